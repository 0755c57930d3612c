import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerweave.llm import sentences

from .helpers import CLASH, ODD, documents

MODEL = "piece_bpe_32k.model"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
TEXT = st.one_of(
    st.text(max_size=40),
    st.lists(st.sampled_from([*"abetionsTHE019 .,;'\"(-\n\t", "  ", "    ", "▁", "▁▁", "é", "中", "\U0001f600", "\x00", "<s>", "<0x0A>", "tion", " the", "́", " ", "‍"]), max_size=40).map("".join),
)


def brute_merge(text):
    """The definition: again and again the best-scored adjacent pair, leftmost of equals, searched from the start."""
    score = {LIBRARY.id_to_piece(i): LIBRARY.get_score(i) for i in range(LIBRARY.vocab_size()) if not (LIBRARY.is_control(i) or LIBRARY.is_byte(i) or LIBRARY.is_unknown(i))}
    symbols = list(LIBRARY.normalize(text))
    while found := [(-score[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in score]:
        _, i = min(found)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return [i for s in symbols for i in ([LIBRARY.piece_to_id(s)] if s in score else [LIBRARY.piece_to_id(f"<0x{b:02X}>") for b in s.encode()])]


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(TEXT, max_size=6))
def test_same_as_the_library(texts):
    mine = sentences.vocabulary(MODEL)
    ids, at = mine.encode(texts)
    got = [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))]
    assert got == [LIBRARY.encode(t) for t in texts]
    assert mine.decode(ids, at) == [LIBRARY.decode(x) for x in got]


@settings(max_examples=200, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 300), st.sampled_from([3 + b for b in "é中\U0001f600".encode()]), st.integers(0, 31999)), max_size=12))
def test_decodes_any_ids(ids):
    assert sentences.vocabulary(MODEL).decode(np.array(ids, np.int32), np.array([0, len(ids)])) == [LIBRARY.decode(ids)]


def test_agenda_is_the_definition():
    rng = random.Random(3)
    for text in ("the nation's  hesitation", "aaaaaaaaaaaaa", "".join(rng.choice("etaoinsh ") for _ in range(300))):
        mine = sentences.vocabulary(MODEL)
        assert mine.agenda(LIBRARY.normalize(text)) == brute_merge(text) == LIBRARY.encode(text)
        assert mine._by_list(LIBRARY.normalize(text)) == mine._by_heap(LIBRARY.normalize(text))


def test_rows(spark):
    texts = [*ODD, "x▁y " * 400, "a" * 20000]
    ids = [*range(len(texts) - 1), None]
    got = {r["doc_id"]: r for r in sentences.encoded(documents(spark, texts, ids), MODEL).collect()}
    assert len(got) == len(texts) and set(CLASH).isdisjoint(got[0].asDict())
    for k, text in zip(ids, texts, strict=True):
        assert list(got[k]["ids"]) == LIBRARY.encode(text or "") and got[k]["decoded"] == LIBRARY.decode(list(got[k]["ids"]))
    assert sentences.encoded(documents(spark, []), MODEL).count() == 0


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = sentences.op12_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))


def test_a_difference_stops_the_job():
    mine = sentences.MergeVocabulary(public_tokenizers.path(MODEL))
    del mine.cost["▁the"]
    mine.encode(["so the then"])
    with pytest.raises(ValueError, match="other ids"):
        mine.check_segments()


def test_segments_are_forgotten(monkeypatch):
    monkeypatch.setattr(sentences, "REMEMBERED", 2)
    mine = sentences.MergeVocabulary(public_tokenizers.path(MODEL))
    for text in ("one two three four", "four five six", "one"):
        assert mine.encode([text])[0].tolist() == LIBRARY.encode(text)


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(TEXT, max_size=6))
def test_segments_are_checked_together(texts):
    mine = sentences.vocabulary(MODEL)
    mine.clear()
    mine.encode(texts)
    mine.check_segments()
    assert mine.border and not mine.new
