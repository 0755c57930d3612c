import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerweave.llm.tokens import encoder

VOCABULARIES = ("word_bpe_49k.json", "byte_bpe_50k.json")
TEXT = st.lists(st.sampled_from(list("abcXYZ019 \n.,!'*-") + ["  ", "é", "Ñ", "ß", "×", "½", "中", " ", "́", "'s", "<|endoftext|>", "\t"]), max_size=60).map("".join)


@pytest.mark.parametrize("name", VOCABULARIES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_same_as_the_library(name, texts):
    mine = encoder(name)
    ids, at = mine.encode(pa.array(texts, pa.string()))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == mine.whole([t or "" for t in texts])


@pytest.mark.parametrize("name", VOCABULARIES)
def test_cache_starts_anew(name, monkeypatch):
    from ledgerweave.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    monkeypatch.setattr(tokens, "SLOTS", 4)
    mine = tokens.PieceEncoder(tokens.public_tokenizers.path(name))
    for texts in (["one two three four five six"], ["six seven one two"], ["one one two"]):
        ids, at = mine.encode(pa.array(texts))
        assert ids.tolist() == mine.whole(texts)[0]
