import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerweave.llm import common, planes

from .helpers import ODD, documents


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("most", [1, 2, 255, 256, 49407, 2**32 - 1])
def test_planes_round_trip(kind, most):
    ids = np.random.default_rng(0).integers(0, most, 1001, endpoint=True).astype(np.uint32)
    assert (planes.from_planes(planes.to_planes(ids, kind), len(ids), kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_random_access(kind):
    out = io.BytesIO()
    writer = planes.PlaneWriter(out, kind, block_ids=16)
    parts = [np.arange(n, dtype=np.uint32) * 7 for n in (0, 5, 40, 1, 16)]
    for k, p in enumerate(parts):
        writer.add(np.array([k]), np.array([len(p)]), p)
    writer.close()
    reader, whole = planes.PlaneReader(io.BytesIO(out.getvalue())), np.concatenate(parts)
    assert (reader.ids(3, 57) == whole[3:57]).all()
    assert [(d, s, i.tolist()) for d, s, i in reader.documents()] == [(k, sum(map(len, parts[:k])), p.tolist()) for k, p in enumerate(parts)]
    with pytest.raises(ValueError):
        planes.PlaneReader(io.BytesIO(out.getvalue()[:-3]))


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_of_documents(spark, kind):
    path = common.new_path(spark, "test-planes")
    ids = [5, 3, 1, 0, 9, 8, 7, 6, 2, 12, 11, 10]
    planes.write_planes(documents(spark, ODD, ids), path, "word_bpe_49k.json", 1, kind, block_ids=50, file_text_bytes=4000)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in planes.read_planes(spark, path).collect()}
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for i, text in sorted(zip(ids, ODD, strict=True)):
        x = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] = (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert got == want


def test_empty_table(spark):
    path = common.new_path(spark, "test-planes")
    planes.write_planes(documents(spark, []), path, "word_bpe_49k.json", 1)
    assert planes.read_planes(spark, path).count() == 0


def test_null_least_and_repeated_ids(spark):
    path, least = common.new_path(spark, "test-planes"), -(2**63)
    texts, ids = ["b", "a", None, "c", "word " * 9, ""], [4, 4, least, None, None, 5]
    planes.write_planes(documents(spark, texts, ids), path, "word_bpe_49k.json", 1, block_ids=4)
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, text in sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        x = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert [tuple(r) for r in planes.read_planes(spark, path).orderBy("start").collect()] == want
