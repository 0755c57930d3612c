"""Near-duplicate documents: many universal hash minima, banding, signature verification, exact confirmation, components.

1. Every whole text becomes its set of word shingles, ``BANDS * ROWS`` minima of universal hashes (a * x + b) of the
   set, one key for each band of minima, and one signature bit for each minimum.
2. Documents with the same set are one node (their smallest doc_id): they need no candidates.
3. Each band bucket's smallest node is its hub. A node's best hub, by signature, is confirmed on the full sets, and
   the confirmed links make first components: a bucket of n near copies costs n comparisons.
4. Where buckets still hold several components, each node tries a few partners of other components for some rounds.
   Then what is open gets the rest: members outside the hub's component against the bucket's members of other
   components, if sizes and signature bits allow it. A pair meets in the first open bucket that both are in and in no
   other; a bucket is dealt in blocks of BLOCK members a side. These pairs are confirmed too, so every pair that shares
   a bucket is either in one component, compared, or cannot have the similarity.
5. In large open buckets most pairs cannot: of their nodes' shingles, those in up to COMMON nodes are rare. Nodes that
   share a rare shingle meet by it, at most COMMON at a time. Any other pair has only common shingles in both sets, so
   the fewer common shingles of the two bound the intersection, exactly; pairs beyond the bound are not compared.
   Pairs of such buckets then compare STRONG further minima (one byte of each) before their texts are fetched.
6. Components by alternating large-star and small-star.

At a similarity of 0.8 a pair shares none of the bands with probability (1 - 0.8^ROWS)^BANDS = 3e-7 and fails each of
the signature tests with about 3e-7.

Nulls, empty texts and texts without words have an empty set and are linked with nothing. A null doc_id gets a row
with a null component and is kept. Repeated rows of one document give equal rows; other texts under the same doc_id
are of one class with it, and only the one with the least xxhash64 looks for near copies. Texts of any length are
taken whole, CHUNK_BYTES or one text at a time. Equal agreement is settled by the smaller doc_id. Other columns are
not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import chunked, mix64, written
from .components import component_stars
from .words import shingles, words

#: Bands, minima in a band; their product is the number of hash functions, 60 bits of signature in each of 4 longs.
BANDS, ROWS = 48, 5
HASHES = BANDS * ROWS
#: Of HASHES signature bits a pair at the threshold agrees in 90 %; five standard deviations below that.
LEAST_BITS = 192
#: Rounds in which nodes of open buckets try a few partners, before all pairs that are still open are compared.
ROUNDS, TRIES = 1, 8
#: Members beyond which an open bucket is large; nodes of large open buckets beyond which a shingle is common.
LARGE, COMMON = 64, 64
#: Members of a side of a block of an open bucket.
BLOCK = 1024
#: Minima of the second signature, and how many must agree: five standard deviations below 80 %.
STRONG, LEAST_STRONG = 1024, 755
#: Ids that are broadcast to select texts, at most (8 bytes each).
MOST_SENT = 1 << 20
_rng = np.random.default_rng(20240601)
_A = _rng.integers(1 << 31, size=HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(1 << 32, size=HASHES, dtype=np.uint32)
_A2 = _rng.integers(1 << 31, size=STRONG, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B2 = _rng.integers(1 << 32, size=STRONG, dtype=np.uint32)
_SEED = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))[:, None]
_ROW = mix64(np.arange(100, 100 + ROWS, dtype=np.uint64)) | np.uint64(1)


def minima(values: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """For each hash function the minimum of a * x + b (mod 2^32) over the 32-bit folded set."""
    x = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(a), np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 256):
        np.minimum(out, (a[:, None] * x[i : i + 256] + b[:, None]).min(axis=1), out=out)
    return out


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch, data, at in chunked(batches):
        _, _, hashes, first = words(data, at)
        sets = shingles(hashes, first, size)
        low = np.stack([minima(s) for s in sets]) if sets else np.zeros((0, HASHES), np.uint32)
        bands = mix64((low.reshape(-1, BANDS, ROWS).astype(np.uint64) * _ROW).sum(axis=2) + _SEED[:, 0])
        bits = (mix64(low.astype(np.uint64) + np.arange(HASHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(1)
        packed = (bits.reshape(-1, 4, HASHES // 4) << np.arange(HASHES // 4, dtype=np.uint64)).sum(axis=2).view(np.int64)
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        keys = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        flat = pa.array(bands.view(np.int64).reshape(-1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(keys[:, k]) for k in (0, 1)), *(pa.array(packed[:, k]) for k in range(4)), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), flat)],
            names=["doc_id", "h", "n", "k0", "k1", "s0", "s1", "s2", "s3", "bands"],
        )


def signatures(docs: DataFrame, size: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    return docs.mapInArrow(lambda b: _sign(b, size), "doc_id long, h long, n long, k0 long, k1 long, s0 long, s1 long, s2 long, s3 long, bands array<long>")


def _agree(a: str, b: str):
    """Signature bits in which two rows agree."""
    return F.lit(HASHES) - sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(4)), F.lit(0))


def _sizes_allow(a: str, b: str, percent: int):
    return (100 * F.least(a, b)) >= percent * F.greatest(a, b)


def _common_allow(percent: int):
    """Whether two sets that share only common shingles, c and bc of them, may have the similarity."""
    most = F.least("c", "bc")
    return 100 * most >= percent * (F.col("n") + F.col("bn") - most)


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose full sets are similar enough."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            sets = []
            for column in ("ta", "tb"):
                data, at = common.flat(part.column(column))
                _, _, hashes, first = words(data, at)
                sets.append(shingles(hashes, first, size))
            keep = []
            for x, y in zip(*sets, strict=True):
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids (one column): broadcast up to MOST_SENT ids, repeated ones included, else a shuffled semi-join."""
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids.distinct(), key, "left_semi")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, whose whole texts' shingle sets have the similarity, exactly. texts (id, t), one row for an id."""
    texts = _only(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    found = pairs.join(texts.withColumnsRenamed({"id": "b", "t": "tb"}), "b").join(texts.withColumnsRenamed({"id": "a", "t": "ta"}), "a")
    return found.select("a", "b", "ta", "tb").mapInArrow(lambda b: _confirm(b, size, percent), "a long, b long")


def _open(members: DataFrame, part: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that hold several; hub_part is the component of the bucket's hub."""
    known = part.withColumnsRenamed({"id": "node", "component": "part"})
    placed = members.join(known, "node", "left").withColumn("part", F.coalesce("part", "node"))
    several = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min_by("part", "node").alias("hub_part")).filter("low < high")
    return placed.join(several.select("key", "hub_part"), "key")


def _linked(part: DataFrame, more: DataFrame) -> DataFrame:
    """Components after further links (a, b): the known ones go in as stars and not with all links again."""
    return component_stars(part.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))


def _tries(left: DataFrame, sign: DataFrame, turn: int, percent: int) -> DataFrame:
    """Up to TRIES pairs for each node: the likeliest of its open buckets' partners, one partner for a bucket and turn."""
    partner = left.groupBy("key").agg(F.min_by(F.struct("node", "n", "part"), F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("p"))
    pairs = left.join(partner, "key").filter((F.col("part") != F.col("p.part")) & _sizes_allow("n", "p.n", percent)).select("node", F.col("p.node").alias("hub")).distinct()
    pairs = pairs.join(sign, "node").join(sign.withColumnsRenamed({"node": "hub", **{f"s{k}": f"h{k}" for k in range(4)}}), "hub")
    pairs = pairs.withColumn("agree", _agree("s", "h")).filter(F.col("agree") >= LEAST_BITS)
    order = Window.partitionBy("node").orderBy(F.desc("agree"), "hub")  # at most BANDS rows
    pairs = pairs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= TRIES)
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch, data, at in chunked(batches, "t"):
        _, _, hashes, first = words(data, at)
        yield batch, shingles(hashes, first, size)


def _shingle_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch, sets in _sets(batches, size):
        node = batch.column("id").take(pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), node], ["shingle", "node"])


def rare_shingles(texts: DataFrame, size: int, common_from: int) -> DataFrame:
    """(shingle, node, met) of the shingles that at most common_from of the texts (id, t) have; met: how many have it."""
    rows = written(texts.mapInArrow(lambda b: _shingle_rows(b, size), "shingle long, node long"), "shingles")
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("met"))
    many = written(counts.filter(F.col("met") > common_from).select("shingle"), "common")
    # the rows of common shingles go before the shuffle, so that no task gets all rows of one
    few = rows.join(F.broadcast(many) if many.count() <= MOST_SENT else many, "shingle", "left_anti")
    return few.join(few.groupBy("shingle").agg(F.count(F.lit(1)).alias("met")), "shingle")


def _strong(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch, sets in _sets(batches, size):
        low = [(mix64(minima(s, _A2, _B2).astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(low, pa.binary())], ["id", "strong"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose second signatures agree enough; a pair without two of them stays."""
    for batch in batches:
        both = pc.and_(batch.column("sa").is_valid(), batch.column("sb").is_valid()).to_numpy(zero_copy_only=False)
        keep, at = ~both, np.flatnonzero(both)
        for i in range(0, len(at), 1024):
            part = batch.take(pa.array(at[i : i + 1024]))
            x, y = (common.flat(part.column(c))[0].reshape(-1, STRONG) for c in ("sa", "sb"))
            keep[at[i : i + 1024]] = (x == y).sum(axis=1) >= LEAST_STRONG
        yield batch.filter(pa.array(keep)).select(["a", "b"])


def _blocks(rows: DataFrame, keys: DataFrame, own: str, others: str) -> DataFrame:
    """Rows of open buckets, each in one block of its own side and in every block of the other side."""
    rows = rows.join(keys, "key").withColumn(own, F.pmod(F.xxhash64("node"), F.ceil(F.col(f"n_{own}") / BLOCK)))
    return rows.withColumn(others, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(f"n_{others}") / BLOCK) - 1))).drop(f"n_{own}", f"n_{others}")


def open_pairs(left: DataFrame, percent: int) -> DataFrame:
    """(a, b), each once: members outside a bucket's hub's component with its members of other components that bounds allow.

    left: members of open buckets with their signatures and c, the shingles that a pair may share unseen.
    """
    own = left.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("own"))  # at most BANDS keys
    left = left.join(own, "node").withColumn("before", F.filter("own", lambda k: k < F.col("key")))
    left = left.withColumn("outside", F.col("part") != F.col("hub_part"))
    keys = left.groupBy("key").agg(F.count_if("outside").alias("n_block"), F.count(F.lit(1)).alias("n_other")).filter("n_block > 0")
    outside = _blocks(left.filter("outside").select("key", "node", "n", "c", "part", "before", "s0", "s1", "s2", "s3"), keys, "block", "other")
    inside = _blocks(left.select("key", "node", "n", "c", "part", "outside", "before", "s0", "s1", "s2", "s3"), keys, "other", "block")
    inside = inside.withColumnsRenamed({"node": "b", "n": "bn", "c": "bc", "part": "bpart", "outside": "boutside", "before": "bbefore", **{f"s{k}": f"h{k}" for k in range(4)}})
    met = outside.join(inside, ["key", "block", "other"])
    met = met.filter((F.col("part") != F.col("bpart")) & (~F.col("boutside") | (F.col("node") < F.col("b"))) & _sizes_allow("n", "bn", percent) & _common_allow(percent) & (_agree("s", "h") >= LEAST_BITS) & ~F.arrays_overlap("before", "bbefore"))
    return met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    docs is read several times. Links join documents with 100 * |intersection| >= percent * |union| of their sets of
    size-word shingles; percent below 80 would lower the chance that a pair meets in a band.
    """
    signed = written(signatures(docs, size), "signed")
    filled = signed.filter("n > 0 and doc_id is not null")
    groups = written(filled.groupBy("k0", "k1", "n").agg(F.min("doc_id").alias("node")), "groups")
    nodes = filled.join(groups.select(F.col("node").alias("doc_id"), "k0", "k1"), ["doc_id", "k0", "k1"], "left_semi")
    nodes = nodes.groupBy(F.col("doc_id").alias("node")).agg(F.min_by(F.struct("n", "s0", "s1", "s2", "s3", "bands"), "h").alias("x"))
    nodes = written(nodes.select("node", "x.*"), "nodes")

    rows = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = written(rows.join(shared, "key").select("key", "node", "n", "members", "hub"), "members")

    sign = nodes.select("node", "s0", "s1", "s2", "s3")
    other = nodes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), *(F.col(f"s{k}").alias(f"h{k}") for k in range(4)))
    star = members.filter(F.col("node") != F.col("hub")).select("node", "n", "hub").distinct()
    star = star.join(sign, "node").join(other, "hub").withColumn("agree", _agree("s", "h")).filter((F.col("agree") >= LEAST_BITS) & _sizes_allow("n", "hub_n", percent))
    best = star.groupBy("node").agg(F.max_by("hub", F.struct("agree", -F.col("hub"))).alias("hub"))
    shown = written(members.select(F.col("node").alias("id")).distinct(), "shown")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
    texts = _only(texts, shown, "id").groupBy("id").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    texts = written(texts, "texts", compression="zstd")
    best = written(best.select(F.col("hub").alias("a"), F.col("node").alias("b")), "best")
    # written, as a task that confirms and combines at once takes two Python workers, and an executor keeps them
    part = component_stars(written(confirmed(best, texts, size, percent), "linked"))

    left = written(_open(members, part), "open")
    for turn in range(ROUNDS):
        some = written(confirmed(written(_tries(left, sign, turn, percent), "tries"), texts, size, percent), "tried")
        if some.isEmpty():
            break
        part = _linked(part, some)
        left = written(_open(left.drop("part", "hub_part"), part), "open")

    # exactly what is left: every pair of a bucket that no confirmed link joins yet
    left = left.join(sign, "node")
    crowd = written(left.filter(F.col("members") > LARGE).select("node", "n", "part", "s0", "s1", "s2", "s3").distinct(), "crowd")
    crowd_texts = _only(texts, crowd.select(F.col("node").alias("id")), "id")
    rare = written(rare_shingles(crowd_texts, size, COMMON), "rare")
    left = left.join(rare.groupBy("node").agg(F.count(F.lit(1)).alias("rare")), "node", "left")
    left = left.withColumn("c", F.when(F.col("members") > LARGE, F.col("n") - F.coalesce("rare", F.lit(0))).otherwise(F.col("n")))
    several = rare.filter("met > 1").select("shingle", "node")
    pairs = several.join(several.withColumnRenamed("node", "b"), "shingle").filter("node < b").select("node", "b").distinct()
    pairs = pairs.join(crowd, "node").join(crowd.withColumnsRenamed({"node": "b", "n": "bn", "part": "bpart", **{f"s{k}": f"h{k}" for k in range(4)}}), "b")
    pairs = pairs.filter((F.col("part") != F.col("bpart")) & _sizes_allow("n", "bn", percent) & (_agree("s", "h") >= LEAST_BITS)).select(F.col("node").alias("a"), "b")
    rest = written(open_pairs(left, percent).unionAll(pairs).distinct(), "rest")
    strong = written(crowd_texts.mapInArrow(lambda b: _strong(b, size), "id long, strong binary"), "strong")
    rest = rest.join(strong.withColumnsRenamed({"id": "a", "strong": "sa"}), "a", "left").join(strong.withColumnsRenamed({"id": "b", "strong": "sb"}), "b", "left")
    rest = written(rest.select("a", "b", "sa", "sb").mapInArrow(_alike, "a long, b long"), "alike")
    more = written(confirmed(rest, texts, size, percent), "more")
    component = part if more.isEmpty() else _linked(part, more)

    whole = groups.join(component.withColumnsRenamed({"id": "node"}), "node", "left").select("k0", "k1", "n", F.coalesce("component", "node").alias("component_id"))
    done = filled.select("doc_id", "n", "k0", "k1").join(whole, ["k0", "k1", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.filter("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return done.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents: two-word shingles, similarity 0.8."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), size=2, percent=80)
