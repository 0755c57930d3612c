"""Phrase collocations from depth-truncated suffix subtrees, built independently for groups of word prefixes.

1. Texts become blocks: a dictionary of words, how often each occurs, and their numbers in order, 0 where a piece ends.
   Blocks of a language hold up to BLOCK words and are written once.
2. Dictionaries meet by word: words that occur often enough get whole numbers, the most frequent the smallest, and
   blocks are written again in these numbers. Any other word ends a phrase.
3. Vertical partitioning: one-word prefixes with more than ``budget`` occurrences are split by their second word, those
   with more again by their third, then their fourth. All other prefixes go by their numbers to buckets, and buckets, in
   order, to groups of at most ``budget`` suffixes. The driver holds the prefixes that are split, of which there are at
   most words / budget on each level, and four to eight buckets for each group.
4. Each block sends each group its suffixes, cut to WORDS words, equal ones counted, as compressed byte planes. A
   group's subtree is their sorted order: leaves are distinct suffixes, and a node's count is the sum of its leaves.
   Nodes above the level that a group's prefixes were split at have exact counts from step 3.
5. Phrases meet the counts of their parts by joins; a phrase is covered if a longer one that holds it has nearly its
   count; the best of each language come from a ranking of ranked slices.

A language has a third of all words or more without harm: its prefixes are split as any others. Null texts are empty,
null languages ``und``; a text of any length is cut into blocks (a word of any length is one entry). Repeated rows
count again. Ties are settled by score, count, then the phrase's bytes. No doc_id or other column is read, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import drop, written

#: Words of a phrase at most, its least count, and the percentage of its count from which a longer phrase covers it.
WORDS, LEAST, COVERED = 4, 30, 80
#: Suffixes of a group, and words of a block, at most.
BUDGET, BLOCK = 2_000_000, 2_000_000
#: Slices in which a language's phrases are ranked before they are ranked together.
SLICES = 256
_STOP = b"\xff"  # in no UTF-8 text
_TABLE = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = 1_000_003  # of the sum that deals prefixes to buckets


def word_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, lang, words, n, ids): number k of ids is the k-th of words, from 1; 0 ends a piece; n counts the words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        parts: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def done(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            words = pa.array([w.decode() for w in list(known.pop(lang))[1:]], pa.string())
            ids = np.concatenate(parts.pop(lang)).astype("<i4")
            counts = np.bincount(ids[ids > 0], minlength=len(words) + 1)[1:]
            size.pop(lang)
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), listed(words), listed(pa.array(counts)), pa.array([ids.tobytes()], pa.binary())], ["block", "lang", "words", "n", "ids"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                words = text.encode().translate(_TABLE).replace(_STOP, b" \xff ").split()  # what is left to split at are 0x20 and 0x09
                for i in range(0, len(words), block):
                    # a part that goes on in the next block ends in the words that begin there, so that no phrase is lost
                    part = words[i : i + block + WORDS - 1]
                    own = known.setdefault(lang, {_STOP: 0})
                    numbers = np.fromiter((own.setdefault(w, len(own)) for w in part), np.int64, len(part))
                    numbers[block:] *= -1  # they start no phrase here
                    parts.setdefault(lang, []).extend([numbers, np.zeros(1, np.int64)])
                    size[lang] = size.get(lang, 0) + min(block, len(part))
                    if size[lang] >= block:
                        yield done(lang)
            if sum(size.values()) >= 2 * block:
                yield from map(done, list(size))
        yield from map(done, list(size))

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "block long, lang string, words array<string>, n array<long>, ids binary")


def frequent_words(blocks: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(block, local, lang, word) of the words that occur least times or more, and (id, lang, word, n), the most frequent first."""
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "n")).alias("local", "w")).select("block", "lang", (F.col("local") + 1).alias("local"), F.col("w.words").alias("word"), F.col("w.n").alias("n"))
    # a word has one row for each block at most
    live = words.withColumn("n", F.sum("n").over(Window.partitionBy("lang", "word"))).filter(F.col("n") >= least)
    live = written(live, "phrase-words")
    sorted_ = live.groupBy("lang", "word").agg(F.first("n").alias("n")).orderBy(F.desc("n"), "lang", "word").withColumn("at", F.monotonically_increasing_id())
    sorted_ = written(sorted_, "phrase-sorted")
    part = F.shiftright("at", 33)
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row for each partition
    if sum(r["n"] for r in sizes) >= 1 << 31:
        raise ValueError("more than 2^31 frequent words")
    before = dict(zip([r["part"] for r in sizes], np.cumsum([1, *(r["n"] for r in sizes)]).tolist(), strict=False))
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0), F.lit(1))
    numbered = sorted_.select((offset[part] + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("id"), "lang", "word", "n")
    return live.drop("n"), numbered


def coded_blocks(blocks: DataFrame, live: DataFrame, frequent: DataFrame) -> DataFrame:
    """(ids): blocks in the numbers of frequent words; 0 for other words and ends of pieces, negative where no phrase starts."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i4")
                own = np.zeros(row["size"] + 1, np.int32)
                own[row["local"]] = row["id"]
                yield pa.RecordBatch.from_arrays([pa.array([(own[np.abs(ids)] * np.sign(ids)).astype("<i4").tobytes()], pa.binary())], ["ids"])

    own = live.join(frequent.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("local", "id")).alias("x"))  # at most a block's dictionary
    rows = blocks.select("block", F.size("words").alias("size"), "ids").join(own, "block")
    return rows.select("size", "ids", F.col("x.local").alias("local"), F.col("x.id").alias("id")).mapInArrow(code, "ids binary")


class Plan:
    """What tasks need: by level, the prefixes that are split further and the groups of the buckets of all others."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.split: list[np.ndarray] = []  # sorted rows of 1, 2, ... numbers
        self.group: list[np.ndarray] = []
        self.groups = 0

    def bucket(self, prefix: np.ndarray) -> np.ndarray:
        """Of prefixes, one in each column."""
        out = np.zeros(prefix.shape[1], np.int64)
        for row in prefix:
            out = (out * _STEP + row) % self.buckets
        return out

    def add(self, counts: DataFrame, budget: int) -> None:
        """counts (p0, p1, ..., n): a level's frequent prefixes, and groups for the buckets of all others. Leaves are never split."""
        depth = len(self.split) + 1
        columns = [f"p{k}" for k in range(depth)]
        large = (F.col("n") > budget) if depth < WORDS else F.lit(False)
        found = counts.filter(large).select(*columns).toArrow()  # at most words / budget
        self.split.append(np.array([found.column(c).to_numpy() for c in columns], np.int64).reshape(depth, -1))
        bucket = F.lit(0).cast("long")
        for c in columns:
            bucket = (bucket * _STEP + F.col(c)) % self.buckets
        sums = counts.filter(~large).groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).toArrow()  # at most buckets
        weights = np.zeros(self.buckets, np.int64)
        weights[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
        group, filled = np.zeros(self.buckets, np.int64), 0
        for k, n in enumerate(weights.tolist()):
            if filled and filled + n > budget:
                self.groups, filled = self.groups + 1, 0
            group[k], filled = self.groups, filled + n
        self.group.append(group)
        self.groups += 1


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes, n) of each block: distinct suffixes of two words or more, WORDS rows in sorted order, 0 behind a phrase's end; their counts."""
    for batch in batches:
        for raw in batch.column("ids"):
            ids = np.frombuffer(raw.as_buffer(), "<i4").astype(np.int64)
            padded = np.concatenate([np.abs(ids), np.zeros(WORDS, np.int64)])
            at = np.flatnonzero((ids > 0) & (padded[1 : len(ids) + 1] > 0))
            rows = np.stack([padded[at + k] for k in range(WORDS)])
            for k in range(1, WORDS):
                rows[k][rows[k - 1] == 0] = 0
            yield _counted(rows, np.ones(rows.shape[1], np.int64))


def _counted(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of an array of WORDS rows of numbers under 2^32, sorted, and the sums of their n."""
    high, low = rows[0] << 32 | rows[1], rows[2] << 32 | rows[3]
    order = np.argsort(high, kind="stable")
    high, low = high[order], low[order]
    same = high[1:] == high[:-1]
    if same.any():  # only ties of the first two words are ordered by the others
        mine = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        inner = np.lexsort((low[mine], high[mine]))
        order[mine], low[mine] = order[mine][inner], low[mine][inner]
    head = np.ones(len(order), bool)
    head[1:] = ~same | (low[1:] != low[:-1])
    at = np.flatnonzero(head)
    return rows[:, order[at]], np.add.reduceat(n[order], at) if len(at) else n[:0]


def _heads(rows: np.ndarray, depth: int) -> np.ndarray:
    """Where sorted rows begin with other words than the row before."""
    head = np.ones(rows.shape[1], bool)
    head[1:] = (rows[:depth, 1:] != rows[:depth, :-1]).any(axis=0)
    return np.flatnonzero(head)


def _among(prefix: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which columns of prefix are columns of wanted."""
    if not wanted.shape[1]:
        return np.zeros(prefix.shape[1], bool)
    known = set(zip(*wanted.tolist(), strict=True))
    near = np.isin(prefix[0], wanted[0])
    near[near] = [p in known for p in zip(*prefix[:, near].tolist(), strict=True)]
    return near


def _levels(rows: np.ndarray, plan: Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level (depth, places, heads, split): the rows that get there, where their prefixes begin, and which of these are split."""
    mine = np.arange(rows.shape[1])
    for depth in range(1, min(len(plan.split) + 1, WORDS) + 1):
        if not len(mine):
            return
        heads = _heads(rows[:, mine], depth)
        split = _among(rows[:depth, mine[heads]], plan.split[depth - 1]) if depth <= len(plan.split) else np.zeros(len(heads), bool)
        yield depth, mine, heads, split
        mine = mine[np.repeat(split, np.diff(np.append(heads, len(mine))))]


def prefix_counts(coded: DataFrame, plan: Plan) -> DataFrame:
    """(p0, p1, ..., n) one word deeper than the plan goes, under the prefixes that it splits; a 0 where a phrase ends before."""
    shared, depth = coded.sparkSession.sparkContext.broadcast(plan), len(plan.split) + 1
    columns = [f"p{k}" for k in range(depth)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n in _suffixes(batches):
            for level, mine, heads, _ in _levels(rows, shared.value):
                if level == depth:
                    yield pa.RecordBatch.from_arrays([*(pa.array(rows[k, mine[heads]].astype(np.int32)) for k in range(depth)), pa.array(np.add.reduceat(n[mine], heads))], [*columns, "n"])

    return coded.mapInArrow(count, ", ".join(f"{c} int" for c in columns) + ", n long").groupBy(*columns).agg(F.sum("n").alias("n"))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers under 2^32 as compressed byte planes; sorted first rows are stored as differences."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").reshape(-1).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def subtrees(coded: DataFrame, plan: Plan, least: int) -> DataFrame:
    """(ids, n): nodes of two words or more with n >= least, but for those above the level of their group."""
    shared = coded.sparkSession.sparkContext.broadcast(plan)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for rows, n in _suffixes(batches):
            for depth, mine, heads, split in _levels(rows, plan):
                number = np.where(split, -1, plan.group[depth - 1][plan.bucket(rows[:depth, mine[heads]])])
                group = np.repeat(number, np.diff(np.append(heads, len(mine))))
                order = np.argsort(group, kind="stable")
                bounds = np.flatnonzero(np.diff(group[order], prepend=-2, append=-2))
                numbers = group[order[bounds[:-1]]]
                sent = []
                for a, b, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), numbers.tolist(), strict=True):
                    if k >= 0:
                        part = mine[order[a:b]]
                        first = np.diff(rows[0, part], prepend=0)
                        sent.append((k, depth, _packed(np.concatenate([first, *rows[1:, part], n[part]]))))
                if sent:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*sent, strict=True)], ["part", "depth", "rows"])

    def build(_: tuple, table: pa.Table) -> pa.Table:
        parts = [_unpacked(raw).reshape(WORDS + 1, -1) for raw in table.column("rows").to_pylist()]
        for p in parts:
            p[0] = np.cumsum(p[0])
        all_ = np.concatenate(parts, axis=1)
        rows, n = _counted(all_[:WORDS], all_[WORDS])
        ids, counts = [], [np.zeros(0, np.int64)]
        for k in range(max(2, table.column("depth")[0].as_py()), WORDS + 1):
            heads = _heads(rows, k)
            total = np.add.reduceat(n, heads)
            kept = (total >= least) & (rows[k - 1, heads] > 0)
            ids += rows[:k, heads[kept]].T.tolist()
            counts.append(total[kept])
        return pa.table({"ids": pa.array(ids, pa.list_(pa.int32())), "n": pa.array(np.concatenate(counts))})

    sent = coded.mapInArrow(send, "part long, depth long, rows binary")
    return sent.groupBy("part").applyInArrow(build, "ids array<int>, n long")


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, n) of all phrases of 1 to WORDS words that occur least times or more; (id, lang, word, n); and (lang, n): all words."""
    blocks = written(word_blocks(docs, block), "phrase-blocks", compression="zstd")
    totals = written(blocks.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")), "phrase-totals")
    live, frequent = frequent_words(blocks, least)
    frequent = written(frequent, "phrase-numbers")
    coded = written(coded_blocks(blocks, live, frequent), "phrase-coded", compression="zstd")
    made = [blocks, live, coded]
    plan = Plan(1 << max(10, int(4 * (frequent.agg(F.sum("n")).first()[0] or 0) // budget).bit_length()))
    plan.add(frequent.select(F.col("id").alias("p0"), "n"), budget)
    nodes = frequent.select(F.array("id").alias("ids"), "n")
    while plan.split[-1].shape[1]:
        size = len(plan.split) + 1
        deeper = written(prefix_counts(coded, plan), "phrase-prefixes")
        made.append(deeper)
        plan.add(deeper, budget)
        if size < WORDS:
            nodes = nodes.unionAll(deeper.filter((F.col("n") > budget) & (F.col(f"p{size - 1}") > 0)).select(F.array(*(f"p{k}" for k in range(size))).alias("ids"), "n"))
    nodes = written(nodes.unionAll(subtrees(coded, plan, least)), "phrase-nodes")
    for table in made:
        drop(table)
    return nodes, frequent, totals


def collocations(docs: DataFrame, top: int, least: int = LEAST, covered: int = COVERED, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's top phrases of 2 to WORDS words.

    a, l and r count the phrase and its two parts at the cut that scores lowest; score is floor(2000000 a / (l + r)).
    """
    nodes, frequent, totals = phrase_counts(docs, least, budget, block)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    size = F.size("ids")
    inner = F.explode(F.expr("flatten(transform(sequence(2, size(ids) - 1), k -> transform(sequence(1, size(ids) - k + 1), i -> slice(ids, i, k))))"))
    longer = nodes.filter(size > 2).select(inner.alias("ids"), "n").groupBy("ids").agg(F.max("n").alias("longest"))
    found = nodes.filter(size > 1).select("ids", F.col("n").alias("a")).join(longer, "ids", "left")
    found = found.filter(F.col("longest").isNull() | (exact("longest") * 100 < exact("a") * covered)).drop("longest")
    cuts = found.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", 1, F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(nodes.select(F.col("ids").alias("first"), F.col("n").alias("l")), "first").join(nodes.select(F.col("ids").alias("rest"), F.col("n").alias("r")), "rest")
    cuts = cuts.withColumn("score", F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("ids", "a", "cut.l", "cut.r", "cut.score")
    # words for what can be among the first: in slices, ties kept, since only the words settle them
    best = best.join(frequent.select(F.col("id").alias("_id"), "lang"), F.get("ids", F.lit(0)) == F.col("_id")).drop("_id").withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(SLICES)))
    best = best.withColumn("near", F.rank().over(Window.partitionBy("lang", "slice").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("near") <= top)
    words = best.select("ids", F.posexplode("ids").alias("at", "id")).join(frequent.select("id", "word"), "id").groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = best.join(words, "ids").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations(common.table(spark, sf_dir, "documents"), 2000)


#: The same for small tables, where tests compare the two: its lists make it too slow for whole ones, so it is no registered twin.
OP11_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\v\\f\\r]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest(range(1, {WORDS + 1})) AS size) WHERE len(ws) >= size),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
often AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS ws FROM counts WHERE size > 1 AND f >= {LEAST}),
inside AS (
  SELECT lang, f, unnest(list_transform(range(1, size - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM often, (SELECT unnest(range(2, {WORDS})) AS k) WHERE k < size),
longer AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
cuts AS (
  SELECT o.lang, o.phrase, o.f AS a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * o.f) // (l.f + r.f) AS score
  FROM often o JOIN (SELECT unnest(range(1, {WORDS})) AS k) ON k < o.size
  JOIN counts l ON l.lang = o.lang AND l.size = k AND l.phrase = array_to_string(o.ws[1:k], ' ')
  JOIN counts r ON r.lang = o.lang AND r.size = o.size - k AND r.phrase = array_to_string(o.ws[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.f IS NULL OR 100::HUGEINT * g.f < {COVERED}::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
