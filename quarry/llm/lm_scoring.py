"""Language-model scoring of whole documents.

Words are counted over all training documents. The most frequent ones, a bounded number, are sent to all executors;
only the rare words of a document are joined to their counts. Documents are then read once more and written as units of
the model, whose number grows with the vocabulary. A gated recurrent model is trained on shards of the training
documents' units, whose weights are averaged, and scores each document from its first to its last word.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recurrent
from .common import discard, materialize, remainder, slices, small_batches, text_or_empty
from .words import hashed_words

#: Words whose counts every executor holds.
HEAD = 200_000
#: A shard has about so many training documents for every UNITS of the model, so the shards' weights keep to a share of the input.
SHARD_DOCS = 1_500
UNITS = 4_096
#: But not over so many times SHARD_DOCS, as a task holds its shard's units in memory.
MOST = 8
#: Documents that are scored side by side, as far as a batch has them: the more, the less the longest one runs alone.
SCORED = 8_192
#: A document's end, counted as a token: a number in the place of a word's hash.
END = np.int64(-7_046_029_254_386_353_131)
#: Tokens that a task counts before it gives their counts on.
_FLUSH = 1 << 22
#: Weights that are added up at once.
_PIECE = 1 << 16


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit hashes of all tokens of the texts in order, and offsets: text i has offsets[i]:offsets[i + 1], its end last."""
    found, at = hashed_words(texts)
    offsets = at + np.arange(len(at))
    out = np.empty(int(offsets[-1]), np.int64)
    ends = offsets[1:] - 1
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = found.view(np.int64), END
    return out, offsets


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash), n over all rows of ``docs`` (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["word", "n"])

        for batch in slices(batches):
            held.append(tokens(batch.column(0).cast(pa.binary()).to_pylist())[0])
            if sum(map(len, held)) > _FLUSH:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def own_leaves(leaves: int) -> int:
    """Units of a bucket that are single words; one in eight is shared, and one at least."""
    return leaves - max(1, leaves // 8)


def shared_units(found: np.ndarray, buckets: int, leaves: int) -> np.ndarray:
    """Of words that share a unit: its number within all buckets."""
    own = own_leaves(leaves)
    at = found % (buckets * (leaves - own))
    return at % buckets * leaves + own + at // buckets


def ranks_of(head: np.ndarray, order: np.ndarray, found: np.ndarray, buckets: int, leaves: int) -> np.ndarray:
    """Ranks of tokens among the head words, or -1 less their shared unit; ``order`` sorts the head."""
    other = -1 - shared_units(found, buckets, leaves)
    if not len(head):
        return other
    ordered = head[order]
    at = np.minimum(np.searchsorted(ordered, found), len(head) - 1)
    return np.where(ordered[at] == found, order[at], other)


def units_of_ranks(head: np.ndarray, buckets: int, leaves: int) -> np.ndarray:
    """Units of the head words: the first ``buckets`` of them are before the buckets, the next are dealt over the buckets."""
    at = np.arange(len(head))
    within = at - buckets
    dealt = np.where(within < buckets * own_leaves(leaves), within % buckets * leaves + within // buckets, shared_units(head, buckets, leaves))
    return np.where(at < buckets, at, buckets + dealt)


def _units(ranks: np.ndarray, of_rank: np.ndarray, buckets: int) -> np.ndarray:
    out = buckets - 1 - ranks
    inside = ranks >= 0
    out[inside] = of_rank[ranks[inside]]
    return out


def bucket_masses(counts: DataFrame, head: np.ndarray, head_n: np.ndarray, buckets: int, leaves: int) -> np.ndarray:
    """Of each bucket's units: the counts of its words, plus one for each of them, and one for all words not counted where
    they may fall."""
    own = own_leaves(leaves)
    modulus = buckets * (leaves - own)
    found = counts.groupBy(F.pmod("word", F.lit(modulus)).alias("at")).agg((F.sum("n") + F.count(F.lit(1))).alias("mass")).toArrow()  # a row a shared unit
    out = np.zeros(buckets * leaves)
    out[shared_units(np.arange(modulus), buckets, leaves)] = 1
    out[shared_units(found.column("at").to_numpy(), buckets, leaves)] += found.column("mass").to_numpy()
    alone, dealt = slice(0, buckets * (1 + own)), slice(buckets, buckets * (1 + own))
    np.subtract.at(out, shared_units(head[alone], buckets, leaves), head_n[alone] + 1.0)
    out[units_of_ranks(head, buckets, leaves)[dealt] - buckets] = head_n[dealt] + 1.0
    return out.reshape(buckets, leaves)


def unit_type(units: int) -> str:
    return "<u2" if units <= 1 << 16 else "<i4"


def train_model(units: DataFrame, start: recurrent.Weights, n_docs: int) -> recurrent.Weights:
    """Weights averaged over shards, each of which trains once over its documents (doc_id, units); every row is in one.

    The shards' weights are added up as a tree: within groups, about the root of the shards in number, then over them.
    """
    side, leaves, n_units = start["w"].shape[1], recurrent.leaves_of(start), len(start["x"]) - 1
    kind, packed = unit_type(n_units), recurrent.pack(start)
    shards = max(1, -(-n_docs // (SHARD_DOCS * min(MOST, max(1, n_units // UNITS)))))
    pieces, groups = -(-len(packed) // _PIECE), math.isqrt(shards - 1) + 1
    shared = units.sparkSession.sparkContext.broadcast(packed)  # grows with the square root of the vocabulary

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for shard, key, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(shard, []).append((key or 0, x))
        for shard in sorted(held):
            found = sorted(held.pop(shard))
            size = sum(len(x) for _, x in found)
            out = recurrent.pack(recurrent.train(recurrent.unpack(shared.value, side, leaves), [np.frombuffer(x, kind) for _, x in found]))
            parts = [x.tobytes() for x in np.array_split(out, pieces)]
            group = zlib.crc32(parts[0]) % groups
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([group] * pieces, pa.int32()), pa.array([size] * pieces, pa.int64()), pa.array(parts, pa.binary())], names=["piece", "part", "size", "weights"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in slices(batches, 16):
            for piece, size, weights in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                old = kept.setdefault(piece, [0, 0.0])
                old[0] += size
                old[1] = old[1] + np.frombuffer(weights, "f4") * float(size)
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array([0] * len(kept), pa.int32()), pa.array([v[0] for v in kept.values()], pa.int64()), pa.array([(v[1] / v[0]).astype("f4").tobytes() for v in kept.values()], pa.binary())], names=["piece", "part", "size", "weights"])

    schema = "piece int, part int, size long, weights binary"
    # However many partitions there are, a shard is in one, and writes its weights once.
    rows = units.select(F.pmod(F.hash(F.xxhash64("doc_id")), F.lit(shards)).alias("shard"), "doc_id", "units")
    learned = materialize(rows.repartition(4 * shards, "shard").mapInArrow(learn, schema), "weights")
    grouped = learned.repartition(pieces * groups, "piece", "part").mapInArrow(add, schema)
    rows = sorted(grouped.repartition(pieces, "piece").mapInArrow(add, schema).collect(), key=lambda r: r["piece"])
    discard(learned)
    if not rows:
        return start
    return recurrent.unpack(np.concatenate([np.frombuffer(bytes(r["weights"]), "f4") for r in rows]), side, leaves)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Training documents are those whose crc32(doc_id as text) mod 7 is not 2. Tokens are the lower-cased (A-Z) words
    and one end for each document. base_score is the add-one unigram log10-likelihood, score the recurrent model's. A
    null or empty text is one end. Every word is read and predicted by the model: the most frequent ones, 29
    times the square root of the distinct words' number, by themselves, the others by a shared unit and their add-one
    counted share of it. Repeated
    rows count and are scored as often as they come; a null doc_id counts as the empty text's fold. Without training
    documents all counts are zero and the model is uniform over its shared units. No documents give no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = remainder(F.col("doc_id"), 7) == 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("held_out", held)
    counts = materialize(count_words(rows.filter("not held_out").select("text")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()  # at most HEAD rows
    head, head_n = (top.column(c).to_numpy() for c in ("word", "n"))
    side = recurrent.side_of(distinct)
    buckets = side * side
    masses = bucket_masses(counts, head, head_n, buckets, recurrent.LEAVES)
    read = materialize(as_units(rows, head, head_n, masses), "units")
    seen = read.filter("not held_out")
    model = train_model(seen, recurrent.initial(head_n[:buckets] + 1.0, masses), seen.count())
    kind, shared = unit_type(buckets + masses.size), spark.sparkContext.broadcast(recurrent.pack(model))  # grows with the square root of the vocabulary

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = recurrent.unpack(shared.value, side, recurrent.LEAVES)
        for batch in slices(batches, SCORED):
            found = recurrent.score(p, [np.frombuffer(x, kind) for x in batch.column(batch.num_columns - 1).to_pylist()]) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[*batch.schema.names[:-1], "class_sum"])

    plain = read.drop("tail")
    judged = plain.mapInArrow(judge, plain.drop("units").withColumn("class_sum", F.lit(0.0)).schema)
    # The rare words: none is frequent, so their join has no hot key.
    tail = read.select("row", F.explode("tail").alias("word")).join(counts, "word")
    tail = tail.groupBy("row").agg(F.count(F.lit(1)).alias("n_tail"), F.sum(F.log10(F.col("n") + 1.0)).alias("tail_sum"))
    out = judged.join(tail, "row", "left").fillna({"n_tail": 0, "tail_sum": 0.0})
    base = F.col("head_sum") + F.col("tail_sum") - F.col("n_tokens") * float(np.log10(total + distinct + 1.0))
    score = F.col("class_sum") + F.col("rare_sum") + F.col("tail_sum")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.col("n_tail")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def as_units(rows: DataFrame, head: np.ndarray, head_n: np.ndarray, masses: np.ndarray) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_head, head_sum, rare_sum, tail, units of (doc_id, text, held_out).

    n_head and head_sum: number and log10 counts of the head words; rare_sum: the counted shares of the words within
    their buckets, as far as head words go; tail: the hashes of the others; units: the model's, as one binary.
    """
    buckets, leaves = len(masses), masses.size // len(masses)
    kind = unit_type(buckets + masses.size)
    shared = rows.sparkSession.sparkContext.broadcast((head, np.log10(head_n + 1.0), np.log10(np.maximum(masses.ravel(), 1.0))))  # bounded by HEAD, and the units

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, logs, log_masses = shared.value
        logs = logs if len(logs) else np.zeros(1)
        order, of_rank = np.argsort(words, kind="stable"), units_of_ranks(words, buckets, leaves)
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            every, first = tokens(batch.column(3).cast(pa.binary()).to_pylist())
            sizes = np.diff(first)
            r = ranks_of(words, order, every, buckets, leaves)
            x = _units(r, of_rank, buckets)
            inside, other = r >= 0, x >= buckets
            head_logs = np.where(inside, logs[np.maximum(r, 0)], 0.0)
            shares = np.where(other, head_logs - log_masses[np.maximum(x - buckets, 0)], 0.0)
            by_text = lambda values: np.add.reduceat(values, first[:-1])  # noqa: B023, E731
            raw, width = x.astype(kind).tobytes(), np.dtype(kind).itemsize
            found = [raw[a * width : b * width] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            at = np.flatnonzero(~inside)
            tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), pa.array(every[at]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes), pa.array(by_text(inside.astype(np.int64))), pa.array(by_text(head_logs)), pa.array(by_text(shares)), tails, pa.array(found, pa.binary())], names=names)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, head_sum double, rare_sum double, tail array<long>, units binary"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(read, schema)
