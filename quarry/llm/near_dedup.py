"""Near-duplicate detection with SetSketch registers.

1. A document's set holds its distinct word shingles, hashed to 64 bits. Documents with equal sets form a class, and
   only one member of each class goes on.
2. Each of ``REGISTERS`` registers keeps the smallest of the set's hashes under one hash function as the exponent of
   an exponential scale of base ``BASE``, truncated to a byte. Registers of a union are the maxima of the registers.
3. Bands of ``ROWS`` registers are the keys of buckets. A bucket offers the links from its members to one hub, picked
   by hash; what stays apart after that is compared within the buckets, in blocks, between different components only.
   A bucket of very many that are apart is split by every other band first, so its members meet where two bands agree;
   those that are still apart then meet by the rarest shingles of their full sets, which leaves no link out. So the
   links are the same whatever the size of a bucket.
4. The likelihood of a pair's registers gives an estimate of its similarity; clearly different pairs go.
5. The others are verified on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY_ROWS, bounded, discard, keyed, materialize, one_each, slices, small_batches, text_or_empty
from .components import connected_components
from .words import hashed_words, mix

REGISTERS = 80
ROWS = 4
BANDS = REGISTERS // ROWS
#: Base of the scale of the registers, and the rate that keeps registers of small sets above the lowest value. A
#: register is LEVELS - 1 at most; larger ones are truncated, which no set of under 10^15 shingles reaches.
BASE = 1.02
RATE = 20.0
LEVELS = 1 << 11
#: Standard errors by which an estimate may miss the threshold before its pair is left out unverified.
SLACK = 4.0
#: Members of a bucket that meet in one block; larger buckets are compared block by block.
BLOCK = 1024
#: In the place of a band: the bucket is of a shingle.
ANY = -1

_rng = np.random.default_rng(20_170_301)
_FACTORS = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64)
_M1 = np.uint64(0xBF58476D1CE4E5B9)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; with fewer words, of the whole sequence; without words, none."""
    found, offsets = hashed_words(texts)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        h, k = found[a:b], min(width, b - a)
        if not k:
            yield np.zeros(0, np.uint64)
            continue
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        yield np.unique(out)


def registers_of(items: np.ndarray) -> np.ndarray:
    """The SetSketch of a set that is not empty: floor(1 - log_BASE of the least exponential variate), truncated."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 4096):
        part = items[at : at + 4096, None] * _FACTORS + _OFFSETS
        part ^= part >> np.uint64(32)
        part *= _M1
        np.minimum(least, part.min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    spaced = np.floor(1.0 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE))
    return np.clip(spaced, 0, LEVELS - 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sketches (rows of ``a`` and ``b``) of sets of known sizes, by maximum likelihood.

    With sizes na and nb, u and v the shares of the union that only a or only b has, a register of a is larger,
    smaller or equal with probabilities p(u), p(v) and the rest, where p(x) = -log_BASE(1 - x (BASE - 1) / BASE). The
    likelihood has one parameter, the Jaccard similarity, and one maximum, which a ternary search finds.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    ratio = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    share = na / np.maximum(na + nb, 1)

    def value(j: np.ndarray) -> np.ndarray:
        u, v = np.clip(share * (1 + j) - j, 0, 1), np.clip((1 - share) * (1 + j) - j, 0, 1)
        pu, pv = (-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE) for x in (u, v))
        return more * np.log(pu + 1e-12) + less * np.log(pv + 1e-12) + same * np.log(np.maximum(1 - pu - pv, 1e-12))

    low, high = np.zeros(len(a)), ratio.astype(np.float64)
    for _ in range(16):
        third = (high - low) / 3
        up = value(low + third) < value(high - third)
        low, high = np.where(up, low + third, low), np.where(up, high, high - third)
    return (low + high) / 2


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that may reach the threshold: by their sizes, and by the estimate with SLACK standard errors to spare."""
    t = percent / 100
    near = np.minimum(na, nb) >= t * np.maximum(na, nb) - 1e-9
    # Cheap first: far fewer equal registers than the threshold implies.
    margin = SLACK * np.sqrt(t * (1 - t) / REGISTERS)
    near &= (a == b).sum(axis=1) >= REGISTERS * (t - margin)
    if near.any():
        near[near] = estimate(a[near], b[near], na[near], nb[near]) >= t - margin
    return near


KEYS = ["key1", "key2"]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key1, key2, n_shingles, digest of the set (null without words), registers (null without words)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, digests, found = [], [], []
            for items in shingle_sets(batch.column(3).cast(pa.binary()).to_pylist(), width):
                sizes.append(len(items))
                digests.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                found.append(registers_of(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(found, pa.binary())], names=["doc_id", *KEYS, "n_shingles", "digest", "registers"])

    rows = docs.select(F.col("doc_id").cast("long"), *KEYS, text_or_empty().alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, key1 long, key2 long, n_shingles long, digest binary, registers binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """A row for each class and band: id, band and the key of its bucket."""
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", i * width + 1, width)) for i in range(BANDS)])
    return classes.select("id", F.posexplode(keys).alias("band", "bucket"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def keep_likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the registers don't rule out."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.loc[likely(_stack(f["ra"]), _stack(f["rb"]), f["na"].to_numpy(), f["nb"].to_numpy(), percent), ["a", "b", "votes"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(keep, "a long, b long, votes long")


def class_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id and full set (sorted 64-bit hashes) of the wanted classes (id, key1, key2): one row's text for each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [s.tobytes() for s in shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "items"])

    rows = docs.select(*KEYS, text_or_empty().alias("text")).join(bounded(wanted, KEY_ROWS), KEYS).select("id", "text")
    return rows.mapInArrow(build, "id long, items binary").dropDuplicates(["id"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(x) == 0 or len(y) == 0:
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, other, ia, ib = (c.to_pylist() for c in batch.columns)
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(ia, ib, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, g in zip(ids, good, strict=True) if g], pa.int64()), pa.array([v for v, g in zip(other, good, strict=True) if g], pa.int64())], names=["a", "b"])

    side = lambda x: sets.select(F.col("id").alias(x), F.col("items").alias(f"i{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ia", "ib").mapInArrow(check, "a long, b long")


def mixed_buckets(members: DataFrame, least: int = 3) -> DataFrame:
    """bucket, size, guests, main: buckets whose members (bucket, band, id, component) are of several components; main has
    the most of them, guests are the others.

    Of buckets with the same members the one of the first band is kept. Those of less than ``least`` members are left
    out: a bucket of two was compared through its hub, but the parts of a bucket have no hubs.
    """
    by_part = members.groupBy("bucket", "component").agg(F.max("band").alias("band"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sign"))
    whole = by_part.groupBy("bucket").agg(F.max("band").alias("band"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size"), F.sum("sign").alias("sign"), F.max(F.struct("n", "component")).alias("m"))
    whole = whole.filter(f"parts > 1 and size >= {least}")
    return whole.groupBy("sign", "size").agg(F.min(F.struct("band", "bucket", "m.component", "m.n")).alias("m")).select("m.bucket", "size", (F.col("size") - F.col("m.n")).alias("guests"), F.col("m.component").alias("main"))


def is_hot() -> Column:
    """Whether a bucket has so many guests that its members don't all meet in its blocks.

    Guests are in every block of their bucket, so a bucket costs guests times blocks; its parts cost each member once
    for every other band. The parts are less where there are more than BANDS blocks of guests: a bucket of texts that
    share a passage and are all apart, which rarely agree on two bands.
    """
    return F.col("guests") > BANDS * BLOCK


def split_hot(members: DataFrame) -> DataFrame:
    """``members`` with the hot buckets replaced by what is mixed of their parts, by one more band.

    Band j within a bucket of band i is BANDS * (1 + i) + j. Pairs that agree on one band of all alone don't meet here;
    ``by_shingles`` has them.
    """
    hot = members.filter(is_hot())
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64("bucket", F.lit(j), F.substring("registers", j * width + 1, width)) for j in range(BANDS)])
    parts = hot.select("id", "component", "n_shingles", "registers", F.col("band").alias("of"), F.posexplode(keys).alias("j", "bucket")).filter("j != of")
    parts = parts.withColumn("band", ((F.col("of") + 1) * BANDS + F.col("j")).cast("int")).drop("of", "j")
    split = parts.join(mixed_buckets(parts, 2), "bucket").select(*members.columns)
    return members.filter(~is_hot()).unionByName(split)


def by_shingles(rows: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """The rows (id, component, n_shingles, registers) as members of buckets of band ANY, each of one shingle; written,
    the table of common shingles after it.

    Sets of n and more shingles that reach the threshold share one of the first n - ceil(n * percent / 100) + 1, in any
    order that both follow. Shingles of more than a block of the sets come last, so what many texts share makes a bucket
    only where a text has little else.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], names=["id", "bucket"])

    each = rows.select("id").join(sets, "id").select("id", "items").mapInArrow(spread, "id long, bucket long")
    common = materialize(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK), "common")
    ordered = each.join(bounded(common, KEY_ROWS), "bucket", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "bucket"))).alias("order"))
    need = F.ceil(F.size("order") * percent / F.lit(100)).cast("int")
    first = ordered.select("id", F.explode(F.slice("order", F.lit(1), F.size("order") - need + 1)).alias("at")).select("id", "at.bucket")
    return [materialize(first.join(rows, "id").withColumn("band", F.lit(ANY)), "apart"), common]


def met_first(agree: np.ndarray, band: int) -> np.ndarray:
    """Which pairs (rows of equal registers) count in a bucket of this band: it is the first that agrees, or the first two;
    of band ANY, those that agree on any."""
    bands = agree.reshape(-1, BANDS, ROWS).all(axis=2)
    if band == ANY:
        return bands.any(axis=1)
    outer, inner = (band, None) if band < BANDS else (band // BANDS - 1, band % BANDS)
    here = bands.argmax(axis=1) == outer
    if inner is not None:
        bands[:, outer] = False
        here &= bands.argmax(axis=1) == inner
    return here


MEMBER = "bucket long, band int, block int, guest boolean, id long, component long, n_shingles long"


def seated(members: DataFrame) -> DataFrame:
    """Members of mixed buckets dealt into blocks of about BLOCK: each is in one block of its bucket, and those outside
    the main component are guests in all of the bucket's blocks."""
    rows = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    here = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("guest", F.lit(False))
    guests = rows.filter("component != main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("guest", F.lit(True))
    columns = ["bucket", "band", "block", "guest", "id", "component", "n_shingles", "registers"]
    return here.select(columns).unionByName(guests.select(columns))


def candidates(f: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in a block of guests and members of other components that may link, and their equal registers.

    A pair that meets in several buckets counts in that of the first band on which its registers agree.
    """
    guest, label, sizes = (f[c].to_numpy() for c in ("guest", "component", "n_shingles"))
    regs, band = _stack(f["registers"]), int(f["band"].iloc[0])
    t = percent / 100
    need = REGISTERS * (t - SLACK * np.sqrt(t * (1 - t) / REGISTERS))
    left, right, found = np.flatnonzero(guest), np.flatnonzero(~guest), []
    for at in range(0, len(left), 16):
        part = left[at : at + 16]
        equal = regs[part][:, None, :] == regs[right][None, :, :]
        i, j = np.nonzero((equal.sum(axis=2) >= need) & (label[part][:, None] != label[right][None, :]))
        agree = equal[i, j]
        first = met_first(agree, band)
        found.append((part[i[first]], right[j[first]], agree[first].sum(axis=1)))
    x, y, same = (np.concatenate([p[k] for p in found]) if found else np.zeros(0, np.int64) for k in range(3))
    if len(x):
        good = np.concatenate([likely(regs[x[k : k + 8192]], regs[y[k : k + 8192]], sizes[x[k : k + 8192]], sizes[y[k : k + 8192]], percent) for k in range(0, len(x), 8192)])
        x, y, same = x[good], y[good], same[good]
    return x, y, same


def with_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, sets: DataFrame, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """``sets`` with those of the wanted ids that it lacks, and the tables written for them."""
    missing = wanted.select("id").distinct().join(sets.select("id"), "id", "left_anti").join(classes.select("id", *KEYS), "id")
    written = [materialize(missing, "missing")]
    if written[0].limit(1).count():
        written.append(materialize(class_sets(docs, written[0], width), "sets"))
        sets = sets.unionByName(written[-1])
    return sets, written


def crossing_links(members: DataFrame, classes: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) between different components of a bucket, and the tables it has written for them.

    ``members``: bucket, band, size, main, id, n_shingles, registers, component. First the registers tell which members
    have a likely pair at all; only their sets are fetched, and pairs are verified where they meet, the likeliest
    first, until the guest and the component are linked. So no pair is written that is no link.
    """

    def involved(f: pd.DataFrame) -> pd.DataFrame:
        x, y, _ = candidates(f, percent)
        return f.iloc[np.unique(np.concatenate([x, y]))]

    def linked(f: pd.DataFrame) -> pd.DataFrame:
        x, y, same = candidates(f, percent)
        items, ids, label = [np.frombuffer(v, np.uint64) for v in f["items"]], f["id"].to_numpy(), f["component"].to_numpy()
        done, out = set(), []
        for k in np.lexsort((ids[y], -same, x)):
            if (x[k], label[y[k]]) not in done and similar(items[x[k]], items[y[k]], percent):
                done.add((x[k], label[y[k]]))
                out.append((max(ids[x[k]], ids[y[k]]), min(ids[x[k]], ids[y[k]])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    near = materialize(seated(members).groupBy("bucket", "block").applyInPandas(involved, f"{MEMBER}, registers binary"), "involved")
    sets, written = with_sets(near, classes, docs, sets, width)
    rows = near.join(sets, "id").select(*near.columns, "items")
    return rows.groupBy("bucket", "block").applyInPandas(linked, "a long, b long").distinct(), [near, *written]


def near_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, key1, key2, row, n_shingles, part of every row of ``docs`` (``keyed``); written.

    Texts link when 100 * |intersection| >= percent * |union| of their shingle sets. ``part`` is the least row number
    that links reach; the numbers are of this table, given once. A row without words is a part of its own.
    """
    small_batches(docs.sparkSession)
    found = materialize(sketches(docs, width).withColumn("row", F.monotonically_increasing_id()), "sketches")
    first = F.min(F.struct(F.col("row").alias("id"), *KEYS)).alias("m")
    classes = found.filter("digest is not null").groupBy("digest").agg(first, F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers"))
    classes = materialize(classes.select("digest", "m.*", "n_shingles", "registers"), "classes")
    bands = band_rows(classes)
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("bucket", "id").alias("h"), F.col("id").alias("hub"))).alias("m")).filter("size > 1")
    buckets = materialize(buckets.select("bucket", "size", F.col("m.hub").alias("hub")), "buckets")
    pairs = bands.join(buckets, "bucket").filter("id != hub").groupBy(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).agg(F.count(F.lit(1)).alias("votes"))
    pairs = materialize(pairs, "pairs")
    offered = materialize(keep_likely(pairs, classes, percent), "offered")
    discard(pairs)
    # First the link of each document that most bands offer: most components are complete after it.
    first = offered.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    first = materialize(first, "first")
    ids = offered.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes.select("id", *KEYS), "id")
    ids = materialize(ids, "ids")
    sets = materialize(class_sets(docs, ids, width), "sets")
    links = materialize(verify(first, sets, percent), "links")
    parts = materialize(connected_components(links), "parts")
    named = lambda frame, key, as_: frame.join(parts.select(F.col("id").alias(key), F.col("component").alias(as_)), key, "left").withColumn(as_, F.coalesce(as_, key))
    # Then what other hubs offer to join, and last members of one bucket that are still apart.
    rest = named(named(offered, "a", "ca"), "b", "cb").filter("ca != cb").join(first, ["a", "b"], "left_anti")
    rest = materialize(rest.select("a", "b"), "rest")
    parts = _joined(parts, verify(rest, sets, percent))
    members = materialize(named(bands.join(buckets.select("bucket"), "bucket"), "id", "component"), "members")
    mixed = materialize(mixed_buckets(members), "mixed")
    inside = members.join(mixed, "bucket").join(classes.select("id", "n_shingles", "registers"), "id")
    crossing, more = crossing_links(split_hot(inside), classes, docs, sets, width, percent)
    parts = _joined(parts, crossing)
    # What members of hot buckets were not compared for.
    if mixed.filter(is_hot()).limit(1).count():
        hot = inside.filter(is_hot()).select("id", "n_shingles", "registers").dropDuplicates(["id"])
        hot = materialize(named(hot, "id", "component"), "hot")
        every, written = with_sets(hot, classes, docs, sets, width)
        apart, common = by_shingles(hot, every, percent)
        shared = materialize(mixed_buckets(apart, 2), "shared")
        crossing, again = crossing_links(apart.join(shared, "bucket"), classes, docs, every, width, percent)
        parts = _joined(parts, crossing)
        more += [hot, apart, common, shared, *written, *again]
    of_class = classes.select("digest", "id").join(parts, "id", "left").select("digest", F.coalesce("component", "id").alias("part"))
    of_class = materialize(of_class, "verdicts")
    discard(buckets, offered, first, links, ids, sets, rest, members, mixed, classes, parts, *more)
    out = found.drop("registers").join(of_class, "digest", "left").withColumn("part", F.coalesce("part", "row")).drop("digest")
    out = materialize(out, "rows")
    discard(found, of_class)
    return out


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The verdict on every row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts link as in ``near_rows``; component_id is the smallest doc_id that links reach, and kept marks it. A null,
    empty or blank text has no shingles, links with nothing and is its own component. Rows with one doc_id are one
    document, so they join their components; a null doc_id links with nothing, has a null component and stays. An empty
    table gives no rows; other columns are ignored.
    """
    rows, keys = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = near_rows(rows.withColumnsRenamed(dict(zip(keys, KEYS, strict=True))).filter("doc_id is not null"), width, percent)
    # Texts of one doc_id: their parts are one.
    shared = found.groupBy("doc_id").agg(F.min("part").alias("b"), F.max("part").alias("last")).filter("b != last")
    ties = materialize(found.join(shared, "doc_id").filter("part != b").select(F.col("part").alias("a"), "b").distinct(), "ties")
    if ties.limit(1).count():
        joined = materialize(connected_components(ties), "parts").withColumnRenamed("id", "part")
        found = found.join(joined, "part", "left").withColumn("part", F.coalesce("component", "part"))
    least = materialize(found.groupBy("part").agg(F.min("doc_id").alias("component_id")), "least")
    out = found.join(least, "part").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    nulls = sketches(rows.withColumnsRenamed(dict(zip(keys, KEYS, strict=True))).filter("doc_id is null"), width)
    return out.unionByName(nulls.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def _joined(parts: DataFrame, found: DataFrame) -> DataFrame:
    """Components (id, component) after the links ``found``, of which only those between components go through the rounds."""
    of = lambda c, as_: parts.select(F.col("id").alias(c), F.col("component").alias(as_))
    ends = found.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    ends = ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).filter("a != b").distinct()
    ends = materialize(ends, "links")
    if not ends.limit(1).count():
        discard(ends)
        return parts
    joined = materialize(connected_components(ends), "parts")
    grown = parts.join(joined.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    grown = materialize(grown.unionByName(joined.join(parts.select("id"), "id", "left_anti")), "parts")
    discard(ends, joined, parts)
    return grown


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component; all columns stay.

    Components are of rows, whatever their ids. The row with the smallest doc_id stays (null last); of several with
    one doc_id the one with the smallest key, a hash of all its values, and of rows that are equal in all columns one.
    Rows without words all stay, but for such repeats; an empty table gives no rows; columns of any name pass unchanged.
    """
    rows, keys = keyed(docs)
    plain = rows.select("doc_id", "text", *[F.col(k).alias(n) for k, n in zip(keys, KEYS, strict=True)])
    found = near_rows(plain, width, percent)
    best = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), *KEYS)
    kept = materialize(found.groupBy("part").agg(F.min_by(F.struct(*KEYS), best).alias("m")).select("m.*").distinct(), "kept")
    counted = materialize(found.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), "keys")
    named = dict(zip(KEYS, keys, strict=True))
    dropped = materialize(counted.join(kept, KEYS, "left_anti").select(*KEYS).withColumnsRenamed(named), "near-copies")
    again = materialize(counted.filter("n > 1").join(kept, KEYS, "left_semi").select(*KEYS).withColumnsRenamed(named), "again")
    discard(found, kept, counted)
    return one_each(rows, keys, dropped, again).select(*docs.columns)
