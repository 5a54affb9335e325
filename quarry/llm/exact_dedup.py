"""Exact deduplication by two passes of Bloom filtering.

The first pass digests every text and marks, in bit maps of bounded size, the digests that may occur twice. In the
second pass only rows with a marked digest shuffle; the others are unique for certain and pass straight through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import MAX_BITS, flag_repeated, parts_of, repeated_map
from .common import SPACE_BYTES, discard, keyed, materialize, one_each, slices, small_batches, text_or_empty


def text_digests(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_chars (code points of the original text), digest (SHA-256 of the text without white space), and the
    columns ``carry`` of ``docs``."""
    carry = carry or []

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1)
            found = [hashlib.sha256(t.translate(None, SPACE_BYTES)).digest() for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.utf8_length(texts).cast(pa.int64()), pa.array(found, pa.binary()), *batch.columns[2:]], names=["doc_id", "n_chars", "digest", *carry])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), *carry)
    return rows.mapInArrow(digest, "doc_id long, n_chars long, digest binary" + "".join(f", {c} long" for c in carry))


def flagged_digests(docs: DataFrame, max_bits: int = MAX_BITS, carry: list[str] | None = None) -> DataFrame:
    """``text_digests`` with ``maybe_repeated``.

    The digests are written in as many parts as maps are needed, by their last bytes, so each part is read by its own
    two passes only.
    """
    small_batches(docs.sparkSession)
    keys = materialize(text_digests(docs, carry), "digests")
    n = keys.count()
    parts = parts_of(n, max_bits)
    if parts == 1:
        return flag_repeated(docs.sparkSession, keys, "digest", repeated_map(keys, "digest", n, max_bits))
    whole = keys
    # The last bytes, as the first ones are the slots.
    part = F.pmod(F.conv(F.hex(F.substring("digest", 29, 4)), 16, 10).cast("long"), F.lit(parts)).cast("int")
    keys = materialize(whole.withColumn("part", part), "digests", "part")
    discard(whole)
    flagged = []
    for part in range(parts):
        mine = keys.filter(F.col("part") == part).drop("part")
        flagged.append(flag_repeated(docs.sparkSession, mine, "digest", repeated_map(mine, "digest", -(-n // parts), max_bits)))
    return reduce(DataFrame.unionByName, flagged)


def exact_groups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The verdict on every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``. Of equal texts the row
    with the most code points stays, then the smallest doc_id. A null text counts as empty, so null, empty and blank
    texts form one group. A null doc_id comes after every other one. Rows that share doc_id and text are one
    another's copies: each is counted in group_size and reported, and they share one verdict. No rows in, no rows out;
    other columns are ignored.
    """
    flagged = flagged_digests(docs, max_bits)
    alone = flagged.filter(~F.col("maybe_repeated")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    rows = flagged.filter("maybe_repeated")
    best = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)))
    # Written first, so that the join below is between two plain exchanges, whose hot keys Spark can split.
    groups = materialize(rows.groupBy("digest").agg(F.min_by("doc_id", best).alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    repeated = rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    return alone.unionByName(repeated).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay.

    The row is the one that ``exact_groups`` keeps; of several with its doc_id and length (or with null doc_ids) the one
    with the smallest key, a hash of all its values. Rows are dropped by key, never by doc_id; of rows that are equal
    in all columns one stays. Null, empty and blank texts are one group; an empty table gives no rows; columns of any
    name pass unchanged.
    """
    rows, keys = keyed(docs)
    repeated = materialize(flagged_digests(rows, carry=keys).filter("maybe_repeated"), "repeated")
    best = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), *keys)
    kept = materialize(repeated.groupBy("digest").agg(F.min_by(F.struct(*keys), best).alias("m")).select("m.*"), "kept")
    counted = materialize(repeated.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "keys")
    dropped = materialize(counted.join(kept, keys, "left_anti").select(*keys), "copies")
    again = materialize(counted.filter("n > 1").join(kept, keys, "left_semi").select(*keys), "again")
    discard(repeated, kept, counted)
    return one_each(rows, keys, dropped, again).select(*docs.columns)
