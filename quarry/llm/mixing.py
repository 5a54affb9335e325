"""Mixing sources to target weights.

The words of each source are packed, in pseudorandom order of its documents, into blocks of fixed length. Output
shards draw how many slots each source gets in them; a slot maps through its source's pseudorandom permutation of
block indexes, which starts anew after every pass over the source; slots and blocks join by index. All draws, orders
and permutations hang on hashes of the rows' values, so neither files nor partitions change the mixture. DataFrame
functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, keyed, let, materialize, one_each, text_or_empty, unused_name

BLOCK_WORDS = 64
#: Slots of one output shard, on average.
SHARD_SLOTS = 4096
#: Documents whose positions one task adds up.
BUCKET_DOCS = 512
#: A target is at most so many times its source's size.
MAX_PASSES = 3
#: Rounds of the shuffle that permutes block indexes.
ROUNDS = 12
#: Slots that one task makes; a set number of partitions, as adaptive execution would put the few rows that they are
#: made from into one.
TASK_SLOTS = 65_536
MAX_TASKS = 50_000
#: Draws of at most so many slots are exact, of more by the normal approximation, and levels of draws that one task makes.
EXACT = 4096
FIRST_LEVELS = 8


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target from (sid, source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. A source is held at MAX_PASSES times its size when its
    share would be more; the excess goes to the others by weight. Sorted by the share at which each is held, the held
    sources come first, so running sums give the level at which the sharing settles. There is a row for each source.
    """
    by_source = sizes.groupBy("sid", "source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("weight", (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3)) + 1).cast("double"))
    limit = ranked.withColumn("limit", MAX_PASSES * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, weights = F.sum("source_size").over(whole), F.sum("weight").over(whole)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (weights - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = limit.withColumn("level", level).withColumn("free", F.col("limit") >= F.col("level") * F.col("weight"))
    settled = levels.withColumn("settled", F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(whole)["level"])
    target = F.least("limit", F.coalesce(F.col("settled") * F.col("weight"), F.col("limit")))
    return settled.select("sid", "source", "source_size", "weight", target.alias("target"))


def permuted(index: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 for each key, exact for any n: the swap-or-not shuffle.

    In each round an index and its mirror image about a keyed point trade places or not, as a hash of the larger one
    says. A round undoes itself, so the inverse runs the rounds backwards.
    """
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, mirror), F.lit("swap")).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)

    return F.aggregate(rounds, index, step)


def packed(sizes: DataFrame, n_docs: int) -> DataFrame:
    """sizes with ``start``: the words of the source's documents before this one, in pseudorandom order.

    Rows that are equal in all values share a place, and which of them comes first makes no difference. Sums run within buckets of about BUCKET_DOCS documents, then over runs of buckets, then over the runs, so a source
    with a third of all rows is spread over as many tasks as its rows need.
    """
    buckets = max(1, -(-n_docs // BUCKET_DOCS))
    rows = sizes.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size")).withColumn("run", F.floor(F.col("bucket") / BUCKET_DOCS))
    runs = sums.groupBy("sid", "run").agg(F.sum("bucket_size").alias("run_size"))
    runs = runs.withColumn("run_start", F.sum("run_size").over(Window.partitionBy("sid").orderBy("run")) - F.col("run_size")).drop("run_size")
    starts = sums.withColumn("in_run", F.sum("bucket_size").over(Window.partitionBy("sid", "run").orderBy("bucket")) - F.col("bucket_size"))
    starts = starts.join(runs, ["sid", "run"]).select("sid", "bucket", (F.col("in_run") + F.col("run_start")).alias("bucket_start"))
    inside = rows.withColumn("before", F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("place", "doc_id", "size", "row")) - F.col("size"))
    return inside.join(starts, ["sid", "bucket"]).select(*sizes.columns, (F.col("before") + F.col("bucket_start")).alias("start"))


def source_plan(targets: DataFrame, block_words: int) -> DataFrame:
    """For each source with a target: blocks, whole words to take, whole passes and words of the last pass."""
    take = F.least(F.round("target").cast("long"), MAX_PASSES * F.col("source_size"))
    plan = targets.withColumn("take", take).filter("take > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    plan = plan.withColumn("passes", F.floor(F.col("take") / F.col("source_size")).cast("long")).withColumn("rest", F.col("take") - F.col("passes") * F.col("source_size"))
    # The last block of a source is short; its place in the last pass tells how many words come before any other place.
    return plan.withColumn("short", F.col("blocks") * block_words - F.col("source_size")).withColumn("short_place", permuted(F.col("blocks") - 1, F.col("blocks"), F.xxhash64("sid", "passes"), inverse=True))


def half_of(n: Column, key: Column) -> Column:
    """A draw from the binomial distribution of n trials at one half, by hashes of ``key``.

    Up to EXACT trials are bits that are counted; beyond, the normal distribution is off by less than a thousandth of
    its deviation.
    """
    word = lambda i: F.xxhash64(key, i, F.lit("bits"))
    bits = lambda i: F.when((i + 1) * 64 <= n, word(i)).otherwise(F.call_function("shiftrightunsigned", word(i), (F.lit(64) - n % 64).cast("int")))
    counted = F.when(n > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / 64)), F.lit(0).cast("long"), lambda a, i: a + F.bit_count(bits(i)))).otherwise(0)
    uniform = lambda name: (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11) + F.lit(0.5)) / F.lit(2.0**53)
    normal = F.sqrt(-2 * F.log(uniform("radius"))) * F.cos(F.lit(6.283185307179586) * uniform("angle"))
    near = F.least(F.greatest(F.round(n / 2 + normal * F.sqrt(n.cast("double")) / 2).cast("long"), F.lit(0).cast("long")), n)
    return F.when(n <= EXACT, counted).otherwise(near).cast("long")


def draws(plan: DataFrame, block_words: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``plan`` with a row for each output shard and source that has slots there: shard, first, slots.

    The slots that a source's target fixes are drawn into shards as a multinomial sample: halving the shards again and
    again, a binomial draw tells how many slots go to the lower half. A source's slots are numbered through its
    shards, so a shard holds the numbers from first on. Halves without slots are not followed, so the rows of a level
    are no more than slots, nor than shards of each source.
    """
    last = F.when(F.col("rest") > 0, F.least("blocks", F.ceil((F.col("rest") + F.col("short")) / block_words).cast("long") + 1)).otherwise(0)
    rows = plan.withColumn("slots", F.col("passes") * F.col("blocks") + last)
    total = rows.agg(F.sum("slots")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(total, 1) / shard_slots)))
    tasks = int(min(MAX_TASKS, -(-total // TASK_SLOTS))) or 1
    rows = rows.withColumn("shard", F.lit(0).cast("long")).withColumn("first", F.lit(0).cast("long"))
    kept = [c for c in rows.columns if c not in ("shard", "first", "slots")]
    for level in range(levels):
        if level == FIRST_LEVELS:
            rows = rows.repartition(tasks, "sid", "shard")
        drawn = rows.withColumn("lower", half_of(F.col("slots"), F.xxhash64("sid", F.lit(level), "shard")))
        sides = F.array(
            F.struct((2 * F.col("shard")).alias("shard"), F.col("first"), F.col("lower").alias("slots")),
            F.struct((2 * F.col("shard") + 1).alias("shard"), (F.col("first") + F.col("lower")).alias("first"), (F.col("slots") - F.col("lower")).alias("slots")),
        )
        rows = drawn.select(*kept, F.explode(sides).alias("s")).select(*kept, "s.shard", "s.first", "s.slots").filter("slots > 0")
    return rows.repartition(tasks, "sid", "shard")


def slots(drawn: DataFrame, block_words: int) -> DataFrame:
    """The slots of the mixture: shard, sid, pass, block, words (the first words of the block that the slot takes).

    The slots of one pass go through one permutation of the source's blocks; the last pass ends within a block, when
    its words are used up.
    """
    number = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1))
    rows = drawn.withColumn("number", number).withColumn("pass", F.floor(F.col("number") / F.col("blocks"))).withColumn("place", F.col("number") % F.col("blocks"))
    rows = rows.withColumn("block", permuted(F.col("place"), F.col("blocks"), F.xxhash64("sid", "pass")))
    before = F.col("place") * block_words - F.when(F.col("short_place") < F.col("place"), F.col("short")).otherwise(F.lit(0))
    whole = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    rows = rows.withColumn("words", F.when(F.col("pass") == F.col("passes"), F.greatest(F.least(whole, F.col("rest") - before), F.lit(0).cast("long"))).otherwise(whole)).filter("words > 0")
    return rows.select("shard", "sid", "pass", "block", "words")


def shard_counts(slot_rows: DataFrame) -> DataFrame:
    """How many slots, and words, each output shard drew from each source."""
    return slot_rows.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("slots"), F.sum("words").alias("words"))


def sized(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """row, doc_id, source, sid (a hash of the source), place (a hash of the values, the order of packing), size and the
    columns ``carry``; written, so that rows keep their numbers."""
    source = F.col("source").cast("string")
    place = F.xxhash64(F.col("doc_id").cast("long"), source, F.xxhash64(text_or_empty()))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), place.alias("place"), word_count(text_or_empty()).alias("size"), *(carry or []))
    return materialize(found.withColumn("sid", F.xxhash64("source", F.col("source").isNull())), "sizes")


def pieces(docs_at: DataFrame, slot_rows: DataFrame, block_words: int) -> DataFrame:
    """shard, row, pass, first, last: the words (from first to before last, counted in the document) that a slot takes."""
    end = F.col("start") + F.col("size")
    parts = docs_at.filter("size > 0").select("row", "sid", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    at = F.col("block") * block_words
    joined = parts.join(slot_rows.select("shard", "sid", "block", "pass", "words"), ["sid", "block"])
    joined = joined.select("shard", "row", "pass", (F.greatest("start", at) - F.col("start")).alias("first"), (F.least("end", at + F.col("words")) - F.col("start")).alias("last"))
    return joined.filter("first < last")


def mix(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Targets of the sources, and pieces of the documents in the slots of the shards, from ``sized`` rows.

    A null text has no words and is never taken; a null source is a source of its own, weighed last. Repeated rows
    count as often as they come. An empty table, or one without a word, gives targets of zero and no pieces. Equal
    rows give equal mixtures, however they are dealt over files.
    """
    targets = materialize(source_targets(sizes), "targets")
    plan = materialize(source_plan(targets, block_words), "plan")
    taken = materialize(slots(draws(plan, block_words), block_words), "slots")
    return targets, pieces(packed(sizes, sizes.count()), taken, block_words)


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_pieces, first_shard of every row: what the mixture takes of it.

    ``taken`` counts repeats; n_pieces are the slots that hold some of it, first_shard the lowest shard of them (null
    without any). Nulls, repeats and empty tables as in ``mix``; other columns are ignored.
    """
    sizes = sized(docs)
    targets, parts = mix(sizes, block_words)
    taken = parts.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.count(F.lit(1)).alias("n_pieces"), F.min("shard").alias("first_shard"))
    out = sizes.join(taken, "row", "left").join(targets.select("sid", "source_size", "target"), "sid", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("n_pieces", zero).alias("n_pieces"), "first_shard")


def mix_shards(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixture by output shard: shard, doc_id, source, pass, first, last (words of the document, before last)."""
    sizes = sized(docs)
    return mix(sizes, block_words)[1].join(sizes.select("row", "doc_id", "source"), "row").select("shard", "doc_id", "source", "pass", "first", "last")


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixture as documents: a row for each document and pass that takes words of it, with the columns of ``docs``.

    The text is the original where a pass takes all its words, else the words taken, joined by single spaces; n_chars,
    where there is such a column, counts the code points of the new text. Rows are known by a hash of all their values;
    of rows that are equal in all columns each is mixed by itself. Texts without words are in no pass; null sources and
    ids as in ``mix``; columns of any name pass unchanged. An empty table gives no rows.
    """
    rows, keys = keyed(docs)
    sizes = sized(rows, keys)
    parts = mix(sizes, block_words)[1]
    ranges = parts.groupBy("row", "pass").agg(F.sum(F.col("last") - F.col("first")).alias("n"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    taken = ranges.join(sizes.select("row", "size", *keys), "row")
    # Equal rows take their words from any of them, so the passes of all join one; without such rows nothing is added.
    passes = taken.groupBy(*keys).agg(F.collect_list(F.struct((F.col("n") == F.col("size")).alias("whole"), "ranges")).alias(mine := unused_name("passes", docs.columns)))
    passes = materialize(passes, "passes")
    again = materialize(sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys), "again")
    joined = one_each(rows, keys, None, again).join(passes, keys)
    words = F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))
    cut = lambda p, w: F.array_join(F.flatten(F.transform(p["ranges"], lambda r: F.slice(w, (r["first"] + 1).cast("int"), (r["last"] - r["first"]).cast("int")))), " ")
    every = F.forall(mine, lambda p: p["whole"])
    texts = F.when(every, F.transform(mine, lambda p: F.col("text"))).otherwise(let(words, lambda w: F.transform(mine, lambda p: F.when(p["whole"], F.col("text")).otherwise(cut(p, w)))))
    out = joined.withColumn("text", F.explode(texts))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
