"""Document fingerprints: a Merkle tree over paragraphs and sections. DataFrame functions only.

Paragraphs end at a line end, sections where blank lines end. A leaf is the SHA-256 of a paragraph, a section that of
its leaves' digests, the root that of its sections' digests. Every character belongs to one paragraph, so roots are
equal exactly for equal texts, and differing branches locate edits.

A fingerprint is the written tree, ``root/sections/stretches``: the root's digest; the sections, parted by bars, each
with its digest and, after semicolons, those of its leaves; and for every leaf, parted by semicolons, short hashes of
its stretches of STRETCH code points, which tell how much of an edited paragraph is left. All comparisons are of
fingerprints alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

STRETCH = 48
#: Hexadecimal digits of the digests of branches below the root, and of the hashes of stretches.
BRANCH, SHORT = 16, 8
#: Documents of one block, which one task sorts, and the most blocks; beyond them blocks grow.
BLOCK_DOCS = 256
MAX_BLOCKS = 10_000
#: Borders of blocks that are looked at first.
_STRIDE = 100

_SECTION = r"(?<=\n\n)(?!\n)"
_PARAGRAPH = r"(?<=\n)(?!$)"


def _leaves(section: Column) -> Column:
    return F.transform(F.split(section, _PARAGRAPH, -1), lambda p: F.struct(F.sha2(p, 256).alias("digest"), _stretches(p).alias("stretches")))


def _stretches(paragraph: Column) -> Column:
    parts = F.regexp_extract_all(paragraph, F.lit(r"[^\n]{1,%d}" % STRETCH), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(F.lit((1 << 32) - 1)))), SHORT, "0")), "")


def tree(text: Column) -> Column:
    """The tree of a text: array of (digest, leaves: array of (digest, stretches))."""
    branch = lambda leaves: F.struct(F.sha2(F.array_join(F.transform(leaves, lambda x: x["digest"]), ""), 256).alias("digest"), leaves.alias("leaves"))
    return F.transform(F.transform(F.split(text, _SECTION, -1), _leaves), branch)


def fingerprint(text: Column) -> Column:
    """The written tree of a text."""

    def write(sections: Column) -> Column:
        root = F.sha2(F.array_join(F.transform(sections, lambda s: s["digest"]), ""), 256)
        branch = lambda s: F.concat_ws(";", F.substring(s["digest"], 1, BRANCH), F.transform(s["leaves"], lambda x: F.substring(x["digest"], 1, BRANCH)))
        stretches = F.flatten(F.transform(sections, lambda s: F.transform(s["leaves"], lambda x: x["stretches"])))
        return F.concat_ws("/", root, F.array_join(F.transform(sections, branch), "|"), F.array_join(stretches, ";"))

    return F.transform(F.array(tree(text)), write)[0]


def root(print_: Column) -> Column:
    return F.substring_index(print_, "/", 1)


def branches(print_: Column) -> Column:
    """The sections of a fingerprint: array of (section, paragraphs: array of the leaves' digests)."""
    sections = F.split(F.split(print_, "/")[1], r"\|", -1)
    parts = F.transform(sections, lambda s: F.split(s, ";", -1))
    return F.transform(parts, lambda p: F.struct(p[0].alias("section"), F.slice(p, F.lit(2), F.size(p)).alias("paragraphs")))


def likeness(a: Column, b: Column) -> Column:
    """Share of the stretches of two fingerprints that both have (Dice); equal roots are alike, others without any not."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.split(c, "/")[2], F.lit("[0-9a-f]{%d}" % SHORT), F.lit(0)))

    def share(pair: Column) -> Column:
        total = F.size(pair["a"]) + F.size(pair["b"])
        return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(pair["a"], pair["b"])) / total)

    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(F.transform(F.array(F.struct(found(a).alias("a"), found(b).alias("b"))), share)[0])


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Where two fingerprints' branches differ: (section, paragraph) numbers of leaves of ``a`` that ``b`` has not at that place.

    Sections with equal digests are not descended into. A section or leaf beyond the end of ``b`` differs.
    """

    def leaves(s: Column, i: Column) -> Column:
        other = F.try_element_at(b, (i + 1).cast("int"))
        same = F.coalesce(s["section"] == other["section"], F.lit(False))
        found = F.filter(
            F.transform(s["paragraphs"], lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), (~F.coalesce(p == F.try_element_at(other["paragraphs"], (j + 1).cast("int")), F.lit(False))).alias("differs"))),
            lambda x: x["differs"],
        )
        return F.when(~same, found).otherwise(F.slice(found, 1, 0))

    return F.flatten(F.transform(a, leaves))


def blocks_of(docs: DataFrame) -> Column:
    """The number of a row's block, from doc_id and ``h``, a hash of its text; larger ids have larger numbers.

    Blocks of documents with ids lie between quantiles of the ids, so they are of like size however the ids are
    spread. Null ids come last, in blocks of negative numbers by h. The quantiles are at most MAX_BLOCKS numbers.
    """
    n, nulls = docs.agg(F.count("doc_id"), F.sum(F.col("doc_id").isNull().cast("long"))).first()
    wanted = min(MAX_BLOCKS, n // BLOCK_DOCS)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)], 10 * MAX_BLOCKS)).first()[0] if wanted > 1 else []
    cuts = sorted(set(cuts)) or [0]
    array = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda c: c <= F.col("doc_id")))
    stride = F.greatest(below(array(cuts[::_STRIDE])) - 1, F.lit(0)) * _STRIDE
    some = F.transform(F.array(stride), lambda at: at + below(F.slice(array(cuts), at + 1, F.lit(_STRIDE))))[0]
    parts = min(MAX_BLOCKS, 1 + (nulls or 0) // BLOCK_DOCS)
    none = -1 - F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * parts), F.lit(parts - 1))
    return F.when(F.col("doc_id").isNull(), none).otherwise(some).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text, h, print) with those of the next, in descending order of doc_id, as next_*.

    A window within a block finds the next document. The last of a block takes the first of the nearest lower block
    that has documents, the last of all the first of all; those few, one for each block, are joined.
    """
    block = blocks_of(docs.select("doc_id"))
    rows = docs.withColumn("block", block)
    order = Window.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), "h")
    after = lambda c: F.lead(c).over(order).alias(f"next_{c}")
    rows = rows.select("block", "doc_id", "text", "print", F.row_number().over(order).alias("place"), F.lead(F.lit(1)).over(order).alias("inner"), after("text"), after("print"))
    heads = rows.filter("place = 1").select(F.col("block").alias("lower"), F.col("text").alias("head_text"), F.col("print").alias("head_print"))
    lower = lower_blocks(docs.select(block.alias("block")).distinct())
    # One head for each block; the documents are where their block is already, so only the heads move.
    heads = lower.join(heads, "lower").select(F.col("block").alias("of"), "head_text", "head_print")
    joined = rows.join(heads, (F.col("block") == F.col("of")) & F.col("inner").isNull(), "left")
    following = lambda c: F.when(F.col("inner").isNull(), F.col(f"head_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}")
    return joined.select("doc_id", "text", "print", following("text"), following("print"))


def lower_blocks(blocks: DataFrame) -> DataFrame:
    """(block, lower): the next lower number in the table; the lowest one's is the highest. At most 2 * MAX_BLOCKS rows."""
    every = Window.orderBy(F.col("block").desc())
    highest = F.max("block").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return blocks.select("block", F.coalesce(F.lead("block").over(every), highest).alias("lower"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, how alike they are, and how many paragraphs the edit changes.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many, or all, of the next
    document in descending order of doc_id; after the last comes the first, so a single document is its own next. A
    null text counts as empty; null ids come last, repeated ids in the order of a hash of their texts (all rows of one
    id that is not null are in one block). No documents give no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    rows = with_next(rows.withColumn("print", fingerprint(F.col("text"))))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "print", "next_print", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "print", fingerprint(F.col("edited")).alias("edited_print"), "next_print")
    changed = F.size(differing_paragraphs(branches(F.col("print")), branches(F.col("edited_print")))).cast("long")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"), changed.alias("n_changed"),
    )
