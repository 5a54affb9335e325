"""Maintenance of a glossary: columns id, target, target_kind, terms, note, author, updated_at; one row for each target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.terms import QUESTION_WORDS, query_stems, roots_of
from quarry.functions.text import query_tokens, tokens
from quarry.operators.snapshots import object_of

#: Letters that the shorter of two different keys of a word must have to be the start of the longer.
SHARED = 4

COLUMNS = ["id", "target", "target_kind", "terms", "note", "author", "updated_at"]


def distinct_terms(terms: Column) -> Column:
    """Trimmed terms in order, without blanks and without repeats in any case."""
    trimmed = F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != "")
    empty = F.array().cast("array<string>")
    return F.aggregate(trimmed, empty, lambda seen, t: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(t)), seen).otherwise(F.concat(seen, F.array(t))))


def save(glossary: DataFrame, changes: DataFrame, merge: bool = True) -> DataFrame:
    """The glossary after ``changes`` (all columns but id), whose targets match in any case.

    With ``merge`` terms are added to the former ones and an empty note keeps the former note; otherwise both are
    replaced. Of several changes to one target the latest counts. A new target gets an id made of its name.
    """
    latest = changes.groupBy(F.lower("target").alias("key")).agg(F.max_by(F.struct(*COLUMNS[1:]), F.struct("updated_at", "target")).alias("new"))
    rows = glossary.select(F.lower("target").alias("key"), F.struct(*COLUMNS).alias("old")).join(latest, "key", "full_outer")
    old, new = (lambda c: F.col(f"old.{c}")), (lambda c: F.col(f"new.{c}"))
    none = F.array().cast("array<string>")
    given = F.coalesce(new("terms"), none)
    terms = F.concat(F.coalesce(old("terms"), none), given) if merge else given
    note = F.when(F.coalesce(new("note"), F.lit("")) == "", old("note")).otherwise(new("note")) if merge else new("note")
    values = {"id": F.coalesce(old("id"), F.substring(F.md5("key"), 1, 8)), "terms": distinct_terms(terms), "note": F.coalesce(note, F.lit(""))}
    changed = F.col("new").isNotNull()
    return rows.select(*[F.when(changed, values.get(c, new(c) if c != "id" else None)).otherwise(old(c)).alias(c) for c in COLUMNS])


def remove(glossary: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """The glossary without the given ids, a list or a table with the column id."""
    gone = ids if isinstance(ids, DataFrame) else glossary.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return glossary.join(gone.select("id"), "id", "left_anti").select(*glossary.columns)


def word_keys(query: str) -> list[str]:
    """What the words of a query are known by: themselves, their stems and their roots."""
    words = [w for w in query_tokens(query) if len(w) > 1]
    words = [w for w in words if len(w) > 2 and w not in QUESTION_WORDS] or words
    return sorted({k for w in words for k in (w, *query_stems(w), *roots_of(w))})


def matches(glossary: DataFrame, query: str, kinds: list[str] | None = None) -> DataFrame:
    """id, target, target_kind, term, score: entries with a term whose every word is one of the query's, the best first.

    Two words are the same if a key of one starts with a key of the other and the shorter has SHARED letters, or if they
    are equal. The score is the number of words; an entry's term is its longest. The keys of the query are a literal
    array, so that a glossary of any size is read once, without a join.
    """
    keys = word_keys(query)
    rows = glossary.filter(F.col("target_kind").isin(kinds)) if kinds else glossary
    asked = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")
    # Stems of a term's word that a query can meet are its own starts, of SHARED letters at least.
    starts = lambda a, b: F.startswith(a, b) & ((F.length(b) >= SHARED) | (a == b))
    stem = lambda w: F.when(w.rlike("^[а-яё]+$") & (F.length(w) > SHARED), F.substring(w, F.lit(1), F.greatest(F.lit(SHARED), F.length(w) - 2))).otherwise(w)
    same = lambda w: F.exists(asked, lambda k: starts(w, k) | starts(k, w) | starts(k, stem(w)))
    words = F.filter(tokens(F.col("term")), lambda w: F.length(w) > 1)
    useful = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(F.array(*[F.lit(x) for x in sorted(QUESTION_WORDS)]), w))
    terms = rows.select("id", "target", "target_kind", F.explode("terms").alias("term"))
    terms = terms.withColumn("words", F.when(F.size(useful) > 0, useful).otherwise(words))
    found = terms.filter((F.size("words") > 0) & F.forall("words", same)).withColumn("score", F.size("words"))
    best = found.groupBy("id", "target", "target_kind").agg(F.max_by("term", F.struct("score", F.col("term"))).alias("term"), F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "target")


def resolve_targets(targets: DataFrame, objects: DataFrame, procedures: DataFrame, attributes: DataFrame) -> DataFrame:
    """target, full_name, target_kind: what each target is called in the index: object, else procedure, else attribute.

    A procedure's module may be a common module's short name. An attribute is the longest object's name that the target
    starts with and the rest, so that a dotted attribute of a section is found. Each try is an equi-join on one
    spelling; a target without any is left out.
    """
    rows = targets.select("target").distinct().withColumn("key", F.lower(F.regexp_replace(F.trim("target"), r"^\.+|\.+$", ""))).filter("key != ''")
    as_object = rows.join(objects.select(F.lower("object").alias("key"), F.col("object").alias("full_name")).distinct(), "key").select("target", F.lit(0).alias("tier"), "full_name", F.lit("object").alias("target_kind"))
    module = F.lower("module")
    spelt = F.array(module, F.regexp_replace(module, r"^общиймодуль\.(.*)\.модуль$", "$1"))
    procs = procedures.select(F.explode(F.array_distinct(spelt)).alias("m"), F.lower("procedure").alias("p"), F.concat_ws(".", "module", "procedure").alias("full_name"))
    as_proc = rows.join(procs.select(F.concat_ws(".", "m", "p").alias("key"), "full_name"), "key").select("target", F.lit(1).alias("tier"), "full_name", F.lit("procedure").alias("target_kind"))
    attrs = attributes.select(F.lower(F.concat_ws(".", "object", "attribute")).alias("key"), F.concat_ws(".", "object", "attribute").alias("full_name"))
    as_attr = rows.join(attrs, "key").select("target", F.lit(2).alias("tier"), "full_name", F.lit("attribute").alias("target_kind"))
    every = as_object.unionByName(as_proc).unionByName(as_attr)
    return every.groupBy("target").agg(F.min(F.struct("tier", "full_name", "target_kind")).alias("m")).select("target", "m.full_name", "m.target_kind")


def entries_of(glossary: DataFrame, objects: DataFrame) -> DataFrame:
    """object, entries: what the glossary says of each object and of its attributes, by target."""
    rows = glossary.withColumn("key", F.lower(object_of(F.col("target"))))
    grouped = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("target", "terms", "note"))).alias("entries"))
    return objects.select("object").distinct().withColumn("key", F.lower("object")).join(grouped, "key").select("object", "entries")
