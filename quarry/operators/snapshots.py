"""What a configuration changed against its base, and where that meets the changes of a new release.

Snapshots are dictionaries of tables. ``objects``: object, kind, synonym. ``attributes``: object, attribute, type_desc.
``forms``: object, form. ``modules``: module, file_hash. ``procedures``: module, procedure, signature, content_hash.
Changes are rows (object, module, part, name, change, was, now, n): part is object, attribute, form, synonym, module or
procedure; change is added, removed or changed; n is what a row counts for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Snapshot = dict[str, DataFrame]

#: Kinds of conflicts in the order of their weight, and what they ask for.
CONFLICTS = {
    "both_changed": "merge both changes",
    "removed_in_release": "move the change elsewhere or drop it",
    "intercepted_removed": "the interceptor no longer applies",
    "intercepted_changed": "compare the interceptor with the new text",
    "name_clash": "rename or join the additions",
    "removed_by_you": "decide whether it stays removed",
    "object_both": "compare the object",
    "module_both": "compare the module",
}
#: Directives that put a procedure wholly in the place of another: fixed values of the language.
REPLACING = ("вместо", "around", "изменениеиконтроль", "changeandvalidate")

COLUMNS = ("object", "module", "part", "name", "change", "was", "now", "n")


def object_of(module: Column) -> Column:
    """The object of a module's dotted name: its first two words; the module itself where it has only one."""
    return F.when(module.contains("."), F.substring_index(module, ".", 2)).otherwise(module)


def _rows(frame: DataFrame, part: str, change: Column | str, **values: Column) -> DataFrame:
    given = {"part": F.lit(part), "change": F.lit(change) if isinstance(change, str) else change, "n": F.lit(1).cast("long")} | values
    return frame.select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in COLUMNS])


def _compare(old: DataFrame, new: DataFrame, keys: list[str], differs: Column) -> DataFrame:
    """keys, every other column as was_* and now_*, and change; equal rows go."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(F.lit(1).alias("here"), *rest).alias("a"))
    b = new.select(*keys, F.struct(F.lit(1).alias("here"), *rest).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(differs, "changed")
    rows = a.join(b, keys, "full_outer").withColumn("change", change).filter("change is not null")
    return rows.select(*keys, "change", *[F.col(f"a.{c}").alias(f"was_{c}") for c in rest], *[F.col(f"b.{c}").alias(f"now_{c}") for c in rest])


def changes(base: Snapshot, current: Snapshot) -> DataFrame:
    """All changes from ``base`` to ``current``.

    Attributes, forms and synonyms are compared in objects that both have. A module changes with its file hash; its
    procedures are compared then, by content hash or signature. A changed module without changed procedures is still a
    row; an added or removed module counts its procedures in n.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    objects = _compare(base["objects"], current["objects"], ["object"], text("a.synonym") != text("b.synonym"))
    whole = objects.filter("change != 'changed'")
    synonyms = objects.filter("change = 'changed'")
    both = base["objects"].select("object").join(current["objects"].select("object"), "object", "left_semi")
    members = lambda s, t: s[t].join(both, "object", "left_semi")
    attributes = _compare(members(base, "attributes"), members(current, "attributes"), ["object", "attribute"], text("a.type_desc") != text("b.type_desc"))
    forms = _compare(members(base, "forms").withColumn("x", F.lit(1)), members(current, "forms").withColumn("x", F.lit(1)), ["object", "form"], F.lit(False))
    modules = _compare(base["modules"], current["modules"], ["module"], ~F.col("a.file_hash").eqNullSafe(F.col("b.file_hash")))
    changed = modules.filter("change = 'changed'").select("module")
    procedures = lambda s: s["procedures"].join(changed, "module", "left_semi").withColumn("key", F.lower("procedure"))
    differs = (text("a.content_hash") != text("b.content_hash")) | (text("a.signature") != text("b.signature"))
    procs = _compare(procedures(base), procedures(current), ["module", "key"], differs)
    counts = base["procedures"].groupBy("module").agg(F.count(F.lit(1)).alias("before")).join(current["procedures"].groupBy("module").agg(F.count(F.lit(1)).alias("after")), "module", "full_outer")
    listed = modules.join(counts, "module", "left")
    n = F.when(F.col("change") == "added", F.coalesce("after", F.lit(0))).when(F.col("change") == "removed", F.coalesce("before", F.lit(0))).otherwise(0).cast("long")
    return reduce(
        DataFrame.unionByName,
        [
            _rows(whole, "object", F.col("change"), object=F.col("object"), name=F.col("object"), was=F.col("was_kind"), now=F.col("now_kind")),
            _rows(synonyms, "synonym", "changed", object=F.col("object"), name=F.col("object"), was=F.col("was_synonym"), now=F.col("now_synonym")),
            _rows(attributes, "attribute", F.col("change"), object=F.col("object"), name=F.col("attribute"), was=F.col("was_type_desc"), now=F.col("now_type_desc")),
            _rows(forms, "form", F.col("change"), object=F.col("object"), name=F.col("form")),
            _rows(listed, "module", F.col("change"), object=object_of(F.col("module")), module=F.col("module"), name=F.col("module"), was=F.col("was_file_hash"), now=F.col("now_file_hash"), n=n),
            _rows(procs, "procedure", F.col("change"), object=object_of(F.col("module")), module=F.col("module"), name=F.coalesce("now_procedure", "was_procedure"), was=F.col("was_signature"), now=F.col("now_signature")),
        ],
    )


def _signature() -> Column:
    return (F.col("part") == "procedure") & (F.col("change") == "changed") & ~F.col("was").eqNullSafe(F.col("now"))


def object_changes(found: DataFrame) -> DataFrame:
    """object, status, metadata_changed, weight: a row for each object with a change.

    An object that is neither added nor removed is changed; the weight counts its attributes, forms and procedures,
    and the procedures of its added and removed modules.
    """
    is_ = lambda *parts: F.col("part").isin(*parts)
    status = F.coalesce(F.max(F.when(is_("object"), F.col("change"))), F.lit("changed"))
    weight = F.when(is_("attribute", "form", "procedure"), 1).when(is_("module"), F.col("n")).otherwise(0)
    meta = F.max(F.when(is_("attribute", "form", "synonym"), 1).otherwise(0)) == 1
    return found.groupBy("object").agg(status.alias("status"), meta.alias("metadata_changed"), F.sum(weight).cast("long").alias("weight"))


def ordered(rows: DataFrame) -> DataFrame:
    """``object_changes`` in the order of reports: the heaviest changed objects first, others by name."""
    return rows.orderBy("status", F.when(F.col("status") == "changed", -F.col("weight")).otherwise(0), "object")


def totals(found: DataFrame) -> DataFrame:
    """One row of the sixteen counters of a comparison."""
    by_object = object_changes(found)
    is_ = lambda part, change: (F.col("part") == part) & (F.col("change") == change)
    count = lambda c: F.count(F.when(c, 1))
    a = found.agg(
        *[count(is_("module", c)).alias(f"modules_{c}") for c in ("changed", "added", "removed")],
        *[count(is_("procedure", c)).alias(f"procedures_{c}") for c in ("changed", "added", "removed")],
        count(_signature()).alias("procedures_signature"),
        F.coalesce(F.sum(F.when(is_("module", "added"), F.col("n"))), F.lit(0)).cast("long").alias("procedures_in_added_modules"),
        *[count(is_("attribute", c)).alias(f"attributes_{n}") for c, n in (("added", "added"), ("removed", "removed"), ("changed", "retyped"))],
        count(is_("form", "added")).alias("forms_added"),
    )
    b = by_object.agg(
        *[count(F.col("status") == s).alias(f"objects_{s}") for s in ("added", "removed", "changed")],
        count((F.col("status") == "changed") & F.col("metadata_changed")).alias("objects_metadata_changed"),
    )
    return a.crossJoin(b)  # one row each


def conflicts(ours: DataFrame, release: DataFrame, intercepts: DataFrame | None = None) -> DataFrame:
    """kind, object, target, note: where ``changes`` of ours meet those of a release against the same base.

    ``intercepts``: module, procedure, source_id, ext_procedure, directive. Modules: added on both sides name_clash,
    removed by us and changed there removed_by_you, changed by us and removed there removed_in_release; of two changed
    ones the procedures are compared, and module_both stands for a module none of whose procedures meet. Objects: added
    on both sides name_clash; changed by us and removed there removed_in_release; of two changed ones attributes added on
    both sides clash, retyped by us and retyped or removed there are both_changed, and object_both stands for the rest.
    """
    out = []

    def add(rows: DataFrame, kind: Column | str, target: Column, note: Column | str = "") -> None:
        named = lambda x: F.lit(x) if isinstance(x, str) else x
        out.append(rows.select(named(kind).alias("kind"), "object", target.alias("target"), named(note).alias("note")).filter("kind is not null"))

    # What both sides touched, whatever it is: one join.
    keys = ["object", "part", "m", "name"]
    side = lambda found, s: found.select("object", "part", F.coalesce("module", F.lit("")).alias("m"), "name", F.col("change").alias(f"{s}_change"), F.col("was").alias(f"{s}_was"), F.col("now").alias(f"{s}_now"))
    both = side(ours, "our").drop("our_was", "our_now").join(side(release, "their"), keys)
    us, them, part = F.col("our_change"), F.col("their_change"), F.col("part")
    kind = (
        F.when((us == "added") & (them == "added"), "name_clash")
        .when((us == "removed") & (them == "changed") & part.isin("module", "procedure"), "removed_by_you")
        .when((us == "changed") & (them == "removed") & part.isin("module", "procedure"), "removed_in_release")
        .when((us == "changed") & (them == "changed") & (part == "procedure"), "both_changed")
        .when((us == "changed") & them.isin("changed", "removed") & (part == "attribute"), "both_changed")
    )
    both = both.filter(part.isin("module", "procedure", "attribute", "object")).withColumn("kind", kind).persist()
    target = F.when(part == "procedure", F.concat_ws(".", "m", "name")).when(part == "attribute", F.concat_ws(".", "object", "name")).otherwise(F.col("name"))
    resigned = (part == "procedure") & (F.col("kind") == "both_changed") & ~F.col("their_was").eqNullSafe(F.col("their_now"))
    named_note = F.when(resigned, "new signature").when(part == "procedure", "").when((part == "attribute") & (F.col("kind") == "both_changed"), "type of an attribute").otherwise(part)
    add(both.filter("kind is not null and not (part = 'module' and kind = 'removed_in_release')"), F.col("kind"), target, named_note)

    # Modules that need counts: what is removed there, and what both changed without meeting in a procedure.
    counted = _counts(ours).withColumnsRenamed({"edited": "our_edited", "touched": "our_touched"}).join(_counts(release).withColumnsRenamed({"edited": "their_edited", "touched": "their_touched"}), "module", "full_outer")
    met = both.filter("part = 'procedure' and kind is not null").select("m").distinct()
    modules = both.filter("part = 'module' and our_change = 'changed' and their_change in ('removed', 'changed')").withColumnRenamed("name", "module").join(counted, "module", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    add(modules.filter("their_change = 'removed'"), "removed_in_release", F.col("module"), F.concat(F.lit("module, our procedures: "), zero("our_edited")))
    alone = modules.filter("their_change = 'changed'").join(met, "m", "left_anti")
    add(alone, "module_both", F.col("module"), F.concat(F.lit("our procedures: "), zero("our_edited"), F.lit(", of the release: "), zero("their_touched")))

    # Objects whose metadata we changed: removed there, or changed there without a common attribute. Parts are compared
    # only in objects that both sides of a comparison have, so such an object is neither added nor removed itself.
    inside = lambda found: found.filter(F.col("part").isin("attribute", "form", "synonym")).select("object").distinct()
    mine = inside(ours)
    gone = release.filter("part = 'object' and change = 'removed'").select("object")
    add(mine.join(gone, "object", "left_semi"), "removed_in_release", F.col("object"), "object")
    shared = mine.join(inside(release), "object", "left_semi").join(both.filter("part = 'attribute' and kind is not null").select("object").distinct(), "object", "left_anti")
    add(shared, "object_both", F.col("object"))

    if intercepts is not None:
        where = F.concat(F.col("source_id").cast("string"), F.lit(": "), "ext_procedure")
        theirs = release.filter("part = 'module'").select("module", F.col("change").alias("module_change"), "object")
        inside = release.filter("part = 'procedure'").select("module", F.lower("name").alias("key"), F.col("change").alias("proc_change"), _signature().alias("resigned"))
        rows = intercepts.withColumn("key", F.lower("procedure")).join(theirs, "module").join(inside, ["module", "key"], "left")
        lost = (F.col("module_change") == "removed") | (F.col("proc_change") == "removed")
        changed = (F.col("module_change") == "changed") & (F.col("proc_change") == "changed")
        word = F.lower(F.regexp_extract("directive", r"&(\S+?)[:(]", 1))
        note = F.concat_ws("; ", where, F.when(~lost & F.col("resigned"), "new signature").when(~lost & word.isin(*REPLACING), "replaced wholly").when(lost, "removed"))
        add(rows.filter(lost | changed), F.when(lost, "intercepted_removed").otherwise("intercepted_changed"), F.concat_ws(".", "module", "procedure"), note)
    return reduce(DataFrame.unionByName, out)


def _counts(found: DataFrame) -> DataFrame:
    """module, edited (changed and added procedures), touched (removed ones too)."""
    procs = found.filter("part = 'procedure'")
    return procs.groupBy("module").agg(F.count(F.when(F.col("change") != "removed", 1)).alias("edited"), F.count(F.lit(1)).alias("touched"))


def severity(spark) -> DataFrame:
    """kind, rank, advice: the kinds of conflicts, the gravest first."""
    return spark.createDataFrame([(k, i, a) for i, (k, a) in enumerate(CONFLICTS.items())], "kind string, rank int, advice string")


def by_severity(found: DataFrame) -> DataFrame:
    """``conflicts`` with rank and advice, the gravest kinds first, then by target."""
    return found.join(F.broadcast(severity(found.sparkSession)), "kind").orderBy("rank", "target", "note")


def conflict_counts(found: DataFrame) -> DataFrame:
    """kind, n of all kinds, those without conflicts too."""
    counted = found.groupBy("kind").agg(F.count(F.lit(1)).alias("found"))
    return severity(found.sparkSession).join(counted, "kind", "left").select("kind", F.coalesce("found", F.lit(0).cast("long")).alias("n"))
