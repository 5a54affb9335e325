"""Static checks over an index: broken calls, causes of unresolved ones, completeness, stale files, versions.

``resolved``: the result of ``graph.resolve_calls`` with proc_id (the calling procedure) and context (the text of the
call's line). Other tables as in ``graph``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import version_parts
from quarry.operators.graph import common_key

#: Kinds of calls that name a module.
NAMED = ("common_module", "manager", "manager_object")
HINTS = 3
# Kinds whose objects a configuration lists, so that a missing one is certain.
LISTED_KINDS = ("справочник", "документ", "константа")
# Standard attributes, whose methods are no module's.
STANDARD = (
    "ссылка", "ref", "владелец", "owner", "родитель", "parent", "бизнеспроцесс", "businessprocess", "точкамаршрута", "routepoint", "ведущаязадача", "headtask", "регистратор", "recorder",
    "движения", "registerrecords", "обменданными", "dataexchange", "отбор", "filter", "объект", "object",
)
_MANAGER = ".модульменеджера"


def short_name(module: Column) -> Column:
    """The second word of a dotted name, or the only one."""
    return F.coalesce(F.get(F.split(module, r"\."), F.lit(1)), module)


def exports_of(procedures: DataFrame) -> DataFrame:
    """module_key, name, exported: whether any source exports the procedure of that name in that module."""
    own = F.lower("module")
    keys = F.when(own.contains("."), F.array(own)).otherwise(F.array(own, common_key(own)))
    rows = procedures.select(F.explode(keys).alias("module_key"), F.lower("procedure").alias("name"), "is_export")
    return rows.groupBy("module_key", "name").agg(F.bool_or("is_export").alias("exported"))


def homes_of(procedures: DataFrame, hints: int = HINTS) -> DataFrame:
    """name, defined_in: the first modules, by module and source, that have a procedure of that name."""
    rows = procedures.groupBy(F.lower("procedure").alias("name"), "module", "source_id").agg(F.lit(1).alias("x"))
    first = F.row_number().over(Window.partitionBy("name").orderBy("module", "source_id"))
    return rows.withColumn("rn", first).filter(F.col("rn") <= hints).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("module", "source_id"))).alias("defined_in"))


def named_directly(context: Column, module: Column, name: Column) -> Column:
    """Whether a line spells the call out; an unknown line counts as doing so."""
    dots = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s*([.(])\s*", "$1")
    spelt = F.concat(F.lower(module), F.lit("."), F.lower(name), F.lit("("))
    before = F.call_function("substring_index", dots(context), spelt, F.lit(1))
    return (F.coalesce(context, F.lit("")) == "") | (F.contains(dots(context), spelt) & ~before.rlike(r"[\p{L}\p{N}_.]$"))


def broken_calls(resolved: DataFrame, procedures: DataFrame, objects: DataFrame | None = None, attributes: DataFrame | None = None, platform_methods: DataFrame | None = None, platform_names: DataFrame | None = None, evaluated: DataFrame | None = None) -> DataFrame:
    """The calls of named modules with their problem: call_id, source_id, module, caller, line, kind, callee_module,
    callee, problem, defined_in, missing_object.

    - missing: the module is there and has no such procedure (defined_in tells which have), or the object that a
      manager belongs to is not among ``objects`` (missing_object);
    - not_export: another module calls a procedure that no source exports;
    - external: no module of that name is there, nor an object, a name of the platform or an attribute of the caller's
      own object;
    - dynamic: the line does not spell the call out, or ``evaluated`` (callee_module) tells that the name is a variable
      that holds an evaluated module.

    Calls of ``platform_methods`` (kind, method) are none of these. Only calls without a target, or to a procedure that
    is not exported, are looked at.
    """
    targets = procedures.select(F.col("proc_id").alias("target"), F.col("is_export").alias("target_export"))
    rows = resolved.filter(F.col("kind").isin(*NAMED)).join(targets, "target", "left").filter("target is null or not target_export")
    named = F.lower(F.coalesce("callee_module", F.lit("")))
    rows = rows.filter(named != "").withColumn("module_key", F.when(F.col("kind") == "common_module", common_key(named)).otherwise(named)).withColumn("name", F.lower("callee"))
    exports = exports_of(procedures)
    modules = exports.select("module_key").distinct().withColumn("has_module", F.lit(True))
    shorts = procedures.select(short_name(F.lower("module")).alias("short")).distinct().withColumn("has_short", F.lit(True))
    rows = rows.join(exports, ["module_key", "name"], "left").join(modules, "module_key", "left").withColumn("short", short_name(named)).join(shorts, "short", "left")
    rows = rows.withColumn("object_key", F.regexp_replace("module_key", r"\.модульменеджера$", "")).withColumn("kind_key", F.substring_index("module_key", ".", 1))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    if objects is not None:
        known = objects.select(F.lower("object").alias("object_key")).unionByName(procedures.filter(F.lower("module").endswith(_MANAGER)).select(F.regexp_replace(F.lower("module"), r"\.модульменеджера$", "").alias("object_key"))).distinct()
        rows = rows.join(known.withColumn("has_object", F.lit(True)), "object_key", "left")
        lost = F.col("kind").isin("manager", "manager_object") & F.col("kind_key").isin(*LISTED_KINDS) & no("has_object")
    else:
        lost = F.lit(False)
    flag = lambda frame, column, keys: rows.join(frame, keys, "left") if frame is not None else rows.withColumn(column, F.lit(False))
    rows = flag(platform_methods.select(F.lower("kind").alias("kind_key"), F.lower("method").alias("name"), F.lit(True).alias("platform")).distinct() if platform_methods is not None else None, "platform", ["kind_key", "name"])
    rows = rows.withColumn("named", named)
    rows = flag(platform_names.select(F.lower("name").alias("named"), F.lit(True).alias("known")).distinct() if platform_names is not None else None, "known", ["named"])
    rows = rows.withColumn("own", F.when(F.lower("module").contains("."), F.substring_index(F.lower("module"), ".", 2)))
    rows = flag(attributes.select(F.lower("object").alias("own"), F.lower("attribute").alias("named"), F.lit(True).alias("attributed")).distinct() if attributes is not None else None, "attributed", ["own", "named"])
    rows = flag(evaluated.select(F.lower("callee_module").alias("named"), F.lit(True).alias("is_evaluated")).distinct() if evaluated is not None else None, "is_evaluated", ["named"])
    common = F.col("kind") == "common_module"
    own_attribute = common & (F.col("named").isin(*STANDARD) | ~no("attributed"))
    direct = ~common | named_directly(F.col("context"), F.col("callee_module"), F.col("callee"))
    absent = F.col("exported").isNull()
    foreign = ~absent & ~F.coalesce("exported", F.lit(False)) & (F.lower("module") != F.col("module_key"))
    problem = (
        F.when(lost, "missing")
        .when(F.col("kind").isin("manager", "manager_object") & ~no("platform"), None)
        .when(no("has_module") & ((F.col("kind") == "manager_object") | F.col("target").isNotNull() | ~no("has_short") | ~no("known") | own_attribute), None)
        .when(no("has_module") & common & ~no("is_evaluated"), "dynamic")
        .when(no("has_module"), "external")
        .when((absent | foreign) & ~direct, "dynamic")
        .when(absent, "missing")
        .when(foreign, "not_export")
    )
    rows = rows.withColumn("missing_object", lost).withColumn("problem", problem).filter("problem is not null").join(homes_of(procedures), "name", "left")
    hints = F.when((F.col("problem") == "missing") & ~F.col("missing_object"), F.coalesce("defined_in", F.array().cast("array<struct<module:string,source_id:string>>")))
    kind = F.when(F.col("kind") == "manager_object", "manager").otherwise(F.col("kind"))
    return rows.select("call_id", "source_id", "module", "caller", "line", kind.alias("kind"), "callee_module", "callee", "problem", hints.alias("defined_in"), "missing_object")


def in_order(broken: DataFrame, problem: str) -> DataFrame:
    return broken.filter(F.col("problem") == problem).orderBy("module", "source_id", "line", "callee")


def external_modules(broken: DataFrame) -> DataFrame:
    """callee_module, kind, calls, methods, sample (the first call): the modules that are not there, the most called first."""
    rows = broken.filter("problem = 'external'").groupBy("callee_module").agg(
        F.min("kind").alias("kind"), F.count(F.lit(1)).alias("calls"), F.countDistinct("callee").alias("methods"),
        F.min_by(F.struct("module", "caller", "line", "callee"), F.struct("call_id")).alias("sample"),
    )
    return rows.orderBy(F.desc("calls"), "callee_module")


def evaluated_names(modules: DataFrame) -> DataFrame:
    """source_id, module, callee_module: variables that a module's text fills by evaluating an expression."""
    found = F.regexp_extract_all("text", F.lit(r"(?iu)(?<![\p{L}\p{N}_.])([\p{L}_][\p{L}\p{N}_]*)\s*=\s*(?:Вычислить|Eval)\s*\("), F.lit(1))
    return modules.select("source_id", "module", F.explode(F.array_distinct(found)).alias("callee_module"))


def unresolved_causes(resolved: DataFrame, procedures: DataFrame) -> DataFrame:
    """kind, callee_module, callee, freq, cause, reason, defined_in of the names of common modules and managers without a target.

    module_missing: no module with code and no object of that name; method_missing: the module has no such procedure;
    other: for the reason that the name is empty, that a target is there after all, or that an object has the name.
    """
    rows = resolved.filter("target is null and kind in ('common_module', 'manager')").groupBy("kind", "callee_module", "callee").agg(F.count(F.lit(1)).alias("freq"))
    named = F.lower(F.coalesce("callee_module", F.lit("")))
    rows = rows.withColumn("module_key", F.when(F.col("kind") == "common_module", common_key(named)).otherwise(named)).withColumn("name", F.lower("callee")).withColumn("short", short_name(named))
    exports = exports_of(procedures)
    rows = rows.join(exports.select("module_key", "name", F.lit(True).alias("has_method")), ["module_key", "name"], "left")
    rows = rows.join(exports.select("module_key").distinct().withColumn("has_module", F.lit(True)), "module_key", "left")
    rows = rows.join(procedures.select(short_name(F.lower("module")).alias("short")).distinct().withColumn("has_short", F.lit(True)), "short", "left")
    reason = F.when(named == "", "no_module_name").when(F.col("has_method"), "resolvable").when(F.col("has_module").isNull() & F.col("has_short"), "name_matches")
    cause = F.when(reason.isNotNull(), "other").when(F.col("has_module"), "method_missing").otherwise("module_missing")
    rows = rows.withColumn("reason", reason).withColumn("cause", cause).join(homes_of(procedures), "name", "left")
    return rows.select("kind", "callee_module", "callee", "freq", "cause", "reason", F.when(F.col("cause") == "method_missing", F.col("defined_in")).alias("defined_in"))


def cause_shares(causes: DataFrame, top: int = 20) -> DataFrame:
    """cause, calls, pct, top: calls by cause, their share of all, and the names that occur most."""
    rank = F.row_number().over(Window.partitionBy("cause").orderBy(F.desc("freq"), "callee_module", "callee", "kind"))
    best = causes.withColumn("rn", rank).filter(F.col("rn") <= top).groupBy("cause").agg(F.array_sort(F.collect_list(F.struct("rn", "kind", "callee_module", "callee", "freq"))).alias("top"))
    sums = causes.groupBy("cause").agg(F.sum("freq").alias("calls"))
    total = sums.agg(F.sum("calls").alias("total"))
    return sums.crossJoin(F.broadcast(total)).join(best, "cause").select("cause", "calls", F.round(100.0 * F.col("calls") / F.col("total"), 1).alias("pct"), "top")  # one row


# -- completeness ---------------------------------------------------------------------------------------------------------

_DECLARED = r"(?imu)^\s*(?:(?:Асинх|Async)\s+)?(?:Процедура|Функция|Procedure|Function)\s+([\p{L}\p{N}_]+)\s*\("


def declared(modules: DataFrame) -> DataFrame:
    """module, procedure, line, signature: every line of a module's text that looks like a declaration."""
    lines = modules.select("module", F.posexplode(F.split("text", "\r?\n", -1)).alias("at", "s")).withColumn("procedure", F.regexp_extract("s", _DECLARED, 1)).filter("procedure != ''")
    last = F.max(F.struct((F.col("at") + 1).alias("line"), F.substring(F.trim("s"), 1, 150).alias("signature")))
    return lines.groupBy("module", "procedure").agg(last.alias("m")).select("module", "procedure", "m.*")


def not_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of ``left`` (module, procedure) without a procedure of that name in a module of ``right`` whose name
    holds, or is held by, theirs. Modules meet only where they share the procedure's name."""
    names = right.groupBy("procedure").agg(F.collect_set("module").alias("modules"))
    rows = left.join(names, "procedure", "left")
    near = F.exists(F.coalesce("modules", F.array().cast("array<string>")), lambda m: F.contains(m, F.col("module")) | F.contains(F.col("module"), m))
    return rows.filter(~near).drop("modules")


def completeness(modules: DataFrame, procedures: DataFrame) -> DataFrame:
    """side (missing: in files only; extra: in the index only), module, procedure, line, signature."""
    files = declared(modules)
    indexed = procedures.select("module", "procedure").distinct()
    missing = not_in(files, indexed).select(F.lit("missing").alias("side"), "module", "procedure", "line", "signature")
    extra = not_in(indexed, files).select(F.lit("extra").alias("side"), "module", "procedure", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("signature"))
    return missing.unionByName(extra)


def stale_files(stored: DataFrame, now: DataFrame, key: str = "relative_path", digest: str = "file_hash") -> DataFrame:
    """key and state (changed, gone) of the stored files whose content is not what it was when they were read."""
    rows = stored.select(key, F.col(digest).alias("was")).join(now.select(key, F.col(digest).alias("now")), key, "left")
    return rows.withColumn("state", F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("was"), "changed")).filter("state is not null").select(key, "state")


# -- versions -------------------------------------------------------------------------------------------------------------


def minimum_mode(since: Column, compat: Column, verified: Column | None = None) -> Column:
    """The later of the version a member exists since and the mode it asks for; ``verified`` where no mode is given."""
    given = F.coalesce(compat, F.lit("")) != ""
    later = F.when(version_parts(compat) > version_parts(F.coalesce(since, F.lit(""))), compat).otherwise(since)
    return F.when(given, later).otherwise(F.coalesce(verified, since) if verified is not None else since)


def mode_warning(least: Column, mode: Column) -> Column:
    """What is wrong with a mode older than the least one; null where nothing is, or where one is unknown."""
    known = (F.coalesce(least, F.lit("")) != "") & (F.coalesce(mode, F.lit("")) != "")
    return F.when(known & (version_parts(least) > version_parts(mode)), F.concat(F.lit("needs mode "), least, F.lit(" or later, the mode is "), mode))


def newest(versions: DataFrame) -> DataFrame:
    """version: the latest of those that are not corrupt (columns version, corrupt); null without any."""
    return versions.filter("not corrupt").agg(F.max_by("version", version_parts(F.col("version"))).alias("version"))
