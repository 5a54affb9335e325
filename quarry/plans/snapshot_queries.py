"""Queries over three snapshots of a configuration: a base, ours and a release, each made of the test tables.

A snapshot leaves out the rows whose key a number divides, and changes those that another divides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import snapshots
from quarry.plans.registry import entry, read

#: (left out, changed) of each snapshot; nothing is changed in the base.
CUTS = {"base": (11, 0), "ours": (13, 7), "release": (17, 5)}


def _sql(name: str) -> str:
    gone, changed = CUTS[name]
    mark = lambda key, old, new: f"CASE WHEN {changed or 1} > 1 AND {key} % {changed or 1} = 0 THEN {new} ELSE {old} END"
    return f"""
    {name}_objects AS (SELECT 'Справочник.C' || c_custkey AS object, c_mktsegment AS kind, {mark("c_custkey", "c_name", f"'{name}'")} AS synonym FROM customer WHERE c_custkey % {gone} <> 0),
    {name}_attributes AS (SELECT 'Справочник.C' || o_custkey AS object, 'A' || o_orderkey AS attribute, {mark("o_orderkey", "o_orderpriority", f"'{name}'")} AS type_desc FROM orders WHERE o_orderkey % {gone} <> 0 AND o_custkey % {gone} <> 0),
    {name}_forms AS (SELECT 'Справочник.C' || o_custkey AS object, 'F' || o_orderkey AS form FROM orders WHERE o_orderkey % 10 = 0 AND (o_orderkey // 10) % {gone} <> 0 AND o_custkey % {gone} <> 0),
    {name}_modules AS (SELECT 'Справочник.C' || p_partkey || '.Модуль' AS module, {mark("p_partkey", "p_brand", f"'{name}'")} AS file_hash FROM part WHERE p_partkey % {gone} <> 0),
    {name}_procedures AS (SELECT 'Справочник.C' || l_partkey || '.Модуль' AS module, 'P' || l_suppkey AS procedure, {mark("l_suppkey", "min(l_returnflag)", f"'{name}'")} AS signature, {mark("(l_suppkey // 2)", "max(l_linestatus)", f"'{name}'")} AS content_hash
        FROM lineitem WHERE (l_suppkey + l_partkey) % {gone} <> 0 AND l_partkey % {gone} <> 0 GROUP BY l_partkey, l_suppkey)"""


def snapshot(spark: SparkSession, sf_dir: str, name: str) -> snapshots.Snapshot:
    gone, changed = CUTS[name]
    c, o, p, l = (read(spark, sf_dir, t) for t in ("customer", "orders", "part", "lineitem"))  # noqa: E741
    mark = lambda key, old: F.when(key % changed == 0, name).otherwise(old) if changed else old
    named = lambda k, end="": F.concat(F.lit("Справочник.C"), k, F.lit(end))
    there = lambda *keys: [f"{k} % {gone} != 0" for k in keys]
    kept = lambda frame, *keys: frame.filter(" and ".join(there(*keys)))
    half = F.floor(F.col("l_suppkey") / 2)
    procedures = l.filter(f"(l_suppkey + l_partkey) % {gone} != 0 and l_partkey % {gone} != 0").groupBy("l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("s"), F.max("l_linestatus").alias("h"))
    return {
        "objects": kept(c, "c_custkey").select(named("c_custkey").alias("object"), F.col("c_mktsegment").alias("kind"), mark(F.col("c_custkey"), F.col("c_name")).alias("synonym")),
        "attributes": kept(o, "o_orderkey", "o_custkey").select(named("o_custkey").alias("object"), F.concat(F.lit("A"), "o_orderkey").alias("attribute"), mark(F.col("o_orderkey"), F.col("o_orderpriority")).alias("type_desc")),
        "forms": kept(o.filter("o_orderkey % 10 = 0"), "floor(o_orderkey / 10)", "o_custkey").select(named("o_custkey").alias("object"), F.concat(F.lit("F"), "o_orderkey").alias("form")),
        "modules": kept(p, "p_partkey").select(named("p_partkey", ".Модуль").alias("module"), mark(F.col("p_partkey"), F.col("p_brand")).alias("file_hash")),
        "procedures": procedures.select(named("l_partkey", ".Модуль").alias("module"), F.concat(F.lit("P"), "l_suppkey").alias("procedure"), mark(F.col("l_suppkey"), F.col("s")).alias("signature"), mark(half, F.col("h")).alias("content_hash")),
    }


def _changes_sql(name: str, a: str, b: str) -> str:
    full = lambda t, key, value: f"{a}_{t} x FULL JOIN {b}_{t} y ON {' AND '.join(f'x.{k} = y.{k}' for k in key)}"
    status = lambda key, differs: f"CASE WHEN x.{key} IS NULL THEN 'added' WHEN y.{key} IS NULL THEN 'removed' WHEN {differs} THEN 'changed' END"
    both = f"(SELECT x.object FROM {a}_objects x JOIN {b}_objects y ON x.object = y.object)"
    changed = f"(SELECT x.module FROM {a}_modules x JOIN {b}_modules y ON x.module = y.module WHERE x.file_hash <> y.file_hash)"
    return f"""
    {name}_o AS (SELECT coalesce(x.object, y.object) AS object, {status("object", "x.synonym <> y.synonym")} AS change, x.synonym AS s0, y.synonym AS s1, x.kind AS k0, y.kind AS k1 FROM {full("objects", ["object"], "")}),
    {name}_a AS (SELECT coalesce(x.object, y.object) AS object, coalesce(x.attribute, y.attribute) AS name, {status("object", "x.type_desc <> y.type_desc")} AS change, x.type_desc AS was, y.type_desc AS now FROM {full("attributes", ["object", "attribute"], "")} WHERE coalesce(x.object, y.object) IN {both}),
    {name}_f AS (SELECT coalesce(x.object, y.object) AS object, coalesce(x.form, y.form) AS name, {status("object", "false")} AS change FROM {full("forms", ["object", "form"], "")} WHERE coalesce(x.object, y.object) IN {both}),
    {name}_m AS (SELECT coalesce(x.module, y.module) AS module, {status("module", "x.file_hash <> y.file_hash")} AS change, x.file_hash AS was, y.file_hash AS now FROM {full("modules", ["module"], "")}),
    {name}_p AS (SELECT coalesce(x.module, y.module) AS module, coalesce(y.procedure, x.procedure) AS name, {status("module", "x.signature <> y.signature OR x.content_hash <> y.content_hash")} AS change, x.signature AS was, y.signature AS now FROM {full("procedures", ["module", "procedure"], "")} WHERE coalesce(x.module, y.module) IN {changed}),
    {name} AS (
        SELECT object, NULL::VARCHAR AS module, 'object' AS part, object AS name, change, k0 AS was, k1 AS now, 1 AS n FROM {name}_o WHERE change IN ('added', 'removed')
        UNION ALL SELECT object, NULL, 'synonym', object, change, s0, s1, 1 FROM {name}_o WHERE change = 'changed'
        UNION ALL SELECT object, NULL, 'attribute', name, change, was, now, 1 FROM {name}_a WHERE change IS NOT NULL
        UNION ALL SELECT object, NULL, 'form', name, change, NULL, NULL, 1 FROM {name}_f WHERE change IS NOT NULL
        UNION ALL SELECT replace(module, '.Модуль', ''), module, 'module', module, change, was, now, CASE change WHEN 'added' THEN (SELECT count(*) FROM {b}_procedures q WHERE q.module = m.module) WHEN 'removed' THEN (SELECT count(*) FROM {a}_procedures q WHERE q.module = m.module) ELSE 0 END FROM {name}_m m WHERE change IS NOT NULL
        UNION ALL SELECT replace(module, '.Модуль', ''), module, 'procedure', name, change, was, now, 1 FROM {name}_p WHERE change IS NOT NULL)"""


OURS = f"{_sql('base')}, {_sql('ours')}, {_changes_sql('d', 'base', 'ours')}"
OBJECTS_SQL = """{0}_x AS (SELECT object, coalesce(max(change) FILTER (part = 'object'), 'changed') AS status, bool_or(part IN ('attribute', 'form', 'synonym')) AS metadata_changed,
    CAST(sum(CASE WHEN part IN ('attribute', 'form', 'procedure') THEN 1 WHEN part = 'module' THEN n ELSE 0 END) AS BIGINT) AS weight FROM {0} GROUP BY 1)"""


def _ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changes(snapshot(spark, sf_dir, "base"), snapshot(spark, sf_dir, "ours"))


@entry(f"WITH {OURS} SELECT object, part, name, change, was, now FROM d WHERE part IN ('object', 'synonym', 'attribute', 'form')")
def diff_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ours(spark, sf_dir).filter("part in ('object', 'synonym', 'attribute', 'form')").select("object", "part", "name", "change", "was", "now")


@entry(f"WITH {OURS} SELECT object, module, part, name, change, was, now, CAST(n AS BIGINT) AS n FROM d WHERE part IN ('module', 'procedure')")
def diff_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ours(spark, sf_dir).filter("part in ('module', 'procedure')")


@entry(f"""
    WITH {OURS}, {OBJECTS_SQL.format("d")}
    SELECT count(*) FILTER (part = 'module' AND change = 'changed') AS modules_changed, count(*) FILTER (part = 'module' AND change = 'added') AS modules_added, count(*) FILTER (part = 'module' AND change = 'removed') AS modules_removed,
        count(*) FILTER (part = 'procedure' AND change = 'changed') AS procedures_changed, count(*) FILTER (part = 'procedure' AND change = 'added') AS procedures_added, count(*) FILTER (part = 'procedure' AND change = 'removed') AS procedures_removed,
        count(*) FILTER (part = 'procedure' AND change = 'changed' AND was <> now) AS procedures_signature, CAST(sum(n) FILTER (part = 'module' AND change = 'added') AS BIGINT) AS procedures_in_added_modules,
        count(*) FILTER (part = 'attribute' AND change = 'added') AS attributes_added, count(*) FILTER (part = 'attribute' AND change = 'removed') AS attributes_removed, count(*) FILTER (part = 'attribute' AND change = 'changed') AS attributes_retyped,
        count(*) FILTER (part = 'form' AND change = 'added') AS forms_added, (SELECT count(*) FROM d_x WHERE status = 'added') AS objects_added, (SELECT count(*) FROM d_x WHERE status = 'removed') AS objects_removed,
        (SELECT count(*) FROM d_x WHERE status = 'changed') AS objects_changed, (SELECT count(*) FROM d_x WHERE status = 'changed' AND metadata_changed) AS objects_metadata_changed FROM d""")
def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.totals(_ours(spark, sf_dir))


@entry(f"WITH {OURS}, {OBJECTS_SQL.format('d')} SELECT object, status, metadata_changed, weight FROM d_x")
def diff_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.object_changes(_ours(spark, sf_dir))


CONFLICTS_SQL = f"""{_sql("base")}, {_sql("ours")}, {_sql("release")}, {_changes_sql("u", "base", "ours")}, {_changes_sql("t", "base", "release")}, {OBJECTS_SQL.format("u")}, {OBJECTS_SQL.format("t")},
    met AS (SELECT u.object, u.module, u.name, CASE WHEN u.change = 'changed' AND t.change = 'changed' THEN 'both_changed' WHEN u.change = 'changed' AND t.change = 'removed' THEN 'removed_in_release' WHEN u.change = 'added' AND t.change = 'added' THEN 'name_clash'
        WHEN u.change = 'removed' AND t.change = 'changed' THEN 'removed_by_you' END AS kind FROM u JOIN t ON u.part = 'procedure' AND t.part = 'procedure' AND u.module = t.module AND u.name = t.name),
    mods AS (SELECT u.object, u.module, u.change AS c0, t.change AS c1 FROM u JOIN t ON u.part = 'module' AND t.part = 'module' AND u.module = t.module),
    touched AS (SELECT u_x.object, t_x.status, t_x.metadata_changed FROM u_x JOIN t_x ON u_x.object = t_x.object WHERE u_x.status <> 'added' AND u_x.metadata_changed),
    attrs AS (SELECT u.object, u.name, CASE WHEN u.change = 'added' AND t.change = 'added' THEN 'name_clash' WHEN u.change = 'changed' AND t.change IN ('changed', 'removed') THEN 'both_changed' END AS kind FROM u JOIN t ON u.part = 'attribute' AND t.part = 'attribute' AND u.object = t.object AND u.name = t.name
        WHERE u.object IN (SELECT object FROM touched WHERE status <> 'removed' AND metadata_changed)),
    taken AS (SELECT module, procedure, l AS source_id, 'Ext_' || procedure AS ext_procedure, CASE WHEN l = 'ext' THEN '&Around:' ELSE '&After:' END || procedure AS directive FROM base_procedures, (VALUES ('ext')) AS x(l) WHERE ends_with(procedure, '3')),
    lost AS (SELECT i.*, m.change = 'removed' OR coalesce(p.change, '') = 'removed' AS gone, m.change = 'changed' AND coalesce(p.change, '') = 'changed' AS differs, m.object FROM taken i JOIN t m ON m.part = 'module' AND m.module = i.module LEFT JOIN t p ON p.part = 'procedure' AND p.module = i.module AND p.name = i.procedure),
    conflicts AS (
        SELECT 'name_clash' AS kind, object, module AS target FROM mods WHERE c0 = 'added' AND c1 = 'added'
        UNION ALL SELECT 'removed_by_you', object, module FROM mods WHERE c0 = 'removed' AND c1 = 'changed'
        UNION ALL SELECT 'removed_in_release', object, module FROM mods WHERE c0 = 'changed' AND c1 = 'removed'
        UNION ALL SELECT kind, object, module || '.' || name FROM met WHERE kind IS NOT NULL
        UNION ALL SELECT 'module_both', object, module FROM mods WHERE c0 = 'changed' AND c1 = 'changed' AND module NOT IN (SELECT module FROM met WHERE kind IS NOT NULL)
        UNION ALL SELECT 'name_clash', u_x.object, u_x.object FROM u_x JOIN t_x ON u_x.object = t_x.object WHERE u_x.status = 'added' AND t_x.status = 'added'
        UNION ALL SELECT 'removed_in_release', object, object FROM touched WHERE status = 'removed'
        UNION ALL SELECT kind, object, object || '.' || name FROM attrs WHERE kind IS NOT NULL
        UNION ALL SELECT 'object_both', object, object FROM touched WHERE status <> 'removed' AND metadata_changed AND object NOT IN (SELECT object FROM attrs WHERE kind IS NOT NULL)
        UNION ALL SELECT CASE WHEN gone THEN 'intercepted_removed' ELSE 'intercepted_changed' END, object, module || '.' || procedure FROM lost WHERE gone OR differs)"""


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, release = (snapshot(spark, sf_dir, n) for n in CUTS)
    taken = base["procedures"].filter(F.col("procedure").endswith("3")).select("module", "procedure", F.lit("ext").alias("source_id"), F.concat(F.lit("Ext_"), "procedure").alias("ext_procedure"), F.concat(F.lit("&Around:"), "procedure").alias("directive"))
    # Each side is read by nine joins.
    return snapshots.conflicts(snapshots.changes(base, ours).persist(), snapshots.changes(base, release).persist(), taken)


@entry(f"WITH {CONFLICTS_SQL} SELECT kind, object, target FROM conflicts")
def update_conflicts_3way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir).select("kind", "object", "target")


@entry(f"""
    WITH {CONFLICTS_SQL}, k AS (SELECT unnest(['both_changed', 'removed_in_release', 'intercepted_removed', 'intercepted_changed', 'name_clash', 'removed_by_you', 'object_both', 'module_both', 'no_such_kind']) AS kind)
    SELECT k.kind, count(c.kind) AS n FROM k LEFT JOIN conflicts c ON c.kind = k.kind WHERE k.kind <> 'no_such_kind' GROUP BY 1""")
def conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.conflict_counts(_conflicts(spark, sf_dir))
