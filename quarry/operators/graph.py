"""Call resolution and bounded traversal.

Tables by their columns. ``sources``: source_id, source_type (main or extension). ``modules``: source_id, module (a
dotted name), is_global. ``procedures``: proc_id, source_id, module, procedure, is_export. ``calls``: call_id, source_id,
module and caller (where the call stands), kind (local, common_module, manager, manager_object or override),
callee_module, callee, line. Names compare in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Full names of common modules, by which calls of that kind are looked up: fixed values of the data.
COMMON_MODULE = ("общиймодуль.", ".модуль")


def common_key(module: Column) -> Column:
    return F.concat(F.lit(COMMON_MODULE[0]), module, F.lit(COMMON_MODULE[1]))


def homes(procedures: DataFrame, sources: DataFrame) -> DataFrame:
    """module_key, name, places: for a procedure's name in a module the sources that have it, one element each.

    An element is (source_id, module, extension, first, last): the least and the greatest proc_id of that name there. A
    module of one word is found under its full name as a common module as well, so a key may have two modules of a source.
    """
    rows = procedures.join(sources.select("source_id", (F.col("source_type") == "extension").alias("extension")), "source_id", "left")
    own = F.lower("module")
    keys = F.when(own.contains("."), F.array(own)).otherwise(F.array(own, common_key(own)))
    rows = rows.select(F.explode(keys).alias("module_key"), F.lower("procedure").alias("name"), "source_id", own.alias("module"), F.coalesce("extension", F.lit(False)).alias("extension"), "proc_id")
    places = rows.groupBy("module_key", "name", "source_id", "module", "extension").agg(F.min("proc_id").alias("first"), F.max("proc_id").alias("last"))
    return places.groupBy("module_key", "name").agg(F.collect_list(F.struct("source_id", "module", "extension", "first", "last")).alias("places"))


def _first(places: Column, extension: bool) -> Column:
    """The least proc_id of the preferred kind of source, else of any."""
    liked = F.filter(places, lambda p: p["extension"] == extension)
    pool = F.when(F.size(liked) > 0, liked).otherwise(places)
    return F.array_min(F.transform(pool, lambda p: p["first"]))


def resolve_calls(calls: DataFrame, procedures: DataFrame, modules: DataFrame, sources: DataFrame, platform_methods: DataFrame | None = None) -> DataFrame:
    """``calls`` with target (proc_id) and confidence (exact, name_only, override), both null where nothing fits.

    - local: the procedure of the caller's own module and source (the last of several): exact; else an exported one
      of a global module: name_only, extensions first.
    - common_module: that module under its full name; manager and manager_object: the module as named; both exact,
      extensions first. A manager_object call of one of ``platform_methods`` (kind, method; a kind is the module's
      first word) has no target.
    - override: the same module in another source than the caller's, main sources first: override.

    Ties go to the least proc_id. A call is looked up by one key, so two equi-joins do, and no call is multiplied: the
    candidates of a key are an array with an element for each source.
    """
    kind, named = F.col("kind"), F.lower(F.coalesce("callee_module", F.lit("")))
    key = F.when(kind == "local", F.lower("module")).when(kind == "common_module", common_key(named)).when(kind.isin("manager", "manager_object", "override"), named)
    rows = calls.withColumn("module_key", key).withColumn("name", F.lower("callee"))
    rows = rows.join(homes(procedures, sources), ["module_key", "name"], "left")
    if platform_methods is not None:
        known = platform_methods.select(F.lower("kind").alias("platform_kind"), F.lower("method").alias("name"), F.lit(True).alias("platform")).distinct()
        rows = rows.withColumn("platform_kind", F.substring_index("module_key", ".", 1)).join(known, ["platform_kind", "name"], "left")
    else:
        rows = rows.withColumn("platform", F.lit(None).cast("boolean"))
    here = F.array_max(F.transform(F.filter("places", lambda p: (p["source_id"] == F.col("source_id")) & (p["module"] == F.lower("module"))), lambda p: p["last"]))
    elsewhere = F.filter("places", lambda p: p["source_id"] != F.col("source_id"))
    direct = (
        F.when(kind == "local", here)
        .when((kind == "manager_object") & F.coalesce("platform", F.lit(False)), None)
        .when(kind == "override", _first(elsewhere, False))
        .otherwise(_first(F.col("places"), True))
    )
    rows = rows.withColumn("direct", direct)
    exported = procedures.filter("is_export").join(modules.filter("is_global").select("source_id", "module").distinct(), ["source_id", "module"], "left_semi")
    exported = exported.join(sources.select("source_id", (F.col("source_type") == "extension").alias("extension")), "source_id", "left")
    by_name = exported.groupBy(F.lower("procedure").alias("name")).agg(F.min_by("proc_id", F.struct(~F.coalesce("extension", F.lit(False)), "proc_id")).alias("global"))
    rows = rows.join(by_name, "name", "left").withColumn("global", F.when(kind == "local", F.col("global")))
    confidence = F.when(F.col("direct").isNotNull(), F.when(kind == "override", "override").otherwise("exact")).when(F.col("global").isNotNull(), "name_only")
    return rows.select(*calls.columns, F.coalesce("direct", "global").alias("target"), confidence.alias("confidence"))


def traverse(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """node, depth: nodes within ``depth`` steps of the roots along (src, dst), each at its least depth.

    One join for each step; visited nodes are left out by an anti join, so no path is enumerated. Edges and every front
    are kept, so a level reads the one before it and not its history; an empty front is the end.
    """
    edges = edges.select("src", "dst").persist()
    front = roots.select("node").distinct().withColumn("depth", F.lit(0)).persist()
    seen = front
    for d in range(1, depth + 1):
        near = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = near.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)).persist()
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def callees(resolved: DataFrame) -> DataFrame:
    """The lines of a tree downwards: node, pos, target, name, line, confidence.

    A procedure's calls by line; of those with one (callee, callee_module) the first that is resolved, else the first.
    An unresolved call is a leaf (confidence none); an unresolved one of the kind manager_object is left out.
    ``resolved``: the result of ``resolve_calls`` with proc_id, the calling procedure.
    """
    rows = resolved.filter("kind != 'manager_object' or target is not null")
    best = rows.groupBy("proc_id", "callee", "callee_module").agg(
        F.min(F.struct("line", "call_id")).alias("seen"),
        F.min(F.struct(F.col("target").isNull().alias("open"), "line", "call_id", F.struct("target", "line", "confidence").alias("b"))).alias("m"),
    )
    best = best.select(F.col("proc_id").alias("node"), "seen", F.col("m.b").alias("b"), "callee", "callee_module")
    name = F.when(F.coalesce("callee_module", F.lit("")) != "", F.concat_ws(".", "callee_module", "callee")).otherwise(F.col("callee"))
    pos = F.row_number().over(Window.partitionBy("node").orderBy("seen"))
    return best.select("node", pos.alias("pos"), F.col("b.target").alias("target"), name.alias("name"), F.col("b.line").alias("line"), F.coalesce("b.confidence", F.lit("none")).alias("confidence"))


def callers(resolved: DataFrame, procedures: DataFrame) -> DataFrame:
    """The lines of a tree upwards, in the columns of ``callees``: callers by confidence with their first line, by source, module, name."""
    rows = resolved.filter("target is not null").groupBy(F.col("target").alias("node"), "proc_id", "confidence").agg(F.min("line").alias("line"))
    rows = rows.join(procedures.select("proc_id", "source_id", "module", "procedure"), "proc_id")
    pos = F.row_number().over(Window.partitionBy("node").orderBy("source_id", "module", "procedure", "proc_id", "confidence"))
    return rows.select("node", pos.alias("pos"), F.col("proc_id").alias("target"), F.concat_ws(".", "module", "procedure").alias("name"), "line", "confidence")


TREE = "pos int, parent int, depth int, node long, name string, line int, confidence string, expanded boolean, truncated boolean"


def call_tree(lines: DataFrame, procedures: DataFrame, roots: DataFrame, depth: int = 3, max_nodes: int = 200) -> DataFrame:
    """The tree below each root, depth first: pos, parent (a pos), depth, node, name, line, confidence, expanded, truncated.

    ``lines``: of ``callees`` or ``callers``, written once. A procedure is expanded at its first place under a root
    and may appear again unexpanded. All roots share ``max_nodes``; truncated tells, on every row, that it was reached.
    A round of one job fetches at most max_nodes lines of each procedure that the tree shows so far, and there are at
    most ``depth`` rounds; what a tree shows is bounded by max_nodes, so the walk itself is the driver's.
    """
    spark = lines.sparkSession
    named = procedures.select("proc_id", F.concat_ws(".", "module", "procedure").alias("full_name"), "source_id", "module")
    start = [(r.proc_id, r.full_name) for r in roots.select("proc_id").distinct().join(named, "proc_id").orderBy("source_id", "module", "proc_id").limit(max_nodes).collect()]
    known: dict[int, list] = {}
    while True:
        out, missing, full = _walk(start, known, depth, max_nodes)
        if not missing:
            break
        wanted = spark.createDataFrame([(n,) for n in missing], "node long")
        near = lines.join(F.broadcast(wanted), "node").filter(F.col("pos") <= max_nodes)  # max_nodes rows at most
        near = near.join(named.select(F.col("proc_id").alias("target"), "full_name"), "target", "left")
        known.update((n, []) for n in missing)
        for r in near.select("node", "pos", "target", F.coalesce("full_name", "name").alias("name"), "line", "confidence").orderBy("node", "pos").collect():
            known[r.node].append((r.target, r.name, r.line, r.confidence))
    return spark.createDataFrame([(*row, full) for row in out], TREE)


def _walk(start: list, known: dict[int, list], depth: int, max_nodes: int) -> tuple[list, list, bool]:
    """The rows of the tree as far as it is known, the procedures whose lines are missing, and whether the limit was met."""
    out: list[tuple] = []
    missing: dict[int, None] = {}
    count = 1
    for node, name in start:
        if len(start) > 1:
            count += 1
        visited: set[int] = set()
        # (node, parent's pos, depth, name, line, confidence) still to come, the next one last
        stack = [(node, None, 0, name, None, None, True)]
        while stack:
            at, parent, level, label, line, confidence, counted = stack.pop()
            if not counted:
                if count >= max_nodes:
                    continue
                count += 1
            pos = len(out)
            expand = at is not None and level < depth and at not in visited and count < max_nodes
            out.append((pos, parent, level, at, label, line, confidence, expand))
            if expand:
                visited.add(at)
                if at not in known:
                    missing[at] = None
                stack.extend((t, pos, level + 1, n, ln, c, False) for t, n, ln, c in reversed(known.get(at, [])))
    return out, list(missing), count >= max_nodes


def graph_of(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, name, depth: the least) and distinct edges (source, target) of a tree; a repeated visit adds an edge only."""
    keyed = tree.withColumn("key", F.coalesce(F.col("node").cast("string"), F.concat(F.lit("?"), F.col("name"))))
    nodes = keyed.groupBy("key").agg(F.min_by("name", "pos").alias("name"), F.min("depth").alias("depth"))
    parents = keyed.select(F.col("pos").alias("parent"), F.col("key").alias("source"))
    return nodes, keyed.filter("parent is not null").join(parents, "parent").select("source", F.col("key").alias("target")).distinct()


def intercepts(resolved: DataFrame, procedures: DataFrame) -> DataFrame:
    """module, procedure, source_id, ext_procedure, directive: what procedures of other sources replace or extend.

    An interceptor is an override call that stands on the line where its own procedure starts. ``resolved`` has
    proc_id, ``procedures`` start_line and directive.
    """
    taken = procedures.select(F.col("proc_id").alias("target"), F.col("source_id").alias("base"), F.col("module").alias("base_module"), F.col("procedure").alias("base_procedure"))
    ours = procedures.select("proc_id", F.col("procedure").alias("ext_procedure"), "directive", F.col("start_line").alias("line"))
    rows = resolved.filter("confidence = 'override'").select("proc_id", "source_id", "line", "target").join(ours, ["proc_id", "line"]).join(taken, "target").filter("base != source_id")
    return rows.select(F.col("base_module").alias("module"), F.col("base_procedure").alias("procedure"), "source_id", "ext_procedure", "directive")


def enclosing(points: DataFrame, ranges: DataFrame, group: str, at: str, start: str, stop: str, key: str, width: int = 64) -> DataFrame:
    """Each point with the range of its group that holds it and starts last (ties: the least ``key``); nulls where none does.

    Ranges are dealt over the stretches of ``width`` that they touch, so a point meets only those near it. Each
    distinct place is looked up once and joined back, so equal points stay apart and none vanishes.
    """
    cell = lambda c: F.floor(c / width)
    asked = points.select(group, F.col(at).alias("__at")).distinct().withColumn("__cell", cell(F.col("__at")))
    rest = [c for c in ranges.columns if c != group]
    near = ranges.filter(F.col(start) <= F.col(stop)).withColumn("__cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(stop)))))
    near = near.select(group, "__cell", F.struct(*rest).alias("__r"))
    inside = asked.join(near, [group, "__cell"]).filter((F.col("__at") >= F.col(f"__r.{start}")) & (F.col("__at") <= F.col(f"__r.{stop}")))
    best = inside.groupBy(group, "__at").agg(F.min_by("__r", F.struct(-F.col(f"__r.{start}"), F.col(f"__r.{key}"))).alias("__r"))
    return points.withColumn("__at", F.col(at)).join(best, [group, "__at"], "left").select(*points.columns, *[F.col(f"__r.{c}").alias(c) for c in rest])
