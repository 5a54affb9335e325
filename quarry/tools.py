"""The questions that can be asked of an index, each by name: the operators put together.

An ``Index`` holds the tables of ``ingest.opened`` or ``ingest.build``, a glossary and, where there is one, the help. Pages
are ordered; limits beyond CAP are cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import platform_calls
from quarry.functions.terms import query_terms
from quarry.operators import cards, checks, diff, glossary, graph, lifecycle, metadata_search, metrics, objects, platform, search, snapshots
from quarry.sources import dump, help as books, modules

CAP = 500
KINDS = {en.lower(): ru for en, ru in dump.RUSSIAN.items()}


@dataclass
class Index:
    tables: dict[str, DataFrame]
    entries: DataFrame | None = None
    terms: DataFrame | None = None
    mode: str = ""

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def _page(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    return search.page(rows, min(limit, CAP), offset)


def _of_source(rows: DataFrame, source_id: str | None) -> DataFrame:
    return rows.filter(F.col("source_id") == source_id) if source_id else rows


def _targets(index: Index, query: str, kinds: list[str]) -> list[str]:
    """Targets of the glossary's entries for a query, the best first; a page of them."""
    return [r.target for r in glossary.matches(index.terms, query, kinds).limit(CAP).collect()] if index.terms is not None else []


# -- state ----------------------------------------------------------------------------------------------------------------


def list_sources(index: Index) -> DataFrame:
    return index["sources"].orderBy("source_id")


def get_index_status(index: Index) -> DataFrame:
    """One row: the numbers of objects, modules, procedures and calls."""
    counts = [index[t].agg(F.count(F.lit(1)).alias(t)) for t in ("objects", "modules", "procedures", "calls")]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(counts[3])  # one row each


def remove_source(index: Index, source_id: str, confirm: bool = False) -> DataFrame | Index:
    """What would go with a source; with ``confirm`` the index without it."""
    held = {n: t for n, t in index.tables.items() if "source_id" in t.columns}
    if not confirm:
        return lifecycle.source_counts({n: held[n] for n in ("objects", "attributes", "forms", "modules", "procedures", "calls")}, source_id)
    return Index(index.tables | lifecycle.without_source(held, source_id), index.entries, index.terms, index.mode)


# -- glossary -------------------------------------------------------------------------------------------------------------


def add_glossary_term(index: Index, changes: DataFrame, merge: bool = True) -> tuple[DataFrame, DataFrame]:
    """The glossary after ``changes`` whose targets are in the index, by the names they have there; and those that are not."""
    attributes = index["attributes"]
    found = glossary.resolve_targets(changes, index["objects"], index["procedures"], attributes)
    known = changes.drop("target_kind").join(found, "target").drop("target").withColumnRenamed("full_name", "target")
    return glossary.save(index.terms, known.select(*glossary.COLUMNS[1:]), merge), changes.join(found, "target", "left_anti")


def list_glossary(index: Index, query: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    return _page(glossary.matches(index.terms, query) if query else index.terms.orderBy("target"), limit, offset)


def remove_glossary_term(index: Index, entry_id: str) -> DataFrame:
    return glossary.remove(index.terms, [entry_id])


# -- objects --------------------------------------------------------------------------------------------------------------


def search_metadata(index: Index, query: str, kind: str | None = None, source_id: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    rows = _of_source(index["objects"], source_id)
    rows = search.of_kind(rows, "kind", kind, KINDS) if kind else rows
    return metadata_search.search_objects(rows, query, index["attributes"], index["helps"], _targets(index, query, ["object"]), min(limit, CAP), offset)


def search_attributes(index: Index, query: str, type_filter: str | None = None, source_id: str | None = None, limit: int = 30, offset: int = 0) -> DataFrame:
    forms = index["form_files"].select(F.col("owner").alias("form"), "source_id", "attribute", "title", "type_desc")
    wanted = [tuple(t.rsplit(".", 1)) for t in _targets(index, query, ["attribute"]) if "." in t]
    return metadata_search.search_attributes(index["objects"], _of_source(index["attributes"], source_id), query, _of_source(forms, source_id), wanted, type_filter, min(limit, CAP), offset)


def get_object_details(index: Index, full_name: str, detail: str = "brief") -> DataFrame:
    """The page of an object, with its standard attributes, hints for queries, and the glossary's entries."""
    mine = lambda t: index[t].filter(F.lower("object") == full_name.strip().lower())
    rows = objects.pages(index["objects"], index["attributes"], index["forms"], index["properties"], index["content"], detail == "brief").filter(F.lower("object") == full_name.strip().lower())
    resources = mine("attributes").filter("kind = 'Ресурс'").groupBy("object").agg(F.array_sort(F.collect_set("attribute")).alias("resources"))
    rows = rows.join(resources, "object", "left").withColumn("resources", F.coalesce("resources", F.array().cast("array<string>")))
    rows = objects.query_hints(objects.standard_attributes(rows))
    return rows.join(glossary.entries_of(index.terms, index["objects"]), "object", "left") if index.terms is not None else rows


def find_references(index: Index, object_name: str, source_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    return objects.find_references(_of_source(index["attributes"], source_id), object_name, min(limit, CAP), offset)


def knowledge_sources(index: Index, kind: str | None = None, include_query: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """Reports with their queries and what these read, or registers with the reports that read them."""
    named = search.canonical_kind(kind or "Report", KINDS)
    if named == KINDS["report"]:
        return _page(objects.report_sources(index["queries"], index["objects"], include_query).orderBy("report"), limit, offset)
    return _page(objects.used_by(index["queries"], index["objects"], (named,)).orderBy("object"), limit, offset)


def list_objects(index: Index, kind: str | None = None, source_id: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = _of_source(index["objects"], source_id)
    return _page((search.of_kind(rows, "kind", kind, KINDS) if kind else rows).orderBy("object", "source_id"), limit, offset)


# -- code -----------------------------------------------------------------------------------------------------------------


def modules_named(index: Index, name: str, source_id: str | None = None) -> DataFrame:
    """The modules that a name means best: the full name, a common module's short one, a word of it, a part of it."""
    low, module = name.strip().lower(), F.lower("module")
    words = F.split(module, r"\.")
    rows = _of_source(index["modules"], source_id)
    return search.best_tier(rows, [module == low, module == f"{graph.COMMON_MODULE[0]}{low}{graph.COMMON_MODULE[1]}", F.array_contains(words, low), module.contains(low)]).orderBy(F.length("module"), "module", "source_id")


def _procedures_in(index: Index, module_name: str | None, source_id: str | None = None) -> DataFrame:
    if not module_name:
        return _of_source(index["procedures"], source_id)
    return index["procedures"].join(modules_named(index, module_name, source_id).select("source_id", "module"), ["source_id", "module"], "left_semi")


def search_procedures(index: Index, query: str, module_filter: str | None = None, export_only: bool = False, source_id: str | None = None, limit: int = 30, offset: int = 0) -> DataFrame:
    rows = _of_source(index["procedures"], source_id)
    rows = rows.filter(F.lower("module").contains(module_filter.lower())) if module_filter else rows
    rows = rows.filter("is_export") if export_only else rows
    return _page(search.exact_first(rows, "procedure", query, "module", "source_id", "start_line"), limit, offset)


def get_procedure_code(index: Index, module_name: str, procedure_name: str) -> DataFrame:
    """source_id, module, procedure, start_line, end_line, code."""
    rows = _procedures_in(index, module_name).filter(F.lower("procedure") == procedure_name.strip().lower())
    rows = rows.join(index["modules"].select("source_id", "module", "text"), ["source_id", "module"])
    body = F.array_join(F.slice(F.split("text", "\r?\n", -1), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return rows.select("source_id", "module", "procedure", "start_line", "end_line", body.alias("code"))


def get_procedure_context(index: Index, module_name: str, procedure_name: str) -> DataFrame:
    """side (caller, callee, unresolved), name, sites, first_line; the region and the comment come with ``get_module_outline``."""
    mine = _procedures_in(index, module_name).filter(F.lower("procedure") == procedure_name.strip().lower()).select("proc_id")
    named = index["procedures"].select("proc_id", F.concat_ws(".", "module", "procedure").alias("name"))
    resolved = index["resolved"]
    figures = [F.count(F.lit(1)).alias("sites"), F.min("line").alias("first_line")]
    to_me = resolved.join(mine.withColumnRenamed("proc_id", "target"), "target", "left_semi").join(named, "proc_id").groupBy(F.lit("caller").alias("side"), "name").agg(*figures)
    from_me = resolved.join(mine, "proc_id", "left_semi")
    done = from_me.filter("target is not null").join(named.withColumnRenamed("proc_id", "target"), "target").groupBy(F.lit("callee").alias("side"), "name").agg(*figures)
    text = F.when(F.col("callee_module") != "", F.concat_ws(".", "callee_module", "callee")).otherwise(F.col("callee"))
    left = from_me.filter("target is null").groupBy(F.lit("unresolved").alias("side"), text.alias("name")).agg(*figures)
    return to_me.unionByName(done).unionByName(left).orderBy("side", "first_line", "name")


def get_module_outline(index: Index, module_name: str) -> DataFrame:
    return _procedures_in(index, module_name).select("source_id", "module", "procedure", "kind", "is_export", "params", "directive", "start_line", "end_line", "region", "comment").orderBy("source_id", "module", "start_line")


def get_call_tree(index: Index, procedure_name: str, module_name: str | None = None, direction: str = "down", depth: int = 3, max_nodes: int = 200) -> DataFrame:
    roots = _procedures_in(index, module_name).filter(F.lower("procedure") == procedure_name.strip().lower())
    lines = graph.callees(index["resolved"]) if direction == "down" else graph.callers(index["resolved"], index["procedures"])
    return graph.call_tree(lines.persist(), index["procedures"], roots, depth, max_nodes)


def search_code(index: Index, query: str, file_pattern: str | None = None, limit: int = 30, per_module: int = 5, candidates: int = 50) -> DataFrame:
    """Lines of modules with the query, with their neighbours. Modules with all words come first, at most ``candidates`` of
    them by name; a query without words of an index is looked for in all modules."""
    rows = index["modules"].filter(F.lower("relative_path").contains(file_pattern.lower())) if file_pattern else index["modules"]
    words = [w for w in query_terms(query) if len(w) > 1]
    near = rows.filter(search.contains_all(F.col("text"), words)).orderBy("module", "source_id").limit(candidates) if words else rows
    keyed = near.withColumn("key", F.struct("source_id", "module"))
    return _page(search.matching_lines(keyed, "key", "text", query, per_module).select("key.*", "line", "context", "capped").orderBy("module", "source_id", "line"), limit, 0)


def semantic_search_code(index: Index, query: str, source_id: str | None = None, limit: int = 10) -> DataFrame:
    """Cards of procedures by rank, with the line that shows why: stems and roots of the query, without common terms."""
    post = index["card_postings"].withColumn("chunk", F.struct("proc_id", "chunk_no")).drop("proc_id", "chunk_no")
    procedures = _of_source(index["procedures"], source_id)
    chunks = index["cards"]
    vocab = search.vocabulary(post, "chunk")
    terms = cards.rare_terms(vocab, chunks.count(), query_terms(query))
    if not terms:
        return chunks.limit(0)
    wanted = index["procedures"].select(F.concat_ws(".", "module", "procedure").alias("name"), "proc_id")
    named = _targets(index, query, ["procedure"])
    given = [r.proc_id for r in wanted.filter(F.col("name").isin(named)).collect()] if named else None  # a page at most
    found = cards.search_cards(post, chunks, procedures, cards.callers_of(index["resolved"]), query, terms, given, min(limit, 50))
    shown = chunks.select("proc_id", "chunk_no", "body", "start_line", "end_line", "content_hash")
    rows = found.join(shown, ["proc_id", "chunk_no"], "left").join(index["procedures"].select("proc_id", "source_id", "module", "procedure"), "proc_id")
    return rows.select("rank", "source_id", "module", "procedure", "start_line", "end_line", "score", "match", cards.snippet(F.col("body"), terms).alias("snippet"), "content_hash").orderBy("rank")


def procedure_key(source_id, module, procedure):
    """A stable id of a procedure, which survives a new index."""
    return F.concat(F.lit("proc:"), F.substring(F.sha1(F.concat_ws("\0", source_id, F.lower(module), F.lower(procedure))), 1, 16))


# -- comparisons ----------------------------------------------------------------------------------------------------------


def snapshot_of(index: Index, source_id: str) -> snapshots.Snapshot:
    t = {n: _of_source(index[n], source_id) for n in ("objects", "attributes", "forms", "modules", "procedures")}
    return {
        "objects": t["objects"].select("object", "kind", "synonym"), "attributes": t["attributes"].select("object", "attribute", "type_desc"), "forms": t["forms"].select("object", "form"),
        "modules": t["modules"].select("module", "file_hash"), "procedures": t["procedures"].select("module", "procedure", "signature", "content_hash"),
    }


def diff_from_base(index: Index, base: Index, source_id: str = "main", base_source: str | None = None) -> DataFrame:
    return snapshots.changes(snapshot_of(base, base_source or source_id), snapshot_of(index, source_id))


def diff_procedure(index: Index, base: Index, module_name: str, procedure_name: str) -> DataFrame:
    """module, procedure, status, diff of a procedure's text between the base and now."""
    was, now = (get_procedure_code(i, module_name, procedure_name).select("module", "procedure", F.col("code").alias(n)) for i, n in ((base, "was"), (index, "now")))
    rows = was.join(now, ["module", "procedure"], "full_outer")
    return rows.select("module", "procedure", diff.text_status(F.col("was"), F.col("now")).alias("status"), diff.unified_diff("was", "now").alias("diff"))


def update_conflicts(index: Index, base: Index, release: Index, source_id: str = "main") -> DataFrame:
    """Where our changes, and what extensions intercept, meet those of a release; the gravest first."""
    ours, theirs = diff_from_base(index, base, source_id).persist(), diff_from_base(release, base, source_id).persist()
    taken = graph.intercepts(index["resolved"], index["procedures"])
    return snapshots.by_severity(snapshots.conflicts(ours, theirs, taken))


# -- checks ---------------------------------------------------------------------------------------------------------------


def find_broken_calls(index: Index, module_name: str | None = None, source_id: str | None = None) -> DataFrame:
    from quarry.ingest import platform_methods

    methods = platform_methods(index["sources"].sparkSession)
    names = index.entries.filter("kind = 'global_property'").select(F.explode(F.array("name_ru", "name_en")).alias("name")) if index.entries is not None else None
    found = checks.broken_calls(index["resolved"], index["procedures"], index["objects"], index["attributes"], methods, names, checks.evaluated_names(index["modules"]))
    found = _of_source(found, source_id)
    low = (module_name or "").strip().lower()
    return found.filter(F.lower("module").contains(low) | F.lower("callee_module").contains(low)) if low else found


def check_platform_calls(index: Index) -> DataFrame:
    sites = platform_calls.sites_of(index["modules"])
    return platform.check(sites, index.entries, index["procedures"], index["modules"], index["objects"], index.mode)


def platform_help(index: Index, query: str, kind: str | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """Entries with ``warning``, where the compatibility mode is too old for them."""
    least = checks.minimum_mode(F.col("since"), F.col("compat"))
    return books.find(index.entries, query, kind, min(limit, CAP), offset).withColumn("warning", checks.mode_warning(least, F.lit(index.mode)))


def diagnose_index(index: Index) -> dict[str, DataFrame]:
    """completeness, resolution, worst modules, unresolved names, and their causes."""
    rows = index["resolved"].filter("kind != 'manager_object' or target is not null")
    by_module = metrics.resolution(rows.withColumn("place", F.concat_ws(" ", "module", "source_id")), "place", "target")
    unresolved = rows.filter("target is null").groupBy("callee_module", "callee").agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "callee_module", "callee").limit(20)
    return {
        "completeness": checks.completeness(index["modules"].filter("text is not null"), index["procedures"]),
        "resolution": metrics.overall(rows, "call_id", "kind", "target", {"manager_object": "manager"}),
        "worst_modules": metrics.worst(by_module, "place", 5, 20),
        "unresolved": unresolved,
        "causes": checks.cause_shares(checks.unresolved_causes(index["resolved"], index["procedures"])),
        "interceptors": rows.filter("kind = 'override'").agg(F.countDistinct("proc_id").alias("procedures")),
    }


def stale(index: Index, sources: list) -> DataFrame:
    """relative_path, state of module files that changed since the index was made."""
    spark = index["modules"].sparkSession
    now = None
    for s in sources:
        rows = modules.module_files(spark, s.path).select(F.concat_ws(":", F.lit(s.source_id), "relative_path").alias("relative_path"), "file_hash")
        now = rows if now is None else now.unionByName(rows)
    stored = index["modules"].select(F.concat_ws(":", "source_id", "relative_path").alias("relative_path"), "file_hash")
    return checks.stale_files(stored, now)
