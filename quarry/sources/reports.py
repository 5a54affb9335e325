"""Reports as text: CSV for spreadsheets, Markdown, graphs as JSON lines, trees, cards and pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _field(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[;"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame) -> DataFrame:
    """``line``: the header after a byte order mark, then a line for each row; fields are parted by semicolons."""
    header = rows.sparkSession.range(1, numPartitions=1).select(F.lit("﻿" + ";".join(rows.columns)).alias("line"))
    return header.unionByName(rows.select(F.concat_ws(";", *[_field(F.col(f"`{c}`")) for c in rows.columns]).alias("line")))


def write_csv(rows: DataFrame, path: str) -> None:
    """Write ``csv_lines``; the files' contents in order of their names are the report."""
    csv_lines(rows).write.option("lineSep", "\r\n").text(path)


def markdown_lines(rows: DataFrame, title: str, note: str = "") -> DataFrame:
    """``line``: a heading, a note, and a table whose cells have their bars escaped and their lines joined."""
    spark = rows.sparkSession
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", " ")
    head = [f"# {title}", "", *([note, ""] if note else []), f"| {' | '.join(rows.columns)} |", f"|{' --- |' * len(rows.columns)}"]
    first = spark.createDataFrame([(x,) for x in head], "line string").coalesce(1)
    return first.unionByName(rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |")).alias("line")))


def diff_report(changes: DataFrame) -> DataFrame:
    """change, object, module, part, name, was, now: the rows of ``snapshots.changes`` in the order of a report."""
    rank = F.array_position(F.array(*map(F.lit, ("object", "synonym", "attribute", "form", "module", "procedure"))), F.col("part"))
    return changes.orderBy("object", F.coalesce("module", F.lit("")), rank, "name").select("change", "object", "module", "part", "name", "was", "now")


def conflict_report(conflicts: DataFrame) -> DataFrame:
    """kind, object, target, note, advice: the rows of ``snapshots.by_severity``."""
    return conflicts.orderBy("rank", "target", "note").select("kind", "object", "target", "note", "advice")


def tree_text(tree: DataFrame) -> str:
    """A call tree as indented lines. The tree is bounded by its number of nodes, so it is collected."""
    rows = tree.orderBy("pos").collect()
    lines = []
    for r in rows:
        marks = [f"line {r.line}"] if r.line is not None else []
        marks += [r.confidence] if r.confidence not in (None, "exact") else []
        lines.append("  " * r.depth + r.name + (f" ({', '.join(marks)})" if marks else ""))
    if rows and rows[0].truncated:
        lines.append("... more nodes than shown")
    return "\n".join(lines)


def page_text(rows: DataFrame, columns: list[str], limit: int, offset: int = 0, cap: int = 500) -> str:
    """One page of an ordered result as numbered lines, and where the next one begins. One row more than the page is read,
    which tells whether there is one; a limit beyond ``cap`` is cut, and the text says so."""
    asked, limit = limit, min(limit, cap)
    found = rows.select(*columns).offset(offset).limit(limit + 1).collect()  # a page and one row
    lines = [f"{offset + i + 1}. " + " | ".join("" if v is None else str(v) for v in r) for i, r in enumerate(found[:limit])]
    lines += [f"Next page: offset={offset + limit}"] if len(found) > limit else []
    lines += [f"At most {cap} rows are shown at a time"] if asked > cap else []
    return "\n".join(lines) if lines else "Nothing found"


def object_text(page: DataFrame) -> str:
    """The page of one object as text: the first row of ``objects.pages``."""
    row = page.limit(1).collect()
    if not row:
        return "No such object"
    r = row[0].asDict(recursive=True)
    lines = [r["object"] + (f" - {r['synonym']}" if r.get("synonym") else "")]
    lines += [f"  {a['attribute']}: {a['type_desc']}" for a in r.get("attributes") or []]
    rest = (r.get("n_attributes") or 0) - len(r.get("attributes") or [])
    lines += [f"  ... {rest} more attributes"] if rest > 0 else []
    for s in r.get("sections") or []:
        lines.append(f"  {s['section']}")
        lines += [f"    {a['attribute']}: {a['type_desc']}" for a in s["attributes"]]
    for name in ("values", "forms", "recorded_by", "content", "children", "other_sources"):
        lines += [f"{name}: {', '.join(r[name])}"] if r.get(name) else []
    return "\n".join(lines)


def broken_text(broken: DataFrame, problem: str, limit: int = 50) -> str:
    """The broken calls of one problem as lines, with where else the procedure is."""
    rows = broken.filter(F.col("problem") == problem).orderBy("module", "source_id", "line", "callee").limit(limit + 1).collect()
    lines = []
    for r in rows[:limit]:
        where = f"; defined in {', '.join(d['module'] for d in r.defined_in)}" if r.defined_in else ""
        lines.append(f"{r.module}.{r.caller}, line {r.line}: {r.callee_module}.{r.callee}{where}")
    return "\n".join(lines + (["..."] if len(rows) > limit else []))


def help_text(entry: dict, mode: str = "", warning: str = "", full: bool = True) -> str:
    """An entry of the help as text; a brief one has its description cut at 400 characters."""
    name = entry["name_ru"] + (f" ({entry['name_en']})" if entry.get("name_en") else "")
    lines = [f"{entry['owner_ru']}.{name}" if entry.get("owner_ru") else name]
    for v in entry.get("variants") or []:
        lines.append((f"{v['title']}: " if v["title"] else "") + v["syntax"])
        lines += [f"  {p['name']}{'' if p['required'] is not False else ' (optional)'}: {', '.join(p['types'])}" for p in v["params"]]
    lines += [f"{k}: {entry[k]}" for k in ("returns_types", "value_type", "availability", "since", "compat") if entry.get(k)]
    lines += [warning] if warning else []
    text = entry.get("description") or ""
    lines += [text if full or len(text) <= 400 else text[:400].rstrip() + "..."] if text else []
    return "\n".join(lines)


def graph_json(nodes: DataFrame, edges: DataFrame, legend: dict[str, str] | None = None) -> DataFrame:
    """``json``: an object for each node and edge, with its columns and ``part``: node or edge; then the legend's, if any."""
    spark = nodes.sparkSession
    as_json = lambda frame, part: frame.select(F.to_json(F.struct(F.lit(part).alias("part"), *frame.columns)).alias("json"))
    out = as_json(nodes, "node").unionByName(as_json(edges, "edge"))
    return out.unionByName(as_json(spark.createDataFrame(sorted(legend.items()), "name string, meaning string"), "legend")) if legend else out
