"""From dumps to the tables of an index: one pass over metadata, two over module texts, then calls and cards.

Each table is written once below a snapshot's folder and read back, so that later steps share it; the snapshot is
published when all are there. Every table has source_id.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import call_sites, source_code
from quarry.operators import cards, graph, lifecycle
from quarry.sources import dump, modules

#: Rounds of code that make the tables; a change of one asks for a new index.
PARSER = lifecycle.fingerprint(source_code, call_sites, dump)
RESOLVER = lifecycle.fingerprint(graph)


class Source(NamedTuple):
    source_id: str
    label: str
    source_type: str
    path: str


class _Writer:
    """Writes tables below a folder and reads them back."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.tables = spark, folder, {}

    def put(self, name: str, frame: DataFrame) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self.tables[name] = self.spark.read.parquet(f"{self.folder}/{name}")
        return self.tables[name]


def _each(sources: list[Source], f) -> DataFrame:
    return reduce(DataFrame.unionByName, [f(s).withColumn("source_id", F.lit(s.source_id)) for s in sources])


def metadata(spark: SparkSession, sources: list[Source], out: _Writer) -> None:
    """objects, attributes, forms, properties, content, queries, helps, form_files, form_events of all dumps with a configuration."""
    files = out.put("files", _each(sources, lambda s: dump.parsed(spark, s.path)))
    of = lambda read: _each(sources, lambda s: read(files.filter(F.col("source_id") == s.source_id).drop("source_id")))
    known = out.put("objects", of(dump.objects))
    out.put("attributes", of(dump.attributes))
    out.put("forms", of(dump.forms))
    out.put("properties", of(dump.properties))
    out.put("content", of(dump.subsystem_content))
    out.put("queries", of(dump.report_queries))
    out.put("form_files", of(dump.form_attributes))
    out.put("form_events", of(dump.form_events))
    out.put("helps", known.filter("help != ''").select("object", "source_id", F.col("help").alias("text")))


def module_table(spark: SparkSession, sources: list[Source], out: _Writer) -> DataFrame:
    """modules: source_id, module, module_type, relative_path, form_path, file_hash, text, is_global, attributes (of its form)."""
    rows = _each(sources, lambda s: modules.module_files(spark, s.path)).withColumnRenamed("full_name", "module")
    flags = out.tables["properties"].filter("key = 'Global' and value = 'true'").select("source_id", F.concat("object", F.lit(".Модуль")).alias("module"), F.lit(True).alias("is_global"))
    forms = out.tables["form_files"].groupBy("source_id", F.concat("owner", F.lit("/Ext/Form.xml")).alias("form_xml_path")).agg(F.collect_set("attribute").alias("attributes"))
    rows = rows.join(flags, ["source_id", "module"], "left").join(forms, ["source_id", "form_xml_path"], "left")
    none = F.array().cast("array<string>")
    return out.put("modules", rows.select("source_id", "module", "module_type", "relative_path", "form_xml_path", "file_size", "mtime", "file_hash", "text", F.coalesce("is_global", F.lit(False)).alias("is_global"), F.coalesce("attributes", none).alias("attributes")))


def code(out: _Writer) -> None:
    """procedures, calls of all modules: outlines, factories (the first round over texts), call sites (the second)."""
    spark, rows = out.spark, out.tables["modules"]
    keyed = rows.withColumn("key", F.concat_ws("\0", "source_id", "module"))
    found = source_code.procedures_of(keyed, "key", "text").withColumnRenamed("name", "procedure")
    both = lambda f: f.withColumn("source_id", F.split("key", "\0")[0]).withColumn("module", F.split("key", "\0")[1]).drop("key")
    signature = F.concat(F.initcap("kind"), F.lit(" "), "procedure", F.lit("("), "params", F.lit(")"), F.when(F.col("is_export"), " Export").otherwise(""))
    # A key of its values, the same whenever the module is read again.
    proc_id = F.xxhash64("source_id", F.lower("module"), F.lower("procedure"), "start_line")
    body = F.array_join(F.slice(F.split("text", "\r?\n", -1), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    procedures = both(found).join(rows.select("source_id", "module", "text"), ["source_id", "module"])
    procedures = procedures.withColumn("signature", signature).withColumn("proc_id", proc_id).withColumn("content_hash", F.sha2(body, 256)).drop("text")
    out.put("procedures", procedures)
    factories = out.put("factories", call_sites.factories_of(rows))
    common = rows.filter(F.lower("module").startswith(graph.COMMON_MODULE[0])).select(F.split("module", r"\.")[1].alias("module"))
    known = call_sites.known_names(common, out.tables["objects"].select("kind", "name"), factories)
    sites = call_sites.call_sites_of(rows, known)
    owners = out.tables["procedures"].select("source_id", "module", F.col("procedure").alias("caller"), "proc_id", "start_line", "end_line")
    # Of several procedures with one name the call belongs to that whose lines hold it.
    inside = sites.join(owners, ["source_id", "module", "caller"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    # In the order of a module's text.
    call_id = F.concat_ws(":", F.hex(F.xxhash64("source_id", "module")), F.lpad(F.col("place").cast("string"), 9, "0"))
    out.put("calls", inside.withColumn("call_id", call_id).drop("place", "start_line", "end_line"))


def build(spark: SparkSession, sources: list[Source], root: str, name: str, publish: bool = True) -> dict[str, DataFrame]:
    """The tables of an index of ``sources``, written below root/name and published."""
    out = _Writer(spark, f"{root}/{name}")
    out.put("sources", spark.createDataFrame([s[:3] for s in sources], "source_id string, label string, source_type string").withColumn("indexed_at", F.current_timestamp()))
    metadata(spark, sources, out)
    module_table(spark, sources, out)
    code(out)
    t = out.tables
    out.put("resolved", graph.resolve_calls(t["calls"], t["procedures"], t["modules"], t["sources"], platform_methods(spark)))
    out.put("cards", cards.cards(t["procedures"], t["modules"], t["objects"]))
    out.put("card_postings", cards.index(t["cards"]).select("chunk.*", "field", "token", "tf").repartitionByRange(16, "token").sortWithinPartitions("token"))
    out.put("state", spark.createDataFrame([(PARSER, RESOLVER, cards.CARD_FORMAT)], "parser string, resolver string, card_format int"))
    if publish:
        lifecycle.publish(spark, root, name)
    return t


def platform_methods(spark: SparkSession) -> DataFrame:
    """kind, method: methods that managers of every kind have by themselves."""
    kinds = sorted(set(call_sites.MANAGERS.values()))
    return spark.createDataFrame([(k, m) for k in kinds for m in sorted(call_sites.MANAGER_METHODS)], "kind string, method string")


def opened(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the published snapshot."""
    name = lifecycle.current(spark, root)
    if name is None:
        raise FileNotFoundError(f"no index below {root}")
    tables = ("sources", "files", "objects", "attributes", "forms", "properties", "content", "queries", "form_files", "form_events", "helps", "modules", "procedures", "factories", "calls", "resolved", "cards", "card_postings", "state")
    return {t: spark.read.parquet(f"{root}/{name}/{t}") for t in tables}


def is_current(tables: dict[str, DataFrame], sources: list[Source]) -> bool:
    """Whether a new index would be the same: made by this code, of files with the contents that are there now."""
    state = tables["state"].first()
    if state.parser != PARSER or state.resolver != RESOLVER or state.card_format != cards.CARD_FORMAT:
        return False
    spark = tables["modules"].sparkSession
    now = _each(sources, lambda s: modules.module_files(spark, s.path)).select("source_id", "relative_path", "file_hash")
    before = tables["modules"].select("source_id", "relative_path", "file_hash")
    return now.exceptAll(before).limit(1).count() == 0 and before.exceptAll(now).limit(1).count() == 0
