"""The life of an index: what to read again, what to carry over, what to delete, and when the call graph is stale.

A state is an ordinary table that is written as a new snapshot; nothing is changed in place.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def fingerprint(*parts: ModuleType | Callable | str) -> str:
    """A digest of the code that makes a table; a table made by other code must be made again."""
    text = "\0".join(p if isinstance(p, str) else inspect.getsource(p) for p in parts)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def plan_files(stored: DataFrame, now: DataFrame, parser: str, key: str = "relative_path") -> DataFrame:
    """key, action of every file: read (new, changed, or read by another parser), keep, touch (same content, new time), delete.

    ``stored``: key, file_size, mtime, file_hash, parser. ``now``: key, file_size, mtime, file_hash. The hash is looked
    at only where size or time differ, so a caller may leave it null for files whose stat is unchanged.
    """
    a = stored.select(key, F.struct("file_size", "mtime").alias("stat0"), F.col("file_hash").alias("hash0"), F.col("parser").alias("parser0"))
    b = now.select(key, F.struct("file_size", "mtime").alias("stat1"), F.col("file_hash").alias("hash1"))
    action = (
        F.when(F.col("stat0").isNull(), "read")
        .when(F.col("stat1").isNull(), "delete")
        .when(F.col("parser0") != parser, "read")
        .when(F.col("stat0") == F.col("stat1"), "keep")
        .when(F.col("hash0").eqNullSafe(F.col("hash1")), "touch")
        .otherwise("read")
    )
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def digest(*columns: str) -> Column:
    """A digest of a row's values, nested ones too: equal digests need no new rows for its children."""
    return F.sha1(F.to_json(F.struct(*columns)))


def changed_keys(stored: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """key of the rows of ``now`` that are new or whose digest differs (both have the column digest)."""
    return now.join(stored, [*key, "digest"], "left_anti").select(*key)


def replace(stored: Tables, fresh: Tables, read: DataFrame, gone: DataFrame, key: str) -> Tables:
    """The tables after the rows of ``read`` keys are replaced by ``fresh`` ones and those of ``gone`` keys are deleted.

    All tables carry ``key``, so children go with their parent, without a cascade of deletes.
    """
    leaving = read.select(key).unionByName(gone.select(key)).distinct()
    return {name: table.join(leaving, key, "left_anti").unionByName(fresh[name]) if name in fresh else table.join(leaving, key, "left_anti") for name, table in stored.items()}


def write_tables(tables: Tables, folder: str) -> None:
    """Write all tables of a snapshot below a folder of its own; ``current`` tells readers of it only when all are there."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def publish(spark: SparkSession, root: str, snapshot: str) -> None:
    """Make ``snapshot`` the one that ``current`` returns, by renaming one small file."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path(root))
    new, named = path(f"{root}/CURRENT.new"), path(f"{root}/CURRENT")
    out = system.create(new, True)
    out.write(bytearray(snapshot, "utf-8"))
    out.close()
    system.delete(named, False)
    system.rename(new, named)


def current(spark: SparkSession, root: str) -> str | None:
    """The name of the published snapshot, or null."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(f"{root}/CURRENT", wholetext=True).first()[0]


def seeded(base: Tables, now: DataFrame, key: str = "relative_path") -> Tables:
    """A first index out of another project's: the rows of its tables whose files have the same content here.

    ``base`` has a table ``files`` with key and file_hash, and its other tables carry ``key``.
    """
    same = base["files"].join(now.select(key, "file_hash").distinct(), [key, "file_hash"], "left_semi").select(key).distinct()
    return {name: table.join(same, key, "left_semi") for name, table in base.items()}


def backfill(table: DataFrame | None, files: DataFrame, build: Callable[[DataFrame], DataFrame], key: str = "relative_path") -> DataFrame:
    """A table that was added later: built for the files (key and content) that have no row in it, kept for the others."""
    if table is None:
        return build(files)
    return table.unionByName(build(files.join(table.select(key).distinct(), key, "left_anti")))


def graph_stale(state: DataFrame, resolver: str, changed: DataFrame) -> bool:
    """Whether calls must be resolved again: never done, by another resolver, marked dirty, or files have changed.

    ``state``: at most one row of resolver, dirty. ``changed``: keys of files that were read or deleted.
    """
    row = state.limit(1).collect()
    return not row or row[0].resolver != resolver or bool(row[0].dirty) or changed.limit(1).count() > 0


def graph_state(spark: SparkSession, resolver: str, dirty: bool = False) -> DataFrame:
    return spark.createDataFrame([(resolver, dirty)], "resolver string, dirty boolean")


def source_counts(tables: Tables, source_id: str) -> DataFrame:
    """One row: how many rows each table has under a source, which is what removing it would delete."""
    counts = [t.filter(F.col("source_id") == source_id).agg(F.count(F.lit(1)).alias(name)) for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # one row each
    return out


def without_source(tables: Tables, source_id: str) -> Tables:
    return {name: t.filter(F.col("source_id") != source_id) for name, t in tables.items()}


def cached(spark: SparkSession, root: str, name: str, states: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, written once for the given states of what it reads and read back from then on."""
    path = f"{root}/cache/{name}-{hashlib.sha256(chr(0).join(states).encode()).hexdigest()[:32]}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def replace_partition(table: DataFrame, path: str, by: str = "source_id") -> None:
    """Write a table by partition so that only the partitions it holds are replaced."""
    table.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def readiness(sources: DataFrame, modules: DataFrame, procedures: DataFrame, card_modules: DataFrame, parsers: DataFrame, parser: str, card_format: int) -> DataFrame:
    """A row for each source: source_id, label, indexed_at, modules, parser_current, with_code, cards_current, issues.

    ``card_modules``: source_id, module, card_format. ``parsers``: source_id, parser. Modules with procedures count as
    with code; issues are what keeps the source from being ready.
    """
    key = ["source_id", "module"]
    counted = modules.groupBy("source_id").agg(F.count(F.lit(1)).alias("modules"))
    coded = modules.join(procedures.select(*key).distinct(), key, "left_semi").join(card_modules, key, "left")
    cards = coded.groupBy("source_id").agg(F.count(F.lit(1)).alias("with_code"), F.sum(F.when(F.col("card_format") == card_format, 1).otherwise(0)).alias("cards_current"))
    rows = sources.join(counted, "source_id", "left").join(cards, "source_id", "left").join(parsers, "source_id", "left").fillna(0, ["modules", "with_code", "cards_current"])
    rows = rows.withColumn("parser_current", F.coalesce(F.col("parser") == parser, F.lit(False)))
    never = F.coalesce(F.col("indexed_at").cast("string"), F.lit("")) == ""
    issues = F.array_compact(F.array(F.when(never, "not indexed"), F.when(~never & ~F.col("parser_current"), "read by another parser"), F.when(~never & (F.col("cards_current") < F.col("with_code")), "cards are missing")))
    return rows.select("source_id", "label", "indexed_at", "modules", "parser_current", "with_code", "cards_current", issues.alias("issues"))


def manifest(ready: DataFrame, counts: DataFrame) -> DataFrame:
    """``json``: one object of the whole index: its sources, their issues, and whether all are ready. ``counts``: one row."""
    sources = ready.agg(F.array_sort(F.collect_list(F.struct(*ready.columns))).alias("sources"), (F.sum(F.size("issues")) == 0).alias("ready"))
    return sources.crossJoin(counts).select(F.to_json(F.struct("ready", "sources", *counts.columns)).alias("json"))  # one row each
