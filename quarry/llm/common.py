"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a regex class body and as bytes.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = f"[^{SPACE_CLASS}]+"

#: A side is broadcast explicitly only below this measured size; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: The same for tables of keys of two columns, whose rows take more.
KEY_ROWS = 200_000

_RUN = 128

#: Bytes of one Arrow batch that goes to a Python worker; a row larger than that goes by itself.
BATCH_BYTES = 4 << 20

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset (tests) a temporary one."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, so that a lost executor costs a reread and not the whole history, and lets several
    consumers share one computation. The folder goes with ``discard``, or when the Spark driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    system, target = _folder(spark, path)
    system.deleteOnExit(target)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` whose consumers are all written themselves."""
    for found in tables:
        system, target = _folder(found.sparkSession, found._written_to)
        system.delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session's Python operators by bytes, so that long texts don't add up in a worker.

    A smaller bound that is set already stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that only those become Python objects at a time; empty ones as they are."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def running_starts(lengths: Column) -> Column:
    """For an array of lengths, the sums of those before each one.

    Appending to an array copies it, so sums run within groups of _RUN, and over the groups.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def sums(values: Column, first: Column) -> Column:
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found"))
        return F.aggregate(values, F.struct(first.alias("at"), none.alias("found")), step)["found"]

    def over(values: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _RUN).cast("int")), lambda g: F.slice(values, g * _RUN + 1, F.lit(_RUN)))
        return let(groups, lambda g: let(sums(F.transform(g, lambda x: F.aggregate(x, zero, lambda a, b: a + b)), zero), lambda firsts: F.flatten(F.transform(g, lambda x, i: sums(x, F.get(firsts, i))))))

    return F.when(F.size(lengths) == 0, none).otherwise(let(lengths.cast("array<bigint>"), over))


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of a value as text, modulo ``modulus``; the held-out folds of the contracts."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns that hash all of a row's values (maps and variants left out), and their names.

    Rows with equal keys, 128 bits together, are equal. So rows are known without numbering them, which would need the
    whole table written, and nothing hangs on files or partitions.
    """
    names = [unused_name(n, docs.columns) for n in ("key1", "key2")]
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return docs.withColumns({n: F.xxhash64(F.lit(i), *plain) for i, n in enumerate(names)}), names


def one_each(rows: DataFrame, keys: list[str], dropped: DataFrame | None, again: DataFrame) -> DataFrame:
    """``rows`` (``keyed``) without those whose keys are in ``dropped``, and one row only of each key in ``again``.

    Both are written tables of keys. They are broadcast only after their rows have been counted; longer ones shuffle.
    """
    if dropped is not None:
        rows = rows.join(bounded(dropped, KEY_ROWS), keys, "left_anti")
    if again.limit(1).count():
        again = bounded(again, KEY_ROWS)
        rows = rows.join(again, keys, "left_anti").unionByName(rows.join(again, keys, "left_semi").dropDuplicates(keys))
    return rows


def bounded(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of ids, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused_name(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores before it as make it differ from all of ``taken``."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name
