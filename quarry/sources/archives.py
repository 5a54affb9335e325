"""Dumps from archives, and small JSON files: glossaries, registries, evaluation sets."""

from __future__ import annotations

import os
import shutil
import stat
import tarfile
import tempfile
import zipfile
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILES, MAX_BYTES = 500_000, 20 << 30


class Refused(ValueError):
    """An archive that would write outside its folder, hold links, or unpack to too much."""


def _inside(name: str) -> PurePosixPath:
    path = PurePosixPath(name.replace("\\", "/"))
    if path.is_absolute() or ".." in path.parts or (path.parts and ":" in path.parts[0]):
        raise Refused(f"a path outside the archive: {name}")
    return path


def _members(archive: Path):
    """(path, size, open) of the files of a zip or tar archive; whatever is neither file nor folder is refused."""
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for info in z.infolist():
                kind = info.external_attr >> 16
                if kind and stat.S_ISLNK(kind):
                    raise Refused(f"a link: {info.filename}")
                if not info.is_dir():
                    yield _inside(info.filename), info.file_size, lambda i=info: z.open(i)
    elif tarfile.is_tarfile(archive):
        with tarfile.open(archive) as t:
            for member in t:
                if member.isfile():
                    yield _inside(member.name), member.size, lambda m=member: t.extractfile(m)
                elif not member.isdir():
                    raise Refused(f"neither file nor folder: {member.name}")
    else:
        raise Refused("neither zip nor tar")


def unpack(archive: str, target: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> int:
    """Unpack an archive as the folder ``target``, in place of what was there, and return the number of files.

    All is written beside the target first; the target changes only when everything is there, by renaming. Sizes are
    counted as they are written, whatever the archive says.
    """
    goal = Path(target)
    goal.parent.mkdir(parents=True, exist_ok=True)
    staging = Path(tempfile.mkdtemp(prefix=f".{goal.name}-", dir=goal.parent))
    n = written = 0
    try:
        for path, _, opened in _members(Path(archive)):
            n += 1
            if n > max_files:
                raise Refused(f"more than {max_files} files")
            out = staging.joinpath(*path.parts)
            out.parent.mkdir(parents=True, exist_ok=True)
            with opened() as source, out.open("wb") as sink:
                while block := source.read(1 << 20):
                    written += len(block)
                    if written > max_bytes:
                        raise Refused(f"more than {max_bytes} bytes")
                    sink.write(block)
        old = goal.with_name(f".{goal.name}-old")
        shutil.rmtree(old, ignore_errors=True)
        if goal.exists():
            os.rename(goal, old)
        os.rename(staging, goal)
        shutil.rmtree(old, ignore_errors=True)
        return n
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise


GLOSSARY = "id string, target string, target_kind string, terms array<string>, note string, author string, updated_at string"


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a glossary file: an array of objects, or an object with ``entries``. Lists that lack are empty."""
    rows = spark.read.schema(f"{GLOSSARY}, entries array<struct<{GLOSSARY.replace(', ', ',').replace(' ', ':')}>>").option("multiLine", True).json(path)
    flat = rows.filter("entries is null").drop("entries").unionByName(rows.select(F.inline("entries")))
    none = F.array().cast("array<string>")
    return flat.filter("target is not null").withColumn("terms", F.coalesce("terms", none)).fillna("", ["note", "author", "updated_at"])


def write_glossary(rows: DataFrame, path: str) -> None:
    """Write the entries as one JSON array, in the order of targets; a folder is renamed, so a reader never sees a half."""
    jvm = rows.sparkSession.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    system = fs_path(path).getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration())
    ordered = F.array_sort(F.collect_list(F.struct("target", *[c for c in rows.columns if c != "target"])))
    rows.agg(F.to_json(ordered)).write.mode("overwrite").text(f"{path}.new")
    system.delete(fs_path(path), True)
    system.rename(fs_path(f"{path}.new"), fs_path(path))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """project_id, name, status, base_project, source_id, label, source_type, xml_path: a row for each source of each project."""
    source = "struct<id:string,label:string,source_type:string,xml_path:string>"
    schema = f"projects array<struct<id:string,name:string,status:string,base_project:string,sources:array<{source}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("projects").alias("p")).select("p.*", F.explode_outer("p.sources").alias("s"))
    return rows.select(F.col("id").alias("project_id"), "name", "status", "base_project", F.col("s.id").alias("source_id"), "s.label", "s.source_type", "s.xml_path")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """query, kind, expect: the cases of an evaluation set; a case without an answer has an empty list."""
    case = "query:string,kind:string,expect:array<string>"
    rows = spark.read.schema(f"cases array<struct<{case}>>, query string, kind string, expect array<string>").option("multiLine", True).json(path)
    flat = rows.filter("cases is null").drop("cases").unionByName(rows.select(F.inline("cases")))
    return flat.filter("query is not null").withColumn("expect", F.coalesce("expect", F.array().cast("array<string>")))
