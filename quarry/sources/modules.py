"""Module files of a configuration dump as a DataFrame."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Folders of a dump and the kinds of their objects.
KINDS = {
    "Catalogs": "Справочник", "Constants": "Константа", "Documents": "Документ", "DocumentJournals": "ЖурналДокументов", "InformationRegisters": "РегистрСведений", "AccumulationRegisters": "РегистрНакопления",
    "AccountingRegisters": "РегистрБухгалтерии", "CalculationRegisters": "РегистрРасчета", "CommonModules": "ОбщийМодуль", "DataProcessors": "Обработка", "Reports": "Отчет", "Enums": "Перечисление",
    "ChartsOfCharacteristicTypes": "ПланВидовХарактеристик", "ChartsOfCalculationTypes": "ПланВидовРасчета", "ChartsOfAccounts": "ПланСчетов", "BusinessProcesses": "БизнесПроцесс", "Tasks": "Задача",
    "ExchangePlans": "ПланОбмена", "CommonForms": "ОбщаяФорма", "CommonCommands": "ОбщаяКоманда", "SettingsStorages": "ХранилищеНастроек", "FilterCriteria": "КритерийОтбора",
}
# File names and module types.
MODULE_TYPES = {
    "Module.bsl": "Модуль", "ObjectModule.bsl": "МодульОбъекта", "ManagerModule.bsl": "МодульМенеджера", "CommandModule.bsl": "МодульКоманды", "RecordSetModule.bsl": "МодульНабораЗаписей",
    "ManagedApplicationModule.bsl": "МодульУправляемогоПриложения", "SessionModule.bsl": "МодульСеанса",
}


FORM_MODULE = "МодульФормы"


@F.pandas_udf(StringType())
def decode_name(names: pd.Series) -> pd.Series:
    """``#Uhhhh`` stands for one character of a name."""
    return names.map(lambda n: n if n is None else re.sub("#U([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), n))


@F.pandas_udf(StringType())
def decode_text(contents: pd.Series) -> pd.Series:
    """Bytes as UTF-8 without its mark, else as code page 1251; null where neither fits."""

    def decoded(raw: bytes | None) -> str | None:
        for name in ("utf-8-sig", "cp1251") if raw is not None else ():
            try:
                return bytes(raw).decode(name)
            except UnicodeDecodeError:
                pass
        return None

    return contents.map(decoded)


def _named(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def relative_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """relative_path, content, length and modificationTime of the files below ``root`` whose names fit ``glob``.

    Files are listed and read by Spark's binary source, one task for a group of files. Spark's source leaves out empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    # The part of the path after the root, wherever the scheme ends; the root is a literal, whatever it holds.
    start = F.locate(f"{full}/", F.col("path"))
    return files.select(F.substring("path", start + len(full) + 1, F.length("path")).alias("relative_path"), "content", "length", "modificationTime")


def module_files(spark: SparkSession, root: str, glob: str = "*.bsl") -> DataFrame:
    """relative_path, object_kind, object_name, form_name, module_type, full_name, form_xml_path, file_size, mtime, file_hash, text.

    A file under no known folder is a module of the configuration itself; an unknown file name is its own type.
    form_xml_path is where the form of a form's module is described, relative as well. The hash is of the file alone.
    """
    files = relative_files(spark, root, glob)
    part = lambda i: F.get("parts", F.lit(i))
    known = part(0).isin(*KINDS)
    in_form = F.col("relative_path").rlike(r"/Ext/Form/Module\.bsl$")
    form = F.when(part(2) == "Forms", part(3)).when(part(0) == "CommonForms", part(1))
    found = files.select("relative_path", F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"), F.md5("content").alias("file_hash"), decode_text("content").alias("text"))
    found = found.withColumn("parts", F.split("relative_path", "/"))
    last = F.element_at("parts", -1)
    kind = F.when(known, _named(KINDS, part(0))).otherwise("Конфигурация")
    type_ = F.when(known & in_form, FORM_MODULE).otherwise(F.coalesce(_named(MODULE_TYPES, last), F.regexp_replace(last, r"\.[^.]*$", "")))
    rows = found.select(
        "relative_path",
        kind.alias("object_kind"),
        decode_name(F.when(known, part(1)).otherwise("")).alias("object_name"),
        decode_name(F.when(known, form)).alias("form_name"),
        type_.alias("module_type"),
        F.when(known & in_form, F.regexp_replace("relative_path", r"/Form/Module\.bsl$", "/Form.xml")).alias("form_xml_path"),
        "file_size", "mtime", "file_hash", "text",
    )
    whole = (
        F.when(F.col("object_name") == "", F.concat_ws(".", "object_kind", "module_type"))
        .when((F.col("module_type") == FORM_MODULE) & (F.col("object_kind") == KINDS["CommonForms"]), F.concat_ws(".", "object_kind", "object_name"))
        .when(F.col("module_type") == FORM_MODULE, F.concat_ws(".", "object_kind", "object_name", F.lit("Форма"), "form_name"))
        .otherwise(F.concat_ws(".", "object_kind", "object_name", "module_type"))
    )
    return rows.withColumn("full_name", whole)


def line_range(text: Column, first: int, last: int) -> Column:
    """Lines first..last, counted from 1; fewer where the text ends."""
    return F.array_join(F.slice(F.split(text, "\r?\n", -1), first, last - first + 1), "\n")
