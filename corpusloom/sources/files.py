"""Sources and sinks: Markdown folders, JSON lines, CSV, split folders and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx


def _contents(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """path, content of a folder's files, empty ones too, which a table of files would leave out. A folder on a mount that all executors share is listed here and read by name, 20,000 files a task at most; others go through Hadoop."""
    import fnmatch
    import os

    context = spark.sparkContext
    local = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")
    if "://" in local:
        found = context.binaryFiles(f"{folder.rstrip('/')}/{glob}")
        try:
            found.getNumPartitions()  # lists them
        except Exception as e:  # noqa: BLE001
            if "matches 0 files" not in str(e):
                raise
            found = context.parallelize([], 1)
    else:

        def read(names):
            for name in names:
                with open(f"{local}/{name}", "rb") as f:
                    yield f"file:{local}/{name}", f.read()

        local = os.path.abspath(local)
        names = sorted(x.name for x in os.scandir(local) if x.name[0] not in "._" and fnmatch.fnmatchcase(x.name, glob) and x.is_file())
        found = context.parallelize(names, max(1, min(len(names), max(context.defaultParallelism, len(names) // 20_000 + 1)))).mapPartitions(read)
    return spark.createDataFrame(found, "path string, content binary", verifySchema=False)


def read_markdown(spark: SparkSession, folder: str, cleaned_only: bool = False, limit: int | None = None) -> DataFrame:
    """path, stem, content (bytes) and text (newlines normalised) of the .md files of a folder; limit: the first so many by name, 0 or None for all."""
    glob = "*_cleaned.md" if cleaned_only else "*.md"
    files = _contents(spark, folder, glob).withColumn("stem", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", ""))
    if limit:
        files = files.orderBy("stem").limit(limit)
    return files.select("path", "stem", "content", tx.normalise_newlines(F.decode("content", "UTF-8")).alias("text"))


def doc_id(stem, how: str = "suffix"):
    """A document's id from its file's stem: without a final `_cleaned` (suffix), without any (anywhere), or as it is (raw)."""
    return {"suffix": F.regexp_replace(stem, "_cleaned$", ""), "anywhere": F.replace(stem, F.lit("_cleaned"), F.lit("")), "raw": stem}[how]


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Strict: a bad line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """line, keys (null: not an object), record, invalid for every line that isn't blank."""
    lines = spark.read.text(path).where(tx.strip(F.col("value")) != "").withColumnRenamed("value", "line")
    asked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.select("line", F.json_object_keys("line").alias("keys"), F.from_json("line", asked, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("record"))
    return parsed.withColumn("invalid", F.col("keys").isNull() | F.col("record._corrupt_record").isNotNull())


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, nulls written out."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_markdown(cleaned: DataFrame, folder: str, suffix: str = "_cleaned") -> None:
    """stem, text to files <stem><suffix>.md in a folder that all executors share. A table is the usual sink; this is for export."""

    def save(rows) -> None:
        import pathlib

        for row in rows:
            pathlib.Path(folder, f"{row.stem}{suffix}.md").write_text(row.text, encoding="utf-8")

    import os

    os.makedirs(folder, exist_ok=True)
    cleaned.select("stem", "text").foreachPartition(save)


def with_split_ids(records: DataFrame, prefix: str = "qac", order: str = "ord") -> DataFrame:
    """Records with `id`: <prefix>-<split>-<number from 0 in the order of the split>."""
    number = F.row_number().over(Window.partitionBy("split").orderBy(order)) - 1
    return records.withColumn("id", F.format_string("%s-%s-%05d", F.lit(prefix), F.col("split"), number))


def write_splits(records: DataFrame, folder: str, prefix: str = "qac", order: str = "ord") -> None:
    """A folder for each split, with ids, and one of all records, with their split and without ids."""
    with_split_ids(records, prefix, order).drop(order).write.partitionBy("split").option("ignoreNullFields", False).json(f"{folder}/{prefix}_splits")
    columns = [c for c in records.columns if c not in ("split", order)]
    records.select("split", *columns).write.option("ignoreNullFields", False).json(f"{folder}/{prefix}_all")


def report_json(report: DataFrame) -> str:
    """The one row of a report as indented JSON."""
    return json.dumps(json.loads(report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]), indent=2, ensure_ascii=False)


def parse_files(spark: SparkSession, folder: str, parse: Callable[[str, bytes], str], glob: str = "*") -> DataFrame:
    """path, markdown, error of each file through a parser from outside; a file that fails doesn't stop the others."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    out.append((path, parse(path, content), None))
                except Exception as e:  # noqa: BLE001
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "markdown", "error"])

    return _contents(spark, folder, glob).mapInPandas(work, "path string, markdown string, error string")


def failed(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NOT NULL").select("path", "error")


def merge_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of JSON shards without blank or malformed ones, ones that hold a NaN or None marker, and ones with Chinese characters."""
    lines = spark.read.text(paths).select(F.col("value").alias("line")).where(tx.strip(F.col("value")) != "")
    marker = r':\s*(?:NaN|None|"(?i:nan|none)")\s*[,}\]]'
    return lines.where(F.json_object_keys("line").isNotNull() & ~F.col("line").rlike(marker) & ~F.col("line").rlike(r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"))
