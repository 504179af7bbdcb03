"""Sources: whole-text documents, JSON lines with checks, review CSV, frozen files by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

REQUIREMENT = (
    "dataset_version string, document_id string, agency string, domain string, requirement_uid string, requirement_id string, source_requirement_id string, requirement_type string, "
    "requirement_name string, raw_requirement_text string, normalized_requirement_text string, source_file string, source_location string, source_table_index int, source_block_index int, "
    "source_sha256 string, extraction_adapter string"
)


def documents(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(file_name, size, sha256, text) of each file."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return d.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def registry_difference(files: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """(key, side) of files not registered and registered files not found."""
    f, r = files.select(key).distinct(), registry.select(key).distinct()
    return f.join(r, key, "left_anti").withColumn("side", F.lit("unregistered")).unionByName(r.join(f, key, "left_anti").withColumn("side", F.lit("missing")))


class UnregisteredFiles(ValueError):
    """Files and registry don't agree."""


def require_registered(files: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """The files, or an error that names some that only one side has."""
    bad = registry_difference(files, registry, key).orderBy(key).limit(5).collect()
    if bad:
        raise UnregisteredFiles(", ".join(f"{r[0]} ({r[1]})" for r in bad))
    return files


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(folder, files, bytes) of everything under a path, at any depth; contents aren't read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return d.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def run_inventory(results: DataFrame, run: str = "run_name") -> DataFrame:
    """(run, ok, total) of each run's results."""
    return results.groupBy(run).agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count(F.lit(1)).alias("total"))


def largest(files: DataFrame) -> DataFrame:
    """The largest file by (size, file_name)."""
    return files.orderBy(F.desc("size"), F.desc("file_name")).limit(1)


def number_setting(name: str, env: dict[str, str], default: float = 0.0) -> float:
    """A number from the environment, thousands marks (``,`` and ``_``) allowed; absent or blank: the default; an error names the variable."""
    text = env.get(name, "").strip().replace(",", "").replace("_", "")
    try:
        return float(text) if text else default
    except ValueError as e:
        raise ValueError(f"{name} is no number: {env[name]!r}") from e


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON lines under an explicit schema; blank lines are skipped, a broken line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def checked_json_lines(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """(file, line, value, missing, broken) of each non-blank line: its number in its file (from 1), required keys that are missing or empty, and whether it is no object.

    Files are read whole, as a line's number needs the lines before it; each goes to one task.
    """
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    lines = text.select("file", F.posexplode(F.split("value", "\n")).alias("line", "value")).where("trim(value) <> ''").withColumn("line", F.col("line") + 1)
    schema = StructType([StructField(k, StringType()) for k in required])
    row = F.from_json("value", schema)
    missing = F.filter(F.array(*[F.when(F.coalesce(row[k], F.lit("")) == "", F.lit(k)) for k in required]), lambda x: x.isNotNull())
    keys = F.json_object_keys("value")
    return lines.select("file", "line", "value", F.when(keys.isNull(), F.array(*map(F.lit, required))).otherwise(missing).alias("missing"), keys.isNull().alias("broken"))


class BadLine(ValueError):
    """The first line that lacks something."""


def require_lines(lines: DataFrame) -> DataFrame:
    """The checked lines, or an error with the file and line of the first bad one."""
    bad = lines.where("broken or size(missing) > 0").orderBy("file", "line").first()
    if bad is not None:
        raise BadLine(f"{bad.file}:{bad.line} " + ("no JSON object" if bad.broken else f"missing: {', '.join(bad.missing)}"))
    return lines


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, the byte order mark off the first name."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return d.toDF(*[c.lstrip("﻿") for c in d.columns])


class HashMismatch(ValueError):
    """A frozen file isn't what it was."""


def frozen_json_lines(spark: SparkSession, path: str, schema: str | StructType, sha256: str | None) -> DataFrame:
    """JSON lines of one frozen file, whose bytes must have the given hash (None: not checked)."""
    if sha256 is not None:
        found = [r[0] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).limit(2).collect()]
        if found != [sha256]:
            raise HashMismatch(f"{path}: {found}")
    return json_lines(spark, path, schema)


def row_range(rows: DataFrame, order: str, start: int, limit: int) -> DataFrame:
    """Rows ``start`` (from 1) to ``start + limit - 1`` in order of a column."""
    return rows.orderBy(order).offset(start - 1).limit(limit)


def head(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """The first rows in order of a column."""
    return rows.orderBy(order).limit(limit)
