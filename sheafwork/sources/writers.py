"""Sinks: JSON lines and CSV twins, appends that are idempotent by key, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.functions.text import model_text
from sheafwork.operators.runs import upsert

COMPARED = ("input", "strategy", "schema_version", "prompt_version", "parameters", "anchoring")


def json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def csv(rows: DataFrame, path: str, mode: str = "overwrite", bom: bool = False) -> None:
    """CSV with header; ``bom``: each file begins with a byte order mark, for spreadsheets."""
    if bom:
        rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    rows.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def text_variants(rows: DataFrame) -> DataFrame:
    """Sample rows with their text raw, with normalised lists and flat."""
    forms = {"raw_text": "raw", "normalized_list_text": "normalized-list", "flat_text": "flat"}
    return rows.select("requirement_uid", "document_id", "requirement_id", "requirement_type", "requirement_name", *[model_text(F.col("requirement_name"), F.col("raw_requirement_text"), v).alias(n) for n, v in forms.items()])


#: Rows of an aggregate that a report shows.
REPORT_ROWS = 1_000


def report(sections: dict[str, DataFrame], most: int = REPORT_ROWS) -> tuple[dict, str]:
    """(data, Markdown) of named aggregates; each is collected up to ``most`` rows, and says so where it has more."""
    data, lines = {}, []
    for title, d in sections.items():
        got = d.limit(most + 1).collect()
        data[title] = [r.asDict(recursive=True) for r in got[:most]]
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        lines += [f"## {title}", "", "| " + " | ".join(d.columns) + " |", "|" + "-|" * len(d.columns)]
        lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in got[:most]]
        lines += [f"(more than {most} rows)"] if len(got) > most else []
        lines.append("")
    return data, "\n".join(lines)


def write_dataset(rows: DataFrame, folder: str, audit: dict[str, DataFrame]) -> None:
    """A dataset as JSON lines and CSV with byte order marks, its audit as JSON, its report as Markdown, all through Spark's own file systems."""
    json_lines(rows, f"{folder}/data_json")
    csv(rows, f"{folder}/data_csv", bom=True)
    data, markdown = report(audit)
    write_text(rows.sparkSession, f"{folder}/audit.json", json.dumps(data, ensure_ascii=False, default=str, indent=1))
    write_text(rows.sparkSession, f"{folder}/report.md", markdown)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file on any file system that Spark knows; it takes the place of an old one in one step."""
    p, new = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, path + ".new"))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    try:
        out.write(text.encode("utf-8"))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(new, p):
        raise OSError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file of any file system."""
    return spark.read.text(path, wholetext=True).first()[0]


def upsert_reviews(queue: DataFrame, path: str, keys: tuple[str, ...], human: tuple[str, ...]) -> None:
    """Writes a review queue over an older one (CSV): human fields that were filled in stay where the new row leaves them empty. The new queue is written beside the old one first."""
    spark = queue.sparkSession
    if exists(spark, path):
        old = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        old = old.toDF(*[c.lstrip("\ufeff") for c in old.columns]).withColumn("_line", F.monotonically_increasing_id())
        queue = upsert(queue, old, keys, human, "_line").select(*queue.columns)
    csv(queue, path + ".new", bom=True)
    p, new = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, path + ".new"))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(p, True)
    if not fs.rename(new, p):
        raise OSError(f"could not write {path}")


def write_label_dataset(dataset: DataFrame, folder: str, built_at: str, sources: dict[str, str], order: str = "requirement_uid") -> dict:
    """The dataset as JSON lines in order of its key (a range sort, as many files as its partitions) and its manifest: rows, hash of the content, counts by column, sources with their hashes, corrections."""
    from sheafwork.operators.assembly import content_hash, corrections, manifest_counts

    json_lines(dataset.sort(order), f"{folder}/data")
    whole = content_hash(dataset).first()
    counts: dict[str, dict] = {}
    for r in manifest_counts(dataset).collect():
        counts.setdefault(r["column"], {})[str(r["value"])] = r["n"]
    corrected = [r.asDict() for r in corrections(dataset).sort(order).limit(REPORT_ROWS).collect()]
    now = {"built_at": built_at, "row_count": whole["rows"], "content_sha256": whole["sha256"], "sources": sources, "counts": counts, "rule_corrections": corrected}
    write_text(dataset.sparkSession, f"{folder}/manifest.json", json.dumps(now, ensure_ascii=False, indent=1))
    return now


def write_versions(pool: DataFrame, folder: str) -> None:
    """A pool of several versions as one folder of JSON lines each (``pool.versions``)."""
    pool.write.mode("overwrite").partitionBy("pool_version").json(folder)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any file system that Spark knows; what can't be asked raises."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key isn't there yet, so a repeated run adds nothing."""
    if exists(rows.sparkSession, path):
        rows = rows.join(rows.sparkSession.read.schema(rows.schema).parquet(path).select(key).distinct(), key, "left_anti")
    rows.write.mode("append").parquet(path)


class ManifestMismatch(ValueError):
    """A run is continued under other conditions."""


def manifest(spark: SparkSession, path: str, now: dict) -> dict:
    """Writes the run's manifest; an existing one must agree on the compared keys (a changed sample count is taken over)."""
    if exists(spark, path):
        old = json.loads(read_text(spark, path))
        bare = lambda m: json.dumps({k: m.get(k) if k != "input" else {x: y for x, y in (m.get(k) or {}).items() if x != "sample_count"} for k in COMPARED}, sort_keys=True)
        if bare(old) != bare(now):
            raise ManifestMismatch(path)
    write_text(spark, path, json.dumps(now, ensure_ascii=False, sort_keys=True, indent=1))
    return now


def counts_manifest(rows: DataFrame, *columns: str) -> DataFrame:
    """(column, value, n) for each of the columns in one pass over the rows."""
    g = rows.groupingSets([[c] for c in columns], *columns)
    out = g.agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in columns])
    which = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.col(c).cast("string")) for c in columns])
    return out.select(which.alias("column"), value.alias("value"), "n")
