"""The label dataset out of labelling runs: ordered union with provenance, checks, rule correction, canonical types, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.operators import rules, taxonomy
from sheafwork.sources.writers import counts_manifest

#: Fields taken over from the requirement.
REQUIREMENT_FIELDS = ("document_id", "agency", "domain", "requirement_id", "requirement_type", "requirement_name", "raw_requirement_text")
LABEL_FIELDS = ("primary_action", "blockers", "cost_basis", "domain_dependency", "build_difficulty", "reasoning")


class OverlappingRuns(ValueError):
    """A requirement has successful results in several rows."""


class UnknownRequirement(KeyError):
    """A result answers for a requirement that isn't in the dataset."""


def union_runs(runs: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(run_order, source_run, execution_path, requirement_uid, label): the successful rows of the runs (name, path, results) in their order; fields that a run lacks are NULL."""
    parts = [d.where("status = 'ok'").select("requirement_uid", "label").withColumns({"run_order": F.lit(i), "source_run": F.lit(name), "execution_path": F.lit(path)}) for i, (name, path, d) in enumerate(runs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def overlapping(union: DataFrame) -> DataFrame:
    """(requirement_uid, n, runs) of requirements with more than one successful row, within a run too."""
    return union.groupBy("requirement_uid").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("source_run")).alias("runs")).where("n > 1")


def unknown(union: DataFrame, requirements: DataFrame) -> DataFrame:
    """(requirement_uid) that no requirement has."""
    return union.select("requirement_uid").distinct().join(requirements.select("requirement_uid"), "requirement_uid", "left_anti")


def require_clean(union: DataFrame, requirements: DataFrame) -> DataFrame:
    """The union, or an error that names some of the overlapping or unknown requirements."""
    if twice := [r[0] for r in overlapping(union).orderBy("requirement_uid").limit(5).collect()]:
        raise OverlappingRuns(", ".join(twice))
    if lost := [str(r[0]) for r in unknown(union, requirements).orderBy("requirement_uid").limit(5).collect()]:
        raise UnknownRequirement(", ".join(lost))
    return union


def assemble(union: DataFrame, requirements: DataFrame, schema_version: str) -> DataFrame:
    """Rows of the label dataset: requirement and label fields, the model's action and the rule's, canonical type, provenance. Unsorted; ``require_clean`` first."""
    fields = requirements.select("requirement_uid", *REQUIREMENT_FIELDS)
    j = union.select("requirement_uid", "source_run", "execution_path", *[F.col(f"label.{f}").alias(f) for f in LABEL_FIELDS]).join(fields, "requirement_uid")
    c = rules.correct(j)
    kind, source = taxonomy.canonical_type(F.col("requirement_type"), F.col("requirement_id"))
    return c.select(
        "requirement_uid", *REQUIREMENT_FIELDS, kind.alias("requirement_type_normalized"), source.alias("requirement_type_source"), F.col("derived_action").alias("primary_action"), F.col("primary_action").alias("primary_action_model"),
        F.col("corrected").alias("rule_corrected"), "blockers", "cost_basis", "domain_dependency", "build_difficulty", "reasoning", "execution_path", "source_run", F.lit(schema_version).alias("schema_version"))


def corrections(dataset: DataFrame) -> DataFrame:
    """(requirement_uid, source_run, model, rule, blockers, cost_basis, reasoning) of the rows in which the rule overruled the model."""
    return dataset.where("rule_corrected").select("requirement_uid", "source_run", F.col("primary_action_model").alias("model"), F.col("primary_action").alias("rule"), "blockers", "cost_basis", "reasoning")


def content_hash(dataset: DataFrame) -> DataFrame:
    """(rows, sha256): one hash over the rows' hashes, the same for every order of rows and partitions: the hashes' sums of four words each, hashed."""
    row = F.sha2(F.to_json(F.struct(*sorted(dataset.columns))), 256)
    words = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    return dataset.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(",", *[F.coalesce(F.sum(w), F.lit(0)).cast("string") for w in words]), 256).alias("sha256"))


def manifest_counts(dataset: DataFrame) -> DataFrame:
    """(column, value, n): rows per run, path, type, source of the type and action in one pass."""
    return counts_manifest(dataset, "source_run", "execution_path", "requirement_type_normalized", "requirement_type_source", "primary_action")
