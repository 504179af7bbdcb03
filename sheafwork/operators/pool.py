"""Anchor pools: checked loading, metadata, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.operators.rules import ACTIONS

# Fields an anchor must have, states of its review.
REQUIRED = ("requirement_uid", "document_id", "requirement_name", "raw_requirement_text", "primary_action", "reasoning", "review_status", "pool_version")
STATUSES = ("후보", "검토완료", "제외")
REVIEWED = "검토완료"
SCHEMA = ", ".join(f"{c} string" for c in (*REQUIRED, "provenance", "source_run"))


class PoolError(ValueError):
    """Why a pool can't be used."""


def problem(row: Column | None = None) -> Column:
    """What is wrong with one anchor, NULL if nothing: missing or empty fields first, then its review state, then its action."""
    of = (lambda c: row[c]) if row is not None else F.col
    missing = F.filter(F.array(*[F.when(F.coalesce(of(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull())
    return (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))
        .when(~of("review_status").isin(*STATUSES), F.concat(F.lit("unknown review_status: "), of("review_status")))
        .when(~of("primary_action").isin(*ACTIONS), F.concat(F.lit("unknown primary_action: "), of("primary_action")))
    )


def from_lines(lines: DataFrame) -> DataFrame:
    """Rows of a pool's JSON lines (value), each with its ``problem``; blank lines are skipped, a line that is no object has the problem ``no JSON object``."""
    r = lines.where(F.trim("value") != "").select("value", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("r"))
    return r.select(F.when(F.json_object_keys("value").isNull(), F.lit("no JSON object")).otherwise(problem(F.col("r"))).alias("problem"), "r.*")


def reviewed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("review_status") == REVIEWED)


def checked(rows: DataFrame) -> DataFrame:
    """The reviewed anchors of a pool (rows with ``problem``), or the first thing wrong with it: a bad row, no rows, several versions, none reviewed, repeated keys."""
    bad = rows.where("problem is not null").select("problem", "requirement_uid").orderBy("problem", "requirement_uid").first()
    if bad is not None:
        raise PoolError(f"{bad.problem} ({bad.requirement_uid})")
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.min("pool_version").alias("lo"), F.max("pool_version").alias("hi"), F.count_if(F.col("review_status") == REVIEWED).alias("reviewed")).first()
    if not one.n:
        raise PoolError("empty pool")
    if one.lo != one.hi:
        raise PoolError(f"several versions: {one.lo}, {one.hi}")
    if not one.reviewed:
        raise PoolError("no reviewed anchor")
    twice = [r[0] for r in reviewed(rows).groupBy("requirement_uid").count().where("count > 1").orderBy("requirement_uid").limit(5).collect()]
    if twice:
        raise PoolError(f"repeated: {', '.join(twice)}")
    return reviewed(rows).drop("problem")


def metadata(anchors: DataFrame, actions: tuple[str, ...] = ACTIONS) -> DataFrame:
    """(action, n, documents, missing): anchors and documents of each action, those of none too."""
    all_actions = anchors.sparkSession.createDataFrame([(a,) for a in actions], "action string")
    g = anchors.groupBy(F.col("primary_action").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("documents"))
    return all_actions.join(g, "action", "left").na.fill(0, ["n", "documents"]).withColumn("missing", F.col("n") == 0)


def require_labels(anchors: DataFrame, actions: tuple[str, ...] = ACTIONS) -> DataFrame:
    """The anchors, or an error if an action has none (strategies with one anchor of each need them all)."""
    lost = [r[0] for r in metadata(anchors, actions).where("missing").orderBy("action").collect()]
    if lost:
        raise PoolError(f"no anchor of {', '.join(lost)}")
    return anchors


def versions(rows: DataFrame, first: DataFrame, late_run: str, names: tuple[str, str, str] = ("v1", "v2", "v3")) -> DataFrame:
    """The pool in three versions, each row stamped with its ``pool_version``: those listed in ``first`` (requirement_uid), all but those of one run (rows without a run stay), all. A semi-join and two filters."""
    stamp = lambda d, v: d.withColumn("pool_version", F.lit(v))
    early = rows.join(first.select("requirement_uid").distinct(), "requirement_uid", "left_semi")
    return stamp(early, names[0]).unionByName(stamp(rows.where(~F.col("source_run").eqNullSafe(F.lit(late_run))), names[1])).unionByName(stamp(rows, names[2]))
