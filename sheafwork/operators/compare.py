"""Comparing labelling runs and conditions, and summaries of what retrieval put in front of the labeller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Agreement of repeated runs of the same condition, the baseline of a comparison of two conditions.
REPEAT_BASELINE = 0.925


def screened(votes: DataFrame, by: str, value: str, repeats: int = 3) -> DataFrame:
    """(by, n, unanimous, value): keys with exactly ``repeats`` answers, whether all are equal, and the common answer. ``value`` NULL is an answer of its own."""
    v = F.coalesce(F.col(value), F.lit(""))
    g = votes.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).where(F.col("n") == repeats)
    return g.select(by, "n", (F.col("lo") == F.col("hi")).alias("unanimous"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias(value))


def admitted(screening: DataFrame) -> DataFrame:
    """The keys that pass a screening."""
    return screening.where("unanimous")


def changed(before: DataFrame, after: DataFrame, key: str, value: str, *carry: str) -> DataFrame:
    """(key, before, after, carried columns of both): common keys whose values differ."""
    side = lambda d, name: d.select(key, F.col(value).alias(name), *[F.col(c).alias(f"{c}_{name}") for c in carry])
    return side(before, "before").join(side(after, "after"), key).where(~F.col("before").eqNullSafe(F.col("after")))


def against_gold(gold: DataFrame, run: DataFrame, key: str, value: str) -> DataFrame:
    """(key, gold, value, agrees) of every gold row; one that the run lacks raises when it is read."""
    j = gold.select(key, F.col(value).alias("gold")).join(run.select(key, value, F.lit(True).alias("_there")), key, "left")
    there = F.when(F.col("_there"), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("no answer for "), F.col(key))))
    return j.select(key, "gold", there.alias(value)).withColumn("agrees", F.col("gold").eqNullSafe(F.col(value)))


def verdicts(agreement: DataFrame, baseline: float = REPEAT_BASELINE) -> DataFrame:
    """Adds whether two conditions agree as well as repeats of one do."""
    return agreement.withColumn("as_good_as_repeats", F.col("agreement") >= baseline)


def side_by_side(a: DataFrame, b: DataFrame, value: str, domain: tuple[str, ...], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(place, value, counts of both, difference) for each of ``domain`` in its order, zero-filled."""
    tagged = a.select(value, F.lit(0).alias("side")).unionByName(b.select(value, F.lit(1).alias("side")))
    g = tagged.groupBy(value).agg(*[F.count_if(F.col("side") == i).alias(n) for i, n in enumerate(names)])
    dom = a.sparkSession.createDataFrame(list(enumerate(domain)), f"place int, {value} string")
    j = dom.join(g, value, "left").na.fill(0, list(names))
    return j.select("place", value, *names, (F.col(names[1]) - F.col(names[0])).alias("difference"))


def merged_counts(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(value, merged, summed): values of the right-biased union of two maps, and of their plain sum."""
    j = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full_outer")
    merged = j.groupBy(F.coalesce("_b", "_a").alias(value)).agg(F.count(F.lit(1)).alias("merged"))
    summed = a.select(value).unionByName(b.select(value)).groupBy(value).agg(F.count(F.lit(1)).alias("summed"))
    return merged.join(summed, value, "full_outer").na.fill(0, ["merged", "summed"])


def similarity_change(shown: DataFrame, by: str, base: str) -> DataFrame:
    """(by, n, mean, most, change): mean and best similarity of shown anchors (by, similarity) per condition, and the mean's relative change against the condition ``base``. NULLs don't count."""
    g = shown.where("similarity is not null").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("mean"), F.max("similarity").alias("most"))
    reference = g.where(F.col(by) == base).select(F.col("mean").alias("_base"))
    return g.join(reference, F.lit(True), "left").select(by, "n", "mean", "most", F.try_divide(F.col("mean") - F.col("_base"), F.col("_base")).alias("change"))


def usage_profile(uses: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """(anchors, used, unused, most, median): how the uses (key, uses) spread over the pool's anchors."""
    j = pool.select(key).distinct().join(uses.select(key, "uses"), key, "left").na.fill(0, ["uses"])
    return j.agg(F.count(F.lit(1)).alias("anchors"), F.count_if(F.col("uses") > 0).alias("used"), F.count_if(F.col("uses") == 0).alias("unused"), F.max("uses").alias("most"), F.percentile("uses", F.lit(0.5)).alias("median"))


def count_of_counts(rows: DataFrame, key: str) -> DataFrame:
    """(n, keys): how many keys have n rows."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("keys"))


def preview(targets: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(what, item, n): how many targets get how many anchors (0 too), how often each label is shown, and how many targets get none. ``retrieved``: (target, label)."""
    per = targets.select("target").join(retrieved.groupBy("target").agg(F.count(F.lit(1)).alias("k")), "target", "left").na.fill(0, ["k"])
    shape = per.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(F.lit("anchors").alias("what"), F.col("k").cast("string").alias("item"), "n")
    labels = retrieved.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("label").alias("what"), F.col("label").alias("item"), "n")
    empty = per.agg(F.count_if(F.col("k") == 0).alias("n")).select(F.lit("empty").alias("what"), F.lit("targets").alias("item"), "n")
    return shape.unionByName(labels).unionByName(empty)


def trace(anchors: Column, with_document: bool = True) -> Column:
    """Array of anchors without their texts: key, document, action, similarity to four places, overlap terms."""
    fields = ["requirement_uid", *(["document_id"] if with_document else []), "primary_action"]
    return F.transform(anchors, lambda a: F.struct(*[a[f].alias(f) for f in fields], F.round(a["similarity"], 4).alias("similarity"), a["overlap_terms"].alias("overlap_terms")))


def best_attributes(uses: DataFrame, pool: DataFrame, key: str, top: int = 10) -> DataFrame:
    """The most used anchors with the pool's attributes; an anchor that left the pool keeps NULLs."""
    return uses.orderBy(F.desc("uses"), key).limit(top).join(pool, key, "left")


def prefix_cardinality(requests: DataFrame, system: str = "system") -> DataFrame:
    """(prefix, n): requests per distinct system block (by hash)."""
    return requests.groupBy(F.sha2(F.coalesce(F.col(system), F.lit("")), 256).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def concentration(rows: DataFrame, by: str) -> DataFrame:
    """(groups, rows, least, most, most_share) over the sizes of the groups."""
    g = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"), (F.max("n") / F.sum("n")).alias("most_share"))


def composition(sample: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n) per group and, with ``by`` NULL, overall, in one pass."""
    return sample.groupingSets([[by, value], [value]], by, value).agg(F.grouping(by).cast("int").alias("overall"), F.count(F.lit(1)).alias("n"))


def first_label(*candidates: Column) -> Column:
    """The first label that isn't empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])
