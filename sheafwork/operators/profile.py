"""Profiling aggregates: counts, crosstabs, exact quantiles, shares, duplicates, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafwork.session import cut

#: Parts in which the rows of a group are ranked before the group as a whole.
SALTS = 32
QUANTILES = (0.5, 0.9, 0.95, 0.99)


def latest(rows: DataFrame, key: str, time: str, *columns: str) -> DataFrame:
    """One row per key: the greatest time's columns (combined map-side)."""
    s = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(time, *columns)).alias("s"))
    return s.select(key, *[F.col(f"s.{c}").alias(c) for c in columns])


def counts(rows: DataFrame, *keys: Column | str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def shares(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count and share of each value, within ``by`` or overall. Shares are taken of the counts, which are few."""
    c = counts(rows, *by, value)
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def length_stats(rows: DataFrame, value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """n, min, max, mean and exact interpolated quantiles; NULLs don't count. Exact percentiles keep counts per distinct value, so their state grows with the
    distinct lengths, not with the rows."""
    v = rows.select(*by, value.alias("v"))
    q = F.percentile("v", F.array(*map(F.lit, QUANTILES)))
    out = v.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum("v").alias("total"), q.alias("q"))
    return out.select(*by, "n", "least", "most", (F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("mean"), *[F.col("q")[i].alias(f"p{int(p * 100)}") for i, p in enumerate(QUANTILES)])


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return counts(rows, *keys).where("n > 1")


def dominant(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Commonest value of each group (ties: the first by code point), its count, and its share."""
    c = counts(rows, by, value)
    g = c.groupBy(by).agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    t = c.join(g, by).where("n = top").groupBy(by).agg(F.min(value).alias(value), F.first("top").alias("n"), F.first("total").alias("total"))
    return t.select(by, value, "n", (F.col("n") / F.col("total")).alias("share"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per equal-width bin of [low, high], overall or per group; the top edge belongs to the last bin."""
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(value).between(low, high)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def extremes(rows: DataFrame, text: str, key: str, k: int = 5) -> DataFrame:
    """The k shortest and the k longest texts, with ranks; ties by key (longest: descending). TakeOrdered, no full sort."""
    r = rows.select(key, F.length(text).alias("length")).where("length is not null")
    short = r.orderBy("length", key).limit(k).withColumn("side", F.lit("shortest"))
    long = r.orderBy(F.desc("length"), F.desc(key)).limit(k).withColumn("side", F.lit("longest"))
    rank_s = F.row_number().over(Window.partitionBy("side").orderBy("length", key))
    rank_l = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("length"), F.desc(key)))
    return short.withColumn("rank", rank_s).unionByName(long.withColumn("rank", rank_l))


def pair_counts(rows: DataFrame, items: str) -> DataFrame:
    """Co-occurring unordered pairs of a row's distinct items."""
    s = rows.select(F.array_sort(F.array_distinct(items)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + F.lit(2), F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return s.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def distribution_gap(population: DataFrame, sample: DataFrame, value: str) -> DataFrame:
    """Share of each value in both, and the difference; values of one side only count 0 in the other."""
    p, s = (shares(d, value).select(value, F.col("share").alias(n)) for d, n in ((population, "population"), (sample, "sample")))
    j = p.join(s, value, "full_outer").na.fill(0.0, ["population", "sample"])
    return j.withColumn("gap", F.col("sample") - F.col("population"))


def positions(rows: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, .., position): places from 1 within each group, whatever its size: one range-partitioned sort of all rows, whose partitions' sizes give each row its place; no task holds a group.

    The sort's places are cut by a checkpoint, so a task run again can't give others.
    """
    at = F.monotonically_increasing_id()
    s = cut(rows.sort(by, order).withColumn("_pos_at", at)).withColumn("_pos_part", F.shiftrightunsigned("_pos_at", 33))
    sizes = s.groupBy("_pos_part").agg(F.count(F.lit(1)).alias("_pos_n"))  # as many rows as there are partitions
    before = sizes.withColumn("_pos_before", F.coalesce(F.sum("_pos_n").over(Window.orderBy("_pos_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_pos_n")
    s = s.join(F.broadcast(before), "_pos_part").withColumn("_pos_at", F.col("_pos_before") + F.col("_pos_at").bitwiseAND(F.lit((1 << 33) - 1)))
    start = s.groupBy(F.col(by).alias("_pos_of")).agg(F.min("_pos_at").alias("_pos_start"))
    return s.join(start, F.col(by).eqNullSafe(F.col("_pos_of"))).withColumn("position", F.col("_pos_at") - F.col("_pos_start") + 1).drop("_pos_at", "_pos_part", "_pos_before", "_pos_start", "_pos_of")


def edge_rows(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """First, middle, last and longest row of each group (longest: first on ties). Three of them are aggregates; the middle one comes from ``positions``."""
    r = rows.select(by, order, F.coalesce(F.length(text), F.lit(0)).alias("_length"))
    ends = r.groupBy(by).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.max("_length").alias("_most"), F.floor((F.count(F.lit(1)) - 1) / 2).alias("_half"))
    of = ends.select(F.col(by).alias("_by"), "_most", "_half")
    longest = r.join(of, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_length") == F.col("_most"))).groupBy(by).agg(F.min(order).alias(order))
    p = positions(r, by, order)
    middle = p.join(of, F.col(by).eqNullSafe(F.col("_by"))).where(F.col("position") == F.col("_half") + 1).select(by, order)
    named = lambda d, name: d.select(by, order, F.lit(name).alias("reason"))
    out = ends.select(by, F.explode(F.array(F.struct(F.col("first").alias("o"), F.lit("first").alias("reason")), F.struct(F.col("last").alias("o"), F.lit("last").alias("reason")))).alias("x")).select(by, F.col("x.o").alias(order), "x.reason")
    return out.unionByName(named(middle, "middle")).unionByName(named(longest, "longest"))


def round_robin(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Rows taken in turns from the groups (in order of their first row) until ``size`` are taken; a group gives no more than ``size``."""
    first = rows.groupBy(group).agg(F.min(order).alias("group_first"))
    r = first_n(rows, (group,), (F.col(order),), size, "turn", order).join(first, group)
    return r.orderBy("turn", "group_first").limit(size).drop("group_first")


def first_n(rows: DataFrame, group: tuple[str, ...], order: tuple[Column, ...], most: int, rank: str = "rank", by: str = "requirement_uid") -> DataFrame:
    """The first ``most`` rows of each group with their rank. Each of ``SALTS`` parts of a group keeps at most ``most`` rows, so no task sorts a whole hot group."""
    part = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    part = part.withColumn("_k", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))).where(F.col("_k") <= most).drop("_k", "_part")
    return part.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= most)


def describe(rows: DataFrame, value: Column, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95), by: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, sample standard deviation, least, exact interpolated quantiles and most, overall or per group."""
    v = rows.select(*by, value.alias("v"))
    out = v.groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("least"), F.percentile("v", F.array(*map(F.lit, quantiles))).alias("q"), F.max("v").alias("most"))
    return out.select(*by, "n", "mean", "std", "least", *[F.col("q")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(quantiles)], "most")


def quartiles(rows: DataFrame, value: Column, by: str) -> DataFrame:
    """(by, n, q1, median, q3, place): quartiles of each group, groups placed by their median (ties by name)."""
    g = rows.select(by, value.alias("v")).groupBy(by).agg(F.count("v").alias("n"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    g = g.select(by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("median", by)))


def at_least_quantile(rows: DataFrame, value: Column, p: float) -> DataFrame:
    """The rows whose value reaches the quantile ``p`` of all, with both. The quantile is one row."""
    r = rows.withColumn("value", value)
    limit = r.agg(F.percentile("value", F.lit(p)).alias("limit"))
    return r.join(F.broadcast(limit), F.col("value") >= F.col("limit"))


def quantile_comparison(population: DataFrame, sample: DataFrame, value: Column, quantiles: tuple[float, ...] = (0.5, 0.9, 0.95)) -> DataFrame:
    """(quantile, population, sample)."""
    q = lambda d, name: d.agg(F.percentile(value, F.array(*map(F.lit, quantiles))).alias("q")).select(F.posexplode("q").alias("i", name))
    at = F.element_at(F.array(*map(F.lit, quantiles)), F.col("i") + 1)
    return q(population, "population").join(q(sample, "sample"), "i").select(at.alias("quantile"), "population", "sample")


def item_counts(rows: DataFrame, items: str) -> DataFrame:
    """Rows per item of a multi-valued column; an item counts once a row."""
    return rows.select(F.explode(F.array_distinct(items)).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def integrity(rows: DataFrame, key: str, body: str, kind: str) -> DataFrame:
    """(check, n): repeated keys, empty bodies, missing types."""
    blank = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
    one = rows.agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("repeated key"), blank(body).alias("empty body"), blank(kind).alias("missing type"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("n")) for c in one.columns])).alias("x")).select("x.*")
