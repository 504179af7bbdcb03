"""Labelling runs: latest answers, votes, agreement, transitions, unions, resume, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafwork.functions.canon import label_key, label_keys

AXES = ("primary_action", "cost_basis", "domain_dependency", "build_difficulty", "blockers")


def latest_ok(results: DataFrame, *by: str, time: str = "received_at", carry: tuple[str, ...] = ()) -> DataFrame:
    """Latest successful row per key; ties go to the greatest label."""
    ok = results.where("status = 'ok' and label is not null")
    return ok.groupBy(*by).agg(F.max(F.struct(F.col(time).alias("_t"), "label", *carry)).alias("s")).select(*by, F.col("s.label").alias("label"), *[F.col(f"s.{c}").alias(c) for c in carry])


def axis_values(labels: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per key and label axis, values by meaning (label keys); the blockers as a sorted list. Absent values stay NULL."""
    text = lambda a: F.array_join(label_keys(F.col("label.blockers")), "|") if a == "blockers" else label_key(F.col(f"label.{a}"))
    return labels.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), text(a).alias("value")) for a in AXES])).alias("x")).select(*keys, "x.axis", "x.value")


def unanimity(votes: DataFrame, by: tuple[str, ...], value: str = "value", at_least: int = 2) -> DataFrame:
    """Whether all answers of a key are equal, for keys with at least so many; NULL is a value of its own."""
    g = votes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(value, F.lit(""))).alias("lo"), F.max(F.coalesce(value, F.lit(""))).alias("hi"))
    return g.where(F.col("n") >= at_least).select(*by, "n", (F.col("lo") == F.col("hi")).alias("unanimous"))


def majority(votes: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """Commonest value of a key; ties go to the value answered first. Two map-side combined aggregations, no window over votes."""
    c = votes.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    best = c.groupBy(by).agg(F.max("n").alias("votes"), F.sum("n").alias("answers"))
    tied = c.join(best, by).where("n = votes")
    first = tied.groupBy(by).agg(F.min(F.struct("first_seen", value)).alias("s"), F.first("votes").alias("votes"), F.first("answers").alias("answers"))
    return first.select(by, F.col(f"s.{value}").alias(value), "votes", "answers")


def transitions(a: DataFrame, b: DataFrame, key: str, value: str, domain: tuple[str, ...]) -> DataFrame:
    """Zero-filled matrix in long form: how many keys went from one value to another."""
    spark = a.sparkSession
    grid = spark.createDataFrame([(x, y) for x in domain for y in domain], "before string, after string")
    moved = a.select(key, F.col(value).alias("before")).join(b.select(key, F.col(value).alias("after")), key).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(moved, ["before", "after"], "left").na.fill(0, ["n"]) if len(domain) <= 100 else grid.join(moved, ["before", "after"], "left").na.fill(0, ["n"])


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Per axis: common keys and the share on which both agree. ``a`` and ``b`` are (key, axis, value)."""
    j = a.join(b.withColumnRenamed("value", "other"), [key, "axis"])
    return j.groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value").eqNullSafe(F.col("other")).cast("double")).alias("agreement"))


def override_union(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """Later sources win where they have a non-empty value."""
    rows = [d.select(key, F.nullif(F.col(value), F.lit("")).alias(value), F.lit(i).alias("rank")) for i, d in enumerate(sources)]
    u = rows[0]
    for r in rows[1:]:
        u = u.unionByName(r)
    return u.where(F.col(value).isNotNull()).groupBy(key).agg(F.max(F.struct("rank", value)).alias("s")).select(key, F.col(f"s.{value}").alias(value))


def pending(samples: DataFrame, done: DataFrame, key: str = "requirement_uid") -> DataFrame:
    """Samples without a successful result."""
    return samples.join(done.where("status = 'ok'").select(key).distinct(), key, "left_anti")


def usage_totals(results: DataFrame, by: str) -> DataFrame:
    """Token sums per group and overall (``grouping`` 1) in one pass."""
    u = results.select(by, *[F.coalesce(F.col(f"usage.{c}"), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")])
    return u.rollup(by).agg(F.grouping(by).cast("int").alias("is_total"), F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in u.columns[1:]])


def cost(input_tokens: Column, output_tokens: Column, per_million_in: int, per_million_out: int) -> Column:
    """Cost in millionths of the currency unit, exactly."""
    return input_tokens * per_million_in + output_tokens * per_million_out


def anchor_usage(results: DataFrame) -> DataFrame:
    """How often each anchor was shown, and with which mean and best similarity (in ten-thousandths)."""
    a = results.select(F.explode("anchors_used").alias("a")).select("a.requirement_uid", F.round(F.col("a.similarity") * 10000).cast("bigint").alias("s"))
    return a.groupBy("requirement_uid").agg(F.count(F.lit(1)).alias("uses"), F.sum("s").alias("similarity_sum"), F.max("s").alias("similarity_max"))


def normalized_usage(response: Column) -> dict[str, Column]:
    """Token usage of a provider's JSON response: prompt/completion or input/output keys; the total has the cache tokens too."""
    get = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object(response, f"$.usage.{p}").cast("bigint"), F.lit(0)) for p in paths], F.lit(0))
    provider = F.when(F.get_json_object(response, "$.usage.prompt_tokens").isNotNull(), "openai").when(F.get_json_object(response, "$.usage.input_tokens").isNotNull(), "anthropic").otherwise("generic")
    i, o = get("prompt_tokens", "input_tokens"), get("completion_tokens", "output_tokens")
    write, read = get("cache_creation_input_tokens"), get("cache_read_input_tokens")
    return {"provider": provider, "input_tokens": i, "output_tokens": o, "cache_write": write, "cache_read": read, "total_tokens": F.greatest(get("total_tokens"), i + o + write + read)}


def usage_columns(usage: Column) -> dict[str, Column]:
    """Flat columns of a usage struct, absent counts 0."""
    return {c: F.coalesce(usage[c], F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")}


def usage_summary(totals: DataFrame, by: str) -> dict:
    """A run's usage as one document: overall sums, and by group; ``totals``: ``usage_totals``, a row per group."""
    rows = [r.asDict() for r in totals.collect()]
    bare = lambda r: {k: v for k, v in r.items() if k not in (by, "is_total")}
    return {"total": next((bare(r) for r in rows if r["is_total"]), {}), f"by_{by}": {str(r[by]): bare(r) for r in sorted(rows, key=lambda r: str(r[by])) if not r["is_total"]}}


def upsert(new: DataFrame, old: DataFrame, keys: tuple[str, ...], human: tuple[str, ...], order: str) -> DataFrame:
    """New rows keep the human-owned columns of the last old row with the same keys where they have none themselves."""
    last = old.groupBy(*keys).agg(F.max(F.struct(order, *human)).alias("s")).select(*keys, *[F.col(f"s.{h}").alias(f"_{h}") for h in human])
    j = new.join(last, list(keys), "left")
    return j.select(*keys, *[c for c in new.columns if c not in keys and c not in human], *[F.coalesce(F.nullif(F.col(h), F.lit("")), F.col(f"_{h}")).alias(h) for h in human])


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """Values by frequency; ties by value."""
    c = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.col(by).asc_nulls_first())))
