"""Samplers: quotas with fill, pilot sample by rules, bullets first, longest, largest document, round-robin. Hot groups are ranked in salted parts first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafwork.functions.text import is_bullet_line, normalize_common
from sheafwork.operators.profile import first_n


#: Anchors of a pool that is packed into one array.
MAX_POOL = 5_000


def quota_sample(rows: DataFrame, by: str, stratum: str, quotas: dict[str, int], size: int, order: tuple[Column, ...] | None = None, seed: int = 42) -> DataFrame:
    """(.., stage): per ``by`` the quota of each stratum in the order given (default: by hash), then others until ``size`` rows are taken; never more.

    ``rows`` has requirement_uid. Of a stratum at most ``size`` rows can be taken at all, so ranks stop there.
    """
    order = order or (F.xxhash64(F.lit(seed), "requirement_uid"), F.col("requirement_uid"))
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(stratum)), F.lit(0))
    top = first_n(rows, (by, stratum), order, size, "_in")
    top = top.withColumn("stage", F.when(F.col("_in") <= quota, "quota").otherwise("fill"))
    place = {s: i for i, s in enumerate(quotas)}
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col(stratum)), F.lit(len(place)))
    w = Window.partitionBy(by).orderBy(F.desc("stage"), F.when(F.col("stage") == "quota", rank), *order)  # "quota" after "fill" by name
    return top.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= size).drop("_k", "_in")


def bullets_first(rows: DataFrame, per_document: int, text: str = "raw_requirement_text") -> DataFrame:
    """(.., rank): the first rows of each document, those with a list line before the others, then by key."""
    lines = F.split(normalize_common(F.coalesce(F.col(text), F.lit(""))), "\n")
    marked = rows.withColumn("has_bullet", F.exists(lines, is_bullet_line))
    return first_n(marked, ("document_id",), (F.desc("has_bullet"), F.col("requirement_uid")), per_document)


def longest(rows: DataFrame, text: str = "raw_requirement_text") -> DataFrame:
    """The row with the longest text; ties: the greatest key."""
    return rows.orderBy(F.coalesce(F.length(text), F.lit(0)).desc(), F.desc("requirement_uid")).limit(1)


def of_largest_document(rows: DataFrame, files: DataFrame, file: str = "source_file") -> DataFrame:
    """All rows of the largest source file among theirs; ``files``: (file_name, size); ties: the greatest name."""
    of = files.select(F.col("file_name").alias(file), "size").join(rows.select(file).distinct(), file, "left_semi")
    best = of.orderBy(F.desc("size"), F.desc(file)).limit(1).select(file)
    return rows.join(best, file, "left_semi")


def pilot_sample(rows: DataFrame, kind: Column, target: int = 40, nested: int = 4, extremes: int = 2, per_document: int = 3) -> DataFrame:
    """(requirement_uid, document_id, rule, why): a sample by rules in order; a record counts for the first rule that takes it.

    1 identifiers that differ from their source, 2 the first texts with a nested table, 3 and 4 the shortest and longest texts, 5 every document has ``per_document`` at least, 6 in turns over the ``kind``s
    until ``target`` are taken (the sample may be larger if the rules before take more). The order of rows is that of requirement_uid.
    """
    r = rows.select("requirement_uid", "document_id", "requirement_id", "source_requirement_id", F.coalesce("raw_requirement_text", F.lit("")).alias("text"), kind.alias("kind")).dropDuplicates(["requirement_uid"])
    size = F.length("text")
    keep = ("requirement_uid", "document_id", "kind")
    special = [
        r.where(~F.col("requirement_id").eqNullSafe(F.col("source_requirement_id"))).select(*keep, F.lit(1).alias("rule")),
        r.where(F.col("text").contains(" | ")).orderBy("requirement_uid").limit(nested).select(*keep, F.lit(2).alias("rule")),
        r.orderBy(size, "requirement_uid").limit(extremes).select(*keep, F.lit(3).alias("rule")),
        r.orderBy(size.desc(), F.desc("requirement_uid")).limit(extremes).select(*keep, F.lit(4).alias("rule")),
    ]
    taken = reduce(DataFrame.unionByName, special).groupBy(*keep).agg(F.min("rule").alias("rule"))
    have = taken.groupBy("document_id").agg(F.count(F.lit(1)).alias("have"))
    left = r.select(*keep).join(taken.select("requirement_uid"), "requirement_uid", "left_anti")
    per = first_n(left, ("document_id",), (F.col("requirement_uid"),), per_document).join(have, "document_id", "left").where(F.col("rank") <= per_document - F.coalesce("have", F.lit(0)))
    taken = taken.unionByName(per.select(*keep, F.lit(5).alias("rule")))
    # turns: every kind gives its next record not taken yet; kinds in the order of their first record
    left = r.select(*keep).join(taken.select("requirement_uid"), "requirement_uid", "left_anti")
    first = r.groupBy("kind").agg(F.min("requirement_uid").alias("first"))
    turns = first_n(left, ("kind",), (F.col("requirement_uid"),), target, "turn").join(first, "kind").orderBy("turn", "first").limit(target)
    need = taken.agg((F.lit(target) - F.count(F.lit(1))).alias("need"))
    turns = turns.withColumn("_k", F.row_number().over(Window.orderBy("turn", "first"))).join(need, F.col("_k") <= F.col("need"))
    names = {1: "id_exception", 2: "nested_table", 3: "shortest", 4: "longest", 5: "document", 6: "type"}
    why = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("rule"))
    return taken.unionByName(turns.select(*keep, F.lit(6).alias("rule"))).select("requirement_uid", "document_id", "rule", why.alias("why"))


def random_control(targets: DataFrame, pool: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(target, anchor, rank): k anchors of other documents for each target in an order of its own hash, as a control for retrieval. ``targets``: (target, doc); ``pool``: (anchor, doc), of MAX_POOL rows at most (more raise), whose rows are one array."""
    if pool.limit(MAX_POOL + 1).count() > MAX_POOL:
        raise ValueError(f"a pool has {MAX_POOL} anchors at most")
    packed = pool.agg(F.array_sort(F.collect_list(F.struct("anchor", "doc"))).alias("pool"))
    t = targets.select("target", F.col("doc").alias("tdoc")).join(packed, F.lit(True))
    others = F.filter("pool", lambda a: ~a["doc"].eqNullSafe(F.col("tdoc")))
    mixed = F.slice(F.array_sort(F.transform(others, lambda a: F.struct(F.xxhash64(F.lit(seed), F.col("target"), a["anchor"]).alias("h"), a["anchor"].alias("anchor")))), 1, k)
    return t.select("target", F.posexplode(mixed).alias("rank", "x")).select("target", F.col("x.anchor").alias("anchor"), (F.col("rank") + 1).alias("rank"))
