"""Problem 3: train, validation and test splits that keep linked records together.

Method: connected components over documents that share any entity, by alternating large-star and small-star
rounds, then the component's hash picks a place in proportional ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafwork.functions.canon import document_key, label_key, nfkc
from sheafwork.llm.components import components
from sheafwork.llm.records import latest_state

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def document_links(docs: DataFrame) -> DataFrame:
    """(u, v): each document key tied to the least key that has the same entity (notice, file hash), and to the document it supersedes.

    A notice counts by its year and seven-digit serial, whatever the separators and the revision; a hash by its hexadecimal digits in lower case.
    NULL or malformed values link nothing. One star per entity, so a hot entity gives as many edges as it has documents.
    """
    d = docs.select(
        document_key(F.col("document_id")).alias("doc"),
        document_key(F.col("supersedes_document_id")).alias("old"),
        nfkc(F.col("notice_no")).alias("notice"),
        F.lower(F.regexp_replace(nfkc(F.col("source_sha256")), r"(?i)^\s*sha-?256\s*:|[^0-9A-Fa-f]", "")).alias("sha"),
    ).where("doc is not null and doc <> ''")
    year, serial = (F.regexp_extract("notice", r"(?<![0-9])((?:19|20)[0-9]{2})[^0-9]*([0-9]{7})", k) for k in (1, 2))
    entity = F.explode(F.array(
        F.when((year != "") & (serial != ""), F.concat(F.lit("n:"), year, serial)),
        F.when(F.length("sha") == 64, F.concat(F.lit("h:"), F.col("sha"))),
    ))
    shared = d.select("doc", entity.alias("entity")).where("entity is not null").distinct()
    stars = shared.join(shared.groupBy("entity").agg(F.min("doc").alias("center")), "entity").select(F.col("doc").alias("u"), F.col("center").alias("v"))
    return stars.unionByName(d.where("old is not null and old <> ''").select(F.col("doc").alias("u"), F.col("old").alias("v"))).where("u <> v").distinct()


def procurement_of(docs: DataFrame) -> DataFrame:
    """(doc, procurement): component of every linked document key; a key not listed is its own procurement."""
    return components(document_links(docs)).select(F.col("node").alias("doc"), F.col("component").alias("procurement"))


def _key(column: str):
    return F.coalesce(F.nullif(document_key(F.col(column)), F.lit("")), F.col(column))


def same_procurement(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """(document_id_a, document_id_b), a < b: different stored values of ``labels.document_id`` that belong to one procurement.

    NULL ids are left out; an id of blanks or punctuation only stands for itself; an empty table gives no rows.
    """
    stored = labels.select("document_id").where("document_id is not null").distinct().withColumn("doc", _key("document_id"))
    placed = stored.join(procurement_of(docs), "doc", "left").select("document_id", F.coalesce("procurement", "doc").alias("procurement"))
    a, b = (placed.select(F.col("document_id").alias(f"document_id_{x}"), "procurement") for x in "ab")
    return a.join(b, "procurement").where("document_id_a < document_id_b").select("document_id_a", "document_id_b")


def grouped_split(labels: DataFrame, docs: DataFrame, shares=SHARES, bins: int = 4096, seed: int = 13) -> DataFrame:
    """(requirement_uid, procurement, primary_action, split): every record's split; all records of a procurement share one.

    Balance: procurements are put into size classes (powers of two) and strata of their commonest action and laid out along [0, 1) of their
    stratum by weight; the hash only decides the order in a stratum, so each stratum, hence each action, is cut near
    80/10/10 of its records. The prefix sums run over at most ``bins`` hash bins per stratum, then within a bin.
    Records without a document are their own procurement. Repeats of a record count once (latest state).
    """
    state = latest_state(labels, "document_id", "primary_action").select(
        "requirement_uid", F.coalesce(_key("document_id"), F.col("requirement_uid")).alias("doc"), label_key(F.col("primary_action")).alias("action"))
    placed = state.join(procurement_of(docs), "doc", "left").select("requirement_uid", "action", F.coalesce("procurement", "doc").alias("procurement"))
    by = placed.groupBy("procurement", "action").agg(F.count(F.lit(1)).alias("n"))
    unit = by.groupBy("procurement").agg(F.sum("n").alias("size"), F.max(F.struct("n", "action"))["action"].alias("main"))
    unit = unit.select("procurement", "size", F.concat_ws("/", F.coalesce("main", F.lit("")), F.floor(F.log2("size"))).alias("stratum"),
                       F.xxhash64(F.lit(seed), "procurement").alias("h"))
    unit = unit.withColumn("bin", F.pmod("h", F.lit(bins)))
    bin_sum = unit.groupBy("stratum", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bin_sum = bin_sum.select("stratum", "bin", F.coalesce(F.sum("bin_size").over(before), F.lit(0)).alias("start"), F.sum("bin_size").over(Window.partitionBy("stratum")).alias("total"))
    inside = Window.partitionBy("stratum", "bin").orderBy("h", "procurement").rowsBetween(Window.unboundedPreceding, -1)
    at = (F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2) / F.col("total")
    unit = unit.join(bin_sum, ["stratum", "bin"]).withColumn("at", at)
    # a stratum of one or few units follows its hash, not its place, or it would always fall into the middle range
    unit = unit.withColumn("at", F.when(F.col("total") >= 10 * F.col("size"), F.col("at")).otherwise(F.pmod(F.shiftrightunsigned("h", 20), F.lit(1_000_003)) / 1_000_003))
    split, upto = F.lit(shares[-1][0]), 1.0
    for name, share in reversed(shares[:-1]):
        upto -= shares[[s[0] for s in shares].index(name) + 1][1]
        split = F.when(F.col("at") < upto, F.lit(name)).otherwise(split)
    return placed.join(unit.select("procurement", split.alias("split")), "procurement").select("requirement_uid", "procurement", F.col("action").alias("primary_action"), "split")


def kept_together(labels: DataFrame, docs: DataFrame, slack: float = 0.1) -> DataFrame:
    """One row: records that have a split, procurements in more than one split, and whether each split's share is within ``slack`` of the wanted one."""
    s = grouped_split(labels, docs)
    torn = s.groupBy("procurement").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).agg(F.count_if(F.col("lo") != F.col("hi")).alias("torn"))
    shares = [F.abs(F.count_if(F.col("split") == name) / F.count(F.lit(1)) - share) <= slack for name, share in SHARES]
    whole = s.agg(F.countDistinct("requirement_uid").alias("records"), *[c.alias(f"c{i}") for i, c in enumerate(shares)])
    return whole.join(torn, F.lit(True)).select("records", "torn", F.expr(" and ".join(f"c{i}" for i in range(len(shares)))).alias("balanced"))
