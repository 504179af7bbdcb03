"""Problem 9: sources mixed to target token shares, with capped repeats.

Method: time-varying curriculum. Each source has a weight schedule over the run; its integral is the cumulative token demand, the inverse of
which turns a document's token offset into a training position; documents are range-sorted by position. A source that runs dry before its demand is met falls short.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafwork.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def source_key(c: str) -> Column:
    """Source without outer blanks and case; NULL for a blank one."""
    return F.nullif(F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")), F.lit(""))


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``tokens`` (bigint) of each whole text; NULL text counts 0. The vocabulary file is read on the driver (about a megabyte) and shipped."""
    with open(tokenizer, "rb") as f:
        ranks_file = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        kept = tiktoken.__dict__.setdefault("_kept_encodings", {})
        if tokenizer not in kept:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
            kept[tokenizer] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        enc = kept[tokenizer]
        for b in batches:
            n = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*b.schema.names[:-1], "tokens"])

    kept = documents.select(id_col, *carry, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{kinds}, tokens bigint")


def ramped(weights: DataFrame, repeats: int = 4, start: float = 0.5, end: float = 1.5) -> DataFrame:
    """(source, at, weight): a schedule in which the sources that may be repeated ``repeats`` times or more, taken to be small and good, gain weight towards the end of the run."""
    at = F.explode(F.array(F.struct(F.lit(0.0).alias("at"), F.lit(start).alias("weight")), F.struct(F.lit(1.0).alias("at"), F.lit(end).alias("weight"))))
    return weights.where(F.col("max_repeats") >= repeats).select("source", at.alias("p")).select("source", "p.*")


def segments(schedule: DataFrame) -> DataFrame:
    """(key, segments): the linear pieces of each source's weight between its points, (begin, weight, slope, share of the demand before), scaled so that the integral over the run is 1.

    ``schedule``: (source, at, weight). Times outside [0, 1], negative weights and NULLs don't count; the weight is even before the first and after the last point; a source whose weights are all 0 gets no pieces.
    """
    ok = schedule.select(source_key("source").alias("key"), F.col("at").cast("double").alias("at"), F.col("weight").cast("double").alias("weight")).where("key is not null and at between 0 and 1 and weight >= 0")
    p = ok.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("p"))
    edge = lambda t, i: F.array(F.struct(F.lit(t).alias("at"), F.element_at("p", i)["weight"].alias("weight")))
    p = p.withColumn("p", F.concat(edge(0.0, 1), "p", edge(1.0, -1))).withColumn("i", F.sequence(F.lit(1), F.size("p") - 1))
    begin, end = (lambda i: F.element_at("p", i)), (lambda i: F.element_at("p", i + 1))
    p = p.withColumn("area", F.transform("i", lambda i: (end(i)["at"] - begin(i)["at"]) * (end(i)["weight"] + begin(i)["weight"]) / 2))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    p = p.withColumn("all", total(F.col("area"))).where(F.col("all") > 0)
    width = lambda i: end(i)["at"] - begin(i)["at"]
    piece = lambda i: F.struct(
        begin(i)["at"].alias("t"), (begin(i)["weight"] / F.col("all")).alias("w"), ((end(i)["weight"] - begin(i)["weight"]) / width(i) / F.col("all")).alias("k"), (total(F.slice("area", F.lit(1), i - 1)) / F.col("all")).alias("c"))
    return p.select("key", F.transform(F.filter("i", lambda i: width(i) > 0), piece).alias("segments"))


def position(share: Column, pieces: Column) -> Column:
    """Time at which the scheduled demand reaches ``share`` of the whole: the inverse of the integral; even where there are no pieces."""
    seg = F.element_at(F.filter(pieces, lambda s: s["c"] <= share), -1)
    left = share - seg["c"]
    x = F.try_divide(2 * left, seg["w"] + F.sqrt(F.greatest(F.lit(0.0), seg["w"] * seg["w"] + 2 * seg["k"] * left)))
    return F.when(seg.isNull(), share).otherwise(F.least(F.lit(1.0 - 2**-53), seg["t"] + F.coalesce(x, F.lit(0.0))))


def plan(by_source: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per source of ``weights``: source, key, target_share, max_repeats, tokens, budget (all tokens of documents that have a source), demand, supply.

    A source without documents has 0 tokens; documents whose source is not listed count to the budget only; NULL repeats count as 1. ``by_source``: (key, tokens).
    """
    everything = Window.partitionBy()  # over sources, which are few
    w = weights.select("source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), source_key("source").alias("key")).distinct()
    found = by_source.withColumn("budget", F.sum("tokens").over(everything))
    r = w.join(found, "key", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("budget", F.coalesce(F.max("budget").over(everything), F.lit(0)))
    return r.withColumn("demand", F.coalesce(F.col("target_share") * F.col("budget"), F.lit(0.0))).withColumn("supply", F.col("tokens") * F.col("max_repeats"))


def laid_out(documents: DataFrame, weights: DataFrame, schedule: DataFrame | None = None, tokenizer: str = TOKENIZER, seed: int = 17, bins: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(mixed rows, plan); the rows are (position, doc_id, source, use, tokens), unsorted.

    A source is walked in hash order as often as its demand needs, at most max_repeats times; the document at cumulative offset o gets the position where
    the source's scheduled demand (even without a ``schedule``) reaches o. A short source so ends before the run does.
    Prefix sums run over ``bins`` hash bins of each source, then within a bin, so a hot source is spread.
    """
    per = token_counts(documents.withColumn("_source", source_key("source")), tokenizer, carry=("_source",)).where("_source is not null and tokens > 0")
    per = per.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bin", F.pmod("h", F.lit(bins)))
    per = cut(per)
    bin_sum = cut(per.groupBy("_source", "bin").agg(F.sum("tokens").alias("n")))
    plan_ = plan(bin_sum.groupBy(F.col("_source").alias("key")).agg(F.sum("n").alias("tokens")), weights)
    wanted = plan_.where("demand > 0 and tokens > 0").dropDuplicates(["key"]).select("key", F.col("tokens").alias("all_tokens"), "demand", F.least("demand", F.col("supply").cast("double")).alias("used"))
    pieces = F.lit(None).cast("array<struct<t: double, w: double, k: double, c: double>>")
    wanted = wanted.join(segments(schedule), "key", "left") if schedule is not None else wanted.withColumn("segments", pieces)
    before = Window.partitionBy("_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    start = bin_sum.select("_source", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("_source", "bin").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = per.join(start, ["_source", "bin"]).withColumn("offset", F.col("start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    at = at.join(wanted, at["_source"] == wanted["key"])
    uses = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("used") / F.col("all_tokens")).cast("int") - 1)))
    laid = at.withColumn("use", uses).withColumn("o", F.col("use") * F.col("all_tokens") + F.col("offset")).where("o < used")
    return laid.select(position(F.col("o") / F.col("demand"), F.col("segments")).alias("position"), "doc_id", F.col("_source").alias("source"), "use", "tokens"), plan_


def mix(documents: DataFrame, weights: DataFrame, schedule: DataFrame | None = None, tokenizer: str = TOKENIZER, seed: int = 17) -> DataFrame:
    """(position, doc_id, source, use, tokens): the training order. Position is in [0, 1); ``use`` counts a document's repeats from 0."""
    return laid_out(documents, weights, schedule, tokenizer, seed)[0].orderBy("position", "doc_id", "use")


def mix_report(documents: DataFrame, weights: DataFrame, schedule: DataFrame | None = None, tokenizer: str = TOKENIZER, seed: int = 17) -> DataFrame:
    """(source, target_share, max_repeats, tokens, demand, mixed_tokens, actual_share, short) of every source of ``weights``, measured on the mixed rows.

    ``short``: the source ran dry, its mixed rows have fewer tokens than its demand. A schedule moves positions, never what is mixed.
    """
    rows, plan_ = laid_out(documents, weights, schedule, tokenizer, seed)
    got = rows.groupBy(F.col("source").alias("key")).agg(F.sum("tokens").alias("mixed_tokens"))
    r = plan_.join(got, "key", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    share = F.coalesce(F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(Window.partitionBy())), F.lit(0.0))
    return r.select("source", "target_share", "max_repeats", "tokens", "demand", "mixed_tokens", share.alias("actual_share"), (F.col("mixed_tokens") < F.col("demand")).alias("short"))


def short_sources(documents: DataFrame, weights: DataFrame) -> DataFrame:
    """(source) of ``weights`` that fall short."""
    return mix_report(documents, weights).where("short").select("source").distinct()
