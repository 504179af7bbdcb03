"""Problem 6: records that differ by small edits.

Method: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges; the edges are checked exactly, and
stars that are close enough to hide a link between two of their leaves are opened once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafwork.llm.components import components
from sheafwork.llm.pairs import with_overlap
from sheafwork.llm.records import record_texts
from sheafwork.llm.words import distinct_words, fold, hashed_words, list_column, mix, signed, sketch
from sheafwork.session import cut

MIN_WORDS, MIN_OVERLAP = 10, 0.7
ROWS, BANDS = 5, 48
#: Equal bits (of 64) below which an edge is not checked further: 3.9 standard deviations under the mean of two texts at the least overlap.
MIN_EQUAL_BITS = 43
#: Overlap with the star's center from which two leaves may be linked though neither is to the center.
LOOSE = 0.35
#: Leaves of a star for each task its pairs of leaves go to.
SPLIT_AT = 500
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def profiles(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(record, set_id, words): digest and distinct word hashes (32 bit, ascending) of each (record, text) with at least ``min_words`` words, repeats counted. NULL texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, h = hashed_words(b.column(1).to_pylist())
            keep = np.diff(offsets) >= min_words
            so, sh = distinct_words(offsets, h)
            digest = fold(so, sh, 1)
            short = (sh >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = list_column(so, short, pa.int32())
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed(digest)), lists], ["record", "set_id", "words"]).filter(mask)

    return rows.select("record", "text").mapInArrow(run, "record string, set_id bigint, words array<int>")


def densify_plan(bins: int, tries: int = 64) -> np.ndarray:
    """(tries, bins): the bin that an empty bin asks next; the same for all texts, so equal sets stay equal."""
    grid = mix(np.arange(tries * bins, dtype=np.uint64), 77) % np.uint64(bins)
    return grid.reshape(tries, bins).astype(np.int64)


def one_permutation(offsets: np.ndarray, hashes: np.ndarray, bins: int, plan: np.ndarray) -> np.ndarray:
    """(texts, bins): minimum of each bin under one permutation; empty bins take the value of a filled one by optimal densification."""
    n = len(offsets) - 1
    h = mix(hashes, 5)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    cell = owner * bins + (h % np.uint64(bins)).astype(np.int64)
    sig = np.full(n * bins, _EMPTY)
    order = np.argsort(h, kind="stable")[::-1]  # the smallest is written last
    sig[cell[order]] = h[order]
    sig = sig.reshape(n, bins)
    filled = sig != _EMPTY
    r, c = np.nonzero(~filled & filled.any(1)[:, None])
    for step in plan:
        if not len(r):
            break
        ask = step[c]
        ok = filled[r, ask]
        sig[r[ok], c[ok]] = sig[r[ok], ask[ok]]
        r, c = r[~ok], c[~ok]
    if len(r):  # no filled bin was asked: take the first one after it
        for i, j in zip(r, c):
            f = np.flatnonzero(filled[i])
            sig[i, j] = sig[i, f[np.searchsorted(f, j) % len(f)]]
    return sig


def band_rows(profile: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(band, id, bits): a row per band of each distinct set; copies within a batch are dropped here, before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = densify_plan(rows * bands)
        for b in batches:
            ids, first = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)
            lists = b.column(1).take(pa.array(first))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            h = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint32).astype(np.uint64)
            offsets = offsets - offsets[0]
            h = mix(h, 3)
            sig = one_permutation(offsets, h, rows * bands, plan)
            key = np.zeros((len(ids), bands), np.uint64)
            for k in range(rows):
                key = mix(key + sig[:, k::rows], k + 11)
            # the low six bits are the band's number
            key = (mix(key + np.arange(bands, dtype=np.uint64)[None, :], 23) & ~np.uint64(63)) | np.arange(bands, dtype=np.uint64)[None, :]
            bits = signed(sketch(offsets, h))
            yield pa.RecordBatch.from_arrays([pa.array(signed(key.reshape(-1))), pa.array(np.repeat(ids, bands)), pa.array(np.repeat(bits, bands))], ["band", "id", "bits"])

    return profile.select("set_id", "words").mapInArrow(run, "band bigint, id bigint, bits bigint")


def star_edges(bands: DataFrame, min_equal_bits: int = MIN_EQUAL_BITS) -> DataFrame:
    """(a, b, met), a < b: each set of a bucket with the bucket's least set, if their sketches agree enough; bit i of ``met``: in band i. A bucket of m sets gives m - 1 edges."""
    center = F.min(F.struct("id", "bits")).over(Window.partitionBy("band"))
    e = bands.withColumn("c", center).where("id <> c.id").where(64 - F.bit_count(F.col("bits").bitwiseXOR(F.col("c.bits"))) >= min_equal_bits)
    return e.groupBy(F.col("c.id").alias("a"), F.col("id").alias("b")).agg(F.bit_or(F.expr("shiftleft(1L, cast(band & 63 as int))")).alias("met"))


def hidden_pairs(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: leaves of one star that were in a bucket together, where only their center was compared with them. Big stars go to several tasks."""
    degree = edges.groupBy(F.col("a").alias("c")).agg((1 + F.floor(F.count(F.lit(1)) / SPLIT_AT)).cast("int").alias("salts"))
    arms = edges.select(F.col("a").alias("c"), F.col("b").alias("x"), "met").join(degree, "c")
    p = arms.select("c", "met", F.col("x").alias("a"), F.pmod("x", "salts").cast("int").alias("salt"))
    q = arms.select("c", F.col("met").alias("also"), F.col("x").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return p.join(q, ["c", "salt"]).where((F.col("a") < F.col("b")) & (F.col("met").bitwiseAND(F.col("also")) != 0)).select("a", "b").distinct()


def linked_sets(profile: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(a, b, overlap): different word sets, a < b, whose overlap reaches ``min_overlap``.

    Two leaves of one star are compared too if they shared a bucket and are close to its center: only then can they have been hidden behind it.
    """
    edges = cut(star_edges(band_rows(profile)))
    ends = edges.select(F.col("a").alias("set_id")).unionByName(edges.select(F.col("b").alias("set_id"))).distinct()
    sets = cut(profile.join(ends, "set_id", "left_semi").groupBy("set_id").agg(F.first("words").alias("words")).withColumnRenamed("set_id", "id"))
    close = cut(with_overlap(edges, sets).where(F.col("overlap") >= LOOSE))
    hidden = hidden_pairs(close).join(close, ["a", "b"], "left_anti")
    return close.drop("met").unionByName(with_overlap(hidden, sets)).where(F.col("overlap") >= min_overlap)


def collection(labels: DataFrame, anchors: DataFrame) -> DataFrame:
    """(record, text) of label_dataset_v2 (raw text) and anchor_candidates_quote (normalised text) as one collection."""
    return record_texts(labels, "raw_requirement_text").unionByName(record_texts(anchors, "normalized_requirement_text"))


def near_duplicates(rows: DataFrame, min_words: int = MIN_WORDS, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(record_a, record_b), a < b by code point: all pairs of records whose overlap reaches ``min_overlap``.

    Rows with NULL record or text, and texts below ``min_words`` words, link nothing; repeated rows of a record count once. Copies of a set are one class through all
    steps and are expanded into pairs at the very end only.
    """
    profile = cut(profiles(rows.where("record is not null and text is not null"), min_words))
    links = linked_sets(profile, min_overlap)
    member = profile.select("record", "set_id").distinct()
    a, b = (member.select(F.col("set_id").alias(x), F.col("record").alias(f"r{x}")) for x in "ab")
    across = links.select("a", "b").join(a, "a").join(b, "b").select("ra", "rb")
    many = member.join(member.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "set_id", "left_semi")
    inside = many.alias("p").join(many.alias("q"), "set_id").where("p.record < q.record").select(F.col("p.record").alias("ra"), F.col("q.record").alias("rb"))
    both = across.unionByName(inside).where("ra <> rb")
    return both.select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b")).distinct()


def groups(rows: DataFrame, min_words: int = MIN_WORDS, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(record, class_id, group_id, links): the exact class, the connected group and the number of linked classes of every record with enough words.

    One row per record and class; group_id and class_id are digests, a record without partners is its own group.
    """
    profile = cut(profiles(rows.where("record is not null and text is not null"), min_words))
    links = cut(linked_sets(profile, min_overlap).select("a", "b"))
    group = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = links.select(F.col("a").alias("set_id")).unionByName(links.select(F.col("b").alias("set_id"))).groupBy("set_id").agg(F.count(F.lit(1)).alias("links"))
    out = profile.select("record", "set_id").distinct().join(group.select(F.col("node").alias("set_id"), "component"), "set_id", "left").join(degree, "set_id", "left")
    return out.select("record", F.col("set_id").alias("class_id"), F.coalesce("component", "set_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_requirements(labels: DataFrame, anchors: DataFrame) -> DataFrame:
    """(requirement_uid_a, requirement_uid_b)."""
    return near_duplicates(collection(labels, anchors)).select(F.col("record_a").alias("requirement_uid_a"), F.col("record_b").alias("requirement_uid_b"))
