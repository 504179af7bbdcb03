"""Problem 5: records of the evaluation splits that are also, exactly or almost, in the training split.

Method: candidates are word sets that meet in a bucket of the near-duplicate operator (one-permutation hashing, bands, stars), checked exactly on their words. Content-defined
chunks (a rolling hash cuts the normalised records, their digests are joined across the splits) give the share of a held-out record that stands in a found training record; they decide no pair,
as edits spread over a text break nearly every chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.functions.canon import document_key
from sheafwork.llm.near_dup import linked_sets, profiles
from sheafwork.llm.records import latest_state, record_texts
from sheafwork.llm.words import fold, hashed_words, mix, signed
from sheafwork.session import cut

MIN_WORDS, MIN_OVERLAP = 10, 0.7
#: A chunk ends where the rolling hash of the last WINDOW words is 0 modulo MODULUS and it has MIN_CHUNK words, or has MAX_CHUNK.
WINDOW, MODULUS, MIN_CHUNK, MAX_CHUNK = 2, 4, 2, 64


def linked(rows: DataFrame, splits: DataFrame, min_words: int = MIN_WORDS, min_overlap: float = MIN_OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(links, members): (a, b, overlap) of each training and held-out word set whose overlap reaches ``min_overlap``, also a set with itself; (record, set_id, held).

    Equal word sets are one class through all steps; the work grows with the records, as a bucket of m sets gives m - 1 edges. Sets of one side only take part too, as centers of stars.
    """
    profile = cut(profiles(rows.where("record is not null and text is not null"), min_words))
    members = cut(profile.select("record", "set_id").join(splits, "record").distinct())
    side = members.groupBy("set_id").agg(F.max(~F.col("held")).alias("train"), F.max("held").alias("held"))
    near = linked_sets(profile, min_overlap)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap"))
    across = both.join(side.where("train").select(F.col("set_id").alias("a")), "a").join(side.where("held").select(F.col("set_id").alias("b")), "b")
    same = side.where("train and held").select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("overlap"))
    return cut(across.select("a", "b", "overlap").unionByName(same)), members


def overlaps(rows: DataFrame, splits: DataFrame, min_words: int = MIN_WORDS, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(train, held, overlap): every pair of a train record and a validation or test record whose word overlap reaches ``min_overlap``.

    ``rows``: (record, text); ``splits``: (record, held). NULLs, texts below ``min_words`` words and records without a split link nothing;
    repeated rows count once; a record in both sides links to itself never.
    """
    links, members = linked(rows, splits, min_words, min_overlap)
    mt = members.where("not held").select(F.col("set_id").alias("a"), F.col("record").alias("train"))
    mh = members.where("held").select(F.col("set_id").alias("b"), F.col("record").alias("held"))
    return links.join(mt, "a").join(mh, "b").where("train <> held").select("train", "held", "overlap").distinct()


def chunk_ends(offsets: np.ndarray, hashes: np.ndarray, window: int = WINDOW, modulus: int = MODULUS, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> np.ndarray:
    """Positions (exclusive, ascending) where a chunk ends: after a word at which the rolling hash of the text's last ``window`` words hits, once ``least`` words are in; a text's end always is one."""
    n = len(hashes)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    rolling = np.zeros(n, np.uint64)
    for back in range(window):
        rolling[back:] += np.where(place[back:] >= back, mix(hashes[: n - back], 41 + back), np.uint64(0))
    hit = (mix(rolling) % np.uint64(modulus)) == 0
    last = np.zeros(n, bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    cutting, stop, length, ends = hit.tolist(), last.tolist(), 0, []
    for i in range(n):
        length += 1
        if stop[i] or (length >= least and cutting[i]) or length == most:
            ends.append(i + 1)
            length = 0
    return np.array(ends, np.int64)


def chunked(rows: DataFrame) -> DataFrame:
    """(record, chunk, words): the distinct chunks of each (record, text), as digests, and their lengths in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, h = hashed_words(b.column(1).to_pylist())
            ends = chunk_ends(offsets, h)
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
            digest = fold(np.concatenate([begins[:1], ends]), h, 9) if len(ends) else np.zeros(0, np.uint64)
            own = np.searchsorted(offsets, begins, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(signed(digest)), pa.array((ends - begins).astype(np.int32))], ["record", "chunk", "words"])

    return rows.select("record", "text").mapInArrow(run, "record string, chunk bigint, words int").distinct()


def shared_share(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds ``shared`` to (train, held, ..): the share of the held-out record's words in chunks that the training record has too; chunks are joined along the pairs only."""
    pairs = cut(pairs)
    ends = pairs.select(F.col("train").alias("record")).unionByName(pairs.select(F.col("held").alias("record"))).distinct()
    c = cut(chunked(rows.where("text is not null").join(ends, "record", "left_semi").dropDuplicates(["record"])))
    whole = c.groupBy(F.col("record").alias("held")).agg(F.sum("words").alias("whole"))
    mine = pairs.select("train", "held").join(c.withColumnRenamed("record", "held"), "held")
    met = mine.join(c.select(F.col("record").alias("train"), "chunk"), ["train", "chunk"]).groupBy("train", "held").agg(F.sum("words").alias("met"))
    out = pairs.join(met, ["train", "held"], "left").join(whole, "held", "left")
    return out.withColumn("shared", F.coalesce(F.col("met") / F.col("whole"), F.lit(0.0))).drop("met", "whole")


def sides(split_assignment: DataFrame) -> DataFrame:
    """(record, held) of every record with a known split; validation and test are held out."""
    s = split_assignment.where("requirement_uid is not null").select(F.col("requirement_uid").alias("record"), F.lower(F.trim("split")).alias("split"))
    return s.where(F.col("split").isin("train", "validation", "test")).select("record", (F.col("split") != "train").alias("held")).distinct()


def overlapping_pairs(labels: DataFrame, split_assignment: DataFrame) -> DataFrame:
    """(requirement_uid_a, requirement_uid_b), a < b by code point."""
    o = overlaps(record_texts(labels, "raw_requirement_text"), sides(split_assignment))
    return o.select(F.least("train", "held").alias("requirement_uid_a"), F.greatest("train", "held").alias("requirement_uid_b")).distinct()


def overlap_classes(labels: DataFrame, split_assignment: DataFrame) -> DataFrame:
    """(requirement_uid, class_id, held, links): every record that is in both sides, with its class of equal word sets and the number of linked classes of the other side; copies aren't expanded."""
    links, members = linked(record_texts(labels, "raw_requirement_text"), sides(split_assignment))
    degree = lambda x, held: links.groupBy(F.col(x).alias("set_id")).agg(F.count(F.lit(1)).alias("links")).withColumn("held", F.lit(held))
    return members.join(degree("a", False).unionByName(degree("b", True)), ["set_id", "held"]).select(F.col("record").alias("requirement_uid"), F.col("set_id").alias("class_id"), "held", "links")


def overlap_report(labels: DataFrame, split_assignment: DataFrame) -> DataFrame:
    """(split, document_id, records, max_overlap, max_shared): held-out records that are also in train, counted per split and document (canonical spelling)."""
    texts = record_texts(labels, "raw_requirement_text")
    o = shared_share(texts, overlaps(texts, sides(split_assignment))).groupBy(F.col("held").alias("requirement_uid")).agg(F.max("overlap").alias("overlap"), F.max("shared").alias("shared"))
    split = split_assignment.select("requirement_uid", F.lower(F.trim("split")).alias("split")).where("split in ('validation', 'test')").distinct()
    doc = latest_state(labels, "document_id").select("requirement_uid", document_key(F.col("document_id")).alias("document_id"))
    j = o.join(split, "requirement_uid").join(doc, "requirement_uid")
    return j.groupBy("split", "document_id").agg(F.countDistinct("requirement_uid").alias("records"), F.max("overlap").alias("max_overlap"), F.max("shared").alias("max_shared"))
