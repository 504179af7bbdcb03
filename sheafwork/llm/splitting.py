"""Problem 2: items above a size limit cut into overlapping pieces at natural boundaries.

Method: prefix sums of token sizes, sorted arrays of boundary positions, binary search of the last boundary under the limit,
step back by the overlap, hard cut where there is no boundary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.records import record_texts

LIMIT, OVERLAP = 1500, 100
_TOKEN = re.compile(r"[^ \t\r\n]+|[ \t\r\n]")  # every blank is an edge of its own
#: An empty line, and an end of a line after which a heading, a list item or a table row begins or that closes one.
_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)[ \t\r\n]*")
_BLOCK = re.compile(r"(?:</(?:tr|table|p|li|ul|ol|h[1-6]|div)>[ \t]*)(?:\r\n|\r|\n)|(?:\r\n|\r|\n)(?=[ \t]*(?:#{1,6} |[-*◦○●•▪■□◆▶] |\|))", re.I)


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted cut positions (code points), the strongest first: ends of paragraphs, of blocks (headings, list items, table rows), of lines, of sentences, all token edges. Each is a token edge too."""
    tokens = _TOKEN.findall(text)
    ends = np.cumsum([len(t) for t in tokens])  # prefix sums
    blank = np.fromiter((t[0] in " \t\r\n" for t in tokens), bool, len(tokens))
    line = np.fromiter((t[0] in "\r\n" for t in tokens), bool, len(tokens))
    stop = np.fromiter((t[-1] in ".?!。" for t in tokens), bool, len(tokens))
    after_stop = np.zeros(len(tokens), bool)
    after_stop[1:] = blank[1:] & stop[:-1]
    found = lambda pattern: np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
    return [found(_PARAGRAPH), found(_BLOCK), ends[line], ends[after_stop], ends]


def _last(positions: np.ndarray, low: int, high: int) -> int:
    """The last position in (low, high], or -1."""
    i = int(np.searchsorted(positions, high, side="right")) - 1
    return int(positions[i]) if i >= 0 and positions[i] > low else -1


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """(begin, end, forced) of each piece; end - begin <= limit.

    A piece takes in as much as fits: up to the last paragraph's end, if that leaves it at least half full, else the last block's, line's or sentence's end likewise,
    else the last blank edge. It begins ``overlap`` code points before the end of the one before; fewer only where else the next
    boundary would not fit. ``forced``: the piece ends inside a stretch that has no boundary within the limit. Text of at most
    ``limit`` is one piece, empty text one empty piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, False)]
    *natural, edges = boundaries(text)
    out, at = [], 0
    while at < n:
        back = min(overlap, at)
        top = at - back + limit
        if top >= n:
            out.append((at - back, n, False))
            break
        half = at + (limit - back) // 2
        end = next((e for e in (_last(b, half, top) for b in natural) if e >= 0), -1)
        if end < 0:
            end = _last(edges, at, top)
        forced = False
        if end < 0:
            nxt = int(edges[np.searchsorted(edges, at, side="right")])
            if nxt - at <= limit:
                end, back = nxt, limit - (nxt - at)
            else:
                end, forced = top, True
        out.append((at - back, end, forced))
        at = end
    return out


def _cut_up(rows: DataFrame, text: str, key: str, limit: int, overlap: int, with_text: bool) -> DataFrame:
    """The pieces of every row whose text is over-long, repeats included; only such rows leave the JVM, an Arrow batch at a time."""
    long = rows.where(F.col(key).isNotNull() & (F.length(F.col(text)) > limit)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = ["key", "piece", "pieces", "begin", "end", "overlap", "forced", *(["text"] if with_text else [])]
    kinds = [pa.string(), *[pa.int32()] * 5, pa.bool_(), *([pa.string()] if with_text else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few long texts are decoded at once
                part = batch.slice(at, 64)
                keys, texts = (part.column(i).to_pylist() for i in (0, 1))
                rows_out = [(k, i, len(p), b, e, (p[i - 1][1] - b) if i else 0, f, *([t[b:e]] if with_text else [])) for k, t in zip(keys, texts) for p in [pieces(t, limit, overlap)] for i, (b, e, f) in enumerate(p)]
                cols = list(zip(*rows_out)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    return long.mapInArrow(cut, "key string, piece int, pieces int, begin int, end int, overlap int, forced boolean" + (", text string" if with_text else ""))


def split_texts(rows: DataFrame, text: str = "raw_requirement_text", key: str = "requirement_uid", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, pieces, begin, end, overlap, forced, text) of every text above ``limit`` code points.

    NULL texts, NULL keys and texts within the limit give no rows; repeated rows of a key give its pieces once; other columns are ignored.
    """
    return _cut_up(rows, text, key, limit, overlap, True).dropDuplicates(["key", "piece"]).withColumnRenamed("key", key)


def split_kinds(labels: DataFrame) -> DataFrame:
    """(requirement_uid, kind): ``forced`` if a hard cut was needed, else ``natural``, for every over-long record. Repeats are merged on the flag, so no text is shuffled."""
    p = _cut_up(labels, "raw_requirement_text", "requirement_uid", LIMIT, OVERLAP, False)
    return p.groupBy(F.col("key").alias("requirement_uid")).agg(F.when(F.max("forced"), "forced").otherwise("natural").alias("kind"))


def rejoined(labels: DataFrame) -> DataFrame:
    """(requirement_uid, text_md5) of the over-long records put together again from their pieces without the overlaps."""
    p = split_texts(labels).withColumn("new", F.expr("substring(text, overlap + 1)"))
    whole = p.groupBy("requirement_uid").agg(F.array_sort(F.collect_list(F.struct("piece", "new"))).alias("x"))  # the pieces of one text
    return whole.select("requirement_uid", F.md5(F.array_join(F.transform("x", lambda x: x["new"]), "")).alias("text_md5"))
