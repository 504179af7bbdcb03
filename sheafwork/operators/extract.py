"""Requirement extraction from Markdown with embedded HTML tables, and its reconciliation with the index."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafwork.functions.text import REQUIREMENT_ID, cell_key, clean_lines, unescape

# Keys of the labelled rows of a requirement table.
ID_KEYS = ("요구사항ID", "고유번호")
ID_KEY_PART = "요구사항고유번호"
HEADER_KEYS = ("요구사항명", "요구사항명칭")
CLASS_KEYS = ("요구사항분류", "요구사항구분", "구분")
LABELS = {"requirement_type": CLASS_KEYS, "requirement_name": ("요구사항명", "요구사항명칭", "요구사항이름"), "body": ("요구사항내용", "요구사항세부내용", "세부내용", "상세내용", "요구내용")}


class _Tables(HTMLParser):
    """Cells of outermost tables. A nested table is flattened into its cell: it and its rows stand on lines of their own, its cells are joined by `` | ``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth = self.inner = 0
        self.done: list[tuple[int, int, list]] = []
        self.line, self.rows, self.row, self.cell = 0, [], None, None

    def _put(self, text: str) -> None:
        if self.cell is not None:
            self.cell[1].append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.line, self.rows, self.row, self.cell = self.getpos()[0], [], None, None
            else:
                self.inner = 0
                self._put("\n")
        elif not self.depth:
            return
        elif tag == "br":
            self._put("\n")
        elif self.depth == 1 and tag == "tr":
            self.row = (self.getpos()[0], [])
        elif self.depth == 1 and tag in ("td", "th") and self.row is not None:
            self.cell = (tag, [])
        elif self.depth > 1 and tag == "tr":
            self.inner = 0
            self._put("\n")
        elif self.depth > 1 and tag in ("td", "th"):
            self._put(" | " if self.inner else "")
            self.inner += 1

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            if self.depth:
                self._put("\n")
            else:
                self.done.append((self.line, self.getpos()[0], self.rows))
        elif self.depth > 1 and tag == "tr":
            self._put("\n")
        elif self.depth == 1 and tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row[1].append((self.cell[0], "".join(self.cell[1])))
            self.cell = None
        elif self.depth == 1 and tag == "tr" and self.row is not None:
            if self.row[1]:
                self.rows.append(self.row)
            self.row = None

    def handle_data(self, data):
        if self.depth:
            self._put(data)


CELL = "table int, table_line int, table_end int, row int, row_line int, cell int, tag string, text string"


def table_cells(text: str | None) -> list[tuple]:
    """(table, table_line, table_end, row, row_line, cell, tag, text) of every closed outermost table; lines count from 1, tables, rows and cells from 0."""
    parser = _Tables()
    parser.feed(text or "")
    return [(t, line, end, r, row_line, c, tag, value) for t, (line, end, rows) in enumerate(parser.done) for r, (row_line, cells) in enumerate(rows) for c, (tag, value) in enumerate(cells)]


def parse_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table, table_line, table_end, row, row_line, cell, tag, text): one row per cell; ``text`` is cleaned (entities decoded, lines stripped, empty lines dropped)."""
    names = [c.split()[0] for c in CELL.split(", ")]
    kinds = [pa.int32()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, *c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c in table_cells(t)]
            cols = list(zip(*out)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, [pa.string(), *kinds])], [key, *names])

    raw = docs.select(F.col(key).cast("string").alias(key), text).mapInArrow(run, f"`{key}` string, {CELL}")
    return raw.withColumn("text", clean_lines(unescape("text")))


def _rows(cells: DataFrame, *by: str) -> DataFrame:
    """One row per table row: key of the first cell, value and identifier of the others, the whole line."""
    in_order = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("cell", "text")))), lambda x: x["text"])
    r = cells.groupBy(*by).agg(
        F.max(F.when(F.col("cell") == 0, F.col("text"))).alias("head"), clean_lines(F.array_join(in_order(F.col("cell") > 0), "\n")).alias("value"), clean_lines(F.array_join(in_order(F.col("cell") >= 0), " ")).alias("line"),
        F.min_by(F.regexp_extract("text", REQUIREMENT_ID, 1), F.when((F.col("cell") > 0) & (F.regexp_extract("text", REQUIREMENT_ID, 1) != ""), F.col("cell"))).alias("found"), F.first("row_line").alias("row_line"), F.first("table_line").alias("table_line"))
    k = cell_key(F.col("head"))
    return r.withColumn("key", k).withColumn("marker", ((k.contains(ID_KEY_PART) | k.isin(*ID_KEYS)) & F.col("found").isNotNull()).cast("int"))


def blocks(cells: DataFrame, key: str) -> DataFrame:
    """Rows of each table with their ``block`` (from 1) and its ``block_line``: a table with several identifier rows is cut at each of them; the classification row just before one belongs to its block too.

    Rows before the first of several identifiers belong to no block; a table with one identifier or none is one block.
    """
    rows = _rows(cells, key, "table", "row")
    w = Window.partitionBy(key, "table").orderBy("row")
    rows = rows.withColumn("markers", F.sum("marker").over(Window.partitionBy(key, "table"))).withColumn("so_far", F.sum("marker").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = (F.lead("marker").over(w) == 1) & F.col("key").isin(*CLASS_KEYS)
    several = F.array_distinct(F.filter(F.array(F.when(F.col("so_far") > 0, F.col("so_far")), F.when(ahead, F.col("so_far") + 1)), lambda x: x.isNotNull()))
    rows = rows.withColumn("_blocks", F.when(F.col("markers") > 1, several).otherwise(F.array(F.lit(1).cast("bigint"))).cast("array<int>"))
    rows = rows.withColumn("block", F.explode("_blocks")).drop("_blocks")
    at = F.min(F.when((F.col("marker") == 1) & (F.col("so_far") == F.col("block")), F.col("row_line"))).over(Window.partitionBy(key, "table", "block"))
    return rows.withColumn("block_line", F.when(F.col("markers") > 1, at).otherwise(F.col("table_line"))).drop("markers", "so_far")


def identified(block_rows: DataFrame, *by: str) -> DataFrame:
    """(by, requirement_id, adapter, block_line, labelled values): one row per block, the identifier NULL where there is none.

    ``labeled_id``: a row whose key names the identifier; ``header_id``: the first row is the identifier alone and a name row follows. A labelled value is
    the first non-empty one.
    """
    value = lambda keys: F.min_by("value", F.when(F.col("key").isin(*keys) & (F.col("value") != ""), F.col("row")))
    out = block_rows.groupBy(*by).agg(
        F.min_by("found", F.when(F.col("marker") == 1, F.col("row"))).alias("labeled"), F.min_by("line", "row").alias("top"), F.min("row").alias("top_row"), F.min("block_line").alias("block_line"),
        F.max(F.when(F.col("key").isin(*HEADER_KEYS), F.col("row"))).alias("name_row"), *[value(k).alias(n) for n, k in LABELS.items()])
    alone = F.nullif(F.regexp_extract("top", "^" + REQUIREMENT_ID + "$", 1), F.lit(""))
    header = F.when(F.col("labeled").isNull() & (F.col("name_row") > F.col("top_row")), alone)
    out = out.withColumn("requirement_id", F.coalesce("labeled", header)).withColumn("adapter", F.when(F.col("labeled").isNotNull(), "labeled_id").when(F.col("requirement_id").isNotNull(), "header_id"))
    return out.select(*by, "requirement_id", "adapter", "block_line", *LABELS)


def requirements(cells: DataFrame, key: str) -> DataFrame:
    """(key, table, block, requirement_id, adapter, block_line, requirement_type, requirement_name, body): one row per block with an identifier."""
    return identified(blocks(cells, key), key, "table", "block").where("requirement_id is not null")


def differences(index: DataFrame, detail: DataFrame, doc: str, item: str) -> DataFrame:
    """(doc, item, reason): items that only the index has (``index_only``), only the detail has (``detail_only``, in documents that have an index), or the index has several times (``duplicate_index``).

    One row each, so a document of any size is no group of one task.
    """
    i = index.groupBy(doc, item).agg(F.count(F.lit(1)).alias("ni"))
    d = detail.groupBy(doc, item).agg(F.count(F.lit(1)).alias("nd"))
    j = i.join(d, [doc, item], "full_outer").join(index.select(F.col(doc).alias("_doc")).distinct(), F.col(doc) == F.col("_doc"), "left")
    why = F.array(F.when(F.col("nd").isNull(), "index_only"), F.when(F.col("ni").isNull() & F.col("_doc").isNotNull(), "detail_only"), F.when(F.col("ni") > 1, "duplicate_index"))
    return j.select(doc, item, F.explode(F.array_compact(why)).alias("reason"))


def reconcile(index: DataFrame, detail: DataFrame, doc: str, item: str) -> DataFrame:
    """(doc, index_count, detail_count, index_only, detail_only, duplicate_index, exact): per document the rows of either side, how many items differ in which way, whether both agree exactly.

    Documents of either side only are kept. Without an index nothing differs and nothing agrees. The items themselves are ``differences``.
    """
    counts = index.select(doc, F.lit(0).alias("side")).unionByName(detail.select(doc, F.lit(1).alias("side"))).groupBy(doc).agg(*[F.count_if(F.col("side") == i).alias(f"{n}_count") for i, n in enumerate(("index", "detail"))])
    reasons = ("index_only", "detail_only", "duplicate_index")
    of = differences(index, detail, doc, item).groupBy(doc).agg(*[F.count_if(F.col("reason") == r).alias(r) for r in reasons])
    g = counts.join(of, doc, "left").na.fill(0, list(reasons))
    return g.withColumn("exact", (F.col("index_count") > 0) & (F.col("index_only") + F.col("detail_only") + F.col("duplicate_index") == 0))


def apply_policy(different: DataFrame, accepted: DataFrame, doc: str, item: str) -> DataFrame:
    """The differences with whether they are ``accepted``; ``accepted``: (doc, reason, item)."""
    yes = accepted.select(doc, "reason", item).distinct().withColumn("accepted", F.lit(True))
    return different.join(yes, [doc, "reason", item], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def resolve(compared: DataFrame, judged: DataFrame, doc: str) -> DataFrame:
    """The comparison with the number of ``unresolved`` differences of each document and whether it is ``resolved``: has an index and none is left."""
    left = judged.where("not accepted").groupBy(doc).agg(F.count(F.lit(1)).alias("unresolved"))
    return compared.join(left, doc, "left").na.fill(0, ["unresolved"]).withColumn("resolved", F.col("unresolved") == 0)
