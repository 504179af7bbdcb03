"""From source documents to requirement records: identifiers of the index section, canonical identifiers, records of 17 fields, review queue and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafwork.functions.text import REQUIREMENT_ID, clean_lines, unescape
from sheafwork.operators import extract, profile

# Headings that open the index of the requirements, and that close it.
INDEX_BEGINS = r"요구사항\s*(?:(?:정의\s*및\s*)?목록(?:표)?|총괄표)"
INDEX_ENDS = r"요구사항\s*(?:세부(?:\s*내용)?|상세(?:\s*(?:내용|내역))?)"
# Identifiers spelled otherwise in a document, by (document, identifier).
ALIASES = {("incheon_airport_digital_work", "CUR-CM--001"): "CUR-CM-001"}
REVIEW_MACHINE = ("document_id", "requirement_uid", "requirement_id", "reason", "source_file", "source_location")
REVIEW_HUMAN = ("original_checked", "id_match", "name_match", "body_complete", "table_structure_ok", "review_note", "reviewer", "reviewed_at")
#: Counters of the audit that stop a strict build.
STRICT = ("duplicate_uid_count", "missing_name_count", "missing_body_count", "empty_document_count", "unresolved_index_mismatch_document_count")


def heading_text(line: Column) -> Column:
    """Visible text of a line that may be a heading; empty for a line of table rows or cells."""
    bare = clean_lines(unescape(F.regexp_replace(line, "<[^>]+>", " ")))
    return F.when(line.rlike(r"(?i)</?(?:tr|td|th)\b"), F.lit("")).otherwise(F.regexp_replace(bare, r"^[#* |\t]+|[#* |\t]+$", ""))


def index_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, begin, end): each heading that opens an index and the next heading that closes one (NULL: none); lines count from 1."""
    lines = docs.select(F.col(key).cast("string").alias(key), F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.col("line").contains("요구사항"))
    lines = lines.select(key, (F.col("pos") + 1).alias("at"), heading_text(F.col("line")).alias("heading"))
    lines = lines.withColumn("opens", F.col("heading").rlike(INDEX_BEGINS)).withColumn("closes", F.col("heading").rlike(INDEX_ENDS)).where("opens or closes")
    after = Window.partitionBy(key).orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    return lines.withColumn("end", F.min(F.when(F.col("closes"), F.col("at"))).over(after)).where("opens").select(key, F.col("at").alias("begin"), "end")


def index_ids(docs: DataFrame, key: str, text: str, cells: DataFrame | None = None) -> DataFrame:
    """(key, position, requirement_id): the identifiers of the last index section that has any, in order, repeats kept.

    A section's tables count up to the first one that is a requirement's own. ``cells``: ``parse_tables`` of the documents, if at hand.
    """
    cells = extract.parse_tables(docs, key, text) if cells is None else cells
    own = extract.identified(extract._rows(cells, key, "table", "row").withColumn("block_line", F.col("table_line")), key, "table").select(key, "table", F.col("requirement_id").isNotNull().alias("own"))
    tables = cells.groupBy(key, "table").agg(F.first("table_line").alias("line"), F.first("table_end").alias("last")).join(own, [key, "table"])
    inside = tables.join(index_sections(docs, key, text), key).where((F.col("line") > F.col("begin")) & (F.col("end").isNull() | (F.col("last") < F.col("end"))))
    w = Window.partitionBy(key, "begin").orderBy("table").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("stopped", F.max("own").over(w)).where("not stopped").select(key, "begin", "table")
    ids = F.regexp_extract_all("text", F.lit(REQUIREMENT_ID), F.lit(1))
    found = cells.join(inside, [key, "table"]).select(key, "begin", "table", "row", "cell", F.posexplode(ids).alias("at", "requirement_id"))
    last = found.groupBy(key).agg(F.max("begin").alias("begin"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("table", "row", "cell", "at"))
    return found.join(last, [key, "begin"]).select(key, place.alias("position"), "requirement_id")


def canonical_id(document: Column, source_id: Column, aliases: dict[tuple[str, str], str] = ALIASES) -> Column:
    """The identifier, or the one it is an alias of in its document. The map is a literal, so no join is needed."""
    out = source_id
    for (d, i), name in aliases.items():
        out = F.when((document == d) & (source_id == i), F.lit(name)).otherwise(out)
    return out


def uid(document: Column, requirement_id: Column) -> Column:
    return F.concat_ws(":", document, requirement_id)


def records(docs: DataFrame, version: str, text: str = "content", cells: DataFrame | None = None, aliases: dict[tuple[str, str], str] = ALIASES) -> DataFrame:
    """The 17 fields of each requirement of the documents (file_name, document_id, agency, domain, ``text``), in order of document, table and block.

    NULL or empty documents give no rows; a document that is registered twice gives its rows twice, which the audit reports.
    """
    d = docs.withColumn("sha256", F.sha2(F.encode(F.col(text), "UTF-8"), 256))
    cells = extract.parse_tables(d, "document_id", text) if cells is None else cells
    r = extract.requirements(cells, "document_id").join(d.select("document_id", "agency", "domain", "file_name", "sha256"), "document_id")
    rid = canonical_id(F.col("document_id"), F.col("source_requirement_id"), aliases)
    r = r.withColumnRenamed("requirement_id", "source_requirement_id").withColumn("requirement_id", rid)
    return r.select(
        F.lit(version).alias("dataset_version"), "document_id", "agency", "domain", uid(F.col("document_id"), F.col("requirement_id")).alias("requirement_uid"), "requirement_id", "source_requirement_id",
        "requirement_type", "requirement_name", F.col("body").alias("raw_requirement_text"), F.col("body").alias("normalized_requirement_text"), F.col("file_name").alias("source_file"),
        F.concat(F.lit("markdown_line:"), F.col("block_line")).alias("source_location"), (F.col("table") + 1).alias("source_table_index"), F.col("block").alias("source_block_index"),
        F.col("sha256").alias("source_sha256"), F.col("adapter").alias("extraction_adapter")).orderBy("document_id", "source_table_index", "source_block_index")


def id_mismatches(rows: DataFrame) -> DataFrame:
    """Records whose identifier isn't the one in their source."""
    return rows.where(~F.col("requirement_id").eqNullSafe(F.col("source_requirement_id")))


def review_queue(rows: DataFrame, different: DataFrame) -> DataFrame:
    """Review fields of every difference between index and records (``extract.differences`` by document_id and requirement_id) and of the first, middle, last and longest record of each document.

    A difference without a record gets a made-up key and the file of the document's first record. Human fields are empty.
    """
    place = ("source_table_index", "source_block_index")
    known = rows.groupBy("document_id", "requirement_id").agg(F.max_by(F.struct("requirement_uid", "source_file", "source_location"), F.struct(*place)).alias("r"))
    file = rows.groupBy("document_id").agg(F.min_by("source_file", F.struct(*place)).alias("file"))
    j = different.select("document_id", "requirement_id", "reason").join(known, ["document_id", "requirement_id"], "left").join(file, "document_id", "left")
    differences = j.select("document_id", F.coalesce("r.requirement_uid", uid(F.col("document_id"), F.col("requirement_id"))).alias("requirement_uid"), "requirement_id", "reason", F.coalesce("r.source_file", "file", F.lit("")).alias("source_file"), F.coalesce("r.source_location", F.lit("")).alias("source_location"))
    order = F.struct(*place, "requirement_uid")
    edges = profile.edge_rows(rows.withColumn("_at", order), "document_id", "_at", "raw_requirement_text").withColumn("requirement_uid", F.col("_at.requirement_uid"))
    edges = edges.select("document_id", "_at", F.concat(F.lit("document_"), F.col("reason")).alias("reason")).join(rows.withColumn("_at", order).drop("document_id"), "_at")
    empty = [F.lit("").alias(c) for c in REVIEW_HUMAN]
    return differences.select(*REVIEW_MACHINE, *empty).unionByName(edges.select(*REVIEW_MACHINE, *empty))


def audit(rows: DataFrame, documents: DataFrame, compared: DataFrame) -> DataFrame:
    """One row of counters over records, registered documents (document_id) and their comparison (``extract.resolve``): the lists of the report are ``audit_lists``."""
    blank = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
    r = rows.agg(F.count(F.lit(1)).alias("record_count"), F.countDistinct("document_id").alias("document_count"), blank("requirement_name").alias("missing_name_count"), blank("raw_requirement_text").alias("missing_body_count"))
    twice = profile.duplicate_keys(rows, "requirement_uid").agg(F.count(F.lit(1)).alias("duplicate_uid_count"))
    none = documents.select("document_id").distinct().join(rows.select("document_id").distinct(), "document_id", "left_anti").agg(F.count(F.lit(1)).alias("empty_document_count"))
    has = F.col("index_count") > 0
    c = compared.agg(
        F.count_if("exact").alias("index_exact_match_document_count"), F.count_if(has & ~F.col("exact")).alias("index_mismatch_document_count"), F.count_if(~F.col("exact") & has & F.col("resolved")).alias("index_policy_resolved_document_count"),
        F.count_if(has & ~F.col("resolved")).alias("unresolved_index_mismatch_document_count"), F.count_if(~has).alias("document_without_index_count"))
    out = r
    for one in (twice, none, c):
        out = out.join(one, F.lit(True))  # single rows
    return out


def audit_lists(rows: DataFrame, documents: DataFrame, compared: DataFrame) -> DataFrame:
    """(list, item, n) in long form: records by document and by adapter, records without name or body, repeated keys, documents without records, without an index, exact and unresolved ones."""
    tag = lambda d, name, item, n=1: d.select(F.lit(name).alias("list"), F.col(item).alias("item"), (F.col(n) if isinstance(n, str) else F.lit(n)).cast("bigint").alias("n"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    has = F.col("index_count") > 0
    parts = [
        tag(profile.counts(rows, "document_id"), "records_by_document", "document_id", "n"), tag(profile.counts(rows, "extraction_adapter"), "records_by_adapter", "extraction_adapter", "n"),
        tag(rows.where(blank("requirement_name")), "missing_name_uids", "requirement_uid"), tag(rows.where(blank("raw_requirement_text")), "missing_body_uids", "requirement_uid"),
        tag(profile.duplicate_keys(rows, "requirement_uid"), "duplicate_uids", "requirement_uid", "n"),
        tag(documents.select("document_id").distinct().join(rows.select("document_id").distinct(), "document_id", "left_anti"), "empty_documents", "document_id"),
        tag(compared.where(F.col("exact")), "index_exact_match_documents", "document_id"), tag(compared.where(~has), "documents_without_index_ids", "document_id"),
        tag(compared.where(has & ~F.col("resolved")), "unresolved_index_mismatch_documents", "document_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class StrictBuild(ValueError):
    """Counters that a strict build doesn't allow."""


def require_strict(audited: DataFrame) -> DataFrame:
    one = audited.first().asDict()
    bad = {c: one[c] for c in STRICT if one[c]}
    if bad:
        raise StrictBuild(str(bad))
    return audited
