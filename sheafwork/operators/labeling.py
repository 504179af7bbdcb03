"""Label requests: anchor rendering, request rows, an injected labeler with resume. No transport is included."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.operators.rules import key_violations, messages, violations
from sheafwork.operators.runs import pending

LABEL = "struct<requirement_uid: string, primary_action: string, blockers: array<string>, cost_basis: string, domain_dependency: string, build_difficulty: string, reasoning: string>"


# Wording of a block of anchors.
CASE, SIMILARITY, SHARED, NONE, JUDGED = "사례", "유사도", "공통 어휘", "없음", "판정"
NAME, BODY, REASON = "요구사항명", "내용", "이유"


def anchor_block(anchors: Column, evidence: bool = True, header: str = "") -> Column:
    """Text block of an array of anchor structs (primary_action, similarity, overlap_terms, requirement_name, raw_requirement_text, reasoning), in the given order.

    With ``evidence`` each case names its similarity and shared terms; without, its label only, so that blocks of fixed anchors are the same for every target.
    """
    def one(a: Column, i: Column) -> Column:
        number = F.concat(F.lit(f"{CASE} "), (i + 1).cast("string"))
        shared = F.coalesce(F.nullif(F.array_join(a["overlap_terms"], ", "), F.lit("")), F.lit(NONE))
        how = F.concat(F.lit(f" ({SIMILARITY} "), F.format_number(F.coalesce(a["similarity"], F.lit(0.0)), 3), F.lit(f" / {SHARED}: "), shared, F.lit(")"))
        caption = F.concat(number, how if evidence else F.concat(F.lit(f" ({JUDGED} "), a["primary_action"], F.lit(")")))
        part = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(a[c], F.lit("")))
        return F.concat_ws("\n", F.lit(""), caption, part(NAME, "requirement_name"), part(BODY, "raw_requirement_text"), part(JUDGED, "primary_action"), part(REASON, "reasoning"))

    return F.concat_ws("\n", F.lit(header), F.array_join(F.transform(anchors, one), "\n"))


def retriever_config(word: tuple[int, int] = (1, 2), char: tuple[int, int] = (3, 4)) -> dict:
    """What a run's manifest says of the retriever."""
    return {"retriever_version": "tfidf-word-char-v1", "word_ngram_range": list(word), "char_ngram_range": list(char), "char_analyzer": "char_wb", "sublinear_tf": True, "similarity": "cosine", "same_document_masking": True}


def run_manifest(samples: DataFrame, source: str, strategy: str, versions: dict[str, str], parameters: dict, pool: dict | None = None) -> dict:
    """Conditions of a run: input and its size, strategy, versions, parameters, and for strategies with anchors how they are found."""
    out = {"input": {"path": source, "sample_count": samples.count()}, "strategy": strategy, **versions, "parameters": parameters}
    return out if pool is None else {**out, "anchoring": {"retrieval": strategy, "retriever": retriever_config(), "anchor_pool": pool}}


def require_settings(settings: dict, positive: tuple[str, ...] = (), one_of: dict[str, tuple] | None = None, exclusive: tuple[tuple[str, str], ...] = ()) -> dict:
    """The settings, or an error that names the one that is out of its domain or excludes another."""
    for name in positive:
        if not isinstance(settings.get(name), int) or settings[name] <= 0:
            raise ValueError(f"{name} must be a positive whole number")
    for name, values in (one_of or {}).items():
        if settings.get(name) not in values:
            raise ValueError(f"{name} must be one of {', '.join(map(str, values))}")
    for a, b in exclusive:
        if settings.get(a) and settings.get(b):
            raise ValueError(f"{a} and {b} exclude each other")
    return settings


def batch_info(requests: DataFrame, batch_id: str) -> DataFrame:
    """(batch_id, custom_id, requirement_uid): what a submitted batch holds, to find its answers' requirements again."""
    return requests.select(F.lit(batch_id).alias("batch_id"), "custom_id", "requirement_uid")


def parse_batch(lines: DataFrame, value: str = "value") -> DataFrame:
    """(requirement_uid, status, label, usage, error_type, error, raw_output) of a batch's answers, JSON lines of {custom_id, result: {type, message: {content: [{type, text}], usage}, error}}.

    One answer's failure (no text, text that is no label, a label that breaks the schema, an item that failed) is its own error row with the raw text; it never stops the others.
    """
    usage = "struct<input_tokens: bigint, output_tokens: bigint, cache_creation_input_tokens: bigint, cache_read_input_tokens: bigint>"
    schema = f"custom_id string, result struct<type: string, message: struct<content: array<struct<type: string, text: string>>, usage: {usage}>, error: string>"
    r = lines.where(F.trim(value) != "").select(F.from_json(value, schema).alias("r")).select("r.custom_id", "r.result")
    text = F.get(F.filter("result.message.content", lambda c: c["type"] == "text"), F.lit(0))["text"]
    r = r.withColumn("text", text).withColumn("label", F.from_json("text", LABEL)).withColumn("keys", F.json_object_keys("text"))
    fields = {f: F.col(f"label.{f}") for f in ("primary_action", "blockers", "cost_basis", "domain_dependency", "build_difficulty", "reasoning")}
    wrong = F.array_join(F.array_union(messages(F.col("label.requirement_uid"), fields), F.coalesce(key_violations(F.col("text")), F.array().cast("array<string>"))), "; ")
    done = F.col("result.type") == "succeeded"
    kind = F.when(~F.coalesce(done, F.lit(False)), "BatchError").when(F.coalesce(F.col("text"), F.lit("")) == "", "EmptyOutput").when(F.col("keys").isNull(), "NoObject").when(wrong != "", "ValidationError")
    why = F.when(~F.coalesce(done, F.lit(False)), F.coalesce("result.error", F.lit("failed"))).when(F.coalesce(F.col("text"), F.lit("")) == "", "no text block").when(F.col("keys").isNull(), "no JSON object").when(wrong != "", F.substring(wrong, 1, 400))
    ok = kind.isNull()
    return r.select(
        uid_of(F.col("custom_id")).alias("requirement_uid"), F.when(ok, "ok").otherwise("error").alias("status"), F.when(ok, F.col("label")).alias("label"), F.when(ok, F.col("result.message.usage")).alias("usage"),
        kind.alias("error_type"), why.alias("error"), F.when(~ok, F.substring("text", 1, 2000)).alias("raw_output"))


def custom_id(uid: Column) -> Column:
    return F.replace(uid, F.lit(":"), F.lit("__"))


def uid_of(custom: Column) -> Column:
    return F.replace(custom, F.lit("__"), F.lit(":"))


def requests(samples: DataFrame, anchors: DataFrame) -> DataFrame:
    """(custom_id, requirement_uid, system, user) request rows; ``anchors``: (requirement_uid, anchors)."""
    j = samples.join(anchors, "requirement_uid", "left")
    return j.select(custom_id(F.col("requirement_uid")).alias("custom_id"), "requirement_uid", F.coalesce(anchor_block(F.col("anchors")), F.lit("")).alias("system"), F.concat_ws("\n", "requirement_name", "raw_requirement_text").alias("user"))


def keyword_labeler() -> Callable[[str, str], dict]:
    """Deterministic offline labeler."""
    def label(uid: str, text: str) -> dict:
        text = text or ""
        blockers = ["범위·책임"] if "협의" in text else []
        cost = "라이선스" if "라이선스" in text else "없음"
        action = "계약·질의검토" if blockers else "견적반영" if cost != "없음" else "통상수용"
        return {"requirement_uid": uid, "primary_action": action, "blockers": blockers, "cost_basis": cost, "domain_dependency": "보통", "build_difficulty": "보통", "reasoning": "keywords"}

    return label


def run_labeler(samples: DataFrame, done: DataFrame, factory: Callable[[], Callable[[str, str], dict]] = keyword_labeler) -> DataFrame:
    """(status, requirement_uid, label, error) of the samples not done yet. The labeler is made once per partition; an item's failure is its own error row, as is a
    label that answers for another record or breaks the schema."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = factory()
        for pdf in batches:
            out = []
            for uid, text in zip(pdf["requirement_uid"], pdf["raw_requirement_text"]):
                try:
                    out.append(("ok", uid, label(uid, text), None))
                except Exception as e:  # noqa: BLE001
                    out.append(("error", uid, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["status", "requirement_uid", "label", "error"])

    todo = pending(samples, done).select("requirement_uid", "raw_requirement_text")
    r = todo.mapInPandas(run, f"status string, requirement_uid string, label {LABEL}, error string")
    bad = violations(F.col("requirement_uid"), {f: F.col(f"label.{f}") for f in ("primary_action", "blockers", "cost_basis", "domain_dependency", "build_difficulty", "reasoning")})
    why = F.when(F.col("status") != "ok", F.col("error")).when(~F.col("label.requirement_uid").eqNullSafe(F.col("requirement_uid")), "answers for another record").when(F.size(bad) > 0, F.array_join(bad, ", "))
    return r.withColumn("error", why).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error")).withColumn("label", F.when(F.col("error").isNull(), F.col("label")))
