"""Document build, assembly, pools, samplers and comparisons on small fixtures with known results."""

import json

import pytest
from pyspark.sql import functions as F

from sheafwork.operators import assembly, build, compare, extract, labeling, pool, profile, retrieval, rules, runs, sampling
from sheafwork.sources import readers, writers


def cell_table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


DETAIL = cell_table(("요구사항 고유번호", "SFR-001"), ("요구사항 명칭", "이름"), ("세부내용", "본문 SFR-099"))


def test_index_ids(spark):
    one = "# 요구사항 목록\n" + cell_table(("SFR-001", "가"), ("SFR-002", "나")) + "\n## 요구사항 세부내용\n" + cell_table(("SFR-099", "x")) + "\n" + DETAIL
    two = "요구사항 총괄표\n" + cell_table(("OLD-001",)) + "\n**요구사항 상세**\n글\n<p>요구사항 정의 및 목록표</p>\n" + cell_table(("SFR-001",)) + "\n" + cell_table(("SFR-002",), ("SFR-002",)) + "\n" + DETAIL + "\n" + cell_table(("SFR-003",))
    none = "<td>요구사항 목록</td>\n" + cell_table(("SFR-001",))
    d = spark.createDataFrame([("one", one), ("two", two), ("none", none), ("null", None), ("empty", "")], "document_id string, content string")
    got = {}
    for r in build.index_ids(d, "document_id", "content").orderBy("document_id", "position").collect():
        got.setdefault(r.document_id, []).append(r.requirement_id)
    assert got == {"one": ["SFR-001", "SFR-002"], "two": ["SFR-001", "SFR-002", "SFR-002"]}
    h = spark.createDataFrame([("## **요구사항 목록** |",), ("<b>제목</b>",), ("<tr><td>x</td></tr>",)], "t string").select(build.heading_text(F.col("t"))).collect()
    assert [r[0] for r in h] == ["요구사항 목록", "제목", ""]


def source(spark, rows):
    return spark.createDataFrame(rows, "file_name string, document_id string, agency string, domain string, content string")


def test_records_queue_and_audit(spark):
    text = "글\n" + cell_table(("구분", "기능"), ("요구사항 고유번호", "CUR-CM--001"), ("요구사항명", "가"), ("세부내용", "짧다"), ("요구사항 분류", "보안"), ("요구사항 ID", "SER-002"), ("요구사항명", "나"), ("상세내용", "더 긴 본문"), ("요구사항 고유번호", "SER-003"), ("요구사항명", "다"))
    d = source(spark, [("a.md", "incheon_airport_digital_work", None, "공항", text), ("b.md", "empty", "기관", "d", "없음"), ("c.md", "nul", None, None, None)])
    r = build.records(d, "v9").collect()
    assert [(x.requirement_uid, x.source_requirement_id, x.requirement_type, x.requirement_name, x.raw_requirement_text, x.source_block_index, x.extraction_adapter) for x in r] == [
        ("incheon_airport_digital_work:CUR-CM-001", "CUR-CM--001", "기능", "가", "짧다", 1, "labeled_id"), ("incheon_airport_digital_work:SER-002", "SER-002", "보안", "나", "더 긴 본문", 2, "labeled_id"), ("incheon_airport_digital_work:SER-003", "SER-003", None, "다", None, 3, "labeled_id")]
    assert len(r[0]) == 17 and r[0].source_location == "markdown_line:2" and r[0].agency is None and len(r[0].source_sha256) == 64
    rows = build.records(d, "v9").cache()
    index = spark.createDataFrame([("incheon_airport_digital_work", x) for x in ("CUR-CM-001", "SER-002", "SER-002", "SFR-999")], "document_id string, requirement_id string")
    both = (index, rows.select("document_id", "requirement_id"), "document_id", "requirement_id")
    different = extract.differences(*both)
    q = {(x.reason, x.requirement_id): x for x in build.review_queue(rows, different).collect()}
    assert {k for k in q if not k[0].startswith("document")} == {("index_only", "SFR-999"), ("detail_only", "SER-003"), ("duplicate_index", "SER-002")}
    assert q["index_only", "SFR-999"].requirement_uid == "incheon_airport_digital_work:SFR-999" and q["index_only", "SFR-999"].source_file == "a.md" and q["index_only", "SFR-999"].source_location == ""
    assert {k for k in q if k[0].startswith("document")} == {("document_first", "CUR-CM-001"), ("document_middle", "SER-002"), ("document_last", "SER-003"), ("document_longest", "SER-002")}
    accepted = spark.createDataFrame([("incheon_airport_digital_work", "duplicate_index", "SER-002"), ("incheon_airport_digital_work", "detail_only", "SER-003")], "document_id string, reason string, requirement_id string")
    policy = extract.resolve(extract.reconcile(*both), extract.apply_policy(different, accepted, "document_id", "requirement_id"), "document_id")
    a = build.audit(rows, d, policy).first()
    assert (a.record_count, a.missing_name_count, a.missing_body_count, a.duplicate_uid_count, a.empty_document_count, a.index_mismatch_document_count, a.unresolved_index_mismatch_document_count) == (3, 0, 1, 0, 2, 1, 1)
    listed = {(x.list, x.item) for x in build.audit_lists(rows, d, policy).collect()}
    assert ("empty_documents", "empty") in listed and ("missing_body_uids", "incheon_airport_digital_work:SER-003") in listed
    with pytest.raises(build.StrictBuild, match="missing_body_count"):
        build.require_strict(build.audit(rows, d, policy))
    assert [x.requirement_id for x in build.id_mismatches(rows).collect()] == ["CUR-CM-001"]


def test_review_queue_is_written_over_the_old_one(spark, tmp_path):
    path = str(tmp_path / "queue")
    kinds = ", ".join(f"{c} string" for c in (*build.REVIEW_MACHINE, *build.REVIEW_HUMAN))
    row = lambda place, note="": spark.createDataFrame([("d", "d:1", "1", "index_only", "f", place, "", "", "", "", "", note, "", "")], kinds)
    keys = ("document_id", "requirement_id", "reason")
    writers.upsert_reviews(row("old", "kept, with\n\"quotes\""), path, keys, build.REVIEW_HUMAN)
    writers.upsert_reviews(row("new"), path, keys, build.REVIEW_HUMAN)
    got = readers.reviews(spark, path).collect()
    assert len(got) == 1 and got[0].source_location == "new" and got[0].review_note.startswith("kept, with")


LABEL = "struct<requirement_uid: string, primary_action: string, blockers: array<string>, cost_basis: string, domain_dependency: string, build_difficulty: string, reasoning: string>"


def result(spark, *rows):
    return spark.createDataFrame([(s, u, (u, a, b, c, "보통", "보통", "r") if s == "ok" else None) for s, u, a, b, c in rows], f"status string, requirement_uid string, label {LABEL}")


def test_assembly(spark):
    req = spark.createDataFrame([(u, "d", None, None, "SFR-001", "기능", "n", "t") for u in ("d:1", "d:2", "d:3")], "requirement_uid string, " + ", ".join(f"{c} string" for c in assembly.REQUIREMENT_FIELDS))
    a = result(spark, ("ok", "d:1", "통상수용", [], "라이선스"), ("error", "d:2", None, None, None))
    b = result(spark, ("ok", "d:2", "통상 수용", [], "없음"))
    union = assembly.require_clean(assembly.union_runs([("a", "동기", a), ("b", "배치", b)]), req)
    rows = {r.requirement_uid: r for r in assembly.assemble(union, req, "v2").collect()}
    assert set(rows) == {"d:1", "d:2"} and rows["d:1"].source_run == "a" and rows["d:2"].execution_path == "배치" and len(rows["d:1"]) == 21
    assert (rows["d:1"].primary_action, rows["d:1"].primary_action_model, rows["d:1"].rule_corrected) == ("견적반영", "통상수용", True) and not rows["d:2"].rule_corrected
    c = assembly.corrections(assembly.assemble(union, req, "v2")).collect()
    assert [(r.requirement_uid, r.model, r.rule) for r in c] == [("d:1", "통상수용", "견적반영")]
    with pytest.raises(assembly.OverlappingRuns, match="d:1"):
        assembly.require_clean(assembly.union_runs([("a", "동기", a), ("c", "배치", a)]), req)
    with pytest.raises(assembly.UnknownRequirement, match="d:9"):
        assembly.require_clean(assembly.union_runs([("a", "동기", result(spark, ("ok", "d:9", "통상수용", [], "없음")))]), req)
    ds = assembly.assemble(union, req, "v2")
    h = assembly.content_hash(ds).first()
    assert h == assembly.content_hash(ds.repartition(3)).first() and h.rows == 2 and h.sha256 != assembly.content_hash(ds.withColumn("agency", F.lit("x"))).first().sha256
    assert {tuple(r) for r in assembly.manifest_counts(ds).where("column = 'source_run'").collect()} == {("source_run", "a", 1), ("source_run", "b", 1)}


def anchor(**more):
    base = {"requirement_uid": "d:1", "document_id": "d", "requirement_name": "n", "raw_requirement_text": "t", "primary_action": "통상수용", "reasoning": "r", "review_status": "검토완료", "pool_version": "v1"}
    return json.dumps({**base, **more}, ensure_ascii=False)


def load(spark, *lines):
    return pool.checked(pool.from_lines(spark.createDataFrame([(x,) for x in lines], "value string")))


def test_anchor_pool(spark, tmp_path):
    ok = load(spark, anchor(), " ", anchor(requirement_uid="d:2", review_status="후보"))
    assert [r.requirement_uid for r in ok.collect()] == ["d:1"]
    for lines, why in [((anchor(pool_version="v2"), anchor()), "several versions"), ((anchor(), anchor()), "repeated"), ((anchor(primary_action="x"),), "unknown primary_action"), ((anchor(review_status="x"),), "unknown review_status"), ((anchor(reasoning=""),), "missing fields: reasoning"), (("{",), "no JSON object"), ((anchor(review_status="후보"),), "no reviewed"), ((" ",), "empty pool")]:
        with pytest.raises(pool.PoolError, match=why):
            load(spark, *lines)
    assert {(r.action, r.n, r.missing) for r in pool.metadata(ok).collect()} == {("통상수용", 1, False), ("견적반영", 0, True), ("계약·질의검토", 0, True)}
    with pytest.raises(pool.PoolError, match="no anchor of"):
        pool.require_labels(ok)
    three = spark.createDataFrame([("a", None, ""), ("b", "late", ""), ("c", "x", "")], "requirement_uid string, source_run string, pool_version string")
    got = {(r.pool_version, r.requirement_uid) for r in pool.versions(three, three.where("requirement_uid = 'b'"), "late").collect()}
    assert got == {("v1", "b"), ("v2", "a"), ("v2", "c"), ("v3", "a"), ("v3", "b"), ("v3", "c")}
    writers.write_versions(pool.versions(three, three.where("requirement_uid = 'b'"), "late"), str(tmp_path / "pools"))
    assert sorted(p.name for p in (tmp_path / "pools").glob("pool_version=*")) == [f"pool_version=v{i}" for i in (1, 2, 3)]


def test_samplers(spark):
    kinds = ["기능", "성능", "보안", "데이터", None]
    rows = [(f"d{i}:{j}", f"d{i}", f"SFR-{j}", f"SFR-{j}" if (i, j) != (3, 2) else "X-1", kinds[j], "가 | 나" if (i, j) == (4, 1) else "글" * (1 + i + 7 * j)) for i in range(10) for j in range(5)]
    r = spark.createDataFrame(rows, "requirement_uid string, document_id string, requirement_id string, source_requirement_id string, requirement_type string, raw_requirement_text string")
    s = sampling.pilot_sample(r, F.coalesce("requirement_type", F.lit("x"))).collect()
    by = {x.requirement_uid: x.why for x in s}
    assert len(s) == len(by) == 40 and by["d3:2"] == "id_exception" and by["d4:1"] == "nested_table" and by["d9:4"] == by["d8:4"] == "longest" and by["d0:0"] == "shortest"
    per = {d: sum(x.document_id == d for x in s) for d in {x.document_id for x in s}}
    assert len(per) == 10 and min(per.values()) >= 3
    assert sampling.pilot_sample(r.where("false"), F.col("requirement_type")).count() == 0
    q = sampling.quota_sample(r, "document_id", "requirement_type", {"기능": 1, "성능": 0}, 3).collect()
    assert len(q) == 30 and sum(x.stage == "quota" for x in q) == 10 and {x.requirement_type for x in q if x.stage == "quota"} == {"기능"}
    b = spark.createDataFrame([("1", "d", "글"), ("2", "d", "◦ 항목"), ("3", "d", "줄\n- 항목"), ("4", "e", None)], "requirement_uid string, document_id string, raw_requirement_text string")
    assert [(x.requirement_uid, x.rank) for x in sampling.bullets_first(b, 2).orderBy("document_id", "rank").collect()] == [("2", 1), ("3", 2), ("4", 1)]
    assert sampling.longest(b).first().requirement_uid == "3" and sampling.longest(b.where("false")).count() == 0
    files = spark.createDataFrame([("x", 5), ("y", 5), ("z", 9)], "file_name string, size int")
    assert [x.requirement_uid for x in sampling.of_largest_document(spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "y")], "requirement_uid string, source_file string"), files).orderBy("requirement_uid").collect()] == ["2", "3"]
    c = sampling.random_control(spark.createDataFrame([("t", "d")], "target string, doc string"), spark.createDataFrame([("a", "d"), ("b", "e"), ("c", None)], "anchor string, doc string"), 5).collect()
    assert {x.anchor for x in c} == {"b", "c"} and sorted(x.rank for x in c) == [1, 2]


def test_positions_and_first_n(spark):
    rows = spark.createDataFrame([(f"{i:03}", "hot" if i % 3 else None) for i in range(200)], "k string, g string").repartition(5)
    got = {(r.g, r.k): r.position for r in profile.positions(rows, "g", "k").collect()}
    for g in ("hot", None):
        names = sorted(k for x, k in got if x == g)
        assert [got[g, k] for k in names] == list(range(1, len(names) + 1))
    assert [r.k for r in profile.first_n(rows, ("g",), (F.col("k").desc(),), 2, by="k").where("g is null").orderBy("rank").collect()] == ["198", "195"]
    assert profile.positions(rows.where("false"), "g", "k").count() == 0


def test_comparisons(spark):
    votes = spark.createDataFrame([("u", "a")] * 3 + [("v", "a"), ("v", "b"), ("v", "a"), ("w", "a"), ("x", None), ("x", None), ("x", None)], "k string, v string")
    assert {(r.k, r.unanimous, r.v) for r in compare.screened(votes, "k", "v").collect()} == {("u", True, "a"), ("v", False, None), ("x", True, "")}
    a, b = (spark.createDataFrame(x, "k string, v string, why string") for x in ([("1", "x", "p"), ("2", "x", "q"), ("3", None, "")], [("1", "y", "r"), ("2", "x", "s"), ("3", None, "")]))
    assert [tuple(r) for r in compare.changed(a, b, "k", "v", "why").collect()] == [("1", "x", "p", "y", "r")]
    with pytest.raises(Exception, match="no answer for 3"):
        compare.against_gold(a, b.where("k <> '3'"), "k", "v").collect()
    assert sum(r.agrees for r in compare.against_gold(a, b, "k", "v").collect()) == 2
    s = compare.side_by_side(a, b, "v", ("y", "z", "x"), ("before", "after")).orderBy("place").collect()
    assert [tuple(r)[1:] for r in s] == [("y", 0, 1, 1), ("z", 0, 0, 0), ("x", 2, 1, -1)]
    assert {tuple(r) for r in compare.merged_counts(a.where("k <> '3'"), b.where("k = '1'"), "k", "v").collect()} == {("y", 1, 1), ("x", 1, 2)}
    assert {tuple(r) for r in compare.preview(spark.createDataFrame([("t",), ("n",)], "target string"), spark.createDataFrame([("t", "l"), ("t", "l")], "target string, label string")).collect()} == {("anchors", "2", 1), ("anchors", "0", 1), ("label", "l", 2), ("empty", "targets", 1)}
    r = spark.createDataFrame([("s1",), ("s1",), (None,)], "system string")
    assert sorted(x.n for x in compare.prefix_cardinality(r).collect()) == [1, 2]


def test_retrieval_plans_agree(spark):
    texts = ["서버 도입 수량", "서버  도입\t비용", "AI-플랫폼 1식 구축", "", None, "a", "서버서버서버 ab abc abcd", "서버 도입 수량 수량 수량"]
    p = spark.createDataFrame([(f"a{i}", f"d{i % 3}", ["통상수용", "견적반영", None][i % 3], i, t) for i, t in enumerate(texts)], "anchor string, doc string, label string, pos int, text string")
    t = spark.createDataFrame([(f"t{i}", None if i == 2 else f"d{i % 4}", x) for i, x in enumerate(texts)], "target string, doc string, text string")
    small, large = ({(r.target, r.anchor, r.label, r.pos): round(r.sim, 9) for r in retrieval.similarities(t, p, most).collect()} for most in (100, 1))
    assert small == large and len(small) > 10
    s = retrieval.stratified(retrieval.similarities(t, p), ("견적반영", "계약·질의검토", "통상수용")).where("target = 't0'").orderBy("rank").collect()
    best = sorted((-x, pos, a) for (t_, a, _, pos), x in small.items() if t_ == "t0")
    assert s[0].label == "견적반영" and all(r.label != "통상수용" for r in s)  # its own document has all of those
    assert [r.anchor for r in s[1:]] == [a for *_, a in best if a != s[0].anchor][:2]  # the other places are filled from the top of all
    g = retrieval.global_anchors(t, p, spark.createDataFrame([("통상수용", "a3", 1), ("통상수용", "a0", 2)], "label string, anchor string, rank int"))
    assert {r.anchor for r in g.collect()} == {"a3"} or {r.anchor for r in g.collect()} <= {"a3", "a0"}


def test_anchors_used(spark):
    p = spark.createDataFrame([("a", "d1", "통상수용", 0, "서버 도입", "이름", "서버 도입", "r"), ("b", "d2", "견적반영", 1, "서버 비용", "이름", "서버 비용", "r")], "anchor string, doc string, label string, pos int, text string, requirement_name string, raw_requirement_text string, reasoning string")
    t = spark.createDataFrame([("t", "x", "서버 도입 수량"), ("n", "x", "zzz")], "target string, doc string, text string")
    got = {r.target: r.anchors for r in retrieval.anchors_used(t, p, "similarity").collect()}
    assert [a.requirement_uid for a in got["t"]] == ["a", "b"] and "서버 도입" in got["t"][0].overlap_terms and got["t"][0].similarity == round(got["t"][0].similarity, 4) and got["n"] == []
    fixed = {r.target: r.anchors for r in retrieval.anchors_used(t, p, "global").collect()}
    assert [a.similarity for a in fixed["n"]] == [0.0, 0.0] and fixed["n"][0].overlap_terms == []
    req = labeling.requests(t.select(F.col("target").alias("requirement_uid"), F.lit("n").alias("requirement_name"), F.col("text").alias("raw_requirement_text")), retrieval.anchors_used(t, p, "global").withColumnRenamed("target", "requirement_uid"))
    assert "사례 2" in req.first().system


def test_label_dataset_is_written_with_its_manifest(spark, tmp_path):
    req = spark.createDataFrame([(u, "d", None, None, "SFR-001", "기능", "n", "t") for u in ("d:2", "d:1")], "requirement_uid string, " + ", ".join(f"{c} string" for c in assembly.REQUIREMENT_FIELDS))
    runs_ = assembly.union_runs([("a", "동기", result(spark, ("ok", "d:1", "통상수용", [], "라이선스"), ("ok", "d:2", "통상수용", [], "없음")))])
    m = writers.write_label_dataset(assembly.assemble(runs_, req, "v2"), str(tmp_path / "ds"), "2026-01-01", {"requirements": "0" * 64})
    assert m["row_count"] == 2 and m["counts"]["primary_action"] == {"견적반영": 1, "통상수용": 1} and [c["requirement_uid"] for c in m["rule_corrections"]] == ["d:1"]
    lines = [json.loads(x) for f in sorted((tmp_path / "ds/data").glob("*.json")) for x in f.read_text().splitlines()]
    assert [x["requirement_uid"] for x in lines] == ["d:1", "d:2"] and all(len(x) == 21 for x in lines)


def test_dense_search_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)] + [(200, [0.0] * 4)]
    d = spark.createDataFrame(v, "id bigint, v array<float>").repartition(4)
    q = d.where("id % 10 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    one, many = ({tuple(r) for r in retrieval.dense_top_k(q, d, 5, block).collect()} for block in (1000, 3))
    unit = {i: np.array(x) / (np.linalg.norm(x) or 1) for i, x in v}
    want = set()
    for i in range(0, 120, 10):
        if np.any(unit[i]):
            best = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j in unit if j != i and np.any(unit[j]))[:5]
            want |= {(i, j, k + 1) for k, (_, j) in enumerate(best)}
    assert one == many == want
    assert retrieval.dense_top_k(q.where("false"), d, 5).count() == 0


def test_near_duplicate_analysis(spark):
    pairs = spark.createDataFrame([("a", "b", 0.95), ("a", "c", 0.7), ("b", "d", 0.55)], "left string, right string, sim double")
    rows = spark.createDataFrame([(x, "d1" if x in "ab" else "d2", "l" if x in "abe" else "m") for x in "abcde"], "id string, doc string, label string")
    assert [(r.threshold, r.rows, r.share) for r in retrieval.swept(pairs, rows).orderBy(F.desc("threshold")).collect()] == [(0.9, 2, 0.4), (0.8, 2, 0.4), (0.6, 3, 0.6), (0.5, 4, 0.8)]
    assert {(r.id, r.other) for r in retrieval.nearest(pairs).collect()} == {("a", "b"), ("b", "a"), ("c", "a"), ("d", "b")}
    assert tuple(retrieval.label_agreement(pairs, rows.select("id", "label")).first()) == (3, 1 / 3)
    assert {(r.doc, r.rows, r.exposed) for r in retrieval.exposure(pairs, rows, "doc").collect()} == {("d1", 2, 2), ("d2", 3, 2)}
    assert [r.left for r in retrieval.most_similar(pairs, 1).collect()] == ["a"]


def test_batch_answers(spark):
    label = {"requirement_uid": "d:1", "primary_action": "통상수용", "blockers": [], "cost_basis": "없음", "domain_dependency": "보통", "build_difficulty": "보통", "reasoning": "r"}
    answer = lambda uid, text, kind="succeeded": json.dumps({"custom_id": uid, "result": {"type": kind, "message": {"content": [{"type": "thinking", "text": "x"}, *([{"type": "text", "text": text}] if text is not None else [])], "usage": {"input_tokens": 5}}, "error": "late" if kind != "succeeded" else None}}, ensure_ascii=False)
    lines = [answer("d__1", json.dumps(label)), answer("d__2", None), answer("d__3", "{"), answer("d__4", json.dumps({**label, "cost_basis": "x"})), answer("d__5", "", "errored"), answer("d__6", json.dumps({**label, "extra": 1})), ""]
    got = {r.requirement_uid: r for r in labeling.parse_batch(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert {u: (r.status, r.error_type) for u, r in got.items()} == {"d:1": ("ok", None), "d:2": ("error", "EmptyOutput"), "d:3": ("error", "NoObject"), "d:4": ("error", "ValidationError"), "d:5": ("error", "BatchError"), "d:6": ("error", "ValidationError")}
    assert got["d:1"].usage.input_tokens == 5 and got["d:4"].error.startswith("cost_basis") and "extra:extra" in got["d:6"].error and got["d:5"].error == "late"
    info = labeling.batch_info(spark.createDataFrame([("d__1", "d:1")], "custom_id string, requirement_uid string"), "b7").first()
    assert tuple(info) == ("b7", "d__1", "d:1")
    samples = spark.createDataFrame([("d:1",)], "requirement_uid string")
    m = labeling.run_manifest(samples, "x", "global", {"schema_version": "v2"}, {"model": "m"}, {"pool_version": "v1"})
    assert m["input"]["sample_count"] == 1 and m["anchoring"]["retriever"]["same_document_masking"]
    with pytest.raises(ValueError, match="limit"):
        labeling.require_settings({"limit": 0}, positive=("limit",))
    with pytest.raises(ValueError, match="exclude"):
        labeling.require_settings({"a": 1, "b": 1}, exclusive=(("a", "b"),))


def test_reports_and_settings(spark, tmp_path):
    rows = spark.createDataFrame([("d:1", "d", "1", None, "이름", "◦ 첫\n- 둘")], "requirement_uid string, document_id string, requirement_id string, requirement_type string, requirement_name string, raw_requirement_text string")
    v = writers.text_variants(rows).first()
    assert v.flat_text == "이름 첫 둘" and v.normalized_list_text == "이름\n- 첫\n- 둘"
    writers.write_dataset(rows, str(tmp_path / "out"), {"counts": profile.counts(rows, "document_id")})
    assert json.loads((tmp_path / "out/audit.json").read_text())["counts"] == [{"document_id": "d", "n": 1}] and "| d | 1 |" in (tmp_path / "out/report.md").read_text()
    part = next((tmp_path / "out/data_csv").glob("*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbf") or part.decode("utf-8").startswith("﻿") or b"\xef\xbb\xbf" in part[:8]
    assert {r.folder.rsplit("/", 1)[-1] for r in readers.inventory(spark, str(tmp_path)).collect()} >= {"out"}
    assert readers.number_setting("A", {"A": " 1,416.61 "}) == 1416.61 and readers.number_setting("A", {}) == 0
    with pytest.raises(ValueError, match="A is no number"):
        readers.number_setting("A", {"A": "x"})
    r = spark.createDataFrame([("s", "ok"), ("s", "error")], "run_name string, status string")
    assert tuple(readers.run_inventory(r).first()) == ("s", 1, 2)
    usage = spark.createDataFrame([("a", (5, 1, 0, 0)), ("b", (1, 1, 0, 0))], "strategy string, usage struct<input_tokens: bigint, output_tokens: bigint, cache_creation_input_tokens: bigint, cache_read_input_tokens: bigint>")
    summary = runs.usage_summary(runs.usage_totals(usage, "strategy"), "strategy")
    assert summary["total"]["input_tokens"] == 6 and summary["by_strategy"]["a"]["calls"] == 1
    assert rules.ACTIONS[0] == "통상수용"
