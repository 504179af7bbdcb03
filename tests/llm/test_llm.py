import datetime as dt
import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheafwork.llm import components, consensus, cross_split, grouped_split, leakage, mixing, near_dup, page_spam, quota_sample, splitting, value_mapping
from sheafwork.llm.words import words
from sheafwork.session import table

T0 = dt.datetime(2026, 1, 1)
LABEL = "requirement_uid string, document_id string, requirement_type string, requirement_type_source string, raw_requirement_text string, primary_action string, cost_basis string, build_difficulty string, blockers array<string>, built_at timestamp"
#: Extra columns whose names the operators use inside.
CLASH = ("record", "text", "words", "key", "value", "doc", "action", "token", "term", "score", "tokens", "h", "bin", "id", "band", "chunk", "split", "position", "_t", "_s", "n")


def labels(spark, rows):
    """rows: dicts; the rest NULL; extra columns with clashing names."""
    fields = [f.split()[0] for f in LABEL.split(", ")]
    df = spark.createDataFrame([tuple(r.get(f, T0 if f == "built_at" else None) for f in fields) for r in rows], LABEL)
    return clash(df)


def clash(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def catalog(spark):
    return clash(spark.createDataFrame([(1, "기능", "Functional", "SFR", ["업무 기능"]), (2, "보안", "Security", "SER", None), (3, "제약사항", "Constraint", "COR", ["법규 준수"])], "type_id int, type_name string, name_en string, id_prefix string, aliases array<string>"))


# --- problem 1


def test_mapping(spark, catalog):
    means = {"기능": 1, "업 무　기능요구 사항": 1, "Funtcional": 1, "업무 기늑 외 3건": 1, "SFR 항목": 1, "3.1 보안(Security)": 2, "제약": 3, "제먁사항 요구사항": 3, "\"보​안\"": 2, "봄맞이": 0, "asdf": 0, "-": 0, "Zobel-686 담당": 0, "보안 담당자 문의": 0, "기" * 5000: 0}
    x = [{"requirement_uid": f"u{i}", "requirement_type": v, "requirement_type_source": "none"} for i, v in enumerate(means)]
    x += x[:2] + [{"requirement_uid": "blank", "requirement_type": " \t　", "requirement_type_source": "none"}, {"requirement_uid": "null", "requirement_type_source": "none"}, {"requirement_uid": "known", "requirement_type": "기능", "requirement_type_source": "text"}, {"requirement_type": "기능", "requirement_type_source": "none"}]
    got = dict(rows(value_mapping.mapped_requirements(labels(spark, x), catalog)))
    assert got == {f"u{i}": t for i, t in enumerate(means.values())}


def test_mapping_by_words(spark):
    catalog = clash(spark.createDataFrame([(1, "프로젝트 관리", "Project Management", "PMR", None), (2, "학습모형", "Machine Learning Model", "MLR", ["모형 학습", None]), (3, "보안 통제", "Security", "SER", [])], "type_id int, type_name string, name_en string, id_prefix string, aliases array<string>"))
    means = {"관리 프로젝트": 1, "Management Project": 1, "Managment of the Project": 1, "PROJECT-MANAGEMENT": 1, "프로젝트관리": 1, "Model: Machine Learning": 2, "Machne Lernin Modl": 2, "학습 모형 (Machine Learning Model)": 2, "SER 보안 통제": 3, "Project": 0, "보안 담당자 문의": 0, "the of": 0}
    got = {r.value: (r.type_id, r.score) for r in value_mapping.map_values(clash(spark.createDataFrame([(v,) for v in [*means, None]], "value string").withColumnRenamed("value", "v").withColumn("value", F.col("v"))), catalog).collect()}
    assert {v: t for v, (t, _) in got.items()} == means and all(0 <= x <= 1 for _, x in got.values()) and got["Management Project"][1] == 1


def test_mapping_of_nothing(spark, catalog):
    assert rows(value_mapping.mapped_requirements(labels(spark, []), catalog)) == []
    x = labels(spark, [{"requirement_uid": "a", "requirement_type": "기능", "requirement_type_source": "none"}])
    assert rows(value_mapping.mapped_requirements(x, catalog.where("false"))) == [("a", 0)]


@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9))
@settings(max_examples=150, deadline=None)
def test_neighbourhoods_find_every_close_pair(a, b):
    d = value_mapping.edit_distance(a, b)
    assert d == value_mapping.edit_distance(b, a) and (d == 0) == (a == b)
    if d <= value_mapping.edits_allowed(len(b)):
        assert set(value_mapping.deletions(a)) & set(value_mapping.deletions(b))


# --- problem 2


@given(st.text(alphabet="ab. \n\t가", min_size=0, max_size=400), st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=300, deadline=None)
def test_pieces_round_trip(text, limit, overlap):
    p = splitting.pieces(text, limit, overlap)
    assert all(e - b <= limit for b, e, _ in p) and p[0][0] == 0 and p[-1][1] == len(text)
    assert text[: p[0][1]] + "".join(text[before[1] : now[1]] for before, now in zip(p, p[1:])) == text
    assert all(now[0] >= before[1] - overlap and now[0] <= before[1] for before, now in zip(p, p[1:]))
    longest = max(map(len, __import__("re").split("[ \t\r\n]+", text)), default=0)
    assert any(f for *_, f in p) == (longest > limit)


def test_splitting(spark):
    x = labels(spark, [{"requirement_uid": u, "raw_requirement_text": t} for u, t in (("a", "가나 " * 600), ("b", "x" * 1501), ("b", "x" * 1501), ("c", "y" * 1500), ("d", None), ("e", ""), ("f", "ab cd\n" * 60_000), (None, "z" * 2000))])
    assert rows(splitting.split_kinds(x)) == [("a", "natural"), ("b", "forced"), ("f", "natural")]
    p = splitting.split_texts(x).where("requirement_uid = 'f'").agg(F.max(F.length("text")), F.min(F.when(F.col("piece") > 0, F.col("overlap")))).first()
    assert tuple(p) == (1500, 100)
    assert splitting.split_texts(labels(spark, [])).count() == 0


# --- problem 3


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("hub", f"s{i:03}") for i in range(50)] + [("q", "q"), (None, "r"), ("p000", "p001")]
    got = dict(rows(components.components(spark.createDataFrame(edges, "u string, v string"))))
    assert got == brute_components([(u, v) for u, v in edges if u and v and u != v])
    assert components.components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_grouped_split(spark, data):
    x, d = clash(table(spark, data, "label_dataset_v2")), clash(table(spark, data, "source_docs"))
    s = grouped_split.grouped_split(x, d)
    assert s.count() == x.select("requirement_uid").distinct().count()
    assert s.groupBy("procurement").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    docs = "document_id string, notice_no string, supersedes_document_id string, source_sha256 string"
    reg = spark.createDataFrame([("a", "2024-0000001-00", None, None), ("b", "제2024-0000001호", None, "AB" * 32), ("c", None, "d.md", "ab" * 32), (None, None, None, None), ("z", "", " ", "n/a"), ("y", "x", "", "n/a")], docs)
    y = labels(spark, [{"requirement_uid": str(i), "document_id": v} for i, v in enumerate(["A", "b.md", "c ", "D", "d", "z", "y", None, "--", "a", "a"])])
    pairs = rows(grouped_split.same_procurement(y, clash(reg)))
    assert pairs == sorted(p for p in itertools.combinations(sorted(["A", "b.md", "c ", "D", "d", "a"]), 2))
    assert rows(grouped_split.same_procurement(labels(spark, []), reg)) == [] and rows(grouped_split.same_procurement(y, reg.where("false"))) == [("A", "a"), ("D", "d")]


# --- problem 4


def brute_quotas(need, floor, have, size):
    """Best cells by trying all: most places filled (real before unfilled), floors kept, fewest trimmed and refilled."""
    total = [sum(h) for h in have]
    margin = max(size, sum(min(f, n, t) for f, n, t in zip(floor, need, total)))
    want = min(margin, sum(total), max(size, sum(min(n, t) for n, t in zip(need, total))))
    best = None
    for x in itertools.product(*[range(t + 1) for t in total]):
        if sum(x) == want and all(a >= min(f, n, t) for a, f, n, t in zip(x, floor, need, total)):
            off = sum(max(0, min(n, t) - a) + max(0, a - n) for a, n, t in zip(x, need, total))
            best = off if best is None else min(best, off)
    return want, best


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.lists(st.integers(0, 3), min_size=2, max_size=2)), min_size=1, max_size=3), st.integers(0, 12))
@settings(max_examples=150, deadline=None)
def test_quotas_against_brute_force(cells, size):
    need, floor, have = ([c[i] for c in cells] for i in range(3))
    got, short = quota_sample.quotas(need, floor, have, size)
    assert short == [max(0, n - sum(h)) for n, h in zip(need, have)]
    assert all(0 <= q <= h for g, r in zip(got, have) for q, h in zip(g, r))
    x = [sum(g) for g in got]
    want, best = brute_quotas(need, floor, have, size)
    assert sum(x) == want and all(a >= min(f, n, sum(h)) for a, f, n, h in zip(x, floor, need, have))
    assert sum(max(0, min(n, sum(h)) - a) + max(0, a - n) for a, n, h in zip(x, need, have)) == best


def test_quotas_share_the_margin():
    # the margin binds: one unit above the floors is trimmed though records are there
    assert [sum(g) for g in quota_sample.quotas([6, 5], [0, 5], [[9], [9]], 10)[0]] == [5, 5]
    # a shortfall is refilled from the other actions, in proportion to their targets
    got, short = quota_sample.quotas([8, 8, 4], [0, 0, 0], [[2], [40], [40]], 20)
    assert short == [6, 0, 0] and sum(map(sum, got)) == 20 and sum(got[1]) > 8 and sum(got[2]) > 4
    # the second class keeps its share
    assert quota_sample.quotas([4, 4], [0, 0], [[10, 10], [10, 10]], 8)[0] in ([[2, 2], [2, 2]], [[4, 0], [0, 4]], [[0, 4], [4, 0]], [[1, 3], [3, 1]], [[3, 1], [1, 3]])


def test_quota_sample(spark):
    x = [{"requirement_uid": f"a{i}", "document_id": "Doc-1.md", "primary_action": "통상 수용"} for i in range(20)] + [{"requirement_uid": "b", "document_id": "doc_1", "primary_action": "견적반영"}] * 3
    x += [{"requirement_uid": "c", "document_id": "doc_1", "primary_action": "통상수용", "built_at": T0}, {"requirement_uid": "c", "document_id": "doc_1", "primary_action": "견적반영", "built_at": T0 + dt.timedelta(1)}, {"requirement_uid": "n"}, {"document_id": "doc_1"}]
    t = spark.createDataFrame([("doc_1", "통상수용", 0.5, 1, 10), ("doc_1", "견적반영", 0.5, 1, 10), ("doc_2", "견적반영", 1.0, 2, 0), ("doc_3", "견적반영", None, None, None), (None, None, 1.0, 1, 1)], "document_id string, primary_action string, target_share double, min_rows int, sample_size int")
    assert rows(quota_sample.shortfalls(labels(spark, x), clash(t)).where("document_id is not null")) == [("doc_1", "견적반영"), ("doc_2", "견적반영")]
    drawn = quota_sample.draw(labels(spark, x), clash(t))
    assert dict(rows(drawn.groupBy("primary_action").count())) == {"통상수용": 8, "견적반영": 2}  # the three that are missing are refilled
    assert {(r.primary_action, r.need, r.available, r.quota, r.shortfall) for r in quota_sample.report(labels(spark, x), clash(t)).where("document_id = 'doc_1'").collect()} == {("통상수용", 5, 20, 8, 0), ("견적반영", 5, 2, 2, 3)}
    assert rows(quota_sample.shortfalls(labels(spark, x), t.where("false"))) == []
    assert len(rows(quota_sample.shortfalls(labels(spark, []), t.where("document_id = 'doc_1'")))) == 2


# --- problems 5 and 6


def close_pairs(texts, least=0.7):
    sets = {u: (set(w), len(w)) for u, t in texts for w in [words(t)]}
    big = sorted(u for u, (_, n) in sets.items() if n >= 10)
    return {(a, b) for a, b in itertools.combinations(big, 2) if len(sets[a][0] & sets[b][0]) >= least * len(sets[a][0] | sets[b][0])}


def near_texts():
    base = " ".join(f"낱말{i}" for i in range(30))
    edit = base.replace("낱말7 ", "다른 ").replace("낱말20 ", "")
    turned = " ".join(reversed(base.split()))
    short = "하나 둘 셋 넷 다섯 여섯 일곱 여덟 아홉"
    return [("a", base), ("b", base), ("c", edit), ("d", turned), ("e", short), ("f", short), ("g", short + " 열"), ("h", short + "\n열!"), ("i", None), ("j", ""), ("k", "긴글 " * 50_000), ("l", "긴글\t" * 50_000), ("m", "ＡＢ " + base), ("a", base)]


def test_near_duplicates(spark, data):
    x = labels(spark, [{"requirement_uid": u, "raw_requirement_text": t} for u, t in near_texts()] + [{"raw_requirement_text": "x " * 20}])
    none = spark.createDataFrame([], "requirement_uid string, normalized_requirement_text string")
    assert set(rows(near_dup.near_duplicate_requirements(x, none))) == close_pairs(near_texts())
    assert rows(near_dup.near_duplicate_requirements(labels(spark, []), none)) == []
    real, anchors = table(spark, data, "label_dataset_v2"), table(spark, data, "anchor_candidates_quote")
    texts = rows(near_dup.collection(real, anchors).where("text is not null").distinct())
    assert set(rows(near_dup.near_duplicate_requirements(real, anchors))) == close_pairs(texts)


def test_near_duplicate_groups(spark):
    x = labels(spark, [{"requirement_uid": u, "raw_requirement_text": t} for u, t in near_texts()])
    g = near_dup.groups(near_dup.collection(x, spark.createDataFrame([], "requirement_uid string, normalized_requirement_text string"))).collect()
    by = {r.record: r for r in g}
    assert len(by) == len(g) and len({by[u].group_id for u in "abcdm"}) == 1 and by["a"].class_id == by["d"].class_id != by["c"].class_id and by["g"].group_id == by["h"].group_id != by["a"].group_id


def test_densified_bins_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(1, 2**63, n, dtype=np.uint64) for n in (70, 15, 15))
    x, y = np.concatenate([common, a]), np.concatenate([common, b])
    sig = near_dup.one_permutation(np.array([0, 85, 170, 170]), np.concatenate([x, y]), 1200, near_dup.densify_plan(1200))
    assert abs((sig[0] == sig[1]).mean() - 0.7) < 0.12 and (sig[2] == near_dup._EMPTY).all()


def test_cross_split_overlaps(spark, data):
    x = labels(spark, [{"requirement_uid": u, "raw_requirement_text": t, "document_id": "d"} for u, t in near_texts()])
    kind = {"a": "train", "b": "validation", "c": "test", "d": "train", "g": "train", "h": "test", "k": "train", "l": "test", "m": "validation", "i": "train", "j": "test"}
    s = clash(spark.createDataFrame([*kind.items(), ("a", "train"), ("x", None), (None, "test")], "requirement_uid string, split string").withColumnRenamed("split", "s2").withColumn("split", F.col("s2")))
    want = {p for p in close_pairs(near_texts()) if {"train"} < {kind.get(u, "train") for u in p} and all(u in kind for u in p)}
    assert set(rows(cross_split.overlapping_pairs(x, s))) == want
    classes = {(r.requirement_uid, r.held): (r.class_id, r.links) for r in cross_split.overlap_classes(x, s).collect()}
    assert {u for u, _ in classes} == {u for p in want for u in p} and classes["a", False] == classes["d", False] and classes["a", False][0] == classes["b", True][0]
    report = {(r.split, r.document_id): r.records for r in cross_split.overlap_report(x, s).collect()}
    assert report[("test", "d")] >= 2
    assert rows(cross_split.overlapping_pairs(labels(spark, []), s)) == []


def test_cross_split_against_brute_force(spark, data):
    real, split = table(spark, data, "label_dataset_v2"), table(spark, data, "split_assignment")
    texts = rows(real.where("raw_requirement_text is not null").select("requirement_uid", "raw_requirement_text").distinct())
    kind = dict(rows(split.select("requirement_uid", "split").distinct()))
    want = {p for p in close_pairs(texts) if all(u in kind for u in p) and (kind[p[0]] == "train") != (kind[p[1]] == "train")}
    assert set(rows(cross_split.overlapping_pairs(real, split))) == want


def spread_edits(seed=11):
    """Pairs at an overlap of at least 0.7 whose edits are spread over the text."""
    rng = np.random.default_rng(seed)
    out = []
    for n, add, drop, swap in [(10, 4, 0, 0), (14, 0, 4, 0), (11, 3, 0, 0), (30, 12, 0, 0), (12, 0, 0, 2), (500, 200, 0, 0)]:
        for i in range(20):
            tag = f"n{n}a{add}d{drop}s{swap}i{i}"
            a = [f"{tag}w{k}" for k in range(n)] if i % 2 else [f"공통{int(k)}" for k in rng.choice(2000, n, replace=False)]
            b = list(a)
            for k in sorted(rng.choice(n, drop + swap, replace=False), reverse=True):
                b[k : k + 1] = [f"{tag}x{k}"] * (1 if swap else 0)
            for k in range(add):
                b.insert(int(rng.integers(len(b) + 1)), f"{tag}y{k}")
            out += [(f"{tag}-a", " ".join(a)), (f"{tag}-b", " ".join(b))]
    out += [("r-a", " ".join(f"r{k}" for k in range(40))), ("r-b", " ".join(f"r{k}" for k in reversed(range(40))))]
    return out


def test_cross_split_finds_spread_edits(spark):
    texts = spread_edits()
    x = spark.createDataFrame(texts, "record string, text string")
    split = spark.createDataFrame([(u, u.endswith("b")) for u, _ in texts], "record string, held boolean")
    want = {p for p in close_pairs(texts) if p[0][-1] != p[1][-1]}
    assert len(want) >= 101 and ("r-a", "r-b") in want
    assert {(r.train, r.held) for r in cross_split.overlaps(x, split).collect()} == want
    shared = {(r.train, r.held): r.shared for r in cross_split.shared_share(x, cross_split.overlaps(x, split)).collect()}
    assert set(shared) == want and shared["r-a", "r-b"] == 0 and max(shared.values()) > 0.3


# --- problem 7


def test_consensus_finds_truth_and_spammers(spark):
    rng = np.random.default_rng(3)
    actions = ["통상수용", "견적반영", "계약·질의검토"]
    kinds = "status string, requirement_uid string, annotator_id string, received_at timestamp, label struct<primary_action: string, blockers: array<string>, cost_basis: string>"
    out, truth = [], {}
    for i in range(150):
        truth[f"u{i}"] = actions[int(rng.integers(3))]
        for j, skill in enumerate([0.95, 0.95, 0.9, 0.05, 0.05]):
            value = truth[f"u{i}"] if rng.random() < skill else actions[0]
            out.append(("ok", f"u{i}", f"r{j}", T0, (value.replace("·", "/") + " ", ["기술실현성", "기술실현성"] if j < 3 else [], None if j else "없음")))
    out += [("error", "u0", "r0", T0, None), ("ok", None, "r0", T0, out[0][4]), ("ok", "u0", "r1", T0 - dt.timedelta(1), (actions[1], None, None)), out[0], ("ok", "nul", "r0", T0, (None, None, None))]
    df = clash(spark.createDataFrame(out, kinds))
    items, people = consensus.consensus(df)
    got = {r.requirement_uid: r for r in items.where("field = 'primary_action'").collect()}
    assert sum(got[u].value == t.replace("·", "") for u, t in truth.items()) >= 147 and "nul" not in got
    assert {r.value for r in items.where("field = 'blockers'").collect()} == {"기술실현성"}
    skill = {r.annotator_id: r.competence for r in people.where("field = 'primary_action'").collect()}
    assert min(skill["r0"], skill["r1"], skill["r2"]) > 0.7 > 0.4 > max(skill["r3"], skill["r4"])
    now = labels(spark, [{"requirement_uid": u, "primary_action": t if u != "u1" else "엉뚱", "blockers": ["기술실현성"] if u != "u2" else [], "cost_basis": "없음"} for u, t in truth.items()])
    found = set(rows(consensus.disputed(df, now)))
    assert {("u1", "primary_action"), ("u2", "blockers")} <= found and len(found) <= 5
    items, people = consensus.consensus(df.where("false"))
    assert items.count() == 0 and people.count() == 0


def test_consensus_takes_labels_and_blockers_from_the_data(spark):
    kinds = "status string, requirement_uid string, annotator_id string, received_at timestamp, label struct<primary_action: string, blockers: array<string>, cost_basis: string>"
    out = [("ok", f"u{i}", f"r{j}", T0, (f"label {i if j else i + 1}", ["New one", "b"] if i % 2 else [], f"cost{i}")) for i in range(120) for j in range(3)]
    items, people = consensus.consensus(spark.createDataFrame(out, kinds))
    got = {(r.requirement_uid, r.field): (r.value, round(r.agreement, 3)) for r in items.collect()}
    assert all(got[f"u{i}", "primary_action"] == (f"label{i}", 0.667) and got[f"u{i}", "cost_basis"] == (f"cost{i}", 1) and got[f"u{i}", "blockers"] == ("b|newone" if i % 2 else "", 1) for i in range(120))
    assert {r.field for r in people.collect()} == {"primary_action", "cost_basis", "blockers:b", "blockers:newone"}


# --- problem 8


def test_leaks(spark, data):
    text = "각 기관은 12 대의 서버를 Abc-77 기반으로 30 일 안에 설치하고 결과를 빠짐없이 보고하며 매주 점검한다"
    items = clash(spark.createDataFrame([(1, text), (2, None), (3, "짧은 글"), (1, text)], "item_id bigint, text string").withColumnRenamed("text", "t").withColumn("text", F.col("t")))
    docs = [(1, "앞 " + text + " 뒤"), (2, text.replace("12", "15").replace("30", "45")), (3, text.replace("기반으로", "바탕으로")), (4, None), (5, ""), (6, "다른 말 " * 100_000), (7, text.upper().replace(" ", "\n"))]
    d = spark.createDataFrame([*docs, (None, text)], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in leakage.leaks(d, items).collect()}
    assert got == {(1, 1): True, (2, 1): False, (7, 1): True}
    for bits in (6, 20):  # a filter that lets all through, a roomy one
        assert got == {(r.doc_id, r.item_id): r.verbatim for r in leakage.leaks(d, items, filter_bits=bits).collect()}
    assert leakage.leaked_items(d, items.where("false")).count() == 0 and leakage.leaked_items(d.where("false"), items).count() == 0
    real, ev = table(spark, data, "documents"), table(spark, data, "eval_items")
    grams = {}
    for i, t in rows(ev.select("item_id", "text")):
        w = words(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(doc, i) for doc, t in rows(real.select("doc_id", "text")) for w in [words(t)] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    assert set(rows(leakage.leaked_items(real, ev))) == want


def test_leaks_with_other_names_and_units(spark):
    text = "담당자는 Galve-40 장비를 10GB 용량으로 구성하고 30 일 안에 한빛진흥원을 방문하여 Torin 서버의 결과를 5시간마다 점검하고 보고한다"
    english = "The supplier must deliver the Galve-40 unit within 30 days and keep 10GB of logs for each site it runs there"
    items = spark.createDataFrame([(1, text), (2, english)], "item_id bigint, text string")
    other = [
        text.replace("Galve-40", "Zomi-12"), text.replace("10GB", "2TB"), text.replace("30 일", "6 주"), text.replace("한빛진흥원을", "푸른솔협회를"), text.replace("Torin", "Kelda"), text.replace("5시간마다", "20분마다"),
        text.replace("Galve-40", "Zomi-12").replace("10GB", "2TB").replace("30 일", "6 주").replace("한빛진흥원을", "푸른솔협회를").replace("Torin", "Kelda").replace("5시간마다", "20분마다"),
    ]
    docs = [*other, english.replace("Galve-40", "Zomi-12").replace("30 days", "6 weeks").replace("10GB", "2TB"), text.replace("장비를", "기계를").replace("방문하여", "찾아가").replace("결과를", "상태를")]
    got = {(r.doc_id, r.item_id): r.windows for r in leakage.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), items).collect()}
    assert set(got) == {(i, 1) for i in range(7)} | {(7, 2)}
    n = len(words(text)) - 11
    assert all(got[i, 1] == n for i in (1, 2, 3, 5)) and got[6, 1] >= n - 2  # a name whose neighbour is outside the window is none


# --- problem 9


def test_mixing(spark):
    d = [(i, "가나다 라마바 " * 30, "Big ") for i in range(40)] + [(100 + i, "가나다 라마바 " * 30, "small") for i in range(4)] + [(200, None, "small"), (201, "", "small"), (202, "글", None), (203, "글", "  "), (204, "글", "other")]
    docs = clash(spark.createDataFrame(d, "doc_id bigint, text string, source string"))
    w = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("gone", 0.1, 5), ("zero", 0.0, None)], "source string, target_share double, max_repeats int")
    assert rows(mixing.short_sources(docs, clash(w))) == [("gone",), ("small",)]
    m = mixing.mix(docs, clash(w)).collect()
    assert [r.position for r in m] == sorted(r.position for r in m) and all(0 <= r.position < 1 for r in m)
    use = {}
    for r in m:
        use.setdefault(r.source, []).append(r.use)
    assert max(use["small"]) == 1 and len(use["small"]) == 8 and max(use["big"]) == 0 and abs(len(use["big"]) - 22) <= 1
    assert max(r.position for r in m if r.source == "small") < 0.9  # it runs dry
    assert rows(mixing.short_sources(docs.where("false"), w)) == [] and mixing.mix(docs.where("false"), w).count() == 0
    other = {r.source: (r.short, r.mixed_tokens) for r in mixing.mix_report(docs, w, tokenizer="/opt/tokenizers/byte_bpe_50k.tiktoken").collect()}
    assert {k: v[0] for k, v in other.items()} == {"big": False, "small": True, "gone": True, "zero": False} and other["gone"][1] == other["zero"][1] == 0


def test_mixing_follows_the_schedule(spark):
    docs = spark.createDataFrame([(i, "가나다 라마바 " * 10, "ab"[i % 2]) for i in range(800)], "doc_id bigint, text string, source string")
    w = spark.createDataFrame([("A ", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    points = [("a", 0.0, 0.0), ("a", 0.5, 2.0), ("a", 1.0, 0.0), ("a", 1.5, 9.0), ("a", 0.2, -1.0), (None, 0.1, 1.0), ("b", 0.3, None)]
    m = mixing.mix(docs, w, spark.createDataFrame(points, "source string, at double, weight double")).collect()
    a, b = (sorted(r.position for r in m if r.source == x) for x in "ab")
    assert len(a) == len(b) == 400 and all(0 <= x < 1 for x in a + b)
    # the share of a laid before t is the integral of its tent, that of b is even
    for t in (0.1, 0.25, 0.5, 0.75, 0.9):
        assert abs(sum(x < t for x in a) / 400 - (2 * t * t if t <= 0.5 else 1 - 2 * (1 - t) ** 2)) < 0.01 and abs(sum(x < t for x in b) / 400 - t) < 0.01
    shares = {r.source: r.actual_share for r in mixing.mix_report(docs, w).collect()}
    assert shares == {"A ": 0.5, "b": 0.5}
    assert mixing.ramped(w).count() == 0 and mixing.ramped(w, 1).count() == 4


# --- problem 10


def test_spam_pages(spark):
    ok = "담당자는 매월 운영 현황을 점검하고 결과를 보고한다. 장애가 생기면 즉시 복구하여야 한다. 모든 기록은 규정에 따라 안전하게 보관한다."
    en = "The operators shall review the records before the handover. When alerts change, each team must export its budgets within two days."
    bad = ["서버 가격 " * 60, "\n".join(f"https://a{i}.example/x" for i in range(40)), "홈 > 상품 > 공지 > 인기 > " * 20, "#태그하나 #태그둘 #태그셋 " * 15, ok[:40] + "\n" + "\n".join(f"가게{i} 노트북 최저가" for i in range(40)), "<a href='http://x.example'>구매</a> " * 30]
    good = [ok, en, ok + "\n홈 > 공지", "\n".join(f"- {x}" for x in ok.split(". ")), " ".join(f"{i}번 담당자는 매월 운영 현황을 점검하고 결과를 보고한다." for i in range(3000))]
    good += [
        "Die Lieferanten müssen die Geräte bis zum Ende des Monats an die Behörde liefern. Der Auftraggeber prüft die Unterlagen und meldet Fehler nach dem Test an das Team.",
        "Le fournisseur doit livrer les appareils avant la fin du mois. Le client vérifie les documents et signale les erreurs à l'équipe après le test.",
        "この契約は、発注者と受注者の間で締結される。受注者は期限までに製品を納入しなければならない。検査に合格しない場合は、速やかに交換する。",
        "供应商应在月底之前交付设备。客户检查文件并将错误报告给团队。如有问题，应及时更换。",
        "Поставщик должен передать оборудование заказчику до конца месяца. Заказчик проверяет документы и сообщает об ошибках команде.",
        "Toimittajan on toimitettava laitteet asiakkaalle ennen kuukauden loppua. Asiakas tarkistaa asiakirjat ja ilmoittaa virheistä tiimille.",
    ]
    bad += ["\n".join(f"Laptop Preis {i} kaufen" for i in range(40)), "cheap laptops best laptops laptop deals " * 15]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *bad, None, "", " \n"])], "doc_id bigint, text string")
    assert {r[0] for r in page_spam.spam_pages(clash(d.withColumn("lang", F.lit("xx")))).collect()} == set(range(len(good), len(good) + len(bad)))
    assert page_spam.spam_pages(d.where("false")).count() == 0


def test_spam_signs_decide_by_themselves(spark):
    rng = np.random.default_rng(5)
    pick = lambda stem, n: [f"{stem}{int(k)}" for k in rng.integers(0, 3000, n)]
    korean = lambda: "{}를 {}에서 {}과 {} 점검하고 {}를 보고한다.".format(*pick("업무", 5))
    english = lambda: "The {} shall review each {} before it can {} the {} of {}.".format(*pick("word", 5))
    good = [" ".join(f() for _ in range(int(rng.integers(3, 15)))) for f in (korean, english) for _ in range(60)] + ["담당자가 확인하고 보고한다.", "The team shall wait for the team."]
    bad = [
        ("keywords", " ".join(f"노트북은 {a} 노트북을 {b} 노트북 노트북 산다." for a, b in zip(pick("상품", 20), pick("상점", 20)))),
        ("keywords", " ".join(f"The laptop laptop of {a} is laptop for laptop {b} laptop." for a, b in zip(pick("x", 20), pick("y", 20)))),
        ("repeated lines", "\n".join([korean()] * 2 + [korean()] * 2 + [english()] * 3 + [korean()] * 3)),
        ("tags", " ".join(f"#{a} #{b} #{c} #{d} 하고 있는 것." for a, b, c, d in zip(*(pick("꼬리", 12) for _ in range(4))))),
        ("no sentences", " ".join("The " + " ".join(pick("word", 12)) + " of the " + " ".join(pick("word", 5)) + "." for _ in range(6))),
    ]
    d = spark.createDataFrame(list(enumerate([*good, *(t for _, t in bad)])), "doc_id bigint, text string")
    got = {r.doc_id: (r.reason, r.listed_share) for r in page_spam.spam_scores(d).where("spam").collect()}
    assert {k: v[0] for k, v in got.items()} == {len(good) + i: x for i, (x, _) in enumerate(bad)}
    assert all(listed <= 0.5 for _, listed in got.values())  # the build of their sentences tells nothing


def test_queries_are_registered():
    from sheafwork.llm import queries

    q = queries.queries()
    assert all(f"p{n}_found" in q for n in range(1, 11)) and set(queries.oracle_sql()) <= set(q)
    assert math.isclose(sum(s for _, s in grouped_split.SHARES), 1)


def test_against_sql(spark, data):
    import glob
    import os

    import duckdb

    from sheafwork.llm import queries

    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, data)
        names = sorted(got.columns)
        want = c.execute(sql)
        at = [x[0] for x in want.description]
        assert names == sorted(at) and rows(got.select(*names)) == sorted((tuple(r[at.index(n)] for n in names) for r in want.fetchall()), key=repr), name
