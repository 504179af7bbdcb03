"""The cosine self-join: blocks of rows, no pair that merely meets is shuffled."""

import contextlib
import io
import math
import random
from collections import Counter

import pytest

from sheafwork.operators import cosine, retrieval
from sheafwork.plans import catalog

ODD = [None, "", " ", "a", "ab", "a　b c", "İ x", "\U0001f600 \U0001f600\U0001f600", "별첨 참조", "별첨  참조\n", "추후 협의하여 확정"]


def texts(n: int) -> list:
    draw = random.Random(5)
    words = ["".join(draw.choice("가나다라마바사아자차abc") for _ in range(draw.randrange(1, 6))) for _ in range(60)]
    out = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 14))) for _ in range(n)]
    return out + [t.replace(" ", "  ", 1) + " " + draw.choice(words) for t in out[::3]] + ODD + ODD


def brute(rows: list[tuple], threshold: float) -> dict:
    counted = {i: retrieval.text_terms(t)[1] for i, _, t in rows}
    df = Counter(g for c in counted.values() for g in c)
    vec = {}
    for i, c in counted.items():
        v = {g: (1 + math.log(k)) * (math.log((1 + len(rows)) / (1 + df[g])) + 1) for g, k in c.items() if df[g] >= 2}
        size = math.sqrt(sum(x * x for x in v.values()))
        vec[i] = {g: x / size for g, x in v.items()}
    docs = {i: d for i, d, _ in rows}
    sims = {(a, b): sum(x * vec[b].get(g, 0.0) for g, x in vec[a].items()) for a in vec for b in vec if a < b and docs[a] != docs[b]}
    return {k: s for k, s in sims.items() if s >= threshold}


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def rows():
    return [(f"u{i:04d}", None if i % 11 == 0 else f"d{i % 7}", t) for i, t in enumerate(texts(150))]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, doc string, text string").repartition(3)


def test_grams_of_many_texts_are_those_of_each():
    all_texts = texts(80)
    terms, begin, ids, tf = cosine.gram_rows(all_texts)
    name = {}
    for i, t in enumerate(all_texts):
        want = retrieval.text_terms(t)[1]
        got = dict(zip(ids[begin[i] : begin[i + 1]].tolist(), tf[begin[i] : begin[i + 1]].tolist()))
        assert sorted(got.values()) == sorted(want.values())
        name |= {g: name.get(g, set(got)) & set(got) for g in want}
    assert len(terms) == len(name) and all(name.values())


def test_a28_pairs_that_merely_meet_are_not_shuffled(spark, frame, rows, monkeypatch):
    monkeypatch.setattr(cosine, "BLOCK_CHARS", 700)
    monkeypatch.setattr(cosine, "SCORES", 500)
    for threshold in (0.03, 0.5, 0.6, 0.95):
        want = brute(rows, threshold)
        pairs = retrieval.cosine_join(frame, threshold)
        got = {(r.left, r.right): r.sim for r in pairs.collect()}
        assert want and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert "Exchange" not in plan(pairs)
    best = {}
    for (a, b), s in brute(rows, 0.5).items():
        best[a], best[b] = max(best.get(a, 0), s), max(best.get(b, 0), s)
    swept = retrieval.swept(retrieval.cosine_join(frame, 0.5), frame)
    assert plan(swept).count("CartesianProduct") == 1  # pairs are made once
    assert {r.threshold: r.rows for r in swept.collect()} == {t: sum(s >= t for s in best.values()) for t in (0.9, 0.8, 0.6, 0.5)}


def test_join_of_no_rows_and_of_texts_without_terms(spark):
    kind = "id bigint, doc string, text string"
    assert retrieval.cosine_join(spark.createDataFrame([], kind), 0.5).count() == 0
    assert retrieval.cosine_join(spark.createDataFrame([(1, "a", ""), (2, "b", None), (None, "c", "abc")], kind), 0.5).count() == 0
    got = retrieval.cosine_join(spark.createDataFrame([(2, "a", "abc"), (1, None, "abc"), (3, None, "abc"), (4, "b", "xyz")], kind), 0.5).collect()
    assert {(r.left, r.right) for r in got} == {(1, 2), (2, 3)}  # NULL documents count as equal


def test_x12_label_pairs_shuffles_no_pairs(spark, data, frame, rows, monkeypatch):
    monkeypatch.setattr(cosine, "TERMS", 40)
    want = brute(rows, 0.6)
    assert {(r.left, r.right) for r in retrieval.cosine_join(frame, 0.6).collect()} == set(want)
    made = plan(catalog.queries()["x12_label_pairs"](spark, data))
    assert made.count("CartesianProduct") == 1 and "Exchange" not in made


def test_o9_most_similar_makes_the_pairs_once(spark, data):
    made = plan(catalog.queries()["o9_most_similar"](spark, data))
    assert made.count("CartesianProduct") == 1 and "SortMergeJoin" not in made and "TakeOrdered" in made


def test_a29_pair_agreement_makes_the_pairs_once(spark, frame, rows):
    want, label = brute(rows, 0.5), {i: len(t or "") % 3 for i, _, t in rows}
    pairs = retrieval.cosine_join(frame, 0.5)
    agreed = retrieval.label_agreement(pairs, spark.createDataFrame(list(label.items()), "id string, label int"))
    assert plan(agreed).count("CartesianProduct") == 1
    got = agreed.first()
    assert got.pairs == len(want) and abs(got.agree - sum(label[a] == label[b] for a, b in want) / len(want)) < 1e-12


def test_w8_nearest_neighbour_makes_the_pairs_once(frame, rows):
    best = {}
    for (a, b), s in sorted(brute(rows, 0.5).items()):
        for x, y in ((a, b), (b, a)):
            best[x] = min(best.get(x, (0, "~")), (-round(s, 6), y))
    near = retrieval.nearest(retrieval.cosine_join(frame, 0.5).selectExpr("left", "right", "round(sim, 6) as sim"))
    assert plan(near).count("CartesianProduct") == 1
    assert {r.id: r.other for r in near.collect()} == {x: y for x, (_, y) in best.items()}


def test_a30_exposure_makes_the_pairs_once(frame, rows):
    hit = {i for k in brute(rows, 0.5) for i in k}
    found = retrieval.exposure(retrieval.cosine_join(frame, 0.5), frame, "doc")
    assert plan(found).count("CartesianProduct") == 1
    docs = {d for _, d, _ in rows}
    assert {r.doc: (r.rows, r.exposed) for r in found.collect()} == {d: (sum(x == d for _, x, _ in rows), sum(x == d and i in hit for i, x, _ in rows)) for d in docs}


def test_x12_cosine_pairs_shuffles_no_pairs(spark, data):
    made = plan(catalog.queries()["x12_cosine_pairs"](spark, data))
    assert made.count("CartesianProduct") == 1 and "Exchange" not in made
