"""TF-IDF terms, leakage-masked retrieval and the cosine self-join."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafwork.functions.text import BLANKS, compact
from sheafwork.operators.cosine import cosine_join  # noqa: F401
from sheafwork.session import cut

STRATEGIES = ("similarity", "stratified", "global")
WORD_SIZES, CHAR_SIZES = (1, 2), (3, 4)
#: Rows of a pool, and characters of its texts, up to which it is indexed once and shipped to the targets (some 100 bytes a character at most); a larger one is joined term by term. Both give the same rows.
MAX_POOL_ROWS, MAX_POOL_CHARS = 5_000, 2_000_000


def word_terms(text: Column) -> Column:
    """Words of at least two word characters, and pairs of neighbours, lower case."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def char_terms(text: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams within words padded by a blank on either side; a padded word no longer than n gives itself once and no longer n-grams."""
    def grams(word: Column) -> Column:
        p = F.concat(F.lit(" "), word, F.lit(" "))
        n = F.length(p)
        parts = []
        for i, size in enumerate(sizes):
            cut_at = partial(F.substr, p, len=F.lit(size))
            run = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda s: cut_at(s))  # noqa: B023
            parts.append(run if i == 0 else F.when(n > sizes[i - 1], run).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    c = compact(F.lower(text))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(F.split(c, " "), grams)))


def term_counts(rows: DataFrame, key: str, terms: Column, block: str) -> DataFrame:
    """(key, block, term, tf)."""
    return rows.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")).select(key, F.lit(block).alias("block"), "term", "tf")


def idf_of(counts: DataFrame, n: int, min_df: int = 1) -> DataFrame:
    """(block, term, df, idf): smoothed inverse document frequency."""
    d = counts.groupBy("block", "term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return d.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def weights(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, block, term, df, w): sublinear tf x idf, unit length per block; terms without idf are dropped."""
    raw = counts.join(idf, ["block", "term"]).withColumn("r", (1.0 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy(key, "block").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    return raw.join(norm, [key, "block"]).select(key, "block", "term", "df", (F.col("r") / F.col("norm")).alias("w"))


def _vectors(targets: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted terms of both sides in two blocks; frequencies come from the pool only."""
    n = pool.count()
    counted = lambda d, k: term_counts(d, k, word_terms(F.col("text")), "word").unionByName(term_counts(d, k, char_terms(F.col("text")), "char"))
    p = counted(pool, "anchor")
    idf = idf_of(p, n)
    return weights(counted(targets, "target"), idf, "target"), weights(p, idf, "anchor")


_WORDS = regex.compile(r"[\p{L}\p{N}_]{2,}")
_SPACES = regex.compile("[" + BLANKS + "]+")


def text_terms(text: str | None) -> tuple[Counter, Counter]:
    """Counts of the word terms and of the character terms of a text: what ``word_terms`` and ``char_terms`` give."""
    low = (text or "").lower()
    w = _WORDS.findall(low)
    chars = [g for word in _SPACES.split(low) if word for g in word_grams(word)]
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]), Counter(chars)


def word_grams(word: str) -> list[str]:
    """Character n-grams of a word padded by a blank on either side, as ``char_terms`` gives them."""
    p = f" {word} "
    n = len(p)
    return [p[k : k + size] for i, size in enumerate(CHAR_SIZES) if not i or n > CHAR_SIZES[i - 1] for k in range(max(1, n - size + 1))]


class _Grams(dict):
    """Pool positions of the n-grams of a word; forgotten when there are very many words, so memory stays bounded."""

    def __init__(self, known: dict[str, int]) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = np.array([self.known[g] for g in word_grams(word) if g in self.known], np.int64)
        return out

    def __reduce__(self):
        return _Grams, (self.known,)


class PoolIndex:
    """Inverted index of a small pool: postings (anchor, weight) of each term of the two blocks, words and pairs of words, and n-grams."""

    def __init__(self, texts: list[str | None]) -> None:
        n = len(texts)
        counted = [text_terms(t) for t in texts]
        self.blocks = np.array([sum(bool(c) for c in two) for two in counted])
        self.known, self.idf, self.begin, self.anchor, self.weight = [], [], [], [], []
        for b in range(2):
            df = Counter(t for two in counted for t in two[b])
            at = {t: i for i, t in enumerate(df)}
            idf = np.log((1.0 + n) / (1.0 + np.array(list(df.values()), float))) + 1.0 if df else np.zeros(0)
            rows = []
            for i, two in enumerate(counted):
                ids = np.array([at[t] for t in two[b]], np.int64)
                w = (1 + np.log(np.array(list(two[b].values()), float))) * idf[ids] if len(ids) else np.zeros(0)
                rows.append((ids, np.full(len(ids), i), w / (np.sqrt(w @ w) or 1.0)))
            ids, who, w = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0) for k in range(3))
            order = np.argsort(ids, kind="stable")
            self.known.append(at)
            self.idf.append(idf)
            self.begin.append(np.searchsorted(ids[order], np.arange(len(at) + 1)))
            self.anchor.append(who[order].astype(np.int64))
            self.weight.append(w[order])
        self.grams = _Grams(self.known[1])

    def _found(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the terms of a text that the pool has, with repeats, in either block. A pair of words is there only if both words are."""
        low = (text or "").lower()
        known = self.known[0]
        w = _WORDS.findall(low)
        own = [known.get(x, -1) for x in w]
        pairs = [known.get(f"{a} {b}", -1) for a, b, x, y in zip(w, w[1:], own, own[1:]) if x >= 0 and y >= 0]
        chars = [self.grams[x] for x in _SPACES.split(low) if x]
        words = np.array(own + pairs, np.int64)
        return words[words >= 0], np.concatenate(chars) if chars else words[:0]

    def cosines(self, text: str | None) -> np.ndarray:
        """Cosine of the joint vectors of a text and every anchor."""
        total, own = np.zeros(len(self.blocks)), 0
        for b, ids in enumerate(self._found(text)):
            if not len(ids):
                continue
            own += 1
            tf = np.bincount(ids, minlength=0)
            at = np.flatnonzero(tf)
            w = (1 + np.log(tf[at])) * self.idf[b][at]
            w /= np.sqrt(w @ w)
            begin = self.begin[b][at]
            size = self.begin[b][at + 1] - begin
            pos = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            total += np.bincount(self.anchor[b][pos], self.weight[b][pos] * np.repeat(w, size), len(total))
        return total / np.sqrt(np.maximum(1, own) * np.maximum(1, self.blocks))


def similarities(targets: DataFrame, pool: DataFrame, most_rows: int = MAX_POOL_ROWS, best: int | None = None) -> DataFrame:
    """(target, anchor, label, pos, sim): cosine of the joint vectors, positive ones only, never within one document (NULL documents count as equal).

    With ``best`` a small pool gives the most similar anchors of each target, so many, and the most similar of each label only: what ``top_k`` and ``stratified`` look at.

    ``targets``: (target, doc, text); ``pool``: (anchor, doc, label, pos, text). A pool of a checked small size is indexed and scored per Arrow batch of targets, without
    any shuffle; a larger one is joined term by term. A joint vector has length sqrt(number of its non-empty blocks).
    """
    kept = pool.select(F.col("anchor").cast("string").alias("anchor"), "doc", "label", F.col("pos").cast("bigint").alias("pos"), "text").limit(most_rows + 1).collect()
    if len(kept) > most_rows or sum(len(r.text or "") for r in kept) > MAX_POOL_CHARS:
        return _joined_similarities(targets, pool)
    index, docs = PoolIndex([r.text for r in kept]), [r.doc for r in kept]
    code = {d: i for i, d in enumerate(dict.fromkeys(docs))}
    own = np.array([code[d] for d in docs], np.int64)
    place = np.array([r.pos for r in kept], np.int64)
    kind = np.unique([r.label or "" for r in kept], return_inverse=True)[1] if kept else own
    names = pa.array([r.anchor for r in kept], pa.string()), pa.array([r.label for r in kept], pa.string()), pa.array([r.pos for r in kept], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, text = b.column(1).to_pylist(), b.column(2).to_pylist()
            for begin in range(0, b.num_rows, 256):  # a bounded number of pairs at a time
                who, hit, sims = [], [], []
                for i in range(begin, min(begin + 256, b.num_rows)):
                    s = index.cosines(text[i])
                    at = np.flatnonzero((s > 0) & (own != code.get(doc[i], -1)))
                    if best is not None:
                        at = at[np.lexsort((place[at], -s[at]))]
                        at = at[np.union1d(np.arange(min(best, len(at))), np.unique(kind[at], return_index=True)[1])]
                    who.append(np.full(len(at), i)), hit.append(at), sims.append(s[at])
                at = pa.array(np.concatenate(hit).astype(np.int64))
                cols = [b.column(0).take(pa.array(np.concatenate(who).astype(np.int64))), *[c.take(at) for c in names], pa.array(np.concatenate(sims))]
                yield pa.RecordBatch.from_arrays(cols, ["target", "anchor", "label", "pos", "sim"])

    return targets.select(F.col("target").cast("string").alias("target"), F.col("doc"), "text").mapInArrow(run, "target string, anchor string, label string, pos bigint, sim double")


def _joined_similarities(targets: DataFrame, pool: DataFrame) -> DataFrame:
    t, p = _vectors(targets, pool)
    blocks = lambda d, k, name: d.groupBy(k).agg(F.countDistinct("block").alias(name))
    dot = t.join(p.withColumnRenamed("w", "v").drop("df"), ["block", "term"]).groupBy("target", "anchor").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    s = dot.join(blocks(t, "target", "bt"), "target").join(blocks(p, "anchor", "ba"), "anchor")
    s = s.join(targets.select("target", F.col("doc").alias("tdoc")), "target").join(pool.select("anchor", "doc", "label", "pos"), "anchor")
    s = s.where(~F.col("tdoc").eqNullSafe(F.col("doc")) & (F.col("dot") > 0))
    return s.select("target", "anchor", "label", "pos", (F.col("dot") / F.sqrt(F.col("bt") * F.col("ba"))).alias("sim"))


def top_k(sims: DataFrame, k: int = 3) -> DataFrame:
    """The k most similar anchors of each target; ties by pool position."""
    w = Window.partitionBy("target").orderBy(F.desc("sim"), "pos")
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stratified(sims: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """The best anchor of each label, in the labels' order; where labels have none, others from the top of all anchors (twice as many as labels) fill up to one per label."""
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    r = sims.withColumn("k", F.row_number().over(Window.partitionBy("target", "label").orderBy(F.desc("sim"), "pos"))).withColumn("top", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("sim"), "pos")))
    chosen = (F.col("k") == 1) & F.col("label").isin(*labels)
    r = r.where(chosen | (F.col("top") <= 2 * len(labels))).withColumn("order", F.when(chosen, place).otherwise(F.lit(len(labels)) + F.col("top")))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("order"))).where(F.col("rank") <= len(labels)).drop("k", "top", "order")


def global_anchors(targets: DataFrame, pool: DataFrame, priority: DataFrame | None = None) -> DataFrame:
    """Per target and label the first anchor of another document in order of priority; sim 0. ``priority``: (label, anchor, rank), by default the pool's order.

    The first anchor per label and the first of another document suffice, so the join has two rows per label at most.
    """
    p = pool if priority is None else pool.drop("label").join(priority, "anchor").withColumn("pos", F.col("rank"))
    by_doc = p.groupBy("label", "doc").agg(F.min(F.struct("pos", "anchor")).alias("b"))
    two = by_doc.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("b"))).where("k <= 2").select("label", "doc", "b.pos", "b.anchor")
    x = targets.select("target", F.col("doc").alias("tdoc")).join(F.broadcast(two), ~F.col("tdoc").eqNullSafe(F.col("doc")))  # two rows of each label
    best = x.groupBy("target", "label").agg(F.min(F.struct("pos", "anchor")).alias("b"))
    return best.select("target", F.col("b.anchor").alias("anchor"), "label", F.col("b.pos").alias("pos"), F.lit(0.0).alias("sim"))


def overlap_terms(targets: DataFrame, pool: DataFrame, pairs: DataFrame, top: int = 5) -> DataFrame:
    """(target, anchor, terms): the words that add most to the similarity of each given pair; ties by term."""
    t, p = _vectors(targets, pool)
    t, p = (d.where("block = 'word'") for d in (t, p))
    x = t.join(pairs.select("target", "anchor"), "target").join(p.withColumnRenamed("w", "v").drop("df", "block"), ["anchor", "term"]).withColumn("x", F.round(F.col("w") * F.col("v"), 9))
    k = F.row_number().over(Window.partitionBy("target", "anchor").orderBy(F.desc("x"), "term"))
    return x.withColumn("k", k).where(F.col("k") <= top).groupBy("target", "anchor").agg(F.array_sort(F.collect_list(F.struct("k", "term"))).alias("s")).select("target", "anchor", F.transform("s", lambda s: s["term"]).alias("terms"))


def retrieve(targets: DataFrame, pool: DataFrame, strategy: str, k: int = 3, labels: tuple[str, ...] = ()) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "global":
        return global_anchors(targets, pool)
    sims = similarities(targets, pool, best=k if strategy == "similarity" else 2 * len(labels))
    return top_k(sims, k) if strategy == "similarity" else stratified(sims, labels)


def anchors_used(targets: DataFrame, pool: DataFrame, strategy: str, k: int = 3, labels: tuple[str, ...] = (), terms: int = 5) -> DataFrame:
    """(target, anchors): what a run records of retrieval, in rank order: key, document, name, text, action, reasoning, similarity to four places, and the terms that add most to it (none for fixed anchors).

    A target without anchors has an empty array. ``pool`` has requirement_name, raw_requirement_text and reasoning beside the columns of ``similarities``.
    """
    r = retrieve(targets, pool, strategy, k, labels).select("target", "anchor", "sim", "pos")
    if strategy == "global":
        r = r.withColumn("terms", F.array().cast("array<string>"))
    else:
        r = cut(r)
        r = r.join(overlap_terms(targets, pool, r, terms), ["target", "anchor"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    full = r.join(pool.select("anchor", "doc", "label", "requirement_name", "raw_requirement_text", "reasoning"), "anchor")
    one = F.struct((-F.col("sim")).alias("o"), "pos", F.struct(
        F.col("anchor").alias("requirement_uid"), F.col("doc").alias("document_id"), "requirement_name", "raw_requirement_text", F.col("label").alias("primary_action"), "reasoning", F.round("sim", 4).alias("similarity"), F.col("terms").alias("overlap_terms")).alias("a"))
    packed = full.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["a"]).alias("anchors"))
    out = targets.select("target").join(packed, "target", "left")
    empty = F.array().cast(packed.schema["anchors"].dataType)
    return out.withColumn("anchors", F.coalesce("anchors", empty))


def swept(pairs: DataFrame, rows: DataFrame, thresholds: tuple[float, ...] = (0.9, 0.8, 0.6, 0.5)) -> DataFrame:
    """(threshold, rows, share): how many rows (id) have a partner at each threshold. ``pairs``: (left, right, sim)."""
    best = nearest(pairs).select("sim")
    per = best.agg(*[F.count_if(F.col("sim") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    listed = per.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("rows")) for i, t in enumerate(thresholds)])).alias("x")).select("x.*")
    return listed.join(rows.agg(F.count(F.lit(1)).alias("all")), F.lit(True)).select("threshold", "rows", F.try_divide("rows", "all").alias("share"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(id, other, sim): each unordered pair from either side."""
    side = lambda x, y: F.struct(F.col(x).alias("id"), F.col(y).alias("other"), "sim")
    return pairs.select(F.explode(F.array(side("left", "right"), side("right", "left"))).alias("x")).select("x.*")  # no union: pairs are made once


def nearest(pairs: DataFrame) -> DataFrame:
    """(id, other, sim): each row's most similar partner; ties: the first by id."""
    w = F.min(F.struct((-F.col("sim")).alias("s"), "other"))
    return both_ways(pairs).groupBy("id").agg(w.alias("b")).select("id", F.col("b.other").alias("other"), (-F.col("b.s")).alias("sim"))


def label_agreement(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(pairs, agree): how many pairs there are, and the share whose rows have the same label. ``labels``: (id, label)."""
    a, b = (labels.select(F.col("id").alias(x), F.col("label").alias(f"{x}_label")) for x in ("left", "right"))
    return pairs.join(a, "left").join(b, "right").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("left_label").eqNullSafe(F.col("right_label")).cast("double")).alias("agree"))


def exposure(pairs: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """(by, rows, exposed, share): how many rows of each group have a partner."""
    hit = both_ways(pairs).select("id").distinct().withColumn("hit", F.lit(1))
    return rows.select("id", by).join(hit, "id", "left").groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("exposed")).withColumn("share", F.col("exposed") / F.col("rows"))


def most_similar(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar pairs; ties by ids."""
    return pairs.orderBy(F.desc("sim"), "left", "right").limit(k)


def corpus_terms(rows: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), min_df: int = 2, max_features: int = 30_000) -> DataFrame:
    """(term, df, tf): the vocabulary of a corpus, the ``max_features`` terms with the highest total count of those in ``min_df`` rows; ties by term."""
    c = rows.select("id", F.explode(char_terms(F.col("text"), sizes)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return c.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).where(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(max_features)


#: Queries of a block of the dense search.
QUERY_BLOCK = 4096


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, id, rank): most similar vectors by cosine of a stated query set against all rows, exact; ties by id. ``queries``: (query, q); ``vectors``: (id, v).

    The queries go in blocks of a fixed size, each shipped once; an Arrow batch of vectors is multiplied with a block as matrices and gives its k best
    per query only, so what is shuffled is k rows per query and batch. Vectors of length 0 and NULLs match nothing.
    """
    spark = queries.sparkSession
    of = queries.where("query is not null and q is not null").select(F.col("query").cast("bigint").alias("query"), F.transform("q", lambda x: x.cast("double")).alias("q")).toLocalIterator()
    out, kind = None, "query bigint, id bigint, sim double"
    while True:
        part = [r for _, r in zip(range(block), of)]
        if not part:
            break
        names, q = np.array([r.query for r in part], np.int64), np.array([r.q for r in part], np.float64)
        length = np.linalg.norm(q, axis=1)
        names, q = names[length > 0], q[length > 0] / length[length > 0, None]

        def run(batches: Iterator[pa.RecordBatch], names=names, q=q) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not len(names):
                    continue
                ids, lists = b.column(0).to_numpy(), b.column(1)
                v = np.asarray(lists.flatten().to_numpy(), np.float64).reshape(b.num_rows, -1)
                size = np.linalg.norm(v, axis=1)
                ids, v = ids[size > 0], v[size > 0] / size[size > 0, None]
                sim = np.round(q @ v.T, 6)
                sim[names[:, None] == ids[None, :]] = -2.0
                keep = min(k, len(ids))
                if not keep:
                    continue
                # all at the k-th value, so that ties are left to the ids
                least = -np.partition(-sim, keep - 1, axis=1)[:, keep - 1]
                r, c = np.nonzero((sim >= least[:, None]) & (sim > -2.0))
                yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(ids[c]), pa.array(sim[r, c])], ["query", "id", "sim"])

        one = vectors.where("id is not null and v is not null").select(F.col("id").cast("bigint").alias("id"), "v").mapInArrow(run, kind)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], kind)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))).where(F.col("rank") <= k).select("query", "id", "rank")
