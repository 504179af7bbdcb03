"""Problem 1: freely entered values mapped to the entries of a reference list.

Method: token-level repair (each distinct token is joined to the reference vocabulary by edit distance, through
deletion neighbourhoods), then soft TF-IDF over the repaired tokens ranks the names of the entries.
"""

from __future__ import annotations

import math
import re
import unicodedata
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sheafwork.llm.records import latest_state
from sheafwork.session import cut

# Wording of procurement forms that carries no meaning of its own.
NUMBERING = r"제\s*\d+\s*[장절편]|외\s*\d+\s*건|p\.?\s*\d+"
GENERIC_TAILS = ("요구사항", "요구", "사항", "항목", "목록", "상세", "세부", "관련", "requirements", "requirement", "req")
PARTICLES = frozenset(("of", "the", "and", "for", "a", "an", "in", "on", "to"))

#: Least soft TF-IDF score at which a value means an entry, read without blanks or by its words; one of two words alone stays under the latter.
THRESHOLD, WORDS_THRESHOLD = 0.7, 0.8


def _letters(text: str) -> list[str]:
    """Runs of one script (Latin, other) of the letters of a text; blanks, digits, marks and numbering do not count."""
    s = unicodedata.normalize("NFKC", re.sub("[​‌‍﻿­]", "", text)).lower()
    s = "".join(c for c in re.sub(NUMBERING, " ", s) if c.isalpha())
    return re.findall(r"[a-z]+|[^a-z]+", s)


def value_tokens(text: str | None) -> list[str]:
    """Tokens of a value read without its blanks: script runs without generic tails; a run of generic wording only is no token."""
    return list(dict.fromkeys(filter(None, map(_without_tails, _letters(text or "")))))


def _without_tails(run: str) -> str:
    again = True
    while again:
        again = False
        for tail in GENERIC_TAILS:
            if run.endswith(tail):
                run, again = run[: -len(tail)], True
    return run


def spelled(token: str) -> str:
    """Canonical decomposition, so that an edit is one letter (jamo), not one syllable."""
    return unicodedata.normalize("NFD", token)


def edits_allowed(n: int) -> int:
    return 0 if n <= 3 else 1 if n <= 7 else 2


def edit_distance(a: str, b: str) -> int:
    """Optimal string alignment: insert, delete, replace, swap of neighbours."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def deletions(token: str) -> list[str]:
    """The token and all it becomes by as many deletions as edits are allowed one letter longer."""
    k = edits_allowed(len(token) + 2)
    return list({"".join(c for i, c in enumerate(token) if i not in gone) for r in range(k + 1) for gone in map(set, combinations(range(len(token)), r))})


def word_tokens(text: str | None) -> list[str]:
    """Tokens of a value as it is worded: its words, cut at blanks, separators and changes of script, without generic tails and English particles; repeats stay."""
    s = unicodedata.normalize("NFKC", re.sub("[\u200b\u200c\u200d\ufeff\u00ad]", "", text or "")).lower()
    words = re.findall(r"[a-z]+|[^\W\d_a-z]+", re.sub(NUMBERING, " ", s))
    return [w for w in map(_without_tails, words) if w and w not in PARTICLES]


#: How a value is read: by its words, and with all blanks taken out (entered values have blanks inside words and none between them).
READINGS = (("words", word_tokens), ("glued", value_tokens))


@F.pandas_udf(ArrayType(StructType([StructField("reading", StringType()), StructField("token", StringType())])))
def _tokens(v: pd.Series) -> pd.Series:
    return v.map(lambda x: [{"reading": name, "token": t} for name, read in READINGS for t in read(x)])


@F.pandas_udf(StructType([StructField("nfd", StringType()), StructField("keys", ArrayType(StringType()))]))
def _keyed(v: pd.Series) -> pd.DataFrame:
    nfd = v.map(spelled)
    return pd.DataFrame({"nfd": nfd, "keys": nfd.map(deletions)})


@F.pandas_udf(StringType())
def _spelled(v: pd.Series) -> pd.Series:
    return v.map(spelled)


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b)], dtype="int32")


def entry_names(catalog: DataFrame) -> DataFrame:
    """(type_id, name): the own and English name, the prefix and the aliases of each entry, and each of the names in Hangul with each in Latin letters, as both are often entered side by side.

    An entry gives at most the square of its own names.
    """
    own = F.filter(F.array_distinct(F.concat(F.array("type_name", "name_en", "id_prefix"), F.coalesce("aliases", F.array().cast("array<string>")))), lambda x: x.isNotNull())
    latin = lambda x: x.rlike("^[\\x00-\\x7F]*$")
    both = F.flatten(F.transform(F.filter("own", lambda x: ~latin(x)), lambda a: F.transform(F.filter("own", latin), lambda b: F.concat_ws(" ", a, b))))
    return catalog.select("type_id", own.alias("own")).select("type_id", F.explode(F.concat("own", both)).alias("name")).distinct()


def _weighted(tokens: DataFrame, *by: str) -> DataFrame:
    """Adds the length of the vector of each group; ``w`` is the weight of a token in it."""
    norm = tokens.groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return tokens.join(norm, list(by))


def map_values(values: DataFrame, catalog: DataFrame, threshold: float = THRESHOLD, words_threshold: float = WORDS_THRESHOLD) -> DataFrame:
    """(value, type_id, score, matched): the entry each distinct value means; type_id 0 where it means none.

    ``values`` has a column ``value``; NULL values give no row, a blank or unreadable one gets 0. Score: soft TF-IDF, the cosine of the value's and the name's
    vectors (sublinear frequency x idf over the names, both of length one), in which a token counts for the term it is repaired to times the similarity of the repair;
    the best name of the entry, the better reading (``READINGS``). Ties go to the lower type_id. An empty catalog maps everything to 0. Every repair within
    the allowed edits is found: two strings within d edits share a string reached by at most d deletions from each.
    """
    distinct = values.select("value").where("value is not null").distinct()
    tokens = cut(distinct.withColumn("t", F.explode(_tokens("value"))).groupBy("value", "t.reading", "t.token").agg(F.count(F.lit(1)).alias("tf")))
    names = entry_names(catalog).withColumn("t", F.explode(_tokens("name"))).select("type_id", "name", "t.reading", F.col("t.token").alias("term"))
    # a name that ends in a generic word also counts unshortened
    full = entry_names(catalog).select("type_id", F.concat("name", F.lit("\x00")).alias("name"), F.lit("glued").alias("reading"), F.lower(F.regexp_replace("name", r"(?U)\s+", "")).alias("term"))
    names = cut(names.unionByName(full).where("term <> ''").groupBy("type_id", "name", "reading", "term").agg(F.count(F.lit(1)).alias("tf")))
    total, longest = names.agg(F.countDistinct("type_id", "name"), F.coalesce(F.max(F.length(_spelled("term"))), F.lit(0))).first()
    df = names.groupBy("term").agg(F.countDistinct("type_id").alias("df"))
    idf = df.select("term", (1 + F.log((1.0 + total) / (1.0 + F.col("df")))).alias("idf"))

    def keyed(d: DataFrame, c: str) -> DataFrame:
        # a token longer than every term by more than the edits allowed is near none; it gets no neighbourhood
        return d.select(c).distinct().where(F.length(c) <= longest + 2).withColumn("k", _keyed(c)).select(c, F.col("k.nfd").alias(f"{c}_nfd"), F.explode("k.keys").alias("key")).where(F.length(f"{c}_nfd") <= longest + 2)

    near = keyed(tokens, "token").join(keyed(names, "term"), "key").select("token", "term", "token_nfd", "term_nfd").distinct()
    # two edits with swaps are four without
    near = near.where("abs(length(token_nfd) - length(term_nfd)) <= 2 and levenshtein(token_nfd, term_nfd, 4) >= 0").withColumn("d", _distance("token_nfd", "term_nfd")).withColumn("n", F.length("term_nfd"))
    near = near.where(F.col("d") <= F.when(F.col("n") <= 3, 0).when(F.col("n") <= 7, 1).otherwise(2))
    repaired = cut(near.select("token", "term", (1 - F.col("d") / F.greatest("n", F.length("token_nfd"))).alias("sim")).join(idf, "term"))
    best = repaired.groupBy("token").agg(F.max(F.struct("sim", "idf"))["idf"].alias("idf"))
    sublinear = 1 + F.log("tf")
    weight = tokens.join(best, "token", "left").withColumn("w", sublinear * F.coalesce("idf", F.lit(1 + math.log(1.0 + total)))).drop("idf", "tf")
    v = _weighted(weight, "value", "reading")
    n = _weighted(names.join(idf, "term").withColumn("w", sublinear * F.col("idf")).select("type_id", "name", "reading", "term", "w"), "type_id", "name", "reading")
    n = n.select("type_id", "name", "reading", "term", (F.col("w") / F.col("norm")).alias("nw"))
    hit = v.join(repaired.select("token", "term", "sim"), "token").join(n, ["reading", "term"])
    per_term = hit.groupBy("value", "reading", "type_id", "name", "term").agg(F.max(F.struct((F.col("w") / F.col("norm") * F.col("nw") * F.col("sim")).alias("x"), "token")).alias("b"))
    scored = per_term.groupBy("value", "reading", "type_id", "name").agg(F.least(F.lit(1.0), F.round(F.sum("b.x"), 9)).alias("score"), F.array_sort(F.collect_set("b.token")).alias("matched"))
    enough = F.col("score") >= F.when(F.col("reading") == "words", words_threshold).otherwise(threshold)
    best = scored.groupBy("value").agg(F.max(F.struct(enough.alias("enough"), "score", (-F.col("type_id")).alias("neg"), "matched")).alias("b"))
    return distinct.join(best, "value", "left").select(
        "value", F.when(F.col("b.enough"), -F.col("b.neg")).otherwise(0).cast("int").alias("type_id"), F.round(F.coalesce("b.score", F.lit(0.0)), 6).alias("score"), F.col("b.matched").alias("matched"))


def mapped_requirements(labels: DataFrame, catalog: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(requirement_uid, type_id) of every record whose type the pipeline left unmapped and whose entered type is not blank.

    The work is done on distinct values and joined back.
    """
    state = latest_state(labels, "requirement_type", "requirement_type_source").where("requirement_type_source = 'none'")
    state = state.where(F.length(F.regexp_replace("requirement_type", r"(?U)[\s​‌‍﻿­]", "")) > 0)
    found = map_values(state.select(F.col("requirement_type").alias("value")), catalog, threshold)
    return state.join(found, state["requirement_type"] == found["value"]).select("requirement_uid", "type_id")
