"""Problem 7: consensus of several annotators' labels, agreement and reliability.

Method: competence-and-spamming mixture. Annotator j copies the true label with probability theta_j, else draws from an own guess
distribution xi_j; expectation-maximisation gives both and the posterior of every item's label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.functions.canon import label_key, nfkc
from sheafwork.llm.records import latest_state
from sheafwork.session import cut

#: Fields with one value; the values of these and the entries of the multi-valued field come from the data.
SINGLE = ("primary_action", "cost_basis")
ROUNDS, TOLERANCE, SMOOTH = 30, 1e-4, 0.5


def latest_votes(results: DataFrame) -> DataFrame:
    """(requirement_uid, annotator_id, primary_action, cost_basis, blockers): keys of each annotator's latest ok answer per record.

    Failed rows, rows without label, record or annotator don't count; ties in time go to the greatest answer, so repeats change nothing. A NULL label stays NULL, an empty one too.
    """
    ok = results.where("status = 'ok' and label is not null and requirement_uid is not null and annotator_id is not null")
    last = ok.groupBy("requirement_uid", "annotator_id").agg(F.max(F.struct("received_at", F.struct("label.primary_action", "label.cost_basis", "label.blockers").alias("v"))).alias("s"))
    return last.select("requirement_uid", "annotator_id", *[F.nullif(label_key(F.col(f"s.v.{c}")), F.lit("")).alias(c) for c in SINGLE], F.col("s.v.blockers").alias("raw"))


def label_key_list(items):
    """Keys of a list of labels (one canonicalisation of the joined list)."""
    sep = "\x1f"
    text = F.translate(F.array_join(items, sep), "ㆍᆞ", "")
    return F.transform(F.split(nfkc(text), sep), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]|ᆞ", ""))


class Ballots:
    """Numbers of all votes that occur. A slot is a field, or one entry of the multi-valued field; a seat an annotator in a slot; a label a value in a slot; a vote a label of a seat.

    Everything is as long as the annotators times the labels they use (annotators don't grow with the items); nothing is as long as the items.
    """

    def __init__(self, rows: list[tuple[str, str, str, int]]) -> None:
        rows = sorted(rows, key=lambda r: r[3])
        self.key = np.array([r[3] for r in rows], np.int64)
        self.slots = sorted({r[0] for r in rows})
        self.labels = sorted({(r[0], r[2]) for r in rows})
        self.seats = sorted({(r[0], r[1]) for r in rows})
        slot, label, seat = ({x: i for i, x in enumerate(v)} for v in (self.slots, self.labels, self.seats))
        self.label = np.array([label[r[0], r[2]] for r in rows], np.int64)
        self.seat = np.array([seat[r[0], r[1]] for r in rows], np.int64)
        self.slot_of_label = np.array([slot[x[0]] for x in self.labels], np.int64)
        self.slot_of_seat = np.array([slot[x[0]] for x in self.seats], np.int64)
        self.k = np.maximum(2, np.bincount(self.slot_of_label, minlength=len(self.slots))) if rows else np.zeros(0, np.int64)
        self.theta = np.full(len(self.seats), 0.7)
        self.xi = 1 / self.k[self.slot_of_label[self.label]] if rows else np.zeros(0)
        self.prior = 1 / self.k[self.slot_of_label] if rows else np.zeros(0)

    def posterior(self, votes: pa.ListArray) -> tuple:
        """Of a batch of items: the vote of each cast one; its pair (item and slot, label); the pairs' labels, owners and probabilities; the items' slots; what a label without a vote has per prior.

        A label nobody gave an item has the same likelihood whichever it is, so the sums over labels need those with votes only.
        """
        s = len(self.slots)
        sizes = np.diff(votes.offsets.to_numpy())
        vote = np.searchsorted(self.key, votes.flatten().to_numpy(zero_copy_only=False))
        label = self.label[vote]
        owner = np.repeat(np.arange(len(sizes)), sizes) * s + self.slot_of_label[label]
        places, at = np.unique(owner, return_inverse=True)
        pairs, of_vote = np.unique(at * len(self.labels) + label, return_inverse=True)
        pair_owner, pair_label = pairs // len(self.labels), pairs % len(self.labels)
        honest = self.theta[self.seat[vote]]
        spam = (1 - honest) * self.xi[vote]
        log = np.bincount(of_vote, np.log(honest + spam) - np.log(spam), len(pairs)) + np.log(self.prior[pair_label])
        free = np.maximum(0.0, 1 - np.bincount(pair_owner, self.prior[pair_label], len(places)))
        top = np.zeros(len(places))  # the labels without votes stand at 0
        np.maximum.at(top, pair_owner, log)
        weight = np.exp(log - top[pair_owner])
        whole = np.bincount(pair_owner, weight, len(places)) + free * np.exp(-top)
        return vote, of_vote, pair_label, pair_owner, weight / whole[pair_owner], places, np.exp(-top) / whole

    def expect(self, votes: pa.ListArray) -> dict[str, np.ndarray]:
        """Sums of a batch: copied votes of each seat, guesses of each vote, posterior of each label, what unvoted labels have."""
        vote, of_vote, label, owner, q, places, rest = self.posterior(votes)
        seat = self.seat[vote]
        honest = self.theta[seat]
        copied = honest / (honest + (1 - honest) * self.xi[vote]) * q[of_vote]
        slots = self.slot_of_label[label]
        own_slot = np.zeros(len(places), np.int64)
        own_slot[owner] = slots
        return {
            "copied": np.bincount(seat, copied, len(self.seats)), "cast": np.bincount(seat, minlength=len(self.seats)).astype(float), "guessed": np.bincount(vote, 1 - copied, len(self.key)),
            "label": np.bincount(label, q, len(self.labels)), "voted": np.bincount(label, rest[owner], len(self.labels)), "rest": np.bincount(own_slot, rest, len(self.slots)), "items": np.bincount(own_slot, minlength=len(self.slots)).astype(float),
        }

    def maximise(self, x: dict[str, np.ndarray]) -> float:
        """New parameters; the greatest change of a competence."""
        before = self.theta
        self.theta = (x["copied"] + SMOOTH) / (x["cast"] + 2 * SMOOTH)
        all_guessed = np.bincount(self.seat, x["guessed"], len(self.seats))
        self.xi = (x["guessed"] + SMOOTH / self.k[self.slot_of_label[self.label]]) / (all_guessed[self.seat] + SMOOTH)
        share = x["label"] + self.prior * (x["rest"][self.slot_of_label] - x["voted"])
        self.prior = (share + SMOOTH) / (x["items"] + SMOOTH * self.k)[self.slot_of_label]
        return float(np.abs(self.theta - before).max())


#: The sums of a round, in the order in which their numbers are laid out.
SUMS = ("copied", "cast", "guessed", "label", "voted", "rest", "items")


def _decided(b: Ballots, batch: pa.RecordBatch) -> list[tuple]:
    uid, count, votes = (batch.column(batch.schema.get_field_index(c)) for c in ("requirement_uid", "annotators", "votes"))
    uid, count = uid.to_pylist(), count.to_pylist()
    _, of_vote, label, owner, q, places, _ = b.posterior(votes)
    cast = np.bincount(of_vote, minlength=len(q))
    order = np.lexsort((label, -np.round(q, 12), owner))
    first = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])] if len(order) else order
    same = cast[first] / np.bincount(owner, cast, len(places)) if len(first) else np.zeros(0)
    out, entries = [], {}
    for place, pair, agree in zip(places, first, same):
        item, (slot, value) = int(place // len(b.slots)), b.labels[label[pair]]
        if slot in SINGLE:
            out.append((uid[item], slot, count[item], value, float(agree), float(q[pair])))
        else:
            entries.setdefault(item, []).append((slot.split(":", 1)[1], value, float(agree), float(q[pair])))
    for item, e in entries.items():
        out.append((uid[item], "blockers", count[item], "|".join(name for name, value, *_ in sorted(e) if value == "1"), float(np.mean([x[2] for x in e])), min(x[3] for x in e)))
    return out


def consensus(results: DataFrame, min_annotators: int = 1) -> tuple[DataFrame, DataFrame]:
    """(items, annotators).

    items: requirement_uid, field, annotators, value (keys; blockers joined by ``|`` in order), agreement (mean share of votes equal to the consensus), confidence
    (least posterior). annotators: annotator_id, field, competence. The consensus is one of the labels given. Fields nobody voted on give no row; blockers count one by one,
    every one that occurs anywhere. Ties of the posterior go to the label first by code point. An empty table gives empty results.

    One item's votes are one row (at most one per annotator, and annotators don't grow); a round ships the parameters of the
    annotators and their labels (``Ballots``) and gathers the sums of the same length.
    """
    spark = results.sparkSession
    votes = latest_votes(results)
    keys = F.array_sort(F.array_distinct(F.filter(label_key_list(F.col("raw")), lambda x: x != "")))
    votes = cut(votes.select("requirement_uid", "annotator_id", *SINGLE, F.when(F.col("raw").isNotNull(), keys).alias("blockers")))
    known = sorted(r[0] for r in votes.select(F.explode("blockers").alias("b")).distinct().collect())
    given = [(f, F.col(f)) for f in SINGLE] + [(f"blockers:{k}", F.when(F.array_contains("blockers", k), "1").when(F.col("blockers").isNotNull(), "0")) for k in known]
    one = [F.when(v.isNotNull(), F.struct(F.lit(s).alias("slot"), v.alias("value"), F.xxhash64(F.lit(s), "annotator_id", v).alias("key"))) for s, v in given]
    cast = votes.select("requirement_uid", "annotator_id", F.array_compact(F.array(*one)).alias("cast"))
    b = Ballots([tuple(r) for r in cast.select("annotator_id", F.explode("cast").alias("c")).select("c.slot", "annotator_id", "c.value", "c.key").distinct().collect()])
    items = cast.groupBy("requirement_uid").agg(F.count(F.lit(1)).cast("int").alias("annotators"), F.sort_array(F.flatten(F.collect_list("cast.key"))).alias("votes"))
    items = cut(items.where(F.col("annotators") >= min_annotators))
    sizes = {"copied": len(b.seats), "cast": len(b.seats), "guessed": len(b.key), "label": len(b.labels), "voted": len(b.labels), "rest": len(b.slots), "items": len(b.slots)}
    begin = dict(zip(SUMS, np.cumsum([0, *[sizes[x] for x in SUMS]])))

    def summed(at: Ballots):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {x: np.zeros(sizes[x]) for x in SUMS}
            for batch in batches:
                for x, v in at.expect(batch.column(0)).items():
                    total[x] += v
            flat = np.concatenate([total[x] for x in SUMS])
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["i", "x"])

        return run

    for _ in range(ROUNDS if len(b.key) else 0):
        got = items.select("votes").mapInArrow(summed(b), "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        flat = np.zeros(sum(sizes.values()))
        flat[got.column("i").to_numpy()] = got.column("x").to_numpy()
        if b.maximise({x: flat[begin[x] : begin[x] + sizes[x]] for x in SUMS}) < TOLERANCE:
            break

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*_decided(b, batch))) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds)], ["requirement_uid", "field", "annotators", "value", "agreement", "confidence"])

    agreed = items.mapInArrow(decide, "requirement_uid string, field string, annotators int, value string, agreement double, confidence double")
    reliability = spark.createDataFrame([(who, slot, float(t)) for (slot, who), t in zip(b.seats, b.theta)], "annotator_id string, field string, competence double")
    return agreed, reliability


def disputed(results: DataFrame, labels: DataFrame, min_annotators: int = 3) -> DataFrame:
    """(requirement_uid, field): fields whose consensus differs from the label dataset's latest state, for records with at least ``min_annotators`` annotators."""
    agreed, _ = consensus(results)
    state = latest_state(labels, *SINGLE, "blockers")
    keys = F.array_join(F.array_sort(F.array_distinct(F.filter(label_key_list(F.col("blockers")), lambda x: x != ""))), "|")
    flat = state.select("requirement_uid", *[label_key(F.col(c)).alias(c) for c in SINGLE], F.coalesce(keys, F.lit("")).alias("blockers"))
    known = flat.select("requirement_uid", F.explode(F.create_map(*[x for c in (*SINGLE, "blockers") for x in (F.lit(c), F.col(c))])).alias("field", "current"))
    found = agreed.where(F.col("annotators") >= min_annotators).join(known, ["requirement_uid", "field"])
    return found.where(~F.col("value").eqNullSafe(F.col("current"))).select("requirement_uid", "field")
