"""Problem 4: a sample that meets target shares and minimums per category, with the shortfalls.

Method: min-cost flow on the counts of each document's cells (action x a second class). Arcs carry the margins (sample size, target shares, the shares of
the second class), the floors and what is available; slack arcs show the shortfall. The integer cell quotas are then drawn at random by hash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafwork.functions.canon import document_key, label_key
from sheafwork.llm.records import latest_state

#: Costs of a unit on the arcs of the network, see ``quotas``.
SHORT, TRIM, UNFILLED, REFILL, OFF_CLASS = 100, 50, 30, 10, 2
#: Refill and trimming go in so many steps of rising cost, so that they fall on the actions in proportion to their targets.
STEPS = 4
#: Second class of a cell: the sample keeps its shares where that costs no target.
SECOND = "build_difficulty"


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (tail, head, capacity, cost) of a cheapest maximum flow; successive shortest paths (Bellman-Ford)."""
    graph: list[list[int]] = [[] for _ in range(n)]
    head, room, cost = [], [], []
    for u, v, c, w in arcs:
        for a, b, r, k in ((u, v, c, w), (v, u, 0, -w)):
            graph[a].append(len(head))
            head.append(b), room.append(r), cost.append(k)
    while True:
        dist, by = [float("inf")] * n, [-1] * n
        dist[source] = 0
        queue = [source]
        while queue:
            u = queue.pop(0)
            for e in graph[u]:
                if room[e] > 0 and dist[u] + cost[e] < dist[head[e]]:
                    dist[head[e]], by[head[e]] = dist[u] + cost[e], e
                    queue.append(head[e])
        if dist[sink] == float("inf"):
            return [arcs[i][2] - room[2 * i] for i in range(len(arcs))]
        path, v = [], sink
        while v != source:
            path.append(by[v])
            v = head[by[v] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step


def quotas(need: list[int], floor: list[int], have: list[list[int]], size: int) -> tuple[list[list[int]], list[int]]:
    """(quota of each cell, shortfall of each action). ``have[i][j]``: records of action i in class j; ``size``: wanted sample size.

    Every unit of an action's target starts at the source. Either it goes to the action's node, whose arc carries what is available, or over the slack arc to the hub: that flow is the shortfall.
    The hub, which also gets what the rounded targets leave of the size, refills from actions that have more, or leaves the place unfilled. From an action's node a unit takes a cell (what is
    available there), then its class (up to the class's own share, beyond at a cost), then the margin of the whole sample; units above the margin are trimmed, but never of an action's floor.
    The margin is ``size``, or what the floors take if that is more.
    """
    k, classes = len(need), len(have[0]) if have else 0
    total = [sum(h) for h in have]
    low = [min(f, n) for f, n in zip(floor, need)]
    margin = max(size, sum(min(f, t) for f, t in zip(low, total)))
    source, sink, hub, sample, off = range(5)
    action, by_class = [5 + i for i in range(k)], [5 + k + j for j in range(classes)]
    demand = [5 + k + classes + i for i in range(k)]
    arcs: list[tuple[int, int, int, int]] = [(source, hub, max(0, size - sum(need)), 0), (hub, sink, size + sum(need), UNFILLED), (sample, sink, margin, 0), (off, sink, sum(need), 0)]
    slack, cells = [], []
    for i in range(k):
        arcs += [(source, demand[i], need[i], 0), (demand[i], action[i], total[i], 0)]
        slack.append(len(arcs))
        arcs.append((demand[i], hub, need[i], SHORT))
        step, cuttable = max(1, need[i] // STEPS), max(0, min(need[i], total[i]) - low[i])
        arcs += [(hub, action[i], step if t < STEPS - 1 else total[i], REFILL + t) for t in range(STEPS)]
        part = -(-cuttable // STEPS)
        arcs += [(action[i], off, min(part, max(0, cuttable - t * part)), TRIM + t) for t in range(STEPS)]
        cells.append(len(arcs))
        arcs += [(action[i], by_class[j], have[i][j], 0) for j in range(classes)]
    for j in range(classes):
        own = -(-margin * sum(h[j] for h in have) // max(1, sum(total)))
        arcs += [(by_class[j], sample, own, 0), (by_class[j], sample, margin, OFF_CLASS)]
    flow = min_cost_flow(5 + 2 * k + classes, arcs, source, sink)
    return [flow[c : c + classes] for c in cells], [flow[x] for x in slack]


def _cells(labels: DataFrame, *more: str) -> DataFrame:
    """The records by latest state with the keys of their document and action and their second class."""
    return latest_state(labels, "document_id", "primary_action", SECOND).select(
        *more, document_key(F.col("document_id")).alias("doc"), label_key(F.col("primary_action")).alias("action"), F.coalesce(label_key(F.col(SECOND)), F.lit("")).alias("class"))


def cell_quotas(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per row of ``targets``: document_id and primary_action as written there, need, available, quota, shortfall, the keys ``doc`` and ``action``, and ``cells`` (class, quota).

    need = larger of min_rows and sample_size x target_share, rounded half up; NULL counts as 0. Records are counted once, by latest state; their document and
    action by canonical spelling. A target row without records has available 0; records without a target aren't drawn. Rows of the same document and action are one
    action, with the larger need and floor; a document's sample size is its largest. The cells of a document are few (its target rows times the second class's values),
    so one group is bounded by the number of categories, whatever its number of records.
    """
    counted = _cells(labels).groupBy("doc", "action", "class").agg(F.count(F.lit(1)).cast("int").alias("n"))
    counted = counted.groupBy("doc", "action").agg(F.sum("n").cast("int").alias("available"), F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("have"))
    zero = F.lit(0)
    t = targets.select(
        "document_id", "primary_action", document_key(F.col("document_id")).alias("doc"), label_key(F.col("primary_action")).alias("action"),
        F.greatest(zero, F.coalesce("min_rows", zero)).alias("floor"), F.greatest(zero, F.coalesce("sample_size", zero)).alias("size"),
        F.floor(F.coalesce(F.col("sample_size") * F.col("target_share"), F.lit(0.0)) + 0.5 + 1e-9).cast("int").alias("share_rows")).distinct()
    t = t.withColumn("need", F.greatest("floor", "share_rows")).join(counted, ["doc", "action"], "left").withColumn("available", F.coalesce("available", zero))

    # one row per document, whose list is as long as it has target rows; no per-group frames
    kept = ["document_id", "primary_action", "action", "floor", "need", "available", "size", "have"]
    rows = F.collect_list(F.struct(*[F.map_entries(c).alias(c) if c == "have" else c for c in kept]))
    grouped = t.select(F.coalesce("doc", F.lit("")).alias("doc"), *kept).groupBy("doc").agg(F.sort_array(rows).alias("cells"))

    @F.pandas_udf("array<struct<quota: int, shortfall: int, cells: array<struct<class: string, quota: int>>>>")
    def solve(column: pd.Series) -> pd.Series:
        def one(rows):
            merged: dict = {}
            for r in rows:
                m = merged.setdefault(r["action"], {"need": 0, "floor": 0, "have": {e["key"]: e["value"] for e in (r["have"] if r["have"] is not None else ())}})
                m["need"], m["floor"] = max(m["need"], int(r["need"])), max(m["floor"], int(r["floor"]))
            classes = sorted({c for m in merged.values() for c in m["have"]})
            of = list(merged.values())
            got, short = quotas([m["need"] for m in of], [m["floor"] for m in of], [[int(m["have"].get(c, 0)) for c in classes] for m in of], max(int(r["size"]) for r in rows))
            at = {a: i for i, a in enumerate(merged)}
            return [
                {"quota": sum(got[i]), "shortfall": max(0, short[i] - of[i]["need"] + int(r["need"])), "cells": [{"class": c, "quota": n} for c, n in zip(classes, got[i]) if n]}
                for r in rows for i in [at[r["action"]]]
            ]

        return column.map(one)

    solved = grouped.withColumn("x", F.explode(F.arrays_zip("cells", solve("cells").alias("solved"))))
    return solved.select("doc", *[f"x.cells.{c}" for c in ("document_id", "primary_action", "action", "need", "available")], "x.solved.quota", "x.solved.shortfall", "x.solved.cells")


def draw(labels: DataFrame, targets: DataFrame, seed: int = 29, salts: int = 64) -> DataFrame:
    """(requirement_uid, document_id, primary_action) of the drawn records, the quota of each cell in hash order.

    A hot cell is ranked in ``salts`` parts first; each part keeps no more than the quota, so the final ranking sees at most salts x quota rows of a cell.
    """
    q = cell_quotas(labels, targets).groupBy("doc", "action").agg(F.min(F.struct("document_id", "primary_action", "cells")).alias("q"))
    q = q.select("doc", "action", "q.document_id", "q.primary_action", F.explode("q.cells").alias("c")).select("doc", "action", "document_id", "primary_action", "c.class", "c.quota")
    r = _cells(labels, "requirement_uid").withColumn("h", F.xxhash64(F.lit(seed), "requirement_uid")).withColumn("part", F.pmod("h", F.lit(salts)))
    cell = ("doc", "action", "class")
    r = r.join(q, list(cell))
    r = r.withColumn("k", F.row_number().over(Window.partitionBy(*cell, "part").orderBy("h", "requirement_uid"))).where("k <= quota")
    r = r.withColumn("k", F.row_number().over(Window.partitionBy(*cell).orderBy("h", "requirement_uid"))).where("k <= quota")
    return r.select("requirement_uid", "document_id", "primary_action")


def report(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(document_id, primary_action, need, available, quota, shortfall) of every target row."""
    return cell_quotas(labels, targets).select("document_id", "primary_action", "need", "available", "quota", "shortfall")


def shortfalls(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(document_id, primary_action) of the target rows whose slack arc carries flow."""
    return cell_quotas(labels, targets).where("shortfall > 0").select("document_id", "primary_action")
