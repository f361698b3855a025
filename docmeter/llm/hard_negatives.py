"""Hard negatives: rows of another label that are nearly as close to an anchor as its positives, by a multiway tree.

Closeness is the inner product. A further component brings all rows to one length M, and an anchor, lifted with 0 in its
place, lies at the distance whose square is |a|^2 + M^2 - 2 <a, x> from a row x: a window of inner products is an annulus
around the anchor.

* The tree (GNAT) is fitted on a bounded sample: each node has split points far from each other, rows go down to the nearest
  one. Every row is in one leaf. Each node keeps, over all rows, the range of distances from each split point to the rows
  of each child.
* A leaf is left out for an annulus if on the way down to it, for some split point, the range of a child, moved by the query's
  own distance to that point, misses the annulus, or if the hyperplanes between the split points keep the child outside.
* Leaves that remain are scanned exactly. First an anchor's nearest rows of its label are searched, then for each of them the
  window of negatives. Rows of the sample tell beforehand how good the last of a list is at least, which narrows the annulus.

Leaves are packed in tree order into bins of bounded size, and a leaf too large is spread over several; anchors, by the leaf
they are in, into lots likewise. A task scans one bin for one lot, and only pairs of bin and lot that some anchor needs exist.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, materialize


@dataclass(frozen=True)
class Settings:
    """``sample`` rows, of so many ``numbers`` in all, bound what the tree is fitted on; every row is in the tree and searched."""

    sample: int = 8_192
    numbers: int = 1 << 22
    fanout: int = 16
    #: Rows that a leaf should have, as far as the sample can tell leaves apart.
    leaf: int = 1_024
    leaves: int = 2_048
    #: Rows of a bin and anchors of a lot.
    bin: int = 4_096
    lot: int = 512
    seed: int = 17


@dataclass
class Node:
    points: np.ndarray  # split points, k x d
    lift: np.ndarray  # their further component
    child: list[int]  # a node, or -1 - leaf
    low: np.ndarray | None = None  # k x k: least distance from split point to the rows of a child
    high: np.ndarray | None = None


@dataclass
class Tree:
    nodes: list[Node]
    leaves: int
    length: float  # M


def _table(vectors: pd.Series | list, width: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with 0."""
    rows = [np.frombuffer(v) for v in vectors]
    width = max([width, *map(len, rows)])
    if all(len(r) == width for r in rows):
        return np.stack(rows) if rows else np.empty((0, width))
    out = np.zeros((len(rows), width))
    for o, r in zip(out, rows, strict=True):
        o[: len(r)] = r
    return out


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = min(x.shape[1], y.shape[1])
    return x[:, :w] @ y[:, :w].T


def _lift(x: np.ndarray, length: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, length**2 - (x**2).sum(1)))


def _distances(x: np.ndarray, lift: np.ndarray, node: Node, length: float) -> np.ndarray:
    """Between rows and split points; an anchor's lift is 0, and its own length counts."""
    square = (x**2).sum(1) + lift**2
    return np.sqrt(np.maximum(0.0, square[:, None] + length**2 - 2 * (_products(x, node.points) + lift[:, None] * node.lift)))


def fit(sample: np.ndarray, length: float, leaves: int, s: Settings) -> Tree:
    """On the driver, from the bounded sample only."""
    rng = np.random.default_rng(s.seed)
    lift = _lift(sample, length)
    tree = Tree([], 0, length)

    def grow(mine: np.ndarray, wanted: int) -> int:
        k = min(s.fanout, wanted, len(mine))
        chosen: list[int] = []
        if k > 1:
            some = rng.choice(mine, min(len(mine), 3 * k), replace=False)
            gap = np.full(len(some), np.inf)
            at = 0
            while len(chosen) < k and gap[at] > 0:  # each the farthest from those before
                chosen.append(some[at])
                near = Node(sample[some[at]][None], lift[some[at]][None], [])
                gap = np.minimum(gap, _distances(sample[some], lift[some], near, length)[:, 0])
                at = int(gap.argmax())
        if len(chosen) < 2:
            tree.leaves += 1
            return -tree.leaves
        node = Node(sample[chosen], lift[chosen], [])
        tree.nodes.append(node)
        number = len(tree.nodes) - 1
        near = _distances(sample[mine], lift[mine], node, length).argmin(1)
        for j in range(len(chosen)):
            node.child.append(grow(mine[near == j], round(wanted * (near == j).mean())))
        return number

    if len(sample):
        grow(np.arange(len(sample)), leaves)
    tree.leaves = max(1, tree.leaves)
    return tree


def descend(tree: Tree, x: np.ndarray, seen: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The leaf of each row; ``seen`` gathers the ranges (low, high) of (node, child)."""
    leaf = np.zeros(len(x), np.int32)
    lift = _lift(x, tree.length)
    todo = [(0, np.arange(len(x)))] if tree.nodes else []
    while todo:
        number, rows = todo.pop()
        node = tree.nodes[number]
        d = _distances(x[rows], lift[rows], node, tree.length)
        near = d.argmin(1)
        for j, child in enumerate(node.child):
            mine = near == j
            if not mine.any():
                continue
            low, high = d[mine].min(0), d[mine].max(0)
            if (old := seen.get((number, j))) is not None:
                low, high = np.minimum(low, old[0]), np.maximum(high, old[1])
            seen[number, j] = low, high
            if child < 0:
                leaf[rows[mine]] = -1 - child
            else:
                todo.append((child, rows[mine]))
    return leaf


def bounds(tree: Tree, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query and leaf the least and the largest inner product that its rows can have; leaves without rows have none."""
    low, high = np.full((len(q), tree.leaves), np.inf), np.full((len(q), tree.leaves), -np.inf)
    square = (q**2).sum(1) + tree.length**2
    none = np.zeros(len(q))
    if not tree.nodes:
        return np.full_like(low, -np.inf), np.full_like(high, np.inf)
    todo = [(0, none, np.full(len(q), np.inf))]
    while todo:
        number, least, most = todo.pop()
        node = tree.nodes[number]
        d = _distances(q, none, node, tree.length)
        for j, child in enumerate(node.child):
            if node.high[j, 0] < 0:  # no rows
                continue
            a = np.maximum(d - node.high[j], node.low[j] - d).max(1)
            a = np.maximum(np.maximum(a, (d[:, j] - d.min(1)) / 2), least)
            b = np.minimum((d + node.high[j]).min(1), most)
            if child < 0:
                # A little room for rounding.
                room = 1e-9 * square + 1e-9
                high[:, -1 - child] = (square - np.maximum(a, 0) ** 2) / 2 + room
                low[:, -1 - child] = (square - b**2) / 2 - room
            else:
                todo.append((child, a, b))
    return low, high


def _spread(counts: dict[int, int], size: int, leaves: int) -> list[tuple[int, int]]:
    """Of each leaf its first bin and how many bins it spans, if leaves fill bins of so many rows in turn."""
    out, before = [], 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        first = before // size
        out.append((first, max(1, -(-(before + n) // size) - first)))
        before += n
    return out


def _place(spread: list[tuple[int, int]], seed: int) -> Column:
    """The bin of a row by its leaf and id."""
    first, span = (F.element_at(F.expr(f"array({','.join(str(s[i]) for s in spread)})"), F.col("leaf") + 1) for i in (0, 1))
    return (first + F.pmod(F.xxhash64(F.lit(seed), "id"), span)).cast("int")


def _last(scores: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """The k-th best allowed score of each row, -inf if there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(np.where(ok, scores, -np.inf), scores.shape[1] - k, axis=1)[:, -k]


def _best(ids: np.ndarray, scores: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best allowed, ties by id; ids are ascending."""
    at = np.flatnonzero(ok)
    if len(at) > k:
        edge = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= edge]
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Callable[[Column], Column],
    key: str = "vec_id",
    label: str = "label",
    vec: str = "embedding",
    positives: int = 5,
    negatives: int = 5,
    percent: tuple[int, int] = (80, 100),
    settings: Settings = Settings(),
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    An anchor's positives are the nearest other rows of its label; to each, the nearest rows of another label whose score s
    satisfies percent[0] * p <= 100 * s <= percent[1] * p, p being the positive's score. Ties go to the smaller id.

    * Scores are inner products in double precision, exact for whole components as long as they stay below 2^53. A missing
      component of a shorter vector counts 0; the zero vector takes part.
    * Rows with a null key, label or vector or a null or non-finite component take no part. Of rows with one key the smallest
      (label, vector) takes part. Fewer candidates give fewer rows; an empty table or no anchor gives an empty one.
      Other columns are not read.
    """
    spark, s = vectors.sparkSession, settings
    rows = vectors.select(col(key).cast("long").alias("id"), col(label).cast("string").alias("label"), col(vec).cast("array<double>").alias("vec"))
    finite = "forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").where(finite)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec")
    rows = materialize(rows, "negatives-rows")
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"), F.max(square).alias("m")).first()
    if not told["n"]:
        return empty
    size = max(1, min(s.sample, s.numbers // max(1, told["d"])))
    # Chosen by hash at the rate that gives so many rows; the limit is for the chance of a few more.
    chance = F.pmod(F.xxhash64(F.lit(s.seed), "id"), F.lit(1 << 32)) < int(min(1.0, size / told["n"]) * (1 << 32))
    drawn = rows.where(chance).limit(2 * size).toArrow()
    drawn_ids, drawn_labels = drawn["id"].to_numpy(), np.array(drawn["label"].to_pylist(), object)
    sample = _table([np.asarray(v.values, np.float64).tobytes() for v in drawn["vec"]])
    length = float(np.sqrt(told["m"])) * (1 + 1e-12)
    tree = fit(sample, length, min(s.leaves, -(-told["n"] // s.leaf)), s)
    planted = spark.sparkContext.broadcast(tree)

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            if len(b):
                raw = [np.asarray(v, np.float64).tobytes() for v in b["vec"]]
                yield pd.DataFrame({"leaf": descend(planted.value, _table(raw), seen), "id": b["id"], "label": b["label"], "vec": raw, "node": None, "child": None, "low": None, "high": None})
        if seen:
            lows, highs = zip(*seen.values(), strict=True)
            yield pd.DataFrame({"leaf": None, "id": None, "label": None, "vec": None, "node": [n for n, _ in seen], "child": [c for _, c in seen], "low": lows, "high": highs})

    # Rows with their leaf; beside them, with a null leaf, each task's ranges of distances.
    made = materialize(rows.mapInPandas(plant, "leaf int, id long, label string, vec binary, node int, child int, low array<double>, high array<double>"), "negatives-index")
    index = made.where("leaf IS NOT NULL").select("leaf", "id", "label", "vec")
    ranges = made.where("node IS NOT NULL").select("node", "child", F.posexplode(F.arrays_zip("low", "high")).alias("point", "r"))
    # At most a row for each node, child and split point.
    for r in ranges.groupBy("node", "child", "point").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high")).collect():
        node = tree.nodes[r["node"]]
        if node.low is None:
            node.low, node.high = np.full((len(node.child),) * 2, np.inf), np.full((len(node.child),) * 2, -1.0)
        node.low[r["child"], r["point"]], node.high[r["child"], r["point"]] = r["low"], r["high"]
    for node in tree.nodes:
        if node.low is None:
            node.low, node.high = np.full((len(node.child),) * 2, np.inf), np.full((len(node.child),) * 2, -1.0)
    planted.unpersist()
    shared = spark.sparkContext.broadcast((tree, sample, drawn_ids, drawn_labels))

    # A row a leaf, at most.
    counted = index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor(F.col("id"))).alias("a")).collect()
    bins = _spread({r["leaf"]: r["n"] for r in counted}, s.bin, tree.leaves)
    lots = _spread({r["leaf"]: r["a"] for r in counted}, s.lot, tree.leaves)
    base = index.withColumn("bin", _place(bins, s.seed))
    anchors = index.where(is_anchor(F.col("id"))).withColumn("lot", _place(lots, s.seed))

    def routed(asks: DataFrame, aims: Callable) -> DataFrame:
        """An ask for each bin that may hold what an anchor looks for: its leaves there, and its targets (key, least and most of 100 times the score)."""

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree, known, known_ids, known_labels = shared.value
            for b in batches:
                for at in range(0, len(b), 256):
                    part = b.iloc[at : at + 256]
                    q = _table(part["vec"])
                    scores = _products(q, known)
                    same = part["label"].to_numpy()[:, None] == known_labels[None, :]
                    other = part["id"].to_numpy()[:, None] != known_ids[None, :]
                    targets = aims(part, scores, same & other, ~same)
                    low, high = bounds(tree, q)
                    out = []
                    for i, (who, where, what, vector) in enumerate(zip(part["id"], part["lot"], part["label"], part["vec"], strict=True)):
                        keys, least, most = targets[i]
                        if not len(keys):
                            continue
                        needed = np.flatnonzero(((100 * high[i][:, None] >= least) & (100 * low[i][:, None] <= most)).any(1))
                        by_bin: dict[int, list[int]] = {}
                        for leaf in needed.tolist():
                            first, span = bins[leaf]
                            for j in range(first, first + span):
                                by_bin.setdefault(j, []).append(leaf)
                        out += [(who, what, vector, where, j, leaves, keys, least, most) for j, leaves in by_bin.items()]
                    if out:
                        yield pd.DataFrame(out, columns=["id", "label", "vec", "lot", "bin", "leaves", "keys", "least", "most"])

        return materialize(asks.mapInPandas(route, "id long, label string, vec binary, lot int, bin int, leaves array<int>, keys array<long>, least array<double>, most array<double>"), "negatives-asks")

    def scanned(asks: DataFrame, same_label: bool, k: int) -> DataFrame:
        """(id, key, found, score): of each bin the k best rows for each target of each anchor."""
        pairs = asks.select("bin", F.col("lot").alias("to")).distinct().select(F.col("bin").alias("bin"), F.col("to").alias("lot"))
        left = base.join(pairs, "bin").select("bin", "lot", "leaf", "id", "label", "vec")

        def scan(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            who, what, found, reach = [], [], [np.empty(0, np.int64)], [np.empty(0)]
            rows = rows.sort_values("id", kind="stable")
            ids, leaf, labels, x = rows["id"].to_numpy(), rows["leaf"].to_numpy(), rows["label"].to_numpy(), _table(rows["vec"])
            for at in range(0, len(asked) if len(rows) else 0, 64):
                part = asked.iloc[at : at + 64]
                scores = _products(_table(part["vec"]), x)
                for i, a in enumerate(part.itertuples(index=False)):
                    fits = np.isin(leaf, a.leaves) & ((labels == a.label) == same_label) & (ids != a.id)
                    hundred = 100 * scores[i]
                    for target, least, most in zip(a.keys, a.least, a.most, strict=True):
                        best = _best(ids, scores[i], fits & (hundred >= least) & (hundred <= most), k)
                        who += [a.id] * len(best)
                        what += [target] * len(best)
                        found.append(ids[best])
                        reach.append(scores[i][best])
            return pd.DataFrame({"id": np.array(who, np.int64), "key": np.array(what, np.int64), "found": np.concatenate(found), "score": np.concatenate(reach)})

        both = left.groupBy("bin", "lot").cogroup(asks.groupBy("bin", "lot")).applyInPandas(scan, "id long, key long, found long, score double")
        rank = F.row_number().over(W.partitionBy("id", "key").orderBy(F.desc("score"), "found"))
        return both.withColumn("rank", rank).where(F.col("rank") <= k)

    def nearest(part: pd.DataFrame, scores: np.ndarray, same: np.ndarray, other: np.ndarray) -> list:
        last = _last(scores, same, positives)
        return [(np.array([0]), np.array([100 * t]), np.array([np.inf])) for t in last]

    def windows(part: pd.DataFrame, scores: np.ndarray, same: np.ndarray, other: np.ndarray) -> list:
        out = []
        for i, (found, reach) in enumerate(zip(part["found"], part["scores"], strict=True)):
            p = np.asarray(reach, np.float64)
            least, most = percent[0] * p, percent[1] * p
            hundred = 100 * scores[i]
            inside = other[i] & (hundred >= least[:, None]) & (hundred <= most[:, None])
            last = 100 * _last(np.broadcast_to(scores[i], inside.shape), inside, negatives)
            some = least <= most
            out.append((np.asarray(found, np.int64)[some], np.maximum(least, last)[some], most[some]))
        return out

    first = scanned(routed(anchors, nearest), True, positives)
    first = materialize(first.select("id", "found", "score"), "negatives-positives")
    # At most so many positives an anchor.
    held = first.groupBy("id").agg(F.collect_list("found").alias("found"), F.collect_list("score").alias("scores"))
    second = scanned(routed(anchors.join(held, "id"), windows), False, negatives)
    named = first.select(F.col("id").alias("anchor_id"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    second = second.select(F.col("id").alias("anchor_id"), F.col("key").alias("positive_id"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    return second.join(named, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

