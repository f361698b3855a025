"""Links between items that share index entries, without all pairs of a group.

The index is a table of postings (token, item, pos); ``pos`` is the token's position in the
item's ordered set. Each item has its set's size n and a signature: the parities of some
hundred classes of its set's elements. The signatures of two sets differ in no more classes than
the sets differ in elements, so a signature is an upper bound of the overlap that never
loses a link. A list is one group of rows of one task; a longer list is cut into blocks by
size and position, and pairs of blocks whose bounds of size and position leave no room for
the threshold are skipped without being read.

There are two rounds. In the first each short list gives all its promising pairs, and a long
list (or block) only those of a few leaders and each item's nearest one; these are verified
exactly. In the second round answers are derived from those: what is linked to one set is in
the component of all, so only pairs of different components are left; and where both sets
were held against the same leader, the two overlaps bound theirs. Pairs that are still
promising are verified one by one, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, slices
from .components import components

#: Postings of a list that one task compares with each other; longer lists are cut into blocks of about so many.
BLOCK = 1024
#: Lists up to this length give all their promising pairs in the first round.
WHOLE = 8
#: Leaders of a longer list in the first round, and the pairs an item may have there before leaders are taken.
LEADERS, DENSE = 3, 3
#: So many keys (a few numbers each, 64 MB at most) are broadcast.
BROADCAST_KEYS = 1 << 20
POSTING = "token long, item long, pos int, hot boolean"
NARROW = ["item", "pos", "root", "lead", "held"]
_ROWS = [*NARROW, "n"]


@dataclass(frozen=True)
class Rule:
    """Links: 100 * |x & y| >= threshold * |x | y|. With ``by_position`` tokens are the sets' elements in one order for all,
    so that a pair's first common token leaves room for the overlap after it. ``classes`` (a power of two, 64 at least) are
    those of the signatures; they tell sets of up to about 1.5 times so many elements apart."""

    threshold: int
    by_position: bool
    classes: int

    @property
    def signature(self) -> list[str]:
        return [f"s{i}" for i in range(self.classes // 64)]

    @property
    def columns(self) -> list[str]:
        return [*self.signature, *_ROWS]

    def sign(self, hashes: np.ndarray, of: np.ndarray, sets: int) -> np.ndarray:
        """sets x classes / 64 signed numbers: the parities of the classes; ``of`` is the set of each distinct hash."""
        cell = of.astype(np.int64) * self.classes + (hashes & np.uint64(self.classes - 1)).astype(np.int64)
        odd = np.bincount(cell, minlength=sets * self.classes).astype(np.uint8) & 1
        return np.packbits(odd).view(np.int64).reshape(sets, -1)


def shared_postings(postings: DataFrame, name: str) -> DataFrame:
    """Postings of tokens that several items have; ``hot`` tokens are known to be such and may be spread over tasks.

    Sorted by token, so that a look at the neighbours decides; repeated postings of an item are dropped.
    """
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("item"), F.lit(64))).otherwise(0)
    dealt = postings.repartition(parts, "token", salt).sortWithinPartitions("token", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, not yet decided; and whether its token was seen before it
        seen = False
        for b in batches:
            if held is not None:
                b = pa.concat_batches([held, b])
            token, item, hot = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            if not len(token):
                continue
            new = np.r_[True, (token[1:] != token[:-1]) | (item[1:] != item[:-1])]
            b, token, hot = b.filter(pa.array(new)), token[new], hot[new]
            same = token[1:] == token[:-1]
            keep = np.r_[seen, same] | np.r_[same, False] | hot
            seen = bool(keep[-1] and not hot[-1]) or bool(len(same) and same[-1]) or (len(token) == 1 and seen)
            held = b.slice(len(token) - 1)
            yield b.slice(0, len(token) - 1).filter(pa.array(keep[:-1]))
        if held is not None and (seen or held.column(3)[0].as_py()):
            yield held

    return materialize(dealt.mapInArrow(run, POSTING).select("token", "item", "pos"), name)


def index_lists(shared: DataFrame, items: DataFrame, name: str) -> DataFrame:
    """(token, block, c, item, pos): the lists; c is the list's length. Sizes and signatures join them where they are read.

    ``block`` is 0, but in lists longer than ``BLOCK``: there sizes (by classes a quarter apart) and positions (by powers
    of two) and, within these, a hash of the item cut the list.
    """
    lengths = shared.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    rows = materialize(shared.join(lengths.where("c > 1"), "token").withColumn("block", F.lit(0).cast("long")), name)
    long = rows.where(F.col("c") > BLOCK)
    if long.isEmpty():
        return rows
    cell = F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))) * 64 + F.floor(F.log2(F.col("pos") + 1))
    long = long.join(items.select("item", "n"), "item").withColumn("cell", cell)
    cells = long.groupBy("token", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"))
    block = (F.col("cell") * (1 << 24) + F.pmod(F.xxhash64("item", "token"), F.col("cuts")) + 1).cast("long")
    cut = long.join(cells, ["token", "cell"]).withColumn("block", block).select(*rows.columns)
    return materialize(rows.where(F.col("c") <= BLOCK).unionByName(cut), f"{name}-cut")


class _Rows:
    """Columns of one side of a comparison."""

    def __init__(self, b: pa.RecordBatch, rule: Rule):
        for c in _ROWS:
            setattr(self, c, b.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False))
        self.sig = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in rule.signature], axis=1).view(np.uint64)


def _promising(x: _Rows, i: np.ndarray, y: _Rows, j: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Whether the rows i of x may be linked with the rows j of y (arrays that broadcast), and in how many classes they differ."""
    n, m, t = x.n[i], y.n[j], rule.threshold
    least = -(-t * (n + m) // (100 + t))
    ok = (x.root[i] != y.root[j]) & (100 * np.minimum(n, m) >= t * np.maximum(n, m))
    if rule.by_position:
        ok &= np.minimum(n - x.pos[i], m - y.pos[j]) >= least
    differ = np.zeros(np.broadcast_shapes(i.shape, j.shape), np.int16)
    for k in range(x.sig.shape[1]):
        differ += np.bitwise_count(x.sig[i, k] ^ y.sig[j, k])
    ok &= differ <= n + m - 2 * least
    # Held against the same leader, what each has outside of the overlap with it bounds the rest.
    p, q = x.held[i], y.held[j]
    ok &= (x.lead[i] != y.lead[j]) | (np.minimum(p, q) + np.minimum(n - p, m - q) >= least)
    return ok, differ


def _short(x: _Rows, group: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Promising pairs of rows of equal groups, the groups lying side by side."""
    far = 1
    i = np.arange(len(group) - 1)
    while len(i := i[i + far < len(group)]) and len(i := i[group[i] == group[i + far]]):
        ok, _ = _promising(x, i, x, i + far, rule)
        yield i[ok], i[ok] + far
        far += 1


def _block(x: _Rows, xs: np.ndarray, y: _Rows, ys: np.ndarray, rule: Rule, leaders: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Promising pairs between rows xs and rows ys; with ``leaders`` (xs = ys) only those of the first round where they are many."""
    found, gap = np.zeros((len(xs), len(ys)), bool), np.zeros((len(xs), len(ys)) if leaders else (0, 0), np.int16)
    for at in range(0, len(xs), 64):
        ok, differ = _promising(x, xs[at : at + 64, None], y, ys[None, :], rule)
        found[at : at + 64] = ok
        if leaders:
            gap[at : at + 64] = np.where(ok, differ, rule.classes + 1)
    if not leaders or found.sum() <= 2 * DENSE * len(xs):
        i, j = np.nonzero(found)
        yield xs[i], ys[j]
        return
    near = gap.argmin(1)
    has = np.flatnonzero(found.any(1))
    yield xs[has], ys[near[has]]
    left = np.ones(len(xs), bool)
    for _ in range(LEADERS):
        lead = int((found & left[None, :]).sum(1).argmax())
        mine = np.flatnonzero(found[lead] & left)
        if not len(mine):
            break
        yield np.full(len(mine), xs[lead]), ys[mine]
        left[mine] = left[lead] = False


def _compare(rows: DataFrame, items: DataFrame, rule: Rule, first: bool) -> DataFrame:
    """(a, b): promising pairs of each group (token, u, v); side 0: of the group's rows, sides 1 and 2: between the two sides."""
    rows = rows.drop("n").join(items, "item")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["token", "u", "v"]
    dealt = rows.select(*key, "side", *rule.columns).repartition(parts, *key).sortWithinPartitions(*key, "side", "item")

    def pairs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _Rows(b, rule)
        group = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in key])
        side = b.column("side").to_numpy(zero_copy_only=False)
        new = np.r_[True, (group[:, 1:] != group[:, :-1]).any(0)]
        number = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(side)])
        big = (sizes > WHOLE) | (side[starts] > 0)
        mine = ~big[number]
        found = []
        if mine.any():
            # rows of long groups stand apart, each as a group of its own
            found += list(_short(x, np.where(mine, number, -1 - np.arange(len(number))), rule))
        for start, size in zip(starts[big], sizes[big], strict=True):
            at = np.arange(start, start + size)
            if side[start] == 0:
                found += list(_block(x, at, x, at, rule, first))
            else:
                found += list(_block(x, at[side[at] == 1], x, at[side[at] == 2], rule, False))
        if found:
            i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            a, b = np.minimum(x.item[i], x.item[j]), np.maximum(x.item[i], x.item[j])
            keep = np.unique(np.stack([a, b], 1)[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(keep[:, 0]), pa.array(keep[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = [b.column(c)[b.num_rows - 1] for c in key]
            same = np.logical_and.reduce([b.column(c).to_numpy(zero_copy_only=False) == v.as_py() for c, v in zip(key, last, strict=True)])
            cut = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if same.all():
                if held and [held[0].column(c)[0] for c in key] != last:
                    yield from pairs(pa.concat_batches(held))
                    held = []
                held.append(b)
                continue
            yield from pairs(pa.concat_batches([*held, b.slice(0, cut)]))
            held = [b.slice(cut)]
        if held:
            yield from pairs(pa.concat_batches(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _alone(lists: DataFrame) -> DataFrame:
    return lists.select("token", F.col("block").alias("u"), F.col("block").alias("v"), F.lit(0).alias("side"), *NARROW)


def _across(lists: DataFrame, rule: Rule) -> DataFrame:
    """Groups of the second round: lists with several roots; of long lists the pairs of blocks that sizes, positions and roots leave."""
    mixed = lists.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token")
    lists = lists.join(mixed, "token")
    bounds = lists.where(F.col("c") > BLOCK).groupBy("token", "block").agg(
        *[f(c).alias(f"{c}_{k}") for c in ("n", "pos", "root") for k, f in (("lo", F.min), ("hi", F.max))]
    )
    pairs = bounds.alias("l").join(bounds.alias("x"), (F.col("l.token") == F.col("x.token")) & (F.col("l.block") <= F.col("x.block")) & _reach(rule))
    pairs = materialize(pairs.select(F.col("l.token").alias("token"), F.col("l.block").alias("u"), F.col("x.block").alias("v")), "link-blocks")
    short = _alone(lists.where(F.col("c") <= BLOCK))
    if pairs.isEmpty():
        return short
    own = lists.where(F.col("c") > BLOCK)
    sides = [(1, "u", "u < v"), (2, "v", "u < v"), (0, "u", "u = v")]
    for side, end, which in sides:
        some = pairs.where(which).select(F.col("token").alias("t"), "u", "v")
        part = own.join(some, (F.col("token") == F.col("t")) & (F.col("block") == F.col(end)))
        short = short.unionByName(part.select("token", "u", "v", F.lit(side).alias("side"), *NARROW))
    return short


def _reach(rule: Rule) -> Column:
    """Whether two blocks l and x hold rows that could be linked, by their bounds."""
    t = rule.threshold
    out = F.expr(f"100 * l.n_hi >= {t} * x.n_lo AND 100 * x.n_hi >= {t} * l.n_lo AND NOT (l.root_lo = l.root_hi AND l.root_lo = x.root_lo AND x.root_lo = x.root_hi)")
    if rule.by_position:
        out &= F.expr(f"least(l.n_hi - l.pos_lo, x.n_hi - x.pos_lo) * {100 + t} >= {t} * (l.n_lo + x.n_lo)")
    return out


def link(shared: DataFrame, items: DataFrame, rule: Rule, verify: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Components (node, root) of the links between items (item, n, s0 ...) that share a posting.

    ``verify`` takes pairs (a, b) and gives each with ``held``, the exact overlap, and ``linked``.
    """
    with scratch(shared.sparkSession):
        lists = index_lists(shared, items, f"{name}-lists")
        alone = lists.withColumns({"root": F.col("item"), "lead": F.col("item"), "held": F.lit(0)})
        tried = materialize(verify(materialize(_compare(_alone(alone), items, rule, True), f"{name}-first")), f"{name}-tried")
        roots = components(tried.where("linked"))
        # The other pairs are in lists of which the first round left some out.
        long = lists.where(F.col("c") > WHOLE)
        if not long.isEmpty():
            long = long.join(items.select("item", "n"), "item").join(roots.withColumnRenamed("node", "item"), "item", "left").join(leaders(tried), "item", "left")
            long = long.withColumns({"root": F.coalesce("root", "item"), "lead": F.coalesce("lead", "item"), "held": F.coalesce("held", "n")})
            groups = _across(materialize(long, f"{name}-long"), rule)
            rest = _compare(groups, items, rule, False).join(tried.select("a", "b"), ["a", "b"], "left_anti")
            rest = materialize(rest, f"{name}-rest")
            if not rest.isEmpty():
                edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
                roots = components(verify(rest).where("linked").select("a", "b").unionByName(edges))
        return materialize(roots, f"{name}-roots", keep=True)


def leaders(tried: DataFrame) -> DataFrame:
    """(item, lead, held): of the sets that an item was held against, the one that most were held against, and the overlap."""
    ends = tried.select(F.col("a").alias("item"), F.col("b").alias("lead"), "held").unionAll(tried.select(F.col("b").alias("item"), F.col("a").alias("lead"), "held"))
    often = tried.select(F.explode(F.array("a", "b")).alias("lead")).groupBy("lead").agg(F.count(F.lit(1)).alias("times"))
    best = ends.join(often, "lead").groupBy("item").agg(F.max(F.struct("times", "lead", "held")).alias("m"))
    return best.select("item", "m.lead", "m.held")


def few(keys: DataFrame, rows: int | None = None) -> DataFrame:
    """Keys to be joined: broadcast if their rows (or the numbers they hold) are at most ``BROADCAST_KEYS``."""
    return F.broadcast(keys) if (keys.count() if rows is None else rows) <= BROADCAST_KEYS else keys


def measured(pairs: DataFrame, bodies: DataFrame, overlaps: Callable[[list, list], list[tuple[int, int]]], threshold: int) -> DataFrame:
    """The pairs with held, the overlap of their bodies' sets, and linked; ``overlaps`` gives overlap and union of columns of bodies."""
    a, b = (bodies.select(F.col("item").alias(c), F.col("body").alias(f"body_{c}")) for c in "ab")
    rows = pairs.join(a, "a").join(b, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch):
                found = overlaps(t.column(2).to_pylist(), t.column(3).to_pylist())
                held = pa.array([f[0] for f in found], pa.int32())
                linked = pa.array([100 * both >= threshold * union for both, union in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), held, linked], ["a", "b", "held", "linked"])

    return rows.select("a", "b", "body_a", "body_b").mapInArrow(run, "a long, b long, held int, linked boolean")


def overlap_of_hashes(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Overlap and union of two sets of distinct rising hashes."""
    found = np.sort(np.concatenate([a, b]), kind="stable")
    both = int(np.count_nonzero(found[1:] == found[:-1]))
    return both, len(a) + len(b) - both
