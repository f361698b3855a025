"""Nearest neighbours for the largest inner product, from cells and codes.

Vectors are dealt into cells (k-means on a bounded sample); what they differ by from their
cell's centre is coded by a product quantiser whose loss is score-aware: the part of the
error parallel to the vector, which shifts large inner products, costs ``eta`` times the
orthogonal part. Codes have four bits. A query looks into the cells with the largest inner
products to their centres, scans their codes by a table of 16 entries a subspace, and the
best of each block are reranked by the exact inner product in double precision.

Neither cells nor codes are trusted further than their error reaches. A cell keeps the
distance of its farthest vector, a vector that between it and what its code says; times the
query's length these bound the inner product from above. The k-th best of the sample is a
bound from below. Cells and codes between the two are looked into and reranked as well, so
nothing is missed, whatever the rows are like; codes that say little cost time only.

A cell is cut into blocks of bounded size, and so are the queries that look into it, so
that a cell or a single vector with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the rows the index is fitted on; every row is coded and searched."""

    sample: int = 8_192
    cells: int = 64
    #: Share of the cells that a query looks into at least; bounds add those that may hold nearer vectors.
    probe: float = 0.72
    #: Components a subspace; four bits each.
    sub: int = 2
    #: Candidates of a block that are reranked at least, as a multiple of k; bounds add those that may be nearer.
    rerank: int = 4
    #: Inner products over this share of the product of norms are what the loss protects.
    threshold: float = 0.2
    rounds: int = 8
    block: int = 4096
    query_block: int = 1024
    seed: int = 17


@dataclass
class Model:
    """All but ``ids`` and ``scale`` is of vectors divided by ``scale``, so that squares neither overflow nor vanish."""

    centres: np.ndarray  # cells x d
    books: np.ndarray  # subspaces x 16 x sub
    eta: float
    scale: float
    sample: np.ndarray
    ids: np.ndarray


def usable(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Rows that take part: not null, no null or non-finite component, not zero; of the most frequent length."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL AND size(vec) > 0")
    finite = "forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    return rows.where(finite).where("exists(vec, x -> x <> 0)")


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        for j in range(k):
            mine = x[near == j]
            centres[j] = mine.mean(0) if len(mine) else x[rng.integers(len(x))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    """The rows' directions."""
    x = x / np.maximum(np.abs(x).max(1), np.finfo(float).tiny)[:, None]
    return x / np.maximum(np.linalg.norm(x, axis=1), np.finfo(float).tiny)[:, None]


def encode(books: np.ndarray, x: np.ndarray, unit: np.ndarray, eta: float, sweeps: int = 2, rows: int = 1024) -> np.ndarray:
    """Codes by coordinate descent on |r|^2 + (eta - 1) <r, unit>^2, r being the residual; so many rows at a time."""
    return np.concatenate([_encode(books, x[i : i + rows], unit[i : i + rows], eta, sweeps) for i in range(0, len(x), rows)])


def _encode(model_books: np.ndarray, x: np.ndarray, unit: np.ndarray, eta: float, sweeps: int) -> np.ndarray:
    m, _, s = model_books.shape
    parts, unit = x.reshape(len(x), m, s), unit.reshape(len(x), m, s)
    # per subspace and centre: squared distance, and the residual's part along x
    diff = parts[:, :, None, :] - model_books[None]
    square = (diff**2).sum(3)
    along = np.einsum("nmks,nms->nmk", diff, unit)
    codes = square.argmin(2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            cost = square[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2
            codes[:, j] = cost.argmin(1)
            total = rest + along[rows, j, codes[:, j]]
    return codes.astype(np.uint8)


def _decode(books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.concatenate([books[j][codes[:, j]] for j in range(len(books))], axis=1)


def _learn_books(x: np.ndarray, unit: np.ndarray, s: Settings, eta: float, rng: np.random.Generator) -> np.ndarray:
    d = x.shape[1]
    m = d // s.sub
    books = np.stack([_kmeans(x[:, j * s.sub : (j + 1) * s.sub], 16, s.rounds, rng) for j in range(m)])
    for _ in range(s.rounds // 2):
        codes = encode(books, x, unit, eta)
        resid = x - _decode(books, codes)
        total = (resid * unit).sum(1)
        for j in range(m):
            cut = slice(j * s.sub, (j + 1) * s.sub)
            part, u = x[:, cut], unit[:, cut]
            rest = total - (resid[:, cut] * u).sum(1)
            for c in range(16):  # the weighted least-squares centre of its vectors
                mine = codes[:, j] == c
                if mine.sum() < s.sub:
                    continue
                p, v, a = part[mine], u[mine], rest[mine]
                left = np.eye(s.sub) * len(p) + (eta - 1) * v.T @ v
                right = p.sum(0) + (eta - 1) * (v * (a + (p * v).sum(1))[:, None]).sum(0)
                books[j, c] = np.linalg.solve(left, right)
            resid[:, cut] = part - books[j][codes[:, j]]
            total = rest + (resid[:, cut] * u).sum(1)
    return books


def _padded(x: np.ndarray, s: Settings) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % s.sub)))


def fit(sample: np.ndarray, ids: np.ndarray, s: Settings) -> Model:
    """On the driver, from the bounded sample only."""
    rng = np.random.default_rng(s.seed)
    d = sample.shape[1]
    share = s.threshold**2
    eta = max(1.0, (d - 1) * share / (1 - share))
    scale = float(np.abs(sample).max())
    sample = sample / scale
    centres = _kmeans(sample, min(s.cells, len(sample)), s.rounds, rng)
    x = sample - centres[_nearest(sample, centres)]
    return Model(centres, _learn_books(_padded(x, s), _padded(_unit(sample), s), s, eta, rng), eta, scale, sample, ids)


def _pack(codes: np.ndarray) -> np.ndarray:
    even = codes if codes.shape[1] % 2 == 0 else np.pad(codes, ((0, 0), (0, 1)))
    return (even[:, 0::2] | (even[:, 1::2] << 4)).astype(np.uint8)


def _unpack(packed: np.ndarray, m: int) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, 0::2], out[:, 1::2] = packed & 15, packed >> 4
    return out[:, :m]


def least_scores(model: Model, ids: np.ndarray, unit: np.ndarray, k: int) -> np.ndarray:
    """For each query (a direction) what the k-th best of the sample's other rows scores: its k nearest are no worse."""
    if len(model.sample) < k:
        return np.full(len(unit), -np.inf)
    scores = unit @ model.sample.T
    scores[ids[:, None] == model.ids[None, :]] = -np.inf
    return np.partition(scores, len(model.sample) - k, axis=1)[:, len(model.sample) - k]


def _candidates(est: np.ndarray, room: np.ndarray, x: np.ndarray, unit: np.ndarray, least: np.ndarray, other: np.ndarray, k: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of the pairs that may be among a query's k best of the block.

    ``est`` (queries x rows) is what the codes say and ``room`` how far a row's may be wrong. The r best by codes raise the
    bound ``least``; what lies above it with its room is measured. Not-a-number rules nothing out.
    """
    n = len(x)
    if n > r:
        best = np.argpartition(est, n - r, axis=1)[:, n - r :]
        near = np.einsum("qrd,qd->qr", x[best], unit)
        near[~np.take_along_axis(other, best, axis=1)] = -np.inf
        least = np.maximum(least, np.partition(near, r - k, axis=1)[:, r - k])
    may = other & ~(est + room < least[:, None].astype(np.float32))
    if may.sum() * 16 < may.size:
        return np.nonzero(may)
    scores = unit @ x.T
    may &= ~(scores + room < least[:, None])
    if n > k:
        kth = np.partition(np.where(may, scores, -np.inf), n - k, axis=1)[:, n - k]
        may &= ~(scores + 1e-9 * np.linalg.norm(x, axis=1) < kth[:, None])
    return np.nonzero(may)


def search(
    vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vec: str = "embedding", settings: Settings = Settings()
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query (``is_query``: a condition on ``key``) the k nearest others.

    * Vectors that are null, zero, or hold a null or non-finite component take no part, as query or candidate; nor do
      vectors of another length than the most frequent one. Other columns are not read.
    * Scores are inner products of the original vectors in double precision; ties go to the smaller id. A row is no
      candidate of its own query; a repeated id is one row for this. Fewer candidates give fewer rows; an empty table or
      no query gives an empty table.
    """
    spark = vectors.sparkSession
    s = settings
    rows = usable(vectors, key, vec)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return empty
    d = lengths["d"]
    rows = rows.where(F.size("vec") == d)
    drawn = rows.orderBy(F.xxhash64(F.lit(s.seed), "id"), "id").limit(s.sample).select("id", "vec").toArrow()
    model = fit(drawn.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, d), drawn.column("id").to_numpy(), s)
    m = len(model.books)
    shared = spark.sparkContext.broadcast(model)  # (sample + cells + 16) x d numbers
    probes = max(1, min(len(model.centres), round(s.probe * len(model.centres))))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mod = shared.value
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["vec"].to_numpy()).astype(np.float64)
            scaled = x / mod.scale
            cell = _nearest(scaled, mod.centres)
            rest = _padded(scaled - mod.centres[cell], s)
            codes = encode(mod.books, rest, _padded(_unit(scaled), s), mod.eta)
            far, off = np.linalg.norm(rest, axis=1), np.linalg.norm(rest - _decode(mod.books, codes), axis=1)
            yield pd.DataFrame({"id": b["id"], "cell": cell.astype(np.int32), "far": far, "off": off, "code": [r.tobytes() for r in _pack(codes)], "vec": [r.tobytes() for r in x]})

    index = materialize(rows.mapInPandas(code, "id long, cell int, far double, off double, code binary, vec binary"), "ann-index")
    # One row per cell: as many as the settings say.
    blocks = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / s.block).cast("int").alias("blocks"), F.max("far").alias("reach"))
    reach = np.zeros(len(model.centres))
    for r in blocks.collect():
        reach[r.cell] = r.reach
    hashed = F.pmod(F.xxhash64(F.lit(s.seed), "id"), F.col("blocks")).cast("int")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mod = shared.value
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.iloc[at : at + 256]
                ids, unit = b["id"].to_numpy(), _unit(np.stack([np.frombuffer(v) for v in b["vec"]]))
                least = least_scores(mod, ids, unit, k)
                centre = unit @ mod.centres.T
                # what rounding may take from a bound
                slack = 1e-9 * (np.linalg.norm(mod.centres, axis=1) + reach)
                look = ~(centre + reach + slack < least[:, None])
                np.put_along_axis(look, np.argsort(-centre, axis=1, kind="stable")[:, :probes], True, axis=1)
                i, cell = np.nonzero(look)
                yield pd.DataFrame({"id": ids[i], "vec": b["vec"].to_numpy()[i], "least": least[i], "cell": cell.astype(np.int32)})

    queries = index.where(is_query(F.col("id"))).select("id", "vec").mapInPandas(route, "id long, vec binary, least double, cell int")
    queries = materialize(queries, "ann-queries")
    asked = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / s.query_block).cast("int").alias("lots"))
    sizes = F.broadcast(blocks.drop("reach").join(asked, "cell"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lot = F.pmod(F.xxhash64(F.lit(s.seed), "id"), F.col("lots")).cast("int")
    base = index.join(sizes, "cell").select("id", "cell", "far", "off", "code", "vec", hashed.alias("block"), each("lots").alias("lot"))
    ask = queries.join(sizes, "cell").select("id", "cell", "vec", "least", lot.alias("lot"), each("blocks").alias("block"))

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("id", kind="stable")
            # Of equal vectors only the k + 1 smallest ids can be among the nearest k.
            left = left[left.groupby("vec").cumcount() <= k]
            ids, asked_by = left["id"].to_numpy(), right["id"].to_numpy()
            codes = _unpack(np.stack([np.frombuffer(c, np.uint8) for c in left["code"]]), m)
            x = np.stack([np.frombuffer(v) for v in left["vec"]])
            q = np.stack([np.frombuffer(v) for v in right["vec"]])
            mod = shared.value
            scaled, unit, least = x / mod.scale, _unit(q), right["least"].to_numpy()
            centre = mod.centres[left["cell"].iloc[0]]
            off = left["off"].to_numpy()
            # the tables' numbers are single: their rounding is added to the room
            room = (off + (m + 4) * 2.0**-22 * (np.linalg.norm(centre) + left["far"].to_numpy() + off) + 1e-37).astype(np.float32)
            table = np.einsum("qms,mks->mkq", _padded(unit, s).reshape(len(q), m, s.sub), mod.books).astype(np.float32)
            for at in range(0, len(q), 64):
                lot = slice(at, at + 64)
                est = np.tile((unit[lot] @ centre).astype(np.float32), (len(ids), 1))
                for j in range(m):
                    est += np.ascontiguousarray(table[j, :, lot])[codes[:, j]]
                other = asked_by[lot, None] != ids[None, :]
                i, j = _candidates(np.ascontiguousarray(est.T), room, scaled, unit[lot], least[lot], other, k, k * s.rerank)
                i = i + at
                exact = np.einsum("nd,nd->n", x[j], q[i])
                order = np.lexsort((ids[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append(pd.DataFrame({"query_id": asked_by[i[first]], "vec_id": ids[j[first]], "score": exact[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    by = ["cell", "block", "lot"]
    found = base.groupBy(*by).cogroup(ask.groupBy(*by)).applyInPandas(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
