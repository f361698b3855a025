"""Toxicity by the nearest labelled examples.

A document is scored by the votes of the labelled examples nearest to it by the cosine of
TF-IDF vectors. The search is exact: an inverted index over the examples keeps the largest
weight of each block of postings, blocks are taken by falling upper bound, and the search
ends when no block left can reach the k-th best cosine found.

The vectors' terms are words and beginnings of words whose share of toxic examples differs
from that of the others by more than chance (likelihood-ratio test) and by much (odds
ratio); without this choice the cosine of long texts is ruled by their many neutral words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, drop_outputs, fresh

_WORD = re.compile(r"[^\W_]+")
#: Words that a task remembers or counts at once.
HELD = 100_000


@dataclass(frozen=True)
class Settings:
    #: Labelled examples of a class that are learned from, drawn by a hash: about so many, all if there are fewer.
    per_class: int = 10_000
    #: Terms that the vectors have at most, and the least likelihood ratio of a term.
    terms: int = 8192
    least_ratio: float = 11.0
    #: Least odds ratio of a term, either way: without it come neutral words that longer texts hold more often.
    least_odds: float = 6.0
    neighbours: int = 15
    block: int = 64
    #: Weight of the share of toxic examples against the neighbours' weights.
    prior: float = 1.0
    seed: int = 17


def terms_of(word: str) -> tuple[str, ...]:
    """The word itself and, of longer words, the beginning of four letters (marked by ^)."""
    return (word, "^" + word[:4]) if len(word) > 4 else (word,)


class Index:
    """Examples' unit vectors by term, in blocks of example numbers."""

    def __init__(self, idf: dict[str, float], ids: list[int], labels: list[int], vectors: list[dict[str, float]], s: Settings):
        self.s, self.idf = s, idf
        self.terms = {t: i for i, t in enumerate(sorted(idf))}
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        self.prior = float(self.labels.mean()) if len(labels) else 0.0
        lists: dict[int, list[tuple[int, float]]] = {}
        for i, vector in enumerate(vectors):
            for t, w in vector.items():
                lists.setdefault(self.terms[t], []).append((i, w))
        self.n_blocks = len(ids) // s.block + 1
        self.postings, self.blocks = {}, {}
        for t, found in lists.items():
            who, weight = np.array([f[0] for f in found]), np.array([f[1] for f in found])
            block = who // s.block
            first = np.flatnonzero(np.r_[True, np.diff(block) > 0])
            self.postings[t] = (who, weight, np.searchsorted(block, np.arange(self.n_blocks + 1)))
            self.blocks[t] = (block[first], np.maximum.reduceat(weight, first))

    def vector(self, counts: dict[str, int]) -> dict[str, float]:
        """Unit TF-IDF vector over the chosen terms; empty without any."""
        weights = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items() if t in self.idf}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()} if norm else {}

    def nearest(self, vector: dict[str, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and cosines of the k nearest with a cosine over 0; ties to the smaller number."""
        query = [(self.terms[t], w) for t, w in vector.items() if self.terms[t] in self.postings]
        bound = np.zeros(self.n_blocks)
        for t, w in query:
            block, top = self.blocks[t]
            bound[block] += w * top
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound[order] > 0)]
        who, cos = np.empty(0, np.int64), np.empty(0)
        at, step = 0, 8
        while at < len(order):
            if len(who) >= k and bound[order[at]] < cos[-1] - 1e-12:
                break
            some = np.sort(order[at : at + step])
            at, step = at + step, 2 * step
            score = np.zeros((len(some), self.s.block))
            for t, w in query:
                ids, weights, first = self.postings[t]
                begin, n = first[some], first[some + 1] - first[some]
                if total := n.sum():
                    spread = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(total)
                    score[np.repeat(np.arange(len(some)), n), ids[spread] % self.s.block] += w * weights[spread]
            row, col = np.nonzero(score)
            who = np.concatenate([who, some[row] * self.s.block + col])
            cos = np.concatenate([cos, score[row, col]])
            best = np.lexsort((who, -cos))[:k]
            who, cos = who[best], cos[best]
        return who, cos

    def score(self, vector: dict[str, float]) -> tuple[float, np.ndarray, np.ndarray]:
        """Distance-weighted vote: each neighbour has the weight cos^2 / (1.01 - cos); the prior share has its own."""
        who, cos = self.nearest(vector, self.s.neighbours) if vector else (np.empty(0, np.int64), np.empty(0))
        weight = cos * cos / (1.01 - np.minimum(cos, 1.0))
        return float((weight @ self.labels[who] + self.s.prior * self.prior) / (weight.sum() + self.s.prior)), who, cos


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings = Settings()) -> Index:
    """The index of a bounded sample of the labelled documents.

    Rows of ``labels`` with a null key or label don't count; of several labels of a key the largest does. Documents of a
    repeated key are an example each. Only counts of terms and the sample's chosen terms reach the driver.
    """
    s = settings
    given = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    sizes = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    if not sizes:
        return Index({}, [], [], [], s)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(s.per_class / n))])
    draw = F.pmod(F.xxhash64(F.lit(s.seed), "key"), F.lit(1 << 30)) / float(1 << 30)
    sample = F.broadcast(given.where(draw < share[F.col("label")]))  # about 2 x per_class rows of two numbers
    examples = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(sample, "key")

    def presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            for text, label in zip(b["text"], b["label"], strict=True):
                found = {t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)}
                counts.update((t, label) for t in found)
                counts[("", label)] += 1
                if len(counts) > HELD:  # counts are summed over all parts afterwards
                    yield part(counts)
                    counts.clear()
        if counts:
            yield part(counts)

    def part(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"term": [t for t, _ in counts], "label": [y for _, y in counts], "n": list(counts.values())})

    seen = examples.mapInPandas(presence, "term string, label int, n long").groupBy("term").pivot("label", [0, 1]).agg(F.sum("n")).fillna(0)
    totals = seen.where("term = ''").first()
    if totals is None:
        return Index({}, [], [], [], s)
    n0, n1 = float(totals["0"]), float(totals["1"])
    ratio = _ratio_column(F.col("1"), n1, F.col("0"), n0)
    chosen = seen.where("term <> '' AND `0` + `1` >= 3").withColumn("r", ratio).where(F.col("r") >= s.least_ratio)
    odds = F.log((F.col("1") + 0.5) / (n1 - F.col("1") + 0.5)) - F.log((F.col("0") + 0.5) / (n0 - F.col("0") + 0.5))
    chosen = chosen.where(F.abs(odds) >= math.log(s.least_odds))
    chosen = chosen.orderBy(F.desc("r"), "term").limit(s.terms).collect()
    idf = {r["term"]: math.log(1 + (n0 + n1) / (r["0"] + r["1"])) for r in chosen}

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = [_counts(text, idf) for text in b["text"]]
            yield pd.DataFrame({"key": b["key"], "label": b["label"], "terms": [list(c) for c in counts], "n": [list(c.values()) for c in counts]})

    found = examples.mapInPandas(pick, "key long, label int, terms array<string>, n array<int>").orderBy("key", "terms").collect()
    empty = Index(idf, [], [], [], s)
    vectors = [empty.vector(dict(zip(r["terms"], r["n"], strict=True))) for r in found]
    return Index(idf, [r["key"] for r in found], [r["label"] for r in found], vectors, s)


def _ratio_column(a, n: float, b, m: float):
    def ll(k, n: float, p):
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(0.0)

    if not n or not m:
        return F.lit(0.0)
    p = (a + b) / (n + m)
    return 2 * (ll(a, n, a / n) + ll(b, m, b / m) - ll(a, n, p) - ll(b, m, p))


def _counts(text: str, idf: dict[str, float], cache: dict[str, tuple[str, ...]] | None = None) -> dict[str, int]:
    out: dict[str, int] = {}
    cache = {} if cache is None else cache
    for word, n in Counter(_WORD.findall(text.lower())).items():
        terms = cache.get(word)
        if terms is None:
            terms = cache[word] = tuple(t for t in terms_of(word) if t in idf)
        for t in terms:
            out[t] = out.get(t, 0) + n
    return out


def classify(docs: DataFrame, index: Index, text: str = "text", outputs: tuple[str, str, str] = ("score", "predicted", "evidence")) -> DataFrame:
    """``docs`` with ``outputs``: score (0 to 1), predicted (1 from 0.5 on) and evidence, the neighbours that voted.

    Only the text is read, whole. Texts that are null, empty or without a chosen term get the share of toxic examples (0
    without examples) and no evidence. Repeated rows get equal scores; an empty table stays empty; columns named as an
    output are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by per_class and terms

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ix, cache = shared.value, {}
        for texts in batches:
            scores, evidence = [], []
            for t in texts:
                if len(cache) > HELD:
                    cache.clear()
                score, who, cos = ix.score(ix.vector(_counts(t or "", ix.idf, cache)))
                scores.append(score)
                evidence.append([{"doc_id": int(ix.ids[i]), "label": int(ix.labels[i]), "cosine": float(c)} for i, c in zip(who, cos, strict=True)])
            yield pd.DataFrame({"score": scores, "predicted": [int(x >= 0.5) for x in scores], "evidence": pd.Series(evidence, dtype=object)})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, "score double, predicted int, evidence array<struct<doc_id:long,label:int,cosine:double>>")
    (name,) = fresh(docs, "found")
    kept = drop_outputs(docs, *outputs).columns
    found = [col(name)[c].alias(o) for c, o in zip(("score", "predicted", "evidence"), outputs, strict=True)]
    return docs.withColumn(name, udf(col(text))).select(*map(col, kept), *found)
