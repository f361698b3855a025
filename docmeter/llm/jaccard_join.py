"""N-gram Jaccard join with set-relation skipping.

A document's set holds the hashes of its word shingles. Equal sets are one item. An item's
tokens are ordered from rare to frequent; any two sets that reach the threshold share a
token of their prefixes, so only prefixes are indexed. Lists are sorted into blocks by size
and position, and blocks and entries without room for the threshold are skipped; answers of
a set follow from those of a similar set where these decide (see ``linking``).

Frequencies come from a sketch: counts of shingles by the leading bits of their hashes, over
all documents. It decides the order only, never the result. Hashes have 64 bits: that two
different shingles of a corpus of m meet has the odds m^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialize, scratch, slices
from .linking import POSTING, Rule, few, link, measured, overlap_of_hashes, shared_postings

WORDS, THRESHOLD = 5, 80
#: The sketch has a counter for this many bytes of text, within these bounds (powers of two).
SKETCH_BYTES, SKETCH_BITS = 192, (12, 24)
_ROWS = 1 << 12
#: Classes of the sets' signatures.
CLASSES = 256
#: Sets that a task remembers, so that copies in it are posted once.
DONE = 200_000


class Hasher:
    """Shingle sets of texts; hashes of words are kept for a while."""

    def __init__(self, words: int = WORDS, cache: int = 100_000):
        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                found = self[word] = xxhash.xxh3_64_intdigest(word)
                return found

        self.words, self.cache, self.known = words, cache, Words()

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct hashes, rising. ``bytes.lower`` and ``bytes.split`` know A-Z and ASCII white space only."""
        found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not found:
            return np.empty(0, np.uint64)
        if len(self.known) > self.cache:
            self.known.clear()
        x = np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        size = min(self.words, len(x))
        n = len(x) - size + 1
        m = np.uint64(0x9E3779B97F4A7C15)
        out = x[:n] ^ np.uint64(size)
        for i in range(1, size):
            out = (out ^ (out >> np.uint64(29))) * m + x[i : i + n]
        out = (out ^ (out >> np.uint64(32))) * m
        return np.unique(out ^ (out >> np.uint64(29)))

    @staticmethod
    def item(shingles: np.ndarray) -> int:
        return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def _scan(docs: DataFrame, words: int, bits: int, rule: Rule) -> DataFrame:
    """Rows of two kinds: a document's item, set size and signature; a block of a task's counters."""
    key_type = docs.schema["key"].dataType
    shape = f"key {key_type.simpleString()}, item long, n int, " + ", ".join(f"{c} long" for c in rule.signature) + ", block int, counts binary"
    names = ["key", "item", "n", *rule.signature, "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, key_arrow = Hasher(words), np.zeros(1 << bits, np.uint32), pa.null()
        for batch in batches:
            key_arrow = batch.column(0).type
            for b in slices(batch):
                items, sizes, signs = [], np.zeros(b.num_rows, np.int32), np.zeros((b.num_rows, len(rule.signature)), np.int64)
                for i, t in enumerate(b.column(1).to_pylist()):
                    s = hasher.shingles(t)
                    items.append(Hasher.item(s) if len(s) else None)
                    if len(s):
                        sizes[i], signs[i] = len(s), rule.sign(s, np.zeros(len(s)), 1)
                        np.add.at(counts, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
                none = pa.nulls(b.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.int64()), pa.array(sizes), *map(pa.array, signs.T), pa.array(np.full(b.num_rows, -1, np.int32)), none], names)
        width = min(_ROWS, len(counts))
        for at in range(0, len(counts), width):
            part = counts[at : at + width]
            if part.any():
                data = pa.array([np.minimum(part, 65535).astype("<u2").tobytes()], pa.binary())
                empty = [pa.nulls(1, t) for t in (key_arrow, pa.int64(), pa.int32(), *[pa.int64()] * len(rule.signature))]
                yield pa.RecordBatch.from_arrays([*empty, pa.array([at // width], pa.int32()), data], names)

    return docs.mapInArrow(run, shape)


def _classes(scanned: DataFrame, bits: int) -> np.ndarray:
    """The frequency class of each counter: 0 for usual ones, then by powers of two. As large as the sketch, a byte each."""

    def add(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<u2").astype(np.int64) for c in batch["counts"])
        return pd.DataFrame({"block": [key[0]], "counts": [total.astype("<i4").tobytes()]})

    add.__annotations__ = {"key": tuple, "batch": pd.DataFrame, "return": pd.DataFrame}
    rows = scanned.where("block >= 0").select("block", "counts").groupBy("block").applyInPandas(add, "block int, counts binary").toArrow()
    width = min(_ROWS, 1 << bits)
    counts = np.zeros((1 << bits) // width * width, np.int64).reshape(-1, width)
    for block, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        counts[block] = np.frombuffer(data, "<i4")
    flat = counts.ravel()
    usual = float(np.median(flat))
    over = flat > 2 * usual + 12
    return np.where(over, np.log2(np.maximum(flat, 1) / (usual + 1)).clip(0) + 1, 0).astype(np.uint8)


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles (set size) and component_id (smallest key reachable by links).

    Links: 100 * |intersection| >= threshold * |union|, exactly, over all documents and whole texts.

    * Null, empty and blank texts have no shingles and link with nothing; their component is their own key. With fewer
      than ``words`` words the whole sequence is one shingle.
    * A row with a null key stands in the component of the rows with its set; where none of these has a key, it links
      with nothing and its component is null. Repeated keys and rows are rows of their own; a key with several texts
      stands in each text's component.
    * The key may have any type that can be ordered; links are made by sets, so ties between keys don't matter.
    * Equal sets are collapsed first, task by task, so groups of copies cost no more than their count. An empty table
      gives an empty table. Other columns are left out.
    """
    spark = docs.sparkSession
    texts = docs.select(col(key).alias("key"), col(text).alias("text"))
    rule = Rule(threshold, True, CLASSES)
    with scratch(spark):
        total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(max(SKETCH_BITS[0], int(total // SKETCH_BYTES).bit_length()), SKETCH_BITS[1])
        scanned = materialize(_scan(texts, words, bits, rule), "jaccard-scan")
        rows = scanned.where("block < 0").select("key", "item", "n")
        first = scanned.where("block < 0 AND item IS NOT NULL").groupBy("item").agg(F.min("key").alias("key"), *[F.any_value(c).alias(c) for c in ("n", *rule.signature)])
        classes = spark.sparkContext.broadcast(_classes(scanned, bits))  # a byte a counter
        shared = shared_postings(texts.mapInArrow(_poster(classes, bits, words, threshold), POSTING), "jaccard-postings")

        def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(words)
            for batch in batches:
                for b in slices(batch):
                    s = [x for x in (hasher.shingles(t) for t in b.column(0).to_pylist()) if len(x)]
                    yield pa.RecordBatch.from_arrays([pa.array([Hasher.item(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())], ["item", "body"])

        def verify(pairs: DataFrame) -> DataFrame:
            items = pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct()
            needed = materialize(items.join(first, "item").select("key"), "jaccard-needed")
            sets = materialize(texts.join(few(needed), "key", "left_semi").select("text").mapInArrow(sets_of, "item long, body binary"), "jaccard-sets")
            return materialize(measured(pairs, sets.dropDuplicates(["item"]), _overlaps, threshold), "jaccard-tried")

        linked = link(shared, first.select("item", "n", *rule.signature), rule, verify, "jaccard")

        named = first.select("item", "key").join(linked.withColumnRenamed("node", "item"), "item", "left").withColumn("root", F.coalesce("root", "item"))
        names = named.groupBy("root").agg(F.min("key").alias("component_id"))
        by_item = named.join(names, "root").select("item", "component_id")
        out = rows.join(by_item, "item", "left")
        component = F.when(F.col("item").isNull(), F.col("key")).otherwise(F.col("component_id"))
        out = out.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
        return materialize(out, "jaccard-components", keep=True)


def _overlaps(x: list[bytes], y: list[bytes]) -> list[tuple[int, int]]:
    return [overlap_of_hashes(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(x, y, strict=True)]


def _poster(classes, bits: int, words: int, threshold: int):
    """Postings of the texts' prefixes, task by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, done, kinds = Hasher(words), set(), classes.value
        for batch in batches:
            for b in slices(batch):
                tokens, items, hot = [], [], []
                if len(done) > DONE:  # a copy that comes again is dropped when postings are sorted
                    done.clear()
                for t in b.column(1).to_pylist():
                    s = hasher.shingles(t)
                    item = Hasher.item(s) if len(s) else None
                    if item is None or item in done:
                        continue
                    done.add(item)
                    kind = kinds[(s >> np.uint64(64 - bits)).astype(np.int64)]
                    first = np.argsort(kind, kind="stable")[: len(s) - -(-threshold * len(s) // 100) + 1]
                    tokens.append(s[first].view(np.int64))
                    hot.append(kind[first] > 0)
                    items.append(item)
                if items:
                    sizes = [len(x) for x in tokens]
                    columns = np.concatenate(tokens), np.repeat(np.array(items, np.int64), sizes), np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]), np.concatenate(hot)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "item", "pos", "hot"])

    return run
