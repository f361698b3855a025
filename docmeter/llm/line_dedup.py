"""Fuzzy deduplication of lines across all documents.

Lines are compared by their character shingles: MinHash signatures (one permutation, in
bins, with the gaps filled from the right), bands of the signature as index entries, exact
Jaccard verification of the lines that share a band, then distributed union-find. Of each
component of near-equal lines the first one stays, by key and place.

With 9 bands of 5 values a pair at similarity 0.8 is found with odds 0.97, one at 0.9 with
odds over 0.999. Equal lines are always found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, materialize, scratch, slices
from .linking import Rule, few, link, measured, overlap_of_hashes

CHARS, THRESHOLD, BANDS, BAND_ROWS = 5, 80, 9, 5
#: Classes of the lines' signatures.
CLASSES = 1024
#: Characters that are hashed at once (what is made of them stays in the cache), and those whose bands are formed at once.
CHUNK, LOT = 1 << 15, 1 << 19
#: Lines that a task remembers, so that copies in it are posted once.
DONE = 200_000
#: Postings that one task of the index sorts, and those that are dealt to the tasks at once.
BUCKET, DEAL = 1 << 21, 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def normal_line(line: str) -> str:
    return " ".join(line.lower().split())


def line_item(line: str) -> int:
    """Identity of a normalised line."""
    return int(line_items([line])[0])


def line_items(lines: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(x.encode("utf-8", "surrogatepass")) for x in lines], np.uint64).view(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _GOLD
    x ^= x >> np.uint64(29)
    x *= _GOLD
    x ^= x >> np.uint64(32)
    return x


def shingle_hashes(lines: list[str], chars: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of non-empty lines, and the line of each; a shorter line is one shingle."""
    padded = [x if len(x) >= chars else x.ljust(chars, "\0") for x in lines]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = len(codes) - chars + 1
    rolled = codes[:size].copy()
    for i in range(1, chars):
        rolled *= np.uint64(1_000_003)
        rolled += codes[i : i + size]
    # windows over the end of a line are left out
    inside = np.ones(size, bool)
    ends = np.cumsum(lengths)[:-1]
    for i in range(1, chars):
        inside[ends - i] = False
    return _mix(rolled[inside]), np.repeat(np.arange(len(padded)), lengths - chars + 1)


def band_hashes(lines: list[str], chars: int = CHARS, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """lines x bands: hashes of bands of the MinHash signature."""
    bins = bands * rows
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full((len(lines), bins), empty)
    done = 0
    for part in _chunks(lines):
        hashes, line = shingle_hashes(part, chars)
        own = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        np.minimum.at(least[done : done + len(part)].reshape(-1), line * bins + own.astype(np.int64), hashes)
        done += len(part)
    # an empty bin takes the next full one to the right, around the end, marked by the distance
    place = np.where(least != empty, np.arange(bins), 2 * bins)
    twice = np.concatenate([place, place + bins], axis=1)
    following = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :bins]
    away = (following - np.arange(bins)).astype(np.uint64)
    taken = np.take_along_axis(least, following % bins, axis=1)
    filled = np.where(away == 0, least, _mix(taken + away * _GOLD))
    out = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.ones((len(lines), 1), np.uint64)
    for i in range(rows):
        out = _mix(out + filled[:, i::rows])
    return out


def _chunks(lines: list[str], chars: int = CHUNK) -> Iterator[list[str]]:
    at = size = 0
    for i, x in enumerate(lines):
        size += len(x)
        if size >= chars:
            yield lines[at : i + 1]
            at, size = i + 1, 0
    if at < len(lines):
        yield lines[at:]


def line_sets(lines: list[str], chars: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the lines' character shingles, rising within each line, and the line of each."""
    hashes, line = shingle_hashes(lines, chars)
    ends = np.cumsum(np.bincount(line, minlength=len(lines))).tolist()
    for start, end in zip([0, *ends], ends, strict=False):
        hashes[start:end].sort()
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])]
    return hashes[new], line[new]


def overlaps(chars: int):
    """For columns of lines x and y: overlap and union of the sets of character shingles of each pair."""

    def of(x: list[str], y: list[str]) -> list[tuple[int, int]]:
        every, sets = list({*x, *y}), {}
        for part in _chunks(every):
            hashes, line = line_sets(part, chars)
            for text, found in zip(part, np.split(hashes, np.flatnonzero(np.diff(line)) + 1), strict=True):
                sets[text] = found
        return [overlap_of_hashes(sets[a], sets[b]) for a, b in zip(x, y, strict=True)]

    return of


def _lines(text: str | None) -> list[tuple[int, str]]:
    """Place and normalised form of the lines that aren't blank."""
    return [(i, y) for i, x in enumerate((text or "").lower().split("\n")) if (y := " ".join(x.split()))]


def duplicate_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", chars: int = CHARS, threshold: int = THRESHOLD
) -> DataFrame:
    """One row per document: key, text_hash, n_lines (not blank) and drop, the places of the lines that repeat an earlier one.

    Earlier is: smaller key (null last), then hash of the text, then place. Rows with the same key and text count as one
    document. Null and empty texts have no lines; blank lines are neither compared nor dropped; lines shorter than
    ``chars`` are one shingle. Lines of any length are compared whole; an empty table gives an empty table.
    """
    texts = docs.select(col(key).alias("key"), F.xxhash64(col(text)).alias("th"), col(text).alias("text"))
    rule = Rule(threshold, False, CLASSES)
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):
            # Bands take most of the room, so they go as soon as the index stands.
            places = materialize(texts.mapInArrow(_places(chars), _shape(texts)), "line-places")
            shared = materialize(distinct_lists(shared_bands(places)), "line-lists", keep=True)
            seen = materialize(places.drop("bands"), "line-seen", keep=True)
        at = F.struct(F.col("key").isNull().alias("no_key"), "key", "th", "line")
        first = materialize(seen.where("item IS NOT NULL").groupBy("item").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("c")), "line-items")

        # The lines that share a band with another one, each from its first place.
        needed = shared.select("item").distinct().join(first, "item").groupBy(F.col("at.key").alias("k"), F.col("at.th").alias("t"))
        needed = materialize(needed.agg(F.collect_list(F.struct(F.col("at.line").alias("line"), "item")).alias("wanted")), "line-needed")
        held = needed.agg(F.sum(F.size("wanted"))).first()[0] or 0
        same = F.col("key").eqNullSafe(F.col("k")) & (F.col("th") == F.col("t"))
        found = texts.join(few(needed, held), same).select("text", "wanted")
        shape = "item long, body string, n int, " + ", ".join(f"{c} long" for c in rule.signature)
        bodies = materialize(found.mapInArrow(_bodies(chars, rule), shape), "line-bodies")
        if bodies.count() > held:  # rows of the same key and text give their lines again
            bodies = materialize(bodies.dropDuplicates(["item"]), "line-bodies-once")

        def verify(pairs: DataFrame) -> DataFrame:
            return materialize(measured(pairs, bodies.select("item", "body"), overlaps(chars), threshold), "line-tried")

        linked = link(shared, bodies.drop("body"), rule, verify, "lines")

        # Only lines that occur again, as they are or nearly so, can be dropped.
        again = first.join(linked.withColumnRenamed("node", "item"), "item", "left").join(linked.select(F.col("root").alias("r")).distinct(), F.col("item") == F.col("r"), "left")
        again = again.where("c > 1 OR root IS NOT NULL OR r IS NOT NULL").withColumn("root", F.coalesce("root", "item"))
        stays = again.groupBy("root").agg(F.min("at").alias("first"))
        drop = again.join(stays, "root").select("item", "first")
        dropped = seen.join(drop, "item").where(
            ~(F.col("key").eqNullSafe(F.col("first.key")) & (F.col("th") == F.col("first.th")) & (F.col("line") == F.col("first.line")))
        )
        dropped = dropped.groupBy("key", "th").agg(F.array_sort(F.collect_set("line")).alias("drop"))
        every = seen.where("head").select("key", "th", "n_lines").distinct()
        dropped = dropped.withColumnsRenamed({"key": "k", "th": "t"})
        out = every.join(dropped, same, "left")
        none = F.array().cast("array<int>")
        out = out.select(F.col("key").alias(key), F.col("th").alias("text_hash"), "n_lines", F.coalesce("drop", none).alias("drop"))
        return materialize(out, "line-drops", keep=True)


def shared_bands(places: DataFrame) -> DataFrame:
    """(token, item, pos) of the bands that several lines have. Each task sorts the bands of one range of hashes.

    Postings cross the shuffle in packs, 16 bytes each. The number of tasks grows with that of the lines; bands that very
    many lines have are given out as they come, so that no task holds them (a line may then be listed twice).
    """
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, -(-places.where("item IS NOT NULL").count() * BANDS // BUCKET))

    def packs(tokens: list[np.ndarray], items: list[np.ndarray]) -> pa.RecordBatch:
        token, item = np.concatenate(tokens), np.concatenate(items)
        part = ((token >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part)
        found, sizes = np.unique(part[order], return_counts=True)
        offsets = pa.py_buffer(np.r_[0, np.cumsum(sizes * 8)].astype(np.int32))
        data = [pa.Array.from_buffers(pa.binary(), len(found), [None, offsets, pa.py_buffer(x[order])]) for x in (token, item)]
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *data], ["part", "tokens", "items"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, items, size = [], [], 0
        for b in batches:
            tokens.append(b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            items.append(np.repeat(b.column(0).to_numpy(zero_copy_only=False), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)))
            size += len(items[-1])
            if size >= DEAL:
                yield packs(tokens, items)
                tokens, items, size = [], [], 0
        if size:
            yield packs(tokens, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, item, known = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
        more: list[tuple[np.ndarray, np.ndarray]] = []
        size, limit = 0, 2 * BUCKET

        def beside(x: np.ndarray) -> np.ndarray:
            same = x[1:] == x[:-1]
            return (np.r_[False, same] | np.r_[same, False])[: len(x)]

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal token, item, known, more, size, limit
            token, item = (np.concatenate([x, *(m[i] for m in more)]) for i, x in enumerate((token, item)))
            order = np.argsort(token)
            token, item = token[order], item[order]
            again = beside(token)
            # only bands that come again need their lines in order
            t, i = token[again], item[again]
            order = np.lexsort((i, t))
            t, i = t[order], i[order]
            new = np.r_[True, (t[1:] != t[:-1]) | (i[1:] != i[:-1])][: len(t)]
            token, item = np.r_[token[~again], t[new]], np.r_[item[~again], i[new]]
            several = beside(token)
            several |= np.isin(token, known)
            known = np.union1d(known, token[several])
            out = token[several].view(np.int64), item[several]
            token, item, more = token[~several], item[~several], []
            size, limit = len(token), max(2 * BUCKET, 2 * len(token))
            for at in range(0, len(out[0]), DEAL):
                t, i = (pa.array(x[at : at + DEAL]) for x in out)
                yield pa.RecordBatch.from_arrays([t, i, pa.array(np.zeros(len(t), np.int32))], ["token", "item", "pos"])

        for b in batches:
            more.append((np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64), np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)))
            size += len(more[-1][0])
            if size >= limit:
                yield from settle()
        yield from settle()

    packed = places.where("size(bands) > 0").select("item", "bands").mapInArrow(deal, "part int, tokens binary, items binary")
    return materialize(packed.repartitionById(parts, "part").mapInArrow(run, "token long, item long, pos int"), "line-bands")


def distinct_lists(shared: DataFrame) -> DataFrame:
    """Of lists of the same lines only one: near copies share most of their bands, so most lists say the same.

    Lists are told apart by length and two sums of hashes of their lines (33 bits each, so that no list overflows them).
    """
    sums = [F.sum(F.shiftright(F.xxhash64("item", F.lit(i)), 31)).alias(f"h{i}") for i in (0, 1)]
    lists = shared.groupBy("token").agg(F.count(F.lit(1)).alias("c"), *sums).where("c > 1")
    return shared.join(lists.groupBy("c", "h0", "h1").agg(F.min("token").alias("token")).select("token"), "token")


def _shape(texts: DataFrame) -> str:
    return f"key {texts.schema['key'].dataType.simpleString()}, th long, line int, item long, n_lines int, head boolean, bands array<long>"


def _places(chars: int):
    """Each line of the texts with its place and identity; bands of the lines that the task sees for the first time."""
    names = ["key", "th", "line", "item", "n_lines", "head", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for b in slices(batch, 100):
                if len(done) > DONE:  # bands that come again are dropped when postings are sorted
                    done.clear()
                # a document without lines has one row, without an item
                found = [_lines(t) or [(-1, "")] for t in b.column(2).to_pylist()]
                sizes = np.array([len(f) for f in found])
                line = np.array([i for f in found for i, _ in f], np.int32)
                bodies = [x for f in found for _, x in f]
                items = line_items(bodies)
                first = []  # places in the batch of lines that weren't seen before
                for i, item in enumerate(items.tolist()):
                    if item not in done and bodies[i]:
                        done.add(item)
                        first.append(i)
                bands = [band_hashes(part, chars) for part in _chunks([bodies[i] for i in first], LOT)]
                values = np.concatenate([*bands, np.empty((0, BANDS), np.uint64)]).ravel().view(np.int64)
                counts = np.zeros(len(items), np.int32)
                counts[first] = BANDS
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                row = pa.array(np.repeat(np.arange(b.num_rows), sizes))
                head = np.zeros(len(line), bool)
                head[np.cumsum(sizes) - sizes] = True
                n_lines = np.repeat(np.array([len(f) if f[0][0] >= 0 else 0 for f in found], np.int32), sizes)
                columns = [b.column(0).take(row), b.column(1).take(row), pa.array(line), pa.array(items, mask=line < 0), pa.array(n_lines), pa.array(head), pa.ListArray.from_arrays(offsets, pa.array(values))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _bodies(chars: int, rule: Rule):
    """The wanted lines of the texts, with the sizes and signatures of their shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 100):
                wanted = b.column(1)
                at, items = wanted.flatten().field("line").to_pylist(), wanted.flatten().field("item")
                sizes = pc.list_value_length(wanted).to_pylist()
                bodies, done = [], 0
                for text, n in zip(b.column(0).to_pylist(), sizes, strict=True):
                    lines = text.split("\n")
                    bodies += [normal_line(lines[i]) for i in at[done : done + n]]
                    done += n
                n, signs = [np.empty(0, np.int32)], [np.empty((0, len(rule.signature)), np.int64)]
                for part in _chunks(bodies):
                    hashes, line = line_sets(part, chars)
                    n.append(np.bincount(line, minlength=len(part)).astype(np.int32))
                    signs.append(rule.sign(hashes, line, len(part)))
                signs = np.ascontiguousarray(np.concatenate(signs).T)
                yield pa.RecordBatch.from_arrays([items, pa.array(bodies, pa.string()), pa.array(np.concatenate(n)), *map(pa.array, signs)], ["item", "body", "n", *rule.signature])

    return run


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_emptied: bool = True, **options) -> DataFrame:
    """``docs`` with the duplicate lines taken out of the text; all columns and rows as they were otherwise.

    A document all of whose lines repeat earlier ones has nothing left; with ``drop_emptied`` it goes. Documents that had
    no line to begin with stay. See ``duplicate_lines`` for nulls, ties and repeated rows.
    """
    th, k, t, n, places = fresh(docs, "th", "k", "t", "n", "places")
    found = duplicate_lines(docs, key, text, **options).where("size(drop) > 0")
    found = found.select(col(key).alias(k), F.col("text_hash").alias(t), F.col("n_lines").alias(n), F.col("drop").alias(places))
    rows = docs.withColumn(th, F.xxhash64(col(text)))
    rows = rows.join(found, col(key).eqNullSafe(F.col(k)) & (F.col(th) == F.col(t)), "left")
    if drop_emptied:
        rows = rows.where(F.col(places).isNull() | (F.size(places) < F.col(n)))
    # array_except would merge equal lines, so lines are kept by place
    kept = F.filter(F.split(col(text), "\n"), lambda x, i: ~F.array_contains(places, i))
    body = F.when(F.col(places).isNull(), col(text)).otherwise(F.array_join(kept, "\n"))
    return rows.select(*[body.alias(c) if c == text else col(c) for c in docs.columns])
