"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A long text is cut before a space that follows a letter or digit. No match of the
pattern holds a non-space followed by a space, and the pattern never looks back, so
such a cut is always between two matches and the ids stay those of the whole text.
A stretch without such a place is matched by the ``regex`` library instead and its
matches are encoded one by one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, drop_outputs, fresh

#: Characters after which the next safe boundary is taken.
CHUNK_CHARS = 65_536
#: A chunk over this length (no safe boundary for so long) is matched outside tiktoken's own regex engine.
DIRECT_CHARS = 200_000
_SAFE = re.compile(r"(?<=[^\W_])(?= )")


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class Codec:
    """Built once a task; without special tokens."""

    def __init__(self, ranks: bytes, pattern: str, chunk_chars: int = CHUNK_CHARS, direct_chars: int = DIRECT_CHARS):
        import regex
        import tiktoken

        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(ranks), special_tokens={})
        self.pattern, self.chunk_chars, self.direct_chars = regex.compile(pattern), chunk_chars, direct_chars

    def _encode_chunk(self, chunk: str) -> np.ndarray:
        if len(chunk) <= self.direct_chars:
            return np.asarray(self.encoding.encode_to_numpy(chunk, disallowed_special=()), dtype="<u4")
        single = self.encoding._core_bpe.encode_single_piece
        ids = [np.asarray(single(m.group().encode("utf-8")), dtype="<u4") for m in self.pattern.finditer(chunk)]
        return np.concatenate(ids) if ids else np.empty(0, "<u4")

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; null is the empty text."""
        return b"".join(self._encode_chunk(c).tobytes() for c in chunks(text, self.chunk_chars)) if text else b""

    def decode(self, ids: bytes | None) -> bytes:
        if not ids:
            return b""
        return self.encoding.decode_bytes(np.frombuffer(bytes(ids), dtype="<u4").tolist())


def _read_ranks(spark: SparkSession, rank_file: str):
    """The rank file's bytes as a broadcast: its size is that of the vocabulary, whatever the corpus is."""
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: binary, the token ids of the whole text as little-endian unsigned 32-bit integers.

    Null and empty texts give an empty binary; texts of any length are encoded whole; repeated rows are encoded
    alike; an empty table stays empty; a column named as the output is replaced by it, all others stay. Rows are not
    moved: this is a map over partitions.
    """
    ranks = _read_ranks(docs.sparkSession, rank_file)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(ranks.value, pattern)
        for texts in batches:
            yield pd.Series([codec.encode(t) for t in texts], dtype=object)

    return _with(docs, {ids_col: F.pandas_udf(_typed(run), "binary")(col(text))})


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``tokens`` with ``bytes_col``: the raw bytes of the ids (not necessarily valid UTF-8); null ids give no bytes."""
    ranks = _read_ranks(tokens.sparkSession, rank_file)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(ranks.value, pattern)
        for some in batches:
            yield pd.Series([codec.decode(i) for i in some], dtype=object)

    return _with(tokens, {bytes_col: F.pandas_udf(_typed(run), "binary")(col(ids))})


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with ``ids_col`` as of ``encode`` and ``bytes_col`` as of ``decode`` of these ids, by one codec a task."""
    ranks = _read_ranks(docs.sparkSession, rank_file)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(ranks.value, pattern)
        for texts in batches:
            for at in range(0, len(texts), 500):  # ids and bytes of so many texts are held at once
                ids = [codec.encode(t) for t in texts.iloc[at : at + 500]]
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([codec.decode(i) for i in ids], dtype=object)})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(run, "ids binary, decoded binary")(col(text))
    (name,) = fresh(docs, "found")
    rows = docs.withColumn(name, found)
    kept = drop_outputs(docs, ids_col, bytes_col).columns
    return rows.select(*map(col, kept), col(name)["ids"].alias(ids_col), col(name)["decoded"].alias(bytes_col))


def _with(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
    names = fresh(rows, *made)
    wide = rows.withColumns(dict(zip(names, made.values(), strict=True)))
    kept = drop_outputs(rows, *made).columns
    return wide.select(*map(col, kept), *[col(n).alias(m) for n, m in zip(names, made, strict=True)])


def _typed(run):
    """The types that pandas_udf reads, as objects: annotations of this module are strings."""
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def token_count(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")
