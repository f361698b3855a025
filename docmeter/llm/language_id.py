"""Language identification of mixed-language text.

The script of a word narrows the languages that come into question; each word gets a score
per language from character trigrams; Viterbi's algorithm with a penalty for each switch
labels the words, and runs of equal labels are the spans. The document's language is the
one that holds most letters.

Documents of a batch go through Viterbi together, one word position at a time, so that the
work is done by numpy whatever the lengths are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, drop_outputs, fresh

UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters. The pattern also takes numbers that are no digits, such as the half sign; these part words."""
    found = _WORD.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def word_places(text: str) -> list[tuple[int, int]]:
    """Where the words of ``words_of`` begin and end."""
    out = []
    for m in _WORD.finditer(text):
        at = m.start()
        for x in [m.group()] if m.group().isalpha() else "".join(c if c.isalpha() else " " for c in m.group()).split(" "):
            if x:
                out.append((at, at + len(x)))
            at += len(x) + 1
    return out

# First and last code point of the ranges that tell scripts apart.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
)


@dataclass(frozen=True)
class Settings:
    #: About so many documents a language are learned from, drawn by a hash; all, if there are fewer.
    docs_per_language: int = 3000
    #: Trigrams (with their language) that the model keeps at most, the most frequent ones.
    grams: int = 400_000
    #: What a switch of language costs, in nats.
    penalty: float = 12.0
    #: A language owns a script that holds so large a share of its letters.
    script_share: float = 0.02
    smoothing: float = 0.5
    seed: int = 17


def script_of(char: str) -> str:
    code = ord(char)
    return next((name for name, low, high in SCRIPTS if low <= code <= high), "other")


def grams_of(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


class Model:
    """Scores of words; languages in alphabetical order."""

    def __init__(self, counts: list[tuple[str, str, int]], scripts: list[tuple[str, str, int]], s: Settings):
        self.languages = sorted({lang for lang, _, _ in counts})
        at = {lang: i for i, lang in enumerate(self.languages)}
        table: dict[str, np.ndarray] = {}
        for lang, gram, n in counts:
            table.setdefault(gram, np.zeros(len(at)))[at[lang]] = n
        totals = sum(table.values()) if table else np.zeros(len(at))
        base = np.log(totals + s.smoothing * (len(table) + 1))
        # the last row is for trigrams that were not seen
        self.gram_id = {g: i for i, g in enumerate(table)}
        self.scores = np.log(np.stack([*table.values(), np.zeros(len(at))]) + s.smoothing) - base
        letters = Counter()
        for lang, _, n in scripts:
            letters[lang] += n
        owners: dict[str, set[int]] = {}
        for lang, script, n in scripts:
            if lang in at and n >= s.script_share * letters[lang]:
                owners.setdefault(script, set()).add(at[lang])
        self.barred = {k: [i for i in range(len(at)) if i not in v] for k, v in owners.items()}

    def words(self, words: list[str]) -> np.ndarray:
        """words x languages: sums over the words' trigrams; languages that don't own the script are barred."""
        unseen = len(self.gram_id)
        ids = np.array([self.gram_id.get(g, unseen) for w in words for g in grams_of(w)], np.int64)
        first = np.cumsum([0, *(len(w) for w in words[:-1])])
        scores = np.add.reduceat(self.scores[ids], first, axis=0)
        scripts = np.array([script_of(w[0]) for w in words])
        for script, others in self.barred.items():
            scores[np.ix_(np.flatnonzero(scripts == script), others)] -= 1e3
        return scores


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """Learn from the rows whose text and lang are not null; only counts of trigrams reach the driver, at most ``grams``."""
    s = settings
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], [], s)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(s.docs_per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit(s.seed), "key"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.where(draw < share[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                words.setdefault(lang, Counter()).update(words_of(text.lower()))
        for lang, found in words.items():
            grams, scripts = Counter(), Counter()
            for word, n in found.items():
                scripts[script_of(word[0])] += n * len(word)
                for g in grams_of(word):
                    grams[g] += n
            for kind, counter in (("gram", grams), ("script", scripts)):
                if counter:
                    yield pd.DataFrame({"kind": kind, "lang": lang, "item": list(counter), "n": list(counter.values())})

    counts = rows.mapInPandas(count, "kind string, lang string, item string, n long").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("kind"), F.desc("n"), "lang", "item").limit(s.grams).collect()
    return Model(
        [(r["lang"], r["item"], r["n"]) for r in found if r["kind"] == "gram"],
        [(r["lang"], r["item"], r["n"]) for r in found if r["kind"] == "script"],
        s,
    )


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word: ``scores`` are words x languages, of documents one after the other."""
    total, n = scores.shape
    labels = np.zeros(total, np.int16)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    stay = np.zeros((total, n), bool)
    source = np.zeros(total, np.int16)
    state = np.zeros((len(lengths), n))
    for t, a in enumerate(active):
        at = starts[:a] + t
        now = state[:a]
        best = now.argmax(1)
        switched = now[np.arange(a), best] - penalty
        stay[at] = now >= switched[:, None]
        source[at] = best
        state[:a] = np.maximum(now, switched[:, None]) + scores[at]
    current = state.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        labels[at] = current[:a]
        current[:a] = np.where(stay[at, current[:a]], current[:a], source[at])
    return labels


class Tagger:
    def __init__(self, model: Model, penalty: float, cache: int = 300_000, words: int = 400_000):
        self.model, self.penalty, self.cache, self.words = model, penalty, cache, words
        self.ids: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def _ids(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.ids]
        if new:
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.words(new)])
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def batch(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        out, block, size = [], [], 0
        for text in texts:
            words = words_of(text.lower()) if text else []
            block.append((text, words))
            size += len(words)
            if size >= self.words:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block)

    def _block(self, block: list[tuple[str | None, list[str]]]) -> list:
        languages = self.model.languages
        if not languages:
            return [(UNDETERMINED, 0.0, [])] * len(block)
        if len(self.ids) > self.cache:
            self.ids, self.table = {}, self.table[:0]
        flat = [w for _, words in block for w in words]
        ids = self._ids(flat)
        lengths = np.array([len(words) for _, words in block], np.int64)
        starts = np.cumsum(lengths) - lengths
        if not len(ids):
            return [(UNDETERMINED, 0.0, [])] * len(block)
        labels = viterbi(self.table[ids], starts, lengths, self.penalty)
        letters = np.fromiter(map(len, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(block)), lengths)
        held = np.bincount(doc * len(languages) + labels, weights=letters, minlength=len(block) * len(languages)).reshape(len(block), -1)
        out = []
        for (text, words), start, shares in zip(block, starts, held, strict=True):
            if not words:
                out.append((UNDETERMINED, 0.0, []))
                continue
            best = int(shares.argmax())
            out.append((languages[best], float(shares[best] / shares.sum()), self._spans(text, labels[start : start + len(words)])))
        return out

    def _spans(self, text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
        """Spans in the text itself, when lower-casing kept its words; else one span for each label's run by the lower-cased text."""
        places = word_places(text)
        if len(places) != len(labels):
            places = word_places(text.lower())
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(labels)]
        return [(places[a][0], places[b - 1][1], self.model.languages[labels[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def identify(docs: DataFrame, model: Model, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with lang_pred, score (share of the letters that lie in that language's spans) and spans.

    * Texts that are null or have no letter, and all texts where no language was learned, are ``und`` with score 0 and
      no spans. Only the text is read for a prediction; it is read whole, at any length. Ties go to the language first
      in the alphabet. Repeated rows get equal answers; an empty table stays empty; columns named as an output are
      replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by settings.grams
    penalty = settings.penalty

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value, penalty)
        for texts in batches:
            found = tagger.batch(list(texts))
            spans = [[{"start": a, "end": b, "lang": lang} for a, b, lang in f[2]] for f in found]
            yield pd.DataFrame({"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "spans": pd.Series(spans, dtype=object)})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
    (name,) = fresh(docs, "found")
    kept = drop_outputs(docs, "lang_pred", "score", "spans").columns
    return docs.withColumn(name, udf(col(text))).select(*map(col, kept), F.col(f"{name}.*"))
