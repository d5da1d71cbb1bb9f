"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree (contexts of 0 to ``ORDER`` bytes) is counted on a sample of
labelled texts and frozen. A byte costs -log2(count / (total + kinds)) bits in the longest context that has seen it,
and each longer context that was seen but not with this byte charges its escape, -log2(kinds / (total + kinds)) (method
C); unseen contexts charge nothing; below order 0 all 256 bytes cost 8 bits. A text's score in a language is its exact
code length, over every byte of the text. The frozen lengths and escapes of all languages lie side by side in one table
per order, so a text is scored by a few vectorised lookups a byte.

The classifier is fitted on a bounded sample: ``SAMPLE_CHARS`` characters of each language, in hash order of doc_id
(``samples.drawn``); every language with a character is learned. Scoring covers every row and every byte. ASCII letters are lower-cased first.

Defined results: null text or text without a letter is ``und`` with score 0; without any labelled row all is ``und``; of
languages with equal code lengths the first by name is told; long texts are scored whole, piece by piece; repeated rows
are each predicted; an empty table stays empty; extra columns stay, but a column named like the result is refused
(ValueError).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.samples import drawn

ORDER = 4
SAMPLE_CHARS = 2_000_000
PAD = b"\n" * ORDER
CHUNK = 1 << 20
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Rows:
    """Rows of float32 found by uint64 keys: open addressing, vectorised."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        self.rows = rows
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4)))))
        self.size = 1 << (64 - int(self.shift))
        self.keys = np.full(self.size + 64, EMPTY)
        self.at = np.zeros(self.size + 64, np.int32)
        left = np.arange(len(keys))
        slot = ((keys * MIX) >> self.shift).astype(np.int64)
        while len(left):
            if slot.max() >= len(self.keys):
                self.keys = np.concatenate([self.keys, np.full(1024, EMPTY)])
                self.at = np.concatenate([self.at, np.zeros(1024, np.int32)])
            free = self.keys[slot] == EMPTY
            s, first = np.unique(slot[free], return_index=True)
            won = left[free][first]
            self.keys[s], self.at[s] = keys[won], won
            lost = ~np.isin(left, won)
            left, slot = left[lost], slot[lost] + 1
        self.keys = np.concatenate([self.keys, [EMPTY]])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row number of each key, -1 if it has none."""
        slot = ((keys * MIX) >> self.shift).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == keys, self.at[slot], -1)
        todo = np.flatnonzero((got != keys) & (got != EMPTY))
        while len(todo):
            slot[todo] += 1
            got = self.keys[slot[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.at[slot[todo[hit]]]
            todo = todo[~hit & (got != EMPTY)]
        return out


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes at each place as one number, the newest lowest."""
    out = np.zeros(len(data), np.uint64)
    for j in range(n):
        out[j:] |= data[: len(data) - j].astype(np.uint64) << np.uint64(8 * j)
    return out


class Model:
    """Frozen statistics of all languages."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        counts = []
        for lang in self.languages:
            raw = b"".join(PAD + t.encode("utf-8", "surrogatepass").lower() for t in samples[lang])
            data = np.frombuffer(raw, np.uint8)
            real = np.ones(len(data), bool)
            at = 0
            for t in samples[lang]:
                real[at : at + ORDER] = False
                at += ORDER + len(t.encode("utf-8", "surrogatepass"))
            g = grams(data, ORDER + 1)[real]
            counts.append([np.unique(g & np.uint64((1 << 8 * (o + 1)) - 1), return_counts=True) for o in range(ORDER + 1)])
        k = len(self.languages)
        below = np.full((1, k), 8.0)  # bits of a byte that no context has seen
        self.below = below.astype(np.float32)
        self.lengths: list[Rows] = []
        self.escapes: list[Rows] = []
        known: list[tuple[np.ndarray, np.ndarray]] = []
        for o in range(ORDER + 1):
            keys = np.unique(np.concatenate([c[o][0] for c in counts])) if k else np.zeros(0, np.uint64)
            contexts = np.unique(keys >> np.uint64(8))
            esc = np.zeros((len(contexts), k))
            cost = np.zeros((len(keys), k))
            place = np.searchsorted(contexts, keys >> np.uint64(8))
            if o:
                lower_keys, lower = known[-1]
                under = lower[np.searchsorted(lower_keys, keys & np.uint64((1 << 8 * o) - 1))]
            else:
                under = np.repeat(below, len(keys), 0)
            for i in range(k):
                own, n = counts[i][o]
                total = np.zeros(len(contexts))
                kinds = np.zeros(len(contexts))
                c = np.searchsorted(contexts, own >> np.uint64(8))
                np.add.at(total, c, n)
                np.add.at(kinds, c, 1)
                seen = total > 0
                esc[seen, i] = -np.log2(kinds[seen] / (total + kinds)[seen])
                cost[:, i] = under[:, i] + esc[place, i]
                mine = np.searchsorted(keys, own)
                cost[mine, i] = -np.log2(n / (total + kinds)[c])
            known.append((keys, cost))
            self.lengths.append(Rows(keys, cost.astype(np.float32)))
            self.escapes.append(Rows(contexts, esc.astype(np.float32)))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language; texts are lower-cased bytes."""
        out = np.zeros((len(texts), len(self.languages)))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end]) + ORDER
                end += 1
            self._chunk(texts[at:end], out[at:end])
            at = end
        return out

    def _chunk(self, texts: list[bytes], out: np.ndarray) -> None:
        sizes = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
        data = np.frombuffer(b"".join([PAD + t for t in texts]), np.uint8)
        g = grams(data, ORDER + 1)
        row = self.lengths[ORDER].find(g)
        bits = self.lengths[ORDER].rows[np.maximum(row, 0)] if len(self.lengths[ORDER].rows) else np.zeros((len(g), out.shape[1]), np.float32)
        todo = np.flatnonzero(row < 0)
        bits[todo] = 0
        for o in range(ORDER, -1, -1):  # those whose context of o bytes has never seen the byte, in any language
            if not len(todo):
                break
            e = self.escapes[o].find((g[todo] & np.uint64((1 << 8 * (o + 1)) - 1)) >> np.uint64(8))
            hit = e >= 0
            bits[todo[hit]] += self.escapes[o].rows[e[hit]]
            if o == 0:
                bits[todo] += self.below
                break
            r = self.lengths[o - 1].find(g[todo] & np.uint64((1 << 8 * o) - 1))
            hit = r >= 0
            bits[todo[hit]] += self.lengths[o - 1].rows[r[hit]]
            todo = todo[~hit]
        for j in range(ORDER):
            bits[starts + j] = 0
        out[:] = np.add.reduceat(bits, starts, axis=0, dtype=np.float64)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        length = self.code_lengths([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
        best = length.argmin(1)
        share = 1 / np.exp2(np.maximum(length.min(1, keepdims=True) - length, -1000)).sum(1)
        return [(self.languages[b], float(s)) if has_letter(t) else ("und", 0.0) for t, b, s in zip(texts, best, share, strict=True)]


_ASCII = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII.search(text) is not None or any(map(str.isalpha, text)))


def remainder(doc: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(n))


def fit(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Model:
    """``labelled``: doc_id, text, lang. Fits on ``sample_chars`` characters of each language; each language that has a
    character is learned."""
    samples: dict[str, list[str]] = {}
    known = labelled.where(F.length("text") > 0).select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), F.length("text").alias("n"), F.xxhash64("text").alias("tie"))
    for lang, _, text in drawn(known, labelled.select("doc_id", "text", "lang"), "langid", None, sample_chars):
        samples.setdefault(lang, []).append(text)
    return Model(samples)


def predicted(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into``: lang_pred, score."""
    if into in docs.columns:
        raise ValueError(f"column {into} exists")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample, not by the corpus

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(texts.tolist()), columns=["lang_pred", "score"])

    return docs.withColumn(into, run(F.col(text)))
