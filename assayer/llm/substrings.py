"""Substring deduplication: word windows by super-k-mer partitioning, and byte windows by a run-length index.

``dedup_words`` removes each word covered by a window of ``w`` words whose sequence also starts in a document with a
smaller doc_id. In the bucket of a minimiser the windows of all strings are sorted by a 64-bit hash, each is compared
byte by byte with the first one that has its hash (if two differ, all are grouped by their words instead), and every
window gets the smallest document that has it.

``dedup_bytes`` removes each byte covered by a string of ``w`` bytes that also starts earlier (smaller doc_id, or earlier
in the same document). In a bucket, the earlier half of each minimiser's strings goes into a run-compressed Burrows-Wheeler
transform with sampled run ends; the other half streams through it, and windows whose matching statistics reach ``w``
are marked; then the halves are halved.

Both judge the input, not what is left. Defined results: null text is empty; rows without doc_id are left out; if a
doc_id repeats, its rows are collapsed first (``one_row_per_id``); extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.arrays import eights, joined, same_bytes, window_hashes, word_hashes, words_in
from assayer.llm.repeats import Kind, applied, covered, repeated_windows
from assayer.llm.rindex import RunLengthIndex, long_matches


def sorted_windows(head: np.ndarray, strings: list[bytes], w: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of w words a string of a smaller document has."""
    data, starts = joined(strings)
    a, b, counts = words_in(data, starts)
    size = np.diff(counts) - w + 1
    at = np.arange(int(size.sum())) + np.repeat(counts[:-1] - (np.cumsum(size) - size), size)
    h = window_hashes(word_hashes(data, a, b), w)[at]
    doc = np.repeat(head["doc"], size)
    order = np.lexsort((doc, h))
    h, doc_ = h[order], doc[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    start, every = a[at[order]], eights(data)
    length = b[at[order] + w - 1] - start
    equal = length == length[first]
    rest = np.flatnonzero(~new & equal)
    equal[rest] = same_bytes(every, start[rest], every, start[first[rest]], length[rest])
    late = np.zeros(len(at), bool)
    if equal.all():
        late[order] = doc_ > doc_[first]
    else:  # two different windows share a hash: group by the words themselves
        raw, least = data.tobytes(), {}
        keys = [raw[a[i] : b[i + w - 1]] for i in at]
        for k, d in zip(keys, doc.tolist(), strict=True):
            least[k] = min(d, least.get(k, d))
        late[:] = [d > least[k] for k, d in zip(keys, doc.tolist(), strict=True)]
    return late, size


def indexed_windows(head: np.ndarray, strings: list[bytes], w: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of w bytes an earlier string has; strings come by key, document and start.

    The strings of a minimiser are halved again and again: the earlier halves are indexed, the later halves stream
    through the index, and windows found are taken out of them. What is left of a later half has no window of an earlier
    one, so on the next level, where all pairs of halves share an index, nothing matches a later string."""
    out = [np.zeros(len(s) - w + 1, bool) for s in strings]
    key = head["key"]
    groups: list[list[int]] = []  # places of the strings with one key
    for i in range(len(strings)):
        if groups and key[groups[-1][0]] == key[i]:
            groups[-1].append(i)
        else:
            groups.append([i])
    level = [g for g in groups if len(g) > 1]
    while level:
        early = [i for g in level for i in g[: (len(g) + 1) // 2]]
        late = [i for g in level for i in g[(len(g) + 1) // 2 :]]
        texts = [strings[i][a : b + w - 1] for i in early for a, b in _free(out[i])]
        pieces = [(i, a, strings[i][a : b + w - 1]) for i in late for a, b in _free(out[i])]
        if texts and pieces:
            index = RunLengthIndex(np.frombuffer(b"\xff".join([*texts, b""]), np.uint8))
            for (i, a, _), hit in zip(pieces, long_matches(index, [p[2] for p in pieces], w), strict=True):
                out[i][a : a + len(hit)] |= hit
        level = [h for g in level for h in (g[: (len(g) + 1) // 2], g[(len(g) + 1) // 2 :]) if len(h) > 1]
    return np.concatenate(out), np.array([len(x) for x in out])


def _free(marked: np.ndarray) -> list[tuple[int, int]]:
    """Runs of unmarked windows."""
    if not marked.any():
        return [(0, len(marked))]
    edge = np.flatnonzero(np.diff((~marked).view(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()
    return list(zip(edge[::2], edge[1::2]))


def dedup_words(docs: DataFrame, doc: str = "doc_id", text: str = "text", w: int = 13, m: int = 3) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, text (kept words joined by one space)."""
    kind = Kind("word", w, m)
    base, runs = repeated_windows(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), kind, False, lambda head, strings: sorted_windows(head, strings, w))

    def finish(text: str | None, own: np.ndarray) -> tuple:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        gone = 0
        if len(own):
            away = covered(own, w, len(words))
            gone = int(away.sum())
            kept = [x for x, y in zip(words, away.tolist(), strict=True) if not y]
        return len(words), gone, b" ".join(kept if gone else words).decode("utf-8", "surrogatepass")

    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
    return applied(base, runs, finish, fields, "doc_id bigint, n_words bigint, n_removed bigint, text string")


def dedup_bytes(docs: DataFrame, doc: str = "doc_id", text: str = "text", w: int = 100, m: int = 32) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary)."""
    kind = Kind("byte", w, m)
    base, runs = repeated_windows(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), kind, True, lambda head, strings: indexed_windows(head, strings, w))

    def finish(text: str | None, own: np.ndarray) -> tuple:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not len(own):
            return len(raw), 0, 0, raw
        away = covered(own, w, len(raw))
        edge = np.diff(away.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        return len(raw), int(away.sum()), int((edge == 1).sum()), np.frombuffer(raw, np.uint8)[~away].tobytes()

    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    return applied(base, runs, finish, fields, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
