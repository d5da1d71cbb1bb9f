"""BPE encoding and decoding with a tokenization automaton.

The automaton reads *tokens*: it accepts exactly the token sequences that BPE makes of some string. It is compiled by
applying one gadget per merge, in rank order, to the one-state automaton over the base symbols. The gadget of
``(u, v) -> w`` copies the state that ``u`` leads to, takes ``v`` out of the copy, lets ``u`` lead to the copy and lets
``w`` lead to where ``v`` led. All arcs with one label lead to one state, so states are named by labels, and a state is
the set of labels it has no arc for: the gadget adds labels to the set of ``u``, and ``w`` starts with the set that ``v``
has at that moment. What is taken out with ``v`` are the labels that start with ``v`` and got their next longer left part
later; in a suitable order of the labels they are one interval. So the compiled transition table is a numeric array: for
each distinct state, the bounds of its closed intervals (about a million numbers for fifty thousand merges).

The driver compiles the table once and broadcasts it (its size follows from the vocabulary). The words of a batch are
encoded side by side by table-driven transitions: every prefix of a word has one accepted token sequence, so from each
reached position the symbol trie gives the labels that fit and the table says which have an arc. Decoding emits the arc
labels.

Defined results: null text is empty, an empty text has no tokens; whole texts are encoded, whatever their length;
repeated rows are each encoded; an empty table stays empty; extra columns stay, but a column named like the result is
refused (ValueError).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words kept in a worker's memo before it is emptied; bounds memory, never results.
MEMO = 500_000
#: Longer words are walked one by one instead of side by side.
LONG = 64
#: Bits of a label's place in the table's order.
PLACE = 20


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def char_class(*kinds: str) -> str:
    """A regular-expression class body with all characters whose general category starts with one of ``kinds``."""
    out, start = [], None
    for c in range(0x110000 + 1):
        inside = c < 0x110000 and not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)).startswith(kinds)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: White space as the vocabulary's pattern means it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0  -     　"


class Automaton:
    """The compiled automaton of one vocabulary file (word-end BPE over bytes)."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model = spec["model"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {i: x for x, i in vocab.items()} | {i: x for x, i in self.special.items()}
        end = model["end_of_word_suffix"] or ""
        back = {x: b for b, x in byte_symbols().items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        parts: dict[int, tuple[int, int, int]] = {}  # label -> left part, right part, time
        for time, (u, v, w) in enumerate(merges):
            parts.setdefault(w, (u, v, time))
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]
        self._compile(merges, parts)
        usable = [i for i in labels if i in parts or labels[i] in back or (end and labels[i].removesuffix(end) in back)]
        self._trie({i: labels[i] for i in usable if self.reached[i] and labels[i] not in self.special}, end, back)
        letters, numbers = char_class("L"), char_class("N")
        short = "'s|'t|'re|'ve|'m|'ll|'d"
        self.split = re.compile(f"{short}|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+").findall
        self.split_ascii = re.compile(f"{short}|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+").findall
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.spaces = re.compile(f"[{SPACE}]+")
        self.memo: dict[str, bytes] = {}
        self.plain: tuple | None = None

    def _compile(self, merges: list[tuple[int, int, int]], parts: dict[int, tuple[int, int, int]]) -> None:
        """The transition table: ``row`` of each label's state, ``bounds`` of closed intervals by row, ``place`` of each
        label in the order that makes them intervals, and whether a label is ``reached`` at all."""
        n = len(self.labels)
        longer: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for w, (u, _, time) in parts.items():
            longer[u].append((time, w))
        first, place, count = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for x in (i for i in range(n) if i not in parts):
            walk = [(x, 0)]
            longer[x].sort()
            first[x] = count
            while walk:
                x, i = walk.pop()
                if i < len(longer[x]):
                    y = longer[x][i][1]
                    longer[y].sort()
                    first[y] = count
                    walk += [(x, i + 1), (y, 0)]
                else:
                    place[x] = count
                    count += 1
        closed: dict[int, list[tuple[int, int]]] = {}
        self.reached = np.zeros(n, bool)
        self.reached[[i for i in range(n) if i not in parts]] = True
        for time, (u, v, w) in enumerate(merges):
            if parts[w] == (u, v, time):
                # u and v can meet now only if no earlier gadget closed the arc
                at = int(place[v])
                self.reached[w] = self.reached[u] and self.reached[v] and not any(a <= at < b for a, b in closed.get(u, ()))
                closed[w] = list(closed.get(v, ()))
            since = bisect_left(longer[v], (time, -1))
            closed.setdefault(u, []).append((int(first[longer[v][since][1]] if since < len(longer[v]) else place[v]), int(place[v]) + 1))
        rows: dict[tuple[int, ...], int] = {(): 0}
        self.row = np.zeros(n, np.int64)
        for label, found in closed.items():
            out: list[int] = []
            for a, b in sorted(found):
                if out and a <= out[-1]:
                    out[-1] = max(out[-1], b)
                else:
                    out += [a, b]
            self.row[label] = rows.setdefault(tuple(out), len(rows))
        self.place = place
        self.bounds = np.array([i << PLACE | x for row, i in rows.items() for x in row], np.int64)
        self.before = np.cumsum([0, *map(len, rows)])

    def _trie(self, texts: dict[int, str], end: str, back: dict[str, int]) -> None:
        """Labels by their symbols (a byte, plus 256 for the last one of a word), as sorted keys node * 512 + symbol."""
        arcs: dict[int, int] = {}
        ends = {0: -1}
        for label, text in texts.items():
            ended = bool(end) and text.endswith(end)
            symbols = [back[c] for c in (text.removesuffix(end) if ended else text)]
            symbols[-1] += 256 * ended
            node = 0
            for x in symbols:
                node = arcs.setdefault(node << 9 | x, len(arcs) + 1)
                ends.setdefault(node, -1)
            ends[node] = label
        keys = np.array(list(arcs), np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(arcs.values()), np.int64)[order]
        self.ends = np.array([ends[i] for i in range(len(ends))], np.int64)

    def open(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Have the states after ``state`` arcs with ``label``?"""
        row = self.row[state]
        return (np.searchsorted(self.bounds, row << PLACE | self.place[label], "right") - self.before[row]) & 1 == 0

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The labels of each word, as little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(r) for r in raw])
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        stop = np.cumsum(size)
        symbols[stop - 1] += 256
        start = stop - size
        base = start + np.arange(len(raw))  # place 0 of each word; a word has one place more than symbols
        label, came = np.full(len(symbols) + len(raw), -1), np.zeros(len(symbols) + len(raw), np.int64)
        short = np.flatnonzero(size <= LONG)
        for w in np.flatnonzero(size > LONG).tolist():
            at = base[w] + 1
            label[at : at + size[w]], came[at : at + size[w]] = self._walk(symbols[start[w] : stop[w]].tolist())
        for j in range(int(size[short].max(initial=0))):
            w = short[size[short] > j]
            if j:
                w = w[label[base[w] + j] >= 0]
            state, node, i = label[base[w] + j], np.zeros(len(w), np.int64), j
            while len(w):
                key = node << 9 | symbols[start[w] + i]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                fits = self.keys[at] == key
                w, state, node = w[fits], state[fits], self.to[at[fits]]
                t = self.ends[node]
                found = np.flatnonzero(t >= 0)
                if j:
                    found = found[self.open(state[found], t[found])]
                here = base[w[found]] + i + 1
                label[here], came[here] = t[found], j
                i += 1
                more = size[w] > i
                w, state, node = w[more], state[more], node[more]
        # back from the ends, one token of each word a step
        tokens, owner, at, w = [], [], size.copy(), np.arange(len(raw))
        while len(w):
            here = base[w] + at[w]
            tokens.append(label[here])
            owner.append(w)
            at[w] = came[here]
            w = w[at[w] > 0]
        if not tokens:
            return []
        step = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        owner, tokens = np.concatenate(owner), np.concatenate(tokens)
        order = np.lexsort((-step, owner))
        flat = tokens[order].astype("<u4").tobytes()
        cut = [0, *(4 * np.cumsum(np.bincount(owner, minlength=len(raw)))).tolist()]
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def _walk(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Label and earlier place of each place but the first, for one long word; by the same tables."""
        if self.plain is None:
            self.plain = dict(zip(self.keys.tolist(), self.to.tolist(), strict=True)), self.ends.tolist(), self.bounds.tolist()
        arcs, ends, bounds = self.plain
        n = len(symbols)
        label, came = [-1] * (n + 1), [0] * (n + 1)
        for j in range(n):
            if j and label[j] < 0:
                continue
            row, node = int(self.row[label[j]]) if j else 0, 0
            low, high = int(self.before[row]), int(self.before[row + 1])
            for i in range(j, n):
                node = arcs.get(node << 9 | symbols[i])
                if node is None:
                    break
                t = ends[node]
                if t >= 0 and (not j or (bisect_right(bounds, row << PLACE | int(self.place[t]), low, high) - low) & 1 == 0):
                    label[i + 1], came[i + 1] = t, j
        return label[1:], came[1:]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "plain": None}

    def words(self, text: str) -> list[str]:
        """The normalised text's pre-split words."""
        if text.isascii():
            return self.split_ascii(text.lower())
        text = self.spaces.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ")
        return self.split(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers; special strings are their own tokens."""
        pieces: list[list[str]] = []
        for t in texts:
            if self.specials is None or not any(s in t for s in self.special):
                pieces.append(self.words(t))
            else:
                pieces.append([w for p in self.specials.split(t) for w in ([p] if p in self.special else self.words(p))])
        if len(self.memo) >= MEMO:
            self.memo = {}
        memo = self.memo
        memo.update((s, np.array([i], "<u4").tobytes()) for s, i in self.special.items())
        new = list({w for p in pieces for w in p} - memo.keys())
        memo.update(zip(new, self.encode_words(new), strict=True))
        out = [b"".join([memo[w] for w in p]) for p in pieces]
        for w in new:
            if len(w) > LONG:
                del memo[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The labels' texts, separated by spaces as the vocabulary file names no decoder."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_compiled: dict[str, Automaton] = {}


def automaton(content: str) -> Automaton:
    """The automaton of a vocabulary file's content, compiled once in a process."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _compiled:
        _compiled[key] = Automaton(content)
    return _compiled[key]


FIELDS = {"n_tokens": "bigint", "ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _sha256(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def encoder(spark: SparkSession, path: str, fields: tuple[str, ...]):
    """A vectorised function of a text column to a struct of some of FIELDS."""
    with open(path, encoding="utf-8") as f:  # the driver reads the vocabulary; it has a fixed size
        shared = spark.sparkContext.broadcast(automaton(f.read()))

    @F.pandas_udf("struct<" + ",".join(f"{x}:{FIELDS[x]}" for x in fields) + ">")
    def run(texts: pd.Series) -> pd.DataFrame:
        a = shared.value
        rows = []
        for ids in a.encode([t or "" for t in texts]):
            text = a.decode(ids) if "decoded" in fields or "decoded_sha256" in fields else ""
            made = {"n_tokens": len(ids) // 4, "ids": ids, "decoded": text}
            if "ids_sha256" in fields:
                made["ids_sha256"] = _sha256(ids)
            if "decoded_sha256" in fields:
                made["decoded_sha256"] = _sha256(text.encode("utf-8", "surrogatepass"))
            rows.append([made[x] for x in fields])
        return pd.DataFrame(rows, columns=list(fields))

    return run


def tokenized(docs: DataFrame, path: str, text: str | Column = "text", into: str = "bpe", fields: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """``docs`` with a struct column ``into`` of the named FIELDS."""
    if into in docs.columns:
        raise ValueError(f"column {into} exists")
    run = encoder(docs.sparkSession, path, fields)
    return docs.withColumn(into, run(F.col(text) if isinstance(text, str) else text))
