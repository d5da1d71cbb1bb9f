"""Cross-tokenizer alignment: where two tokenizers' tokens end together, and which tokens overlap.

Tokenizer A is a byte-level BPE file, B a piece model that puts a space before the text; both read space + text. A
dictionary from cumulative byte end to token index is made for each side; the sorted intersection of their keys slices
both id lists into groups, and each slice is expanded into its links: the A-B pairs whose byte ranges overlap. A pair's
count is the number of documents in the whole table that hold it linked.

No token of either side crosses a space that follows a visible character, so texts are cut there and each word is
aligned once for a worker's memo; a text without such spaces is one word, whatever its length. A document counts as
unaligned if the bytes of a side don't spell it.

Scan tasks put documents into chunks of about ``CHUNK`` characters (a longer document is a chunk of its own), each with
a table of its distinct pairs and the number of its documents that hold them; this is written once. Pairs are counted by a
shuffle with a row for each pair and chunk, not for each link; so a pair that every document has is one row a chunk. The
counts go back to their chunks, where they are added up for each document. The highest count of each A id is a table
with at most the vocabulary's rows, and is the only one that is broadcast.

Defined results: null and empty texts, and texts whose bytes differ, have no tokens (zeros, empty groups); special tokens'
strings are plain text; each row is a document of its own, repeated ids and null ids included; ties for the highest count
are all best; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assayer.functions.tables import apart, written
from assayer.llm.bpe import byte_symbols

#: Characters of text a chunk; characters of words that a worker remembers before it starts anew.
CHUNK, MEMO = 8 << 20, 4 << 20
#: A space where a text is not cut: nothing visible stands before it.
KEPT_SPACE = re.compile(r"(?<![!-~\w]) ")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Two tokenizers and what they make of words."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            content = f.read()
        self.a = Tokenizer.from_str(content)
        self.a.encode_special_tokens = True
        back = {x: b for b, x in byte_symbols().items()}
        vocab = json.loads(content)["model"]["vocab"]
        self.bytes_a = {i: bytes(map(back.__getitem__, x)) for x, i in vocab.items() if all(c in back for c in x)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        most = max(vocab.values()) + 1
        self.bytes_a = [self.bytes_a.get(i, b"") for i in range(most)]
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.text_a = np.array([[b"%d%c" % (i, end) for i in range(most)] for end in b",|"], object)
        self.text_b = np.array([[b"%d%c" % (i, end) for i in range(len(pieces))] for end in b",;\n"], object)
        self.shift = len(pieces).bit_length()
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.told: list[bytes] = []
        self.sizes = np.zeros((0, 5), np.int64)  # COUNTS, and whether the bytes spell the word
        self.links = np.zeros(0, np.int64)  # of all words, one after the other
        self.characters = 0

    def words(self, text: str) -> list[str]:
        """Cut at the spaces, which go; both sides put them back."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if parts[-1] and not KEPT_SPACE.search(text):
            return parts
        out, open_ = [], False
        for p in parts:
            if open_:
                p = f"{out.pop()} {p}"
            out.append(p)
            open_ = not p or KEPT_SPACE.search(f"{p[-1]} ") is not None
        if len(out) > 1 and not out[-1]:  # a last space has no word to go with
            out[-2:] = [f"{out[-2]} "]
        return out

    def spelled(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """Do both sides' bytes spell each word?"""
        whole = b"".join(raw)
        if all(b"".join(map(table.__getitem__, chain.from_iterable(ids))) == whole for table, ids in ((self.bytes_a, a), (self.bytes_b, b))) and all(x and y for x, y in zip(a, b, strict=True)):
            return [True] * len(raw)
        return [b"".join(map(self.bytes_a.__getitem__, x)) == r == b"".join(map(self.bytes_b.__getitem__, y)) for r, x, y in zip(raw, a, b, strict=True)]

    def align(self, a: list[list[int]], b: list[list[int]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Groups as text and COUNTS of each word, and the links of all; each word's two sides spell the same."""
        ids_a, ids_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a, b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a, b))
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        at_a = dict(zip(ends_a.tolist(), range(1, len(ids_a) + 1), strict=True))
        at_b = dict(zip(ends_b.tolist(), range(1, len(ids_b) + 1), strict=True))
        common = sorted(at_a.keys() & at_b.keys())
        to_a, to_b = (np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (at_a, at_b))
        from_a, from_b = (np.concatenate([[0], to])[:-1] for to in (to_a, to_b))
        # every id with what follows it: the slice's A ids, then its B ids
        texts = np.empty(len(ids_a) + len(ids_b), object)
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), np.int64)
        last_a[to_a - 1], last_b[to_b - 1] = True, 1
        last_b[np.cumsum(n_b) - 1] = 2
        texts[np.arange(len(ids_a)) + np.repeat(from_b, to_a - from_a)] = self.text_a[last_a.astype(np.int64), ids_a]
        texts[np.arange(len(ids_b)) + np.repeat(to_a, to_b - from_b)] = self.text_b[last_b, ids_b]
        told = b"".join(texts.tolist()).split(b"\n")[:-1]
        # a slice's links: from one end of either side to the next the same two tokens overlap, and no other time
        edges = np.union1d(ends_a, ends_b)
        links = ids_a[np.searchsorted(ends_a, edges)] << self.shift | ids_b[np.searchsorted(ends_b, edges)]
        stops = ends_a[np.cumsum(n_a) - 1] if len(n_a) else ends_a
        within = lambda x: np.diff(np.searchsorted(x, stops, "right"), prepend=0)
        return told, np.stack([n_a, n_b, within(np.array(common)), within(edges), np.ones(len(n_a), np.int64)], axis=1), links

    def learn(self, words: set[str]) -> None:
        """Align words that are not known yet."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        a = [x.ids for x in self.a.encode_batch_fast([f" {w}" for w in new], add_special_tokens=False)]
        b = self.b.encode(new, num_threads=1)
        fine = self.spelled([f" {w}".encode() for w in new], a, b)
        good = [i for i, ok in enumerate(fine) if ok]
        told, sizes, links = self.align([a[i] for i in good], [b[i] for i in good])
        odd = [i for i, ok in enumerate(fine) if not ok]
        first = len(self.told)
        self.known.update((new[i], first + n) for n, i in enumerate(good + odd))
        self.told += told + [b""] * len(odd)
        self.sizes = np.concatenate([self.sizes, sizes, np.zeros((len(odd), 5), np.int64)])
        self.links = np.concatenate([self.links, links])
        self.characters += sum(map(len, new))

    def batch(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text its groups and COUNTS; for each text and distinct link, in order: text, link, how often."""
        if self.characters > MEMO:
            self.forget()
        words = [self.words(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(words)))
        which = [list(map(self.known.__getitem__, ws)) for ws in words]
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in which])
        flat = np.fromiter(chain.from_iterable(which), np.int64, len(owner))
        sizes = self.sizes
        ok = np.bincount(owner, 1 - sizes[flat, 4], len(texts)) == 0
        counts = np.stack([np.bincount(owner, sizes[flat, c], len(texts)).astype(np.int64) * ok for c in range(4)], axis=1)
        groups = [b";".join(map(self.told.__getitem__, w)) if fine else b"" for w, fine in zip(which, ok.tolist(), strict=True)]
        # distinct words of each text, then their links
        word, often = np.unique((owner << 32 | flat)[ok[owner]], return_counts=True)
        owner, word = word >> 32, word & 0xFFFFFFFF
        n = sizes[word, 3]
        start = (np.cumsum(sizes[:, 3]) - sizes[:, 3])[word]
        place = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        text, link, often = np.repeat(owner, n), self.links[place], np.repeat(often, n)
        order = np.lexsort((link, text))
        text, link, often = text[order], link[order], often[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(link) != 0)])[: len(text)])
        often = np.add.reduceat(often, first) if len(first) else often[:0]
        return groups, counts, text[first], link[first], often


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker."""
    key = path_a, path_b
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def groups(docs: DataFrame, path_a: str, path_b: str, text: str = "text", into: str = "groups") -> DataFrame:
    """``docs`` with a column ``into``: the groups as ``a1,a2|b1;a3|b2,b3``, ids in order, empty without tokens."""
    if into in docs.columns:
        raise ValueError(f"column {into} exists")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([g.decode() for g in aligner(path_a, path_b).batch(list(texts))[0]], dtype=object)

    return docs.withColumn(into, run(F.col(text)))


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, which have small numbers where x ascends."""
    return np.diff(x, prepend=0)


def _chunks(docs: DataFrame, path_a: str, path_b: str, limit: int) -> DataFrame:
    """A row for each chunk: its documents, its distinct links with their documents' number, and which documents hold
    which of them, how often."""
    kind = docs.schema["doc_id"].dataType
    fields = [("doc_id", to_arrow_type(kind)), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()), ("held", pa.int64())]
    schema = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.struct(fields))), *((c, pa.binary()) for c in ("links", "holders", "places", "often"))])
    ddl = f"chunk long, docs array<struct<doc_id:{kind.simpleString()},{','.join(f'{c}:long' for c in COUNTS)},groups_sha256:string,held:long>>, links binary, holders binary, places binary, often binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a = aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        parts: list[tuple] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            nonlocal number, size
            links = np.concatenate([p[3] for p in parts])
            own, places, holders = np.unique(links, return_inverse=True, return_counts=True)
            rows = pa.StructArray.from_arrays([pa.concat_arrays([p[0] for p in parts]), *(pa.array(np.concatenate([p[1][:, c] for p in parts])) for c in range(4)), pa.array([s for p in parts for s in p[2]], pa.string()), pa.array(np.concatenate([p[5] for p in parts]))], fields=[pa.field(*f) for f in fields])
            packs = [_packed(_steps(own)), _packed(holders.astype("<u4")), _packed(_steps(places).astype("<i4")), _packed(np.concatenate([p[4] for p in parts]).astype("<u4"))]
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), *(pa.array([p], pa.binary()) for p in packs)], schema=schema)
            number, size = number + 1, 0
            parts.clear()
            return out

        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                to = at
                while to < len(texts) and (to == at or size < limit):  # stops a chunk as soon as it is full
                    size += len(texts[to] or "")
                    to += 1
                told, counts, text, link, often = a.batch(texts[at:to])
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in told]
                parts.append((batch.column("doc_id").slice(at, to - at), counts, digests, link, often, np.bincount(text, minlength=to - at).astype(np.int64)))
                if size >= limit:
                    yield chunk()
                at = to
        if parts:
            yield chunk()

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    docs = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType
    shift = aligner(path_a, path_b).shift
    chunks = written(_chunks(docs, path_a, path_b, chunk), "aligned")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each link of each chunk."""
        for batch in batches:
            for number, links, holders in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, n = np.cumsum(_unpacked(links, "<i8")), _unpacked(holders, "<u4").astype(np.int64)
                for at in range(0, len(own), 1 << 16):
                    part = own[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part), pa.array(n[at : at + (1 << 16)])], names=["chunk", "place", "link", "n"])

    asked = chunks.select("chunk", "links", "holders").mapInArrow(held, "chunk long, place int, link long, n long")
    totals = asked.groupBy("link").agg(F.sum("n").alias("docs"))
    id_a = F.shiftright("link", shift)
    best = totals.groupBy(id_a.alias("id_a")).agg(F.max("docs").alias("most"))  # at most A's vocabulary
    judged = totals.join(F.broadcast(best), id_a == best["id_a"]).select(*apart("link"), "docs", (F.col("docs") == F.col("most")).alias("best"))
    answers = asked.select("chunk", "place", "link").join(judged, "link").select("chunk", "place", "docs", "best")
    names = ("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")

    def summed(of: pa.Table, answers: pa.Table) -> pa.Table:
        """A chunk's documents with their counts added up."""
        order = np.argsort(answers.column("place").to_numpy())
        docs_of, is_best = answers.column("docs").to_numpy()[order], answers.column("best").to_numpy()[order].astype(np.int64)
        out = []
        for row in range(of.num_rows):
            rows = of.column("docs").slice(row, 1).combine_chunks().flatten()
            rows = {f.name: x for f, x in zip(rows.type, rows.flatten(), strict=True)}
            n = rows["held"].to_numpy()
            places, often = np.cumsum(_unpacked(of.column("places")[row].as_py(), "<i4")), _unpacked(of.column("often")[row].as_py(), "<u4").astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(n)])
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edge])  # noqa: B023, E731
            out.append(pa.table([rows["doc_id"], *(rows[c] for c in COUNTS), pa.array(total(often * is_best[places])), pa.array(total(often * docs_of[places])), rows["groups_sha256"]], names=list(names)))
        return pa.concat_tables(out)

    ddl = f"doc_id {kind.simpleString()}, {', '.join(f'{c} long' for c in names[1:-1])}, groups_sha256 string"
    return chunks.select("chunk", "docs", "places", "often").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(summed, ddl)
