"""Windows that occur more than once in a corpus, found exactly by super-k-mer partitioning.

A window is ``w`` consecutive units (words or bytes) of one document; its minimiser is the unit run of length ``m`` in
it with the smallest hash, the leftmost if several. Consecutive windows with one minimiser form a super-k-mer, and travel
as one packed string to the bucket of the minimiser's hash; equal windows have equal minimisers, so they meet.

Documents are dealt to pages by a hash of doc_id, once; every later step reuses that exchange:

1. each page sends the distinct minimiser hashes it has, with how often (8 bytes each), to buckets;
2. a bucket answers each page with those that occur elsewhere too, and marks the *hot* ones, with too many strings for
   one group;
3. a page packs the super-k-mers with these minimisers. Equal strings of a page travel once, the others are repeats
   already. Hot minimisers are split: their super-k-mers are cut into windows, whose minimiser is the whole window, so
   each goes to the bucket of its own hash and a passage which a third of all documents share spreads out;
4. a bucket compares strings exactly and answers each page with runs of repeated windows;
5. a page takes the covered units out of its documents.

No step sees an unbounded group: a page is bounded by the paging, a group holds fewer than HOT strings or one window, of
which each page sends one. A page writes a row a bucket, and never more rows than it has minimisers, so the rows of an
exchange grow with the text. Nothing is dropped or capped, nothing goes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.tables import one_row_per_id
from assayer.llm.arrays import BYTES, U, chunks, joined, sliding_argmin, window_hashes, word_hashes, words_in

#: A minimiser that occurs this often is hot: its group is split into windows. A page counts up to TIMES, which is more,
#: so a group is known as hot whether its strings lie in one page or in many.
HOT, TIMES = 2048, 4095
#: Hashes without their lowest bits, which hold how often the minimiser is in a page (or, in answers: hot).
HASH = ~U(TIMES)
#: Bytes of strings that a bucket compares at once; whole groups of a minimiser stay together.
BATCH = 3 << 20
RUN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])
ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i4"), ("size", "<i4"), ("page", "<i4")])


class Kind:
    """What windows are made of."""

    def __init__(self, unit: str, w: int, m: int) -> None:
        self.unit, self.w, self.m = unit, w, m

    def prepared(self, text: str | None) -> bytes:
        raw = (text or "").encode("utf-8", "surrogatepass")
        return b" ".join(raw.split()) if self.unit == "word" else raw

    def cut(self, texts: list[bytes]) -> Iterator[tuple]:
        """By chunk: data, and of each super-k-mer its text, first window, windows, minimiser hash, place in the chunk; and
        two functions of places: the bytes from and to of n windows there, the hashes of windows."""
        w, m = self.w, self.m
        for i, j in chunks(texts):
            data, starts = joined(texts[i:j])
            if self.unit == "word":
                a, b, counts = words_in(data, starts)
                values, ends = word_hashes(data, a, b), counts[1:]
            else:
                a = b = None
                values, counts, ends = BYTES[data], starts, starts[1:] - 1
            place = sliding_argmin(mh := window_hashes(values, m) & HASH, w - m + 1)
            if not len(place):
                continue
            ok = np.arange(len(place)) + w <= np.repeat(ends, np.diff(counts))[: len(place)]
            first = ok.copy()
            first[1:] &= ~ok[:-1] | (place[1:] != place[:-1])
            s = np.flatnonzero(first)
            if not len(s):
                continue
            n = np.bincount(np.cumsum(first)[ok] - 1, minlength=len(s))
            text = np.searchsorted(counts, s, "right") - 1

            def span(s, n, a=a, b=b):
                return (a[s], b[s + n - 1 + w - 1]) if self.unit == "word" else (s, s + n - 1 + w)

            yield data, i + text, s - counts[text], n, mh[place[s]], s, span, (lambda s, v=values: window_hashes(v, w)[s] & HASH)


def pages(docs: DataFrame) -> int:
    """Partitions for the documents: about 8 MB of Parquet each, and the session's shuffle partitions at least."""
    spark = docs.sparkSession
    scan = docs._jdf.queryExecution().toRdd().getNumPartitions()
    size = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), scan * ceil(size / (8 << 20)))


def paged(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, int]:
    docs = one_row_per_id(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    n = pages(docs)
    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(2 * n)).cast("int").alias("page"), "doc_id", "text").repartition(n, "page"), n


def _texts(table: pa.Table, kind: Kind) -> tuple[np.ndarray, list[bytes]]:
    return table.column("doc_id").to_numpy(), [kind.prepared(t) for t in table.column("text").to_pylist()]


def _page(table: pa.Table) -> int:
    return table.column("page")[0].as_py()


def _split(parts: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each bucket's members."""
    order = np.argsort(parts, kind="stable")
    edges = np.searchsorted(parts[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U(20)) % U(buckets)).astype(np.int64)


def _entry_arrays(table: pa.Table, name: str, kind) -> np.ndarray:
    found = [np.frombuffer(x, kind) for x in table.column(name).to_pylist() if x]
    return np.concatenate(found) if found else np.zeros(0, kind)


def _told(page: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
    """Runs by page."""
    order = np.argsort(page, kind="stable")
    page, runs = page[order], runs[order]
    edges = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1], [True]]))
    return pa.record_batch({"page": pa.array(page[edges[:-1]], pa.int32()), "runs": pa.array([runs[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())})


def _again(head: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Which strings came before as a whole, byte by byte; strings are sorted by key, document and start."""
    first: dict[bytes, int] = {}
    return np.array([first.setdefault(s, i) for i, s in enumerate(strings)]) != np.arange(len(strings))


def _runs(head: np.ndarray, hit: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of marked windows, by page; hit: all windows of all strings, size: windows of each string."""
    if not hit.any():
        return
    at = np.cumsum(size) - size
    first = np.zeros(len(hit), bool)
    first[at] = True
    start = np.flatnonzero(hit & (first | ~np.concatenate([[False], hit[:-1]])))
    last = np.flatnonzero(hit & np.concatenate([first[1:] | ~hit[1:], [True]]))
    entry = np.searchsorted(at, start, "right") - 1
    runs = np.zeros(len(start), RUN)
    runs["doc"], runs["start"], runs["n"] = head["doc"][entry], head["start"][entry] + start - at[entry], last - start + 1
    yield _told(head["page"][entry], runs)


def repeated_windows(docs: DataFrame, kind: Kind, same_document: bool, compare: Callable) -> tuple[DataFrame, DataFrame]:
    """(pages of documents, runs: page, runs binary). ``compare(entries, strings)`` marks, for strings sorted by
    key, document and start, each window that an earlier string of the key has: all windows' marks in one array, and
    the number of windows of each string. ``same_document``: an earlier
    start in the same document counts too."""
    base, n = paged(docs, "doc_id", "text")
    buckets = n

    def minimisers(table: pa.Table) -> pa.Table:
        _, texts = _texts(table, kind)
        found = [c[4] for c in kind.cut(texts)]
        keys, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, U), np.zeros(0, int))
        keys = keys | np.minimum(count, TIMES).astype(U)
        rows = [(b, keys[at].tobytes()) for b, at in _split(_bucket(keys & HASH, buckets), buckets)]
        page = _page(table)
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "page": pa.array([page] * len(rows), pa.int32()), "keys": pa.array([x for _, x in rows], pa.binary())})

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, at = [], []
        for batch in batches:
            for page, raw in zip(batch.column("page").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                keys.append(np.frombuffer(raw, U))
                at.append(np.full(len(keys[-1]), page, np.int32))
        if not keys:
            return
        keys, at = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(keys)
        keys, at = keys[order], at[order]
        own = keys & HASH
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        size = np.diff(np.append(head, len(own)))
        times = np.add.reduceat(keys & ~HASH, head)
        told = np.repeat(times > 1, size)
        answer = own | np.repeat(times >= HOT, size).astype(U)
        own, at = answer[told], at[told]
        order = np.argsort(at, kind="stable")
        own, at = own[order], at[order]
        if len(at):
            edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            yield pa.record_batch({"page": pa.array(at[edges[:-1]], pa.int32()), "keys": pa.array([own[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())})

    def packed(table: pa.Table, answer: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "entries": [], "runs": [], "strings": []}
        if table.num_rows and answer.num_rows:
            page = _page(table)
            docs_, texts = _texts(table, kind)
            wanted = np.sort(_entry_arrays(answer, "keys", "<u8"))
            cold, hot = wanted[wanted & U(1) == 0], wanted[wanted & U(1) == 1] & HASH
            entries: list[tuple] = []  # key, doc, start, n, string
            runs: list[tuple] = []
            best: dict[bytes, int] = {}

            # in order of document and start, the first of equal strings is the earliest
            pieces = []
            for data, text, start, n_, key, s, span, window_key in kind.cut(texts):
                which = np.isin(key, hot)
                at = np.flatnonzero(np.isin(key, cold) & ~which)
                a, b = span(s[at], n_[at])
                pieces += zip(docs_[text[at]].tolist(), start[at].tolist(), n_[at].tolist(), key[at].tolist(), [data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)], strict=True)
                at = np.flatnonzero(which)
                if len(at):
                    step = np.arange(int(n_[at].sum())) - np.repeat(np.cumsum(n_[at]) - n_[at], n_[at])
                    each = np.repeat(s[at], n_[at]) + step
                    a, b = span(each, np.ones(len(each), np.int64))
                    pieces += zip(np.repeat(docs_[text[at]], n_[at]).tolist(), (np.repeat(start[at], n_[at]) + step).tolist(), [1] * len(each), window_key(each).tolist(), [data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)], strict=True)
            pieces.sort(key=lambda p: (p[0], p[1]))
            for doc, start, n_, key, string in pieces:
                k = best.setdefault(string, len(entries))
                if k < len(entries) and (same_document or doc != entries[k][1]):
                    runs.append((doc, start, n_))
                else:  # the first, or another one in the first's document
                    entries.append((key, doc, start, n_, string))
            out["bucket"].append(page % buckets)
            out["entries"].append(None)
            out["strings"].append(None)
            out["runs"].append((page, np.array(runs, RUN).tobytes()))
            if entries:
                head = np.zeros(len(entries), ENTRY)
                for i, name in enumerate(("key", "doc", "start", "n")):
                    head[name] = np.array([e[i] for e in entries], ENTRY[name])
                head["size"], head["page"] = [len(e[4]) for e in entries], page
                for bucket, at in _split(_bucket(head["key"], buckets), buckets):
                    out["bucket"].append(bucket)
                    out["entries"].append(head[at].tobytes())
                    out["runs"].append(None)
                    out["strings"].append(pa.compress(b"".join([entries[i][4] for i in at]), codec="zstd", asbytes=True))
        return pa.table({
            "bucket": pa.array(out["bucket"], pa.int32()),
            "page": pa.array([r[0] if r else -1 for r in out["runs"]], pa.int32()),
            "runs": pa.array([r[1] if r else None for r in out["runs"]], pa.binary()),
            "entries": pa.array(out["entries"], pa.binary()),
            "strings": pa.array(out["strings"], pa.binary()),
        })

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, strings = [], []
        for batch in batches:
            rows = batch.to_pydict()
            for page, runs, entries, raw in zip(rows["page"], rows["runs"], rows["entries"], rows["strings"], strict=True):
                if runs:
                    yield pa.record_batch({"page": pa.array([page], pa.int32()), "runs": pa.array([runs], pa.binary())})
                if entries:
                    h = np.frombuffer(entries, ENTRY)
                    raw = pa.decompress(raw, int(h["size"].sum()), codec="zstd", asbytes=True)
                    stops = np.cumsum(h["size"]).tolist()
                    heads.append(h)
                    strings += [raw[b - s : b] for b, s in zip(stops, h["size"].tolist(), strict=True)]
        if not heads:
            return
        head = np.concatenate(heads)
        order = np.lexsort((head["start"], head["doc"], head["key"]))
        head = head[order]
        strings = [strings[i] for i in order]
        at = np.arange(len(head))
        if same_document:  # equal strings are one: only the first goes on, the others are repeats
            again = _again(head, strings)
            whole = np.zeros(int(again.sum()), RUN)
            for name in ("doc", "start", "n"):
                whole[name] = head[name][again]
            if len(whole):
                yield _told(head["page"][again], whole)
            at = np.flatnonzero(~again)
        # batch by batch of whole groups; strings alone in their group are done
        same = head["key"][at][1:] == head["key"][at][:-1]
        at = at[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(at) else at
        head, strings = head[at], [strings[i] for i in at]
        if not len(head):
            return
        edge = np.flatnonzero(np.concatenate([[True], head["key"][1:] != head["key"][:-1]]))
        total = np.concatenate([[0], np.cumsum(head["size"])])
        a = 0
        while a < len(head):
            b = int(np.searchsorted(total, total[a] + BATCH))
            k = int(np.searchsorted(edge, max(b, a + 1)))
            b = int(edge[k]) if k < len(edge) else len(head)
            own = head[a:b]
            hit, size = compare(own, strings[a:b])
            yield from _runs(own, hit, size)
            a = b

    asked = base.groupBy("page").applyInArrow(minimisers, "bucket int, page int, keys binary").repartition(n, "bucket")
    answers = asked.mapInArrow(shared, "page int, keys binary").repartition(n, "page")
    sent = base.groupBy("page").cogroup(answers.groupBy("page")).applyInArrow(packed, "bucket int, page int, runs binary, entries binary, strings binary").repartition(n, "bucket")
    return base, sent.mapInArrow(compared, "page int, runs binary").repartition(n, "page")


def applied(base: DataFrame, runs: DataFrame, finish: Callable[[bytes, str | None, np.ndarray], tuple], fields: pa.Schema, schema: str) -> DataFrame:
    """``finish(text, runs of the document)`` of every document, by page."""

    def run(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return fields.empty_table()
        found = _entry_arrays(answer, "runs", RUN)
        found = found[np.argsort(found["doc"], kind="stable")]
        docs = table.column("doc_id").to_numpy()
        low, high = np.searchsorted(found["doc"], docs), np.searchsorted(found["doc"], docs, "right")
        rows = [(int(d), *finish(t, found[a:b])) for d, t, a, b in zip(docs, table.column("text").to_pylist(), low, high, strict=True)]
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)

    return base.groupBy("page").cogroup(runs.groupBy("page")).applyInArrow(run, schema)


def covered(runs: np.ndarray, w: int, n: int) -> np.ndarray:
    """Which of n units lie in a window that starts in a run."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs["start"], 1)
    np.add.at(change, np.minimum(n, runs["start"] + runs["n"] - 1 + w), -1)
    return np.cumsum(change[:-1]) > 0
