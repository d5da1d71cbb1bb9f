"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine >= c lie within epsilon = sqrt(2 - 2c). Vectors are projected on leading principal dimensions
(any orthonormal directions are valid; they are fitted on at most ``SAMPLE`` rows of the commonest length, other lengths
use their leading coordinates), sorted by their grid cells of width epsilon in lexicographic order, and cut into sequence
blocks. Two blocks are joined only if they share or neighbour a cell of the first dimension and their bounding boxes lie
within epsilon; inside a block pair sequence intervals are halved recursively, skipping intervals whose boxes are provably
distant, down to dense tiles. A tile is computed in single precision; what lies within its error bound of the limit or
above is decided in double precision.

Blocks travel once for each block they can reach. Their number follows the session's partitions (pairs of blocks make
about twice as many tasks, so a vector travels to about the root of the tasks, and traffic grows with the vectors) until
a block is as large as a task can hold (``BLOCK_BYTES``); values that are single precision numbers travel as such. Where
the leading dimensions hold most of the spread, a block reaches few others. Where all directions spread alike (no
projection can tell any two intervals apart), every pair of blocks is compared, and beyond the largest block traffic grows
with the square of the vectors over the block's size: that is the price of an exact result.

Equal vectors are one class with a multiplicity, so a vector repeated in a third of all rows is compared once. A block
pair returns for each class its number of links and its root within the pair, never the pairs themselves, so a dense
group costs as many rows as it has classes; roots are contracted by ``operators.components``.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different length don't link; rows without vec_id are left out; a repeated vec_id is collapsed to its smallest vector; a
cosine at the limit is a link; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.tables import one_row_per_id, written
from assayer.operators.components import components

SAMPLE = 5000
LEADING = 8
#: Vectors of a block at least, and bytes of its vectors (in single precision) at most.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
TILE = 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their length, without overflow or underflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column.to_pylist()])


def directions(classes: DataFrame, n: int) -> np.ndarray:
    """LEADING principal directions of at most about SAMPLE classes of ``n`` vectors in all."""
    rate = min(1.0, SAMPLE / max(1, n))
    place = F.pmod(F.xxhash64(F.lit("principal"), F.col("vec_id")), F.lit(1 << 30)) / (1 << 30)
    rows = classes.where(place < rate).select("embedding").limit(2 * SAMPLE).collect()
    if not rows:
        rows = classes.select("embedding").limit(SAMPLE).collect()
    x = unit(np.array([r[0] for r in rows], np.float64))
    _, vectors = np.linalg.eigh(x.T @ x / len(x) - np.outer(x.mean(0), x.mean(0)))
    return np.ascontiguousarray(vectors[:, ::-1][:, :LEADING])


class Pair:
    """The recursive join of two blocks (or of one with itself)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, mx: np.ndarray, my: np.ndarray, least: float, same: bool) -> None:
        self.x, self.y, self.px, self.py, self.mx, self.my, self.least, self.same = x, y, px, py, mx, my, least, same
        self.x4, self.y4 = x.astype(np.float32), y.astype(np.float32)
        self.margin = 2e-7 * (x.shape[1] + 4)  # more than single precision can be off
        self.reach = (2 - 2 * least) * (1 + 1e-9) + 1e-12
        n = len(x) + (0 if same else len(y))
        self.links, self.root = np.zeros(n, np.int64), np.arange(n)
        self.shift = 0 if same else len(x)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def merge(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.root[max(i, j)] = min(i, j)

    def join(self, a: int, b: int, c: int, d: int) -> None:
        """x[a:b] with y[c:d]."""
        if self.same and c < a:
            return
        gap = np.maximum(0, np.maximum(self.px[a:b].min(0) - self.py[c:d].max(0), self.py[c:d].min(0) - self.px[a:b].max(0)))
        if gap @ gap > self.reach:
            return
        if max(b - a, d - c) <= TILE:
            self.tile(a, b, c, d)
        elif self.same and a == c:
            m = (a + b) // 2
            self.join(a, m, a, m)
            self.join(a, m, m, b)
            self.join(m, b, m, b)
        elif b - a >= d - c:
            m = (a + b) // 2
            self.join(a, m, c, d)
            self.join(m, b, c, d)
        else:
            m = (c + d) // 2
            self.join(a, b, c, m)
            self.join(a, b, m, d)

    def tile(self, a: int, b: int, c: int, d: int) -> None:
        near = self.x4[a:b] @ self.y4[c:d].T >= self.least - self.margin
        hit = np.zeros(near.shape, bool)
        for i in np.flatnonzero(near.any(1)):  # in the plain order of operations, whatever the tile
            j = np.flatnonzero(near[i])
            hit[i, j] = (self.x[a + i] * self.y[c + j]).sum(1) >= self.least
        if self.same and a == c:
            np.fill_diagonal(hit, False)
        rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(rows):
            return
        self.links[a + rows] += hit[rows] @ self.my[c:d]
        if not (self.same and a == c):
            self.links[self.shift + c + cols] += self.mx[a:b] @ hit[:, cols]
        h = hit[np.ix_(rows, cols)]
        by_row, by_col = np.arange(len(rows)), np.zeros(len(cols), np.int64)
        while True:
            by_col = np.where(h, by_row[:, None], len(rows)).min(0)
            new = np.where(h, by_col[None, :], len(rows)).min(1)
            if (new == by_row).all():
                break
            by_row = new
        for i, r in enumerate(by_row):
            self.merge(a + int(rows[i]), a + int(rows[r]))
        for j, r in enumerate(by_col):
            self.merge(self.shift + c + int(cols[j]), a + int(rows[r]))


def near_duplicates(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with cosine >= ``least``), component_id, kept."""
    rows = one_row_per_id(vectors.select(F.col(vec).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")), "vec_id", "embedding")
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.select("vec_id", F.when(good, F.col("embedding")).alias("embedding"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    able = rows.where("embedding is not null")
    classes = written(able.groupBy("h1", "h2").agg(F.min("vec_id").alias("class"), F.count(F.lit(1)).alias("copies")), "classes")
    owners = written(able.join(classes.select(F.col("class").alias("vec_id"), "copies"), "vec_id").select("vec_id", "copies", "embedding", F.size("embedding").alias("d")), "vectors")
    common = owners.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    links = _links(owners, common["d"], common["n"], owners.count(), least) if common else None
    out = rows.join(classes, ["h1", "h2"], "left").withColumn("class", F.when(F.col("embedding").isNotNull(), F.col("class"))).select("vec_id", "class", F.when(F.col("class").isNotNull(), F.col("copies") - 1).otherwise(0).alias("twins"))
    if links is None:
        return out.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = written(links, "links")
    count = links.groupBy("class").agg(F.sum("links").alias("links"))
    found = components(links, "class", "root").withColumnsRenamed({"id": "class", "component": "reached"})
    out = out.join(count, "class", "left").join(found, "class", "left")
    component = F.coalesce("reached", "class", "vec_id")
    return out.select("vec_id", (F.col("twins") + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _links(owners: DataFrame, common: int, n_common: int, n: int, least: float) -> DataFrame:
    """class, links (vectors of other classes), root (smallest class of its group within a block pair)."""
    spark = owners.sparkSession
    basis = directions(owners.where(F.col("d") == common), n_common)
    eps = float(np.sqrt(2 - 2 * least)) * (1 + 1e-9)
    g = LEADING
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # pairs of blocks are about twice the session's partitions: a vector travels to about the root of the tasks
    size = max(1, min(max(BLOCK, -(-n // max(2, isqrt(4 * parts)))), BLOCK_BYTES // (4 * common)))

    def leading(x: np.ndarray) -> np.ndarray:
        y = x @ basis if x.shape[1] == common else x[:, :g]
        return np.hstack([y, np.zeros((len(y), g - y.shape[1]))])

    def packed(x: np.ndarray) -> list[bytes]:
        single = x.astype(np.float32)
        return [a.tobytes() if same else b.tobytes() for a, b, same in zip(single, x, (single == x).all(1))]

    def unpacked(rows: list[bytes], d: int) -> np.ndarray:
        return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * d else np.float64) for r in rows], np.float64)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                x = _matrix(part.column("embedding"))
                with np.errstate(over="ignore"):
                    rows = packed(x)
                cell = np.floor(leading(unit(x)) / eps).astype(np.int32)
                out = {"d": part.column("d"), "vec_id": part.column("vec_id"), "copies": part.column("copies"), "x": pa.array(rows, pa.binary())}
                yield pa.record_batch(out | {f"c{i}": pa.array(cell[:, i]) for i in range(g)})

    cells = [f"c{i}" for i in range(g)]
    placed = owners.mapInArrow(projected, "d int, vec_id bigint, copies bigint, x binary, " + ", ".join(f"{c} int" for c in cells))
    ordered = placed.repartitionByRange(max(1, min(parts, -(-n // size))), "d", *cells, "vec_id").sortWithinPartitions("d", *cells, "vec_id")

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: list) -> pa.RecordBatch:
            d = rows[0][0]
            y = leading(unit(unpacked([r[3] for r in rows], d)))
            lengths = np.array([len(r[3]) for r in rows], np.int32)
            first = np.floor(np.array([y[:, 0].min(), y[:, 0].max()]) / eps).astype(int).tolist()
            box = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (y.min(0), y.max(0))]
            data = [np.array([r[1] for r in rows], np.int64).tobytes(), np.array([r[2] for r in rows], np.int64).tobytes(), lengths.tobytes(), b"".join(r[3] for r in rows)]
            return pa.record_batch([pa.array([rows[0][1]]), pa.array([d], pa.int32()), *(pa.array([c], pa.int32()) for c in first), *box, *(pa.array([v], pa.binary()) for v in data)], ["block", "d", "lo", "hi", "low", "high", "ids", "copies", "lengths", "x"])

        rows: list = []
        for batch in batches:
            r = batch.to_pydict()
            for row in zip(r["d"], r["vec_id"], r["copies"], r["x"], strict=True):
                if rows and (len(rows) >= size or rows[0][0] != row[0] or len(rows) * 4 * row[0] >= BLOCK_BYTES):
                    yield block(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield block(rows)

    # a block is named by its first vector
    blocks = written(ordered.mapInArrow(blocked, "block bigint, d int, lo int, hi int, low array<double>, high array<double>, ids binary, copies binary, lengths binary, x binary"), "blocks")
    left = blocks.select("d", "block", "low", "high", F.explode(F.sequence("lo", "hi")).alias("cell"))
    right = blocks.select("d", F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)).alias("cell"))
    gaps = F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v * v) <= (2 - 2 * least) * (1 + 1e-9) + 1e-12
    pairs = left.join(right, ["d", "cell"]).where((F.col("block") <= F.col("other")) & near).select("block", "other").distinct()
    # overlaps are symmetric only up to the neighbouring cells: list both orders, keep the smaller first
    back = left.join(right, ["d", "cell"]).where((F.col("block") > F.col("other")) & near).select(F.col("other").alias("block"), F.col("block").alias("other")).distinct()
    pairs = pairs.union(back).distinct()
    sides = pairs.select("block", "other", F.explode(F.array_distinct(F.array("block", "other"))).alias("own"))
    data = blocks.select(F.col("block").alias("own"), "d", "ids", "copies", "lengths", "x")

    def joined(table: pa.Table) -> pa.Table:
        r = table.to_pydict()
        at = sorted(range(len(r["own"])), key=lambda i: r["own"][i])
        ids = [np.frombuffer(r["ids"][i], np.int64) for i in at]
        copies = [np.frombuffer(r["copies"][i], np.int64) for i in at]
        x = []
        for i in at:
            stops = np.cumsum(np.frombuffer(r["lengths"][i], np.int32)).tolist()
            x.append(unit(unpacked([r["x"][i][a:b] for a, b in zip([0, *stops], stops)], r["d"][i])))
        y = [leading(v) for v in x]
        p = Pair(x[0], x[-1], y[0], y[-1], copies[0], copies[-1], least, len(at) == 1)
        p.join(0, len(x[0]), 0, len(x[-1]))
        name = np.concatenate(ids)
        has = np.flatnonzero(p.links)
        roots = np.array([p.find(int(i)) for i in has], np.int64) if len(has) else has
        smallest = np.full(len(name), np.iinfo(np.int64).max)
        np.minimum.at(smallest, roots, name[has])
        return pa.table({"class": pa.array(name[has]), "links": pa.array(p.links[has]), "root": pa.array(smallest[roots])})

    return sides.join(data, "own").groupBy("block", "other").applyInArrow(joined, "class bigint, links bigint, root bigint")
