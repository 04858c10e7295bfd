"""Exact top-k search by inner product, without random access while lists are read.

Vectors are made integers. A task takes the candidates that it scans in cells of up to ``CELL``; in a cell each dimension
is a list of the candidates, sorted by component. A query reads its lists from the end that its own component
prefers, a stretch (one of STRETCHES) at a time, for many queries at once by products of matrices, and keeps for every
candidate a lower bound (what was read, and the least for what wasn't) and an upper bound (what was read, and what
the lists' reading points still allow). Candidates whose upper bound is under the k-th lower bound are out; once few
are left (FEW, or an eighth of the cell), no outsider can qualify, reading stops, and the final scores of the few are
resolved. Queries start at the depth where a quarter of those just before them could stop, and every EIGHTH time one
stretch earlier.

Bounds are kept in floats that hold every sum exactly as a whole number, which the largest components of the cell and
of the queries decide; where no float does, scores are inner products of 64-bit integers.

Candidates are read where they lie and not shuffled. Queries are written once and meet all candidates in blocks of at
most ``QUERY_ROWS`` rows and ``QUERY_BYTES`` bytes, one pass a block; such a block is what is broadcast. Each task
returns k candidates for a query. Vectors that are null, or hold a null or a component that isn't finite, take no
part, nor do rows without an id; a shorter vector is filled with zeros. Rows that repeat an id are candidates each,
but never for their own id; as queries equal rows count once, and an id with several vectors asks with each. Ties go
to the smaller id. Scores must fit a long. Extra columns are ignored; a table without queries gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import new_path, trim, written

CELL, STRETCHES, FEW, TOGETHER, EIGHTH = 16_384, 8, 64, 64, 8
QUERY_ROWS, QUERY_BYTES = 16_384, 32 << 20
_SCHEMA = "query_id long, vec_id long, score long"


class Lists:
    """The candidates of a cell, sorted by each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.n, self.width = self.vectors.shape
        self.most = max(int(self.vectors.max(initial=0)), -int(self.vectors.min(initial=0)))
        by = np.argsort(self.vectors, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.vectors, by.T, 0).T
        self.rank = np.empty(by.shape, np.int16 if self.n < 32_000 else np.int32)
        np.put_along_axis(self.rank, by, np.broadcast_to(np.arange(self.n, dtype=self.rank.dtype), by.shape), 1)
        self.kind, self.start, self.tiles = None, 1, 0
        self.resolved = self.stops = 0

    def _hold(self, kind) -> None:
        """Lists and vectors in a kind of floats."""
        if self.kind is not kind:
            self.kind, self.lists, self.rows, self.read = kind, self.sorted.astype(kind), self.vectors.astype(kind), {}
            self.columns = np.ascontiguousarray(self.rows.T)

    def top(self, queries: np.ndarray, owns: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (positions, scores) of the k best candidates whose id isn't its own, best first."""
        for at in range(0, len(queries), TOGETHER):
            part, mine = queries[at : at + TOGETHER], owns[at : at + TOGETHER]
            largest = max(int(part.max(initial=0)), -int(part.min(initial=0)))
            reach = 4 * max(1, self.width) * self.most * largest  # a lower bound, and what three sums add to it
            kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else None
            if kind is None:
                few_of, rows, asked = [np.arange(self.n)] * len(part), self.vectors, part
            else:
                self._hold(kind)
                few_of, rows, asked = self._few(part.astype(kind), mine, k), self.rows, part.astype(kind)
            for query, own, few in zip(asked, mine, few_of, strict=True):
                few = few[self.ids[few] != own]
                score = (rows[few] @ query).astype(np.int64)
                best = np.lexsort((self.ids[few], -score))[:k]
                yield few[best], score[best]

    def _bounds(self, q: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of all candidates for each query after ``done`` entries of every list."""
        if done not in self.read:
            if len(self.read) > 1:
                self.read.pop(next(iter(self.read)))
            seen = np.concatenate([self.rank < done, self.rank >= self.n - done]).astype(self.kind)
            self.read[done] = seen, np.concatenate([self.columns, self.columns]) * seen
        seen, worth = self.read[done]
        down = q > 0
        least = np.where(down, self.lists[:, 0], self.lists[:, -1]) * q
        point = np.where(down, self.lists[:, self.n - done], self.lists[:, done - 1]) * q - least
        sides = lambda x: np.concatenate([np.where(down, 0, x), np.where(down, x, 0)], 1).astype(q.dtype)
        lower = sides(q) @ worth - sides(least) @ seen + least.sum(1, keepdims=True)
        return lower, lower + point.sum(1, keepdims=True) - sides(point) @ seen

    def _few(self, q: np.ndarray, owns: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the candidates that may be among the best, when reading could stop."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
        first, end = np.searchsorted(self.ids, owns, "left"), np.searchsorted(self.ids, owns, "right")
        open_ = np.arange(len(q))
        depth = max(1, self.start - (self.tiles % EIGHTH == EIGHTH - 1))
        self.tiles += 1
        stopped: list[int] = []
        while len(open_):
            done = min(self.n, depth * -(-self.n // STRETCHES))
            lower, upper = self._bounds(q[open_], done)
            on = []
            for row, i in enumerate(open_):
                low, high = lower[row], upper[row]
                low[first[i] : end[i]] = high[first[i] : end[i]] = -np.inf
                bar = np.partition(low, self.n - k)[self.n - k] if self.n - (end[i] - first[i]) > k else -np.inf
                left = np.flatnonzero(high >= bar)
                if done >= self.n or len(left) <= max(FEW, self.n // 8):
                    out[i] = left
                    stopped.append(depth)
                    self.resolved, self.stops = self.resolved + len(left), self.stops + 1
                else:
                    on.append(i)
            open_, depth = np.array(on, np.int64), depth + 1
        self.start = sorted(stopped)[len(stopped) // 4]
        return out


def whole_vectors(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, list[np.ndarray] | np.ndarray]:
    """(ids, rows of whole numbers) of the sound rows of a batch (vec_id, embedding)."""
    lists, ids = batch.column("embedding"), np.asarray(batch.column("vec_id").fill_null(0))
    lists = lists.cast(pa.list_(pa.float64()))
    offsets, values = np.asarray(lists.offsets), lists.values
    null = np.asarray(values.is_null())
    raw = np.asarray(values.fill_null(0.0))
    bad = np.concatenate([[0], np.cumsum(null | ~np.isfinite(raw))])
    sound = np.asarray(batch.column("vec_id").is_valid()) & np.asarray(lists.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]])
    scaled = np.floor(np.where(np.isfinite(raw), raw, 0.0) * scale).astype(np.int64)
    keep = np.flatnonzero(sound)
    sizes = (offsets[1:] - offsets[:-1])[keep]
    out = np.zeros((len(keep), int(sizes.max(initial=0))), np.int64)
    inside = np.arange(out.shape[1])[None, :] < sizes[:, None]
    out[inside] = scaled[(offsets[keep][:, None] + np.arange(out.shape[1])[None, :])[inside]]
    return ids[keep], out


def _wide(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] == width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _together(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([_wide(p, width) for p in parts])


class _Best:
    """The k best so far of each query."""

    def __init__(self, owns: np.ndarray, queries: np.ndarray, k: int):
        self.owns, self.queries, self.k = owns, queries, k
        self.score, self.id, self.there = (np.zeros((len(owns), k), t) for t in (np.int64, np.int64, bool))

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        width = max(vectors.shape[1], self.queries.shape[1])
        cell = Lists(ids, _wide(vectors, width))
        score, id_, there = (np.concatenate([x, np.zeros_like(x)], 1) for x in (self.score, self.id, self.there))
        for i, (at, found) in enumerate(cell.top(_wide(self.queries, width), self.owns, self.k)):
            score[i, self.k : self.k + len(at)], id_[i, self.k : self.k + len(at)], there[i, self.k : self.k + len(at)] = found, cell.ids[at], True
        order = np.lexsort((id_, -score, ~there))[:, : self.k]
        self.score, self.id, self.there = (np.take_along_axis(x, order, 1) for x in (score, id_, there))

    def rows(self) -> pa.RecordBatch:
        query = np.broadcast_to(self.owns[:, None], self.id.shape)[self.there]
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(self.id[self.there]), pa.array(self.score[self.there])], ["query_id", "vec_id", "score"])


def _pass(vectors: DataFrame, owns: np.ndarray, queries: np.ndarray, k: int, scale: int) -> DataFrame:
    """Rows (query_id, vec_id, score): the best of each task for a block of queries, which is broadcast."""
    held = vectors.sparkSession.sparkContext.broadcast((owns, queries))

    def run(batches):
        best = _Best(*held.value, k)
        ids, rows, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CELL):
                own, part = whole_vectors(batch.slice(at, CELL), scale)
                if n + len(own) > CELL:
                    best.meet(np.concatenate(ids), _together(rows))
                    ids, rows, n = [], [], 0
                if len(own):
                    ids.append(own)
                    rows.append(part)
                    n += len(own)
        if n:
            best.meet(np.concatenate(ids), _together(rows))
        yield best.rows()
        trim()

    return vectors.mapInArrow(run, _SCHEMA)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its k best other rows."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))

    def ask(batches):
        for batch in batches:
            own, rows = whole_vectors(batch, scale)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(list(rows), pa.list_(pa.int64()))], ["vec_id", "v"])

    asked = vectors.filter(F.col("vec_id") % every == 0).mapInArrow(ask, "vec_id long, v array<long>").distinct()
    asked = written(asked.withColumn("at", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30))), "queries")
    seen = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    most = max(1, min(QUERY_ROWS, QUERY_BYTES // (8 * max(1, seen["width"] or 1))))
    blocks, path = -(-seen["n"] // most), new_path(spark, "best")
    for block in range(blocks):
        mine = asked.filter((F.col("at") >= (block << 30) // blocks) & (F.col("at") < ((block + 1) << 30) // blocks)).orderBy("vec_id", "v").toArrow()
        owns, rows = np.asarray(mine.column("vec_id"), dtype=np.int64), mine.column("v").to_pylist()
        width = max(map(len, rows), default=0)
        for at in range(0, len(rows), most):
            part = np.array([r + [0] * (width - len(r)) for r in rows[at : at + most]], np.int64).reshape(-1, width)
            _pass(vectors, owns[at : at + most], part, k, scale).write.mode("append").parquet(path)
    best = spark.read.schema(_SCHEMA).parquet(path) if blocks else spark.createDataFrame([], _SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
