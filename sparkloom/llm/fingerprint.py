"""Document fingerprints from prefix polynomial hashes.

For a text of code points c the prefix array holds h[i + 1] = h[i] B + c[i] + 1 modulo a prime, for two primes below
2^31. h[i + n] - h[i] B^n stands for the span of n code points at i; so any two spans, of one text or of two, are
compared in constant time, and the longest common extension from two places is found by binary search. Prefix arrays
are made CHUNK places at a time. The fingerprint is a sketch of all spans of ``SPAN`` code points: the ``SKETCH``
smallest of their mixed hashes, with the length and the hash of the whole text before them. The likeness of two
fingerprints is the share of spans in common (twice the common ones by the sum of both), as the sketches estimate it,
with a standard error of about 0.06; it is 1 for equal texts.

Rows are ordered by id, those without one last, and rows that repeat an id by a hash of their text and by the text, so
"the next document" is defined for all; the last row's is the first, and a single row is its own. Rows are dealt out in
ranges of that order, whose limits (id, hash) come from a sample: about RANGE_BYTES of texts each, and RANGES of them
at most, so that what the driver holds and sends is bounded; in larger tables ranges grow, and are sorted and streamed.
So rows that share an id, or have none, are spread too; only equal rows stay together.

A null text is an empty one; a text shorter than a span is one span. A text takes about 16 bytes of memory a code
point besides itself, and a task holds two texts and the edited one. Extra columns are ignored; a table without rows
gives none.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import U64, mix, trim

PRIMES, BASE, SPAN, SKETCH, CHUNK = (2147483647, 2147483629), 1315423911, 24, 64, 1 << 14
#: Texts of about so many bytes make a range, of which there are RANGES at most; keys sampled for the cuts between ranges.
RANGE_BYTES, RANGES, SAMPLES = 6_000_000, 100_000, 20


@functools.lru_cache(1)
def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime the first CHUNK + 1 powers of the base and of its inverse."""
    out = []
    for p in PRIMES:
        pair = []
        for base in (BASE % p, pow(BASE % p, -1, p)):
            run = np.ones(1, U64)
            while len(run) <= CHUNK:
                run = np.concatenate([run, run * U64(pow(base, len(run), p)) % U64(p)])
            pair.append(run[: CHUNK + 1])
        out.append(tuple(pair))
    return out


class Prefixes:
    """Prefix arrays of a text; edited() makes those of an edited text from those of its parts."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays, self.n = arrays, len(arrays[0]) - 1

    @classmethod
    def of(cls, points: np.ndarray) -> Prefixes:
        n, arrays = len(points), []
        for p, (up, down) in zip(PRIMES, _powers(), strict=True):
            out, last = np.zeros(n + 1, np.uint32), 0
            for at in range(0, n, CHUNK):
                c = points[at : at + CHUNK].astype(U64) + U64(1)
                m = len(c)
                # sums of c[j] B^-j, below 2^45, times B^i: the hashes of this chunk alone; and the text before it
                run = np.cumsum(c * down[:m] % U64(p)) % U64(p) * up[:m] % U64(p)
                if last:
                    run = (run + up[1 : m + 1] * U64(last) % U64(p)) % U64(p)
                out[at + 1 : at + m + 1] = run
                last = int(run[-1])
            arrays.append(out)
        return cls(arrays)

    def edited(self, keep: int, other: Prefixes, take: int) -> Prefixes:
        """Of the first ``keep`` code points, and behind them the first ``take`` of the other text."""
        arrays = []
        for p, (up, _), a, b in zip(PRIMES, _powers(), self.arrays, other.arrays, strict=True):
            out = np.empty(keep + take + 1, np.uint32)
            out[: keep + 1] = a[: keep + 1]
            for at in range(0, take, CHUNK):
                m = min(CHUNK, take - at)
                before = U64(int(a[keep]) * pow(BASE, at, p) % p)
                out[keep + at + 1 : keep + at + m + 1] = (b[at + 1 : at + m + 1] + up[1 : m + 1] * before % U64(p)) % U64(p)
            arrays.append(out)
        return Prefixes(arrays)

    def span(self, start: int, size: int) -> tuple[int, ...]:
        """The hash of a span, wherever it lies."""
        return tuple((int(a[start + size]) - int(a[start]) * pow(BASE, size, p)) % p for p, a in zip(PRIMES, self.arrays, strict=True))

    def same(self, start: int, other: Prefixes, at: int, size: int) -> bool:
        return self.span(start, size) == other.span(at, size)

    def extension(self, start: int, other: Prefixes, at: int) -> int:
        """Length of the longest common extension from two places, by binary search."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(start, other, at, middle) else (low, middle - 1)
        return low

    def spans(self, size: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """32-bit hashes, of 62 bits, of all spans of ``size`` that start in [low, high)."""
        high = self.n - size + 1 if high is None else min(high, self.n - size + 1)
        if high <= low:
            return np.empty(0, np.uint32)
        out = np.empty(high - low, np.uint32)
        for at in range(low, high, CHUNK):
            end, parts = min(high, at + CHUNK), []
            for p, a in zip(PRIMES, self.arrays, strict=True):
                parts.append((a[at + size : end + size] + U64(p) - a[at:end] * U64(pow(BASE, size, p)) % U64(p)) % U64(p))
            out[at - low : end - low] = mix((parts[0] << U64(32)) | parts[1]) >> U64(32)
        return out


def _smallest(hashes: list[np.ndarray]) -> np.ndarray:
    """The SKETCH smallest distinct hashes, in order."""
    few = []
    for h in hashes:
        if len(h) > 16 * SKETCH:
            near = np.unique(np.partition(h, 8 * SKETCH)[: 8 * SKETCH])
            h = near if len(near) >= SKETCH else np.unique(h)
        few.append(h)
    return np.unique(np.concatenate(few))[:SKETCH]


class Print:
    """A text's prefix arrays, span hashes and fingerprint."""

    def __init__(self, text: str):
        self.text, self.prefixes = text, Prefixes.of(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        self.n = self.prefixes.n
        self.hashes = self.prefixes.spans(SPAN) if self.n >= SPAN else self.prefixes.spans(self.n) if self.n else np.empty(0, np.uint32)
        self.sketch = _smallest([self.hashes])
        self.name = named(self.prefixes, self.sketch)


def named(prefixes: Prefixes, sketch: np.ndarray) -> str:
    whole = prefixes.span(0, prefixes.n)
    return f"{prefixes.n}:{whole[0]:08x}{whole[1]:08x}:" + "".join(f"{int(h):08x}" for h in sketch)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of common spans of two sketches: 2 J / (1 + J) for the similarity J of the sets."""
    union = np.union1d(a, b)[: max(SKETCH if max(len(a), len(b)) >= SKETCH else len(a) + len(b), 1)]
    if not len(union):
        return 1.0
    both = len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True))
    j = both / len(union)
    return 2 * j / (1 + j)


def compare(own: Print, after: Print) -> tuple:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, extension to the edited, to the next)."""
    tail = own.n // 2
    keep, take = own.n - tail, min(tail, after.n)
    text = own.text[:keep] + after.text[:take]
    edited = own.prefixes.edited(keep, after.prefixes, take)
    if edited.n < SPAN:
        sketch = _smallest([edited.spans(edited.n)]) if edited.n else np.empty(0, np.uint32)
    else:
        inner = max(0, keep - SPAN + 1)
        sketch = _smallest([own.hashes[:inner] if own.n >= SPAN else np.empty(0, np.uint32), edited.spans(SPAN, inner, keep), after.hashes[: max(0, take - SPAN + 1)] if after.n >= SPAN else np.empty(0, np.uint32)])
    name = named(edited, sketch)
    return (own.n, hashlib.sha256(text.encode()).hexdigest(), own.name, name, 1.0 if own.name == name else likeness(own.sketch, sketch), 1.0 if own.name == after.name else likeness(own.sketch, after.sketch), own.prefixes.extension(0, edited, 0), own.prefixes.extension(0, after.prefixes, 0))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, lce_edited long, lce_next long"


def _key() -> list[Column]:
    """A row's id in two columns without nulls."""
    return [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")]


def _cuts(keyed: DataFrame) -> list[tuple[bool, int, int]]:
    """Keys at which ranges start, beginning with the least of all, from a sample by hash, SAMPLES a range."""
    seen = keyed.agg(F.sum("n").alias("bytes"), F.count("*").alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash")).alias("low")).first()
    if not seen["rows"]:
        return []
    low = (seen["low"]["none"], seen["low"]["doc_id"] or 0, seen["low"]["_hash"])
    ranges = max(1, min(RANGES, -(-seen["bytes"] // RANGE_BYTES), seen["rows"]))
    share = min(1.0, ranges * SAMPLES / seen["rows"])
    picked = keyed.filter(F.pmod(F.xxhash64("doc_id", "_hash"), F.lit(1 << 31)) < int(share * (1 << 31))).select(*_key(), "_hash").distinct()
    none, ids, hashes = picked.toArrow().to_pandas().to_numpy(object).T.reshape(3, -1) if ranges > 1 else np.empty((3, 0), object)
    none, ids, hashes = none.astype(bool), ids.astype(np.int64), hashes.astype(np.int64)
    order = np.lexsort((hashes, ids, none))
    picks = order[np.arange(1, ranges) * len(order) // ranges] if len(order) else order
    return sorted({low, *(k for k in zip(none[picks].tolist(), ids[picks].tolist(), hashes[picks].tolist(), strict=True) if k > low)})


def _ranged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _hash, _range, _mark): rows by the range that their keys lie in, and the first rows of each range
    once more, marked, in the range before it; those of the first range are in the last."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("_hash", F.xxhash64("text"))
    cuts = docs.sparkSession.sparkContext.broadcast(_cuts(docs.select("doc_id", "_hash", F.octet_length("text").alias("n"))))

    @F.pandas_udf("_range int, _first boolean")
    def place(without: pd.Series, id_: pd.Series, hash_: pd.Series) -> pd.DataFrame:
        """The range of each row, and whether its key is the range's first."""
        starts = cuts.value
        ids = np.array([c[1] for c in starts if not c[0]], np.int64)
        none, own, h = without.to_numpy(bool), id_.to_numpy(np.int64), hash_.to_numpy(np.int64)
        at = np.where(none, len(ids), np.searchsorted(ids, own, "right")) - 1
        # keys that share their id with a cut, or have none, are placed by their hashes too
        close = np.flatnonzero(none | ((at >= 0) & (ids[np.maximum(at, 0)] == own))) if len(ids) else np.arange(len(own))
        keys = [(bool(none[i]), int(own[i]), int(h[i])) for i in close]
        at[close] = [bisect_right(starts, k) - 1 for k in keys]
        first = np.zeros(len(own), bool)
        first[close] = [starts[a] == k for a, k in zip(at[close].tolist(), keys, strict=True)]
        return pd.DataFrame({"_range": at.astype(np.int32), "_first": first})

    placed = docs.withColumn("_at", place(*_key(), "_hash"))
    last = F.lit(max(len(cuts.value) - 1, 0))
    before = F.when(F.col("_at._range") == 0, last).otherwise(F.col("_at._range") - 1)
    here, there = F.struct(F.col("_at._range").alias("_range"), F.lit(False).alias("_mark")), F.struct(before.alias("_range"), F.lit(True).alias("_mark"))
    return placed.withColumn("_to", F.explode(F.when(F.col("_at._first"), F.array(here, there)).otherwise(F.array(here)))).select("doc_id", "text", "_hash", "_to._range", "_to._mark")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs``: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    and the longest common extensions from the start, lce_edited and lce_next."""

    def run(batches):
        own, doc_id, place = None, None, None
        for batch in batches:
            rows = []
            for id_, text, range_, mark in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("_range").to_pylist(), batch.column("_mark").to_pylist(), strict=True):
                if mark and (own is None or range_ != place):
                    continue
                after = Print(text.as_py())
                if own is not None and range_ == place:
                    rows.append((doc_id, *compare(own, after)))
                own, doc_id, place = (None, None, range_) if mark else (after, id_, range_)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in _OUT.split(", ")])
        trim()

    order = ("_range", "_mark", F.col("doc_id").asc_nulls_last(), "_hash", "text")
    return _ranged(docs).repartition("_range").sortWithinPartitions(*order).mapInArrow(run, _OUT)
