"""Near-duplicate documents by min-max hashing.

Each of ``PERMUTATIONS`` hash functions gives two signature values, the smallest and the largest hash of the
document's shingles, so half as many evaluations as values are made; both agree between two documents with a
probability equal to their Jaccard similarity. ``rows`` values make a band. Documents with equal shingle sets
are one class; a class stands for its copies from then on. In each bucket of a band its members meet the
bucket's smallest member, their pivot, and all members of a pivot's group are compared on their full shingle sets.
No pair is a row: a block gives at most one edge for each member.

A group that fits in a block is compared whole. A larger one is compared with its pivot first, in blocks that each
hold the pivot: members linked to it are of one component and need no comparison with each other, and one of them,
x, can be linked to a member y that isn't only if x lies as far from the pivot as y, less the largest distance of a
link (Jaccard distance is a metric). So those that aren't linked to the pivot are compared in blocks of bounded size
with each other and with the linked ones that lie far enough out; the rest is done.

Null or empty texts, and texts of white space only, have no shingles, are linked with nothing and keep
themselves. Fewer words than a shingle takes make one shingle. Rows that repeat an id with the same text count as
copies; with other texts they are of one component too, since links hold for the id. Rows without an id belong to
the component of the rows with the same shingles, if one of these has an id; else they have none and are kept. A table
without rows gives none. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NOT_SPACE, U64, components, gram_hashes, mix, new_path, removed, slices, trim, word_hashes, word_spans, written

BANDS = 30
BLOCK_MEMBERS, BLOCK_BYTES = 128, 24 << 20
#: Largest Bloom filter of the ids whose sets are compared; with more ids than it takes, texts are shuffled to them.
NEED_BITS = 1 << 26
_SLAB = 2048


def band_rows(threshold: float) -> int:
    """Values a band: as many as keep the chance that a pair at the threshold shares none of BANDS bands under 1e-5."""
    return max(r for r in range(1, 9) if r == 1 or (1 - threshold**r) ** BANDS < 1e-5)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    hashes = word_hashes(data, starts, ends)
    grams = gram_hashes(hashes, words)
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            yield gram_hashes(hashes[a:b], b - a)
        else:
            yield np.empty(0, U64)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(7)
    return random.integers(0, 1 << 63, (n, 1), dtype=np.uint64), random.integers(0, 1 << 62, (n, 1), dtype=np.uint64) * U64(2) + U64(1)


def min_max_signature(shingles: np.ndarray, flips: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """For each permutation its smallest and its largest value over the set."""
    low, high = np.full(len(flips), ~U64(0)), np.zeros(len(flips), U64)
    for at in range(0, len(shingles), 512):
        values = shingles[at : at + 512] ^ flips
        values *= odds
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def signatures(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands): set_key names the set, bands holds a hash for each band; null without shingles."""
    rows = band_rows(threshold)

    def run(batches):
        flips, odds = _permutations((BANDS * rows + 1) // 2)
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            for row, end, data, offsets in slices(batch, "text"):
                sizes, keys, bands = [], [], []
                for s in shingle_sets(data, offsets, words):
                    sizes.append(len(s))
                    if not len(s):
                        keys.append(None)
                        bands.append(None)
                        continue
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    grid = min_max_signature(s, flips, odds)[: BANDS * rows].reshape(BANDS, rows)
                    total = salt.copy()
                    for j in range(rows):
                        total = mix(total * U64(0x9E3779B97F4A7C15) + grid[:, j])
                    bands.append(total.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Two bits for each id."""
    h = mix(ids.view(np.uint64))
    return (np.stack([h, mix(h)]) & U64(bits - 1)).astype(np.int64)


def _bitmap(ids: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of up to NEED_BITS bits: tasks set bits, Spark ors the words, and the words come here."""
    bits = 1 << max(12, (16 * count).bit_length())

    def run(batches):
        for batch in batches:
            at = np.unique(_places(np.asarray(batch.column("rep")), bits))
            word, start = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(U64(1) << (at & 63).astype(np.uint64), start) if len(at) else np.empty(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "value"])

    got = ids.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits >> 6, U64)
    out[np.asarray(got["word"])] = np.asarray(got["value"]).view(np.uint64)
    return out


def _sets(docs: DataFrame, words: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """(rep, shingles) of the texts of ``docs`` (rep, text), of those whose id the bitmap passes if there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        held = shared.value
        for batch in batches:
            if held is not None:
                batch = batch.filter(pc.is_valid(batch.column("rep")))
                at = _places(np.asarray(batch.column("rep")).astype(np.int64), len(held) << 6)
                batch = batch.filter(pa.array(((held[at >> 6] >> (at & 63).astype(np.uint64)) & U64(1)).astype(bool).all(0)))
            for row, end, data, offsets in slices(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(data, offsets, words)]
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(row, end - row), pa.array(sets, pa.binary())], ["rep", "shingles"])
        trim()

    return docs.mapInArrow(run, "rep long, shingles binary")


def _forest(ids: list[int], linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """An edge from each member to the smallest id of its component; linked: a square boolean matrix."""
    left = np.ones(len(ids), bool)
    for i in np.argsort(ids, kind="stable"):
        if not left[i]:
            continue
        left[i], front = False, np.array([i])
        while len(front):
            front = np.flatnonzero(linked[front].any(0) & left)
            left[front] = False
            for j in front:
                yield ids[j], ids[i]


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from an incidence matrix over the shingles that two sets or more hold."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    names, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    column, owner = shared[inverse[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _SLAB):
        a, b = np.searchsorted(column, [low, low + _SLAB])
        grid = np.zeros((n, _SLAB), np.float32)
        grid[owner[a:b], column[a:b] - low] = 1
        out += grid @ grid.T
    return out


def block_edges(ids: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that join what is linked within the block (100 * intersection >= percent * union): a forest, not all pairs.

    sides: members of different sides only are compared, unless all have the same."""
    size = np.array([len(s) for s in sets], np.float64)
    if len(ids) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(max(ids), min(ids))] if 100 * both >= percent * (size.sum() - both) and ids[0] != ids[1] else []
    both = _overlaps(sets)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    if len(set(sides)) > 1:
        side = np.array(sides)
        linked &= side[:, None] != side[None, :]
    return list(_forest(ids, linked))


def _compared(dealt: DataFrame, docs: DataFrame, words: int, percent: int, repeats: bool) -> DataFrame:
    """(a, b, linked, n, far) of the members (pivot, low, high, rep, own) dealt out: the edges of blocks, and from
    blocks with high = -1 each member a with its pivot b, its size n and its distance, linked or not.

    repeats: whether ids occur more than once, so that equal sets of an id have to be made one."""
    need = dealt.select("rep").distinct()
    whole = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string"))
    count = need.count()
    if count * 16 <= NEED_BITS:
        sets = _sets(whole, words, _bitmap(need, count))  # the join below drops what the bitmap passes wrongly
    else:
        sets = _sets(whole.join(need, "rep", "left_semi"), words)
    sets = sets.filter(F.octet_length("shingles") > 0).distinct() if repeats else sets

    def run(batches):
        key, ids, sides, sets_ = None, [], [], []
        out: list[tuple] = []

        def close():
            if key is not None and key[2] < 0:
                pivot = sets_[0]
                for id_, s in zip(ids[1:], sets_[1:], strict=True):
                    if id_ == key[0] and key[1]:
                        continue  # another set of the pivot's id is a member of the first block only
                    both = len(np.intersect1d(pivot, s, assume_unique=True))
                    union = len(pivot) + len(s) - both
                    out.append((id_, key[0], 100 * both >= percent * union, len(s), 1 - both / union))
            elif len(ids) > 1:
                out.extend((a, b, True, None, None) for a, b in block_edges(ids, sides, sets_, percent))

        def rows():
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["a", "b", "linked", "n", "far"])

        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("pivot", "low", "high", "rep", "own")]
            for i, (pivot, low, high, rep_, own_) in enumerate(zip(*lists, strict=True)):
                if (pivot, low, high) != key:
                    close()
                    key, ids, sides, sets_ = (pivot, low, high), [], [], []
                ids.append(rep_)
                sides.append(own_)
                sets_.append(np.frombuffer(batch.column("shingles")[i].as_py(), U64))
            yield rows()
            out.clear()
        close()
        sets_ = []
        trim()
        yield rows()

    order = ["pivot", "low", "high", F.col("rep") != F.col("pivot"), *(["rep", F.xxhash64("shingles")] if repeats else [])]
    grouped = dealt.join(sets, "rep").repartition("pivot", "low", "high").sortWithinPartitions(*order)
    return grouped.select("pivot", "low", "high", "rep", "own", "shingles").mapInArrow(run, "a long, b long, linked boolean, n long, far double")


def _blocks(members, size) -> F.Column:
    """How many blocks hold so many members with so many shingles."""
    return F.greatest(F.ceil(members / F.lit(BLOCK_MEMBERS)), F.ceil(size * 8 / F.lit(BLOCK_BYTES)))


def links(docs: DataFrame, sig: DataFrame, words: int, threshold: float) -> tuple[DataFrame, list[str]]:
    """(a, b): edges between ids of classes of equal sets whose components are those of all links; and the paths of the
    tables that only they are read from. sig: signatures(), written."""
    spark, percent, paths = docs.sparkSession, round(100 * threshold), []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        paths.append(new_path(spark, tag))
        return written(df, tag, paths[-1])

    sound = sig.filter("set_key is not null")
    classes = sound.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    several = kept(sound.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1"), "several")
    repeats = not several.isEmpty()
    rep = sig.join(classes, ["set_key", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", F.explode("bands").alias("band"))
    rep = rep.filter("rep is not null").select("rep", "band", F.col("n_shingles").alias("n"))
    buckets = rep.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("members")).filter("members > 1")
    met = kept(rep.join(buckets, "band").groupBy("pivot", "rep").agg(F.max("n").alias("n")), "met")
    # Written too: a pivot of many members meets its count in a join whose sides are plain exchanges and can be split.
    blocks = kept(met.groupBy("pivot").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks")), "blocks")
    whole = F.col("blocks") == 1
    every = F.expr("sequence(0L, blocks - 1)")
    lanes = F.when((F.col("rep") == F.col("pivot")) & ~whole, every).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("blocks"))))
    dealt = met.join(blocks, "pivot").select("pivot", "rep", F.lit(0).cast("long").alias("own"), F.explode(lanes).alias("low"), F.when(whole, 0).otherwise(-1).cast("long").alias("high"))
    found = kept(_compared(dealt, docs, words, percent, repeats), "found")
    edges = [found.filter("linked").select("a", "b")]

    met_pivot = found.filter("far is not null").groupBy(F.col("b").alias("pivot"), F.col("a").alias("rep")).agg(F.max("far").alias("far"), F.bool_and("linked").alias("linked"), F.max("n").alias("n"))
    least = kept(found.filter("not linked").groupBy(F.col("b").alias("pivot")).agg((F.min("far") - (100 - percent) / 100 - 1e-9).alias("least")), "least")
    if not least.isEmpty():
        left = kept(met_pivot.join(least, "pivot").filter("not linked or far >= least").select("pivot", "rep", "linked", "n"), "left")
        side = lambda c: F.coalesce(_blocks(F.count_if(c), F.sum(F.when(c, F.col("n")))), F.lit(0))
        counts = kept(left.groupBy("pivot").agg(side(~F.col("linked")).alias("free"), side(F.col("linked")).alias("held")), "counts")
        own = F.when(F.col("linked"), F.col("free") + F.pmod(F.xxhash64("rep"), F.col("held"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("free")))
        lanes = F.expr("transform(sequence(0L, if(linked, free, free + held) - 1), x -> struct(least(x, own) as low, greatest(x, own) as high))")
        again = left.join(counts, "pivot").withColumn("own", own).select("pivot", "rep", "own", F.explode(lanes).alias("at")).select("pivot", "rep", "own", "at.low", "at.high")
        edges.append(kept(_compared(again, docs, words, percent, repeats), "rest").select("a", "b"))
    if repeats:
        of = sound.select("doc_id", "set_key").join(several, "doc_id", "left_semi").distinct()
        edges.append(of.join(classes.withColumnRenamed("doc_id", "rep"), "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    return reduce(DataFrame.unionAll, edges), paths


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    sig = written(signatures(docs, words, threshold), "signatures")
    edges, paths = links(docs, sig, words, threshold)
    found = components(edges)
    for path in paths:
        removed(docs.sparkSession, path)
    rep = sig.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    # Written, so that both sides of the last join are plain exchanges and the rows of a hot set can be split over tasks.
    named = written(rep.join(found, rep["rep"] == found["id"], "left").select("set_key", F.coalesce("component", "rep").alias("component")), "classes")
    out = sig.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
