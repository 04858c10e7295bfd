"""URL filters by a cascade of Bloom filters.

The list holds domains; a host is listed if it or a domain above it is. So the corpus's key universe is every host of
the pages and every domain above one. The first level holds the listed keys; the second those other keys of the
universe that the first takes for listed; the third the listed ones that the second takes for its own; and so on until
a level is wrong on nothing. The number of levels that take a key, up to the first that doesn't, then tells exactly for
every key of the universe whether it is listed. Only the keys that the first level takes are held against the list when
the cascade is built; no page is joined with it.

The keys are cut by a hash of their last two labels, which a host shares with all domains above it but the topmost, into
as many shards as keep a level near ``LEVEL_BYTES``; listed top domains are in every shard. A domain of two labels with
very many listed ones below it makes the levels of its shard larger, up to 16 times that bound, beyond which building
fails. Spark sets the bits of a level for all shards at once. A cascade of one shard is gathered and broadcast, and the pages are scanned once. One
of several shards stays a table: pages and bits are dealt out together by shard, hot shards over as many tasks as they
need, and read past each other in one pass. In no case is there a scan or a job a shard.

Hosts and paths are read as the contract says; a null url, or one without ``://``, has both empty and is judged by
the empty host, which no list holds. Rules of equal length go by their order. Every row gives a row, repeated ones and
those without an id each their own; extra columns are ignored; a table without rows gives none. Null and empty domains
in a list are ignored, and its repeats count once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm.common import U64, mix, new_path, written

LEVEL_BYTES, LEVELS, TASK_PAGES = 8 << 20, 64, 2_000_000
#: Fixed values: (verdict, host, path) of the rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def parts(url) -> tuple[Column, Column]:
    """(host, path) of a url column."""
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    has = url.isNotNull() & (F.instr(url, "://") > 0)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def under(host, domain: str) -> Column:
    return (host == domain) | host.endswith("." + domain)


def rule(host, path, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; of equal lengths the first."""
    name = verdict = None
    for kind, domain, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = under(host, domain) & path.startswith(start)
        name = F.when(fits, domain + start) if name is None else name.when(fits, domain + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


def _positions(keys: np.ndarray, level: int, probes: int, bits: int) -> np.ndarray:
    """Bit numbers of each key in a level, one row a probe."""
    seeds = np.arange(1, probes + 1, dtype=np.uint64)[:, None] + U64(level * 64)
    return (mix(keys[None, :] + mix(seeds * U64(0x9E3779B97F4A7C15))) % U64(bits)).astype(np.int64)


class Cascade:
    """Levels of (bits as words, number of bits, probes), the first of which has a number."""

    def __init__(self, first: int = 0):
        self.first = first
        self.levels: list[tuple[np.ndarray, int, int]] = []

    def takes(self, keys: np.ndarray, level: int) -> np.ndarray:
        words, bits, probes = self.levels[level]
        at = _positions(keys, self.first + level, probes, bits)
        return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & U64(1)).astype(bool).all(0)

    def depth(self, keys: np.ndarray) -> np.ndarray:
        """Levels in a row that take each key."""
        out, left = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        for level in range(len(self.levels)):
            left &= self.takes(keys, level)
            out += left
        return out

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Listed keys are taken by an odd number of levels in a row."""
        return self.depth(keys) % 2 == 1


def domains(host) -> Column:
    """The host and all domains above it, but for empty ones."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.filter(above, lambda d: d != "")


def _key(domain) -> Column:
    return F.xxhash64(domain)


def _shard(domain, shards: int) -> Column:
    """By the last two labels."""
    return F.pmod(F.xxhash64(F.substring_index(domain, ".", -2), F.lit(9)), F.lit(shards)).cast("int")


def _bits(keys: DataFrame, level: int, sizes: dict[int, tuple[int, int]], path: str) -> DataFrame:
    """(shard, level, word, value) of a level of all shards, written: tasks set their keys' bits, Spark ors the words."""
    held = keys.sparkSession.sparkContext.broadcast(sizes)

    def run(batches):
        for batch in batches:
            shard, key = np.asarray(batch.column("shard")), np.asarray(batch.column("key")).view(np.uint64)
            for s in np.unique(shard):
                bits, probes = held.value[int(s)]
                at = np.unique(_positions(key[shard == s], level, probes, bits))
                word, start = np.unique(at >> 6, return_index=True)
                value = np.bitwise_or.reduceat(U64(1) << (at & 63).astype(np.uint64), start) if len(at) else np.empty(0, U64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), s, np.int32)), pa.array(word), pa.array(value.view(np.int64))], ["shard", "word", "value"])

    found = keys.select("shard", "key").mapInArrow(run, "shard int, word long, value long")
    return written(found.groupBy("shard", "word").agg(F.bit_or("value").alias("value")).select("shard", F.lit(level).alias("level"), "word", "value"), "bits", path)


def _probed(rows: DataFrame, bits: DataFrame, sizes: list[dict[int, tuple[int, int]]], first: int, judge, fields: str) -> DataFrame:
    """``judge(cascade, batch)`` of batches of ``rows`` (shard, ...) with the levels from ``first`` on of their shard."""
    spark, names = rows.sparkSession, rows.columns
    shards = {s for level in sizes for s in level}

    def blank(shard: int) -> Cascade:
        cascade = Cascade(first)
        for held in sizes:
            n, probes = held.get(shard, (64, 1))
            cascade.levels.append((np.zeros((n + 63) // 64, U64), n, probes))
        return cascade

    if shards <= {0}:
        cascade, got = blank(0), bits.toArrow()
        level, word, value = (np.asarray(got.column(c)) for c in ("level", "word", "value"))
        for i, (words, _, _) in enumerate(cascade.levels):
            words[word[level == i + first]] = value[level == i + first].view(np.uint64)
        shared = spark.sparkContext.broadcast(cascade)
        return rows.mapInArrow(lambda batches: (judge(shared.value, b) for b in batches), fields)

    # Bits and rows of a shard lie together, the bits first; a shard with many rows is dealt out over several tasks.
    counts = written(rows.groupBy("shard").agg(F.ceil(F.count("*") / TASK_PAGES).alias("tasks")), "tasks")
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    dealt = rows.join(counts, "shard").select("shard", F.pmod(F.xxhash64(row), F.col("tasks")).alias("task"), row.alias("row"), F.lit(None).cast("struct<level:int,word:long,value:long>").alias("bit"))
    spread = bits.join(counts, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), F.lit(None).cast(dealt.schema["row"].dataType).alias("row"), F.struct("level", "word", "value").alias("bit"))
    kinds = pa.schema([(f.name, t.type) for f, t in zip(rows.schema, to_arrow_schema(rows.schema), strict=True)])

    def run(batches):
        shard, cascade = None, Cascade()
        for batch in batches:
            at = np.asarray(batch.column("shard"))
            ends = [*(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for low, high in zip([0, *ends], ends, strict=False):
                part = batch.slice(low, high - low)
                if int(at[low]) != shard:
                    shard = int(at[low])
                    cascade = blank(shard)
                bit = part.filter(part.column("bit").is_valid()).column("bit").flatten()
                level, word, value = (np.asarray(c) for c in bit)
                for i in np.unique(level):
                    cascade.levels[i - first][0][word[level == i]] = value[level == i].view(np.uint64)
                own = part.filter(part.column("row").is_valid()).column("row")
                if len(own):
                    yield judge(cascade, pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(own.flatten(), kinds.types, strict=True)], names=names))

    together = spread.unionByName(dealt).repartition("shard", "task").sortWithinPartitions("shard", "task", F.col("bit").isNull())
    return together.mapInArrow(run, fields)


class Built:
    """A cascade as a table of bits, and the sizes of its levels by shard."""

    def __init__(self, shards: int):
        self.shards, self.sizes, self.levels = shards, [], []

    def bits(self) -> DataFrame:
        return reduce(DataFrame.unionAll, self.levels)

    def judged(self, rows: DataFrame, judge, fields: str) -> DataFrame:
        return _probed(rows, self.bits(), self.sizes, 0, judge, fields)


def _of_all(table_: DataFrame, shards: int) -> DataFrame:
    """(shard, key) of domains; one of a single label is in every shard."""
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    own = F.when(F.instr("domain", ".") == 0, every).otherwise(F.array(_shard(F.col("domain"), shards)))
    return table_.select(F.explode(own).alias("shard"), _key(F.col("domain")).alias("key"))


def built(universe: DataFrame, listed: DataFrame, shards: int | None = None) -> Built:
    """The cascade of a list (domain) over a universe (domain) of distinct keys. Without shards, as many as levels need."""
    spark = universe.sparkSession
    listed = listed.filter("domain <> ''").select("domain").distinct()
    shards = shards or 1 + int(listed.count() * 24 // (8 * LEVEL_BYTES))
    given = written(_of_all(listed, shards).distinct(), "listed")
    others = written(_of_all(universe, shards).distinct(), "universe")
    out = Built(shards)
    counts = {r["shard"]: r["count"] for r in given.groupBy("shard").count().collect()}
    against = {r["shard"]: r["count"] for r in others.groupBy("shard").count().collect()}
    sides, level = [given, others], 0
    while counts:
        if level >= LEVELS:
            raise RuntimeError("two keys of different kinds can't be told apart")
        sizes = {}
        for shard, n in counts.items():
            rate = min(0.5, max(1e-6, n / max(1, against.get(shard, 0)) * 0.5**0.5)) if not level else 0.5
            probes = max(1, round(-np.log2(rate)))
            sizes[shard] = max(64, int(np.ceil(n * probes / np.log(2)))), probes
        if max(n for n, _ in sizes.values()) > LEVEL_BYTES << 7:  # so many listed domains below one of two labels
            raise ValueError("a level of a shard is over its bound")
        bits = _bits(sides[level % 2], level, sizes, new_path(spark, "bits"))
        out.sizes.append(sizes)
        out.levels.append(bits)
        other = sides[(level + 1) % 2]
        taken = _probed(other.filter(F.col("shard").isin(list(sizes))), bits, [sizes], level, _taken, "shard int, key long")
        if not level:
            taken = taken.join(given, ["shard", "key"], "left_anti")  # what the list itself holds isn't wrong
        wrong = written(taken, "wrong")
        sides[(level + 1) % 2] = wrong
        counts = {r["shard"]: r["count"] for r in wrong.groupBy("shard").count().collect()}
        level += 1
    return out


def _taken(cascade: Cascade, batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pa.array(cascade.takes(np.asarray(batch.column("key")).view(np.uint64), 0)))


def _blocked(cascade: Cascade, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with whether any of a row's keys is held, for its keys."""
    keys = batch.column("keys")
    offsets, values = np.asarray(keys.offsets), np.asarray(keys.values).view(np.uint64)
    total = np.concatenate([[0], np.cumsum(cascade.holds(values))])
    return batch.drop_columns(["keys", "shard"]).append_column("held", pa.array(total[offsets[1:]] > total[offsets[:-1]]))


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, shards: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``: the rule's verdict, else block for hosts that are
    listed or lie below a listed domain, else allow. listed: (domain)."""
    host, path = parts(F.col("url"))
    found = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).select("page_id", host.alias("host"), path.alias("path"))
    universe = found.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("domain")).distinct()
    cascade = built(universe, listed, shards)
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    ruled = found.withColumn("rule", name).withColumn("ruled", verdict)
    if cascade.levels:
        keys = F.transform(domains(F.col("host")), _key)
        ruled = ruled.withColumn("shard", _shard(F.col("host"), cascade.shards)).withColumn("keys", keys)
        ruled = cascade.judged(ruled, _blocked, "page_id long, host string, path string, rule string, ruled string, held boolean")
    else:
        ruled = ruled.withColumn("held", F.lit(False))
    return ruled.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("held"), "block").otherwise("allow")).alias("verdict"))
