"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of tokens.

A source's target is its share of all tokens by weight, at most ``CAP`` times its own tokens; what it can't take is
shared again among the others by weight. A source is cut into shards, by a seeded hash of ids and texts, of about
``SHARD_TOKENS`` tokens; each shard is a line of its documents, in seeded order, cut into equal blocks of about
``BLOCK`` tokens. All blocks go to sources by highest quotients votes / (2 n + 1), with the targets as votes; each
source's go to its districts of ``DISTRICT`` shards, and each district's to its shards, with their blocks as votes. A
shard takes all its blocks as often as its quota goes into them, and for the rest a run of blocks from a seeded start
on, round the end of the line; a document takes what of it lies in the run, at most CAP times its size. So all
documents but those at the two ends of a run are taken whole or not.

Only tables with one row a source, one row a district of one source, or one row a shard of one district, are gathered
in one place; documents are dealt by source and shard, so a hot source is spread over its shards.

A null text has no tokens and takes none. A null source is a source, the last in order. Rows that repeat an id, or
have none, are each taken from; those with one id and one text lie in one shard and are interchangeable. A table
without tokens has targets of 0. Other columns pass through ``mixed``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import written

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP, BLOCK, SHARD_TOKENS, DISTRICT, SEED = (5, 2, 1), 3, 16, 1_000_000, 1_000, 17


def n_tokens(text) -> F.Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def filled(sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Targets that share the sum of sizes by weight, where none is over CAP times its size."""
    most, free = CAP * sizes.astype(np.float64), np.ones(len(sizes), bool)
    while True:
        level = (float(sizes.sum()) - most[~free].sum()) / weights[free].sum() if free.any() else 0.0
        over = free & (weights * level > most)
        if not over.any():
            return np.where(free, weights * level, most)
        free &= ~over


def apportioned(votes: np.ndarray, most: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 n + 1), ties to the first, at most ``most`` each.

    At the price 1 / (2 t) a party has won floor(votes t + 1 / 2) seats; bisection finds the last price at which no
    more than ``seats`` are won, and what is left, because quotients tie, goes by the quotients themselves."""
    votes, most = votes.astype(np.float64), np.where(votes > 0, most, 0).astype(np.int64)
    seats = int(min(seats, most.sum()))
    won = lambda t: np.minimum(np.floor(votes * t + 0.5), most).astype(np.int64)
    low, high = 0.0, 1.0
    while won(high).sum() < seats:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if won(middle).sum() <= seats else (low, middle)
    out = won(low)
    while (short := seats - int(out.sum())) > 0:
        quotient = np.where(out < most, votes / (2 * out + 1), -1.0)
        out[np.argsort(-quotient, kind="stable")[:short]] += 1
        out = np.minimum(out, most)
    return out


def _blocks(tokens: np.ndarray) -> np.ndarray:
    """Blocks of ``tokens``: as near to BLOCK as a whole number of equal ones allows."""
    return np.maximum((tokens + BLOCK // 2) // BLOCK, tokens > 0).astype(np.int64)


def _goals(frame: pd.DataFrame) -> pd.DataFrame:
    names = frame["source"]
    order = sorted(range(len(frame)), key=lambda i: (pd.isna(names.iloc[i]), "" if pd.isna(names.iloc[i]) else names.iloc[i]))
    out = frame.iloc[order].reset_index(drop=True)
    sizes = out["source_size"].to_numpy(np.int64)
    weights = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(out))], np.float64)
    out["target"] = filled(sizes, weights)
    out["quota"] = apportioned(out["target"].to_numpy(), CAP * _blocks(sizes), round(int(sizes.sum()) / BLOCK))
    out["shards"] = np.maximum(-(-sizes // SHARD_TOKENS), 1)
    return out[["source", "source_size", "target", "quota", "shards"]]


def _dealt(frame: pd.DataFrame, part: str) -> pd.DataFrame:
    """Quotas of the parts (districts or shards) of one whole, whose quota each row holds as ``quota``."""
    out = frame.sort_values(part, ignore_index=True)
    out["quota"] = apportioned(out["blocks"].to_numpy(np.float64), CAP * out["blocks"].to_numpy(np.int64), int(out["quota"].iloc[0]))
    return out


def planned(sized: DataFrame, slim: DataFrame) -> DataFrame:
    """``sized`` (doc_id, source, size, mark and more) with source_size, target, _start, _tokens, _blocks, _quota and _first.

    slim: the same rows with three of these columns only, written, from which sources and shards are counted."""
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = written(sources.groupBy().applyInPandas(_goals, "source string, source_size long, target double, quota long, shards long"), "goals")
    goals = goals.withColumnRenamed("source", "_of").withColumnRenamed("quota", "_all")

    def sharded(df: DataFrame) -> DataFrame:
        out = df.join(goals, df["source"].eqNullSafe(goals["_of"])).drop("_of")
        return out.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "mark", F.lit(SEED)), F.col("shards")))

    shards = sharded(slim).groupBy("source", F.col("_shard").alias("shard")).agg(F.sum("size").alias("tokens"), F.first("_all").alias("quota"))
    blocks = F.greatest((F.col("tokens") + BLOCK // 2).cast("long") / BLOCK, F.when(F.col("tokens") > 0, 1).otherwise(0)).cast("long")
    shards = written(shards.select("source", "shard", F.floor(F.col("shard") / DISTRICT).alias("district"), "tokens", blocks.alias("blocks"), "quota"), "shards")
    districts = shards.groupBy("source", "district").agg(F.sum("blocks").alias("blocks"), F.first("quota").alias("quota"))
    districts = districts.groupBy("source").applyInPandas(lambda f: _dealt(f, "district"), districts.schema)
    districts = districts.select(F.col("source").alias("_of"), F.col("district").alias("_at"), F.col("quota").alias("_given"))
    within = shards.join(districts, shards["source"].eqNullSafe(districts["_of"]) & (shards["district"] == districts["_at"]))
    within = within.select("source", "shard", "district", "tokens", "blocks", F.col("_given").alias("quota"))
    quotas = written(within.groupBy("source", "district").applyInPandas(lambda f: _dealt(f, "shard"), within.schema), "quotas")
    first = F.when(F.col("blocks") > 0, F.pmod(F.xxhash64("source", "shard"), F.col("blocks"))).otherwise(0)
    quotas = quotas.select(F.col("source").alias("_of"), F.col("shard").alias("_at"), F.col("tokens").alias("_tokens"), F.col("blocks").alias("_blocks"), F.col("quota").alias("_quota"), first.alias("_first"))
    line = Window.partitionBy("source", "_shard").orderBy(F.xxhash64("doc_id", "mark", F.lit(SEED + 1)), "doc_id", "size", "mark")
    placed = sharded(sized).withColumn("_start", F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.drop("_all", "shards").join(quotas, placed["source"].eqNullSafe(quotas["_of"]) & (placed["_shard"] == quotas["_at"])).drop("_of", "_at")


#: SQL: whole rounds; the run of chosen blocks beyond them, as stretches of the line's words, the second one round its end.
ROUNDS = "if(size = 0, 0L, _quota div _blocks)"
_END = "(_first + _quota % _blocks)"
_STRETCHES = (("_first * _tokens div _blocks", f"least({_END}, _blocks) * _tokens div _blocks"), ("0L", f"greatest({_END} - _blocks, 0L) * _tokens div _blocks"))
#: SQL: what of a document lies in either stretch, as (words before it in the document, words).
PIECES = [f"if(size = 0, struct(0L as skip, 0L as words), struct(greatest({low} - _start, 0L) as skip, greatest(least(_start + size, {high}) - greatest(_start, {low}), 0L) as words))" for low, high in _STRETCHES]
EXTRA = " + ".join(f"{p}.words" for p in PIECES)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark), written; mark tells rows that share an id and a size apart."""
    size = n_tokens(F.col("text")).alias("size")
    return written(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size, F.xxhash64(F.col("text").cast("string")).alias("mark")), "sizes")


def shares(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``."""
    slim = sizes(docs)
    taken = F.expr(f"{ROUNDS} * size + {EXTRA}")
    return planned(slim, slim).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once for each round in which it is taken whole, and once
    for each stretch of its words that is taken beyond these, as it stands in the text, white space included."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    text = F.col("text").cast("string")
    sized = docs.select(row, text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens(text).alias("size"), F.xxhash64(text).alias("mark"))
    plan = planned(sized, sizes(docs)).withColumn("_pieces", F.expr(f"filter(array({', '.join(PIECES)}), p -> p.words > 0)"))
    whole = F.expr(f"transform(sequence(1L, {ROUNDS} + 1), n -> struct(0L as skip, size as words))")
    copies = F.concat(F.expr("slice(whole, 1, size(whole) - 1)"), F.col("_pieces"))
    out = plan.withColumn("whole", whole).withColumn("_copy", F.explode(copies))
    part = F.expr(f"rtrim(' \t\n\r\f\x0b', array_join(slice(regexp_extract_all(text, r'({WORDS}[\x20\x09-\x0D]*)', 1), cast(_copy.skip + 1 as int), cast(_copy.words as int)), ''))")
    out = out.withColumn("text", F.when(F.col("_copy.words") == F.col("size"), F.col("text")).otherwise(part))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*[new.get(f.name, F.col("_row")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema])
