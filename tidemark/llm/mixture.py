"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Blocks of ``block_words`` words are given to sources by highest quotients target / (2k + 1), then in
each source to its shards by shard size. A shard lays its documents out in a seeded order and
repeats that stream ``max_repeats`` times; its quota of consecutive blocks is taken from a seeded
start, cyclically. So no word is taken more often than ``max_repeats`` times, and none is repeated
before the shard's whole stream was used. Only the last block of a shard that gives all its words can
be short; the words that a source so lacks are handed to its shards with room, so every source is
within a block of its target.

At scale: one pass over the texts leaves a slim table (id, source, size). A source's number of shards
grows with the square root of its own words, so both a shard's rows and a source's list of shards stay
small beside the corpus. Documents without words, which no block can hold, are spread by the corpus's
words; documents without an id, or of one id, are spread by their texts.
The driver holds one entry for each source, which is the mixture's own configuration.

Cases: null text has size 0; null source is a source of its own, ordered last; repeated rows are
documents of their own, laid side by side; an empty table gives no rows; a source without words has target 0 and takes 0.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import WORD, only, place_of
from tidemark.sources.shared import written


def targets(sizes: list[int], weights: list[float], max_repeats: int) -> list[float]:
    """Words for each source: all sizes shared by weight, none above ``max_repeats`` times its size, the excess reshared."""
    out, active, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > max_repeats * sizes[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(max_repeats * sizes[i])
        left -= sum(out[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return out


def apportion(weights: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Laguë with caps: ``seats`` to the highest quotients weight / (2k + 1), ties to the first.

    A divisor that gives almost all seats at once is found by bisection, the rest go one by one.
    """
    w, caps = np.asarray(weights, float), np.where(np.asarray(weights, float) > 0, np.asarray(caps, np.int64), 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(w), np.int64)

    def given(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(np.minimum(w / divisor, 1e18) / 2 + 0.5), caps).astype(np.int64)

    low, high = w[w > 0].min() / (2.0 * caps.max() + 2), w.max() * 2.0 + 1
    while given(low).sum() < seats:
        low /= 2
    for _ in range(200):
        if (mid := (low + high) / 2) in (low, high):
            break
        low, high = (low, mid) if given(mid).sum() <= seats else (mid, high)
    out = given(high)
    heap = [(-w[i] / (2 * out[i] + 1), i) for i in np.flatnonzero(out < caps)]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-w[i] / (2 * out[i] + 1), i))
    return out


def mix(docs: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, block_words: int = 16, seed: int = 42) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, source): size, source_size, target of its source, and taken words.

    Sources in order of code points, null last, have the weights of ``cycle``, repeated.
    """
    rows = only(docs, doc_id="long", text="string", source="string")
    return _planned(rows, cycle, max_repeats, block_words, seed).drop("_digest")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs``, all columns, with size, source_size, target and taken of ``mix`` (whose parameters ``how`` are) at the end; a name that ``docs`` has gets ``mix_`` before it.

    The plan is joined back by id, source and a digest of the text; equal rows are told apart by number.
    """
    taken = {c.lower() for c in docs.columns}
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own = lambda name: F.col(f"c{place_of(docs, name)}")
    keys = {"_id": own("doc_id").cast("long"), "_source": own("source").cast("string"), "_text": _digest(own("text").cast("string"))}
    plain = plain.withColumns(keys)
    plan = written(_planned(only(docs, doc_id="long", text="string", source="string"), **how), "mix")
    plan = plan.withColumnsRenamed({"doc_id": "_id", "source": "_source", "_digest": "_text"})
    same = ["_id", "_source", "_text"]
    if not plan.groupBy(*same).count().where("count > 1").isEmpty():
        number = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
        plain, plan, same = plain.withColumn("_n", number), plan.withColumn("_n", number), [*same, "_n"]
    new = ["size", "source_size", "target", "taken"]
    plan = plan.select(*(F.col(c).alias(f"p{c}") for c in same), *new)
    meet = F.lit(True)
    for c in same:
        meet = meet & plain[c].eqNullSafe(plan[f"p{c}"])
    names = [f"mix_{c}" if c in taken else c for c in new]
    return plain.join(plan, meet).select(*(f"c{i}" for i in range(len(docs.columns))), *new).toDF(*docs.columns, *names)


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _planned(rows: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, block_words: int = 16, seed: int = 42) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = written(rows.select("doc_id", "source", size.alias("size"), _digest(F.col("text")).alias("_digest")), "sizes")
    slim = slim.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    by_source = {r._key: r.n or 0 for r in slim.groupBy("_key").agg(F.sum("size").alias("n")).collect()}
    keys = sorted(by_source, key=lambda k: (k == "n", k))
    sizes = [by_source[k] for k in keys]
    goal = targets(sizes, [cycle[i % len(cycle)] for i in range(len(keys))], max_repeats)
    shards = rows.sparkSession.createDataFrame([(k, max(1, math.isqrt(n // 1024))) for k, n in by_source.items()], "_key string, _shards long")
    # documents without words take nothing anywhere, so they are spread by the corpus's words
    spread = F.when(F.col("size") > 0, F.col("_shards")).otherwise(max(1, math.isqrt(sum(sizes) // 1024)))
    spot = F.xxhash64(F.lit(seed), "doc_id", "_digest")
    placed = slim.join(F.broadcast(shards), "_key").withColumn("_shard", F.pmod(spot, spread).cast("int")).drop("_shards")
    by_shard = placed.groupBy("_key", "_shard").agg(F.sum("size").alias("n"))
    # a shard's last block may be shorter than the others, so a source has room for max_repeats times its words
    room = {r._key: r.n for r in by_shard.groupBy("_key").agg(F.sum(F.expr(f"({max_repeats} * n + {block_words - 1}) div {block_words}")).alias("n")).collect()}
    quota = apportion(np.array(goal), np.array([room[k] for k in keys], np.int64), round(sum(sizes) / block_words)) if keys else []
    plan = {k: (int(q), n, t) for k, q, n, t in zip(keys, quota, sizes, goal)}

    def to_shards(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_shard", ignore_index=True)
        q, n, t = plan[group["_key"].iloc[0]]
        size = group["n"].to_numpy(np.int64)
        most = max_repeats * size
        blocks = apportion(size.astype(float), -(-most // block_words), q)
        words = np.minimum(blocks * block_words, most)
        # what short last blocks left over is handed out to shards with room, first by number, so that the source's words are within a block of its target
        spare = most - words
        lack = max(0, min(int(round(t)) - int(words.sum()), int(spare.sum())))
        before = np.cumsum(spare) - spare
        return group.assign(_words=words + np.clip(lack - before, 0, spare), source_size=n, target=t)

    quotas = by_shard.groupBy("_key").applyInPandas(to_shards, "_key string, _shard int, n long, _words long, source_size long, target double")
    order = Window.partitionBy("_key", "_shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "_digest"), "doc_id", "_digest", "size")
    laid = placed.join(quotas, ["_key", "_shard"]).withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def overlap(a: str, b: str) -> str:
        return f"greatest(0, least(_end, {b}) - greatest(_end - size, {a}))"

    laid = laid.withColumn("_first", F.expr(f"CASE WHEN n > 0 THEN (pmod(xxhash64({seed}, _key, _shard), greatest(1, n div {block_words})) * {block_words}) ELSE 0 END"))
    laid = laid.withColumn("_rest", F.expr("CASE WHEN n > 0 THEN _words % n ELSE 0 END"))
    taken = f"CASE WHEN n > 0 THEN (_words div n) * size + {overlap('_first', 'least(_first + _rest, n)')} + {overlap('0', '_first + _rest - n')} ELSE 0 END"
    return laid.select("doc_id", "source", "size", "source_size", "target", F.expr(taken).cast("long").alias("taken"), "_digest")
