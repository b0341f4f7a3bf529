"""Sharding by sampled splitters.

A size-weighted sample of keys (text hash, id) gives quantile boundaries of many small ranges; ranges that turn out
overfull are subdivided by a sample of their own; exact byte sums of the ranges then place every record: the shard is
the fortieth (or n-th) of all bytes into which the middle of the record falls, in key order. Equal texts are neighbours
in that order, so they share a shard unless their group is larger than what the shard has left.

The law is ``bytes``: shard sizes differ from the mean by less than the largest record.

Defined results: null text has size 16 and crc32 0 (as the empty text); null ids order first; repeated rows are
neighbours in any order, which leaves the same set of rows; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 40
OVERHEAD = 16
#: Ranges a shard, and sampled keys a range: with these the sample has some 20,000 keys at any input size.
RANGES = 64
OVERSAMPLE = 8
#: A range is overfull beyond so many times its due, and is divided anew so many times at most.
OVERFULL = 4
ROUNDS = 4


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _sample(keyed: DataFrame, total: int, wanted: int) -> np.ndarray:
    """About ``wanted`` keys, each drawn with probability in proportion to its size (by a hash, so reruns agree)."""
    u = F.pmod(F.xxhash64("_b", "_a", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    got = keyed.where(u * float(total) < F.col("_size") * float(wanted)).select("_a", "_b").toPandas()
    return np.unique(got.to_numpy(np.int64).copy().view([("a", np.int64), ("b", np.int64)]).ravel()) if len(got) else np.zeros(0, [("a", np.int64), ("b", np.int64)])


def _spread(keys: np.ndarray, n: int) -> np.ndarray:
    """n - 1 boundaries at even steps through the sorted sample."""
    return keys[np.unique(np.linspace(0, len(keys), n + 1).astype(int)[1:-1])] if len(keys) > 1 else keys


def ranged(keyed: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Adds _range, the number of splitters that are not above the key."""
    shared = keyed.sparkSession.sparkContext.broadcast(splitters)

    def find(a: pd.Series, b: pd.Series) -> pd.Series:
        cut = shared.value
        key = a.to_numpy(np.int64)
        low, high = np.searchsorted(cut["a"], key, "left"), np.searchsorted(cut["a"], key, "right")
        tied = np.flatnonzero(low < high)
        if len(tied):
            ids = b.to_numpy(np.int64)
            for lo in np.unique(low[tied]):
                own = tied[low[tied] == lo]
                low[own] = lo + np.searchsorted(cut["b"][lo : high[own[0]]], ids[own], "right")
        return pd.Series(low)

    return keyed.withColumn("_range", F.pandas_udf(find, "int")("_a", "_b"))


def shard(docs: DataFrame, n_shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", extra: list[Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the ``extra`` columns of every row of ``docs``."""
    t = docs[text].cast("string")
    keyed = docs.select(
        docs[doc_id].alias("doc_id"), record_size(t).alias("_size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("_a"), F.coalesce(docs[doc_id].cast("long"), F.lit(-(1 << 63))).alias("_b"), *(extra or []),
    )
    names = keyed.columns[5:]
    if not extra:
        keyed = common.stored(keyed, "shard-keys")
    total, rows = keyed.agg(F.sum("_size"), F.count("*")).first()
    if not rows:
        return keyed.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), *names)
    n = n_shards * RANGES
    cut = _spread(_sample(keyed, total, n * OVERSAMPLE), n)
    for _ in range(ROUNDS):
        placed = ranged(keyed, cut)
        sums = placed.groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows"), F.max("_size").alias("most")).toPandas().sort_values("_range")
        over = sums[(sums["bytes"] > OVERFULL * total / n) & (sums["rows"] > 1) & (sums["bytes"] > 2 * sums["most"])]
        if over.empty:
            break
        inside = placed.where(F.col("_range").isin(over["_range"].tolist()))
        more = np.unique(np.concatenate([cut, _sample(inside, int(over["bytes"].sum()), OVERSAMPLE * max(2 * len(over), int(over["bytes"].sum() * n / total)))]))
        if len(more) == len(cut):
            break  # only equal keys are left
        cut = more
    # exact offsets of the ranges: as many rows as there are ranges
    sums = ranged(keyed, cut).groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows")).toPandas().sort_values("_range")
    offsets = pd.DataFrame({"_range": sums["_range"], "_to": sums["bytes"].cumsum() - sums["bytes"], "_row": sums["rows"].cumsum() - sums["rows"]})
    table = F.broadcast(docs.sparkSession.createDataFrame(offsets.astype({"_range": "int32", "_to": "int64", "_row": "int64"}), "_range int, _to long, _row long"))
    order = Window.partitionBy("_range").orderBy("_a", "_b", "_size").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged(keyed, cut).withColumn("_end", F.sum("_size").over(order)).withColumn("_nth", F.count("*").over(order)).join(table, "_range")
    middle = F.col("_to") + F.col("_end") - F.col("_size") / 2
    out = out.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / float(total))).cast("int")).withColumn("_nth", F.col("_row") + F.col("_nth") - 1)
    out = common.stored(out, "shards")
    first = F.broadcast(out.groupBy("shard").agg(F.min("_nth").alias("_first")))
    out = out.join(first, "shard")
    return out.select("doc_id", F.col("_size").alias("size"), "text_crc32", "shard", (F.col("_nth") - F.col("_first")).alias("slot"), *names)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: all columns of the input and each row's shard and slot."""
    names = [common.fresh(docs, "shard"), common.fresh(docs, "slot")]
    out = shard(docs, extra=[F.struct(*[docs[c] for c in docs.columns]).alias("_doc")])
    return out.select("_doc.*", F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))
