"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key -ln(u)/w, u fixed by its id and w its quality weight; a source's documents are
taken in key order until the prefix sum of their sizes reaches what its complete epochs leave of the target. Only the
histogram cell of keys in which the budget falls is sorted: sums of all other cells decide for their whole cell, so no
task ever holds a source. DataFrame operations throughout.

Defined results: null or empty text has size 0 and takes 0; a null source is a source of its own, last in order;
repeated rows draw the same key and are taken one by one; an empty table gives no rows; extra columns are never read (the
pipeline stage carries them along).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
SYMBOLS = "#*$%&|<>"
CELLS = 1 << 12


def key(doc_id: Column, weight: Column) -> Column:
    """Exponential key: 52 bits of md5 of the id as u in (0, 1)."""
    u = (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> also target. One row a source.

    Sources are capped at ``most`` times their size in order of cap over weight; a source is capped while its cap is
    below its share of what the sources before it leave, and everyone after the first uncapped one shares the rest.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole, before = Window.partitionBy(), by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("rest_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("rest") / F.col("rest_w"))
    s = s.withColumn("free", F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level")))
    level = F.first("free", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return s.select("source", "source_size", F.coalesce(level * F.col("w"), F.col("cap").cast("double")).alias("target"))


def quality(text: Column) -> Column:
    """Quality weight of a text: a quarter for one with a symbol in every 50 characters or more, else 1."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(symbols * 50 > F.length(text), 0.25).otherwise(1.0)


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with size, the key and its histogram cell; reads source, text and doc_id."""
    d = docs.withColumn("size", F.coalesce(F.regexp_count(docs["text"], F.lit(common.WORD)), F.lit(0)).cast("long"))
    d = d.withColumn("_key", key(docs["doc_id"], quality(docs["text"])))
    return d.withColumn("_cell", F.floor((1 - F.exp(-F.col("_key"))) * CELLS).cast("int"))


def mix(d: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """What sized() gives, with source_size, target, taken and copies.

    Read two or three times, so its rows should be cheap to make again or stored.
    """
    cells = d.groupBy("source", "_cell").agg(F.sum("size").alias("_in"))
    cells = common.stored(cells, "mix-cells")
    goal = targets(cells.groupBy("source").agg(F.sum("_in").alias("source_size")), weights, most)
    goal = goal.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("_left", F.col("target") - F.col("_epochs") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_to", F.sum("_in").over(run))
    cells = cells.withColumnRenamed("source", "_s").join(goal, F.col("_s").eqNullSafe(goal["source"])).drop("_s")
    # the cell where the prefix sum reaches the budget
    cut = cells.where("_to - _in < _left AND _to >= _left").groupBy("source").agg(F.min("_cell").alias("_cut"), F.min(F.struct("_cell", (F.col("_to") - F.col("_in")).alias("v")))["v"].alias("_before"))
    goal = common.stored(goal.withColumnRenamed("source", "_s").join(cut.withColumnRenamed("source", "_s2"), F.col("_s").eqNullSafe(F.col("_s2")), "left").drop("_s2"), "mix-goal")
    j = d.join(F.broadcast(goal) if goal.count() <= 100_000 else goal, d["source"].eqNullSafe(goal["_s"])).drop("_s")
    sure = j.where("_cut IS NULL OR _cell <> _cut").withColumn("_more", F.when((F.col("_left") > 0) & (F.col("_cut").isNull() | (F.col("_cell") < F.col("_cut"))), 1).otherwise(0))
    order = Window.partitionBy("source").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    close = j.where("_cell = _cut").withColumn("_more", F.when(F.col("_before") + F.sum("size").over(order) - F.col("size") / 2 <= F.col("_left"), 1).otherwise(0))
    out = sure.unionByName(close)
    out = out.withColumn("taken", F.col("size") * (F.col("_epochs") + F.col("_more")))
    return out.withColumn("copies", (F.col("_epochs") + F.col("_more")).cast("int")).drop("_key", "_cell", "_epochs", "_left", "_cut", "_before", "_more")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "text")
    out = mix(common.stored(sized(docs).drop("text"), "mix-sizes"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
        -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r}::DOUBLE)
        / CASE WHEN (length(text) - length(translate(text, '{SYMBOLS}', ''))) * 50 > length(text) THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS k
      FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM r
      WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(first_value(CASE WHEN cap >= level * w THEN level END IGNORE NULLS)
        OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * w, cap::DOUBLE) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
c AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest,
        sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS run
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + more))::BIGINT AS taken, source, (epochs + more)::INT AS copies
FROM (SELECT *, CASE WHEN rest > 0 AND run - size / 2 <= rest THEN 1 ELSE 0 END AS more FROM c)
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, over the words of this stage's input."""
    packed = docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    taken = mix(sized(packed).drop("text")).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")
