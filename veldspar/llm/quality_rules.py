"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio, in DataFrame operations alone.

Every word and word pair of a text falls into one of BUCKETS hash buckets. Two smoothed multinomials over them are
summed from all documents: the raw corpus, and the trusted target (documents labelled good and not toxic). A document's
verdict is the mean log ratio of its n-grams against a threshold that is a fixed quantile of the scores of the trusted
documents that pass the base rules, so every document is decided alone and reruns agree. A trusted document's n-grams
are in the target, so its own score would be higher than that of an equally good unlabelled one: trusted documents fall
into FOLDS by a hash of the id, and each is scored by the target of the other folds. All trusted documents count: the
target's counts take one join of the texts with their ids, and each document is scored both ways, so that only scores
are joined with them then.

Defined results: null and empty texts have no words: all counts 0, base_failed, not kept; without labelled documents the
ratio is 0 everywhere and only the base rules decide; a document labelled both ways is not trusted, nor is one that any
label calls toxic; repeated rows count as often as they occur; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 14
SMOOTH = 1.0
WINDOW = 8
LEAST_WORDS = 20
SYMBOLS = "#*$%&|<>"
#: The share of trusted documents that pass the base rules (by score) that the threshold gives up.
QUANTILE = 0.001
FOLDS = 4


def word_array(text: Column) -> Column:
    """The words of a text: empty for null and for text without words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text.

    Windows are sorted with their places by hash; of equal neighbours both are marked, and the union of the marked
    windows is summed from their distances: n log n in the words, and only where a window repeats at all.
    """
    count = F.size(words) - (WINDOW - 1)
    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW)))))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, lambda p: let(_marked(p), _union)))

    return F.when(count >= 2, let(hashed, covered)).otherwise(F.lit(0)).cast("long")


def _marked(p: Column) -> Column:
    """Places, in order, of the entries of ``p`` whose hash a neighbour has too."""
    same = lambda x, i: F.coalesce(F.get(p, i)["h"] == x["h"], F.lit(False))
    flagged = F.transform(p, lambda x, i: F.struct(x["i"].alias("i"), (same(x, i + 1) | same(x, i - 1)).alias("on")))
    return F.array_sort(F.transform(F.filter(flagged, lambda s: s["on"]), lambda s: s["i"]))


def _union(places: Column) -> Column:
    """Words that windows at these places cover."""
    step = lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last"))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step, lambda a: a["n"])


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(common.WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def measures(text: Column, words: Column) -> list[Column]:
    """The base statistics."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")
    plain = F.coalesce(text, F.lit(""))
    return [
        F.size(words).cast("long").alias("n_words"), F.length(bare).cast("long").alias("word_chars"),
        (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long").alias("n_symbols"), dup_lines(text).alias("n_dup_lines"), repeat_words(words).alias("n_repeat_words"),
    ]


def grams(words: Column) -> Column:
    """Buckets of the words and of the word pairs."""
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    pairs = lambda h: F.transform(F.slice(h, F.lit(2), F.size(h)), lambda x, i: bucket(F.get(h, i), x))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(F.transform(h, lambda x: bucket(x)), pairs(h)))


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of documents that all labels call good and none toxic."""
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("_toxic"))
    return told.where("_good = 1 AND _toxic = 0").select("_id")


def multinomials(marked: DataFrame) -> tuple[Column, list[int]]:
    """(words, fold) -> a literal array of BUCKETS log ratios for fold 0 (all trusted documents) and for each other fold
    (those of the rest), its size fixed; and the folds that have trusted documents outside them."""
    counted = marked.select(F.explode(grams(F.col("words"))).alias("bucket"), "fold").groupBy("bucket", "fold").agg(F.count("*").alias("n"))
    counts = [[0] * BUCKETS for _ in range(FOLDS + 1)]
    for r in counted.collect():  # BUCKETS * (FOLDS + 1) rows at most
        counts[r["fold"]][r["bucket"]] = r["n"]
    raw, every = [sum(c) for c in zip(*counts, strict=True)], [sum(c) for c in zip(*counts[1:], strict=True)]
    n_raw = sum(raw) + SMOOTH * BUCKETS
    apart = [f for f in range(1, FOLDS + 1) if sum(every) > sum(counts[f])]

    def ratios(fold: int) -> list[float]:
        target = [t - c for t, c in zip(every, counts[fold], strict=True)] if fold in apart else every
        n_target = sum(target) + SMOOTH * BUCKETS
        none = n_target == SMOOTH * BUCKETS
        return [0.0 if none else math.log((t + SMOOTH) / n_target) - math.log((n + SMOOTH) / n_raw) for t, n in zip(target, raw, strict=True)]

    return F.split(F.lit(",".join(f"{x:.6f}" for f in range(FOLDS + 1) for x in ratios(f))), ",").cast("array<double>"), apart


def threshold(scored: DataFrame, apart: list[int]) -> float:
    """The QUANTILE of the scores of the trusted documents that pass the base rules, down to the thousandth."""
    cells = scored.where(~F.col("base_failed") & F.col("fold").isin(apart)).groupBy(F.floor(F.col("llr") * 1000).cast("long").alias("at")).agg(F.count("*").alias("n")).orderBy("at").collect()  # a row for each thousandth
    due = QUANTILE * sum(r["n"] for r in cells)
    seen = 0
    for r in cells:
        seen += r["n"]
        if seen > due:
            return r["at"] / 1000
    return -math.inf


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base statistics, llr (mean log ratio of the n-grams), base_failed and kept of every row of (doc_id, text)."""
    good = trusted(labels).hint("merge")  # they grow with the corpus: never sent to all tasks
    d = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    fold = (1 + F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))).cast("int")  # of a trusted document
    marked = lambda rows, *kept: rows.join(good, rows["doc_id"] == good["_id"], "left").select(*kept, F.when(F.col("_id").isNull(), 0).otherwise(fold).alias("fold"))
    table, apart = multinomials(marked(d, "doc_id", "text").select(word_array(F.col("text")).alias("words"), "fold"))
    mean = lambda g, at: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, at + b)) / F.size(g)).otherwise(F.lit(0.0))
    both = let(grams(F.col("words")), lambda g: let(fold * BUCKETS, lambda at: F.array(mean(g, F.lit(0)), mean(g, at))))  # as a document that is not trusted, and as one that is
    measured = d.withColumn("words", word_array(F.col("text"))).select("doc_id", *measures(F.col("text"), F.col("words")), both.alias("llrs"))
    names = [c for c in measured.columns if c != "llrs"]
    llr = F.when(F.col("fold") == 0, F.get("llrs", F.lit(0))).otherwise(F.get("llrs", F.lit(1))).alias("llr")
    scored = common.stored(marked(measured, *names, "llrs").select(*names, "fold", llr), "quality-scores")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    return scored.withColumn("kept", ~failed & (F.col("llr") >= F.lit(threshold(scored, apart))))


def op7(spark, sf_dir: str) -> DataFrame:
    out = judge(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
