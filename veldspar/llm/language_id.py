"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram bucket counts per language in Spark (all training documents, no cap); the log-probability matrix
has ``languages * 3 * 2**BITS`` floats, a size fixed by the parameters, and is broadcast. Scoring looks up the rows of
whole Arrow batches in numpy. Beyond ``MAX_LANGUAGES`` the languages come in blocks, and a row keeps its best language
and the sum over all blocks so far.

Defined results: null text, empty text and text without a letter give ``und`` with score 0; a row whose language or
text is null trains nothing; with no training row at all every document is ``und``; ties go to the language first by
code point; repeated rows count as often as they occur; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 15
ORDERS = (1, 2, 3)
#: Languages in one matrix (100 MB at most); a table with more is scored by one block of languages after the other.
MAX_LANGUAGES = 256
UNDETERMINED = "und"
#: Characters handled at a time inside a task.
BLOCK = 1 << 18
LETTER = regex.compile(r"\p{L}")


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: bucket of each position, and the first and end position of each text."""
    code = np.frombuffer("".join(texts).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # lower() can lengthen a text (U+0130), so lengths are those of the lowered texts
    ends = np.cumsum(np.fromiter((len(t) if t.isascii() else len(t.lower()) for t in texts), np.int64, len(texts)))
    starts = np.concatenate(([0], ends[:-1]))
    state = np.zeros(len(code), np.uint32)
    for k, order in enumerate(ORDERS):
        state = state[: len(code) - order + 1] * np.uint32(0x01000193) + code[order - 1 :] * np.uint32(0x9E3779B1) if len(code) >= order else state[:0]
        mixed = state ^ (state >> np.uint32(15))
        yield ((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int64) + (k << BITS), starts, np.maximum(ends - order + 1, starts)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    width = len(ORDERS) << BITS
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for lang, group in batch.groupby("lang", sort=False):
            texts = group["text"].tolist()
            docs[lang] = docs.get(lang, 0) + len(texts)
            mine = sums.setdefault(lang, np.zeros(width, np.int64))
            for a, b in _blocks(texts):
                for bucket, starts, ends in _buckets(texts[a:b]):
                    inside = np.zeros(len(bucket) + 1, np.int8)
                    # a text shorter than the order has no n-gram; others own [start, end)
                    owned = ends > starts
                    np.add.at(inside, starts[owned], 1)
                    np.add.at(inside, ends[owned], -1)
                    mine += np.bincount(bucket[np.cumsum(inside[:-1]) > 0], minlength=width)
            if len(sums) >= MAX_LANGUAGES:
                yield from _told(sums, docs)
    yield from _told(sums, docs)


def _told(sums: dict[str, np.ndarray], docs: dict[str, int]) -> Iterator[pd.DataFrame]:
    """The counts so far, which are then forgotten; bucket -1 has the documents."""
    while sums:
        lang, mine = sums.popitem()
        at = np.flatnonzero(mine)
        yield pd.DataFrame({"lang": lang, "bucket": np.concatenate(([-1], at)), "n": np.concatenate(([docs.pop(lang)], mine[at]))})


class Model:
    """Languages in code point order, and per bucket the log probability under each."""

    def __init__(self, langs: list[str], prior: np.ndarray, weights: np.ndarray):
        self.langs, self.prior, self.weights = langs, prior, weights

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.tile(self.prior, (len(texts), 1))
        for a, b in _blocks(texts):
            for bucket, starts, ends in _buckets(texts[a:b]):
                for k in range(len(self.langs)):
                    run = np.concatenate(([0.0], np.cumsum(self.weights[k].take(bucket), dtype=np.float64)))
                    end = np.minimum(ends, len(bucket))
                    out[a:b, k] += np.where(end > starts, run[end] - run[np.minimum(starts, len(bucket))], 0.0)
        return out

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        """Best language, its log probability and that of all languages together; null without a letter."""
        known = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)] if self.langs else []
        pred, top, total = np.full(len(texts), None, object), np.full(len(texts), np.nan), np.full(len(texts), np.nan)
        if known:
            values = self.score([texts.iloc[i] for i in known])
            top[known] = values.max(axis=1)
            pred[known] = np.array(self.langs, object)[values.argmax(axis=1)]
            total[known] = top[known] + np.log(np.exp(values - top[known][:, None]).sum(axis=1))
        return pd.DataFrame({"lang": pred, "top": top, "total": total})


def count(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) of all rows of (text, lang) without a null."""
    common.bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(langs: list[str], got: pd.DataFrame) -> Model:
    width = len(ORDERS) << BITS
    prior, weights = np.zeros(len(langs)), np.zeros((len(langs), width), np.float32)
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        table = np.zeros(width)
        real = own["bucket"] >= 0
        table[own["bucket"][real]] = own["n"][real]
        for o in range(len(ORDERS)):
            part = slice(o << BITS, (o + 1) << BITS)
            weights[k, part] = np.log((table[part] + 0.5) / (table[part].sum() + 0.5 * (1 << BITS)))
        prior[k] = np.log(own["n"][~real].sum())
    return Model(langs, prior, weights)


def blocks(counts: DataFrame) -> Iterator[Model]:
    """Models of up to MAX_LANGUAGES languages in code point order; the first has none if nothing was learnt."""
    heads, last = counts.where("bucket = -1"), None
    while True:
        left = heads if last is None else heads.where(F.col("lang") > last)
        langs = [r["lang"] for r in left.orderBy("lang").limit(MAX_LANGUAGES).select("lang").collect()]
        if langs or last is None:
            yield fit(langs, counts.where(F.col("lang").isin(langs)).toPandas())  # at most MAX_LANGUAGES * 3 * 2**BITS rows
        if len(langs) < MAX_LANGUAGES:
            return
        last = langs[-1]


def scorer(docs: DataFrame, model: Model):
    """A column function: text -> struct(lang, top, total)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(texts)

    return F.pandas_udf(predict, "lang string, top double, total double")


def _better(old: Column, new: Column) -> Column:
    """Of two blocks the better language (the former in a tie) and the log of the summed probabilities."""
    wins = new["top"] > old["top"]
    total = F.greatest(old["total"], new["total"]) + F.log1p(F.exp(-F.abs(old["total"] - new["total"])))
    return F.struct(F.when(wins, new["lang"]).otherwise(old["lang"]).alias("lang"), F.greatest(old["top"], new["top"]).alias("top"), total.alias("total"))


def predicted(docs: DataFrame, labelled: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``name`` of lang_pred and score, learnt from ``labelled``."""
    out = docs
    for k, model in enumerate(blocks(common.stored(count(labelled), "language_counts"))):
        if k:  # what the blocks before gave is written, so that a task holds one matrix
            out = common.stored(out, "language_blocks")
        new = scorer(out, model)(out[text].cast("string"))
        out = out.withColumn(name, _better(out[name], new) if k else new)
    got = out[name]
    known = got["lang"].isNotNull()
    return out.withColumn(name, F.struct(F.coalesce(got["lang"], F.lit(UNDETERMINED)).alias("lang_pred"), F.when(known, F.least(F.exp(got["top"] - got["total"]), F.lit(1.0))).otherwise(0.0).alias("score")))


def identify(docs: DataFrame, held_out: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with a struct column ``predicted``; learns from the rows where ``held_out`` is false."""
    return predicted(docs, docs.where(~held_out).select(docs[text].alias("text"), docs[lang].alias("lang")), common.fresh(docs, "predicted"), text)


def held_out(docs: DataFrame) -> Column:
    """The contract's fold; a null id is in neither part, so it trains nothing and is not held out."""
    return common.remainder(docs["doc_id"], 3) == 1


def op8(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = identify(docs, held_out(docs))
    return out.select("doc_id", F.coalesce(held_out(out), F.lit(False)).alias("held_out"), "predicted.lang_pred", "predicted.score")


def stage(spark, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: drops documents without a language (``und``) or with a posterior under ``least``."""
    mark = common.fresh(docs, "predicted")
    out = predicted(docs, docs.where(~held_out(docs)).select("text", "lang"), mark)
    kept = out.where((F.col(f"{mark}.lang_pred") != UNDETERMINED) & (F.col(f"{mark}.score") >= least))
    return kept.select(*[kept[c] for c in docs.columns])
