"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton of a block of items (at most BLOCK_WORDS words, so what is broadcast is bounded) is built once; document
words are streamed through it, which gives at each word the longest match that ends there. A document is cleaned by
removing the spans that windows cover, or dropped when they cover too much of it. More items make more blocks, each a
pass over the texts that adds to the spans found before.

Only stretches whose word pairs all occur in some item can hold a window, so the automaton is walked there alone.

Defined results: null and empty texts have no words and no hits; an item without words (null, empty) has no window; an
item given twice counts once, by its id as a string (a null id is the string "null"); an empty benchmark hits nothing;
repeated documents give repeated rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
BLOCK_WORDS = 200_000
#: 20 * hit words >= words: contaminated.
COVER = 20
MASK = (1 << 20) - 1
#: Upper case to lower case, and every byte outside 0-9, a-z and UTF-8's multi-byte range to a space.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


class Automaton:
    """Generalised suffix automaton over word ids, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        owner: list[set[str]] = [set()]
        ends: list[tuple[int, str, int]] = []
        pairs = np.zeros(MASK + 1, bool)
        self.least = window
        for item, ws in items:
            if not ws:
                continue
            codes = [self.ids.setdefault(w, len(self.ids)) for w in ws]
            self.least = min(self.least, len(codes))
            a = np.array(codes, np.int64)
            pairs[self._pair(a[:-1], a[1:])] = True
            state = 0
            for c in codes:
                state = self._extend(state, c, owner)
            ends.append((state, item, len(codes)))
            state = 0
            for c in codes:  # every state on the suffix path of a prefix occurs in the item
                state = self.next[state][c]
                s = state
                while s > 0 and item not in owner[s]:
                    owner[s].add(item)
                    s = self.link[s]
        self.pairs = pairs
        #: state -> its ancestor (or itself) that holds the suffix of `window` words, where there is one
        n = len(self.next)
        self.full = [-1] * n
        self.short: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for state, item, size in ends:
            if size < window:
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                self.short[state].append((size, item))
        self.has_short = [False] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            self.has_short[s] = bool(self.short[s]) or self.has_short[up]
            if self.length[s] >= window:
                self.full[s] = s if self.length[up] < window else self.full[up]
        self.owner = [sorted(owner[s]) if self.full[s] == s else [] for s in range(n)]

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7_919) & MASK

    def _extend(self, last: int, c: int, owner: list[set[str]]) -> int:
        nxt, length, link = self.next, self.length, self.link
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q, owner)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        owner.append(set())
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q, owner)
        return cur

    def _clone(self, p: int, c: int, q: int, owner: list[set[str]]) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        owner.append(set(owner[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) word ranges that windows cover, and the items they come from."""
        found: set[str] = set()
        spans: list[tuple[int, int]] = []
        if not self.ids or len(ws) < self.least:
            return spans, found
        code = np.fromiter(map(self.ids.get, ws, itertools.repeat(-1)), np.int64, len(ws))
        known = code >= 0
        good = known[:-1] & known[1:]
        good &= self.pairs[self._pair(code[:-1], code[1:])]
        # stretches of known words joined by good pairs
        cut = np.flatnonzero(~good) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(ws)]))
        long = (ends - starts >= self.least) & known[starts]
        nxt, length, link, full = self.next, self.length, self.link, self.full
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            state, matched = 0, 0
            for i, c in enumerate(code[a:b].tolist(), a + 1):
                while state and c not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                state = nxt[state].get(c, 0)
                matched = matched + 1 if state else 0
                if matched >= self.window and full[state] >= 0:
                    spans.append((i - self.window, i))
                    found.update(self.owner[full[state]])
                s = state
                while s > 0 and self.has_short[s]:
                    for size, item in self.short[s]:
                        if size <= matched:
                            spans.append((i - size, i))
                            found.add(item)
                    s = link[s]
        return merged(spans), found


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(bench: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about BLOCK_WORDS words; one block at a time is on the driver."""
    rows = bench.select(F.coalesce(bench[item_id].cast("string"), F.lit("null")).alias("item"), bench[text].cast("string").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // (4 * BLOCK_WORDS)
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).distinct().sort("item", "text").collect()
        yield [(r["item"], words(r["text"])) for r in got]


def _finder(shared):
    def find(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        counts, spans, names = [], [], []
        for t, old, had in zip(texts, before["spans"], before["items"], strict=True):
            ws = words(t)
            got, who = shared.value.hits(ws)
            if len(old):
                got = merged([*got, *zip(old[::2].tolist(), old[1::2].tolist(), strict=True)])
            counts.append(len(ws))
            spans.append([x for s in got for x in s])
            names.append(sorted(who.union(had)))
        return pd.DataFrame({"n_words": counts, "spans": spans, "items": names})

    return F.pandas_udf(find, "n_words long, spans array<int>, items array<string>")


def matched(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> Column:
    """A struct column over ``docs``: n_words, spans (flat word positions start, end, start, end) and items."""
    common.bounded_batches(docs.sparkSession)
    found: Column = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for items in blocks(bench, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(items, window))
        found = _finder(shared)(docs[text].cast("string"), found)
    return found


def n_hit(spans: Column) -> Column:
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(n_words: Column, hit: Column, cover: int = COVER) -> Column:
    return (hit > 0) & (cover * hit >= n_words)


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, s in zip(texts, spans, strict=True):
        if t is not None and len(s):
            raw = t.encode("utf-8", "surrogatepass")
            plain = np.frombuffer(raw.translate(TABLE), np.uint8) != 0x20
            edge = np.flatnonzero(np.diff(np.concatenate(([False], plain, [False])).astype(np.int8)))
            first, last = edge[::2], edge[1::2]
            keep, at = [], 0
            for a, b in zip(s[::2].tolist(), s[1::2].tolist(), strict=True):
                keep.append(raw[at : first[a]])
                at = last[b - 1]
            t = b"".join([*keep, raw[at:]]).decode("utf-8", "surrogatepass")
        out.append(t)
    return pd.Series(out, dtype=object)


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", cover: int = COVER) -> DataFrame:
    """``docs`` without the documents that windows cover to 1/``cover`` or more, and without the matched spans of the rest."""
    mark = common.fresh(docs, "found")
    d = docs.withColumn(mark, matched(docs, bench, text))
    left = d.where(~contaminated(F.col(f"{mark}.n_words"), n_hit(F.col(f"{mark}.spans")), cover))
    cut = F.pandas_udf(_cut, "string")
    return left.select(*[cut(left[c], F.col(f"{mark}.spans")).alias(c) if c == text else left[c] for c in docs.columns])


def op4(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = docs.select("doc_id", matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).alias("f"))
    hit = n_hit(F.col("f.spans"))
    return out.select(
        "doc_id", F.col("f.n_words").alias("n_words"), hit.alias("n_hit"), F.size("f.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("f.items"), ","), 256).alias("items_sha256"), contaminated(F.col("f.n_words"), hit).alias("contaminated"), F.col("f.spans").alias("spans"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops contaminated documents; the others stay as they are."""
    mark = common.fresh(docs, "found")
    d = docs.withColumn(mark, matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    left = d.where(~contaminated(F.col(f"{mark}.n_words"), n_hit(F.col(f"{mark}.spans"))))
    return left.select(*[left[c] for c in docs.columns])
