"""Token ids in a binary format, compressed by Re-Pair grammars.

Documents are range-partitioned by id and encoded in order. Every partition writes shards of about SHARD_IDS ids. A shard
is compressed by itself: frequent adjacent pairs become nonterminals, round by round, until no pair is frequent enough
(FREQUENT occurrences in the shard; rarer pairs would save little more than their rules take).

Format: Parquet files written by Spark's own committed writer, one row a shard, with little-endian arrays:

======== ============================================================
part     partition, in id order
shard    number of the shard in its partition
first    ids of the partition before this shard
n_ids    ids of the shard, end ids included
doc_ids  int64 ids of its documents (doc_null: a byte each, 1 for a null id)
doc_lens int32 ids of each document
left     uint32 first symbol of each rule; symbol BASE + k is rule k
right    uint32 second symbol
rule_len uint32 ids a rule expands to
seq      uint32 the compressed sequence
======== ============================================================

With rule_len any id can be found without expanding what is before it: see ``decode_range``. No rule reaches over the end
of a document.

Defined results: null and empty texts are the end id alone; null document ids come first; equal ids follow each other in
the order of their text hash; an empty table writes no shard and reads no row; extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .suffix_dedup import Hashes

TOKENIZER = "byte_bpe_50k.json"
END = 2
BASE = 1 << 20
SHARD_IDS = 1 << 19
#: A pair becomes a rule with so many occurrences at least in a shard, if it can then be used WORTH times.
FREQUENT, WORTH = 24, 4
CELLS = 1 << 20
#: Pieces whose ids a Python worker remembers; it starts anew beyond that. Longer pieces are not cut out of their text.
REMEMBERED, LONGEST = 1_500_000, 64
#: Pieces given to the library in a row.
IN_ROW = 64
#: Characters encoded at a time, if a text is not longer.
CHUNK = 1 << 22

FORMAT = "part int, shard int, first long, n_ids long, doc_ids binary, doc_null binary, doc_lens binary, left binary, right binary, rule_len binary, seq binary"


#: Kinds of bytes: white space, ASCII letters, ASCII digits, the apostrophe, other ASCII, all others.
_WHITE, _LETTER, _DIGIT, _QUOTE, _OTHER, _HIGH = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*b"\t\n\v\f\r "]] = _WHITE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[[*range(0x30, 0x3A)]] = _DIGIT
_KIND[0x27] = _QUOTE
_KIND[0x80:] = _HIGH
#: Whether the pre-tokenizer parts a byte of the first kind from a next one of the second, whatever stands around them.
_PARTS = np.zeros((6, 6), bool)
_PARTS[:, _WHITE] = True
_PARTS[_LETTER, [_DIGIT, _QUOTE, _OTHER]] = True
_PARTS[_DIGIT, [_LETTER, _QUOTE, _OTHER]] = True
_PARTS[_OTHER, [_LETTER, _DIGIT]] = True
_PARTS = _PARTS.ravel()


def _uncut(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places in texts that go to the library whole: white space in a row, white space beyond ASCII, NUL, "<|"."""
    if len(data) < 3:
        return np.flatnonzero((data == 0) | (kind == _HIGH) | (kind == _WHITE))
    x, y = data[:-1], data[1:]
    odd = ((kind[:-1] == _WHITE) & (kind[1:] == _WHITE)) | ((x == 0x3C) & (y == 0x7C)) | ((x == 0xC2) & ((y == 0x85) | (y == 0xA0)))
    odd |= (x == 0) | (y == 0)
    at = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
    a, b, c = data[at], data[at + 1], data[at + 2]
    wide = ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return np.concatenate((np.flatnonzero(odd), at[wide]))


class Encoder:
    """The tokenizer's ids of whole texts.

    Texts are cut where the pre-tokenizer parts them whatever stands around: before and after white space (a space stays
    with what follows) and between ASCII letters, digits and other signs. The library encodes every distinct piece once
    and its ids are remembered by a 64-bit hash of the piece. Texts with white space in a row, or with what may be a
    special token, and those with very long pieces go to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size()
        self.starts = np.fromiter(((self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(n)), bool, n)
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _rows(self, pieces: list[str], space: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, given to the library in rows, and how many each has: at their first spaces, or at a line break after each, it parts them."""
        between = "" if space else "\n"
        got = self._encode([between.join(pieces[k : k + IN_ROW]) + between for k in range(0, len(pieces), IN_ROW)])
        ids = np.fromiter(chain.from_iterable(got), np.uint32)
        at = np.flatnonzero(self.starts[ids] if space else ids == self.line[0])
        if len(at) == len(pieces) and (not space or at[0] == 0):
            return (ids, np.diff(at, append=len(ids))) if space else (np.delete(ids, at), np.diff(at, prepend=-1) - 1)
        return self._each(pieces)

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self._encode(pieces)
        return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, p in enumerate(pieces):
            kinds[0 if p[0] == " " and len(p) > 1 else 2 if p.isspace() or len(self.line) != 1 else 1].append(i)
        for kind, some in enumerate(kinds):
            if not some:
                continue
            own = [pieces[i] for i in some]
            ids, size = self._each(own) if kind == 2 else self._rows(own, kind == 0)
            first = len(self.size)
            self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(size) - size))
            self.size, self.ids = np.concatenate((self.size, size)), np.concatenate((self.ids, ids))
            self.known.update(zip((hashes[i] for i in some), range(first, first + len(some)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        kind = _KIND[data]
        whole = set(np.searchsorted(ends, _uncut(data, kind), "right").tolist())
        # a piece starts where the kind changes, at white space and after white space other than a space
        first = np.zeros(len(data) + 1, bool)
        if len(data):
            first[1:-1] = _PARTS[kind[:-1] * 6 + kind[1:]] | ((kind[:-1] == _WHITE) & (data[:-1] != 0x20))
        first[0], first[ends] = len(data) > 0, True
        cuts = np.flatnonzero(first)
        start, end = cuts[:-1], cuts[1:]
        text = np.searchsorted(ends, start, "right")
        whole.update(text[end - start > LONGEST].tolist())
        if whole:
            good = ~np.isin(text, list(whole))
            start, end, text = start[good], end[good], text[good]
        value, at, inverse = np.unique(Hashes(data).of(start, end) + (end - start).astype(np.uint64), return_index=True, return_inverse=True)
        if len(self.known) + len(value) > REMEMBERED:
            self.forget()
        names = value.tolist()
        new = [i for i, h in enumerate(names) if h not in self.known]
        if new:
            joined = data.tobytes()
            self._learn([names[i] for i in new], [joined[a:b].decode("utf-8", "replace") for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
        number = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[inverse]
        size = self.size[number]
        to = np.cumsum(size)
        flat = self.ids[np.arange(int(size.sum())) + np.repeat(self.at[number] - (to - size), size)]
        pieces = np.searchsorted(text, np.arange(len(texts) + 1))
        edge = np.concatenate(([0], to))[pieces]
        out = [flat[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        some = sorted(i for i in whole if i < len(texts))
        for i, got in zip(some, self._encode([texts[i] for i in some]), strict=True):
            out[i] = np.array(got, np.uint32)
        return out


#: The encoder of a Python worker, which Spark uses for many tasks.
_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds, until no pair is frequent -> (left, right, rule_len, seq).

    A round replaces all frequent pairs at once; of overlapping occurrences every other one, from the left. From then on
    only pairs with a new symbol, and what overlaps kept from its turn, can be frequent, so only those are counted again.
    """
    seq = ids.astype(np.uint32)
    left, right, size = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    at = np.flatnonzero(seq[:-1] != END)  # no rule goes over the end of a document
    while len(at) >= FREQUENT:
        code = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        cell = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        many = (np.bincount(cell, minlength=CELLS) >= FREQUENT)[cell]  # only cells that can hold a frequent pair are sorted
        at, code = at[many], code[many]
        value, pair, n = np.unique(code, return_inverse=True, return_counts=True)
        often = (n >= FREQUENT)[pair]
        at, pair = at[often], pair[often]
        nth = np.arange(len(at))
        take = (nth - np.maximum.accumulate(np.where(np.concatenate(([True], at[1:] != at[:-1] + 1))[: len(at)], nth, 0))) % 2 == 0
        worth = np.bincount(pair[take], minlength=len(value)) >= WORTH
        take &= worth[pair]
        if not take.any():
            break
        used = np.flatnonzero(worth)
        number = np.zeros(len(value), np.uint32)
        number[used] = BASE + len(left) + np.arange(len(used), dtype=np.uint32)
        a, b = (value[used] >> np.uint64(32)).astype(np.uint32), value[used].astype(np.uint32)
        wide = lambda s, size=size: np.where(s < BASE, 1, np.concatenate((size, np.ones(1, np.uint32)))[np.minimum(s - np.minimum(s, BASE), len(size))])
        left, right, size = np.concatenate((left, a)), np.concatenate((right, b)), np.concatenate((size, (wide(a) + wide(b)).astype(np.uint32)))
        to = at[take]
        seq[to] = number[pair[take]]
        keep = np.ones(len(seq), bool)
        keep[to + 1] = False
        place = np.cumsum(keep) - 1
        waiting = at[~take & worth[pair]]
        again = np.zeros(len(place) + 1, bool)
        seq = seq[keep]
        again[place[to]] = again[place[waiting[keep[waiting]]]] = True
        again[place[to[to > 0]] - 1] = True
        at = np.flatnonzero(again[: len(seq) - 1])
        at = at[seq[at] != END]
    return left, right, size, seq


def expand(left: np.ndarray, right: np.ndarray, size: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """All ids of a compressed sequence: every symbol's place is known by its length, so each pass opens only the rules left."""

    def wide(s: np.ndarray) -> np.ndarray:
        out = np.ones(len(s), np.int64)
        rule = s >= BASE
        out[rule] = size[s[rule] - BASE]
        return out

    n = wide(seq)
    to = np.cumsum(n)
    out, symbol, place = np.empty(int(n.sum()), np.uint32), seq, to - n
    while len(symbol):
        rule = symbol >= BASE
        out[place[~rule]] = symbol[~rule]
        k, at = symbol[rule] - BASE, place[rule]
        symbol, place = np.concatenate((left[k], right[k])), np.concatenate((at, at + wide(left[k])))
    return out


def decode_range(left: np.ndarray, right: np.ndarray, size: np.ndarray, seq: np.ndarray, start: int, end: int) -> np.ndarray:
    """Ids start to end of a shard: only the symbols that overlap the range are opened."""
    wide = np.where(seq < BASE, 1, size[np.maximum(seq.astype(np.int64) - BASE, 0)] if len(size) else 1)
    to = np.cumsum(wide)
    a, b = np.searchsorted(to, start, "right"), np.searchsorted(to, end, "left") + 1
    before = int(to[a - 1]) if a else 0
    return expand(left, right, size, seq[a:b])[start - before : end - before]


def _writer(path: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(path)
        part = TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        names: list[int] = []
        null: list[bool] = []
        held, first, shard = 0, 0, 0

        def flush() -> pd.DataFrame:
            left, right, size, seq = compress(np.concatenate(ids))
            return pd.DataFrame([{
                "part": part, "shard": shard, "first": first, "n_ids": held,
                "doc_ids": np.array(names, "<i8").tobytes(), "doc_null": np.array(null, np.uint8).tobytes(), "doc_lens": np.array([len(x) for x in ids], "<i4").tobytes(),
                "left": left.astype("<u4").tobytes(), "right": right.astype("<u4").tobytes(), "rule_len": size.astype("<u4").tobytes(), "seq": seq.astype("<u4").tobytes(),
            }])

        end = np.array([END], np.uint32)
        for batch in batches:
            bytes_before = np.cumsum(batch["text"].str.len().to_numpy()) // CHUNK
            for b in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(bytes_before)) + 1):
                b = batch.iloc[b]
                for i, missing, got in zip(b["id"].tolist(), b["missing"].tolist(), encoder.encode(b["text"].tolist()), strict=True):
                    ids.append(np.concatenate((got, end)))
                    names.append(i)
                    null.append(missing)
                    held += len(ids[-1])
                    if held >= SHARD_IDS:
                        yield flush()
                        ids, names, null = [], [], []
                        first, shard, held = first + held, shard + 1, 0
        if ids:
            yield flush()

    return write


def write(docs: DataFrame, path: str, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode all of ``docs`` in ascending id order into shards under ``path``."""
    common.bounded_batches(docs.sparkSession)
    t = common.text_or_empty(docs, text)
    rows = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(0)).alias("id"), docs[doc_id].isNull().alias("missing"), t.alias("text"), F.xxhash64(t).alias("h"))
    by = [F.col("missing").desc(), "id", "h"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    rows.select("id", "missing", "text").mapInPandas(_writer(tokenizer or public_tokenizers.path(TOKENIZER)), FORMAT).write.parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards under ``path``, with start: the ids of all shards before."""
    rows = spark.read.schema(FORMAT).parquet(path)
    # one row a partition
    ends = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.select(F.col("part").alias("p"), F.coalesce("before", F.lit(0)).alias("before"))
    return rows.join(F.broadcast(ends), rows["part"] == ends["p"]).withColumn("start", F.col("before") + F.col("first")).drop("p", "before")


def arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """left, right, rule_len and seq of a shard's row."""
    return tuple(np.frombuffer(row[c], "<u4") for c in ("left", "right", "rule_len", "seq"))


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.to_dict("records"):
            ids = expand(*arrays(row)).astype("<u4")
            lens = np.frombuffer(row["doc_lens"], "<i4").astype(np.int64)
            to = np.cumsum(lens)
            raw = ids.tobytes()
            yield pd.DataFrame({
                "doc_id": pd.array(np.frombuffer(row["doc_ids"], "<i8"), "Int64").copy(), "start": row["start"] + to - lens, "n_tokens": lens,
                "ids_crc32": [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(to.tolist(), lens.tolist(), strict=True)],
                "shard_symbols": len(row["seq"]) // 4, "shard_rules": len(row["left"]) // 4,
            }).assign(doc_id=lambda d, null=row["doc_null"]: d["doc_id"].mask(np.frombuffer(null, np.uint8) == 1))


def op1(spark, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "op1-ids")
    write(common.documents(spark, sf_dir), path)
    return shards(spark, path).mapInPandas(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long, shard_symbols long, shard_rules long")
