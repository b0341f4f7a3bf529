"""Exact removal of repeated byte strings by external induced sorting of sampled suffixes.

A string of LENGTH bytes that starts at two places is found as follows, and in the same pass every string of PASSAGE bytes.

1. Sampling. Of the SPAN + 1 grams of GRAM bytes in a string's first PASSAGE bytes the one with the least hash is its
   anchor, so equal strings have equal anchors at equal offsets. An anchor owns the run of string starts that chose it,
   and about one byte in eighty-six is an anchor. Suffix tuples (gram hash, text, place, owned run) go through Spark's spilling sorts,
   which are the disk-backed queues here; only tuples whose gram occurs elsewhere go on.
2. Anchors with equal grams and equal owned bytes are one class: if a class has two places, all of its owned strings
   repeat. Copies of any number are thereby settled with partial aggregates.
3. Classes that share a gram are sorted externally by what follows the anchor, and the common prefixes of neighbours are
   taken. From that order the order of the suffixes one byte further left is induced, again and again: a stable
   distribution by the preceding byte, the common prefix growing by one where it is equal and taking the least of the
   values between. An anchor's string at offset l repeats where a neighbour's common prefix reaches LENGTH (or PASSAGE).
   Grams with more than CROWD classes are not held in a task: their owned strings are counted by hash instead.

Texts are worked on once for each distinct text (64-bit hash); a text that is there twice repeats in full.

What is removed are the strings of LENGTH bytes. Runs of repeated strings of PASSAGE bytes that have more than WORDS words
are counted as passages and stay.

Defined results: null and empty texts have no bytes; texts under LENGTH bytes keep them all; matches never cross rows;
repeated rows are copies of each other and lose everything (if LENGTH bytes or more); an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 400
#: Strings of this length are told too: a passage of over WORDS words has rarely less.
PASSAGE, WORDS = 280, 50
GRAM = 110
SPAN = PASSAGE - GRAM
CHUNK = 1 << 20
#: Tuples induced at a time in a task, and classes of one gram beyond which strings are counted by hash.
HELD = 20_000
CROWD = 50_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20_240_101).integers(0, 1 << 64, 256, np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(20, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_ODD, _INV))
    return _powers[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any substrings of a byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        return _mix((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` keys in a row, by running minima of blocks."""
    n = len(keys) - width + 1
    full = np.concatenate((keys, np.full(-len(keys) % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    head = np.minimum.accumulate(full, axis=1).ravel()
    tail = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def anchors(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchors of texts of PASSAGE bytes or more -> (text number, place, first and last owned start, end of the owned bytes, gram, their hash)."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(lens)
    h = Hashes(data)
    gram = h.grams(GRAM)
    place = np.uint64(int(len(gram)).bit_length())
    keys = ((gram >> place) << place) | np.arange(len(gram), dtype=np.uint64)  # on a tie the first place
    least = (_least(keys, SPAN + 1) & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(raw)), lens)[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + PASSAGE <= ends[text])
    least, text = least[starts], text[starts]
    new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((new[1:], [len(starts)])) - 1
    s, e, pos, text = starts[new], starts[last], least[new], text[new]
    to = np.minimum(e + LENGTH, ends[text])
    owned = _mix(h.of(s, to) + (pos - s).astype(np.uint64) * np.uint64(1_000_003) + (e - s).astype(np.uint64))
    base = (ends - lens)[text]
    return text, pos - base, s - base, e - base, to - base, gram[pos], owned


def _sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[int] = set()
    names: list[int] = []
    raw: list[bytes] = []
    size = 0

    def flush() -> pd.DataFrame:
        text, pos, s, e, to, gram, owned = anchors(raw)
        return pd.DataFrame({"gram": gram.view(np.int64), "owned": owned.view(np.int64), "t": np.array(names, np.int64)[text], "pos": pos.astype(np.int32), "s": s.astype(np.int32), "e": e.astype(np.int32), "to": to.astype(np.int32)})

    for batch in batches:
        for t, text in zip(batch["t"].tolist(), batch["text"], strict=True):
            b = text.encode("utf-8", "surrogatepass")
            if len(b) >= PASSAGE and t not in seen:
                seen.add(t)
                names.append(t)
                raw.append(b)
                size += len(b)
                if size >= CHUNK:
                    yield flush()
                    names, raw, size = [], [], 0
    if raw:
        yield flush()


def induce(gram: np.ndarray, before: list[bytes], after: list[bytes], lengths: tuple[int, ...] = (LENGTH, PASSAGE)) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows in order of (gram, after) -> least and greatest offset at which the row's string of each length repeats in its gram, or -1.

    lcp[j] is the common prefix of the rows at places j - 1 and j of the order.
    """
    n = len(gram)
    out = [(np.full(n, -1), np.full(n, -1)) for _ in lengths]
    size = np.fromiter(map(len, after), np.int64, n)
    right = np.zeros((n, LENGTH + 1), np.uint8)
    for i, b in enumerate(after):
        right[i, : len(b)] = np.frombuffer(b, np.uint8)
    left_size = np.fromiter(map(len, before), np.int64, n)
    left = np.zeros((n, SPAN + 1), np.uint8)
    for i, b in enumerate(before):
        left[i, : len(b)] = np.frombuffer(b, np.uint8)
    group = np.cumsum(np.concatenate(([0], gram[1:] != gram[:-1])))
    lcp = np.zeros(n + 1, np.int64)
    if n > 1:
        differ = right[1:] != right[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
        lcp[1:n] = np.where(group[1:] == group[:-1], np.minimum(first, np.minimum(size[1:], size[:-1])), 0)
    order = np.arange(n)
    for offset in range(SPAN + 1):
        common_to = np.maximum(lcp[: len(order)], lcp[1 : len(order) + 1])
        for length, (low, high) in zip(lengths, out, strict=True):
            rows = order[common_to >= length]
            low[rows] = np.where(low[rows] < 0, offset, low[rows])
            high[rows] = offset
        alive = np.flatnonzero(left_size[order] > offset)
        if len(alive) < 2:
            break
        rows = order[alive]
        key = group[rows] * 256 + left[rows, offset]
        turn = np.argsort(key, kind="stable")
        key, old = key[turn], alive[turn]
        same = np.flatnonzero(key[1:] == key[:-1])
        if not len(same):
            break
        ranges = np.stack((old[same] + 1, old[same + 1] + 1), axis=1).ravel()
        grown = np.zeros(len(old) + 1, np.int64)
        grown[same + 1] = np.minimum.reduceat(lcp, ranges)[::2] + 1
        order, lcp = rows[turn], grown
    return out


def _induced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (gram, after): complete grams are induced, about HELD rows at a time."""
    held: list[pd.DataFrame] = []
    count = 0

    def run(d: pd.DataFrame) -> pd.DataFrame:
        found, within = [], np.zeros(len(d), bool)
        both = induce(d["gram"].to_numpy(), d["before"].tolist(), d["after"].tolist())
        for length, (low, high) in zip((LENGTH, PASSAGE), both, strict=True):
            at = np.flatnonzero((low >= 0) & d["single"].to_numpy() & ~within)
            pos = d["pos"].to_numpy()[at]
            if length == LENGTH:  # what reaches no further for PASSAGE is left out there
                low_short, high_short = both[1]
                within = (low >= 0) & (high_short == high) & (low_short + LENGTH - PASSAGE >= low)
            found.append(pd.DataFrame({"t": d["t"].to_numpy()[at], "start": (pos - high[at]).astype(np.int32), "end": (pos - low[at] + length).astype(np.int32), "whole": length == LENGTH}))
        return pd.concat(found)

    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= HELD:
            d = pd.concat(held, ignore_index=True)
            cut = int((d["gram"] != d["gram"].iloc[-1]).sum())  # the last gram may go on
            if cut:
                yield run(d.iloc[:cut].reset_index(drop=True))
            held = [d.iloc[cut:].reset_index(drop=True)]
            count = 0 if cut else len(held[0]) // 2
    if held:
        yield run(pd.concat(held, ignore_index=True))


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hash of every owned string of each row, for both lengths."""
    for batch in batches:
        for k in range(0, len(batch), 2000):
            b = batch.iloc[k : k + 2000]
            raw = [x[::-1] + y for x, y in zip(b["before"], b["after"], strict=True)]
            lens = np.fromiter(map(len, raw), np.int64, len(raw))
            first = np.cumsum(lens) - lens
            h = Hashes(np.frombuffer(b"".join(raw), np.uint8))
            left = b["pos"].to_numpy() - np.fromiter(map(len, b["before"]), np.int64, len(raw))
            for length in (LENGTH, PASSAGE):
                own = np.clip(np.minimum(lens - length + 1, b["own"].to_numpy()), 0, None)
                row = np.repeat(np.arange(len(raw)), own)
                offset = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
                at = first[row] + offset
                yield pd.DataFrame({"string": h.of(at, at + length).view(np.int64), "t": b["t"].to_numpy()[row], "start": (left[row] + offset).astype(np.int32), "single": b["single"].to_numpy()[row], "whole": length == LENGTH})


def _crowded(regions: DataFrame) -> DataFrame:
    """(t, start, end, whole) of repeated strings by counting: partial aggregates settle however many equal ones."""
    s = regions.mapInPandas(_strings, "string long, t long, start int, single boolean, whole boolean")
    s = common.stored(s.withColumn("o", F.xxhash64("t", "start")), "suffix-strings")
    again = s.groupBy("string", "whole").agg(F.min("o").alias("a"), F.max("o").alias("b")).where("a < b").select("string", "whole")
    length = F.when(F.col("whole"), LENGTH).otherwise(PASSAGE)
    return s.where("single").join(again, ["string", "whole"], "left_semi").groupBy("t", "start", "whole").agg(F.first("start").alias("x")).select("t", "start", (F.col("x") + length).alias("end"), "whole")


def repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(t, long, short): byte ranges of repeated strings of LENGTH, and of PASSAGE bytes beyond these, of each distinct text by its hash.

    A range is one number: its start times 2**32 and its end.
    """
    common.bounded_batches(docs.sparkSession)
    texts = docs.select(F.xxhash64(docs[text]).alias("t"), docs[text].alias("text")).where(F.octet_length("text") >= PASSAGE)
    a = texts.mapInPandas(_sample, "gram long, owned long, t long, pos int, s int, e int, to int")
    a = common.stored(a, "suffix-anchors")
    place = F.xxhash64("t", "pos")
    twice = a.groupBy("gram").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x < y").select("gram")
    twice = common.stored(twice, "suffix-grams")  # so that both sides are dealt for the join, and a hot gram can be split
    a = common.stored(a.join(twice, "gram", "left_semi"), "suffix-candidates")
    kinds = a.groupBy("gram", "owned").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.min(F.struct("t", "pos", "s", "e", "to")).alias("at"))
    kinds = common.stored(kinds.select("gram", "owned", (F.col("x") == F.col("y")).alias("single"), "at"), "suffix-classes")
    equal = a.join(kinds.where("NOT single").select("gram", "owned"), ["gram", "owned"], "left_semi")
    large = F.col("to") - F.col("s") >= LENGTH  # then the strings of PASSAGE bytes are within
    equal = equal.select("t", F.col("s").alias("start"), F.when(large, F.col("to")).otherwise(F.col("e") + PASSAGE).alias("end"), large.alias("whole"))
    many = kinds.groupBy("gram").agg(F.count("*").alias("n"), F.max("single").alias("open")).where("n > 1 AND open").select("gram", (F.col("n") > CROWD).alias("crowd"))
    wanted = kinds.join(many, "gram").select("at.t", F.struct("gram", "at.t", "at.pos", "at.s", "at.e", "at.to", "single").alias("run"), "crowd")
    wanted = wanted.groupBy("t").agg(F.collect_list("run").alias("runs"), F.collect_set(F.when(F.col("crowd"), F.col("run.gram"))).alias("crowded"))  # runs of one text
    one = texts.join(wanted, "t")
    regions = common.stored(one.mapInPandas(_cut_known, _REGION), "suffix-regions").dropDuplicates(["t", "pos"])
    calm = regions.where("NOT crowd").drop("crowd")
    near = calm.repartition("gram").sortWithinPartitions("gram", "after").mapInPandas(_induced, "t long, start int, end int, whole boolean")
    found = equal.unionByName(near)
    if regions.where("crowd").head(1):
        found = found.unionByName(_crowded(regions.where("crowd").drop("crowd")))
    packed = F.shiftleft(F.col("start").cast("long"), 32) + F.col("end")
    return found.groupBy("t").agg(F.collect_list(F.when(F.col("whole"), packed)).alias("long"), F.collect_list(F.when(~F.col("whole"), packed)).alias("short"))


_REGION = "gram long, t long, pos int, own int, single boolean, before binary, after binary, crowd boolean"


def _cut_known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each wanted run, of each text once in a task."""
    seen: set[int] = set()
    for batch in batches:
        for t, text, runs, crowded in zip(batch["t"].tolist(), batch["text"], batch["runs"], batch["crowded"], strict=True):
            if t in seen:
                continue
            seen.add(t)
            b, crowd = text.encode("utf-8", "surrogatepass"), set(crowded)
            yield pd.DataFrame([(r["gram"], t, r["pos"], r["e"] - r["s"] + 1, r["single"], b[r["s"] : r["pos"]][::-1], b[r["pos"] : r["to"]], r["gram"] in crowd) for r in runs], columns=["gram", "t", "pos", "own", "single", "before", "after", "crowd"])


def _merged(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of packed ranges; those that touch are one."""
    if not len(ranges):
        return []
    ranges = np.sort(ranges)
    start, end = ranges >> 32, np.maximum.accumulate(ranges & 0xFFFFFFFF)
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist(), strict=True))


def _kept(texts: pd.Series, longs: pd.Series, shorts: pd.Series, copies: pd.Series) -> pd.DataFrame:
    out = []
    none = np.zeros(0, np.int64)
    for text, long, short, copy in zip(texts, longs, shorts, copies, strict=True):
        b = (text or "").encode("utf-8", "surrogatepass")
        long, short = (none if x is None else x for x in (long, short))
        gone = [(0, len(b))] if copy and len(b) >= LENGTH else _merged(long)
        told = [(0, len(b))] if copy and len(b) >= PASSAGE else _merged(np.concatenate((long, short)))
        keep, at = [], 0
        for x, y in gone:
            keep.append(b[at:x])
            at = y
        rest = b"".join([*keep, b[at:]])
        out.append((len(b), len(b) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), sum(len(b[x:y].split()) > WORDS for x, y in told)))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passages of every row.

    n_passages counts the maximal runs of repeated strings of PASSAGE bytes that have more than WORDS words.
    """
    d = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    spans = repeats(d)
    copies = d.select(F.xxhash64("text").alias("t")).groupBy("t").count().where("count > 1").select("t", F.lit(True).alias("copy"))
    known = common.stored(spans.join(copies, "t", "full"), "suffix-spans")
    j = d.withColumn("t", F.xxhash64("text")).join(known, "t", "left")
    kept = F.pandas_udf(_kept, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long")
    return j.select("doc_id", kept("text", "long", "short", F.coalesce("copy", F.lit(False))).alias("k")).select("doc_id", "k.*")


def op9(spark, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir).select("doc_id", "text"))
