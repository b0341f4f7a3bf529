"""N-gram Jaccard join by token-combination prefixes.

A text's tokens are its distinct 5-word shingles (64-bit hashes), ordered by how frequent their class is (all tokens of
rare classes before those of frequent ones) and then by hash. Texts with equal sets are one class of copies. Of every class the prefix of the ordered set is indexed:

* tokens of rare classes alone;
* for short sets, whose prefixes can be made of shared passages only, the prefix is extended by one and tokens of
  frequent classes are indexed as pairs (two sets that may link share two tokens of the extended prefixes: a rare one,
  or two frequent ones);
* longer sets index every prefix token alone. Sets in between do both, so no link falls between the two ways: linked
  sets differ in size by a quarter at most.

Index keys are read in sorted order. A key's most typical set leads, the one whose tokens are the most frequent on the
whole: of near copies it is the one that the others were made from. Every other set is verified against it (and, in
frequent keys, against the leader of its salted part). The verified links make components. Of keys that still hold several
components, a set that has no partner by size and place is left out, and the others outside a key's largest component are
verified against all that are not of their own. So a group of n near copies costs about n checks, and yet no link between
texts is lost.

Defined results: null text and text without words have an empty set (n_shingles 0), linked with nothing, and stand
alone even if repeated; a text of fewer than five words has one shingle, the whole sequence; component_id is the
smallest doc_id of the component (null only if all of its ids are null); rows of one doc_id are texts of their own;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

WIDTH = 5
NUM, DEN = 75, 100
#: Classes of tokens for which frequencies are kept, in CHUNKS rows a task.
CLASSES = 1 << 21
CLASS_SHIFT = np.uint64(64 - 21)
CHUNKS = 64
#: Tokens counted at a time: those that only one set of them has add nothing to their class.
WINDOW = 1 << 21
#: A class is frequent with so many times the mean count of a class, and so many more.
FREQUENT_X, FREQUENT = 4, 16
#: Sets of at most SHORT tokens index pairs of frequent tokens; those of at least 3/4 of it index them alone.
SHORT = 60
SALTS = 16
FILTER_BITS = 1 << 26
M = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Words of the lower-cased text; bytes.lower() and bytes.split() know A-Z and ASCII white space alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    digest = xxhash.xxh64_intdigest
    group: list[list[bytes]] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        lens = np.fromiter(map(len, group), np.int64, len(group))
        flat = np.fromiter((digest(w) for ws in group for w in ws), np.uint64, int(lens.sum()))
        ends = np.cumsum(lens)
        h = np.zeros(max(0, len(flat) - WIDTH + 1), np.uint64)
        for k in range(WIDTH):
            h = _mix(h * M + flat[k : len(flat) - WIDTH + 1 + k]) if k == WIDTH - 1 else h * M + (flat[k : len(flat) - WIDTH + 1 + k] ^ np.uint64(k + 1))
        for n, end in zip(lens.tolist(), ends.tolist(), strict=True):
            if n >= WIDTH:
                yield np.unique(h[end - n : end - WIDTH + 1])
            elif n:
                whole = np.uint64(n)
                with np.errstate(over="ignore"):
                    for x in flat[end - n : end]:
                        whole = whole * M + x
                yield _mix(np.array([whole]) ^ np.uint64(0x5851F42D4C957F2D))
            else:
                yield np.zeros(0, np.uint64)

    for t in texts:
        group.append(words(t))
        size += len(group[-1])
        if size >= BLOCK:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


def set_id(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64)) if len(tokens) else 0


def sketch(tokens: np.ndarray) -> bytes:
    """Tokens of each of 2**k buckets, at most two in the mean: two sketches bound an intersection from above."""
    cells = 1 << max(3, (len(tokens) - 1).bit_length() - 1)
    return np.minimum(np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def at_most(x: bytes, y: bytes) -> int:
    """A number that the intersection of the sketched sets does not exceed."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if (a.max(initial=0) | b.max(initial=0)) == 255:  # a count may be cut: no bound
        return 1 << 62
    a, b = a.astype(np.int64), b.astype(np.int64)
    n = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, n).sum(axis=0), b.reshape(-1, n).sum(axis=0)).sum())


def _count(counts: np.ndarray, window: list[np.ndarray]) -> None:
    """Add the tokens that several sets of the window have; the many that one set has would drown them in their classes."""
    token, n = np.unique(np.concatenate(window), return_counts=True)
    np.add.at(counts, (token[n > 1] >> CLASS_SHIFT).astype(np.int64), n[n > 1])


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(CLASSES, np.int64)
    seen: set[int] = set()
    window: list[np.ndarray] = []
    held = 0
    for batch in batches:
        n, sid, sketches = [], [], []
        for tokens in shingle_sets(batch["text"].tolist()):
            n.append(len(tokens))
            sid.append(set_id(tokens))
            sketches.append(None)
            if sid[-1] not in seen and len(tokens):  # copies within a task count once
                seen.add(sid[-1])
                sketches[-1] = sketch(tokens)
                window.append(tokens)
                held += len(tokens)
                if held >= WINDOW:
                    _count(counts, window)
                    window, held = [], 0
        yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "n": n, "sid": sid, "sketch": sketches, "chunk": None, "counts": None})
    if window:
        _count(counts, window)
    if counts.any():
        parts = np.minimum(counts, 2**31 - 1).astype("<i4").reshape(CHUNKS, -1)
        yield pd.DataFrame({"doc_id": pd.Series([None] * CHUNKS, dtype="Int64"), "text_hash": 0, "n": -1, "sid": None, "sketch": None, "chunk": range(CHUNKS), "counts": [zlib.compress(p.tobytes(), 1) for p in parts]})


def _sum_counts(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CLASSES // CHUNKS, np.int64)
    for c in group["counts"]:
        total += np.frombuffer(zlib.decompress(c), "<i4")
    return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "counts": [total.astype("<i8").tobytes()]})


class Order:
    """Token order: class of frequency, then hash. Two bytes a class, so its size is fixed.

    The limit falls inside a power of two, so ``frequent`` parts that level too: if the first token two sets share is
    frequent, so is the second.
    """

    def __init__(self, counts: np.ndarray):
        limit = FREQUENT_X * counts.mean() + FREQUENT
        self.frequent = counts > limit
        self.level = 2 * np.ceil(np.log2(counts + 1)).astype(np.uint8) + self.frequent

    def prefix(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prefix tokens, extended by one for short sets, and which of them are frequent."""
        n = len(tokens)
        size = n - (-(-NUM * n // DEN)) + 1
        cls = (tokens >> CLASS_SHIFT).astype(np.int64)
        take = np.lexsort((tokens, self.level[cls]))[: min(n, size + (n <= SHORT))]
        return tokens[take], self.frequent[cls[take]]

    def typical(self, tokens: np.ndarray) -> int:
        """How frequent the tokens of a set are: the mean level of their classes, in thousandths."""
        return int(1000 * self.level[(tokens >> CLASS_SHIFT).astype(np.int64)].mean())

    def keys(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index keys of a set, which of them are frequent, and the reach of each.

        If a key holds the first tokens that two sets share, they share no more than either's reach: the tokens from
        the key's place on.
        """
        n = len(tokens)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int32)
        t, often = self.prefix(tokens)
        reach = n - np.arange(len(t))
        alone = np.ones(len(t), bool) if n * 4 >= SHORT * 3 or len(t) == 1 else ~often
        key, hot, far = t[alone], often[alone], reach[alone]
        many = np.flatnonzero(often)
        if n <= SHORT and len(many) > 1:
            i, j = np.triu_indices(len(many), 1)
            key = np.concatenate((key, _mix(t[many[i]] * M + t[many[j]])))
            hot = np.concatenate((hot, np.ones(len(i), bool)))
            far = np.concatenate((far, reach[many[j]] + 1))
        return key, hot, far.astype(np.int32)


def _indexer(shared):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            keys, sids, ns, salts, far, typical = [], [], [], [], [], []
            for tokens in shingle_sets(batch["text"].tolist()):
                sid = set_id(tokens)
                if sid in seen or not len(tokens):
                    continue
                seen.add(sid)
                k, hot, reach = shared.value.keys(tokens)
                far.append(reach)
                typical.append(np.full(len(k), shared.value.typical(tokens), np.int32))
                keys.append(k.view(np.int64))
                sids.append(np.full(len(k), sid, np.int64))
                ns.append(np.full(len(k), len(tokens), np.int32))
                salts.append(np.where(hot, sid % SALTS, -1).astype(np.int32))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "salt": np.concatenate(salts), "sid": np.concatenate(sids), "n": np.concatenate(ns), "reach": np.concatenate(far), "typical": np.concatenate(typical)})

    return index


def _lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key and salt, the leader first -> rows of keys with several sets, each with the first set of its run.

    The first row of a run comes too: at once if the key is salted, else when a second set appears. Only the first row
    of the run at hand is carried from batch to batch, however long the run is.
    """
    last: tuple[int, int] | None = None
    lead, lead_n, lead_reach, lead_typical, told = 0, 0, 0, 0, True
    for b in batches:
        key, salt, sid, n, reach, typical = (b[c].to_numpy() for c in ("key", "salt", "sid", "n", "reach", "typical"))
        if not len(key):
            continue
        new = np.concatenate(([last != (int(key[0]), int(salt[0]))], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first, first_n, first_reach, first_typical = (np.where(at >= 0, x[at], y) for x, y in ((sid, lead), (n, lead_n), (reach, lead_reach), (typical, lead_typical)))
        others = sid != first
        run = np.cumsum(new)
        second = np.flatnonzero(others)
        second = second[np.unique(run[second], return_index=True)[1]]
        second = second[(salt[second] < 0) & ~(told & (run[second] == 0))]
        tell = np.concatenate((second, np.flatnonzero(new & (salt >= 0))))
        i = np.flatnonzero(others)
        if len(i) + len(tell):
            both = np.concatenate((i, tell))
            own = lambda x, of_lead, i=i, tell=tell: np.concatenate((x[i], of_lead[tell]))
            yield pd.DataFrame({"key": key[both], "salt": salt[both], "sid": own(sid, first), "n": own(n, first_n), "reach": own(reach, first_reach), "typical": own(typical, first_typical), "lead": first[both], "lead_n": first_n[both], "lead_reach": first_reach[both]})
        tail = run == run[-1]
        told = bool(salt[-1] >= 0 or others[tail].any() or (run[-1] == 0 and told))
        lead, lead_n, lead_reach, lead_typical, last = int(first[-1]), int(first_n[-1]), int(first_reach[-1]), int(first_typical[-1]), (int(key[-1]), int(salt[-1]))


_INDEX = "key long, salt int, sid long, n int, reach int, typical int"
_LED = f"{_INDEX}, lead long, lead_n int, lead_reach int"


def _led(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("typical"), "sid").mapInPandas(_lead, _LED)


def _setter(shared):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        bits = shared.value
        for batch in batches:
            cell = batch["text_hash"].to_numpy() & (FILTER_BITS - 1)
            want = np.flatnonzero(bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)  # only texts that may be wanted are cut into words
            sids, tokens_of = [], []
            for tokens in shingle_sets(batch["text"].iloc[want].tolist()):
                sid = set_id(tokens)
                if len(tokens) and sid not in seen:
                    seen.add(sid)
                    sids.append(sid)
                    tokens_of.append(tokens.tobytes())
            yield pd.DataFrame({"sid": sids, "tokens": tokens_of})

    return sets


def _filter(wanted: DataFrame) -> np.ndarray:
    """A bit for each low part of a wanted hash: FILTER_BITS bits at any input size. It only saves work; a join decides."""
    cell = F.col("text_hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    got = wanted.groupBy(F.shiftright(cell, 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(text_hash & 31 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, "<u4")
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype("<u4")
    return out.view(np.uint8)


def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(DEN * both >= NUM * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


def _may_link(n: pd.Series, m: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([DEN * both >= NUM * (i + j - both) for i, j, both in zip(n, m, map(at_most, a, b), strict=True)], dtype=bool)


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) of set ids that link: sketches refuse most others, the sets themselves decide."""
    side = lambda x: sketches.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    maybe = pairs.join(side("a"), "a").join(side("b"), "b").where(F.pandas_udf(_may_link, "boolean")("na", "nb", "sa", "sb")).select("a", "b")
    maybe = common.stored(maybe, f"{name}-maybe")
    wanted = maybe.select(F.col("a").alias("sid")).union(maybe.select("b")).distinct().join(sketches.select("sid", "text_hash"), "sid")
    wanted = common.stored(wanted, f"{name}-wanted")
    bits = pairs.sparkSession.sparkContext.broadcast(_filter(wanted))
    sets = texts.mapInPandas(_setter(bits), "sid long, tokens binary").join(wanted, "sid", "left_semi")
    sets = common.stored(sets, f"{name}-sets").dropDuplicates(["sid"])
    p = maybe.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), "a")
    p = p.join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb")), "b")
    return common.stored(p.where(F.pandas_udf(_linked, "boolean")("ta", "tb")).select("a", "b"), name)


def _near(a: str, b: str, reach_a: str, reach_b: str):
    """Sizes and reaches with which two sets can link.

    A key that is not the first they share may be refused here: of a pair that links, the first one is not.
    """
    return (F.col(a) * DEN >= F.col(b) * NUM) & (F.col(b) * DEN >= F.col(a) * NUM) & (F.least(F.col(reach_a), F.col(reach_b)) * (DEN + NUM) >= (F.col(a) + F.col(b)) * NUM)


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, sid) of every row, and (node, root) of the set ids that have links."""
    common.bounded_batches(docs.sparkSession)
    t = docs[text].cast("string")
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    texts = rows.select("text", "text_hash").where("text IS NOT NULL")
    told = common.stored(rows.mapInPandas(_describe, "doc_id long, text_hash long, n int, sid long, sketch binary, chunk int, counts binary"), "shingle-counts")
    members = told.where("n >= 0").select("doc_id", "text_hash", F.col("n").cast("long").alias("n"), "sid")
    counts = np.zeros(CLASSES, np.int64)
    # CHUNKS rows of CLASSES / CHUNKS counts
    for r in told.where("n < 0").select("chunk", "counts").groupBy("chunk").applyInPandas(_sum_counts, "chunk int, counts binary").collect():
        counts[r["chunk"] * (CLASSES // CHUNKS) : (r["chunk"] + 1) * (CLASSES // CHUNKS)] = np.frombuffer(r["counts"], "<i8")
    spark = docs.sparkSession
    index = texts.mapInPandas(_indexer(spark.sparkContext.broadcast(Order(counts))), _INDEX)
    led = common.stored(_led(index), "led")
    # the leaders of a frequent key's salted parts are led by the most typical of them, and so are their sets
    over = common.stored(_led(led.where("salt >= 0 AND sid = lead").select("key", F.lit(-1).alias("salt"), "sid", "n", "reach", "typical").distinct()), "led-over")
    top = common.stored(over.select("key", *[F.col(c).alias(f"top_{c}") for c in ("lead", "lead_n", "lead_reach")]).distinct(), "led-top")
    again = led.where("salt >= 0").join(top, "key").where(_near("n", "top_lead_n", "reach", "top_lead_reach"))
    sketches = told.where("sketch IS NOT NULL").select("sid", "n", "sketch", "text_hash").join(led.select("sid").distinct(), "sid", "left_semi")
    sketches = common.stored(sketches, "sketches").dropDuplicates(["sid"])
    first = _pairs(led.unionByName(over).where(_near("n", "lead_n", "reach", "lead_reach")), "sid", "lead")
    first = common.stored(first.union(_pairs(again, "sid", "top_lead")).distinct(), "led-pairs")
    links = _verified(first, sketches, texts, "links")
    parts = components(links)
    more = _verified(_across(_open(led.select("key", "sid", "n", "reach").distinct(), parts)).join(first, ["a", "b"], "left_anti"), sketches, texts, "more-links")
    return members, (components(links.union(more)) if more.head(1) else parts)


def _open(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of keys that hold several components, with the component of each as part, without those that have no partner.

    A set links through a key only if its reach there suffices for the smallest set of the key that it may link with.
    """
    placed = rows.join(parts.select(F.col("node").alias("sid"), "root"), "sid", "left").select("key", "sid", "n", "reach", F.coalesce("root", "sid").alias("part"))
    placed = common.stored(placed, "open-placed")
    for turn in ("first", "second"):  # what is left out the first time may have been the smallest set or the second component
        keys = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("n").alias("least")).where("lo < hi")
        keys = common.stored(keys.select("key", "least"), f"open-keys-{turn}")
        reaches = F.col("reach").cast("long") * (DEN + NUM) * DEN >= (F.col("n") * DEN + F.greatest(F.col("n") * NUM, F.col("least") * DEN)) * NUM
        placed = common.stored(placed.join(keys, "key").where(reaches).drop("least"), f"open-{turn}")
    return placed


def _across(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of near sets of different components that meet in a key: what is outside its largest one with all."""
    sizes = rows.groupBy("key", "part").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("largest"))
    sizes = common.stored(sizes, "open-largest")
    minor = common.stored(rows.join(sizes, "key").where("part <> largest").select("key", *[F.col(c).alias(f"{c}_b") for c in ("sid", "n", "reach", "part")]), "open-minor")
    j = rows.select("key", *[F.col(c).alias(f"{c}_a") for c in ("sid", "n", "reach", "part")]).join(minor, "key")
    return common.stored(_pairs(j.where((F.col("part_a") != F.col("part_b")) & _near("n_a", "n_b", "reach_a", "reach_b")), "sid_a", "sid_b"), "across")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and keep (the row's id and text are the component's first) of each row."""
    members, parts = classes(docs, doc_id, text)
    m = members.join(parts.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.coalesce("root", "sid")).alias("part"))
    m = common.stored(m, "parts")
    first = m.where("part IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")).alias("first"))
    first = common.stored(first, "firsts")  # so that both sides are dealt for the join, and large parts can be split
    out = m.join(first, "part", "left")
    alone = F.col("part").isNull()
    same = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash").eqNullSafe(F.col("first"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | same).alias("keep"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the row with the smallest id (and text hash) stays, once; rows without words stay."""
    keep = grouped(docs).where("keep").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), (F.col("n_shingles") > 0).alias("_once")).distinct()
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs["doc_id"].cast("long").alias("_key"), F.xxhash64(docs["text"].cast("string")).alias("_text"))
    j = d.join(keep, d["_key"].eqNullSafe(keep["_id"]) & (d["_text"] == keep["_hash"]))
    nth = F.row_number().over(Window.partitionBy("_key", "_text").orderBy("_text"))
    return j.withColumn("_nth", nth).where("NOT _once OR _nth = 1").select("_doc.*")
