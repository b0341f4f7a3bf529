"""LM scoring: a causal self-attention model over subword ids, trained and applied in Spark tasks with numpy.

Every text is split and encoded once; its ids are written to the shared folder and all later passes read them. A word's
key is a 64-bit hash of its ids, which tell it exactly.

Learning, from all training documents:

* word counts, counts of the tokenizer's ids and (the classes then fixed) bigrams of id classes: summed in tasks, then by
  Spark;
* the attention layer: the documents are dealt to ROUNDS by hash; in each round every task trains once on all windows of
  its documents of the round, and Spark averages the parameters of all tasks, weighted by their windows. The next round
  starts from the average. What is gathered grows with the number of tasks.

Scoring: a text is its words and an end; a word is the ids of " word". Overlapping windows give each id one probability
from batched masked attention. A word's probability is the weighted mean of the attention model's (its ids, then any id that
starts a word or the end) and of the word's smoothed training frequency, in which, as in the base score, unseen words
are one type of count 0.
Counts of the HEAD most frequent words are broadcast (a fixed number); those of all other words come by a join.

Defined results: null and empty texts are the end alone; a row with a null id is not held out and trains nothing; without
training documents N and V are 0 and the model is uniform over what it has not seen; repeated rows count each time; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention as A
from . import common

TOKENIZER = "byte_bpe_50k.tiktoken"
HEAD = 1 << 17
#: Weight of the word's own frequency in the mean.
MIXED = 0.7
#: A task takes a step for each BATCH of the windows of a round, and where these are few, STEPS steps at least.
ROUNDS, STEPS, BATCH = 2, 120, 64
SMOOTH = 20.0
#: Distinct words a task remembers; bytes of texts it encodes at a time, and ids it handles at a time (one text at least).
REMEMBERED = 250_000
BYTES = 8 << 20
BLOCK = 250_000
#: Words given to the tokenizer at a time.
JOINED = 10_000
TINY = 64
#: Bits of a key that name its cell among the frequent words.
CELLS = 18


def words(text: str) -> list[bytes]:
    """Only A-Z become lower case, and only ASCII white space parts words."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Ids:
    """Subword ids of words: the ranks of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.n = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.starts = np.zeros(self.n, bool)
        self.starts[[i for b, i in ranks.items() if b.startswith(b" ")]] = True

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has. Only a word's first id starts with a space."""
        flat, size = [np.zeros(0, np.int32)], []
        for k in range(0, len(words), JOINED):
            some = [w.decode("utf-8", "replace") for w in words[k : k + JOINED]]
            ids = np.array(self.encoding.encode_ordinary(" " + " ".join(some)), np.int32)
            first = np.flatnonzero(self.starts[ids])
            n = np.diff(np.concatenate((first, [len(ids)])))
            if len(n) != len(some):  # a word with a space of another kind at its edge
                each = [self.encoding.encode_ordinary(" " + w) for w in some]
                ids, n = np.fromiter(chain.from_iterable(each), np.int32), np.fromiter(map(len, each), np.int64, len(each))
            flat.append(ids)
            size.append(n)
        return np.concatenate(flat), np.concatenate(size)


#: A Python worker loads a vocabulary once.
known_ids = cache(Ids)


def stored_as(n_ids: int) -> np.dtype:
    """How ids are written."""
    return np.dtype("<u2" if n_ids <= 1 << 16 else "<i4")


class Vocabulary(dict):
    """Words of a task -> their numbers; what is known of each word stands in arrays."""

    def __init__(self, path: str):
        super().__init__()
        self.known = known_ids(path)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.size, self.at, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n

    def numbers(self, texts: list[list[bytes]]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64)
        if self.new:
            got, size = self.known.of(self.new)
            self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.ids = np.concatenate((self.ids, got))
            self.new = []
        return out

    def spelled(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words in a row."""
        n = self.size[numbers]
        return self.ids[np.arange(int(n.sum())) + np.repeat(self.at[numbers] - (np.cumsum(n) - n), n)]


def parted(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of texts in a row, and how many each has; the rule of ``words``."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
    full = pc.binary_length(found).to_numpy() > 0  # there are empty ones at the edges of texts
    if not full.all():
        n = np.bincount(np.repeat(np.arange(len(n)), n)[full], minlength=len(n))
        found = found.filter(pa.array(full))
    return found, n


def encoded(v: Vocabulary, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of texts in a row, and how many ids and how many words each has."""
    if len(v) > REMEMBERED:
        v.reset()
    found, n_words = parted(texts)
    coded = found.dictionary_encode()
    numbers = v.numbers([coded.dictionary.cast(pa.binary()).to_pylist()])[coded.indices.to_numpy()]
    size = np.concatenate(([0], np.cumsum(v.size[numbers])))
    to = np.cumsum(n_words)
    return v.spelled(numbers), size[to] - size[to - n_words], n_words


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in groups of about BYTES of text: batches of short texts together, those of long texts in parts."""
    held, size = [], 0
    for batch in batches:
        at = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(at, (at[begin - 1] if begin else 0) + BYTES - size, "right")))
            held.append(batch.slice(begin, end - begin))
            size += int(at[end - 1] - (at[begin - 1] if begin else 0))
            begin = end
            if begin < len(at) or size >= BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


_ENCODED = "doc_id long, held_out boolean, h long, n_words long, ids binary"


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(path)
        kind = stored_as(v.known.n)
        for rows in _grouped(batches):
            rows = rows.combine_chunks()
            ids, n_ids, n_words = encoded(v, rows.column("text").chunk(0))
            offsets = np.concatenate(([0], np.cumsum(n_ids * kind.itemsize))).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(n_ids), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind))])
            yield pa.RecordBatch.from_arrays([*(rows.column(c).chunk(0) for c in ("doc_id", "held_out", "h")), pa.array(n_words.astype(np.int64)), binary], ["doc_id", "held_out", "h", "n_words", "ids"])

    return encode


def _blocks(batches: Iterator[pd.DataFrame], n_ids: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows, their ids in a row and how many each has, about BLOCK ids at a time."""
    kind = stored_as(n_ids)
    for batch in batches:
        size = np.fromiter(map(len, batch["ids"]), np.int64, len(batch)) // kind.itemsize
        at, begin = np.cumsum(size), 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(at, (at[begin - 1] if begin else 0) + BLOCK, "right")))
            rows = batch.iloc[begin:end]
            yield rows, np.frombuffer(b"".join(rows["ids"]), kind), size[begin:end]
            begin = end


class Keys:
    """Keys of words from their ids: sums of random numbers of the ids, each times an odd number of its place."""

    def __init__(self, n_ids: int):
        self.of_id = np.append(np.random.default_rng(97).integers(0, 1 << 64, n_ids, np.uint64), np.uint64(0))
        self.of_place = np.ones(1, np.uint64)

    def of(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The key of the ids from each ``first`` to before the next; an id of -1 adds nothing."""
        size = np.diff(first, append=len(ids))
        if len(size) and size.max() > len(self.of_place):
            odd = np.full(2 * int(size.max()), 0x9E3779B97F4A7C15, np.uint64)
            odd[0] = 1
            self.of_place = np.cumprod(odd, dtype=np.uint64)
        run = self.of_id[ids]
        run *= self.of_place[np.arange(len(ids)) - np.repeat(first, size)]
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(run, dtype=np.uint64)))
        return run[first + size] - run[first]


def with_ends(ids: np.ndarray, n_ids: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of texts with their ends, ids of each text (the end counted), and the ids at their places (-1: an end)."""
    lens = n_ids + 1
    places = np.ones(int(lens.sum()), bool)
    places[np.cumsum(lens) - 1] = False
    out, at = np.full(len(places), A.END, np.int16), np.full(len(places), -1, np.int32)
    out[places], at[places] = classes[ids], ids
    return out, lens, at


def sequences(vocabulary: Vocabulary, numbers: np.ndarray, n_words: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``with_ends`` gives, of texts of numbered words."""
    size = np.concatenate(([0], np.cumsum(vocabulary.size[numbers])))
    to = np.cumsum(n_words)
    return with_ends(vocabulary.spelled(numbers), size[to] - size[to - n_words], classes)


#: Kinds of counts.
WORD, ID = 0, 1


def _counter(shared):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = shared.value
        keys, ids = Keys(len(starts)), np.zeros(len(starts), np.int64)
        held, seen = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]  # keys and their counts, merged when they are many

        def merge() -> None:
            key = np.concatenate(held)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            n = np.add.reduceat(np.concatenate(seen)[order], first) if len(key) else np.zeros(0, np.int64)
            held[:], seen[:] = [key[first]], [n]

        for _, got, _ in _blocks(batches, len(starts)):
            ids += np.bincount(got, minlength=len(ids))
            found, n = np.unique(keys.of(got, np.flatnonzero(starts[got])), return_counts=True)
            held.append(found)
            seen.append(n)
            if sum(map(len, held)) > 4 * REMEMBERED:
                merge()
                if len(held[0]) > REMEMBERED:
                    yield pd.DataFrame({"kind": WORD, "key": held[0].view(np.int64), "n": seen[0]})
                    held[:], seen[:] = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        merge()
        yield pd.DataFrame({"kind": WORD, "key": held[0].view(np.int64), "n": seen[0]})
        at = np.flatnonzero(ids)
        yield pd.DataFrame({"kind": ID, "key": at, "n": ids[at]})

    return count


def _sequences(path: str, batches: Iterator[pd.DataFrame], classes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes of texts with their ends, and how many each has, of rows with ids; texts without are encoded first."""
    v = None

    def coded() -> Iterator[pd.DataFrame]:
        nonlocal v
        for batch in batches:
            if "ids" not in batch:
                v = v or Vocabulary(path)
                ids, n, _ = encoded(v, pa.array(batch["text"], pa.string()))
                batch = pd.DataFrame({"ids": [x.astype(stored_as(len(classes))).tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]})
            yield batch

    for _, ids, n in _blocks(coded(), len(classes)):
        yield with_ends(ids, n, classes)[:2]


def _pair_counter(path: str, shared):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.zeros((A.CLASSES + 1) * A.CLASSES, np.int64)
        for c, lens in _sequences(path, batches, shared.value):
            before = np.concatenate(([A.BEGIN], c[:-1])).astype(np.int64)
            before[np.cumsum(lens) - lens] = A.BEGIN
            pairs += np.bincount(before * A.CLASSES + c, minlength=len(pairs))
        at = np.flatnonzero(pairs)
        yield pd.DataFrame({"key": at, "n": pairs[at]})

    return count


def of_round(training: DataFrame, nth: int) -> DataFrame:
    """The documents of a round; every document is in one."""
    return training.where(F.pmod(F.xxhash64("h"), F.lit(ROUNDS)) == nth)


def _trainer(path: str, shared, nth: int):
    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        A.keep_pages()
        flat, bigram, classes = shared.value
        context = TaskContext.get()
        rng = np.random.default_rng([5, nth, context.partitionId() if context else 0])

        def blocks() -> Iterator[tuple[np.ndarray, ...]]:
            for c, lens in _sequences(path, batches, classes):
                yield A.windows(c, lens)

        flat, n = A.fit(flat, bigram, blocks(), STEPS, rng, BATCH)
        if n:
            yield pd.DataFrame({"place": np.arange(A.PARAMETERS), "value": flat.astype(np.float64) * n, "weight": float(n)})

    return train


class Scorer:
    """All that scoring needs; its size does not depend on the corpus."""

    def __init__(self, flat, bigram, classes, start, share, head_key, head_count, total, distinct, ends):
        self.model, self.classes, self.start, self.share = A.Model(flat, bigram), classes, start, share
        self.head_key, self.head_count = head_key, head_count
        self.total, self.distinct, self.ends = total, distinct, ends
        self.cells = np.searchsorted(head_key, np.arange(1 << CELLS, dtype=np.uint64) << np.uint64(64 - CELLS))
        self.cells = np.append(self.cells, len(head_key))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of words by their keys, 0 beyond the head: looked up in the cell of their first bits."""
        cell = (keys >> np.uint64(64 - CELLS)).astype(np.int64)
        at, end = self.cells[cell], self.cells[cell + 1]
        out, open_ = np.zeros(len(keys), np.int64), np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            same = self.head_key[here] == keys[open_]
            out[open_[same]] = self.head_count[here[same]]
            at[open_] += 1
            open_ = open_[~same & (here + 1 < end[open_])]
        return out

    def base(self, count):
        return np.log10((count + 1) / (self.total + self.distinct + 1))

    def places(self, c: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each class of the texts, and that a word starts (or the text ends) there."""
        x, y, scored = A.windows(c, lens)
        n = 1 + np.maximum(0, -(-(lens - A.WINDOW) // (A.WINDOW - A.CONTEXT)))
        opens = np.zeros(len(x), bool)
        opens[np.cumsum(n) - n] = True
        at = np.cumsum(scored.sum(axis=1)) - scored.sum(axis=1)
        lp, ls = np.zeros(len(c)), np.zeros(len(c))
        for first, rows in ((0, np.flatnonzero(opens)), (A.CONTEXT, np.flatnonzero(~opens))):
            for k in range(0, len(rows), TINY):
                i = rows[k : k + TINY]
                a, b = self.model.log_probability(x[i], y[i], self.start, first)
                on = scored[i][:, first:]
                to = at[i][:, None] + np.cumsum(on, axis=1) - 1
                lp[to[on]], ls[to[on]] = a[on], b[on]
        return lp, ls


_SCORED = "row long, doc_id long, held_out boolean, n_words long, head_known long, head_base double, head_score double, tail array<long>, tail_lp array<double>"


def _scorer(shared):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        A.keep_pages()
        s: Scorer = shared.value
        keys, share = Keys(len(s.classes)), np.append(s.share, 0.0)  # an end is alone in its class
        for rows, ids, n_ids in _blocks(batches, len(s.classes)):
            n_words = rows["n_words"].to_numpy()
            c, lens, at = with_ends(ids, n_ids, s.classes)
            lp, ls = s.places(c, lens)
            lp += share[at]
            # a word: its ids given that a word starts, then that another word (or the end) does
            first = np.flatnonzero(c >= s.start)
            word = c[first] != A.END
            run, end = np.concatenate(([0.0], np.cumsum(lp))), np.append(first[1:], len(c))[word]
            key, first = keys.of(at, first)[word], first[word]
            of_word = (run[end] - run[first] - ls[first] + ls[end]) / math.log(10)
            last = np.cumsum(lens) - 1
            of_end = (lp[last] - ls[last]) / math.log(10)
            count = s.counts(key)
            head = count > 0
            mixed = np.where(head, mean(of_word, s.base(count)), 0.0)
            to = np.cumsum(n_words)
            total = lambda values, to=to, n=n_words: (r := np.concatenate(([0.0], np.cumsum(values))))[to] - r[to - n]
            end_known = int(s.ends > 0)
            end_score = mean(of_end, s.base(s.ends))
            tail = np.concatenate(([0], np.cumsum(~head)))
            hashes, tail_lp = key[~head].view(np.int64), of_word[~head]
            yield pd.DataFrame({
                "row": rows["row"].to_numpy(), "doc_id": rows["doc_id"].to_numpy(), "held_out": rows["held_out"].to_numpy(), "n_words": n_words,
                "head_known": total(head).round().astype(np.int64) + end_known, "head_base": total(np.where(head, s.base(count), 0.0)) + s.base(s.ends), "head_score": total(mixed) + end_score,
                "tail": [hashes[tail[b - n] : tail[b]] for b, n in zip(to, n_words, strict=True)], "tail_lp": [tail_lp[tail[b - n] : tail[b]] for b, n in zip(to, n_words, strict=True)],
            })

    return score


def mean(model: np.ndarray, base: np.ndarray) -> np.ndarray:
    """log10 of the weighted mean of two probabilities given by their log10."""
    a, b = model + math.log10(1 - MIXED), base + math.log10(MIXED)
    top = np.maximum(a, b)
    return top + np.log10(10 ** (a - top) + 10 ** (b - top))


def least_frequent(frequent: DataFrame) -> int:
    """The least count that HEAD words at most reach, from a histogram of counts in steps of an eighth of their logarithm."""
    cell = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, None
    for r in frequent.groupBy(cell.alias("cell")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.col("cell").desc()).collect():
        held += r["words"]
        if held > HEAD:
            break
        least = r["n"]
    return least or 1 << 62


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Learn from the rows where ``held_out`` is false, score all rows (null ``held_out``: scored only)."""
    common.bounded_batches(docs.sparkSession)
    spark, path = docs.sparkSession, tokenizer or public_tokenizers.path(TOKENIZER)
    known = known_ids(path)
    n_ids, starts = known.n, known.starts
    d = docs.select(docs[doc_id].cast("long").alias("doc_id"), held_out.alias("held_out"), F.xxhash64(docs[doc_id].cast("long"), F.lit("lm")).alias("h"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    d = common.stored(d.mapInArrow(_encoder(path), _ENCODED), "lm-ids")
    training = d.where("NOT held_out").select("ids", "h")
    n_train = training.count()
    shared = spark.sparkContext.broadcast(starts)
    counts = training.select("ids").mapInPandas(_counter(shared), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = common.stored(counts, "lm-counts")
    frequent = counts.where(F.col("kind") == WORD).select("key", "n")
    total, distinct = frequent.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + n_train, distinct + (n_train > 0)
    seen, pairs = np.zeros(n_ids, np.int64), np.zeros((A.CLASSES + 1) * A.CLASSES)
    for r in counts.where(F.col("kind") == ID).collect():  # a row for each id
        seen[r["key"]] = r["n"]
    classes, start = A.class_map(seen, starts)
    ids = seen + 0.5
    shared = spark.sparkContext.broadcast(classes)
    for r in training.select("ids").mapInPandas(_pair_counter(path, shared), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():  # a row for each pair of classes
        pairs[r["key"]] = r["n"]
    share = np.log(ids / np.bincount(classes, weights=ids, minlength=A.CLASSES)[classes])
    pairs = pairs.reshape(A.CLASSES + 1, A.CLASSES)
    one = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * A.CLASSES)
    bigram = np.log((pairs + SMOOTH * one) / (pairs.sum(axis=1, keepdims=True) + SMOOTH))
    # attention: rounds of training in all tasks, averaged
    flat = A.initial()
    for nth in range(ROUNDS):
        shared = spark.sparkContext.broadcast((flat, bigram, classes))
        got = of_round(training, nth).select("ids").mapInPandas(_trainer(path, shared, nth), "place int, value double, weight double").groupBy("place").agg((F.sum("value") / F.sum("weight")).alias("value")).collect()
        for r in got:  # PARAMETERS rows
            flat[r["place"]] = r["value"]
    head = frequent.where(F.col("n") >= least_frequent(frequent)).toPandas()  # HEAD rows at most
    order = np.argsort(head["key"].to_numpy(np.int64).view(np.uint64))
    scorer = Scorer(flat, bigram, classes, start, share, head["key"].to_numpy(np.int64).view(np.uint64)[order], head["n"].to_numpy(np.int64)[order], total, distinct, n_train)
    shared = spark.sparkContext.broadcast(scorer)
    rows = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "n_words", "ids")
    scored = common.stored(rows.mapInPandas(_scorer(shared), _SCORED), "lm-scored")
    # words beyond the head
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "tail_lp")).alias("z")).select("row", F.col("z.tail").alias("key"), F.col("z.tail_lp").alias("lp"))
    n = F.coalesce("n", F.lit(0))
    base = F.log10((n + 1) / F.lit(float(total + distinct + 1)))
    a, b = F.col("lp") + math.log10(1 - MIXED), base + math.log10(MIXED)
    both = F.greatest(a, b) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(a - b)))
    found = tail.join(frequent, "key", "left").groupBy("row").agg(F.count("n").alias("known"), F.sum(base).alias("base"), F.sum(both).alias("score"))
    zero = F.lit(0.0)
    out = scored.drop("tail", "tail_lp").join(found, "row", "left")
    return out.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("base", zero)).alias("base_score"), (F.col("head_score") + F.coalesce("score", zero)).alias("score"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, common.remainder(docs["doc_id"], 7) == 2)
