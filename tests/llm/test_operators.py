"""Every corpus operator against brute force on a small table with nulls, empty texts, copies, ties and odd names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veldspar.llm import decontaminate, jaccard, language_id, lm_scoring, mixing, pii, quality_rules, registry, repair_ids, sharding, suffix_dedup
from veldspar.llm.common import stored

RNG = np.random.default_rng(7)
VOCAB = ["the", "of", "and", *("w%d" % i for i in range(300))]


def prose(n):
    return " ".join(VOCAB[i] for i in RNG.integers(0, len(VOCAB), n))


def table():
    item = prose(15)
    base = prose(120)
    words = base.split()
    texts = [None, "", "   \n", "one two", "one two", "One  TWO", "é", "12 + 3", base, base, base.upper()]
    texts += [" ".join([*words[:k], "x%d" % k, *words[k + 1 :]]) for k in range(20, 100, 9)]
    texts += [prose(60) + " " + item + " " + prose(30), item, prose(400) + " " + base + "\n" + prose(40)]
    texts += [prose(int(n)) for n in RNG.integers(1, 90, 30)]
    texts += ["write to a.b+c@mail.example.org, or x@y@z.de or +1 (974) 555-3436. " + prose(8), "10.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 4111-1111-1111-1112", "A a a a\nA a a a\n" + "r s t u v w x y " * 4]
    texts += ["the und die der nicht und die", "le la les de une pour", "z" * 5000, "ab " * 3000, "<|endoftext|> tail", "tab\tand  space  twice"]
    rows = [(i * 3, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s0"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    passage = prose(70)
    rows += [(3000 + i, prose(20) + " " + passage + " " + prose(30), "en", "s1", 1) for i in range(3)]
    return [*rows, (None, base, None, None, 1), (None, None, None, None, None), rows[8], rows[20]], item


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rows, item = table()
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumnsRenamed({}).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (1, item), (2, "one two"), (3, None), (4, "!!")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(24, 1, 0), (27, 1, 0), (30, 0, 1), (30, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, item


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf[0]}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return d


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_ids(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for d, x, *_ in sf[1]]
    got = repair_ids.op1(spark, sf[0]).orderBy("start").collect()
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], [(d, len(i), zlib.crc32(i.tobytes())) for d, i in want])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids)


def test_grammar_round_trip():
    ids = np.concatenate([np.tile(RNG.integers(3, 40, 50), 30), [2], RNG.integers(3, 9, 2000), [2], np.full(500, 7), [2]]).astype(np.uint32)
    g = repair_ids.compress(ids)
    assert len(g[3]) < len(ids) / 2
    assert (repair_ids.expand(*g) == ids).all()
    for a, b in ((0, 1), (17, 903), (1500, 1502), (3000, len(ids))):
        assert (repair_ids.decode_range(*g, a, b) == ids[a:b]).all()


def test_shards(spark, sf):
    got = sharding.op2(spark, sf[0]).collect()
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in sf[1]])
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(0 <= s < 40 for s in by)


def test_model_base(spark, sf):
    w = [(d, words(low(t))) for d, t, *_ in sf[1]]
    train = [x for d, x in w if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    c, e = Counter(y for x in train for y in x), len(train)
    n, v = sum(c.values()) + e, len(c) + 1
    want = [(d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(x) + 1, sum(c[y] > 0 for y in x) + 1, n, round(float(sum(np.log10((c[y] + 1) / (n + v + 1)) for y in x) + np.log10((e + 1) / (n + v + 1))), 4)) for d, x in w]
    got = lm_scoring.op3(spark, sf[0]).collect()
    same([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got], want)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_model_trains_on_every_window(spark):
    import public_tokenizers

    path, attention = public_tokenizers.path(lm_scoring.TOKENIZER), lm_scoring.A
    ids = lm_scoring.Ids(path)
    classes, _ = attention.class_map(np.zeros(ids.n, np.int64), ids.starts)
    flat, bigram = attention.initial(), np.full((attention.CLASSES + 1, attention.CLASSES), -np.log(attention.CLASSES))
    texts = [prose(int(n)) for n in RNG.integers(0, 400, 60)]
    v = lm_scoring.Vocabulary(path)
    held = [lm_scoring.words(t) for t in texts]
    c, lens, _ = lm_scoring.sequences(v, v.numbers(held), np.array([len(h) for h in held]), classes)
    n = len(attention.windows(c, lens)[0])
    once = [pd.concat(lm_scoring._trainer(path, SimpleNamespace(value=(flat, bigram, classes)), k)(iter([pd.DataFrame({"text": texts[:20]}), pd.DataFrame({"text": texts[20:]})]))) for k in (0, 1)]
    assert all((t["weight"] == n).all() for t in once)
    assert not np.allclose(once[0]["value"], once[1]["value"])  # a seed of its own for each round
    taken = []
    step = attention.Model.gradient
    with pytest.MonkeyPatch.context() as m:
        m.setattr(attention.Model, "gradient", lambda self, x, y, s: (taken.extend(map(bytes, np.ascontiguousarray(x))), step(self, x, y, s))[1])
        x, y, s = attention.windows(c, lens)
        x = x.copy()
        x[:, 0] = np.arange(n) % attention.CLASSES
        attention.fit(flat, bigram, iter([(x[:100], y[:100], s[:100]), (x[100:], y[100:], s[100:])]), 1, np.random.default_rng(1))
    assert sorted(taken) == sorted(map(bytes, np.ascontiguousarray(x)))
    training = spark.range(500).select(F.xxhash64("id").alias("h"))
    assert sum(lm_scoring.of_round(training, k).count() for k in range(lm_scoring.ROUNDS)) == 500


def test_decontaminate(spark, sf):
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for i, t in ((1, sf[2]), (2, "one two")):
        x = rule.findall(low(t))
        k = min(13, len(x))
        for a in range(len(x) - k + 1):
            wins[tuple(x[a : a + k])].add(str(i))
    want = []
    for d, t, *_ in sf[1]:
        x = rule.findall(low(t))
        hit, items = set(), set()
        for k in {len(g) for g in wins}:
            for a in range(len(x) - k + 1):
                if (g := tuple(x[a : a + k])) in wins:
                    hit.update(range(a, a + k))
                    items |= wins[g]
        want.append((d, len(x), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(x)))
    got = decontaminate.op4(spark, sf[0]).collect()
    same([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got], want)


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "a b " + " ".join("k%d" % i for i in range(13)) + ", " + "c " * 400)], "doc_id int, text string")
    bench = spark.createDataFrame([(1, " ".join("K%d" % i for i in range(13)))], "item_id int, text string")
    assert decontaminate.decontaminate(docs, bench).first()["text"] == "a b , " + "c " * 400


def test_jaccard(spark, sf):
    rows = sf[1]
    sets = []
    for _, t, *_ in rows:
        x = words(low(t))
        sets.append({tuple(x[i : i + 5]) for i in range(len(x) - 4)} if len(x) > 4 else {tuple(x)} if x else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)].append(r[0])
    want = [(r[0], len(sets[i]), min(least[root(i)], default=None)) for i, r in enumerate(rows)]
    same([tuple(r) for r in jaccard.op5(spark, sf[0]).collect()], want)
    kept = jaccard.stage(spark, spark.read.parquet(f"{sf[0]}/documents.parquet"), sf[0])
    assert kept.count() == len({root(i) for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)


def test_jaccard_keys_reach_every_link():
    rng = np.random.default_rng(3)
    counts = np.zeros(jaccard.CLASSES, np.int64)
    counts[: 1 << 12] = rng.integers(15, 19, 1 << 12)  # on both sides of the limit, which is just over 16
    order = jaccard.Order(counts)
    linked = 0
    for _ in range(4000):
        n = int(rng.integers(2, 70))
        pool = np.unique(rng.integers(0, 1 << 55, 2 * n, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = (np.unique(np.concatenate((pool[: n - k], pool[n + 4 * i : n + 4 * i + j]))) for i, k, j in ((0, *rng.integers(0, 4, 2)), (1, *rng.integers(0, 4, 2))))
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < 75 * (len(a) + len(b) - both):
            continue
        linked += 1
        (ka, _, ra), (kb, _, rb) = order.keys(a), order.keys(b)
        reach = dict(zip(kb.tolist(), rb.tolist(), strict=True))
        assert any(k in reach and min(r, reach[k]) >= both for k, r in zip(ka.tolist(), ra.tolist(), strict=True)), (len(a), len(b), both)
    assert linked > 1000


def test_jaccard_links_around_the_frequency_limit(spark):
    rng = np.random.default_rng(12)
    some = lambda n: " ".join("q%d" % i for i in rng.integers(0, 10**9, n))
    texts, pairs = [], []
    for _ in range(12):
        x = some(13)
        pairs.append((len(texts), len(texts) + 1))
        texts += [x + " " + some(1), x + " " + some(1)]
        for k, n in enumerate(rng.integers(13, 18, 9)):  # and two texts of the pair: 15 to 19 sets share each shingle
            texts += [" ".join([some(20), *x.split()[k : k + 5], some(20)]) for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.grouped(docs).collect()}
    assert [(a, b) for a, b in pairs if got[a] != got[b]] == []
    assert len(set(got.values())) == len(texts) - len(pairs)


def test_pii(spark, sf):
    got = {r["doc_id"]: r for r in pii.op6(spark, sf[0]).where("doc_id IS NOT NULL").collect()}
    mail = next(r[0] for r in sf[1] if (r[1] or "").startswith("write to"))
    assert (got[mail]["n_email"], got[mail]["n_phone"]) == (2, 1)
    nums = next(r[0] for r in sf[1] if (r[1] or "").startswith("10.2.3.4"))
    assert got[nums]["n_ip"] == 3 and got[nums]["spans"].startswith("ip:0:8")
    assert len(pii.op6(spark, sf[0]).collect()) == len(sf[1])


def luhn(n):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(n)))) % 10 == 0


def base_spans(text):
    number = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(number(m)) <= 19 and luhn(number(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(number(m)) <= 15),
    )
    found = [(m.start(), k, m.end()) for k, (_, rule, good) in enumerate(rules) for m in re.finditer(rule, text or "") if good(m[0])]
    return [f"{rules[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


@pytest.mark.parametrize("real", [False, True])
def test_pii_base_spans(spark, sf, real):
    d = "/root/testdata/sf0.01" if real else sf[0]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, hashlib.sha256(",".join(x).encode()).hexdigest(), *(sum(y.startswith(k) for y in x) for k in pii.KINDS)) for i, t in rows for x in [base_spans(t)]]
    got = pii.op6(spark, d).collect()
    same([(r["doc_id"], r["base_sha256"], *(r[f"n_{k}"] for k in pii.KINDS)) for r in got], want)
    if real:  # patterns find identifiers in the test tables, and every one is a number after a token sign
        texts = dict(rows)
        added = [(r["doc_id"], s) for r in got for s in r["spans"].split(",") if r["n_added"] and s not in base_spans(texts[r["doc_id"]])]
        assert added and all(re.fullmatch("[0-9a-f]{40}", texts[i][int(a) : int(b)]) for i, s in added for _, a, b in [s.split(":")])


def test_pii_secrets_need_a_context(spark):
    value = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'so the token = "{value(i)}" was lost') for i in range(6)] + [(50, 'my token = "Zx81-33aq-7720" is here'), (51, f"commit {value(99)} was here")]
    got = {r["doc_id"]: [x["kind"] for x in r["spans"]] for r in pii.extract(spark.createDataFrame(rows, "doc_id int, text string")).selectExpr("doc_id", "spans").collect()}
    assert all(got[i] == [4] for i in (*range(6), 50)) and not got[51]


def test_pii_learns_a_pattern(spark):
    rows = [(i, f"and so my phone is +1 (20{i}) 555-343{i} ok") for i in range(8)] + [(50, "and so my phone is 5553-4367 ok"), (51, "room 5553-4367x here")]
    got = {r["doc_id"]: r["spans"] for r in pii.extract(spark.createDataFrame(rows, "doc_id int, text string")).selectExpr("doc_id", "spans").collect()}
    assert len(got[50]) == 1 and not got[51]


def test_attention_gradient_is_the_slope():
    attention, rng = lm_scoring.A, np.random.default_rng(3)
    flat = attention.initial() + rng.normal(0, 0.1, attention.PARAMETERS)
    bigram = np.log(rng.dirichlet(np.ones(attention.CLASSES), attention.CLASSES + 1))
    lens = np.array([1, 5, 32, 33, 90])
    c = rng.integers(0, attention.CLASSES, lens.sum())
    x, y, scored = attention.windows(c, lens)
    loss, g = attention.Model(flat, bigram).gradient(x, y, scored)
    lp, _ = attention.Model(flat.astype(np.float32), bigram).log_probability(x, y, 80)
    assert abs(loss + lp[scored].mean()) < 1e-4
    at = 0
    for name in attention.NAMES:  # along a random direction in each array of the parameters
        way = np.zeros(attention.PARAMETERS)
        way[at : at + attention.SIZES[name]] = rng.normal(size=attention.SIZES[name])
        at += attention.SIZES[name]
        up, down = (attention.Model(flat + e * way, bigram).gradient(x, y, scored)[0] for e in (1e-3, -1e-3))
        assert abs((up - down) / 2e-3 - g @ way) < 1e-2 * (abs(g @ way) + 0.05), name


def test_attention_with_large_logits():
    attention, rng = lm_scoring.A, np.random.default_rng(4)
    flat = attention.initial() + rng.normal(0, 0.1, attention.PARAMETERS)
    bigram = np.log(rng.dirichlet(np.ones(attention.CLASSES), attention.CLASSES + 1))
    lens = np.array([3, 40, 70])
    x, y, scored = attention.windows(rng.integers(0, attention.CLASSES, lens.sum()), lens)
    for times in (1, 300):  # exponentials of these logits do not fit single precision as they are
        p = attention.parts(big := (flat * times).astype(np.float32))
        loss, g = attention.Model(big, bigram).gradient(x, y, scored)
        lp, _ = attention.Model(big, bigram).log_probability(x, y, 80)
        assert np.isfinite(g).all() and abs(loss + lp[scored].mean()) < 1e-4 * max(1, loss)
        assert attention.bounded(p["out"], bigram + p["skip"]) == (times == 1)


def test_texts_are_read_and_encoded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    docs = spark.createDataFrame([(i, prose(30)) for i in range(40)], "doc_id long, text string").mapInPandas(count, "doc_id long, text string")
    assert len(lm_scoring.score(docs, F.col("doc_id") % 7 == 2).collect()) == 40
    assert seen.value == 40


def test_encoded_words_and_keys(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path(lm_scoring.TOKENIZER)
    known = lm_scoring.known_ids(path)
    texts = ["", " \n", "a  B\tÉ a\x0b", "x\xa0y \x1c z", "z" * 5000, " ".join("q%d r%d" % (i, i * i) for i in range(20_000)), "end", "aa ab ba bb aab aba baa"] * 3
    rows = pa.table({"doc_id": range(len(texts)), "held_out": [False] * len(texts), "h": range(len(texts)), "text": texts})
    monkeypatch.setattr(lm_scoring, "BYTES", 5000)
    monkeypatch.setattr(lm_scoring, "BLOCK", 1000)
    got = pd.concat(b.to_pandas() for b in lm_scoring._encoder(path)(iter(rows.to_batches(max_chunksize=5))))
    held = [lm_scoring.words(t) for t in texts]
    assert got["doc_id"].tolist() == list(range(len(texts))) and got["n_words"].tolist() == [len(h) for h in held]
    ids = [np.frombuffer(b, "<u2") for b in got["ids"]]
    for h, i in zip(held, ids, strict=True):
        assert i.tolist() == (known.of(h)[0].tolist() if h else [])
    counts = pd.concat(lm_scoring._counter(SimpleNamespace(value=known.starts))(iter([got])))
    by_key = counts[counts["kind"] == lm_scoring.WORD].groupby("key")["n"].sum()
    assert sorted(by_key) == sorted(Counter(w for h in held for w in h).values())  # a key for each word
    keys = lm_scoring.Keys(known.n)
    pairs = np.array([(i, j) for i in range(300) for j in range(300)]).ravel()
    assert len(np.unique(keys.of(pairs, np.arange(0, len(pairs), 2)))) == 90_000
    found = np.unique(keys.of(np.concatenate(ids), np.flatnonzero(known.starts[np.concatenate(ids)])))
    scorer = lm_scoring.Scorer(lm_scoring.A.initial(), np.zeros((lm_scoring.A.CLASSES + 1, lm_scoring.A.CLASSES)), np.zeros(known.n, np.int16), 80, np.zeros(known.n), found[::2], np.arange(1, len(found[::2]) + 1), 1, 1, 1)
    assert scorer.counts(found).tolist() == [k // 2 + 1 if k % 2 == 0 else 0 for k in range(len(found))]


def test_memory_of_training_steps_is_kept():
    resource = pytest.importorskip("resource")
    lm_scoring.A.keep_pages()
    faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for k in range(20):
        if k == 10:
            before = faults()
        np.ones(250_000, np.float32) + np.ones(250_000, np.float32)
    assert faults() - before < 2_000  # each array is 244 pages: without it about 7,000


def test_quality(spark, sf):
    want = []
    for d, t, *_ in sf[1]:
        x = words(t)
        c = Counter(tuple(x[i : i + 8]) for i in range(len(x) - 7))
        rep = {j for i in range(len(x) - 7) if c[tuple(x[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [y for y in (t or "").split("\n") if words(y)]
        want.append((d, len(x), sum(map(len, x)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), len(x) < 20 or 100 * len(rep) > 30 * len(x)))
    got = quality_rules.op7(spark, sf[0]).collect()
    same([tuple(r)[:7] for r in got], want)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_rejects_bad_labels(spark):
    sf = "/root/testdata/sf0.1"
    told = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("quality").alias("best"), F.max("toxic").alias("toxic"))
    got = quality_rules.op7(spark, sf).where("NOT base_failed").join(told, "doc_id").groupBy("good", "best", "toxic").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    share = lambda rows: sum(r["kept"] for r in rows) / sum(r["n"] for r in rows)
    assert share([r for r in got if r["best"] == 0]) < 0.02
    assert share([r for r in got if r["good"] == 1]) > 0.99  # of these the toxic ones are not in the target


def test_quality_trusts_no_toxic_documents(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, None), (4, 1, 0), (4, 0, 0), (5, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    assert sorted(r["_id"] for r in quality_rules.trusted(labels).collect()) == [1, 3]


def test_quality_counts_all_trusted_documents(spark):
    n, marked, fit = 120_000, [], quality_rules.multinomials
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('w', id % 7) AS text")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality_rules, "multinomials", lambda rows: (marked.append(rows.where("fold > 0").count()), fit(rows))[1])
        quality_rules.judge(docs, spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic"))
    assert marked == [n]


def test_quality_scores_by_the_other_folds(spark, sf):
    docs = [(d, words(t)) for d, t, *_ in sf[1]]
    row = spark.createDataFrame([(d, w) for d, w in docs], "d long, w array<string>").select("d", quality_rules.grams(F.col("w")).alias("g"), F.expr("1 + pmod(xxhash64(d, 'fold'), 4)").alias("fold")).collect()
    good, size = {24, 27}, quality_rules.BUCKETS
    raw = Counter(b for r in row for b in r["g"])
    of = {f: Counter(b for r in row if r["d"] in good and r["fold"] != f for b in r["g"]) for f in range(5)}
    want = []
    for r in row:
        c = of[r["fold"] if r["d"] in good and sum(of[r["fold"]].values()) else 0]
        each = [np.log((c[b] + 1) / (sum(c.values()) + size)) - np.log((raw[b] + 1) / (sum(raw.values()) + size)) for b in r["g"]]
        want.append((r["d"], round(float(np.mean(each)) if each else 0.0, 4) + 0.0))
    same([(r["doc_id"], round(r["llr"], 4) + 0.0) for r in quality_rules.op7(spark, sf[0]).collect()], want)


def test_language(spark, sf):
    got = language_id.op8(spark, sf[0]).collect()
    assert len(got) == len(sf[1])
    t = {r[0]: r[1] for r in sf[1]}
    for r in got:
        letters = any(c.isalpha() for c in (t[r["doc_id"]] or "")) or r["doc_id"] is None
        assert letters or r["lang_pred"] == "und"
        assert 0 <= r["score"] <= 1


def plain_language(rows, trains):
    """Naive Bayes of whole texts, one n-gram after the other."""

    def buckets(t):
        code = [ord(c) for c in t.lower()]
        for k, order in enumerate(language_id.ORDERS):
            for i in range(len(code) - order + 1):
                state = 0
                for c in code[i : i + order]:
                    state = (state * 0x01000193 + c * 0x9E3779B1) % 2**32
                yield k, ((state ^ state >> 15) * 0x85EBCA6B % 2**32) >> 32 - language_id.BITS

    grams, docs = defaultdict(Counter), Counter()
    for t, lang in ((t, lang) for t, lang, learn in zip(*rows, trains, strict=True) if learn and t is not None and lang is not None):
        grams[lang].update(buckets(t))
        docs[lang] += 1
    sizes = {lang: Counter() for lang in grams}
    for lang, c in grams.items():
        for (k, _), n in c.items():
            sizes[lang][k] += n
    out = []
    for t in rows[0]:
        if not docs or not any(map(str.isalpha, t or "")):
            out.append(("und", 0.0))
            continue
        own = Counter(buckets(t))
        value = {lang: np.log(docs[lang]) + sum(n * np.log((c[b] + 0.5) / (sizes[lang][b[0]] + 0.5 * 2**language_id.BITS)) for b, n in own.items()) for lang, c in sorted(grams.items())}
        best = max(value, key=value.get)
        out.append((best, 1 / sum(np.exp(v - value[best]) for v in value.values())))
    return out


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert a[:-1] == b[:-1] and abs(a[-1] - b[-1]) < 1e-3, (a, b)


def test_language_brute_force(spark, sf):
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in sf[1]]
    want = plain_language(([r[1] for r in sf[1]], [r[2] for r in sf[1]]), [r[0] is not None and not h for r, h in zip(sf[1], held, strict=True)])
    close([tuple(r) for r in language_id.op8(spark, sf[0]).collect()], [(r[0], h, *w) for r, h, w in zip(sf[1], held, want, strict=True)])


def test_language_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(map(chr, 97 + 3 * (i % 5) + rng.integers(0, 6, 4))) for _ in range(6)) for i in range(40)] + [None, "", "12"]
    langs = ["l%d" % (i % 5) for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(range(len(texts)), texts, langs, strict=True)), "doc_id long, text string, lang string")
    want = [(i, *w) for i, w in enumerate(plain_language((texts, langs), [True] * len(texts)))]
    for most in (256, 5, 2):
        monkeypatch.setattr(language_id, "MAX_LANGUAGES", most)
        close([tuple(r) for r in language_id.identify(docs, F.lit(False)).select("doc_id", "predicted.*").collect()], want)


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.op8(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").selectExpr("avg(CAST(lang = lang_pred AS INT)) AS a").first()
    assert got["a"] > 0.95


def repeated(raw, n):
    """A mask of the bytes of each text that a string of n bytes covers that is there twice."""
    c = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if c[b[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return out


def test_suffixes(spark, sf, monkeypatch):
    raw = [(t or "").encode() for _, t, *_ in sf[1]]
    want = []
    for (d, *_), b, gone, told in zip(sf[1], raw, repeated(raw, suffix_dedup.LENGTH), repeated(raw, suffix_dedup.PASSAGE), strict=True):
        rest = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        edge = np.flatnonzero(np.diff(told.astype(int), prepend=0, append=0))
        passages = sum(len(b[x:y].split()) > suffix_dedup.WORDS for x, y in zip(edge[::2], edge[1::2], strict=True))
        want.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest(), passages))
    assert sum(w[5] > 0 and not w[2] for w in want)  # a passage under LENGTH bytes is told and stays
    same([tuple(r) for r in suffix_dedup.op9(spark, sf[0]).collect()], want)
    monkeypatch.setattr(suffix_dedup, "CROWD", 1)
    same([tuple(r) for r in suffix_dedup.op9(spark, sf[0]).collect()], want)


def test_mixing(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{sf[0]}/documents.parquet/*.parquet'")
    c.sql(f"CREATE VIEW labels AS FROM '{sf[0]}/labels.parquet/*.parquet'")
    got = mixing.op10(spark, sf[0])
    want = c.sql(mixing.ORACLE)
    total = lambda rows, i, j: sorted(Counter((r[i], r[j]) for r in rows).items(), key=repr)
    rows = [tuple(r) for r in got.select(*want.columns).collect()]
    assert total(rows, 0, 1) == total(want.fetchall(), 0, 1)
    assert all(r["taken"] <= 3 * r["size"] for r in got.collect())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []


def test_pipeline_columns(spark, sf):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet").withColumn("predicted", sharding.F.lit(1)).withColumn("Shard", sharding.F.lit(2)).withColumn("size", sharding.F.lit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf[0]).columns == docs.columns, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf[0])
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count()


def plain_targets(sizes):
    """The contract's shares: 5, 2, 1 by code point, null last, none above 3 times its source's size."""
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(sorted(sizes, key=lambda n: (n is None, n or "")))}
    out, todo, left = {}, set(sizes), sum(sizes.values())
    while todo:
        whole = sum(weight[n] for n in todo)
        over = {n for n in todo if left * weight[n] / whole > 3 * sizes[n]}
        if not over:
            return out | {n: left * weight[n] / whole for n in todo}
        out |= {n: 3 * sizes[n] for n in over}
        left -= sum(out[n] for n in over)
        todo -= over
    return out


def test_pipeline_brute_force(spark, sf):
    docs, after = spark.read.parquet(f"{sf[0]}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf[0]), name)
        after.append([tuple(r) for r in docs.select("doc_id", "text", "source", *(["shard", "slot"] if name == "sharding" else [])).collect()])
    known, distinct, clean, mixed, placed = after

    # of two languages the better one always has half the probability, so only texts without a letter go
    same(known, [(d, t, s) for d, t, _, s, _ in sf[1] if any(map(str.isalpha, t or ""))])

    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} or {tuple(x)} for x in (words(low(t)) for _, t, _ in known)]
    group = list(range(len(known)))
    for i in range(len(known)):
        for j in range(i):
            if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    of = {(d, t): g for (d, t, _), g in zip(known, group, strict=True)}
    assert Counter(of[d, t] for d, t, _ in distinct) == Counter(set(group))
    for d, t, _ in distinct:
        ids = [x for (x, _), g in of.items() if g == of[d, t]]
        assert None in ids or d == min(ids)

    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(x[a : a + 13]) for x in (rule.findall(low(sf[2])), ["one", "two"]) for a in range(max(1, len(x) - 12))}

    def contaminated(t):
        x = rule.findall(low(t))
        hit = {i for k in {len(w) for w in windows} for a in range(len(x) - k + 1) if tuple(x[a : a + k]) in windows for i in range(a, a + k)}
        return bool(hit) and 20 * len(hit) >= len(x)

    assert any(contaminated(t) for _, t, _ in distinct)
    same(clean, [r for r in distinct if not contaminated(r[1])])

    size, most, taken = Counter(), Counter(), Counter()
    for _, t, s in clean:
        size[s] += len(words(t))
        most[s] = max(most[s], len(words(t)))
    for _, t, s in mixed:
        taken[s] += len(words(t))
    there, copies = Counter(clean), Counter(mixed)
    assert all(n <= 3 * there[r] for r, n in copies.items())
    assert all(abs(taken[s] - t) <= most[s] for s, t in plain_targets(size).items())

    same([r[:3] for r in placed], mixed)
    slots = defaultdict(list)
    for r in placed:
        slots[r[3]].append(r[4])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(0 <= k < 40 for k in slots)
