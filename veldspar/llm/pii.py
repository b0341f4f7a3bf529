"""Personal data by bootstrapped contextual extraction, in DataFrame operations alone.

Base patterns find e-mail addresses, IP addresses, cards and phone numbers: the seeds. Long hexadecimal numbers are seeds
of secrets, which are spans only if a trusted pattern precedes them. The two and the three words before an entity are its
lexical patterns. A pattern-instance graph is scored in rounds: a pattern's confidence is the mean
score of the distinct identifiers it precedes (seeds have score 1), an unseen identifier's score is that of its best
pattern. Patterns with enough seeds and confidence add the identifiers they precede to the spans.

The base expressions are written with possessive quantifiers and anchored at the start of a run of their characters (or
the end of the last match), which finds the same matches in linear time on any text.

Defined results: null and empty texts have no spans; positions are code points; repeated rows count once in the graph
(patterns and identifiers are distinct) and all get their spans; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .quality_rules import let

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans: what the patterns add may also be a secret.
NAMES = (*KINDS, "secret")
SECRET = r"^(?=[0-9]*[a-f])[0-9a-f]{32,}\z"
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:[0-9]{2,}+|[0-9][ -][0-9]++)(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text with a valid match has at least; cheap to test.
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][ -]?){11}[0-9]", "phone": r"\+[0-9]"}
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Identifiers that a pattern may discover: of these characters, with so many digits.
IDENTIFIER = r"(?<![A-Za-z0-9_.@+-])[A-Za-z_.@+-]*+[0-9][A-Za-z0-9_.@+-]*+"
LEAST_DIGITS, LEAST_LENGTH = 4, 6
CONTEXT = 64
ROUNDS = 3
SUPPORT, CONFIDENCE = 3, 0.75


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Of a string of at most 19 digits; zeros in front change nothing."""
    padded = F.lpad(number, 19, "0")

    def value(i: int) -> Column:
        d = F.substring(padded, i, 1).cast("int")
        return d if i % 2 else F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)

    return sum((value(i) for i in range(2, 20)), value(1)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}\z")
    if kind in ("card", "phone"):
        n = F.length(digits(m))
        return F.when(n.between(12, 19), luhn(digits(m))).otherwise(F.lit(False)) if kind == "card" else n.between(9, 15)
    return F.lit(True)


def placed(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` as (start, end, m), from the gaps that split() leaves between matches."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    kind = "array<struct<start:int,end:int,m:string>>"

    def step(a: Column, z: Column) -> Column:
        start = a["at"] + F.length(z["g"])
        end = start + F.length(z["m"])
        return F.struct(end.alias("at"), F.concat(a["all"], F.array(F.struct(start.alias("start"), end.alias("end"), z["m"].alias("m")))).alias("all"))

    def run(m: Column) -> Column:
        pairs = F.arrays_zip(F.slice(gaps, 1, F.size(m)).alias("g"), m.alias("m"))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("all")), step, lambda a: a["all"])

    return let(found, run)


def base_spans(text: Column) -> Column:
    """Array of (start, rank of the kind, end, m) in order of start, then kind."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,m:string>>")

    def of(k: int, kind: str) -> Column:
        ok = F.filter(placed(text, BASE[kind]), lambda s: valid(kind, s["m"]))
        spans = F.transform(ok, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["m"].alias("m")))
        return F.when(text.rlike(HINT[kind]), spans).otherwise(empty)

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def unseen(text: Column, spans: Column) -> Column:
    """Identifiers outside the base spans, as spans without a kind, but for the seeds of secrets."""
    good = lambda s: (F.length(digits(s["m"])) >= LEAST_DIGITS) & (F.length(s["m"]) >= LEAST_LENGTH) & ~F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    out = F.transform(F.filter(placed(text, IDENTIFIER), good), lambda s: F.struct(s["start"].alias("start"), F.when(s["m"].rlike(SECRET), len(KINDS)).alias("kind"), s["end"].alias("end"), s["m"].alias("m")))
    return F.when(text.rlike(r"[0-9]{2}|[0-9][A-Za-z_.@+-]+[0-9]"), out).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,m:string>>"))


def patterns(text: Column, start: Column) -> Column:
    """The last two and the last three words before a place, in lower case with digits as 0."""
    before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    words = F.filter(F.split(F.regexp_replace(F.lower(before), "[0-9]", "0"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return let(words, lambda w: F.transform(F.filter(F.array(F.lit(2), F.lit(3)), lambda n: F.size(w) >= n), lambda n: F.array_join(F.slice(w, -n, n), " ")))


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (the base spans) and spans (all spans) of every row."""
    d = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("base", base_spans(F.col("text"))).withColumn("more", unseen(F.col("text"), F.col("base")))
    seen = F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lower(s["m"]).alias("value"), patterns(F.col("text"), s["start"]).alias("patterns")))
    d = common.stored(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", F.when((F.size("base") > 0) | (F.size("more") > 0), seen).alias("seen")), "pii-instances")
    edges = d.select("row", F.explode("seen").alias("s")).select("row", "s.start", "s.kind", "s.end", "s.value", F.explode("s.patterns").alias("pattern"))
    graph = common.stored(edges.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "pii-graph")
    score = graph.select("value", "kind").groupBy("value").agg(F.max(F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)).alias("score"))
    for k in range(ROUNDS):
        scored = graph.join(score, "value")
        conf = scored.groupBy("pattern").agg(F.avg("score").alias("confidence"), F.count("kind").alias("seeds"), F.count("*").alias("values"), F.mode("kind", True).alias("most"))
        conf = common.stored(conf, f"pii-patterns-{k}")
        found = graph.join(conf.where(F.col("seeds") >= SUPPORT).select("pattern", "confidence"), "pattern", "left")
        score = common.stored(found.groupBy("value").agg(F.max(F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("confidence", F.lit(0.0)))).alias("score")), f"pii-scores-{k}")
    trusted = conf.where((F.col("seeds") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("pattern", "most")
    new = edges.where(F.col("kind").isNull() | (F.col("kind") == len(KINDS))).join(trusted, "pattern").groupBy("row", "start", "end").agg(F.min("most").alias("kind"))
    new = new.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))  # of one document
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = d.join(new, "row", "left").withColumn("bare", bare)
    return out.select("doc_id", F.col("bare").alias("base"), F.array_sort(F.concat("bare", F.coalesce("new", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def op6(spark, sf_dir: str) -> DataFrame:
    found = extract(common.documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))
