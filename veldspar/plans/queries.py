"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arithmetic as A
from ..functions import numbers as N
from ..functions import text as X
from ..operators import comprehension as C
from ..operators import frames as R
from ..operators import schema as S
from ..operators import values as V
from ..functions.registry import MATH
from ..sources import jsonschema, openapi

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LINE = S.struct(l_quantity=S.between(5, 45), l_returnflag=S.one_of("A", "N"), l_discount=S.between(0.0, 0.1))


@query("""SELECT 'l_quantity' AS path, count(*) FILTER (WHERE NOT l_quantity BETWEEN 5 AND 45)::BIGINT AS n FROM lineitem
UNION ALL SELECT 'l_returnflag', count(*) FILTER (WHERE l_returnflag NOT IN ('A','N'))::BIGINT FROM lineitem
UNION ALL SELECT 'l_discount', count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.1)::BIGINT FROM lineitem""")
def vet_lineitem_bounds(t):
    d = t("lineitem")
    return d.agg(*[F.count_if(~S.matches(f.schema, d[n])).alias(n) for n, f in LINE.fields]).unpivot([], [n for n, _ in LINE.fields], "path", "n")


@query("""SELECT path, code, count(*)::BIGINT AS n FROM (SELECT 'l_quantity' AS path, 'bound' AS code FROM lineitem WHERE l_quantity < 5
UNION ALL SELECT 'l_quantity', 'bound' FROM lineitem WHERE l_quantity > 45
UNION ALL SELECT 'l_returnflag', 'value' FROM lineitem WHERE l_returnflag NOT IN ('A','N')) GROUP BY ALL""")
def vet_violation_rows(t):
    return S.vet(t("lineitem"), LINE).select(F.explode("violations").alias("v")).groupBy("v.path", "v.code").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 AND l_returnflag IN ('A','N') AND l_discount BETWEEN 0 AND 0.1")
def vet_filter_valid(t):
    d = t("lineitem")
    for n, f in LINE.fields:
        d = d.where(S.matches(f.schema, d[n]))
    return d.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


STATUS = S.Const("O").default() | S.one_of("F", "P")


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'O') AS o_orderstatus FROM orders")
def default_fill(t):
    d = t("orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"))
    return S.complete_frame(d, S.struct(o_orderstatus=STATUS))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS o_orderstatus FROM orders")
def trim_defaults(t):
    d = t("orders")
    return d.select("o_orderkey", S.trim(STATUS, d["o_orderstatus"]).alias("o_orderstatus"))


@query("SELECT branch, count(*)::BIGINT AS n FROM (SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_brand = 'Brand#1' THEN 'brand' ELSE 'none' END AS branch FROM part) GROUP BY branch")
def disjunction_branch(t):
    d = t("part")
    small, brand = S.Bound("<", 10), S.Const("Brand#1")
    return d.select(F.when(S.matches(small, d["p_size"]), "small").when(S.matches(brand, d["p_brand"]), "brand").otherwise("none").alias("branch")).groupBy("branch").agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM part WHERE (p_size >= 10)::INT + (p_size <= 30)::INT + (p_size != 20)::INT = 2")
def matchn_count(t):
    d = t("part")
    return d.where(S.matches(S.MatchN(S.Const(2), (S.Bound(">=", 10), S.Bound("<=", 30), S.Bound("!=", 20))), d["p_size"])).agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM events WHERE NOT CASE WHEN event_type = 'purchase' THEN coalesce(value >= 1, false) ELSE true END")
def matchif_events(t):
    d = t("events")
    purchase = S.struct(event_type=S.Const("purchase"))
    rule = S.MatchIf(purchase, S.struct(value=S.Bound(">=", 1)), S.Any())
    e = d.select(F.struct("event_type", "value").alias("e"))
    return e.where(~S.matches(rule, e["e"], e.schema["e"].dataType)).agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM part WHERE p_size >= 11 AND p_size < 40")
def bound_simplify(t):
    d = t("part")
    s = S.Kind("int") & S.Bound(">=", 3) & S.Bound(">", 10.5) & S.Bound("<", 60) & S.Bound("<", 40)
    assert s == S.All((S.Kind("int"), S.Bound(">=", 11), S.Bound("<", 40)))
    return d.where(S.matches(s, d["p_size"])).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal < 0),
b AS (SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal + 1 ELSE c_acctbal END AS bal, c_name AS name FROM customer WHERE c_mktsegment <> 'AUTOMOBILE' AND c_acctbal >= 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN coalesce(a.bal <> b.bal, false) THEN NULL ELSE coalesce(a.bal, b.bal) END AS bal, coalesce(a.bal <> b.bal, false) AS bal_conflict, seg, name FROM a FULL JOIN b ON a.k = b.k""")
def unify_frames(t):
    c = t("customer")
    a = c.where("c_mktsegment <> 'BUILDING' OR c_acctbal < 0").selectExpr("c_custkey AS k", "c_acctbal AS bal", "c_mktsegment AS seg")
    b = c.where("c_mktsegment <> 'AUTOMOBILE' AND c_acctbal >= 0").selectExpr("c_custkey AS k", "CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal + 1 ELSE c_acctbal END AS bal", "c_name AS name")
    return R.unify_frames(a, b, ["k"])


@query("SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS l_returnflag, coalesce(min(l_returnflag) <> max(l_returnflag), false) AS l_returnflag_conflict FROM lineitem GROUP BY l_orderkey")
def unify_aggregate(t):
    return R.unify_aggregate(t("lineitem"), ["l_orderkey"], ["l_returnflag"])


@query("SELECT l_orderkey, max_by(l_returnflag, (l_linenumber::BIGINT, l_returnflag)) AS l_returnflag FROM lineitem GROUP BY l_orderkey")
def layered_priority(t):
    return R.layered(t("lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber")


@query("SELECT count(*) FILTER (WHERE text IS NULL)::BIGINT AS text_missing, count(*) FILTER (WHERE lang IS NULL OR lang NOT IN ('en','de','fr','es'))::BIGINT AS lang_bad, count(*) FILTER (WHERE n_chars <> length(text))::BIGINT AS count_bad, count(*) FILTER (WHERE n_chars > 10000)::BIGINT AS long FROM documents")
def required_optional(t):
    d = t("documents")
    lang = S.one_of("en", "de", "fr", "es")
    return d.agg(F.count_if(d["text"].isNull()).alias("text_missing"), F.count_if(~S.matches(lang, d["lang"])).alias("lang_bad"), F.count_if(d["n_chars"] != F.char_length("text")).alias("count_bad"), F.count_if(~S.matches(S.Bound("<=", 10000), d["n_chars"])).alias("long"))


PROPS = "map<string,bigint>"


@query("SELECT count(*)::BIGINT AS n FROM events WHERE NOT (len(json_keys(props)) = 1 AND json_keys(props)[1] = 'k' AND coalesce((props->>'$.k')::BIGINT BETWEEN 0 AND 49, false))")
def closedness_props(t):
    d = t("events")
    s = S.Struct((("k", S.Field(S.Bound(">=", 0) & S.Bound("<", 50), "required")),), (), True)
    return d.where(F.size(S.map_violations(s, F.from_json("props", PROPS))) > 0).agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM events WHERE coalesce((props->>'$.k')::BIGINT < 20, false)")
def pattern_constraint(t):
    s = S.Struct((), (("^[a-z]$", S.Bound(">=", 20)),), False)
    return t("events").where(F.size(S.map_violations(s, F.from_json("props", PROPS))) > 0).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE NOT l_quantity BETWEEN 1 AND 50) = 0 AS loose, count(*) FILTER (WHERE NOT l_quantity BETWEEN 5 AND 45) = 0 AS tight, count(*) FILTER (WHERE NOT l_quantity BETWEEN 0 AND 60) = 0 AS wide FROM lineitem")
def subsume_check(t):
    d = t("lineitem")
    loose, tight, wide = S.between(1, 50), S.between(5, 45), S.between(0, 60)
    assert S.subsumes(wide, loose) and S.subsumes(loose, tight) and not S.subsumes(tight, loose)
    # what subsumes a constraint that all rows satisfy needs no look at the rows
    got = d.agg(*[(F.count_if(~S.matches(s, d["l_quantity"], d.schema["l_quantity"].dataType)) == 0).alias(n) for n, s in (("loose", loose), ("tight", tight))])
    return got.select("loose", "tight", F.when(F.col("loose"), F.lit(S.subsumes(wide, loose))).alias("wide"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def comp_for_if(t):
    return C.each(t("orders")).if_("o_orderstatus = 'F'").if_("o_totalprice > 200000").yield_("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount))::BIGINT AS net FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
def comp_for_let(t):
    return C.each(t("lineitem")).let(let_net="l_extendedprice * (1 - l_discount)").if_("let_net > 50000").yield_("l_orderkey", "l_linenumber", net="floor(let_net)")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
def comp_join_equi(t):
    return C.each(t("orders")).for_(t("customer"), "o_custkey = c_custkey").if_("c_acctbal < 0").yield_("o_orderkey", "c_name")


@query("SELECT c_mktsegment, l_returnflag, count(*)::BIGINT AS n, sum(l_quantity)::DECIMAL(38,2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def comp_join_three(t):
    j = C.each(t("lineitem")).for_(t("orders"), "l_orderkey = o_orderkey").for_(t("customer"), "o_custkey = c_custkey").yield_("c_mktsegment", "l_returnflag", "l_quantity")
    return j.groupBy("c_mktsegment", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("decimal(38,2)").alias("qty"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def comp_theta(t):
    return C.each(t("nation")).for_(t("region"), "n_regionkey < r_regionkey").yield_("n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def comp_semi(t):
    return C.each(t("customer")).where_any(t("orders").where("o_orderpriority = '1-URGENT'"), "o_custkey = c_custkey").yield_("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def comp_anti(t):
    return C.each(t("customer")).where_none(t("orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"), "o_custkey = c_custkey").yield_("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 0 UNION ALL SELECT -count(*)::BIGINT FROM orders HAVING count(*) FILTER (WHERE o_totalprice < 0) = 0")
def comp_or_else(t):
    none = C.each(t("orders")).if_("o_totalprice < 0").yield_("o_orderkey")
    return C.or_else(none, t("orders").agg((-F.count("*")).alias("o_orderkey")))


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def comp_lookup(t):
    return R.lookup(t("supplier"), t("nation"), "s_nationkey", "n_nationkey").select("s_suppkey", "n_name")


@query("SELECT o_orderkey, coalesce(c_name, 'none') AS who FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON o_custkey = c_custkey")
def comp_else(t):
    return C.each(t("orders")).try_(t("customer").where("c_acctbal > 9000"), "o_custkey = c_custkey", c_name="none").yield_("o_orderkey", who="c_name")


@query("SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS o_orderstatus, min(o_orderstatus) <> max(o_orderstatus) AS o_orderstatus_conflict FROM orders GROUP BY o_custkey")
def comp_group_keyed(t):
    return R.keyed(t("orders"), "o_custkey", "o_orderstatus")


@query("SELECT l_orderkey, sum(l_quantity)::DECIMAL(38,2) AS s, round(avg(l_quantity), 6) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey")
def list_sum_avg_min_max(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("decimal(38,2)").alias("s"), F.round(F.avg("l_quantity"), 6).alias("a"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count("*").alias("n"))


@query("SELECT p_brand, round(ln(product(1 + p_size / 10000.0)), 6) AS p FROM part GROUP BY p_brand")
def list_product(t):
    return t("part").groupBy("p_brand").agg(F.round(F.log(F.product(1 + F.col("p_size") / 10000.0)), 6).alias("p"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def list_sort_topk(t):
    return R.take(t("orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT l_orderkey, max(n) = 1 AS unique_items FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def list_unique_items(t):
    return R.unique_items(t("lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT o_custkey, NOT bool_or(coalesce(before > o_totalprice, false)) AS is_sorted FROM (SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) GROUP BY o_custkey")
def list_is_sorted(t):
    return R.is_sorted(t("orders"), "o_custkey", "o_totalprice", "o_orderdate", "o_orderkey")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice, p_partkey LIMIT 20 OFFSET 10")
def list_slice_drop(t):
    return R.nth_range(t("part"), 10, 30, "p_retailprice", "p_partkey").select("p_partkey", "p_name")


@query("SELECT 'c' AS kind, c_name AS name FROM customer UNION ALL SELECT 's', s_name FROM supplier")
def list_concat(t):
    return t("customer").select(F.lit("c").alias("kind"), F.col("c_name").alias("name")).unionByName(t("supplier").select(F.lit("s").alias("kind"), F.col("s_name").alias("name")))


@query("SELECT 'both' AS side, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT 'only', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def set_intersect_except(t):
    s = t("supplier")
    a = t("customer").select(F.col("c_nationkey").alias("k")).intersect(s.where("s_acctbal > 5000").select("s_nationkey"))
    b = t("nation").select(F.col("n_nationkey").alias("k")).subtract(s.where("s_acctbal > 9000").select("s_nationkey"))
    return a.select(F.lit("both").alias("side"), "k").union(b.select(F.lit("only").alias("side"), "k"))


@query("""WITH a AS (SELECT p_partkey, p_size, p_brand FROM part WHERE p_size < 45), b AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN p_size + 1 ELSE p_size END AS p_size, p_brand FROM part WHERE p_size > 5)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.p_partkey IS NULL THEN 'added' WHEN a.p_size = b.p_size AND a.p_brand = b.p_brand THEN 'identical' ELSE 'modified' END AS change FROM a FULL JOIN b USING (p_partkey)""")
def diff_frames(t):
    p = t("part").select("p_partkey", "p_size", "p_brand")
    new = p.where("p_size > 5").withColumn("p_size", F.expr("CASE WHEN p_brand = 'Brand#2' THEN p_size + 1 ELSE p_size END"))
    return R.diff(p.where("p_size < 45"), new, ["p_partkey"])


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 23 - 11)::BIGINT AS a, (l_linenumber * 3 - 10)::BIGINT AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, ((a % abs(b)) + abs(b)) % abs(b) AS m, ((a - ((a % abs(b)) + abs(b)) % abs(b)) // b) AS d, a % b AS r, (a - a % b) // b AS q FROM x""")
def euclid_div_mod(t):
    a, b = F.expr("CAST(l_orderkey % 23 - 11 AS BIGINT)"), F.expr("CAST(l_linenumber * 3 - 10 AS BIGINT)")
    return t("lineitem").select("l_orderkey", "l_linenumber", N.mod(a, b).alias("m"), N.div(a, b).alias("d"), N.rem(a, b).alias("r"), N.quo(a, b).alias("q"))


@query("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, replace(p_name, ' ', '_') AS r, (length(p_name) - length(replace(p_name, 'a', '')))::BIGINT AS n_a, starts_with(p_type, 'S') AS pre, contains(p_name, 'e') AS has, len(string_split(p_name, ' '))::INT AS parts, p_name[2:4] AS mid FROM part")
def strings_basic(t):
    n = F.col("p_name")
    return t("part").select("p_partkey", X.to_upper(n).alias("u"), X.to_lower(F.col("p_brand")).alias("l"), X.replace_all(n, " ", "_").alias("r"), X.count(n, "a").alias("n_a"), X.has_prefix(F.col("p_type"), "S").alias("pre"), X.contains(n, "e").alias("has"), F.size(X.split(n, " ")).alias("parts"), X.slice_runes(n, 1, 4).alias("mid"))


@query("SELECT page_id, regexp_extract(url, '[a-z]+\\.[a-z]+') AS found, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, regexp_matches(url, '^https?://[^/]+/') AS ok, list_extract(regexp_extract_all(url, '[a-z]+'), 2) AS second FROM pages")
def regexp_find_replace(t):
    u = F.col("url")
    return t("pages").select("page_id", F.coalesce(X.find(u, r"[a-z]+\.[a-z]+"), F.lit("")).alias("found"), X.regexp_replace_all(u, "[0-9]+", "#").alias("masked"), X.match(u, "^https?://[^/]+/").alias("ok"), F.get(X.find_all(u, "[a-z]+"), 1).alias("second"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders")
def time_split_format(t):
    x = N.time_split(F.col("o_orderdate"))
    return t("orders").select("o_orderkey", x["year"].alias("y"), x["month"].alias("m"), x["day"].alias("d"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"))


@query("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, sha1(c_name) AS s1, to_base64(encode(c_name)) AS b, lower(hex(encode(c_name))) AS h FROM customer")
def hash_codec(t):
    n = F.col("c_name")
    return t("customer").select("c_custkey", X.hex_encode(X.md5(n)).alias("m"), X.hex_encode(X.sha2(n, 256)).alias("s"), X.hex_encode(X.sha1(n)).alias("s1"), X.base64_encode(n).alias("b"), X.hex_encode(n.cast("binary")).alias("h"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_unmarshal_path(t):
    return t("events").select("event_id", X.json_field(F.col("props"), "$.k", "bigint").alias("k"))


PART_SCHEMA = {
    "type": "object",
    "properties": {"p_size": {"type": "integer", "minimum": 5, "exclusiveMaximum": 45, "multipleOf": 5}, "p_brand": {"enum": ["Brand#1", "Brand#2", "Brand#3"]}, "p_name": {"type": "string", "minLength": 8, "pattern": "a"}},
    "required": ["p_size"],
}


@query("SELECT p_partkey FROM part WHERE p_size >= 5 AND p_size < 45 AND p_size % 5 = 0 AND p_brand IN ('Brand#1','Brand#2','Brand#3') AND length(p_name) >= 8 AND regexp_matches(p_name, 'a')")
def jsonschema_vet(t):
    return S.vet(t("part"), jsonschema.extract(PART_SCHEMA)).where(F.size("violations") == 0).select("p_partkey")


@query("""SELECT path, code, count(*)::BIGINT AS n FROM (SELECT 'p_size' AS path, 'bound' AS code FROM part WHERE p_size < 5 UNION ALL SELECT 'p_size', 'bound' FROM part WHERE p_size >= 45 UNION ALL SELECT 'p_size', 'value' FROM part WHERE p_size % 5 <> 0
UNION ALL SELECT 'p_brand', 'value' FROM part WHERE p_brand NOT IN ('Brand#1','Brand#2','Brand#3') UNION ALL SELECT 'p_name', 'value' FROM part WHERE length(p_name) < 8 UNION ALL SELECT 'p_name', 'bound' FROM part WHERE NOT regexp_matches(p_name, 'a')) GROUP BY ALL""")
def jsonschema_violations(t):
    return S.vet(t("part"), jsonschema.extract(PART_SCHEMA)).select(F.explode("violations").alias("v")).groupBy("v.path", "v.code").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE (p_size < 10)::INT + (p_size > 40)::INT + (p_size % 2 = 0)::INT = 1")
def jsonschema_oneof(t):
    s = jsonschema.extract({"oneOf": [{"exclusiveMaximum": 10}, {"exclusiveMinimum": 40}, {"multipleOf": 2}]})
    d = t("part")
    return d.where(S.matches(s, d["p_size"])).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE CASE WHEN p_size >= 25 THEN p_size <= 30 ELSE p_size >= 20 END AND NOT p_size = 22")
def jsonschema_if_not(t):
    s = jsonschema.extract({"if": {"minimum": 25}, "then": {"maximum": 30}, "else": {"minimum": 20}, "not": {"const": 22}})
    d = t("part")
    return d.where(S.matches(s, d["p_size"])).select("p_partkey")


@query("SELECT vec_id FROM embeddings WHERE len(embedding) >= 8 AND len(list_filter(embedding, lambda x: NOT (x >= -1.0 AND x <= 1.0))) = 0")
def list_elements_vet(t):
    d = t("embeddings")
    return d.where(S.matches(S.ListOf((), S.between(-1.0, 1.0), 8), d["embedding"])).select("vec_id")


@query("SELECT vec_id, len(embedding)::INT AS n, list_max(embedding)::DOUBLE AS hi, list_min(embedding)::DOUBLE AS lo, list_reverse(embedding)[1]::DOUBLE AS last, len(embedding[3:])::INT AS rest, list_sort(embedding) = embedding AS sorted FROM embeddings")
def list_functions(t):
    e = F.col("embedding")
    return t("embeddings").select("vec_id", F.size(e).alias("n"), N.list_max(e).cast("double").alias("hi"), N.list_min(e).cast("double").alias("lo"), F.get(N.reverse(e), 0).cast("double").alias("last"), F.size(N.drop(e, 2)).alias("rest"), N.is_sorted(e).alias("sorted"))


@query("SELECT p_partkey, floor(p_retailprice)::BIGINT AS f, ceil(p_retailprice)::BIGINT AS c, trunc(p_retailprice)::BIGINT AS t, round(cbrt(p_retailprice), 6) AS cb, round(log10(p_retailprice), 6) AS lg, round(sqrt(p_retailprice), 6) AS sq, round(atan2(p_size, 3), 6) AS at FROM part")
def math_functions(t):
    p = F.col("p_retailprice")
    return t("part").select("p_partkey", F.floor(p).alias("f"), F.ceil(p).alias("c"), N.trunc(p).alias("t"), F.round(N.cbrt(p), 6).alias("cb"), F.round(F.log10(p), 6).alias("lg"), F.round(F.sqrt(p), 6).alias("sq"), F.round(F.atan2(F.col("p_size"), F.lit(3)), 6).alias("at"))


@query("SELECT o_orderkey, (o_orderkey << 2)::BIGINT AS l, (o_orderkey >> 3)::BIGINT AS r, bit_count(o_orderkey)::INT AS n, (o_orderkey & 12)::BIGINT AS a, xor(o_orderkey, 5)::BIGINT AS x, (o_orderkey | 8)::BIGINT AS s FROM orders")
def bit_functions(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", N.lsh(k, 2).alias("l"), N.rsh(k, 3).alias("r"), N.ones_count(k).alias("n"), k.bitwiseAND(12).alias("a"), k.bitwiseXOR(5).alias("x"), N.bit_set(k, 3, 1).alias("s"))


@query("SELECT c_custkey, try_cast(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS n, c_acctbal::VARCHAR IS NOT NULL AS ok, lower(printf('%x', c_custkey)) AS hex FROM customer")
def strconv_functions(t):
    return t("customer").select("c_custkey", N.atoi(F.regexp_extract("c_name", "[0-9]+", 0)).alias("n"), F.col("c_acctbal").cast("string").isNotNull().alias("ok"), N.format_int(F.col("c_custkey"), 16).alias("hex"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:[^ ]+$') AS abs_url, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages")
def net_path_functions(t):
    u = F.col("url")
    return t("pages").select("page_id", X.url_host(u).alias("host"), X.abs_url(u).alias("abs_url"), F.regexp_extract(u, r"([^/]*)\z", 1).alias("base"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;') AS e, length(html)::INT AS n FROM pages")
def html_functions(t):
    return t("pages").select("page_id", X.html_escape(F.col("url")).alias("e"), F.length("html").alias("n"))


@query("SELECT c_custkey, h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-' || substr('89ab89ab89ab89ab', 1 + ('0x' || h[17:17])::INT, 1) || h[18:20] || '-' || h[21:32] AS u FROM (SELECT c_custkey, md5(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer)")
def uuid_named(t):
    return t("customer").select("c_custkey", X.uuid_named("6ba7b810-9dad-11d1-80b4-00c04fd430c8", 3)(F.col("c_name")).alias("u"))


@query("SELECT conv_id, count(*)::BIGINT AS turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def strings_join_group(t):
    g = t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return g.select("conv_id", "turns", X.join(F.transform("x", lambda s: s["role"]), ",").alias("roles"))


@query("SELECT o_orderkey, to_json({'status': o_orderstatus, 'key': o_orderkey})::VARCHAR AS j FROM orders")
def json_marshal(t):
    return t("orders").select("o_orderkey", X.json_marshal(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key"))).alias("j"))


@query()
def hmac_sign(t):
    return t("customer").select("c_custkey", X.hex_encode(X.hmac_sign("SHA256")(F.col("c_mktsegment"), F.col("c_name"))).alias("sign"))


@query()
def math_special(t):
    return t("part").select("p_partkey", F.round(N.from_math("erf")(F.col("p_size") / 50.0), 9).alias("erf"), F.round(N.from_math("gamma")(F.col("p_size") / 10.0), 6).alias("gamma"))


@query("""SELECT path, code, count(*)::BIGINT AS n FROM (SELECT 'p_name' AS path, 'kind' AS code FROM part UNION ALL SELECT 'p_retailprice', 'kind' FROM part WHERE p_retailprice <> floor(p_retailprice)
UNION ALL SELECT 'p_brand', 'bound' FROM part UNION ALL SELECT 'p_size', 'kind' FROM part) GROUP BY ALL""")
def type_constraints(t):
    """Columns of another kind than the constraint's are violations in every row, not failures."""
    s = S.struct(p_name=S.Kind("int"), p_retailprice=S.Kind("int"), p_brand=S.Bound(">", 3), p_size=S.Kind("string"), p_type=S.Kind("string"), p_partkey=S.Kind("number"))
    return S.vet(t("part"), s).select(F.explode("violations").alias("v")).groupBy("v.path", "v.code").agg(F.count("*").alias("n"))


@query("""SELECT path, code, count(*)::BIGINT AS n FROM (SELECT 'o.o_custkey' AS path, 'bound' AS code FROM orders WHERE o_custkey > 1000 UNION ALL SELECT 'o.o_orderstatus', 'closed' FROM orders UNION ALL SELECT 'o_orderkey', 'closed' FROM orders) GROUP BY ALL""")
def nested_closedness(t):
    d = t("orders").select("o_orderkey", F.struct("o_custkey", "o_orderstatus").alias("o"))
    s = S.Struct((("o", S.Field(S.Struct((), (("^o_cust", S.Bound("<=", 1000)),), True))),), (), True)
    return S.vet(d, s).select(F.explode("violations").alias("v")).groupBy("v.path", "v.code").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') OR (value IS NOT NULL AND value >= 10)")
def jsonschema_objects(t):
    """Object keywords over a struct: dependencies, names, counts and a schema for all other properties."""
    d = t("events").select("event_id", F.struct(F.when(F.expr("event_type NOT IN ('click', 'view')"), F.col("event_type")).alias("paid"), F.when(F.col("value") >= 10, F.col("value")).alias("value")).alias("e"))
    s = jsonschema.extract({"type": "object", "properties": {"paid": {"type": "string"}}, "additionalProperties": {"minimum": 10}, "dependentRequired": {"paid": ["value"]}, "propertyNames": {"maxLength": 5}, "maxProperties": 2})
    return d.where(S.matches(s, d["e"], d.schema["e"].dataType)).select("event_id")


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x >= 0.1)) BETWEEN 20 AND 30")
def jsonschema_contains(t):
    d = t("embeddings")
    s = jsonschema.extract({"type": "array", "contains": {"minimum": 0.1}, "minContains": 20, "maxContains": 30})
    return d.where(S.matches(s, d["embedding"], d.schema["embedding"].dataType)).select("vec_id")


@query("SELECT page_id, '/' || regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS clean, regexp_extract(url, '^[a-z]+://([^/]+)', 1) || ':80' AS host_port, coalesce(regexp_extract(url, '([^/]*)$', 1), '') AS last FROM pages")
def path_functions(t):
    u = F.col("url")
    way = F.regexp_extract(u, "^[a-z]+://[^/]+/(.*)$", 1)
    host = F.regexp_extract(u, "^[a-z]+://([^/]+)", 1)
    return t("pages").select("page_id", F.when(way == "", "/").otherwise(F.concat(X.path_clean(F.concat(F.lit("/x/.././"), way)), F.when(F.endswith(way, F.lit("/")), "/").otherwise(""))).alias("clean"), X.join_host_port(host, F.lit(80)).alias("host_port"), F.get(X.path_split(u), 1).alias("last"))


@query("SELECT o_orderkey, (o_totalprice * 1000)::BIGINT * 1000000 AS ns FROM orders")
def duration_functions(t):
    n = (F.col("o_totalprice") * 1000).cast("decimal(20,0)").cast("long") * 1_000_000
    return t("orders").select("o_orderkey", N.parse_duration(N.format_duration(n)).alias("ns"))


@query("SELECT p_partkey, round(sin(x), 6) AS s, round(exp(x), 6) AS e, round(ln(1 + x), 6) AS l, round(atan(x), 6) AS t, round(acos(x / 100), 6) AS ac, round(pow(x, 1.5), 6) AS pw, round(degrees(x), 6) AS dg FROM (SELECT p_partkey, p_size / 10.0 AS x FROM part)")
def math_elementary(t):
    x = F.col("p_size") / 10.0
    m = MATH
    return t("part").select("p_partkey", F.round(m["Sin"](x), 6).alias("s"), F.round(m["Exp"](x), 6).alias("e"), F.round(m["Log1p"](x), 6).alias("l"), F.round(m["Atan"](x), 6).alias("t"), F.round(m["Acos"](x / 100), 6).alias("ac"), F.round(m["Pow"](x, F.lit(1.5)), 6).alias("pw"), F.round(F.degrees(x), 6).alias("dg"))


@query("SELECT p_partkey, regexp_matches(p_name, '[xz]') AS has, CASE WHEN regexp_matches(p_name, '[ae]') THEN length(regexp_extract(p_name, '^[^ae]*')) ELSE -1 END::INT AS first, CASE WHEN regexp_matches(p_name, '[ae]') THEN length(regexp_extract(p_name, '^(.*)[ae]', 1)) ELSE -1 END::INT AS last, replace(p_name, ' ', ' |') AS pieces, CASE WHEN contains(p_name, ' ') THEN substr(p_name, strpos(p_name, ' ') + 1) END AS rest, ascii(p_name[2])::INT AS b FROM part")
def strings_any_of(t):
    n = F.col("p_name")
    return t("part").select("p_partkey", X.contains_any(n, "xz").alias("has"), X.index_any(n, "ae").alias("first"), X.last_index_any(n, "ae").alias("last"), X.join(X.split_after(n, " "), "|").alias("pieces"), F.get(X.split_n(n, " ", 2), 1).alias("rest"), X.byte_at(n, 1).alias("b"))


@query("""SELECT c_custkey, 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS urn,
CASE WHEN h[17:17] IN ('8','9','a','b') THEN 1 WHEN h[17:17] IN ('c','d') THEN 3 WHEN h[17:17] IN ('e','f') THEN 4 ELSE 2 END::INT AS variant FROM (SELECT c_custkey, md5(c_name) AS h FROM customer)""")
def uuid_forms(t):
    h = F.upper(F.md5("c_name"))
    return t("customer").select("c_custkey", X.uuid_urn(h).alias("urn"), X.uuid_variant(h).alias("variant"))


@query("""SELECT o_orderkey, a, n >> 24 = 127 AS loopback, n >> 28 = 14 AS multicast, n <> 0 AND n <> 4294967295 AND n >> 24 <> 127 AND n >> 28 <> 14 AND n >> 16 <> 43518 AS unicast, n >> 24 = 10 AS inside, true AS v6
FROM (SELECT o_orderkey, n, (n >> 24)::VARCHAR || '.' || ((n >> 16) & 255)::VARCHAR || '.' || ((n >> 8) & 255)::VARCHAR || '.' || (n & 255)::VARCHAR AS a FROM (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS n FROM orders))""")
def net_addresses(t):
    a = F.col("a")
    d = t("orders").select("o_orderkey", X.ip_string(F.expr("(CAST(o_orderkey AS BIGINT) * 2654435761L) % 4294967296L")).alias("a"))
    return d.select("o_orderkey", "a", X.loopback_ip(a).alias("loopback"), X.multicast_ip(a).alias("multicast"), X.global_unicast_ip(a).alias("unicast"), X.in_cidr(a, "10.0.0.0/8").alias("inside"), X.ipv6(F.concat(F.lit("::ffff:"), a)).alias("v6"))


@query("""SELECT path, pointer, count(*)::BIGINT AS n, min(v) AS least, max(v) AS most FROM (SELECT 'key' AS path, '/key' AS pointer, o_orderkey::VARCHAR AS v FROM orders
UNION ALL SELECT 'by.cust', '/by/cust', o_custkey::VARCHAR FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT 'by.tags[0]', '/by/tags/0', o_orderstatus FROM orders
UNION ALL SELECT 'by.tags[1]', '/by/tags/1', o_orderpriority FROM orders UNION ALL SELECT '"at/' || o_orderstatus || '"', '/at~1' || o_orderstatus, o_orderpriority FROM orders) GROUP BY path, pointer""")
def value_walk(t):
    """Leaves of a nested value with an absent field, a list and names that need quotes."""
    by = F.struct(F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("cust"), F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    d = t("orders").select(F.struct(F.col("o_orderkey").alias("key"), by.alias("by")).alias("v"), F.create_map(F.concat(F.lit("at/"), "o_orderstatus"), F.col("o_orderpriority")).alias("m"))
    leaves = d.select(F.explode(F.concat(V.walk(d["v"], d.schema["v"].dataType), V.walk(d["m"], d.schema["m"].dataType))).alias("leaf")).select("leaf.*")
    return leaves.groupBy("path", "pointer").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'BUILDING' END AS segment, c_acctbal > 0 AND c_mktsegment <> 'BUILDING' AS conflict, c_nationkey AS nation FROM customer""")
def value_fill_path(t):
    d = t("customer").select("c_custkey", "c_nationkey", F.struct(F.struct(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment")).alias("of")).alias("v"))
    filled, conflict = V.fill_path(d["v"], d.schema["v"].dataType, "of.segment", F.lit("BUILDING"))
    d = d.select("c_custkey", "c_nationkey", filled.alias("v"), conflict.alias("conflict"))
    filled, _ = V.fill_path(d["v"], d.schema["v"].dataType, "place.nation.key", F.col("c_nationkey"))
    d = d.select("c_custkey", "conflict", filled.alias("v"))
    kind = d.schema["v"].dataType
    return d.select("c_custkey", V.at_pointer(d["v"], kind, "/of/segment").alias("segment"), "conflict", V.at_pointer(d["v"], kind, "/place/nation/key").alias("nation"))


@query("SELECT p_size = 10 AS same, count(*)::BIGINT AS n, count(DISTINCT p_size)::BIGINT AS kinds FROM part GROUP BY 1")
def value_equals(t):
    """Maps are equal whatever the order of their entries, and can be counted as values."""
    m = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    d = t("part").select(F.array(m("a", F.col("p_size"), "b", F.lit(1))).alias("x"), F.array(m("b", F.lit(1), "a", F.lit(10))).alias("y"))
    kind = d.schema["x"].dataType
    return d.groupBy(V.equals(d["x"], d["y"], kind).alias("same")).agg(F.count("*").alias("n"), F.count_distinct(V.canonical(d["x"], kind)).alias("kinds"))


@query("SELECT c_custkey, c_name || ' (' || c_custkey::VARCHAR || ') in ' || c_nationkey::VARCHAR AS line FROM customer")
def interpolation(t):
    d = t("customer")
    return d.select("c_custkey", V.interpolate(r"\(name) (\( key )) in \(nation)", name=d["c_name"], key=d["c_custkey"], nation=d["c_nationkey"]).alias("line"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND (o_totalprice >= 1000 AND o_totalprice < 200000) AND (o_custkey % 2 = 0 OR o_orderpriority LIKE '%-%')")
def openapi_orders(t):
    """Orders that an OpenAPI component accepts: a reference, a nullable field, an exclusive bound in the older spelling."""
    doc = {"components": {"schemas": {
        "Price": {"type": "number", "minimum": 1000, "maximum": 200000, "exclusiveMaximum": True, "example": 2000.5},
        "Order": {"type": "object", "required": ["status", "price"], "properties": {"status": {"type": "string", "enum": ["O", "F"]}, "price": {"$ref": "#/components/schemas/Price"}, "priority": {"type": "string", "nullable": True, "pattern": "-"}}},
    }}}
    price, priority = F.col("o_totalprice"), F.when(F.col("o_custkey") % 2 == 1, F.col("o_orderpriority"))
    d = t("orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), price.alias("price"), priority.alias("priority")).alias("o"))
    return d.where(S.matches(openapi.extract(doc, "Order"), d["o"], d.schema["o"].dataType)).select("o_orderkey")


@query("""SELECT p_partkey, p_partkey + p_size AS total, p_size::BIGINT * 3 AS three, p_brand || p_type AS label, repeat('ab', p_size % 4) AS bar,
CASE WHEN p_size % 3 <> 0 THEN round(p_retailprice / (p_size % 3), 6) END AS share, strlen(p_name)::INT AS bytes, (p_size * 1024)::BIGINT AS kib FROM part""")
def arithmetic_kinds(t):
    d = t("part")
    kind = {f.name: f.dataType for f in d.schema.fields}
    size, whole = F.col("p_size"), kind["p_size"]
    return d.select(
        "p_partkey", A.add(d["p_partkey"], kind["p_partkey"], size, whole).alias("total"), A.multiply(size, whole, F.lit(3), whole).alias("three"), A.add(d["p_brand"], kind["p_brand"], d["p_type"], kind["p_type"]).alias("label"),
        A.multiply(F.lit("ab"), kind["p_name"], size % 4, whole).alias("bar"), F.round(A.divide(d["p_retailprice"], kind["p_retailprice"], size % 3, whole), 6).alias("share"),
        A.length(d["p_name"], kind["p_name"]).alias("bytes"), A.number_literal(F.concat(size.cast("string"), F.lit("Ki"))).cast("long").alias("kib"),
    )


@query("""SELECT vec_id, round(s[1].x::DOUBLE, 6) AS first, round(s[2].x::DOUBLE, 6) AS second, round(s[-1].x::DOUBLE, 6) AS last
FROM (SELECT vec_id, list_sort(list_transform(embedding, lambda x, i: {'k': abs(x), 'i': i, 'x': x})) AS s FROM embeddings)""")
def list_sort_comparator(t):
    """Vectors' elements by size without sign, equal ones in their order."""
    d = t("embeddings").select("vec_id", A.sort_by(F.col("embedding"), lambda x, y: F.abs(x) < F.abs(y)).alias("s"))
    return d.select("vec_id", *[F.round(F.get("s", at).cast("double"), 6).alias(n) for n, at in (("first", F.lit(0)), ("second", F.lit(1)), ("last", F.size("s") - 1))])


@query("""SELECT p_partkey, '"' || p_name || ',' || p_brand || '",' || repeat('"', 3) || p_type || '"' || chr(10) || p_size::VARCHAR || ',' || chr(10) AS csv FROM part""")
def csv_encode(t):
    """Parts as CSV texts of two lines, with fields that need quotes and an absent one."""
    first = F.array(F.concat_ws(",", "p_name", "p_brand"), F.concat(F.lit('"'), "p_type"))
    return t("part").select("p_partkey", X.csv_encode(F.array(first, F.array(F.col("p_size").cast("string"), F.lit(None).cast("string")))).alias("csv"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["vet_violation_rows"](spark, sf_dir)
