"""One query for each operator of the sequence API, with its SQL twin for a differential check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.filters import build_predicate, parse_filter_json, parse_query_string, predicate_from_parsed_query
from seqloom.operators.seq import Seq
from seqloom.plans.exprs import py
from seqloom.plans.order import ORD
from seqloom.sources.read import empty, range_, repeat
from seqloom.streaming.stream import StreamSeq

#: A total order of each table.
ORDER = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"],
}
LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> Seq:
    return Seq.of(spark.read.parquet(f"{sf_dir}/{name}.parquet"), ORDER.get(name))


def add(name: str, func: Callable, sql: str | None) -> None:
    QUERIES[f"op_{name}"] = lambda spark, sf_dir: func(lambda t: table(spark, sf_dir, t))
    if sql:
        ORACLES[f"op_{name}"] = sql


def numbered(s: Seq, *cols: str, name: str = "ord") -> DataFrame:
    """Columns of a sequence with its positions."""
    return s._ordinal()._df.select(*[F.col(c) for c in cols], F.col(ORD).alias(name))


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


def dec(c: str) -> str:
    return f"CAST({c} AS DECIMAL(18,2))"


# -- the headline query -------------------------------------------------------------------------------------
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").Where(lambda r: r.l_returnflag != "A").GroupBy(["l_returnflag", "l_linestatus"])
    g = s.Agg(sum_qty=F.sum(money("l_quantity")).cast("double"), sum_price=F.sum(money("l_extendedprice")).cast("double"), n=F.count("*"))
    return g._df.select("key.l_returnflag", "key.l_linestatus", "sum_qty", "sum_price", "n")


QUERIES["pricing_summary"] = pricing_summary
ORACLES["pricing_summary"] = f"SELECT l_returnflag, l_linestatus, CAST(sum({dec('l_quantity')}) AS DOUBLE) sum_qty, CAST(sum({dec('l_extendedprice')}) AS DOUBLE) sum_price, count(*) n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2"

# -- lazy operators -----------------------------------------------------------------------------------------
OK2 = "SELECT o_orderkey, o_totalprice FROM orders WHERE "
STATUS = "(SELECT *, nullif(o_orderstatus, 'P') st FROM orders)"


def status(s: Seq) -> Seq:
    return Seq(s._df.withColumn("st", F.nullif("o_orderstatus", F.lit("P"))), s._keys, s._log)


def keep(s: Seq) -> DataFrame:
    return s.SelectKeys("o_orderkey", "o_totalprice").df


add("where", lambda t: keep(t("orders").Where(lambda r: (r.o_totalprice > 150000) & (r.o_orderstatus == "F"))), OK2 + "o_totalprice > 150000 AND o_orderstatus = 'F'")
add("where_index", lambda t: t("orders").Where(lambda r, i: i % 10 == 3).SelectKeys("o_orderkey").df, "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 i FROM orders) WHERE i % 10 = 3")
add("select", lambda t: t("orders").Select(lambda r: {"o_orderkey": r.o_orderkey, "half": F.round(r.o_totalprice / 2, 3)}).df, "SELECT o_orderkey, round(o_totalprice / 2, 3) half FROM orders")
add("select_many", lambda t: t("embeddings").Select(lambda r: r.embedding).WithIndex().SelectMany(lambda r: F.transform(r["value"], lambda x: F.struct(r.index.alias("vec_id"), x.cast("double").alias("x")))).Select(lambda r: {"vec_id": r["value.vec_id"], "x": r["value.x"]}).df, "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) x FROM embeddings")
add("flatten", lambda t: numbered(t("embeddings").Select(lambda r: F.slice(r.embedding, 1, 3)).Flatten().Select(lambda r: r["value"].cast("double")), "value"), "SELECT CAST(embedding[p] AS DOUBLE) AS value, row_number() OVER (ORDER BY vec_id, p) - 1 AS ord FROM embeddings, (SELECT unnest([1, 2, 3]) p)")
add("flatten_whole", lambda t: numbered(t("embeddings").Select(lambda r: r.embedding).Flatten().Select(lambda r: r["value"].cast("double")), "value"), "SELECT CAST(x AS DOUBLE) AS value, row_number() OVER (ORDER BY vec_id, p) - 1 AS ord FROM (SELECT vec_id, unnest(embedding) x, generate_subscripts(embedding, 1) p FROM embeddings)")
add("of_type", lambda t: t("customer").Select(lambda r: F.when(r.c_acctbal > 0, F.struct(r.c_custkey.alias("k"), r.c_acctbal.alias("b")))).OfType().Select(lambda r: {"k": r["value.k"], "b": r["value.b"]}).df, "SELECT c_custkey k, c_acctbal b FROM customer WHERE c_acctbal > 0")
add("cast", lambda t: t("customer").SelectKeys("c_custkey", "c_acctbal").Cast({"c_acctbal": "decimal(18,1)"}).Cast({"c_acctbal": "double"}).df, "SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,1)) AS DOUBLE) c_acctbal FROM customer")
add("take", lambda t: keep(t("orders").OrderByDescending("o_totalprice").Take(25)), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
add("skip", lambda t: keep(t("orders").OrderByDescending("o_totalprice").Skip(100)), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey OFFSET 100")
EV = "(SELECT *, row_number() OVER (ORDER BY event_id) - 1 i FROM events)"
CUT = f"(SELECT min(i) FROM {EV} WHERE NOT value < 99.5)"
add("take_while", lambda t: t("events").TakeWhile(lambda r: r.value < 99.5).SelectKeys("event_id").df, f"SELECT event_id FROM {EV} WHERE {CUT} IS NULL OR i < {CUT}")
add("skip_while", lambda t: t("events").SkipWhile(lambda r: r.value < 99.5).SelectKeys("event_id").df, f"SELECT event_id FROM {EV} WHERE i >= {CUT}")
add("default_if_empty", lambda t: t("region").Where(lambda r: r.r_regionkey > 100).SelectKeys("r_regionkey", "r_name").DefaultIfEmpty({"r_regionkey": -1, "r_name": "none"}).df, "SELECT -1 AS r_regionkey, 'none' AS r_name WHERE NOT EXISTS (SELECT * FROM region WHERE r_regionkey > 100) UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 100")
add("chunk", lambda t: numbered(t("events").Select(lambda r: r.event_id).Chunk(7).Select(lambda r: {"n": F.size(r["value"]).cast("long"), "total": F.aggregate(r["value"], F.lit(0).cast("long"), lambda a, x: a + x)}), "n", "total"), f"SELECT i // 7 AS ord, count(*) n, CAST(sum(event_id) AS BIGINT) total FROM {EV} GROUP BY 1")
add("buffer", lambda t: numbered(t("events").Select(lambda r: r.event_id).Buffer(5, 3).Select(lambda r: {"first": F.element_at(r["value"], 1), "total": F.aggregate(r["value"], F.lit(0).cast("long"), lambda a, x: a + x)}), "first", "total"), f"SELECT i // 3 AS ord, first, total FROM (SELECT i, event_id AS first, CAST(sum(event_id) OVER w AS BIGINT) total, count(*) OVER w n FROM {EV} WINDOW w AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5 AND i % 3 = 0")
add("scan", lambda t: numbered(t("events").Scan(100, "sum", "event_id"), "value"), f"SELECT 0 AS ord, 100 AS value UNION ALL SELECT i + 1, CAST(100 + sum(event_id) OVER (ORDER BY i) AS BIGINT) FROM {EV}")
add("scan_max", lambda t: numbered(t("events").Scan(-1.0, "max", "value"), "value"), f"SELECT 0 AS ord, CAST(-1 AS DOUBLE) AS value UNION ALL SELECT i + 1, greatest(-1.0, max(value) OVER (ORDER BY i)) FROM {EV}")
add("with_index", lambda t: t("nation").OrderBy("n_name").WithIndex().Select(lambda r: {"n_name": r["value.n_name"], "index": r["index"]}).df, 'SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS "index" FROM nation')
add("index", lambda t: t("nation").OrderByDescending("n_name").Index().Select(lambda r: {"n_name": r["item.n_name"], "index": r["index"]}).df, 'SELECT n_name, row_number() OVER (ORDER BY n_name DESC) - 1 AS "index" FROM nation')
add("try_where", lambda t: t("events").TryWhere(lambda r: F.try_divide(F.lit(100.0), r.event_id % 4) > 40).SelectKeys("event_id").df, "SELECT event_id FROM events WHERE event_id % 4 IN (1, 2)")
add("try_where_py", lambda t: t("nation").TryWhere(py(lambda r: 10 // r["n_regionkey"] > 4, "boolean")).SelectKeys("n_nationkey").df, "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2)")
add("pairwise", lambda t: t("events").Pairwise().Select(lambda r: {"prev": r["prev.event_id"], "cur": r["cur.event_id"], "rise": F.round(r["cur.value"] - r["prev.value"], 4)}).df, f"SELECT * FROM (SELECT lag(event_id) OVER (ORDER BY i) AS prev, event_id AS cur, round(value - lag(value) OVER (ORDER BY i), 4) rise FROM {EV}) WHERE prev IS NOT NULL")
add("tap", lambda t: t("region").Tap(print).SelectKeys("r_regionkey").df, "SELECT r_regionkey FROM region")
add("adjacent_distinct", lambda t: t("events").AdjacentDistinct(lambda r: F.nullif(r.event_type, F.lit("click"))).SelectKeys("event_id", "event_type").df, "SELECT event_id, event_type FROM (SELECT *, nullif(event_type, 'click') e, lag(nullif(event_type, 'click')) OVER (ORDER BY event_id) p, row_number() OVER (ORDER BY event_id) n FROM events) WHERE n = 1 OR e IS DISTINCT FROM p")
ND = "SELECT n_name, row_number() OVER (ORDER BY b, k) - 1 AS ord FROM (SELECT n_name, n_nationkey k, {} b FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name, n_nationkey, {} FROM nation WHERE n_regionkey = 2)"
part1 = lambda t, k: t("nation").Where(lambda r: r.n_regionkey == k)
add("prepend", lambda t: numbered(part1(t, 1).Prepend(part1(t, 2)), "n_name"), ND.format(1, 0))
add("append", lambda t: numbered(part1(t, 1).Append(part1(t, 2)), "n_name"), ND.format(0, 1))
add("concat", lambda t: numbered(part1(t, 1).Concat(part1(t, 2)), "n_name"), ND.format(0, 1))
add("take_last", lambda t: numbered(t("events").TakeLast(20), "event_id"), "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS ord FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 20)")
add("skip_last", lambda t: t("events").SkipLast(900).SelectKeys("event_id").df, f"SELECT event_id FROM {EV} WHERE i < (SELECT count(*) - 900 FROM events)")

# -- where family, projections ------------------------------------------------------------------------------
for _name, _f, _sql in [
    ("eq", lambda s: s.WhereEq("st", None), "st IS NULL"), ("not_eq", lambda s: s.WhereNotEq("st", "F"), "st IS DISTINCT FROM 'F'"),
    ("gt", lambda s: s.WhereGt("o_totalprice", 200000.0), "o_totalprice > 200000"), ("gte", lambda s: s.WhereGte("o_custkey", 700), "o_custkey >= 700"),
    ("lt", lambda s: s.WhereLt("st", "O"), "st < 'O'"), ("lte", lambda s: s.WhereLte("o_custkey", 70), "o_custkey <= 70"),
    ("in", lambda s: s.WhereIn("st", ["F", None]), "st = 'F' OR st IS NULL"), ("not_in", lambda s: s.WhereNotIn("st", ["F"]), "st IS NULL OR st <> 'F'"),
    ("between", lambda s: s.WhereBetween("o_totalprice", 1000.0, 90000.0), "o_totalprice BETWEEN 1000 AND 90000"),
    ("contains", lambda s: s.WhereContains("o_orderpriority", "urg", insensitive=True), "contains(lower(o_orderpriority), 'urg')"),
    ("starts_with", lambda s: s.WhereStartsWith("o_orderpriority", "1"), "starts_with(o_orderpriority, '1')"),
    ("ends_with", lambda s: s.WhereEndsWith("o_orderpriority", "H"), "ends_with(o_orderpriority, 'H')"),
    ("null", lambda s: s.WhereNull("st"), "st IS NULL"), ("not_null", lambda s: s.WhereNotNull("st"), "st IS NOT NULL"),
]:
    add(f"where_{_name}", lambda t, f=_f: keep(f(status(t("orders")))), f"SELECT o_orderkey, o_totalprice FROM {STATUS} WHERE {_sql}")
add("where_truthy", lambda t: t("part").Select(lambda r: {"k": r.p_partkey, "v": r.p_size % 3}).WhereTruthy("v").df, "SELECT p_partkey k, p_size % 3 v FROM part WHERE p_size % 3 <> 0")
add("where_falsy", lambda t: t("part").Select(lambda r: {"k": r.p_partkey, "v": F.nullif(r.p_size % 3, F.lit(1))}).WhereFalsy("v").df, "SELECT p_partkey k, nullif(p_size % 3, 1) v FROM part WHERE p_size % 3 IN (0, 1)")
add("pluck", lambda t: t("customer").Pluck("c_name").df, 'SELECT c_name AS "value" FROM customer')
add("select_keys", lambda t: t("customer").SelectKeys("c_custkey", "c_name").df, "SELECT c_custkey, c_name FROM customer")
add("omit_keys", lambda t: t("customer").OmitKeys("c_acctbal", "c_name").df, "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
add("as_enumerable", lambda t: t("region").AsEnumerable().df, "SELECT * FROM region")
add("page", lambda t: keep(t("orders").OrderByDescending("o_totalprice").Page(3, 20)), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")

# -- ordering -----------------------------------------------------------------------------------------------
P3 = "SELECT p_partkey, row_number() OVER (ORDER BY {}) - 1 AS ord FROM part"
NB = "nullif(p_brand, 'Brand#11')"
add("order_by", lambda t: numbered(t("part").OrderBy(lambda r: F.nullif(r.p_brand, F.lit("Brand#11"))), "p_partkey"), P3.format(f"{NB} NULLS LAST, p_partkey"))
add("order_by_descending", lambda t: numbered(t("part").OrderByDescending(lambda r: F.nullif(r.p_brand, F.lit("Brand#11"))), "p_partkey"), P3.format(f"{NB} DESC NULLS LAST, p_partkey"))
add("then_by", lambda t: numbered(t("part").OrderByDescending("p_brand").ThenBy("p_size"), "p_partkey"), P3.format("p_brand DESC, p_size, p_partkey"))
add("then_by_descending", lambda t: numbered(t("part").OrderBy("p_brand").ThenByDescending("p_size"), "p_partkey"), P3.format("p_brand, p_size DESC, p_partkey"))
add("order", lambda t: numbered(t("part").Select(lambda r: r.p_partkey * -1).Order(), "value"), 'SELECT -p_partkey AS "value", row_number() OVER (ORDER BY -p_partkey) - 1 AS ord FROM part')
add("order_descending", lambda t: numbered(t("part").Select(lambda r: r.p_partkey).OrderDescending(), "value"), 'SELECT p_partkey AS "value", row_number() OVER (ORDER BY p_partkey DESC) - 1 AS ord FROM part')
add("order_by_comparer", lambda t: numbered(t("nation").OrderBy("n_name", comparer=lambda c: F.substring(c, 2, 1)), "n_nationkey"), "SELECT n_nationkey, row_number() OVER (ORDER BY substr(n_name, 2, 1), n_nationkey) - 1 AS ord FROM nation")
add("reverse", lambda t: numbered(t("nation").OrderBy("n_regionkey").Reverse(), "n_nationkey"), "SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey DESC) - 1 AS ord FROM nation")

# -- distinct, grouping -------------------------------------------------------------------------------------
FIRST = "SELECT {k}, row_number() OVER (ORDER BY f) - 1 AS ord FROM (SELECT {k}, min({o}) f FROM {t} GROUP BY 1)"
add("distinct", lambda t: numbered(t("customer").SelectKeys("c_nationkey").Distinct(), "c_nationkey"), FIRST.format(k="c_nationkey", o="c_custkey", t="customer"))
add("distinct_by", lambda t: numbered(t("customer").DistinctBy("c_nationkey"), "c_custkey", "c_nationkey"), "SELECT f AS c_custkey, c_nationkey, row_number() OVER (ORDER BY f) - 1 AS ord FROM (SELECT c_nationkey, min(c_custkey) f FROM customer GROUP BY 1)")
add("group_by", lambda t: numbered(t("events").GroupBy("event_type", "event_id").Select(lambda r: {"key": r.key, "n": F.size(r.elements).cast("long"), "firsts": F.concat_ws(",", F.slice(r.elements, 1, 3).cast("array<string>"))}), "key", "n", "firsts"), "SELECT event_type AS key, count(*) n, array_to_string(list(event_id ORDER BY event_id)[1:3], ',') firsts, row_number() OVER (ORDER BY min(event_id)) - 1 AS ord FROM events GROUP BY 1")
add("group_by_agg", lambda t: numbered(t("lineitem").GroupBy("l_suppkey").Agg(qty=F.sum(money("l_quantity")).cast("double")), "key", "qty"), f"SELECT l_suppkey AS key, CAST(sum({dec('l_quantity')}) AS DOUBLE) qty, row_number() OVER (ORDER BY min(struct_pack({', '.join(f'{c} := {c}' for c in LINE.split(', '))}))) - 1 AS ord FROM lineitem GROUP BY 1")
add("group_by_many", lambda t: t("orders").GroupByMany("o_orderstatus", "o_orderpriority").Agg(n=F.count("*")).Select(lambda r: {"s": r["key.o_orderstatus"], "p": r["key.o_orderpriority"], "n": r.n}).df, "SELECT o_orderstatus s, o_orderpriority p, count(*) n FROM orders GROUP BY 1, 2")
add("aggregate_by", lambda t: numbered(t("events").AggregateBy("user_id", 0, lambda a, x: a + x["event_id"].cast("int")), "key", "value"), 'SELECT user_id AS key, CAST(sum(event_id) AS INTEGER) AS "value", row_number() OVER (ORDER BY min(event_id)) - 1 AS ord FROM events GROUP BY 1')
add("aggregate_by_comparer", lambda t: numbered(t("events").AggregateBy("user_id", F.lit(0).cast("long"), lambda a, x: a + x["event_id"], comparer=lambda k: k % 10), "key", "value"), 'SELECT arg_min(user_id, event_id) AS key, CAST(sum(event_id) AS BIGINT) AS "value", row_number() OVER (ORDER BY min(event_id)) - 1 AS ord FROM events GROUP BY user_id % 10')
add("group_by_descending", lambda t: numbered(t("events").OrderByDescending("event_id").GroupBy("event_type", "event_id").Select(lambda r: {"key": r.key, "all": F.sha2(F.concat_ws(",", r.elements.cast("array<string>")), 256)}), "key", "all"), "SELECT event_type AS key, sha256(string_agg(event_id, ',' ORDER BY event_id DESC)) AS all, row_number() OVER (ORDER BY max(event_id) DESC) - 1 AS ord FROM events GROUP BY 1")
add("count_by", lambda t: t("events").count_by_df(lambda r: F.nullif(r.event_type, F.lit("click"))), "SELECT nullif(event_type, 'click') AS key, count(*) AS count FROM events GROUP BY 1")
add("to_lookup", lambda t: (lambda s: s.spark.createDataFrame([(k, "|".join(v)) for k, v in s.ToLookup("n_regionkey", "n_name")], "key int, names string"))(t("nation")), "SELECT n_regionkey AS key, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
add("mode", lambda t: t("events").mode_df("event_type"), 'SELECT event_type AS "value" FROM events GROUP BY 1 ORDER BY count(*) DESC, min(event_id) LIMIT 1')

# -- joins --------------------------------------------------------------------------------------------------
RICH = "(SELECT * FROM customer WHERE c_acctbal > 5000)"
rich = lambda t: t("customer").Where(lambda r: r.c_acctbal > 5000)
pair = lambda o, i: {"ok": o.o_orderkey, "ck": i.c_custkey}
both = lambda o, i: {"ck": o.c_custkey, "sk": i.s_suppkey}
add("join", lambda t: numbered(t("orders").Join(rich(t), "o_custkey", "c_custkey", pair), "ok", "ck"), f"SELECT o_orderkey ok, c_custkey ck, row_number() OVER (ORDER BY o_orderkey, c_custkey) - 1 AS ord FROM orders JOIN {RICH} ON o_custkey = c_custkey")
add("join_whole", lambda t: numbered(t("orders").Join(t("customer"), "o_custkey", "c_custkey", pair), "ok", "ck"), "SELECT o_orderkey ok, c_custkey ck, row_number() OVER (ORDER BY o_orderkey, c_custkey) - 1 AS ord FROM orders JOIN customer ON o_custkey = c_custkey")
add("join_null_keys", lambda t: t("nation").Join(t("region"), lambda r: F.nullif(r.n_regionkey, F.lit(2)), lambda r: F.nullif(r.r_regionkey, F.lit(3)), lambda o, i: {"n": o.n_nationkey, "r": i.r_regionkey}).df, "SELECT n_nationkey n, r_regionkey r FROM nation JOIN region ON nullif(n_regionkey, 2) IS NOT DISTINCT FROM nullif(r_regionkey, 3)")
add("join_comparer", lambda t: t("nation").Join(t("region"), "n_regionkey", "r_regionkey", lambda o, i: {"n": o.n_nationkey, "r": i.r_regionkey}, on=lambda a, b: a < b).df, "SELECT n_nationkey n, r_regionkey r FROM nation JOIN region ON n_regionkey < r_regionkey")
add("left_join_comparer", lambda t: t("nation").LeftJoin(t("region"), "n_regionkey", "r_regionkey", lambda o, i: {"n": o.n_nationkey, "r": i.r_regionkey}, on=lambda a, b: a < b).df, "SELECT n_nationkey n, r_regionkey r FROM nation LEFT JOIN region ON n_regionkey < r_regionkey")
add("right_join_comparer", lambda t: t("nation").RightJoin(t("region"), "n_regionkey", "r_regionkey", lambda o, i: {"n": o.n_nationkey, "r": i.r_regionkey}, on=lambda a, b: a < b).df, "SELECT n_nationkey n, r_regionkey r FROM nation RIGHT JOIN region ON n_regionkey < r_regionkey")
add("full_join_comparer", lambda t: t("nation").FullJoin(t("region"), "n_regionkey", "r_regionkey", lambda o, i: {"n": o.n_nationkey, "r": i.r_regionkey}, on=lambda a, b: a < b).df, "SELECT n_nationkey n, r_regionkey r FROM nation FULL JOIN region ON n_regionkey < r_regionkey")
add("group_join_comparer", lambda t: t("region").GroupJoin(t("nation"), "r_regionkey", "n_regionkey", lambda o, g: {"k": o.r_regionkey, "names": F.concat_ws(",", F.transform(g, lambda x: x["n_name"]))}, on=lambda a, b: a < b).df, "SELECT r_regionkey k, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS names FROM region LEFT JOIN nation ON r_regionkey < n_regionkey GROUP BY 1")
add("left_join", lambda t: t("orders").LeftJoin(rich(t), "o_custkey", "c_custkey", lambda o, i: {"ok": o.o_orderkey, "ck": i.c_custkey, "found": i.is_present()}).df, f"SELECT o_orderkey ok, c_custkey ck, c_custkey IS NOT NULL found FROM orders LEFT JOIN {RICH} ON o_custkey = c_custkey")
add("right_join", lambda t: numbered(t("orders").Where(lambda r: r.o_orderstatus == "P").RightJoin(rich(t), "o_custkey", "c_custkey", pair), "ok", "ck"), f"SELECT o_orderkey ok, c_custkey ck, row_number() OVER (ORDER BY c_custkey, o_orderkey NULLS LAST) - 1 AS ord FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') RIGHT JOIN {RICH} ON o_custkey = c_custkey")
add("full_join", lambda t: numbered(rich(t).Where(lambda r: r.c_nationkey < 12).FullJoin(t("supplier").Where(lambda r: r.s_nationkey > 9), "c_nationkey", "s_nationkey", both), "ck", "sk"), f"SELECT c_custkey ck, s_suppkey sk, row_number() OVER (ORDER BY c_custkey NULLS LAST, s_suppkey NULLS LAST) - 1 AS ord FROM (SELECT * FROM {RICH} WHERE c_nationkey < 12) FULL JOIN (SELECT * FROM supplier WHERE s_nationkey > 9) ON c_nationkey = s_nationkey")
add("group_join", lambda t: t("customer").GroupJoin(t("orders").Where(lambda r: r.o_orderstatus == "P"), "c_custkey", "o_custkey", lambda o, g: {"ck": o.c_custkey, "n": F.size(g).cast("long"), "keys": F.concat_ws(",", F.transform(g, lambda x: x["o_orderkey"].cast("string")))}).df, "SELECT c_custkey ck, count(o_orderkey) n, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey GROUP BY 1")
add("zip", lambda t: t("nation").Zip(t("region").OrderByDescending("r_name"), lambda a, b: {"n": a.n_name, "r": b.r_name}).df, "SELECT n_name n, r_name r FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) i FROM nation) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name DESC) i FROM region) USING (i)")

# -- set operators ------------------------------------------------------------------------------------------
cn = lambda t: t("customer").Where(lambda r: r.c_nationkey < 15).Select(lambda r: r.c_nationkey)
sn = lambda t: t("supplier").Where(lambda r: r.s_nationkey > 8).Select(lambda r: r.s_nationkey)
CN, SN = "(SELECT c_nationkey v, c_custkey o FROM customer WHERE c_nationkey < 15)", "(SELECT s_nationkey v, s_suppkey o FROM supplier WHERE s_nationkey > 8)"
BOTH = f"(SELECT v, 0 b, o FROM {CN} UNION ALL SELECT v, 1, o FROM {SN})"
add("union", lambda t: numbered(cn(t).Union(sn(t)), "value"), f'SELECT v AS "value", row_number() OVER (ORDER BY m) - 1 AS ord FROM (SELECT v, min(struct_pack(b := b, o := o)) m FROM {BOTH} GROUP BY 1)')
add("intersect", lambda t: numbered(cn(t).Intersect(sn(t)), "value"), f'SELECT v AS "value", row_number() OVER (ORDER BY m) - 1 AS ord FROM (SELECT v, min(o) m FROM {CN} WHERE v IN (SELECT v FROM {SN}) GROUP BY 1)')
add("except", lambda t: numbered(cn(t).Except(sn(t)), "value"), f'SELECT v AS "value", row_number() OVER (ORDER BY o) - 1 AS ord FROM {CN} WHERE v NOT IN (SELECT v FROM {SN})')
cu = lambda t: t("customer").Where(lambda r: r.c_nationkey < 15).Select(lambda r: {"k": r.c_custkey, "nk": r.c_nationkey})
su = lambda t: t("supplier").Where(lambda r: r.s_nationkey > 8).Select(lambda r: {"k": r.s_suppkey, "nk": r.s_nationkey})
add("union_by", lambda t: cu(t).UnionBy(su(t), "nk").df, f"SELECT o AS k, v AS nk FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY b, o) n FROM {BOTH}) WHERE n = 1")
add("intersect_by", lambda t: cu(t).IntersectBy(sn(t), "nk").df, f"SELECT min(o) AS k, v AS nk FROM {CN} WHERE v IN (SELECT v FROM {SN}) GROUP BY v")
add("except_by", lambda t: cu(t).ExceptBy(sn(t), "nk").df, f"SELECT min(o) AS k, v AS nk FROM {CN} WHERE v NOT IN (SELECT v FROM {SN}) GROUP BY v")

# -- terminals ----------------------------------------------------------------------------------------------
for _n in ("to_array", "to_list"):
    add(_n, lambda t: numbered(t("nation").OrderByDescending("n_name"), "n_name"), "SELECT n_name, row_number() OVER (ORDER BY n_name DESC) - 1 AS ord FROM nation")
BIG = "WHERE o_totalprice > 100000"
big = lambda r: r.o_totalprice > 100000
OD = "SELECT o_orderkey, o_totalprice FROM orders {} ORDER BY {} LIMIT 1"
one = lambda s, row: s.spark.createDataFrame([] if row is None else [(row["o_orderkey"], row["o_totalprice"])], "o_orderkey long, o_totalprice double")
for _n, _f in [("first", lambda s: s.First(big)), ("first_or_default", lambda s: s.FirstOrDefault(None, big)), ("first_or_throw", lambda s: s.FirstOrThrow(big))]:
    add(_n, lambda t, f=_f: (lambda s: one(s, f(s)))(t("orders").OrderBy("o_orderdate")), OD.format(BIG, "o_orderdate, o_orderkey"))
for _n, _f in [("last", lambda s: s.Last(big)), ("last_or_default", lambda s: s.LastOrDefault(None, big)), ("last_or_throw", lambda s: s.LastOrThrow(big))]:
    add(_n, lambda t, f=_f: (lambda s: one(s, f(s)))(t("orders").OrderBy("o_orderpriority")), OD.format(BIG, "o_orderpriority DESC, o_orderkey DESC"))
is77 = lambda r: r.o_orderkey == 77
for _n, _f in [("single", lambda s: s.Single(is77)), ("single_or_default", lambda s: s.SingleOrDefault(None, is77)), ("single_or_throw", lambda s: s.SingleOrThrow(is77))]:
    add(_n, lambda t, f=_f: (lambda s: one(s, f(s)))(t("orders")), OD.format("WHERE o_orderkey = 77", "1"))
for _n, _f in [("element_at", lambda s: s.ElementAt(41)), ("element_at_or_default", lambda s: s.ElementAtOrDefault(41))]:
    add(_n, lambda t, f=_f: (lambda s: one(s, f(s)))(t("orders").OrderByDescending("o_totalprice")), OD.format("", "o_totalprice DESC, o_orderkey") + " OFFSET 41")
NEVER = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 0"
never = lambda r: r.o_orderkey < 0
for _n, _f in [("first", lambda s: s.FirstOrDefault(None, never)), ("last", lambda s: s.LastOrDefault(None, never)), ("single", lambda s: s.SingleOrDefault(None, never)), ("element_at", lambda s: s.ElementAtOrDefault(-1))]:
    add(f"{_n}_default", lambda t, f=_f: (lambda s: one(s, f(s)))(t("orders")), NEVER)
add("min_by", lambda t: t("orders").min_by_df(lambda r: F.nullif(r.o_orderstatus, F.lit("P"))).select("o_orderkey", "o_totalprice"), OD.format("", "nullif(o_orderstatus, 'P') NULLS FIRST, o_orderkey"))
add("max_by", lambda t: t("orders").max_by_df("o_orderpriority").select("o_orderkey", "o_totalprice"), OD.format("", "o_orderpriority DESC NULLS LAST, o_orderkey"))
add("any", lambda t: t("orders").any_df(lambda r: r.o_totalprice < 0), 'SELECT EXISTS (SELECT * FROM orders WHERE o_totalprice < 0) AS "value"')
add("all", lambda t: t("orders").all_df(lambda r: r.o_totalprice > 0), 'SELECT NOT EXISTS (SELECT * FROM orders WHERE NOT o_totalprice > 0) AS "value"')
add("contains", lambda t: t("nation").Select(lambda r: r.n_nationkey).contains_df(7), 'SELECT 7 IN (SELECT n_nationkey FROM nation) AS "value"')
add("sequence_equal", lambda t: t("nation").sequence_equal_df(t("nation").OrderBy("n_nationkey")), 'SELECT true AS "value"')
add("count", lambda t: t("lineitem").count_df(lambda r: r.l_quantity > 25), 'SELECT count(*) AS "value" FROM lineitem WHERE l_quantity > 25')
add("long_count", lambda t: t("lineitem").count_df(), 'SELECT count(*) AS "value" FROM lineitem')
add("sum", lambda t: t("lineitem").sum_df("l_extendedprice"), f"SELECT CAST(sum({dec('l_extendedprice')}) AS DOUBLE) AS \"value\" FROM lineitem")
add("min", lambda t: t("lineitem").min_df("l_extendedprice"), 'SELECT min(l_extendedprice) AS "value" FROM lineitem')
add("max", lambda t: t("lineitem").max_df("l_extendedprice"), 'SELECT max(l_extendedprice) AS "value" FROM lineitem')
add("average", lambda t: t("lineitem").average_df("l_quantity").select(F.round("value", 6).alias("value")), f"SELECT round(CAST(sum({dec('l_quantity')}) AS DOUBLE) / count(*), 6) AS \"value\" FROM lineitem")
add("median", lambda t: t("orders").median_df("o_totalprice").select(F.round("value", 4).alias("value")), 'SELECT round(median(o_totalprice), 4) AS "value" FROM orders')
add("percentile", lambda t: t("orders").percentile_df(90, "o_totalprice").select(F.round("value", 4).alias("value")), 'SELECT round(quantile_cont(o_totalprice, 0.9), 4) AS "value" FROM orders')
add("aggregate", lambda t: t("events").aggregate_df(F.lit(5).cast("long"), lambda a, x: (a * 31 + x) % 1000003, "event_id"), 'SELECT list_reduce(list_prepend(CAST(5 AS BIGINT), list(event_id ORDER BY event_id)), lambda a, x: (a * 31 + x) % 1000003) AS "value" FROM events')
add("reduce", lambda t: (lambda s: s.spark.createDataFrame([(s.Reduce(0, "sum", of="event_id"),)], "value long"))(t("events")), 'SELECT CAST(sum(event_id) AS BIGINT) AS "value" FROM events')
for _n, _op in [("to_dictionary", "ToDictionary"), ("to_map", "ToMap"), ("to_object", "ToObject")]:
    add(_n, lambda t, op=_op: (lambda s: s.spark.createDataFrame([(int(k), v) for k, v in getattr(s, op)("n_nationkey", "n_name").items()], "key int, element string"))(t("nation")), "SELECT n_nationkey AS key, n_name AS element FROM nation")
for _n in ("to_set", "to_hash_set"):
    add(_n, lambda t: t("customer").SelectKeys("c_mktsegment").to_set_df(), "SELECT DISTINCT c_mktsegment FROM customer")
add("partition", lambda t: (lambda a, b: a.df.select("o_orderkey", F.lit(True).alias("fits")).unionByName(b.df.select("o_orderkey", F.lit(False).alias("fits"))))(*t("orders").Partition(big)), "SELECT o_orderkey, o_totalprice > 100000 fits FROM orders")
add("split_at", lambda t: (lambda a, b: a.df.select("event_id", F.lit(1).alias("part")).unionByName(b.df.select("event_id", F.lit(2).alias("part"))))(*t("events").SplitAt(333)), f"SELECT event_id, CASE WHEN i < 333 THEN 1 ELSE 2 END AS part FROM {EV}")
add("paginate", lambda t: t("orders").OrderBy("o_totalprice").paginate_df(2, 30).select("o_orderkey", "page", "page_size", "total", F.col("total_pages").cast("long").alias("total_pages"), "has_next", "has_previous"), "SELECT o_orderkey, 2 AS page, 30 AS page_size, (SELECT count(*) FROM orders) AS total, CAST(ceil((SELECT count(*) FROM orders) / 30.0) AS BIGINT) total_pages, (SELECT count(*) FROM orders) > 60 AS has_next, true AS has_previous FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30 OFFSET 30)")
add("cursor_page", lambda t: (lambda s: s.spark.createDataFrame([(r,) for r in s.OrderBy("o_totalprice").Pluck("o_orderkey").CursorPage(21, "60").items], "o_orderkey long"))(t("orders")), "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 21 OFFSET 60")
add("keyset_page", lambda t: t("orders").KeysetPage(20, "o_orderkey", 500).SelectKeys("o_orderkey").df, "SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 20")
add("for_each", lambda t: (lambda s, seen: (s.Pluck("n_nationkey").ForEach(lambda k: seen.append((k,))), s.spark.createDataFrame(seen, "n_nationkey int"))[1])(t("nation"), []), "SELECT n_nationkey FROM nation")
add("explain", lambda t: (lambda s: s.spark.createDataFrame([(e["index"], e["kind"]) for e in s.Explain()], "idx long, kind string"))(t("orders").Where(big).OrderBy("o_totalprice").Take(3)), "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'where'), (1, 'orderBy'), (2, 'take')) t(idx, kind)")
add("explain_text", lambda t: (lambda s: s.spark.createDataFrame([(s.ExplainText(),)], "text string"))(t("orders").Where(big).Take(3)), "SELECT '0: where' || chr(10) || '1: take (3)' AS text")

# -- sources, filters, streams ------------------------------------------------------------------------------
add("range", lambda t: range_(t("region").spark, 5, 10).df, 'SELECT range AS "value" FROM range(5, 15)')
add("repeat", lambda t: repeat(t("region").spark, "x", 4).df, "SELECT 'x' AS \"value\" FROM range(4)")
add("empty", lambda t: (lambda s: empty(s.spark, s.schema).df)(t("region")), "SELECT * FROM region WHERE false")
add("pipe", lambda t: t("region").pipe(lambda s: s.WhereGt("r_regionkey", 2)).df, "SELECT * FROM region WHERE r_regionkey > 2")
FILTER = '?page=1&filter={"and":[{"field":"o_totalprice","op":"between","value":1000,"value2":120000},{"or":[{"field":"o_orderstatus","op":"eq","value":"F"},{"not":{"field":"o_orderpriority","op":"startsWith","value":"5"}}]}]}'
add("query_string", lambda t: keep((lambda s: s.Where(predicate_from_parsed_query(s.schema, parse_query_string(FILTER))))(t("orders"))), OK2 + "o_totalprice BETWEEN 1000 AND 120000 AND (o_orderstatus = 'F' OR NOT starts_with(o_orderpriority, '5'))")
add("filter_json", lambda t: keep((lambda s: s.Where(build_predicate(s.schema, parse_filter_json('{"not": {"field": "o_orderstatus", "op": "in", "value": ["F", "O"]}}'))))(t("orders"))), OK2 + "o_orderstatus NOT IN ('F', 'O')")
add("json_path", lambda t: t("events").Select(lambda r: {"event_id": r.event_id, "k": F.get_json_object(r.props, "$.k").cast("long")}).df, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events")


def events_stream(spark: SparkSession, sf_dir: str) -> StreamSeq:
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    # a stream reads a folder: the table itself, or the folder that holds its one file
    one_file = batch.inputFiles()[0].endswith("/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet" if one_file else "*.parquet").load(sf_dir if one_file else path)
    return StreamSeq(stream)


def add_stream(name: str, func: Callable, sql: str) -> None:
    """A grouped result over a file stream, run to the end of what is there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = func(events_stream(spark, sf_dir), lambda t: table(spark, sf_dir, t)).to_table(f"seqloom_{name}", "complete")
        query.awaitTermination()
        return spark.table(f"seqloom_{name}")

    QUERIES[f"op_{name}"], ORACLES[f"op_{name}"] = run, sql


add_stream("stream_count_by", lambda s, t: s.Where(lambda r: r.value > 10).CountBy("event_type"), "SELECT event_type, count(*) AS count FROM events WHERE value > 10 GROUP BY 1")
add_stream("stream_select_many", lambda s, t: s.SelectMany(lambda r: F.array(r.event_type, F.upper(r.event_type))).CountBy("value"), 'SELECT unnest([event_type, upper(event_type)]) AS "value", count(*) AS count FROM events GROUP BY 1')
add_stream("stream_join", lambda s, t: s.Select(lambda r: {"k": (r.user_id % 25).cast("int")}).Join(t("nation").df.withColumnRenamed("n_nationkey", "k"), "k").CountBy("n_name"), "SELECT n_name, count(*) AS count FROM events JOIN nation ON user_id % 25 = n_nationkey GROUP BY 1")
