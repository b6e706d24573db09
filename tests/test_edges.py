"""Values, plans and entry points that the differential queries do not reach."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import seqloom as q
from seqloom.operators import lazy
from seqloom.plans import order
from seqloom.sources.read import from_rows, range_


def doubles(spark, expr: str, n: int):
    return q.from_df(spark.range(n).select(F.expr(expr).alias("value")), ["value"])


@pytest.mark.parametrize("expr, n, want", [("1e-13", 1_000_000, 1e-7), ("0.1", 1_000_000, 100_000.0), ("9e17", 200_000, 1.8e23), ("CASE WHEN id = 0 THEN 1e300 ELSE 1.0 END", 9, 1e300), ("0.1 + 1e-11", 1000, 100.00000001)])
def test_sums_of_doubles(spark, expr, n, want):
    s = doubles(spark, f"CAST({expr} AS DOUBLE)", n)
    assert s.Sum() == pytest.approx(want, rel=1e-12) and s.Average() == pytest.approx(want / n, rel=1e-12)


def test_sums_that_run_over(spark):
    many = spark.range(200).select(F.lit(9.1e17 + 0.0).alias("value")).withColumn("value", F.col("value") + F.rand() * 0)
    one = q.from_df(many, ["value"])
    assert one.Sum() == pytest.approx(1.82e20)
    big = q.from_df(spark.sql("SELECT explode(sequence(1, 3)) AS k, CAST(9e17 AS DOUBLE) AS value"), ["k"])
    assert big.Sum("value") == 2.7e18
    odd = q.from_df(spark.sql("SELECT CAST(v AS DOUBLE) AS value FROM VALUES (1.5), (NULL), (double('NaN')) t(v)"), ["value"])
    assert math.isnan(odd.Sum())
    exact = q.from_df(spark.sql("SELECT CAST(v AS DOUBLE) AS value FROM VALUES (0.1), (0.2), (NULL), (1e15), (-1e15) t(v)"), ["value"])
    assert exact.Sum() == 0.3 and q.from_df(spark.range(0).select(F.lit(1.0).alias("value"))).Sum() == 0.0


def test_size_test_sees_exploded_rows(spark):
    s = q.from_df(spark.range(10), ["id"]).SelectMany(lambda r: F.sequence(F.lit(1), F.lit(9000)))
    assert not order.small_plan(s._df, 1 << 20) and order.small_plan(s._df, 16 << 20)
    out = order.with_ordinal(s._df, s._keys, 1 << 20)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert out.agg(F.count_distinct(order.ORD), F.max(order.ORD), F.sum("value")).head()[:] == (90_000, 89_999, 10 * sum(range(1, 9001)))


def test_skips_and_pages_far_on(spark, monkeypatch):
    s = range_(spark, 0, 5000).OrderByDescending("value")
    near = s.Page(3, 7).ToArray()
    assert "TakeOrderedAndProject" in s.Skip(14).Take(7)._df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lazy, "NEAR", 0)
    assert s.Page(3, 7).ToArray() == near == list(range(4985, 4978, -1))
    assert s.Skip(4998).ToArray() == [1, 0] and s.Skip(10).Take(0).ToArray() == [] and s.ElementAt(4999) == 0
    assert "CollectLimit" not in s.Skip(10)._df._jdf.queryExecution().executedPlan().toString()
    assert [e["kind"] for e in s.Skip(3).Take(2).Explain()] == ["orderBy", "skip", "take"]


def test_order_without_positions(spark):
    a, b = from_rows(spark, [3, 1, 2]), from_rows(spark, [9, 1])
    for s, want in [(a.Concat(b), [3, 1, 2, 9, 1]), (a.Prepend(b), [9, 1, 3, 1, 2]), (a.Union(b), [3, 1, 2, 9]), (a.Concat(a).Reverse(), [2, 1, 3, 2, 1, 3])]:
        assert s.ToArray() == want
        assert "Window [row_number" not in s._df._jdf.queryExecution().optimizedPlan().toString() or s.ToArray() == [3, 1, 2, 9]
    long = a
    for _ in range(12):
        long = long.Append(b)
    assert long.ToArray() == [3, 1, 2] + [9, 1] * 12
    rows = from_rows(spark, [{"k": k % 3, "v": k} for k in range(9)])
    assert {g["key"]: list(g["elements"]) for g in rows.OrderByDescending("v").GroupBy("k", "v").ToArray()} == {2: [8, 5, 2], 1: [7, 4, 1], 0: [6, 3, 0]}
    assert [g["key"] for g in rows.OrderByDescending("v").GroupBy("k").Agg(n=F.count("*")).ToArray()] == [2, 1, 0]
    assert [g["key"] for g in rows.OrderByDescending("k").ThenBy("v").GroupBy("k", "v").ToArray()] == [2, 1, 0]
    assert rows.OrderByDescending("v").Mode("k") == 2


def test_percentile_by_rank(spark, monkeypatch):
    s = doubles(spark, "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id * 37 % 101 AS DOUBLE) END", 500)
    want = [s.Percentile(p) for p in (0, 12.5, 50, 99, 100)]
    monkeypatch.setattr(order, "ONE_TASK_BYTES", 0)
    assert [s.Percentile(p) for p in (0, 12.5, 50, 99, 100)] == pytest.approx(want)
    assert s.Where(lambda r: r["value"] < -1).median_df().head()[0] is None


def test_joins_by_comparer(spark):
    a = from_rows(spark, [{"x": v} for v in (1, 2, 2, None)])
    b = from_rows(spark, [{"y": v} for v in (2, 3, None)])
    pair = lambda o, i: {"x": o.x, "y": i.y}
    less = lambda k, m: k < m
    got = {how: Counter(map(tuple, getattr(a, how)(b, "x", "y", pair, on=less).ToArray())) for how in ("Join", "LeftJoin", "RightJoin", "FullJoin")}
    inner = Counter([(1, 2), (1, 3), (2, 3), (2, 3)])
    assert got == {"Join": inner, "LeftJoin": inner + Counter([(None, None)]), "RightJoin": inner + Counter([(None, None)]), "FullJoin": inner + Counter({(None, None): 2})}
    assert a.FullJoin(b, "x", "y", pair).ToArray() == [(1, None), (2, 2), (2, 2), (None, None), (None, 3)]
    assert [tuple(r) for r in a.GroupJoin(b, "x", "y", lambda o, g: {"x": o.x, "n": F.size(g)}, on=less).ToArray()] == [(1, 2), (2, 1), (2, 1), (None, 0)]


def test_statics_register_and_selectors(spark):
    assert q.Seq.range(spark, 2, 3).ToArray() == [2, 3, 4] and q.Seq.from_rows(spark, ["a"]).ToArray() == ["a"]
    assert isinstance(q.AsyncSeq.repeat(spark, 1, 2), q.AsyncSeq) and q.Seq.empty(spark).ToArray() == []
    q.register("Doubled", lambda s: s.Select(lambda r: r["value"] * 2), replace=True)
    assert q.Seq.range(spark, 1, 2).Doubled().doubled().ToArray() == [4, 8]
    with pytest.raises(ValueError):
        q.register("Where", lambda s: s)
    with pytest.raises(ValueError):
        q.register("lower", lambda s: s)
    rows = from_rows(spark, [{"a": 1, "b": 2, "c": 3}])
    p = q.predicates
    assert rows.Select(p.pluck("b")).ToArray() == [2]
    assert rows.Select(p.select_keys("a", "c")).columns == ["a", "c"] and rows.Select(p.omit_keys("a")).columns == ["b", "c"]


def test_terminals_beside_their_queries(spark, tmp_path):
    s = from_rows(spark, [{"k": "x", "v": 1}, {"k": "y", "v": 2}, {"k": "x", "v": 3}])
    with pytest.raises(q.InvalidOperationError):
        s.ToDictionary("k", "v")
    assert s.DistinctBy("k").ToObject("v", "k") == {"1": "x", "2": "y"} and s.ToLookup("k", "v").get("x") == [1, 3]
    path = str(tmp_path)
    s.ForEach(lambda r: open(f"{path}/{r['v']}", "w").close(), concurrency=2)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1", "2", "3"]
    assert s.Tap(lambda r: open(f"{path}/t{r['v']}", "w").close()).Count() == 3
    assert s.ElementAtOrDefault(7, "none") == "none" and s.FirstOrDefault("none", lambda r: r.v > 9) == "none"


def test_temporary_tables_need_a_shared_folder(spark):
    class Far:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Far, type("Conf", (), {"get": staticmethod(lambda k, d: None)})

    with pytest.raises(RuntimeError):
        order.shared_folder(Session)


def test_folds_in_a_streaming_pass(spark):
    s = q.from_df(spark.range(2000).select((F.col("id") * 7919 % 2003).alias("v"), (F.col("id") % 5).cast("int").alias("k")).repartition(6), ["v"])
    rows = sorted((i * 7919 % 2003, i % 5) for i in range(2000))
    step = lambda acc, x: (acc * 31 + x) % 1000003
    want = [5]
    for v, _ in rows:
        want.append(step(want[-1], v))
    assert s.Scan(5, q.py(step, "long"), "v").ToArray() == want
    assert s.Aggregate(5, q.py(step, "long"), "v") == want[-1] and s.Reduce(5, q.py(step, "long"), of="v") == want[-1]
    assert s.Where(lambda r: r.v < 0).Aggregate(5, q.py(step, "long"), "v") == 5 and s.Where(lambda r: r.v < 0).Scan(5, q.py(step, "long"), "v").ToArray() == [5]
    groups, first = {}, {}
    for v, k in rows:
        groups[k], first[k] = step(groups.get(k, v + 1), v), first.get(k, v)
    fold = q.py(lambda acc, r: step(acc, r["v"]), "long")
    got = s.AggregateBy("k", lambda r: r["v"] + 1, fold).ToArray()
    assert [tuple(r) for r in got] == [(k, groups[k]) for k in sorted(groups, key=first.get)]
    pairs = {}
    for v, k in rows:
        pair = pairs.setdefault(k % 2, [k, 0])
        pair[1] = step(pair[1], v)
    assert Counter(tuple(r) for r in s.AggregateBy("k", 0, fold, comparer=lambda c: c % 2).ToArray()) == Counter(map(tuple, pairs.values()))
    keyed = from_rows(spark, [{"k": x, "v": n} for n, x in enumerate([None, 1.5, float("nan"), None, float("nan")])])
    assert sorted(r["value"] for r in keyed.AggregateBy("k", 0, q.py(lambda a, r: a + r["v"], "long")).ToArray()) == [1, 3, 6]


def test_for_each_stops_at_a_signal(spark, tmp_path):
    import threading
    import time

    stop, seen = threading.Event(), []
    with pytest.raises(q.AbortedError):
        range_(spark, 0, 100).ForEach(lambda x: (seen.append(x), x == 6 and stop.set()), signal=stop)
    assert seen == list(range(7))
    path = str(tmp_path)
    from_rows(spark, ["b", "a"]).Order().ForEach(lambda x, n: open(f"{path}/{n}{x}", "w").close(), concurrency=2)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0a", "1b"]
    late = threading.Event()
    threading.Timer(1.5, late.set).start()
    with pytest.raises(q.AbortedError):
        range_(spark, 0, 60).ForEach(lambda x: time.sleep(0.5), concurrency=2, signal=late)
