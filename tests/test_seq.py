import asyncio

import pytest
from pyspark.sql import functions as F

import seqloom as q
from seqloom.functions import filters, pagination, result
from seqloom.plans.order import ORD, running, with_ordinal
from seqloom.streaming.stream import StreamSeq


@pytest.fixture(scope="module")
def seq(spark):
    return lambda rows, schema=None: q.from_rows(spark, rows, schema)


CASES = [
    ("where", [1, 2, 3, 4], lambda s: s.Where(lambda r: r["value"] % 2 == 0), [2, 4]),
    ("where after reorder", [3, 1, 2], lambda s: s.OrderBy(None).Where(lambda r, i: i > 0), [2, 3]),
    ("select", [1, 2], lambda s: s.Select(lambda r: r["value"] * 10), [10, 20]),
    ("take", [3, 1, 2], lambda s: s.Take(2), [3, 1]),
    ("where take none", [1, 2], lambda s: s.Where(lambda r: r["value"] > 0).Take(0), []),
    ("skip", [3, 1, 2], lambda s: s.Skip(1), [1, 2]),
    ("take while", [1, 2, 5, 1], lambda s: s.TakeWhile(lambda r: r["value"] < 3), [1, 2]),
    ("take while all", [1, 2], lambda s: s.TakeWhile(lambda r: r["value"] < 3), [1, 2]),
    ("skip while", [1, 2, 5, 1], lambda s: s.SkipWhile(lambda r: r["value"] < 3), [5, 1]),
    ("take last", [1, 2, 3], lambda s: s.TakeLast(2), [2, 3]),
    ("skip last", [1, None, 3], lambda s: s.SkipLast(1), [1, None]),
    ("default", [1], lambda s: s.Where(lambda r: r["value"] > 1).DefaultIfEmpty(7), [7]),
    ("chunk", [1, 2, 3, 4, 5], lambda s: s.Chunk(2), [[1, 2], [3, 4], [5]]),
    ("buffer", [1, 2, 3, 4, 5], lambda s: s.Buffer(2, 3), [[1, 2], [3, 4]]),
    ("buffer step", [1, 2, 3, 4, 5], lambda s: s.Buffer(3), [[1, 2, 3], [2, 3, 4], [3, 4, 5]]),
    ("scan", [1, 2, 3], lambda s: s.Scan(0, "sum"), [0, 1, 3, 6]),
    ("scan lambda", [1, 2, 3], lambda s: s.Scan(F.lit(1).cast("long"), lambda a, x: a * x), [1, 1, 2, 6]),
    ("adjacent", [1, 1, None, None, 1], lambda s: s.AdjacentDistinct(), [1, None, 1]),
    ("nulls last", [3, None, 1, None, 2], lambda s: s.Order(), [1, 2, 3, None, None]),
    ("nulls last, down", [3, None, 1], lambda s: s.OrderDescending(), [3, 1, None]),
    ("nulls first", [3, None, 1], lambda s: s.Order(nulls="first"), [None, 1, 3]),
    ("locale", ["ä", "z", "a"], lambda s: s.Order(locale="de"), ["a", "ä", "z"]),
    ("reverse", [1, 3, 2], lambda s: s.Reverse(), [2, 3, 1]),
    ("distinct", [2, 1, 2, None, None], lambda s: s.Distinct(), [2, 1, None]),
    ("distinct folded", ["a", "A", "b"], lambda s: s.Distinct(F.lower), ["a", "b"]),
    ("concat", [1], lambda s: s.Concat([1, 2]), [1, 1, 2]),
    ("prepend", [1], lambda s: s.Prepend([3, 2]), [3, 2, 1]),
    ("union", [2, 1], lambda s: s.Union([3, 2]), [2, 1, 3]),
    ("intersect", [3, 1, 3, None], lambda s: s.Intersect([None, 3]), [3, None]),
    ("except keeps repeats", [1, 1, 2, None], lambda s: s.Except([2]), [1, 1, None]),
    ("except distinct", [1, 1, 2], lambda s: s.Except([2], distinct=True), [1]),
    ("pairwise", [1, 2, 4], lambda s: s.Pairwise().Select(lambda r: r.cur - r.prev), [1, 2]),
    ("zip", [1, 2, 3], lambda s: s.Zip([5, 6], lambda a, b: a["value"] + b["value"]), [6, 8]),
    ("index", [5, 6], lambda s: s.WithIndex().Select(lambda r: r["index"] * 100 + r["value"]), [5, 106]),
    ("try", ["1", "x", "3"], lambda s: s.TryWhere(q.py(lambda r: int(r["value"]) > 0, "boolean")), ["1", "3"]),
    ("union by", [1, 2], lambda s: s.UnionBy([12, 3], lambda r: r["value"] % 10), [1, 2, 3]),
]


@pytest.mark.parametrize("rows, op, want", [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_lazy(seq, rows, op, want):
    s = op(seq(rows))
    assert s.ToArray() == want
    assert asyncio.run(s.as_async().ToArrayAsync()) == want


def test_order_chains(seq):
    s = seq([("a", 2, 1), ("b", 1, 2), ("c", 1, 1)], "n string, x long, y long")
    assert [r["n"] for r in s.OrderBy("x").OrderBy("y").ToArray()] == ["c", "b", "a"]  # the second only breaks ties
    assert [r["n"] for r in s.OrderBy("x").Where(lambda r: r.x > 0).OrderBy("y").ToArray()] == ["c", "a", "b"]


def test_joins(seq):
    a = seq([(1, "x"), (None, "y"), (2, "z")], "id long, v string")
    b = seq([(2, "p"), (None, "q"), (3, "r"), (2, "s")], "id long, w string")
    pick = lambda o, i: {"v": o.v, "w": i.w}
    got = lambda s: [tuple(r) for r in s.ToArray()]
    assert got(a.Join(b, "id", "id", pick)) == [("y", "q"), ("z", "p"), ("z", "s")]
    assert got(a.LeftJoin(b, "id", "id", pick)) == [("x", None), ("y", "q"), ("z", "p"), ("z", "s")]
    assert got(a.RightJoin(b, "id", "id", pick)) == [("z", "p"), ("y", "q"), (None, "r"), ("z", "s")]
    assert got(a.FullJoin(b, "id", "id", pick)) == [("x", None), ("y", "q"), ("z", "p"), ("z", "s"), (None, "r")]
    assert [len(r["matches"]) for r in a.GroupJoin(b, "id", "id").ToArray()] == [0, 1, 2]


def test_groups(seq):
    s = seq([("b", 1), (None, 2), ("b", 3), ("a", 4)], "k string, v long")
    assert [(r["key"], r["elements"]) for r in s.GroupBy("k", "v").ToArray()] == [("b", [1, 3]), (None, [2]), ("a", [4])]
    assert s.CountBy("k") == {"b": 2, None: 1, "a": 1}
    assert [tuple(r) for r in s.AggregateBy("k", F.lit(10).cast("long"), lambda a, x: a + x["v"]).ToArray()] == [("b", 14), (None, 12), ("a", 14)]
    assert s.ToLookup("k", "v").get("zz") == []
    assert seq(["b", "a", "b", "a"]).Mode() == "b"
    with pytest.raises(q.InvalidOperationError):
        s.ToDictionary("k")
    assert s.DistinctBy("k").ToDictionary("k", "v") == {"b": 1, None: 2, "a": 4}


def test_terminals(seq):
    s, none = seq([3, 1, 2]), seq([], "long")
    assert (s.First(), s.Last(), s.ElementAt(1), s.Count(), s.Sum(), s.Min(), s.Max(), s.Average(), s.Median()) == (3, 2, 1, 3, 6, 1, 3, 2.0, 2.0)
    assert s.Percentile(30) == pytest.approx(1.6) and s.Any() and not none.Any() and none.All(lambda r: r["value"] > 0)
    assert none.Sum() == 0 and none.FirstOrDefault(9) == 9 and s.ElementAtOrDefault(7, -1) == -1
    assert s.Aggregate(0, lambda a, x, i: a + x * i) == 5 and s.Reduce(lambda a, x: a - x) == 0
    for f in (none.First, none.Min, none.Average, none.Mode, lambda: none.Reduce(max), none.Single):
        with pytest.raises(q.EmptySequenceError):
            f()
    with pytest.raises(q.MoreThanOneElementError):
        s.Single()
    for f in (lambda: s.ElementAt(-1), lambda: s.ElementAt(3), lambda: s.Percentile(101)):
        with pytest.raises(q.ArgumentOutOfRangeError):
            f()
    for f in (lambda: s.Take(-1), lambda: s.Chunk(0), lambda: s.SplitAt(-1), lambda: s.WhereEq("a..b", 1)):
        with pytest.raises(ValueError):
            f()
    assert s.Contains(1) and s.SequenceEqual([3, 1, 2]) and not s.SequenceEqual([3, 1]) and s.ToSet() == {1, 2, 3}
    a, b = s.SplitAt(1)
    assert a.ToArray() == [3] and b.ToArray() == [1, 2]
    seen = []
    s.ForEach(lambda x, i: seen.append((i, x)))
    assert seen == [(0, 3), (1, 1), (2, 2)]
    assert seq([None, 4]).Average() == 2.0 and seq([None, 4]).Median() == 4.0
    with pytest.raises(TypeError):
        s.Where(lambda r: 1 if r else 2)


def test_null_keys_of_extremes(seq):
    s = seq([(1, None), (2, 5), (3, 1)], "id long, k long")
    assert s.MinBy("k")["id"] == 1 and s.MaxBy("k")["id"] == 2


def test_exact_sum(spark):
    assert q.repeat(spark, 0.1, 100_000).Sum() == 10000.0


def test_pages(seq):
    s = seq(list(range(7)))
    p = s.Paginate(2, 3)
    assert (p.items, p.total, p.total_pages, p.has_next, p.has_previous) == ([3, 4, 5], 7, 3, True, True)
    c = s.CursorPage(3, "3")
    assert c.items == [3, 4, 5] and c.next_cursor == "6" and s.CursorPage(3, "6").next_cursor is None
    assert s.CursorPage(2, "junk").items == [0, 1] and s.KeysetPage(2, "value", 3).ToArray() == [4, 5]
    assert pagination.create_page_result([], 1, 0, 5).total_pages == 0


def test_filters(seq):
    s = seq([(1, "ab", None), (2, "cd", 5)], "id long, t string, n long")
    run = lambda g: [r["id"] for r in s.Where(filters.build_predicate(s.schema, g)).ToArray()]
    assert run({"not": {"field": "n", "op": "gt", "value": 3}}) == [1]
    assert run({"or": []}) == [1, 2] and run({"field": "t", "op": "contains"}) == [1, 2]
    assert run({"field": "n", "op": "nin", "value": [5]}) == [1] and run({"field": "zz", "op": "null"}) == [1, 2]
    with pytest.raises(ValueError):
        run({"field": "n", "op": "like"})
    assert filters.parse_filter_json('{"field":"n","op":"eq","value":5,"__proto__":1}') == {"and": [{"field": "n", "op": "eq", "value": 5}]}
    assert filters.parse_filter_json("[]") == {"and": []}
    with pytest.raises(ValueError):
        filters.parse_filter_json('{"field":"n","op":"eq"}', allowed=["id"])
    with pytest.raises(ValueError):
        filters.parse_filter_json("{\"not\":" * 8 + '{"field":"n","op":"null"}' + "}" * 8)
    assert filters.parse_query_string("page=2&page_size=x&limit=5000&sort=-id") == {"page": 2, "limit": 1000, "sort": "-id"}
    assert filters.clamp_limit(float("nan")) == 1 and filters.safe_api_error(None) == "Request failed"
    with pytest.raises(ValueError):
        filters.validate_filter_with_schema({"field": "zz", "op": "null"}, lambda g: (True, g), s.schema)


def test_results():
    assert result.from_nullable(None) is result.NONE and result.some(1).value == 1
    assert result.try_run_sync(lambda: 1 // 0).is_ok is False
    assert asyncio.run(result.try_run(lambda: asyncio.sleep(0, 3))).value == 3


def test_ordinals_agree(spark):
    s = q.range_(spark, 0, 5000).OrderByDescending(lambda r: r["value"] % 7)
    small, large = (with_ordinal(s._df, s._keys, n).select("value", ORD) for n in (1 << 60, 0))
    assert small.exceptAll(large).count() == 0 and large.agg(F.max(ORD)).head()[0] == 4999


def test_running_over_blocks(spark):
    df = spark.range(50).select(F.col("id").alias(ORD), (F.col("id") * 7 % 11).alias("v"))
    for kind, fold in (("sum", sum), ("max", max), ("count", len)):
        got = [r["x"] for r in running(df, "x", kind, F.col("v"), block=8).orderBy(ORD).collect()]
        v = [i * 7 % 11 for i in range(50)]
        assert got == [fold(v[: i + 1]) for i in range(50)]


def test_filters_reach_the_scan(spark):
    df = q.read(spark, "/root/testdata/sf0.001/orders.parquet", order_by=["o_orderkey"]).WhereGt("o_custkey", 70).SelectKeys("o_orderkey").df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_custkey,70)" in plan and "o_comment" not in plan and "o_totalprice" not in plan


def test_aggregates_skip_arrays(spark):
    s = q.read(spark, "/root/testdata/sf0.001/events.parquet", order_by=["event_id"])
    plan = s.GroupBy("event_type").Agg(n=F.count("*")).df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_stream(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    got = []
    StreamSeq(stream).Where(lambda r: r.id > 6).for_each_batch(lambda s, n: got.extend(s.OrderByDescending("id").Select("id").ToArray()), str(tmp_path / "cp")).awaitTermination()
    assert got == [9, 8, 7]


@pytest.mark.parametrize("seed", range(3))
def test_laws(seq, seed):
    import random

    rnd = random.Random(seed)
    v = [rnd.randint(-9, 9) for _ in range(30)]
    s, even, low = seq(v), (lambda r: r["value"] % 2 == 0), (lambda r: r["value"] < 3)
    assert s.Select(lambda r: r["value"]).ToArray() == v
    assert s.Where(even).Where(low).ToArray() == s.Where(low).Where(even).ToArray() == s.Where(even).Where(low).Where(even).ToArray()
    assert s.OrderBy(lambda r: r["value"] % 3).ToArray() == sorted(v, key=lambda x: (abs(x) % 3) * (1 if x >= 0 else -1))
    assert s.Reverse().Reverse().ToArray() == v and s.Take(10).Concat(s.Skip(10)).ToArray() == v
