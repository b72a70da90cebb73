"""Oversized groups give the same answers as one plain sort."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticework.functions import ordered as O


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": np.where(np.arange(3000) < 2000, "hot", rng.choice(list("abc"), 3000)),
                        "o": rng.permutation(3000), "v": rng.choice(list("xyz"), 3000, p=[.8, .1, .1]),
                        "q": np.round(rng.lognormal(size=3000), 2)})
    return pdf, spark.createDataFrame(pdf).repartition(8).cache()


@pytest.mark.parametrize("hot_rows", [37, 500, 10**6])
def test_row_index(data, hot_rows):
    pdf, df = data
    want = pdf.assign(r=pdf.groupby("k")["o"].rank().astype(int) - 1).set_index("o")["r"]
    got = O.row_index(df, ["k"], ["o"], "r", hot_rows).toPandas().set_index("o")["r"]
    assert (got.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("hot_rows", [3, 37, 500, 10**6])
def test_runs(data, hot_rows):
    pdf, df = data
    s = pdf.sort_values(["k", "o"])
    new = (s["v"] != s.groupby("k")["v"].shift()).astype(int)
    want = s.assign(run=new.groupby(s["k"]).cumsum()).groupby(["k", "run"]).agg(v=("v", "first"), o=("o", "min"), n=("o", "size"))
    got = O.runs(df, ["k"], "v", "o", hot_rows).toPandas()
    assert sorted(map(tuple, got[["k", "run_start", "run_length", "v"]].values)) == sorted(
        map(tuple, want.reset_index()[["k", "o", "n", "v"]].values))


@pytest.mark.parametrize("hot_rows", [100, 10**6])
def test_quantiles(data, hot_rows):
    pdf, df = data
    got = O.quantiles(df, ["k"], "q", {"a": .1, "b": .5, "c": .93}, hot_rows=hot_rows).toPandas().set_index("k")
    want = pdf.groupby("k")["q"].quantile([.1, .5, .93]).unstack()
    assert np.allclose(got.loc[want.index, ["a", "b", "c"]].values, want.values)


def test_weighted_quantiles_match_repeated_rows(data):
    pdf, df = data
    counted = df.groupBy("k", "q").agg(F.count("*").alias("w"))
    for hot_rows in (50, 10**6):
        got = O.quantiles(counted, ["k"], "q", {"b": .5}, F.col("w"), hot_rows).toPandas().set_index("k")["b"]
        want = pdf.groupby("k")["q"].median()
        assert np.allclose(got.loc[want.index], want)


def test_fill_forward_crosses_buckets(spark):
    rows = [("f", i // 4, i, i * 10 if i in (1, 9) else None) for i in range(16)]
    df = spark.createDataFrame(rows, "f string, b int, o int, m int").repartition(5)
    got = {r.o: r.x for r in O.fill_forward(df, ["f"], "b", "o", "m", "x").collect()}
    assert got == {i: None if i < 1 else 10 if i < 9 else 90 for i in range(16)}


def test_order_statistics(data):
    pdf, df = data
    got = O.values_at_ranks(df, ["k"], "q", {"last": lambda n: n - 1, "mid": lambda n: F.floor(n / 2)}).toPandas()
    for k, values in pdf.groupby("k")["q"]:
        ordered = np.sort(values.values)
        mine = got[got.k == k].set_index("stat")["value"]
        assert mine["last"] == ordered[-1] and mine["mid"] == ordered[len(ordered) // 2]


@pytest.mark.parametrize("hot_rows", [3, 7, 1000])
def test_any_limit_gives_the_same_result(spark, hot_rows):
    """Nulls first, ties by the next column, one far value, null keys."""
    rows = [(None if i % 5 == 0 else "a", None if i % 4 == 3 else float(i % 6), i, i % 3) for i in range(60)] + [("a", 1e12, 99, 1)]
    df = spark.createDataFrame(rows, "k string, o double, id long, v int")
    got = {r.id: r.r for r in O.row_index(df, ["k"], ["o", "id"], "r", hot_rows).collect()}
    for key in (None, "a"):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        assert [got[r[2]] for r in mine] == list(range(len(mine)))
    found = sorted(map(str, O.runs(df, ["k"], "v", ["o", "id"], hot_rows).collect()))
    assert found == sorted(map(str, O.runs(df, ["k"], "v", ["o", "id"]).collect()))
    middle = {r.k: r.b for r in O.quantiles(df, ["k"], "o", {"b": .5}, hot_rows=hot_rows).collect()}
    assert middle == {r.k: r.b for r in O.quantiles(df, ["k"], "o", {"b": .5}).collect()} and None in middle


def test_ties_in_the_first_columns_are_cut_by_later_ones(spark):
    rows = [("a", 7.0, f"t{k:02}", k % 2) for k in range(12)] + [("b", 1.0, "x", 0)]
    df = spark.createDataFrame(rows, "k string, o double, t string, v int").repartition(3)
    hot = O.hot_groups(df, ["k"], ["o", "t"], 3)
    buckets = O._cut(df, hot, ["k"], ["o", "t"]).groupBy("k", "_bucket").count().collect()
    assert sorted((r.k, r._bucket, r["count"]) for r in buckets) == [("a", 0, 3), ("a", 1, 3), ("a", 2, 3), ("a", 3, 3), ("b", 0, 1)]
    got = {(r.k, r.t): r.r for r in O.row_index(df, ["k"], ["o", "t"], "r", 3).collect()}
    assert got == {(r.k, r.t): r.r for r in O.row_index(df, ["k"], ["o", "t"], "r").collect()}


def test_many_equal_rows_in_a_hot_group(spark):
    rows = [(1, k % 5, k // 400) for k in range(4000)]
    df = spark.createDataFrame(rows, "k int, o int, v int").repartition(5)
    got = sorted(r.r for r in O.row_index(df, ["k"], ["o", "v"], "r", 150).collect())
    assert got == list(range(4000))
    firsts = {r.o: r.f for r in O.row_index(df, ["k"], ["o", "v"], "r", 150).groupBy("o").agg(F.min("r").alias("f")).collect()}
    assert firsts == {o: 800 * o for o in range(5)}
