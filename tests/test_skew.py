"""One key or one value holds much of the data: the sliced and salted forms give the plain result."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from periodica.operators import joins, ordered, projects


@pytest.fixture(scope="module")
def events(spark):
    """A key with half of the rows, a time that a third of the rows share, missing values."""
    rng = random.Random(1)
    data = [
        ("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 40)}", 500 if rng.random() < 0.33 else rng.randint(0, 1000),
         i, float(rng.randint(1, 99)) if rng.random() < 0.8 else None)
        for i in range(3000)
    ]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, at int, id int, v double").repartition(5).cache()


def _series(data, keyed):
    groups = defaultdict(list)
    for row in sorted(data, key=lambda r: (r[1], r[2])):
        groups[row[0] if keyed else None].append(row)
    return groups.values()


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("slices", [3, 16])
def test_lags(events, keyed, slices):
    data, df = events
    out = ordered.lag_columns(df, {"v1": ("v", 1), "v5": ("v", 5)}, "at", "id", keys="k" if keyed else (), slices=slices)
    got = {r["id"]: (r["v1"], r["v5"]) for r in out.collect()}
    want = {}
    for s in _series(data, keyed):
        for i, row in enumerate(s):
            want[row[2]] = (s[i - 1][3] if i >= 1 else None, s[i - 5][3] if i >= 5 else None)
    assert got == want


@pytest.mark.parametrize("keyed", [True, False])
def test_rolling_mean(events, keyed):
    data, df = events
    out = ordered.rolling_mean(df, "id", 7, "m", "at", "id", keys="k" if keyed else (), slices=9)
    got = {r["id"]: r["m"] for r in out.collect()}
    for s in _series(data, keyed):
        for i, row in enumerate(s):
            want = sum(x[2] for x in s[i - 6:i + 1]) / 7 if i >= 6 else None
            assert got[row[2]] == (pytest.approx(want) if want is not None else None)


def test_rolling_mean_longer_than_a_slice(events):
    data, df = events
    got = {r["id"]: r["m"] for r in ordered.rolling_mean(df, "id", 900, "m", "at", "id", slices=16).collect()}
    s = next(iter(_series(data, False)))
    for i in (0, 898, 899, 1500, 2999):
        want = sum(x[2] for x in s[i - 899:i + 1]) / 900 if i >= 899 else None
        assert got[s[i][2]] == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("keyed", [True, False])
def test_previous_known(events, keyed):
    data, df = events
    out = ordered.previous_known(df, ["v"], "at", "id", keys="k" if keyed else (), slices=12)
    got = {r["id"]: r["v_prev"] for r in out.collect()}
    for s in _series(data, keyed):
        last = None
        for row in s:
            assert got[row[2]] == last
            last = row[3] if row[3] is not None else last


@pytest.mark.parametrize("keyed", [True, False])
def test_running_totals(events, keyed):
    data, df = events
    out = ordered.running_totals(df, {"before": "id"}, "at", "id", keys="k" if keyed else (), slices=12, totals=True)
    got = {r["id"]: (r["before"], r["before_total"]) for r in out.collect()}
    for s in _series(data, keyed):
        seen = 0
        for row in s:
            assert got[row[2]] == (seen, sum(x[2] for x in s))
            seen += row[2]


def test_a_hot_value_is_divided(events):
    _, df = events
    cuts = ordered.find_cuts(df, "at", "id", 12)
    sizes = [r["count"] for r in ordered.add_slice(df, "at", cuts, "id").groupBy("_slice").count().collect()]
    assert 500.0 in cuts.heavy and max(sizes) < 3000 / 4


def test_only_frequent_keys_are_sliced(events):
    _, df = events
    sliced = ordered.slice_for_keys(df, "at", "id", "k", slices=4)
    parts = {r["k"]: r["n"] for r in sliced.groupBy("k").agg(F.count_distinct("_slice").alias("n")).collect()}
    assert parts["hot"] > 1


def test_spread_left_join(spark):
    rng = random.Random(2)
    right = [("hot" if rng.random() < 0.5 else f"r{rng.randint(0, 30)}", i % 7) for i in range(600)] + [(None, 1)]
    left = [("hot", 0), ("hot", 1), ("absent", 2), (None, 3)] + [(f"r{i}", 10 + i) for i in range(40)]
    a = spark.createDataFrame(left, "lk string, l int")
    b = spark.createDataFrame(right, "rk string, r int")
    want = sorted(map(str, a.join(b, F.col("lk") == F.col("rk"), "left").collect()))
    for spread in (None, F.monotonically_increasing_id()):
        got = joins.left_join_spread(a, b, "lk", "rk", spread, salts=5)
        assert got.columns == ["lk", "l", "rk", "r"] and sorted(map(str, got.collect())) == want


def test_hot_keys_by_share_or_by_size(spark):
    data = [("hot",)] * 60 + [(f"k{i}",) for i in range(40)] + [("some",)] * 9 + [(None,)] * 200
    df = spark.createDataFrame(data, "k string").repartition(3)
    found = lambda share, limit: {r.k: r.n for r in joins.hot_keys(df, F.col("k"), share, limit).collect()}
    assert found(0.15, 1000) == {"hot": 60} and found(0.15, 8) == {"hot": 60, "some": 9} and found(0.15, 9) == {"hot": 60}
    assert joins.hot_keys(df.limit(0), F.col("k"), 0.2, 5).count() == 0


def test_a_key_of_a_thousandth_is_divided(spark):
    """No key's share matters beyond a number of rows: here 20 of 20,000 are too many for a task. Borders are estimated."""
    rows = [("warm", i, i % 3) for i in range(20)] + [(f"k{i % 4995}", 100 + i, i % 5) for i in range(19_980)]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(5)
    sliced = ordered.slice_for_keys(df, "at", "v", "k", limit=6)
    sizes = {r.k: (r.most, r.slices) for r in sliced.groupBy("k", "_slice").count().groupBy("k").agg(
        F.max("count").alias("most"), F.count("*").alias("slices")).collect()}
    assert sizes["warm"][0] <= 8 and sizes["warm"][1] >= 4 and all(s == (4, 1) for k, s in sizes.items() if k != "warm")
    left = spark.createDataFrame([("warm", 1), ("k7", 2), ("none", 3)], "lk string, l int")
    plain = sorted(map(str, left.join(df, F.col("lk") == F.col("k"), "left").collect()))
    spread = joins.left_join_spread(left, df, "lk", "k", limit=6)
    assert sorted(map(str, spread.collect())) == plain and len(plain) == 25
    hot = joins.hot_keys(df, F.col("k"), 1.0, 6).collect()
    assert [(r.k, r.n) for r in hot] == [("warm", 20)]


@pytest.mark.parametrize("per", [1, 10, 1000])
def test_dense_index(spark, per):
    df = spark.createDataFrame([(f"n{i}",) for i in range(500)], "name string")
    import hashlib
    want = {n: i for i, n in enumerate(sorted((f"n{i}" for i in range(500)), key=lambda n: hashlib.md5(n.encode()).hexdigest()))}
    assert {r["name"]: r["i"] for r in ordered.dense_index(df, "name", "i", rows_per_group=per).collect()} == want


def test_slices_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", 10)
    monkeypatch.setattr(ordered, "BORDERS", 16)
    for n in (1000, 4000):
        df = spark.range(n).withColumn("x", (F.col("id") * 7919) % 100_003)
        sliced = ordered.add_slice(df, "x", ordered.find_cuts(df, "x"))
        sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
        assert n / 10 * 0.7 <= len(sizes) <= n / 10 * 1.5 and max(sizes) <= 40


@pytest.mark.parametrize("slices", [1, 5, 40])
def test_order_by_text(spark, slices):
    names = [f"Customer#{i:05d}" for i in range(0, 900, 3)] + ["é", "Customer#", "", "日本"] + ["same"] * 5
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, id int").repartition(4)
    got = {r["id"]: r["before"] for r in ordered.lag_columns(df, {"before": ("id", 1)}, "name", "id", slices=slices).collect()}
    order = sorted(range(len(names)), key=lambda i: (names[i].encode(), i))
    assert got == {i: (order[k - 1] if k else None) for k, i in enumerate(order)}
    totals = {r["id"]: r["n"] for r in ordered.running_totals(df.selectExpr("*", "1 as one"), {"n": "one"}, "name", "id", slices=slices).collect()}
    assert totals == {i: k for k, i in enumerate(order)}


@pytest.mark.parametrize("rows", [20, 1000])
def test_totals_by_key_divide_only_large_keys(spark, monkeypatch, rows):
    monkeypatch.setattr(ordered, "ROWS_PER_SORT", rows)
    data = [(i, None if i % 9 == 0 else "hot" if i % 3 else f"k{i % 40}", (i * 37) % 11, i % 5) for i in range(300)]
    df = spark.createDataFrame(data, "id int, k string, at int, v int").repartition(5)
    out = ordered.running_totals(df, {"before": "v"}, "at", "id", keys="k", totals=True)
    place = {i: (k, at, v) for i, k, at, v in data}
    for r in out.collect():
        k, at, _ = place[r["id"]]
        mine = [(a, i, v) for i, (q, a, v) in place.items() if q == k]
        assert r["before"] == sum(v for a, i, v in mine if (a, i) < (at, r["id"])) and r["before_total"] == sum(v for _, _, v in mine)
    assert out.count() == 300 and out.columns == [*df.columns, "before", "before_total"]


def test_a_timeline_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    data = [(i % 4, i % 9, i % 5, i % 6, i % 6 + 2) for i in range(90)]
    df = spark.createDataFrame(data, "project int, milestone int, task int, low int, high int").mapInArrow(
        told, "project int, milestone int, task int, low int, high int")
    rows = projects.timeline_all(df, ["project"], "milestone", "task", "low", "high", "low", "high").collect()
    assert seen.value == 90
    spans = {}
    for p, m, t, low, high in data:
        for kind, item in (("milestone", m), ("task", t)):
            a, b = spans.get((p, kind, item), (low, high))
            spans[p, kind, item] = min(a, low), max(b, high)
    assert {(r["project"], r["type"], r["item"]): (r["start"], r["end"]) for r in rows} == spans
    for p in range(4):
        order = sorted((r for r in rows if r["project"] == p), key=lambda r: (r["start"], r["item"], r["type"]))
        assert [r["low"] for r in order] == [k + 0.6 for k in range(len(order))]


def test_dimension_fallback(spark):
    df = spark.createDataFrame([("a" * 12,), ("short",), ("p",)], "k string")
    dim = spark.createDataFrame([("p", "Pool")], "address string, poolname string")
    names = joins.dimension_name(df, "k", dim, "address", "poolname", "name", longest=10)
    assert {r["k"]: r["name"] for r in names.collect()} == {"a" * 12: "a" * 10, "short": "short", "p": "Pool"}


def test_differs(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    assert not joins.differs(a, a) and joins.differs(a, a.limit(1)) and joins.differs(a.limit(1), a)
