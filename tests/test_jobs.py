"""Models, forecasts, stores and streams on small made-up inputs."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.operators import clusters, forecast, forest, models, svm
from periodica.plans import modeling
from periodica.session import file_state, materialise, shared_folder
from periodica.sources.artifacts import ArtifactStore
from periodica.sources.scan import scan_days, scan_moments
from periodica.sources.tables import DayTables, RangeDatasets, load_missing, missing_ranges, schema_of
from periodica.streaming import feeds


@pytest.fixture(scope="module")
def separable(spark):
    rng = random.Random(4)
    data = [(i, float(y * 10 + rng.random()), 0.0 if i % 9 == 0 else float(5 - y), y) for i in range(300) for y in [i % 2]]
    return spark.createDataFrame(data, "id int, x double, w double, churned int")


def test_forest_separates(spark, separable):
    train, test = models.split_rows(separable, ["id"], "churned")
    assert train.count() + test.count() == 300 and 150 < train.count() < 260
    model = forest.fit(train, ["id"], ["x", "w"], "churned", trees=8)
    scored = forest.score(test, model)
    assert models.accuracy_table(scored, "churned", "churned").first()["accuracy"] == 100.0
    assert {(r["label"], r["prediction"]) for r in models.confusion(scored, "churned").collect()} == {(0, 0), (1, 1)}
    ranks = models.importance_table(spark, model, "churned").orderBy("rank_within_outcome").collect()
    assert [r["rank_within_outcome"] for r in ranks] == [1, 2] and ranks[0]["importance"] >= ranks[1]["importance"]
    rules = forest.rules(spark, model, 3)
    assert rules.where("kind = 'predict'").count() >= 2 and rules.where("kind = 'if'").count() == rules.where("kind = 'else'").count()
    labelled, share = models.score_entities(model, separable, "id")
    assert share.first()[0] == 50.0 and labelled.where("likely_action = 'churn'").count() == 150


def brute_forest_counts(rows, model, x):
    """The bag's rows at each node, by walking every row down every tree."""
    held = {}
    roots = {t: p for p, (t, n) in enumerate(zip(model.tree, model.node)) if n == 1}
    for draw, cells, y in zip(rows, x[:, :-1], x[:, -1].astype(int)):
        for t, p in roots.items():
            w = int(forest.bag_weights(np.array([draw]), forest.tree_factors(t + 1)[t])[0])
            while w:
                held.setdefault(p, [0, 0])[y] += w
                if model.feature[p] < 0:
                    break
                p = model.left[p] if cells[model.feature[p]] <= model.threshold[p] else model.right[p]
    return held


def test_forest_nodes_hold_their_rows(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=200).round(2), rng.integers(0, 4, 200), rng.random(200)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 2) ^ (rng.random(200) < 0.1)).astype(int)
    frame = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "id int, a double, b double, c double, y int")
    for impute in (False, True):
        model = forest.fit(frame, ["id"], ["a", "b", "c"], "y", trees=6, depth=5, impute=impute)
        draws = [r[0] for r in frame.select("id", forest.key_draw(["id"])).orderBy("id").select("_draw").collect()]
        filled = x.copy()
        if impute:
            for j in range(3):
                filled[filled[:, j] == 0, j] = np.median(x[x[:, j] != 0, j])
        counts = brute_forest_counts(draws, model, np.column_stack([filled, y]))
        assert {p: list(c) for p, c in enumerate(model.counts)} == counts
        assert len(model.tree) > 30 and abs(sum(forest.importances(model)) - 1) < 1e-12
        for p, f in enumerate(model.feature):
            if f >= 0:
                low, high = model.counts[model.left[p]], model.counts[model.right[p]]
                assert [a + b for a, b in zip(low, high)] == model.counts[p] and sum(low) and sum(high) and model.gain[p] > 0
        both = forest.score_columns(forest.score(frame, model).withColumnsRenamed({"votes": "v", "prediction": "p"}), model)
        assert both.where("v <> votes or p <> prediction").count() == 0 and both.count() == 200
    pure = forest.fit(frame.where("y = 1"), ["id"], ["a"], "y", trees=2)
    assert pure.feature == [-1, -1] and forest.score(frame, pure).where("prediction <> 1").count() == 0
    assert forest.fit(frame.limit(0), ["id"], ["a"], "y", trees=2, impute=False).tree == []


def test_deep_forests_leave_their_nodes_in_the_tasks(spark, monkeypatch):
    """The nodes that follow the rows in number do not reach the driver, and are those of scans level by level."""
    rng = random.Random(8)
    data = [(i, float(rng.randint(0, 60)), rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0]), rng.choice([0, 1, None] if i % 40 == 0 else [0, 1])) for i in range(400)]
    frame = spark.createDataFrame(data, "id int, a double, b double, c double, y int").repartition(3)

    def grown():
        model = forest.fit(frame, ["id"], ["a", "b", "c"], "y", trees=4, depth=30)
        nodes = sorted(forest.nodes_table(spark, model).collect(), key=lambda r: (r["tree"], r["node"]))
        votes = forest.score(frame, model).orderBy("id").collect()
        return model, nodes, votes, forest.rules(spark, model, 2).collect(), pytest.approx(forest.importances(model))

    deep = grown()
    assert len(deep[0].tree) == 4 and len(deep[1]) > 400
    monkeypatch.setattr(forest, "TAIL", 90)
    halfway = grown()
    assert 4 < len(halfway[0].tree) < 200
    monkeypatch.setattr(forest, "HELD", 1 << 40)
    held = grown()
    assert len(held[0].tree) == len(held[1]) and held[0].deep is None
    assert deep[1:] == halfway[1:4] + (forest.importances(halfway[0]),) and deep[1:] == held[1:4] + (forest.importances(held[0]),)


def test_a_changed_file_has_another_state(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    before = file_state(spark, f"{tmp_path}/t")
    assert before == file_state(spark, f"{tmp_path}/t")
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert before != file_state(spark, f"{tmp_path}/t")


def test_no_class_is_missing_in_training(spark):
    df = spark.createDataFrame([(i, int(i == 17)) for i in range(50)], "id int, churned int")
    train, test = models.split_rows(df, ["id"], "churned", share=0.01)
    assert {r["churned"] for r in train.collect()} == {0, 1} and train.count() + test.count() == 50
    assert train.join(test, "id").count() == 0


@pytest.mark.parametrize("parts", [4, 64])
def test_the_layout_does_not_change_a_model(spark, separable, parts):
    noisy = separable.withColumn("churned", F.when(F.col("id") % 7 == 0, 1 - F.col("churned")).otherwise(F.col("churned")))
    found = []
    for df in (noisy.coalesce(1), noisy.repartition(parts, "x")):
        model = forest.fit(df, ["id"], ["x", "w"], "churned", trees=5)
        gaps = clusters.gap_statistic(clusters.standardised(df, ["x", "w"]), "id", 2, most=5)
        found.append((model, gaps))
    assert found[0] == found[1]


def test_the_rows_of_the_miners_are_built_once(spark, monkeypatch):
    """Both parts, and all rounds over them, read rows that are written already."""
    lines = [(o, n, o % 5, n, 1.0, 10.0 * o + n, datetime(1999 + o % 3, 1, 1)) for o in range(40) for n in range(3)]
    kinds = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    orders = spark.createDataFrame([(o, o % 7, 5.0 * o) for o in range(40)], "o_orderkey long, o_custkey long, o_totalprice double")
    held = {"lineitem": spark.createDataFrame(lines, kinds), "orders": orders}
    monkeypatch.setattr(modeling.t, "table", lambda spark, sf, name: held[name])
    seen = []
    monkeypatch.setattr(modeling.models, "split_rows", lambda df, keys, label: seen.append(df) or (df, df))
    modeling._miner_split(spark, "none")
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString() and seen[0].count() == 5


def test_the_rows_of_the_accounts_are_built_once(spark, monkeypatch):
    rows = [(i, i % 6, datetime(2024, 1, 1 + i % 20), float(i), "x", '{"k": 3}') for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double, event_type string, props string")
    monkeypatch.setattr(modeling.t, "table", lambda spark, sf, name: events)
    built = modeling._account_rows(spark, "none")
    assert "Join" not in built._jdf.queryExecution().optimizedPlan().toString() and built.count() == 6


def test_svm_report(spark, separable):
    train, test = models.split_rows(separable, ["id"], "churned")
    model = svm.fit(train, ["x", "w"], "churned")
    report = models.class_report(svm.score(test, model), "churned").collect()
    assert {r["class"] for r in report} == {0, 1} and all(r["precision"] == r["recall"] == r["f1"] == 1.0 for r in report)


def test_svm_is_the_best_plane(spark):
    """The gap bounds the distance to the best cost, and no small step in any direction lowers the cost further."""
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=150), 1e5 * rng.normal(size=150), np.full(150, 3.0)])
    y = np.where(x[:, 0] + x[:, 1] / 1e5 + rng.normal(size=150) > 0, 1, 0)
    frame = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, flat double, y int")
    model = svm.fit(frame.repartition(5), ["a", "b", "flat"], "y", cost=0.7)
    z = np.column_stack([(x[:, :2] - x[:, :2].mean(axis=0)) / x[:, :2].std(axis=0, ddof=1), np.zeros(150), np.ones(150)])
    cost = lambda w: 0.5 * w @ w + 0.7 * (np.maximum(0, 1 - (2 * y - 1) * (z @ w)) ** 2).sum()
    w = np.array(model.weights)
    assert model.primal == pytest.approx(cost(w)) and -1e-9 < model.gap <= 1e-6 * max(1, model.primal)
    for step in np.vstack([np.eye(4), -np.eye(4), rng.normal(size=(20, 4))]) * 1e-3:
        assert cost(w + step) > model.primal - model.gap - 1e-9
    assert np.allclose(model.weights, svm.fit(frame.coalesce(1), ["a", "b", "flat"], "y", cost=0.7).weights, atol=1e-8)
    told = [r.prediction for r in svm.score(frame, model).collect()]
    assert np.mean(np.array(told) == y) > 0.7


def test_gap_finds_separate_groups(spark):
    rng = random.Random(8)
    data = [(i, 100.0 * (i % 3) + rng.random(), 50.0 * (i % 3 == 1) + rng.random()) for i in range(90)]
    df = spark.createDataFrame(data, "id int, a double, b double")
    scaled = clusters.standardised(df, ["a", "b"])
    kept = {}
    gaps = clusters.gap_statistic(scaled, "id", 2, most=4, references=2, kept=kept)
    assert [k for k, _ in gaps] == [1, 2, 3, 4] and dict(gaps)[3] > dict(gaps)[2] > dict(gaps)[1]
    named = clusters.name_clusters(clusters.assign_clusters(scaled, "id", 3, kept[3]), "id", 4, "own")
    own = {r["id"] for r in named.where("cluster = 'own'").collect()}
    assert own == {i for i in range(90) if i % 3 == 1}


def test_rounds_are_those_of_lloyd(spark):
    """Centres that rest are the means of their points, and no cost is above that of a plain k-means with many starts."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.6, (70, 2)) for c in ((0, 0), (4, 0), (0, 5), (5, 5), (9, 1))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    fits = clusters.fit_all(frame, "id", 2, [1, 2, 5, 7])
    for (_, k), (centres, cost) in fits.items():
        at, square = clusters.nearest(x, np.array(centres))
        assert cost == pytest.approx(square.sum(), rel=1e-5)
        assert np.allclose(centres, [x[at == n].mean(axis=0) for n in range(k)], atol=0.03)
        got = {r.id: r.prediction for r in clusters.assign_clusters(frame, "id", k, centres).collect()}
        assert got == dict(enumerate(at.tolist()))
        best = np.inf
        for _ in range(30):
            c = x[rng.choice(len(x), k, False)]
            for _ in range(50):
                near = clusters.nearest(x, c)[0]
                c = np.array([x[near == n].mean(axis=0) if (near == n).any() else c[n] for n in range(k)])
            best = min(best, clusters.nearest(x, c)[1].sum())
        assert cost <= best * 1.1
    assert clusters.fit_all(frame.limit(0), "id", 2, [2]) == {}
    same = clusters.fit_all(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id int, features array<double>"), "id", 2, [3])
    assert same[0, 3][1] == 0.0


def test_forecast_recovers_trend_and_week():
    days = np.arange(19700, 19700 + 140)
    y = 3.0 + 0.5 * (days - days[0]) + np.where(days % 7 == 0, 14.0, 0.0)
    out = forecast.fit_and_extend(days, y, 14)
    ahead = np.arange(days[-1] + 1, days[-1] + 15)
    want = 3.0 + 0.5 * (ahead - days[0]) + np.where(ahead % 7 == 0, 14.0, 0.0)
    assert np.max(np.abs(out["yhat"][-14:] - want)) < 1.0
    assert np.allclose(out["trend"] + out["weekly"], out["yhat"])
    assert np.all(out["yhat_lower"] <= out["yhat"]) and np.all(out["yhat"] <= out["yhat_upper"])


def test_forecast_by_key(spark):
    start = datetime(2024, 1, 1)
    data = [(k, start + timedelta(days=d), 1.0 + d * s) for k, s in (("a", 1.0), ("b", -1.0)) for d in range(30)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, v double")
    out = forecast.forecast(df, "ts", "v", "sum", 5, keys="k")
    assert {r["k"]: r["n"] for r in out.groupBy("k").agg(F.count("*").alias("n")).collect()} == {"a": 35, "b": 35}
    last = {r["k"]: r["yhat"] for r in out.where(F.col("ds") == date(2024, 2, 4)).collect()}
    assert last["a"] == pytest.approx(35.0, abs=0.5) and last["b"] == pytest.approx(-33.0, abs=0.5)


def test_scan_filters_reach_the_file(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    plan = scan_days(events, "2024-01-02", "2024-01-03", "ts", cols=["ts", "value"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-02T00:00)" in plan and "LessThan(ts,2024-01-04T00:00)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan
    assert scan_moments(events, "2024-02-01", "2024-01-02", "ts").count() == 0
    assert scan_days(events, "2024-02-01", "2024-01-02", "ts").count() == scan_days(events, "2024-01-02", "2024-01-02", "ts").count() > 0


TYPES = {"k": "UInt64", "block_timestamp": "Datetime", "v": "Float64"}


@pytest.fixture()
def store(spark):
    tables = DayTables(spark, f"periodica_test_{random.randrange(10**9)}")
    tables.create("t", TYPES)
    yield tables
    tables.drop("t")
    tables.drop_database()


def _days(spark, days, v=1.0, first=0):
    return spark.createDataFrame(
        [(first + i, datetime(2024, 1, d, 8) if d else None, v) for i, d in enumerate(days)], schema_of(TYPES))


def test_upsert_replaces_the_span(spark, store):
    store.append(_days(spark, [1, 2, 3, 4, 5, None]), "t")
    store.upsert(_days(spark, [2, 4], 9.0), "t")
    got = [(r["block_timestamp"].day if r["block_timestamp"] else None, r["v"]) for r in store.read("t").collect()]
    assert sorted(got, key=str) == sorted([(1, 1.0), (2, 9.0), (4, 9.0), (5, 1.0), (None, 1.0)], key=str)
    store.upsert(_days(spark, [2, 4], 9.0), "t")
    assert store.read("t").count() == 5


def test_deletes(spark, store):
    store.append(_days(spark, [1, 2, 2, 3, None]), "t")
    store.delete_days("t", date(2024, 1, 2), date(2024, 1, 2))
    assert store.read("t").count() == 3
    store.delete_range("t", "k", 3, 3)
    assert sorted(r["k"] for r in store.read("t").collect()) == [0, 4]
    store.delete_range("t", "k", 100, 200)
    assert store.read("t").count() == 2


def test_range_datasets(spark):
    data = RangeDatasets(spark, shared_folder(spark, "ranges"))
    now = datetime(2024, 2, 1)
    df = _days(spark, [1, 2, 3, 4, None])
    assert data.save(df, "a:b", date(2024, 1, 1), date(2024, 1, 4), now, "block_timestamp")
    assert not data.save(df, "a:b", date(2024, 1, 1), date(2024, 1, 4), now, "block_timestamp")
    assert data.load("a:b", date(2024, 1, 2), date(2024, 1, 3), now, "block_timestamp").count() == 2
    assert data.load("a:b", date(2024, 1, 2), date(2024, 1, 3), now, "block_timestamp", whole=True).count() == 4
    assert data.load("a:b", date(2024, 1, 2), date(2024, 1, 9), now, "block_timestamp") is None
    assert data.load("other", date(2024, 1, 2), date(2024, 1, 3), now, "block_timestamp") is None


def test_range_dataset_keys_are_exact(spark):
    data, now, span = RangeDatasets(spark, shared_folder(spark, "ranges")), datetime(2024, 2, 1), (date(2024, 1, 1), date(2024, 1, 4))
    for key, first in (("a_b", 10), ("a:b", 20), ("a%b", 30)):
        assert data.save(_days(spark, [2], first=first), key, *span, now, "block_timestamp")
    for key, first in (("a_b", 10), ("a:b", 20), ("a%b", 30)):
        assert [r["k"] for r in data.load(key, *span, now, "block_timestamp").collect()] == [first]
    assert data.load("a%", *span, now, "block_timestamp") is None


def test_upsert_keeps_rows_without_a_time(spark, store):
    store.append(_days(spark, [None, 2, 3]), "t")
    store.upsert(_days(spark, [None, 2], 9.0, first=8), "t")
    assert sorted(r["k"] for r in store.read("t").collect()) == [0, 2, 8, 9]
    store.upsert(_days(spark, [None], 9.0, first=20), "t")
    assert store.read("t").count() == 5


def test_a_partly_held_day_is_completed(spark):
    hours = [(i, datetime(2024, 1, 3 + i // 24, i % 24), 1.0) for i in range(72)]
    source = spark.createDataFrame(hours, schema_of(TYPES))
    held = source.where("k between 6 and 11 or k = 40")
    got = load_missing(held, source, "block_timestamp", date(2024, 1, 3), date(2024, 1, 4))
    assert sorted(r["k"] for r in got.collect()) == list(range(48))


def test_missing_days(spark):
    held = _days(spark, [3, 4, 7])
    runs = missing_ranges(held, "block_timestamp", date(2024, 1, 2), date(2024, 1, 8))
    assert runs == [(date(2024, 1, 2), date(2024, 1, 2)), (date(2024, 1, 5), date(2024, 1, 6)), (date(2024, 1, 8), date(2024, 1, 8))]
    source = _days(spark, range(1, 11), first=50)
    held = source.where("day(block_timestamp) in (3, 4, 7)")
    got = load_missing(held, source, "block_timestamp", date(2024, 1, 2), date(2024, 1, 8))
    assert sorted(r["block_timestamp"].day for r in got.collect()) == [2, 3, 4, 5, 6, 7, 8]


def test_artifacts_expire(spark):
    store = ArtifactStore(spark, shared_folder(spark, "artifacts"))
    assert store.all().count() == 0 and store.hull(datetime(2024, 1, 1)) is None
    one = spark.createDataFrame([("i", "old")], "item string, payload string")
    store.save(one, "k", date(2024, 1, 1), date(2024, 1, 5), datetime(2024, 1, 1))
    store.save(one.withColumn("payload", F.lit("new")), "k", date(2024, 1, 1), date(2024, 1, 5), datetime(2024, 1, 2))
    assert store.latest(datetime(2024, 1, 3), "k").first()["payload"] == "new"
    assert store.latest(datetime(2024, 1, 6), "k").count() == 0
    store.save(one.limit(0), "empty", None, None, datetime(2024, 1, 2))
    store.save(one, "empty", None, None, datetime(2024, 1, 1))
    assert store.latest(datetime(2024, 1, 3), "empty").count() == 0
    assert store.hull(datetime(2024, 1, 3), "k") == (date(2024, 1, 1), date(2024, 1, 5))


def test_last_row_sink_is_repeatable(spark):
    sink = feeds.LastRowSink(spark, shared_folder(spark, "sink"), ["k"], ["at"])
    assert sink.read() is None
    first = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k int, at int, v string")
    second = spark.createDataFrame([(1, 6, "late"), (2, 1, "tie"), (3, 1, None)], "k int, at int, v string")
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        sink.write_batch(batch, number, "one")
    want = [(1, 7, "b"), (2, 1, "tie"), (3, 1, None)]
    assert sorted(tuple(r) for r in sink.read().collect()) == want
    merged = sink.compact(shared_folder(spark, "merged"))
    assert sorted(tuple(r) for r in merged.read().collect()) == want
    merged.write_batch(spark.createDataFrame([(3, 2, "z")], "k int, at int, v string"), 0, "two")
    assert sorted(tuple(r) for r in merged.read().collect()) == [*want[:2], (3, 2, "z")]


def test_deleted_keys_stay_away(spark):
    lines = [
        '{"op": "c", "ts_ms": 1, "before": null, "after": {"k": 1, "v": "a"}}', '{"op": "c", "ts_ms": 1, "after": {"k": 2, "v": "b"}}',
        '{"op": "d", "ts_ms": 3, "before": {"k": 1, "v": "a"}, "after": null}', '{"op": "d", "ts_ms": 4, "before": {"k": 3, "v": null}}',
        "no json", "", '{"op": "d", "ts_ms": 9}', None]
    events = feeds.change_events(spark.createDataFrame([(x,) for x in lines], "value string"), "k int, v string")
    assert sorted(tuple(r) for r in events.collect()) == [(1, "a", False, 1), (1, "a", True, 3), (2, "b", False, 1), (3, None, True, 4)]
    sink = feeds.LastRowSink(spark, shared_folder(spark, "gone"), ["k"], ["changed_at"], "deleted")
    sink.write_batch(events, 0, "one")
    assert [tuple(r) for r in sink.read().collect()] == [(2, "b", 1)]
    merged = sink.compact(shared_folder(spark, "gone"))
    late = spark.createDataFrame([(1, "late", False, 2), (3, "again", False, 5)], events.schema)
    merged.write_batch(late, 0, "two")
    assert sorted(tuple(r) for r in merged.read().collect()) == [(2, "b", 1), (3, "again", 5)]


def test_materialise(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert sorted(r["x"] for r in materialise(df, "m").collect()) == list(range(0, 20, 2))
