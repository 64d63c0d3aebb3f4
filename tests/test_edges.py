"""Hand-made frames for the edges of calendars, fills and groups."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from periodica.functions import periods, scalars
from periodica.operators import cards, comparison, filters, groups, models, resample, reshape


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def at(*parts):
    return datetime(*parts)


def test_empty_buckets_are_kept(spark):
    df = spark.createDataFrame(
        [(at(2024, 1, 1, 5), 2.0), (at(2024, 1, 4), 6.0), (at(2024, 1, 4, 9), None)], "ts timestamp_ntz, v double")
    out = resample.resample(df, "ts", "D", {"s": ("sum", "v"), "m": ("mean", "v"), "n": ("count", "v"), "u": ("nunique", "v")})
    assert rows(out, "ts") == [
        (date(2024, 1, 1), 2.0, 2.0, 1, 1), (date(2024, 1, 2), 0.0, None, 0, 0),
        (date(2024, 1, 3), 0.0, None, 0, 0), (date(2024, 1, 4), 6.0, 6.0, 1, 1)]


@pytest.mark.parametrize("period,day,label", [
    ("W", at(2024, 1, 7, 23), date(2024, 1, 7)), ("W", at(2024, 1, 8), date(2024, 1, 14)),
    ("M", at(2024, 2, 1), date(2024, 2, 29)), ("Q", at(2024, 4, 1), date(2024, 6, 30)),
    ("Y", at(2024, 5, 5), date(2024, 12, 31))])
def test_bucket_labels(spark, period, day, label):
    df = spark.createDataFrame([(day, 1)], "ts timestamp_ntz, v int")
    assert rows(resample.resample(df, "ts", period, {"n": ("count", "v")})) == [(label, 1)]


def test_gaps_over_months_and_quarters(spark):
    df = spark.createDataFrame([(at(2023, 11, 30),), (at(2024, 3, 31),)], "ts timestamp_ntz")
    months = rows(resample.resample(df, "ts", "M", {"n": ("count", "ts")}, label="b"))
    assert [m[0] for m in months] == [date(2023, 11, 30), date(2023, 12, 31), date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 31)]
    assert [m[1] for m in months] == [1, 0, 0, 0, 1]
    quarters = rows(resample.resample(df, "ts", "Q", {"n": ("count", "ts")}, label="b"))
    assert quarters == [(date(2023, 12, 31), 1), (date(2024, 3, 31), 1)]


def test_each_key_has_its_own_span(spark):
    df = spark.createDataFrame(
        [("a", at(2024, 1, 1)), ("a", at(2024, 1, 3)), ("b", at(2024, 1, 2)), (None, at(2024, 1, 2))], "k string, ts timestamp_ntz")
    out = resample.resample(df, "ts", "D", {"n": ("count", "ts")}, keys="k", label="day")
    assert rows(out, F.col("k").asc_nulls_last(), "day") == [
        ("a", date(2024, 1, 1), 1), ("a", date(2024, 1, 2), 0), ("a", date(2024, 1, 3), 1),
        ("b", date(2024, 1, 2), 1), (None, date(2024, 1, 2), 1)]


def test_resampled_sum_is_raw_sum(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    raw = orders.agg(F.sum("o_totalprice")).first()[0]
    for period in "DWMQ":
        out = resample.resample(orders, "o_orderdate", period, {"s": ("sum", "o_totalprice")}, keys="o_orderstatus")
        assert out.agg(F.sum("s")).first()[0] == raw


def test_shift_clamps_month_ends(spark):
    df = spark.createDataFrame([(at(2024, 3, 31, 7),)], "ts timestamp_ntz")
    got = df.select(*[periods.shift(F.col("ts"), p).alias(p) for p in periods.PERIODS]).first()
    assert tuple(got) == (at(2024, 3, 24, 7), at(2024, 2, 29, 7), at(2023, 12, 31, 7), at(2023, 3, 31, 7))
    assert periods.shift_moment(at(2024, 3, 31), "month") == at(2024, 2, 29)
    assert periods.shift_moment(at(2024, 1, 31), "quarter") == at(2023, 10, 31)
    assert periods.shift_moment(at(2024, 2, 29), "year") == at(2023, 2, 28)


def test_quarter_label_counts_a_part_day(spark):
    df = spark.createDataFrame([(at(2024, 1, 1),), (at(2024, 1, 1, 0, 0, 1),), (at(2024, 1, 2),)], "ts timestamp_ntz")
    assert [r[0] for r in df.orderBy("ts").select(periods.day_label(F.col("ts"), "quarter")).collect()] == [0, 1, 1]


def test_windows_stop_at_the_initial_date():
    found = periods.comparison_windows("month", date(2018, 6, 30), date(2018, 7, 5), 5, date(2018, 4, 25))
    assert [(w.label, w.start.date()) for w in found] == [
        ("0 month(s) prev(current)", date(2018, 6, 30)), ("1 month(s) prev", date(2018, 5, 30)), ("2 month(s) prev", date(2018, 4, 30))]


def test_history_window_of_one_row_is_dropped(spark):
    df = spark.createDataFrame(
        [(at(2024, 1, 22), 1), (at(2024, 1, 15), 5), (at(2024, 1, 8), 7), (at(2024, 1, 14, 23, 59), 8)], "ts timestamp_ntz, v int")
    span = ("week", date(2024, 1, 22), date(2024, 1, 28), 4)
    kept = comparison.period_over_period(df, "ts", *span)
    assert rows(kept.select("period", "dayset", "v")) == [
        ("0 week(s) prev(current)", 0, 1), ("2 week(s) prev", 0, 7), ("2 week(s) prev", 6, 8)]
    wide = comparison.period_columns(comparison.compare(df, "ts", *span, "v", "sum"), "week", 4, "v")
    assert wide.columns[1:] == sorted(comparison.period_labels("week", 4))
    assert rows(wide, "dayset") == [(0, 1, 0, 7, 0), (6, 0, 0, 8, 0)]


def test_span_guard(spark):
    df = spark.createDataFrame([(at(2024, 1, 22), 1)], "ts timestamp_ntz, v int")
    assert comparison.guarded_comparison(df, "ts", "week", date(2024, 1, 1), date(2024, 1, 9), 2, "v", "sum") is None
    assert comparison.too_long("year", date(2000, 1, 1), date(2024, 1, 1)) is False


def test_overlapping_windows_repeat_rows(spark):
    df = spark.createDataFrame([(at(2024, 1, 20), 1), (at(2024, 1, 21), 1)], "ts timestamp_ntz, v int")
    out = comparison.tag_periods(df, "ts", "week", date(2024, 1, 10), date(2024, 1, 30), 2)
    assert out.groupBy("period").count().count() == 2 and out.count() == 4


def test_cards_use_distinct_values(spark):
    df = spark.createDataFrame([(at(2024, 5, 15), 10.0), (at(2024, 5, 15), 10.0), (at(2024, 1, 2), 4.4)], "ts timestamp_ntz, v double")
    as_of = at(2024, 5, 15, 12)
    assert dict(cards.value_cards(df, "ts", as_of, "v", "sum").collect()) == {"week": 10, "month": 10, "quarter": 10, "year": 14}
    assert dict(cards.value_cards(df, "ts", as_of, "v", " mean").collect())["year"] == 7.2
    assert dict(cards.value_cards(df, "ts", as_of, "v", "count").collect())["year"] == 2
    assert dict(cards.value_cards(df, "ts", as_of, "v", "count", distinct=False).collect())["year"] == 3


def test_week_to_date_reaches_into_the_year_before(spark):
    df = spark.createDataFrame([(at(2024, 12, 30), 3.0), (at(2025, 1, 1), 4.0)], "ts timestamp_ntz, v double")
    assert dict(cards.value_cards(df, "ts", at(2025, 1, 1), "v", "sum").collect()) == {"week": 7, "month": 4, "quarter": 4, "year": 4}


def test_cost_of_nothing(spark):
    df = spark.createDataFrame([(at(2024, 5, 15), 0, 0), (at(2024, 5, 1), 3, 0)], "ts timestamp_ntz, fork int, push int")
    out = {r["period"]: r for r in cards.cost_cards(df, "ts", at(2024, 5, 15), "fork", ["push"]).collect()}
    assert out["week"]["payroll_per_unit"] is None and out["week"]["fork_per_push"] == "0"
    assert out["month"]["payroll_per_unit"] == round(48000 * 3 / 3, 2) and out["month"]["fork_per_push"] == "*"


def test_percent_change_of_zero_base(spark):
    df = spark.createDataFrame([(date(2024, 1, d), v) for d, v in ((1, 0), (2, 5), (3, None), (4, 10))], "d date, v int")
    assert [r["c"] for r in groups.change_in_percent(df, "d", "v", "c").orderBy("d").collect()] == [0.0, 0.0, 0.0, 100.0]


def test_filters(spark):
    df = spark.createDataFrame([(1, "male", "guest", float("nan")), (2, None, "x", float("-inf")), (None, "other", "member", 3.5)],
                               "k int, gender string, status string, v double")
    assert [r["v"] for r in filters.clean_numbers(df).collect()] == [0.0, 0.0, 3.5]
    assert [r["k"] for r in filters.clean_numbers(df).collect()] == [1, 2, 0]
    coded = filters.add_codes(df).collect()
    assert [(r["gender_coded"], r["status_coded"]) for r in coded] == [(1, 1), (None, None), (3, 2)]
    assert filters.by_selectors(df, {"gender": "all", "status": "all"}).count() == 3
    assert filters.drop_present(df, ["v", "absent"]).columns == ["k", "gender", "status"]
    listed = spark.createDataFrame([(1,), (1,)], "a int")
    assert rows(filters.label_by_list(df.select("k"), "k", listed, "a"), F.col("k").asc_nulls_last()) == [
        (1, 1, "churned"), (2, 0, "retained"), (None, 0, "retained")]


def test_list_texts(spark):
    from periodica.operators.miners import list_to_rows

    df = spark.createDataFrame([(1, "[a,b]"), (2, "[c]"), (3, None)], "k int, h string")
    assert rows(list_to_rows(df, "h")) == [(1, "a"), (1, "b"), (2, "c")]
    assert rows(list_to_rows(df, "h", keep=True)) == [(1, "[a,b]"), (1, "a"), (1, "b"), (2, "c")]
    dotted = spark.createDataFrame([("a.b",)], "h string")
    assert rows(list_to_rows(dotted, "h", sep=".")) == [("a",), ("b",)]


def test_hex_and_epoch(spark):
    df = spark.createDataFrame([("0x1f", 1704067200, 1704067200123), ("ff", 86399, 16307632001), (None, 0, 0)], "h string, s long, m long")
    got = df.select(scalars.hex_to_int(F.col("h")), scalars.epoch_to_date(F.col("s")), scalars.epoch_to_date(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [
        (31, date(2024, 1, 1), date(2024, 1, 1)), (255, date(1970, 1, 1), date(1970, 7, 8)), (0, date(1970, 1, 1), date(1970, 1, 1))]


def test_union_distinct_twice_is_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    once = reshape.union_distinct(df, df)
    assert once.count() == 2 and reshape.union_distinct(once, df).count() == 2


def test_wide_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], ["aa.x.gross-product", "aa.x.debt", "bb.debt"])
    out = reshape.wide_names_to_rows(df, "country")
    assert rows(out) == [("aa", 2.0, 1.0), ("bb", 3.0, 0.0)] and out.columns == ["country", "debt", "gross_product"]
    coins = spark.createDataFrame([(1.0, 2.0)], ["bitcoin_cash_watch", "aa_fork"])
    assert rows(reshape.prefixed_names_to_rows(coins, ["bitcoin_cash", "aa"], "crypto")) == [("aa", 2.0, None), ("bitcoin_cash", None, 1.0)]


def test_all_zero_feature_is_left_out(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0), (0.0, 5.0, 1)] * 20, "z double, x double, y int")
    assert models.usable_features(df, ["z", "x"]) == ["x"]


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "ts timestamp_ntz, v double, g string")
    assert resample.resample(df, "ts", "D", {"s": ("sum", "v")}).count() == 0
    assert groups.box_summary(df, "v", "g").count() == 0
    assert groups.histogram(df.where("v > 0").unionByName(spark.createDataFrame([(None, 1.0, "a")], df.schema)), ["v"], 5).count() == 1


def test_card_texts(spark):
    df = spark.createDataFrame([(1234567.891,)], "v double")
    got = df.select(*[cards.card_text(k, F.col("v")).alias(k) for k in ("money", "percent", "days", "project")]).first()
    assert tuple(got) == ("$1,234,567.89", "1234567.891%", "1234567.89 days", "1234567 projects")
