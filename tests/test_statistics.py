"""Association tests against plain formulas, tails against known values."""

import itertools
import math
import random

import pytest

from periodica.functions import tails
from periodica.operators import association, ordered, ranks


def test_tails_known_values():
    assert tails.student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.student_two_sided(12.70620474, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.student_two_sided(0.0, 5) == pytest.approx(1.0)
    assert tails.student_two_sided(math.inf, 5) == 0.0
    assert tails.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_upper(36.4150285, 24) == pytest.approx(0.05, abs=1e-8)
    assert tails.chi2_upper(0.5, 4) == pytest.approx(math.exp(-0.25) * 1.25, abs=1e-12)
    assert tails.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)


def _least_squares(a, b):
    n, ma, mb = len(a), sum(a) / len(a), sum(b) / len(b)
    sxy = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    sxx, syy = sum((x - ma) ** 2 for x in a), sum((y - mb) ** 2 for y in b)
    return sxy / sxx, mb - sxy / sxx * ma, sxy / math.sqrt(sxx * syy), n


def test_linear_relationships(spark):
    rng = random.Random(3)
    data = [(x, 2 * x + rng.gauss(0, 1), -x + rng.gauss(0, 12), rng.gauss(0, 1)) for x in (rng.uniform(0, 20) for _ in range(300))]
    df = spark.createDataFrame(data, ["a", "strong", "weak", "noise"])
    got = {r["variable_2"]: r for r in association.linear_relationships(df, "a", ["a", "strong", "weak", "noise"]).collect()}
    for i, name in enumerate(["strong", "weak", "noise"], start=1):
        slope, intercept, r, n = _least_squares([d[0] for d in data], [d[i] for d in data])
        assert got[name]["slope"] == pytest.approx(slope) and got[name]["intercept"] == pytest.approx(intercept)
        assert got[name]["r"] == pytest.approx(r) and got[name]["n"] == n
        t = r * math.sqrt((n - 2) / (1 - r * r))
        assert got[name]["p_value"] == pytest.approx(tails.student_two_sided(t, n - 2), abs=1e-12)
    assert got["strong"]["relationship"] == "strong positive"
    assert got["weak"]["relationship"].endswith("negative")


def test_constant_feature_is_not_significant(spark):
    df = spark.createDataFrame([(float(i), 1.0, 2.0 * i) for i in range(10)], ["a", "flat", "line"])
    got = {r["variable_2"]: r["relationship"] for r in association.linear_relationships(df, "a", ["flat", "line"]).collect()}
    assert got == {"flat": "Not significant", "line": "strong positive"}


@pytest.mark.parametrize("slices", ["2", "5", "64"])
def test_mann_whitney_counts_pairs(spark, slices):
    rng = random.Random(7)
    data = [(float(rng.randint(0, 9)), float(rng.randint(2, 14)), 5.0 if rng.random() < 0.5 else rng.random()) for _ in range(120)]
    df = spark.createDataFrame(data, ["a", "b", "c"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        got = {r["variable_2"]: r for r in association.mann_whitney(df, "a", ["b", "c"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, name in ((1, "b"), (2, "c")):
        u = sum((x[0] > y[i]) + 0.5 * (x[0] == y[i]) for x in data for y in data)
        assert got[name]["stat"] == u
    assert got["b"]["relationship"] == "No" and got["b"]["different"] and got["b"]["p_value"] < 1e-6


def test_mann_whitney_same_sample(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(20)], ["a", "b"])
    row = association.mann_whitney(df, "a", ["b"]).first()
    assert row["stat"] == 200 and row["p_value"] == 1.0 and row["relationship"] == "Yes"


def _ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


def test_kruskal(spark):
    rng = random.Random(11)
    data = [(float(rng.randint(0, 6)) + (g == "c") * 2, g, "only", rng.choice("xy"), rng.randint(1, 30))
            for g in "abc" for _ in range(25)]
    df = spark.createDataFrame(data, ["v", "g", "one", "h", "who"])
    got = {(r["variable_1"], r["variable_2"]): r for r in association.kruskal(df, ["v", "who"], ["g", "one", "h"], counted=["who"]).collect()}
    values = [d[0] for d in data]
    ranks, n = _ranks(values), len(values)
    ties = sum(values.count(v) ** 3 - values.count(v) for v in set(values))
    for i, name in ((1, "g"), (3, "h")):
        q = sum(sum(r for r, d in zip(ranks, data) if d[i] == g) ** 2 / sum(d[i] == g for d in data) for g in {d[i] for d in data})
        h = (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n))
        assert got["v", name]["stat"] == pytest.approx(h)
        assert got["v", name]["p_value"] == pytest.approx(tails.chi2_upper(h, len({d[i] for d in data}) - 1))
    assert got["v", "g"]["relationship"] == "Yes" and got["v", "one"]["relationship"] == "na" and got["v", "one"]["stat"] is None
    counts = {g: len({d[4] for d in data if d[1] == g}) for g in "abc"}
    if len(set(counts.values())) == 3:
        assert got["who", "g"]["stat"] == pytest.approx(2.0)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_rank_sums_of_cut_values(spark, parts):
    """A value that holds most rows is cut between partitions, and outcomes end inside of them."""
    rng = random.Random(parts)
    cells = [(o, rng.choice([7.0, 7.0, 7.0, 3.0, float("inf"), -0.0, 0.0, rng.random() * 9]), rng.choice([1, 2, 50]), rng.choice("abcdefghij"),
              rng.choice([None, "x", "y"])) for o in ("p", "q", "r") for _ in range(300)]
    cells += [("p", None, 4, "a", "x"), ("p", float("nan"), 4, "a", "x"), ("s", 1.0, 3, None, None)]
    frame = spark.createDataFrame(cells, "o string, v double, c long, g string, h string").repartition(4)
    got = {(r.outcome, r.test, r.level): r for r in ranks.rank_sums(frame, "o", "v", "c", ["g", "h"], parts=parts).collect()}
    want = {}
    for o in "pqr":
        for k, test in ((3, "g"), (4, "h")):
            known = [c for c in cells if c[0] == o and c[1] is not None and not math.isnan(c[1]) and c[k]]
            count = {}
            for c in known:
                count[c[1] + 0.0] = count.get(c[1] + 0.0, 0) + c[2]
            total, before, rank = sum(count.values()), 0, {}
            for v in sorted(count):
                rank[v] = before + (count[v] + 1) / 2
                before += count[v]
            for level in {c[k] for c in known}:
                n = sum(c[2] for c in known if c[k] == level)
                r = sum(c[2] * rank[c[1] + 0.0] for c in known if c[k] == level)
                want[o, test, level] = (n, r - n * (total + 1) / 2, total, sum(x ** 3 - x for x in count.values()))
    assert {k: (r.n, r.centred, r.total, r.ties) for k, r in got.items()} == want
    assert ranks.rank_sums(frame.limit(0), "o", "v", "c", ["g"]).count() == 0


def test_exact_u_against_all_mixtures():
    for n in range(1, 8):
        for m in range(1, 8):
            all_u = [sum(places) - n * (n - 1) // 2 for places in itertools.combinations(range(n + m), n)]
            assert tails.u_counts(n, m) == [all_u.count(u) for u in range(n * m + 1)]
            for u in range(n * m + 1):
                far = sum(x >= max(u, n * m - u) for x in all_u)
                assert tails.u_exact(u, n, m) == pytest.approx(min(1.0, 2 * far / len(all_u)))


def test_small_samples_name_their_method(spark):
    rows = [(float(i), 3.5 + 2 * i if i < 6 else None, 2.0) for i in range(30)]
    got = {r.variable_2: r for r in association.mann_whitney(spark.createDataFrame(rows, "a double, b double, c double"), "a", ["b", "c"]).collect()}
    assert got["b"].method == "exact" and got["c"].method == "normal"
    u = sum(a > b for a, _, _ in rows for _, b, _ in rows if b is not None)
    assert got["b"].stat == u and got["b"].p_value == pytest.approx(tails.u_exact(u, 30, 6))


def test_mutual_information_of_a_copy(spark):
    df = spark.createDataFrame([(float(i % 10), float(i % 10), 1.0) for i in range(1000)], ["a", "same", "flat"])
    got = {r["variable_2"]: r for r in association.mutual_information(df, "a", ["same", "flat"]).collect()}
    assert got["same"]["stat"] == pytest.approx(math.log(10)) and got["same"]["relationship"] == "strong"
    assert got["flat"]["stat"] == pytest.approx(0.0) and got["flat"]["relationship"] == "None"


def test_matching_columns():
    assert association.matching_columns(["coin_watch", "coin_fork", "day"], ["watch"]) == ["coin_watch"]


def test_exact_quantiles(spark):
    rng = random.Random(5)
    data = [("a" if i % 3 else "b", float(rng.choice([7, rng.randint(0, 50)]))) for i in range(401)]
    df = spark.createDataFrame(data, ["g", "v"])
    got = {r["g"]: r for r in ordered.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], keys="g", slices=6).collect()}
    for g in "ab":
        values = sorted(v for k, v in data if k == g)
        for i, p in enumerate([0.0, 0.25, 0.5, 0.9, 1.0]):
            at = p * (len(values) - 1)
            lo = int(at)
            hi = min(lo + 1, len(values) - 1)
            assert got[g][f"q{i}"] == pytest.approx(values[lo] + (values[hi] - values[lo]) * (at - lo))
