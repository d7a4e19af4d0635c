"""Quality rules, keys, ranks, quantiles, histograms and the dense index."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dwell.functions.nulls import fails_between
from dwell.operators import joins, ordering, quality, stats, windows
from dwell.operators.ranking import average_ranks, dense_index


def test_rule_status_and_severity(spark):
    df = spark.createDataFrame([(1,), (9,), (None,)], "floor int")
    out = {r["check"]: r for r in quality.evaluate(df, [
        quality.Rule("Domain", "floor 1-8", fails_between("floor", 1, 8)),
        quality.Rule("Domain", "floor soft", F.col("floor") > 5, severity="WARN"),
        quality.Rule("Domain", "never", F.lit(False)),
    ]).collect()}
    assert (out["floor 1-8"]["failures"], out["floor 1-8"]["status"]) == (2, "FAIL")
    assert out["floor soft"]["status"] == "WARN" and out["never"]["status"] == "PASS"


def test_duplicates_and_orphans_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (None, "b"), (None, "b")], "k int, v string")
    assert windows.duplicate_count(df, ["k"]).first()[0] == 3
    flags = windows.duplicate_flag(df, ["k"], ["v"]).filter("is_duplicate").count()
    assert flags == 3
    parent = spark.createDataFrame([(1,)], "k int")
    assert joins.orphans(df, parent, "k").count() == 2     # null keys are orphans
    assert joins.key_violations(df, ["k"]).first()["duplicate_rows"] == 3


def test_average_ranks_match_pandas(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0, None, 5.0, 1.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    ranks = {r["v"]: r["avg_rank"] for r in average_ranks(df, ["g"], "v", partitions=3).collect()}
    expected = pd.Series(values).rank(method="average")
    for v, r in zip(values, expected):
        if v is not None:
            assert ranks[v] == pytest.approx(r)


def test_spearman_of_many_null_patterns_and_chosen_pairs(spark, monkeypatch):
    import numpy as np
    import pandas as pd
    r = np.random.default_rng(5)
    pdf = pd.DataFrame({c: r.integers(0, 12, 300).astype(float) for c in "abcd"}).assign(e=r.normal(size=300), f=np.nan, g=7.0)
    for c in "acde":
        pdf.loc[r.random(300) < 0.3, c] = np.nan
    df = spark.createDataFrame(pdf)
    want = pdf.corr(method="spearman")
    for few in (0, 10, 1000):                       # shuffled and broadcast rank tables
        monkeypatch.setattr(stats, "FEW_VALUES", few)
        pairs = [("a", "b"), ("c", "e"), ("e", "a"), ("b", "f"), ("g", "b")]
        got = {(x["row"], x["col"]): x["corr"] for x in stats.spearman_pairs(df, list("abcdefg"), pairs).collect()}
        for a, b in pairs:
            assert got[a, b] is None or got[a, b] != got[a, b] if a in "fg" or b in "fg" else got[a, b] == pytest.approx(want.loc[a, b])


def test_spearman_matches_pandas_pairwise(spark):
    pdf = pd.DataFrame({"id": range(12), "a": [1, 2, 2, 3, 5, 4, 7, 7, 9, 8, 10, 11],
                        "b": [2.0, 1.0, None, 4.0, 3.0, 6.0, 5.0, None, 9.0, 7.0, 8.0, 12.0],
                        "c": [5, 5, 5, 1, 2, 3, 4, 4, 9, 9, 1, 0]})
    df = spark.createDataFrame(pdf)
    got = {(r["row"], r["col"]): r["corr"] for r in stats.spearman_matrix(df, ["a", "b", "c"]).collect()}
    exp = pdf[["a", "b", "c"]].corr(method="spearman")
    for a in "abc":
        for b in "abc":
            assert got[(a, b)] == pytest.approx(exp.loc[a, b], abs=1e-6)


def test_describe_matches_pandas(spark):
    vals = [0, 1, 1, 2, 3, 5, 8, 13, 21, 34]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    r = stats.describe(df, "x").first()
    d = pd.Series(vals, dtype=float).describe(percentiles=[0.25, 0.5, 0.75, 0.9, 0.95, 0.99])
    assert r["std"] == pytest.approx(d["std"], abs=1e-6) and r["p90"] == pytest.approx(d["90%"])
    skew = stats.adjusted_skewness(df, "x").first()[0]
    assert skew == pytest.approx(pd.Series(vals, dtype=float).skew(), abs=1e-6)


def test_histogram_last_edge_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double")
    h = {r["bin"]: r["count"] for r in stats.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 0, 2: 0, 3: 0, 4: 1}


def test_box_stats_single_row_group(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("b", 2.0), ("b", 100.0), ("b", 3.0)], "g string, y double")
    out = {r["g"]: r for r in stats.box_stats(df, "g", "y").collect()}
    assert out["a"]["q1"] == 5.0 and out["a"]["outliers"] == 0
    assert out["b"]["outliers"] == 1 and out["b"]["whisker_high"] == 3.0


def test_dense_index_and_top_k(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    idx = dense_index(df, ["k"], partitions=5)
    rows = idx.orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(1000)) and [r["k"] for r in rows] == list(range(1000))
    top = ordering.top_k(df, "k", 3, ["k"]).collect()
    assert [r["k"] for r in top] == [999, 998, 997]


def test_arg_min_tie_break(spark):
    df = spark.createDataFrame([("p", 3, "b"), ("p", 3, "a"), ("p", 4, "c"), ("q", 1, "z")], "g string, m int, id string")
    out = {r["g"]: r["id"] for r in windows.arg_min(df, ["g"], "m", ["id"]).collect()}
    assert out == {"p": "a", "q": "z"}


def test_null_group_keeps_its_median(spark):
    from dwell.operators.ranking import exact_quantiles
    df = spark.createDataFrame([(None, 5.0), (None, 9.0), (None, 7.0), ("a", 1.0)], "g string, v double")
    got = {r["g"]: r["quantile"] for r in exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {None: 7.0, "a": 1.0}


def test_arg_min_skips_null_metric(spark):
    from dwell.operators.windows import arg_min
    df = spark.createDataFrame([("p", 1, None), ("p", 2, 3.0)], "g string, id int, m double")
    assert [r["id"] for r in arg_min(df, ["g"], "m", ["id"]).collect()] == [2]


def test_small_and_constant_samples(spark):
    from dwell.ml.metrics import regression_metrics
    from dwell.operators.stats import adjusted_skewness, monthly_trend
    two = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert adjusted_skewness(two, "v").first()[0] is None
    flat = spark.createDataFrame([(2.0, 2.0, "exact"), (2.0, 2.0, "exact"), (2.0, 3.0, "off"), (2.0, 2.0, "off")],
                                 "actual double, prediction double, m string")
    assert {r["m"]: r["r2"] for r in regression_metrics(flat, ["m"]).collect()} == {"exact": 1.0, "off": 0.0}
    months = spark.createDataFrame([("2024-01-05", 1.0), (None, 2.0)], "d string, v double")
    assert monthly_trend(months, "d", "v").count() == 1


def test_spearman_of_few_values_does_not_move_the_rows(spark):
    import contextlib
    import io
    df = spark.createDataFrame([(float(i % 7), float(i % 5) if i % 3 else None, float(i % 11)) for i in range(200)], "a double, b double, c double")
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        stats.spearman_pairs(df, list("abc"), [("a", "b"), ("a", "c"), ("b", "c")]).explain()
    assert "hashpartitioning" not in plan.getvalue()


def test_spearman_spreads_rows_without_a_value(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW_VALUES", 0)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        import contextlib
        import io
        df = spark.createDataFrame([(float(i), float(-i) if i % 50 == 0 else None) for i in range(400)], "a double, b double")
        found = stats.spearman_pairs(df, ["a", "b"], [("a", "b")])
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            found.explain()
        assert "THEN salt" in plan.getvalue()                       # a key of the join, beside the value
        assert found.first()["corr"] == pytest.approx(-1.0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_many_quantiles_look_at_few_targets_each(spark):
    """255 quantiles of 30,000 values: as numpy has them, and no value goes through all 255."""
    import numpy as np
    from dwell.operators import ranking
    r = np.random.default_rng(2)
    values = {"a": np.round(r.normal(size=30_000), 4), "b": np.array([3.0]), "c": np.repeat([1.0, 5.0, 9.0], [500, 1, 20])}
    rows = [(g, float(v), int(n)) for g, x in values.items() for v, n in zip(*np.unique(x, return_counts=True))]
    counts = spark.createDataFrame(rows, "g string, v double, n long").coalesce(1)
    probs = [1.0, 0.0, *[i / 255 for i in range(1, 255)]]
    found = {(q["g"], q["p_index"]): q["quantile"] for q in ranking.quantiles_from_counts(counts, ["g"], "v", "n", probs).collect()}
    for g, x in values.items():
        assert [found[g, i] for i in range(len(probs))] == pytest.approx(np.quantile(x, probs).tolist())
    plan = ranking.quantiles_from_counts(counts, ["g"], "v", "n", probs)._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in plan
