"""Models on the reference's fixture frames (FIXTURES.md §2.4–2.8)."""

import datetime as dt
import math
import tempfile

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from dwell.ml import encode, forward, metrics as M, models as ML, runs
from dwell.operators import splits
from dwell.plans import features as feat
from dwell.sources import io

SMALL_FOREST = {"n_estimators": 10, "max_depth": 4, "min_samples_leaf": 5, "max_features": 0.8, "random_state": 42}


def ttl_frame(spark):
    rows = []
    for i in range(90):
        size = 22 + i % 12
        asking = 8000 + 180 * size + 250 * (i % 4)
        market = 10000 + 100 * (i % 5)
        split = "train" if i < 60 else "validation" if i < 75 else "test"
        weeks = max(0.0, 12 + (asking / market - 1) * 10 - 0.45 * (i % 10) + (2 if i % 3 == 0 else 0))
        rows.append((f"L-{i:03d}", f"U-{i:03d}", i % 3, (dt.date(2025, 1, 1) + dt.timedelta(days=7 * i)).isoformat(),
                     split, i % 12 + 1, float(size), "studio" if i % 2 == 0 else "1br", "pool" if i % 3 == 0 else "city",
                     "True" if i % 2 == 0 else "False", float(asking), f"Project {i % 3}", "University A",
                     100 + 200 * (i % 3), 20 + 10 * (i % 3), "peak" if i % 4 == 0 else "normal", 2025, i % 12 + 1,
                     0.75 + (i % 5) / 100, 1 + (i % 6) / 10, 10000.0 + 100 * (i % 5), asking / market, "False", weeks))
    ddl = ("listing_id string, unit_id string, project_id int, date_listed string, data_split string, floor int, "
           "size_sqm double, room_type string, view string, furnished string, first_asking_rent double, "
           "project_name string, university string, distance_to_campus_m int, facility_count int, season_listed string, "
           "listing_year int, listing_month int, market_occupancy double, market_demand_pressure double, "
           "market_median_asking_rent double, rent_to_market_ratio double, missing_market_history string, "
           "weeks_on_market double")
    return spark.createDataFrame(rows, ddl)


def test_ttl_run_shapes(spark):
    out = runs.ttl_run(ttl_frame(spark), forest_params=SMALL_FOREST)
    metrics = out["metrics"].collect()
    assert len(metrics) == 4
    assert {(r["model"], r["split"]) for r in metrics} == {(m, s) for m in (runs.LINEAR, runs.FOREST)
                                                          for s in ("validation", "test")}
    val = {r["model"]: r["mae"] for r in metrics if r["split"] == "validation"}
    assert out["winner"] == min(val, key=val.get)
    assert out["prediction_table"].count() == 15
    assert out["deployment_training_rows"] == 90 and out["excluded_post_test_rows"] == 0
    from dwell.ml.outputs import save_ttl_run
    paths = save_ttl_run(spark, out, tempfile.mkdtemp(prefix="dwell-ttl-"))
    assert spark.read.option("header", True).csv(paths["predictions"]).count() == 15
    meta = io.read_metadata(spark, paths["metadata"]).first()
    assert meta["winner"] == out["winner"] and meta["params"]["max_depth"] == 4 and meta["excluded_post_test_rows"] == 0
    assert meta["features"] == [*feat.TTL_CATEGORICAL, *feat.TTL_NUMERIC] and meta["minimum_follow_up_weeks"] == 52
    assert {(m["model"], m["split"]) for m in meta["metrics"]} == {(r["model"], r["split"]) for r in metrics}
    importance = ML.grouped_importance(out["models"][runs.FOREST])
    assert sum(v for _, v in importance) == pytest.approx(1.0)
    assert {f for f, _ in importance} == set(feat.TTL_CATEGORICAL) | set(feat.TTL_NUMERIC)
    out["data"].unpersist()


def test_ttl_metrics_clip(spark):
    df = spark.createDataFrame([(0.0, -3.0), (2.0, 4.0)], "actual double, prediction double")
    r = M.ttl_metrics(df, group=()).first()
    assert r["mae"] == pytest.approx(1.0) and r["rmse"] == pytest.approx(math.sqrt(2))
    assert r["within_2_pct"] == pytest.approx(100.0) and r["within_1_pct"] == pytest.approx(50.0)


def price_frame(spark):
    rows = []
    for i in range(60):
        size = 20 + 0.2 * i
        floor = i % 10 + 1
        rows.append(((dt.date(2025, 1, 1) + dt.timedelta(days=i)).isoformat(), floor, size, "studio", "city", "True",
                     12 if i % 2 == 0 else 6, "True" if i % 4 == 0 else "False", "A" if i < 30 else "B",
                     "University A", 100 + i, 20, 2025, str(i % 12 + 1), 4000 + 250 * size + 5 * floor))
    ddl = ("date_start string, floor int, size_sqm double, room_type string, view string, furnished string, "
           "lease_months int, is_renewal string, project_name string, university string, distance_to_campus_m int, "
           "facility_count int, start_year int, start_month string, rent double")
    return spark.createDataFrame(rows, ddl).withColumn("i", F.monotonically_increasing_id())


def test_forward_selection_finds_size(spark):
    df = price_frame(spark)
    folds = splits.sliced_folds(df, "date_start", [("f1", "2025-01-30", "2025-02-09"), ("f2", "2025-02-09", "2025-02-19")])
    selected, history = forward.forward_select(folds, feat.PRICE_CATEGORICAL, feat.PRICE_NUMERIC, "rent")
    assert "size_sqm" in selected
    assert history[0]["mae_improvement"] is None and set(history[0]) >= {"fold_1_mae", "fold_2_mae"}


def test_preprocessor_drop_first_unseen_and_names(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), (None, 4.0)], "cat string, x double")
    enc = encode.fit_preprocessor(train, ["cat"], ["x"], drop_first=True)
    assert enc.names == ["category__cat_b", "category__cat_c", "number__x"]
    assert enc.medians["x"] == 3.0 and enc.modes["cat"] == "a"
    test = spark.createDataFrame([("zzz", None), ("c", 1.0)], "cat string, x double")
    vecs = [r[0].toArray().tolist() for r in enc.transform(test).select("features").collect()]
    assert vecs == [[0.0, 0.0, 3.0], [0.0, 1.0, 1.0]]
    assert encode.layout(enc) == [("cat", 0, 2), ("x", 2, 1)]


def test_linear_collinear_and_persistence(spark):
    df = price_frame(spark)
    model = ML.fit_linear(df, ["project_name", "university"], ["size_sqm", "floor", "distance_to_campus_m"], "rent")
    table = ML.coefficient_table(model)
    assert table[0][0] == "intercept"
    assert [abs(v) for _, v in table[1:]] == sorted((abs(v) for _, v in table[1:]), reverse=True)
    pred = model.predict(df, keep=["rent"]).select(F.max(F.abs(F.col("rent") - F.col("prediction")))).first()[0]
    assert pred < 1e-6          # the rent formula is linear in size and floor
    path = tempfile.mkdtemp(prefix="dwell-model-")
    model.pipeline.write().overwrite().save(path)
    again = PipelineModel.load(path)
    first = model.pipeline.transform(df).select(F.col("prediction").alias("p1"), *df.columns)
    diff = again.transform(first).select(F.max(F.abs(F.col("p1") - F.col("prediction")))).first()[0]
    assert diff == 0.0


def test_boosting_and_scoring(spark):
    df = price_frame(spark)
    model = ML.fit_boosting(df, ["project_name"], ["size_sqm"], "rent",
                            {"n_estimators": 5, "max_depth": 2, "min_samples_leaf": 2})
    assert sum(v for _, v in ML.encoded_importance(model)) == pytest.approx(1.0)
    rooms = df.drop("start_year", "start_month", "rent")
    linear = ML.fit_linear(df, [], ["size_sqm"], "rent")
    rec = runs.recommend_price(linear, rooms, keep=("i",)).collect()
    assert all(r["recommended_rent"] == max(0.0, round(r["predicted_rent"])) for r in rec)


def test_price_dataset_column_order(spark):
    leases = spark.createDataFrame([("C1", 1, 7, "2025-02-03", 6, 9000.0, True)],
                                   "lease_id string, unit_id bigint, project_id int, date_start string, lease_months int, "
                                   "rent double, is_renewal boolean")
    units = spark.createDataFrame([(1, 7, 3, 25.0, "studio", "city", None)],
                                  "unit_id bigint, project_id int, floor int, size_sqm double, room_type string, "
                                  "view string, furnished boolean")
    projects = spark.createDataFrame([(7, "P", "U", 300, 20)], "project_id int, project_name string, university string, "
                                                             "distance_to_campus_m int, facility_count int")
    out = feat.price_dataset({"leases": leases, "units": units, "projects": projects})
    assert out.columns == [feat.PRICE_DATE, *feat.PRICE_FEATURES, feat.PRICE_TARGET]
    r = out.first()
    assert (r["start_year"], r["start_month"]) == (2025, 2)
    text = feat.price_model_input(out).first()
    assert (text["furnished"], text["is_renewal"], text["start_month"]) == ("nan", "True", "2")


def test_tuning_pick_and_price_run(spark):
    d = F.to_date("date_start")
    df = price_frame(spark).withColumn("split", F.when(d <= "2025-02-09", "train").when(d <= "2025-02-19", "validation")
                                       .otherwise("test"))
    folds = splits.sliced_folds(df, "date_start", [("f1", "2025-01-25", "2025-02-04")])
    grid = ({"n_estimators": 3, "learning_rate": 0.1, "max_depth": 2, "min_samples_leaf": 2, "subsample": 1.0},
            {"n_estimators": 3, "learning_rate": 0.1, "max_depth": 2, "min_samples_leaf": 2, "subsample": 1.0})
    best, rows = runs.tune_boosting(folds, ["project_name"], ["size_sqm", "floor"], "rent", grid)
    assert [r["set_number"] for r in rows] == [1, 2]
    assert best["set_number"] == 1          # identical sets tie on MAE and std -> first set
    out = runs.price_run(feat.price_features_and_target(df, keep=("split", "date_start")),
                         (("f1", "2025-01-25", "2025-02-04"),), grid=grid[:1])
    metrics = {(r["model"], r["split"]) for r in out["metrics"].collect()}
    assert metrics == {(m, s) for m in (runs.STEPWISE, runs.BOOSTING) for s in ("validation", "test")}
    assert "size_sqm" in out["selected"]
    from dwell.ml.outputs import save_price_run
    folder = tempfile.mkdtemp(prefix="dwell-run-")
    paths = save_price_run(spark, out, folder)
    assert spark.read.option("header", True).csv(paths["metrics"]).count() == 4
    assert PipelineModel.load(paths["model_winner"]) is not None
    out["data"].unpersist()


def test_scoring_rejects_invalid_dates(spark):
    df = price_frame(spark)
    model = ML.fit_linear(df, [], ["size_sqm"], "rent")
    rooms = df.drop("start_year", "start_month", "rent").withColumn("date_start", F.when(F.col("floor") == 3, "soon").otherwise(F.col("date_start")))
    with pytest.raises(ValueError, match="date_start"):
        runs.recommend_price(model, rooms, keep=("i",))


def test_small_scale_feature_is_kept():
    import numpy as np
    r = np.random.default_rng(1)
    big, small = r.normal(0, 1e6, 500), r.normal(0, 1e-3, 500)
    z = np.column_stack([big, small, np.ones(500) * 7, 2e-6 * big + 3e3 * small, np.ones(500)])
    beta, b0 = forward.ols_from_gram(z.T @ z, [0, 1, 2])
    assert beta == pytest.approx([2e-6, 3e3, 0.0], rel=1e-6) and abs(b0) < 1e-6


def test_tuning_table_equals_single_fits(spark):
    """Sets that share an ensemble are read off its stages: as if fitted alone."""
    d = F.to_date("date_start")
    df = price_frame(spark)
    folds = splits.sliced_folds(df, "date_start", [("f1", "2025-01-25", "2025-02-04")])
    params = {"n_estimators": 3, "learning_rate": 0.1, "max_depth": 2, "min_samples_leaf": 2, "subsample": 0.8}
    grid = [params, {**params, "n_estimators": 7}, {**params, "learning_rate": 0.2}]
    sides = df.filter(d <= "2025-01-25"), df.filter((d > "2025-01-25") & (d <= "2025-02-04"))
    for number, row in enumerate(runs.tuning_table(folds, ["project_name"], ["size_sqm"], "rent", grid)):
        model = ML.fit_boosting(sides[0], ["project_name"], ["size_sqm"], "rent", grid[number])
        for part, name in zip(sides, ("mean_train_mae", "fold_1_mae")):
            want = model.predict(part, keep=["rent"]).select(F.avg(F.abs(F.col("rent") - F.col("prediction")))).first()[0]
            assert row[name] == pytest.approx(want)
        assert row["mae_gap"] == pytest.approx(row["mean_validation_mae"] - row["mean_train_mae"])
        assert (row["set_number"], row["n_estimators"]) == (number + 1, grid[number]["n_estimators"])


def test_registered_tuning_runs_the_whole_grid(spark, monkeypatch):
    from dwell.plans.catalog import models as catalog
    asked = []

    def table(folds, categorical, numeric, target, grid=()):
        asked.append((len(folds.names), tuple(grid)))
        return [{"set_number": i, "mean_validation_mae": float(abs(i - 11)), "std_validation_mae": 0.0, **p} for i, p in enumerate(grid, 1)]

    def run(labelled, windows, grid=(), **kw):
        asked.append((len(windows), tuple(grid)))
        frame = spark.createDataFrame([("m", "test", 1, 1.0, 1.0, 1.0)], "model string, split string, rows long, mae double, rmse double, r2 double")
        return {"metrics": frame, "winner": "m", "data": frame}

    monkeypatch.setattr(runs, "tuning_table", table)
    monkeypatch.setattr(runs, "price_run", run)
    chosen = [r["set_number"] for r in catalog.m13(spark, "/root/testdata/sf0.001").filter("chosen").collect()]
    catalog.m23(spark, "/root/testdata/sf0.001")
    assert chosen == [11.0] and asked == [(4, runs.BOOSTING_GRID)] * 2 and len(runs.BOOSTING_GRID) == 12


def test_selection_hands_few_blocks_to_a_worker(spark, monkeypatch):
    import pyarrow as pa
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held, seen = spark.conf.get(name), []
    with forward.few_blocks(spark):
        sizes = spark.range(0, 300, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert max(r["n"] for r in sizes.collect()) <= forward.BLOCKS
    assert spark.conf.get(name) == held
    monkeypatch.setattr(forward, "few_blocks", lambda s, usual=forward.few_blocks: (seen.append(name), usual(s))[1])
    rows = spark.createDataFrame([(i % 2, f"v{i % 3}", float(i % 5), float(i % 3)) for i in range(60)], "slice int, c string, n double, y double")
    folds = splits.SlicedFolds(rows, ("f",), ((0, 1),))
    assert forward.forward_select(folds, ["c"], ["n"], "y")[0] == ["c"]
    assert len(seen) == 3 and spark.conf.get(name) == held         # the Gram pass and two rounds


def test_linear_fit_computes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    train = spark.range(0, 400, 1, 4).selectExpr("concat('v', id % 3) AS c", "cast(id % 7 AS double) AS n", "cast(id % 3 + 2 * (id % 7) AS double) AS y")
    fitted = ML.fit_linear(train.mapInArrow(rows, train.schema), ["c"], ["n"], "y")
    assert made.value == 400
    assert dict(ML.coefficient_table(fitted))["number__n"] == pytest.approx(2.0)
