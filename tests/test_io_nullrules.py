"""Null rules N6, N12, N18 and the folder reader / writers."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from dwell.ml import encode
from dwell.operators import stats
from dwell.sources import io


def test_group_keys_null_dropped_or_kept(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 5.0), ("a", 3.0)], "g string, y double")
    dropped = {r["g"] for r in stats.grouped_describe(df, "g", "y").collect()}
    assert dropped == {"a"}                                   # N6 default: null key dropped
    kept = {r["value"]: r["count"] for r in stats.by_dimensions(df, ["g"], "y").collect()}
    assert kept == {"a": 2, None: 1}                          # N6 dropna=False: null key kept


def test_null_category_imputed_by_training_mode(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("a",)], "c string")
    enc = encode.fit_preprocessor(train, ["c"], [], drop_first=False)
    assert enc.modes["c"] == "a"                              # tie 2-2 -> smallest value
    v = enc.transform(spark.createDataFrame([(None,)], "c string")).select("features").first()[0].toArray().tolist()
    assert v == [1.0, 0.0]                                    # N12: null -> mode "a"


def test_csv_folder_reader_null_tokens_and_missing_file(spark):
    folder = tempfile.mkdtemp(prefix="dwell-csv-")
    schemas = {"projects": "project_id int, project_name string, university string"}
    path = io.table_path(folder, "projects", cleaned=True)
    os.makedirs(path)
    with open(os.path.join(path, "part-0.csv"), "w") as fh:
        fh.write("project_id,project_name,university\n1,NA,U1\n2,,U2\n3,P3,nan\n")
    t = io.load_tables(spark, folder, cleaned=True, fmt="csv", schemas=schemas)["projects"]
    rows = sorted(tuple(r) for r in t.collect())
    assert rows == [(1, None, "U1"), (2, None, "U2"), (3, "P3", None)]      # N18
    with pytest.raises(FileNotFoundError) as err:
        io.load_tables(spark, folder, cleaned=False, fmt="csv", schemas=schemas)
    assert "projects.csv" in str(err.value)


KINDS = "a int, b bigint, c double, d boolean, e date, f string"


def csv_folder(*files):
    folder = tempfile.mkdtemp(prefix="dwell-csv-")
    for i, lines in enumerate(files):
        with open(os.path.join(folder, f"part-{i}.csv"), "w") as fh:
            fh.write("\n".join(["a,b,c,d,e,f", *lines, ""]))
    return folder


def test_null_spellings_hold_in_every_type(spark):
    lines = [",".join([token] * 6) for token in io.NULL_TOKENS if token] + ["1,2,0.5,True,2020-02-29,text", '"",,"",,,', "3.0,4.0,5,false,2021-01-01, NA"]
    rows = io.read_text_table(spark, csv_folder(lines), KINDS).collect()
    values = [tuple(r) for r in rows if any(v is not None for v in r)]
    assert len(rows) == len(lines) and len(values) == 2                         # " NA" is a text: spellings are not trimmed
    assert values[0][:4] == (1, 2, 0.5, True) and str(values[0][4]) == "2020-02-29" and values[0][5] == "text"
    assert values[1][:4] == (3, 4, 5.0, False) and values[1][5] == " NA"


def test_texts_of_no_value_are_reported(spark):
    folder = csv_folder(["1,1,1,true,2020-01-01,x", "x,1,1,true,2020-01-01,x", "2,3.5,NA,maybe,2020-02-30,y"], ["9,9,9,false,2020-01-01,z", "99999999999,1,1.x,true,soon,z"])
    found = sorted((os.path.basename(r["file"]), r["line"], r["column"], r["value"]) for r in io.rejected(spark, folder, KINDS).collect())
    assert found == [("part-0.csv", 3, "a", "x"), ("part-0.csv", 4, "b", "3.5"), ("part-0.csv", 4, "d", "maybe"), ("part-0.csv", 4, "e", "2020-02-30"),
                     ("part-1.csv", 3, "a", "99999999999"), ("part-1.csv", 3, "c", "1.x"), ("part-1.csv", 3, "e", "soon")]
    loose = io.read_text_table(spark, folder, KINDS, strict=False)
    assert sorted(str(r["a"]) for r in loose.collect()) == ["1", "2", "9", "None", "None"]
    strict = io.read_text_table(spark, folder, KINDS)
    with pytest.raises(Exception, match="column a: not a value of type int: (x|99999999999)"):
        strict.select("a").collect()
    assert strict.select("f").count() == 5                                      # a column that is not read raises nothing


def test_lines_of_a_split_file(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    folder = csv_folder([f"{'x' if i % 700 == 0 else i},1,1,true,2020-01-01,t" for i in range(1, 3001)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert [(r["line"], r["value"]) for r in io.rejected(spark, folder, KINDS).orderBy("line").collect()] == [(i + 1, "x") for i in (700, 1400, 2100, 2800)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_header_must_match(spark):
    with pytest.raises(Exception, match="(?i)header"):
        io.read_text_table(spark, csv_folder(["1,1,1,true,2020-01-01,x"]), "z int, b bigint, c double, d boolean, e date, f string").collect()


def test_binding_follows_the_files(spark):
    import shutil
    from dwell.sources import binding
    folder = tempfile.mkdtemp(prefix="dwell-base-")
    for name in binding.BASE_TABLES:
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    first = binding.views(spark, folder)
    assert binding.views(spark, folder) is first
    units, old = first["units"].count(), binding._cache[spark.sparkContext.applicationId, folder][2]
    parts = [f for f in os.listdir(f"{folder}/customer.parquet") if f.endswith(".parquet")]
    kept = spark.read.parquet(f"{folder}/customer.parquet").filter("c_custkey > 50").toPandas()
    for f in parts[1:]:
        os.remove(f"{folder}/customer.parquet/{f}")
    shutil.rmtree(f"{folder}/customer.parquet")
    spark.createDataFrame(kept).write.parquet(f"{folder}/customer.parquet")
    again = binding.views(spark, folder)
    assert again is not first and again["units"].count() < units
    assert not binding.path_exists(spark, old)                                  # the replaced version is gone


def test_report_and_metadata_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="dwell-report-")
    df = spark.createDataFrame([("train", 1.23456)], "split string, mae double")
    back = io.read_report(spark, io.write_report(df, f"{folder}/m"), "split string, mae double")
    assert back.select(F.round("mae", 2)).first()[0] == 1.23                 # S06 presentation rounding
    meta = spark.range(1).select(
        F.lit("x").alias("winner"), F.lit("validation_mae").alias("selection_metric"),
        F.create_map(F.lit("train_end"), F.lit("2025-12-31")).alias("cutoffs"),
        F.array(F.struct(F.lit("q1").alias("fold"), F.lit("a").alias("train_end"), F.lit("b").alias("validation_end"),
                         F.lit(3).cast("long").alias("train_rows"), F.lit(1).cast("long").alias("validation_rows"))
                ).alias("rolling_folds"),
        F.array(F.lit("size_sqm")).alias("features"),
        F.create_map(F.lit("max_depth"), F.lit(2.0)).alias("params"))
    read = io.read_metadata(spark, io.write_metadata(meta, f"{folder}/meta"))
    assert io.metadata_folds(read).first()["train_rows"] == 3                # S05 inline
    assert io.metadata_params(read).first()["key"] == "max_depth"


def test_run_metadata_holds_the_run(spark, monkeypatch):
    import json

    from pyspark.sql import Row

    from dwell.ml import runs
    from dwell.plans import features as feat
    from dwell.plans import registry
    from dwell.plans.catalog import sources
    from dwell.sources import binding
    asked = []

    def run(labelled, windows, grid=(), **kw):
        asked.append(grid)
        metrics = [(m, s, 3, 1.0, 2.0, 0.5) for m in (runs.STEPWISE, runs.BOOSTING) for s in ("test", "validation")]
        folds = [Row(fold=f, train_end=t, validation_end=v, train_rows=5 + i, validation_rows=i, ordinal=i) for i, (f, t, v) in enumerate(windows)]
        return {"winner": runs.STEPWISE, "selected": ["size_sqm", "floor"], "features": list(feat.PRICE_FEATURES), "best_params": dict(grid[9]), "folds": folds, "data": labelled,
                "metrics": spark.createDataFrame(metrics, "model string, split string, rows long, mae double, rmse double, r2 double")}

    monkeypatch.setattr(runs, "price_run", run)
    out = registry.QUERIES["s04_run"](spark, "/root/testdata/sf0.001").first()
    assert asked == [runs.BOOSTING_GRID]                            # the full run: every set
    assert out["winner"] == runs.STEPWISE and json.loads(out["features"]) == ["size_sqm", "floor"]
    assert len(json.loads(out["metrics"])) == 4 and json.loads(out["cutoffs"])["train_end"] == binding.PRICE_TRAIN_END
    monkeypatch.setattr(sources, "closed_price_run", lambda spark, sf: run(spark.createDataFrame([("train",)], "split string"), binding.PRICE_FOLDS, runs.BOOSTING_GRID))
    got = {q: registry.QUERIES[q](spark, "/root/testdata/sf0.001").collect() for q in ("s05", "s05_params")}
    assert [tuple(r) for r in got["s05"]] == [(f, t, v, 5 + i, i) for i, (f, t, v) in enumerate(binding.PRICE_FOLDS)]
    assert {r["key"]: r["value"] for r in got["s05_params"]} == {k: float(v) for k, v in runs.BOOSTING_GRID[9].items()}
    with pytest.raises(KeyError, match="colour"):
        io.metadata_frame(spark, {"colour": "red"})
