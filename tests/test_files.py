"""Files in, tables out."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.masks import anomaly_mask
from tidewatch.plans import batch
from tidewatch.sources import files, sinks


def test_csv_series_and_json_windows(spark, tmp_path):
    for name in ("web/one.csv", "web/two.csv", "app/three.csv"):
        path = tmp_path / "data" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("timestamp,value\n" + "".join(f"2024-01-01 00:0{i}:00,{i}.5\n" for i in range(6)))
    windows = {
        "web/one.csv": [["2024-01-01 00:01:00", "2024-01-01 00:02:30"], ["2024-01-01 00:04:10", "2024-01-01 00:04:20"], ["2025-01-01 00:00:00", "2025-01-02 00:00:00"]],
        "web/two.csv": [], "app/three.csv": [["2024-01-01 00:00:00", "2024-01-01 00:00:00"]],
    }
    (tmp_path / "windows.json").write_text(json.dumps(windows, indent=1))
    series = files.csv_series(spark, str(tmp_path / "data"))
    w = files.json_windows(spark, str(tmp_path / "windows.json"))
    assert series.count() == 18
    assert {r[0] for r in series.select("series_id").distinct().collect()} == set(windows)
    chosen = files.in_category(series, w, "web")
    assert {r[0] for r in chosen.select("series_id").distinct().collect()} == {"web/one.csv"}
    assert files.in_category(series, w, "web", include_empty=True).count() == 12
    marked = anomaly_mask(chosen, w.filter("start_ts is not null")).filter("is_anomaly").select(F.collect_list("idx")).first()[0]
    assert sorted(marked) == [1, 2, 5]


def test_batch_analysis_is_saved(spark, indexed, tmp_path):
    a = batch.analyse(indexed(), ["f0", "f1", "f2"], n_steps=1)
    scores = batch.fuse(a)
    names = sinks.save_analysis(a, scores, str(tmp_path / "out"), full=True)
    assert "path_stats" in names and "paths" in names
    back = spark.read.parquet(str(tmp_path / "out/scores"))
    assert back.count() == 490
    assert np.isfinite(back.toPandas()["score"]).all()
    assert spark.read.parquet(str(tmp_path / "out/path_stats")).count() == 6
    with pytest.raises(Exception):
        spark.read.parquet(str(tmp_path / "out/missing"))
