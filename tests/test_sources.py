"""Run files, result documents and charts."""

import json

import pytest

from seriesloom.plans import diagnosis
from seriesloom.sources import charts, results, runs


@pytest.fixture
def root(tmp_path):
    def put(name, header, n):
        p = tmp_path / "raw" / f"{name}.csv"
        p.parent.mkdir(parents=True, exist_ok=True)
        names = header.split(",")
        lines = [",".join(str(10.0 * i if c == "TIME" else len(c) * 100 + i) for c in names) for i in range(n)]
        p.write_text("\n".join([header, *lines]) + "\n")

    for name, header, n in (
        ("A/1", "TIME,P,TAVG,PWR", 12), ("A/2", "TIME,P,TAVG,PWR", 9), ("A/10", "TIME,P,TAVG,PWR", 4), ("B/-1", "TIME,P,TAVG,PWR,WPCS", 11),
        ("B/1", "TIME,P,TAVG,PWR,WPCS", 11), ("C/1", "TIME,PWR,P,TAVG", 20), ("E/1", "TIME,P,TAVG,PWR", 0),
    ):
        put(name, header, n)
    (tmp_path / "raw/A/notes.txt").write_text("x")
    (tmp_path / "raw/A/sub").mkdir()
    (tmp_path / "raw/A/sub/9.csv").write_text("TIME,P\n1,2\n")
    put.root = str(tmp_path / "raw")
    return put


def test_load(spark, root):
    readings, files, sensors = runs.load(spark, root.root)
    assert sensors == ["P", "TAVG", "PWR"] and runs.accident_types(files) == ["A", "B", "C", "E"]
    assert readings.columns == ["accident_type", "severity_id", "time_seconds", "P", "TAVG", "PWR"]
    got = {(r[0], r[1]): (r[2], r[3]) for r in readings.where("time_seconds = 0").select("accident_type", "severity_id", "P", "PWR").collect()}
    assert got == {k: (100.0, 300.0) for k in (("A", "1"), ("A", "2"), ("A", "10"), ("B", "-1"), ("B", "1"), ("C", "1"))}
    assert files.count() == 7


def test_missing_sensor_and_bad_value(spark, root):
    root("D/1", "TIME,P,PWR", 5)
    with pytest.raises(ValueError, match="TAVG"):
        runs.load(spark, root.root)
    with pytest.raises(Exception):  # noqa: B017
        root("D/1", "TIME,P,TAVG,PWR", 5)
        p = root.root + "/D/1.csv"
        text = open(p).read().replace("101", "abc")
        open(p, "w").write(text)
        runs.load(spark, root.root)[0].collect()


def test_plans(spark, root, tmp_path):
    loaded = runs.load(spark, root.root)
    doc = diagnosis.eda(*loaded)
    assert doc["total_samples"] == 7
    assert {t["accident_type"]: (t["sample_count"], t["max_duration_seconds"]) for t in doc["accident_types"]} == {"A": (3, 110.0), "B": (2, 100.0), "C": (1, 190.0), "E": (1, 0.0)}
    windows, summary = diagnosis.features(*loaded)
    assert summary["windows_per_accident_type"] == [["A", 5], ["B", 6], ["C", 6]] and summary["accident_types_with_zero_windows"] == ["E"]
    results.write_windows(windows, str(tmp_path / "w"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).count() == 17
    results.write_document(spark, doc, str(tmp_path / "eda"))
    assert results.read_document(spark, str(tmp_path / "eda"), "total_samples int").first()[0] == 7
    scratch = diagnosis.scratch(*loaded, rounds=2)
    assert scratch["n_train"] + scratch["n_test"] == 17 and set(scratch["cart_tree"]) == {"accuracy", "macro_f1", "labels", "confusion_matrix", "per_class"}
    assert json.dumps(scratch)


def test_more_plans(spark, root):
    for i in range(2, 8):
        root(f"C/{i}", "TIME,PWR,P,TAVG", 14)
    loaded = runs.load(spark, root.root)
    assert diagnosis.baseline(*loaded)["random_forest"]["accuracy"] >= 0
    found = diagnosis.out_of_distribution(*loaded, unknown="B , E", rounds=2)
    assert 0 <= found["auroc"] <= 1 and found["ood_types"] == ["B", "E"]
    k = diagnosis.kinetics(*loaded, up="A", down="C")
    assert len(k["simulated_up"]) == 601 and k["recorded_up"][0] == [0.0, 1.0] and max(t for t, _ in k["recorded_down"]) == 120.0
    assert len(diagnosis.lstm(*loaded, length=5, hidden=4, epochs=2)["losses"]) == 2


def test_charts():
    assert charts.bar_chart("t", [("a<b", 1.0), ("c", 2.0)], "n").count("<rect") == 3
    assert "a&lt;b" in charts.bar_chart("t", [("a<b", 1.0)], "n")
    assert charts.line_chart("t", [("s", [(0.0, 1.0), (1.0, 2.0)])], "x", "y").count("<polyline") == 1
    assert charts.heatmap("m", ["a", "b"], [[1, 1], [0, 0]]).count('fill="#ffffff"') == 2
    assert charts.histogram_chart("h", [], 1.0) == ""
    assert "acc" in results.table_text([{"acc": 0.5}])


def test_staged_tables_can_be_cleared(spark):
    import os

    from seriesloom import shared

    kept = shared.staged(spark.range(3), "t")
    folder = shared.own_dir(spark).removeprefix("file://")
    assert kept.count() == 3 and os.path.isdir(folder)
    shared.clear(spark)
    assert not os.path.exists(folder)
