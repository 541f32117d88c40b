"""Readers, writers and streams."""

import json

from pyspark.sql import functions as F

import pytest

from halyard.sources import readers, workbook, writers
from halyard.streaming import vitals


def test_json_lines_and_counts(spark, tmp_path):
    good, bad = tmp_path / "tag_a", tmp_path / "tag_b"
    for d in (good, bad):
        d.mkdir()
    (good / "r.jsonl").write_text('{"idx": 1, "sid": 5, "gen_flags": ["x"]}\n\n  \n{"idx": 2, "sid": 6, "extra": 1}\n')
    (bad / "r.jsonl").write_text('{"idx": 1}\n{"idx": \n')
    rows = readers.json_lines(spark, str(good)).orderBy("idx").collect()
    assert [(r["idx"], r["sid"], r["gen_flags"]) for r in rows] == [(1, 5, ["x"]), (2, 6, None)]
    assert readers.json_line_count(spark, str(good)).first()["n"] == 2 and readers.json_line_count(spark, str(bad)).first()["n"] == -1
    assert {r["tag"] for r in readers.tagged_results(spark, str(tmp_path / "*" / "*.jsonl")).collect()} == {"tag_a", "tag_b"}


def test_json_map_of_a_missing_file_is_empty(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"1": "a", "2": "b"}))
    assert {r["key"]: r["value"] for r in readers.json_map(spark, str(tmp_path / "m.json")).collect()} == {"1": "a", "2": "b"}
    assert readers.json_map(spark, str(tmp_path / "none.json")).count() == 0


def test_small_readers(spark):
    logs = spark.createDataFrame([("a", "p1", [1]), ("a", "p2", [1, 2]), ("b", "p3", [])], "tag string, path string, log array<int>")
    assert {r["tag"]: r["log"] for r in readers.longest_logs(logs).collect()} == {"a": [1, 2], "b": []}
    assert readers.hinted_columns(["Name", "체중(kg)"], {"w": ("체중", "weight"), "x": ("zz",)}) == {"w": "체중(kg)", "x": None}
    s = readers.synthetic_series(spark, 1, "HR", [80, 81, 0]).collect()
    assert len(s) == 3 and (s[1]["ts"] - s[0]["ts"]).seconds == 300
    cells = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, x string")
    assert [r["x"] for r in readers.filled_down(cells, "id", "x").orderBy("id").collect()] == ["a", "a", "b"]
    assert [r["rows"] for r in readers.preflight(spark, {"none": "/nowhere"}).collect()] == [-1]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0.5), (2, "a|b", None)], "id int, t string, x double")
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    writers.write_csv(df, str(tmp_path / "c"))
    writers.write_text(df, "t", str(tmp_path / "t"))
    assert "| 2 | a\\|b | — |" in writers.markdown(df) and "<td>0.500</td>" in writers.html_table(df, "<x>")
    out = tmp_path / "stage"
    out.write_text("data")
    key = writers.file_digest(str(out))
    assert not writers.is_done(str(out), source=key)
    writers.mark_done(str(out), source=key)
    assert writers.is_done(str(out), source=key) and not writers.is_done(str(out), source="other")
    assert len(writers.invalidate(str(tmp_path), ("*.done",))) == 1 and writers.is_done(str(out), source=key)
    writers.invalidate(str(tmp_path), ("*.done",), apply=True)
    assert not writers.is_done(str(out), source=key)


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{k:02d}:00", "HR <- x", "80") for k in range(12)] + [(1, "2024-01-01 02:00:00", "HR <- x", "90"), (-1, "2024-01-01 02:00:00", "HR", "1")]
    df = spark.createDataFrame(rows, "sid long, t string, item_raw string, value_raw string").select("sid", F.col("t").cast("timestamp_ntz").alias("ts"), "item_raw", "value_raw")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: vitals.arriving(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    for name, out in (("stuck", vitals.stuck_alerts(stream())), ("wins", vitals.windowed(stream()))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r["sid"], r["v"], r["n"]) for r in spark.table("stuck").collect()] == [(1, 80.0, 10)]
    assert spark.table("wins").where("n = 12").count() >= 1


def test_workbooks_are_read_as_they_were_written(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    head = [["Review"], [], ["sid", "old", None, "new <&>"]]
    workbook.write_sheets(path, {"12": [*head, [5, "a\nb", None, 0.5]], "7": [["x"], ["② GT", "q"], [None, None, "  text "]], "notes/1": []})
    sheets = workbook.read_sheets(path)
    assert list(sheets) == ["12", "7", "notes_1"] and sheets["12"][3] == ["5", "a\nb", None, "0.5"] and sheets["12"][2][3] == "new <&>"
    rows = workbook.sheet(spark, path, ["sid", "old", "gap", "new", "more"], skip=3).collect()
    assert [tuple(r) for r in rows] == [("5", "a\nb", None, "0.5", None)]
    assert [tuple(r) for r in workbook.anchored(spark, path, "② GT", {"gt": (1, 2), "none": (9, 0)}).collect()] == [("7", "  text ", None)]
    filled = str(tmp_path / "f.xlsx")
    workbook.write_sheets(filled, {"s": [["case", "reference", "reference"], ["id", "first", "second"], [1, None, "b"], [2, "", "c"], [3, "a", None], [None, "z", "z"]]})
    got = workbook.best_filled(spark, filled, "id", ("reference",)).collect()
    assert [(r["key"], r["value"]) for r in got] == [("1", "b"), ("2", "c"), ("3", None)] and got[0]["source"] == "reference second"
    assert workbook.best_filled(spark, filled, "id", ("none such",)).count() == 0
    writers.write_workbook(filled, {"a": spark.range(3), "b": spark.range(0)})
    assert workbook.read_sheets(filled) == {"a": [["id"], ["0"], ["1"], ["2"]], "b": [["id"]]}


def test_missing_files_count_nothing_and_maps_have_a_key_once(spark, tmp_path):
    assert readers.json_line_count(spark, str(tmp_path / "none.jsonl")).first()["n"] == 0
    one = spark.createDataFrame([("1", "a"), ("2", "b")], "key string, value string")
    writers.write_map(one, str(tmp_path / "m"))
    assert readers.key_value(spark, str(tmp_path / "m"), "string").count() == 2
    writers.write_map(one.unionByName(one), str(tmp_path / "m"))
    with pytest.raises(ValueError):
        readers.key_value(spark, str(tmp_path / "m"), "string")


def test_results_of_several_folders_have_their_tags(spark, tmp_path):
    for setting in ("few", "zero"):
        (tmp_path / setting).mkdir()
        (tmp_path / setting / "base.jsonl").write_text('{"idx": 1, "sid": 2}\n')
    tags = spark.createDataFrame([("few", "base", "llama_raw"), ("few", "other", "x")], "setting string, stem string, tag string")
    assert [(r["tag"], r["sid"]) for r in readers.mapped_results(spark, str(tmp_path), tags).collect()] == [("llama_raw", 2)]


def test_reports_digests_and_archives(spark, tmp_path):
    df = spark.createDataFrame([(1, "<b>", None)], "sid int, t string, x double")
    page = writers.html_report("R & D", {"n": 1, "mean": None}, {"all": df}, df)
    assert "R &amp; D" in page and "&lt;b&gt;" in page and "<summary>1</summary>" in page and "<b>—</b>" in page and "<script" not in page
    assert writers.dir_digest(str(tmp_path)) == "no-ckpt" and not writers.is_checkpoint(str(tmp_path))
    (tmp_path / "config.json").write_text("{}")
    (tmp_path / "a.bin").write_bytes(b"x" * 100)
    first = writers.dir_digest(str(tmp_path))
    assert len(first) == 16 and writers.is_checkpoint(str(tmp_path)) and writers.file_digest(str(tmp_path / "a.bin"), whole=10, part=4) != writers.file_digest(str(tmp_path / "a.bin"))
    (tmp_path / "a.bin").write_bytes(b"y" * 100)
    assert writers.dir_digest(str(tmp_path)) != first
    assert {r["name"] for r in writers.content_digests(spark, str(tmp_path / "*.bin")).collect()} == {"a.bin"}
    stage = tmp_path / "run" / "eval"
    stage.mkdir(parents=True)
    (stage / "out").write_text("data")
    writers.mark_done(str(stage / "out"), k=1)
    root, away = str(tmp_path / "run"), str(tmp_path / "old")
    assert writers.invalidate(root, scopes=("infer",)) == [] and len(writers.invalidate(root, scopes=("eval",))) == 1
    writers.invalidate(root, scopes=("eval",), apply=True, archive=away)
    assert not (stage / "out").exists() and (tmp_path / "old" / "eval" / "out").read_text() == "data"
    writers.write_csv(df, str(tmp_path / "c"))
    assert [r["sid"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["1"]
