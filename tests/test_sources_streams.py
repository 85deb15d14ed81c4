"""Readers, writers and streams."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.sources import las, rasters, survey
from strataspark.streaming import events as S


def test_control_file_with_decimal_commas(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿Point No;Elevation;Easting;Northing;Type\n# note\nA1;12,5;100,25;200,75;full\nA2;13,0;bad;201;check\n;14;300;400;CHK\n", encoding="utf-8")
    points, rejects = survey.read_control(spark, str(tmp_path / "c.csv"))
    got = {r["id"]: (r["x"], r["y"], r["z"], r["is_check"]) for r in points.collect()}
    assert got == {"A1": (100.25, 200.75, 12.5, False), "G0005": (300.0, 400.0, 14.0, True)}
    assert [(r["line"], r["reason"]) for r in rejects.collect()] == [(4, "no x")]


def test_whole_file_is_read_not_the_sniffed_lines(spark, tmp_path):
    (tmp_path / "c.txt").write_text("id x y z\n" + "".join(f"P{k} {k}.5 {k} 1\n" for k in range(1000)))
    points, rejects = survey.read_control(spark, str(tmp_path / "c.txt"))
    assert points.count() == 1000 and rejects.count() == 0


def test_flight_log_units(spark, tmp_path):
    (tmp_path / "f.csv").write_text("image,x,y,z,omega,phi,kappa\na.tif,1,2,3,90,0,180\nb.tif,1,2,3,,0,1\n")
    good, bad = survey.read_exterior(spark, str(tmp_path / "f.csv"))
    r = good.head()
    assert abs(r["omega"] - math.pi / 2) < 1e-12 and abs(r["kappa"] - math.pi) < 1e-12 and bad.count() == 1


def test_sniffing():
    assert survey.sniff(["a;b;c", "1;2;3"]) == {"sep": ";", "header": ["a", "b", "c"], "columns": 3}
    assert survey.sniff(["1 2 3", "4 5 6"])["header"] is None
    assert survey.sniff([])["columns"] == 0
    assert survey.match_columns(["Point No", "Easting", "Northing"], ["id", "x", "y"]) == {"id": 0, "x": 1, "y": 2}
    assert survey.match_columns(["Point No", "X_lo", "Y_lo"], ["id", "x", "y"]) == {"id": 0, "x": 2, "y": 1}  # x runs south there, y west


def test_rpc_sidecar_and_cameras(spark, tmp_path):
    text = "LINE_OFF: 100.5 pixels\nSAMP_OFF = 200\nLAT_OFF=-25\nLONG_OFF=31\nHEIGHT_OFF=1000\nLINE_SCALE=1\nSAMP_SCALE=1\nLAT_SCALE=1\nLONG_SCALE=1\nHEIGHT_SCALE=1\n"
    for name in ("LINE_NUM_COEFF", "LINE_DEN_COEFF", "SAMP_NUM_COEFF", "SAMP_DEN_COEFF"):
        text += "".join(f"{name}_{k}: {k / 10}\n" for k in range(1, 21))
    (tmp_path / "a_RPC.TXT").write_text(text)
    r = survey.read_rpc(spark, str(tmp_path / "a_RPC.TXT")).head()
    assert (r["line_off"], r["samp_off"]) == (100.5, 200.0) and r["samp_den"] == [k / 10 for k in range(1, 21)]
    (tmp_path / "cams.json").write_text(json.dumps({"version": 1, "cameras": [{"label": "b", "camera": {"f": 1}}, {"label": "a", "camera": {"f": 2}}]}))
    library = survey.read_cameras(spark, str(tmp_path / "cams.json"))
    saved = survey.save_camera(library, "b", '{"f":3}').collect()
    assert [(r["label"], json.loads(r["camera"])["f"]) for r in saved] == [("a", 2), ("b", 3)]


def test_project_document(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"images": [{"id": "1", "name": "a.tif", "extra": 5}], "observations": [{"imageId": "1", "pointId": "p", "col": 1.5, "row": 2}]}))
    t = survey.read_project(spark, str(tmp_path / "p.json"))
    assert t["images"].count() == 1 and t["gcps"].count() == 0 and t["observations"].head()["col"] == 1.5


def _cloud(n=2500):
    rng = np.random.default_rng(1)
    return {"x": rng.random(n) * 100 + 5000, "y": rng.random(n) * 100, "z": rng.random(n) * 10 - 3, "intensity": rng.integers(0, 60000, n), "return_number": rng.integers(1, 4, n), "number_of_returns": np.full(n, 3), "classification": rng.integers(0, 19, n)}


def test_las_round_trip(spark, tmp_path):
    cloud = _cloud()
    (tmp_path / "a.las").write_bytes(las.encode(cloud))
    spark.dataSource.register(las.LasDataSource)
    df = spark.read.format("las").option("chunk", 700).load(str(tmp_path))
    got = df.orderBy("index").toPandas()
    assert df.rdd.getNumPartitions() == 4 and got["index"].tolist() == list(range(2500))
    for c in "xyz":
        assert np.abs(got[c] - cloud[c]).max() < 6e-4
    for c in ("intensity", "return_number", "classification"):
        assert (got[c] == cloud[c]).all()
    with pytest.raises(ValueError):
        las.header(b"nope" + bytes(400))


def test_tiff_round_trip(spark, tmp_path):
    a = np.random.default_rng(2).random((150, 70)).astype(np.float32).astype(float)
    a[3, 4] = np.nan
    (tmp_path / "a.tif").write_bytes(rasters.encode_tiff(a, 1000.0, 2000.0, 2.0, 3.0))
    r = rasters.tiff_info(spark, str(tmp_path / "a.tif")).head()
    assert (r["width"], r["height"], r["bands"], r["dtype"], r["west"], r["north"], r["cell_x"], r["cell_y"], r["nodata"]) == (70, 150, 1, "f4", 1000.0, 2000.0, 2.0, 3.0, -9999.0)
    cells = rasters.read_tiff(spark, str(tmp_path / "a.tif")).toPandas()
    back = np.full(a.shape, np.nan)
    back[cells["row"], cells["col"]] = cells["value"]
    assert np.array_equal(back, a, equal_nan=True) and len(cells) == a.size


def test_text_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    cells, head = rasters.read_text_grid(spark, str(tmp_path / "g.asc"))
    assert head["ncols"] == 3 and {(r["row"], r["col"]): r["value"] for r in cells.collect()} == {(0, 0): 1.0, (0, 1): 2.0, (0, 2): 3.0, (1, 0): 4.0, (1, 1): None, (1, 2): 6.0}


def test_journal_with_a_torn_line(spark, tmp_path):
    lines = [{"t": "x", "ns": 1, "op": "set_state", "payload": '{"a":"1","b":"1"}'}, {"t": "x", "ns": 5, "op": "set_state", "payload": '{"a":"2"}'}, {"t": "x", "ns": 7, "op": "patch", "payload": '{"c":"3"}'}]
    (tmp_path / "j.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n\n{"t": "x", "ns": 9, "op"')
    journal = S.read_journal(spark, str(tmp_path / "j.jsonl"))
    assert {r["field"]: r["value"] for r in S.replay(journal).collect()} == {"a": "2", "c": "3"}
    assert {r["field"]: r["value"] for r in S.replay(journal, 5).collect()} == {"c": "3"}


def test_stream_gives_the_batch_rows(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = S.windowed(stream, "event_type", "value", "1 hour", late="60 days")
    q = out.writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    flat = lambda df: sorted((str(r["start"]), r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert flat(spark.table("hours")) == flat(S.windowed(batch, "event_type", "value", "1 hour"))
    q = S.append_journal(stream, str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
    state = S.last_state(stream, "user_id", "event_id", "value")
    q = state.writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    pick = lambda df: sorted((r["user_id"], r["event_id"]) for r in df.collect())
    assert pick(spark.table("states")) == pick(S.last_state(batch, "user_id", "event_id", "value"))


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = []
    q = S.windowed(stream, "event_type", "value", "1 hour").writeStream.outputMode("append").foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    whole = S.windowed(batch, "event_type", "value", "1 hour").count()
    assert 0 < len(got) <= whole and len(got) >= whole - 10


def test_push_hands_rows_over(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    seen = []
    q = S.push(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda rows: seen.extend(r["id"] for r in rows), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sorted(seen) == list(range(20))


def test_throttle_keeps_finished_jobs(spark):
    rows = spark.createDataFrame([(1, 0.01, 0.1), (1, 0.05, 0.2), (1, 0.06, 1.0), (1, 0.2, 0.3), (2, 0.05, 0.4)], "job int, at double, share double")
    df = rows.withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    got = sorted((r["job"], r["share"]) for r in S.throttled(df, "job", 0.12, done="share").collect())
    assert got == [(1, 0.1), (1, 0.3), (1, 1.0), (2, 0.4)]


def test_a_window_opens_the_strips_that_it_meets(spark, tmp_path, monkeypatch):
    values = np.arange(300 * 20, dtype=float).reshape(300, 20)
    values[7, 3] = np.nan
    (tmp_path / "a.tif").write_bytes(rasters.encode_tiff(values, 0.0, 300.0, 1.0, 1.0, strip=16))
    whole = rasters.read_tiff(spark, str(tmp_path / "a.tif"))
    assert whole.count() == values.size
    got = {(r["row"], r["col"]): r["value"] for r in rasters.read_tiff(spark, f"file:{tmp_path}/a.tif", (5, 2, 30, 4)).collect()}
    assert got == {(r, c): None if np.isnan(values[r, c]) else values[r, c] for r in range(5, 35) for c in range(2, 6)}
    assert rasters.read_tiff(spark, str(tmp_path / "a.tif"), (290, 15, 100, 100)).count() == 50
    assert rasters.read_tiff(spark, str(tmp_path / "a.tif"), (400, 0, 5, 5)).count() == 0
    asked = []
    raw = (tmp_path / "a.tif").read_bytes()

    def read(at, n):
        asked.append((at, n))
        return raw[at : at + n]

    h = rasters.info(read)
    assert sum(n for _, n in asked) < 600 and h["height"] == 300  # the tags and what they point to
    monkeypatch.setattr(rasters, "arrow_reaches", lambda path: False)  # a store that only Spark reads
    again = {(r["row"], r["col"]): r["value"] for r in rasters.read_tiff(spark, str(tmp_path / "a.tif"), (5, 2, 30, 4)).collect()}
    assert again == got and rasters.tiff_info(spark, str(tmp_path / "a.tif")).head()["width"] == 20


def test_two_jobs_write_to_one_folder(spark, tmp_path):
    from strataspark.sources import blobs

    one, two = blobs._Writer(f"file:{tmp_path}/out"), blobs._Writer(str(tmp_path / "out"))
    kept = one.write(iter([{"name": "a.bin", "content": b"1"}]))
    two.commit([two.write(iter([{"name": "b.bin", "content": b"2"}]))])
    one.commit([kept])
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"a.bin": b"1", "b.bin": b"2"}
    assert blobs.qualified(spark, "some/place").startswith("file:/")
    blobs.write_files(spark.createDataFrame([("x y.bin", b"3")], blobs.SCHEMA), f"{tmp_path}/with space")
    assert (tmp_path / "with space" / "x y.bin").read_bytes() == b"3"


def test_comments_and_single_lines_do_not_fool_the_sniff(spark, tmp_path):
    (tmp_path / "long.csv").write_text("".join(f"# comment {k}\n" for k in range(80)) + "id;xLo;yLo;z\np1;5,5;6,5;7\n")
    points, bad = survey.read_control(spark, str(tmp_path / "long.csv"))
    assert [tuple(r) for r in points.select("id", "x", "y", "z").collect()] == [("p1", 6.5, 5.5, 7.0)] and bad.count() == 0
    assert survey.sniff(["a,1,2,3"])["header"] is None and survey.sniff(["id,x,y,z"])["header"] is None
