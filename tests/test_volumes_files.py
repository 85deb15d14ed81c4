import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import fits, neighbours, volumes
from strataspark.operators.grid import Grid
from strataspark.sources import las, rasters, tiles
from strataspark.sources.blobs import write_files


def test_las_files_of_a_bounded_size_come_back(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.uniform(0, 1e5), rng.uniform(-50, 50), rng.uniform(0, 9), rng.randrange(1, 4), 3, rng.randrange(18), rng.randrange(60_000)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "x double, y double, z double, return_number int, number_of_returns int, classification int, intensity int")
    las.write_las(df.unionByName(spark.createDataFrame([(None, 1.0)], "x double, y double"), allowMissingColumns=True), str(tmp_path / "a"), most=400)
    files = [p for p in (tmp_path / "a").iterdir() if p.suffix == ".las"]
    assert len(files) >= 8 and not (tmp_path / "a" / "_pending").exists()
    got = las.read_las(spark, str(tmp_path / "a"), chunk=150).select("x", "y", "z", "return_number", "number_of_returns", "classification", "intensity").collect()
    assert np.allclose(sorted(map(tuple, got)), sorted(rows), atol=6e-4)
    heads = las.read_headers(spark, str(tmp_path / "a")).collect()
    assert sum(h["points"] for h in heads) == 3000 and abs(max(h["east"] for h in heads) - max(r[0] for r in rows)) < 1e-3


def test_files_get_their_names_and_take_the_place_of_old_ones(spark, tmp_path):
    for text in (b"one", b"two"):
        write_files(spark.createDataFrame([("a.bin", bytearray(text)), ("b.bin", None)], "name string, content binary"), str(tmp_path / "f"))
    assert (tmp_path / "f" / "a.bin").read_bytes() == b"two" and (tmp_path / "f" / "b.bin").read_bytes() == b""


def test_tiff_bands_of_rows(spark, tmp_path):
    g = Grid.over(0.0, 0.0, 30.0, 50.0, 1.0, 5.0)
    cells = spark.range(300).select((F.col("id") / 30).cast("int").alias("row"), (F.col("id") % 30).cast("int").alias("col"), F.when(F.col("id") % 7 > 0, F.col("id") / 4).alias("value"))
    rasters.write_tiff(cells, g, str(tmp_path / "t"), rows_a_file=3)
    info = {r["file"]: r for r in rasters.tiff_info(spark, str(tmp_path / "t")).collect()}
    assert sorted(r["height"] for r in info.values()) == [g.rows - 9, 3, 3, 3] and max(r["north"] for r in info.values()) == g.north
    got = {(r["row"] + round((g.north - info[r["file"]]["north"]) / 5), r["col"]): r["value"] for r in rasters.read_tiff(spark, str(tmp_path / "t")).collect()}
    assert {k: v for k, v in got.items() if k[0] < 10 and k[1] < 30} == {(k // 30, k % 30): (k / 4 if k % 7 else None) for k in range(300)}
    assert all(v is None for k, v in got.items() if k[0] >= 10 or k[1] >= 30)


def test_a_box_opens_its_tiles_alone(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.uniform(-40, 100), rng.uniform(0, 100)) for k in range(2000)] + [(k, 5.0, 5.0) for k in range(2000, 3000)] + [(3000, None, 1.0)]
    path = str(tmp_path / "tiles")
    assert not tiles.has_tiles(spark, path)
    tiles.write_tiles(spark.createDataFrame(rows, "id long, x double, y double"), path, 10.0)
    assert tiles.has_tiles(spark, path)
    box = (-12.0, 3.0, 20.0, 27.5)
    found = tiles.read_box(spark, path, 10.0, box)
    assert {r["id"] for r in found.collect()} == {k for k, x, y in rows if x is not None and box[0] <= x <= box[2] and box[1] <= y <= box[3]}
    assert len(found.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(tile_x" in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).replace("\n", " ")
    assert tiles.tile_index(spark, path).agg(F.sum("n")).head()[0] == 3001


def test_depth_consensus_against_numpy(spark):
    rng = random.Random(3)
    rows = [(i, r, c, rng.choice([None, float("nan"), 10 + rng.random() * 0.3, 12.0])) for i in range(3) for r in range(6) for c in range(6) for _ in range(rng.randint(1, 6))]
    got = {(r["image_id"], r["row"], r["col"]): (r["depth"], r["agree"]) for r in volumes.depth_consensus(spark.createDataFrame(rows, "image_id int, row int, col int, depth double"), 0.02).collect()}
    want = {}
    for key in {r[:3] for r in rows}:
        have = np.array([r[3] for r in rows if r[:3] == key and r[3] is not None and not math.isnan(r[3])])
        if len(have) and len(near := have[np.abs(have - np.median(have)) <= 0.02 * np.median(have)]):
            want[key] = (near.mean(), len(near))
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)


def test_fused_distances_are_the_running_mean(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(5), rng.choice([None, float("nan"), rng.uniform(-3, 3)]), rng.randrange(255)) for _ in range(200)]
    got = {r["voxel"]: r for r in volumes.fuse_distances(spark.createDataFrame(rows, "voxel int, sdf double, red int"), 1.5, ["red"]).collect()}
    for v in range(5):
        value = weight = 0.0
        for _, sdf, _ in (r for r in rows if r[0] == v):
            if sdf is not None and sdf > -1.5:
                value, weight = (value * weight + min(1, max(-1, sdf / 1.5))) / (weight + 1), weight + 1
        assert got[v]["value"] == pytest.approx(value) and got[v]["weight"] == weight


def test_redundancy_numbers_against_the_hat_matrix(spark):
    rng = np.random.default_rng(5)
    x = np.c_[np.ones(30), rng.normal(size=(30, 2))]
    y = x @ [1, 2, 3] + rng.normal(size=30)
    df = spark.createDataFrame([(k, *map(float, x[k, 1:]), float(y[k])) for k in range(30)], "k int, a double, b double, y double")
    terms = [F.lit(1.0), F.col("a"), F.col("b")]
    got = np.array([[r["residual"], r["redundancy"], r["w"]] for r in fits.checked(df, terms, F.col("y")).orderBy("k").collect()])
    hat = x @ np.linalg.inv(x.T @ x) @ x.T
    v = y - hat @ y
    s0 = math.sqrt(v @ v / 27)
    assert np.allclose(got, np.c_[v, 1 - np.diag(hat), v / (s0 * np.sqrt(1 - np.diag(hat)))])
    p = fits.precision(df, terms, F.col("y"))
    assert p["redundancy"] == 27 and np.allclose(p["covariance"], s0**2 * np.linalg.inv(x.T @ x)) and got[:, 1].sum() == pytest.approx(27)


def test_mutual_matches_in_parts_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(int(k), [float(v) for v in rng.integers(0, 4, 3)], int(k % 3)) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, block int")
    left, right = df.filter("id < 60"), df.filter("id >= 50 and block < 2")
    got = {(r["a"], r["b"]) for r in neighbours.ratio_match(left, right, 0.9).collect()}
    want = set()
    for block in range(2):
        a = [(i, np.array(v)) for i, v, b in rows if b == block and i < 60]
        c = [(i, np.array(v)) for i, v, b in rows if b == block and i >= 50]
        far = {(i, j): float(((v - w) ** 2).sum()) for i, v in a for j, w in c}
        for i, _ in a:
            order = sorted((far[i, j], j) for j, _ in c)
            j = order[0][1]
            if math.sqrt(order[0][0]) < 0.9 * math.sqrt(order[1][0]) and min((far[k, j], k) for k, _ in a)[1] == i:
                want.add((i, j))
    assert got == want


def test_contour_lines_of_two_hills_and_an_open_slope(spark):
    from strataspark.plans import terrain

    hill = lambda r, c: max(10 - math.hypot(r - 10, c - 10), 10 - math.hypot(r - 10, c - 32), 0.0)
    df = spark.createDataFrame([(r, c, float(hill(r, c))) for r in range(21) for c in range(43)], "row int, col int, value double")
    rings = terrain.contour_rings(terrain.contour_segments(df, 4.0)).collect()
    assert sorted((r["level"], r["closed"]) for r in rings) == [(4.0, True), (4.0, True), (8.0, True), (8.0, True)]
    for r in rings:
        assert r["length"] == pytest.approx(2 * math.pi * (10 - r["level"]), rel=0.05)
    slope = spark.createDataFrame([(r, c, r + 0.25) for r in range(4) for c in range(6)] + [(4, c, None) for c in range(6)], "row int, col int, value double")
    lines = terrain.contour_rings(terrain.contour_segments(slope, 2.0)).collect()
    assert [(r["level"], r["segments"], r["length"], r["closed"]) for r in lines] == [(2.0, 5, 5.0, False)]
    saddle = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.2)], "row int, col int, value double")
    found = terrain.contour_segments(saddle, 0.5).collect()
    got = sorted((r["x1"], r["y1"], r["x2"], r["y2"]) for r in found if r["level"] == 0.5)
    assert np.allclose(got, [(5 / 12, 1.0, 0.0, 0.5), (0.5, 0.0, 1.0, 5 / 12)])  # the corners under the level are cut off


def test_vectors_meet_across_shares(spark, monkeypatch):
    """Blocks dealt into shares give what brute force gives, with many equal vectors; ties go to the least id."""
    monkeypatch.setattr(neighbours, "MATCH_SHARE", 40)
    monkeypatch.setattr(neighbours, "MATCH_ROWS", 16)
    monkeypatch.setattr(neighbours, "MATCH_WIDE", 1)
    rng = np.random.default_rng(8)
    v = rng.normal(0, 1, (150, 6)).astype(np.float32)
    v[20:90] = v[20]
    rows = [(k, k % 3 == 0, v[k].tolist()) for k in rng.permutation(150).tolist()]
    df = spark.createDataFrame(rows, "id long, block boolean, vector array<float>")
    d2 = ((v[:, None] - v[None]).astype(float) ** 2).sum(2)
    same = np.equal.outer(np.arange(150) % 3 == 0, np.arange(150) % 3 == 0)
    far = np.where(same & ~np.eye(150, dtype=bool), d2, np.inf)
    assert {r["q"]: r["p"] for r in neighbours.nearest_vectors(df).collect()} == dict(enumerate(far.argmin(1).tolist()))
    odd = np.arange(150) % 2 == 1
    ab = np.where(same & ~odd[:, None] & odd[None], d2, np.inf)
    want = set()
    for a in np.flatnonzero(~odd).tolist():
        b, two = int(ab[a].argmin()), np.sort(ab[a])[:2]
        if ab[:, b].argmin() == a and np.sqrt(two[0]) < 0.9 * np.sqrt(two[1]):
            want.add((a, b))
    got = {(r["a"], r["b"]) for r in neighbours.ratio_match(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), 0.9).collect()}
    assert got == want and want


def test_many_small_ranges_of_points_share_tasks(spark, tmp_path):
    points = spark.range(900).selectExpr("double(id) as x", "double(id % 7) as y", "0.0 as z")
    las.write_las(points.repartition(3), str(tmp_path / "cloud"), 0.01, 50)
    read = spark.read.format("las").option("chunk", 10).option("tasks", 8)
    assert las.read_las(spark, str(tmp_path / "cloud"), 10).count() == 900
    rows = read.load(las.qualified(spark, str(tmp_path / "cloud")))
    assert rows.rdd.getNumPartitions() <= 8
    assert sorted(r["x"] for r in rows.collect()) == [float(k) for k in range(900)]
    assert rows.groupBy("file").agg(F.max("index").alias("m"), F.count_distinct("index").alias("n")).filter("m + 1 <> n").isEmpty()
