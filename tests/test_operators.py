"""Operators without SQL, on small cases with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.functions import geometry as G
from strataspark.functions import text as T
from strataspark.operators import cameras, diagnostics, features, fits, graph, grid, imports, neighbours, residuals, statistics, stencils
from strataspark.operators.ranks import global_rank
from strataspark.plans import mosaic, reports, terrain


def _cells(spark, a):
    return spark.createDataFrame([(r, c, None if math.isnan(a[r][c]) else float(a[r][c])) for r in range(len(a)) for c in range(len(a[0]))], "row int, col int, value double")


def _array(df, rows, cols, name="value"):
    out = np.full((rows, cols), np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["row"], r["col"]] = r[name]
    return out


def test_points_beyond_the_bounds_go_to_edge_cells(spark):
    g = grid.Grid.over(0, 0, 9.5, 9.5, 1.0)
    assert (g.cols, g.rows, g.north) == (10, 10, 10.0)
    p = spark.createDataFrame([(-5.0, 50.0, 1.0), (99.0, -3.0, 2.0), (0.5, 9.5, 3.0)], "x double, y double, z double")
    got = {(r["row"], r["col"]): (r["value"], r["n"]) for r in grid.grid_aggregate(p, g, "max").collect()}
    assert got == {(0, 0): (3.0, 2), (9, 9): (2.0, 1)}
    with pytest.raises(ValueError):
        grid.grid_aggregate(p, g, "mode")


def test_section_thins_evenly(spark):
    p = spark.range(1000).select(F.col("id").alias("index"), F.col("id").cast("double").alias("x"), F.lit(0.2).alias("y"), F.lit(1.0).alias("z"))
    got = grid.section(p, (0.0, 0.0), (999.0, 0.0), 1.0, 100).collect()
    along = sorted(r["along"] for r in got)
    assert len(got) == 100 and along[0] == 0 and along[-1] == 999 and max(np.diff(along)) <= 11


def test_nearest_is_exact_for_any_box(spark):
    rng = random.Random(3)
    p = [(k, rng.random() * 100, rng.random() * 5, rng.choice([0.0, 80.0])) for k in range(150)]
    df = spark.createDataFrame(p, "index long, x double, y double, z double")
    want = {}
    for k, *a in p:
        want[k] = sorted((round(math.dist(a, b), 9), j) for j, *b in p if j != k)[:5]
    for size in (1.0, 30.0):
        got = {}
        for r in neighbours.nearest(df, 5, size).collect():
            got.setdefault(r["q"], []).append((round(r["distance"], 9), r["p"]))
        assert {k: sorted(v) for k, v in got.items()} == want


def test_components_against_brute_force(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 600)] + [(700, k) for k in range(701, 900)] + [(5, 5)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: find(k) for k in root if k in got} and len(got) == len({k for e in edges if e[0] != e[1] for k in e})


def test_tracks_drop_two_features_of_one_photo(spark):
    m = spark.createDataFrame([(1, 5, 2, 6), (2, 6, 3, 7), (1, 8, 2, 9), (2, 9, 1, 10)], "photo_a int, feature_a int, photo_b int, feature_b int")
    got = sorted((r["photo"], r["feature"]) for r in graph.tracks(m).collect())
    assert got == [(1, 5), (2, 6), (3, 7)]


def test_distance_transform_and_fills(spark):
    rng = np.random.default_rng(1)
    a = np.where(rng.random((12, 15)) < 0.15, rng.integers(0, 9, (12, 15)).astype(float), np.nan)
    d2 = _array(terrain.nearest_filled(_cells(spark, a), 4), 12, 15, "d2")
    filled = np.argwhere(~np.isnan(a))
    for r in range(12):
        for c in range(15):
            best = min(int(((f - [r, c]) ** 2).sum()) for f in filled)
            assert (np.isnan(d2[r, c]) and best > 16) or d2[r, c] == best
    assert not np.isnan(_array(terrain.fill_all(_cells(spark, a)), 12, 15)).any()


def test_bare_earth_takes_a_building_off(spark):
    a = np.add.outer(np.arange(20) * 0.1, np.arange(20) * 0.05)
    b = a.copy()
    b[8:12, 8:12] += 12
    ground = _array(stencils.bare_earth(_cells(spark, b), 1.0, 15).withColumn("g", F.col("ground").cast("double")), 20, 20, "g")
    assert not ground[8:12, 8:12].any() and ground[:6].all()


def test_ground_filter_on_a_built_slope(spark):
    rng = random.Random(2)
    rows = []
    for k in range(3000):
        x, y = rng.random() * 60, rng.random() * 60
        z, truth = 0.05 * x + rng.gauss(0, 0.03), 0
        if 20 < x < 30 and 20 < y < 30:
            z, truth = z + 9, 1
        elif rng.random() < 0.01:
            z, truth = z - 6, 2
        rows.append((k, x, y, z, 7 if k == 0 else 2 if k % 50 == 1 else 1, truth))
    df = spark.createDataFrame(rows, "index long, x double, y double, z double, classification short, truth int")
    got = terrain.classify_ground(df, grid.Grid.over(0, 0, 60, 60, 1.5), window=14.0).collect()
    assert len(got) == 3000 and {r["classification"] for r in got if r["index"] == 0} == {7}
    open_ground = [r["classification"] for r in got if r["truth"] == 0 and r["index"]]
    assert np.mean([c == 2 for c in open_ground]) > 0.98
    assert not any(r["classification"] == 2 for r in got if r["truth"] == 1)
    assert np.mean([r["classification"] == 7 for r in got if r["truth"] == 2]) > 0.9


def test_profile_of_a_plane(spark):
    g = grid.Grid(0.0, 20.0, 1.0, 1.0, 20, 20)
    a = [[2 * (c + 0.5) for c in range(20)] for _ in range(20)]
    got = terrain.profile(_cells(spark, a), g, [(2.0, 10.0), (12.0, 10.0)], 11).orderBy("sample").collect()
    assert [round(r["elevation"], 6) for r in got] == [4.0 + 2 * k for k in range(11)]
    assert got[0]["gradient"] is None and round(got[5]["gradient"], 6) == 2.0


def test_orthophoto_of_a_flat_scene(spark):
    g = grid.Grid(0.0, 40.0, 1.0, 1.0, 40, 40)
    dem = grid.lattice(spark, g).withColumn("value", F.lit(0.0))
    image = grid.lattice(spark, grid.Grid(0, 0, 1, 1, 80, 80)).withColumn("value", (F.col("col") + 100 * F.col("row")).cast("double"))
    # 50 mm at 100 m over a pitch of 0.5 mm: a metre is a pixel
    got = _array(terrain.orthorectify(dem, g, image, 80, 80, 0.5, 50.0, (20.0, 20.0, 100.0, 0.0, 0.0, 0.0)), 40, 40)
    assert abs(got[0, 0] - (20.0 + 2000.0)) < 1e-6 and abs(got[39, 39] - (59.0 + 5900.0)) < 1e-6
    near = _array(terrain.orthorectify(dem, g, image, 80, 80, 0.5, 50.0, (20.0, 20.0, 100.0, 0.0, 0.0, 0.0), "nearest"), 40, 40)
    assert np.allclose(near, got)


def test_cone_volume_and_contours(spark):
    n = 101
    r = np.hypot(*np.meshgrid(np.arange(n) - 50.0, np.arange(n) - 50.0))
    cone = np.maximum(0, 10 * (1 - r / 40))
    v = statistics.volume_between(_cells(spark, cone), _cells(spark, np.zeros((n, n))), 1.0).head()
    assert abs(v["cut"] / (math.pi * 40**2 * 10 / 3) - 1) < 0.002 and v["fill"] == 0
    edges = terrain.contour_edges(_cells(spark, cone), 5.0).filter("level = 5").collect()
    away = [math.hypot(e["row"] - 50 + (0 if e["across"] else e["share"]), e["col"] - 50 + (e["share"] if e["across"] else 0)) for e in edges]
    assert abs(np.mean(away) / 20 - 1) < 0.015


def test_offsets_between_surfaces(spark):
    base = np.random.default_rng(5).random((25, 30)) * 20
    layers = [_cells(spark, base + d) for d in (0.0, 3.0, -1.0)]
    add = statistics.vertical_offsets(layers, 100)
    assert np.allclose(add - add[0], [0, -3, 1], atol=1e-9) or np.allclose(add - add[0], [0, 3, -1], atol=1e-9)


def test_mosaic_gains_and_quantiles(spark):
    base = np.random.default_rng(2).random((20, 20)) * 50 + 50
    layers = _cells(spark, base).withColumn("layer", F.lit(0)).unionByName(_cells(spark, base * 1.25).withColumn("layer", F.lit(1)))
    g = mosaic.gains(layers)
    assert abs(g[0][0] / g[1][0] - 1.25) < 1e-3 and abs(g[0][0] + g[1][0] - 2) < 1e-3
    matched = _array(mosaic.quantile_match(_cells(spark, base * 2 + 7), _cells(spark, base)), 20, 20)
    assert np.abs(matched - base).max() < 0.6


def test_residual_figures(spark):
    rows = [("gcp" if k % 2 else "tie", float(k % 7), k) for k in range(40)]
    df = spark.createDataFrame(rows, "kind string, magnitude double, id int")
    got = {r["kind"]: (r["n"], round(r["rms"], 9)) for r in residuals.residual_summary(df).collect()}
    v = np.array([r[1] for r in rows])
    assert got["all"] == (40, round(float(np.sqrt((v**2).mean())), 9)) and got["gcp"][0] == 20
    w = residuals.worst_share(df, "magnitude", ["id"]).head()
    assert (w["n"], w["rms"]) == (2, 6.0)
    biased = residuals.bias_test(spark.createDataFrame([(g, d + (5 if g else 0)) for g in (0, 1) for d in (-1.0, 0.0, 1.0, 0.0)], "g int, v double"), "g", "v")
    assert {r["g"]: r["biased"] for r in biased.collect()} == {0: False, 1: True}


def test_global_rank_over_partitions(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 5003).alias("v"))
    got = global_rank(df.repartition(7), ["v", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(5000)) and [r["v"] for r in got] == sorted(r["v"] for r in got)


def test_numbers_out_of_text(spark):
    rows = ["1 234,5", "1,234.5", "-3", "n/a", "", "abc", "7,0", None, "1e3"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(rows)], "k int, s string")
    assert [r["v"] for r in df.select("k", T.european_float(F.col("s")).alias("v")).orderBy("k").collect()] == [1234.5, None, -3.0, None, None, None, 7.0, None, 1000.0]
    df = spark.createDataFrame([(0, "f = −153,692 mm ± 0,01"), (1, "I52.O"), (2, "none")], "k int, s string")
    assert [r["v"] for r in df.select("k", T.certificate_number(F.col("s")).alias("v")).orderBy("k").collect()] == [-153.692, 152.0, None]


def _matrix(o, p, k):
    rx = np.array([[1, 0, 0], [0, math.cos(o), math.sin(o)], [0, -math.sin(o), math.cos(o)]])
    ry = np.array([[math.cos(p), 0, -math.sin(p)], [0, 1, 0], [math.sin(p), 0, math.cos(p)]])
    rz = np.array([[math.cos(k), math.sin(k), 0], [-math.sin(k), math.cos(k), 0], [0, 0, 1]])
    return rz @ ry @ rx


def test_rotation_and_quaternion(spark):
    for angles in ((0.1, -0.2, 2.5), (1.5, 0.3, -3.0), (3.0, 0.1, 0.2)):
        m = G.rotation(*[F.lit(a) for a in angles])
        row = spark.range(1).select(*[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)], *[q.alias(f"q{k}") for k, q in enumerate(G.quaternion(m))]).head()
        got = np.array([row[f"m{i}{j}"] for i in range(3) for j in range(3)]).reshape(3, 3)
        assert np.allclose(got, _matrix(*angles), atol=1e-12)
        w, x, y, z = (row[f"q{k}"] for k in range(4))
        back = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        assert np.allclose(back, got, atol=1e-12)


def test_map_projection_known_places(spark):
    x, y = cameras.to_crs(F.lit(33.0), F.lit(0.0), "UTM36N")
    r = spark.range(1).select(x.alias("x"), y.alias("y")).head()
    assert abs(r["x"] - 500_000) < 1e-6 and abs(r["y"]) < 1e-6
    # a quarter of the meridian of the ellipsoid
    x, y = G.transverse_mercator(F.lit(31.0), F.lit(90.0), 31.0)
    assert abs(spark.range(1).select(y.alias("y")).head()["y"] - 10_001_965.7293) < 1e-3


def test_fits(spark):
    marks = [(float(c), float(r), 2.0 * c - 0.5 * r + 10, 0.5 * c + 2.0 * r - 3) for c, r in ((0, 0), (100, 0), (100, 80), (0, 80))]
    df = spark.createDataFrame(marks, "col double, row double, x double, y double")
    a, rest, n = fits.affine_fit(df)
    assert np.allclose(a, [[2, -0.5, 10], [0.5, 2, -3]], atol=1e-8) and rest < 1e-5 and n == 4
    s = fits.similarity_2d(df)
    assert abs(s["scale"] - math.hypot(2, 0.5)) < 1e-9 and abs(s["tx"] - 10) < 1e-9
    table = spark.createDataFrame([(r, 1e-4 * r - 2e-7 * r**3) for r in np.linspace(10, 140, 14).tolist()], "radius_mm double, distortion_mm double")
    k, rest, _ = fits.radial_fit(table, 2)
    assert np.allclose(k, [1e-4, -2e-7], rtol=1e-6)
    src = np.random.default_rng(3).random((12, 3)) * 10
    r = _matrix(0.2, -0.1, 1.0)
    dst = 3 * src @ r.T + [5, -2, 7]
    scale, rot, shift = fits.umeyama(spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(src, dst, strict=True)], "sx double, sy double, sz double, tx double, ty double, tz double"))
    assert abs(scale - 3) < 1e-9 and np.allclose(rot, r, atol=1e-9) and np.allclose(shift, [5, -2, 7], atol=1e-8)


def test_rays_meet(spark):
    rng = random.Random(4)
    rows = []
    for k in range(5):
        p = [rng.random() * 10 for _ in range(3)]
        for _ in range(3):
            c = [rng.random() * 100 for _ in range(3)]
            rows.append((k, *c, *[a - b for a, b in zip(p, c, strict=True)], *p))
    df = spark.createDataFrame(rows, "point_id int, cx double, cy double, cz double, dx double, dy double, dz double, px double, py double, pz double")
    truth = {r[0]: r[7:] for r in rows}
    for r in fits.ray_points(df).collect():
        assert np.allclose([r["x"], r["y"], r["z"]], truth[r["point_id"]], atol=1e-6)


def _strip(rng, noise):
    exterior = {f"p{k}": np.array([200.0 * k, 5.0 * k, 1000.0, 0.01 * k, -0.01, 0.02 * k]) for k in range(3)}
    points = {f"t{k}": np.array([rng.uniform(-100, 500), rng.uniform(-200, 200), rng.uniform(0, 40)]) for k in range(40)}
    rows = []
    for i, e in exterior.items():
        for k, x in points.items():
            u, v = fits._film(x[None], e, 150.0)[0]
            if abs(u) < 60 and abs(v) < 60:
                rows.append((i, k, float(u + rng.gauss(0, noise)), float(v + rng.gauss(0, noise))))
    return exterior, points, rows


def test_resection(spark):
    rng = random.Random(1)
    exterior, points, rows = _strip(rng, 0.0)
    obs = spark.createDataFrame([(i, x, y, *map(float, points[k])) for i, k, x, y in rows] + [("few", 0.0, 0.0, 1.0, 1.0, 1.0)], "image_id string, x_mm double, y_mm double, gx double, gy double, gz double")
    for r in fits.resection(obs, 150.0).collect():
        if r["image_id"] == "few":
            assert r["X0"] is None
        else:
            assert np.allclose([r[c] for c in ("X0", "Y0", "Z0", "omega", "phi", "kappa")], exterior[r["image_id"]], atol=1e-5)


def test_block_adjustment(spark):
    rng = random.Random(6)
    exterior, points, rows = _strip(rng, 0.002)
    obs = spark.createDataFrame(rows, "image_id string, point_id string, x_mm double, y_mm double")
    control = {k: points[k] for k in list(points)[:8]}
    start = {i: e + np.array([3, -2, 4, 0.004, -0.003, 0.005]) for i, e in exterior.items()}
    first = {k: p + np.array([2.0, -1.5, 3.0]) if k not in control else p for k, p in points.items()}
    state, table, history = fits.block_adjustment(obs, start, first, control, 150.0, rounds=8, control_sigma=0.01)
    assert history[0] > 0.1 and history[-1] < 0.004
    assert all(np.linalg.norm(state[i][:3] - exterior[i][:3]) < 1.0 for i in exterior)
    assert table.count() == len({r[1] for r in rows})


def test_features_of_a_plane_and_forest(spark):
    rng = random.Random(5)
    p = [(k, rng.random() * 20, rng.random() * 20, 0.0 if k % 2 else rng.random() * 8) for k in range(300)]
    df = spark.createDataFrame([r for r in p if r[0] % 2], "index long, x double, y double, z double")
    f = features.neighbourhood_features(df, 8, 2.0).collect()
    assert max(r["scattering"] for r in f) < 1e-9 and max(r["verticality"] for r in f) < 1e-6
    rows = spark.createDataFrame([(float(k % 10), float(k % 3), int(k % 10 > 4)) for k in range(400)], "a double, b double, y int")
    model, ranked = features.train_forest(rows, "y", ["a", "b"], trees=10, depth=4)
    got = features.apply_forest(model, rows, ["a", "b"])
    assert ranked[0][0] == "a" and got.filter("predicted <> y").count() == 0 and got.filter("confidence > 0.5").count() == 400


def test_imports(spark):
    images = spark.createDataFrame([(1, "A1.tif"), (2, "a2.TIF"), (3, "x/a3.jpg")], "image_id int, name string")
    got = {r["name"]: r["image_id"] for r in imports.match_names(spark.createDataFrame([("a1.TIF",), ("A2.jpg",), ("a3",), ("zz",)], "name string"), images).collect()}
    assert got == {"a1.TIF": 1, "A2.jpg": 2, "a3": 3, "zz": None}
    old = spark.createDataFrame([(1, "a", "hand"), (2, "b", "auto")], "id int, v string, source string")
    new = spark.createDataFrame([(3, "c")], "id int, v string")
    assert sorted(r["id"] for r in imports.replace_source(old, new, "auto").collect()) == [1, 3]


def test_cameras(spark):
    photos = spark.createDataFrame([(0, "M", "A", 35.0, 52.5, 6000, 4000), (1, "M", "B", 24.0, 36.0, 6000, 4000), (2, "M", "A", 35.001, 52.5, 4000, 6000)], "index int, make string, model string, focal double, focal35 double, width int, height int")
    g = {r["index"]: r["camera"] for r in cameras.camera_groups(photos).collect()}
    assert g == {0: 0, 1: 1, 2: 0}
    u = cameras.usual_camera(cameras.camera_groups(photos)).head()
    assert (u["camera"], u["n"], u["others"]) == (0, 2, 1)
    a = cameras.attitude_from_gimbal(F.lit(90.0), F.lit(-90.0))
    r = spark.range(1).select(*[c.alias(n) for c, n in zip(a, "opk", strict=True)]).head()
    assert abs(r["o"]) < 1e-9 and abs(r["p"]) < 1e-9 and abs(abs(r["k"]) - math.pi / 2) < 1e-9
    ph = spark.createDataFrame([("a", 0.0, 0.0, 100.0, 0.0, 0.0, 0.0)], "image_id string, X0 double, Y0 double, Z0 double, omega double, phi double, kappa double")
    c = {r["corner"]: (round(r["x"], 6), round(r["y"], 6)) for r in cameras.footprint_corners(ph, 10.0, 5.0, 50.0, 0.0).collect()}
    assert c == {0: (-20.0, -10.0), 1: (20.0, -10.0), 2: (20.0, 10.0), 3: (-20.0, 10.0)}
    pts = spark.createDataFrame([("in", 5.0, 5.0, 0.0), ("out", 300.0, 0.0, 0.0)], "point_id string, x double, y double, z double")
    assert [r["point_id"] for r in cameras.transfer(ph, pts, 50.0, 10.0, 5.0).collect()] == ["in"]
    assert cameras.fitting_presets(spark.createDataFrame([(31.1, -25.0)], "lon double, lat double"))[0].startswith("Lo31")


def test_report_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("bbb", None), ("c", 22.25)], "id string, v double")
    lines = [r["line"] for r in reports.table_lines(rows, [("id", "Id", None), ("v", "Value", 2)], ["id"]).orderBy("rank").collect()]
    assert lines == [" Id Value", "---------", "  a  1.50", "bbb      ", "  c 22.25"]
    reports.write_lines(reports.table_lines(rows, [("id", "Id", None)], ["id"]), str(tmp_path / "r"))
    assert b"\r\n" in b"".join(p.read_bytes() for p in (tmp_path / "r").glob("*.txt"))


def test_diagnostics(spark):
    words = spark.createDataFrame([(1, "length", 50.0, 10.0, 90.0, 20.0), (1, "Focal", 0.0, 11.0, 40.0, 21.0), (1, "153,692", 100.0, 9.0, 140.0, 19.0), (1, "next", 0.0, 40.0, 30.0, 50.0)], "page int, text string, x0 double, y0 double, x1 double, y1 double")
    lines = diagnostics.word_rows(words)
    assert [r["line"] for r in lines.orderBy("row").collect()] == ["Focal length 153,692", "next"]
    assert diagnostics.certificate_fields(lines).head()["focal_mm"] == "153,692"
    marks = spark.createDataFrame([("a", 100.0, 0.0), ("b", -100.2, 0.0), ("c", 0.0, 100.0), ("d", 3.0, -100.0)], "slot string, x_mm double, y_mm double")
    assert [(r["a"], r["b"]) for r in diagnostics.mirror_check(marks, {"a": "b", "c": "d"}).collect()] == [("c", "d")]
    cov = np.diag([0.01, 0.01, 0.04, 0, 0, 0])
    assert abs(diagnostics.corner_uncertainty(np.array([0, 0, 1000.0, 0, 0, 0]), cov, 150.0, 75.0, 75.0, 0.0) - math.sqrt(0.02 + 0.04 * 0.5)) < 1e-6
    some = diagnostics.subsample(spark.range(1000), "id", 50).collect()
    assert some == diagnostics.subsample(spark.range(1000).repartition(9), "id", 50).collect() and len({r["id"] for r in some}) == 50


def test_headings_from_shifts(spark):
    rows = []
    for turn, (a, b, dx, dy) in {0.5: (1, 2, 100.0, 0.0), -2.0: (3, 4, 0.0, 80.0)}.items():
        # a ground vector turned into the image: things ahead move back
        u, v = math.cos(-turn) * dx - math.sin(-turn) * dy, math.sin(-turn) * dx + math.cos(-turn) * dy
        rows += [(a, b, 500.0, 500.0, 500.0 - u, 500.0 + v)] * 15
    m = spark.createDataFrame(rows, "a int, b int, col_a double, row_a double, col_b double, row_b double")
    pos = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 0.0, 1000.0), (4, 0.0, 1080.0), (5, 10.0, 1100.0)], "image_id int, x double, y double")
    got = {r["image_id"]: (round(r["kappa"], 6), r["pairs"]) for r in diagnostics.headings(m, pos).collect()}
    assert got == {1: (0.5, 1), 2: (0.5, 1), 3: (-2.0, 1), 4: (-2.0, 1), 5: (-2.0, 0)}


def test_snapshots_and_colmap_lines(spark, tmp_path):
    for ns, v in ((5, "a"), (9, "b")):
        diagnostics.save_snapshot(spark.createDataFrame([(v,)], "v string"), str(tmp_path), ns)
    assert diagnostics.read_snapshot(spark, str(tmp_path)).head()["v"] == "b" and diagnostics.read_snapshot(spark, str(tmp_path), 7).head()["v"] == "a"
    images = spark.createDataFrame([(1, "a.jpg", 1, 10.0, 20.0, 30.0, 0.0, 0.0, 0.0)], "image_id int, name string, camera_id int, X0 double, Y0 double, Z0 double, omega double, phi double, kappa double")
    line = diagnostics.colmap_images(images).head()["line"].split()
    assert line[0] == "1" and line[-1] == "a.jpg" and [float(v) for v in line[5:8]] == [-10.0, 20.0, 30.0] and abs(float(line[2])) == 1.0


def test_rational_model_there_and_back(spark):
    rng = random.Random(2)
    poly = lambda first: [first, *[rng.uniform(-1e-3, 1e-3) for _ in range(19)]]
    samp, line = poly(0.0), poly(0.0)
    samp[1], line[2] = 1.0, -1.0
    model = {"long_off": 31.0, "lat_off": -25.0, "height_off": 1000.0, "long_scale": 0.1, "lat_scale": 0.1, "height_scale": 500.0, "samp_off": 5000.0, "line_off": 4000.0, "samp_scale": 5000.0, "line_scale": 4000.0, "samp_num": samp, "samp_den": poly(1.0), "line_num": line, "line_den": poly(1.0)}
    df = spark.createDataFrame([(31.0 + rng.uniform(-0.09, 0.09), -25.0 + rng.uniform(-0.09, 0.09), rng.uniform(600, 1400)) for _ in range(20)], "lon double, lat double, h double")
    s, t = G.rpc_forward(F.col("lon"), F.col("lat"), F.col("h"), model)
    lon, lat = G.rpc_inverse(F.col("s"), F.col("l"), F.col("h"), model)
    for r in df.select("*", s.alias("s"), t.alias("l")).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-9 and abs(r["lat"] - r["lat2"]) < 1e-9


def test_pairs_of_the_neighbour_search_follow_the_points_and_not_their_density(spark, monkeypatch):
    """2,000 points in one box, 1,000 more at one place, and a few far out: exact neighbours from some hundred pairs a point."""
    rng = np.random.default_rng(4)
    xyz = np.concatenate([rng.uniform(0, 4, (2000, 3)), np.full((1000, 3), 2.0), rng.uniform(300, 900, (12, 3))])
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(xyz)], "index long, x double, y double, z double")
    made, pairs = [], neighbours._candidates
    monkeypatch.setattr(neighbours, "_candidates", lambda *a: made.append(pairs(*a)) or made[-1])
    found = {}
    for r in neighbours.nearest(df, 3, 8.0).collect():
        found.setdefault(r["q"], {})[r["rank"]] = (r["p"], r["distance"])
    for q in [*range(0, 2000, 97), 2000, 2001, 2999, *range(3000, 3012)]:
        d = np.sqrt(((xyz - xyz[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:3]
        assert [found[q][k][0] for k in (1, 2, 3)] == want.tolist()
        np.testing.assert_allclose([found[q][k][1] for k in (1, 2, 3)], d[want])
    assert len(found) == len(xyz) and sum(m.count() for m in made) < 400 * len(xyz)


def test_rational_inverse_is_no_expression_that_grows_with_its_steps(spark):
    model = {"long_off": 30.0, "long_scale": 0.25, "lat_off": -25.0, "lat_scale": 0.5, "height_off": 500.0, "height_scale": 400.0, "samp_off": 2000.0, "samp_scale": 1800.0, "line_off": 1000.0, "line_scale": 900.0}
    list_ = lambda **c: [c.get(f"c{k}", 0.0) for k in range(20)]
    model |= {"samp_num": list_(c0=0.02, c1=0.9, c5=0.05), "samp_den": list_(c0=1.0, c3=0.03), "line_num": list_(c0=0.01, c2=1.1), "line_den": list_(c0=1.0, c1=0.02)}
    g = spark.createDataFrame([(30.1, -24.9, 510.0), (29.9, -25.2, 700.0), (None, -25.0, 500.0)], "lon double, lat double, h double")
    sample, line = G.rpc_forward(F.col("lon"), F.col("lat"), F.col("h"), model)
    seen = g.select("lon", "lat", "h", sample.alias("s"), line.alias("l"))
    lon, lat = G.rpc_inverse(F.col("s"), F.col("l"), F.col("h"), model)
    out = seen.select("lon", "lat", lon.alias("a"), lat.alias("b"))
    for r in out.collect():
        if r["lon"] is None:
            assert r["a"] is None and r["b"] is None
        else:
            assert abs(r["a"] - r["lon"]) < 1e-9 and abs(r["b"] - r["lat"]) < 1e-9
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_spaced_choice_reads_groups_in_batches(spark):
    rng = np.random.default_rng(12)
    rows = [(None if k % 4 == 3 else k % 4, float(x), float(y), float(s)) for k, (x, y, s) in enumerate(rng.integers(0, 30, (400, 3)))]
    df = spark.createDataFrame(rows, "tile int, x double, y double, score double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = features.spaced(df, "tile", "score", 6.0, 9)
        got = sorted((str(r["tile"]), r["x"], r["y"], r["score"]) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for tile in (None, 0, 1, 2):
        kept = []
        for _, x, y, s in sorted((r for r in rows if r[0] == tile), key=lambda r: (-r[3], r[1], r[2])):
            if len(kept) < 9 and all(math.hypot(x - a, y - b) >= 6.0 for a, b, _ in kept):
                kept.append((x, y, s))
        want += [(str(tile), *k) for k in kept]
    assert got == sorted(want) and "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_control_at_one_place_is_met_once(spark, monkeypatch):
    made, write = {}, diagnostics.materialise
    monkeypatch.setattr(diagnostics, "materialise", lambda df, name: made.setdefault(name, write(df, name)))
    existing = spark.createDataFrame([(k, 10.0, 5.0, k % 2) for k in range(600)] + [(900, 10.5, 5.0, 7)], "point_id long, x double, y double, image_id int")
    proposals = spark.createDataFrame([(k % 3, 10.0, 5.5, float(k)) for k in range(300)] + [(0, 50.0, 5.0, 0.0), (None, 10.0, 5.0, 0.0)], "image_id int, x double, y double, z double")
    got = {(r["image_id"], r["x"], r["y"], r["z"]): r["point_id"] for r in diagnostics.accept_control(proposals, existing).collect()}
    assert len(got) == 302 and got[None, 10.0, 5.0, 0.0] is None and got[0, 50.0, 5.0, 0.0] is None
    assert all(got[k % 3, 10.0, 5.5, float(k)] == (1 if k % 3 == 0 else 0) for k in range(300))
    assert made["control-places"].count() == 3 and made["control-asked"].count() == 5


def test_frames_of_a_full_cell_meet_in_shares(spark, monkeypatch):
    monkeypatch.setattr(mosaic, "MEET", 4)
    monkeypatch.setattr(mosaic, "MEETINGS", 50)
    rng = np.random.default_rng(3)
    rows = [(k, float(x), float(y), float(x + 4), float(y + 3)) for k, (x, y) in enumerate(rng.integers(0, 12, (60, 2)))]
    df = spark.createDataFrame(rows, "layer long, west double, south double, east double, north double")
    want = {}
    for a in rows:
        for b in rows:
            wide, high = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
            if a[0] < b[0] and wide > 0 and high > 0:
                want[a[0], b[0]] = wide * high
    got = [(r["a_layer"], r["b_layer"], r["area"]) for r in mosaic.overlaps(df).collect()]
    assert len(got) == len(want) and {(a, b): v for a, b, v in got} == want
