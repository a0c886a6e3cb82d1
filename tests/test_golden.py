"""Small arrays with known results."""

import numpy as np
import pytest

from tesserae.functions import kernels as K
from tesserae.functions.shapes import circle_points, ellipse_points, line_points
from tesserae.operators import drawing, features, geometry, histograms, labels, metric, peaks, regions, spatial, thinning, trees, whole_image
from tesserae.operators import neighbourhood as N
from tesserae.sources import images

NINE = [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
DIAMOND = K.diamond(2)


def px(spark, a):
    a = np.atleast_2d(np.array(a, float))
    h, w = a.shape
    return spark.createDataFrame([(1, h, w, y, x, float(a[y, x])) for y in range(h) for x in range(w)], "image_id long, h int, w int, y int, x int, v double")


def arr(df, v="v"):
    rows = df.collect()
    y0, x0 = min(r.y for r in rows), min(r.x for r in rows)
    out = np.full((max(r.y for r in rows) - y0 + 1, max(r.x for r in rows) - x0 + 1), np.nan)
    for r in rows:
        out[r.y - y0, r.x - x0] = r[v]
    return out.tolist()


def test_convolutions(spark):
    assert arr(N.convolve(px(spark, NINE), K.cross(3))) == [[7, 11, 11], [17, 25, 23], [19, 29, 23]]
    assert arr(N.convolve(px(spark, NINE), K.box(3, 3), mode="valid")) == [[45]]
    assert arr(N.convolve(px(spark, [[1, 2, 3], [4, 5, 6]]), [[1, 1, 1]])) == [[3, 6, 5], [9, 15, 11]]
    with pytest.raises(RuntimeError):
        N.convolve(px(spark, NINE), K.box(3, 3), stride=2)
    with pytest.raises(ValueError):
        K.taps(K.box(2, 2))


def test_ranks(spark):
    cross = K.cross(3)
    assert arr(N.rank_filter(px(spark, NINE), cross, 1, mode="symmetric")) == [[1, 1, 2], [1, 2, 3], [4, 5, 6]]
    assert arr(N.rank_filter(px(spark, NINE), cross, 5, mode="symmetric")) == [[4, 5, 6], [7, 8, 9], [8, 9, 9]]
    assert arr(N.rank_filter(px(spark, NINE), cross, 3, mode="reflect")) == [[2, 3, 3], [5, 5, 5], [7, 7, 8]]


def test_binary_morphology(spark):
    line, ring = [[1, 1, 1]], [[1, 0, 1]]
    assert arr(N.binary_erosion(px(spark, [1, 1, 1]), line)) == [[0, 1, 0]]
    assert arr(N.binary_erosion(px(spark, [1, 1, 1]), line, border=1)) == [[1, 1, 1]]
    assert arr(N.binary_erosion(px(spark, [1, 1, 0, 1, 1]), line, border=1)) == [[1, 0, 0, 0, 1]]
    assert arr(N.binary_erosion(px(spark, [1, 1, 0, 1, 1]), ring, border=1)) == [[1, 0, 1, 0, 1]]
    assert arr(N.binary_erosion(px(spark, [1, 1, 0, 1, 1]), ring)) == [[0, 0, 1, 0, 0]]
    turned = [[0, 0, 0, 0, 0], [0, 0, 0, 1, 0], [0, 0, 1, 1, 1], [0, 0, 1, 1, 0], [0, 0, 0, 0, 0]]
    assert arr(N.binary_erosion(px(spark, DIAMOND), [[1, 1], [0, 1]], (1, 1))) == turned
    assert arr(N.binary_erosion(px(spark, DIAMOND), [[0]])) == DIAMOND
    assert arr(N.binary_erosion(px(spark, DIAMOND), iterations=-1)) == np.zeros((5, 5)).tolist()


def test_labels_and_fills(spark):
    assert arr(labels.label(px(spark, [1, 1, 1, 0, 1, 1, 1])), "label") == [[1, 1, 1, 0, 2, 2, 2]]
    assert arr(labels.label(px(spark, [1, 0, 1])), "label") == [[1, 0, 2]]
    assert arr(labels.region_fill(px(spark, [1, 0, 0, 0, 1]), (0, 2))) == [[1] * 5]
    u = [[1, 0, 1], [1, 0, 1], [1, 1, 1]]
    assert arr(labels.label(px(spark, u)), "label") == u
    ring = [[1, 1, 1], [1, 0, 1], [1, 1, 1]]
    assert arr(labels.fill_holes(px(spark, ring))) == [[1] * 3] * 3
    assert arr(labels.label(px(spark, np.zeros((2, 2)))), "label") == [[0, 0], [0, 0]]


def test_skeleton(spark):
    point = np.zeros((5, 5))
    point[2, 2] = 1
    assert arr(thinning.skeletonize(px(spark, DIAMOND))) == point.tolist()
    assert arr(thinning.skeletonize(px(spark, point))) == point.tolist()
    assert arr(thinning.skeletonize(px(spark, K.cross(5)))) == K.cross(5)


def test_area_open_by_level_sets(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 4, (9, 9)).astype(float)

    def sizes(m):
        seen, out = np.zeros(m.shape, bool), np.zeros(m.shape)
        for s in zip(*np.nonzero(m), strict=True):
            if seen[s]:
                continue
            comp, todo = [], [s]
            seen[s] = True
            while todo:
                y, x = todo.pop()
                comp.append((y, x))
                for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= q[0] < 9 and 0 <= q[1] < 9 and m[q] and not seen[q]:
                        seen[q] = True
                        todo.append(q)
            for q in comp:
                out[q] = len(comp)
        return out

    want = np.zeros(a.shape)
    for level in range(1, 4):
        want[sizes(a >= level) >= 5] = level
    assert arr(trees.area_open(px(spark, a), 5)) == want.tolist()
    again = trees.area_open(trees.area_open(px(spark, a), 5), 5)
    assert arr(again) == want.tolist()


def test_peaks_keep_their_distance(spark):
    a = np.random.default_rng(3).integers(0, 100, (20, 20))
    got = peaks.find_peaks(px(spark, a), 3, threshold=10).collect()
    assert got
    for i, p in enumerate(got):
        assert all((p.y - q.y) ** 2 + (p.x - q.x) ** 2 > 9 for q in got[:i])


def test_probabilistic_lines(spark):
    a = np.zeros((20, 20))
    a[5, 2:18] = 1
    got = whole_image.hough_probabilistic_line(px(spark, a), threshold=5, length=8, gap=1).collect()
    assert got and all(r.y1 == r.y2 == 5 for r in got)


def test_shapes():
    assert line_points((0, 0), (2, 4)) == [(0, 0), (1, 1), (1, 2), (2, 3), (2, 4)]
    for r in range(1, 30):
        assert all(abs((y * y + x * x) ** 0.5 - r) < 1 for y, x in circle_points(r))
    assert {(0, 7), (0, -7), (4, 0), (-4, 0)} <= set(ellipse_points(7, 4))


def test_lines_match_plan_time_points(spark):
    ends = [(0, 0, 3, 9), (5, 5, 5, 5), (9, 1, 0, 4), (2, 8, 7, 0)]
    got = drawing.lines(spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "k int, y1 int, x1 int, y2 int, x2 int")).orderBy("k", "i").collect()
    for i, (a, b, u, v) in enumerate(ends):
        assert [(r.y, r.x) for r in got if r.k == i] == line_points((a, b), (u, v))


def test_hull(spark):
    rng = np.random.default_rng(4)
    pts = rng.integers(0, 30, (60, 2))
    df = spark.createDataFrame([(1, int(y), int(x)) for y, x in pts], "set_id long, y int, x int")
    hull = spatial.convex_hull(df)
    assert spatial.hull_contains(hull, df).where("not inside").count() == 0
    assert {(r.y, r.x) for r in hull.collect()} <= {(y, x) for y, x in pts.tolist()}


def test_region_hulls(spark):
    u = [[1, 0, 1, 0], [1, 0, 1, 0], [1, 1, 1, 0], [0, 0, 0, 1]]
    got = {r.label: (r.area, r.area_convex, r.n_corners) for r in regions.region_hulls(labels.label(px(spark, u))).collect()}
    assert got == {1: (7, 9, 4), 2: (1, 1, 1)}


def test_knn_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(metric, "PACK", 25)
    rng = np.random.default_rng(5)
    p = rng.integers(0, 50, (80, 2)).astype(float)
    pts = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(p)], "point_id long, p array<double>")
    ask = pts.toDF("query_id", "q")
    got = {(r.query_id, r["rank"]): r.point_id for r in spatial.knn(pts, ask, 4).collect()}
    for i, q in enumerate(p):
        d = np.sqrt(((p - q) ** 2).sum(axis=1))
        assert [got[i, k + 1] for k in range(4)] == sorted(range(80), key=lambda j: (d[j], j))[:4]


def test_reflect_of_one_cell_and_constant_images(spark):
    assert arr(N.convolve(px(spark, [[5]]), K.box(3, 3), mode="reflect")) == [[45]]
    assert histograms.otsu(px(spark, [[7, 7], [7, 7]])).first().th == 7
    assert [r.cnt for r in histograms.histogram(px(spark, [[7, 7]]), 2).orderBy("bin").collect()] == [0, 2]


def test_integral_and_moments(spark):
    assert arr(features.integral_image(px(spark, NINE)))[2][2] == 45
    m = regions.moments(px(spark, NINE), 1).first()
    assert (m.m00, m.m10, m.m01) == (45, 63, 51)


def test_resize_keeps_corners(spark):
    got = np.array(arr(geometry.resize(px(spark, NINE), (5, 7), 1)))
    assert got[0, 0] == 1 and got[-1, -1] == 9 and got[0, -1] == 3
    assert geometry.times(geometry.rigid(30, (1, 2)), geometry.inverse(geometry.rigid(30, (1, 2))))[0][0] == pytest.approx(1)


def test_png_round_trip(spark, tmp_path):
    saved = images.save_images(px(spark, NINE), str(tmp_path)).collect()
    assert saved[0].path.endswith("1.png")
    (tmp_path / "no_extension").write_bytes(b"x")
    assert [r.name for r in images.catalogue(spark, str(tmp_path)).collect()] == ["1"]
    back = images.load_images(spark, str(tmp_path / "*.png"))
    assert arr(back, "g") == NINE


def test_registries():
    histograms.register("HALF", lambda p: p, registry := dict(histograms.THRESHOLDS))
    assert "HALF" in registry
    with pytest.raises(ValueError):
        histograms.register("OTSU", lambda p: p)


def test_stream_of_files_and_windows(spark, tmp_path):
    from tesserae.streaming.frames import arriving_files, windowed

    images.save_images(px(spark, NINE), str(tmp_path)).collect()
    q = arriving_files(spark, str(tmp_path)).select("path", "length").writeStream.format("memory").queryName("files").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT * FROM files").count() == 1
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = windowed(events).writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT sum(n) FROM sums").first()[0] == 1000


def test_line_segments_bridge_holes_of_gap_cells_and_no_more():
    import numpy as np

    from tesserae.operators import whole_image as W

    theta = W.default_angles()
    for gap in (0, 1, 3):
        for hole in (0, gap, gap + 1):
            a = np.zeros((20, 40))
            a[7, 2:15] = a[7, 15 + hole : 30] = 1
            ends = sorted(tuple(sorted(((y1, x1), (y2, x2)))) for y1, x1, y2, x2 in W.line_segments(a, theta, 3, 8, gap))
            want = [((7, 2), (7, 29))] if hole <= gap else [((7, 2), (7, 14)), ((7, 15 + hole), (7, 29))]
            assert ends == want, (gap, hole, ends)
    a = np.zeros((30, 30))
    a[np.arange(4, 25), np.arange(4, 25)] = 1
    assert [tuple(sorted(((s[0], s[1]), (s[2], s[3])))) for s in W.line_segments(a, theta, 3, 8, 0)] == [((4, 4), (24, 24))]
