import pytest

from tesserae.functions import shapes, sql


def test_shapes_in_sql(spark):
    assert set(sql.register(spark)) >= {"draw_line", "draw_circle", "draw_ellipse", "stamp"}
    ends = [(0, 0, 3, 9), (5, 5, 5, 5), (9, 1, 0, 4), (2, 8, 7, 0), (4, 4, -8, -8), (1, 2, 1, -7), (0, 3, 6, 3)]
    spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "k int, y1 int, x1 int, y2 int, x2 int").createOrReplaceTempView("ends")
    got = spark.sql("SELECT e.k, c.* FROM ends e, LATERAL draw_line(e.y1, e.x1, e.y2, e.x2) c ORDER BY k, i").collect()
    for k, (a, b, u, v) in enumerate(ends):
        assert [(r.y, r.x) for r in got if r.k == k] == shapes.line_points((a, b), (u, v))
    circles: dict[int, list] = {}
    for r in spark.sql("SELECT r.id, c.y, c.x FROM range(1, 30) r, LATERAL draw_circle(2, -3, int(r.id)) c").collect():
        circles.setdefault(r.id, []).append((r.y - 2, r.x + 3))
    assert all(sorted(circles[r]) == sorted(set(shapes.circle_points(r))) for r in range(1, 30))
    assert {tuple(r) for r in spark.sql("SELECT y, x FROM draw_ellipse(0, 0, 7, 4)").collect()} == set(shapes.ellipse_points(7, 4))
    assert spark.sql("SELECT * FROM draw_ellipse(NULL, 0, 7, 4)").count() == 0
    assert spark.sql("SELECT * FROM stamp(1, 1, 'SQUARE', 3)").count() == 24
    with pytest.raises(Exception, match="SQUARE or CROSS"):
        spark.sql("SELECT * FROM stamp(1, 1, 'STAR', 3)").collect()


def test_further_functions(spark):
    sql.register(spark, {"diagonal": ("n INT", "y INT, x INT", "SELECT i, i FROM explode(sequence(0, n - 1)) AS t(i)")})
    assert [tuple(r) for r in spark.sql("SELECT * FROM diagonal(3)").collect()] == [(0, 0), (1, 1), (2, 2)]


def test_default_path_is_a_setting(spark):
    from tesserae.sources import images

    with pytest.raises(ValueError, match="spark.tesserae.path"):
        images.default_path(spark)
    spark.conf.set("spark.tesserae.path", "/data/pictures")
    assert images.default_path(spark) == "/data/pictures"
    spark.conf.unset("spark.tesserae.path")


def test_colours_by_name(spark):
    from tesserae.operators import pointwise

    px = spark.createDataFrame([(1, 1, 1, 0, 0, 0.2, 0.4, 0.6)], "image_id long, h int, w int, y int, x int, r double, g double, b double")
    assert pointwise.converted(px, "rgb2gray").collect() == pointwise.rgb2gray(px).collect()
    assert pointwise.converted(px, "RGB2HSV").columns == pointwise.rgb2hsv(px).columns and len(pointwise.COLOURS) == 7
    with pytest.raises(ValueError, match="RGB2YUV"):
        pointwise.converted(px, "rgb2lab")
