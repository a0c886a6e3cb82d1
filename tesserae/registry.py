"""All queries over the driver's tables by name, and the SQL that another engine checks them with."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels as K
from .functions import sql
from .functions.borders import MODES
from .functions.shapes import circle_points, ellipse_points
from .operators import drawing, features, geometry, histograms, labels, peaks, pointwise, reach, regions, spatial, thinning, trees, volumes, whole_image
from .operators import neighbourhood as N
from .plans import gather_sql as G
from .plans import rasters as R
from .plans.frames import cast_to, grid, images_of, shown
from .streaming.frames import windowed

Query = Callable[[SparkSession, str], DataFrame]
c = F.col
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def add(name: str, run: Query, sql: str | None = None) -> None:
    """Registers a query; names are taken once."""
    if name in _queries:
        raise ValueError(f"{name} is taken")
    _queries[name] = run
    if sql:
        _sql[name] = sql


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _plain(px: DataFrame) -> DataFrame:
    return px.select("image_id", "y", "x", shown("v").alias("v"))


def pixels(name: str, op: Callable[[DataFrame], DataFrame], sql: str | None, source=R.gray) -> None:
    """A query of pixels (image_id, y, x, v) from an operator on the raster."""
    add(name, lambda s, d: _plain(op(source(s, d))), G.shown(sql) if sql else None)


CROSS, BOX3, BOX5, RING = K.default_element(1), K.box(3, 3), K.box(5, 5), K.default_element(2, hole=True)
SHARP = [[0.0, -1.0, 0.0], [-1.0, 5.0, -2.0], [0.0, 0.5, 1.0]]
CORNER = [[1.0, 1.0], [0.0, 1.0]]

# Colour.

_UNIT = f"SELECT image_id, h, w, y, x, r / 255 AS r, g / 255 AS g, b / 255 AS b FROM ({R.RGB})"


def _unit(s: SparkSession, d: str) -> DataFrame:
    return pointwise.scaled(R.rgb(s, d), 1 / 255)


def _cols(names: str) -> list:
    return ["image_id", "y", "x", *(shown(n, 9).alias(n) for n in names.split())]


def _sel(names: str, sql: str) -> str:
    return f"SELECT image_id, y, x, {', '.join(f'round({n}, 9) + 0.0 AS {n}' for n in names.split())} FROM ({sql})"


_YUV = "SELECT image_id, y, x, 0.299 * r + 0.578 * g + 0.114 * b AS yy, -0.147 * r - 0.289 * g + 0.436 * b + 0.5 AS u, 0.615 * r - 0.515 * g - 0.1 * b + 0.5 AS vv FROM (" + _UNIT + ")"
_HSV = (
    "SELECT *, CASE WHEN dl = 0 THEN 0 ELSE hh - floor(hh) END AS hue, CASE WHEN dl = 0 THEN 0 ELSE dl / val END AS sat FROM (SELECT *, "
    "CASE WHEN b = val THEN 4 + (r - g) / dl WHEN g = val THEN 2 + (b - r) / dl ELSE (g - b) / dl END / 6 AS hh FROM (SELECT *, greatest(r, g, b) AS val, greatest(r, g, b) - least(r, g, b) AS dl FROM (" + _UNIT + ")))"
)
_RGB2 = (
    "SELECT image_id, y, x, [val, q, p, p, t, val][k] AS r, [t, val, val, q, p, p][k] AS g, [p, p, t, val, val, q][k] AS b FROM (SELECT *, val * (1 - sat) AS p, "
    "val * (1 - (hue * 6 - floor(hue * 6)) * sat) AS q, val * (1 - (1 - hue * 6 + floor(hue * 6)) * sat) AS t, (floor(hue * 6)::INT % 6) + 1 AS k FROM (" + _HSV + "))"
)
pixels("color_rgb2gray", pointwise.rgb2gray, f"SELECT *, 0.2989 * r + 0.5870 * g + 0.1140 * b AS v FROM ({R.RGB})", R.rgb)
add("color_gray2rgb", lambda s, d: pointwise.gray2rgb(R.gray(s, d)).select("image_id", "y", "x", "r", "g", "b"), f"SELECT image_id, y, x, v AS r, v AS g, v AS b FROM ({R.GRAY})")
add("color_gray2rgba", lambda s, d: pointwise.gray2rgba(R.gray(s, d)).select("image_id", "y", "x", "r", "g", "b", "a"), f"SELECT image_id, y, x, v AS r, v AS g, v AS b, 255.0::DOUBLE AS a FROM ({R.GRAY})")
add("color_rgb2yuv", lambda s, d: pointwise.rgb2yuv(_unit(s, d)).select(*_cols("yy u vv")), _sel("yy u vv", _YUV))
add("color_yuv2rgb", lambda s, d: pointwise.yuv2rgb(pointwise.rgb2yuv(_unit(s, d))).select(*_cols("r g b")), _sel("r g b", f"SELECT image_id, y, x, yy + 1.14 * (vv - 0.5) AS r, yy - 0.395 * (u - 0.5) - 0.581 * (vv - 0.5) AS g, yy + 2.032 * (u - 0.5) AS b FROM ({_YUV})"))
add("color_rgb2hsv", lambda s, d: pointwise.rgb2hsv(_unit(s, d)).select(*_cols("hue sat val")), _sel("hue sat val", _HSV))
add("color_hsv2rgb", lambda s, d: pointwise.hsv2rgb(pointwise.rgb2hsv(_unit(s, d))).select(*_cols("r g b")), _sel("r g b", _RGB2))

# Intensity.

_ENDS = "SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM ({})"
_T = f"SELECT *, (v - lo) / (hi - lo) AS t FROM ({_ENDS.format(R.GRAY)})"


def _curve(expr: str) -> str:
    return f"SELECT image_id, y, x, floor(round((k - min(k) OVER w2) * ((hi - lo) / (max(k) OVER w2 - min(k) OVER w2)) + lo, 9)) AS v FROM (SELECT *, {expr} AS k FROM ({_T})) WINDOW w2 AS (PARTITION BY image_id)"


pixels("adj_gamma", lambda p: pointwise.adjust_gamma(p, 0.7, 1.1), f"SELECT *  REPLACE (floor(least(255 * 1.1 * pow(v / 255, 0.7), 255)) AS v) FROM ({R.GRAY})")
pixels("adj_gamma_float", lambda p: pointwise.adjust_gamma(p, 1.5, 0.9, "float64"), f"SELECT image_id, y, x, 0.9 * pow(t, 1.5) AS v FROM ({_T})")
pixels("adj_log", pointwise.adjust_log, _curve("log2(t + 1)"))
pixels("adj_exp", pointwise.adjust_exp, _curve("exp(t) - 1"))
pixels("adj_linear", lambda p: pointwise.adjust_linear(p, (10, 200), (20, 180)), f"SELECT * REPLACE ((least(greatest(v, 20), 180) - 20) * (190.0 / 160) + 10 AS v) FROM ({R.GRAY})")
pixels("adj_linear_image", pointwise.adjust_linear, f"SELECT image_id, y, x, t * 255 AS v FROM ({_T})")
pixels("invert", pointwise.invert, f"SELECT * REPLACE (255 - v AS v) FROM ({R.GRAY})")
pixels("quantise_sqr", pointwise.quantise, f"SELECT * REPLACE (floor(sqrt(v)) AS v) FROM ({R.GRAY})")
pixels("quantise_log", lambda p: pointwise.quantise(p, "log"), f"SELECT * REPLACE (CASE WHEN v > 0 THEN floor(log2(v)) ELSE 0 END AS v) FROM ({R.GRAY})")
pixels("quantise_linear", lambda p: pointwise.quantise(p, "linear"), f"SELECT * REPLACE (CASE WHEN v = 0 THEN 0 ELSE floor(v / 16) + 1 END AS v) FROM ({R.GRAY})")
pixels("binarize", lambda p: pointwise.binarize(p, 100), f"SELECT * REPLACE ((v > 100)::INT::DOUBLE AS v) FROM ({R.GRAY})")
pixels("check_finite", pointwise.checked, R.GRAY)
pixels("cast_uint8", lambda p: p.withColumn("v", cast_to(c("v") * 1.5 - 60, "uint8")), f"SELECT * REPLACE (least(greatest(round(v * 1.5 - 60), 0), 255) AS v) FROM ({R.GRAY})")
for _mode in MODES[2:]:
    pixels(f"pad_{_mode}", lambda p, m=_mode: N.pad(p, 2, 3, 4, 1, m), f"SELECT g.image_id, g.y, g.x, s.v FROM (SELECT i.i::BIGINT AS image_id, y.y::INT AS y, x.x::INT AS x FROM range(4) i(i), range(-2, 35) y(y), range(-4, 33) x(x)) g JOIN ({R.GRAY}) s ON s.image_id = g.image_id AND s.y = {G.fit_sql('g.y', '32', _mode)} AND s.x = {G.fit_sql('g.x', '32', _mode)}")

pixels("border_mask", lambda p: N.border_mask(p, 5, 3), f"SELECT * REPLACE ((y < 2 OR y >= h - 2 OR x < 1 OR x >= w - 1)::INT::DOUBLE AS v) FROM ({R.GRAY})")

# Histograms and thresholds.


def _hist(rows: DataFrame) -> DataFrame:
    return rows.select("image_id", shown("bin").alias("bin"), "cnt")


_H = f"SELECT image_id, round(bin, 6) + 0.0 AS bin, cnt FROM ({{}})"
_WIDE = (
    "SELECT e.image_id, e.lo + (k.k + 0.5) * (e.hi - e.lo) / {n} AS bin, coalesce(q.cnt, 0)::BIGINT AS cnt FROM (SELECT image_id, min(v) AS lo, max(v) AS hi FROM ({px}) GROUP BY 1) e CROSS JOIN range({n}) k(k) "
    "LEFT JOIN (SELECT image_id, least(floor((v - lo) * {n} / (hi - lo)), {n} - 1) AS k, count(*) AS cnt FROM ({ends}) GROUP BY ALL) q ON q.image_id = e.image_id AND q.k = k.k"
)
_EDGES = [0, 10, 50, 100, 180, 255]
add("hist_bincount", lambda s, d: _hist(histograms.bin_count(R.gray(s, d))), _H.format(G.counts(R.GRAY)))
add("hist_equal_width", lambda s, d: _hist(histograms.histogram(R.gray(s, d), 10)), _H.format(_WIDE.format(n=10, px=R.GRAY, ends=_ENDS.format(R.GRAY))))
add(
    "hist_edges",
    lambda s, d: _hist(histograms.histogram(R.gray(s, d), _EDGES)),
    "SELECT i.i::BIGINT AS image_id, (e.lo + e.hi) / 2.0 AS bin, count(p.v) AS cnt FROM range(4) i(i) CROSS JOIN (VALUES " + ", ".join(f"({a}, {b})" for a, b in zip(_EDGES, _EDGES[1:], strict=False)) + f") e(lo, hi) LEFT JOIN ({R.GRAY}) p ON p.image_id = i.i AND p.v >= e.lo AND (p.v < e.hi OR (p.v = 255 AND e.hi = 255)) GROUP BY ALL",
)
add("hist_normalised", lambda s, d: histograms.normalised(histograms.bin_count(R.gray(s, d))).select("image_id", "bin", shown("p").alias("p")), f"SELECT image_id, bin, round(cnt / sum(cnt) OVER (PARTITION BY image_id), 6) + 0.0 AS p FROM ({G.counts(R.GRAY)})")
_CDF = f"SELECT *, sum(cnt) OVER (PARTITION BY image_id ORDER BY bin) / sum(cnt) OVER (PARTITION BY image_id) AS f FROM ({{}})"
add("hist_cdf", lambda s, d: histograms.cdf(histograms.bin_count(R.gray(s, d))).select("image_id", "bin", shown("cdf").alias("cdf")), f"SELECT image_id, bin, round(f, 6) + 0.0 AS cdf FROM ({_CDF.format(G.counts(R.GRAY))})")


def _interp(q: str, n: str) -> str:
    """Queries (image_id, xn) through nodes (image_id, xp, fp): f."""
    return (
        f"SELECT q.image_id, q.xn, CASE WHEN a.xp IS NULL THEN b.fp WHEN b.xp IS NULL OR a.xp = q.xn THEN a.fp ELSE a.fp + (b.fp - a.fp) * (q.xn - a.xp) / (b.xp - a.xp) END AS f FROM ({q}) q "
        f"ASOF LEFT JOIN ({n}) a ON a.image_id = q.image_id AND a.xp <= q.xn ASOF LEFT JOIN ({n}) b ON b.image_id = q.image_id AND b.xp >= q.xn"
    )


_NODES = f"SELECT image_id, bin AS xp, f AS fp FROM ({_CDF.format(_WIDE.format(n=256, px=R.GRAY, ends=_ENDS.format(R.GRAY)))})"
pixels("hist_equalize", histograms.equalise, f"SELECT p.image_id, p.y, p.x, round(m.f * 255) AS v FROM ({R.GRAY}) p JOIN ({_interp(f'SELECT DISTINCT image_id, v AS xn FROM ({R.GRAY})', _NODES)}) m ON m.image_id = p.image_id AND m.xn = p.v")


def _interp_query(s: SparkSession, d: str) -> DataFrame:
    nodes = histograms.cdf(histograms.histogram(R.gray(s, d), 16)).select("image_id", c("bin").alias("xp"), c("cdf").alias("fp"))
    asked = R.gray(s, d).select("image_id", c("v").alias("xn"), "y", "x")
    return histograms.interpolated(asked, nodes, ["image_id"]).select("image_id", "y", "x", "xn", shown("f").alias("f"))


add("interp_linear", _interp_query, f"SELECT p.image_id, p.y, p.x, p.v AS xn, round(m.f, 6) + 0.0 AS f FROM ({R.GRAY}) p JOIN ({_interp(f'SELECT DISTINCT image_id, v AS xn FROM ({R.GRAY})', f'SELECT image_id, bin AS xp, f AS fp FROM ({_CDF.format(_WIDE.format(n=16, px=R.GRAY, ends=_ENDS.format(R.GRAY)))})')}) m ON m.image_id = p.image_id AND m.xn = p.v")


def _threshold(name: str, run, sql: str | None) -> None:
    add(name, lambda s, d: run(R.gray(s, d)).select("image_id", shown("th").alias("th")), f"SELECT image_id, round(th, 6) + 0.0 AS th FROM ({sql})" if sql else None)


_S = G.sums(R.GRAY)
_P = f"SELECT *, sum(p) OVER u AS p1, sum(p) OVER dn AS p2, sum(e) OVER u AS e1, sum(e) OVER (PARTITION BY image_id) AS al FROM (SELECT image_id, bin, cnt / n AS p, CASE WHEN cnt > 0 THEN cnt / n * ln(cnt / n) ELSE 0 END AS e FROM ({_S})) WINDOW u AS (PARTITION BY image_id ORDER BY bin), dn AS (PARTITION BY image_id ORDER BY bin DESC)"
_ONE = "CASE WHEN {0} = 0 THEN 1 ELSE {0} END"
_V = f"SELECT image_id, bin, n1, n2, {_ONE.format('s1')} AS s1, {_ONE.format('s2')} AS s2 FROM (SELECT *, sqrt(sum(pow(bin - m1, 2)) OVER u / n1) AS s1, sqrt(sum(pow(bin - m2, 2)) OVER dn / n2) AS s2 FROM ({_S}) WINDOW u AS (PARTITION BY image_id ORDER BY bin), dn AS (PARTITION BY image_id ORDER BY bin DESC))"
_LN = "CASE WHEN {0} = 0 THEN 0 ELSE ln({0}) END"
_threshold("thr_otsu", histograms.otsu, G.otsu(R.GRAY))
_threshold("thr_li_lee", histograms.li_and_lee, G.best(f"SELECT image_id, bin, n1 * m1 * {_LN.format('m1')} AS a, n2 * m2 * {_LN.format('m2')} AS b FROM ({_S})", "a + lead(b) @lead", 1))
_threshold("thr_kapur", histograms.kapur, G.best(_P, "-(e1 / p1) + ln(p1) - (al - e1) / p2 + ln(p2)"))
_threshold("thr_min_error", histograms.minimum_error, G.best(_V, "1 + 2 * (lead(n1) @lead * ln(lead(s1) @lead / s2) + n2 * ln(s2 / lead(s1) @lead))", 1, True))
_threshold("thr_mean", histograms.mean_threshold, f"SELECT image_id, avg(v) AS th FROM ({R.GRAY}) GROUP BY 1")
_threshold("thr_minimum", histograms.minimum, G.valley(R.GRAY))
pixels("threshold_otsu", lambda p: histograms.threshold(p, "otsu"), f"SELECT p.image_id, p.y, p.x, (p.v > t.th)::INT::DOUBLE AS v FROM ({R.GRAY}) p JOIN ({G.otsu(R.GRAY)}) t USING (image_id)")

# Filters.

for _mode in MODES:
    pixels(f"flt_convolve_{_mode}", lambda p, m=_mode: N.convolve(p, SHARP, mode=m, value=7.0 if m == "constant" else 0.0), G.convolved(R.GRAY, SHARP, _mode, 7.0 if _mode == "constant" else 0.0))
pixels("flt_convolve_anchor", lambda p: N.convolve(p, CORNER, (1, 1)), G.convolved(R.GRAY, CORNER, anchor=(1, 1)))
pixels("flt_convolve_dilated", lambda p: N.convolve(p, BOX3, dilation=2), G.gather(R.GRAY, K.taps(BOX3, dilation=2), "sum(@w * @v) AS v"))
pixels("flt_gaussian", lambda p: N.gaussian_filter(p, 1.2), G.blurred(R.GRAY, 1.2))
_MEAN = [[w / 25 for w in r] for r in BOX5]
pixels("flt_mean", lambda p: N.mean_filter(p, BOX5), G.convolved(R.GRAY, _MEAN))
pixels("flt_variance", lambda p: N.variance_filter(p, BOX5, "symmetric"), G.gather(R.GRAY, K.taps(_MEAN), "sum(@w * @v * @v) - pow(sum(@w * @v), 2) AS v", "symmetric"))
pixels("flt_median_15", lambda p: N.median_filter(p, K.box(15, 15), "reflect"), G.ranked(R.GRAY, K.box(15, 15), 112, "reflect"))
pixels("flt_mean_15", lambda p: N.mean_filter(p, K.box(15, 15), "edge"), G.convolved(R.GRAY, [[w / 225 for w in r] for r in K.box(15, 15)], "edge"))
pixels("flt_median", lambda p: N.median_filter(p, BOX3, "reflect"), G.ranked(R.GRAY, BOX3, 4, "reflect"))
pixels("flt_rank", lambda p: N.rank_filter(p, CROSS, 2, mode="symmetric"), G.ranked(R.GRAY, CROSS, 2, "symmetric"))
pixels("flt_local_min", lambda p: N.local_min_filter(p, BOX3), G.gather(R.GRAY, K.taps(BOX3), "min(@v) AS v", "reflect"))
pixels("flt_local_max", lambda p: N.local_max_filter(p, BOX5), G.gather(R.GRAY, K.taps(BOX5), "max(@v) AS v", "reflect"))
for _how, _t in (("gaussian", G.blurred(R.GRAY, 4 / 6, radius=2)), ("mean", G.convolved(R.GRAY, _MEAN, "reflect")), ("median", G.ranked(R.GRAY, BOX5, 12, "reflect"))):
    pixels(f"thr_adaptive_{_how}", lambda p, m=_how: N.adaptive_threshold(p, 5, m, 2.0).withColumnRenamed("th", "v"), f"SELECT image_id, y, x, v - 2.0 AS v FROM ({_t})")

# Edges and corners.

_RMS = "SELECT image_id, y, x, sqrt((gy * gy + gx * gx) / 2) AS v FROM ({})"
pixels("edge_sobel", N.sobel, _RMS.format(G.gradients(R.GRAY)))
pixels("edge_prewitt", N.prewitt, _RMS.format(G.gradients(R.GRAY, "prewitt")))
pixels("edge_sobel_axis", lambda p: N.sobel(p, axis=0, mode="wrap"), f"SELECT image_id, y, x, gy AS v FROM ({G.gradients(R.GRAY, 'sobel', 'wrap')})")
_UNITPX = f"SELECT * REPLACE (v / 255 AS v) FROM ({R.GRAY})"
_GRAD = G.gradients(R.GRAY, normalise=False)
_NINE = ", ".join(f"max(CASE WHEN k.dy = {a} AND k.dx = {b} THEN coalesce(s.v, 0) END) AS m{(a + 1) * 3 + b + 1}" for a in (-1, 0, 1) for b in (-1, 0, 1))


def _nms(grad: str) -> str:
    mag = f"SELECT image_id, h, w, y, x, sqrt(gy * gy + gx * gx) AS v FROM ({grad})"
    wide = G.gather(mag, [(a, b, 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1)], _NINE)
    rows = f"SELECT n.*, gy, gx, (gy >= 0 AND gx >= 0) OR (gy <= 0 AND gx <= 0) AS dg, CASE WHEN abs(gy) > abs(gx) THEN abs(gx) / abs(gy) WHEN abs(gx) > 0 THEN abs(gy) / abs(gx) END AS d FROM ({wide}) n JOIN ({grad}) USING (image_id, y, x)"
    first = "CASE WHEN dg AND abs(gx) > abs(gy) THEN m7 * d + m8 * (1 - d) WHEN dg THEN m5 * d + m8 * (1 - d) WHEN abs(gy) < abs(gx) THEN m7 * d + m6 * (1 - d) ELSE m3 * d + m6 * (1 - d) END"
    other = "CASE WHEN dg AND abs(gx) > abs(gy) THEN m0 * d + m1 * (1 - d) WHEN dg THEN m0 * d + m3 * (1 - d) WHEN abs(gy) < abs(gx) THEN m2 * d + m1 * (1 - d) ELSE m2 * d + m5 * (1 - d) END"
    return f"SELECT image_id, h, w, y, x, m4 AS mag, coalesce(y BETWEEN 1 AND h - 2 AND x BETWEEN 1 AND w - 2 AND m4 + 1e-9 >= {first} AND m4 + 1e-9 >= {other}, false)::INT::DOUBLE AS v FROM ({rows})"


def _edge_nms(s: SparkSession, d: str) -> DataFrame:
    g = N.gradients(R.gray(s, d), normalise=False).withColumn("mag", F.sqrt(c("gy") * c("gy") + c("gx") * c("gx")))
    return _plain(N.canny_suppression(g, 0.0))


add("edge_nms", _edge_nms, G.shown(_nms(_GRAD)))
_INNER = "(y BETWEEN 1 AND h - 2 AND x BETWEEN 1 AND w - 2)::INT::DOUBLE"
_GK = K.gaussian(1.0, radius=2)
_BLUR = G.minus(G.convolved(_UNITPX, _GK), G.convolved(f"SELECT * REPLACE ({_INNER} AS v) FROM ({_UNITPX})", _GK), f"a.v / (b.v + {K.EPSILON!r})")
_THIN = f"SELECT * REPLACE ((v > 0 AND y BETWEEN 3 AND h - 4 AND x BETWEEN 3 AND w - 4 AND mag >= 0.1)::INT::DOUBLE AS v) FROM ({_nms(G.gradients(_BLUR, normalise=False))})"
_SHAPE = "(y + x < 46 AND (y - 12) * (y - 12) + (x - 14) * (x - 14) > 3)"
_HELD = f"SELECT * REPLACE ({_SHAPE}::INT::DOUBLE AS v) FROM ({R.GRAY})"
_WEIGHT = G.convolved(G.eroded(_HELD, BOX3), _GK)
_BLUR_HELD = G.minus(G.convolved(f"SELECT * REPLACE (v * {_SHAPE}::INT AS v) FROM ({_UNITPX})", _GK), _WEIGHT, f"a.v / (b.v + {K.EPSILON!r})")
_THIN_HELD = f"SELECT n.* REPLACE ((n.v > 0 AND q.v >= 1 - 1e-9 AND mag >= 0.1)::INT::DOUBLE AS v) FROM ({_nms(G.gradients(_BLUR_HELD, normalise=False))}) n JOIN ({_WEIGHT}) q USING (image_id, y, x)"
_STRONG = "SELECT image_id, y, x, coalesce(max(CASE WHEN mag >= {high} AND root IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, root) = 1 AND root IS NOT NULL, false)::INT::DOUBLE AS v FROM ({rows})"
pixels("edge_canny_masked", lambda p: labels.canny(p, high=255 * 0.8, mask=p.select("image_id", "y", "x", F.expr(_SHAPE).cast("double").alias("m"))), _STRONG.format(high=0.8, rows=G.rooted(_THIN_HELD, 2)))
pixels("edge_canny", labels.canny, f"SELECT image_id, y, x, coalesce(max(CASE WHEN mag >= 0.2 AND root IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, root) = 1 AND root IS NOT NULL, false)::INT::DOUBLE AS v FROM ({G.rooted(_THIN, 2)})")
_GRAD0 = G.gradients(R.GRAY, "sobel", "constant", False)
_TENSOR = [G.blurred(f"SELECT image_id, h, w, y, x, {e} AS v FROM ({_GRAD0})", 1.0, "constant") for e in ("gy * gy", "gy * gx", "gx * gx")]
_ST = f"SELECT a.image_id, a.y, a.x, a.v AS ayy, b.v AS axy, c.v AS axx FROM ({_TENSOR[0]}) a JOIN ({_TENSOR[1]}) b USING (image_id, y, x) JOIN ({_TENSOR[2]}) c USING (image_id, y, x)"
add("structure_tensor", lambda s, d: N.structure_tensor(R.gray(s, d)).select("image_id", "y", "x", *(shown(n, 3).alias(n) for n in ("ayy", "axy", "axx"))), f"SELECT image_id, y, x, round(ayy, 3) + 0.0 AS ayy, round(axy, 3) + 0.0 AS axy, round(axx, 3) + 0.0 AS axx FROM ({_ST})")


def _unit_gray(s: SparkSession, d: str) -> DataFrame:
    return R.gray(s, d).withColumn("v", c("v") / 255)


_UT = [G.blurred(f"SELECT image_id, h, w, y, x, {e} AS v FROM ({G.gradients(_UNITPX, 'sobel', 'constant', False)})", 1.0, "constant") for e in ("gy * gy", "gy * gx", "gx * gx")]
_UST = f"SELECT a.image_id, a.y, a.x, a.v AS ayy, b.v AS axy, c.v AS axx FROM ({_UT[0]}) a JOIN ({_UT[1]}) b USING (image_id, y, x) JOIN ({_UT[2]}) c USING (image_id, y, x)"
pixels("harris", N.harris_corner, f"SELECT image_id, y, x, axx * ayy - axy * axy - 0.05 * pow(axx + ayy, 2) AS v FROM ({_UST})", _unit_gray)
pixels("harris_nobel", lambda p: N.harris_corner(p, nobel=True), f"SELECT image_id, y, x, 2 * (axx * ayy - axy * axy) / (axx + ayy + 1e-5) AS v FROM ({_UST})", _unit_gray)

# Morphology.

pixels("morph_erode", N.binary_erosion, G.eroded(R.MASK, CROSS), R.mask)
pixels("morph_dilate", N.binary_dilation, G.dilated(R.MASK, CROSS), R.mask)
pixels("morph_erode_anchor", lambda p: N.binary_erosion(p, CORNER, (1, 1), border=1), G.eroded(R.MASK, CORNER, 1.0, (1, 1)), R.mask)
pixels("morph_dilate_twice", lambda p: N.binary_dilation(p, CROSS, iterations=2), G.dilated(G.dilated(R.MASK, CROSS), CROSS), R.mask)
pixels("morph_erode_stable", lambda p: N.binary_erosion(p, BOX3, iterations=-1), f"SELECT * REPLACE (0.0::DOUBLE AS v) FROM ({R.MASK})", R.mask)
pixels("morph_open", N.binary_opening, G.dilated(G.eroded(R.MASK, CROSS), CROSS), R.mask)
pixels("morph_close", N.binary_closing, G.eroded(G.dilated(R.MASK, CROSS), CROSS), R.mask)
_E, _D = G.eroded(R.MASK, CROSS), G.dilated(R.MASK, CROSS)
for _how, _a, _b in (("inner", R.MASK, _E), ("outer", _D, R.MASK), ("double", _D, _E)):
    pixels(f"morph_edge_{_how}", lambda p, m=_how: N.binary_edge(p, m), G.minus(_a, _b, "(a.v <> b.v)::INT::DOUBLE"), R.mask)
pixels("morph_gray_erode", lambda p: N.gray_erosion(p, BOX3), G.eroded(R.GRAY, BOX3))
pixels("morph_gray_dilate", lambda p: N.gray_dilation(p, BOX3), G.dilated(R.GRAY, BOX3))
_BUMP = [[1.0, 2.0, 1.0], [2.0, 5.0, 3.0], [1.0, 2.0, 1.0]]
pixels("morph_gray_erode_height", lambda p: N.gray_erosion(p, _BUMP, border=255.0, flat=False), G.gather(R.GRAY, K.taps(_BUMP), "min(@v - @w) AS v", "constant", 255.0))
pixels("morph_gray_dilate_height", lambda p: N.gray_dilation(p, _BUMP, flat=False), G.gather(R.GRAY, K.taps(_BUMP), "max(@v + @w) AS v"))
_OPEN, _CLOSE = G.dilated(G.eroded(R.GRAY, BOX3), BOX3), G.eroded(G.dilated(R.GRAY, BOX3), BOX3)
pixels("morph_gray_open", lambda p: N.gray_opening(p, BOX3), _OPEN)
pixels("morph_gray_close", lambda p: N.gray_closing(p, BOX3), _CLOSE)
pixels("morph_white_top", lambda p: N.white_top(p, BOX3), G.minus(R.GRAY, _OPEN))
pixels("morph_black_top", lambda p: N.black_top(p, BOX3), G.minus(_CLOSE, R.GRAY))
pixels("morph_hit_or_miss", lambda p: N.hit_or_miss(p, CROSS), G.minus(_E, G.eroded(R.MASK, [[float(not w) for w in r] for r in CROSS]), "(a.v = 1 AND b.v = 0)::INT::DOUBLE"), R.mask)


def _masked(name: str, op: Callable[[DataFrame, DataFrame], DataFrame], sql: str, source=R.mask) -> None:
    """A query of an operator under a mask: the pixels of the gray raster over 60."""
    add(name, lambda s, d: _plain(op(source(s, d), R.mask(s, d, 60).withColumnRenamed("v", "m"))), G.shown(sql))


def _under(after: str, before: str) -> str:
    return f"SELECT a.* REPLACE (CASE WHEN m.v > 60 THEN a.v ELSE b.v END AS v) FROM ({after}) a JOIN ({before}) b USING (image_id, y, x) JOIN ({R.GRAY}) m USING (image_id, y, x)"


_NONE = f"SELECT * REPLACE (0.0::DOUBLE AS v) FROM ({R.GRAY})"
_ME, _MD = _under(_E, R.MASK), _under(_D, R.MASK)
_masked("morph_erode_masked", lambda p, m: N.binary_erosion(p, mask=m), _ME)
_masked("morph_open_masked", lambda p, m: N.binary_opening(p, mask=m), _under(G.dilated(_ME, CROSS), _ME))
_masked("morph_close_masked", lambda p, m: N.binary_closing(p, mask=m), _under(G.eroded(_MD, CROSS), _MD))
_masked("morph_edge_masked", lambda p, m: N.binary_edge(p, "double", mask=m), G.minus(_MD, _ME, "(a.v <> b.v)::INT::DOUBLE"))
_MISS = [[1.0, 0.0], [0.0, 0.0]]
_masked("morph_hit_or_miss_masked", lambda p, m: N.hit_or_miss(p, CORNER, _MISS, (1, 1), miss_anchor=(0, 1), mask=m), _under(G.minus(G.eroded(R.MASK, CORNER, anchor=(1, 1)), G.eroded(R.MASK, _MISS, anchor=(0, 1)), "(a.v = 1 AND b.v = 0)::INT::DOUBLE"), _NONE))
_MGE, _MGD = _under(G.eroded(R.GRAY, BOX3), R.GRAY), _under(G.dilated(R.GRAY, BOX3), R.GRAY)
_MGO, _MGC = _under(G.dilated(_MGE, BOX3), _MGE), _under(G.eroded(_MGD, BOX3), _MGD)
_masked("morph_gray_dilate_masked", lambda p, m: N.gray_dilation(p, BOX3, mask=m), _MGD, R.gray)
_masked("morph_gray_open_masked", lambda p, m: N.gray_opening(p, BOX3, mask=m), _MGO, R.gray)
_masked("morph_white_top_masked", lambda p, m: N.white_top(p, BOX3, mask=m), G.minus(R.GRAY, _MGO), R.gray)
_masked("morph_black_top_masked", lambda p, m: N.black_top(p, BOX3, mask=m), G.minus(_MGC, R.GRAY), R.gray)
pixels("morph_skeleton", thinning.skeletonize, G.thinned(R.MASK, 64), R.mask)
pixels("morph_skeleton_dark", lambda p: thinning.skeletonize(p, 2, 8), G.thinned(f"SELECT * REPLACE ((v <= 170)::INT::DOUBLE AS v) FROM ({R.GRAY})", 64), lambda s, d: R.gray(s, d).withColumn("v", (c("v") <= 170).cast("double")))
pixels("morph_area_open", lambda p: trees.area_open(p, 8), G.tree_filtered(R.GRAY, "o.area >= 8"))
_DARK = f"SELECT * REPLACE (-v AS v) FROM ({R.GRAY})"
pixels("morph_area_close", lambda p: trees.area_close(p, 8), f"SELECT * REPLACE (0 - v AS v) FROM ({G.tree_filtered(_DARK, 'o.area >= 8')})")
_NUMBER = "(SELECT image_id, node, row_number() OVER (PARTITION BY image_id ORDER BY {0}level, node) - bool_or(parent IS NULL AND level = 0) OVER (PARTITION BY image_id)::INT AS k FROM o)"
_NUMBERED = "{0} SELECT f.image_id, f.y, f.x, k::DOUBLE AS v FROM f JOIN n ON n.image_id = f.image_id AND n.a = f.id JOIN {1} z ON z.image_id = n.image_id AND z.node = n.node"
pixels("tree_labels", trees.tree_labels, _NUMBERED.format(G.trees(R.GRAY), _NUMBER.format("")))
pixels("tree_labels_min", lambda p: trees.tree_labels(p, 2, minima=True), _NUMBERED.format(G.trees(_DARK, 2), _NUMBER.format("")))
add("tree_nodes", lambda s, d: trees.ComponentTree(R.gray(s, d), tile=8).nodes.select("image_id", "node", "level", "parent", "area"), G.trees(R.GRAY) + "SELECT image_id, node, level, parent, area FROM o")
add("tree_nodes_min", lambda s, d: trees.ComponentTree(R.gray(s, d), 2, minima=True, attributes={"mass": c("v")}, tile=8).nodes.drop("h", "w"), G.trees(_DARK, 2) + "SELECT image_id, node, 0 - level AS level, parent, area, 0 - mass AS mass FROM o")
pixels("tree_filter", lambda p: trees.ComponentTree(p, attributes={"mass": c("v")}, tile=16).filter(c("mass") >= 4000), G.tree_filtered(R.GRAY, "o.mass >= 4000"))


def _contrast(px: DataFrame) -> DataFrame:
    """Nodes stay that stand out from their parent by 12 levels: a values map that is made from the tree."""
    tree = trees.ComponentTree(px, tile=8)
    below = tree.nodes.select("image_id", c("node").alias("parent"), c("level").alias("below"))
    values = tree.nodes.join(below, ["image_id", "parent"]).select("image_id", "node", (c("level") - c("below")).alias("contrast"))
    return tree.filter(c("contrast") >= 12, values)


pixels("tree_filter_values", _contrast, G.tree_filtered(R.GRAY, "o.level - o.below >= 12"))

# Volumes.

_SPACE = volumes.Space(side=4)
_BALL = K.solid(1)
_KERNEL = [[[0.0, -1.0, 0.0], [0.5, 2.0, 0.0], [0.0, 1.0, 0.25]], [[1.0, 0.0, 0.0], [0.0, 4.0, -2.0], [0.0, 0.0, 1.0]], [[0.0, 0.0, 0.0], [0.0, -3.0, 0.0], [0.125, 0.0, 1.0]]]


def _voxels(name: str, op: Callable[[DataFrame], DataFrame], sql: str, above: int | None = None) -> None:
    """A query of cells (image_id, z, y, x, v) from an operator on the volumes."""
    at = "image_id, z, y, x"
    add(name, lambda s, d: op(R.volume(s, d, above)).select(*at.split(", "), shown("v").alias("v")), f"SELECT {at}, round(v, 6) + 0.0 AS v FROM ({sql})")


_OFF = volumes.offsets(_BALL)
_voxels("vol_convolve", lambda p: _SPACE.convolve(p, _KERNEL, mode="reflect"), G.gather_volume(R.VOLUME, volumes.offsets(_KERNEL), "sum(@w * @v) AS v", "reflect"))
_voxels("vol_mean", lambda p: _SPACE.mean_filter(p, K.cuboid(3, 3, 5), mode="wrap"), G.gather_volume(R.VOLUME, volumes.offsets(K.cuboid(3, 3, 5)), "avg(@v) AS v", "wrap"))
_voxels("vol_median", lambda p: _SPACE.median_filter(p, _BALL, mode="symmetric"), G.gather_volume(R.VOLUME, _OFF, f"list_sort(list(@v))[{len(_OFF) // 2}] AS v", "symmetric"))
_voxels("vol_rank", lambda p: _SPACE.rank_filter(p, K.solid(1, shape="octahedron"), 6, mode="edge"), G.gather_volume(R.VOLUME, volumes.offsets(K.solid(1, shape="octahedron")), "list_sort(list(@v))[6] AS v", "edge"))
_voxels("vol_erode", lambda p: _SPACE.erosion(p), G.gather_volume(R.volume_mask(100), volumes.offsets(volumes.element(3)), "min(@v) AS v"), 100)
_voxels("vol_dilate", lambda p: _SPACE.dilation(p, _BALL), G.gather_volume(R.volume_mask(200), _OFF, "max(@v) AS v"), 200)
_voxels("vol_gray_open", lambda p: _SPACE.opening(p, _BALL), G.gather_volume(G.gather_volume(R.VOLUME, _OFF, "min(@v) AS v"), _OFF, "max(@v) AS v"))
for _k in (1, 2, 3):
    _ROOTS = G.rooted_volume(R.volume_mask(190), _k)
    add(f"vol_label_{_k}", lambda s, d, k=_k: _SPACE.label(R.volume(s, d, 190), k).select("image_id", "z", "y", "x", "label"), f"SELECT image_id, z, y, x, CASE WHEN root IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY image_id ORDER BY root NULLS LAST) END::BIGINT AS label FROM ({_ROOTS})")
_voxels("vol_small_objects", lambda p: _SPACE.remove_small_objects(p, 4), f"SELECT *, (root IS NOT NULL AND n > 4)::INT::DOUBLE AS k FROM ({G.rooted_volume(R.volume_mask(190))})".replace("SELECT *,", "SELECT * REPLACE (k AS v) FROM (SELECT *,", 1) + ")", 190)
_EDGE = "z IN (0, d - 1) OR y IN (0, h - 1) OR x IN (0, w - 1)"
_HOLES = G.rooted_volume(f"SELECT * REPLACE ((v = 0)::INT::DOUBLE AS v) FROM ({R.volume_mask(70)})")
_voxels("vol_fill_holes", lambda p: _SPACE.fill_holes(p), f"SELECT * REPLACE ((root IS NULL OR NOT bool_or({_EDGE}) OVER (PARTITION BY image_id, root))::INT::DOUBLE AS v) FROM ({_HOLES})", 70)
_PLANE = volumes.Space((("y", "h"), ("x", "w")), keys=("image_id", "d", "z"), side=8)
_voxels("vol_planes_mean", lambda p: _PLANE.mean_filter(p, BOX3, mode="reflect"), G.gather_volume(R.VOLUME, volumes.offsets([BOX3]), "avg(@v) AS v", "reflect"))

# Labels and regions.

add("label", lambda s, d: labels.label(R.mask(s, d)).select("image_id", "y", "x", "label"), f"SELECT image_id, y, x, label FROM ({G.labelled(R.MASK)})")
add("label_diagonal", lambda s, d: labels.label(R.mask(s, d), 2).select("image_id", "y", "x", "label"), f"SELECT image_id, y, x, label FROM ({G.labelled(R.MASK, 2)})")
add("label_values", lambda s, d: labels.label(R.gray(s, d), 1, "linear", 128).select("image_id", "y", "x", "label"), f"SELECT image_id, y, x, label FROM ({G.labelled(f'SELECT * REPLACE (CASE WHEN v = 0 THEN 0 ELSE floor(v / 128) + 1 END AS v) FROM ({R.GRAY})')})")
pixels("rm_small_objects", lambda p: labels.remove_small_objects(p, 6), G.by_area(R.MASK, 6), R.mask)
pixels("rm_small_holes", lambda p: labels.remove_small_holes(p, 6), G.inverted(G.by_area(G.inverted(R.MASK), 6)), R.mask)
pixels("fill_holes", labels.fill_holes, G.filled(R.MASK), R.mask)
pixels("region_fill", lambda p: labels.region_fill(p, (5, 5)), f"SELECT image_id, y, x, (v = 0 OR coalesce(root = max(CASE WHEN y = 5 AND x = 5 THEN root END) OVER (PARTITION BY image_id), false))::INT::DOUBLE AS v FROM ({G.rooted(G.inverted(R.MASK))})", R.mask)
_NEARBY = f"SELECT p.* REPLACE ((abs(p.v - t.v) <= 90)::INT::DOUBLE AS v) FROM ({R.GRAY}) p JOIN ({R.GRAY}) t ON t.image_id = p.image_id AND t.y = 5 AND t.x = 5"
pixels("region_fill_gray", lambda p: labels.region_fill(p, (5, 5), 90, binary=False), f"SELECT image_id, y, x, (v = 0 OR coalesce(root = max(CASE WHEN y = 5 AND x = 5 THEN root END) OVER (PARTITION BY image_id), false))::INT::DOUBLE AS v FROM ({G.rooted(_NEARBY)})")
_UNEVEN = [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 1.0]]
_LIGHT = f"SELECT * REPLACE ((v > 70)::INT::DOUBLE AS v) FROM ({R.GRAY})"
_STEPS = [t[:2] for t in K.taps(_UNEVEN)]
_OUTSIDE = " OR ".join(f"y + {dy} NOT BETWEEN 0 AND h - 1 OR x + {dx} NOT BETWEEN 0 AND w - 1" for dy, dx in _STEPS)
pixels("fill_holes_element", lambda p: reach.fill_holes(p, _UNEVEN, side=8), G.reached(_LIGHT, "v = 0", _OUTSIDE, [(-dy, -dx) for dy, dx in _STEPS], "NOT hit"), lambda s, d: R.mask(s, d, 70))
_ON = [t[:2] for t in K.taps(_UNEVEN, flip=False)]
pixels("region_fill_element", lambda p: reach.region_fill(p, (7, 6), _UNEVEN, side=8), G.reached(R.MASK, "v = 0", "y = 7 AND x = 6", _ON, "hit OR NOT free"), R.mask)
_CLOSE_TO = f"SELECT p.* REPLACE (abs(p.v - t.v) AS v) FROM ({R.GRAY}) p JOIN ({R.GRAY}) t ON t.image_id = p.image_id AND t.y = 7 AND t.x = 6"
pixels("region_fill_gray_element", lambda p: reach.region_fill(p, (7, 6), _UNEVEN, tolerance=110, binary=False), G.reached(_CLOSE_TO, "v <= 110", "y = 7 AND x = 6", _ON, "hit OR NOT free"))
_L = G.labelled(R.MASK)
_BOXES = f"SELECT image_id, label, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1, count(*) AS area FROM ({_L}) WHERE label > 0 GROUP BY 1, 2"
add("find_object", lambda s, d: regions.find_objects(labels.label(R.mask(s, d))), f"SELECT image_id, label, y0, x0, y1, x1 FROM ({_BOXES})")
add(
    "bbox",
    lambda s, d: regions.boxes(regions.find_objects(labels.label(R.mask(s, d)))),
    f"SELECT image_id, label, y0, x0, y1, x1, (y0 + y1) / 2.0 AS cy, (x0 + x1) / 2.0 AS cx, (y1 - y0) / 2.0 AS ly, (x1 - x0) / 2.0 AS lx, ((y0 + y1) // 2)::INT AS py, ((x0 + x1) // 2)::INT AS px, ((y1 - y0 + 1) * (x1 - x0 + 1))::BIGINT AS box_area, y1 + 1 AS y_end, x1 + 1 AS x_end FROM ({_BOXES})",
)
_PROPS = "area y0 x0 y1 x1 cy cx v_min v_max v_mean mu20 mu11 mu02 box_area local_cy local_cx"


def _props(lab: DataFrame, px: DataFrame) -> DataFrame:
    return regions.region_properties(lab, px).select("image_id", "label", *(shown(c(n).cast("double"), 4).alias(n) for n in _PROPS.split()))


def _props_sql(lab: str, px: str) -> str:
    rows = f"SELECT l.image_id, l.label, l.y::DOUBLE AS y, l.x::DOUBLE AS x, p.v FROM ({lab}) l JOIN ({px}) p USING (image_id, y, x) WHERE label > 0"
    agg = f"SELECT image_id, label, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1, avg(y) AS cy, avg(x) AS cx, min(v) AS v_min, max(v) AS v_max, avg(v) AS v_mean, sum(y * y) AS syy, sum(y * x) AS syx, sum(x * x) AS sxx FROM ({rows}) GROUP BY 1, 2"
    more = f"SELECT *, syy - area * cy * cy AS mu20, syx - area * cy * cx AS mu11, sxx - area * cx * cx AS mu02, (y1 - y0 + 1) * (x1 - x0 + 1) AS box_area, cy - y0 AS local_cy, cx - x0 AS local_cx FROM ({agg})"
    return f"SELECT image_id, label, {', '.join(f'round({n}::DOUBLE, 4) + 0.0 AS {n}' for n in _PROPS.split())} FROM ({more})"


add("region_props", lambda s, d: _props(labels.label(R.mask(s, d)), R.gray(s, d)), _props_sql(_L, R.GRAY))
_CODES = G.convolved(G.minus(R.MASK, _E, "(a.v <> b.v)::INT::DOUBLE"), regions.CODES)
add(
    "perimeter",
    lambda s, d: regions.perimeter(R.mask(s, d)).select("image_id", shown("perimeter").alias("perimeter")),
    f"SELECT image_id, round(sum(CASE WHEN v IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN v IN (21, 33) THEN sqrt(2) WHEN v IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END), 6) + 0.0 AS perimeter FROM ({_CODES}) GROUP BY 1",
)
_LENGTH = "sum(CASE WHEN v IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN v IN (21, 33) THEN sqrt(2) WHEN v IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END)"
# Each region as an image of its own, in its box.
_OWN = f"SELECT b.image_id * 10000 + b.label AS image_id, (b.y1 - b.y0 + 1)::INT AS h, (b.x1 - b.x0 + 1)::INT AS w, (l.y - b.y0)::INT AS y, (l.x - b.x0)::INT AS x, (l.label = b.label)::INT::DOUBLE AS v FROM ({_BOXES}) b JOIN ({_L}) l ON l.image_id = b.image_id AND l.y BETWEEN b.y0 AND b.y1 AND l.x BETWEEN b.x0 AND b.x1"
_OWN_CODES = G.convolved(G.minus("SELECT * FROM own", G.eroded("SELECT * FROM own", CROSS), "(a.v <> b.v)::INT::DOUBLE"), regions.CODES)
_SHAPES = (
    f"WITH own AS MATERIALIZED ({_OWN}), a AS (SELECT image_id, sum(v)::BIGINT AS area FROM own GROUP BY 1), f AS MATERIALIZED (SELECT image_id, sum(v)::BIGINT AS area_filled FROM ({G.filled('SELECT * FROM own')}) GROUP BY 1), "
    f"p AS (SELECT image_id, {_LENGTH} AS perimeter FROM ({_OWN_CODES}) GROUP BY 1) SELECT image_id // 10000 AS image_id, image_id % 10000 AS label, area, area_filled, round(perimeter, 6) + 0.0 AS perimeter, "
    "area - area_filled AS euler_number, round(pow(perimeter, 2) / (4 * pi() * area_filled), 6) + 0.0 AS circularity FROM a JOIN f USING (image_id) JOIN p USING (image_id)"
)
add("region_shapes", lambda s, d: regions.region_shapes(labels.label(R.mask(s, d))).select("image_id", "label", "area", "area_filled", shown("perimeter").alias("perimeter"), "euler_number", shown("circularity").alias("circularity")), _SHAPES)
_M = [(p, q) for p in range(3) for q in range(3)]
add("moments", lambda s, d: regions.moments(R.gray(s, d), 2), f"SELECT image_id, {', '.join(f'sum(v * pow(y, {p}) * pow(x, {q})) AS m{p}{q}' for p, q in _M)} FROM ({R.GRAY}) GROUP BY 1")
add("moments_central", lambda s, d: regions.moments(R.gray(s, d), 2, (15.5, 15.5)), f"SELECT image_id, {', '.join(f'sum(v * pow(y - 15.5, {p}) * pow(x - 15.5, {q})) AS m{p}{q}' for p, q in _M)} FROM ({R.GRAY}) GROUP BY 1")
add("crop", lambda s, d: regions.cropped(R.gray(s, d), regions.find_objects(labels.label(R.mask(s, d)))).select("image_id", "label", "y", "x", "v"), f"SELECT p.image_id, b.label, p.y - b.y0 AS y, p.x - b.x0 AS x, p.v FROM ({R.GRAY}) p JOIN ({_BOXES}) b ON b.image_id = p.image_id AND p.y BETWEEN b.y0 AND b.y1 AND p.x BETWEEN b.x0 AND b.x1")

# Texture.

_DIST, _ANG = (1, 2), (0.0, math.pi / 4, math.pi / 2)
_SHIFTS = ", ".join(f"({i}, {j}, {regions._half_away(r * math.sin(t))}, {regions._half_away(r * math.cos(t))})" for i, r in enumerate(_DIST) for j, t in enumerate(_ANG))
_Q16 = f"SELECT * REPLACE (floor(v / 16) AS v) FROM ({R.GRAY})"


def _coarse(s: SparkSession, d: str) -> DataFrame:
    return R.gray(s, d).withColumn("v", F.floor(c("v") / 16).cast("double"))


_GLCM = f"SELECT p.image_id, k.d::INT AS d, k.a::INT AS a, p.v::INT AS i, s.v::INT AS j, count(*) AS n FROM ({_Q16}) p CROSS JOIN (VALUES {_SHIFTS}) k(d, a, sy, sx) JOIN ({_Q16}) s ON s.image_id = p.image_id AND s.y = p.y + k.sy AND s.x = p.x + k.sx GROUP BY ALL"
_SYM = f"SELECT image_id, d, a, i, j, sum(n) AS n FROM (SELECT * FROM ({_GLCM}) UNION ALL SELECT image_id, d, a, j, i, n FROM ({_GLCM})) GROUP BY ALL"
_NORM = f"SELECT image_id, d, a, i, j, n / sum(n) OVER (PARTITION BY image_id, d, a) AS p FROM ({_SYM})"
add("glcm", lambda s, d: regions.glcm(_coarse(s, d), _DIST, _ANG), _GLCM)
add("glcm_normalised", lambda s, d: regions.glcm(_coarse(s, d), _DIST, _ANG, True, True).select("image_id", "d", "a", "i", "j", shown("p", 9).alias("p")), f"SELECT image_id, d, a, i, j, round(p, 9) + 0.0 AS p FROM ({_NORM})")
_GP = f"SELECT image_id, d, a, sum(pow(i - j, 2) * p) AS contrast, sum(p * p) AS asm, sum(p / (1 + pow(i - j, 2))) AS idm, (sum(i * j * p) - sum(i * p) * sum(j * p)) / (sqrt(sum(i * i * p) - pow(sum(i * p), 2)) * sqrt(sum(j * j * p) - pow(sum(j * p), 2))) AS cor FROM ({_NORM}) GROUP BY 1, 2, 3"
add("glcm_props", lambda s, d: regions.glcm_props(regions.glcm(_coarse(s, d), _DIST, _ANG, True, True)).select("image_id", "d", "a", *(shown(n).alias(n) for n in ("contrast", "asm", "idm", "cor"))), f"SELECT image_id, d, a, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in ('contrast', 'asm', 'idm', 'cor'))} FROM ({_GP})")

# Integral images, Haar, FAST.

_INT = f"SELECT image_id, h, w, y, x, sum(r) OVER (PARTITION BY image_id, x ORDER BY y) AS v FROM (SELECT *, sum(v) OVER (PARTITION BY image_id, y ORDER BY x) AS r FROM ({R.GRAY}))"
pixels("integral", features.integral_image, _INT)
for _kind, _axis in features.HAAR:
    (_ny, _nx), _parts = features.HAAR[_kind, _axis]
    _sum = " + ".join(f"{'' if i % 2 else '-'}(SELECT sum(q.v) FROM s q WHERE q.image_id = p.image_id AND q.y BETWEEN p.y + {a} * z.dh AND p.y + {a} * z.dh + z.dh - 1 AND q.x BETWEEN p.x + {b} * z.dw AND p.x + {b} * z.dw + z.dw - 1)" for i, (a, b) in enumerate(_parts))
    add(
        f"haar_{_kind}_{_axis}",
        lambda s, d, k=_kind, a=_axis: features.haar_features(R.gray(s, d), k, a).select("image_id", "y", "x", "dh", "dw", shown("v").alias("v")),
        f"WITH s AS ({R.GRAY}) SELECT p.image_id, p.y, p.x, z.dh, z.dw, {_sum} AS v FROM s p CROSS JOIN (VALUES (1, 1), (1, 2), (2, 1), (2, 2)) z(dh, dw) WHERE p.y + {_ny} * z.dh <= p.h AND p.x + {_nx} * z.dw <= p.w",
    )
_RS = ", ".join(f"max(CASE WHEN k.wt = {i} THEN s.v END) AS r{i}" for i in range(17))
_FAST = G.gather(R.GRAY, [(0, 0, 16), *((a, b, i) for i, (a, b) in enumerate(features.RING))], _RS)
_RINGS = [f"CASE WHEN r{i} > r16 + 0.1 THEN '+' WHEN r{i} < r16 - 0.1 THEN '-' ELSE '0' END" for i in range(16)]
pixels("fast", lambda p: features.corner_fast(p, 9), f"SELECT image_id, y, x, CASE WHEN y BETWEEN 3 AND h - 4 AND x BETWEEN 3 AND w - 4 AND (contains(g, '{'+' * 9}') OR contains(g, '{'-' * 9}')) THEN {' + '.join(f'floor(abs(r{i} - r16))' for i in range(16))} ELSE 0 END AS v FROM (SELECT *, concat({', '.join(_RINGS + _RINGS)}) AS g FROM ({_FAST}))")

# Hough.

_ANGLES = features.default_angles(36)
_AV = ", ".join(f"({i}, {math.cos(t)!r}::DOUBLE, {math.sin(t)!r}::DOUBLE)" for i, t in enumerate(_ANGLES))
add("hough_line", lambda s, d: features.hough_line(R.mask(s, d), _ANGLES), f"SELECT image_id, floor(round(x * t.co + y * t.si, 9) + 0.5)::INT AS rho, t.i AS theta_ix, count(*) AS votes FROM ({R.MASK}) CROSS JOIN (VALUES {_AV}) t(i, co, si) WHERE v <> 0 GROUP BY ALL")
_RADII = (3, 5)
_CO = ", ".join(f"({i}, {a}, {b})" for i, r in enumerate(_RADII) for a, b in circle_points(r))
add("hough_circle", lambda s, d: features.hough_circle(R.mask(s, d), _RADII), f"SELECT image_id, o.i AS radius_ix, p.y + o.dy AS y, p.x + o.dx AS x, count(*) AS votes FROM ({R.MASK}) p CROSS JOIN (VALUES {_CO}) o(i, dy, dx) WHERE v <> 0 AND p.y + o.dy BETWEEN 0 AND 31 AND p.x + o.dx BETWEEN 0 AND 31 GROUP BY ALL")
add("hough_pp_line", lambda s, d: whole_image.hough_probabilistic_line(R.mask(s, d, 40), _ANGLES, 5, 6, 2))


def _plateaus_sql(cells: str, reach: tuple[int, int, int]) -> str:
    """Rows (image_id, z, y, x, v, rank) by the greedy choice among ``cells`` (candidates): the best that is left takes the
    cells that touch it with its value, and silences its box."""
    order = "list(struct_pack(z := z::BIGINT, y := y::BIGINT, x := x::BIGINT, v := v::DOUBLE) ORDER BY v DESC, z, y, x)"
    touch = "len(list_filter(acc, lambda t: abs(t.z - q.z) <= 1 AND abs(t.y - q.y) <= 1 AND abs(t.x - q.x) <= 1)) > 0"
    taken = f"list_reduce(range(40), lambda acc, i: list_distinct(list_concat(acc, list_filter(live, lambda q: q.v = live[1].v AND {touch}))), [live[1]])"
    box = " AND ".join(f"abs(q.{a} - live[1].{a}) <= {r}" for a, r in zip("zyx", reach, strict=True))
    step = (
        f"SELECT image_id, step + 1, list_filter(live, lambda q: NOT list_contains(taken, q) AND NOT ({box})), list_concat(done, [struct_pack(c := t, rank := step + 1) FOR t IN taken]) "
        f"FROM (SELECT *, {taken} AS taken FROM r WHERE len(live) > 0)"
    )
    none = "[]::STRUCT(c STRUCT(z BIGINT, y BIGINT, x BIGINT, v DOUBLE), rank BIGINT)[]"
    return (
        f"WITH RECURSIVE r(image_id, step, live, done) AS (SELECT image_id, 0::BIGINT, {order}, {none} FROM ({cells}) GROUP BY 1 UNION ALL ({step})) "
        "SELECT image_id, e.c.z AS z, e.c.y AS y, e.c.x AS x, e.c.v AS v, e.rank AS rank FROM (SELECT image_id, unnest(done) AS e FROM r WHERE len(live) = 0)"
    )


def _strong_sql(votes: str, reach: tuple[int, int, int]) -> str:
    """Cells of an accumulator above half an image's greatest that none in their box exceeds."""
    near = " AND ".join(f"abs(b.{a} - a.{a}) <= {r}" for a, r in zip("zyx", reach, strict=True))
    return f"SELECT * FROM (SELECT * FROM ({votes}) QUALIFY v > 0.5 * max(v) OVER (PARTITION BY image_id)) a WHERE NOT EXISTS (SELECT 1 FROM ({votes}) b WHERE b.image_id = a.image_id AND b.v > a.v AND {near})"


_LINES_SQL = f"SELECT image_id, 0 AS z, rho AS y, theta_ix AS x, votes AS v FROM ({_sql['hough_line']})"
_CIRCLES_SQL = f"SELECT image_id, radius_ix AS z, y, x, votes AS v FROM ({_sql['hough_circle']})"
add("hough_line_peak", lambda s, d: peaks.hough_line_peak(features.hough_line(R.mask(s, d), _ANGLES), 5), f"SELECT image_id, y::INT AS rho, x::INT AS theta_ix, v::BIGINT AS votes, rank FROM ({_plateaus_sql(_strong_sql(_LINES_SQL, (0, 7, 7)), (0, 7, 7))}) WHERE rank <= 5")
_AROUND = (int(len(_RADII) > 1), 7, 7)
add("hough_circle_peak", lambda s, d: peaks.hough_circle_peak(features.hough_circle(R.mask(s, d), _RADII), 5), f"SELECT image_id, z::INT AS radius_ix, y::INT AS y, x::INT AS x, v::BIGINT AS votes FROM ({_plateaus_sql(_strong_sql(_CIRCLES_SQL, _AROUND), _AROUND)}) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY z, y, x) <= 5")


def _boxes_sql(px: str, reach: tuple[int, int], mode: str, limit: int) -> str:
    top = G.gather(px, K.taps(K.box(2 * reach[0] + 1, 2 * reach[1] + 1)), "any_value(p.v) AS v, max(@v) AS top", mode)
    cells = f"SELECT image_id, 0 AS z, y, x, v FROM ({top}) JOIN (SELECT image_id, 0.5 * max(v) AS th FROM ({px}) GROUP BY 1) USING (image_id) WHERE v > th AND v >= top"
    return f"SELECT image_id, y::INT AS y, x::INT AS x, v, rank FROM ({_plateaus_sql(cells, (0, *reach))}) WHERE rank <= {limit}"


add("peaks_box", lambda s, d: peaks.peak_suppression(R.gray(s, d), 3), _boxes_sql(R.GRAY, (3, 3), "constant", 100_000))
add("peaks_box_inverted", lambda s, d: peaks.peak_suppression(R.gray(s, d), (2, 4), n_peaks=20, mode="edge", invert=True), _boxes_sql(f"SELECT * REPLACE (255 - v AS v) FROM ({R.GRAY})", (2, 4), "edge", 20))
_GREEDY = "list_reduce(list(struct_pack(y := y, x := x, v := v) ORDER BY v DESC, y, x), lambda a, q: CASE WHEN len(list_filter(a, lambda t: {near})) > 0 THEN a ELSE list_append(a, q) END, []::STRUCT(y INT, x INT, v DOUBLE)[])"


def _peaks_sql(taps, near: str, sign: str = "", limit: int = 10) -> str:
    """Candidates in falling order, each taken unless one that was taken is near."""
    px = f"SELECT * REPLACE ({sign}v AS v) FROM ({R.GRAY})"
    top = G.gather(px, taps, "any_value(p.v) AS v, max(@v) AS top")
    th = f"SELECT image_id, {sign}0.5 * max({sign}v) AS th FROM ({px}) GROUP BY 1"
    kept = f"SELECT image_id, {_GREEDY.format(near=near)} AS k FROM ({top}) JOIN ({th}) USING (image_id) WHERE v > th AND v >= top GROUP BY 1"
    each = f"SELECT image_id, unnest(k) AS e, unnest(range(1, len(k) + 1)) AS rank FROM ({kept})"
    return f"SELECT image_id, e.y AS y, e.x AS x, {sign}e.v AS v, rank::BIGINT AS rank FROM ({each}) WHERE rank <= {limit}"


_ROUND = "(t.y - q.y) * (t.y - q.y) + (t.x - q.x) * (t.x - q.x) <= 9"
add("peaks", lambda s, d: peaks.find_peaks(R.gray(s, d), 3, n_peaks=10), _peaks_sql(K.taps(K.box(7, 7)), _ROUND))
add("peaks_inverted", lambda s, d: peaks.find_peaks(R.gray(s, d), 3, n_peaks=10, p=1, footprint=CROSS, invert=True), _peaks_sql(K.taps(CROSS), "abs(t.y - q.y) + abs(t.x - q.x) <= 3", "-"))

# Geometry and pyramids.


def _asked_points(s: SparkSession, d: str) -> DataFrame:
    """A point in or about an image for each embedding."""
    at = lambda i: F.round(16 + c("embedding")[i].cast("double") * 60, 3)
    return R.table(s, d, "embeddings").select((c("vec_id") % 4).alias("image_id"), c("vec_id").alias("id"), at(0).alias("y"), at(1).alias("x"))


_POINTS_SQL = "SELECT vec_id % 4 AS image_id, vec_id AS id, round(16 + embedding[1]::DOUBLE * 60, 3) AS y, round(16 + embedding[2]::DOUBLE * 60, 3) AS x FROM embeddings"
for _o, _mode in ((0, "edge"), (1, "constant"), (2, "wrap"), (3, "reflect")):
    add(f"sample_points_{_o}", lambda s, d, o=_o, m=_mode: geometry.map_coordinates(R.gray(s, d), _asked_points(s, d), o, m, 7.0).select("image_id", "id", "y", "x", shown("v").alias("v")), f"SELECT image_id, id, y, x, round(v, 6) + 0.0 AS v FROM ({G.sampled_at(R.GRAY, _POINTS_SQL, _o, _mode, 7.0)})")

for _o in range(4):
    pixels(f"resize_{_o}", lambda p, o=_o: geometry.resize(p, (20, 45), o), G.resized(R.GRAY, (20, 45), _o))
pixels("resize_antialias", lambda p: geometry.resize(p, (16, 16), 1, size=(32, 32)), G.resized(G.convolved(G.convolved(R.GRAY, [[w] for w in K.gaussian_line((31 / 15 - 1) / 2)]), [K.gaussian_line((31 / 15 - 1) / 2)]), (16, 16), 1))
_AFF = geometry.affine(20, (3, -2), (1.1, 0.9), (0.1, 0.0))
pixels("warp", lambda p: geometry.warp(p, _AFF), G.warped(R.GRAY, (32, 32), _AFF, 1))
_PROJ = [[1.0, 0.1, -1.0], [0.05, 0.9, 2.0], [0.001, 0.002, 1.0]]
pixels("warp_projective", lambda p: geometry.warp(p, _PROJ, 3), G.warped(R.GRAY, (32, 32), _PROJ, 3))
_ROT = geometry.times(geometry.times(geometry.rigid(0, (15.5, 15.5)), geometry.rigid(30)), geometry.rigid(0, (-15.5, -15.5)))
pixels("rotate", lambda p: geometry.rotate(p, 30, (32, 32), reshape=False), G.warped(R.GRAY, (32, 32), _ROT, 1))
_TURN = geometry.rotation(30, (32, 32))
pixels("rotate_reshape", lambda p: geometry.rotate(p, 30, (32, 32)), G.warped(R.GRAY, _TURN[1], _TURN[0], 1))
add(
    "transform_points",
    lambda s, d: geometry.transform_points(R.points(s, d).select("point_id", c("p")[0].alias("x"), c("p")[1].alias("y")), _PROJ).select("point_id", shown("x").alias("x"), shown("y").alias("y")),
    f"SELECT point_id, round((p[1] + 0.1::DOUBLE * p[2] - 1) / z, 6) + 0.0 AS x, round((0.05 * p[1] + 0.9 * p[2] + 2) / z, 6) + 0.0 AS y FROM (SELECT *, 0.001 * p[1] + 0.002 * p[2] + 1 AS z FROM ({R.POINTS}))",
)


def _levels(px: DataFrame, *more: str) -> DataFrame:
    return px.select("image_id", "level", *more, "y", "x", shown("v").alias("v"))


def _sym(px: str, sigma: float = 1.0) -> str:
    return G.blurred(px, sigma, "symmetric")


_G0 = _sym(R.GRAY)
_R1 = G.resized(_G0, (16, 16), 0, "symmetric")
_LEVEL = "SELECT image_id, {k} AS level, y, x, round(v, 6) + 0.0 AS v FROM ({s})"
add("pyr_gauss", lambda s, d: _levels(geometry.gaussian_pyramid(R.gray(s, d), (32, 32), n_layers=2)), " UNION ALL ".join(_LEVEL.format(k=k, s=q) for k, q in enumerate((_G0, _sym(_R1)))))
add("pyr_laplace", lambda s, d: _levels(geometry.laplacian_pyramid(R.gray(s, d), (32, 32), n_layers=2)), " UNION ALL ".join(_LEVEL.format(k=k, s=q) for k, q in enumerate((G.minus(R.GRAY, _G0), G.minus(_R1, _sym(_R1))))))
pixels("layer_scale", lambda p: geometry.Layer((32, 32), sigma=0.8).scale(p), _sym(R.GRAY, 0.8))
pixels("layer_rescale", lambda p: geometry.Layer((32, 32)).rescale(p), G.resized(R.GRAY, (16, 16), 0, "symmetric"))
pixels("layer_reduce", lambda p: geometry.Layer((32, 32), sigma=0.8).reduce(p), _sym(G.resized(R.GRAY, (16, 16), 0, "symmetric"), 0.8))
_S0 = [R.GRAY, _sym(R.GRAY, 0.8), _sym(_sym(R.GRAY, 0.8), 1.0)]
_S1 = [(_x := G.resized(_S0[-1], (16, 16), 0, "symmetric")), _sym(_x, 0.8), _sym(_sym(_x, 0.8), 1.0)]
_SCALE = "SELECT image_id, {k} AS level, {i} AS scale_ix, y, x, round(v, 6) + 0.0 AS v FROM ({s})"
add("pyr_scale_space", lambda s, d: _levels(geometry.scale_space(R.gray(s, d), (32, 32), (0.8, 1.0), 2), "scale_ix"), " UNION ALL ".join(_SCALE.format(k=k, i=i, s=q) for k, o in enumerate((_S0, _S1)) for i, q in enumerate(o)))
add("pyr_dog", lambda s, d: _levels(geometry.dog_pyramid(R.gray(s, d), (32, 32), (0.8, 1.0), 1), "scale_ix"), " UNION ALL ".join(_SCALE.format(k=k, i=i, s=G.minus(o[i + 1], o[i])) for k, o in enumerate((_S0, _S1)) for i in (0, 1)))
add("pyr_mosaic", lambda s, d: _plain(geometry.mosaic(geometry.gaussian_pyramid(R.gray(s, d), (32, 32), n_layers=2))), f"SELECT image_id, y, x, round(v, 6) + 0.0 AS v FROM (SELECT image_id, y, x, v FROM ({_G0}) UNION ALL SELECT image_id, y, x + 32 AS x, v FROM ({_sym(_R1)}))")

# Point sets.


def _asked(s: SparkSession, d: str) -> DataFrame:
    return R.points(s, d).select(c("point_id").alias("query_id"), c("p").alias("q"))


def _dist(p: float = 2) -> str:
    gaps = "[abs(z[1] - z[2]) FOR z IN list_zip(a.p, b.p)]"
    return "list_distance(a.p, b.p)" if p == 2 else f"list_sum({gaps})" if p == 1 else f"list_max({gaps})"


_PAIR = f"SELECT a.point_id AS query_id, b.point_id, round({{}}, 9) + 0.0 AS dist FROM ({R.POINTS}) a, ({R.POINTS}) b"
for _p, _n in ((2, "knn"), (1, "knn_p1"), (math.inf, "knn_inf")):
    add(_n, lambda s, d, p=_p: spatial.knn(R.points(s, d), _asked(s, d), 5, p).select("query_id", "point_id", shown("dist", 9).alias("dist"), "rank"), f"SELECT query_id, point_id, dist, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, point_id) AS rank FROM ({_PAIR.format(_dist(_p))})) WHERE rank <= 5")
_NEXT = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, point_id) AS rank FROM ({_PAIR.format(_dist())})"
add("knn_each", lambda s, d: spatial.knn(R.points(s, d), _asked(s, d).withColumn("k", (1 + c("query_id") % 7).cast("int")), "k", within=140.0).select("query_id", "point_id", shown("dist", 9).alias("dist"), "rank"), f"SELECT query_id, point_id, dist, rank::INT AS rank FROM ({_NEXT}) WHERE rank <= 1 + query_id % 7 AND dist < 140")
add("ball_each", lambda s, d: spatial.ball(R.points(s, d), _asked(s, d).withColumn("r", 90.0 + c("query_id") % 31), "r", p=2), f"SELECT * FROM ({_PAIR.format(_dist())}) WHERE dist <= 90 + query_id % 31")
add("ball_inf", lambda s, d: spatial.ball(R.points(s, d), _asked(s, d), 34.0, math.inf), f"SELECT * FROM ({_PAIR.format(_dist(math.inf))}) WHERE dist <= 34")
add("ball", lambda s, d: spatial.ball(R.points(s, d), _asked(s, d), 115.0), f"SELECT * FROM ({_PAIR.format(_dist())}) WHERE dist <= 115")
_CENTRES = [[0.0] * 64, [5.0 * (-1) ** i for i in range(64)], [float(i % 9 - 4) for i in range(64)]]
_CD = ", ".join(f"round(list_distance(p, {k}::DOUBLE[]), 9)" for k in _CENTRES)
add("kmeans_assign", lambda s, d: spatial.assign(R.points(s, d), _CENTRES).select("point_id", "cluster"), f"SELECT point_id, (list_position([{_CD}], list_min([{_CD}])) - 1)::INT AS cluster FROM ({R.POINTS})")


def _kmeans(s: SparkSession, d: str) -> DataFrame:
    points = R.points(s, d)
    centres = spatial.kmeans(points, 4)
    return spatial.assign(points, centres).groupBy("cluster").agg(F.count("*").alias("n"), *(shown(F.avg(c("p")[i])).alias(f"m{i}") for i in range(len(centres[0]))))


def _kmeans_sql(k: int = 4, rounds: int = 100, dims: int = 64) -> str:
    """Farthest-point seeds, then Lloyd's rounds well past the last that changes anything."""
    gaps = "[round(list_distance(p.p, x), 9) FOR x IN {c}]"
    seeds = ["s1 AS MATERIALIZED (SELECT [arg_min(p, point_id)] AS c FROM p)"]
    for i in range(1, k):
        seeds.append(f"s{i + 1} AS MATERIALIZED (SELECT list_append(any_value(s.c), arg_min(p.p, (-list_min({gaps.format(c='s.c')}), p.point_id))) AS c FROM p, s{i} s)")
    at = lambda c: f"list_position({gaps.format(c=c)}, list_min({gaps.format(c=c)})) - 1"
    means = f"SELECT step, k, j, avg(v) AS m FROM (SELECT r.step, {at('r.c')} AS k, unnest(p.p) AS v, unnest(range({dims})) AS j FROM p, r WHERE r.step < {rounds}) GROUP BY ALL"
    step = f"SELECT step + 1, list(m ORDER BY k) FROM (SELECT step, k, list(m ORDER BY j) AS m FROM ({means}) GROUP BY step, k) GROUP BY step"
    last = f"SELECT p.p, {at('r.c')} AS cluster FROM p, r WHERE r.step = {rounds}"
    cols = ", ".join(f"round(avg(p[{i + 1}]), 6) + 0.0 AS m{i}" for i in range(dims))
    return f"WITH RECURSIVE p AS MATERIALIZED ({R.POINTS}), {', '.join(seeds)}, r(step, c) AS (SELECT 0, c FROM s{k} UNION ALL ({step})) SELECT cluster::INT AS cluster, count(*) AS n, {cols} FROM ({last}) GROUP BY cluster"


add("kmeans_fit", _kmeans, _kmeans_sql())


def _foreground(s: SparkSession, d: str) -> DataFrame:
    return R.mask(s, d).where("v = 1").select(c("image_id").alias("set_id"), "y", "x")


_FG = f"SELECT image_id AS set_id, y, unnest(list_distinct([min(x), max(x)])) AS x FROM ({R.MASK}) WHERE v = 1 GROUP BY 1, 2"  # a row's ends have its hull
# A point is a corner of the hull if no two others have it between or inside them.
_ON = "SELECT DISTINCT a.set_id, a.y, a.x, b.y AS y2, b.x AS x2 FROM f a JOIN f b ON a.set_id = b.set_id AND (a.y <> b.y OR a.x <> b.x) WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.set_id = a.set_id AND ((b.y - a.y) * (q.x - a.x) - (b.x - a.x) * (q.y - a.y) < 0 OR ((b.y - a.y) * (q.x - a.x) - (b.x - a.x) * (q.y - a.y) = 0 AND ((q.y - a.y) * (q.y - b.y) + (q.x - a.x) * (q.x - b.x)) > 0)))"
_HULL = f"WITH f AS ({_FG}), e AS ({_ON}) "
add("hull", lambda s, d: spatial.convex_hull(_foreground(s, d)).select("set_id", c("y").cast("int").alias("y"), c("x").cast("int").alias("x")), _HULL + "SELECT DISTINCT set_id, y, x FROM e")
_INSIDE = "EXISTS (SELECT 1 FROM e WHERE e.set_id = g.image_id) AND NOT EXISTS (SELECT 1 FROM e WHERE e.set_id = g.image_id AND (e.y2 - e.y) * (g.x - e.x) - (e.x2 - e.x) * (g.y - e.y) < 0)"
_IN_SHAPE = f"WITH f AS (SELECT image_id AS set_id, y, unnest(list_distinct([min(x), max(x)])) AS x FROM ({R.MASK}) WHERE v = 1 AND {_SHAPE} GROUP BY 1, 2), e AS ({_ON}) "
add("hull_masked", lambda s, d: spatial.convex_hull(_foreground(s, d), R.mask(s, d).select(c("image_id").alias("set_id"), "y", "x", F.expr(_SHAPE).alias("m")).withColumn("m", c("m").cast("int"))).select("set_id", c("y").cast("int").alias("y"), c("x").cast("int").alias("x")), _IN_SHAPE + "SELECT DISTINCT set_id, y, x FROM e")
add("hull_fill", lambda s, d: _plain(spatial.hull_image(spatial.convex_hull(_foreground(s, d)), images_of(R.gray(s, d)))), _HULL + f"SELECT g.image_id, g.y, g.x, ({_INSIDE})::INT::DOUBLE AS v FROM ({R.GRAY}) g")
add("hull_query", lambda s, d: spatial.hull_contains(spatial.convex_hull(_foreground(s, d)), R.gray(s, d).select(c("image_id").alias("set_id"), "y", "x")), _HULL + f"SELECT g.image_id AS set_id, g.y, g.x, {_INSIDE} AS inside FROM ({R.GRAY}) g")
_CELLS = f"SELECT image_id * 10000 + label AS set_id, image_id, label, y, x FROM ({G.labelled(R.MASK)}) WHERE label > 0"
_REGION_HULL = f"WITH l AS MATERIALIZED ({_CELLS}), f AS (SELECT set_id, y, unnest(list_distinct([min(x), max(x)])) AS x FROM l GROUP BY 1, 2), e AS MATERIALIZED ({_ON}), "
_REGION_HULL += "b AS (SELECT set_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM l GROUP BY 1), g AS (SELECT set_id, unnest(range(y0, y1 + 1)) AS y, x0, x1 FROM b), "
_REGION_HULL += "k AS (SELECT set_id, y, unnest(range(x0, x1 + 1)) AS x FROM g), i AS (SELECT k.set_id, count(*) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.set_id = k.set_id AND (e.y2 - e.y) * (k.x - e.x) - (e.x2 - e.x) * (k.y - e.y) < 0) GROUP BY 1), "
_REGION_HULL += "q AS (SELECT set_id, count(*) AS n FROM (SELECT DISTINCT set_id, y, x FROM e) GROUP BY 1) "
add("region_hulls", lambda s, d: regions.region_hulls(labels.label(R.mask(s, d))), _REGION_HULL + "SELECT l.image_id, l.label, count(*) AS area, any_value(i.n) AS area_convex, coalesce(any_value(q.n), 1) AS n_corners FROM l JOIN i USING (set_id) LEFT JOIN q USING (set_id) GROUP BY l.image_id, l.label")
_CUT_HULL = _REGION_HULL.replace("WHERE label > 0", f"WHERE label > 0 AND {_SHAPE}")
add("region_hulls_masked", lambda s, d: regions.region_hulls(labels.label(R.mask(s, d)), R.gray(s, d).select("image_id", "y", "x", F.expr(_SHAPE).cast("int").alias("m"))), _CUT_HULL + "SELECT l.image_id, l.label, count(*) AS area, any_value(i.n) AS area_convex, coalesce(any_value(q.n), 1) AS n_corners FROM l JOIN i USING (set_id) LEFT JOIN q USING (set_id) GROUP BY l.image_id, l.label")
_SPAN = "greatest(abs(y2 - y1), abs(x2 - x1))"
_OUTLINE = (
    "SELECT DISTINCT set_id, (y1 + CASE WHEN y2 > y1 THEN 1 ELSE -1 END * CASE WHEN abs(y2 - y1) > abs(x2 - x1) THEN i ELSE (2 * abs(y2 - y1) * i + n) // (2 * n) END)::INT AS y, "
    "(x1 + CASE WHEN x2 > x1 THEN 1 ELSE -1 END * CASE WHEN abs(y2 - y1) > abs(x2 - x1) THEN (2 * abs(x2 - x1) * i + n) // (2 * n) ELSE i END)::INT AS x "
    f"FROM (SELECT *, {_SPAN} AS n, unnest(range({_SPAN} + 1)) AS i FROM (SELECT set_id, y AS y1, x AS x1, y2, x2 FROM e))"
)
add("hull_outline", lambda s, d: spatial.hull_outline(spatial.convex_hull(_foreground(s, d))), _HULL + _OUTLINE)

# Drawing.


def _segments(s: SparkSession, d: str) -> DataFrame:
    return R.table(s, d, "embeddings").select("vec_id", *(F.abs(F.round(c("embedding")[i].cast("double") * 40)).cast("int").alias(n) for i, n in enumerate(("y1", "x1", "y2", "x2"))))


_SEG = "SELECT vec_id, " + ", ".join(f"abs(round(embedding[{i + 1}]::DOUBLE * 40))::INT AS {n}" for i, n in enumerate(("y1", "x1", "y2", "x2"))) + " FROM embeddings"
_N = "greatest(abs(y2 - y1), abs(x2 - x1))"
_LINE = (
    f"SELECT vec_id, i::INT AS i, (y1 + CASE WHEN y2 > y1 THEN 1 ELSE -1 END * CASE WHEN abs(y2 - y1) > abs(x2 - x1) THEN i WHEN n = 0 THEN 0 ELSE (2 * abs(y2 - y1) * i + n) // (2 * n) END)::INT AS y, "
    f"(x1 + CASE WHEN x2 > x1 THEN 1 ELSE -1 END * CASE WHEN abs(y2 - y1) <= abs(x2 - x1) THEN i WHEN n = 0 THEN 0 ELSE (2 * abs(x2 - x1) * i + n) // (2 * n) END)::INT AS x FROM (SELECT *, {_N} AS n, unnest(range({_N} + 1)) AS i FROM ({_SEG}))"
)
add("draw_line", lambda s, d: drawing.lines(_segments(s, d)), _LINE)


def _centres(s: SparkSession, d: str) -> DataFrame:
    """The cells that are the greatest of their 5x5 box."""
    taps = [(a, b, float(a == b == 0)) for a in range(-2, 3) for b in range(-2, 3)]
    near = N.gathered(R.gray(s, d), taps, "reflect", top=F.max("v"), own=F.max(F.when(c("wt") == 1, c("v"))))
    return near.where("own = top").select("image_id", "y", "x")


_TOPS = f"SELECT p.image_id, p.y, p.x FROM ({R.GRAY}) p JOIN ({G.gather(R.GRAY, K.taps(BOX5), 'max(@v) AS v', 'reflect')}) t USING (image_id, y, x) WHERE p.v = t.v"


def _stamped(offsets) -> str:
    o = ", ".join(f"({a}, {b})" for a, b in dict.fromkeys(offsets))
    return f"SELECT g.image_id, g.y + o.dy AS y, g.x + o.dx AS x FROM ({_TOPS}) g CROSS JOIN (VALUES {o}) o(dy, dx)"


add("draw_circle", lambda s, d: drawing.circles(_centres(s, d), 6), _stamped(circle_points(6)))
add("draw_ellipse", lambda s, d: drawing.ellipses(_centres(s, d), 7, 4), _stamped(ellipse_points(7, 4)))
add("draw_paint", lambda s, d: _plain(drawing.paint(R.gray(s, d), drawing.circles(_centres(s, d), 4), 300.0)), f"SELECT g.image_id, g.y, g.x, CASE WHEN EXISTS (SELECT 1 FROM ({_stamped(circle_points(4))}) k WHERE k.image_id = g.image_id AND k.y = g.y AND k.x = g.x) THEN 300.0::DOUBLE ELSE g.v END AS v FROM ({R.GRAY}) g")
_MARK = f"EXISTS (SELECT 1 FROM ({_stamped(drawing.SHAPES['CROSS'])}) k WHERE k.image_id = g.image_id AND k.y = g.y AND k.x = g.x)"
add("mark_points", lambda s, d: drawing.mark_points(R.gray(s, d), _centres(s, d), "CROSS").select("image_id", "y", "x", "r", "g", "b"), f"SELECT g.image_id, g.y, g.x, CASE WHEN {_MARK} THEN 255.0::DOUBLE ELSE v END AS r, CASE WHEN {_MARK} THEN 0.0::DOUBLE ELSE v END AS g, CASE WHEN {_MARK} THEN 0.0::DOUBLE ELSE v END AS b FROM ({R.GRAY}) g")



def _in_sql(text: str, name: str, rows: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query written in SQL over the registered table functions."""

    def run(s: SparkSession, d: str) -> DataFrame:
        sql.register(s)
        rows(s, d).createOrReplaceTempView(name)
        return s.sql(text)

    return run


add("sql_draw_line", _in_sql("SELECT s.vec_id, c.i, c.y, c.x FROM segments s, LATERAL draw_line(s.y1, s.x1, s.y2, s.x2) c", "segments", _segments), _LINE)
add("sql_draw_circle", _in_sql("SELECT t.image_id, c.y, c.x FROM tops t, LATERAL draw_circle(t.y, t.x, 6) c", "tops", _centres), _stamped(circle_points(6)))
add("sql_draw_ellipse", _in_sql("SELECT t.image_id, c.y, c.x FROM tops t, LATERAL draw_ellipse(t.y, t.x, 7, 4) c", "tops", _centres), _stamped(ellipse_points(7, 4)))
add("sql_stamp", _in_sql("SELECT t.image_id, c.y, c.x FROM tops t, LATERAL stamp(t.y, t.x, 'SQUARE', 3) c", "tops", _centres), _stamped(drawing.SHAPES["SQUARE"]))

# Streams (as batches) and grids.

add("stream_windows", lambda s, d: windowed(R.table(s, d, "events")).select("win_start", "event_type", "n", shown("total", 4).alias("total"), "lo", "hi"), "SELECT date_trunc('hour', ts) AS win_start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2")
add("grid", lambda s, d: grid(images_of(R.gray(s, d))), f"SELECT image_id, h, w, y, x FROM ({R.GRAY})")

# Flagship: opening, Otsu's threshold, labels, properties of regions.


def _flagship(s: SparkSession, d: str) -> DataFrame:
    smooth = N.gray_opening(R.gray(s, d), CROSS)
    return _props(labels.label(histograms.threshold(smooth, "otsu").drop("th")), R.gray(s, d))


_SMOOTH = G.dilated(G.eroded(R.GRAY, CROSS), CROSS)
_CUT = f"SELECT p.image_id, p.h, p.w, p.y, p.x, (p.v > t.th)::INT::DOUBLE AS v FROM ({_SMOOTH}) p JOIN ({G.otsu(_SMOOTH)}) t USING (image_id)"
add("flagship_regions", _flagship, _props_sql(G.labelled(_CUT), R.GRAY))
