"""Colour conversions and point-wise intensity functions: projections, with a window where an image's range is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.frames import LIMITS

c = F.col


def rgb2gray(px: DataFrame) -> DataFrame:
    return px.withColumn("v", 0.2989 * c("r") + 0.5870 * c("g") + 0.1140 * c("b")).drop("r", "g", "b")


def gray2rgb(px: DataFrame) -> DataFrame:
    return px.withColumns({n: c("v") for n in "rgb"}).drop("v")


def gray2rgba(px: DataFrame, alpha: float | None = None, dtype: str = "uint8") -> DataFrame:
    """Adds an alpha channel, by default the type's greatest value; one that the type cannot hold is an error."""
    low, high = LIMITS.get(dtype, (float("-inf"), float("inf")))
    alpha = (high if dtype in LIMITS else 1.0) if alpha is None else alpha
    if not low <= alpha <= high or (dtype in LIMITS and alpha != int(alpha)):
        raise ValueError(f"{dtype} cannot hold an alpha of {alpha}")
    return gray2rgb(px).withColumn("a", F.lit(float(alpha)))


def scaled(px: DataFrame, factor: float) -> DataFrame:
    """Colour channels of 8 bits to [0, 1] (factor 1/255) or back."""
    return px.withColumns({n: c(n) * factor for n in "rgb"})


#: Channel weights of the two conversions.
TO_YUV = {"yy": (0.299, 0.578, 0.114, 0.0), "u": (-0.147, -0.289, 0.436, 0.5), "vv": (0.615, -0.515, -0.100, 0.5)}
FROM_YUV = {"r": (1.0, 0.0, 1.140), "g": (1.0, -0.395, -0.581), "b": (1.0, 2.032, 0.0)}


def rgb2yuv(px: DataFrame) -> DataFrame:
    """Channels in [0, 1] to yy, u, vv."""
    return px.withColumns({n: wr * c("r") + wg * c("g") + wb * c("b") + o for n, (wr, wg, wb, o) in TO_YUV.items()}).drop("r", "g", "b")


def yuv2rgb(px: DataFrame) -> DataFrame:
    u, v = c("u") - 0.5, c("vv") - 0.5
    return px.withColumns({n: wy * c("yy") + wu * u + wv * v for n, (wy, wu, wv) in FROM_YUV.items()}).drop("yy", "u", "vv")


def rgb2hsv(px: DataFrame) -> DataFrame:
    """Channels in [0, 1] to hue, saturation, value in [0, 1]. Of equal channels blue leads, then green."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    d = top - low
    sector = F.when(c("b") == top, 4 + (c("r") - c("g")) / d).when(c("g") == top, 2 + (c("b") - c("r")) / d).otherwise((c("g") - c("b")) / d) / 6
    hue = F.when(d == 0, 0.0).otherwise(sector - F.floor(sector))
    return px.withColumns({"hue": hue, "sat": F.when(d == 0, 0.0).otherwise(d / top), "val": top}).drop("r", "g", "b")


def hsv2rgb(px: DataFrame) -> DataFrame:
    six = F.floor(c("hue") * 6)
    f, s, v = c("hue") * 6 - six, c("sat"), c("val")
    a, b, g = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    k = (F.pmod(six, F.lit(6)) + 1).cast("int")
    pick = lambda *cols: F.element_at(F.array(*cols), k)
    return px.withColumns({"r": pick(v, b, a, a, g, v), "g": pick(g, v, v, b, a, a), "b": pick(a, a, g, v, v, b)}).drop("hue", "sat", "val")


#: Colour conversions by name.
COLOURS = {"RGB2GRAY": rgb2gray, "GRAY2RGB": gray2rgb, "GRAY2RGBA": gray2rgba, "RGB2YUV": rgb2yuv, "YUV2RGB": yuv2rgb, "RGB2HSV": rgb2hsv, "HSV2RGB": hsv2rgb}


def converted(px: DataFrame, name: str, **options) -> DataFrame:
    """A colour conversion by its name, in any case."""
    if name.upper() not in COLOURS:
        raise ValueError(f"conversions are {', '.join(COLOURS)}")
    return COLOURS[name.upper()](px, **options)


COLOURS = {"RGB2GRAY": rgb2gray, "GRAY2RGB": gray2rgb, "GRAY2RGBA": gray2rgba, "RGB2YUV": rgb2yuv, "YUV2RGB": yuv2rgb, "RGB2HSV": rgb2hsv, "HSV2RGB": hsv2rgb}

def _ranged(px: DataFrame) -> DataFrame:
    """Adds lo and hi, each image's least and greatest value: an aggregate joined back, not a window over whole images."""
    return px.join(px.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "image_id")


def _rescaled(v: Column, a: Column, b: Column, lo: Column, hi: Column) -> Column:
    """Clips to [a, b] and maps that to [lo, hi]; an empty range only clips."""
    clipped = F.least(F.greatest(v, a), b)
    return F.when(a == b, F.least(F.greatest(clipped, lo), hi)).otherwise((clipped - a) * ((hi - lo) / (b - a)) + lo)


def _whole(v: Column) -> Column:
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")


def adjust_gamma(px: DataFrame, gamma: float = 1.0, gain: float = 1.0, dtype: str = "uint8") -> DataFrame:
    """8-bit images go through 255 * gain * (v / 255) ** gamma, cut at 255 and truncated; others through their own range."""
    if gamma < 0:
        raise ValueError("gamma must not be negative")
    if dtype == "uint8":
        return px.withColumn("v", F.floor(F.least(255 * gain * F.pow(c("v") / 255, F.lit(gamma)), F.lit(255.0))).cast("double"))
    zero = F.lit(0.0)
    v = gain * F.pow(_rescaled(c("v"), F.greatest(c("lo"), zero), F.greatest(c("hi"), zero), zero, F.lit(1.0)), F.lit(gamma))
    return _ranged(px).withColumn("v", _whole(v) if dtype in LIMITS else v).drop("lo", "hi")


def _curved(px: DataFrame, curve, dtype: str) -> DataFrame:
    zero = F.lit(0.0)
    unit = _ranged(px).withColumn("t", curve(_rescaled(c("v"), F.greatest(c("lo"), zero), F.greatest(c("hi"), zero), zero, F.lit(1.0))))
    ends = unit.groupBy("image_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    v = _rescaled(c("t"), c("t0"), c("t1"), c("lo"), c("hi"))
    return unit.join(ends, "image_id").withColumn("v", _whole(F.round(v, 9)) if dtype in LIMITS else v).drop("lo", "hi", "t", "t0", "t1")


def adjust_log(px: DataFrame, gain: float = 1.0, dtype: str = "uint8") -> DataFrame:
    return _curved(px, lambda t: gain * F.log2(t + 1), dtype)


def adjust_exp(px: DataFrame, gain: float = 1.0, dtype: str = "uint8") -> DataFrame:
    return _curved(px, lambda t: F.exp(gain * t) - 1, dtype)


def adjust_linear(px: DataFrame, out_range=(0.0, 255.0), in_range=None) -> DataFrame:
    """Maps ``in_range`` (the image's own by default) to ``out_range``."""
    a, b = (c("lo"), c("hi")) if in_range is None else map(F.lit, map(float, in_range))
    rows = _ranged(px)
    return rows.withColumn("v", _rescaled(c("v"), a, b, *(F.lit(float(x)) for x in out_range))).drop("lo", "hi")


def binarize(px: DataFrame, threshold: float | DataFrame) -> DataFrame:
    """v > threshold, a number or rows of (image_id, [y, x,] th)."""
    if isinstance(threshold, DataFrame):
        px = px.join(threshold, [k for k in ("image_id", "y", "x") if k in threshold.columns])
        return px.withColumn("v", (c("v") > c("th")).cast("double")).drop("th")
    return px.withColumn("v", (c("v") > threshold).cast("double"))


def invert(px: DataFrame, dtype: str = "uint8") -> DataFrame:
    low, high = LIMITS.get(dtype, (-1, 0))
    return px.withColumn("v", (high - c("v")) if low == 0 else -c("v"))


def quantise(px: DataFrame, method: str = "sqr", mod: int = 16) -> DataFrame:
    """Classes of values 0..255: integer square root, integer log2, or blocks of ``mod`` with 0 apart."""
    v = c("v")
    how = {"sqr": F.floor(F.sqrt(v)), "log": F.when(v > 0, F.floor(F.log2(F.greatest(v, F.lit(1.0))))).otherwise(0), "linear": F.when(v == 0, 0).otherwise(F.floor(v / mod) + 1)}
    return px.withColumn("v", how[method].cast("double"))


def checked(px: DataFrame) -> DataFrame:
    """Fails on a value that is null, not a number or infinite."""
    bad = c("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    return px.withColumn("v", F.when(F.assert_true(~bad, F.lit("values must be finite")).isNull(), c("v")))
