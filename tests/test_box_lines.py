"""Boxes by lines give what boxes by cells give, at every border."""

import numpy as np
from pyspark.sql import functions as F

from tesserae.functions import kernels as K
from tesserae.functions.borders import MODES
from tesserae.operators import neighbourhood as N


def test_boxes_by_lines(spark):
    data = np.random.default_rng(3).integers(-50, 50, (7, 9))
    px = spark.createDataFrame([(1, 7, 9, y, x, float(v)) for (y, x), v in np.ndenumerate(data)], "image_id long, h int, w int, y int, x int, v double").coalesce(1)
    box = K.box(3, 5)
    for mode in MODES:
        got, want = N.local_max_filter(px, box, mode, 4.0), N.gathered(px, K.taps(box), mode, 4.0, v=F.max("v"))
        assert sorted(got.collect()) == sorted(want.collect()), mode
