"""Sizes of flattened layers against plain division."""

import time

import numpy as np
from pyspark.sql import functions as F

from tarnlake.operators import traces as T


def test_heights_against_plain_division():
    n = np.asarray([-3, 0, 1, 2, 3, 4, 16, 97, 97, 98, 9409, 10403, 65536, *range(200)])
    want = [max([h for h in range(1, int(max(v, 0) ** 0.5) + 1) if v % h == 0], default=1) for v in n.tolist()]
    assert T.heights(n).tolist() == want and T.heights(n[:0]).tolist() == []


def test_equal_numbers_of_places_are_sized_once(spark):
    """3,000 layers of a prime number of places, whose root is 46,340: a scan per row takes minutes."""
    rows = spark.range(3000).select((F.col("id") % 3).alias("layer"), F.lit(4 * 2147483629).alias("flat"), F.lit(4).alias("channels"))
    odd = spark.createDataFrame([(0, 4 * 77, 4), (1, 3, 4), (2, None, 4), (3, None, 4), (4, 240, 4)], "layer long, flat long, channels int")
    began = time.time()
    got = {r.layer: (r.h, r.w) for r in T.common_resolution(rows.unionByName(odd.select("layer", F.col("flat"), "channels")), "layer", "flat", "channels").collect()}
    assert got == {0: (1, 11), 1: (1, 0), 2: (1, 2147483629), 3: (1, None), 4: (2, 30)}
    assert time.time() - began < 40
