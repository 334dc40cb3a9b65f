import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.operators import observations as O


def test_in_step(spark):
    a = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 3, 9, 3])], "k string, i int, n long")
    b = spark.createDataFrame([("g", j, m) for j, m in enumerate([4, 5, 3, 3])], "k string, j int, m long")
    got = O.in_step(a, b, ["k"], "k string, i int, j int").collect()
    assert sorted((r.i, r.j) for r in got) == [(0, 1), (1, 2), (3, 3)]


def test_relation_vectors(spark):
    t = "array<struct<subject string, relation string, object string>>"
    df = spark.createDataFrame([([("a", "r", "b")],), ([("a", "r", "b"), ("c", "r", "b")],), ([],), (None,)], f"t {t}")
    v = [np.asarray(r.v) for r in df.select(O.relation_vectors("t").alias("v")).collect()]
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-9 and abs(np.linalg.norm(v[1]) - 1) < 1e-9
    assert not v[2].any() and not v[3].any() and 0.3 < v[0] @ v[1] < 0.99
    x, y = np.asarray([1.0, 2, 3, 4]), np.asarray([0.5, 0, -1, 2])
    direct = [sum(x[j] * y[(i - j) % 4] for j in range(4)) for i in range(4)]
    assert np.allclose(O.bound(x, y), direct)


def test_shuffle_is_a_permutation_within_groups(spark):
    df = spark.createDataFrame([(i % 3, i, i * 10) for i in range(60)], "g int, i int, x int")
    once, again, other = (sorted(map(tuple, O.shuffled_within(df, ["g"], ["i"], "x", s).select("g", "i", "x").collect())) for s in (1, 1, 2))
    assert once == again != other
    for g in range(3):
        assert sorted(x for h, _, x in once if h == g) == [i * 10 for i in range(60) if i % 3 == g]


def test_lateral(spark):
    regions = spark.createDataFrame([("Hip",), ("Vermis",), ("None",)], "name string")
    labels = spark.createDataFrame([("Hip_L", 1), ("Hip_R", 2), ("Vermis", 3)], "label string, code int")
    found, missing = O.lateral(regions, labels)
    assert sorted((r.name, r.side, r.code) for r in found.collect()) == [("Hip", "left", 1), ("Hip", "right", 2), ("Vermis", "midline", 3)]
    assert [r.name for r in missing.collect()] == ["None"]


def test_pooling_overlaps_when_it_grows(spark):
    df = spark.createDataFrame([([1.0, 3.0],)], "v array<double>")
    assert df.select(O.pooled(F.col("v"), 2, 3).alias("p")).first().p == [1.0, 2.0, 3.0]


def test_tagged_values_and_what_is_none(spark):
    import datetime

    from tarnlake.functions import text as X

    when = datetime.datetime(2024, 1, 2, 3, 4, 5, 60)
    df = spark.createDataFrame([(1.5, bytearray(b"\x00\xff"), when), (float("inf"), bytearray(b""), when), (None, None, None)], "x double, b binary, t timestamp")
    kinds = {"x": "double", "b": "binary", "t": "timestamp"}
    coded = df.select("*", *[X.tagged(F.col(c), k, "$k").alias(f"{c}_") for c, k in kinds.items()])
    assert [r.x_ for r in coded.collect()] == ["1.5", '{"$k":"float","value":"inf"}', "null"]
    back = coded.select(*[X.untagged(F.col(f"{c}_"), k, "$k").alias(c) for c, k in kinds.items()]).collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in df.collect()]
    for text, kind in (("{}", "double"), ('{"$k":"float","value":"2"}', "double"), ('{"$k":"binary"}', "timestamp"), ("words", "double"), ("7", "binary")):
        with pytest.raises(Exception, match="no (double|binary|timestamp)"):
            spark.createDataFrame([(text,)], "t string").select(X.untagged(F.col("t"), kind, "$k")).collect()


def test_ways_of_sampling(spark):
    df = spark.createDataFrame([(0, "wait"), (1, "up"), (2, None)], "i int, a string")
    assert [r.i for r in O.sampled(df, "non_wait", action="a", waits=("wait",)).collect()] == [1] and O.sampled(df, "all").count() == 3
    with pytest.raises(ValueError, match="no such way"):
        O.sampled(df, "whatever")
