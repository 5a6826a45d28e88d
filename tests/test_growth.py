"""Work that must not grow faster than its input."""

import re

import numpy as np
from marlstone.functions.text import json_to_text
from marlstone.operators import places
from pyspark.sql import functions as F


def test_nearest_of_few_blocks(monkeypatch):
    """The nearest of all places, smallest ids of equally near ones, and few of them compared."""
    monkeypatch.setattr(places, "BLOCK", 16)
    rng = np.random.default_rng(11)
    lat, lng = rng.uniform(-90, 90, 20_000), rng.uniform(-180, 180, 20_000)
    lat[:4], lng[:4] = [90, -90, 0, 0], [10, 0, 180, -180]
    ids = rng.permutation(20_000)
    a, b = np.concatenate([lat[:600], rng.uniform(-90, 90, 400), [0, 90, -90]]), np.concatenate([lng[:600], rng.uniform(-180, 180, 400), [179.9999, 77, 5]])
    sites = places.Sites(ids, lat, lng)
    best, km = sites.nearest(a, b)
    far = places.haversine(a[:, None], b[:, None], lat, lng)
    assert np.allclose(km, far.min(1), rtol=0, atol=1e-9)
    assert (best == [min(ids[np.flatnonzero(row == row.min())]) for row in far]).all()
    assert sites.compared < 0.05 * len(a) * len(ids)


def test_nearest_site_of_each_place_one(spark):
    s = spark.createDataFrame([(9, 1.0, 1.0), (4, 1.0, 1.0), (None, 0.0, 0.0), (5, None, 0.0), (6, float("nan"), 0.0)], "site long, lat double, lng double")
    p = spark.createDataFrame([("a", 1.0, 1.0), ("b", None, 1.0), ("c", 0.0, float("nan"))], "k string, lat double, lng double")
    assert [tuple(r) for r in places.nearest_site(p, "k", s).collect()] == [("a", 4, 0.0)]
    assert places.nearest_site(p, "k", s.limit(0)).count() == 0


def test_json_is_parsed_once_for_texts_and_once_for_kinds(spark):
    out = spark.createDataFrame([('{"a":"long enough text"}',)], "payload string").select(json_to_text(F.col("payload")).alias("t"))
    most = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", most)
    assert len(re.findall(r"from_json\(MapType\(\w+,\w+,true\), payload#", plan)) == 2
    assert out.first().t == "a: long enough text"
