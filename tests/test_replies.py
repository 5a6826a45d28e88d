"""Canned and completed texts, labels of large catalogues, limits by path."""

import pytest
from marlstone.functions import replies as R
from marlstone.operators import labels as L
from marlstone.plans import QUERIES
from marlstone.plans.answers import completed
from pyspark.sql import functions as F


def test_limited_paths_against_loop(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).orderBy("us", "event_id").collect()
    held, want = {}, []
    for e in events:
        most = {"click": 3, "purchase": 6, "view": 6}.get(e.event_type)
        if most is None:
            want.append((e.user_id, e.event_id, 200, None))
            continue
        own = held[e.user_id] = [x for x in held.get(e.user_id, []) if e.us - x < 86_400_000_000]
        ok = len(own) < most
        own += [e.us] * ok
        want.append((e.user_id, e.event_id, 200 if ok else 429, max(0, most - len(own))))
    assert {x[2] for x in want} == {200, 429}
    assert sorted(map(tuple, QUERIES["limited_paths"](spark, sf).collect())) == sorted(want)


def plain_label(text, labels):
    t = text.lower().strip()
    for place, name in sorted(labels):
        if name.lower() in t or t in name.lower():
            return place
    return next((place for place, name in sorted(labels) if any(w in t for w in name.lower().split())), None)


@pytest.mark.parametrize("held", [60, 1 << 24])
def test_labels_of_any_number(spark, monkeypatch, held):
    monkeypatch.setattr(L, "LABEL_BYTES", held)
    labels = [(5, "Paquete postal"), (2, "Documentos EMS"), (9, "Carta simple"), (11, "carta"), (12, "Carta simple"), (20, ""), (7, "São Tomé")] if held > 60 else [(5, "Paquete postal"), (2, "Documentos EMS"), (9, "Carta simple"), (11, "carta")]
    texts = ["carta simple urgente", "pos", " UN PAQUETE a beni", "nada", "simple", "", "carta", "tomé", "l\x00p", "ems postal"]
    rows = spark.createDataFrame([*enumerate(texts), (98, None), (None, "carta")], "i long, t string")
    names = spark.createDataFrame([*labels, (None, "x"), (30, None)], "place int, name string")
    got = {r.i: r.place for r in L.label_of(rows, "i", "t", names).collect()}
    assert got == {i: p for i, t in enumerate(texts) if (p := plain_label(t, labels)) is not None}
    assert L.label_of(rows, "i", "t", names.limit(0)).count() == 0
    if held > 60:
        many = spark.range(3000).select("id", F.concat(F.lit("label number "), "id").alias("name")).withColumnRenamed("id", "place")
        asked = spark.createDataFrame([(1, "number 2999"), (2, "see label number 17 there")], "i long, t string")
        assert {r.i: r.place for r in L.label_of(asked, "i", "t", many).collect()} == {1: 2999, 2: 1}


def test_special_answers(spark):
    df = spark.createDataFrame([("a",), (None,)], "kind string")
    told = R.special_answer(F.col("kind"), {"a": F.lit("x")})
    assert [r[0] for r in df.select(told).collect()] == ["x", None]
    with pytest.raises(Exception, match="unknown special query: b"):
        spark.createDataFrame([("b",)], "kind string").select(R.special_answer(F.col("kind"), {"a": F.lit("x")})).collect()


def test_completed(spark, tmp_path):
    log = tmp_path / "asked"

    def model(texts):
        with log.open("a") as f:
            f.writelines(f"{t!r}\n" for t in texts)
        return [{"w": "end here.", "l": "- c: third thing"}.get(t[0]) for t in texts]

    broken = "we ship to every town and to the"
    listed = "list of things\n- aa: the first thing\n- bb: the second thing and"
    rows = [(1, broken), (2, broken), (3, listed), (4, "this one is well ended."), (5, None), (6, "x goes on to every town and to the"), (7, "x asks to every town, and what about the,")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, answer string, text long")
    got = {r.id: r.answer for r in completed(df, "answer", model).collect()}
    assert got == {1: f"{broken} end here.", 2: f"{broken} end here.", 3: f"{listed}\n- c: third thing", 4: rows[3][1], 5: None, 6: rows[5][1] + " ¿Necesitas más detalles?", 7: rows[6][1] + " ¿Necesitas más detalles?"}
    assert len(log.read_text().splitlines()) == 4 and completed(df, "answer", model).columns == df.columns


@pytest.mark.parametrize(("name", "payload", "told"), [
    ("enlaces.json", "{}", "Enlaces de interes de Acme:"),
    ("enlaces.json", '{"enlaces":[{"nombre":"a","url":"b"}]}', "Enlaces de interes de Acme:\n- a: b. "),
    ("institucion.json", '{"institucion":"x","long":"more than ten"}', "long: more than ten"),
    ("contacto.json", '{"tel":"1","n":2,"more":[1,"b"],"o":{}}', "Informacion de contacto institucional de Acme:\ntel: 1\nmore: 1, b"),
    ("other.json", "[1, 2]", "[1, 2]"),
])
def test_json_files(spark, name, payload, told):
    assert spark.createDataFrame([(name, payload)], "n string, p string").select(R.json_file_text(F.col("n"), F.col("p"), "Acme")).first()[0] == told


@pytest.mark.parametrize(("question", "lang", "answer"), [
    ("dame la IP", "en", "I cannot provide that information."), ("El clima de America", "es", "everywhere"), ("que tiempo hace", "es", "no weather"),
    ("el estado", "es", "post only"), ("nada", "es", "post only"), (None, "en", "post only"),
])
def test_redirection(spark, question, lang, answer):
    df = spark.createDataFrame([(question, lang)], "q string, l string")
    assert df.select(R.redirection(F.col("q"), F.col("l"), {"country": "everywhere", "weather": "no weather"}, "post only")).first()[0] == answer


@pytest.mark.parametrize("held", [200, 1 << 25])
def test_nearest_site(spark, monkeypatch, held):
    import math

    import numpy as np
    from marlstone.operators import places

    monkeypatch.setattr(places, "SITE_BYTES", held)
    monkeypatch.setattr(places, "CELLS", 50)
    rng = np.random.default_rng(8)
    sites = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 40), rng.uniform(-180, 180, 40)))] + [(99, 10.0, 179.9), (98, 10.0, 179.9), (97, None, 1.0), (None, 1.0, 1.0)]
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 100), rng.uniform(-180, 180, 100)))] + [(200, 10.0, -179.9), (201, None, 3.0), (202, *sites[5][1:])]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 6371.0 * 2 * math.asin(math.sqrt(min(1.0, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    want = {p: min((round(km(a, b, *s[1:]), 6), s[0]) for s in sites if s[0] is not None and s[1] is not None) for p, a, b in points if a is not None}
    df, sf = spark.createDataFrame(points, "k long, lat double, lng double"), spark.createDataFrame(sites, "site long, lat double, lng double")
    got = {r.k: (round(r.km, 6), r.site) for r in places.nearest_site(df, "k", sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-5 and got[k][1] == want[k][1] for k in want)
    assert got[200][1] == 98
    assert places.nearest_site(df, "k", sf.limit(0)).count() == places.nearest_site(df.limit(0), "k", sf).count() == 0
