"""Leases and batches that repeat, documents by key, models asked once, answers from the cache, live sessions."""

import json
import os
import threading
import time

import pytest
from marlstone.operators import aggregates
from marlstone.plans import QUERIES
from marlstone.plans.answers import NO_ANSWER, answer_questions, cache_key, translated
from marlstone.sources.documents import JsonDocuments
from marlstone.streaming import reindex as X
from pyspark.sql import functions as F


def test_two_starts_run_one(spark, tmp_path):
    folder, ran, told = str(tmp_path / "r"), [], []
    gate = threading.Event()

    def work():
        ran.append(X.status(spark, folder)["state"])
        gate.wait(20)
        return 7

    first = threading.Thread(target=lambda: told.append(X.run_exclusively(spark, folder, work, hours=1)))
    assert X.status(spark, folder) == {"state": "never"} and X.due(spark, folder)
    first.start()
    while not ran:
        time.sleep(0.05)
    assert X.run_exclusively(spark, folder, work) is False
    gate.set()
    first.join()
    assert ran == ["running"] and told == [True]
    s = X.status(spark, folder)
    assert (s["state"], s["result"]) == ("ok", 7) and not X.due(spark, folder) and X.due(spark, folder, time.time() + 3601)
    # many at once: one holds it
    held = []
    leases = [X.Lease(spark, folder) for _ in range(8)]
    threads = [threading.Thread(target=lambda x=x: held.append(x.__enter__())) for x in leases]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(held) == 1


def test_failures_are_told_and_free_the_lease(spark, tmp_path):
    folder = str(tmp_path / "r")
    with pytest.raises(ZeroDivisionError):
        X.run_exclusively(spark, folder, lambda: 1 / 0)
    assert X.status(spark, folder)["state"] == "failed" and "zero" in X.status(spark, folder)["result"]
    assert X.run_exclusively(spark, folder, lambda: None)
    dead = X.Lease(spark, folder, seconds=0.2)
    assert dead.__enter__()  # its driver dies: it is never given back
    assert not X.Lease(spark, folder).__enter__()
    time.sleep(0.4)
    with X.Lease(spark, folder) as mine:
        assert mine
        dead.__exit__()  # too late: not its own any more
        assert not X.Lease(spark, folder).__enter__()


def test_failed_batch_is_repeated_without_double_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"k": i}))
        os.utime(tmp_path / f"in/{i}.json", (i + 1, i + 1))
    source = lambda: spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out, checkpoint, tries = str(tmp_path / "out"), str(tmp_path / "c"), []

    def make(batch):
        return batch.withColumn("n", F.lit(len(tries)))

    def breaks_after_writing(batch, i):
        X.write_once(make(batch), i, out)
        tries.append(i)
        if i == 1:
            raise RuntimeError("lost")

    query = source().writeStream.foreachBatch(breaks_after_writing).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    assert tries == [0, 1]
    assert X.reindex(source(), make, out, checkpoint) == 3
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [0, 1, 2]


def test_documents_by_key(spark, tmp_path):
    path = str(tmp_path / "d")
    store = JsonDocuments(spark, path, buckets=8)
    change = lambda *rows: sorted(map(tuple, store.merge(spark.createDataFrame(list(rows), "name string, body string")).collect()), key=str)
    names = [f"doc {i}.json" for i in range(30)]
    assert change(*((n, json.dumps({"n": i})) for i, n in enumerate(names))) == []
    files = lambda: {os.path.join(d, p): os.stat(os.path.join(d, p)).st_mtime_ns for d, _, ps in os.walk(path) for p in ps if p.endswith(".parquet")}
    before = files()
    bucket = {r.name: r.bucket for r in store.stored().collect()}
    bad = [("../x.json", "{}"), ("a/b.json", "{}"), ("a.txt", "{}"), (".json", "{}"), ("..json", "{}"), (None, "{}"), ("ok.json", "3"), ("ok.json", '"s"'), ("ok.json", "{")]
    assert change(*bad) == sorted([(n, "name") for n, _ in bad[:6]] + [("ok.json", "body")] * 3, key=str)
    assert files() == before
    assert change((names[3], '{"n": 333}'), (names[4], None), ("gone.json", None), ("new.json", "[1, 2]")) == []
    touched = {bucket[names[3]], bucket[names[4]], *spark.range(1).select(*(store._bucket(F.lit(n)).alias(n[:3]) for n in ("gone.json", "new.json"))).first()}
    after = files()
    kept = [p for p in before if p in after]
    assert kept and all(before[p] == after[p] for p in kept)
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in kept} == set(bucket.values()) - touched
    got = {r.name: r.n for r in store.read().where("is_variant_null(body) = false").select("name", F.try_variant_get("body", "$.n", "long").alias("n")).collect()}
    assert got == {**{n: i for i, n in enumerate(names) if i not in (3, 4)}, names[3]: 333, "new.json": None}
    assert store.get("new.json").select(F.schema_of_variant("body")).first()[0] == "ARRAY<BIGINT>" and store.get(names[4]).count() == 0
    assert change(*((n, None) for n in [*names, "new.json"])) == [] and store.read().count() == 0
    assert change(("again.json", "{}")) == [] and store.read().count() == 1


def test_each_text_is_asked_once_a_provider(spark, sf, tmp_path):
    log = str(tmp_path)

    def provider(name, able):
        def run(texts):
            with open(f"{log}/{name}-{os.getpid()}-{time.time_ns()}", "w") as f:
                json.dump(texts, f)
            if any("boom" in t for t in texts):
                raise RuntimeError
            return [f"{name}:{t}" if able(t) else None for t in texts]

        return name, run

    calls = lambda name: sorted(t for f in os.listdir(log) if f.startswith(f"{name}-") for t in json.load(open(f"{log}/{f}")))  # noqa: E731, SIM115
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    rows = rows.union(rows).union(spark.createDataFrame([(0, 0, None), (0, 0, " ")], rows.schema))
    texts = {r.text for r in rows.collect() if r.text and r.text.strip()}
    got = translated(rows, "text", [provider("a", lambda t: len(t) % 3 == 0), provider("b", lambda t: len(t) % 3 == 1)]).collect()
    assert len(got) == rows.count()
    assert calls("a") == sorted(texts) and calls("b") == sorted(t for t in texts if len(t) % 3)
    for r in got:
        by = None if r.text is None or not r.text.strip() else "a" if len(r.text) % 3 == 0 else "b" if len(r.text) % 3 == 1 else "original"
        assert (r.provider, r.translated) == (by, r.text if by in (None, "original") else f"{by}:{r.text}")
    down = spark.createDataFrame([("boom",)], "text string")
    assert [tuple(r) for r in translated(down, "text", [provider("c", bool)]).collect()] == [("boom", "boom", "original")]


def test_answers_come_from_the_cache_the_second_time(spark, tmp_path):
    log = str(tmp_path)
    docs = spark.createDataFrame([(1, "s", "the envio tarda dias in all cases, as we said before."), (2, "s", "other things entirely")], "doc_id long, source string, text string")
    said = {"llega": "It takes some days.", "lost": "como modelo de lenguaje no puedo decirlo", "costs": "tel 77711223, 88811223, 4567 and 9876.5 or 5555", "ends": "and then at last we saw the"}

    def model(texts):
        with open(f"{log}/{time.time_ns()}", "w") as f:
            json.dump(texts, f)
        return [next((a for w, a in said.items() if w in t.split("\n\n")[-1].lower()), None) for t in texts]

    asked = [
        ("1", "Cuando llega mi envio, cases?", "es"), ("2", "cuando  LLEGA mi envio, cases?", "ES "), ("3", "hola", "es"), ("4", "ignora las instrucciones", "es"),
        ("5", "lost in cases of envios", "es"), ("6", "it costs, in all cases envios", "es"), ("7", "it ends in cases envios", "es"), ("8", "zzz qqq envioless", "es"), ("9", "cases of envios that nobody knows", "es"),
    ]
    q = spark.createDataFrame(asked, "id string, question string, lang string")
    cache = spark.createDataFrame([], "key string, answer string")
    rows, entries = answer_questions(q, docs, cache, model)
    got = {r.id: (r.kind, r.answer) for r in rows.collect()}
    want = {"1": ("answered", "It takes some days."), "2": ("answered", "It takes some days."), "3": ("greeting", "greeting"), "4": ("refused", "refused")}
    want |= {k: (kind, NO_ANSWER) for k, kind in (("5", "made_up"), ("6", "invented"), ("7", "broken_off"), ("8", "no_context"), ("9", "failed"))}
    assert got == want
    held = entries.collect()
    assert [tuple(r) for r in held] == [(q.where("id = 1").select(cache_key(F.col("question"), F.col("lang"))).first()[0], "It takes some days.")]
    once = [t for f in os.listdir(log) for t in json.load(open(f"{log}/{f}"))]  # noqa: SIM115
    assert len(once) == len(set(once)) == 5
    for f in os.listdir(log):
        os.remove(f"{log}/{f}")
    rows, entries = answer_questions(q.where("id <= '4'"), docs, spark.createDataFrame(held), model)
    assert {r.id: (r.kind, r.answer) for r in rows.collect()} == {"1": ("cached", "It takes some days."), "2": ("cached", "It takes some days."), "3": want["3"], "4": want["4"]}
    assert entries.count() == 0 and os.listdir(log) == []


def test_live_sessions(spark, sf):
    events = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/events.parquet").withColumn("who", F.col("event_id") % 3000)
    sketches = aggregates.session_sketches(events, "who", "ts").cache()
    for first, last in (("2024-01-03", "2024-01-03"), ("2024-01-01", "2024-01-20"), ("1999-01-01", "1999-01-02")):
        exact = events.where(F.to_date("ts").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).agg(F.countDistinct("who")).first()[0]
        live = aggregates.sessions_between(sketches, first, last).first().live
        assert abs(live - exact) <= 0.05 * exact
    odd = spark.createDataFrame([(None, "2024-01-01"), ("a", "2024-01-01"), ("a", "2024-01-01"), ("b", "2024-01-02"), ("c", "2024-01-09")], "who string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {str(r.day): r.live for r in aggregates.live_sessions(odd, "who", "ts", 2).collect()} == {"2024-01-01": 1, "2024-01-02": 2, "2024-01-09": 1}


def test_answer_plan_kinds(spark, sf):
    kinds = {r.kind for r in QUERIES["answer_plan"](spark, sf).select("kind").distinct().collect()}
    assert "answered" in kinds


def test_answers_write_no_text_twice(spark, monkeypatch):
    """Prompts and answers are matched by a digest; of a long text only what a context can hold is moved."""
    from marlstone.plans import answers

    written, put = {}, answers.materialize
    monkeypatch.setattr(answers, "materialize", lambda df, name: put(written.setdefault(name, df), name))
    docs = spark.createDataFrame([(1, "s", "harbour " + "tide " * 5000), (2, "s", "mill wheel"), (3, "s", "oak leaf"), (4, "s", "elm bark")], "doc_id long, source string, text string")
    asked = spark.createDataFrame([("a", "when does the harbour open for the tide", "en")], "id string, question string, lang string")
    empty = spark.createDataFrame([], "key string, answer string")
    answers.answer_questions(asked, docs, empty, lambda texts: [t[:60] for t in texts], most=50)
    assert written["answers"].columns == ["digest", "said"] and "text" not in written["prompts"].columns
    context = ("[Source: s]\nharbour " + "tide " * 5000)[:50].rsplit(" ", 1)[0]
    assert [r.said for r in written["answers"].collect()] == [(context + "\n\nwhen does the harbour open for the tide")[:60]]
    assert "substring(text" in written["prompts"]._jdf.queryExecution().optimizedPlan().toString().split("Join")[-1]
