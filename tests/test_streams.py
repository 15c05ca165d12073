"""Keyed work from a state store, paced calls and a paged search as a stream: restarts, late events, clocks."""

import json
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from scholia.plans import providers as G
from scholia.sources.search import SearchSource, SearchStreamReader
from scholia.streaming import incremental as I

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(k, T0 + timedelta(minutes=m), s) for k, m, s in rows], "k string, ts timestamp, status string")


def test_keyed_work_over_restarts(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))

    def run(rows):
        events(spark, rows).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("k string, ts timestamp, status string").parquet(src)
        I.run_once(I.keyed_work(stream, "k", "ts", "status", "10 minutes", 3, "5 minutes"), out, ck)
        got = spark.read.parquet(out).collect()
        return sorted((r["k"], r["action"], r["failures"]) for r in got)

    one = run([("a", 0, "extracted"), ("a", 1, "completed"), ("b", 0, "error"), ("c", 2, "extracted")])
    assert one == [("a", "done", 0), ("a", "start", 0), ("b", "start", 0), ("c", "start", 0)]
    # nothing new: a restart repeats nothing; then time passes, and b is asked for again once
    two = run([("c", 30, "completed"), ("a", 31, "error")])
    assert two == sorted([*one, ("c", "done", 0), ("b", "retry", 1)])
    # late events below the watermark count for a key that is not done, and a done key stays done
    three = run([("b", 32, "error"), ("b", 33, "cancelled"), ("a", 34, "extracted"), ("d", 34, "low_score")])
    assert three == sorted([*two, ("b", "give_up", 3), ("d", "start", 0), ("d", "done", 0)])
    four = run([("e", 300, "extracted")])
    assert four == sorted([*three, ("e", "start", 0)])


def test_fresh_keys_once(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))
    for rows in ([("a", 0, "x"), ("b", 0, "x"), ("a", 1, "x")], [("b", 5, "x"), ("c", 6, "x")], []):
        if rows:
            events(spark, rows).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("k string, ts timestamp, status string").parquet(src)
        I.append_new(stream, out, ck, "k", "ts", "1 day", lambda df: df.select("k"))
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def test_bucket_holds_the_global_rate():
    made = []
    limit = G.Limit(4.0, tasks=3)
    for task in range(3):  # tasks run side by side, each on its own clock
        clock = Clock()
        bucket = G.Bucket(limit.rate / limit.tasks, 1, clock, clock.sleep)
        G.paced([f"{task}-{k}" for k in range(20)], lambda p, c=clock: [made.append(c()) or "x" for _ in p], bucket, 64)
    made.sort()
    for start in made:  # in every span of ten seconds at most rate * 10 calls and one at once for each task
        assert sum(start <= t < start + 10 for t in made) <= 4.0 * 10 + 3
    assert max(made) >= 60 / 4.0 - 3 / 4.0 - 1e-6
    clock = Clock()
    lazy = G.Bucket(1.0, 2, clock, clock.sleep)
    clock.now = 100.0  # idle time does not pile up beyond the burst
    times = []
    for _ in range(5):
        lazy.take()
        times.append(clock.now)
    assert times == [100.0, 100.0, 101.0, 102.0, 103.0]
    again = G.Limit(2.0, 1, clock, clock.sleep).bucket(attempt=1)
    before = clock.now
    again.take()
    assert clock.now == before + 0.5  # a task that is tried again pays for its lost try


def test_limited_responses_are_the_same(spark):
    prompts = spark.createDataFrame([(k, f"p{k % 30}") for k in range(60)], "k int, prompt string")
    none = spark.createDataFrame([], "prompt_hash string, response string")
    told = lambda limit: sorted(map(str, G.respond(prompts, none, G.stub, limit=limit)[0].collect()))
    assert told(G.Limit(400.0, 3)) == told(None)


def pages(n, limit=2):
    return json.dumps({str(k): {"total": n, "next": k + limit if k + limit < n else None, "data": [{"paperId": f"p{j}", "title": "t"} for j in range(k, min(n, k + limit))]} for k in range(0, max(n, 1), limit)})


def test_search_stream_resumes(spark, tmp_path):
    spark.dataSource.register(SearchSource)
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"

    def run(n):
        stream = spark.readStream.format("search").option("keyword", "k").option("limit", "2").option("most", "100").option("recorded", pages(n)).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r["paper_id"] for r in spark.read.parquet(out).collect())

    assert run(4) == ["p0", "p1", "p2", "p3"]
    assert run(4) == ["p0", "p1", "p2", "p3"]
    assert run(9) == sorted(f"p{k}" for k in range(9))  # each page once, also after restarts
    reader = SearchStreamReader({"recorded": pages(7), "limit": "2", "most": "5"})
    assert reader.latestOffset() == {"next": 5}
    assert [p.offset for p in reader.partitions({"next": 2}, {"next": 5})] == [2, 4]
    assert SearchStreamReader({"recorded": json.dumps({"0": {"data": []}}), "limit": "2"}).latestOffset() == {"next": 0}
