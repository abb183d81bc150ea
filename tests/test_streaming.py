import datetime as dt
import json
import random
import socket
import threading
import time

from pyspark.sql import functions as F

from tests.conftest import rows_of

from tessera.sources.readers import file_stream, push_stream, socket_json
from tessera.streaming import reservoir, windows
from tessera.streaming.sinks import appending

SCHEMA = "city string, seen_at timestamp"


def test_sliding_windows_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    start = dt.datetime(2023, 1, 1)
    rows = [(rng.choice(["a", "b", "", "Zürich", "x y", None]), start + dt.timedelta(seconds=rng.random() * 90)) for _ in range(120)]
    rows.sort(key=lambda r: r[1])
    folder = str(tmp_path / "in")
    for i in range(0, 120, 40):
        spark.createDataFrame(rows[i : i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([("end", start + dt.timedelta(days=1))], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = windows.sliding_distinct(file_stream(spark, folder, SCHEMA, per_trigger=10), "seen_at", "city")
    q = stream.writeStream.format("memory").queryName("sliding").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = windows.sliding_distinct(spark.createDataFrame(rows, SCHEMA), "seen_at", "city")
    assert rows_of(spark.table("sliding"), "window", "distinct", "estimate") == rows_of(batch, "window", "distinct", "estimate")


def test_appended_csv(spark, tmp_path):
    folder = str(tmp_path / "in")
    start = dt.datetime(2023, 1, 1)
    spark.createDataFrame([("a", start), ("b", start), ("z", start + dt.timedelta(days=1))], SCHEMA).write.parquet(folder)
    stream = windows.sliding_distinct(file_stream(spark, folder, SCHEMA, per_trigger=10), "seen_at", "city")
    windows.append_csv(stream, str(tmp_path / "out.csv"), str(tmp_path / "c"), {"availableNow": True}).awaitTermination(120)
    lines = (tmp_path / "out.csv").read_text().splitlines()
    assert lines[0] == "Time,Ground Truth,Estimation" and lines[1].startswith("2023-01-01 00:00:10,2,") and len(lines) == 4


def test_reservoir_rules():
    r = reservoir.Reservoir(capacity=2, seed=3)
    assert not r.offer(None) and not r.offer([]) and not r.offer(["é"]) and r.n == 0
    assert r.offer(["a", "é", None]) and r.offer(["b"]) and r.kept == [["a"], ["b"]]
    for i in range(500):
        r.offer([f"t{'x' * (i % 7)}"])
    assert r.n == 502 and len(r.kept) == 2
    assert reservoir.trending({"a": 3, "b": 3, "c": 2, "d": 1, "e": 0, "f": 1}) == [("a", 3), ("b", 3), ("c", 2), ("d", 1), ("f", 1)]


def test_reservoir_is_uniform():
    hits = [0] * 40
    for seed in range(600):
        r = reservoir.Reservoir(capacity=10, seed=seed)
        for i in range(40):
            r.offer(["a" * (i + 1)])
        for (t,) in r.kept:
            hits[len(t) - 1] += 1
    assert sum((h - 150) ** 2 / 150 for h in hits) < 80  # 39 degrees of freedom


def test_trending_stream_equals_a_replay(spark, tmp_path):
    start = dt.datetime(2023, 1, 1)
    rows = [([(t,) for t in ("ab"[i % 2], "c")], start + dt.timedelta(seconds=i)) for i in range(30)] + [(None, start), ([], start)]
    schema = "hashtags array<struct<text: string>>, posted_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = reservoir.trending_stream(file_stream(spark, str(tmp_path / "in"), schema), capacity=5, seed=1)
    stream.writeStream.format("memory").queryName("trending").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    own = reservoir.Reservoir(5, 1)
    for tags, _ in rows[:30]:
        own.offer([t for (t,) in tags])
    assert [(r["n"], r["tag"], r["count"]) for r in spark.table("trending").collect()] == [(30, t, n) for t, n in reservoir.trending(own.counts())]


def test_report_after_each_post(spark, tmp_path):
    start = dt.datetime(2023, 1, 1)
    schema = "hashtags array<struct<text: string>>, posted_at timestamp"
    rows = [([("a",)], start), ([("é",)], start + dt.timedelta(seconds=1)), ([("b",), ("a",)], start + dt.timedelta(seconds=2))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    reports = reservoir.trending_stream(file_stream(spark, str(tmp_path / "in"), schema), capacity=5, each_post=True)
    reservoir.append_blocks(reports, str(tmp_path / "out.txt"), str(tmp_path / "c"), {"availableNow": True}).awaitTermination(120)
    head = "The number of tweets with tags from the beginning: "
    assert (tmp_path / "out.txt").read_text() == f"{head}1\na: 1\n\n{head}2\na: 2\nb: 1\n\n"


def test_merged_samples_equal_the_sample_of_all(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "post_id")
    whole = rows_of(reservoir.smallest_hashes(df, "post_id", 20, 4))
    parts = reservoir.smallest_hashes(df.filter("post_id < 200"), "post_id", 20, 4).union(reservoir.smallest_hashes(df.filter("post_id >= 200"), "post_id", 20, 4))
    assert rows_of(reservoir.smallest_hashes(parts, "post_id", 20, 4)) == whole
    assert df.filter(F.lit(False)).count() == 0


def test_a_batch_of_many_pieces_is_taken_in_order(spark, tmp_path):
    start = dt.datetime(2023, 1, 1)
    rows = [([(f"{chr(97 + i % 26)}{chr(97 + i % 11)}",)], start + dt.timedelta(seconds=(i * 7919) % 10_501 // 3)) for i in range(10_501)]
    schema = "hashtags array<struct<text: string>>, posted_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = reservoir.trending_stream(file_stream(spark, str(tmp_path / "in"), schema, per_trigger=10), capacity=50, seed=3)
    stream.writeStream.format("memory").queryName("pieces").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    own = reservoir.Reservoir(50, 3)
    for tags, _ in sorted(rows, key=lambda r: (r[1], r[0][0][0])):
        own.offer([t for (t,) in tags])
    assert [(r["n"], r["tag"], r["count"]) for r in spark.table("pieces").collect()] == [(10_501, t, n) for t, n in reservoir.trending(own.counts())]


def test_batches_are_appended_once(tmp_path):
    path = tmp_path / "out.csv"
    path.write_text("of an earlier run")
    for batch, text in ((0, "a\n"), (1, "b\n"), (1, "b\n"), (2, "c\n")):
        with appending(path, batch, "head\n") as f:
            f.write(text)
    try:
        with appending(path, 3) as f:
            f.write("half of ")
            f.flush()
            raise OSError
    except OSError:
        pass
    with appending(path, 3) as f:
        f.write("d\n")
    assert path.read_text() == "head\na\nb\nc\nd\n"


def test_a_restart_goes_on_with_the_file(spark, tmp_path):
    folder, start = str(tmp_path / "in"), dt.datetime(2023, 1, 1)
    run = lambda: windows.append_csv(windows.sliding_distinct(file_stream(spark, folder, SCHEMA, per_trigger=10), "seen_at", "city"), str(tmp_path / "o.csv"), str(tmp_path / "c"), {"availableNow": True}).awaitTermination(120)
    spark.createDataFrame([("a", start), ("z", start + dt.timedelta(days=1))], SCHEMA).write.parquet(folder)
    run()
    before = (tmp_path / "o.csv").read_text()
    spark.createDataFrame([("b", start + dt.timedelta(days=2))], SCHEMA).write.mode("append").parquet(folder)
    run()
    after = (tmp_path / "o.csv").read_text()
    assert after.startswith(before) and len(before.splitlines()) == 4 and len(after.splitlines()) == 7 and after.count("Time") == 1


def test_lines_from_a_socket(spark, tmp_path):
    server = socket.create_server(("localhost", 0))
    lines = [{"city": "Oslo"}, {"city": None}, {"city": "x" * 5000}, {"other": 1}]

    def serve():
        client, _ = server.accept()
        for x in lines:
            client.sendall((json.dumps(x) + "\n").encode())
        client.sendall(b"no json\n")
        done.wait(60)
        client.close()

    done = threading.Event()
    threading.Thread(target=serve, daemon=True).start()
    q = socket_json(spark, server.getsockname()[1], "city string").writeStream.format("memory").queryName("heard").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(240):
            if spark.table("heard").count() >= 5:
                break
            time.sleep(0.25)
        rows = spark.table("heard").collect()
    finally:
        q.stop()
        done.set()
    assert sorted(str(r["city"]) for r in rows) == sorted(["Oslo", "None", "x" * 5000, "None", "None"]) and all(r["seen_at"] for r in rows)


def test_pushed_messages(spark, tmp_path):
    posts = [{"hashtags": [{"text": f"t{i % 3}"}], "posted_at": i} for i in range(200)] + [{"hashtags": None}]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, posts)) + "\nno json\n")
    stream = push_stream(spark, str(tmp_path / "m.json"), "hashtags array<struct<text: string>>, posted_at long", per_second=2000)

    q = stream.writeStream.format("memory").option("checkpointLocation", str(tmp_path / "c")).queryName("pushed").start()
    try:
        for _ in range(240):
            if spark.table("pushed").count() >= 202:
                break
            time.sleep(0.25)
        rows = spark.table("pushed").collect()
    finally:
        q.stop()
    assert sorted(r["posted_at"] for r in rows if r["posted_at"] is not None) == list(range(200)) and len(rows) == 202
    assert {r["hashtags"][0]["text"] for r in rows if r["hashtags"]} == {"t0", "t1", "t2"}
