import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import buffer as B
from tidewatch.operators.flows import align_flows
from tidewatch.operators.states import window_states
from tidewatch.sources.log_tail import tail_stream
from tidewatch.streaming import buffer as SB
from tidewatch.streaming import late as SLT
from tidewatch.streaming import logs as SL
from tidewatch.streaming.windows import stream_window_states

from tests.test_buffer import simulate
from tests.test_logs import header

ARRIVAL = "n bigint, sensor_name string, timestamp string, _id string"


def put(spark, folder, rows, schema=ARRIVAL):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def to_rows(batch):
    return B.buffer_rows(batch, seq=F.col("n"), sensor=F.col("sensor_name"))


def run_dual(spark, tmp, **options):
    stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).parquet(str(tmp / "in"))
    SB.start_dual_sink(
        stream,
        str(tmp / "archive"),
        str(tmp / "buffer"),
        str(tmp / "checkpoint"),
        available_now=True,
        to_rows=to_rows,
        **options,
    ).awaitTermination()


def arrivals(count, start=0):
    """Out-of-order arrivals of a busy and a quiet sensor."""
    return [
        (i, "a" if i % 5 else "b", str(1000 + i * 40 + (i * 7919) % 700), f"id{i}")
        for i in range(start, start + count)
    ]


def test_streamed_buffer_equals_simulation(spark, tmp_path):
    rows = arrivals(120)
    for at in range(0, 90, 30):
        put(spark, tmp_path / "in", rows[at : at + 30])
        time.sleep(0.02)
    run_dual(spark, tmp_path)
    put(spark, tmp_path / "in", rows[90:])
    run_dual(spark, tmp_path)  # restart from the checkpoint
    got = SB.read_buffer(spark, str(tmp_path / "buffer")).collect()
    order = [(n, s, float(t), i, i) for n, s, t, i in rows]
    assert sorted((r.sensor, r._id, r.ts_epoch) for r in got) == simulate(order)
    archived = spark.read.option("recursiveFileLookup", "true").csv(str(tmp_path / "archive"), header=True)
    assert archived.count() == 120


def test_replayed_batch_changes_nothing(spark, tmp_path):
    first = spark.createDataFrame(arrivals(30), ARRIVAL).withColumn("_at", F.lit("2024-03-05 10:47:10").cast("timestamp"))
    second = spark.createDataFrame(arrivals(30, 30), ARRIVAL).withColumn("_at", F.lit("2024-03-05 10:48:10").cast("timestamp"))
    write = SB.dual_writer(str(tmp_path / "archive"), str(tmp_path / "buffer"), to_rows)
    write(first, 0)
    write(second, 1)
    before = sorted(map(tuple, SB.read_buffer(spark, str(tmp_path / "buffer")).collect()))
    write(second, 1)
    assert sorted(map(tuple, SB.read_buffer(spark, str(tmp_path / "buffer")).collect())) == before
    archived = spark.read.csv(str(tmp_path / "archive"), header=True)
    assert archived.count() == 60
    assert {(r.date, r.slot) for r in archived.select("date", "slot").distinct().collect()} == {
        ("2024-03-05", "10-47"), ("2024-03-05", "10-48"),
    }


def test_buffer_failure_leaves_the_archive(spark, tmp_path):
    def broken(batch):
        raise RuntimeError("no buffer")

    flows = spark.createDataFrame(arrivals(5), ARRIVAL).withColumn("_at", F.current_timestamp())
    write = SB.dual_writer(str(tmp_path / "archive"), str(tmp_path / "buffer"), broken, fields="n,_id")
    write(flows, 0)
    archived = spark.read.option("recursiveFileLookup", "true").csv(str(tmp_path / "archive"), header=True)
    assert archived.columns == ["n", "_id"] and archived.count() == 5
    assert SB.read_buffer(spark, str(tmp_path / "buffer")).count() == 0


def buffer_files(tmp):
    """Data files of the buffer, with what would change if they were written again."""
    found = {}
    for folder, _, names in os.walk(tmp / "buffer"):
        for n in names:
            if n.endswith(".parquet"):
                st = os.stat(os.path.join(folder, n))
                found[os.path.relpath(os.path.join(folder, n), tmp / "buffer")] = (st.st_ino, st.st_mtime_ns)
    return found


def test_a_batch_rewrites_nothing_and_expired_slots_go(spark, tmp_path):
    folder = str(tmp_path / "buffer")
    all_rows, seen = arrivals(400), {}
    for batch in range(8):
        part = all_rows[batch * 50 : batch * 50 + 50]
        SB.put_batch(to_rows(spark.createDataFrame(part, ARRIVAL)), batch, folder)
        now = buffer_files(tmp_path)
        kept = {k: v for k, v in now.items() if k in seen}
        assert kept == {k: seen[k] for k in kept}
        assert all(f"batch={batch}/" in k for k in now.keys() - seen.keys())
        seen = now
        order = [(n, s, float(t), i, i) for n, s, t, i in all_rows[: batch * 50 + 50]]
        got = SB.read_buffer(spark, folder).collect()
        assert sorted((r.sensor, r._id, r.ts_epoch) for r in got) == simulate(order)
    batches = {k.split("batch=")[1].split("/")[0] for k in seen}
    assert "7" in batches and len(batches) < 5  # the first ones expired, with their summaries
    assert not os.listdir(tmp_path / "buffer" / "open")


@pytest.mark.parametrize("seed", range(3))
def test_batches_in_any_order_of_times(spark, tmp_path, seed):
    """Late flows outlive newer ones that arrived before; folders that hold one must stay."""
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), str(1000 + rng.choice((0, 0, 350, 700, 5000)) + rng.randrange(400)), f"i{i}") for i in range(60)]
    folder = str(tmp_path / "buffer")
    for batch in range(6):
        SB.put_batch(to_rows(spark.createDataFrame(rows[batch * 10 : batch * 10 + 10], ARRIVAL)), batch, folder)
    got = SB.read_buffer(spark, folder).collect()
    order = [(n, s, float(t), i, i) for n, s, t, i in rows]
    assert sorted((r.sensor, r._id, r.ts_epoch) for r in got) == simulate(order)


def test_flows_without_ids_in_batches(spark, tmp_path):
    """Equal flows of two batches both stay, each with an id of its own."""
    folder = str(tmp_path / "buffer")
    flows = spark.createDataFrame([("1000", 1), ("1000", 1), ("1001", 2)], "timestamp string, port int").coalesce(1)
    write = SB.dual_writer(str(tmp_path / "archive"), folder)
    for batch in (0, 1):
        write(flows.withColumn("_at", F.lit("2024-03-05 10:47:10").cast("timestamp")), batch)
    write(flows.withColumn("_at", F.lit("2024-03-05 10:47:10").cast("timestamp")), 1)  # a replay
    got = SB.read_buffer(spark, folder).collect()
    assert len(got) == 6 and len({r._id for r in got}) == 6
    assert sorted(r.arrival_seq for r in got) == [b * 2**SB.BATCH_BITS + i for b in (0, 1) for i in range(3)]
    assert json.loads(got[0].payload).keys() == {"timestamp", "port", "_id"}


def test_failed_batch_is_made_up_from_the_archive(spark, tmp_path):
    rows, fails = arrivals(60), {1}

    def flaky(batch):
        if {r.n // 20 for r in batch.select("n").collect()} & fails:
            raise RuntimeError("no buffer")
        return to_rows(batch)

    write = SB.dual_writer(str(tmp_path / "archive"), str(tmp_path / "buffer"), flaky)
    for batch in range(2):
        flows = spark.createDataFrame(rows[batch * 20 : batch * 20 + 20], ARRIVAL)
        write(flows.withColumn("_at", F.lit("2024-03-05 10:47:10").cast("timestamp")), batch)
    folder = str(tmp_path / "buffer")
    order = [(n, s, float(t), i, i) for n, s, t, i in rows]
    assert sorted((r.sensor, r._id, r.ts_epoch) for r in SB.read_buffer(spark, folder).collect()) == simulate(order[:20])
    assert SB.open_batches(spark, folder) == [1]
    fails.clear()
    write(spark.createDataFrame(rows[40:], ARRIVAL).withColumn("_at", F.current_timestamp()), 2)
    assert sorted((r.sensor, r._id, r.ts_epoch) for r in SB.read_buffer(spark, folder).collect()) == simulate(order)
    assert SB.open_batches(spark, folder) == []


def test_reinserted_text_moves_in_a_stream(spark, tmp_path):
    folder = str(tmp_path / "buffer")

    def put(batch, *items):
        rows = [(batch * 10 + i, "s", float(t), p, p) for i, (t, p) in enumerate(items)]
        SB.put_batch(spark.createDataFrame(rows, B.BUFFER_SCHEMA), batch, folder, supplied_ids=True)

    def held():
        return sorted((r.payload, r.ts_epoch) for r in SB.read_buffer(spark, folder, supplied_ids=True).collect())

    put(0, (1000, "x"), (1010, "y"))
    put(1, (1100, "x"), (1100, "z"))
    assert held() == [("x", 1100), ("y", 1010), ("z", 1100)]
    put(2, (700, "y"), (1050, "w"))  # y moves back in time and expires by the next insert
    put(3, (1100, "v"))
    assert held() == [("v", 1100), ("w", 1050), ("x", 1100), ("z", 1100)]


def test_repeated_ids_are_dropped(spark, tmp_path):
    schema = "_id string, at timestamp"
    base = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "_id string, s bigint")
    base.select("_id", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = SB.without_replays(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "at")
    q = stream.writeStream.format("memory").queryName("ids").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r._id for r in spark.table("ids").collect()) == ["a", "b"]


def start_logs(spark, tmp, totals=None, **options):
    lines = SL.log_stream(spark, str(tmp / "logs"), **options)
    SL.start_log_stream(lines, str(tmp / "out"), str(tmp / "checkpoint"), available_now=True, totals=totals).awaitTermination()


def events(spark, tmp):
    text = spark.read.option("recursiveFileLookup", "true").text(str(tmp / "out")).collect()
    return sorted((e["event_type"], e["timestamp"]) for e in (json.loads(r.value) for r in text))


def test_log_stream_delivers_each_event_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "conn.log").write_text(header("conn", ["ts", "proto"]) + "1\ttcp\n2\tudp\nbad\n")
    (logs / "weird.log").write_text(header("weird", ["ts"]) + "9\n")
    totals = {}
    start_logs(spark, tmp_path, totals)
    assert events(spark, tmp_path) == [("connection", "1970-01-01T00:00:01Z"), ("connection", "1970-01-01T00:00:02Z")]
    assert totals == {"events": 2}
    (logs / "conn.2024-01-01.log").write_text(header("conn", ["ts", "proto"]) + "3\ttcp\n")
    (logs / "dns.log").write_text(header("dns", ["ts", "query"]) + "4\tq\n#path\tssl\n5\tr\n")
    start_logs(spark, tmp_path, totals)
    start_logs(spark, tmp_path, totals)
    assert events(spark, tmp_path) == [
        ("connection", "1970-01-01T00:00:01Z"),
        ("connection", "1970-01-01T00:00:02Z"),
        ("connection", "1970-01-01T00:00:03Z"),
        ("dns", "1970-01-01T00:00:04Z"),
        ("ssl", "1970-01-01T00:00:05Z"),
    ]
    assert totals == {"events": 5}


def test_log_stream_from_now(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for name, age in (("conn.log", 100), ("dns.log", 0)):
        (logs / name).write_text(header(name[:-4], ["ts"]) + "1\n")
        os.utime(logs / name, (time.time() - age,) * 2)
    start_logs(spark, tmp_path, since=time.time() - 50)
    assert [e for e, _ in events(spark, tmp_path)] == ["dns"]


@pytest.mark.parametrize("std_mode", ["population"])
def test_streamed_states_equal_batch(spark, tmp_path, std_mode):
    features = ["Dst Port", "Protocol", "v"]
    rows = [("a" if i % 3 else "b", i * 7, float(1000 + i % 60), 6.0 + i % 2, float(i * i % 97)) for i in range(300)]
    df = spark.createDataFrame(rows, "capture_id string, s bigint, dst_port double, protocol double, v double")
    df = df.withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
    for low in range(0, 2100, 700):
        part = df.filter((F.unix_seconds("timestamp") >= low) & (F.unix_seconds("timestamp") < low + 700))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states = stream_window_states(align_flows(stream, features), features, std_mode=std_mode)
    q = (
        states.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    got = {(r.capture_id, r.window_start): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = window_states(align_flows(df, features), features, std_mode=std_mode).collect()
    closed = [r for r in batch if r.window_start.timestamp() + 60 <= 299 * 7 - 60]
    assert len(got) == len(closed) > 50
    for r in closed:
        other = got[r.capture_id, r.window_start]
        assert other.flow_count == r.flow_count and other.state == pytest.approx(r.state)


def test_late_rows_are_parted_and_counted(spark, tmp_path):
    """The watermark is the newest time of earlier batches less the delay, over restarts."""
    taken = []
    write = SLT.late_writer(str(tmp_path), "1 minute", "30 seconds", "t", lambda df, b: taken.append(sorted(r.n for r in df.collect())))

    def batch(number, *seconds):
        rows = [(i, s) for i, s in enumerate(seconds)]
        df = spark.createDataFrame(rows, "n int, s bigint").select("n", F.timestamp_seconds("s").alias("t"))
        write(df, number)

    batch(0, 0, 200, 5)  # nothing is late in the first batch
    batch(1, 119, 120, 179, None, 400)  # mark 170: the minute to 120 has closed
    batch(1, 119, 120, 179, None, 400)
    batch(2, 300, 359, 360)  # mark 370
    batch(3)
    assert taken == [[0, 1, 2], [1, 2, 3, 4], [1, 2, 3, 4], [2], []]
    late = SLT.read_late(spark, str(tmp_path), "n int, t timestamp")
    assert sorted(r.n for r in late.collect()) == [0, 0, 1]
    counts = SLT.late_counts(spark, str(tmp_path)).first()
    assert (counts.rows, counts.late_rows, counts.newest.timestamp()) == (11, 3, 400.0)
    assert len([d for d in os.listdir(tmp_path / "state") if d.startswith("batch=")]) == 2
    assert SLT.read_late(spark, str(tmp_path / "none"), "n int").count() == 0


def test_counts_hold_over_restarts(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "conn.log").write_text(header("conn", ["ts", "proto"]) + "1\ttcp\n2\tudp\n")
    start_logs_counted(spark, tmp_path)
    (logs / "dns.log").write_text(header("dns", ["ts", "query"]) + "4\tq\n")
    start_logs_counted(spark, tmp_path)
    start_logs_counted(spark, tmp_path)
    assert SL.event_count(spark, str(tmp_path / "counts")).first() == (3, 2)
    assert SL.event_count(spark, str(tmp_path / "none")).first() == (0, 0)


def start_logs_counted(spark, tmp):
    SL.start_log_stream(
        SL.log_stream(spark, str(tmp / "logs")), str(tmp / "out"), str(tmp / "checkpoint"), available_now=True,
        counts=str(tmp / "counts"),
    ).awaitTermination()


def start_tail(spark, tmp, **options):
    SL.start_log_stream(
        tail_stream(spark, str(tmp / "logs"), **options), str(tmp / "out"), str(tmp / "checkpoint"), available_now=False,
        headers=str(tmp / "headers"),
    )
    (query,) = spark.streams.active
    query.processAllAvailable()
    query.stop()


def test_growing_and_rotated_logs(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    conn = logs / "conn.log"
    conn.write_text(header("conn", ["ts", "proto"]) + "1\ttcp\n2\tu")
    (logs / "other.log").write_text(header("other", ["ts"]) + "99\n")
    start_tail(spark, tmp_path)
    at = lambda *s: sorted(("connection", f"1970-01-01T00:00:{x:02d}Z") for x in s)
    assert events(spark, tmp_path) == at(1)
    with open(conn, "a") as f:
        f.write("dp\n3\ttcp\n")  # the rest of a half line, and one more under the header read before
    start_tail(spark, tmp_path)
    assert events(spark, tmp_path) == at(1, 2, 3)
    with open(conn, "a") as f:
        f.write("4\ttcp\n")
    conn.rename(logs / "conn.old.log")  # rotated with a line not read yet
    conn.write_text(header("conn", ["proto", "ts"]) + "tcp\t5\n")
    start_tail(spark, tmp_path)
    assert events(spark, tmp_path) == at(1, 2, 3, 4, 5)
    conn.write_text(header("conn", ["ts"]) + "6\n")  # emptied and begun anew under the same inode
    start_tail(spark, tmp_path)
    with open(conn, "a") as f:
        f.write("".join(f"{x}\n" for x in range(7, 40)))
    start_tail(spark, tmp_path, piece_bytes=7)
    start_tail(spark, tmp_path)
    assert events(spark, tmp_path) == at(*range(1, 40))


def test_tail_from_now(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "dns.log").write_text(header("dns", ["ts", "query"]) + "1\tq\n")
    start_tail(spark, tmp_path, from_now=True)
    (logs / "conn.log").write_text(header("conn", ["ts"]) + "2\n")
    start_tail(spark, tmp_path, from_now=True)
    assert events(spark, tmp_path) == [("connection", "1970-01-01T00:00:02Z")]
