import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import buffer as B
from tidewatch.operators import time_layout as TL


def arrivals(spark, times, sensor="s"):
    rows = [(i, sensor, float(t), f"id{i}", json.dumps({"n": i})) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, B.BUFFER_SCHEMA)


def kept(df):
    return sorted(r.ts_epoch for r in df.collect())


def simulate(rows, retention=300.0):
    """Insert one by one, prune by the inserted time; identical text replaces its time."""
    held = {}
    for _, sensor, ts, _, payload in rows:
        held[sensor, payload] = ts
        held = {k: t for k, t in held.items() if k[0] != sensor or t >= ts - retention}
    return sorted((s, p, t) for (s, p), t in held.items())


@pytest.mark.parametrize(
    "times, want",
    [
        ([1000, 1060, 1120, 1180, 1240, 1300], [1000, 1060, 1120, 1180, 1240, 1300]),
        ([1000, 1060, 1120, 1180, 1240, 1300, 1360], [1060, 1120, 1180, 1240, 1300, 1360]),
        ([1000, 1060, 1120, 1180, 1240, 1360], [1060, 1120, 1180, 1240, 1360]),
        ([500, 500, 500], [500, 500, 500]),
        ([100, 1000, 650, 1360, 50], [50, 1360]),
    ],
)
def test_survivor_cases(spark, times, want):
    assert kept(B.survivors(arrivals(spark, times))) == want


@pytest.mark.parametrize("bits, limit", [((2, 4, 6), 3), ((3, 5, 9), 1 << 19), (B.CHUNK_BITS, 1 << 19)])
def test_survivors_equal_simulation(spark, bits, limit):
    rng = random.Random(11)
    rows = [
        (i, rng.choice("aaab"), float(i * 7 + rng.randint(0, 900)), f"id{i}", json.dumps({"n": i}))
        for i in range(600)
    ]
    got = B.survivors(spark.createDataFrame(rows, B.BUFFER_SCHEMA), bits=bits, limit=limit)
    assert sorted((r.sensor, r.payload, r.ts_epoch) for r in got.collect()) == simulate(rows)


def test_reinserted_flows_equal_simulation(spark):
    rng = random.Random(12)
    rows = []
    for i in range(500):
        n = rng.randint(0, 60)
        rows.append((i, rng.choice("ab"), float(i * 3 + rng.randint(-400, 400)), f"id{n}", f'{{"n":{n}}}'))
    got = B.survivors(spark.createDataFrame(rows, B.BUFFER_SCHEMA), supplied_ids=True, bits=(4, 7, 9))
    assert sorted((r.sensor, r.payload, r.ts_epoch) for r in got.collect()) == simulate(rows)


def test_size_after_each_insert(spark):
    """Survivors of every prefix of the arrivals."""
    times = [1000, 1060, 1120, 1180, 1240, 1300, 1360, 50]
    df = arrivals(spark, times)
    sizes = [B.survivors(df.filter(F.col("arrival_seq") <= i)).count() for i in range(len(times))]
    assert sizes == [1, 2, 3, 4, 5, 6, 6, 7]


def test_rows_of_flows(spark):
    df = spark.createDataFrame(
        [("2026-09-10 17:51:52", "x", None), ("1000", "x", "mine"), ("nan", "x", None), ("1000", "x", None)],
        "timestamp string, src_ip string, _id string",
    ).coalesce(1)
    rows = B.buffer_rows(df).orderBy("arrival_seq").collect()
    assert [r.ts_epoch for r in rows] == [1789062712.0, 1000.0, 1000.0]
    assert rows[1]._id == "mine" and len({r._id for r in rows}) == 3
    assert json.loads(rows[1].payload) == {"timestamp": "1000", "src_ip": "x", "_id": "mine"}
    assert all(r.sensor == "cic:flows" for r in rows)
    again = B.buffer_rows(df).orderBy("arrival_seq").collect()
    assert [r._id for r in again] == [r._id for r in rows]


def test_given_time_wins(spark):
    df = spark.createDataFrame([("2026-09-10", 7.0)], "timestamp string, at double")
    assert B.buffer_rows(df, timestamp=F.col("at")).first().ts_epoch == 7.0


def test_range_is_inclusive_and_sorted(spark):
    df = arrivals(spark, [200, 100, 400, 300])
    assert [r.ts_epoch for r in B.read_flows(df, "n int").collect()] == [100, 200, 300, 400]
    assert [r.ts_epoch for r in B.read_flows(df, "n int", 200, 350).collect()] == [200, 300]
    assert [r.ts_epoch for r in B.read_flows(df, "n int", 200, 300).collect()] == [200, 300]
    tied = [r.n for r in B.read_flows(arrivals(spark, [5, 5, 5]), "n int").collect()]
    assert tied == [0, 1, 2]


def test_prune_keeps_the_cutoff(spark):
    left, removed = B.prune(arrivals(spark, [699, 700, 701]), 1000)
    assert kept(left) == [700, 701] and removed.first().removed == 1


def test_stats_and_ends(spark):
    df = arrivals(spark, [5, 1, 9, 7, 3, 8, 2])
    stats = B.buffer_stats(df).first()
    assert (stats.flow_count, stats.oldest, stats.newest, stats.span) == (7, 1, 9, 8)
    assert [r.ts_epoch for r in B.oldest(df).collect()] == [1, 2, 3, 5, 7]
    assert [r.ts_epoch for r in B.newest(df).collect()] == [9, 8, 7, 5, 3]
    empty = B.buffer_stats(B.empty_buffer(spark)).first()
    assert (empty.flow_count, empty.oldest, empty.span) == (0, None, None)


def test_flow_text(spark):
    df = spark.createDataFrame(
        [
            ('{"timestamp": "t", "src_ip": "a", "src_port": 1, "dst_ip": "b", "dst_port": 2, "protocol": 6}',),
            ('{"src_ip": null}',),
            ("{broken",),
        ],
        "payload string",
    ).coalesce(1)
    got = [r[0] for r in df.select(B.flow_text(F.col("payload"))).collect()]
    assert got == ["[t] a:1 -> b:2 (6)", "[N/A] None:N/A -> N/A:N/A (N/A)", "Invalid JSON"]


def test_append_and_clear(spark, tmp_path):
    table = str(tmp_path / "buffer")
    assert B.load_buffer(spark, table).count() == 0
    B.append_buffer(arrivals(spark, [1, 2]), table)
    B.append_buffer(arrivals(spark, [3]), table)
    assert B.load_buffer(spark, table).count() == 3
    B.clear_buffer(spark, table)
    assert B.load_buffer(spark, table).count() == 0


def test_batches_without_order(spark, tmp_path):
    table = str(tmp_path / "buffer")
    for times in ([5000, 5010], [1000], [1000]):
        flows = spark.createDataFrame([(t, "x") for t in times], "timestamp long, note string")
        B.append_flows(flows.coalesce(1), table)
    rows = B.load_buffer(spark, table)
    assert rows.select("_id").distinct().count() == 4
    alive = B.survivors(rows, 300)
    assert kept(alive) == [1000, 1000, 5000, 5010]


@pytest.mark.parametrize("how", [{}, {"group_bits": 2, "per_task": 5}, {"group_bits": 1}])
def test_sizes_after_every_insert(spark, how):
    rng = random.Random(3)
    rows = [(i * 3, rng.choice("aab"), f"i{i}", float(1000 + i * 20 + rng.choice((0, -900, 400, 2000 * (i == 60))))) for i in range(130)]
    df = spark.createDataFrame(rows, "arrival_seq bigint, sensor string, _id string, ts_epoch double")
    got = {(r.sensor, r.arrival_seq): r.flow_count for r in B.sizes_after_inserts(df.repartition(3), **how).collect()}
    held = {"a": [], "b": []}
    for seq, sensor, _, t in rows:
        held[sensor] = [x for x in held[sensor] + [t] if x >= t - 300]
        assert got[sensor, seq] == len(held[sensor])
    assert len(got) == len(rows)
    assert B.sizes_after_inserts(df.limit(0)).count() == 0


def test_layout_by_time_opens_few_files(spark, tmp_path):
    rng = random.Random(4)
    times = [1000 + rng.randrange(5000) + rng.choice((0, 0.5)) for _ in range(400)] + [7000.0] * 50
    table = str(tmp_path / "t")
    TL.write_by_time(arrivals(spark, times).repartition(3), table, 8)
    zones = TL.zones_of(spark, table).collect()
    assert len(zones) > 5 and sum(z.flows for z in zones) == len(times)

    def opened(df):
        return len(df.inputFiles())

    for start, end in ((1500, 1800), (None, 1200), (5900, None), (8000, None), (2000.5, 2000.5), (None, None)):
        got = TL.rows_between(spark, table, start, end)
        want = sorted(t for t in times if (start is None or t >= start) and (end is None or t <= end))
        assert kept(got) == want
        if start == 1500 or end == 1200:
            assert opened(got) <= 2
    assert opened(TL.rows_between(spark, table, 8000)) == 0
    for n in (1, 5, 60, 449, 1000):
        assert [r.ts_epoch for r in TL.oldest_of(spark, table, n).collect()] == sorted(times)[:n]
        assert [r.ts_epoch for r in TL.newest_of(spark, table, n).collect()] == sorted(times, reverse=True)[:n]
    assert opened(TL.oldest_of(spark, table, 5)) == 1 and opened(TL.newest_of(spark, table, 5)) == 1
    assert TL.oldest_of(spark, str(tmp_path / "none")).count() == 0
