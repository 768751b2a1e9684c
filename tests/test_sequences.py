import pytest
from pyspark.sql import functions as F

from tidewatch.operators.sequences import capture_lengths, scaled_states, sequences
from tidewatch.plans.materialize import written


def states(spark, minutes_by_capture):
    rows = [
        (c, m, [float(m), float(-m)])
        for c, minutes in minutes_by_capture.items()
        for m in minutes
    ]
    df = spark.createDataFrame(rows, "capture_id string, m bigint, scaled array<double>")
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("m") * 60)
    return written(df.withColumn("window_start", start), "test-states")


def check(got, minutes_by_capture, seq_len):
    want = {}
    for c, minutes in minutes_by_capture.items():
        minutes = sorted(minutes)
        for i in range(len(minutes) - seq_len):
            want[c, i] = (minutes[i + seq_len], [[float(m), float(-m)] for m in minutes[i : i + seq_len]])
    assert {(r.capture_id, r.step_index): (r.m, r.seq) for r in got} == want


@pytest.mark.parametrize("chunk_rows", [5, 7, 4096])
def test_sequences_bridge_gaps_and_chunks(spark, chunk_rows):
    data = {
        "dense": range(60),
        "gaps": [1, 2, 50, 51, 300, 301, 302, 5000, 5001, 90000, 90001],
        "short": range(5),
        "just": range(6),
    }
    got = sequences(states(spark, data), 5, chunk_rows=chunk_rows).collect()
    check(got, data, 5)
    assert sum(r.capture_id == "just" for r in got) == 1
    assert not any(r.capture_id == "short" for r in got)


def test_lengths(spark):
    got = capture_lengths(states(spark, {"a": range(5), "b": range(6)}), 5).collect()
    assert {r.capture_id: (r.windows, r.enough) for r in got} == {"a": (5, False), "b": (6, True)}


def test_zero_scale_is_refused(spark):
    df = spark.createDataFrame([([1.0],)], "state array<double>")
    with pytest.raises(ValueError, match="scale"):
        scaled_states(df, [0.0], [0.0])
