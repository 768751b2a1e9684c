import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import names, numeric, report, timeparse


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names():
    assert names.match_name("Flow Byts/s") == names.match_name("flow_byts_s") == "flowbytss"
    assert names.state_names(["a", "b"]) == [
        "mean_a", "mean_b", "std_a", "std_b", "min_a", "min_b", "max_a", "max_b",
        "meta_log_flow_count", "meta_log_unique_ports", "meta_unique_protocols",
        "meta_high_port_ratio",
    ]


@pytest.mark.parametrize(
    "steps, size, label",
    [
        (1, "30s", "+30s"),
        (3, "1min", "+3min"),
        (3, "30s", "+1.5min"),
        (1, "1h", "+60min"),
        (2, "soon", "+2 step(s)"),
        (1, "500ms", "+0s"),
    ],
)
def test_horizon(steps, size, label):
    assert names.horizon_labels(steps, size)[-1] == label


def test_tactics_and_dimensions(spark):
    assert column(spark, [0, 6, 7, None], names.tactic_name, "int") == [
        "Benign", "C2 / Botnet (TA0011)", "Unknown", "Unknown",
    ]
    assert column(spark, [1, 5], lambda c: names.dimension_name(["p", "q"], c), "int") == [
        "q", "dim_5",
    ]


def test_safe_numbers(spark):
    texts = [" 12 ", "12.0", "1e3", "", None, "x", "-7"]
    assert column(spark, texts, numeric.safe_int) == [12, None, None, None, None, None, -7]
    texts = ["1.5", "1.5d", "1.5F", "1e3", " 2 ", "", None, "abc", "inf"]
    got = column(spark, texts, numeric.safe_float)
    assert got == [1.5, None, None, 1000.0, 2.0, None, None, None, math.inf]


def test_clean_number(spark):
    rows = [("1.5",), ("Infinity",), ("-inf",), ("NaN",), ("",), ("bad",), (None,), ("2d",)]
    df = spark.createDataFrame(rows, "x string").coalesce(1)
    got = [r[0] for r in df.select(numeric.clean_number("x", True, 1e6)).collect()]
    assert got == [1.5e6] + [0.0] * 7


def test_scaling(one):
    got = one(
        "s array<double>",
        ([0.0, 1.0, -1.0, 1e9],),
        z=numeric.scale_state(
            F.col("s"), numeric.double_array([0.0, 0.0, 0.0, 0.0]), numeric.double_array([1, 0.5, 1, 1])
        ),
    )["z"]
    assert got[0] == 0.0 and got[3] == 3.0
    assert got[1] == pytest.approx(2 * math.log(2)) and got[2] == pytest.approx(-math.log(2))


def test_larger_of_risk_keeps_first_on_nan(one):
    got = one(
        "p double, q double, n double",
        (0.4, float("nan"), None),
        a=numeric.max_keep_first(F.col("p"), F.col("q")),
        b=numeric.max_keep_first(F.col("p"), F.col("n")),
        c=numeric.max_keep_first(F.col("p"), F.lit(0.9)),
    )
    assert got == {"a": 0.4, "b": 0.4, "c": 0.9}


def test_argmax_takes_the_first(one):
    assert one("x array<double>", ([1.0, 3.0, 3.0],), y=numeric.first_argmax(F.col("x")))["y"] == 1


def test_bands_and_flags(spark):
    got = column(spark, [0.61, 0.6, 0.3, None], report.risk_band, "double")
    assert got == ["Critical Anomaly", "Elevated Drift", "Nominal Physics", "Nominal Physics"]
    assert column(spark, [True, False], report.flag_status, "boolean") == ["Flagged", "Nominal"]


def test_percent_rounds_the_stored_value(spark):
    values = [0.0015, 0.0185, 0.6525, 0.0, 1.0, 0.1234, 0.00049]
    got = column(spark, values, report.percent_text, "double")
    assert got == ["0.1%", "1.8%", "65.3%", "0.0%", "100.0%", "12.3%", "0.0%"]


def test_gate_uses_strictly_below(one):
    got = one(
        "s double",
        (0.5,),
        a=report.gate_class(F.lit(3), F.col("s"), 0.5),
        b=report.gate_class(F.lit(3), F.col("s"), 0.51),
    )
    assert got == {"a": 3, "b": 0}


def epochs(spark, texts):
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return column(spark, texts, lambda c: timeparse.buffer_epoch(c, now=now))


NOW = 1893456000.0


def test_epoch_rules(spark):
    texts = [
        "2026-09-10 17:51:52", "15/02/2018 08:35:18", "03/02/2018 00:00:00", None, "",
        "not_a_date", "1000.5", "0", "02/15/2018 00:00:00", "2026-09-10T00:00:00Z",
    ]
    assert epochs(spark, texts) == [
        1789062712.0, 1518683718.0, 1517616000.0, NOW, NOW, NOW, 1000.5, 0.0, 1518652800.0,
        1788998400.0,
    ]


def test_epoch_boundaries(spark):
    a, b, c, d = epochs(
        spark,
        ["2026-09-30 23:59:59", "2026-10-01 00:00:01", "2026-12-31 23:59:59", "2027-01-01 00:00:01"],
    )
    assert b - a == 2.0 and d - c == 2.0


def test_numeric_zero_is_empty(spark):
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    got = column(spark, [0.0, 5.0], lambda c: timeparse.buffer_epoch(c, True, now), "double")
    assert got == [NOW, 5.0]


def test_flow_times(spark):
    got = column(
        spark,
        ["2018-02-15 08:35:18", "15/02/2018 08:35:18", "03/02/2018 08:35", "5/7/2017 8:59:00 PM", "x", None],
        lambda c: timeparse.flow_time(c).cast("string"),
    )
    assert got == [
        "2018-02-15 08:35:18", "2018-02-15 08:35:18", "2018-02-03 08:35:00",
        "2017-07-05 20:59:00", None, None,
    ]


def test_log_times(spark):
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    texts = ["1672531200.123456", "1672531200", None, "", "abc", "nan", "1e15", "-1"]
    assert column(spark, texts, lambda c: timeparse.log_time(c, now)) == [
        "2023-01-01T00:00:00.123456Z", "2023-01-01T00:00:00Z", "2030-01-01T00:00:00Z",
        "2030-01-01T00:00:00Z", "abc", "nan", "1e15", "1969-12-31T23:59:59Z",
    ]


def test_millisecond_text_cuts(spark):
    got = column(spark, [1.9999, 0.0], timeparse.millisecond_text, "double")
    assert got == ["1970-01-01 00:00:01.999", "1970-01-01 00:00:00.000"]
