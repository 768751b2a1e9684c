import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.flows import (
    FlowInputError,
    align_flows,
    check_flow_table,
    is_span,
    missing_features,
)
from tidewatch.operators import states as S
from tidewatch.operators.states import state_dimensions, window_states
from tidewatch.schemas import FLOW_COLUMNS
from tidewatch.sources.flow_csv import captured, header_of, read_capture_rows, read_flow_csv, read_flows
from tidewatch.sources.sinks import select_fields, store_capture_rows, write_captures

FEATURES = ["Dst Port", "Protocol", "Flow IAT Mean", "CWE Flag Count", "Idle Mean"]
TEXT = "capture_id string, timestamp string, dst_port string, protocol string, `Flow IAT Mean` string, cwr_flag_count string, note string"


def flows(spark, rows):
    return spark.createDataFrame(rows, TEXT)


def test_schema_has_82_columns_and_23_spans():
    assert len(FLOW_COLUMNS) == len(set(FLOW_COLUMNS)) == 82
    assert sum(map(is_span, FLOW_COLUMNS)) == 23


def test_alignment(spark):
    raw = flows(
        spark,
        [
            ("a", "2018-02-15 08:35:18", "1025", "6", "0.5", "2", "kept"),
            ("a", "nonsense", "80", "6", "1", "1", "dropped"),
            ("a", "15/02/2018 08:36:00", "bad", "", "Infinity", None, None),
        ],
    )
    got = align_flows(raw, FEATURES).orderBy("Timestamp").collect()
    assert [r.note for r in got] == ["kept", None]
    assert got[0]["Flow IAT Mean"] == 0.5e6 and got[0]["CWE Flag Count"] == 2.0
    assert got[1]["Flow IAT Mean"] == 0.0 and got[1]["Dst Port"] == 0.0
    assert all(r["Idle Mean"] == 0.0 for r in got)
    assert missing_features(raw.columns, FEATURES) == [4]


def test_units(spark):
    raw = flows(spark, [("a", "2018-02-15 08:35:18", "1", "6", "0.5", "2", "x")])
    assert align_flows(raw, FEATURES, time_unit="us").first()["Flow IAT Mean"] == 0.5
    exempt = align_flows(raw, FEATURES, keep_unit=["Flow IAT Mean"])
    assert exempt.first()["Flow IAT Mean"] == 0.5


def test_unusable_tables(spark):
    with pytest.raises(FlowInputError, match="Timestamp"):
        align_flows(spark.createDataFrame([("1",)], "dst_port string"), FEATURES)
    with pytest.raises(FlowInputError, match="two columns"):
        align_flows(
            spark.createDataFrame([("1", "2", "3")], "timestamp string, dst_port string, `Dst Port` string"),
            FEATURES,
        )


def test_exact_name_wins_over_alias(spark):
    raw = spark.createDataFrame([("2024-01-01", "4")], "timestamp string, cwr_flag_count string")
    assert align_flows(raw, ["cwr_flag_count"]).first()["cwr_flag_count"] == 4.0


def expected_states(pdf, features, minutes=1):
    pdf = pdf.assign(w=pdf["Timestamp"].dt.floor(f"{minutes}min"))
    out = {}
    for key, g in pdf.groupby(["capture_id", "w"]):
        x = g[features].to_numpy(float)
        ports = g["Dst Port"].astype(int) if "Dst Port" in features else pd.Series(dtype=int)
        protocols = g["Protocol"].astype(int) if "Protocol" in features else pd.Series(dtype=int)
        high = float((g["Dst Port"] > 1024).mean()) if "Dst Port" in features else 0.0
        meta = [np.log1p(len(x)), np.log1p(ports.nunique()), protocols.nunique(), high]
        out[key] = (len(x), np.concatenate([x.mean(0), x.std(0), x.min(0), x.max(0), meta]))
    return out


def test_states_match_numpy(spark):
    rng = np.random.default_rng(5)
    n = 2500
    hot = rng.random(n) < 0.4  # one minute holds much of the data
    seconds = np.where(hot, 30, rng.integers(0, 3600, n))
    pdf = pd.DataFrame(
        {
            "capture_id": rng.choice(["a", "b"], n),
            "Timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds, unit="s"),
            "Dst Port": rng.integers(1000, 1060, n).astype(float),
            "Protocol": rng.choice([1.0, 6.0, 17.0], n),
            "f1": rng.normal(0, 1e6, n),
            "f2": rng.random(n),
            "f3": rng.random(n),
        }
    )
    features = ["Dst Port", "Protocol", "f1", "f2", "f3"]
    df = spark.createDataFrame(pdf)
    want = expected_states(pdf, features)
    for mode in ("population", "moments"):
        got = window_states(df, features, std_mode=mode).collect()
        assert len(got) == len(want)
        for r in got:
            count, state = want[(r.capture_id, pd.Timestamp(r.window_start))]
            assert r.flow_count == count
            np.testing.assert_allclose(r.state, state, rtol=1e-7, atol=1e-4)


def test_states_small_cases(spark):
    rows = [
        ("a", "2024-01-01 00:00:10", 1024.0, 6.0),
        ("a", "2024-01-01 00:00:50", 1025.0, 6.0),
        ("a", "2024-01-01 00:02:00", 80.0, 17.0),
    ]
    df = spark.createDataFrame(rows, "capture_id string, t string, `Dst Port` double, Protocol double")
    df = df.withColumn("Timestamp", F.col("t").cast("timestamp"))
    states = window_states(df, ["Dst Port", "Protocol"])
    long = state_dimensions(states, ["Dst Port", "Protocol"])
    got = {(str(r.window_start)[14:16], r.feature): r.value for r in long.collect()}
    assert {m for m, _ in got} == {"00", "02"}  # the empty minute is absent
    assert got["00", "meta_high_port_ratio"] == 0.5
    assert got["00", "meta_log_unique_ports"] == pytest.approx(np.log(3))
    assert got["00", "meta_unique_protocols"] == 1.0
    assert got["00", "std_Dst Port"] == 0.5 and got["02", "std_Dst Port"] == 0.0


def test_states_without_port_or_protocol(spark):
    df = spark.createDataFrame([("a", 1.0)], "capture_id string, v double")
    df = df.withColumn("Timestamp", F.lit("2024-01-01").cast("timestamp"))
    assert window_states(df, ["v"]).first().state == [1.0, 0.0, 1.0, 1.0, np.log(2), 0.0, 0.0, 0.0]


def test_huge_port_does_not_fail(spark):
    df = spark.createDataFrame([("a", 1e300), ("a", 1e301)], "capture_id string, `Dst Port` double")
    df = df.withColumn("Timestamp", F.lit("2024-01-01").cast("timestamp"))
    assert window_states(df, ["Dst Port"]).first().state[5] == pytest.approx(np.log(2))


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_csv_short_lines_and_names(spark, tmp_path):
    path = write(tmp_path / "c.csv", 'a,b,a\n1,"x,y",3\n4\n')
    assert header_of(spark, path) == ["a", "b", "a.1"]
    got = read_flow_csv(spark, path).select("`a`", "b", "`a.1`", "capture_id").collect()
    assert [tuple(r) for r in got] == [("1", "x,y", "3", "c.csv"), ("4", None, None, "c.csv")]


def test_csv_long_line_fails(spark, tmp_path):
    path = write(tmp_path / "c.csv", "a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="too many fields"):
        read_flow_csv(spark, path).collect()


def test_captures_merge_and_stay_apart(spark, tmp_path):
    write(tmp_path / "x" / "one.csv", "a,b\n1,2\n")
    write(tmp_path / "x" / "two.csv", "a,b\n3,4\n")
    write(tmp_path / "x" / "three.csv", "a,c\n5,6\n")
    merged = read_flows(spark, folder=str(tmp_path / "x"), merge=True)
    rows = {tuple(r) for r in merged.select("capture_id", "a", "b", "c").collect()}
    assert rows == {("one.csv", "1", "2", None), ("two.csv", "3", "4", None), ("three.csv", "5", None, "6")}
    apart = read_flows(spark, folder=str(tmp_path / "x"))
    assert {tuple(t.columns): {tuple(r) for r in t.collect()} for t in apart} == {
        ("capture_id", "a", "b"): {("one.csv", "1", "2"), ("two.csv", "3", "4")},
        ("capture_id", "a", "c"): {("three.csv", "5", "6")},
    }
    with pytest.raises(ValueError, match="folder"):
        read_flows(spark, file="one.csv", merge=True)


def test_unlike_captures_in_one_table(spark, tmp_path):
    """Any headers: other orders, odd names, repeated names, short lines, quoted commas."""
    write(tmp_path / "x" / "one.csv", "a,b\n1,2\n7\n")
    write(tmp_path / "x" / "y" / "two.csv", 'b,a.b,it\'s,a,a\n3,4,5,"6,x",8\n')
    write(tmp_path / "x" / "none.csv", "")
    rows = read_capture_rows(spark, str(tmp_path / "x"))
    assert rows.columns == ["capture_id", "flow"]
    got = {tuple(r) for r in rows.select("capture_id", F.to_json("flow")).collect()}
    assert got == {
        ("one.csv", '{"a":"1","b":"2"}'), ("one.csv", '{"a":"7","b":null}'),
        ("two.csv", '{"a":"6,x","a.1":"8","a.b":"4","b":"3","it\'s":"5"}'),
    }
    store_capture_rows(rows, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"capture_id=one.csv", "capture_id=two.csv"}
    again = spark.read.parquet(str(tmp_path / "out")).select(
        captured("a", "int"), captured("a.b", "int"), captured("it's", "int"), captured("absent"), captured("b", "int")
    )
    assert {tuple(r) for r in again.collect()} == {(1, None, None, None, 2), (7, None, None, None, None), (None, 4, 5, None, 3)}
    write(tmp_path / "x" / "two.csv", "a,b\n1,2,3\n")
    with pytest.raises(Exception, match="too many fields"):
        read_capture_rows(spark, str(tmp_path / "x")).collect()


def test_fields_subset(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert select_fields(df, "c,a").columns == ["c", "a"]
    assert select_fields(df).columns == ["a", "b", "c"]


def test_table_check(spark):
    good = spark.createDataFrame([("x",) * 82], FLOW_COLUMNS)
    assert all(r.passed for r in check_flow_table(good).collect())
    poor = spark.createDataFrame([], "SRC_IP string, dst_port string")
    got = {r["check"]: r.passed for r in check_flow_table(poor).collect()}
    assert got["column src_ip"] and not got["column dst_ip"] and not got["has data rows"]
    assert not got["at least 70 columns"]


def test_one_output_per_capture_or_one_for_all(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, 2), ("y", 3, 4)], "capture_id string, a int, b int")
    write_captures(df, str(tmp_path / "apart"), "b")
    assert {p.name for p in (tmp_path / "apart").iterdir() if p.is_dir()} == {"capture_id=x", "capture_id=y"}
    got = spark.read.csv(str(tmp_path / "apart"), header=True)
    assert {(r.capture_id, r.b) for r in got.collect()} == {("x", "2"), ("y", "4")}
    write_captures(df, str(tmp_path / "one"), merge=True)
    assert spark.read.csv(str(tmp_path / "one"), header=True).columns == ["a", "b"]


def test_long_line_fails_whatever_is_read(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("a,b\n1,2\n1,2,3\n")
    flows = read_flow_csv(spark, str(path))
    for read in (flows.drop("capture_id").collect, flows.count, flows.select("a").collect, flows.agg({"b": "max"}).collect):
        with pytest.raises(Exception, match="too many fields"):
            read()


def test_each_file_by_its_own_header(spark, tmp_path):
    write(tmp_path / "m" / "one.csv", 'timestamp,dst_port,protocol\nt1,443,6\n\n"t,2",80\n')
    write(tmp_path / "m" / "two.csv", "timestamp,protocol,dst_port\nt3,17,53\n")
    write(tmp_path / "m" / "three.csv", "protocol,note,timestamp\n1,x,t4\n")
    flows = read_flow_csv(spark, str(tmp_path / "m"))
    rows = {tuple(r) for r in flows.select("capture_id", "timestamp", "dst_port", "protocol", "note").collect()}
    assert rows == {
        ("one.csv", "t1", "443", "6", None), ("one.csv", "t,2", "80", None, None),
        ("two.csv", "t3", "53", "17", None), ("three.csv", "t4", None, "1", "x"),
    }
    write(tmp_path / "m" / "four.csv", "note,timestamp\na,b,\n")
    flows = read_flow_csv(spark, str(tmp_path / "m"))
    for read in (flows.count, flows.select("note").collect):
        with pytest.raises(Exception, match="too many fields"):
            read()


def test_own_headers_reach_every_split(spark, tmp_path):
    lines = [f"{i},{i * 2}" for i in range(400)]
    write(tmp_path / "s" / "one.csv", "\n".join(["a,b", *lines]) + "\n")
    write(tmp_path / "s" / "two.csv", "\n".join(["b,a", *lines]) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_flow_csv(spark, str(tmp_path / "s")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = sorted((r.capture_id, int(r.a), int(r.b)) for r in rows)
    assert got == sorted([("one.csv", i, i * 2) for i in range(400)] + [("two.csv", i * 2, i) for i in range(400)])


@pytest.mark.parametrize("extra", [0, 20])
def test_stored_states_merge_to_longer_windows(spark, tmp_path, extra):
    """Minutes merged to hours equal hours, on few features and on many."""
    rng = np.random.default_rng(extra)
    names = ["Dst Port", "Protocol"] + [f"v{i}" for i in range(extra + 1)]
    ports = rng.choice([0, 1, 63, 64, 1024, 1025, 65535, -1, -64, 2**40, -(2**63)], 400).astype(float)
    rows = [
        ("ab"[i % 2], int(t), float(p), float(6 + i % 3), *map(float, rng.normal(1e6, 1, extra + 1)))
        for i, (t, p) in enumerate(zip(rng.integers(0, 9000, 400), ports))
    ]
    schema = "capture_id string, s bigint, " + ", ".join(f"`{n}` double" for n in names)
    flows = spark.createDataFrame(rows, schema).withColumn("Timestamp", F.timestamp_seconds("s"))
    S.append_states(S.partial_states(flows, names), str(tmp_path / "minutes"))
    S.append_states(S.partial_states(flows.limit(0), names), str(tmp_path / "minutes"))
    stored = S.load_states(spark, str(tmp_path / "minutes"), "1970-01-01", "1970-01-01")
    got = {tuple(r)[:2]: r for r in S.finished_states(S.merged_states(stored, "1 hour")).collect()}
    expected = window_states(flows, names, "1 hour").collect()
    assert len(got) == len(expected) == 6
    for r in expected:
        other = got[tuple(r)[:2]]
        assert other.flow_count == r.flow_count
        assert other.state == pytest.approx(r.state, rel=1e-9)
        own = [x for x in rows if x[0] == r.capture_id and x[1] // 3600 == r.window_start.timestamp() // 3600]
        assert r.state[-3] == pytest.approx(np.log1p(len({int(x[2]) for x in own})))
        assert r.state[-2] == len({x[3] for x in own})
        assert r.state[-1] == pytest.approx(sum(x[2] > 1024 for x in own) / len(own))
        for i in range(len(names)):
            v = np.array([x[2 + i] for x in own])
            assert r.state[i] == pytest.approx(v.mean(), rel=1e-9)
            assert r.state[len(names) + i] == pytest.approx(v.std(), rel=1e-6, abs=1e-9)


def test_states_plan_has_no_row_for_each_port(spark):
    flows = spark.createDataFrame([("a", 1.0, 6.0)], "capture_id string, `Dst Port` double, Protocol double")
    flows = flows.withColumn("Timestamp", F.timestamp_seconds(F.lit(0)))
    plan = window_states(flows, ["Dst Port", "Protocol"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_item" not in plan and "_word" in plan and "bit_or" in plan
