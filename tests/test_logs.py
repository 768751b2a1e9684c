import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import normalize as N
from tidewatch.sources import sinks, zeek

CONN_FIELDS = (
    "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes "
    "resp_bytes conn_state local_orig local_resp missed_bytes history orig_pkts orig_ip_bytes "
    "resp_pkts resp_ip_bytes tunnel_parents"
).split()


def header(path, fields, sep="\t"):
    return (
        f"#separator \\x{ord(sep):02x}\n#set_separator\t,\n#empty_field\t(empty)\n"
        f"#unset_field\t-\n#path\t{path}\n#fields{sep}" + sep.join(fields) + "\n"
    )


def parse(spark, folder, **files):
    for name, text in files.items():
        (folder / f"{name}.log").write_text(text)
    lines = zeek.read_log_lines(spark, str(folder), "*.log")
    return zeek.parse_log(lines).orderBy("file", "pos").collect()


def test_full_line_and_null_markers(spark, tmp_path):
    text = header("conn", ["ts", "service", "history", "note"])
    text += "1672531200.123456\t-\t(empty)\t\n1\t2\n\n#close\n"
    (row,) = parse(spark, tmp_path, conn=text)
    assert row.path == "conn"
    assert row.rec == {"ts": "1672531200.123456", "service": None, "history": None, "note": ""}


def test_nothing_before_fields(spark, tmp_path):
    text = "1\t2\n#path\tx\n1\t2\n#fields\ta\tb\n3\t4\n"
    (row,) = parse(spark, tmp_path, conn=text)
    assert row.rec == {"a": "3", "b": "4"} and row.path == "x"


def test_defaults_and_last_duplicate(spark, tmp_path):
    (row,) = parse(spark, tmp_path, dns="#fields\ta\ta\n1\t2\n")
    assert row.rec == {"a": "2"} and row.path == "unknown"


def test_header_in_mid_file_changes_everything(spark, tmp_path):
    text = header("conn", ["a", "b"]) + "1\t-\n"
    text += "#separator \\x7c\n#unset_field none\n#path new\n#fields |c|d|e\n1|none|-\n1\t2\n#path\n"
    rows = parse(spark, tmp_path, http=text)
    assert [(r.path, r.rec) for r in rows] == [
        ("conn", {"a": "1", "b": None}),
        ("new", {"c": "1", "d": None, "e": "-"}),
    ]


def test_regex_separator_is_literal(spark, tmp_path):
    (row,) = parse(spark, tmp_path, ssl="#separator .\n#fields .a.b\n1.2\n")
    assert row.rec == {"a": "1", "b": "2"}


def test_header_reaches_every_split_of_a_file(spark, tmp_path):
    """A file cut into many splits, with a second header somewhere in the middle."""
    first = "".join(f"{i}\tx{i}\n" for i in range(400))
    second = "".join(f"{i}\ty{i}\tz\n" for i in range(400, 900))
    text = header("conn", ["n", "v"]) + first + "#path\tlate\n#fields\tn\tw\tu\n" + second
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        (tmp_path / "conn.log").write_text(text)
        (tmp_path / "dns.log").write_text(header("dns", ["n", "q"]) + "1\ta\n2\tb\tc\n")
        lines = zeek.read_log_lines(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 10
        rows = zeek.parse_log(lines).collect()
        rejects = {r.path: (r.kept, r.rejected) for r in zeek.reject_counts(lines).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    conn = {r.rec["n"]: (r.path, r.rec) for r in rows if r.path != "dns"}
    assert len(conn) == 900
    assert conn["7"] == ("conn", {"n": "7", "v": "x7"})
    assert conn["800"] == ("late", {"n": "800", "w": "y800", "u": "z"})
    assert rejects == {"conn": (400, 0), "late": (500, 0), "dns": (1, 1)}


def test_only_the_named_logs(spark, tmp_path):
    for name in ("conn", "weird", "conn-summary", "notice"):
        (tmp_path / f"{name}.log").write_text(header(name, ["a"]) + "1\n")
    (tmp_path / "dns.2024-01-01.log").write_text(header("dns", ["a"]) + "1\n")
    rows = zeek.parse_log(zeek.read_log_lines(spark, str(tmp_path))).collect()
    assert sorted(r.path for r in rows) == ["conn", "dns", "notice"]


def records(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, rec map<string,string>")


CONN = {
    "ts": "1672531200.0", "id.orig_h": "192.168.1.1", "id.orig_p": "12345", "id.resp_h": "10.0.0.1",
    "id.resp_p": "443", "proto": "tcp", "duration": "1.42", "orig_bytes": "1234",
    "resp_bytes": "5678", "orig_pkts": "12", "resp_pkts": "18", "conn_state": "SF",
}


def test_connection_event(spark):
    row = N.connection_events(records(spark, ("conn", CONN), ("dns", CONN))).collect()
    assert len(row) == 1 and row[0].asDict() == {
        "timestamp": "2023-01-01T00:00:00Z", "event_type": "connection", "src_ip": "192.168.1.1",
        "src_port": 12345, "dst_ip": "10.0.0.1", "dst_port": 443, "protocol": "tcp",
        "duration": 1.42, "orig_bytes": 1234, "resp_bytes": 5678, "orig_pkts": 12,
        "resp_pkts": 18, "conn_state": "SF",
    }
    bare = {**CONN, "duration": None, "orig_bytes": None}
    row = N.connection_events(records(spark, ("conn", bare))).first()
    assert row.duration is None and row.orig_bytes is None


def test_json_per_type(spark):
    rows = records(
        spark,
        ("conn", CONN),
        ("dns", {"ts": "1", "query": "example.com", "qtype_name": "A", "rcode_name": "NOERROR", "answers": "a,b"}),
        ("http", {"ts": "1", "method": "GET", "status_code": "200"}),
        ("weird", {"ts": "1", "name": "bad_TCP_checksum", "id.orig_p": "7", "src_ip": "mine", "_path": "q"}),
        ("conn", {"ts": "inf"}),
        ("", {"ts": "1"}),
        ("conn", {}),
    )
    got = {(e := json.loads(r.json))["event_type"]: e for r in N.all_events(rows).collect()}
    assert list(got) and set(got) == {"connection", "dns", "http", "weird"}
    assert list(got["dns"]) == [
        "timestamp", "event_type", "src_ip", "src_port", "dst_ip", "dst_port", "protocol",
        "query", "qclass_name", "qtype_name", "rcode_name", "answers",
    ]
    assert got["dns"]["query"] == "example.com" and got["dns"]["protocol"] is None
    assert got["http"]["status_code"] == 200 and "protocol" not in got["http"]
    assert got["weird"]["src_ip"] == "mine" and got["weird"]["src_port"] == 7
    assert got["weird"]["name"] == "bad_TCP_checksum" and "_path" not in got["weird"]
    assert len(got["connection"]) == 13


def test_generic_event_keeps_the_rest(spark):
    row = N.other_events(records(spark, ("weird", {"ts": "1", "name": "n", "peer": None}))).first()
    assert row.event_type == "weird" and row.extra == {"name": "n", "peer": None}


def test_rotated_sink(spark, tmp_path):
    events = N.all_events(records(spark, ("conn", CONN)))
    at = F.lit("2024-03-05 10:47:10").cast("timestamp")
    sinks.write_events(events, str(tmp_path / "out"), 15, at)
    sinks.write_events(events, str(tmp_path / "out"), 15, at)
    sinks.write_events(events.limit(0), str(tmp_path / "none"), 15, at)
    got = spark.read.text(str(tmp_path / "out")).collect()
    assert [(r.date, r.slot) for r in got] == [("2024-03-05", "10-45")] * 2
    assert '"conn_state":"SF"' in got[0].value
    assert not list((tmp_path / "none").rglob("part-*"))
    bare = N.all_events(records(spark, ("conn", {"ts": "1"}))).first()
    assert '"duration":null' in bare.json
    with pytest.raises(KeyError):
        json.loads(bare.json)["query"]


def test_many_headers_in_a_block_do_not_multiply_lines(spark, tmp_path):
    """A line meets one state, whatever the number of headers around it."""
    text = "".join(
        header(f"p{i}", ["n", "v"]) + "".join(f"{i * 50 + j}\tx\n" for j in range(50)) for i in range(40)
    )
    (tmp_path / "conn.log").write_text(text)
    lines = zeek.read_log_lines(spark, str(tmp_path))
    split = zeek.split_lines(lines)
    assert "BroadcastNestedLoopJoin" not in split._jdf.queryExecution().toString()
    rows = split.select("path", F.get("parts", F.lit(0)).cast("int").alias("n")).collect()
    assert sorted(r.n for r in rows) == list(range(2000))
    assert all(r.path == f"p{r.n // 50}" for r in rows)
    begins = F.array(*[F.lit(v) for v in (0, 10, 20, 30, 40)])
    found = spark.range(1, 60).select("id", zeek.last_at_or_before(begins, F.col("id")).alias("at")).collect()
    assert all(r.at == min(4, r.id // 10) for r in found)


def test_broadcast_check_measures_rows(spark):
    from tidewatch.plans.materialize import fits_broadcast, written, written_bytes

    wide = written(spark.range(20_000).select(F.lit("y" * 2_000).alias("v")), "wide")
    assert written_bytes(wide) < 1 << 20 and not fits_broadcast(wide, 1 << 20)
    assert fits_broadcast(wide.limit(0))


def test_rotated_files_hold_many_blocks_and_read_on_their_own(spark):
    """Files follow the number of lines, also where a block has one line; each is led by the
    header that holds for it."""
    from tidewatch.plans.queries import _rotated

    heads = {0: "#path a\n#fields\tx\ty", 7: "#separator \\x7c\n#path b\n#fields |x|y"}
    rows = [("f", b, b * 10 - 5 + i, line) for b, text in heads.items() for i, line in enumerate(text.split("\n"))]
    rows += [("f", b, b * 10, f"{b}{'|' if b >= 7 else chr(9)}v") for b in range(20) if b != 7]
    rows += [(None, 3, 30, "lost"), ("f", None, None, "lost")]
    lines = spark.createDataFrame(rows, "file string, block bigint, pos bigint, value string")
    for turns in (1, 2):
        rotated = _rotated(lines, turns, per_file=4)
        assert rotated.filter("value = 'lost'").count() == 2
        known = rotated.filter("file = 'f' and block is not null")
        assert known.select("turn", "part").distinct().count() <= 5 * turns
        apart = known.select(F.concat_ws("-", "turn", "part").alias("file"), "block", "pos", "value")
        got = {(r.path, r.rec["x"]) for r in zeek.parse_log(apart).collect()}
        assert got == {("b" if b >= 7 else "a", str(b)) for b in range(20) if b != 7}


def test_log_queries_write_few_files(spark, tmp_path):
    from pathlib import Path

    from tidewatch.plans.queries import QUERIES
    from tidewatch.session import shared_dir

    kinds = F.element_at(F.array(*[F.lit(k) for k in ("view", "click", "purchase", "signup", "error")]), (F.col("id") % 5 + 1).cast("int"))
    # The first 40 in one block, so that each log begins there; then a block for each.
    ids = [i if i < 40 else (i - 39) * 4096 for i in range(300)]
    events = spark.range(300).select(
        F.when(F.col("id") < 40, F.col("id")).otherwise((F.col("id") - 39) * 4096).alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 8).alias("user_id"), kinds.alias("event_type"),
        F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    good = sum((i % 17 == 0) == (i % 19 == 0) for i in ids)
    base = Path(shared_dir(spark))
    for name, label, most in (("log_file_scan", "logs", 20), ("stream_event_log", "stream-logs", 20), ("stream_event_counts", "stream-counts", 40)):
        before = set(base.glob(f"{label}-*"))
        got = QUERIES[name](spark, str(tmp_path))
        rows = got.count() if name == "stream_event_log" else got.agg(F.sum("events")).first()[0]
        assert rows == good, name
        (folder,) = set(base.glob(f"{label}-*")) - before
        assert 0 < len(list(folder.rglob("log=*/part=*/part-*.txt"))) <= most, name


def test_logs_that_begin_in_a_later_block_keep_their_lines(spark, tmp_path):
    """Ssl lines after block 0 are piped; their header holds also where no ssl line is older."""
    from tidewatch.plans import adapters as ad

    ids = [0, 4096, 3 * 4096, 3 * 4096 + 4, 5 * 4096]
    rows = [(i, u, "signup", 1.0, "{}") for u, i in enumerate(ids)] + [(5 * 4096 + 4, 1, "signup", 1.0, "{}")]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string")
    at = F.timestamp_seconds(F.col("event_id") + 1_700_000_000).cast("timestamp_ntz")
    events.withColumn("ts", at).write.parquet(f"{tmp_path}/events.parquet")
    got = zeek.parse_log(ad.log_lines(spark, str(tmp_path))).collect()
    good = [i for i, *_ in rows if (i % 17 == 0) == (i % 19 == 0)]
    assert sorted(r.rec["uid"] for r in got) == sorted(f"C{i}" for i in good)
