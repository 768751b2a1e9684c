import os
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import rotation
from tidewatch.operators.retention import clean_expired, clean_slots, expired_files, slots_of


@pytest.mark.parametrize(
    "at, minutes, name",
    [
        ("2026-09-09 22:00:00", 1, "flows_2026-09-09_22-00.csv"),
        ("2026-09-09 14:37:45", 5, "flows_2026-09-09_14-35.csv"),
        ("2026-09-09 08:03:12", 1, "flows_2026-09-09_08-03.csv"),
        ("2026-09-09 10:22:00", 15, "flows_2026-09-09_10-15.csv"),
        ("2026-09-10 00:00:00", 1, "flows_2026-09-10_00-00.csv"),
        ("2026-09-10 10:37:00", 25, "flows_2026-09-10_10-25.csv"),
        ("2026-09-10 10:37:00", 0, "flows_2026-09-10_10-37.csv"),
    ],
)
def test_file_names(one, at, minutes, name):
    ts = F.col("t").cast("timestamp")
    assert one("t string", (at,), n=rotation.flow_file_name(ts, minutes))["n"] == name


@pytest.mark.parametrize(
    "at, minutes, left",
    [
        ("2026-09-09 15:30:00", 1, 60),
        ("2026-09-09 15:30:30", 1, 30),
        ("2026-09-09 15:32:00", 5, 180),
        ("2026-09-09 15:55:00", 25, 300),
        ("2026-09-09 15:59:59.9", 1, 1),
    ],
)
def test_next_slot(one, at, minutes, left):
    ts = F.col("t").cast("timestamp")
    assert one("t string", (at,), n=rotation.seconds_to_next_slot(ts, minutes))["n"] == left


def aged(folder, name, minutes, now):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("{}\n")
    os.utime(path, (now - minutes * 60, now - minutes * 60))
    return path


def test_retention(spark, tmp_path):
    now = float(int(time.time()))
    old = aged(tmp_path, "2024-01-01/10-00.jsonl", 20, now)
    new = aged(tmp_path, "2024-01-02/10-00.jsonl", 0, now)
    edge = aged(tmp_path, "2024-01-02/10-15.jsonl", 10, now)
    other = aged(tmp_path, "2024-01-03/notes.md", 99, now)
    part = aged(tmp_path, "date=2024-01-04/slot=10-00/part-0.txt", 20, now)
    names = [r.path.rsplit("/", 1)[-1] for r in expired_files(spark, str(tmp_path), 10, now).collect()]
    assert sorted(names) == ["10-00.jsonl", "part-0.txt"]
    assert clean_expired(spark, str(tmp_path), 10, now, dry_run=True) == 2 and old.exists()
    assert clean_expired(spark, str(tmp_path), 0, now) == 0 and old.exists()
    assert clean_expired(spark, str(tmp_path), 10, now) == 2
    assert not old.parent.exists() and not part.exists()
    assert new.exists() and edge.exists() and other.exists()


def test_retention_of_missing_and_nested_folders(spark, tmp_path):
    assert clean_expired(spark, str(tmp_path / "absent"), 10) == 0
    slot = tmp_path / "events" / "date=2024-01-01" / "slot=00-00"
    slot.mkdir(parents=True)
    (slot / "part-0.txt").write_text("x\n")
    assert clean_expired(spark, str(tmp_path / "events"), 10, now=4102444800.0) == 1
    assert not (tmp_path / "events" / "date=2024-01-01").exists()


def slotted(tmp_path, name, age, now):
    return aged(tmp_path / "events", name + "/part-0.txt", age, now)


def test_retention_by_slots(spark, tmp_path):
    """Slots that ended before the limit go whole; in the slot of the limit files decide."""
    folder, now = str(tmp_path / "events"), 1709632800.0  # 2024-03-05 10:00
    gone = [slotted(tmp_path, f"date=2024-03-05/slot={s}", 0, now) for s in ("09-00", "09-15", "09-30")]
    gone.append(slotted(tmp_path, "date=2024-03-04/slot=23-45", 0, now))
    edge_old = aged(tmp_path / "events", "date=2024-03-05/slot=09-45/part-1.txt", 11, now)
    edge_new = aged(tmp_path / "events", "date=2024-03-05/slot=09-45/part-2.txt", 5, now)
    later = slotted(tmp_path, "date=2024-03-05/slot=10-00", 99, now)
    other = aged(tmp_path / "events", "notes/part-9.txt", 99, now)
    found = {r.path.rsplit("slot=", 1)[1]: (r.begins, r.ends) for r in slots_of(spark, folder, 15).collect()}
    assert len(found) == 6 and (found["23-45"][1] - found["23-45"][0]).seconds == 900
    # A rotation that does not divide the hour ends with it.
    assert {(r.ends - r.begins).seconds for r in slots_of(spark, folder, 25).collect()} == {1500, 900}
    assert clean_slots(spark, folder, 0, now, 15) == 0 and all(p.exists() for p in gone)
    assert clean_slots(spark, folder, 10, now, 15) == 5
    assert not any(p.exists() for p in [*gone, edge_old]) and not (tmp_path / "events" / "date=2024-03-04").exists()
    assert edge_new.exists() and later.exists() and other.exists()
    assert clean_slots(spark, str(tmp_path / "absent"), 10, now) == 0
