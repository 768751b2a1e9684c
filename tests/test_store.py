"""The scenario store: two tables that change at once."""

import pytest

from tidewatch.plans import files
from tidewatch.sources import scenario_store as store


def tables(spark, ids, name, steps):
    meta = spark.createDataFrame([(i, name, "t") for i in ids], "scenario_id string, name string, target_asset string")
    rows = [(i, s, name) for i in ids for s in range(steps)]
    return meta, spark.createDataFrame(rows, "scenario_id string, step_index int, of string")


def seen(spark, folder):
    meta = {r.scenario_id: r.name for r in store.load_table(spark, folder, store.META).collect()}
    steps = {}
    for r in store.load_table(spark, folder, store.WINDOWS).collect():
        assert r.of == steps.setdefault(r.scenario_id, [r.of])[0]
        steps[r.scenario_id].append(r.step_index)
    return meta, {i: (of, sorted(s)) for i, (of, *s) in steps.items()}


def test_both_tables_or_none(spark, tmp_path, monkeypatch):
    """A save that breaks between the two tables, or before it is published, changes nothing."""
    folder = str(tmp_path / "store")
    assert store.load_table(spark, folder, store.META) is None
    store.save_scenarios(*tables(spark, ["a", "b/ü"], "one", 2), folder)
    before = seen(spark, folder)
    assert before == ({"a": "one", "b/ü": "one"}, {"a": ("one", [0, 1]), "b/ü": ("one", [0, 1])})
    meta, windows = tables(spark, ["a"], "two", 3)
    broken = meta.selectExpr("scenario_id", "raise_error('no name') AS name", "target_asset")
    with pytest.raises(Exception, match="no name"):
        store.save_scenarios(broken, windows, folder)
    assert seen(spark, folder) == before
    assert len(list(files.children(spark, f"{folder}/{store.WINDOWS}"))) == 1
    whole = files.write_bytes

    def ends_before_publication(session, path, content):
        if "/published/" in path:
            raise SystemExit
        whole(session, path, content)

    monkeypatch.setattr(files, "write_bytes", ends_before_publication)
    with pytest.raises(SystemExit):
        store.save_scenarios(meta, windows, folder)
    monkeypatch.undo()
    assert seen(spark, folder) == before
    store.save_scenarios(meta, windows, folder)
    assert seen(spark, folder) == ({"a": "two", "b/ü": "one"}, {"a": ("two", [0, 1, 2]), "b/ü": ("one", [0, 1])})


def test_replacement_without_windows_and_old_versions(spark, tmp_path):
    folder = str(tmp_path / "store")
    for name, ids, steps in (("one", ["a", "b"], 2), ("two", ["a"], 1), ("three", ["a"], 0), ("four", ["c"], 1)):
        store.save_scenarios(*tables(spark, ids, name, steps), folder)
    want = {"a": "three", "b": "one", "c": "four"}, {"b": ("one", [0, 1]), "c": ("four", [0])}
    assert seen(spark, folder) == want
    assert store.drop_superseded(spark, folder) == 1 and len(store.published(spark, folder)) == 3
    assert seen(spark, folder) == want
    store.save_scenarios(store.load_table(spark, folder, store.META), store.load_table(spark, folder, store.WINDOWS), folder)
    assert store.drop_superseded(spark, folder) == 3 and seen(spark, folder) == want


def test_windows_only_and_two_writers(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    store.save_scenarios(*tables(spark, ["a"], "one", 1), folder)
    meta, windows = tables(spark, ["a"], "two", 2)
    store.save_scenarios(meta.limit(0), windows, folder)
    assert seen(spark, folder) == ({"a": "one"}, {"a": ("two", [0, 1])})
    # Both writers saw the same versions; different scenarios of both are there.
    known = store.published(spark, folder)
    monkeypatch.setattr(store, "published", lambda *_: known)
    store.save_scenarios(*tables(spark, ["b"], "left", 1), folder)
    store.save_scenarios(*tables(spark, ["c"], "right", 1), folder)
    monkeypatch.undo()
    assert seen(spark, folder)[0] == {"a": "one", "b": "left", "c": "right"}
