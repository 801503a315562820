"""Whole snapshots at every step, one winner among writers."""

from __future__ import annotations

import os
import uuid

import pytest

from attrition.session import scratch_path
from attrition.sources import snapshots
from attrition.sources.tables import save_training_table


@pytest.fixture
def place(spark):
    name = f"snap_{uuid.uuid4().hex[:8]}"
    return name, scratch_path(spark, name)


def test_a_save_that_stops_before_publication_leaves_the_old_rows(spark, place, monkeypatch):
    name, path = place
    save_training_table(spark.range(5), name, path=path)

    class Killed(BaseException):
        """Nothing is tidied up after it, as after a lost driver."""

    def stop(*_):
        raise Killed

    for step in ("publish", "point"):
        with monkeypatch.context() as m:
            m.setattr(snapshots, step, stop)
            with pytest.raises(Killed):
                save_training_table(spark.range(3), name, path=path)
        assert spark.table(name).count() == 5
    # the second one was published; only the name had not moved on
    assert snapshots.versions(spark, path) == [1, 2]
    assert snapshots.read_snapshot(spark, path).count() == 3
    assert snapshots.repair(spark, name).version == 2
    assert spark.table(name).count() == 3
    save_training_table(spark.range(7), name, path=path)
    assert spark.table(name).count() == 7


def test_of_two_writers_one_gets_a_clear_error(spark, place, monkeypatch):
    name, path = place
    save_training_table(spark.range(5), name, path=path)
    plain = snapshots.publish

    def overtaken(session, root, new):
        monkeypatch.setattr(snapshots, "publish", plain)
        save_training_table(spark.range(4), name, path=path)  # another writer, from the same version
        plain(session, root, new)

    monkeypatch.setattr(snapshots, "publish", overtaken)
    with pytest.raises(snapshots.PublishConflict, match="version 2"):
        save_training_table(spark.range(9), name, path=path)
    assert spark.table(name).count() == 4 and snapshots.versions(spark, path) == [1, 2]
    assert len(os.listdir(f"{path}/data")) == 2  # the loser's rows are gone
    assert not [f for f in os.listdir(f"{path}/versions") if f.startswith("draft")]


def test_readers_of_the_last_version_finish_and_older_ones_go(spark, place):
    name, path = place
    save_training_table(spark.range(1), name, path=path)
    held = spark.table(name)
    save_training_table(spark.range(2), name, path=path)
    assert held.count() == 1
    for n in (3, 4):
        save_training_table(spark.table(name).union(spark.range(1)), name, path=path)  # reads what it replaces
        assert spark.table(name).count() == n
    assert snapshots.versions(spark, path) == [3, 4]
    assert len(os.listdir(f"{path}/data")) == 2
    assert len([t for t in spark.catalog.listTables() if t.name.startswith(f"{name}__snapshot_")]) == 2


def test_versions_are_published_once_where_a_rename_decides(spark, place):
    _, path = place
    new = snapshots.Snapshot(1, "t", f"{path}/data/x", spark.range(1).schema.json())
    snapshots.publish(spark, path, new)
    conflict = snapshots.PublishConflict("taken")
    for n, (target, taken) in enumerate([("versions/new.json", False), ("versions/" + f"{1:020d}.json", True)]):
        draft = f"{path}/draft{n}"
        with open(draft, "w") as f:
            f.write("{}")
        if taken:
            with pytest.raises(snapshots.PublishConflict):
                snapshots._rename_unless_there(spark, f"file://{draft}", f"file://{path}/{target}", conflict)
        else:
            snapshots._rename_unless_there(spark, f"file://{draft}", f"file://{path}/{target}", conflict)
    assert snapshots.snapshot(spark, path) == new


def test_a_plain_table_is_taken_over_with_its_schema(spark, place):
    name, path = place
    spark.createDataFrame([(1, "a")], "id long, a string").write.option("path", f"{path}-old").saveAsTable(name)
    save_training_table(spark.createDataFrame([(2,)], "id long"), name, path=path)
    assert [tuple(r) for r in spark.table(name).collect()] == [(2, None)]
    kept = [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name}__before_snapshots")]
    assert len(kept) == 1 and spark.table(kept[0]).count() == 1


def test_partitioned_save_keeps_types(spark, place):
    name, path = place
    save_training_table(spark.createDataFrame([("07", 1), ("x", 2)], "day string, n int"), name, path=path, partition_by=["day"])
    assert sorted(tuple(r) for r in spark.table(name).select("day", "n").collect()) == [("07", 1), ("x", 2)]
    assert dict(spark.table(name).dtypes) == {"day": "string", "n": "int"}


def test_names_without_snapshots(spark, place):
    name, path = place
    assert snapshots.root_of(spark, name) is None and snapshots.snapshot(spark, path) is None
    with pytest.raises(ValueError, match="no published snapshot"):
        snapshots.repair(spark, name)
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.read_snapshot(spark, path)
