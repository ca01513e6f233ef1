"""Databases as source and sink: ranges, changes by key, and writes that are repeated, die half way or are aborted."""

import pytest
from pyspark.sql.types import StructType

from heliograph.sources import database as db

ROWS = [(1, "a", 1.5), (2, "b", None), (3, None, 3.5), (None, "d", 4.5), (9, "ü'\"", -1.0)]


@pytest.fixture
def at(tmp_path):
    connect = {"database": str(tmp_path / "x.db"), "timeout": 60}
    db.execute(connect, 'CREATE TABLE "my table" (id BIGINT, name TEXT, "the value" DOUBLE)')
    return connect


def all_rows(at):
    return sorted(db.execute(at, 'SELECT * FROM "my table"'), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, `the value` double")


def test_rows_come_back_in_any_number_of_ranges(spark, at):
    db.change_rows(frame(spark, ROWS).repartition(3), at, "my table", "insert")
    assert all_rows(at) == sorted(ROWS, key=str)
    for parts in (1, 2, 5):
        got = db.read_query(spark, at, 'SELECT id, name, "the value" FROM "my table"', "id long, name string, v double", column="id", low=0, high=10, parts=parts)
        assert got.rdd.getNumPartitions() == parts and sorted(map(tuple, got.collect()), key=str) == sorted(ROWS, key=str)
    assert db.read_query(spark, at, 'SELECT count(*) AS n FROM "my table"', "n long").first()[0] == 5


def test_replaced_and_deleted_by_key(spark, at):
    db.change_rows(frame(spark, ROWS), at, "my table", "insert")
    db.change_rows(frame(spark, [(2, "new", 7.0), (50, "more", 8.0)]), at, "my table", "replace", ["id"])
    db.change_rows(frame(spark, [(1, None, None), (77, None, None)]), at, "my table", "delete", ["id"])
    assert all_rows(at) == sorted([(2, "new", 7.0), (50, "more", 8.0), *ROWS[2:]], key=str)
    with pytest.raises(Exception, match="keys"):
        db.change_rows(frame(spark, ROWS), at, "my table", "delete")


def test_a_name_is_written_once(spark, at):
    for _ in range(3):
        db.change_rows(frame(spark, ROWS), at, "my table", "insert", name="monday")
    assert len(all_rows(at)) == 5 and db.execute(at, "SELECT * FROM spark_writes") == [("monday", 5)]


def test_repeated_tasks_and_lost_attempts_leave_each_row_once(at):
    schema = StructType().add("id", "long").add("name", "string").add("the value", "double")
    import json

    w = db.StagedWriter({"connect": json.dumps(at), "table": "my table", "name": "n"}, schema)

    def dies():
        yield ROWS[0]
        raise OSError("the executor is lost")

    with pytest.raises(OSError, match="lost"):
        w.put(dies(), 0, 0)
    w.put(iter(ROWS[:2]), 0, 1)  # finished, but its executor was lost before it could say so
    first, second = w.put(iter(ROWS[:2]), 0, 2), w.put(iter(ROWS[2:]), 1, 3)
    w.commit([first, second, None])
    assert all_rows(at) == sorted(ROWS, key=str)
    again = db.StagedWriter({"connect": json.dumps(at), "table": "my table", "name": "n"}, schema)
    again.commit([again.put(iter(ROWS), 0, 9)])
    assert all_rows(at) == sorted(ROWS, key=str) and not db.execute(at, "SELECT name FROM sqlite_master WHERE name LIKE 'stage%'")


def test_a_failed_job_leaves_nothing_and_can_be_run_again(spark, at):
    def fails(parts):
        for p in parts:
            if (p["id"] == 9).any():
                raise ValueError("bad row")
            yield p

    d = frame(spark, ROWS).repartition(4, "name")
    with pytest.raises(Exception, match="bad row"):
        db.change_rows(d.mapInPandas(fails, d.schema), at, "my table", "insert", name="n")
    assert all_rows(at) == [] and not db.execute(at, "SELECT name FROM sqlite_master WHERE name LIKE 'stage%'")
    db.change_rows(d, at, "my table", "insert", name="n")
    assert all_rows(at) == sorted(ROWS, key=str)


def test_changes_by_key_do_not_read_the_stage_for_each_row(at):
    import json
    import sqlite3

    schema, rows, steps = StructType().add("id", "long").add("name", "string").add("the value", "double"), [(i, "a", 0.5) for i in range(3000)], []
    for mode in ("insert", "replace", "delete"):
        w = db.StagedWriter({"connect": json.dumps(at), "table": "my table", "mode": mode, "keys": '["id"]'}, schema)
        message = w.put(iter(rows), 0, 1)

        def counted():
            c = sqlite3.connect(**at)
            c.set_progress_handler(lambda: steps.append(1), 1000)
            return c

        w.link.open = counted
        w.commit([message])
        assert len(all_rows(at)) == (0 if mode == "delete" else 3000)
    assert len(steps) < 1000  # a million of SQLite's instructions
