import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lattica.operators import changes as C
from lattica.sources.tables import current_nodes


def _kv(spark, rows):
    return spark.createDataFrame(rows, "key string, hash string")


def test_diff_kinds_nulls_and_empty(spark):
    now = _kv(spark, [("a", "1"), ("b", "2"), ("c", None), ("d", None), ("n", "9")])
    then = _kv(spark, [("a", "1"), ("b", "3"), ("c", None), ("d", "4"), ("x", "5")])
    assert sorted(map(tuple, C.diff(now, then).collect())) == [("b", "updated"), ("d", "updated"), ("n", "added"), ("x", "deleted")]
    assert {tuple(r) for r in C.diff(now, _kv(spark, [])).collect()} == {(k, "added") for k in "abcdn"}
    assert {tuple(r) for r in C.diff(_kv(spark, []), then).collect()} == {(k, "deleted") for k in "abcdx"}


def test_hex_values_compare_by_value(spark):


    df = spark.createDataFrame([("00Ab",), ("ab",), ("0000",), (None,), (" AB ",)], "h string").select(C.hex_value(F.col("h")).alias("h"))
    assert [r[0] for r in df.collect()] == ["ab", "ab", "0", None, "ab"]


def test_latest_hash_ties_repeats_and_clashing_columns(spark):
    t = datetime(2025, 1, 1)
    rows = [("p", "01", t, 1), ("p", "02", t, 2), ("p", "02", t, 2), ("q", "05", None, 3), (None, "07", t, 4)]
    df = spark.createDataFrame(rows, "path string, h string, seen timestamp, hash int")
    assert sorted(map(tuple, C.latest_hashes(df, "path", "h", "seen").collect())) == [("p", "2"), ("q", "5")]


def test_content_hash_tells_nulls_and_limits_apart(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None), ("", "ab"), (None, "ab")], "x string, y string")
    assert C.with_content_hash(df, ["x", "y"]).select("hash").distinct().count() == 5


def test_store_swaps_versions_and_ignores_unfinished_ones(spark, tmp_path):
    store = C.StateStore(spark, str(tmp_path / "s"))
    assert store.version() is None and store.read().count() == 0
    assert store.publish(_kv(spark, [("a", "1")])) == 0
    _kv(spark, [("zz", "9")]).write.parquet(str(tmp_path / "s" / "v=1-unfinished"))  # a run that died before it published
    assert [tuple(r) for r in store.read().collect()] == [("a", "1")]
    assert C.StateStore(spark, str(tmp_path / "s")).publish(_kv(spark, [("a", "1"), ("b", "2")])) == 1
    assert C.diff(_kv(spark, [("a", "1"), ("b", "2")]), store.read()).count() == 0 and store.read(0).count() == 1
    cut = tmp_path / "s" / "_published" / "2"
    cut.write_text("v=2-cut off")  # no line end: being written, or its writer died
    with pytest.raises(RuntimeError):
        store.publish(_kv(spark, [("c", "1")]))
    os.utime(cut, (0, 0))
    assert store.version() == 1 and store.publish(_kv(spark, [("c", "1")])) == 2 and store.version() == 2


def test_two_runs_and_a_crash(spark, tmp_path):
    store, one, two = C.StateStore(spark, str(tmp_path / "s")), _kv(spark, [("a", "1"), ("b", "2")]), _kv(spark, [("a", "1"), ("b", "3"), ("c", "4")])
    assert sorted(map(tuple, C.process_changes(store, one, lambda c: c.select("key")).collect())) == [("a", "added"), ("b", "added")]

    def dies(changes):
        raise OSError("executor lost")

    with pytest.raises(OSError):
        C.process_changes(store, two, dies)
    assert store.version() == 0  # nothing skipped: the next run sees the same changes
    # a run that could process only one key leaves the other to the next
    assert sorted(map(tuple, C.process_changes(store, two, lambda c: c.where("key = 'c'").select("key")).collect())) == [("b", "updated"), ("c", "added")]
    assert [tuple(r) for r in C.process_changes(store, two, lambda c: c.select("key")).collect()] == [("b", "updated")]
    assert C.process_changes(store, two, lambda c: c.select("key")).count() == 0
    assert [tuple(r) for r in C.process_changes(store, two.where("key != 'a'"), lambda c: c.select("key")).collect()] == [("a", "deleted")]
    assert sorted(r["key"] for r in store.read().collect()) == ["b", "c"]


def test_of_racing_writers_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "s")
    C.StateStore(spark, root).publish(_kv(spark, []))

    def write(i):
        try:
            C.StateStore(spark, root).publish(_kv(spark, [(f"k{i}", "1")]), after=0)
            return i
        except RuntimeError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [i for i in pool.map(write, range(4)) if i is not None]
    store = C.StateStore(spark, root)
    assert len(won) == 1 and store.version() == 1 and [r["key"] for r in store.read().collect()] == [f"k{won[0]}"]
    with pytest.raises(RuntimeError):
        store.publish(_kv(spark, []), after=0)


def test_stored_state_and_current_rows(spark):
    t = lambda d: datetime(2025, 1, d)
    nodes = spark.createDataFrame([("a", "0A", 1, t(1)), ("a", "0B", 2, t(2)), ("a", "0B", 2, t(2)), ("a", "0C", 9, t(9)), ("b", "01", 1, t(1)), ("c", "02", 1, t(5)), (None, "03", 1, t(1)), ("d", "04", 1, None)], "path string, content_hash string, run_id long, saved_at timestamp")
    runs = spark.createDataFrame([(1,), (2,), (2,)], "run_id long")
    gone = spark.createDataFrame([("b", t(3)), ("c", t(3)), ("b", t(3)), (None, t(3)), ("a", None)], "path string, deleted_at timestamp")
    state = C.stored_state(current_nodes(nodes, runs), gone)
    assert sorted(map(tuple, state.collect())) == [("a", "b"), ("c", "2"), ("d", "4")]
    assert current_nodes(nodes.limit(0), runs).count() == 0
