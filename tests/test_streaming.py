"""The incremental refresh over small folders of change records."""

import datetime as dt
import json

import pytest

from graphweft.streaming import freshness, refresh, sessions


def put(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"file": f, "fingerprint": p, "deleted": d, "ts": t}) for f, p, d, t in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


def run(spark, tmp, quiet=None):
    stream = refresh.changes(spark, str(tmp / "in"), files_per_batch=1)
    refresh.start(stream, str(tmp / "table"), str(tmp / "ckpt"), quiet=quiet, availableNow=True).awaitTermination()
    return {(r.file, r.fingerprint) for r in refresh.snapshot(spark, str(tmp / "table")).collect()}


def test_refresh_merges_and_resumes(spark, tmp_path):
    put(tmp_path / "in", "1.json", ("a", "x1", False, "2024-01-01T00:00:00"), ("b", "y1", None, "2024-01-01T00:00:00"), (None, "z", False, "2024-01-01T00:00:00"))
    assert run(spark, tmp_path) == {("a", "x1"), ("b", "y1")}
    put(tmp_path / "in", "2.json", ("a", "x2", False, "2024-01-01T00:01:00"), ("a", "x3", False, "2024-01-01T00:02:00"), ("b", None, True, "2024-01-01T00:01:00"))
    assert run(spark, tmp_path) == {("a", "x3")}


def test_debounced_bursts_reach_the_table(spark, tmp_path):
    put(tmp_path / "in", "1.json", ("a", "x1", False, "2024-01-01T00:00:00"), ("a", "x2", False, "2024-01-01T00:00:01"))
    put(tmp_path / "in", "2.json", ("b", "y", False, "2024-01-01T01:00:00"))
    put(tmp_path / "in", "3.json", ("c", "z", False, "2024-01-01T03:00:00"))
    assert run(spark, tmp_path, "1500 milliseconds") >= {("a", "x2")}
    assert ("a", "x1") not in run(spark, tmp_path, "1500 milliseconds")


def changed(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, fingerprint string, deleted boolean, ts timestamp")


T = dt.datetime(2024, 1, 1)


def test_equal_fingerprints_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "table")
    refresh.merge(changed(spark, ("a", "x", False, T)), 0, folder)
    refresh.merge(changed(spark, ("a", "x", False, T), ("gone", None, True, T)), 1, folder)
    assert refresh._rows(spark, folder).filter("batch = 1").count() == 0
    refresh.merge(changed(spark, ("a", "x2", False, T)), 2, folder)
    refresh.merge(changed(spark, ("a", "x2", False, T)), 2, folder)  # the batch again, after a failure
    assert [r.fingerprint for r in refresh.snapshot(spark, folder).collect()] == ["x2"]
    refresh.merge(changed(spark), 3, folder)
    assert refresh.snapshot(spark, folder).count() == 1


def test_compaction_keeps_the_state_and_drops_the_deltas(spark, tmp_path):
    folder = str(tmp_path / "table")
    refresh.compact(spark, folder)
    refresh.merge(changed(spark, ("a", "x", False, T), ("b", "y", False, T), ("c", "z", False, T)), 0, folder)
    refresh.merge(changed(spark, ("b", None, True, T)), 1, folder)
    refresh.compact(spark, folder)
    state = lambda: {(r.file, r.fingerprint) for r in refresh.snapshot(spark, folder).collect()}
    assert state() == {("a", "x"), ("c", "z")}
    assert not list((tmp_path / "table" / "deltas").glob("batch=*"))
    refresh.merge(changed(spark, ("a", "x", False, T), ("c", "z2", False, T), ("d", "w", False, T)), 2, folder)
    assert state() == {("a", "x"), ("c", "z2"), ("d", "w")}
    refresh.compact(spark, folder)
    assert state() == {("a", "x"), ("c", "z2"), ("d", "w")} and [p.name for p in (tmp_path / "table" / "base").glob("upto=*")] == ["upto=2"]


def test_an_unknown_change_is_settled_by_a_whole_listing(spark, tmp_path):
    folder = str(tmp_path / "table")
    refresh.merge(changed(spark, ("a", "x", False, T), ("b", "y", False, T)), 0, folder)
    refresh.reconcile(spark.createDataFrame([("a", "x", T), ("c", "z", T)], "file string, fingerprint string, ts timestamp"), 1, folder)
    assert {(r.file, r.fingerprint) for r in refresh.snapshot(spark, folder).collect()} == {("a", "x"), ("c", "z")}


def test_bursts_end_when_a_file_is_quiet(spark, tmp_path):
    put(tmp_path / "in", "1.json", ("a", "x1", False, "2024-01-01T00:00:00"), ("a", "x2", False, "2024-01-01T00:00:01"), ("a", "x3", False, "2024-01-01T00:00:10"))
    put(tmp_path / "in", "2.json", ("b", "y", False, "2024-01-01T01:00:00"))
    stream = refresh.debounced(refresh.changes(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.file, r.fingerprint, r.n) for r in spark.table("bursts").collect()}
    assert got == {("a", "x2", 2), ("a", "x3", 1)}


def test_a_degraded_session_stays_so_until_it_recovers(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    say = lambda name, *rows: (folder / name).write_text("\n".join(json.dumps({"session": s, "event": e, "ts": f"2024-01-01T00:00:0{e}", "cause": c}) for s, e, c in rows))
    say("1.json", ("a", 1, None), ("a", 2, "down"), ("b", 1, None))
    stream = spark.readStream.schema("session string, event bigint, ts timestamp, cause string").json(str(folder))

    def follow():
        writer = sessions.degraded(stream).writeStream.format("json").outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt"))
        writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return {(r.session, r.event, r.state, r.cause) for r in spark.read.schema("session string, event bigint, state string, since timestamp, cause string").json(str(tmp_path / "out")).collect()}

    assert follow() == {("a", 1, "ok", None), ("a", 2, "degraded", "down"), ("b", 1, "ok", None)}
    say("2.json", ("a", 3, "slow"), ("a", 4, None), ("a", 5, None))
    assert follow() >= {("a", 3, "degraded", "down"), ("a", 4, "recovered", "down"), ("a", 5, "ok", None)}


def test_staleness(spark):
    commits = spark.createDataFrame([("c1", 1), ("c2", 2), ("c3", 3)], "commit string, place int")
    got = lambda *args: tuple(freshness.staleness(commits, *args).first())
    assert got("c3", 0) == (0, False, None) and got("c1", 0) == (2, True, None) and got("c3", 4) == (0, True, None)
    assert got("other", 0) == (None, None, None) and got(None, 0) == (None, None, "no index")


def test_results_are_kept_for_a_while(spark):
    now, made = [0.0], []
    kept = freshness.Kept(5, lambda: now[0])
    make = lambda: made.append(1) or spark.range(3)
    first = kept.get("k", make)
    now[0] = 4.9
    assert kept.get("k", make) is first
    now[0] = 5.0
    assert kept.get("k", make) is not first and len(made) == 2


def test_one_writer_at_a_time(spark, tmp_path):
    folder = f"file://{tmp_path}"
    with freshness.WriteLock(spark, folder), pytest.raises(TimeoutError), freshness.WriteLock(spark, folder, wait=0.3):
        pass
    with freshness.WriteLock(spark, folder, wait=0.3):
        pass


def test_a_lock_that_was_taken_over_stays_with_who_took_it(spark, tmp_path):
    folder = f"file://{tmp_path}"
    slow = freshness.WriteLock(spark, folder)
    with slow:
        assert slow.renew()
        with freshness.WriteLock(spark, folder, wait=5, expires=-1) as next_:
            assert not slow.renew()
            slow.__exit__()
            assert next_.renew()
        assert not (tmp_path / ".lock").exists() and not list(tmp_path.glob(".lock.*"))
