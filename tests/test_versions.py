"""Versioned stores: readers and writers interleaved at every step, and writers that die between any two steps."""

from __future__ import annotations

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from playbill import schemas
from playbill.sources import sinks, versions
from playbill.sources.versions import Change
from playbill.streaming import jobs

DAYS = ["2026-01-10", "2026-01-11", "2026-01-12"]


def days(spark, *pairs):
    return spark.createDataFrame([(n, dt.date.fromisoformat(d) if d else None) for n, d in pairs], "n long, date date")


def rows(spark, root, name="t", parts=None):
    return sorted((r.n, str(r.date)) for r in versions.read(spark, versions.load(spark, root), name, parts).collect())


def files(spark, root, parts):
    return sorted(versions.read(spark, versions.load(spark, root), "t", parts).inputFiles())


def test_a_table_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(5), path)
    before = sinks.stored_table(spark, path)
    sinks.replace_table(before.filter("id < 3"), path)
    assert sinks.stored_table(spark, path).count() == 3 and before.count() == 5  # a reader keeps its version
    with pytest.raises(KeyError):
        versions.read(spark, versions.load(spark, path), "other")
    assert versions.load(spark, str(tmp_path / "none")) is None


def test_parts_are_replaced_appended_and_dropped(spark, tmp_path):
    root = str(tmp_path / "s")
    first = versions.commit(spark, root, None, [Change("t", days(spark, (1, DAYS[0]), (2, DAYS[1]), (3, None)), by="date")])
    assert first.parts("t") == [DAYS[0], DAYS[1], "none"]
    kept = files(spark, root, [DAYS[1], "none"])
    second = versions.commit(spark, root, first, [Change("t", days(spark, (4, DAYS[0]), (5, DAYS[2])), by="date", mode="parts", parts=(DAYS[0], DAYS[2]))])
    assert rows(spark, root) == [(2, DAYS[1]), (3, "None"), (4, DAYS[0]), (5, DAYS[2])]
    assert files(spark, root, [DAYS[1], "none"]) == kept and rows(spark, root, parts=[DAYS[2], "missing"]) == [(5, DAYS[2])]
    third = versions.commit(spark, root, second, [Change("t", days(spark, (6, DAYS[0])), by="date", mode="append")], {"t": [DAYS[2]]}, {"mark": 1})
    assert rows(spark, root, parts=[DAYS[0]]) == [(4, DAYS[0]), (6, DAYS[0])] and third.notes == {"mark": 1}
    # a part whose rows are all gone leaves, and stray rows are refused
    versions.commit(spark, root, third, [Change("t", days(spark), by="date", mode="parts", parts=(DAYS[0],))])
    assert rows(spark, root) == [(2, DAYS[1]), (3, "None")]
    with pytest.raises(ValueError):
        versions.commit(spark, root, versions.load(spark, root), [Change("t", days(spark, (9, DAYS[2])), by="date", mode="parts", parts=(DAYS[0],))])
    with pytest.raises(ValueError):
        versions.commit(spark, root, versions.load(spark, root), [Change("t", days(spark, (9, DAYS[2])), by="n", mode="append")])


def test_writers_of_other_parts_both_stay_and_of_the_same_part_clash(spark, tmp_path):
    root = str(tmp_path / "s")
    base = versions.commit(spark, root, None, [Change("t", days(spark, (1, DAYS[0]), (2, DAYS[1])), by="date")])
    versions.commit(spark, root, base, [Change("t", days(spark, (3, DAYS[0])), by="date", mode="parts", parts=(DAYS[0],))])
    versions.commit(spark, root, base, [Change("t", days(spark, (4, DAYS[1])), by="date", mode="parts", parts=(DAYS[1],))])
    assert rows(spark, root) == [(3, DAYS[0]), (4, DAYS[1])]
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, base, [Change("t", days(spark, (5, DAYS[0])), by="date", mode="parts", parts=(DAYS[0],))])
    noted = versions.commit(spark, root, versions.load(spark, root), notes={"batch": 1})
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, base, notes={"batch": 1})
    assert versions.load(spark, root) == noted and rows(spark, root) == [(3, DAYS[0]), (4, DAYS[1])]


STEPS = ["_write", "_applied", "_publish", "after"]


@pytest.mark.parametrize("step", STEPS)
def test_a_reader_between_any_two_steps_loses_nothing(spark, tmp_path, monkeypatch, step):
    """The lost update of two renames: a reader that comes while a writer stands between its steps must not change what the writer does."""
    path, seen = f"{tmp_path}/t", []
    sinks.replace_table(spark.range(3), path)
    look = lambda: seen.append(sinks.stored_table(spark, path).count())
    if step != "after":
        real = getattr(versions, step)
        monkeypatch.setattr(versions, step, lambda *a: [look(), real(*a), look()][1])
    sinks.replace_table(spark.range(10), path)
    look()
    assert seen[-1] == 10 and set(seen[:-1]) <= {3, 10} and seen == sorted(seen)


@pytest.mark.parametrize("step", STEPS[:-1])
@pytest.mark.parametrize("late", [False, True])
def test_a_writer_that_dies_leaves_the_former_state(spark, tmp_path, monkeypatch, step, late):
    path = f"{tmp_path}/t"
    sinks.replace_table(spark.range(3), path)
    real = getattr(versions, step)

    def dies(*a):
        if late:
            real(*a)
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(versions, step, dies)
        with pytest.raises(OSError):
            sinks.replace_table(spark.range(10), path)
    done = late and step == "_publish"
    assert sinks.stored_table(spark, path).count() == (10 if done else 3)
    sinks.replace_table(spark.range(2), path)
    assert sinks.stored_table(spark, path).count() == 2
    assert versions.vacuum(spark, path, keep=1, grace_seconds=3600) == 0  # too young to tell from a running writer
    left = 1 if step == "_write" and not late else 2  # the first rows, and what the dead writer wrote
    assert versions.vacuum(spark, path, keep=1, grace_seconds=0) == left and sinks.stored_table(spark, path).count() == 2


def test_many_writers_at_once_lose_no_commit(spark, tmp_path):
    root = str(tmp_path / "s")
    versions.commit(spark, root, None, [Change("t", days(spark, (0, DAYS[0])), by="date")])
    errors = []

    def add(n):
        try:
            base = versions.load(spark, root)
            versions.commit(spark, root, base, [Change("t", days(spark, (n, DAYS[0])), by="date", mode="append")], blind=True)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=add, args=(n,)) for n in range(1, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and [r[0] for r in rows(spark, root)] == list(range(7)) and versions.load(spark, root).version == 7


# streams over versioned stores


def event(n, day, act, url="a.example", venue="Hall"):
    return (n, act, venue, "", "Town", dt.date.fromisoformat(day) if day else None, f"https://{url}/{n}", [], "", "", "", [], n)


def stored_events(spark, store):
    return {(r.id, str(r.date), r.act, tuple(r.sources)) for r in sinks.stored_table(spark, store, "events").collect()}


def test_batches_read_and_replace_their_days_alone(spark, tmp_path):
    store = f"{tmp_path}/store"
    hall = spark.createDataFrame([("v-1", "Hall", [], "", "1")], jobs.VENUES)
    old = spark.createDataFrame([event("0a", "2026-01-09", "Past"), event("0b", DAYS[0], "Band"), event("0c", DAYS[1], "Solo"), event("0d", None, "Some Day")], schemas.EVENTS)
    state = jobs.start_store(spark, store, old, hall)
    batch = lambda *e: spark.createDataFrame(list(e), schemas.EVENTS)
    state = jobs.fold_batch(spark, store, state, batch(event("n1", DAYS[0], "Band", "b.example")), hall, DAYS[0], 0)
    assert state.parts("events") == [DAYS[0], DAYS[1], "none"]  # the day that is over left
    assert {r.venue_id for r in sinks.stored_table(spark, store, "events").collect()} == {"v-1"}  # the first batch links all rows
    kept = versions.read(spark, state, "events", [DAYS[1], "none"]).inputFiles()
    more = batch(event("n2", DAYS[0], "Duo", venue="New Room"), event("0c", DAYS[2], "Trio"), event("n4", "2026-01-08", "Late"))
    state = jobs.fold_batch(spark, store, state, more, hall, DAYS[0], 1)
    assert versions.read(spark, state, "events", [DAYS[1], "none"]).inputFiles() == kept
    got = stored_events(spark, store)
    assert {g for g in got if g[2] == "Band"} == {("0b", DAYS[0], "Band", ("https://b.example/n1",))}
    trio = [g for g in got if g[2] == "Trio"]
    assert len(trio) == 1 and trio[0][0] not in ("0c", "")  # its id is taken on a day that was not read
    assert "2026-01-08" in state.parts("events")
    assert sorted(r.name for r in versions.read(spark, state, "venues").collect()) == ["Hall", "New Room"]
    # the next day: what is over leaves without being read, the late row with it
    state = jobs.fold_batch(spark, store, state, batch(event("n5", DAYS[2], "Trio", "c.example")), hall, DAYS[1], 0)
    assert state.parts("events") == [DAYS[1], DAYS[2], "none"] and len(stored_events(spark, store)) == 3


def test_scores_leave_untouched_buckets_alone(spark, tmp_path):
    store = f"{tmp_path}/scores"
    delta = "report_id string, report_ts timestamp, pos long, kind string, key string, label string, events_added long, events_seen long, duplicates long, zero_yield_runs long, metadata map<string,string>"
    when = dt.datetime(2026, 1, 10)
    one = lambda report, *keys: [(report, when, 0, "venue", k, k, 1, 2, 1, 0, None) for k in keys]
    for n, group in enumerate([one("r1", *"abcdefgh"), one("r2", "a"), one("r2", "a")]):
        spark.createDataFrame(group, delta).write.parquet(f"{tmp_path}/in{n}")
        src = spark.readStream.schema(delta).parquet(f"{tmp_path}/in{n}")
        jobs.score_stream(src, lambda b: b, store, f"{tmp_path}/marks{n}", buckets=8)
        state = versions.load(spark, store)
        mine = {str(r[0]) for r in spark.createDataFrame(one("x", "a"), delta).select(jobs.score_bucket(8)).collect()}
        rest = sorted(set(state.parts("scores")) - mine)
        now = sorted(versions.read(spark, state, "scores", rest).inputFiles())
        assert n == 0 or now == before
        before = now
    got = {r.key: (r.runs, r.events_added) for r in versions.read(spark, state, "scores").collect()}
    assert got == {**dict.fromkeys("bcdefgh", (1, 1)), "a": (2, 2)}
