import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltstone.plans.incremental import replay_sync_runs
from siltstone.runtime import scratch
from siltstone.streaming.ledger import COMPACT_EVERY, WatermarkLedger
from tests.conftest import rows

RUN = "run_id int, started_at timestamp, ended_at timestamp, state string"
SEEN = "obs_id bigint, collection string, relative_path string, mtime bigint, found_at timestamp, delivered_at timestamp, newest string, side int"
META = "collection string, relative_path string, mtime bigint, changed boolean"
T0 = dt.datetime(2026, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def brute(runs, seen, meta):
    done = {(c, p): m for c, p, m, _ in meta if m is not None and c and p}
    out = set()
    for run_id, start, _, state in sorted({r for r in runs if r[1] is not None}, key=lambda r: (r[1], r[0])):
        if state != "ok":
            continue
        best = {}
        for o, c, p, m, f, d, *_ in seen:
            if m is not None and c and p and d is not None and d <= start:
                k = (f is not None, f or T0, o)
                if (c, p) not in best or k > best[c, p][0]:
                    best[c, p] = (k, m)
        for key, (_, m) in best.items():
            if done.get(key) != m:
                out.add((run_id, *key, m))
                done[key] = m
    return sorted(out, key=repr)


def test_random_schedules(spark):
    rng = random.Random(5)
    runs = [(i, at(i * 3), None, rng.choice(["ok", "ok", "ok", "failed", "aborted", None])) for i in range(1, 22)]
    assert sum(r[3] == "ok" for r in runs) > COMPACT_EVERY
    seen = []
    for o in range(700):
        f = rng.uniform(0, 60)
        m = None if rng.random() < 0.05 else rng.randrange(6)
        seen.append((o, rng.choice("ab"), f"f{rng.randrange(40)}", m, at(f), at(f + rng.expovariate(0.2)), "n", 1))
    seen += rng.sample(seen, 50) + [(900, None, "f", 1, at(1), at(1), "", 0), (901, "a", None, 1, at(1), at(1), "", 0), (902, "a", "f1", 1, None, at(1), "", 0), (903, "a", "f1", 1, at(1), None, "", 0)]
    meta = [("a", f"f{i}", rng.choice([None, 1, 2]), True) for i in range(25)]
    meta += meta[:5]
    got = replay_sync_runs(spark.createDataFrame(runs, RUN), spark.createDataFrame(seen, SEEN), spark.createDataFrame(meta, META))
    assert rows(got, "run_id", "collection", "relative_path", "mtime") == brute(runs, seen, meta)


def test_empty(spark):
    got = replay_sync_runs(spark.createDataFrame([], RUN), spark.createDataFrame([], SEEN), spark.createDataFrame([], META))
    assert got.count() == 0
    got = replay_sync_runs(spark.createDataFrame([(1, at(1), None, "ok")], RUN), spark.createDataFrame([], SEEN), spark.createDataFrame([], META))
    assert got.count() == 0


def micros(h):
    return int(at(h).replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)


def test_failed_run_leaves_nothing_and_repeats_nothing(spark):
    seen = spark.createDataFrame([(1, "a", "x", 5, at(1), at(1), "", 0), (2, "a", "y", 6, at(4), at(4), "", 0)], SEEN)
    base = spark.createDataFrame([], META).drop("changed")
    ledger = WatermarkLedger(spark, scratch(spark, "ledger"), ["collection", "relative_path"])
    args = (seen.drop("newest", "side"), "delivered_at")
    with pytest.raises(RuntimeError):
        ledger.run(1, *args, micros(2), ["found_at", "obs_id"], "mtime", base, fail_before_commit=True)
    assert ledger.commits() == [] and ledger.changes() is None
    ledger.run(2, *args, micros(3), ["found_at", "obs_id"], "mtime", base)
    ledger.run(3, *args, micros(9), ["found_at", "obs_id"], "mtime", base)
    assert rows(ledger.changes(), "run_id", "relative_path") == [(2, "x"), (3, "y")]
    assert [c["watermark"] for c in ledger.commits()] == [micros(3), micros(9)]
    with pytest.raises(RuntimeError):
        ledger.log.publish(1, {})
    assert len(ledger.commits()) == 2 and ledger.vacuum() == 1 and ledger.vacuum() == 0
    assert rows(ledger.changes(), "run_id", "relative_path") == [(2, "x"), (3, "y")]


def test_two_runs_from_one_watermark(spark, monkeypatch):
    seen = spark.createDataFrame([(1, "a", "x", 5, at(1), at(1), "", 0)], SEEN).drop("newest", "side")
    base = spark.createDataFrame([], META).drop("changed")
    root = scratch(spark, "ledger")
    one, two = (WatermarkLedger(spark, root, ["collection", "relative_path"]) for _ in range(2))
    real, args = two.log.publish, (seen, "delivered_at", micros(2), ["found_at", "obs_id"], "mtime", base)
    monkeypatch.setattr(two.log, "publish", lambda n, m: (one.run(1, *args), real(n, m)))
    with pytest.raises(RuntimeError):
        two.run(2, *args)
    assert rows(one.changes(), "run_id", "relative_path") == [(1, "x")] and one.vacuum() == 1


def test_manifests_are_given_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    from siltstone.runtime import ManifestLog

    log = ManifestLog(spark, scratch(spark, "log"))

    def attempt(k):
        try:
            log.publish(0, {"writer": k})
            return k
        except RuntimeError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [k for k in pool.map(attempt, range(24)) if k is not None]
    assert len(won) == 1 and log.last() == (0, {"writer": won[0]}) and log.numbers() == [0]


def test_count_below(spark):
    from siltstone.operators.ranking import count_below

    data = [("g", float(i % 50), 1 + i % 3) for i in range(50)] + [("h", 1.0, 4)]
    got = count_below(spark.createDataFrame(data, "g string, v double, n int"), ["g"], "v", "n", parts=5)
    want = {(g, v): sum(n for g2, v2, n in data if g2 == g and v2 < v) for g, v, _ in data}
    assert {(r.g, r.v): r.below for r in got.collect()} == want
    assert got.where(F.col("below").isNull()).count() == 0


def test_stream_of_sightings(spark, tmp_path):
    from siltstone.streaming.watch import follow

    kind = "obs_id bigint, collection string, relative_path string, mtime bigint, found_at timestamp, delivered_at timestamp"
    base = spark.createDataFrame([("a", "x", 1)], "collection string, relative_path string, mtime bigint")
    ledger = WatermarkLedger(spark, scratch(spark, "ledger"), ["collection", "relative_path"])
    for n, data in enumerate([[(1, "a", "x", 1, at(1), at(1)), (2, "a", "y", 2, at(1), at(2))], [(3, "a", "x", 5, at(3), at(3)), (4, "a", "z", 7, at(0), at(0))], []]):
        spark.createDataFrame(data, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        follow(spark, str(tmp_path / "in"), kind, ledger, base, str(tmp_path / "cp")).awaitTermination(120)
    assert rows(ledger.changes(), "run_id", "relative_path", "mtime") == [(0, "y", 2), (1, "x", 5), (1, "z", 7)]
    assert [c["watermark"] for c in ledger.commits()] == [1, 2]
