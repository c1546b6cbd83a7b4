"""Streams run to their end over files and are held against the batch rule."""

import datetime as dt

import pytest

from tessera.streaming import stateful as S

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def run(spark, tmp_path):
    def go(rows, schema, operator, mode="append"):
        for k, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        name = f"out_{abs(hash(str(tmp_path)))}"
        q = operator(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    return go


SAID = "session_id string, content string, ts timestamp"
END = [("end", "end", at(10**6))], [("end", "end", at(10**6 + 1))]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, S.ROCKSDB)
    yield
    spark.conf.set(name, before)


def replayed(rows, seconds=300, capacity=4096):
    """The rule over all rows in the order of time."""
    import hashlib

    digest = lambda x: hashlib.sha256(x.strip().encode()).hexdigest()
    held, out = {}, []
    for key, h, t in sorted(((k, digest(c), t) for k, c, t in rows), key=lambda x: (x[2], x[1])):
        own = held.setdefault(key, {})
        for old in [o for o, since in own.items() if (t - since).total_seconds() > seconds]:
            del own[old]
        fresh = h not in own
        if fresh:
            own[h] = t
            if len(own) > capacity:
                del own[next(iter(own))]
        out.append((key, h, t, fresh))
    return sorted(out)


def test_rolling_dedup_by_time_whatever_the_batches(run, rocks):
    """B at 800 s comes after A at 1000 s; at 1150 s it is 350 s old, and so fresh."""
    rows = [[("s", " a ", at(0)), ("s", "a", at(300)), ("s", "A", at(1000))], [("s", "b", at(800)), ("t", "a", at(302))], [("s", "b", at(1150)), ("s", "a", at(301))], *END]
    got = sorted((r.session_id, r.content_hash, r.ts, r.fresh) for r in run(rows, SAID, lambda d: S.dedup_rolling(d, late="2000 seconds")) if r.session_id != "end")
    assert got == [x for x in replayed([r for part in rows for r in part]) if x[0] != "end"]
    assert (at(1150), True) in {(t, f) for _, _, t, f in got} and (at(301), True) in {(t, f) for k, _, t, f in got if k == "s"}


def test_rolling_dedup_many_batches(run, rocks):
    import random

    r = random.Random(5)
    rows = [("st"[r.randrange(2)], r.choice("abcdefgh"), at(10 * k + r.randrange(10))) for k in range(300)]
    parts, rest = [], list(rows)
    while rest:
        parts.append(sorted(rest[:60], key=lambda _: r.random()))
        rest = rest[60:]
    parts[1][0], parts[2][0] = parts[2][0], parts[1][0]  # a row that comes a batch late
    got = sorted((x.session_id, x.content_hash, x.ts, x.fresh) for x in run([*parts, *END], SAID, lambda d: S.dedup_rolling(d, seconds=120, capacity=4, late="2000 seconds")) if x.session_id != "end")
    assert got == replayed(rows, 120, 4)


def test_rolling_dedup_drops_what_is_too_late(run, rocks):
    rows = [[("s", "a", at(0))], [("s", "b", at(5000))], [("t", "c", at(5001))], [("s", "a", at(10)), ("s", "b", at(5010))], *END]
    got = sorted((x.ts, x.fresh) for x in run(rows, SAID, lambda d: S.dedup_rolling(d, late="60 seconds")) if x.session_id == "s")
    assert got == [(at(0), True), (at(5000), True), (at(5010), False)]


def test_idle_memories_begin_anew(run):
    rows = [[(1, at(0)), (1, at(1))], [(2, at(5000))], [(2, at(9000))], [(1, at(9001))]]
    got = run(rows, "memory_id long, ts timestamp", lambda s: S.access_log(s, idle_seconds=60), "update")
    assert [r.n for r in sorted(got, key=lambda r: (r.memory_id, r.last_at)) if r.memory_id == 1] == [2, 1]


def test_watermark_dedup(run):
    got = run([[("x", at(0)), ("x ", at(10)), ("y", at(20))]], "content string, ts timestamp", S.dedup_within)
    assert len(got) == 2


def test_access_log(run):
    got = run([[(1, at(0)), (1, at(5))], [(1, at(9)), (2, at(1))]], "memory_id long, ts timestamp", S.access_log, "update")
    last = {(r.memory_id, r.n) for r in got}
    assert (1, 3) in last and (2, 1) in last


def test_leases(run):
    rows = [[(1, "a", at(0), 0), (1, "b", at(10), 0), (1, "a", at(20), 60)], [(1, "b", at(79), 0), (1, "b", at(81), 0)]]
    got = run(rows, "action_id long, agent_id string, ts timestamp, ttl long", S.leases)
    assert [(r.agent_id, r.granted) for r in sorted(got, key=lambda r: r.ts)] == [("a", True), ("b", False), ("a", True), ("b", False), ("b", True)]


def test_follow_ups(run):
    rows = [[("a", at(0), [1, 2])], [("a", at(60), [3]), ("a", at(70), [3, 4]), ("b", at(60), [9])]]
    got = run(rows, "agent_id string, ts timestamp, result_ids array<long>", S.follow_ups)
    assert sorted((r.agent_id, r.ts, r.is_follow_up) for r in got) == [("a", at(0), False), ("a", at(60), True), ("a", at(70), False), ("b", at(60), False)]


def test_windows_and_sessions(run, spark, tmp_path):
    rows = [[("message", "a", at(0)), ("action", "a", at(60)), ("blocker", "a", at(3700))], [("message", "a", at(20000))], [("message", "a", at(40000))]]
    got = run(rows, "event_type string, agent_id string, ts timestamp", S.saturation_windows)
    assert [(r.start, r.messages, r.actions, r.blockers) for r in sorted(got, key=lambda r: r.start)][:2] == [(at(0), 1, 1, 0), (at(3600), 0, 0, 1)]


def test_upsert_sink(spark, tmp_path):
    for k, rows in enumerate(([(1, 1), (1, 2), (2, 1)], [(1, 3)])):
        spark.createDataFrame(rows, "id long, version long").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("id long, version long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = S.upsert_sink(stream, str(tmp_path / "out"), "id", "version", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("id").max("version").collect()
    assert sorted(map(tuple, got)) == [(1, 3), (2, 1)]


def test_introductions_wait_for_late_claims(run, rocks):
    """A claim that comes two batches late counts; one behind the watermark does not."""
    from tessera.operators import coordination as C

    rows = [[("a", "hello", at(0)), ("b", "hello", at(10))], [("c", "hello", at(4000))], [("a", "working on it", at(600))], [("z", "done", at(20_000))], [("z", "done", at(20_001))], [("b", "claimed", at(20))], *[[("z", "done", at(10**6 + k))] for k in range(3)]]
    got = run(rows, "agent_id string, content string, ts timestamp", lambda s: C.unclaimed_introductions(s, "1 hour", "2 hours"))
    assert sorted((r.agent_id, r.ts) for r in got) == [("b", at(10)), ("c", at(4000))]
