"""Leased jobs, joins within time and ranges, rule tables, sessions, totals and snapshots against plain versions."""

import collections
import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from leadspark.operators import intervals, sessions, suffixes, totals
from leadspark.streaming import joins, leases

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
T0 = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- leased jobs -------------------------------------------------------------------------------------------------------


def simulated(commands, end, attempts=2, backoff=5_000, lease=120_000, forgiven=1):
    """One job at a time, with a clock that stops at each lease's end and each command; told as the queue itself would."""
    out = []
    for key in {c[:2] for c in commands}:
        state, tries, stalls, until = None, None, None, None
        todo = sorted((c[3], c[2], c[4]) for c in commands if c[:2] == key) + [(end, None, None)]
        for t, seq, kind in todo:
            if state == "active" and until <= t:
                stalls += 1
                state = "waiting" if stalls <= forgiven else "failed"
                out.append((*key, None, until, "lapse", True, state, tries, stalls, until))
            if seq is None:
                continue
            ok = {
                "enqueue": state is None, "claim": state == "waiting" or (state == "delayed" and until <= t), "beat": state == "active", "done": state == "active", "error": state == "active", "drain": state in ("waiting", "delayed"),
            }.get(kind, False)
            if ok:
                if kind == "enqueue":
                    state, tries, stalls, until = "waiting", 0, 0, t
                elif kind in ("claim", "beat"):
                    state, until = "active", t + lease
                elif kind == "done":
                    state, until = "completed", t
                elif kind == "drain":
                    state, until = "removed", t
                else:
                    tries += 1
                    state, until = ("failed", t) if tries == attempts else ("delayed", t + backoff * 2 ** (tries - 1))
            out.append((*key, seq, t, kind, ok, state, tries, stalls, until))
    return sorted(out, key=repr)


COMMANDS = "run_id string, domain string, seq long, t_ms long, kind string"
LOG = ["run_id", "domain", "seq", "t_ms", "kind", "taken", "status", "attempts", "stalls", "until_ms"]


def random_commands(n, seed, keys=6):
    rng, out, clock = random.Random(seed), [], collections.Counter()
    for seq in range(n):
        key = ("r", f"d{rng.randrange(keys)}")
        clock[key] += rng.choice([0, 1_000, 5_000, 60_000, 119_999, 120_000, 150_000])
        out.append((*key, seq, clock[key], rng.choice(["enqueue", "claim", "claim", "beat", "beat", "error", "error", "done", "drain", "nonsense", None])))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leases_are_as_simulated(spark, seed):
    commands = random_commands(60, seed)
    got = leases.replay(spark.createDataFrame(commands, COMMANDS), 10**9).select(LOG).collect()
    assert sorted(map(tuple, got), key=repr) == simulated(commands, 10**9)


def test_lease_rules():
    rules = leases.Rules()
    job, _ = leases.told(None, 1, 0, "enqueue", rules)
    job, _ = leases.told(job, 2, 0, "claim", rules)
    job, _ = leases.told(job, 3, 100_000, "beat", rules)
    assert job == leases.Job("active", 0, 0, 220_000)
    job, _ = leases.told(job, 4, 200_000, "error", rules)
    assert job == leases.Job("delayed", 1, 0, 205_000)
    assert not leases.told(job, 5, 204_999, "claim", rules)[1][0][3]
    job, _ = leases.told(job, 6, 205_000, "claim", rules)
    job, rows = leases.told(job, 7, 325_000, "done", rules)  # too late: the lease has lapsed, and a worker's word counts no more
    assert [r[2:4] for r in rows] == [("lapse", True), ("done", False)] and job.status == "waiting" and job.stalls == 1
    job, _ = leases.told(job, 8, 330_000, "claim", rules)
    job, _ = leases.told(job, 9, 331_000, "error", rules)
    assert job.status == "failed" and job.attempts == 2
    assert not leases.told(job, 10, 340_000, "enqueue", rules)[1][0][3]


def test_replay_of_odd_tables(spark):
    rows = [(None, None, 1, 5, "enqueue"), (None, "d", 2, 5, "enqueue"), (None, None, 3, 6, "claim"), ("r", "d", 4, 1, None)]
    got = leases.outcomes(leases.replay(spark.createDataFrame(rows * 2, COMMANDS))).collect()
    assert {(r.run_id, r.domain, r.status) for r in got} == {(None, None, "active"), (None, "d", "waiting")}
    assert leases.replay(spark.createDataFrame([], COMMANDS)).count() == 0


@pytest.fixture
def stream(spark, tmp_path):
    """Feeds rows of a schema into a stream, step by step, and gives the result's rows so far."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    made = []

    def of(schemas, transform, mode="append"):
        dirs = [tmp_path / f"in{len(made)}_{i}" for i in range(len(schemas))]
        for d in dirs:
            d.mkdir()
        sources = [spark.readStream.schema(s).json(str(d)) for s, d in zip(schemas, dirs, strict=True)]
        name = f"out_{tmp_path.name.replace('-', '_')}_{len(made)}"
        q = transform(*sources).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c{len(made)}")).start()
        made.append(q)
        count = [0]

        def step(*rows, until=None):
            for d, some in zip(dirs, rows, strict=True):
                if some:
                    count[0] += 1
                    (tmp_path / "part.json").write_text("\n".join(json.dumps(r, default=str) for r in some))
                    (tmp_path / "part.json").rename(d / f"{count[0]}.json")
            if until is None:
                q.processAllAvailable()
            deadline = time.time() + 60  # a query with timers is never idle, so its rows are waited for
            while until is not None and not until(spark.table(name).collect()) and time.time() < deadline and q.isActive:
                time.sleep(0.5)
            if q.exception():
                raise q.exception()
            return spark.table(name).collect()

        return step

    yield of
    for q in made:
        q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_leases_as_a_stream(stream):
    """The operator with state tells what the batch form tells; a timer ends the lease nobody renews; ends are forgotten in time."""
    rules = leases.Rules(lease_ms=20_000)
    step = stream([COMMANDS], lambda c: leases.leased(c, rules, keep_done_ms=25_000, keep_failed_ms=600_000))
    now = int(time.time() * 1000)

    def command(domain, seq, t, kind):
        return {"run_id": "r", "domain": domain, "seq": seq, "t_ms": t, "kind": kind}

    def has(*seqs):
        return lambda rows: {r.seq for r in rows} >= set(seqs)

    first = [command("a", 1, now, "enqueue"), command("a", 2, now + 1, "claim"), command("a", 3, now + 2, "error"), command("b", 4, now, "enqueue"), command("b", 5, now, "claim"), command("b", 6, now + 9, "done")]
    first += [command("c", 7, now - 19_500, "enqueue"), command("c", 9, now - 18_500, "claim")]
    rows = step(first, until=has(*(c["seq"] for c in first)))
    expected = simulated([("r", c["domain"], c["seq"], c["t_ms"], c["kind"]) for c in first], 0, lease=20_000)
    assert sorted((tuple(r) for r in rows if r.kind != "lapse"), key=repr) == expected
    written = int(time.time() * 1000)
    rows = step([command("a", 3, now + 2, "error"), command("b", 10, now + 20, "enqueue")], until=has(10))  # one told again; an end that is kept
    assert sum(r.seq == 3 for r in rows) == 1 and [r.taken for r in rows if r.seq == 10] == [False]
    rows = step([], until=lambda rows: any(r.kind == "lapse" for r in rows))
    (lapse,) = [r for r in rows if r.kind == "lapse"]
    assert (lapse.domain, lapse.status, lapse.stalls, lapse.t_ms) == ("c", "waiting", 1, now + 1_500)
    time.sleep(max(0, 27 - time.time() + written / 1000))
    later = int(time.time() * 1000)
    rows = step([command("b", 11, later, "enqueue"), command("a", 12, later, "claim"), command("a", 13, later + 1, "beat")], until=has(11, 12, 13))
    assert [r.taken for r in rows if r.seq == 11] == [True]  # b's end has gone with its time to live
    assert [(r.taken, r.attempts, r.status) for r in rows if r.seq == 12] == [(True, 1, "active")]


# --- joins -------------------------------------------------------------------------------------------------------------

SIDE = "user string, ts timestamp, id long"


def test_stream_join_with_timeouts_and_late_rows(stream, spark):
    step = stream([SIDE, SIDE], lambda a, b: joins.answered(a, b, ["user"], "1 hour", late="10 minutes"))

    def row(user, s, i):
        return {"user": user, "ts": at(s).isoformat(), "id": i}

    requests, responses = [row("a", 0, 1), row("a", 60, 2), row("b", 0, 3), row("c", 100, 4)], [row("a", 3600, 11), row("b", 3601, 12), row("c", 99, 13), row("d", 5, 14)]
    rows = step(requests, responses)
    assert {(r.request_id, r.response_id) for r in rows} == {(1, 11), (2, 11)}
    step([row("z", 90_000, 9)], [row("z", 90_001, 19)])
    rows = step([row("z", 90_002, 10)], [row("y", 90_003, 20)])
    found = {(r.request_id, r.response_id) for r in rows}
    assert {(3, None), (4, None), (9, 19)} <= found and (1, None) not in found
    rows = step([row("a", 10, 5)], [row("a", 20, 15)])  # far behind both watermarks
    assert not any(r.request_id == 5 or r.response_id == 15 for r in rows)
    batch = [spark.createDataFrame([(r["user"], dt.datetime.fromisoformat(r["ts"]), r["id"]) for r in x], SIDE) for x in (requests, responses)]
    assert {(r.request_id, r.response_id) for r in joins.answered(*batch, ["user"], "1 hour").collect()} == {(1, 11), (2, 11), (3, None), (4, None)}
    assert {(r.request_id, r.response_id) for r in joins.answered(*batch, ["user"], "1 hour", unanswered=False).collect()} == {(1, 11), (2, 11)}


@pytest.mark.parametrize("unit", [1, 0.01, 50])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_points_within_ranges(spark, how, unit):
    rng = random.Random(4)
    points = [(i, rng.choice(["hot", "hot", "b", None]), rng.choice([None, float("nan"), rng.uniform(-50, 400), float(rng.randrange(100))])) for i in range(300)]
    ranges = []
    for i in range(80):
        low = rng.choice([None, rng.uniform(-60, 300), float(rng.randrange(100))])
        ranges.append((i, rng.choice(["hot", "b", "c", None]), low, rng.choice([None, (low or 0) + rng.choice([0.0, 0.5, 30.0, 500.0, -1.0])])))
    p, r = spark.createDataFrame(points + points[:5], "pid long, k string, x double"), spark.createDataFrame(ranges + ranges[:3], "rid long, k string, low double, high double")
    got = intervals.within(p, r, ["k"], "x", "low", "high", unit=unit, how=how)
    want = []
    for i, k, x in points + points[:5]:
        met = [j for j, q, lo, hi in ranges + ranges[:3] if k is not None and k == q and x is not None and x == x and (lo is None or x >= lo) and (hi is None or x <= hi)]
        want += [(i, j) for j in met] or ([(i, None)] if how == "left" else [])
    assert sorted(((a.pid, a.rid) for a in got.collect()), key=repr) == sorted(want, key=repr)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_points_within_ranges_of_large_numbers_and_none(spark):
    big = 1 << 60
    p, r = spark.createDataFrame([(big + 1,), (big + 3,)], "x long"), spark.createDataFrame([(1, big + 2, big + 3), (2, 0, big)], "rid long, low long, high long")
    assert [tuple(a) for a in intervals.within(p, r, [], "x", "low", "high").collect()] == [(big + 3, 1, big + 2, big + 3)]
    assert intervals.within(p.limit(0), r, [], "x", "low", "high").count() == 0 and intervals.within(p, r.limit(0), [], "x", "low", "high", how="left").count() == 2
    few = spark.range(2000).select((F.col("id") % 1000).cast("double").alias("x"))
    wide = spark.range(500).select(F.col("id").alias("rid"), F.col("id").cast("double").alias("low"), (F.col("id") + 400).cast("double").alias("high"))
    assert intervals.within(few, wide, [], "x", "low", "high").count() == 2 * 401 * 500


@pytest.mark.parametrize("how", ["inner", "left"])
def test_cells_of_intervals_are_never_broadcast(spark, how):
    """Small as the table is, its intervals in their cells are many times its size, which Spark's estimate does not know."""
    p, r = spark.range(900).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 2).alias("x")), spark.range(300).select(F.col("id").alias("rid"), (F.col("id") % 3).alias("k"), F.col("id").alias("low"), (F.col("id") + 15).alias("high"))
    got = intervals.within(p, r, ["k"], "x", "low", "high", how=how)
    assert "BroadcastHashJoin" not in plan(got) and "BroadcastExchange" not in plan(got)
    want = [(i, j) for i in range(900) for j in range(300) if i % 3 == j % 3 and j <= 2 * i <= j + 15]
    want += [(i, None) for i in range(900) if how == "left" and i not in {a for a, _ in want}]
    assert sorted(((a.id, a.rid) for a in got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_cell_of_many_rows_is_dealt_to_several_tasks(spark, how):
    """All points and intervals are in one cell; rows that repeat count each, and rows without a partner are there once."""
    p = spark.range(60).select("id", (F.col("id") % 12).alias("x"))
    r = spark.range(200).select(F.col("id").alias("rid"), F.when(F.col("id") % 9 != 0, F.col("id") % 5).alias("low"), F.lit(10).alias("high"))
    got = intervals.within(p, r.unionByName(r.limit(5)), [], "x", "low", "high", unit=100, how=how, spread=8)
    dealt = got.filter("rid is not null").groupBy(F.spark_partition_id().alias("part")).count().collect()
    if how == "inner":  # the other form reads its rows from a table, in parts of that table
        assert len(dealt) > 3 and max(d["count"] for d in dealt) < sum(d["count"] for d in dealt) / 2
    ranges = [(j, None if j % 9 == 0 else j % 5) for j in [*range(200), *range(5)]]
    want = [(i, j) for i in range(60) for j, low in ranges if i % 12 <= 10 and (low is None or i % 12 >= low)]
    want += [(i, None) for i in range(60) if how == "left" and i % 12 == 11]
    assert sorted(((a.id, a.rid) for a in got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("keyed", [True, False])
def test_tiles_of_points_and_intervals(spark, monkeypatch, how, keyed):
    """Many strips, blocks, packs and deals: each pair is there once for each time its rows repeat, whatever is null, NaN, open or upside down."""
    for name, value in {"BLOCK": 4, "STRIP": 16, "PACK": 2, "DEAL": 8}.items():
        monkeypatch.setattr(intervals, name, value)
    rng = random.Random(7)
    points = [(i, rng.choice(["hot", "hot", "hot", "b", None]) if keyed else "a", rng.choice([None, float("nan"), 7.0, 7.0, rng.uniform(-50, 400), float(rng.randrange(100))])) for i in range(150)]
    ranges = []
    for i in range(60):
        low = rng.choice([None, rng.uniform(-60, 300), float(rng.randrange(100))])
        ranges.append((i, rng.choice(["hot", "b", "c", None]) if keyed else "a", low, rng.choice([None, (low or 0) + rng.choice([0.0, 0.5, 30.0, 500.0, -1.0])])))
    ranges += ranges[:1] * 20
    p, r = spark.createDataFrame(points + points[:5], "pid long, k string, x double"), spark.createDataFrame(ranges, "rid long, k string, low double, high double")
    got = intervals.within(p, r, ["k"], "x", "low", "high", how=how, spread=2) if keyed else intervals.within(p.drop("k"), r.drop("k"), [], "x", "low", "high", how=how, spread=2)
    want = []
    for i, k, x in points + points[:5]:
        met = [(j, lo, hi) for j, q, lo, hi in ranges if k is not None and k == q and x is not None and x == x and (lo is None or x >= lo) and (hi is None or x <= hi)]
        want += [(i, *m) for m in met] or ([(i, None, None, None)] if how == "left" else [])
    assert sorted(((a.pid, a.rid, a.low, a.high) for a in got.collect()), key=repr) == sorted(want, key=repr)
    assert got.columns == ["pid", *["k"] * keyed, "x", "rid", "low", "high"]


def test_pairs_take_little_disk(spark, tmp_path):
    """All pairs are written, in an order that a table holds in few bytes; an interval is copied for strips of points, not for cells."""
    p = spark.range(6000).select(F.concat(F.lit("l"), "id").alias("id"), (F.xxhash64("id") % 300 + 300).alias("x"))
    r = spark.range(6000).select(F.col("id").alias("rid"), F.when(F.col("id") % 50 != 0, F.col("id") * 7 % 50 * 10).alias("low"), F.when(F.col("id") % 30 != 0, F.col("id") * 7 % 50 * 10 + F.col("id") % 40).alias("high"))
    got = intervals.within(p, r, [], "x", "low", "high", unit=4, spread=4)
    got.write.parquet(f"{tmp_path}/pairs")
    rows = p.groupBy("x").count().join(F.broadcast(r), F.expr("(low is null or x >= low) and (high is null or x <= high)")).agg(F.sum("count")).first()[0]
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == rows > 1_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.8 * rows


@pytest.mark.parametrize("seed", [1, 2])
def test_last_before(spark, seed):
    rng = random.Random(seed)

    def side(n):
        return [(i, rng.choice(["hot"] * 6 + ["b", "c", None]), rng.choice([None] + [at(rng.randrange(300)) for _ in range(9)])) for i in range(n)]

    a, b = side(400), side(200)
    left, right = spark.createDataFrame(a, "lid long, k string, ts timestamp"), spark.createDataFrame([(*r, r[0] % 7) for r in b], "rid long, k string, ts timestamp, v long").withColumn("v", F.when(F.col("v") != 3, F.col("v")))
    got = {r.lid: (r.rid, r.v) for r in intervals.last_before(left, right, ["k"], "ts", ties=["rid"]).collect()}
    for i, k, t in a:
        before = [(u, j) for j, q, u in b if k is not None and t is not None and q == k and u is not None and u <= t]
        best = max(before)[1] if before else None
        assert got[i] == (best, None if best is None or best % 7 == 3 else best % 7)
    assert len(got) == 400
    assert intervals.last_before(left.limit(0), right, ["k"], "ts").count() == 0
    assert all(r.rid is None for r in intervals.last_before(left, right.limit(0), ["k"], "ts").collect())


def test_rules_by_longest_suffix(spark):
    rng = random.Random(6)
    names = ["a", "b", "www", "shop"]
    hosts = [".".join(rng.choice(names) for _ in range(rng.randint(0, 3))) + rng.choice([".com", ".co.uk", "com", ".Example.ORG.", ""]) for _ in range(400)] + [None, "", ".", "xa.com"]
    listed = ["com", "a.com", "b.a.com", "co.uk", "shop.co.uk", "EXAMPLE.org", "example.org.", None, "", "a.b.www.shop.com"]
    rows, rules = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "id long, host string"), spark.createDataFrame([(s, f"r{i}") for i, s in enumerate(listed)], "suffix string, rule string")
    got = {r.id: r.rule for r in suffixes.longest_suffix(rows, rules, "host").collect()}

    def plain(x):
        return (x or "").lower().removesuffix(".")

    table = {}
    for i, s in enumerate(listed):
        if plain(s):
            table.setdefault(plain(s), []).append((s, f"r{i}"))
    for i, h in enumerate(hosts):
        labels = plain(h).split(".")
        fit = next((min(table[s])[1] for k in range(len(labels)) if (s := ".".join(labels[k:])) in table), None) if h else None
        assert got[i] == fit, h
    assert len(got) == len(hosts)
    open_ = {r.id for r in suffixes.unlisted(rows, rules, "host").collect()}
    assert open_ == {i for i, v in got.items() if v is None}


def test_a_hundred_thousand_rules(spark, tmp_path):
    """The plan has no branch for a rule, and its size is that for one rule."""
    many = spark.range(100_000).select(F.concat(F.lit("h"), "id", F.when(F.col("id") % 3 == 0, ".com").otherwise(".co.uk")).alias("suffix"), F.col("id").alias("rule"))
    many.write.parquet(str(tmp_path / "rules"))
    rules = spark.read.parquet(str(tmp_path / "rules"))
    rows = spark.range(3000).select(F.concat(F.lit("www.h"), F.col("id") * 40, F.when(F.col("id") * 40 % 3 == 0, ".com").otherwise(".co.uk")).alias("host"), F.col("id"))
    out = suffixes.longest_suffix(rows, rules, "host")
    assert out.filter((F.col("rule") == F.col("id") * 40) | (F.col("rule").isNull() & (F.col("id") >= 2500))).count() == 3000
    one = suffixes.longest_suffix(rows, rules.limit(1), "host")
    assert len(plan(out)) < len(plan(one)) + 500 and "NestedLoop" not in plan(out)


# --- sessions and days -------------------------------------------------------------------------------------------------


def test_session_forms_agree(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 9 + ["b", None]), rng.choice([None] + [at(rng.randrange(40_000)) for _ in range(30)]), i) for i in range(600)] + [("gap", at(0), 1000), ("gap", at(1800), 1001), ("gap", at(3600), 1002), ("gap", at(5401), 1003)]
    e = spark.createDataFrame(rows, SIDE)
    measures = [F.count("*").alias("n"), F.max("id").alias("last")]

    def told(df):
        return sorted(map(tuple, df.collect()), key=repr)

    a, b = told(sessions.sessions(e, ["user"], "30 minutes", *measures)), told(sessions.session_islands(e, ["user"], "30 minutes", *measures))
    assert a == b and [r[3] for r in a if r[0] == "gap"] == [3, 1]
    assert sessions.session_islands(e.limit(0), ["user"], "30 minutes", *measures).count() == 0


def test_sessions_of_a_stream(stream):
    step = stream([SIDE], lambda e: sessions.sessions(e, ["user"], "5 minutes", F.count("*").alias("n")))

    def row(s, i=0):
        return {"user": "a", "ts": at(s).isoformat(), "id": i}

    step([row(0), row(100), row(1000)])
    rows = step([row(5000)])
    rows = step([row(5001)])
    assert sorted((r.start.timestamp() - T0.timestamp(), r.n) for r in rows) == [(0, 2), (1000, 1)]
    rows = step([row(150)])  # its session has been closed
    rows = step([row(20_000)])
    rows = step([row(20_001)])
    assert sorted((r.start.timestamp() - T0.timestamp(), r.n) for r in rows) == [(0, 2), (1000, 1), (5000, 2)]


def test_calendar(spark):
    d = [dt.date(2024, 2, k) for k in range(1, 30)]
    c = spark.createDataFrame([("a", d[0], 3, 7), ("a", d[3], 1, None), ("a", d[4], 2, 9), (None, d[8], 4, 1), ("a", None, 5, 5)], "k string, day date, n long, v long")
    got = sorted(map(tuple, sessions.calendar(c, ["k"], "day", ["n"], ["v"]).collect()), key=repr)
    assert got == sorted([("a", d[0], 3, 7), ("a", d[1], 0, 7), ("a", d[2], 0, 7), ("a", d[3], 1, 7), ("a", d[4], 2, 9), (None, d[8], 4, 1)], key=repr)


# --- totals, sketches, snapshots ---------------------------------------------------------------------------------------


def test_totals(spark):
    rows = [("a", "x", 1), ("a", None, 2), (None, "x", 4)]
    d = spark.createDataFrame(rows, "s string, t string, n long")
    got = {(r.s, r.t, r.level): r.n for r in totals.totals(d, ["s", "t"], "cube", F.sum("n").alias("n")).collect()}
    assert got[None, None, 3] == 7 and got["a", None, 1] == 3 and got["a", None, 0] == 2 and got[None, None, 1] == 4 and got[None, "x", 2] == 5 and len(got) == 8
    assert {r.level for r in totals.totals(d, ["s", "t"], "rollup", F.count("*").alias("n")).collect()} == {0, 1, 3}
    sets = totals.totals(d, ["s", "t"], [["t"], []], F.count("*").alias("n"))
    assert plan(sets).count("Expand") == 1 and {(r.t, r.level, r.n) for r in sets.collect()} == {("x", 2, 2), (None, 2, 1), (None, 3, 3)}
    assert totals.totals(d.limit(0), ["s", "t"], [["t"], []], F.count("*").alias("n")).count() == 0


def test_sketches_merge_without_loss(spark):
    d = spark.range(20_000).select((F.col("id") % 4).alias("day"), (F.col("id") % 5000).alias("m"), F.col("id").alias("x"))
    days = totals.sketches(d, ["day"], "m", "x")
    whole = totals.estimates(totals.merged(days.withColumn("all", F.lit(1)), ["all"]), ["all"], [0.5]).first()
    assert whole.rows == 20_000 and abs(whole.members - 5000) < 150 and abs(whole.members_theta - 5000) < 150 and abs(whole.quantiles[0] - 10_000) < 400
    once = totals.estimates(totals.sketches(d.withColumn("all", F.lit(1)), ["all"], "m", "x"), ["all"], [0.5]).first()
    assert once.members_theta == whole.members_theta
    runs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "d"), (3, None)], "run long, m string").withColumn("x", F.lit(1.0))
    got = {r.run: (r.gone, r.fresh) for r in totals.gone(totals.sketches(runs, ["run"], "m", "x"), "run").collect()}
    assert got == {1: (None, 2), 2: (1, 2), 3: (3, 0)}


def test_snapshot_changes(spark):
    schema = "k long, v string"
    old = [(1, "a"), (1, "a"), (1, "a"), (2, "b"), (3, None), (None, "n"), (5, "same")]
    new = [(1, "a"), (2, "c"), (4, "d"), (4, "d"), (None, "m"), (5, "same")]
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema).select("v", "k")
    patch = totals.changes(a, b, ["k"])
    assert {(r.op, r.k, r.row.v, r.copies) for r in patch.collect()} == {("delete", 1, "a", 2), ("update_before", 2, "b", 1), ("update_after", 2, "c", 1), ("delete", 3, None, 1), ("insert", 4, "d", 2), ("update_before", None, "n", 1), ("update_after", None, "m", 1)}
    assert collections.Counter(map(tuple, totals.patched(a, patch).collect())) == collections.Counter(new)
    assert totals.changes(a, a, ["k"]).count() == 0 and collections.Counter(map(tuple, totals.patched(a.limit(0), totals.changes(a.limit(0), b, ["k"])).collect())) == collections.Counter(new)
