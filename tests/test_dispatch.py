"""Jobs that come due, against a plain walk over ticks."""

import random

from stationlake.operators import fleet


def plain(episodes, jobs, handled):
    out = []
    for eid, station, kind, start, length in episodes:
        if kind != "empty" or eid in handled:
            continue
        for tick in range(-(-(start + 1200) // 60) * 60, start + length, 60):
            if not any(s == station and a <= tick and (b is None or tick < b) for s, a, b in jobs):
                out.append((eid, tick))
                break
    return sorted(out)


def test_due_is_the_first_free_tick(spark):
    rnd = random.Random(3)
    episodes = [(f"e{i}", f"s{rnd.randrange(3)}", rnd.choice(["empty", "empty", "full"]), rnd.randrange(100_000), rnd.choice([600, 1200, 1201, 1500, 4000, 20_000])) for i in range(150)]
    jobs = []
    for _ in range(160):
        a = rnd.randrange(-5000, 110_000)
        jobs.append((f"s{rnd.randrange(3)}", a, rnd.choice([a, a + 60, a + 599, a + 3600, a + 9000])))
    jobs += [("s0", 90_000, None), ("s1", 50_000, 50_000), ("s9", 0, None)]
    handled = {"e3", "e10", "e77"}
    got = fleet.due(
        spark.createDataFrame(episodes, "episode_id string, station_id string, kind string, start_ts long, duration_s long"), spark.createDataFrame(jobs, "station_id string, opened_at long, closed_at long"),
        spark.createDataFrame([(h,) for h in handled], "episode_id string"),
    )
    want = plain(episodes, jobs, handled)
    assert len(want) > 30 and sorted((r.episode_id, r.due_at) for r in got.collect()) == want


def test_without_jobs_and_without_episodes(spark):
    e = spark.createDataFrame([("a", "s", "empty", 30, 5000)], "episode_id string, station_id string, kind string, start_ts long, duration_s long")
    j = spark.createDataFrame([("s", 0, 10_000)], "station_id string, opened_at long, closed_at long")
    assert [r.due_at for r in fleet.due(e, j.limit(0)).collect()] == [1260]
    assert fleet.due(e, j).count() == 0 and fleet.due(e.limit(0), j).count() == 0


def test_vans_are_given_in_order_over_days(spark):
    jobs = spark.createDataFrame([(i, "s", "open" if i % 3 else "done", 86400 * (i % 4) + i) for i in range(30)], "job_id long, station_id string, status string, opened_at long")
    vans = spark.createDataFrame([(i, f"P{i:02d}", "idle" if i != 4 else "busy") for i in range(9)], "van_id long, plate string, status string")
    got = sorted((r.opened_at, r.plate) for r in fleet.assign(jobs, vans).collect())
    waiting = sorted(86400 * (i % 4) + i for i in range(30) if i % 3)
    assert got == list(zip(waiting, [f"P{i:02d}" for i in range(9) if i != 4], strict=False))
