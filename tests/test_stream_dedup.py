"""Streaming dedup: the earliest event of a run, whatever the arrival."""
import datetime as dt
import random

import pytest

from ranklab.streaming import stream as STR

SCHEMA = "event_id long, ts timestamp, user_id long, note string"
START = dt.datetime(2024, 1, 1)


def _runs(events):
    out, by = [], {}
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        by.setdefault(e[2], []).append(e)
    end = max(e[1] for e in events) - dt.timedelta(hours=3)
    for es in by.values():
        run = [es[0]]
        for e in es[1:] + [None]:
            if e is not None and e[1] <= run[-1][1] + dt.timedelta(minutes=30):
                run.append(e)
                continue
            if run[-1][1] + dt.timedelta(minutes=30) <= end:
                out.append(run[0][0])
            run = [e]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_earliest_of_each_run(spark, tmp_path, seed):
    rng = random.Random(7)
    events = [(i, START + dt.timedelta(minutes=rng.randint(0, 900)), rng.randint(0, 4), f"n{i}") for i in range(150)]
    events += [(900, START + dt.timedelta(hours=30), 99, "last")]
    hours = {}
    for e in events:       # files in order of time, each shuffled; neighbours swapped
        hours.setdefault(int((e[1] - START).total_seconds()) // 3600, []).append(e)
    order = sorted(hours)
    for a in range(0, len(order) - 2, 2):
        if seed == 2:
            order[a], order[a + 1] = order[a + 1], order[a]
    for n, h in enumerate(order):
        rows = hours[h][:]
        random.Random(seed + n).shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n:03d}")
    ev = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*"))
    out = STR.run_append(STR.dedup_earliest(ev, ["user_id"], "30 minutes", "3 hours"), "t", f"{tmp_path}/run").collect()
    assert sorted(r.event_id for r in out) == _runs(events)
    assert all(r.note == f"n{r.event_id}" for r in out)
