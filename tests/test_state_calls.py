"""The state is asked a few times for each device, however many rows it has; a log record is parsed once."""

from __future__ import annotations

from types import SimpleNamespace

import pandas as pd

from brookmart.operators import logs
from brookmart.streaming import state


class Kept:
    """Value, list and map state in memory that counts its calls."""

    def __init__(self, handle):
        self.handle, self.held = handle, {}

    def __getattribute__(self, name):
        if name not in ("handle", "held", "__class__", "__dict__"):
            object.__getattribute__(self, "handle").calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return bool(self.held)

    def get(self):
        return iter(self.held.get("list", [])) if "list" in self.held else self.held.get("value")

    def update(self, value):
        self.held = {"value": value}

    def appendList(self, rows):  # noqa: N802
        self.held = {"list": [*self.held.get("list", []), *rows]}

    def put(self, rows):
        self.held = {"list": list(rows)}

    def clear(self):
        self.held = {}

    def updateValue(self, key, value):  # noqa: N802
        self.held[key] = value

    def getValue(self, key):  # noqa: N802
        return self.held[key]

    def keys(self):
        return iter(list(self.held))

    def removeKey(self, key):  # noqa: N802
        del self.held[key]


class Handle:
    def __init__(self):
        self.calls, self.timers = 0, set()

    def getValueState(self, *_):  # noqa: N802
        return Kept(self)

    getListState = getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def run(processor, n, hour=3_600_000):
    handle = Handle()
    processor.init(handle)
    rows = pd.DataFrame({"ts": [k * hour for k in range(n)], "seq": range(n), "entry": [k % 3 != 2 for k in range(n)], "payload": [str(k) for k in range(n)]})
    time = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    out = [f for f in processor.handleInputRows(("m",), iter([rows[n // 2 :], rows[: n // 2]]), time(0)) if len(f)]
    at = n * hour - 10 * hour  # some rows wait on
    for now in (at, 2 * n * hour):
        due = sorted(t for t in handle.timers if t <= now)
        while due:
            handle.timers.discard(due[0])
            out += [f for f in processor.handleExpiredTimer(("m",), time(now), SimpleNamespace(getExpiryTimeInMs=lambda t=due[0]: t)) if len(f)]
            due = sorted(t for t in handle.timers if t <= now)
    return handle.calls, pd.concat(out)["seq"].tolist()


def test_state_calls_do_not_grow_with_rows():
    few, many = run(state.Visits(), 48), run(state.Visits(), 480)
    assert many[0] == few[0] < 60 and many[1] == [24 * d for d in range(20)]
    few, many = run(state.Jumps(2 * 3_600_000), 48), run(state.Jumps(2 * 3_600_000), 480)
    assert many[0] == few[0] < 60 and many[1] == [k for k in range(480) if k % 3 == 0]


def test_a_log_record_is_parsed_once(spark):
    lines = spark.createDataFrame([(1, '{"common":{"mid":"m"},"page":{"page_id":"p"},"ts":5}'), (2, "{"), (3, None), (4, '{"ts":1}')], "seq long, value string")
    good, dirty = logs.parse_log(lines)
    assert [r.seq for r in good.collect()] == [1] and sorted(r.seq for r in dirty.collect()) == [2, 3, 4]
    plan = logs.split_page(good)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
