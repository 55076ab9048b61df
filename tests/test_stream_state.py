"""The state of ordered streams: many small values, read slice by slice, gone at the end."""

import pickle
import random

import pandas as pd

from vetloom.streaming import jobs as Z


class FakeMap(dict):
    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class FakeValue:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class FakeHandle:
    def __init__(self):
        self.maps, self.values, self.timers = {}, {}, []

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, FakeMap())

    def getValueState(self, name, schema):
        return self.values.setdefault(name, FakeValue())

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_a_hot_key_waits_in_bounded_values_and_leaves_nothing_behind(monkeypatch):
    monkeypatch.setattr(Z, "VALUE_ROWS", 40)
    monkeypatch.setattr(Z, "SLICE_SECONDS", 60)
    rng = random.Random(1)
    rows = [(rng.randrange(0, 3_600) * Z.MICRO + i, i) for i in range(20_000)]

    def fold(key, now, us, row):
        return (now[0] + 1,), [(now[0], row[0])]

    for triggers in (1, 10):
        handle = FakeHandle()
        step = Z.InOrder("k", ["event_id"], ["place", "event_id"], lambda: (0,), fold, lambda now, last: last + 5 * Z.MICRO, None)
        step.init(handle)
        got, largest = [], 0
        for t in range(triggers):  # each trigger brings rows that no watermark has passed yet, in any order
            span = [r for r in rows if t * 3_600 <= triggers * (r[0] // Z.MICRO) < (t + 1) * 3_600]
            rng.shuffle(span)
            frame = pd.DataFrame(span, columns=["event_micros", "event_id"])
            mark = (t + 1) * 3_600_000 // triggers - 1_000
            for out in [*step.handleInputRows(("k",), iter([pd.DataFrame(), frame]), Clock(0 if t == 0 else t * 3_600_000 // triggers - 1_000))]:
                got += out.values.tolist()
            largest = max([largest, *(len(pickle.loads(v[0])) for v in handle.maps["rows"].values())])
            assert len(handle.timers) == 1
            for out in step.handleExpiredTimer(("k",), Clock(mark), None):
                got += out.values.tolist()
        for out in step.handleExpiredTimer(("k",), Clock(10**9), None):
            got += out.values.tolist()
        assert got == [[i, row[1]] for i, row in enumerate(sorted(rows))]
        assert 0 < largest <= 40
        assert not handle.maps["rows"] and not handle.maps["slices"] and not handle.values["folded"].exists() and not handle.timers
