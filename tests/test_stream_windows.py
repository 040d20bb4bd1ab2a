"""Stateful windows and cuts of streams, handler by handler, on states that count their calls."""

from collections import Counter

from pyspark.sql import Row

from auditlake.streaming.windows import ChannelWindows, FirstBlock


class State:
    """A value and a map state of one key; ``calls`` counts what a worker would ask the JVM for."""

    def __init__(self):
        self.value, self.entries, self.calls = None, {}, Counter()

    def __getattribute__(self, name):
        if name not in ("value", "entries", "calls"):
            self.calls[name] += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in self.entries

    def getValue(self, key):
        return self.entries[key]

    def updateValue(self, key, value):
        self.entries[key] = value

    def registerTimer(self, at):
        self.entries["timer", at] = True

    def deleteTimer(self, at):
        del self.entries["timer", at]


def fragments(*rows):
    return iter([Row("s", "r", "t", "/p", seq, 0, channel, text, ms and ms * 1000, None) for seq, channel, text, ms in rows])


def test_windows_of_rows_and_few_calls():
    windows = ChannelWindows(window=4, idle_ms=100)
    windows.handle, windows.tails, windows.deadline = State(), State(), State()
    got = list(windows.handleInputRows(("s",), fragments((1, "a", b"def", 2), (0, "a", b"abc", 1), (2, "b", b"x", 3)), None))
    assert [(r.seq, r.channel, r.window, r.us) for r in got] == [(0, "a", b"abc", 1000), (1, "a", b"abcdef", 2000), (2, "b", b"x", 3000)]
    # Of a new stream nothing is looked up: a call is a round trip to the JVM.
    assert windows.tails.calls == {"updateValue": 2} and windows.deadline.calls == {"exists": 1, "update": 1}
    got = list(windows.handleInputRows(("s",), fragments((3, "a", b"g", 9), (4, "c", b"y", None)), None))
    assert [(r.channel, r.window) for r in got] == [("a", b"cdefg"), ("c", b"y")]
    assert windows.deadline.value == (109,) and windows.handle.entries == {("timer", 109): True}


def test_rows_pass_until_the_first_block():
    cut = FirstBlock()
    cut.ended = State()

    def passed(*rows):
        return [r.seq for r in cut.handleInputRows(("s",), iter([Row("s", "r", n, 0, "a", 0, d, None) for n, d in rows]), None)]

    assert passed((1, "allow"), (0, "allow")) == [0, 1]
    assert passed((4, "allow"), (3, "block"), (2, "allow")) == [2, 3]
    assert passed((5, "allow")) == []
