"""A key's stream sets a timer for a batch, not for each of its events, and every event still comes into the state."""

from types import SimpleNamespace

from gridloom.streaming import folds, streams


class Kept:
    """A state variable of a key."""

    def __init__(self):
        self.held = None

    exists = lambda self: self.held is not None
    get = lambda self: self.held

    def update(self, value):
        self.held = value

    put = update

    def appendList(self, more):  # noqa: N802
        self.held = (self.held or []) + list(more)

    def clear(self):
        self.held = None


def test_timers():
    p, timers = streams.Folded(folds.Pending(), "frames double"), []
    p.told_names = ["pending"]
    p.handle, p.value, p.waiting, p.seen = SimpleNamespace(registerTimer=timers.append), Kept(), Kept(), Kept()
    rows = [SimpleNamespace(**{"at": at, "n": at, "frames": f, "__getitem__": None}) for at, f in ((30, None), (10, 4.0), (20, None))]
    rows = [type("R", (), {"at": r.at, "n": r.n, "__getitem__": lambda self, c, r=r: getattr(r, c)})() for r in rows]
    assert next(p.handleInputRows((1,), rows, None)).pending == 2
    assert timers == [11]
    for mark, waits in ((11, [20, 30]), (25, [30]), (31, [])):
        list(p.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), None))  # noqa: B023
        assert [e[0] for e in p.waiting.held or []] == waits
    assert timers == [11, 21, 31] and p.value.held is not None
