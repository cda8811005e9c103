"""How often the state of a live page is asked."""

import pandas as pd

from agora.streaming import trees


class Map(dict):
    """A map state that counts how often it is asked."""

    calls = 0

    def _one(self):
        self.calls += 1

    def exists(self):
        self._one()
        return bool(self)

    def containsKey(self, key):
        self._one()
        return key in self

    def getValue(self, key):
        self._one()
        return self[key]

    def updateValue(self, key, value):
        self._one()
        self[key] = value

    def removeKey(self, key):
        self._one()
        del self[key]

    def iterator(self):
        return iter([*self.items()])


def test_state_is_asked_by_blocks():
    states = {}

    class Handle:
        def getMapState(self, name, *_):
            return states.setdefault(name, Map())

    rows = pd.DataFrame([(k, "insert", 0, k, "p", None, None, "pass") for k in range(1, 4001)], columns="seq kind target node tag name value verdict".split())
    regions = trees.Regions()
    regions.init(Handle())
    (out,) = regions.handleInputRows((1,), iter([rows]), None)
    assert out.iloc[0][["node", "size", "children"]].tolist() == [0, 4000, 4000]
    assert sum(s.calls for s in states.values()) < 20
    more = rows.assign(seq=rows.seq + 4000, kind="remove").head(3999)
    (out,) = regions.handleInputRows((1,), iter([more]), None)
    assert out.iloc[0][["node", "change"]].tolist() == [0, "gone"]
    assert sum(s.calls for s in states.values()) < 40
