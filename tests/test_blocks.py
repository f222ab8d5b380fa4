import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.operators import structure


def by_hand(old, new, reach):
    out = {}
    for g, k, a in old:
        if len(a) >= 4:
            hits = Counter((m, y - x) for h, m, b in new if g == h and len(b) >= 4 for x in a for y in b if abs(y - x) <= reach)
            best = min(((-n, abs(d), d, m) for (m, d), n in hits.items()), default=None)
            if best and round(-best[0] / len(a), 6) >= 0.6:
                out[g, k] = (best[3], best[2], -best[0])
    return out


@pytest.mark.parametrize("block", [50, 1 << 21])
def test_dense_children_that_moved_meet_in_few_rows(spark, block):
    """All children of a group are near to one another; what is shuffled are the rows, not their pairs."""
    rnd = random.Random(17)
    some = lambda: sorted(rnd.sample(range(60), rnd.randrange(2, 20)))
    old = [(rnd.choice("gh"), k, some()) for k in range(60)]
    new = [(g, k + 500, [c + rnd.choice((4, 4, 4, -3)) for c in a if rnd.random() < 0.9]) for g, k, a in old]
    new = [(g, k, sorted(set(a))) for g, k, a in new]
    frame = lambda rows: spark.createDataFrame(rows, "g string, k long, children array<long>")
    told = structure.by_delta(frame(old), frame(new), ["g"], "k", "children", block=block)
    want = by_hand(old, new, 12)
    assert {(r.g, r.k): (r.new_key, r.delta, r.hits) for r in told.collect()} == want and len(want) > 10
    assert "explode(children" not in told._jdf.queryExecution().toString()


def test_rows_of_a_block_are_counted_together(monkeypatch):
    """Three thousand rows of ten groups are no work of their own each, and have what plain loops find."""
    rnd = random.Random(17)
    lists = [[(g, k, sorted(rnd.sample(range(4000), 5))) for g in range(10) for k in range(n)] for n in (300, 40)]
    old, new = (pa.table({"__g": [g for g, _, _ in x], "key": [k for _, k, _ in x], "size": [len(c) for _, _, c in x], "c": pa.array([c for _, _, c in x], pa.list_(pa.int64()))}) for x in lists)
    calls, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    place, key, size, shift, hits = structure._moved(old, new, 12)
    assert len(calls) < 20
    found = {}
    for i, (g, _, a) in enumerate(lists[0]):
        told = Counter((c - x, j) for j, (h, _, b) in enumerate(lists[1]) if g == h for x in a for c in b if abs(c - x) <= 12)
        if told:
            found[i] = min((-n, abs(d), d, j) for (d, j), n in told.items())
    assert {i: (-h, abs(d), d, j) for i, j, d, h in zip(place.tolist(), key.tolist(), shift.tolist(), hits.tolist())} == found and set(size.tolist()) == {5}
    few = structure._moved(old, new, 12, 100)
    assert all(np.array_equal(x, y) for x, y in zip(few, (place, key, size, shift, hits)))
