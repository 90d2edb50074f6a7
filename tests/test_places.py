"""Places of boxes by a grid against a look at every place."""

import random
import time

from zonelake.operators import tracks


def plain(rows, reach):
    """Looks at every place for each box."""
    sums, frame, taken, out = [], None, set(), []
    for f, x, y in rows:
        if f != frame:
            frame, taken = f, set()
        near = min(((abs(complex(x - sx / n, y - sy / n)), k) for k, (sx, sy, n) in enumerate(sums) if k not in taken), default=(reach + 1, 0))
        k = near[1] if near[0] <= reach else len(sums)
        sums[k:k] = [(0.0, 0.0, 0)] if k == len(sums) else []
        sums[k] = sums[k][0] + x, sums[k][1] + y, sums[k][2] + 1
        taken.add(k)
        out.append(k)
    return out


def test_grid_equals_a_look_at_every_place():
    """Crowded frames, copies of a box in one frame, equal distances, places exactly at the reach and at the edges of cells, coordinates under 0."""
    for seed in range(30):
        rng = random.Random(seed)
        some = lambda: rng.choice((rng.uniform(-50, 50), rng.randrange(-50, 50), rng.randrange(-10, 10) * 5.0))
        spots = [(float(some()), float(some())) for _ in range(40)]
        rows = [(f, *rng.choice(spots)) for f in range(12) for _ in range(rng.choice((3, 40)))]
        for reach in (0.0, 5.0, 12.5, 70.0):
            places = tracks.Clusters(reach)
            assert [places.add(*r) for r in rows] == plain(rows, reach)


def test_a_box_looks_at_few_places(monkeypatch):
    """In frames of 2,000 boxes a box looks at the free places around it; all places were looked at before, and all taken ones listed."""
    looked = []
    monkeypatch.setattr(tracks, "abs", lambda x: looked.append(1) or abs(x), raising=False)
    rng, places = random.Random(1), tracks.Clusters(10.0)
    for f in range(3):
        for _ in range(2000):
            places.add(f, rng.uniform(0, 1000), rng.uniform(0, 1000))
    assert 0 < len(looked) < 6000 * 12


def test_crowds_cost_no_more_a_box():
    """Sixteen times the boxes over sixteen times the area: a look at every place would take many times as long for a box."""

    def seconds(n, side):
        rng, places = random.Random(1), tracks.Clusters(10.0)
        spots = [(f, rng.uniform(0, side), rng.uniform(0, side)) for f in range(2) for _ in range(n)]
        began = time.process_time()
        for s in spots:
            places.add(*s)
        return (time.process_time() - began) / len(spots)

    assert min(seconds(4000, 1000) for _ in range(2)) < 5 * min(seconds(250, 250) for _ in range(3))
