"""People whose boxes overlap a track's equally well: last digits are those of the boxes before they were moved."""

import random
from collections import Counter, defaultdict

from zonelake.operators import tracks

BOX = "camera_id string, ts_us long, track_id long, person long, x1 double, y1 double, x2 double, y2 double"


def test_ties_after_a_move(spark):
    rng, rows = random.Random(3), []
    for k in range(4000):
        x, y = round(rng.uniform(0, 500), 2) * 7 % 1180, float(rng.randrange(560))
        rows.append(("C", k // 40, rng.randrange(8), rng.randrange(6), x, y, x + 60, y + 90.0))
    seen = spark.createDataFrame(rows, BOX)
    truth = seen.selectExpr("camera_id", "ts_us", "person", "x1 + 5 AS x1", "y1", "x2 + 5 AS x2", "y2", "(x2 - x1) * (y2 - y1) AS area")
    best, hits = {}, defaultdict(Counter)
    for _, t, track, _, x1, y1, x2, y2 in rows:
        for _, u, _, person, a1, b1, a2, b2 in rows[t * 40 : t * 40 + 40]:
            i = max(0.0, min(x2, a2 + 5) - max(x1, a1 + 5)) * max(0.0, min(y2, b2) - max(y1, b1))
            iou = i / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - i)
            if t == u and iou >= 0.5:
                best[t, track] = max(best.get((t, track), (0.0, 0)), (iou, -person))
    for (_, track), (_, person) in best.items():
        hits[track][-person] += 1
    want = {track: max((n, -person) for person, n in c.items() if n >= 3) for track, c in hits.items()}
    found = lambda truth: {r.track_id: (r.hits, -r.person) for r in tracks.ground_truth(seen, truth).collect()}
    assert found(truth) == want and found(truth.drop("area")) != want
