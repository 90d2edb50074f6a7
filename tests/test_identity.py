"""The registry of people at size: memory by tracks and not by pairs, and the same decisions as a search of everyone."""

import random
import tracemalloc

from zonelake.operators import identity

S = 1_000_000
TOPOLOGY = {("A", "B"): ("OVERLAP", 0, 60 * S), ("B", "C"): ("TRANSIT", 5 * S, 90 * S)}


def test_live_tracks_of_a_camera_take_no_pairs():
    """Of 1,500 live tracks on a camera 1.1 million pairs are apart; keeping them took over 250 MB."""
    rng = random.Random(1)
    registry = identity.Registry({}, "s")
    tracemalloc.start()
    for k in range(1500):
        registry.resolve("C", k, [[rng.gauss(0, 1) for _ in range(8)]], k * S)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(registry.people) == 1500 and peak < 20e6


class Plain(identity.Registry):
    """Looks at everyone for each track, and keeps every pair that was on a camera together."""

    def __init__(self, *args, **options):
        super().__init__(*args, **options)
        self.pairs = set()

    def bind(self, person, key, vectors, now):
        self.pairs |= {frozenset((person.ref, self.bound[key[0], t])) for t in self.on_camera.get(key[0], ()) if self.bound[key[0], t] != person.ref}
        super().bind(person, key, vectors, now)

    def merge(self, keep, drop):
        super().merge(keep, drop)
        self.pairs = {frozenset(keep.ref if r == drop.ref else r for r in pair) for pair in self.pairs}

    def together(self, a, b):
        return frozenset((a.ref, b.ref)) in self.pairs

    def open_to(self, camera, now):
        return [p for p in self.people.values() if not any(c == camera for c, _ in p.active) and self.feasible(p.last_camera, camera, now - p.last_us)]

    def resolve(self, camera, track, vectors, now):
        if self.bound.get((camera, track)) not in self.people:
            for ref in [r for r, p in self.people.items() if now - p.last_us > identity.TTL_US and not p.active]:
                self.forget(ref)
        return super().resolve(camera, track, vectors, now)


def test_registry_equals_a_search_of_everyone(monkeypatch):
    """Tracks that begin, go on and end, merges, people who are forgotten by time and by number."""
    monkeypatch.setattr(identity, "GALLERY", 25)
    reasons, people = set(), 0
    for seed in range(12):
        rng = random.Random(seed)
        faces = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
        both, now, live = (identity.Registry(TOPOLOGY, "s", 0.7, 0.05), Plain(TOPOLOGY, "s", 0.7, 0.05)), 0, []
        for track in range(600):
            now += rng.choice((0, 1, 1, 20, 20, 400 if rng.random() < 0.02 else 2)) * S
            if live and rng.random() < 0.75:
                end = live.pop(rng.randrange(len(live)))
                [r.release(end) for r in both]
            if rng.random() < 0.02:
                camera = rng.choice("ABC")
                [r.release_camera(camera) for r in both]
                live = [k for k in live if k[0] != camera]
            key = rng.choice(live) if live and rng.random() < 0.2 else (rng.choice("ABC"), track)
            seen = [[x + rng.gauss(0, rng.choice((0.02, 0.3))) for x in rng.choice(faces)] for _ in range(rng.choice((1, 1, 3)))]
            got, want = (r.resolve(*key, seen, now) for r in both)
            assert got == want and list(both[0].people) == list(both[1].people)
            live += [] if key in live else [key]
            reasons.add(got[4])
            people = max(people, len(both[0].people))
        alive = {frozenset(pair) for pair in both[1].pairs if all(r in both[1].people for r in pair)}
        assert both[0].apart == alive and not any(p.active for p in both[0].people.values()) ^ bool(both[0].bound)
    assert reasons == {"existing_binding", "no_candidates", "below_threshold", "appearance_match", "ambiguous_margin", "consolidated_duplicate"} and people >= 25


def test_search_looks_at_few(monkeypatch):
    """Where nobody can be meant but those of the last seconds, others aren't looked at."""
    looked = []
    monkeypatch.setattr(identity.Registry, "feasible", lambda self, a, b, dt, f=identity.Registry.feasible: looked.append(dt) or f(self, a, b, dt))
    registry = identity.Registry({("A", "B"): ("TRANSIT", 0, 30 * S)}, "s")
    for k in range(400):
        registry.resolve("AB"[k % 2], k, [[float(k % 3), 1.0, float(k % 7)]], k * 10 * S)
    assert len(looked) <= 2 * 400
