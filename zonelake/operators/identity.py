"""Cross-camera identity: reachability between cameras, similarity with a margin, the registry, and counts.

Vectors stay in memory: no operator here writes one to a sink or a checkpoint.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelake.functions.identity import as_doubles, cosine
from zonelake.operators import intervals as iv
from zonelake.operators import order_stats
from zonelake.operators.folds import ordered

THRESHOLD, MARGIN = 0.70, 0.06
GALLERY, BANK, TTL_US = 2000, 5, 300_000_000
#: Parts in which rows meet a block of a larger gallery.
SALTS = 64
TRANSIT_US, SKEW_US = (0, 120_000_000), 5_000_000


def feasibility(kind: Column, lo: Column, hi: Column, same: Column, dt: Column, unknown_ok: bool = True) -> Column:
    """Struct (ok, reason): whether one person can have been on one camera and dt microseconds later on another.

    kind is OVERLAP, TRANSIT or null for a pair that no table knows; lo and hi its window.
    """
    low, high = F.coalesce(lo, F.lit(TRANSIT_US[0])), F.coalesce(hi, F.lit(TRANSIT_US[1]))
    verdict = lambda ok, reason: F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"))
    overlap = kind.eqNullSafe(F.lit("OVERLAP"))
    return (
        F.when(same, verdict(True, "same_camera"))
        .when(overlap & (dt < -SKEW_US), verdict(False, "overlap_clock_skew"))
        .when(overlap & (dt > high), verdict(False, "overlap_stale"))
        .when(overlap, verdict(True, "overlapping"))
        .when(kind.isNull() & F.lit(not unknown_ok), verdict(False, "unknown_pair_rejected"))
        .when(dt < 0, verdict(False, "negative_dt"))
        .when(dt < low, verdict(False, "too_fast"))
        .when(dt > high, verdict(False, "too_slow"))
        .when(kind.isNull(), verdict(True, "unknown_pair"))
        .otherwise(verdict(True, "transit_ok"))
    )


def reachable(pairs: DataFrame, topology: DataFrame, unknown_ok: bool = True) -> DataFrame:
    """Adds (ok, reason) to pairs (from_camera, to_camera, dt_us); topology has one row (a, b, kind, min_us, max_us) for
    each known pair with a <= b, at most the square of a site's cameras, so it is broadcast."""
    t = F.broadcast(topology.select(F.col("a").alias("__a"), F.col("b").alias("__b"), "kind", "min_us", "max_us"))
    known = pairs.join(t, (F.least("from_camera", "to_camera") == F.col("__a")) & (F.greatest("from_camera", "to_camera") == F.col("__b")), "left")
    found = feasibility(F.col("kind"), F.col("min_us"), F.col("max_us"), F.col("from_camera") == F.col("to_camera"), F.col("dt_us"), unknown_ok)
    return known.withColumn("__f", found).withColumn("ok", F.col("__f.ok")).withColumn("reason", F.col("__f.reason")).drop("__a", "__b", "kind", "min_us", "max_us", "__f")


def gallery_means(views: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean of the unit vectors of each key. Sums run by position, so a key with very many views is summed in parts."""
    norm = F.sqrt(F.aggregate(as_doubles(F.col(vector)), F.lit(0.0), lambda s, x: s + x * x))
    each = views.select(key, norm.alias("__n"), F.posexplode(vector).alias("__i", "__x")).where("__n > 0")
    means = each.groupBy(key, "__i").agg(F.avg(F.col("__x").cast("double") / F.col("__n")).alias("__m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda p: p["__m"]).alias("mean"))


def in_blocks(rows: DataFrame, gallery: DataFrame, key: str) -> DataFrame:
    """Each row once for each block of about GALLERY keys, with the block as an array (k, mean).

    One block is small enough to be broadcast. Of more, each is repeated for SALTS parts of the rows, so that a task gets a part of
    the rows and one block at a time.
    """
    blocks = max(1, -(-gallery.count() // GALLERY))
    number = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    listed = gallery.groupBy(number.alias("__block")).agg(F.collect_list(F.struct(F.col(key).alias("k"), "mean")).alias("__gallery"))
    if blocks == 1:
        return rows.withColumn("__block", F.lit(0)).join(F.broadcast(listed), "__block", "left").drop("__block")
    salted = listed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.join(salted, ["__block", "__salt"], "left").drop("__block", "__salt")


def best_match(tracks: DataFrame, gallery: DataFrame, track: str, vector: str, key: str) -> DataFrame:
    """For each track the best key of the gallery and the runner-up's score; matched if the best is at or over the
    threshold and leads by the margin. Each block of the gallery gives a track its two best, of which the two best of all follow."""
    rank = lambda scores: F.slice(F.sort_array(scores, asc=False), 1, 2)
    top = rank(F.transform("__gallery", lambda g: F.struct(cosine(F.col(vector), g["mean"]).alias("s"), (-g["k"]).alias("k"))))
    scored = in_blocks(tracks.select(track, vector), gallery, key).select(track, top.alias("__top")).groupBy(track).agg(rank(F.flatten(F.collect_list("__top"))).alias("__scores"))
    best, second = F.get("__scores", F.lit(0)), F.coalesce(F.get("__scores", F.lit(1))["s"], F.lit(0.0))
    score = F.greatest(best["s"], F.lit(0.0))
    out = scored.select(track, (-best["k"]).alias("best"), score.alias("score"), F.greatest(second, F.lit(0.0)).alias("runner_up"))
    return out.withColumn("matched", (F.col("score") >= THRESHOLD) & (F.col("score") - F.col("runner_up") >= MARGIN))


def scored_pairs(views: DataFrame, gallery: DataFrame, label: str, vector: str, key: str, digits: int = 6) -> DataFrame:
    """(same, score) of every view with every mean: whether it is its own person's, and the rounded cosine. Scores are told apart by
    value only, so separability() counts them where they are made and pairs are never moved."""
    scores = F.transform("__gallery", lambda g: F.struct((g["k"] == F.col(label)).alias("same"), F.round(cosine(F.col(vector), g["mean"]), digits).alias("score")))
    return in_blocks(views.select(label, vector), gallery, key).select(F.inline(scores))


def candidates(observations: DataFrame, topology: DataFrame, within_us: int = TTL_US, unknown_ok: bool = True) -> DataFrame:
    """Pairs of observations (site_id, camera_id, track_id, ts_us, seq, vector) that can be one person: of one site and different tracks,
    the first no later than the second but for the skew of overlapping cameras, at most within_us apart, and feasible by the
    topology; with the reason and the cosine of their vectors.

    Rows meet in bands of time as wide as the longest gap, the earlier one in the two bands that a later one can look back to, so a site
    with a third of all rows is spread over its bands and no pair outside of the windows is made. The windows are the topology's own, where a pair
    of cameras has one, so within_us should be no less than the longest of them.
    """
    band = within_us + SKEW_US
    a = observations.select("site_id", *[F.col(c).alias(f"from_{c}") for c in ("camera_id", "track_id", "ts_us", "seq", "vector")])
    b = observations.select("site_id", *[F.col(c).alias(f"to_{c}") for c in ("camera_id", "track_id", "ts_us", "seq", "vector")]).withColumn("__band", F.floor(F.col("to_ts_us") / band))
    own = F.floor(F.col("from_ts_us") / band)
    a = a.withColumn("__band", F.explode(F.array(own - 1, own, own + 1)))
    dt = F.col("to_ts_us") - F.col("from_ts_us")
    later = (dt > 0) | ((dt == 0) & (F.col("from_seq") < F.col("to_seq"))) | ((dt < 0) & (dt >= -SKEW_US) & (F.col("from_seq") < F.col("to_seq")))
    other = (F.col("from_camera_id") != F.col("to_camera_id")) | (F.col("from_track_id") != F.col("to_track_id"))
    met = a.join(b, ["site_id", "__band"]).where(later & (dt <= within_us) & other).withColumn("dt_us", dt)
    named = met.withColumnRenamed("from_camera_id", "from_camera").withColumnRenamed("to_camera_id", "to_camera")
    possible = reachable(named, topology, unknown_ok).where("ok")
    return possible.select(
        "site_id", "from_camera", F.col("from_track_id").alias("from_track"), "from_seq", "to_camera", F.col("to_track_id").alias("to_track"), "to_seq", "dt_us", "reason",
        cosine(F.col("to_vector"), F.col("from_vector")).alias("score"),
    )


def merged(resolved: DataFrame, pairs: DataFrame) -> DataFrame:
    """Operator's corrections (keep, drop): rows of drop become rows of keep; chains of corrections are followed by repeating this."""
    p = pairs.select(F.col("drop").alias("global_ref"), F.col("keep").alias("__keep")).where("global_ref <> __keep").dropDuplicates(["global_ref"])
    return resolved.join(p, "global_ref", "left").withColumn("global_ref", F.coalesce("__keep", "global_ref")).drop("__keep").select(*resolved.columns)


def journey(resolved: DataFrame, key: tuple[str, ...] = ("site_id", "global_ref")) -> DataFrame:
    """(key, camera_id, from_us, to_us, n): the stretches that each person spent on one camera after another, in order of time."""
    stretches = iv.runs(resolved, list(key), F.col("camera_id"))
    return stretches.groupBy(*key, "run", "camera_id").agg(F.min("ts_us").alias("from_us"), F.max("ts_us").alias("to_us"), F.count("*").alias("n")).drop("run")


def listing(resolved: DataFrame, cross_camera_only: bool = False) -> DataFrame:
    """(site_id, global_ref, first_us, last_us, cameras, sightings) of each person."""
    out = resolved.groupBy("site_id", "global_ref").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count_distinct("camera_id").alias("cameras"), F.count("*").alias("sightings"))
    return out.where("cameras > 1") if cross_camera_only else out


@dataclass
class Person:
    """``active`` are live tracks, ``stays`` by camera the stretches [first, last] of bindings during which a track of theirs was there;
    last is null for a live one."""

    ref: str
    bank: list
    last_camera: str
    last_us: int
    made: int = 0
    active: dict = field(default_factory=dict)
    stays: dict = field(default_factory=dict)
    matrix: np.ndarray | None = None
    mean: np.ndarray | None = None

    def on(self, camera: str) -> bool:
        """Whether a track is live there; there is one a camera at most."""
        return any(c == camera for c, _ in self.active)


class Registry:
    """One site's identities in order of time: sticky bindings, then reachability, then similarity with a margin, then
    consolidation of twins, else a new identity. Its state is bounded by GALLERY people with BANK vectors each, besides those with a
    live track, and two numbers for each of their tracks; tracks end by release() and release_camera().

    People are listed by their last camera in order of time, so those who can be meant are found without a look at all others. Who was on a
    camera together follows from the stays of two people; no pairs are kept.
    """

    def __init__(self, topology: dict[tuple[str, str], tuple[str, int, int]], salt: str, threshold: float = THRESHOLD, margin: float = MARGIN, unknown_ok: bool = True) -> None:
        self.topology, self.salt, self.threshold, self.margin, self.unknown_ok = topology, salt, threshold, margin, unknown_ok
        self.people: dict[str, Person] = {}
        self.bound: dict[tuple[str, int], str] = {}
        self.made = self.bindings = 0
        self.on_camera: dict[str, set[int]] = {}
        self.placed: dict[str, dict[str, Person]] = {}  # by last camera, the latest last
        self.away: dict[str, dict[str, Person]] = {}  # of these, who has no live track there
        self.idle: list[tuple[int, str]] = []  # a heap of (last_us, ref) of people without live tracks, some of it out of date

    def window(self, a: str, b: str) -> tuple[str | None, int, int]:
        return self.topology.get((min(a, b), max(a, b)), (None, *TRANSIT_US))

    def feasible(self, a: str, b: str, dt: int) -> bool:
        if a == b:
            return True
        kind, lo, hi = self.window(a, b)
        if kind == "OVERLAP":
            return -SKEW_US <= dt <= hi
        return (kind is not None or self.unknown_ok) and max(lo, 0) <= dt <= hi

    @staticmethod
    def unit_mean(vectors: np.ndarray) -> np.ndarray:
        return vectors.mean(0) / max(float(np.linalg.norm(vectors.mean(0))), 1e-12)

    @classmethod
    def similarity(cls, x: np.ndarray, mean: np.ndarray, person: Person) -> float:
        return max(float(mean @ person.mean), 0.9 * float((x @ person.matrix.T).max()))

    def keep(self, person: Person, vectors: list) -> None:
        person.bank = (person.bank + vectors)[-BANK:]
        person.matrix = np.array(person.bank)
        person.mean = self.unit_mean(person.matrix)

    def place(self, person: Person, camera: str, now: int) -> None:
        """Lists a person where they are, or anew where they were."""
        self.unplace(person)
        person.last_camera, person.last_us = camera, now
        self.placed.setdefault(camera, {})[person.ref] = person
        if not person.on(camera):
            self.away.setdefault(camera, {})[person.ref] = person

    def unplace(self, person: Person) -> None:
        for listed in (self.placed, self.away):
            listed.get(person.last_camera, {}).pop(person.ref, None)

    def bind(self, person: Person, key: tuple[str, int], vectors: list, now: int) -> None:
        self.bindings += 1
        self.keep(person, vectors)
        person.active[key] = stay = [self.bindings, None]
        person.stays.setdefault(key[0], []).append(stay)
        self.place(person, key[0], now)
        self.on_camera.setdefault(key[0], set()).add(key[1])
        self.bound[key] = person.ref

    def together(self, a: Person, b: Person) -> bool:
        """Whether both had a live track on one camera at once, so that they are two people."""
        for camera in a.stays.keys() & b.stays.keys():
            mine, theirs, i, j = a.stays[camera], b.stays[camera], 0, 0
            while i < len(mine) and j < len(theirs):
                first, second = (mine[i], theirs[j]) if mine[i][0] < theirs[j][0] else (theirs[j], mine[i])
                if first[1] is None or second[0] <= first[1]:
                    return True
                i, j = (i + 1, j) if first is mine[i] else (i, j + 1)
        return False

    @property
    def apart(self) -> set[frozenset]:
        """The pairs of people who were on a camera together; they are as many as its square, so resolve() asks for one at a time."""
        every = list(self.people.values())
        return {frozenset((a.ref, b.ref)) for k, a in enumerate(every) for b in every[:k] if self.together(a, b)}

    def forget(self, ref: str) -> None:
        """Drops a person with all that refers to them."""
        if person := self.people.pop(ref, None):
            self.unplace(person)
            for key in list(person.active):
                self.unbind(key)

    def unbind(self, key: tuple[str, int]) -> str:
        self.on_camera.get(key[0], set()).discard(key[1])
        return self.bound.pop(key, "")

    def merge(self, keep: Person, drop: Person) -> None:
        self.keep(keep, drop.bank)
        self.unplace(drop)
        keep.active |= drop.active
        for key in drop.active:
            self.bound[key] = keep.ref
        for camera, stays in drop.stays.items():
            keep.stays[camera] = sorted(keep.stays.get(camera, []) + stays, key=lambda x: x[0])
        self.people.pop(drop.ref)
        last = max(keep, drop, key=lambda p: p.last_us)
        self.place(keep, last.last_camera, last.last_us)
        self.rest(keep)

    def rest(self, person: Person) -> None:
        if not person.active:
            heapq.heappush(self.idle, (person.last_us, person.ref))

    def rested(self) -> str | None:
        """Takes the person without live tracks who was seen last the longest ago, if the heap's first is one still."""
        last_us, ref = heapq.heappop(self.idle)
        person = self.people.get(ref)
        return ref if person and not person.active and person.last_us == last_us else None

    def release(self, key: tuple[str, int]) -> None:
        """The end of a track: its person stays for TTL_US."""
        if person := self.people.get(self.unbind(key)):
            person.active.pop(key)[1] = self.bindings
            if person.last_camera == key[0] and not person.on(key[0]):
                self.away.setdefault(key[0], {})[person.ref] = person
            self.rest(person)

    def release_camera(self, camera: str) -> None:
        """The end of all tracks of a camera that went offline."""
        for track in list(self.on_camera.get(camera, ())):
            self.release((camera, track))

    def open_to(self, camera: str, now: int) -> list[Person]:
        """Who can be meant by a new track, in the order in which they were made: no live track on the camera, and a feasible way from the last one."""
        found = list(self.away.get(camera, {}).values())
        for other, people in self.placed.items():
            if other == camera:
                continue
            hi = self.window(other, camera)[2]
            for person in reversed(people.values()):
                if now - person.last_us > hi:
                    break
                if self.feasible(other, camera, now - person.last_us) and not person.on(camera):
                    found.append(person)
        return sorted(found, key=lambda p: p.made)

    def resolve(self, camera: str, track: int, vectors: list, now: int) -> tuple[str, bool, float, float, str]:
        """(ref, matched, score, runner-up, reason)."""
        key = (camera, track)
        vectors = [np.asarray(v, float) / max(float(np.linalg.norm(v)), 1e-12) for v in vectors]
        if (ref := self.bound.get(key)) in self.people:
            person = self.people[ref]
            self.keep(person, vectors[-1:])
            self.place(person, camera, now)
            return ref, True, 0.0, 0.0, "existing_binding"
        while self.idle and now - self.idle[0][0] > TTL_US:
            if ref := self.rested():
                self.forget(ref)
        x = np.array(vectors)
        mean = self.unit_mean(x)
        ranked = sorted(((self.similarity(x, mean, p), p.made, p) for p in self.open_to(camera, now)), key=lambda r: (-r[0], r[1]))
        score, second = (max(ranked[i][0], 0.0) if len(ranked) > i else 0.0 for i in (0, 1))
        reason = "below_threshold" if ranked else "no_candidates"
        if ranked and score >= self.threshold:
            best = ranked[0][2]
            if score - second >= self.margin or len(ranked) == 1:
                self.bind(best, key, vectors, now)
                return best.ref, True, score, second, "appearance_match"
            twin = ranked[1][2]
            if not self.together(best, twin) and self.similarity(best.matrix, best.mean, twin) >= self.threshold:
                self.merge(best, twin)
                self.bind(best, key, vectors, now)
                return best.ref, True, score, second, "consolidated_duplicate"
            reason = "ambiguous_margin"
        self.made += 1
        ref = "gp_" + hashlib.sha256(f"{self.salt}:g:{self.made}".encode()).hexdigest()[:16]
        person = self.people[ref] = Person(ref, [], camera, now, self.made)
        self.bind(person, key, vectors, now)
        over = len(self.people) - GALLERY
        while over > 0 and self.idle:
            if old := self.rested():
                self.forget(old)
                over -= 1
        return ref, False, score, second, reason


RESOLVED = "site_id string, camera_id string, track_id long, ts_us long, global_ref string, matched boolean, score double, runner_up double, reason string"


def resolve(observations: DataFrame, topology: list[tuple[str, str, str, int, int]], salt: str, ends: DataFrame | None = None, **options) -> DataFrame:
    """Runs the registry over (site_id, camera_id, track_id, ts_us, seq, vectors): in order within a site, as each decision
    depends on those before it, and in parallel across sites.

    ``ends`` (site_id, camera_id, track_id, ts_us, seq) are ends of tracks, of all tracks of a camera where track_id is null;
    they release people, who are then forgotten after TTL_US or where there are more than GALLERY.
    """
    known = {(min(a, b), max(a, b)): (kind, lo, hi) for a, b, kind, lo, hi in topology}

    def step(registry: Registry, row: dict) -> list[tuple]:
        if row["vectors"] is None:
            if row["track_id"] is None:
                registry.release_camera(row["camera_id"])
            else:
                registry.release((row["camera_id"], row["track_id"]))
            return []
        found = registry.resolve(row["camera_id"], row["track_id"], list(row["vectors"]), row["ts_us"])
        return [(row["site_id"], row["camera_id"], row["track_id"], row["ts_us"], *found)]

    rows = observations.select("site_id", "camera_id", "track_id", "ts_us", "seq", "vectors").where("vectors is not null")
    if ends is not None:
        rows = rows.unionByName(ends.select("site_id", "camera_id", "track_id", "ts_us", "seq"), allowMissingColumns=True)
    return ordered(rows, ["site_id"], lambda: Registry(known, salt, **options), step, RESOLVED)


def occupancy(resolved: DataFrame, ends: DataFrame, at_us: int, by: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """Distinct people with a live track at an instant, by site or by site and camera: tracks that began and didn't end."""
    track = ["site_id", "camera_id", "track_id"]
    begun = resolved.where(F.col("ts_us") <= at_us).groupBy(*track).agg(F.max_by("global_ref", "ts_us").alias("global_ref"), F.max("ts_us").alias("__seen"))
    over = ends.where(F.col("ts_us") <= at_us)
    own = over.where("track_id is not null").groupBy(*track).agg(F.max("ts_us").alias("__end"))
    cameras = over.where("track_id is null").groupBy("site_id", "camera_id").agg(F.max("ts_us").alias("__down"))
    live = begun.join(own, track, "left").join(cameras, ["site_id", "camera_id"], "left").where(F.col("__seen") > F.coalesce(F.greatest("__end", "__down"), F.lit(-(2**62))))
    return live.groupBy(*by).agg(F.count_distinct("global_ref").alias("people"), F.count("*").alias("tracks"))


def counts(resolved: DataFrame) -> DataFrame:
    """Per site: distinct people, the sum of distinct people by camera, and people seen by more than one camera.

    The sum less the distinct people equals the last only if nobody is on three cameras, so all are given.
    """
    cameras = resolved.groupBy("site_id", "global_ref").agg(F.count_distinct("camera_id").alias("n"))
    return cameras.groupBy("site_id").agg(F.count("*").alias("unique_total"), F.sum("n").alias("sum_by_camera"), F.count_if(F.col("n") > 1).alias("cross_camera"))


def separability(pairs: DataFrame) -> DataFrame:
    """Lowest, upper median and highest score of true and of false pairs (same, score), and the gap between them."""
    stats = order_stats.select(pairs, ["same"], "score", {"lo": lambda n: n * 0, "median": order_stats.upper_median, "hi": lambda n: n - 1})
    pick = lambda c, same: F.max(F.when(F.col("same") == same, F.col(c)))
    return stats.agg(pick("lo", True).alias("true_min"), pick("median", True).alias("true_median"), pick("hi", False).alias("false_max"), pick("median", False).alias("false_median"), (pick("lo", True) - pick("hi", False)).alias("gap"))
