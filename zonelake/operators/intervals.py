"""Primitives over half-open intervals [a_us, b_us) in microseconds, by key.

Keys may be very unequal, so whatever follows the order of a key's rows works on two levels: within chunks of time, then over
one summary row for each chunk (scan(), hold_forward(), previous(), runs(), and offline() by these) or over what touches the
edges of chunks (merge()); overlaps meet in bins of time. No task needs all rows of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def _equal(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c] == right[f"__{c}"] for c in columns))


def hold_forward(rows: DataFrame, keys: list[str], ts: str = "ts_us", seq: str = "seq", into: str = "next_us", chunk_us: int = DAY) -> DataFrame:
    """Adds the time of the next row of the key, null for the last one: a reading describes all moments until the next."""
    chunked = rows.withColumn("__chunk", F.floor(F.col(ts) / chunk_us))
    inside = F.lead(ts).over(Window.partitionBy(*keys, "__chunk").orderBy(ts, seq))
    firsts = chunked.groupBy(*keys, "__chunk").agg(F.min(ts).alias("__first"))
    following = firsts.withColumn("__next", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__chunk"))).drop("__first")
    held = chunked.withColumn("__inside", inside).join(following, [*keys, "__chunk"])
    return held.withColumn(into, F.coalesce("__inside", "__next")).drop("__chunk", "__inside", "__next")


def scan(rows: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], order: list[str], inclusive: bool = True, chunk_us: int = DAY) -> DataFrame:
    """Adds running aggregates over a key's rows in order, whose first column is a time: values are (max, min or sum, expression) by
    the name they get. Not inclusive: over the rows before.

    These functions are associative, so a row's value is that of its chunk up to it, together with that of all chunks before.
    """
    functions = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b))}
    chunked = rows.withColumns({"__chunk": F.floor(F.col(order[0]) / chunk_us), **{f"__of_{n}": of for n, (_, of) in values.items()}})
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    sums = chunked.groupBy(*keys, "__chunk").agg(*[functions[how][0](f"__of_{n}").alias(f"__of_{n}") for n, (how, _) in values.items()])
    chunks = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__chunk", *[functions[how][0](f"__of_{n}").over(chunks).alias(f"__before_{n}") for n, (how, _) in values.items()])
    scanned = chunked.withColumns({f"__in_{n}": functions[how][0](f"__of_{n}").over(inside) for n, (how, _) in values.items()}).join(sums, [*keys, "__chunk"])
    scanned = scanned.withColumns({n: functions[how][1](F.col(f"__in_{n}"), F.col(f"__before_{n}")) for n, (how, _) in values.items()})
    return scanned.drop("__chunk", *[f"__{x}_{n}" for n in values for x in ("of", "in", "before")])


def chunk_ends(chunked: DataFrame, keys: list[str], ts: str, seq: str, *columns: str) -> DataFrame:
    """The last row of each chunk."""
    place = F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(F.desc(ts), F.desc(seq)))
    return chunked.select(*dict.fromkeys([*keys, "__chunk", ts, seq, *columns])).withColumn("__place", place).where("__place = 1").drop("__place")


def previous(rows: DataFrame, keys: list[str], column: str, into: str, ts: str = "ts_us", seq: str = "seq", chunk_us: int = DAY) -> DataFrame:
    """Adds a column's value in the row before of the key, null for the first; within chunks as hold_forward()."""
    chunked = rows.withColumn("__chunk", F.floor(F.col(ts) / chunk_us))
    inside = F.lag(F.struct(F.col(column).alias("v"))).over(Window.partitionBy(*keys, "__chunk").orderBy(ts, seq))
    ends = chunk_ends(chunked, keys, ts, seq, column).withColumn("__carried", F.lag(F.struct(F.col(column).alias("v"))).over(Window.partitionBy(*keys).orderBy("__chunk")))
    ends = ends.select(*keys, "__chunk", "__carried")
    return chunked.withColumn("__inside", inside).join(ends, [*keys, "__chunk"]).withColumn(into, F.coalesce("__inside", "__carried")["v"]).drop("__chunk", "__inside", "__carried")


def runs(rows: DataFrame, keys: list[str], value: Column, into: str = "run", ts: str = "ts_us", seq: str = "seq", chunk_us: int = DAY) -> DataFrame:
    """Adds the place (ts, seq) at which the run of equal values that a row belongs to began.

    Like hold_forward(), it works within chunks of time; from chunk to chunk go its last value and the start of its last run.
    """
    chunked = rows.withColumn("__chunk", F.floor(F.col(ts) / chunk_us)).withColumn("__value", F.struct(value.alias("value")))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(ts, seq)
    chunks = Window.partitionBy(*keys).orderBy("__chunk")
    ends = chunk_ends(chunked, keys, ts, seq, "__value").withColumn("__carried", F.lag("__value").over(chunks)).select(*keys, "__chunk", "__carried")
    before = F.coalesce(F.lag("__value").over(inside), F.col("__carried"))
    place = F.struct(F.col(ts).alias("ts_us"), F.col(seq).alias("seq"))
    marked = chunked.join(ends, [*keys, "__chunk"]).withColumn("__start", F.when(before.isNull() | ~before.eqNullSafe(F.col("__value")), place))
    starts = marked.groupBy(*keys, "__chunk").agg(F.max("__start").alias("__latest"))
    starts = starts.withColumn("__earlier", F.max("__latest").over(chunks.rowsBetween(Window.unboundedPreceding, -1))).drop("__latest")
    here = F.last("__start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    found = marked.withColumn("__here", here).join(starts, [*keys, "__chunk"])
    return found.withColumn(into, F.coalesce("__here", "__earlier")).drop("__chunk", "__value", "__carried", "__start", "__here", "__earlier")


def starts(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The rows at which a value differs from that of the row before, and the first of each key."""
    return runs(rows, keys, value, "__run").where((F.col("__run.ts_us") == F.col("ts_us")) & (F.col("__run.seq") == F.col("seq"))).drop("__run")


def clip(rows: DataFrame, t0: int, t1: int) -> DataFrame:
    clipped = rows.withColumn("a_us", F.greatest("a_us", F.lit(t0))).withColumn("b_us", F.least("b_us", F.lit(t1)))
    return clipped.where("b_us > a_us")


def merge(rows: DataFrame, keys: list[str], chunk_us: int = DAY) -> DataFrame:
    """Coalesces overlapping and touching intervals of a key; empty ones are dropped.

    Intervals are cut at the edges of chunks and coalesced within each; what then ends at an edge is glued to what begins there. Only
    such pieces, two of a chunk at most, meet by key alone, so the input is read once and nothing is joined.
    """
    cut = binned(rows.where("b_us > a_us").select(*keys, "a_us", "b_us"), chunk_us)
    lo, hi = F.col("__bin") * chunk_us, (F.col("__bin") + 1) * chunk_us
    cut = cut.withColumn("a_us", F.greatest("a_us", lo)).withColumn("b_us", F.least("b_us", hi))
    inside = Window.partitionBy(*keys, "__bin").orderBy("a_us", "b_us")
    reach = F.max("b_us").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    begins = cut.withColumn("__reach", reach).withColumn("__begins", F.when(F.col("__reach").isNull() | (F.col("a_us") > F.col("__reach")), F.col("a_us")))
    # By range, so that equal beginnings, of which only the first row says so, are one.
    began = F.max("__begins").over(Window.partitionBy(*keys, "__bin").orderBy("a_us").rangeBetween(Window.unboundedPreceding, 0))
    local = begins.withColumn("__began", began).groupBy(*keys, "__bin", "__began").agg(F.min("a_us").alias("a_us"), F.max("b_us").alias("b_us"))
    apart = F.when((F.col("a_us") > lo) & (F.col("b_us") < hi), F.col("a_us"))
    along = Window.partitionBy(*keys, "__apart").orderBy("a_us")
    glued = local.withColumn("__apart", apart).withColumn("__new", F.coalesce(F.lag("b_us").over(along) != F.col("a_us"), F.lit(True)).cast("int"))
    glued = glued.withColumn("__island", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return glued.groupBy(*keys, "__apart", "__island").agg(F.min("a_us").alias("a_us"), F.max("b_us").alias("b_us")).drop("__apart", "__island")


def binned(rows: DataFrame, bin_us: int = DAY) -> DataFrame:
    """One row for each bin that an interval meets."""
    return rows.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("a_us") / bin_us), F.floor((F.col("b_us") - 1) / bin_us))))


def swept(pieces: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces (keys, __bin, __a, __b, ...) of bins with how many holes (keys, __bin, a_us, b_us), apart from each other, have begun in the bin by __a and by
    __b (__begun_a, __begun_b) and the time inside holes until then (__lost_a, __lost_b).

    Both are one stream, sorted by each end of a piece in turn, so neither a piece nor a hole is looked at more than once or twice, however
    many of the others its bin has.
    """
    others = [c for c in pieces.columns if c not in (*keys, "__bin", "__a", "__b")]
    mine = pieces.select(*keys, "__bin", "__a", "__b", F.lit(1).alias("__kind"), F.struct(F.lit(0).alias("__"), *others).alias("__row"))
    theirs = holes.dropna(subset=keys).select(*keys, "__bin", F.col("a_us").alias("__a"), F.col("a_us").alias("__b"), F.lit(0).alias("__kind"), (F.col("b_us") - F.col("a_us")).alias("__length"), F.col("b_us").alias("__end"))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    for end in ("a", "b"):
        so_far = Window.partitionBy(*keys, "__bin").orderBy(f"__{end}", "__kind").rowsBetween(Window.unboundedPreceding, 0)
        ahead = F.greatest(F.max("__end").over(so_far) - F.col(f"__{end}"), F.lit(0))
        both = both.withColumns({f"__begun_{end}": F.count("__end").over(so_far), f"__lost_{end}": F.coalesce(F.sum("__length").over(so_far) - ahead, F.lit(0))})
    return both.where("__kind = 1").select(*keys, "__bin", "__a", "__b", *[F.col(f"__row.{c}").alias(c) for c in others], "__begun_a", "__begun_b", "__lost_a", "__lost_b")


def holes_of(blind: DataFrame, keys: list[str], bin_us: int) -> DataFrame:
    """Blind intervals cut at the edges of bins."""
    lo, hi = F.col("__bin") * bin_us, (F.col("__bin") + 1) * bin_us
    return binned(blind.select(*keys, "a_us", "b_us"), bin_us).select(*keys, "__bin", F.greatest("a_us", lo).alias("a_us"), F.least("b_us", hi).alias("b_us"))


def subtract(rows: DataFrame, blind: DataFrame, keys: list[str], bin_us: int = DAY) -> DataFrame:
    """The parts of each row's interval outside merged blind intervals of the key; other columns are repeated.

    Both sides meet in bins, so a key with many rows is spread over its bins. A row is cut at its bins first and its
    parts there are cut at blind intervals; parts that touch at a bin's edge belong together (merge() joins them).
    A sweep tells in which gaps between blind intervals a part lies, and it meets these by number.
    """
    others = [c for c in rows.columns if c not in ("a_us", "b_us", *keys)]
    cut = binned(rows.where("b_us > a_us"), bin_us)
    cut = cut.select(*keys, "__bin", F.greatest("a_us", F.col("__bin") * bin_us).alias("__a"), F.least("b_us", (F.col("__bin") + 1) * bin_us).alias("__b"), *others)
    holes = holes_of(blind, keys, bin_us)
    number = F.row_number().over(Window.partitionBy(*keys, "__bin").orderBy("a_us"))
    ends = F.array(F.struct((number - 1).alias("g"), F.lit(None).cast("long").alias("lo"), F.col("a_us").alias("hi")), F.struct(number.alias("g"), F.col("b_us").alias("lo"), F.lit(None).cast("long").alias("hi")))
    gaps = holes.select(*keys, "__bin", ends.alias("__e")).select(*keys, "__bin", F.explode("__e").alias("__e"))
    gaps = gaps.groupBy(*keys, "__bin", F.col("__e.g").cast("long").alias("__gap")).agg(F.max("__e.lo").alias("__lo"), F.max("__e.hi").alias("__hi"))
    each = swept(cut, holes, keys).withColumn("__gap", F.explode(F.sequence("__begun_a", "__begun_b"))).join(gaps, [*keys, "__bin", "__gap"], "left")
    parts = each.withColumn("a_us", F.greatest("__a", "__lo")).withColumn("b_us", F.least("__b", "__hi")).where("b_us > a_us")
    return parts.select(*[c for c in rows.columns if c not in ("a_us", "b_us")], "a_us", "b_us")


def observed(rows: DataFrame, blind: DataFrame, keys: list[str], bin_us: int = DAY) -> DataFrame:
    """One row for each bin that a row's interval meets, one at least: ``seen_us`` is its time there outside merged blind
    intervals of the key, and ``once`` is true for one of a row's bins."""
    first, last = F.floor(F.col("a_us") / bin_us), F.floor(F.greatest("a_us", F.col("b_us") - 1) / bin_us)
    cut = rows.withColumn("__bin", F.explode(F.sequence(first, last))).withColumn("once", F.col("__bin") == first)
    cut = cut.withColumn("__a", F.greatest("a_us", F.col("__bin") * bin_us)).withColumn("__b", F.least("b_us", (F.col("__bin") + 1) * bin_us))
    seen = F.when(F.col("__b") > F.col("__a"), F.col("__b") - F.col("__a") - (F.col("__lost_b") - F.col("__lost_a"))).otherwise(F.lit(0))
    return swept(cut, holes_of(blind, keys, bin_us), keys).withColumn("seen_us", seen).select(*rows.columns, "once", "seen_us")


def overlap_us(rows: DataFrame, blind: DataFrame, keys: list[str], ids: list[str], bin_us: int = DAY) -> DataFrame:
    """(ids, overlap_us): time of each row's interval inside merged blind intervals."""
    left = binned(rows.where("b_us > a_us").select(*dict.fromkeys([*keys, *ids]), "a_us", "b_us"), bin_us)
    right = binned(blind, bin_us).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("a_us").alias("c_us"), F.col("b_us").alias("d_us"), F.col("__bin").alias("____bin"))
    lo = F.greatest("a_us", "c_us", F.col("__bin") * bin_us)
    hi = F.least("b_us", "d_us", (F.col("__bin") + 1) * bin_us)
    met = left.join(right, _equal(left, right, keys) & (left["__bin"] == right["____bin"]) & (left["a_us"] < right["d_us"]) & (right["c_us"] < left["b_us"]))
    return met.groupBy(*ids).agg(F.sum(F.greatest(hi - lo, F.lit(0))).alias("overlap_us"))


def offline(events: DataFrame, t0: int, t1: int, keys: tuple[str, ...] = ("camera_id",)) -> DataFrame:
    """Outages from CAMERA_OFFLINE until the next ONLINE or RECOVERED, clipped; one that is still open lasts until t1."""
    marks = events.where(F.col("event_type").isin("CAMERA_OFFLINE", "CAMERA_ONLINE", "CAMERA_RECOVERED"))
    marks = marks.select(*keys, "ts_us", "seq", (F.col("event_type") == "CAMERA_OFFLINE").alias("__down"))
    flips = previous(marks, list(keys), "__down", "__before").where(F.coalesce(F.col("__down") != F.col("__before"), F.col("__down")))
    spans = hold_forward(flips, list(keys), into="b_us").where("__down")
    return clip(spans.select(*keys, F.col("ts_us").alias("a_us"), F.coalesce("b_us", F.lit(t1)).alias("b_us")), t0, t1)
