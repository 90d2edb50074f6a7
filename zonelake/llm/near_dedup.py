"""MinHash near-deduplication with an LSH forest of sorted signature orders.

A document's signature has TREES * DEPTH MinHash values; each tree sorts all documents by its own DEPTH of them. In such
an order the neighbours of a document are those with the longest common prefix. Documents that share FIRST values in a
tree are a region of it; two documents with a similarity of 0.8 share no region at all with a probability of
(1 - 0.8^FIRST)^TREES, 3e-6. A region with over REGION members is split by further values, as deep as it takes (its
leaves). Documents with equal shingle sets are one representative.

Candidates are confirmed in rounds, exactly, on full shingle sets. The links of each round tie documents into components,
and a pair inside of one can't change the result any more. The first round takes each document's neighbour with the
longest common prefix in any tree; the next ones a few pivots, the smallest members of its leaves and regions, while these lie
in other components. The last one takes what is left: in each region all pairs across components, so no region, however crowded, loses
a link: in small ones a sketch of two bits a MinHash value spares pairs far below 0.8 the exact check, and 3e-6 of those at
0.8; in all others, documents outside the region's main component meet all of the region in bounded blocks.

Defined results: null or empty texts have no shingles and are linked with nothing; a null id is linked with nothing,
has no component and is kept; rows that share an id are one document, linked where any of their texts are, and each
row has its own number of shingles; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelake.llm import shingle_sets
from zonelake.llm.common import Shelf, text_of
from zonelake.llm.components import components, merged

TREES, FIRST, DEPTH, REGION = 24, 4, 8, 64
VALUES, MORE = TREES * DEPTH, DEPTH - FIRST
#: Two documents differ in about (1 - similarity) * VALUES bits of their sketches; MOST lies 4.5 standard deviations over
#: what a similarity of 0.8 gives.
MOST = int(VALUES * (0.2 + 4.5 * (0.26 / VALUES) ** 0.5))
#: Rounds with pivots, how many a document tries in one of them, and the share of links without which no further one follows.
PIVOT_ROUNDS, PIVOTS, SUCCESS = 3, 3, 0.05
#: In the last round, members of a region whose pairs are written out; members of a block, and bytes of their shingles.
SMALL, BLOCK, BLOCK_BYTES = 32, 256, 16_000_000
#: Bytes of shingle sets on each side of a tile of pairs, and tiles a side at least.
TILE_BYTES, TILES = 16_000_000, 6
#: Ids up to which those that need a check are broadcast (16 bytes each); beyond, texts are shuffled.
BROADCAST_IDS = 500_000


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(9)
    return draw.integers(0, 2**31, n, dtype=np.uint32) * 2 + 1, draw.integers(0, 2**32, n, dtype=np.uint32)


def rows_of_bytes(values: np.ndarray) -> pa.Array:
    """A matrix as one binary value a row."""
    values = np.ascontiguousarray(values)
    width = values.shape[1] * values.itemsize
    offsets = np.arange(0, (len(values) + 1) * width, width or 1, dtype=np.int32)[: len(values) + 1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def bytes_of_rows(column: pa.Array, kind: type) -> np.ndarray:
    """The inverse of rows_of_bytes, for values of the same size in all rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def unpacked(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in some binary values, and how many each of these has."""
    flat = np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()] or [np.empty(0, kind)])
    return flat, pc.binary_length(column).to_numpy().astype(np.int64) // np.dtype(kind).itemsize


def sketch_bits(values: np.ndarray) -> np.ndarray:
    """Two bits of each MinHash value that depend on all bits of it, packed."""
    mixed = values * np.uint32(0x9E3779B1)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return np.packbits(np.concatenate([mixed >> np.uint32(31), mixed >> np.uint32(30) & np.uint32(1)], axis=1).astype(np.uint8), axis=1)


SIGNED = "v long, n long, f long, g long, signature binary, sketch binary"


def signatures(texts: DataFrame, size: int) -> DataFrame:
    """(v, n, f, g, signature, sketch) of each row (v, text): the number of shingles, two hashes that only equal sets share,
    and the MinHash values with their sketch as bytes, null for rows without shingles or id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, shift = multipliers(VALUES)
        for batch in batches:
            for at, end in shingle_sets.slices(batch.column(1)):
                v = batch.column(0).slice(at, end - at)
                found = shingle_sets.sets(batch.column(1).slice(at, end - at), size)
                n = np.array([len(x) for x in found], np.int64)
                starts = np.cumsum(n) - n
                flat = np.concatenate(found)
                some = n > 0
                set_hash = np.zeros((2, len(n)), np.uint64)
                out = np.zeros((len(n), VALUES), np.uint32)
                if len(flat):
                    for k in (0, 1):
                        set_hash[k, some] = np.add.reduceat(shingle_sets.mixed(flat + np.uint64(k)), starts[some])
                    half = (flat >> np.uint64(32)).astype(np.uint32)
                    for k in range(VALUES):
                        out[some, k] = np.minimum.reduceat(half * factor[k] + shift[k], starts[some])
                use = pa.array(some & ~np.asarray(v.is_null()))
                made = [pc.if_else(use, rows_of_bytes(x), pa.scalar(None, pa.binary())) for x in (out, sketch_bits(out))]
                yield pa.RecordBatch.from_arrays([v, pa.array(n), *(pa.array(x.view(np.int64)) for x in set_hash), *made], [x.split()[0] for x in SIGNED.split(", ")])

    return texts.mapInArrow(run, SIGNED)


def kept_sets(texts: DataFrame, ids: DataFrame, most: int, size: int, shelf: Shelf, short: bool = False) -> DataFrame:
    """(v, n, set) for rows with one of the ids (v), of which there are at most so many; a set is 64-bit hashes in ascending order, or 32 bits of each, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in shingle_sets.slices(batch.column(1)):
                found = shingle_sets.sets(batch.column(1).slice(at, end - at), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array([len(x) for x in found], pa.int64()), pa.array([((x >> np.uint64(32)).astype(np.uint32) if short else x).tobytes() for x in found], pa.binary())], ["v", "n", "set"])

    few = texts.join(F.broadcast(ids) if most <= BROADCAST_IDS else ids, "v", "left_semi")
    return shelf.keep(few.select("v", "text").mapInArrow(run, "v long, n long, set binary"))


MEMBER = "region long, deeper binary, leaf_depth int, v long, n long, near long, near_n long, prefix int"


def neighbours(rows: pa.Table, head: bool, tail: bool) -> pa.RecordBatch:
    """Rows of MEMBER for sorted rows (region, deeper, v, n) but the first if head, and the last if tail, is false.

    Rows that share their region with none of these rows are left out, unless they are the first or last at all, which
    may share it with rows of another task.
    """
    region, v, n = (rows.column(c).to_numpy() for c in ("region", "v", "n"))
    deeper = bytes_of_rows(rows.column("deeper").combine_chunks(), np.uint32)
    size = len(v)
    # Values that a row shares with the one before: none, or FIRST and as many as are equal in a row.
    shared = np.zeros(size + 1, np.int32)
    equal = np.cumprod(deeper[1:] == deeper[:-1], axis=1).sum(axis=1) if size > 1 else np.zeros(0, np.int64)
    shared[1:size] = np.where(region[1:] == region[:-1], FIRST + equal, 0)
    leaf = np.full(size, DEPTH, np.int32)
    for depth in range(DEPTH - 1, FIRST - 1, -1):
        begins = np.flatnonzero(shared[:size] < depth)
        length = np.diff(np.r_[begins, size])
        leaf[np.repeat(length, length) <= REGION] = depth
    before, after = shared[:size], shared[1:]
    prefix = np.maximum(before, after)
    at = np.clip(np.arange(size) + np.where(before >= after, -1, 1), 0, size - 1)
    keep = prefix >= FIRST
    keep[0] |= head
    keep[-1] |= tail
    inner = np.ones(size, bool)
    inner[0], inner[-1] = (head, tail) if size > 1 else (head or tail,) * 2
    keep &= inner
    missing = prefix[keep] < FIRST
    columns = [pa.array(region[keep]), rows.column("deeper").combine_chunks().filter(pa.array(keep)), pa.array(leaf[keep]), pa.array(v[keep]), pa.array(n[keep]), pa.array(v[at][keep], mask=missing), pa.array(n[at][keep], mask=missing), pa.array(prefix[keep])]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in MEMBER.split(", ")])


def forest(reps: DataFrame) -> DataFrame:
    """(region, leaf, v, n, near, near_n, prefix) from the sorted orders of all trees: every member of a region with two
    or more, its nearest neighbour in that order (null where another task has it) and how many values they share."""
    whole, first, more = 4 * DEPTH, 4 * FIRST, 4 * MORE
    cut = lambda t, start, length: F.substring("signature", t * whole + start + 1, F.lit(length))
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(F.xxhash64(t, cut(t, 0, first)).alias("region"), cut(t, first, more).alias("deeper")))
    rows = reps.select("v", "n", F.explode(trees).alias("t")).select("t.region", "t.deeper", "v", "n")
    order = ["region", "deeper", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last two rows of a batch go before the next one: the last has its neighbours only there.
        held, head = None, True
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            if table.num_rows < 3:
                held = table
                continue
            yield neighbours(table, head, False)
            held, head = table.slice(table.num_rows - 2), False
        if held is not None and held.num_rows:
            yield neighbours(held, head, True)

    found = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MEMBER)
    leaf = F.xxhash64("region", "leaf_depth", F.substring("deeper", F.lit(1), (F.col("leaf_depth") - FIRST) * 4))
    return found.select("region", leaf.alias("leaf"), "v", "n", "near", "near_n", "prefix")


def similar_size(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * 80


def similar(a: np.ndarray, b: np.ndarray, ids: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether any set of a and any of b are similar, pair by pair. Sets are slices of flat, by ids in ascending order."""
    token = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(len(flat) + 1, bool)
    ends = np.cumsum(lengths)
    span = lambda i: slice(ends[i] - lengths[i], ends[i])
    order = np.argsort(a, kind="stable")
    linked = np.zeros(len(a), bool)
    for group in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(a) else []:
        lo, hi = np.searchsorted(ids, b[group], "left"), np.searchsorted(ids, b[group], "right")
        of = np.repeat(group, hi - lo)
        other = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True)])
        for i in range(np.searchsorted(ids, a[group[0]], "left"), np.searchsorted(ids, a[group[0]], "right")):
            mark[token[span(i)]] = True
            same = np.array([np.count_nonzero(mark[token[span(j)]]) for j in other], np.int64)
            mark[token[span(i)]] = False
            linked[of[100 * same >= 80 * (lengths[i] + lengths[other] - same)]] = True
    return linked


def confirmed(pairs: DataFrame, count: int, texts: DataFrame, size: int, shelf: Shelf) -> DataFrame:
    """Of so many kept distinct pairs (a, b) those with 100 * intersection >= 80 * union; texts has (v, text).

    Pairs are dealt into tiles by the hash of either side, so that a set is sent once to each tile that needs it, and a tile's
    sets have a bounded size.
    """
    own = Shelf(shelf.spark)
    needed = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    few = kept_sets(texts, needed, 2 * count, size, own)
    total = few.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sides = max(TILES, -(-total * 8 // TILE_BYTES))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(sides))
    dealt = pairs.select((part("a") * sides + part("b")).alias("tile"), "a", "b")
    places = dealt.select("tile", F.col("a").alias("v")).union(dealt.select("tile", "b")).distinct()
    sets = places.join(few.select("v", "set"), "v").select(F.col("tile").alias("place"), "v", "set")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("v")
        flat, lengths = unpacked(right.column("set"), np.uint64)
        a, b = (left.column(c).to_numpy() for c in ("a", "b"))
        linked = similar(a, b, right.column("v").to_numpy(), flat, lengths)
        return pa.table({"a": a[linked], "b": b[linked]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    found = shelf.keep(dealt.groupBy("tile").cogroup(sets.groupBy("place")).applyInArrow(check, "a long, b long"))
    own.clear()
    return found


class Ties:
    """Pairs tried so far, links among them and the components these give."""

    def __init__(self, texts: DataFrame, size: int, shelf: Shelf, first: DataFrame) -> None:
        self.texts, self.size, self.shelf, self.tried = texts, size, shelf, None
        self.labels = None if first.isEmpty() else components(first)

    def of(self, rows: DataFrame, name: str, to: str) -> DataFrame:
        if self.labels is None:
            return rows.withColumn(to, F.col(name))
        found = self.labels.select(F.col("v").alias(name), F.col("component").alias("__component"))
        return rows.join(found, name, "left").withColumn(to, F.coalesce("__component", name)).drop("__component")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, ...) that lie in different components and weren't tried yet."""
        rows = self.of(self.of(pairs, "a", "__a"), "b", "__b").where("__a <> __b").drop("__a", "__b")
        return rows if self.tried is None else rows.join(self.tried, ["a", "b"], "left_anti")

    def check(self, pairs: DataFrame) -> bool:
        """Confirms pairs and merges what they tie; whether SUCCESS of them were links."""
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        pairs = self.shelf.keep(ordered if self.tried is None else ordered.join(self.tried, ["a", "b"], "left_anti"))
        count = pairs.count()
        if not count:
            return False
        found = confirmed(pairs, count, self.texts, self.size, self.shelf)
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        links = found.count()
        if links:
            self.labels = self.shelf.keep(merged(self.labels, found))
        return links >= SUCCESS * count


def pivots(members: DataFrame) -> DataFrame:
    """(a, b, weight): the smallest members a of the leaves and regions of a document b, once each."""
    found = None
    for by in ("leaf", "region"):
        first = members.groupBy(by).agg(F.min(F.struct("v", "n")).alias("first"), F.count("*").alias("weight")).where("weight > 1")
        rows = members.join(first, by).select(F.col("first.v").alias("a"), F.col("v").alias("b"), F.when(similar_size(F.col("n"), F.col("first.n")), F.col("weight")).alias("weight"))
        found = rows if found is None else found.union(rows)
    return found.where("a <> b and weight is not null").groupBy("a", "b").agg(F.max("weight").alias("weight"))


def tie(members: DataFrame, sketches: DataFrame, ties: Ties) -> DataFrame:
    """(v, component) of all documents with a link."""
    near = members.where(F.col("near").isNotNull() & similar_size(F.col("n"), F.col("near_n")))
    best = near.groupBy("v").agg(F.max(F.struct("prefix", (-F.col("near")).alias("minus"))).alias("best"))
    ties.check(best.select((-F.col("best.minus")).alias("a"), F.col("v").alias("b")))
    around = ties.shelf.keep(ties.apart(pivots(members)))
    for _ in range(PIVOT_ROUNDS):
        tries = ties.apart(around).groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("weight", (-F.col("a")).alias("minus"))), False), 1, PIVOTS).alias("best"))
        if not ties.check(tries.select(F.explode("best").alias("x"), "b").select((-F.col("x.minus")).alias("a"), "b")):
            break
    left = ties.of(members.select("region", "v", "n"), "v", "component")
    parts = left.groupBy("region", "component").agg(F.count("*").alias("c"), F.sum("n").alias("total"))
    shapes = parts.groupBy("region").agg(F.sum("c").alias("size"), F.sum("total").alias("total"), F.max(F.struct("c", "component")).alias("main")).where("main.c < size")
    shapes = shapes.select("region", "size", "total", F.col("main.component").alias("main"), (F.col("size") - F.col("main.c")).alias("others"))
    rows = ties.shelf.keep(left.join(shapes, "region").withColumn("outside", F.col("component") != F.col("main")))
    few = ties.apart(inside(rows.where(F.col("size") <= SMALL), sketches))
    ties.check(few.union(across(rows.where(F.col("size") > SMALL), ties.texts, ties.size, ties.shelf)))
    return ties.labels if ties.labels is not None else members.select("v", F.col("v").alias("component")).limit(0)


def inside(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): pairs in different components of a small region whose sketches and sizes allow a similarity of 0.8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            regions = table.column("region").to_numpy()
            whole = int(np.searchsorted(regions, regions[-1], "left")) if len(regions) else 0
            yield allowed(table.slice(0, whole))
            held = table.slice(whole)
        if held is not None:
            yield allowed(held)

    dealt = rows.select("region", "v", "n", "component").join(sketches, "v").select("region", "v", "n", "component", "sketch")
    return dealt.repartition("region").sortWithinPartitions("region").mapInArrow(run, "a long, b long").distinct()


def across(rows: DataFrame, texts: DataFrame, size: int, shelf: Shelf) -> DataFrame:
    """(a, b): links between what lies outside the main component of a crowded region and all of the region, one for each
    document and component at least.

    Both are cut into blocks, and each block of these meets each of those with its shingles, shortened to 32 bits. Pairs
    aren't written out: only those that pass the test on these, which equal hashes can't make fail, go on to the exact one.
    """
    ids = shelf.keep(rows.select("v").distinct())
    count = ids.count()
    if not count:
        return ids.select(F.col("v").alias("a"), F.col("v").alias("b"))
    tokens = kept_sets(texts, ids, count, size, shelf, short=True)
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.ceil(F.col("total") * F.col(c) / F.col("size") * 4 / BLOCK_BYTES)).cast("int")
    tile = lambda i, j: F.xxhash64("region", i, j)
    of = lambda count, salt: F.pmod(F.xxhash64("v", F.lit(salt)), count).cast("int")
    upto = lambda count: F.sequence(F.lit(0), count - 1)
    right = rows.withColumn("tile", F.explode(F.transform(upto(blocks("others")), lambda i: tile(i, of(blocks("size"), 1)))))
    left = rows.where("outside").withColumn("tile", F.explode(F.transform(upto(blocks("size")), lambda j: tile(of(blocks("others"), 2), j))))
    both = right.withColumn("outside", F.lit(False)).union(left).select("tile", "v", "component", "outside")
    return both.join(tokens, "v").select("tile", "v", "n", "component", "outside", "set").groupBy("tile").applyInArrow(linked_across, "a long, b long")


def linked_across(tile: pa.Table) -> pa.Table:
    """Links between rows outside and the other rows of a tile, the first for each row and component."""
    v, n, component, outside = (tile.column(c).to_numpy() for c in ("v", "n", "component", "outside"))
    flat, lengths = unpacked(tile.column("set"), np.uint32)
    count = len(v)
    token = np.unique(flat, return_inverse=True)[1]
    key = np.unique(token.astype(np.int64) * count + np.repeat(np.arange(count), lengths))
    token, row = key // count, key % count
    lost = n - np.bincount(row, minlength=count)
    often = np.bincount(token) > 1
    place = np.cumsum(often) - 1
    use = often[token]
    token, row = place[token[use]], row[use]
    left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
    shared = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(token, [start, start + 4096])
        held = np.zeros((count, 4096), np.float32)
        held[row[lo:hi], token[lo:hi] - start] = 1
        shared += held[left] @ held[right].T
    shared = shared.astype(np.int64) + np.maximum(lost[left][:, None], lost[right][None])
    linked = (component[left][:, None] != component[right][None]) & (100 * shared >= 80 * (n[left][:, None] + n[right][None] - shared))
    x, y = np.nonzero(linked)
    _, first = np.unique(np.stack([x, component[right[y]]]), axis=1, return_index=True)
    return pa.table({"a": v[left[x[first]]], "b": v[right[y[first]]]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def allowed(rows: pa.Table) -> pa.RecordBatch:
    """Pairs of rows of the same region that may be similar; compared at each distance at once."""
    region, v, n, component = (rows.column(c).to_numpy() for c in ("region", "v", "n", "component"))
    sketch = bytes_of_rows(rows.column("sketch").combine_chunks(), np.uint64) if len(v) else None
    found: list[np.ndarray] = []
    at, step = np.arange(len(v) - 1), 1
    while len(at):
        at = at[at + step < len(v)]
        at = at[region[at] == region[at + step]]
        x, y = at, at + step
        fits = (component[x] != component[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * 80)
        x, y = x[fits], y[fits]
        for k in range(0, len(x), 65536):
            p, q = x[k : k + 65536], y[k : k + 65536]
            near = np.bitwise_count(sketch[p] ^ sketch[q]).sum(axis=1, dtype=np.int64) <= MOST
            found.append(np.stack([np.minimum(v[p], v[q])[near], np.maximum(v[p], v[q])[near]]))
        step += 1
    both = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    both = np.unique(both, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def cluster(docs: DataFrame, size: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: size of its shingle set, the smallest id of its component, and whether it is that one."""
    shelf = Shelf(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("v"), text_of(text_col).alias("text"))
    every = shelf.keep(signatures(texts, size))
    signed = every.where("signature is not null")
    groups = signed.groupBy("f", "g", "n").agg(F.min("v").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    joined = shelf.keep(signed.select("v", "n", "f", "g").join(groups, ["f", "g", "n"], "left").select("v", "n", "f", "g", F.coalesce("rep", "v").alias("rep")))
    # Ids that are copies of others, or come more than once; their texts' representatives are tied, and each is taken once.
    ids = joined.groupBy("v").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("c"))
    marked = shelf.keep(ids.where("c > 1 or lo <> v"))
    first = joined.join(marked.where("lo <> hi").select("v"), "v", "left_semi").select(F.col("rep").alias("a"), F.col("v").alias("b"))
    again = joined.where("v = rep").join(marked.where("c > 1").select("v"), "v", "left_semi").select("v", "f", "g").distinct()
    plain = signed.join(marked.select("v"), "v", "left_anti").select("v", "n", "signature")
    reps = plain.union(signed.join(again, ["v", "f", "g"], "left_semi").dropDuplicates(["v", "f", "g"]).select("v", "n", "signature"))

    members = shelf.keep(forest(reps))
    labels = tie(members, signed.select("v", "sketch").distinct(), Ties(texts, size, shelf, first))
    final = labels.where("v <> component").withColumnRenamed("v", "rep")
    decided = joined.join(final, "rep", "left").select("v", "n", F.coalesce("component", "rep").alias("component_id"))
    bare = every.where("signature is null").select("v", "n", F.col("v").alias("component_id"))
    both = shelf.last(decided.union(bare))
    return both.select(F.col("v").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("v") == F.col("component_id"), F.lit(True)).alias("kept"))
