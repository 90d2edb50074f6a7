"""Benchmark decontamination: size-partitioned MinHash containment search for short items in long documents.

Items are partitioned by the size of their set of five-word shingles (powers of two). An item's sketch holds its m
smallest shingles in hash order, a bottom-m MinHash; m follows from the largest size u of the partition: m = u - t + 1
with t the least number of shingles that 0.8 of u asks for. A document that contains 0.8 of an item misses fewer
than m of its shingles, so it must hold one of the sketch: the search loses nothing. A document is a candidate if it
has a hit, misses no more of the sketch than the item may miss at all, and is large enough for the item. Candidates are
verified by exact shingle containment. Items go to the executors in blocks with a bounded number of shingles, and each
document is searched in the task that reads it, so documents aren't shuffled, however many share a passage.

Defined results: null or empty texts and items or texts under five words contain nothing and are contained nowhere;
rows that share an id are searched one by one; items that share an id are separate sets; an empty table on either
side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelake.llm.common import shingles, text_of, words_of

SIZE = 5
#: Shingles of items broadcast at a time: 8 bytes each.
BLOCK = 1_000_000
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long"


def least(q: int) -> int:
    """Shingles that 0.8 of q asks for."""
    return -(-q * 80 // 100)


class Sketches:
    """One block of items, searched with the shingles of one document at a time."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.items = items
        partitions = defaultdict(list)
        for k, (_, s) in enumerate(items):
            partitions[len(s).bit_length()].append(k)
        self.m, owners = np.zeros(len(items), np.int64), defaultdict(list)
        for members in partitions.values():
            u = max(len(items[k][1]) for k in members)
            for k in members:
                sketch = np.sort(items[k][1])[: u - least(u) + 1]
                self.m[k] = len(sketch)
                for h in sketch:
                    owners[int(h)].append(k)
        self.hashes = np.array(sorted(owners), np.int64)
        self.owners = [np.array(owners[int(h)]) for h in self.hashes]

    def hits(self, flat: np.ndarray) -> np.ndarray:
        """For each shingle the place of its hash among the sketches', or -1."""
        if not len(self.hashes):
            return np.full(len(flat), -1)
        at = np.minimum(np.searchsorted(self.hashes, flat), len(self.hashes) - 1)
        return np.where(self.hashes[at] == flat, at, -1)

    def search(self, own: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item_id, its shingles, how many the document has) of every item that it contains."""
        count = np.bincount(np.concatenate([self.owners[i] for i in hit]), minlength=len(self.items))
        for k in np.flatnonzero(count):
            item_id, s = self.items[k]
            q = len(s)
            if len(own) >= least(q) and self.m[k] - count[k] <= q - least(q):
                shared = int(np.isin(s, own).sum())
                if 100 * shared >= 80 * q:
                    yield item_id, q, shared


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list:
    """Broadcasts of at most about BLOCK shingles each; the number of blocks follows from a count."""
    sets = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("id"), words_of(text_of(text_col)).alias("w"), shingles(text_of(text_col), SIZE).alias("s")).where(F.size("w") >= SIZE).drop("w")
    total = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    n = -(-total // BLOCK)
    out = []
    for k in range(n):
        rows = (sets if n == 1 else sets.where(F.pmod(F.xxhash64("s"), F.lit(n)) == k)).toLocalIterator()
        out.append(benchmark.sparkSession.sparkContext.broadcast([(r.id, np.array(r.s, np.int64)) for r in rows]))
    return out


def with_shingles(docs: DataFrame, text_col: str, *columns) -> DataFrame:
    text = text_of(text_col)
    return docs.select(*columns, shingles(text, SIZE).alias("__shingles"))


def found_in(lists: pa.ListArray, sketches: Sketches) -> Iterator[tuple[int, tuple[int, int, int]]]:
    """(row, item) for every document of the batch and item that it contains."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    hits = sketches.hits(flat)
    at = np.flatnonzero(hits >= 0)
    rows = np.searchsorted(ends, at, side="right")
    found, first = np.unique(rows, return_index=True)
    for row, hit in zip(found, np.split(hits[at], first[1:]), strict=True) if len(found) else ():
        own = flat[ends[row - 1] if row else 0 : ends[row]]
        for item in sketches.search(own, hit):
            yield int(row), item


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item with 0.8 or more of the item's shingles in the document."""
    searched = with_shingles(docs, text_col, F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for shared in blocks(benchmark, item_id_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(shared.value)
            for batch in batches:
                ids = batch.column(0)
                rows = [(ids[row].as_py(), *item) for row, item in found_in(batch.column(1), sketches)]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])

        out = out.union(searched.mapInArrow(run, SCHEMA))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that contain no item."""
    out = docs
    for shared in blocks(benchmark, item_id_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in found_in(batch.column(batch.num_columns - 1), sketches)]] = False
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))

        out = with_shingles(out, text_col, *[F.col(f"`{c}`") for c in docs.columns]).mapInArrow(run, docs.schema)
    return out
