"""LM scoring with a probabilistic suffix tree that spells words, beside a unigram base over words.

A text is its words, A-Z lower-cased, each spelled by its characters and a space, and then an end mark. The ALPHABET most
frequent characters are symbols of their own; others share one symbol and then cost a uniform choice among all code
points. Contexts have up to DEPTH symbols of the word so far, led by marks of the word's start. The tree considers
contexts that make up at least P_MIN of all positions, of which there can't be more than 1 / P_MIN at each depth, and
keeps one if its next-symbol distribution diverges from that of its parent (the context without its first symbol):
count * KL(context || parent) in nats over DIVERGENCE. Next-symbol distributions are smoothed by SMOOTHING
pseudo-counts spread like the distribution of the parent, the root's by a uniform one. Spelling uses the longest kept suffix
of what precedes a symbol. A token's probability mixes its share of the training tokens with its spelling; the
spelling's weight is the share of tokens that occur once in training, which estimates how much of a new text was never
seen.

Contexts also run across words: before any word, the word before it (or the text's start) is a context. Its
branch to that word is kept if it was seen at least twice in training and diverges from the word's share:
count * ln(P(word | context) / P(word)) over WORD_DIVERGENCE. A kept branch has the share (count - DISCOUNT) / count of the context;
what a context's kept branches leave goes to all tokens by their own probability, so a context without any changes nothing. These
branches grow with the corpus, and passages that the corpus repeats score far higher than the same words in another order. The
score is the log10 of a probability: after any context those of all next tokens add up to one, as far as spellings do.

Counting covers all training rows: word counts are summed in each task, then by key; (DEPTH + 1)-grams and pairs of words are
dealt into buckets and summed there as arrays. A word is known by a 64-bit hash. Words that make up at least FREQUENT of all
tokens, at most 1 / FREQUENT of them, are broadcast, and so are branches that make up as much. A token's log10 probability is a sum
of what the word costs alone, what the branches of the word before leave, and what a branch between the two adds, so documents ask
for each of these apart: for rarer words by hash, and for other branches by the pair, where a bitmap of fixed size tells most pairs
without a branch. What they ask is packed by block of documents and bucket of keys, as sorted steps between keys and places of
documents. It meets the words and branches of the bucket, which are packed as well, and goes back as sums by document. No occurrence
is a row, and a word with many contexts builds no array of its own.

Defined results: null or empty text is the end mark alone; without training rows counts are 0 and next symbols uniform;
repeated rows get equal scores; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelake.llm.common import Shelf, crc_mod, text_of

DEPTH, BITS = 4, 6
SYMBOLS = 1 << BITS
END, OTHER = 0, 1
ALPHABET = SYMBOLS - 2
P_MIN, DIVERGENCE, SMOOTHING = 3e-5, 20.0, 4.0
#: Words from this share of all tokens on have no branches: none has more than all.
HEAD = float("inf")
FREQUENT = 1e-6
#: Bits of the bitmap of branches; tokens a bucket of pairs is for; tokens that a task gathers before it packs their pairs.
BITMAP, BUCKET, GATHERED = 27, 500_000, 2_000_000
#: Tokens that a bucket of what documents ask is for.
ASKED_BUCKET = 4_000_000
WORD_DIVERGENCE, DISCOUNT = 8.0, 0.75
CODE_POINTS = 0x110000
SLICE = 200
#: Marks the end token among the words' hashes; a word's hash equals it with a probability of 2^-64.
END_HASH = 0
#: Stands before the first word of a text.
START_HASH = 1


class Tally:
    """Counts of integers, merged whenever many have gathered."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys.astype(np.int64, copy=False))
        self.counts.append(counts.astype(np.int64, copy=False))
        self.held += len(keys)
        if self.held > 1_000_000 and len(self.keys) > 1:
            self.keys, self.counts = map(lambda x: [x], self.merged())
            self.held = len(self.keys[0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, np.concatenate(self.counts))
        return keys, counts

    def batches(self, kind: int) -> Iterator[pa.RecordBatch]:
        keys, counts = self.merged()
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part), pa.array(counts[at : at + 50_000])], ["kind", "key", "n"])


def prepared(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """(doc_id, held_out, text): what all passes read of a document."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out.alias("held_out"), text_of(text_col).alias("text"))


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes and their number in each text; the code points of lower-cased words, each with a space behind it, and theirs."""
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int64)
    points = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    space = (points == 32) | (points - np.uint32(9) <= 4)
    inner = ~space
    end = space.copy()
    end[0] = False
    end[1:] &= inner[:-1]
    behind = np.searchsorted(np.flatnonzero(end), np.cumsum([len(t) + 1 for t in texts]))
    kept = points[inner | end]
    kept[kept - np.uint32(65) < 26] += 32
    ends = np.flatnonzero(end[inner | end])
    kept[ends] = 32
    if not len(ends):
        return np.empty(0, np.int64), behind, kept, np.zeros(len(texts), np.int64)
    starts = np.r_[0, ends[:-1] + 1]
    # A code point and its place in the word, mixed; the sum over a word is mixed once more.
    mixed = (np.arange(len(kept)) - np.repeat(starts, ends - starts + 1)).astype(np.uint64)
    mixed <<= np.uint64(21)
    mixed |= kept
    hashes = mix(np.add.reduceat(mix(mixed), starts)).view(np.int64)
    return hashes, np.diff(behind, prepend=0), kept, np.diff(np.r_[0, ends + 1][behind], prepend=0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    x += np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of some texts, and the length of each."""
    parts = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), np.array([len(p) for p in parts], np.int64)


def grams(points: np.ndarray, lengths: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (DEPTH + 1)-gram that ends at each symbol, end marks included, and where tokens begin.

    Symbols before a token's first are END in its contexts, so what a token costs depends on the token alone.
    """
    sizes = lengths + 1
    ends = np.cumsum(sizes) - 1
    stream = np.full(int(sizes.sum()), END, np.int32)
    inner = np.ones(len(stream), bool)
    inner[ends] = False
    stream[inner] = symbol[points]
    last = ~inner
    last[inner] = points == 32
    starts = np.flatnonzero(np.r_[True, last[:-1]]) if len(stream) else np.empty(0, np.int64)
    offset = np.arange(len(stream)) - np.repeat(starts, np.diff(np.r_[starts, len(stream)]))
    key = stream.copy()
    for d in range(1, DEPTH + 1):
        before = np.zeros_like(stream)
        before[d:] = stream[:-d]
        key |= np.where(offset >= d, before, np.int32(END)) << np.int32(BITS * d)
    return key, starts


def count_words(rows: DataFrame) -> DataFrame:
    """(kind, key, n): kind 0 counts characters, kind 1 tokens by hash, of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, words = Tally(), Tally()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                flat, _, points, _ = split(part.column(0).to_pylist())
                found = np.bincount(points, minlength=1)
                seen = np.flatnonzero(found)
                chars.add(seen, found[seen])
                words.add(flat)
                words.add(np.array([END_HASH]), np.array([part.num_rows]))
        yield from chars.batches(0)
        yield from words.batches(1)

    counted = rows.select("text").mapInArrow(run, "kind byte, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def find(keys: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is among sorted keys, and whether it is."""
    if not len(keys):
        return np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
    place = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
    return place, keys[place] == flat


def before(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The word before each word of some documents."""
    prev = np.empty_like(flat)
    prev[1:] = flat[:-1]
    starts = np.cumsum(lengths) - lengths
    prev[starts[lengths > 0]] = START_HASH
    return prev


def pair_of(word, prev):
    """One number for two words' hashes, as arrays or columns."""
    if isinstance(word, Column):
        return word.bitwiseXOR(F.shiftleft(prev, 21).bitwiseOR(F.shiftrightunsigned(prev, 43)))
    before = prev.view(np.uint64)
    return word ^ (before << np.uint64(21) | before >> np.uint64(43)).view(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Numbers of 8 bytes by the planes of their bytes, of which most are alike."""
    return pa.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, size: int, kind: str = "<i8") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(blob, 8 * size, "zstd"), np.uint8).reshape(8, size).T).view(kind).ravel()


def ascending(blob: bytes, size: int) -> np.ndarray:
    """The keys of a row of dealt()."""
    return np.cumsum(unpacked(blob, size, "<u8"), dtype=np.uint64)


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where each distinct one of sorted keys begins."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


def dealt(keys: np.ndarray, buckets: int, bits: int, each: np.ndarray | None, distinct: np.ndarray | None) -> tuple:
    """Sorted keys of so many bits, dealt into buckets by their range: (bucket, size, steps between keys, each, distinct).

    each has a number for every key; of distinct, which has the same number for equal keys, one is packed for each distinct key.
    """
    bucket = (keys * np.uint64(buckets) >> np.uint64(bits) if bits <= 40 else (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    begins = firsts(bucket)
    cuts = [slice(i, j) for i, j in zip(begins, [*begins[1:], len(keys)], strict=False)]
    blob = lambda f: pa.array([packed(f(c)) for c in cuts], pa.binary())
    steps = blob(lambda c: np.diff(keys[c], prepend=np.uint64(0)))
    nothing = pa.nulls(len(cuts), pa.binary())
    return (
        pa.array(bucket[begins]), pa.array([c.stop - c.start for c in cuts], pa.int64()), steps,
        nothing if each is None else blob(lambda c: each[c]),
        nothing if distinct is None else blob(lambda c: distinct[c][firsts(keys[c])]),
    )


FACTORS = 0x5BD1E9 | 1, 0x2C9277 | 1


def code_bits(n_head: int) -> int:
    """Bits of mixed_code; 40 for a million words."""
    return max(2, ((n_head + 1) ** 2).bit_length())


def mixed_code(word, prev, n_head: int):
    """One number for the places of two frequent words, as arrays or columns; spread evenly over code_bits, so that ranges are alike."""
    bits = code_bits(n_head)
    mask, shift, (one, two) = (1 << bits) - 1, (bits + 1) // 2, FACTORS
    if isinstance(word, Column):
        x = ((word * (n_head + 1) + prev) * one).bitwiseAND(F.lit(mask))
        return (x.bitwiseXOR(F.shiftrightunsigned(x, shift)) * two).bitwiseAND(F.lit(mask))
    x = (word * (n_head + 1) + prev) * one & mask
    return (x ^ x >> shift) * two & mask


def places_of(code: np.ndarray, n_head: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the words of mixed_code."""
    bits = code_bits(n_head)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    one, two = (np.uint64(pow(f, -1, 1 << bits)) for f in FACTORS)
    x = code.astype(np.uint64) * two & mask
    x = ((x ^ x >> shift) * one & mask).astype(np.int64)
    return np.divmod(x, n_head + 1)


PACKED = "kind byte, bucket long, size long, key binary, prev binary, n binary"
COUNTED = "kind byte, key long, prev long, n long, share double"


def count_grams(rows: DataFrame, symbol, head, twice, n_tokens: int, n_texts: int) -> DataFrame:
    """(kind, key, prev, n, share) of all rows: kind 2 counts (DEPTH + 1)-grams, kinds 3 and 4 words by the word before.

    symbol is a broadcast table from code point to symbol, head one of the sorted hashes of frequent words and their counts, twice one
    of a bitmap of the words that occur more than once. Pairs seen once are left out. Kind 3 has the kept branches between frequent
    words, by their places among these, with the share; the start's place is behind these. Kind 4 has all other pairs by hashes, without.
    """
    buckets = max(1, n_tokens // BUCKET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKED.split(", ")]
        n_head, bits = len(head.value[0]), code_bits(len(head.value[0]))
        tally, codes, others, held = Tally(), [], [], 0

        def pack(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
            """The columns, which are in order of the bucket, as a row for each bucket."""
            begins = firsts(bucket)
            ends = np.r_[begins[1:], len(bucket)][: len(begins)]
            blobs = [pa.array([packed(c[i:j]) for i, j in zip(begins, ends, strict=True)], pa.binary()) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(begins), kind, np.int8)), pa.array(bucket[begins]), pa.array(ends - begins), *blobs], names)

        def pairs() -> Iterator[pa.RecordBatch]:
            code = np.sort(np.concatenate(codes).view(np.uint64))
            new = firsts(code)
            bucket, size, keys, n, _ = dealt(code[new], buckets, bits, np.diff(np.r_[new, len(code)]), None)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), 3, np.int8)), bucket, size, keys, pa.nulls(len(size), pa.binary()), n], names)
            word, prev = (np.concatenate(x) for x in zip(*others, strict=True))
            hashes = mix(pair_of(word, prev).view(np.uint64))
            order = np.argsort(hashes)
            hashes = hashes[order]
            new = firsts(hashes)
            bucket = ((hashes[new] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            yield pack(4, bucket, word[order[new]], prev[order[new]], np.diff(np.r_[new, len(order)]))
            codes.clear()
            others.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                flat, lengths, points, sizes = split(batch.column(0).slice(at, SLICE).to_pylist())
                tally.add(grams(points, sizes, symbol.value)[0])
                # Frequent words go by their place, and the start behind these; 2^20 numbers that a hash has with a chance of 2^-44.
                place, hit = find(head.value[0], flat)
                code = np.where(hit, place, flat)
                begins = (np.cumsum(lengths) - lengths)[lengths > 0]
                prev, known = before(code, lengths), hit.copy()
                prev[begins] = n_head
                known[1:] = hit[:-1]
                known[begins] = True
                both = hit & known
                codes.append(mixed_code(code[both], prev[both], n_head))
                # A pair with a word that occurs once is seen once.
                often = hit | marked(twice.value, flat)
                again = np.r_[True, often[:-1]][: len(often)]
                again[begins] = True
                other = ~both & often & again
                others.append((code[other], prev[other]))
                held += len(code)
                if held >= GATHERED:
                    yield from pairs()
                    held = 0
        if codes:
            yield from pairs()
        keys, n = tally.merged()
        order = np.argsort(keys & 15, kind="stable")
        yield pack(2, keys[order] & 15, keys[order], np.zeros(len(keys), np.int64), n[order])

    def merge(group: pa.Table) -> pa.Table:
        hashes, counts = head.value
        kind = group.column("kind")[0].as_py()
        sizes = group.column("size").to_pylist()
        read = lambda c, f=unpacked: np.concatenate([f(b, k) for b, k in zip(group.column(c).to_pylist(), sizes, strict=True)])
        n = read("n")
        if kind == 3:
            pair = read("key", ascending)
        else:
            key, prev = read("key"), read("prev")
            pair = pair_of(key, prev)
        order = np.argsort(pair, kind="stable")
        new = firsts(pair[order])
        n, at = np.add.reduceat(n[order], new), order[new]
        if kind > 2:
            n, at = n[n > 1], at[n > 1]
        share = np.full(len(n), np.nan)
        if kind == 3:
            key, prev = places_of(pair[at], len(hashes))
            own, of = counts[key].astype(float), np.r_[counts, n_texts][prev].astype(float)
            share = (n - DISCOUNT) / of
            good = (own < HEAD * n_tokens) & (n * np.log(n / of * n_tokens / own) > WORD_DIVERGENCE)
            key, prev, n, share = key[good], prev[good], n[good], share[good]
        else:
            key, prev = key[at], prev[at]
        if kind == 4:
            known, context = (key >= 0) & (key < len(hashes)), (prev >= 0) & (prev <= len(hashes))
            key = np.where(known, np.r_[hashes, 0][np.where(known, key, 0)], key)
            prev = np.where(context, np.r_[hashes, START_HASH][np.where(context, prev, 0)], prev)
        return pa.table([pa.array(np.full(len(n), kind, np.int8)), pa.array(key), pa.array(prev), pa.array(n), pa.array(share, from_pandas=True)], names=[x.split()[0] for x in COUNTED.split(", ")])

    return rows.select("text").mapInArrow(run, PACKED).groupBy("kind", "bucket").applyInArrow(merge, COUNTED)


def branches(pairs: DataFrame, words: DataFrame, n_tokens: int, n_texts: int) -> DataFrame:
    """(key, prev, own, share): the kept branches, each with its word's count and discounted share in that context."""
    words = words.where("n > 1")
    known = words.union(words.sparkSession.createDataFrame([(START_HASH, n_texts)], "key long, n long"))
    found = pairs.join(words.select("key", F.col("n").alias("own")), "key").join(known.select(F.col("key").alias("prev"), F.col("n").alias("of")), "prev")
    kept = found.where((F.col("own") < HEAD * n_tokens) & (F.col("n") * F.log(F.col("n") / F.col("of") * n_tokens / F.col("own")) > WORD_DIVERGENCE))
    return kept.select("key", "prev", "own", ((F.col("n") - DISCOUNT) / F.col("of")).alias("share"))


def bitmap(pairs: DataFrame) -> np.ndarray:
    """The bits of all values of the only column; 16 MB."""
    pairs = pairs.toDF("pair")
    bit = F.col("pair").bitwiseAND(F.lit((1 << BITMAP) - 1))
    one = F.expr("shiftleft(1L, cast(pair & 63 as int))")
    found = pairs.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << BITMAP - 6, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def marked(bits: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether the bit of each number is set."""
    at = pairs & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


#: What is looked up: branches between frequent words by mixed_code, other branches by pair_of, and rarer words by hash.
CODES, PAIRS, WORDS = 5, 6, 7
ASKED = "kind byte, bucket long, block long, size long, key binary, each binary, value binary"
ASKED_NAMES = [x.split()[0] for x in ASKED.split(", ")]
ANSWERED = "block long, size long, doc binary, score binary, base binary, known binary"


def asked(kind: int, keys: np.ndarray, buckets: int, bits: int, each: np.ndarray | None, value: np.ndarray | None, block: int | None = None) -> pa.RecordBatch:
    """Facts, or with a block what its documents ask, as rows for each bucket; the keys come in any order."""
    keys = keys.view(np.uint64)
    order = np.argsort(keys, kind="stable")
    bucket, size, steps, each, value = dealt(keys[order], buckets, bits, *(None if x is None else x[order] for x in (each, value)))
    rows = len(size)
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int8)), bucket, pa.array([block] * rows, pa.int64()), size, steps, each, value], ASKED_NAMES)


def facts(df: DataFrame, make) -> DataFrame:
    """What make(columns) packs of all rows of each task, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= GATHERED:
                yield made(held)
                held, rows = [], 0
        if rows:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        return make(*(c.to_numpy() for c in whole.columns))

    return df.mapInArrow(run, ASKED)


def answered(asking: DataFrame, own, share: float, spelled: float) -> DataFrame:
    """(row, known, base, score): what documents add up to in all that they asked. own is a broadcast array by place of a frequent word's
    probability alone."""

    def answer(group: pa.Table) -> pa.Table:
        kind = group.column("kind")[0].as_py()
        rows = group.to_pylist()
        told = [(ascending(r["key"], r["size"]), r) for r in rows if r["block"] is None]
        out = []

        def table(column: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
            """The facts that have the column, in order of their keys."""
            have = [(k, unpacked(r[column], len(k), kind)) for k, r in told if r[column] is not None]
            keys, values = (np.concatenate(x) if have else np.empty(0, t) for x, t in zip(zip(*have, strict=True) if have else ((), ()), (np.uint64, kind), strict=True))
            order = np.argsort(keys)
            return keys[order], values[order]

        counts_of, counts = table("each", "<i8")
        keys_of, values = table("value", "<f8")
        if kind == CODES and len(keys_of):
            values = np.log10(1 + values / own.value[places_of(keys_of, len(own.value))[0]])
        for r in rows:
            if r["block"] is None:
                continue
            keys, doc = ascending(r["key"], r["size"]), unpacked(r["each"], r["size"])
            begins = firsts(keys)
            times = np.diff(np.r_[begins, len(keys)])
            at, there = find(keys_of, keys[begins])
            base = known = None
            if kind != CODES:
                cost = unpacked(r["value"], len(begins), "<f8")
                at_count, counted = find(counts_of, keys[begins])
                n = np.where(counted, np.r_[counts, 0][at_count], 0)
                # A long word's spelling is less than the least number.
                alone = np.where(n > 0, np.log10(np.where(n > 0, share * n + spelled * 10**cost, 1)), np.log10(spelled) + cost)
            fact = np.where(there, np.r_[values, 0.0][at], 0.0)
            if kind == CODES:
                score = fact
            elif kind == PAIRS:
                score = np.log10(1 + fact * 10 ** np.where(there, -alone, 0.0))
            else:
                score = alone + np.log10(np.where(there, fact, 1.0))
                base, known = np.log10(n + 1), (n > 0).astype(float)
            sums = lambda x, doc=doc, times=times: None if x is None else np.bincount(doc, weights=np.repeat(x, times))
            totals = sums(score), sums(base), sums(known)
            some = np.flatnonzero(np.bincount(doc) if kind == WORDS else totals[0])
            if len(some):
                out.append((r["block"], len(some), packed(some), *(None if x is None else packed(x[some]) for x in totals)))
        names = [x.split()[0] for x in ANSWERED.split(", ")]
        types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)

    def add_up(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        docs = [unpacked(r["doc"], r["size"]) for r in rows]
        doc = np.concatenate(docs)

        def total(column: str) -> np.ndarray:
            return np.bincount(doc, weights=np.concatenate([np.zeros(r["size"]) if r[column] is None else unpacked(r[column], r["size"], "<f8") for r in rows]))

        known, base, score = (total(c) for c in ("known", "base", "score"))
        return pa.table({"row": rows[0]["block"] + np.arange(len(score)), "known": np.rint(known).astype(np.int64), "base": base, "score": score})

    return asking.groupBy("kind", "bucket").applyInArrow(answer, ANSWERED).groupBy("block").applyInArrow(add_up, "row long, known long, base double, score double")


def candidate_contexts(counted: DataFrame) -> list[np.ndarray]:
    """For each depth the (context, next symbol, count) of contexts with P_MIN of all positions: a bounded number."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    out = []
    for d in range(DEPTH + 1):
        by_next = counted.groupBy(F.col("key").bitwiseAND(F.lit((1 << BITS * (d + 1)) - 1)).alias("g")).agg(F.sum("n").alias("n"))
        by_next = by_next.select(F.shiftright("g", BITS).alias("context"), F.col("g").bitwiseAND(F.lit(SYMBOLS - 1)).alias("next"), "n")
        often = by_next.groupBy("context").agg(F.sum("n").alias("all")).where(F.col("all") >= P_MIN * total).select("context")
        found = by_next.join(often, "context").toPandas()
        out.append(found.sort_values(["context", "next"])[["context", "next", "n"]].to_numpy(np.int64))
    return out


def tree(candidates: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The kept contexts of each depth, and log10 of the next-symbol distribution of every state in that order."""
    parents: dict[int, int] = {}
    smooth = np.full((1, SYMBOLS), 1 / SYMBOLS)  # of the depth above, by place in parents
    kept, rows = [], []
    for d, found in enumerate(candidates):
        contexts, at = np.unique(found[:, 0], return_inverse=True)
        counts = np.zeros((len(contexts), SYMBOLS))
        counts[at, found[:, 1]] = found[:, 2]
        total = counts.sum(1, keepdims=True)
        # A candidate's parent occurs at least as often, so it is a candidate as well.
        above = smooth[[parents[int(c) & ((1 << BITS * (d - 1)) - 1)] for c in contexts] if d else np.zeros(len(contexts), int)]
        own = (counts + SMOOTHING * above) / (total + SMOOTHING)
        keep = np.ones(len(contexts), bool)
        if d:
            with np.errstate(divide="ignore", invalid="ignore"):
                terms = np.where(counts > 0, counts * np.log(counts / total / above), 0)
            keep = terms.sum(1) > DIVERGENCE
        kept.append(contexts[keep])
        rows.append(own[keep])
        parents, smooth = {int(c): i for i, c in enumerate(contexts)}, own
    if not len(kept[0]):
        kept[0], rows[0] = np.zeros(1, np.int64), np.full((1, SYMBOLS), 1 / SYMBOLS)
    return kept, np.log10(np.concatenate(rows)).astype(np.float32)


def states(kept: list[np.ndarray]) -> np.ndarray:
    """The state of every context of DEPTH symbols: its longest kept suffix. 32 MB where 16 bits number the states."""
    kind = np.uint16 if sum(map(len, kept)) <= 1 << 16 else np.int32
    table = np.zeros(1 << (BITS * DEPTH), kind)
    first = 0
    for d, contexts in enumerate(kept):
        table.reshape(-1, 1 << (BITS * d))[:, contexts] = np.arange(first, first + len(contexts)).astype(kind)
        first += len(contexts)
    return table


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; held_out says which rows the counts leave out."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = prepared(docs, id_col, text_col, held_out)
    training = rows.where(~F.col("held_out"))

    shelf = Shelf(spark)
    counted = shelf.keep(count_words(training))
    words = counted.where("kind = 1 and n > 0").select("key", "n")
    n_tokens, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = counted.where("kind = 0").orderBy(F.desc("n"), "key").limit(ALPHABET).select("key").collect()
    symbol = np.full(CODE_POINTS, OTHER, np.uint8)
    symbol[[r.key for r in frequent]] = np.arange(2, 2 + len(frequent))
    symbol = sc.broadcast(symbol)

    head = words.where(F.col("n") >= FREQUENT * n_tokens).toArrow().sort_by("key")
    head = {c: head[c].to_numpy() for c in ("key", "n")}
    n_end = words.where(F.col("key") == END_HASH).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    texts = max(n_end, 1)  # every training row has one end
    n_head, bits = len(head["key"]), code_bits(len(head["key"]))
    frequents = sc.broadcast((head["key"], head["n"]))
    seen = shelf.keep(count_grams(training, symbol, frequents, sc.broadcast(bitmap(words.where("n > 1").select("key"))), n_tokens, texts))
    kept, log_next = tree(candidate_contexts(seen.where("kind = 2").select("key", "n")))
    once = words.where("n = 1").count()
    spelled = once / n_tokens if 0 < once < n_tokens else 1.0 if n_tokens == 0 else 0.5 / n_tokens
    share = (1 - spelled) / max(n_tokens, 1)

    # Contexts that are frequent words, or the start, go by place, and there are no more than these.
    inner = seen.where("kind = 3").select("key", "prev", "n", "share")
    outer = shelf.keep(branches(seen.where("kind = 4").select("key", "prev", "n"), words, n_tokens, texts))
    taken = outer.groupBy("prev").agg(F.sum("share").alias("taken"))
    heads = words.where(F.col("n") >= FREQUENT * n_tokens).select("key").union(spark.createDataFrame([(START_HASH,)], "key long"))
    taken = shelf.keep(taken.join(F.broadcast(heads.select(F.col("key").alias("prev"), F.lit(True).alias("frequent"))), "prev", "left"))
    rest = np.ones(n_head + 1)
    some = inner.groupBy("prev").agg(F.sum("share").alias("taken")).toArrow()
    rest[some["prev"].to_numpy()] -= some["taken"].to_numpy()
    some = taken.where("frequent").select("prev", "taken").toArrow()
    at, there = find(head["key"], some["prev"].to_numpy())
    rest[np.where(there, at, n_head)] -= some["taken"].to_numpy()

    often = inner.where(F.col("n") >= FREQUENT * n_tokens).select("key", "prev", "share").toArrow()
    codes = mixed_code(often["key"].to_numpy(), often["prev"].to_numpy(), n_head)
    order = np.argsort(codes)
    often_gain = (often["share"].to_numpy() / rest[often["prev"].to_numpy()])[order]
    rare = inner.where(F.col("n") < FREQUENT * n_tokens)
    branched = rare.select(mixed_code(F.col("key"), F.col("prev"), n_head).alias("key")).union(outer.select(pair_of(F.col("key"), F.col("prev"))))
    model = sc.broadcast((kept, log_next, codes[order], often_gain, bitmap(branched), rest))
    spare = -np.log10(CODE_POINTS)
    buckets = max(1, n_tokens // ASKED_BUCKET)

    def codes_told(key, prev, share):
        return asked(CODES, mixed_code(key, prev, n_head), buckets, bits, None, share / model.value[5][prev])

    def pairs_told(key, prev, own, share, taken):
        place, hit = find(frequents.value[0], prev)
        place[prev == START_HASH], hit[prev == START_HASH] = n_head, True
        rest = np.where(hit, model.value[5][place], 1 - taken)
        return asked(PAIRS, pair_of(key, prev), buckets, 64, own, share / rest)

    def counts_told(key, n):
        return asked(WORDS, key, buckets, 64, n, None)

    def rests_told(key, taken):
        return asked(WORDS, key, buckets, 64, None, 1 - taken)

    told = [
        facts(rare.select("key", "prev", "share"), codes_told),
        facts(outer.join(taken.select("prev", "taken"), "prev").select("key", "prev", "own", "share", "taken"), pairs_told),
        facts(words.where(F.col("n") < FREQUENT * n_tokens), counts_told),
        facts(taken.where("frequent is null").select("prev", "taken"), rests_told),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, log_next, often, often_gain, branched, rest = model.value
        head_keys, head_counts = frequents.value
        head_counts, log_rest = head_counts.astype(np.float64), np.log10(rest)
        state = states(kept)
        told = np.zeros(n_head, bool)
        block = number = TaskContext.get().partitionId() << 33
        gathered, held = {CODES: [], PAIRS: [], WORDS: []}, 0

        def tall(**columns) -> pa.RecordBatch:
            rows = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(rows, t)) for n, t in TALL_TYPES.items()], list(TALL_TYPES))

        def flushed() -> Iterator[pa.RecordBatch]:
            for kind, held in gathered.items():
                keys, doc, *cost = (np.concatenate(x) for x in zip(*held, strict=True))
                part = asked(kind, keys, buckets, bits if kind == CODES else 64, doc, cost[0] if cost else None, block)
                yield tall(**dict(zip(ASKED_NAMES, part.columns, strict=True)))
                held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = part.num_rows
                flat, lengths, points, sizes = split(part.column(2).to_pylist())
                doc = np.repeat(np.arange(rows), lengths)

                key, starts = grams(points, sizes, symbol.value)
                nexts = key & (SYMBOLS - 1)
                logs = np.add.reduceat(log_next[state[key >> BITS], nexts].astype(np.float64) + np.where(nexts == OTHER, spare, 0), starts)
                ends = np.cumsum(lengths + 1) - 1
                spelling = np.delete(logs, ends)

                place, hit = find(head_keys, flat)
                mine = place[hit]
                counts = head_counts[mine]
                total = lambda values, doc=doc[hit], rows=rows: np.bincount(doc, weights=values, minlength=rows)
                known = np.bincount(doc[hit], minlength=rows) + (n_end > 0)
                base = total(np.log10(counts + 1)) + np.log10(n_end + 1)
                own = share * counts + spelled * 10 ** spelling[hit]
                scores = np.log10(own) + log_rest[mine]

                begins = (np.cumsum(lengths) - lengths)[lengths > 0]
                before_place, after_known = np.r_[0, place[:-1]][: len(place)], np.r_[True, hit[:-1]][: len(hit)]
                before_place[begins], after_known[begins] = n_head, True
                both = after_known[hit]
                code = mixed_code(mine[both], before_place[hit][both], n_head)
                inside = np.flatnonzero(both)
                at_often, found = find(often, code)
                there = inside[found]
                scores[there] += np.log10(1 + often_gain[at_often[found]] / own[there])
                likely = ~found & marked(branched, code)
                in_block = doc + (number - block)
                gathered[CODES].append((code[likely], in_block[hit][inside[likely]]))
                words = mine[inside[likely]]
                fresh = np.flatnonzero(~told[words])
                if len(fresh):
                    some, first = np.unique(words[fresh], return_index=True)
                    told[some] = True
                    yield tall(place=pa.array(some), score=pa.array(own[inside[likely]][fresh[first]]))

                outside = np.flatnonzero(~(hit & after_known))
                pair = pair_of(flat[outside], before(flat, lengths)[outside])
                likely = marked(branched, pair)
                gathered[PAIRS].append((pair[likely], in_block[outside[likely]], spelling[outside[likely]]))
                gathered[WORDS].append((flat[~hit], in_block[~hit], spelling[~hit]))

                scores = total(scores) + np.log10(share * n_end + spelled * 10 ** logs[ends]) + log_rest[n_head]
                yield tall(doc_id=part.column(0), held_out=part.column(1), row=pa.array(number + np.arange(rows)), tokens=pa.array(lengths + 1), known=pa.array(known.astype(np.int64)), base=pa.array(base), score=pa.array(scores))
                number += rows
                held += len(flat)
                if held >= GATHERED:
                    yield from flushed()
                    block, held = number, 0
        if number > block:
            yield from flushed()

    tall = shelf.keep(rows.mapInArrow(run, TALL))
    alone = tall.where("place is not null").groupBy("place").agg(F.max("score").alias("own")).toArrow()
    own = np.full(n_head, np.nan)
    own[alone["place"].to_numpy()] = alone["own"].to_numpy()
    asking = tall.where("kind is not null").select(ASKED_NAMES)
    for part in told:
        asking = asking.union(part)
    by_row = answered(asking, sc.broadcast(own), share, spelled).select("row", *(F.col(c).alias(f"more_{c}") for c in ("known", "base", "score")))
    more = lambda c: F.coalesce(f"more_{c}", F.lit(0))
    joined = tall.where("row is not null").join(by_row, "row", "left").select(
        "doc_id", "held_out", F.col("tokens").alias("n_tokens"),
        (F.col("known") + more("known")).cast("long").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more("base") - F.col("tokens") * F.log10(F.lit(float(n_tokens + n_distinct + 1)))).alias("base_score"),
        (F.col("score") + more("score")).alias("score"),
    )
    return shelf.last(joined)


TALL_TYPES = {
    "doc_id": pa.int64(), "held_out": pa.bool_(), "row": pa.int64(), "tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "place": pa.int64(),
    "kind": pa.int8(), "bucket": pa.int64(), "block": pa.int64(), "size": pa.int64(), "key": pa.binary(), "each": pa.binary(), "value": pa.binary(),
}
TALL = f"doc_id long, held_out boolean, row long, tokens long, known long, base double, score double, place long, {ASKED}"


def default_held_out(id_col: str = "doc_id", n: int = 7, remainder: int = 2) -> Column:
    return crc_mod(id_col, n) == remainder
