"""Byte-level BPE encoding and decoding as a monoid: halves are encoded, neighbours joined at their seam.

A text is halved until a part has at most LEAF characters; leaves are encoded, then joined up the tree. A join encodes
a window around the seam anew. White space after another character is a place where a pre-token always starts, as none
of the pattern's alternatives takes a white space after something else, and where what lies before isn't looked past.
So the window grows on either side of the seam until it meets such a place (or the end of its part); tokens outside
are then those of the whole for certain. A stretch without such a place that is too long for a window is left in one piece: the
text is cut at its ends instead, where nothing needs a window. It is matched in one go, and a single pre-token
of more than LEAF bytes is halved in turn: two token sequences join as they are exactly if encoding the bytes of the two
tokens at the seam gives these two again (a sequence is an encoding if and only if this holds for all neighbours);
else a window of tokens around the seam is encoded, and grows until both of its outer pairs hold. Decoding maps ids to
bytes in leaves and concatenates up the same tree.

Defined results: null counts as empty text, which has no tokens; repeated rows are encoded one by one; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelake.llm.common import text_of

LEAF = 512
SPACES = " \n\t"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBPE:
    """A vocabulary with its encoder and decoder; ``leaf`` is the size from which parts are halved."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF) -> None:
        import regex
        import tiktoken

        self.ranks, self.tokens, self.leaf = ranks, {i: b for b, i in ranks.items()}, leaf
        self.plain = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    # One pre-token of any length.

    def merged(self, data: bytes) -> list[int]:
        """BPE of a few bytes: of all neighbours the lowest-ranked merge first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def holds(self, a: int, b: int) -> bool:
        return self.merged(self.tokens[a] + self.tokens[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        reach = 1
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = self.merged(b"".join(self.tokens[t] for t in left[a:] + right[:b]))
            if (a == 0 or self.holds(left[a - 1], window[0])) and (b == len(right) or self.holds(window[-1], right[b])):
                return left[:a] + window + right[b:]
            reach *= 2

    def pretoken(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.plain._encode_single_piece(data)
        half = len(data) // 2
        return self.join_tokens(self.pretoken(data[:half]), self.pretoken(data[half:]))

    # Texts.

    def run(self, text: str) -> list[int]:
        """A window: short ones at once, long ones match by match."""
        if len(text) <= 2 * self.leaf:
            return self.plain.encode_ordinary(text)
        ids: list[int] = []
        for m in self.pattern.finditer(text):
            data = m[0].encode()
            ids += self.plain.encode_ordinary(m[0]) if len(data) <= self.leaf else self.pretoken(data)
        return ids

    def join(self, text: str, p: int, seam: int, q: int, left: list[int], right: list[int]) -> list[int]:
        """left encodes what ends at the seam, right what begins there; text[p:q] is the window that is encoded anew."""
        gone, i = len(text[p:seam].encode()), len(left)
        while gone > 0:
            i -= 1
            gone -= len(self.tokens[left[i]])
        more, j = len(text[seam:q].encode()), 0
        while more > 0:
            more -= len(self.tokens[right[j]])
            j += 1
        assert gone == more == 0
        return left[:i] + self.run(text[p:q]) + right[j:]

    def encode(self, text: str, a: int = 0, b: int | None = None) -> list[int]:
        b = len(text) if b is None else b
        if b - a <= self.leaf:
            return self.plain.encode_ordinary(text[a:b])
        seam = (a + b) // 2
        p, q = seam - 1, seam + 1
        while p > a and not (text[p] in SPACES and not text[p - 1].isspace()):
            p -= 1
        while q < b and not (text[q] in SPACES and not text[q - 1].isspace()):
            q += 1
        if q - p <= 2 * self.leaf:
            return self.join(text, p, seam, q, self.encode(text, a, seam), self.encode(text, seam, b))
        if p == a and q == b:
            return self.run(text[a:b])
        cut = p if p > a and (q == b or seam - p <= q - seam) else q
        return self.encode(text, a, cut) + self.encode(text, cut, b)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join([self.tokens[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@cache
def load(path: str, pattern: str) -> ByteBPE:
    """Ranks as lines of base64 bytes and a number; kept for the tasks of a Python worker."""
    with open(path, "rb") as lines:
        return ByteBPE({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """Per document: number of tokens, digests of ids and decoded bytes, and unless digests_only the ids. No shuffle."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(x.as_py()) for x in part.column(1)]
                columns = [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns if digests_only else [*columns, pa.array(ids, pa.list_(pa.int32()))], names if digests_only else [*names, "ids"])

    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return chosen.mapInArrow(run, SCHEMA if digests_only else f"{SCHEMA}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) from token ids; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>")).mapInArrow(run, "doc_id long, decoded binary")
