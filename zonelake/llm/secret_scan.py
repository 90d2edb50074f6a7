"""Secret scans: a keyword automaton finds where to look, anchored expressions match there, checksums decide.

Base kinds: ``assign`` (a credential name, a separator and a value of 8+ characters), ``access`` (AKIA and upper-case
letters or digits, 16+ characters) and ``hex`` (32+ lower-case hexadecimal digits). A base match that is too short
is dropped but still consumes its characters. Added kinds carry a checksum inside: ``ghtoken`` (prefix gh?_, 30
base-62 characters and the CRC-32 of these in 6 base-62 digits) and ``npmtoken`` (npm_ and the same form); they
count only if the checksum holds. Spans are in code points, end exclusive, sorted by start and then kind.

Defined results: null or empty text: no spans; repeated rows are scanned one by one; an empty table gives an empty
table; extra columns are ignored. A text is scanned in one pass, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelake.llm.common import text_of

# Kinds in the order of ties, keywords, prefixes of tokens with a checksum, base-62 digits.
KINDS = ("assign", "access", "hex", "ghtoken", "npmtoken")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
CHECKED = {"ghp_": "ghtoken", "gho_": "ghtoken", "ghu_": "ghtoken", "ghs_": "ghtoken", "ghr_": "ghtoken", "npm_": "npmtoken"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

# ASCII and IGNORECASE together: letters such as U+017F don't count as s.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BODY = re.compile(r"[A-Za-z0-9]{36}(?![A-Za-z0-9_])")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in KEYWORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for prefix in CHECKED:
        found.add_word(prefix, ("checked", len(prefix)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """Lower case at the same positions; only a guide to hits, which the expressions then confirm."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def base62_crc(body: str) -> str:
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def scan(text: str, keywords) -> list[tuple[int, int, str]]:
    """(start, order of the kind, "kind:start:end") of every span."""
    spans, free = [], {"assign": 0, "access": 0}
    for last, (group, size) in keywords.iter(lowered(text)):
        start = last - size + 1
        if group == "checked":
            kind = CHECKED.get(text[start : start + size])
            if kind and (start == 0 or not (text[start - 1].isascii() and text[start - 1].isalnum())) and (m := BODY.match(text, start + size)):
                if base62_crc(m[0][:30]) == m[0][30:]:
                    spans.append((start, m.end(), kind))
            continue
        if start < free[group]:
            continue
        if m := (ASSIGN if group == "assign" else ACCESS).match(text, start):
            free[group] = m.end()
            if len(m[2]) >= 8 if group == "assign" else len(m[0]) >= 16:
                spans.append((start, m.end(), group))
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted((a, KINDS.index(kind), f"{kind}:{a}:{b}") for a, b, kind in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with counts by kind, the digest of the base spans and all spans. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = scan(text.as_py(), keywords)
                base = [x for x in found if x[1] < 3]
                count = [sum(x[1] == k for x in found) for k in range(3)]
                rows.append((doc_id, *count, len(found) - len(base), hashlib.sha256(",".join(x[2] for x in base).encode()).hexdigest(), ",".join(x[2] for x in found)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.string()] * 2, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same columns; every span found in the text is replaced by the mark (overlapping spans by one)."""
    names, kind = docs.columns, docs.schema[text_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            for value in batch.column(at):
                text = value.as_py()
                parts, end = [], 0
                for _, _, span in scan(text, keywords) if text else ():
                    a, b = map(int, span.split(":")[1:])
                    if a >= end:
                        parts += [text[end:a], mark]
                    end = max(end, b)
                out.append("".join([*parts, text[end:]]) if parts else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    assert kind.typeName() == "string" and names.count(text_col) == 1
    return docs.mapInArrow(run, docs.schema)
