"""HTML extraction by union-free wrappers, inferred from the pages of a host and then matched to each page.

A page becomes a stream of tokens: tags (with a plain class or id of containers, and whether class, id or role say that they
are page furniture) and ``#`` for any text. Repeated neighbours fold into a group ``+``. Streams of one host are aligned one by
one: a stretch that one side lacks becomes an optional group, what repeats on one side takes up its single occurrence on the
other, and text against text stays a slot. The result is a regular expression without unions, the host's wrapper. Equal
streams are counted before they are shuffled, and a host's wrappers join in a tree of bounded fans, so a host with a third
of all pages is no larger a task than others.

Each page is matched with its host's wrapper, and the texts of slots are summed up by host and slot: their characters, and on how many pages they differ.
A slot weighs its characters times the share of pages on which its text is one of its own, so what a host repeats on
all pages weighs next to nothing. The main part of a wrapper is found from the root down: as long as one container that doesn't
repeat holds SHARE of the weight outside furniture, it is entered. (A host with one page says nothing of what it
repeats; there, an article or main element is taken where the page has a single one.) The text of a page is that of the
main part's slots, split where a block begins or ends. A page that lacks the wrapper's main part is wrapped by
itself. Matching takes linear time.

Defined results: null or empty html and pages without main text give the empty text; pages without a host in the
url share the wrapper of the empty host; repeated rows are extracted one by one; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelake.llm.common import Shelf
from zonelake.llm.url_filter import host_of

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Wrappers that one task joins at a time; characters of all wrappers up to which they are broadcast.
FAN, BROADCAST_CHARS = 64, 16_000_000
#: Cells of an alignment of which all rows are held; beyond that, about twice the square root of their number are.
CELLS = 1_000_000
SHARE = 0.6
SLOT = "#"

# Elements by what they mean for reading.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "button", "title")
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", *RAW}
NAMES = r"(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|side|social|sponsor\w*|subscribe|toolbar|widget)"
KINDS = r"(?:area|bar|block|box|buttons?|container|form|links?|list|section|signup|slot|unit|wrapper)"
#: Outside of an article a name may be a part of a class or id; inside, where words such as social or side can speak of the text, a class or id
#: is furniture if it consists of names and kinds of containers only.
FURNITURE_NAMES = re.compile(rf"(?:^|[\s_-]){NAMES}(?:$|[\s_-])", re.IGNORECASE)
WHOLE_NAMES = re.compile(rf"(?:^|\s)(?:{KINDS}[_-])*{NAMES}(?:[_-](?:{NAMES}|{KINDS}))*(?:$|\s)", re.IGNORECASE)
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("html body div section article main table tbody tr td center fieldset".split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:(?>=\s*(?:\"[^\"]*\"|'[^']*'))|[^>])*+)>|<[!?][^>]*>", re.DOTALL)
PLAIN = re.compile(r"\b(?:class|id)\s*=\s*[\"']?([A-Za-z][A-Za-z_-]{0,23})(?=[\s\"'/>]|\Z)", re.IGNORECASE)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)


def furniture(tag: str, attributes: str, names: re.Pattern = FURNITURE_NAMES) -> bool:
    if tag in FURNITURE:
        return True
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next(filter(None, m.groups()[1:]), "")
        if name == "hidden" or (name == "role" and value.lower() in FURNITURE_ROLES) or (name in ("class", "id") and tag not in ("html", "body", "article", "main") and names.search(value)):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """The stream of a page as from marked(); white space alone is no token, but goes before the next token's text."""
    space = ""
    for token, text in marked(page):
        if token:
            yield token, space + text
        space = "" if token else " "


def marked(page: str) -> Iterator[tuple[str, str]]:
    """(token, text), with an empty token for white space between tags. Tags are ``<p``, ``<!div`` (furniture) or ``>p``; elements that are left
    open are closed where their parents end or a following element implies it; a closing tag of none is dropped."""
    stack: list[str] = []
    at, raw = 0, ""
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if not raw and m.start() > at:
            text = page[at : m.start()]
            yield SLOT if text.strip() else "", text
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if raw:
            continue
        if m[1]:
            if tag in stack:
                while (top := stack.pop()) != tag:
                    yield f">{top}", ""
                yield f">{tag}", ""
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                yield f"<{tag}", ""
            continue
        closes = SIBLINGS.get(tag, {"p"} if tag in CLOSES_P else ())
        open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] in closes), None) if closes else None
        limit = max((i for i, x in enumerate(stack) if x in ("ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "td", "th", "aside", "nav", "header", "footer", "form")), default=-1)
        if open_at is not None and open_at > limit:
            while len(stack) > open_at:
                yield f">{stack.pop()}", ""
        if tag == "header" and "article" in stack:
            marked_off = False  # the head of the article itself
        else:
            marked_off = furniture(tag, m[3], WHOLE_NAMES if "article" in stack else FURNITURE_NAMES)
        name = PLAIN.search(m[3]) if m[3] and tag in CONTAINERS else None
        yield ("<!" if marked_off else "<") + tag + (f".{name[1].lower()}" if name else ""), ""
        if m[3].endswith("/") and tag in ("svg", "iframe"):
            yield f">{tag}", ""
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            yield f">{tag}", ""
        else:
            stack.append(tag)
    if page[at:].strip():
        yield SLOT, page[at:]
    while stack:
        yield f">{stack.pop()}", ""


# Wrappers: lists of tokens and groups ["+", ...] or ["?", ...].


def opens(node) -> bool:
    return isinstance(node, str) and node[0] == "<"


def periods(nodes: list) -> Iterator[int]:
    """Lengths of groups that may repeat, in ascending order: those at which enough nodes equal the one so far behind."""
    places: dict = {}
    for i, n in enumerate(nodes):
        if opens(n):
            places.setdefault(n, []).append(i)
    steps: dict[int, int] = {}
    for found in places.values():
        for x, y in zip(found, found[1:], strict=False):
            steps[y - x] = steps.get(y - x, 0) + 1
    yield from sorted(steps)


def folded(nodes: list) -> list:
    """Repeated neighbours as groups, shortest first; a group begins with an opening tag that occurs in it once."""
    done = 0
    while (size := next((p for p in periods(nodes) if p > done), None)) is not None:
        out, i, found = [], 0, False
        while i < len(nodes):
            if opens(nodes[i]) and i + size < len(nodes) and nodes[i] == nodes[i + size] and (group := nodes[i : i + size]) == nodes[i + size : i + 2 * size]:
                while nodes[i : i + size] == group:
                    i += size
                out.append(["+", *group])
                found = True
            else:
                out.append(nodes[i])
                i += 1
        done = size
        if found:
            nodes, done = taken_up(out, out), 0
    return nodes


def taken_up(nodes: list, groups: list) -> list:
    """Single occurrences, and neighbouring ones, of the repeated groups of another list become such groups."""
    for g in (x for x in groups if isinstance(x, list) and x[0] == "+"):
        out, i, size = [], 0, len(g) - 1
        while i < len(nodes):
            if nodes[i] == g:
                step = 1
            elif nodes[i : i + size] == g[1:]:
                step = size
            else:
                out.append(nodes[i])
                i += 1
                continue
            i += step
            if not (out and out[-1] == g):
                out.append(g)
        nodes = out
    return nodes


def row_pairs(x: list[int], y: list[int]) -> Iterator[tuple[int, int]]:
    """For each place of x, the rows of lengths of longest common subsequences at it and at the next.

    A row is a whole number. Its bit len(y) - 1 - k is clear if y[k:] has a subsequence in common with x[i:] that is longer by one than
    that of y[k + 1 :]. A row follows from the next in a few operations. Every so many rows one is held; those between are computed
    anew when they are reached.
    """
    top = len(y) - 1
    digits = {n: bytearray((top >> 3) + 1) for n in set(x) & set(y)}
    for k, n in enumerate(y):
        if n in digits:
            digits[n][(top - k) >> 3] |= 1 << ((top - k) & 7)
    places = {n: int.from_bytes(d, "little") for n, d in digits.items()}
    full = (1 << len(y)) - 1

    def rows(begin: int, end: int, after: int) -> Iterator[int]:
        """The rows from end - 1 down to begin, given the row at end."""
        for i in range(end - 1, begin - 1, -1):
            both = after & places.get(x[i], 0)
            after = ((after + both) | (after - both)) & full
            yield after

    size = max(isqrt(len(x)), CELLS // max(len(y), 1), 1)
    begins = range(0, len(x), size)
    held = {len(x): full}
    for begin in reversed(begins[1:]):
        end = min(begin + size, len(x))
        *_, held[begin] = rows(begin, end, held[end])
    for begin in begins:
        end = min(begin + size, len(x))
        block = [held[end], *rows(begin, end, held[end])][::-1]
        yield from zip(block, block[1:], strict=False)


def common(x: list[int], y: list[int]) -> Iterator[str]:
    """The steps of an alignment by a longest common subsequence: "both", "a" (only x goes on) or "b"; of equal ones, what x has comes first."""
    top, j = len(y) - 1, 0
    for i, (row, after) in enumerate(row_pairs(x, y)):
        if j == len(y):
            yield "a"
            continue
        # How much longer the subsequence in common with y[j:] is with x[i] than without it.
        low = (1 << (len(y) - j)) - 1
        gain = (after & low).bit_count() - (row & low).bit_count()
        while j < len(y):
            if x[i] == y[j]:
                yield "both"
                j += 1
                break
            if not gain:
                yield "a"
                break
            yield "b"
            bit = top - j
            gain += (row >> bit & 1) - (after >> bit & 1)
            j += 1
        else:
            yield "a"
    yield from ["b"] * (len(y) - j)


def aligned(a: list, b: list) -> list:
    """The least general wrapper here that matches what a or b match."""
    if a == b:
        return a
    a, b = taken_up(a, b), taken_up(b, a)
    # Elements of optional groups are compared one by one. What is optional in the result keeps where it came from: neighbours
    # that come from one stretch or one group, and met the same on the other side, are there together or not at all.
    def flat(nodes: list) -> list[tuple]:
        return [(x, k if optional else None) for k, n in enumerate(nodes) for optional in [isinstance(n, list) and n[0] == "?"] for x in (n[1:] if optional else [n])]

    x, y = flat(a), flat(b)
    same = lambda p, q: p == q or (isinstance(p, list) and isinstance(q, list) and p[1] == q[1])
    out: list[tuple] = []

    def put(one: tuple, side: str) -> None:
        out.append((one[0], (side, one[1])))

    def pair(p: tuple, q: tuple) -> None:
        node = p[0] if p[0] == q[0] else ["+", *aligned(p[0][1:], q[0][1:])]
        out.append((node, None if p[1] is None and q[1] is None else ("both", p[1], q[1])))

    ahead = 0
    while ahead < min(len(x), len(y)) and same(x[ahead][0], y[ahead][0]):
        pair(x[ahead], y[ahead])
        ahead += 1
    behind = 0
    while behind < min(len(x), len(y)) - ahead and same(x[-1 - behind][0], y[-1 - behind][0]):
        behind += 1
    ends = list(zip(x[len(x) - behind :], y[len(y) - behind :], strict=True))
    x, y = x[ahead : len(x) - behind], y[ahead : len(y) - behind]
    keys: dict = {}
    kind = lambda n: keys.setdefault(n if isinstance(n, str) else ("+", json.dumps(n[1])), len(keys))  # noqa: E731 - equal where same() holds
    i = j = 0
    for step in common([kind(n) for n, _ in x], [kind(n) for n, _ in y]):
        if step == "both":
            pair(x[i], y[j])
        else:
            put(x[i] if step == "a" else y[j], step)
        i, j = i + (step != "b"), j + (step != "a")
    for p, q in ends:
        pair(p, q)
    return grouped(out)


def grouped(nodes: list[tuple]) -> list:
    """Nodes with an origin become optional groups by runs of one origin; those with none stay as they are."""
    out: list = []
    for origin, run in groupby(nodes, key=lambda n: n[1]):
        found = [node for node, _ in run]
        out += found if origin is None else [["?", *found]]
    return out


def stream_wrapper(page: str) -> list:
    return folded([t for t, _ in tokens(page)])


def joined(wrappers: list[str]) -> str:
    """Aligns wrappers in the order of their JSON, so that the order of rows doesn't matter."""
    first, *rest = map(json.loads, sorted(set(wrappers)))
    for other in rest:
        first = aligned(first, other)
    return json.dumps(first)


def slot_texts(stream: list[tuple[str, str]], way: list[int]) -> dict[int, tuple[int, int]]:
    """For each slot of a wrapper that a stream fills: the characters of its texts, and a hash of them."""
    found: dict[int, tuple[int, int]] = {}
    for (token, text), k in zip(stream, way, strict=True):
        if token == SLOT:
            chars, seen = found.get(k, (0, 0))
            found[k] = chars + len(text), zlib.crc32(text.encode("utf-8", "replace"), seen)
    return found


class Element:
    """An element of a wrapper: its first token, whether it is repeated or furniture, and what its slots weigh."""

    def __init__(self, token: str, first: int, repeated: bool, hidden: bool) -> None:
        self.tag, self.first, self.repeated = token.lstrip("<!").partition(".")[0], first, repeated
        self.hidden, self.weight, self.inner = hidden or token[1:2] == "!", 0.0, []


def elements(wrapper: list, weights: dict[int, float]) -> Element:
    """The tree of a wrapper's elements, given what each slot (by its place among the tokens) weighs."""
    root = Element("<", -1, False, False)
    open_, at = [root], 0

    def close(count: int) -> None:
        for _ in range(count):
            e = open_.pop()
            open_[-1].weight += e.weight

    def walk(nodes: list, repeated: bool) -> None:
        nonlocal at
        for n in nodes:
            if isinstance(n, list):
                walk(n[1:], repeated or n[0] == "+")
                continue
            if n == SLOT:
                open_[-1].weight += 0.0 if open_[-1].hidden else weights.get(at, 0.0)
            elif n[0] == "<" and n not in ("<br", "<hr"):
                made = Element(n, at, repeated, open_[-1].hidden)
                open_[-1].inner.append(made)
                open_.append(made)
            elif n[0] == ">":
                # An optional closing tag may lack its partner here: elements up to one of its name end.
                k = next((k for k in range(len(open_) - 1, 0, -1) if open_[k].tag == n[1:]), None)
                close(len(open_) - k if k else 0)
            at += 1

    walk(wrapper, False)
    close(len(open_) - 1)
    return root


def main_part(wrapper: list, weights: dict[int, float], pages: int) -> int:
    """Where the main part begins among the tokens of a wrapper; -1 if it is all of it."""
    at = elements(wrapper, weights)
    if pages == 1:
        named, todo = [], [at]
        while todo:
            e = todo.pop()
            todo += e.inner
            named += [e] * (e.tag in ("article", "main") and not e.hidden)
        for tag in ("article", "main"):
            if found := [e for e in named if e.tag == tag]:
                if len(found) == 1 and not found[0].repeated:
                    return found[0].first
                break
    while True:
        inner = [e for e in at.inner if e.tag in CONTAINERS and not e.repeated and not e.hidden]
        most = max(inner, key=lambda e: e.weight, default=None)
        if most is None or not at.weight or most.weight < SHARE * at.weight:
            return at.first
        at = most


class Matcher:
    """A wrapper as an automaton over tokens that remembers one way through, so a match takes linear time."""

    def __init__(self, wrapper: list, main: int) -> None:
        self.main = main
        self.tokens: list[str] = []
        self.program: list = []  # a token's number, or the places where it may go on
        self.write(wrapper)
        self.program.append(None)
        self.reached: dict[int, dict[str | None, list[int]]] = {}

    def write(self, nodes: list) -> None:
        for n in nodes:
            if not isinstance(n, list):
                self.program.append(len(self.tokens))
                self.tokens.append(n)
                continue
            begin = len(self.program)
            if n[0] == "?":
                self.program.append(None)
            self.write(n[1:])
            if n[0] == "+":
                self.program.append([begin, len(self.program) + 1])
            else:
                self.program[begin] = [begin + 1, len(self.program)]

    def after(self, at: int) -> dict[str | None, list[int]]:
        """By token, the places of tokens that may come next from a place of the program on; None is the end."""
        if at not in self.reached:
            found, todo, seen = {}, [at], set()
            while todo:
                k = todo.pop()
                if k in seen:
                    continue
                seen.add(k)
                step = self.program[k]
                if isinstance(step, list):
                    todo += reversed(step)
                else:
                    found.setdefault(None if step is None else self.tokens[step], []).append(k)
            self.reached[at] = found
        return self.reached[at]

    def match(self, stream: list[tuple[str, str]]) -> list[int] | None:
        """The wrapper's token for each token of a stream; None if the wrapper doesn't match."""
        steps, now = [], {-1: None}
        for token, _ in stream:
            following: dict[int, int] = {}
            for at in now:
                for k in self.after(at + 1).get(token, ()):
                    following.setdefault(k, at)
            if not following:
                return None
            steps.append(following)
            now = following
        at = next((k for k in now if None in self.after(k + 1)), None)
        if at is None:
            return None
        out = []
        for step in reversed(steps):
            out.append(self.program[at])
            at = step[at]
        return out[::-1]

    def blocks(self, stream: list[tuple[str, str]]) -> list[str] | None:
        """The blocks of main text; None if the wrapper doesn't match the stream or the stream lacks its main part."""
        way = self.match(stream)
        if way is None:
            return None
        if self.main < 0:
            return main_blocks(stream)
        begin = next((i for i, k in enumerate(way) if k == self.main), None)
        if begin is None:
            return None
        depth, end = 0, begin
        for end in range(begin, len(stream)):
            token = stream[end][0]
            depth += (token[0] == "<" and token not in ("<br", "<hr")) - (token[0] == ">")
            if not depth:
                break
        return main_blocks(stream[begin : end + 1])


def main_blocks(stream: list[tuple[str, str]]) -> list[str]:
    """The texts of a part of a stream outside furniture, one for each block."""
    out: list[str] = []
    stack: list[bool] = []
    parts: list[str] = []
    hidden = 0

    def flush() -> None:
        if line := " ".join(html.unescape("".join(parts)).split()):
            out.append(line)
        parts.clear()

    for token, text in stream:
        if text and not hidden:
            parts.append(text)
        if token == SLOT:
            continue
        tag = token.lstrip("<>!").partition(".")[0]
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if tag == "hr":
            continue
        if token[0] == "<":
            stack.append(token[1] == "!")
            hidden += stack[-1]
        elif stack:
            hidden -= stack.pop()
    flush()
    return out


@lru_cache(maxsize=2000)
def matcher(wrapper: str, main: int) -> Matcher:
    return Matcher(json.loads(wrapper), main)


def main_text(page: str, wrapper: str | None, main: int = -1) -> str:
    stream = list(tokens(page))
    found = matcher(wrapper, main).blocks(stream) if wrapper else None
    if found is None:
        own = folded([t for t, _ in stream])
        made = Matcher(own, -1)
        weights = {k: float(chars) for k, (chars, _) in slot_texts(stream, made.match(stream)).items()}  # matches by construction
        made.main = main_part(own, weights, 1)
        found = made.blocks(stream) or []
    return "\n".join(found)


def with_wrappers(pages: DataFrame, wrappers: DataFrame, chars: int, *columns: str) -> DataFrame:
    small = F.broadcast(wrappers) if chars <= BROADCAST_CHARS else wrappers
    return pages.join(small, "host", "left").select(*columns)


def infer(pages: DataFrame) -> tuple[DataFrame, int]:
    """For pages (host, html) the rows (host, wrapper as JSON, main), the main part beginning with that token of the wrapper; and
    how many characters all wrappers have."""
    shelf = Shelf(pages.sparkSession)

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found[host, json.dumps(stream_wrapper(page.as_py()))] = None
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.string()) for i in (0, 1)], ["host", "wrapper"])

    def join_group(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [joined(list(group["wrapper"]))]})

    level = shelf.keep(pages.mapInArrow(streams, "host string, wrapper string").distinct())
    while True:
        sizes = shelf.keep(level.groupBy("host").agg(F.count("*").alias("n")))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        dealt = level.join(sizes, "host").withColumn("bin", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / FAN)))
        level = shelf.keep(dealt.groupBy("host", "bin").applyInPandas(join_group, "host string, wrapper string"))
    chars = level.agg(F.sum(F.length("wrapper"))).first()[0] or 0

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page, wrapper in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                stream = list(tokens(page.as_py()))
                rows.append((host, -1, 0, 0))
                rows += [(host, k, *x) for k, x in slot_texts(stream, matcher(wrapper, -1).match(stream) or [0] * len(stream)).items()]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 3), strict=True)], ["host", "slot", "chars", "seen"])

    def place(one: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The main part of a host's wrapper; the row of slot -1 counts its pages."""
        count = int(found.loc[found["slot"] < 0, "pages"].sum())
        own = (found["kinds"] / found["pages"]).clip(upper=1.0)
        main = main_part(json.loads(one["wrapper"].iloc[0]), dict(zip(found["slot"], found["chars"] * own, strict=True)), count)
        return pd.DataFrame({"host": [one["host"].iloc[0]], "wrapper": [one["wrapper"].iloc[0]], "main": [main]})

    filled = with_wrappers(pages, level, chars, "host", "html", "wrapper").mapInArrow(slots, "host string, slot long, chars long, seen long")
    told = filled.groupBy("host", "slot", "seen").agg(F.sum("chars").alias("chars"), F.count("*").alias("pages"))
    texts = told.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("pages").alias("pages"), F.count("*").alias("kinds"))
    named = texts.withColumnRenamed("host", "of")
    return shelf.last(level.groupBy("host").cogroup(named.groupBy("of")).applyInPandas(place, "host string, wrapper string, main long")), chars


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page with its main text, by the wrapper of its host."""
    url = F.col(f"`{url_col}`")
    chosen = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.cast("string").alias("url"), host_of(url).alias("host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    wrappers, chars = infer(chosen.select("host", "html"))
    chosen = with_wrappers(chosen, wrappers, chars, "page_id", "url", "html", "wrapper", "main")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page.as_py(), *place) for page, *place in zip(part.column(2), *(part.column(k).to_pylist() for k in (3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [x.split()[0] for x in SCHEMA.split(", ")])

    return chosen.mapInArrow(run, SCHEMA)
