"""Operators on pages, components, the pipeline, and that the rest imports without this subpackage."""

import gzip
import itertools
import random
import subprocess
import sys
from pathlib import Path

import pytest
from conftest_llm import SCHEMA, prose, rows
from pyspark.sql import functions as F

from zonelake.llm import decontaminate, html_wrapper, near_dedup, quality_rules, secret_scan, url_filter, warc
from zonelake.llm.components import components

REPO = Path(__file__).resolve().parents[2]
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
PAGES = "page_id long, url string, html string, host string, rule string, text string"


def pages(spark, made):
    return spark.createDataFrame([(i, u, h, "h", "r", "t") for i, (u, h) in enumerate(made)], PAGES)


# Url filter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:at], rest[at:]
    return "".join(c.lower() if c.isascii() else c for c in host), path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def longest(host, path):
    fits = [(len(r), r, v) for v, r in RULES for h, p in [(r.partition("/")[0], "/" + r.partition("/")[2])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "https://example.org", "ftp://x.com/fr/?a", "http://x.com/de", "http://x.com/de/1", "http://b.net?x/y", "http://c.net#z", "http://notorg/es/", "http://İ.Org/a", "a://b://c.org/d"]


def test_url_rules(spark):
    got = {r.page_id: r for r in url_filter.judge(pages(spark, [(u, None) for u in URLS]), RULES).collect()}
    for i, url in enumerate(URLS):
        host, path = split(url)
        rule = longest(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule[0] if rule else None), url
        assert got[i].verdict == (rule[1] if rule else got[i].verdict) and got[i].verdict in ("allow", "block")
    assert got[0].verdict == got[1].verdict == "allow"
    assert url_filter.judge(pages(spark, []) if False else pages(spark, [(None, None)]).limit(0), RULES).count() == 0


def test_url_propagation(spark):
    link = lambda *hosts: "".join(f"<a href='https://{h}/x'>l</a>" for h in hosts)
    made = [("http://good.org/", link("friend.net")), ("http://bad.com/de/1", link("victim.net")), ("http://farm.net/", link("BAD.com", "bad.com")), ("http://friend.net/", None), ("http://victim.net/", ""), ("http://alone.net/", "")]
    got = {r.host: r for r in url_filter.judge(pages(spark, made), RULES).collect()}
    edges = {("good.org", "friend.net"): 1, ("bad.com", "victim.net"): 1, ("farm.net", "bad.com"): 1}

    def rank(links, seed):
        """Mass of hosts without links goes back to the seed at each of many steps."""
        score = {seed: 1.0}
        for _ in range(400):
            new = {seed: 1 - url_filter.DAMPING}
            for a, mass in score.items():
                out = {b: w for (x, b), w in links.items() if x == a} or {seed: 1}
                for b, w in out.items():
                    new[b] = new.get(b, 0) + url_filter.DAMPING * mass * w / sum(out.values())
            score = new
        return score

    trust, doubt = rank(edges, "good.org"), rank({(b, a): w for (a, b), w in edges.items()}, "bad.com")
    for host, r in got.items():
        assert (r.trust or 0) == pytest.approx(trust.get(host, 0)) and (r.distrust or 0) == pytest.approx(doubt.get(host, 0))
    assert {h: r.verdict for h, r in got.items()} == {"good.org": "allow", "bad.com": "block", "farm.net": "block", "friend.net": "allow", "victim.net": "allow", "alone.net": "allow"}


def test_url_propagation_goes_all_the_way(spark):
    """A chain far longer than one check, a cycle, and the SQL beside it."""
    import duckdb

    from zonelake.llm import queries

    hosts = ["good.org", *[f"h{k}.net" for k in range(30)]]
    made = [(f"http://{a}/", f"<a href=//{b}/>") for a, b in zip(hosts, [*hosts[1:], "h20.net"], strict=True)] + [("http://x.com/de/", ""), ("http://h25.net/", "<a href=//x.com>")] * 2
    table = pages(spark, made)
    got = {r.page_id: (r.verdict, r.trust, r.distrust) for r in url_filter.judge(table, RULES).collect()}
    con = duckdb.connect()
    con.register("pages", table.toPandas())
    names = ("page_id", "verdict", "trust", "distrust")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT {', '.join(names)} FROM ({queries.url_filter_sql()})").fetchall()}
    assert {i: r[0] for i, r in got.items()} == {i: r[0] for i, r in want.items()}
    for i, r in got.items():
        assert r[1:] == pytest.approx(want[i][1:], abs=2e-9) and (r[1] or 0) > 0 or r[2] > 0
    assert len(got) == len(made)


def test_url_filter_is_native(spark):
    plan = url_filter.judge(pages(spark, [("http://a.org/", link) for link in ("<a href=//b.net/>", "")]), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_rules_are_native(spark):
    plan = quality_rules.judge(spark.createDataFrame(rows(["a b c"]), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Main text


def page(body, nav=2, extra="", tail=""):
    menu = "".join(f'<li><a href="/{k}">Menu {k}</a></li>' for k in range(nav))
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{menu}</ul></nav><!-- ad --><div class="ad">Buy</div>{extra}<article>{body}</article>{tail}<footer>&copy; f</footer></body></html>'


CASES = [
    (page("<h1>Title</h1><p>One &amp; two\n three<br>four</p><p>Five</p>"), "Title\nOne & two three four\nFive"),
    (page("<h1>A</h1><p><b>Bold<br><p>next</p>", 5), "A\nBold\nnext"),
    (page("<p>x</p>", extra="<header><h2>Site</h2></header><aside>Side</aside>", tail='<section id="comments"><p>Reader says</p></section>'), "x"),
    (page('<p>a</p><div class="cookie-notice">We use</div><form><p>Mail</p><input></form><ul><li>i<li>j</ul>'), "a\ni\nj"),
    ("<html><body><main><p>m1</p><p>m2 &lt;b&gt;</p></main><div class='sidebar'>no</div></body></html>", "m1\nm2 <b>"),
    ("<html><body><div><p>p1</p><p>p2</p></div><footer>f</footer></body></html>", "p1\np2"),
    ("", ""), (None, ""), ("<html><body></body></html>", ""), ("<nav>only</nav>", ""), (page("<p>&#233;&nbsp;&eacute;</p>"), "é é"), (page("<p>" + "long " * 5000 + "</p>"), ("long " * 5000).strip()),
]


def test_main_text(spark):
    made = [(None if i == 7 else f"http://h{i % 3}.net/{i}", h) for i, (h, _) in enumerate(CASES)] * 2
    got = {r.page_id: r for r in html_wrapper.extract(pages(spark, made)).collect()}
    assert len(got) == len(made)
    for i, (_, text) in enumerate(CASES * 2):
        assert (got[i].text, got[i].n_chars) == (text, len(text)), i
    assert html_wrapper.extract(pages(spark, made).limit(0)).count() == 0


def test_space_between_tags():
    assert html_wrapper.main_text(page("<p><b>foo</b> <i>bar</i>\n<a>x</a><a>y</a></p> <p>z</p>"), None) == "foo bar xy\nz"


def test_main_part_without_article(spark):
    """What the host repeats is left out and what varies stays, whatever its elements are called."""
    rng = random.Random(9)
    made, want = [], []
    for k in range(40):
        parts = [prose(rng, rng.randint(4, 12)) for _ in range(rng.randint(1, 5))]
        body = "".join(f"<p>{x}</p>" for x in parts)
        made.append(("http://one.net/", f"<html><body><div><p>Welcome to our site, which we hope you like very much indeed, dear reader.</p></div><div class='t{k}'><h1>{k}</h1>{body}</div><div><p>All rights reserved by the owner of this site, since the year of its foundation.</p></div></body></html>"))
        want.append("\n".join([str(k), *parts]))
    got = {r.page_id: r.text for r in html_wrapper.extract(pages(spark, made)).collect()}
    assert sum(got[k] == want[k] for k in range(40)) >= 38
    for name in ("div", "section", "main"):
        renamed = [(f"http://h{i % 3}.net/{i}", page(f"<h1>t {i}</h1>" + "".join(f"<p>{prose(rng, 9)}</p>" for _ in range(i % 4 + 1)))) for i in range(24)]
        plain = {r.page_id: r.text for r in html_wrapper.extract(pages(spark, renamed)).collect()}
        other = [(u, h.replace("<article", f"<{name}").replace("</article", f"</{name}")) for u, h in renamed]
        assert {r.page_id: r.text for r in html_wrapper.extract(pages(spark, other)).collect()} == plain


def test_odd_markup():
    text = lambda h: html_wrapper.main_text(h, None)
    assert text("<article><p class=x'>b</p><p title=\"a>b\">c</p></article>") == "b\nc"
    assert text("<article><header><h1>T</h1></header><p>b</p></article><header>Site</header>") == "T\nb"
    assert text("<div>" * 300 + "x" + "</div>" * 300) == "x"
    assert text("<p>" + "a <b" * 50) == text("<p>a &lt;b" + "a &lt;b" * 49)


def matches(wrapper, tokens):
    """Brute force: whether a wrapper matches, by trying all splits."""
    if not wrapper:
        return not tokens
    head, rest = wrapper[0], wrapper[1:]
    if not isinstance(head, list):
        return bool(tokens) and tokens[0] == head and matches(rest, tokens[1:])
    if head[0] == "?":
        return matches(head[1:] + rest, tokens) or matches(rest, tokens)
    return any(matches(head[1:], tokens[:k]) and (matches(rest, tokens[k:]) or matches([head, *rest], tokens[k:])) for k in range(1, len(tokens) + 1))


def test_alignment_and_automaton():
    rng = random.Random(1)

    def stream():
        return [t for _ in range(rng.randint(0, 4)) for t in rng.choice((["<p", "#", ">p"], ["<b", ">b"], ["#"], ["<p", "<b", "#", ">b", ">p"]))]

    agreed = 0
    for _ in range(150):
        a, b, c = stream(), stream(), stream()
        wrapper = html_wrapper.aligned(html_wrapper.folded(a), html_wrapper.folded(b))
        made = html_wrapper.Matcher(wrapper, -1)
        for tokens in (a, b, c):
            way = made.match([(t, "") for t in tokens])
            assert (way is not None) == matches(wrapper, tokens)
            assert way is None or [made.tokens[k] for k in way] == tokens
            agreed += way is not None
        assert matches(wrapper, a) and matches(wrapper, b)
    assert agreed < 450


def test_alignment_of_very_long_pages(monkeypatch):
    monkeypatch.setattr(html_wrapper, "CELLS", 10)
    a, b = (["<x", *(t for k in ks for t in (f"<t{k}", f">t{k}")), ">x"] for ks in (range(8), range(4, 16)))
    made = html_wrapper.Matcher(html_wrapper.aligned(a, b), -1)
    assert all(made.match([(t, "") for t in x]) for x in (a, b))


def test_alignment_is_the_same_at_every_size(monkeypatch):
    """The result doesn't depend on how many cells an alignment has or may hold, and is that of the plain table of lengths."""

    def plain(x, y):
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, j in itertools.product(reversed(range(len(x))), reversed(range(len(y)))):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + (x[i] == y[j]))
        i = j = 0
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and x[i] == y[j]:
                step = "both"
            else:
                step = "a" if j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]) else "b"
            yield step
            i, j = i + (step != "b"), j + (step != "a")

    rng = random.Random(11)
    for cells in (10, html_wrapper.CELLS):
        monkeypatch.setattr(html_wrapper, "CELLS", cells)
        for _ in range(200):
            x, y = ([rng.randint(0, rng.choice((2, 9))) for _ in range(rng.randint(0, 40))] for _ in range(2))
            assert list(html_wrapper.common(x, y)) == list(plain(x, y))
    a, b = (["<x", *(t for k in ks for t in (f"<t{k}", "#", f">t{k}")), ">x"] for ks in (range(800), range(400, 1200)))
    made = html_wrapper.aligned(a, b)  # 5.8 million cells
    assert made == ["<x", ["?", *a[1:1201]], *a[1201:-1], ["?", *b[1201:-1]], ">x"]


def test_optional_groups_are_whole():
    """What one page has and the other lacks is there as a whole or not at all, so tags can't cross; also after a third page."""
    body = lambda *inner: ["<body", *inner, ">body"]
    h2, ul = ["<h2", "#", ">h2"], ["<ul", "<li", "#", ">li", ">ul"]
    a, b, c = body(*h2, "<p", "#", ">p", *ul), body("<p", "#", ">p"), body(*h2, "<p", "#", ">p")
    made = html_wrapper.aligned(a, b)
    assert made == ["<body", ["?", *h2], "<p", "#", ">p", ["?", *ul], ">body"]
    both = html_wrapper.aligned(made, c)
    match = lambda w, t: html_wrapper.Matcher(w, -1).match([(x, "") for x in t]) is not None
    for w in (made, both):
        assert all(match(w, t) for t in (a, b, c, body("<p", "#", ">p", *ul)))
        assert not match(w, body("<h2", "#", "<p", "#", ">p", ">ul")) and not match(w, body("<h2", "#", ">ul", "<p", "#", ">p")) and not match(w, body("<h2", ">h2", "<p", "#", ">p"))


def test_names_inside_an_article(spark):
    """Words in names of an article's own parts don't make them furniture; whole names and those of containers do."""
    text = "<article><h1>T</h1><p class='social-history'>one</p><blockquote class=\"side-note\">two</blockquote><p id=related-work>three</p><div class='ad'>buy</div><div class='share-buttons'>x</div><div class='post comments'>c</div></article>"
    made = [("http://one.net/", f"<html><body><nav>m</nav>{text}<div class='site-footer'>f</div></body></html>")]
    found = html_wrapper.extract(pages(spark, made)).first()
    assert found.text == "T\none\ntwo\nthree"


def test_wrappers_match_all_pages(spark):
    rng = random.Random(3)
    made = [page("".join(f"<h2>{prose(rng, 3)}</h2>" * rng.randint(0, 1) + f"<p>{prose(rng, 5)}</p>" * rng.randint(0, 4) for _ in range(rng.randint(1, 3))), rng.randint(0, 4), "<div class='x'><p>e</p></div>" * rng.randint(0, 1)) for _ in range(60)]
    found = html_wrapper.infer(spark.createDataFrame([("one.net", h) for h in made], "host string, html string"))[0].collect()
    assert len(found) == 1
    matcher = html_wrapper.matcher(found[0].wrapper, found[0].main)
    assert all(matcher.blocks(list(html_wrapper.tokens(h))) is not None for h in made)
    assert '["+"' in found[0].wrapper and '["?"' in found[0].wrapper


# WARC


def test_warc_round_trip(spark, tmp_path):
    made = [("http://a.net/x", page("<h1>T &amp; t</h1><p>b\nc</p>")), (None, None), ("http://b.net/ü", "<p>ünï</p>"), ("http://b.net/ü", "<p>ünï</p>")]
    responses = warc.from_pages(pages(spark, made), "2024-01-01T00:00:00Z")
    out = warc.derive(responses).collect()
    assert len(out) == 2 * len(made)
    source = {r.record_id: r for r in responses.collect()}
    for r in out:
        s = source[r.refers_to]
        assert r.target_uri == s.target_uri and r.block_digest == warc.digest(bytes(r.block)) and r.content_length == len(r.block)
        assert f"WARC-Refers-To: {s.record_id}" in r.warc_headers
        if r.warc_type == "metadata":
            assert f"source-payload-digest: {s.payload_digest}" in bytes(r.block).decode() and "source-http-header: HTTP/1.1 200 OK" in bytes(r.block).decode()
        else:
            assert r.http_headers == s.http_headers and f"WARC-Source-Payload-Digest: {s.payload_digest}" in r.warc_headers
    texts = {r.key: bytes(r.block).decode() for r in out if r.warc_type == "conversion"}
    assert texts == {0: "Menu 0\nMenu 1\nBuy\nT & t\nb c\n© f", 1: "", 2: "ünï", 3: "ünï"}
    for name, options in (("plain", {}), ("gz", {"compression": "gzip"})):
        warc.to_text(responses).coalesce(1).write.options(**options).text(str(tmp_path / name))
        back = warc.read(spark, str(tmp_path / name / "part*"))
        key = lambda r: (r.record_id, r.block, r.warc_headers, r.http_headers, r.target_uri)
        assert sorted(map(key, back.collect())) == sorted(map(key, responses.collect()))
        again = warc.derive(back)
        assert sorted((r.record_id, r.block) for r in again.collect()) == sorted((r.record_id, r.block) for r in out)
    assert warc.derive(responses.limit(0)).count() == 0


def test_warc_members():
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    data = gzip.compress(one) + gzip.compress(one.replace(b"<a>", b"<b>"))
    assert [r[2] for r in warc.records_in(data)] == ["<a>", "<b>"] and list(warc.records_in(b"")) == []


def plain_records(data):
    """An independent parser of sound files: (id, block) by stated lengths."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        out.append((fields[b"WARC-Record-ID"].decode(), rest[:size]))
        assert rest[size : size + 4] == b"\r\n\r\n"
        data = rest[size + 4 :]
    return out


def warc_file(blocks):
    return [b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(x), x) for i, x in enumerate(blocks)]


def test_warc_sound_files(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 37)
    rng = random.Random(2)
    blocks = [bytes(rng.choice(b"ab\r\nWARC/1.0: \xff") for _ in range(rng.randint(0, 200))) for _ in range(50)] + [b"", b"\r\n\r\nWARC/1.0\r\nContent-Length: 1\r\n\r\n"]
    parts = warc_file(blocks)
    want = plain_records(b"".join(parts))
    for data in (b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        assert [(r[2], r[-1]) for r in warc.records_in(data)] == want


@pytest.mark.parametrize("size", ["4", "6", "9999", "-1", "x", "", "1e3"])
def test_warc_damaged_files(size):
    first, second, third = warc_file([b"hello", b"world", b"again"])
    wrong = second.replace(b"Content-Length: 5", b"Content-Length: " + size.encode())
    assert [(r[2], r[-1]) for r in warc.records_in(first + wrong + third)] == [("<0>", b"hello"), ("<1>", b"world"), ("<2>", b"again")]
    kinds = [(r[1], r[-1], r[9]) for r in warc.records_in(first + b"junk\r\n\r\n" + third[:-6])]
    assert kinds == [("response", b"hello", 5), ("skipped", b"", 8), ("response", b"aga", 3)]
    broken = bytearray(gzip.compress(second))
    broken[20] ^= 255
    assert "<2>" in [r[2] for r in warc.records_in(gzip.compress(first) + bytes(broken) + gzip.compress(third))]
    assert list(warc.records_in(b"no warc at all"))[0][1] == "skipped"


@pytest.mark.parametrize("charset", ["undefined", "no-such", "hex", "idna", "utf-16", "latin-1"])
def test_warc_charsets_and_encodings(charset):
    page = "<p>caf\u00e9 \u2013 ok</p>" if charset == "utf-16" else "<p>caf\u00e9 ok</p>"
    raw = page.encode(charset if charset in ("utf-16", "latin-1") else "utf-8")
    squeezed = gzip.compress(raw)
    chunked = b"%x;x=1\r\n%s\r\n%x\r\n%s\r\n0\r\n\r\n" % (5, squeezed[:5], len(squeezed) - 5, squeezed[5:])
    for head, body in ((b"", raw), (b"Content-Encoding: gzip\r\n", squeezed), (b"Content-Encoding: GZIP\r\nTransfer-Encoding: chunked\r\n", chunked), (b"Content-Encoding: br\r\n", raw), (b"Transfer-Encoding: chunked\r\n", raw)):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=" + charset.encode() + b"\r\n" + head + b"\r\n" + body
        meta, conversion = warc.derivatives(1, "<r>", "http://a/", "d", None, block, None)
        assert conversion[-1].decode() == page[3:-4], (charset, head)
        assert f"source-payload-digest: {warc.digest(body)}".encode() in meta[-1]


# Components


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 90)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2060), rng.randrange(2000, 2060)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.v: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: find(v) for v in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Pipeline


def test_pipeline(spark, tmp_path):
    import public_tokenizers

    import corpus_pipeline

    rng = random.Random(7)
    good = [prose(rng, 120) for _ in range(25)]
    item = prose(rng, 30)
    texts = [*good, good[3] + " x", "too short", f"{prose(rng, 60)} {item} {prose(rng, 60)}", prose(rng, 60) + " password: hunter2hunter2 " + prose(rng, 60), None, ""]
    docs = spark.createDataFrame(rows(texts), SCHEMA).withColumn("lang", F.lit("en")).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(25), 28}
    kept = quality_rules.judge(docs).where("kept")
    rest = docs.join(kept.select("doc_id"), "doc_id").select(*docs.columns)
    one = near_dedup.cluster(rest, 5).where("kept").select("doc_id")
    rest = decontaminate.clean(rest.join(one, "doc_id").select(*docs.columns), spark.read.parquet(str(tmp_path / "benchmark.parquet")))
    clean = {r.doc_id: r.text for r in secret_scan.redact(rest).collect()}
    assert clean[28].count("[secret]") == 1 and "hunter2" not in clean[28]
    from zonelake.llm import byte_bpe

    bpe = byte_bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {i: r.ids for i, r in got.items()} == {i: bpe.plain.encode_ordinary(t) for i, t in clean.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "secret scan", "byte-level BPE"]


def test_pipeline_odd_tables(spark, tmp_path):
    """An empty table; repeated rows, null ids and columns whose names the operators use themselves."""
    import corpus_pipeline

    rng = random.Random(3)
    a, b, c = (prose(rng, 90) for _ in range(3))
    schema = "doc_id long, text string, lang string, source string, n_chars long, v string, kept int, region string, tile int, ids string"
    made = [(1, a), (1, a), (2, b), (None, c), (3, a + " end"), (4, None), (5, "")]
    for name, rows_ in (("none", []), ("some", made)):
        folder = tmp_path / name
        spark.createDataFrame([(i, t, "en", "s", 1, "x", 2, "y", 3, "z") for i, t in rows_], schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(0, prose(rng, 40))], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(folder))
            assert docs.columns == spark.read.parquet(str(folder / "documents.parquet")).columns
        out = corpus_pipeline.run(spark, str(folder))
        assert sorted(str(r.doc_id) for r in out.collect()) == (["1", "1", "2", "None"] if rows_ else [])
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_imports_without_this_subpackage(tmp_path):
    """A copy without the llm folders and the pipeline still imports and has the other queries."""
    import shutil

    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "r")}, timeout=120)
