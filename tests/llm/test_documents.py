"""Operators on documents against brute force, and on odd tables."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD, SCHEMA, prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonelake.llm import byte_bpe, decontaminate, near_dedup, quality_classifier, quality_rules, secret_scan, shingle_sets, suffix_tree_lm

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts, size):
    out = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


def components_of(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


# Secrets


def base_spans(text):
    out = []
    kinds = (
        (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "assign", lambda m: len(m[2]) >= 8),
        (r"AKIA[A-Z0-9]+", "access", lambda m: len(m[0]) >= 16),
        (r"[0-9a-f]+", "hex", lambda m: len(m[0]) >= 32),
    )
    for k, (pattern, kind, ok) in enumerate(kinds):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m)]
    return sorted(out)


PIECES = ["password", "SECRET", "api_key", "apikey", "token", "=", ": ", '"', "'", "abcdefgh1", "x", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", " ", "İ", "paſſword", "K", "\n", "𝔘"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_secret_base_spans(text):
    assert [x for x in secret_scan.scan(text, secret_scan.automaton()) if x[1] < 3] == base_spans(text)


def test_secret_checksums():
    body = "A" * 30
    good, bad = body + secret_scan.base62_crc(body), body + "000000"
    keywords = secret_scan.automaton()
    assert [x[2] for x in secret_scan.scan(f"x ghp_{good} y", keywords)] == ["ghtoken:2:42"]
    assert [x[2] for x in secret_scan.scan(f"npm_{good}", keywords)] == ["npmtoken:0:40"]
    assert secret_scan.scan(f"ghp_{bad} aghp_{good} ghp_{good}z GHP_{good}", keywords) == []


def test_secret_tables(odd, empty):
    found = {r.doc_id: r for r in secret_scan.detect(odd).collect()}
    assert secret_scan.detect(odd).count() == odd.count()
    assert (found[9].n_assign, found[9].spans) == (1, "assign:0:25") and found[0].spans == found[1].spans == ""
    assert found[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan.detect(empty).count() == 0
    clean = {r.doc_id: r.text for r in secret_scan.redact(odd).collect()}
    assert clean[9] == "[secret]" and clean[0] is None and clean[7] == ODD[7]
    assert secret_scan.redact(odd).columns == odd.columns


# Tokens


@pytest.fixture(scope="module")
def bpes():
    big = byte_bpe.load(PATH, PATTERN)
    return big, byte_bpe.ByteBPE(big.ranks, PATTERN, leaf=8)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=200), st.lists(st.sampled_from(["ab", "'s", " ", "\n", "  ", "é", "日本", "\x1c", "\xa0", "\x85", "!?", "aaaaaaaaaaaa", "1234", "'ll"]), max_size=60).map("".join)))
def test_bpe_joins(bpes, text):
    text = text.encode("utf-8", "ignore").decode()
    for bpe in bpes:
        ids = bpe.encode(text)
        assert ids == bpe.plain.encode_ordinary(text) and bpe.decode(ids) == text.encode()


def test_bpe_long_pretokens(bpes):
    rng = random.Random(5)
    for text in ("a" * 3000, "".join(rng.choice("abcdeéß") for _ in range(4000)), " " * 1500 + "x", "!?" * 900 + "y" * 700):
        assert bpes[1].encode(text) == bpes[0].plain.encode_ordinary(text)


def test_bpe_text_without_spaces(bpes):
    """One run of letters between words: a few times the work of a text with spaces, not one per level."""
    import time

    rng = random.Random(8)
    run = "".join(rng.choice("日本語の文章を書くとき句読点") for _ in range(80_000))
    began = time.process_time()
    ids = bpes[0].encode(f"two words {run} and more")
    assert time.process_time() - began < 3
    assert bpes[0].decode(ids).decode() == f"two words {run} and more"
    for text in (run[:9000], f"a b {run[:5000]} c {run[:3000]}!"):
        assert bpes[0].encode(text) == bpes[0].plain.encode_ordinary(text)
    assert bpes[1].encode(run[:3000]) == bpes[0].plain.encode_ordinary(run[:3000])


def test_bpe_tables(odd, empty, bpes):
    out = byte_bpe.encode(odd, PATH, PATTERN)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count() and byte_bpe.encode(empty, PATH, PATTERN).count() == 0
    for i, text in enumerate(ODD):
        assert got[i].ids == bpes[0].plain.encode_ordinary(text or "")
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.decode(out, PATH, PATTERN).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))


# Quality rules


def surface(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def test_quality_rules(spark, odd, empty):
    rng = random.Random(1)
    phrase = prose(rng, 12)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(40)] + [f"{phrase} {prose(rng, 30)} {phrase} {phrase}", "a | b\n" * 5, *[prose(rng, 150).upper().replace(" ", "!! ") for _ in range(3)]]
    docs = spark.createDataFrame(rows([*ODD, *texts]), SCHEMA).withColumn("lang", F.lit("en"))
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, text in enumerate([*ODD, *texts]):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == surface(text), text
        assert not (r.base_failed and r.kept)
    assert not any(got[len(ODD) + 42 + k].kept for k in range(3))
    assert all(got[len(ODD) + k].kept for k in range(40) if not got[len(ODD) + k].base_failed)
    assert quality_rules.judge(odd).count() == odd.count() and quality_rules.judge(empty).count() == 0


def test_js_distance(spark):
    a = spark.sql("select array(1L, 3L, 0L) a, array(2L, 0L, 2L) b, array(0L, 0L, 0L) z")
    p, q = [0.25, 0.75, 0], [0.5, 0, 0.5]
    kl = lambda x, m: sum(u * math.log2(u / v) for u, v in zip(x, m, strict=True) if u)
    m = [(u + v) / 2 for u, v in zip(p, q, strict=True)]
    got = a.select(quality_rules.js_distance(F.col("a"), F.col("b")), quality_rules.js_distance(F.col("a"), F.col("a")), quality_rules.js_distance(F.col("a"), F.col("z"))).first()
    assert got[0] == pytest.approx(math.sqrt((kl(p, m) + kl(q, m)) / 2)) and got[1] == 0 and got[2] is None


# Near-duplicates


def families(rng, n=12):
    out = []
    for _ in range(n):
        base = prose(rng, rng.randint(30, 120)).split()
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(["amber", "cobalt", "violet", "ochre"])
            out.append(" ".join(copy))
    return [*out, *out[:7]]


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(spark, size):
    texts = [*ODD, *families(random.Random(size))]
    got = {r.doc_id: r for r in near_dedup.cluster(spark.createDataFrame(rows(texts), SCHEMA), size).collect()}
    sets = sets_of(dict(enumerate(texts)), size)
    want = components_of(sets)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}


def test_near_dedup_crowded_region(spark, monkeypatch):
    """More members than a region may have, down to the last depth."""
    monkeypatch.setattr(near_dedup, "REGION", 4)
    rng = random.Random(3)
    base = prose(rng, 80).split()
    texts = []
    for k in range(60):
        copy = list(base)
        copy[rng.randrange(80)] = f"w{k}"
        texts.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in near_dedup.cluster(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert got == components_of(sets_of(dict(enumerate(texts)), 2))


def test_near_dedup_links_within_one_crowded_region(spark, monkeypatch):
    """Hundreds of near copies under 0.8 of each other, and pairs among them that are linked to nothing else."""
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    rng = random.Random(11)
    base = prose(rng, 120).split()

    def edited(words, n, name):
        copy = list(words)
        for k in rng.sample(range(len(copy)), n):
            copy[k] = f"{name}w{k}"
        return copy

    texts = []
    for k in range(150):
        copy = edited(base, 9, f"x{k}")
        texts.append(" ".join(copy))
        if k % 10 == 0:
            texts.append(" ".join(edited(copy, 4, f"y{k}")))
    rng.shuffle(texts)
    sets = sets_of(dict(enumerate(texts)), 2)
    want = components_of(sets)
    got = {r.doc_id: r.component_id for r in near_dedup.cluster(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert got == want and 10 < len(set(want.values())) < 160


def test_near_dedup_small_sets_at_the_limit(spark):
    """Pairs of 4 and 5, and of 16 and 20 shingles, whose similarity is 0.8 exactly."""
    texts = []
    for k in range(300):
        n = (5, 20)[k % 2]
        w = [f"{k}v{i}" for i in range(n + 1)]
        texts += [" ".join(w), " ".join(w[: n - n // 5 + 1])]
    got = {r.doc_id: r.component_id for r in near_dedup.cluster(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert sum(got[2 * k + 1] != 2 * k for k in range(300)) == 0


def test_near_dedup_repeated_ids(spark):
    a, b, c = (f"{x} " * 3 + f"{x}1 {x}2 {x}3 {x}4 {x}5 {x}6 {x}7 {x}8 {x}9" for x in "abc")
    docs = spark.createDataFrame([(5, a), (5, a), (5, b), (2, a), (7, b), (9, c), (9, c), (None, c)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.cluster(docs).collect())
    assert got == [(0, 0, True), (2, 2, True), (5, 2, False), (5, 2, False), (5, 2, False), (7, 2, False), (9, 9, True), (9, 9, True)]


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_shingle_sets(monkeypatch, piece):
    """As sets of the words themselves, for texts that are hashed in slices and in pieces."""
    import pyarrow as pa

    monkeypatch.setattr(shingle_sets, "PIECE", piece)
    rng = random.Random(4)
    texts = ["", " ", *(t or "" for t in ODD), "A\x0bb\x0cc", "x" * 200 + " y " + "x" * 200, *(prose(rng, rng.randint(1, 80)).upper() for _ in range(60))]
    column = pa.array(["skipped", *texts]).slice(1)
    for size in (1, 2, 5):
        found = [x for at, end in shingle_sets.slices(column) for x in shingle_sets.sets(column.slice(at, end - at), size)]
        want = sets_of(dict(enumerate(texts)), size)
        assert [len(x) for x in found] == [len(want[i]) for i in range(len(texts))]
        for i in range(0, len(texts), 5):
            for j in range(len(texts)):
                assert len(set(found[i].tolist()) & set(found[j].tolist())) == len(want[i] & want[j])


def test_near_dedup_tables(odd, empty):
    out = near_dedup.cluster(odd)
    assert out.count() == odd.count() and near_dedup.cluster(empty).count() == 0
    nameless = [r for r in out.collect() if r.doc_id is None]
    assert [(r.n_shingles, r.component_id, r.kept) for r in nameless] == [(0, None, True)]


# Benchmark items


def test_decontaminate(spark, odd, empty):
    rng = random.Random(4)
    items = [prose(rng, n) for n in (3, 9, 20, 40, 59)]
    cut = items[3].split()
    texts = [*ODD, *[f"{prose(rng, 200)} {x} {prose(rng, 2000)}" for x in items], f"{prose(rng, 50)} {' '.join(cut[:37])} {prose(rng, 50)}", " ".join(cut[:20]), items[4].upper()]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    d, b = sets_of(dict(enumerate(texts)), 5), sets_of(dict(enumerate(items)), 5)
    want = {(i, k, len(s), len(s & d[i])) for i in d for k, s in b.items() if k and 100 * len(s & d[i]) >= 80 * len(s)}
    assert {tuple(r) for r in decontaminate.contained(docs, bench).collect()} == want and len(want) >= 5
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == set(d) - {x[0] for x in want}
    assert decontaminate.contained(empty, bench).count() == decontaminate.contained(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.clean(odd, bench).count() == odd.count()


def test_decontaminate_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 20)
    rng = random.Random(8)
    items = [prose(rng, 25) for _ in range(6)]
    docs = spark.createDataFrame(rows([f"{x} {prose(rng, 20)}" for x in items]), SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained(docs, bench).collect()} == {(i, i) for i in range(6)}
    assert decontaminate.clean(docs, bench).count() == 0


# Language model


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "HEAD", 0.01)
    rng = random.Random(6)
    texts = [*ODD, *[prose(rng, rng.randint(1, 60)) for _ in range(80)]]
    made = rows(texts)
    docs = spark.createDataFrame([*made, made[3], made[12]], SCHEMA)
    got = suffix_tree_lm.score(docs, suffix_tree_lm.default_held_out()).collect()
    assert len(got) == len(made) + 2
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    words = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in enumerate(texts)}
    c = collections.Counter(w for i in [*words, 3, 12] if not out[i] for w in words[i])
    n, v = sum(c.values()), len(c)
    for r in got:
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w))
        assert r.score < 0


def test_language_model_brute_force(spark, monkeypatch):
    """Scores from dictionaries: shares, spellings by the tree's own distributions, and branches from the word before."""
    import numpy as np

    monkeypatch.setattr(suffix_tree_lm, "HEAD", 0.02)
    lm, rng = suffix_tree_lm, random.Random(16)
    passage = " ".join(f"rare{k}" for k in rng.sample(range(1000), 30))
    often = " ".join(["often oddword"] * 10 + ["often"] * 40)
    texts = [often, *[prose(rng, rng.randint(0, 60)) for _ in range(59)]] + [passage, passage, " ".join(reversed(passage.split()))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") >= 62).collect()}
    words = {i: WORD.findall(t.translate(LOWER)) for i, t in enumerate(texts)}
    training = [words[i] for i in range(62)]
    c = collections.Counter(w for ws in training for w in [*ws, None])
    pairs = collections.Counter(p for ws in training for p in zip([0, *ws], ws, strict=False))
    n = sum(c.values())
    contexts = {0: len(training), **{w: k for w, k in c.items() if w is not None}}
    chars = collections.Counter(x for ws in training for w in ws for x in w + " ")
    symbol = {x: 2 + k for k, (x, _) in enumerate(sorted(chars.items(), key=lambda x: (-x[1], ord(x[0])))[: lm.ALPHABET])}
    table = np.full(lm.CODE_POINTS, lm.OTHER, np.uint8)
    table[[ord(x) for x in symbol]] = list(symbol.values())
    counted = collections.Counter(int(k) for ws in training for k in lm.grams(*lm.code_points([" ".join(ws) + " " * bool(ws)]), table)[0])
    kept, logs = lm.tree(lm.candidate_contexts(spark.createDataFrame(list(counted.items()), "key long, n long")))
    state = lm.states(kept)

    def spelling(word):
        """Symbol by symbol; the end mark is a token of itself."""
        seen, total = [lm.END] * lm.DEPTH, 0.0
        for s in [lm.END] if word is None else [symbol.get(x, lm.OTHER) for x in word + " "]:
            total += float(logs[state[sum(x << lm.BITS * k for k, x in enumerate(seen))], s]) - (math.log10(lm.CODE_POINTS) if s == lm.OTHER else 0)
            seen = [s, *seen[:-1]]
        return total

    once = (sum(k == 1 for k in c.values()) or 0.5) / n
    head = {w for w, k in c.items() if k >= lm.HEAD * n}
    share = {(p, w): (k - lm.DISCOUNT) / contexts[p] for (p, w), k in pairs.items() if k > 1 and w not in head and k * math.log(k / contexts[p] * n / c[w]) > lm.WORD_DIVERGENCE}
    rest = {p: 1 - sum(x for (q, _), x in share.items() if q == p) for p in contexts}
    assert any(p in head for p, _ in share) and any(p not in head for p, _ in share) and min(rest.values()) > 0

    def token(prev, w):
        own = (1 - once) * c[w] / n + once * 10 ** spelling(w)
        return rest.get(prev, 1) * own + share.get((prev, w), 0)

    # After every context the tokens of training add up to one, but for the spelling of others.
    spelled = once * (1 - sum(10 ** spelling(w) for w in c))
    for prev in contexts:
        assert sum(token(prev, w) for w in c) + rest[prev] * spelled == pytest.approx(1)
    for i, ws in words.items():
        want = sum(math.log10(token(prev, w)) for prev, w in zip([0, *ws], [*ws, None], strict=True))
        assert got[i] == pytest.approx(want, rel=1e-5), i
    assert got[61] == got[60] > got[62] + 40


@pytest.mark.parametrize("frequent", [1e-6, 0.005])
def test_language_model_follows_every_word(spark, monkeypatch, frequent):
    """Branches lead to frequent words as well, whichever way a branch is looked up; what tokens cost alone is from texts of one word."""
    lm, rng = suffix_tree_lm, random.Random(23)
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "BITMAP", 8)
    passage = " ".join(f"rare{k}" for k in rng.sample(range(1000), 30))
    common = "river stone river lamp stone lamp lamp river"
    texts = [" ".join(["often oddword"] * 10 + ["often"] * 40), *[prose(rng, rng.randint(0, 60)) for _ in range(59)], passage, passage, f"{common} the {common}", f"{common} a {common}"]
    words = [WORD.findall(t.translate(LOWER)) for t in texts]
    c = collections.Counter(w for ws in words for w in [*ws, None])
    pairs = collections.Counter(p for ws in words for p in zip([0, *ws], ws, strict=False))
    n, single = sum(c.values()), [w for w in c if w is not None]
    docs = spark.createDataFrame(list(enumerate([*texts, "", *single])), "doc_id long, text string")
    score = lambda: {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") >= len(texts)).collect()}
    got = score()
    monkeypatch.setattr(lm, "HEAD", 0)
    alone = score()
    end = alone[len(texts)]
    own = {None: end, **{w: alone[len(texts) + 1 + k] - end for k, w in enumerate(single)}}
    contexts = {0: len(texts), **{w: c[w] for w in single}}
    share = {(p, w): (k - lm.DISCOUNT) / contexts[p] for (p, w), k in pairs.items() if k > 1 and k * math.log(k / contexts[p] * n / c[w]) > lm.WORD_DIVERGENCE}
    rest = collections.Counter(contexts.keys())
    for (p, _), x in share.items():
        rest[p] -= x
    kinds = {(c[w] >= frequent * n, c[p] >= frequent * n, pairs[p, w] >= frequent * n) for p, w in share}
    assert kinds >= ({(True, True, True)} if frequent < 0.001 else {(True, True, True), (True, True, False), (True, False, False), (False, True, False), (False, False, False)})
    for i, ws in enumerate(words):
        want = sum(math.log10(rest[p] * 10 ** own[w] + share.get((p, w), 0)) for p, w in zip([0, *ws], [*ws, None], strict=True))
        assert got[i] == pytest.approx(want, rel=1e-5), i


def test_language_model_rows(spark, monkeypatch):
    """Looking up words and branches writes no row for each occurrence, and scores don't depend on blocks and buckets."""
    lm, rng = suffix_tree_lm, random.Random(31)
    monkeypatch.setattr(lm, "FREQUENT", 0.002)
    vocabulary = [f"{'often' if k < 150 else 'rare'}{k}" for k in range(450)]
    texts = [" ".join(rng.sample(vocabulary, 450) + rng.choices(vocabulary[:150], k=150)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    sizes, keep = [], lm.Shelf.keep

    def kept(self, df):
        out = keep(self, df)
        sizes.append(out.count())
        return out

    def scores():
        return {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") % 5 == 0).collect()}

    monkeypatch.setattr(lm.Shelf, "keep", kept)
    want = scores()
    assert max(sizes) < 8_000 < sum(len(t.split()) for t in texts) // 2
    for name, value in (("GATHERED", 3_000), ("BUCKET", 2_000), ("ASKED_BUCKET", 4_000)):
        monkeypatch.setattr(lm, name, value, raising=False)
    assert scores() == pytest.approx(want, rel=1e-9)


def test_language_model_long_unknown_word(spark):
    """A word whose spelling is less than the least number costs its spelling, twice if there twice."""
    rng = random.Random(37)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(900))
    texts = [prose(rng, 50) for _ in range(20)] + ["", word, f"{word} {word}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffix_tree_lm.score(docs, F.col("doc_id") >= 20).collect()}
    assert got[21] - got[20] < -400 and got[22] - got[21] == pytest.approx(got[21] - got[20], abs=5)


def test_packed_pairs(spark):
    """Codes of pairs of places are distinct, the same for columns and arrays, and lead back; what is dealt comes back in its bucket."""
    import numpy as np

    lm = suffix_tree_lm
    for n_head in (0, 1, 30, 1_000_000):
        rng = np.random.default_rng(n_head)
        word, prev = rng.integers(0, n_head + 1, 500), rng.integers(0, n_head + 1, 500)
        code = lm.mixed_code(word, prev, n_head)
        assert code.min() >= 0 and int(code.max()) < 1 << lm.code_bits(n_head) and all((x == y).all() for x, y in zip(lm.places_of(code, n_head), (word, prev), strict=True))
        made = spark.createDataFrame(list(zip(word.tolist(), prev.tolist(), strict=True)), "word long, prev long")
        assert [r[0] for r in made.select(lm.mixed_code(F.col("word"), F.col("prev"), n_head)).collect()] == code.tolist()
    for bits in (10, 40, 64):
        keys = np.sort(np.r_[rng.integers(0, (1 << bits) - 1, 400, np.uint64, endpoint=True), np.uint64(0), np.uint64((1 << bits) - 1)])
        keys = np.sort(np.r_[keys, keys[::3]])
        bucket, size, steps, each, distinct = (x.to_pylist() for x in lm.dealt(keys, 7, bits, np.arange(len(keys)), keys.astype(float)))
        assert bucket == list(range(7)) and np.concatenate([lm.ascending(b, k) for b, k in zip(steps, size, strict=True)]).tolist() == keys.tolist()
        assert np.concatenate([lm.unpacked(b, k) for b, k in zip(each, size, strict=True)]).tolist() == list(range(len(keys)))
        parts = [np.unique(lm.ascending(b, k)) for b, k in zip(steps, size, strict=True)]
        assert [lm.unpacked(d, len(p), "<f8").tolist() for d, p in zip(distinct, parts, strict=True)] == [p.astype(float).tolist() for p in parts]


def test_words_of_the_language_model():
    """Words, lower-cased, with the space behind them, against an expression; equal words have equal hashes and others don't."""
    texts = [*[t or "" for t in ODD], "", " \t", "a", "A b\x0b\x0cB  \r\n a ", "\x1f\x08 \u00a0x\u2003y \u0130 \U0001f600", "x" * 5000, "ab ba aab aba baa"]
    hashes, lengths, points, sizes = suffix_tree_lm.split(texts)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) for t in texts]
    assert lengths.tolist() == [len(w) for w in words]
    assert "".join(map(chr, points)) == "".join(f"{x} " for w in words for x in w) and sizes.tolist() == [sum(len(x) + 1 for x in w) for w in words]
    known = dict(zip((x for w in words for x in w), hashes.tolist(), strict=True))
    assert hashes.tolist() == [known[x] for w in words for x in w] and len(set(known.values())) == len(known)


def test_language_model_is_a_distribution(spark):
    """Spellings of all tokens of a small alphabet add up to less than one, and near to it with the end mark."""
    import numpy as np

    symbol = np.full(suffix_tree_lm.CODE_POINTS, suffix_tree_lm.OTHER, np.uint8)
    symbol[[32, 97, 98]] = 2, 3, 4
    points, lengths = suffix_tree_lm.code_points(["ab a ", "a ", "bb ab "])
    key, _ = suffix_tree_lm.grams(points, lengths, symbol)
    counted = spark.createDataFrame([(int(k), int(n)) for k, n in zip(*np.unique(key, return_counts=True), strict=True)], "key long, n long")
    kept, logs = suffix_tree_lm.tree(suffix_tree_lm.candidate_contexts(counted))
    assert np.allclose((10.0 ** logs.astype(float)).sum(1), 1, atol=1e-5)
    state = suffix_tree_lm.states(kept)
    assert state.max() < len(logs)


def test_language_model_tables(odd, empty):
    out = suffix_tree_lm.score(odd, F.lit(False)).collect()
    assert len(out) == odd.count() and suffix_tree_lm.score(empty, F.lit(False)).count() == 0
    untrained = suffix_tree_lm.score(odd, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in untrained)


# Quality classifier


def test_classifier(spark, odd, empty):
    rng = random.Random(2)
    good = [prose(rng, 80) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 80).split()) for _ in range(60)]
    texts = [t for pair in zip(good, bad, strict=True) for t in pair]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(len(texts))], "doc_id long, quality int")
    got = quality_classifier.score(docs, labels, quality_classifier.default_held_out()).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and held
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert quality_classifier.score(odd, labels, F.lit(False)).count() == odd.count()
    assert quality_classifier.score(empty, labels, F.lit(False)).count() == 0
    none = quality_classifier.score(docs, labels.limit(0), F.lit(False)).collect()
    assert all(r.score == 0.5 for r in none)
    nulls = labels.withColumn("quality", F.lit(None).cast("int"))
    assert all(r.score == 0.5 for r in quality_classifier.score(docs, nulls, F.lit(False)).collect())



def test_classifier_pools_in_little_memory():
    """Pooling holds a few numbers for each word, not all of the word's features at once."""
    rng, size = np.random.default_rng(4), 200_000
    words = [pa.array([np.int32(low) + rng.integers(0, 4096, size // 20, dtype=np.int32) for _ in range(20)], pa.list_(pa.int32())) for low in (0, 4096)]
    part = pa.RecordBatch.from_arrays(words, ["hash", "shape"])
    index = quality_classifier.index_vectors()
    tracemalloc.start()
    found = quality_classifier.pooled(part, index, index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(found[3, :32], index[np.array(words[0][3].as_py())].mean(0), atol=1e-4) and peak < 200 * size


def test_classifier_vectors_and_pooling(spark):
    """The table of vectors and the pooled documents against sums in plain Python."""
    rng = random.Random(5)
    texts = {i: prose(rng, rng.randint(1, 40)) for i in range(15)} | {15: None, 16: "", 17: "one", 18: "same same Same sAme", 19: "river " * 3000}
    docs = spark.createDataFrame(rows([texts[i] for i in sorted(texts)]), SCHEMA)
    docs = docs.unionByName(docs.where("doc_id = 3"))
    keyed = quality_classifier.prepared(docs, "text", F.col("doc_id"))
    keys = [list(zip(r[1], r[2], strict=True)) for r in keyed.collect()]
    index = quality_classifier.index_vectors()
    sums = collections.defaultdict(lambda: np.zeros(quality_classifier.DIMENSIONS))
    for words in keys:
        for at, pair in enumerate(words):
            for other in range(max(0, at - 2), min(len(words), at + 3)):
                if other != at:
                    for bucket in pair:
                        sums[bucket] += index[words[other][0]] + index[words[other][1]]
    got = quality_classifier.word_vectors(docs, "text")
    for bucket in range(quality_classifier.BUCKETS):
        length = np.linalg.norm(sums[bucket])
        assert np.allclose(got[bucket], sums[bucket] / length if length else 0, atol=1e-6)
    for part in keyed.toArrow().to_batches():
        for i, row in zip(part.column(0).to_pylist(), quality_classifier.pooled(part, got, index), strict=True):
            words, (hashes, shapes) = WORD.findall(texts[i] or ""), zip(*keys[i], strict=True) if keys[i] else ((), ())
            means = [np.mean(table[list(k)], axis=0) if k else np.zeros(quality_classifier.DIMENSIONS) for table, k in ((got, hashes), (got, shapes), (index, shapes))]
            again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words))
            assert np.allclose(row, [*np.concatenate(means), again, math.log1p(len(words))], atol=1e-4)
