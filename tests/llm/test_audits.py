"""Filter audit, conversation repair and license scans against brute force, and on odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest_llm import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonelake.llm import conversation_repair as cr
from zonelake.llm import filter_audit, license_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, part string, mask string, good int, toxic int, n string"
LABELS = "doc_id long, quality int, toxic int, part string"
TALKS = "conv_id long, turn long, role string, text string, kind string, phase string, digest int"
LAWS = "doc_id long, text string, template string, place int, hash string, covered int"


# Filter audit


def audited(docs, labels):
    """Applies the filters one after another, for every order."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = {}
    for part in {s or "" for _, _, s in docs}:
        rows = []
        for i, text, source in docs:
            if (source or "") == part:
                text = text or ""
                words = WORD.findall(text)
                failed = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), bool(set(text) & set("#$%&*|")), i is not None and first[text] < i]
                marks = [(q, t) for j, q, t in labels if j == i and i is not None]
                rows.append(({x for x, f in zip("ABCDE", failed, strict=True) if f}, any(q == 1 for q, _ in marks), any(t == 1 for _, t in marks)))
        total = dict.fromkeys("ABCDE", 0)
        mine = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                total[x] += len(gone)
                redundant = sum(x in r[0] for r in rows) - len(gone)
                mine[part, order, step] = (len(left), len(gone), redundant, sum(r[0] == {x} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
        out |= {k: (*v, total[k[1][k[2] - 1]]) for k, v in mine.items()}
    return out


def test_filter_audit(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "# one", "ABC def", prose(rng, 250), prose(rng, 220) + " $", "w " * 500, "Ab " * 300, " ".join(map(str, range(400))), "x" * 1_000_000, "A" * 300_000 + " é"]
    docs = [(i, rng.choice(texts), rng.choice([None, "", "a", "hot", "hot", "hot"])) for i in range(150)]
    docs += [docs[7], docs[7], (None, "", "a"), (None, texts[5], None), (3, "other text of id 3", "hot")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame([(*d, "p", "m", 5, 6, "n") for d in docs], DOCS)
    found = filter_audit.audit(table, spark.createDataFrame([(*x, "q") for x in labels], LABELS))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}
    assert got == audited(docs, labels) and len(got) == 600 * 3


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None, "p", "m", 5, 6, "n")], DOCS), labels)
    assert one.count() == 600 and one.agg(F.sum("removed")).first()[0] == 120  # only the first filter says no to an empty text


# Conversations


def brute(rows):
    """(cost, audit, repaired) by the plain recursion over rows and produced roles."""
    options = {}

    def best(i, last):
        """Least (cost, audit, lines) from row i on; last: '', 's', 'u' or 'a' was produced before."""
        if (i, last) in options:
            return options[i, last]
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        needed = "a" if last == "u" else "u"
        if i < len(rows):
            role, text, gone, cut = rows[i]
            ways.append(add(best(i + 1, last), 2, "D"))
            if not gone:
                more = 5 if cut else 0
                if role[:1] == needed:
                    ways.append(add(best(i + 1, needed), more, "K", f"{role}:{text}"))
                else:
                    ways.append(add(best(i + 1, needed), more + 1, "R", f"{names[needed]}:{text}"))
                if role[:1] == "s" and last == "":
                    ways.append(add(best(i + 1, "s"), more, "K", f"{role}:{text}"))
        # Two insertions in a row at most are of use.
        options[i, last] = None
        for depth in (1, 2):
            chain, at = [], last
            for _ in range(depth):
                at = "a" if at == "u" else "u"
                chain.append(f"{names[at]}:")
            tail = plain(i, at)
            if tail:
                for line in reversed(chain):
                    tail = add(tail, 5, "I", line)
                ways.append(tail)
        options[i, last] = min((w for w in ways if w), default=None)
        return options[i, last]

    def plain(i, last):
        """As best(), without an insertion first."""
        if i == len(rows):
            return (0, "", ()) if last in ("", "a") else None
        role, text, gone, cut = rows[i]
        needed, ways = "a" if last == "u" else "u", [add(best(i + 1, last), 2, "D")]
        if not gone:
            more = 5 if cut else 0
            ways.append(add(best(i + 1, needed), more, "K", f"{role}:{text}") if role[:1] == needed else add(best(i + 1, needed), more + 1, "R", f"{names[needed]}:{text}"))
            if role[:1] == "s" and last == "":
                ways.append(add(best(i + 1, "s"), more, "K", f"{role}:{text}"))
        return min((w for w in ways if w), default=None)

    def add(way, cost, letter, line=None):
        return way and (way[0] + cost, letter + way[1], ((line,) if line is not None else ()) + way[2])

    names = {"u": "user", "a": "assistant"}
    return best(0, "")


def expected(rows):
    """All figures of one conversation's rows after damage, in order."""
    seen, judged, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        words = WORD.findall(text)
        blank, again, cut = not words, (role, text) in seen, bool(words) and words[-1][-1] not in ".!?"
        seen.add((role, text))
        for k, fault in enumerate((blank, again, cut)):
            if fault:
                counts[k] += 1
                break
        judged.append((role, text, blank or again, cut))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, lines = brute(judged)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


ROLES = ["system", "user", "assistant", "tool", "", " ", "u2"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.sampled_from(range(3))), max_size=12))
def test_repair_of_rows(rows):
    """The automaton against the recursion: cost, audit and what comes out."""
    automaton = cr.Automaton()
    repair = cr.Repair(automaton)
    for role, status in rows:
        repair.read(3 * (cr.INITIALS.find(role[:1]) if role and role[0] in cr.INITIALS else 3) + status)
    repair.finish()
    cost, audit, lines = brute([(role, str(k), status == cr.DELETE, status == cr.TRUNCATED) for k, (role, status) in enumerate(rows)])
    assert (repair.cost, "".join(x for x, _ in repair.edits())) == (cost, audit)
    made = "".join(line[0] for line in lines)
    assert not made or re.fullmatch("s?(ua)+", made)


def test_repair_automaton_is_small():
    """Every kind of row in every order: the table closes, so a scan needs no memory of the conversation."""
    automaton = cr.Automaton()
    for state in itertools.count():
        if state == len(automaton.vectors):
            break
        for kind in range(12):
            automaton.step(state, kind)
        assert state < 500
    assert 4 < len(automaton.vectors) < 100


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if harm == 4 else role, "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text)
        out += [] if harm == 0 else [row, row] if harm == 3 else [row]
    return out


def check_repair(spark, rows):
    found = cr.repair(cr.damage(spark.createDataFrame([(*r, "k", "p", 1) for r in rows], TALKS))).collect()
    place = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest())
    want = {c: expected([r[1:] for r in sorted((x for x in damaged(rows) if x[0] == c), key=place)]) for c in {r[0] for r in rows}}
    assert {r[0]: tuple(r)[1:] for r in found} == want and len(found) == len(want)


def test_repair(spark):
    rng = random.Random(8)
    texts = ["Fine.", "Fine.", "cut", "", " \n", None, "Ende! ", "x?\n", "no end, ünï 𝔘", ". . .", "Long. " * 20000]
    rows = [(rng.choice([*range(40), None]), rng.choice([*range(8), None]), rng.choice([*ROLES, "user", "assistant", None]), rng.choice(texts)) for _ in range(600)]
    rows += rows[:50] + [(900, t, None, None) for t in range(5)] + [(901, None, "user", "Ja."), (902, 5, "user", "A."), (902, 5_000_000_000, "assistant", "B.")]
    rows += [(k, 0, "user", "Gone.") for k in range(1000, 1200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]  # no row is left of these
    check_repair(spark, rows)


def test_repair_of_one_long_conversation(spark):
    """One conversation with nearly all rows, many of them equal, over several batches."""
    rng = random.Random(9)
    rows = [(1, t // 2 if t % 5 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["Same text.", f"Text {t}.", f"cut {t}"])) for t in range(30_000)]
    found = cr.repair(cr.damage(spark.createDataFrame([(*r, "k", "p", 1) for r in [*rows, (2, 0, "user", "Hi.")]], TALKS))).collect()
    after = damaged(rows)
    seen, duplicates = set(), 0
    for r in after:
        duplicates += r[2:] in seen and r[3] != ""
        seen.add(r[2:])
    big = next(r for r in found if r.conv_id == 1)
    assert (big.duplicate, big.gaps) == (duplicates, 1 + max(r[1] for r in after if r[1] is not None) - min(r[1] for r in after if r[1] is not None) - len({r[1] for r in after if r[1] is not None}))
    assert sum(x in "DKR" for x in big.audit) == len(after)


def test_repair_of_nothing(spark):
    assert cr.repair(cr.damage(spark.createDataFrame([], TALKS))).count() == 0


# Licenses


def scanned(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(i, name) for i in range(len(words)) for p, name in license_scan.PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    labels, best, k = {name for _, name in places}, 0.0, license_scan.K
    for name, template in license_scan.TEMPLATES:
        own = re.findall(r"[a-z0-9]+", template.lower())
        hits = sorted((i - j, i, j) for i in range(len(words) - k + 1) for j in range(len(own) - k + 1) if words[i : i + k] == own[j : j + k])
        spans = []
        for hit in hits:
            if not spans or hit[0] - spans[-1][-1][0] > (license_scan.SLACK if len(own) >= license_scan.LONG else 0):
                spans.append([])
            spans[-1].append(hit)
        for span in spans:
            covered = len({j + x for _, _, j in span for x in range(k)})
            length = max(i for _, i, _ in span) + k - min(i for _, i, _ in span)
            if length <= 2 * len(own) and (covered == len(own) if len(own) < license_scan.LONG else covered >= license_scan.SHARE * len(own)):
                labels.add(name)
                best = max(best, covered / len(own))
    starts = [i for i, _ in places]
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in places})), ",".join(sorted(labels)), 1.0 if starts else best)


@pytest.fixture(scope="module")
def laws():
    rng = random.Random(4)
    long = [t for _, t in license_scan.TEMPLATES if len(t.split()) > 16]
    edited = [" ".join(w for w in t.split() if rng.random() > 0.05) for t in long] + [" ".join(x for w in t.split() for x in ([w, "really"] if rng.random() < 0.06 else [w])) for t in long]
    texts = [None, "", " \t\n", "mit", "MIT license", "The MIT-License. mit license, Apache\nLicense general public license mit licenses", "GENERAL public\x00license", "généralpublic license mit license"]
    texts += [f"{prose(rng, 30)} {t}. {prose(rng, 30)}" for _, t in license_scan.TEMPLATES] + edited + [prose(rng, 3000) + " " + long[0]]
    texts += ["this software " * 2000, "in the License. You may " * 300, long[0] + " " + long[0], "licensed under the general public license", "word " * 200_000 + "Licensed under CC BY-NC 4.0. mit license", "x" * 1_000_000]
    return list(enumerate(texts)) + [(5, texts[5]), (5, "other"), (None, texts[8]), (None, texts[8]), (None, None)]


def test_license_scan(spark, laws):
    found = license_scan.detect(spark.createDataFrame([(*x, "t", 1, "h", 2) for x in laws], LAWS).repartition(5)).collect()
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r) for r in found) == order((i, *scanned(t)) for i, t in laws)
    by_id = {r.doc_id: r for r in found}
    assert by_id[4].base_labels == by_id[4].labels == "mit" and max(r.n_base for r in found if r.doc_id == 5) == 4


def test_license_labels(spark):
    texts = [t for _, t in license_scan.TEMPLATES]
    found = license_scan.detect(spark.createDataFrame([(i, f"Some words. {t}, and more.", "t", 1, "h", 2) for i, t in enumerate(texts)], LAWS)).collect()
    assert all(license_scan.TEMPLATES[r.doc_id][0] in r.labels.split(",") and r.score == 1.0 for r in found)
    assert {r.labels for r in found if "cc-by-nc" in r.labels} == {"cc-by-nc"}


def test_license_scan_of_nothing(spark):
    assert license_scan.detect(spark.createDataFrame([], LAWS)).count() == 0
