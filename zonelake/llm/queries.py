"""The queries of this subpackage: each numbered operator over its whole table, and the SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelake.llm import byte_bpe, conversation_repair, decontaminate, filter_audit, html_wrapper, license_scan, near_dedup, quality_classifier, quality_rules, secret_scan, suffix_tree_lm, url_filter, warc
from zonelake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: The pages have no date of their own; a fixed one keeps the records the same in every run.
FETCHED = "2024-01-01T00:00:00Z"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality_classifier.default_held_out())


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.detect(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests_only=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivatives of every page's response; the block, UTF-8 in both kinds, as text."""
    made = warc.derive(warc.from_pages(table(spark, sf_dir, "pages"), FETCHED))
    return made.withColumnRenamed("key", "page_id").withColumn("block", F.col("block").cast("string"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.cluster(table(spark, sf_dir, "documents"), size=2)


def op10_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"), suffix_tree_lm.default_held_out())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.detect(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_url_filter, op2_quality_classifier, op3_secret_scan, op4_decontaminate, op5_byte_bpe, op6_quality_rules, op7_html_wrapper, op8_warc, op9_near_dedup, op10_suffix_tree_lm, op11_filter_audit, op12_conversation_repair, op13_license_scan)}


# DuckDB SQL by other ways than the operators': nested loops over rules, unrolled propagation, joins of all shingles.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingle_sql(name: str, source: str, key: str, size: int, whole: bool) -> str:
    """CTEs of the distinct shingles (key, sh) of a table's texts; whole: a shorter text has its sequence as one."""
    text = LOWER.format("coalesce(text, '')")
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    short = "WHEN len(w) > 0 THEN [array_to_string(w, ' ')] " if whole else ""
    return f"""{name}_w AS (SELECT {key}, list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {source}),
{name} AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {size} THEN list_transform(range(1, len(w) - {size - 2}), lambda i: {joined}) {short}ELSE CAST([] AS VARCHAR[]) END) AS sh FROM {name}_w)"""


def url_filter_sql() -> str:
    rules = " UNION ALL ".join(f"SELECT '{v}' AS verdict, '{r}' AS rule, '{r.partition('/')[0]}' AS h, '/{r.partition('/')[2]}' AS p" for v, r in RULES)
    host = LOWER.format("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")
    steps = []
    for side, a, b in (("t", "src", "dst"), ("d", "dst", "src")):
        steps.append(f"{side}_e AS (SELECT {a} AS a, {b} AS b, CAST(pages AS DOUBLE) / sum(CAST(pages AS DOUBLE)) OVER (PARTITION BY {a}) AS share FROM ed)")
        column = "allowed" if side == "t" else "blocked"
        steps.append(f"{side}_s AS (SELECT host, {column} / (SELECT CAST(sum({column}) AS DOUBLE) FROM hs) AS rank FROM hs WHERE {column} > 0)")
        steps.append(f"{side}_m AS (SELECT 0 AS k, host, rank FROM {side}_s UNION ALL SELECT k + 1, b, sum(rank * share * {url_filter.DAMPING!r}) FROM {side}_m JOIN {side}_e ON host = a WHERE k < 150 GROUP BY k + 1, b)")
        steps.append(f"{side}_r AS (SELECT host, sum(rank) / (SELECT sum(rank) FROM {side}_m) AS rank FROM {side}_m GROUP BY host)")
    return f"""WITH RECURSIVE pg AS (SELECT page_id, coalesce({host}, '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages), ru AS ({rules}),
ft AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM pg LEFT JOIN ru ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2, 3),
h0 AS (SELECT host, sum(CASE verdict WHEN 'allow' THEN 1 WHEN 'block' THEN -1 ELSE 0 END) AS more FROM ft GROUP BY 1), hs AS (SELECT host, greatest(more, 0) AS allowed, greatest(-more, 0) AS blocked FROM h0),
lk AS (SELECT DISTINCT page_id, host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\\bhref\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s<>]+)', 1)) AS raw FROM pg),
ed AS (SELECT src, dst, count(*) AS pages FROM (SELECT src, {LOWER.format('raw')} AS dst FROM lk) WHERE src <> '' AND src <> dst GROUP BY 1, 2), {', '.join(steps)},
bo AS (SELECT host, sum(t) AS trust, sum(d) AS distrust FROM (SELECT host, rank AS t, 0.0 AS d FROM t_r UNION ALL SELECT host, 0.0, rank FROM d_r) GROUP BY 1)
SELECT page_id, ft.host, path, rule, coalesce(verdict, CASE WHEN distrust > {url_filter.THRESHOLD} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict, round(CAST(trust AS DOUBLE), 9) AS trust, round(CAST(distrust AS DOUBLE), 9) AS distrust
FROM ft LEFT JOIN bo ON ft.host = bo.host"""


CONTAINED = f"""WITH {shingle_sql("d", "documents", "doc_id", 5, False)}, {shingle_sql("b", "benchmark", "item_id", 5, False)}, q AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
c AS (SELECT doc_id, b.item_id, count(*) AS s FROM d JOIN b ON d.sh = b.sh GROUP BY 1, 2)
SELECT doc_id, c.item_id, n AS n_item, s AS n_shared FROM c JOIN q ON c.item_id = q.item_id WHERE 100 * s >= 80 * n"""

CLUSTERS = f"""WITH RECURSIVE {shingle_sql("s", "documents", "doc_id", 2, True)}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a), m AS (SELECT v, min(u) AS c FROM r GROUP BY 1)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, documents.doc_id) AS component_id, coalesce(c, documents.doc_id) = documents.doc_id AS kept
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN m ON m.v = documents.doc_id"""


def quality_rules_sql() -> str:
    """Windows by their texts, positions one by one, and histograms as rows."""
    q = quality_rules
    listed = " UNION ALL ".join(f"SELECT '{lang}' AS lang, '{w}' AS word" for lang, words in q.COMMON_WORDS.items() for w in words)
    rest, counts = ["regexp_replace(t, '[a-z]+', '', 'g')"], ["length(t) - length(r0)"]
    for k, pattern in enumerate(q.CLASSES):
        rest.append(f"regexp_replace(r{k}, '{pattern.replace("'", "''")}', '', 'g')")
        counts.append(f"length(r{k}) - length(r{k + 1})")
    chain = ", ".join(f"x{k} AS (SELECT *, {r} AS r{k} FROM {f'x{k - 1}' if k else 'tx'})" for k, r in enumerate(rest))
    counts.append(f"length(r{len(q.CLASSES)})")
    classes = " UNION ALL ".join(f"SELECT doc_id, lang, 'c{k}' AS bin, CAST({c} AS BIGINT) AS c FROM x{len(q.CLASSES)}" for k, c in enumerate(counts))

    def distance(name: str, bins: str, guard: str) -> str:
        return f"""{name}_n AS (SELECT doc_id, sum(c) AS n FROM {bins} GROUP BY 1), {name}_p AS (SELECT b.doc_id, b.lang, bin, c, n FROM {bins} b JOIN {name}_n x ON x.doc_id = b.doc_id WHERE n > 0),
{name}_f AS (SELECT p.lang, bin, sum(floor(CAST(c AS DOUBLE) * {q.PPM} / n)) AS r FROM {name}_p p JOIN us ON us.doc_id = p.doc_id GROUP BY 1, 2), {name}_t AS (SELECT lang, sum(r) AS total FROM {name}_f GROUP BY 1),
{name}_j AS (SELECT p.doc_id, CAST(c AS DOUBLE) / n AS u, CAST(r AS DOUBLE) / total AS v FROM {name}_p p JOIN {name}_f f ON f.lang = p.lang AND f.bin = p.bin JOIN {name}_t t ON t.lang = p.lang WHERE total > 0),
{name} AS (SELECT j.doc_id, sqrt(greatest(0.0, sum(CASE WHEN u > 0 THEN u * log2(u / ((u + v) / 2)) ELSE 0 END + CASE WHEN v > 0 THEN v * log2(v / ((u + v) / 2)) ELSE 0 END) / 2)) AS dist FROM {name}_j j JOIN sz ON sz.doc_id = j.doc_id WHERE {guard} GROUP BY 1)"""

    return f"""WITH tx AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(f"'{x}'" for x in q.COMMON_WORDS)}) THEN lang ELSE 'other' END AS lang FROM documents),
wd AS (SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM tx),
wi AS (SELECT doc_id, i, array_to_string(w[i:i + {q.WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i FROM wd)),
wc AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM wi), rp AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {q.WINDOW})) AS p FROM wc WHERE c > 1) GROUP BY 1),
sz AS (SELECT wd.doc_id, wd.lang, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, length(t) AS chars FROM wd LEFT JOIN rp ON rp.doc_id = wd.doc_id),
bf AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM sz), us AS (SELECT doc_id FROM bf WHERE NOT base_failed AND chars >= {q.MIN_CHARS} AND n_words >= {q.MIN_WORDS}),
{chain}, cl AS ({classes}), ls AS ({listed}), wl AS (SELECT doc_id, lang, lower(unnest(w)) AS word FROM wd WHERE lang <> 'other'),
cm AS (SELECT bf.doc_id, bf.lang, ls.word AS bin, 0 AS c FROM bf JOIN ls ON ls.lang = bf.lang UNION ALL SELECT wl.doc_id, wl.lang, coalesce(ls.word, '*'), 1 FROM wl LEFT JOIN ls ON ls.lang = wl.lang AND ls.word = wl.word UNION ALL SELECT doc_id, lang, '*', 0 FROM bf WHERE lang <> 'other'),
co AS (SELECT doc_id, lang, bin, CAST(sum(c) AS BIGINT) AS c FROM cm GROUP BY 1, 2, 3),
{distance("dc", "cl", f"chars >= {q.MIN_CHARS}")}, {distance("dw", "co", f"n_words >= {q.MIN_WORDS}")}
SELECT bf.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND NOT (coalesce(dc.dist > {q.MAX_CLASS_DISTANCE}, FALSE) OR coalesce(dc.dist + dw.dist > {q.MAX_SUM} + {q.LENGTH_SLACK} / n_words, FALSE)) AS kept, round(dc.dist, 6) AS class_distance, round(dw.dist, 6) AS word_distance
FROM bf LEFT JOIN dc ON dc.doc_id = bf.doc_id LEFT JOIN dw ON dw.doc_id = bf.doc_id"""


#: Every document goes through every order by itself.
AUDIT = """WITH RECURSIVE tx AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
lb AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
fa AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN min(tx.doc_id) OVER (PARTITION BY t) < tx.doc_id THEN 'E' ELSE '' END AS failed FROM tx LEFT JOIN lb ON lb.doc_id = tx.doc_id),
pe AS (SELECT '' AS o UNION ALL SELECT o || l FROM pe, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)), od AS (SELECT o, step, substr(o, step, 1) AS letter FROM pe, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) WHERE length(o) = 5),
ft AS (SELECT *, (SELECT coalesce(min(instr(o, x)), 9) FROM (SELECT unnest(string_split(failed, '')) AS x) WHERE x <> '') AS gone FROM fa, (SELECT DISTINCT o FROM od)),
st AS (SELECT part, od.o AS filter_order, step, letter, count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed, count(*) FILTER (contains(failed, letter) AND gone < step) AS redundant,
  count(*) FILTER (failed = letter) AS unique_fails, coalesce(sum(good) FILTER (gone = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost FROM ft JOIN od ON od.o = ft.o GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM st"""


#: The checksum of an ASCII text, bit by bit.
BIT = "xor(acc, CASE WHEN k % 8 = 0 THEN ascii(substr({0}, CAST(k // 8 + 1 AS BIGINT), 1)) ELSE 0 END)"
CRC32 = f"xor(list_reduce(list_concat([4294967295], range(8 * length({{0}}))), lambda acc, k: xor({BIT} >> 1, CASE WHEN {BIT} & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"


def repair_sql() -> str:
    """A recursion from the last row to the first, with the cheapest edits and the text that they make for each of the four states."""
    never = "{'cost': 1000000000, 'audit': '', 'made': CAST([] AS VARCHAR[])}"

    def put(of: str, letter: str, cost: str, line: str | None = None) -> str:
        return f"{{'cost': {of}.cost + {cost}, 'audit': '{letter}' || {of}.audit, 'made': {f'list_prepend({line}, {of}.made)' if line else f'{of}.made'}}}"

    def least(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}])[1]"

    def turned(made: str, to: str) -> str:
        """Ways to make a role from a row: kept or reroled, if it may stay."""
        own = put(to, "K", "(CASE status WHEN 1 THEN 5 ELSE 0 END)", "role || ':' || text")
        new = put(to, "R", "(CASE status WHEN 1 THEN 6 ELSE 1 END)", f"'{made}:' || text")
        return f"CASE WHEN status = 2 THEN {never} WHEN substr(role, 1, 1) = '{made[0]}' THEN {own} ELSE {new} END"

    user, assistant = (lambda to: put(to, "I", "5", "'user:'")), (lambda to: put(to, "I", "5", "'assistant:'"))
    system = f"CASE WHEN status <> 2 AND substr(role, 1, 1) = 's' THEN {put('f1', 'K', '(CASE status WHEN 1 THEN 5 ELSE 0 END)', "role || ':' || text")} ELSE {never} END"
    closed = f"{least('e0', user('f2'))} AS f0, {least('e1', user('f2'))} AS f1, f2, f3"
    half = f"e0, e1, {least('e2', assistant('e3'))} AS f2, {least('e3', user('e2'))} AS f3"
    return f"""WITH RECURSIVE hm AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, harm FROM (SELECT *, {CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS harm FROM conversations)),
dm AS (SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE harm WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hm WHERE harm <> 0),
nu AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM dm),
st AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, max(i) OVER (PARTITION BY conv_id) AS n FROM nu),
rw AS (SELECT *, CASE WHEN blank OR again THEN 2 WHEN cut THEN 1 ELSE 0 END AS status FROM st),
g AS (SELECT conv_id, n + 1 AS i, {closed} FROM (SELECT conv_id, n, {half} FROM (SELECT DISTINCT conv_id, n, {{'cost': 0, 'audit': '', 'made': CAST([] AS VARCHAR[])}} AS e0, {never} AS e1, {never} AS e2, {{'cost': 0, 'audit': '', 'made': CAST([] AS VARCHAR[])}} AS e3 FROM rw))
  UNION ALL SELECT conv_id, i, {closed} FROM (SELECT conv_id, i, {half} FROM (SELECT rw.conv_id, rw.i,
  {least(put('f0', 'D', '2'), turned('user', 'f2'), system)} AS e0, {least(put('f1', 'D', '2'), turned('user', 'f2'))} AS e1, {least(put('f2', 'D', '2'), turned('assistant', 'f3'))} AS e2, {least(put('f3', 'D', '2'), turned('user', 'f2'))} AS e3
  FROM g JOIN rw ON rw.conv_id IS NOT DISTINCT FROM g.conv_id AND rw.i = g.i - 1))),
co AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated,
  count(*) FILTER (before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM rw GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
CAST(coalesce(f0.cost, 0) AS BIGINT) AS cost, coalesce(f0.audit, '') AS audit, sha256(coalesce(array_to_string(f0.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN co ON co.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN g ON g.i = 1 AND g.conv_id IS NOT DISTINCT FROM c.conv_id"""


def license_sql() -> str:
    """Phrases and template words by their texts; the words that hits cover are counted one by one."""
    m = license_scan
    words = f"list_filter(regexp_split_to_array({LOWER.format('{}')}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    listed = " UNION ALL ".join(f"SELECT {k} AS template, '{name}' AS name, '{text}' AS text" for k, (name, text) in enumerate(m.TEMPLATES))
    phrases = " UNION ALL ".join(f"SELECT '{p}' AS phrase, {len(p.split())} AS size, '{name}' AS name" for p, name in m.PHRASES.items())
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(m.K))
    grams = f"unnest(list_transform(range(1, len(w) - {m.K - 2}), lambda i: {{'pos': i - 1, 'gram': {gram}}}), recursive := true)"
    return f"""WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {words.format("coalesce(text, '')")} AS w FROM documents), tw AS (SELECT template, name, {words.format("text")} AS w FROM ({listed})),
dg AS (SELECT r, {grams} FROM dw), tg AS (SELECT template, name, len(w) AS length, {grams} FROM tw), hi AS (SELECT r, template, name, length, dg.pos AS place, tg.pos AS pos, dg.pos - tg.pos AS diagonal FROM dg JOIN tg ON dg.gram = tg.gram),
di AS (SELECT DISTINCT r, template, length, diagonal FROM hi), ap AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= CASE WHEN length < {m.LONG} THEN 0 ELSE {m.SLACK} END THEN 0 ELSE 1 END AS apart FROM di),
sp AS (SELECT r, template, diagonal, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM ap), ct AS (SELECT hi.*, span, unnest(range(pos, pos + {m.K})) AS word FROM hi JOIN sp USING (r, template, diagonal)),
ve AS (SELECT r, name, count(DISTINCT word) AS covered, length FROM ct GROUP BY r, template, name, length, span HAVING (CASE WHEN length < {m.LONG} THEN count(DISTINCT word) = length ELSE count(DISTINCT word) >= {m.SHARE} * length END) AND max(place) + {m.K} - min(place) <= 2 * length),
me AS (SELECT r, list(DISTINCT name) AS names, max(covered / length) AS best FROM ve GROUP BY r),
pl AS (SELECT r, i - 1 AS place, name FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM dw), ({phrases}) WHERE array_to_string(w[i:i + size - 1], ' ') = phrase),
ba AS (SELECT r, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT name) AS names FROM pl GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(array_to_string(list_sort(ba.names), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(ba.names, me.names))), ','), '') AS labels, CAST(CASE WHEN n > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM dw LEFT JOIN ba ON ba.r = dw.r LEFT JOIN me ON me.r = dw.r"""


def oracle_sql() -> dict[str, str]:
    """Of the others, SQL has no spans with code points, tokenizer, parser or learned model; tests use brute force."""
    return {"op1_url_filter": url_filter_sql(), "op4_decontaminate": CONTAINED, "op6_quality_rules": quality_rules_sql(), "op9_near_dedup": CLUSTERS, "op11_filter_audit": AUDIT, "op12_conversation_repair": repair_sql(), "op13_license_scan": license_sql()}
