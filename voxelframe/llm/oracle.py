"""SQL for the queries of this subpackage, over the tables as views.

Each is a plain statement of the contract, exact strings in place of hashes and
self joins in place of searches, so that it shares nothing with the operators
but their parameters. BPE and the classifier have no SQL form.
"""

from __future__ import annotations

from . import mixing, quality_rules, url_filter
from .url_filter import LOWER, UPPER

_WORD = r"[^\x20\x09-\x0D]+"


def _words(text: str = "text", name: str = "w") -> str:
    """CTEs that end in ``name`` (doc_id, i, w): every word with its place from 1."""
    return f"""{name}l AS (SELECT doc_id, regexp_extract_all(coalesce({text}, ''), '{_WORD}') AS ws FROM documents),
{name} AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM {name}l)"""


def _over(by: str = "doc_id") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY i)"


def _op1() -> str:
    # Digests of 2, 4, ... 32 words, each of two halves; 50 = 32 + 16 + 2. Null where the text ends first.
    steps, last = ["d1 AS (SELECT doc_id, i, w, w AS h1 FROM w)"], "d1"
    for k in (2, 4, 8, 16, 32):
        steps.append(f"d{k} AS (SELECT *, md5(h{k // 2} || ' ' || lead(h{k // 2}, {k // 2}) {_over()}) AS h{k} FROM {last})")
        last = f"d{k}"
    return f"""WITH {_words()}, {', '.join(steps)},
win AS (SELECT doc_id, i, w, h32 || lead(h16, 32) {_over()} || lead(h2, 48) {_over()} AS h FROM d32),
seen AS (SELECT h, min(doc_id) AS low FROM win WHERE h IS NOT NULL GROUP BY h),
hit AS (SELECT win.doc_id, i, w, coalesce(win.doc_id > low, FALSE) AS x FROM win LEFT JOIN seen USING (h)),
cov AS (SELECT doc_id, i, w, bool_or(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hit),
got AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS g, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM cov GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(g, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN got USING (doc_id)"""


def _op3() -> str:
    return """WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def _op4() -> str:
    u = url_filter
    part = lambda k: f"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {k})"
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(u.RULES, key=lambda r: -len(r.pattern))
    pick = lambda out: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{out(r)}'" for r in longest) + " END"
    steps = []
    # A level a turn: children, the crowded ones as wildcards, labelled ones numbered by share, folded into branches.
    for k in range(u.DEPTH + 1):
        steps.append(f"""a{k} AS (SELECT *, seg[{k + 1}] AS child FROM v{k} WHERE len(seg) > {k}),
c{k} AS (SELECT a.* REPLACE (CASE WHEN child <> '**' AND (SELECT count(DISTINCT o.child) FROM a{k} o WHERE o.host = a.host AND o.br = a.br AND o.child NOT IN ('*', '**')) > {u.MOST_SIBLINGS} THEN '*' ELSE child END AS child) FROM a{k} a),
t{k} AS (SELECT host, br, child, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(b) AS DOUBLE) AS b, min(p) AS p FROM c{k} GROUP BY ALL HAVING sum(n) > 0),
s{k} AS (SELECT *, row_number() OVER (PARTITION BY host, br ORDER BY b / n, child) AS i FROM t{k}),
f{k} AS (SELECT host, br, child, i, p, n, b, n AS bn, b AS bb, 1 AS g FROM s{k} WHERE i = 1 UNION ALL
SELECT s.host, s.br, s.child, s.i, s.p, s.n, s.b, CASE WHEN d THEN s.n ELSE f.bn + s.n END, CASE WHEN d THEN s.b ELSE f.bb + s.b END, f.g + CASE WHEN d THEN 1 ELSE 0 END
FROM (SELECT f.host, f.br, f.i, f.bn, f.bb, f.g, abs(f.bb / f.bn - s.b / s.n) > {u.Z} * sqrt((f.bb + s.b) / (f.bn + s.n) * (1 - (f.bb + s.b) / (f.bn + s.n)) * (1 / f.bn + 1 / s.n)) AS d
FROM f{k} f JOIN s{k} s ON s.host = f.host AND s.br = f.br AND s.i = f.i + 1) f JOIN s{k} s ON s.host = f.host AND s.br = f.br AND s.i = f.i + 1),
m{k} AS (SELECT host, br, child, string_agg(child, '/') OVER q AS label, (sum(b) OVER q + {u.STRENGTH} * p) / (sum(n) OVER q + {u.STRENGTH}) AS np FROM f{k} WINDOW q AS (PARTITION BY host, br, g ORDER BY child ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
v{k + 1} AS (SELECT v.host, v.seg, v.n, v.b, v.told, CASE WHEN c.child IS NULL THEN v.br ELSE v.br || '//' || coalesce(m.label, c.child) END AS br, coalesce(m.np, v.p) AS p
FROM v{k} v LEFT JOIN c{k} c ON c.host = v.host AND c.seg = v.seg LEFT JOIN m{k} m ON m.host = c.host AND m.br = c.br AND m.child = c.child)""")
    return f"""WITH RECURSIVE hp AS (SELECT page_id, translate({part(1)}, '{UPPER}', '{LOWER}') AS host, {part(2)} AS path FROM pages),
r AS (SELECT *, {pick(lambda r: r.pattern)} AS rule, {pick(lambda r: r.verdict)} AS said, [CASE WHEN regexp_matches(x, '[0-9]') OR length(x) > {u.LONG_SEGMENT} THEN '*' ELSE x END FOR x IN string_split(path, '/') IF x <> ''] AS all_seg FROM hp),
rs AS (SELECT *, all_seg[1:{u.DEPTH}] || CASE WHEN len(all_seg) > {u.DEPTH} THEN ['**'] ELSE [] END AS seg FROM r),
lf AS (SELECT host, seg, count(said) AS n, count(*) FILTER (WHERE said = 'block') AS b FROM rs GROUP BY ALL),
v0 AS (SELECT host, seg, n, b, sum(n) OVER w AS told, '' AS br, (sum(b) OVER w + {u.STRENGTH} * (SELECT coalesce(sum(b) / nullif(sum(n), 0), 0) FROM lf)) / (sum(n) OVER w + {u.STRENGTH}) AS p FROM lf WINDOW w AS (PARTITION BY host)),
{', '.join(steps)}
SELECT page_id, rs.host, path, rule, coalesce(said, CASE WHEN told > 0 AND round(p, 9) >= {u.REJECT} THEN 'block' ELSE 'allow' END) AS verdict FROM rs JOIN v{u.DEPTH + 1} v ON v.host = rs.host AND v.seg = rs.seg"""


def _op5() -> str:
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    more = " || ' ' || ".join(f"lead(w, {k}) {_over()}" for k in range(1, 5))
    return f"""WITH RECURSIVE {_words(lower)},
g AS (SELECT doc_id, w || ' ' || {more} AS g FROM w),
sh AS (SELECT DISTINCT doc_id, g FROM g WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM wl WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.other = e.a),
comp AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)"""


def _op6() -> str:
    w = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(mixing.WEIGHTS))
    cap = mixing.LIMIT
    # The level rises round by round: what is above its stop is taken out, and the rest is shared again by weight.
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {w} END AS w FROM d GROUP BY source),
lv AS (SELECT 1 AS k, (SELECT sum(n) * 1.0 / sum(w) FROM s) AS level UNION ALL
SELECT k + 1, (SELECT ((SELECT sum(n) FROM s) - coalesce(sum({cap} * n) FILTER (WHERE level * w > {cap} * n), 0)) * 1.0 / sum(w) FILTER (WHERE level * w <= {cap} * n) FROM s) FROM lv WHERE k < 20),
t AS (SELECT source, n, round(least({cap} * n, w * (SELECT max(level) FROM lv)), 6) AS target FROM s),
r AS (SELECT *, CASE WHEN n > 0 THEN least(target / n, {cap}) ELSE 0 END AS rate FROM t),
u AS (SELECT d.*, n, target, rate, CAST('0x' || substr(md5('{mixing.SEED}:' || d.key), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, CAST(target AS DOUBLE) AS target,
CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM u"""


def _op7() -> str:
    stop = ", ".join(f"'{x}'" for x in sorted(set(quality_rules.STOP_WORDS)))
    rules = []
    for r in quality_rules.RULES:
        value = f"({r.expression.replace('/', '* 1.0 /')})"
        rules += [f"coalesce({value} >= {r.low}, TRUE)"] * (r.low is not None) + [f"coalesce({value} <= {r.high}, TRUE)"] * (r.high is not None)
    symbols = "[#*$%&|<>]"
    return f"""WITH {_words()},
g AS (SELECT doc_id, i, w || ' ' || lead(w, 1) {_over()} || ' ' || lead(w, 2) {_over()} AS g FROM w),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g WHERE g IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS r FROM c, (VALUES (0), (1), (2)) t(o) WHERE k > 1 GROUP BY doc_id),
ws AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS chars, count(*) FILTER (WHERE lower(w) IN ({stop})) AS stops FROM w GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents),
ln AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS k FROM l WHERE regexp_matches(x, '{_WORD}') GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(ws.n, 0) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(coalesce(text, ''), '{symbols}')) AS BIGINT) AS n_symbols,
coalesce(ln.n - ln.k, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, coalesce(ln.n, 0) AS n_lines, coalesce(stops, 0) AS n_stop_words, length(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')) AS n_loud
FROM documents d LEFT JOIN ws USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(rules)} AS kept FROM b"""


def _op9(shards: int = 24) -> str:
    # g: groups in order of their MD5, cum: bytes up to their end. A table of capacities is scanned greedily, a shard a step; the least that reaches the end is c.
    greedy = ", ".join(f"s{k} AS (SELECT s.c, e.cum AS at FROM s{k - 1} s ASOF JOIN ends e ON s.at + s.c >= e.cum)" for k in range(1, shards + 1))
    # b_k: the first place from which k shards reach the end; cut_k: the place nearest an even share that the capacity allows.
    back = ", ".join(f"b{k} AS (SELECT min(e.cum) AS v FROM ends e, b{k - 1} b, cap WHERE e.cum >= b.v - c)" for k in range(1, shards))
    cuts = []
    for k in range(1, shards):
        left = shards - k
        even = f"(p.v + ((SELECT v FROM total) - p.v) / {left + 1}.0)"
        near = f"(SELECT cum FROM ends e ORDER BY abs(e.cum - {even}), e.cum LIMIT 1)"
        far = "(SELECT max(cum) FROM ends e WHERE e.cum <= p.v + c)"
        cuts.append(f"cut{k} AS (SELECT least(greatest({near}, (SELECT v FROM b{left})), {far}) AS v FROM cut{k - 1} p, cap)")
    all_cuts = " UNION ALL ".join(f"SELECT v FROM cut{k}" for k in range(1, shards))
    crc = "list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))"
    return f"""WITH tb AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT range AS n, list_reduce([range, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256))),
d AS (SELECT doc_id, md5(coalesce(text, '')) AS m, hex(encode(coalesce(text, ''))) AS h FROM documents),
r AS (SELECT doc_id, m, length(h) // 2 + 8 AS size, xor({crc}, 4294967295::BIGINT) AS crc FROM (SELECT doc_id, m, h, tab, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(length(h) // 2)] AS bytes FROM d, tb)),
g AS (SELECT m, CAST(sum(sum(size)) OVER (ORDER BY m) AS BIGINT) AS cum, CAST(sum(size) AS BIGINT) AS size FROM r GROUP BY m), ends AS (SELECT cum FROM g UNION ALL SELECT 0),
total AS (SELECT max(cum) AS v FROM ends), lo AS (SELECT greatest(max(size), CAST(ceil(max(cum) / {shards}.0) AS BIGINT)) AS v, max(size) AS most FROM g),
s0 AS (SELECT unnest(range((SELECT v FROM lo), (SELECT v + most FROM lo) + 1)) AS c, 0::BIGINT AS at), {greedy},
cap AS (SELECT min(s.c) AS c FROM s{shards} s, total WHERE s.at = total.v), b0 AS (SELECT v FROM total), {back}, cut0 AS (SELECT 0::BIGINT AS v), {', '.join(cuts)},
cuts AS ({all_cuts}), gs AS (SELECT m, CAST((SELECT count(*) FROM cuts WHERE cuts.v <= g.cum - g.size) AS INT) AS shard FROM g),
a AS (SELECT r.*, shard, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r.m), 1, 8))::BIGINT % 64 AS lane FROM r JOIN gs USING (m))
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY lane, doc_id, crc, size) - 1 AS BIGINT) AS slot, CAST(NULL AS DOUBLE) AS grown_shard FROM a"""


def _op10() -> str:
    # p: the line's place in the text, from 1; i: its rank among lines that hold a word.
    return f"""WITH sp AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
al AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS p FROM sp),
l AS (SELECT doc_id, x, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM al WHERE regexp_matches(x, '{_WORD}')),
win AS (SELECT doc_id, i, x || chr(10) || lead(x, 1) {_over()} || chr(10) || lead(x, 2) {_over()} AS g FROM l),
f AS (SELECT doc_id, i, g, first_value(doc_id) OVER q AS fd, first_value(i) OVER q AS fi FROM win WHERE g IS NOT NULL WINDOW q AS (PARTITION BY g ORDER BY doc_id, i)),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM f, (VALUES (0), (1), (2)) t(o) WHERE (doc_id, i) <> (fd, fi) AND NOT (doc_id = fd AND i + o < fi + 3)),
st AS (SELECT al.doc_id, al.x, al.p, gone.i IS NOT NULL AS g FROM al LEFT JOIN l USING (doc_id, p) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i),
got AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE g) AS k, string_agg(x, chr(10) ORDER BY p) FILTER (WHERE NOT g) AS t FROM st GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_lines, coalesce(k, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN got USING (doc_id)"""


SQL = {
    "op1_substring_dedup": _op1(),
    "op3_topk_search": _op3(),
    "op4_url_filter": _op4(),
    "op5_jaccard_join": _op5(),
    "op6_mixing": _op6(),
    "op7_quality_rules": _op7(),
    "op9_sharding": _op9(),
    "op10_line_dedup": _op10(),
}
