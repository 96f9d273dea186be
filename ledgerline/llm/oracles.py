"""SQL, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from ledgerline.llm import secrets
from ledgerline.llm.divergence import COMMON_WORDS, DEFAULTS

_WORD = r"[^\x20\x09-\x0D]+"

#: Base 32 of a SHA-1: five bits for each character, from groups of five hexadecimal digits.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(i // 4 AS INT) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '')"

OP2 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), d AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS m FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM d"""

OP8 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i : i + 4], ' ')))) WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END AS s FROM w),
    e AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS h FROM s), l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    k AS (SELECT x AS s, y AS t FROM l UNION SELECT y, x FROM l), n AS (SELECT DISTINCT s AS node FROM k),
    c AS (WITH RECURSIVE cc(node, component) USING KEY (node) AS (SELECT node, node FROM n UNION SELECT k.t, min(cc.component) FROM cc JOIN k ON k.s = cc.node JOIN recurring.cc r ON r.node = k.t WHERE cc.component < r.component GROUP BY k.t) SELECT node, component FROM cc)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM s LEFT JOIN c ON node = doc_id"""


def _without(column: str, pattern: str) -> str:
    return f"regexp_replace({column}, '{pattern}', '', 'g')"


def _jensen_shannon(p: str, q: str) -> str:
    part = f"list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN {p}[i] > 0 THEN {p}[i] * log2(2 * {p}[i] / ({p}[i] + {q}[i])) ELSE 0 END + CASE WHEN {q}[i] > 0 THEN {q}[i] * log2(2 * {q}[i] / ({p}[i] + {q}[i])) ELSE 0 END)"
    return f"sqrt(greatest(list_sum({part}) / 2, 0))"


_LISTED = "CASE lang " + " ".join(f"WHEN '{code}' THEN [{', '.join(repr(w) for w in words)}]" for code, words in COMMON_WORDS.items()) + " END"
_LIMITS = {k: f"sqrt({v * v!r} + {(n - 1) / 8!r} / ln(2) / greatest({size}, 1))" for k, v, n, size in (("chars", DEFAULTS["max_char_distance"], 8, "n_chars"), ("words", DEFAULTS["max_word_distance"], 17, "n_words"))}

OP4 = f"""WITH d0 AS (SELECT doc_id, CASE WHEN lang IN ({', '.join(map(repr, COMMON_WORDS))}) THEN lang ELSE 'other' END AS lang, coalesce(text, '') AS t FROM documents),
    d1 AS (SELECT *, length(t) AS n_chars, {_without('t', '[a-z]')} AS a, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d0),
    d2 AS (SELECT *, {_without('a', chr(92) + 'x20|[' + chr(92) + 'x09-' + chr(92) + 'x0D]')} AS b FROM d1), d3 AS (SELECT *, {_without('b', "[.,;:''" + '"' + "?()-]")} AS c FROM d2), d4 AS (SELECT *, {_without('c', chr(92) + 'p{Lu}')} AS d FROM d3), d5 AS (SELECT *, {_without('d', chr(92) + 'p{L}')} AS e FROM d4), d6 AS (SELECT *, {_without('e', '[0-9]')} AS f FROM d5), d7 AS (SELECT *, {_without('f', '[#*$%&|<>!+=/' + chr(92) * 2 + '^~@_]')} AS g FROM d6),
    x AS (SELECT doc_id, lang, n_chars, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length({_without('t', '[#*$%&|<>]')}) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, w,
        [n_chars - length(a), length(a) - length(b), length(b) - length(c), length(c) - length(d), length(d) - length(e), length(e) - length(f), length(f) - length(g), length(g)] AS chars, list_transform({_LISTED}, lambda v: len(list_filter(w, lambda y: lower(y) = v))) AS common FROM d7),
    win AS (SELECT doc_id, unnest(range(1, n_words - 1)) AS p, unnest(list_transform(range(1, n_words - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM x WHERE n_words > 2), rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS k FROM win) WHERE k > 1),
    rw AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY doc_id),
    y AS (SELECT x.*, coalesce(rw.n, 0) AS n_repeat_words, CASE WHEN common IS NOT NULL THEN list_concat(common, [n_words - list_sum(common)]) END AS counts FROM x LEFT JOIN rw USING (doc_id)),
    ref AS (SELECT lang, sum(n_chars) AS ac, sum(n_words) AS aw, [{', '.join(f'sum(chars[{i}])' for i in range(1, 9))}] AS rc, [{', '.join(f'sum(counts[{i}])' for i in range(1, 18))}] AS rw FROM y GROUP BY lang),
    z AS (SELECT y.*, CASE WHEN n_chars > 0 THEN list_transform(chars, lambda v: v / n_chars) END AS pc, list_transform(rc, lambda v: v / ac) AS qc, CASE WHEN lang <> 'other' AND n_words > 0 THEN list_transform(counts, lambda v: v / n_words) END AS pw, list_transform(ref.rw, lambda v: v / aw) AS qw FROM y JOIN ref USING (lang)),
    j AS (SELECT *, CASE WHEN pc IS NOT NULL THEN {_jensen_shannon('pc', 'qc')} END AS cd, CASE WHEN pw IS NOT NULL THEN {_jensen_shannon('pw', 'qw')} END AS wd, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM z)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance,
        NOT base_failed AND NOT coalesce(n_chars >= {DEFAULTS['min_chars']} AND cd > {_LIMITS['chars']}, false) AND NOT coalesce(n_words >= {DEFAULTS['min_words']} AND wd > {_LIMITS['words']}, false) AS kept FROM j"""

ORACLE_SQL: dict[str, str] = {"op2_warc": OP2, "op4_divergence": OP4, "op8_near_duplicates": OP8}

_LIST12 = "list_filter(list_transform(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]'), lambda x: regexp_extract_all(x, '[^\\x20\\x09]+')), lambda x: len(x) > 0)"


def _score12(x: str, y: str) -> str:
    return f"CAST(1000000 * CAST(g.f AS HUGEINT) * g.f // (CAST({x}.f AS HUGEINT) * {y}.f) AS BIGINT)"


OP12 = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest({_LIST12}) AS w FROM documents),
    g1 AS (SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(w) AS w1 FROM p) GROUP BY ALL), size AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g1 GROUP BY lang),
    g2 AS (SELECT lang, x[1] AS w1, x[2] AS w2, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i : i + 1])) AS x FROM p) GROUP BY ALL HAVING f >= 10),
    g3 AS (SELECT lang, x[1] AS w1, x[2] AS w2, x[3] AS w3, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2])) AS x FROM p) GROUP BY ALL HAVING f >= 10),
    inside AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM g3 UNION ALL SELECT lang, w2, w3, f FROM g3) GROUP BY lang, w1, w2),
    two AS (SELECT g.lang, g.w1 || ' ' || g.w2 AS phrase, g.f AS a, x.f AS l, y.f AS r, {_score12('x', 'y')} AS score FROM g2 g JOIN g1 x ON x.lang = g.lang AND x.w1 = g.w1 JOIN g1 y ON y.lang = g.lang AND y.w1 = g.w2
        LEFT JOIN inside i ON i.lang = g.lang AND i.w1 = g.w1 AND i.w2 = g.w2 WHERE coalesce(100 * i.f < 50 * g.f, true)),
    cut AS (SELECT g.lang, g.w1 || ' ' || g.w2 || ' ' || g.w3 AS phrase, g.f AS a, x1.f AS l1, y1.f AS r1, {_score12('x1', 'y1')} AS s1, x2.f AS l2, y2.f AS r2, {_score12('x2', 'y2')} AS s2 FROM g3 g JOIN g1 x1 ON x1.lang = g.lang AND x1.w1 = g.w1
        JOIN g2 y1 ON y1.lang = g.lang AND y1.w1 = g.w2 AND y1.w2 = g.w3 JOIN g2 x2 ON x2.lang = g.lang AND x2.w1 = g.w1 AND x2.w2 = g.w2 JOIN g1 y2 ON y2.lang = g.lang AND y2.w1 = g.w3),
    c AS (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cut)
    SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c) JOIN size USING (lang) WHERE rank <= 2000"""

ORACLE_SQL["op12_phrases"] = OP12


def _found11(kind: str, pattern: str, value: str, ok: str, flags: str = "") -> str:
    """The findings of a pattern: what stands between them tells where they are. `value` and `ok` are of the match m."""
    own = f"(?{flags}:{pattern})" if flags else pattern
    return f"""SELECT doc_id, source, '{kind}' AS kind, start, start + length(m) AS stop, {value} AS value FROM (SELECT *, coalesce(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS start FROM (
        SELECT doc_id, source, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(list_slice(gap, 1, len(m))) AS gap FROM (SELECT doc_id, source, regexp_extract_all(t, '{own}') AS m, string_split_regex(t, '{own}') AS gap FROM d) WHERE len(m) > 0)) WHERE {ok}"""


_NAMES11 = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_ASSIGN11 = _NAMES11 + "[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_ADDRESS11 = "://([^\\x20\\x09-\\x0D/:@]+):([^\\x20\\x09-\\x0D/@]+)@"
_PEM11 = "-----BEGIN [A-Z\\x20]*PRIVATE KEY-----([^-]+)-----END [A-Z\\x20]*PRIVATE KEY-----"
_PARTS11 = {
    "assign": _found11("assign", _ASSIGN11, f"regexp_extract(m, '{_ASSIGN11}', 2)", f"length(value) >= {secrets.LEAST_ASSIGNED}"),
    "access": _found11("access", "AKIA[A-Z0-9]+", "m", f"length(m) >= {secrets.LEAST_ACCESS}"),
    "hex": _found11("hex", "[0-9a-f]+", "m", "length(m) >= 16"),
    "key": _found11("key", "[0-9A-Za-z_-]+", "m", f"length(m) >= 20 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]') AND len(list_distinct(string_split(m, ''))) >= {secrets.KEY_CHARACTERS}"),
    "url": f"SELECT doc_id, source, kind, stop - 1 - length(value) AS start, stop - 1 AS stop, value FROM ({_found11('url', _ADDRESS11, f'regexp_extract(m, {chr(39)}{_ADDRESS11}{chr(39)}, 2)', 'true')})",
    "pem": _found11("pem", _PEM11, f"regexp_extract(m, '{_PEM11}', 1)", "true"),
}
_ORDER11 = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(secrets.KINDS)) + " END"
_REAL11 = f"len(list_distinct(string_split(value, ''))) >= {secrets.LIVE_CHARACTERS}" + "".join(f" AND NOT contains(lower(value), '{x}')" for x in secrets.PLACEHOLDERS)

OP11 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), f0 AS ({' UNION ALL '.join(_PARTS11.values())}), f1 AS (SELECT *, {_ORDER11} AS k FROM f0), base AS (SELECT * FROM f1 WHERE k < {secrets.BASE}),
    f AS (SELECT * FROM base UNION ALL SELECT * FROM f1 WHERE k >= {secrets.BASE} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f1.doc_id AND b.start < f1.stop AND f1.start < b.stop)),
    o AS (SELECT value, count(DISTINCT coalesce('=' || split_part(source, '/', 1), '')) > {secrets.MAX_OWNERS} OR count(DISTINCT coalesce('=' || source, '')) > {secrets.MAX_REPOSITORIES} AS copied FROM f GROUP BY value),
    j AS (SELECT f.*, copied, {_REAL11} AND NOT copied AS live FROM f JOIN o USING (value)),
    s AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < {secrets.BASE}), '') AS b,
        coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < {secrets.BASE} OR live), '') AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied FROM j GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN s USING (doc_id)"""

ORACLE_SQL["op11_secrets"] = OP11
