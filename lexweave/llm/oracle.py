"""The operators that SQL can express, in SQL."""

from __future__ import annotations

import re

from . import licences, urls

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, gap: str) -> str:
    return f"[x FOR x IN string_split_regex({text}, '{gap}') IF x <> '']"


_GAP = r"[\x20\x09-\x0D]+"
_TEXT = "coalesce(text, '')"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SYMBOLS = "length(regexp_replace({0}, '[^#*$%&|<>]', '', 'g'))"
#: The lists of the quality rules, written out again.
_PHRASES = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies", "site uses cookies", "website uses cookies", "accept cookies", "accept all cookies",
    "enable javascript", "subscribe to our newsletter", "sign up for our newsletter", "follow us on", "click here to", "lorem ipsum", "powered by wordpress",
]
_NAV_LINES = [
    "home", "next", "previous", "back", "back to top", "menu", "search", "login", "log in", "sign in", "sign up", "share", "read more", "more", "comments", "reply", "contact", "contact us", "about",
    "about us", "skip to content", "skip to main content", "site map",
]
_NAV_PAGES = ["home", "menu", "search", "login", "logout", "register", "contact", "about", "share", "comments", "reply", "sitemap", "faq", "help", "blog", "news", "account", "cart", "privacy", "terms"]
_NAV_ANY = ["home", "next", "previous", "back", "to", "top", "menu", "search", "login", "log", "in", "sign", "up", "share", "read", "more", "comments", "reply", "contact", "us", "about", "skip", "content", "main", "site", "map", "logout", "register", "sitemap", "faq", "help", "blog", "news", "account", "cart", "privacy", "terms"]
_SAID = " + ".join(f"CASE WHEN contains(low, {_quoted(x)}) THEN {len(x.split())} ELSE 0 END" for x in _PHRASES)
_NAMED = "trim(regexp_replace(low, '[^a-z0-9\\x{80}-\\x{10FFFF}]+', ' ', 'g'))"
_ENDED = "[\\x20\\x09-\\x0D]*$"


def _in(words: list[str]) -> str:
    return f"IN ({', '.join(map(_quoted, sorted(words)))})"


QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TEXT} AS text, {_words(_TEXT, _GAP)} AS l FROM documents),
w AS (SELECT rid, i, l[i:i + 4] AS g FROM (SELECT rid, l, unnest(range(1, len(l) - 3)) AS i FROM d)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM w) WHERE c > 1) GROUP BY rid),
s AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
n0 AS (SELECT rid, line, i, {_words('line', _GAP)} AS l, {_LOWER.format('line')} AS low, regexp_matches(line, '[\p{{L}}\p{{N}}]{_ENDED}') AS bare FROM s),
n AS (SELECT *, lead(l[1]) OVER o AS first_after, coalesce(len(lag(l) OVER o), 0) = 0 AS alone, max(length(line)) FILTER (WHERE len(l) <= 25) OVER w AS width,
  count(*) FILTER (WHERE len(l) BETWEEN 4 AND 25) OVER w AS n_judged, count(*) FILTER (WHERE len(l) BETWEEN 4 AND 25 AND bare) OVER w AS n_bare FROM n0 WINDOW o AS (PARTITION BY rid ORDER BY i), w AS (PARTITION BY rid)),
j AS (SELECT *, row_number() OVER (PARTITION BY rid, line ORDER BY i) AS k, len(l) AS n, {_SYMBOLS.format('line')} AS sym, len(line) - len(replace(line, '!', '')) AS bang, string_split({_NAMED}, ' ') AS named,
  length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS upper, length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) AS letters, len([x FOR x IN range(1, len(l)) IF l[x] = l[x + 1]]) AS same FROM n WHERE len(l) > 0),
f AS (SELECT *, (4 * sym > n AND (sym > n OR n >= 4)) OR (n >= 3 AND (2 * bang >= n OR 10 * upper > 6 * letters)) OR (n >= 6 AND 3 * same >= n)
  OR (n BETWEEN 4 AND 25 AND bare AND 2 * n_bare <= n_judged AND NOT (n <= 12 AND alone) AND NOT coalesce(length(line) + 1 + length(first_after) > width, FALSE))
  OR (n BETWEEN 3 AND 25 AND 2 * len([x FOR x IN l IF regexp_matches(x, '[A-Za-z0-9\x{{80}}-\x{{10FFFF}}]')]) < n)
  OR (n <= 25 AND regexp_matches(line, '(\{{|\}}|\);|\*/|-->){_ENDED}'))
  OR (n <= 12 AND (contains(line, ' | ') OR contains(line, ' » ') OR contains(line, ' > ') OR len([x FOR x IN l IF x IN ('·', '•', '›', '/', '::')]) >= 2 OR regexp_matches(low, '^[\x20\x09-\x0D]*(copyright|\(c\)|©).*(19|20)[0-9][0-9]')
    OR {_NAMED} {_in(_NAV_LINES)} OR (len([x FOR x IN named IF x {_in(_NAV_ANY)}]) = len(named) AND len([x FOR x IN named IF x {_in(_NAV_PAGES)}]) >= 2)))
  OR (n <= 25 AND ({_SAID}) > 0 AND 2 * ({_SAID}) >= n) AS fails FROM j),
g AS (SELECT rid, count(*) AS lines, count(DISTINCT line) AS own, sum(n) FILTER (WHERE k > 1 OR fails) AS lost FROM f GROUP BY rid),
a AS (SELECT d.doc_id, len(d.l)::BIGINT AS n_words, length(array_to_string(d.l, ''))::BIGINT AS word_chars, {_SYMBOLS.format('d.text')}::BIGINT AS n_symbols,
  coalesce(lines - own, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words FROM d LEFT JOIN r USING (rid) LEFT JOIN g USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_lost_words <= 0.5 * n_words AS kept FROM a
"""

_NORMAL = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words(_LOWER.format(_TEXT), _NORMAL)} AS l FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_words(_LOWER.format('text'), _NORMAL)} AS l FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, size, array_to_string(l[i:i + size - 1], ' ') AS w FROM (SELECT *, least(len(l), 13) AS size, unnest(range(1, greatest(len(l) - 12, 1) + 1)) AS i FROM b WHERE len(l) > 0)),
dw AS (SELECT doc_id, size, i, array_to_string(l[i:i + size - 1], ' ') AS w FROM (SELECT doc_id, l, size, unnest(range(1, len(l) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(l) >= size)),
h AS (SELECT doc_id, i, size, item FROM dw JOIN bw USING (size, w)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_KEYS = "[" + ", ".join(map(_quoted, licences.KNOWN)) + "]"
_IDS = "[" + ", ".join(map(_quoted, licences.KNOWN.values())) + "]"


def _swapped(text: str, rule: tuple[str, str], flags: str = "") -> str:
    pattern, by = rule
    return f"regexp_replace({text}, '{flags}{pattern}', '{by.replace('$', chr(92))}', 'g')"


def _identified(marked: str) -> str:
    pieces = f"[trim(regexp_replace(x, '[.!?]', '', 'g')) FOR x IN string_split({_swapped(marked, licences.HOLDER)}, '|')]"
    return f"[{_IDS}[list_position({_KEYS}, x)] FOR x IN {pieces} IF list_contains({_KEYS}, x)]"


_PARAGRAPHS = r"regexp_replace(t, '(?m)^ *copyright( c)? (\d{4}|yyyy|year)\b.*$', chr(10) || chr(10), 'g')"
_PARAGRAPHS = rf"regexp_replace({_PARAGRAPHS}, '\n *\n[ \n]*', '|', 'g')"
for _before, _after in licences.GOES_ON:
    _PARAGRAPHS = _swapped(_PARAGRAPHS, ("(" + _before.replace(" ", r"[ \n]+") + r")[ \n]*\|[ \n]*(" + _after.replace(" ", r"[ \n]+") + ")", "$1 $2"))
_PARAGRAPHS = rf"regexp_replace(regexp_replace({_PARAGRAPHS}, ' *\n *', ' ', 'g'), '[.!?]+ ', '|', 'g')"
_LINED, _WRAPPED = r"regexp_replace(t, '[.!?]* *\n|[.!?]+ ', '|', 'g')", r"regexp_replace(regexp_replace(t, ' *\n[ \n]*', ' ', 'g'), '[.!?]+ ', '|', 'g')"
_RULE_ROWS = ", ".join(
    f"({_quoted(name)}, {_quoted('%<' + '>%<'.join(ids) + '>%')}, [{', '.join(map(_quoted, inside))}]::VARCHAR[])" for (name, ids), inside in zip(licences.RULES, licences.INSIDE, strict=True)
)
LICENCES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_swapped(f"regexp_replace(lower({_TEXT}), '[^a-z0-9.!?{chr(92)}n]+', ' ', 'g')", licences.VERSION)} AS t FROM documents),
i AS (SELECT rid, doc_id, {_identified(_LINED)} AS lined, {_identified(_WRAPPED)} AS wrapped, {_identified(_PARAGRAPHS)} AS paragraphs FROM d),
j AS (SELECT *, greatest(len(lined), len(wrapped), len(paragraphs)) AS most, [array_to_string(['<' || x || '>' FOR x IN y], '') FOR y IN [lined, wrapped, paragraphs]] AS said FROM i),
h AS (SELECT DISTINCT rid, name, inside FROM (SELECT * FROM j WHERE most > 0) j, (VALUES {_RULE_ROWS}) r(name, p, inside) WHERE said[1] LIKE p OR said[2] LIKE p OR said[3] LIKE p),
a AS (SELECT rid, list(name) AS all_names FROM h GROUP BY rid),
n AS (SELECT rid, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(DISTINCT name) AS n FROM h JOIN a USING (rid) WHERE NOT list_has_any(inside, all_names) GROUP BY rid)
SELECT doc_id, most::BIGINT AS n_sentences, array_to_string(CASE WHEN len(lined) = most THEN lined WHEN len(wrapped) = most THEN wrapped ELSE paragraphs END, ',') AS sentence_ids,
  coalesce(names, '') AS licences, coalesce(n, 0)::BIGINT AS n_licences FROM j LEFT JOIN n USING (rid)
"""


#: Tokens of the longest rules that SQL counts.
SQL_TOKENS = 4


def _url_rules() -> str:
    """Every set of up to SQL_TOKENS tokens is counted, where FP-growth grows only the frequent ones."""
    fixed = sorted(urls.HOST_RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in fixed]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, fixed, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, fixed, strict=True))
    sets = []
    for n in range(1, SQL_TOKENS + 1):
        names = [f"t{i}" for i in range(n)]
        joins = " ".join(f"JOIN one {b} ON {b}.rid = {a}.rid AND {b}.t > {a}.t" for a, b in zip(names, names[1:], strict=False))
        sets.append(f"SELECT t0.rid, {' || chr(9) || '.join(f'{x}.t' for x in names)} AS k FROM one t0 {joins}")
    return rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
p AS (SELECT rid, page_id, url, {_LOWER.format("regexp_extract(after, '^([^/?#]*)', 1)")} AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS fixed, list_distinct(['h:' || x FOR x IN string_split_regex(host, '[.\-]') IF x <> '']
  || ['p:' || regexp_replace(x, '\d+', '0', 'g') FOR x IN string_split(path, '/') IF x <> ''] || ['q:' || regexp_extract(x, '^([^=]*)', 1) FOR x IN string_split(regexp_extract(url, '\?([^#]*)', 1), '&') IF x <> '']) AS tokens FROM p),
one AS (SELECT rid, unnest(tokens) AS t FROM f),
sets AS ({" UNION ALL ".join(sets)}),
marks AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 'block' ELSE '' END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
basket AS (SELECT rid, CASE WHEN bad = 'block' THEN 'block' ELSE 'allow' END AS v FROM f JOIN marks ON doc_id = page_id),
n AS (SELECT count(*)::DOUBLE AS n FROM basket),
nv AS (SELECT v, count(*)::DOUBLE AS c FROM basket GROUP BY v),
na AS (SELECT k, count(*)::DOUBLE AS c FROM sets JOIN basket USING (rid) GROUP BY k),
nb AS (SELECT k, v, count(*)::DOUBLE AS c FROM sets JOIN basket USING (rid) GROUP BY k, v),
rules AS (SELECT k, v, nb.c / na.c AS confidence, nb.c / n.n AS support FROM nb JOIN na USING (k) JOIN nv USING (v), n
  WHERE nb.c >= ceil({urls.MIN_SUPPORT} * n.n) AND nb.c / na.c >= {urls.MIN_CONFIDENCE} AND (nb.c / na.c) / (nv.c / n.n) >= {urls.MIN_LIFT}),
best AS (SELECT rid, min(struct_pack(c := -confidence, s := -support, a := CASE v WHEN 'block' THEN 0 ELSE 1 END, n := len(string_split(k, chr(9))), k := k, v := v)) AS best FROM sets JOIN rules USING (k) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(fixed, best.v, 'allow') AS verdict, CASE WHEN fixed IS NULL THEN translate(best.k, chr(9), ' ') END AS mined_rule FROM f LEFT JOIN best USING (rid)
"""


URLS = _url_rules()

INFILL = rf"""
WITH d AS (SELECT doc_id, {_TEXT} AS text, regexp_extract_all({_TEXT}, '[A-Za-z]+|[^A-Za-z]') AS l, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(l)::BIGINT AS n, [('0x' || s[k:k + 7])::BIGINT FOR k IN [1, 9, 17, 25]] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(l[:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
