"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pathfield.llm import leaks, licenses, manifest, mixing, urls

_LOWER = f"'{ascii_uppercase}', '{ascii_lowercase}'"


def _jaccard() -> str:
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, {words} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.u, ways.v FROM reach JOIN ways ON reach.v = ways.u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) ON u = d.doc_id LEFT JOIN sizes USING (doc_id)
"""


def _form(text: str) -> str:
    """SQL of licenses.canonical."""
    # RE2 has no look-ahead, so what licenses.COPYRIGHT_LINE tells at once takes several patterns
    begin = "^[^a-z0-9]*copyright"
    goes_on = rf"regexp_matches(l, '{begin}[^a-z][^a-z0-9(]*{licenses.SENTENCE}\b') AND NOT regexp_matches(l, '{begin}[^a-z][^a-z0-9(]*{licenses.SENTENCE}[ \t]*:')"
    states = rf"regexp_matches(l, '{begin}[^a-z]') AND regexp_matches(l, '{begin}.*[^\x00-/:-@\[-`{{-\x7f]') AND NOT ({goes_on})"
    line = rf"(regexp_matches(l, '^[^a-z0-9]*\(c\)([^a-z].*)?$') OR {states})"
    c = f"translate(coalesce({text}, ''), {_LOWER})"
    c = f"array_to_string(list_filter(string_split({c}, chr(10)), lambda l: NOT {line}), chr(10))"
    c = rf"regexp_replace(replace({c}, 'https', 'http'), '[\x00-/:-@\[-`{{-\x7f]+', ' ', 'g')"
    c = f"' ' || replace(trim({c}, ' '), ' ', '  ') || ' '"
    for a, b in licenses.spellings():
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim(replace({c}, '  ', ' '), ' ')"


def _licenses() -> str:
    known = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.KNOWN)
    line = "split_part(split_part(rtrim(coalesce(text, ''), ' ' || chr(9) || chr(13) || chr(10)), chr(10), -1), chr(13), -1)"
    return f"""
WITH known AS (SELECT sha256({_form("t")}) AS digest, min(license) AS license FROM (VALUES {known}) AS k(license, t) GROUP BY 1),
forms AS (SELECT doc_id, {_form("text")} AS form, {_form(line)} AS line FROM documents)
SELECT doc_id, sha256(form) AS digest, w.license, e.license AS notice
FROM forms LEFT JOIN known w ON form <> '' AND w.digest = sha256(form) LEFT JOIN known e ON line <> '' AND e.digest = sha256(line)
"""


def _mixing() -> str:
    key = f"coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) || '|{mixing.SEED}'"
    return f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
means AS (SELECT source, (SELECT sum(n) FROM counts) / CAST((SELECT count(*) FROM counts) AS DOUBLE) / n AS mean FROM counts),
rates AS (SELECT source, greatest(CAST(ceil(mean / {mixing.PART}) AS BIGINT), 1) AS parts, mean / greatest(CAST(ceil(mean / {mixing.PART}) AS BIGINT), 1) AS rate FROM means),
terms AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM rates, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k)),
sums AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
keyed AS (SELECT *, {key} AS key, row_number() OVER () AS r FROM documents),
tries AS (
  SELECT k.source, r, CAST('0x' || substr(md5(key || CASE WHEN part = 0 THEN '' ELSE '|' || CAST(part AS VARCHAR) END), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM keyed k JOIN rates ON k.source IS NOT DISTINCT FROM rates.source, LATERAL (SELECT unnest(range(0, parts)) AS part)),
counted AS (SELECT r, sum((SELECT count(*) FROM sums s WHERE s.source IS NOT DISTINCT FROM t.source AND s.c <= t.u)) AS times FROM tries t GROUP BY r)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, md5(key || '|' || CAST(copy AS VARCHAR) || '|order') AS shuffle_key
FROM keyed JOIN counted USING (r), LATERAL (SELECT unnest(range(1, CAST(times AS BIGINT) + 1)) AS copy)
"""


def _urls() -> str:
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    text = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    order, pull, signs = urls.ORDER, urls.PULL, urls.SIGNS
    steps, before = [], "grams"
    for k in range(order + 1):
        part, context = f"substr(gram, {order + 1 - k}, {k + 1})", f"substr(gram, {order + 1 - k}, {k})"
        lower = {x: str(1.0 / signs) if k == 0 else f"{x}_{k - 1}" for x in "ab"}
        columns = ", ".join(f"(sum({x}) OVER (PARTITION BY {part}) + {pull} * {lower[x]}) / (sum({x}) OVER (PARTITION BY {context}) + {pull}) AS {x}_{k}" for x in "ab")
        steps.append(f"level{k} AS (SELECT *, {columns} FROM {before})")
        before = f"level{k}"
    return f"""
WITH hosts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {_LOWER}) AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, {text} AS rule, {verdict} AS by_rule, regexp_replace(regexp_replace(translate(host || path, {_LOWER}), '[0-9]+', '0', 'g'), '[^a-z0._/\\-]', '~', 'g') AS form FROM hosts),
forms AS (SELECT form, count(*) FILTER (by_rule = 'allow') AS a, count(*) FILTER (by_rule = 'block') AS b FROM ruled GROUP BY form),
cut AS (SELECT form, a, b, substr(repeat('^', {order}) || form || '$', i, {order + 1}) AS gram FROM forms, LATERAL (SELECT unnest(range(1, length(form) + 2)) AS i)),
grams AS (SELECT gram, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b FROM cut GROUP BY gram),
{", ".join(steps)},
scored AS (SELECT form, cut.a, cut.b, round(avg(ln(a_{order}) - ln(b_{order})), 9) AS score FROM cut JOIN level{order} USING (gram) GROUP BY form, cut.a, cut.b),
bins AS (SELECT floor(score * {urls.BINS}) AS bin, sum(a) AS a, sum(b) AS b FROM scored GROUP BY bin),
gains AS (SELECT bin, sum(a) OVER (ORDER BY bin DESC) / nullif(CAST(sum(a) OVER () AS DOUBLE), 0) - sum(b) OVER (ORDER BY bin DESC) / nullif(CAST(sum(b) OVER () AS DOUBLE), 0) AS gain FROM bins),
border AS (SELECT (SELECT bin / {urls.BINS} FROM gains WHERE gain IS NOT NULL ORDER BY gain DESC, bin LIMIT 1) AS least)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN least IS NULL OR score >= least THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN least IS NOT NULL THEN score END AS score
FROM ruled JOIN scored USING (form), border
"""


_NEAREST = """
WITH rows AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
good AS (SELECT * FROM rows WHERE vec_id IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
common AS (SELECT len(v) AS n FROM good GROUP BY 1 ORDER BY count(*) DESC, n DESC LIMIT 1),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id WHERE len(q.v) = (SELECT n FROM common) AND len(c.v) = (SELECT n FROM common))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""

def _framed(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _manifest() -> str:
    leaf = lambda n: "sha256(" + " || ".join(_framed(n if c == "n_chars" else c) for c in manifest.FIELDS) + ")"
    #: crc32 of a decimal number, bit by bit over its digits
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
crc(doc_id, s, i, bit, c) AS (
  SELECT doc_id, s, 1, 0, xor(4294967295, CAST(ascii(s) AS BIGINT)) FROM ids
  UNION ALL SELECT doc_id, s, CASE WHEN bit = 7 THEN i + 1 ELSE i END, (bit + 1) % 8,
    CASE WHEN bit = 7 AND i < length(s) THEN xor({step}, CAST(ascii(substr(s, i + 1, 1)) AS BIGINT)) ELSE {step} END FROM crc WHERE i <= length(s)),
touched AS (SELECT doc_id FROM crc WHERE i > length(s) AND xor(c, 4294967295) % 7 = 0),
leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, {leaf("n_chars")} AS leaf,
    CASE WHEN doc_id IN (SELECT doc_id FROM touched) THEN {leaf("CAST(n_chars AS HUGEINT) + 1")} END AS given FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low(tree, k, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, n FROM placed
  UNION ALL SELECT tree, k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, k, pos // 2, n),
tops AS (SELECT tree, h, k AS depth, count(*) OVER () AS n FROM low WHERE n = 1),
high(k, pos, h, n) AS (
  SELECT 0, tree, h, n FROM tops
  UNION ALL SELECT k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY k, pos // 2, n),
steps AS (
  SELECT p.tree, p.pos, l.k, (p.pos >> l.k) % 2 = 1 AS before, s.h FROM placed p JOIN low l ON l.tree = p.tree AND l.pos = p.pos >> l.k AND l.n > 1
    LEFT JOIN low s ON s.tree = p.tree AND s.k = l.k AND s.pos = xor(l.pos, 1)
  UNION ALL SELECT p.tree, p.pos, t.depth + l.k, l.pos % 2 = 1, s.h FROM placed p JOIN tops t USING (tree) JOIN high l ON l.pos = p.tree >> l.k AND l.n > 1
    LEFT JOIN high s ON s.k = l.k AND s.pos = xor(l.pos, 1)),
proofs AS (SELECT tree, pos, string_agg(h, '' ORDER BY k) AS proof FROM steps GROUP BY tree, pos),
fold(tree, pos, k, h) AS (
  SELECT tree, pos, 0, coalesce(given, leaf) FROM placed
  UNION ALL SELECT f.tree, f.pos, f.k + 1, sha256(CASE WHEN s.before THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END) FROM fold f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.k = f.k),
ends AS (SELECT tree, pos, arg_max(h, k) AS h FROM fold GROUP BY tree, pos),
root AS (SELECT h FROM high WHERE n = 1)
SELECT doc_id, leaf, t.h AS subroot, root.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
FROM placed p JOIN tops t USING (tree) JOIN ends e ON e.tree = p.tree AND e.pos = p.pos LEFT JOIN proofs o ON o.tree = p.tree AND o.pos = p.pos, root
"""


def _leaks() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
items AS (SELECT item_id, {words} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), {leaks.WINDOW}) AS k, array_to_string(w[i:i + {leaks.WINDOW - 1}], ' ') AS g FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - {leaks.WINDOW - 1}, 1) + 1)) AS i) WHERE len(w) > 0),
found AS (
  SELECT r, i, windows.k, item_id
  FROM (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM docs, (SELECT DISTINCT k FROM windows), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)) s JOIN windows ON windows.k = s.k AND windows.g = s.g),
hits AS (SELECT r, count(DISTINCT j) AS n FROM found, LATERAL (SELECT unnest(range(i, i + k)) AS j) GROUP BY r),
listed AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(l.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits h USING (r) LEFT JOIN listed l USING (r)
"""


ORACLES = {
    "op11_manifest": _manifest(),
    "op12_leaks": _leaks(),
    "op3_url_filters": _urls(),
    "op4_jaccard": _jaccard(),
    "op5_license_scans": _licenses(),
    "op8_mixing": _mixing(),
    "op10_nearest": _NEAREST,
}
