"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *,
    regexp_replace(replace(role, '\', '\\'), '([<\[])(\|im_(?:start|sep|end)\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g') AS erole,
    regexp_replace(replace(text, '\', '\\'), '([<\[])(\|im_(?:start|sep|end)\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g') AS etext
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|><|im_sep|><|im_end|>') + length(erole) + length(etext)) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""

OP2 = r"""
WITH toks AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, p, sha256(array_to_string(w[p:p+49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM toks WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS d FROM wins GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, p + k AS i
  FROM (SELECT w.doc_id, w.p FROM wins w JOIN firsts f ON w.h = f.h AND f.d < w.doc_id), (SELECT unnest(range(50)) AS k)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM toks),
kept AS (
  SELECT a.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY a.i) AS s
  FROM words a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM toks t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""

OP6 = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM toks WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 85 * (s.n + t.n - c)),
ends AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT a, b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a)
SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(t.doc_id, coalesce(m, t.doc_id)) AS component_id
FROM toks t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = t.doc_id
"""

OP9 = r"""
WITH toks AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p+9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM items WHERE len(w) > 0 AND item_id IS NOT NULL)),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (
  SELECT doc_id, n, p, array_to_string(w[p:p+n-1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM toks JOIN sizes ON len(w) >= n)),
found AS (SELECT doc_id, s.n, p, item_id FROM spots s JOIN wins v ON s.n = v.n AND s.s = v.s),
hit AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM toks t LEFT JOIN hit h ON h.doc_id = t.doc_id LEFT JOIN named m ON m.doc_id = t.doc_id
"""

#: letters beyond ASCII in the tables, each of which the twin of op8 compares as one byte
LETTERS = "äöüßÄÖÜéèêÉÈÊçÇñÑíÍóÓáÁúÚ"
_CODES = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32)][: len(LETTERS)])

OP8 = rf"""
WITH lines AS (
  SELECT doc_id, doc_id * 1000000 + n AS place, n, x, translate(x, '{LETTERS}', {_CODES}) AS c, length(x) AS l, regexp_matches(x, '[^\x09-\x0D\x20]') AS inked
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents)),
firsts AS (SELECT x, any_value(c) AS c, any_value(l) AS l, min(place) AS place FROM lines WHERE inked GROUP BY x),
long AS (SELECT * FROM firsts WHERE l >= 20),
near AS (
  SELECT DISTINCT a.x FROM long a JOIN long b ON b.place < a.place AND abs(a.l - b.l) <= 2
  WHERE (contains(b.c, left(a.c, a.l // 3)) OR contains(b.c, substr(a.c, a.l // 3 + 1, a.l // 3)) OR contains(b.c, substr(a.c, 2 * (a.l // 3) + 1))) AND levenshtein(a.c, b.c) <= 2),
judged AS (
  SELECT t.doc_id, t.n, t.x, t.inked AND (t.place > f.place OR m.x IS NOT NULL) AS gone FROM lines t LEFT JOIN firsts f ON f.x = t.x LEFT JOIN near m ON m.x = t.x)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (coalesce(gone, false)) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY n) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op7(weights: dict[tuple[str, ...], float], share: float, epochs: int, seed: int) -> str:
    """The mix of three levels; budgets by the same whole numbers, each leaf's prefix by one running sum."""
    paths = ", ".join("(" + ", ".join([*(f"'{x}'" for x in (*p, *[""] * (3 - len(p)))), str(len(p)), str(round(w * 1_000_000))]) + ")" for p, w in weights.items())
    names = ["domain", "lang", "source"]
    steps = ""
    for d in range(1, 4):
        own, up = ", ".join(names[:d]), ", ".join(names[: d - 1])
        by, same = (f"PARTITION BY {up}" if up else ""), " AND ".join(f"a.{n} = p.{n}" for n in names[: d - 1])
        source = f"(SELECT {own}, max(w{d}) AS w, max(cap{d}) AS cap FROM caps GROUP BY {own}) a"
        given = f"SELECT a.*, p.budget AS up FROM {source} JOIN b{d - 1} p ON {same}" if up else f"SELECT a.*, (SELECT sum(t)::HUGEINT * {round(share * 1_000_000)} // 1000000 FROM leaf) AS up FROM {source}"
        steps += f""",
n{d} AS (SELECT *, w > 0 AND cap > 0 AS open, cap / nullif(w, 0) AS ratio FROM ({given})),
o{d} AS (SELECT *, least(up, coalesce(sum(cap) FILTER (open) OVER ({by}), 0))::HUGEINT AS b FROM n{d}),
f{d} AS (SELECT *, open AND (b - coalesce(sum(cap) FILTER (open) OVER w, 0)) * w >= cap::HUGEINT * (coalesce(sum(w) FILTER (open) OVER ({by}), 0) - coalesce(sum(w) FILTER (open) OVER w, 0)) AS saturated
  FROM o{d} WINDOW w AS ({by} ORDER BY CASE WHEN open THEN ratio END NULLS LAST, {names[d - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s{d} AS (SELECT *, open AND NOT saturated AS sharing, (b - coalesce(sum(cap) FILTER (saturated) OVER ({by}), 0))::HUGEINT AS spare, coalesce(sum(w) FILTER (open AND NOT saturated) OVER ({by}), 0)::HUGEINT AS mass FROM f{d}),
p{d} AS (SELECT *, CASE WHEN sharing THEN spare * w // mass END AS part FROM s{d}),
b{d} AS (SELECT {own}, CASE WHEN saturated THEN cap WHEN sharing THEN least(cap, part + CASE WHEN row_number() OVER ({by} ORDER BY spare * w - part * mass DESC NULLS LAST, {names[d - 1]}) <= spare - sum(part) OVER ({by}) THEN 1 ELSE 0 END) ELSE 0 END AS budget FROM p{d})"""
    w = [f"coalesce((SELECT max(w) FROM given WHERE depth = {d} AND " + " AND ".join(f"p{k} = {names[k - 1]}" for k in range(1, d + 1)) + "), 1000000)" for d in range(1, 4)]
    return rf"""
WITH given(p1, p2, p3, depth, w) AS (VALUES {paths}),
docs AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' WHEN regexp_matches(source, '^src[1-9]$') THEN 'web' ELSE 'curated' END AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS t FROM docs GROUP BY 1, 2, 3),
heavy AS (SELECT *, {w[0]} AS w1, {w[1]} AS w2, {w[2]} AS w3 FROM leaf),
caps AS (SELECT *, t * {epochs} AS cap3, sum(CASE WHEN w3 > 0 THEN t * {epochs} ELSE 0 END) OVER (PARTITION BY domain, lang) AS cap2,
  sum(CASE WHEN w3 > 0 AND w2 > 0 THEN t * {epochs} ELSE 0 END) OVER (PARTITION BY domain) AS cap1 FROM heavy){steps},
plan AS (SELECT l.*, CASE WHEN t > 0 THEN budget // t ELSE 0 END AS whole, CASE WHEN t > 0 THEN budget % t ELSE 0 END AS rest FROM leaf l JOIN b3 b ON b.domain = l.domain AND b.lang = l.lang AND b.source = l.source),
keyed AS (SELECT d.*, whole, rest, md5(concat_ws(':', '{seed}', CAST(whole AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS k FROM docs d JOIN plan p ON p.domain = d.domain AND p.lang = d.lang AND p.source = d.source)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM keyed
"""
