"""DuckDB SQL of the queries that SQL can express, written from their definitions.

Not here, as SQL can't express the model or is too slow on whole tables: the
quality classifier, language model scores, toxicity, token files, BPE and the pipeline. Tests
hold those against brute force, the tokenizers library or held-out labels."""

from __future__ import annotations

from tradewind.llm import licenses

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORDS = (
    f"list_filter(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'),"
    " lambda x: x <> '')"
)
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_SHINGLE_WORDS = _WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, least(len(w), 10) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM s)),
dw AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM s))),
m AS (SELECT r, k, p, item_id FROM dw JOIN iw USING (k, g)),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
             + (length(text) - length(replace(text, '</turn>', ''))) // 7
             + list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)) AS escaped,
             length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, ':', ''))
             + (length(role) - length(replace(role, '</turn>', ''))) // 7
             + list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)) AS head
      FROM c),
g AS (SELECT *, coalesce(escaped, length(text) + length(text) - length(replace(text, '\', ''))
             + (length(text) - length(replace(text, '</turn>', ''))) // 7)
             + coalesce(head, length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, ':', ''))
             + (length(role) - length(replace(role, '</turn>', ''))) // 7) + 15 AS chars FROM f)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""

_SHINGLES = f"""
t AS (SELECT doc_id, {_SHINGLE_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM t WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)"""

JACCARD = f"""
WITH RECURSIVE {_SHINGLES},
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN z x ON a = x.doc_id JOIN z y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT doc_id, doc_id AS other FROM t UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON reach.other = l.a)
SELECT t.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM t JOIN reach USING (doc_id) LEFT JOIN z USING (doc_id) GROUP BY t.doc_id
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    out = f"lower({column})"
    for pattern, by in licenses.REWRITES:
        out = f"regexp_replace({out}, {_literal(pattern)}, {_literal(by)}, 'g')"
    return f"trim({out})"


def _licenses() -> str:
    known = ", ".join(f"({_literal(name)}, {_literal(text)})" for name, forms in licenses.KNOWN.items() for text in forms)
    return f"""
WITH k AS (SELECT sha256(form) AS digest, min(name) AS license
           FROM (SELECT name, {_canonical("text")} AS form FROM (VALUES {known}) AS v(name, text)) GROUP BY 1),
d AS (SELECT doc_id, sha256({_canonical("text")}) AS digest FROM documents)
SELECT doc_id, digest, license FROM d LEFT JOIN k USING (digest)
"""


_TERMS = (
    f"list_filter(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),"
    " '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
t AS (SELECT *, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM t),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
o AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) JOIN (SELECT DISTINCT term FROM i) USING (term)
      GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM o GROUP BY term),
g AS (SELECT r, doc_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
             * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS gain
      FROM o JOIN f USING (term) JOIN t USING (r), s),
c AS (SELECT item_id, r, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM g JOIN i USING (term) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""

# The pages of the test tables have one article each, of headings, paragraphs and bold text.
ARTICLES = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(
             x, '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS x FROM b),
t AS (SELECT page_id, url, trim(regexp_replace(x, '[\x09-\x0D\x1C-\x20\x85\p{Z}]+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

PHRASES = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p
           FROM documents),
q AS (SELECT row_number() OVER () AS id, lang, list_filter(regexp_extract_all(p, '[^\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
u AS (SELECT id, lang, unnest(w) AS w1, unnest(range(len(w))) AS i FROM q),
v AS (SELECT lang, w1, lead(w1) OVER x AS w2, lead(w1, 2) OVER x AS w3 FROM u WINDOW x AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS s, w1 AS phrase, w1, w2, w3 FROM v
      UNION ALL SELECT lang, 2, w1 || ' ' || w2, w1, w2, w3 FROM v WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3 FROM v WHERE w3 IS NOT NULL),
f AS (SELECT lang, s, phrase, min(w1) AS w1, min(w2) AS w2, min(w3) AS w3, count(*) AS f FROM g GROUP BY lang, s, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE s = 1 GROUP BY lang),
c AS (SELECT lang, s, phrase, f AS a, w1, w2, w3 FROM f WHERE s > 1 AND f >= 10),
k AS (SELECT lang, s, phrase, a, 1 AS k, w1 AS x, CASE s WHEN 2 THEN w2 ELSE w2 || ' ' || w3 END AS y FROM c
      UNION ALL SELECT lang, s, phrase, a, 2, w1 || ' ' || w2, w3 FROM c WHERE s = 3),
e AS (SELECT k.*, l.f AS l, r.f AS r,
             CAST((1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM k JOIN f l ON k.lang = l.lang AND k.x = l.phrase JOIN f r ON k.lang = r.lang AND k.y = r.phrase),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS a
      FROM (SELECT lang, w1 || ' ' || w2 AS phrase, a FROM c WHERE s = 3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM c WHERE s = 3)
      GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE i.a IS NULL OR 100 * i.a < 50 * b.a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""


def statements() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": DECONTAMINATION,
        "op6_chat_formatting": CHAT,
        "op8_ngram_jaccard_join": JACCARD,
        "op10_license_scans": _licenses(),
        "op11_ranked_lexical_search": RANKED,
        "op12_html_extraction": ARTICLES,
        "op13_phrase_collocations": PHRASES,
    }
