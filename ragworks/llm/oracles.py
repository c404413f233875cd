"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from ragworks.llm import license_scan
from ragworks.llm.common import ASCII_LOWER, ASCII_UPPER
from ragworks.llm.decontamination import CONTAINMENT, SHINGLE_WORDS
from ragworks.llm.line_dedup import RATIO
from ragworks.llm.pii import ACCEPT, ADDED_KINDS, BASE_KINDS, CONTEXT_CHARS, CONTEXT_GAIN
from ragworks.llm.spelling import MIN_COUNT, MIN_LENGTH, NOISE
from ragworks.llm.spelling import RATIO as FORM_RATIO
from ragworks.llm.topk import SCALE, TOP_K
from ragworks.llm.words import words


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = f"""
WITH item AS (
  SELECT row_number() OVER () AS k, item_id, {_words('text')} AS w FROM benchmark),
sized AS (SELECT k, item_id, w, least({SHINGLE_WORDS}, len(w)) AS width FROM item WHERE len(w) > 0),
wanted AS (
  SELECT DISTINCT k, item_id, width,
         unnest(list_transform(generate_series(1, len(w) - width + 1), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS s
  FROM sized),
total AS (SELECT k, count(*) AS q FROM wanted GROUP BY k),
doc AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text')} AS w FROM documents),
held AS (
  SELECT DISTINCT rid, doc_id, width,
         unnest(list_transform(generate_series(1, len(w) - width + 1), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS s
  FROM doc, (SELECT DISTINCT width FROM sized) WHERE len(w) >= width),
hit AS (SELECT h.rid, h.doc_id, w.k, w.item_id, count(*) AS n FROM held h JOIN wanted w USING (width, s) GROUP BY ALL)
SELECT doc_id, item_id, q AS n_shingles, n AS n_shared, CAST(n AS DOUBLE) / q AS containment
FROM hit JOIN total USING (k) WHERE n >= ceil({CONTAINMENT} * q - 1e-9)
"""

#: The kinds' patterns in DuckDB's syntax: without look-around and possessive repeats, which change no match.
_PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": ADDED_KINDS[0].pattern,
    "national_id": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = (
    "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN CAST(d[i] AS INT)"
    " WHEN CAST(d[i] AS INT) > 4 THEN 2 * CAST(d[i] AS INT) - 9 ELSE 2 * CAST(d[i] AS INT) END)) % 10 = 0"
)
_MOVED = "(replace(v, ' ', '')[5:] || replace(v, ' ', '')[:4])"
_PII_CONFIRM = {
    "email": "true",
    "ip": "list_min(list_transform(string_split(v, '.'), lambda p: len(ltrim(p, '0')) < 4 AND coalesce(try_cast(right('0' || ltrim(p, '0'), 4) AS INT), 999) <= 255))",
    "card": f"len(d) BETWEEN 16 AND 19 AND {_LUHN}",
    "phone": "len(d) BETWEEN 8 AND 15",
    "iban": "list_reduce(list_prepend(0, list_transform(string_split(regexp_replace(m, '(.)', '\\1,', 'g')[:-2], ','), lambda c: CAST(CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END AS INT))),"
    " lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1",
    "national_id": "NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$')",
}


def _pii_kind(place: int, kind) -> str:
    name, pattern = kind.name, _PII_PATTERNS[kind.name]
    return f"""
  SELECT rid, {place} AS place, '{name}' AS kind, s AS "start", s + len(v) AS "end", score FROM (
    SELECT rid, s, v, {_DIGITS} AS d, {_MOVED} AS m,
           CASE WHEN regexp_matches(lower(text[greatest(0, s - {CONTEXT_CHARS}) + 1:s]), '{kind.context}')
                THEN CAST({kind.base + CONTEXT_GAIN} AS DOUBLE) ELSE CAST({kind.base} AS DOUBLE) END AS score
    FROM (
      SELECT rid, text, unnest(vs) AS v,
             unnest(list_transform(range(1, len(vs) + 1), lambda i: CAST(list_sum(list_transform(gs[1:i], lambda g: len(g)))
               + coalesce(list_sum(list_transform(vs[1:i - 1], lambda x: len(x))), 0) AS INT))) AS s
      FROM (SELECT rid, text, regexp_extract_all(text, '{pattern}') AS vs, regexp_split_to_array(text, '{pattern}') AS gs FROM doc)
      WHERE len(vs) > 0))
  WHERE score >= {ACCEPT} AND {_PII_CONFIRM[name]}"""


PII = f"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
span AS ({" UNION ALL ".join(_pii_kind(i, k) for i, k in enumerate([*BASE_KINDS, *ADDED_KINDS]))}),
told AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in BASE_KINDS)},
         string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY place, "start") FILTER (place < {len(BASE_KINDS)}) AS base,
         string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY place, "start") AS spans,
         string_agg(printf('%.2f', score), ',' ORDER BY place, "start") AS scores
  FROM span GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in BASE_KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM doc LEFT JOIN told USING (rid)
"""

_TEMPLATE_ROWS = ", ".join(
    f"({i}, '{label}', list_distinct(string_split('{b' '.join(words(text)).decode()}', ' ')), {license_scan.window(len(words(text)))})" for i, (label, text) in enumerate(license_scan.TEMPLATES)
)


def _phrase_places(phrase: str) -> str:
    ws = phrase.split()
    test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(ws, 1))
    return f"list_filter(range(0, len(w)), lambda i: {test})"


LICENSES = f"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text, {_words('text')} AS w FROM documents),
template(t, label, tokens, width) AS (VALUES {_TEMPLATE_ROWS}),
able AS (
  SELECT rid, w, label, tokens, width, ceil({license_scan.CONTAINMENT} * len(tokens) - 1e-9) AS must FROM doc, template
  WHERE len(list_intersect(list_distinct(w), tokens)) >= ceil({license_scan.CONTAINMENT} * len(tokens) - 1e-9)),
block AS (SELECT rid, label, tokens, must, unnest(list_transform(range(1, len(w) + 1), lambda i: list_distinct(w[i:i + width - 1]))) AS own FROM able),
met AS (
  SELECT rid, label, max(len(list_intersect(own, tokens)) / CAST(len(tokens) AS DOUBLE)) AS share
  FROM block WHERE len(list_intersect(own, tokens)) >= must GROUP BY ALL),
placed AS (
  SELECT rid, doc_id, len(w) AS n_words,
         {", ".join(f"{_phrase_places(p)} AS p{i}" for i, p in enumerate(license_scan.PHRASES))} FROM doc),
base AS (
  SELECT *, {" || ".join(f"p{i}" for i in range(len(license_scan.PHRASES)))} AS places FROM placed),
named AS (
  SELECT rid, label FROM met
  {" ".join(f"UNION SELECT rid, '{label}' FROM base WHERE len(p{i}) > 0" for i, label in enumerate(license_scan.PHRASES.values()))}),
labels AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM named GROUP BY rid),
best AS (SELECT rid, max(share) AS share FROM met GROUP BY rid)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       array_to_string(list_sort(list_distinct(list_filter([{", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(license_scan.PHRASES.values()))}], lambda x: x IS NOT NULL))), ',') AS base_labels,
       coalesce(labels, '') AS labels,
       greatest(CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(share, 0)) AS score
FROM base LEFT JOIN labels USING (rid) LEFT JOIN best USING (rid)
"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

LINE_DEDUP = f"""
WITH pages AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce('=' || source, '') AS site, text,
         string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT site, count(*) AS total FROM pages GROUP BY site),
seen AS (SELECT DISTINCT rid, site, unnest(list_transform(lines, lambda x: trim(x, chr(32) || chr(9) || chr(13)))) AS line FROM pages),
hot AS (
  SELECT s.site, s.line FROM seen s JOIN totals t USING (site) WHERE s.line <> ''
  GROUP BY s.site, s.line, t.total
  HAVING count(*) > 1 AND count(*) > CAST({RATIO} AS DOUBLE) * t.total),
lists AS (SELECT site, list(line) AS boilerplate FROM hot GROUP BY site),
cut AS (
  SELECT p.*, list_filter(p.lines, lambda x: NOT list_contains(coalesce(l.boilerplate, []), trim(x, chr(32) || chr(9) || chr(13)))) AS kept
  FROM pages p LEFT JOIN lists l USING (site))
SELECT doc_id, source,
       CASE WHEN len(kept) < len(lines) THEN array_to_string(kept, chr(10)) ELSE text END AS text,
       CAST(coalesce(len(lines), 0) AS INTEGER) AS n_lines,
       CAST(coalesce(len(lines) - len(kept), 0) AS INTEGER) AS n_dropped
FROM cut
"""

#: Entries of the byte table of CRC-32, and the unsigned CRC-32 of a string column by it; crc_table is a table of one row.
CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS crc_of FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) AS v FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    byte = f"list_transform(range(octet_length(encode({text}))), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295)"


def _levels(name: str, levels: int) -> str:
    """Tables {name}1.. of the levels above {name}0(tree, i, h), and {name}_step0.. with what stands beside each node."""
    out = []
    for k in range(levels):
        open_ = f"(SELECT tree FROM {name}{k} GROUP BY tree HAVING count(*) > 1)"
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE tree IN {open_} GROUP BY tree, i // 16)")
        out.append(
            f"{name}_step{k} AS MATERIALIZED (SELECT a.tree, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r "
            f"FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.i // 16 = b.i // 16 WHERE a.tree IN {open_} GROUP BY a.tree, a.i)"
        )
    tops = " UNION ALL ".join(f"SELECT tree, any_value(h) AS root FROM {name}{k} GROUP BY tree HAVING count(*) = 1" for k in range(levels + 1))
    return ",\n".join([*out, f"{name}_root AS MATERIALIZED ({tops})"])


def _folded(levels: int) -> str:
    """Steps of the leaves and then of the subroots, one inner query a level."""
    rows = "(SELECT *, coalesce(tampered, leaf) AS f, '' AS proof FROM leaves)"
    for name, at, tree in (("g", "at", "tree"), ("s", "place", "''")):
        for k in range(levels):
            rows = (
                f"(SELECT x.* REPLACE (CASE WHEN y.i IS NULL THEN x.f ELSE sha256(concat(y.l, x.f, y.r)) END AS f, concat(x.proof, y.l, y.r) AS proof) "
                f"FROM {rows} x LEFT JOIN {name}_step{k} y ON y.tree = x.{tree} AND y.i = x.{at} // {16**k})".replace("x.''", "''")
            )
    return rows


def _framed(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def merkle(levels: int = 5) -> str:
    """Rows of op11 for at most 16 ** levels leaves a source, and as many sources."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    lowered = f"translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}')"
    return f"""
WITH {CRC_TABLE},
hashed AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256(concat({", ".join(map(_framed, columns))})) AS leaf,
  CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN sha256(concat({", ".join(_framed(lowered if c == "text" else c) for c in columns)})) END AS tampered
  FROM documents, crc_table),
g0 AS MATERIALIZED (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
{_levels("g", levels)},
placed AS MATERIALIZED (SELECT tree, root, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM g_root),
s0 AS MATERIALIZED (SELECT '' AS tree, place AS i, root AS h FROM placed),
{_levels("s", levels)},
leaves AS MATERIALIZED (SELECT doc_id, g0.tree, leaf, tampered, g0.i AS at, placed.root AS subroot, place, s_root.root FROM g0 JOIN placed USING (tree), s_root)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM {_folded(levels)}
"""


MERKLE = merkle()

SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS MATERIALIZED (SELECT id, run, count(*) AS k FROM (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, k, {crc32("id || ':' || run")} AS h FROM runs, crc_table),
spelt AS (SELECT CASE WHEN h % {NOISE} = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, k FROM hashed),
known AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
cut AS MATERIALIZED (SELECT word, i, left(word, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, unnest(range(length(word))) AS i FROM known)),
shorter AS (SELECT DISTINCT cut.word, known.word AS other FROM cut JOIN known ON known.word = cut.a || cut.b),
near AS MATERIALIZED (
  SELECT word, other FROM shorter UNION ALL SELECT other, word FROM shorter
  UNION ALL SELECT DISTINCT x.word, y.word FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b WHERE x.word <> y.word),
best AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY o.n DESC, other) AS other, max(o.n) AS other_n FROM near JOIN known o ON o.word = near.other GROUP BY near.word),
forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {FORM_RATIO} * n THEN other END AS form, CASE WHEN other_n >= {FORM_RATIO} * n THEN other_n END AS form_n
  FROM known LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT chain.word, forms.word, forms.form FROM chain JOIN forms ON forms.word = chain.next)
SELECT forms.word, forms.form, chain.root, forms.n, forms.n_near, forms.form_n FROM forms JOIN chain ON chain.word = forms.word AND chain.next IS NULL
"""

TOPK = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= {TOP_K}
"""
