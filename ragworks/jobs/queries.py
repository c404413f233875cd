"""Queries over the retrieval operators, each with DuckDB SQL for the same rows where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragworks.functions import features as feat
from ragworks.functions import text as tx
from ragworks.functions.helpers import pack_paragraphs
from ragworks.jobs.answering import answer_queries, evaluate_answered, log_answers
from ragworks.jobs.corpus import CLOSING, CONTRACT_PAGES, DAYS, DEFINITION_DOCS, FEATURE_CHUNKS, FEES, NL, NUMBER, PAGE_1, PARTY, TERMS
from ragworks.jobs.contract_plans import PLANNED_CHUNKS, planned_pages
from ragworks.jobs.ingest import delete_contracts, ingest_contracts, read_contracts
from ragworks.jobs.registered import ORACLES, QUERIES, Tables, query
from ragworks.operators import evaluate, index, lanes, registry, retrieve, structure, tables, term_index
from ragworks.schemas import EVAL_CHUNKS, QUERY_LOGS
from ragworks.sources import io
from ragworks.streaming.ingest import current_uploads, ingest_stream

__all__ = ["ORACLES", "QUERIES"]


def _bounded(pattern: str) -> str:
    """A Spark pattern between word boundaries in RE2, which knows only ASCII boundaries."""
    inner = pattern.removeprefix("(?i)").replace(r"\b", "")
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_]){inner}($|[^\p{{L}}\p{{N}}_])"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


# ---- text projections ---------------------------------------------------------------------------------------------

_PARTY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(x, '{_bounded(rf'{p}' + chr(92) + 's+shall')}') THEN '{p}'" for p in tx.OBLIGED) + " ELSE 'General' END"


@query(rf"""
WITH t AS (SELECT doc_id, concat(coalesce(text, ''), chr(1), chr(133), ' The ', {PARTY}, ' shall pay') AS x FROM documents)
SELECT doc_id, regexp_replace(x, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g') AS clean,
       regexp_replace(x, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS export,
       CAST(greatest(1, len(x) // 4) AS INTEGER) AS tokens,
       left(regexp_replace(regexp_replace(lower(regexp_replace(x, '^[\s\x{{85}}]+|[\s\x{{85}}]+$', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 60) AS slug,
       right(x, 600) AS tail, left(x, 300) AS snippet, {_PARTY_SQL} AS party
FROM t
""")
def t_text_projections(t: Tables) -> DataFrame:
    rows = t.sql(f"SELECT doc_id, concat(coalesce(text, ''), chr(1), chr(133), ' The ', {PARTY}, ' shall pay') AS x FROM documents")
    x = F.col("x")
    return rows.select(
        "doc_id", tx.clean_control(x).alias("clean"), tx.clean_export(x).alias("export"), tx.token_count(x).alias("tokens"), tx.slugify(x).alias("slug"),
        tx.tail_tokens(x).alias("tail"), tx.snippet(x, 300).alias("snippet"), tx.obligation_party(x).alias("party"),
    )


_STOPS = ", ".join(f"'{w}'" for w in tx.NAME_STOP_WORDS)
_FILE = "concat('LIC_', replace(p_name, ' ', '-'), CASE p_partkey % 5 WHEN 0 THEN ' Jeevan Arogya' WHEN 1 THEN ' Plan_9-inch-x' ELSE '' END, '_Brochure-(', cast(p_partkey AS string), ')_Eng.pdf')"


@query(f"""
WITH f AS (SELECT p_partkey, {_FILE} AS filename FROM part
           UNION ALL SELECT -1 - p_partkey, concat('policy_', cast(p_partkey AS string), '.pdf') FROM part),
k AS (SELECT *, upper(regexp_replace(filename, '\\.[^.]+$', '')) AS stem FROM f),
w AS (SELECT *, list_filter(regexp_extract_all(stem, '[A-Z0-9]+'), lambda x: NOT list_contains([{_STOPS}], x) AND NOT regexp_full_match(x, '[0-9]+')) AS kept FROM k)
SELECT p_partkey, filename, CASE WHEN len(kept) = 0 THEN stem
  WHEN list_has_all(kept, ['LIC', 'JEEVAN', 'AROGYA']) THEN 'LIC_JEEVAN_AROGYA' ELSE array_to_string(kept, '_') END AS policy_name
FROM w
""")
def t_policy_names(t: Tables) -> DataFrame:
    rows = t.sql(f"SELECT p_partkey, {_FILE} AS filename FROM part UNION ALL SELECT -1 - p_partkey, concat('policy_', cast(p_partkey AS string), '.pdf') FROM part")
    return rows.withColumn("policy_name", tx.normalize_policy_name(F.col("filename")))


@query(f"""
WITH l AS (SELECT o_orderkey, concat('Chapter ', o_orderpriority, CASE o_orderkey % 3 WHEN 0 THEN ' ..... 12 ' WHEN 1 THEN ' ... 12' ELSE '.....12 x' END) AS line FROM orders)
SELECT o_orderkey, regexp_matches({_strip("line")}, '\\.{{4,}}\\s*\\d+\\s*$') AS toc FROM l
""")
def t_contents_lines(t: Tables) -> DataFrame:
    rows = t.sql("SELECT o_orderkey, concat('Chapter ', o_orderpriority, CASE o_orderkey % 3 WHEN 0 THEN ' ..... 12 ' WHEN 1 THEN ' ... 12' ELSE '.....12 x' END) AS line FROM orders")
    return rows.select("o_orderkey", tx.is_toc_line(F.col("line")).alias("toc"))


# ---- structure ----------------------------------------------------------------------------------------------------


@query(f"""
SELECT doc_id, concat({PAGE_1}, {NL}, {FEES}, {NL}, {CLOSING}) AS text,
       len({PAGE_1}) + 1 AS second_page, len({PAGE_1}) + len({FEES}) + 2 AS third_page
FROM documents
""")
def s_join_pages(t: Tables) -> DataFrame:
    docs = structure.join_pages(t.sql(CONTRACT_PAGES))
    at = lambda i: F.get("page_offsets", i)["start"].cast("long")
    return docs.select("doc_id", "text", at(1).alias("second_page"), at(2).alias("third_page"))


@query(f"""
SELECT doc_id, page_number, start FROM (
  SELECT doc_id, 1 AS page_number, 0 AS start FROM documents
  UNION ALL SELECT doc_id, 2, CAST(len({PAGE_1}) + 1 AS INTEGER) FROM documents
  UNION ALL SELECT doc_id, 3, CAST(len({PAGE_1}) + len({FEES}) + 2 AS INTEGER) FROM documents)
""")
def s_page_offsets(t: Tables) -> DataFrame:
    return structure.page_offsets(t.sql(CONTRACT_PAGES))


_AT = f"len({PAGE_1}) + 1"


@query(f"""
SELECT doc_id, level, number, title, CAST(start AS INTEGER) AS start, strategy FROM (
  SELECT doc_id, 1 AS level, {NUMBER} AS number, 'Scope of Work' AS title, 0 AS start, 'S1_section' AS strategy FROM documents
  UNION ALL SELECT doc_id, 2, {NUMBER} || '.1', 'General Terms', 25, 'S4_subsec' FROM documents
  UNION ALL SELECT doc_id, 2, {NUMBER} || '.2', 'Fees and Costs', {_AT}, 'S4_subsec' FROM documents
  UNION ALL SELECT doc_id, 1, '', 'GENERAL CONDITIONS', {_AT} + len({FEES}) + 1, 'S5_caps' FROM documents)
""")
def s_headers(t: Tables) -> DataFrame:
    return structure.headers(structure.join_pages(t.sql(CONTRACT_PAGES)))


@query(f"""
SELECT doc_id, 0 AS span, {NUMBER} AS number, 'Scope of Work' AS title, 0 AS start, CAST({_AT} + len({FEES}) + 1 AS INTEGER) AS "end", 1 AS first_page, 2 AS last_page FROM documents
UNION ALL
SELECT doc_id, 1, '', 'GENERAL CONDITIONS', CAST({_AT} + len({FEES}) + 1 AS INTEGER), CAST({_AT} + len({FEES}) + 1 + len({CLOSING}) AS INTEGER), 3, 3 FROM documents
""")
def s_spans_and_pages(t: Tables) -> DataFrame:
    spans = structure.section_spans(structure.join_pages(t.sql(CONTRACT_PAGES)))
    return spans.select("doc_id", "span", "number", "title", "start", "end", F.get("page_range", 0).alias("first_page"), F.get("page_range", 1).alias("last_page"))


_RAW_FEES = _strip(f"concat({FEES}, {NL})")
_CHUNK_PARTS = f"""
SELECT doc_id, 1 AS seq, 'sec_' || {NUMBER} || '_1' AS chunk_id, {NUMBER} || '.1' AS section_number, 'General Terms' AS section_title, {NUMBER} AS parent_section,
       {PARTY} AS obligations_of, 'S4_subsec' AS header_strategy,
       concat('[Document | ', {NUMBER}, '.1 — General Terms | Obligations of: ', {PARTY}, ']', {NL}, {NL}, {TERMS}) AS page_content FROM documents
UNION ALL
SELECT doc_id, 2, 'sec_' || {NUMBER} || '_2', {NUMBER} || '.2', 'Fees and Costs', {NUMBER}, 'General', 'S4_subsec',
       concat('[Document | ', {NUMBER}, '.2 — Fees and Costs | Obligations of: General]', {NL}, {NL}, '[...continued from previous]', {NL}, {TERMS}, {NL}, {NL}, {_RAW_FEES}) FROM documents
UNION ALL
SELECT doc_id, 3, 'sec_general_conditions_main', '', 'GENERAL CONDITIONS', '', 'General', NULL,
       concat('[Document | GENERAL CONDITIONS | Obligations of: General]', {NL}, {NL}, {CLOSING}) FROM documents
"""


@query(f"""
SELECT *, CAST(greatest(1, len(page_content) // 4) AS INTEGER) AS token_count,
       coalesce(lag(chunk_id) OVER d, '') AS prev_chunk_id, coalesce(lead(chunk_id) OVER d, '') AS next_chunk_id
FROM ({_CHUNK_PARTS}) WINDOW d AS (PARTITION BY doc_id ORDER BY seq)
""")
def s_section_chunks(t: Tables) -> DataFrame:
    chunks = structure.section_chunks(structure.join_pages(t.sql(CONTRACT_PAGES)))
    return chunks.select(
        "doc_id", "seq", "chunk_id", "section_number", "section_title", "parent_section", "obligations_of", "header_strategy", "page_content", "token_count", "prev_chunk_id", "next_chunk_id"
    )


#: 0 to 44 list items in section 10.2.
_ITEMS_SPARK = "array_join(transform(sequence(1, 1 + cast(o_orderkey % 45 AS int)), i -> concat(cast(i AS string), '. item ', cast(i AS string))), chr(10))"
_ITEMS_DUCK = "array_to_string(list_transform(range(1, 2 + o_orderkey % 45), lambda i: concat(i, '. item ', i)), chr(10))"


@query("""
WITH n AS (SELECT o_orderkey, 1 + o_orderkey % 45 AS total FROM orders),
g AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((total - 13) / 9.0)) AS INTEGER) + 1)) AS g, greatest(0, ceil((total - 13) / 9.0)) AS last_group FROM n)
SELECT o_orderkey, CAST(9 * g + 1 AS INTEGER) AS first, CAST(CASE WHEN g < last_group THEN 9 * g + 9 ELSE total END AS INTEGER) AS last, CAST(total AS INTEGER) AS total FROM g
""")
def s_warranty_groups(t: Tables) -> DataFrame:
    rows = t.sql(f"SELECT o_orderkey, {_ITEMS_SPARK} AS body FROM orders")
    groups = structure.warranty_groups(structure.warranty_items(F.concat(F.lit("\n"), F.col("body"))))
    return rows.select("o_orderkey", F.explode(groups).alias("g")).select("o_orderkey", "g.first", "g.last", "g.total")


@query("""
WITH r AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS INTEGER) AS seq, l_returnflag AS base_id FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base_id ORDER BY seq) - 1 AS again FROM r),
n AS (SELECT doc_id, seq, CASE WHEN again = 0 THEN base_id ELSE base_id || '_dup' || again END AS chunk_id FROM d)
SELECT *, coalesce(lag(chunk_id) OVER w, '') AS prev_chunk_id, coalesce(lead(chunk_id) OVER w, '') AS next_chunk_id FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY seq)
""")
def s_unique_linked_ids(t: Tables) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag")
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).alias("seq"), F.col("l_returnflag").alias("base_id"))
    return structure.link_chunks(structure.dedupe_chunk_ids(rows)).drop("base_id")


@query("""
WITH p AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS ps FROM documents),
m AS (SELECT doc_id, list_reduce(ps, lambda a, x: CASE WHEN greatest(1, (len(string_split(a, chr(1))[-1]) + 2 + len(x)) // 4) <= 800
        THEN a || chr(10) || chr(10) || x ELSE a || chr(1) || x END) AS packed FROM p),
s AS (SELECT doc_id, string_split(packed, chr(1)) AS parts FROM m)
SELECT doc_id, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS part, unnest(parts) AS content FROM s
""")
def s_packed_paragraphs(t: Tables) -> DataFrame:
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    rows = t.documents.select("doc_id", F.posexplode(pack_paragraphs(text)).alias("pos", "content"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("part"), "content")


@query(f"""
WITH d AS (
  SELECT doc_id, 1 AS seq, 'def_eligible_borrower_fha' AS chunk_id, 'Eligible Borrower (FHA)' AS term, '"Eligible Borrower (FHA)": a person.' AS body FROM documents WHERE doc_id % 4 > 0
  UNION ALL SELECT doc_id, 2, 'def_bond', 'Bond', concat('"Bond": a debt', {NL}, 'of two lines.') FROM documents WHERE doc_id % 4 > 1
  UNION ALL SELECT doc_id, 3, 'def_bond_dup1', 'Bond', '"Bond": again.' FROM documents WHERE doc_id % 4 > 2)
SELECT doc_id, seq, chunk_id, term, concat('[IHDA Agreement | Section 1 — Definitions | Term: ', term, ']', {NL}, {NL}, body) AS page_content FROM d
""")
def s_definitions(t: Tables) -> DataFrame:
    found = structure.definition_chunks(t.sql(DEFINITION_DOCS))
    # the piece before the first term has no number of its own
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return found.select("doc_id", seq.alias("seq"), "chunk_id", "term", "page_content")


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body,
  CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['Eligible Borrower (FHA)'] ELSE ['Bond', 'Eligible Borrower (FHA)'] END AS terms FROM documents)
SELECT doc_id, array_to_string(list_filter(terms, lambda x: contains(concat('The Bond of an Eligible Borrower. ', body), x)), '|') AS present FROM d
""")
def s_defined_terms(t: Tables) -> DataFrame:
    chunks = t.sql("SELECT doc_id, concat('The Bond of an Eligible Borrower. ', coalesce(text, '')) AS page_content FROM documents")
    found = structure.defined_terms_present(chunks, structure.definition_chunks(t.sql(DEFINITION_DOCS)))
    return found.select("doc_id", F.array_join("def_terms_present", "|").alias("present"))


@query("""
SELECT doc_id, page_number, CASE page_number WHEN 1 THEN concat(cast(1 + doc_id % 9 AS string), '.1 General Terms')
  WHEN 2 THEN concat(cast(1 + doc_id % 9 AS string), '.2 Fees and Costs') ELSE 'GENERAL CONDITIONS' END AS context
FROM documents, (VALUES (1), (2), (3)) AS p(page_number)
""")
def s_heading_context(t: Tables) -> DataFrame:
    return t.sql(CONTRACT_PAGES).select("doc_id", "page_number", structure.heading_context(F.col("text")).alias("context"))


#: Lines are joined while they fit; one beyond the size is split at blanks (no word of the given texts is longer).
#: A unit is such a line or the shorter ones between two of them; ends are the places where its pieces end, counting a character between pieces.
_SPLIT = """
WITH RECURSIVE lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS no FROM documents),
marked AS (SELECT *, CASE WHEN len(line) > 1000 THEN 1 ELSE 0 END AS long FROM lines),
numbered AS (SELECT *, 2 * sum(long) OVER (PARTITION BY doc_id ORDER BY no) + 1 - long AS unit FROM marked),
units AS MATERIALIZED (SELECT doc_id, source, unit, CASE WHEN max(long) = 1 THEN ' ' ELSE chr(10) END AS sep,
  CASE WHEN max(long) = 1 THEN string_split(max(line), ' ') ELSE list(line ORDER BY no) END AS pieces FROM numbered GROUP BY ALL),
placed AS (SELECT doc_id, unit, unnest(range(1, len(pieces) + 1)) AS i, unnest(pieces) AS piece FROM units),
ends AS MATERIALIZED (SELECT doc_id, unit, list(stop ORDER BY i) AS c FROM (SELECT doc_id, unit, i, CAST(sum(len(piece) + 1) OVER (PARTITION BY doc_id, unit ORDER BY i) AS BIGINT) AS stop FROM placed) GROUP BY ALL),
steps AS (
  SELECT doc_id, unit, c, CAST(1 AS BIGINT) AS s, CAST(len(list_filter(c, lambda x: x <= 1001)) AS BIGINT) AS e FROM ends
  UNION ALL
  SELECT doc_id, unit, c, s, CAST(len(list_filter(c, lambda x: x <= 1001 + base)) AS BIGINT) FROM (
    SELECT doc_id, unit, c, s, CASE WHEN s > 1 THEN c[s - 1] ELSE 0 END AS base FROM (
      SELECT doc_id, unit, c, CAST(len(list_filter(c, lambda x: x < least_end)) + CASE WHEN least_end > 0 THEN 2 ELSE 1 END AS BIGINT) AS s
      FROM (SELECT doc_id, unit, c, greatest(c[e] - 201, c[e + 1] - 1001) AS least_end FROM steps WHERE e < len(c))))),
texts AS (SELECT doc_id, source, unit, s, regexp_replace(CASE WHEN sep = ' ' THEN array_to_string(pieces[s:e], ' ') ELSE array_to_string(pieces[s:e], chr(10)) END, '^\\s+|\\s+$', '', 'g') AS page_content FROM steps JOIN units USING (doc_id, unit))
SELECT doc_id, source, 1 AS page_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY unit, s) - 1 AS INTEGER) AS piece, page_content, CAST(len(page_content) AS INTEGER) AS size
FROM texts WHERE page_content <> ''
"""


@query(_SPLIT)
def s_policy_chunks(t: Tables) -> DataFrame:
    """Fixed-size chunks of every document."""
    pages = t.documents.select("doc_id", "source", F.lit(1).alias("page_number"), "text")
    return structure.policy_chunks(pages).select("doc_id", "source", "page_number", "piece", "page_content", F.length("page_content").alias("size"))


# ---- tables -------------------------------------------------------------------------------------------------------

_REGION_GRID = "concat(array(array('Term', ' Meaning ')), array_sort(collect_list(array(n_name, concat('nation ', cast(n_nationkey AS string))))))"


@query("""
WITH k AS (SELECT p_partkey, p_partkey % 7 AS m, p_name, p_brand FROM part)
SELECT p_partkey,
  CASE m WHEN 0 THEN 'scoring' WHEN 1 THEN 'criteria' WHEN 2 THEN 'reference' WHEN 3 THEN 'key_value' WHEN 4 THEN 'generic' WHEN 5 THEN 'skip' ELSE 'scoring' END AS kind,
  CASE m WHEN 0 THEN 'Item|Score|' WHEN 1 THEN 'Evaluation criteria|Weighted|' WHEN 2 THEN 'Rule 7|GFR|' WHEN 3 THEN 'Risk|Mitigation|' WHEN 4 THEN 'One|Two|Three|' WHEN 5 THEN '' ELSE 'Sold in|Share|' END
    || CASE m WHEN 6 THEN 'second|5 percentage' ELSE p_name || '|' || p_brand END || CASE m WHEN 4 THEN '|x' ELSE '' END AS signature
FROM k
""")
def b_classify_tables(t: Tables) -> DataFrame:
    rows = t.sql("""
SELECT p_partkey, filter(array(
  CASE p_partkey % 7 WHEN 0 THEN array('Item', 'Score') WHEN 1 THEN array('Evaluation criteria', 'Weighted') WHEN 2 THEN array('Rule 7', 'GFR') WHEN 3 THEN array('Risk', ' Mitigation')
    WHEN 4 THEN array('One', 'Two', 'Three') WHEN 6 THEN array('Sold in', 'Share') END,
  array('', NULL),
  CASE p_partkey % 7 WHEN 6 THEN array('second', '5 percentage') WHEN 4 THEN array(p_name, p_brand, 'x') ELSE array(p_name, p_brand) END), r -> r IS NOT NULL) AS grid FROM part""")
    return rows.select("p_partkey", tables.classify_table(F.col("grid")).alias("kind"), tables.table_signature(F.col("grid")).alias("signature"))


@query("""
SELECT p_partkey, CAST(2 AS INTEGER) AS n_rows, 'Name' AS h1, 'Brand' AS h2, p_name AS c1, p_brand AS c2 FROM part
""")
def b_markdown_grids(t: Tables) -> DataFrame:
    md = F.concat(F.lit("intro\n| Name | Brand |\n|:--|---|\n  |"), F.col("p_name"), F.lit(" |  "), F.col("p_brand"), F.lit("|\n|  |  |\nend"))
    rows = t.part.select("p_partkey", tables.md_table_to_grid(md).alias("g"))
    cell = lambda i, j: F.get(F.get("g", i), j)
    return rows.select("p_partkey", F.size("g").alias("n_rows"), cell(0, 0).alias("h1"), cell(0, 1).alias("h2"), cell(1, 0).alias("c1"), cell(1, 1).alias("c2"))


@query("""
WITH c AS (SELECT r_regionkey, r_name, list(n_name ORDER BY n_name) AS names, list('nation ' || n_nationkey ORDER BY n_name) AS told FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
w AS (SELECT *, greatest(4, list_max(list_transform(names, lambda x: len(x)))) AS a, greatest(7, list_max(list_transform(told, lambda x: len(x)))) AS b FROM c)
SELECT r_regionkey, 'table_p' || r_regionkey || '_t0_key_value' AS base_id,
  '[Document | Table (key_value) | Page ' || r_regionkey || ' | Near: ' || r_name || ']' || chr(10) || chr(10) || 'MARKDOWN:' || chr(10)
  || '| ' || rpad('Term', CAST(a AS INTEGER), ' ') || ' | ' || rpad('Meaning', CAST(b AS INTEGER), ' ') || ' |' || chr(10)
  || '|' || repeat('-', CAST(a + 2 AS INTEGER)) || '|' || repeat('-', CAST(b + 2 AS INTEGER)) || '|' || chr(10)
  || array_to_string(list_transform(range(1, len(names) + 1), lambda i: '| ' || rpad(names[i], CAST(a AS INTEGER), ' ') || ' | ' || rpad(told[i], CAST(b AS INTEGER), ' ') || ' |'), chr(10))
  || chr(10) || chr(10) || 'PROSE: ' || array_to_string(list_transform(range(1, len(names) + 1), lambda i: names[i] || ': ' || told[i]), ' | ') AS content,
  'markdown,prose' AS formats
FROM w
""")
def b_key_value_tables(t: Tables) -> DataFrame:
    rows = t.sql(f"SELECT r_regionkey, r_name, {_REGION_GRID} AS grid FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
    kind = tables.classify_table(F.col("grid"))
    made = tables.serialize_table(F.col("grid"), kind, F.col("r_name"), F.col("r_regionkey"), F.lit(0), F.lit(False))
    return rows.select("r_regionkey", made.alias("c")).select("r_regionkey", "c.base_id", "c.content", F.array_join("c.formats", ",").alias("formats"))


_SCORES = "array(array('Item', 'Score'), array(p_name, cast(p_size AS string)), array('', ''), array(p_brand, ''))"


@query("""
WITH w AS (SELECT *, greatest(len(p_name), len(p_brand), 4) AS a FROM part)
SELECT p_partkey, 'table_p' || p_size || '_t1_scoring_dup' AS base_id,
  '[Document | Table (scoring) | Page ' || p_size || ']' || chr(10) || chr(10) || 'MARKDOWN:' || chr(10)
  || '| ' || rpad('Item', CAST(a AS INTEGER), ' ') || ' | Score |' || chr(10) || '|' || repeat('-', CAST(a + 2 AS INTEGER)) || '|-------|' || chr(10)
  || '| ' || rpad(p_name, CAST(a AS INTEGER), ' ') || ' | ' || rpad(CAST(p_size AS VARCHAR), 5, ' ') || ' |' || chr(10)
  || '| ' || rpad(p_brand, CAST(a AS INTEGER), ' ') || ' |       |' || chr(10) || chr(10)
  || 'PIPE: Item=' || p_name || ' | Score=' || p_size || ' || Item=' || p_brand AS content
FROM w
""")
def b_scoring_tables(t: Tables) -> DataFrame:
    rows = t.sql(f"SELECT p_partkey, p_size, {_SCORES} AS grid FROM part")
    made = tables.serialize_table(F.col("grid"), tables.classify_table(F.col("grid")), F.lit(""), F.col("p_size"), F.lit(1), F.lit(True))
    return rows.select("p_partkey", made.alias("c")).select("p_partkey", "c.base_id", "c.content")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'table_recapture_duplicate' ELSE 'table_recapture_main' END AS base_id,
  'PIPE: Year 1=' || p_size || '% | Year 2=1% | ' || p_brand || '=0% | After 9yr=0%' AS pipe,
  'PROSE: Recapture percentages by year of sale after purchase: Year 1 is ' || p_size || '%, Year 2 is 1%, ' || p_brand || ' is 0%. Maximum recapture is always capped at 50% of gain on sale.' AS prose
FROM part
""")
def b_recapture_tables(t: Tables) -> DataFrame:
    rows = t.sql("SELECT p_partkey, array(array('Year', 'Percentage'), array('First', concat(cast(p_size AS string), '%')), array('second', '1%'), array(p_brand, '0%')) AS grid FROM part")
    rows = rows.where(tables.is_recapture(F.col("grid"), tables.classify_table(F.col("grid"))))
    made = rows.select("p_partkey", tables.serialize_recapture(F.col("grid"), F.col("p_partkey") % 2 == 0).alias("c"))
    part = lambda i: F.element_at(F.split("c.content", "\n\n"), i)
    return made.select("p_partkey", "c.base_id", part(3).alias("pipe"), part(4).alias("prose"))


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag || '|' || l_linestatus AS signature,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber) > 1 AS is_duplicate FROM lineitem
""")
def b_duplicate_tables(t: Tables) -> DataFrame:
    grid = F.array(F.array("l_returnflag", F.lit(" ")), F.array("l_linestatus"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"), F.lit(0).alias("table_index"), tables.table_signature(grid).alias("signature"))
    return tables.flag_duplicate_tables(rows).select(F.col("doc_id").alias("l_orderkey"), F.col("page_number").alias("l_linenumber"), "signature", "is_duplicate")


@query("""
SELECT conv_id, turn, 'Example B: ' || regexp_replace(coalesce(text, ''), '\\s+$', '') AS example FROM conversations
""")
def b_example_text(t: Tables) -> DataFrame:
    text = F.concat(F.lit("See below.\nexample "), F.lit("B: "), F.coalesce("text", F.lit("")), F.lit(" \n"))
    found = tables.example_text(text)
    return t.conversations.select("conv_id", "turn", F.concat(F.lit("Example"), F.substring(found, F.lit(8), F.length(found))).alias("example"))


# ---- features -----------------------------------------------------------------------------------------------------


def _cases(patterns: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(x, '{_bounded(p)}') THEN '{name}'" for name, p in patterns.items()) + f" ELSE '{otherwise}' END"


def _named(patterns: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, '{_bounded(p)}') THEN '{name}' END" for name, p in patterns.items()) + "], lambda y: y IS NOT NULL), ',')"


_CONTENT = rf"""CASE WHEN chunk_type = 'definition' THEN 'Definition' WHEN chunk_type = 'table' THEN 'Procedure'
  WHEN regexp_matches(x, '(?i)(^|[^\p{{L}}\p{{N}}_])means($|[^\p{{L}}\p{{N}}_].*[:;]|[:;])') OR regexp_matches(x, '{_bounded("(definition|define[ds]?)")}') THEN 'Definition'
  WHEN regexp_matches(x, '{_bounded("(procedure|process)")}') OR regexp_matches(x, '(?i)(^|[^\p{{L}}\p{{N}}_])(step|stage)\s+\d') THEN 'Procedure'
  WHEN len(x) < 120 AND regexp_matches({_strip("x")}, '(?m)\A[A-Z][A-Z\s\-]{{4,60}}$') THEN 'Heading' ELSE 'Clause' END"""


_RULES = rf"""
WITH c AS (SELECT doc_id, chunk_type, section_number, page_content AS x FROM ({FEATURE_CHUNKS})),
k AS (SELECT *, {_CONTENT} AS content_type, coalesce(nullif(section_number, ''), nullif(regexp_extract(x, '(?:^|\n)\s*(\d{{1,2}}\.\d{{1,2}}(?:\.\d{{1,2}})?)\s', 1), '')) AS section_id FROM c)
SELECT doc_id, content_type, section_id,
  nullif(concat_ws(' ', nullif(regexp_extract(x, '{feat.TIMELINE}', 1), ''), nullif(lower(regexp_extract(x, '{feat.TIMELINE}', 2)), '')), '') AS timeline,
  {_cases(feat.OBLIGATIONS, "Informational")} AS obligation,
  {_named(feat.PARTIES)} AS parties, {_named(feat.ACTIONS)} AS actions,
  CASE WHEN content_type IN ('Heading', 'Definition') THEN 'None' WHEN regexp_matches(x, '{_bounded(feat.HIGH_RISK)}') THEN 'High'
    WHEN regexp_matches(x, '{_bounded(feat.MEDIUM_RISK)}') THEN 'Medium' ELSE 'Low' END AS risk_level,
  CASE WHEN section_id IS NOT NULL THEN concat('Chapter ', split_part(section_id, '.', 1)) END AS chapter
FROM k
"""


@query(_RULES)
def f_rule_features(t: Tables) -> DataFrame:
    rows = feat.enrich(t.sql(FEATURE_CHUNKS))
    f = F.col("features")
    return rows.select(
        "doc_id", f["content_type"].alias("content_type"), f["section_id"].alias("section_id"), f["timeline"].alias("timeline"), f["obligation"].alias("obligation"),
        F.array_join(f["responsible_party"], ",").alias("parties"), F.array_join(f["action_type"], ",").alias("actions"), f["risk_level"].alias("risk_level"), f["chapter"].alias("chapter"),
    )


@query("""
WITH w AS (SELECT rid, doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}') AS ws FROM documents)),
c AS (SELECT rid, word, count(*) AS n, min(pos) AS first FROM w WHERE NOT list_contains([""" + ", ".join(f"'{w}'" for w in feat.STOP_WORDS) + """], word) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY n DESC, first) AS place FROM c),
k AS (SELECT rid, string_agg(word, ',' ORDER BY place) AS keywords FROM r WHERE place <= 5 GROUP BY rid)
SELECT doc_id, coalesce(keywords, '') AS keywords FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) LEFT JOIN k USING (rid)
""")
def f_keywords(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(feat.keywords(F.coalesce("text", F.lit(""))), ",").alias("keywords"))


@query(rf"""
WITH c AS (SELECT doc_id, regexp_replace({_strip("concat('[Document | x]', chr(10), coalesce(text, ''))")}, '\A\[.*?\]\s*', '') AS clean FROM documents)
SELECT doc_id, coalesce(nullif({_strip("regexp_extract(clean, '[A-Z][^.!?" + chr(92) + "n]{15,200}[.!?]')")}, ''),
  CASE WHEN len(clean) > 120 THEN {_strip("left(clean, 120)")} || '…' ELSE {_strip("clean")} END) AS summary FROM c
""")
def f_summary(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", feat.summary(F.concat(F.lit("[Document | x]\n"), F.coalesce("text", F.lit("")))).alias("summary"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Form,Section,Annex' WHEN 1 THEN 'Section' WHEN 2 THEN 'Terms of Reference,EOI' ELSE '' END AS documents,
  CASE p_partkey % 3 WHEN 0 THEN 'Payment Terms' WHEN 1 THEN 'Fees / Costs - Other' END AS title,
  CASE p_partkey % 3 WHEN 0 THEN 'Chapter ' || p_size WHEN 1 THEN 'Chapter 7' ELSE 'Chapter IV: The Fees' END AS chapter
FROM part
""")
def f_references_and_titles(t: Tables) -> DataFrame:
    rows = t.sql("""SELECT p_partkey,
  CASE p_partkey % 4 WHEN 0 THEN 'Formal Section 4, section 5, Annex B' WHEN 1 THEN 'Section Table 3' WHEN 2 THEN 'terms, Terms of Reference and the EOI' ELSE 'none' END AS a,
  CASE p_partkey % 3 WHEN 0 THEN concat('x', chr(10), '3.1 Payment Terms', chr(10), 'y') WHEN 1 THEN '2. Fees / Costs - Other' ELSE 'CHAPTER IV: The Fees ' END AS b,
  CASE p_partkey % 3 WHEN 0 THEN concat('sec_ch', cast(p_size AS string), '_x') ELSE 'sec_1' END AS chunk_id,
  CASE p_partkey % 3 WHEN 1 THEN '7.2' ELSE NULL END AS section FROM part""")
    b = F.col("b")
    return rows.select(
        "p_partkey", F.array_join(feat.document_referenced(F.col("a")), ",").alias("documents"), feat.section_title(b).alias("title"), feat.chapter(b, F.col("chunk_id"), F.col("section")).alias("chapter")
    )


#: Letters beyond ASCII become _, which is a letter at a boundary and none in a reference.
_NAMED_DOCUMENTS = f"""regexp_extract_all(regexp_replace(page_content, '[^\\x00-\\x7F]', '_', 'g'), '{feat.DOCUMENTS}', 1)"""
_KEYWORDS = f"""
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(page_content), '[a-z]{{3,}}') AS ws FROM chunks)),
n AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w WHERE NOT list_contains([{", ".join(f"'{w}'" for w in feat.STOP_WORDS)}], word) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS place FROM n),
keys AS (SELECT doc_id, string_agg(word, ', ' ORDER BY place) AS keywords FROM ranked WHERE place <= 5 GROUP BY doc_id)"""


@query(rf"""
WITH chunks AS MATERIALIZED ({FEATURE_CHUNKS}), rules AS ({_RULES}), {_KEYWORDS},
named AS (SELECT doc_id, {_NAMED_DOCUMENTS} AS found FROM chunks),
told AS (SELECT doc_id, array_to_string(list_filter(found, lambda x, i: list_position(list_transform(found, lambda y: lower(y)), lower(x)) = i)[1:5], ', ') AS documents FROM named),
short AS (SELECT doc_id, coalesce(nullif({_strip("regexp_extract(clean, '" + feat.SENTENCE + "')")}, ''), CASE WHEN len(clean) > 120 THEN {_strip("left(clean, 120)")} || '…' ELSE clean END) AS summary
  FROM (SELECT doc_id, {_strip("page_content")} AS clean FROM chunks))
SELECT chunk_id AS "Chunk ID", section_id AS "Section Id", chapter AS "Chapter", CAST(NULL AS VARCHAR) AS "Section Title", content_type AS "Content Type", obligation AS "Obligation", risk_level AS "Risk Level",
  replace(parties, ',', ', ') AS "Responsible Party", replace(actions, ',', ', ') AS "Action Type", timeline AS "Timeline", documents AS "Document Referenced", coalesce(keywords, '') AS "Keywords",
  summary AS "Summary", page_content AS "Text Content"
FROM chunks JOIN rules USING (doc_id) JOIN told USING (doc_id) JOIN short USING (doc_id) LEFT JOIN keys USING (doc_id)
""")
def f_export_table(t: Tables) -> DataFrame:
    """The flat feature table of every chunk."""
    return feat.export_features(feat.enrich(t.sql(FEATURE_CHUNKS)))


# ---- sources ------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey AS doc_id, 1 AS page_number, p_name AS text, 1 AS n_tables, p_brand AS cell FROM part
UNION ALL SELECT p_partkey, 9, 'md of ' || p_brand, 0, NULL FROM part
UNION ALL SELECT p_partkey, 3, '| a | b |' || chr(10) || '| ' || p_type || ' | 2 |' || chr(10) || 'x' || chr(10) || '| c |', 2, p_type FROM part
""")
def io_parser_pages(t: Tables) -> DataFrame:
    item = F.struct(F.lit("Table").alias("type"), F.lit("").alias("value"), F.concat(F.lit("|h|i|\n|-|-|\n|"), F.col("p_brand"), F.lit("|1|")).alias("md"))
    none = F.expr("CAST(array() AS array<struct<type:string,value:string,md:string>>)")
    empty = F.lit(None).cast("string")

    def page(number, text, md, items):
        return F.struct(F.lit(number).cast("int").alias("page"), text.alias("text"), md.alias("md"), items.alias("items"))

    md = F.concat(F.lit("| a | b |\n| "), F.col("p_type"), F.lit(" | 2 |\nx\n| c |"))
    pages = F.array(page(None, F.col("p_name"), empty, F.array(item)), page(9, F.lit(""), F.concat(F.lit("md of "), F.col("p_brand")), none), page(None, empty, md, none))
    parsed = io.parse_results_to_pages(t.part.select(F.col("p_partkey").alias("doc_id"), F.to_json(F.struct(pages.alias("pages"))).alias("json")))
    return parsed.select("doc_id", "page_number", "text", F.size("tables").alias("n_tables"), F.get(F.get(F.get("tables", 0), 1), 0).alias("cell"))


@query(r"""
WITH p AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS page_number,
  regexp_replace(CASE WHEN turn % 3 = 1 THEN ' ' ELSE concat(chr(7), coalesce(text, ''), ' ') END, '^[\s\x07]+|\s+$', '', 'g') AS text FROM conversations)
SELECT * FROM p WHERE len(text) > 0
""")
def io_page_text(t: Tables) -> DataFrame:
    rows = t.sql("""SELECT conv_id AS doc_id, turn AS at, CASE WHEN turn % 3 = 2 THEN '' ELSE NULL END AS markdown,
  CASE WHEN turn % 3 = 1 THEN ' ' ELSE concat(chr(7), coalesce(text, ''), ' ') END AS text, 'unused' AS content FROM conversations""")
    return io.page_text(rows)


@query("""
SELECT sha256(coalesce(text, '')) AS file_hash, min(doc_id) AS doc_id FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE lang = 'en') GROUP BY 1
""")
def io_needs_parse(t: Tables) -> DataFrame:
    files = t.documents.select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("file_hash"))
    return io.needs_parse(files, files.where("lang = 'en'")).groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))


@query("""
SELECT doc_id, source, CASE WHEN lang IN ('de', 'fr') THEN 'new' ELSE 'old' END AS version FROM documents
""")
def io_upsert(t: Tables) -> DataFrame:
    old = t.documents.where("coalesce(lang, '') <> 'de'").select("doc_id", "source", F.lit("old").alias("version"))
    new = t.documents.where("lang IN ('de', 'fr')").select("doc_id", "source", F.lit("new").alias("version"))
    once = index.upsert_chunks(old, new, ("doc_id",))
    return index.upsert_chunks(once, new, ("doc_id",))


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT 'src' || s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def io_delete_documents(t: Tables) -> DataFrame:
    gone = t.supplier.where("s_acctbal > 5000").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source"))
    return index.delete_document(t.documents.select("doc_id", "source"), gone, "source")


@query("SELECT sha256(s_name || chr(10)) AS file_hash, count(*) AS n FROM supplier GROUP BY 1")
def io_raw_files(t: Tables) -> DataFrame:
    """Every supplier's name written as a file of its own and read as raw bytes."""
    folder = io.new_folder(t.spark)
    io.write_each(t.supplier.select("s_suppkey", "s_name"), "s_suppkey", folder, "text")
    return io.read_raw_files(t.spark, folder, "*.txt").groupBy("file_hash").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(s_suppkey AS INTEGER) AS page_number, s_name AS text, 1 AS n_tables, 'x' AS cell FROM supplier")
def io_pages_cache(t: Tables) -> DataFrame:
    """Pages cached as one file each and read again."""
    folder = io.new_folder(t.spark)
    pages = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("int").alias("page_number"), F.col("s_name").alias("text"), F.expr("array(array(array('x', NULL)))").alias("tables"))
    io.write_each(pages, "k", folder, "json")
    got = io.read_pages_cache(t.spark, folder, "*.json")
    return got.select("page_number", "text", F.size("tables").alias("n_tables"), F.get(F.get(F.get("tables", 0), 0), 0).alias("cell"))


@query("SELECT text AS input, role AS expected, concat(conv_id, '_', turn) AS expected_chunk_id, conv_id AS manual_id, 'f' AS filename FROM conversations")
def io_eval_sets(t: Tables) -> DataFrame:
    """An evaluation set written and read again."""
    folder = io.new_folder(t.spark)
    io.write_eval_set(t.sql("SELECT text AS input, role AS expected, concat(cast(conv_id AS string), '_', cast(turn AS string)) AS expected_chunk_id, conv_id AS manual_id, 'f' AS filename FROM conversations"), folder)
    return io.read_eval_set(t.spark, folder, EVAL_CHUNKS)


@query("SELECT doc_id, n_chars, to_json([coalesce(lang, '?'), coalesce(source, '?')]) AS tags, CAST(DATE '2020-01-01' + CAST(doc_id % 300 AS INTEGER) AS VARCHAR) AS day FROM documents")
def f_flat_metadata(t: Tables) -> DataFrame:
    """Metadata of every document: numbers as they are, lists as JSON, dates as text."""
    rows = t.documents.select(
        "doc_id", "n_chars", F.array(F.coalesce("lang", F.lit("?")), F.coalesce("source", F.lit("?"))).alias("tags"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).alias("day")
    )
    return feat.flatten_metadata(rows)


# ---- index and retrieval ------------------------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')"


def _index_sql(source: str = "documents") -> str:
    return f"""
tok AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM {source}),
post AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM tok) GROUP BY ALL),
dl AS MATERIALIZED (SELECT doc_id, len(ws) AS dl FROM tok),
corpus AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
freq AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM freq, corpus),
mean AS MATERIALIZED (SELECT avg(raw) AS mean FROM raw),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN {index.EPSILON} * mean ELSE raw END AS idf FROM raw, mean)"""


_INDEX = _index_sql()
_SCORES_SQL = f"""{_INDEX},
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
score AS (
  SELECT query_id, doc_id, round(sum(times * idf * tf * {index.K1 + 1} / (tf + {index.K1} * (1 - {index.B} + {index.B} * dl / avgdl))), 6) AS score
  FROM q JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), corpus GROUP BY ALL),
hits AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM score QUALIFY rank <= 10)"""


def _bm25_index(t: Tables, path: str | None = None) -> dict[str, DataFrame]:
    return term_index.build_term_index(t.documents.select("doc_id", "text"), path or io.new_folder(t.spark), "doc_id", "text")


def _bm25_hits(t: Tables, k: int = 10) -> DataFrame:
    return retrieve.bm25_topk(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), _bm25_index(t), k, "doc_id", pad=False)


def _described(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits with the columns of their documents. Hits are a table first: where they are few, they go to the texts, and no text is moved to them."""
    return io.written(hits, "found").join(docs, "doc_id")


@query(f"WITH {_INDEX} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf")
def e_term_stats(t: Tables) -> DataFrame:
    return _bm25_index(t)["term_stats"].select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_INDEX} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM post) AS n_postings, (SELECT CAST(sum(tf) AS BIGINT) FROM post) AS n_tokens FROM corpus")
def e_index_counts(t: Tables) -> DataFrame:
    path = io.new_folder(t.spark)
    made = _bm25_index(t, path)
    tokens = term_index.posting_counts(t.spark, path)
    counted = index.index_count(made["doc_stats"]).select(F.col("n").alias("n_docs"))
    return counted.crossJoin(made["corpus_stats"].select("avgdl")).crossJoin(tokens).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_postings", "n_tokens")  # one row each


@query()
def e_embeddings(t: Tables) -> DataFrame:
    """Every document with its hashed vector; tests compare it with a plain encoder."""
    return index.embed(t.documents.select("doc_id", F.col("text").alias("page_content"))).select("doc_id", "embedding")


def _counting_encoder() -> index.Encoder:
    """An encoder that SQL can express: characters, e's and blanks of a text."""
    return lambda texts: [[float(len(x)), float(x.count("e")), float(x.count(" "))] for x in texts]


_COUNTED = """SELECT doc_id, CAST(len(x) AS DOUBLE) AS v0, CAST(len(x) - len(replace(x, 'e', '')) AS DOUBLE) AS v1, CAST(len(x) - len(replace(x, ' ', '')) AS DOUBLE) AS v2
FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)"""


def _components(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *[F.get("embedding", i).cast("double").alias(f"v{i}") for i in range(3)])


@query(_COUNTED)
def e_embed_by_encoder(t: Tables) -> DataFrame:
    """Every document through an encoder that is a parameter."""
    return _components(index.embed(t.documents.select("doc_id", F.col("text").alias("page_content")), _counting_encoder))


@query(_COUNTED)
def e_embed_in_lanes(t: Tables) -> DataFrame:
    """The same from lanes with a store: a third of the documents first, then all."""
    texts, store = t.documents.select("doc_id", F.col("text").alias("page_content")), io.new_folder(t.spark)
    lanes.embed_in_lanes(texts.where("doc_id % 3 = 0"), _counting_encoder, store)
    return _components(lanes.embed_in_lanes(texts, _counting_encoder, store))


@query(f"WITH {_SCORES_SQL} SELECT * FROM hits")
def r_bm25_topk(t: Tables) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return _bm25_hits(t)


@query(f"""WITH {_INDEX},
bench AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'zzz-unknown' ELSE text END AS text FROM benchmark),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_WORDS}) AS term FROM bench) GROUP BY ALL),
score AS (
  SELECT query_id, doc_id, round(sum(times * idf * tf * {index.K1 + 1} / (tf + {index.K1} * (1 - {index.B} + {index.B} * dl / avgdl))), 6) AS score
  FROM q JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), corpus GROUP BY ALL)
SELECT query_id, doc_id, coalesce(score, 0.0) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0.0) DESC, doc_id) AS INTEGER) AS rank
FROM bench CROSS JOIN dl LEFT JOIN score USING (query_id, doc_id) QUALIFY rank <= 10
""")
def r_bm25_padded(t: Tables) -> DataFrame:
    """Ten documents a query even where fewer match."""
    queries = t.sql("SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'zzz-unknown' ELSE text END AS query FROM benchmark")
    return retrieve.bm25_topk(queries, _bm25_index(t), 10, "doc_id")


_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9)"


def _dense_sql(k: int, extra: str = "") -> str:
    return f"""SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS INTEGER) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 {extra} QUALIFY rank <= {k}"""


def _dense(t: Tables, k: int, vectors: DataFrame | None = None) -> DataFrame:
    queries = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.dense_topk(queries, t.embeddings if vectors is None else vectors, k, "vec_id")


@query(f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({_dense_sql(10)})")
def r_dense_topk(t: Tables) -> DataFrame:
    """Exact nearest vectors of every hundredth vector among all."""
    return _dense(t, 10).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, vec_id, rank FROM ({_dense_sql(15, 'AND b.label = 3')})")
def r_dense_filtered(t: Tables) -> DataFrame:
    """The same among vectors of one type."""
    typed = t.embeddings.withColumn("chunk_type", F.col("label").cast("string"))
    return _dense(t, 15, retrieve.filter_chunk_type(typed, "3")).drop("score")


_OPEN = "(a.vec_id % 200 = 0 OR b.label IN (1, 2))"


@query(f"SELECT query_id, vec_id, rank FROM ({_dense_sql(15, f'AND {_OPEN}')})")
def r_filter_manuals(t: Tables) -> DataFrame:
    """The nearest vectors among the manuals that each query allows; every second query allows all."""
    some = F.when(F.col("vec_id") % 200 == 0, F.expr("CAST(array() AS array<int>)")).otherwise(F.array(F.lit(1), F.lit(2)))
    queries = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", some.alias("manual_ids"))
    return retrieve.dense_topk(queries, t.embeddings.withColumn("manual_id", F.col("label")), retrieve.POLICY_TOP_K, "vec_id").drop("score")


_NEAR_IDS = "SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id - a.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND b.vec_id BETWEEN a.vec_id AND a.vec_id + 9"


@query(f"""
WITH d AS ({_dense_sql(10)}), s AS ({_NEAR_IDS}),
m AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.vec_id, s.vec_id) AS vec_id, d.rank AS dense_rank, CAST(s.rank AS INTEGER) AS sparse_rank,
  round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 9) AS rrf_score FROM d FULL JOIN s ON d.query_id = s.query_id AND d.vec_id = s.vec_id)
SELECT query_id, vec_id, rrf_score, coalesce(dense_rank, 0) AS dense_rank, coalesce(sparse_rank, 0) AS sparse_rank,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS INTEGER) AS rank FROM m
""")
def r_rank_fusion(t: Tables) -> DataFrame:
    """Nearest vectors fused with a second ranking."""
    ids = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("step"))
    second = ids.select("query_id", (F.col("query_id") + F.col("step")).alias("vec_id"), (F.col("step") + 1).alias("rank")).join(t.embeddings.select("vec_id"), "vec_id", "left_semi")
    fused = retrieve.rrf_merge(_dense(t, 10), second, "vec_id")
    return fused.fillna(0, ["dense_rank", "sparse_rank"])


#: All documents as chunks and all benchmark items as queries, with the vector of the same number where there is one.
_CHUNKS = "SELECT doc_id, text, lang, label, embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id"
_QUERIES = "SELECT item_id AS query_id, text, embedding, CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'en' ELSE 'de' END AS chunk_types FROM benchmark LEFT JOIN embeddings ON item_id = vec_id"


def _hybrid_sql(k: int, open_: str = "true", typed: str = "true") -> str:
    """Dense and sparse top k and their fusion, as CTEs; open_: which chunks b a query a may see, typed: which of them on the dense side."""
    return f"""chunks AS MATERIALIZED ({_CHUNKS}), qs AS MATERIALIZED ({_QUERIES}), {_index_sql("chunks")},
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_WORDS}) AS term FROM qs) GROUP BY ALL),
score AS MATERIALIZED (
  SELECT query_id, doc_id, round(sum(times * idf * tf * {index.K1 + 1} / (tf + {index.K1} * (1 - {index.B} + {index.B} * dl / avgdl))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), corpus GROUP BY ALL),
sparse AS MATERIALIZED (
  SELECT s.query_id, s.doc_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.doc_id) AS rank
  FROM score s JOIN qs a ON a.query_id = s.query_id JOIN chunks b ON b.doc_id = s.doc_id WHERE {open_} QUALIFY rank <= {k}),
dense AS MATERIALIZED (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, doc_id) AS rank FROM qs a JOIN chunks b ON {open_} AND {typed} AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL QUALIFY rank <= {k}),
merged AS (
  SELECT query_id, doc_id, d.rank AS dense_rank, s.rank AS sparse_rank, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 9) AS rrf_score
  FROM dense d FULL JOIN sparse s USING (query_id, doc_id)),
fused AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS rank FROM merged)"""


def _hybrid_tables(t: Tables) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(queries, chunks without texts, written index). Texts go into the index as they are read; they are not moved to meet vectors."""
    chunks = t.sql(_CHUNKS).select("doc_id", F.col("lang").alias("chunk_type"), F.col("label").cast("long").alias("manual_id"), "embedding")
    return t.sql(_QUERIES).withColumnRenamed("text", "query"), io.written(chunks, "chunks"), _bm25_index(t)


def _hybrid(t: Tables, typed: bool = False) -> DataFrame:
    queries, chunks, made = _hybrid_tables(t)
    queries = queries if typed else queries.drop("chunk_types")
    return retrieve.hybrid_retrieve(queries, chunks.select("doc_id", "embedding", "chunk_type"), made, chunks.select("doc_id", "chunk_type", "manual_id"), key="doc_id", pad=False)


_RANKS = "query_id, doc_id, CAST(coalesce(dense_rank, 0) AS INTEGER) AS dense_rank, CAST(coalesce(sparse_rank, 0) AS INTEGER) AS sparse_rank, rrf_score, CAST(rank AS INTEGER) AS rank"


@query(f"WITH {_hybrid_sql(10, typed='(a.chunk_types IS NULL OR b.lang = a.chunk_types)')} SELECT {_RANKS}, lang AS chunk_type FROM fused JOIN chunks USING (doc_id)")
def r_hybrid(t: Tables) -> DataFrame:
    """Vectors and BM25 over all documents fused for every benchmark item; two of three items ask for one type of vectors each."""
    hits = _hybrid(t, typed=True).fillna(0, ["dense_rank", "sparse_rank"])
    return hits.select("query_id", "doc_id", "chunk_type", "dense_rank", "sparse_rank", "rrf_score", "rank")


@query(f"WITH {_hybrid_sql(15, '(a.query_id % 3 = 0 OR b.label IN (a.query_id % 10, 5))')} SELECT {_RANKS}, CAST(label AS BIGINT) AS manual_id FROM fused JOIN chunks USING (doc_id) WHERE rank <= 15")
def r_policy_hybrid(t: Tables) -> DataFrame:
    """The same among the manuals that each query allows, on both sides before ranking; every third query allows all."""
    queries, chunks, made = _hybrid_tables(t)
    some = F.when(F.col("query_id") % 3 == 0, F.expr("CAST(NULL AS array<bigint>)")).otherwise(F.array(F.col("query_id") % 10, F.lit(5).cast("long")))
    hits = retrieve.policy_retrieve(queries.drop("chunk_types").withColumn("manual_ids", some), chunks.select("doc_id", "embedding", "manual_id"), made, chunks.select("doc_id", "manual_id"), key="doc_id")
    return hits.fillna(0, ["dense_rank", "sparse_rank"]).select("query_id", "doc_id", "manual_id", "dense_rank", "sparse_rank", "rrf_score", "rank")


@query(f"""WITH {_hybrid_sql(10)},
x AS (SELECT query_id, CASE query_id % 4 WHEN 0 THEN NULL WHEN 1 THEN query_id ELSE query_id + 1 END AS expected FROM qs),
h AS (SELECT x.query_id, expected, min(CASE WHEN doc_id = expected THEN rank END) AS hit, count(f.doc_id) AS n, count(CASE WHEN doc_id % 9 IN (2, 4) THEN 1 END) AS pages FROM x LEFT JOIN fused f USING (query_id) GROUP BY ALL),
m AS (
  SELECT 'recall' AS metric, CASE WHEN n = 0 THEN 0 WHEN expected IS NULL OR hit IS NOT NULL THEN 1 ELSE 0 END AS score FROM h
  UNION ALL SELECT 'reciprocal_rank', CASE WHEN n = 0 THEN 0 WHEN expected IS NULL THEN 1 ELSE coalesce(1.0::DOUBLE / hit, 0) END FROM h
  UNION ALL SELECT 'page_hit', CASE WHEN pages > 0 THEN 1 ELSE 0 END FROM h)
SELECT 'hybrid' AS experiment, metric, round(avg(score::DOUBLE), 6) AS mean, count(*) AS n FROM m GROUP BY metric
""")
def v_hybrid_evaluation(t: Tables) -> DataFrame:
    """A hybrid run scored from the evaluation set to the summary: recall, reciprocal rank and page hits."""
    hits = io.written(_hybrid(t).select("query_id", F.col("doc_id").cast("string").alias("chunk_id"), "rank", (F.col("doc_id") % 9).cast("int").alias("page_number")), "run")
    wanted = F.when(F.col("query_id") % 4 == 1, F.col("query_id")).when(F.col("query_id") % 4 > 1, F.col("query_id") + 1).cast("string")
    expected = t.sql(_QUERIES).select("query_id", wanted.alias("expected_chunk_id"), F.expr("array('2', '4')").alias("sources"))
    return evaluate.evaluate_run(hits, expected, "hybrid")


@query(f"""WITH {_SCORES_SQL}
SELECT query_id, string_agg('[Source ' || rank || ' | type=' || coalesce(lang, '?') || ' | section=' || coalesce(source, '?') || ' | id=' || doc_id || ']' || chr(10) || coalesce(text, ''),
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM hits JOIN documents USING (doc_id) WHERE rank <= 8 GROUP BY query_id
""")
def r_contexts(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.col("text").alias("page_content"), F.col("lang").alias("chunk_type"), F.lit("").alias("section_number"), F.col("source").alias("section"))
    return retrieve.build_context(_described(_bm25_hits(t), docs), key="doc_id")


@query(f"""WITH {_SCORES_SQL}
SELECT query_id, string_agg('[Source ' || rank || ' | ' || coalesce(source, '?') || ' | ? | Page ' || doc_id % 7 || ']' || chr(10) || coalesce(text, ''),
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM hits JOIN documents USING (doc_id) GROUP BY query_id
""")
def r_policy_contexts(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.col("text").alias("page_content"), F.col("source").alias("policy_name"), F.lit(None).cast("string").alias("insurer"), (F.col("doc_id") % 7).alias("page_number"))
    return retrieve.build_policy_context(_described(_bm25_hits(t), docs))


@query(f"""WITH {_SCORES_SQL}
SELECT query_id, rank, CAST(doc_id AS VARCHAR) AS chunk_id, coalesce(lang, '?') AS chunk_type, coalesce(source, '?') AS section, left(text, 300) AS snippet, 'Optional' AS feat_obligation
FROM hits JOIN documents USING (doc_id) WHERE rank <= 8
""")
def r_sources(t: Tables) -> DataFrame:
    docs = t.documents.select(
        "doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("page_content"), F.col("lang").alias("chunk_type"),
        F.lit(None).cast("string").alias("section_number"), F.col("source").alias("section"), F.lit("Optional").alias("feat_obligation"),
    )
    return retrieve.source_list(_described(_bm25_hits(t), docs)).drop("feat_risk_level", "feat_content_type", "feat_summary")


@query(f"""WITH {_SCORES_SQL}
SELECT query_id, rank, doc_id % 5 AS manual_id, CAST(doc_id % 7 AS INTEGER) AS page_number, source AS policy_name, lang AS insurer, 'health' AS category, concat(source, '.pdf') AS filename,
  left(coalesce(text, ''), 400) AS snippet
FROM hits JOIN documents USING (doc_id)
""")
def r_policy_sources(t: Tables) -> DataFrame:
    docs = t.documents.select(
        "doc_id", (F.col("doc_id") % 5).alias("manual_id"), (F.col("doc_id") % 7).cast("int").alias("page_number"), F.col("source").alias("policy_name"), F.col("lang").alias("insurer"),
        F.lit("health").alias("category"), F.concat(F.coalesce("source", F.lit("")), F.lit(".pdf")).alias("filename"), F.concat(F.lit("\x07"), F.col("text")).alias("page_content"),
    )
    return retrieve.policy_source_list(_described(_bm25_hits(t), docs))


@query(f"""
WITH u AS (SELECT conv_id * 100 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'),
c AS (SELECT query_id, 'facts of ' || query_id AS context FROM u WHERE len(query) > 100)
SELECT query_id, CASE WHEN context IS NOT NULL THEN 'Use: ' || context || ' only.' END AS system, CASE WHEN context IS NOT NULL THEN query END AS "user",
  CASE WHEN context IS NULL THEN '{retrieve.NOTHING_INDEXED.replace("'", "''")}' END AS answer FROM u LEFT JOIN c USING (query_id)
""")
def r_answer_requests(t: Tables) -> DataFrame:
    queries = t.sql("SELECT conv_id * 100 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'")
    contexts = queries.where("length(query) > 100").select("query_id", F.concat(F.lit("facts of "), F.col("query_id").cast("string")).alias("context"))
    return retrieve.answer_requests(queries, contexts, "Use: {context} only.")


@query(f"""
WITH c AS ({_dense_sql(50)}), r AS (SELECT query_id, vec_id, rank AS first_rank, round(CASE WHEN vec_id % 3 = 0 THEN 1 - 0.001 * (rank - 1) ELSE (vec_id % 10) / 10.0 END, 9)::DOUBLE AS score FROM c)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS INTEGER) AS rank FROM r
""")
def r_rerank(t: Tables) -> DataFrame:
    scored = _dense(t, 50).withColumn("rerank_score", F.when(F.col("vec_id") % 3 == 0, None).otherwise((F.col("vec_id") % 10) / 10.0))
    return retrieve.rerank(scored, 50, key="vec_id")


# ---- evaluation ---------------------------------------------------------------------------------------------------

_EXPECTED = "SELECT vec_id AS query_id, CASE vec_id % 300 WHEN 0 THEN NULL WHEN 100 THEN cast(vec_id AS string) ELSE cast(vec_id + 1 AS string) END AS expected_chunk_id FROM embeddings WHERE vec_id % 100 = 0"


def _run(t: Tables, k: int) -> DataFrame:
    return _dense(t, k).select("query_id", F.col("vec_id").cast("string").alias("chunk_id"), "rank")


@query(f"""
WITH run AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS chunk_id, rank FROM ({_dense_sql(10)}) WHERE query_id NOT IN (SELECT vec_id FROM embeddings WHERE label > 7)), x AS ({_EXPECTED}),
h AS (SELECT x.query_id, expected_chunk_id, min(CASE WHEN chunk_id = expected_chunk_id THEN rank END) AS hit, count(run.query_id) AS n FROM x LEFT JOIN run USING (query_id) GROUP BY ALL)
SELECT query_id, CASE WHEN n = 0 THEN false WHEN expected_chunk_id IS NULL THEN true ELSE hit IS NOT NULL END AS recall,
  CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN expected_chunk_id IS NULL THEN 1.0::DOUBLE ELSE coalesce(1.0::DOUBLE / hit, 0.0::DOUBLE) END AS rr FROM h
""")
def v_recall_and_rank(t: Tables) -> DataFrame:
    silent = t.embeddings.where("label > 7").select(F.col("vec_id").alias("query_id"))
    run, expected = _run(t, 10).join(silent, "query_id", "left_anti"), t.sql(_EXPECTED)
    return evaluate.retrieval_recall(run, expected).join(evaluate.reciprocal_rank(run, expected), "query_id")


@query(f"""
WITH c AS ({_dense_sql(100)}),
run AS (SELECT l AS "limit", query_id, vec_id, rank FROM c, (VALUES (10), (50), (100)) AS x(l) WHERE rank <= l),
qrels AS (SELECT a.vec_id AS query_id, b.vec_id FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.label = b.label),
n AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY 1),
g AS (SELECT l AS "limit", k, query_id, n FROM n, (VALUES (10), (50), (100)) AS x(l), (VALUES (1), (3), (5), (10), (15), (20), (25)) AS y(k)),
h AS (SELECT g.limit, g.k, g.query_id, g.n, min(r.rank) AS first, count(q.vec_id) AS hits FROM g
  LEFT JOIN run r ON r.limit = g.limit AND r.query_id = g.query_id AND r.rank <= g.k AND EXISTS (SELECT 1 FROM qrels z WHERE z.query_id = r.query_id AND z.vec_id = r.vec_id)
  LEFT JOIN qrels q ON q.query_id = r.query_id AND q.vec_id = r.vec_id GROUP BY ALL)
SELECT "limit", k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(hits / n::DOUBLE), 6) AS recall FROM h GROUP BY ALL
""")
def v_limit_sweep(t: Tables) -> DataFrame:
    """Recall and reciprocal rank for three limits and seven cut-offs; vectors of a query's label are relevant."""
    best = _dense(t, max(evaluate.LIMITS))
    limits = F.explode(F.array(*map(F.lit, evaluate.LIMITS)))
    run = best.select(limits.alias("limit"), "query_id", F.col("vec_id").alias("doc_id"), "rank").where(F.col("rank") <= F.col("limit"))
    asked = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return evaluate.label_sweep(run, asked, t.embeddings.select(F.col("vec_id").alias("doc_id"), "label"))


@query(f"""
WITH run AS (SELECT query_id, vec_id % 9 AS page FROM ({_dense_sql(5)}))
SELECT vec_id AS query_id, vec_id IN (SELECT query_id FROM run WHERE page IN (2, 4)) AS page_hit FROM embeddings WHERE vec_id % 100 = 0
""")
def v_page_hits(t: Tables) -> DataFrame:
    run = _dense(t, 5).select("query_id", (F.col("vec_id") % 9).cast("int").alias("page_number"))
    expected = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.expr("array('2', '4', 'x')").alias("sources"))
    return evaluate.page_hit(run, expected)


_OUTPUTS = "SELECT conv_id * 100 + turn AS query_id, 'Why?' AS question, CASE WHEN turn % 3 = 0 THEN NULL ELSE text END AS answer, 'So.' AS expected FROM conversations"


_JUDGE = lambda kind: f"'{evaluate.JUDGES[kind]}'"


@query(f"""
WITH o AS ({_OUTPUTS})
SELECT query_id, 'groundedness' AS kind, CASE WHEN answer IS NOT NULL THEN {_JUDGE("groundedness")} END AS system, 'FACTS: one' || chr(10) || chr(10) || 'two' || chr(10) || 'STUDENT ANSWER: ' || answer AS "user", CASE WHEN answer IS NULL THEN false END AS grade FROM o
UNION ALL SELECT query_id, 'correctness', CASE WHEN answer IS NOT NULL THEN {_JUDGE("correctness")} END, 'QUESTION: Why?' || chr(10) || 'GROUND TRUTH ANSWER: So.' || chr(10) || 'STUDENT ANSWER: ' || answer, CASE WHEN answer IS NULL THEN false END FROM o
UNION ALL SELECT query_id, 'relevance', CASE WHEN answer IS NOT NULL THEN {_JUDGE("relevance")} END, 'QUESTION: Why?' || chr(10) || 'STUDENT ANSWER: ' || answer, CASE WHEN answer IS NULL THEN false END FROM o
UNION ALL SELECT query_id, 'retrieval_relevance', {_JUDGE("retrieval_relevance")}, 'FACTS: one' || chr(10) || chr(10) || 'two' || chr(10) || 'QUESTION: Why?', NULL FROM o
""")
def v_judge_requests(t: Tables) -> DataFrame:
    outputs = t.sql(_OUTPUTS).withColumn("sources", F.array(F.lit("one"), F.lit("t\x07wo")))
    parts = [evaluate.judge_requests(outputs, k) for k in ("groundedness", "correctness", "relevance", "retrieval_relevance")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS experiment, 'correctness' AS metric, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS mean, count(*) AS n FROM labels GROUP BY 1
UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END, 'groundedness', round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE, count(*) FROM labels GROUP BY 1
""")
def v_grades_and_summary(t: Tables) -> DataFrame:
    verdicts = t.sql("""
SELECT doc_id, 'correctness' AS kind, concat('{"explanation": "x", "correct": "', CASE toxic WHEN 1 THEN 'TRUE' ELSE 'yes' END, '"}') AS verdict FROM labels
UNION ALL SELECT doc_id, 'groundedness' AS kind, CASE quality WHEN 1 THEN '{"grounded": "true"}' ELSE '{"correct": "true"}' END AS verdict FROM labels""")
    scores = evaluate.parse_grades(verdicts).select(F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("experiment"), F.col("kind").alias("metric"), F.col("grade").cast("double").alias("score"))
    return evaluate.experiment_summary(scores)


@query("""
SELECT 'Question ' || doc_id AS input, 'Answer' AS expected, CAST(doc_id AS VARCHAR) AS expected_chunk_id, doc_id % 11 AS manual_id, source AS filename
FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 15) WHERE doc_id % 4 <> 1
""")
def v_synthetic_rows(t: Tables) -> DataFrame:
    """Evaluation rows for the first fifteen chunks, a report of fixed size, of which some generations failed."""
    chunks = t.documents.select(F.col("doc_id").alias("chunk_key"), F.col("text").alias("page_content"), (F.col("doc_id") % 11).alias("manual_id"), F.col("source").alias("filename"))
    sample = evaluate.sample_chunks_for_eval(chunks)
    question = F.when(F.col("chunk_key") % 4 != 1, F.concat(F.lit("Question "), F.col("chunk_key").cast("string")))
    return evaluate.synthetic_eval_rows(chunks, sample.select("chunk_key", question.alias("question"), F.lit("Answer").alias("answer")))


# ---- from retrieval to answers ------------------------------------------------------------------------------------

_ANSWERED = f"""{_hybrid_sql(10)},
hit AS MATERIALIZED (SELECT query_id, rank, doc_id, lang, text AS content FROM fused JOIN chunks USING (doc_id) WHERE rank <= 8),
ctx AS (SELECT query_id, string_agg('[Source ' || rank || ' | type=' || coalesce(lang, '?') || ' | section=? | id=' || doc_id || ']' || chr(10) || coalesce(content, ''),
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, CAST(count(*) AS INTEGER) AS n_sources, first(CAST(doc_id AS VARCHAR) ORDER BY rank) AS first_source,
  string_agg(left(content, 300), chr(10) || chr(10) ORDER BY rank) AS facts FROM hit GROUP BY query_id),
answered AS MATERIALIZED (SELECT query_id, qs.text AS query, CASE WHEN context IS NULL THEN '{retrieve.NOTHING_INDEXED.replace("'", "''")}' ELSE left('Use: ' || context || ' only.', 120) || ' -- ' || qs.text END AS response,
  n_sources, first_source, facts FROM qs LEFT JOIN ctx USING (query_id))"""


def _answered(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(hits, answers) of the hybrid search; the answer repeats the head of its prompt and the question."""
    docs = t.documents.select("doc_id", F.col("text").alias("page_content"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit("").alias("section_number"), F.lit("").alias("section"))
    hits = io.written(_described(_hybrid(t), docs), "retrieved")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return hits, answer_queries(asked, hits, "Use: {context} only.", lambda system, user: F.concat(F.substring(system, 1, 120), F.lit(" -- "), user))


@query(f"WITH {_ANSWERED} SELECT query_id AS id, query AS query_text, response AS response_text, coalesce(n_sources, 0) AS n_sources, first_source FROM answered")
def r_answer_log(t: Tables) -> DataFrame:
    """The query log after every benchmark item was retrieved for, answered and logged with its sources."""
    logs = t.spark.createDataFrame([], QUERY_LOGS)
    log = log_answers(logs, _answered(t)[1], F.lit("2024-01-01").cast("timestamp"))
    sources = F.from_json("sources_used", "array<struct<rank:int,chunk_id:string>>")
    return log.select("id", "query_text", "response_text", F.size(sources).alias("n_sources"), F.get(sources, 0)["chunk_id"].alias("first_source"))


_CLEAN = r"regexp_replace({}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g')"


@query(f"""WITH {_ANSWERED},
g AS (
  SELECT 'correctness' AS metric, concat_ws(chr(10), 'QUESTION: ' || query, 'GROUND TRUTH ANSWER: ' || 'So.', 'STUDENT ANSWER: ' || response) AS u FROM answered
  UNION ALL SELECT 'relevance', concat_ws(chr(10), 'QUESTION: ' || query, 'STUDENT ANSWER: ' || response) FROM answered
  UNION ALL SELECT 'groundedness', CASE WHEN n_sources > 0 THEN concat_ws(chr(10), 'FACTS: ' || {_CLEAN.format("coalesce(facts, '')")}, 'STUDENT ANSWER: ' || response) END FROM answered
  UNION ALL SELECT 'retrieval_relevance', CASE WHEN n_sources > 0 THEN concat_ws(chr(10), 'FACTS: ' || {_CLEAN.format("coalesce(facts, '')")}, 'QUESTION: ' || query) END FROM answered),
x AS (SELECT query_id, query_id % 5 AS expected FROM qs),
h AS (SELECT x.query_id, min(CASE WHEN doc_id = expected THEN rank END) AS hit, count(f.doc_id) AS n, count(CASE WHEN doc_id % 9 IN (2, 4) THEN 1 END) AS pages FROM x LEFT JOIN fused f USING (query_id) GROUP BY ALL),
m AS (
  SELECT metric, CASE WHEN length(u) % 2 = 0 THEN 1.0 ELSE 0.0 END AS score FROM g
  UNION ALL SELECT 'recall', CASE WHEN n > 0 AND hit IS NOT NULL THEN 1.0 ELSE 0.0 END FROM h
  UNION ALL SELECT 'reciprocal_rank', CASE WHEN n = 0 THEN 0 ELSE coalesce(1.0::DOUBLE / hit, 0) END FROM h
  UNION ALL SELECT 'page_hit', CASE WHEN pages > 0 THEN 1.0 ELSE 0.0 END FROM h)
SELECT 'answered' AS experiment, metric, round(avg(score::DOUBLE), 6) AS mean, count(*) AS n FROM m GROUP BY metric
""")
def v_answer_evaluation(t: Tables) -> DataFrame:
    """Retrieval metrics and the grades of a judge that likes even lengths, over one evaluation set with its answers."""
    hits, answers = _answered(t)
    run = hits.select("query_id", "chunk_id", "rank", (F.col("doc_id") % 9).cast("int").alias("page_number"))
    expected = t.benchmark.select(F.col("item_id").alias("query_id"), F.lit("So.").alias("expected"), (F.col("item_id") % 5).cast("string").alias("expected_chunk_id"), F.expr("array('2', '4')").alias("sources"))
    yes = '{"correct": "True", "relevant": "true", "grounded": "TRUE"}'
    return evaluate_answered(run, answers, expected, lambda system, user: F.when(F.length(user) % 2 == 0, yes).otherwise("{}"), "answered")


# ---- registry and logs --------------------------------------------------------------------------------------------

_UPLOADS = "SELECT doc_id AS upload_id, sha2(coalesce(text, ''), 256) AS file_hash, concat(coalesce(source, 'none'), '-draft', CASE WHEN doc_id % 10 = 9 THEN '.txt' ELSE '.PDF' END) AS filename FROM documents"


@query("""
WITH u AS (SELECT doc_id AS upload_id, sha256(coalesce(text, '')) AS file_hash, coalesce(source, 'none') AS s, doc_id % 10 <> 9 AS named FROM documents),
known AS (SELECT DISTINCT file_hash FROM u WHERE s = 'src3'),
r AS (SELECT *, file_hash IN (SELECT file_hash FROM known) AS there, row_number() OVER (PARTITION BY file_hash, named ORDER BY upload_id) AS n FROM u)
SELECT upload_id, CASE WHEN NOT named THEN 'not a pdf' WHEN there OR n > 1 THEN 'already indexed' END AS reason,
  CASE WHEN named AND NOT there AND n = 1 THEN upper(s) END AS policy_name, CASE WHEN named AND NOT there AND n = 1 THEN 'queued' END AS status FROM r
""")
def g_admit_uploads(t: Tables) -> DataFrame:
    uploads = t.sql(_UPLOADS)
    accepted, rejected = registry.admit_uploads(uploads, uploads.where("filename LIKE 'src3-%'"), contract=True)
    none = F.lit(None).cast("string")
    return accepted.select("upload_id", none.alias("reason"), "policy_name", "status").unionByName(rejected.select("upload_id", "reason", none.alias("policy_name"), none.alias("status")))


_MANUALS = "SELECT c_custkey AS id, c_mktsegment AS filename, CASE c_custkey % 3 WHEN 0 THEN 'indexing' WHEN 1 THEN 'failed' ELSE 'active' END AS status, CASE c_custkey % 3 WHEN 1 THEN 'old error' END AS error FROM customer"


@query(f"""
WITH m AS ({_MANUALS}), e AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS s, arg_max(props, (ts, event_id)) AS e FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT m.id, filename, coalesce(s, status) AS status, CASE WHEN e.id IS NULL THEN error ELSE e END AS error FROM m LEFT JOIN e USING (id)
""")
def g_apply_status(t: Tables) -> DataFrame:
    events = t.events.where("user_id % 2 = 0").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("props").alias("error"), "ts", "event_id")
    return registry.apply_status(t.sql(_MANUALS), events)


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders")
def g_list_manuals(t: Tables) -> DataFrame:
    return registry.list_manuals(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")))


@query(f"SELECT * FROM ({_MANUALS}) WHERE NOT (status IN ('indexing', 'failed') AND filename NOT IN ('BUILDING', 'MACHINERY'))")
def g_reconcile_stale(t: Tables) -> DataFrame:
    manuals = t.sql(_MANUALS)
    return registry.reconcile_stale(manuals, manuals.where("filename IN ('BUILDING', 'MACHINERY')").select(F.concat_ws("_", F.col("id").cast("string"), "filename").alias("name")))


@query("SELECT c_custkey AS id, 'plan_' || c_mktsegment || '.pdf' AS filename, 'active' AS status, CASE c_custkey % 3 WHEN 1 THEN 'old error' END AS error, upper(c_mktsegment) AS policy_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def g_reindex_plan(t: Tables) -> DataFrame:
    manuals = t.sql(_MANUALS).withColumn("filename", F.concat(F.lit("plan_"), "filename", F.lit(".pdf")))
    return registry.reindex_plan(manuals, manuals.where("filename IN ('plan_BUILDING.pdf', 'plan_MACHINERY.pdf')").select(F.concat_ws("_", F.col("id").cast("string"), "filename").alias("name")))


@query("""
SELECT manual_id, 0 AS piece, text AS page_content, policy_name, status FROM (
  SELECT c_custkey AS manual_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'new ' || c_name ELSE 'old ' || c_name END AS text,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN upper(c_mktsegment) ELSE 'OLD' END AS policy_name,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'active' ELSE CASE c_custkey % 3 WHEN 0 THEN 'indexing' WHEN 1 THEN 'failed' ELSE 'active' END END AS status FROM customer)
""")
def g_reindex(t: Tables) -> DataFrame:
    """Every chunk after the manuals whose file exists were chunked again, with the status of its manual; old chunks of these are gone."""
    manuals = t.sql(_MANUALS).withColumn("filename", F.concat(F.lit("plan_"), "filename", F.lit(".pdf")))
    files = manuals.where("filename IN ('plan_BUILDING.pdf', 'plan_MACHINERY.pdf')").select(F.concat_ws("_", F.col("id").cast("string"), "filename").alias("name"))
    pages = t.sql("SELECT c_custkey AS manual_id, 1 AS page_number, concat('new ', c_name) AS text FROM customer")
    old = t.sql("SELECT c_custkey AS manual_id, 1 AS page_number, 0 AS piece, concat('old ', c_name) AS page_content, 'OLD' AS policy_name FROM customer")
    stale = old.where("manual_id % 2 = 0").withColumn("piece", F.lit(1)).withColumn("page_content", F.lit("stale"))
    named = t.sql("SELECT c_custkey AS manual_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
    after, chunks = registry.reindex(manuals, files, pages, old.unionByName(stale.join(named, "manual_id", "left_semi")))
    return chunks.join(after.select(F.col("id").alias("manual_id"), "status"), "manual_id").select("manual_id", "piece", "page_content", "policy_name", "status")


@query("""
WITH f AS (SELECT user_id AS log_id, CASE WHEN value > 50 THEN 1 ELSE -1 END AS value, ts, event_id FROM events),
l AS (SELECT log_id, arg_max(value, (ts, event_id)) AS v FROM f GROUP BY 1)
SELECT c_custkey AS id, CAST(coalesce(v, 0) AS INTEGER) AS feedback, 0::BIGINT AS rejected FROM customer LEFT JOIN l ON log_id = c_custkey WHERE c_acctbal > 0
UNION ALL SELECT -1, 0, count(*) FROM f WHERE log_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
""")
def g_apply_feedback(t: Tables) -> DataFrame:
    logs = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit(None).cast("int").alias("feedback"))
    feedback = t.events.select(F.col("user_id").alias("log_id"), F.when(F.col("value") > 50, 1).otherwise(-1).alias("value"), "ts", "event_id")
    updated, rejected = registry.apply_feedback(logs, feedback)
    count = rejected.agg(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("int").alias("feedback"), F.count(F.lit(1)).alias("rejected"))
    return updated.withColumn("rejected", F.lit(0).cast("long")).unionByName(count).fillna(0, ["feedback"])


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, s_name AS filename, 0::BIGINT AS n_chunks FROM supplier
UNION ALL SELECT 'pre-indexed', NULL, (SELECT count(*) FROM documents)
""")
def g_list_documents(t: Tables) -> DataFrame:
    uploads = t.supplier.select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("filename"), F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error"))
    both = registry.list_documents(uploads, t.documents).unionByName(registry.list_documents(uploads.where("false"), t.documents))
    return both.select("doc_id", "filename", "n_chunks").fillna(0, ["n_chunks"])


@query("""
SELECT conv_id AS id, count(*) AS n_sources, min(turn) AS first_turn FROM conversations GROUP BY 1
""")
def g_query_log(t: Tables) -> DataFrame:
    answers = t.conversations.select(
        F.col("conv_id").alias("query_id"), F.lit("q").alias("query_text"), F.lit("a").alias("response_text"),
        F.struct(F.col("turn").alias("rank"), "text").alias("source"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    logs = t.spark.createDataFrame([], QUERY_LOGS)
    log = registry.append_query_log(logs, answers)
    sources = F.from_json("sources_used", "array<struct<rank:long,text:string>>")
    return log.select("id", F.size(sources).cast("long").alias("n_sources"), F.get(sources, 0)["rank"].alias("first_turn"))


# ---- streaming ----------------------------------------------------------------------------------------------------


@query(r"SELECT DISTINCT sha256(coalesce(text, '')) AS file_hash, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN 'active' ELSE 'failed' END AS status FROM documents")
def k_ingest_stream(t: Tables) -> DataFrame:
    """All documents taken in as a stream of page files, in several batches and then once more; each content once."""
    folder = io.new_folder(t.spark)
    pages = t.documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("file_hash"), F.col("source").alias("filename"), F.lit(1).alias("page_number"), "text")
    pages.repartitionByRange(4, "doc_id").write.json(f"{folder}/in")
    for _ in range(2):
        ingest_stream(t.spark, f"{folder}/in", f"{folder}/tables", f"{folder}/progress", files_per_batch=2).awaitTermination()
    return current_uploads(t.spark, f"{folder}/tables").select("file_hash", "status")


# ---- contracts as one job -----------------------------------------------------------------------------------------


def _ingested(t: Tables) -> dict[str, DataFrame]:
    """The given documents as contracts: half of them, a third of all deleted, then all, so that some replace what is there."""
    folder, pages = io.new_folder(t.spark), planned_pages(t)
    ingest_contracts(pages.where("doc_id % 2 = 0"), folder)
    delete_contracts(t.documents.where("doc_id % 3 = 0").select("doc_id"), folder)
    return ingest_contracts(pages, folder)


_INGESTED = f"SELECT concat(doc_id, '/', chunk_id) AS doc_id, chunk_id, page_content AS text FROM ({PLANNED_CHUNKS})"


@query(rf"""
WITH k AS (SELECT *, page_content AS x FROM ({PLANNED_CHUNKS}))
SELECT doc_id, chunk_id, chunk_type, section_number, prev_chunk_id, next_chunk_id, {_cases(feat.OBLIGATIONS, "Informational")} AS obligation, {_named(feat.PARTIES)} AS parties,
  CAST(len(list_filter(regexp_split_to_array(lower(x), '\s+'), lambda w: w <> '')) AS INTEGER) AS dl
FROM k
""")
def ingest_contract_chunks(t: Tables) -> DataFrame:
    """Chunks of the ingested contracts with their links, features and lengths in the term index."""
    made = _ingested(t)
    chunks = made["chunks"].withColumn("chunk_key", F.concat_ws("/", F.col("doc_id").cast("string"), "chunk_id")).join(made["doc_stats"], "chunk_key")
    parties = F.array_join("features.responsible_party", ",").alias("parties")
    return chunks.select("doc_id", "chunk_id", "chunk_type", "section_number", "prev_chunk_id", "next_chunk_id", F.col("feat_obligation").alias("obligation"), parties, "dl")


@query(f"WITH chunks AS MATERIALIZED ({_INGESTED}), {_index_sql('chunks')} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf")
def ingest_contract_terms(t: Tables) -> DataFrame:
    """The term index of the ingested contracts."""
    return _ingested(t)["term_stats"].select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH chunks AS MATERIALIZED (SELECT * FROM ({_INGESTED}) WHERE CAST(split_part(doc_id, '/', 1) AS BIGINT) % 3 <> 0), {_index_sql('chunks')}
SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf, (SELECT count(*) FROM chunks) AS n_chunks FROM idf""")
def ingest_contract_deleted(t: Tables) -> DataFrame:
    """The term index and the number of chunks after all contracts were taken in and a third was deleted, read from the written tables."""
    folder = io.new_folder(t.spark)
    ingest_contracts(planned_pages(t), folder)
    delete_contracts(t.documents.where("doc_id % 3 = 0").select("doc_id"), folder)
    made = read_contracts(t.spark, folder)
    count = F.broadcast(made["chunks"].agg(F.count(F.lit(1)).alias("n_chunks")))  # one row
    return made["term_stats"].select("term", "df", F.round("idf", 6).alias("idf")).crossJoin(count)
