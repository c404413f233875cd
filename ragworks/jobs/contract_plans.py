"""Contracts of seven plans, built around the whole text of each document, and SQL for the chunks that they must give.

The plan is doc_id modulo 7: sections with sub-sections; a chapter with a
third level; warranties in section 10.2; a section without sub-sections that
long texts fill beyond the bound of a chunk; definitions; tables; no header.
What each plan gives follows from arithmetic on doc_id, so SQL needs no parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragworks.jobs.corpus import CLOSING, FEES, NL, NUMBER, PAGE_1, PARTY, TERMS
from ragworks.jobs.registered import Tables, query
from ragworks.operators import structure

PLAN = "doc_id % 7"
TEXT = "coalesce(text, '')"

DUTY = f"concat('The ', {PARTY}, ' shall keep records.')"
DEEP = f"concat({NUMBER}, '.1.1 Deep Rules', {NL}, {DUTY})"
GENERAL = f"concat('10.1 General Terms', {NL}, {DUTY})"
#: 1 to 45 items after the title, which counts as one.
ITEM = "(a) to own the loan"
WARRANTIES = f"concat('10.2 Lender Warranties', repeat(concat({NL}, '{ITEM}'), 1 + cast(doc_id % 45 AS int)))"
COSTS = f"concat('10.3 Fees and Costs', {NL}, {TEXT})"
WHOLE_1 = f"concat('Section ', {NUMBER}, '. Scope of Work', {NL}, 'The ', {PARTY}, ' shall pay.', {NL}, {NL}, {TEXT})"
BOND, BORROWER = f"""concat('"Bond": a debt', {NL}, 'of two lines.')""", """'"Eligible Borrower (FHA)": a person.'"""
DEFINITIONS = f"concat('Section 1. Definitions', {NL}, {BOND}, {NL}, {BORROWER})"
DUE = f"concat('2.1 Fees and Costs', {NL}, 'The Bond is due. ', {TEXT})"

PLANNED_PAGES = f"""
SELECT doc_id, 1 AS page_number, CASE {PLAN} WHEN 1 THEN concat('Chapter ', {NUMBER}, ': Loan Terms', {NL}, {DEEP})
  WHEN 2 THEN concat('Section 10. Warranties and Covenants', {NL}, {GENERAL}, {NL}, {WARRANTIES})
  WHEN 3 THEN {WHOLE_1} WHEN 4 THEN {DEFINITIONS} WHEN 6 THEN {TEXT} ELSE {PAGE_1} END AS text FROM documents
UNION ALL SELECT doc_id, 2 AS page_number, CASE {PLAN} WHEN 2 THEN {COSTS} WHEN 3 THEN concat({NL}, {TEXT})
  WHEN 4 THEN concat('Section 2. Terms', {NL}, {DUE}) WHEN 6 THEN 'The second page.' ELSE {FEES} END AS text FROM documents
UNION ALL SELECT doc_id, 3 AS page_number, CASE {PLAN} WHEN 6 THEN {TEXT} ELSE {CLOSING} END AS text FROM documents
"""


def planned_pages(t: Tables) -> DataFrame:
    """pages(doc_id, page_number, text, tables): on the second page of plan 5 a table twice, scores, and percentages by year."""
    grids = """array(array(array('Risk', 'Mitigation'), array('Late', 'Plan')), array(array('Risk', 'Mitigation'), array('Late', 'Plan')),
      array(array('Item', 'Score'), array('Plan', cast(doc_id % 10 AS string))), array(array('Year', 'Percentage'), array('first', '50%')))"""
    has = F.expr(f"{PLAN} = 5 AND page_number = 2")
    return t.sql(PLANNED_PAGES).withColumn("tables", F.when(has, F.expr(grids)))


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _crumb(number: str, title: str, party: str) -> str:
    return f"concat('[Document | ', {number}, ' — {title} | Obligations of: ', {party}, ']', {NL}, {NL})"


def _section(where: str, seq: str, slug: str, number: str, title: str, parent: str, party: str, strategy: str, content: str, pages: str = "1, 2", terms: str = "") -> str:
    first, last = pages.split(",")
    return f"""SELECT doc_id, {seq} AS seq, concat('sec_', {slug}) AS chunk_id, {number} AS section_number, '{title}' AS section_title, {parent} AS parent_section,
      {party} AS obligations_of, {strategy} AS header_strategy, {first} AS first_page, {last} AS last_page, '{terms}' AS terms,
      NULL AS warranty_range, NULL AS warranty_total, {content} AS page_content FROM documents WHERE {where}"""


def _sub(plan: str, seq: str, slug: str, number: str, title: str, parent: str, party: str, raw: str, tail: str | None = None, strategy: str = "S4_subsec", **more: str) -> str:
    overlap = f"concat('[...continued from previous]', {NL}, {tail}, {NL}, {NL})" if tail else "''"
    return _section(f"{PLAN} {plan}", seq, slug, number, title, parent, party, f"'{strategy}'", f"concat({_crumb(number, title, party)}, {overlap}, {raw})", **more)


_GROUPS = "CAST(greatest(0, ceil((2 + doc_id % 45 - 13) / 9.0)) AS INTEGER)"
_WARRANTY_ROWS = f"""
SELECT doc_id, 2 + g AS seq, concat('sec_10_2_warranties_', f, '_', l) AS chunk_id, '10.2' AS section_number, 'Lender Warranties' AS section_title, '10' AS parent_section,
  'Lender' AS obligations_of, NULL AS header_strategy, 1 AS first_page, 2 AS last_page, '' AS terms, concat(f, '-', l) AS warranty_range, total AS warranty_total,
  concat('[IHDA Agreement | Section 10.2 — Lender Warranties | warranties #', f, '–', l, ' of ', total, ']', {NL}, {NL},
    CASE WHEN g = 0 THEN '10.2 Lender Warranties' ELSE '{ITEM}' END, repeat(concat({NL}, {NL}, '{ITEM}'), l - f)) AS page_content
FROM (SELECT doc_id, g, total, CAST(9 * g + 1 AS INTEGER) AS f, CAST(CASE WHEN g < groups THEN 9 * g + 9 ELSE total END AS INTEGER) AS l
  FROM (SELECT doc_id, CAST(2 + doc_id % 45 AS INTEGER) AS total, {_GROUPS} AS groups, unnest(range(0, {_GROUPS} + 1)) AS g FROM documents WHERE {PLAN} = 2))
"""

_BODY = _strip(f"concat({WHOLE_1}, {NL}, {NL}, {TEXT}, {NL})")
#: The parts of the section of plan 3: all of it where that is short enough, else paragraphs packed in order.
_WHOLE_ROWS = rf"""
SELECT doc_id, part AS seq, concat('sec_', {NUMBER}, '_main', CASE WHEN n = 1 AND short THEN '' ELSE concat('_part', part) END) AS chunk_id, {NUMBER} AS section_number,
  'Scope of Work' AS section_title, {NUMBER} AS parent_section, CASE WHEN part = 1 THEN {PARTY} ELSE 'General' END AS obligations_of, NULL AS header_strategy,
  1 AS first_page, 2 AS last_page, '' AS terms, NULL AS warranty_range, NULL AS warranty_total, content AS page_content
FROM (SELECT doc_id, short, len(parts) AS n, unnest(parts) AS content, unnest(range(1, len(parts) + 1)) AS part FROM (
  SELECT doc_id, short, CASE WHEN short THEN [x] ELSE string_split(list_reduce(regexp_split_to_array(x, '\n\s*\n'),
      lambda a, y: CASE WHEN (len(string_split(a, chr(1))[-1]) + 2 + len(y)) // 4 <= 800 THEN a || {NL} || {NL} || y ELSE a || chr(1) || y END), chr(1)) END AS parts
  FROM (SELECT doc_id, x, len(x) // 4 <= 800 AS short FROM (SELECT doc_id, concat({_crumb(NUMBER, "Scope of Work", PARTY)}, {_BODY}) AS x FROM documents WHERE {PLAN} = 3))))
"""

_DOTTED = lambda n: f"concat({NUMBER}, '{n}')"
_SECTIONS = " UNION ALL BY NAME ".join([
    _sub("IN (0, 5)", "1", f"concat({NUMBER}, '_1')", _DOTTED(".1"), "General Terms", NUMBER, PARTY, TERMS),
    _sub("IN (0, 5)", "2", f"concat({NUMBER}, '_2')", _DOTTED(".2"), "Fees and Costs", NUMBER, "'General'", _strip(f"concat({FEES}, {NL})"), TERMS),
    _sub("= 1", "1", f"concat({NUMBER}, '_1_1')", _DOTTED(".1.1"), "Deep Rules", f"concat('Ch', {NUMBER})", PARTY, DEEP, strategy="S3_deep"),
    _sub("= 1", "2", f"concat({NUMBER}, '_2')", _DOTTED(".2"), "Fees and Costs", f"concat('Ch', {NUMBER})", "'General'", _strip(f"concat({FEES}, {NL})"), DEEP),
    _sub("= 2", "1", "'10_1'", "'10.1'", "General Terms", "'10'", PARTY, GENERAL),
    _WARRANTY_ROWS,
    _sub("= 2", "1000", "'10_3'", "'10.3'", "Fees and Costs", "'10'", "'General'", _strip(f"concat({COSTS}, {NL})"), GENERAL),
    _WHOLE_ROWS,
    _section(f"{PLAN} = 4", "1", "'1_main'", "'1'", "Definitions", "'1'", "'General'", "NULL", f"concat({_crumb(chr(39) + '1' + chr(39), 'Definitions', chr(39) + 'General' + chr(39))}, {DEFINITIONS})", pages="1, 1", terms="Bond|Eligible Borrower (FHA)"),
    _sub("= 4", "2", "'2_1'", "'2.1'", "Fees and Costs", "'2'", "'General'", _strip(f"concat({DUE}, {NL})"), pages="2, 2", terms="Bond"),
    _section(f"{PLAN} < 6", "2000", "'general_conditions_main'", "''", "GENERAL CONDITIONS", "''", "'General'", "NULL", f"concat('[Document | GENERAL CONDITIONS | Obligations of: General]', {NL}, {NL}, {CLOSING})", pages="3, 3"),
])

_NEAR = f"concat({NUMBER}, '.2 Fees and Costs')"
_RISKS = f"""concat('[Document | Table (key_value) | Page 2 | Near: ', {_NEAR}, ']', {NL}, {NL}, 'MARKDOWN:', {NL}, '| Risk | Mitigation |', {NL}, '|------|------------|', {NL},
  '| Late | Plan       |', {NL}, {NL}, 'PROSE: Late: Plan')"""
_SCORES = f"""concat('[Document | Table (scoring) | Page 2 | Near: ', {_NEAR}, ']', {NL}, {NL}, 'MARKDOWN:', {NL}, '| Item | Score |', {NL}, '|------|-------|', {NL},
  '| Plan | ', doc_id % 10, '     |', {NL}, {NL}, 'PIPE: Item=Plan | Score=', doc_id % 10)"""
_YEARS = f"""concat('[IHDA Agreement | Recapture Percentage Table | Section 4 / Exhibit A]', {NL}, {NL}, 'MARKDOWN:', {NL}, '| Year  | Percentage |', {NL}, '|-------|------------|', {NL},
  '| first | 50%        |', {NL}, {NL}, 'PIPE: Year 1=50% | After 9yr=0%', {NL}, {NL},
  'PROSE: Recapture percentages by year of sale after purchase: Year 1 is 50%. Maximum recapture is always capped at 50% of gain on sale.')"""


def _table(seq: int, chunk_id: str, kind: str, content: str, formats: str, duplicate: str = "false", first: str = "NULL", context: str = _NEAR) -> str:
    return f"""SELECT doc_id, {seq} AS seq, '{chunk_id}' AS chunk_id, {kind} AS table_kind, {content} AS page_content, '{formats}' AS formats, {duplicate} AS is_duplicate,
      {first} AS canonical_chunk_id, {context} AS context_heading, 2 AS first_page, 2 AS last_page, 'table' AS chunk_type, true AS contains_table FROM documents WHERE {PLAN} = 5"""


#: Every chunk of the planned contracts. A null in terms, pages and the like means that the layer has no such field.
PLANNED_CHUNKS = f"""
SELECT *, CAST(greatest(1, len(page_content) // 4) AS INTEGER) AS token_count FROM (
  SELECT doc_id, CAST(row_number() OVER d AS INTEGER) AS seq, chunk_id, 'section' AS chunk_type, section_number, section_title, parent_section, obligations_of, header_strategy,
    CAST(first_page AS INTEGER) AS first_page, CAST(last_page AS INTEGER) AS last_page, terms, warranty_range, CAST(warranty_total AS INTEGER) AS warranty_total, page_content,
    coalesce(lag(chunk_id) OVER d, '') AS prev_chunk_id, coalesce(lead(chunk_id) OVER d, '') AS next_chunk_id, false AS contains_table
  FROM ({_SECTIONS}) WINDOW d AS (PARTITION BY doc_id ORDER BY seq)
  UNION ALL BY NAME SELECT doc_id, 1 AS seq, 'def_bond' AS chunk_id, 'definition' AS chunk_type, 'Bond' AS term, false AS contains_table,
    concat('[IHDA Agreement | Section 1 — Definitions | Term: Bond]', {NL}, {NL}, {BOND}) AS page_content FROM documents WHERE {PLAN} = 4
  UNION ALL BY NAME SELECT doc_id, 2 AS seq, 'def_eligible_borrower_fha' AS chunk_id, 'definition' AS chunk_type, 'Eligible Borrower (FHA)' AS term, false AS contains_table,
    concat('[IHDA Agreement | Section 1 — Definitions | Term: Eligible Borrower (FHA)]', {NL}, {NL}, {BORROWER}) AS page_content FROM documents WHERE {PLAN} = 4
  UNION ALL BY NAME {_table(1, "table_p2_t0_key_value", "'key_value'", _RISKS, "markdown,prose")}
  UNION ALL BY NAME {_table(2, "table_p2_t1_key_value_dup", "'key_value'", _RISKS, "markdown,prose", "true", "'table_p2_t0_key_value'")}
  UNION ALL BY NAME {_table(3, "table_p2_t2_scoring", "'scoring'", _SCORES, "markdown,pipe")}
  UNION ALL BY NAME {_table(4, "table_recapture_main", "NULL", _YEARS, "markdown,pipe,prose", context="NULL")})
"""

_FIELDS = [
    "doc_id", "chunk_id", "chunk_type", "seq", "page_content", "token_count", "contains_table", "term", "section_number", "section_title", "parent_section", "obligations_of",
    "header_strategy", "prev_chunk_id", "next_chunk_id", "warranty_range", "warranty_total", "table_kind", "context_heading", "is_duplicate", "canonical_chunk_id",
]


@query(f"SELECT {', '.join(_FIELDS)}, first_page, last_page, terms, formats FROM ({PLANNED_CHUNKS})")
def s_contract_layers(t: Tables) -> DataFrame:
    """Every field of every chunk of the three layers, over contracts of all plans."""
    chunks = structure.contract_chunks(planned_pages(t))
    return chunks.select(
        *_FIELDS, F.get("page_range", 0).alias("first_page"), F.get("page_range", 1).alias("last_page"),
        F.array_join("def_terms_present", "|").alias("terms"), F.array_join("serialization_formats", ",").alias("formats"),
    )


@query(f"""SELECT d.doc_id, count(*) FILTER (chunk_type = 'definition') AS definition, count(*) FILTER (chunk_type = 'section') AS section, count(*) FILTER (chunk_type = 'table') AS "table",
  count(*) FILTER (warranty_range IS NOT NULL) AS warranty, count(*) FILTER (header_strategy = 'S3_deep') AS deep, count(*) FILTER (chunk_id LIKE '%\\_part%' ESCAPE '\\') AS packed
FROM documents d JOIN ({PLANNED_CHUNKS}) c USING (doc_id) GROUP BY 1""")
def s_all_layers_counts(t: Tables) -> DataFrame:
    """Chunks of each kind in each contract that has any."""
    chunks = structure.contract_chunks(planned_pages(t))
    # one aggregation, so that the chunks are made once
    return structure.chunk_type_counts(chunks, warranty="warranty_range IS NOT NULL", deep="header_strategy = 'S3_deep'", packed="contains(chunk_id, '_part')")
