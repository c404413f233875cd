"""Contracts, tables and registry rows built from the given tables by rule, in SQL that Spark and DuckDB both run.

The expected structure of what is built follows from arithmetic on the keys,
so the oracle SQL needs no parser.
"""

from __future__ import annotations

NL = "chr(10)"

#: Who is obliged, and how many days they have, in document doc_id.
PARTY = "(CASE doc_id % 3 WHEN 0 THEN 'Lender' WHEN 1 THEN 'Authority' ELSE 'Borrower' END)"
DAYS = "cast(1 + doc_id % 40 AS string)"
NUMBER = "cast(1 + doc_id % 9 AS string)"

TERMS = f"concat({NUMBER}, '.1 General Terms', {NL}, 'The ', {PARTY}, ' shall submit Form A within ', {DAYS}, ' days.')"
FEES = f"concat({NUMBER}, '.2 Fees and Costs', {NL}, coalesce(text, ''))"
CLOSING = f"concat('GENERAL CONDITIONS', {NL}, 'The agency must report any breach.')"
PAGE_1 = f"concat('Section ', {NUMBER}, '. Scope of Work', {NL}, {TERMS})"

#: A contract of three pages for each document: sections, the text itself, closing words.
CONTRACT_PAGES = f"""
SELECT doc_id, 1 AS page_number, {PAGE_1} AS text FROM documents
UNION ALL SELECT doc_id, 2 AS page_number, {FEES} AS text FROM documents
UNION ALL SELECT doc_id, 3 AS page_number, {CLOSING} AS text FROM documents
"""

#: One text a document with what the feature rules look for ahead of the document's own text.
FEATURE_CHUNKS = f"""
SELECT doc_id, concat('sec_', cast(doc_id AS string)) AS chunk_id,
       CASE doc_id % 7 WHEN 0 THEN 'definition' WHEN 1 THEN 'table' ELSE 'section' END AS chunk_type,
       CASE WHEN doc_id % 4 = 0 THEN concat({NUMBER}, '.2') ELSE '' END AS section_number,
       concat(CASE doc_id % 6
         WHEN 0 THEN 'The consultant must submit Annex B within 30 Business Days. '
         WHEN 1 THEN 'The employer may accept the draft; the penalty is void on breach. '
         WHEN 2 THEN 'The Evaluation Committee should review the audit report in 2 weeks. '
         WHEN 3 THEN 'Step 3 of the procedure: notify the ministry. '
         WHEN 4 THEN 'Fee means the payment: see Section Table 3, section 5 and Appendix C. '
         ELSE '' END, coalesce(text, '')) AS page_content
FROM documents
"""

#: Definitions ahead of a second section, as many as doc_id modulo 4.
DEFINITION_DOCS = f"""
SELECT doc_id, concat('Preface', {NL}, 'Section 1. Definitions', {NL},
  CASE WHEN doc_id % 4 > 0 THEN concat('"Eligible Borrower (FHA)": a person.', {NL}) ELSE '' END,
  CASE WHEN doc_id % 4 > 1 THEN concat('"Bond": a debt', {NL}, 'of two lines.', {NL}) ELSE '' END,
  CASE WHEN doc_id % 4 > 2 THEN concat('"Bond": again.', {NL}) ELSE '' END,
  'Section 2. Terms', {NL}, '"Late": no.', {NL}, coalesce(text, '')) AS text
FROM documents
"""
