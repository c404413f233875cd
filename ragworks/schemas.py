"""Schemas of the tables that the jobs read and write."""

from __future__ import annotations

GRID = "array<array<string>>"

PAGES = f"doc_id BIGINT, page_number INT, text STRING, tables ARRAY<{GRID}>"

HEADER = "struct<level:int,number:string,title:string,start:int,strategy:string>"

#: One fixed schema for the chunks of all three layers; what a layer has not is null.
CHUNKS = (
    "doc_id BIGINT, chunk_id STRING, chunk_type STRING, seq INT, page_content STRING, token_count INT, contains_table BOOLEAN, "
    "term STRING, section STRING, section_number STRING, section_title STRING, parent_section STRING, page_range ARRAY<INT>, "
    "obligations_of STRING, def_terms_present ARRAY<STRING>, header_strategy STRING, prev_chunk_id STRING, next_chunk_id STRING, "
    "warranty_range STRING, warranty_total INT, table_kind STRING, context_heading STRING, serialization_formats ARRAY<STRING>, "
    "is_duplicate BOOLEAN, canonical_chunk_id STRING, table_name STRING, has_examples BOOLEAN, doc_source STRING, retrieval_priority STRING"
)

PARSER_RESULT = "struct<pages:array<struct<page:int,text:string,md:string,items:array<struct<type:string,value:string,md:string>>>>>"

QUERY_LOGS = "id BIGINT, query_text STRING, response_text STRING, sources_used STRING, feedback INT, created_at TIMESTAMP"

EVAL_ANSWERS = "input STRING, expected STRING"
EVAL_PAGES = "input STRING, sources ARRAY<STRING>"
EVAL_CHUNKS = "input STRING, expected STRING, expected_chunk_id STRING, manual_id BIGINT, filename STRING"
