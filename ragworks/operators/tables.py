"""Tables inside documents: grids of cells, their kinds and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragworks.functions.text import let, strip, token_count
from ragworks.operators.structure import dedupe_chunk_ids, heading_context
from ragworks.schemas import GRID

#: Ordinals and the years they stand for (fixed values).
ORDINALS = {
    "first": "Year 1", "second": "Year 2", "third": "Year 3", "fourth": "Year 4", "fifth": "Year 5",
    "sixth": "Year 6", "seventh": "Year 7", "eighth": "Year 8", "ninth": "Year 9",
}
SCORING_WORDS = r"\b(?:score|weighting|weight|marks|percentage|%|rating)\b"
CRITERIA_WORDS = r"\b(?:criteria|sub[- ]criteria|evaluation|parameter|indicator)\b"
REFERENCE_WORDS = r"\b(?:rule\s*\d|gfr|clause|schedule|appendix|annexure|article)\b"

_EMPTY_GRID = f"CAST(array() AS {GRID})"


def md_table_to_grid(md: Column) -> Column:
    """Rows of a Markdown table: lines with a leading bar but separators; outer bars go, cells are trimmed."""
    lines = F.filter(F.transform(F.split(md, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x.startswith("|"))
    inner = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\|+|\|+$", "")), lambda x: ~x.rlike(r"\A[\s\-:|]+\z"))
    return F.transform(inner, lambda x: F.transform(F.split(x, r"\|"), strip))


def filled_rows(grid: Column) -> Column:
    """Rows with anything in them, cells trimmed; null cells count as empty."""
    trimmed = F.transform(F.coalesce(grid, F.expr(_EMPTY_GRID)), lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    return F.filter(trimmed, lambda r: F.exists(r, lambda c: c != ""))


def _flat(cells: Column) -> Column:
    return F.array_join(F.filter(F.transform(cells, F.lower), lambda c: c != ""), " ")


def _has_ordinal(text: Column) -> Column:
    return text.rlike("|".join(ORDINALS))


def _words(cell: Column) -> Column:
    return F.size(F.filter(F.split(cell, r"(?U)\s+"), lambda w: w != ""))


def classify_table(grid: Column) -> Column:
    """skip, scoring, criteria, reference, key_value or generic."""
    return let(filled_rows(grid), _classify_rows)


def _classify_rows(rows: Column) -> Column:
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    cells = F.flatten(rows)
    filled = F.size(F.filter(cells, lambda c: c != ""))
    header, everything = _flat(F.get(rows, 0)), _flat(cells)
    first_words = F.aggregate(rows, F.lit(0), lambda n, r: n + F.coalesce(_words(F.get(r, 0)), F.lit(0)))
    return (
        F.when((F.size(rows) < 2) | (width < 2) | (filled / F.size(cells) < 0.15), "skip")
        .when(header.rlike(SCORING_WORDS), "scoring")
        .when(F.contains(everything, F.lit("percentage")) & _has_ordinal(everything), "scoring")
        .when(header.rlike(CRITERIA_WORDS), "criteria")
        .when(header.rlike(REFERENCE_WORDS), "reference")
        .when((width == 2) & (first_words / F.size(rows) <= 10), "key_value")
        .otherwise(F.lit("generic"))
    )


def looks_like_header(row: Column) -> Column:
    """Short cells, or half of them in capitals or in title case."""
    return let(F.filter(row, lambda c: c != ""), _header_cells)


def _header_cells(cells: Column) -> Column:
    words = F.aggregate(F.transform(cells, _words), F.lit(0), lambda n, w: n + w)
    title = lambda c: c.rlike(r"\p{Lu}") & ~c.rlike(r"(?<!\p{L})\p{Ll}|(?<=\p{L})\p{Lu}")
    capital = F.size(F.filter(cells, lambda c: (c == F.upper(c)) | title(c)))
    return F.coalesce((F.size(cells) > 0) & ((words / F.nullif(F.size(cells), F.lit(0)) <= 5) | (capital / F.nullif(F.size(cells), F.lit(0)) >= 0.5)), F.lit(False))


def table_signature(grid: Column) -> Column:
    cells = F.filter(F.transform(F.flatten(F.coalesce(grid, F.expr(_EMPTY_GRID))), lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    return F.left(F.array_join(cells, "|"), F.lit(300))


def _fit(rows: Column, width: Column) -> Column:
    return F.transform(rows, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), 1, width))


def markdown(headers: Column, rows: Column) -> Column:
    """A Markdown table with cells padded to the widest of their column; rows must be as wide as headers."""
    return let(_widths(headers, rows), lambda widths: _markdown(headers, rows, widths))


def _widths(headers: Column, rows: Column) -> Column:
    return F.transform(headers, lambda h, i: F.greatest(F.length(h), F.coalesce(F.array_max(F.transform(rows, lambda r: F.length(F.get(r, i)))), F.lit(0))))


def _markdown(headers: Column, rows: Column, widths: Column) -> Column:
    padded = lambda r: F.array_join(F.transform(r, lambda c, i: F.rpad(c, F.get(widths, i), " ")), " | ")
    line = lambda r: F.concat(F.lit("| "), padded(r), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w + 2)), "|"), F.lit("|"))
    return F.concat(line(headers), F.lit("\n"), rule, F.lit("\n"), F.array_join(F.transform(rows, line), "\n"))


def serialize_table(grid: Column, kind: Column, context: Column, page: Column, index: Column, duplicate: Column) -> Column:
    """struct(base_id, content, formats) of a table: Markdown, and pipe or prose forms where the kind has them."""

    def of_rows(rows: Column) -> Column:
        headed = (F.size(rows) > 1) & looks_like_header(F.get(rows, 0))
        width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(2))
        numbered = F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("Col "), i.cast("string")))
        headers = F.when(headed, F.get(rows, 0)).otherwise(numbered)
        body = F.when(headed, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1)))).otherwise(rows)
        return let(headers, lambda h: let(_fit(body, F.size(h)), lambda b: _table_text(h, b, kind, context, page, index, duplicate)))

    return let(filled_rows(grid), of_rows)


def _table_text(headers: Column, body: Column, kind: Column, context: Column, page: Column, index: Column, duplicate: Column) -> Column:
    pair = lambda h, c: F.when(c != "", F.concat(h, F.lit("="), c))
    piped = F.filter(F.transform(body, lambda r: F.array_join(F.array_compact(F.zip_with(headers, r, pair)), " | ")), lambda x: x != "")
    has_pipe = kind.isin("scoring", "criteria")
    pipe = F.concat(F.lit("PIPE: "), F.array_join(piped, " || "))
    told = F.filter(body, lambda r: (F.get(r, 0) != "") & (F.get(r, 1) != ""))
    has_prose = (kind == "key_value") & (F.size(headers) == 2)
    prose = F.concat(F.lit("PROSE: "), F.array_join(F.transform(told, lambda r: F.concat(F.get(r, 0), F.lit(": "), F.get(r, 1))), " | "))
    near = F.when(context != "", F.concat(F.lit(" | Near: "), context)).otherwise(F.lit(""))
    crumb = F.concat(F.lit("[Document | Table ("), kind, F.lit(") | Page "), page.cast("string"), near, F.lit("]"))
    content = F.concat_ws("\n\n", crumb, F.concat(F.lit("MARKDOWN:\n"), markdown(headers, body)), F.when(has_pipe, pipe), F.when(has_prose, prose))
    suffix = F.when(duplicate, F.lit("_dup")).otherwise(F.lit(""))
    base_id = F.concat(F.lit("table_p"), page.cast("string"), F.lit("_t"), index.cast("string"), F.lit("_"), kind, suffix)
    formats = F.array_compact(F.array(F.lit("markdown"), F.when(has_pipe, F.lit("pipe")), F.when(has_prose, F.lit("prose"))))
    return F.struct(base_id.alias("base_id"), content.alias("content"), formats.alias("formats"))


def is_recapture(grid: Column, kind: Column) -> Column:
    """Scoring tables that name an ordinal have a form of their own."""
    return (kind == "scoring") & _has_ordinal(_flat(F.flatten(filled_rows(grid))))


def serialize_recapture(grid: Column, duplicate: Column) -> Column:
    """struct(base_id, content, formats) of a table of percentages by year."""

    def of_rows(rows: Column) -> Column:
        headed = (F.size(rows) > 1) & F.exists(F.get(rows, 0), lambda c: F.lower(c).rlike("year|percent"))
        headers = F.when(headed, F.get(rows, 0)).otherwise(F.array(F.lit("Year After Purchase"), F.lit("Percentage")))
        body = F.when(headed, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1)))).otherwise(rows)
        return let(headers, lambda h: let(_fit(body, F.lit(2)), lambda b: _recapture_text(h, b, duplicate)))

    return let(filled_rows(grid), of_rows)


def _recapture_text(headers: Column, body: Column, duplicate: Column) -> Column:
    years = F.create_map(*[F.lit(x) for k, v in ORDINALS.items() for x in (k, v)])
    year = lambda r: F.coalesce(years[F.lower(F.get(r, 0))], F.get(r, 0))
    piped = F.concat(F.transform(body, lambda r: F.concat(year(r), F.lit("="), F.get(r, 1))), F.array(F.lit("After 9yr=0%")))
    told = F.transform(body, lambda r: F.concat(year(r), F.lit(" is "), F.get(r, 1)))
    content = F.concat_ws(
        "\n\n",
        F.lit("[IHDA Agreement | Recapture Percentage Table | Section 4 / Exhibit A]"),
        F.concat(F.lit("MARKDOWN:\n"), markdown(headers, _fit(body, F.size(headers)))),
        F.concat(F.lit("PIPE: "), F.array_join(piped, " | ")),
        F.concat(F.lit("PROSE: Recapture percentages by year of sale after purchase: "), F.array_join(told, ", "), F.lit(". Maximum recapture is always capped at 50% of gain on sale.")),
    )
    base_id = F.when(duplicate, "table_recapture_duplicate").otherwise(F.lit("table_recapture_main"))
    return F.struct(base_id.alias("base_id"), content.alias("content"), F.array(*map(F.lit, ("markdown", "pipe", "prose"))).alias("formats"))


def page_tables(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_number, text, tables) -> a row a table that is worth keeping: kind, signature, duplicate flag."""
    rows = pages.select("doc_id", "page_number", "text", F.posexplode("tables").alias("table_index", "grid"))
    rows = rows.withColumn("table_kind", classify_table(F.col("grid"))).where("table_kind <> 'skip'").withColumn("signature", table_signature(F.col("grid")))
    return flag_duplicate_tables(rows)


def flag_duplicate_tables(tables: DataFrame) -> DataFrame:
    """is_duplicate: a table with the same signature stands before this one in the document."""
    order = Window.partitionBy("doc_id", "signature").orderBy("page_number", "table_index")
    return tables.withColumn("is_duplicate", F.row_number().over(order) > 1)


def table_chunks(pages: DataFrame) -> DataFrame:
    """Layer 3: a chunk for each table; a duplicate names the chunk of its first occurrence."""
    rows = page_tables(pages.withColumn("text", heading_context(F.col("text")))).withColumnRenamed("text", "context_heading")
    special = is_recapture(F.col("grid"), F.col("table_kind"))
    rows = rows.withColumn("__special", special).withColumn(
        "c",
        F.when(F.col("__special"), serialize_recapture(F.col("grid"), F.col("is_duplicate"))).otherwise(
            serialize_table(*map(F.col, ("grid", "table_kind", "context_heading", "page_number", "table_index", "is_duplicate")))
        ),
    )
    rows = rows.select(
        "doc_id", "signature", "is_duplicate",
        F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "table_index")).alias("seq"),
        F.col("c.base_id").alias("base_id"), F.lit("table").alias("chunk_type"), F.col("c.content").alias("page_content"),
        token_count(F.col("c.content")).alias("token_count"), F.lit(True).alias("contains_table"),
        F.when(~F.col("__special"), F.col("table_kind")).alias("table_kind"),
        F.when(~F.col("__special"), F.col("context_heading")).alias("context_heading"),
        F.array("page_number", "page_number").alias("page_range"), F.col("c.formats").alias("serialization_formats"),
        F.when(F.col("__special"), "4").alias("section"), F.when(F.col("__special"), "recapture_percentages").alias("table_name"),
        F.when(F.col("__special"), F.lit(False)).alias("has_examples"),
        F.lit("main").alias("doc_source"), F.lit("high").alias("retrieval_priority"),
    )
    rows = dedupe_chunk_ids(rows)
    first = F.first("chunk_id").over(Window.partitionBy("doc_id", "signature").orderBy("seq"))
    return rows.withColumn("canonical_chunk_id", F.when(F.col("is_duplicate"), first)).drop("signature")


def example_text(text: Column) -> Column:
    """From the first "Example X:" to the end, trimmed; nothing without one."""
    at = F.regexp_instr(text, F.lit(r"(?i)Example\s+[A-Z]\s*:"))
    return F.when(at > 0, strip(F.substring(text, at, F.length(text)))).otherwise(F.lit(""))
