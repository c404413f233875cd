"""Documents into chunks: definitions, sections and fixed-size pieces.

The document is the natural unit: pages are joined once by doc_id, and every
window below is partitioned by doc_id, so the one shuffle serves all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragworks.functions.helpers import detect_headers, pack_paragraphs, recursive_split
from ragworks.functions.text import OVERLAP_TOKENS, first_filled, let, obligation_party, running_sums, slugify, strip, tail_tokens, token_count
from ragworks.schemas import CHUNKS

MAX_TOKENS = 800
WARRANTY_GROUP = 9
#: Title that breadcrumbs of agreements carry (fixed value).
AGREEMENT = "IHDA Agreement"

#: A term in quotes at the start of a line (fixed value).
TERM = r'"[A-Z][^"]+":'
#: Start of a list item in a warranty section (fixed value).
ITEM = r"\n(?=\s*(?:[A-Z]\.|\([a-z]\)|\d+\.))"


def join_pages(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_number, text) -> (doc_id, text, page_offsets): pages in order, joined by line ends."""
    row = F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("__pages"))
    size = lambda p: F.length(p["text"]) + 1
    ends = running_sums(F.transform("__pages", size))

    def offsets(ends: Column) -> Column:
        return F.transform("__pages", lambda p, i: F.struct(p["page_number"].alias("page_number"), (F.get(ends, i) - size(p)).alias("start"), size(p).alias("size")))

    return docs.select("doc_id", F.array_join(F.transform("__pages", lambda p: p["text"]), "\n").alias("text"), let(ends, offsets).alias("page_offsets"))


def page_offsets(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, start): where each page begins in the joined text."""
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.length("text"), F.lit(0)) + 1
    return pages.select("doc_id", "page_number", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int").alias("start"))


def _document_headers(docs: DataFrame, text: str = "text") -> Column:
    """The headers of each text; where docs has page_offsets, none in capitals runs on from one page to the next."""
    starts = F.transform("page_offsets", lambda p: p["start"]) if "page_offsets" in docs.columns else None
    return detect_headers(F.col(text), starts)


def headers(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per header: doc_id, level, number, title, start, strategy."""
    return docs.select("doc_id", F.explode(_document_headers(docs, text)).alias("h")).select("doc_id", "h.*")


def section_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text[, page_offsets]) -> a row for each level-1 header to the next one or the end of the document, with its page_range.

    Documents without such a header give no rows; what stands before the first is dropped.
    """
    tops = F.filter(_document_headers(docs), lambda h: h["level"] == 1)
    found = docs.withColumn("__tops", tops)
    keep = [c for c in docs.columns if c not in ("text", "page_offsets")]

    def cut(h: Column, i: Column) -> Column:
        start, end = h["start"], F.coalesce(F.get("__tops", i + 1)["start"], F.length("text"))
        parts = {"number": h["number"], "title": h["title"], "strategy": h["strategy"], "start": start, "end": end, "body": F.substring("text", start + 1, end - start)}
        return F.struct(*[value.alias(name) for name, value in parts.items()])

    # cut before the rows are laid out, so that the text goes with none of them
    found = found.withColumn("__cut", F.transform("__tops", cut))
    if "page_offsets" not in docs.columns:
        return found.select(*keep, F.posexplode("__cut").alias("span", "__s")).select(*keep, "span", "__s.*")
    # all spans of a document at once, so that no span carries the pages
    part = lambda name: F.transform("__cut", lambda c: c[name])
    found = found.withColumn("__pages", page_ranges(part("start"), part("end"), F.col("page_offsets")))
    rows = found.select(*keep, F.posexplode(F.arrays_zip("__cut", "__pages")).alias("span", "__z"))
    return rows.select(*keep, "span", "__z.__cut.*", F.col("__z.__pages").alias("page_range"))


def span_pages(starts: np.ndarray, ends: np.ndarray, page_numbers: np.ndarray, page_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row (first page, last page) a span, found by bisection among pages in order; 1 where none fits."""
    if not len(page_numbers):
        return np.ones((len(starts), 2), np.int32)
    low = np.searchsorted(page_starts + sizes, starts, side="right")
    high = np.maximum(np.searchsorted(page_starts, ends, side="left") - 1, low)
    last = len(page_numbers) - 1
    return np.where((low > last)[:, None], 1, np.stack([page_numbers[np.minimum(low, last)], page_numbers[np.minimum(high, last)]], axis=1)).astype(np.int32)


def page_ranges(starts: Column, ends: Column, page_offsets: Column) -> Column:
    """array<array<int>>: the page range of each span of a document, from arrays of spans and the array of its pages."""

    @F.pandas_udf("array<array<int>>")
    def ranges(starts: pd.Series, ends: pd.Series, numbers: pd.Series, page_starts: pd.Series, sizes: pd.Series) -> pd.Series:
        rows = zip(starts, ends, numbers, page_starts, sizes)
        return pd.Series([span_pages(*(np.asarray([] if x is None else x, np.int64) for x in row)).tolist() for row in rows], dtype=object)

    part = lambda name: F.transform(page_offsets, lambda p: p[name])
    return ranges(starts, ends, part("page_number"), part("start"), part("size"))


def _label(number: Column) -> Column:
    return F.when(number != "", F.concat(number, F.lit(" — "))).otherwise(F.lit(""))


def _breadcrumb(number: Column, title: Column, body: Column) -> Column:
    return F.concat(F.lit("[Document | "), _label(number), title, F.lit(" | Obligations of: "), obligation_party(body), F.lit("]"))


def warranty_items(body: Column) -> Column:
    """Items of a warranty section: cut before list markers at line starts; blank ones are dropped."""
    return F.filter(F.transform(F.split(body, ITEM), strip), lambda x: x != "")


def warranty_groups(items: Column) -> Column:
    """array<struct(first, last, total, text)>: groups of nine, the rest in the last one when fewer than 14 remain."""
    return let(items, _item_groups)


def _item_groups(items: Column) -> Column:
    total = F.size(items)
    full = F.greatest(F.lit(0), F.ceil((total - 13) / F.lit(WARRANTY_GROUP)).cast("int"))
    numbers = F.when(total > 0, F.sequence(F.lit(0), full)).otherwise(F.expr("CAST(array() AS array<int>)"))

    def group(g: Column) -> Column:
        first = g * WARRANTY_GROUP
        size = F.when(g < full, F.lit(WARRANTY_GROUP)).otherwise(total - first)
        return F.struct((first + 1).alias("first"), (first + size).alias("last"), total.alias("total"), F.array_join(F.slice(items, first + 1, size), "\n\n").alias("text"))

    return F.transform(numbers, group)


def sub_sections(spans: DataFrame) -> DataFrame:
    """A row for each header below level 1 of a span, found on the span's own text, to the next one; with `tail` before it.

    The tail is that of the last sub-section that is no warranty.
    """
    return _tails(_cut_sub_sections(spans))


def _cut_sub_sections(spans: DataFrame) -> DataFrame:
    subs = F.filter(detect_headers(F.col("body")), lambda h: h["level"] >= 2)
    found = spans.withColumn("__subs", subs).withColumn("has_subs", F.size("__subs") > 0)

    def cut(h: Column, i: Column) -> Column:
        end = F.coalesce(F.get("__subs", i + 1)["start"], F.length("body"))
        return F.struct(h.alias("h"), strip(F.substring("body", h["start"] + 1, end - h["start"])).alias("raw"))

    # each row gets its own piece; the body goes only with sections that have no sub-section
    found = found.withColumn("__cut", F.transform("__subs", cut)).withColumn("body", F.when(~F.col("has_subs"), F.col("body")))
    found = found.select(*[c for c in found.columns if c not in ("__subs", "__cut")], F.posexplode_outer("__cut").alias("sub", "__c"))
    found = found.select(*[c for c in found.columns if c != "__c"], F.col("__c.h").alias("__h"), F.col("__c.raw").alias("raw"))
    parent = F.substring_index("number", ".", 1)
    return found.withColumn("warranty", F.col("has_subs") & (parent == "10") & F.col("__h.number").endswith(".2"))


def _tails(found: DataFrame) -> DataFrame:
    # by document, as the windows that number and link its chunks are, so that one shuffle serves all
    before = Window.partitionBy("doc_id").orderBy("span", "sub").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(~F.col("warranty") & F.col("raw").isNotNull(), F.struct("span", tail_tokens(F.col("raw"), OVERLAP_TOKENS).alias("tail")))
    found = found.withColumn("__tail", F.last(own, ignorenulls=True).over(before))
    return found.withColumn("tail", F.coalesce(F.when(F.col("__tail.span") == F.col("span"), F.col("__tail.tail")), F.lit(""))).drop("__tail")


def section_chunks(docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Layer 2: chunks of sections and sub-sections of docs(doc_id, text, page_offsets), ids unique and linked in a document."""
    subs = _cut_sub_sections(section_spans(docs))
    number, title = F.coalesce("__h.number", F.lit("")), F.coalesce("__h.title", F.lit(""))
    overlap = F.when(F.col("tail") != "", F.concat(F.lit("[...continued from previous]\n"), F.col("tail"), F.lit("\n\n"))).otherwise(F.lit(""))
    plain = F.concat(_breadcrumb(number, title, F.col("raw")), F.lit("\n\n"), overlap, F.col("raw"))
    whole = F.concat(_breadcrumb(F.col("number"), F.col("title"), F.col("body")), F.lit("\n\n"), strip(F.col("body")))
    whole_id = F.concat(F.lit("sec_"), slugify(first_filled(F.col("number"), F.col("title"))), F.lit("_main"))
    parent = F.substring_index("number", ".", 1)

    def chunk(base_id: Column, content: Column, first: Column, last: Column, total: Column) -> Column:
        return F.struct(base_id.alias("base_id"), content.alias("content"), first.alias("first"), last.alias("last"), total.alias("total"))

    no = F.lit(None).cast("int")
    one = F.array(chunk(F.concat(F.lit("sec_"), slugify(first_filled(number, title))), plain, no, no, no))
    label = lambda g: F.concat(F.lit("warranties #"), g["first"].cast("string"), F.lit("–"), g["last"].cast("string"), F.lit(" of "), g["total"].cast("string"))
    groups = F.transform(
        warranty_groups(warranty_items(F.col("raw"))),
        lambda g: chunk(
            F.concat(F.lit("sec_"), parent, F.lit("_2_warranties_"), g["first"].cast("string"), F.lit("_"), g["last"].cast("string")),
            F.concat(F.lit(f"[{AGREEMENT} | Section "), number, F.lit(" — "), title, F.lit(" | "), label(g), F.lit("]\n\n"), g["text"]),
            g["first"], g["last"], g["total"],
        ),
    )
    subs = subs.withColumn("__whole", F.when(~F.col("has_subs"), whole))
    small = token_count(F.col("__whole")) <= max_tokens
    parts = pack_paragraphs(F.when(~F.col("has_subs") & ~small, F.col("__whole")), max_tokens)
    # Python comes before the windows, as it would part them by another shuffle; of a section without sub-sections only its parts go on
    subs = subs.withColumn("__small", small).withColumn("__parts", F.when(F.col("__small"), F.array("__whole")).otherwise(parts))
    subs = _tails(subs.drop("__whole", "body"))
    numbered = F.transform("__parts", lambda p, i: chunk(F.concat(whole_id, F.lit("_part"), (i + 1).cast("string")), p, no, no, no))
    made = (
        F.when(F.col("warranty"), groups)
        .when(F.col("has_subs"), one)
        .when(F.col("__small"), F.array(chunk(whole_id, F.get("__parts", 0), no, no, no)))
        .otherwise(numbered)
    )
    rows = subs.withColumn("__made", made).select("*", F.posexplode("__made").alias("piece", "c"))
    is_whole = ~F.col("has_subs")
    rows = rows.select(
        "doc_id", "page_range", *[c for c in rows.columns if c == "__terms"],
        F.row_number().over(Window.partitionBy("doc_id").orderBy("span", "sub", "piece")).alias("seq"),
        F.col("c.base_id").alias("base_id"),
        F.lit("section").alias("chunk_type"),
        F.col("c.content").alias("page_content"),
        F.when(is_whole, F.col("number")).otherwise(number).alias("section_number"),
        F.when(is_whole, F.col("title")).otherwise(title).alias("section_title"),
        F.when(is_whole | F.col("warranty"), parent).otherwise(F.col("number")).alias("parent_section"),
        F.when(F.col("warranty"), "Lender").when(is_whole, obligation_party(F.col("c.content"))).otherwise(obligation_party(F.col("raw"))).alias("obligations_of"),
        F.when(is_whole | F.col("warranty"), None).otherwise(F.col("__h.strategy")).alias("header_strategy"),
        F.when(F.col("c.first").isNotNull(), F.concat_ws("-", F.col("c.first").cast("string"), F.col("c.last").cast("string"))).alias("warranty_range"),
        F.col("c.total").alias("warranty_total"),
        F.when(is_whole | F.col("warranty"), F.col("c.content")).otherwise(F.col("raw")).alias("__searched"),
    )
    rows = link_chunks(dedupe_chunk_ids(rows))
    return rows.withColumns({
        "token_count": token_count(F.col("page_content")), "contains_table": F.lit(False), "doc_source": F.lit("main"), "retrieval_priority": F.lit("high"),
    })


def dedupe_chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id from base_id: the first use in a document keeps it, later ones get _dup1, _dup2 and so on."""
    again = F.row_number().over(Window.partitionBy("doc_id", "base_id").orderBy("seq")) - 1
    chunk_id = F.when(again == 0, F.col("base_id")).otherwise(F.concat("base_id", F.lit("_dup"), again.cast("string")))
    return chunks.withColumn("chunk_id", chunk_id)


def link_chunks(chunks: DataFrame) -> DataFrame:
    """prev_chunk_id and next_chunk_id along a document; empty at its ends."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    return chunks.withColumn("prev_chunk_id", F.coalesce(F.lag("chunk_id").over(order), F.lit(""))).withColumn(
        "next_chunk_id", F.coalesce(F.lead("chunk_id").over(order), F.lit(""))
    )


def definition_slice(text: Column) -> Column:
    """The text from the first "Section 1" (else its start) to the first "Section 2" (else its end)."""
    start, end = F.regexp_instr(text, F.lit(r"(?i)Section\s+1[.\s]")), F.regexp_instr(text, F.lit(r"(?i)Section\s+2[.\s]"))
    start = F.when(start == 0, F.lit(1)).otherwise(start)
    end = F.when(end == 0, F.length(text) + 1).otherwise(end)
    return F.when(end > start, F.substring(text, start, end - start)).otherwise(F.lit(""))


def _definitions(text: Column) -> Column:
    """array<string>: the first section of a text, cut before each quoted term that opens a line."""
    return F.filter(F.split(definition_slice(text), rf"(?md)^(?={TERM})"), lambda x: x.rlike(rf"\A{TERM}"))


def _term(piece: Column) -> Column:
    return F.regexp_extract(piece, r'\A"([A-Z][^"]+)":', 1)


def definition_chunks(docs: DataFrame) -> DataFrame:
    """Layer 1: a chunk for each quoted term of docs(doc_id, text) that opens a line of the first section."""
    rows = docs.select("doc_id", F.posexplode(_definitions(F.col("text"))).alias("__pos", "__piece"))
    term = _term(F.col("__piece"))
    content = F.concat(F.lit(f"[{AGREEMENT} | Section 1 — Definitions | Term: "), term, F.lit("]\n\n"), strip(F.col("__piece")))
    rows = rows.select(
        "doc_id", (F.col("__pos") + 1).alias("seq"), F.concat(F.lit("def_"), slugify(term)).alias("base_id"), F.lit("definition").alias("chunk_type"),
        term.alias("term"), F.lit("1").alias("section"), content.alias("page_content"), token_count(content).alias("token_count"),
        F.lit(False).alias("contains_table"), F.lit("main").alias("doc_source"), F.lit("critical").alias("retrieval_priority"),
    )
    return dedupe_chunk_ids(rows)


def defined_terms_present(chunks: DataFrame, definitions: DataFrame, searched: str = "page_content") -> DataFrame:
    """chunks with def_terms_present: the document's defined terms that occur in the column `searched`, sorted.

    The terms of a document become one automaton, and each of its chunks is
    read once, however many terms there are.
    """
    terms = definitions.groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("__terms"))
    # chunks of one document behind each other, so that a task makes few automata
    return _with_terms(chunks.join(terms, "doc_id", "left").sortWithinPartitions("doc_id"), searched)


def _with_terms(chunks: DataFrame, searched: str) -> DataFrame:
    """def_terms_present from the array __terms of a chunk's document."""
    none = F.expr("CAST(array() AS array<string>)")
    return chunks.withColumn("def_terms_present", F.coalesce(terms_in(F.col("doc_id").cast("string"), F.col(searched), F.col("__terms")), none)).drop("__terms")


def terms_in(doc: Column, text: Column, terms: Column) -> Column:
    """The strings of the array `terms`, the same for all rows of one doc, that occur in text, in their order."""

    @F.pandas_udf("array<string>")
    def present(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import ahocorasick

        last, automaton = None, None
        for docs, texts, lists in batches:
            out = []
            for doc, text, own in zip(docs, texts, lists):
                if own is None or not len(own) or not text:
                    out.append([])
                    continue
                if automaton is None or doc is None or doc != last:
                    automaton, last = ahocorasick.Automaton(), doc
                    for i, term in enumerate(own):
                        automaton.add_word(term, i)
                    automaton.make_automaton()
                out.append([own[i] for i in sorted({i for _, i in automaton.iter(text)})])
            yield pd.Series(out, dtype=object)

    return present(doc, text, terms)


def heading_context(text: Column) -> Column:
    """The last header of a page: number and title, or the title, or nothing."""
    last = F.try_element_at(detect_headers(text), F.lit(-1))
    return F.coalesce(strip(F.concat_ws(" ", F.nullif(last["number"], F.lit("")), last["title"])), F.lit(""))


def all_layers(definitions: DataFrame, sections: DataFrame, tables: DataFrame) -> DataFrame:
    """The chunks of all layers under one schema, CHUNKS; what a layer has not is null, other columns go."""
    out = definitions.unionByName(sections, allowMissingColumns=True).unionByName(tables, allowMissingColumns=True)
    wanted = T.StructType.fromDDL(CHUNKS)
    return out.select(*[(F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def contract_chunks(pages: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """pages(doc_id, page_number, text, tables) -> chunks of the three layers. docs: join_pages(pages), where that is written already.

    A document's terms go with it, so the shuffle that joins its pages serves
    definitions, sections and the terms in these.
    """
    from ragworks.operators.tables import table_chunks

    docs = join_pages(pages) if docs is None else docs
    terms = F.array_sort(F.array_distinct(F.transform(_definitions(F.col("text")), _term)))
    sections = _with_terms(section_chunks(docs.withColumn("__terms", terms)), "__searched")
    return all_layers(definition_chunks(docs), sections, table_chunks(pages))


def chunk_type_counts(chunks: DataFrame, **more: str) -> DataFrame:
    """Chunks of each type in a document, and those that each condition of more holds for; 0 where it has none."""
    kinds = {k: f"chunk_type = '{k}'" for k in ("definition", "section", "table")} | more
    return chunks.groupBy("doc_id").agg(*[F.count_if(F.expr(condition)).alias(name) for name, condition in kinds.items()])


def policy_chunks(pages: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Fixed-size overlapping chunks of each page; all other columns go with each."""
    rest = [c for c in pages.columns if c != "text"]
    return pages.select(*rest, F.posexplode(recursive_split(F.col("text"), size, overlap)).alias("piece", "page_content"))
