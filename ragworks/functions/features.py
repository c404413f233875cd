"""Rule-based features of a chunk, all as column expressions.

The word lists and patterns below are fixed values: results depend on them.
Stems among them match only as whole words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragworks.functions.text import first_filled, let, strip

STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will "
    "would shall should may might can could of in to for on with at by from "
    "as into through during before after above below between under and but or "
    "nor not so yet both either neither each every all any few more most other "
    "some such no only own same than too very just about also back even still "
    "well how what which who whom this that these those it its he she they we "
    "you his her their our your my me him us them i ii iii iv v vi vii viii ix x "
    "ie eg etc per se re vs"
).split()

SECTION_ID = r"(?:^|\n)\s*(\d{1,2}\.\d{1,2}(?:\.\d{1,2})?)\s"
TIMELINE = r"(?i)(\d+)\s*(days?|weeks?|months?|years?|hours?|business\s+days?|calendar\s+days?|working\s+days?)"
OBLIGATIONS = {
    "Mandatory": r"(?i)\b(shall|must|is required to|are required to|obligat)\b",
    "Recommended": r"(?i)\b(should|is recommended|it is advisable|ought to)\b",
    "Optional": r"(?i)\b(may|can|is permitted to|at its discretion|optionally)\b",
}
PARTIES = {
    "Consultant": r"(?i)\b(consultant|consultancy firm|consulting firm)\b",
    "Employer": r"(?i)\b(employer|client|procuring entity|contracting authority)\b",
    "Project Manager": r"(?i)\b(project manager|project director|team leader)\b",
    "Authority": r"(?i)\b(authority|government|ministry|department|agency)\b",
    "Committee": r"(?i)\b(committee|evaluation committee|selection committee|panel)\b",
}
ACTIONS = {
    "submit": r"(?i)\b(submit|submitting|submission|deliver|furnish)\b",
    "approve": r"(?i)\b(approv|accept|endorse|sanction|consent)\b",
    "pay": r"(?i)\b(pay|payment|remunerat|compensat|reimburse|disburse)\b",
    "terminate": r"(?i)\b(terminat|cancel|rescind|revoke)\b",
    "notify": r"(?i)\b(notify|notification|notice|inform|advise)\b",
    "review": r"(?i)\b(review|evaluat|assess|examin|inspect|audit)\b",
    "prepare": r"(?i)\b(prepar|draft|develop|formulate|design)\b",
    "issue": r"(?i)\b(issue|issuing|issuance|publish|release)\b",
}
DEFINITION = r"(?i)\b(definition|define|defined|defines)\b"
MEANS = r"(?i)\bmeans\b.*[:;]"
PROCEDURE = r"(?i)\b(procedure|process)\b"
NUMBERED_STEP = r"(?i)\b(?:step|stage)\s+\d"
HEADING = r"(?md)\A[A-Z][A-Z\s\-]{4,60}$"
HIGH_RISK = r"(?i)\b(penalt|terminat|liquidated damages|breach|default|forfeiture|disqualif|blacklist|debar|suspend|void|invalid)\b"
MEDIUM_RISK = r"(?i)\b(compliance|compliant|comply|regulation|regulatory|audit|report|deadline|liable|liability|warranty|guarantee|insurance|indemnit)\b"
DOCUMENTS = (
    r"(?i)\b(Annex|Appendix|Schedule|Attachment|Exhibit|Section|Clause|Article|Form|Table|ToR|Terms of Reference|RFP|EOI|LoI"
    r"|Contract Agreement|General Conditions|Special Conditions|Bid Document)\s*[A-Z0-9\-]*\b"
)
SENTENCE = r"[A-Z][^.!?\n]{15,200}[.!?]"
CHAPTER = r"(?i)(?:Chapter|CHAPTER)\s+(\d+|[IVXLC]+)\s*[:\-–—.\s]+\s*(.+)"
TITLE = r"(?:^|\n)\s*(?:\d+\.)+\d*\s+([A-Z][A-Za-z\s,\-&/]{3,80}?)(?:\n|$)"


#: Bytes of texts whose words are counted at once.
SLICE_BYTES = 4_000_000

#: What stands between words: \\b lies where it begins or ends.
BETWEEN_WORDS = r"[^\p{L}\p{Nd}\p{Mn}_]+"


def _alternatives(pattern: str) -> tuple[list[str], list[str]]:
    """(single words, phrases) of a pattern that is a list of them between word boundaries."""
    parts = pattern.removeprefix(r"(?i)\b(").removesuffix(r")\b").split("|")
    return [x for x in parts if x.isalpha()], [x for x in parts if not x.isalpha()]


def _rarest(phrase: str) -> str:
    """The word of a phrase that is looked for before the phrase."""
    return max(re.findall("[a-z]+", phrase), key=len)


_WORD_LISTS = [*OBLIGATIONS.values(), *PARTIES.values(), *ACTIONS.values(), DEFINITION, PROCEDURE, HIGH_RISK, MEDIUM_RISK]
_SOUGHT = sorted({"means", "step", "stage"} | {w for p in _WORD_LISTS for words, phrases in [_alternatives(p)] for w in [*words, *map(_rarest, phrases)]})


def sought_words(text: Column) -> Column:
    """The words of a text that any of the word lists names: found in one pass for all rules."""
    return F.array_intersect(F.split(F.lower(text), BETWEEN_WORDS), F.array(*map(F.lit, _SOUGHT)))


def _named(text: Column, seen: Column, pattern: str) -> Column:
    """Whether a text has a word or phrase of the pattern; seen: its sought_words."""
    words, phrases = _alternatives(pattern)
    out = F.arrays_overlap(seen, F.array(*map(F.lit, words)))
    for phrase in phrases:
        out = out | (F.array_contains(seen, _rarest(phrase)) & text.rlike(rf"(?i)\b{phrase}\b"))
    return out


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without a match (none of these groups can be empty)."""
    return F.get(F.filter(F.array(F.regexp_extract(text, pattern, group)), lambda x: x != ""), 0)


def _all_named(text: Column, seen: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(_named(text, seen, p), F.lit(name)) for name, p in patterns.items()]))


def section_id(text: Column, section_number: Column) -> Column:
    return first_filled(section_number, F.regexp_extract(text, SECTION_ID, 1))


def timeline(text: Column) -> Column:
    """The first number with a unit of time, the unit in lower case; null without one."""
    told = lambda m: F.concat_ws(" ", F.regexp_extract(m, r"\d+", 0), F.lower(F.regexp_extract(m, TIMELINE, 2)))
    return F.get(F.transform(F.filter(F.array(F.regexp_extract(text, TIMELINE, 0)), lambda m: m != ""), told), 0)


def obligation(text: Column, seen: Column | None = None) -> Column:
    """seen, here and below: sought_words of the text where they are at hand."""
    seen = sought_words(text) if seen is None else seen
    out = F
    for name, pattern in OBLIGATIONS.items():
        out = out.when(_named(text, seen, pattern), name)
    return out.otherwise(F.lit("Informational"))


def responsible_party(text: Column, seen: Column | None = None) -> Column:
    return _all_named(text, sought_words(text) if seen is None else seen, PARTIES)


def action_type(text: Column, seen: Column | None = None) -> Column:
    return _all_named(text, sought_words(text) if seen is None else seen, ACTIONS)


def content_type(text: Column, chunk_type: Column, seen: Column | None = None) -> Column:
    seen = sought_words(text) if seen is None else seen
    means = F.array_contains(seen, "means") & text.rlike(MEANS)
    step = F.arrays_overlap(seen, F.array(F.lit("step"), F.lit("stage"))) & text.rlike(NUMBERED_STEP)
    return (
        F.when(chunk_type == "definition", "Definition")
        .when(chunk_type == "table", "Procedure")
        .when(means | _named(text, seen, DEFINITION), "Definition")
        .when(step | _named(text, seen, PROCEDURE), "Procedure")
        .when((F.length(text) < 120) & strip(text).rlike(HEADING), "Heading")
        .otherwise(F.lit("Clause"))
    )


def risk_level(text: Column, content_type: Column, seen: Column | None = None) -> Column:
    seen = sought_words(text) if seen is None else seen
    return (
        F.when(content_type.isin("Heading", "Definition"), "None").when(_named(text, seen, HIGH_RISK), "High").when(_named(text, seen, MEDIUM_RISK), "Medium").otherwise(F.lit("Low"))
    )


def document_referenced(text: Column) -> Column:
    """Kinds of documents named, first spelling of each, five at most (a word behind the kind is part of the match)."""
    found = F.regexp_extract_all(text, F.lit(DOCUMENTS), F.lit(1))
    lower = F.transform(found, F.lower)
    firsts = F.filter(found, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)
    return F.slice(firsts, 1, 5)


def keywords(text: Column, top_n: int = 5) -> Column:
    """The most frequent words of three letters or more, ties by first appearance."""

    @F.arrow_udf("array<string>")
    def top(texts: pa.Array) -> pa.Array:
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        cuts = np.unique(np.append(np.searchsorted(size, np.arange(SLICE_BYTES, size[-1] if len(size) else 0, SLICE_BYTES)), len(texts)))
        return pa.concat_arrays([pa.array([], pa.list_(pa.string())), *(top_words(texts.slice(i, j - i), top_n) for i, j in zip([0, *cuts], cuts))])

    return top(F.lower(text))


def top_words(texts: pa.Array, top_n: int) -> pa.Array:
    """keywords of each of some lower-case texts, all of them counted at once."""
    texts = texts.cast(pa.string())
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    start = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if len(texts) else 0
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[start : start + (ends[-1] if len(ends) else 0)]
    # a word is a run of a-z in one text: it begins and ends beside another byte or where a text does
    letter = (data >= ord("a")) & (data <= ord("z"))
    edge = np.zeros(len(data) + 1, bool)
    edge[[0, len(data)]] = True
    edge[ends] = True
    edge[1:-1] |= letter[1:] != letter[:-1]
    at = np.flatnonzero(edge)
    first, last = at[:-1], at[1:]
    word = (last - first >= 3) & letter[first] if len(data) else np.zeros(0, bool)
    first, last = first[word], last[word]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[first] += 1
    inside[last] -= 1
    lengths = np.append(0, np.cumsum(last - first)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(lengths), pa.py_buffer(data[np.cumsum(inside[:-1], dtype=np.int8) > 0])).dictionary_encode()
    named, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
    row = np.searchsorted(ends, first, side="right")
    kept = ~pc.is_in(named, pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False)[code]
    keyed, place, n = np.unique(row[kept] * max(1, len(named)) + code[kept], return_index=True, return_counts=True)
    row, code = np.divmod(keyed, max(1, len(named)))
    order = np.lexsort((place, -n, row))
    row, code = row[order], code[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < top_n
    offsets = np.append(0, np.cumsum(np.bincount(row[best], minlength=len(texts)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), named.take(pa.array(code[best])), mask=texts.is_null())


def summary(text: Column) -> Column:
    return let(F.regexp_replace(strip(text), r"\A\[.*?\]\s*", ""), _first_sentence)


def _first_sentence(clean: Column) -> Column:
    short = F.when(F.length(clean) > 120, F.concat(strip(F.left(clean, F.lit(120))), F.lit("…"))).otherwise(strip(clean))
    return F.coalesce(strip(_found(clean, f"({SENTENCE})")), short)


def chapter(text: Column, chunk_id: Column, section: Column) -> Column:
    """section: the result of section_id."""
    found = F.filter(F.array(F.when(F.contains(F.lower(text), F.lit("chapter")), F.regexp_extract(text, CHAPTER, 0))), lambda m: m != "")
    told = lambda m: F.concat(F.lit("Chapter "), F.regexp_extract(m, CHAPTER, 1), F.lit(": "), strip(F.regexp_extract(m, CHAPTER, 2)))
    named = F.get(F.transform(found, told), 0)
    return F.coalesce(
        F.concat(F.lit("Chapter "), _found(chunk_id, r"ch(\d+)")),
        F.concat(F.lit("Chapter "), F.substring_index(section, ".", 1)),
        named,
    )


def section_title(text: Column) -> Column:
    return strip(_found(text, TITLE))


#: Features that enrich() also lays out as columns of their own: plain ones, and lists as JSON.
PLAIN = ["content_type", "obligation", "risk_level", "timeline", "summary"]
LISTS = ["responsible_party", "action_type", "document_referenced", "keywords"]


def enrich(chunks: DataFrame) -> DataFrame:
    """chunks(chunk_id, chunk_type, section_number, page_content, ...) with `features`, `features_json` and feat_* columns.

    Null contents give null features where a pattern is sought, and the last
    choice (Informational, Clause, Low) where one is picked.
    """
    text = F.coalesce("page_content", F.lit(""))
    out = chunks.withColumn("__section", section_id(text, F.col("section_number"))).withColumn("__seen", sought_words(text))
    seen = F.col("__seen")
    out = out.withColumn("__content", content_type(text, F.coalesce("chunk_type", F.lit("")), seen))
    features = F.struct(
        F.col("__section").alias("section_id"),
        chapter(text, F.coalesce("chunk_id", F.lit("")), F.col("__section")).alias("chapter"),
        section_title(text).alias("section_title"),
        F.col("__content").alias("content_type"),
        obligation(text, seen).alias("obligation"),
        responsible_party(text, seen).alias("responsible_party"),
        action_type(text, seen).alias("action_type"),
        timeline(text).alias("timeline"),
        document_referenced(text).alias("document_referenced"),
        risk_level(text, F.col("__content"), seen).alias("risk_level"),
        keywords(text).alias("keywords"),
        summary(text).alias("summary"),
    )
    out = out.withColumn("features", features).withColumn("features_json", F.to_json("features", {"ignoreNullFields": "false"}))
    for name in PLAIN:
        out = out.withColumn(f"feat_{name}", F.col(f"features.{name}"))
    for name in LISTS:
        out = out.withColumn(f"feat_{name}", F.when(F.size(f"features.{name}") > 0, F.to_json(f"features.{name}")))
    return out.drop("__section", "__content", "__seen")


def flatten_metadata(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scalars as they are, nested columns as JSON text, the rest as text; by the schema alone."""
    scalar = (T.StringType, T.NumericType, T.BooleanType)
    nested = (T.ArrayType, T.MapType, T.StructType)

    def flat(f: T.StructField) -> Column:
        if f.name in keep or isinstance(f.dataType, scalar):
            return F.col(f"`{f.name}`")
        return F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string").alias(f.name)

    return df.select(*[flat(f) for f in df.schema.fields])


def export_features(chunks: DataFrame) -> DataFrame:
    """The flat feature table: `Chunk ID`, the leading features, the others, and the text last; lists joined by commas."""
    from ragworks.functions.text import clean_export

    leading = ["section_id", "chapter", "section_title", "content_type", "obligation", "risk_level"]
    others = ["responsible_party", "action_type", "timeline", "document_referenced", "keywords", "summary"]

    def column(name: str) -> Column:
        title = name.replace("_", " ").title()
        value = F.array_join(f"features.{name}", ", ") if name in LISTS else F.col(f"features.{name}")
        return clean_export(value).alias(title)

    return chunks.select(clean_export(F.col("chunk_id")).alias("Chunk ID"), *map(column, leading + others), clean_export(F.col("page_content")).alias("Text Content"))
