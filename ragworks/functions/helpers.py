"""Per-row helpers for what column expressions can't say, as Arrow-batched functions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ragworks.schemas import HEADER

#: Strategy, level, prefix of the number, pattern; earlier ones win where two start together (fixed values).
HEADER_RULES = [
    ("S1_section", 1, "", re.compile(r"^[ \t]*Section\s+(\d{1,2})[.\s]\s*([^\n.]{3,80}?)[ \t]*$", re.M | re.I)),
    ("S2_chapter", 1, "Ch", re.compile(r"^[ \t]*Chapter\s+(\d{1,2})\s*[:.\s]\s*([^\n]{3,100}?)[ \t]*$", re.M | re.I)),
    ("S3_deep", 3, "", re.compile(r"^[ \t]{0,6}(\d{1,2}\.\d{1,2}\.\d{1,2})\.?\s+([A-Z][^\n]{2,80}?)[ \t]*$", re.M)),
    ("S4_subsec", 2, "", re.compile(r"^[ \t]{0,6}(\d{1,2}\.\d{1,2})\.?\s+([A-Z][^\n]{2,80}?)[ \t]*$", re.M)),
    ("S5_caps", 1, "", re.compile(r"^[ \t]*()([A-Z][A-Z\s\-/]{4,60})[ \t]*$", re.M)),
]
CONTENTS_LINE = re.compile(r"\.{4,}\s*\d+\s*$")


def find_headers(text: str | None, page_starts: Sequence[int] = ()) -> list[dict]:
    """Headers of a text by start, as the rules find them.

    Lines of a table of contents and empty titles are none; a single word in
    capitals needs eight letters. A title in capitals may take several lines,
    but ends with its page: page_starts says where pages that were joined by
    line ends begin.
    """
    text = text or ""
    inner = [s for s in page_starts if 0 < s <= len(text)]
    pages = list(zip([0, *inner], [*(s - 1 for s in inner), len(text)]))
    found: dict[int, dict] = {}
    for strategy, level, prefix, pattern in HEADER_RULES:
        caps = strategy == "S5_caps"
        for m in chain.from_iterable(pattern.finditer(text, *page) for page in (pages if caps else [(0, len(text))])):
            title = m[2].strip() if caps else m[2].strip().rstrip(".")
            listed = CONTENTS_LINE.search(m[0].strip())
            short = caps and len(title.split()) < 2 and len(title) < 8
            if m.start() not in found and title and not listed and not short:
                found[m.start()] = {"level": level, "number": prefix + m[1] if m[1] else "", "title": title, "start": m.start(), "strategy": strategy}
    return [found[k] for k in sorted(found)]


def detect_headers(text: Column, page_starts: Column | None = None) -> Column:
    """array<struct(level, number, title, start, strategy)> of a text column; null counts as empty.

    page_starts: an array of where the pages of the text begin.
    """

    @F.pandas_udf(f"array<{HEADER}>")
    def headers(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, starts in batches:
            yield pd.Series([find_headers(t, () if s is None else s) for t, s in zip(texts, starts)], dtype=object)

    return headers(text, F.lit(None).cast("array<int>") if page_starts is None else page_starts)


def pack(text: str | None, max_tokens: int) -> list[str]:
    """Paragraphs filled into parts of at most max_tokens (4 characters each); a longer paragraph stays whole."""
    parts: list[str] = []
    for paragraph in re.split(r"\n\s*\n", text or ""):
        if parts and max(1, (len(parts[-1]) + 2 + len(paragraph)) // 4) <= max_tokens:
            parts[-1] += "\n\n" + paragraph
        else:
            parts.append(paragraph)
    return parts


def pack_paragraphs(text: Column, max_tokens: int = 800) -> Column:
    @F.pandas_udf("array<string>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([pack(t, max_tokens) for t in batch], dtype=object)

    return parts(text)


SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str | None, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, cut at the first separator that occurs; too long pieces at the next ones.

    Pieces are joined from the left while they fit; a chunk starts with the
    last pieces of the one before that fit in the overlap.
    """
    text = text or ""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, rest = separators[at], separators[at + 1 :]
    pieces = text.split(separator) if separator else list(text)
    out: list[str] = []
    held: list[str] = []
    width = 0

    def flush() -> None:
        whole = separator.join(held).strip()
        if whole:
            out.append(whole)

    for piece in pieces:
        if len(piece) > size:
            flush()
            held, width = [], 0
            out += split_text(piece, size, overlap, rest)
            continue
        if held and width + len(separator) + len(piece) > size:
            flush()
            while held and (width > overlap or width + len(separator) + len(piece) > size):
                width -= len(held[0]) + (len(separator) if len(held) > 1 else 0)
                held = held[1:]
        width += len(piece) + (len(separator) if held else 0)
        held.append(piece)
    flush()
    return out


def recursive_split(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    @F.pandas_udf("array<string>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([split_text(t, size, overlap) for t in batch], dtype=object)

    return chunks(text)
