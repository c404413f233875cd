"""Text projections: column expressions of one row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a policy name drops (fixed values).
NAME_STOP_WORDS = [
    "BROCHURE", "POLICY", "PLAN", "PROSPECTUS", "INSURANCE", "PDF", "ENG", "HIN", "HINDI",
    "VERSION", "DRAFT", "FINAL", "COPY", "UPDATED", "REVISED", "INCH", "X", "S",
]
#: A name with all of these is known under one name (fixed values).
KNOWN_NAME = ["LIC", "JEEVAN", "AROGYA"]

#: Who is obliged, by the first phrase found (fixed values).
OBLIGED = ["Lender", "Authority", "Borrower"]

OVERLAP_TOKENS = 150

#: All Unicode white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running_sums(values: Column) -> Column:
    """Sums of an array of integers (none null) from its start up to each place.

    Each of log2(n) passes adds what stands 1, 2, 4 ... places before, so no
    array grows element by element.
    """

    def summed(whole: Column) -> Column:
        passes = F.when(F.size(whole) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(whole))).cast("int"))).otherwise(F.expr("CAST(array() AS array<int>)"))

        def add(acc: Column, k: Column) -> Column:
            back = F.call_function("shiftleft", F.lit(1), k)
            return F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - back), F.lit(0)))

        return F.aggregate(passes, whole, add)

    return let(values, summed)


def strip(text: Column) -> Column:
    """Without white space at both ends (Unicode white space, not only blanks); no pattern is tried at every character."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def first_filled(*texts: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def clean_control(text: Column) -> Column:
    """Delete control characters but tab, line feed and carriage return; C1 controls go too."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")


def clean_export(text: Column) -> Column:
    """Delete C0 control characters but tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def normalize_policy_name(filename: Column) -> Column:
    """Name of a policy from its file name: significant upper-case tokens joined by underscores, or the stem."""
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    stem = F.upper(F.regexp_replace(base, r"(?<=.)\.[^.]+$", ""))
    tokens = F.regexp_extract_all(stem, F.lit("[A-Z0-9]+"), F.lit(0))
    kept = F.filter(tokens, lambda t: ~t.isin(*NAME_STOP_WORDS) & ~t.rlike("^[0-9]+$"))
    known = reduce(lambda a, b: a & b, [F.array_contains(kept, w) for w in KNOWN_NAME])
    return F.when(F.size(kept) == 0, stem).when(known, F.lit("_".join(KNOWN_NAME))).otherwise(F.array_join(kept, "_"))


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def slugify(text: Column) -> Column:
    runs = F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(runs, "^_+|_+$", ""), 1, 60)


def tail_tokens(text: Column, n: int = OVERLAP_TOKENS) -> Column:
    return F.right(text, F.lit(4 * n))


def snippet(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def obligation_party(text: Column) -> Column:
    # a plain search first: few texts have the word, and patterns are tried at every character
    out = F.when(~F.contains(F.lower(text), F.lit("shall")), "General")
    for party in OBLIGED:
        out = out.when(text.rlike(rf"(?i)\b{party}\s+shall\b"), party)
    return out.otherwise(F.lit("General"))


def is_toc_line(line: Column) -> Column:
    """Whether a line looks like one of a table of contents."""
    return strip(line).rlike(r"\.{4,}\s*\d+\s*$")
