"""PII spans, in DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and value rules
confirm them, and words shortly before a span raise its score. Spark has no
function for the places of matches: they are running sums of the lengths of
the matches and of the gaps that a split at the same expression leaves. The
words before a match are put together from these pieces as well, so that the
work grows with the text and not with its square.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragworks.functions.text import let, running_sums

#: Characters before a span that are searched for context words.
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
ACCEPT = 0.5

#: Characters of an account number by country (fixed values of the public registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; false for an empty one."""
    at = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.when(F.length(digits) > 0, F.aggregate(at, F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def mod_97(value: Column) -> Column:
    """Whether an account number in capitals and digits passes mod 97 (ISO 13616)."""
    text = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(text, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.when(F.length(value) > 4, F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add) == 1).otherwise(F.lit(False))


def _ip_parts(value: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(value, "\\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))


def _between(value: Column, least: int, most: int) -> Column:
    return F.length(_digits(value)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """pattern proposes, confirm validates, base is the score without context; quick is a cheap test that a text may have a match.

    The patterns are possessive and start only where no match can have begun
    earlier, so that a long run of one class of characters is read once.
    """

    name: str
    quick: str
    pattern: str
    confirm: Callable[[Column], Column]
    base: float
    context: str


#: The four kinds of the contract; their spans all score at least ACCEPT.
BASE_KINDS = [
    Kind(
        "email",
        "@",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9-]|\.(?=[A-Za-z0-9-]))*+",
        lambda v: F.lit(True),
        0.7,
        "mail|contact|write to",
    ),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip_parts, 0.5, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){15}", r"[0-9](?:[\x20-]?[0-9])++", lambda v: _between(v, 16, 19) & luhn(_digits(v)), 0.7, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: _between(v, 8, 15), 0.6, "phone|call|tel|mobile"),
]

#: Kinds that the method adds.
ADDED_KINDS = [
    Kind("iban", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", rf"\b(?:{_IBAN})\b", lambda v: mod_97(F.replace(v, F.lit(" "), F.lit(""))), 0.7, "iban|account|bank"),
    Kind("national_id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", lambda v: ~v.rlike("^(000|666|9)|-00-|-0000$"), 0.3, "ssn|social security|tax id"),
]


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, value, near), in code points, end exclusive.

    near: the CONTEXT_CHARS characters before the match.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(matches.alias("value"), F.split(text, pattern, -1).alias("gap")), lambda p: p["value"].isNotNull())
    size = lambda p: F.length(F.coalesce(p["value"], F.lit("")))

    def spans(pairs: Column) -> Column:
        ends = running_sums(F.transform(pairs, lambda p: size(p) + F.length(F.coalesce(p["gap"], F.lit("")))))
        return let(F.struct(ends.alias("ends"), _before(pairs).alias("near")), lambda x: F.transform(pairs, lambda p, i: span(x, p, i)))

    def span(x: Column, p: Column, i: Column) -> Column:
        end = F.get(x["ends"], i)
        return F.struct((end - size(p)).alias("start"), end.alias("end"), p["value"].alias("value"), F.get(x["near"], i).alias("near"))

    return let(pairs, spans)


def _before(pairs: Column) -> Column:
    """What stands right before each match: its gap, and as much of the pieces before as CONTEXT_CHARS take.

    As a match has a character at least, CONTEXT_CHARS pieces are enough, and
    each pass doubles how many are joined.
    """
    cut = lambda x: F.right(x, F.lit(CONTEXT_CHARS))
    own = F.transform(pairs, lambda p, i: cut(F.concat(F.coalesce(F.get(pairs, i - 1)["value"], F.lit("")), F.coalesce(p["gap"], F.lit("")))))
    passes = F.array(*[F.lit(1 << k) for k in range(CONTEXT_CHARS.bit_length())])
    return F.aggregate(passes, own, lambda acc, back: F.transform(acc, lambda x, i: cut(F.concat(F.coalesce(F.get(acc, i - back), F.lit("")), x))))


def kind_spans(text: Column, kind: Kind) -> Column:
    """Accepted spans of one kind: array of (start, end, value, score)."""
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,value:string,score:double>>)")
    confirmed = F.filter(located(text, kind.pattern), lambda s: kind.confirm(s["value"]))
    score = lambda s: F.when(F.lower(s["near"]).rlike(kind.context), F.lit(kind.base + CONTEXT_GAIN)).otherwise(F.lit(kind.base))
    scored = F.transform(confirmed, lambda s: F.struct(s["start"], s["end"], s["value"], score(s).alias("score")))
    return F.when(text.rlike(kind.quick), F.filter(scored, lambda s: s["score"] >= ACCEPT)).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text", added: list[Kind] = ADDED_KINDS, out: str = "pii") -> DataFrame:
    """docs with the column `out`: array of (kind, start, end, value, score), by kind in the order of the lists, then start.

    A null text counts as empty; every row stays and every other column passes
    through, whatever its name; only a column called as `out` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def named(kind: Kind) -> Column:
        return F.transform(kind_spans(whole, kind), lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"], s["end"], s["value"], s["score"]))

    return docs.withColumn(out, F.concat(*map(named, [*BASE_KINDS, *added])))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores of every row of docs.

    Repeated rows give repeated rows, an empty table an empty result; columns
    besides doc_id and text are not read. A text without spans has zeros, the
    digest of an empty string, and empty lists.
    """
    found = find_pii(docs.select("doc_id", "text"))
    place = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("pii", lambda s: s["kind"].isin(*[k.name for k in BASE_KINDS]))

    def count(kind: Kind) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind.name)).cast("long").alias(f"n_{kind.name}")

    return found.select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, place), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", place), ",").alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
