"""Numbers in text under a document's decimal style: comma, point or unknown."""

from pyspark.sql import Column, functions as F

from .dims import COMMA_LANGUAGES, CURRENCY_WORDS, LABELS, MONEY_MULTIPLIERS, MULTIPLIERS, POINT_LANGUAGES
from .text import cents, let, lookup

# Number tokens by style, and numbers that are grouped in one way only.
COMMA = r"\d{1,3}(?:[ .]\d{3})+(?:,\d+)?|\d+,\d+|\d+\.\d{1,2}(?![\d.])|\d+"
POINT = r"\d{1,3}(?:[, ]\d{3})+(?:\.\d+)?|\d+\.\d+|\d+"
TOKEN = {"comma": COMMA, "point": POINT}
GROUPED = (r"(?<![\d.,])\d{1,3}(?:\.\d{3}){2,}(?![\d.,])", r"(?<![\d.,])\d{1,3}(?:,\d{3}){2,}(?![\d.,])")


def value(raw: Column, style: str) -> Column:
    """Value of a token as a double."""
    if style == "point":
        return F.translate(raw, ", ", "").cast("double")
    whole = F.translate(F.substring_index(raw, ",", 1), " .", "")
    plain = F.when(raw.contains(".") & raw.rlike(r"^\d+\.\d{1,2}$"), raw).otherwise(F.translate(raw, " .", ""))
    return F.when(raw.contains(","), F.concat(whole, F.lit("."), F.substring_index(raw, ",", -1))).otherwise(plain).cast("double")


def language_style(language: Column) -> Column:
    code = F.lower(F.substring(language, 1, 2))
    return F.when(code.isin(COMMA_LANGUAGES), "comma").when(code.isin(POINT_LANGUAGES), "point").otherwise("unknown")


def style_scores(rest: Column) -> tuple[Column, Column]:
    """How much of a text without dates is written with decimal commas and with decimal points."""
    count = lambda pattern: F.regexp_count(rest, F.lit(pattern))
    # What counts for a style, and how much.
    comma = count(r"\d,\d{1,2}(?!\d)") + 2 * count(r"\d{1,3}(?: \d{3})+,\d")
    point = count(r"\d\.\d{1,2}(?![\d.])") + 2 * count(r"\d{1,3}(?:,\d{3})+\.\d")
    return comma, point


def style_of(comma: Column, point: Column, language: Column) -> Column:
    return F.when((comma >= 2) & (comma >= 3 * point), "comma").when((point >= 2) & (point >= 3 * comma), "point").otherwise(language_style(language))


_TOKENS = "array<struct<raw:string,before:string,after:string,cents:bigint,reading:string>>"


def tokens(rest: Column, style: str) -> Column:
    """Number tokens of a text: raw, the text before (back to the last token) and after (up to the
    next), cents and reading."""

    def made(parts: Column) -> Column:
        gap = lambda i: F.get(parts["gaps"], i)
        return F.transform(parts["found"], lambda raw, i: F.struct(raw.alias("raw"), gap(i).alias("before"), gap(i + 1).alias("after"), cents(value(raw, style)).alias("cents"), F.lit(style).alias("reading")))

    split = F.struct(F.regexp_extract_all(rest, F.lit(TOKEN[style]), F.lit(0)).alias("found"), F.split(rest, TOKEN[style], -1).alias("gaps"))
    return F.when(rest.rlike(r"\d"), let(split, made)).otherwise(F.array().cast(_TOKENS))


def read(rest: Column, style: Column, both: bool) -> Column:
    """Tokens under a column of styles; an unknown style has both readings, or the comma's only."""
    comma, point = tokens(rest, "comma"), tokens(rest, "point")
    return F.when(style == "comma", comma).when(style == "point", point).otherwise(F.concat(comma, point) if both else comma)


def multiplied(token: Column) -> Column:
    """Cents of a token times the multiplier word that follows it, null without one."""
    # How far a multiplier may be, and its letters.
    word = F.lower(F.regexp_extract(F.left(token["after"], F.lit(12)), r"(?i)^\s*([a-ząćęłńóśźż]+)\.?", 1))
    return cents(token["cents"] / 100 * lookup(MULTIPLIERS, word))


def tails(token: Column, style: Column) -> Column:
    """Cents of the ends of a token with spaces: they may be the neighbouring cells of a table."""
    parts = F.split(token["raw"], r"\s+")
    ends = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), " "))).otherwise(F.array().cast("array<string>"))
    first = lambda end, s: cents(value(F.regexp_extract(end, f"^(?:{TOKEN[s]})", 0), s))
    by = {s: F.transform(ends, lambda end: first(end, s)) for s in TOKEN}  # noqa: B023
    return F.when(style == "comma", by["comma"]).when(style == "point", by["point"]).otherwise(F.concat(by["comma"], by["point"]))


def grouped(rest: Column) -> Column:
    """Cents of numbers with two or more groups of thousands: unambiguous in either notation."""
    found = F.concat(*(F.transform(F.regexp_extract_all(rest, F.lit(p), F.lit(0)), lambda raw: F.regexp_replace(raw, "[.,]", "").cast("long") * 100) for p in GROUPED))
    return F.when(rest.rlike(r"\d[.,]\d{3}[.,]\d{3}"), found).otherwise(F.array().cast("array<bigint>"))


# A currency right after and right before a number.
_CURRENCY = "|".join(x.replace("$", r"\$") for x in sorted(CURRENCY_WORDS, key=len, reverse=True))
_AFTER = rf"(?iu)^\s*(?:(tys\.?|mln|mld|million|billion|thousand)\s*)?({_CURRENCY})(?!\p{{L}})"
_BEFORE = rf"(?iu)(?:^|[^\p{{L}}])({_CURRENCY})[ \t]*$"


def currency_of(token: Column) -> Column:
    """Currency written right after a token, else right before it on the same line; else null."""
    after = F.regexp_extract(F.left(token["after"], F.lit(24)), _AFTER, 2)
    before = F.regexp_extract(F.right(token["before"], F.lit(6)), _BEFORE, 1)
    return lookup(CURRENCY_WORDS, F.lower(F.coalesce(F.nullif(after, F.lit("")), before)))


def money_cents(token: Column) -> Column:
    word = F.lower(F.regexp_extract(F.left(token["after"], F.lit(24)), _AFTER, 1))
    factor = F.coalesce(lookup(MONEY_MULTIPLIERS, word), F.lit(1))
    return F.when(factor == 1, token["cents"]).otherwise(cents(token["cents"] / 100 * factor))


#: What a text must have before the words of a kind are searched in it: three letters that each of them
#: has, in every spelling that counts as the same letter where case is ignored (dotless i, Kelvin sign).
LABEL_HINTS = {
    "tax": r"[nN][eE][tT]|[vV][aA][tT]|[bB][rR][uU]|[gG][rR][oO]",
    "period": "[mM](?:[iI\u0130\u0131][eE]|[oO][nN])|[rR][oO][cCkK\u212a]|[aA][nN][nN]|[yY][eE][aA]",
}


def labels_in(text: Column, kind: str) -> Column:
    """Labels of a kind whose words a text has."""
    found = F.filter(F.array(*(F.when(text.rlike(f"(?iu){p}"), label) for label, p in LABELS[kind].items())), lambda x: x.isNotNull())
    return F.when(text.rlike(LABEL_HINTS[kind]), found).otherwise(F.array().cast("array<string>"))


def labels_of(token: Column, kind: str) -> Column:
    """Labels right after a token, else right before it."""
    any_of = "|".join(f"(?:{p})" for p in LABELS[kind].values())
    here = lambda text: F.when(text.rlike(LABEL_HINTS[kind]) & text.rlike(f"(?iu){any_of}"), labels_in(text, kind))
    none = F.array().cast("array<string>")
    return F.coalesce(here(F.left(token["after"], F.lit(40))), here(F.right(token["before"], F.lit(40))), none)
