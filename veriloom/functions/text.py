"""Text expressions: cleaning, folding, trimming. All are built-in functions."""

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
HARD_SPACES = "\u00a0\u2007\u202f"
HIDDEN = r"[\u00AD\u200B-\u200D\u2060\uFEFF\u202A-\u202E\u2066-\u2069]|[\p{Cc}&&[^\t\n\r]]"
#: A character that cleaning or folding may change, besides white space: most texts have none.
SPECIAL = r"[^\t\n\r\x20-\x7E]"


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks, and their plain letters."""
    pairs = {"ł": "l", "Ł": "L"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.category(c).startswith("M"))
        if len(plain) == 1 and plain != chr(code):
            pairs[chr(code)] = plain
    return "".join(pairs), "".join(pairs.values())


MARKED, PLAIN = _fold_table()


def clean(text: Column) -> Column:
    """Ligatures apart, hard spaces as spaces, no hidden or control characters but tab and breaks."""
    return F.when(text.rlike(SPECIAL), _cleaned(text)).otherwise(text)


def _cleaned(text: Column) -> Column:
    for ligature, letters in LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    return F.regexp_replace(F.translate(text, HARD_SPACES, "   "), HIDDEN, "")


def fold(text: Column) -> Column:
    """Clean, without diacritics, single spaces: what phrase rules read. Marks of other scripts stay."""
    plain = F.when(text.rlike(SPECIAL), F.regexp_replace(F.translate(_cleaned(text), MARKED, PLAIN), r"\p{M}", "")).otherwise(text)
    return F.regexp_replace(plain, r"\s+", " ")


def search_form(text: Column) -> Column:
    """The folded text in lower case, without spaces before commas."""
    return F.replace(F.lower(fold(text)), F.lit(" ,"), F.lit(","))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def dedupe_key(text: Column) -> Column:
    """Lower case with single spaces: values that differ in nothing else are the same."""
    return F.lower(strip(F.regexp_replace(text, r"\s+", " ")))


def visible_length(text: Column) -> Column:
    """Characters that are not white space; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(text, r"\s+", "")), F.lit(0))


def lookup(table: dict, key: Column) -> Column:
    """Value of a small table of constants (strings, or whole numbers), null where it has none. The
    table is one literal of the plan."""
    text = "\x02".join(f"{k}\x01{v}" for k, v in table.items())
    found = F.try_element_at(F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01")), key)
    return found if isinstance(next(iter(table.values())), str) else found.cast("long")


def cents(value: Column) -> Column:
    """Hundredths of an amount without its sign, rounded half up as binary numbers do."""
    return F.floor(F.abs(value.cast("double")) * 100 + 0.5).cast("long")


def rebuilt(text: Column, pattern: str, piece: Callable[[Column], Column]) -> Column:
    """``text`` with ``piece(match)`` for each match; what stands between matches is kept."""

    def join(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        joined = F.array_join(F.transform(F.arrays_zip(between.alias("gap"), found.alias("match")), lambda p: F.concat(p["gap"], F.coalesce(piece(p["match"]), F.lit("")))), "")
        return F.when(F.size(found) > 0, joined).otherwise(text)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), join)
