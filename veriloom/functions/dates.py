"""Dates in text: the strict grammar that is taken out of a text, and the wide one of evidence."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .dims import MONTHS_DE, MONTHS_EN, MONTHS_FR, MONTHS_NL, MONTHS_PL
from .text import MARKED, PLAIN, clean, let, lookup

_EDGE, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_PLAIN_PL = [m.translate(str.maketrans(MARKED, PLAIN)) for m in MONTHS_PL]
_STRICT = {m: i % 12 + 1 for i, m in enumerate([*MONTHS_PL, *MONTHS_EN])} | {m: i + 1 for i, m in enumerate(_PLAIN_PL) if "rzes" in m or "pazdz" in m}
_NAMES = "|".join(sorted(_STRICT, key=len, reverse=True))


def to_date(year: Column, month: Column, day: Column) -> Column:
    """A real calendar date, else null. Parts are texts or numbers."""
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.try_to_date(F.concat_ws("-", part(year, 4), part(month, 2), part(day, 2)), "yyyy-MM-dd")


def _group(pattern: str) -> Callable[[Column, int], Column]:
    return lambda match, i: F.regexp_extract(match, pattern, i)


def _by_slash(m: Column, g: Callable[[Column, int], Column]) -> Column:
    first, second = g(m, 1), g(m, 2)
    return F.when(second.cast("int") > 12, to_date(g(m, 3), first, second)).otherwise(to_date(g(m, 3), second, first))


# The strict grammar of dates.
_AT = rf"(?=\d){_EDGE}"  # the digit first: most places have none
_ISO = rf"{_AT}(\d{{4}})-(\d{{2}})-(\d{{2}}){_END}"
_DOTS = rf"{_AT}(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){_END}"
_SLASHES = rf"{_AT}(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_END}"
_DAY_MONTH = rf"(?iu){_AT}(\d{{1,2}})(?:st|nd|rd|th|\.)?\s+({_NAMES})\s*,?\s+(\d{{4}})"
_MONTH_DAY = rf"(?iu){_EDGE}({_NAMES})\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s+(\d{{4}})"
#: What a text must have, and is found faster, before it is searched for a pattern.
_HINTS = {_ISO: r"\d-\d", _DOTS: r"\d\.\d", _SLASHES: r"\d/\d", _DAY_MONTH: r"\d(?:\p{L}{2}|\.)?\s+\p{L}+\s*,?\s+\d{4}", _MONTH_DAY: r"\s\d{1,2}(?:[A-Za-z\u017F]{2})?\s*,?\s+\d{4}"}
#: Pattern and reading of a match, in the order in which they are taken out.
_GRAMMAR = (
    (_ISO, lambda m, g: to_date(g(m, 1), g(m, 2), g(m, 3))),
    (_DOTS, lambda m, g: to_date(g(m, 3), g(m, 2), g(m, 1))),
    (_SLASHES, _by_slash),
    (_DAY_MONTH, lambda m, g: to_date(g(m, 3), lookup(_STRICT, F.lower(g(m, 2))), g(m, 1))),
    (_MONTH_DAY, lambda m, g: to_date(g(m, 3), lookup(_STRICT, F.lower(g(m, 1))), g(m, 2))),
)


def _taken(text: Column) -> Column:
    """(dates, rest) of a text, after each pattern in turn; a pattern without a match costs its
    search only."""
    state = F.struct(F.array().cast("array<date>").alias("dates"), F.coalesce(clean(text), F.lit("")).alias("rest"))
    for pattern, read in _GRAMMAR:
        group = _group(pattern)

        def told(found: Column, s: Column) -> Column:
            marked = F.transform(found, lambda m: F.struct(m.alias("text"), read(m, group).alias("date")))  # noqa: B023

            def step(m: Column) -> Column:
                dates = F.filter(F.transform(m, lambda x: x["date"]), lambda d: d.isNotNull())
                blank = lambda x: F.when(x["date"].isNotNull(), F.repeat(F.lit(" "), F.length(x["text"]))).otherwise(x["text"])
                pieces = F.arrays_zip(F.split(s["rest"], pattern, -1).alias("gap"), m.alias("m"))  # noqa: B023
                rest = F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.coalesce(blank(p["m"]), F.lit("")))), "")
                return F.struct(F.concat(s["dates"], dates).alias("dates"), rest.alias("rest"))

            return F.when(F.size(found) == 0, s).otherwise(let(marked, step))

        taken = lambda s: let(F.regexp_extract_all(s["rest"], F.lit(pattern), F.lit(0)), lambda found: told(found, s))  # noqa: B023, E731
        state = let(state, lambda s: F.when(s["rest"].rlike(_HINTS[pattern]), taken(s)).otherwise(s))  # noqa: B023
    return state


def without_dates(text: Column) -> Column:
    """The cleaned text with valid dates blanked by spaces."""
    return _taken(text)["rest"]


def take_dates(df: DataFrame, text: str, dates: str = "dates", rest: str = "rest") -> DataFrame:
    """``df`` with the dates of its column ``text`` (an array, pattern by pattern) and ``rest``, the
    cleaned text with valid dates blanked by spaces. Impossible dates stay in the text."""
    taken = df.withColumn("__taken", _taken(F.col(text)))
    return taken.withColumns({dates: F.col("__taken.dates"), rest: F.col("__taken.rest")}).drop("__taken")


_WIDE = {m: i + 1 for names in (_PLAIN_PL, MONTHS_EN, MONTHS_DE, MONTHS_FR, MONTHS_NL) for i, m in enumerate(names)}
_SHORT = {m[:3]: i + 1 for i, m in enumerate(MONTHS_EN)} | {"sept": 9}
_MONTHS = _WIDE | _SHORT | {f"{m}.": i for m, i in _SHORT.items()}
_ORDINAL = r"\d{1,2}(?:er|st|nd|rd|th)?"
_DASH = r"\s?[-–]\s?"
#: Any word may stand for a month here: the table of names decides, so that no text is searched for
#: each of them. A name may be the end of a word in the second pattern only.
_WORD = r"\p{L}++\.?"
_FREE, _APART = r"(?<!\d)", r"(?<![\p{L}\d])"
#: Pattern, and the groups of day text, month text and year. At most one begins at any place.
_VERBAL = (
    (rf"{_APART}od ({_ORDINAL}) do \d{{1,2}} ({_WORD}) (\d{{4}})(?!\d)", 1, 2, 3),
    (rf"{_FREE}({_ORDINAL})\.? ({_WORD}) (\d{{4}})(?!\d)", 1, 2, 3),
    (rf"(?<!\p{{L}})({_WORD}) ({_ORDINAL}),? (\d{{4}})(?!\d)", 2, 1, 3),
    (rf"{_APART}({_WORD}) ({_ORDINAL}){_DASH}(?:\p{{L}}+\.? )?\d{{1,2}}(?:st|nd|rd|th)?,? (\d{{4}})(?!\d)", 2, 1, 3),
    (rf"{_APART}({_ORDINAL})\.?{_DASH}\d{{1,2}}\.? ({_WORD}) (\d{{4}})(?!\d)", 1, 2, 3),
    (rf"{_APART}({_ORDINAL})\.? ({_WORD}){_DASH}\d{{1,2}}\.? \p{{L}}+ (\d{{4}})(?!\d)", 1, 2, 3),
)
#: How every spelling with a month's name ends: texts without such an end are not searched for one.
_VERBAL_END = r"[\p{L}\d.,] \d{4}(?!\d)"
#: What stands at a place is captured without being consumed: spellings may overlap.
_VERBAL_HERE = f"(?=({'|'.join(p for p, *_ in _VERBAL)}))"
_NUMERIC_HERE = r"(?<!\d)(?=((?:\d{1,2}([./-])\d{1,2}\2(?:\d{4}|\d{2})|\d{4}([-.])\d{2}\3\d{2})(?!\d)))"


def _reading(year: Column, month: Column, day: Column) -> Column:
    return F.struct(year.cast("int").alias("year"), (F.length(year) == 2).alias("short"), month.cast("int").alias("month"), day.cast("int").alias("day"))


def _day_number(day: Column) -> Column:
    """The day of a day text, null where its ordinal ending is another day's."""
    number, ending = F.regexp_extract(day, r"^\d+", 0).cast("int"), F.regexp_extract(day, r"[a-z]*$", 0)
    fits = (ending == "") | (ending.isin("er", "st") & (number == 1)) | ((ending == "nd") & (number == 2)) | ((ending == "rd") & (number == 3)) | ((ending == "th") & (number > 3))
    return F.when(fits & ((ending == "") | ~day.startswith("0")), number)


def _numeric(m: Column) -> Column:
    """Readings of day, month and year, or year, month and day, with one sign between them. Padding
    is paired: both day and month have two digits, or neither has a leading zero; a bare spelling
    with a short year is one with points, or with slashes and the day first."""
    sign = F.regexp_extract(m, r"[./-]", 0)

    def read(parts: Column) -> Column:
        a, b, year = (parts.getItem(i) for i in range(3))
        padded = (F.length(a) == 2) & (F.length(b) == 2)
        bare = ~a.startswith("0") & ~b.startswith("0")
        whole = F.length(year) == 4
        first = F.when(padded | (bare & (whole | (sign != "-"))), _reading(year, b, a))
        second = F.when((sign == "/") & (padded | (bare & whole)), _reading(year, a, b))
        return F.when(F.length(a) == 4, F.array(_reading(a, b, year))).otherwise(F.array(first, second))

    return let(F.split(m, r"[./-]"), read)


def _verbal(m: Column) -> Column:
    """The reading of a spelling with a month's name, null where its word is none."""
    out = None
    for number, (pattern, day, month, year) in reversed(list(enumerate(_VERBAL))):
        pattern = "^" + pattern
        word = F.regexp_extract(m, pattern, month)
        ends = [F.right(word, F.lit(n)) for n in range(max(map(len, _MONTHS)), 2, -1)] if number == 2 else [word]  # the longest name that a word ends in
        name = F.coalesce(*(lookup(_MONTHS, end) for end in ends))
        reading = _reading(F.regexp_extract(m, pattern, year), name, _day_number(F.regexp_extract(m, pattern, day)))
        out = F.when(word != "", reading) if out is None else F.when(word != "", reading).otherwise(out)
    return out


def date_readings(folded: Column) -> Column:
    """Every date that a folded text can state, as structs (year, short, month, day). A short year
    has two digits and no century; an ambiguous spelling has two readings."""

    def read(text: Column) -> Column:
        here = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        numeric = F.flatten(F.transform(here(_NUMERIC_HERE), _numeric))
        spelled = F.transform(here(_VERBAL_HERE), _verbal)
        verbal = F.when(text.rlike(_VERBAL_END), spelled).otherwise(F.array().cast("array<struct<year:int,short:boolean,month:int,day:int>>"))
        return F.filter(F.concat(numeric, verbal), lambda r: r.isNotNull() & r["month"].between(1, 12) & r["day"].between(1, 31))

    return let(folded, read)
