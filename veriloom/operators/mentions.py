"""What pages state: dates, numbers, money, labels, instructions. One pass over pages each.

Pages are (doc_id, page, text). Everything here works on one page at a time with built-in
expressions, so nothing is shuffled but the final distinct or sum per document.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers as N
from ..functions.dates import date_readings, take_dates, to_date, without_dates
from ..functions.dims import ABBREVIATIONS, INSTRUCTION_PHRASES
from ..functions.text import fold, search_form, strip

# A number that a line break has split.
_REJOIN = r"(\d)[ \t]*\n[ \t]*(\d{3}(?:[,.]\d+)?)(?!\d)"


def spread(pages: DataFrame, *keys: str) -> DataFrame:
    """``pages`` dealt over as many tasks as shuffles have: mining a text costs far more than its bytes say,
    so few bytes are no reason for few tasks. By default by document and page, so that a document of
    very many pages is many tasks' work."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.repartition(n, *(keys or ("doc_id", "page")))


#: Of these beginnings every instruction phrase has one: texts without any are not searched for phrases.
_INSTRUCTION_HINT = "(?i)ignor|instru|disregard|note|you|system"


def has_instruction(folded: Column) -> Column:
    return folded.rlike(_INSTRUCTION_HINT) & folded.rlike(f"(?i)(?:{'|'.join(f'(?:{phrase})' for phrase in INSTRUCTION_PHRASES)})")


def injection_findings(pages: DataFrame) -> DataFrame:
    """Pages with a phrase that addresses a language system: the first phrase in list order, with 20
    characters before it and 40 after."""
    folded = pages.select("doc_id", "page", fold(F.col("text")).alias("folded")).where(has_instruction(F.col("folded")))
    found = F.lit(None).cast("string")
    for phrase in reversed(INSTRUCTION_PHRASES):
        match = F.regexp_extract("folded", f"(?i){phrase}", 0)
        found = F.when(match != "", match).otherwise(found)
    at = F.instr("folded", F.col("found"))
    begin = F.greatest(at - 20, F.lit(1))
    excerpt = F.trim(F.substr("folded", begin, at + F.length("found") + 40 - begin))
    return folded.withColumn("found", found).select("doc_id", "page", excerpt.alias("excerpt"))


def split_injected_lines(pages: DataFrame, instructed: str | None = None) -> DataFrame:
    """``pages`` with ``clean`` and ``injected``: lines that match a phrase by themselves, or joined
    with a neighbour where neither does alone, are injected. A column ``instructed`` tells the pages that
    injection_findings returns.

    The whole page is tested first, and lines are taken apart only where it matches.
    """
    lines, text = F.col("__lines"), F.coalesce(F.col("text"), F.lit(""))
    hit = lambda i: F.element_at("__hits", i)
    size = F.size("__lines")
    folded = lambda i: F.element_at("__folded", i)
    pair = lambda i: (i >= 1) & (i < size) & ~hit(F.greatest(i, F.lit(1))) & ~hit(F.least(i + 1, size)) & has_instruction(F.concat_ws(" ", folded(F.greatest(i, F.lit(1))), folded(F.least(i + 1, size))))
    flags = F.transform("__lines", lambda _, i: hit(i + 1) | pair(i + 1) | pair(i))
    picked = lambda wanted: F.array_join(F.filter(lines, lambda _, i: F.element_at("__flags", i + 1) == wanted), "\n")
    out = pages.withColumn("__any", has_instruction(fold(text)))
    out = out.withColumn("__lines", F.when(F.col("__any"), F.split(text, "\n", -1)))
    out = out.withColumn("__folded", F.transform("__lines", fold)).withColumn("__hits", F.transform("__folded", has_instruction)).withColumn("__flags", flags)
    out = out.withColumn("clean", F.when(F.col("__any"), picked(F.lit(False))).otherwise(text)).withColumn("injected", F.when(F.col("__any"), picked(F.lit(True))).otherwise(""))
    told = out.withColumn(instructed, F.col("__any")) if instructed else out
    return told.drop("__any", "__lines", "__folded", "__hits", "__flags")


def date_mentions(pages: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, page, date) for every date of the strict grammar."""
    return take_dates(pages, text).select("doc_id", "page", F.explode("dates").alias("date"))


def undated(pages: DataFrame, text: str = "text", rejoin: bool = True) -> DataFrame:
    """(doc_id, page, rest, joined): the text without its dates, and the same of the text in which
    numbers that a line break has split are rejoined, null where there are none."""
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = F.array(whole)
    if rejoin:
        texts = F.when(whole.rlike(_REJOIN), F.array(whole, F.regexp_replace(whole, _REJOIN, "$1 $2"))).otherwise(texts)
    rests = pages.select("doc_id", "page", F.transform(texts, without_dates).alias("rests"))
    return rests.select("doc_id", "page", F.get("rests", F.lit(0)).alias("rest"), F.get("rests", F.lit(1)).alias("joined"))


def styles_of(rests: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, style) of every document of ``docs`` (doc_id, language): as its pages write numbers
    in ``rests`` (doc_id, rest), else as its language does."""
    comma, point = N.style_scores(F.col("rest"))
    scores = rests.select("doc_id", comma.alias("comma"), point.alias("point")).groupBy("doc_id").agg(F.sum("comma").alias("comma"), F.sum("point").alias("point"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return docs.join(scores, "doc_id", "left").select("doc_id", N.style_of(zero("comma"), zero("point"), F.col("language")).alias("style"))


def decimal_styles(pages: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    return styles_of(undated(pages, text, rejoin=False), docs)


def readable_of(rests: DataFrame, styles: DataFrame) -> DataFrame:
    """Texts ready for number reading, of undated pages: (doc_id, page, rest, style)."""
    both = F.filter(F.array("rest", "joined"), lambda x: x.isNotNull())
    return rests.select("doc_id", "page", F.explode(both).alias("rest")).join(styles, "doc_id")


def readable(pages: DataFrame, styles: DataFrame, text: str = "text", rejoin: bool = True) -> DataFrame:
    return readable_of(undated(pages, text, rejoin), styles)


def tokens_of(read: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, *keep, style, t) of each number token; an unknown style has both readings."""
    return read.select("doc_id", *keep, "style", F.explode(N.read(F.col("rest"), F.col("style"), True)).alias("t"))


#: Readings of tokens next to words: an unknown style counts as the comma's.
_ONE_READING = "style <> 'unknown' or t.reading = 'comma'"


def number_mentions(read: DataFrame) -> DataFrame:
    """(doc_id, page, seq, raw, cents, before, after) of each number token; an unknown style has
    both readings."""
    tokens = read.select("doc_id", "page", F.posexplode(N.read(F.col("rest"), F.col("style"), True)).alias("seq", "t"))
    return tokens.select("doc_id", "page", "seq", "t.raw", "t.cents", "t.before", "t.after")


def numbers_of(tokens: DataFrame, read: DataFrame) -> DataFrame:
    """Distinct (doc_id, cents): tokens, multiplied tokens, ends of spaced tokens, grouped numbers."""
    t = F.col("t")
    spaced = F.when(F.col("t.raw").rlike(r"\s"), N.tails(t, F.col("style"))).otherwise(F.array().cast("array<bigint>"))
    told = tokens.select("doc_id", F.explode(F.concat(F.array(t["cents"], N.multiplied(t)), spaced)).alias("cents"))
    grouped = read.select("doc_id", F.explode(N.grouped(F.col("rest"))).alias("cents"))
    return told.unionByName(grouped).where("cents is not null").distinct()


def number_evidence(read: DataFrame) -> DataFrame:
    return numbers_of(tokens_of(read), read)


def money_of(tokens: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, *keep, cents, currency) of each number with a currency next to it."""
    priced = F.filter(F.array(N.currency_of(F.col("t"))), lambda x: x.isNotNull())  # exploded: a filter would read the currency twice
    found = tokens.where(_ONE_READING).select("doc_id", *keep, "t", F.explode(priced).alias("currency"))
    return found.select("doc_id", *keep, N.money_cents(F.col("t")).alias("cents"), "currency")


def money_mentions(read: DataFrame, *keep: str) -> DataFrame:
    return money_of(tokens_of(read, *keep), *keep)


def labels_of(tokens: DataFrame, *keep: str) -> DataFrame:
    """Distinct (doc_id, *keep, cents, kind, label) of words next to numbers."""
    pairs = F.concat(*(F.transform(N.labels_of(F.col("t"), kind), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label"))) for kind in N.LABELS))  # noqa: B023
    told = tokens.where(_ONE_READING).select("doc_id", *keep, F.col("t.cents").alias("cents"), F.explode(pairs).alias("p"))
    return told.select("doc_id", *keep, "cents", "p.kind", "p.label").distinct()


def label_mentions(read: DataFrame, *keep: str) -> DataFrame:
    return labels_of(tokens_of(read, *keep), *keep)


def date_evidence(pages: DataFrame, text: str = "text") -> DataFrame:
    """Distinct readings (doc_id, year, short, month, day) of the wide grammar. Texts are scanned
    once; a claim then needs an equality join instead of a search for its spellings."""
    return pages.select("doc_id", F.explode(date_readings(search_form(F.col(text)))).alias("r")).select("doc_id", "r.*").distinct()


def full_dates(readings: DataFrame) -> DataFrame:
    """(doc_id, date) of the readings with a whole year that are real dates."""
    return readings.where("not short").select("doc_id", to_date(F.col("year"), F.col("month"), F.col("day")).alias("date")).where("date is not null").distinct()


def clause_with(text: Column, has) -> Column:
    """The first clause of a text for which ``has(clause)`` holds, else the text; without closing
    marks and cut at a word after 100 characters."""
    clause = F.coalesce(F.try_element_at(F.filter(F.split(text, r"[;,]\s+"), has), F.lit(1)), text)
    whole = F.regexp_replace(strip(clause), r"[.;,]+$", "")
    return F.when(F.length(whole) <= 100, whole).otherwise(F.concat(F.regexp_replace(F.left(whole, F.lit(100)), r"\s+\S*$", ""), F.lit("…")))


# Where a sentence ends.
_BOUNDARY = r"""[.!?…]+["'”»)]*\s+(?=["'„«(]?\p{Lu})"""


def sentence_count(text: Column) -> Column:
    """Sentences of a text: closing marks before white space and a capital, but not the point of an
    initial or an abbreviation; 0 for blank."""
    whole = strip(F.coalesce(text, F.lit("")))
    parts = F.split(whole, _BOUNDARY, -1)
    marks = F.regexp_extract_all(whole, F.lit(_BOUNDARY), F.lit(0))
    last = lambda part: F.regexp_replace(F.regexp_extract(part, r"\S*$", 0), r"""^[("„«']+""", "")
    held = lambda word: word.rlike(r"^\p{Lu}$") | F.lower(word).isin(ABBREVIATIONS)
    ends = F.filter(F.arrays_zip(F.slice(parts, 1, F.size(marks)).alias("part"), marks.alias("mark")), lambda p: ~(p["mark"].startswith(".") & held(last(p["part"]))))
    return F.when(whole == "", 0).otherwise(F.size(ends) + 1)
