"""Verdicts on claims: equality joins of claims with evidence that is grouped first, so that a claim
keeps exactly one row."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N
from ..functions.dates import take_dates
from ..functions.dims import NAME_STOPWORDS
from ..functions.text import cents, search_form
from ..sources.shared import kept
from . import mentions as M
from .evidence import Evidence, short_key


def _support(ev: Evidence) -> DataFrame:
    """One row per (doc_id, cents): in which texts and with which currencies the value stands."""
    none = F.lit(None).cast("string")
    rows = ev.numbers.select("doc_id", "cents", F.lit(True).alias("clean"), F.lit(False).alias("injected"), none.alias("currency"), none.alias("injected_currency"))
    rows = rows.unionByName(ev.money.select("doc_id", "cents", F.lit(False).alias("clean"), F.lit(False).alias("injected"), "currency", none.alias("injected_currency")))
    rows = rows.unionByName(ev.injected_numbers.select("doc_id", "cents", F.lit(False).alias("clean"), F.lit(True).alias("injected"), none.alias("currency"), none.alias("injected_currency")))
    rows = rows.unionByName(ev.injected_money.select("doc_id", "cents", F.lit(False).alias("clean"), F.lit(False).alias("injected"), none.alias("currency"), F.col("currency").alias("injected_currency")))
    return rows.groupBy("doc_id", "cents").agg(F.max("clean").alias("clean"), F.max("injected").alias("injected"), F.collect_set("currency").alias("currencies"), F.collect_set("injected_currency").alias("injected_currencies"))


def check_amounts(claims: DataFrame, ev: Evidence) -> DataFrame:
    """``claims`` (doc_id, cents, currency, ...) with ``verdict``: fromInstruction, currencyMismatch,
    ok or notInText, the first that applies, and ``in_document``, the currencies that stand next to the
    value. Null cents are notInText."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    has = lambda c: F.coalesce(F.array_contains(F.col(c), F.col("currency")), F.lit(False))
    verdict = (
        F.when(has("injected_currencies") | (~flag("clean") & flag("injected")), "fromInstruction")
        .when((F.size(F.coalesce("currencies", F.array())) > 0) & ~has("currencies"), "currencyMismatch")
        .when(flag("clean"), "ok")
        .otherwise("notInText")
    )
    out = claims.join(_support(ev), ["doc_id", "cents"], "left").withColumn("verdict", verdict).withColumn("in_document", F.array_sort("currencies"))
    return out.drop("clean", "injected", "currencies", "injected_currencies")


def check_dates(claims: DataFrame, ev: Evidence) -> DataFrame:
    """``claims`` (doc_id, date, ...) with ``verdict``: ok, fromInstruction or notInText."""
    mark = lambda df, name: df.withColumn(name, F.lit(True))
    full = mark(M.full_dates(ev.dates), "full")
    short = mark(ev.dates.where("short").select("doc_id", F.col("year").alias("__year"), F.col("month").alias("__month"), F.col("day").alias("__day")), "in_short")
    injected = mark(ev.injected_dates, "injected")
    keyed = claims.select("*", *(c.alias(f"__{n}") for c, n in zip(short_key(F.col("date")), ("year", "month", "day"))))
    out = keyed.join(full, ["doc_id", "date"], "left").join(short, ["doc_id", "__year", "__month", "__day"], "left").join(injected, ["doc_id", "date"], "left")
    verdict = F.when(F.col("full") | F.coalesce("in_short", F.lit(False)), "ok").when(F.col("in_short"), "ok").when(F.col("injected"), "fromInstruction").otherwise("notInText")
    return out.withColumn("verdict", verdict).select(*claims.columns, "verdict")


def _document_labels(ev: Evidence) -> DataFrame:
    return ev.labels.groupBy("doc_id", "cents", "kind").agg(F.array_sort(F.collect_set("label")).alias("in_document"))


def _contradicted(said: DataFrame, ev: Evidence) -> DataFrame:
    """Rows of (doc_id, cents, kind, said: array) that say exactly one label and the document, next
    to that value, only others."""
    one = said.where(F.size("said") == 1).withColumn("said", F.element_at("said", 1))
    return one.join(_document_labels(ev), ["doc_id", "cents", "kind"]).where(~F.array_contains("in_document", F.col("said")))


def check_labels(claims: DataFrame, ev: Evidence) -> DataFrame:
    """One row per contradiction of ``claims`` (doc_id, idx, cents, context): doc_id, idx, cents,
    kind, said, in_document."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), N.labels_in(F.col("context"), k).alias("said")) for k in N.LABELS)))
    said = claims.select("doc_id", "idx", "cents", kinds.alias("k")).select("doc_id", "idx", "cents", "k.kind", "k.said")
    return _contradicted(said, ev).select("doc_id", "idx", "cents", "kind", "said", F.array_join("in_document", "/").alias("in_document"))


def priced(cents: Column, currency: Column) -> Column:
    """An amount in text, as in "12.50 EUR"."""
    return F.concat_ws(" ", F.format_string("%d.%02d", F.floor(cents / 100), cents % 100), currency)


def _found(verdict: Column, unverified: Column) -> Column:
    return F.when(verdict == "ok", True).when((verdict == "notInText") & unverified, F.lit(None).cast("boolean")).otherwise(False)


def ground_amounts(claims: DataFrame, ev: Evidence, unverified: DataFrame) -> DataFrame:
    """``claims`` (doc_id, idx, value, currency, context) with found_in_text (null: cannot be
    checked, a scan of a document of ``unverified`` (doc_id) may have it), issue and ``detail``: what the
    document says instead of another currency or label. Flags that claims bring along are replaced."""
    plain = claims.drop("found_in_text", "issue", "cents", "verdict", "detail", "in_document").withColumn("cents", cents(F.col("value")))
    told = F.concat(F.col("said"), F.lit(", document: "), F.col("in_document"))
    wrong = check_labels(plain, ev).groupBy("doc_id", "idx").agg(F.array_join(F.array_sort(F.collect_set(told)), "; ").alias("mislabelled"))
    scans = unverified.select("doc_id").distinct().withColumn("scans", F.lit(True))
    out = check_amounts(plain, ev).join(wrong, ["doc_id", "idx"], "left").join(scans, "doc_id", "left")
    found = _found(F.col("verdict"), F.coalesce("scans", F.lit(False)))
    issue = F.when(F.col("verdict") == "ok", F.when(F.col("mislabelled").isNotNull(), "labelMismatch")).when(F.col("found_in_text").isNotNull(), F.col("verdict"))
    detail = F.when(F.col("issue") == "labelMismatch", F.col("mislabelled")).when(F.col("issue") == "currencyMismatch", F.concat(F.lit("document: "), F.array_join("in_document", "/")))
    return out.withColumn("found_in_text", found).withColumn("issue", issue).withColumn("detail", detail).drop("verdict", "mislabelled", "scans", "in_document")


def ground_dates(claims: DataFrame, ev: Evidence, unverified: DataFrame) -> DataFrame:
    """As ground_amounts, for ``claims`` (doc_id, idx, date, context)."""
    scans = unverified.select("doc_id").distinct().withColumn("scans", F.lit(True))
    out = check_dates(claims.drop("found_in_text", "issue", "verdict"), ev).join(scans, "doc_id", "left")
    found = _found(F.col("verdict"), F.coalesce("scans", F.lit(False)))
    issue = F.when((F.col("verdict") != "ok") & F.col("found_in_text").isNotNull(), F.col("verdict"))
    return out.withColumn("found_in_text", found).withColumn("issue", issue).drop("verdict", "scans")


def read_texts(texts: DataFrame, styles: DataFrame) -> DataFrame:
    """``texts`` (doc_id, text_no, text) with dates, rest and style, written once for all that read them."""
    return kept(take_dates(texts, "text").join(styles, "doc_id"))


def _stated(read: DataFrame) -> DataFrame:
    """Money and dates of texts that were ``read``: doc_id, text_no, text, date, cents, currency."""
    money = M.money_mentions(read, "text_no", "text").withColumn("date", F.lit(None).cast("date"))
    dates = read.select("doc_id", "text_no", "text", F.explode("dates").alias("date"), F.lit(None).cast("long").alias("cents"), F.lit(None).cast("string").alias("currency"))
    return money.unionByName(dates)


def ground_texts(texts: DataFrame, ev: Evidence, unverified: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Distinct (doc_id, verdict, item) of amounts and dates that texts state and pages do not
    support; an item is "12.50 EUR" or a date. What a scan may have is left out. ``read``: the texts as
    read_texts has them, where they are read already."""
    stated = kept(_stated(read_texts(texts, ev.styles) if read is None else read))
    amounts = check_amounts(stated.where("currency is not null").select("doc_id", "cents", "currency").distinct(), ev)
    dates = check_dates(stated.where("date is not null").select("doc_id", "date").distinct(), ev)
    rows = amounts.select("doc_id", "verdict", priced(F.col("cents"), F.col("currency")).alias("item")).unionByName(dates.select("doc_id", "verdict", F.col("date").cast("string").alias("item")))
    hidden = unverified.select("doc_id").distinct().withColumn("verdict", F.lit("notInText"))
    return rows.where("verdict <> 'ok'").join(hidden, ["doc_id", "verdict"], "left_anti").distinct()


def ground_text_labels(texts: DataFrame, ev: Evidence, read: DataFrame | None = None) -> DataFrame:
    """Distinct (doc_id, cents, kind, said, in_document): labels next to numbers of texts that the
    document contradicts. ``read`` as in ground_texts."""
    read = read_texts(texts, ev.styles) if read is None else read
    said = M.label_mentions(read, "text_no").groupBy("doc_id", "text_no", "cents", "kind").agg(F.collect_set("label").alias("said"))
    return _contradicted(said, ev).select("doc_id", "cents", "kind", "said", F.array_join("in_document", "/").alias("in_document")).distinct()


def check_names(names: DataFrame, pages: DataFrame, text: str = "clean") -> DataFrame:
    """``names`` (doc_id, kind, idx, name) with ``supported``: every word of the name (three letters
    or more, no legal form) has a word in the document that is equal or differs in the ending only.

    Both words share their first three letters whenever they match. A document's wanted beginnings, packed
    into one row, meet its pages first, so that only words that begin so are taken out of a page; the
    rest is an equality join on the beginning. A name without such words is supported.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(search_form(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))
    asked = names.select("doc_id", "kind", "idx", F.explode(words(F.col("name"))).alias("word")).where(~F.col("word").isin(NAME_STOPWORDS))
    asked = asked.withColumn("head", F.left("word", F.lit(3)))
    wanted = asked.groupBy("doc_id").agg(F.collect_set("head").alias("heads"))
    begun = lambda w: F.array_contains("heads", F.left(w, F.lit(3)))
    there = pages.select("doc_id", F.col(text).alias("__text")).join(wanted, "doc_id")
    there = there.select("doc_id", F.explode(F.filter(words(F.col("__text")), begun)).alias("other")).withColumn("head", F.left("other", F.lit(3))).distinct()
    shared = F.greatest(F.lit(3), F.least(F.length("word"), F.length("other")) - 3)
    met = asked.join(there, ["doc_id", "head"]).where(F.left("word", shared) == F.left("other", shared))
    hits = met.select("doc_id", "kind", "idx", "word").distinct()
    missing = asked.join(hits, ["doc_id", "kind", "idx", "word"], "left_anti").select("doc_id", "kind", "idx").distinct().withColumn("missing", F.lit(True))
    return names.join(missing, ["doc_id", "kind", "idx"], "left").withColumn("supported", F.col("missing").isNull()).drop("missing")


def reconcile(texts: DataFrame, styles: DataFrame, amounts: DataFrame, dates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Amounts (doc_id, cents, currency, context) and dates (doc_id, date, context) that texts state
    and the lists lack, each once, with the clause of the first text that states it."""
    stated = kept(_stated(read_texts(texts, styles)))
    first = lambda *keys: F.row_number().over(Window.partitionBy("doc_id", *keys).orderBy("text_no"))
    have = amounts.select("doc_id", cents(F.col("value")).alias("cents"), "currency").distinct()
    money = stated.where("currency is not null").join(have, ["doc_id", "cents", "currency"], "left_anti").withColumn("n", first("cents", "currency")).where("n = 1")
    holds = lambda clause: F.exists(N.read(clause, F.col("style"), False), lambda t: (N.money_cents(t) == F.col("cents")) & (N.currency_of(t) == F.col("currency")))
    money = money.join(styles, "doc_id").select("doc_id", "cents", "currency", M.clause_with(F.col("text"), holds).alias("context"))
    days = stated.where("date is not null").join(dates.select("doc_id", "date").distinct(), ["doc_id", "date"], "left_anti").withColumn("n", first("date")).where("n = 1")
    # the clause is found among the dates of each clause of the text
    clauses = days.select("doc_id", "date", "text", F.posexplode(F.split("text", r"[;,]\s+")).alias("at", "clause"))
    read = take_dates(clauses, "clause").where(F.array_contains("dates", F.col("date"))).groupBy("doc_id", "date").agg(F.min_by("clause", "at").alias("clause"))
    days = days.join(read, ["doc_id", "date"], "left").select("doc_id", "date", M.clause_with(F.coalesce("clause", "text"), lambda _: F.lit(True)).alias("context"))
    return money, days
