"""Does a translation keep every number and date? Pairs are (doc_id, field, idx, source, target,
source_style, target_style)."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers as N
from ..functions.dates import take_dates
from ..functions.text import cents, let, rebuilt
from ..sources.shared import kept
from .mentions import spread

KEY = ("doc_id", "field", "idx")
# Numbers in the other notation than the style's.
_WRONG = {"point": (r"\d{1,3}(?: \d{3})*,\d{1,2}(?!\d)", "comma"), "comma": (r"\d{1,3}(?:,\d{3})+\.\d+", "point")}


def _by_style(style: Column, make, otherwise: Column) -> Column:
    return F.when(style == "point", make("point")).when(style == "comma", make("comma")).otherwise(otherwise)


def _wrong(rest: Column, style: Column) -> Column:
    """Tokens in the wrong notation, as structs of raw and cents."""
    make = lambda s: F.transform(F.regexp_extract_all(rest, F.lit(_WRONG[s][0]), F.lit(0)), lambda r: F.struct(r.alias("raw"), cents(N.value(r, _WRONG[s][1])).alias("cents")))
    return _by_style(style, make, F.array().cast("array<struct<raw:string,cents:bigint>>"))


def wrong_notation(pairs: DataFrame) -> DataFrame:
    """(doc_id, field, idx, raw) of numbers in targets that are written the other way."""
    read = take_dates(pairs, "target")
    return read.select(*KEY, F.explode(_wrong(F.col("rest"), F.col("target_style"))).alias("w")).select(*KEY, "w.raw")


def _values(dates: Column, numbers: Column) -> Column:
    return F.concat(F.transform(dates, lambda d: d.cast("string")), F.transform(numbers, lambda c: c.cast("string")))


def numeric_diff(pairs: DataFrame) -> DataFrame:
    """(doc_id, field, idx, value, missing, extra): how many times a value (a date, or cents) is
    missing from the target or extra in it. A number in the wrong notation counts with the value
    that its own notation gives."""
    either = lambda style: F.when(style == "unknown", "comma").otherwise(style)
    read = take_dates(take_dates(spread(pairs, *KEY), "source", "__said", "__source"), "target", "__put", "rest")
    read = read.withColumn("wrong", _wrong(F.col("rest"), F.col("target_style")))
    blank = lambda m: F.repeat(F.lit(" "), F.length(m))
    read = read.withColumn("rest", _by_style(F.col("target_style"), lambda s: rebuilt(F.col("rest"), _WRONG[s][0], blank), F.col("rest")))
    numbers = lambda rest, style: F.transform(N.read(F.col(rest), either(F.col(style)), False), lambda t: t["cents"])
    source = _values(F.col("__said"), numbers("__source", "source_style"))
    target = _values(F.col("__put"), F.concat(F.transform("wrong", lambda w: w["cents"]), numbers("rest", "target_style")))

    def counted(sides: Column) -> Column:
        """Values with 1 and -1 by their side; a pair whose sides hold the same has none to tell."""
        signed = lambda side, n: F.transform(sides[side], lambda v: F.struct(v.alias("value"), F.lit(n).alias("n")))
        both = F.concat(signed("source", 1), signed("target", -1))
        return F.when(F.array_sort(sides["source"]) != F.array_sort(sides["target"]), both)

    left = read.select(*KEY, F.explode(let(F.struct(source.alias("source"), target.alias("target")), counted)).alias("v")).groupBy(*KEY, "v.value").agg(F.sum("v.n").alias("n")).where("n <> 0")
    return left.select(*KEY, "value", F.greatest("n", F.lit(0)).alias("missing"), F.greatest(-F.col("n"), F.lit(0)).alias("extra"))


def structure_issues(source: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, field, n_source, n_target) where the number of texts of a field differs; both are
    (doc_id, field, idx, text)."""
    n = lambda df, name: df.groupBy("doc_id", "field").agg(F.count("*").alias(name))
    met = n(source, "n_source").join(n(target, "n_target"), ["doc_id", "field"], "full_outer").fillna(0, ["n_source", "n_target"])
    return met.where("n_source <> n_target")


def check_texts(source: DataFrame, target: DataFrame, styles: DataFrame) -> DataFrame:
    """(doc_id, field, idx, missing, extra, wrong_format), arrays joined by spaces, of documents whose
    structure is the same on both sides. ``styles`` (doc_id, source_style, target_style)."""
    bad = structure_issues(source, target).select("doc_id").distinct()
    pairs = source.withColumnRenamed("text", "source").join(target.withColumnRenamed("text", "target"), list(KEY)).join(styles, "doc_id").join(bad, "doc_id", "left_anti")
    pairs = kept(pairs)
    listed = lambda value, n: F.array_join(F.array_sort(F.flatten(F.collect_list(F.array_repeat(value, F.col(n).cast("int"))))), " ").alias(n)
    diff = numeric_diff(pairs).groupBy(*KEY).agg(listed(F.col("value"), "missing"), listed(F.col("value"), "extra"))
    wrong = wrong_notation(pairs).groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list("raw")), " ").alias("wrong_format"))
    return diff.join(wrong, list(KEY), "full_outer").fillna("", ["missing", "extra", "wrong_format"])


def check_pages(expected: DataFrame, returned: DataFrame, scans: DataFrame, styles: DataFrame) -> DataFrame:
    """(doc_id, page, issue) of a translated document: pages are not the expected ones, a blank
    target of a page with text, or values that differ. ``expected`` and ``returned`` are (doc_id,
    page, text); pages of ``scans`` without text are left out."""
    order = lambda df, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_list("page")).alias(name))
    lists = order(expected, "want").join(order(returned, "got"), "doc_id", "left")
    wrong = lists.where("got is null or want <> got").select("doc_id", F.lit(None).cast(expected.schema["page"].dataType).alias("page"), F.lit("pages").alias("issue"))
    met = expected.withColumnRenamed("text", "source").join(returned.withColumnRenamed("text", "target"), ["doc_id", "page"])
    met = met.join(scans.select("doc_id", "page").distinct().withColumn("scan", F.lit(True)), ["doc_id", "page"], "left").where("scan is null or trim(source) <> ''").drop("scan")
    blank = met.where("trim(source) <> '' and trim(target) = ''").select("doc_id", "page", F.lit("blank").alias("issue"))
    pairs = kept(met.where("trim(target) <> ''").join(styles, "doc_id").withColumnRenamed("page", "idx").withColumn("field", F.lit("page")))
    differ = numeric_diff(pairs).select("doc_id", F.col("idx").alias("page")).distinct().withColumn("issue", F.lit("values"))
    return wrong.unionByName(blank).unionByName(differ)


def translatable_fields(records: DataFrame) -> DataFrame:
    """(doc_id, field, idx, text) of all texts of ``records`` (doc_id, record) that a translation
    touches; numbers and names stay at home."""
    lists = {
        "title": F.array("record.document.title"), "summary": F.array("record.summary"), "keyPoints": F.col("record.keyPoints"),
        "amounts": F.transform("record.amounts", lambda a: a["context"]), "dates": F.transform("record.dates", lambda d: d["context"]),
        "keywords": F.col("record.keywords"), "warnings": F.col("record.warnings"),
    }
    parts = [F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda t, i: F.struct(F.lit(k).alias("field"), i.alias("idx"), t.alias("text"))) for k, v in lists.items()]  # noqa: B023
    return records.where("record is not null").select("doc_id", F.explode(F.concat(*parts)).alias("t")).select("doc_id", "t.*").where("text is not null")


def apply_translation(records: DataFrame, target: DataFrame, issues: DataFrame, to: str) -> DataFrame:
    """``records`` (doc_id, record) with ``translated`` records and their ``translation`` (from, to,
    numbers_verified, issues): each text is the ``target``'s (doc_id, field, idx, text) at its place;
    contexts without one keep the source's. Values, currencies and dates stay. ``issues`` are
    (doc_id, field, idx, missing, extra, wrong_format). A document whose other lists differ in length
    is left out, as is one without a target."""
    source = translatable_fields(records)
    free = "field not in ('amounts', 'dates')"
    bad = structure_issues(source.where(free), target.where(free)).select("doc_id").distinct()
    texts = target.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "field", F.col("idx").cast("string")), "text"))).alias("__texts"))
    fields = [F.col(c) for c in ("field", "idx", "missing", "extra", "wrong_format")]
    told = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__issues"))
    met = records.where("record is not null").join(bad, "doc_id", "left_anti").join(texts, "doc_id").join(told, "doc_id", "left")
    at = lambda field, i: F.try_element_at("__texts", F.concat(F.lit(f"{field}:"), i.cast("string")))
    listed = lambda field: F.transform(f"record.{field}", lambda t, i: F.coalesce(at(field, i), t))
    context = lambda field: F.transform(f"record.{field}", lambda x, i: x.withField("context", F.coalesce(at(field, i), x["context"])))
    title = F.col("record.document.title")
    record = F.col("record").withField("document.title", F.when(title.isNotNull(), F.coalesce(at("title", F.lit(0)), title))).withField("summary", F.coalesce(at("summary", F.lit(0)), F.col("record.summary")))
    for field in ("keyPoints", "keywords", "warnings"):
        record = record.withField(field, listed(field))
    for field in ("amounts", "dates"):
        record = record.withField(field, context(field))
    found = F.coalesce("__issues", F.array().cast(met.schema["__issues"].dataType))
    translation = F.struct(F.col("record.document.language").alias("from"), F.lit(to).alias("to"), (F.size(found) == 0).alias("numbers_verified"), found.alias("issues"))
    return met.select("doc_id", "record", record.alias("translated"), translation.alias("translation"))
