"""Records of extractors: parsing, repair, constraints and quarantine."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dims import CURRENCIES, CURRENCY_ALIASES, DOCUMENT_TYPES, TYPE_ALIASES
from ..functions.text import let, lookup, strip
from .mentions import sentence_count

#: What an answer may hold, before repair: texts where a repair may be needed.
ANSWER = (
    "document struct<fileName:string,pages:int,language:string,type:string,title:string,date:string>, summary string, keyPoints array<string>, "
    "entities struct<organizations:array<string>,people:array<string>>, amounts array<struct<value:string,currency:string,context:string>>, "
    "dates array<struct<date:string,context:string>>, keywords array<string>, warnings array<string>"
)


def parse_answers(answers: DataFrame) -> DataFrame:
    """``answers`` (doc_id, raw) with ``record``, null where the text has no JSON object: a code fence
    is taken off, else what stands from the first { to the last }. The object is exploded, so that it is
    parsed once a text, whatever later reads or filters name of the record."""

    def body(bare: Column) -> Column:
        first, last = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
        return F.when((first > 0) & F.contains(bare, F.lit("}")) & (last > first), F.substr(bare, first, last - first + 1))

    def record(parsed: Column) -> Column:
        return F.when(parsed.isNotNull() & parsed["broken"].isNull(), F.struct(*(parsed[n].alias(n) for n in names)))

    bare = F.regexp_replace(strip(F.col("raw")), r"^```[A-Za-z]*\s*|\s*```$", "")
    found = answers.select("*", F.explode(F.array(let(bare, body))).alias("__body"))
    parsed = F.from_json("__body", f"{ANSWER}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    names = [f.name for f in found.select(parsed.alias("p")).schema["p"].dataType.fields if f.name != "broken"]
    return found.select(*answers.columns, F.explode(F.array(let(parsed, record))).alias("record"))


# A language tag, a timestamp and the numeric texts of one reading.
def _language(value: Column) -> Column:
    tag = F.regexp_extract(strip(value), r"(?i)^([a-z]{2})(?:[-_][a-z0-9]+)*$", 1)
    return F.when(tag != "", F.lower(tag)).otherwise(strip(value))


def _date(value: Column) -> Column:
    stamp = strip(value).rlike(r"^\d{4}-\d{2}-\d{2}T[\d:.]+(?:Z|[+-]\d{2}:?\d{2})?$")
    return F.when(stamp, F.left(strip(value), F.lit(10))).otherwise(strip(value))


def unambiguous_number(value: Column) -> Column:
    """Value of a numeric text that can be read in one way only, else null."""
    bare = F.regexp_replace(value, r"[\s ]", "")
    plain = F.when(bare.rlike(r"^-?\d+(\.\d+)?$"), bare).when(bare.rlike(r"^-?\d+,\d{1,2}$"), F.replace(bare, F.lit(","), F.lit(".")))
    return plain.cast("double")


def normalize_records(records: DataFrame) -> DataFrame:
    """``records`` (doc_id, record) repaired in format, never in content: language tags, timestamps,
    type and currency names, numeric texts of one reading, blank titles, missing lists; at most 7
    key points and 15 keywords."""
    doc = lambda f: F.col(f"record.document.{f}")
    blank = lambda c: F.when(strip(c) != "", c)
    kind = F.lower(strip(doc("type")))
    aliases = {k.upper(): v for k, v in CURRENCY_ALIASES.items()}
    currency = lambda c: F.coalesce(lookup(aliases, F.upper(strip(c))), F.upper(strip(c)))
    listed = lambda f, kind: F.coalesce(F.col(f"record.{f}"), F.array().cast(kind))
    repaired = F.struct(
        F.struct(
            doc("fileName").alias("fileName"), doc("pages").alias("pages"), _language(doc("language")).alias("language"),
            F.coalesce(lookup(TYPE_ALIASES, kind), kind).alias("type"), blank(doc("title")).alias("title"), _date(blank(doc("date"))).alias("date"),
        ).alias("document"),
        F.col("record.summary").alias("summary"),
        F.slice(listed("keyPoints", "array<string>"), 1, 7).alias("keyPoints"),
        F.struct(listed("entities.organizations", "array<string>").alias("organizations"), listed("entities.people", "array<string>").alias("people")).alias("entities"),
        F.transform(listed("amounts", "array<struct<value:string,currency:string,context:string>>"), lambda a: F.struct(unambiguous_number(a["value"]).alias("value"), currency(a["currency"]).alias("currency"), a["context"].alias("context"))).alias("amounts"),
        F.transform(listed("dates", "array<struct<date:string,context:string>>"), lambda d: F.struct(_date(d["date"]).alias("date"), d["context"].alias("context"))).alias("dates"),
        F.slice(listed("keywords", "array<string>"), 1, 15).alias("keywords"),
        listed("warnings", "array<string>").alias("warnings"),
    )
    return records.withColumn("record", F.when(F.col("record").isNotNull(), repaired))


Check = Callable[[DataFrame], DataFrame]


def _violations(rows: DataFrame, rules: Sequence[tuple[Column, str, Column]]) -> DataFrame:
    """(doc_id, path, rule) for each (path, rule, ok) that does not hold; null does not hold."""
    told = F.filter(F.array(*(F.struct(p.alias("path"), F.lit(r).alias("rule"), F.coalesce(ok, F.lit(False)).alias("ok")) for p, r, ok in rules)), lambda x: ~x["ok"])
    return rows.select("doc_id", F.explode(told).alias("v")).select("doc_id", "v.path", "v.rule")


def real_date(value: Column) -> Column:
    return value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()


def _listed(records: DataFrame, field: str, path: str) -> DataFrame:
    """Blank or missing texts of a list of a record, each with its place."""
    rows = records.select("doc_id", F.posexplode(f"record.{field}").alias("i", "x"))
    return _violations(rows, [(F.format_string(f"{path}.%d", F.col("i")), "blank", strip(F.col("x")) != "")])


#: What each profile asks for: whole records, a model's answer (no file, no pages), the part of a long
#: document (also no number of sentences or least number of key points), the merge of parts (no lists).
PROFILES = {"whole": {"file", "lists", "sentences"}, "answer": {"lists", "sentences"}, "part": {"lists"}, "merge": {"sentences"}}


def validate_records(records: DataFrame, profile: str = "whole", checks: Sequence[Check] = ()) -> DataFrame:
    """(doc_id, path, rule) of what breaks a rule in ``records`` (doc_id, record), by one of the
    PROFILES; ``checks`` add rules of their own. A record that could not be parsed breaks "json"."""
    asked = PROFILES[profile]
    d = lambda f: F.col(f"record.document.{f}")
    filled = lambda c: strip(c) != ""
    n = F.size("record.keyPoints")
    rules = [
        (F.lit("document.language"), "language", d("language").rlike("^[a-z]{2}$")),
        (F.lit("document.type"), "type", d("type").isin(*DOCUMENT_TYPES)),
        (F.lit("document.title"), "blank", d("title").isNull() | filled(d("title"))),
        (F.lit("document.date"), "date", d("date").isNull() | real_date(d("date"))),
        (F.lit("summary"), "blank", filled(F.col("record.summary"))),
        (F.lit("keyPoints"), "count", (n <= 7) if profile == "part" else n.between(3, 7)),
    ]
    if "file" in asked:
        rules += [(F.lit("document.fileName"), "blank", filled(d("fileName"))), (F.lit("document.pages"), "pages", d("pages") >= 1)]
    if "sentences" in asked:
        rules.append((F.lit("summary"), "sentences", sentence_count(F.col("record.summary")).between(3, 5)))
    out = _violations(records.where("record is not null"), rules)
    out = out.unionByName(records.where("record is null").select("doc_id", F.lit("").alias("path"), F.lit("json").alias("rule")))
    out = out.unionByName(_listed(records, "keyPoints", "keyPoints"))
    if "lists" in asked:
        amounts = records.select("doc_id", F.posexplode("record.amounts").alias("i", "a"))
        at = lambda kind, field: F.format_string(f"{kind}.%d.{field}", F.col("i"))
        worth = [(at("amounts", "value"), "number", F.col("a.value").isNotNull()), (at("amounts", "currency"), "currency", F.col("a.currency").isin(*CURRENCIES)), (at("amounts", "context"), "blank", filled(F.col("a.context")))]
        dates = records.select("doc_id", F.posexplode("record.dates").alias("i", "d"))
        days = [(at("dates", "date"), "date", real_date(F.col("d.date"))), (at("dates", "context"), "blank", filled(F.col("d.context")))]
        out = out.unionByName(_violations(amounts, worth)).unionByName(_violations(dates, days))
        for field, path in (("entities.organizations", "entities.organizations"), ("entities.people", "entities.people"), ("keywords", "keywords")):
            out = out.unionByName(_listed(records, field, path))
    for check in checks:
        out = out.unionByName(check(records).select("doc_id", "path", "rule"))
    return out


def quarantine(records: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and the rejected ones with their reasons. Both sides are as many as the records, and the
    ids alone of a stored table pass for few bytes: merged, so that they never go through the driver."""
    reasons = violations.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "path", "rule"))), ", ").alias("reasons")).hint("merge")
    return records.join(reasons, "doc_id", "left_anti"), records.join(reasons, "doc_id")


def _report(rows: DataFrame, path: Column, rule: str) -> DataFrame:
    return rows.select("doc_id", path.cast("string").alias("path"), F.lit(rule).alias("rule"))


def validate_requests(docs: DataFrame, pages: DataFrame, images: DataFrame, unread: DataFrame, max_chars: int = 400_000, max_images: int = 4, max_name: int = 255) -> DataFrame:
    """(doc_id, path, rule) of requests: ``docs`` (doc_id, file_name, page_count), ``pages`` (doc_id,
    page, text), ``images`` (doc_id, page, mime), ``unread`` (doc_id, page): pages that could not be
    read."""
    counted = docs.select("doc_id", "page_count")
    name = F.length(strip(F.coalesce("file_name", F.lit(""))))
    out = _report(docs.where(~name.between(1, max_name)), F.lit("fileName"), "length")
    out = out.unionByName(_report(counted.where("page_count is null or not page_count between 1 and 2000"), F.lit("pageCount"), "range"))
    out = out.unionByName(_report(counted.join(pages.select("doc_id").distinct(), "doc_id", "left_anti"), F.lit("pages"), "none"))
    beyond = lambda df: df.join(counted, "doc_id").where("page > page_count or page < 1")
    out = out.unionByName(_report(beyond(pages), F.col("page"), "page out of range")).unionByName(_report(beyond(unread), F.concat(F.lit("unread "), F.col("page").cast("string")), "page out of range"))
    twice = lambda df: df.groupBy("doc_id", "page").count().where("count > 1")
    out = out.unionByName(_report(twice(pages), F.col("page"), "page repeated")).unionByName(_report(twice(images), F.col("page"), "image repeated"))
    out = out.unionByName(_report(images.join(pages.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti"), F.col("page"), "image without page"))
    out = out.unionByName(_report(images.where("mime <> 'image/jpeg' or mime is null"), F.col("page"), "image type"))
    out = out.unionByName(_report(pages.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).where(F.col("n") > max_chars), F.lit("pages"), "too long"))
    return out.unionByName(_report(images.groupBy("doc_id").count().where(F.col("count") > max_images), F.lit("images"), "too many")).distinct()


def validate_translation_requests(chunks: DataFrame, images: DataFrame, translated: DataFrame, max_chars: int = 12_000, max_pages: int = 60) -> DataFrame:
    """(doc_id, path, rule) of translation requests: ``chunks`` (doc_id, chunk_no, page, text),
    ``images`` (doc_id, chunk_no, page), ``translated`` (doc_id) records."""
    by_chunk = chunks.groupBy("doc_id", "chunk_no").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"), F.sum(F.length("text")).alias("chars"))
    out = _report(by_chunk.where("n > pages"), F.col("chunk_no"), "page repeated").unionByName(_report(by_chunk.where(F.col("chars") > max_chars), F.col("chunk_no"), "too long"))
    out = out.unionByName(_report(by_chunk.where(F.col("n") > max_pages), F.col("chunk_no"), "too many pages"))
    outside = images.join(chunks.select("doc_id", "chunk_no", "page"), ["doc_id", "chunk_no", "page"], "left_anti")
    out = out.unionByName(_report(outside, F.col("page"), "image outside chunk"))
    return out.unionByName(_report(chunks.select("doc_id").distinct().join(translated, "doc_id", "left_semi"), F.lit("document"), "already translated"))
