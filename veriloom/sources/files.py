"""Files and records as sources and sinks."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.running import dealt, running
from .named import HEAD_BYTES, file_heads, packed_files, write_named
from .shared import kept

MOST_BYTES = 10 * 1024 * 1024


def read_pages(spark: SparkSession, path: str, doc_id: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Pages (doc_id, page, text) of a parquet table; pages that could not be read are empty."""
    return spark.read.parquet(path).select(F.col(doc_id).alias("doc_id"), F.col(page).alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def admit_files(files: DataFrame) -> DataFrame:
    """``files`` (path, mime, length, head: the first 1024 bytes) with ``code``, the first that applies:
    NOT_PDF (by neither its type nor its name), EMPTY, TOO_LARGE, BAD_SIGNATURE (no %PDF- in the head),
    OK."""
    head = F.decode(F.substring("head", 1, HEAD_BYTES), "ISO-8859-1")
    code = (
        F.when((F.coalesce("mime", F.lit("")) != "application/pdf") & ~F.lower(F.coalesce("path", F.lit(""))).endswith(".pdf"), "NOT_PDF")
        .when(F.col("length") == 0, "EMPTY")
        .when(F.col("length") > MOST_BYTES, "TOO_LARGE")
        .when(F.instr(head, "%PDF-") == 0, "BAD_SIGNATURE")
        .otherwise("OK")
    )
    return files.withColumn("code", code)


def read_truth(texts: DataFrame) -> DataFrame:
    """(name, issuer, amount, amount_untaxed, date, invoice_number, currency) of ``texts`` (name, text):
    JSON arrays whose first element is the record. A field of the wrong type or a blank one is null,
    and a missing issuer is the name; a text that is no JSON has nulls."""
    parsed = texts.withColumn("__v", F.expr("try_parse_json(text)"))

    def field(name: str, kind: str) -> Column:
        at = f"try_variant_get(__v, '$[0].{name}', 'variant')"
        fits = F.expr(f"schema_of_variant({at})").rlike("^(DECIMAL|BIGINT|DOUBLE|FLOAT)" if kind == "double" else "^STRING$")
        value = F.expr(f"try_variant_get(__v, '$[0].{name}', '{kind}')")
        return F.when(fits & (value if kind == "double" else F.trim(value)).isNotNull(), value if kind == "double" else F.when(F.trim(value) != "", value)).alias(name)

    texts_of = [field(n, "string") for n in ("issuer", "date", "invoice_number", "currency")]
    out = parsed.select("name", *texts_of, field("amount", "double"), field("amount_untaxed", "double"))
    return out.withColumn("issuer", F.coalesce("issuer", "name"))


def read_truth_files(spark: SparkSession, folder: str) -> DataFrame:
    """read_truth of a folder's files; a file's name without .json is the record's."""
    texts = spark.read.text(folder, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("name"), F.col("value").alias("text"))
    return read_truth(texts)


def file_base(name):
    """A file's name without .pdf, with _ for what is no letter, digit, point, _ or -."""
    base = F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), r"[^\p{L}\p{N}._-]+", "_")
    return F.when(base == "", "document").otherwise(base)


def record_name(name, language=None):
    ending = ".insight.json" if language is None else f".insight.{language}.json"
    return F.concat(file_base(name), F.lit(ending))


def told_apart(records: DataFrame, name: str = "name", order: str = "doc_id") -> DataFrame:
    """``records`` with names that differ: of equal ones the second is ``a-2.insight.json`` and so on, in
    ``order``. Numbers are running counts, so a name that very many records share is many tasks' work. They
    are found on names alone; what the names stand for is moved once, to meet them."""
    rows = kept(records.withColumn("__row", F.monotonically_increasing_id()))
    counted = running(dealt(rows.select("__row", name, order), [name], [order]), [name], [order], {"__nth": F.lit(1)})
    other = F.regexp_replace(name, r"((?:\.(?:insight|summary))?(?:\.[a-z]{2})?\.(?:json|md))$", F.concat(F.lit("-"), (F.col("__nth") + 1).cast("string"), F.lit("$1")))
    named = counted.select("__row", F.when(F.col("__nth") == 0, F.col(name)).otherwise(other).alias(name))
    return rows.drop(name).join(named.hint("merge"), "__row").select(*records.columns)


def write_records(records: DataFrame, path: str, packed: bool = False) -> None:
    """Verified ``records`` (doc_id, name, record: struct) as files of a folder, each under its ``name``,
    with JSON of the record; all or none of them. A file by itself takes a block of disk, often 4 KB: of
    very many records the files are better ``packed`` in tar volumes, where they are as long as they are."""
    named = told_apart(records.select("doc_id", "name", F.to_json("record").alias("json")))
    write_named(named.select("name", F.col("json").cast("binary").alias("content")), path, packed)


def read_records_files(spark: SparkSession, path: str, schema: str, packed: bool = False) -> DataFrame:
    """(name, record) of the files of a folder of write_records."""
    # Spark's own readers pass over names that begin with _
    whole = packed_files(spark, path) if packed else file_heads(spark, path, n_bytes=0).select(F.substring_index("path", "/", -1).alias("name"), F.col("head").alias("content"))
    return whole.select("name", F.from_json(F.col("content").cast("string"), schema).alias("record"))


def report_name(name: Column, language: Column | None = None) -> Column:
    """The file of a report on the file ``name``; with a language, of its translation."""
    return F.concat(file_base(name), F.lit(".summary.md") if language is None else F.concat(F.lit("."), language, F.lit(".md")))


def write_reports(reports: DataFrame, path: str) -> None:
    """``reports`` (doc_id, name, report) as files of a folder, each under its ``name``; all or none."""
    named = told_apart(reports.select("doc_id", "name", "report"))
    write_named(named.select("name", F.col("report").cast("binary").alias("content")), path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(name, report) of the files of a folder of write_reports."""
    return file_heads(spark, path, n_bytes=0).select(F.substring_index("path", "/", -1).alias("name"), F.col("head").cast("string").alias("report"))
