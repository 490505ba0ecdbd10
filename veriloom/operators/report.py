"""Locale output and Markdown reports as string columns."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dims import MONTHS_EN, MONTHS_PL

# Labels of the report, by language.
MESSAGES = {
    "pl": {"title": "Podsumowanie: ", "source": "Plik", "type": "Typ", "date": "Data", "language": "Język", "pages": "Strony", "translated": "Tłumaczenie maszynowe z języka ", "notGiven": "nie podano",
           "summary": "Podsumowanie", "keyPoints": "Najważniejsze punkty", "amounts": "Kwoty", "amount": "Kwota", "concerns": "Dotyczy", "dates": "Daty", "organizations": "Organizacje", "people": "Osoby", "keywords": "Słowa kluczowe", "warnings": "Ostrzeżenia", "none": "Brak.",
           "notInText": "nie znaleziono w tekście", "currencyMismatch": "inna waluta w dokumencie", "fromInstruction": "tylko w podejrzanym poleceniu", "labelMismatch": "inny opis w dokumencie",
           "faktura": "faktura", "umowa": "umowa", "oferta": "oferta", "raport": "raport", "inne": "inne"},
    "en": {"title": "Summary: ", "source": "File", "type": "Type", "date": "Date", "language": "Language", "pages": "Pages", "translated": "Machine translation from ", "notGiven": "not given",
           "summary": "Summary", "keyPoints": "Key points", "amounts": "Amounts", "amount": "Amount", "concerns": "Concerns", "dates": "Dates", "organizations": "Organizations", "people": "People", "keywords": "Keywords", "warnings": "Warnings", "none": "None.",
           "notInText": "not found in the text", "currencyMismatch": "other currency in the document", "fromInstruction": "only in a suspicious instruction", "labelMismatch": "other label in the document",
           "faktura": "invoice", "umowa": "contract", "oferta": "offer", "raport": "report", "inne": "other"},
}


def format_number(value: Column, language: str) -> Column:
    text = F.format_number(value, 2)
    return F.translate(text, ",.", " ,") if language == "pl" else text


def format_money(value: Column, currency: Column, language: str) -> Column:
    if language == "pl":
        return F.concat_ws(" ", format_number(value, language), F.when(currency == "PLN", "zł").otherwise(currency))
    return F.concat_ws(" ", currency, format_number(value, language))


def format_date(date: Column, language: str) -> Column:
    names = MONTHS_PL if language == "pl" else [m.capitalize() for m in MONTHS_EN]
    return F.concat_ws(" ", F.dayofmonth(date).cast("string"), F.element_at(F.array(*map(F.lit, names)), F.month(date)), F.year(date).cast("string"))


def escape(text: Column) -> Column:
    """Text in which nothing is Markdown: a document cannot put links or images into a report."""
    marked = F.regexp_replace(text, r"([\\`*_{}\[\]<>()#+!|~])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(marked, r"(?m)^(\s*)(\d+)\.(\s)", r"$1$2\\.$3"), r"(?m)^(\s*)-(\s)", r"$1\\-$2")


def escape_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), escape), "  \n")


def _section(title: Column, lines: Column, empty: str) -> Column:
    """A heading with its lines, or with what stands for none."""
    body = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(empty)
    return F.concat(F.lit("## "), title, F.lit("\n\n"), body)


def summary_report(results: DataFrame, language: str = "en") -> DataFrame:
    """(doc_id, report) of ``results`` (doc_id, file_name, title, type, document_language, pages, date,
    translated_from, summary, key_points, amounts: array of (value, currency, context, found_in_text,
    issue), dates: array of (date, context, found_in_text, issue), organizations, people, keywords,
    warnings). What verification calls false or labelled otherwise is flagged; a null list is empty."""
    say = MESSAGES[language]
    listed = lambda c: F.coalesce(c, F.array().cast(results.schema[c].dataType))
    named = lambda keys, c: F.coalesce(*(F.when(c == k, say[k]) for k in keys), F.lit(say[keys[0]]))
    flag = lambda x: F.when(~F.coalesce(x["found_in_text"], F.lit(True)) | F.coalesce(x["issue"] == "labelMismatch", F.lit(False)), F.concat(F.lit(" ("), named(("notInText", "currencyMismatch", "fromInstruction", "labelMismatch"), x["issue"]), F.lit(")"))).otherwise("")
    text = lambda c: escape(F.coalesce(c, F.lit("")))
    row = lambda a: F.concat(F.lit("| "), format_money(a["value"], a["currency"], language), F.lit(" | "), text(a["context"]), flag(a), F.lit(" |"))
    day = lambda d: F.concat(F.lit("- "), format_date(d["date"], language), F.lit(": "), text(d["context"]), flag(d))
    items = lambda c: F.transform(listed(c), lambda t: F.concat(F.lit("- "), text(t)))
    counted = lambda c: F.concat(F.lit(f"{say[c]} ("), F.size(listed(c)).cast("string"), F.lit(")"))
    table = F.array(F.lit(f"| {say['amount']} | {say['concerns']} |"), F.lit("| ---: | --- |"))
    rows = F.transform(listed("amounts"), row)
    types = ("inne", "faktura", "umowa", "oferta", "raport")
    head = F.concat_ws(
        "\n", F.concat(F.lit(f"# {say['title']}"), text(F.coalesce("title", "file_name"))), F.lit(""), F.concat(F.lit(f"- {say['source']}: "), text(F.col("file_name"))),
        F.concat(F.lit(f"- {say['type']}: "), named(types, F.col("type"))), F.concat(F.lit(f"- {say['date']}: "), F.coalesce(F.when(F.col("date").isNotNull(), format_date(F.col("date"), language)), F.lit(say["notGiven"]))),
        F.concat(F.lit(f"- {say['language']}: "), text(F.col("document_language"))), F.concat(F.lit(f"- {say['pages']}: "), F.coalesce(F.col("pages").cast("string"), F.lit(say["notGiven"]))),
    )
    parts = F.concat_ws(
        "\n\n", head, F.concat(F.lit(f"> {say['translated']}"), F.col("translated_from")), F.concat(F.lit(f"## {say['summary']}\n\n"), text(F.col("summary"))),
        _section(F.lit(say["keyPoints"]), items("key_points"), ""), _section(counted("amounts"), F.when(F.size(rows) > 0, F.concat(table, rows)).otherwise(rows), say["none"]), _section(counted("dates"), F.transform(listed("dates"), day), say["none"]),
        *(_section(F.lit(say[c]), items(c), say["none"]) for c in ("organizations", "people", "keywords")), F.when(F.size(listed("warnings")) > 0, _section(F.lit(say["warnings"]), items("warnings"), "")),
    )
    return results.select("doc_id", F.concat(parts, F.lit("\n")).alias("report"))


def translated_document(pages: DataFrame, issues: DataFrame, unchecked: DataFrame) -> DataFrame:
    """(doc_id, report): pages (doc_id, page, text) in order with escaped lines, then issues (doc_id,
    page, issue) and the ranges (doc_id, ranges) of scans that were not checked."""
    ordered = F.array_sort(F.collect_list(F.struct("page", escape_lines(F.col("text")).alias("text"))))
    body = pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: F.concat(F.format_string("## %d\n", p["page"].cast("int")), p["text"])), "\n\n").alias("body"))
    listed = issues.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.lit("-"), F.coalesce(F.col("page").cast("string"), F.lit("all")), "issue"))), "\n").alias("issues"))
    met = body.join(listed, "doc_id", "left").join(unchecked.select("doc_id", "ranges"), "doc_id", "left")
    parts = F.concat_ws("\n\n", "body", F.when(F.col("issues").isNotNull(), F.concat(F.lit("Issues:\n"), "issues")), F.when(F.col("ranges") != "", F.concat(F.lit("Not checked: "), "ranges")))
    return met.select("doc_id", parts.alias("report"))
