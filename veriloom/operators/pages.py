"""Page-level jobs: cleaning, scans, coverage, lines and form fields. Pages are (doc_id, page, text)."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import clean, fold, rebuilt, search_form, strip, visible_length
from .running import dealt, running

#: A page with fewer visible characters is a scan; with an image, one with fewer than the second.
FEW_CHARS, FEW_CHARS_WITH_IMAGE = 30, 400
USABLE_OCR = 20


def normalize_pages(pages: DataFrame) -> DataFrame:
    """Pages with their text cleaned, and ``changed``: did the cleaning change it? Null stays null."""
    cleaned = clean(F.col("text"))
    return pages.withColumn("changed", F.coalesce(cleaned != F.col("text"), F.lit(False))).withColumn("text", cleaned)


def fold_pages(pages: DataFrame) -> DataFrame:
    """Pages with ``folded`` (for phrases) and ``search`` (for names and dates)."""
    return pages.withColumns({"folded": fold(F.col("text")), "search": search_form(F.col("text"))})


def scan_candidates(info: DataFrame) -> DataFrame:
    """Rows of ``info`` (text_chars, has_images, ...) without usable text."""
    few = (F.col("text_chars") < FEW_CHARS) | (F.coalesce("has_images", F.lit(False)) & (F.col("text_chars") < FEW_CHARS_WITH_IMAGE))
    return info.where(few)


def page_info(pages: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, text_chars, has_images): visible characters, and is there an image?"""
    info = pages.select("doc_id", "page", visible_length(F.col("text")).alias("text_chars"))
    if images is None:
        return info.withColumn("has_images", F.lit(False))
    marked = images.select("doc_id", "page").distinct().withColumn("has_images", F.lit(True))
    return info.join(marked, ["doc_id", "page"], "left").withColumn("has_images", F.coalesce("has_images", F.lit(False)))


def neutralize_markup(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` whose texts have other brackets in place of each < and > of the tags of the
    document's own block, so that data cannot close it, and ``changed``. A tag goes on to its first
    >, whatever it holds."""
    tag = r"(?i)</?\s*document[^>]*>"
    told = rebuilt(F.col(text), tag, lambda m: F.translate(m, "<>", "‹›"))
    return pages.withColumn("changed", F.coalesce(F.col(text).rlike(tag), F.lit(False))).withColumn(text, told)


def translation_target(language: Column) -> Column:
    """English, and Polish for English documents."""
    return F.when(language == "en", "pl").otherwise("en")


def content_language(docs: DataFrame, default: str) -> DataFrame:
    """``docs`` (language, translated_to) with ``content_language`` (of the texts: a translation's, else
    the document's), ``target`` (of a translation) and ``export_language``: that of the content where
    reports are written in it, else ``default``."""
    content = F.coalesce("translated_to", "language")
    export = F.when(content.isin("pl", "en"), content).otherwise(F.lit(default))
    return docs.withColumns({"content_language": content, "target": translation_target(F.col("language")), "export_language": export})


def mark_scan_pages(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Pages with a header, and a marker where the page is a scan with an image."""
    scans = images.select("doc_id", "page").distinct().withColumn("__image", F.lit(True))
    scan = F.coalesce("__image", F.lit(False)) & (F.length(strip(F.coalesce("text", F.lit("")))) < FEW_CHARS)
    body = F.concat_ws("\n", F.format_string("[Page %d]", F.col("page").cast("int")), F.when(scan, "[scan, see image]"), F.coalesce("text", F.lit("")))
    return pages.join(scans, ["doc_id", "page"], "left").withColumn("text", body).drop("__image")


def select_scan_pages(candidates: DataFrame, most: int = 4) -> DataFrame:
    """``candidates`` (doc_id, page, text_chars) with ``selected``: the ``most`` pages with the
    least text of each document, the earlier of equals."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text_chars", "page"))
    return candidates.withColumn("selected", rank <= most)


def text_budget_cutoff(pages: DataFrame, budget: int = 400_000) -> DataFrame:
    """(doc_id, page, total): the first page of a document with which its text exceeds the budget."""
    sized = dealt(pages.select("doc_id", "page", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size")), ["doc_id"], ["page"])
    over = running(sized, ["doc_id"], ["page"], {"total": F.col("size")}, inclusive=True).where(F.col("total") > budget)
    return over.groupBy("doc_id").agg(F.min("page").alias("page"), F.min_by("total", "page").alias("total"))


def page_ranges(pages: DataFrame) -> DataFrame:
    """(doc_id, ranges): distinct pages as "5–7, 9"."""
    islands = pages.select("doc_id", F.col("page").cast("long").alias("page")).dropna().distinct()
    islands = islands.withColumn("island", F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    runs = islands.groupBy("doc_id", "island").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    text = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("–", "low", "high"))
    ordered = F.array_sort(F.collect_list(F.struct("low", text.alias("text"))))
    return runs.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), ", ").alias("ranges"))


def coverage(docs: DataFrame, skipped: DataFrame, failed: DataFrame) -> DataFrame:
    """``docs`` (doc_id, page_count) with ``unread`` (pages skipped or failed, joined by commas), n_unread,
    ``notes`` (how many pages of each kind, "failed 1, skipped 2") and share_read, of all pages. Blank
    pages are read; a page that was skipped and failed is one unread page with both notes."""
    kinds = skipped.select("doc_id", "page", F.lit("skipped").alias("kind")).unionByName(failed.select("doc_id", "page", F.lit("failed").alias("kind"))).distinct()
    listed = kinds.groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    counted = kinds.groupBy("doc_id", "kind").count().groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "kind", F.col("count").cast("string")))), ", ").alias("notes"))
    met = docs.join(listed, "doc_id", "left").join(counted, "doc_id", "left")
    n = F.greatest(F.coalesce(F.size("pages"), F.lit(0)), F.lit(0)).cast("long")
    share = F.when(F.col("page_count") > 0, 1 - n / F.col("page_count"))
    unread = F.coalesce(F.array_join("pages", ","), F.lit(""))
    return met.withColumns({"unread": unread, "n_unread": n, "notes": F.coalesce("notes", F.lit("")), "share_read": share}).drop("pages")


def ocr_uncovered(scans: DataFrame, ocr: DataFrame) -> DataFrame:
    """(doc_id) of documents with a scan that no usable second reading covers: what is missing from
    their text cannot be called false."""
    usable = ocr.where(visible_length(F.col("text")) >= USABLE_OCR).select("doc_id", "page")
    return scans.select("doc_id", "page").join(usable, ["doc_id", "page"], "left_anti").select("doc_id").distinct()


def assemble_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, text) of positioned fragments (doc_id, page, item_no, str, a, b, c, d, x, y,
    width, has_eol).

    A fragment starts a line where the direction turns or it lies off the line by over half its
    size, and a word where the gap is over 0.15 of its size. Empty fragments without width move
    nothing; an end of line forgets the last place.
    """
    order = Window.partitionBy("doc_id", "page").orderBy("item_no")
    length = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    size = F.sqrt(F.col("c") * F.col("c") + F.col("d") * F.col("d"))
    placed = items.withColumn("str", F.coalesce("str", F.lit(""))).withColumn("len", F.when(length == 0, 1.0).otherwise(length))
    placed = placed.withColumns({"size": F.when(size == 0, 10.0).otherwise(size), "dx": F.col("a") / F.col("len"), "dy": F.col("b") / F.col("len")})
    moved = (F.length("str") > 0) | (F.col("width") > 0)
    end = F.struct((F.col("x") + F.col("width") * F.col("dx")).alias("x"), (F.col("y") + F.col("width") * F.col("dy")).alias("y"), "dx", "dy", F.lit(False).alias("eol"))
    forgotten = F.struct(*(F.lit(0.0).alias(c) for c in ("x", "y", "dx", "dy")), F.lit(True).alias("eol"))
    placed = placed.withColumn("anchor", F.when(F.col("has_eol"), forgotten).when(moved, end))
    placed = placed.withColumn("prev", F.last("anchor", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.lag("str").over(order))
    vx, vy = F.col("x") - F.col("prev.x"), F.col("y") - F.col("prev.y")
    along, across = vx * F.col("prev.dx") + vy * F.col("prev.dy"), F.abs(vy * F.col("prev.dx") - vx * F.col("prev.dy"))
    turned = (F.abs(F.col("dx") - F.col("prev.dx")) >= 0.01) | (F.abs(F.col("dy") - F.col("prev.dy")) >= 0.01)
    known = F.col("prev").isNotNull() & ~F.coalesce("prev.eol", F.lit(True)) & (F.length("str") > 0)
    gap = F.when(known & (turned | (across > F.col("size") * 0.5)), "\n").when(known & (along > F.col("size") * 0.15) & ~F.coalesce(F.col("before").endswith(" "), F.lit(False)) & ~F.col("str").startswith(" "), " ").otherwise("")
    piece = F.concat(gap, clean(F.col("str")), F.when(F.col("has_eol"), "\n").otherwise(""))
    pieces = F.array_sort(F.collect_list(F.struct("item_no", piece.alias("piece"))))
    joined = placed.groupBy("doc_id", "page").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"))
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"[ \t]+\n", "\n"), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return joined.withColumn("text", strip(tidy))


PASSWORD_FLAG = 1 << 13


def form_fields(annotations: DataFrame) -> DataFrame:
    """(doc_id, page, seq, line) "label: value" of filled fields, each line of a page once, where it
    first stands. ``field_value`` is a string or an array of strings."""
    blank = lambda c: F.when(strip(c) != "", strip(c))
    widgets = annotations.where((F.col("subtype") == "Widget") & (F.coalesce("field_flags", F.lit(0)).bitwiseAND(PASSWORD_FLAG) == 0))
    if annotations.schema["field_value"].dataType.typeName() == "array":
        entered = blank(F.array_join(F.filter(F.transform("field_value", strip), lambda v: v != ""), ", "))
    else:
        entered = blank(F.col("field_value"))
    chosen = F.when(entered != "Off", F.when(F.col("radio_button"), entered).otherwise("checked"))
    value = F.when(F.coalesce("check_box", F.lit(False)) | F.coalesce("radio_button", F.lit(False)), chosen).otherwise(entered)
    label = F.coalesce(blank(F.col("alt_text")), blank(F.col("field_name")), F.lit("field"))
    lines = widgets.select("doc_id", "page", "seq", F.concat(label, F.lit(": "), value).alias("line")).dropna(subset=["line"])
    first = F.row_number().over(Window.partitionBy("doc_id", "page", "line").orderBy("seq"))
    return lines.withColumn("n", first).where("n = 1").drop("n")


def append_form_fields(pages: DataFrame, fields: DataFrame, header: str = "[Form fields]") -> DataFrame:
    """Pages with their filled fields under a header."""
    listed = fields.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines"))
    more = F.concat_ws("\n", F.col("text"), F.lit(header), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return pages.join(listed, ["doc_id", "page"], "left").withColumn("text", F.when(F.col("lines").isNotNull(), more).otherwise(F.col("text"))).drop("lines")


def blank_images(images: DataFrame, luma: str = "luma", contrast: float = 24.0, ink: int = 8) -> DataFrame:
    """``images`` with ``n_ink``, pixels of the array ``luma`` further than ``contrast`` from its
    mean, and ``blank``: are there fewer than ``ink``?"""
    n = F.size(luma)
    mean = F.aggregate(luma, F.lit(0.0), lambda a, x: a + x.cast("double")) / n
    with_mean = images.withColumn("__mean", F.when(n > 0, mean))
    inked = with_mean.withColumn("n_ink", F.coalesce(F.size(F.filter(luma, lambda x: F.abs(x.cast("double") - F.col("__mean")) > contrast)), F.lit(0)).cast("long"))
    return inked.withColumn("blank", F.col("n_ink") < ink).drop("__mean")
