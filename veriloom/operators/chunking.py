"""Packing pages into chunks of a capacity.

A page above the capacity is cut into pieces first, at line breaks, and inside lines that are longer
than the capacity themselves; each piece is a chunk alone. Only lengths are packed; texts are joined
to their chunk's number.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import strip
from ..sources.shared import kept
from .packing import pack


def blocks(pages: DataFrame) -> DataFrame:
    """Pages as blocks: a header, the trimmed text and a line break."""
    body = strip(F.coalesce(F.col("text"), F.lit("")))
    return pages.select("doc_id", F.col("page").cast("long").alias("page"), F.concat(F.format_string("[Page %d]", F.col("page").cast("int")), F.lit("\n"), body, F.lit("\n")).alias("block"))


def split_long_pages(pages: DataFrame, max_chars: int, text: str = "text", blank_lines: bool = True) -> DataFrame:
    """(doc_id, page, piece_no, piece) of the pages above the capacity: whole lines while they fit,
    and lines above the capacity in cuts that stand alone. Without ``blank_lines`` runs of line
    breaks count as one; empty pieces are left out."""
    long = kept(pages.where(F.length(text) > max_chars).select("doc_id", "page", F.split(text, "\n" if blank_lines else "\n+", -1).alias("lines")))
    cuts = lambda line: F.floor((F.greatest(F.length(line), F.lit(1)) - 1) / max_chars) + 1
    n_parts = F.aggregate("lines", F.lit(0).cast("long"), lambda n, line: n + cuts(line))
    folded = long.where(n_parts <= _FOLDED).select("doc_id", "page", F.posexplode(_folded(F.col("lines"), max_chars)).alias("piece_no", "piece"))
    large = long.where(n_parts > _FOLDED)
    if large.isEmpty():
        return folded
    return folded.unionByName(_packed(large.select("doc_id", "page", F.posexplode("lines").alias("line_no", "line")), max_chars))


#: Pages of up to so many lines and cuts are taken apart in their row; above, a page is many tasks' work.
_FOLDED = 4096


def _folded(lines: Column, max_chars: int) -> Column:
    """The pieces of a page's lines, in order; nothing is shuffled."""
    kind = "struct<done:array<string>,open:string>"
    state = lambda done, open: F.struct(done.alias("done"), open.alias("open")).cast(kind)
    none = F.lit(None).cast("string")
    closed = lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))

    def step(s: Column, line: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(line) - 1) / max_chars).cast("int"))
        parts = F.transform(starts, lambda i: F.substr(line, i * max_chars + 1, F.lit(max_chars)))
        fits = F.length(s["open"]) + 1 + F.length(line) <= max_chars
        return (
            F.when(F.length(line) > max_chars, state(F.concat(closed(s), parts), none))
            .when(fits, state(s["done"], F.concat(s["open"], F.lit("\n"), line)))
            .otherwise(state(closed(s), F.nullif(line, F.lit(""))))
        )

    return F.aggregate(lines, state(F.array().cast("array<string>"), none), step, closed)


def _packed(long: DataFrame, max_chars: int) -> DataFrame:
    """The same of pages of any number of lines, from rows of (doc_id, page, line_no, line)."""
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.length("line"), F.lit(1)) - 1) / max_chars).cast("int"))
    cuts = F.transform(starts, lambda i: F.struct((F.length("line") > max_chars).alias("alone"), i.alias("cut_no"), F.substr("line", i * max_chars + 1, F.lit(max_chars)).alias("part")))
    parts = long.select("doc_id", "page", "line_no", F.explode(cuts).alias("c")).select("doc_id", "page", "line_no", "c.*").withColumn("size", F.length("part"))

    numbered = pack(parts, ["doc_id", "page"], ["line_no", "cut_no"], F.col("size") + 1, max_chars + 1, "piece_no", alone=F.col("alone"), blank=F.col("size") == 0).where("piece_no is not null").withColumn("piece_no", F.col("piece_no").cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "cut_no", "part")))
    return numbered.groupBy("doc_id", "page", "piece_no").agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "\n").alias("piece"))


def page_pieces(pages: DataFrame, max_chars: int) -> DataFrame:
    """(doc_id, page, piece_no, piece, long) of the blocks of ``pages``: those that fit as they are."""
    whole = blocks(pages)
    long = split_long_pages(whole, max_chars, "block", blank_lines=False).withColumn("long", F.lit(True))
    fits = whole.where(F.length("block") <= max_chars).select("doc_id", "page", F.lit(0).alias("piece_no"), F.col("block").alias("piece"), F.lit(False).alias("long"))
    return fits.unionByName(long)


def chunk_pieces(pieces: DataFrame, max_chars: int) -> DataFrame:
    """``pieces`` (doc_id, page, piece_no, piece, long) with ``chunk_no``: pages are packed in order
    while they fit, the line break between two not counted; pieces of long pages stand alone."""

    sized = pieces.select("doc_id", "page", "piece_no", "long", F.length("piece").alias("size"))
    numbers = pack(sized, ["doc_id"], ["page", "piece_no"], F.col("size") + 1, max_chars + 2, "chunk_no", alone=F.col("long")).drop("size", "long")
    return pieces.join(numbers, ["doc_id", "page", "piece_no"])


def chunk_pages(pages: DataFrame, max_chars: int) -> DataFrame:
    """(doc_id, chunk_no, pages, text) of ``pages`` (doc_id, page, text): no text is above the
    capacity but for the line breaks between its pages. A null text counts as empty."""
    pieces = chunk_pieces(page_pieces(pages, max_chars), max_chars)
    ordered = F.array_sort(F.collect_list(F.struct("page", "piece_no", "piece")))
    rows = pieces.groupBy("doc_id", "chunk_no").agg(ordered.alias("rows"))
    return rows.select("doc_id", "chunk_no", F.transform("rows", lambda r: r["page"]).alias("pages"), F.array_join(F.transform("rows", lambda r: r["piece"]), "\n").alias("text"))


def plan_translation_chunks(pages: DataFrame, images: DataFrame, max_chars: int = 12_000, max_images: int = 2) -> DataFrame:
    """(doc_id, page, part_no, chunk_no, has_image, text): as chunk_pages with two capacities. Blank
    pages without an image are left out; the parts of a page in several stand alone, its image with
    the first."""
    marked = images.select("doc_id", F.col("page").cast("long").alias("page")).distinct().withColumn("has_image", F.lit(True))
    sent = pages.select("doc_id", F.col("page").cast("long").alias("page"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sent = sent.join(marked, ["doc_id", "page"], "left").withColumn("has_image", F.coalesce("has_image", F.lit(False))).where((strip(F.col("text")) != "") | F.col("has_image"))
    n_parts = F.count("*").over(Window.partitionBy("doc_id", "page"))
    parts = split_long_pages(sent, max_chars).withColumn("n", n_parts).where("n > 1").select("doc_id", "page", F.col("piece_no").alias("part_no"), "piece")
    met = sent.join(parts, ["doc_id", "page"], "left")
    parted = F.col("part_no").isNotNull()
    image = F.col("has_image") & (F.coalesce("part_no", F.lit(0)) == 0)
    rows = met.select("doc_id", "page", F.coalesce("part_no", F.lit(0)).alias("part_no"), F.when(parted, F.col("piece")).otherwise(F.col("text")).alias("text"), image.alias("has_image"), parted.alias("parted"))

    sized = rows.select("doc_id", "page", "part_no", "has_image", "parted", F.length("text").alias("size"))
    numbers = pack(sized, ["doc_id"], ["page", "part_no"], F.col("size"), max_chars, "chunk_no", alone=F.col("parted"), counted=F.col("has_image"), most=max_images).select("doc_id", "page", "part_no", "chunk_no")
    return rows.join(numbers, ["doc_id", "page", "part_no"]).select("doc_id", "page", "part_no", "chunk_no", "has_image", "text")


def chunk_limits(chunks: DataFrame, max_chunks: int = 4, max_chars: int = 120_000) -> DataFrame:
    """(doc_id, n_chunks, chars, reason) of documents that are over a limit, from ``chunks``
    (doc_id, chunk_no, chars)."""
    total = chunks.groupBy("doc_id").agg(F.countDistinct("chunk_no").alias("n_chunks"), F.sum("chars").alias("chars"))
    reason = F.when(F.col("n_chunks") > max_chunks, "TOO_MANY_CHUNKS").when(F.col("chars") > max_chars, "TOO_LONG")
    return total.withColumn("reason", reason).where("reason is not null")


def reassemble_pages(parts: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, text, scanned) of ``parts`` (doc_id, page, part_no, text), joined by line
    breaks; ``scanned``: the page is one of ``images`` (doc_id, page), so its text is a reading."""
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "text")))
    whole = parts.groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))
    scans = images.select("doc_id", "page").distinct().withColumn("scanned", F.lit(True))
    return whole.join(scans, ["doc_id", "page"], "left").withColumn("scanned", F.coalesce("scanned", F.lit(False)))


def inference_requests(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """A request per chunk for an external extractor: (doc_id, chunk_no, n_chunks, page_count, first,
    last, note, text) of ``chunks`` (doc_id, chunk_no, pages, text). ``docs`` (doc_id, page_count,
    unread: ranges or null); file names are left out."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    note = F.when(F.length(F.coalesce("unread", F.lit(""))) > 0, F.concat(F.lit("Pages not read: "), F.col("unread"))).otherwise("")
    first, last = F.element_at("pages", 1).alias("first"), F.element_at("pages", -1).alias("last")
    return chunks.join(n, "doc_id").join(docs, "doc_id").select("doc_id", "chunk_no", "n_chunks", "page_count", first, last, note.alias("note"), "text")
