"""What a document's pages support, kept as mention tables keyed by document and value."""

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..sources.shared import kept
from . import mentions as M


class Evidence:
    """``clean`` and ``injected`` texts of ``pages`` (doc_id, page, text), and what they state, for
    ``docs`` (doc_id, language). Injected values are those that the clean text lacks.

    Each table is made when it is first asked for, and written: a check pays for what it reads only.
    """

    def __init__(self, pages: DataFrame, docs: DataFrame):
        self._given, self._docs = pages.select("doc_id", "page", "text"), docs.select("doc_id", "language")

    @cached_property
    def pages(self) -> DataFrame:
        """doc_id, page, clean, injected, instructed (is it one of M.injection_findings?)"""
        return kept(M.split_injected_lines(M.spread(self._given), "instructed").drop("text"))

    @cached_property
    def _rests(self) -> DataFrame:
        return kept(M.undated(self.pages, "clean"))

    @cached_property
    def styles(self) -> DataFrame:
        """doc_id, style"""
        return kept(M.styles_of(self._rests, self._docs))

    @cached_property
    def _tokens(self) -> DataFrame:
        return kept(M.tokens_of(M.readable_of(self._rests, self.styles)))

    @cached_property
    def numbers(self) -> DataFrame:
        """doc_id, cents"""
        return kept(M.numbers_of(self._tokens, M.readable_of(self._rests, self.styles)))

    @cached_property
    def money(self) -> DataFrame:
        """doc_id, cents, currency"""
        return kept(M.money_of(self._tokens).distinct())

    @cached_property
    def labels(self) -> DataFrame:
        """doc_id, cents, kind, label"""
        return kept(M.labels_of(self._tokens))

    @cached_property
    def dates(self) -> DataFrame:
        """doc_id, year, short, month, day"""
        return kept(M.date_evidence(self.pages, "clean"))

    @cached_property
    def _suspect(self) -> DataFrame:
        return self.pages.where("injected <> ''")

    @cached_property
    def _injected(self) -> DataFrame:
        return M.readable(self._suspect, self.styles, "injected", rejoin=False)

    @cached_property
    def _told(self) -> DataFrame:
        return kept(M.tokens_of(self._injected))

    @cached_property
    def injected_numbers(self) -> DataFrame:
        return M.numbers_of(self._told, self._injected).join(self.numbers, ["doc_id", "cents"], "left_anti")

    @cached_property
    def injected_money(self) -> DataFrame:
        return M.money_of(self._told).distinct().join(self.money, ["doc_id", "cents", "currency"], "left_anti")

    @cached_property
    def injected_dates(self) -> DataFrame:
        """doc_id, date"""
        return without_dates(kept(M.date_mentions(self._suspect, "injected").select("doc_id", "date").distinct()), self.dates)


def build_evidence(pages: DataFrame, docs: DataFrame) -> Evidence:
    """Evidence of ``pages`` (doc_id, page, text) for ``docs`` (doc_id, language).

    Pages without text state nothing. Pages that repeat state their values once. Documents without
    pages have no evidence; a null language leaves the decimal style to the pages.
    """
    return Evidence(pages, docs)


def short_key(date):
    return [(F.year(date) % 100).alias("year"), F.month(date).alias("month"), F.dayofmonth(date).alias("day")]


def without_dates(dates: DataFrame, readings: DataFrame) -> DataFrame:
    """(doc_id, date) rows that no reading of the document supports."""
    left = dates.join(M.full_dates(readings), ["doc_id", "date"], "left_anti")
    short = readings.where("short").drop("short")
    keyed = left.select("*", *short_key(F.col("date")))
    return keyed.join(short, ["doc_id", "year", "month", "day"], "left_anti").select(*dates.columns)


def union_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pages and the independent readings of scans: both are evidence."""
    return pages.select("doc_id", "page", "text").unionByName(ocr.select("doc_id", "page", "text"))
