"""URL filtering with host/path rules and a Bloom filter cascade [DataFrame functions only].

A cascade alternates levels: the first encodes the listed keys, the second those keys of the
corpus that the first lets through by mistake, the third the listed keys that the second lets
through, and so on until a level lets nothing through by mistake. Over the whole key universe
membership is then exact, and testing a row needs no join: the levels are constants of the plan.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .tables import ascii_lower, cut, free_name


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for
    null and for urls without ``://``."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def sites(host: Column) -> Column:
    """A host and every domain that it belongs to: the keys under which a list may hold it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def first_rule(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest fitting rule (then the longest host, then code points)."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        out = F.when(rule.fits(host, path), F.lit(value(rule))).otherwise(out)
    return out


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` in bytes, tested at ``hashes`` places a key."""

    number: int
    bits: bytes
    hashes: int

    def holds(self, key: Column) -> Column:
        data = F.lit(self.bits)  # once in the plan, however many hashes there are

        def is_set(place: Column) -> Column:
            byte = F.conv(F.hex(F.substr(data, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10)  # without reading the others
            return F.getbit(byte.cast("int"), (place % 8).cast("int")) == 1

        return F.forall(F.array(*_places(key, self.number, self.hashes, len(self.bits) * 8)), is_set)


def _places(key: Column, level: int, hashes: int, size: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(size).cast("long")) for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over; null keys are not contained."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):  # the first level that says no decides
            out = F.when(~level.holds(key), F.lit(level.number % 2 == 0)).otherwise(out)
        return F.coalesce(out, F.lit(False))


def build_cascade(universe: DataFrame, listed: DataFrame, false_positives: float = 0.01) -> Cascade:
    """Cascade over all keys of ``universe`` (one string column) for those of ``listed``.

    Nulls and repeated keys are left out; an empty list gives a cascade that contains nothing. A
    level holds about 10 bits a key; ``listed_flag`` deals more keys than a plan can hold over
    several cascades.
    """
    key = universe.columns[0]
    inside = cut(listed.select(F.col(listed.columns[0]).alias(key)).dropna().distinct())
    outside = universe.select(key).dropna().distinct().join(inside, key, "left_anti")
    levels: list[Level] = []
    encode, other = inside, outside
    while True:
        level = _encode(encode, key, len(levels) + 1, encode.count(), false_positives if not levels else 0.5)
        levels.append(level)
        wrong = cut(other.where(level.holds(F.col(key))))  # a few of the universe, fewer each level
        if wrong.isEmpty():
            return Cascade(tuple(levels))
        encode, other = wrong, encode


def _encode(keys: DataFrame, key: str, number: int, count: int, rate: float) -> Level:
    size = 8 * max(8, math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 8))
    hashes = max(1, round(size / max(1, count) * math.log(2))) if count else 1
    hashes = min(hashes, 16)
    place = F.explode(F.array(*_places(F.col(key), number, hashes, size)))
    places = keys.select(place.alias("place"))
    # words of 64 bits, the first byte highest, so that their hexadecimal digits are the bytes in order
    bit = F.expr("shiftleft(1L, cast(8 * (7 - (place % 64) div 8) + place % 8 as int))")
    n_words = -(-size // 64)
    none = keys.sparkSession.range(n_words).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("word"))
    words = places.groupBy(F.floor(F.col("place") / 64).alias("at")).agg(F.bit_or(bit).alias("word")).unionByName(none).groupBy("at").agg(F.bit_or("word").alias("word"))
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: F.lpad(F.hex(w["word"]), 16, "0")), "")
    rows = words.groupBy(F.floor(F.col("at") / 4096).alias("piece")).agg(digits.alias("digits")).orderBy("piece").collect()  # size / 2^18 rows of 64 KB
    return Level(number, b"".join(bytes.fromhex(r.digits) for r in rows)[: size // 8], hashes)


def listed_flag(df: DataFrame, keys: Column, listed: DataFrame, name: str, false_positives: float = 0.01, max_keys: int = 4_000_000, at_once: int = 8) -> DataFrame:
    """``df`` with a boolean column ``name``: is one of the ``keys`` (an array of strings) in ``listed``?

    A hash deals all keys over as many cascades as keep each level near ``max_keys`` keys (5 MB); a
    key asks its own. ``at_once`` cascades are tested in one pass over ``df``, which is then written,
    so plan and driver hold about 40 MB however long the list is. One cascade, as a rule, is one pass
    and no writing. Null keys are in no list; an empty or null array gives false.
    """
    universe = cut(df.select(F.explode(keys).alias("key")).dropna().distinct())
    known = cut(listed.select(F.col(listed.columns[0]).alias("key")).dropna().distinct())
    n = max(1, math.ceil(known.count() / max_keys), math.ceil(universe.count() * false_positives / max_keys))
    part = lambda key: F.pmod(F.xxhash64(F.lit("part"), key), F.lit(n).cast("long"))
    out = df.withColumn(name, F.lit(False))
    for first in range(0, n, at_once):
        some = range(first, min(first + at_once, n))
        cascades = [(i, build_cascade(universe.where(part(F.col("key")) == i), known.where(part(F.col("key")) == i), false_positives)) for i in some]

        def contains(key: Column) -> Column:
            inside = F.lit(False)
            for i, cascade in cascades:
                inside = F.when(part(key) == i, cascade.contains(key)).otherwise(inside)
            return inside

        out = out.withColumn(name, F.col(name) | F.coalesce(F.exists(keys, contains), F.lit(False)))
        out = cut(out) if some.stop < n else out
    return out


def filter_urls(pages: DataFrame, rules: Sequence[Rule], listed_sites: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict: the longest fitting rule's verdict, else
    ``block`` for hosts of a listed site or below one and ``allow`` for the rest.

    A null url has an empty host and path, which no rule fits. Repeated rows stay, each judged
    alike; an empty table stays empty. Columns named host, path, rule or verdict are replaced.
    """
    host_name, path_name = free_name(pages, "host"), free_name(pages, "path")
    host, path = F.col(host_name), F.col(path_name)
    parts = pages.withColumns({host_name: url_host(F.col(url)), path_name: url_path(F.col(url))})
    listed = free_name(parts, "listed")
    flagged = listed_flag(parts, sites(host), listed_sites, listed)
    rule = first_rule(rules, host, path, lambda r: r.text)
    verdict = F.coalesce(first_rule(rules, host, path, lambda r: r.verdict), F.when(F.col(listed), "block").otherwise("allow"))
    return flagged.withColumns({"host": host, "path": path, "rule": rule, "verdict": verdict}).drop(host_name, path_name, listed)
