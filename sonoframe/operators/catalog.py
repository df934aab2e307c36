"""The catalog: searching, filtering and ordering listings, and telling what changed between two of them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import natural_key
from ..functions.text import query_words

#: The extensions that count as audio, by the format that the filter names.
FORMATS = {
    "wav": ("wav", "wave", "bwf", "rf64"), "aiff": ("aif", "aiff", "aifc"), "caf": ("caf",), "flac": ("flac",),
    "mp3": ("mp3",), "m4a": ("m4a", "aac"), "ogg": ("ogg", "oga"), "mka": ("mka", "webm"),
}
AUDIO = tuple(x for group in FORMATS.values() for x in group)


def is_audio(extension: Column) -> Column:
    return F.lower(extension).isin(*AUDIO)


@dataclass(frozen=True)
class Search:
    """What a search asks: words, a format, an interval of a kind of date, bounds of length. Defaults ask nothing."""

    words: str = ""
    format: str | None = None
    date_kind: str = "recorded"
    since: str | None = None
    until: str | None = None
    shortest: float | None = None
    longest: float | None = None
    text_columns: tuple[str, ...] = ("name", "title")
    dates: str = "dates"
    _: object = field(default=None, repr=False)

    def asks(self) -> bool:
        return bool(query_words(self.words)) or any(x is not None for x in (self.format, self.since, self.until, self.shortest, self.longest))

    def condition(self) -> Column:
        """One predicate, so that Catalyst can push its parts down. Unknown lengths and dates fail bounds on them."""
        text = F.lower(F.concat_ws("\n", *self.text_columns))
        parts = [text.contains(w) | F.lower("folder").contains(w) for w in query_words(self.words)]
        if self.format:
            parts.append(F.lower("extension").isin(*FORMATS[self.format]))
        if self.since or self.until:
            since = F.lit(self.since).cast("timestamp_ntz") if self.since else None
            until = F.lit(self.until).cast("timestamp_ntz") if self.until else None

            def within(d: Column) -> Column:
                held = d["kind"] == self.date_kind
                held = held & (d["start"] >= since) if since is not None else held
                return held & (d["end"] <= until) if until is not None else held

            parts.append(F.coalesce(F.exists(self.dates, within), F.lit(False)))
        if self.shortest is not None:
            parts.append(F.coalesce(F.col("seconds") >= self.shortest, F.lit(False)))
        if self.longest is not None:
            parts.append(F.coalesce(F.col("seconds") <= self.longest, F.lit(False)))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(catalog: DataFrame, ask: Search) -> DataFrame:
    """The rows that a search admits, by folder and name in natural order."""
    return catalog.where(ask.condition()).orderBy(natural_key(F.lower("folder")), natural_key(F.lower("name")), "path")


def matched_in(ask: str, fields: dict[str, str]) -> Column:
    """The labels of the columns that hold any word of a search, in order."""
    words = query_words(ask)
    hit = lambda c: reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(w) for w in words], F.lit(False))
    return F.array_distinct(F.array_compact(F.array(*[F.when(hit(c), F.lit(label)) for label, c in fields.items()])))


def reuse(listing: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a listing that a cache still describes (same path, bytes and time), and those to read again."""
    keys = ["path", "bytes", "modified"]
    return listing.join(cache, keys, "inner"), listing.join(cache.select(*keys), keys, "left_anti")


def neighbours(listing: DataFrame, by: list[str]) -> DataFrame:
    """Each row's predecessor and successor within its folder in natural order."""
    order = Window.partitionBy("folder").orderBy(*[natural_key(F.lower(c)) for c in by], "path")
    return listing.withColumn("previous", F.lag("path").over(order)).withColumn("next", F.lead("path").over(order))
