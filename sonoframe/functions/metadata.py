"""Metadata texts to rows: key-value lines, lenient XML, chapters, and what changed between two versions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import chapter_key

_TOKEN = re.compile(r"<!\[CDATA\[(.*?)\]\]>|<!--.*?-->|<\?.*?\?>|<!.*?>|<(/?)([^\s/>]+)[^>]*?(/?)>|([^<]+)", re.S)
#: XML's five entities.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def unescape(text: str) -> str:
    """Entities and numeric references as characters; what is malformed stays."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            return ENTITIES.get(name, m[0])
        try:
            return chr(int(name[2:], 16) if name[1] in "xX" else int(name[1:]))
        except (ValueError, OverflowError):
            return m[0]

    return re.sub(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[a-z]+);", one, text)


class Element:
    """An element's name, own text and children."""

    def __init__(self, name: str):
        self.name, self.text, self.children = name, "", []


def tree(xml: str) -> list[Element]:
    """The outermost elements; unclosed elements end with their parent, stray ends are ignored."""
    top = Element("")
    stack = [top]
    for cdata, end, name, empty, text in _TOKEN.findall(xml):
        if name and not end:
            stack[-1].children.append(Element(name))
            if not empty:
                stack.append(stack[-1].children[-1])
        elif name:
            at = max((i for i, e in enumerate(stack) if i and e.name == name), default=0)
            del stack[at or len(stack) :]
        elif len(stack) > 1:
            stack[-1].text += cdata or unescape(text)
    return top.children


def _below(element: Element, label: str, numbered: bool) -> Iterator[tuple[str, str]]:
    """(label, text) of the leaves of an element; siblings of one name are numbered, if asked for."""
    if not element.children:
        yield label, element.text.strip()
        return
    names = [e.name for e in element.children]
    for i, child in enumerate(element.children):
        nth = f" {names[: i + 1].count(child.name)}" if numbered and names.count(child.name) > 1 else ""
        yield from _below(child, f"{label} / {child.name}{nth}" if label else child.name + nth, numbered)


def leaves(xml: str, numbered: bool = False) -> list[tuple[str, str]]:
    """Path and text of each element without children that has text."""
    return [(path, text) for e in tree(xml) for path, text in _below(e, e.name, numbered) if text]


def details(xml: str) -> list[tuple[str, str]]:
    """What iXML says, label and value below its outermost element; tracks as `Track n`, name and function."""
    out = []
    for child in (c for e in tree(xml)[:1] for c in e.children):
        if child.name == "TRACK_LIST":
            for track in (t for t in child.children if t.name == "TRACK"):
                field = lambda name: next((c.text.strip() for c in track.children if c.name == name), "")  # noqa: B023, E731
                out.append((f"Track {field('CHANNEL_INDEX')}", ", ".join(filter(None, (field("NAME"), field("FUNCTION"))))))
        else:
            out += _below(child, child.name, False)
    return [(label, value) for label, value in out if value]


def _xml(rows: DataFrame, key: str, xml: str, read) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = [(k, i, p, v) for k, x in zip(pdf["key"], pdf["xml"]) for i, (p, v) in enumerate(read(x or ""))]
            yield pd.DataFrame(each, columns=["key", "ord", "path", "value"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(xml).alias("xml")).mapInPandas(work, f"key {kind}, ord long, path string, value string")


def xml_rows(rows: DataFrame, key: str, xml: str, numbered: bool = False) -> DataFrame:
    """Each XML text's leaves in order: key, ord, path, value; siblings that share a name are numbered, if asked for."""
    return _xml(rows, key, xml, lambda x: leaves(x, numbered))


def detail_rows(rows: DataFrame, key: str, xml: str) -> DataFrame:
    """Each iXML text's details in order: key, ord, path (the label), value."""
    return _xml(rows, key, xml, details)


def key_values(rows: DataFrame, key: str, text: str) -> DataFrame:
    """`Key: Value` lines, split at the first colon, in order; \\n in a value is a line's end; the line of the version is left out."""
    lines = rows.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\r?\n")).alias("ord", "line")).where(F.col("line").contains(":"))
    value = F.replace(F.trim(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1)), F.lit("\\n"), F.lit("\n"))
    return lines.select("key", F.col("ord").cast("long").alias("ord"), F.trim(F.substring_index("line", ":", 1)).alias("name"), value.alias("value")).where("name <> 'GUANO|Version'")


def chapters(fields: DataFrame) -> DataFrame:
    """Fields (rec_id, name, value) named CHAPTERnn, with NAME, NOTE or END, gathered: rec_id, n, start, title, note, stop."""
    n, part = chapter_key(F.col("name"))
    rows = fields.withColumn("n", n).withColumn("part", part).where("n is not null")
    pick = lambda p: F.max(F.when(F.col("part") == p, F.col("value")))
    return rows.groupBy("rec_id", "n").agg(pick("").alias("start"), pick("NAME").alias("title"), pick("NOTE").alias("note"), pick("END").alias("stop"))


def frames_at(text: Column, rate: Column) -> Column:
    """`hh:mm:ss.sss` as frames; more parts don't matter; null for anything else."""
    part = lambda i: F.get(F.split(F.trim(text), ":"), F.lit(i)).try_cast("double")
    return F.round((part(0) * 3600 + part(1) * 60 + part(2)) * rate).cast("long")


def chapter_markers(fields: DataFrame, rate: int) -> DataFrame:
    """Chapters as markers (rec_id, id, frame, length, label, note): the length is what END is after the start; times that can't be read count as 0."""
    at = lambda x: F.greatest(F.coalesce(frames_at(F.col(x), F.lit(rate)), F.lit(0).cast("long")), F.lit(0).cast("long"))
    length = F.when(F.col("stop").isNotNull(), F.greatest(at("stop") - at("start"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    text = lambda x: F.coalesce(F.col(x), F.lit(""))
    return chapters(fields).select("rec_id", F.col("n").alias("id"), at("start").alias("frame"), length.alias("length"), text("title").alias("label"), text("note").alias("note"))


def difference(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What was added, removed or changed between two versions of fields."""
    a, b = before.select(*keys, F.col(value).alias("was"), F.lit(True).alias("had")), after.select(*keys, F.col(value).alias("now"), F.lit(True).alias("has"))
    what = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, keys, "full_outer").select(*keys, "was", "now", what.alias("what")).where("what is not null")


def sync_point(high: Column, low: Column) -> Column:
    """A 64-bit frame from its two halves."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))
