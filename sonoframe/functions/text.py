"""Text rules as column expressions: dates, lengths and frequencies as people type them, names, keys and escapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FIRST = r"^([0-9]{4})(?:[-:/.]([0-9]{1,2})(?:[-:/.]([0-9]{1,2}))?)?"
DAY_FIRST = r"^([0-9]{1,2})[-:/.]([0-9]{1,2})[-:/.]([0-9]{4})"
TIME = r"(?:[Tt ]+(?:([0-9]{1,2})(?::([0-9]{1,2})(?::([0-9]{1,2})(?:[.,][0-9]*)?)?)?)?(?:Z|z|[+-][0-9:]+)?)?$"


def parse_stamp(text: Column) -> Column:
    """A date and time as typed to the half-open interval it names, as a struct (start, end): a year, month, day,
    hour, minute or second. Its fields are null for what isn't a date. A zone is ignored, fractions of a second drop.
    """
    let = lambda value, f: F.transform(F.array(value), f)[0]  # computed once, however often it is used
    mark = "\u0001"  # before the parts of what matched, in one order

    def fields(s: Column) -> Column:
        parts = F.split(F.substring(s, 2, 100), r"\|", -1)
        number = lambda x: F.when(x != "", x.try_cast("int"))  # empty parts are many, and a cast that fails is slow
        of = lambda p: F.struct(*[number(F.get(p, F.lit(i))).alias(n) for i, n in enumerate("ymdhns")])
        return F.when(s.startswith(mark), let(parts, of))

    def matched(s: Column) -> Column:
        day_first = F.regexp_replace(s, DAY_FIRST + TIME, f"{mark}$3|$2|$1|$4|$5|$6")
        return let(F.regexp_replace(s, DATE_FIRST + TIME, f"{mark}$1|$2|$3|$4|$5|$6"), lambda x: F.when(x.startswith(mark), x).otherwise(day_first))

    def interval(f: Column) -> Column:
        zero = lambda x: F.coalesce(f[x], F.lit(0))
        one = lambda x: F.lpad(F.coalesce(f[x], F.lit(1)).cast("string"), 2, "0")
        known = f["y"].isNotNull() & (f["h"].isNull() | (f["d"].isNotNull() & (f["h"] < 24))) & (zero("n") < 60) & (zero("s") < 60)
        day = F.concat_ws("-", F.lpad(f["y"].cast("string"), 4, "0"), one("m"), one("d")).try_cast("date").cast("timestamp_ntz")
        start = F.when(known, day) + F.make_dt_interval(F.lit(0), zero("h"), zero("n"), zero("s").cast("decimal(18,6)"))
        plus = lambda start, x: start + F.expr(f"interval 1 {x}")
        end = lambda start: F.when(f["m"].isNull(), plus(start, "year")).when(f["d"].isNull(), plus(start, "month")).when(f["h"].isNull(), plus(start, "day")).when(f["n"].isNull(), plus(start, "hour")).when(f["s"].isNull(), plus(start, "minute")).otherwise(plus(start, "second"))
        return let(start, lambda x: F.struct(x.alias("start"), end(x).alias("end")))

    typed = let(F.trim(text), lambda x: F.when(~x.startswith(mark), x))
    return let(let(let(typed, matched), fields), interval)


def stamp_text(start: Column, end: Column) -> Column:
    """Only the precision that an interval has."""
    seconds = F.timestamp_diff("SECOND", start, end)
    form = lambda p: F.date_format(start, p)
    day = 86400
    return F.when(seconds >= 365 * day, form("yyyy")).when(seconds >= 28 * day, form("yyyy-MM")).when(seconds >= day, form("yyyy-MM-dd")).when(seconds >= 60, form("yyyy-MM-dd HH:mm")).otherwise(form("yyyy-MM-dd HH:mm:ss"))


def parse_length(text: Column) -> Column:
    """Seconds of `90`, `1:30`, `1:30.5`, `1:02:03`, `2 m`, `2min`, `1,5 h`, `45s`; null for anything else."""
    s = F.replace(F.lower(F.trim(text)), F.lit(","), F.lit("."))
    number = r"\+?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?"
    clock = F.aggregate(F.split(s, ":"), F.lit(0.0), lambda acc, x: acc * 60 + F.when(F.trim(x).rlike(f"^{number}$"), F.trim(x).try_cast("double")))
    unit = F.regexp_extract(s, f"^{number}\\s*(min|s|m|h)?$", 3)
    value = F.regexp_extract(s, f"^({number})\\s*(min|s|m|h)?$", 1).try_cast("double")
    return F.when(s.contains(":"), clock).otherwise(value * F.when(unit == "h", 3600.0).when(unit.startswith("m"), 60.0).otherwise(1.0))


def parse_hz(text: Column) -> Column:
    """Hertz of `12000`, `12k`, `12.5 kHz`, `1,5k`, `1 MHz`; null for anything else."""
    s = F.replace(F.lower(F.trim(text)), F.lit(","), F.lit("."))
    pattern = r"^([0-9]+\.?[0-9]*|\.[0-9]+)\s*([km]?)(hz)?$"
    unit = F.regexp_extract(s, pattern, 2)
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1).try_cast("double") * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0))


def human_text(text: Column) -> Column:
    """Lines without those a machine wrote (`sNAME=...`), trimmed and joined by spaces; null if none is left."""
    lines = F.transform(F.split(text, "[\r\n]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.nullif(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike("^[a-z][A-Z0-9_]{1,15}=")), " "), F.lit(""))


def recorder_date(comment: Column) -> Column:
    """The time and date that a recorder's comment first names as `Recorded at 21:30:00 01/05/2024`, day first, in any
    number of digits and precision of time, as text that parse_stamp reads or refuses."""
    p = r"(?sU)^.*?Recorded at \s*(\S+)\s+([^/\s]+)/([^/\s]+)/([^/\s]+)"
    g = lambda i: F.regexp_extract(comment, p, i)
    return F.when(comment.rlike(p), F.concat(g(4), F.lit("-"), g(3), F.lit("-"), g(2), F.lit(" "), g(1)))


def xml_escape(text: Column) -> Column:
    return reduce(lambda s, x: F.replace(s, F.lit(x[0]), F.lit(x[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")), text)


def line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def crlf(text: Column) -> Column:
    return F.replace(line_feeds(text), F.lit("\n"), F.lit("\r\n"))


def stem(name: Column) -> Column:
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(name)


def extension(name: Column) -> Column:
    """What follows the last dot; none where that dot leads the name."""
    return F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)


def letters(n: Column) -> Column:
    """1 as a, 26 as z, 27 as aa; empty for 0 and less."""
    step = lambda acc, _: F.when(acc["n"] <= 0, acc).otherwise(F.struct(F.floor((acc["n"] - 1) / 26).cast("long").alias("n"), F.concat(F.char((97 + (acc["n"] - 1) % 26).cast("int")), acc["s"]).alias("s")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(n.cast("long").alias("n"), F.lit("").alias("s")), step, lambda acc: acc["s"])


#: Roman numerals.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(n: Column) -> Column:
    """Roman numerals of positive numbers; empty for the rest."""
    rest, out = n.cast("long"), F.lit("")
    for value, sign in ROMAN:
        out = F.concat(out, F.repeat(F.lit(sign), F.greatest(F.floor(rest / value), F.lit(0)).cast("int")))
        rest = rest % value
    return F.when(n > 0, out).otherwise("")


def padded(n: Column, width: int) -> Column:
    """A sign and at least `width` digits."""
    digits = F.abs(n).cast("string")
    digits = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(F.when(n < 0, "-").otherwise(""), digits)


def sign_padded(n: Column, width: int) -> Column:
    """A number of at least `width` characters, its sign counted."""
    digits = F.abs(n).cast("string")
    room = F.lit(width) - F.when(n < 0, 1).otherwise(0)
    return F.concat(F.when(n < 0, "-").otherwise(""), F.repeat(F.lit("0"), F.greatest(room - F.length(digits), F.lit(0))), digits)


#: Fields of strftime as patterns of date_format, and fields made of others.
_FIELDS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "j": "DDD", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "3f": "SSS", "6f": "SSSSSS", "9f": "SSSSSSSSS", "f": "SSSSSSSSS"}
_WHOLE = {"F": "%Y-%m-%d", "T": "%H:%M:%S", "X": "%H:%M:%S", "R": "%H:%M", "D": "%m/%d/%y", "x": "%m/%d/%y", "r": "%I:%M:%S %p", ".3f": ".%3f", ".6f": ".%6f", ".9f": ".%9f"}
_NUMBERS = "YymdHIMSjek"


def strftime(when: Column, form: str) -> Column | None:
    """A date by a format of strftime; None if it isn't one. `-` and `_` before a number's field leave its zeros out, or put spaces."""
    import re

    for key, whole in _WHOLE.items():
        form = re.sub(rf"(?<!%)((?:%%)*)%{re.escape(key)}", lambda m, w=whole: m[1] + w, form)
    parts: list[Column] = []
    for text, field in re.findall(r"([^%]+)|%([-_0]?(?:[369]f|[A-Za-z%]))|%", form):
        if text:
            parts.append(F.lit(text))
            continue
        mode, name = (field[0], field[1:]) if field[:1] in ("-", "_", "0") else ("", field)
        if mode and name not in _NUMBERS:
            return None
        if name in ("%", "n", "t"):
            parts.append(F.lit({"%": "%", "n": "\n", "t": "\t"}[name]))
            continue
        if name in ("e", "k"):
            name, mode = {"e": "d", "k": "H"}[name], mode or "_"
        if name not in _FIELDS:
            return None
        value = F.date_format(when, _FIELDS[name])
        if mode in ("-", "_"):
            bare = F.regexp_replace(value, "^0+(?=.)", "")
            value = bare if mode == "-" else F.lpad(bare, len(_FIELDS[name]), " ")
        parts.append(value)
    return F.concat(*parts) if parts else F.lit("")


def title_words(text: Column) -> Column:
    """Each run of letters, digits and apostrophes with its first letter upper, the rest lower."""
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}']+|[^\p{L}\p{N}']+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def beside(a: Column, b: Column, mark: str) -> Column:
    """Both joined by a mark, unless either is empty."""
    return F.concat(a, F.when((a == "") | (b == ""), "").otherwise(mark), b)


def inserted(text: Column, piece: Column, place: Column) -> Column:
    """A piece before the place-th character, counted from 1; at the end beyond it."""
    at = F.least(place, F.length(text) + 1)
    return F.concat(F.substring(text, F.lit(1), at - 1), piece, F.substring(text, at, F.length(text)))


def name_problem(name: Column) -> Column:
    """The first rule that a file name breaks; null for a good one."""
    return (
        F.when(name.rlike(r"(?U)^\s*\z"), "empty").when(name.rlike(r"(?U)^\s|\s\z"), "edge space").when(name.startswith("."), "leading dot")
        .when(name.rlike(r"[/\\:\x00-\x1f\x7f-\x9f]"), "reserved").when(F.octet_length(name) > 255, "too long")
    )


def mask_pattern(masks: str) -> str:
    """Masks with * and ?, separated by semicolons, as one anchored pattern, in any case."""
    import re

    one = lambda m: "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in m)
    return "(?isu)^(?:" + "|".join(one(m.strip()) for m in masks.split(";") if m.strip()) + ")$"


def chapter_key(key: Column) -> tuple[Column, Column]:
    """The number and part of a chapter field's key, in any case; nulls for other keys."""
    p = r"(?i)^CHAPTER([0-9]+)(NAME|NOTE|END)?$"
    return F.when(key.rlike(p), F.regexp_extract(key, p, 1).try_cast("long")), F.when(key.rlike(p), F.upper(F.regexp_extract(key, p, 2)))


def comment_key(key: Column) -> Column:
    """A key with what a comment key may not hold (= and all outside space to }) as underscores; one for none."""
    return F.when(key == "", "_").otherwise(F.regexp_replace(key, r"[^ -<>-}]", "_"))


def number_split(text: Column) -> tuple[Column, Column]:
    """`3/12` as number and total, where both are digits; any other text is a number without a total."""
    p = r"(?U)^\s*([0-9]+)\s*/\s*([0-9]+)\s*$"
    both = text.rlike(p)
    return F.when(both, F.regexp_extract(text, p, 1)).otherwise(text), F.when(both, F.regexp_extract(text, p, 2))


def query_words(text: str) -> list[str]:
    """The words of a search: split at white space, quotes that lead a word hold it together as it is, leading stars go,
    lower case; blank words are none."""
    import re

    found = [a if q else b for q, a, b in re.findall(r'(")([^"]*)"?|(\S+)', text)]
    return [w for w in (x.lstrip("*").lower() for x in found) if w.strip()]


def words_of(text: Column) -> Column:
    """query_words of a column of searches, as an array."""
    found = F.regexp_extract_all(text, F.lit(r'(?U)"[^"]*"?|\S+'), F.lit(0))
    bare = F.transform(found, lambda w: F.lower(F.regexp_replace(F.regexp_replace(w, r'^"([^"]*)"?$', "$1"), r"^\*+", "")))
    return F.filter(bare, lambda w: ~w.rlike(r"(?U)^\s*$"))
