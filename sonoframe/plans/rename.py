"""Bulk renames: twelve rules in a fixed order as column expressions, running numbers as windows, collisions as joins."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.order import natural_key

#: Latin letters with a stroke, without a dot or with one beside them, and what stands for them.
STRUCK = {"Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ł": "L", "ł": "l", "Ŀ": "L", "ŀ": "l", "Ø": "O", "ø": "o", "Ŧ": "T", "ŧ": "t"}
#: Latin letters (U+00C0 to U+017F) and what stands for them: their base letter, where they are one with a mark.
UNACCENTED = {c: d[0] for c in map(chr, range(0xC0, 0x180)) if len(d := unicodedata.normalize("NFD", c)) == 2} | STRUCK


@dataclass(frozen=True)
class Rules:
    """What a rename does, in the order it is done; defaults do nothing. Names are stems, without extensions."""

    pattern: str = ""  # a regular expression, and what replaces its matches (\1 or $1 for groups)
    replacement: str = ""
    name: str = "keep"  # keep, remove, fixed, reverse
    fixed: str = ""
    find: str = ""  # plain text, and what replaces it
    put: str = ""
    any_case: bool = False
    case: str = "same"  # same, lower, upper, title, sentence
    spelled: tuple[str, ...] = ()  # words to keep as spelled here
    first: int = 0  # characters to drop
    last: int = 0
    cut: tuple[int, int] = (0, 0)  # from, to; counted from 1
    chars: str = ""
    words: tuple[str, ...] = ()
    crop: tuple[str, str] = ("", "")  # before or after, text
    digits: bool = False
    accents: bool = False
    symbols: bool = False
    non_ascii: bool = False
    double_spaces: bool = False
    trim: bool = False
    lead_dots: bool = False
    move: tuple[str, int, str | int, str] = ("", 0, "", "")  # first, last, copy first or copy last, n, start, end or a place, mark
    word_space: bool = False
    insert: tuple[str, int] = ("", 0)
    insert_number: tuple[int, int, int, int] = (0, 0, 1, 0)  # place, from, step, digits
    prefix: str = ""
    suffix: str = ""
    date: tuple[str, str, str] = ("", "", "_")  # prefix or suffix, format as of strftime, mark
    date_of: str = "recorded"  # the column of that date (recorded, modified, created), or now
    or_modified: bool = False  # takes column `modified` where `recorded` is unknown
    now: datetime | None = None  # the moment of `now`; that of the run if none is given
    folders: tuple[str, int, str] = ("", 1, "-")  # prefix or suffix, levels, mark
    number: tuple[str | int, int, int, int, str] = ("", 1, 1, 0, "_")  # prefix, suffix, both or a place, from, step, digits, mark
    numerals: str = "decimal"  # decimal, letters, upper (letters), roman
    restart_after: int = 0  # a new number run where these first characters change
    restart_folder: bool = False
    extension: str = "same"  # same, lower, upper, title, remove, fixed, extra
    fixed_extension: str = ""


def group_references(replacement: str, groups: int) -> str:
    """A replacement with \\1, $1 or ${1} as Spark wants it; groups that the pattern lacks are empty."""
    out, at = [], 0
    for m in re.finditer(r"\\(\d)|\$(\d)|\$\{(\d)\}", replacement):
        n = int(next(x for x in m.groups() if x))
        out += [replacement[at : m.start()].replace("\\", "\\\\").replace("$", "\\$"), f"${n}" if n <= groups else ""]
        at = m.end()
    return "".join([*out, replacement[at:].replace("\\", "\\\\").replace("$", "\\$")])


def groups(pattern: str) -> int:
    """How many groups of a pattern capture."""
    bare = re.sub(r"\\Q.*?(?:\\E|$)|\\.|\[(?:\\.|[^\]\\])*\]", "", pattern, flags=re.S)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


def broken(spark: SparkSession, rules: Rules) -> bool:
    """Whether rules can't be followed: a pattern that isn't one, or a date's format."""
    if rules.date[0] and T.strftime(F.lit(None).cast("timestamp_ntz"), rules.date[1]) is None:
        return True
    try:
        spark.range(1).select(F.regexp_replace(F.lit("x"), F.lit("(?U)" + rules.pattern), F.lit(""))).collect()
    except Exception:
        return True
    return False


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def renamed(stem: Column, rules: Rules) -> Column:
    """The rules that need nothing but the stem, in order."""
    s = stem
    if rules.pattern:
        s = F.regexp_replace(s, F.lit("(?U)" + rules.pattern), F.lit(group_references(rules.replacement, groups(rules.pattern))))
    s = {"keep": s, "remove": F.lit(""), "fixed": F.lit(rules.fixed), "reverse": F.reverse(s)}[rules.name]
    if rules.find:
        s = F.regexp_replace(s, F.lit(("(?iu)" if rules.any_case else "") + _quoted(rules.find)), F.lit(rules.put.replace("\\", "\\\\").replace("$", "\\$")))
    sentence = F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))
    s = {"same": s, "lower": F.lower(s), "upper": F.upper(s), "title": T.title_words(s), "sentence": sentence}[rules.case]
    for word in rules.spelled:
        s = F.regexp_replace(s, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}']){_quoted(word)}(?![\p{{L}}\p{{N}}'])"), F.lit(word))
    return _moved(_removed(s, rules), rules)


def _removed(s: Column, rules: Rules) -> Column:
    if rules.first:
        s = F.substring(s, F.lit(rules.first + 1), F.length(s))
    if rules.last:
        s = F.substring(s, F.lit(1), F.greatest(F.length(s) - rules.last, F.lit(0)))
    if 0 < rules.cut[0] <= rules.cut[1]:
        s = F.concat(F.substring(s, F.lit(1), F.lit(rules.cut[0] - 1)), F.substring(s, F.lit(rules.cut[1] + 1), F.length(s)))
    if rules.chars:
        s = F.translate(s, rules.chars, "")
    for word in rules.words:
        s = F.regexp_replace(s, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}']){_quoted(word)}(?![\p{{L}}\p{{N}}'])"), F.lit(""))
    if rules.crop[1]:
        at = F.locate(rules.crop[1].lower(), F.lower(s))
        kept = F.substring(s, at, F.length(s)) if rules.crop[0] == "before" else F.substring(s, F.lit(1), at - 1 + len(rules.crop[1]))
        s = F.when(at > 0, kept).otherwise(s)
    for on, pattern in ((rules.digits, "[0-9]"),):
        s = F.regexp_replace(s, pattern, "") if on else s
    if rules.accents:
        s = F.translate(s, "".join(UNACCENTED), "".join(UNACCENTED.values()))
    for on, pattern, put in ((rules.symbols, r"[^\p{IsAlphabetic}\p{N} _-]", ""), (rules.non_ascii, r"[^\x00-\x7f]", ""), (rules.double_spaces, " {2,}", " "), (rules.trim, r"(?U)^\s+|\s+\z", ""), (rules.lead_dots, r"^\.+", "")):
        s = F.regexp_replace(s, pattern, put) if on else s
    return s


def _moved(s: Column, rules: Rules) -> Column:
    part, n, to, mark = rules.move
    if part and n > 0:
        piece, rest = F.substring(s, 1, n), F.substring(s, F.lit(n + 1), F.length(s))
        if part.endswith("last"):
            piece, rest = F.right(s, F.lit(n)), F.substring(s, F.lit(1), F.greatest(F.length(s) - n, F.lit(0)))
        rest, between = s if part.startswith("copy") else rest, F.lit(mark)
        if isinstance(to, int):
            s = T.inserted(rest, F.concat(between, piece, between), F.lit(max(to, 1)))
        else:
            s = F.concat(rest, between, piece) if to == "end" else F.concat(piece, between, rest)
    if rules.word_space:
        s = F.regexp_replace(s, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", " ")
    if rules.insert[1]:
        s = T.inserted(s, F.lit(rules.insert[0]), F.lit(rules.insert[1]))
    return s


def _numeral(n: Column, kind: str, digits: int) -> Column:
    """A number with its sign: padded digits, letters as of spreadsheet columns, or Roman numerals."""
    if kind == "decimal":
        return T.padded(n, digits)
    text = {"letters": T.letters, "upper": lambda x: F.upper(T.letters(x)), "roman": T.roman}[kind](F.abs(n))
    return F.concat(F.when(n < 0, "-").otherwise(""), text)


def plan(files: DataFrame, rules: Rules, batch: str = "batch") -> DataFrame:
    """Of files (batch, place, folder, name, chosen, and the dates that the rules name): the new name of each chosen one, and what is wrong with it.

    place orders a batch. Numbers run over a batch's chosen files; a run restarts where the first characters, or the
    folder, differ from the file before. Rules with a pattern or a date's format that isn't one change nothing, and are
    each file's problem. Problems, the first that holds: the rules, no date, an invalid name, a name that two
    changing files share, a name that a file which stays has. Names compare in lower case, with their folders.
    """
    if broken(files.sparkSession, rules):
        return files.where("chosen").withColumn("new_name", F.col("name")).withColumn("changing", F.lit(False)).withColumn("problem", F.lit("rules"))
    order = Window.partitionBy(batch).orderBy("place")
    rows = files.where("chosen").withColumn("stem", renamed(T.stem(F.col("name")), rules)).withColumn("ext", T.extension(F.col("name")))
    place, first, step, digits = rules.insert_number
    if place:
        rows = rows.withColumn("stem", T.inserted(F.col("stem"), T.sign_padded(F.lit(first) + step * (F.row_number().over(order) - 1), digits), F.lit(place)))
    rows = rows.withColumn("stem", F.concat(F.lit(rules.prefix), "stem", F.lit(rules.suffix)))
    put = lambda side, text, mark: T.beside(text, F.col("stem"), mark) if side == "prefix" else T.beside(F.col("stem"), text, mark)
    dated = F.lit(True)
    if rules.date[0]:
        when = F.lit(rules.now or datetime.now()).cast("timestamp_ntz") if rules.date_of == "now" else F.col(rules.date_of)
        if rules.or_modified and rules.date_of == "recorded":
            when = F.coalesce(when, F.col("modified"))
        dated = when.isNotNull()
        rows = rows.withColumn("stem", put(rules.date[0], F.coalesce(T.strftime(when, rules.date[1]), F.lit("")), rules.date[2]))
    if rules.folders[0]:
        names = F.filter(F.split("folder", "/"), lambda x: x != "")
        levels = F.slice(names, -F.least(F.lit(rules.folders[1]), F.size(names)), F.lit(rules.folders[1]))
        rows = rows.withColumn("stem", put(rules.folders[0], F.when(F.size(names) > 0, F.array_join(levels, rules.folders[2])).otherwise(""), rules.folders[2]))
    rows = rows.withColumn("dated", dated)
    if rules.number[0]:
        side, first, step, digits, mark = rules.number
        taken = rows.where("dated")  # files without a date use up no number
        changes = F.lit(False)
        if rules.restart_after:
            key = F.substring("stem", 1, rules.restart_after)
            changes = changes | (key != F.lag(key).over(order))
        if rules.restart_folder:
            changes = changes | (F.col("folder") != F.lag("folder").over(order))
        taken = taken.withColumn("fresh", F.coalesce(changes, F.lit(False)).cast("int")).withColumn("run", F.sum("fresh").over(order))
        k = F.row_number().over(Window.partitionBy(batch, "run").orderBy("place")) - 1
        number = _numeral(F.lit(first) + step * k, rules.numerals, digits)
        numbered = T.inserted(F.col("stem"), number, F.lit(max(side, 1))) if isinstance(side, int) else put(side, number, mark)
        if side == "both":
            ahead = T.beside(number, F.col("stem"), mark)
            numbered = T.beside(ahead, number, mark)
        rows = taken.withColumn("stem", numbered).drop("fresh", "run").unionByName(rows.where("not dated"))
    own, given = F.col("ext"), F.lit(rules.fixed_extension.lstrip("."))
    ext = {
        "same": own, "lower": F.lower(own), "upper": F.upper(own), "title": F.concat(F.upper(F.substring(own, 1, 1)), F.lower(F.substring(own, F.lit(2), F.length(own)))),
        "remove": F.lit(""), "fixed": given, "extra": F.when(own == "", given).otherwise(F.concat(own, F.lit("."), given)),
    }[rules.extension]
    rows = rows.withColumn("new_name", F.concat("stem", F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))))
    return checked(rows.select(*files.columns, "new_name", "dated"), files, batch)


def checked(rows: DataFrame, files: DataFrame, batch: str = "batch") -> DataFrame:
    """Planned rows with `problem`, null where there is none; files are all files of the batches."""
    path = lambda name: F.lower(F.concat_ws("/", "folder", name))
    changing = F.col("new_name") != F.col("name")
    bad = F.when(~F.col("dated"), "no date").otherwise(F.when(T.name_problem(F.col("new_name")).isNotNull(), "invalid"))
    rows = rows.withColumn("target", path("new_name")).withColumn("changing", changing)
    rows = rows.withColumn("sharing", F.sum(F.col("changing").cast("int")).over(Window.partitionBy(batch, "target")))
    duplicate = F.col("changing") & (F.col("sharing") > 1) | ~F.col("changing") & (F.col("sharing") > 1)
    leaving = rows.where(F.col("changing") & bad.isNull()).select(batch, path("name").alias("target"))
    staying = files.select(batch, path("name").alias("target")).join(leaving, [batch, "target"], "left_anti").distinct().withColumn("exists", F.lit(True))
    rows = rows.join(staying, [batch, "target"], "left")
    problem = F.coalesce(bad, F.when(duplicate, "duplicate"), F.when(F.col("changing") & F.col("exists"), "exists"))
    return rows.withColumn("problem", problem).drop("target", "sharing", "exists", "dated")


def ordered(listing: DataFrame, by: str, descending: bool = False) -> list[Column]:
    """The order of a listing by name, size or date, then naturally by name; unknown first; descending turns all of it."""
    keys = [natural_key(F.lower("name")), F.col("name")]
    keys = keys if by == "name" else [F.col(by), *keys]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def counts(planned: DataFrame, batch: str = "batch") -> DataFrame:
    return planned.groupBy(batch).agg(F.count("*").alias("chosen"), F.count_if("changing").alias("changing"), F.count("problem").alias("problems"))


def undone(planned: DataFrame) -> DataFrame:
    """A plan that takes a finished one back."""
    return planned.where("changing and problem is null").select("batch", "folder", F.col("new_name").alias("name"), F.col("name").alias("new_name"))



