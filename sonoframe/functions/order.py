"""Natural order: digit runs compare by value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(text: Column) -> Column:
    """A string whose plain order is the natural order of `text`: each digit run is led by its length.

    Digit runs of up to 999,999 digits; leading zeros don't count.
    """
    parts = F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda x: F.regexp_replace(x, "^0+", "")
    keyed = lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits(x)).cast("string"), 6, "0"), digits(x))).otherwise(x)
    return F.array_join(F.transform(parts, keyed), "")


def natural_key_sql(text: str) -> str:
    return f"""array_to_string(list_transform(regexp_extract_all({text}, '[0-9]+|[^0-9]+'), lambda x: case when x ~ '[0-9]+' then '0' || lpad(length(ltrim(x, '0'))::varchar, 6, '0') || ltrim(x, '0') else x end), '')"""
