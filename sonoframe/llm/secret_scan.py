"""Secret scans by two character Markov models, in DataFrame functions only.

Three base patterns find assignments, access keys and long hexadecimal runs. The method adds tokens of 20 or more
characters whose log-likelihood ratio under two character-pair models, of random strings and of ordinary
identifiers, passes a threshold set on held-out samples; both models are counted from labelled samples by grouping,
and hold at most 67 * 67 ratios whatever the samples' size.

Positions come from the lengths of what lies between matches, as code points. A document without any trigger word
or run is not split at all. All steps take time in proportion to a text and its matches, however many it has.

Defined results: a null text counts as empty; documents without secrets have zero counts and an empty list; every
row gives one row. Only id and text columns are read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_column

KINDS = ("assign", "access", "hex", "markov")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ONE = "struct<start:int,kind:int,end:int>"
SPAN = f"array<{ONE}>"
#: The score that a token has to pass where no samples are held out, and the share of ordinary ones that must not.
LEAST, QUANTILE = 10.0, 0.9995
#: The kind of the model's spans.
MODEL = 3
#: Items that one array grows by at most, and code points of a piece of a text that is cut.
CHUNK, PIECE = 256, 4096


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _scan(items: Column, state: Column, out: str, step, last: bool = False) -> Column:
    """The outputs of step(state, item), a struct (state, out), from the first item to the last; or the last state.

    Arrays grow by copying, so outputs are gathered CHUNK at a time: the time is in proportion to the items.
    """
    chunks = _let(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / CHUNK).cast("int")), lambda k: F.slice(x, k * CHUNK + 1, F.lit(CHUNK))))
    none = F.array().cast(f"array<{out}>")

    def one(acc: Column, item: Column) -> Column:
        return _let(step(acc["state"], item), lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def many(acc: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return _let(inner, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["outs"], F.array(x["out"])).alias("outs")))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{out}>>").alias("outs"))
    return F.aggregate(chunks, start, many, lambda acc: acc["state"] if last else F.flatten(acc["outs"]))


def _spans(text: Column, pattern: str, kind: int, holds: Column | None = None) -> Column:
    """Every match of a pattern as (start, kind, end), except those whose entry in `holds` is false."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    step = F.zip_with(between, found, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("size")))
    if holds is not None:
        step = F.zip_with(step, holds, lambda x, ok: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), ok.alias("ok")))
    else:
        step = F.transform(step, lambda x: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.lit(True).alias("ok")))

    def add(at: Column, x: Column) -> Column:
        first = at + x["gap"]
        end = first + F.coalesce(x["size"], F.lit(0))
        keep = x["size"].isNotNull() & F.coalesce(x["ok"], F.lit(False))
        return F.struct(end.alias("state"), F.when(keep, F.struct(first.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))).alias("out"))

    return F.filter(_scan(step, F.lit(0), ONE, add), lambda x: x.isNotNull()).cast(SPAN)


def _apart(base: Column, found: Column) -> Column:
    """Those of `found` that overlap none of `base`, and all of `base`, sorted."""
    def ahead(reach: Column, x: Column) -> Column:  # how far the base spans before it reach
        far = F.when(x["kind"] < MODEL, F.greatest(reach, x["end"])).otherwise(reach)
        return F.struct(far.alias("state"), F.when((x["kind"] < MODEL) | (x["start"] >= reach), x).alias("out"))

    def behind(nearest: Column, x: Column) -> Column:  # where the next base span begins
        near = F.when(x["kind"] < MODEL, x["start"]).otherwise(nearest)
        return F.struct(near.alias("state"), F.when((x["kind"] < MODEL) | (x["end"] <= nearest), x).alias("out"))

    kept = F.filter(_scan(F.sort_array(F.concat(base, found)), F.lit(0), ONE, ahead), lambda x: x.isNotNull())
    kept = F.filter(_scan(F.reverse(kept), F.lit(2**31 - 1), ONE, behind), lambda x: x.isNotNull())
    return F.reverse(kept).cast(SPAN)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, random over ordinary, from samples (token, random boolean)."""
    k = len(ALPHABET)
    code = F.transform(F.split("token", ""), lambda c: F.position(c, F.lit(ALPHABET)))
    pairs = samples.where(F.col("token").isNotNull()).select("random", code.alias("codes"))
    each = F.explode(F.transform(F.slice("codes", 2, F.greatest(F.size("codes") - 1, F.lit(0))), lambda b, i: F.struct(F.get("codes", i).alias("a"), b.alias("b"))))
    counts = pairs.select("random", each.alias("x")).where("x.a > 0 and x.b > 0").groupBy("random", "x.a", "x.b").count()
    n = {(r["random"], r["a"], r["b"]): r["count"] for r in counts.collect()}  # at most 2 * 67 * 67 rows
    total: dict = {}
    for (random, a, _), c in n.items():
        total[random, a] = total.get((random, a), 0) + c
    p = lambda random, a, b: math.log((n.get((random, a, b), 0) + 0.5) / (total.get((random, a), 0) + 0.5 * k))
    return [p(True, a, b) - p(False, a, b) for a in range(1, k + 1) for b in range(1, k + 1)]


def _score(ratios: list[float]):
    """The log-likelihood ratio of a token column, as a function."""
    k = len(ALPHABET)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def ratio(token: Column) -> Column:
        codes = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
        last = F.struct(F.lit(-1).alias("a"), F.lit(0.0).alias("sum"))
        add = lambda acc, b: F.struct(b.alias("a"), (acc["sum"] + F.when((acc["a"] >= 0) & (b >= 0), F.get(table, acc["a"] * k + b)).otherwise(0.0)).alias("sum"))
        return F.aggregate(codes, last, add, lambda acc: acc["sum"])

    return ratio


def fit(samples: DataFrame) -> tuple[list[float], float]:
    """The ratios, from four fifths of the samples, and the score that the held-out fifth asks for.

    It is the one that QUANTILE of the held-out ordinary tokens of 20 characters or more stay under, never so high
    that a twentieth of the held-out random ones would be missed; LEAST where nothing is held out.
    """
    held = F.pmod(F.xxhash64("token"), F.lit(5)) == 0
    ratios = train(samples.where(~held))
    scored = samples.where(held & (F.length("token") >= 20)).select("random", _score(ratios)(F.col("token")).alias("score"))
    of = lambda random, q: F.percentile_approx(F.when(F.col("random") == random, F.col("score")), q, 10000)
    ordinary, random = scored.agg(of(False, QUANTILE), of(True, 0.05)).first()
    return ratios, LEAST if ordinary is None or random is None else min(max(ordinary, 0.0), random)


def labelled_samples(ordinary: DataFrame, text_col: str = "text", n_random: int = 6000) -> DataFrame:
    """Labelled training tokens: hashes written in three alphabets, and three words of trusted text joined as identifiers and paths."""
    spark = ordinary.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    kind, size = F.col("id") % 3, (20 + F.col("id") % 21).cast("int")
    base64 = F.base64(F.unhex(digest))
    token = F.when(kind == 0, digest).when(kind == 1, base64).otherwise(F.translate(F.upper(base64), "+/=", "X7Q"))
    random = spark.range(n_random).select(F.substring(token, F.lit(1), size).alias("token"), F.lit(True).alias("random"))
    words = F.filter(F.split(F.coalesce(text_col, F.lit("")), "[^A-Za-z]+"), lambda w: w != "")
    base = ordinary.select(words.alias("w"))
    joined = lambda mark: F.transform("w", lambda x, i: F.array_join(F.slice("w", i + 1, 3), mark))
    camel = F.transform(joined(" "), lambda x: F.regexp_replace(F.initcap(x), " ", ""))
    tokens = F.concat(joined("_"), joined("-"), joined("/"), joined(""), camel)
    return random.unionByName(base.select(F.explode(tokens).alias("token"), F.lit(False).alias("random")))


def with_spans(docs: DataFrame, ratios: list[float], least: float = LEAST, text: str = "text", out: str = "spans") -> DataFrame:
    """docs with a column of spans, sorted (start, kind, end); least: the log-likelihood ratio that a token has to pass."""
    low, t = F.lower(F.col(text)), F.col(text)
    named = F.lit(False)
    for word in WORDS:
        named = named | low.contains(word)
    none = F.array().cast(SPAN)
    values = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    docs = docs.withColumn("_assign", F.when(named, _spans(t, ASSIGN, 0, values)).otherwise(none))
    docs = docs.withColumn("_access", F.when(t.contains("AKIA"), _spans(t, ACCESS, 1)).otherwise(none))
    # a run of 24 hexadecimal digits or a long token lies within a run of 20 token characters or more
    docs = docs.withColumn("_tokens", F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)))
    long_ = F.size("_tokens") > 0
    docs = docs.withColumn("_hex", F.when(long_, _spans(t, HEX, 2)).otherwise(none))
    docs = docs.withColumn("_base", F.sort_array(F.concat("_assign", "_access", "_hex")))
    ratio = _score(ratios)
    docs = docs.withColumn("_random", F.transform("_tokens", lambda x: ratio(x) >= least))
    docs = docs.withColumn("_found", F.when(F.exists("_random", lambda x: x), _spans(t, TOKEN, 3, F.col("_random"))).otherwise(none))
    both = F.when(F.size("_found") == 0, F.col("_base")).otherwise(_apart(F.col("_base"), F.col("_found")))
    return docs.withColumn(out, both).drop("_assign", "_access", "_hex", "_tokens", "_random", "_found", "_base")


def written(spans: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans (kind:start:end, comma-joined) of each row."""
    docs = text_column(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    docs = with_spans(docs, *fit(samples))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return docs.select("doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, samples: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every secret in `text` replaced by a mark, overlapping ones by one; n_chars follows."""
    columns = docs.columns
    ratios, least = fit(samples)
    docs = with_spans(docs, ratios, least, out="_secrets")
    text, any_ = F.col("text"), F.size("_secrets") > 0
    docs = docs.withColumn("_pieces", F.when(any_, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def between(a: Column, b: Column) -> Column:
        """The text from a to b (none: to its end): of one piece, or the ends of two and all between."""
        piece = lambda at: F.get("_pieces", F.floor(at / PIECE).cast("int"))
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        far = F.concat(F.substring(piece(a), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice("_pieces", i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.substring(piece(b), F.lit(1), b % PIECE), F.lit("")))
        return F.when(i == j, F.substring(piece(a), a % PIECE + 1, b - a)).otherwise(far)

    def fresh(at: Column, x: Column) -> Column:  # overlapping secrets get one mark
        new = F.when(x["start"] >= at, F.struct(at.alias("from"), x["start"].alias("to")))
        return F.struct(F.greatest(at, x["end"]).alias("state"), new.alias("out"))

    gaps = F.filter(_scan(F.col("_secrets"), F.lit(0), "struct<from:int,to:int>", fresh), lambda x: x.isNotNull())
    kept = F.transform(gaps, lambda x: F.concat(F.when(x["from"] < x["to"], between(x["from"], x["to"])).otherwise(""), F.lit(mark)))
    ends = F.struct(F.array_max(F.transform("_secrets", lambda x: x["end"])).alias("a"), F.length(text).alias("b"))
    tail = _let(ends, lambda x: F.when(x["a"] < x["b"], between(x["a"], x["b"])).otherwise(""))
    clean = F.concat(F.array_join(kept, ""), tail)
    docs = docs.withColumn("text", F.when(any_, clean).otherwise(text))
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.when(any_, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return docs.select(*columns)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"), labelled_samples(read_table(spark, sf_dir, "benchmark")))
