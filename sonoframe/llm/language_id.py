"""Language identification by Bayesian evidence fusion.

The posterior of a language adds up three kinds of evidence: the text's likelihood under byte-trigram models, the
declared language's likelihood given the true one, and a prior from the host, smoothed towards its address suffix's
and that towards the whole corpus's. The declared language's and the priors' tables are grouped counts of the
languages that texts alone show, over all rows but the one judged: its text speaks once. All but the likelihood is
the same for rows with the same host, declaration and shown language, so it is computed once for each such group,
and only small rows without text are joined with it, hot hosts dealt to many tasks.

The trigram models are fitted on SAMPLE to 2 SAMPLE expected declared rows of each language (all, where it has
fewer), taken by a hash of the id. A language is what LEAST rows with text declare, or LEAST_SHARE of them in a small
table; the LANGUAGES of most rows have a model, whatever other tags there are, so that models, tables and what
reaches the driver are bounded. Rows of other declarations are judged like rows without one, but `keep_identified`
never drops or renames them: nothing is known about their language. A row is accepted if it has text, its best language's posterior is at least 0.6, and that language's model
explains the text better than equally likely trigrams do: a text in a language without a model is rejected.

Defined results: null texts count as empty; empty texts have no language of their own, get the one the other
evidence names and are rejected; null or unknown declarations are evidence for nothing; null hosts share one prior.
Every row gives one row, repeated ones too. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, slices, spread_join, text_column

BINS = 1 << 15
#: Expected declared rows, at least, that a language's trigram model is fitted on if it has as many.
SAMPLE = 1000
#: How many rows of all have to declare a language for it to count as one, or which share of them if that is less.
LEAST, LEAST_SHARE = 5, 0.005
#: Languages with a model, those that most rows declare.
LANGUAGES = 64
#: Overlapping trigrams repeat each other's evidence: each counts for a third.
TEMPER = 1 / 3
#: Pseudo-counts with which a host leans on its suffix, and a suffix on the corpus.
LEAN = 10.0
ACCEPT = 0.6
EVIDENCE = ["suffix", "host", "declared", "text_lang"]


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each byte trigram (letters A-Z as a-z), and each text's range of trigrams in them."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    key = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    inside = np.ones(len(key), dtype=bool)
    for back in (1, 2):
        edge = offsets[1:-1] - back
        inside[edge[(edge >= 0) & (edge < len(key))]] = False
    own = np.flatnonzero(inside)
    return ((key[own] * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64), np.searchsorted(own, offsets)


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-likelihood of each trigram bin under each, from rows (text, declared)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                bins, first = _trigrams(data, offsets)
                names = part.column(1).to_pylist()
                for name in sorted(set(names)):
                    own = np.concatenate([bins[first[i] : first[i + 1]] for i, x in enumerate(names) if x == name])
                    values, n = np.unique(own, return_counts=True)
                    docs = names.count(name)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (len(n) + 1)), pa.array([-1, *values], pa.int32()), pa.array([docs, *n], pa.int64())], ["lang", "bin", "n"])

    counts = rows.select("text", "declared").mapInArrow(work, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = counts.toPandas()  # at most 32,769 rows a language, of a bounded sample
    langs = sorted(table.lang.unique())
    ratio = np.full((len(langs), BINS), 0.5)
    for i, name in enumerate(langs):
        own = table[(table.lang == name) & (table.bin >= 0)]
        ratio[i, own.bin.to_numpy()] += own.n.to_numpy()
    return langs, np.log(ratio / ratio.sum(1, keepdims=True)).astype(np.float32)


def _likelihoods(rows: DataFrame, model: np.ndarray) -> DataFrame:
    table = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = table.value
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                bins, first = _trigrams(data, offsets)
                out = np.zeros((part.num_rows, len(logs)))
                for i, row in enumerate(logs):
                    total = np.concatenate([[0.0], np.cumsum(row[bins], dtype=np.float64)])
                    out[:, i] = total[first[1:]] - total[first[:-1]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(logs)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(np.diff(first)), lists], ["doc_id", "declared", "host", "suffix", "n_grams", "likelihoods"])

    return rows.select("doc_id", "text", "declared", "host", "suffix").mapInArrow(work, "doc_id long, declared string, host string, suffix string, n_grams long, likelihoods array<double>")


def _best(scores: str | Column, langs: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, langs)), F.array_position(scores, F.array_max(scores)).cast("int"))


def identify(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, text, declared, host, suffix): doc_id, lang, confidence, accepted, text_lang."""
    return _identified(rows)[0]


def _identified(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """identify(), and the languages that have a model."""
    rows = text_column(rows).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "declared", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("suffix", F.lit("")).alias("suffix"))
    declared = rows.where("declared <> '' and octet_length(text) >= 3")
    told = declared.groupBy("declared").agg(F.count("*").alias("of_lang")).where(F.col("of_lang") >= min(LEAST, LEAST_SHARE * declared.count()))
    told = told.orderBy(F.desc("of_lang"), "declared").limit(LANGUAGES)
    every = F.greatest(F.lit(1), F.floor(F.col("of_lang") / SAMPLE))
    langs, model = fit(declared.join(F.broadcast(told), "declared").where(F.pmod(F.xxhash64("doc_id"), every) == 0))
    if not langs:
        return rows.select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("text_lang")), langs
    seen = _likelihoods(rows, model)
    chance = F.col("n_grams") * float(-np.log(BINS))  # of the text, were all trigrams equally likely
    shown = F.when(F.col("n_grams") > 0, _best("likelihoods", langs)).otherwise("")
    known = F.when(F.col("declared").isin(langs), F.col("declared")).otherwise("")
    seen = materialise(seen.withColumn("text_lang", shown).withColumn("declared", known), "likelihoods")
    # one small table of counts by (suffix, host, declared, language shown) gives all other evidence
    combos = materialise(seen.groupBy(*EVIDENCE).count(), "counts")
    known = combos.where("text_lang <> ''")
    array = F.array(*[F.coalesce(F.col(f"`{x}`"), F.lit(0)).cast("double") for x in langs])
    by = lambda name, *keys: known.groupBy(*keys).pivot("text_lang", langs).agg(F.sum("count")).select(*keys, array.alias(name))
    whole = by("n").first()
    whole = list(whole["n"]) if whole else [0.0] * len(langs)
    told = {r["declared"]: r["n"] for r in by("n", "declared").where(F.col("declared").isin(langs)).collect()}  # a row for each language
    said = [(d, list(told.get(d, [0.0] * len(langs)))) for d in langs]
    said = F.broadcast(rows.sparkSession.createDataFrame(said, "declared string, of_declared array<double>"))
    every = F.array(*[F.lit(float(sum(n[i] for n in told.values()))) for i in range(len(langs))])
    combos = combos.join(by("of_suffix", "suffix"), "suffix", "left").join(by("of_host", "suffix", "host"), ["suffix", "host"], "left").join(said, "declared", "left")
    own = F.transform(F.array(*map(F.lit, langs)), lambda x: (x == F.col("text_lang")).cast("double"))
    combos = combos.withColumn("own", own)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    others = lambda n: F.zip_with(F.coalesce(n, F.array(*[F.lit(0.0)] * len(langs))), "own", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    lean = lambda n, prior: F.zip_with(n, prior, lambda x, p: (x + LEAN * p) / (total(n) + LEAN))
    combos = combos.withColumn("base", others(F.array(*map(F.lit, whole)))).withColumn("base", F.transform("base", lambda x: (x + 1) / (total(F.col("base")) + len(langs))))
    combos = combos.withColumn("of_suffix", others(F.col("of_suffix"))).withColumn("of_host", others(F.col("of_host")))
    combos = combos.withColumn("of_suffix", lean(F.col("of_suffix"), F.col("base"))).withColumn("prior", lean(F.col("of_host"), F.col("of_suffix")))
    given = F.zip_with(others(F.col("of_declared")), others(every), lambda x, n: F.log((x + 1) / (n + len(langs))))
    given = F.when(F.col("of_declared").isNotNull(), given).otherwise(F.array(*[F.lit(0.0)] * len(langs)))
    combos = combos.select(*EVIDENCE, F.zip_with(given, "prior", lambda x, p: x + F.log(p)).alias("evidence"))
    out = spread_join(seen, combos, EVIDENCE)  # a host of many rows is dealt to many tasks
    score = F.zip_with("likelihoods", "evidence", lambda a, b: a * TEMPER + b)
    out = out.withColumn("score", score).withColumn("top", F.array_max("score"))
    confidence = 1 / F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    out = out.withColumn("confidence", confidence).withColumn("lang", _best("score", langs))
    explained = F.element_at("likelihoods", F.array_position("score", F.col("top")).cast("int")) >= chance
    return out.select("doc_id", "lang", "confidence", ((F.col("confidence") >= ACCEPT) & (F.col("n_grams") > 0) & explained).alias("accepted"), F.nullif("text_lang", F.lit("")).alias("text_lang")), langs


def document_evidence(docs: DataFrame) -> DataFrame:
    """documents as evidence: the lang column is the declaration, the source the host; what follows its last dot, if any, the suffix."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.regexp_extract("source", r"\.([^.]*)$", 1).alias("suffix"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """pages as evidence: the html element's lang, the address's host and its last label; text without scripts and tags."""
    bare = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")
    declared = F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1)), F.lit(""))
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]*)", 1)
    return pages.select(F.col("page_id").alias("doc_id"), bare.alias("text"), declared.alias("declared"), host.alias("host"), F.regexp_extract(host, r"\.([^.]*)$", 1).alias("suffix"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs whose language is identified, with that language as lang; rows without an id stay as they are.

    Rows that declare a language without a model stay as they are too, if their text has a trigram: no model says
    anything about them. Rows that repeat an id share one verdict, that of the most confident accepted row (ties: the
    last language).
    """
    found, langs = _identified(document_evidence(docs))
    found = found.groupBy("doc_id").agg(F.max(F.struct("accepted", "confidence", "lang")).alias("x"))
    found = found.select("doc_id", F.when(F.col("x.accepted"), F.col("x.lang")).alias("_found_lang"))
    unknown = F.coalesce((F.col("lang") != "") & ~F.col("lang").isin(langs) & (F.octet_length("text") >= 3), F.lit(False))
    out = docs.withColumn("_unknown", unknown).join(found.where("doc_id is not null"), "doc_id", "left").where("doc_id is null or _unknown or _found_lang is not null")
    return out.withColumn("lang", F.when(F.col("_unknown"), F.col("lang")).otherwise(F.coalesce("_found_lang", "lang"))).select(*docs.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(document_evidence(read_table(spark, sf_dir, "documents")))


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(page_evidence(read_table(spark, sf_dir, "pages"))).withColumnRenamed("doc_id", "page_id")
