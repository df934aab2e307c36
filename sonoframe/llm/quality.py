"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is a 5-gram model of bytes (digits alike) for each language, with every n-gram that trusted text holds.
Both sides of the join are sharded on language and the third and fourth byte of a 5-gram: a shard has all that a
5-gram's probability takes down to the third order, so its counts, continuation counts and contexts meet the n-grams
of the documents in one place. Orders one and two are at most 256^2 numbers a language and are broadcast. Documents
send each distinct 5-gram of a slice of text once, with no text, get its log-probability back, and are summed where
the slice's text (compressed) meets its answers. Rows of a shard stream by, the counts first, so no shard's documents
need fit in memory; a shard's counts are at most 256^3.

One trusted document in HELD isn't counted; the others' perplexities are raised by the mean difference, so that the
thresholds aren't those of text the model has seen. A document is kept if its perplexity is at most SLACK times its
language's quantile among trusted documents (trusted text is a sample: other clean text is a little further from the
model, junk many times further); short texts lean on their language's mean, as if PRIOR more bytes had it.

Languages of little trusted text share one model, so any number of languages has one; each of them has a threshold of
its own, its quantile leaning on that of all of them as if LEAN more documents had it. The TAGS of most trusted text
are told apart; if there are more, all other tags share the model and the pooled threshold. Shards' questions are salted by
the number of slices, so no task grows with the input.

Defined results: null and empty texts have no perplexity of their own, get their language's mean and are kept;
rows without a language take the model that likes them best; rows of a language without any trusted text aren't
judged: kept, without perplexity. So are all where there is no trusted text. Every row gives one row. The documents are
read more than once and must come in the same order both times, as from files; where they don't, the job fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_tasks, materialise, read_table, slices, text_column

BEGIN = 2
PRIOR = 40
QUANTILE = 0.995
SLACK = 1.25
#: Language tags of trusted rows that are told apart, those of most text.
TAGS = 10_000
#: Trusted documents that the pooled threshold counts for beside those of a language that shares the model.
LEAN = 20
HELD = 5
#: Languages with a model of their own: those of most trusted text, FEW trusted documents at least. Others share one.
LANGUAGES, FEW, SHARED, UNJUDGED = 64, 20, "*", "\0"
#: Text bytes whose distinct n-grams are asked for together.
SLICE = 8 << 20
#: A shard's questions from so many slices, about, meet in one task with the shard's counts.
SLICES = 64
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[48:58] = 48
_FOLD[[9, 11, 12, 13]] = 32


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte e, the 5-gram abcde that it ends, as c, d, a, b, e from the highest byte; texts begin with BEGIN."""
    e = _FOLD[data]
    starts = offsets[:-1][np.diff(offsets) > 0]
    ends = offsets[1:][np.diff(offsets) > 0]
    key = e.copy()
    for back, shift in ((1, 24), (2, 32), (3, 8), (4, 16)):
        x = np.full_like(e, BEGIN)
        x[back:] = e[:-back]
        for i in range(back):
            x[(starts + i)[starts + i < ends]] = BEGIN
        key |= x << shift
    return key


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of SLICE bytes, over the ends of Arrow batches."""
    held, size = [], 0
    for batch in batches:
        for part, _, offsets in slices(batch, "text", SLICE):
            n = int(offsets[-1])
            if held and size + n > SLICE:
                yield from slices(pa.Table.from_batches(held).combine_chunks().to_batches()[0], "text", 1 << 62)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield from slices(pa.Table.from_batches(held).combine_chunks().to_batches()[0], "text", 1 << 62)


def counts(rows: DataFrame) -> DataFrame:
    """5-gram counts (lang, mid, low, n) of rows (text, lang)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _pieces(batches):
            keys, names = grams(data, offsets), np.array(part.column(1).to_pylist(), dtype=object)
            for name in sorted(set(names)):
                found, n = np.unique(keys[np.repeat(names == name, np.diff(offsets))], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array((found >> 24).astype(np.int32)), pa.array((found & 0xFFFFFF).astype(np.int32)), pa.array(n)], ["lang", "mid", "low", "n"])

    return rows.select("text", "lang").mapInArrow(work, "lang string, mid int, low int, n long").groupBy("lang", "mid", "low").agg(F.sum("n").alias("n"))


def _discounts(n: list) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and more, from how many grams have counts 1 to 4."""
    y = n[0] / max(n[0] + 2 * n[1], 1)
    # with too few grams the closed form leaves its range: a discount stays between 0.1 and its count less 0.1
    return np.array([0.0, *[min(max(k - (k + 1) * y * n[k] / max(n[k - 1], 1), 0.1), k - 0.1) for k in (1, 2, 3)]])


def _order(n: np.ndarray, discounts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities by (context, last byte) of counts n, interpolated with the next lower order's."""
    cut = discounts[np.minimum(n, 3)]
    total = n.sum(-1, keepdims=True)
    weight = np.where(total > 0, cut.sum(-1, keepdims=True) / np.maximum(total, 1), 1.0)
    return (n - cut) / np.maximum(total, 1) + weight * lower


class Shard:
    """The counts of one language's 5-grams with the same third and fourth byte."""

    def __init__(self, low: np.ndarray, n: np.ndarray, discounts: dict[int, np.ndarray], second: np.ndarray):
        four = np.bincount(low & 0xFFFF, minlength=1 << 16).reshape(256, 256)  # how many bytes come before bcde
        three = (four > 0).sum(0)
        self.lower = _order(four, discounts[4], _order(three, discounts[3], second)).ravel()
        cut = discounts[5][np.minimum(n, 3)]
        total = np.bincount(low >> 8, weights=n, minlength=1 << 16)
        self.weight = np.where(total > 0, np.bincount(low >> 8, weights=cut, minlength=1 << 16) / np.maximum(total, 1), 1.0)
        self.low, self.share = low, (n - cut) / np.maximum(total, 1)[low >> 8]

    def logs(self, asked: np.ndarray) -> np.ndarray:
        p = self.weight[asked >> 8] * self.lower[asked & 0xFFFF]
        if len(self.low):
            at = np.minimum(np.searchsorted(self.low, asked), len(self.low) - 1)
            p = p + np.where(self.low[at] == asked, self.share[at], 0.0)
        return np.log(p)


def fit(rows: DataFrame) -> tuple[DataFrame, dict]:
    """The counts of rows (text, lang), and by language the discounts of each order and the second order's table."""
    five = materialise(counts(rows), "five-grams")
    four = five.groupBy("lang", "mid", F.col("low").bitwiseAND(0xFFFF).alias("low")).agg(F.count("*").alias("n"))
    three = four.groupBy("lang", "mid", F.col("low").bitwiseAND(0xFF).alias("low")).agg(F.count("*").alias("n"))
    two = three.groupBy("lang", F.col("mid").bitwiseAND(0xFF).alias("d"), "low").agg(F.count("*").alias("n"))
    small: dict = {}
    for order, table in ((5, five), (4, four), (3, three)):
        for r in table.groupBy("lang").agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect():
            small.setdefault(r["lang"], {})[order] = _discounts(list(r[1:]))
    pairs = two.toPandas()  # at most 256^2 rows a language
    for name, model in small.items():
        own, n = pairs[pairs.lang == name], np.zeros((256, 256), dtype=np.int64)
        n[own.d.to_numpy(), own.low.to_numpy()] = own.n.to_numpy()
        of = lambda x: _discounts([int((x == k).sum()) for k in (1, 2, 3, 4)])
        one = (n > 0).sum(0)
        model[2] = _order(n, of(n), _order(one, of(one), np.full(256, 1 / 256)))
    return five, small


def _asked(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, names: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """For each model: the rows of a slice (doc_id, text, lang) that take it, all their 5-grams, and the distinct ones."""
    keys, place = grams(data, offsets), {x: i for i, x in enumerate(names)} | {None: -1}
    lang = np.array([place.get(SHARED if x and x[0] == SHARED else x, -2) for x in part.column(2).to_pylist()])
    for i, name in enumerate(names):
        takes = (lang == -1) | (lang == i)
        own = keys[np.repeat(takes, np.diff(offsets))]
        if takes.any():
            yield name, takes, own, np.unique(own)


def _places(found: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where each of own stands in found (sorted, distinct): by a table of hashes, by bisection where those collide."""
    slot = lambda x: (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
    table = np.zeros(1 << 21, dtype=np.int64)
    table[slot(found)] = np.arange(len(found))
    at = table[slot(own)]
    other = np.flatnonzero(found[at] != own)
    at[other] = np.searchsorted(found, own[other])
    return at


def _slice_id(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> int:
    h = hashlib.blake2b(data.tobytes(), digest_size=8)
    h.update(offsets.tobytes() + repr(part.column(0).to_pylist()).encode())
    return int.from_bytes(h.digest(), "little", signed=True)


def _blobs(x: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())


def _answers(docs: DataFrame, five: DataFrame, small: dict, n_bytes: int) -> DataFrame:
    """(slice, lang, mid, body): the log-probabilities of a slice's distinct 5-grams of that shard, in order, as float16."""
    names, spark, salts = sorted(small), docs.sparkSession, max(1, -(-n_bytes // (SLICES * SLICE)))
    model = spark.sparkContext.broadcast(small)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _pieces(batches):
            key = _slice_id(part, data, offsets)
            for name, _, _, found in _asked(part, data, offsets, names):
                mids, first = np.unique(found >> 24, return_index=True)
                low = np.ascontiguousarray(found.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :3]
                n = len(mids)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(mids.astype(np.int32)), pa.array(np.full(n, key % salts, dtype=np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(np.full(n, key)), _blobs(low, np.append(first, len(found)))], ["lang", "mid", "salt", "low", "n", "slice", "body"])

    schema = "lang string, mid int, salt int, low int, n long, slice long, body binary"
    known = five.select("lang", "mid", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "low", "n", F.lit(None).cast("long").alias("slice"), F.lit(None).cast("binary").alias("body"))
    both = in_tasks(docs.mapInArrow(ask, schema).unionByName(known), n_bytes // (16 * SLICE), "lang", "mid", "salt").sortWithinPartitions("lang", "mid", "salt", F.col("low").asc_nulls_last())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, low, n = None, None, [], []
        for batch in batches:
            langs, mids, salts = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            edges = [0, *[i for i in range(1, len(langs)) if (langs[i], mids[i], salts[i]) != (langs[i - 1], mids[i - 1], salts[i - 1])], len(langs)]
            out: tuple[list, list, list, list] = ([], [], [], [])
            for a, b in zip(edges[:-1], edges[1:]):
                if (langs[a], mids[a], salts[a]) != at:
                    at, shard, low, n = (langs[a], mids[a], salts[a]), None, [], []
                part = batch.slice(a, b - a)
                counted = part.num_rows - part.column(3).null_count  # a shard's counts come before its questions
                low.append(part.column(3).slice(0, counted).to_numpy())
                n.append(part.column(4).slice(0, counted).to_numpy())
                for i in range(counted, part.num_rows):
                    if shard is None:
                        of = model.value[at[0]]
                        shard = Shard(np.concatenate(low).astype(np.int64), np.concatenate(n).astype(np.int64), of, of[2][int(at[1]) & 255])
                    asked = np.frombuffer(part.column(6)[i].as_py(), dtype=np.uint8).reshape(-1, 3).astype(np.int64)
                    logs = shard.logs(asked[:, 0] | asked[:, 1] << 8 | asked[:, 2] << 16)
                    for x, y in zip(out, (part.column(5)[i].as_py(), at[0], int(at[1]), logs.astype("<f2").tobytes())):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.binary()))], ["slice", "lang", "mid", "body"])

    return both.mapInArrow(answer, "slice long, lang string, mid int, body binary")


def _scored(docs: DataFrame, five: DataFrame, small: dict) -> DataFrame:
    """(doc_id, model_lang, tag, n, logp) of every row of (doc_id, text, lang); n: bytes. A lang that shares the model is SHARED and its tag."""
    names = sorted(small)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _pieces(batches):
            body = pa.compress(data.tobytes(), codec="zstd", asbytes=True)
            rows = [[_slice_id(part, data, offsets)], [None], [None], [body], [part.column(0).to_pylist()], [np.diff(offsets).tolist()], [part.column(2).to_pylist()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())))], ["slice", "lang", "mid", "body", "ids", "sizes", "langs"])

    texts = docs.mapInArrow(pack, "slice long, lang string, mid int, body binary, ids array<long>, sizes array<long>, langs array<string>")
    both = texts.unionByName(_answers(docs, five, small, n_bytes), allowMissingColumns=True)
    both = in_tasks(both, n_bytes // (16 * SLICE), "slice").sortWithinPartitions("slice", F.col("mid").asc_nulls_last())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, answers = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                if (key := batch.column(0)[i].as_py()) != at:
                    at, answers = key, {}
                if batch.column(4)[i].as_py() is None:
                    answers.setdefault(batch.column(1)[i].as_py(), {})[batch.column(2)[i].as_py()] = batch.column(3)[i].as_py()
                    continue
                ids, sizes, langs = (batch.column(c)[i].as_py() for c in (4, 5, 6))
                offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
                data = np.frombuffer(pa.decompress(batch.column(3)[i].as_py(), decompressed_size=int(offsets[-1]), codec="zstd", asbytes=True), dtype=np.uint8)
                part = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.nulls(len(ids), pa.string()), pa.array(langs, pa.string())], ["doc_id", "text", "lang"])
                best, name_of = np.full(len(ids), -np.inf), np.full(len(ids), None, dtype=object)
                for name, takes, own, found in _asked(part, data, offsets, names):
                    of = answers.get(name, {})
                    logs = np.frombuffer(b"".join(of[m] for m in sorted(of)), dtype="<f2").astype(np.float64)
                    if len(logs) != len(found):
                        raise RuntimeError("the documents came in another order when they were read again; write them to a table first")
                    sums = np.concatenate([[0.0], np.cumsum(logs[_places(found, own)])]) if len(found) else np.zeros(1)
                    edges = np.concatenate([[0], np.cumsum(np.diff(offsets)[takes])])
                    total = np.full(len(ids), -np.inf)
                    total[takes] = sums[edges[1:]] - sums[edges[:-1]]
                    better = total > best
                    best[better], name_of[better] = total[better], name
                tags = [x[1:] if x and x[0] == SHARED else None for x in langs]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name_of.tolist(), pa.string()), pa.array(tags, pa.string()), pa.array(np.diff(offsets)), pa.array(best, mask=np.isinf(best))], ["doc_id", "model_lang", "tag", "n", "logp"])

    return both.mapInArrow(work, "doc_id long, model_lang string, tag string, n long, logp double")


def perplexities(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold and keep of every row of (doc_id, text, lang); trusted: (doc_id)."""
    docs = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("said")))
    trusted = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("held", F.xxhash64("doc_id") % HELD == 0)
    # the ids grow with the corpus: they are never broadcast, so that the plan is the same at every size
    told = docs.where("said is not null").select("doc_id", "said", F.octet_length("text").alias("size")).join(trusted.hint("merge"), "doc_id", "left_semi").groupBy("said").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    told = [(r["said"], r["n"]) for r in told.orderBy(F.desc("size"), "said").limit(TAGS + 1).collect()]
    more, told = told[TAGS:], told[:TAGS]
    own = [name for name, n in told if n >= FEW and name[:1] not in (SHARED, UNJUDGED)][:LANGUAGES]
    shared = [name for name, _ in told if name not in own]
    # a language among the first TAGS is known by its tag; of further ones only that they are further
    lang = F.when(F.col("said").isin(own), F.col("said")).when(F.col("said").isin(shared), F.concat(F.lit(SHARED), "said"))
    lang = lang.when(F.col("said").isNotNull() & F.lit(bool(more)), F.lit(SHARED))
    docs = docs.select("doc_id", "text", lang.otherwise(F.when(F.col("said").isNotNull(), F.lit(UNJUDGED))).alias("lang"))
    models = F.when(F.col("lang").startswith(SHARED), F.lit(SHARED)).otherwise(F.col("lang"))
    five, small = fit(docs.where(F.col("lang") != UNJUDGED).withColumn("lang", models).join(trusted.where("not held").hint("merge"), "doc_id", "left_semi"))
    if not small:
        return docs.select("doc_id", F.lit(None).cast("string").alias("lang"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
    rows = materialise(_scored(docs, five, small), "scores")
    known = rows.where("n > 0").join(trusted.hint("merge"), "doc_id")
    mean = lambda which: F.sum(F.when(which, F.col("logp"))) / F.sum(F.when(which, F.col("n")))
    means = known.groupBy("model_lang").agg(mean(F.lit(True)).alias("every"), mean(F.col("held")).alias("unseen"), mean(~F.col("held")).alias("seen"))
    # a language none of whose trusted documents was held out takes the gap of all
    pooled = known.agg(F.greatest(mean(~F.col("held")) - mean(F.col("held")), F.lit(0.0)).alias("gap")).first()["gap"] or 0.0
    means = means.select("model_lang", F.coalesce("unseen", F.col("every") - pooled).alias("mean"), F.greatest(F.coalesce(F.col("seen") - F.col("unseen"), F.lit(pooled)), F.lit(0.0)).alias("gap"))
    means = F.broadcast(means)  # LANGUAGES rows and one at most
    logs = -(F.col("logp") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR)
    # seen texts would have had the mean difference more, as far as they don't lean on the mean
    fair = F.exp(logs + F.when(F.col("held"), 0.0).otherwise(F.col("gap") * F.col("n") / (F.col("n") + PRIOR)))
    level = known.join(means, "model_lang").withColumn("fair", fair)
    at = F.percentile_approx("fair", quantile, 10000)
    pooled = level.groupBy("model_lang").agg(at.alias("pooled"))
    by_tag = level.where("tag is not null").groupBy("model_lang", "tag").agg(at.alias("own"), F.count("*").alias("of_tag"))  # TAGS rows at most
    rows = rows.join(means, "model_lang", "left").join(F.broadcast(pooled), "model_lang", "left").join(F.broadcast(by_tag), ["model_lang", "tag"], "left").withColumn("perplexity", F.exp(logs))
    # a language's own quantile and the pooled one, by their logarithms, in proportion to the documents behind them
    leaned = F.exp((F.log("own") * F.col("of_tag") + F.log("pooled") * LEAN) / (F.col("of_tag") + LEAN))
    rows = rows.withColumn("threshold", F.coalesce(leaned, "pooled") * slack)
    keep = (F.col("n") == 0) | F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return rows.select("doc_id", F.col("model_lang").alias("lang"), F.col("n").alias("n_bytes"), "perplexity", "threshold", keep.alias("keep"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0")
    return perplexities(read_table(spark, sf_dir, "documents"), trusted)
