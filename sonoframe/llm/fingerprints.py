"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each 5-word shingle is hashed once; the hash's top seven bits name one of 128 bins and each bin keeps its least
hash. An empty bin takes the value of a filled one, chosen by a random order of bins of its own (optimal
densification: what probing by a universal hash until a filled bin is met amounts to). The fingerprint is the low
eight bits of each bin as lowercase hex. The likeness of two fingerprints is the share of equal bins, corrected for
the 1/256 of bins that agree by chance.

Defined results: null counts as the empty text; a text without words has the empty fingerprint, like only itself;
texts of fewer than five words have one shingle, the whole sequence. Rows that repeat an id are ordered by their
texts' hashes; rows without an id come last. Only id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_tasks, materialise, read_table, text_column

BIN_BITS = 7
BINS = 1 << BIN_BITS
SHINGLE = 5
#: Documents that one block of neighbours holds, about.
BLOCK = 1024
#: How many blocks there are at most, about; beyond, blocks grow.
SPLITS = 1 << 16
_SHIFT = 64 - BIN_BITS
_FULL = (1 << _SHIFT) - 1


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of a text column; each step is a column of its own, so nothing is computed twice."""
    w, s, m = f"{out}_words", f"{out}_sorted", f"{out}_bins"
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    df = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    n = F.size(w)
    shingles = F.transform(F.slice(w, 1, n - (SHINGLE - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)]))
    shingles = F.when(n >= SHINGLE, shingles).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    empty = F.array(*[F.lit((b << _SHIFT) | _FULL) for b in range(-BINS // 2, BINS // 2)])  # a bin's largest hash: none
    df = df.withColumn(s, F.sort_array(F.concat(shingles, empty)))
    bin_ = lambda x: F.shiftright(x, _SHIFT)
    df = df.withColumn(m, F.filter(s, lambda x, i: (i == 0) | (bin_(x) != bin_(F.get(s, i - 1)))))
    none = lambda x: x.bitwiseAND(F.lit(_FULL)) == F.lit(_FULL)
    filled = f"{out}_filled"
    df = df.withColumn(filled, F.filter(m, lambda x: ~none(x)))
    lent = lambda i: F.array_min(F.transform(filled, lambda y: F.struct(F.xxhash64(i, bin_(y)).alias("order"), y.alias("value"))))["value"]
    dense = F.transform(m, lambda x, i: F.when(none(x), lent(i)).otherwise(x))
    byte = lambda x: F.substring(F.hex(x.bitwiseAND(F.lit(255)) + F.lit(256)), 2, 2)
    packed = F.lower(F.array_join(F.transform(dense, byte), ""))
    return df.withColumn(out, F.when(F.size(filled) > 0, packed).otherwise("")).drop(w, s, m, filled)


def likeness(a: str, b: str) -> Column:
    """The estimated similarity of two fingerprints' texts, 0 to 1."""
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(F.col(a), 2 * i + 1, F.lit(2)) == F.substring(F.col(b), 2 * i + 1, F.lit(2))))
    chance = 1 / 256
    share = F.greatest(F.lit(0.0), (equal / F.lit(BINS) - chance) / (1 - chance))
    return F.when(F.col(a) == F.col(b), 1.0).when((F.col(a) == "") | (F.col(b) == ""), 0.0).otherwise(share)


def _block(docs: DataFrame) -> Column:
    """The block of each row of (doc_id, text): BLOCK neighbours or fewer, later blocks first; null ids come last.

    Ids are ranked in a shuffle of their own, and every BLOCK-th one of a partition begins a block: at most SPLITS and
    one for each partition reach the driver, however the ids lie. Rows without an id are dealt by the hash of their
    text, which orders them.
    """
    n, known = docs.agg(F.count("*"), F.count("doc_id")).first()
    size = max(BLOCK, -(-known // SPLITS))
    ids = docs.where("doc_id is not null").select("doc_id").repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    rank = F.row_number().over(Window.partitionBy("part").orderBy("doc_id"))
    splits = sorted({r["doc_id"] for r in ids.withColumn("rank", rank).where(F.col("rank") % size == 0).select("doc_id").collect()})
    table = F.split(F.lit(",".join(map(str, splits))), ",").cast("array<bigint>")

    def halve(acc: Column, _: Column) -> Column:  # bisection: how many blocks begin at the id or before
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        after = F.coalesce(F.get(table, middle) <= F.col("doc_id"), F.lit(False))
        return F.struct(F.when(after, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(after, acc["hi"]).otherwise(middle).alias("hi"))

    ends = F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi"))
    of_id = F.aggregate(F.sequence(F.lit(1), F.lit(len(splits).bit_length() + 1)), ends, halve, lambda acc: acc["lo"].cast("long")) if splits else F.lit(0)
    bits = min(max(0, (n - known) // BLOCK).bit_length(), 16)
    of_text = F.shiftright(F.xxhash64("text"), 63 - bits) if bits else F.lit(0)  # signed: -2^bits to 2^bits - 1
    return F.when(F.col("doc_id").isNotNull(), of_id).otherwise(-1 - (1 << bits) - of_text)


def _next_block(blocks: DataFrame) -> DataFrame:
    """Of blocks (block, top): the block that comes next in descending order, the first after the last.

    Two levels of windows: only one row for every 4,096 blocks meets in one task.
    """
    blocks = blocks.withColumn("group", F.floor(F.col("block") / F.lit(4096)))
    inner = F.lead("block").over(Window.partitionBy("group").orderBy(F.desc("block")))
    groups = blocks.groupBy("group").agg(F.max("block").alias("head"))
    whole = Window.partitionBy(F.lit(0)).orderBy(F.desc("group"))
    beyond = F.coalesce(F.lead("head").over(whole), F.first("head").over(whole)).alias("beyond")
    return blocks.withColumn("inner", inner).join(groups.select("group", beyond), "group").select("block", F.coalesce("inner", "beyond").alias("next_block"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of each row."""
    docs = text_column(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return with_fingerprint(docs, "text", "fingerprint").select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint")


def _edited(df: DataFrame) -> DataFrame:
    """df (doc_id, text, fingerprint, next_text, next_fingerprint, ...) with the edited text's columns in place of the next one's."""
    half = F.floor(F.length("text") / 2).cast("int")
    n = F.length("text")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("near_next", likeness("fingerprint", "next_fingerprint"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    df = with_fingerprint(df, "edited", "edited_fingerprint")
    df = df.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("near_edited", likeness("fingerprint", "edited_fingerprint"))
    return df.drop("edited", "next_text", "next_fingerprint")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint against that of its text with the last half replaced by the next row's first, descending id.

    Texts are shuffled once, into counted blocks of neighbouring ids; a block's last row meets the next block's first in a
    join of one row a block.
    """
    docs = text_column(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    docs = docs.withColumn("block", _block(docs))
    next_block = _next_block(docs.groupBy("block").agg(F.count("*").alias("n")))
    docs = in_tasks(docs, docs.count() // (16 * BLOCK), "block")
    rows = with_fingerprint(docs, "text", "fingerprint")
    order = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order))
    last = F.col("next_text").isNull()
    ends = F.when(last | (F.col("place") == 1), F.col("text"))
    inside = _edited(rows.withColumn("last", last).withColumn("ends", ends)).drop("text")
    inside = materialise(inside, "fingerprints")
    firsts = inside.where("place = 1").select(F.col("block").alias("next_block"), F.col("ends").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    lasts = inside.where("last").select("doc_id", "block", F.col("ends").alias("text"), "fingerprint").join(next_block, "block").join(firsts, "next_block")
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return inside.where("not last").select(*out).unionByName(_edited(lasts).select(*out))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(read_table(spark, sf_dir, "documents"))
