"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

Each term of a text, weighted by how often it occurs, draws two gamma variates and one uniform from
its hash, per sample; the term with the least value is the sample. Two texts agree in a sample with the
probability of their generalised Jaccard similarity: the sum of the smaller over the sum of the larger weights.
"""

from __future__ import annotations

from hashlib import blake2b

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialise
from .common import text_of

BLANKS = r"[\x20\x09-\x0D]+"
KEY = ["id0", "mark"]
#: Samples of a fingerprint: a likeness of 0.5 has a standard error of 0.0625, one of 0.9 of 0.0375.
SAMPLES = 64


def _hashes(term: Column, sample: int) -> tuple[Column, Column]:
    """Two 64-bit hashes of a term in one sample; terms are hashes themselves, so one round each after a constant of the sample."""
    return tuple(F.xxhash64(term.bitwiseXOR(F.lit(int.from_bytes(blake2b(b"%d" % (2 * sample + i), digest_size=8).digest(), "little", signed=True)))) for i in (0, 1))


def _uniform(bits: Column, width: int) -> Column:
    """A number inside (0, 1) from a whole number of `width` bits."""
    return (bits + F.lit(0.5)) * F.lit(1.0 / (1 << width))


def variates(term: Column, sample: int) -> tuple[Column, Column, Column]:
    """What a term draws in one sample whatever its weight: r and c gamma(2, 1), b uniform, as (r, ln c, b).

    Each hash gives two numbers of 26 bits, and their upper 12 bits together a fifth of 24.
    """
    y, z = _hashes(term, sample)
    low = lambda h: _uniform(h.bitwiseAND(F.lit((1 << 26) - 1)), 26)
    high = lambda h: _uniform(F.shiftrightunsigned(h, 26).bitwiseAND(F.lit((1 << 26) - 1)), 26)
    b = F.shiftleft(F.shiftrightunsigned(y, 52), 12).bitwiseOR(F.shiftrightunsigned(z, 52))
    return -F.log(low(y) * high(y)), F.log(-F.log(low(z) * high(z))), _uniform(b, 24)


def draw(term: Column, log_weight: Column, sample: int) -> tuple[Column, Column]:
    """(value to minimise, sampled code) of a term in one sample; null for a missing weight.

    With t = floor(ln w / r + b) the value is ln c - r * (t - b + 1), the code 32 bits of the term's hashes with t in them.
    """
    y, z = _hashes(term, sample)
    r, log_c, b = variates(term, sample)
    t = F.floor(log_weight / r + b)
    return log_c - r * (t - b + F.lit(1.0)), F.shiftrightunsigned(y, 20).bitwiseXOR(z).bitwiseXOR(t).bitwiseAND(F.lit(0xFFFFFFFF))


def _packed(term: Column, log_weight: Column, sample: int) -> Column:
    """Value, in steps of 2^-22, with its code behind it in one long: one number a sample to aggregate."""
    value, code = draw(term, log_weight, sample)
    return F.shiftleft(F.floor(value * F.lit(float(1 << 22))).cast("bigint"), 32).bitwiseOR(code)


def _codes(names: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(n).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(-1)) for n in names])


def _words(texts: DataFrame, *columns: str) -> DataFrame:
    """(columns, term): hashes of the lower-case words of `text`; a text without words has one row whose term is null."""
    words = F.split(F.regexp_replace(F.lower("text"), f"^{BLANKS}|{BLANKS}$", ""), BLANKS)
    rows = texts.select(*columns, F.explode(words).alias("word"))
    return rows.select(*columns, F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))


def weighted_terms(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, log_weight): the terms of `text` with the logarithm of their count."""
    return _words(texts, *keys).groupBy(*keys, "term").agg(F.log(F.count(F.lit(1))).alias("log_weight"))


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, signature): an array of `samples` codes per text."""
    names = [f"s{i}" for i in range(samples)]
    best = [F.min(_packed(F.col("term"), F.col("log_weight"), i)).alias(name) for i, name in enumerate(names)]
    return weighted_terms(texts, keys).groupBy(*keys).agg(*best).select(*keys, _codes(names).alias("signature"))


def paired_signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, own, changed): signatures of a text (`which` 0) and of its edited text (1).

    Terms that are as frequent in both draw once: their samples (`part` 2) count for either text.
    """
    count = lambda which: F.count(F.when(F.col("which") == which, 1))
    terms = _words(texts, *keys, "which").groupBy(*keys, "term").agg(count(0).alias("n0"), count(1).alias("n1"))
    one = lambda part, n: F.struct(F.lit(part).alias("part"), F.col(n).alias("n"))
    parts = F.when(F.col("n0") == F.col("n1"), F.array(one(2, "n0"))).otherwise(F.array(one(0, "n0"), one(1, "n1")))
    terms = terms.select(*keys, "term", F.inline(parts)).filter("n > 0").select(*keys, "term", "part", F.log("n").alias("log_weight"))
    names = [f"s{i}" for i in range(samples)]
    best = terms.groupBy(*keys, "part").agg(*[F.min(_packed(F.col("term"), F.col("log_weight"), i)).alias(name) for i, name in enumerate(names)])
    sides = [F.min(F.when(F.col("part") != other, F.col(name))).alias(f"{side}{name}") for side, other in (("own", 1), ("changed", 0)) for name in names]
    return best.groupBy(*keys).agg(*sides).select(*keys, *[_codes([f"{side}{name}" for name in names]).alias(side) for side in ("own", "changed")])


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two signatures agree: an estimate of generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a).cast("double")


def written(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def _texts(docs: DataFrame) -> DataFrame:
    """Documents with a key without nulls; rows alike in id and text share it."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id0"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("mark"), "text")


def neighbours(docs: DataFrame) -> DataFrame:
    """(id0, mark, doc_id, copies, n_chars) of each distinct row with the keys of the next and the previous one and the latter's length.

    Order is by doc_id, missing ids first, then by hash of the text; the first follows the last.
    Keys are range-sorted; neighbours are found inside each range, and the ends of the ranges,
    one row each, are matched on their own.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark")]
    rows = _texts(docs).groupBy("doc_id", *KEY).agg(F.max(F.length("text")).cast("bigint").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    rows = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "neighbours")
    this = F.struct(*KEY, "n_chars")
    line = Window.partitionBy("part").orderBy(*order)
    rows = rows.withColumn("next", F.lead(this).over(line)).withColumn("last", F.lag(this).over(line))
    sort = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("mark"))
    ends = rows.groupBy("part").agg(F.min_by(this, sort).alias("first_row"), F.max_by(this, sort).alias("last_row"))
    ring, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("first_row").over(ring), F.first("first_row").over(whole)).alias("after"),
                       F.coalesce(F.lag("last_row").over(ring), F.last("last_row").over(whole)).alias("before"))
    rows = rows.join(ends, "part")
    after, before = F.coalesce("next", "after"), F.coalesce("last", "before")
    return rows.select(*KEY, "doc_id", "copies", "n_chars", after["id0"].alias("next_id0"), after["mark"].alias("next_mark"),
                       before["id0"].alias("last_id0"), before["mark"].alias("last_mark"), before["n_chars"].alias("last_chars"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next text's.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many of the
    next document in doc_id order. Each text is shuffled once, whole, and the head of the next
    text once; terms are grouped where the text is. Fingerprints are `samples` codes of 32 bits in hex.

    Missing text is empty; texts without words agree with each other and with nothing else. Rows
    alike in id and text are one document in the order and each give a row; a missing id sorts
    first. Only doc_id and text are read. No rows yield no rows.
    """
    near = materialise(neighbours(docs), "near")
    whole = _texts(docs).groupBy(*KEY).agg(F.first("text").alias("text")).join(near, KEY)
    heads = whole.select(F.col("last_id0").alias("id0"), F.col("last_mark").alias("mark"),
                         F.expr("substring(text, 1, cast(floor(last_chars / 2) as int))").alias("head"))
    pairs = whole.join(heads, KEY).withColumn(
        "edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), "head"))
    both = pairs.select(*KEY, F.posexplode(F.array("text", "edited")).alias("which", "text"))
    signed = paired_signatures(both, KEY, samples)
    facts = pairs.select(*KEY, "doc_id", "copies", "n_chars", "next_id0", "next_mark", F.sha2("edited", 256).alias("edited_sha256"))
    rows = materialise(signed.join(facts, KEY), "signatures")
    following = rows.select(F.col("id0").alias("next_id0"), F.col("mark").alias("next_mark"), F.col("own").alias("following"))
    return rows.join(following, ["next_id0", "next_mark"]).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
