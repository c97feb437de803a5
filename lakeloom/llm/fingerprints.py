"""Document fingerprints by consistent weighted sampling.

A text's weighted terms are its words with their counts.  For every term and
each of K samples, r and c are Gamma(2, 1) and beta is uniform, all from a hash
of term and sample number, so equal terms draw equally everywhere.  With weight w,

    t = floor(ln w / r + beta),  a = c exp(-r (t - beta) - r),

and the sample is the (term, t) of the smallest a.  Two texts' samples agree
with probability sum(min(w)) / sum(max(w)) over terms, the generalised Jaccard
similarity.  All of it is DataFrame operators in generated code: ``a`` is
quantised into the high bits of a long whose low bits tag (term, t), and a
signature is K minima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, number_rows, repeat_rows, setting

SAMPLES = 64
TAG_BITS = 24  # of (term, t), below the quantised a
SCALE = 1 << 34  # steps of a for each unit; a is below 2 ** 5, as c comes from two 15-bit uniforms
EMPTY = "-"  # fingerprint of a text without words


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """A uniform in (0, 1) from ``width`` bits of a hash."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return (part.cast("double") + F.lit(0.5)) * F.lit(1.0 / (1 << width))


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """Packed (a, tag) of one term in sample k; the least over a text's terms is its sample.

    One 64-bit hash of term and k gives all draws.  A Gamma(2, 1) r that a uniform
    beta splits is two exponentials, r (1 - beta) = -ln u and r beta = -ln v; so
    a = c exp(-r t) u and t = floor((ln w - ln v) / r), and a word that is there
    once, as most are, has t = 0 and takes one logarithm.
    """
    bits = F.xxhash64(term, F.lit(k))
    u, v = _uniform(bits, 0, 20), _uniform(bits, 20, 14)
    a = -F.ln(_uniform(bits, 34, 15) * _uniform(bits, 49, 15)) * u
    once = log_weight == 0
    r = -F.ln(u * v)
    t = F.floor((log_weight - F.ln(v)) / r)
    a = F.when(once, a).otherwise(a * F.exp(-r * t))
    tag = F.when(once, bits).otherwise(bits.bitwiseXOR(t * F.lit(7919).cast("long"))).bitwiseAND(F.lit((1 << TAG_BITS) - 1).cast("long"))
    return F.shiftleft(F.floor(a * F.lit(float(SCALE))), TAG_BITS).bitwiseOR(tag)


def explode_words(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each word of ``text``, with the columns ``keep``."""
    return df.select(*keep, F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")


def signatures(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """Signature (array of int) for each key of ``keys..., term (long), weight`` rows, one row a key and term."""
    log_weight = F.ln(F.col("weight").cast("double"))
    rows = terms.select(*keys, "term", log_weight.alias("log_weight"))
    made = rows.groupBy(*keys).agg(*[F.min(sample(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(samples)])
    return made.select(*keys, F.array(*[F.col(f"s{k}") for k in range(samples)]).alias("signature"))


def similarity(one: Column, two: Column) -> Column:
    """Share of equal samples; two texts without words are alike, one without and one with are not."""
    same = F.aggregate(F.zip_with(one, two, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return F.when(one.isNull() & two.isNull(), 1.0).when(one.isNull() | two.isNull(), 0.0).otherwise(same / F.size(one)).cast("double")


def as_text(signature: Column) -> Column:
    """Fingerprint string: 8 hexadecimal digits a sample."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), ""), F.lit(EMPTY))


def fingerprint_texts(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id and fingerprint of every whole text; null text is empty.  Rows that repeat doc_id and text give one row each time."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("text_hash", F.unhex(F.md5("text")))
    terms = explode_words(keyed.dropDuplicates(["text_hash"]), "text_hash")
    counts = terms.groupBy("text_hash", F.xxhash64("word").alias("term")).agg(F.count(F.lit(1)).alias("weight"))
    made = signatures(counts, ["text_hash"], samples).withColumn("signature", _short(F.col("signature")))
    return keyed.select("doc_id", "text_hash").join(made, "text_hash", "left").select("doc_id", as_text(F.col("signature")).alias("fingerprint"))


def _short(signature: Column) -> Column:
    """32 bits of each packed sample."""
    return F.transform(signature, lambda x: F.xxhash64(x).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))


def compare_edited(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they are.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  In the edited text the last floor(n_chars / 3) code
    points give way to the first as many (or all) of the next document in
    descending doc_id (after the last: the first; a single document follows
    itself).  Null text is empty; null doc_ids come last; rows with one doc_id
    follow by a hash of their text, and rows that repeat doc_id and text count as
    one document in this order and give the same result each.  Other columns are
    not read.

    Both texts share what stands before the cut: it is split into words once,
    and terms of equal weight in both are sampled once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # A row's key: doc_id with nulls as 0, and a hash of the text that also tells nulls apart.
    rows = rows.withColumn("k1", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("k2", F.xxhash64(F.col("doc_id").isNull(), "text"))
    small = rows.groupBy("k1", "k2").agg(F.max("doc_id").alias("doc_id"), F.max(F.length("text")).cast("long").alias("n"), F.count(F.lit(1)).alias("times"))
    numbered, total = number_rows(small, [F.desc_nulls_last("doc_id"), F.col("k2")], "place")
    numbered = materialize(numbered, "order")
    follow = numbered.select(F.pmod(F.col("place") - 1, F.lit(max(total, 1))).alias("place"), F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"))
    pairs = materialize(numbered.join(follow, "place"), "pairs")

    unique = rows.select("k1", "k2", "text")
    repeated = not numbered.filter("times > 1").isEmpty()
    if repeated:
        unique = unique.dropDuplicates(["k1", "k2"])
    cut = F.expr("n div 3")
    heads = unique.join(pairs.select(F.col("k1").alias("own_k1"), F.col("k2").alias("own_k2"), cut.alias("cut"), F.col("next_k1").alias("k1"), F.col("next_k2").alias("k2")), ["k1", "k2"])
    heads = heads.select(F.col("own_k1").alias("k1"), F.col("own_k2").alias("k2"), "cut", F.expr("substring(text, 1, cast(cut as int))").alias("head"))
    texts = unique.join(heads, ["k1", "k2"])
    body = F.expr("substring(text, 1, cast(length(text) - cut as int))")
    tail = F.expr("substring(text, cast(length(text) - cut + 1 as int), cast(cut as int))")
    texts = texts.select("k1", "k2", body.alias("body"), tail.alias("tail"), "head")
    shared = F.regexp_extract("body", r"(?s)\A.*[\x20\x09-\x0D]", 0)  # whole words before the cut, with the white space after them
    texts = texts.withColumn("shared", shared)
    rest = F.expr("substring(body, length(shared) + 1)")
    texts = texts.withColumn("digest", F.sha2(F.concat("body", "head"), 256))
    pieces = F.concat_ws(" ", *[F.concat(F.lit(str(i)), F.substring("digest", 16 * i + 1, 16)) for i in range(4)])  # numbered, as four words
    parts = texts.select(
        "k1", "k2", F.posexplode(F.array("shared", F.concat(rest, F.col("tail")), F.concat(rest, F.col("head")), pieces)).alias("part", "text")
    )
    # Part 0 is in both texts, 1 in the own, 2 in the edited one; part 3 carries the digest, as four longs of a kind each.
    spread = explode_words(parts, "k1", "k2", "part")
    is_digest = F.col("part") == 3
    spread = spread.select(
        "k1",
        "k2",
        "part",
        F.when(is_digest, F.ascii("word") - F.lit(ord("0") - 1)).otherwise(0).alias("kind"),
        F.when(is_digest, F.conv(F.substring("word", 2, 16), 16, -10).cast("long")).otherwise(F.xxhash64("word")).alias("term"),
    )
    counts = spread.groupBy("k1", "k2", "kind", "term").agg(F.count_if(F.col("part") <= 1).alias("own"), F.count_if(F.col("part") != 1).alias("edited"))
    return _finish(counts, pairs, samples, repeated)


def _finish(counts: DataFrame, pairs: DataFrame, samples: int, repeated: bool) -> DataFrame:
    """From term counts (k1, k2, kind, term, own, edited) to the result."""
    # Text 0 stands for both texts, 1 for the own, 2 for the edited: equal weights are sampled once.
    side = F.expr(
        "explode(case when kind > 0 or own = edited then array(0) when own = 0 then array(2) when edited = 0 then array(1) else array(1, 2) end)"
    )
    terms = counts.select("*", side.alias("side"))
    weight = F.when(F.col("kind") == 0, F.when(F.col("side") == 2, F.col("edited")).otherwise(F.col("own")))
    terms = terms.select("k1", "k2", "side", "kind", "term", F.ln(weight.cast("double")).alias("log_weight"))
    minima = terms.groupBy("k1", "k2", "side").agg(
        *[F.min(sample(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(samples)],
        *[F.max(F.when(F.col("kind") == i + 1, F.col("term"))).alias(f"d{i}") for i in range(4)],
    )
    own, edited = F.col("side") <= 1, F.col("side") != 1
    both = minima.groupBy("k1", "k2").agg(
        *[F.min(F.when(own, F.col(f"s{k}"))).alias(f"o{k}") for k in range(samples)],
        *[F.min(F.when(edited, F.col(f"s{k}"))).alias(f"e{k}") for k in range(samples)],
        *[F.max(f"d{i}").alias(f"d{i}") for i in range(4)],
    )

    def joined(letter: str) -> Column:
        """Signature of 32-bit samples, null for a text without words."""
        short = [F.xxhash64(F.col(f"{letter}{k}")).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int") for k in range(samples)]
        return F.when(F.col(f"{letter}0").isNotNull(), F.array(*short))

    digest = F.concat(*[F.lpad(F.lower(F.hex(f"d{i}")), 16, "0") for i in range(4)])
    with setting(pairs.sparkSession, "spark.sql.subexpressionElimination.enabled", "false"):  # it spills the 64 samples' terms to fields, which costs more than it saves
        made = materialize(both.select("k1", "k2", digest.alias("edited_sha256"), joined("o").alias("own"), joined("e").alias("edited")), "signatures")
    following = made.select(F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"), F.col("own").alias("next_own"))
    out = pairs.join(made, ["k1", "k2"]).join(following, ["next_k1", "next_k2"])
    out = out.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        similarity(F.col("own"), F.col("edited")).alias("near_edited"),
        similarity(F.col("own"), F.col("next_own")).alias("near_next"),
        "times",
    )
    return (repeat_rows(out, "times") if repeated else out).drop("times")
