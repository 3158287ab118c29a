"""Document fingerprints by consistent weighted sampling, in SQL functions alone.

A text is a weighted set: its words ``[^\\x20\\x09-\\x0D]+`` with their counts.
For sample i and a word k of weight S, hashes of (k, i) give
``r, c ~ Gamma(2, 1)`` (minus the log of a product of two uniforms) and
``b ~ U(0, 1)``; then ``t = floor(ln S / r + b)`` and
``a = c * exp(-r * (t - b + 1))``.  The sample is the pair (k, t) with the
smallest ``a``.  Two texts have the same sample with a chance equal to their
generalised Jaccard similarity, ``sum min(S, S') / sum max(S, S')``, so the
share of equal samples estimates it without bias.

A sample is a ``min_by`` over a text's words, with map-side combine, whose
value is 16 bits of a hash of (k, t): four hex digits of the fingerprint.  Two
different samples agree by accident once in 65,536.  Samples are taken
``BLOCK`` at a time: each counted word becomes a row per block, and the block's
number enters the hashes, so the generated method holds ``BLOCK`` samples
whatever their number, which is small enough for HotSpot to compile well.

Everything runs in generated JVM code.  Texts are shuffled once by document;
words are exploded, counted and reduced to ``samples`` numbers in the same
stage, so no word ever crosses the network, and a document of any length adds
one row of ``samples`` numbers.

Defined cases: a NULL text is an empty one; an empty text's fingerprint is
``-`` all over and likens to another empty text alone; a NULL id counts as the
smallest BIGINT (which itself is taken for a NULL id); of rows that share an id, the one with the smallest text hash
stands for it as a next document; repeated rows give repeated rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodging.llm.common import stage, table

SAMPLES = 32
BLOCK = 4
DIGITS = 4
_NO_ID = -(1 << 63)  # what a NULL id counts as
# A document's id loses so many low bits at each level when neighbours are looked up.
_LEVELS = (12, 17, 17)


def _unit(bits: Column, width: int) -> Column:
    """A number in (0, 1) from ``width`` random bits."""
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-width)


def sample(term: Column, weight: Column, i: Column) -> tuple[Column, Column]:
    """Sample i (an INT) of a term of a weight: its ``a`` and its name, 16 bits of a hash of (term, t)."""
    h = F.xxhash64(term, i)
    g = F.xxhash64(h)
    low = F.lit((1 << 21) - 1).cast("long")
    b = _unit(F.shiftrightunsigned(h, 43), 21)
    r = -F.ln(_unit(F.shiftrightunsigned(h, 22).bitwiseAND(low), 21) * _unit(F.shiftrightunsigned(h, 1).bitwiseAND(low), 21))
    c = -F.ln(_unit(F.shiftrightunsigned(g, 32), 32) * _unit(g.bitwiseAND(F.lit((1 << 32) - 1).cast("long")), 32))
    t = F.floor(F.ln(weight) / r + b)
    a = c * F.exp(r * (b - F.lit(1.0) - t))
    # r >= 2**-21, so t * 40503 stays far below 2**63; being odd, the factor keeps different t apart
    name = g.bitwiseXOR(t * F.lit(40503).cast("long")).bitwiseAND(F.lit(0xFFFF).cast("long"))
    return a, name


def signatures(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``keys`` (which name a row of ``texts``) and its fingerprint.

    Needs no shuffle where ``texts`` is partitioned by some of ``keys``.
    """
    word = F.explode_outer(F.split(F.col(text), "[\\x20\\x09-\\x0D]+")).alias("word")
    words = texts.select(*keys, word).select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    counted = words.groupBy(*keys, "term").agg(F.count("term").cast("double").alias("weight"))
    starts = range(0, samples, BLOCK)
    blocks = counted.select("*", F.explode(F.array(*[F.lit(b) for b in starts])).alias("block"))
    taken = [sample(F.col("term"), F.col("weight"), F.col("block") + F.lit(j)) for j in range(min(BLOCK, samples))]
    # A row without a word has weight 0, whose logarithm is NULL: it gives no sample.
    sampled = blocks.groupBy(*keys, "block").agg(*[F.min_by(name, a).alias(f"s{j}") for j, (a, name) in enumerate(taken)])
    none = "-" * DIGITS
    digits = [F.coalesce(F.lpad(F.hex(F.col(f"s{j}")), DIGITS, "0"), F.lit(none)) for j in range(len(taken))]
    parts = sampled.select(*keys, "block", F.lower(F.concat(*digits)).alias("part"))
    wide = parts.groupBy(*keys).agg(*[F.max(F.when(F.col("block") == b, F.col("part"))).alias(f"p{b}") for b in starts])
    whole = F.concat(*[F.col(f"p{b}") for b in starts])
    return wide.select(*keys, F.substring(whole, 1, DIGITS * samples).alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints: estimates generalised Jaccard similarity."""
    equal = [(F.substring(a, 1 + DIGITS * i, DIGITS) == F.substring(b, 1 + DIGITS * i, DIGITS)).cast("int") for i in range(samples)]
    total = equal[0]
    for e in equal[1:]:
        total = total + e
    return total.cast("double") / F.lit(float(samples))


def next_lower(ids: DataFrame, levels: tuple[int, ...] = _LEVELS) -> DataFrame:
    """``ids(id)``, distinct BIGINTs -> ``id, lower``: the next smaller id, NULL for the smallest.

    A window over groups of ids that share their high bits finds most; a
    group's smallest id takes the largest one of the next lower group, and
    the groups are looked up likewise, one level up.  So a window holds at
    most 2**18 rows, whatever the number of ids.
    """
    if not levels:
        return ids.select("id", F.lead("id").over(Window.orderBy(F.desc("id"))).alias("lower"))
    group = F.shiftright("id", levels[0])
    near = ids.select("id", group.alias("group"))
    near = near.withColumn("lower", F.lead("id").over(Window.partitionBy("group").orderBy(F.desc("id"))))
    tops = near.groupBy("group").agg(F.max("id").alias("top"))
    below = next_lower(tops.select(F.col("group").alias("id")), levels[1:]).where("lower is not null")
    last = below.join(tops, below["lower"] == tops["group"]).select(below["id"].alias("group"), "top")
    inside = near.where("lower is not null").select("id", "lower")
    ends = near.where("lower is null").join(last, "group", "left").select("id", F.col("top").alias("lower"))
    return inside.unionByName(ends)


def _join_texts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join on key and hash of two frames that are partitioned by key.

    The hashes are compared by a condition that isn't a join key, or the
    planner would shuffle both sides again by key and hash.
    """
    b = b.withColumnsRenamed({"key": "key_", "hash": "hash_"})
    same = (a["key"] == b["key_"]) & (a["hash"].bitwiseXOR(b["hash_"]) == 0)
    return a.join(b, same).drop("key_", "hash_")


def fingerprint_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    One row per row: ``id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.  The edited text is the
    text with its last ``n_chars div 2`` code points replaced by the first as
    many of the next document's, in descending order of id; after the last
    document comes the first.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(id).cast("long"), F.lit(_NO_ID)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    counted = hashed.groupBy("key", "hash", F.char_length("text").cast("long").alias("n_chars"))
    sizes, _ = stage(counted.agg(F.count(F.lit(1)).alias("copies")), "sizes")
    keys = sizes.select(F.col("key").alias("id")).distinct()
    largest = keys.agg(F.max("id").alias("largest"))
    chain = next_lower(keys).join(F.broadcast(largest))  # one row
    following, _ = stage(chain.select(F.col("id").alias("key"), F.coalesce("lower", "largest").alias("next")), "next")

    # The texts once by document: what is edited and what replaces it read the same shuffle.
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = hashed.repartition(parts, "key")
    own = dealt.groupBy("key", "hash").agg(F.min("text").alias("text"))
    first = dealt.groupBy("key").agg(F.min(F.struct("hash", "text")).alias("first")).select(F.col("key").alias("next"), "first.text")
    wanted = sizes.join(following, "key").select("key", "hash", "next", F.expr("n_chars div 2").cast("int").alias("half"))
    tails = wanted.join(first, "next").select("key", "hash", F.expr("left(text, half)").alias("tail"))
    both = _join_texts(own, tails.repartition(parts, "key"))
    both = both.withColumn("edited", F.concat(F.expr("left(text, char_length(text) - char_length(text) div 2)"), "tail"))

    told = both.select("key", "hash", F.sha2("edited", 256).alias("edited_sha256"))
    forms = F.explode(F.array(F.struct(F.lit(0).alias("form"), "text"), F.struct(F.lit(1).alias("form"), F.col("edited").alias("text"))))
    texts = both.select("key", "hash", forms.alias("x")).select("key", "hash", "x.form", "x.text")
    # Until the last step a fingerprint is its bytes, half as long as its digits; an empty text's is NULL.
    signed = signatures(texts, ["key", "hash", "form"], samples=samples).withColumn("fingerprint", F.unhex("fingerprint"))
    wide = signed.groupBy("key", "hash").agg(
        F.max(F.when(F.col("form") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("form") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    made, _ = stage(_join_texts(told, wide), "fingerprints")

    of_next = made.groupBy(F.col("key").alias("next")).agg(F.min_by("fingerprint", "hash").alias("next_fingerprint"))
    near = following.join(of_next, "next").select("key", "next_fingerprint")
    out = made.join(near, "key").join(sizes, ["key", "hash"])
    empty = F.lit("-" * DIGITS * samples)
    for name in ("fingerprint", "edited_fingerprint", "next_fingerprint"):
        out = out.withColumn(name, F.coalesce(F.lower(F.hex(name)), empty))
    out = out.select(
        F.when(F.col("key") != _NO_ID, F.col("key")).alias(id),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
        "copies",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted-sampling fingerprints of all ``documents`` and their edited texts; see ``fingerprint_documents``."""
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
