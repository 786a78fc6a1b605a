"""Near-duplicate texts by word shingles: min-wise signatures, banding, and an exact check of what the bands bring together (after Broder, 1997).

A signature has one number for each of some hash functions: the least hash of the text's shingles. Two texts agree in a number with a chance equal to
their Jaccard similarity, so the share of equal numbers estimates it (``estimate``), and texts that agree in all numbers of a band are candidates. Bands are
taken from the threshold (``bands_for``), candidates are compared by their whole shingle sets: no false pairs, and a pair at the threshold is missed with
chance ``1 - recall``. All of it is built-in expressions. Texts with equal words are one text here (``text_classes``): copies cost a row each and no pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import tokens
from tidemark.operators.stories import groups_of
from tidemark.work import cut

WORDS, LEAST, RECALL = 5, 0.8, 0.99999
BAND_ROWS = 4
SLOTS = 1 << 20


def bands_for(least: float, recall: float, rows: int = BAND_ROWS) -> int:
    """Bands of ``rows`` numbers so that a pair at ``least`` agrees in one of them with chance ``recall``."""
    meet = least**rows
    return 1 if meet >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-meet))


def shingles(words: str | Column, width: int) -> Column:
    """Distinct runs of ``width`` words as 64-bit hashes; fewer words make one run of them all, none make none."""
    w = F.col(words) if isinstance(words, str) else words
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, width), " ")))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(runs))


def text_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, class``: the smallest ``key`` with the same words; texts without words stay alone. What is shuffled is ids and hashes, copies pre-aggregated."""
    hashed = cut(docs.select(key, F.when(F.size(tokens(text)) > 0, F.md5(F.array_join(tokens(text), " "))).alias("_h")), "word-hashes")
    least = hashed.where("_h is not null").groupBy("_h").agg(F.min(key).alias("_least"))
    return hashed.join(least, "_h", "left").select(key, F.coalesce("_least", key).alias("class"))


def signatures(sets: DataFrame, key: str, size: int) -> DataFrame:
    """``key, signature``: ``size`` least hashes of the array ``shingles``. A text's shingles meet in its own task; a row of numbers leaves it."""
    each = sets.select(key, F.explode("shingles").alias("s"))
    least = each.groupBy(key).agg(*(F.min(F.xxhash64("s", F.lit(i))).alias(f"m{i}") for i in range(size)))
    return least.select(key, F.array(*(f"m{i}" for i in range(size))).alias("signature"))


def estimate(a: str | Column, b: str | Column) -> Column:
    """The share of equal numbers in two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.size(a)


def similar_pairs(docs: DataFrame, key: str, text: str, least: float = LEAST, words: int = WORDS, recall: float = RECALL, estimates: bool = True) -> DataFrame:
    """``a, b, jaccard, estimate`` (the last with ``estimates`` alone) with a < b of texts whose shingle sets reach ``least``; ``key`` must be unique and ``docs`` without copies (``text_classes``).

    Bands are shuffled as a hash and a ``key`` each; only texts that some band brings together give their sets to be compared, and signatures are
    read again only for pairs found. Null texts and texts without words have no pairs.
    """
    bands = bands_for(least, recall)
    # No filter on the sets here: pushed below, it would split the text again for each shingle. Empty sets have no signature.
    sets = cut(docs.select(F.col(key).alias("k"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("w")).select("k", shingles("w", words).alias("shingles")), "shingle-sets")
    signed = cut(signatures(sets, "k", bands * BAND_ROWS), "signatures")
    codes = F.array(*(F.xxhash64(F.lit(b), *(F.get("signature", F.lit(b * BAND_ROWS + r)) for r in range(BAND_ROWS))) for b in range(bands)))
    dealt = signed.select("k", F.explode(codes).alias("code"))
    met = dealt.join(dealt.select(F.col("k").alias("b"), "code"), "code").where("k < b")
    first = cut(met.select(F.col("k").alias("a"), "b").distinct(), "minhash-met")
    # Most texts meet none: a filter of at most SLOTS places spares the shuffle their sets.
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    slots = F.broadcast(first.select(F.explode(F.array("a", "b")).alias("k")).select(slot("k").alias("_slot")).distinct())
    near = lambda rows: rows.withColumn("_slot", slot("k")).join(slots, "_slot", "left_semi").drop("_slot")
    one = near(sets)
    pairs = first.join(one.select(F.col("k").alias("a"), F.col("shingles").alias("x")), "a").join(one.select(F.col("k").alias("b"), F.col("shingles").alias("y")), "b")
    # Sizes too far apart cannot be similar: that spares the intersection.
    low, high = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = pairs.where(low >= least * high).select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("jaccard")).where(F.col("jaccard") >= least)
    if not estimates:
        return found
    found, seen = cut(found, "minhash-found"), near(signed)
    both = found.join(seen.select(F.col("k").alias("a"), F.col("signature").alias("s")), "a").join(seen.select(F.col("k").alias("b"), F.col("signature").alias("t")), "b")
    return both.select("a", "b", "jaccard", estimate("s", "t").alias("estimate"))


def near_groups(docs: DataFrame, key: str, text: str, least: float = LEAST, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """``key, class, cluster_id, n_links``: each row's class of equal texts, its group of near copies (named by its smallest ``key``), and the links of its class to others."""
    classes = cut(text_classes(docs, key, text), "text-classes")
    own = docs.join(classes.where(F.col(key) == F.col("class")).select(key), key, "left_semi")
    pairs = cut(similar_pairs(own, key, text, least, words, recall, estimates=False).select("a", "b"), "minhash-pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    roots = groups_of(pairs).select(F.col("node").alias("class"), "cluster_id")
    out = classes.join(roots, "class", "left").join(degree, "class", "left")
    return out.select(key, "class", F.coalesce("cluster_id", "class").alias("cluster_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
