"""Quality rules with adaptive thresholds, DataFrame functions only.

Rules read counts of the whole text. Fixed base rules fail a document at once; the others compare it with its own
language and source. For each of these groups a mergeable quantile sketch per measure holds counts over buckets of
a log-linear scale (``STEPS`` an octave, as in HDR histograms; DDSketch has the same guarantee): sketches merge by adding, so
partial aggregation builds them before the shuffle, and the sketches of a language or of all documents are sums of the finest.
They hold the documents that pass the base rules.

Measures are rates with one find added (Laplace's rule of succession), so those of documents without finds still differ by length, and
no spread is zero only because most documents have none. On the sketch's log scale a group's upper fence is Tukey's far one, ``SPREAD``
interquartile ranges above the upper quartile, or as far above the median as twice the lower half says for a symmetric spread, if that is less: junk
in the upper half, nearly half of a group, does not move the latter. A spread is one step of the sketch at least. Where values tie, the fence does not fall below the group's
90th percentile, or its parent's fence (for all documents the upper quartile) if that is less. Lower fences (of word length) mirror this.
Each fence is drawn towards its parent's (source to language to all documents) as if ``PRIOR_DOCS`` documents spoke for
the parent: there is no size at which a group's own voice starts. Joined to their groups, documents beyond a fence go.

Defined cases: null text is empty and fails the base rules; null language or source is a group of its own; repeated rows get a row
each and weigh as often as they come; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.shared import materialize

LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
MEASURES = ("symbols", "dup_lines", "repeats", "word_length")
TWO_SIDED = ("word_length",)
SPREAD, PRIOR_DOCS = 3, 20
STEPS = 256
_WS = r"[\\x20\\x09-\\x0D]"


def base_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words`` of whole texts."""
    d = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("t"))
    d = d.select(
        "doc_id", "lang", "source",
        F.expr(f"filter(split(t, '{_WS}+'), w -> w <> '')").alias("words"),
        F.expr("length(regexp_replace(t, '[^#*$%&|<>]+', ''))").cast("long").alias("n_symbols"),
        F.expr(f"filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"),
    )
    d = d.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.expr("length(array_join(words, ''))").cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> concat_ws(' ', w, get(words, i + 1), get(words, i + 2)))").alias("grams"),
    )
    # Only texts with a window found twice pay for sorting their windows; equal ones then stand side by side.
    d = d.withColumn("sorted", F.expr("case when size(array_distinct(grams)) < size(grams) then sort_array(transform(grams, (g, i) -> struct(g as g, i as i))) end")).drop("grams")
    d = d.withColumn("at", F.expr("filter(transform(sorted, (s, j) -> case when s.g = get(sorted, j - 1).g or s.g = get(sorted, j + 1).g then s.i end), i -> i is not null)")).drop("sorted")
    repeat = F.expr("coalesce(size(array_distinct(flatten(transform(at, i -> array(i, i + 1, i + 2))))), 0)")
    return d.withColumn("n_repeat_words", F.when(F.col("at").isNull(), 0).otherwise(repeat).cast("long")).drop("at")


def with_measures(counts: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and the measures (millionths, word length in thousandths), whole numbers so that every engine agrees."""
    rate = lambda found, of: F.expr(f"({found} + 1) * 1000000 div ({of} + 2)")
    return counts.select(
        "*",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        rate("n_symbols", "n_words").alias("symbols"),
        rate("n_dup_lines", "n_lines").alias("dup_lines"),
        rate("n_repeat_words", "n_words").alias("repeats"),
        F.expr("1000 * word_chars div greatest(n_words, 1)").alias("word_length"),
    )


def bucket(measure: str) -> Column:
    """The place on the log-linear scale: the number itself below ``2 * STEPS``, then ``STEPS`` places an octave."""
    extra = f"(length(bin({measure})) - {STEPS.bit_length()})"
    return F.expr(f"case when {measure} < {2 * STEPS} then {measure} else {STEPS} * {extra} + shiftright({measure}, {extra}) end")


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n``: the sketch of each group."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(m).alias("bucket")) for m in MEASURES))).alias("x")
    return measured.where("not base_failed").select("lang", "source", pairs).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Merges sketches up to ``by``: ``*by, measure, n, q10, q25, q50, q75, q90``; a quantile is the first bucket that reaches its share."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    run = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    reached = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("bucket"))).alias(f"q{q}")
    return run.groupBy(*by, "measure").agg(F.max("total").alias("n"), *map(reached, (10, 25, 50, 75, 90)))


def fences(quantile: DataFrame, parent: DataFrame | None, on: list[str]) -> DataFrame:
    """Adds ``high, low`` to ``quantile`` and drops the quantiles. ``parent`` has the fences above, matched by ``on`` and measure."""
    if parent is None:
        rows = quantile.withColumns({"_high": F.col("q75"), "_low": F.col("q25"), "_prior": F.lit(0)})
    else:
        above = parent.select(*(F.col(c).alias(f"_{c}") for c in [*on, "measure", "high", "low"]))
        same = F.col("measure") == F.col("_measure")
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        rows = quantile.join(above, same).withColumn("_prior", F.lit(PRIOR_DOCS))
    reach = lambda times, spread: f"{times} * greatest(1, {spread})"  # noqa: E731  (the sketch cannot tell values within a step apart)
    whole, lower, upper = reach(SPREAD, "q75 - q25"), reach(2 * SPREAD + 1, "q50 - q25"), reach(2 * SPREAD + 1, "q75 - q50")
    rows = rows.withColumn("_own_high", F.expr(f"greatest(least(q50 + {lower}, q75 + {whole}), least(q90, _high))"))
    rows = rows.withColumn("_own_low", F.expr(f"greatest(0, least(greatest(q50 - {upper}, q25 - {whole}), greatest(q10, _low)))"))
    drawn = lambda side: F.expr(f"(n * _own_{side} + _prior * _{side}) div (n + _prior)")
    low = F.when(F.col("measure").isin(*TWO_SIDED), drawn("low")).otherwise(F.lit(0))
    return rows.withColumns({"high": drawn("high"), "low": low}).select(*[c for c in quantile.columns if c not in ("q10", "q25", "q50", "q75", "q90")], "high", "low")


def group_fences(sketch: DataFrame) -> DataFrame:
    """``lang, source, n`` and, per measure, a struct ``low, high`` on the sketch's scale."""
    top = fences(quantiles(sketch, []), None, [])
    mid = fences(quantiles(sketch, ["lang"]), top, [])
    fine = fences(quantiles(sketch, ["lang", "source"]), mid, ["lang"])
    return fine.groupBy("lang", "source").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("measure") == m, F.struct("low", "high"))).alias(m) for m in MEASURES))


def apply_rules(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and the name of the rule that rejects."""
    counts = materialize(base_counts(docs), "rule-counts")
    measured = with_measures(counts)
    limits = group_fences(materialize(sketches(measured), "rule-sketches"))
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(F.col(m).alias(f"_{m}") for m in MEASURES))
    joined = measured.join(limits, F.expr("lang <=> _lang and source <=> _source"), "left")
    beyond = F.lit(None).cast("string")
    for m in reversed(MEASURES):
        beyond = F.when((bucket(m) > F.col(f"_{m}.high")) | (bucket(m) < F.col(f"_{m}.low")), F.lit(m)).otherwise(beyond)
    joined = joined.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(beyond))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
