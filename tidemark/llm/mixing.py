"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each source gets a target number of words; a document's expected copies are target / source size. The whole part is
certain, the rest is a probability that pivotal steps round: two open documents meet, one of them takes or gives
mass until one is 0 or 1 while ``size * probability`` summed over both stays as it was (so words, not documents, are
conserved), with chances that keep each document's expectation. Documents of a source are dealt by hash into blocks
of about ``FAN``; a block folds its documents into one open residual, and the residuals of ``FAN`` blocks fold again, up a tree
whose depth is logarithmic in the source's documents. The last residual of a source is rounded by its own chance, so a source's
words miss their target by less than one document. A hot source only has more blocks.

All chances come from hashes of ids and sizes, so reruns agree whatever the partitioning.

Defined cases: null texts have size 0 and no copies to take; a null source is a source of its own, last in order; documents of equal id, source and
size are interchangeable and each get a row; a null ``doc_id`` is a document like any other; an empty table gives no rows;
further columns are ignored by ``mix`` and kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.shared import materialize

WEIGHTS = (5, 2, 1)
SHARE_TENTHS = 15
MOST_COPIES = 2
FAN = 64
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: ``source, source_size, n_open, target``. Its windows see one row per source.

    A source is capped if, with all sources of smaller cap per weight capped, its share still exceeds its cap;
    those sources come first by cap per weight, so a running sum decides without iterating.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n_open"))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", MOST_COPIES * F.col("source_size"))
    s = s.withColumn("goal10", SHARE_TENTHS * F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    s = s.withColumn("capped", (wide("goal10") - 10 * wide("cap_before")) * wide("w") > 10 * wide("cap") * (wide("all_w") - wide("w_before")))
    s = s.withColumn("rest10", F.col("goal10") - 10 * F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)))
    s = s.withColumn("rest_w", F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("rest10") / 10.0 * F.col("w") / F.col("rest_w"))
    return s.select("source", "source_size", "n_open", target.alias("target"))


def _chance(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts, F.lit(SEED)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _meet(state: Column, x: Column) -> Column:
    """One pivotal step between the open document of ``state`` and ``x``; the one that becomes whole joins ``done``."""
    a = state["open"]
    ratio = x["size"] / a["size"]
    up, down = F.least(1 - a["p"], x["p"] * ratio), F.least(a["p"], (1 - x["p"]) * ratio)
    rise = _chance(a["key"], x["key"], a["size"], x["size"]) * (up + down) < down
    a_first = F.when(rise, 1 - a["p"] <= x["p"] * ratio).otherwise(a["p"] <= (1 - x["p"]) * ratio)  # a becomes whole, else x
    left = F.when(rise, F.when(a_first, x["p"] - (1 - a["p"]) / ratio).otherwise(a["p"] + x["p"] * ratio)).otherwise(
        F.when(a_first, x["p"] + a["p"] / ratio).otherwise(a["p"] - (1 - x["p"]) * ratio)
    )
    whole = (rise == a_first).cast("int")  # a rises to 1 or falls to 0; x does the opposite
    out, stay = F.when(a_first, a).otherwise(x), F.when(a_first, x).otherwise(a)
    done = F.struct(out["doc_id"].alias("doc_id"), out["key"].alias("key"), out["nth"].alias("nth"), out["size"].alias("size"), whole.alias("extra"))
    keep = F.struct(stay["key"].alias("key"), stay["doc_id"].alias("doc_id"), stay["nth"].alias("nth"), stay["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)).alias("p"))
    return F.struct(keep.alias("open"), F.concat(state["done"], F.array(done)).alias("done"))


def _fold(items: Column, done_type: str) -> Column:
    first = F.struct(F.element_at(items, 1).alias("open"), F.array().cast(done_type).alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), first, _meet)


def row_key() -> Column:
    """A hash of what tells documents apart here; never null, so rows with null ids spread like others."""
    return F.xxhash64("doc_id", "source", "size")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, nth``; ``nth`` numbers rows of one ``row_key``, by id, source and size."""
    rows = docs.select("doc_id", "source", word_count("text").alias("size")).withColumn("_row_key", row_key())
    order = Window.partitionBy("_row_key").orderBy("doc_id", "source", "size")
    return rows.withColumn("nth", F.row_number().over(order)).drop("_row_key")


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, source, nth, size, source_size, target, copies, taken`` for each row."""
    sizes = materialize(sized(docs), "sizes")
    targets = materialize(source_targets(sizes), "targets")
    most = targets.agg(F.max("n_open")).first()[0] or 0
    per = F.try_divide(F.col("target"), F.col("source_size"))
    at = targets.withColumnRenamed("source", "_source")
    rows = sizes.join(at, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("base", F.when(F.col("source_size") > 0, F.floor(per)).otherwise(0).cast("int"))
    rows = rows.withColumn("p", F.when(F.col("source_size") > 0, per - F.col("base")).otherwise(0.0))
    columns = ["source", "source_size", "target", "base"]
    open_rows = (F.col("size") > 0) & (F.col("p") > 0)
    out = [rows.where(~open_rows).select("doc_id", "nth", "size", *columns, F.lit(0).alias("extra"))]

    item = F.struct(F.xxhash64("doc_id", "size", "nth", F.lit(SEED)).alias("key"), "doc_id", "nth", "size", "p")
    blocks = F.ceil(F.col("n_open") / FAN)
    level = rows.where(open_rows).select(*columns, item.alias("item"), F.pmod(F.col("item.key"), blocks).alias("block"))
    id_type = dict(docs.dtypes)["doc_id"]
    done_type = f"array<struct<doc_id:{id_type},key:bigint,nth:int,size:bigint,extra:int>>"
    n = max(1, -(-most // FAN))
    step = 0
    while True:
        step += 1
        packed = level.groupBy("source", "block").agg(*(F.first(c).alias(c) for c in columns[1:]), F.array_sort(F.collect_list("item")).alias("items"))
        folded = materialize(packed.select(*columns, "block", _fold(F.col("items"), done_type).alias("state")), f"mix-{step}")
        done = folded.select(*columns, F.explode("state.done").alias("d"))
        out.append(done.select("d.doc_id", "d.nth", "d.size", *columns, "d.extra"))
        if n <= 1:
            break
        level = folded.select(*columns, F.col("state.open").alias("item"), F.floor(F.col("block") / FAN).alias("block"))
        n = -(-n // FAN)
    last = F.col("state.open")  # of each source
    out.append(folded.select(last["doc_id"].alias("doc_id"), last["nth"].alias("nth"), last["size"].alias("size"), *columns, (_chance(last["key"], F.lit("last")) < last["p"]).cast("int").alias("extra")))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    copies = (F.col("base") + F.col("extra")).cast("int")
    return result.select("doc_id", "source", "nth", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Documents without words go.

    Of rows equal in id, source and size, which one the mix repeats is decided by a hash of their texts.
    """
    taken = mix(docs).where((F.col("copies") > 0) & (F.col("size") > 0)).select(row_key().alias("_taken"), F.col("nth").alias("_nth"), "copies")
    rows = docs.select(F.struct("*").alias("d"), "doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("text_hash"))
    order = Window.partitionBy("_row_key").orderBy("doc_id", "source", "size", "text_hash")
    numbered = rows.withColumn("_row_key", row_key()).withColumn("_row_no", F.row_number().over(order))
    # The rows stay where the window has put them: their number is compared by difference, so it is no key to shuffle by.
    both = numbered.join(taken, (F.col("_row_key") == F.col("_taken")) & (F.col("_row_no") - F.col("_nth") == 0))
    return both.select("d", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("d.*")
