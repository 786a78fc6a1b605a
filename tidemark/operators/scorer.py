"""A trained three-class sentiment scorer: multinomial regression over hashed terms, fitted and applied by Spark.

Terms are words, beginnings of long words, which stand for inflected stems, and single signs, hashed into ``TERMS`` places; classes are neg, neu and pos. A
penalty on the absolute weights keeps the few terms that tell classes apart. All labelled rows but the held-out ones take part, wherever they lie; what comes
together is gradients of the size of the model. Rare classes weigh more, by the root of their share.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.sentiment import CLASSES
from tidemark.work import cut

TERMS, STEPS, PENALTY, STEM = 1 << 17, 60, 0.005, 5
MOD, HELD_OUT = 5, 0


def terms(text: str) -> Column:
    """Words, beginnings of longer words and single signs, lower-cased; a null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))
    stems = lambda d: F.transform(F.filter(d, lambda t: F.length(t) > STEM), lambda t: F.concat(F.left(t, F.lit(STEM)), F.lit("-")))
    # Bound to a variable, as the search would run anew wherever its result is named.
    return F.flatten(F.transform(F.array(F.array_distinct(found)), lambda d: F.concat(d, stems(d))))


def held_out(key: str) -> Column:
    """Rows never learned from: by the key's CRC, so alike everywhere."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % MOD == HELD_OUT, F.lit(True))


def fit(news: DataFrame, labels: DataFrame, key: str = "news_id", text: str = "text", label: str = "label") -> PipelineModel | None:
    """The scorer, learned from ``labels`` (``key``, ``label`` one of ``CLASSES``); None without usable rows. Rows of equal key count as often as they come."""
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col(label)) - 1
    usable = labels.where(F.col(label).isin(*CLASSES) & ~held_out(key)).select(key, place.cast("double").alias("_y"))
    hashing = HashingTF(inputCol="_terms", outputCol="_x", numFeatures=TERMS, binary=True)
    rows = cut(hashing.transform(news.join(usable, key).select(terms(text).alias("_terms"), "_y")).select("_x", "_y"), "scorer-rows")
    n = {r["_y"]: r.n for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    share = F.element_at(F.create_map(*(F.lit(v) for y in n for v in (y, (sum(n.values()) / len(n) / n[y]) ** 0.5))), F.col("_y"))
    regression = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_class", family="multinomial", maxIter=STEPS, regParam=PENALTY, elasticNetParam=1.0)
    model = Pipeline(stages=[regression]).fit(rows.withColumn("_w", share))
    return PipelineModel([hashing, *model.stages])


def score(news: DataFrame, text: str, model: PipelineModel | None) -> DataFrame:
    """Adds ``sentiment`` (neg, neu, pos, adding up to 1); without a model all is neutral. Classes that no label had come out as nothing."""
    none = F.struct(*(F.lit(float(c == "neu")).alias(c) for c in CLASSES))
    if model is None:
        return news.withColumn("sentiment", none)
    p = vector_to_array("_p")
    of = lambda k: F.coalesce(F.get(p, F.lit(k)), F.lit(0.0))
    scored = model.transform(news.withColumn("_terms", terms(text)))
    return scored.withColumn("sentiment", F.struct(*(of(k).alias(c) for k, c in enumerate(CLASSES)))).drop("_terms", "_x", "_raw", "_p", "_class")
