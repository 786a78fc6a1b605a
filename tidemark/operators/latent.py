"""Learned text vectors: hashed terms weighed by rarity, brought to unit length, and projected on the directions in which texts vary most.

The directions are eigenvectors of the terms' covariance, which Spark adds up over all texts: one pass, and a matrix of terms by terms whatever the number of
texts. Texts are projected where they are read, by built-in transformers. Near copies lie together, and texts of one subject nearer than others.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.text import tokens
from tidemark.functions.vector import norm
from tidemark.work import cut

TERMS, SIZE = 1024, 64


def _listed(news: DataFrame, text: str) -> DataFrame:
    return news.withColumn("_terms", tokens(F.coalesce(F.col(text), F.lit(""))))


def _hashing(terms: int) -> HashingTF:
    return HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=terms)


def _directions(hashed: DataFrame, size: int, terms: int) -> PipelineModel | None:
    """Learns from rows with a term; ``hashed`` is read several times."""
    rows = hashed.where("_any").select("_tf")
    if rows.isEmpty():
        return None
    stages = [IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_unit"), PCA(k=min(size, terms), inputCol="_unit", outputCol="_latent")]
    return Pipeline(stages=stages).fit(rows)


def _hashed(news: DataFrame, text: str, terms: int, *keep: str) -> DataFrame:
    """Term counts, written out: rarity, means and covariance each take a pass, and none shall take texts apart again."""
    rows = _hashing(terms).transform(_listed(news, text))
    return cut(rows.select(*keep, "_tf", (F.size("_terms") > 0).alias("_any")), "latent-terms")


def fit(news: DataFrame, text: str, size: int = SIZE, terms: int = TERMS) -> PipelineModel | None:
    """Learns from all texts with a word; None if there are none."""
    model = _directions(_hashed(news, text, terms), size, terms)
    return model and PipelineModel([_hashing(terms), *model.stages])


def learned(news: DataFrame, key: str, text: str, size: int = SIZE, terms: int = TERMS) -> DataFrame:
    """``key, embedding`` of ``news`` by what they themselves teach: ``embed`` after ``fit``, but each text is taken apart once."""
    hashed = _hashed(news, text, terms, key)
    return _embedded(hashed, _directions(hashed, size, terms)).select(key, "embedding")


def embed(news: DataFrame, text: str, model: PipelineModel | None) -> DataFrame:
    """Adds ``embedding``, floats of unit length; zeros for a text without words, null without a model."""
    return _embedded(_listed(news, text), model).drop("_terms", "_tf")


def _embedded(rows: DataFrame, model: PipelineModel | None) -> DataFrame:
    if model is None:
        return rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    out = model.transform(rows).withColumn("_latent", vector_to_array("_latent"))
    # The length is bound to a variable: named inside the inner function it would be worked out for every component.
    unit = F.flatten(F.transform(F.array(norm("_latent")), lambda n: F.transform("_latent", lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0)).cast("float"))))
    return out.withColumn("embedding", unit).drop("_idf", "_unit", "_latent")
