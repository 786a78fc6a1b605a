"""The trained scorer, macro answers by scope, and the path from news to sentiment."""

import json
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import latent, macro, scorer, sentiment
from tidemark.plans import path
from tidemark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_scorer_on_held_out_news(spark):
    sf = "/root/testdata/sf0.1"
    n = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("news_id"), "text")
    la = path.labels(spark, sf)
    model = scorer.fit(n, la)
    rows = scorer.score(n.join(la, "news_id"), "text", model).select("news_id", "label", "sentiment", scorer.held_out("news_id").alias("out"), sentiment.label(F.col("sentiment.neg"), F.col("sentiment.neu"), F.col("sentiment.pos")).alias("got")).collect()
    assert all(r.out == (zlib.crc32(str(r.news_id).encode()) % 5 == 0) for r in rows)
    assert all(abs(sum(r.sentiment) - 1) < 1e-9 for r in rows)
    out = [r for r in rows if r.out]
    right = lambda c: sum(r.got == r.label for r in out if c in (None, r.label)) / sum(c in (None, r.label) for r in out)
    assert len(out) > 700 and right(None) > 0.93 and right("neg") > 0.8 and right("neu") > 0.75 and right("pos") > 0.97


def test_scorer_without_labels_nulls_and_one_class(spark):
    n = spark.createDataFrame([(1, "good thing"), (2, None), (3, ""), (None, "bad thing")], "news_id long, text string")
    none = spark.createDataFrame([], "news_id long, label string")
    assert scorer.fit(n, none) is None
    assert {tuple(r.sentiment) for r in scorer.score(n, "text", None).collect()} == {(0.0, 1.0, 0.0)}
    one = spark.createDataFrame([(i, "pos") for i in range(1, 4)] + [(1, "other"), (2, None)], "news_id long, label string")
    got = scorer.score(n, "text", scorer.fit(n, one)).collect()
    assert len(got) == 4 and all(abs(sum(r.sentiment) - 1) < 1e-9 for r in got)


def test_path_counts_each_story_once(spark):
    mentions = QUERIES["path_mentions"](spark, SF).groupBy("ticker", "month").agg(F.sum("n_news").alias("n")).collect()
    scored = QUERIES["path_sentiment"](spark, SF).collect()
    assert {(r.ticker, r.month): r.n for r in mentions} == {(r.ticker, r.month): r.n_news for r in scored} and scored
    assert all(-1 <= r.sent <= 1 and r.n_neg + r.n_pos <= r.n_news for r in scored)


def test_news_scores_hold_all_news(spark):
    rows = QUERIES["news_scores"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    learned = [r for r in rows if r.label and not r.held_out]
    assert sum(r.predicted == r.label for r in learned) > 0.9 * len(learned)


def test_answers_about_one_sector_are_of_its_scope(spark):
    ask = lambda t: json.loads(macro.rule_classifier(t))
    assert ask("Ставка растёт, банки рады")["scope"] == "sector" and ask("Ставка растёт, банки рады")["sector"] == "Банки"
    assert ask("Ставка: нефть и банки")["scope"] == "market" and ask("инфляция")["sector"] is None
    n = spark.createDataFrame([(1, "Санкции против банков: $SBER и $NONE"), (2, "инфляция, $GAZP"), (3, "погода в банке"), (4, None)], "news_id long, text string")
    known = spark.createDataFrame([("SBER",), ("GAZP",), ("SBER",), (None,)], "ticker string")
    s = macro.only_macro(macro.signals(macro.classify(n, "text"), "answer", known)).withColumn("score", F.lit(-0.5)).withColumn("month", F.lit("m"))
    assert sorted((r.news_id, r.signal["class"], r.signal.scope, r.signal.sector, tuple(r.signal.tickers)) for r in s.collect()) == [(1, "geo", "sector", "Банки", ("SBER",)), (2, "macro", "market", None, ("GAZP",))]
    market, sector = macro.by_scope(s, "month", "score")
    assert [(r.month, r.n_news) for r in market.collect()] == [("m", 1)] and [(r.sector, r.n_news) for r in sector.collect()] == [("Банки", 1)]


def test_signals_keep_rows_and_the_order_of_their_lists(spark):
    """No list, an empty one, nulls and repeats in it, equal lists in many rows, names that clash."""
    lists = [["B", "A", "Z", "A"], [], None, ["Z"], ["B", "A", "Z", "A"], [None, "A"]]
    rows = [(k, json.dumps({"class": "macro", "scope": "market", "sector": None, "tickers": t}), "x", "y") for k, t in enumerate(lists)] + [(9, "not json", "x", "y"), (9, None, "x", "y"), (10, json.dumps({"class": "geo", "scope": "sector", "tickers": []}), "x", "y")]
    df = spark.createDataFrame(rows, "id int, answer string, ticker string, tickers string")
    got = {(r.id, r.answer): r.signal and r.signal.tickers for r in macro.signals(df, "answer", spark.createDataFrame([("A",), ("B",)], "ticker string")).collect()}
    assert [got[r[0], r[1]] for r in rows] == [["B", "A"], [], [], [], ["B", "A"], ["A"], None, None, None]
    assert macro.signals(df, "answer", spark.createDataFrame([], "ticker string")).count() == len(rows)


def test_macro_path_has_both_scopes(spark):
    rows = QUERIES["macro_path"](spark, "/root/testdata/sf0.01").collect()
    assert {r.scope for r in rows} == {"market", "sector"} and all((r.sector is None) == (r.scope == "market") for r in rows)


def test_learned_vectors_keep_the_neighbours_of_the_terms(spark):
    """Against brute force over hashed terms: the directions, the cosines of near copies, and each text's own group."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array

    from tidemark.operators import latent, minhash

    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("news_id"), "text")
    model = latent.fit(n, "text")
    rows = model.transform(latent._listed(n, "text")).select("news_id", vector_to_array("_unit").alias("x")).orderBy("news_id").collect()
    x = np.array([r.x for r in rows])
    values, axes = np.linalg.eigh(np.cov(x.T))
    want = x @ axes[:, ::-1][:, : latent.SIZE]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    got = np.array([r.embedding for r in latent.embed(n, "text", model).orderBy("news_id").collect()])
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-3)
    place = {r.news_id: k for k, r in enumerate(rows)}
    pairs = minhash.similar_pairs(n, "news_id", "text").collect()
    assert len(pairs) > 50 and min(got[place[p.a]] @ got[place[p.b]] for p in pairs) > 0.97
    groups = {r.news_id: r.cluster_id for r in QUERIES["dedup_learned"](spark, sf).collect()}
    assert len(groups) == len(rows) and all(groups[p.a] == groups[p.b] for p in pairs if p.jaccard > 0.95)


def test_learned_vectors_of_odd_texts(spark):
    from tidemark.operators import latent

    n = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, None), (4, " .. "), (None, "b c d"), (1, "a b")], "news_id long, text string")
    got = latent.embed(n, "text", latent.fit(n, "text", 2, 16)).collect()
    assert len(got) == 6 and all(len(r.embedding) == 2 for r in got) and [r.embedding for r in got if not (r.text or "").strip(" .")] == [[0.0, 0.0]] * 2
    assert latent.fit(n.limit(0), "text") is None and latent.embed(n, "text", None).first().embedding is None


def test_bands_carry_ids_alone_and_estimates_are_apart(spark, monkeypatch):
    """What bands bring together is kept as pairs of ids; signatures of all bands ride on no shuffled row."""
    from tidemark.operators import minhash

    kept, put = {}, minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda df, name: kept.setdefault(name, put(df, name)))
    base = [f"w{k}" for k in range(60)]
    n = spark.createDataFrame([(k, " ".join([*base[:50], f"x{k}", *base[50:]])) for k in range(6)] + [(9, "other words here altogether")], "id long, t string")
    full = {(r.a, r.b): r for r in minhash.similar_pairs(n, "id", "t").collect()}
    assert kept["minhash-met"].columns == ["a", "b"] and len(full) == 15 and all(abs(r.jaccard - r.estimate) < 0.3 for r in full.values())
    assert {(r.a, r.b): r.jaccard for r in minhash.similar_pairs(n, "id", "t", estimates=False).collect()} == {k: r.jaccard for k, r in full.items()}


def test_learned_takes_texts_apart_once(spark):
    """Rarity, means, covariance and projection read the counted terms, not the texts; the vectors are those of ``embed`` after ``fit``."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(k):
        read.add(1)
        return f"alpha w{k % 3} v{k % 5}" if k else None

    n = spark.range(0, 30, 1, 2).select(F.col("id").alias("news_id"), text("id").alias("text"))
    got = {r.news_id: r.embedding for r in latent.learned(n, "news_id", "text", 2, 16).collect()}
    assert read.value == 30 and got[0] == [0.0, 0.0]
    want = {r.news_id: r.embedding for r in latent.embed(n, "text", latent.fit(n, "text", 2, 16)).collect()}
    assert all(abs(abs(np.dot(got[k], want[k])) - np.dot(want[k], want[k])) < 1e-5 for k in want)
    assert latent.learned(n.limit(0), "news_id", "text").collect() == []


def test_terms_search_a_text_once(spark):
    news = spark.createDataFrame([("Wonderful, wonderful! a wonder",)], "text string").repartition(1)
    assert sorted(news.select(scorer.terms("text")).first()[0]) == ["!", ",", "a", "wonde-", "wonde-", "wonder", "wonderful"]
    plan = news.select(scorer.terms("text").alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_models_share_one_panel(spark, monkeypatch):
    """The backtest of all models reads trades and news for one panel; what M3 sees more is joined to it."""
    from tidemark.plans import books

    panels, plain = [], books.features
    monkeypatch.setattr(books, "features", lambda *a: panels.append(plain(*a)) or panels[-1])
    monkeypatch.setattr(books, "walk_forward", lambda x: x.where("fwd is not null").select("inst", "month", "fwd", F.col("sent").alias("score")))
    assert QUERIES["backtest_models"](spark, SF).count() == 6 and len(panels) == 1
