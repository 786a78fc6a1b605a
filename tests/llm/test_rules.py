import re
from collections import Counter

import duckdb

from tidemark.llm import quality_rules
from tidemark.llm.queries import ORACLE_SQL


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if n[g] > 1 for o in range(3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_counts(docs, odd_docs):
    for table in (docs, odd_docs):
        got = quality_rules.base_counts(table).collect()
        rows = table.select("doc_id", "text").collect()
        key = lambda x: tuple(map(repr, x))
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((r.doc_id, *brute(r.text)) for r in rows), key=key)


def test_rules_equal_sql(odd_docs, empty_docs):
    con = duckdb.connect()
    con.register("documents", odd_docs.toArrow())
    cur = con.execute(ORACLE_SQL["op8_adaptive_rules"])
    names = [d[0] for d in cur.description]
    got = sorted(repr(tuple(r)) for r in quality_rules.apply_rules(odd_docs).select(*names).collect())
    assert got == sorted(repr(r) for r in cur.fetchall())
    assert quality_rules.apply_rules(empty_docs).collect() == []


def test_fences_adapt_to_their_group(spark):
    """The same share of symbols passes where it is usual and fails where it is not; merged sketches serve small groups."""
    word = lambda i, k: f"w{i * 60 + k:07d}x"
    text = lambda i, sign: " ".join(word(i, k) + ("#" if k < sign else "") for k in range(60))
    rows = [(i, text(i, 30 + i % 5), "en", "code") for i in range(150)] + [(1000 + i, text(1000 + i, i % 2), "en", "prose") for i in range(600)]
    rows += [(5000, text(5000, 32), "en", "prose"), (5001, text(5001, 32), "en", "code"), (5002, text(5002, 32), "en", "rare"), (5003, text(5003, 0), "en", "rare")]
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[5000].kept and got[5000].rejected_by == "symbols"
    assert got[5001].kept and got[5003].kept
    assert sum(r.kept for r in got.values()) >= len(rows) - 2


def made(spark, groups):
    """Documents of ``(language, source, [(words, symbols), ...])``; words differ, so nothing repeats."""
    rows = []
    for lang, source, shapes in groups:
        for n, signs in shapes:
            i = len(rows)
            rows.append((i, " ".join(f"w{i * 1000 + k:07d}x" + ("#" if k < signs else "") for k in range(n)), lang, source))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_a_hot_source_of_junk_does_not_set_its_own_fence(spark):
    """30 % of one source, 200 documents, hold 500 symbols a thousand words: all of them go, and all others stay."""
    lengths = [60 + 7 * (i % 40) for i in range(200)]
    hot = [(n, n // 2 if i % 10 < 3 else 0) for i, n in enumerate(lengths)]
    rows, docs = made(spark, [("en", "hot", hot), ("en", "calm", [(n, 0) for n in lengths])])
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    for i, (n, signs) in enumerate(hot + [(n, 0) for n in lengths]):
        assert got[i].kept == (signs == 0), (i, n, signs)


def test_fences_come_from_the_data_where_all_quartiles_are_zero(spark):
    """No source has a symbol in three of four documents; their fences still differ, as their lengths do."""
    rows, docs = made(spark, [("en", f"s{g}", [(50 + (i * (5 + 9 * g)) % 400, i % 5 == 0) for i in range(150)]) for g in range(3)])
    sketch = quality_rules.materialize(quality_rules.sketches(quality_rules.with_measures(quality_rules.base_counts(docs))), "sketch")
    high = [r.symbols.high for r in quality_rules.group_fences(sketch).collect()]
    assert len(set(high)) == 3
    assert all(r.kept for r in quality_rules.apply_rules(docs).collect())


def test_a_majority_of_copies_does_not_reject_the_rest(spark):
    """Most of a source is one document many times; a fence without any spread would reject what differs from it."""
    lengths = [60 + 7 * (i % 40) for i in range(450)]
    rows, docs = made(spark, [("en", "copies", [(n, 0) for n in lengths[:150]]), ("en", "calm", [(n, 0) for n in lengths])])
    copies = [(10_000 + i, rows[70][1], "en", "copies") for i in range(400)]
    got = quality_rules.apply_rules(spark.createDataFrame(rows + copies, docs.schema)).where("kept").count()
    assert got >= 0.9 * len(rows + copies)


def test_no_size_at_which_a_verdict_switches(spark):
    """A source's fence moves with each further document by little: 99 or 101 documents give nearly the same."""
    def high(n):
        rows, docs = made(spark, [("en", "grows", [(60 + i % 30, 6 + i % 3) for i in range(n)]), ("en", "calm", [(60 + 7 * (i % 40), 0) for i in range(300)])])
        sketch = quality_rules.materialize(quality_rules.sketches(quality_rules.with_measures(quality_rules.base_counts(docs))), "sketch")
        return {r.source: r.symbols.high for r in quality_rules.group_fences(sketch).collect()}["grows"]

    assert abs(high(99) - high(101)) < 0.05 * high(99)


def test_native_plan(docs):
    plan = quality_rules.apply_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
