import hashlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tidemark.llm import mixing, quality_crf, queries, simhash, toxicity_mil

DATA = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, docs, labels, tokenizer):
    """Each stage against its operator's verdicts, or the library, on what its predecessor kept."""
    library = Tokenizer.from_file(tokenizer)
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, DATA)
        rows = out.collect()
        seen[name] = len(rows)
        if name != "encode":
            assert out.columns == docs.columns
        before = {r.doc_id: r for r in now.collect()}
        if name == "quality":
            verdict = quality_crf.score_documents(now, quality_crf.train(now, labels)).where("predicted = 1")
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in verdict.collect())
        if name == "toxicity":
            verdict = toxicity_mil.toxicity(now, toxicity_mil.train(now, labels)).where("predicted = 0")
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in verdict.collect())
        if name == "near_dedup":
            fp = {d: simhash.fingerprint(r.text) for d, r in before.items()}
            kept = sorted(r.doc_id for r in rows)
            assert all(bin(fp[a] ^ fp[b]).count("1") > 2 for a in kept for b in kept if a < b)
            assert set(kept) == {r.component_id for r in simhash.components(now).collect()}
        if name == "mix":
            copies = {r.doc_id: r.copies for r in mixing.mix(now).collect()}
            assert sorted(r.doc_id for r in rows) == sorted(d for d, n in copies.items() for _ in range(n))
        if name == "encode":
            want = sorted((r.doc_id, *digest(library, r.text)) for r in now.collect())
            assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in rows) == want
        now = out
    assert seen["quality"] < docs.count() and all(seen.values())


def digest(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_odd_documents_go_through(spark, odd_docs, empty_docs, tokenizer):
    """Rows, not ids, are counted: null and repeated ids must neither vanish nor multiply. Extra columns stay as they are."""
    library = Tokenizer.from_file(tokenizer)
    now = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, DATA)
        before, after = (Counter(repr(tuple(r)) for r in t.collect()) for t in (now, out))
        if name in ("quality", "toxicity"):
            assert all(before[r] == n for r, n in after.items())  # copies of a row share its fate
        elif name == "near_dedup":
            assert all(n == 1 and r in before for r, n in after.items())
            left, all_of = ({simhash.fingerprint(r.text) for r in t.collect()} for t in (out, now))
            assert all(any(bin(f ^ g).count("1") <= 2 for g in left) for f in all_of)
        elif name == "mix":
            assert all(r in before and n <= 2 * before[r] for r, n in after.items())
            assert sum(after.values()) == sum(r.copies for r in mixing.mix(now).collect() if r.size)
        else:
            want = sorted(repr((r.doc_id, *digest(library, r.text or ""))) for r in now.collect())
            assert sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256)) for r in out.collect()) == want
            assert all(len(r.ids) == r.n_tokens and hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in out.collect())
        if name != "encode":
            assert out.columns == odd_docs.columns
        now = out
    now = empty_docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA)
        assert now.collect() == []


def test_run_leaves_only_its_result(spark, tmp_path):
    from tidemark import work

    made = len(work._MADE)
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and len(work._MADE) == made + 1


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(names)
