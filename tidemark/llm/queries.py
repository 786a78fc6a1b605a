"""One query per operator, over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import chat_format, cover_tree, jaccard_join, mixing, quality_crf, quality_rules, simhash, token_files, toxicity_mil, transducer_bpe, warc_zstd, weighted_lloyd, whitening
from tidemark.llm.shared import materialize

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_crf.score_documents(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"))


def op5_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = spark.sql("select -1L as conv_id, stack(2, 0L, 'user', 1L, 'assistant') as (turn, role)").withColumn("text", F.lit(chat_format.CONFLICT))
    return chat_format.read_back(materialize(chat_format.format_turns(rows.unionByName(made)), "chat"))


def op6_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer_bpe.encode_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def op9_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_mil.toxicity(docs, toxicity_mil.train(docs, table(spark, sf_dir, "labels")))


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.read_archives(warc_zstd.write_archives(table(spark, sf_dir, "pages")))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_lloyd.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_crf, op2_token_files, op3_pivotal_mix, op4_cover_tree_topk, op5_chat_round_trip, op6_transducer_bpe, op7_simhash_vptree, op8_adaptive_rules, op9_toxicity_mil, op10_warc_zstd, op11_jaccard_join, op12_whitening, op13_weighted_lloyd)}

_OP4 = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 50 = 0
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""

_OP5 = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e as (
  select *, case when regexp_matches(text, '<\\+\|') or contains(text, '<|im_start|>') or contains(text, '<|im_end|>')
                 then regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') else text end as escaped
  from c
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
       cast(sum(length(role) + length(escaped) + 24) as bigint) as formatted_chars
from e group by conv_id
"""

_OP8 = r"""
with t as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents
), w as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from t
), g as (
  select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
  from (select rid, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3)
), hit as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from g) where n > 1
), rep as (
  select rid, count(distinct i + o) as n from hit, (values (0), (1), (2)) v(o) group by rid
), c as (
  select w.rid, doc_id, lang, source, cast(len(words) as bigint) as n_words,
         cast(length(array_to_string(words, '')) as bigint) as word_chars,
         cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) as bigint) as n_lines,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from w left join rep on rep.rid = w.rid
), m as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c
), long as (
  select rid, lang, source, measure, case when x < 512 then x else 256 * (length(bin(x)) - 9) + (x >> (length(bin(x)) - 9)) end as place
  from (select rid, lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) as measure,
               unnest([(n_symbols + 1) * 1000000 // (n_words + 2), (n_dup_lines + 1) * 1000000 // (n_lines + 2),
                       (n_repeat_words + 1) * 1000000 // (n_words + 2), 1000 * word_chars // greatest(n_words, 1)]) as x
        from m where not base_failed)
), top as (
  select measure, quantile_disc(place, [0.1, 0.25, 0.5, 0.75, 0.9]) as q from long group by measure
), top_fence as (
  select measure, greatest(least(q[3] + 7 * greatest(1, q[3] - q[2]), q[4] + 3 * greatest(1, q[4] - q[2])), q[4]) as high, greatest(0, least(greatest(q[3] - 7 * greatest(1, q[4] - q[3]), q[2] - 3 * greatest(1, q[4] - q[2])), q[2])) as low from top
), mid as (
  select lang, measure, count(*) as n, quantile_disc(place, [0.1, 0.25, 0.5, 0.75, 0.9]) as q from long group by lang, measure
), mid_fence as (
  select lang, mid.measure, (n * greatest(least(q[3] + 7 * greatest(1, q[3] - q[2]), q[4] + 3 * greatest(1, q[4] - q[2])), least(q[5], f.high)) + 20 * f.high) // (n + 20) as high,
         (n * greatest(0, least(greatest(q[3] - 7 * greatest(1, q[4] - q[3]), q[2] - 3 * greatest(1, q[4] - q[2])), greatest(q[1], f.low))) + 20 * f.low) // (n + 20) as low
  from mid join top_fence f on f.measure = mid.measure
), fine as (
  select lang, source, measure, count(*) as n, quantile_disc(place, [0.1, 0.25, 0.5, 0.75, 0.9]) as q from long group by lang, source, measure
), fence as (
  select fine.lang, source, fine.measure, (n * greatest(least(q[3] + 7 * greatest(1, q[3] - q[2]), q[4] + 3 * greatest(1, q[4] - q[2])), least(q[5], f.high)) + 20 * f.high) // (n + 20) as high,
         (n * greatest(0, least(greatest(q[3] - 7 * greatest(1, q[4] - q[3]), q[2] - 3 * greatest(1, q[4] - q[2])), greatest(q[1], f.low))) + 20 * f.low) // (n + 20) as low
  from fine join mid_fence f on f.measure = fine.measure and f.lang is not distinct from fine.lang
), beyond as (
  select rid, bool_or(place > high or (long.measure = 'word_length' and place < low)) as beyond
  from long join fence on fence.measure = long.measure and fence.lang is not distinct from long.lang and fence.source is not distinct from long.source
  group by rid
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce(beyond, false) as kept
from m left join beyond on beyond.rid = m.rid
"""

_OP10 = """
with p as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), w as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) end as winner from p
)
select page_id, payload_bytes, payload_digest,
       case when winner is not null and page_id is distinct from winner then 'revisit' else 'response' end as record_type,
       case when winner is not null and page_id is distinct from winner then winner end as refers_to
from w
"""

_OP11 = r"""
with recursive d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), g as (
  select distinct rid, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i:i + 3], ' ') end as g
  from (select rid, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from d where len(w) > 0)
), n as (
  select rid, count(*) as n from g group by rid
), common as (
  select g, count(*) as c from g group by g having count(*) > 1
), kept as (
  select g.rid, g.g from g join common using (g)
), link as (
  select a.rid as a, b.rid as b
  from kept a join kept b on a.g = b.g and a.rid <> b.rid join n x on x.rid = a.rid join n y on y.rid = b.rid
  group by a.rid, b.rid, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach as (
  select rid as a, rid as b from d
  union select r.a, l.b from reach r join link l on l.a = r.b
), least as (
  select r.a as rid, min(d.doc_id) as component_id from reach r join d on d.rid = r.b group by r.a
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least.component_id from d join least on least.rid = d.rid left join n on n.rid = d.rid
"""


def _op13(rounds: int = 10) -> str:
    """A common table of centroids for each round."""
    steps = ""
    for k in range(rounds):
        steps += f""", a{k} as materialized (
  select rid, c from (select v.rid, m.c, row_number() over (partition by v.rid order by sum((v.x - m.x) * (v.x - m.x)), m.c) as r from v join m{k} m on m.i = v.i group by v.rid, m.c) where r = 1
), m{k + 1} as materialized (
  select m.c, m.i, case when s.n is null then m.x else (s.s - ((s.s % s.n) + s.n) % s.n) // s.n end as x
  from m{k} m left join (select a.c, v.i, sum(v.x) as s, count(*) as n from a{k} a join v on v.rid = a.rid group by a.c, v.i) s on s.c = m.c and s.i = m.i
)"""
    return f"""
with e as (
  select row_number() over () as rid, vec_id, embedding from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), v as materialized (
  select rid, vec_id, generate_subscripts(embedding, 1) as i, cast(floor(1024 * cast(unnest(embedding) as double)) as bigint) as x from e
), m0 as materialized (
  select s.c, v.i, v.x from (select rid, row_number() over (order by sha256('3:' || vec_id)) - 1 as c from e order by c limit 8) s join v on v.rid = s.rid
){steps}, f as materialized (
  select rid, vec_id, c, d from (
    select v.rid, v.vec_id, m.c, sum((v.x - m.x) * (v.x - m.x)) as d, row_number() over (partition by v.rid order by sum((v.x - m.x) * (v.x - m.x)), m.c) as r
    from v join m{rounds} m on m.i = v.i group by v.rid, v.vec_id, m.c) where r = 1
), h as (
  select c, sha256(string_agg(cast(x as varchar), ',' order by i)) as h from m{rounds} group by c
)
select vec_id, cast(f.c as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by f.c) as bigint) as cluster_inertia,
       cast(sum(d) over () as bigint) as inertia, h as centroid_sha256
from f join h on h.c = f.c
"""


ORACLE_SQL = {"op4_cover_tree_topk": _OP4, "op5_chat_round_trip": _OP5, "op8_adaptive_rules": _OP8, "op10_warc_zstd": _OP10, "op11_jaccard_join": _OP11, "op13_weighted_lloyd": _op13()}
