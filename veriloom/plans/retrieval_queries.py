"""Corpus, embeddings, dense search and reranking. Queries are the vectors whose id is divisible by 20, held against all others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators import shape as S
from ..operators.skew import lookup_join
from .registry import query
from .shape_queries import STATUS, REFS
from .text_queries import norm_sql

CORPUS = f"""corpus AS (SELECT page_id || '::' || CAST(sentence_id AS VARCHAR) AS corpus_id, page_id, sentence_id, text, corpus_version
FROM (SELECT *, row_number() OVER (PARTITION BY page_id, sentence_id ORDER BY row_id) AS r FROM sentences) WHERE r = 1 AND page_id IS NOT NULL AND sentence_id IS NOT NULL AND {norm_sql('text')} <> '')"""
CAND = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
cand AS (SELECT * FROM (SELECT q.vec_id AS q, c.vec_id AS c, q.label = c.label AS gold, list_inner_product(q.e, c.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id) WHERE rank <= 20)"""
RSCORE = "1 / (1 + exp(-4 * (score + (((c * 7919 + q * 104729) % 1000) / CAST(1000 AS DOUBLE) - 0.5) * 0.1)))"
RERANKED = f"""{CAND}, reranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY reranker_score DESC, rank) AS reranked_rank FROM (SELECT *, {RSCORE} AS reranker_score FROM cand))"""


def candidates(t):
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    top = R.top_k(e, e.filter("id % 20 = 0"), 20)
    label = t("embeddings").select("vec_id", "label")
    return top.join(label.toDF("q", "ql"), "q").join(label.toDF("c", "cl"), "c").select("q", "c", (F.col("ql") == F.col("cl")).alias("gold"), "score", "rank")


def reranked(t, keep: int = 20):
    return R.rerank(candidates(t), F.expr(RSCORE), keep)


@query("PR17 SO4", f"WITH {CORPUS} SELECT corpus_id, text, corpus_version FROM corpus")
def corpus_build(t):
    return R.corpus(t("sentences")).select("corpus_id", "text", "corpus_version")


@query("VA6", f"""
SELECT row_id, 'blank_text' AS issue FROM sentences WHERE {norm_sql('text')} = '' UNION ALL SELECT row_id, 'no_version' FROM sentences WHERE corpus_version IS NULL
UNION ALL SELECT row_id, 'duplicate_id' FROM (SELECT row_id, row_number() OVER (PARTITION BY page_id, sentence_id ORDER BY row_id) AS r FROM sentences) WHERE r > 1""")
def corpus_validate(t):
    s = t("sentences")
    keyed = s.select("row_id", S.one_key("page_id", "sentence_id").alias("k"))
    first = keyed.groupBy("k").agg(F.min("row_id").alias("first"))
    dup = lookup_join(keyed, first, "k").filter("row_id <> first").select("row_id", F.lit("duplicate_id").alias("issue"))
    return Q.issues(s, ["row_id"], {"blank_text": T.is_blank(F.col("text")), "no_version": F.col("corpus_version").isNull()}).unionAll(dup)


@query("PR18", """
SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, count(CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 1 END) AS n_not_finite FROM embeddings""")
def embeddings_validate(t):
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    dim = F.size("embedding").cast("long")
    return t("embeddings").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("n_ids"), F.min(dim).alias("min_dim"), F.max(dim).alias("max_dim"), F.count_if(bad).alias("n_not_finite"))


@query("FN9", """
SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first_unit FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def l2_normalize(t):
    norm = R.l2_norm(F.col("embedding"))
    return t("embeddings").select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.element_at("embedding", 1).cast("double") / norm, 6).alias("first_unit"))


@query("FN10", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.e, b.e), 6) AS ip, round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)), 6) AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def vector_similarity(t):
    a = t("embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = t("embeddings").select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    ip = R.inner_product(F.col("x"), F.col("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(ip, 6).alias("ip"), F.round(ip / (R.l2_norm(F.col("x")) * R.l2_norm(F.col("y"))), 6).alias("cosine"))


@query("WN1 JN10 JN11", f"WITH {CAND} SELECT q, c, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM cand")
def dense_topk(t):
    return candidates(t).select("q", "c", "rank", F.round("score", 6).alias("score"))


@query("JN12", f"WITH {CAND} SELECT q, count(*) AS n, count(CASE WHEN gold THEN 1 END) AS n_gold FROM cand GROUP BY q")
def gold_candidates(t):
    return candidates(t).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.count_if("gold").alias("n_gold"))


@query("WN6 AG29 IT6", f"""
WITH {CAND}, hits AS (SELECT q, min(CASE WHEN gold THEN rank END) AS h FROM cand GROUP BY q)
SELECT k, count(*) AS n_queries, round(count(CASE WHEN h <= k THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS recall FROM hits, (VALUES (1), (5), (10), (20)) ks(k) GROUP BY k""")
def recall_at_k(t):
    return R.recall_at(R.first_hits(candidates(t), "rank", F.col("gold")), [1, 5, 10, 20])


@query("WN2", f"WITH {RERANKED} SELECT q, c, CAST(rank AS INTEGER) AS rank, CAST(reranked_rank AS INTEGER) AS reranked_rank, round(reranker_score, 6) AS reranker_score FROM reranked WHERE reranked_rank <= 5")
def rerank(t):
    return reranked(t, 5).select("q", "c", "rank", "reranked_rank", F.round("reranker_score", 6).alias("reranker_score"))


@query("AG30 AG31", f"""
WITH {RERANKED}, h AS (SELECT q, min(CASE WHEN gold THEN rank END) AS f, min(CASE WHEN gold THEN reranked_rank END) AS r FROM reranked GROUP BY q)
SELECT count(*) AS n, count(CASE WHEN r < f THEN 1 END) AS improved, count(CASE WHEN f IS NOT DISTINCT FROM r THEN 1 END) AS unchanged, count(CASE WHEN r > f THEN 1 END) AS worsened, round(avg(f), 6) AS mean_before, round(avg(r), 6) AS mean_after, round(avg(r) - avg(f), 6) AS delta FROM h""")
def rank_shift(t):
    r = reranked(t)
    h = r.groupBy("q").agg(F.min(F.when(F.col("gold"), F.col("rank"))).alias("f"), F.min(F.when(F.col("gold"), F.col("reranked_rank"))).alias("r"))
    f, r = F.col("f"), F.col("r")
    return h.agg(F.count(F.lit(1)).alias("n"), F.count_if(r < f).alias("improved"), F.count_if(f.eqNullSafe(r)).alias("unchanged"), F.count_if(r > f).alias("worsened"), F.round(F.avg(f), 6).alias("mean_before"), F.round(F.avg(r), 6).alias("mean_after"), F.round(F.avg(r) - F.avg(f), 6).alias("delta"))


@query("JN17 SO3 ST5", f"""
WITH {REFS}, {STATUS}, {CORPUS}, sets AS (SELECT r.record_id, r.set_pos, bool_and(c.corpus_id IS NOT NULL) AS whole FROM refs r LEFT JOIN corpus c ON r.page_id = c.page_id AND r.sentence_id = c.sentence_id GROUP BY ALL),
rel AS (SELECT DISTINCT r.record_id, r.page_id || '::' || CAST(r.sentence_id AS VARCHAR) AS cid FROM refs r JOIN sets s ON r.record_id = s.record_id AND r.set_pos = s.set_pos WHERE s.whole)
SELECT record_id, count(*) AS n_relevant, string_agg(cid, '|' ORDER BY cid) AS relevant FROM rel GROUP BY record_id ORDER BY md5('7|' || CAST(record_id AS VARCHAR)), record_id LIMIT 200""")
def eval_set_build(t):
    from ..operators import claims as C

    refs = C.evidence_references(t("pool_records"), "record_id", "premise_reference")
    known = R.corpus(t("sentences")).select("page_id", "sentence_id", "corpus_id")
    joined = refs.join(known, ["page_id", "sentence_id"], "left")
    whole = joined.groupBy("record_id", "set_pos").agg(F.bool_and(F.col("corpus_id").isNotNull()).alias("whole"), F.collect_set("corpus_id").alias("ids")).filter("whole")
    relevant = whole.select("record_id", F.explode("ids").alias("cid")).distinct().groupBy("record_id").agg(F.count(F.lit(1)).alias("n_relevant"), F.array_join(F.array_sort(F.collect_list("cid")), "|").alias("relevant"))
    return relevant.orderBy(S.md5_order(F.lit("7"), F.col("record_id").cast("string")), "record_id").limit(200)
