"""Models inside the plans: embeddings, pair scores, verification, generation and choice likelihoods with the deterministic stand-ins.

Texts run through the batch scorers of ``operators.scorers``; a trained model takes the place of a stand-in by its factory.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import decide as D
from ..operators import retrieval as R
from ..operators import scorers as M
from .decision_queries import AGG, ITEMS, _decision_sql, aggregates, items
from .registry import query
from .retrieval_queries import CORPUS, RERANKED, reranked
from .text_queries import WS, norm_sql

DIMENSIONS = 64


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{WS}+'), lambda x: x <> '')"


def _vector_sql(name: str, key: str, text: str, source: str) -> str:
    """Hashed bags of words as lists of whole numbers."""
    return f"""{name}_w AS (SELECT {key} AS id, unnest({words_sql(text)}) AS w FROM {source}), {name}_h AS (SELECT id, CAST('0x' || substr(md5(w), 1, 4) AS BIGINT) % {DIMENSIONS} AS b, sum(CASE WHEN substr(md5(w), 5, 1) < '8' THEN 1 ELSE -1 END) AS x FROM {name}_w GROUP BY ALL),
{name} AS (SELECT id, list_transform(range({DIMENSIONS}), lambda k: CAST(coalesce(m[k], 0) AS DOUBLE)) AS e FROM (SELECT {key} AS id, coalesce(any_value(h.m), MAP {{}}::MAP(BIGINT, HUGEINT)) AS m FROM {source} LEFT JOIN (SELECT id, map_from_entries(list((b, x))) AS m FROM {name}_h GROUP BY id) h ON h.id = {key} GROUP BY {key}))"""


def _share_sql(claim: str, text: str) -> str:
    own = f"list_distinct({words_sql(f'coalesce({claim}, {chr(39)*2})')})"
    return f"CASE WHEN len({own}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({own}, list_distinct({words_sql(f'coalesce({text}, {chr(39)*2})')}))) / CAST(len({own}) AS DOUBLE) END"


def whole_numbers():
    """A checked model whose vectors hold whole numbers: products are exact, so ties are ties in any engine."""
    return M.verified(lambda: M.hashed_embedder(DIMENSIONS, False), DIMENSIONS)()


@query("UD1 UD8 FN9", f"WITH {_vector_sql('v', 'item_id', 'text', 'eval_items')} SELECT id AS item_id, CAST(len(list_filter(e, lambda x: x <> 0)) AS INTEGER) AS n_places, round(list_max(e) / sqrt(greatest(list_inner_product(e, e), 1e-24)), 5) AS top FROM v")
def text_embeddings(t):
    rows = t("eval_items").select("item_id", M.embedding_column(F.col("text"), whole_numbers).alias("e"))
    return rows.select("item_id", F.size(F.filter("e", lambda x: x != 0)).alias("n_places"), F.round(F.array_max("e").cast("double") / F.greatest(R.l2_norm(F.col("e")), F.lit(1e-12)), 5).alias("top"))


@query("UD7", f"SELECT CASE WHEN {norm_sql('text')} = '' THEN 'ValueError' END AS error, count(*) AS n, count(CASE WHEN {norm_sql('text')} <> '' THEN 1 END) AS n_vectors FROM sentences GROUP BY 1")
def embedding_failures(t):
    """A model that refuses blank texts: the batch is tried again item by item, what fails is a row with its error."""

    def careful():
        model = M.hashed_embedder(DIMENSIONS)

        def embed(texts):
            if any(x is None or not x.strip() for x in texts):
                raise ValueError("blank text")
            return model(texts)

        return embed

    rows = M.embed_with_failures(t("sentences"), "row_id", "text", careful)
    return rows.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.count("vector").alias("n_vectors"))


_SHARE = _share_sql("hypothesis", "premise")


@query("UD2 FN8", f"SELECT example_id, round(1 / (1 + exp(-(4 * s - 2))), 6) AS score FROM (SELECT example_id, {_SHARE} AS s FROM verifier_examples)")
def pair_relevance(t):
    return t("verifier_examples").select("example_id", F.round(M.relevance_column(F.col("hypothesis"), F.col("premise")), 6).alias("score"))


@query("UD3 FN7", f"SELECT example_id, round(p, 6) AS entailment_probability, CASE WHEN s >= 0.5 THEN 'entailment' ELSE 'contradiction' END AS verifier_label FROM (SELECT *, 1 / (1 + exp(-(8 * s - 4))) AS p FROM (SELECT example_id, {_SHARE} AS s FROM verifier_examples))")
def verified_pairs(t):
    rows = t("verifier_examples").select("example_id", M.pair_column(F.col("premise"), F.col("hypothesis")).alias("v"))
    return rows.select("example_id", F.round("v.entailment_probability", 6).alias("entailment_probability"), F.col("v.verifier_label").alias("verifier_label"))


TEXT_PIPELINE = f"""{CORPUS}, kept AS (SELECT min(s.row_id) AS row_id, c.corpus_id, any_value(c.text) AS text FROM corpus c JOIN sentences s ON s.page_id = c.page_id AND s.sentence_id = c.sentence_id GROUP BY c.corpus_id),
claims AS (SELECT record_id, hypothesis FROM pool_records WHERE record_id % 20 = 0 AND {norm_sql('hypothesis')} <> ''),
{_vector_sql('qv', 'record_id', 'hypothesis', 'claims')}, {_vector_sql('cv', 'row_id', 'text', 'kept')},
cand AS (SELECT * FROM (SELECT q.id AS q, c.id AS c, row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.e, c.e) DESC, c.id) AS rank FROM qv q, cv c WHERE q.id <> c.id) WHERE rank <= 20),
scored AS (SELECT q, c, rank, {_share_sql('hypothesis', 'text')} AS s FROM cand JOIN claims ON record_id = q JOIN kept ON row_id = c),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, rank) AS rr FROM scored) WHERE rr <= 5),
verified AS (SELECT *, 1 / (1 + exp(-(8 * s - 4))) AS ent FROM best),
decided AS (SELECT q, arg_max(c, {{'p': ent, 'r': -rr}}) AS best, max(ent) AS max_ent, max(1 - ent) AS max_con FROM verified GROUP BY q)"""


def text_candidates(t):
    """Claims whose id is divisible by 20 against every sentence of the corpus: (q, c, rank, claim, text)."""
    s = t("sentences")
    kept = R.corpus(s, "row_id").select(F.col("row_id").alias("id"), "text")
    claims = t("pool_records").filter("record_id % 20 = 0").filter(~R.is_blank(F.col("hypothesis"))).select(F.col("record_id").alias("id"), F.col("hypothesis").alias("claim"))
    vectors = kept.select("id", M.embedding_column(F.col("text"), whole_numbers).alias("vector"))
    found = R.top_k(vectors, claims.select("id", M.embedding_column(F.col("claim"), whole_numbers).alias("vector")), 20)
    return found.join(claims.withColumnRenamed("id", "q"), "q").join(kept.withColumnRenamed("id", "c"), "c")


def text_verified(t):
    best = R.rerank(text_candidates(t), M.relevance_column(F.col("claim"), F.col("text")), 5)
    return best.withColumn("v", M.pair_column(F.col("text"), F.col("claim"))).select("q", "c", "rank", "reranked_rank", "v.*")


@query("IT3 WN2 UD1 UD2 UD3", f"WITH {TEXT_PIPELINE} SELECT q, best, round(max_ent, 6) AS max_ent, {_decision_sql('max_ent', 'max_con', '0.7', '0.7')} AS decision FROM decided")
def verify_claims(t):
    """Retrieve, rerank, verify and decide over texts, every stage by its scorer."""
    from ..session import written

    policy = D.Policy(0.7, 0.7)
    v = written(text_verified(t), "verified")
    agg = D.decide(D.query_aggregates(v, ["q"], policy), policy)
    best = D.select_evidence(v, ["q"], "entailment_probability", "reranked_rank", F.col("c")).withColumnRenamed("selected", "best")
    return agg.join(best, "q").select("q", "best", F.round("max_ent", 6).alias("max_ent"), "decision")


@query("WN3", f"WITH {RERANKED} SELECT 'first' AS stage, q, c, CAST(rank AS INTEGER) AS place FROM reranked WHERE rank <= 5 UNION ALL SELECT 'reranked', q, c, CAST(reranked_rank AS INTEGER) FROM reranked WHERE reranked_rank <= 5")
def both_stages(t):
    """The first five of the search and the first five after reranking, from one set of candidates."""
    rows = reranked(t)
    stage = F.array(F.struct(F.lit("first").alias("stage"), F.col("rank").alias("place")), F.struct(F.lit("reranked").alias("stage"), F.col("reranked_rank").alias("place")))
    return rows.select("q", "c", F.inline(stage)).filter("place <= 5").select("stage", "q", "c", "place")


_PROMPT = "CASE WHEN coalesce(system_instruction, '') <> '' THEN 'system: ' || system_instruction || chr(10) ELSE '' END || CASE WHEN coalesce(user_input, '') <> '' THEN 'user: ' || user_input || chr(10) ELSE '' END || 'assistant:'"


@query("UD6", f"SELECT generation_id, md5({_PROMPT}) AS digest FROM generation_results")
def chat_prompts(t):
    return t("generation_results").select("generation_id", F.md5(M.chat_prompt_column(F.col("user_input"), F.col("system_instruction")).cast("binary")).alias("digest"))


@query("UD4", f"""
SELECT generation_id, array_to_string(w[:12], ' ') AS generated_text, CAST(len(p) AS INTEGER) AS prompt_tokens, CAST(least(12, len(w)) AS INTEGER) AS generated_tokens, CAST(NULL AS VARCHAR) AS error FROM (
SELECT generation_id, list_filter(string_split_regex(user_input, '{WS}+'), lambda x: x <> '') AS w, list_filter(string_split_regex({_PROMPT}, '{WS}+'), lambda x: x <> '') AS p FROM generation_results WHERE user_input IS NOT NULL AND NOT contains(user_input, 'user: '))""")
def generated_answers(t):
    g = t("generation_results").filter("user_input IS NOT NULL AND NOT contains(user_input, 'user: ')")
    prompts = g.select("generation_id", M.chat_prompt_column(F.col("user_input"), F.col("system_instruction")).alias("prompt"))
    return M.generate(prompts, "generation_id", "prompt", lambda: M.first_words(12)).select("generation_id", "generated_text", "prompt_tokens", "generated_tokens", "error")


@query("UD5 FN16", f"""
WITH {ITEMS}, c AS (SELECT i.attempt_id, pos, list_distinct({words_sql("coalesce(candidate_answer, '')")}) AS known, {words_sql("coalesce(e.text, '')")} AS w FROM items i JOIN attempt_records a ON a.attempt_id = i.attempt_id WHERE e IS NOT NULL)
SELECT attempt_id, pos, round(len(w) * -ln(exp(1) + exp(-1)) + coalesce(list_sum(list_transform(w, lambda x: CASE WHEN list_contains(known, x) THEN 1.0 ELSE -1.0 END)), 0), 5) AS total,
CASE WHEN len(w) > 0 THEN round((len(w) * -ln(exp(1) + exp(-1)) + list_sum(list_transform(w, lambda x: CASE WHEN list_contains(known, x) THEN 1.0 ELSE -1.0 END))) / len(w), 5) END AS per_token FROM c""")
def choice_likelihoods(t):
    """The evidence texts of an attempt as choices after its answer."""
    rows = t("attempt_records").select("attempt_id", "candidate_answer", F.posexplode("evidence").alias("pos", "e")).filter("e IS NOT NULL")
    scored = rows.select("attempt_id", F.col("pos").cast("long").alias("pos"), M.choice_likelihood(F.col("candidate_answer"), F.col("e.text"), M.shared_word_scores).alias("s"))
    return scored.select("attempt_id", "pos", F.round("s.total", 5).alias("total"), F.round("s.per_token", 5).alias("per_token"))


@query("FN7 FN8 FN16", """
SELECT vec_id, round(1 / (1 + exp(-a)), 6) AS activated, round(exp(a) / (exp(a) + exp(b)), 6) AS share, round(a - ln(exp(a) + exp(b) + exp(c)), 6) AS log_share FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)""")
def score_functions(t):
    a, b, c = (F.element_at("embedding", k).cast("double") for k in (1, 2, 3))
    return t("embeddings").select("vec_id", F.round(N.sigmoid(a), 6).alias("activated"), F.round(N.softmax_of_two(a, b), 6).alias("share"), F.round(F.get(N.log_softmax(F.array(a, b, c)), F.lit(0)), 6).alias("log_share"))


@query("FN11", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT a.vec_id AS a, list_max(list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2]))) AS m FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT a, round(m, 6) AS max_abs_diff, m <= 0.4 AS alike, true AS same FROM d""")
def vectors_compared(t):
    e = t("embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "a").select("a", F.round(N.max_abs_diff(x, y), 6).alias("max_abs_diff"), N.allclose(x, y, 0.0, 0.4).alias("alike"), N.allclose(x, x).alias("same"))


@query("FN12", f"""
WITH {AGG}, d AS (SELECT *, {_decision_sql('max_ent', 'max_con', '0.6', '0.6')} AS decision FROM agg)
SELECT attempt_id, CASE WHEN num = 0 THEN 'no candidates' WHEN decision = 'SUPPORTED' THEN 'entailment ' || format('{{:.4f}}', max_ent) || ' reaches 0.6' WHEN decision = 'CONTRADICTED' THEN 'contradiction ' || format('{{:.4f}}', max_con) || ' reaches 0.6' ELSE 'no candidate is sure enough' END AS reason FROM d""")
def decision_reasons(t):
    policy = D.Policy(0.6, 0.6)
    d = D.decide(aggregates(t, policy), policy)
    return d.select("attempt_id", D.reason(policy, F.col("decision"), F.col("max_ent"), F.col("max_con"), F.col("num_candidates")).alias("reason"))


@query("PR26", f"WITH {ITEMS} SELECT attempt_id, e.corpus_id AS corpus_id, e.text AS text, e.page_id AS page_id, e.sentence_id AS sentence_id, coalesce(e.reranked_rank, e.original_rank) AS rank, round(e.entailment_probability, 6) AS entailment_probability FROM items WHERE e IS NOT NULL")
def evidence_items(t):
    """What a correction is given of each candidate."""
    rows = t("attempt_records").select("attempt_id", F.explode("evidence").alias("e")).filter("e IS NOT NULL")
    return rows.select("attempt_id", "e.corpus_id", "e.text", "e.page_id", "e.sentence_id", F.coalesce("e.reranked_rank", "e.original_rank").alias("rank"), F.round("e.entailment_probability", 6).alias("entailment_probability"))


@query("IT9", f"""
WITH last AS (SELECT run_id, arg_max(mapped_decision, {{'n': attempt_number, 'a': attempt_id}}) AS final_decision, count(DISTINCT attempt_number) AS attempts FROM attempt_records GROUP BY run_id),
{ITEMS}, c AS (SELECT a.run_id, ln(e.entailment_probability) AS ll, pos, e.original_rank <= 5 AS good FROM items i JOIN (SELECT run_id, min(attempt_id) AS attempt_id FROM attempt_records WHERE attempt_number = 0 GROUP BY run_id) a ON a.attempt_id = i.attempt_id WHERE e.entailment_probability > 0 AND e.original_rank IS NOT NULL),
m AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY run_id)) AS w FROM c), s AS (SELECT run_id, sum(CASE WHEN good THEN w ELSE 0 END) / sum(w) AS mass FROM m GROUP BY run_id)
SELECT l.run_id, final_decision, attempts, round(mass, 6) AS choice_mass FROM last l LEFT JOIN s ON s.run_id = l.run_id""")
def two_tracks(t):
    """Of each run the outcome of the loop beside the choice score of its first attempt."""
    from ..operators import metrics as M2

    a = t("attempt_records")
    last = a.groupBy("run_id").agg(F.max_by(F.struct("mapped_decision"), F.struct("attempt_number", "attempt_id")).alias("r"), F.count_distinct("attempt_number").alias("attempts"))
    first = a.filter("attempt_number = 0").groupBy("run_id").agg(F.min("attempt_id").alias("attempt_id"))
    choices = items(t).filter("entailment_probability > 0 AND original_rank IS NOT NULL").join(first, "attempt_id")
    scored = M2.choice_scores(choices.select("run_id", "pos", F.ln("entailment_probability").alias("ll"), (F.col("original_rank") <= 5).alias("good")), "run_id", "ll", "pos", "good")
    return last.join(scored, "run_id", "left").select("run_id", F.col("r.mapped_decision").alias("final_decision"), "attempts", F.round("mass", 6).alias("choice_mass"))


@query("VA17", "SELECT example_id, CASE WHEN lower(trim(label, ' ')) = 'entailment' THEN 2 WHEN lower(trim(label, ' ')) = 'contradiction' THEN 0 END AS output FROM verifier_examples WHERE lower(trim(label, ' ')) IN ('entailment', 'contradiction')")
def label_outputs(t):
    """Which output of a three-way model stands for the label of each example; models with other outputs are refused before planning."""
    M.check_head({0: "ENTAILMENT", 1: "contradiction"})
    rows = M.label_rows({0: "CONTRADICTION", 1: "NEUTRAL", 2: "ENTAILMENT"}, {"entailment", "contradiction"})
    place = F.create_map(*[F.lit(x) for pair in rows.items() for x in pair])
    label = F.lower(F.trim("label"))
    return t("verifier_examples").filter(label.isin(*rows)).select("example_id", place[label].alias("output"))


@query("FN17", """
SELECT source_dataset, n, steps_per_epoch, steps_per_epoch * 3 AS total_steps, CAST(floor(steps_per_epoch * 3 * 0.06::DOUBLE) AS BIGINT) AS warmup_steps FROM (SELECT source_dataset, count(*) AS n, greatest(1, CAST(ceil(count(*) / 32.0::DOUBLE) AS BIGINT)) AS steps_per_epoch FROM verifier_examples GROUP BY source_dataset)""")
def training_steps(t):
    per = t("verifier_examples").groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"))
    return per.select("source_dataset", "n", N.training_steps(F.col("n"), 16, 2, 3, 0.06).alias("s")).select("source_dataset", "n", "s.*")


_SMOKE = ["choice_likelihood_negative", "embedding_dimension", "embedding_finite", "generation_not_empty", "pair_probabilities_sum_to_one", "relevance_between_0_and_1"]


@query("IT12", "SELECT check_name, true AS passed FROM (VALUES " + ", ".join(f"('{c}')" for c in _SMOKE) + ") v(check_name)")
def model_smoke(t):
    """Every model run over all evaluation items, with what must hold of its output whatever the model."""
    e = t("eval_items").select("item_id", "text", F.lower("text").alias("other"))
    known = M.hashed_embedder
    rows = e.select(M.embedding_column(F.col("text"), M.verified(known, DIMENSIONS)).alias("v"), M.pair_column(F.col("text"), F.col("other")).alias("p"), M.relevance_column(F.col("other"), F.col("text")).alias("r"), M.choice_likelihood(F.col("text"), F.col("other"), M.shared_word_scores).alias("c"))
    made = M.generate(e.select("item_id", M.chat_prompt_column(F.col("text"), F.lit("Be brief.")).alias("prompt")), "item_id", "prompt", lambda: M.first_words(12))
    sure = F.col("p.entailment_probability") + F.col("p.contradiction_probability")
    held = {
        "choice_likelihood_negative": F.bool_and(F.col("c.total") < 0), "embedding_dimension": F.bool_and(F.size("v") == DIMENSIONS), "embedding_finite": F.bool_and(F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) <= 1.0001))),
        "pair_probabilities_sum_to_one": F.bool_and(F.abs(sure - 1) < 1e-9), "relevance_between_0_and_1": F.bool_and((F.col("r") > 0) & (F.col("r") < 1)),
    }
    one = rows.agg(F.array(*[F.struct(F.lit(n).alias("check_name"), c.alias("passed")) for n, c in held.items()]).alias("m")).select(F.inline("m"))
    return one.unionByName(made.agg(F.lit("generation_not_empty").alias("check_name"), F.bool_and((F.col("generated_tokens") > 0) & F.col("error").isNull()).alias("passed")))
