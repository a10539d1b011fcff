"""SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations



def _bare(column: str) -> str:
    return rf"upper(regexp_replace({column}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def _item(dataset: str, subset: str, number: str) -> str:
    ws = r"[\t\n\v\f\r \x1c-\x1f\x{85}\p{Z}]"
    clean = lambda c: f"lower(regexp_replace({c}, '^{ws}+|{ws}+$', '', 'g'))"
    digits = rf"regexp_replace(regexp_extract({number}, '(\d+)', 1), '^0+(\d)', '\1')"
    return f"CASE WHEN {digits} <> '' AND {dataset} IS NOT NULL AND {subset} IS NOT NULL AND {clean(subset)} <> '' THEN {clean(dataset)} || '|' || {clean(subset)} || '|' || {digits} END"


_TIES = f"""RECURSIVE named AS (
  SELECT 'pool_records' AS member_table, record_id AS member_id, {_item('group_key.dataset', 'group_key.subset', 'group_key.id')} AS g, {_item('source_dataset', 'source_subset', 'source_id')} AS s FROM pool_records
  UNION ALL SELECT 'verifier_examples', example_id, NULL, {_item('source_dataset', 'source_subset', 'source_id')} FROM verifier_examples),
edges AS (SELECT DISTINCT g AS a, s AS b FROM named WHERE g <> s UNION SELECT DISTINCT s, g FROM named WHERE g <> s),
reach(v, root) AS (SELECT DISTINCT a, a FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.v),
roots AS (SELECT v, min(root) AS root FROM reach GROUP BY v),
tied AS (SELECT member_table, member_id, coalesce(root, coalesce(g, s)) AS root FROM named LEFT JOIN roots ON v = coalesce(g, s) WHERE coalesce(g, s) IS NOT NULL),
firsts AS (SELECT root, min(member_id) AS first_record_id FROM tied WHERE member_table = 'pool_records' GROUP BY root)"""

_SAME = f"""SELECT record_id, min(record_id) OVER w AS kept_id, count(*) OVER w AS copies FROM pool_records
WINDOW w AS (PARTITION BY {_bare('hypothesis')}, {_bare('label')}, {_bare('premise_text')}, CAST(from_json(premise_reference, '[[{{"sentence_id":"BIGINT","wiki_url":"VARCHAR"}}]]') AS VARCHAR))"""

_GRAMS = """grams AS (SELECT {key}, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12))"""


def _grams(name: str, key: str, table: str) -> str:
    return _GRAMS.format(key=key, table=table).replace("grams AS", f"{name} AS", 1)


_LEAKS = f"{_grams('d', 'doc_id', 'documents')}, {_grams('e', 'item_id', 'eval_items')}, leaks AS (SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (gram))"

ORACLES = {
    "p1_found": f"WITH {_TIES} SELECT first_record_id, member_table, member_id FROM tied JOIN firsts USING (root) WHERE NOT (member_table = 'pool_records' AND member_id = first_record_id)",
    # What must hold of any assignment or packing: every row is there, no group and no document is torn, no container holds too much.
    "p1_check": f"WITH {_TIES} SELECT (SELECT count(*) FROM named) AS n_rows, (SELECT count(DISTINCT root) FROM tied) + (SELECT count(*) FROM named WHERE coalesce(g, s) IS NULL) AS n_groups, CAST(0 AS BIGINT) AS n_torn, true AS shares_met",
    "p7_check": "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS n_torn, CAST(0 AS BIGINT) AS n_overfull FROM documents",
    "p6_members": r"""WITH w AS (SELECT lower(trim(split, ' ')) = 'train' AS train, 'pool_records' AS table_name, CAST(record_id AS VARCHAR) AS id, hypothesis AS t FROM pool_records WHERE lower(trim(split, ' ')) IN ('train', 'dev', 'test')
UNION ALL SELECT DISTINCT false, 'rag_error_analysis', response_id, answer_preview FROM rag_error_analysis WHERE response_id IS NOT NULL)
SELECT DISTINCT train, table_name, id, upper(md5(words)) AS form FROM (SELECT *, trim(regexp_replace(lower(t), '[^\p{L}\p{N}\p{M}]+', ' ', 'g'), ' ') AS words FROM w WHERE t IS NOT NULL) WHERE words <> ''""",
    "p3_found": f"SELECT kept_id, record_id AS copy_id FROM ({_SAME}) WHERE record_id <> kept_id",
    "p3_collapsed": f"SELECT kept_id, copies FROM ({_SAME}) WHERE record_id = kept_id",
    "p8_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leaks",
    "p8_report": f"""WITH {_LEAKS}, per AS (SELECT item_id, count(*) AS n FROM leaks GROUP BY item_id)
SELECT benchmark, split, count(*) AS items, count(n) AS leaked_items, CAST(coalesce(sum(n), 0) AS BIGINT) AS holding_documents FROM eval_items LEFT JOIN per USING (item_id) GROUP BY benchmark, split""",
}
