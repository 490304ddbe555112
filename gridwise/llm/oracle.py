"""SQL for the queries that SQL can express."""

from __future__ import annotations

from gridwise.llm import licenses


def _license_sql() -> str:
    known = "MAP {" + ", ".join(f"'{words}': '{id}'" for id, words in licenses.SENTENCES.items()) + "}"
    normal = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    steps, at = [], "s0"
    for i, (licence, wanted) in enumerate(licenses.RULES):
        run = "".join(f",{x}," for x in wanted)
        to = f"s{i + 1}"
        steps.append(
            f"{to} AS (SELECT doc_id, sentence_ids, replace(l, '{run}', ',,') AS l,"
            f" CASE WHEN contains(l, '{run}') THEN list_append(names, '{licence}') ELSE names END AS names FROM {at})"
        )
        at = to
    return f"""
    WITH pieces AS (
      SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'),
             '\\n[ \\t\\r#*/]*\\n', chr(1), 'g'), chr(1)) AS p FROM documents),
    ids AS (
      SELECT doc_id, array_to_string([y FOR y IN [coalesce(
        ({known})[{normal.format('x')}], ({known})[{normal.format("regexp_extract(x, '([^\\n]*)\\n?$', 1)")}]) FOR x IN p]
        IF y IS NOT NULL], ',') AS sentence_ids FROM pieces),
    s0 AS (SELECT doc_id, sentence_ids, ',' || replace(sentence_ids, ',', ',,') || ',' AS l, CAST([] AS VARCHAR[]) AS names FROM ids),
    {", ".join(steps)}
    SELECT doc_id, sentence_ids,
           CASE WHEN sentence_ids = '' THEN '' ELSE array_to_string(list_sort(list_distinct(names)), ',') END AS licenses,
           CASE WHEN sentence_ids = '' THEN '' ELSE regexp_replace(regexp_replace(l, ',+', ',', 'g'), '^,|,$', '', 'g') END AS left_over
    FROM {at}"""


SQL: dict[str, str] = {
    "op2_exact_top_k": """
    WITH v AS MATERIALIZED (
      SELECT row_number() OVER () AS r, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
    s AS (
      SELECT q.r AS query, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.r <> c.r)
    SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                          vec_id, score FROM s) WHERE rank <= 5""",
    "op6_licenses": _license_sql(),
    "op12_hard_negatives": """
    WITH v AS MATERIALIZED (
      SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v,
             CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
    s AS MATERIALIZED (
      SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same,
             CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v AS a JOIN v AS c ON a.vec_id % 50 = 0 AND a.r <> c.r),
    p AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, c) AS n FROM s WHERE same) WHERE n <= 5),
    w AS (
      SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.vec_id, s.c) AS n
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
    SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE n <= 3""",
}
