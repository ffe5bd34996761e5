"""SQL for the results of the operators that compare pairs, exact, for tables small enough to compare all."""

OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT r.x AS vec_id, coalesce(max(n.n), 0) AS n_links, min(r.y) AS component_id, r.x = min(r.y) AS kept FROM r LEFT JOIN n ON r.x = n.x GROUP BY r.x
"""
OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM documents WHERE regexp_matches(text, '[^\x09-\x0D\x20]')),
s AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w),
c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS m FROM c GROUP BY ALL),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS o FROM c a JOIN c b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN t a ON p.x = a.doc_id JOIN t b ON p.y = b.doc_id WHERE o >= 0.8 * (a.m + b.m - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT x AS doc_id, min(y) AS class_id, x = min(y) AS kept FROM r GROUP BY x
"""
