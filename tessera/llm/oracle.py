"""The same results in plain DuckDB SQL, by other means than the operators.

There is none for truncation: SQL for it could only repeat the operator's rules with its constants. Its tests plant cuts instead.
"""

from __future__ import annotations

PAIRS = """
    SELECT DISTINCT trim(user_id, ' ') AS u, trim(business_id, ' ') AS b FROM train_review
    WHERE trim(user_id, ' ') <> '' AND trim(business_id, ' ') <> ''"""

REVIEWS = """
    SELECT review_id, trim(business_id, ' ') AS b, text FROM train_review
    QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY loaded_at) = 1"""

TERMS = f"""
WITH r AS ({REVIEWS}), t AS (SELECT review_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM r),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT review_id) AS records FROM t GROUP BY term),
m AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.2 * (SELECT count(text) FROM r) THEN 'common' END AS mark FROM c)"""

NGRAMS = f"""
WITH r AS ({REVIEWS}), w AS (SELECT review_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM r WHERE text IS NOT NULL),
t AS (SELECT review_id, terms, array_to_string(w[i:i + terms - 1], ' ') AS gram
      FROM (SELECT review_id, w, terms, unnest(range(1, len(w) - terms + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(terms))),
c AS (SELECT gram, terms, count(*) AS occurrences, count(DISTINCT review_id) AS records FROM t GROUP BY ALL)
SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.2 * (SELECT count(text) FROM r) THEN 'common' END AS mark FROM c"""

COUNTS = f"""
WITH r AS ({REVIEWS}), t AS (SELECT b, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM r WHERE b <> ''),
c AS (SELECT b, term, count(*) AS n FROM t WHERE length(term) >= 3
      AND term NOT IN (SELECT lower(trim(word, ' ')) FROM stop_words WHERE word IS NOT NULL) GROUP BY ALL),
d AS (SELECT term, count(*) AS d FROM c GROUP BY term HAVING count(*) >= 3),
k AS (SELECT c.*, d.d, max(n) OVER (PARTITION BY b) AS m, sum(n) OVER (PARTITION BY b) AS len FROM c JOIN d USING (term)),
s AS (SELECT count(DISTINCT b)::DOUBLE AS nn, sum(n)::DOUBLE / count(DISTINCT b) AS mean FROM k)"""

ORACLE = {
    "p1_found": f"""
WITH p AS ({PAIRS}), n AS (SELECT b, count(*) AS n FROM p GROUP BY b HAVING count(*) >= 5),
q AS (SELECT p.u, p.b, n.n FROM p JOIN n USING (b)),
s AS (SELECT x.b AS business_a, y.b AS business_b, x.n AS nx, y.n AS ny, count(*) AS k
      FROM q x JOIN q y ON x.u = y.u AND x.b < y.b GROUP BY ALL)
SELECT business_a, business_b FROM s WHERE 2 * k >= nx + ny - k""",
    "p2_found": """
WITH r AS (SELECT review_id, trim(user_id, ' ') AS user_id, stars FROM train_review
           QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY loaded_at) = 1)
SELECT user_id, review_id FROM r WHERE user_id <> '' AND stars >= 1 AND stars <= 5
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY stars DESC, review_id) <= 3""",
    "p5_found": f"""
WITH p AS ({PAIRS}), n AS (SELECT b, count(*) AS n FROM p GROUP BY b), t AS (SELECT count(DISTINCT u) AS t FROM p),
s AS (SELECT x.b AS business_a, y.b AS business_b, count(*) AS k
      FROM p x JOIN p y ON x.u = y.u AND x.b < y.b GROUP BY ALL HAVING count(*) >= 5)
SELECT business_a, business_b FROM s JOIN n na ON na.b = business_a JOIN n nb ON nb.b = business_b, t
WHERE k * t >= 12 * na.n * nb.n""",
    "p3_found": f"{TERMS} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p3_terms": f"{TERMS} SELECT term, occurrences, records, mark FROM m",
    "p3_ngrams": NGRAMS,
    "p4_relevance": f"""{COUNTS}, w AS (SELECT b, term, n, round(ln(1 + (nn - d + 0.5) / (d + 0.5)) * (n * (1.2::DOUBLE + 1) / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len / mean)))), 9) AS score FROM k, s),
o AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, term) AS position FROM w WHERE score > 0)
SELECT b AS business_id, term, n, score, position FROM o WHERE position <= 5""",
    "p4_found": f"""{COUNTS}, w AS (SELECT b, term, round(n / m * log2(nn / d), 9) AS score FROM k, s)
SELECT b AS business_id, term FROM w WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY b ORDER BY score DESC, term) <= 5""",
}
