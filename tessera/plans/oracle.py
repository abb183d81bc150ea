"""The same results in plain DuckDB SQL over the same tables."""

from __future__ import annotations

from tessera.operators.similarity import PRIME, hash_constants
from tessera.operators.split_values import BLANKS, DELIMITERS
from tessera.operators.sketch import BITS, BLOOM_HASHES, COUNT_HASHES
from tessera.plans import queries as q

R = """r AS (SELECT review_id, nullif(trim(user_id, ' '), '') AS user_id, nullif(trim(business_id, ' '), '') AS business_id,
          CASE WHEN stars >= 1 AND stars <= 5 THEN stars END AS stars, review_date, text
     FROM train_review QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY loaded_at) = 1)"""
B = """b AS (SELECT business_id, categories, state, city FROM business QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY updated_at) = 1)"""
P = f"""{R}, p AS (SELECT DISTINCT user_id AS u, business_id AS b FROM r WHERE user_id IS NOT NULL AND business_id IS NOT NULL)"""
STOP = "SELECT lower(trim(word, ' ')) FROM stop_words WHERE word IS NOT NULL"
CATEGORIES = """c AS (SELECT business_id, trim(unnest(string_split(categories, ',')), ' ') AS category FROM b WHERE categories IS NOT NULL)"""
BYTES = "list_transform(range(1, (length(hex(encode({0}))) // 2) + 1), lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::BIGINT)"


def _hashed(city: str, a: str, b: str, c: str) -> str:
    s = f"list_reduce(list_prepend(0::BIGINT, {BYTES.format(city)}), lambda x, y: (x * 256 + y) % {c})"
    return f"((({s} * {a} + {b}) % {c} + {c}) % {c})"


def _minhash(n: int) -> str:
    x = "('0x' || substr(md5(u), 1, 8))::BIGINT"
    return ", ".join(f"min(({x} * {a} + {b}) % {PRIME}) AS h{i}" for i, (a, b) in enumerate(hash_constants(n)))


def _banded(key: str, bands: int) -> str:
    """c: the pairs of keys (k1 < k2) that agree in a band of two hashes, each hash over the values of the other column."""
    other = "u" if key == "b" else "b"
    values = ", ".join(f"[h{2 * i}, h{2 * i + 1}]" for i in range(bands))
    return f"""g AS (SELECT {key} AS k, {_minhash(2 * bands).replace("md5(u)", f"md5({other})")} FROM p GROUP BY {key}),
h AS (SELECT k, unnest(range({bands})) AS i, unnest([{values}]) AS v FROM g),
c AS (SELECT DISTINCT x.k AS k1, y.k AS k2 FROM h x JOIN h y ON x.i = y.i AND x.v = y.v AND x.k < y.k)"""


def _all_sets(support: int) -> str:
    return f"""{P}, one AS (SELECT u, b FROM p QUALIFY count(*) OVER (PARTITION BY b) >= {support}),
f AS (SELECT [b] AS items, u FROM one
  UNION ALL SELECT list_append(items, b), f.u FROM f JOIN one ON one.u = f.u AND one.b > items[-1] QUALIFY count(*) OVER (PARTITION BY list_append(items, b)) >= {support}),
sets AS (SELECT items, count(*) AS support FROM f GROUP BY items)"""


def _pair_sets(rows: str, support: int) -> str:
    return f"""WITH {P}, m AS ({rows}) SELECT x.i || ',' || y.i AS items, count(*) AS support
FROM m x JOIN m y ON x.k = y.k AND x.i < y.i GROUP BY x.i, y.i HAVING count(*) >= {support}"""


WORDS = f"""{R}, w AS (SELECT business_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM r WHERE business_id IS NOT NULL),
t AS (SELECT business_id, word, count(*) AS n FROM w WHERE word NOT IN ({STOP}) GROUP BY ALL),
k AS (SELECT t.* FROM t WHERE word IN (SELECT word FROM t GROUP BY word HAVING sum(n) > 30)),
d AS (SELECT word, count(*) AS df FROM k GROUP BY word)"""
PROFILES = f"""{WORDS}, bp AS (
  SELECT business_id, word, round(n / max(n) OVER (PARTITION BY business_id) * log2((SELECT count(DISTINCT business_id) FROM k) / df), 9) AS weight
  FROM k JOIN d USING (word)),
best AS (SELECT * FROM bp QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY weight DESC, word) <= 200)"""
USERS = f"""{PROFILES}, up AS (SELECT DISTINCT user_id, word FROM (SELECT user_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM r WHERE user_id IS NOT NULL)
  WHERE word IN (SELECT word FROM best))"""
TESTS = """v AS (SELECT DISTINCT trim(user_id, ' ') AS user_id, trim(business_id, ' ') AS business_id FROM test_review WHERE trim(user_id, ' ') <> '' AND trim(business_id, ' ') <> '')"""
RATINGS = f"{R}, t AS (SELECT user_id AS u, business_id AS b, stars AS s FROM r WHERE user_id IS NOT NULL AND business_id IS NOT NULL AND stars IS NOT NULL)"


def _pearson(key: str, other: str) -> str:
    return f"""m AS (SELECT x.{key} AS ka, y.{key} AS kb, count(*)::DOUBLE AS n, sum(x.s) AS sx, sum(y.s) AS sy, sum(x.s * y.s) AS sxy, sum(x.s * x.s) AS sxx, sum(y.s * y.s) AS syy
  FROM t x JOIN t y ON x.{other} = y.{other} AND x.{key} < y.{key} GROUP BY ALL HAVING count(*) >= 3),
s AS (SELECT ka, kb, round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 9) AS sim FROM m WHERE n * sxx - sx * sx > 1e-9 AND n * syy - sy * sy > 1e-9)"""


ITEMS = f"{RATINGS}, {_pearson('b', 'u')}, im AS (SELECT kb AS b1, ka AS b2, sim FROM s WHERE sim > 0)"
NEAR_USERS = f"""{RATINGS}, {_pearson('u', 'b')}, ub AS (SELECT DISTINCT u, b FROM t), un AS (SELECT u, count(*) AS n FROM ub GROUP BY u),
j AS (SELECT x.u AS ka, y.u AS kb, count(*) AS k FROM ub x JOIN ub y ON x.b = y.b AND x.u < y.u GROUP BY ALL HAVING count(*) >= 3),
um AS (SELECT ka AS u1, kb AS u2, sim FROM s JOIN j USING (ka, kb) JOIN un na ON na.u = ka JOIN un nb ON nb.u = kb WHERE sim > 0 AND k / (na.n + nb.n - k) >= 0.01)"""
CELLS = """cells AS (SELECT u, b, avg(s) AS s FROM t GROUP BY u, b), means AS (SELECT u, avg(s) AS m, count(*) AS n FROM cells GROUP BY u)"""
EDGES = f"""{P}, e AS (SELECT x.u AS src, y.u AS dst, count(*) AS common FROM p x JOIN p y ON x.b = y.b AND x.u < y.u GROUP BY ALL HAVING count(*) >= {q.THRESHOLD}),
l AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"""
COMPONENTS = f"""{EDGES}, reach AS (SELECT src AS node, src AS got FROM l UNION SELECT l.dst, reach.got FROM reach JOIN l ON l.src = reach.node),
comp AS (SELECT node, min(got) AS component FROM reach GROUP BY node)"""


def _labels(rounds: int) -> str:
    out = f"WITH {EDGES}, l0 AS (SELECT DISTINCT src AS node, src AS label FROM l)"
    for i in range(rounds):
        out += f""", l{i + 1} AS (SELECT src AS node, label FROM (SELECT src, label, count(*) AS n FROM l JOIN l{i} ON l.dst = l{i}.node GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, label) = 1)"""
    return out + f" SELECT node, label FROM l{rounds}"


COUNTERS = "h(i, a, b, c) AS (VALUES " + ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT, {c}::BIGINT)" for i, (a, b, c) in enumerate(COUNT_HASHES)) + ")"


def _fm(events: str, key: str) -> str:
    bits = "bin(v)"
    return f"""WITH {COUNTERS}, ev AS ({events}), cities AS (SELECT DISTINCT city FROM ev),
z AS (SELECT city, i, {_hashed('city', 'a', 'b', 'c')} AS v FROM cities, h),
t AS (SELECT city, i, length({bits}) - length(rtrim({bits}, '0')) AS zeros FROM z),
m AS (SELECT {key}, i, pow(2, max(zeros)) AS e FROM ev JOIN t USING (city) GROUP BY ALL),
o AS (SELECT {key}, e, row_number() OVER (PARTITION BY {key} ORDER BY e) AS place FROM m),
est AS (SELECT {key}, round(sum(e) / 14, 6) AS estimate FROM o WHERE place BETWEEN 25 AND 38 GROUP BY {key}),
n AS (SELECT {key}, count(DISTINCT city) AS distinct_ FROM ev GROUP BY {key})
SELECT {key}, distinct_ AS "distinct", estimate FROM n JOIN est USING ({key})"""


_BLANK, _DELIMITER = "".join(BLANKS), "".join(DELIMITERS)
_GAP = f"[{_BLANK}]*"
_QUOTED = rf'''{_GAP}"(?:[^"\\]|""|\\.)*"|{_GAP}“[^”]*”|[^{_DELIMITER}]+'''
_LISTED = rf"""{_GAP}''(?:[^''\\]|\\.)*''|{_QUOTED}"""
CATEGORY_NAMES = f"""WITH {B}, t AS (SELECT business_id, trim(categories, '{_BLANK}') AS c FROM b WHERE categories IS NOT NULL),
l AS (SELECT *, length(c) > 1 AND left(c, 1) = '[' AND right(c, 1) = ']' AS listed FROM t),
e AS (SELECT business_id, CASE WHEN listed THEN regexp_extract_all(substr(c, 2, length(c) - 2), '{_LISTED}') ELSE regexp_extract_all(c, '{_QUOTED}') END AS e, listed FROM l),
n AS (SELECT business_id, list_filter(list_transform(list_transform(e, lambda x: trim(x, '{_BLANK}')), lambda x: CASE
  WHEN length(x) > 1 AND left(x, 1) = '"' AND right(x, 1) = '"' THEN trim(replace(replace(substr(x, 2, length(x) - 2), '""', '"'), '\\"', '"'), '{_BLANK}')
  WHEN length(x) > 1 AND (left(x, 1) = '“' AND right(x, 1) = '”' OR listed AND left(x, 1) = chr(39) AND right(x, 1) = chr(39)) THEN trim(substr(x, 2, length(x) - 2), '{_BLANK}')
  ELSE x END), lambda x: x <> '') AS names FROM e)"""
VECTORS = f"""v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f, label FROM embeddings), c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, f AS c FROM (SELECT * FROM v ORDER BY id LIMIT {q.CLUSTERS})),
a AS (SELECT id, f, label, cluster FROM v, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(f, c), cluster) = 1),
s AS (SELECT cluster, dim - 1 AS dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM (SELECT cluster, unnest(f) AS x, generate_subscripts(f, 1) AS dim FROM a) GROUP BY ALL)"""
POSTS = """t AS (SELECT post_id, hashtags FROM tag_stream WHERE post_id IS NOT NULL AND len(hashtags) > 0 QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY arrived_at, chunk_no) = 1)"""

def _round(i: int) -> str:
    """a1, a2, ...: the assignment to the means of the assignment before."""
    before = f"a{i}" if i else "a"
    return f""", m{i + 1} AS (SELECT cluster, list(mean ORDER BY dim) AS c FROM (SELECT cluster, dim, avg(x) AS mean FROM (SELECT cluster, unnest(f) AS x, generate_subscripts(f, 1) AS dim FROM {before}) GROUP BY ALL) GROUP BY cluster),
a{i + 1} AS (SELECT id, f, m{i + 1}.cluster FROM v, m{i + 1} QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(f, c), m{i + 1}.cluster) = 1)"""


ORACLE = {
    "p6_found": f"{CATEGORY_NAMES} SELECT business_id, generate_subscripts(names, 1)::INT AS pos, unnest(names) AS category FROM n",
    "explore_counts": f"WITH {R} SELECT count(*) AS reviews, count(*) FILTER (substr(review_date, 1, 4) = '{q.YEAR}') AS in_year, count(DISTINCT user_id) AS users FROM r",
    "top_users": f"WITH {R} SELECT user_id, count(*) AS reviews FROM r WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY reviews DESC, user_id LIMIT {q.TOP}",
    "top_words": f"""WITH {R}, w AS (SELECT trim(unnest(string_split_regex(lower(text), '[ \\(\\[,\\n.!?:;\\]\\)]+')), ' ') AS word FROM r)
SELECT word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN ({STOP}) GROUP BY word ORDER BY n DESC, word LIMIT {q.TOP}""",
    "category_avg_stars": f"""WITH {R}, {B}, {CATEGORIES} SELECT category, round(avg(stars), 6) AS stars FROM c JOIN r USING (business_id)
WHERE stars IS NOT NULL GROUP BY category ORDER BY stars DESC, category LIMIT {q.TOP}""",
    "business_over_n": f"WITH {R} SELECT business_id, count(*) AS reviews FROM r WHERE business_id IS NOT NULL GROUP BY business_id HAVING count(*) > {q.OVER}",
    "state_user_business": f"""WITH {R}, {B} SELECT user_id, business_id FROM r WHERE user_id IS NOT NULL
AND business_id IN (SELECT business_id FROM b WHERE upper(trim(state, ' ')) = '{q.STATE}')""",
    "frequent_items_k1": f"WITH {P} SELECT b AS items, count(*) AS support FROM p GROUP BY b HAVING count(*) >= {q.SUPPORT}",
    "frequent_items_k2": _pair_sets("SELECT u AS k, b AS i FROM p", q.SUPPORT),
    "frequent_items_k3": f"""WITH {P}, f AS (SELECT x.b AS a, y.b AS b FROM p x JOIN p y ON x.u = y.u AND x.b < y.b GROUP BY ALL HAVING count(*) >= 3),
g AS (SELECT x.a, x.b, y.b AS c FROM f x JOIN f y ON x.a = y.a AND x.b < y.b JOIN f z ON z.a = x.b AND z.b = y.b)
SELECT g.a || ',' || g.b || ',' || g.c AS items, count(*) AS support FROM g JOIN p x ON x.b = g.a JOIN p y ON y.b = g.b AND y.u = x.u JOIN p z ON z.b = g.c AND z.u = x.u
GROUP BY g.a, g.b, g.c HAVING count(*) >= 3""",
    "frequent_items_all": f"WITH RECURSIVE {_all_sets(q.SUPPORT)} SELECT len(items)::INT AS size, count(*) AS sets, max(support) AS most FROM sets GROUP BY len(items)",
    "son_itemsets": f"WITH RECURSIVE {_all_sets(q.SUPPORT)} SELECT array_to_string(items, ',') AS items, support FROM sets",
    "itemset_lines": f"""WITH RECURSIVE {_all_sets(q.SUPPORT)} SELECT len(items)::INT AS size,
  string_agg('(' || chr(39) || array_to_string(items, chr(39) || ', ' || chr(39)) || chr(39) || ')', ',' ORDER BY items) AS line FROM sets WHERE len(items) IN (2, 3) GROUP BY len(items)""",
    "frequent_items_swapped": _pair_sets("SELECT b AS k, u AS i FROM p", q.SUPPORT),
    "frequent_items_min_basket": _pair_sets(f"SELECT u AS k, b AS i FROM p WHERE u IN (SELECT u FROM p GROUP BY u HAVING count(*) > {q.MIN_BASKET})", q.SUPPORT),
    "jaccard_pairs": f"""WITH {P}, n AS (SELECT b, count(*) AS n FROM p GROUP BY b),
s AS (SELECT x.b AS b1, y.b AS b2, count(*) AS k FROM p x JOIN p y ON x.u = y.u AND x.b < y.b GROUP BY ALL)
SELECT b1, b2, round(k / (na.n + nb.n - k), 9) AS sim FROM s JOIN n na ON na.b = b1 JOIN n nb ON nb.b = b2 WHERE k / (na.n + nb.n - k) >= {q.JACCARD}""",
    "minhash_signatures": f"WITH {P} SELECT b AS business_id, {_minhash(4)} FROM p GROUP BY b",
    "lsh_candidates": f"""WITH {P}, g AS (SELECT b, {_minhash(4)} FROM p GROUP BY b)
SELECT x.b AS key_a, y.b AS key_b FROM g x JOIN g y ON x.b < y.b AND ((x.h0 = y.h0 AND x.h1 = y.h1) OR (x.h2 = y.h2 AND x.h3 = y.h3))""",
    "lsh_pairs": f"""WITH {P}, n AS (SELECT b, count(*) AS n FROM p GROUP BY b), {_banded("b", q.BANDS)},
s AS (SELECT k1 AS b1, k2 AS b2, count(*) AS k FROM c JOIN p x ON x.b = k1 JOIN p y ON y.b = k2 AND y.u = x.u GROUP BY ALL)
SELECT b1, b2, round(k / (na.n + nb.n - k), 9) AS sim FROM s JOIN n na ON na.b = b1 JOIN n nb ON nb.b = b2 WHERE k / (na.n + nb.n - k) >= {q.LSH_JACCARD}""",
    "jaccard_pairs_w3": f"""WITH {P}, n AS (SELECT b, count(*) AS n FROM p GROUP BY b),
s AS (SELECT x.b AS b1, y.b AS b2, count(*) AS k FROM p x JOIN p y ON x.u = y.u AND x.b < y.b GROUP BY ALL)
SELECT b1, b2, round(k / (na.n + nb.n - k), 9) AS sim FROM s JOIN n na ON na.b = b1 JOIN n nb ON nb.b = b2 WHERE k / (na.n + nb.n - k) >= {q.W3_JACCARD}""",
    "lsh_pairs_w3": f"""WITH {P}, n AS (SELECT b, count(*) AS n FROM p GROUP BY b), g AS (SELECT b, {_minhash(q.W3_HASHES)} FROM p GROUP BY b),
h AS (SELECT b, unnest(range({q.W3_HASHES})) AS i, unnest([{', '.join(f'h{i}' for i in range(q.W3_HASHES))}]) AS v FROM g),
c AS (SELECT DISTINCT x.b AS b1, y.b AS b2 FROM h x JOIN h y ON x.i = y.i AND x.v = y.v AND x.b < y.b),
s AS (SELECT b1, b2, count(*) AS k FROM c JOIN p x ON x.b = b1 JOIN p y ON y.b = b2 AND y.u = x.u GROUP BY ALL)
SELECT b1, b2, round(k / (na.n + nb.n - k), 9) AS sim FROM s JOIN n na ON na.b = b1 JOIN n nb ON nb.b = b2 WHERE k / (na.n + nb.n - k) >= {q.W3_JACCARD}""",
    "doc_freq": f"WITH {WORDS} SELECT word, df FROM d",
    "tfidf_topk": f"WITH {PROFILES} SELECT business_id, word, weight FROM best",
    "binary_user_profile": f"WITH {USERS} SELECT user_id, word FROM up",
    "user_term_weights": f"""WITH {PROFILES}, uw AS (SELECT user_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM r WHERE user_id IS NOT NULL),
m AS (SELECT user_id, word, count(*) AS n FROM uw WHERE word IN (SELECT word FROM best) GROUP BY ALL)
SELECT user_id, word, round(n / sum(n) OVER (PARTITION BY user_id), 9) AS weight FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, word) <= 300""",
    "cosine_score": f"""WITH {USERS}, {TESTS}, c AS (SELECT v.user_id, v.business_id, count(*) AS common FROM v JOIN best USING (business_id) JOIN up ON up.user_id = v.user_id AND up.word = best.word GROUP BY ALL),
n AS (SELECT user_id, count(*) AS used FROM up GROUP BY user_id), s AS (SELECT user_id, business_id, round(common / sqrt(200) / sqrt(used), 6) AS score FROM c JOIN n USING (user_id))
SELECT * FROM s WHERE score >= 0.01""",
    "item_pearson": f"WITH {ITEMS} SELECT b1, b2, sim FROM im",
    "user_pearson": f"WITH {NEAR_USERS} SELECT u1, u2, sim FROM um",
    "user_pearson_lsh": f"""WITH {NEAR_USERS}, p AS (SELECT DISTINCT user_id AS u, business_id AS b FROM r WHERE user_id IS NOT NULL AND business_id IS NOT NULL),
{_banded("u", q.USER_HASHES // 2)} SELECT u1, u2, sim FROM um JOIN c ON k1 = u1 AND k2 = u2""",
    "predict_item": f"""WITH {ITEMS}, {CELLS}, {TESTS}, w AS (SELECT b1 AS b, b2 AS o, sim FROM im UNION ALL SELECT b2, b1, sim FROM im),
near AS (SELECT v.user_id AS u, v.business_id AS b, sim, s FROM v JOIN w ON w.b = v.business_id JOIN cells c ON c.u = v.user_id AND c.b = w.o
  QUALIFY row_number() OVER (PARTITION BY v.user_id, v.business_id ORDER BY sim DESC, w.o) <= 5),
g AS (SELECT u, b, sum(sim * s) / sum(sim) AS p, count(*) AS k FROM near GROUP BY u, b)
SELECT u AS user_id, b AS business_id, round(p * k / n + m * (1 - k / n), 6) AS stars FROM g JOIN means USING (u)""",
    "predict_user": f"""WITH {NEAR_USERS}, {CELLS}, {TESTS}, w AS (SELECT u1 AS u, u2 AS o, sim FROM um UNION ALL SELECT u2, u1, sim FROM um),
near AS (SELECT v.user_id AS u, v.business_id AS b, sim, c.s - means.m AS d FROM v JOIN w ON w.u = v.user_id JOIN cells c ON c.u = w.o AND c.b = v.business_id JOIN means ON means.u = w.o
  QUALIFY row_number() OVER (PARTITION BY v.user_id, v.business_id ORDER BY sim DESC, w.o) <= 5),
g AS (SELECT u, b, sum(sim * d) / sum(sim) AS p FROM near GROUP BY u, b), h AS (SELECT b, count(*) AS k FROM cells GROUP BY b)
SELECT u AS user_id, b AS business_id, round(m + p * least(1.0::DOUBLE, log2((SELECT count(DISTINCT u) FROM cells) / k) / log2(1000)), 6) AS stars FROM g JOIN means USING (u) JOIN h USING (b)""",
    "cooccurrence_edges": f"WITH {EDGES} SELECT src, dst, common FROM e",
    "connected_components": f"WITH RECURSIVE {COMPONENTS} SELECT node, component FROM comp",
    "label_propagation": _labels(5),
    "modularity": f"""WITH RECURSIVE {COMPONENTS}, m AS (SELECT count(*)::DOUBLE AS m FROM e), d AS (SELECT component, count(*) AS d FROM l JOIN comp ON comp.node = l.src GROUP BY component)
SELECT round(sum(d / 2 / m - pow(d / (2 * m), 2)), 6) AS q FROM d, m""",
    "edge_betweenness": f"""WITH RECURSIVE {EDGES},
walk AS (SELECT src AS s, src AS v, [src] AS path FROM l UNION SELECT walk.s, l.dst, list_append(path, l.dst) FROM walk JOIN l ON l.src = walk.v WHERE NOT list_contains(path, l.dst) AND len(path) < 12),
best AS (SELECT s, v, min(len(path)) AS n FROM walk WHERE s < v GROUP BY s, v), short AS (SELECT walk.* FROM walk JOIN best USING (s, v) WHERE len(path) = n),
w AS (SELECT s, v, 1.0::DOUBLE / count(*) AS share FROM short GROUP BY s, v),
step AS (SELECT path[i] AS a, path[i + 1] AS b, share FROM (SELECT path, share, unnest(range(1, len(path))) AS i FROM short JOIN w USING (s, v)))
SELECT least(a, b) AS src, greatest(a, b) AS dst, round(sum(share), 9) AS value FROM step GROUP BY ALL""",
    "bloom_membership": f"""WITH {B}, known AS (SELECT DISTINCT city FROM b WHERE city <> ''),
bits AS ({' UNION '.join(f"SELECT {_hashed('city', a, b, c)} % {BITS} AS bit FROM known" for a, b, c in BLOOM_HASHES)})
SELECT city, seen_at, CASE WHEN city IS NULL THEN 0 WHEN city = '' THEN 1
  WHEN {' AND '.join(f"{_hashed('city', a, b, c)} % {BITS} IN (SELECT bit FROM bits)" for a, b, c in BLOOM_HASHES)} THEN 1 ELSE 0 END AS flag FROM city_stream""",
    "fm_distinct": _fm("SELECT strftime(seen_at, '%Y-%m-%d %H:%M') AS minute, city FROM city_stream WHERE city IS NOT NULL", "minute"),
    "fm_sliding": _fm("""SELECT strftime(time_bucket(INTERVAL 10 SECOND, seen_at) - k * INTERVAL 10 SECOND, '%Y-%m-%d %H:%M:%S') AS start, city
FROM city_stream, (VALUES (0), (1), (2)) s(k) WHERE city IS NOT NULL""", "start"),
    "trending_tags": f"""WITH {POSTS}, g AS (SELECT unnest(hashtags).text AS tag FROM t), n AS (SELECT tag, count(*) AS n FROM g WHERE regexp_full_match(tag, '[A-Za-z]+') GROUP BY tag)
SELECT tag, n FROM n QUALIFY dense_rank() OVER (ORDER BY n DESC) <= 3""",
    "reservoir_sample": f"WITH {POSTS} SELECT post_id FROM t ORDER BY md5('1:' || post_id::VARCHAR), post_id LIMIT 100",
    "kmeans_assign": f"WITH {VECTORS} SELECT id, cluster::INT AS cluster FROM a",
    "cluster_sizes": f"WITH {VECTORS} SELECT cluster::INT AS label, count(*) AS points FROM a GROUP BY cluster",
    "kmeans_step": f"WITH {VECTORS} SELECT cluster::INT AS cluster, dim::INT AS dim, round(s / n, 12) AS centre FROM s",
    "cluster_summaries": f"WITH {VECTORS} SELECT cluster::INT AS cluster, dim::INT AS dim, n, round(s, 6) AS s, round(q, 6) AS q FROM s",
    "kmeans_rounds": f"WITH {VECTORS}{''.join(_round(i) for i in range(3))} SELECT id, cluster::INT AS cluster FROM a3",
    "json_lines_reviews": """SELECT user_id, business_id, count(*) AS reviews, count(*) FILTER (stars <= 5) AS rated, sum(length(text))::BIGINT AS letters
FROM train_review GROUP BY user_id, business_id""",
    "json_lines_businesses": "SELECT business_id, categories, state, city FROM business",
    "csv_pairs": f"WITH {P} SELECT u AS user_id, b AS business_id FROM p",
    "text_stop_words": "SELECT DISTINCT coalesce(string_split_regex(trim(word, ' '), ' +')[1], '') AS word FROM stop_words UNION SELECT ''",
    "text_points": "SELECT vec_id AS id, len(embedding)::INT AS dims, round(list_sum(embedding::DOUBLE[]), 9) AS total FROM embeddings",
    "json_label_map": "SELECT vec_id::VARCHAR AS id, label::INT AS label FROM embeddings",
    "json_item_model": f"WITH {ITEMS} SELECT b1, b2, sim FROM im",
    "mahalanobis_assign": f"""WITH {VECTORS}, g AS (SELECT cluster, list(s / n ORDER BY dim) AS mu, list(greatest(sqrt(greatest(q / n - pow(s / n, 2), 0)), 1e-9) ORDER BY dim) AS sd, count(*) AS dims FROM s GROUP BY cluster),
d AS (SELECT id, cluster, sqrt(list_sum(list_transform(range(1, len(f) + 1), lambda i: pow((f[i] - mu[i]) / sd[i], 2)))) AS d, dims FROM v, g),
o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1)
SELECT id, CASE WHEN d < 2 * sqrt(dims) THEN 'DS' ELSE 'RS' END AS kind, (CASE WHEN d < 2 * sqrt(dims) THEN cluster ELSE -1 END)::INT AS cluster FROM o""",
    "nmi": f"""WITH {VECTORS}, t AS (SELECT count(*)::DOUBLE AS t FROM a), j AS (SELECT cluster, label, count(*) AS n FROM a GROUP BY ALL),
u AS (SELECT cluster, sum(n)::DOUBLE AS n FROM j GROUP BY cluster), w AS (SELECT label, sum(n)::DOUBLE AS n FROM j GROUP BY label)
SELECT round(2 * (SELECT sum(j.n / t * ln(j.n * t / (u.n * w.n))) FROM j JOIN u USING (cluster) JOIN w USING (label), t)
  / ((SELECT sum(-n / t * ln(n / t)) FROM u, t) + (SELECT sum(-n / t * ln(n / t)) FROM w, t)), 6) AS nmi""",
}
ORACLE["category_avg_eager"] = ORACLE["category_avg_stars"]
