"""Texts that lost their end, in pure SQL.

Word trigrams are counted inside sentences and at their ends over the whole corpus. The final
trigram of a text that ends without a sentence mark is joined to these counts: where it is frequent
inside but almost never terminal, the text was cut. The last word of a cut text may itself be cut, so
the trigrams that begin like the final one and go on (``good ser`` in ``good service``) are inside
trigrams of it, too. Two shares come from the same counts:

* whole: of all trigrams that begin like the final one, those that end with its last word;
* terminal: of these, those found at the end of a sentence or text.

A text is cut if whole x terminal is below ``NEVER``. Words of less than ``RARE`` of all words (names,
numbers) count as one class within trigrams, and a trigram that was seen seldom borrows from its
last two words and these from the last one. Lengths at which the texts of a source pile up are field
limits; a text of that length is cut if the product is below a half.

A text whose end leaves no final trigram is judged by its last characters: an open tag, a replacement
character or other half of a character, a comma, or ``[...]`` or ``(more)``. A final ``...`` may be
style or the mark of a break: it is taken off and the text judged without it, as is a closing tag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.session import materialized

RARE = 1e-4  # so at most 10,000 words are frequent, a set that is broadcast
NEVER = 0.01  # share of whole and terminal trigrams below which a final one is almost never terminal
PRIOR = 10  # occurrences that a longer context needs to outweigh a shorter one
UNSEEN = 0.1  # occurrences credited to a final word that is found nowhere else
TAIL = 400  # characters in which the last words are looked for first

# The blanks of Unicode, with the zero-width space and the byte-order mark.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
# Words, and as empty ones (the group takes no part) the marks that end a sentence or line, brackets, quotes and tags.
TOKENS = r"""r"([a-z'’0-9\p{L}\p{M}\p{N}]+|[#:–])|[.!?。…\x22()\[\]\n]+|</?[a-z][^<>]*>", 1"""

# What is judged of a text lies at its end, so no pattern runs over the whole of it. A generator of one row keeps
# the steps apart: expressions that use a step several times would else repeat it.
BODIES = r"""
SELECT doc_id, source, text, t, body
FROM {documents}
LATERAL VIEW explode(array(CASE WHEN instr('<BLANKS>', right(text, 1)) > 0 THEN rtrim('<BLANKS>', text) ELSE text END)) AS trimmed
LATERAL VIEW explode(array(CASE WHEN right(trimmed, 1) = '>' THEN regexp_replace(trimmed, r'(\s*</?[A-Za-z][^<>]*>)+$', '') ELSE trimmed END)) AS t
LATERAL VIEW explode(array(CASE WHEN right(t, 6) = '(more)' THEN rtrim('. ', left(t, char_length(t) - 6))
                                WHEN right(t, 5) = '[...]' THEN rtrim(left(t, char_length(t) - 5))
                                WHEN right(t, 3) = '[…]' THEN rtrim(left(t, char_length(t) - 3))
                                WHEN right(t, 1) = '…' OR right(t, 3) = '...' THEN rtrim('.… ', t) ELSE t END)) AS body
WHERE text IS NOT NULL AND trimmed <> ''""".replace("<BLANKS>", BLANKS)

# The last three words come from the last characters, where these hold enough words and no tag; else from the whole text.
ENDS = r"""
WITH shown AS (
  SELECT doc_id, source, char_length(text) AS n, octet_length(text) AS bytes, body, body <> t AS marked,
         right(t, 6) = '(more)' OR right(t, 5) = '[...]' OR right(t, 3) = '[…]' AS explicit,
         body LIKE '%<%' AND substring_index(body, '<', -1) RLIKE r'^(/?[A-Za-z][^<>]*)?/?$' AS in_tag,
         right(body, 1) IN ('�', '‍') OR (right(body, 1) RLIKE '[🇦-🇿]' AND regexp_extract(body, '[🇦-🇿]+$', 0) RLIKE '^.(..)*$') AS in_char,
         right(body, 1) IN (',', ';', ':', '–', '-') AS in_clause,
         right(body, 1) RLIKE r'[\p{L}\p{N}\p{M}]' AS open_end
  FROM {bodies}),
three AS (
  SELECT shown.*, nullif(get(w, size(w) - 1), '') AS w3, get(w, size(w) - 2) AS p, get(w, size(w) - 3) AS q FROM shown
  LATERAL VIEW explode(array(CASE WHEN open_end THEN regexp_extract_all(lower(right(body, <TAIL>)), <TOKENS>) END)) AS near
  LATERAL VIEW explode(array(CASE WHEN NOT open_end OR char_length(body) <= <TAIL> OR (size(near) > 4 AND instr(right(body, <TAIL>), '>') = 0) THEN near
                                  ELSE regexp_extract_all(lower(body), <TOKENS>) END)) AS w)
SELECT doc_id, source, n, bytes, marked, explicit, in_tag, in_char, in_clause, w3,
       CASE WHEN coalesce(p, '') = '' THEN '^' ELSE p END AS w2, CASE WHEN coalesce(p, '') = '' OR coalesce(q, '') = '' THEN '^' ELSE q END AS w1
FROM three"""

TRIGRAMS = """
WITH tokens AS (SELECT body <> t AS marked, regexp_extract_all(lower(body), <TOKENS>) AS w FROM {bodies}),
each AS (
  SELECT marked, x AS w3, get(w, i - 1) AS p, get(w, i - 2) AS q, get(w, i + 1) AS next
  FROM tokens LATERAL VIEW OUTER posexplode(w) g AS i, x WHERE x <> '')
SELECT CASE WHEN coalesce(p, '') = '' OR coalesce(q, '') = '' THEN '^' ELSE q END AS w1, CASE WHEN coalesce(p, '') = '' THEN '^' ELSE p END AS w2, w3,
       count_if(coalesce(next, '') = '') AS terminal, count_if(next <> '') AS inside
FROM each WHERE NOT (marked AND next IS NULL) GROUP BY 1, 2, 3"""

VOCABULARY = "SELECT w3 AS w, sum(terminal + inside) AS n FROM {trigrams} GROUP BY w3"

FREQUENT = "SELECT w FROM {vocabulary} WHERE n >= {rare} * (SELECT sum(n) FROM {vocabulary}) UNION ALL SELECT '^' AS w"

CLASSED = """
SELECT /*+ BROADCAST(a), BROADCAST(b), BROADCAST(c) */ coalesce(a.w, '<r>') AS k1, coalesce(b.w, '<r>') AS k2, coalesce(c.w, '<r>') AS k3,
       sum(terminal) AS terminal, sum(inside) AS inside
FROM {trigrams} t LEFT JOIN {frequent} a ON a.w = t.w1 LEFT JOIN {frequent} b ON b.w = t.w2 LEFT JOIN {frequent} c ON c.w = t.w3
GROUP BY 1, 2, 3"""

PAIRS = "SELECT k2, k3, sum(terminal) AS terminal, sum(inside) AS inside FROM {classed} GROUP BY k2, k3"

FINAL = """
SELECT /*+ BROADCAST(a), BROADCAST(b), BROADCAST(c) */ e.doc_id, CASE WHEN marked THEN 0 ELSE 1 END AS own, e.w3,
       coalesce(a.w, '<r>') AS k1, coalesce(b.w, '<r>') AS k2, coalesce(c.w, '<r>') AS k3
FROM {ends} e LEFT JOIN {frequent} a ON a.w = e.w1 LEFT JOIN {frequent} b ON b.w = e.w2 LEFT JOIN {frequent} c ON c.w = e.w3 WHERE e.w3 IS NOT NULL"""

# How often each final word, alone or after the words before it, is the beginning of longer words.
LONGER = """
WITH beginnings AS (
  SELECT <KEYS> n, explode(transform(sequence(1, char_length(w) - 1), i -> substring(w, 1, i))) AS w3
  FROM (SELECT * FROM {counts} c <REACHED>) WHERE char_length(w) > 1 AND w NOT IN ('<r>', '^'))
SELECT <KEYS> w3, sum(n) AS longer FROM beginnings LEFT SEMI JOIN {final} USING (<KEYS> w3) GROUP BY <KEYS> w3"""


def _longer(keys: str) -> str:
    reached = f"LEFT SEMI JOIN {{final}} USING ({keys.rstrip(', ')})" if keys else "WHERE n >= 3"
    return LONGER.replace("<REACHED>", reached).replace("<KEYS>", keys)


# Lengths, in characters or bytes, at which a source's texts pile up: 6 times as many as at others near by, and at least 20, in sources of
# under 1000 texts 2 % and at least 5. A row for every length that counts as one at a limit.
LIMITS = """
WITH sizes AS (
  SELECT source, 'n' AS unit, n AS size, count(*) AS k FROM {ends} GROUP BY source, n
  UNION ALL SELECT source, 'bytes', bytes, count(*) FROM {ends} GROUP BY source, bytes),
near AS (
  SELECT *, (sum(k) OVER (PARTITION BY source, unit ORDER BY size RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) - k) / 40.0D AS around,
         sum(k) OVER (PARTITION BY source, unit) AS texts FROM sizes)
SELECT DISTINCT source, unit, explode(sequence(size - CASE WHEN unit = 'n' THEN 1 ELSE 3 END, size)) AS size
FROM near WHERE k >= 5 AND k >= least(20, 0.02D * texts) AND k >= 6 * around"""

VERDICTS = """
WITH one AS (SELECT k3, sum(terminal) AS terminal, sum(inside) AS inside FROM {pairs} GROUP BY k3),
counts AS (
  SELECT f.doc_id, f.k3 <> '<r>' AS known, coalesce(v.n, 0) - f.own AS seen, coalesce(l1.longer, 0) AS l1, coalesce(l2.longer, 0) AS l2, coalesce(l3.longer, 0) AS l3,
         greatest(coalesce(x.terminal, 0) - f.own, 0) AS t3, coalesce(x.inside, 0) AS n3,
         greatest(coalesce(y.terminal, 0) - f.own, 0) AS t2, coalesce(y.inside, 0) AS n2,
         greatest(coalesce(z.terminal, 0) - f.own, 0) AS t1, coalesce(z.inside, 0) AS n1
  FROM {final} f LEFT JOIN {vocabulary} v ON v.w = f.w3 LEFT JOIN {longer1} l1 ON l1.w3 = f.w3
    LEFT JOIN {longer2} l2 ON l2.k2 = f.k2 AND l2.w3 = f.w3 LEFT JOIN {longer3} l3 ON l3.k1 = f.k1 AND l3.k2 = f.k2 AND l3.w3 = f.w3
    LEFT JOIN {classed} x ON x.k1 = f.k1 AND x.k2 = f.k2 AND x.k3 = f.k3 LEFT JOIN {pairs} y ON y.k2 = f.k2 AND y.k3 = f.k3 LEFT JOIN one z ON z.k3 = f.k3),
p1 AS (SELECT *, (seen + {unseen}) / (seen + {unseen} + l1) AS whole1, CAST(t1 AS DOUBLE) / (t1 + n1 + 1) AS terminal1,
              CASE WHEN known THEN t2 + n2 ELSE 0 END AS s2, CASE WHEN known THEN t3 + n3 ELSE 0 END AS s3 FROM counts),
p2 AS (SELECT *, (s2 + {prior} * whole1) / (s2 + l2 + {prior}) AS whole2, (t2 + {prior} * terminal1) / (t2 + n2 + {prior}) AS terminal2 FROM p1),
p3 AS (SELECT doc_id, (s3 + {prior} * whole2) / (s3 + l3 + {prior}) * (t3 + {prior} * terminal2) / (t3 + n3 + {prior}) AS share FROM p2)
SELECT doc_id, source, CASE WHEN explicit THEN 'mark' WHEN in_tag THEN 'tag' WHEN in_char THEN 'character' WHEN in_clause THEN 'clause'
                            WHEN share < {never} THEN 'trigram' WHEN at_limit AND share < 0.5D THEN 'limit' END AS reason
FROM (SELECT /*+ BROADCAST(l), BROADCAST(b) */ e.*, l.size IS NOT NULL OR b.size IS NOT NULL AS at_limit
      FROM {ends} e LEFT JOIN {limits} l ON l.source = e.source AND l.unit = 'n' AND l.size = e.n
                    LEFT JOIN {limits} b ON b.source = e.source AND b.unit = 'bytes' AND b.size = e.bytes)
LEFT JOIN p3 USING (doc_id)"""


def _filled(statement: str) -> str:
    """With the pattern of tokens and the length of tails."""
    return statement.replace("<TOKENS>", TOKENS).replace("<TAIL>", str(TAIL))


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut, reason) of every document with a text that isn't blank.

    ``reason`` is null for texts that aren't cut, and else ``trigram``, ``limit`` (the trigram rule
    at a field limit), or one of ``mark``, ``tag``, ``character`` and ``clause`` for ends without a
    final trigram. Needs the columns doc_id (unique), source and text; others are ignored. Null, empty
    and blank texts have no row; an empty table gives no rows. Statistics are those of all texts, whole.
    """
    spark = documents.sparkSession
    number = {"rare": f"{RARE}D", "never": f"{NEVER}D", "prior": f"{PRIOR}D", "unseen": f"{UNSEEN}D"}

    def sql(statement: str, **tables: DataFrame) -> DataFrame:
        statement = _filled(statement)
        used = {k: v for k, v in tables.items() if "{" + k + "}" in statement}
        for k, v in number.items():
            statement = statement.replace("{" + k + "}", v)
        for k in used:
            statement = statement.replace("{" + k + "}", f"<<{k}>>")
        statement = statement.replace("{", "{{").replace("}", "}}")  # braces of patterns
        for k in used:
            statement = statement.replace(f"<<{k}>>", "{" + k + "}")
        return spark.sql(statement, **used)

    bodies = sql(BODIES, documents=documents.select("doc_id", "source", "text"))
    trigrams = materialized(sql(TRIGRAMS, bodies=bodies), "trigrams")
    ends = materialized(sql(ENDS, bodies=bodies), "ends")
    vocabulary = materialized(sql(VOCABULARY, trigrams=trigrams), "vocabulary")
    frequent = sql(FREQUENT, vocabulary=vocabulary)
    classed = materialized(sql(CLASSED, trigrams=trigrams, frequent=frequent), "classed")
    pairs = materialized(sql(PAIRS, classed=classed), "pairs")
    final = materialized(sql(FINAL, ends=ends, frequent=frequent), "final")
    counted = {"": vocabulary, "k2, ": pairs.selectExpr("k2", "k3 AS w", "terminal + inside AS n"), "k1, k2, ": classed.selectExpr("k1", "k2", "k3 AS w", "terminal + inside AS n")}
    longer = {f"longer{i}": sql(_longer(keys), counts=counts, final=final) for i, (keys, counts) in enumerate(counted.items(), 1)}
    found = sql(VERDICTS, ends=ends, final=final, vocabulary=vocabulary, classed=classed, pairs=pairs, limits=sql(LIMITS, ends=ends), **longer)
    return found.selectExpr("doc_id", "source", "reason IS NOT NULL AS cut", "reason")


def truncated(documents: DataFrame) -> DataFrame:
    """doc_id of every document whose text lost its end."""
    return judged(documents).filter("cut").select("doc_id")


def truncation_by_source(documents: DataFrame) -> DataFrame:
    """(source, texts, cut, share): how many texts that aren't blank each source has, and how many of them are cut."""
    return judged(documents).selectExpr("source", "CAST(cut AS INT) AS cut").groupBy("source").agg({"*": "count", "cut": "sum"}).selectExpr("source", "`count(1)` AS texts", "`sum(cut)` AS cut", "round(`sum(cut)` / `count(1)`, 6) AS share")
