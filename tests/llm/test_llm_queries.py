import numpy as np
import pytest

from tessera.llm import leakage, oracle, queries, tokenizer


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_matches_sql(name, same):
    same(queries.QUERIES[name], oracle.ORACLE[name])


SMALL = "/root/testdata/sf0.001"


def test_sample_of_posts(spark, duck):
    rows = queries.p7_sample(spark, SMALL).collect()
    tagged = duck.execute("SELECT count(DISTINCT post_id) FROM tag_stream WHERE len(hashtags) > 0").fetchone()[0]
    assert len(rows) == len({r["post_id"] for r in rows}) == min(100, tagged) and sorted(r["slot"] for r in rows) == list(range(len(rows)))


def test_leaks_equal_alignment_of_all_pairs(spark, duck):
    """Every document against every item it shares five consecutive words with, which any case does."""
    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in leakage.words(t)], dtype=np.int64)
    fives = lambda c: {tuple(c[i : i + 5]) for i in range(len(c) - 4)}
    items = {i: (c := code(t), fives(c)) for i, t in duck.execute("SELECT item_id, text FROM eval_items WHERE text IS NOT NULL").fetchall()}
    expected = set()
    for d, t in duck.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        c = code(t)
        own = fives(c)
        expected |= {(d, i) for i, (item, five) in items.items() if own & five and leakage.holds(c, item)}
    found = {tuple(r) for r in queries.p9_found(spark, SMALL).select("doc_id", "item_id").collect()}
    assert found == expected and found
    report = {r["item_id"]: r["documents"] for r in queries.p9_items(spark, SMALL).collect()}
    assert report == {i: sum(j == i for _, j in expected) for i in {i for _, i in expected}}


def test_cut_texts_by_source(spark, duck):
    cut = {r["doc_id"] for r in queries.p10_found(spark, SMALL).collect()}
    source = dict(duck.execute("SELECT doc_id, source FROM documents").fetchall())
    report = queries.p10_sources(spark, SMALL).collect()
    assert cut and {r["source"]: r["cut"] for r in report} == {s: sum(source[d] == s for d in cut) for s in set(source.values())}


def test_surprise_of_the_pairs_found(spark, duck):
    rows = queries.p5_surprise(spark, "/root/testdata/sf0.01").collect()
    pairs = {tuple(r) for r in queries.p5_found(spark, "/root/testdata/sf0.01").select("business_a", "business_b").collect()}
    assert {(r["business_a"], r["business_b"]) for r in rows} == pairs and pairs
    assert all(r["k"] > r["expected"] > 0 and r["surprise"] > 0 and 0 <= r["q_value"] <= 1 and r["lift"] >= 12 for r in rows)


def test_ids_of_every_document(spark, duck):
    library = pytest.importorskip("tokenizers")
    known = library.Tokenizer.from_file(tokenizer.DEFAULT_VOCABULARY)
    known.encode_special_tokens = True
    found = {r["doc_id"]: list(r["ids"]) for r in queries.p8_ids(spark, SMALL).collect()}
    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert found == {d: known.encode(t, add_special_tokens=False).ids if t else [] for d, t in texts}


def test_every_query_is_tested():
    by_hand = {"p7_sample", "p9_found", "p9_items", "p10_found", "p10_sources", "p5_surprise", "p8_ids"}
    assert set(queries.QUERIES) - set(oracle.ORACLE) == by_hand
