import random

from tessera.llm import truncation

NOUNS = ["soup", "waiter", "menu", "garden", "bakery", "terrace", "kitchen", "parking"]
PLACES = ["corner", "market", "station", "harbor"]


def sentence(r):
    return f"The {r.choice(NOUNS)} near the {r.choice(PLACES)} was better than the {r.choice(NOUNS)} behind the {r.choice(PLACES)}"


def corpus():
    r = random.Random(1)
    whole = [". ".join(sentence(r) for _ in range(4)) + r.choice([".", "!", "", "...", ". Sent from my phone", '. "Zofi"']) for _ in range(400)]
    return [(i, "a", t) for i, t in enumerate(whole)]


CUT = {
    1000: "The soup near the market was better than the",
    1001: "The soup near the market was better than the kitc",
    1002: "The soup near the market was better than…",
    1003: "The soup near the market was. <im",
    1004: "The soup near the market, was all right�",
    1005: "The soup was better than the menu near the market. [...]",
    1006: "The soup near the market,",
    1007: "The soup near the mar... (more)",
}
WHOLE = {
    2000: "The soup near the market was better than the soup behind the station",
    2001: "The soup near the market was better than the soup behind the station...",
    2002: "<p>The soup near the market was better than the soup behind the station.</p>",
    2003: '{"stars": 3}',
    2004: "The soup near the market was better than the soup behind the station. 👩‍🍳 🇫🇮",
    2005: "x" * 200_000 + ".",
}


def test_cut_and_whole_texts(spark):
    rows = corpus() + [(i, "b", t) for i, t in {**CUT, **WHOLE}.items()] + [(3000, "b", None), (3001, "b", ""), (3002, "b", " \n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, cut int")
    found = sorted(r["doc_id"] for r in truncation.truncated(df).collect())
    assert found == sorted(CUT)
    report = {r["source"]: (r["texts"], r["cut"]) for r in truncation.truncation_by_source(df).collect()}
    assert report == {"a": (400, 0), "b": (len(CUT) + len(WHOLE), len(CUT))}


def test_field_limit(spark):
    r = random.Random(2)
    rows = corpus()
    for i in range(400):
        t = ". ".join(sentence(r) for _ in range(r.randrange(1, 5))) + "."
        rows.append((5000 + i, "limited", t[:160]))
    cut = {i for i, s, t in rows if s == "limited" and len(t) == 160 and not t.endswith(".")}
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {x["doc_id"] for x in truncation.truncated(df).collect()} == cut


def test_field_limit_of_few_texts_of_a_large_source(spark):
    r = random.Random(3)
    rows = corpus()
    for i in range(2400):
        rows.append((5000 + i, "large", (sentence(r) if i % 10 else sentence(r).split(" behind")[0]) + "."))
    for i in range(40):
        t = ". ".join(sentence(r) for _ in range(5)) + ". " + sentence(r).split(" behind")[0]
        rows.append((9000 + i, "large", t[-250:]))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {x["doc_id"] for x in truncation.truncated(df).collect()} == {9000 + i for i in range(40)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert truncation.truncated(df).collect() == [] == truncation.truncation_by_source(df).collect()


def test_reasons(spark):
    rows = corpus() + [(i, "b", t) for i, t in {**CUT, **WHOLE}.items()]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    reasons = {r["doc_id"]: r["reason"] for r in truncation.judged(df).filter("cut").collect()}
    assert reasons == {1000: "trigram", 1001: "trigram", 1002: "trigram", 1003: "tag", 1004: "character", 1005: "mark", 1006: "clause", 1007: "mark"}


def test_planted_cuts(spark, duck):
    """Whole sentences of the documents, half of them cut at a random place within the last sentence."""
    r = random.Random(4)
    texts = [t for (t,) in duck.execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE regexp_matches(text, '[a-z]{3}[.!]$') AND lang = 'en' ORDER BY doc_id").fetchall()]
    rows, cut = [], set()
    for i, t in enumerate(dict.fromkeys(texts)):
        if i % 4 == 0:
            start = max(t.rfind(x, 0, -2) for x in ".!?\n") + 1
            words = t[start:].split()
            if len(words) > 4:
                t = t[: start + len(" ".join(words[:3])) + 2 + r.randrange(len(" ".join(words[3:-1])))]
                if t[-1] not in ".!?":
                    cut.add(i)
        rows.append((i, f"s{i % 3}", t))
    found = {x["doc_id"] for x in truncation.truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert len(cut) > 60
    assert len(found & cut) >= 0.85 * len(cut)  # the others end with a whole clause, or in words of these few texts only
    assert len(found & cut) >= 0.98 * len(found)
