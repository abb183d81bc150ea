import json

from tessera.sources import readers, writers


def test_json_lines_and_text_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"user_id": "u", "business_id": "b", "stars": 4, "date": "2019-01-01", "text": "x"}\nnot json\n')
    assert [r["user_id"] for r in readers.reviews(spark, str(tmp_path / "r.json")).collect()] == ["u", None]
    (tmp_path / "s.txt").write_text("the  x\nand\n")
    assert sorted(r["word"] for r in readers.stop_words(spark, str(tmp_path / "s.txt")).collect()) == ["", "and", "the"]
    (tmp_path / "l.json").write_text('{"a": 1, "b": -1}')
    assert sorted(map(tuple, readers.label_map(spark, str(tmp_path / "l.json")).collect())) == [("a", 1), ("b", -1)]
    (tmp_path / "p.json").write_text('{"b": ["x", "y"]}\n{"u": {"x": 1}}\n')
    business, user = readers.profile_lines(spark, str(tmp_path / "p.json"))
    assert business.count() == 2 and user.first()["weight"] == 1.0


def test_chunks_come_in_numeric_order(spark, tmp_path):
    for i in (0, 2, 10):
        (tmp_path / f"data{i}.txt").write_text(f"p{i},{i},0.5\n")
    chunks = readers.point_chunks(spark, str(tmp_path))
    assert [c.first()["id"] for c in chunks] == ["p0", "p2", "p10"] and chunks[2].first()["features"] == [10.0, 0.5]


def test_csv_and_tables_come_back(spark, tmp_path):
    df = spark.createDataFrame([("u", "b"), ("v", "c")], readers.PAIRS)
    writers.csv_single(df, str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("part-*"))) == 1
    assert sorted(map(tuple, readers.csv_rows(spark, str(tmp_path / "c")).collect())) == [("u", "b"), ("v", "c")]
    sims = spark.createDataFrame([("a", "b", 0.5)], readers.ITEM_MODEL)
    writers.table(sims, str(tmp_path / "m"))
    assert readers.model(spark, str(tmp_path / "m")).first()["sim"] == 0.5
    writers.json_lines(sims, str(tmp_path / "j"))
    assert readers.model(spark, str(tmp_path / "j")).first()["b2"] == "b"


def test_text_formats(spark, tmp_path):
    sets = spark.createDataFrame([(["b"],), (["a"],), (["a", "b"],)], "items array<string>")
    writers.itemset_text(sets, sets.filter("size(items) = 2"), str(tmp_path / "i"))
    assert (tmp_path / "i").read_text() == "Candidates:\n('a'),('b')\n\n('a', 'b')\n\nFrequent Itemsets:\n('a', 'b')\n"
    groups = spark.createDataFrame([(2, ["c", "d"]), (1, ["e"]), (2, ["a", "b"])], "size int, members array<string>")
    writers.community_text(groups, str(tmp_path / "g"))
    assert (tmp_path / "g").read_text() == "'e'\n'a', 'b'\n'c', 'd'\n"
    writers.betweenness_text(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 9.0)], "src string, dst string, value double"), str(tmp_path / "b"))
    assert (tmp_path / "b").read_text() == "('b', 'c'), 9.0\n('a', 'b'), 1.0\n"
    writers.flags_text(spark.createDataFrame([(2, 0), (1, 1)], "at int, flag int"), "at", str(tmp_path / "f"))
    assert (tmp_path / "f").read_text() == "1 0"
    writers.json_object({"A": 1}, str(tmp_path / "o"), 4)
    assert json.loads((tmp_path / "o").read_text()) == {"A": 1}


def test_points_keep_all_features(spark, tmp_path):
    (tmp_path / "wide.txt").write_text("p," + ",".join(map(str, range(10_001))) + "\nq,1\nr\n")
    found = {r["id"]: r["features"] for r in readers.points(spark, str(tmp_path / "wide.txt")).collect()}
    assert found == {"p": [float(i) for i in range(10_001)], "q": [1.0], "r": []}


def test_profiles_come_back_from_two_lines(spark, tmp_path):
    business = spark.createDataFrame([("b1", "soup", 0.5), ("b1", "tea", 0.9), ('b"2', "pie", 1.0)], "business_id string, word string, weight double")
    user = spark.createDataFrame([("u", "soup", 0.25), ("u", "pie", 0.75), ("ü", "tea", 1.0)], "user_id string, word string, weight double")
    path = str(tmp_path / "p.json")
    writers.profile_lines(business, user, path)
    first, second = open(path, encoding="utf-8").read().splitlines()
    assert json.loads(first) == {"b1": ["tea", "soup"], 'b"2': ["pie"]} and json.loads(second) == {"u": {"soup": 0.25, "pie": 0.75}, "ü": {"tea": 1.0}}
    of_business, of_user = readers.profile_lines(spark, path)
    assert sorted(map(tuple, of_business.collect())) == sorted((b, w) for b, w, _ in business.collect())
    assert sorted(map(tuple, of_user.collect())) == sorted(map(tuple, user.collect()))


def test_rounds_as_csv(spark, tmp_path):
    rounds = spark.createDataFrame([(2, 3, 200, 1, 4, 0), (1, 3, 90, 0, 0, 1)], "round int, discard_clusters int, discard_points long, compressed_clusters int, compressed_points long, retained_points long")
    writers.round_stats(rounds, str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text().splitlines()[1:] == ["1,3,90,0,0,1", "2,3,200,1,4,0"]


def test_steps_are_counted_while_they_run(spark):
    seen = writers.Diagnostics()
    df = seen.watched(seen.watched(spark.range(100), "read").filter("id < 7"), "kept")
    assert df.count() == 7
    report = seen.report()
    assert (report["read"], report["kept"]) == (100, 7) and report["seconds"] >= 0


def test_files_by_pattern(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    assert [p.rsplit("/", 1)[-1] for p in readers.files(spark, f"{tmp_path}/*.txt")] == ["a.txt"] and readers.files(spark, f"{tmp_path}/*.csv") == []
