import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators.split_values import DELIMITERS, business_categories, split_buffer, split_values

NAMES = ["Bars", 'The "Old" Trades', "Fish, Live", "Children's Cafés", "A/B", "Bed | Breakfast", "R & B-Soul", "24h"]


def by_row(fields):
    values, row, at = split_buffer(pa.array(fields, pa.string()))
    out = [[] for _ in fields]
    for v, r, k in zip(values.to_pylist(), row.tolist(), at.tolist()):
        out[r].append(v)
        assert k == len(out[r])
    return out


def state_machine(field):
    """The same rules, character by character, for fields whose quoting is valid."""
    t = (field or "").strip()
    listed = len(t) >= 2 and t[0] == "[" and t[-1] == "]"
    t = t[1:-1] if listed else t
    out, i = [], 0
    while i <= len(t):
        while i < len(t) and t[i].isspace() and t[i] not in DELIMITERS:
            i += 1
        close = {'"': '"', "“": "”", "'": "'" if listed else None}.get(t[i]) if i < len(t) else None
        value, k = "", i
        if close:
            k += 1
            while k < len(t):
                if close != "”" and t[k] == "\\" and t[k + 1 : k + 2] and t[k + 1] in "\"'\\":
                    value, k = value + t[k + 1], k + 2
                elif t[k] == close:
                    if close == '"' and t[k + 1 : k + 2] == '"':
                        value, k = value + '"', k + 2
                        continue
                    break
                else:
                    value, k = value + t[k], k + 1
        while k < len(t) and t[k] not in DELIMITERS:
            value, k = value if close else value + t[k], k + 1
        if value.strip():
            out.append(value.strip())
        i = k + 1
    return out


def notations(names):
    import json

    return [
        repr(names),
        json.dumps(names, ensure_ascii=False),
        ";  ".join('"' + n.replace('"', '""') + '"' for n in names),
        "、".join('"' + n.replace('"', '\\"') + '"' for n in names),
        " | ".join("“" + n + "”" for n in names),
        " · \xa0".join(n if not set(n) & set('",/|') else '"' + n.replace('"', '""') + '"' for n in names),
    ]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(NAMES), max_size=5), min_size=1, max_size=6))
def test_all_notations_come_back(lists):
    fields = [f for names in lists for f in notations(names)]
    assert by_row(fields) == [names for names in lists for _ in range(6)]
    assert by_row(fields) == [state_machine(f) for f in fields]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='ab"“”\'[],;\\ \n、é', max_size=14), min_size=1, max_size=8))
def test_any_text_is_split_without_loss_of_rows(fields):
    together = by_row(fields)
    assert together == [by_row([f])[0] for f in fields]
    for values in together:
        assert all(v and v == v.strip() for v in values)


def test_edges():
    assert by_row([None, "", "  \xa0", "[]", ", ;", '""', '"abc', "a,,b"]) == [[], [], [], [], [], [], ['"abc'], ["a", "b"]]
    assert by_row(["x" * 300_000 + "," + "y" * 300_000])[0][1] == "y" * 300_000
    assert by_row(["Bars, Bars"]) == [["Bars", "Bars"]]


def test_slices_of_a_column():
    whole = pa.array(["a,b", "c;d", None, "e"], pa.string())
    values, row, _ = split_buffer(whole.slice(1, 3))
    assert values.to_pylist() == ["c", "d", "e"] and row.tolist() == [0, 0, 2]


def test_operator(spark):
    df = spark.createDataFrame([(1, "a; b", 9), (2, None, 8), (2, "c", 8)], "id int, f string, pos int")
    out = split_values(df, "f")
    assert sorted(map(tuple, out.select("id", "pos", "value").collect())) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    assert split_values(df.limit(0), "f").collect() == []


def test_a_business_counts_once(spark):
    df = spark.sql("SELECT * FROM VALUES ('x', 'a, b', timestamp'2020-01-01'), ('x', 'a, b', timestamp'2021-01-01'), ('y', null, null) t(business_id, categories, updated_at)")
    assert sorted(map(tuple, business_categories(df).collect())) == [("x", 1, "a"), ("x", 2, "b")]
