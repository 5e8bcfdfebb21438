import random

import pytest

from basket_engine.llm.queries import ORACLES, QUERIES
from basket_engine.llm.quotes import as_mail, conversations, ranked

SCHEMA = "id long, text string, ord long, parent string, own string, hash int"


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "clash", "clash", 2) for i, t in rows], SCHEMA)
    return {r["id"]: r for r in conversations(df, ["id"]).collect()}


def test_replies_and_nested_levels(spark):
    got = run(spark, [
        (1, "Shall we meet?\n\nTuesday is fine."),
        (2, "Yes.\n\nOn Monday, A wrote:\n> Shall we meet?\n>\n> Tuesday is fine."),
        (3, "No, Friday.\n\nOn Monday, A wrote:\n> shall   we MEET?"),
        (4, "Then Friday.\n> > Shall we meet?\n> No, Friday."),
        (5, "Something else"),
        (6, "Agreed.\n> Yes.\n>> Shall we meet?"),
        (7, "What?\n> never written"),
    ])
    assert {k: r["parent"]["id"] if r["parent"] else None for k, r in got.items()} == {1: None, 2: 1, 3: 1, 4: 3, 5: None, 6: 2, 7: None}
    assert {k: (r["root"]["id"], r["depth"]) for k, r in got.items() if k in (1, 2, 3, 4, 6)} == {1: (1, 0), 2: (1, 1), 3: (1, 1), 4: (1, 2), 6: (1, 2)}
    order = sorted((r for r in got.values() if r["root"]["id"] == 1), key=lambda r: r["position"])
    assert [r["id"] for r in order] == [1, 2, 6, 3, 4] and [r["position"] for r in order] == list(range(5))
    assert [got[i]["text"] for i in (2, 3, 4, 7)] == ["Yes.", "No, Friday.", "Then Friday.", "What?"]


def test_latest_earlier_copy_counts(spark):
    got = run(spark, [(1, "hello"), (2, "hello"), (3, "me too\n> hello"), (4, "hello"), (5, "hello\n> hello")])
    assert got[3]["parent"]["id"] == 2 and got[5]["parent"]["id"] == 4 and got[1]["parent"] is None


def test_edges(spark):
    long_text = "line of text\n" * 5000
    got = run(spark, [(1, None), (2, ""), (3, ">"), (4, "> > >"), (5, long_text), (6, "ok\n" + "".join(f"> {x}\n" for x in long_text.split("\n"))), (7, "x"), (7, "x"), (7, None)])
    assert set(got) == set(range(1, 8)) and got[6]["parent"]["id"] == 5
    assert [got[i]["text"] for i in (1, 2, 3, 4, 6, 7)] == ["", "", "", "", "ok", "x"]
    assert all(got[i]["parent"] is None for i in (1, 2, 3, 4, 5, 7))
    assert run(spark, []) == {}


def test_pieces_and_deeper_levels(spark):
    original = "Shall we meet on Tuesday? I am free\nall day. Bring the plans.\n\nThe room is booked!\nSee you there"
    got = run(spark, [
        (1, original),
        (2, "Yes\n> Bring the plans."),  # a sentence
        (3, "Which?\n> The room is booked!"),  # a line
        (4, "So\n> I am free all\n> day. Bring\n> the plans."),  # sentences, in other lines
        (5, "Well\n> > see you   THERE"),  # the second level alone
        (6, "Hm\n> Yes, of course\n> > Shall we meet on Tuesday? I am free\n> > all day. Bring the plans."),  # the first level was changed
        (7, "Ok\n> Yes\n> Bring nothing"),  # a line of a passage
        (8, "No\n> something else entirely"),
        (9, "Two\n> The room is booked!\n> > > Yes"),  # the nearest level decides
    ])
    assert {k: r["parent"]["id"] if r["parent"] else None for k, r in got.items()} == {1: None, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2, 8: None, 9: 1}


def test_the_longest_run_decides(spark):
    got = run(spark, [
        (1, "First thing. Second thing. Third thing."), (2, "A rather long sentence that comes later. Second thing."), (3, "x\n> First thing. Second thing. Third thing."),
        (4, "y\n> Second thing. Third thing."), (5, "z\n> Second thing."), (6, "w\n> A rather long sentence that comes later.\n> Third thing."),
    ])
    assert {k: r["parent"]["id"] for k, r in got.items() if r["parent"]} == {3: 1, 4: 2, 5: 2, 6: 2}


@pytest.mark.parametrize("name", ["root", "parent", "position", "depth", "ord", "own", "path", "step", "known", "hash", "text_", "_text", "level"])
def test_key_columns_of_any_name(spark, name):
    df = spark.createDataFrame([(1, "hello"), (2, "me too\n> hello")], f"`{name}` long, body string")
    got = conversations(df, [name], "body")
    key = f"{name}_key" if name in ("root", "parent", "depth", "position", "text") else name
    rows = {r[key]: r for r in got.collect()}
    assert rows[2]["parent"][name] == 1 and rows[2]["root"][name] == 1 and rows[2]["position"] == 1


def walk(parents):
    """{message: (root, depth, position)} by a plain walk through the trees."""
    below, out = {}, {}
    for k in sorted(parents):
        below.setdefault(parents[k], []).append(k)
    for root in below.get(None, []):
        stack, n = [(root, 0)], 0
        while stack:
            k, depth = stack.pop()
            out[k] = (root, depth, n)
            n += 1
            stack += [(c, depth + 1) for c in reversed(below.get(k, []))]
    return out


@pytest.mark.parametrize("shape", ["chain", "star", "random", "alone"])
def test_ranks_of_trees(spark, shape):
    rng = random.Random(shape)
    parents = {k: None if k % 50 == 0 else {"chain": k - 1, "star": k - k % 50, "random": rng.choice([None, *range(max(0, k - 20), k)]), "alone": None}[shape] for k in range(150)}
    got = ranked(spark.createDataFrame(list(parents.items()), "ord long, parent long")).collect()
    assert {r["ord"]: (r["root"], r["depth"], r["position"]) for r in got} == walk(parents)
    assert len(got) == 150


def test_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    found = con.sql(ORACLES["op4_quotes"])
    expected = sorted(found.fetchall())
    got = QUERIES["op4_quotes"](spark, sf)
    assert got.columns == found.columns and sorted(tuple(r) for r in got.collect()) == expected
    assert len({r[3] is not None and r[1] - r[3] for r in expected}) == 3  # roots, direct replies and branches


@pytest.mark.parametrize("copies", [1, 40])
def test_round_trip_of_conversations(spark, copies):
    """Equal conversations: the latest earlier copy is that of the conversation itself."""
    turns = [(c, t, f"First words of {c % 3 if t else 0}.\nSome more, {t} of them. And an end {t}") for c in range(copies) for t in range(6)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    got = conversations(as_mail(df), ["conv_id", "turn"]).collect()
    assert len(got) == len(turns)
    parents = {}
    for c, t, _ in turns:
        parents[c, t] = None if not t else (c, t - 1 if (c + 3 * t) % 5 < 3 or t < 2 else t - 2)
    places = walk(parents)
    for r in got:
        key = r["conv_id"], r["turn"]
        assert (tuple(r["parent"]) if r["parent"] else None) == parents[key]
        assert (tuple(r["root"]), r["depth"], r["position"]) == places[key]
    assert {(r["conv_id"], r["turn"], r["text"]) for r in got} == set(turns)
