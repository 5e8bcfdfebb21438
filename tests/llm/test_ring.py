import zlib

import pytest

from basket_engine.llm.ring import _nodes, placed

from .data import edge_rows, edge_table, kept_texts, table


def shards(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("n, count", [(500, 24), (23, 24), (0, 24), (48, 5), (1, 3)])
def test_balance_and_slots(spark, n, count):
    got = shards(placed(table(spark, [(i * 7, f"t{i}", "en", "s", 2) for i in range(n)]), count, 16))
    assert len(got) == n
    by = {}
    for r in got.values():
        assert 0 <= r["shard"] < count and r["law"] == "rows" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(count)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())


def clockwise(at, nodes, count):
    """{id: (shard, slot)}: every document walks from its own place, round by round.

    All that ask a shard are taken in ring order until it is full; who is left goes on to the
    next node of a shard with room.
    """
    ring = sorted([(h, False, i, None) for i, h in at.items()] + [(h, True, 0, s) for h, s in nodes])
    shard_of, asking = [x[3] for x in ring if x[1]], []
    for place, (_, is_node, i, _) in enumerate(ring):
        if not is_node:
            k = sum(x[1] for x in ring[:place])
            asking.append((k % len(shard_of), place, i))
    free = [len(at) // count + (s < len(at) % count) for s in range(count)]
    taken, out = [0] * count, {}
    while asking:
        rest = []
        for k, place, i in sorted(asking):
            s = shard_of[k]
            if free[s]:
                out[i] = (s, taken[s])
                free[s], taken[s] = free[s] - 1, taken[s] + 1
            else:
                rest.append((k, place, i))
        asking = []
        for k, place, i in rest:
            ahead = [j for j in [*range(k + 1, len(shard_of)), *range(len(shard_of))] if free[shard_of[j]]]
            asking.append((ahead[0], place, i))
    return out


@pytest.mark.parametrize("n, count, virtual", [(500, 24, 16), (60, 5, 3), (300, 7, 1), (10, 3, 8)])
def test_like_a_walk_of_each_document(spark, n, count, virtual):
    rows = [(i * 7, f"t{i}", "en", "s", 2) for i in range(n)]
    at = {r["id"]: r["at"] for r in spark.range(n).selectExpr("id * 7 AS id", "xxhash64(id * 7) AS at").collect()}
    nodes = [(r["at"], r["shard"]) for r in _nodes(spark, count, virtual).collect()]
    got = shards(placed(table(spark, rows), count, virtual))
    assert {i: (r["shard"], r["slot"]) for i, r in got.items()} == clockwise(at, nodes, count)


def test_movement_is_limited(spark):
    row = lambda i: (i, "x", "en", "s", 1)
    before = shards(placed(table(spark, [row(i) for i in range(600)]), 8))
    more = shards(placed(table(spark, [row(i) for i in range(630)]), 8))
    wider = shards(placed(table(spark, [row(i) for i in range(600)]), 9))
    assert sum(before[i]["shard"] != more[i]["shard"] for i in before) < 150
    assert sum(before[i]["shard"] != wider[i]["shard"] for i in before) < 300  # a new deal would move 533


def test_edges(spark):
    texts = kept_texts(edge_rows())
    got = shards(placed(edge_table(spark)))
    assert set(got) == set(texts)
    for k, t in texts.items():
        raw = (t or "").encode()
        assert (got[k]["size"], got[k]["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
