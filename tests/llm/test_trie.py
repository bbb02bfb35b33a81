"""Prefix trie of conversations, list ranking and running sums, against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from raterkit.llm import list_rank, order, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt_conversations(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(rows):
    convs = rebuilt_conversations(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(node))
        out[(min(m), len(node))] = (
            min(members[node[:-1]]) if node else None, len(m), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()
        )
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("x"), "depth": F.lit(7), "pos": F.lit(1.5), **more})
    return {(r[0], r[1]): tuple(r[2:]) for r in prefix_trie.prefix_trie(df).collect()}


def test_trie_against_brute_force(spark, monkeypatch):
    r = random.Random(11)
    said = [("user", "hi"), ("user", "há"), ("assistant", "yes"), (None, "no"), ("assistant", None), ("", ""), ("u", "serhi")]
    rows = []
    for c in [*range(-12, 60), 10**12, 10**12 + 3]:
        for t in range(r.choice((0, 1, 2, 5, 9, 14))):
            rows.append((c, r.choice((t, t, t, None, 3)), *r.choice(said[: r.choice((1, 2, 7))])))
    rows += rows[:7] + [(None, 1, "user", "lost"), (61, None, None, None)] + [(62, t, "user", "long talk") for t in range(40)] + [(63, 5, "user", "same row")] * 12
    monkeypatch.setattr(list_rank, "LAST", 40)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "SUM_BLOCK", 16)
    assert found(spark, rows) == plain_trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    assert found(spark, []) == {} and found(spark, [(None, 1, "a", "b")]) == {}
    rows = [(4, 1, "user", "x")]  # its first turns come from conversation 0, which is absent
    assert found(spark, rows) == plain_trie(rows) == {(4, 0): (None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())}


def test_many_ends_in_chunks(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 60_000, 5) for t in range(2)]
    out = found(spark, rows)
    want = hashlib.sha256(",".join(str(c) for c in range(0, 60_000, 5)).encode()).hexdigest()
    assert len(out) == 3 and out[(0, 2)] == (0, 12_000, 0, 1, 11_999 * 6, want) and out[(0, 0)][:4] == (None, 12_000, 1, 1)


def test_list_ranking_in_rounds(spark):
    ids = list(range(1000))
    random.Random(3).shuffle(ids)
    lists = [ids[:700], ids[700:701], ids[701:]]
    arcs = [(x, a[i - 1] if i else None, a[i + 1] if i + 1 < len(a) else None) for a in lists for i, x in enumerate(a)]
    df = spark.createDataFrame(arcs, "arc long, prev long, next long")
    want = {x: len(a) - i for a in lists for i, x in enumerate(a)}
    for last in (50, 5000):
        assert {r.arc: r["rank"] for r in list_rank.ranked(df, last).collect()} == want
    assert list_rank.ranked(df.limit(0)).count() == 0


def test_running_sums_over_one_group(spark):
    rows = [(0, i, i % 7) for i in range(500)] + [(1, 3, 5), (None, 1, 2), (None, 2, 2)]
    df = spark.createDataFrame(rows, "k long, at long, v long")
    groups = defaultdict(list)
    for k, at, v in rows:
        groups[k].append((at, v))
    upto = {(k, at): sum(v for b, v in g if b <= at) for k, g in groups.items() for at, _ in g}
    assert {(r.k, r.at): r.s for r in order.running_sums(df, ["k"], "at", {"s": "v"}, 16).collect()} == upto
    assert {(r.k, r.at): r.s + r.v for r in order.before_in_order(df, ["k"], ["at"], "v", "s").collect()} == upto
