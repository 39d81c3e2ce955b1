import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from viaduct.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, c string, n1 long, depth string"


def brute(rows, rebuild):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [v[1:] for v in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:] if rebuild else turns)
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        saved[s] = (len(members[s]) - 1) * words + sum(saved[k] for k in kids[s])
    digest = lambda s, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(s)).encode()).hexdigest()
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], digest(s, m)) for s, m in members.items())


def found(spark, rows, rebuild):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    turns, convs = tries.numbered(df)
    if rebuild:
        turns, convs = tries.reopened(turns, convs)
    return sorted((tuple(r) for r in tries.trie(turns, convs).collect()), key=lambda r: r[:2])


def talks():
    r = random.Random(5)
    rows = [(None, 0, "user", "nobody's"), (3, None, None, None), (3, 1, "user", "  two words "), (3, 1, "user", "  two words "), (3, 1, "user", "another at the same turn")]
    for c in (0, 1, 2, 7, 20, 21, 22, 23, 25, 41, 45, -19, 10**12 + 3):
        rows += [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "b c", "d\te f"])) for t in range(r.randrange(1, 6))]
    rows += [(60 + c, t, "user", "same") for c in range(40) for t in range(3)]  # copies
    return rows + [(200, t, "user", f"turn {t}") for t in range(37)] + [(201, t, "user", f"turn {t % 35}") for t in range(37)] + [(210, 0, "user", "word " * 60_000)]


@pytest.mark.parametrize("rebuild", [False, True])
def test_nodes_are_those_of_brute_force(spark, rebuild, monkeypatch):
    monkeypatch.setattr(tries, "PIECE", 7)  # ids of a node come in several pieces
    assert found(spark, talks(), rebuild) == brute(talks(), rebuild)


def test_one_conversation_in_several_segments(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(1, t, "user", str(t % 7)) for t in range(300)] + [(2, t, "user", str(t % 7)) for t in range(290)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        turns, convs = tries.numbered(df)
        assert turns.select("seg").distinct().count() > 2
        got = sorted((tuple(r) for r in tries.trie(turns, convs).collect()), key=lambda r: r[:2])
        assert got == brute(rows, False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_conversation_no_node(spark):
    assert found(spark, [], True) == [] and found(spark, [(None, 1, "user", "x")], True) == []
