import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lodestar.llm import prefixes
from lodestar.llm.queries import QUERIES
from tests.llm.test_oracle import SF

SCHEMA = "conv_id long, turn long, role string, text string, depth int, path string, k1 long"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(rows):
    """Every node from plain lists of turns."""
    convs = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[conv_id].append(((turn is not None, turn or 0), name, role, text))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = tuple(turns.get(first, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
        ends[seq].append(c)
    out = []
    for node, ids in members.items():
        under = [n for n in members if n[: len(node)] == node]
        children = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in under)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n)
        joined = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children), len(leaves), saved, hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 8) for r in rows], SCHEMA).repartition(3)


def made(seed, n, alphabet=3, longest=9):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(0, 400), n):
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant"]) if t > 4 else "user", "ab"[: r.randrange(alphabet)]))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_shared_prefixes_match_brute_force(spark, seed):
    rows = made(seed, 60)
    assert got(prefixes.trie(frame(spark, rows))) == brute(rows)


def test_nulls_ties_repeats_and_long_conversations(spark, monkeypatch):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, None, "user", "b"), (5, 2, "user", "é漢"), (5, 2, "user", "é漢"), (105, 2, "user", "c"), (-5, 1, "user", "a"), (0, 1, "user", "a"), (0, 1, "user", "")]
    rows += [(c, t, "user", f"turn {t}") for c in (200, 201, 202) for t in range(80)] + [(203, t, "user", "copy") for t in range(2)] * 2
    monkeypatch.setattr(prefixes, "BLOCK", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(prefixes.trie(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ids_of_one_node_are_joined_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 100)
    rows = [(1000 * i, 0, "user", "same") for i in range(200)]
    assert got(prefixes.trie(frame(spark, rows))) == brute(rows)


def test_a_conversation_may_be_turnless_and_a_table_empty(spark):
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "gone")]
    assert got(prefixes.trie(frame(spark, rows))) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert prefixes.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_conversation_prefix_trie"](spark, SF)) == brute(rows)
