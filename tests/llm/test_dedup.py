import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import neardup, suffixes
from lodestar.llm.graph import components
from lodestar.llm.wordhash import PrimeHasher, WordHasher, shingles
from tests.llm.cases import documents, empty, prose, rows

import pyarrow as pa


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)]) if words else frozenset()


def brute_components(pairs, width):
    sets = {i: shingle_set(t, width) for i, t in pairs}
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label, sets


@pytest.mark.parametrize("width", [2, 5])
def test_components_match_brute_force(spark, width):
    got = neardup.near_dup_table(documents(spark), width).collect()
    label, sets = brute_components({(i, t) for i, t, *_ in rows() if i is not None}, width)
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
    assert neardup.near_dup_table(empty(spark), width).count() == 0
    kept = neardup.near_dup_kept(documents(spark), width)
    assert kept.columns == documents(spark).columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted({v for v in label.values()})


@pytest.mark.parametrize("block", [None, 3])
def test_links_that_a_star_misses_are_found(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(neardup, "WIDE_BLOCK", block)
        monkeypatch.setattr(neardup, "BLOCK", block)
    # a chain around one hub: neighbours are alike, the hub is like none of them
    base = prose(9, 200).split(" ")
    texts = []
    for i in range(40):
        words = list(base)
        for j in range(i * 4, i * 4 + 26):
            words[j % 200] = f"edit{j}"
        texts.append((i, " ".join(words)))
    label, _ = brute_components(texts, 2)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_dup_table(df, 2).collect()}
    assert got == label


def test_block_comparison_is_complete():
    rng = np.random.default_rng(5)
    core = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([core[rng.random(60) < 0.93], rng.integers(0, 2**63, 2, dtype=np.uint64)])) for _ in range(50)]
    links = neardup.joining_links(np.arange(50), np.arange(50), sets, np.ones(50, dtype=bool))
    label = list(range(50))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        assert neardup.is_link(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
        label[root(b)] = root(a)
    for a in range(50):
        for b in range(a):
            if neardup.is_link(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                assert root(a) == root(b)


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_forest_connects_all_links_of_two_sides(batch):
    rng = np.random.default_rng(11)
    core = rng.integers(0, 2**63, 90, dtype=np.uint64)
    rows = []
    for node in range(60):
        held = np.unique(np.concatenate([core[rng.random(90) < rng.choice([0.85, 0.97])], rng.integers(0, 2**63, 3, dtype=np.uint64)]))
        # two groups of one task: (1, 0, 1) has two sides, (2, 0, 0) has one
        rows.append({"shingle": 1 + node % 2, "low": 0, "high": 1 - node % 2, "first": node % 2 == 1 or node < 20, "node": node, "component": node // 3, "set": held})
    rows.sort(key=lambda r: (r["shingle"], r["low"], r["high"], r["node"]))
    bits = np.zeros((60, neardup.MARK), dtype=np.uint8)
    for at, r in enumerate(rows):
        np.bitwise_xor.at(bits[at], (r["set"] % np.uint64(neardup.MARK)).astype(np.int64), 1)
    table = pa.Table.from_pylist([{**r, "set": None, "size": len(r["set"]), "mark": np.packbits(b).tobytes()} for r, b in zip(rows, bits, strict=True)])
    edges = [(a, b) for out in neardup.near_forest(iter(table.to_batches(max_chunksize=batch))) for a, b in zip(*out.to_pydict().values(), strict=True)]
    label = list(range(60))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        label[root(b)] = root(a)
    links = 0
    for i, x in enumerate(rows):
        for y in rows[:i]:
            one_side = x["shingle"] == 1 and x["first"] == y["first"]
            if x["shingle"] == y["shingle"] and x["component"] != y["component"] and not one_side and neardup.is_link(len(np.intersect1d(x["set"], y["set"])), len(x["set"]), len(y["set"])):
                links += 1
                assert root(x["node"]) == root(y["node"])
    assert links > 50
    assert len(edges) < 60


def test_rows_of_one_id_with_different_texts(spark):
    x, y = prose(41, 120), prose(42, 120)
    texts = [(1, x), (1, y), (2, x + " q"), (3, y + " q"), (4, prose(43, 50)), (4, prose(43, 50))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = neardup.near_dup_table(df, 2).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4} and len(got) == 6
    kept = sorted((r.doc_id, r.text) for r in neardup.near_dup_kept(df, 2).collect())
    assert kept == sorted({(1, x), (1, y), (4, texts[-1][1])})


@pytest.mark.parametrize("width", [2, 5])
def test_recall_on_sample_documents(spark, width):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    label, _ = brute_components([(r.doc_id, r.text) for r in df.collect()], width)
    assert {r.doc_id: r.component_id for r in neardup.near_dup_table(df, width).collect()} == label


def test_links_between_groups_are_found_without_their_centres(spark):
    # near copies with more and more edits: early ones are like each other, late ones like few
    base = prose(9, 150).split(" ")
    texts = []
    for i in range(60):
        words = list(base)
        for j in range(3 + i // 6):
            words[(i * 37 + j * 11) % 150] = f"edit{i}.{j}"
        texts.append((i, " ".join(words)))
    label, _ = brute_components(texts, 2)
    got = neardup.near_dup_table(spark.createDataFrame(texts, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == label and 1 < len(set(label.values())) < 60


def test_words_of_one_hash_modulo_powers_of_two_differ():
    thue = "a"
    for _ in range(10):
        thue += thue.translate(str.maketrans("ab", "ba"))
    words = [thue, thue.translate(str.maketrans("ab", "ba"))]
    (_, _, old, _), = WordHasher().words(pa.array([" ".join(words)]))
    (_, _, new, _), = PrimeHasher().words(pa.array([" ".join(words)]))
    assert old[0] == old[1] and new[0] != new[1]
    long = pa.array(["w " * 40 + "x" * (PrimeHasher.SHORT + 9) + " w y"])
    (_, _, hashes, _), = PrimeHasher().words(long)
    assert len(set(hashes.tolist())) == 3 and hashes[0] == hashes[-2]


def test_densification_fills_every_bin():
    hashes = np.array([1, 2**60, 2**63], dtype=np.uint64)
    signature = neardup.signatures(hashes, np.array([0, 0, 1, 3]))
    assert (signature[0] == neardup.EMPTY).all()
    assert set(signature[1].tolist()) == {1} and set(signature[2].tolist()) == {2**60, 2**63}


def test_word_hashes_by_hand():
    column = pa.array(["The cat  THE", None, "", "a\tb", "é É"])
    (_, _, words, firsts), = WordHasher().words(column)
    assert firsts.tolist() == [0, 3, 3, 3, 5, 7]
    assert words[0] == words[2] != words[1] and words[5] != words[6]
    hashes, at = shingles(words, firsts, 2)
    assert at.tolist() == [0, 2, 2, 2, 3, 4]


def test_components_of_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(20)] + [(50, 40), (41, 40), (60, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 41: 40, 50: 40}


def brute_repeats(pairs):
    encoded = [(i, (t or "").encode()) for i, t in pairs]
    n = Counter(b[p : p + 200] for _, b in encoded for p in range(len(b) - 199))
    out = []
    for i, b in encoded:
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if n[b[p : p + 200]] > 1:
                mask[p : p + 200] = True
        spans = int((mask & ~np.concatenate([[False], mask[:-1]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~mask]) if len(b) else b""
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _sorted(rows):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("wide", [False, True])
def test_repeats_match_brute_force(spark, monkeypatch, wide):
    if wide:  # every suffix bucket takes the way of the largest
        monkeypatch.setattr(suffixes, "WIDE_BYTES", 1)
    got = suffixes.repeat_table(documents(spark)).collect()
    assert _sorted(got) == _sorted(brute_repeats([r[:2] for r in rows()]))
    assert suffixes.repeat_table(empty(spark)).count() == 0


def test_shared_passages_and_periods(spark):
    passage = prose(20, 60)
    texts = [(i, prose(100 + i, 20 + i) + " " + passage[i % 5 :] + " " + prose(200 + i, 25)) for i in range(40)] + [(90, "ab" * 400), (91, "x" * 199), (92, "x" * 200), (93, "y" * 201)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert _sorted(suffixes.repeat_table(df).collect()) == _sorted(brute_repeats(texts))


def test_the_sort_decides(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_sorted", lambda pieces: pieces.select("piece", F.lit(0).alias("lo"), F.lit(0).alias("hi")).limit(0))
    assert {r.n_removed for r in suffixes.repeat_table(documents(spark)).collect()} == {0}


def test_rows_without_id_are_told_apart_by_their_texts(spark):
    # two texts whose 32-bit hashes are equal, one of them repeated elsewhere
    other = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(256))
    made = spark.range(400_000).select(F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2((F.col("id") + 10**9).cast("string"), 512)).alias("t")).withColumn("h", F.hash("t"))
    pair = made.groupBy("h").agg(F.collect_list("t").alias("t")).filter(F.size("t") > 1).first()
    a, b = pair.t[:2]
    texts = [(None, a), (None, b), (5, a), (-(2**63), other), (None, other + "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert _sorted(suffixes.repeat_table(df).collect()) == _sorted(brute_repeats(texts))


def test_equal_texts_are_cut_once_and_counted(spark, monkeypatch):
    tables, stored = {}, suffixes.stored
    monkeypatch.setattr(suffixes, "dropped", lambda *_: None)
    monkeypatch.setattr(suffixes, "stored", lambda df, name: tables.setdefault(name, stored(df, name)))
    text = prose(40, 120)
    texts = [(i, text) for i in range(6)] + [(6, prose(41, 90)), (7, prose(42, 70) + text[:500]), (8, "x" * 199), (9, text)]
    got = suffixes.repeat_table(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert _sorted(got) == _sorted(brute_repeats(texts))
    slices = tables["suffix-slices"].collect()
    assert len({(r.piece, r.start, r.copies) for r in slices if r.copies == 7}) == sum(r.copies == 7 for r in slices) > 0
    assert {r.copies for r in slices} == {1, 7}


def test_ranks_by_plain_sorts_order_like_lexsort():
    rng = np.random.default_rng(5)
    for top in (3, 1 << 20, 1 << 45):  # the last does not fit one number
        keys = [rng.integers(0, 4, 4000), rng.integers(0, 1 << 64, 50, dtype=np.uint64)[rng.integers(0, 50, 4000)], rng.integers(-1, top, 9)[rng.integers(0, 9, 4000)], rng.integers(-1, top, 9)[rng.integers(0, 9, 4000)]]
        order, classes = suffixes._sorted_keys(keys)
        rows = list(zip(*(k.tolist() for k in keys), strict=True))
        assert [rows[i] for i in order] == sorted(rows)
        assert classes.tolist() == np.cumsum([0, *(rows[a] != rows[b] for a, b in zip(order, order[1:], strict=False))]).tolist()
    assert [len(x) for x in suffixes._sorted_keys([np.zeros(0, np.int64), np.zeros(0, np.uint64)])] == [0, 0]


def test_removed_text_keeps_columns(spark):
    out = suffixes.remove_repeats(documents(spark))
    assert out.columns == documents(spark).columns
    assert out.filter("doc_id = 5").first().text == ""


def test_difference_cover_and_block_order():
    cover = suffixes.difference_cover(32)
    assert {(a - b) % 32 for a in cover for b in cover} == set(range(32)) and len(cover) <= 9
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 3000, dtype=np.uint8)
    text[1600:2000] = text[320:720]
    padded = np.concatenate([text, np.zeros(suffixes.RANKED + suffixes.PERIOD, np.uint8)])
    starts = np.arange(0, 2784, 32)
    order, classes = suffixes.block_classes(padded, starts, np.zeros(len(starts), dtype=np.int64))
    strings = [bytes(text[s : s + 200]) for s in starts]
    assert [strings[i] for i in order] == sorted(strings)
    assert all((strings[a] == strings[b]) == (x == y) for a, b, x, y in zip(order, order[1:], classes, classes[1:], strict=False))
