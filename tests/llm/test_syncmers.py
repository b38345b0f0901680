import hashlib
import random
import re

import pytest
import xxhash

from lodestar.llm import syncmers as sy
from lodestar.llm.queries import QUERIES
from tests.llm import cases
from tests.llm.test_oracle import SF


def hashed(*words, seed=42):
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode() if isinstance(w, str) else w, seed=seed)
    return seed


def words_of(text):
    out = []
    for w in re.split(r"[\x20\x09-\x0D]+", text):
        out += [w[i : i + sy.PIECE] for i in range(0, len(w), sy.PIECE)] if len(w) > sy.LONG else [w] if w else []
    return out


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def anchors_of(text, k=sy.K, s=sy.S):
    ws = words_of(text)
    out = []
    for i in range(len(ws) - k + 1):
        inner = [signed(hashed(*ws[i + j : i + j + s])) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, hashed(*ws[i : i + k]) >> 32))
    if not out and ws:
        # Spark hashes an int by 4 bytes, then the joined words
        out = [(0, xxhash.xxh64_intdigest(" ".join(ws).encode(), seed=xxhash.xxh64_intdigest(k.to_bytes(4, "little"), seed=42)) >> 32)]
    return out


def kept_of(text):
    return sorted({a for _, a in anchors_of(text)})[: sy.KEPT]


def like(a, b):
    union = sorted({*a, *b})[: sy.KEPT]
    return len({*union} & {*a} & {*b}) / len(union) if union else 1.0


def brute(rows):
    """(doc_id, text) -> the query's rows."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(hashed(r[1])), r[1]))
    out = []
    for at, (i, text) in enumerate(order):
        other = order[(at + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        a, b, c = kept_of(text), kept_of(edited), kept_of(other)
        write = lambda kept: "".join(f"{x:08x}" for x in kept)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), write(a), write(b), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect()), key=repr)


def test_awkward_rows_match_brute_force(spark):
    rows = [(r[0], r[1]) for r in cases.rows()]
    rows += [(900, "x" * 500 + " tail"), (901, "漢字" * 300), (None, "another one of the null ids"), (3, "the same id with another text")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 1, True, "x") for i, t in rows], cases.SCHEMA).repartition(3)
    assert got(sy.fingerprint_table(df)) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_tiny_tables(spark, n):
    rows = [(i, cases.prose(i, 30)) for i in range(n)]
    assert got(sy.fingerprint_table(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert sy.fingerprint_table(cases.empty(spark)).count() == 0


def test_heavy_ids_are_cut_by_hash(spark):
    rows = [(7, cases.prose(i, 12)) for i in range(200)] + [(None, cases.prose(i, 12)) for i in range(300, 400)] + [(i, cases.prose(i, 12)) for i in range(-20, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(sy.fingerprint_table(df)) == brute(rows)


def test_anchors_are_free_of_context_and_dense(spark):
    r = random.Random(4)
    ws = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    changed = [*ws[:1000], "new", "words", *ws[1010:]]
    found = spark.createDataFrame([(" ".join(x),) for x in (ws, changed)], "text string").select(sy.anchors(sy.words(sy.F.col("text"))).alias("a")).collect()
    a, b = ([(x["place"], x["anchor"]) for x in row["a"]] for row in found)
    assert a == anchors_of(" ".join(ws))
    assert {x for x in a if x[0] + sy.K <= 1000} == {x for x in b if x[0] + sy.K <= 1000}
    assert {(p - 8, h) for p, h in a if p >= 1010} == {x for x in b if x[0] >= 1002}
    assert max(q - p for (p, _), (q, _) in zip(a, a[1:], strict=False)) <= sy.K - sy.S
    assert len(a) < 0.6 * len(ws)


def test_agreement_ends_where_the_edit_starts(spark):
    text = cases.prose(5, 400)
    edited = " ".join(text.split(" ")[:250]) + " " + cases.prose(6, 100)
    ends = lambda t: sy.anchors(sy.words(t))
    row = spark.createDataFrame([(text, edited)], "a string, b string").select(sy.agreed(ends(sy.F.col("a")), ends(sy.F.col("b"))).alias("n"), sy.agreed(ends(sy.F.col("a")), ends(sy.F.lit("other words"))).alias("none")).first()
    assert 250 - 2 * (sy.K - sy.S) <= row["n"] <= 250 and row["none"] == 0


def test_query_on_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_document_fingerprints"](spark, SF)) == brute(rows)
