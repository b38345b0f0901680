"""The quality classifier against plain Python: votes, EM, training and scores, one document and one word at a time."""

import math
import random
import re
import struct
from collections import Counter

import pyarrow as pa

from lodestar.llm import quality
from tests.llm.cases import prose

BASE, MASK = 0x9E3779B97F4A7C15, 2**64 - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def polynomial(values):
    return mixed(sum((v + 1) * pow(BASE, i, 2**64) for i, v in enumerate(values)) & MASK)


def kind(byte):
    if 0x41 <= byte <= 0x5A:
        return 1
    if 0x61 <= byte <= 0x7A or byte >= 0x80:
        return 2
    return 3 if 0x30 <= byte <= 0x39 else byte


def folded(word):
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in word)


def words_of(raw):
    return re.findall(rb"[^\x20\x09-\x0D]+", raw)


def votes(text):
    """The vote of every labeller: 0 none, 1 good, 2 bad."""
    raw = (text or "").encode()
    words = words_of(raw)
    n = len(words)
    if not n:
        return None
    kinds = [kind(b) for b in b"".join(words)]
    low = [folded(w) for w in words]
    measures = {
        "symbols": sum(b in b"#*$%&<>" for b in raw) / n,
        "marks": sum(k > 3 for k in kinds) / n,
        "capitals": kinds.count(1) / max(kinds.count(1) + kinds.count(2), 1),
        "exclaims": raw.count(b"!") / n,
        "bars": raw.count(b"|") / n,
        "loose": sum(len(w) == 1 and kind(w[0]) > 3 for w in words) / n,
        "echoes": sum(a == b for a, b in zip(low, low[1:], strict=False)) / n,
        "repeats": 1 - min(len(set(low)) / min(n, 4 * math.sqrt(n)), 1),
        "run_on": 1 - min(sum(b in b".?!" for b in raw) * 20 / n, 1),
    }
    out = []
    for _, name, good, bad in quality.LABELLERS:
        x = measures[name]
        short = n < 20 and name in ("repeats", "run_on")
        out.append(0 if short else 2 if x >= bad else 1 if x <= good else 0)
    return tuple(out)


def em(counts, rounds=100):
    """{votes: posterior of good}, document classes and labellers looped over one by one."""
    m, prior, total = len(quality.LABELLERS), 0.8, sum(counts.values())
    rates = {0: [[1, 0.98, 0.02] for _ in range(m)], 1: [[1, 0.7, 0.3] for _ in range(m)]}
    posterior = dict.fromkeys(counts, prior)
    for _ in range(rounds):
        before = posterior
        posterior = {}
        for v in counts:
            good, bad = prior, 1 - prior
            for j in range(m):
                good, bad = good * rates[0][j][v[j]], bad * rates[1][j][v[j]]
            posterior[v] = good / (good + bad)
        for c in (0, 1):
            for j in range(m):
                seen = {k: 0.5 + sum(n * (posterior[v] if c == 0 else 1 - posterior[v]) for v, n in counts.items() if v[j] == k) for k in (1, 2)}
                rates[c][j] = [1, seen[1] / sum(seen.values()), seen[2] / sum(seen.values())]
        prior = min(max(sum(n * posterior[v] for v, n in counts.items()) / total, 0.02), 0.98)
        if max(abs(posterior[v] - before[v]) for v in counts) < 1e-9:
            break
    return posterior


def features(text):
    """Counts of hashed features: each word's shape, its shape after the one before, and the word itself."""
    out, last, last_low = Counter(), None, None
    top = lambda x: mixed(x) >> (64 - quality.BITS)
    for word in words_of((text or "").encode()):
        kinds = [kind(b) for b in word]
        shape = polynomial([k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1]])
        low = folded(word)
        out[top(shape + (low == last_low) & MASK)] += 1
        pair = shape if last is None else mixed(shape + last * 31 & MASK)
        out[top(pair ^ 0x51ED270B)] += 1
        out[top(polynomial(low) ^ 0x2545F491)] += 1
        last, last_low = shape, low
    return out


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def logistic(rows, labels, rounds=300):
    """Weights by feature and the bias of a logistic regression on soft labels, both classes weighing the same."""
    good, bad, n = max(sum(labels), 1), max(sum(1 - y for y in labels), 1), len(labels)
    importance = [n * (y / good + (1 - y) / bad) / 2 for y in labels]
    weights = dict.fromkeys({k for r in rows for k in r} | {"bias"}, 0.0)
    first, second = dict.fromkeys(weights, 0.0), dict.fromkeys(weights, 0.0)
    for t in range(1, rounds + 1):
        slope = {k: 0.0 if k == "bias" else 1e-6 * w for k, w in weights.items()}
        for row, y, weight in zip(rows, labels, importance, strict=True):
            z = weights["bias"] + sum(weights[k] * x for k, x in row.items())
            error = weight * (1 / (1 + math.exp(-min(max(z, -30), 30))) - y) / n
            slope["bias"] += error
            for k, x in row.items():
                slope[k] += error * x
        for k, s in slope.items():
            first[k], second[k] = 0.9 * first[k] + 0.1 * s, 0.99 * second[k] + 0.01 * s * s
            weights[k] -= 0.1 * (first[k] / (1 - 0.9**t)) / (math.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return weights


def small_table():
    r = random.Random(5)
    junk = ["$$$", "###", "BUY", "NOW!!!", "|", "a|b", "<b>", "click", "click", "%%", "!!"]
    texts = [prose(s, r.randint(15, 60)) for s in range(14)]
    texts += [" ".join(r.choice(junk) for _ in range(r.randint(15, 50))) for _ in range(7)]
    texts += ["word " * 40, "one", "Émile dit: été à Köln!", prose(90, 30) + " ### $$ | " * 4, None, "", " \n"]
    rows = list(enumerate(texts))
    return [*rows, rows[3], rows[15], (100, texts[4]), (None, texts[0])]


def test_table_is_that_of_plain_python(spark):
    rows = small_table()
    posterior = em(Counter(v for v in (votes(t) for _, t in rows) if v))
    # rows equal in id and text train once
    drawn = [t for _, t in dict.fromkeys(rows) if votes(t)]
    n_words = lambda t: len(words_of((t or "").encode()))
    vectors = [{k: single(c / (n_words(t) + quality.SHRINK)) for k, c in features(t).items()} for t in drawn]
    weights = logistic(vectors, [posterior[votes(t)] for t in drawn])

    got = quality.quality_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text in rows:
        row, v = by_id[doc_id], votes(text)
        assert row.n_words == n_words(text)
        if not v:
            assert (row.pattern, row.weak_label, row.score, row.accepted) == (0, 0.0, 0.0, False)
            continue
        assert row.pattern == sum(x * 3 ** (len(v) - 1 - j) for j, x in enumerate(v)), text
        assert abs(row.weak_label - posterior[v]) < 1e-5
        z = weights["bias"] + sum(weights.get(k, 0.0) * c for k, c in features(text).items()) / (n_words(text) + quality.SHRINK)
        score = 1 / (1 + math.exp(-min(max(z, -30), 30)))
        assert abs(row.score - score) < 1e-3, text
        assert row.accepted == (score >= quality.ACCEPT) or abs(score - quality.ACCEPT) < 1e-3


def test_accuracy_on_documents_not_trained_on(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id")
    # no text of the other half is in the half that trains
    half = "pmod(xxhash64(text), 2) = {}"
    known, weights = quality.train(docs.filter(half.format(0)))
    unseen = docs.filter(half.format(1)).select("text", "quality").toArrow().combine_chunks()
    batch = pa.RecordBatch.from_arrays([unseen["text"].combine_chunks()], names=["text"])
    accepted = quality._scored(batch, quality.Reader(), known, weights)[3] >= quality.ACCEPT
    right = accepted == (unseen["quality"].to_numpy() == 1)
    assert len(right) > 1000 and right.mean() > 0.97
