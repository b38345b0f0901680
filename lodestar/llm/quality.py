"""Weak-label quality classifier.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of vote patterns (all documents,
at most 3 ** labellers patterns) estimates how often each labeller votes what
on good and on bad documents.  The posterior of a pattern is the soft label
of its documents; on a hash sample of at most about ``SAMPLE`` documents these
train a linear scorer over hashed word shapes, which then scores every
document.

Defined results: null or empty text (no words) gets no votes and is rejected
with score 0; very long texts are read whole; equal texts get equal scores,
repeated rows too; an empty table gives no rows; further columns stay in
``accepted_documents`` and are ignored by ``quality_table``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.wordhash import WordHasher, mix, powers, runs, utf8_parts, word_spans

#: Bound of the training sample (expected number of rows).
SAMPLE = 6_000
BITS = 14
ACCEPT = 0.5
#: Words added to every document's length, so that a few odd words alone say little.
SHRINK = 3
#: (labeller, measure, good at or below, bad at or above), measures per word or letter
# fixed values
LABELLERS = (
    ("symbols", "symbols", 0.02, 0.15),
    ("marks", "marks", 0.35, 1.2),
    ("shouting", "capitals", 0.25, 0.6),
    ("exclaiming", "exclaims", 0.02, 0.25),
    ("barred", "bars", 0.005, 0.2),
    ("loose marks", "loose", 0.03, 0.2),
    ("stuttering", "echoes", 0.06, 0.25),
    ("repeating", "repeats", 0.4, 0.65),
    ("running on", "run_on", 0.5, 0.9),
)


def _classes() -> np.ndarray:
    """Byte classes: 0 space, 1 capital, 2 other letter, 3 digit, else the byte."""
    table = np.arange(256, dtype=np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    table[0x41:0x5B], table[0x61:0x7B], table[0x80:], table[0x30:0x3A] = 1, 2, 2, 3
    return table


class Reader:
    """Measures and hashed features of documents, a run of texts at a time."""

    def __init__(self) -> None:
        self.hasher, self.classes = WordHasher(fold=True), _classes()
        self.space = self.hasher.space

    def measure(self, column: pa.Array) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
        """(measures, features of all words, word offsets) of runs of rows."""
        raw_all, offsets_all = utf8_parts(column)
        words_of = self.hasher.words(column)
        for (a, b), (_, _, words, firsts) in zip(runs(offsets_all), words_of, strict=True):
            raw, offsets = raw_all[offsets_all[a] : offsets_all[b]], offsets_all[a : b + 1] - offsets_all[a]
            kinds = self.classes[raw]
            count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])  # noqa: B023, E731
            n_words = np.diff(firsts)
            some = np.maximum(n_words, 1)
            rows = np.repeat(np.arange(b - a), n_words)
            starts, ends, _ = word_spans(raw, offsets, self.space)
            symbol = np.isin(raw, np.frombuffer(b"#*$%&<>", np.uint8))
            capitals, letters = count(kinds == 1), count((kinds == 1) | (kinds == 2))
            echo = np.zeros(len(words), dtype=bool)
            echo[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
            shape = self.shapes(kinds, starts, ends)
            order = np.lexsort((words, rows))
            new = np.ones(len(words), dtype=bool)
            new[1:] = (words[order][1:] != words[order][:-1]) | (rows[order][1:] != rows[order][:-1])
            distinct = np.bincount(rows[order][new], minlength=b - a)
            per = lambda x: np.bincount(rows, weights=x, minlength=b - a)  # noqa: B023, E731
            # distinct words are measured against what a text of that length has
            expected = np.minimum(some, 4 * np.sqrt(some))
            yield (
                {
                    "n_words": n_words,
                    "symbols": count(symbol) / some,
                    "marks": count((kinds > 3)) / some,
                    "capitals": capitals / np.maximum(letters, 1),
                    "exclaims": count(raw == ord("!")) / some,
                    "bars": count(raw == ord("|")) / some,
                    "loose": per((ends - starts == 1) & (kinds[starts] > 3)) / some,
                    "echoes": per(echo) / some,
                    "repeats": 1 - np.minimum(distinct / expected, 1),
                    "run_on": 1 - np.minimum(count(np.isin(raw, np.frombuffer(b".?!", np.uint8))) * 20 / some, 1),
                },
                self.features(shape, words, echo, rows),
                firsts,
            )

    def shapes(self, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each word's byte classes, runs of one class taken once."""
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        keep = kinds > 0
        keep[1:] &= kinds[1:] != kinds[:-1]
        keep[starts] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        kept = kinds[keep].astype(np.uint64) + np.uint64(1)
        base = 0x9E3779B97F4A7C15 | 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kept * powers(max(len(kept), 1), base)[: len(kept)], dtype=np.uint64)])
        down = powers(len(kept) + 1, pow(base, -1, 1 << 64))
        return mix((total[at[ends]] - total[at[starts]]) * down[at[starts]])

    def features(self, shape: np.ndarray, words: np.ndarray, echo: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Three hashed features of each word: shape with echo, shape pair, the word itself."""
        top = np.uint64(64 - BITS)
        pair = shape.copy()
        inside = rows[1:] == rows[:-1]
        pair[1:][inside] = mix(shape[1:] + shape[:-1] * np.uint64(31))[inside]
        kinds = (mix(shape + echo.astype(np.uint64)), mix(pair ^ np.uint64(0x51ED270B)), mix(words ^ np.uint64(0x2545F491)))
        return tuple((x >> top).astype(np.int64) for x in kinds)


def votes_of(measures: dict) -> np.ndarray:
    """A pattern number: per labeller 0 no vote, 1 good, 2 bad, in base 3."""
    pattern = np.zeros(len(measures["n_words"]), dtype=np.int64)
    for _, name, good, bad in LABELLERS:
        x = measures[name]
        vote = np.where(x >= bad, 2, np.where(x <= good, 1, 0))
        if name in ("repeats", "run_on"):
            vote = np.where(measures["n_words"] < 20, 0, vote)
        pattern = pattern * 3 + np.where(measures["n_words"] > 0, vote, 0)
    return pattern


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over pattern counts: (posterior of good per pattern, P(vote | class), prior of good).

    Class 0 is good, 1 bad.  The start says what a labeller is for: it votes
    good on most good documents and bad on some bad ones.  Not voting is no
    evidence for either class.
    """
    m = len(LABELLERS)
    votes = np.stack([patterns // 3 ** (m - 1 - j) % 3 for j in range(m)])
    rates = np.empty((2, m, 3))
    rates[0], rates[1] = [1, 0.98, 0.02], [1, 0.7, 0.3]
    prior = 0.8
    posterior = np.full(len(patterns), prior)
    for _ in range(rounds):
        logs = [np.log(p) + sum(np.log(rates[c, j, votes[j]]) for j in range(m)) for c, p in ((0, prior), (1, 1 - prior))]
        before, posterior = posterior, 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        if not counts.sum():
            break
        for c, weight in ((0, counts * posterior), (1, counts * (1 - posterior))):
            for j in range(m):
                seen = np.bincount(votes[j], weights=weight, minlength=3)[1:] + 0.5
                rates[c, j, 1:] = seen / seen.sum()
        prior = float(np.clip((counts * posterior).sum() / counts.sum(), 0.02, 0.98))
        if np.abs(posterior - before).max() < 1e-9:
            break
    return posterior, rates, prior


def vote_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all vote patterns in ``docs``; their number is bounded by the labellers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(), np.zeros(3 ** len(LABELLERS), dtype=np.int64)
        for batch in batches:
            for measures, _, _ in reader.measure(batch.column("text")):
                total += np.bincount(votes_of(measures)[measures["n_words"] > 0], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["pattern", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    rows.sort()
    return np.array([r.pattern for r in rows], dtype=np.int64), np.array([r.n for r in rows], dtype=np.float64)


def fit_scorer(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels; weights by feature, the bias last."""
    weights = np.zeros((1 << BITS) + 1)
    if not features:
        return weights
    lengths = np.array([len(f) for f, _ in features])
    columns, values = (np.concatenate(x) for x in zip(*features, strict=True))
    rows = np.repeat(np.arange(len(features)), lengths)
    # both classes weigh the same, so a rare kind of junk is not outvoted
    good = np.clip(labels.sum(), 1, None)
    bad = np.clip((1 - labels).sum(), 1, None)
    importance = len(labels) * (labels / good + (1 - labels) / bad) / 2
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, weights=weights[columns] * values, minlength=len(labels)) + weights[-1]
        error = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        slope = np.bincount(columns, weights=error[rows] * values, minlength=len(weights)) + 1e-6 * weights
        slope[-1] = error.sum()
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        weights -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return weights


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 7) -> tuple[dict[int, float], np.ndarray]:
    """(posterior of good by pattern, scorer's weights)."""
    patterns, counts = vote_counts(docs)
    posterior, _, _ = fit_labellers(patterns, counts)
    share = min(1.0, sample / max(counts.sum(), 1))
    known = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))

    def feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            columns, values, pattern = [], [], []
            for measures, kinds, firsts in reader.measure(batch.column("text")):
                votes = votes_of(measures)
                for i in np.flatnonzero(measures["n_words"]):
                    all_kinds = np.concatenate([k[firsts[i] : firsts[i + 1]] for k in kinds])
                    seen, n = np.unique(all_kinds, return_counts=True)
                    columns.append(seen.astype(np.int32))
                    values.append((n / (measures["n_words"][i] + SHRINK)).astype(np.float32))
                    pattern.append(int(votes[i]))
            arrays = [pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(pattern, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["columns", "values", "pattern"])

    # copies are drawn one by one and equal rows once, so no group of them can swell the sample
    hashed = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("drawn_by"))
    drawn = hashed.filter(F.pmod("drawn_by", F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["drawn_by"]).select("text")
    got = sorted(drawn.mapInArrow(feature, "columns array<int>, values array<float>, pattern long").collect())
    features = [(np.array(r["columns"], dtype=np.int64), np.array(r["values"], dtype=np.float64)) for r in got]
    return known, fit_scorer(features, np.array([known[r["pattern"]] for r in got]))


def _scored(batch: pa.RecordBatch, reader: Reader, known: dict, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    parts = []
    for measures, kinds, _ in reader.measure(batch.column("text")):
        n = measures["n_words"]
        gained = sum(weights[k] for k in kinds) if len(kinds[0]) else np.zeros(0)
        # summed row by row, so that a text's score does not depend on its neighbours
        z = np.bincount(np.repeat(np.arange(len(n)), n), weights=gained, minlength=len(n)) / (n + SHRINK) + weights[-1]
        votes = votes_of(measures)
        label = np.array([known.get(v, np.nan) for v in votes.tolist()])
        parts.append((n, votes, np.where(n > 0, label, 0.0), np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0),) * 4


def quality_table(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Each document's weak label (posterior of good), its score, and whether it is accepted."""
    known, weights = train(docs, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            n, votes, label, scores = _scored(batch, reader, known, weights)
            names = ["doc_id", "n_words", "pattern", "weak_label", "score", "accepted"]
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(votes, pa.int64()), pa.array(np.round(label, 6), pa.float64()), pa.array(np.round(scores, 6), pa.float64()), pa.array(scores >= ACCEPT, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(score, "doc_id long, n_words long, pattern long, weak_label double, score double, accepted boolean")


def accepted_documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier accepts, columns as they are."""
    known, weights = train(docs, sample)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch, reader, known, weights)[3] >= ACCEPT))

    return docs.mapInArrow(keep, docs.schema)
