import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from lodestar.llm import mixing
from lodestar.llm.packing import pack_documents
from tests.llm.cases import documents, empty, rows, texts


def test_pieces_cover_every_document_once(spark):
    got = pack_documents(documents(spark)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, x in enumerate(texts())}
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # nothing to pad
    for i, mine in pieces.items():
        if i is None:
            continue
        copies = 2 if i == 5 else 1
        assert sum(r.length for r in mine) == copies * len(ids[i])
        for r in mine:
            assert r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(ids[i][r.start : r.start + r.length].tobytes())
    assert len(pieces[None]) >= 2
    assert pack_documents(empty(spark)).count() == 0


def test_step_groups_are_balanced(spark):
    got = pack_documents(documents(spark).coalesce(1))
    totals = [r[0] for r in got.select("step_id", "sequence_id", "window").distinct().groupBy("step_id").sum("window").select("sum(window)").collect()]
    assert max(totals) == 8192 and sum(t < 8192 for t in totals) <= 2


def test_mix_meets_targets(spark):
    df = documents(spark)
    got = mixing.mix_table(df).collect()
    assert len(got) == len(rows())
    groups = defaultdict(list)
    for (doc_id, text, _, source, *_), _n in zip(rows(), range(99), strict=False):
        groups[(source is None, source or "")].append(len((text or "").split()))
    order = sorted(groups)
    targets = mixing.water_fill([sum(groups[k]) for k in order], [i % 3 + 1 for i in range(len(order))], 3)
    by = defaultdict(list)
    for r in got:
        by[r.source_size, round(r.target, 6)].append(r)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for k, t in zip(order, targets, strict=True):
        mine = by[sum(groups[k]), round(float(t), 6)]
        assert len(mine) == len(groups[k])
        size, sums = sum(groups[k]), {0}
        for n in groups[k]:
            sums |= {s + n for s in sums}
        whole = size * min(3, int(t // size)) if size else 0
        nearest = min(abs(whole + s - t) for s in sums)
        assert abs(sum(r.taken for r in mine) - t) <= nearest + 1
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, mixing.mix_table(df).collect())) == sorted(map(key, got))
    assert mixing.mix_table(empty(spark)).count() == 0


def test_apply_keeps_columns(spark):
    df = documents(spark)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) > 0
    assert mixing.apply_mix(empty(spark)).count() == 0


def test_water_fill_by_hand():
    assert mixing.water_fill([10, 90], [1, 1], 3) == [30, 70]
    assert mixing.water_fill([50, 50], [1, 3], 3) == [25, 75]
    assert mixing.water_fill([0, 6], [1, 1], 3) == [Fraction(0), 6]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), min_size=1, max_size=12), st.floats(0, 1))
def test_fit_is_near(counts, share):
    lengths, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)])
    budget = int(share * (lengths * n).sum())
    take = mixing.fit_budget(lengths, n, budget)
    assert (take >= 0).all() and (take <= n).all()
    got = int((lengths * take).sum())
    assert abs(got - budget) <= lengths.max() / 2 + 1 or lengths.max() > mixing.OVER


def reachable(lengths, counts):
    sums = {0}
    for length, n in zip(lengths, counts):
        sums = {s + k * length for s in sums for k in range(n + 1)}
    return sums


def test_budgets_beyond_the_table_are_met_exactly_by_few_documents():
    r = random.Random(8)
    cases = [([180_000, 300_000], [3, 3], 540_000), ([150_000, 220_000], [4, 4], 450_000), ([131_073], [2], 200_000)]
    for _ in range(40):
        lengths = sorted(r.sample(range(1_000, 400_000), r.randint(1, 6)))
        counts = [r.randint(1, 4) for _ in lengths]
        cases.append((lengths, counts, r.randint(131_073, sum(a * b for a, b in zip(lengths, counts)) + 1 if sum(a * b for a, b in zip(lengths, counts)) > 131_073 else 131_074)))
    for lengths, counts, budget in cases:
        take = mixing.fit_budget(np.array(lengths), np.array(counts), budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        got = sum(int(t) * n for t, n in zip(take, lengths))
        assert abs(got - budget) == min(abs(s - budget) for s in reachable(lengths, counts)), (lengths, counts, budget, got)


def test_steps_in_common_are_exact_and_many_documents_near():
    assert mixing.fit_budget(np.array([40_000, 60_000]), np.array([500, 500]), 10_020_000).tolist() and abs(int((mixing.fit_budget(np.array([40_000, 60_000]), np.array([500, 500]), 10_020_000) * np.array([40_000, 60_000])).sum()) - 10_020_000) == 0
    lengths = np.arange(50, 900)
    take = mixing.fit_budget(lengths, np.full(850, 40), 7_654_321)
    assert int((take * lengths).sum()) == 7_654_321
