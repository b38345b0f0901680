import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import chat, licenses, lines, quality, rules
from tests.llm.cases import documents, empty, prose, rows


def python_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    fives = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if fives[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    worded = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(worded) - len(set(worded)), len(covered), failed


def test_rules_base_counts(spark):
    got = rules.rule_table(documents(spark)).collect()
    want = sorted((str(i), *python_rules(t)) for i, t, *_ in rows())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    kept = {r.doc_id for r in got if r.kept}
    assert {5, 7, 8, 10, 11} <= kept and not kept & {0, 1, 2, 3, 4, 14, 18, 19}
    assert rules.rule_table(empty(spark)).count() == 0


def test_rules_lines(spark):
    text = "\n".join([prose(1, 30), "Home | News | Shop | Contact", "All rights reserved.", "SHOUTING LINE OF TEXT!!", prose(2, 30)])
    df = spark.createDataFrame([(1, text, 9)], "doc_id long, text string, n_words int")
    out = rules.apply_rules(df).first()
    assert out.text == prose(1, 30) + "\n" + prose(2, 30) and out.n_words == 9


def test_line_dedup_counts_sites(spark):
    boiler, local = "Shared footer everywhere.", "A line of one site."
    made = [(i, f"{prose(i, 20)}\n{boiler} \n{local if i % 12 == 0 else prose(900 + i, 5)}", f"s{i % 12}", 1) for i in range(60)]
    made += [(100, boiler, "s0", 1), (101, None, "s1", 1), (102, "", None, 1)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string, line int")
    got = {r.doc_id: r for r in lines.remove_boilerplate(df.withColumn("n_lines", F.lit("mine"))).collect()}
    table = {r.doc_id: r for r in lines.line_table(df).collect()}
    assert boiler not in got[3].text and local in got[12].text and table[3].n_removed == 1 and got[3].n_lines == "mine"
    # a document of nothing else is a copy, not a page with a footer
    assert got[100].text == boiler and got[101].text is None and got[102].text == ""
    assert got[3].line == 1
    out = lines.line_table(documents(spark))
    assert out.count() == len(rows()) and lines.line_table(empty(spark)).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    made = [(str(k), f"s{s}") for k in range(30) for s in range(k)]
    frame = spark.createDataFrame(made, "line string, site string").select(F.xxhash64("line").alias("line"), "site")
    got = {r.line for r in lines.boilerplate_lines(frame, 10).collect()}
    want = {r.h for r in spark.createDataFrame([(str(k),) for k in range(10, 30)], "line string").select(F.xxhash64("line").alias("h")).collect()}
    assert got == want


def test_perspectives(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|end|>"), (1, 2, "bob", "Hello"), (1, 2, "bob", "Hello"), (1, None, None, None), (1, 300, "ann", "Late"), (None, 1, "ann", "x")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, speaker string")
    got = {(r.conv_id, r.part, r.speaker): r for r in chat.rotate_perspectives(df, turns_per_part=4).collect()}
    assert set(got) == {(1, p, s) for p in (0, 1) for s in ("ann", "bob", "unknown")} | {(None, 0, "ann")}
    r = got[1, 0, "bob"]
    assert r.rendered == "<|user:unknown|>\n<|end|>\n<|system|>\nBe kind.<|end|>\n<|user:ann|>\nHi < |end|><|end|>\n<|assistant|>\nHello<|end|>\n"
    start, length = map(int, r.mask.split("+"))
    assert r.rendered[start : start + length] == "Hello<|end|>\n" and r.masked_chars == length
    assert got[1, 1, "bob"].mask == "" and got[1, 1, "ann"].n_own_turns == 1
    assert chat.rotate_perspectives(df.filter("false")).count() == 0


def test_parts_of_a_long_dialogue_join_to_the_whole(spark):
    # one dialogue with most rows, many of them without a turn or with the same one
    turns = [(1, None if i % 3 == 0 else i // 40, "system" if i == 7 else f"speaker{i % 3}", f"text {i} " * (i % 4)) for i in range(900)] + [(2, 1, "ann", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)
    whole = {(r.conv_id, r.speaker): r for r in chat.rotate_perspectives(df, turns_per_part=10**6).collect()}
    parts = sorted(chat.rotate_perspectives(df, turns_per_part=64).collect(), key=lambda r: (r.conv_id, r.speaker, r.part))
    for (conv, speaker), one in whole.items():
        mine = [r for r in parts if (r.conv_id, r.speaker) == (conv, speaker)]
        assert [r.part for r in mine] == list(range(len(mine))) and all(r.n_turns == 64 for r in mine[:-1])
        assert "".join(r.rendered for r in mine) == one.rendered and one.part_offset == 0
        at = 0
        for r in mine:
            assert r.part_offset == at
            at += len(r.rendered)
        assert ",".join(r.mask for r in mine if r.mask) == one.mask
        spans = [tuple(map(int, s.split("+"))) for s in one.mask.split(",")]
        assert all(one.rendered[a - 14 : a] == "<|assistant|>\n" and one.rendered[a : a + n].endswith("<|end|>\n") for a, n in spans)
    assert len([r for r in parts if r.conv_id == 1 and r.speaker == "speaker0"]) > 1


def test_scattered_template_words_are_no_license(spark):
    words = dict((i, w) for i, _, w in licenses.template_words())[6]
    filled = " ".join(x for i in range(0, len(words), 3) for x in [*words[i : i + 3], "foo", "bar", "baz"])
    short = "all rights reserved " * 5
    near = " ".join([*words[:9], "extra", *words[9:]])
    upper = "İ MIT LİCENSE mit license"
    df = spark.createDataFrame([(1, filled), (2, " ".join(words)), (3, near), (4, short), (5, upper)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_table(df).collect()}
    assert got[1].labels == "" and got[1].score < 0.75 and got[2].labels == "bsd" and got[2].score == 1 and got[3].labels == "bsd" and got[4].labels == "reserved"
    assert (got[5].n_base, got[5].n_words) == (1, 5)


def test_native_operators_run_without_python(spark):
    turns = spark.createDataFrame([(1, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    for df in (chat.rotate_perspectives(turns), rules.rule_table(documents(spark)), rules.apply_rules(documents(spark)), licenses.license_table(documents(spark))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_license_places_and_labels(spark):
    got = {r.doc_id: r for r in licenses.license_table(documents(spark)).collect()}
    assert (got[17].n_base, got[17].first_word, got[17].last_word, got[17].base_labels) == (3, 0, 8, "gpl,mit")
    assert got[16].labels == "mit" and got[16].score == 1.0
    assert got[0].n_words == 0 and got[0].labels == "" and got[0].score == 0.0 and got[0].first_word is None
    assert licenses.license_table(documents(spark)).count() == len(rows())
    assert licenses.license_table(empty(spark)).count() == 0


def test_license_spans_survive_edits(spark):
    words = next(w for _, label, w in licenses.template_words() if label == "bsd")
    edited = words[:8] + ["truly"] + words[8:14] + words[15:]
    df = spark.createDataFrame([(1, prose(1, 50) + " " + " ".join(edited) + " " + prose(2, 50)), (2, " ".join(words[:7]))], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_table(df).collect()}
    assert got[1].labels == "bsd" and 0.75 <= got[1].score < 1 and got[2].labels == ""


def test_em_recovers_labellers():
    rng = np.random.default_rng(0)
    m = len(quality.LABELLERS)
    good = rng.random(20000) < 0.85
    patterns = np.zeros(20000, dtype=np.int64)
    for j in range(m):
        bad_vote = np.where(good, rng.random(20000) < 0.01, rng.random(20000) < 0.4)
        silent = rng.random(20000) < 0.05
        patterns = patterns * 3 + np.where(silent, 0, np.where(bad_vote, 2, 1))
    seen, counts = np.unique(patterns, return_counts=True)
    posterior, rates, prior = quality.fit_labellers(seen, counts.astype(float))
    assert abs(prior - good.mean()) < 0.02
    assert np.abs(rates[1, :, 2] - 0.4).max() < 0.05
    assert ((posterior[np.searchsorted(seen, patterns)] > 0.5) == good).mean() > 0.97


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    table = quality.quality_table(spark.read.parquet(f"{sf}/documents.parquet"))
    joined = table.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right = joined.filter("accepted = (quality = 1)").count() / joined.count()
    assert right > 0.97


def test_classifier_edges(spark):
    got = {r.doc_id: r for r in quality.quality_table(documents(spark)).collect()}
    assert got[0].score == 0 and not got[1].accepted and not got[2].accepted
    assert got[5].accepted and not got[18].accepted
    assert got[5].score == got[6].score
    kept = quality.accepted_documents(documents(spark))
    assert kept.columns == documents(spark).columns and kept.count() > 0
    assert quality.quality_table(empty(spark)).count() == 0


NOTICES = {
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0", "cc-by": "Licensed under CC BY 4.0", "cc-by-nc": "Licensed under CC BY-NC 4.0",
}


def test_similar_notices_keep_their_own_label(spark):
    base = {"agpl": {"gpl"}, "lgpl": set()}  # what the contract's phrases add
    cases = [(label, text) for label, text in NOTICES.items()] + [(f"{a}+{b}", f"{NOTICES[a]} Some words between the two of them here. {NOTICES[b]}") for a in NOTICES for b in NOTICES if a < b]
    made = spark.createDataFrame([(i, prose(i, 40) + " " + text + " " + prose(i + 500, 40)) for i, (_, text) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_table(made).collect()}
    for i, (names, _) in enumerate(cases):
        want = {x for n in names.split("+") for x in {n, *base.get(n, set())}}
        phrases = set(filter(None, got[i]["base_labels"].split(",")))
        assert set(got[i]["labels"].split(",")) == want | phrases, (names, got[i])
        assert got[i]["score"] == 1.0
