from lodestar.llm import lines
from tests.llm.cases import prose

BLANKS = " \t\r"


def brute(made):
    sites = {}
    for _, text, source, *_ in made:
        for line in (text or "").split("\n"):
            sites.setdefault(line.strip(BLANKS), set()).add(source)
    bad = {k for k, v in sites.items() if k and len(v) >= 10}
    out = {}
    for i, text, *_ in made:
        kept = [x for x in (text or "").split("\n") if x.strip(BLANKS) not in bad]
        cut = any(x.strip(BLANKS) for x in kept)
        out[i] = ("\n".join(kept) if cut else text, len(text.split("\n")) - len(kept) if cut else 0)
    return out


def test_a_null_source_is_a_site_of_its_own(spark):
    foot = "Shared footer line of all the sites here."
    made = [(i, f"{prose(i, 9)}\n{foot}", s) for i, s in enumerate([None, "", *(f"s{k}" for k in range(8))])]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    assert {r.n_removed for r in lines.line_table(df).collect()} == {1}
    assert {r.n_removed for r in lines.line_table(df.filter("source is not null")).collect()} == {0}


def test_short_pages_lose_their_furniture(spark):
    top, foot = "Shared top line of all the sites here.", "Shared footer line of all the sites here."
    made = [(i, f"{top}\n{prose(i, 3)}\n{foot}", f"s{i % 12}") for i in range(24)]  # furniture holds most of the page
    made += [(100, f"{top}\n{foot}", "s0"), (101, f"{top}\n \t\n{foot}", "s1"), (102, f"{top}\n\n.", None), (103, prose(7, 9), "s2")]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    want = brute(made)
    assert want[3] == (prose(3, 3), 2) and want[100] == (made[24][1], 0) and want[102][1] == 1
    assert {r.doc_id: (r.text, r.n_removed) for r in lines.line_table(df).collect()} == want
    assert {r.doc_id: r.text for r in lines.remove_boilerplate(df).collect()} == {i: t for i, (t, _) in want.items()}
