import unicodedata
from collections import defaultdict

from lodestar.plans import queries as engine



def folded(word):
    return "".join(c for c in unicodedata.normalize("NFKD", word.upper()) if not unicodedata.combining(c))


def test_variants_of_every_language_are_found(spark, tmp_path):
    made = [(1, "Café naïve\nresume", "en"), (2, "cafe Straße résumé", "de"), (3, "STRASSE número", "es"), (4, "numero naive été", "fr"), (5, "ÉTÉ alone", None), (6, None, "en"), (7, "", "de")]
    spark.createDataFrame(made, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    groups = defaultdict(set)
    for _, text, _ in made:
        for word in (text or "").replace("\n", " ").split(" "):
            groups[" ".join(folded(word).split())].add(word)
    want = {k: len(v) for k, v in groups.items() if len(v) > 1}
    assert {"CAFE", "STRASSE", "RESUME", "NAIVE"} <= set(want)
    got = engine.QUERIES["accent_variants_all"](spark, str(tmp_path))
    assert {r.key: r.spellings for r in got.collect()} == want
