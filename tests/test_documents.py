import re

from pyspark.sql import functions as F

from lodestar.operators import chunks, versions
from lodestar.plans import documents as D, reports
from lodestar.schemas import PAGE, PARAGRAPH


def pages(spark, *texts, document="doc"):
    return spark.createDataFrame([(document, i, t, len(t)) for i, t in enumerate(texts, 1)], PAGE)


def paragraphs(spark, *rows):
    return spark.createDataFrame([("law", page, i, text) for i, (page, text) in enumerate(rows)], PARAGRAPH)


def texts(df):
    return [r.text for r in df.orderBy("page", "pos").collect()]


def test_paragraphs_of_both_kinds(spark):
    blank = pages(spark, "uno\ndos\n\n\ntres-\ncuatro\n(*) Nota\nsigue")
    assert texts(chunks.paragraphs(blank)) == ["uno dos", "tres-cuatro", "(*) Nota sigue"]
    tight = pages(spark, "Una frase que\nsigue aquí.\nOtra frase\na) literal\nArtículo 5. Texto\ncon minúscula.\nno parte")
    assert texts(chunks.paragraphs(tight, blank_lines=False)) == ["Una frase que sigue aquí.", "Otra frase", "a) literal", "Artículo 5. Texto con minúscula. no parte"]


def test_noise_is_removed_and_counted(spark):
    page = "34\nNORMAS LEGALES\nJueves 8 de enero de 2026\nEl Peruano /\nTexto ofi cial caliﬁ cado.\nFirmado por: Editora Peru\nFecha: 08/01/2026 04:30\n1234567-1\nfin"
    row = D.noise_out(pages(spark, page)).first()
    assert re.sub(r"\s+", " ", row.text).strip() == "Texto ofi cial calificado. fin"
    assert row.hits.asDict() == {"header": 1, "signature": 1, "publication_code": 1, "ligatures": 1}
    assert D.rule_counts(D.noise_out(pages(spark, page, page))).first().ligatures == 2


CHANGE = "por el Artículo 3 del Decreto Legislativo N° 1, publicada el 04 febrero 2026"


def test_modified_text_replaces_the_old(spark):
    df = paragraphs(spark, (1, "a) queda"), (1, "b) viejo uno"), (1, "sigue viejo (*)"), (2, f'(*) Literal modificado {CHANGE}, cuyo texto es el siguiente: "b) nuevo'), (2, 'y más"'), (2, "c) queda"))
    assert texts(versions.in_force(df)) == ["a) queda", '[Texto vigente — Literal modificado por el Artículo 3 del Decreto Legislativo N° 1, publicada el 04 febrero 2026] "b) nuevo\ny más"', "c) queda"]
    entry = versions.register(df).first()
    assert (entry.label, entry.old_pages, entry.state, entry.old_text) == ("b)", [1], "old text removed", "b) viejo uno sigue viejo (*)")


def test_other_notes(spark):
    df = paragraphs(
        spark, (1, "1. derogado (*)"), (1, f"(*) Numeral derogado {CHANGE}"), (1, "2. agregado (*)"), (1, f"(*) Numeral incorporado {CHANGE}"), (1, "(*) De conformidad con la ley, rige."),
        (2, "un eror (*) NOTA SPIJ aquí"), (2, '(*) NOTA SPIJ: dice: "eror", debiendo decir: "error"'), (2, "(*) algo raro"), (2, f'(*) Literal sustituido {CHANGE}, cuyo texto es el siguiente: "z) nuevo"'),
    )
    got = texts(versions.in_force(df))
    assert got[0].startswith("[Numeral 1 derogado por") and got[1] == "2. agregado" and got[2].startswith("[Numeral incorporado por")
    assert got[3] == "[Nota de vigencia] De conformidad con la ley, rige." and got[4] == "un error aquí" and got[5] == "algo raro"
    states = {r.action: r.state for r in versions.register(df).collect()}
    assert states["not recognised"] == "to review" and states["Literal sustituido"] == "old text not found"
    assert reports.note_counts(versions.register(df)).count() == 6


def test_note_across_pages_moves_on(spark):
    df = paragraphs(spark, (1, "(*) Literal modificado por el Artículo 3"), (2, 'del D.L. N° 1, publicada el 04 febrero 2026, cuyo texto es el siguiente: "q) nuevo"'))
    rows = versions.in_force(df).collect()
    assert [r.page for r in rows] == [2] and "q) nuevo" in rows[0].text


def test_chunks_pack_paragraphs_with_overlap(spark):
    text = "\n\n".join(["a" * 40, "b b b b b b b b b b", "palabra " * 20])
    got = [r.text for r in chunks.chunked(pages(spark, text), 60, 10).orderBy("n").collect()]
    assert got[0] == "a" * 40 and got[1].startswith("aaaaaaaaaa b b") and all(len(x) <= 60 + 12 for x in got)
    assert "".join(got).count("palabra") >= 20
    assert chunks.chunked(pages(spark, "", "  \n\n "), 60, 10).count() == 0


def test_metadata_and_carried_article(spark):
    catalogue = spark.createDataFrame([("doc", "Ley", "ley", "v1", "2026", None)], "document string, title string, kind string, version string, version_date string, amends string")
    df = pages(spark, "Artículo 1. Uno\n\nmás", "sigue el uno", "PRIMERA. Disp\n\n[Texto vigente — Literal modificado por X, publicada el 1 mayo 2026] z")
    rows = {r.id: r for r in D.chunk_documents(df, catalogue).collect()}
    assert [rows[f"doc:p{p}:c0"].metadata.article for p in (1, 2, 3)] == ["Artículo 1", "Artículo 1", "Disposición PRIMERA"]
    m = rows["doc:p3:c0"].metadata
    assert (m.amended_by, m.amended_on, m.amends, len(m.hash)) == ("X", "1 mayo 2026", "", 12)


def test_whole_documents(spark):
    law = pages(spark, f'1. viejo (*)\n\n(*) Numeral modificado {CHANGE}, cuyo texto es el siguiente: "1. nuevo"\n\nCONCORDANCIAS: otra', document="law")
    plain = pages(spark, "Frase una.\nFrase dos.", document="plain")
    clean, notes = D.clean_documents(law.union(plain), ["law"])
    got = {r.document: r.text for r in clean.collect()}
    assert got["plain"] == "Frase una.\n\nFrase dos." and "viejo" not in got["law"] and "CONCORDANCIAS" not in got["law"]
    assert notes.count() == 1
    report = {r.document: r for r in reports.page_report(law.union(plain), clean).collect()}
    assert report["law"].pages_dropped == 0


def test_markers_trim_neighbours(spark):
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["otro", "DECRETO 1", "texto", "DECRETO 2", "más"])], "d string, i int, t string")
    assert [r.t for r in chunks.trimmed_to_markers(lines, "d", "i", "t", "^DECRETO 1", "^DECRETO").orderBy("i").collect()] == ["DECRETO 1", "texto"]


def test_exclusive_decile(spark):
    import statistics

    values = [3, 8, 1, 9, 4, 7, 2, 6, 5, 12, 30]
    df = spark.createDataFrame([("c", "x" * v) for v in values], "c string, text string")
    assert reports.length_p90_exclusive(df, "c").first().p90_exclusive == statistics.quantiles(values, n=10)[8]
