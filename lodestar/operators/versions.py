r"""Version notes of consolidated laws: which text is in force, and a register of the changes.

A note stands after the text it speaks of, and that text ends with a mark.
Everything a note needs is found by windows over a document's paragraphs and
by equi-joins on paragraph numbers:

* the text marked last in the ``look_back`` paragraphs before the note;
* the stretch that the note's new text takes up, to its closing quotation mark;
* the stretch that the old text takes up, from the paragraph with the new
  text's label to the marked one.

``resolved`` gives both results at once: the text that stays of every
paragraph, and what the register says of it.  Corrections of errata hold for
all paragraphs of the document, whatever stands in the other notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.schemas import PARAGRAPH, VERSION_NOTE, fields, names

#: How many paragraphs back a note's old text may begin.
LOOK_BACK = 15
# fixed values: how the source words its notes
MARK = "(*)"
CHANGE = (
    r"(?s)^\(\*\)\s*(Literal|Numeral(?:\s+\d+)?|Disposición|Artículo|Párrafo)\s+"
    r"(modificad[oa]|incorporad[oa]|derogad[oa]|sustituid[oa])\s+por\s+(.+?),\s*publicad[oa]\s+el\s+(\d{1,2}\s+(?U:\w+)\s+\d{4})"
)
VALIDITY = r"^\(\*\)\s*De conformidad con"
ERRATUM = r"(?s)^\(\*\)\s*NOTA SPIJ.*?dice:\s*[“\"](.+?)[”\"],\s*debiendo decir:\s*[“\"](.+?)[”\"]"
NEW_TEXT = r"(?iu)cuyo texto es el siguiente:\s*"
LABEL = r"^\s*[“\"]?\s*([a-zñ]\)|\d+(?:\.\d+)*\.?|[A-ZÁÉÍÓÚÑ]+(?:\s+[A-ZÁÉÍÓÚÑ]+)?\.)"
CLOSED = r"[”\"]\s*$"


def label_of(text: Column) -> Column:
    """The label a unit starts with (``e)``, ``41.1``, ``PRIMERA``), or nothing."""
    return F.regexp_replace(F.regexp_extract(text, LABEL, 1), r"\.$", "")


def note_kind(text: Column) -> Column:
    """erratum, validity, change or unknown; empty if the paragraph is no note."""
    known = F.when(text.rlike(ERRATUM), "erratum").when(text.rlike(VALIDITY), "validity").when(text.rlike(CHANGE), "change")
    return F.when(text.startswith(MARK), known.otherwise("unknown")).otherwise("")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _numbered(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs by number; a note cut by the end of its page goes to the page where it goes on."""
    reading = W.partitionBy("document").orderBy("page", "pos")
    cut = (note_kind(F.col("text")) == "unknown") & (F.lead("page").over(reading) != F.col("page")) & ~F.lead("text").over(reading).startswith(MARK)
    begun = paragraphs.withColumns({"at": F.row_number().over(reading), "cut": F.coalesce(cut, F.lit(False))})
    whole = F.when(F.lag("cut").over(reading), F.concat_ws(" ", F.lag("text").over(reading), "text")).otherwise(F.col("text"))
    return begun.withColumn("text", F.when(F.col("cut"), "").otherwise(whole)).drop("cut").withColumn("kind", note_kind(F.col("text")))


def _corrected(numbered: DataFrame) -> DataFrame:
    """All errata of a document applied to its other paragraphs, in reading order."""
    found = F.struct("at", F.regexp_extract("text", ERRATUM, 1).alias("wrong"), F.regexp_extract("text", ERRATUM, 2).alias("right"))
    errata = numbered.filter("kind = 'erratum'").groupBy("document").agg(F.sort_array(F.collect_list(found)).alias("errata"))

    def correct(text: Column, erratum: Column) -> Column:
        pattern = F.concat(F.lit(r"\Q"), erratum["wrong"], F.lit(r"\E(\s*\(\*\)\s*NOTA SPIJ)?"))
        return F.regexp_replace(text, pattern, F.regexp_replace(erratum["right"], r"([\\$])", r"\\$1"))

    both = numbered.join(errata, "document", "left")
    text = F.when((F.col("kind") == "erratum") | F.col("errata").isNull(), F.col("text")).otherwise(F.aggregate("errata", F.col("text"), correct))
    return both.withColumn("text", text).drop("errata")


def _changes(paragraphs: DataFrame, look_back: int) -> DataFrame:
    """Change notes with the stretches of paragraphs that their new and old texts take up."""
    reading = W.partitionBy("document").orderBy("at")
    behind = reading.rowsBetween(-look_back, -1)
    # what comes next, as what came last when read backwards
    ahead = W.partitionBy("document").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1)
    last = lambda condition, over: F.last(F.when(condition, F.col("at")), ignorenulls=True).over(over)
    looked = paragraphs.withColumns(
        {
            "marked": last(F.rtrim("text").endswith(MARK), behind),
            "closed": last(F.col("text").rlike(CLOSED), ahead),
            "next_note": last(F.col("text").startswith(MARK), ahead),
            "page_end": F.max("at").over(W.partitionBy("document", "page")),
        }
    )
    brought = F.when(F.col("text").rlike(NEW_TEXT), F.get(F.split("text", NEW_TEXT, 2), F.lit(1))).otherwise("")
    part = lambda i: F.regexp_extract("text", CHANGE, i)
    notes = looked.filter("kind = 'change'").select(
        "document", "page", F.col("at").alias("note"), "marked", part(1).alias("unit"), F.lower(part(2)).alias("action"), F.regexp_replace(part(3), r"\s+", " ").alias("norm"), part(4).alias("dated"), brought.alias("new"),
        F.least("closed", F.col("next_note") - 1, "page_end").alias("new_end"),
    )
    replaces = F.col("action").rlike("^(modificad|sustituid)")
    notes = notes.withColumns({"replaces": replaces, "new_end": F.when(replaces & ~F.col("new").rlike(CLOSED), F.col("new_end")).otherwise(F.col("note"))})
    at = lambda first, end: F.explode(F.when(first <= end, F.sequence(first, end)))
    row = F.struct("at", F.col("page").alias("on_page"), "text")
    rows = paragraphs.select("document", "at", row.alias("row"))

    def stretch(first: Column, end: Column, name: str) -> DataFrame:
        """The paragraphs ``first`` to ``end`` of every note, in one array."""
        wanted = notes.select("document", "note", at(first, end).alias("at"))
        return wanted.join(rows, ["document", "at"]).groupBy("document", "note").agg(F.sort_array(F.collect_list("row")).alias(name))

    after = stretch(F.col("note") + 1, F.col("new_end"), "after")
    before = stretch(F.greatest(F.lit(1), F.col("marked") - (look_back - 1)), F.col("marked"), "before")
    full = notes.join(after, ["document", "note"], "left").join(before, ["document", "note"], "left")
    none = F.expr("cast(array() as array<struct<at:int,on_page:int,text:string>>)")
    full = full.withColumns({"after": F.coalesce("after", none), "before": F.coalesce("before", none)})
    full = full.withColumn("new", _stripped(F.concat_ws("\n", F.array("new"), F.transform("after", lambda r: r["text"])))).withColumn("label", F.when(F.col("replaces"), label_of(F.col("new"))))
    first = F.array_max(F.transform(F.filter("before", lambda r: label_of(r["text"]) == F.col("label")), lambda r: r["at"]))
    full = full.withColumn("first", F.when(F.col("replaces") & (F.col("label") != ""), first).when(F.col("action").startswith("derogad"), F.col("marked")))
    return full.withColumn("old", F.filter("before", lambda r: r["at"] >= F.col("first")))


def _entered(notes: DataFrame) -> DataFrame:
    """(document, at, said, entry): what stands in a change note's place, and its line in the register."""
    texts = F.concat_ws(" ", F.transform("old", lambda r: r["text"]))
    source = F.concat(F.col("action"), F.lit(" por "), F.col("norm"), F.lit(", publicada el "), F.col("dated"), F.lit("]"))
    gone, added = F.col("action").startswith("derogad"), F.col("action").startswith("incorporad")
    label = F.when(gone, F.nullif(label_of(texts), F.lit("")))
    said = F.concat(F.when(F.col("replaces"), "[Texto vigente — ").otherwise("["), F.concat_ws(" ", "unit", label, source), F.when(F.col("replaces"), F.concat(F.lit(" "), "new")).otherwise(""))
    found = F.size("old") > 0
    state = F.when(added, "added text kept").when(gone, "repealed text removed").when(found, "old text removed").otherwise("old text not found")
    line = {
        "action": F.concat_ws(" ", "unit", "action"),
        "norm": F.col("norm"),
        "dated": F.col("dated"),
        "old_pages": F.when(F.col("replaces"), F.sort_array(F.array_distinct(F.transform("old", lambda r: r["on_page"])))),
        "label": F.col("label"),
        "state": state,
        "old_text": F.when(~added, F.substring(F.coalesce(texts, F.lit("")), 1, 300)),
        "new_text": F.when(F.col("replaces"), F.substring("new", 1, 300)),
    }
    return notes.select("document", F.col("note").alias("at"), said.alias("said"), _line(line).alias("entry"))


def _line(values: dict[str, Column]) -> Column:
    return F.struct(*(values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields(VERSION_NOTE) if n not in ("document", "pos", "page")))


def resolved(paragraphs: DataFrame, look_back: int = LOOK_BACK) -> DataFrame:
    """Every paragraph with the text that stays of it (null: none) and, for notes, its register ``entry``."""
    numbered = _corrected(_numbered(paragraphs))
    notes = _changes(numbered, look_back)
    taken = notes.select("document", F.explode(F.concat("old", "after")["at"]).alias("at")).distinct().withColumn("taken", F.lit(True))
    every = numbered.join(_entered(notes), ["document", "at"], "left").join(taken, ["document", "at"], "left")
    kind, text = F.col("kind"), F.col("text")
    notice = F.concat(F.lit("[Nota de vigencia] "), F.regexp_replace(text, r"^\(\*\)\s*", ""))
    stays = F.when(F.col("taken") | (kind == "erratum"), None).when(kind == "validity", notice).otherwise(F.coalesce("said", text))
    entry = (
        F.when(kind == "erratum", _line({"action": F.lit("erratum"), "old_text": F.regexp_extract(text, ERRATUM, 1), "new_text": F.regexp_extract(text, ERRATUM, 2)}))
        .when(kind == "validity", _line({"action": F.lit("validity notice"), "state": F.lit("kept"), "new_text": F.substring(notice, 1, 120)}))
        .when(kind == "unknown", _line({"action": F.lit("not recognised"), "state": F.lit("to review"), "new_text": F.substring(text, 1, 160)}))
        .otherwise(F.col("entry"))
    )
    bare = F.nullif(_stripped(F.regexp_replace(stays, r"\s*\(\*\)", "")), F.lit(""))
    return every.select("document", "page", "pos", bare.alias("text"), F.when(kind != "", entry).alias("entry"))


def in_force(paragraphs: DataFrame, look_back: int = LOOK_BACK) -> DataFrame:
    """The paragraphs with every note resolved; pages and positions stay."""
    return standing(resolved(paragraphs, look_back))


def register(paragraphs: DataFrame, look_back: int = LOOK_BACK) -> DataFrame:
    """One row for every note: what it did, and which text it replaced."""
    return entries(resolved(paragraphs, look_back))


def standing(rows: DataFrame) -> DataFrame:
    return rows.filter("text is not null").select(*names(PARAGRAPH))


def entries(rows: DataFrame) -> DataFrame:
    """The register's lines among ``resolved`` rows; ``pos`` is the note's place on its page."""
    return rows.filter("entry is not null").select("document", "pos", "page", *(F.col(f"entry.{n}").alias(n) for n in names(VERSION_NOTE) if n not in ("document", "pos", "page"))).select(*names(VERSION_NOTE))
