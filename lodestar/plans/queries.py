"""Registered queries: every operator on the driver's tables, and SQL that checks them.

Orders stand for procurement processes: the customer buys, the suppliers of
its lines bid, an order with one supplier is a single bid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lodestar.functions import dates, text as tx
from lodestar.operators import chunks, dedupe, filters, index, lookups, metrics, nearest, risk, search
from lodestar.plans import reports
from lodestar.sources.tables import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


# ---------------------------------------------------------------- similarity search


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


_DOT = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"""SELECT e.vec_id, e.label, round({_DOT}, 4) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
WHERE e.label IN (1, 3, 5) ORDER BY {_DOT} DESC, e.vec_id LIMIT 8""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.top_k(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 8, F.col("label").isin(1, 3, 5), "vec_id")
    return hits.select("vec_id", "label", F.round("similarity", 4).alias("similarity"))


@query(f"""SELECT e.vec_id, round({_DOT}, 4) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
ORDER BY {_DOT} DESC, e.vec_id LIMIT 8""")
def vector_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 8, id_column="vec_id").select("vec_id", F.round("similarity", 4).alias("similarity"))


@query(f"""SELECT count(*) AS hits, round(max(s), 4) AS best, round(max(s), 4) >= 0.5 AS passes FROM (
SELECT {_DOT} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label = 2 ORDER BY s DESC, e.vec_id LIMIT 5)""")
def vector_gate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.gated(search.top_k(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 7), 5, F.col("label") == 2, "vec_id"), 0.5)


_RUN = f"""hits AS (SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id, e.label, {_DOT} AS s,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank
FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)"""


def _run(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Every hundredth vector as a query against all others; the same label is relevant."""
    corpus = table(spark, sf_dir, "embeddings")
    asked = corpus.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = search.top_k_per_query(corpus, asked, k + 1, id_column="vec_id").filter("vec_id <> query_id")
    hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= k)
    labels = corpus.select("vec_id", "label")
    return hits.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")


@query(f"WITH {_RUN} SELECT query_id, vec_id, rank, round(s, 4) AS similarity FROM hits WHERE rank <= 5")
def vector_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 4).alias("similarity"))


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    corpus = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return corpus, corpus.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"""SELECT query_id, vec_id, rank, round(s, 4) AS similarity FROM (SELECT q.vec_id AS query_id, e.vec_id, {_DOT} AS s,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0) WHERE rank <= 8""")
def vector_topk_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout by cells, all of them probed: the exact search."""
    corpus, asked = _asked(spark, sf_dir)
    layout = nearest.lay_out(corpus, new_path(spark, "cells"))
    hits = nearest.nearest_in_cells(layout, asked, 8, len(layout.centroids), id_column="vec_id")
    return hits.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 4).alias("similarity"))


@query(None)
def vector_cell_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query: how many of its eight nearest are found with as many cells as a recall of 0.9 is measured to take."""
    corpus, asked = _asked(spark, sf_dir)
    layout = nearest.lay_out(corpus, new_path(spark, "cells"))
    found = nearest.nearest_in_cells(layout, asked, 8, nearest.probes_for(layout, spark, 8, id_column="vec_id"), id_column="vec_id")
    return nearest.recall(found, nearest.nearest_per_query(corpus, asked, 8, id_column="vec_id"), id_column="vec_id")


# ---------------------------------------------------------------- repeated keys

@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey
ORDER BY l_shipdate DESC, l_linenumber DESC, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n = 1""")
def dedupe_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_shipdate"), F.desc("l_linenumber"), F.asc("l_suppkey"), F.asc("l_quantity"), F.asc("l_extendedprice")]
    return dedupe.latest_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], order).select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity")


@query("SELECT doc_id, n AS group_size FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def duplicate_groups_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return dedupe.group_members(docs, ["digest"]).select("doc_id", "group_size")


@query("SELECT doc_id, n AS copy_number FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def duplicate_non_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return dedupe.later_copies(docs, ["digest"], [F.asc("doc_id")]).select("doc_id", F.col("copy_number").cast("long").alias("copy_number"))


_VERSIONS = """WITH a AS (SELECT *, count(*) OVER k AS n, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS p FROM orders
WINDOW k AS (PARTITION BY o_custkey, o_orderpriority)), g AS (SELECT o_custkey, o_orderpriority, bool_or(o_orderstatus = 'F' AND p < n) AS failed,
count(DISTINCT CAST(o_orderdate AS DATE)) AS days, count(DISTINCT o_totalprice) AS kinds, max(n) AS size FROM a WHERE n > 1 GROUP BY ALL), v AS (
SELECT a.o_orderkey, a.p, a.n, CASE WHEN failed THEN 'A' WHEN days = 1 AND kinds = size THEN 'B' WHEN days = 1 THEN 'C' ELSE 'D' END AS kind FROM a JOIN g USING (o_custkey, o_orderpriority) WHERE a.n > 1)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.version_groups(
        table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], [F.asc("o_orderdate"), F.asc("o_orderkey")], F.col("o_orderstatus") == "F", F.to_date("o_orderdate"), F.col("o_totalprice").cast("string")
    )


@query(f"{_VERSIONS} SELECT kind, count(*) AS orders FROM v GROUP BY kind")
def version_group_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).groupBy(F.col("version_kind").alias("kind")).agg(F.count("*").alias("orders"))


@query(f"{_VERSIONS} SELECT o_orderkey, kind, kind = 'B' OR p = n AS is_current FROM v")
def version_current_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("o_orderkey", F.col("version_kind").alias("kind"), "is_current")


@query("""SELECT l_orderkey, count(DISTINCT l_returnflag) + max(CASE WHEN l_returnflag IS NULL THEN 1 ELSE 0 END) AS n_l_returnflag,
count(DISTINCT l_linestatus) + max(CASE WHEN l_linestatus IS NULL THEN 1 ELSE 0 END) AS n_l_linestatus FROM lineitem GROUP BY l_orderkey HAVING n_l_returnflag > 1 OR n_l_linestatus > 1""")
def changed_versions_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.changed_versions(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def values_per_key_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.values_per_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "priorities")


@query("""SELECT o_orderkey, string_agg(file, ',' ORDER BY file) AS months, max(file) AS latest FROM (SELECT o_orderkey, 'a' AS file FROM orders WHERE o_orderstatus <> 'O'
UNION ALL SELECT o_orderkey, 'b' FROM orders WHERE o_orderstatus <> 'F') GROUP BY o_orderkey""")
def union_files_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    union = keys.filter("o_orderstatus <> 'O'").withColumn("file", F.lit("a")).unionByName(keys.filter("o_orderstatus <> 'F'").withColumn("file", F.lit("b"))).drop("o_orderstatus")
    latest = dedupe.latest_per_key(union, ["o_orderkey"], [F.desc("file")]).withColumnRenamed("file", "latest")
    return latest.join(dedupe.values_per_key(union, "o_orderkey", "file", "months"), "o_orderkey").orderBy("o_orderkey")


@query("""SELECT lang, doc_id, place FROM (SELECT lang, doc_id, dense_rank() OVER (PARTITION BY lang ORDER BY sha256(text)) AS place
FROM (SELECT *, count(*) OVER (PARTITION BY lang, text) AS n FROM documents) WHERE n > 1) WHERE place <= 3""")
def examples_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.plans.processes import examples_per_class as examples

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    out = examples(dedupe.group_members(docs, ["lang", "digest"]), "lang", ["digest"])
    return out.select("lang", "doc_id", F.col("place").cast("long").alias("place"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2028}\x{2029}\p{Zs}]+', ' ', 'g'))) AS digest FROM documents")
def clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.squeeze(F.col("text"))).alias("digest"))


#: By the database's own folding, which shares no table with the code.
_FOLD = r"trim(regexp_replace(upper(strip_accents(replace({}, 'ß', 'SS'))), '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}\p{{Zs}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_FOLD.format('text')}) AS digest FROM documents")
def accent_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.accent_key(F.col("text"))).alias("digest"))


@query(f"""WITH w AS (SELECT coalesce(lang, '') || ':' || unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents)
SELECT {_FOLD.format('word')} AS key, count(DISTINCT word) AS spellings FROM w GROUP BY 1 HAVING count(DISTINCT word) > 1""")
def accent_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings inside each language."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \\n]")).alias("word"), "lang")
    return lookups.spelling_variants(words.select(F.concat(F.coalesce("lang", F.lit("")), F.lit(":"), "word").alias("word")), "word", tx.accent_key(F.col("word")))


@query(f"""WITH w AS (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents)
SELECT {_FOLD.format('word')} AS key, count(DISTINCT word) AS spellings FROM w GROUP BY 1 HAVING count(DISTINCT word) > 1""")
def accent_variants_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \\n]")).alias("word"))
    return lookups.spelling_variants(words, "word", tx.accent_key(F.col("word")))


@query("SELECT doc_id, trim(text) = '' AS blank, trim(text) <> '' AND length(text) < 200 AS short FROM documents")
def short_text_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.blank(F.col("text")).alias("blank"), tx.is_short(F.col("text"), 200).alias("short"))


_BROKEN = "replace(replace(text, 'é', 'Ã'), '.', '¿')"


@query(f"SELECT doc_id, contains({_BROKEN}, '¿') AND NOT contains({_BROKEN}, '?') AS quotes_lost, regexp_matches({_BROKEN}, 'Ã|Â|�') AS mojibake FROM documents")
def mojibake_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.replace(F.replace("text", F.lit("é"), F.lit("Ã")), F.lit("."), F.lit("¿"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.lost_quotes(broken).alias("quotes_lost"), tx.mojibake(broken).alias("mojibake"))


@query("SELECT doc_id, substring(sha1(text), 1, 12) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("hash"))


@query("""SELECT doc_id, substring(sha1(text || '{"lang":"' || lang || '","n":' || n_chars || ',"source":"' || source || '"}'), 1, 16) AS hash FROM documents""")
def record_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.record_hash(F.col("text"), {"lang": F.col("lang"), "source": F.col("source"), "n": F.col("n_chars")}).alias("hash"))


@query(r"SELECT doc_id, substring(regexp_replace('key sk-' || doc_id || '_abc* ' || text, 'sk-[A-Za-z0-9*_\-]+', 'sk-[hidden]', 'g'), 1, 200) AS message FROM documents")
def mask_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("key sk-"), F.col("doc_id").cast("string"), F.lit("_abc* "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.mask_secrets(message).alias("message"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'ring|b[aeiou]') AND NOT regexp_matches(lower(p_name), '^small|x$')")
def regex_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(filters.by_words(F.lower("p_name"), ["ring", "b[aeiou]"], ["^small", "x$"])).select("p_partkey", "p_name")


@query(r"""WITH s AS (SELECT page_id, html, regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS bare FROM pages), t AS (SELECT *, regexp_replace(bare, '<[^>]+>', '', 'g') AS body FROM s)
SELECT page_id, len(regexp_extract_all(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>')) AS scripts, len(regexp_extract_all(bare, '<[^>]+>')) AS tags, length(body) AS chars, md5(body) AS digest FROM t""")
def html_page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    body, hits = tx.removed(F.col("html"), {"scripts": r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", "tags": "<[^>]+>"})
    return table(spark, sf_dir, "pages").select("page_id", *(n.cast("long").alias(k) for k, n in hits.items()), F.length(body).cast("long").alias("chars"), F.md5(body).alias("digest"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(source || ':' || (length(text) % 97) || ', ' || (n_chars % 31) || ',x;' || lang || ':' || (doc_id % 5) || ';' || left(text, 3), ';')) AS part FROM documents),
p AS (SELECT doc_id, trim(string_split(part, ':')[1]) AS document, unnest(string_split(string_split(part, ':')[2], ',')) AS page FROM s WHERE contains(part, ':')) SELECT DISTINCT doc_id, document, TRY_CAST(trim(page) AS BIGINT) AS page FROM p""")
def page_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: c.cast("string")
    spec = F.concat("source", F.lit(":"), s(F.length("text") % 97), F.lit(", "), s(F.col("n_chars") % 31), F.lit(",x;"), "lang", F.lit(":"), s(F.col("doc_id") % 5), F.lit(";"), F.left("text", F.lit(3)))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.pages_of(spec)).alias("p"))
    return rows.select("doc_id", "p.document", F.col("p.page").cast("long").alias("page"))


@query(r"""WITH m AS (SELECT doc_id, replace(replace(replace(text, ' the ', ' [F2] '), ' de ', ' [F9] '), ' and ', ' [F1] ') AS t FROM documents)
SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(t, '[F2]', '(two, p. 2)'), '[F9]', ''), '[F1]', '(one, p. 1)'), '\s+([.,;:])', '\1', 'g'), ' ')) AS answer, array_to_string(regexp_extract_all(t, '\[F(\d+)\]', 1), ',') AS cited FROM m""")
def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks in place of common words; the first two have a source, the ninth has none."""
    marked = F.col("text")
    for word, n in (("the", 2), ("de", 9), ("and", 1)):
        marked = F.replace(marked, F.lit(f" {word} "), F.lit(f" [F{n}] "))
    labels = F.array(F.lit("(one, p. 1)"), F.lit("(two, p. 2)"))
    return table(spark, sf_dir, "documents").withColumn("marked", marked).select("doc_id", F.md5(tx.citations_set(F.col("marked"), labels)).alias("answer"), F.array_join(tx.numbers_cited(F.col("marked")).cast("array<string>"), ",").alias("cited"))


@query(r"""WITH m AS (SELECT conv_id, turn, regexp_replace(replace(text, ' the ', ' id-' || (turn % 10) || ' '), ' (of|de|and) ', ' id-' || ((turn + conv_id) % 10) || ' ', 'g') AS t, ['id-' || (turn % 10), 'id-3'] AS known FROM conversations),
n AS (SELECT *, regexp_extract_all(t, 'id-\d') AS every FROM m), u AS (SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i) AS named FROM n)
SELECT conv_id, turn, array_to_string(list_filter(named, lambda x: list_contains(known, x)), ',') AS cited, array_to_string(list_filter(named, lambda x: NOT list_contains(known, x)), ',') AS invented,
md5(list_reduce(list_filter(named, lambda x: NOT list_contains(known, x)), lambda s, x: replace(s, x, '[removed]'), t)) AS answer FROM u""")
def invalid_ids_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in place of common words, of which two are known."""
    mark = lambda n: F.concat(F.lit(" id-"), (n % 10).cast("string"), F.lit(" "))
    text = F.regexp_replace(F.replace("text", F.lit(" the "), mark(F.col("turn"))), F.lit(" (of|de|and) "), mark(F.col("turn") + F.col("conv_id")))
    known = F.array(F.concat(F.lit("id-"), (F.col("turn") % 10).cast("string")), F.lit("id-3"))
    marked = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("t"), known.alias("known")).withColumn("named", tx.ids_in(F.col("t"), r"id-\d"))
    return marked.select(
        "conv_id", "turn", F.array_join(F.array_intersect("named", "known"), ",").alias("cited"), F.array_join(F.array_except("named", "known"), ",").alias("invented"), F.md5(tx.ids_masked(F.col("t"), F.col("named"), F.col("known"), "[removed]")).alias("answer")
    )


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS first_only, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    sides = events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "click").alias("a"), F.bool_or(F.col("event_type") == "purchase").alias("b"))
    return sides.agg(F.count_if(F.expr("a and b")).alias("both"), F.count_if(F.expr("a and not b")).alias("first_only"), F.count_if(F.expr("a or b")).alias("either"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'S/ ' || format('{:,.2f}', c_acctbal) ELSE 'no published amount' END AS amount FROM customer""")
def money_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", tx.money(F.col("c_acctbal"), F.col("c_acctbal") > 0).alias("amount"))


@query("""SELECT string_agg('[F' || n || '] ' || n_name || ' — ' || n_regionkey, chr(10) || chr(10) ORDER BY n) AS listing FROM (SELECT *, row_number() OVER (ORDER BY n_name) AS n FROM nation)""")
def prompt_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "nation").withColumn("rank", F.row_number().over(W.orderBy("n_name")))
    return search.sources_listed(ranked, F.concat(F.col("n_name"), F.lit(" — "), F.col("n_regionkey").cast("string")))


# ---------------------------------------------------------------- filters and repairs


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_totalprice <= 300000 AND o_orderdate >= '1994-01-01' AND o_orderdate < '1997-01-01'""")
def structured_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"department": "F", "amount_min": 100000.0, "amount_max": 300000.0, "date_from": "1994-01-01", "date_to": "1996-12-31"}
    orders = table(spark, sf_dir, "orders").withColumn("day", dates.day_number(F.col("o_orderdate")))
    return orders.filter(filters.structured(wanted, {"department": "o_orderstatus", "amount": "o_totalprice"})).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0")
def filter_by_in_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"categories": ["BUILDING", "MACHINERY"], "amount_min": 0.0}
    return table(spark, sf_dir, "customer").filter(filters.structured(wanted, {"category": "c_mktsegment", "amount": "c_acctbal"})).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("""SELECT event_id, CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS local_day, strftime(ts - INTERVAL 5 HOUR, '%H:%M') AS local_time, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day_number FROM events""")
def local_date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", dates.local_date(ts).cast("string").alias("local_day"), dates.local_time(ts).alias("local_time"), dates.day_number(ts).alias("day_number"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) >= '1995-03-01' AS late, o_orderpriority LIKE '1%' AS urgent FROM orders""")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    parsed = F.when(dates.is_iso_day(text), F.to_date(text))
    return table(spark, sf_dir, "orders").select("o_orderkey", (parsed >= F.lit("1995-03-01").cast("date")).alias("late"), F.col("o_orderpriority").startswith("1").alias("urgent"))


_AMOUNT = """WITH t AS (SELECT c_custkey, c_acctbal, sum(o_totalprice) AS awarded FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
a AS (SELECT *, CASE WHEN c_acctbal > 0 THEN c_acctbal WHEN awarded > 0 THEN round(awarded, 2) END AS amount, CASE WHEN c_acctbal > 0 THEN 'called' WHEN awarded > 0 THEN 'awarded' ELSE '' END AS amount_source FROM t)"""


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    awarded = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("awarded"))
    joined = table(spark, sf_dir, "customer").join(awarded, F.col("c_custkey") == F.col("o_custkey"), "left")
    called, rescued = F.col("c_acctbal") > 0, F.col("awarded") > 0
    return joined.select("c_custkey", "c_acctbal", F.when(called, F.col("c_acctbal")).when(rescued, F.round("awarded", 2)).alias("amount"), F.when(called, "called").when(rescued, "awarded").otherwise("").alias("amount_source"))


@query(f"{_AMOUNT} SELECT c_custkey, amount, amount_source FROM a")
def amount_repair_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amounts(spark, sf_dir).select("c_custkey", "amount", "amount_source")


@query(f"""{_AMOUNT} SELECT count(*) AS total, count(*) FILTER (c_acctbal <= 0) AS missing, count(*) FILTER (amount_source = 'awarded') AS rescued, count(*) FILTER (amount IS NULL) AS unsolved,
round(count(*) FILTER (amount_source = 'awarded') / greatest(1, count(*) FILTER (c_acctbal <= 0)), 4) AS rescue_rate FROM a""")
def quality_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing, rescued = F.count_if(F.col("c_acctbal") <= 0), F.count_if(F.col("amount_source") == "awarded")
    return _amounts(spark, sf_dir).agg(F.count("*").alias("total"), missing.alias("missing"), rescued.alias("rescued"), F.count_if(F.col("amount").isNull()).alias("unsolved"), F.round(rescued / F.greatest(F.lit(1), missing), 4).alias("rescue_rate"))


@query("""SELECT c_custkey, concat_ws(' | ', CASE WHEN c_acctbal <= 0 THEN 'no amount' END, CASE WHEN c_acctbal < 500 THEN 'low' END, CASE WHEN c_nationkey = 3 THEN 'watched' END) AS warnings,
(c_acctbal <= 0)::INT + (c_acctbal < 500)::INT + (c_nationkey = 3)::INT AS n_warnings FROM customer""")
def warnings_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(F.col("c_acctbal") <= 0, "no amount"), (F.col("c_acctbal") < 500, "low"), (F.col("c_nationkey") == 3, "watched")]
    found = F.array_compact(F.array(*(F.when(c, t) for c, t in rules)))
    return table(spark, sf_dir, "customer").withColumn("found", found).select("c_custkey", F.array_join("found", " | ").alias("warnings"), F.size("found").alias("n_warnings"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Works' WHEN 'MACHINERY' THEN 'Goods' ELSE 'No category' END AS category FROM customer")
def category_map_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("BUILDING", "Works"), ("MACHINERY", "Goods")], "key string, name string")
    return lookups.mapped(table(spark, sf_dir, "customer"), F.col("c_mktsegment"), names, "category", "No category").select("c_custkey", "category")


_PLACED = """WITH p AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_nationkey < 8 THEN n_name WHEN c_nationkey < 16 THEN r_name WHEN c_custkey % 5 = 0 THEN 'DISTRICT' END AS place,
CASE WHEN c_nationkey < 8 THEN 'declared' WHEN c_nationkey < 16 THEN 'province' WHEN c_custkey % 5 = 0 THEN 'district' ELSE '' END AS place_source
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    declared = nation.filter("n_nationkey < 8").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("place"))
    province = nation.filter("n_nationkey < 16").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("key"), F.col("r_name").alias("place"))
    district = spark.createDataFrame([(0, "DISTRICT")], "key long, place string")
    steps = [("declared", F.col("c_nationkey"), declared), ("province", F.col("c_nationkey"), province), ("district", F.col("c_custkey") % 5, district)]
    return lookups.cascade(table(spark, sf_dir, "customer"), steps, "place")


@query(f"{_PLACED} SELECT c_custkey, place, place_source FROM p")
def location_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("c_custkey", "place", "place_source")


@query(f"""{_PLACED}, m AS (SELECT c_mktsegment, place AS mode_place FROM (SELECT c_mktsegment, place, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, place) AS n FROM p WHERE place IS NOT NULL GROUP BY 1, 2) WHERE n = 1)
SELECT c_custkey, coalesce(place, mode_place) AS place, CASE WHEN place IS NULL AND mode_place IS NOT NULL THEN 'same entity' ELSE place_source END AS place_source FROM p LEFT JOIN m USING (c_mktsegment)""")
def same_entity_mode_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.filled_by_mode(_placed(spark, sf_dir), "c_mktsegment", "place").select("c_custkey", "place", "place_source")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)")
def anti_join_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT doc_id, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 100 THEN 'too short' WHEN len(regexp_extract_all(text, '[#*$%&|<>]')) / length(text) > 0.05 THEN 'illegible' ELSE 'usable' END AS verdict FROM documents""")
def legibility_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.regexp_count("text", F.lit("[#*$%&|<>]")) / F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", filters.legibility(F.length("text"), 100, odd, 0.05).alias("verdict"))


# ---------------------------------------------------------------- single bids

_BIDS = "bids AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, c_nationkey, n_name, count(DISTINCT l_suppkey) AS n, count(DISTINCT l_suppkey) = 1 AS single FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"
_RATES = """cases, flagged, round(flagged / cases, 4) AS rate,
round(greatest(0.0, (p + z / 2 - 1.96 * sqrt(p * (1 - p) / cases + z / (4 * cases))) / (1 + z)), 4) AS low, round(least(1.0, (p + z / 2 + 1.96 * sqrt(p * (1 - p) / cases + z / (4 * cases))) / (1 + z)), 4) AS high"""


def _rates(by: str) -> str:
    return f"rates AS (SELECT {by}, {_RATES} FROM (SELECT *, flagged / cases AS p, 3.8416 / cases AS z FROM (SELECT {by}, count(*) AS cases, count(*) FILTER (single) AS flagged FROM bids GROUP BY {by})))"


def _bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with how many suppliers they have; the lines are summed up before any join."""
    suppliers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_suppkey").alias("n"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return orders.join(suppliers, "o_orderkey").join(customers, "o_custkey").join(nations, "c_nationkey").withColumn("single", F.col("n") == 1)


@query(f"WITH {_BIDS}, {_rates('n_name')} SELECT * FROM rates")
def single_supplier_rate_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.rate_by(_bids(spark, sf_dir), "n_name", "single")


@query(f"WITH {_BIDS}, {_rates('o_custkey')} SELECT * FROM rates WHERE cases >= 5 ORDER BY rate DESC, flagged DESC, cases DESC, o_custkey LIMIT 10")
def single_supplier_rate_by_customer_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.ranked(risk.rate_by(_bids(spark, sf_dir), "o_custkey", "single", least=5), "o_custkey", 10)


@query(f"WITH {_BIDS}, {_rates('o_orderpriority')} SELECT o_orderpriority, low, high FROM rates")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.rate_by(_bids(spark, sf_dir), "o_orderpriority", "single").select("o_orderpriority", "low", "high")


@query(f"""WITH {_BIDS}, {_rates('o_custkey')}, top AS (SELECT * FROM rates WHERE cases >= 5 ORDER BY rate DESC, flagged DESC, cases DESC, o_custkey LIMIT 10), cut AS (SELECT min(rate) AS cut_rate FROM top)
SELECT cut_rate, (SELECT count(*) FROM rates WHERE cases >= 5 AND rate = cut_rate) AS in_all, (SELECT count(*) FROM top WHERE rate = cut_rate) AS inside FROM cut""")
def ties_at_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.ties_at_cut(risk.rate_by(_bids(spark, sf_dir), "o_custkey", "single", least=5), "o_custkey", 10)


@query(f"""WITH {_BIDS} SELECT count(*) AS all_rows, count(*) FILTER (o_orderstatus <> 'P') AS analysed, count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice > 100000) AS awarded,
count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS competitive, count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND single) AS single FROM bids""")
def universe_step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = {"analysed": F.col("o_orderstatus") != "P", "awarded": F.col("o_totalprice") > 100000, "competitive": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "single": F.col("single")}
    return filters.step_counts(_bids(spark, sf_dir), steps)


@query(f"""WITH {_BIDS}, g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (single) AS flagged FROM bids GROUP BY 1), m AS (SELECT unnest([1, 5, 10, 15, 20, 30]) AS least)
SELECT least, count(o_custkey) AS groups, round(count(o_custkey) / (SELECT count(*) FROM g), 3) AS share_of_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS cases,
round(coalesce(sum(n), 0) / (SELECT sum(n) FROM g), 3) AS share_of_cases, round(1 / least, 3) AS weight_of_one, round(max(flagged / n), 3) AS highest_rate FROM m LEFT JOIN g ON n >= least GROUP BY least""")
def minimum_size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.minimum_sizes(_bids(spark, sf_dir), "o_custkey", "single")


@query(f"""WITH {_BIDS}, g AS (SELECT count(*) AS n FROM bids GROUP BY o_custkey) SELECT {', '.join(f'CAST(floor(quantile_cont(n, {p / 100})) AS INTEGER) AS p{p}' for p in risk.PERCENTILES)} FROM g""")
def group_size_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.size_percentiles(_bids(spark, sf_dir), "o_custkey")


# ---------------------------------------------------------------- dashboard


@query(f"WITH {_BIDS} SELECT count(*) AS processes, round(sum(CASE WHEN o_totalprice > 1000 THEN o_totalprice END), 2) AS amount, count(DISTINCT n_name) AS areas, round(count(*) FILTER (single) / count(*), 4) AS single_rate FROM bids")
def kpi_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kpis(_bids(spark, sf_dir).withColumn("valid", F.col("o_totalprice") > 1000), "o_totalprice", "valid", "n_name", "single")


@query(f"WITH {_BIDS} SELECT o_orderpriority, count(*) AS processes, round(sum(CASE WHEN o_totalprice > 1000 THEN o_totalprice END), 2) AS amount FROM bids GROUP BY 1")
def distribution_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution(_bids(spark, sf_dir).withColumn("valid", F.col("o_totalprice") > 1000), "o_orderpriority", "o_totalprice", "valid")


@query(f"WITH {_BIDS} SELECT n.n_name, count(o_orderkey) AS processes, round(coalesce(sum(o_totalprice), 0), 2) AS amount FROM nation n LEFT JOIN (SELECT * FROM bids WHERE o_totalprice > 450000) b ON n.n_name = b.n_name GROUP BY 1")
def map_by_nation_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = _bids(spark, sf_dir).filter("o_totalprice > 450000").withColumn("valid", F.lit(True))
    return reports.map_table(table(spark, sf_dir, "nation").select("n_name"), big, "n_name", "o_totalprice", "valid")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")).limit(20).select("o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- calls and their cost

_BANDS = [("click", "00:00", "08:30", 0.27, 0.07, 1.1), ("click", "08:30", "24:00", 0.135, 0.035, 0.55), ("view", "00:00", "24:00", 0.5, 0.1, 1.5)]
_BAND_SQL = ", ".join(str(b) for b in _BANDS)
_COSTED = f"""costed AS (SELECT event_id, event_type AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, strftime(ts - INTERVAL 5 HOUR, '%H:%M') AS t, from_time || '-' || to_time AS band, pi, pc, po
FROM events LEFT JOIN (VALUES {_BAND_SQL}) b(m, from_time, to_time, pi, pc, po) ON event_type = m AND strftime(ts - INTERVAL 5 HOUR, '%H:%M') >= from_time AND (to_time = '24:00' OR strftime(ts - INTERVAL 5 HOUR, '%H:%M') < to_time))"""


def _costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame(_BANDS, "model string, from_time string, to_time string, price_in double, price_cached double, price_out double")
    calls = table(spark, sf_dir, "events").withColumn("tokens", F.get_json_object("props", "$.k").try_cast("long"))
    priced = lookups.priced(calls, F.broadcast(bands), "event_type", dates.local_time(F.col("ts")))
    n = F.col("tokens")
    cost = lookups.call_cost(n * 1000, n * 100, n * 10, F.col("price_in"), F.col("price_cached"), F.col("price_out"))
    return priced.select("event_id", F.col("event_type").alias("model"), "tokens", F.concat("from_time", F.lit("-"), "to_time").alias("band"), F.round(cost, 9).alias("cost_usd"))


@query(f"WITH {_COSTED} SELECT event_id, band, round((tokens * 900 * pi + tokens * 100 * pc + tokens * 10 * po) / 1e6, 9) AS cost_usd FROM costed")
def tariff_band_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costed(spark, sf_dir).select("event_id", "band", "cost_usd")


@query(f"""WITH {_COSTED} SELECT model, count(*) AS calls, count(*) FILTER (band IS NULL) AS failed, CAST(sum(tokens * 1000) AS BIGINT) AS tokens_in, CAST(sum(tokens * 10) AS BIGINT) AS tokens_out,
round(sum(round((tokens * 900 * pi + tokens * 100 * pc + tokens * 10 * po) / 1e6, 9)), 6) AS cost_usd FROM costed GROUP BY model""")
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.call_costs(_costed(spark, sf_dir).withColumns({"success": F.col("band").isNotNull(), "tokens_in": F.col("tokens") * 1000, "tokens_out": F.col("tokens") * 10}))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events")
def json_tokens_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("tokens"))


# ---------------------------------------------------------------- evaluation


@query(f"""WITH {_RUN}, q AS (SELECT query_id, coalesce(1 / min(CASE WHEN label = query_label THEN rank END), 0.0) AS rr, {', '.join(f"max(CASE WHEN rank <= {k} AND label = query_label THEN 1 ELSE 0 END) AS r{k}, count(*) FILTER (rank <= {k} AND label = query_label) / {k} AS p{k}, avg(CASE WHEN rank <= {k} THEN (label = query_label)::INT END) AS c{k}" for k in (1, 3, 5))}
FROM hits WHERE rank <= 5 GROUP BY query_id) SELECT count(*) AS questions, round(avg(rr), 4) AS mrr, {', '.join(f'round(avg(r{k}), 4) AS recall_{k}, round(avg(p{k}), 4) AS precision_{k}, round(avg(c{k}), 4) AS compliance_{k}' for k in (1, 3, 5))} FROM q""")
def recall_precision_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = table(spark, sf_dir, "embeddings").select("label", F.col("label").alias("query_label"))
    hits = metrics.with_hits(_run(spark, sf_dir, 5), same, ["label", "query_label"])
    return metrics.retrieval_summary(metrics.retrieval_by_question(hits, "query_id", (1, 3, 5)), (1, 3, 5))


_SCORES = f"""scores AS (SELECT e.vec_id AS id, round({_DOT}, 4) AS score, e.label >= 7 AS outside, e.label = 8 AS verdict, e.label FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


def _scores(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    from lodestar.functions.vectors import dot

    vector = F.array(*map(F.lit, map(float, _vector(spark, sf_dir, 0))))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(dot(F.col("embedding"), vector), 4).alias("score"), (F.col("label") >= 7).alias("outside"), (F.col("label") == 8).alias("verdict"), *more)


@query(f"WITH {_SCORES} SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM scores a JOIN scores b ON NOT a.outside AND b.outside")
def auc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(_scores(spark, sf_dir).withColumn("positive", ~F.col("outside")), "score", "positive")


_THRESHOLDS = (-0.2, -0.1, 0.0, 0.1, 0.2)


@query(f"""WITH {_SCORES}, t AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in _THRESHOLDS)}]) AS threshold) SELECT threshold, count(*) FILTER (outside AND score < threshold) AS right, count(*) FILTER (NOT outside AND score < threshold) AS wrong,
round(count(*) FILTER (outside AND score < threshold) / count(*) FILTER (outside), 4) AS right_rate, round(count(*) FILTER (NOT outside AND score < threshold) / count(*) FILTER (NOT outside), 4) AS wrong_rate FROM t, scores GROUP BY threshold""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_sweep(_scores(spark, sf_dir), "score", "outside", _THRESHOLDS)


@query(f"""WITH {_SCORES}, t AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in _THRESHOLDS)}]) AS threshold) SELECT threshold, count(*) FILTER (outside AND score < threshold) AS gate_right, count(*) FILTER (NOT outside AND score < threshold) AS gate_wrong,
count(*) FILTER (outside AND (score < threshold OR verdict)) AS final_right, count(*) FILTER (NOT outside AND (score < threshold OR verdict)) AS final_wrong, count(*) FILTER (score >= threshold) AS calls, round(count(*) FILTER (score >= threshold) * 0.00012::DOUBLE, 6) AS cost,
round(min(CASE WHEN NOT outside THEN score END) - threshold, 4) AS margin, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) FILTER (NOT outside AND score < threshold), '') AS wrongly_gated FROM t, scores GROUP BY threshold""")
def threshold_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_options(_scores(spark, sf_dir), _THRESHOLDS, 0.00012)


@query(f"""WITH {_SCORES} SELECT count(*) FILTER (outside) AS outside, count(*) FILTER (NOT outside) AS inside, count(*) FILTER (outside AND score < 0.1) AS abstained_right, count(*) FILTER (NOT outside AND score < 0.1) AS abstained_wrong,
round(count(*) FILTER (outside AND score < 0.1) / count(*) FILTER (outside), 4) AS right_rate, round(count(*) FILTER (NOT outside AND score < 0.1) / count(*) FILTER (NOT outside), 4) AS wrong_rate FROM scores""")
def abstention_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.abstention_rates(_scores(spark, sf_dir).withColumn("abstained", F.col("score") < 0.1), "abstained", "outside")


@query("""SELECT count(*) AS n, count(*) FILTER (abs(a - b) <= 0.01 * greatest(abs(a), 1)) AS right_amount, count(*) FILTER (x IS NOT DISTINCT FROM y) AS right_status, count(*) FILTER (abs(a - b) <= 0.01 * greatest(abs(a), 1) AND x IS NOT DISTINCT FROM y) AS all_right
FROM (SELECT o_totalprice AS a, o_totalprice * (1 + (o_orderkey % 5) * 0.004) AS b, o_orderstatus AS x, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS y FROM orders)""")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    from lodestar.plans.evaluation import engine_report

    orders = table(spark, sf_dir, "orders")
    gold = orders.select(key.alias("id"), (key % 10 == 0).alias("outside"), F.col("o_totalprice").alias("a"), F.col("o_orderstatus").alias("x"))
    answers = orders.select(key.alias("id"), (key % 10 == 1).alias("abstained"), (F.col("o_totalprice") * (1 + (key % 5) * 0.004)).alias("b"), F.when(key % 11 != 0, F.col("o_orderstatus")).alias("y"))
    return engine_report(answers, gold, {"amount": ("a", "b", True), "status": ("x", "y", False)})[1]


# ---------------------------------------------------------------- paragraphs and chunks


def _doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document"), F.lit(1).alias("page"), "text")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents), t AS (SELECT doc_id, trim(l) AS l, p FROM l WHERE trim(l) <> ''),
m AS (SELECT *, CASE WHEN regexp_matches(l, '{UNIT}') OR regexp_matches(lag(l) OVER w, '[.:;][”"]?$') AND regexp_matches(l, '^\p{Lu}') OR lag(l) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM m) SELECT doc_id, count(DISTINCT g) AS paragraphs FROM g GROUP BY doc_id""".replace("{UNIT}", chunks.UNIT_START))
def paragraph_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chunks.paragraphs(_doc_pages(spark, sf_dir), blank_lines=False)
    return parts.groupBy(F.col("document").cast("long").alias("doc_id")).agg(F.count("*").alias("paragraphs"))


_CHUNKS = """
WITH paragraphs AS (
  SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ps FROM documents
), cut AS (
  SELECT doc_id, list_transform(ps, lambda p: CASE WHEN length(p) <= 500 THEN {'done': CAST([] AS VARCHAR[]), 'now': p} ELSE
    list_reduce(list_transform(string_split(p, ' '), lambda w: {'done': CAST([] AS VARCHAR[]), 'now': w}),
      lambda s, x: CASE WHEN s.now <> '' AND length(s.now) + 1 + length(x.now) > 500 THEN {'done': list_append(s.done, s.now), 'now': x.now} ELSE {'done': s.done, 'now': trim(s.now || ' ' || x.now, ' ')} END) END) AS ps FROM paragraphs
), units AS (
  SELECT doc_id, flatten(list_transform(ps, lambda s: CASE WHEN s.now <> '' THEN list_append(s.done, s.now) ELSE s.done END)) AS us FROM cut
), packed AS (
  SELECT doc_id, list_reduce(list_transform(us, lambda u: {'done': CAST([] AS VARCHAR[]), 'now': u}),
    lambda s, x: CASE WHEN length(s.now) + 2 + length(x.now) <= 500 THEN {'done': s.done, 'now': s.now || chr(10) || chr(10) || x.now}
      WHEN length(s.now) <= 150 THEN {'done': list_append(s.done, s.now), 'now': x.now}
      ELSE {'done': list_append(s.done, s.now), 'now': trim(CASE WHEN contains(right(s.now, 150), ' ') THEN substr(right(s.now, 150), instr(right(s.now, 150), ' ') + 1) ELSE right(s.now, 150) END || ' ' || x.now, ' ')} END) AS s FROM units WHERE len(us) > 0
), chunks AS (
  SELECT doc_id, unnest(list_append(s.done, s.now)) AS text, unnest(range(0, len(s.done) + 1)) AS n FROM packed
)
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(length(text) AS INTEGER) AS chars, left(sha1(text), 12) AS hash FROM chunks
"""


@query(_CHUNKS)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _doc_pages(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunks.chunked(pages, 500, 150).select(F.col("document").cast("long").alias("doc_id"), "n", F.length("text").alias("chars"), tx.content_hash(F.col("text")).alias("hash"))


@query("SELECT count(*) AS chunks, min(length(text)) AS least, median(length(text)) AS median, max(length(text)) AS most, round(quantile_cont(length(text), 0.9), 2) AS p90 FROM documents")
def chunk_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.length_stats(table(spark, sf_dir, "documents"))


_DECILE = "CASE WHEN len({0}) < 2 THEN {0}[1] ELSE {0}[least(greatest(floor(0.9::DOUBLE * (len({0}) + 1))::BIGINT, 1), len({0}) - 1)] * (1 - {1}) + {0}[least(greatest(floor(0.9::DOUBLE * (len({0}) + 1))::BIGINT, 1), len({0}) - 1) + 1] * {1} END"
_STEP = "(0.9::DOUBLE * (len({0}) + 1) - least(greatest(floor(0.9::DOUBLE * (len({0}) + 1))::BIGINT, 1), len({0}) - 1))"
_SIZES = ", ".join(f"floor({m}[1])::BIGINT AS {n}_least, floor(list_median({m}))::BIGINT AS {n}_median, floor({_DECILE.format(m, _STEP.format(m))})::BIGINT AS {n}_p90, floor({m}[len({m})])::BIGINT AS {n}_most" for m, n in (("c", "chars"), ("t", "tokens")))


@query(f"""SELECT lang, chunks, over_limit, {_SIZES} FROM (SELECT lang, count(*) AS chunks, count(*) FILTER (tokens > 512) AS over_limit, list(chars::DOUBLE ORDER BY chars) AS c, list(tokens::DOUBLE ORDER BY tokens) AS t
FROM (SELECT lang, length(text) AS chars, length(text) - length(replace(text, ' ', '')) + 1 AS tokens FROM documents) GROUP BY lang)""")
def chunk_size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages stand for chunk configurations, blanks part the tokens."""
    tokens = F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1
    sizes = reports.chunk_sizes(table(spark, sf_dir, "documents"), ["lang"], tokens, 512)
    return sizes.select("lang", "chunks", "over_limit", *(F.col(f"{n}_{c}").cast("long").alias(f"{n}_{c}") for n in ("chars", "tokens") for c in ("least", "median", "p90", "most")))


@query(f"""WITH {_SCORES} SELECT a.label % 3 AS configuration, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS auc
FROM scores a JOIN scores b ON NOT a.outside AND b.outside AND a.label % 3 = b.label % 3 GROUP BY 1""")
def auc_by_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir, F.col("label"), (F.col("label") % 3).cast("long").alias("configuration")).withColumn("positive", ~F.col("outside"))
    return metrics.auc(scores, "score", "positive", by=["configuration"])


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user_turn FROM conversations""")
def carry_forward_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.carried_forward(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.when(F.col("role") == "user", F.col("turn")), "last_user_turn").select("conv_id", "turn", "last_user_turn")


@query("""SELECT conv_id, round(avg(step::INT), 4) AS in_order FROM (SELECT conv_id, length(text) >= lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations) GROUP BY conv_id""")
def reading_order_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reading_order(table(spark, sf_dir, "conversations").withColumn("size", F.length("text")), "conv_id", "turn", "size")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER w AS marked, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)""")
def bounded_look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_order = W.partitionBy("conv_id").orderBy("turn")
    marked = F.last(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(in_order.rowsBetween(-15, -1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", marked.alias("marked"), F.lead("role").over(in_order).alias("next_role"))


@query("""SELECT doc_id, concat_ws(chr(10), concat_ws(' — ', 'Document', CASE WHEN lang = 'en' THEN source END), text) AS embedded FROM documents""")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    article = F.when(F.col("lang") == "en", F.col("source")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", chunks.embedding_text(F.lit("Document"), article, F.col("text")).alias("embedded"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS document, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 300 THEN 'too short' ELSE 'usable' END AS verdict, count(*) AS pages FROM documents GROUP BY ALL""")
def source_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_check(_doc_pages(spark, sf_dir), 300, 1.0)


# ---------------------------------------------------------------- the index


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The index as it should be, and as it was: some rows gone, some changed, some new."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    current = docs.filter("lang <> 'fr'").select("id", tx.content_hash(F.col("text")).alias("hash"))
    old = docs.filter("lang <> 'es'").select("id", tx.content_hash(F.when(F.col("lang") == "de", F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("hash"))
    return current, old


_SNAP = "cur AS (SELECT doc_id AS id, substring(sha1(text), 1, 12) AS hash FROM documents WHERE lang <> 'fr'), old AS (SELECT doc_id AS id, substring(sha1(CASE WHEN lang = 'de' THEN text || 'x' ELSE text END), 1, 12) AS hash FROM documents WHERE lang <> 'es')"


@query(f"WITH {_SNAP} SELECT id, hash FROM cur WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.id = cur.id AND old.hash = cur.hash)")
def index_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.pending(*_snapshots(spark, sf_dir)).select("id", "hash")


@query(f"WITH {_SNAP} SELECT id FROM old WHERE id NOT IN (SELECT id FROM cur)")
def index_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.stale(*_snapshots(spark, sf_dir))


@query(f"""WITH {_SNAP} SELECT count(cur.id) AS to_index, count(*) FILTER (cur.hash = old.hash) AS already_there, count(*) FILTER (cur.id IS NOT NULL AND cur.hash IS DISTINCT FROM old.hash) AS upserted,
count(*) FILTER (cur.id IS NULL) AS deleted, count(cur.id) AS total FROM cur FULL JOIN old ON cur.id = old.id""")
def index_upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.upsert_counts(*_snapshots(spark, sf_dir))


class _Shape:
    """Stands in for a model: a text's characters, blanks and line ends."""

    name = "shape"

    def passages(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]

    def query(self, text: str) -> list[float]:
        return self.passages([text])[0]

    def tokens(self, text: str) -> int:
        return len(text.split())


@query(r"""SELECT doc_id AS id, lang, substring(sha1(text || '{"lang":"' || lang || '"}'), 1, 16) AS hash, length(text) AS chars, length(text) - length(replace(text, ' ', '')) AS blanks,
length(text) - length(replace(text, chr(10), '')) AS line_ends, 2 AS version FROM documents WHERE lang <> 'fr' AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def index_build_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after two builds: of another state of the documents, then of theirs; some rows went, changed and came between."""
    docs = table(spark, sf_dir, "documents")
    rows = lambda df: index.to_index(df, "doc_id", "text", {"lang": F.col("lang")})
    path = new_path(spark, "index")
    index.build(rows(docs.filter("lang <> 'es'").withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("x"))).otherwise(F.col("text")))), path, _Shape, steps=2, buckets=64)
    index.build(rows(docs.filter("lang <> 'fr'")), path, _Shape, steps=2)
    part = lambda k: F.get("embedding", F.lit(k)).cast("long")
    built = index.open_index(spark, path).select("id", "lang", "hash", part(0).alias("chars"), part(1).alias("blanks"), part(2).alias("line_ends"))
    return built.withColumn("version", F.lit(index.versions(spark, path)[-1]))


# ---------------------------------------------------------------- nested records


@query("""WITH n AS (SELECT o_orderkey, list(l_suppkey) AS s, list(l_returnflag) AS f, list(strftime(l_shipdate, '%Y-%m-%d')) AS d, sum(l_extendedprice) AS awarded, count(*) AS items FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT o_orderkey, items AS n_items, len(list_distinct(s)) AS n_suppliers, list_max(d) AS last_release_at, array_to_string(list_sort(list_distinct(f)), '|') AS item_states, round(awarded, 2) AS awarded_amount FROM n""")
def nested_flatten_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders nested into source records, then flattened as records are."""
    from lodestar.plans.processes import flattened

    line = table(spark, sf_dir, "lineitem")
    nested = line.groupBy(F.col("l_orderkey").cast("string").alias("ocid")).agg(
        F.collect_list(F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))).alias("releases"),
        F.collect_list(F.struct(F.lit(None).cast("string").alias("description"), F.col("l_returnflag").alias("statusDetails"), F.struct(F.col("l_partkey").cast("string").alias("id")).alias("classification"))).alias("items"),
        F.collect_list(F.struct(F.struct(F.col("l_extendedprice").alias("amount")).alias("value"), F.array(F.struct(F.col("l_suppkey").cast("string").alias("id"))).alias("suppliers"))).alias("awards"),
    )
    nested = nested.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("ocid")), "ocid", "left_semi")
    null = lambda kind: F.lit(None).cast(kind)
    from lodestar.schemas import PARTY

    tender = F.struct(
        null("string").alias("id"), null("string").alias("title"), null("string").alias("description"), null("string").alias("procurementMethodDetails"), null("string").alias("mainProcurementCategory"), null("string").alias("datePublished"),
        null("struct<amount:double,currency:string,amount_PEN:double>").alias("value"), null("struct<startDate:string>").alias("tenderPeriod"), null("int").alias("numberOfTenderers"), null("array<struct<id:string>>").alias("tenderers"), F.col("items"),
    )
    compiled = F.struct(
        F.col("ocid"), null("string").alias("date"), null("struct<id:string>").alias("dataSegmentation"), null("struct<id:string,name:string>").alias("buyer"), null(f"array<{PARTY}>").alias("parties"), tender.alias("tender"), F.col("awards")
    )
    flat = flattened(nested.select("ocid", "releases", compiled.alias("compiledRelease")), F.lit("2026-01"))
    return flat.select(F.col("ocid").cast("long").alias("o_orderkey"), F.col("n_items").cast("long").alias("n_items"), F.col("n_suppliers").cast("long").alias("n_suppliers"), "last_release_at", "item_states", F.round("awarded_amount", 2).alias("awarded_amount"))


@query("""SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the streaming job's windows, run as a batch."""
    counts = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", "total")


# queries of whole pipelines register themselves
from lodestar.plans import document_queries, evaluation_queries, process_queries  # noqa: E402,F401
