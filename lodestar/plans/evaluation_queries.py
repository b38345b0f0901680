"""Queries that run saved-run replays, model comparisons, logged embedding and the monthly sinks.

Orders stand for questions: filled ones are inside the corpus, open ones
outside, pending ones ask for nothing that is there; lines are what was cited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.operators.embedding import embedded_with_log
from lodestar.plans import evaluation, replay
from lodestar.plans.queries import _Shape, query, table
from lodestar.sources import sinks
from lodestar.sources.files import read_calls
from lodestar.sources.tables import new_path


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(saved runs, relevant items)."""
    lines = table(spark, sf_dir, "lineitem")
    item = F.concat(F.lit("p"), "l_partkey")
    cited = lines.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_list(item).alias("cited"), F.collect_list(F.when(F.col("l_tax") >= 0.08, item)).alias("invalid"))
    orders = table(spark, sf_dir, "orders").join(cited, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key, none = F.col("o_orderkey"), F.array().cast("array<string>")
    score = F.when(key % 31 != 0, F.round(F.col("o_totalprice") / 600000, 4))
    runs = orders.select(
        key.cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "inside").when(F.col("o_orderstatus") == "O", "outside").otherwise("empty").alias("kind"), F.when(key % 50 == 0, "timeout").alias("error"),
        F.create_map(F.lit("status"), "o_orderstatus", F.lit("amount"), F.col("o_totalprice").cast("string")).alias("wanted"),
        F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("status").alias("k"), F.when(key % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("v")), F.when(key % 4 != 0, F.struct(F.lit("amount").alias("k"), (F.col("o_totalprice") * (1 + (key % 3) * 0.008)).cast("string").alias("v")))))).alias("found"),
        score.alias("top_score"), F.round(score + 0.05, 4).alias("gold_score"), (F.col("o_custkey") % 4 == 0).alias("model_abstained"), ((F.col("o_orderstatus") == "P") & (key % 2 == 0)).alias("no_results"),
        F.coalesce("cited", none).alias("cited"), F.coalesce("invalid", none).alias("invalid"), F.lit(0.001).alias("cost_usd"), F.lit(2).alias("calls"),
    )
    relevant = lines.filter("l_quantity > 40").select(F.col("l_orderkey").cast("string").alias("id"), item.alias("item"))
    return runs, relevant


_RUNS = """runs AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'inside' WHEN 'O' THEN 'outside' ELSE 'empty' END AS kind, o_orderkey % 50 = 0 AS failed, CASE WHEN o_orderkey % 31 <> 0 THEN round(o_totalprice / 600000, 4) END AS top,
  round(CASE WHEN o_orderkey % 31 <> 0 THEN round(o_totalprice / 600000, 4) END + 0.05::DOUBLE, 4) AS gold, o_custkey % 4 = 0 AS turned, o_orderstatus = 'P' AND o_orderkey % 2 = 0 AS nothing, o_orderstatus AS s, o_totalprice AS a FROM orders)"""


@query(f"""WITH {_RUNS}, e AS (SELECT *, coalesce(top < t, false) AS low, coalesce(gold < t, false) AS gold_low FROM runs, (SELECT unnest([0.2::DOUBLE, 0.4::DOUBLE]) AS t)), f AS (SELECT *, NOT failed AND NOT nothing AND (low OR turned) AS final FROM e),
g AS (SELECT *, kind = 'inside' AND final AS lost, kind = 'outside' AND NOT final AND NOT nothing AS through FROM f) SELECT t AS threshold, count(*) FILTER (kind = 'outside') AS outside, count(*) FILTER (kind = 'inside') AS inside,
count(*) FILTER (kind = 'outside' AND gold_low) AS gate_right, count(*) FILTER (kind = 'inside' AND gold_low) AS gate_wrong, count(*) FILTER (kind = 'outside' AND final) AS final_right, count(*) FILTER (lost) AS final_wrong, count(*) FILTER (through) AS let_through,
count(*) FILTER (NOT nothing AND top IS NOT NULL AND NOT low) AS drafting_calls, array_to_string(coalesce(list_slice(list_sort(list(CAST(k AS VARCHAR)) FILTER (lost)), 1, 20), []), ' ') AS lost_ids,
array_to_string(coalesce(list_slice(list_sort(list(CAST(k AS VARCHAR)) FILTER (through)), 1, 20), []), ' ') AS let_through_ids FROM g GROUP BY t""")
def engine_replay_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.options(_runs(spark, sf_dir)[0], (0.2, 0.4))


@query(f"""WITH {_RUNS}, cites AS (SELECT DISTINCT l.l_orderkey AS k FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_partkey = r.l_partkey WHERE l.l_returnflag = 'R' AND r.l_quantity > 40),
bad AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_tax >= 0.08), x AS (SELECT *, NOT failed AND NOT nothing AND NOT turned AS answered, k IN (SELECT k FROM cites) AS c, k IN (SELECT k FROM bad) AS b FROM runs)
SELECT count(*) AS questions, round(count(*) * 0.001::DOUBLE, 6) AS cost_usd, count(*) * 2 AS calls, count(*) FILTER (failed) AS errors, count(*) FILTER (kind = 'empty') AS empty, count(*) FILTER (kind = 'empty' AND nothing) AS empty_right,
count(*) FILTER (kind = 'outside' AND nothing) AS outside_without_results, count(*) FILTER (kind = 'inside' AND nothing) AS inside_without_results, count(*) FILTER (kind = 'inside' AND answered) AS answered_inside, count(*) FILTER (b) AS with_invalid_ids,
count(*) FILTER (kind = 'inside' AND answered AND c) AS cite_relevant, count(*) FILTER (k % 9 <> 0) AS right_status, count(*) FILTER (k % 4 <> 0 AND (k % 3) * 0.008::DOUBLE <= 0.01) AS right_amount, count(*) FILTER (k % 9 <> 0 AND k % 4 <> 0 AND (k % 3) * 0.008::DOUBLE <= 0.01) AS all_right FROM x""")
def engine_replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, relevant = _runs(spark, sf_dir)
    fields = replay.field_results(runs, ("status", "amount"), ("amount",)).drop("questions")
    # one row each
    return replay.summary(runs, relevant).join(F.broadcast(fields))


def _comparison(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(hits, scores): return flags stand for models, parts for questions, a line's number for its rank."""
    lines = table(spark, sf_dir, "lineitem")
    hits = lines.groupBy(F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("question"), F.col("l_linenumber").alias("rank")).agg(
        (F.max("l_quantity") > 30).alias("hit"), F.max("l_extendedprice").alias("latency_ms"), F.max("l_tax").alias("cost")
    )
    scores = lines.groupBy(F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("question")).agg(F.round(F.avg("l_discount") * 10, 3).alias("score")).withColumn("inside", F.col("question") % 3 != 0)
    return hits, scores


_HITS = """hits AS (SELECT l_returnflag AS model, l_partkey AS question, l_linenumber AS rank, max(l_quantity) > 30 AS hit, max(l_extendedprice) AS ms, max(l_tax) AS cost FROM lineitem GROUP BY ALL),
scores AS (SELECT l_returnflag AS model, l_partkey AS question, round(avg(l_discount) * 10, 3) AS score, l_partkey % 3 <> 0 AS inside FROM lineitem GROUP BY ALL),
by_question AS (SELECT model, question, coalesce(1 / min(CASE WHEN hit THEN rank END), 0.0) AS rr, max((rank <= 1 AND hit)::INT) AS r1, max((rank <= 3 AND hit)::INT) AS r3 FROM hits GROUP BY ALL)"""


@query(f"""WITH {_HITS}, quality AS (SELECT model, count(*) AS questions, round(avg(rr), 4) AS mrr, round(avg(r1), 4) AS recall_1, round(avg(r3), 4) AS recall_3 FROM by_question GROUP BY model),
once AS (SELECT model, round(avg(ms), 2) AS mean_ms, round(sum(cost), 6) AS cost, list(ms ORDER BY ms) AS l FROM hits WHERE rank = 1 GROUP BY model),
late AS (SELECT model, mean_ms, cost, round(l[floor(0.9::DOUBLE * (len(l) + 1))::BIGINT] * (1 - (0.9::DOUBLE * (len(l) + 1) - floor(0.9::DOUBLE * (len(l) + 1)))) + l[floor(0.9::DOUBLE * (len(l) + 1))::BIGINT + 1] * (0.9::DOUBLE * (len(l) + 1) - floor(0.9::DOUBLE * (len(l) + 1))), 2) AS p90_ms FROM once),
counted AS (SELECT model, score, count(*) FILTER (inside) AS p, count(*) FILTER (NOT inside) AS n FROM scores GROUP BY ALL), running AS (SELECT *, sum(n) OVER (PARTITION BY model ORDER BY score) - n AS below FROM counted),
area AS (SELECT model, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM running GROUP BY model), ranges AS (SELECT model, min(score) FILTER (inside) AS inside_least, max(score) FILTER (inside) AS inside_most, min(score) FILTER (NOT inside) AS outside_least, max(score) FILTER (NOT inside) AS outside_most FROM scores GROUP BY model),
above AS (SELECT s.model, count(*) FILTER (NOT inside AND score > inside_least) AS outside_above FROM scores s JOIN ranges USING (model) GROUP BY s.model)
SELECT * FROM quality JOIN late USING (model) JOIN area USING (model) JOIN ranges USING (model) JOIN above USING (model)""")
def models_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, scores = _comparison(spark, sf_dir)
    return evaluation.model_comparison(hits, (1, 3), scores)


@query(f"""WITH {_HITS} SELECT a.model, m AS measure, count(*) AS questions, round(avg(CASE m WHEN 'recall_1' THEN a.r1 - b.r1 ELSE a.rr - b.rr END), 6) AS difference, true AS inside_interval
FROM by_question a JOIN by_question b ON a.question = b.question AND b.model = 'A' AND a.model <> 'A', (SELECT unnest(['recall_1', 'reciprocal_rank']) AS m) GROUP BY ALL""")
def models_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences to one model on the same questions; each lies in its bootstrap interval."""
    from lodestar.operators.metrics import retrieval_by_question

    hits, _ = _comparison(spark, sf_dir)
    by = retrieval_by_question(hits.withColumn("_q", F.struct("model", "question")), "_q", (1,)).select("_q.*", "recall_1", "reciprocal_rank")
    apart = evaluation.paired_differences(by, "A", ("recall_1", "reciprocal_rank"), replicates=200)
    return apart.select("model", "measure", "questions", F.round("difference", 6).alias("difference"), F.col("difference").between(F.col("low"), F.col("high")).alias("inside_interval"))


@query(r"""SELECT doc_id, length(text) AS chars, (SELECT sum(len(regexp_extract_all(text, '\S+'))) FROM documents)::BIGINT AS tokens_called, (SELECT count(*) FROM documents) AS passages_called, 0 AS failed_calls FROM documents""")
def embedded_with_call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's vector, and the totals of the log that its calls left."""
    log = new_path(spark, "calls")
    rows = embedded_with_log(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _Shape, new_path(spark, "vectors"), log)
    passages = F.split("question", " ")[0].cast("long")
    totals = read_calls(spark, log).agg(F.sum("tokens_in").alias("tokens_called"), F.sum(passages).alias("passages_called"), F.count_if(~F.col("success")).alias("failed_calls"))
    return rows.select("doc_id", F.get("embedding", F.lit(0)).cast("long").alias("chars")).join(F.broadcast(totals))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT o_custkey) AS buyers FROM orders WHERE strftime(o_orderdate, '%Y-%m') <> '1997-03' OR o_orderkey % 2 = 0 GROUP BY 1""")
def monthly_sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders written by month, then one month again with half of its rows."""
    path, month = new_path(spark, "months"), F.date_format("o_orderdate", "yyyy-MM")
    orders = table(spark, sf_dir, "orders")
    sinks.write_months(orders, path, month)
    sinks.write_months(orders.filter((month == "1997-03") & (F.col("o_orderkey") % 2 == 0)), path, month)
    return sinks.read_months(spark, path).groupBy(month.alias("month")).agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("buyers"))
