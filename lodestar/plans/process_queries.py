"""Queries that run the process pipeline whole: nested records in archives, flattened, validated, counted.

Orders stand for processes: the customer buys, its nation is the department,
every line is an item, returned lines are awards.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestar.plans import cube, processes as P
from lodestar.plans.queries import query, table
from lodestar.schemas import PARTY, PROCESS, fields
from lodestar.sources.archives import zipped_records
from lodestar.sources.tables import new_path


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ocid, releases, compiledRelease): nested records, some of their branches missing."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")
    # plain columns travel; what nests is made of them after the grouping
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag", "p_name")
    rows = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    supplier = lambda r: F.struct(F.concat(F.lit("s"), r["l_suppkey"]).alias("id"))
    nested = {
        "release": lambda r: F.struct(F.date_format(r["l_shipdate"], "yyyy-MM-dd").alias("date")),
        "item": lambda r: F.struct(r["p_name"].alias("description"), r["l_returnflag"].alias("statusDetails"), F.struct(F.concat(F.lit("k"), r["l_partkey"] % 50).alias("id")).alias("classification")),
        "award": lambda r: F.struct(F.struct(r["l_extendedprice"].alias("amount")).alias("value"), F.array(supplier(r)).alias("suppliers")),
        "tenderer": supplier,
    }
    each = lambda name: F.transform("rows", nested[name])
    buyers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    orders = table(spark, sf_dir, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    orders = orders.withColumns({"tenderers": F.array_distinct(each("tenderer")), "awards": F.transform(F.filter("rows", lambda r: r["l_returnflag"] == "R"), nested["award"])})
    key, cust = F.col("o_orderkey"), F.concat(F.lit("c"), "o_custkey")
    foreign = key % 7 == 0
    other = F.struct(F.lit("s0").alias("id"), F.array(F.lit("supplier")).alias("roles"), _null("array<struct<scheme:string,id:string>>").alias("additionalIdentifiers"), _null("struct<department:string,region:string,locality:string>").alias("address"))
    buyer = F.struct(
        F.when(key % 6 == 0, "elsewhere").otherwise(cust).alias("id"), F.when(key % 3 == 0, F.array(F.lit("payer"), F.lit("buyer"))).alias("roles"),
        F.array(F.struct(F.lit("OTHER").alias("scheme"), F.lit("1").alias("id")), F.struct(F.lit("PE-RUC").alias("scheme"), F.col("c_custkey").cast("string").alias("id"))).alias("additionalIdentifiers"),
        F.struct(F.col("n_name").alias("department"), F.concat(F.lit("R"), F.col("c_nationkey") % 7).alias("region"), F.col("c_mktsegment").alias("locality")).alias("address"),
    )
    amount = F.when(key % 5 != 0, F.col("o_totalprice"))
    tender = F.struct(
        F.when(key % 13 != 0, F.concat(F.lit("t"), key)).alias("id"), F.concat(F.lit("Call "), "o_orderpriority").alias("title"), F.when(key % 17 != 0, F.concat_ws(" ", F.lit("Order of"), "c_name")).alias("description"),
        F.col("o_orderpriority").alias("procurementMethodDetails"), F.col("c_mktsegment").alias("mainProcurementCategory"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datePublished"),
        F.when(key % 19 != 0, F.struct(amount.alias("amount"), F.when(foreign, "USD").otherwise("PEN").alias("currency"), F.when(foreign & (key % 2 == 0), F.round(F.col("o_totalprice") * 4, 2)).alias("amount_PEN"))).alias("value"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("startDate")).alias("tenderPeriod"), F.when(key % 11 != 0, F.size("tenderers")).alias("numberOfTenderers"),
        F.when(key % 2 == 0, F.col("tenderers")).alias("tenderers"), each("item").alias("items"),
    )
    compiled = F.struct(
        F.concat(F.lit("o"), key).alias("ocid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.struct(F.date_format("o_orderdate", "yyyy-MM").alias("id")).alias("dataSegmentation"),
        F.struct(cust.alias("id"), F.col("c_name").alias("name")).alias("buyer"), F.array(other, buyer).cast(f"array<{PARTY}>").alias("parties"), tender.alias("tender"), F.when(F.size("awards") > 0, F.col("awards")).alias("awards"),
    )
    return orders.select(F.when(key % 23 != 0, F.concat(F.lit("o"), key)).alias("ocid"), each("release").alias("releases"), compiled.alias("compiledRelease"))


#: Bytes of an archive after which its task begins another.
ARCHIVE = 8 << 20


def packages(batches: Iterator[pa.RecordBatch], name: str, most: int = ARCHIVE) -> Iterator[pa.RecordBatch]:
    """ZIPs of one JSON package each, of about ``most`` bytes, however many records there are."""
    runs = (batch.slice(i, 256).column(0).to_pylist() for batch in batches for i in range(0, batch.num_rows, 256))
    k, run = 0, next(runs, None)
    while run:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive, archive.open("package.json", "w", force_zip64=True) as member:
            member.write(b'{"uri": "records", "records": [')
            member.write(", ".join(run).encode())
            while (run := next(runs, None)) and out.tell() < most:
                member.write((", " + ", ".join(run)).encode())
            member.write(b'], "publisher": {"records": []}}')
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}-{k}.zip"]), pa.array([out.getvalue()], pa.binary())], names=["path", "content"])
        k += 1


def _archives(records: DataFrame) -> DataFrame:
    """(path, content): the records as JSON packages in ZIPs, one or more for each part of the table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from packages(batches, f"part-{TaskContext.get().partitionId()}")

    return records.select(F.to_json(F.struct(*records.columns)).alias("json")).mapInArrow(pack, "path string, content binary")


_PROCESSES = """lines AS (SELECT l.*, p_name FROM lineitem l LEFT JOIN part ON l_partkey = p_partkey), grouped AS (
  SELECT l_orderkey, count(*) AS n, max(strftime(l_shipdate, '%Y-%m-%d')) AS last_ship, array_to_string(list_sort(list_distinct(list(l_returnflag))), '|') AS states,
    array_to_string(list(p_name ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)[1:5], ' | ') AS names, substring(array_to_string(list_sort(list_distinct(list('k' || (l_partkey % 50)))), '|'), 1, 300) AS classes,
    count(*) FILTER (l_returnflag = 'R') AS awards, sum(l_extendedprice) FILTER (l_returnflag = 'R') AS awarded, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS winners, count(DISTINCT l_suppkey) AS suppliers
  FROM lines GROUP BY l_orderkey
), processes AS (
  SELECT 'o' || o_orderkey AS ocid, '2026-01' AS file_month, strftime(o_orderdate, '%Y-%m') AS segment, strftime(o_orderdate, '%Y-%m-%d') AS compiled_at, coalesce(n, 0) AS n_releases, last_ship AS last_release_at,
    CASE WHEN o_orderkey % 13 <> 0 THEN 't' || o_orderkey END AS tender_id, 'Call ' || o_orderpriority AS title, CASE WHEN o_orderkey % 17 <> 0 THEN 'Order of ' || c_name END AS description, o_orderpriority AS method, c_mktsegment AS category,
    CASE WHEN o_orderkey % 19 <> 0 AND o_orderkey % 5 <> 0 THEN o_totalprice END AS amount, CASE WHEN o_orderkey % 19 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'USD' ELSE 'PEN' END END AS currency,
    CASE WHEN o_orderkey % 19 <> 0 AND o_orderkey % 14 = 0 THEN round(o_totalprice * 4, 2) END AS amount_local, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published_at, strftime(o_orderdate, '%Y-%m-%d') AS opened_at,
    'c' || o_custkey AS buyer_id, c_name AS buyer_name, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 6 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS buyer_tax_id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 6 <> 0 THEN n_name END AS buyer_department,
    CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 6 <> 0 THEN 'R' || (c_nationkey % 7) END AS buyer_region, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 6 <> 0 THEN c_mktsegment END AS buyer_locality,
    CASE WHEN o_orderkey % 11 <> 0 THEN suppliers END AS n_bidders, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(suppliers, 0) ELSE 0 END AS n_bidders_listed, coalesce(n, 0) AS n_items, coalesce(states, '') AS item_states, coalesce(names, '') AS item_descriptions,
    coalesce(classes, '') AS item_classes, coalesce(awards, 0) AS n_awards, CASE WHEN awards > 0 THEN awarded END AS awarded_amount, coalesce(winners, 0) AS n_suppliers
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN grouped ON o_orderkey = l_orderkey
)"""
_SHOWN = ", ".join(f"round({n}, 2) AS {n}" if t == "double" else n for n, t in fields(PROCESS))


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(n, 2).alias(n) if t == "double" else F.col(n) for n, t in fields(PROCESS)))


@query(f"WITH {_PROCESSES} SELECT {_SHOWN} FROM processes")
def archive_records_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records packed into ZIPs, cut out of them as streams, and flattened to all their columns."""
    return _shown(P.flattened(zipped_records(_archives(_records(spark, sf_dir))), F.lit("2026-01")))


def _rules(spark: SparkSession, sf_dir: str) -> P.Rules:
    nations = table(spark, sf_dir, "nation")
    names = nations.select(F.col("n_name").alias("key"), F.col("n_name").alias("department")).filter("n_nationkey % 4 <> 0")
    provinces = spark.createDataFrame([(f"R{i}", f"NATION_{i}") for i in range(5)], "key string, department string")
    districts = spark.createDataFrame([("BUILDING", "NATION_1")], "key string, department string")
    return P.Rules(names, provinces, districts, {}, {"BUILDING": "Works"}, ("A|N|R",))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.validated(P.flattened(_records(spark, sf_dir), F.lit("2026-01")), _rules(spark, sf_dir))


_VALID = f"""{_PROCESSES}, called AS (
  SELECT *, CASE WHEN amount_local > 0 THEN amount_local WHEN coalesce(currency, 'PEN') = 'PEN' THEN amount END AS c FROM processes
), chosen AS (
  SELECT *, coalesce(c, 0) = 0 AND coalesce(awarded_amount, 0) > 0 AND coalesce(currency, 'PEN') = 'PEN' AS rescued, trim(coalesce(description, '')) AS own, CASE WHEN trim(coalesce(description, '')) = '' AND item_descriptions <> '' THEN item_descriptions ELSE trim(coalesce(description, '')) END AS shown FROM called
), placed AS (
  SELECT *, CASE WHEN rescued THEN awarded_amount ELSE c END AS final, CASE WHEN rescued THEN 'awarded' WHEN c > 0 THEN 'called' ELSE '' END AS amount_source, CAST(substring(buyer_region, 2) AS INT) AS r,
    CASE WHEN buyer_department IS NOT NULL AND CAST(substring(buyer_department, 8) AS INT) % 4 <> 0 THEN buyer_department END AS d FROM chosen
), located AS (
  SELECT *, CASE WHEN d IS NOT NULL THEN d WHEN r < 5 THEN 'NATION_' || r WHEN buyer_locality = 'BUILDING' THEN 'NATION_1' END AS first_department, CASE WHEN d IS NOT NULL THEN 'declared' WHEN r < 5 THEN 'province' WHEN buyer_locality = 'BUILDING' THEN 'district' ELSE '' END AS s FROM placed
), modes AS (
  SELECT buyer_id, first(first_department ORDER BY n DESC, first_department) AS m FROM (SELECT buyer_id, first_department, count(*) AS n FROM located WHERE first_department IS NOT NULL GROUP BY ALL) GROUP BY buyer_id
), valid AS (
  SELECT located.*, coalesce(first_department, m) AS department, CASE WHEN first_department IS NULL AND m IS NOT NULL THEN 'same entity' ELSE s END AS department_source, s = 'declared' AND r < 5 AND 'NATION_' || r <> d AS location_off FROM located LEFT JOIN modes USING (buyer_id)
)"""


@query(f"""WITH {_VALID} SELECT ocid, segment AS month, CASE category WHEN 'BUILDING' THEN 'Works' ELSE 'Sin categoría' END AS category_name, amount_source, round(final, 2) AS amount_local, coalesce(c, 0) = 0 AS amount_missing, coalesce(final, 0) > 0 AS amount_valid,
shown AS description_clean, own = '' AS description_empty, own = '' AND item_descriptions <> '' AS description_rescued, own <> '' AND length(own) < 15 AS description_short, department, department_source, coalesce(location_off, false) AS location_off FROM valid""")
def validated_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All validation rules in turn; what rules 2 to 5 leave of each process."""
    valid = _valid(spark, sf_dir)
    flags = ["amount_missing", "amount_valid", "description_clean", "description_empty", "description_rescued", "description_short", "department", "department_source"]
    return valid.select("ocid", "month", "category_name", "amount_source", F.round("amount_local", 2).alias("amount_local"), *flags, F.coalesce("location_off", F.lit(False)).alias("location_off"))


@query(f"""WITH {_VALID} SELECT count(*) AS rows, count(*) FILTER (coalesce(c, 0) = 0) AS amount_missing, count(*) FILTER (amount_source = 'awarded') AS amount_rescued, count(*) FILTER (NOT coalesce(final, 0) > 0) AS amount_invalid,
count(*) FILTER (currency <> 'PEN') AS foreign_currency, count(*) FILTER (own = '') AS description_empty, count(*) FILTER (own = '' AND item_descriptions <> '') AS description_rescued, count(*) FILTER (own <> '' AND length(own) < 15) AS description_short,
count(*) FILTER (location_off) AS location_off, count(*) FILTER (department IS NULL) AS no_department, count(*) FILTER (n_bidders IS NULL) AS no_bidders,
round(count(*) FILTER (amount_source = 'awarded') / greatest(1, count(*) FILTER (coalesce(c, 0) = 0)), 4) AS amount_rescue_rate, round(avg((department IS NOT NULL)::INT), 4) AS located_rate FROM valid""")
def quality_report_of_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's counts of rules 2 to 5, from the whole pipeline."""
    names = "rows amount_missing amount_rescued amount_invalid foreign_currency description_empty description_rescued description_short location_off no_department no_bidders amount_rescue_rate located_rate".split()
    return P.quality_report(_valid(spark, sf_dir)).select(*names)


@query("""WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, n_name AS department, c_mktsegment AS category, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS amount, o_orderstatus = 'F' AS single
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT * FROM p WHERE category IN ('BUILDING', 'MACHINERY') AND amount >= 10000 AND amount < 1000000)
SELECT dimension, value, count(*) AS processes, round(sum(amount), 2) AS amount, round(avg(single::INT), 4) AS single_rate
FROM (SELECT 'month' AS dimension, month AS value, * FROM s UNION ALL SELECT 'department', department, * FROM s UNION ALL SELECT 'category', category, * FROM s) GROUP BY ALL""")
def dashboard_from_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube of all orders, written by month; the tables of one selection from its cells."""
    buyers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    processes = orders.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("n_name").alias("department"), F.col("c_mktsegment").alias("category"), F.col("o_totalprice").alias("amount"),
        (F.col("o_orderkey") % 5 != 0).alias("amount_valid"), (F.col("o_orderstatus") == "F").alias("single_bid"), F.col("o_custkey").cast("string").alias("buyer_id"),
    )
    path = new_path(spark, "cube")
    cube.write_cube(processes, path)
    chosen = cube.Selection(categories=["BUILDING", "MACHINERY"], amount_from=1e4, amount_below=1e6)
    return cube.tables(cube.read_cube(spark, path), chosen).filter("dimension <> 'band'").select("dimension", "value", "processes", "amount", "single_rate")
