"""The nearest rows of many queries: matrix products over Arrow batches, and a layout by cells.

A task multiplies blocks of its rows with blocks of the queries and keeps
``k`` candidates a query, so what leaves it is bounded by the queries and not
by the rows.  Candidates within ``MARGIN`` of the last place have their
similarity taken again, entry by entry in one order, so equal vectors have
equal similarities wherever they are read, and ties go to the smaller id.

The layout puts every row into the cell of its nearest centroid, one folder a
cell.  A search reads the folders of the cells that its queries probe; with
all cells probed it is the exact search.

Defined results: rows without a vector, or with one of another length than the
queries', are no candidates; a null or other-length query has no rows; equal
query ids are searched each on their own and ranked together; null ids come
first on a tie; fewer than ``k`` rows give what there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from lodestar.sources.tables import kept

#: Queries that are sent to every task at once; more are searched in turns, each turn's hits written before the next.
MOST_BROADCAST = 10_000
#: Rows and queries of one matrix product.
ROWS, QUERIES = 4096, 1024
MARGIN = 1e-9
#: Vectors that centroids are fitted on: so many for each cell.
SAMPLE_PER_CELL = 64
#: Rows that ask when the number of probes is measured.
TRIED = 256


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, doubles) of the vectors of length ``dim`` without a null or a NaN entry."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    whole = ~np.isnan(values).any(axis=1)
    return rows[whole], values[whole]


class Best:
    """The ``k`` best rows of every query so far: (query, similarity, place in ``rows``)."""

    def __init__(self, queries: np.ndarray, k: int, order: int) -> None:
        self.queries, self.k, self.order = queries, k, order
        self.query, self.score = np.zeros(0, np.int64), np.zeros(0)
        self.rows: pa.Table | None = None
        self.floor = np.full(len(queries), -np.inf)

    def add(self, vectors: np.ndarray, rows: pa.Table, asked: np.ndarray | None = None) -> None:
        """Takes in ``rows`` with their vectors, for the queries ``asked`` (all if None)."""
        asked = np.arange(len(self.queries)) if asked is None else asked
        for a in range(0, len(vectors), ROWS):
            block = vectors[a : a + ROWS]
            found = [self._close(block, asked[b : b + QUERIES]) for b in range(0, len(asked), QUERIES)]
            query, row = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            if len(query):
                self._merge(query, np.einsum("nd,nd->n", block[row], self.queries[query]), rows.slice(a, ROWS), row)

    def _close(self, block: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores = self.queries[asked] @ block.T
        floor = self.floor[asked]
        if len(block) > self.k and np.isinf(floor).any():
            floor = np.maximum(floor, np.partition(scores, len(block) - self.k, axis=1)[:, len(block) - self.k])
        query, row = np.nonzero(scores >= (floor - MARGIN)[:, None])
        return asked[query], row

    def _merge(self, query: np.ndarray, score: np.ndarray, rows: pa.Table, row: np.ndarray) -> None:
        used, place = np.unique(row, return_inverse=True)
        fresh, before = rows.take(pa.array(used)), 0
        if self.rows is not None:
            before, fresh = self.rows.num_rows, pa.concat_tables([self.rows, fresh])
        both = np.concatenate([np.arange(len(self.query)) if not before else self._place, before + place])
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ranks = pc.rank(fresh.column(self.order).combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
        order = np.lexsort((ranks[both], -score, query))
        query, score, both = query[order], score[order], both[order]
        starts = np.searchsorted(query, query)
        best = np.arange(len(query)) - starts < self.k
        self.query, self.score, both = query[best], score[best], both[best]
        used, self._place = np.unique(both, return_inverse=True)
        self.rows = fresh.take(pa.array(used)).combine_chunks()
        counts = np.bincount(self.query, minlength=len(self.queries))
        full = np.flatnonzero(counts == self.k)
        self.floor[full] = self.score[np.cumsum(counts)[full] - 1]

    def hits(self) -> tuple[np.ndarray, np.ndarray, pa.Table] | None:
        return (self.query, self.score, self.rows.take(pa.array(self._place))) if self.rows is not None else None


def _scan(rows: DataFrame, vector: str, queries: np.ndarray, k: int, order: str, probes: np.ndarray | None = None, cell: str | None = None) -> DataFrame:
    """(all columns of ``rows`` but ``cell``, _query int, similarity) of each task's candidates.

    ``probes`` (queries x cells, true where a query looks) limits queries to rows of their cells.
    """
    if not isinstance(rows.schema[vector].dataType.elementType, T.FloatType | T.DoubleType):
        rows = rows.withColumn(vector, F.col(vector).cast("array<double>"))
    sent = rows.sparkSession.sparkContext.broadcast((queries, probes))
    names = [c for c in rows.columns if c != cell]
    at = names.index(order)
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("_query", T.IntegerType()), T.StructField("similarity", T.DoubleType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, probes = sent.value
        found = Best(queries, k, at)
        for batch in batches:
            numbers, vectors = matrix(batch.column(batch.schema.names.index(vector)), queries.shape[1])
            table = pa.Table.from_batches([batch]).select(names).take(pa.array(numbers))
            if probes is None:
                found.add(vectors, table)
                continue
            cells = batch.column(batch.schema.names.index(cell)).to_numpy(zero_copy_only=False)[numbers]
            for c in np.unique(cells):
                inside = np.flatnonzero(cells == c)
                found.add(vectors[inside], table.take(pa.array(inside)), np.flatnonzero(probes[:, int(c)]))
        if hits := found.hits():
            query, score, table = hits
            table = table.append_column("_query", pa.array(query, pa.int32())).append_column("similarity", pa.array(score))
            yield from table.combine_chunks().to_batches()

    return rows.mapInArrow(best, schema)


def nearest_to(rows: DataFrame, vector: list[float], k: int, id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` rows most similar to one vector, with all their columns, best first."""
    found = _scan(rows, vector_column, np.array([vector], dtype=np.float64), k, id_column)
    return found.drop("_query").orderBy(F.desc("similarity"), F.asc(id_column)).limit(k)


def _turns(queries: DataFrame, query_id: str) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, vectors) of at most ``MOST_BROADCAST`` queries, one turn in memory at a time."""
    from pyspark.sql.pandas.types import to_arrow_type

    chosen = queries.select(F.col(query_id), F.col("vector").cast("array<double>"))
    kind, held = to_arrow_type(chosen.schema[query_id].dataType), []
    for row in chosen.toLocalIterator():
        held.append(row)
        if len(held) == MOST_BROADCAST:
            yield pa.array([r[0] for r in held], kind), pa.array([r[1] for r in held], pa.list_(pa.float64()))
            held = []
    if held:
        yield pa.array([r[0] for r in held], kind), pa.array([r[1] for r in held], pa.list_(pa.float64()))


def _length(vectors: pa.Array) -> int:
    """The commonest length of vectors with entries, the longer on a tie; 0 without any."""
    counts = pc.value_counts(pc.list_value_length(vectors)).to_pylist()
    return max(((c["counts"], c["values"]) for c in counts if c["values"]), default=(0, 0))[1]


def ranked(hits: DataFrame, k: int, query_id: str, id_column: str) -> DataFrame:
    """The ``k`` first of every query among all tasks' candidates; Spark keeps ``k`` a task before it shuffles."""
    order = W.partitionBy(query_id).orderBy(F.desc("similarity"), F.asc(id_column))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched(rows: DataFrame, queries: DataFrame, k: int, query_id: str, id_column: str, vector_column: str, layout: Cells | None = None, probes: int = 0) -> DataFrame:
    """(query_id, id, similarity, rank), a scan for each turn of the queries."""
    spark, dim, last, done = rows.sparkSession, None, None, []
    columns = [id_column, vector_column, *(["cell"] if layout else [])]
    for ids, vectors in _turns(queries, query_id):
        if last is not None:
            done.append(kept(last, "nearest"))
        dim = dim or _length(vectors)
        numbers, asked = matrix(vectors, dim) if dim else (np.zeros(0, np.int64), np.zeros((0, 1)))
        looks = layout.probed(asked, probes) if layout else None
        scanned = rows if looks is None else rows.filter(F.col("cell").isin(np.flatnonzero(looks.any(axis=0)).tolist()))
        found = _scan(scanned.select(*columns), vector_column, asked, k, id_column, looks, "cell" if layout else None)
        names = spark.createDataFrame(pa.table({"_query": pa.array(range(len(numbers)), pa.int32()), query_id: ids.take(pa.array(numbers))}), T.StructType([T.StructField("_query", T.IntegerType()), queries.schema[query_id]]))
        last = found.select("_query", id_column, "similarity").join(F.broadcast(names), "_query").select(query_id, id_column, "similarity")
    if last is None:
        last = spark.createDataFrame([], T.StructType([queries.schema[query_id], rows.schema[id_column], T.StructField("similarity", T.DoubleType())]))
    for part in done:
        last = last.unionByName(part)
    return ranked(last, k, query_id, id_column)


def nearest_per_query(corpus: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id", id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` nearest of all rows for every query (query_id, vector)."""
    return _searched(corpus, queries, k, query_id, id_column, vector_column)


# ---------------------------------------------------------------- the layout by cells


@dataclass
class Cells:
    """A table laid out by the nearest of ``centroids``; rows without a usable vector are in cell -1."""

    path: str
    centroids: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def probed(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """(queries x cells): true for the ``probes`` nearest cells."""
        n = len(self.centroids)
        out = np.zeros((len(queries), n), dtype=bool)
        for a in range(0, len(queries), QUERIES):
            near = np.argsort(-(queries[a : a + QUERIES] @ self.centroids.T), axis=1, kind="stable")[:, : min(probes, n)]
            np.put_along_axis(out[a : a + QUERIES], near, True, axis=1)
        return out


def fit_centroids(corpus: DataFrame, cells: int, vector_column: str = "embedding", rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids by k-means on a sample of about ``SAMPLE_PER_CELL`` x ``cells`` distinct vectors, at most twice that.

    The sample is chosen by the vectors' own hash and holds copies once, so a
    vector that fills the table counts as one; the driver holds nothing else.
    """
    vector = F.col(vector_column).cast("array<double>")
    lengths = corpus.groupBy(F.size(vector_column).alias("d")).count().filter("d > 0").orderBy(F.desc("count"), F.desc("d")).collect()
    if not lengths:
        return np.zeros((0, 1))
    dim, n, wanted = lengths[0]["d"], lengths[0]["count"], SAMPLE_PER_CELL * cells
    mark = F.xxhash64(F.lit(seed), vector_column)
    sampled = corpus.filter(F.size(vector_column) == dim).withColumn("_mark", mark).filter(F.pmod("_mark", F.lit(1 << 32)) < F.lit(max(1, int(min(1.0, wanted / n) * (1 << 32)))))
    rows = sampled.select("_mark", vector.alias("v")).dropDuplicates(["_mark"]).orderBy("_mark").limit(2 * wanted).select("v").toArrow()
    _, points = matrix(rows.column("v").combine_chunks(), dim) if rows.num_rows else (None, np.zeros((0, dim)))
    points = points.astype(np.float32)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    if len(points) <= cells:
        return points.astype(np.float64)
    draw = np.random.default_rng(seed)
    centroids = points[draw.choice(len(points), cells, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(points[a : a + ROWS] @ centroids.T).argmax(axis=1) for a in range(0, len(points), ROWS)])
        order = np.argsort(own, kind="stable")
        counts = np.bincount(own, minlength=cells)
        filled = np.flatnonzero(counts)
        centroids[filled] = np.add.reduceat(points[order], np.concatenate([[0], np.cumsum(counts[filled])[:-1]]), axis=0)
        empty = np.flatnonzero(counts == 0)
        centroids[empty] = points[draw.choice(len(points), len(empty), replace=False)]
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids.astype(np.float64)


def assigned(corpus: DataFrame, centroids: np.ndarray, vector_column: str = "embedding") -> DataFrame:
    """``corpus`` with its ``cell``: every row's, -1 without a usable vector."""
    sent = corpus.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([*corpus.schema.fields, T.StructField("cell", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        for batch in batches:
            cell = np.full(batch.num_rows, -1, dtype=np.int32)
            if len(centroids):
                rows, vectors = matrix(batch.column(batch.schema.names.index(vector_column)), centroids.shape[1])
                for a in range(0, len(rows), ROWS):
                    cell[rows[a : a + ROWS]] = (vectors[a : a + ROWS] @ centroids.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return corpus.mapInArrow(place, schema)


def lay_out(corpus: DataFrame, path: str, cells: int | None = None, vector_column: str = "embedding") -> Cells:
    """Writes ``corpus`` by cells below ``path``; by default about the square root of its rows, at most 4,096.

    Rows meet by cell before they are written, and cells above Spark's advisory
    size, as those of a vector with very many copies, are split into several files.
    """
    spark = corpus.sparkSession
    cells = cells or max(1, min(4096, int(corpus.count() ** 0.5)))
    centroids = fit_centroids(corpus, cells, vector_column)
    by_cell = spark.sql("SELECT /*+ REBALANCE(cell) */ * FROM {rows}", rows=assigned(corpus, centroids, vector_column))
    by_cell.write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame(pa.table({"cell": pa.array(range(len(centroids)), pa.int32()), "centroid": pa.array(centroids.tolist(), pa.list_(pa.float64()))})).write.parquet(f"{path}/centroids")
    return Cells(path, centroids)


def open_cells(spark: SparkSession, path: str) -> Cells:
    """A layout that was written before; its centroids are at most 4,096 rows."""
    found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return Cells(path, np.array([r["centroid"] for r in found], dtype=np.float64).reshape(len(found), -1))


def probes_for(layout: Cells, spark: SparkSession, k: int, wanted: float = 0.9, id_column: str = "id", vector_column: str = "embedding", sample: int = TRIED, margin: float = 0.03) -> int:
    """The fewest cells to probe for a recall of ``wanted`` and a margin, as measured.

    About ``sample`` rows of the table, chosen by their vectors' hash, ask for
    their own nearest rows in one exact search; how far down each one's order
    of cells the found rows lie gives the recall of every number of probes.
    """
    rows = layout.table(spark)
    n = max(1, rows.count())
    mark = F.xxhash64(F.lit(11), vector_column)
    asking = rows.filter("cell >= 0").filter(F.pmod(mark, F.lit(1 << 32)) < F.lit(max(1, int(min(1.0, 2 * sample / n) * (1 << 32))))).dropDuplicates([vector_column]).orderBy(mark).limit(sample)
    asking = kept(asking.select(F.monotonically_increasing_id().alias("query_id"), F.col(vector_column).alias("vector")), "asking")
    truth = nearest_per_query(rows.filter("cell >= 0"), asking, k, id_column=id_column, vector_column=vector_column)
    cells = truth.join(rows.select(F.col(id_column), "cell"), id_column).select("query_id", "cell").collect()
    if not cells:
        return len(layout.centroids)
    vectors = {r["query_id"]: np.array(r["vector"], dtype=np.float64) for r in asking.collect()}
    places = np.empty((len(vectors), len(layout.centroids)), dtype=np.int64)
    row = {q: i for i, q in enumerate(vectors)}
    for q, i in row.items():
        places[i][np.argsort(-(layout.centroids @ vectors[q]), kind="stable")] = np.arange(len(layout.centroids))
    depth = np.sort([places[row[r["query_id"]], r["cell"]] for r in cells])
    return int(depth[min(len(depth) - 1, int(np.ceil(min(1.0, wanted + margin) * len(depth))) - 1)]) + 1


def nearest_in_cells(layout: Cells, queries: DataFrame, k: int, probes: int, query_id: str = "query_id", id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """As ``nearest_per_query``, among the rows of each query's ``probes`` nearest cells; only those folders are read."""
    return _searched(layout.table(queries.sparkSession), queries, k, query_id, id_column, vector_column, layout, probes)


def recall(found: DataFrame, truth: DataFrame, query_id: str = "query_id", id_column: str = "id") -> DataFrame:
    """(query_id, wanted, found, recall): how many of the true neighbours each query found."""
    hit = found.select(query_id, id_column).withColumn("_hit", F.lit(1))
    per = truth.select(query_id, id_column).join(hit, [query_id, id_column], "left").groupBy(query_id)
    return per.agg(F.count("*").alias("wanted"), F.count("_hit").alias("found")).withColumn("recall", F.col("found") / F.col("wanted"))
