"""The vector table: what must be embedded, what is stale, and its replacement.

The table has a folder per model and chunk configuration.  Its rows lie in
buckets by the hash of their id; a commit file per version names the folders of
every bucket.  ``build`` finds what changed in one pass, writes new folders for
the buckets that hold a change, and then puts the next commit file in place by
one rename.  Texts are dealt out once, to their buckets: what follows reads and
writes bucket by bucket.  Readers take the last commit file, so they see a whole version
before and after, and a build that breaks changes nothing for them.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from lodestar.functions.dates import day_number, utc_timestamp
from lodestar.functions.text import blank, record_hash
from lodestar.sources.tables import files_of


class Embedder(Protocol):
    """What turns texts into vectors of length 1; loaded once per worker."""

    name: str

    def passages(self, texts: list[str]) -> list[list[float]]: ...

    def query(self, text: str) -> list[float]: ...

    def tokens(self, text: str) -> int: ...


EMBEDDERS: dict[str, Callable[[], Embedder]] = {}


def embedder(key: str) -> Embedder:
    """The embedder registered under ``key``."""
    if key not in EMBEDDERS:
        raise KeyError(f"no embedder {key}; known: {', '.join(sorted(EMBEDDERS)) or 'none'}")
    return EMBEDDERS[key]()


def prefixed(model: Callable[[list[str]], list[list[float]]], name: str, batch: int = 32, passage: str = "passage: ", query: str = "query: ", count: Callable[[str], int] = lambda t: len(t.split())) -> Embedder:
    """An embedder from a model that wants its inputs marked, asked in batches."""

    class Marked:
        def passages(self, texts: list[str]) -> list[list[float]]:
            return [v for i in range(0, len(texts), batch) for v in model([passage + t for t in texts[i : i + batch]])]

        def query(self, text: str) -> list[float]:
            return model([query + text])[0]

        def tokens(self, text: str) -> int:
            return count(text)

    out = Marked()
    out.name = name
    return out


def logged(inner: Embedder, log: Callable[[dict], None], batch: int = 100) -> Embedder:
    """An embedder behind an API: every batch is logged; a failure is logged, then raised.

    For calls from the driver, as single queries are: inside tasks ``log``
    would reach a worker's copy, so columns go through
    ``embedding.embedded_with_log``.
    """

    class Logged:
        name = inner.name

        def _call(self, what: str, run: Callable, texts: list[str]):
            row = {"model": inner.name, "tokens_in": sum(map(inner.tokens, texts)), "question": what}
            try:
                out = run()
            except Exception as error:
                log(row | {"success": False, "error": f"{type(error).__name__}: {error}"[:200]})
                raise
            log(row | {"success": True})
            return out

        def passages(self, texts: list[str]) -> list[list[float]]:
            parts = [texts[i : i + batch] for i in range(0, len(texts), batch)]
            return [v for part in parts for v in self._call(f"{len(part)} passages", lambda part=part: inner.passages(part), part)]

        def query(self, text: str) -> list[float]:
            return self._call("query", lambda: inner.query(text), [text])

        def tokens(self, text: str) -> int:
            return inner.tokens(text)

    return Logged()


def embedded(df: DataFrame, text: str, make: Callable[[], Embedder], output: str = "embedding") -> DataFrame:
    """``df`` with the vectors of ``text``; ``make`` runs once per task."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(model.passages(batch.fillna("").tolist()))

    return df.withColumn(output, vectors(text))


def process_metadata(processes: DataFrame) -> dict[str, Column]:
    """What the index keeps of a process; nulls stay nulls."""
    return {
        "department": F.col("department"),
        "amount": F.when(F.col("amount_valid"), F.col("amount_local")),
        "amount_valid": F.col("amount_valid"),
        "day": day_number(utc_timestamp(F.col("published_at"))),
        "month": F.col("month"),
        "category": F.col("category_name"),
        "buyer": F.col("buyer_name_clean"),
        "buyer_id": F.col("buyer_id"),
        "method": F.col("method"),
        "states": F.col("item_states"),
        "n_bidders": F.col("n_bidders"),
    }


def to_index(rows: DataFrame, id_column: str, text: str, metadata: dict[str, Column], keep: Column | None = None) -> DataFrame:
    """(id, text, metadata..., hash) of the rows that are kept and have a text."""
    chosen = rows.filter(~blank(F.col(text)) & (F.lit(True) if keep is None else keep))
    return chosen.select(F.col(id_column).alias("id"), F.col(text).alias("text"), *(c.alias(k) for k, c in metadata.items()), record_hash(F.col(text), metadata).alias("hash"))


def pending(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Rows that are new or have changed: no indexed row of that id and hash."""
    return current.join(indexed.select("id", "hash"), ["id", "hash"], "left_anti")


def stale(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Indexed ids that are no longer there."""
    return indexed.join(current.select("id"), "id", "left_anti").select("id")


def upsert_counts(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: rows to index, already there, inserted or updated, deleted, total after; one join."""
    a = current.select("id", F.col("hash").alias("new_hash"))
    b = indexed.select("id", F.col("hash").alias("old_hash"))
    both = a.join(b, "id", "full_outer")
    same = F.coalesce(F.col("new_hash") == F.col("old_hash"), F.lit(False))
    return both.agg(
        F.count("new_hash").alias("to_index"),
        F.count_if(same).alias("already_there"),
        F.count_if(F.col("new_hash").isNotNull() & ~same).alias("upserted"),
        F.count_if(F.col("new_hash").isNull()).alias("deleted"),
        F.count("new_hash").alias("total"),
    )


def index_path(root: str, model: str, configuration: str) -> str:
    return f"{root.rstrip('/')}/{model}__{configuration}"


#: Parts that rows are dealt to by id; fixed when a table is first built.
BUCKETS = 256


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions of a table, in order."""
    where, files = files_of(spark, f"{path}/commits")
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d{6})\.json", n)))


def committed(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """A version's commit: schema, number of buckets, and the folder of each bucket that has rows."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        return None
    return json.loads(_read(spark, f"{path}/commits/{known[-1] if version is None else version:06d}.json"))


def _read(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def commit(spark: SparkSession, path: str, version: int, entry: dict) -> None:
    """Puts a commit file in place by one rename; of two writers of one version the later fails."""
    draft, files = files_of(spark, f"{path}/commits/.{version:06d}-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
    out.close()
    final = files_of(spark, f"{path}/commits/{version:06d}.json")[0]
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError(f"version {version} of {path} was committed by another build")


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


#: Shares of a bucket that tasks work on.
SHARES = 4


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` by ``bucket`` and ``_share`` of the ids, each in one task."""
    share = F.pmod(F.shiftrightunsigned(F.xxhash64("id"), 32), F.lit(SHARES)).cast("int")
    return df.withColumns({"bucket": _bucket(buckets), "_share": share}).repartition("bucket", "_share")


def _folders(entry: dict, bucket: str) -> list[str]:
    """A bucket's folders; commits of before name one without a list."""
    named = entry["folders"][bucket]
    return [named] if isinstance(named, str) else named


def _rows(spark: SparkSession, path: str, entry: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(entry["schema"])
    folders = [f"{path}/{folder}" for b in entry["folders"] if buckets is None or int(b) in buckets for folder in _folders(entry, b)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def open_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table's last version (or an earlier one), read only; it must be there."""
    if (entry := committed(spark, path, version)) is None:
        raise FileNotFoundError(f"no index in {path}")
    return _rows(spark, path, entry)


def _changes(current: DataFrame, indexed: DataFrame | None, buckets: int) -> DataFrame:
    """What differs: rows of ``current`` to put, ids to drop, and ids with two contents, each with its bucket.

    Indexed rows come as ids and hashes among those of ``current``, all dealt by bucket; windows over an id need no other order.
    """
    both = current.withColumn("_old", F.lit(None).cast("string"))
    if indexed is not None:
        both = both.unionByName(indexed.select("id", F.col("hash").alias("_old")), allowMissingColumns=True)
    in_order = W.partitionBy("bucket", "_share", "id").orderBy(F.asc_nulls_last("hash"))
    whole = in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    old = F.max("_old").over(whole)
    what = F.when(F.min("hash").over(whole) < F.max("hash").over(whole), "clash").when(F.col("hash").isNull(), "drop").when(old.isNull() | (old != F.col("hash")), "put")
    seen = _dealt(both.filter("id IS NOT NULL"), buckets).withColumns({"what": what, "_n": F.row_number().over(in_order)}).filter("_n = 1 AND what IS NOT NULL")
    return seen.drop("_n", "_old", "_share").select(*current.columns, "what", "bucket")


def _unchanged(old: DataFrame, changes: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``old`` whose ids are not among ``changes``, by bucket."""
    both = old.withColumn("_gone", F.lit(None).cast("boolean")).unionByName(changes.select("id", F.lit(True).alias("_gone")), allowMissingColumns=True)
    gone = F.max("_gone").over(W.partitionBy("bucket", "_share", "id"))
    return _dealt(both, buckets).withColumn("_any", gone).filter("_any IS NULL").select(*old.columns, "bucket")


def _staged(spark: SparkSession, path: str, schema: T.StructType) -> list[str]:
    """Bucket folders of embedded rows that earlier steps, of a build that broke, have finished: those that ``staging`` names."""
    where, files = files_of(spark, f"{path}/staging")
    if not files.exists(where):
        return []
    names = sorted(m[1] for f in files.listStatus(where) if (m := re.fullmatch(r"rows-(\w+)", f.getPath().getName())))
    done = [f"{path}/data/{n}" for n in names if files.exists(files_of(spark, f"{path}/data/{n}/_SUCCESS")[0])]
    parts = {d: [f"{d}/bucket={b}" for b in _written(spark, d)] for d in done}
    kinds = {f.name: f.dataType for f in schema}
    # rows with other columns are of another table
    return [f for some in parts.values() if some and {f.name: f.dataType for f in spark.read.parquet(some[0]).schema} == kinds for f in some]


def _written(spark: SparkSession, folder: str) -> list[int]:
    """The buckets that have rows in a folder of data."""
    where, files = files_of(spark, folder)
    return [int(f.getPath().getName().split("=")[1]) for f in files.listStatus(where) if f.isDirectory() and "bucket=" in f.getPath().getName()]


def build(current: DataFrame, path: str, make: Callable[[], Embedder], steps: int = 8, buckets: int = BUCKETS) -> DataFrame:
    """Brings the table in ``path`` up to ``current`` (id, text, metadata..., hash) and returns it.

    ``current`` is read once; everything after that reads the changes alone.
    They are embedded in ``steps``, each written to data of its own that
    ``staging`` names: a build that broke goes on with what is not there yet.
    Buckets without a change keep their folders.  With nothing changed no
    version is written.

    Defined results: rows without an id are left out; repeated rows of one id
    and hash are one row; an id with two hashes is refused before anything is
    embedded; a table with other metadata columns than ``current`` is built anew.
    """
    spark, staging = current.sparkSession, f"{path}/staging"
    entry, known = committed(spark, path), versions(spark, path)
    wanted = [f.name for f in current.schema.fields] + ["embedding"]
    if entry is not None and [f["name"] for f in entry["schema"]["fields"]] != wanted:
        entry = None
    buckets = entry["buckets"] if entry else buckets
    indexed = _rows(spark, path, entry) if entry else None
    found = f"{staging}/changes-{uuid.uuid4().hex}"
    rows = _changes(current, indexed, buckets)
    rows.write.option("compression", "zstd").partitionBy("bucket").parquet(found)
    changes = spark.read.schema(rows.schema).parquet(found)
    touched = {r["bucket"]: r["puts"] for r in changes.groupBy("bucket").agg(F.count_if(F.col("what") == "put").alias("puts")).collect()}
    if clash := changes.filter("what = 'clash'").select("id").limit(3).collect():
        _removed(spark, found)
        raise ValueError(f"ids with more than one content: {', '.join(str(r['id']) for r in clash)}")
    if not touched and entry:
        _removed(spark, staging)
        return indexed

    puts = changes.filter("what = 'put'").drop("what")
    schema = T.StructType([*(f for f in puts.schema if f.name != "bucket"), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    written: list[str] = []

    def write(df: DataFrame) -> None:
        """A folder of data with the rows of ``df`` by bucket; of a build that breaks the next one finds it."""
        name = uuid.uuid4().hex
        where, files = files_of(spark, f"{staging}/rows-{name}")
        files.create(where, False).close()
        df.select(*wanted, "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/data/{name}")
        written.append(f"data/{name}")

    ready = _staged(spark, path, schema)
    done = spark.read.schema(schema).parquet(*ready) if ready else None
    for step in range(steps):
        todo = puts.filter(F.col("bucket") % steps == step)
        if done is not None:
            todo = todo.join(done.select("id", "hash"), ["id", "hash"], "left_anti")
        write(embedded(todo, "text", make))
    if done is not None:
        write(_dealt(done.join(puts.select("id", "hash"), ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"]), buckets))
    if entry:
        write(_unchanged(_rows(spark, path, entry, list(touched)), changes, buckets))
    folders = {b: f for b, f in entry["folders"].items() if int(b) not in touched} if entry else {}
    for name in written:
        for b in sorted(_written(spark, f"{path}/{name}")):
            folders.setdefault(str(b), []).append(f"{name}/bucket={b}")
    commit(spark, path, (known or [0])[-1] + 1, {"buckets": buckets, "folders": folders, "schema": schema.jsonValue()})
    _removed(spark, staging)
    return open_index(spark, path)


def _removed(spark: SparkSession, path: str) -> None:
    where, files = files_of(spark, path)
    files.delete(where, True)


def vacuumed(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes data that none of the last ``keep`` versions names, and older commits; returns the folders deleted.

    For a time when no build runs and no reader is on an older version.
    """
    known = versions(spark, path)
    named = {folder for v in known[-keep:] for entry in [committed(spark, path, v)] for b in entry["folders"] for folder in _folders(entry, b)}
    gone = 0
    for v in known[:-keep]:
        _removed(spark, f"{path}/commits/{v:06d}.json")
    where, files = files_of(spark, f"{path}/data")
    for build_folder in files.listStatus(where) if files.exists(where) else []:
        name = build_folder.getPath().getName()
        for bucket in files.listStatus(build_folder.getPath()):
            if bucket.isDirectory() and f"data/{name}/{bucket.getPath().getName()}" not in named:
                files.delete(bucket.getPath(), True)
                gone += 1
    return gone


def refreshed(current: DataFrame, indexed: DataFrame | None, make: Callable[[], Embedder]) -> DataFrame:
    """The whole new table: unchanged rows keep their vectors, changed ones are embedded.

    Written to a new folder, so a run that breaks leaves the old table; running
    again with nothing changed embeds nothing.
    """
    if indexed is None:
        return embedded(current, "text", make)
    kept = indexed.join(current.select("id", "hash"), ["id", "hash"], "left_semi").select(*indexed.columns)
    return kept.unionByName(embedded(pending(current, indexed), "text", make).select(*indexed.columns))
