"""Embedding whole columns: a local model under a token limit, and an API whose calls are logged.

A task holds one Arrow batch of texts.  The local model takes them in
micro-batches of like length, so little is padded, and the order is restored.
The API's answers and its calls leave a task as one stream: what a failed
attempt of a task has called is not kept, what the attempt that counts has
called is kept once, and the failure is raised when the log is on disk.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lodestar.operators.index import Embedder
from lodestar.schemas import CALL_LOG, names
from lodestar.sources.files import read_calls

Model = Callable[[list[str]], Sequence[Sequence[float]]]


def normalised(vectors: Sequence[Sequence[float]]) -> np.ndarray:
    """Rows of length 1; a row of zeros stays as it is."""
    rows = np.asarray(vectors, dtype=np.float64)
    rows = rows.reshape(len(rows), -1)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(size > 0, size, 1.0)).astype(np.float32)


class LocalEmbedder:
    """An embedder around ``model`` that marks its inputs, limits their tokens and normalises its output.

    Tokens are those of the tokenizer file in ``tokenizer``, special ones
    counted; a longer text ends after its last whole token within ``limit``.
    """

    def __init__(self, model: Model, name: str, tokenizer: str, limit: int = 512, batch: int = 32, passage: str = "passage: ", query: str = "query: ") -> None:
        from tokenizers import Tokenizer

        self.model, self.name, self.limit, self.batch, self.marks = model, name, limit, batch, (passage, query)
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = self.tokenizer.num_special_tokens_to_add(False)

    def tokens(self, text: str) -> int:
        return len(self.tokenizer.encode(text).ids)

    def cut(self, texts: list[str]) -> list[tuple[str, int]]:
        """(text within the limit, its tokens) of each."""
        room, out = self.limit - self.special, []
        for text, coded in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            n = len(coded.ids)
            # bytes of one character may be several tokens: a character that is cut goes
            while n > room:
                end = coded.offsets[room - 1][1] if coded.offsets[room][0] >= coded.offsets[room - 1][1] else coded.offsets[room - 1][0]
                text = text[:end]
                coded = self.tokenizer.encode(text, add_special_tokens=False)
                n = len(coded.ids)
            out.append((text, n + self.special))
        return out

    def _vectors(self, texts: list[str]) -> list[list[float]]:
        ready = self.cut(texts)
        order = sorted(range(len(ready)), key=lambda i: (ready[i][1], i))
        out: list = [None] * len(ready)
        for a in range(0, len(order), self.batch):
            part = order[a : a + self.batch]
            for i, v in zip(part, normalised(self.model([ready[i][0] for i in part])).tolist(), strict=True):
                out[i] = v
        return out

    def passages(self, texts: list[str]) -> list[list[float]]:
        return self._vectors([self.marks[0] + t for t in texts])

    def query(self, text: str) -> list[float]:
        return self._vectors([self.marks[1] + text])[0]


class EmbeddingFailed(RuntimeError):
    """Calls of an embedding job failed; the log that names them is already written."""


def masked(error: BaseException, most: int = 200) -> str:
    return re.sub(r"sk-[A-Za-z0-9*_\-]+", "sk-[hidden]", f"{type(error).__name__}: {error}")[:most]


def embedded_with_log(df: DataFrame, text: str, make: Callable[[], Embedder], path: str, log: str, batch: int = 100, price: float = 0.0) -> DataFrame:
    """``df`` with ``embedding``, written to ``path`` with every call's row, which then go to the call log ``log``.

    ``price`` is that of a million tokens.  After a failed call a task asks for
    nothing more and leaves the rest of its vectors null; ``EmbeddingFailed``
    is raised once the log is written.  Null and empty texts are embedded as
    the empty text.  A second run into the same ``path`` is refused by Spark.
    """
    spark = df.sparkSession
    rows = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    call = T.StructType.fromDDL(CALL_LOG)
    schema = T.StructType([T.StructField("row", rows), T.StructField("call", call)])
    fields = names(CALL_LOG)
    at = df.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        row_type, call_type = types.field("row").type, types.field("call").type
        model, failed = make(), False
        for whole in batches:
            vectors: list = []
            calls: list[dict] = []
            texts = whole.column(at).fill_null("").to_pylist()
            for part in (texts[a : a + batch] for a in range(0, len(texts), batch)):
                if failed:
                    vectors += [None] * len(part)
                    continue
                tokens, began = sum(map(model.tokens, part)), time.time()
                entry = dict.fromkeys(fields) | {"called_at": datetime.fromtimestamp(began, timezone.utc), "model": model.name, "tokens_in": tokens, "question": f"{len(part)} passages"}
                try:
                    got = [list(map(float, v)) for v in model.passages(part)]
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                except Exception as error:  # noqa: BLE001  whatever a client raises is logged
                    failed, got = True, [None] * len(part)
                    entry |= {"success": False, "error": masked(error), "cost_usd": 0.0}
                else:
                    entry |= {"success": True, "cost_usd": tokens * price / 1_000_000}
                calls.append(entry | {"latency_s": time.time() - began})
                vectors += got
            embedding = pa.array(vectors, pa.list_(pa.float32())).cast(row_type.field(len(row_type) - 1).type)
            body = pa.StructArray.from_arrays([*(c.cast(f.type) for c, f in zip(whole.columns, list(row_type)[:-1], strict=True)), embedding], fields=list(row_type))
            n, m = len(body), len(calls)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([body, pa.nulls(m, row_type)]), pa.concat_arrays([pa.nulls(n, call_type), pa.array(calls, call_type)])], schema=types)

    df.mapInArrow(work, schema).write.parquet(path)
    both = spark.read.schema(schema).parquet(path)
    calls = both.filter("call IS NOT NULL").select("call.*")
    calls.write.mode("append").parquet(log)
    failed = calls.filter("NOT success").agg(F.count("*").alias("n"), F.min("error").alias("error")).first()
    if failed["n"]:
        raise EmbeddingFailed(f"{failed['n']} calls failed, the first with {failed['error']}; see {log}")
    return both.filter("row IS NOT NULL").select("row.*")


__all__ = ["EmbeddingFailed", "LocalEmbedder", "embedded_with_log", "normalised", "read_calls"]
