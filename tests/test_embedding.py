import os
import random
import time

import numpy as np
import pytest

from lodestar.operators import embedding as E
from lodestar.operators.index import embedded

TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")


def a_tokenizer():
    return os.path.join(TOKENIZERS, "byte_bpe_50k.json")


def model(seen=None):
    def run(texts):
        if seen is not None:
            seen.append(texts)
        return [[float(len(t)), float(sum(map(ord, t)) % 97), 1.0] for t in texts]

    return run


def test_vectors_have_length_one_and_keep_their_order():
    r = random.Random(2)
    seen = []
    made = E.LocalEmbedder(model(seen), "m", a_tokenizer(), batch=4)
    texts = [" ".join(r.choice(["uno", "dos", "tres", "漢字", "é"]) for _ in range(r.randrange(60))) for _ in range(30)] + [""]
    got = made.passages(texts)
    want = E.normalised(model()(["passage: " + t for t in texts]))
    np.testing.assert_allclose(got, want, rtol=1e-6)
    np.testing.assert_allclose(np.linalg.norm(got, axis=1), 1.0, rtol=1e-6)
    assert max(map(len, seen)) == 4
    lengths = [made.tokens(t) for part in seen for t in part]
    assert lengths == sorted(lengths)
    assert made.query("x") == pytest.approx(E.normalised(model()(["query: x"]))[0].tolist())
    assert E.normalised([[0.0, 0.0], [3.0, 4.0]]).tolist() == [[0.0, 0.0], pytest.approx([0.6, 0.8])]


@pytest.mark.parametrize("text", ["word " * 2000, "漢字" * 900, "🙂" * 700, "a" * 9000, "é́" * 800])
@pytest.mark.parametrize("limit", [512, 16])
def test_token_limit(text, limit):
    seen = []
    made = E.LocalEmbedder(model(seen), "m", a_tokenizer(), limit=limit)
    made.passages([text, "short"])
    sent = [t for part in seen for t in part]
    (long,) = (t for t in sent if t != "passage: short")
    assert ("passage: " + text).startswith(long) and len(sent) == 2
    assert limit - 8 <= made.tokens(long) <= limit


def test_column_of_a_local_model(spark):
    path = a_tokenizer()
    texts = [f"text {i} " * (i % 7) for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = {r["id"]: r["embedding"] for r in embedded(df, "text", lambda: E.LocalEmbedder(model(), "m", path)).collect()}
    want = E.normalised(model()(["passage: " + t for t in texts]))
    np.testing.assert_allclose([got[i] for i in range(50)], want, rtol=1e-6)


class Api:
    """A client that fails on some texts, and leaves a note of each call."""

    name = "api"

    def __init__(self, folder, fail=()):
        self.folder, self.fail = folder, fail

    def tokens(self, text):
        return len(text.split())

    def passages(self, texts):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as note:
            note.write(texts[0])
        if any(t in self.fail for t in texts):
            raise OSError("refused key sk-abc123")
        return [[float(len(t)), 1.0] for t in texts]


def test_rows_and_calls_of_an_api(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    df = spark.createDataFrame([(i, f"text {i}" if i % 9 else None, {"k": [i]}) for i in range(40)], "id int, text string, more map<string,array<int>>").repartition(2)
    out = E.embedded_with_log(df, "text", lambda: Api(str(notes)), str(tmp_path / "rows"), str(tmp_path / "log"), batch=6, price=2.0)
    rows = {r["id"]: r for r in out.collect()}
    assert len(rows) == 40 and all(rows[i]["embedding"] == [float(len(f"text {i}")) if i % 9 else 0.0, 1.0] and rows[i]["more"] == {"k": [i]} for i in rows)
    calls = E.read_calls(spark, str(tmp_path / "log")).collect()
    assert len(calls) == len(list(notes.iterdir())) and all(c["success"] and c["called_at"] and c["latency_s"] >= 0 for c in calls)
    assert sum(c["tokens_in"] for c in calls) == 2 * 35 and sum(int(c["question"].split()[0]) for c in calls) == 40
    assert sum(c["cost_usd"] for c in calls) == pytest.approx(70 * 2 / 1e6)


def test_a_failing_batch_is_logged_once_and_then_raised(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    df = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "id int, text string").coalesce(1)
    log = str(tmp_path / "log")
    with pytest.raises(E.EmbeddingFailed, match="1 calls failed"):
        E.embedded_with_log(df, "text", lambda: Api(str(notes), {"text 12"}), str(tmp_path / "rows"), log, batch=5)
    calls = E.read_calls(spark, log).orderBy("called_at").collect()
    assert [c["success"] for c in calls] == [True, True, False] and len(list(notes.iterdir())) == 3
    assert "sk-[hidden]" in calls[-1]["error"] and "abc123" not in calls[-1]["error"]


class Breaking(Api):
    """An API behind a task whose first attempt dies after its calls."""

    def passages(self, texts):
        out = super().passages(texts)
        marker = f"{self.folder}/../died"
        if texts[0] == "text 20" and not os.path.exists(marker):
            open(marker, "w").close()
            time.sleep(0.2)
            os._exit(1)
        return out


def test_two_executors_and_a_lost_attempt(tmp_path):
    """In a session of its own: two executors, whose worker dies once after it has called."""
    import subprocess
    import sys

    script = tmp_path / "job.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from lodestar.operators import embedding as E
from tests.test_embedding import Breaking
import tests.test_embedding, pyspark.cloudpickle as cp
cp.register_pickle_by_value(tests.test_embedding)
spark = SparkSession.builder.master("local-cluster[2,1,700]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path / "wh")!r}).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
df = spark.createDataFrame([(i, f"text {{i}}") for i in range(40)], "id int, text string").repartitionByRange(4, "id")
out = E.embedded_with_log(df, "text", lambda: Breaking({str(tmp_path / "notes")!r}), {str(tmp_path / "rows")!r}, {str(tmp_path / "log")!r}, batch=5)
calls = E.read_calls(spark, {str(tmp_path / "log")!r})
print("RESULT", out.filter("embedding is not null").count(), calls.count(), calls.selectExpr("sum(tokens_in)").first()[0])
spark.stop()
""")
    (tmp_path / "notes").mkdir()
    done = subprocess.run(["timeout", "240", sys.executable, str(script)], capture_output=True, text=True, cwd=tmp_path)
    assert (tmp_path / "died").exists(), done.stderr[-2000:]
    line = next((x for x in done.stdout.splitlines() if x.startswith("RESULT")), done.stderr[-2000:])
    rows, calls, tokens = map(int, line.split()[1:])
    assert rows == 40 and tokens == 80
    # more calls were made than the log keeps: those of the attempt that was lost
    assert calls <= len(list((tmp_path / "notes").iterdir())) - 1
