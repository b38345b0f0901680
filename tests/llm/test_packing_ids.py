import functools
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from lodestar.llm.packing import Encoder, default_tokenizer, encoder, pack_documents
from tests.llm.cases import prose, texts

END = "<|endoftext|>"


@functools.cache
def json_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_json_tokenizer():
    t, encode = json_tokenizer(), Encoder(default_tokenizer())
    made = [END, END * 3, f" {END}", f"x{END}y", f"a  {END}\n\n b", f"{END}  ", f"<{END}>", "<|endoftext|", "<|ENDOFTEXT|>", "<| endoftext |>", "é \x00\r\n" + END, prose(1, 900) + END + prose(2, 50)]
    made += [" a", "a ", "a\n b", "a \n b", "a\u00a0 b \u3000c", "a\x1c b", "it 's  we'll 漢 字 12 3", "x" * 3000 + " y", " ".join("ab" * n for n in range(1, 60)), " " * 1_000_000, "z" * 100_000]
    assert np.frombuffer(encode.many(pa.array([f"a {END} b"]))[0], "<u4").tolist() == [64, 220, 50256, 275]
    everything = [*made, *(x or "" for x in texts())]
    for _ in range(2):  # cuts unknown, then known
        ids, at = encode.many(pa.array(everything))
        for i, text in enumerate(everything):
            assert np.frombuffer(ids[at[i] : at[i + 1]], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:80]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ é漢9.'\n\t\r\x1c\x85\u00a0\u2003<|>"), max_size=30), min_size=1, max_size=5))
def test_cuts_never_change_ids(made):
    t, encode = json_tokenizer(), encoder(default_tokenizer())
    ids, at = encode.many(pa.array(["", *made])[1:])
    assert [np.frombuffer(ids[a:b], "<u4").tolist() for a, b in zip(at, at[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in made]


def test_pieces_with_added_tokens(spark):
    made = [(1, f"a {END} b"), (2, f"{prose(3, 2000)}{END}{prose(4, 300)}"), (3, END)]
    t = json_tokenizer()
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], dtype="<u4") for i, x in made}
    got = pack_documents(spark.createDataFrame(made, "doc_id long, text string")).collect()
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert all(sum(r.length for r in got if r.doc_id == i) == len(ids[i]) for i in ids)


class Small(Encoder):
    KNOWN, AT_ONCE = 60, 7

    def ids(self, text):
        self.asked.append(text)
        return super().ids(text)


def test_known_cuts_and_what_is_encoded_at_once_stay_bounded():
    t, encode = json_tokenizer(), Small(default_tokenizer())
    for turn in range(3):
        encode.asked = []
        made = [" ".join(f"often{j % 5} once{turn}x{i}x{j}" for j in range(40)) + " " + "long" * 30 for i in range(12)]
        ids, at = encode.many(pa.array(made))
        assert [np.frombuffer(ids[a:b], "<u4").tolist() for a, b in zip(at, at[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in made]
        assert max(len(x.split()) for x in encode.asked) <= Small.AT_ONCE
        assert len(encode.cuts) == len(encode.parts) == len(encode.met) <= Small.KNOWN
        assert {f"often{k}" for k in range(5)} <= set(encode.cuts.to_pylist()) and max(map(len, encode.cuts.to_pylist())) <= Small.LONGEST
        # each text's first cut goes alone; other frequent cuts are not asked for again
        assert turn == 0 or not any("often" in x for x in encode.asked if x.startswith(" "))
