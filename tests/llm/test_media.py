import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import media
from tests.llm.cases import documents, empty, rows


def test_round_trip_and_digests(spark):
    got = media.media_digest(documents(spark)).collect()
    assert len(got) == len(rows())
    want = {}
    for doc_id, text, *_ in rows():
        raw = (text or "").encode()
        n = max(576, -(-len(raw) // 576) * 576)
        payload = raw + b"\xff" * (n - len(raw))
        want[doc_id, len(raw)] = (n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    for r in got:
        assert want[r.doc_id, r.n_bytes] == (r.payload_bytes, r.payload_sha256, r.tail_crc32)
        assert r.media_bytes > r.payload_bytes
    same = [r for r in got if r.doc_id in (5, 6)]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1
    assert media.media_digest(empty(spark)).count() == 0


def test_columns_are_stored_and_read_back(spark):
    df = documents(spark)
    stored = media.decode_telephony(media.encode_telephony(df, "text"))
    r = stored.filter("doc_id = 3").first()
    codec, rate, _, data = media.unwav(bytes(r.media))
    assert data[:3] == b"one" and rate == 8000 and codec in media.CODECS
    kind, rate, _, pcm = media.unwav(bytes(r.pcm))
    assert (kind, rate) == (1, 16000) and len(pcm) >= 2 * 2 * 576
    clash = media.encode_telephony(df.withColumn("media", F.lit(1)), "text")
    assert clash.columns == [*df.columns, "media"] and media.unwav(bytes(clash.filter("doc_id = 3").first().media))


def test_companding_tables():
    mu, a = media.mu_law_table(), media.a_law_table()
    assert mu[0xFF] == 0 and mu[0x80] == 32124 and mu[0x00] == -32124
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_adpcm_blocks_agree_with_one_sample_at_a_time():
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 256, (7, 36), dtype=np.uint8)
    steps = media.step_sizes().tolist()
    shift = [-1, -1, -1, -1, 2, 4, 6, 8]
    for block, got in zip(blocks, media.adpcm_blocks(blocks), strict=True):
        value, index = int.from_bytes(block[:2].tobytes(), "little", signed=True), min(int(block[2]), 88)
        out = [value]
        for byte in block[4:].tolist():
            for nibble in (byte & 15, byte >> 4):
                step = steps[index]
                change = step >> 3
                for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                    change += part if nibble & bit else 0
                value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
                index = max(0, min(88, index + shift[nibble & 7]))
                out.append(value)
        assert got.tolist() == out


def test_resampling_keeps_a_tone():
    x = (8000 * np.sin(2 * np.pi * 440 * np.arange(4000) / 8000)).astype(np.int16)
    y = media.resample(x, 8000, 16000)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 16000)
    assert len(y) == 8000 and np.abs(y - want)[50:-50].max() < 200
    down = media.resample(y, 16000, 8000)
    assert len(down) == 4000 and np.abs(down - x.astype(float))[50:-50].max() < 400


def test_media_that_cannot_be_decoded(spark):
    good = media.encode_one(b"x" * 576)
    pcm = media.wav(1, 8000, b"\0" * 8)
    made = [(1, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(good[:30])), (5, bytearray(b"RIFF....WAVEfmt \x02\0\0\0xx")), (6, bytearray(pcm)), (7, bytearray(good))]
    df = spark.createDataFrame(made, "doc_id long, media binary")
    got = {r.doc_id: r for r in media.decode_telephony(df).collect()}
    assert got[1].pcm == got[7].pcm and got[1].feature == got[7].feature and not got[1].feature.startswith("fault")
    assert all(got[i].pcm is None and got[i].feature.startswith("fault=") for i in range(2, 7))
    assert got[2].feature == "fault=no media" and media.decode_telephony(df.filter("false")).count() == 0


def test_query_columns_come_from_the_stored_ones(spark):
    df = documents(spark).filter("doc_id = 8")
    digest = media.media_digest(df).first()
    both = media.decode_telephony(media.encode_telephony(df, "text")).first()
    assert digest.media_sha256 == hashlib.sha256(both.media).hexdigest() and digest.pcm_sha256 == hashlib.sha256(both.pcm).hexdigest() and digest.feature == both.feature
