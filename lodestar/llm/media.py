"""Telephony audio columns: mu-law, A-law and ADPCM in WAV, decoded to PCM.

``encode_telephony`` wraps bytes, unchanged, as the samples of a WAV file in
one of three telephony codecs.  ``decode_telephony`` reads such files back:
mu-law and A-law expand through 256-entry tables, ADPCM blocks of all files
of a run decode together (numpy steps through the samples of a block, across
blocks), and the PCM is resampled and stored as 16-bit WAV.

Defined results: a null payload counts as empty; an empty one is padded to a
whole 576-byte frame; equal payloads give equal files; null media, and media
that are no telephony WAV file (broken, another codec, or longer as PCM than
a WAV header can say), give null PCM and a feature that names the fault, and
end no task; rows are independent, so ties and repeated rows need no rule; an
empty table gives no rows; very long texts are worked on whole, rows leave in
runs of about ``RUN_BYTES`` so that a batch's PCM is never held together;
other columns pass untouched, but one that has an output's name is replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.scratch import stored

FRAME = 576
BLOCK = 36
RATE = 8_000
A_LAW, MU_LAW, IMA_ADPCM = 6, 7, 17
CODECS = (MU_LAW, A_LAW, IMA_ADPCM)
RUN_BYTES = 1 << 20


def mu_law_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, size = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(exponent == 0, size, size + 256 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def step_sizes() -> np.ndarray:
    """The 89 fixed step sizes of IMA ADPCM."""
    # fixed values
    return np.array(
        [
            7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
            130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
            1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
            7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
        ],
        dtype=np.int32,
    )


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks, one block a row: its header's sample, then two a byte."""
    steps, shift = step_sizes(), np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.uint16).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    nibbles = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), dtype=np.uint8)
    nibbles[0::2], nibbles[1::2] = blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4
    out = np.empty((len(nibbles) + 1, len(blocks)), dtype=np.int16)
    out[0] = value
    # change of the predictor for every (step index, nibble)
    code = np.arange(16, dtype=np.int32)
    size = steps[:, None]
    change = (size >> 3) + (code >> 2 & 1) * size + (code >> 1 & 1) * (size >> 1) + (code & 1) * (size >> 2)
    change = np.where(code & 8, -change, change).astype(np.int32).ravel()
    after = np.clip(np.arange(89, dtype=np.int32)[:, None] + shift, 0, 88).astype(np.int32).ravel()
    for k, nibble in enumerate(nibbles):
        at = index * 16 + nibble
        value = np.clip(value + change[at], -32768, 32767)
        index = after[at]
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, to_rate: int, taps: int = 8) -> np.ndarray:
    """Windowed-sinc polyphase resampling in whole numbers; edges repeat."""
    if rate == to_rate or not len(pcm):
        return pcm.astype(np.int16)
    common = np.gcd(rate, to_rate)
    up, down = to_rate // common, rate // common
    half = taps // 2
    place = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    width = min(1.0, to_rate / rate)
    kernel = np.sinc(place * width) * np.cos(np.pi * place / (2 * (half + 1))) ** 2
    kernel = np.round(kernel / kernel.sum(axis=1, keepdims=True) * 4096).astype(np.int64)
    padded = np.concatenate([np.full(half, pcm[0]), pcm, np.full(half + 1, pcm[-1])]).astype(np.int64)
    n_out = len(pcm) * up // down
    out = np.empty(n_out, dtype=np.int64)
    for phase in range(min(up, n_out)):
        where = np.arange(phase, n_out, up, dtype=np.int64) * down
        lane, base = where[0] % up, where // up + 1
        if down == 1:
            total = sum(kernel[lane, t] * padded[base[0] + t : base[0] + t + len(base)] for t in range(taps) if kernel[lane, t])
        else:
            total = sum(kernel[lane, t] * padded[base + t] for t in range(taps) if kernel[lane, t])
        out[phase::up] = total
    return np.clip(out + 2048 >> 12, -32768, 32767).astype(np.int16)


def wav(codec: int, rate: int, data: bytes) -> bytes:
    """A mono WAV file: PCM (1) of 16 bits, or one of ``CODECS`` with its sample count."""
    if codec == 1:
        fmt, fact = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16), b""
    elif codec == IMA_ADPCM:
        per_block = 2 * (BLOCK - 4) + 1
        fmt = struct.pack("<HHIIHHHH", codec, 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
        fact = struct.pack("<4sII", b"fact", 4, len(data) // BLOCK * per_block)
    else:
        fmt, fact = struct.pack("<HHIIHHH", codec, 1, rate, rate, 1, 8, 0), struct.pack("<4sII", b"fact", 4, len(data))
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) & 1)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def unwav(media: bytes) -> tuple[int, int, int, bytes]:
    """(codec, rate, block size, data) of a WAV file, chunk by chunk; ValueError if it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate, block = 12, 0, 0, 1
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt " and size >= 16 and at + 24 <= len(media):
            codec, _, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            return codec, rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without data")


def payload_of(text: str | bytes | None) -> tuple[int, bytes]:
    raw = b"" if text is None else text.encode() if isinstance(text, str) else text
    return len(raw), raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def encode_one(payload: bytes) -> bytes:
    return wav(CODECS[zlib.crc32(payload) % len(CODECS)], RATE, payload)


def fault_of(media: bytes | None, to_rate: int) -> str:
    """Why a file cannot be decoded, or nothing."""
    if media is None:
        return "no media"
    try:
        codec, rate, block, data = unwav(media)
    except ValueError as error:
        return str(error)
    if codec not in CODECS or not 0 < rate <= 1_000_000 or (codec == IMA_ADPCM and block <= 4):
        return f"codec {codec} at {rate} a second is not telephony"
    return "too long for a WAV file" if 2 * len(data) * 2 * -(-to_rate // rate) >= 2**32 - 64 else ""


def decode_many(files: list[bytes], to_rate: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(codec, stored bytes, PCM, resampled PCM) of each file; ADPCM decodes across all files."""
    parsed = [unwav(x) for x in files]
    tables = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}
    blocks: dict[int, list[bytes]] = {}
    for codec, _, block, data in parsed:
        if codec == IMA_ADPCM:
            blocks.setdefault(block, []).append(data[: len(data) // block * block])
    pcm = {block: adpcm_blocks(np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, block)) for block, parts in blocks.items()}
    used = dict.fromkeys(pcm, 0)
    for codec, rate, block, data in parsed:
        if codec == IMA_ADPCM:
            n = len(data) // block
            samples = pcm[block][used[block] : used[block] + n].ravel()
            used[block] += n
        elif codec in tables:
            samples = tables[codec][np.frombuffer(data, dtype=np.uint8)]
        else:
            raise ValueError(f"codec {codec} is not a telephony codec")
        yield codec, data, samples, resample(samples, rate, to_rate)


def feature_of(codec: int, pcm: np.ndarray, resampled: np.ndarray) -> str:
    """Whole-number loudness, peak, zero crossings and the resampled PCM's checksum."""
    x = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    name = {MU_LAW: "mulaw", A_LAW: "alaw", IMA_ADPCM: "adpcm"}[codec]
    power = int((x * x).sum()) // max(len(x), 1)
    return f"{name};samples={len(x)};power={power};peak={int(np.abs(x).max(initial=0))};crossings={crossings};pcm_crc32={zlib.crc32(resampled.tobytes())}"


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[list]:
    """The column's values in runs of about ``RUN_BYTES``."""
    held, size = [], 0
    for value in batch.column(name):
        held.append(value.as_py())
        size += len(held[-1] or "") + FRAME
        if size >= RUN_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_telephony(df: DataFrame, column: str, output: str = "media") -> DataFrame:
    """``df`` with ``output``: the column's bytes as a telephony WAV file."""
    kept = [c for c in df.columns if c != output]
    schema = df.select(*kept, F.lit(b"").alias(output)).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for values in _texts(batch, column):
                media = pa.array([encode_one(payload_of(x)[1]) for x in values], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, len(values)) for c in kept), media], names=[*kept, output])
                row += len(values)

    return df.mapInArrow(encode, schema)


def decode_telephony(df: DataFrame, column: str = "media", to_rate: int = 16_000, output: str = "pcm") -> DataFrame:
    """``df`` with ``output``: the resampled 16-bit PCM as WAV, and ``feature``."""
    kept = [c for c in df.columns if c not in (output, "feature")]
    schema = df.select(*kept, F.lit(None).cast("binary").alias(output), F.lit("").alias("feature")).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for files in _texts(batch, column):
                faults = [fault_of(x, to_rate) for x in files]
                pcm, feature = [None] * len(files), [f"fault={x}" for x in faults]
                good = [i for i, x in enumerate(faults) if not x]
                for i, (codec, _, samples, out) in zip(good, decode_many([files[i] for i in good], to_rate), strict=True):
                    pcm[i], feature[i] = wav(1, to_rate, out.tobytes()), feature_of(codec, samples, out)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, len(files)) for c in kept), pa.array(pcm, pa.binary()), pa.array(feature, pa.string())], names=[*kept, output, "feature"])
                row += len(files)

    return df.mapInArrow(decode, schema)


def media_digest(docs: DataFrame, to_rate: int = 16_000) -> DataFrame:
    """Each text stored as telephony audio, read back, decoded and resampled: sizes, checksums, features.

    The files are written once, as a table; the PCM is a column of the plan and
    leaves as its digest, as it is several times the text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files = stored(encode_telephony(texts, "text").select("doc_id", F.length(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("n_bytes"), "media"), "media")
    decoded = decode_telephony(files, to_rate=to_rate)
    # an ADPCM header is 60 bytes, the others 58; a padded payload has an even length
    data = F.expr("substring(media, if(hex(substring(media, 21, 2)) = '1100', 61, 59))")
    read = decoded.select("doc_id", "n_bytes", "media", data.alias("data"), "pcm", "feature")
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("data").cast("long").alias("payload_bytes"),
        F.sha2("data", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(data, -32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )
