"""Telephony audio columns: G.711 and IMA ADPCM payloads in WAV files, decoded with numpy.

mu-law and A-law bytes are expanded by 256-entry tables made from their segment rule. ADPCM is
sequential inside a block but not across blocks, so all blocks of a batch are decoded side by side,
one sample position at a time. Resampled PCM is 16-bit linear.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 8000
RESAMPLED = 16000
#: Payload bytes of a unit, and of an ADPCM block beside its header of four bytes.
UNIT = 64
#: Bytes of media that are decoded and resampled at once; their PCM takes up to eight times as many.
AT_ONCE = 1 << 20

#: WAV format codes.
FORMATS = {"mulaw": 7, "alaw": 6, "ima": 0x11, "pcm": 1}
CODECS = ("mulaw", "alaw", "ima")

#: Fixed values of IMA ADPCM: quantizer steps and the change of the step index by code.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
     157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
     1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
     12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    step, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(step == 0, low + 8, low + 264 << np.maximum(step - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": _mulaw(), "alaw": _alaw()}


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Blocks (n x bytes: predictor, step index, codes) -> n x (2 x code bytes + 1) samples."""
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(head[:, 2].astype(np.int32), 0, len(STEPS) - 1)
    codes = blocks[:, 4:].T
    out = np.empty((2 * codes.shape[0] + 1, len(blocks)), np.int16)
    out[0] = value
    for k in range(2 * codes.shape[0]):
        code = (codes[k >> 1] >> 4 if k & 1 else codes[k >> 1] & 15).astype(np.int32)
        size, step = code & 7, STEPS[index]
        change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + CHANGES[size], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


def pad(data: bytes) -> bytes:
    """data, then bytes 0 up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def wav(codec: str, payload: bytes, rate: int = RATE) -> bytes:
    """The payload as a WAV file: bytes as samples, for ima as codes of blocks that start at silence."""
    if codec == "ima":
        units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        payload = np.hstack([np.zeros((len(units), 4), np.uint8), units]).tobytes()
        more = struct.pack("<H", 2 * UNIT + 1)
        form = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, rate * (UNIT + 4) // (2 * UNIT + 1), UNIT + 4, 4)
        samples = len(payload) // (UNIT + 4) * (2 * UNIT + 1)
    else:
        wide = 2 if codec == "pcm" else 1
        more, form, samples = struct.pack("<H", 0)[2:], struct.pack("<HHIIHH", FORMATS[codec], 1, rate, rate * wide, wide, 8 * wide), len(payload) // wide
    form += struct.pack("<H", len(more)) + more if codec != "pcm" else b""
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WAVE" + chunks


def unwav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and data chunk of a WAV file."""
    at, codec, rate, data = 12, "", 0, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            code, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next(k for k, v in FORMATS.items() if v == code)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return codec, rate, data


def payload_of(codec: str, data: bytes) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(-1, UNIT + 4)[:, 4:].tobytes() if codec == "ima" else data


def decode(codec: str, data: list[bytes]) -> list[np.ndarray]:
    """Samples of each data chunk; ADPCM blocks of all chunks are decoded together."""
    if codec == "pcm":
        return [np.frombuffer(x, "<i2") for x in data]
    if codec != "ima":
        return [TABLES[codec][np.frombuffer(x, np.uint8)] for x in data]
    blocks = np.frombuffer(b"".join(data), np.uint8).reshape(-1, UNIT + 4)
    samples = decode_ima(blocks)
    ends = np.cumsum([len(x) // (UNIT + 4) for x in data])
    return [samples[b - len(x) // (UNIT + 4) : b].ravel() for x, b in zip(data, ends, strict=True)]


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    n = -(-len(samples) * to // rate)
    at = np.arange(n, dtype=np.int64) * rate
    left, part = at // to, at % to
    a = samples[left].astype(np.int64)
    b = samples[np.minimum(left + 1, len(samples) - 1)]
    return ((a * (to - part) + b * part) // to).astype("<i2")


def codec_for(payload: bytes) -> str:
    """The codec that a text payload is stored with, by its length."""
    return CODECS[len(payload) // UNIT % len(CODECS)]


def _store(texts: pd.Series) -> pd.DataFrame:
    data = [(x or "").encode("utf-8", "replace") for x in texts]
    padded = [pad(x) for x in data]
    codecs = [codec_for(x) for x in padded]
    return pd.DataFrame({"n_bytes": [len(x) for x in data], "codec": codecs, "media": [wav(c, x) for c, x in zip(codecs, padded, strict=True)]})


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, codec, media: each text's UTF-8 bytes, padded, as a WAV file.

    Null texts are empty; an empty text gives one unit of silence. Equal texts give equal media, repeated rows
    repeat. Null ids stay. An empty table gives an empty result. Extra columns aren't read.
    """
    stored = F.pandas_udf(_store, "n_bytes long, codec string, media binary")
    return docs.select(F.col(id_col).alias("doc_id"), stored(F.col(text_col)).alias("s")).select("doc_id", "s.*")


def _blocks(media: list[bytes]) -> Iterator[list[tuple[int, str, int, bytes]]]:
    """Decoded together: files of a codec up to AT_ONCE bytes."""
    kept: dict[str, list] = {}
    for i, x in enumerate(media):
        codec, rate, data = unwav(x)
        kept.setdefault(codec, []).append((i, codec, rate, data))
        if sum(len(x[3]) for x in kept[codec][-64:]) >= AT_ONCE or len(kept[codec]) >= 512:
            yield kept.pop(codec)
    yield from kept.values()


def _pcm(media: list[bytes], rate: int) -> list[bytes]:
    """Each file decoded, resampled and stored as a 16-bit PCM WAV file; files of a codec are decoded together."""
    out = [b""] * len(media)
    for block in _blocks(media):
        for (i, _, own, _), samples in zip(block, decode(block[0][1], [x[3] for x in block]), strict=True):
            out[i] = wav("pcm", resample(samples, own, rate).tobytes(), rate)
    return out


def _digest(media: bytes | None, pcm: bytes | None) -> tuple:
    """What is read back: the payload from the file, the feature from the stored PCM."""
    if media is None:
        return None, None, None, None, None, None
    codec, rate, data = unwav(media)
    payload = payload_of(codec, data)
    _, to, body = unwav(pcm)
    samples = np.frombuffer(body, "<i2")
    level = int(np.sqrt(np.mean(samples.astype(np.float64) ** 2)))
    turns = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    feature = f"{codec}:{rate}:pcm{to}:{len(samples)}:rms{level}:zc{turns}:crc{zlib.crc32(body):08x}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature


def _some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in pieces of at most AT_ONCE bytes of media, one row at least."""
    for frame in frames:
        ends = frame["media"].str.len().fillna(0).cumsum().to_numpy(np.int64)
        start = 0
        while start < len(frame):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
            yield frame.iloc[start:end]
            start = end


DIGEST = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def resampled(stored: DataFrame, rate: int = RESAMPLED, keep: bool = True) -> DataFrame:
    """Rows of store_texts -> doc_id, n_bytes, what is read back of each, and pcm, its 16-bit PCM WAV file at `rate`:

    payload_bytes, payload_sha256 and tail_crc32 of the payload, media_bytes and media_sha256 of the file, and feature, which is read from the stored PCM: codec, rates, samples,
    level, zero crossings and a checksum. Of null media all of it is null; an empty table gives an empty result. Without `keep` the PCM files,
    up to eight times as large as the media, are made and read but don't leave the task. A task holds AT_ONCE bytes of media at a time, or one file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _some(frames):
            media = [None if x is None else bytes(x) for x in frame["media"]]
            there = [i for i, x in enumerate(media) if x is not None]
            pcm: list[bytes | None] = [None] * len(media)
            for i, x in zip(there, _pcm([media[i] for i in there], rate), strict=True):
                pcm[i] = x
            found = pd.DataFrame([_digest(m, x) for m, x in zip(media, pcm, strict=True)], columns=list(DIGEST)).astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})
            yield found.assign(doc_id=frame["doc_id"].to_numpy(), n_bytes=frame["n_bytes"].to_numpy(), pcm=pcm)[["doc_id", "n_bytes", *DIGEST, *more]]

    kind, more = stored.schema["doc_id"].dataType.simpleString(), ["pcm"] if keep else []
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", pcm binary" if keep else "")
    return stored.select("doc_id", "n_bytes", "media").mapInPandas(run, schema)
