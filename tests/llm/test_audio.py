"""Codecs against sample-by-sample decoders; round trips of payloads."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lectern.llm import audio


def test_g711_tables():
    for code in range(256):
        u = ~code & 0xFF
        size = (((u & 15) * 2 + 33) << (u >> 4 & 7)) - 33
        assert audio.TABLES["mulaw"][code] == (-size if u & 128 else size) * 4
    assert audio.TABLES["alaw"][0xD5] == 8 and audio.TABLES["alaw"][0x55] == -8 and audio.TABLES["alaw"][0x2A] == -32256
    assert len(set(audio.TABLES["alaw"].tolist())) == 256


def plain_ima(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = step >> 3
            change += step if code & 4 else 0
            change += step >> 1 if code & 2 else 0
            change += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(audio.CHANGES[code & 7])))
            out.append(value)
    return out


def test_adpcm_blocks_side_by_side():
    rng = random.Random(1)
    blocks = np.array([[rng.randint(0, 255) for _ in range(68)] for _ in range(9)], np.uint8)
    assert audio.decode_ima(blocks).tolist() == [plain_ima(bytes(b)) for b in blocks]


@pytest.mark.parametrize("codec", audio.CODECS)
def test_files_hold_their_payload(codec):
    for n in (0, 1, 63, 64, 65, 1000):
        payload = audio.pad(random.Random(n).randbytes(n))
        assert len(payload) % 64 == 0 and payload
        got, rate, data = audio.unwav(audio.wav(codec, payload))
        assert (got, rate, audio.payload_of(codec, data)) == (codec, 8000, payload)


def test_resampling():
    x = np.array([0, 100, -100], np.int16)
    assert audio.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert audio.resample(x, 8000, 8000).tolist() == x.tolist()


def plain_media(codec, payload):
    """A file, byte by byte."""
    le = lambda n, size: n.to_bytes(size, "little")
    if codec == "ima":
        body = b"".join(bytes(4) + payload[i : i + 64] for i in range(0, len(payload), 64))
        form, samples = le(0x11, 2) + le(1, 2) + le(8000, 4) + le(8000 * 68 // 129, 4) + le(68, 2) + le(4, 2) + le(2, 2) + le(129, 2), len(body) // 68 * 129
    else:
        body, samples = payload, len(payload)
        form = le({"mulaw": 7, "alaw": 6}[codec], 2) + le(1, 2) + le(8000, 4) + le(8000, 4) + le(1, 2) + le(8, 2) + le(0, 2)
    chunks = b"WAVE" + b"fmt " + le(len(form), 4) + form + b"fact" + le(4, 4) + le(samples, 4) + b"data" + le(len(body), 4) + body
    return b"RIFF" + le(len(chunks), 4) + chunks


def plain_samples(codec, payload):
    """Telephony samples of a payload, one after another."""
    if codec == "ima":
        return [s for i in range(0, len(payload), 64) for s in plain_ima(bytes(4) + payload[i : i + 64])]
    out = []
    for code in payload:
        if codec == "mulaw":
            u = ~code & 0xFF
            size = ((((u & 15) * 2 + 33) << (u >> 4 & 7)) - 33) * 4
            out.append(-size if u & 128 else size)
        else:
            a = code ^ 0x55
            step, low = a >> 4 & 7, a & 15
            size = (low * 2 + 1 if step == 0 else (low * 2 + 33) << (step - 1)) * 8
            out.append(size if a & 128 else -size)
    return out


def plain_wide(samples):
    """Twice the rate: each sample and the mean, rounded down, of it and the next."""
    return [x for a, b in zip(samples, [*samples[1:], samples[-1]], strict=True) for x in (a, (a + b) // 2)]


@pytest.mark.parametrize("at_once", [1 << 20, 200])
def test_stored_files(spark, monkeypatch, at_once):
    monkeypatch.setattr(audio, "AT_ONCE", at_once)
    texts = ["", None, "a", "é" * 32, "x" * 64, "y" * 65, "long " * 3000, "a", "z" * 130, "w" * 200]
    rows = [(None if i == 3 else i, t, "m") for i, t in enumerate(texts)]
    got = audio.resampled(audio.store_texts(spark.createDataFrame(rows, "doc_id long, text string, media string"))).collect()
    assert len(got) == len(texts)
    codecs = set()
    for r in got:
        data = (texts[3 if r["doc_id"] is None else r["doc_id"]] or "").encode()
        p = data + bytes(-len(data) % 64 or 64 * (not data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        codec = ["mulaw", "alaw", "ima"][len(p) // 64 % 3]
        media, wide = plain_media(codec, p), plain_wide(plain_samples(codec, p))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        body = b"".join(s.to_bytes(2, "little", signed=True) for s in wide)
        assert audio.unwav(bytes(r["pcm"])) == ("pcm", 16000, body) and len(r["pcm"]) == 44 + 12 + len(body)
        level, turns = int((sum(s * s for s in wide) / len(wide)) ** 0.5), sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:], strict=False))
        assert r["feature"] == f"{codec}:8000:pcm16000:{len(wide)}:rms{level}:zc{turns}:crc{zlib.crc32(body):08x}"
        codecs.add(codec)
    assert codecs == {"mulaw", "alaw", "ima"}
    slim = audio.resampled(audio.store_texts(spark.createDataFrame(rows, "doc_id long, text string, media string")), keep=False).collect()
    assert sorted(map(tuple, slim), key=repr) == sorted((tuple(r)[:-1] for r in got), key=repr)


def test_nulls_and_a_very_long_text(spark):
    stored = audio.store_texts(spark.createDataFrame([(1, "€ten megabytes" * 700_000)], "doc_id long, text string"))
    rows = audio.resampled(stored.unionByName(spark.createDataFrame([(2, None, None, None)], stored.schema))).drop("pcm").collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["payload_bytes"] == -(-by[1]["n_bytes"] // 64) * 64 > 10_000_000 and by[1]["payload_sha256"]
    assert set(by[2].asDict().values()) == {2, None}
    assert audio.resampled(audio.store_texts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
