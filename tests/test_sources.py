"""WAV files and containers: round trips, repairs, refusals."""

import struct

import numpy as np
import pytest

from lagweave.operators import lossless
from lagweave.sources import container, wav


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_wav_round_trip(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(-(1 << bits - 1), 1 << bits - 1, (1001, 2))
    got = wav.parse(wav.build(x, 48_000, bits))
    assert (got["samples"] == x).all() and got["bits"] == bits and got["rate"] == 48_000 and got["exact"]


def test_wav_clamps_and_repairs():
    data = wav.build(np.array([[40_000], [-40_000], [5]]), 8000)
    assert wav.parse(data)["samples"].ravel().tolist() == [32767, -32768, 5]
    at = data.index(b"data")
    broken = data[: at + 4] + struct.pack("<I", 0xFFFFFFFF) + data[at + 8 :]
    assert wav.parse(broken)["samples"].ravel().tolist() == [32767, -32768, 5]
    with pytest.raises(wav.WavError):
        wav.parse(b"nothing")


def test_wav_float_grid():
    body = np.array([0.5, -0.25, 1 / 3], "<f4").tobytes()
    head = struct.pack("<HHIIHH", 3, 1, 8000, 32000, 4, 32)
    data = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body
    got = wav.parse(data)
    assert got["samples"].ravel()[:2].tolist() == [1 << 22, -(1 << 21)] and not got["exact"]


def test_wav_files_in_spark(spark, tmp_path):
    x = np.arange(-500, 500).reshape(-1, 2)
    (tmp_path / "a.wav").write_bytes(wav.build(x, 44_100))
    rows = wav.read(spark, str(tmp_path), chunk=100).orderBy("ch", "start").collect()
    assert sum((r["x"] for r in rows if r["ch"] == 1), []) == x[:, 1].tolist()


def test_container_round_trip():
    blocks = [container.Block(0, 40, b"hello"), container.Block(40, 59, b"abc", 2)]
    c = container.Container(48_000, 2, 24, 100_000, {"encoder": "test", "title": "Song"}, b"\1\2\3\4\5", blocks)
    data = container.write(c)
    assert container.read(data) == c
    assert [b.payload for b in container.read(data, payloads=False).blocks] == [b"", b""]
    assert container.read(container.retag(data, {"title": "Other", "year": "2000"})).metadata == {"encoder": "test", "title": "Other", "year": "2000"}
    for at in (0, 30, 60, len(data) - 1):
        with pytest.raises(container.ContainerError):
            container.read(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
            container.read(data[:at])


def test_segments_are_independent(spark):
    s = spark.range(10_000).selectExpr("id AS n", "CAST(1000 * sin(id / 7) AS BIGINT) AS x")
    blocks = lossless.encode(s)
    assert blocks.count() == 3
    one = lossless.decode(blocks.filter("seg = 1"))
    assert one.exceptAll(s.filter("n BETWEEN 4096 AND 8191")).count() == 0 and one.count() == 4096
