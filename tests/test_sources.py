import random
import struct

import pytest

from pointweave.operators.kernels import cache_values, layers_of
from pointweave.sources.chunks import split_chunks, unescape_payload
from pointweave.sources.ply import PlyDataSource, arrays_of, body_of, header_of, parse_header, rows_of, scan_frames, scan_ply

ROWS = [(1.5, -2.0, 3.25, 10, 20, 255, -7), (4.0, 5.0, 6.0, 0, 1, 2, 300)]
COLUMNS = ["x", "y", "z", "r", "g", "b", "refl"]
ENCODINGS = ["ascii", "binary_little_endian", "binary_big_endian"]


def write_ply(path, rows, columns, encoding):
    with open(path, "wb") as out:
        out.write(header_of(len(rows), columns, encoding) + b"".join(body_of(rows, columns, encoding)))


@pytest.mark.parametrize("encoding", ENCODINGS)
def test_ply_round_trip(spark, tmp_path, encoding):
    write_ply(f"{tmp_path}/cloud_0001.ply", ROWS, COLUMNS, encoding)
    write_ply(f"{tmp_path}/cloud_0002.ply", ROWS[:1], COLUMNS, encoding)
    spark.dataSource.register(PlyDataSource)
    for df in (spark.read.format("ply").load(str(tmp_path)), scan_ply(spark, f"file://{tmp_path}")):
        assert sorted(tuple(r)[:7] for r in df.collect()) == sorted([*ROWS, ROWS[0]])
    assert spark.read.format("ply").option("geom_only", "true").load(str(tmp_path)).columns == ["x", "y", "z", "path"]
    assert scan_ply(spark, str(tmp_path), geom_only=True).columns == ["x", "y", "z", "path"]
    frames = scan_frames(spark, str(tmp_path), 1, 5).groupBy("frame").count().collect()
    assert {r["frame"]: r["count"] for r in frames} == {1: 2, 2: 1}


@pytest.mark.parametrize("encoding", ENCODINGS)
def test_ply_written_by_tasks(spark, tmp_path, encoding):
    spark.dataSource.register(PlyDataSource)
    rows = [(float(i), -i / 4, 0.5, i % 256, 1, 2, i - 50) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, y double, z double, r short, g short, b short, refl short").repartition(3)
    out = str(tmp_path / "cloud")
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        df.write.format("ply").option("encoding", encoding).mode(mode).save(out)
        assert sorted(tuple(r)[:7] for r in scan_ply(spark, out).collect()) == sorted(rows * times)
    assert all(p.name.endswith(".ply") for p in (tmp_path / "cloud").iterdir())
    with pytest.raises(Exception, match="needs x, y and z"):
        df.drop("g").write.format("ply").mode("append").save(out)


def test_binary_columns_equal_rows():
    head = b"ply\nformat binary_big_endian 1.0\nelement vertex 9\nproperty float32 x\nproperty double nx\nproperty int y\nproperty double z\nproperty uint16 refl\nproperty int r\nproperty uchar g\nproperty float b\nend_header\n"
    body = b"".join(struct.pack(">fdidHiBf", i / 3, 9, -i, i * 1e9, 65535 - i, 300 + i, i, i + 0.9) for i in range(7))
    data = head + body + b"\0" * 5  # the ninth and part of the eighth row are missing
    columns = parse_header(data).columns()
    arrays = list(arrays_of(data, columns))
    assert len(list(rows_of(data))) == 7 and [tuple(c.item() for c in row) for part in arrays for row in zip(*part)] == list(rows_of(data))


def test_ply_rules():
    text = b"ply\r\nformat ascii 1.0\r\ncomment c\n\nelement vertex 10\nproperty float x\nproperty float y\nproperty float z\nproperty float nx\nproperty uchar red\nend_header\n1 2 3 9 7\n4 5 6 9 7\n"
    assert list(rows_of(text)) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    for bad in (b"plx\n", b"ply\nelement edge 1\n", b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float\nend_header\n"):
        with pytest.raises(ValueError):
            parse_header(bad)
    with pytest.raises(ValueError):
        list(rows_of(text.replace(b"property float z\n", b"")))


def test_chunks():
    data = b"junk\x00\x00\x01\xa1abc\x00\x00\x01\x05\x00\x00\x01\xa7"
    assert split_chunks(data) == [(0xA1, b"abc\x00\x00\x01\x05"), (0xA7, b"")]
    assert unescape_payload(b"\x01\x02\x03") == b"\x01\x02\x03"


def test_unescape_drops_two_bits_of_each_escape():
    rng = random.Random(5)
    for _ in range(300):
        data = bytes(rng.choice((0, 0, 0, 2, 2, 7, 255)) for _ in range(rng.randrange(12)))
        bits, zeros = "", 0
        for byte in data:
            escape = zeros >= 2 and byte == 2
            bits += f"{byte:08b}"[: 6 if escape else 8]
            zeros = zeros + 1 if byte == 0 and not escape else 0
        assert unescape_payload(data) == bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert unescape_payload(b"\x00\x00\x02\xff") == b"\x00\x00\x03\xfc"


def test_kernels():
    # The cache starts empty, new values go to its end, a known one changes places with the oldest.
    assert cache_values([5, 5, 7, 6, 7, 5, 9], 3) == [(-1, 0), (0, 5), (0, 5), (0, 5), (1, 7), (1, 5), (1, 7)]
    import numpy as np

    layer = layers_of(np.array([[0, 0, 0], [1, 0, 0], [64, 0, 0]]), 3, 2)
    assert list(layer) == [1, 0, 1]
