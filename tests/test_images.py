"""Image headers, hashes and features on files made here."""

import struct

import numpy as np

from tessella.sources import images


def jpeg(orientation=6):
    ascii_value = b"Cam\0"
    entries = [struct.pack("<HHI4s", images.MAKE, 2, 4, ascii_value), struct.pack("<HHIHH", images.ORIENTATION, 3, 1, orientation, 0)]
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
    app1 = b"Exif\0\0" + tiff
    sof = struct.pack(">BHHB", 8, 30, 40, 1) + b"\1\x11\0"
    return b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">H", len(sof) + 2) + sof


def pgm(a):
    return b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def picture(seed=1):
    x = np.random.default_rng(seed).normal(0, 1, (12, 12))
    return np.kron((x - x.min()) / np.ptp(x) * 255, np.ones((16, 16)))


def test_headers(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 7, 5)
    rows = spark.createDataFrame([(1, jpeg()), (2, png), (3, b"GIF89a" + struct.pack("<HH", 3, 4)), (4, b"junk"), (5, None), (6, pgm(picture()))], "id int, content binary")
    got = {r.id: r.p for r in rows.select("id", images.probe("content").alias("p")).collect()}
    assert (got[1].width, got[1].height, got[1].orientation, got[1].display_width, got[1].display_height, got[1].make) == (40, 30, 6, 30, 40, "Cam")
    assert (got[2].width, got[2].height) == (7, 5) and (got[3].width, got[3].height) == (3, 4) and got[6].width == 192
    assert got[4].error and got[5].error and got[1].error is None


def bits(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_hashes_are_stable_under_noise_and_tell_pictures_apart():
    a, b = picture(1), picture(2)
    noisy = np.clip(a + np.random.default_rng(3).normal(0, 3, a.shape), 0, 255)
    for h, n in ((images.cosine_hash, 64), (lambda g: images.difference_hash(g, 16), 64), (images.difference_hash, 16)):
        assert len(h(a)) == n
        assert bits(h(a), h(noisy)) < bits(h(a), h(b)) / 3
    v = images.variants(a)
    assert len(v) == 7 and np.array_equal(np.rot90(v["turn90"], -1), a)


def test_features(spark):
    flat = np.full((20, 20), 128)
    rows = spark.createDataFrame([(1, pgm(flat)), (2, pgm(picture())), (3, b"x")], "id int, content binary")
    got = {r.id: r.f for r in rows.select("id", images.pixel_facts("content").alias("f")).collect()}
    assert got[1].spread == 0 and got[1].sharpness == 0 and got[1].median == 128
    assert got[2].sharpness > 0 and got[2].low < got[2].median < got[2].high and got[3].error
