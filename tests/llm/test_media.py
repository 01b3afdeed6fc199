import hashlib
import struct

import numpy as np
from pyspark.sql import functions as F

from riskframe.llm import media as M


def test_round_trip(spark):
    texts = [None, "", "é" * 40, "x" * 64, "y" * 65, "ÿ\U0001f600 " * 9000, "x" * 64]
    docs = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(texts)] + [(None, "x" * 64, None)], "doc_id long, text string, media string")
    stored = M.store_as_media(docs)
    rows = {r.doc_id: r for r in M.media_features(stored).collect()}
    for k, x in enumerate(texts):
        raw = (x or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        import hashlib
        import zlib

        assert rows[k].n_bytes == len(raw) and rows[k].payload_bytes == len(padded)
        assert rows[k].payload_sha256 == hashlib.sha256(padded).hexdigest() and rows[k].tail_crc32 == zlib.crc32(padded[-64:])
    assert rows[3][1:] == rows[6][1:] == rows[None][1:]
    assert M.store_as_media(docs.limit(0)).count() == 0
    broken = stored.limit(0).union(spark.createDataFrame([(99, 0, None), (98, 0, bytearray(b"no avi"))], stored.schema))
    assert {(r.doc_id, r.clip, r.error) for r in M.clips(broken).collect()} == {(99, None, "ValueError: not an AVI file"), (98, None, "ValueError: not an AVI file")}
    by = M.clips(stored.union(spark.createDataFrame([(99, 0, None), (98, 0, bytearray(b"no avi"))], stored.schema))).groupBy("doc_id").agg(F.sum("frames").alias("n")).collect()
    assert {r.doc_id for r in by} == {*range(7), None, 98, 99} and next(r.n for r in by if r.doc_id == 5) == -(-(9000 * 7) // M.PER_FRAME)


def brute_feature(data):
    """Shots by decoding each frame alone with the general decoder."""
    seconds, _, frames = M.read_avi(data)
    lumas = [M.decode_frame(f).luma() for f in frames]
    hists = [np.histogram(x, bins=16, range=(0, 256))[0] / x.size for x in lumas]
    cuts, seen = [0], []
    for k in range(1, len(hists)):
        d = np.abs(hists[k] - hists[k - 1]).sum() / 2
        if d > max(0.1, 3 * np.mean(seen) if seen else 0.1):
            cuts, seen = [*cuts, k], []
        else:
            seen.append(d)
    ends = [*cuts[1:], len(hists)]
    means = [np.mean([h @ (np.arange(16) * 16 + 8) for h in hists[a:b]]) for a, b in zip(cuts, ends, strict=True)]
    return ";".join(f"{a * seconds:.2f}+{(b - a) * seconds:.2f}:{m:.1f}" for a, b, m in zip(cuts, ends, means, strict=True))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    stored = M.store_as_media(docs)
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    rows = M.media_features(stored).collect()
    assert len(rows) == len(media) and len({r.feature for r in rows}) > len(rows) // 2
    for r in rows:
        data = media[r.doc_id]
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(data), hashlib.sha256(data).hexdigest(), brute_feature(data))


def test_general_decoder_agrees():
    frame = M.encode_frames(bytes(range(256)) * 10)[0]
    assert (M.decode_frame(frame).coefficients == M._own_coefficients([frame])[0]).all()


def jpeg(spark, pixels, quality=0.8):
    """A JPEG by the encoder of the Java runtime, which is independent of this decoder."""
    jvm, (height, width) = spark._jvm, pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(width, height, 1 if pixels.ndim == 3 else 10)
    raster = image.getRaster()
    for y in range(height):
        for x in range(width):
            for band, v in enumerate(np.atleast_1d(pixels[y, x]).tolist()):
                raster.setSample(x, y, band, int(v))
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    params = writer.getDefaultWriteParam()
    params.setCompressionMode(2)
    params.setCompressionQuality(quality)
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), params)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


def without_tables(data):
    """A frame without its Huffman tables, as motion-JPEG allows."""
    at, out = 2, data[:2]
    while data[at + 1] != 0xDA:
        end = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        out += b"" if data[at + 1] == 0xC4 else data[at:end]
        at = end
    return out + data[at:]


def test_frames_of_another_encoder(spark):
    y, x = np.mgrid[0:37, 0:45]
    grey = ((x * 5 + y * 3) % 256 * (x > 20) + 90 * (x <= 20)).astype(np.uint8)
    colour = np.stack((grey, np.roll(grey, 7, 1), 255 - grey), 2)
    for pixels in (grey, colour):
        want = pixels.astype(float) if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])
        for quality in (0.5, 0.95):
            data = jpeg(spark, pixels, quality)
            luma = M.decode_frame(data).luma()
            assert luma.shape == (37, 45)
            assert np.abs(luma.astype(float) - want).mean() < (12 if quality < 0.9 else 4)
            assert (M.decode_frame(without_tables(data)).luma() == luma).all()


def test_clips_of_another_encoder(spark):
    dark, bright = (jpeg(spark, np.full((24, 32, 3), v, np.uint8)) for v in (20, 230))
    frames = [dark] * 5 + [bright] * 3
    data = M.write_avi(frames, 0)
    at, absolute = data.index(b"movi"), bytearray(data)
    index = data.index(b"idx1") + 8
    for k in range(len(frames)):
        place = index + 16 * k + 8
        absolute[place : place + 4] = struct.pack("<I", struct.unpack("<I", data[place : place + 4])[0] + at)
    bare = data[: index - 8]
    table = spark.createDataFrame([(1, data), (2, bytes(absolute)), (3, bare)], "doc_id long, media binary")
    got = sorted(map(tuple, M.clips(table).collect()))
    assert [(r[0], r[1], r[4], r[5]) for r in got] == [(k, n, f, None) for k in (1, 2, 3) for n, f in ((0, 5), (1, 3))]


def test_general_decoder_on_common_codes():
    # one block: DC category 2 (code 00), value 3; AC (run 1, size 1) code 01, value -1; end code 10
    bits = "00" + "11" + "01" + "0" + "10" + "1111111"
    scan = int(bits, 2).to_bytes(2, "big")
    dc, ac = {(2, 0): 2}, {(2, 1): 0x11, (2, 2): 0}
    got = M._decode_scan(scan, 1, [(0, dc, ac)], 0)[0]
    assert got[0] == 3 and got[2] == -1 and np.count_nonzero(got) == 2


def test_shots_and_samples():
    flat, dark = np.full((8, 8), 128, np.uint8), np.full((8, 8), 28, np.uint8)
    assert M.shots([M.luma_histogram(x) for x in (flat, flat, flat, dark, dark)]) == [(0, 3), (3, 2)]
    assert np.allclose(M.INVERSE @ M.INVERSE.T, np.eye(64), atol=1e-5)
    data = M.write_avi([b"\xff\xd8odd", b"\xff\xd8even1"], 7)
    assert M.read_avi(data)[1:] == (7, [b"\xff\xd8odd", b"\xff\xd8even1"]) and struct.unpack("<I", data[4:8])[0] == len(data) - 8


def test_features_of_null_broken_and_foreign_media(spark):
    made = M.store_as_media(spark.createDataFrame([(1, "some text")], "doc_id long, text string")).first()
    plain = M.write_avi(M.encode_frames(b"x" * 64), 64)
    rows = [(1, made.n_bytes, bytearray(made.media)), (2, None, None), (3, 5, bytearray(b"RIFF....")), (4, None, bytearray(plain[: len(plain) // 2])), (None, 0, bytearray(b""))]
    got = {r.doc_id: r for r in M.media_features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1].error is None and got[1].payload_bytes == 64
    assert got[2].error == "ValueError: media is null" and got[2].media_bytes is None
    assert got[3].error and got[3].payload_sha256 is None and got[3].media_bytes == 8 and got[4].error and got[None].error
    assert M.clips(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).where("error IS NOT NULL").count() == 4
