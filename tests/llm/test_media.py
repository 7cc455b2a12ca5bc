import hashlib
import os
import zlib

import numpy as np
import pytest

from fathom.llm import media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 3300, 40_000])
def test_payload_round_trip(n):
    payload = media.as_payload("é" * (n // 2) + "x" * (n % 2))
    assert len(payload) % 576 == 0 and payload
    assert media.Picture(media.store(payload)).payload() == payload
    noise = os.urandom(max(1, n))
    assert media.Picture(media.store(noise)).payload() == noise


def test_general_decoder_agrees_with_array_reads(monkeypatch):
    file = media.store(os.urandom(5000))
    fast = media.Picture(file)
    monkeypatch.setattr(media.Picture, "_flat", lambda *a: False)
    first, refine = media.Picture._first, media.Picture._refine
    rows = lambda f: staticmethod(lambda data, c, rows, *a: f(data, c, list(media._numbers(rows)), *a))
    monkeypatch.setattr(media.Picture, "_first", rows(first))
    monkeypatch.setattr(media.Picture, "_refine", rows(refine))
    slow = media.Picture(file)
    for a, b in zip(fast.parts, slow.parts, strict=True):
        assert (a["c"] == b["c"]).all() and a["c"].any()


def test_transform_and_colour():
    picture = media.Picture(media.store(bytes(576)))
    for part in picture.parts:
        part["c"][:] = 0
    assert (picture.rgb() == 128).all()
    picture.parts[0]["c"][:, 0] = 80  # a DC of 80 raises every sample by 10
    picture.parts[2]["c"][:, 0] = 80
    red, green, blue = picture.rgb()
    assert (red == 152).all() and (green == 131).all() and (blue == 138).all()
    block = np.random.default_rng(1).integers(-50, 50, 64)
    natural = np.zeros(64)
    natural[media.ZIGZAG] = block
    x = np.arange(8)
    basis = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * i + 1) * u * np.pi / 16) for i in x] for u in x])
    assert np.allclose(basis.T @ natural.reshape(8, 8) @ basis, (block.astype(np.float32) @ media.BASIS).reshape(8, 8), atol=1e-3)


def test_rejects_other_files():
    with pytest.raises(ValueError):
        media.Picture(b"GIF89a")


def test_query_on_odd_rows(spark):
    texts = ["", None, "abc", "abc", "long " * 40_000, "é\n"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, feature int")
    got = {r.doc_id: r for r in media.digests(docs).collect()}
    for i, text in enumerate(texts):
        payload = media.as_payload(text)
        assert got[i].n_bytes == len((text or "").encode()) and got[i].payload_bytes == len(payload)
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[i].tail_crc32 == zlib.crc32(payload[-32:])
        assert got[i].media_sha256 == hashlib.sha256(media.store(payload)).hexdigest()
    assert got[0][1:] == got[1][1:] and got[2][1:] == got[3][1:]
    assert media.digests(docs.where("false")).count() == 0


def test_columns(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    files = docs.select("doc_id", media.stored("text").alias("file"))
    rows = files.select("doc_id", media.tensors("file").alias("t")).select("doc_id", "t.*").collect()
    assert all(len(r.rgb) == 3 * r.height * r.width for r in rows)
    empty = files.selectExpr("doc_id", "cast(null as binary) file").select(media.tensors("file").alias("t")).select("t.*").collect()
    assert all(r.rgb is None for r in empty)


@pytest.mark.parametrize(("width", "height", "kind"), [(61, 45, 1), (128, 96, 1), (33, 70, 10)])
def test_reads_files_of_another_encoder(spark, width, height, kind):
    """Progressive files that the JVM's own encoder writes: several scans, refinements, runs, cut-off blocks, grey too."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, kind)
    for y in range(height):
        for x in range(width):
            r, g, b = (x * 3) % 256, (y * 4) % 256, (128 + 90 * (x // 16 % 2) - 60 * (y // 16 % 2)) % 256
            image.setRGB(x, y, (255 << 24 | r << 16 | g << 8 | b) - (1 << 32))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    settings = writer.getDefaultWriteParam()
    settings.setProgressiveMode(1)  # the default progression
    settings.setCompressionMode(2)  # a quality of ours
    settings.setCompressionQuality(0.9)
    sink = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(sink)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), settings)
    stream.close()
    file = bytes(sink.toByteArray())
    assert b"\xff\xc2" in file and file.count(b"\xff\xda") >= 6
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(file)))
    if kind == 1:
        want = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(width)] for y in range(height)])
        want = np.stack([want >> 16, want >> 8 & 255, want & 255]).astype(int)
    else:
        want = np.array([[[back.getRaster().getSample(x, y, 0) for x in range(width)] for y in range(height)]] * 3)
    got = media.Picture(file).rgb().astype(int)
    assert got.shape == want.shape
    # The JVM's reader smooths chroma between samples, so pixels at the edges of colours differ; grey does not.
    assert np.abs(got - want).mean() < (6 if kind == 1 else 0.6) and np.abs(got.sum((1, 2)) - want.sum((1, 2))).max() < 0.5 * width * height
