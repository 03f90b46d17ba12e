"""Image metrics: packed and long forms, files, edge cases."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkscore.operators import images as I
from inkscore.operators import pixels as P
from inkscore.operators import strips as Z
from inkscore.plans.scoring import score
from inkscore.sources.files import (
    read_artifact_tree,
    read_images,
    read_images_packed,
    scan_artifacts,
)

IDS = ["gen_id", "tgt_id"]


def packed(spark, arrays):
    rows = [(k, (a.shape[0], a.shape[1], a.astype(np.uint8).tobytes())) for k, a in arrays.items()]
    return spark.createDataFrame(
        rows, "image_id long, image struct<height: int, width: int, rgb: binary>"
    )


def naive_ssim(a, b):
    a, b = a.astype(float), b.astype(float)
    scores = []
    for y in range(a.shape[0] - 6):
        for x in range(a.shape[1] - 6):
            for c in range(3):
                p, q = a[y : y + 7, x : x + 7, c].ravel(), b[y : y + 7, x : x + 7, c].ravel()
                cov = np.cov(p, q, ddof=1)
                top = (2 * p.mean() * q.mean() + P.C1) * (2 * cov[0, 1] + P.C2)
                low = (p.mean() ** 2 + q.mean() ** 2 + P.C1) * (cov[0, 0] + cov[1, 1] + P.C2)
                scores.append(top / low)
    return float(np.mean(scores))


def naive_resample(image, n_out, axis):
    """One cell at a time, in whole numbers."""
    moved = np.moveaxis(image, axis, 0).astype(int)
    n_in, out = moved.shape[0], []
    scale, stretch = n_in / n_out, max(n_in / n_out, 1.0)
    for o in range(n_out):
        centre = (o + 0.5) * scale
        low = max(int(centre - 3 * stretch + 0.5), 0)
        high = min(int(centre + 3 * stretch + 0.5), n_in)
        at = [(i - centre + 0.5) / stretch for i in range(low, high)]
        w = [np.sinc(d) * np.sinc(d / 3) if -3 <= d < 3 else 0.0 for d in at]
        fixed = [int(v / sum(w) * 2**22 + (0.5 if v >= 0 else -0.5)) for v in w]
        total = sum(k * moved[i] for k, i in zip(fixed, range(low, high)))
        out.append(np.clip((total + 2**21) >> 22, 0, 255))
    return np.moveaxis(np.array(out), 0, axis)


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (20, 24, 3))
    return {
        1: base,
        2: np.clip(base + rng.integers(-20, 20, base.shape), 0, 255),
        3: rng.integers(0, 256, (13, 31, 3)),
        4: rng.integers(0, 256, (6, 24, 3)),
        5: np.full((20, 24, 3), [255, 0, 0]),
        6: np.full((20, 24, 3), [0, 0, 255]),
    }


PAIRS = [(1, 1), (1, 2), (2, 1), (3, 1), (4, 1), (1, 4), (5, 6), (5, 5), (1, 99)]


@pytest.fixture(scope="module")
def results(spark, arrays):
    images = packed(spark, arrays)
    pairs = spark.createDataFrame(PAIRS, "gen_id long, tgt_id long")
    gen = images.select(F.col("image_id").alias("gen_id"), F.col("image").alias("gen"))
    tgt = images.select(F.col("image_id").alias("tgt_id"), F.col("image").alias("tgt"))
    both = pairs.join(gen, "gen_id", "left").join(tgt, "tgt_id", "left")
    short = I.image_similarity_packed(both, IDS)
    pixels = I.unpack_pixels(images)
    long = P.image_similarity(pixels, pixels, pairs)
    return [{(r.gen_id, r.tgt_id): r for r in df.collect()} for df in (short, long)]


def test_forms_agree(results):
    short, long = results
    assert set(short) == set(long) == set(PAIRS)
    for key in PAIRS:
        assert short[key].structural == pytest.approx(long[key].structural, abs=1e-12)
        assert short[key].pixel == pytest.approx(long[key].pixel, abs=1e-12)


def test_values(results, arrays):
    short, _ = results
    assert short[1, 1].structural == pytest.approx(1) and short[1, 1].pixel == 1
    assert short[5, 5].structural == pytest.approx(1) and short[5, 5].pixel == 1
    assert short[5, 6].structural < 1
    assert short[5, 6].pixel == pytest.approx(1 - 256 / (3 * 255))
    assert short[1, 2].structural == pytest.approx(naive_ssim(arrays[1], arrays[2]), abs=1e-12)
    wrapped = ((arrays[1] - arrays[2]) % 256).mean() / 255
    assert short[1, 2].pixel == pytest.approx(1 - wrapped)
    assert short[1, 2].pixel != short[2, 1].pixel  # the wrapped difference has a direction
    assert (short[1, 4].structural, short[1, 4].pixel) == (0, 0)  # target below seven pixels
    assert (short[1, 99].structural, short[1, 99].pixel) == (0, 0)  # no target image
    assert short[4, 1].pixel > 0  # a small generated image is resized first


def test_resampling(results, arrays):
    moved = naive_resample(naive_resample(arrays[3], 24, 1), 20, 0)
    assert np.array_equal(I._resample(I._resample(arrays[3].astype(np.uint8), 24, 1), 20, 0), moved)
    assert results[0][3, 1].structural == pytest.approx(naive_ssim(moved, arrays[1]), abs=1e-12)


def test_resample_beyond_the_broadcast_bound(spark, arrays):
    pixels = I.unpack_pixels(packed(spark, {3: arrays[3], 1: arrays[1]}))
    sizes = P.image_sizes(pixels).select("*", F.lit(9).alias("out_w"), F.lit(11).alias("out_h"))
    small = P.resample_to(pixels, sizes)
    large = P.resample_to(pixels, sizes, broadcast_rows=0)
    assert "Broadcast" not in large._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(small.collect()) == sorted(large.collect())


def test_abs_mode(spark, arrays):
    row = packed(spark, {5: arrays[5]}).crossJoin(
        packed(spark, {6: arrays[6]}).select(F.col("image").alias("tgt"))
    ).select(I.image_scores(F.col("image"), F.col("tgt"), "abs").alias("s")).first()
    assert row.s.pixel == pytest.approx(1 - 510 / (3 * 255))


def test_strips_do_not_change_ssim(arrays, monkeypatch):
    a, b = (arrays[k].astype(np.uint8) for k in (1, 2))
    whole = I._ssim(a, b)
    monkeypatch.setattr(I, "STRIP", 3)
    assert I._ssim(a, b) == pytest.approx(whole, abs=1e-12)


def png(path, array):
    kind = {1: 0, 3: 2, 4: 6}[array.shape[2]]

    def chunk(name, data):
        body = name + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    h, w = array.shape[:2]
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in array)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(raw))
        + chunk(b"IEND", b"")
    )


def test_read_images(spark, tmp_path):
    rng = np.random.default_rng(2)
    color, clear = rng.integers(0, 256, (4, 5, 3)), rng.integers(0, 256, (4, 5, 4))
    grey = rng.integers(0, 256, (4, 5, 1))
    for name, array in (("color", color), ("clear", clear), ("grey", grey)):
        png(tmp_path / f"{name}.png", array)
    (tmp_path / "broken.png").write_bytes(b"not an image")
    rows = {
        r.image_id.rsplit("/", 1)[1]: r.image
        for r in read_images_packed(spark, str(tmp_path)).collect()
    }
    assert rows["broken.png"] is None
    assert bytes(rows["color.png"].rgb) == color.astype(np.uint8).tobytes()
    assert bytes(rows["clear.png"].rgb) == clear[:, :, :3].astype(np.uint8).tobytes()
    assert bytes(rows["grey.png"].rgb) == np.repeat(grey, 3, 2).astype(np.uint8).tobytes()
    pixels = read_images(spark, str(tmp_path))
    assert pixels.count() == 3 * 4 * 5 * 3
    found = pixels.where(F.col("image_id").endswith("color.png") & F.expr("y = 2 AND x = 3"))
    assert [r.v for r in found.orderBy("c").collect()] == color[2, 3].tolist()


def test_scan_artifacts(spark, tmp_path):
    for name in ("m1/0.svg", "m1/0.png", "m1/1.svg", "m two/2.png", "m1/0_target.svg", "m1/a.txt"):
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_text("x")
    rows = {(r.model, r.record): (r.has_markup, r.has_render) for r in scan_artifacts(spark, str(tmp_path)).collect()}
    assert rows == {("m1", 0): (True, True), ("m1", 1): (True, False), ("m two", 2): (False, True)}


def test_holes_and_unequal_sizes_are_not_compared(spark):
    """An image with a missing column or pixel, or of another size, has no score of its own."""
    def table(image_id, height, width, skip=()):
        return [
            (image_id, y, x, c, (7 * y + 11 * x + 5 * c + image_id) % 256)
            for y in range(height)
            for x in range(width)
            for c in range(3)
            if (y, x) not in skip
        ]

    schema = "image_id long, y int, x int, c int, v int"
    column = {(y, 5) for y in range(12)}
    rows = table(1, 12, 12) + table(2, 12, 12, column) + table(3, 12, 12, {(4, 4)}) + table(4, 8, 9)
    pixels = spark.createDataFrame(rows, schema)
    pairs = spark.createDataFrame([(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3)], "gen_id long, tgt_id long")
    scores = {(r.gen_id, r.tgt_id): (r.structural, r.pixel) for r in P.image_similarity(pixels, pixels, pairs).collect()}
    assert scores[1, 1] == (1.0, 1.0)
    assert scores[4, 1] != (0.0, 0.0)  # complete, and resampled to the target
    assert all(scores[p] == (0.0, 0.0) for p in scores if {2, 3} & set(p))
    side = P.pair_pixels(pixels, pixels, pairs)
    assert {tuple(r) for r in side.select("gen_id", "tgt_id").distinct().collect()} == {(1, 1)}
    holed = side.where("x <> 5")
    assert P.ssim(holed, ["gen_id", "tgt_id"]).collect() == []


def test_artifact_tree_to_scores(spark, tmp_path):
    rng = np.random.default_rng(4)
    same, other = rng.integers(0, 256, (9, 8, 3)), rng.integers(0, 256, (9, 8, 3))
    for name in ("m1", "m two"):
        (tmp_path / name).mkdir()
        png(tmp_path / name / "0_target.png", same)
        png(tmp_path / name / "1_target.png", same)
    text = "<svg a b c d e f/>"
    for name, markup, image in (("m1/0", text, same), ("m1/1", None, same), ("m two/0", text, other), ("m two/1", text, None)):
        if markup:
            (tmp_path / f"{name}.svg").write_text(markup)
        if image is not None:
            png(tmp_path / f"{name}.png", image)
    (tmp_path / "m1" / "notes.txt").write_text("x")
    artifacts, generated, target = read_artifact_tree(spark, str(tmp_path), "r")
    assert artifacts.count() == 4 and generated.count() == 3 and target.count() == 2
    examples = spark.createDataFrame([(0, text), (1, text)], "record long, completion string")
    rows = {(r.model, r.record): r for r in score(artifacts, examples, generated, target, check_unique=True).collect()}
    assert (rows["m1", 0].bleu, rows["m1", 0].structural, rows["m1", 0].pixel) == (1, 1, 1)
    assert rows["m two", 0].bleu == 1 and rows["m two", 0].pixel < 1
    for key in (("m1", 1), ("m two", 1)):
        assert (rows[key].bleu, rows[key].structural, rows[key].pixel) == (0, 0, 0)


def strip_cases():
    rng = np.random.default_rng(12)
    sizes = [(64, 40), (64, 40), (33, 57), (200, 9), (7, 7), (6, 90), (300, 31), (1, 1)]
    return {k: rng.integers(0, 256, (*size, 3)) for k, size in enumerate(sizes)}


@pytest.mark.parametrize("strip_bytes", [1, 700, 1 << 20])
def test_strips_are_those_of_the_whole_image(spark, strip_bytes):
    arrays = strip_cases()
    images = packed(spark, arrays)
    broken = images.limit(1).select(F.lit(99).cast("long").alias("image_id"), F.struct(F.lit(3).alias("height"), F.lit(3).alias("width"), F.unhex(F.lit("00")).alias("rgb")).alias("image"))
    cut = Z.cut_strips(images.union(broken), strip_bytes)
    pixels = Z.strips_of_pixels(I.unpack_pixels(images), strip_bytes)
    for strips in (cut, pixels):
        rows = sorted(strips.collect(), key=lambda r: (r["image_id"], r["y"]))
        assert all(len(r["rgb"]) <= max(strip_bytes, 3 * r["width"]) for r in rows)
        for k, a in arrays.items():
            own = [r for r in rows if r["image_id"] == k]
            assert b"".join(r["rgb"] for r in own) == a.astype(np.uint8).tobytes()
            assert {(r["height"], r["width"]) for r in own} == {a.shape[:2]}
        assert {r["image_id"] for r in rows} == set(arrays)


@pytest.mark.parametrize("strip_bytes", [1, 700, 1 << 20])
def test_strips_resample_like_the_whole_image(spark, strip_bytes):
    arrays = strip_cases()
    wanted = {0: (64, 40), 1: (30, 90), 2: (66, 20), 3: (11, 9), 4: (40, 3), 5: (9, 7), 6: (12, 31), 7: (5, 4)}
    sizes = spark.createDataFrame([(k, w, h) for k, (h, w) in wanted.items()], "image_id long, out_w int, out_h int")
    strips = Z.cut_strips(packed(spark, arrays), strip_bytes).join(sizes, "image_id")
    rows = sorted(Z.resample_strips(strips, strip_bytes).collect(), key=lambda r: (r["image_id"], r["y"]))
    assert all(len(r["rgb"]) <= max(strip_bytes, 3 * r["width"]) for r in rows)
    for k, (h, w) in wanted.items():
        own = [r for r in rows if r["image_id"] == k]
        made = np.frombuffer(b"".join(r["rgb"] for r in own), np.uint8).reshape(h, w, 3)
        assert (made == naive_resample(naive_resample(arrays[k], w, 1), h, 0)).all()


@pytest.mark.parametrize("mode", ["wrap", "abs"])
def test_strip_scores_are_those_of_packed_images(spark, mode):
    arrays = strip_cases()
    images = packed(spark, arrays)
    ids = list(arrays)
    pairs = spark.createDataFrame([(a, b) for a in ids + [77] for b in ids + [88]], "gen_id long, tgt_id long")
    gen = images.select(F.col("image_id").alias("gen_id"), F.col("image").alias("gen"))
    tgt = images.select(F.col("image_id").alias("tgt_id"), F.col("image").alias("tgt"))
    whole = pairs.join(gen, "gen_id", "left").join(tgt, "tgt_id", "left")
    wanted = {tuple(r)[:2]: tuple(r)[2:] for r in I.image_similarity_packed(whole, IDS, mode).collect()}
    for strip_bytes in (1, 900, 1 << 20):
        strips = Z.cut_strips(images, strip_bytes)
        found = {tuple(r)[:2]: tuple(r)[2:] for r in Z.strip_similarity(strips, strips, pairs, mode, strip_bytes).collect()}
        assert found.keys() == wanted.keys()
        for key, scores in wanted.items():
            assert found[key] == pytest.approx(scores, abs=1e-9), key


def test_large_images_in_strips(spark):
    """1,024 x 1,024: no row above a strip, scores of the packed form."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 200, (1024, 1024, 3))
    arrays = {1: base, 2: base + rng.integers(0, 50, base.shape), 3: base[:900, :700]}
    images, limit = packed(spark, arrays), 1 << 17
    strips = Z.cut_strips(images, limit)
    assert strips.agg(F.max(F.octet_length("rgb"))).first()[0] <= limit
    pairs = spark.createDataFrame([(1, 2), (3, 1), (2, 3)], "gen_id long, tgt_id long")
    found = {tuple(r)[:2]: tuple(r)[2:] for r in Z.strip_similarity(strips, strips, pairs, strip_bytes=limit).collect()}
    for (a, b), scores in found.items():
        h, w = arrays[b].shape[:2]
        moved = I._resample(I._resample(arrays[a].astype(np.uint8), w, 1), h, 0)
        target = arrays[b].astype(np.uint8)
        assert scores == pytest.approx((I._ssim(moved, target), I._pixel(moved, target, "wrap")), abs=1e-9)


def test_strips_with_holes_score_zero(spark):
    """A strip missing, short or there twice: no error, and 0 as for any broken image."""
    rng = np.random.default_rng(5)
    arrays = {k: rng.integers(0, 256, (40, 16, 3)) for k in range(5)}
    strips = Z.cut_strips(packed(spark, arrays), 480)
    at = F.col("y") == 10
    missing = (F.col("image_id") == 1) & at
    rgb = F.when((F.col("image_id") == 2) & at, F.substring("rgb", 1, 100)).otherwise(F.col("rgb"))
    twice = strips.where((F.col("image_id") == 3) & at)
    broken = strips.where(~missing).withColumn("rgb", rgb).unionByName(twice)
    pairs = spark.createDataFrame([(a, b) for a in arrays for b in arrays], "gen_id long, tgt_id long")
    found = {tuple(r)[:2]: tuple(r)[2:] for r in Z.strip_similarity(broken, broken, pairs, strip_bytes=480).collect()}
    assert found.keys() == {(a, b) for a in arrays for b in arrays}
    for (a, b), scores in found.items():
        if {a, b} <= {0, 4}:
            p, q = arrays[a].astype(np.uint8), arrays[b].astype(np.uint8)
            assert scores == pytest.approx((I._ssim(p, q), I._pixel(p, q, "wrap")), abs=1e-9)
        else:
            assert scores == (0.0, 0.0)
