import numpy as np
import pytest

from fieldglass.operators import vision


def page():
    image = np.full((40, 60, 3), 255, "u1")
    image[15:25, 20:40] = 0
    return image


def test_noise_keeps_shape_and_is_deterministic():
    a = page()
    for f in (lambda x: vision.blur(x, 1.4), lambda x: vision.rotate(x, 3.5), lambda x: vision.speckle(x, 0.01, 5)):
        assert f(a).shape == a.shape and f(a).dtype == np.uint8 and (f(a) == f(a)).all() and not (f(a) == a).all()
    for f in (lambda x: vision.blur(x, 0), lambda x: vision.rotate(x, 0), lambda x: vision.speckle(x, 0, 1), lambda x: vision.jpeg(x, 95)):
        assert (f(a) == a).all()


def test_rotation_fills_with_white_and_blur_keeps_the_mean():
    a = page()
    assert (vision.rotate(np.zeros_like(a), 30)[0, 0] == 255).all() and abs(float(vision.blur(a, 1.0).mean()) - float(a.mean())) < 1


def test_easy_pages_are_nearly_clean_and_unknown_tiers_raise():
    image, used = vision.degrade(page(), "easy", 1)
    assert used["blur"] == 0.4 and np.abs(image.astype(int) - page()).mean() < 5
    with pytest.raises(ValueError):
        vision.degrade(page(), "odd", 1)


@pytest.mark.skipif(not vision.is_available(), reason="no optical recognition here")
def test_read(spark):
    rows = spark.createDataFrame([("1", "easy", "Name: Asha")], "id string, difficulty string, raw_text string")
    assert "Asha" in vision.read_samples_by_eye(rows).head()["ocr_text"]


def test_png_files_hold_their_pixels(tmp_path):
    import struct
    import zlib

    image = page()
    image[0, 0] = (1, 2, 3)
    vision.save_image(image, str(tmp_path / "a" / "x.png"))
    data = (tmp_path / "a" / "x.png").read_bytes()
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (60, 40)
    size = struct.unpack(">I", data[33:37])[0]
    rows = np.frombuffer(zlib.decompress(data[41 : 41 + size]), "u1").reshape(40, 181)
    assert (rows[:, 0] == 0).all() and (rows[:, 1:].reshape(40, 60, 3) == image).all()


def test_samples_are_read_by_other_means(spark, tmp_path):
    def draw(text):
        return np.full((8, 8 + len(text), 3), 255, "u1")

    def read(image):
        return f"width {image.shape[1]}"

    samples = spark.createDataFrame([("a", "easy", "abc"), ("b", "easy", "")], "id string, difficulty string, raw_text string")
    got = vision.read_samples_by_eye(samples, draw, read, str(tmp_path / "images"))
    assert {r["id"]: r["ocr_text"] for r in got.collect()} == {"a": "width 11", "b": "width 8"}
    assert sorted(f.name for f in (tmp_path / "images").iterdir()) == ["a.png", "b.png"]
    if not vision.is_available():
        with pytest.raises(RuntimeError):
            vision.read_samples_by_eye(samples)
