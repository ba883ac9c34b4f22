"""The optical track: text drawn as an image, image noise, and recognition.

Blur, rotation and speckle work on arrays and need nothing else. Drawing and JPEG need Pillow, recognition needs pytesseract and
the Tesseract program; where they are missing, is_available() says so and the functions raise.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    from PIL import Image, ImageDraw, ImageFont
except ImportError:
    Image = ImageDraw = ImageFont = None
try:
    import pytesseract
except ImportError:
    pytesseract = None

# Image noise by difficulty.
PRESETS = {
    "easy": {"blur": 0.4, "rotation": 0.0, "jpeg": 95, "speckle": 0.0},
    "medium": {"blur": 0.8, "rotation": 1.0, "jpeg": 80, "speckle": 0.001},
    "hard": {"blur": 1.4, "rotation": 2.0, "jpeg": 65, "speckle": 0.003},
    "extreme": {"blur": 2.0, "rotation": 3.5, "jpeg": 50, "speckle": 0.006},
}
WHITE = 255


def is_available() -> bool:
    """Whether text can be drawn and recognized here."""
    if Image is None or pytesseract is None:
        return False
    try:
        pytesseract.get_tesseract_version()
    except Exception:  # the program is missing or doesn't answer
        return False
    return True


def render(text: str, font_size: int = 18, line_spacing: float = 1.4, margin: int = 40) -> np.ndarray:
    """Black text on white, sized to fit, as an array of rows, columns and RGB."""
    if Image is None:
        raise RuntimeError("drawing needs Pillow")
    font = ImageFont.load_default(font_size)
    lines = text.split("\n")
    step = int(font_size * line_spacing)
    wide = max(int(font.getlength(line)) for line in lines)
    image = Image.new("RGB", (max(1, wide) + 2 * margin, step * len(lines) + 2 * margin), "white")
    draw = ImageDraw.Draw(image)
    for i, line in enumerate(lines):
        draw.text((margin, margin + i * step), line, font=font, fill="black")
    return np.asarray(image)


def blur(image: np.ndarray, radius: float) -> np.ndarray:
    """Gaussian blur, rows then columns; edges repeat."""
    if radius <= 0:
        return image
    reach = max(1, int(3 * radius + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    kernel /= kernel.sum()
    out = image.astype("f8")
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in range(3)]
        wide = np.pad(out, pad, mode="edge")
        out = sum(k * np.take(wide, range(i, i + image.shape[axis]), axis) for i, k in enumerate(kernel))
    return np.clip(out + 0.5, 0, 255).astype("u1")


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """Rotation about the centre with bilinear sampling; what comes from outside is white."""
    if degrees == 0:
        return image
    h, w, _ = image.shape
    y, x = np.mgrid[:h, :w].astype("f8")
    cy, cx, a = (h - 1) / 2, (w - 1) / 2, np.deg2rad(degrees)
    sy, sx = cy + (y - cy) * np.cos(a) + (x - cx) * np.sin(a), cx + (x - cx) * np.cos(a) - (y - cy) * np.sin(a)
    padded = np.pad(image.astype("f8"), ((1, 2), (1, 2), (0, 0)), constant_values=WHITE)
    iy, ix = np.clip(np.floor(sy).astype(int), -1, h), np.clip(np.floor(sx).astype(int), -1, w)
    fy, fx = np.clip(sy - iy, 0, 1)[..., None], np.clip(sx - ix, 0, 1)[..., None]
    at = lambda dy, dx: padded[iy + 1 + dy, ix + 1 + dx]
    out = (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))
    return np.clip(out + 0.5, 0, 255).astype("u1")


def jpeg(image: np.ndarray, quality: int) -> np.ndarray:
    if quality >= 95:
        return image
    if Image is None:
        raise RuntimeError("JPEG needs Pillow")
    buffer = io.BytesIO()
    Image.fromarray(image).save(buffer, "JPEG", quality=quality)
    return np.asarray(Image.open(buffer).convert("RGB"))


def speckle(image: np.ndarray, density: float, seed: int) -> np.ndarray:
    """A share of the pixels, chosen by seed, turns black."""
    if density <= 0:
        return image
    h, w, _ = image.shape
    out = image.copy()
    at = np.random.default_rng(seed).integers(0, h * w, int(h * w * density))
    out.reshape(-1, 3)[at] = 0
    return out


def degrade(image: np.ndarray, difficulty: str, seed: int, **own: float) -> tuple[np.ndarray, dict[str, float]]:
    """The noise of a difficulty, with parameters of one's own, and the parameters that were used."""
    if difficulty not in PRESETS:
        raise ValueError(f"unknown difficulty {difficulty!r}")
    p = PRESETS[difficulty] | own
    return speckle(jpeg(rotate(blur(image, p["blur"]), p["rotation"]), int(p["jpeg"])), p["speckle"], seed), p


def png(image: np.ndarray) -> bytes:
    """An RGB array as a PNG file."""
    h, w, _ = image.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), "u1"), np.ascontiguousarray(image, "u1").reshape(h, 3 * w)], 1)  # each row begins with its filter: none
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def save_image(image: np.ndarray, uri: str) -> None:
    """A PNG file on whatever storage the URI names, folders made as needed; also from a task."""
    fs, path = FileSystem.from_uri(uri) if "://" in uri else (LocalFileSystem(), uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(png(image))


def recognize(image: np.ndarray, lang: str = "eng", psm: int = 6, timeout: float = 30.0) -> str:
    if pytesseract is None:
        raise RuntimeError("recognition needs pytesseract")
    return pytesseract.image_to_string(Image.fromarray(image), lang=lang, config=f"--psm {psm}", timeout=timeout).strip()


def read_samples_by_eye(samples: DataFrame, draw: Callable[[str], np.ndarray] | None = None, read: Callable[[np.ndarray], str] | None = None, image_dir: str | None = None) -> DataFrame:
    """(id, ocr_text) of samples (id, difficulty, raw_text): drawn, degraded and recognized, in partitions.

    draw and read stand for render() and recognize(); with image_dir the degraded images are kept there, by id.
    """
    if (draw is None or read is None) and not is_available():
        raise RuntimeError("the optical track needs Pillow, pytesseract and Tesseract")
    make, say = draw or render, read or recognize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for key, difficulty, text in zip(batch["id"], batch["difficulty"], batch["raw_text"], strict=True):
                image, _ = degrade(make(text), difficulty, zlib.crc32(key.encode()))
                if image_dir:
                    save_image(image, f"{image_dir}/{key}.png")
                said.append(say(image))
            yield pd.DataFrame({"id": batch["id"], "ocr_text": said})

    return samples.select("id", "difficulty", "raw_text").mapInPandas(run, "id string, ocr_text string")


def build_dataset(spark: SparkSession, path: str, per_cell: int = 100, seed: int = 42, draw: Callable[[str], np.ndarray] | None = None, read: Callable[[np.ndarray], str] | None = None, keep_images: bool = True) -> DataFrame:
    """Generates the data set of the optical track below `path` and reads it back: samples in its folder, images beside it.

    Texts come from drawn and degraded images instead of corruptions, so samples have no noise tags.
    """
    from ..plans.run import cut
    from ..sources.records import read_samples, track_folder, write_samples
    from .generate import samples as generated

    samples = cut(generated(spark, per_cell, seed, track="real_ocr").select("source_type", "id", "domain", "difficulty", "track", "split", "task", "raw_text", "gt"))
    said = read_samples_by_eye(samples, draw, read, f"{path}/vision_images" if keep_images else None)
    out = samples.join(said, "id").withColumns({"noise_tags": F.array().cast("array<string>"), "noise_valid": F.lit(True)})
    write_samples(out, track_folder(path, "real_ocr"))
    return read_samples(spark, track_folder(path, "real_ocr"), track="real_ocr")
