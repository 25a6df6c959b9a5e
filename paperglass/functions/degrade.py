"""Image degradations of scanned and faded paper, in numpy.

An image is a row (height, width, pixels): red, green and blue bytes, row by row.
Every random choice comes from a generator seeded by the document's key and the
condition, so a repeated task makes the same image.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Stages (name, probability, intensity) of each condition, paper tints.
PRESETS: dict[str, list[tuple[str, float, float]]] = {
    "clean": [],
    "bad_scan": [("scanner_bed", 1.0, 0.50), ("lighting_gradient", 1.0, 0.45), ("scanner_artifacts", 1.0, 0.65), ("camera_noise", 1.0, 0.25), ("jpeg_compress", 1.0, 0.40)],
    "faded": [("thermal_fade", 1.0, 0.60), ("lighting_gradient", 1.0, 0.30), ("camera_noise", 1.0, 0.20), ("jpeg_compress", 1.0, 0.25)],
}
TINTS = ((255, 252, 248), (248, 250, 255), (255, 255, 245), (252, 248, 245), (248, 252, 248))
# End of fixed values.

Stage = Callable[[np.ndarray, float, np.random.Generator], np.ndarray]


def _bytes(image: np.ndarray) -> np.ndarray:
    return np.clip(image, 0, 255).astype(np.uint8)


def _contrast(image: np.ndarray, factor: float) -> np.ndarray:
    grey = (image @ np.array([0.299, 0.587, 0.114])).mean()
    return grey + (image - grey) * factor


def _blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur over the first two axes, edges repeated."""
    reach = max(1, int(3 * sigma + 0.5))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight /= weight.sum()
    for axis in (0, 1):
        wide = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in range(image.ndim)], mode="edge")
        image = sum(w * np.take(wide, np.arange(k, k + image.shape[axis]), axis=axis) for k, w in enumerate(weight))
    return image


def _enlarged(field: np.ndarray, height: int, width: int) -> np.ndarray:
    """A small field stretched over an image, linear between its points."""
    rows = np.stack([np.interp(np.linspace(0, field.shape[1] - 1, width), np.arange(field.shape[1]), r) for r in field])
    return np.stack([np.interp(np.linspace(0, field.shape[0] - 1, height), np.arange(field.shape[0]), c) for c in rows.T], axis=1)


def scanner_bed(image: np.ndarray, intensity: float, rng: np.random.Generator) -> np.ndarray:
    """The page slightly turned on a dark scanner bed that shows around it."""
    height, width = image.shape[:2]
    angle = np.deg2rad(rng.uniform(-1.5, 1.5) * intensity)
    pad = [int(n * rng.uniform(0.02, 0.08)) for n in (height, width)]
    out = np.empty((height + 2 * pad[0], width + 2 * pad[1], 3), np.uint8)
    out[:] = rng.integers(10, 46, 3)
    shift = rng.integers(-15, 16, 2)
    y, x = np.mgrid[: out.shape[0], : out.shape[1]]
    y, x = y - out.shape[0] / 2 - shift[0], x - out.shape[1] / 2 - shift[1]
    from_y = np.rint(np.cos(angle) * y + np.sin(angle) * x + height / 2).astype(int)
    from_x = np.rint(-np.sin(angle) * y + np.cos(angle) * x + width / 2).astype(int)
    inside = (from_y >= 0) & (from_y < height) & (from_x >= 0) & (from_x < width)
    out[inside] = image[from_y[inside], from_x[inside]]
    return out


def _bump(height: int, width: int, at: tuple[float, float], spread: float) -> np.ndarray:
    y, x = np.ogrid[:height, :width]
    return np.exp(-((x - at[0] * width) ** 2 + (y - at[1] * height) ** 2) / (2 * spread**2))


def lighting_gradient(image: np.ndarray, intensity: float, rng: np.random.Generator) -> np.ndarray:
    """Uneven light: a slope, one bright spot, or two."""
    height, width = image.shape[:2]
    across = np.hypot(height, width)
    kind = rng.integers(3)
    if kind == 0:
        way = rng.integers(3)
        y, x = np.linspace(0, 1, height)[:, None], np.linspace(0, 1, width)[None]
        slope = (x + 0 * y, y + 0 * x, (x + y) / 2)[way]
        slope = 1 - slope if way < 2 and rng.random() > 0.5 else slope
        light = 1 - 0.12 * intensity + slope * 0.27 * intensity
    elif kind == 1:
        light = 1 + 0.15 * intensity * _bump(height, width, (rng.uniform(0.2, 0.8), rng.uniform(0.2, 0.8)), 0.21 * across)
    else:
        first = _bump(height, width, (rng.uniform(0.1, 0.4), rng.uniform(0.1, 0.4)), 0.2 * across)
        second = _bump(height, width, (rng.uniform(0.6, 0.9), rng.uniform(0.6, 0.9)), 0.15 * across)
        light = 1 + 0.1 * intensity * (0.6 * first + 0.4 * second)
    return _bytes(image * light[:, :, None])


def thermal_fade(image: np.ndarray, intensity: float, rng: np.random.Generator) -> np.ndarray:
    """Old thermal paper: yellowed, pale towards the edges, streaked, scratched."""
    height, width = image.shape[:2]
    made = np.clip(image + 0.10 * intensity * np.array([45.0, 28.0, -18.0]), 0, 255)
    made = np.clip(_contrast(made, 1 - 0.35 * intensity), 0, 255) * (1 - 0.08 * intensity)
    patches = rng.uniform(1 - 0.22 * intensity, 1 + 0.05 * intensity, (max(4, height // 40), max(4, width // 40)))
    y, x = np.ogrid[:height, :width]
    edge = np.hypot(x - width / 2, y - height / 2) / np.hypot(height / 2, width / 2)
    made = made * (_enlarged(patches, height, width) * (1 - 0.35 * intensity * edge))[:, :, None]
    for _ in range(rng.integers(3, 9)):
        at, thick = rng.integers(height), rng.integers(1, 4)
        made[max(0, at - thick) : at + thick] *= rng.uniform(0.82, 0.94)
    for _ in range(rng.integers(0, int(4 * intensity) + 2)):
        start, way = np.array([rng.integers(height), rng.integers(width)]), rng.integers(-50, 51, 2)
        line = np.rint(start + np.linspace(0, 1, 101)[:, None] * way).astype(int)
        line = line[((line >= 0) & (line < [height, width])).all(axis=1)]
        made[line[:, 0], line[:, 1]] = rng.integers([20, 20, 20], [51, 51, 61])
    return _bytes(made)


def scanner_artifacts(image: np.ndarray, intensity: float, rng: np.random.Generator) -> np.ndarray:
    """A copier's tint, uneven exposure and grain; weaker on small pages."""
    if min(image.shape[:2]) < 600:
        intensity = max(0.2, 0.7 * intensity)
    share = 0.04 + 0.06 * intensity
    made = image * (1 - share) + np.array(TINTS[rng.integers(len(TINTS))]) * share
    made = _contrast(made * rng.uniform(0.90, 1.04), rng.uniform(0.88, 1.04))
    return _bytes(made + rng.normal(0, 3 + 10 * intensity, image.shape))


def camera_noise(image: np.ndarray, intensity: float, rng: np.random.Generator) -> np.ndarray:
    """Sensor noise, and slight defocus where it is strong."""
    made = _bytes(image + rng.normal(0, 1.5 + 5 * intensity, image.shape))
    return _bytes(_blurred(made.astype(float), 0.2 + 0.5 * intensity)) if intensity > 0.4 else made


def jpeg_compress(image: np.ndarray, intensity: float, rng: np.random.Generator) -> np.ndarray:
    """The losses of block compression: cosine transform of 8 x 8 blocks, rounded
    to steps that grow with frequency and fall with quality."""
    quality = int(np.clip(int(92 - 50 * intensity), 25, 92))
    scale = (5000 / quality if quality < 50 else 200 - 2 * quality) / 100
    k = np.arange(8)
    basis = np.sqrt(np.where(k == 0, 1, 2) / 8)[:, None] * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / 16)
    step = np.maximum(1, scale * (10 + 6 * (k[:, None] + k[None])))
    height, width = image.shape[:2]
    wide = np.pad(image.astype(float) - 128, [(0, -height % 8), (0, -width % 8), (0, 0)], mode="edge")
    blocks = wide.reshape(wide.shape[0] // 8, 8, -1, 8, 3)
    turned = np.einsum("ui,aibjc,vj->aubvc", basis, blocks, basis)
    turned = np.rint(turned / step[None, :, None, :, None]) * step[None, :, None, :, None]
    back = np.einsum("ui,aubvc,vj->aibjc", basis, turned, basis).reshape(wide.shape)
    return _bytes(np.rint(back[:height, :width]) + 128)


STAGES: dict[str, Stage] = {f.__name__: f for f in (scanner_bed, lighting_gradient, thermal_fade, scanner_artifacts, camera_noise, jpeg_compress)}


def seeded(key: str, salt: str) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{key}:{salt}".encode()).digest()[:8], "big"))


def degraded(image: np.ndarray, preset: str, rng: np.random.Generator, stages: dict[str, Stage] = STAGES) -> tuple[np.ndarray, list[str]]:
    """The image under a condition, and the stages that failed and were skipped.
    An unknown condition is a bad scan."""
    failed = []
    for name, probability, intensity in PRESETS.get(preset, PRESETS["bad_scan"]):
        if name not in stages or rng.random() > probability:
            continue
        strength = float(np.clip(intensity * rng.uniform(0.95, 1.05), 0.05, 1.0))
        try:
            image = stages[name](image, strength, rng)
        except Exception:  # noqa: BLE001 - a stage that fails leaves the image as it was
            failed.append(name)
    return image, failed


def degrade_images(images: DataFrame, key: str, presets: tuple[str, ...] = tuple(PRESETS), stages: dict[str, Stage] = STAGES) -> DataFrame:
    """(key, condition, height, width, pixels, failed): each image under each
    condition.  An image whose bytes do not fit its size has null pixels."""
    kind = images.schema[key].dataType.simpleString()
    names = [key, "condition", "height", "width", "pixels", "failed"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, height, width, pixels = (batch.column(c)[k].as_py() for c in range(4))
                rows = []
                for preset in presets:
                    if pixels is None or len(pixels) != 3 * (height or 0) * (width or 0) or not pixels:
                        rows.append((name, preset, height, width, None, []))
                        continue
                    image = np.frombuffer(pixels, np.uint8).reshape(height, width, 3)
                    out, failed = degraded(image, preset, seeded(str(name), preset), stages)
                    rows.append((name, preset, *out.shape[:2], out.tobytes(), failed))
                columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return images.select(key, "height", "width", "pixels").mapInArrow(made, f"`{key}` {kind}, condition string, height int, width int, pixels binary, failed array<string>")


def fitted(height: int, width: int, most: int) -> tuple[int, int]:
    """The size of an image whose longer side is at most ``most``."""
    if max(height, width) <= most:
        return height, width
    return (int(height * (most / width)), most) if width > height else (most, int(width * (most / height)))


def resized(image: np.ndarray, most: int) -> np.ndarray:
    """The image within ``most``: each pixel the mean of those it stands for."""
    height, width = (max(1, n) for n in fitted(*image.shape[:2], most))
    if (height, width) == image.shape[:2]:
        return image
    rows, cols = ((np.arange(n) * full // n).astype(int) for n, full in zip((height, width), image.shape[:2]))
    total = np.add.reduceat(np.add.reduceat(image.astype(float), rows, axis=0), cols, axis=1)
    share = np.diff(np.append(rows, image.shape[0]))[:, None] * np.diff(np.append(cols, image.shape[1]))[None]
    return _bytes(np.rint(total / share[:, :, None]))


def png(image: np.ndarray) -> bytes:
    """The image as a PNG file."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.concatenate([np.zeros((image.shape[0], 1), np.uint8), image.reshape(image.shape[0], -1)], axis=1)
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")
