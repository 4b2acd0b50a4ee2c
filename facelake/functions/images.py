"""Image arithmetic in numpy, for use inside Arrow-batched functions. Images are height x width x 3, RGB."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def _triangle(size_in: int, size_out: int) -> np.ndarray:
    """Weights of a bilinear resampling along one axis; the triangle widens when an image shrinks."""
    scale = size_in / size_out
    reach = max(scale, 1.0)
    centre = (np.arange(size_out) + 0.5) * scale
    distance = np.abs(np.arange(size_in) + 0.5 - centre[:, None]) / reach
    weights = np.maximum(0.0, 1.0 - distance)
    return weights / weights.sum(axis=1, keepdims=True)


def whole(values: np.ndarray) -> np.ndarray:
    """Pixel values as bytes: the nearest, halves to the even one, whatever the last digits of the sums."""
    return np.clip(np.rint(np.round(values, 6)), 0, 255).astype(np.uint8)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    rows, columns = _triangle(image.shape[0], height), _triangle(image.shape[1], width)
    out = np.einsum("hy,yxc,wx->hwc", rows, image.astype(np.float64), columns, optimize=True)
    return whole(out)


def flip(image: np.ndarray) -> np.ndarray:
    return image[:, ::-1]


def to_tensor(image: np.ndarray) -> np.ndarray:
    """Channels first, from -1 to 1."""
    return ((image.astype(np.float32) / 255.0 - 0.5) / 0.5).transpose(2, 0, 1)


def fit_similarity(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 2 x 3 similarity from source to target points; not a number where all source points coincide."""
    s, t = source - source.mean(0), target - target.mean(0)
    square = (s**2).sum()
    if square <= 1e-12:
        return np.full((2, 3), np.nan)
    a, b = (s * t).sum() / square, (s[:, 0] * t[:, 1] - s[:, 1] * t[:, 0]).sum() / square
    linear = np.array([[a, -b], [b, a]])
    return np.column_stack([linear, target.mean(0) - linear @ source.mean(0)])


def warp(image: np.ndarray, matrix: np.ndarray, size: int) -> np.ndarray:
    """The square image that a similarity maps the image to: bilinear, black outside."""
    inverse = np.linalg.inv(np.vstack([matrix, [0, 0, 1]]))
    y, x = np.mgrid[:size, :size]
    u, v, _ = np.tensordot(inverse, np.stack([x, y, np.ones_like(x)]).astype(float), 1)
    padded = np.pad(image.astype(np.float64), ((1, 2), (1, 2), (0, 0)))
    u, v = np.clip(u, -1, image.shape[1]) + 1, np.clip(v, -1, image.shape[0]) + 1
    left, top = np.floor(u).astype(int), np.floor(v).astype(int)
    du, dv = (u - left)[..., None], (v - top)[..., None]
    upper = padded[top, left] * (1 - du) + padded[top, left + 1] * du
    lower = padded[top + 1, left] * (1 - du) + padded[top + 1, left + 1] * du
    return whole(upper * (1 - dv) + lower * dv)


def from_row(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """An image of Spark's image source as RGB: it holds blue first, one channel for grey, four with alpha."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


#: Digits, point and percent sign as five rows of three dots.
GLYPHS = dict(zip("0123456789.%", ("75557", "26227", "71747", "71717", "55711", "74717", "74757", "71111", "75757", "75717", "00002", "51245"), strict=True))
ROWS = {c: [int(x) for x in g] for c, g in GLYPHS.items()}


def label(score: float) -> np.ndarray:
    """A score as the dots of its percentage."""
    text = f"{score * 100:.1f}%"
    out = np.zeros((5, 4 * len(text)), bool)
    for i, c in enumerate(text):
        for y, row in enumerate(ROWS[c]):
            for x in range(3):
                out[y, 4 * i + x] = row >> (2 - x) & 1
    return out


def png(image: np.ndarray) -> bytes:
    """An RGB image as a PNG file."""
    height, width, _ = image.shape
    rows = np.hstack([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image).reshape(height, 3 * width)])

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def draw(image: np.ndarray, boxes: list[list[float]], landmarks: list[list[list[float]]], scores: list[float] = (), color=(0, 255, 0), thickness: int = 2) -> np.ndarray:
    """A copy with box outlines, landmark dots and the scores inside the boxes' corners."""
    out = image.copy()
    for (x0, y0, *_), score in zip(boxes, scores, strict=False):
        dots = label(score)
        y, x = max(int(y0) + thickness + 1, 0), max(int(x0) + thickness + 1, 0)
        part = out[y : y + dots.shape[0], x : x + dots.shape[1]]
        part[dots[: part.shape[0], : part.shape[1]]] = color
    for x0, y0, x1, y1 in (map(int, b) for b in boxes):
        for t in range(thickness):
            out[max(y0 + t, 0) : y0 + t + 1, max(x0, 0) : x1 + 1] = color
            out[max(y1 - t, 0) : y1 - t + 1, max(x0, 0) : x1 + 1] = color
            out[max(y0, 0) : y1 + 1, max(x0 + t, 0) : x0 + t + 1] = color
            out[max(y0, 0) : y1 + 1, max(x1 - t, 0) : x1 - t + 1] = color
    for points in landmarks:
        for x, y in points:
            out[max(int(y) - 1, 0) : int(y) + 2, max(int(x) - 1, 0) : int(x) + 2] = color
    return out
