"""Pixels, as a boundary of numpy functions that run in Python workers over binaryFile rows.

PNG, BMP and PPM are read and written here; JPEG and TIFF need Pillow, and without it count as undecodable. Images are
arrays of 8-bit numbers, (height, width) for grey and (height, width, 3) for red, green, blue.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"


# Files


def decode(raw: bytes) -> np.ndarray | None:
    """An image, or null if the bytes are none that can be read."""
    try:
        if raw[:8] == PNG:
            return _png(raw)
        if raw[:2] == b"BM":
            return _bmp(raw)
        if raw[:2] in (b"P5", b"P6"):
            return _pnm(raw)
        import io

        from PIL import Image

        with Image.open(io.BytesIO(raw)) as im:
            return np.asarray(im.convert("L" if im.mode in ("1", "L") else "RGB"))
    except Exception:  # whatever is wrong with a file, it is undecodable
        return None


def _png(raw: bytes) -> np.ndarray:
    at, data, palette = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    if depth != 8 or interlaced:
        raise ValueError("only 8 bits a channel, in order")
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    before = np.zeros(width * channels, np.int64)
    for y in range(height):
        line = _unfiltered(rows[y, 0], rows[y, 1:].astype(np.int64), before, channels)
        out[y] = line
        before = line
    image = out.reshape(height, width, channels)
    if color == 3:
        return palette[image[:, :, 0]]
    return image[:, :, 0] if channels < 3 else image[:, :, :3]


def _unfiltered(kind: int, line: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes from its differences to the left (1), above (2), their mean (3) or the nearest of three (4)."""
    if kind == 0:
        return line
    if kind == 2:
        return (line + up) % 256
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), 0).ravel() % 256
    out = line.copy()
    for i in range(len(line)):
        a, b, c = (out[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
        if kind == 3:
            out[i] = (line[i] + (a + b) // 2) % 256
        else:
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))
            out[i] = (line[i] + near[2]) % 256
    return out


def _bmp(raw: bytes) -> np.ndarray:
    start, (width, height), bits = struct.unpack("<I", raw[10:14])[0], struct.unpack("<ii", raw[18:26]), struct.unpack("<H", raw[28:30])[0]
    if bits not in (24, 32):
        raise ValueError("only 24 or 32 bits")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    image = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(image[::-1] if height > 0 else image)


def _pnm(raw: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        end = at
        while not raw[end : end + 1].isspace():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    width, height, _ = fields
    shape = (height, width) if raw[:2] == b"P5" else (height, width, 3)
    return np.frombuffer(raw, np.uint8, int(np.prod(shape)), at + 1).reshape(shape)


def encode(image: np.ndarray, level: int = 3) -> bytes:
    """A PNG file."""
    image = image if image.ndim == 3 else image[:, :, None]
    height, width, channels = image.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1).astype(np.uint8)], 1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def size(content: Column) -> Column:
    """(width, height) of an image, or null."""

    @F.pandas_udf("struct<width:int,height:int>")
    def of(s: pd.Series) -> pd.DataFrame:
        found = [decode(bytes(x)) if x is not None else None for x in s]
        return pd.DataFrame({"width": pd.array([None if x is None else x.shape[1] for x in found], "Int32"), "height": pd.array([None if x is None else x.shape[0] for x in found], "Int32")})

    return of(content)


def mask_likeness(content: Column) -> Column:
    """How much an image looks like a mask: the share of nearly black or white pixels and that of nearly black ones."""

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return s.map(lambda x: likeness(decode(bytes(x))) if x is not None else 0.0).astype(float)

    return F.coalesce(score(content), F.lit(0.0))


def likeness(image: np.ndarray | None) -> float:
    if image is None:
        return 0.0
    small = resized(grey(image), 128, 128)
    dark = small < 20
    return float((dark | (small > 235)).mean() + dark.mean())


# Geometry


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """By the mean of the pixels that a new one covers, or (where it grows) of its neighbours."""
    out = image.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        first = np.moveaxis(out, axis, 0)
        out = np.moveaxis((_weights(len(first), n) @ first.reshape(len(first), -1)).reshape(n, *first.shape[1:]), 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _weights(old: int, new: int) -> np.ndarray:
    w = np.zeros((new, old))
    if new < old:
        edges = np.linspace(0, old, new + 1)
        for i in range(new):
            a, b = edges[i], edges[i + 1]
            cover = np.clip(np.minimum(np.arange(old) + 1, b) - np.maximum(np.arange(old), a), 0, None)
            w[i] = cover / cover.sum()
    else:
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, old - 1)
        w[np.arange(new), low] += 1 - (at - low)
        w[np.arange(new), high] += at - low
    return w


def ordered(points: np.ndarray) -> np.ndarray:
    """Four points as top left, top right, bottom right, bottom left."""
    total, gap = points.sum(1), points[:, 1] - points[:, 0]
    return points[[total.argmin(), gap.argmin(), total.argmax(), gap.argmax()]].astype(float)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four points to four points."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def warped(image: np.ndarray, matrix: np.ndarray, width: int, height: int, fill=0, nearest: bool = False) -> np.ndarray:
    """The image under a matrix: each new pixel from where it came, by its four neighbours or the nearest one."""
    y, x = np.mgrid[0:height, 0:width]
    back = np.linalg.inv(matrix) @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    u, v = back[0] / back[2], back[1] / back[2]
    h, w = image.shape[:2]
    inside = (u > -1) & (v > -1) & (u < w) & (v < h)
    src = image.reshape(h, w, -1).astype(np.float64)
    pad = np.empty((h + 2, w + 2, src.shape[2]))
    pad[:] = fill
    pad[1:-1, 1:-1] = src
    u, v = np.where(inside, u, -1) + 1, np.where(inside, v, -1) + 1
    if nearest:
        out = pad[np.clip(np.rint(v), 0, h + 1).astype(int), np.clip(np.rint(u), 0, w + 1).astype(int)]
    else:
        i, j = np.clip(np.floor(v), 0, h).astype(int), np.clip(np.floor(u), 0, w).astype(int)
        a, b = (v - i)[:, None], (u - j)[:, None]
        out = pad[i, j] * (1 - a) * (1 - b) + pad[i, j + 1] * (1 - a) * b + pad[i + 1, j] * a * (1 - b) + pad[i + 1, j + 1] * a * b
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape(height, width, *image.shape[2:])


def straightened(image: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The document within four corners, as if seen from above."""
    p = ordered(points)
    edge = lambda i, j: int(np.linalg.norm(p[i] - p[j]))
    width, height = max(edge(2, 3), edge(1, 0), 1), max(edge(1, 2), edge(0, 3), 1)
    target = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    return warped(image, homography(p, target), width, height)


def blurred(image: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(out.ndim)], "reflect" if out.shape[axis] > r else "edge")
        out = sum(w * np.take(padded, range(i, i + out.shape[axis]), axis) for i, w in enumerate(k))
    return out


def edges(image: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Where brightness changes strongly, or clearly beside such a place."""
    g = blurred(grey(image), 1.1)
    dy, dx = np.gradient(g)
    strength = 4 * (np.abs(dx) + np.abs(dy))
    strong, weak = strength > high, strength > low
    for _ in range(8):
        grown = strong.copy()
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                grown |= np.roll(np.roll(strong, a, 0), b, 1)
        strong = grown & weak | strong
    return strong


def thickened(mask: np.ndarray, r: int = 2) -> np.ndarray:
    out = mask.copy()
    for axis in (0, 1):
        out = np.logical_or.reduce([np.roll(out, k, axis) for k in range(-r, r + 1)])
    return out


def components(mask: np.ndarray) -> np.ndarray:
    """Numbers of connected regions, 0 outside: runs of each row are joined with those they touch above."""
    label, parent = np.zeros(mask.shape, int), [0]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    before: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        flips = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for a, b in zip(flips[::2], flips[1::2], strict=True):
            over = {find(k) for s, e, k in before if s <= b and e >= a}
            k = min(over) if over else len(parent)
            if not over:
                parent.append(k)
            for other in over:
                parent[find(other)] = k
            label[y, a:b] = k
            now.append((a, b, k))
        before = now
    return np.array([find(i) for i in range(len(parent))])[label]


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the least convex shape around points."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    sides = []
    for run in (p, p[::-1]):
        out: list = []
        for q in run:
            while len(out) > 1 and cross(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        sides += out[:-1]
    return np.array(sides)


def area(corners: np.ndarray) -> float:
    x, y = corners[:, 0], corners[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def least_rectangle(corners: np.ndarray) -> tuple[np.ndarray, float]:
    """The smallest rectangle around a convex shape, and its angle in degrees: one of its sides lies on one of the shape's."""
    best = None
    for i in range(len(corners)):
        d = corners[(i + 1) % len(corners)] - corners[i]
        t = float(np.arctan2(d[1], d[0])) % (np.pi / 2)
        turn = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
        q = corners @ turn.T
        low, high = q.min(0), q.max(0)
        if best is None or np.prod(high - low) < best[0]:
            box = np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]])
            best = (np.prod(high - low), box @ turn, float(np.degrees(t)))
    return best[1], best[2]


def simplified(corners: np.ndarray, count: int = 4) -> np.ndarray:
    """A convex shape without those corners that matter least for its area, down to `count`."""
    p = list(map(tuple, corners))
    while len(p) > count:
        loss = [area(np.array([p[i - 1], p[i], p[(i + 1) % len(p)]])) for i in range(len(p))]
        p.pop(int(np.argmin(loss)))
    return np.array(p, float)


def document_corners(image: np.ndarray, tried: int = 10) -> np.ndarray | None:
    """Four corners of the document in a picture: of the ten largest outlines the first that covers 8 % of it and is close
    to a quadrilateral; else the rectangle around the largest, from 5 % on; else null."""
    found = components(thickened(edges(image)))
    shapes = []
    for k in np.unique(found)[1:]:
        y, x = np.nonzero(found == k)
        if np.ptp(x) * np.ptp(y) >= 0.01 * found.size:
            h = hull(np.stack([x, y], 1).astype(float))
            if len(h) > 2:
                shapes.append((area(h), h))
    shapes.sort(key=lambda s: -s[0])
    for size_, h in shapes[:tried]:
        four = simplified(h)
        if size_ >= 0.08 * found.size and len(four) == 4 and area(four) >= 0.93 * size_:
            return four
    if not shapes or shapes[0][0] < 0.05 * found.size:
        return None
    return least_rectangle(shapes[0][1])[0]


# Recognition


def contrasted(image: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Local contrast: each tile's histogram, clipped and made even; pixels take the mean of the four nearest tiles."""
    h, w = image.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = image[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            n = np.bincount(part.ravel(), minlength=256).astype(float)
            most = max(1.0, clip * part.size / 256)
            over = np.clip(n - most, 0, None).sum()
            maps[i, j] = np.cumsum(np.minimum(n, most) + over / 256) * 255 / part.size
    v, u = (np.clip((np.arange(n) + 0.5) * tiles / n - 0.5, 0, tiles - 1) for n in (h, w))
    i, j = np.floor(v).astype(int), np.floor(u).astype(int)
    i1, j1 = np.minimum(i + 1, tiles - 1), np.minimum(j + 1, tiles - 1)
    a, b = (v - i)[:, None], (u - j)[None, :]
    of = lambda r, c: maps[r[:, None], c[None, :], image]
    out = of(i, j) * (1 - a) * (1 - b) + of(i, j1) * (1 - a) * b + of(i1, j) * a * (1 - b) + of(i1, j1) * a * b
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def median(image: np.ndarray) -> np.ndarray:
    """Each pixel as the middle one of its nine."""
    p = np.pad(image, 1, "edge")
    h, w = image.shape
    return np.median(np.stack([p[a : a + h, b : b + w] for a in range(3) for b in range(3)]), 0).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The level that splits brightness into two classes that are furthest apart."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (total[-1] * below - total * below[-1]) ** 2 / (below * (below[-1] - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def ready_for_ocr(image: np.ndarray, least: int = 1200, most: int = 2200) -> np.ndarray:
    """Width within bounds, grey, contrast made even, noise smoothed, edges sharpened, black and white."""
    h, w = image.shape[:2]
    target = min(max(w, least), most)
    g = grey(image if target == w else resized(image, target, int(h * (target / w))))
    g = median(contrasted(g))
    sharp = np.clip(np.rint(1.35 * g - 0.35 * blurred(g, 1.0)), 0, 255).astype(np.uint8)
    m = median(sharp)
    return np.where(m > otsu(m), 255, 0).astype(np.uint8)


def deskewed(image: np.ndarray, most: float = 12.0, least_pixels: int = 100) -> np.ndarray:
    """Turned by the angle of the rectangle around its dark pixels, if that is small."""
    g = 255 - grey(image)
    y, x = np.nonzero(g > otsu(g))
    if len(x) < least_pixels:
        return image
    shape = hull(np.stack([x, y], 1).astype(float))
    if len(shape) < 3:
        return image
    angle = least_rectangle(shape)[1]
    angle = angle - 90 if angle > 45 else angle
    if not angle or abs(angle) > most:
        return image
    h, w = image.shape[:2]
    t, c = np.radians(-angle), np.array([w // 2, h // 2], float)
    turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    matrix = np.eye(3)
    matrix[:2, :2], matrix[:2, 2] = turn, c - turn @ c
    return warped(image, matrix, w, h, fill=np.median(image.reshape(h * w, -1), 0))


def oriented(image: np.ndarray, document_type: str) -> np.ndarray:
    """Types that lie broad side down are turned so."""
    return np.rot90(image, -1) if document_type.startswith(("CNH", "RG")) and image.shape[0] > image.shape[1] else image


def rectified(image: np.ndarray, document_type: str, most: int = 1200) -> tuple[np.ndarray, dict]:
    """The document in a picture, straightened and turned, with what was done."""
    h, w = image.shape[:2]
    scale = min(1.0, most / max(h, w))
    small = image if scale == 1 else resized(image, int(w * scale), int(h * scale))
    corners = document_corners(small)
    facts = {"contour_found": corners is not None, "scale": scale, "fallback": corners is None, "corners": None if corners is None else np.round(corners / scale, 2).tolist()}
    out = image if corners is None else straightened(image, corners / scale)
    return deskewed(np.ascontiguousarray(oriented(out, document_type))), facts


RECTIFIED = "doc_id string, document_type string, rectified binary, pre_ocr binary, contour_found boolean, fallback boolean, scale double, error string"


def rectify(images: DataFrame) -> DataFrame:
    """images (doc_id, document_type, content) → their two versions for recognition as PNG, with what was done; an error
    instead where an image can't be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc_id, kind, content in zip(b["doc_id"], b["document_type"], b["content"], strict=True):
                row = {"doc_id": doc_id, "document_type": kind, "rectified": None, "pre_ocr": None, "contour_found": None, "fallback": None, "scale": None, "error": None}
                image = decode(bytes(content)) if content is not None else None
                if image is None:
                    row["error"] = "undecodable image"
                else:
                    flat, facts = rectified(image, kind or "")
                    row |= {"rectified": encode(flat), "pre_ocr": encode(ready_for_ocr(flat)), **{k: facts[k] for k in ("contour_found", "fallback", "scale")}}
                yield pd.DataFrame([row]).astype({"doc_id": object, "document_type": object, "error": object, "contour_found": object, "fallback": object})

    return images.select("doc_id", "document_type", "content").mapInPandas(run, RECTIFIED)


# Augmentation


class Scenario:
    """Draws the transforms of a scenario from their ranges, and applies them to an image, its mask and its boxes."""

    def __init__(self, steps: tuple, seed: int, fill: tuple[int, ...]):
        self.steps, self.rng, self.fill = steps, np.random.default_rng(seed), fill

    def apply(self, image: np.ndarray, mask: np.ndarray, boxes: np.ndarray, least: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[dict]]:
        """boxes (n, 4) as x, y, width, height. Returns image, mask, boxes, which boxes are left, and records."""
        image = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, 2)
        h, w = image.shape[:2]
        kept, records = np.arange(len(boxes)), []
        for name, ranges, chance in self.steps:
            if self.rng.random() >= chance:
                continue
            drawn = {k: float(self.rng.uniform(lo, hi)) for k, (lo, hi) in ranges.items()}
            if name in ("affine", "perspective"):
                matrix = getattr(self, f"_{name}")(w, h, drawn, ranges)
                image, mask = warped(image, matrix, w, h, self.fill), warped(mask, matrix, w, h, 0, nearest=True)
                boxes, left = self._moved(boxes, matrix, w, h, least)
                kept = kept[left]
            else:
                image = getattr(self, f"_{name}")(image.astype(float), drawn)
                image = np.clip(np.rint(image), 0, 255).astype(np.uint8)
            records.append({"name": name, "params": drawn, "applied_to": ["image", "mask", "annotations"] if name in ("affine", "perspective") else ["image"]})
        return image, mask, boxes, kept, records

    def _affine(self, w: int, h: int, p: dict, ranges: dict) -> np.ndarray:
        t, s, shear = np.radians(p["rotate"]), p["scale"], np.tan(np.radians(p["shear"]))
        down = float(self.rng.uniform(*ranges["translate"]))
        c = np.array([w / 2, h / 2])
        m = np.eye(3)
        m[:2, :2] = s * np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]) @ np.array([[1, shear], [0, 1]])
        m[:2, 2] = c - m[:2, :2] @ c + np.array([p["translate"] * w, down * h])
        return m

    def _perspective(self, w: int, h: int, p: dict, ranges: dict) -> np.ndarray:
        corners = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
        inward = np.abs(self.rng.normal(0, p["scale"], (4, 2))).clip(0, 0.4) * [w, h]
        return homography(corners, corners + inward * np.array([[1, 1], [-1, 1], [-1, -1], [1, -1]]))

    @staticmethod
    def _moved(boxes: np.ndarray, matrix: np.ndarray, w: int, h: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        if not len(boxes):
            return boxes, np.empty(0, int)
        x, y, bw, bh = boxes.T
        corners = np.stack([np.stack([x, x + bw, x + bw, x], 1), np.stack([y, y, y + bh, y + bh], 1), np.ones((len(boxes), 4))], 1)
        q = np.einsum("ij,njk->nik", matrix, corners)
        q = q[:, :2] / q[:, 2:]
        low, high = np.clip(q.min(2), 0, [w, h]), np.clip(q.max(2), 0, [w, h])
        left = np.flatnonzero((high - low >= least).all(1))
        return np.concatenate([low, high - low], 1)[left], left

    def _brightness_contrast(self, x: np.ndarray, p: dict) -> np.ndarray:
        return x * (1 + p["contrast"]) + 255 * p["brightness"]

    def _hue_saturation(self, x: np.ndarray, p: dict) -> np.ndarray:
        mean = x.mean(2, keepdims=True)
        turned = mean + (x - mean) * (1 + p["saturation"] / 255) + p["value"]
        return turned + np.array([p["hue"], 0, -p["hue"]])

    def _shadow(self, x: np.ndarray, p: dict) -> np.ndarray:
        h, w = x.shape[:2]
        y, u = np.mgrid[0:h, 0:w]
        for _ in range(max(1, round(p["shadows"]))):
            t, at = self.rng.uniform(0, 2 * np.pi), self.rng.uniform(0.2, 0.8)
            side = (np.cos(t) * (u / w - at) + np.sin(t) * (y / h - at)) > 0
            x = x * np.where(side, 1 - p["intensity"], 1)[:, :, None]
        return x

    def _blur(self, x: np.ndarray, p: dict) -> np.ndarray:
        return blurred(x, p["size"] / 4)

    def _noise(self, x: np.ndarray, p: dict) -> np.ndarray:
        return x + self.rng.normal(0, 255 * p["std"], x.shape)

    def _compression(self, x: np.ndarray, p: dict) -> np.ndarray:
        """What is left when brightness is kept in steps, wider at lower quality."""
        step = 1 + (100 - p["quality"]) / 6
        return np.rint(x / step) * step


AUGMENTED = "class_name string, document_id string, variant int, scenario string, seed long, image binary, mask binary, annotation string, n_boxes int, transforms string, error string"


def augment(planned: DataFrame, steps: dict[str, tuple], least: float = 2.0) -> DataFrame:
    """planned (class_name, document_id, variant, scenario, seed, is_augmented, color, image, mask, boxes) → the outputs of a
    plan: images and masks as PNG, annotations as text, records as JSON. Originals pass as they are; boxes are structs
    (x, y, width, height, transcription)."""
    import json

    def rows(boxes: np.ndarray, texts: list[str]) -> str:
        quote = lambda t: '"' + t.replace('"', '""') + '"' if any(c in t for c in ',"') else t
        return "\n".join(["x,y,width,height,transcription", *(",".join([*(str(int(round(v))) for v in b), quote(t)]) for b, t in zip(boxes, texts, strict=True))]) + "\n"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                held = list(r["boxes"]) if r["boxes"] is not None else []
                boxes, texts = np.array([[x["x"], x["y"], x["width"], x["height"]] for x in held], float).reshape(-1, 4), [x["transcription"] or "" for x in held]
                out = {k: r[k] for k in ("class_name", "document_id", "variant", "scenario", "seed")} | {"image": None, "mask": None, "annotation": None, "n_boxes": 0, "transforms": "[]", "error": None}
                if not r["is_augmented"]:
                    out |= {"image": r["image"], "mask": r["mask"], "annotation": rows(boxes, texts), "n_boxes": len(texts)}
                elif (image := decode(bytes(r["image"]))) is None or (mask := decode(bytes(r["mask"]))) is None:
                    out["error"] = "undecodable image"
                else:
                    image, mask, boxes, kept, records = Scenario(steps[r["scenario"]], int(r["seed"]), tuple(r["color"])).apply(image, grey(mask), boxes, least)
                    out |= {"image": encode(image), "mask": encode(mask), "annotation": rows(boxes, [texts[i] for i in kept]), "n_boxes": len(kept), "transforms": json.dumps(records)}
                yield pd.DataFrame([out]).astype({c: object for c in ("class_name", "document_id", "scenario", "annotation", "transforms", "error")})

    return planned.select("class_name", "document_id", "variant", "scenario", "seed", "is_augmented", "color", "image", "mask", "boxes").mapInPandas(run, AUGMENTED)
