"""Image headers and pixel statistics from bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def image_format(c: Column) -> Column:
    """The format by the first bytes."""
    head = F.hex(F.substring(c, 1, 8))
    return (F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("474946383"), "gif").when(head.startswith("424D"), "bmp")
            .when(head.startswith("01000000"), "emf").when(head.startswith("D7CDC69A"), "wmf").otherwise("unknown"))


def header_size(data: bytes | None) -> tuple[int | None, int | None]:
    """Width and height in pixels from the header; (None, None) where it has none."""
    if not data or len(data) < 10:
        return None, None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8":
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(data):
            if data[i] != 0xFF:
                i += 1
                continue
            kind = data[i + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[i + 5 : i + 9])
                return w, h
            i += 2 + (0 if 0xD0 <= kind <= 0xD9 or kind == 0xFF else struct.unpack(">H", data[i + 2 : i + 4])[0])
    return None, None


def decode_png(data: bytes) -> np.ndarray | None:
    """RGB pixels of an 8-bit, not interlaced PNG; None for other kinds."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, packed, palette = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or lace or colour not in (0, 2, 3, 4, 6):
                return None
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * planes)
    out = np.zeros((h, w * planes), np.uint8)
    prev = np.zeros(w * planes, np.int32)
    for y in range(h):
        f, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if f == 2:
            line = (line + prev) & 255
        elif f:
            for x in range(len(line)):
                a = line[x - planes] if x >= planes else 0
                b, c = prev[x], prev[x - planes] if x >= planes else 0
                if f == 1:
                    p = a
                elif f == 3:
                    p = (a + b) // 2
                else:
                    d = (abs(b - c), abs(a - c), abs(a + b - 2 * c))
                    p = a if d[0] <= d[1] and d[0] <= d[2] else b if d[1] <= d[2] else c
                line[x] = (line[x] + p) & 255
        out[y], prev = line, line
    px = out.reshape(h, w, planes)
    if colour == 3:
        return palette[px[:, :, 0]]
    return np.repeat(px[:, :, :1], 3, axis=2) if planes < 3 else px[:, :, :3]


def encode_png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB PNG of an array (height, width, 3)."""
    h, w, _ = rgb.shape
    raw = np.concatenate((np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, w * 3)), axis=1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


MEASURES = ("luma", "dark", "saturation", "grey", "background", "vivid", "transitions", "busy_rows")
STATS = T.StructType([T.StructField(n, T.DoubleType()) for n in MEASURES] + [T.StructField(n, T.IntegerType()) for n in ("colours", "width", "height")])


def pixel_stats(data: bytes | None) -> tuple:
    """Measures of an image: mean luma (0 to 1), share of dark pixels, mean saturation, shares of grey pixels and of the
    commonest colour (3 bits a channel), share of vivid pixels, mean number of changes between light and dark on a scan line,
    share of lines with many changes; number of colours; size. Images that can't be decoded have a size only."""
    w, h = header_size(data)
    px = decode_png(data) if data else None
    if px is None or not px.size:
        return (*(None,) * len(MEASURES), None, w, h)
    f = px.astype(np.float64)
    top, spread = f.max(axis=2), f.max(axis=2) - f.min(axis=2)
    luma = f @ np.array([0.299, 0.587, 0.114])
    share = spread / np.maximum(top, 1)
    _, n = np.unique((px >> 5).astype(np.int32) @ np.array([64, 8, 1]), return_counts=True)
    at = np.s_[:: max(1, px.shape[0] // 120), :: max(1, px.shape[1] // 200)]  # scan lines, a few hundred points each
    light = luma[at] > 110
    changes = (light[:, 1:] != light[:, :-1]).sum(axis=1)
    vivid = (share[at] >= 0.35) & (top[at] >= 80)
    return (float((luma / 255).mean()), float((luma / 255 < 0.25).mean()), float(share.mean()), float((spread < 25).mean()), float(n.max() / n.sum()), float(vivid.mean()), float(changes.mean()), float((changes >= 12).mean()), len(n), w, h)


@F.pandas_udf(STATS)
def image_stats(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([pixel_stats(x) for x in data], columns=STATS.names)


# fixed values: thresholds of the decision ladder
DARK, BRIGHT, FEW_DARK, DENSE, SPARSE, BUSY, COLOURFUL, VIVID, GREY = 0.60, 0.75, 0.15, 15.0, 11.5, 0.40, 45, 0.02, 0.85


def image_kind(s: Column) -> Column:
    """console, dashboard, diagram, text or unknown, from the measures; an image between two thresholds stays unknown."""
    dense = (s["transitions"] >= DENSE) & (s["busy_rows"] >= BUSY)
    on_dark = F.when(dense, "console").when(s["transitions"] <= SPARSE, "dashboard").otherwise("unknown")
    on_bright = F.when((s["colours"] >= COLOURFUL) & (s["vivid"] >= VIVID) & ~dense, "diagram").when((s["grey"] >= GREY) & (s["vivid"] < VIVID), "text").otherwise("unknown")
    return F.when(s["dark"] >= DARK, on_dark).when((s["luma"] >= BRIGHT) & (s["dark"] <= FEW_DARK), on_bright).otherwise("unknown")


def aspect_ratio(width: Column, height: Column, shown_width: Column, shown_height: Column) -> Column:
    """Width by height of the pixels, else of the place on the page; null where neither has both sides."""
    of = lambda w, h: F.when((w > 0) & (h > 0), w / h)
    return F.coalesce(of(width, height), of(shown_width, shown_height))
