"""Images: pixels and metadata from bytes, with NumPy and the standard library."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..functions.numbers import aspect_of

EXTENSIONS = ("png", "jpg", "jpeg", "webp", "gif", "tif", "tiff", "avif", "svg")
#: Longest side that goes to a provider: smaller images are enlarged, larger ones reduced.
SMALLEST, LARGEST = 224, 512


@dataclass
class Image:
    pixels: np.ndarray  # height x width x channels, 8 bits
    format: str
    channels: int
    space: str = "srgb"
    frames: int = 1
    density: int | None = None

    @property
    def has_alpha(self) -> bool:
        return self.pixels.shape[2] in (2, 4)


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """PNG rows without their filters."""
    out = np.zeros((height + 1, stride + step), dtype=np.uint8)  # a row above, a pixel to the left
    for y in range(height):
        at = y * (stride + 1)
        line = np.frombuffer(raw, np.uint8, stride, at + 1)
        up = out[y, step:]
        kind = raw[at]
        if kind == 0:
            out[y + 1, step:] = line
        elif kind == 1:
            whole = line.reshape(-1, step) if stride % step == 0 else line
            out[y + 1, step:] = np.cumsum(whole, axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[y + 1, step:] = line + up
        else:
            row, before = out[y + 1], out[y]
            for x in range(step, stride + step):
                a, b, c = int(row[x - step]), int(before[x]), int(before[x - step])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[x] = (int(line[x - step]) + guess) & 255
    return out[1:, step:]


#: First column and row, and steps between them, of an interlaced image's seven passes.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_png(data: bytes) -> Image:
    at, body, palette, alpha, density = 8, [], None, None, None
    width = height = depth = color = interlace = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = chunk
        elif kind == b"pHYs" and chunk[8] == 1:
            density = round(struct.unpack(">I", chunk[:4])[0] * 0.0254)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
        at += 12 + size
    if not width or not height or not body:
        raise ValueError("PNG without pixels")
    raw = zlib.decompress(b"".join(body))
    per = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]

    def rows(w: int, h: int, raw: bytes) -> np.ndarray:
        stride = (w * per * depth + 7) // 8
        lines = _unfilter(raw, h, stride, max(1, per * depth // 8))
        if depth < 8:
            bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth)
            values = bits @ (1 << np.arange(depth - 1, -1, -1))
            return values[:, : w * per].reshape(h, w, per).astype(np.uint8)
        if depth == 16:
            lines = lines.reshape(h, -1, 2)[:, :, 0]
        return lines.reshape(h, w, per)

    if interlace:
        pixels = np.zeros((height, width, per), dtype=np.uint8)
        for x0, y0, dx, dy in _PASSES:
            w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
            if w > 0 and h > 0:
                pixels[y0::dy, x0::dx] = rows(w, h, raw)
                raw = raw[h * ((w * per * depth + 7) // 8 + 1) :]
    else:
        pixels = rows(width, height, raw)
    channels = per
    if color == 3:
        if palette is None:
            raise ValueError("PNG without a palette")
        index = pixels[:, :, 0]
        pixels, channels = palette[index], 3
        if alpha is not None:
            table = np.full(256, 255, np.uint8)
            table[: len(alpha)] = np.frombuffer(alpha, np.uint8)
            pixels, channels = np.dstack([pixels, table[index]]), 4
    elif depth < 8:
        pixels = (pixels.astype(np.int32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return Image(pixels, "png", channels, "b-w" if color in (0, 4) else "srgb", density=density)


def _lzw(data: bytes, least: int, size: int) -> np.ndarray:
    clear = 1 << least
    table: list[bytes] = []
    out = bytearray()
    width, bits, held, before = least + 1, 0, 0, b""
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code, held, bits = held & ((1 << width) - 1), held >> width, bits - width
            if code == clear:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
                width, before = least + 1, b""
                continue
            if code == clear + 1 or len(out) >= size:
                return np.frombuffer(bytes(out[:size]).ljust(size, b"\0"), np.uint8)
            entry = table[code] if code < len(table) else before + before[:1]
            if before and len(table) < 4096:
                table.append(before + entry[:1])
            out += entry
            before = entry
            if len(table) == 1 << width and width < 12:
                width += 1
    return np.frombuffer(bytes(out[:size]).ljust(size, b"\0"), np.uint8)


def decode_gif(data: bytes) -> Image:
    """The first frame; frames are counted."""
    if data[:4] != b"GIF8":
        raise ValueError("Not a GIF file")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at = 13
    shared = None
    if flags & 128:
        n = 3 * (2 << (flags & 7))
        shared, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
    frames, canvas, clear = 0, np.zeros((height, width, 4), np.uint8), None

    def blocks(at: int) -> tuple[bytes, int]:
        got = []
        while at < len(data) and data[at]:
            got.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(got), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9 and not frames:
                clear = data[at + 6] if data[at + 3] & 1 else None
            _, at = blocks(at + 2)
        elif data[at] == 0x2C:
            x, y, w, h, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            palette = shared
            if own & 128:
                n = 3 * (2 << (own & 7))
                palette, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
            least = data[at]
            body, at = blocks(at + 1)
            frames += 1
            if frames == 1:
                index = _lzw(body, least, w * h).reshape(h, w)
                if own & 64:
                    order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
                    index = index[np.argsort(order)]
                there = np.full((h, w), 255, np.uint8) if clear is None else np.where(index == clear, 0, 255).astype(np.uint8)
                canvas[y : y + h, x : x + w] = np.dstack([palette[np.minimum(index, len(palette) - 1)], there])[: height - y, : width - x]
        else:
            break
    if not frames:
        raise ValueError("GIF without frames")
    opaque = clear is None and bool((canvas[:, :, 3] == 255).all())
    return Image(canvas[:, :, :3] if opaque else canvas, "gif", 3 if opaque else 4, frames=frames)


#: Decoders by format; others can be added, for instance where an imaging library is installed.
DECODERS: dict[str, Callable[[bytes], Image]] = {"png": decode_png, "gif": decode_gif}


def format_of(data: bytes) -> str | None:
    for start, name in ((b"\x89PNG\r\n\x1a\n", "png"), (b"GIF8", "gif"), (b"\xff\xd8\xff", "jpeg"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (b"BM", "bmp")):
        if data.startswith(start):
            return name
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[4:12] == b"ftypavif":
        return "avif"
    return "svg" if b"<svg" in data[:1024] else None


def decode(data: bytes) -> Image:
    name = format_of(data)
    if name is None:
        raise ValueError("Input contains an unsupported image format")
    if name not in DECODERS:
        raise ValueError(f"No decoder for {name} is installed")
    return DECODERS[name](data)


def from_spark(height: int, width: int, channels: int, data: bytes, name: str) -> Image:
    """Pixels of Spark's image source (blue first) as an Image."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels >= 3:
        pixels = pixels[:, :, [2, 1, 0, *range(3, channels)]]
    return Image(pixels, name, channels, "b-w" if channels == 1 else "srgb")


def rgba(image: Image) -> np.ndarray:
    p = image.pixels
    color = np.repeat(p[:, :, :1], 3, axis=2) if p.shape[2] < 3 else p[:, :, :3]
    alpha = p[:, :, -1:] if image.has_alpha else np.full((*p.shape[:2], 1), 255, np.uint8)
    return np.concatenate([color, alpha], axis=2)


def dominant_color(image: Image) -> str:
    """The middle of the fullest of 16 x 16 x 16 cells of colour."""
    cells = rgba(image)[:, :, :3].astype(np.int32) >> 4
    counts = np.bincount((cells[:, :, 0] << 8 | cells[:, :, 1] << 4 | cells[:, :, 2]).reshape(-1), minlength=4096)
    best = int(counts.argmax())
    return "#" + "".join(f"{((best >> s) & 15) * 16 + 8:02x}" for s in (8, 4, 0))


def describe(image: Image) -> dict:
    height, width = image.pixels.shape[:2]
    ratio, aspect = aspect_of(width, height)
    out = {
        "width": width,
        "height": height,
        "aspectRatio": ratio,
        "aspect": aspect,
        "format": image.format,
        "hasAlphaChannel": image.has_alpha,
        "hasTransparency": image.has_alpha and bool((image.pixels[:, :, -1] < 255).any()),
        "dominantColor": dominant_color(image),
        "channels": image.channels,
        "colorSpace": image.space,
    }
    if image.frames > 1:
        out |= {"frames": image.frames, "animated": True}
    if image.density:
        out["density"] = image.density
    return out


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Box means where it shrinks, nearest pixels where it grows."""
    h, w = pixels.shape[:2]
    if width <= w and height <= h:
        ys, xs = np.linspace(0, h, height + 1).astype(int), np.linspace(0, w, width + 1).astype(int)
        sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.float64), ys[:-1], axis=0), xs[:-1], axis=1)
        return np.rint(sums / (np.diff(ys)[:, None, None] * np.diff(xs)[None, :, None])).astype(np.uint8)
    return pixels[np.arange(height) * h // height][:, np.arange(width) * w // width]


def for_embedding(image: Image) -> np.ndarray:
    """RGB on white, its longest side brought into the range that providers take."""
    whole = rgba(image).astype(np.float64)
    share = whole[:, :, 3:] / 255
    flat = np.rint(whole[:, :, :3] * share + 255 * (1 - share)).astype(np.uint8)
    height, width = flat.shape[:2]
    longest = max(width, height)
    if longest < SMALLEST:
        times = -(-SMALLEST // longest)
        return flat.repeat(times, axis=0).repeat(times, axis=1)
    if longest > LARGEST:
        return resize(flat, max(1, round(width * LARGEST / longest)), max(1, round(height * LARGEST / longest)))
    return flat


def encode_png(pixels: np.ndarray) -> bytes:
    """RGB or RGBA pixels as a PNG file."""
    height, width, channels = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6, 1: 0}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")
