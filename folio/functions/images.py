"""Image kernels on gray or BGRA pixel arrays, in NumPy: for pandas functions over binary columns."""

from __future__ import annotations

import numpy as np

from folio.schema import Motion


def gray(bgra: np.ndarray, target_width: int) -> np.ndarray:
    """Block means of a (height, width, 4) image, near the target width, as luma in integers."""
    step = max(1, bgra.shape[1] // target_width)
    h, w = bgra.shape[0] // step, bgra.shape[1] // step
    blocks = bgra[: h * step, : w * step, :3].astype(np.int64).reshape(h, step, w, step, 3).sum(axis=(1, 3))
    return np.minimum(255, blocks @ np.array([29, 150, 77]) // (step * step * 256)).astype(np.uint8)


def rotate(image: np.ndarray, quarter_turns: int) -> np.ndarray:
    """Counter-clockwise quarter turns, like the rotation of boxes whose origin is at the bottom left."""
    return np.rot90(image, quarter_turns % 4)


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return image[max(0, y) : y + h, max(0, x) : x + w]


def downscale(image: np.ndarray, longest: int) -> np.ndarray:
    """Block means so that the longer edge is at most ``longest``; smaller images stay."""
    step = -(-max(image.shape[:2]) // longest)
    if step <= 1:
        return image
    h, w = image.shape[0] // step, image.shape[1] // step
    return image[: h * step, : w * step].reshape(h, step, w, step, *image.shape[2:]).mean(axis=(1, 3)).astype(image.dtype)


def square(pixels: list[int]) -> np.ndarray:
    """A square gray frame from its pixels; what is missing to a square is black."""
    side = int(np.ceil(np.sqrt(len(pixels))))
    out = np.zeros(side * side, np.uint8)
    out[: len(pixels)] = pixels
    return out.reshape(side, side)


def mean_difference(a: np.ndarray, b: np.ndarray) -> float:
    if not a.size or a.shape != b.shape:
        return 0.0
    return float(np.abs(a.astype(np.int64) - b).mean())


def motion_level(a: np.ndarray, b: np.ndarray, rule: Motion = Motion()) -> float:
    """The tile difference that only the most moved quarter of the tiles exceeds."""
    tile = max(1, a.shape[1] // rule.tiles_across)
    rows, cols = a.shape[0] // tile, a.shape[1] // tile
    if not rows:
        return mean_difference(a, b)
    apart = np.abs(a.astype(np.int64) - b)[: rows * tile, : cols * tile]
    tiles = np.sort(apart.reshape(rows, tile, cols, tile).sum(axis=(1, 3)).ravel() / (tile * tile))
    return float(tiles[min(len(tiles) - 1, int(len(tiles) * (1 - rule.quantile)))])


#: Standardized gray values are whole numbers of 1024ths of a deviation, so that all that follows is exact.
UNIT = 1024


def standardized(frame: np.ndarray, least: float = 8.0) -> np.ndarray:
    """Mean zero and deviation ``UNIT``; nearly empty frames keep a deviation of ``least`` so that noise stays small."""
    x = frame.astype(np.int64)
    mean, square = int(x.sum()) / x.size, int((x * x).sum()) / x.size
    return np.floor(UNIT * (x - mean) / max(np.sqrt(max(square - mean * mean, 0.0)), least)).astype(np.int64)


def best_shift(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int]:
    """(dy, dx) that lays b on the inner part of a best: every second pixel over all shifts, then all pixels around the best one."""
    h, w = a.shape
    inner = a[shift : h - shift, shift : w - shift]

    def apart(dy: int, dx: int, step: int) -> tuple[int, int, int]:
        moved = b[shift + dy : h - shift + dy, shift + dx : w - shift + dx]
        return int(np.abs(inner[::step, ::step] - moved[::step, ::step]).sum()), dy, dx

    span = range(-shift, shift + 1)
    _, y, x = min(apart(dy, dx, 2) for dy in span for dx in span)
    _, y, x = min(apart(dy, dx, 1) for dy in span for dx in span if abs(dy - y) <= 1 and abs(dx - x) <= 1)
    return y, x


def changed_share(a: np.ndarray, b: np.ndarray, shift: int = 4, tile: int = 16, texture: float = 0.25, change: float = 0.3) -> float:
    """The share of textured tiles that differ after the best shift; 1 for frames of other or too small sizes."""
    h, w = a.shape
    if a.shape != b.shape or min(h, w) <= 2 * shift + tile:
        return 1.0
    x, y = standardized(a), standardized(b)
    dy, dx = best_shift(x, y, shift)
    rows, cols, n = (h - 2 * shift) // tile, (w - 2 * shift) // tile, tile * tile
    tiles = lambda z, dy, dx: z[shift + dy :, shift + dx :][: rows * tile, : cols * tile].reshape(rows, tile, cols, tile)
    p, q = tiles(x, 0, 0), tiles(y, dy, dx)
    spread = lambda t: n * (t * t).sum(axis=(1, 3)) - t.sum(axis=(1, 3)) ** 2
    textured = np.maximum(spread(p), spread(q)) >= (texture * UNIT * n) ** 2
    changed = textured & (np.abs(p - q).sum(axis=(1, 3)) >= change * UNIT * n)
    return float(changed.sum() / textured.sum()) if textured.any() else 0.0


def gutter_fraction(image: np.ndarray, low: float, high: float, depth: float) -> float | None:
    """The darkest smoothed column of the middle rows within a range of the width, if far enough below the median."""
    image = downscale(image, 600)
    h, w = image.shape
    if w <= 10 or h <= 10:
        return None
    middle = image[h // 5 : h * 4 // 5].astype(np.int64)
    near = np.minimum(np.arange(w) + 2, w - 1) - np.maximum(np.arange(w) - 2, 0) + 1
    smooth = np.convolve(middle.sum(axis=0), np.ones(5, np.int64), "same") / (near * len(middle))
    lower, upper = max(0, int(w * low)), min(w - 1, int(w * high))
    if lower >= upper:
        return None
    at = lower + int(np.argmin(smooth[lower : upper + 1]))
    return at / w if np.sort(smooth)[w // 2] - smooth[at] >= depth else None


def text_free_gap(lines: list[tuple[float, float, float]]) -> tuple[float, float] | None:
    """The widest run of columns without text, between text and with its centre in the middle third, from (x, w, confidence)."""
    usable = [(x, x + w) for x, w, c in lines if c >= 0.5 and w >= 0.05]
    if len(usable) < 4:
        return None
    taken = np.zeros(1002, bool)
    for lo, hi in usable:
        taken[1 + max(0, int(lo * 1000)) : 2 + min(999, int(hi * 1000))] = True
    edges = np.flatnonzero(np.diff(taken[1:-1].astype(np.int8)))
    free = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if not taken[a + 2]]
    free = [(a, b) for a, b in free if b - a >= 9 and 0.35 <= (a + b) / 2000 <= 0.65]
    best = max(free, key=lambda r: (r[1] - r[0], -r[0]), default=None)
    return (best[0] / 1000, (best[1] + 1) / 1000) if best else None


def cut_fraction(image: np.ndarray, mode: str, lines: list[tuple[float, float, float]] = ()) -> float | None:
    """Where a double page is cut, as a share of its width; None if it is one page or the cut would harm text."""
    if mode == "none" or image.shape[1] / max(image.shape[0], 1) < 1.15:
        return None
    gap = text_free_gap(list(lines)) if mode != "middle" else None
    if mode == "middle":
        cut = 0.5
    elif gap:
        found = gutter_fraction(image, *gap, 10)
        cut = sum(gap) / 2 if found is None else found
    else:
        found = gutter_fraction(image, 0.35, 0.65, 20)
        cut = 0.5 if found is None else found
    if any(c >= 0.3 and w > 0 and cut - x >= 0.15 * w and x + w - cut >= 0.15 * w for x, w, c in lines):
        return None
    usable = [(x, x + w) for x, w, c in lines if c >= 0.3]
    if usable and not (any(r < cut - 0.02 for _, r in usable) and any(x > cut + 0.02 for x, _ in usable)):
        return None
    return cut


def split(image: np.ndarray, mode: str, lines: list[tuple[float, float, float]] = ()) -> list[np.ndarray]:
    """The image as one or two pages, left before right."""
    cut = cut_fraction(image, mode, lines)
    if cut is None:
        return [image]
    at = round(image.shape[1] * cut)
    return [image[:, :at], image[:, at:]]


def prepare(image: np.ndarray, mode: str, turns: int, lines: list[tuple[float, float, float]] = (), auto_rotate: bool = True) -> list[np.ndarray]:
    """Upright pages of a capture; lines, in upright boxes, count only if the image stands as they do."""
    if auto_rotate:
        return split(rotate(image, turns), mode, lines)
    return split(image, mode, lines if turns % 4 == 0 else ())
