"""Texts as numpy arrays: words, 64-bit hashes of words and of runs, exact comparison of byte ranges, sliding minima.

Hashes are not polynomials: every step multiplies and folds the high bits back, so texts with a regular structure don't
collide together. Hashes bring candidates together; what is deleted or linked is compared byte by byte (``same_bytes``)
or word by word. Arithmetic is modulo 2**64.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mixed((np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BYTES = _splitmix(256, 7)
LEFT, STIR = U(0x9DDFEA08EB382D69), U(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Words longer than this many bytes are hashed by a digest function.
SHORT = 32
TAIL = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], U)


def stirred(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    x = left * LEFT
    x += right
    x ^= x >> U(29)
    x *= STIR
    x ^= x >> U(32)
    return x


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values, by start: runs of two, four, eight ... values, then two that overlap."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h, size = values, 1
    while 2 * size <= k:
        h = stirred(h[:-size], h[size:])
        size *= 2
    return stirred(h[:n], h[k - size : k - size + n]) if size < k else h[:n]


def eights(data: np.ndarray | bytes) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number; zeros follow the data."""
    raw = (data.tobytes() if isinstance(data, np.ndarray) else data) + bytes(16)
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def common_bytes(x: np.ndarray, at: np.ndarray, y: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes, at most ``most``, agree from ``at`` in x and from ``place`` in y on; x and y are ``eights``."""
    out = np.array(most, np.int64)
    left, done = np.flatnonzero(out > 0), 0
    while len(left):
        differ = x[at[left] + done] ^ y[place[left] + done]
        some = differ != 0
        low = differ[some]
        ends = left[some]
        same = np.bitwise_count((low & (~low + U(1))) - U(1)).astype(np.int64) >> 3
        out[ends] = np.minimum(out[ends], done + same)
        done += 8
        left = left[~some]
        left = left[out[left] > done]
    return out


def same_bytes(x: np.ndarray, at: np.ndarray, y: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from ``at`` in x and from ``place`` in y are equal."""
    return common_bytes(x, at, y, place, size) == size


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost minimum of x[i:i+w] for each i: block prefix and suffix minima."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(x) > 1 << 23:  # places have 24 bits below
        step = (1 << 23) - w + 1
        return np.concatenate([sliding_argmin(x[i : i + step + w - 1], w) + i for i in range(0, n, step)])
    size = -(-len(x) // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, U)
    padded[: len(x)] = x
    # the place is packed below the value's high bits, so that equal values order by place
    packed = (padded & ~U(0xFFFFFF)) | (np.arange(size, dtype=U) & U(0xFFFFFF))
    rows = packed.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & U(0xFFFFFF)).astype(np.int64)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each followed by a space; and where each starts (one more: the end)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


def words_in(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of each word, and how many words lie before each text (one more: all)."""
    edge = np.flatnonzero(np.diff(IS_SPACE[data].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    a, b = edge[::2], edge[1::2]
    return a, b, np.searchsorted(a, starts)


def word_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """Hashes of the words data[a:b]: eight bytes a step, and a digest of words over SHORT bytes. Other seeds give
    independent hashes."""
    if lower:
        data = LOWER[data]
    raw = data.tobytes()
    at, size = eights(raw), b - a
    h = mixed(size.astype(U) + U(seed) * STIR)
    left = np.flatnonzero(size <= SHORT)
    for done in range(0, SHORT, 8):
        left = left[size[left] > done]
        if not len(left):
            break
        rest = np.minimum(size[left] - done, 8)
        h[left] = stirred(h[left], mixed(at[a[left] + done] & TAIL[rest]))
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[a[i] : b[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def chunks(texts: list[bytes], limit: int = 1 << 20):
    """Ranges of texts of about ``limit`` bytes together; one text may be longer."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) + 1 > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
