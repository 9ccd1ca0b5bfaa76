"""Word shingles of many texts as 64-bit hashes, and registers of their minima, in NumPy."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; a longer text is cut at white space.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = _random(256, 1)
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.full(n, x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word: a polynomial over its bytes, read off one running sum over the buffer."""
    a = np.frombuffer(buffer, np.uint8)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(max(len(a), PIECE))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * power[: len(a)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def _pieces(text: bytes):
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of every word (maximal run without the six ASCII white-space characters), in order."""
    hashes, owners, held, offsets, numbers = [], [], [], [], []
    size = 0

    def flush():
        nonlocal size
        if held:
            h, start = _word_hashes(b"\n".join(held))
            hashes.append(h)
            owners.append(np.repeat(np.array(numbers), np.diff(np.append(np.searchsorted(start, np.array(offsets)), len(start)))))
            held.clear(), offsets.clear(), numbers.clear()
            size = 0

    for k, text in enumerate(texts):
        for piece in _pieces(text):
            if size + len(piece) > PIECE:
                flush()
            held.append(piece)
            offsets.append(size)
            numbers.append(k)
            size += len(piece) + 1
    flush()
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners).astype(np.int64)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct k-word shingles of text i are hashes[bounds[i]:bounds[i + 1]], ascending.

    A text of fewer than k words has its whole sequence as one shingle, a text without words has none.
    """
    return word_sets(*words_of(texts), len(texts), k)


def word_sets(word: np.ndarray, owner: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_sets(), of texts whose words words_of() has given."""
    with np.errstate(over="ignore"):
        count = np.bincount(owner, minlength=texts)
        first = np.concatenate([[0], np.cumsum(count)])
        weight = _random(k, 2) | np.uint64(1)
        n = max(len(word) - k + 1, 0)
        run = np.zeros(n, np.uint64)
        for j in range(k):
            run += word[j : j + n] * weight[j]
        whole = owner[:n] == owner[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
        size = np.where(count < k, np.minimum(count, 1), count - k + 1)
        bounds = np.concatenate([[0], np.cumsum(size)])
        o = np.repeat(np.arange(texts), size)
        h = np.empty(len(o), np.uint64)
        h[(count >= k)[o]] = mix(run[whole])
        for i in np.flatnonzero((count > 0) & (count < k)):
            w = word[first[i] : first[i + 1]]
            h[bounds[i]] = mix(np.array([(w * weight[: len(w)]).sum() + np.uint64(len(w))], np.uint64))[0]
        # Sorting each set where it lies takes a tenth of the time of sorting all by text and hash.
        for i in np.flatnonzero(size > 1):
            h[bounds[i] : bounds[i + 1]].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(o[new], minlength=texts))]).astype(np.int64)


def set_names(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums per set that name it, whatever the order; 0 for an empty set."""
    out = []
    with np.errstate(over="ignore"):
        for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(seed)))])
            out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def minima(hashes: np.ndarray, bounds: np.ndarray, buckets: int) -> np.ndarray:
    """Least hash per set (row) and bucket (column); each bucket hashes with a function of its own. Sets must not be empty."""
    out = np.empty((len(bounds) - 1, buckets), np.uint64)
    factor, shift = _random(buckets, 3) | np.uint64(1), _random(buckets, 4)
    with np.errstate(over="ignore"):
        for b in range(buckets):
            x = (hashes ^ shift[b]) * factor[b]
            x ^= x >> np.uint64(32)
            out[:, b] = np.minimum.reduceat(x * factor[b], bounds[:-1])
    return out


def pack(registers: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Signed 64-bit integers that each hold the registers of one band."""
    r = registers.astype(np.uint64).reshape(len(registers), -1, rows)
    out = np.zeros(r.shape[:2], np.uint64)
    for j in range(rows):
        out |= r[:, :, j] << np.uint64(j * bits)
    return out.view(np.int64)


def equal_registers(a: np.ndarray, b: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Number of equal registers of signatures packed by pack(); a and b broadcast against each other."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    mask, out = np.uint64((1 << bits) - 1), 0
    for j in range(rows):
        out = out + ((x >> np.uint64(j * bits)) & mask == 0).sum(-1)
    return out
