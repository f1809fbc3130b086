"""Word shingles of texts as 64-bit hashes, and SuperMinHash signatures of them, in numpy.

Runs inside tasks on Arrow batches. Texts are hashed whole, a chunk of documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C55
_PINV = pow(_P, -1, 1 << 64)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
_U = np.uint64

#: Bytes of text that are hashed together, and elements whose signatures are made together.
CHUNK_BYTES, CHUNK_ITEMS = 1 << 18, 20_000

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64, at least n of them."""
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, CHUNK_BYTES + 1), base, dtype=_U)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; A-Z count as a-z.

    A text with fewer words than a shingle has its whole word sequence as one; without words it has none.
    """
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK_BYTES):
            size += len(texts[j]) + 1
            j += 1
        out += _chunk(texts[i:j], words)
        i = j
    return out


def _chunk(texts: list[bytes], k: int) -> list[np.ndarray]:
    b = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    lo, hi = edge[::2], edge[1::2]
    sums = np.zeros(len(b) + 1, dtype=_U)
    np.cumsum((b.astype(_U) + _U(1)) * _power(_P, len(b)), out=sums[1:])
    h = mix((sums[hi] - sums[lo]) * _power(_PINV, len(b))[lo] + (hi - lo).astype(_U))
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(lo, np.concatenate(([0], ends)))
    n = len(h) - k + 1
    grams = np.zeros(max(n, 0), dtype=_U)
    if n > 0:
        for i in range(k):
            grams = grams * _MIX[3] + h[i:i + n]
        grams = mix(grams)
    out = []
    for a, z in zip(first[:-1], first[1:], strict=True):
        if z - a >= k:
            out.append(np.unique(grams[a:z - k + 1]))
        elif z > a:
            x = np.zeros(1, dtype=_U)
            for i in range(a, z):
                x = x * _MIX[3] + h[i]
            out.append(mix(x + _U(z - a)))
        else:
            out.append(np.empty(0, dtype=_U))
    return out


def super_min_hash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of m values for each set (Ertl 2017): bin b holds the least j + r over elements whose
    own random permutation puts rank j into b, with r uniform for each element and rank.

    Ranks are dealt to all elements of a chunk at once. A set is done as soon as no bin is empty:
    later ranks only give larger values, which is the early stop of the sequential form.
    """
    sig = np.full((len(sets), m), np.inf)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= CHUNK_ITEMS):
            size += len(sets[j])
            j += 1
        _signatures(sets[i:j], sig[i:j])
        i = j
    return sig


def _signatures(sets: list[np.ndarray], sig: np.ndarray) -> None:
    m = sig.shape[1]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.empty(0, dtype=_U)
    flat, perm = sig.reshape(-1), None
    for j in range(m):
        if j:
            empty = np.isinf(sig).any(axis=1)[owner]
            if not empty.any():
                return
            if perm is None:
                owner, x = owner[empty], x[empty]
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(x), 1))
                at = np.arange(len(x))
                perm[at, 0], perm[at, k[empty]] = perm[at, k[empty]], 0
            elif empty.sum() < 0.5 * len(empty):
                owner, x, perm = owner[empty], x[empty], perm[empty]
                at = np.arange(len(x))
        z = mix(x + _U((j + 1) * int(_MIX[2]) % (1 << 64)))
        r = (z >> _U(11)).astype(np.float64) * 2.0**-53
        k = j + (mix(z + _MIX[3]) % _U(m - j)).astype(np.int64)
        if perm is None:
            bins = k
        else:
            bins = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, j]
            perm[at, j] = bins
        np.minimum.at(flat, owner * m + bins, j + r)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    v = mix(sig[:, : bands * rows].copy().view(_U)).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), v.shape[:2]).copy()
    for i in range(rows):
        key = key * _MIX[3] + v[:, :, i]
    return mix(key).view(np.int64)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def signature_batches(words: int, bands: int, rows: int):
    """For mapInArrow over (doc_id, text, hash): size, a 128-bit key of the set, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                sets = shingle_sets(_bytes(part.column("text")), words)
                full = np.array([len(s) > 0 for s in sets], dtype=bool)
                keys = band_keys(super_min_hash(sets, bands * rows), bands, rows) if len(sets) else np.empty((0, bands), np.int64)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(full * bands))).astype(np.int32), pa.array(keys[full].reshape(-1)))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("hash"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([s.sum(dtype=_U) for s in sets], dtype=_U).view(np.int64)),
                    pa.array(np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], dtype=_U).view(np.int64)),
                    lists], names=["doc_id", "hash", "n_shingles", "key1", "key2", "bands"])

    return run


def gram_batches(words: int):
    """For mapInArrow over (set, lead, guest, text): one row for each distinct shingle of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = shingle_sets(_bytes(part.column("text")), words)
                at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                grams = np.concatenate(sets) if sets else np.empty(0, dtype=_U)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("set", "lead", "guest")), pa.array(grams.view(np.int64))], names=["set", "lead", "guest", "gram"])

    return run


def overlap_batches(words: int):
    """For mapInArrow over (a, b, text_a, text_b): the sizes of the two sets and of their intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                left, right = _bytes(part.column("text_a")), _bytes(part.column("text_b"))
                unique = list(dict.fromkeys(left + right))
                made = dict(zip(unique, shingle_sets(unique, words), strict=True))
                found = [(len(made[x]), len(made[y]), len(np.intersect1d(made[x], made[y], assume_unique=True))) for x, y in zip(left, right, strict=True)]
                counts = np.array(found, dtype=np.int32).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *(pa.array(counts[:, k]) for k in range(3))], names=["a", "b", "n_a", "n_b", "both"])

    return run
