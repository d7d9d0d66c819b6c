"""Seeded draws that depend only on (seed, instance, sample, feature, draw).

Every random word is ``hash(k, key)`` with Spark's built-in ``hash`` (32-bit Murmur3, published by A. Appleby), where the
BIGINT key is made of two hashes of (seed, instance_id, sample_id) with different seeds.  The number of the word comes
first, so the words of two samples are all equal only if all 64 bits of their keys are: rows of draws do not recur.  A word therefore does not depend on partitioning, task
retries or row order, which ``rand()`` would.  The built-in keeps the generated Java small: a
hand-written mixer made of column arithmetic passes the JIT's 8000-byte method limit at four
features and runs more than ten times slower.

Features come in pairs, four words per pair p: ``4p`` and ``4p + 1`` decide the two masks,
``4p + 2`` is the Box-Muller radius and ``4p + 3`` the angle; the even feature takes the cosine and
the odd one the sine, two independent normals for one logarithm.  The NumPy twins at the end give
the same words to the Arrow tasks that handle wide instances.
"""

from __future__ import annotations

import math

import numpy as np

WORDS_PER_PAIR = 4
TWO_31 = 2147483648
TWO_32 = 4294967296


def check_seed(seed: int) -> int:
    if not -TWO_31 <= seed < TWO_31:
        raise ValueError(f"seed must fit in 32 bits, got {seed}")
    return int(seed)


def double(value: float) -> str:
    """A SQL DOUBLE literal that keeps every bit of ``value``."""
    value = float(value)
    if not math.isfinite(value):
        raise ValueError(f"not a finite number: {value}")
    return f"{value!r}D"


SECOND = 1540483477  # flips bits of the seed for the lower half of a key


def sample_key(seed: int | str, instance_id: str = "instance_id", sample_id: str = "sample_id") -> str:
    """``seed`` is a number or the name of an INT column that holds one."""
    first = seed if isinstance(seed, str) else check_seed(seed)
    second = f"({seed} ^ {SECOND})" if isinstance(seed, str) else check_seed(seed) ^ SECOND
    halves = [f"bigint(hash({s}, {instance_id}, {sample_id}))" for s in (first, second)]
    return f"(shiftleft({halves[0]}, 32) | ({halves[1]} & {TWO_32 - 1}L))"


def mask_test(key: str, draw: str | int, mask_prob: float) -> str:
    """True where the uniform draw is below ``mask_prob``; the hash is compared unscaled."""
    return f"hash({draw}, {key}) < {double(mask_prob * TWO_32 - TWO_31)}"


def mask_word(f: int) -> int:
    return WORDS_PER_PAIR * (f // 2) + f % 2


def radius(key: str, pair: str | int) -> str:
    """``ln`` is declared nullable, so ``coalesce`` keeps null checks out of the generated code."""
    uniform = f"(hash({_word(pair, 2)}, {key}) + {TWO_31 + 1}D) * {double(1 / TWO_32)}"
    return f"sqrt(-2D * coalesce(ln({uniform}), 0D))"


def angle(key: str, pair: str | int) -> str:
    return f"(hash({_word(pair, 3)}, {key}) + {TWO_31}D) * {double(2 * math.pi / TWO_32)}"


def _word(pair: str | int, k: int) -> str | int:
    return WORDS_PER_PAIR * pair + k if isinstance(pair, int) else f"{WORDS_PER_PAIR} * ({pair}) + {k}"


def pair_columns(d: int, key: str = "sample_key") -> list[str]:
    """Columns _r0, _a0, _r1, _a1, ..: radius and angle of every pair of features, apart from what rows may carry (r2)."""
    return [
        f"{draw(key, p)} AS {name}{p}" for p in range((d + 1) // 2) for draw, name in ((radius, "_r"), (angle, "_a"))
    ]


def normal(f: int) -> str:
    """The normal of feature ``f`` from the columns of its pair."""
    return f"_r{f // 2} * {'sin' if f % 2 else 'cos'}(_a{f // 2})"


def cell_mask(f: str, mask_prob: float, key: str = "sample_key") -> str:
    """``mask_test`` for a feature index that is itself a column."""
    return mask_test(key, f"int({f} + 2 * ({f} DIV 2))", mask_prob)


def cell_normal(f: str, key: str = "sample_key") -> str:
    pair = f"int({f} DIV 2)"
    return f"{radius(key, pair)} * if({f} % 2 = 0, cos({angle(key, pair)}), sin({angle(key, pair)}))"


# --- the same words for Arrow batches ---------------------------------------------------------
# Fixed values of 32-bit Murmur3.
_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
_H5 = np.uint32(0xE6546B64)
_F1, _F2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
SPARK_HASH_SEED = 42


def _rotate(x, r):
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _mix(word):
    return _rotate(word * _C1, 15) * _C2


def _absorb_mixed(h, mixed):
    return _rotate(h ^ mixed, 13) * np.uint32(5) + _H5


def _absorb(h, word):
    return _absorb_mixed(h, _mix(word))


def _finish(h, n_bytes):
    h = h ^ np.uint32(n_bytes)
    h = (h ^ (h >> np.uint32(16))) * _F1
    h = (h ^ (h >> np.uint32(13))) * _F2
    return h ^ (h >> np.uint32(16))


def hash_int(word, h):
    return _finish(_absorb(h, word), 4)


def hash_long(value, h):
    bits = value.astype(np.int64).view(np.uint64)
    low = (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (bits >> np.uint64(32)).astype(np.uint32)
    return _finish(_absorb(_absorb(h, low), high), 8)


def sample_keys(seed: int, instance_id: np.ndarray, sample_id: np.ndarray) -> np.ndarray:
    """The key of every pair as its two words (high, low), shape (2, instances, samples)."""
    start = np.full(1, SPARK_HASH_SEED, np.uint32)
    halves = []
    for s in (check_seed(seed), check_seed(seed) ^ SECOND):
        h = hash_int(np.array([s], np.int64).astype(np.uint32), start)
        h = hash_long(instance_id, np.broadcast_to(h, instance_id.shape))
        halves.append(hash_int(sample_id.astype(np.uint32)[None, :], h[:, None]))
    return np.stack(halves)


def words(keys: np.ndarray, indexes: np.ndarray) -> np.ndarray:
    """``hash(index, key) + 2**31`` for every key and index, as unsigned words."""
    high, low = (_mix(k)[..., None] for k in keys)
    h = hash_int(indexes.astype(np.uint32), np.full(1, SPARK_HASH_SEED, np.uint32))
    return _finish(_absorb_mixed(_absorb_mixed(h, low), high), 8) ^ np.uint32(TWO_31)


# Up to here blocks are kept feature by feature: sums over a handful of features are then sums of long vectors.
NARROW = 8


def draw_offsets(keys, x0, means, mask_prob, noise_std):
    """Offsets ``x - x0`` and the 0/1 mask for keys (2, m, b) and instances (m, D)."""
    d = x0.shape[-1]
    if d <= NARROW:
        return _narrow_offsets(keys, x0, means, mask_prob, noise_std)
    f, pairs = np.arange(d), np.arange((d + 1) // 2)
    masked = words(keys, WORDS_PER_PAIR * (f // 2) + f % 2).astype(np.float64) < mask_prob * TWO_32
    r = np.sqrt(-2.0 * np.log((words(keys, WORDS_PER_PAIR * pairs + 2) + 1.0) * (1 / TWO_32)))
    a = words(keys, WORDS_PER_PAIR * pairs + 3) * (2 * math.pi / TWO_32)
    noise = np.empty((*keys.shape[1:], d))
    noise[..., ::2] = r * np.cos(a)
    noise[..., 1::2] = (r * np.sin(a))[..., : d // 2]
    return np.where(masked, (means - x0)[:, None, :], noise_std * noise), masked


def _narrow_offsets(keys, x0, means, mask_prob, noise_std):
    """The same, (m, b, D) views of arrays that lie feature by feature; one word of all samples is in memory at a time."""
    d, shape = x0.shape[-1], keys.shape[1:]
    high, low = (_mix(k) for k in keys)
    h, spare = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    off, masked, angles = np.empty((d, *shape)), np.empty((d, *shape), bool), np.empty(shape)

    def word(index: int) -> np.ndarray:
        return _word_into(h, spare, low, high, index)

    for p in range((d + 1) // 2):
        r = np.add(word(WORDS_PER_PAIR * p + 2), 1.0)
        r *= 1 / TWO_32
        np.sqrt(np.multiply(np.log(r, out=r), -2.0, out=r), out=r)
        np.multiply(word(WORDS_PER_PAIR * p + 3), 2 * math.pi / TWO_32, out=angles)
        for f, wave in zip(range(2 * p, min(2 * p + 2, d)), (np.cos, np.sin)):
            wave(angles, out=off[f])
            off[f] *= r
            off[f] *= noise_std
            np.less(word(mask_word(f)), mask_prob * TWO_32, out=masked[f])
            np.copyto(off[f], (means[f] - x0[:, f])[:, None], where=masked[f])
    return np.moveaxis(off, 0, -1), np.moveaxis(masked, 0, -1)


def _word_into(h, spare, low, high, index: int) -> np.ndarray:
    """``words`` of one index, in h."""

    def rotate_13():
        np.right_shift(h, np.uint32(19), out=spare)
        np.left_shift(h, np.uint32(13), out=h)
        np.bitwise_or(h, spare, out=h)

    def fold(bits):
        np.right_shift(h, np.uint32(bits), out=spare)
        np.bitwise_xor(h, spare, out=h)

    np.bitwise_xor(low, hash_int(np.array([index], np.uint32), np.full(1, SPARK_HASH_SEED, np.uint32)), out=h)
    for then in (high, np.uint32(8)):
        rotate_13()
        np.multiply(h, np.uint32(5), out=h)
        np.add(h, _H5, out=h)
        np.bitwise_xor(h, then, out=h)
    fold(16)
    np.multiply(h, _F1, out=h)
    fold(13)
    np.multiply(h, _F2, out=h)
    fold(16)
    return np.bitwise_xor(h, np.uint32(TWO_31), out=h)


def along(off: np.ndarray, w) -> np.ndarray:
    """``off @ w`` for offsets (m, b, D) and weights (D,) or, one vector for each row, (m, D)."""
    if off.shape[-1] > NARROW:
        return off @ w if w.ndim == 1 else np.einsum("mbd,md->mb", off, w)
    parts = [w[..., f, None] if w.ndim > 1 else w[f] for f in range(off.shape[-1])]
    out = off[..., 0] * parts[0]
    for f in range(1, len(parts)):
        out += off[..., f] * parts[f]
    return out


def squared(off: np.ndarray) -> np.ndarray:
    """The squared lengths of offsets (m, b, D)."""
    if off.shape[-1] > NARROW:
        return (off * off).sum(2)
    out = off[..., 0] * off[..., 0]
    for f in range(1, off.shape[-1]):
        out += off[..., f] * off[..., f]
    return out
