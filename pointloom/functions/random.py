"""Classic 32-bit generators as column expressions on longs: seeds, single steps, and skips of any number of steps.

A step returns the next state (or states), the output last. A `skip_` function gives the state after n steps, n a column (null or
negative: none), in a number of operations that grows with the bits of n, not with n, so that streams can be dealt out to rows:
affine maps are squared, multiply-with-carry states are powers modulo a prime, shift registers are linear maps over bits whose
matrices are squared once, on the driver.

All arithmetic is on non-negative longs below 2**32, whose products stay below 2**63 where the factor is below 2**31; wider
products are decimals.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, functions as F

_M = 0xFFFFFFFF
#: Factor and addend of the congruence; factors of both 16-bit multiply-with-carry parts and of the 64-bit one; for
#: each shift register its two shifts, the bits it keeps, and the shift of these.
CONG = (69069, 12345)
MWC = (36969, 18000)
MWC64 = 698769069
LFSR113 = ((6, 13, 0xFFFFFFFE, 18), (2, 27, 0xFFFFFFF8, 2), (13, 21, 0xFFFFFFF0, 7), (3, 12, 0xFFFFFF80, 13))
LFSR88 = ((13, 19, 0xFFFFFFFE, 12), (2, 25, 0xFFFFFFF8, 4), (3, 11, 0xFFFFFFF0, 17))
#: Moduli of the multiply-with-carry states; their multiples, 0 among them, are no states.
PRIMES = tuple((f << 16) - 1 for f in MWC)
PRIME64 = (MWC64 << 32) - 1


def _and(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_M))


def _shl(c: Column, k: int) -> Column:
    return _and(F.shiftleft(c, k))


def _shr(c: Column, k: int) -> Column:
    return F.shiftrightunsigned(c, k)


def cong(s: Column) -> Column:
    """Linear congruence."""
    return _and(s * CONG[0] + CONG[1])


def shr3(s: Column) -> Column:
    """Three shifts; the state must not be 0."""
    s = s.bitwiseXOR(_shl(s, 13))
    s = s.bitwiseXOR(_shr(s, 17))
    return s.bitwiseXOR(_shl(s, 5))


def mwc(upper: Column, lower: Column) -> tuple[Column, Column, Column]:
    """Two 16-bit multiply-with-carry parts: next upper, next lower, output by shifting the upper one."""
    u, v = (_and(f * x.bitwiseAND(F.lit(0xFFFF)) + _shr(x, 16)) for f, x in zip(MWC, (upper, lower), strict=True))
    return u, v, mwc1_output(u, v)


def mwc1_output(upper: Column, lower: Column) -> Column:
    return _and(_shl(upper, 16) + lower)


def mwc2_output(upper: Column, lower: Column) -> Column:
    """The same states' output by turning the upper one."""
    return _and(_shl(upper, 16) + _shr(upper, 16) + lower)


def mwc2(upper: Column, lower: Column) -> tuple[Column, Column, Column]:
    """Both parts with the upper one turned: next upper, next lower, output."""
    u, v, _ = mwc(upper, lower)
    return u, v, mwc2_output(u, v)


def lfsr113(z: tuple[Column, Column, Column, Column]) -> tuple[Column, Column, Column, Column, Column]:
    """Four combined shift registers: next states, output."""
    out = []
    for s, (a, b, keep, c) in zip(z, LFSR113, strict=True):
        t = _shr(_shl(s, a).bitwiseXOR(s), b)
        out.append(_shl(s.bitwiseAND(F.lit(keep)), c).bitwiseXOR(t))
    return (*out, out[0].bitwiseXOR(out[1]).bitwiseXOR(out[2]).bitwiseXOR(out[3]))


def lfsr88(z: tuple[Column, Column, Column]) -> tuple[Column, Column, Column, Column]:
    """Three combined shift registers: next states, output."""
    out = []
    for s, (a, b, keep, c) in zip(z, LFSR88, strict=True):
        t = _shr(_shl(s, a).bitwiseXOR(s), b)
        out.append(_shl(s.bitwiseAND(F.lit(keep)), c).bitwiseXOR(t))
    return (*out, out[0].bitwiseXOR(out[1]).bitwiseXOR(out[2]))


def kiss(m: tuple[Column, Column], c: Column, s: Column) -> tuple[Column, Column, Column, Column, Column]:
    """MWC (upper part turned), congruence and shifts together: next states, output."""
    u, v, x = mwc2(*m)
    c, s = cong(c), shr3(s)
    return u, v, c, s, _and(x.bitwiseXOR(c) + s)


def mwc64(upper: Column, lower: Column) -> tuple[Column, Column, Column]:
    """One 64-bit multiply-with-carry: next upper, next lower, output."""
    whole = MWC64 * lower + upper  # below 2**62
    low = _and(whole)
    return _shr(whole, 32), low, low


def kiss2(m: tuple[Column, Column], c: Column, s: Column) -> tuple[Column, Column, Column, Column, Column]:
    """MWC64, congruence and shifts added up: next states, output."""
    u, v, x = mwc64(*m)
    c, s = cong(c), shr3(s)
    return u, v, c, s, _and(x + c + s)


# ---------------------------------------------------------------------------------------------- seeds


def seed_cong(seed: Column) -> Column:
    """Any seed is a state."""
    return _and(seed)


def seed_shr3(seed: Column) -> Column:
    """0 is no state; all bits stand for it."""
    return F.when(_and(seed) == 0, F.lit(_M)).otherwise(_and(seed))


def seed_mwc(upper: Column, lower: Column) -> tuple[Column, Column]:
    """Both parts modulo their primes; the inverted seed stands for a multiple of one."""
    out = []
    for seed, p in zip((upper, lower), PRIMES, strict=True):
        s = _and(seed)
        out.append(F.when(s % p == 0, s.bitwiseXOR(F.lit(_M)) % p).otherwise(s % p))
    return tuple(out)


def _wide(upper: Column, lower: Column) -> Column:
    """upper * 2**32 + lower as a decimal of 20 digits."""
    return (upper.cast("decimal(10,0)") * F.lit(1 << 32).cast("decimal(10,0)") + lower.cast("decimal(10,0)")).cast("decimal(20,0)")


def _halves(whole: Column) -> tuple[Column, Column]:
    """Upper and lower 32 bits of a number below 2**63."""
    w = whole.cast("long")
    return _shr(w, 32), _and(w)


def seed_mwc64(upper: Column, lower: Column) -> tuple[Column, Column]:
    """Both halves together modulo the prime; the inverted seed stands for a multiple of it."""
    p = F.lit(PRIME64).cast("decimal(20,0)")
    plain, inverted = _wide(_and(upper), _and(lower)) % p, _wide(_M - _and(upper), _M - _and(lower)) % p
    return _halves(F.when(plain == 0, inverted).otherwise(plain))


def seed_kiss(upper: Column, lower: Column, c: Column, s: Column) -> tuple[Column, Column, Column, Column]:
    return (*seed_mwc(upper, lower), seed_cong(c), seed_shr3(s))


def seed_kiss2(upper: Column, lower: Column, c: Column, s: Column) -> tuple[Column, Column, Column, Column]:
    return (*seed_mwc64(upper, lower), seed_cong(c), seed_shr3(s))


def seed_lfsr(seeds: tuple[Column, ...], registers: tuple = LFSR113) -> tuple[Column, ...]:
    """Seeds folded over themselves; where the bits that a register keeps are all 0, the seed's lowest byte in front, or its inverse."""
    out = []
    for seed, (_, _, keep, _) in zip(seeds, registers, strict=True):
        least = _M + 1 - keep
        s = _and(seed)
        folded, front = s.bitwiseXOR(_shl(s, 16)), _shl(s, 24)
        out.append(F.when(folded >= least, folded).when(front >= least, front).otherwise(_M - front))
    return tuple(out)


# ---------------------------------------------------------------------------------------------- skips


def _table(rows: list, kind: str) -> Column:
    """A constant array, from one literal."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


def _by_bits(n: Column, state: Column, steps: Column, apply: Callable[[Column, Column], Column]) -> Column:
    """state after the steps that the bits of n name: steps[k] takes 2**k single steps."""
    n = F.greatest(F.coalesce(n.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    bits = F.when(n > 0, F.length(F.bin(n))).otherwise(0)
    named = F.filter(F.slice(steps, 1, bits), lambda x, k: F.call_function("shiftrightunsigned", n, k).bitwiseAND(F.lit(1)) == 1)
    return F.aggregate(named, state, lambda s, e: apply(s, e))


def _times(a: Column, b: Column) -> Column:
    """The lower 32 bits of a product of two numbers below 2**32."""
    return _and(a.bitwiseAND(F.lit(0xFFFF)) * b + _shl((_shr(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16))


def skip_cong(s: Column, n: Column) -> Column:
    """Squared affine maps modulo 2**32, whose cycle is 2**32 steps."""
    steps, (a, c) = [], CONG
    for _ in range(32):
        steps.append({"a": a, "c": c})
        a, c = a * a & _M, (a * c + c) & _M
    n = F.greatest(n.cast("long"), F.lit(0).cast("long")).bitwiseAND(F.lit(_M))
    return _by_bits(n, s, _table(steps, "struct<a: bigint, c: bigint>"), lambda x, e: _and(_times(e["a"], x) + e["c"]))


def skip_mwc(upper: Column, lower: Column, n: Column) -> tuple[Column, Column]:
    """Powers of the factor modulo the prime: a step multiplies by the factor, as that is the inverse of 2**16."""
    out = []
    for s, f, p in zip((upper, lower), MWC, PRIMES, strict=True):
        steps = _table([pow(f, 1 << k, p) for k in range(63)], "bigint")
        out.append(_by_bits(n, s, steps, lambda x, e, p=p: x * e % p))
    return tuple(out)


def skip_mwc64(upper: Column, lower: Column, n: Column) -> tuple[Column, Column]:
    """The same with 2**32 and decimals."""
    wide = lambda x: F.lit(x).cast("decimal(19,0)")
    steps = _table([pow(MWC64, 1 << k, PRIME64) for k in range(63)], "decimal(19,0)")
    whole = _wide(upper, lower).cast("decimal(19,0)")
    return _halves(_by_bits(n, whole, steps, lambda x, e: (x * e % wide(PRIME64)).cast("decimal(19,0)")))


@cache
def _jumps(step: Callable[[int], int]) -> list[list[int]]:
    """For 1, 2, 4, .. steps the images of the 32 single bits under a linear map of 32 bits."""
    out = [[step(1 << i) for i in range(32)]]
    for _ in range(62):
        last = out[-1]
        images = []
        for image in last:
            x = 0
            for i in range(32):
                if image >> i & 1:
                    x ^= last[i]
            images.append(x)
        out.append(images)
    return out


def _skip_linear(step: Callable[[int], int], s: Column, n: Column) -> Column:
    def moved(x: Column, images: Column) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate(images, zero, lambda a, e: F.when(x.bitwiseAND(e["bit"]) == 0, a).otherwise(a.bitwiseXOR(e["image"])))

    table = [[{"bit": 1 << i, "image": image} for i, image in enumerate(images)] for images in _jumps(step)]
    return _by_bits(n, s, _table(table, "array<struct<bit: bigint, image: bigint>>"), moved)


def _shr3_step(s: int) -> int:
    s ^= s << 13 & _M
    s ^= s >> 17
    return s ^ (s << 5 & _M)


@cache
def _register_step(a: int, b: int, keep: int, c: int) -> Callable[[int], int]:
    return lambda s: ((s & keep) << c & _M) ^ (((s << a & _M) ^ s) >> b)


def skip_shr3(s: Column, n: Column) -> Column:
    return _skip_linear(_shr3_step, s, n)


def skip_lfsr(z: tuple[Column, ...], n: Column, registers: tuple = LFSR113) -> tuple[Column, ...]:
    return tuple(_skip_linear(_register_step(*r), s, n) for s, r in zip(z, registers, strict=True))


def skip_kiss(m: tuple[Column, Column], c: Column, s: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    return (*skip_mwc(*m, n), skip_cong(c, n), skip_shr3(s, n))


def skip_kiss2(m: tuple[Column, Column], c: Column, s: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    return (*skip_mwc64(*m, n), skip_cong(c, n), skip_shr3(s, n))


def kiss_output(upper: Column, lower: Column, c: Column, s: Column) -> Column:
    return _and(mwc2_output(upper, lower).bitwiseXOR(c) + s)


def kiss2_output(upper: Column, lower: Column, c: Column, s: Column) -> Column:
    return _and(lower + c + s)
