"""Portable keys and numeric helpers shared by Spark code and oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplicative hash constant and modulus of the portable
# split/sample key  (key * 2654435761 + seed) mod 2^32  (Knuth's constant).
HASH_MULT = 2654435761
HASH_MOD = 4294967296


def _seed_mask(seed: int) -> int:
    """0 for the default seed 42 (the portable formula as written); other
    seeds XOR the key with a seed-derived mask first, so a different seed
    gives a different permutation rather than a rotation of the same one."""
    return ((seed - 42) * 2654435761) % HASH_MOD


def hash_key(key: str | Column, seed: int = 42) -> Column:
    """``(key * 2654435761 + seed) mod 2^32`` without 64-bit overflow.

    The key is split in 16-bit halves so every product stays below 2^49; the
    result equals the plain formula for non-negative keys, which is what the
    oracle SQL writes.  Distinct keys below 2^32 give distinct values (the
    multiplier is odd), so ordering by it is a seeded permutation.
    """
    k = F.col(key) if isinstance(key, str) else key
    if _seed_mask(seed):
        k = k.bitwiseXOR(F.lit(_seed_mask(seed)))
    k = F.pmod(k, F.lit(HASH_MOD))
    hi = F.floor(k / 65536).cast("bigint")
    lo = F.pmod(k, F.lit(65536))
    mixed = F.pmod(hi * HASH_MULT, F.lit(65536)) * 65536 + lo * HASH_MULT + seed
    return F.pmod(mixed, F.lit(HASH_MOD)).cast("bigint")


def hash_key_sql(key: str, seed: int = 42) -> str:
    k = f"xor({key}, {_seed_mask(seed)})" if _seed_mask(seed) else key
    return f"(({k}) * {HASH_MULT} + {seed}) % {HASH_MOD}"


def count_below(x: Column, values, inclusive: bool = False) -> Column:
    """Number of the sorted literal ``values`` that are < x (or <= x with
    ``inclusive``), as a balanced CASE tree: log2(n) comparisons per row,
    compiled into the stage (no higher-order function); null x gives 0."""
    vals = sorted(float(v) for v in values)

    def build(lo: int, hi: int) -> Column:        # count within vals[lo:hi], all below lo known
        if lo >= hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        hit = (x >= F.lit(vals[mid])) if inclusive else (x > F.lit(vals[mid]))
        return F.when(hit, build(mid + 1, hi)).otherwise(build(lo, mid))

    return F.coalesce(build(0, len(vals)), F.lit(0))
