"""Sign votes of 64-bit hashes, counted for all bits at once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64
_HALF = 32
#: Bits 0 and 32: a sum holds the votes of two bits, 32 places apart. It is exact while the
#: weights of a document add up to less than 2**32.
_LANES = (1 << _HALF) | 1
_LOW = (1 << _HALF) - 1


def vote_sums(hashes: str, weight: str) -> list[Column]:
    """Aggregates: weight of the hashes with bit k set, and with bit k + 32, for each k."""
    h, w = F.col(hashes), F.col(weight)
    return [
        F.sum(w * F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES))).alias(f"_v{k}")
        for k in range(_HALF)
    ]


def fingerprint(total: str) -> Column:
    """Bit set where its votes are over half of ``total``; from the sums of ``vote_sums``."""
    out = F.lit(0).cast("long")
    for k in range(_HALF):
        v = F.col(f"_v{k}")
        for votes, bit in (
            (v.bitwiseAND(F.lit(_LOW)), k), (F.shiftrightunsigned(v, _HALF), k + _HALF)
        ):
            value = (1 << bit) - (1 << BITS if bit == BITS - 1 else 0)  # two's complement
            on = F.when(votes * 2 > F.col(total), F.lit(value).cast("long"))
            out = out.bitwiseOR(F.coalesce(on, F.lit(0).cast("long")))
    return out


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
