"""The 64-bit hash behind placement, as Column expressions that stay inside code generation.

Spark has signed longs and, in ANSI mode, raises where a product overflows. Products modulo 2^64 are
therefore put together from 16- and 32-bit parts, none of which can overflow. A weight is the bit pattern of an
unsigned number; `unsigned_order` gives a key that sorts like the number itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The two multipliers and three shifts of the SplitMix64 finaliser.
FIRST_MULTIPLIER, SECOND_MULTIPLIER = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SHIFTS = (30, 27, 31)

#: The seeds (unsigned 64-bit) of the eight nodes that the published placement figures are about.
MEMBER_SEEDS = {
    "node-a": 13242073590991301293,
    "node-b": 11430470374524025358,
    "node-c": 3600174517856159665,
    "node-d": 5067836924840919956,
    "node-e": 9922950709191116619,
    "node-f": 3368794367798241772,
    "node-g": 6131036784192547841,
    "node-h": 2531602512536472929,
}

LOW32, LOW16 = 0xFFFFFFFF, 0xFFFF
KEY = "^[0-9a-f]{64}$"


def signed(n: int) -> int:
    """An unsigned 64-bit number as the long of the same bits."""
    return n - (1 << 64) if n >= 1 << 63 else n


def sha256_hex(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def first_eight_bytes(hex_digest: Column) -> Column:
    """The first 16 hexadecimal digits as the long of the same bits."""
    return F.conv(F.substring(hex_digest, 1, 16), 16, -10).cast("long")


def member_seed(name: Column, domain: str) -> Column:
    """A node's seed from its name; domain is the cluster's prefix, which keeps other uses of the digest apart."""
    return first_eight_bytes(sha256_hex(F.concat(F.lit(domain), name)))


def key_seed(key: Column) -> Column:
    """The key's own first 16 digits if they are lower-case hexadecimal, else those of its digest."""
    return F.when(key.rlike("^[0-9a-f]{16}"), first_eight_bytes(key)).otherwise(first_eight_bytes(sha256_hex(key)))


def valid_key(key: Column) -> Column:
    """64 bytes, all lower-case hexadecimal. The length is tested too, as $ also matches before a final line feed."""
    return F.coalesce((F.octet_length(key) == 64) & key.rlike(KEY), F.lit(False))


def _times(x: Column, c: int) -> Column:
    """x * c modulo 2^64. With x = x3 x2 x1 x0 in 16-bit parts and c = c1 c0 in 32-bit parts."""
    c0, c1 = F.lit(c & LOW32), F.lit(c >> 32)
    part = lambda n: F.shiftrightunsigned(x, 16 * n).bitwiseAND(F.lit(LOW16))
    a, b = part(0) * c0, part(1) * c0  # up to 48 bits each
    low = a.bitwiseAND(F.lit(LOW32)) + F.shiftleft(b.bitwiseAND(F.lit(LOW16)), 16)
    high = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 16)
    high += part(2) * c0 + F.shiftleft((part(3) * c0).bitwiseAND(F.lit(LOW16)), 16)
    high += part(0) * c1 + F.shiftleft((part(1) * c1).bitwiseAND(F.lit(LOW16)), 16)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(LOW32)))


def _fold(x: Column, n: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, n))


#: The finaliser step by step.
STEPS = (lambda x: _fold(x, SHIFTS[0]), lambda x: _times(x, FIRST_MULTIPLIER), lambda x: _fold(x, SHIFTS[1]), lambda x: _times(x, SECOND_MULTIPLIER), lambda x: _fold(x, SHIFTS[2]))


def with_weight(df: DataFrame, key: str, member: str, name: str = "weight") -> DataFrame:
    """df with the weight of two seeds. One step a projection, so that no step's expression is written out several times in the next."""
    df = df.withColumn(name, F.col(key).bitwiseXOR(F.col(member)))
    for step in STEPS:
        df = df.withColumn(name, step(F.col(name)))
    return df


def unsigned_order(x: Column) -> Column:
    """Longs in the order of the unsigned numbers of the same bits."""
    return x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def flipped_seed_bits(keys: DataFrame, key: str = "key") -> DataFrame:
    """keys with `flipped`: bits of the mixed seed that change with the seed's lowest bit."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = keys.withColumns({"_k": key_seed(F.col(key)), "_0": zero, "_1": one})
    rows = with_weight(with_weight(rows, "_k", "_0", "_a"), "_k", "_1", "_b")
    return rows.withColumn("flipped", F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))).cast("long")).drop("_k", "_0", "_1", "_a", "_b")
