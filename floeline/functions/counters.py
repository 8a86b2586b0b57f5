"""Random numbers without state: each follows from a counter, a stream and a seed, in whole-number arithmetic.

Only products below 2^62, remainders, shifts and exclusive or are used, so that any engine with 64-bit integers
makes the same numbers, any part of a random table can be made again, and nothing depends on partitions.
"""

from pyspark.sql import Column, DataFrame, functions as F

# fixed values of the mixing: a prime modulus and multipliers below it
PRIME = 2**31 - 1
FIRST, SECOND, THIRD, CARRY = 48271, 69621, 39373, 1_000_003
HALF = 2**31
ROUNDS = 4


def _start(stream: int, seed: int) -> int:
    return (stream * 7_919_999 + seed * 104_729 + 12_345) % PRIME


def mixed(counter: Column, stream: int, seed: int) -> Column:
    """A number in [0, PRIME) for a counter of 0 or more."""
    counter = counter.cast("bigint")
    rounds = F.call_function("div", counter, F.lit(PRIME).cast("bigint"))
    h = (counter % PRIME * FIRST + rounds % PRIME * CARRY + _start(stream, seed)) % PRIME
    h = (h.bitwiseXOR(F.shiftright(h, 16)) * SECOND) % PRIME
    h = (h.bitwiseXOR(F.shiftright(h, 15)) * THIRD) % PRIME
    return h.bitwiseXOR(F.shiftright(h, 13)) % PRIME


def share(counter: Column, stream: int, seed: int) -> Column:
    """A number in [0, 1)."""
    return mixed(counter, stream, seed) / F.lit(float(PRIME))


def below(counter: Column, stream: int, seed: int, limit: int) -> Column:
    """A whole number in [0, limit), for a limit up to 2^31."""
    return F.shiftright(mixed(counter, stream, seed) * limit, 31)


def permuted(df: DataFrame, index: Column, seed: int, name: str) -> DataFrame:
    """Add `name`: the place of `index` (0 to 2^62 - 1) in a seeded permutation of all such numbers.

    A Feistel network: of two halves one is changed by a number that follows from the other, in turn,
    which can be undone, so that different indexes have different places.
    """
    df = df.withColumns({"_left": F.shiftright(index, 31), "_right": index.bitwiseAND(F.lit(HALF - 1))})
    for r in range(ROUNDS):
        changed = F.col("_left").bitwiseXOR(mixed(F.col("_right"), 1000 + r, seed))
        df = df.withColumn("_next", changed).withColumn("_left", F.col("_right")).withColumn("_right", F.col("_next")).drop("_next")
    return df.withColumn(name, F.col("_left") * HALF + F.col("_right")).drop("_left", "_right")
