"""FNV-1a, xorshift and the vectors made from them, as column expressions on signed 64-bit numbers."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import let

#: FNV's offset and prime (as signed 64-bit numbers), and the state that stands for zero.
OFFSET, PRIME, NONZERO = 0xCBF29CE484222325 - (1 << 64), 0x100000001B3, 0x9E3779B97F4A7C15 - (1 << 64)
MASK32 = 0xFFFFFFFF


def times_prime(x: Column) -> Column:
    """x times PRIME modulo 2**64 by halves, since a plain product would overflow."""
    low, high = x.bitwiseAND(F.lit(MASK32)), F.shiftrightunsigned(x, 32)
    part = low * F.lit(PRIME & MASK32)  # below 2**41, as PRIME's low half is 435
    carried = F.shiftrightunsigned(part, 32) + high * F.lit(PRIME & MASK32) + low * F.lit(PRIME >> 32)
    return F.shiftleft(carried, 32).bitwiseOR(part.bitwiseAND(F.lit(MASK32)))


def fnv1a_64(text: Column) -> Column:
    """The hash of a text's UTF-8 bytes as a signed number."""
    code = F.hex(F.encode(text, "UTF-8"))
    bytes_ = let(code, lambda h: F.transform(F.when(F.length(h) > 0, F.sequence(F.lit(1), F.length(h) - 1, F.lit(2))).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substr(h, i, F.lit(2)), 16, 10).cast("long")))
    return F.aggregate(bytes_, F.lit(OFFSET), lambda s, b: times_prime(s.bitwiseXOR(b)))


def xorshift64(x: Column) -> Column:
    x = let(x, lambda s: s.bitwiseXOR(F.shiftleft(s, 13)))
    x = let(x, lambda s: s.bitwiseXOR(F.shiftrightunsigned(s, 7)))
    return let(x, lambda s: s.bitwiseXOR(F.shiftleft(s, 17)))


def unsigned_mod(x: Column, n: int) -> Column:
    """x as an unsigned number modulo n (n below 2**31)."""
    return ((F.shiftrightunsigned(x, 32) % n) * ((1 << 32) % n) + x.bitwiseAND(F.lit(MASK32)) % n) % n


def unit(state: Column) -> Column:
    """The low 16 bits as a number from -1 to 1."""
    return state.bitwiseAND(F.lit(0xFFFF)) / F.lit(32767.5) - 1.0


def noise(seed: Column, text: Column, count: int) -> Column:
    """``count`` numbers from -1 to 1 that a seed and a text determine."""
    start = let(seed.cast("long").bitwiseXOR(fnv1a_64(text)), lambda s: F.when(s == 0, F.lit(NONZERO)).otherwise(s))
    empty = F.array().cast("array<double>")
    step = lambda a, _: let(xorshift64(a["s"]), lambda s: F.struct(s.alias("s"), F.array_append(a["v"], unit(s)).alias("v")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(count)), F.struct(start.alias("s"), empty.alias("v")), step, lambda a: a["v"])


def row_seed(source_id: Column) -> Column:
    return fnv1a_64(source_id).bitwiseAND(F.lit(0x7FFFFFFF))


def feature_places(name: Column, weight: Column, rounds: Column, count: int) -> Column:
    """(index, value) for each round of a named feature: where it is added, and its weight with the sign."""
    empty = F.array().cast("array<struct<index:bigint,value:double>>")

    def step(a: Column, _: Column) -> Column:
        return let(xorshift64(a["s"]), lambda one: let(xorshift64(one), lambda two: F.struct(
            two.alias("s"),
            F.array_append(a["v"], F.struct(unsigned_mod(one, count).alias("index"), F.when(two.bitwiseAND(F.lit(1)) == 1, weight).otherwise(-weight).alias("value"))).alias("v"),
        )))

    return F.aggregate(F.sequence(F.lit(1), rounds), F.struct(fnv1a_64(name).alias("s"), empty.alias("v")), step, lambda a: a["v"])


def compositional(features: DataFrame, noises: DataFrame, key: str, count: int) -> DataFrame:
    """(key, index, value): the sums of all features' places and of noise, clipped to [-1, 1].

    ``features`` has name, weight, rounds; ``noises`` an array of ``count`` numbers, one row a key. Sums add in no fixed
    order, so values agree to rounding.
    """
    places = features.select(key, F.explode(feature_places(F.col("name"), F.col("weight"), F.col("rounds"), count)).alias("x")).select(key, "x.index", "x.value")
    ground = noises.select(key, F.posexplode("noise").alias("index", "value")).withColumn("index", F.col("index").cast("long"))
    summed = places.unionByName(ground).groupBy(key, "index").agg(F.sum("value").alias("value"))
    return summed.select(key, "index", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "value")).alias("value"))


def sinusoid(scale: Column, size: int) -> Column:
    """Sines, then cosines, of a scale at geometric frequencies."""
    half = size // 2
    angle = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: scale * F.exp(-F.log(F.lit(10000.0)) * i / F.lit(float(max(half - 1, 1)))))
    return let(angle, lambda a: F.concat(F.transform(a, lambda x: F.sin(x)), F.transform(a, lambda x: F.cos(x))))


def gaussian_vectors(df: DataFrame, key: str, seed: str, count: int) -> DataFrame:
    """(key, v): normal numbers by SplitMix64 and Box-Muller from seed xor the key's hash, clipped to [-6, 6]."""
    keyed = df.select(key, F.col(seed).cast("long").bitwiseXOR(fnv1a_64(F.col(key).cast("string"))).alias("_s"))

    def draw(batches):
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "v": _normal(batch["s"].to_numpy(), count)})

    kind = df.schema[key].dataType.simpleString()
    drawn = keyed.select(F.col(key).alias("k"), F.col("_s").alias("s")).mapInPandas(draw, f"k {kind}, v array<double>")
    return drawn.withColumnRenamed("k", key)


def _normal(states: np.ndarray, count: int) -> list[np.ndarray]:
    n = count + count % 2
    with np.errstate(over="ignore"):
        z = states.astype(np.int64).view(np.uint64)[:, None] + (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    u = ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    radius, angle = np.sqrt(-2 * np.log(u[:, 0::2])), 2 * np.pi * u[:, 1::2]
    both = np.empty((len(u), n))
    both[:, 0::2], both[:, 1::2] = radius * np.cos(angle), radius * np.sin(angle)
    return list(np.clip(both[:, :count], -6, 6))
