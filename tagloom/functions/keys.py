"""Hash keys of token prefixes, and encryption of payloads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def _prefix_keys(tokens: list[int]) -> list[str]:
    h, out = FNV_OFFSET, []
    for t in tokens:
        for b in int(t).to_bytes(4, "little", signed=True):
            h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
        out.append(f"{h:016x}")
    return out


def prefix_keys(tokens: Column) -> Column:
    """Keys of all prefixes of an array of integers, the shortest first: one pass over the array."""
    return F.pandas_udf(lambda s: pd.Series([None if v is None else _prefix_keys(v) for v in s]), "array<string>")(tokens)


def longest_prefix(queries: DataFrame, stored: DataFrame, query_id: str, tokens: str, key: str, payload_bytes: str, capacity: int, owner: str | None = None) -> DataFrame:
    """(query, matched length, key) of the longest stored prefix that fits ``capacity`` bytes; none leaves no row.

    With ``owner``, the id of the query an entry comes from, a query's own entries don't count. Each key is joined
    once, however many entries share it.
    """
    p = queries.select(query_id, F.posexplode(prefix_keys(F.col(tokens))).alias("_i", key))
    fits = stored.where(F.col(payload_bytes) <= capacity)
    if owner is None:
        hit = p.join(fits.select(key).distinct(), key)
    else:
        owners = fits.groupBy(key).agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi"))
        hit = p.join(owners, key).where((F.col("_lo") != F.col(query_id)) | (F.col("_hi") != F.col(query_id)))
    return hit.groupBy(query_id).agg((F.max("_i") + 1).alias("matched"), F.max_by(key, "_i").alias(key))


def encrypt(payload: Column, secret: str) -> Column:
    return F.aes_encrypt(payload, F.unhex(F.sha2(F.lit(secret), 256)), F.lit("CBC"), F.lit("PKCS"))


def decrypt(payload: Column, secret: str) -> Column:
    return F.aes_decrypt(payload, F.unhex(F.sha2(F.lit(secret), 256)), F.lit("CBC"), F.lit("PKCS"))
