"""Reed-Solomon parity over GF(2^8): a Cauchy matrix over the field of 0x11D."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLY = 0x11D


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log = np.zeros(512, dtype=np.uint8), np.zeros(256, dtype=np.int64)
    x = 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x <<= 1
        if x & 0x100:
            x ^= POLY
    return exp, log


EXP, LOG = _tables()


def mul(a, b) -> np.ndarray:
    a, b = np.asarray(a, dtype=np.uint8), np.asarray(b, dtype=np.uint8)
    return np.where((a == 0) | (b == 0), 0, EXP[LOG[a] + LOG[b]]).astype(np.uint8)


def inverse(a: int) -> int:
    return int(EXP[255 - LOG[a]])


def cauchy(parity: int, data: int) -> np.ndarray:
    return np.array([[inverse((data + i) ^ j) for j in range(data)] for i in range(parity)], dtype=np.uint8)


def product(m: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((m.shape[0], rows.shape[1]), dtype=np.uint8)
    for i in range(m.shape[0]):
        for j in range(m.shape[1]):
            out[i] ^= mul(m[i, j], rows[j])
    return out


def encode(rows: np.ndarray, parity: int) -> np.ndarray:
    return product(cauchy(parity, rows.shape[0]), rows)


def recover(shards: dict[int, np.ndarray], data: int, parity: int) -> np.ndarray:
    """The data rows from any ``data`` of the shards (data rows first, then parity rows)."""
    full = np.concatenate([np.eye(data, dtype=np.uint8), cauchy(parity, data)])
    use = sorted(shards)[:data]
    if len(use) < data:
        raise ValueError("too few shards")
    a = np.concatenate([full[use], np.stack([shards[i] for i in use])], axis=1)
    for c in range(data):
        p = next(r for r in range(c, data) if a[r, c])
        a[[c, p]] = a[[p, c]]
        a[c] = mul(a[c], inverse(int(a[c, c])))
        for r in range(data):
            if r != c and a[r, c]:
                a[r] ^= mul(a[r, c], a[c])
    return a[:, data:]


def update(parity: np.ndarray, row: int, old: np.ndarray, new: np.ndarray, data: int) -> np.ndarray:
    """Parity rows after one data row changes, from the change alone."""
    m = cauchy(parity.shape[0], data)
    change = np.asarray(old, dtype=np.uint8) ^ np.asarray(new, dtype=np.uint8)
    return np.stack([p ^ mul(m[i, row], change) for i, p in enumerate(parity)])


def stripes(blobs: DataFrame, key: str, payload: str, data: int, parity: int) -> DataFrame:
    """(key, size, shard, payload): each blob cut into ``data`` shards of one length, the last filled with zeros, and ``parity`` more."""

    def run(batches):
        for b in batches:
            out = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = raw or b""
                width = max(1, -(-len(raw) // data))
                rows = np.frombuffer(raw.ljust(width * data, b"\0"), dtype=np.uint8).reshape(data, width)
                out += [(k, len(raw), i, r.tobytes()) for i, r in enumerate([*rows, *encode(rows, parity)])]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=[key, "size", "shard", "payload"])

    return blobs.select(key, F.col(payload).cast("binary")).mapInArrow(run, f"{key} {blobs.schema[key].dataType.simpleString()}, size bigint, shard int, payload binary")


def restored(shards: DataFrame, key: str, data: int, parity: int) -> DataFrame:
    """(key, payload) of the blobs from any ``data`` of their shards; null where fewer are left. A blob's shards meet in one task."""
    each = shards.groupBy(key).agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("shard", "payload"))).alias("s"))

    def run(batches):
        for b in batches:
            out = []
            for n, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                have = {x["shard"]: np.frombuffer(x["payload"], dtype=np.uint8) for x in s}
                out.append(recover(have, data, parity).tobytes()[:n] if len(have) >= data else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[key, "payload"])

    return each.mapInArrow(run, f"{key} {shards.schema[key].dataType.simpleString()}, payload binary")
