"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of hash values; a key (here: the text, so equal texts
stay together) belongs to the first point at or after its hash. A shard that would exceed its bound,
(1 + epsilon) times the mean, passes the key on clockwise to the next shard with room.

The ring is cut into ``cells``. Loads are totalled for each cell by one aggregation, and cells heavier
than 1/``heavy`` of all (so fewer than ``heavy`` of them) are cut again by a hash of the row, which
splits a text of which there are many copies. The walk around the ring then places these units: at
most cells + heavy x ``pieces`` of them at any size of the input, so they are placed on the driver,
the largest size classes first, then clockwise. Units go to shards by a join with that
bounded table, and slots are a unit's offset plus the row's number within the unit. No window or task
holds a shard.

Cases: a null text is an empty one of 0 bytes and belongs to the group of null texts; null ids sort first;
repeated rows take a slot each; an empty table gives an empty result; other columns are kept, the
operator's own go to one struct. With fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, VNODES, EPSILON = 40, 128, 0.0002
CELLS, HEAVY, PIECES = 1 << 15, 512, 128
#: What a row weighs besides its bytes.
ROW_BYTES = 16

Unit = tuple[int, int, int, int]


def ring(shards: int, vnodes: int = VNODES) -> tuple[list[int], list[int]]:
    """Sorted points of all virtual nodes (64 bits) and the shard of each."""
    points = sorted(
        (int.from_bytes(hashlib.md5(f"shard-{s}/{v}".encode()).digest()[:8], "big"), s)
        for s in range(shards)
        for v in range(vnodes)
    )
    return [p for p, _ in points], [s for _, s in points]


def place(units: list[Unit], shards: int, vnodes: int = VNODES, epsilon: float = EPSILON, cells: int = CELLS) -> list[int]:
    """The shard of each unit (cell, piece, bytes, rows), by the bounded walk around the ring."""
    points, owner = ring(shards, vnodes)
    bound = (1 + epsilon) * sum(u[2] for u in units) / shards
    load = [0] * shards
    out = [0] * len(units)
    order = sorted(range(len(units)), key=lambda i: (-units[i][2].bit_length(), units[i][0], units[i][1]))
    for i in order:
        cell, _, size, _ = units[i]
        start = bisect.bisect_left(points, cell * ((1 << 64) // cells))
        seen: set[int] = set()
        for step in range(len(points)):
            shard = owner[(start + step) % len(points)]
            if shard in seen:
                continue
            seen.add(shard)
            if load[shard] + size <= bound or len(seen) == shards:
                break
        if load[shard] + size > bound:
            # No shard has room for the whole unit: the emptiest takes it.
            shard = min(range(shards), key=lambda s: (load[s], s))
        load[shard] += size
        out[i] = shard
    return out


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    key: Column | None = None,
    size: Column | None = None,
    keep: tuple[str, ...] | None = None,
    vnodes: int = VNODES,
    epsilon: float = EPSILON,
    out: str = "placed",
) -> DataFrame:
    """(doc, placed): the columns of docs (those in ``keep``) as a struct, and size, shard and slot of each row.

    ``key`` keeps rows together (default: the text), ``size`` is what the bound holds for. What is kept is shuffled once, for the slots.
    """
    spark = docs.sparkSession
    bytes_ = F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0).cast("bigint"))
    size = bytes_ + ROW_BYTES if size is None else size.cast("bigint")
    key = F.col("text") if key is None else key
    digest = F.coalesce(F.md5(key.cast("binary")), F.lit("0" * 32))
    cell = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") * CELLS / (1 << 32)
    row = F.xxhash64(F.lit(7), "doc_id", F.lit("/"), key)
    own = [size.alias("size"), F.floor(cell).cast("int").alias("cell"), row.alias("row")]
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("doc"), F.col("doc_id").alias("id"), *own)

    # At most CELLS rows, of which fewer than HEAVY are heavy.
    total = rows.groupBy("cell").agg(F.sum("size").alias("bytes")).toPandas()
    heavy = total["cell"][total["bytes"] * HEAVY > total["bytes"].sum()]
    heavy = spark.createDataFrame([(int(c), True) for c in heavy], "cell int, heavy boolean")
    rows = rows.join(F.broadcast(heavy), "cell", "left")
    rows = rows.withColumn("piece", F.when(F.col("heavy"), F.pmod("row", F.lit(PIECES))).otherwise(0).cast("int")).drop("heavy")
    units = rows.groupBy("cell", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    found: list[Unit] = sorted(tuple(map(int, u)) for u in units.toPandas().itertuples(index=False))
    placed = pd.DataFrame(found, columns=["cell", "piece", "bytes", "n"], dtype="int64")
    placed["shard"] = np.array(place(found, shards, vnodes, epsilon), np.int64)
    placed["offset"] = placed.groupby("shard")["n"].cumsum() - placed["n"]
    schema = "cell int, piece int, shard int, offset long"
    plan = spark.createDataFrame(placed[["cell", "piece", "shard", "offset"]].values.tolist(), schema)
    # At most CELLS + HEAVY * PIECES rows of four numbers.
    rows = rows.join(F.broadcast(plan), ["cell", "piece"])
    inside = Window.partitionBy("cell", "piece").orderBy("id", "row", "size")
    slot = (F.col("offset") + F.row_number().over(inside) - 1).alias("slot")
    return rows.select("doc", F.struct("size", "shard", slot).alias(out))
