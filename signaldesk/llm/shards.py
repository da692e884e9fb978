"""Histogram sort into shards of near-equal bytes, built-in functions only.

Rows get a 63-bit key: the CRC-32 of the text, then a hash of ``doc_id``.  Each round counts the exact bytes and rows in
the cells between candidate boundaries; the cell that holds a splitter's target is divided again until a boundary lies
within the tolerance.  Cells of the first rounds are coarser than one text, so equal texts share a shard unless their
group is itself too large for the tolerance.  Rows then cross the network once, by (shard, piece), for their slots.

Defined results: a null text has no bytes, size 1 and CRC 0; repeated rows of one id and text share a shard; an empty
table gives an empty table; columns other than ``doc_id`` and ``text`` play no part.  Only per-cell sums (at most
``MAX_CELLS`` rows, whatever the input) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from signaldesk.llm.common import staged, table

KEY_BITS = 63
MIN_CELLS, MAX_CELLS = 1 << 10, 1 << 16
CELL_ROWS = 50_000       # rows a first-round cell should hold, between those bounds
PROBES = 1 << 10         # cells a probed interval is divided into in each later round
TOLERANCE = 0.002        # of a shard's share of bytes


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and key of every document."""
    df = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                     F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    low = F.xxhash64("doc_id").bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    return df.withColumn("key", F.shiftleft("text_crc32", 31).bitwiseOR(low))


def _sums(df: DataFrame, cell: Column) -> list[tuple[int, int, int]]:
    rows = df.groupBy(cell.alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    return sorted((int(r["cell"]), int(r["bytes"]), int(r["n"])) for r in rows)


def splitters(keys: DataFrame, n_shards: int, cells: int, tolerance: float = TOLERANCE) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Key boundaries between shards, and the first round's (cell, bytes, rows)."""
    shift = KEY_BITS - (cells.bit_length() - 1)
    first = _sums(keys, F.shiftright("key", shift))
    total = sum(b for _, b, _ in first)
    slack = tolerance * total / n_shards
    found: dict[int, int] = {}
    # An open probe is (low key, cell width in bits, bytes below it, sums of its cells).
    probes = {j: (0, shift, 0, first) for j in range(1, n_shards)}
    while probes:
        again: dict[int, tuple[int, int, int]] = {}
        for j, (low, bits, below, sums) in probes.items():
            target, at = total * j / n_shards, low
            for cell, size, _ in sums:
                left, right = low + (cell << bits), low + ((cell + 1) << bits)
                if below + size < target:
                    below, at = below + size, right
                    continue
                if min(target - below, below + size - target) <= slack or bits == 0:
                    found[j] = left if target - below <= below + size - target else right
                else:
                    again[j] = (left, bits, below)
                break
            else:
                found[j] = at
        probes = {}
        spans = sorted({(left, bits) for left, bits, _ in again.values()})
        if spans:
            step = PROBES.bit_length() - 1
            place, inside = F.lit(None).cast("long"), F.lit(False)
            for i, (left, bits) in enumerate(spans):
                fine = max(0, bits - step)
                here = F.col("key").between(left, left + (1 << bits) - 1)
                place = F.when(here, F.shiftright(F.col("key") - F.lit(left), fine) + F.lit(i << step)).otherwise(place)
                inside = inside | here
            sums = _sums(keys.where(inside), place)
            for j, (left, bits, below) in again.items():
                i = spans.index((left, bits))
                own = [(c - (i << step), b, n) for c, b, n in sums if c >> step == i]
                probes[j] = (left, max(0, bits - step), below, own)
    return [found[j] for j in range(1, n_shards)], first


def assign_shards(docs: DataFrame, n_shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, key, shard and slot (gapless from 0 in each shard) of every document."""
    spark = docs.sparkSession
    keys = staged(keyed(docs), "shard-keys")
    cells, n = MIN_CELLS, keys.count()
    while cells < MAX_CELLS and cells * CELL_ROWS < n:
        cells *= 2
    bounds, first = splitters(keys, n_shards, cells, tolerance)
    shard = F.lit(0)
    for s in bounds:
        shard = shard + (F.col("key") >= F.lit(s)).cast("int")
    # A cell with far more rows than most (one text with many copies) is dealt out over pieces.
    most = 2 * max(1, -(-n // cells))
    heavy = [(c, -(-k // most)) for c, _, k in first if k > most]
    shift = KEY_BITS - (cells.bit_length() - 1)
    rows = keys.withColumn("shard", shard).withColumn("cell", F.shiftright("key", shift))
    parts = spark.createDataFrame(heavy, "cell long, pieces long")
    rows = rows.join(F.broadcast(parts), "cell", "left").withColumn(  # at most MAX_CELLS rows
        "piece", F.coalesce(F.pmod(F.col("key").bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), F.col("pieces")), F.lit(0))).drop("pieces")
    sums = rows.groupBy("shard", "cell", "piece").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("cell", "piece").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("shard", "cell", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("shard", "cell", "piece").orderBy("key", "doc_id", "size"))
    return (rows.join(sums, ["shard", "cell", "piece"])
            .select("doc_id", "size", "text_crc32", "key", "shard", (F.col("before") + rank - 1).alias("slot")))


def shard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
