"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made distinct first, so a text with thousands of copies counts once. They are ordered by the
population counts of their four 16-bit quarters and cut into tiles. Two fingerprints differ in at least the sum of the
differences of their quarters' counts; so a pair of tiles whose counts are further apart than the radius is skipped,
and so is a pair of blocks inside a pair of tiles. What is left is compared whole, with exclusive-or and bit counts.
From each pair of tiles only a forest that connects what is linked is kept, never all links of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.llm.arrow import with_columns
from leadspark.llm.components import components
from leadspark.session import stage

TILE = 8192  # fingerprints in a tile at most
BLOCK = 256  # fingerprints of a tile compared at once with a block of the other
QUARTERS = (48, 32, 16, 0)


def fingerprint_of(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: bits set in over half of its shingles' XXH64; zero without words."""
    parts = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(rows), 4096):
        counts += np.unpackbits(rows[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, seed: int = 42, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of its whole text as a signed long; a null text has no words and gets zero."""

    def make():
        def function(batch: pa.RecordBatch) -> list:
            values = [fingerprint_of(t.as_py(), words, seed) for t in batch.column(batch.schema.get_field_index(text))]
            return [pa.array(np.array(values, dtype=np.uint64).view(np.int64))]

        return function

    return with_columns(docs.withColumn(text, F.col(text).cast("string")), [T.StructField(name, T.LongType())], make)


def _quarter_counts(fps: np.ndarray) -> np.ndarray:
    fps = fps.view(np.uint64)
    return np.stack([np.bitwise_count((fps >> np.uint64(s)) & np.uint64(0xFFFF)) for s in QUARTERS], axis=1).astype(np.int16)


def _apart(low_a, high_a, low_b, high_b) -> np.ndarray:
    """The least distance between members of boxes of quarter counts."""
    return np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0).sum(axis=-1)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _link(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the sets of i and j, element by element; roots are the least members."""
    parent = _roots(parent)
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        parent = _roots(parent)


def link_tiles(x: np.ndarray, y: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that connects exactly the fingerprints of x (and y) linked within or between them.

    ``y`` None compares the tile x with itself. Arrays are signed longs without repeats.
    """

    def ordered(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = _quarter_counts(fps)
        order = np.lexsort(counts.T[::-1])
        return fps[order], counts[order]

    def boxes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.arange(0, len(counts), BLOCK)
        return np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)

    x, cx = ordered(x)
    both = x if y is None else None
    if y is None:
        y, cy, base = x, cx, 0
    else:
        y, cy = ordered(y)
        both, base = np.concatenate([x, y]), len(x)
    parent = np.arange(len(both))
    low_y, high_y = boxes(cy)
    low_x, high_x = boxes(cx)
    ux, uy = x.view(np.uint64), y.view(np.uint64)
    for k in range(len(low_x)):
        near = np.flatnonzero(_apart(low_x[k], high_x[k], low_y, high_y) <= radius)
        if both is x:
            near = near[near >= k]
        left = ux[k * BLOCK : (k + 1) * BLOCK, None]
        for at in range(0, len(near), 16):
            columns = np.concatenate([np.arange(b * BLOCK, min((b + 1) * BLOCK, len(uy))) for b in near[at : at + 16]])
            i, j = np.nonzero(np.bitwise_count(left ^ uy[columns][None, :]) <= radius)
            i, j = i + k * BLOCK, columns[j] + base
            keep = i < j
            if keep.any():
                parent = _link(parent, i[keep], j[keep])
    parent = _roots(parent)
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return both[moved], both[parent[moved]]


def links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints linked by ``radius`` or fewer differing bits.

    ``distinct`` is a written table of one long column ``fp`` without repeats. What the driver sees is the number of
    fingerprints per combination of quarter counts, at most 17**4 of them, and the list of tiles.
    """
    spark = distinct.sparkSession
    unsigned = [F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(0xFFFF))).cast("int") for s in QUARTERS]
    cell = sum((c * 17 ** (3 - k) for k, c in enumerate(unsigned)), F.lit(0))
    cells = distinct.groupBy(cell.alias("cell")).count().orderBy("cell").toPandas()
    # consecutive cells share a tile while they fit; a cell beyond that is dealt by hash over tiles of its own
    tiles, cell_rows, filled = [], [], 0
    for c, n in zip(cells["cell"].tolist(), cells["count"].tolist()):
        parts = -(-n // tile) if n <= tile else -(-2 * n // tile)
        if parts > 1 or not tiles or filled + n > tile:
            first, filled = len(tiles), n if parts == 1 else tile
            tiles += [[c] for _ in range(parts)]
        else:
            first, filled = len(tiles) - 1, filled + n
            tiles[-1].append(c)
        cell_rows.append((c, first, parts))
    if not tiles:
        return spark.createDataFrame([], "a long, b long")
    digits = [np.array([[c // 4913, c // 289 % 17, c // 17 % 17, c % 17] for c in t]) for t in tiles]
    low, high = np.array([d.min(axis=0) for d in digits]), np.array([d.max(axis=0) for d in digits])

    placed = spark.createDataFrame(cell_rows, "cell int, first int, parts int")
    of_tile = distinct.withColumn("cell", cell.cast("int")).join(placed, "cell")
    of_tile = of_tile.withColumn("tile", F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    packed = stage(of_tile.groupBy("tile").agg(F.collect_list("fp").alias("fps")), "tiles")  # about ``tile`` at most in each

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                other = np.arange(t, len(low))
                other = other[_apart(low[t], high[t], low[t:], high[t:]) <= radius]
                swap = (other + t) % 2 == 1  # so that each tile is about as often first as second
                first, second = np.where(swap, other, t), np.where(swap, t, other)
                yield pa.RecordBatch.from_arrays([pa.array(first, type=pa.int32()), pa.array(second, type=pa.int32())], names=["tile", "other"])

    # explicit numbers of partitions: adaptive execution would merge by bytes, but the work is in the comparisons
    parts = max(len(tiles), 3 * spark.sparkContext.defaultParallelism)
    together = packed.select("tile").mapInArrow(pairs, "tile int, other int").repartition(parts, "tile", "other")
    other = packed.select(F.col("tile").alias("other"), F.col("fps").alias("other_fps")).repartition(parts, "other")
    together = together.join(packed, "tile").repartition(parts, "other").join(other, "other").select("tile", "other", "fps", "other_fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.asarray(batch.column(2)[k].values, dtype=np.int64)
                y = None if batch.column(0)[k].as_py() == batch.column(1)[k].as_py() else np.asarray(batch.column(3)[k].values, dtype=np.int64)
                a, b = link_tiles(x, y, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return together.mapInArrow(compare, "a long, b long")


def classes(prints: DataFrame, radius: int, key: str, tile: int = TILE) -> DataFrame:
    """(fp, component, size): one row per fingerprint, with the least key reachable from it and its number of rows.

    ``prints`` is a written table with ``fp`` and ``key``. A null key is never the least unless all are null.
    """
    per_print = stage(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("size")), "fingerprints")
    linked = components(links(per_print.select("fp"), radius, tile))
    rooted = per_print.join(linked.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    rooted = stage(rooted.select("fp", "root", "least", "size"), "rooted")
    roots = stage(rooted.groupBy("root").agg(F.min("least").alias("component")), "roots")
    return stage(rooted.join(roots, "root").select("fp", "component", "size"), "classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, seed: int = 42, tile: int = TILE) -> DataFrame:
    """(key, fingerprint, component_id) for every row: 16 hex digits, and the least key that links lead to.

    Links join fingerprints with at most ``radius`` differing bits. Empty and null texts have the fingerprint zero,
    which links like any other. Repeated rows stay, an empty table stays empty, further columns are left out.
    """
    prints = stage(fingerprints(docs.select(key, text), text, words, seed, "fp").select(key, "fp"), "simhash")
    found = classes(prints, radius, key, tile)
    return prints.join(found, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, seed: int = 42, tile: int = TILE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of the least key stays, whole.

    Rows are told apart by a number given when they are written, so of repeated rows exactly one stays.
    """
    names = docs.columns
    numbered = stage(fingerprints(docs, text, words, seed, "_fp").withColumn("_row", F.monotonically_increasing_id()), "documents")
    slim = numbered.select(F.col("_fp").alias("fp"), F.struct(F.col(key).isNull().alias("no"), F.col(key).alias("key"), F.col("_row").alias("row")).alias("at"))
    kept = classes(slim, radius, "at", tile).select(F.col("component.row").alias("_row")).distinct()
    return numbered.join(kept, "_row", "left_semi").select(*names)
