"""Fuzzy removal of repeated lines.

Lines are normalised (lower case, white space folded) and made distinct by a 128-bit digest, so a line that fills a
third of the corpus counts once. Each distinct line has a SimHash of its different words, each counted once: else a
sign that makes up half of a table's cells would alone decide. Two SimHashes that differ in at most
``radius`` bits agree on one of ``radius + 1`` blocks of bits, so lines meet in buckets of equal blocks. Buckets larger
than a tile are cut into parts that meet pairwise; from each only a forest of links is kept. The connected groups of
SimHashes are the candidates: only their lines are fetched as text, and within a group those within the radius are
verified by edit similarity, again in parts and skipping pairs that are connected already. Of each connected group of
verified lines the first occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.llm.arrow import small
from leadspark.llm.components import components
from leadspark.llm.simhash import link_tiles
from leadspark.session import stage

TILE = 4096  # SimHashes of a bucket compared at once
PART_LINES, PART_CHARS = 2048, 2_000_000  # lines of a group, and their characters, verified at once
CHUNK_WORDS = 100_000  # words whose bits are counted at once
CACHE_WORDS = 250_000  # hashes of words that a task remembers


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = got
        return got


# for each byte eight lanes of a byte, one per bit, most significant bit first in memory
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def line_hashes(words: list[str], counts: list[int], cache: dict[str, int]) -> np.ndarray:
    """SimHashes (signed) of consecutive lines of ``counts`` words each, at least one; a bit is set in over half."""
    n = np.asarray(counts, dtype=np.int64)
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)).astype(">u8")
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    # a lane holds up to 255, so longer lines are summed in segments first
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    pieces = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64)
    totals = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    return np.packbits(totals * 2 > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def normal(line: str) -> list[str]:
    """The words of the normalised line; none for a blank one."""
    return line.lower().split()


def _packed(docs: DataFrame, names: list[str], key: str, text: str) -> DataFrame:
    """``names`` of ``docs`` but the text, with it compressed as _packed, and a struct for each line that is not blank.

    The text is read by Python once; later steps exchange it compressed. _row numbers the rows of the written table.
    """
    others = [n for n in names if n != text]
    rows = docs.select(*others, F.xxhash64(key, F.col(text).cast("string")).alias("_hash"), F.monotonically_increasing_id().alias("_row"), F.col(text).cast("string").alias("_text"))
    added = T.StructType.fromDDL("_packed binary, _lines array<struct<line: int, digest: binary, fp: long>>")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_text"] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, out, pack = _Hashes(), [f.name for f in schema.fields], zstandard.ZstdCompressor(level=1).compress
        for batch in small(batches):
            packed, ends, lines, digests, words, counts, fps = [], [0], [], [], [], [], []
            for value in batch.column(batch.num_columns - 1):
                value = value.as_py()
                packed.append(None if value is None else pack(value.encode()))
                for k, line in enumerate((value or "").split("\n")):
                    if own := normal(line):
                        lines.append(k)
                        digests.append(xxhash.xxh3_128_digest(" ".join(own)))
                        once = dict.fromkeys(own)
                        words += once
                        counts.append(len(once))
                ends.append(len(lines))
                if len(words) >= CHUNK_WORDS:
                    fps.append(line_hashes(words, counts, cache))
                    words, counts = [], []
            if counts:
                fps.append(line_hashes(words, counts, cache))
            fps = np.concatenate(fps) if fps else np.empty(0, np.int64)
            found = pa.StructArray.from_arrays([pa.array(lines, pa.int32()), pa.array(digests, pa.binary()), pa.array(fps)], names=["line", "digest", "fp"])
            nested = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary()), nested], names=out)

    return rows.mapInArrow(run, schema)


def _bucket_links(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """(a, b): a forest of the links between the values ``fp`` of a written table without repeats."""
    blocks = radius + 1
    width = [64 * (k + 1) // blocks - 64 * k // blocks for k in range(blocks)]
    at = [64 - 64 * (k + 1) // blocks for k in range(blocks)]
    block = lambda k: F.shiftrightunsigned("fp", at[k]).bitwiseAND(F.lit((1 << width[k]) - 1)) * blocks + k
    dealt = prints.select("fp", F.explode(F.array(*[block(k) for k in range(blocks)])).alias("bucket"))
    # buckets beyond a tile are cut by hash; how many parts, their counts say
    sizes = stage(dealt.groupBy("bucket").count().where("count > 1"), "buckets")
    parts = F.when(F.col("count") <= tile, 1).otherwise(F.ceil(2 * F.col("count") / tile)).cast("int")
    # every row goes to as many pairs of parts as there are parts: its own part with each
    placed = dealt.join(sizes.select("bucket", parts.alias("parts")), "bucket")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = [F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")]
    # dealt anew by bucket and pair: else Spark would keep a whole bucket in the task that the join put it in
    tiles = placed.select("bucket", *pair, "fp").repartition("bucket", "i", "j").groupBy("bucket", "i", "j").agg(F.collect_list("fp").alias("fps"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps in batch.column(0):
                x, y = link_tiles(np.asarray(fps.values, dtype=np.int64), None, radius)
                a.append(x), b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (a, b)], names=["a", "b"])

    return tiles.select("fps").mapInArrow(compare, "a long, b long")


def edit_distance(a: str, b: str, most: int) -> int:
    """The Levenshtein distance, or ``most + 1`` if it is larger: a column of the table at a time, as bits of one number."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < len(a) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if not a:
        return min(len(b), most + 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for k, c in enumerate(b):
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise, fall = down | ~(diagonal | up) & full, up & diagonal
        distance += bool(rise & last) - bool(fall & last)
        if distance - (len(b) - k - 1) > most:
            return most + 1
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | ~(diagonal | rise) & full, rise & diagonal
    return min(distance, most + 1)


def similar(a: str, b: str, least: float) -> bool:
    """Whether the edit similarity, 1 - distance / longer length, is at least ``least``."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    return edit_distance(a, b, most) <= most


def _verified(lines: DataFrame, radius: int, least: float, part_lines: int) -> DataFrame:
    """(id, root): the verified components of two or more of the lines (id, grp, fp, norm) of a written table.

    Groups that fit one part are settled where they are checked; of the others only forests of links come out, which
    are joined afterwards.
    """
    sizes = stage(lines.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.length("norm")).alias("chars")).where("n > 1"), "group-sizes")
    parts = F.when((F.col("n") <= part_lines) & (F.col("chars") <= PART_CHARS), 1).otherwise(F.ceil(2 * F.greatest(F.col("n") / part_lines, F.col("chars") / PART_CHARS)))
    placed = lines.join(sizes.select("grp", parts.cast("int").alias("parts")), "grp")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = [F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")]
    groups = placed.select("grp", *pair, "parts", F.struct("id", "fp", "norm").alias("member")).repartition("grp", "i", "j").groupBy("grp", "i", "j").agg(F.collect_list("member").alias("members"), F.first("parts").alias("parts"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, settled = [], [], []
            for members, parts in zip(batch.column(0), batch.column(1).to_pylist()):
                ids, fps, norms = (members.values.field(k) for k in range(3))
                ids, fps, norms = ids.to_numpy(), fps.to_numpy().view(np.uint64), norms.to_pylist()
                group = np.arange(len(ids))
                for i in range(1, len(ids)):
                    near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius)
                    while len(near):
                        j = near[0]
                        if similar(norms[i], norms[j], least):
                            if parts > 1:
                                a.append(ids[i]), b.append(ids[j]), settled.append(False)
                            group[group == group[i]] = group[j]
                            near = near[group[near] != group[i]]
                        else:
                            near = near[1:]
                if parts == 1:
                    _, place, times = np.unique(group, return_inverse=True, return_counts=True)
                    roots = np.full(len(times), np.iinfo(np.int64).max)
                    np.minimum.at(roots, place, ids)
                    together = times[place] > 1
                    a += ids[together].tolist()
                    b += roots[place[together]].tolist()
                    settled += [True] * int(together.sum())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(settled, pa.bool_())], names=["a", "b", "settled"])

    found = stage(groups.select("members", "parts").mapInArrow(check, "a long, b long, settled boolean"), "verified")
    rest = components(found.where("NOT settled")).select(F.col("vertex").alias("id"), F.col("component").alias("root"))
    return found.where("settled").select(F.col("a").alias("id"), F.col("b").alias("root")).union(rest)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, least: float = 0.8, tile: int = TILE, part_lines: int = PART_LINES, counts: bool = True) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and with ``counts`` the columns n_lines and n_removed.

    Lines are linked if their SimHashes differ in at most ``radius`` bits and their edit similarity is ``least`` or
    more; of each connected group the first occurrence stays, by key (null last), hash of key and text, place of the
    row, and line. Blank lines stay where they are. A document all of whose lines go has an empty text; a null text
    stays null. Rows with the same key and text are occurrences in turn: the lines of one row stay. Every row and every
    further column stays; columns called n_lines and n_removed are replaced; none may be called _hash, _row, _text,
    _packed, _lines or _kept. Values that are neither null nor blank count as lines whatever their length. The text is
    shuffled twice, compressed, to fetch candidates and to apply the decisions.
    """
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    packed = stage(_packed(docs, names, key, text), "packed-documents")
    place = F.struct(F.col("key").isNull().alias("no"), "key", "_hash", "_row", "line")
    found = packed.select(F.col(key).alias("key"), "_hash", "_row", F.inline("_lines"))
    distinct = stage(found.groupBy("digest").agg(F.min(place).alias("first"), F.first("fp").alias("fp")), "lines")
    document = F.col("first._row").alias("_row")

    # groups of SimHashes within the radius, and SimHashes that several lines share
    prints = stage(distinct.groupBy("fp").agg(F.count("*").alias("n")), "line-simhash")
    grouped = components(_bucket_links(prints.select("fp"), radius, tile)).select(F.col("vertex").alias("fp"), F.col("component").alias("grp"))
    grouped = stage(grouped.union(prints.where("n > 1").join(grouped, "fp", "left_anti").select("fp", F.col("fp").alias("grp"))), "line-groups")
    candidates = stage(distinct.join(grouped, "fp").select("digest", "fp", "grp", "first", F.monotonically_increasing_id().alias("id")), "candidates")

    # their text, from the document of the first occurrence
    wanted = candidates.groupBy(document).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "id", "grp", "fp")).alias("_lines"))
    # the lists grow with the documents, so they are never broadcast, and hashed, so that no text is sorted
    fetched = packed.select("_row", "_packed").join(wanted.hint("shuffle_hash"), "_row").select("_lines", "_packed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            out = [(x["id"], x["grp"], x["fp"], " ".join(normal(lines[x["line"]]))) for wanted, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for lines in [unpack(value).decode().split("\n")] for x in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["id", "grp", "fp", "norm"])

    texts = stage(fetched.mapInArrow(cut, "id long, grp long, fp long, norm string"), "line-texts")
    same = _verified(texts, radius, least, part_lines)
    linked = stage(candidates.join(same, "id").select("digest", "first", "root"), "linked")
    dropped = linked.join(stage(linked.groupBy("root").agg(F.min("first").alias("earliest")), "roots"), "root").where("first <> earliest").select("digest")

    # what stays, per document
    kept = distinct.join(dropped, "digest", "left_anti").groupBy(document).agg(F.collect_list("first.line").alias("_kept"))
    joined = packed.drop("_hash", "_lines").join(kept.hint("shuffle_hash"), "_row", "left")

    kinds = {f.name: T.StructField(text, T.StringType()) if f.name == text else f for f in docs.schema.fields}
    schema = T.StructType([kinds[n] for n in names] + [T.StructField(n, T.LongType()) for n in ("n_lines", "n_removed") if counts])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            get = lambda n: batch.column(batch.schema.get_field_index(n))
            out, total, removed = [], [], []
            for value, keep in zip(get("_packed"), get("_kept")):
                value, keep = value.as_py(), set(keep.as_py() or ())
                if value is None:
                    out.append(None), total.append(0), removed.append(0)
                    continue
                value = unpack(value).decode()
                lines = value.split("\n")
                full_ = [k for k, line in enumerate(lines) if line and not line.isspace()]
                gone = {k for k in full_ if k not in keep}
                out.append("" if gone and len(gone) == len(full_) else value if not gone else "\n".join(line for k, line in enumerate(lines) if k not in gone))
                total.append(len(full_)), removed.append(len(gone))
            columns = [pa.array(out, pa.string()) if n == text else get(n) for n in names]
            columns += [pa.array(total, pa.int64()), pa.array(removed, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return joined.mapInArrow(apply, schema)
