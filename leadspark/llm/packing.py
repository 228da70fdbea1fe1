"""Best-fit packing of tokenised documents into sequences, with several capacities at once.

A sequence has a capacity of tokens, of documents and of attention cost (the sum of squared piece lengths). A piece
goes, longest first, into the open sequence that fits it best under every capacity: the one whose remaining
capacities have the smallest weighted norm after it (``rule="norm"``), or the largest weighted dot product with the
piece's demands (``rule="dot"``). If none fits, a new one opens.

Pieces of one length are alike, and so are sequences with equal remaining capacities. The plan is thus made on counts:
one number of pieces per length, at most ``capacity`` of them whatever the size of the corpus, and classes of
sequences. It says, for each length, which ranks go to which sequences. Ranks of pieces come from counts per written
part and length, so that no length is ever sorted in one task.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.session import stage


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and the weight of each share in the choice of a sequence."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"

    @property
    def limits(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or 1, self.attention or 1

    def demands(self, length: int) -> tuple[int, int, int]:
        """What a piece takes of each; nothing of a capacity that is not set."""
        return length, int(self.documents is not None), length * length if self.attention is not None else 0


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a byte-level BPE file of the tokenizers library; its ids are the library's own.

    The file's merges come in the order of their ids, which is checked here; ranks and merges are then the same rule.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    # how byte-level BPE files write bytes: printable ones as themselves, the others from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocabulary = {token: i for token, i in file["model"]["vocab"].items()}
    merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    if [vocabulary[a + b] for a, b in merges] != list(range(256, 256 + len(merges))) or file["normalizer"]:
        raise ValueError(f"{path} is not a byte-level BPE whose merges are in the order of ids")
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(shown[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, path: str, pattern: str, end_id: int, capacity: int = 1024, text: str = "text") -> DataFrame:
    """The pieces of every document: the other columns of ``docs`` with piece, start, length, ids_crc32.

    A document is its ids and then ``end_id``; a null text is empty. Only documents longer than ``capacity`` are cut,
    into pieces of ``capacity`` ids; the first piece takes what is over. Further columns are repeated for each
    piece; columns of the names above are replaced.
    """
    own = ["piece", "start", "length", "ids_crc32"]
    kept = [f for f in docs.schema.fields if f.name not in own and f.name != text]
    schema = T.StructType(kept + [T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in own[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path, pattern)
        tail = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, value in enumerate(batch.column(batch.schema.get_field_index(text))):
                ids = np.concatenate([np.frombuffer(tokenizer.encode_to_numpy(value.as_py() or "", allowed_special="all"), dtype="<u4"), tail])
                first = len(ids) % capacity or min(len(ids), capacity)
                at = 0
                for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    rows.append(row), piece.append(k), start.append(at), length.append(stop - at)
                    crc.append(zlib.crc32(ids[at:stop].tobytes()))
                    at = stop
            index = pa.array(rows, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(f.name)).take(index) for f in kept] + [pa.array(piece, type=pa.int32())] + [pa.array(x, type=pa.int64()) for x in (start, length, crc)],
                names=[f.name for f in kept] + own,
            )

    return docs.withColumn(text, F.col(text).cast("string")).select(*[f.name for f in kept], text).mapInArrow(run, schema)


@dataclass
class _Run:
    """``count`` pieces of ranks from ``rank`` on, ``each`` of them in every sequence from ``sequence`` on."""

    rank: int
    count: int
    each: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: Capacity) -> tuple[dict[int, list[_Run]], int]:
    """For each length the runs that its pieces go to, and the number of sequences.

    A class of sequences is its remaining capacities; it holds ranges of sequence numbers. A class can take a piece
    only if every remainder allows it, and is looked up among the tokens left.
    """
    limits = capacity.limits
    share = [w / limit for w, limit in zip(capacity.weights, limits)]
    classes: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # remainders: (first sequence, how many)
    by_tokens: dict[int, set[tuple[int, int, int]]] = {}
    open_tokens: list[int] = []  # sorted
    runs: dict[int, list[_Run]] = {}
    opened = 0

    def put(key: tuple[int, int, int], first: int, many: int) -> None:
        if key[0] and key[1] and key[2]:
            classes.setdefault(key, []).append((first, many))
            if key[0] not in by_tokens:
                bisect.insort(open_tokens, key[0])
                by_tokens[key[0]] = set()
            by_tokens[key[0]].add(key)

    def drop(key: tuple[int, int, int]) -> None:
        del classes[key]
        by_tokens[key[0]].discard(key)
        if not by_tokens[key[0]]:
            del by_tokens[key[0]]
            open_tokens.remove(key[0])

    def best(need: tuple[int, int, int]) -> tuple[int, int, int] | None:
        found, least = None, None
        for tokens in open_tokens[bisect.bisect_left(open_tokens, need[0]) :]:
            if capacity.rule == "norm" and least is not None and (share[0] * (tokens - need[0])) ** 2 > least[0]:
                break  # the tokens alone leave more than the best found
            for key in by_tokens[tokens]:
                if key[1] < need[1] or key[2] < need[2]:
                    continue
                if capacity.rule == "norm":
                    score = sum((s * (left - n)) ** 2 for s, left, n in zip(share, key, need))
                else:
                    score = -sum(s * s * left * n for s, left, n in zip(share, key, need))
                if least is None or (score, key) < least:
                    found, least = key, (score, key)
        return found

    for length in sorted(counts, reverse=True):
        left, rank, out = counts[length], 0, runs.setdefault(length, [])
        need = capacity.demands(length)
        if any(n > limit for n, limit in zip(need, limits)):
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of a sequence")
        while left:
            key = best(need)
            if key is None:
                # fresh sequences take as many pieces of this length as they hold, the last one what is over
                each = min(limit // n for limit, n in zip(limits, need) if n)
                for many, full in ((left // each, each), (1, left % each)):
                    if many and full:
                        out.append(_Run(rank, many * full, full, opened, 0))
                        put(tuple(limit - full * n for limit, n in zip(limits, need)), opened, many)
                        opened, rank, left = opened + many, rank + many * full, left - many * full
                continue
            ranges = classes[key]
            first, many = ranges.pop()
            if not ranges:
                drop(key)
            take = min(many, left)
            out.append(_Run(rank, take, 1, first, limits[0] - key[0]))
            if take < many:
                put(key, first + take, many - take)
            put(tuple(k - n for k, n in zip(key, need)), first, take)
            rank, left = rank + take, left - take
    return runs, opened


def pack(items: DataFrame, capacity: Capacity) -> DataFrame:
    """``items`` (any columns and ``length``, from 1 to the token capacity) with sequence_id and offset.

    Sequences are gapless from offset 0. ``items`` is written once to the shared folder, as it is read twice. An
    empty table stays empty; repeated rows are separate pieces. Columns sequence_id, offset and those that start
    with ``_pack`` are replaced.
    """
    kept = [c for c in items.columns if c not in ("sequence_id", "offset") and not c.startswith("_pack")]
    written = stage(items.select(*kept, F.spark_partition_id().alias("_pack_part")), "pieces")
    sizes = written.groupBy("_pack_part", "length").agg(F.count("*").alias("_pack_n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_pack_n").alias("n")).collect()}  # a row per length
    runs, _ = plan(counts, capacity)
    table = {n: np.array([[r.rank, r.each, r.sequence, r.offset] for r in rs], dtype=np.int64) for n, rs in runs.items()}

    before = W.partitionBy("length").orderBy("_pack_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_pack_part", "length", F.coalesce(F.sum("_pack_n").over(before), F.lit(0)).alias("_pack_before"))
    inside = W.partitionBy("_pack_part", "length").orderBy(*[F.col(f.name) for f in items.schema.fields if f.name in kept and isinstance(f.dataType, T.AtomicType)])
    ranked = written.join(offsets, ["_pack_part", "length"]).select(*kept, (F.col("_pack_before") + F.row_number().over(inside) - 1).alias("_pack_rank"))

    fields = [f for f in items.schema.fields if f.name in kept]
    schema = T.StructType(fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.schema.get_field_index("_pack_rank")).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                own = table[int(n)]
                r = own[np.searchsorted(own[:, 0], rank[rows], side="right") - 1]
                nth = rank[rows] - r[:, 0]
                sequence[rows] = r[:, 2] + nth // r[:, 1]
                offset[rows] = r[:, 3] + nth % r[:, 1] * n
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in fields] + [pa.array(sequence), pa.array(offset)], names=[f.name for f in schema.fields])

    return ranked.mapInArrow(run, schema)
