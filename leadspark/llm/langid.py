"""Language identification by compression.

For each learned language a raw-content zstandard dictionary is made of excerpts of labelled texts. A text is
compressed with every dictionary, whole, in blocks that each start from the dictionary alone; the language whose
dictionary gives the smallest sum wins. Each block is led by a carrier that ends every dictionary: it always shrinks,
so that even a few words are not stored as they are, which would make all sizes equal. If the next language is nearly as small, the prediction is marked as rejected.
"""

from __future__ import annotations

import math

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.llm.arrow import with_columns

UNDETERMINED = "und"
MAX_LANGUAGES = 500  # more distinct labels than this are taken for an error
BLOCK = 4000  # bytes of normalised text compressed at once
CARRIER = bytes(range(1, 32)) * 4  # not part of any normalised text
# bytes that are no ASCII letter and no part of a longer character count as spaces
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def normal(text: str) -> bytes:
    """Lower case, letters and other scripts' characters only, single spaces between and around."""
    return b" " + b" ".join(text.lower().encode("utf-8").translate(_LETTERS).split()) + b" "


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", texts: int = 400, excerpt: int = 400, size: int = 32_768) -> dict[str, bytes]:
    """A dictionary of at most ``size`` bytes for each non-null label, the most frequent label first.

    The sample is bounded: per language the ``texts`` rows of the smallest hash of their key, ``excerpt`` characters
    from each, repeated excerpts once. Each task keeps that many rows per language at most before the exchange.
    """
    usable = labelled.where(F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(key).alias("h"))
    order = W.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    sample = usable.select("lang", "h", F.substring("text", 1, excerpt).alias("text")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= texts)
    found: dict[str, list[bytes]] = {}
    for row in sample.limit((MAX_LANGUAGES + 1) * texts).collect():
        found.setdefault(row.lang, []).append((row.n, normal(row.text)))
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().where(F.col("lang").isin(list(found))).collect()} if found else {}
    names = sorted(found, key=lambda name: (-rows[name], name))
    return {name: b"".join(dict.fromkeys(t for _, t in sorted(found[name])))[:size] for name in names}


class Compressors:
    """One compressor per language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.of = []
        for name in self.names:
            content = dictionaries[name] + CARRIER
            log = max(len(content).bit_length(), 10)
            settings = zstandard.ZstdCompressionParameters(
                window_log=17, chain_log=log - 1, hash_log=log, search_log=3, min_match=3, target_length=16, strategy=zstandard.STRATEGY_GREEDY,
                write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=settings)
            self.of.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=dictionary))

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin. Ties go to the more frequent language; no letters or no languages give ``und``."""
        if not self.names or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0
        data = normal(text)
        blocks = [CARRIER + data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.of]
        least = min(sizes)
        at = sizes.index(least)
        others = [s for k, s in enumerate(sizes) if k != at]
        if not others:
            return self.names[at], 1.0, 1.0
        margin = (min(others) - least) / min(others)
        spread = math.sqrt(8 * least)
        return self.names[at], 1 / (1 + sum(math.exp(-8 * (s - least) / spread) for s in others)), margin


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", least_margin: float = 0.005, names: tuple[str, str, str] = ("lang_pred", "score", "accepted")
) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and accepted, or what ``names`` calls them.

    ``accepted`` is false if the smallest size undercuts the next by less than the share ``least_margin``, or if the
    text is null or has no letter (``und``, score 0). Each row is judged on its own whole text, so repeated rows get
    equal answers; columns of the three names are replaced.
    """

    def make():
        compressors = Compressors(dictionaries)

        def function(batch: pa.RecordBatch) -> list:
            got = [compressors.classify(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            return [[g[0] for g in got], [g[1] for g in got], [g[0] != UNDETERMINED and g[2] >= least_margin for g in got]]

        return function

    fields = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    return with_columns(docs.withColumn(text, F.col(text).cast("string")), fields, make)


def held_out(key: str) -> Column:
    """Whether the row is kept from learning: CRC-32 of the key as text leaves 2 modulo 4; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
