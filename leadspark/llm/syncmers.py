"""Document fingerprints of closed syncmers, in DataFrame functions only.

A text is cut into units: words, or single characters of scripts without case. A run of ``k`` units is chosen if the
least hash among its runs of ``s`` units is that of its first or its last one. The choice depends on nothing outside
the ``k`` units, so equal passages choose equal anchors wherever they stand. About 2 / (k - s + 1) of all runs are
chosen, and at least one of any k - s + 1 neighbouring ones. The fingerprint holds every anchor with its place, so
what two texts share is counted, and so is how much of it stands at one offset.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, S = 7, 2  # units of an anchor, and of the runs inside that choose it
SKETCH = None  # anchors of a fingerprint: all
UNIT = r"\p{Lo}|[^\s\p{Lo}]{1,32}"  # longer words are cut


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` reads it, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _anchors(hashes: Column, k: int, s: int) -> Column:
    """(start, hash) of the chosen runs of unit hashes; the whole text if it is shorter than a run."""
    n, width = F.size(hashes), k - s + 1

    def run(h: Column, i: Column, length: int) -> Column:
        return F.xxhash64(*[F.get(h, i + j) for j in range(length)])

    def choose(inner: Column) -> Column:
        ends = lambda i: F.least(F.get(inner, i), F.get(inner, i + width - 1))
        between = [lambda i, j=j: F.get(inner, i + j) for j in range(1, width - 1)]
        if not between:
            kept = F.sequence(F.lit(0), n - k)
        elif len(between) == 1:
            kept = F.filter(F.sequence(F.lit(0), n - k), lambda i: between[0](i) >= ends(i))
        else:
            kept = F.filter(F.sequence(F.lit(0), n - k), lambda i: F.least(*[b(i) for b in between]) >= ends(i))
        return F.transform(kept, lambda i: F.struct(i.alias("start"), run(hashes, i, k).alias("hash")))

    whole = F.array(F.struct(F.lit(0).alias("start"), F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: F.xxhash64(a, h)).alias("hash")))
    chosen = let(F.transform(F.sequence(F.lit(0), n - s), lambda i: run(hashes, i, s)), choose)
    return F.when(n == 0, F.slice(whole, 1, 0)).when(n < k, whole).otherwise(chosen)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (start, hash): the closed syncmers of the whole text with the unit they start at; null counts as empty."""
    units = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(UNIT), F.lit(0))
    return let(F.transform(units, lambda u: F.xxhash64(u)), lambda h: _anchors(h, k, s))


def placed(found: Column) -> Column:
    """Every anchor as one long, ascending: the upper 32 bits of its hash, then its start."""
    return F.sort_array(F.transform(found, lambda a: F.shiftleft(F.shiftright(a["hash"], 32), 32).bitwiseOR(a["start"].cast("long"))))


def sketch(anchors: Column) -> Column:
    """The distinct hashes of ``placed`` anchors, as integers in ascending order."""
    return F.array_distinct(F.transform(anchors, lambda x: F.shiftright(x, 32).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """The share of common anchors of two sketches: 1 for equal sketches, 0 if just one is empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def aligned(a: Column, b: Column) -> Column:
    """The most anchors that two texts have in common at one offset, as a share of the longer one's anchors.

    ``a`` and ``b`` are ``placed``. Anchors of equal hash are lined up by their starts, and each is held against its
    neighbours of the other text, so repeats cost no more than others. At offset zero every repeat counts; at other
    offsets an anchor that repeats counts with those neighbours only. Equal texts have 1, also if both are empty.
    """
    mask, low = F.lit(-(2**32)), F.lit(2**32 - 1)
    # the side goes into the last bit, so starts take 31 bits
    side = lambda x, n: F.transform(x, lambda v: v.bitwiseAND(mask).bitwiseOR(F.shiftleft(v.bitwiseAND(low), 1)).bitwiseOR(F.lit(n)))

    def offset(x: Column, y: Column) -> Column:
        """Of neighbours: the start in ``b`` less that in ``a``; null unless they are one anchor of each."""
        sign = F.when(x.bitwiseAND(F.lit(1)) == 0, 1).otherwise(-1)
        both = (F.shiftright(x, 32) == F.shiftright(y, 32)) & (x.bitwiseXOR(y).bitwiseAND(F.lit(1)) == 1)
        return F.when(both, sign * (F.shiftright(y.bitwiseAND(low), 1) - F.shiftright(x.bitwiseAND(low), 1)))

    def offsets(m: Column) -> Column:
        pairs = F.zip_with(m, F.slice(m, 2, F.greatest(F.size(m), F.lit(1))), lambda x, y: offset(x, y))
        return F.sort_array(F.filter(pairs, lambda d: d.isNotNull()))

    def longest(found: Column) -> Column:
        """The longest run of equal values."""
        start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(state: Column, d: Column) -> Column:
            run = F.when(state["last"] == d, state["run"] + 1).otherwise(1)
            return F.struct(d.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

        return F.aggregate(found, start, step, lambda state: state["best"])

    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(longest(let(F.sort_array(F.concat(side(a, 0), side(b, 1))), offsets)) / most)


def shown(a: Column) -> Column:
    """A sketch as text: eight hex digits for each anchor."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def with_next(docs: DataFrame, key: str, values: list[str], tie: str, buckets: int | None = None) -> DataFrame:
    """``docs`` with ``next_<v>`` for each of ``values``: of the row after it by descending key, the first after the last.

    Nulls come last and ties follow the long column ``tie``. Rows are dealt into ranges of the key whose borders are
    percentiles; a key that spans several is cut by ``tie`` as well. The first row of each range is copied to the
    end of the range before, so that no range needs another and the rows move once. The driver sees the borders and
    one row per range, as many as there are shuffle partitions times a constant.
    """
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit((k + 1) / buckets) for k in range(buckets - 1)]) if buckets > 1 else F.array(F.lit(1.0))
    borders = docs.agg(F.percentile_approx(F.col(key).cast("long"), shares, F.lit(10_000))).first()[0] or []
    no, down = F.col(key).isNull(), F.coalesce(F.bitwise_not(F.col(key).cast("long")), F.lit(0))
    listed = F.from_json(F.lit(json.dumps(borders)), "array<bigint>")
    below = F.size(F.filter(listed, lambda b: b < F.col(key)))
    # a key that is several borders is cut into as many parts by the tie; the smaller keys of its range follow
    cuts = F.when(no, buckets).otherwise(F.greatest(F.lit(1), F.size(F.filter(listed, lambda b: b == F.col(key)))))
    part = F.when(cuts > 1, F.least(cuts - 1, F.floor((F.col(tie) / 2.0**64 + 0.5) * cuts).cast("int"))).otherwise(2**19)
    placed = docs.select("*", no.alias("_no"), down.alias("_down"), (F.when(no, len(borders) + 1).otherwise(len(borders) - below).cast("long") * 2**20 + part).alias("_range"))

    firsts = placed.groupBy("_range").agg(F.min(F.struct("_no", "_down", tie)).alias("at")).orderBy("_range").collect()
    before = {r["_range"]: firsts[k - 1]["_range"] for k, r in enumerate(firsts)}
    names = ["_range", "_before", "_first_no", "_first_down", "_first_tie"]
    listed_heads = json.dumps([dict(zip(names, (r["_range"], before[r["_range"]], *r["at"]))) for r in firsts])
    heads = spark.range(1).select(F.inline(F.from_json(F.lit(listed_heads), "array<struct<_range:bigint,_before:bigint,_first_no:boolean,_first_down:bigint,_first_tie:bigint>>")))
    is_first = (F.col("_no") == F.col("_first_no")) & (F.col("_down") == F.col("_first_down")) & (F.col(tie) == F.col("_first_tie"))
    own, copy = F.struct("_range", F.lit(0).alias("_copy")), F.struct(F.col("_before").alias("_range"), F.lit(1).alias("_copy"))
    # one row per range and no more: its size is bounded by the number of ranges
    spread = placed.join(F.broadcast(heads), "_range").withColumn("_to", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))))
    order = W.partitionBy("_to._range").orderBy("_to._copy", "_no", "_down", tie)
    moved = spread.select(*docs.columns, "_no", "_down", "_to")
    return moved.select(*docs.columns, "_to", *[F.lead(v).over(order).alias(f"next_{v}") for v in values]).where("_to._copy = 0").drop("_to")


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and by position
    anchors, edited_anchors, aligned_edited, aligned_next.

    The edited text is the text with its last third replaced by the first third's worth of the next document's text,
    by descending key. Null texts count as empty; the only document is its own next. Repeated rows stay rows. Anchors
    of a whole text are longer than it is, so only texts move, and the next one's anchors are computed anew.
    """
    own = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    pairs = with_next(own.select("*", F.xxhash64("_text").alias("_tie")), key, ["_text"], "_tie")
    third = F.floor(F.length("_text") / 3).cast("int")
    edited = F.concat(F.left(F.col("_text"), F.length("_text") - third), F.left(F.col("next__text"), third))
    found = pairs.select(key, "_text", "next__text", edited.alias("_edited"))
    found = found.select(
        key, F.length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        *[placed(anchors(F.col(c))).alias(n) for c, n in (("_text", "_a"), ("_edited", "_b"), ("next__text", "_c"))],
    )
    found = found.select("*", *[sketch(F.col(c)).alias(f"{c}s") for c in ("_a", "_b", "_c")])
    return found.select(
        key, "n_chars", "edited_sha256", shown(F.col("_as")).alias("fingerprint"), shown(F.col("_bs")).alias("edited_fingerprint"),
        likeness(F.col("_as"), F.col("_bs")).alias("near_edited"), likeness(F.col("_as"), F.col("_cs")).alias("near_next"),
        F.col("_a").alias("anchors"), F.col("_b").alias("edited_anchors"),
        aligned(F.col("_a"), F.col("_b")).alias("aligned_edited"), aligned(F.col("_a"), F.col("_c")).alias("aligned_next"),
    )
