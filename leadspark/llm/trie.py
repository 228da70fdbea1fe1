"""Prefix trie of conversations as a z-fast trie kept in tables.

Turns become 128-bit tokens, and every prefix of a conversation a 128-bit digest of its tokens. Only different
conversations enter the trie, each with the count and the least id of its copies. The trie is compacted: a node's edge
spans the depths (low, high], its id is the digest of its whole path. Its handle is the digest of the prefix whose
length is the two-fattest number of that span, the one with the most trailing zero bits. A conversation finds its exit
node by a fat binary search: it looks up the handle at the two-fattest depth of the span it still considers, goes below
the node found or above the depth, so rounds grow with the logarithm of the longest conversation.

Conversations enter in batches: all search at once, of those that leave the trie at the same place with the same next
turn one (by a hash) enters as a leaf, edges left in the middle are split, and the others go on from there. Batches grow
with the logarithm of the number of conversations. Compacted edges expand to one row per depth only at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadspark.llm.arrow import small
from leadspark.session import stage, unstage

BLOCK = 1024  # prefixes of a conversation in one row
ROUNDS = 3  # of a search between two writes
EMPTY = bytes(16)  # digest of no turns
GROUP, PREFIX = 100, 5  # conversations of a group start with up to so many turns of its first


# --- conversations ------------------------------------------------------------------------------

def tokens(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, token, chars): turns in order, nulls first, then by token; no text is shuffled."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), token.alias("token"), F.length(text).cast("long").alias("chars"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "token"))
    return turns.select("conv_id", place.cast("long").alias("place"), "token", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, token, chars) of every conversation c: the first h turns of c - c % 100, then its own after the
    first h, for h = crc32(c) % 6. A conversation without turns gives one row of depth 0."""
    first = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") <= PREFIX))
    leaders = first.groupBy(F.col("conv_id").alias("leader")).agg(F.array_sort(F.collect_list(F.struct("place", "token", "chars"))).alias("lead"))
    h = F.crc32(F.col("conv_id").cast("string")) % (PREFIX + 1)
    rows = turns.withColumns({"leader": F.col("conv_id") - F.col("conv_id") % GROUP, "h": h}).join(leaders, "leader", "left")
    rows = rows.withColumn("lead", F.slice(F.coalesce("lead", F.array()), F.lit(1), F.col("h").cast("int")))
    own = F.when(F.col("place") > F.col("h"), F.array(F.struct((F.size("lead") + F.col("place") - F.col("h")).alias("place"), "token", "chars"))).otherwise(F.array())
    head = F.when(F.col("place") == 1, F.concat(F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("token"), F.lit(0).cast("long").alias("chars"))), "lead"))
    parts = rows.select("conv_id", F.explode(F.concat(F.coalesce(head, F.array()), own)).alias("t"))
    return parts.select("conv_id", F.col("t.place").alias("depth"), F.col("t.token").alias("token"), F.col("t.chars").alias("chars"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, block, digests, upto, before, size, ends): up to BLOCK prefixes a row, in order of depth.

    ``turns`` holds conv_id, depth (0 for a mark that the conversation exists, then from 1 without gaps), token, chars.
    ``upto`` counts the code points of each prefix, ``before`` those before the block; ``ends`` is null but in a
    conversation's last row, where it is its digest. A conversation streams through one task, a block of it is in memory.
    """
    schema = "conv_id long, block long, digests array<binary>, upto array<long>, before long, size long, ends binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, block, digests, upto, before, digest = None, 0, [], [], 0, EMPTY

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
            names = ["conv_id", "block", "digests", "upto", "before", "size", "ends"]
            columns = [pa.array(c, type=t) for c, t in zip(zip(*done), types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        def close(last: bool) -> None:
            done.append((conv, block, digests, upto, before, block * BLOCK + len(digests), digest if last else None))

        for batch in small(batches):
            for c, depth, token, n in zip(*(x.to_pylist() for x in batch.columns)):
                if depth == 0:
                    if conv is not None:
                        close(True)
                    conv, block, digests, upto, before, digest = c, 0, [], [], 0, EMPTY
                    continue
                if len(digests) == BLOCK:
                    close(False)
                    block, digests, upto, before = block + 1, [], [], upto[-1]
                digest = hashlib.blake2b(digest + token, digest_size=16).digest()
                digests.append(digest)
                upto.append((upto[-1] if upto else before) + n)
            if len(done) >= BLOCK:
                yield flush()
        if conv is not None:
            close(True)
        if done:
            yield flush()

    ordered = turns.select("conv_id", "depth", "token", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return ordered.mapInArrow(run, schema)


# --- trie ---------------------------------------------------------------------------------------

def fattest(low: str, high: str) -> Column:
    """The number in (low, high] with the most trailing zero bits."""
    return F.expr(f"shiftleft(shiftright({high}, length(bin({low} ^ {high})) - 1), length(bin({low} ^ {high})) - 1)")


def with_digests(df: DataFrame, paths: DataFrame, conv: str, depths: dict[str, Column]) -> DataFrame:
    """``df`` with the digests of the first so many turns of conversation ``conv``; null beyond its end."""
    at = paths.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.col("digests").alias("_digests"))
    for name, depth in depths.items():
        joined = df.withColumn("_at", depth).withColumn("_in", F.floor((F.col("_at") - 1) / BLOCK))
        joined = joined.join(at, (F.col(conv) == F.col("_conv")) & (F.col("_in") == F.col("_block")), "left")
        found = F.try_element_at("_digests", ((F.col("_at") - 1) % BLOCK + 1).cast("int"))
        df = joined.select(*df.columns, F.when(F.col("_at") == 0, F.lit(EMPTY)).otherwise(found).alias(name))
    return df


def search(pending: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Fat binary search: ``at`` becomes the id and ``low`` the depth of the deepest node whose handle starts the path.

    A round rules out the depth looked up, the fattest left, so there are no more rounds than bits in a depth.
    """
    handles = nodes.select(F.col("handle").alias("_handle"), F.col("id").alias("_id"), F.col("high").alias("_high"))
    hit = F.col("_id").isNotNull()
    longest = pending.agg(F.max("high")).first()[0]  # one number
    state = pending
    for k in range(longest.bit_length()):
        fat = F.when(F.col("low") < F.col("high"), fattest("low", "high"))
        probed = with_digests(state.withColumn("fat", fat), paths, "conv_id", {"probe": F.col("fat")}).join(handles, F.col("probe") == F.col("_handle"), "left")
        state = probed.select(
            "conv_id", "size",
            F.when(hit, F.col("_high")).otherwise(F.col("low")).alias("low"),
            F.when(F.col("fat").isNull() | hit, F.col("high")).otherwise(F.col("fat") - 1).alias("high"),
            F.coalesce("_id", "at").alias("at"),
        )
        if k % ROUNDS == ROUNDS - 1:
            state = stage(state, "search")
    return state


def locate(pending: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv_id, size, matched, edge, edge_low, edge_high, edge_conv): how far a conversation goes in the trie, and the
    edge it leaves in the middle; null where it leaves at a node. Those that are nodes already are not returned."""
    found = search(pending, nodes, paths)
    edges = nodes.select(F.col("id").alias("edge"), F.col("low").alias("edge_low"), F.col("high").alias("edge_high"), F.col("conv_id").alias("edge_conv"), "step")
    # at the node found, if its whole path is a prefix; else on the edge to it
    here = with_digests(found, paths, "conv_id", {"here": F.col("low"), "next": F.col("low") + 1}).withColumn("inside", ~F.col("here").eqNullSafe(F.col("at")))
    here = stage(here.where("inside OR low < size"), "found")
    below = here.where("NOT inside").join(edges, F.col("next") == F.col("step"), "left")
    into = here.where("inside").join(edges.drop("step"), F.col("at") == F.col("edge"))
    columns = ["conv_id", "size", "low", "edge", "edge_low", "edge_high", "edge_conv"]
    exits = stage(below.select(*columns).unionByName(into.select(*columns)), "exits")
    # prefixes in common with the edge's conversation: equal digests, as both end at the first difference
    mine = paths.select("conv_id", "block", F.col("digests").alias("mine"))
    its = paths.select(F.col("conv_id").alias("edge_conv"), "block", F.col("digests").alias("its"))
    on_edge = exits.where("edge IS NOT NULL")
    same = F.size(F.filter(F.zip_with("mine", "its", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    matched = on_edge.select("conv_id", "edge_conv").join(mine, "conv_id").join(its, ["edge_conv", "block"]).groupBy("conv_id").agg(F.sum(same).alias("matched"))
    inner = on_edge.join(matched, "conv_id")
    outer = exits.where("edge IS NULL").withColumn("matched", F.col("low"))
    out = ["conv_id", "size", "matched", "edge", "edge_low", "edge_high", "edge_conv"]
    return inner.select(*out).unionByName(outer.select(*out))


def insert(located: DataFrame, nodes: DataFrame | None, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie with a batch entered, and the conversations that still wait, each from the node where it left."""
    keyed = stage(with_digests(located, paths, "conv_id", {"key": F.col("matched") + 1, "at": F.col("matched")}), "located")
    entering = keyed.where("matched < size").groupBy("key").agg(F.min_by(F.struct("conv_id", "size", "matched"), F.struct(F.xxhash64("conv_id"), "conv_id")).alias("leaf"))
    leaves = entering.select(F.col("leaf.conv_id").alias("conv_id"), F.col("leaf.matched").alias("low"), F.col("leaf.size").alias("high"))
    cuts = keyed.where("edge IS NOT NULL").select("edge", "edge_low", "edge_high", "edge_conv", F.col("matched").alias("high"))
    cuts = cuts.unionByName(cuts.withColumn("high", F.col("edge_high"))).distinct()
    above = F.lag("high").over(W.partitionBy("edge").orderBy("high"))
    pieces = cuts.select("edge", F.col("edge_conv").alias("conv_id"), F.coalesce(above, F.col("edge_low")).alias("low"), "high")
    new = leaves.unionByName(pieces.select("conv_id", "low", "high")).withColumn("fat", fattest("low", "high"))
    depths = {"id": F.col("high"), "up": F.col("low"), "step": F.col("low") + 1, "handle": F.col("fat")}
    new = with_digests(new, paths, "conv_id", depths).drop("fat")
    if nodes is not None:
        whole = nodes.join(keyed.where("edge IS NOT NULL").select(F.col("edge").alias("id")).distinct(), "id", "left_anti")
        new = whole.select(*new.columns).unionByName(new)
    trie = stage(new, "trie")
    entered = entering.select(F.col("leaf.conv_id").alias("conv_id"))
    waiting = keyed.where("matched < size").join(entered, "conv_id", "left_anti").select("conv_id", "size", F.col("matched").alias("low"), F.col("size").alias("high"), "at")
    waiting = stage(waiting, "waiting")
    unstage(keyed)
    return trie, waiting


def build(paths: DataFrame) -> DataFrame:
    """(id, up, step, handle, low, high, conv_id): the nodes of the compacted trie but its root, over ``prefixes``.

    ``conv_id`` names a conversation that passes; ``up`` is the parent's id. Sequences must differ from each other.
    """
    whole = paths.where("ends IS NOT NULL AND size > 0")
    none = {"edge": "binary", "edge_low": "long", "edge_high": "long", "edge_conv": "long"}
    located = whole.select("conv_id", "size", F.lit(0).cast("long").alias("matched"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    nodes, waiting = insert(located, None, paths)
    while not waiting.isEmpty():
        grown, rest = insert(locate(waiting, nodes, paths), nodes, paths)
        unstage(nodes)
        unstage(waiting)
        nodes, waiting = grown, rest
    return nodes


# --- what the nodes hold --------------------------------------------------------------------------

def end_digests(members: DataFrame) -> DataFrame:
    """(id, ends_sha256): of the ids of the conversations that end at a node, ascending, joined by commas.

    Sorted within partitions and streamed, so copies of one conversation in any number take no more memory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, type=t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["id", "ends_sha256"])

        for batch in batches:
            for node, conv in zip(*(x.to_pylist() for x in batch.columns)):
                if node != current:
                    if current is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = node, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if len(done) >= BLOCK:
                yield flush()
        if current is not None:
            done.append((current, digest.hexdigest()))
        if done:
            yield flush()

    ordered = members.select("id", "conv_id").repartition("id").sortWithinPartitions("id", "conv_id")
    return ordered.mapInArrow(run, "id binary, ends_sha256 string")


def weigh(nodes: DataFrame, paths: DataFrame, groups: DataFrame) -> DataFrame:
    """The nodes with n_convs, least (member), n_children, n_leaves, start (code points above the node's edge) and saved
    (along the edge and below).

    Every different conversation adds to the nodes on its path. What an edge saves is added once, by the conversation
    that names it, to all nodes above: a running sum up its path.
    """
    prefix = F.explode(F.arrays_zip(F.col("digests").alias("id"), "upto")).alias("p")
    passed = paths.select("conv_id", prefix).select("conv_id", "p.id", "p.upto").join(nodes.select("id", "up", "low", "high", F.col("conv_id").alias("owner")), "id")
    passed = stage(passed, "passed")
    children = nodes.groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n_children"))
    childless = nodes.select("id").join(children, "id", "left_anti").withColumn("leaf", F.lit(1).cast("long"))
    tips = groups.join(childless, "id", "left").select("conv_id", "n", "leaf")
    counted = passed.join(tips, "conv_id")
    counts = stage(counted.groupBy("id").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("least"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves")), "counts")
    # the code points along an edge, by the conversation that names it
    down = W.partitionBy("conv_id").orderBy("high")
    along = passed.withColumn("start", F.coalesce(F.lag("upto").over(down), F.lit(0).cast("long"))).join(counts.select("id", "n_convs"), "id")
    own = F.when(F.col("owner") == F.col("conv_id"), (F.col("n_convs") - 1) * (F.col("upto") - F.col("start"))).otherwise(F.lit(0))
    running = F.sum(own).over(W.partitionBy("conv_id").orderBy(F.desc("high")).rowsBetween(W.unboundedPreceding, W.currentRow))
    saved = along.select("id", "start", running.alias("r")).groupBy("id").agg(F.sum("r").alias("saved"), F.min("start").alias("start"))
    out = nodes.join(counts, "id").join(saved, "id").join(children, "id", "left")
    weighed = stage(out.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "weighed")
    unstage(passed)
    unstage(counts)
    return weighed


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per different prefix of the rebuilt conversations, the empty one included: conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` holds conv_id, turn, role, text; null roles and texts count as empty, rows of a null conv_id take
    no part, rows of equal turn stand by a digest of role and text, further columns are ignored. An empty table gives
    no rows. Sequences count as equal if their 128-bit digests are.
    """
    turns = stage(tokens(conversations), "turns")
    everyone = stage(prefixes(rebuilt(turns)), "prefixes")
    members = everyone.where("ends IS NOT NULL").select("conv_id", F.col("ends").alias("id"))
    groups = stage(members.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")), "groups")
    paths = stage(everyone.join(groups.select("conv_id"), "conv_id", "left_semi"), "paths")
    nodes = build(paths)
    weighed = weigh(nodes, paths, groups)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    ends = end_digests(members)

    total = groups.agg(F.min("conv_id").alias("first"), F.sum("n").alias("n")).first()  # one row
    top = weighed.where(F.col("up") == F.lit(EMPTY)).select(F.lit(1).alias("child"), "n_leaves", "saved", F.lit(None).cast("string").alias("ends"))
    last = ends.where(F.col("id") == F.lit(EMPTY)).select(F.lit(None).alias("child"), F.lit(None).alias("n_leaves"), F.lit(None).alias("saved"), F.col("ends_sha256").alias("ends"))
    root = top.unionByName(last).agg(F.count("child").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"))
    root = root.where(F.lit(total["first"] is not None)).select(
        F.lit(total["first"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(total["n"]).cast("long").alias("n_convs"), "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends", empty).alias("ends_sha256"),
    )
    parents = weighed.select(F.col("id").alias("up"), F.col("least").alias("parent"))
    named = weighed.join(parents, "up", "left").withColumn("parent", F.coalesce("parent", F.lit(total["first"]).cast("long"))).join(ends, "id", "left")
    # expand: every depth of an edge, with the code points above it
    above = F.concat(F.array("before"), F.slice("upto", F.lit(1), F.size("upto") - 1))
    blocks = paths.where(F.size("upto") > 0).select("conv_id", "block", above.alias("above"))
    spans = named.join(blocks, "conv_id").where((F.col("block") * BLOCK < F.col("high")) & ((F.col("block") + 1) * BLOCK > F.col("low")))
    each = spans.select("*", F.posexplode("above").alias("k", "over")).withColumn("depth", F.col("block") * BLOCK + F.col("k") + 1)
    each = each.where((F.col("depth") > F.col("low")) & (F.col("depth") <= F.col("high")))
    # what the edge saves is less by its code points above a depth
    lost = (F.col("n_convs") - 1) * (F.col("over") - F.col("start"))
    last = F.col("depth") == F.col("high")
    body = each.select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("low") + 1, F.col("least")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves", (F.col("saved") - lost).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", empty)).otherwise(empty).alias("ends_sha256"),
    )
    return root.unionByName(body)
