"""Prefix trie of conversations by hashing of fixed-length blocks of turns.

Every conversation is first rebuilt: the first ``shared`` turns of the conversation that heads its
group (ids are grouped by ``group``) replace as many of its own. A node of the trie is a distinct
sequence of first turns; its members are the conversations that start with it.

1. Texts stay where they are: a turn goes on as the digest of its role and text, and its length.
   Turns are dealt by group and sorted, and each task walks its conversations once, turn by turn,
   holding one block of turns. A node's name is the digest of its block's parent and the turns since.
2. Conversations are grouped by whole blocks first: equal blocks after the same parent are one
   edge with a count, so copies meet once a block and not once a turn.
3. Turns inside a block are told apart only where a parent has several next blocks. Where it has
   one, all its inner nodes have that block's members.
4. Sums over subtrees double their reach each round: a block node knows its ancestors 1, 2, 4, ...
   blocks above, adds what it has gathered to one of them, and after round k holds all of 2^k
   blocks below. Nodes of one member only are left out, as their sums are known.
5. Ids of the members that end at a node are hashed as a stream of sorted chunks.

A parent with more than ``hot`` children (the root, a common opening) is joined from a small
table of such parents, and every other key has at most ``hot`` rows.

Cases: null roles and texts are empty; turns of one number follow the order of their digests; a
null turn comes first; repeated rows are turns of their own; rows without a conversation id name
no conversation and are left out; texts of any length are digested whole; a conversation of any
length streams through one task, block by block; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.session import ship_code, written

ROOT = b"\0" * 16
_PIECE = "conv_id long, parent binary, body binary, chars array<int>, depth long, node binary, up array<binary>"
#: Ids of one chunk share all but their lowest bits.
_CHUNK_BITS = 12


def _pieces(batches: Iterator[pa.RecordBatch], block: int, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns to the blocks of each rebuilt conversation; the last, shorter or empty, ends it."""
    out: list[tuple] = []
    group = conv = None
    head: list[tuple[bytes, int]] = []
    own = shared = 0
    parent, keys, body, chars = ROOT, [], [], []

    def close(full: bool) -> None:
        nonlocal parent, body, chars
        joined = b"".join(body)
        node = hashlib.md5(parent + joined).digest() if body else parent
        at = len(keys) + 1 if full else 0
        up = [keys[at - 1 - (1 << k)] if at > 1 << k else ROOT for k in range(at.bit_length())]
        out.append((conv, parent, joined, chars, len(keys) * block, node, up))
        if full:
            keys.append(node)
            parent = node
        body, chars = [], []

    def push(digest: bytes, n: int) -> None:
        body.append(digest)
        chars.append(n)
        if len(body) == block:
            close(True)

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], "conv_id parent body chars depth node up".split())

    for batch in batches:
        for g, c, h, digest, n in zip(*(batch.column(k).to_pylist() for k in ("group", "conv_id", "shared", "digest", "n"))):
            if c != conv:
                if conv is not None:
                    close(False)
                if g != group:
                    group, head = g, []
                conv, own, shared = c, 0, h
                parent, keys, body, chars = ROOT, [], [], []
                if c != g:
                    for turn in head[:shared]:
                        push(*turn)
            own += 1
            if c == g and own <= most:
                head.append((digest, n))
            if c == g or own > shared:
                push(digest, n)
        if out:
            yield flushed()
    if conv is not None:
        close(False)
        yield flushed()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ids sorted by node to one SHA-256 a node."""
    last, state = None, None

    def done(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])

    for batch in batches:
        rows = []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if node != last:
                if state is not None:
                    rows.append((last, state.hexdigest()))
                last, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if rows:
            yield done(rows)
    if state is not None:
        yield done([(last, state.hexdigest())])


def _digest() -> Column:
    """What tells one turn from another; the role's length keeps role and text apart."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def rebuilt_blocks(turns: DataFrame, block: int = 4, group: int = 100, shared: int = 6) -> DataFrame:
    """The blocks of all rebuilt conversations (see ``_PIECE``): ``crc32(id) % shared`` turns come from the group's head."""
    conv = F.col("conv_id").cast("long")
    rows = turns.filter(conv.isNotNull()).select(
        (conv - conv % group).alias("group"),
        conv.alias("conv_id"),
        (F.crc32(conv.cast("string").cast("binary")) % shared).cast("int").alias("shared"),
        F.col("turn").cast("long").alias("turn"),
        _digest().alias("digest"),
        F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("n"),
    )
    order = ["group", F.col("conv_id") != F.col("group"), "conv_id", F.col("turn").asc_nulls_first(), "digest"]
    return rows.repartition("group").sortWithinPartitions(*order).mapInArrow(partial(_pieces, block=block, most=shared - 1), _PIECE)


def _ends(pieces: DataFrame, block: int) -> DataFrame:
    """node, ends_sha256 for every node at which a conversation ends."""
    last = pieces.filter(F.octet_length("body") < 16 * block).select("node", "conv_id")
    chunks = last.groupBy("node", F.shiftright("conv_id", _CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("node", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").mapInArrow(_hashed, "node binary, ends_sha256 string")


def _inner(edges: DataFrame) -> DataFrame:
    """Every turn of the edges' blocks as a node, with the names of the block's nodes down to it."""
    steps = F.sequence(F.lit(1), (F.octet_length("body") / 16).cast("int"))
    name = lambda j: F.unhex(F.md5(F.concat(F.col("parent"), F.substring(F.col("body"), F.lit(1), j * 16))))
    named = edges.withColumn("names", F.transform(steps, name))
    each = named.select("parent", "depth", "chars", "names", "n", "conv_id", "up", F.posexplode("names").alias("at", "node"))
    return each.select(
        "node",
        F.when(F.col("at") == 0, F.col("parent")).otherwise(F.get("names", F.col("at") - 1)).alias("above"),
        F.col("parent").alias("block"),
        (F.col("depth") + F.col("at") + 1).alias("depth"),
        F.get("chars", F.col("at")).cast("long").alias("chars"),
        F.slice("names", F.lit(1), F.col("at") + 1).alias("path"),
        F.when(F.size("up") > 0, F.when(F.col("at") + 1 == F.size("names"), F.col("up"))).alias("up"),
        "n",
        "conv_id",
    )


def trie(turns: DataFrame, block: int = 4, group: int = 100, shared: int = 6, hot: int = 4096) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship_code(turns.sparkSession)
    pieces = written(rebuilt_blocks(turns, block, group, shared), "trie-pieces")
    counted = F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")
    edges = written(pieces.filter(F.octet_length("body") > 0).groupBy("parent", "body", "chars", "up", "depth", "node").agg(*counted), "trie-edges")

    # Blocks: where a parent has one next block, its inner nodes have that block's members.
    siblings = edges.groupBy("parent").agg(F.count(F.lit(1)).alias("s"), F.first(F.struct(*edges.columns)).alias("e"))
    siblings = written(siblings.select("parent", "s", F.when(F.col("s") == 1, F.col("e")).alias("e")), "trie-siblings")
    alone = _inner(siblings.filter("s = 1").select("e.*"))
    crowded = written(siblings.filter(F.col("s") > hot).select("parent"), "trie-hot")
    few = siblings.filter((F.col("s") > 1) & (F.col("s") <= hot)).select("parent")
    parted = edges.join(crowded, "parent", "left_semi").unionByName(edges.join(crowded, "parent", "left_anti").join(few, "parent", "left_semi"))
    told = _inner(parted).groupBy("node", "above", "block", "depth", "chars", "path", "up").agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"))
    top = pieces.filter(F.octet_length("body") < 16 * block).agg(*counted).filter("n > 0")
    none = F.lit(None)
    top = top.select(F.lit(ROOT).alias("node"), none.cast("binary").alias("above"), none.cast("binary").alias("block"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<binary>").alias("path"), F.array().cast("array<binary>").alias("up"), "n", "conv_id")
    nodes = written(alone.unionByName(told).unionByName(top), "trie-nodes")

    # Children, and each node's parent.
    children = nodes.filter("depth > 0").groupBy(F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    full = written(nodes.join(children, "node", "left").fillna(0, ["n_children"]), "trie-children")
    parents = full.filter("n_children > 0").select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("parent_n"), "n_children")
    many = written(parents.filter(F.col("n_children") > hot).drop("n_children"), "trie-hot")
    below = full.filter("depth > 0")
    hung = below.join(many, "above").unionByName(below.join(many, "above", "left_anti").join(parents.filter(F.col("n_children") <= hot).drop("n_children"), "above"))
    lone = full.filter("depth = 0").withColumns({"parent_conv_id": none.cast("long"), "parent_n": none.cast("long")})
    hung = written(hung.unionByName(lone), "trie-hung")

    # What each node adds to its subtrees. A lone member's first own node stands for its leaf.
    leaf = ((F.col("n") == 1) & (F.col("parent_n") > 1)) | ((F.col("n") > 1) & (F.col("n_children") == 0))
    adds = hung.filter(leaf | ((F.col("n") > 1) & (F.col("depth") > 0))).select("node", "block", "path", "depth", leaf.cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved"))
    summed = F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    gained = adds.filter("block is not null").groupBy(F.col("block").alias("node")).agg(*summed)
    ends = hung.filter((F.col("n") > 1) & F.col("up").isNotNull()).select("node", "up", "depth")
    reach = written(ends.join(gained, "node", "left").fillna(0, ["leaves", "saved"]), "trie-reach")
    deepest = (reach.agg(F.max("depth")).first()[0] or 0) // block
    for k in range(deepest.bit_length()):
        sent = reach.filter((F.size("up") > k) & ((F.col("leaves") > 0) | (F.col("saved") > 0)))
        sent = sent.groupBy(F.get("up", F.lit(k)).alias("node")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        more = reach.join(sent, "node", "left")
        total = lambda a: (F.col(a) + F.coalesce(F.col(f"more_{a}"), F.lit(0))).alias(a)
        reach = written(more.select("node", "up", "depth", total("leaves"), total("saved")), "trie-reach")

    # Within a block, and what lies beyond it, to all nodes on the way down the block.
    beyond = reach.filter("depth > 0").select("node", "leaves", "saved").join(full.select("node", "path"), "node")
    parts = adds.filter("depth > 0").select("path", "leaves", "saved").unionByName(beyond.select("path", "leaves", "saved"))
    within = parts.select(F.explode("path").alias("node"), "leaves", "saved").groupBy("node").agg(*summed)
    within = within.unionByName(reach.filter("depth = 0").select("node", "leaves", "saved"))
    shown = hung.join(within, "node", "left").join(_ends(pieces, block), "node", "left")
    single = F.col("n") == 1
    return shown.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        "n_children",
        F.when(single | ((F.col("depth") == 0) & (F.col("n_children") == 0)), F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        F.when(single, F.lit(0)).otherwise(F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
