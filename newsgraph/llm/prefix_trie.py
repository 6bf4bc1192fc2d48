"""The trie of shared conversation prefixes, built as a burst trie.

Distinct conversations lie as suffixes in containers under trie heads. At first there is one container under the root.
A container with too many suffixes bursts: its head becomes a node of the trie and its suffixes move to containers of
their next turn. What remains is small; each container is sorted and swept into nodes by one task, which holds no more
than the open path and the closed children of its nodes. Heads get their figures from the containers below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm.common import map_arrow
from newsgraph.session import stored

CONTAINER = 1024  # production parameter: suffixes that a container may hold before it bursts
_SALTS = 64  # shares of a large container while it is looked up
_SEGMENT = 4096  # ids that travel as one string
HEAD_TURNS = 6  # rebuilt conversations share up to HEAD_TURNS - 1 turns
FAMILY = 100


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, turn_id, chars``: position in the conversation, identity of (role, text), code points of
    the text. Turns of one number are ordered by role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    identity = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return rows.select(
        "conv_id",
        F.row_number().over(order).alias("position"),
        F.substring(identity, 1, 32).alias("turn_id"),
        F.length("text").alias("chars"),
    )


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their first turns with the first one of their hundred: members, and their turns."""
    members = turns.select("conv_id").distinct()
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS).cast("int")
    plan = members.select("conv_id", taken.alias("taken"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("donor"))
    heads = turns.where(F.col("position") < HEAD_TURNS).withColumnRenamed("conv_id", "donor")
    columns = ["conv_id", "position", "turn_id", "chars"]
    borrowed = heads.join(plan, "donor").where("position <= taken").select(columns)
    own = turns.join(plan, "conv_id").where("position > taken").select(columns)
    return members, borrowed.unionByName(own)


def _key(depth: Column) -> Column:
    """The name of the trie node that the first turns of ``path`` lead to."""
    return F.sha2(F.array_join(F.slice("path", F.lit(1), depth), ""), 256)


def sequences(members: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, path, chars, seq`` per member, turnless ones included; ``seq`` names the whole path."""
    steps = F.array_sort(F.collect_list(F.struct("position", "turn_id", "chars"))).alias("steps")
    rows = members.join(turns.groupBy("conv_id").agg(steps), "conv_id", "left")
    path = F.coalesce(F.col("steps.turn_id"), F.array().cast("array<string>"))
    chars = F.coalesce(F.col("steps.chars"), F.array().cast("array<int>"))
    return rows.select("conv_id", path.alias("path"), chars.alias("chars")).withColumn("seq", _key(F.size("path")))


def member_digests(rows: DataFrame) -> DataFrame:
    """``seq, ends_sha256``: digest of the comma-joined ids of all rows of a sequence in ascending order.

    Ids are sorted and joined by range first, so a sequence with very many ids is spread over tasks and only its
    joined strings meet, which stream through one running digest.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, run, at = [], [], None
            for seq, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if seq != at or len(run) == _SEGMENT:
                    if run:
                        out.append((at, run[0], ",".join(map(str, run))))
                    at, run = seq, []
                run.append(conv)
            if run:
                out.append((at, run[0], ",".join(map(str, run))))
            types = (pa.string(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["seq", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, sha256()
        for batch in batches:
            out = []
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if seq != at:
                    if at is not None:
                        out.append((at, state.hexdigest()))
                    at, state = seq, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.record_batch([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], ["seq", "ends_sha256"])
        if at is not None:
            yield pa.record_batch([pa.array([at]), pa.array([state.hexdigest()])], ["seq", "ends_sha256"])

    ids = rows.select("seq", F.col("conv_id").cast("long").alias("conv_id"))
    ids = ids.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    segments = map_arrow(ids, join, "seq string, first long, ids string")
    segments = segments.repartition("seq").sortWithinPartitions("seq", "first")
    return map_arrow(segments, digest, "seq string, ends_sha256 string")


def burst(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Deal distinct sequences into containers of at most ``limit`` suffixes.

    Returns the containers (rows with ``head`` and ``depth``) and the burst heads, if any: ``head, path, depth, chars,
    seq, n_ends, first_id``, the last three for the sequence that ends at the head.
    """
    depth, containers, heads = 0, None, None
    open_rows = rows.withColumn("head", _key(F.lit(0))).withColumn("depth", F.lit(0))
    while True:
        sizes = open_rows.groupBy("head").agg(F.count("*").alias("n"))
        large = stored(sizes.where(F.col("n") > limit).select("head"), "large_containers")
        if large.isEmpty():
            return containers.unionByName(open_rows) if containers else open_rows, heads
        # A container may hold a third of all rows: its rows meet its name in shares.
        shares = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
        names = large.withColumn("salt", shares).withColumn("large", F.lit(True))
        salted = open_rows.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(_SALTS)).cast("int"))
        met = stored(salted.join(names, ["head", "salt"], "left").drop("salt"), "burst")
        settled = met.where("large IS NULL").drop("large")
        containers = containers.unionByName(settled) if containers else settled
        met = met.where("large").drop("large")
        here = F.size("path") == depth
        chars = F.element_at("chars", depth) if depth else F.lit(0)
        found = met.groupBy("head", "depth").agg(
            F.first(F.slice("path", 1, depth)).alias("path"),
            F.first(chars).alias("chars"),
            *(F.max(F.when(here, F.col(c))).alias(c) for c in ("seq", "n_ends", "first_id")),
        )
        found = stored(found, "heads")
        heads = heads.unionByName(found) if heads else found
        depth += 1
        met = met.where(F.size("path") >= depth)
        open_rows = met.withColumn("depth", F.lit(depth)).withColumn("head", _key(F.lit(depth)))


class _Node:
    __slots__ = ("children", "chars", "conv", "convs", "depth", "leaves", "pending", "saved", "seq")

    def __init__(self, depth: int, chars: int):
        self.depth, self.chars, self.conv, self.convs, self.seq = depth, chars, None, 0, None
        self.children = self.leaves = self.saved = 0
        self.pending: list[_Node] = []

    def meet(self, conv: int, convs: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.convs += convs

    def adopt(self, child: _Node) -> None:
        self.meet(child.conv, child.convs)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved
        self.pending.append(child)

    def close(self) -> Iterator[tuple]:
        """Complete the figures; the children's rows are ready, as their parent's smallest member is known."""
        self.leaves = self.leaves or 1
        self.saved += (self.convs - 1) * self.chars
        for child in self.pending:
            yield child.row(self.conv, None)
        self.pending = []

    def row(self, parent: int | None, top: list[str] | None) -> tuple:
        return (self.conv, self.depth, parent, self.convs, self.children, self.leaves, self.saved, self.seq, top)


_NODE_TYPES = (*[pa.int64()] * 7, pa.string(), pa.list_(pa.string()))
_NODE_NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "seq", "top")
_NODE_SCHEMA = "{} long, {} long, {} long, {} long, {} long, {} long, {} long, {} string, {} array<string>".format(*_NODE_NAMES)


def sweep(containers: DataFrame) -> DataFrame:
    """Nodes of all containers. ``top`` is the path of a container's first node, NULL for the nodes below it."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack: list[_Node] = []
        head, last = None, []

        def close_to(depth: int) -> None:
            while len(stack) > 1 and stack[-1].depth > depth:
                node = stack.pop()
                out.extend(node.close())
                stack[-1].adopt(node)

        def close_container() -> None:
            close_to(-1)
            if stack:
                top = stack.pop()
                out.extend(top.close())
                out.append(top.row(None, last[: top.depth]))

        def ready() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(_NODE_TYPES)], _NODE_NAMES)
            out.clear()
            return batch

        for batch in batches:
            for own, depth, path, chars, n_ends, conv, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != head:
                    close_container()
                    head, last = own, path[:depth]
                    stack.append(_Node(depth, chars[depth - 1] if depth else 0))
                common = depth
                while common < min(len(last), len(path)) and last[common] == path[common]:
                    common += 1
                close_to(common)
                for k in range(common, len(path)):
                    stack.append(_Node(k + 1, chars[k]))
                stack[-1].seq = seq
                stack[-1].meet(conv, n_ends)
                last = path
            if out:
                yield ready()
        close_container()
        yield ready()

    rows = containers.select("head", "depth", "path", "chars", "n_ends", "first_id", "seq")
    rows = rows.repartition("head").sortWithinPartitions("head", "path")
    return map_arrow(rows, nodes, _NODE_SCHEMA)


def _ancestors(depth: Column) -> Column:
    """Names of the nodes on ``path`` from the root down to ``depth``; none if it is negative."""
    places = F.when(depth >= 0, F.sequence(F.lit(0), depth)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: _key(k))


def _with_heads(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """The nodes of the containers and the burst heads, parents filled in.

    All that a head needs from below is a sum or a minimum over containers and heads, combined before it is shuffled.
    """
    depth, none = F.col("depth").cast("int"), F.lit(0).cast("long")
    tops = nodes.where("top IS NOT NULL").withColumnRenamed("top", "path")
    tops = tops.withColumn("above", _ancestors(depth - 1)).withColumn("parent", F.element_at("above", -1))
    figures = [F.col(c) for c in ("n_convs", "conv_id", "n_leaves", "saved_tokens")]
    below = tops.select(F.explode("above").alias("head"), *figures)
    ended = heads.where("n_ends > 0").select(
        F.explode(_ancestors(depth)).alias("head"),
        F.col("n_ends").alias("n_convs"),
        F.col("first_id").alias("conv_id"),
        none.alias("n_leaves"),
        none.alias("saved_tokens"),
    )
    sums = below.unionByName(ended).groupBy("head").agg(
        F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_below"),
    )
    parent = F.when(depth > 0, F.element_at(_ancestors(depth - 1), -1))
    heads = stored(heads.join(sums, "head").withColumn("parent", parent), "head_sums")
    own = heads.select(F.explode(_ancestors(depth)).alias("head"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
    own = own.groupBy("head").agg(F.sum("own").alias("own"))
    children = tops.select("parent").unionByName(heads.select("parent")).where("parent IS NOT NULL")
    children = children.groupBy(F.col("parent").alias("head")).agg(F.count("*").alias("n_children"))
    known = heads.select(F.col("head").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = list(_NODE_NAMES[:-1])
    heads = heads.join(own, "head").join(children, "head")
    heads = heads.withColumn("saved_tokens", F.col("saved_below") + F.col("own"))
    heads = heads.withColumn("depth", F.col("depth").cast("long")).join(known, "parent", "left").select(columns)
    tops = tops.drop("parent_conv_id").join(known, "parent", "left").select(columns)
    return nodes.where("top IS NULL").select(columns).unionByName(tops).unionByName(heads)


def trie(members: DataFrame, turns: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """A row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``members`` has the ids of all conversations, ``turns`` their ``conv_id, position, turn_id, chars``. The path of one
    conversation is one value, of some 36 bytes a turn.
    """
    rows = stored(sequences(members, turns), "sequences")
    distinct = rows.groupBy("seq").agg(
        F.first("path").alias("path"),
        F.first("chars").alias("chars"),
        F.count("*").alias("n_ends"),
        F.min("conv_id").alias("first_id"),
    )
    containers, heads = burst(stored(distinct, "distinct_sequences"), limit)
    nodes = stored(sweep(containers), "nodes")
    nodes = _with_heads(nodes, heads) if heads else nodes.drop("top")
    # Most nodes are passed only; they have no sequence and do not take part in the join.
    ending = nodes.where("seq IS NOT NULL").join(member_digests(rows), "seq").drop("seq")
    passed = nodes.where("seq IS NULL").drop("seq").withColumn("ends_sha256", F.sha2(F.lit(""), 256))
    return ending.unionByName(passed)


def shared_prefixes(conversations: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """The trie of all rebuilt conversations (see ``rebuild``).

    Defined results: NULL role and text are empty; a NULL turn comes first; turns of one number go by role and text,
    repeated rows are turns of their own. Rows without conv_id belong to no conversation and are left out. Empty input:
    no rows, not even the root. Columns other than conv_id, turn, role and text are not used.
    """
    members, turns = rebuild(stored(turn_rows(conversations), "turns"))
    return trie(members, turns, limit)
