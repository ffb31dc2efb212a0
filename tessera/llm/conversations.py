"""Prefix trie of conversations that are rebuilt from a base's head and their own rest.

A turn is an affine map x -> m x + c modulo 2^64 (m odd), both from hashes of its
role and text, and a sequence of turns is the composition of its maps: a monoid
whose elements (m, c) compose, and invert, in two multiplications. So every
original conversation is scanned once for its prefix products, and the
fingerprint of a rebuilt prefix is combined from them without rebuilding any
text: the base's product up to its head, then the quotient of two own products.

Members with the same depth and product form a node. Equality is verified, not
assumed: all members' last turns (references to stored turns) must have the same
content and the same product before it, so that by induction the whole prefixes
are equal, and contents of equal hashes must be equal texts. A collision repeats
the work with other hashes.

Sums over subtrees need no descent. A node is represented by its member with the
least hash of its id; the nodes of one representative are a stretch of its path,
and a path crosses about ln(n) stretches. What a stretch holds is added where it
leaves each stretch above it, and running sums along stretches give the subtrees.

Conversations are dealt by ranges of (id, turn), so a long one spans tasks and
its parts' products are composed; running sums go by blocks of depths; keys that
many rows look up are broadcast, of which there are few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import looked_up, stored

#: Turns or depths that one group of a join or running sum holds.
BLOCK = 4096
#: Ids of this many consecutive numbers are joined to one text.
IDS = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()

KEY = ["depth", "f1", "f2"]
RESULT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, ends_sha256 string")


# ---------------------------------------------------------------- the monoid

def inverse(m: np.ndarray) -> np.ndarray:
    """Inverses of odd numbers modulo 2^64 (Newton: each step doubles the right bits)."""
    x = m.copy()
    for _ in range(5):
        x *= np.uint64(2) - m * x
    return x


def compose(a, b):
    """First a, then b; elements are (m, c) pairs of uint64 arrays."""
    return b[0] * a[0], b[0] * a[1] + b[1]


def quotient(a, ab):
    """The b with ``compose(a, b) == ab``."""
    m = ab[0] * inverse(a[0])
    return m, ab[1] - m * a[1]


def running(m: np.ndarray, c: np.ndarray):
    """Products of all beginnings of a sequence of elements."""
    products = np.multiply.accumulate(m)
    return products, products * np.add.accumulate(c * inverse(products))


def _before(m: np.ndarray, c: np.ndarray):
    """Running products shifted by one place, from the identity."""
    return np.concatenate((np.ones(1, np.uint64), m[:-1])), np.concatenate((np.zeros(1, np.uint64), c[:-1]))


def _u(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _s(*arrays):
    return [pa.array(x.view(np.int64)) for x in arrays]


# ---------------------------------------------------------------- stored turns

def hashed(conversations: DataFrame, salt: int) -> DataFrame:
    """``(conv_id, turn, role, text, h1, h2)`` of the rows with a conv_id."""
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                             F.coalesce("text", F.lit("")).alias("text")).filter("conv_id IS NOT NULL")
    return t.select("*", F.xxhash64(F.lit(salt), "role", "text").alias("h1"), F.xxhash64("text", F.lit(salt), "role").alias("h2"))


def contents_differ(turns: DataFrame) -> bool:
    """Whether turns of equal hashes have different roles or texts."""
    contents = turns.groupBy("h1", "h2", "role", "text").agg(F.lit(1).alias("n"))
    return not contents.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


SCANNED = "m long, c long, m0 long, c0 long, h1 long, h2 long, bytes long"


def scanned(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, m, c, m0, c0, h1, h2, bytes)``: every turn's place from 1, the
    product of its conversation up to it (m, c) and before it (m0, c0)."""

    def local(batches):
        part, conv, pos, total = TaskContext.get().partitionId(), None, 0, (np.ones(1, np.uint64), np.zeros(1, np.uint64))
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ids = b.column(0).to_numpy()
            h1, h2 = _u(b.column(1)), _u(b.column(2))
            m, c = running(h1 | np.uint64(1), h2)
            new = np.concatenate(([ids[0] != conv], ids[1:] != ids[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: went on from the last batch
            m0, c0 = _before(m, c)
            cut = (np.where(first < 0, np.uint64(1), m0[first]), np.where(first < 0, np.uint64(0), c0[first]))
            own, before = quotient(cut, (m, c)), quotient(cut, (m0, c0))
            on = first < 0
            for x in (own, before):
                y = compose(total, (x[0][on], x[1][on]))
                x[0][on], x[1][on] = y
            place = np.where(on, pos + np.arange(n) + 1, np.arange(n) - first + 1)
            conv, pos, total = ids[-1], int(place[-1]), (own[0][-1:], own[1][-1:])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(place), *_s(*own, *before), b.column(1), b.column(2), b.column(3),
                 pa.array(np.full(n, part, np.int64))], names=names)

    schema = f"conv_id long, pos long, {SCANNED}, part long"
    names = [x.split()[0] for x in schema.split(", ")]
    # equal turns of a conversation differ by their row's number, so that they can be dealt out too
    numbers = turns.select("conv_id", "turn", "h1", "h2", F.octet_length("text").cast("long").alias("bytes"),
                           F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "h1", "h2", "row"]
    parts = stored(numbers.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "h1", "h2", "bytes").mapInArrow(local, schema), "trie-parts")

    # Conversations in several parts: at most two of them begin or end in a part.
    ends = parts.groupBy("conv_id", "part").agg(
        F.max("pos").alias("n"), F.max_by("m", "pos").alias("m"), F.max_by("c", "pos").alias("c"))
    several = ends.groupBy("conv_id").agg(F.count("*").alias("parts")).filter("parts > 1").select("conv_id")

    def carry(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        n, (m, c) = t.column("n").to_numpy(), _before(*running(_u(t.column("m")), _u(t.column("c"))))
        return pa.table([t.column("conv_id"), t.column("part"), pa.array(np.concatenate(([0], np.cumsum(n)[:-1]))), *_s(m, c)],
                        names=["conv_id", "part", "n_before", "mb", "cb"])

    carried = ends.join(several, "conv_id").groupBy("conv_id").applyInArrow(
        carry, "conv_id long, part long, n_before long, mb long, cb long")

    def whole(batches):
        for b in batches:
            mb, cb = _u(b.column("mb")), _u(b.column("cb"))
            own = compose((mb, cb), (_u(b.column("m")), _u(b.column("c"))))
            before = compose((mb, cb), (_u(b.column("m0")), _u(b.column("c0"))))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("pos"), *_s(*own, *before), *(b.column(x) for x in ("h1", "h2", "bytes"))],
                names=names[:-1])

    at_most = F.broadcast(stored(carried, "trie-carry"))  # two rows for each part
    joined = parts.join(at_most, ["conv_id", "part"], "left").select(
        "conv_id", (F.col("pos") + F.coalesce("n_before", F.lit(0))).alias("pos"), *[x.split()[0] for x in SCANNED.split(", ")],
        F.coalesce("mb", F.lit(1)).alias("mb"), F.coalesce("cb", F.lit(0)).alias("cb"))
    return stored(joined.mapInArrow(whole, f"conv_id long, pos long, {SCANNED}"), "trie-turns")


# ---------------------------------------------------------------- members

def rebuilt(turns: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], max_head: int):
    """The conversations and, per conversation and depth, the node it is a member of.

    Returns ``(conv_id, size)``, size being the rebuilt number of turns, and
    ``(conv_id, size, depth, f1, f2, p1, p2, h1, h2, bytes)``: the product of the
    prefix (f), of the one before it (p), and the last turn's hashes and bytes.
    """
    turn = F.struct("pos", "m", "c", "m0", "c0", "h1", "h2", "bytes")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(
        F.when(F.col("pos") <= max_head, turn))).alias("first"))  # at most max_head turns
    convs = stored(convs.withColumn("h", F.least(head(F.col("conv_id")).cast("long"), F.lit(max_head))), "trie-convs")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"))
    c = convs.withColumn("base", base(F.col("conv_id"))).join(bases, "base", "left")
    c = c.withColumn("base_first", F.coalesce("base_first", F.slice("first", 1, 0)))
    c = c.withColumn("taken", F.least("h", F.size("base_first")))
    c = c.withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    c = stored(c.select("conv_id", "n", "h", "taken", "size", F.slice("base_first", F.lit(1), F.col("taken").cast("int")).alias("head"),
                        F.when(F.col("h") > 0, F.try_element_at("first", F.col("h").cast("int"))).alias("skipped")), "trie-rebuilt")

    columns = ["f1", "f2", "p1", "p2", "h1", "h2", "bytes"]
    heads = c.select("conv_id", "size", F.explode("head").alias("t")).select(
        "conv_id", "size", F.col("t.pos").alias("depth"),
        *[F.col(f"t.{x}").alias(y) for x, y in zip(("m", "c", "m0", "c0", "h1", "h2", "bytes"), columns)])

    last = F.try_element_at("head", F.greatest(F.col("taken").cast("int"), F.lit(1)))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = c.filter("n > h").select(
        F.col("conv_id"), "size", "h", "taken",
        F.coalesce("skipped.m", one).alias("xm"), F.coalesce("skipped.c", zero).alias("xc"),
        F.coalesce(last["m"], one).alias("ym"), F.coalesce(last["c"], zero).alias("yc"),
        F.explode(F.sequence(F.expr(f"h div {BLOCK}"), F.expr(f"n div {BLOCK}"))).alias("block"))
    own = turns.withColumn("block", F.expr(f"pos div {BLOCK}")).join(tails, ["conv_id", "block"]).filter("pos > h")

    def combined(batches):
        for b in batches:
            x, y = ((_u(b.column(f"{k}m")), _u(b.column(f"{k}c"))) for k in "xy")
            f = compose(y, quotient(x, (_u(b.column("m")), _u(b.column("c")))))
            p = compose(y, quotient(x, (_u(b.column("m0")), _u(b.column("c0")))))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("size"), b.column("depth"), *_s(*f, *p), *(b.column(k) for k in ("h1", "h2", "bytes"))],
                names=["conv_id", "size", "depth", *columns])

    schema = "conv_id long, size long, depth long, f1 long, f2 long, p1 long, p2 long, h1 long, h2 long, bytes long"
    own = own.withColumn("depth", F.col("taken") + F.col("pos") - F.col("h")).drop("block", "n").mapInArrow(combined, schema)
    return c.select("conv_id", "size"), stored(heads.unionByName(own), "trie-members")


# ---------------------------------------------------------------- nodes

def _representative() -> Column:
    return F.min_by("conv_id", F.xxhash64("conv_id")).alias("rep")


def nodes_of(convs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node: KEY, the parent's product, representative, sizes, and whether
    all its members agree (``same``)."""
    turn = F.struct("p1", "p2", "h1", "h2")
    nodes = members.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), _representative(), F.max("bytes").alias("bytes"),
        F.min(turn).alias("t"), (F.min(turn) == F.max(turn)).alias("same"))
    nodes = nodes.select(*KEY, "t.p1", "t.p2", "n_convs", "conv_id", "rep", "bytes", "same")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), _representative()).filter("n_convs > 0")
    none = F.lit(None).cast("long")
    return nodes.unionByName(root.select(
        *[F.lit(x).cast("long").alias(k) for k, x in zip(KEY, (0, 1, 0))], none.alias("p1"), none.alias("p2"),
        "n_convs", "conv_id", "rep", F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("same")))


def end_digests(convs: DataFrame, members: DataFrame) -> DataFrame:
    """KEY, ``ends_sha256``: the digest of the ids of the conversations that end in each
    node that has some. Ids are joined in ranges before they meet; a node's digest
    is a stream over its ranges."""
    root = convs.filter("size = 0").select(*[F.lit(x).cast("long").alias(k) for k, x in zip(KEY, (0, 1, 0))], "conv_id")
    ends = members.filter("depth = size").select(*KEY, "conv_id").unionByName(root)
    ranges = ends.groupBy(*KEY, F.floor(F.col("conv_id") / IDS).alias("range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def digests(batches):
        key, digest = None, None

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), pa.array([digest.hexdigest()])],
                                              names=[*KEY, "ends_sha256"])

        for b in batches:
            for own, ids in zip(zip(*(b.column(i).to_pylist() for i in range(3))), b.column(3)):
                if own != key:
                    if key:
                        yield row()
                    key, digest = own, hashlib.sha256(ids.as_py().encode())
                else:
                    digest.update(b"," + ids.as_py().encode())
        if key:
            yield row()

    return ranges.repartition(*KEY).sortWithinPartitions(*KEY, "range").select(*KEY, "ids").mapInArrow(
        digests, "depth long, f1 long, f2 long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, members: DataFrame, convs: DataFrame) -> DataFrame:
    """``(rep, depth, n_leaves, saved_tokens)`` of every node, over its subtree."""
    leaf = (F.col("n_children") == 0).cast("long")
    own = nodes.select("rep", "depth", leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    stretch = own.groupBy(F.col("rep").alias("conv_id")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    above = looked_up(members.select("conv_id", *KEY), nodes.filter("depth > 0").select(*KEY, "rep", "n_convs"), KEY, "n_convs")
    top = nodes.filter("depth = 0").select("rep").first().rep
    above = above.select("conv_id", "rep", "depth").unionByName(
        convs.select("conv_id", F.lit(top).alias("rep"), F.lit(0).cast("long").alias("depth"))).filter("conv_id <> rep")
    leaves_at = above.groupBy("conv_id", "rep").agg(F.max("depth").alias("depth"))  # about ln(n) rows a conversation
    hung = leaves_at.join(stretch, "conv_id").groupBy("rep", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    x = own.unionByName(hung).groupBy("rep", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    x = stored(x.withColumn("block", F.expr(f"depth div {BLOCK}")), "trie-stretches")

    down = Window.partitionBy("rep", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("rep").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = x.groupBy("rep", "block").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    blocks = blocks.select("rep", "block", *[F.coalesce(F.sum(k).over(below), F.lit(0)).alias(f"{k}_below") for k in ("leaves", "saved")])
    within = x.select("rep", "depth", "block", *[F.sum(k).over(down).alias(k) for k in ("leaves", "saved")])
    return within.join(blocks, ["rep", "block"]).select(
        "rep", "depth", (F.col("leaves") + F.col("leaves_below")).alias("n_leaves"),
        (F.col("saved") + F.col("saved_below")).alias("saved_tokens"))


def trie(conversations: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], max_head: int) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, RESULT's columns.

    A conversation is rebuilt as the first ``head(conv_id)`` (0 to ``max_head``)
    turns of conversation ``base(conv_id)``, as many as there are, then its own
    turns after as many. Turns are ordered by ``turn``, null first; equal ones by
    the hashes of their contents, so repeated rows are repeated turns and the input's
    order doesn't matter. Null roles and texts are empty. Rows without a conv_id
    belong to no conversation. A conversation may end up without turns and is then a
    member of the root only. An empty table has no nodes. Only conv_id, turn, role
    and text are read, so further columns can't clash.
    """
    for salt in range(100):
        turns = hashed(conversations, salt)
        if contents_differ(turns):
            continue
        convs, members = rebuilt(scanned(turns), base, head, max_head)
        nodes = stored(nodes_of(convs, members), "trie-groups")
        if nodes.filter("NOT same").isEmpty():
            break
    else:
        raise RuntimeError("no hashes without a collision found")
    if nodes.isEmpty():
        return nodes.sparkSession.createDataFrame([], RESULT)

    # Nodes, their numbers of children and their digests meet by their key.
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(
        F.count("*").alias("n_children"))
    rows = nodes.drop("same").unionByName(children, allowMissingColumns=True).unionByName(
        end_digests(convs, members), allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in KEY]
    nodes = rows.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in rest])
    nodes = stored(nodes.fillna({"n_children": 0, "ends_sha256": EMPTY}), "trie-nodes")

    sums = subtree_sums(nodes, members, convs)
    parents = nodes.filter("n_children > 0").select(
        *[F.col(k).alias(f"up_{k}") for k in KEY], F.col("conv_id").alias("parent_conv_id"), "n_children")
    up = ["up_depth", "up_f1", "up_f2"]
    inner = nodes.filter("depth > 0").select("*", (F.col("depth") - 1).alias("up_depth"), F.col("p1").alias("up_f1"), F.col("p2").alias("up_f2"))
    above = looked_up(inner, parents.withColumnRenamed("n_children", "weight"), up, "weight")
    named = above.drop(*up).unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return named.join(sums, ["rep", "depth"]).select(*[c.split()[0] for c in RESULT.split(", ")])
