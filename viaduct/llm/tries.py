"""Conversation prefix trie by pointer jumping.

A node is a distinct sequence of first turns, named by its depth and a digest. Prefix digests are sums of digests of
(position, role, text), so a conversation cut into range segments gets them from segment sums and running sums inside
a segment, and no conversation has to fit one task. Nodes, parent edges and member counts come from one grouping by
digest that combines before the shuffle.

Leaf counts and savings reach all ancestors in logarithmic doubling rounds: after k rounds a node holds the sums of its
descendants fewer than 2^k levels below; in the next one every node adds what it holds to its ancestor 2^k levels up.
That pointer of double distance is read from the member rows of the node's first conversation, where (conversation,
depth) is unique: asking the node pointed to in place of this would make every popular ancestor a hot key.

Defined cases: rows with a null conversation id take no part; null role or text is empty; turns are ordered by turn
(null first), ties by role and text, and repeated rows are turns of their own. No conversation, no node. Digests hold
120 bits: n sequences meet with a probability of about n^2 / 2^121.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.llm.mixing import sizes
from viaduct.llm.shared import release, remainder, table

#: Ids in one piece of a node's list of conversations.
PIECE = 4_096
ROOT = (0, 0)


def _halves(text: Column) -> tuple[Column, Column]:
    """Two numbers of 60 bits of the text's SHA-256."""
    digest = F.sha2(text, 256)
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16))


def _name(depth: Column, a: Column, b: Column) -> tuple[Column, Column]:
    return _halves(F.concat_ws(":", depth.cast("string"), a.cast("string"), b.cast("string")))


def numbered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, convs), both written. turns: c, seg, depth from 1, length, t1, t2 (digest of role and text), words of the
    text; convs: c, length. seg is the range segment, of which a long conversation has several."""
    full = lambda name: F.coalesce(F.col(name), F.lit(""))
    t1, t2 = _halves(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    own = rows.select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), full(role).alias("role"), full(text).alias("text")).where("c IS NOT NULL")
    order = ["c", F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = own.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order, "salt").sortWithinPartitions(*order)
    listed = table(ranged.select("c", F.monotonically_increasing_id().alias("at"), t1.alias("t1"), t2.alias("t2"), sizes(F.col("text")).alias("words")).withColumn("seg", F.shiftright("at", 33)))
    segments = listed.groupBy("c", "seg").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("c").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("c")
    segments = segments.select("c", "seg", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("length"))
    turns = table(listed.join(segments, ["c", "seg"]).select("c", "seg", (F.col("at") + F.col("shift")).alias("depth"), "length", "t1", "t2", "words"))
    release(listed)
    return turns, table(turns.where("depth = 1").select("c", "length"))


def reopened(turns: DataFrame, convs: DataFrame, share: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) in which conversation c opens with the first h turns of conversation c - c % share (all if fewer,
    none if absent) and goes on with its own turns after its first h; h is the CRC-32 of c's decimal form modulo most."""
    plan = convs.select("c", "length", remainder(F.col("c"), most).alias("h"), (F.col("c") - F.col("c") % share).alias("base"))
    plan = plan.join(convs.select(F.col("c").alias("base"), F.col("length").alias("found")), "base", "left").withColumn("m", F.least("h", F.coalesce("found", F.lit(0))))
    plan = table(plan.select("c", "base", "h", "m", (F.greatest(F.col("length") - F.col("h"), F.lit(0)) + F.col("m")).alias("length")))
    segments = turns.select("c", "seg").distinct().join(plan, "c").drop("base")
    own = turns.drop("length").join(segments, ["c", "seg"]).where("depth > h").withColumn("depth", F.col("depth") - F.col("h") + F.col("m"))
    first = turns.where(F.col("depth") < most).select(F.col("c").alias("base"), "depth", "t1", "t2", "words")
    opening = plan.join(first, "base").where("depth <= m").withColumn("seg", F.lit(-1).cast("long"))
    columns = ["c", "seg", "depth", "length", "t1", "t2", "words"]
    return table(own.select(*columns).union(opening.select(*columns))), plan.select("c", "length")


def ends(found: DataFrame) -> DataFrame:
    """n1, n2, ends_sha256: of the ascending, comma-joined decimal ids c of each node's rows.

    Ids are sorted over range partitions and joined to pieces; a node's pieces are then hashed one after the other, as
    SHA-256 has to be, and no list is held whole."""
    schema = "n1 long, n2 long, at long, ids string"

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 33
        for pdf in batches:
            out = []
            for (n1, n2), ids in pdf.groupby(["n1", "n2"], sort=False)["c"]:
                for lo in range(0, len(ids), PIECE):
                    out.append((n1, n2, at, ",".join(map(str, ids.iloc[lo : lo + PIECE]))))
                    at += 1
            yield pd.DataFrame(out, columns=["n1", "n2", "at", "ids"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for pdf in batches:
            out = []
            for n1, n2, ids in zip(pdf["n1"], pdf["n2"], pdf["ids"], strict=True):
                if (n1, n2) != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (n1, n2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["n1", "n2", "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, sha.hexdigest())], columns=["n1", "n2", "ends_sha256"])

    order = ["n1", "n2", "c"]
    pieces = found.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(join, schema)
    return pieces.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "at").mapInPandas(digest, "n1 long, n2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. turns and convs as of numbered()."""
    a, b = _name(F.col("depth"), F.col("t1"), F.col("t2"))
    wide = lambda x: x.cast("decimal(20,0)")  # noqa: E731  sums of these can't overflow
    terms = turns.select("c", "seg", "depth", "words", (F.col("depth") == F.col("length")).alias("last"), wide(a).alias("a"), wide(b).alias("b"))
    before = Window.partitionBy("c").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    carried = terms.groupBy("c", "seg").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select("c", "seg", carry("a").alias("a0"), carry("b").alias("b0"))
    inside = Window.partitionBy("c", "seg").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = lambda x: F.col(f"{x}0") + F.coalesce(F.sum(x).over(inside), F.lit(0))
    summed = terms.join(carried, ["c", "seg"]).select("c", "depth", "words", "last", "a", "b", above("a").alias("pa"), above("b").alias("pb"))
    n1, n2 = _name(F.col("depth"), F.col("pa") + F.col("a"), F.col("pb") + F.col("b"))
    p1, p2 = (F.when(F.col("depth") > 1, p).otherwise(top) for p, top in zip(_name(F.col("depth") - 1, F.col("pa"), F.col("pb")), ROOT, strict=True))
    members = table(summed.select("c", "depth", "words", "last", n1.alias("n1"), n2.alias("n2"), p1.alias("p1"), p2.alias("p2")))

    first, n = convs.agg(F.min("c"), F.count("*")).first()
    least = [F.min(x).alias(x) for x in ("depth", "words", "p1", "p2")]
    nodes = members.groupBy("n1", "n2").agg(F.min("c").alias("conv_id"), *least, F.count("*").alias("n_convs"))
    root = convs.sparkSession.range(1 if n else 0).select(*[F.lit(x).cast("long").alias(y) for x, y in zip((*ROOT, first, 0, 0, None, None, n), nodes.columns, strict=True)])
    nodes = table(nodes.union(root))
    children = nodes.groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    told = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # a popular parent is a hot key of its children's rows only, which adaptive execution splits: the root isn't joined
    parents = nodes.where("depth > 1").join(told, ["p1", "p2"]).select("n1", "n2", "parent_conv_id")
    parents = table(parents.union(nodes.where("depth = 1").select("n1", "n2", F.lit(first).cast("long"))))

    held = nodes.join(children, ["n1", "n2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    held = table(held.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}))
    deepest, step = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        gains = ["n_leaves", "saved_tokens"]
        to_root = held.where(F.col("depth") == step).select(*[F.lit(x).cast("long").alias(y) for x, y in zip(ROOT, ("n1", "n2"), strict=True)], *gains)
        below = held.where(F.col("depth") > step)
        if step > 1:
            pointers = members.select(F.col("c").alias("conv_id"), (F.col("depth") + step).alias("depth"), F.col("n1").alias("u1"), F.col("n2").alias("u2"))
            up = below.select("conv_id", "depth", *gains).join(pointers, ["conv_id", "depth"]).select(F.col("u1").alias("n1"), F.col("u2").alias("n2"), *gains)
        else:
            up = below.select(F.col("p1").alias("n1"), F.col("p2").alias("n2"), *gains)
        gained = up.union(to_root).groupBy("n1", "n2").agg(*[F.sum(x).alias(f"more_{x}") for x in gains])
        old, held = held, held.join(gained, ["n1", "n2"], "left")
        held = table(held.select(*old.columns[:-2], *[(F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in gains]))
        release(old)
        step *= 2

    root_ends = convs.where("length = 0").select(*[F.lit(x).cast("long").alias(y) for x, y in zip(ROOT, ("n1", "n2"), strict=True)], "c")
    digests = ends(members.where("last").select("n1", "n2", "c").union(root_ends))
    out = held.join(parents, ["n1", "n2"], "left").join(digests, ["n1", "n2"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
