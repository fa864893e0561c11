"""The prefix trie of conversations, with leaf counts and savings rolled up by pointer jumping.

A node is a distinct sequence of first turns. Its key is a digest: the exclusive or, over the places of the sequence,
of two 64-bit hashes of (place, SHA-256 of the turn). Prefix keys are therefore running exclusive ors, found in blocks
of 1024 places, and the parent's key is known in the row itself, so edges need no look at the turn before.

Subtree sums take a logarithmic number of rounds. In round k a node points to its ancestor 2^k levels up (by name: the
ancestor's smallest member and depth) and holds the sums of its descendants less than 2^k levels down; it sends these
to that ancestor and takes over the ancestor's own pointer. Each round is written to the shared folder.

Rows with a null conv_id belong to no conversation. Null roles and texts are empty. Turns are ordered by turn, null
first; equal turns by role and digest, and repeated rows count each. c % 5 isn't negative. No conversation: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, release
from .turns import digest, placed

#: Places in a block, and conv_ids in a piece of a node's list of members.
BLOCK, PIECE = 1024, 4096
#: Conversations that share their beginning with the first of a group, and the most turns they share.
FAMILY, HEADS = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, d1, d2, bytes: one row a turn, without its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), *digest(role, text), F.octet_length(text).cast("bigint").alias("bytes"))
    return placed(rows, "conv_id", ["turn", "role", "d1", "d2"]).select("conv_id", "pos", "d1", "d2", "bytes")


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows like turns of every rebuilt conversation with its length; conv_id, length of all, turnless ones too)."""
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    n = n.select("conv_id", "n", (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("first_id"), head_length(F.col("conv_id")).alias("h"))
    firsts = n.where("conv_id = first_id").select("first_id", F.col("n").alias("first_n"))
    shared = F.least("h", F.coalesce("first_n", F.lit(0)))
    plan = n.join(firsts, "first_id", "left").select("conv_id", "h", shared.alias("shared"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    plan = materialize(plan, "plan")
    heads = turns.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("pos") < HEADS - 1))
    heads = heads.withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(FAMILY)]))).withColumn("conv_id", F.col("conv_id") + F.col("k")).drop("k")
    rows = heads.withColumn("own", F.lit(False)).unionByName(turns.withColumn("own", F.lit(True))).where(F.col("own") == (F.col("pos") >= head_length(F.col("conv_id"))))
    pos = F.when(F.col("own"), F.col("pos") - F.col("h") + F.col("shared")).otherwise(F.col("pos"))
    rows = rows.join(plan, "conv_id").select("conv_id", pos.cast("bigint").alias("pos"), "d1", "d2", "bytes", "length")
    return rows, plan.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, key (a, b), parent key (pa, pb), bytes, ends: a row for each conversation and each of its prefixes."""
    place = [F.xxhash64("d1", "d2", "pos").alias("z1"), F.xxhash64("pos", "d2", "d1", F.lit(7)).alias("z2")]
    rows = rows.select("*", F.floor(F.col("pos") / BLOCK).alias("block"), *place)
    upto = Window.partitionBy("conv_id", "block").orderBy("pos")
    rows = rows.withColumns({"x1": F.expr("bit_xor(z1)").over(upto), "x2": F.expr("bit_xor(z2)").over(upto)})
    long = rows.where(F.col("length") > BLOCK).groupBy("conv_id", "block").agg(F.expr("bit_xor(z1)").alias("t1"), F.expr("bit_xor(z2)").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = long.select("conv_id", "block", F.expr("bit_xor(t1)").over(before).alias("c1"), F.expr("bit_xor(t2)").over(before).alias("c2")).where("c1 is not null")
    rows = rows.join(carried, ["conv_id", "block"], "left")
    key = [F.col(f"x{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0).cast("bigint"))) for k in (1, 2)]
    parent = [key[k].bitwiseXOR(F.col(f"z{k + 1}")) for k in range(2)]
    return rows.select("conv_id", (F.col("pos") + 1).alias("depth"), key[0].alias("a"), key[1].alias("b"), parent[0].alias("pa"), parent[1].alias("pb"), "bytes", (F.col("pos") + 1 == F.col("length")).alias("ends"))


def trie_nodes(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """a, b, conv_id, depth, parent_conv_id, n_convs, n_children, saved (the node's own): one row a node, the root included."""
    nodes = found.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.max("bytes").alias("bytes"))
    zero = F.lit(0).cast("bigint")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", zero.alias("depth"), *[F.lit(None).cast("bigint").alias(c) for c in ("pa", "pb")], zero.alias("bytes"))
    nodes = materialize(nodes.unionByName(root), "nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("depth > 0").join(parents, ["pa", "pb"]).unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    out = materialize(below.join(kids, ["a", "b"], "left").select("a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), saved.alias("saved")), "trie")
    release(nodes)
    return out


def rolled_up(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens: sums over subtrees, by pointer jumping in as many rounds as the greatest depth has binary digits. nodes: conv_id, depth, parent_conv_id, n_children, saved."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    state = nodes.select("conv_id", "depth", F.col("parent_conv_id").alias("up"), (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    step, old = 1, None
    while step <= deepest:
        sent = state.where(F.col("depth") >= step).groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        jumps = state.where(F.col("depth") >= step).select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("_next"))
        far = state.where(F.col("depth") >= 2 * step).join(jumps, ["up", "depth"]).drop("up").withColumnRenamed("_next", "up")
        near = state.where(F.col("depth") < 2 * step).withColumn("up", F.lit(None).cast("bigint"))
        both = far.unionByName(near).join(sent, ["conv_id", "depth"], "left")
        total = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
        state = materialize(both.select("conv_id", "depth", "up", total("n_leaves", "_l"), total("saved_tokens", "_s")), "round")
        if old is not None:
            release(old)
        old, step = state, 2 * step
    return state.select("conv_id", "depth", "n_leaves", "saved_tokens")


def list_digests(ends: DataFrame) -> DataFrame:
    """a, b, ends_sha256 from (a, b, conv_id): the hash of each key's conv_ids, ascending, comma-joined. Pieces of 4096 values are joined in parallel; a task then feeds them one by one to the hash, which holds no list."""
    piece = F.floor(F.col("conv_id") / PIECE).alias("piece")
    pieces = ends.groupBy("a", "b", piece).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for a, b, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if at == (a, b):
                    state.update(b",")
                else:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield packed(out)
        if at is not None:
            yield packed([(*at, state.hexdigest())])

    def packed(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["a", "b", "ends_sha256"])

    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "piece").select("a", "b", "ids").mapInArrow(run, "a bigint, b bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row a node of the trie of the rebuilt conversations. turns: conv_id, pos, d1, d2, bytes."""
    rows, lengths = rebuilt(turns)
    found = materialize(prefixes(rows), "prefixes")
    nodes = trie_nodes(found, lengths)
    zero = F.lit(0).cast("bigint")
    ends = found.where("ends").select("a", "b", "conv_id").unionByName(lengths.where("length = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    out = nodes.join(rolled_up(nodes), ["conv_id", "depth"]).join(list_digests(ends), ["a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(materialize(turn_rows(read_table(spark, sf_dir, "conversations")), "placed"))
