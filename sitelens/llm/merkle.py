"""Merkle manifest of a dataset, with copied hash states before each child.

A row's leaf is the sha256 of its columns. Per group, in order, every ARITY consecutive nodes become one by the hash of their hex
digests, level by level, until one node remains; the groups' last nodes, in the groups' order, make the upper tree in the same way.

A parent's hash is fed child by child, and before each child a copy of its state is kept. Replacing a child resumes the copy made before
its slot with the new digest and the siblings to its right, so what lies to the left is never hashed again.

Rows are hashed where they are scanned; leaves of 32 bytes are sorted by range, and a node's place is its row in a range and the
counts of the ranges before it. A block of ARITY ** DEPTH consecutive nodes is one task's, which takes it DEPTH levels up, so a table
of n rows needs log n / log 4096 rounds, each over 4096 times fewer rows. Going down again, each block learns the siblings on its path to
the root; then the blocks of leaves are rebuilt with their states and every row's changed leaf is folded up to the root.

Nulls are `-` in a leaf. Groups ascend bytewise, the null group first; rows ascend by id, null ids first, then by leaf, so rows that repeat an
id have a defined place and equal rows are leaves of their own. Texts are hashed whole. A row with a null id isn't tampered with. An
empty table has no rows, and no root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_groups, written

ARITY = 8
DEPTH = 4
BLOCK = ARITY**DEPTH
ROWS_A_RANGE = 1_000_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


# ---------------------------------------------------------------- hashes


def leaf(docs: DataFrame, columns=COLUMNS, **instead: Column) -> Column:
    """The sha256 (hex) of a row's columns, each `-` or its UTF-8 length, a colon and its value."""
    values = [instead.get(c, F.col(c)).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]), 256)


def lower_cased(text: Column) -> Column:
    """text with a-z for A-Z and all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Parent:
    """A node over some children: its digest, and the hash state before each child's slot."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[str]):
        state, self.children, self.states = hashlib.sha256(), children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def replaced(self, slot: int, digest: str) -> str:
        """The digest with another child in a slot: the state before it, the child, and what is to its right."""
        state = self.states[slot].copy()
        state.update(digest.encode())
        state.update("".join(self.children[slot + 1 :]).encode())
        return state.hexdigest()


def levels(nodes: list[str], depth: int) -> list[list[Parent]]:
    """The parents of each level above some nodes."""
    out = []
    for _ in range(depth):
        out.append([Parent(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)])
        nodes = [p.digest for p in out[-1]]
    return out


def depth_of(n: int) -> int:
    """Levels until n nodes are one."""
    depth = 0
    while n > 1:
        n, depth = -(-n // ARITY), depth + 1
    return depth


# ---------------------------------------------------------------- places


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos, each row's place in its group from 0, and n, how many the group has. Written twice; nothing is sorted in one task.

    What order leaves open is settled by a number of the row's own, so equal rows are spread over ranges like others.
    """
    own = written(rows.withColumn("_own", F.monotonically_increasing_id()), "merkle-rows")
    total = own.count()
    ranges = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-total // BLOCK)), -(-total // ROWS_A_RANGE))
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_own")]
    dealt = own.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()), "merkle-sorted")
    runs = dealt.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row a range, and one a group
    of_group = Window.partitionBy(group)
    upto = of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).withColumn("n", F.sum("_n").over(of_group)), "merkle-runs")
    runs = runs.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_first", "_before", "n")
    few = runs.count() <= 100_000
    found = dealt.join(F.broadcast(runs) if few else runs.hint("merge"), (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return found.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).select(*rows.columns, "pos", "n")


# ---------------------------------------------------------------- up


def _dealt(rows: DataFrame, *more: Column) -> DataFrame:
    """Rows with gid, block and pos, whole blocks to a task, in order."""
    return rows.repartition("gid", "block").sortWithinPartitions("gid", "block", *more, "pos")


def _up(nodes: DataFrame) -> DataFrame:
    """gid, pos, n, digest: the nodes up to DEPTH levels above, a block each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["gid", "block"]):
            gid, block, n, digest = (t.column(c).to_pylist() for c in ("gid", "block", "n", "digest"))
            rows = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                up = levels([d.hex() for d in digest[s:e]], min(DEPTH, depth_of(n[s])))
                rows.append((gid[s], block[s], -(-n[s] // BLOCK), bytes.fromhex(up[-1][0].digest) if up else digest[s]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["gid", "pos", "n", "digest"])

    with_block = nodes.select("gid", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", "digest")
    return _dealt(with_block).mapInArrow(build, "gid long, pos long, n long, digest binary")


def raised(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Tables of nodes (gid, pos, n, digest), each a round above the one before, until every group is one node."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(written(_up(out[-1]), name))
    return out


# ---------------------------------------------------------------- down


def _steps(up: list[list[Parent]], at: int) -> list[dict]:
    """A node's siblings on the left and the right, level by level."""
    out = []
    for parents in up:
        at, slot = divmod(at, ARITY)
        out.append({"left": "".join(parents[at].children[:slot]), "right": "".join(parents[at].children[slot + 1 :])})
    return out


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """gid, pos, path: of each node, its siblings on the way to the root; above has the path of each block (gid, pos, path)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["gid", "block"]):
            gid, pos, n, digest, path = (t.column(c).to_pylist() for c in ("gid", "pos", "n", "digest", "path"))
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                up = levels([d.hex() for d in digest[s + 1 : e]], min(DEPTH, depth_of(n[s + 1])))
                for i in range(0, e - s - 1, 1024):
                    part = range(i, min(i + 1024, e - s - 1))
                    yield pa.RecordBatch.from_arrays([pa.array([gid[s]] * len(part), pa.int64()), pa.array([pos[s + 1 + k] for k in part], pa.int64()), pa.array([_steps(up, k) + path[s] for k in part], t.schema.field("path").type)], ["gid", "pos", "path"])

    return _dealt(_met(nodes, above, ["digest"]), F.col("pos").isNotNull()).mapInArrow(spread, f"gid long, pos long, path {PATH}")


def _met(nodes: DataFrame, above: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes by block, and as first row of each block (pos null) its path."""
    rows = nodes.select("gid", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", *columns)
    return rows.unionByName(above.select("gid", F.col("pos").alias("block"), "path"), allowMissingColumns=True)


# ---------------------------------------------------------------- manifest


@dataclass
class Manifest:
    """leaves: the rows given, with gid, pos, n and digest. groups: group, gid, subroot, path (from the subroot to the root). root: hex, None of no rows."""

    leaves: DataFrame
    rounds: list[DataFrame]
    groups: DataFrame
    root: str | None


def manifest(leaves: DataFrame, group: str, order: list[str]) -> Manifest:
    """The tree over rows that have their leaf's 32 bytes in `digest`."""
    ranked = placed(leaves, group, [*order, "digest"])
    lots = placed(ranked.select(group).distinct().withColumn("_one", F.lit(0)), "_one", [group])
    gids = written(lots.select(F.col(group).alias("_g"), F.col("pos").alias("gid")), "merkle-groups")
    few = gids.count() <= 100_000
    rows = written(ranked.join(F.broadcast(gids) if few else gids.hint("merge"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g"), "merkle-leaves")
    rounds = raised(rows.select("gid", "pos", "n", "digest"), "merkle-nodes")
    tops = rounds[-1].select("gid", "digest")
    upper = raised(tops.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("pos"), F.lit(gids.count()).cast("long").alias("n"), "digest"), "merkle-upper")
    top = upper[-1].select("digest").head()
    path = upper[-1].select("gid", "pos", F.array().cast(PATH).alias("path"))
    for nodes in reversed(upper[:-1]):
        path = written(_down(nodes, path), "merkle-paths")
    groups = tops.join(gids, "gid").join(path.select(F.col("pos").alias("gid"), "path"), "gid")
    return Manifest(rows, rounds, written(groups.select(F.col("_g").alias(group), "gid", F.lower(F.hex("digest")).alias("subroot"), "path"), "merkle-subroots"), top and bytes(top[0]).hex())


def folded(m: Manifest, key: str, changed: str) -> DataFrame:
    """key, digest, gid, proof_sha256, folded_root of every leaf: its root with the 32 bytes of `changed`, or the leaf's own if that is null.

    proof_sha256 is of its siblings' digests, level by level up to the root, left to right.
    """
    path = m.groups.select("gid", F.lit(0).cast("long").alias("pos"), "path")
    for nodes in reversed(m.rounds[1:-1]):
        path = written(_down(nodes, path), "merkle-paths")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["gid", "block"]):
            gid, n, digest, other, above, ids = (t.column(c).to_pylist() for c in ("gid", "n", "digest", "changed", "path", "key"))
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                own = [d.hex() for d in digest[s + 1 : e]]
                up = levels(own, min(DEPTH, depth_of(n[s + 1])))
                upper = [(hashlib.sha256(x["left"].encode()), x["right"].encode()) for x in above[s]]  # states before the block's slot
                rest = "".join(x["left"] + x["right"] for x in above[s]).encode()
                roots, proofs = [], []
                for k, leaf_ in enumerate(own):
                    node, at, proof = other[s + 1 + k].hex() if other[s + 1 + k] is not None else leaf_, k, hashlib.sha256()
                    for parents in up:
                        at, slot = divmod(at, ARITY)
                        parent = parents[at]
                        node = parent.replaced(slot, node)
                        proof.update("".join(parent.children[:slot] + parent.children[slot + 1 :]).encode())
                    for state, right in upper:
                        state = state.copy()
                        state.update(node.encode() + right)
                        node = state.hexdigest()
                    proof.update(rest)
                    roots.append(node)
                    proofs.append(proof.hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(ids[s + 1 : e], pa.int64()), pa.array(own), pa.array([gid[s]] * len(own), pa.int64()), pa.array(proofs), pa.array(roots)], ["key", "leaf", "gid", "proof_sha256", "folded_root"])

    rows = m.leaves.withColumns({"key": F.col(key), "changed": F.col(changed)})
    out = _dealt(_met(rows, path, ["digest", "key", "changed"]), F.col("pos").isNotNull()).mapInArrow(fold, "key long, leaf string, gid long, proof_sha256 string, folded_root string")
    return out.withColumnRenamed("key", key)


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each document, folded from a lower-cased text where 3 divides the id's crc32."""
    touched = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    leaves = docs.select(
        F.col("lang").cast("string").alias("lang"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(leaf(docs)).alias("digest"),
        F.when(touched, F.unhex(leaf(docs, text=lower_cased(F.col("text"))))).alias("changed"),
    )
    m = manifest(leaves, "lang", ["doc_id"])
    found = folded(m, "doc_id", "changed")
    subroots = m.groups.select("gid", "subroot")
    few = subroots.count() <= 100_000
    found = found.join(F.broadcast(subroots) if few else subroots.hint("merge"), "gid").withColumn("root", F.lit(m.root).cast("string"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
