"""Merkle manifest of a dataset, with a proof for each row (operator 13).

Leaves of a group (a source) ascend by id; runs of three neighbours become their hash until one node,
the subroot, is left; subroots in order of their groups give the root in the same way.

A tree is cut into aligned blocks of 3**7 leaves. Blocks are reduced to their roots in parallel, these
form the next level's leaves, and so on, so a hot group is spread over tasks at every level. Proofs go
the other way: within a block a Merkle traversal walks from leaf to leaf, and what is above the block
is appended, shared by all of its leaves. The traversal keeps per level the current run and one stack
that hashes the nodes needed next; each step gives as many leaves to the stacks as there are levels,
always to the one with the lowest unfinished node, so that the stacks together hold logarithmically
many digests.

Defined results: leaves of equal id are ordered by digest, null ids come first, the null group comes
first; repeated rows are leaves of their own; a null field is written `-`; a group of one leaf has the
leaf as its subroot; proofs without siblings hash the empty string; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import numbered, written

#: Nodes of a run, and levels of a block.
ARITY, LEVELS = 3, 7
BLOCK = ARITY**LEVELS
PATH = "array<struct<left:string,right:string>>"
Step = tuple[str, str]


def digest_of(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def depth_of(n: int) -> int:
    """Levels above n leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Stack:
    """Hashes leaves, given from left to right, into the node of some height; holds at most two digests a level."""

    def __init__(self, height: int) -> None:
        self.height, self.open = height, [[] for _ in range(height + 1)]

    def push(self, digest: str, level: int = 0) -> int:
        """Returns the height up to which runs were closed."""
        while True:
            self.open[level].append(digest)
            if level == self.height or len(self.open[level]) < ARITY:
                return level
            digest, level = digest_of(self.open[level]), level + 1
            self.open[level - 1] = []

    def close(self) -> str:
        """The node over all leaves given, however few the last runs have."""
        for level in range(self.height):
            if self.open[level]:
                last, self.open[level] = self.open[level], []
                self.push(digest_of(last), level + 1)
        return self.open[self.height].pop()

    def low(self) -> int:
        return next((h for h, x in enumerate(self.open) if x), self.height)


class Ahead:
    """The second and third node of a run at some height, hashed leaf by leaf before they are needed."""

    def __init__(self, leaves: list[str], height: int, run: int) -> None:
        self.leaves, self.height, self.stack, self.found = leaves, height, Stack(height), {}
        self.todo = [m for m in (1, 2) if (run * ARITY + m) * ARITY**height < len(leaves)]
        self.first = run * ARITY
        self.at = (self.first + 1) * ARITY**height

    def advance(self) -> None:
        self.stack.push(self.leaves[self.at])
        self.at += 1
        if self.at == len(self.leaves) or self.at % ARITY**self.height == 0:
            self.found[self.todo.pop(0)] = self.stack.close()

    def finish(self) -> dict[int, str]:
        while self.todo:
            self.advance()
        return self.found


def authentication_paths(leaves: list[str], depth: int) -> Iterator[list[Step]]:
    """For each leaf, level by level, what stands left and right of its node in the run."""
    runs = [Ahead(leaves, h, 0).finish() for h in range(depth)]
    ahead = [Ahead(leaves, h, 1) for h in range(depth)]
    behind = Stack(depth)
    for i, leaf in enumerate(leaves):
        place = i
        path = []
        for run in runs:
            own = place % ARITY
            place //= ARITY
            path.append(("".join([run[m] for m in range(own)]), "".join([run[m] for m in range(own + 1, ARITY) if m in run])))
        yield path
        node, count = leaf, i + 1
        for h in range(depth):  # of nodes that end here the first ones of their runs are known from now on
            runs[h][(count - 1) % ARITY] = node
            closes = len(behind.open[h]) == ARITY - 1
            behind.open[h].append(node)
            if not closes:
                break
            node, count = digest_of(behind.open[h]), count // ARITY
            behind.open[h] = []
            runs[h] = ahead[h].finish()
            ahead[h] = Ahead(leaves, h, count + 1)
        for _ in range(depth):
            busy = [x for x in ahead if x.todo]
            if not busy:
                break
            min(busy, key=lambda x: x.stack.low()).advance()


def folded(digest: str, path: list[Step]) -> str:
    for left, right in path:
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def block_depth(n: int) -> int:
    return LEVELS if n > BLOCK else depth_of(n)


def block_leaves(rows: pa.Table) -> tuple[pa.Table, list[str], int]:
    rows = rows.sort_by("idx")
    return rows, rows.column("digest").to_pylist(), block_depth(rows.column("n")[0].as_py())


def reduce_block(key: tuple, rows: pa.Table) -> pa.Table:
    rows, leaves, depth = block_leaves(rows)
    stack = Stack(depth)
    for leaf in leaves:
        stack.push(leaf)
    return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()), "idx": pa.array([key[1].as_py()], pa.int64()), "digest": [stack.close()], "n": pa.array([-(-rows.column("n")[0].as_py() // BLOCK)], pa.int64())})


def upper_path(above: pa.Table) -> list[Step]:
    return [(x["left"], x["right"]) for x in above.column("path")[0].as_py()]


def extend_paths(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
    """Paths of a block's nodes up to the top of all."""
    rows, leaves, depth = block_leaves(rows)
    upper = upper_path(above)
    paths = [[{"left": a, "right": b} for a, b in [*path, *upper]] for path in authentication_paths(leaves, depth)]
    return rows.select(["tree", "idx"]).append_column("path", pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))))


def prove_block(with_path: bool):
    def run(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, leaves, depth = block_leaves(rows)
        upper, subroot, root = upper_path(above), above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
        above_text = "".join([a + b for a, b in upper])
        proof, back, paths = [], [], []
        for leaf, changed, path in zip(leaves, rows.column("changed").to_pylist(), authentication_paths(leaves, depth), strict=True):
            proof.append(digest_of([a + b for a, b in path] + [above_text]))
            back.append(folded(folded(leaf if changed is None else changed, path), upper))
            if with_path:
                paths.append([{"left": a, "right": b} for a, b in [*path, *upper]])
        made = {"id": rows.column("id"), "leaf": rows.column("digest"), "subroot": [subroot] * len(leaves), "root": [root] * len(leaves), "proof_sha256": proof, "folded_root": back, "verified": [x == root for x in back]}
        if with_path:
            made["path"] = pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        return pa.table(made)

    return run


NODE = "tree long, idx long, digest string, n long"


def blocks(nodes: DataFrame):
    return nodes.withColumn("block", F.floor(F.col("idx") / BLOCK)).groupBy("tree", "block")


def climbed(leaves: DataFrame) -> list[DataFrame]:
    """Nodes (tree, idx, digest, n) of every level of blocks; the last one has one node for each tree. n: nodes of the tree at that level."""
    levels = [leaves.select("tree", "idx", "digest", "n")]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        levels.append(written(blocks(levels[-1]).applyInArrow(reduce_block, NODE), "nodes"))
    return levels


def descended(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths (tree, idx, path) of the nodes of the lowest of these levels; above: those of the last level's."""
    for nodes in reversed(levels[:-1]):
        above = written(blocks(nodes).cogroup(above.withColumnRenamed("idx", "block").groupBy("tree", "block")).applyInArrow(extend_paths, f"tree long, idx long, path {PATH}"), "paths")
    return above


def leaf_digest(columns: list[str | Column]) -> Column:
    """SHA-256 of the fields' UTF-8 byte counts and values; a null field is `-`."""
    texts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def merkle_manifest(leaves: DataFrame, id_col: str = "id", group_col: str = "group", leaf_col: str = "leaf", changed_col: str | None = None, with_path: bool = False) -> DataFrame:
    """Rows (id, leaf, subroot, root, proof_sha256, folded_root, verified, and path if asked for).

    proof_sha256 is of the siblings from the leaf up; folded_root is made from the changed leaf (where
    there is one, else the leaf) and the original siblings, and verified says whether it is the root.
    """
    changed = F.col(changed_col) if changed_col else F.lit(None).cast("string")
    rows = leaves.select(F.col(id_col).alias("id"), F.col(group_col).alias("source"), F.col(leaf_col).alias("digest"), changed.alias("changed"))
    rows = numbered(rows, ["source", "id", "digest"], "leaves")
    sources = numbered(rows.groupBy("source").agg(F.min("number").alias("first"), F.count("*").alias("n")), ["source"], "sources")
    sources = sources.withColumnRenamed("number", "tree")
    placed = rows.join(sources.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
    placed = written(placed.select("id", "digest", "changed", "tree", (F.col("number") - F.col("first")).alias("idx"), "n"), "placed")

    levels = climbed(placed)
    subroots = levels[-1].select("tree", F.col("digest").alias("subroot"))
    top = climbed(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"), F.lit(sources.count()).cast("long").alias("n")))
    root = top[-1].select(F.col("digest").alias("root"))  # one row
    start = top[-1].select("tree", "idx", F.array().cast(PATH).alias("path"))
    shared = descended(top, start).select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("idx"), "path")
    uppers = descended(levels[1:], shared) if len(levels) > 1 else shared
    uppers = uppers.join(subroots, "tree").withColumn("root", F.lit((root.first() or [None])[0])).withColumnRenamed("idx", "block")
    kind = leaves.schema[id_col].dataType.simpleString()
    out = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", path {PATH}" * with_path
    return blocks(placed).cogroup(uppers.groupBy("tree", "block")).applyInArrow(prove_block(with_path), out)
