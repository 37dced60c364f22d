"""A Merkle manifest of a dataset: a leaf for each row, a tree for each group, a tree over the groups, and a proof for each row.

Leaves lie in key order within their group. FAN consecutive nodes become one of the level above, until one is left: the group's
root. Group roots, in the groups' order, are the leaves of the tree above, whose last node is the root of the dataset.

Rows are placed by ranges of (group, key), so a group of any size is spread over all tasks. BLOCK = FAN ** LEVELS consecutive
leaves of a group become one row, and a task reduces each to its top node. Blocks of blocks follow until at most TOP nodes are left
(65,536; about 4 MB with all levels above them). The driver builds the rest, and its tree is broadcast; tasks take each
block's remaining path from it, finish the proofs of the block's rows and fold them. Should there be more than TOP groups, their
roots are placed and reduced the same way.

Defined cases: a null field counts as `-`; a null key comes first; rows that repeat a key follow their leaves; a null group is a
group of its own, the first; a group of one row has its leaf as root; a single leaf in all is the root and its proof is empty; an
empty table gives an empty result; columns that aren't fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NARROW, Scratch, places, read, remainder

FAN, LEVELS, TOP = 16, 3, 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A field as it goes into a leaf: `-` if null, else its UTF-8 byte count, a colon and itself."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


# ---------------------------------------------------------------------------------------------- trees in a task


def _node(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def levels_of(nodes: list[bytes], fan: int, height: int | None = None) -> list[list[bytes]]:
    """nodes and the levels above them: height levels, or until one node is left."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([_node(below[i : i + fan]) for i in range(0, len(below), fan)])
    return out


def steps_of(levels: list[list[bytes]], i: int, fan: int) -> list[tuple[int, bytes]]:
    """From node i of the lowest level up: its place in its run, and the run's others."""
    out = []
    for level in levels[:-1]:
        a = i // fan * fan
        out.append((i - a, b"".join(level[a:i] + level[i + 1 : a + fan])))
        i //= fan
    return out


def folded(node: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that a node and the others of its runs give."""
    for at, others in steps:
        node = _node([others[: 32 * at], node, others[32 * at :]])
    return node


def _block_levels(nodes: list[bytes], block: int, fan: int, height: int) -> list[list[bytes]]:
    """A block's levels: all height of them, but a group's only block ends at its root."""
    alone = block == 0 and len(nodes) < fan**height
    return levels_of(nodes, fan, None if alone else height)


class Top:
    """What the driver builds: the upper part of each group's tree and the tree of the groups."""

    def __init__(self, nodes: list[tuple[int, int, bytes]], fan: int):
        groups: dict[int, list[bytes]] = {}
        for g, _, h in sorted(nodes):
            groups.setdefault(g, []).append(h)
        self.fan, self.order = fan, {g: i for i, g in enumerate(groups)}
        self.trees = {g: levels_of(v, fan) for g, v in groups.items()}
        self.over = levels_of([t[-1][0] for t in self.trees.values()], fan) if groups else [[]]

    def path(self, group: int, pos: int) -> tuple[list[tuple[int, bytes]], bytes, bytes]:
        """(steps, group's root, root)."""
        tree = self.trees[group]
        return steps_of(tree, pos, self.fan) + steps_of(self.over, self.order[group], self.fan), tree[-1][0], self.over[-1][0]


# ---------------------------------------------------------------------------------------------- blocks

STEPS = "array<struct<at: int, others: binary>>"


def _blocked(scratch: Scratch, nodes: DataFrame, size: int, *carried: str) -> DataFrame:
    """grp, block and its nodes (pos, hash and what is carried) in order; at most size of them meet."""
    of = nodes.groupBy("grp", F.floor(F.col("pos") / size).cast("long").alias("block"))
    return scratch.table(of.agg(F.sort_array(F.collect_list(F.struct("pos", "hash", *carried))).alias("nodes")), 0)


def _block_roots(scratch: Scratch, blocks: DataFrame, fan: int, height: int) -> DataFrame:
    """grp, pos, hash of each block's top node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [_block_levels([x.as_py() for x in nodes.values.field("hash")[nodes_at : nodes_at + n]], b, fan, height)[-1][0] for nodes, nodes_at, n, b in _rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), pa.array(tops, pa.binary())], ["grp", "pos", "hash"])

    return scratch.table(blocks.select("grp", "block", F.transform("nodes", lambda x: F.struct(x["hash"].alias("hash"))).alias("nodes")).mapInArrow(run, "grp long, pos long, hash binary"), NARROW)


def _rows(batch: pa.RecordBatch):
    """(list column, where a row's nodes begin in its values, how many, block) of each row."""
    nodes = batch.column("nodes")
    ends = nodes.offsets.to_numpy()
    for i, b in enumerate(batch.column("block").to_pylist()):
        yield nodes, int(ends[i]), int(ends[i + 1] - ends[i]), b


def _with_paths(scratch: Scratch, blocks: DataFrame, fan: int, height: int, top: int, regroup: bool = True) -> tuple[DataFrame, Top | None]:
    """(blocks, the driver's tree), or where more than top nodes are left (blocks with columns path, subroot, root, None)."""
    roots = _block_roots(scratch, blocks, fan, height)
    if roots.count() <= top:
        return blocks, Top([(r["grp"], r["pos"], bytes(r["hash"])) for r in roots.collect()], fan)
    if regroup and roots.where("pos > 0").isEmpty():  # groups are the many: their roots are one sequence
        placed = places(scratch, roots, [F.asc("grp")]).select(F.lit(0).cast("long").alias("grp"), (F.col("place") - 1).alias("pos"), "hash", F.col("grp").alias("was"))
        up = _paths(scratch, placed, fan, height, top, False).select(F.col("was").alias("grp"), F.lit(0).cast("long").alias("block"), "path", F.col("hash").alias("subroot"), "root")
    else:
        up = _paths(scratch, roots, fan, height, top, regroup).select("grp", F.col("pos").alias("block"), "path", "subroot", "root")
    return scratch.table(blocks.join(up, ["grp", "block"])), None


def _paths(scratch: Scratch, nodes: DataFrame, fan: int, height: int, top: int, regroup: bool) -> DataFrame:
    """nodes (grp, pos, hash, and was if it is there) with path, subroot and root."""
    extra = [c for c in ("was",) if c in nodes.columns]
    blocks, tree = _with_paths(scratch, _blocked(scratch, nodes, fan**height, *extra), fan, height, top, regroup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (nodes, a, n, b) in enumerate(_rows(batch)):
                part, g = nodes.values.slice(a, n).to_pylist(), batch.column("grp")[i].as_py()
                levels = _block_levels([x["hash"] for x in part], b, fan, height)
                up, subroot, root = _path_of(batch, i, tree, g, b)
                paths = [[{"at": at, "others": others} for at, others in steps_of(levels, k, fan) + up] for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * n, pa.int64()), *[pa.array([x[c] for x in part], t) for c, t in (("pos", pa.int64()), ("hash", pa.binary()), *[(c, pa.int64()) for c in extra])],
                     pa.array(paths, pa.list_(pa.struct([("at", pa.int32()), ("others", pa.binary())]))), pa.array([subroot] * n, pa.binary()), pa.array([root] * n, pa.binary())],
                    ["grp", "pos", "hash", *extra, "path", "subroot", "root"],
                )

    return blocks.mapInArrow(run, f"grp long, pos long, hash binary, {''.join(f'{c} long, ' for c in extra)}path {STEPS}, subroot binary, root binary")


def _path_of(batch: pa.RecordBatch, i: int, tree: Top | None, group: int, block: int):
    if tree is not None:
        return tree.path(group, block)
    return [(x["at"], x["others"]) for x in batch.column("path")[i].as_py()], batch.column("subroot")[i].as_py(), batch.column("root")[i].as_py()


# ---------------------------------------------------------------------------------------------- the manifest


def placed_in_groups(scratch: Scratch, rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with grp (a number that keeps the groups' order, null first) and pos (from 0) within the group.

    A group's first place is looked up by (range, group), so a large group is no hot key.
    """
    part = F.floor((F.col("place") - 1) / NARROW).cast("long")
    placed = scratch.table(places(scratch, rows, [F.asc_nulls_first(group), *[F.asc_nulls_first(c) for c in order]]).withColumn("_part", part), 0)
    heads = placed.groupBy("_part", F.col(group).alias("_g")).agg(F.min("place").alias("first"))
    heads = heads.withColumn("first", F.min("first").over(W.partitionBy("_g")))
    out = placed.join(heads, (placed["_part"] == heads["_part"]) & placed[group].eqNullSafe(heads["_g"])).drop(heads["_part"])
    return out.select(*rows.columns, F.col("first").alias("grp"), (F.col("place") - F.col("first")).alias("pos"))


def manifest(leaves: DataFrame, scratch: Scratch, group: str, key: str, proofs: bool = False, fan: int = FAN, height: int = LEVELS, top: int = TOP) -> DataFrame:
    """The manifest of leaves (key, group, hash, other: what the row's leaf is found to be now).

    Returns key, leaf, subroot, root, proof_sha256 (of all siblings' hex digests, from the leaf up), folded_root (from other and the
    siblings) and verified (whether it is the root), digests in lower-case hex; with proofs also proof, the steps themselves (at: the
    node's place in its run; others: its siblings' digests).
    """
    kind = dict(leaves.dtypes)[key]
    narrow = scratch.table(leaves.select(F.col(key).alias("key"), F.col(group).alias("g"), "hash", "other"), NARROW)
    placed = placed_in_groups(scratch, narrow, "g", ["key", "hash"])
    blocks, tree = _with_paths(scratch, _blocked(scratch, placed, fan**height, "key", "other"), fan, height, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps_type = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.binary())]))
        for batch in batches:
            for i, (nodes, a, n, b) in enumerate(_rows(batch)):
                part = nodes.values.slice(a, n)
                hashes, others = part.field("hash").to_pylist(), part.field("other").to_pylist()
                levels = _block_levels(hashes, b, fan, height)
                up, subroot, root = _path_of(batch, i, tree, batch.column("grp")[i].as_py(), b)
                end, out, kept = b"".join(o for _, o in up).hex().encode(), {c: [] for c in ("leaf", "proof_sha256", "folded_root")}, []
                for k in range(n):
                    steps = steps_of(levels, k, fan)
                    out["leaf"].append(hashes[k].hex())
                    out["proof_sha256"].append(hashlib.sha256(b"".join(o for _, o in steps).hex().encode() + end).hexdigest())
                    out["folded_root"].append(folded(others[k], steps + up).hex())
                    if proofs:
                        kept.append([{"at": at, "others": o} for at, o in steps + up])
                found = np.array(out["folded_root"]) == root.hex()
                arrays = [part.field("key"), pa.array(out["leaf"]), pa.array([subroot.hex()] * n), pa.array([root.hex()] * n), pa.array(out["proof_sha256"]), pa.array(out["folded_root"]), pa.array(found)]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(kept, steps_type)] if proofs else []), names)

    names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + (["proof"] if proofs else [])
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (f", proof {STEPS}" if proofs else "")
    return blocks.mapInArrow(run, schema).withColumnRenamed("key", key)


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of documents by source; where 5 divides the id's crc32, the text is checked with its A-Z in lower case."""
    docs = read(spark, sf_dir, "documents")
    text = F.col("text")
    tampered = F.when(remainder("doc_id", 5) == 0, F.translate(text, UPPER, LOWER)).otherwise(text)
    start = [F.col(c) for c in FIELDS[:-1]]
    original = leaf(*start, text)
    other = F.when(remainder("doc_id", 5) == 0, leaf(*start, tampered)).otherwise(original)
    return manifest(docs.select("doc_id", "source", original.alias("hash"), other.alias("other")), Scratch(spark), "source", "doc_id")


# ---------------------------------------------------------------------------------------------- the same in SQL


def _sql(group_levels: int = 7, over_levels: int = 5) -> str:
    """The query in SQL, a few steps for each level of the trees; crc32 goes byte by byte, from a table made by its rule."""
    part = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE octet_length(encode(CAST({v} AS VARCHAR))) || ':' || CAST({v} AS VARCHAR) END"
    start, text = " || ".join(part(c) for c in FIELDS[:-1]), f"CASE WHEN tampered THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    steps = [
        "poly AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b::BIGINT, [0::BIGINT for _ in range(8)]), lambda a, _x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(b)))",
        "d AS (SELECT documents.*, COALESCE(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda a, c: xor(t[(xor(a, c) & 255) + 1], a >> 8)), 4294967295) % 5 = 0, false) AS tampered FROM documents, poly)",
        f"x AS MATERIALIZED (SELECT doc_id, source, sha256({start} || {part('text')}) AS leaf, sha256({start} || {part('(' + text + ')')}) AS other FROM d)",
        "s0 AS MATERIALIZED (SELECT *, '' AS proof, other AS fold, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM x)",
        "g0 AS (SELECT source AS grp, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS m FROM s0)",
    ]

    def level(key: str, node: str, state: str, new: str) -> None:
        at = "[s.pos % 16 + 2:]"
        join = lambda v: f"array_to_string(hs[:s.pos % 16], '') || {v} || array_to_string(hs{at}, '')"
        steps.append(f"r{new} AS MATERIALIZED (SELECT grp, pos // 16 AS p, list(h ORDER BY pos) AS hs, any_value(m) AS m FROM {node} GROUP BY 1, 2)")
        steps.append(f"g{new} AS (SELECT grp, p AS pos, CASE WHEN m > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, count(*) OVER (PARTITION BY grp) AS m FROM r{new})")
        up = "CASE WHEN m > 1 THEN {} ELSE {} END"
        proof = up.format("s.proof || " + join("''"), "s.proof")
        fold = up.format(f"sha256({join('s.fold')})", "s.fold")
        kept = "" if key == "source" else "s.subroot, "
        steps.append(f"s{new} AS MATERIALIZED (SELECT s.doc_id, s.source, s.leaf, {kept}{proof} AS proof, {fold} AS fold, s.pos // 16 AS pos FROM {state} s JOIN r{new} r ON r.grp IS NOT DISTINCT FROM {'s.source' if key == 'source' else '0'} AND r.p = s.pos // 16)")

    for k in range(group_levels):
        level("source", f"g{k}", f"s{k}", str(k + 1))
    steps.append(f"q AS MATERIALIZED (SELECT grp AS source, h AS subroot, row_number() OVER (ORDER BY encode(grp) NULLS FIRST) - 1 AS pos FROM g{group_levels})")
    steps.append("go AS (SELECT 0 AS grp, pos, subroot AS h, count(*) OVER () AS m FROM q)")
    steps.append(f"so AS MATERIALIZED (SELECT s.doc_id, s.source, s.leaf, q.subroot, s.proof, s.fold, q.pos FROM s{group_levels} s JOIN q ON q.source IS NOT DISTINCT FROM s.source)")
    node, state = "go", "so"
    for k in range(over_levels):
        level("over", node, state, f"o{k}")
        node, state = f"go{k}", f"so{k}"
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM {state} s, {node} g"


SQL = _sql()
