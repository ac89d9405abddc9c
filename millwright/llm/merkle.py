"""Merkle manifest of a table: a digest per row, a tree of fan-out 8 per group, one root, and octopus multiproofs.

Every row is a leaf. Per group the leaves ascend by id; while more than one node remains, every 8 consecutive ones become
the hash of their digests. The group roots, in the order of the groups, make the upper tree in the same way.

A leaf partition is an aligned block of 8^4 consecutive leaves of one group. `missing` walks up from the leaves a partition
holds and names the least set of nodes it can't derive (the union over all its proofs, each node once); those are fetched
by one join with the node table, `expand` derives the shared interior, and each row's proof is cut out of it in the task.
Only digests travel, no text; a group of any size is spread over its blocks.

Defined cases. A null field is `-`; a null group is a group of its own and comes first. Rows with null ids come first in
their group, rows with equal ids are ordered by digest; rows alike in every field are leaves of their own, at neighbouring
places. A null id is never tampered. A text without A-Z stays the same under tampering, so it verifies. An empty table
gives no rows. Other columns are neither read nor returned, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

FANOUT = 8
LEVELS = 4
"""A leaf partition holds the leaves below one node of this level: 8^4 = 4096 rows of two digests."""
HEX = 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(fields: dict[str, Column]) -> Column:
    """Hex SHA-256 of the length-prefixed fields in the given order."""
    return F.sha2(F.concat(*[field(x) for x in fields.values()]).cast("binary"), 256)


# --- places -----------------------------------------------------------------------------------------------------------


def place(rows: DataFrame, name: str) -> DataFrame:
    """Rows (grp, id, leaf, ...) with `pos`, the gapless place in the group, and `n`, the size of the group.

    One range shuffle; the counts of (group, range) are scanned, the rows are not.
    """
    order = ["grp", "id", "leaf", "tie"]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = staged(ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()), f"{name}-leaves")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    runs = ranged.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("grp")
    runs = runs.select(
        "grp", "part", "first", F.sum("rows").over(whole).alias("n"),
        (F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"),
    )
    joined = ranged.join(staged(runs, f"{name}-runs"), ["grp", "part"])
    return joined.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


# --- multiproofs ------------------------------------------------------------------------------------------------------


def missing(indices: Iterable[int], size: int) -> list[tuple[int, int]]:
    """The least set of nodes (level, index) that `indices`, leaves of a tree of `size`, need for all their proofs."""
    found, level, known = [], 0, np.unique(np.fromiter(indices, np.int64))
    while size > 1:
        parents = np.unique(known // FANOUT)
        family = (parents[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        gaps = np.setdiff1d(family[family < size], known, assume_unique=True)
        found += [(level, int(i)) for i in gaps]
        known, size, level = parents, -(-size // FANOUT), level + 1
    return found


def expand(leaves: dict[int, bytes], fetched: dict[tuple[int, int], bytes], size: int) -> list[dict[int, bytes]]:
    """Per level the digests of each touched family in a row (by parent index); the last entry holds the root alone."""
    out, level, known = [], 0, leaves
    while size > 1:
        families = {}
        for parent in sorted({i // FANOUT for i in known}):
            at = range(parent * FANOUT, min(size, parent * FANOUT + FANOUT))
            families[parent] = b"".join(known[i] if i in known else fetched[level, i] for i in at)
        out.append(families)
        known, size, level = {i: sha(x) for i, x in families.items()}, -(-size // FANOUT), level + 1
    return [*out, known]


def others(family: bytes, index: int) -> bytes:
    at = index % FANOUT * HEX
    return family[:at] + family[at + HEX :]


def path(families: list[dict[int, bytes]], index: int) -> list[tuple[int, bytes]]:
    """Per level from the leaf to the root: the place in its family and the digests of the others."""
    out = []
    for level in families[:-1]:
        out.append((index % FANOUT, others(level[index // FANOUT], index)))
        index //= FANOUT
    return out


def fold(leaf: bytes, steps: Iterable[tuple[int, bytes]]) -> bytes:
    for at, rest in steps:
        leaf = sha(rest[: at * HEX] + leaf + rest[at * HEX :])
    return leaf


# --- trees ------------------------------------------------------------------------------------------------------------


def blocks_of(placed: DataFrame, levels: int) -> DataFrame:
    """One row per leaf partition: the node that its leaves give, and the coordinates that its proofs miss."""
    block = FANOUT**levels

    def top(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        at, size, level = first["pos"] // block, first["n"], 0
        wanted = [x for x in missing(table["pos"].to_pylist(), size) if x[0] >= levels]
        known = dict(zip(table["pos"].to_pylist(), (x.encode() for x in table["leaf"].to_pylist()), strict=True))
        while size > 1 and level < levels:
            families: dict[int, list[bytes]] = {}
            for i in sorted(known):
                families.setdefault(i // FANOUT, []).append(known[i])
            known, size, level = {i: sha(b"".join(x)) for i, x in families.items()}, -(-size // FANOUT), level + 1
        (digest,) = known.values()
        row = {"grp": first["grp"], "block": at, "level": level, "size": size, "digest": digest.decode()}
        row["wanted"] = [{"level": a, "idx": b} for a, b in wanted]
        return pa.Table.from_pylist([row], schema=pa.schema([
            ("grp", pa.string()), ("block", pa.int64()), ("level", pa.int32()), ("size", pa.int64()), ("digest", pa.string()),
            ("wanted", pa.list_(pa.struct([("level", pa.int32()), ("idx", pa.int64())]))),
        ]))

    grouped = placed.select("grp", "pos", "n", "leaf").groupBy("grp", F.floor(F.col("pos") / block).cast("long").alias("block"))
    return grouped.applyInArrow(
        top, "grp string, block long, level int, size long, digest string, wanted array<struct<level: int, idx: long>>"
    )


def upper_nodes(blocks: DataFrame, largest: int) -> DataFrame:
    """All nodes (grp, level, idx, size, digest) from the blocks' own up to each group's root; `size` counts the level."""
    level = blocks.select("grp", "level", F.col("block").alias("idx"), "size", "digest")
    nodes = level
    while largest > 1:
        family = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        level = (
            level.filter("size > 1").groupBy("grp", "level", "size", F.floor(F.col("idx") / FANOUT).cast("long").alias("up"))
            .agg(F.sha2(F.array_join(F.transform(family, lambda x: x["digest"]), "").cast("binary"), 256).alias("digest"))
            .select("grp", (F.col("level") + 1).alias("level"), F.col("up").alias("idx"),
                    F.ceil(F.col("size") / FANOUT).cast("long").alias("size"), "digest")
        )
        nodes, largest = nodes.unionByName(level), -(-largest // FANOUT)
    return nodes


def forest(placed: DataFrame, name: str, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The leaf partitions, each with the nodes it fetches once, and the node table of a set of trees."""
    blocks = staged(blocks_of(placed, levels), f"{name}-blocks")
    largest = blocks.agg(F.coalesce(F.max("size"), F.lit(1))).first()[0]
    nodes = staged(upper_nodes(blocks, largest), f"{name}-nodes")
    wanted = blocks.select("grp", "block", F.explode("wanted").alias("w")).select("grp", "block", "w.level", "w.idx")
    fetched = wanted.join(nodes.select("grp", "level", "idx", "digest"), ["grp", "level", "idx"])
    fetched = fetched.groupBy("grp", "block").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("fetched"))
    return blocks.select("grp", "block").join(fetched, ["grp", "block"], "left"), nodes


STEP = pa.struct([("at", pa.int32()), ("others", pa.string())])


def known_tree(leaves: pa.Table, part: pa.Table) -> tuple[list[int], list[dict[int, bytes]]]:
    """The places of a partition's leaves and the families on their paths, from its leaves and what it fetched."""
    places = leaves["pos"].to_pylist()
    known = dict(zip(places, (x.encode() for x in leaves["leaf"].to_pylist()), strict=True))
    fetched = {(x["level"], x["idx"]): x["digest"].encode() for x in part["fetched"].to_pylist()[0] or []}
    return places, expand(known, fetched, leaves["n"][0].as_py())


def paths(placed: DataFrame, parts: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Each leaf's id with its explicit proof and the root; meant for few leaves, such as the groups' roots."""
    block = FANOUT**levels
    schema = pa.schema([("id", pa.string()), ("steps", pa.list_(STEP)), ("root", pa.string())])

    def prove(leaves: pa.Table, part: pa.Table) -> pa.Table:
        places, families = known_tree(leaves, part)
        (root,) = families[-1].values()
        return pa.Table.from_pylist([
            {"id": i, "steps": [{"at": a, "others": o.decode()} for a, o in path(families, p)], "root": root.decode()}
            for i, p in zip(leaves["id"].to_pylist(), places, strict=True)
        ], schema=schema)

    left = placed.withColumn("block", F.floor(F.col("pos") / block).cast("long")).groupBy("grp", "block")
    return left.cogroup(parts.groupBy("grp", "block")).applyInArrow(
        prove, "id string, steps array<struct<at: int, others: string>>, root string"
    )


def manifest(
    docs: DataFrame, id: str = "doc_id", group: str = "lang", fields: list[str] | None = None, text: str = "text",
    levels: int = LEVELS,
) -> DataFrame:
    """Leaf, roots and proof digest of every row, and the root folded from its leaf after a third of the texts was tampered."""
    fields = fields or FIELDS
    columns = {x: F.col(x) for x in fields}
    tampered = F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 0
    leaf = row_digest(columns)
    lowered = row_digest(columns | {text: F.translate(text, UPPER, LOWER)})
    placed = place(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"), F.col(id).alias("id"),
        leaf.alias("leaf"), F.when(tampered, lowered).alias("other"),
    ), "merkle")
    parts, nodes = forest(placed, "merkle", levels)

    roots = place(nodes.filter("size = 1").select(
        F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("digest").alias("leaf"),
    ), "merkle-roots")
    upper = paths(roots, forest(roots, "merkle-roots", levels)[0], levels)
    upper = upper.join(roots.select("id", F.col("leaf").alias("subroot")), "id").withColumnRenamed("id", "grp")
    parts = parts.join(staged(upper, "merkle-upper"), "grp")

    block = FANOUT**levels
    kind = docs.schema[id].dataType.simpleString()

    def prove(leaves: pa.Table, part: pa.Table) -> pa.Table:
        places, families = known_tree(leaves, part)
        above = [(x["at"], x["others"].encode()) for x in part["steps"].to_pylist()[0] or []]
        tail = b"".join(x for _, x in above)
        shared: dict[int, list[tuple[int, bytes]]] = {}
        proof, folded = [], []
        for at, mine, other in zip(places, leaves["leaf"].to_pylist(), leaves["other"].to_pylist(), strict=True):
            if at // FANOUT not in shared:  # all but the lowest step is the same for a family
                shared[at // FANOUT] = path(families, at)[1:]
            low = [(at % FANOUT, others(families[0][at // FANOUT], at))] if len(families) > 1 else []
            steps = [*low, *shared[at // FANOUT]]
            proof.append(hashlib.sha256(b"".join(x for _, x in steps) + tail).hexdigest())
            folded.append(fold(fold((other or mine).encode(), steps), above).decode())
        rows = len(places)
        subroot, root = part["subroot"][0].as_py(), part["root"][0].as_py()
        return pa.table({
            "doc_id": leaves["id"], "leaf": leaves["leaf"], "subroot": [subroot] * rows, "root": [root] * rows,
            "proof_sha256": proof, "folded_root": folded, "verified": [x == root for x in folded],
        })

    left = placed.withColumn("block", F.floor(F.col("pos") / block).cast("long")).groupBy("grp", "block")
    out = left.cogroup(parts.groupBy("grp", "block")).applyInArrow(
        prove, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return out if id == "doc_id" else out.withColumnRenamed("doc_id", id)


ORACLE = """
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, CAST(doc_id AS VARCHAR) AS d,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')
      AS head, text
  FROM documents
), crc AS (
  SELECT *, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(d) + 1), lambda i: ascii(substr(d, i, 1))::BIGINT)),
    lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), range(8)),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS inverted
  FROM docs
), leaves AS (
  SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(inverted, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
  FROM crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n
  FROM leaves
), low(grp, level, idx, size, digest) AS (
  SELECT grp, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT grp, level + 1, idx // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE size > 1
  GROUP BY grp, level, idx // 8, size
), tops AS (
  SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM low WHERE size = 1
), high(level, idx, size, digest) AS (
  SELECT 0, pos, n, digest FROM tops
  UNION ALL
  SELECT level + 1, idx // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE size > 1
  GROUP BY level, idx // 8, size
), depth AS (SELECT grp, max(level) AS levels FROM low GROUP BY grp
), nodes AS (
  SELECT grp, level, idx, digest FROM low WHERE size > 1
  UNION ALL
  SELECT t.grp, d.levels + h.level, h.idx, h.digest FROM tops t JOIN depth d USING (grp) CROSS JOIN high h WHERE h.size > 1
), steps AS (
  SELECT p.grp, p.pos, s.level, CASE WHEN s.level < d.levels THEN p.pos // CAST(pow(8, s.level) AS BIGINT)
    ELSE t.pos // CAST(pow(8, s.level - d.levels) AS BIGINT) END AS idx
  FROM placed p JOIN depth d USING (grp) JOIN tops t USING (grp) JOIN (SELECT DISTINCT grp, level FROM nodes) s ON s.grp = p.grp
), proof AS (
  SELECT s.grp, s.pos, s.level, coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx < s.idx), '') AS before,
    coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx > s.idx), '') AS after
  FROM steps s JOIN nodes n ON n.grp = s.grp AND n.level = s.level AND n.idx // 8 = s.idx // 8 GROUP BY s.grp, s.pos, s.level, s.idx
), whole AS (
  SELECT grp, pos, string_agg(before || after, '' ORDER BY level) AS parts, list({'b': before, 'a': after} ORDER BY level) AS steps
  FROM proof GROUP BY grp, pos
), fold(grp, pos, k, digest, steps) AS (
  SELECT p.grp, p.pos, 0, coalesce(p.other, p.leaf), w.steps FROM placed p LEFT JOIN whole w USING (grp, pos)
  UNION ALL
  SELECT grp, pos, k + 1, sha256(steps[k + 1].b || digest || steps[k + 1].a), steps FROM fold WHERE k < coalesce(len(steps), 0)
)
SELECT p.doc_id, p.leaf, t.digest AS subroot, r.digest AS root, sha256(coalesce(w.parts, '')) AS proof_sha256,
  f.digest AS folded_root, f.digest = r.digest AS verified
FROM placed p JOIN tops t USING (grp) CROSS JOIN (SELECT digest FROM high WHERE size = 1) r
LEFT JOIN whole w ON w.grp = p.grp AND w.pos = p.pos
JOIN fold f ON f.grp = p.grp AND f.pos = p.pos AND f.k = coalesce(len(f.steps), 0)
"""
"""The same answers in DuckDB: CRC-32 bit by bit, both trees by recursion, proofs from siblings, the fold step by step."""
