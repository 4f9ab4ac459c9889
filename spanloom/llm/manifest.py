"""Merkle manifest of a dataset: a tree of digests for each source, one over the sources, and a proof for every row.

Every row is a leaf: ``H`` of its columns. Per source the leaves ascend by id; while several nodes remain, each ``RUN``
consecutive ones become their ``H``; what remains is the source's subroot. The subroots, by source, give the root likewise.
``H`` is the lowercase hex SHA-256 of its inputs joined, digests as hex text.

A tree is built in blocks of ``BLOCK`` aligned nodes, a power of ``RUN``, so that a block's subtree is part of the whole tree:

1. ``placed`` numbers the nodes of each tree: rows are dealt by ranges of (tree, order) and written; a node's place is its place
   in its file plus the counts of the files before, which are one row for each file and tree.
2. A block is one row. ``_unwind`` walks its subtree in postorder: a call returns the digest of its subtree, and on the way back
   up each call appends to the leaves below it the siblings that they met there.
3. The blocks' roots are the nodes of another such tree, in blocks again, until each tree has one block left. So a source with
   any share of the rows is many tasks, no task holds more than ``BLOCK`` nodes, and the rounds grow with the logarithm (base
   ``BLOCK``) of the largest source.
4. Paths come back the same way: a block meets the path of its root in a join, and continues those of its leaves with it.

Proofs have up to ``RUN - 1`` siblings a level, so they are made at the end, a block at a time, and only their digest is kept;
``paths`` gives them whole.

Defined results: null columns count as ``-``; a null source is a source of its own, before all others; null ids come first,
rows of the same id by their leaves, so repeated rows are neighbours and each has its own leaf and proof; a row without id is
never tampered with; an empty table gives no rows. Columns beyond the five of a leaf are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.llm.common import in_arrow, table
from spanloom.plans.scratch import materialise, release

#: Nodes that become one, and nodes of a block: RUN to the power LEVELS.
RUN, LEVELS = 16, 2
BLOCK = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Blocks that a task unfolds at once.
AT_ONCE = 16
#: One in so many ids is tampered with, by crc32.
TAMPERED = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A level of a path: digests of the siblings before and after.
PATH = "array<struct<before: string, after: string>>"
Path = list[tuple[str, str]]


def leaf(columns: dict[str, Column] | None = None) -> Column:
    """Digest of a row: each of ``FIELDS`` as its UTF-8 length, a colon and its value, or as a hyphen where it's null."""
    parts = []
    for name in FIELDS:
        value = (columns or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(documents: DataFrame) -> DataFrame:
    """tree, doc_id, leaf and tampered leaf (null where the row is as it was) of every row."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    touched = F.when(chosen, leaf({"text": F.translate("text", UPPER, LOWER)}))
    own = leaf()
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return documents.select(tree.alias("tree"), "doc_id", own.alias("digest"), F.when(touched != own, touched).alias("tampered"))


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with ``place`` in their tree (from 0, ascending by ``order``) and ``size``, the nodes of the tree."""
    sorted_rows = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = materialise(sorted_rows.select("*", F.spark_partition_id().alias("__file"), F.monotonically_increasing_id().alias("__row")), "nodes")
    # One row for each file and tree: a tree's window holds no more rows than there are files.
    parts = rows.groupBy("tree", "__file").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    w = Window.partitionBy("tree")
    before = F.sum("__n").over(w.orderBy("__file").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    parts = parts.select("tree", "__file", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(w).alias("size"))
    return rows.join(parts, ["tree", "__file"]).withColumn("place", F.col("__row") + F.col("__shift")).drop("__file", "__row", "__shift")


def blocks(nodes: DataFrame, *kept: str) -> DataFrame:
    """A row for each block of placed nodes: tree, block, size of the tree, and its nodes in order, with ``kept``."""
    block = F.expr(f"place div {BLOCK}").alias("block")
    return nodes.groupBy("tree", block, "size").agg(F.sort_array(F.collect_list(F.struct("place", "digest", *kept))).alias("nodes"))  # BLOCK nodes at most


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height_of(size: int) -> int:
    """Levels of a block's subtree, by the nodes of its tree: all LEVELS, or in a tree of one block as many as leave one node."""
    height = 0
    while height < LEVELS and size > 1:
        size, height = -(-size // RUN), height + 1
    return height


def _unwind(nodes: list[str], low: int, height: int, paths: list[Path] | None) -> str:
    """Root of the subtree of this height over ``nodes`` from ``low``; siblings are appended to the paths of the leaves below."""
    if height == 0:
        return nodes[low]
    width = RUN ** (height - 1)
    high = min(low + RUN * width, len(nodes))
    children = [_unwind(nodes, at, height - 1, paths) for at in range(low, high, width)]
    if paths is not None:
        for i, at in enumerate(range(low, high, width)):
            level = "".join(children[:i]), "".join(children[i + 1 :])
            for below in range(at, min(at + width, high)):
                paths[below].append(level)
    return digest_of(children)


def _each_block(own: DataFrame, f: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``f`` gives for each row of ``own``."""
    types = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                rows = [out for r in batch.slice(low, AT_ONCE).to_pylist() for out in f(r)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    return in_arrow(own, run, schema)


def _root(r: dict) -> list[tuple]:
    return [(r["tree"], r["block"], -(-r["size"] // BLOCK), _unwind(r["nodes"], 0, height_of(r["size"]), None))]


def _block_paths(r: dict) -> list[Path]:
    """The path of each node of a block that has met the path of its root."""
    nodes = [n["digest"] for n in r["nodes"]]
    paths: list[Path] = [[] for _ in nodes]
    _unwind(nodes, 0, height_of(r["size"]), paths)
    rest = [(p["before"], p["after"]) for p in r["path"] or ()]
    return [p + rest for p in paths]


def _of_nodes(own: DataFrame) -> DataFrame:
    """tree, place, path and root of each node."""
    one = lambda r: [(r["tree"], n["place"], p, r["root"]) for n, p in zip(r["nodes"], _block_paths(r), strict=True)]
    return _each_block(own, one, f"tree string, place long, path {PATH}, root string")


def grown(nodes: DataFrame, *kept: str) -> tuple[DataFrame, DataFrame]:
    """The blocks of placed nodes, and tree, block, path (of the block's root to the tree's) and root; both are written tables."""
    rounds = []
    while True:
        own = materialise(blocks(nodes, *(kept if not rounds else ())), "blocks")
        bare = own.select("tree", "block", "size", F.transform("nodes", lambda n: n["digest"]).alias("nodes"))
        found = materialise(_each_block(bare, _root, "tree string, place long, size long, digest string"), "roots")
        rounds.append((own, found))
        nodes = found
        if not found.where("size > 1").limit(1).count():
            break
    # Every tree of one block has its root now; smaller ones had it before, and each block of one node hands it on unchanged.
    above = materialise(found.select("tree", F.col("place").alias("block"), F.lit(None).cast(PATH).alias("path"), F.col("digest").alias("root")), "above")
    for own, found in reversed(rounds[1:]):
        lower = _of_nodes(own.join(above, ["tree", "block"])).select("tree", F.col("place").alias("block"), "path", "root")
        before, above = above, materialise(lower, "above")
        release(before, own, found)
    release(rounds[0][1])
    return rounds[0][0], above


def paths(nodes: DataFrame) -> DataFrame:
    """tree, place, path and root of all placed nodes: the whole siblings, level by level."""
    own, above = grown(nodes)
    return _of_nodes(own.join(above, ["tree", "block"]))


def _proofs(r: dict) -> list[tuple]:
    """The rows of a block's leaves: their proof's digest, and the root that their present leaf folds to."""
    top = [(p["before"], p["after"]) for p in r["top"] or ()]
    out = []
    for n, own in zip(r["nodes"], _block_paths(r), strict=True):
        path = own + top
        folded = n["tampered"] or n["digest"]
        for before, after in path:
            folded = digest_of([before, folded, after])
        out.append((n["doc_id"], n["digest"], r["root"], r["whole"], digest_of([x for level in path for x in level]), folded, folded == r["whole"]))
    return out


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row."""
    rows = placed(leaves(documents), "doc_id", "digest")
    own, above = grown(rows, "doc_id", "tampered")
    subroots = placed(above.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), "name")
    top, over = grown(subroots, "name")
    names = top.select("tree", "block", F.explode("nodes").alias("n")).select("tree", F.col("n.place").alias("place"), F.col("n.name").alias("name"))
    tops = _of_nodes(top.join(over, ["tree", "block"])).join(names, ["tree", "place"]).select(F.col("name").alias("tree"), F.col("path").alias("top"), F.col("root").alias("whole"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    ready = own.join(above, ["tree", "block"]).join(tops, "tree").select("nodes", "size", "path", "top", "root", "whole")
    return _each_block(ready, _proofs, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def oracle(levels: int = 5) -> str:
    """DuckDB SQL, for sources of up to RUN to the power ``levels`` rows and as many sources."""
    value = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    row = lambda text: "sha256(" + " || ".join([value("CAST(doc_id AS VARCHAR)"), value("source"), value("lang"), value("CAST(n_chars AS VARCHAR)"), value(text)]) + ")"
    crc = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [-1 - ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b < -1 THEN xor(a, -1 - b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
    parts = [
        f"leaves AS (SELECT row_number() OVER () AS r, coalesce('=' || source, '') AS tree, doc_id, {row('text')} AS leaf, "
        f"CASE WHEN xor({crc}, 4294967295) % {TAMPERED} = 0 THEN {row(f'translate(text, {UPPER!r}, {LOWER!r})')} ELSE {row('text')} END AS now FROM documents)",
        "l0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n, leaf AS d, r FROM leaves)",
        "p0 AS (SELECT r, now AS f, leaf AS own, tree, place, '' AS proof FROM l0 JOIN leaves USING (r, tree))",
    ]

    def climb(name: str, proof: str) -> None:
        for k in range(levels):
            was, now = f"{name}{k}", f"{name}{k + 1}"
            parts.append(f"{now} AS (SELECT tree, place // {RUN} AS place, any_value(n) AS n0, (any_value(n) + {RUN - 1}) // {RUN} AS n, sha256(string_agg(d, '' ORDER BY place)) AS d FROM {was} WHERE n > 1 GROUP BY tree, place // {RUN} UNION ALL SELECT tree, place, n, n, d FROM {was} WHERE n = 1)")
            parts.append(f"s{now} AS (SELECT a.tree, a.place, coalesce(string_agg(b.d, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS x, coalesce(string_agg(b.d, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS y FROM {was} a JOIN {was} b ON a.tree = b.tree AND a.place // {RUN} = b.place // {RUN} WHERE a.n > 1 GROUP BY a.tree, a.place)")
            parts.append(f"{proof}{k + 1} AS (SELECT r, CASE WHEN x IS NULL THEN f ELSE sha256(x || f || y) END AS f, own, tree, CASE WHEN x IS NULL THEN place ELSE place // {RUN} END AS place, CASE WHEN x IS NULL THEN proof ELSE proof || x || y END AS proof FROM {proof}{k} LEFT JOIN s{now} USING (tree, place))")

    climb("l", "p")
    parts.append(f"t0 AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, d FROM l{levels})")
    parts.append(f"q0 AS (SELECT r, f, own, t0.tree, t0.place, proof, t0.d AS subroot FROM p{levels} p JOIN t0 ON t0.name = p.tree)")
    climb("t", "q")
    final = f"SELECT leaves.doc_id, own AS leaf, q0.subroot, t{levels}.d AS root, sha256(q.proof) AS proof_sha256, q.f AS folded_root, q.f = t{levels}.d AS verified FROM q{levels} q JOIN leaves USING (r) JOIN t{levels} ON true JOIN (SELECT r, subroot FROM q0) q0 USING (r)"
    return "WITH " + ",\n".join(parts).replace("q0 AS (", "q0 AS MATERIALIZED (").replace("leaves AS (", "leaves AS MATERIALIZED (", 1) + "\n" + final.replace("own AS leaf", "q.own AS leaf")


ORACLE = oracle()
