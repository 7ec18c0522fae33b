"""A manifest of a dataset as a hash tree whose blocks are stored in van Emde Boas order."""
from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import partitions, written

#: Nodes of a run that become one, and levels of a block below its root: a block is a subtree of FAN ** HEIGHT nodes.
FAN, HEIGHT = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# --- addresses ---------------------------------------------------------------------------------------------------------

def nodes_in(levels: int) -> int:
    return (FAN ** levels - 1) // (FAN - 1)


def address(level: int, index, levels: int):
    """Place of node `index` (a number or an array) of a level (0: the root) in a complete tree of `levels` levels: the upper
    half of the levels comes first, then the subtrees below it one after another, each laid out in the same way."""
    at = 0
    while levels > 1:
        top = levels // 2
        if level < top:
            levels = top
            continue
        below = FAN ** (level - top)
        at = at + nodes_in(top) + index // below * nodes_in(levels - top)
        level, index, levels = level - top, index % below, levels - top
    return at


@lru_cache(64)
def _addresses(level: int, levels: int) -> np.ndarray:
    return np.zeros(FAN ** level, np.int64) + address(level, np.arange(FAN ** level), levels)


def hex_of(digests: np.ndarray) -> bytes:
    return digests.tobytes().hex().encode()


class Block:
    """An aligned subtree: n nodes and the runs above them, `height` levels up."""

    def __init__(self, tree: np.ndarray, n: int, height: int):
        self.tree, self.n, self.height = tree, n, height

    @classmethod
    def build(cls, nodes: np.ndarray, height: int) -> Block:
        """nodes: n x 32 bytes, at most FAN ** height of them."""
        levels = height + 1
        b = cls(np.zeros((nodes_in(levels), 32), np.uint8), len(nodes), height)
        b.tree[_addresses(height, levels)[:len(nodes)]] = nodes
        for level in range(height, 0, -1):
            up = [sha256(run).digest() for run in b.runs(level)]
            b.tree[_addresses(level - 1, levels)[:len(up)]] = np.frombuffer(b"".join(up), np.uint8).reshape(-1, 32)
        return b

    def size(self, level: int) -> int:
        return -(-self.n // FAN ** (self.height - level))

    def runs(self, level: int) -> list[bytes]:
        """The runs of a level as hex text."""
        n = self.size(level)
        text = hex_of(self.tree[_addresses(level, self.height + 1)[:n]])
        return [text[i:i + 64 * FAN] for i in range(0, 64 * n, 64 * FAN)]

    def paths(self, above: list[tuple[bytes, bytes]]):
        """For each node in order its way to the top: (text left of it, text right of it) in its run, level by level, this
        block's levels first, then `above`."""
        ways = [above]
        for level in range(1, self.height + 1):
            runs = self.runs(level)
            ways = [[(runs[i // FAN][:64 * (i % FAN)], runs[i // FAN][64 * (i % FAN) + 64:])] + ways[i // FAN] for i in range(self.size(level))]
        return ways


def fold(leaf: str, way: list[tuple[bytes, bytes]]) -> str:
    for left, right in way:
        leaf = sha256(left + leaf.encode() + right).hexdigest()
    return leaf


def proof_digest(way: list[tuple[bytes, bytes]]) -> str:
    return sha256(b"".join(x for both in way for x in both)).hexdigest()


def _pack(way) -> bytes:
    return b"".join(bytes([len(a) // 64, len(b) // 64]) + bytes.fromhex((a + b).decode()) for a, b in way)


def _unpack(raw: bytes | None):
    at, way = 0, []
    while raw and at < len(raw):
        a, b = raw[at], raw[at + 1]
        text = raw[at + 2:at + 2 + 32 * (a + b)].hex().encode()
        way.append((text[:64 * a], text[64 * a:]))
        at += 2 + 32 * (a + b)
    return way


# --- Spark -------------------------------------------------------------------------------------------------------------

def _field(c):
    text = F.col(c).cast("string")
    return F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text=None):
    """The digest of a row: each field as `-` or its UTF-8 byte count, a colon and its value. `text` stands in for the text."""
    last = _field("text") if text is None else F.when(F.col("text").isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*(_field(c) for c in FIELDS[:-1]), last), 256)


def positions(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with pos (from 0) and total of its group. Rows are sorted over all tasks by range, so that no group is one task; only a
    count per task and group is ordered over a group."""
    parts = partitions(df.sparkSession)
    sort = [group, *order]
    rows = written(df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id())
                   .withColumn("_at", F.monotonically_increasing_id()), "sorted")
    here = rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    here = (here.withColumn("_before", F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).withColumn("total", F.sum("_n").over(w))
            .select(group, "_part", "_first", "_before", "total"))
    return rows.join(here, [group, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def _blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """nodes(g, pos, total, digest, carried columns) -> written blocks (g, block, n, total, height, tree, carried as arrays)."""
    spark, span = nodes.sparkSession, FAN ** HEIGHT
    sorted_ = (nodes.withColumn("block", F.floor(F.col("pos") / span).cast("long")).repartition(partitions(spark), "g", "block")
               .sortWithinPartitions("g", "block", "pos").select("g", "block", "total", "digest", *carry))
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("total", T.LongType()),
                           T.StructField("height", T.IntegerType()), T.StructField("tree", T.BinaryType()), *(T.StructField(c, T.ArrayType(nodes.schema[c].dataType)) for c in carry)])

    def run(batches):
        own, total, digests, held = None, 0, [], {c: [] for c in carry}

        def close():
            nonlocal digests, held
            height = HEIGHT
            if total <= span:
                height = 0
                while FAN ** height < total:
                    height += 1
            b = Block.build(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32), height)
            arrays = [pa.array([x]) for x in own] + [pa.array([len(digests)], pa.int64()), pa.array([total], pa.int64()), pa.array([height], pa.int32()), pa.array([b.tree.tobytes()], pa.binary())]
            out = pa.RecordBatch.from_arrays(arrays + [pa.array([held[c]], pa.list_(kinds[c])) for c in carry], names=schema.names)
            digests, held = [], {c: [] for c in carry}
            return out

        kinds = {}
        for batch in batches:
            kinds = {c: batch.column(c).type for c in carry}
            cols = [batch.column(c).to_pylist() for c in ("g", "block", "total", "digest", *carry)]
            for g, block, n, digest, *more in zip(*cols):
                if own != (g, block):
                    if digests:
                        yield close()
                    own, total = (g, block), n
                digests.append(digest)
                for c, x in zip(carry, more):
                    held[c].append(x)
        if digests:
            yield close()

    return written(sorted_.mapInArrow(run, schema), "blocks")


def _stages(nodes: DataFrame, carry: list[str]) -> list[DataFrame]:
    """Blocks over blocks until every group has a single one; a stage divides a group's nodes by FAN ** HEIGHT."""
    stages = [_blocks(nodes, carry)]
    while True:
        more = stages[-1].where(F.col("total") > FAN ** HEIGHT)
        if more.isEmpty():
            return stages
        stages.append(_blocks(more.select("g", F.col("block").alias("pos"), F.ceil(F.col("total") / FAN ** HEIGHT).cast("long").alias("total"), F.col("tree").substr(1, 32).alias("digest")), []))


def _below(blocks: DataFrame, above: DataFrame, key: str | None = None) -> DataFrame:
    """Ways of all nodes of a stage: (g, block, way, subroot, root), g named by the carried `key` and block 0 if it is given, else
    block the node's position. above: the same for the blocks themselves."""
    carried = [key] if key else []
    joined = blocks.select("g", "block", "n", "height", "tree", *carried).join(above, ["g", "block"])

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                b = Block(np.frombuffer(x["tree"], np.uint8).reshape(-1, 32), x["n"], x["height"])
                ways = [_pack(w) for w in b.paths(_unpack(x["way"]))]
                leaves = b.tree[_addresses(b.height, b.height + 1)[:b.n]].tobytes()
                span = FAN ** HEIGHT * x["block"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(x[key] if key else [x["g"]] * b.n, pa.string()), pa.array([0] * b.n if key else range(span, span + b.n), pa.int64()), pa.array(ways, pa.binary()),
                    pa.array([leaves[i:i + 32] for i in range(0, 32 * b.n, 32)] if key else [x["subroot"]] * b.n, pa.binary()), pa.array([x["root"]] * b.n, pa.binary())], names=names)

    names = ["g", "block", "way", "subroot", "root"]
    return written(joined.mapInArrow(run, "g string, block long, way binary, subroot binary, root binary"), "ways")


def manifest(docs: DataFrame, tampered: str = "pmod(crc32(cast(doc_id as string)), 5) = 0") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs(doc_id, source, lang, n_chars, text).

    Rows are leaves; FAN leaves in a row (by doc_id) become a node and so on until a source has one, its subroot; subroots, by
    source, become the root in the same way. Trees are made of blocks of HEIGHT levels, each built in one piece by some task and
    stored as an array in van Emde Boas order; block roots are the leaves of the next blocks, so that no source and no tree
    is ever gathered. Ways (the siblings up to the root) then go down from block to block. A row that `tampered` marks is
    folded with A-Z of its text in lower case; verified: the folded root is the root.

    Null fields are told from empty ones; null sources are one source, the first; null doc_ids come first in their source and
    are never marked; rows of one doc_id are ordered by their digest; repeated rows are leaves each; very long texts are hashed by
    Spark whole; an empty table gives no rows; other columns are not read."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    digest = F.unhex(leaf_digest())
    leaves = docs.select(
        "doc_id", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("g"),       # null first
        digest.alias("digest"), F.when(F.expr(tampered), F.unhex(leaf_digest(lower))).alias("changed"), F.monotonically_increasing_id().alias("_tie"))
    return _manifest(leaves)


def _manifest(leaves: DataFrame) -> DataFrame:
    key_type = leaves.schema["doc_id"].dataType
    stages = _stages(positions(leaves, "g", ["doc_id", "digest", "_tie"]), ["doc_id", "changed"])
    single = lambda s: s.where(F.col("total") <= FAN ** HEIGHT)
    subroots = single(stages[0]).select("g", F.col("tree").substr(1, 32).alias("digest"))
    for s in stages[1:]:
        subroots = subroots.unionAll(single(s).select("g", F.col("tree").substr(1, 32).alias("digest")))
    top = _stages(positions(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), "g", ["name"]), ["name"])
    ways = top[-1].select("g", "block", F.lit(b"").alias("way"), F.lit(None).cast("binary").alias("subroot"), F.col("tree").substr(1, 32).alias("root"))
    for s in top[:0:-1]:
        ways = _below(s, ways)
    sources = _below(top[0], ways, "name")                                    # the way of each subroot
    ways = single(stages[-1]).select("g", "block").join(sources, ["g", "block"])
    for s, below in zip(stages[:0:-1], stages[-2::-1]):
        ways = _below(s, ways).unionAll(single(below).select("g", "block").join(sources, ["g", "block"]))
    joined = stages[0].select("g", "block", "n", "height", "tree", "doc_id", "changed").join(ways, ["g", "block"])
    texts = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType([T.StructField("doc_id", key_type), *(T.StructField(c, T.StringType()) for c in texts), T.StructField("verified", T.BooleanType())])

    def run(batches):
        for batch in batches:
            kind = batch.column("doc_id").type.value_type
            for x in batch.to_pylist():
                b = Block(np.frombuffer(x["tree"], np.uint8).reshape(-1, 32), x["n"], x["height"])
                leaf = hex_of(b.tree[_addresses(b.height, b.height + 1)[:b.n]]).decode()
                root, out = x["root"].hex(), []
                for i, (changed, way) in enumerate(zip(x["changed"], b.paths(_unpack(x["way"])))):
                    own = leaf[64 * i:64 * i + 64]
                    folded = fold(changed.hex() if changed else own, way)
                    out.append((own, x["subroot"].hex(), root, proof_digest(way), folded, folded == root))
                yield pa.RecordBatch.from_arrays([pa.array(x["doc_id"], kind), *(pa.array(c) for c in zip(*out))], names=schema.names)

    return joined.mapInArrow(run, schema)
