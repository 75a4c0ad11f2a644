"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards, each shard with a weight; a rack's or a region's weight is the sum of
those below it. At every level a document draws -ln(u) / weight for each child of the node it has come to, u a hash
of its id and the child, and descends to the child with the least draw: region, rack, then shard. Draws of different
levels are independent, so a document costs one hash for each region, each rack of its region and each shard of its
rack. A weight that changes changes only the draws of its own path, so documents move only into, out of or within
the region and the rack that it is in.

A tree is built once, with BASE shards; each shard that is added later is a region of its own, so growth takes
documents into the new shard alone, and the law is `key`: the id and the number of shards decide.

Cases: a null id is a key like others; rows with the same id go to the same shard. A null text has 0 bytes and
the checksum 0. Repeated rows each have a slot. Shards without weight get nothing. An empty table gives no rows.
Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.plans.prefix import bits_for, high_bits, prefix_in_groups
from loomfield.plans.shared import materialize

SHARDS = 40
#: Shards that the tree is built with, shards of a rack, and racks of a region.
BASE, RACK, REGION = 40, 2, 5


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    name: int
    weight: float = 1.0


def tree_of(n: int, base: int = BASE) -> list[Shard]:
    """n equal shards: up to base by racks and regions, which are filled one after another, each later one in a region of its own."""
    return [Shard(f"r{i // (RACK * REGION)}", f"k{i // RACK}", i) if i < base else Shard(f"r+{i}", f"k+{i}", i) for i in range(n)]


_CHILDREN = "array<struct<path:string,weight:double,at:int>>"


def _children(nodes: list[tuple[str, float, int]]) -> Column:
    return F.array(*(F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight"), F.lit(i).alias("at")) for p, w, i in nodes)).cast(_CHILDREN)


def _draw(key: Column, children: Column, salt: str) -> Column:
    """at of the child with the least draw."""

    def one(child):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.concat(F.lit(f"{salt}/"), child["path"])), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.ln(u) / child["weight"]).alias("t"), child["at"].alias("at"))

    return F.array_min(F.transform(children, one))["at"]


def place(key: Column, shards: list[Shard], salt: str = "shard") -> Column:
    """The name of the shard that key descends to."""
    tree: dict[str, dict[str, list[Shard]]] = {}
    for s in shards:
        if s.weight > 0:
            tree.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    regions = list(tree)
    racks = [(r, k) for r in regions for k in tree[r]]
    of = lambda r: [(f"{r}/{k}", sum(s.weight for s in tree[r][k]), racks.index((r, k)) + 1) for k in tree[r]]
    top = _children([(r, sum(w for _, w, _ in of(r)), i + 1) for i, r in enumerate(regions)])
    below = F.array(*(_children(of(r)) for r in regions))
    leaves = F.array(*(_children([(f"{r}/{k}/{s.name}", s.weight, s.name) for s in tree[r][k]]) for r, k in racks))
    rack = _draw(key, F.element_at(below, _draw(key, top, salt)), salt)
    return _draw(key, F.element_at(leaves, rack), salt)


def shard(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of docs(doc_id, text), over n shards; a tree of fewer than BASE is built with n."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    narrow = narrow.withColumns({
        "shard": place(F.col("doc_id"), tree_of(n, min(n, BASE))),
        "grown_shard": place(F.col("doc_id"), tree_of(n + 1, min(n, BASE))),
        "order": F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 4),
        "one": F.lit(1).cast("long"),
    })
    narrow = materialize(narrow, "shards")
    bits = bits_for(narrow.count() * 2 // n)
    placed = prefix_in_groups(narrow.withColumn("bucket", high_bits(F.col("order"), bits)), "shard", "bucket", ["order", "doc_id", "text_crc32", "size"], "one", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
