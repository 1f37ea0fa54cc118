"""Operator 7: near-duplicate embeddings by p-stable hashing.

Vectors of one label and length are scaled to length 1, where cosine
``threshold`` is a Euclidean distance.  Each of ``tables`` tables cuts
``projections`` Gaussian projections into cells of ``cell`` and buckets a
vector by its cells; vectors that share a bucket in any table are compared by
their exact cosine in double precision.  With the defaults a pair right at
0.93 meets with probability 0.999, a closer one more surely, and unrelated
unit vectors meet in one of about 40 cases.

Equal vectors are one node with a multiplicity, so copies are counted, never
paired.  A bucket larger than ``block`` nodes is cut into blocks by a hash and
block meets block, so no task holds a bucket whole; matrices of cosines stay
in numpy, and only counts and one edge per linked vector come out.  A pair
that meets in several tables counts in the first.

Defined results: vectors that are null, zero or hold a null or non-finite
component, and those with a null label, link with nothing; component_id is
the smallest vec_id reachable; repeated rows are vectors of their own; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._groups import grouped
from ._store import stored, table


def bucket_keys(x: np.ndarray, tables: int, projections: int, cell: float, seed: int) -> np.ndarray:
    """A 32-bit bucket key per vector and table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a = rng.normal(size=(x.shape[1], tables * projections))
    b = rng.uniform(0, cell, tables * projections)
    odd = rng.integers(0, 1 << 63, projections, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cells = np.floor((unit @ a + b) / cell).astype(np.int64).view(np.uint64).reshape(len(x), tables, projections)
    h = (cells * odd).sum(axis=2, dtype=np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _hashed(nodes: DataFrame, **how) -> DataFrame:
    """(node, label, dim, x, keys) for nodes (node, label, x)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.diff(b.column(2).offsets.to_numpy())
            for d in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == d))
                x = b.column(2).take(at)
                v = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), d)
                keys = bucket_keys(v, **how)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(np.full(len(at), d, np.int32)),
                     pa.array([r.tobytes() for r in v], pa.binary()),
                     pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))],
                    ["node", "label", "dim", "x", "keys"])

    label = nodes.schema["label"].dataType.simpleString()
    return nodes.mapInArrow(run, f"node long, label {label}, dim int, x binary, keys array<int>")


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, "group"):
            t, node, side = g["table"][0].as_py(), g["node"].to_numpy(), g["side"].to_numpy()
            if len(node) < 2:
                continue
            x = np.frombuffer(b"".join(g["x"].to_pylist())).reshape(len(node), -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            keys = g["keys"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            two = side.any()  # two blocks of one bucket: only pairs across
            rows = np.flatnonzero(side == 0)
            cols = np.flatnonzero(side == 1) if two else rows
            hit = x[rows] @ x[cols].T >= threshold
            if not two:
                hit &= ~np.eye(len(rows), dtype=bool)
            u, v = np.nonzero(hit)
            u, v = rows[u], cols[v]
            if t:
                new = (keys[u, :t] != keys[v, :t]).all(axis=1)
                u, v = u[new], v[new]
            if not len(u):
                continue
            if two:
                u, v = np.r_[u, v], np.r_[v, u]
            count = np.bincount(u, g["copies"].to_numpy()[v], len(node)).astype(np.int64)
            # the smallest node each can reach inside the group
            root = np.arange(len(node))
            while True:
                least = root.copy()
                np.minimum.at(least, u, root[v])
                least = least[least]
                if (least == root).all():
                    break
                root = least
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root[at]]), pa.array(count[at])], ["a", "b", "n"])

    return run


def links(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93,
          tables: int = 32, projections: int = 8, cell: float = 1.6, block: int = 1024, seed: int = 11) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    x = F.col(vector)
    sound = (x.isNotNull() & F.col(label).isNotNull()
             & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(x, lambda e: e != 0))
    rows = df.select(F.col(id_col), F.col(label).alias("label"), x.alias("x"),
                     F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(label, vector)).alias("node"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("x").alias("x"),
                                                               F.count(F.lit(1)).alias("copies"))
    hashed = stored(_hashed(nodes.select("node", "label", "x"), tables=tables, projections=projections, cell=cell, seed=seed)
                    .join(nodes.select("node", "copies"), "node"), "op7-vectors")
    member = hashed.select("node", "label", "dim", F.posexplode("keys").alias("table", "key"))
    bucket = ["label", "dim", "table", "key"]
    sizes = member.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node", "table"), F.col("parts")).cast("int")
    # block i meets every block j: as side 0 where i <= j, else as side 1
    met = (member.join(sizes, bucket).withColumn("parts", parts).withColumn("own", own)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
           .withColumn("side", (F.col("own") > F.col("other")).cast("int"))
           .select("node", "table", "side",
                   F.xxhash64(*bucket, F.least("own", "other"), F.greatest("own", "other")).alias("group")))
    found = stored(met.join(hashed.select("node", "x", "keys", "copies"), "node")
                   .repartition("group").sortWithinPartitions("group").select("group", "table", "side", "node", "x", "keys", "copies")
                   .mapInArrow(_compare(threshold), "a long, b long, n long"), "op7-found")
    comp = components(found.select("a", "b"))
    count = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    per = (nodes.select("node", "copies").join(count, "node", "left").join(comp, "node", "left")
           .select("node", F.coalesce("comp", "node").alias("comp"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = rows.select(id_col, "node").join(per, "node", "left")
    least = named.where("comp is not null").groupBy("comp").agg(F.min(id_col).alias("component_id"))
    return (named.join(least, "comp", "left")
            .select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", id_col).alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


# compares every pair of a label, so it is for small tables
SQL = """
with recursive v as (
  select row_number() over () r, vec_id, label, embedding::double[] x,
    coalesce(label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
      and len(list_filter(embedding, lambda e: e <> 0)) > 0, false) sound from embeddings),
links as (
  select a.r a, b.r b from v a join v b on a.label = b.label and len(a.x) = len(b.x) and a.r <> b.r
  where a.sound and b.sound and list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) >= 0.93),
reach(r, t) as (select r, r from v union select reach.r, links.b from reach join links on reach.t = links.a),
comp as (select reach.r, min(v.vec_id) component_id from reach join v on v.r = reach.t group by 1)
select v.vec_id, (select count(*) from links where links.a = v.r) n_links, component_id, v.vec_id = component_id kept
from v join comp using (r)
"""
