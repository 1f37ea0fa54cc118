"""Operator 4: near-duplicates by ProbMinHash.

A text's shingles (``width`` consecutive words; a shorter text is one
shingle) weigh as often as they occur.  Each shingle sends out a Poisson
process of its weight's rate, drawn from its hash alone; an arrival lands in
one of ``slots`` registers, which keeps the shingle that came first.  The
processes stop at a time by which all registers are expected to be filled, so
a text of any length needs about ``slots * ln(slots)`` arrivals; texts with an
empty register run on.  Two texts' registers agree with the probability
Jaccard similarity of their weighted shingles,
``sum over x of 1 / sum over y of max(u(y)/u(x), v(y)/v(x))``, which is the
plain Jaccard similarity where no shingle repeats.

Registers are cut into ``bands``.  Texts that share a band are candidates, and
a candidate pair links if its exact probability Jaccard is ``threshold`` or
more.  Classes are the connected components of links.

Groups of any size: equal texts are one node.  A band's bucket is never
expanded into rows of pairs.  First all its members are checked against one
leader, and components are merged.  Buckets that still hold several
components are taken apart in blocks of ``block`` nodes dealt by a hash, block
against block, inside numpy: pairs of different components whose registers
leave a similarity of ``threshold`` possible are checked exactly, the
likeliest first, unless earlier links have joined them meanwhile, and only
links come out.  So no candidate is dropped, and what is written grows with
the nodes, not with the square of a group.

Defined results: texts that are null or hold no word link with nothing and
are each their own class; equal texts are one class; a class is named by its
smallest doc_id; repeated rows get equal rows; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._components import components
from ._groups import grouped
from ._store import stored, table

_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles, by text."""
    start, end, first = B.spans(data, offs)
    h, n = B.hashes(data, start, end), np.diff(first)
    text_of = np.repeat(np.arange(len(n)), n)
    left = first[text_of + 1] - np.arange(len(h)) if len(h) else np.empty(0, np.int64)
    at = np.flatnonzero((left >= width) | ((n[text_of] < width) & (left == n[text_of])))
    s = np.zeros(len(at), np.uint64)
    for i in range(width):
        ok = left[at] > i
        s[ok] = (s[ok] ^ (s[ok] >> np.uint64(29))) * _ODD[0] + h[at[ok] + i] * _ODD[i % 5]
    s, t = B.mix(s), text_of[at]
    order = np.lexsort((s, t))
    s, t = s[order], t[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return t[at], s[at], np.diff(np.r_[at, len(s)])


def registers(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int, slots: int) -> np.ndarray:
    """For each text and slot the hash of the shingle that arrived first."""
    total = np.bincount(text, weight, n_texts)
    first = np.zeros((n_texts, slots), np.uint64)
    todo, slack = total > 0, 3.0
    while todo.any():
        stop = np.where(todo, slots * (np.log(slots) + slack) / np.maximum(total, 1), -1.0)
        best = np.full(n_texts * slots, np.inf)
        who = np.zeros(n_texts * slots, np.uint64)
        e = np.flatnonzero(todo[text])
        seen, time = np.zeros(len(e), np.int64), np.zeros(len(e))
        while len(e):
            # the next few arrivals of each process that still runs
            more = np.maximum(1, (weight[e] * (stop[text[e]] - time) / 2).astype(np.int64))
            of = np.repeat(np.arange(len(e)), more)
            begin = np.cumsum(more) - more
            j = np.arange(len(of)) - begin[of] + seen[of]
            r = B.mix(h[e][of] + (j.astype(np.uint64) + np.uint64(1)) * _ODD[1])
            gap = -np.log(((r >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / weight[e][of]
            x = np.cumsum(gap)
            x += (time - (x[begin] - gap[begin]))[of]
            ok = x <= stop[text[e]][of]
            slot = text[e][of[ok]] * slots + ((B.mix(r[ok] ^ _ODD[2]) >> np.uint64(33)) % np.uint64(slots)).astype(np.int64)
            np.minimum.at(best, slot, x[ok])
            won = x[ok] == best[slot]
            who[slot[won]] = h[e][of[ok][won]]
            last = begin + more - 1
            runs = x[last] <= stop[text[e]]
            seen, time, e = (seen + more)[runs], x[last][runs], e[runs]
        full = todo & np.isfinite(best).reshape(n_texts, slots).all(axis=1)
        first[full] = who.reshape(n_texts, slots)[full]
        todo &= ~full
        slack += 6.0
    return first


def probability_jaccard(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray) -> float:
    """Exact probability Jaccard of sorted hashes ``a`` with weights ``u`` and ``b`` with ``v``."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    # of x: sum over y of max(u(y)/u(x), v(y)/v(x)); by ratios r(y) = u(y)/v(y) against r(x)
    x, y = u[i].astype(float), v[j].astype(float)
    ratio = x / y
    order = np.argsort(ratio)
    ratio, x, y = ratio[order], x[order], y[order]
    only_a, only_b = u.sum() - x.sum(), v.sum() - y.sum()
    # y whose ratio is larger than that of x count by u(y)/u(x), the others by v(y)/v(x)
    above_u = x.sum() - np.cumsum(x)
    below_v = np.cumsum(y)
    return float((1 / ((only_a + above_u) / x + (only_b + below_v) / y)).sum())


def _band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.shape[1] // bands
    key = np.zeros((len(sig), bands), np.uint64)
    for i in range(rows):
        key = B.mix(key + sig[:, np.arange(bands) * rows + i] * _ODD[i % 5])
    return B.mix(key + np.arange(1, bands + 1, dtype=np.uint64) * _ODD[3]).view(np.int64)


def sketch(nodes: DataFrame, width: int, slots: int, bands: int) -> DataFrame:
    """(node, keys, sig) of the texts (node, text) that hold a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.flat(batch.column(1))
            for i, j in B.pieces(offs):
                t, h, w = shingles(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], width)
                sig = registers(t, h, w, j - i, slots)
                has = np.zeros(j - i, bool)
                has[t] = True
                sig = sig[has]
                keys = _band_keys(sig, bands)
                flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))
                small = np.ascontiguousarray(sig.astype(np.uint32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).filter(pa.array(has)), flat, pa.array([r.tobytes() for r in small], pa.binary())],
                    ["node", "keys", "sig"])

    return nodes.mapInArrow(run, "node long, keys array<long>, sig binary")


def weighted(nodes: DataFrame, width: int) -> DataFrame:
    """(node, h, w): the sorted shingle hashes and their counts, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.flat(batch.column(1))
            for i, j in B.pieces(offs):
                t, h, w = shingles(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], width)
                cut = np.searchsorted(t, np.arange(j - i + 1))
                hs, ws = [], []
                for a, b in zip(cut[:-1], cut[1:]):
                    order = np.argsort(h[a:b])
                    hs.append(h[a:b][order].tobytes())
                    # mostly every count is 1, which no bytes say
                    ws.append(b"" if b - a == w[a:b].sum() else w[a:b][order].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(hs, pa.binary()), pa.array(ws, pa.binary())],
                                                 ["node", "h", "w"])

    return nodes.mapInArrow(run, "node long, h binary, w binary")


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        part = [float(np.mean(np.frombuffer(x.as_py(), np.uint32) == np.frombuffer(y.as_py(), np.uint32)))
                for x, y in zip(b.column(2), b.column(3))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part, pa.float64())], ["a", "b", "est"])


def _weighted_shingles(h: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(h, np.uint64)
    return h, (np.frombuffer(w, np.uint32) if w else np.ones(len(h), np.uint32))


def _across(bands: int, least: float, threshold: float):
    """Links (a, b) between different components in the groups of a bucket's
    blocks; a pair is looked at in the first band that it shares."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, "group"):
            node, side = g["node"].to_numpy(), g["side"].to_numpy()
            label = np.unique(g["comp"].to_numpy(), return_inverse=True)[1]
            if not label.any():
                continue
            sig = np.frombuffer(b"".join(g["sig"].to_pylist()), np.uint32).reshape(len(node), -1)
            band, two = g["band"][0].as_py(), side.any()
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1) if two else left
            links = []
            for n, i in enumerate(left):
                cols = right if two else left[n + 1:]
                cols = cols[label[cols] != label[i]]
                same = sig[cols] == sig[i]
                est = same.mean(axis=1)
                ok = np.flatnonzero(est >= least)
                ok = ok[same[ok].reshape(len(ok), bands, -1).all(axis=2).argmax(axis=1) == band] if len(ok) else ok
                mine = None
                for j in cols[ok[np.argsort(-est[ok], kind="stable")]]:
                    if label[i] == label[j]:
                        continue
                    mine = mine or _weighted_shingles(g["h"][int(i)].as_py(), g["w"][int(i)].as_py())
                    if probability_jaccard(*mine, *_weighted_shingles(g["h"][int(j)].as_py(), g["w"][int(j)].as_py())) >= threshold - 1e-9:
                        links.append((int(node[i]), int(node[j])))
                        label[label == label[j]] = label[i]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def read(h, w):
        return _weighted_shingles(h.as_py(), w.as_py())

    for b in batches:
        sim = [probability_jaccard(*read(h1, w1), *read(h2, w2))
               for h1, w1, h2, w2 in zip(b.column(2), b.column(3), b.column(4), b.column(5))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim, pa.float64())], ["a", "b", "sim"])


class NearDuplicates:
    """The classes of one corpus."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5,
                 threshold: float = 0.8, slots: int = 180, bands: int = 30, block: int = 512):
        self.id_col, self.width, self.threshold, self.bands, self.block = id_col, width, threshold, bands, block
        # 4.5 standard errors under the threshold: no link is ruled out by its registers
        self.least = threshold - 4.5 * (threshold * (1 - threshold) / slots) ** 0.5
        self.rows = df.select(F.col(id_col), F.xxhash64(text).alias("node"), F.col(text).alias("text"))
        nodes = self.rows.where(F.col("text").isNotNull()).select("node", "text")
        self.sketches = stored(sketch(nodes, width, slots, bands).dropDuplicates(["node"]), "op4-sketch")
        # buckets of two or more texts
        one = self.sketches.select("node", F.posexplode("keys").alias("band", "key"))
        found = one.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last")
        self.buckets = stored(one.join(found.select("key", "lead"), "key"), "op4-buckets")
        need = self.buckets.select("node").distinct()
        self.weights = stored(weighted(nodes.join(need, "node", "left_semi").dropDuplicates(["node"]), width), "op4-weighted")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose registers leave the threshold possible."""
        sig = self.sketches.select("node", "sig")
        return (pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("s")), "a")
                .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("t")), "b")
                .select("a", "b", "s", "t").mapInArrow(_agreement, "a long, b long, est double")
                .where(F.col("est") >= self.least).select("a", "b"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose exact similarity reaches the threshold, with it."""
        pairs = stored(pairs, "op4-pairs")
        need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        w = self.weights.join(need, "node", "left_semi")
        return stored(pairs.join(w.select(F.col("node").alias("a"), F.col("h").alias("h1"), F.col("w").alias("w1")), "a")
                      .join(w.select(F.col("node").alias("b"), F.col("h").alias("h2"), F.col("w").alias("w2")), "b")
                      .select("a", "b", "h1", "w1", "h2", "w2").mapInArrow(_similarity, "a long, b long, sim double")
                      .where(F.col("sim") >= self.threshold - 1e-9), "op4-links")

    def across(self, comp: DataFrame) -> DataFrame:
        """Links (a, b) of different components."""
        m = self.buckets.join(comp, "node", "left").select("key", "band", "node", F.coalesce("comp", "node").alias("comp"))
        several = (m.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("size"))
                   .where("c0 <> c1").select("key", F.ceil(F.col("size") / self.block).cast("int").alias("parts")))
        own = F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")
        # block i meets every block j: as side 0 where i <= j, else as side 1
        met = (m.join(several, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
               .withColumn("side", (F.col("own") > F.col("other")).cast("int"))
               .select("node", "comp", "band", "side", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group")))
        held = self.sketches.select("node", "sig").join(self.weights, "node")
        return (met.join(held, "node").repartition("group").sortWithinPartitions("group")
                .select("group", "band", "side", "node", "comp", "sig", "h", "w")
                .mapInArrow(_across(self.bands, self.least, self.threshold), "a long, b long"))

    def classes(self) -> DataFrame:
        """(node, comp) of the texts that link with another."""
        star = self.buckets.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
        links = self.linked(self.likely(star)).select("a", "b")
        more = stored(self.across(components(links)), "op4-across")
        return components(links.union(more))

    def rows_by_class(self) -> DataFrame:
        """(id, node, comp) for each row; comp is null where a text has no word."""
        named = (self.sketches.select("node").join(self.classes(), "node", "left")
                 .select("node", F.coalesce("comp", "node").alias("comp")))
        return self.rows.select(self.id_col, "node").join(named, "node", "left")

    def result(self) -> DataFrame:
        """(id, class_id, kept) for each row: the class's smallest id, and
        whether the row is that document."""
        i = self.id_col
        rows = self.rows_by_class()
        least = rows.where("comp is not null").groupBy("comp").agg(F.min(i).alias("class_id"))
        return (rows.join(least, "comp", "left").select(i, F.coalesce("class_id", i).alias("class_id"))
                .withColumn("kept", F.col(i).eqNullSafe(F.col("class_id"))))

    def kept(self) -> DataFrame:
        """(id, node) of one document of each class; node is the text's xxhash64."""
        own = F.coalesce("comp", F.xxhash64(self.id_col, "node"))
        least = self.rows_by_class().groupBy(own.alias("c")).agg(F.min(F.struct(F.col(self.id_col).isNull(), self.id_col, "node")).alias("m"))
        return least.select(f"m.{self.id_col}", "m.node")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).result()
