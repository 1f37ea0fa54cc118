"""Operator 6: a hashed maximum-entropy language model.

A word's probability is a product of three factors.  Words fall into 256
cells: the most frequent ones (and the end) have a cell each, the others share
128 by their last bytes; 16 successive cells are a class.  Two softmaxes give
the class, and the cell within it, from the hashed features of the context
(the previous word, the previous two together, and a skip to the second
before); inside a cell a word has its smoothed share of the training
counts, unknown words the share of one more word.  The probabilities of all
words, known or not, add up to one.

Counting: texts are tokenised in blocks; a block lists its distinct tokens
once, sorted by hash, with their training counts, and the lists are cut by
hash range into as many buckets as there are shuffle partitions.  A bucket
sums the counts and answers each block, which then scores its documents by
its own short table.  So the vocabulary is never broadcast nor collected, and
traffic follows the blocks' distinct tokens, not tokens.

Training: in each of ``rounds`` rounds every partition takes gradient steps
from the current weights on its share of the documents, and the weights are
averaged by tokens over partitions, one slice of the tables at a time.  Over
all rounds every training token is used once.  The tables have a fixed size
(about 5 MB), so they can travel with the tasks.

Defined results: a null or empty text is its end token alone; rows that
repeat both doc_id and text score alike; with no training rows all counts are
0 and the cells uniform; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._store import stored, table
from .quality_classifier import remainder

END = np.uint64(0x5851F42D4C957F2D)  # the end token's hash
CELLS, CLASS, TAILS = 256, 16, 128
ROWS, ROWS2 = 1 << 14, 1 << 12  # rows of the class and the cell table
N_FEATURES = 3
BLOCK = 8 << 20
CHUNK = 1 << 19  # bytes of text whose arrays stay in the processor's cache


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens, their tail cells, and the first token of each text."""
    data = B.lowered(data)
    start, end, first = B.spans(data, offs)
    n = len(offs) - 1
    at = np.arange(len(start)) + np.repeat(np.arange(n), np.diff(first))
    h = np.full(len(start) + n, END)
    h[at] = B.hashes(data, start, end)
    tail = np.zeros(len(h), np.uint8)
    if len(start):
        size = end - start
        last = data[end - 1].astype(np.uint64)
        for i in (2, 3):
            last |= np.where(size >= i, data[np.maximum(end - i, 0)], 0).astype(np.uint64) << np.uint64(8 * (i - 1))
        tail[at] = (B.mix(last) >> np.uint64(32)) % np.uint64(TAILS)
    return h, tail, first + np.arange(n + 1)


def cells(h: np.ndarray, tail: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The cell of each token; ``heads`` holds the sorted hashes of words with one each."""
    cell = tail.astype(np.int64)
    if len(heads):
        i = np.minimum(np.searchsorted(heads, h), len(heads) - 1)
        cell = np.where(heads[i] == h, TAILS + i, cell)
    return np.where(h == END, CELLS - 1, cell)


def contexts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashed features (tokens, N_FEATURES) of the tokens before each token."""
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))

    def before(k: int) -> np.ndarray:
        out = np.zeros_like(h)
        out[k:] = h[:-k]
        out[place < k] = 0
        return out

    p1, p2 = before(1), before(2)
    return np.stack([B.mix(p1 + np.uint64(1)), B.mix(p1 * np.uint64(31) ^ B.mix(p2 + np.uint64(2))),
                     B.mix(p2 + np.uint64(3))], axis=1)


class Model:
    """Two hashed softmaxes; each has a bias row and one row per hashed feature."""

    def __init__(self, heads: np.ndarray, cell_counts: np.ndarray):
        self.heads = heads
        n = cell_counts + 0.5
        by_class = n.reshape(-1, CLASS)
        self.bias1 = np.log(by_class.sum(axis=1) / n.sum()).astype(np.float32)
        self.bias2 = np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32)
        self.w1 = np.zeros((ROWS, CELLS // CLASS), np.float32)
        self.w2 = np.zeros((ROWS2 * (CELLS // CLASS), CLASS), np.float32)

    def logits(self, x: np.ndarray, cell: np.ndarray):
        """(table, its rows per feature, unnormalised log-probabilities, the true
        column) for the classes and for the cells of the true class."""
        c = cell // CLASS
        r1 = (x % np.uint64(ROWS)).astype(np.uint16)
        r2 = ((x >> np.uint64(20)) % np.uint64(ROWS2)).astype(np.uint16) * np.uint16(CELLS // CLASS) + c[:, None].astype(np.uint16)
        for w, r, bias, y in ((self.w1, r1, self.bias1, c), (self.w2, r2, self.bias2.take(c, axis=0), cell % CLASS)):
            z = w.take(r[:, 0], axis=0)
            z += bias
            for f in range(1, N_FEATURES):
                z += w.take(r[:, f], axis=0)
            yield w, r, z, y

    def log10(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        total = 0.0
        for _, _, z, y in self.logits(x, cell):
            true = z[np.arange(len(z)), y]
            total = total + true - np.log(np.exp(z, out=z).sum(axis=1), dtype=float)
        return total / np.log(10)

    def learn(self, x: np.ndarray, cell: np.ndarray, power: list[np.ndarray], rate: float) -> None:
        """One step on a batch of tokens, scaled per row by its past gradients."""
        for (w, r, g, y), seen in zip(list(self.logits(x, cell)), power):
            np.exp(g, out=g)
            g /= -g.sum(axis=1, keepdims=True)
            g[np.arange(len(g)), y] += 1
            flat = r.ravel()
            order = np.argsort(flat, kind="stable")
            rows = flat.take(order)
            at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            total = np.add.reduceat(g.take(order // N_FEATURES, axis=0), at, axis=0)
            rows = rows.take(at)
            seen[rows] += np.einsum("ij,ij->i", total, total)
            w[rows] += total * (rate / np.sqrt(seen.take(rows) + 1.0))[:, None]


def _texts(batches: Iterator[pa.RecordBatch], most: int):
    """(batch, hashes, tails, first tokens) of about ``most`` bytes at a time,
    tokenised in chunks that fit the cache."""
    for b in batches:
        data, offs = B.flat(b.column("text"))
        for i, j in B.pieces(offs, most):
            parts = [tokens(data[offs[k]:offs[m]], offs[k:m + 1] - offs[k])
                     for k, m in ((i + k, i + m) for k, m in B.pieces(offs[i:j + 1], CHUNK))]
            base = np.cumsum([0] + [len(p[0]) for p in parts])
            first = np.concatenate([p[2][:-1] + n for p, n in zip(parts, base)] + [base[-1:]])
            yield b.slice(i, j - i), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), first


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its documents, distinct tokens and their occurrences."""
    task = TaskContext.get().partitionId()
    for n, (b, h, tail, first) in enumerate(_texts(batches, BLOCK)):
        kind, at, token = np.unique(h, return_index=True, return_inverse=True)
        doc = np.repeat(np.arange(b.num_rows), np.diff(first))
        trains = b.column("trains").to_numpy(zero_copy_only=False)
        count = np.bincount(token[trains[doc]], minlength=len(kind))
        pair, times = np.unique(doc * len(kind) + token, return_counts=True)
        ptr = np.searchsorted(pair, np.arange(b.num_rows + 1) * len(kind))
        row = [(task << 32) + n, b.column("k").to_numpy().astype(np.int64).tobytes(), kind.tobytes(), tail[at].tobytes(),
               count.astype(np.uint32).tobytes(), ptr.astype(np.uint32).tobytes(),
               (pair % len(kind)).astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v]) if i == 0 else pa.array([v], pa.binary()) for i, v in enumerate(row)],
                                         ["block", "k", "h", "tail", "count", "ptr", "token", "times"])


def _requests(buckets: int):
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0 ** 64 / buckets)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h, tail, count = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("h", np.uint64), ("tail", np.uint8), ("count", np.uint32)))
                cut = np.r_[0, np.searchsorted(h, edges), len(h)]
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([b.column("block")[i].as_py()] * len(some), pa.int64()),
                     *[pa.array([v[cut[s]:cut[s + 1]].tobytes() for s in some], pa.binary()) for v in (h, tail, count)]],
                    ["bucket", "block", "h", "tail", "count"])

    return run


def _answers(n_heads: int):
    def run(g: pa.Table) -> pa.Table:
        """kind 0: a block's counts; 1: a tail cell's counts; 2: a frequent word."""
        hs = [np.frombuffer(v.as_py(), np.uint64) for v in g["h"]]
        h, at, inverse = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
        tail = np.concatenate([np.frombuffer(v.as_py(), np.uint8) for v in g["tail"]])[at]
        total = np.bincount(inverse, np.concatenate([np.frombuffer(v.as_py(), np.uint32) for v in g["count"]])).astype(np.int64)
        cut = np.cumsum([0] + [len(x) for x in hs])
        per_block = [total[inverse[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:])]
        word = h != END
        cell_n, cell_v = np.bincount(tail[word], total[word], TAILS), np.bincount(tail[word & (total > 0)], minlength=TAILS)
        top = np.flatnonzero(word & (total > 0))
        top = top[np.lexsort((h[top], -total[top]))][:n_heads]
        ends = total[~word].sum()
        n, k, c = len(hs), TAILS, len(top)
        z = np.zeros
        return pa.table({
            "kind": np.r_[z(n), np.ones(k), np.full(c, 2), 3].astype(np.int32),
            "block": pa.concat_arrays([g["block"].combine_chunks(), pa.array(z(k + c + 1, np.int64))]),
            "bucket": pa.concat_arrays([g["bucket"].combine_chunks(), pa.array(z(k + c + 1, np.int32))]),
            "counts": pa.array(per_block + [None] * (k + c + 1), pa.binary()),
            "cell": np.r_[z(n), np.arange(k), tail[top], CELLS - 1].astype(np.int32),
            "h": np.r_[z(n + k, np.uint64), h[top], END].view(np.int64),
            "n": np.r_[z(n), cell_n, total[top], ends].astype(np.int64),
            "v": np.r_[z(n), cell_v, np.ones(c), ends > 0].astype(np.int64)})

    return run


class LanguageModel:
    """Counts, weights and scores of one corpus."""

    def __init__(self, df: DataFrame, trains: Column, id_col: str = "doc_id", text: str = "text", rounds: int = 2,
                 rate: float = 0.4, batch: int = 16384, alpha: float = 0.1, seed: int = 1):
        self.spark, self.alpha, self.rounds, self.rate, self.batch, self.seed = df.sparkSession, alpha, rounds, rate, batch, seed
        t = F.coalesce(F.col(text), F.lit(""))
        self.docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), t).alias("k"), t.alias("text"), trains.alias("trains"))
        self.blocks = stored(self.docs.select("k", "text", "trains").mapInArrow(
            _blocks, "block long, k binary, h binary, tail binary, count binary, ptr binary, token binary, times binary"), "op6-blocks")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        n_heads = CELLS - TAILS - 1
        self.answers = stored(
            self.blocks.select("block", "h", "tail", "count")
            .mapInArrow(_requests(buckets), "bucket int, block long, h binary, tail binary, count binary")
            .groupBy("bucket").applyInArrow(_answers(n_heads), "kind int, block long, bucket int, counts binary, cell int, h long, n long, v long"), "op6-answers")
        by_cell = self.answers.where("kind in (1, 3)").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # a row per cell
        top = self.answers.where("kind = 2").orderBy(F.desc("n"), "h").limit(n_heads).collect()
        self.cell_n, self.cell_v = np.zeros(CELLS), np.zeros(CELLS)
        for r in by_cell:
            self.cell_n[r["cell"]], self.cell_v[r["cell"]] = r["n"], r["v"]
        self.n, self.v = int(self.cell_n.sum()), int(self.cell_v.sum())
        top = sorted(top, key=lambda r: r["h"] & ((1 << 64) - 1))
        heads = np.array([r["h"] for r in top], np.int64).view(np.uint64)
        for i, r in enumerate(top):  # a frequent word leaves its tail cell
            self.cell_n[r["cell"]] -= r["n"]
            self.cell_v[r["cell"]] -= 1
            self.cell_n[TAILS + i], self.cell_v[TAILS + i] = r["n"], 1
        self.model = Model(heads, self.cell_n)

    def train(self) -> None:
        batch, rate, slices = self.batch, self.rate, 16
        for r in range(self.rounds):
            model = self.model

            def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                power, n = [np.zeros(len(model.w1), np.float32), np.zeros(len(model.w2), np.float32)], 0
                for _, h, tail, first in _texts(batches, CHUNK):
                    cell = cells(h, tail, model.heads)
                    x = contexts(h, first)
                    for a in range(0, len(h), batch):
                        model.learn(x[a:a + batch], cell[a:a + batch], power, rate)
                    n += len(h)
                if n:
                    parts = [s.astype(np.float64).ravel() * n for w in (model.w1, model.w2) for s in np.array_split(w, slices // 2)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices, dtype=np.int32)), pa.array([float(n)] * slices),
                                                      pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], ["slice", "n", "w"])

            def mean(g: pa.Table) -> pa.Table:
                total = np.zeros(len(g["w"][0].as_py()) // 4)
                for w in g["w"]:
                    total += np.frombuffer(w.as_py(), np.float32)
                return pa.table({"slice": g["slice"][:1], "w": pa.array([(total / np.sum(g["n"].to_numpy())).astype(np.float32).tobytes()], pa.binary())})

            share = self.docs.where(F.col("trains") & (F.pmod(F.xxhash64("k", F.lit(self.seed)), F.lit(self.rounds)) == r)).select("text")
            got = (share.mapInArrow(steps, "slice int, n double, w binary").groupBy("slice").applyInArrow(mean, "slice int, w binary").collect())
            if got:  # slices of tables of fixed size
                flat = [np.frombuffer(x["w"], np.float32) for x in sorted(got, key=lambda x: x["slice"])]
                new = Model(model.heads, self.cell_n)
                new.w1 = np.concatenate(flat[:slices // 2]).reshape(model.w1.shape)
                new.w2 = np.concatenate(flat[slices // 2:]).reshape(model.w2.shape)
                self.model = new

    def scores(self) -> DataFrame:
        """(k, n_tokens, n_known, base_score, score), one row per document."""
        alpha, model = self.alpha, self.model
        base = np.log10(self.n + alpha * (self.v + 1))
        inside = np.log10(self.cell_n + alpha * (self.cell_v + 1))
        inside[CELLS - 1] = np.log10(self.cell_n[CELLS - 1] + alpha)  # the end is never unknown
        inside[TAILS:CELLS - 1] = np.log10(self.cell_n[TAILS:CELLS - 1] + alpha)

        def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, h, tail, first in _texts(batches, CHUNK):
                cell = cells(h, tail, model.heads)
                x = contexts(h, first)
                p = np.concatenate([model.log10(x[a:a + 16384], cell[a:a + 16384]) for a in range(0, len(h), 16384)])
                total = np.r_[0, np.cumsum(p - inside[cell])]
                yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(np.diff(total[first]))], ["k", "context"])

        def counted(block: pa.Table, answers: pa.Table) -> pa.Table:
            order = np.argsort(answers["bucket"].to_numpy())
            c = np.concatenate([np.frombuffer(answers["counts"][int(i)].as_py(), np.int64) for i in order]) if len(order) else np.empty(0, np.int64)
            k, ptr, token, times = (np.frombuffer(block[n][0].as_py(), t) for n, t in (("k", np.int64), ("ptr", np.uint32), ("token", np.uint32), ("times", np.uint32)))
            log, known = np.log10(c + alpha)[token] * times, (c > 0)[token] * times.astype(np.int64)

            def by_doc(v):
                return np.diff(np.r_[0, np.cumsum(v)][ptr])

            return pa.table({"k": k, "n_tokens": by_doc(times.astype(np.int64)), "n_known": by_doc(known), "logs": by_doc(log)})

        mine = (self.blocks.select("block", "k", "ptr", "token", "times").groupBy("block")
                .cogroup(self.answers.where("kind = 0").select("block", "bucket", "counts").groupBy("block"))
                .applyInArrow(counted, "k long, n_tokens long, n_known long, logs double").dropDuplicates(["k"]))
        ctx = self.docs.select("k", "text").mapInArrow(context, "k long, context double").dropDuplicates(["k"])
        return mine.join(ctx, "k").select("k", "n_tokens", "n_known", (F.col("logs") - F.col("n_tokens") * float(base)).alias("base_score"),
                                          (F.col("logs") + F.col("context")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    lm = LanguageModel(docs, ~held)
    lm.train()
    return (lm.docs.select(F.col("id").alias("doc_id"), "k", (~F.col("trains")).alias("held_out")).join(lm.scores(), "k")
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(lm.n).cast("long").alias("train_tokens"), "base_score", "score"))
