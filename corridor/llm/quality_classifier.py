"""Operator 1: document quality by random Fourier features.

Statistics of a whole text (lengths, shares of capitals, symbols, repeated
words, ...) are standardised and mapped to ``n_features`` random cosines,
whose products approximate a Gaussian kernel.  Ridge regression on them needs
only the normal equations: every partition sums its own, Spark adds the sums
by matrix row, and the driver solves a system of fixed size.  The equations
are kept per fold, so each fold is scored by a fit without it; these
out-of-fold scores, counted in ``n_bins`` bins, calibrate the score by
isotonic regression.

Scale: one pass over the texts, whose statistics (a few floats a document)
are stored once; all later passes read only those.  The driver receives
matrices and bins of fixed size whatever the corpus.

Defined results: a null or empty text has all-zero statistics and is scored
like any other; rows with a null label do not train, several labels of one
doc_id count by their mean; repeated rows score alike; with no label at all
every score is 0.5; an empty table gives an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._store import stored, table

STATS = ("log_words", "log_bytes", "word_bytes", "word_bytes_sd", "capitals", "shouted", "symbols", "bars",
         "exclaims", "stops", "digits", "non_ascii", "distinct", "stutter", "lines", "short_words")


def text_stats(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of ``STATS`` for each text."""
    start, end, first = B.spans(data, offs)
    n = np.diff(first).astype(float)
    size = np.diff(offs).astype(float)
    per_word, per_byte = 1 / np.maximum(n, 1), 1 / np.maximum(size, 1)

    def by_text(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1)
        np.cumsum(values, out=total[1:])
        return np.diff(total[cuts])

    upper = (data >= 65) & (data <= 90)
    letters = by_text(upper | ((data >= 97) & (data <= 122)), offs)
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))
    h = B.hashes(data, start, end)
    length = (end - start).astype(float)
    text_of = np.repeat(np.arange(len(n)), np.diff(first))
    # distinct words: hashes salted by their text, so that one sort serves all texts
    salted = h ^ B.mix(text_of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(salted)
    new = np.ones(len(h), bool)
    new[1:] = salted[order][1:] != salted[order][:-1]
    distinct = np.bincount(text_of[order][new], minlength=len(n)).astype(float)
    stutter = np.zeros(len(h))
    stutter[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
    mean = by_text(length, first) * per_word
    sd = np.sqrt(np.maximum(by_text(length * length, first) * per_word - mean * mean, 0))
    all_upper = upper[start] & upper[np.minimum(start + 1, end - 1)] & (length > 1) if len(start) else upper[:0]
    return np.stack([
        np.log1p(n), np.log1p(size), np.log1p(mean), np.log1p(sd),
        by_text(upper, offs) / np.maximum(letters, 1), by_text(all_upper, first) * per_word,
        np.sqrt(by_text(symbol, offs) * per_word), np.sqrt(by_text(data == 124, offs) * per_word),
        np.sqrt(by_text(data == 33, offs) * per_word), np.sqrt(by_text(data == 46, offs) * per_word),
        np.sqrt(by_text((data >= 48) & (data <= 57), offs) * per_byte), by_text(data >= 128, offs) * per_byte,
        distinct * per_word, by_text(stutter, first) * per_word,
        np.sqrt(by_text(data == 10, offs) * per_word), by_text(length <= 2, first) * per_word], axis=1)


def with_stats(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, stats) of each row of ``df``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.flat(batch.column(1))
            for i, j in B.pieces(offs):
                x = text_stats(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                stats = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), stats], ["_id", "_x"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).mapInArrow(run, f"_id {kind}, _x array<double>")


class Fourier:
    """The random map; seeded, so every task draws the same one."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, n_features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.normal(size=(len(mean), n_features)) / width
        self.b = rng.uniform(0, 2 * np.pi, n_features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -4, 4)
        return np.c_[np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(x))]


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def classify(df: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text: str = "text",
             label: str = "quality", n_features: int = 256, width: float = 4.0, ridge: float = 1e-3,
             folds: int = 4, n_bins: int = 1000, seed: int = 7) -> DataFrame:
    """(id, score) of each row of ``df``; ``labels`` has (id, label), of which
    only rows where ``trains`` (on the id column) holds are used."""
    x = stored(with_stats(df, id_col, text), "op1-stats")
    y = (labels.where(trains & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id"))
         .agg(F.avg(F.col(label).cast("double")).alias("_y")))
    fold = F.pmod(F.xxhash64(F.col("_id"), F.lit(seed)), F.lit(folds)).cast("int")
    train = stored(x.join(y, "_id").select("_x", "_y", fold.alias("_f")), "op1-train")
    d = len(STATS)
    moments = train.agg(F.count("_y").alias("n"), *[F.avg(F.col("_x")[i]).alias(f"m{i}") for i in range(d)],
                        *[F.stddev_pop(F.col("_x")[i]).alias(f"s{i}") for i in range(d)]).first()
    if not moments["n"]:
        return x.select(F.col("_id").alias(id_col), F.lit(0.5).alias("score"))
    to = Fourier(np.array([moments[f"m{i}"] for i in range(d)]), np.array([moments[f"s{i}"] for i in range(d)]),
                 n_features, width, seed)
    size = n_features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, size, size + 1))
        for b in batches:
            if not b.num_rows:
                continue
            z, t, f = to(matrix(b.column(0))), b.column(1).to_numpy(), b.column(2).to_numpy()
            for k in range(folds):
                zk = z[f == k]
                total[k] += zk.T @ np.c_[zk, t[f == k]]
        rows = [(k * size + i, total[k, i].tobytes()) for k in range(folds) if total[k].any() for i in range(size)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                          pa.array([r[1] for r in rows], pa.binary())], ["k", "v"])

    def add(g):
        total = np.sum([np.frombuffer(v) for v in g["v"]], axis=0)
        return g.head(1).assign(v=[total.tobytes()])

    sums = np.zeros((folds * size, size + 1))
    for r in train.mapInArrow(equations, "k int, v binary").groupBy("k").applyInPandas(add, "k int, v binary").collect():
        sums[r["k"]] = np.frombuffer(r["v"])  # folds * size rows at most
    sums = sums.reshape(folds, size, size + 1)

    def solve(a: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a[:, :-1] + (ridge * max(a[-1, -2], 1.0) + 1e-6) * np.diag(np.r_[np.ones(size - 1), 1e-6]), a[:, -1])

    whole = sums.sum(axis=0)
    beta = solve(whole)
    without = np.stack([solve(whole - sums[k]) for k in range(folds)])
    low, high = -0.5, 1.5

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f = b.column(2).to_numpy()
                raw = np.einsum("ij,ij->i", to(matrix(b.column(0))), without[f])
                at = np.clip((raw - low) / (high - low) * n_bins, 0, n_bins - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], ["bin", "y"])

    bins = sorted(train.mapInArrow(out_of_fold, "bin int, y double").groupBy("bin")
                  .agg(F.count("y").alias("n"), F.avg("y").alias("y")).collect())  # n_bins rows at most
    # two weak observations keep the ends off 0 and 1
    n = np.array([b["n"] for b in bins], float)
    fit = isotonic(np.array([(b["y"] * b["n"] + 0.02) / (b["n"] + 0.04) for b in bins]), n)
    at = low + (np.array([b["bin"] for b in bins]) + 0.5) / n_bins * (high - low)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = to(matrix(b.column(1))) @ beta if b.num_rows else np.empty(0)
            # isotonic steps tie many texts; a small share of the raw score keeps their order
            score = 0.98 * np.interp(raw, at, fit) + 0.02 * np.clip((raw - low) / (high - low), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], [id_col, "score"])

    return x.mapInArrow(scored, f"{id_col} {df.schema[id_col].dataType.simpleString()}, score double")


def remainder(id_col: str, mod: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"),
                   table(spark, sf_dir, "labels").select("doc_id", "quality"), remainder("doc_id", 4) != 2)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
                      "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
