"""Operator 13: benchmark decontamination by suffix arrays of the training text.

Each batch of documents is a shard.  Its words become numbers of the
benchmark's vocabulary (0: a word that the benchmark lacks, which no match
crosses), and the places from which a match can start are sorted by the words
that follow: the shard's suffix array, without the suffixes that begin with an
unknown word or with two words that never follow one another in the benchmark.
Every suffix of every item is searched in it by bisection; equal suffixes are
searched once.  The places found are the occurrences of the item's windows;
those that follow one another in document and item join up to the longest
verbatim matches (``matches``).

Documents never move: each task scans its own shards, and a row leaves per
document.  What travels is the benchmark, in blocks of at most ``block_chars``
characters of whole items; each block is one broadcast and one pass over the
documents.  An index of a shard of ``shard_bytes`` bytes takes some ten times
that; a longer document is a shard of its own.

A window is ``width`` consecutive item words; an item of fewer words, but not
none, is one window.

Defined results: a null or empty text has no words and no hits; a null
item_id reads as an empty one; items of one id count once; repeated rows are
judged alike, each for itself; an empty benchmark hits nothing and an empty
table gives an empty result; extra columns pass through ``decontaminate`` and
are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes
from ._store import stored, table

WIDTH = 10
BLOCK_CHARS = 8 << 20
SHARD_BYTES = 4 << 20


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and for each text the number of its first."""
    low = _bytes.lowered(data)
    word = (low >= 0x80) | ((low >= 0x30) & (low <= 0x39)) | ((low >= 0x61) & (low <= 0x7A))
    start, end, first = _bytes.spans(low, offs, word)
    return _bytes.hashes(low, start, end), first


class Items:
    """The suffixes of a block of benchmark items, ready for the search."""

    def __init__(self, ids: list[str], texts: list[str | None], width: int = WIDTH):
        self.width, self.ids = width, list(ids)
        self.names = np.array(sorted(set(ids)), object)
        number = {x: i for i, x in enumerate(self.names)}
        data, offs = _bytes.flat(pa.array(texts, pa.large_string()))
        hashes, first = _words(data, offs)
        self.vocabulary = np.unique(hashes)
        self.lengths = np.diff(first)
        word = np.r_[np.searchsorted(self.vocabulary, hashes) + 1, np.zeros(width, np.int64)].astype(">u4")
        # a suffix per place that a window starts at; a short item has one
        n_windows = np.where(self.lengths == 0, 0, np.maximum(self.lengths - width + 1, 1))
        self.item_of = np.repeat(np.arange(len(ids)), n_windows)
        self.place = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        start = first[:-1][self.item_of] + self.place if len(ids) else np.empty(0, np.int64)
        self.length = np.minimum(width, self.lengths[self.item_of]) if len(ids) else np.empty(0, np.int64)
        rows = word[start[:, None] + np.arange(width)]
        rows[np.arange(width) >= self.length[:, None]] = 0
        self.rows, self.suffix_of = np.unique(rows.reshape(-1, width), axis=0, return_inverse=True)
        self.suffix_of = self.suffix_of.reshape(-1)
        self.rows = self.rows.astype(">u4")
        self.row_length = (self.rows != 0).sum(axis=1)
        # the items of each distinct suffix, by number of its id
        item_name = np.array([number[x] for x in ids], np.int64)
        pairs = np.unique(np.c_[self.suffix_of, item_name[self.item_of]], axis=0) if len(self.suffix_of) else np.empty((0, 2), np.int64)
        self.item_names, self.item_cut = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        two = self.rows[:, 1].astype(np.uint64) if width > 1 else np.zeros(len(self.rows), np.uint64)
        self.pairs = np.unique((self.rows[:, 0].astype(np.uint64) << np.uint64(32)) | two) if len(self.rows) else np.empty(0, np.uint64)
        self.single = self.row_length.min(initial=2) < 2

    def occurrences(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word of each text, places, distinct suffixes found there):
        a place is a word of the shard."""
        hashes, first = _words(data, offs)
        none = np.empty(0, np.int64)
        if not len(hashes) or not len(self.rows):
            return first, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        word = np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint64)
        known = np.flatnonzero(word)
        # no suffix runs on into the next text
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        after = np.r_[np.where(text[1:] == text[:-1], word[1:], 0), np.uint64(0)].astype(np.uint64)
        key = (word[known] << np.uint64(32)) | after[known]
        near = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
        if self.single:
            near |= np.isin(word[known] << np.uint64(32), self.pairs)
        place = known[near]
        if not len(place):
            return first, none, none
        padded = np.r_[word, np.zeros(self.width, np.uint64)].astype(">u4")
        rows = padded[place[:, None] + np.arange(self.width)]
        rows[place[:, None] + np.arange(self.width) >= first[text[place] + 1][:, None]] = 0
        kind = f"S{4 * self.width}"
        keys = np.ascontiguousarray(rows).view(kind).ravel()
        order = np.argsort(keys, kind="stable")  # the suffix array
        place, keys = place[order], keys[order]
        lo = np.searchsorted(keys, np.ascontiguousarray(self.rows).view(kind).ravel(), "left")
        # a suffix of fewer words ends where its last word is raised by one
        bound = self.rows.copy()
        last = np.maximum(self.row_length - 1, 0)
        bound[np.arange(len(bound)), last] += 1
        hi = np.searchsorted(keys, np.ascontiguousarray(bound).view(kind).ravel(), "left")
        n = hi - lo
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return first, place[np.repeat(lo, n) + inside], np.repeat(np.arange(len(n)), n)

    def of_texts(self, column: pa.Array, shard_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each shard of a column: (words before each text, text of each
        occurrence, its place in the text, its distinct suffix)."""
        data, offs = _bytes.flat(column)
        for i, j in _bytes.pieces(offs, shard_bytes):
            first, place, row = self.occurrences(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            text = np.searchsorted(first, place, "right") - 1
            yield first, text, place - first[text], row

    def found(self, rows: np.ndarray) -> np.ndarray:
        """The ids' numbers of the items that hold any of these suffixes."""
        rows = np.unique(rows)
        return np.unique(np.concatenate([self.item_names[self.item_cut[r]:self.item_cut[r + 1]] for r in rows]))


def covered(place: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Spans [start, end) that the windows cover together, in order."""
    if not len(place):
        return []
    order = np.argsort(place, kind="stable")
    s, e = place[order], np.maximum.accumulate((place + length)[order])
    cut = np.flatnonzero(s[1:] > e[:-1])
    return list(zip(s[np.r_[0, cut + 1]].tolist(), e[np.r_[cut, len(e) - 1]].tolist()))


def _blocks(items: DataFrame, id_col: str, text_col: str, width: int, block_chars: int) -> Iterator[Items]:
    """The benchmark in blocks whose size is bounded, whatever its own."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    total = rows.agg(F.sum(F.length("t") + F.length("i"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        yield Items([r["i"] for r in part], [r["t"] for r in part], width)


def _judge(items, shard_bytes: int):
    """Per document row: words, spans that are hit and the items found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = items.value
        for b in batches:
            n_words, hit, names = [], [], []
            for first, text, place, row in it.of_texts(b.column(1), shard_bytes):
                n_words.append(np.diff(first))
                order = np.argsort(text, kind="stable")
                cut = np.searchsorted(text[order], np.arange(len(first)))
                for k in range(len(first) - 1):
                    at = order[cut[k]:cut[k + 1]]
                    hit.append([{"s": s, "e": e} for s, e in covered(place[at], it.row_length[row[at]])] if len(at) else [])
                    names.append(it.names[it.found(row[at])].tolist() if len(at) else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                 pa.array(hit, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(names, pa.list_(pa.string()))],
                ["row", "n_words", "hit", "names"])
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and digest from spans and names of one or several passes."""
    for b in batches:
        n_hit, n_items, digest = [], [], []
        for spans, names in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            spans = [x for part in spans for x in part]
            s, e = np.array([x["s"] for x in spans], np.int64), np.array([x["e"] for x in spans], np.int64)
            n_hit.append(sum(y - x for x, y in covered(s, e - s)))
            ids = sorted({x for part in names for x in part})
            n_items.append(len(ids))
            digest.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string())],
            ["row", "n_words", "n_hit", "n_items", "items_sha256"])


_PASS = "row {0}, n_words long, hit array<struct<s:long,e:long>>, names array<string>"
_DONE = "row {0}, n_words long, n_hit long, n_items long, items_sha256 string"


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", width: int = WIDTH, block_chars: int = BLOCK_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row.

    One block of items needs no shuffle.  With several, each pass leaves the
    spans that it hit per row, and a row's spans meet in one aggregate."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    blocks = _blocks(items, item_id, item_text, width, block_chars)
    first = next(blocks, None) or Items([], [], width)
    second = next(blocks, None)
    if second is None:
        kind = rows.schema["id"].dataType.simpleString()
        seen = rows.select(F.col("id").alias("row"), "text").mapInArrow(_judge(spark.sparkContext.broadcast(first), shard_bytes), _PASS.format(kind))
        merged = seen.select("row", "n_words", F.array("hit").alias("hit"), F.array("names").alias("names")).mapInArrow(_merge, _DONE.format(kind))
        merged = merged.withColumnRenamed("row", "id")
    else:
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "op13-rows")
        passes, block = [], first
        while block is not None:
            passes.append(stored(rows.select("row", "text").mapInArrow(_judge(spark.sparkContext.broadcast(block), shard_bytes), _PASS.format("long")), "op13-pass"))
            block, second = second, next(blocks, None)
        every = passes[0]
        for p in passes[1:]:
            every = every.unionByName(p.where("size(hit) > 0"))
        merged = (every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.collect_list("hit").alias("hit"), F.collect_list("names").alias("names"))
                  .mapInArrow(_merge, _DONE.format("long")).join(rows.select("row", "id"), "row"))
    return merged.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def _runs(items, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = items.value
        cut = np.searchsorted(np.sort(it.suffix_of), np.arange(len(it.rows) + 1))
        by_row = np.argsort(it.suffix_of, kind="stable")
        for b in batches:
            base = 0
            for first, text, place, row in it.of_texts(b.column(1), shard_bytes):
                n = cut[row + 1] - cut[row]
                who = np.repeat(np.arange(len(row)), n)
                src = by_row[np.repeat(cut[row], n) + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)]
                t, p, j, item, length = text[who], place[who], it.place[src], it.item_of[src], it.length[src]
                order = np.lexsort((p, p - j, item, t))
                t, p, j, item, length = t[order], p[order], j[order], item[order], length[order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (item[1:] != item[:-1]) | (p[1:] - j[1:] != p[:-1] - j[:-1]) | (p[1:] != p[:-1] + 1)
                s = np.flatnonzero(new)
                e = np.r_[s[1:], len(t)] - 1 if len(s) else s
                names = np.array(it.ids, object)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(t[s] + base)), pa.array(p[s]), pa.array(names[item[s]].tolist(), pa.string()), pa.array(j[s]),
                     pa.array(p[e] + length[e] - p[s])], ["row", "start", "item_id", "item_start", "n_words"])
                base += len(first) - 1
    return run


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text", width: int = WIDTH, block_chars: int = BLOCK_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The longest verbatim matches of at least a window: (id, start, item_id,
    item_start, n_words), places counted in words from 0; a match cannot be
    made longer at either end."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("row"), F.col(text).alias("text"))
    schema = f"row {kind}, start long, item_id string, item_start long, n_words long"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, item_id, item_text, width, block_chars):
        found = found.unionByName(rows.mapInArrow(_runs(docs.sparkSession.sparkContext.broadcast(block), shard_bytes), schema))
    return found.withColumnRenamed("row", id_col)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  width: int = WIDTH, block_chars: int = BLOCK_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text no window hits, with all their columns.
    Each block of items takes away the rows that it hits."""
    at = docs.columns.index(text)

    def clean(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep, base = np.ones(b.num_rows, bool), 0
                for first, hit, _, _ in items.value.of_texts(b.column(at), shard_bytes):
                    keep[base + hit] = False
                    base += len(first) - 1
                yield b.filter(pa.array(keep))
        return run

    for block in _blocks(items, item_id, item_text, width, block_chars):
        docs = docs.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_W = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

SQL = rf"""
with docs as (select row_number() over () r, doc_id, coalesce({_W}, []) ws from documents),
items as (select distinct coalesce(item_id::varchar, '') item, {_W} ws from benchmark where text is not null),
windows as (
  select distinct item, list_slice(ws, i, i + least({WIDTH}, len(ws)) - 1) win
  from items, unnest(range(1, greatest(len(ws) - {WIDTH - 1}, 1) + 1)) g(i) where len(ws) > 0),
lengths as (select distinct len(win) n from windows),
found as (
  select r, i, n, item from (
    select r, i, n, list_slice(ws, i, i + n - 1) win from docs, lengths, unnest(range(1, len(ws) - n + 2)) g(i) where len(ws) >= n)
  join windows using (win)),
hit as (select r, count(distinct p) n from found, unnest(range(i, i + n)) g(p) group by r),
named as (select r, count(*) n, string_agg(item, ',' order by item) ids from (select distinct r, item from found) group by r)
select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(hit.n, 0) as bigint) n_hit, cast(coalesce(named.n, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated
from docs left join hit using (r) left join named using (r)
"""
