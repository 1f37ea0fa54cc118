"""Operator 10: best-two-fit packing of token sequences.

Documents are tokenised inside tasks, one pass over the texts; only piece
lengths and checksums leave them.  Pieces are dealt to groups of about
``group_pieces`` by a hash of their number, and each group is packed on its own: bins are
filled greedily with the longest piece that fits; then the bin's smallest
piece is given back if two unpacked pieces fit the widened gap more tightly.
A group of n pieces of any lengths costs about n steps, and at most a few of
its sequences stay unfilled, so many groups cost next to nothing in
sequences; more documents make more groups, not larger ones.

Only documents longer than ``capacity`` are cut, into whole sequences, the
remainder first.

Defined results: a null or empty text is its end token alone; white space of
any length gives the ids of the tokenizer's own file; repeated rows are packed
each on its own and spread over the groups; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import stored, table

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """A byte-level BPE of a ``tokenizers`` JSON file, run by tiktoken, which
    gives the same ids several times as fast."""
    if path not in _ENCODERS:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # GPT-2's printable stand-ins for bytes, fixed by the file format
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _ENCODERS[path] = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


# The characters that the pattern above takes as white space.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def encoded(enc, text: str) -> Iterator[np.ndarray]:
    """The text's ids, in parts.  Long white space is too much for the
    pattern's look-ahead, so it is cut by hand as the pattern would: all of it
    at the text's end, else all but its last character, which goes on with the
    word behind it."""
    at = 0
    for m in BLANKS.finditer(text):
        yield enc.encode_to_numpy(text[at:m.start()], allowed_special="all")
        at = m.end() if m.end() == len(text) else m.end() - 1
        yield np.array(enc._encode_single_piece(text[m.start():at]), np.uint32)
    yield enc.encode_to_numpy(text[at:], allowed_special="all")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenised(df: DataFrame, capacity: int, vocabulary: str, end_id: int, id_col: str, text: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for each piece of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, t in enumerate(batch.column(1)):
                ids = np.concatenate(list(encoded(enc, t.as_py() or ""))).astype("<u4").tobytes() + end
                n = len(ids) // 4
                at, i = 0, 0
                while at < n:
                    size = n % capacity or capacity if at == 0 else capacity
                    row.append(k)
                    piece.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at:4 * (at + size)]))
                    at, i = at + size, i + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(
        run, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long")


class Stock:
    """Unpacked pieces by length; the lengths at hand are the bits of one
    integer, so the longest that fits is found without a scan."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.capacity = capacity
        self.count = np.bincount(lengths, minlength=capacity + 1).tolist()
        self.up = sum(1 << n for n in range(1, capacity + 1) if self.count[n])
        self.down = sum(1 << (capacity - n) for n in range(1, capacity + 1) if self.count[n])

    def longest(self, most: int) -> int:
        """0: none."""
        return max(0, (self.up & ((2 << most) - 1)).bit_length() - 1)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.up &= ~(1 << n)
            self.down &= ~(1 << (self.capacity - n))

    def give(self, n: int) -> None:
        self.count[n] += 1
        self.up |= 1 << n
        self.down |= 1 << (self.capacity - n)

    def two(self, most: int, least: int) -> tuple[int, int] | None:
        """Two pieces of ``least`` to ``most`` together, the most it can."""
        for total in range(most, least - 1, -1):
            pairs = self.up & (self.down >> (self.capacity - total)) & ((1 << (total // 2 + 1)) - 1)
            while pairs:
                a = pairs.bit_length() - 1
                if a and (2 * a < total or self.count[a] > 1):
                    return a, total - a
                pairs ^= 1 << a
        return None


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of lengths."""
    stock, bins = Stock(lengths, capacity), []
    while longest := stock.longest(capacity):
        stock.take(longest)
        held, gap = [longest], capacity - longest
        while n := stock.longest(gap):
            stock.take(n)
            held.append(n)
            gap -= n
        if gap and len(held) > 1:
            smallest = min(held)
            if pair := stock.two(gap + smallest, smallest + 1):
                for n in pair:
                    stock.take(n)
                held.remove(smallest)
                stock.give(smallest)
                held += pair
        bins.append(held)
    return bins


def pack(df: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0,
         id_col: str = "doc_id", text: str = "text", group_pieces: int = 16384) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenised(df, capacity, vocabulary or default_vocabulary(), end_id, id_col, text)
    pieces = stored(pieces.withColumn("_r", F.monotonically_increasing_id()), "op10-pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # by number, so that repeated rows and a long text's pieces are dealt out one by one
    group = F.pmod(F.xxhash64("_r"), F.lit(groups)).cast("int")

    def run(g: pa.Table) -> pa.Table:
        g = g.take(pa.array(np.argsort(g["length"].to_numpy(), kind="stable")))
        lengths = g["length"].to_numpy()
        at = np.searchsorted(lengths, np.arange(capacity + 2)).tolist()  # next unplaced piece of each length
        seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        first = g["_g"][0].as_py() << 32
        for b, held in enumerate(best_two_fit(lengths, capacity)):
            place = 0
            for n in held:
                seq[at[n]], off[at[n]] = first + b, place
                at[n] += 1
                place += n
        return g.drop_columns(["_g"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    kind = df.schema[id_col].dataType.simpleString()
    return pieces.withColumn("_g", group).drop("_r").groupBy("_g").applyInArrow(
        run, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
