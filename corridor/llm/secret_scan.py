"""Operator 9: secrets by a linear-chain conditional random field.

A text's tokens (runs of ``[A-Za-z0-9+/_.=-]`` and non-ASCII bytes) get the
tags outside, begin or inside.  A token's emission is a sum of table entries
for its shape (length, digits, capitals, changes of character class, entropy,
known prefixes), its neighbouring words (a key word shortly before it,
assignment and quote marks around it) and its file (assignments per line,
size); transitions join the tags of neighbours.  The field is fitted by
gradient steps on windows around tokens that the fixed patterns mark and
others that look alike, from a sample of about ``fit_docs`` distinct texts and
``fit_windows`` distinct windows chosen by hash; every text is then scanned
whole.  Windows reach over a text's borders, with outside tags there, so short
texts teach as well.

A field that sees the patterns' evidence learns the patterns.  So each window
with a secret is learned again with evidence hidden in turn: the key word, the
hexadecimal shape, the prefix, the marks around it, its length and letters.
What is left, a long random string among words, is what secrets share that no
pattern covers.

Decoding is exact Viterbi.  Where tag O's emission beats the others by more
than any transitions could return, O is certain, so only the stretches
between such tokens are decoded step by step.

The patterns' own spans always stay; the field adds spans that none of them
covers.  Everything is local to a row: no shuffle but the bounded sample.

Defined results: a null or empty text has no spans; repeated rows get the
same spans; where no text has a span of the patterns there is nothing to learn
from, and the field adds none; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations


import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._store import table

# The patterns, in the order of their kinds, and the shortest match.
ASSIGN = rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey", b"credential", b"auth")
PREFIXES = (b"AKIA", b"ghp_", b"sk-", b"xox", b"eyJ", b"AIza")

#: The number of values of each feature, in the order of ``features``.
SIZES = (8, 5, 4, 5, 2, 2, 2, 2, 2, 2, 2, 2, 3, 3, 6, 2)
REACH = 3  # tokens on either side of a window's middle
HEXES, KEY, PREFIX, KEY_BEFORE, ASSIGNED, QUOTE, KEY_NEAR = 4, 6, 7, 8, 9, 10, 15
LENGTH, DIGITS, UPPER, CHANGES, ENTROPY = 0, 1, 2, 3, 14
_AROUND = {KEY: 0, KEY_BEFORE: 0, KEY_NEAR: 0, ASSIGNED: 0, QUOTE: 0}
#: Evidence that is hidden in turn: the features and what they read instead.
#: The last ones are random strings of other lengths and letters.
HIDDEN = ({KEY: 0, KEY_BEFORE: 0, KEY_NEAR: 0}, {HEXES: 0}, {PREFIX: 0}, {ASSIGNED: 0, QUOTE: 0}, _AROUND | {HEXES: 0, PREFIX: 0}) + tuple(
    {HEXES: 0, PREFIX: 0, LENGTH: n, DIGITS: d, UPPER: 2, CHANGES: 4, ENTROPY: 5 if n > 4 else 4} | around
    for n in (4, 5, 6, 7) for d in (1, 2, 3) for around in ({}, _AROUND))


def _classes() -> np.ndarray:
    """0 outside tokens, 1 lower case, 2 upper case, 3 digit, 4 mark, 5 not ASCII."""
    c = np.zeros(256, np.int8)
    c[97:123], c[65:91], c[48:58], c[128:] = 1, 2, 3, 5
    c[list(b"+/_.=-")] = 4
    return c


def _entropy(data: np.ndarray, start: np.ndarray, length: np.ndarray, least: int = 12) -> np.ndarray:
    """A class for the entropy of a token's bytes; 0 for tokens under ``least`` bytes."""
    out = np.zeros(len(start), np.int8)
    long = np.flatnonzero(length >= least)
    if len(long):
        n = length[long]
        who = np.repeat(np.arange(len(long)), n)
        byte = data[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[long], n)]
        pair, times = np.unique(who * 256 + byte, return_counts=True)
        share = times / n[pair >> 8]
        bits = np.bincount(pair >> 8, -share * np.log2(share), len(long))
        out[long] = 1 + np.searchsorted((2.8, 3.25, 3.6, 4.0), bits, side="right")
    return out


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, first token of each text, and a row of feature values per token."""
    kind = _classes()[data]
    start, end, first = B.spans(data, offs, kind > 0)
    n = len(start)
    if not n:
        return start, end, first, np.empty((0, len(SIZES)), np.int8)
    length = end - start

    def inside(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[end] - total[start]

    def after(values: np.ndarray, by: int, fill=0) -> np.ndarray:
        """Each token's neighbour ``by`` places before it, within its text."""
        out = np.full(n, fill, values.dtype)
        ok = np.arange(n) - by
        ok = (ok >= first[text_of]) & (ok < first[text_of + 1])
        out[ok] = values[np.flatnonzero(ok) - by]
        return out

    text_of = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    digits, upper, high = inside(kind == 3), inside(kind == 2), inside(kind == 5)
    hexes = inside((kind == 3) | ((data >= 97) & (data <= 102)))
    change = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind[1:] != kind[:-1], out=change[1:-1])
    change[-1] = change[-2] if len(data) > 1 else 0
    changes = change[end - 1] - change[start]
    lower = B.lowered(data)
    total = B.running(lower)
    key = np.zeros(n, bool)
    for size in sorted({len(k) for k in KEYWORDS}):
        known = np.frombuffer(b"".join(k for k in KEYWORDS if len(k) == size), np.uint8)
        at = np.arange(0, len(known), size)
        fits = np.flatnonzero(length >= size)
        key[fits] |= np.isin(B.hashes(lower, end[fits] - size, end[fits], total), B.hashes(known, at, at + size))
    prefix = np.zeros(n, bool)
    raw = B.running(data)
    for p in PREFIXES:
        fits = np.flatnonzero(length >= len(p) + 8)
        one = np.frombuffer(p, np.uint8)
        prefix[fits] |= B.hashes(data, start[fits], start[fits] + len(p), raw) == B.hashes(one, np.array([0]), np.array([len(p)]))[0]
    inner = np.concatenate([[0], data, [0]])
    before, behind = inner[start], inner[end + 1]
    before2 = inner[np.maximum(start - 1, 0)]
    quote = np.isin(before, (34, 39)) | np.isin(behind, (34, 39))
    mark = (length <= 2) & ((data[start] == 61) | (data[end - 1] == 61))  # a lone "="
    assigned = after(mark, 1) | np.isin(before, (58,)) | np.isin(before2, (58, 61))
    key_before = np.where(after(mark, 1), after(key, 2), after(key, 1))
    share = digits / length
    equals = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data == 61) | (data == 59) | (data == 123), out=equals[1:])
    codelike = np.diff(equals[offs]) / np.maximum(np.diff(offs), 1)
    out = np.stack([
        np.searchsorted((4, 8, 12, 16, 20, 32, 64), length, side="right"),
        np.searchsorted((1e-9, 0.15, 0.4, 0.95), share, side="right"),
        np.searchsorted((1e-9, 0.3, 0.8), upper / length, side="right"),
        np.searchsorted((1, 3, 6, 10), changes, side="right"),
        (hexes == length) & (digits > 0) & (digits < length),
        high > 0,
        key,
        prefix,
        key_before,
        assigned,
        quote,
        after(length, -1) >= 16,
        np.searchsorted((0.002, 0.02), codelike, side="right")[text_of],
        np.searchsorted((500, 5000), np.diff(offs), side="right")[text_of],
        _entropy(data, start, length),
        after(key, 1) | after(key, 2) | after(key, 3) | after(key, 4)], axis=1).astype(np.int8)
    return start, end, first, out


def base_spans(text: bytes) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, value start, value end) in bytes of the patterns' matches."""
    out = [(0, m.start(), m.end(), *m.span(2)) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
    out += [(1, *m.span(), *m.span()) for m in re.finditer(ACCESS, text) if len(m[0]) >= 16]
    return out + [(2, *m.span(), *m.span()) for m in re.finditer(HEX, text) if len(m[0]) >= 32]


class Field:
    """Tables of emissions, transitions and first tags; tags O, B, I."""

    def __init__(self):
        self.emit = np.zeros((sum(SIZES), 3))
        self.move = np.zeros((3, 3))
        self.base = np.cumsum((0,) + SIZES[:-1])

    def emissions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 3))
        for f, at in enumerate(self.base):
            out += self.emit[at:at + SIZES[f]][x[:, f]]
        return out

    def fit(self, x: np.ndarray, tags: np.ndarray, weight: np.ndarray, steps: int = 200, rate: float = 0.1,
            decay: float = 1e-3, batch: int = 2048, seed: int = 1) -> None:
        """Adam on the mean log-likelihood of windows (windows, tokens,
        features), with evidence hidden in turn; a step takes ``batch`` windows,
        drawn by weight.  Places beyond a text's borders have features -1;
        their tag is outside and teaches nothing."""
        secret = (tags > 0).any(axis=1)
        copies = [(x, tags, np.where(secret, weight, weight * (1 + len(HIDDEN))))]
        for hide in HIDDEN:
            y = x[secret].copy()
            for f, value in hide.items():
                at = (y[..., f] >= 0) & ((tags[secret] > 0) | (f in _AROUND))
                y[..., f][at] = value
            copies.append((y, tags[secret], weight[secret]))
        x, tags, weight = (np.concatenate(c) for c in zip(*copies))
        # hiding makes many windows equal: each is one, with their weight together
        rows = np.ascontiguousarray(np.concatenate([x, tags[..., None]], axis=2).astype(np.int8)).reshape(len(x), -1)
        _, one, of = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
        x, tags, weight = x[one], tags[one], np.bincount(of.ravel(), weight, len(one))
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.emit, self.move)]
        rng, share = np.random.default_rng(seed), weight / weight.sum()
        for step in range(1, steps + 1):
            some = np.arange(len(x)) if len(x) <= batch else rng.choice(len(x), batch, p=share)
            w = weight if len(x) <= batch else np.ones(batch)
            for p, g, m in zip((self.emit, self.move), self.gradient(x[some], tags[some], w), moments):
                g = g / w.sum() - decay * p
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                p += rate * (1.1 - step / steps) * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-9)
        # inside only follows begin or inside
        self.move[0, 2] = min(self.move[0, 2], self.move.min()) - 5.0

    def gradient(self, x: np.ndarray, tags: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows' weighted log-likelihood: seen less expected counts."""
        n, t, k = x.shape
        there = x[..., 0] >= 0
        at = np.where(there[..., None], x.astype(np.int64), 0) + self.base
        hard = np.where(there[..., None], 0.0, np.array([0.0, -1e9, -1e9]))
        both = there[:, :-1] & there[:, 1:]
        e = self.emit[at].sum(axis=2) * there[..., None] + hard
        move = [np.where(both[:, i, None, None], self.move, 0.0) for i in range(t - 1)]
        fwd, bwd = np.empty((n, t, 3)), np.zeros((n, t, 3))
        fwd[:, 0] = e[:, 0]
        for i in range(1, t):
            fwd[:, i] = e[:, i] + np.logaddexp.reduce(fwd[:, i - 1, :, None] + move[i - 1], axis=1)
        for i in range(t - 2, -1, -1):
            bwd[:, i] = np.logaddexp.reduce(move[i] + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        one = np.eye(3)[tags]
        over = (one - np.exp(fwd + bwd - z[:, None, None])) * (weight[:, None] * there)[..., None]
        emit = np.stack([np.bincount(at.reshape(-1), np.repeat(over[..., c].reshape(-1), k), len(self.emit)) for c in range(3)], axis=1)
        moves = np.zeros((3, 3))
        for i in range(t - 1):
            w = (weight * both[:, i])[:, None, None]
            pair = fwd[:, i, :, None] + move[i] + (e[:, i + 1] + bwd[:, i + 1])[:, None, :] - z[:, None, None]
            moves += ((one[:, i, :, None] * one[:, i + 1, None, :] - np.exp(pair)) * w).sum(axis=0)
        return emit, moves

    def viterbi(self, e: np.ndarray, first: bool, last: bool) -> np.ndarray:
        """Tags of a stretch whose neighbours, where it has any, are O."""
        score = e[0] + (self.move[0] if not first else np.array([0, 0, -1e9]))
        back = np.zeros(e.shape, np.int64)
        for i in range(1, len(e)):
            all_ = score[:, None] + self.move
            back[i] = all_.argmax(axis=0)
            score = all_.max(axis=0) + e[i]
        tag = int((score + (0 if last else self.move[:, 0])).argmax())
        out = np.empty(len(e), np.int64)
        for i in range(len(e) - 1, -1, -1):
            out[i] = tag
            tag = int(back[i, tag])
        return out

    def decode(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tags of all tokens of several texts."""
        e = self.emissions(x)
        tags = np.zeros(len(x), np.int64)
        # turning one tag into O changes two transitions at most
        sure = e[:, 0] - np.maximum(e[:, 1], e[:, 2]) > 2 * (self.move.max() - self.move.min())
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return tags
        text_of = np.searchsorted(first, open_, side="right")
        cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(text_of) > 0)) + 1
        starts = set(first[:-1].tolist())
        ends = set(first[1:].tolist())
        for run in np.split(open_, cut):
            a, b = int(run[0]), int(run[-1]) + 1
            tags[a:b] = self.viterbi(e[a:b], a in starts, b in ends)
        return tags


def _tagged(data: np.ndarray, offs: np.ndarray):
    """Features and, from the patterns, spans by text and tags by token."""
    start, end, first, x = features(data, offs)
    n = len(offs) - 1
    long16 = np.zeros(n, bool)
    long16[np.searchsorted(first, np.flatnonzero(end - start >= 16), side="right") - 1] = True
    long16[np.searchsorted(offs, np.flatnonzero((data == 58) | (data == 61)), side="right") - 1] = True
    found: dict[int, list] = {}
    for k in np.flatnonzero(long16).tolist():  # only these can hold a match
        if s := base_spans(data[offs[k]:offs[k + 1]].tobytes()):
            found[k] = s
    return start, end, first, x, found


def fit(df: DataFrame, text: str = "text", fit_docs: int = 20000, fit_windows: int = 8000, seed: int = 3) -> Field | None:
    """A field fitted on a bounded sample: about ``fit_docs`` distinct texts by
    their hash, then ``fit_windows`` distinct windows by theirs, half of them
    with secrets.  A window weighs as often as it occurs in the sample."""
    n = df.agg(F.approx_count_distinct(F.xxhash64(F.col(text)))).first()[0]
    if not n:
        return None
    share = F.pmod(F.xxhash64(F.col(text), F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, fit_docs / n) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.flat(batch.column(0))
            for i, j in B.pieces(offs):
                d, o = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                start, end, first, x, found = _tagged(d, o)
                tags = np.zeros(len(x), np.int8)
                for k, spans in found.items():
                    for _, _, _, a, b in spans:
                        inside = np.flatnonzero((start < o[k] + b) & (end > o[k] + a))
                        tags[inside[1:]] = 2
                        tags[inside[:1]] = 1
                like = (tags > 0) | ((x[:, 0] >= 2) & (x[:, 1] > 0)) | (x[:, 6] > 0) | (x[:, 7] > 0) | (x[:, 8] > 0)
                h = B.mix(B.hashes(d, start, end) + np.uint64(seed))
                place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
                doc = np.repeat(B.hashes(d, o[:-1], o[1:]), np.diff(first))
                h = B.mix(h ^ B.mix(doc + place.astype(np.uint64)))
                pick = np.flatnonzero(like | (h % np.uint64(200) == 0))
                at = pick[:, None] + np.arange(-REACH, REACH + 1)
                text_of = np.searchsorted(first, pick, side="right")[:, None]
                ok = (at >= first[text_of - 1]) & (at < first[text_of])
                at = np.where(ok, at, 0)
                rows = np.concatenate([np.where(ok[..., None], x[at], -1), np.where(ok, tags[at], 0)[..., None]], axis=2).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((tags[pick] > 0).astype(np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["y", "v"])

    windows = (df.where(share).select(text).distinct().mapInArrow(run, "y int, v binary")
               .groupBy("y", "v").agg(F.count(F.lit(1)).alias("n")))
    got = [r for y in (0, 1) for r in windows.where(F.col("y") == y).orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(fit_windows // 2).collect()]
    if not any(r["y"] for r in got):
        return None
    w = np.stack([np.frombuffer(r["v"], np.int8).reshape(2 * REACH + 1, -1) for r in got])
    field = Field()
    y, times = np.array([r["y"] for r in got]), np.array([r["n"] for r in got], float)
    for c in (0, 1):  # a class weighs as much as it has windows
        times[y == c] *= (y == c).sum() / max(times[y == c].sum(), 1.0)
    field.fit(w[..., :-1], w[..., -1].astype(np.int64), times)
    return field


def scan(df: DataFrame, field: Field | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans) with spans as structs (kind, start, end) in code points,
    ordered by start, then kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.flat(batch.column(1))
            for i, j in B.pieces(offs):
                d, o = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                start, end, first, x, found = _tagged(d, o)
                spans: list[list] = [[] for _ in range(j - i)]
                for k, s in found.items():
                    spans[k] = [(kind, a, b) for kind, a, b, _, _ in s]
                tags = field.decode(x, first) if field is not None else np.zeros(len(x), np.int64)
                for t in np.flatnonzero(tags == 1).tolist():
                    last = t
                    while last + 1 < len(tags) and tags[last + 1] == 2:
                        last += 1
                    k = int(np.searchsorted(first, t, side="right")) - 1
                    a, b = int(start[t] - o[k]), int(end[last] - o[k])
                    if not any(c <= a and b <= e for kind, c, e in spans[k] if kind < 3):
                        spans[k].append((3, a, b))
                out = []
                for k, s in enumerate(spans):
                    if s:
                        points = np.concatenate([[0], np.cumsum((d[o[k]:o[k + 1]] & 0xC0) != 0x80)])
                        s = [{"kind": KINDS[c], "start": int(points[a]), "end": int(points[b])} for a, c, b in sorted((a, c, b) for c, a, b in s)]
                    out.append(s)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out, _SPANS)], [id_col, "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, spans array<struct<kind: string, start: long, end: long>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = scan(d, fit(d))

    def joined(keep):
        return F.array_join(F.transform(F.filter("spans", keep), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return s.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                    F.sha2(joined(lambda x: x["kind"] != "crf"), 256).alias("base_sha256"),
                    joined(lambda x: F.lit(True)).alias("spans"))
