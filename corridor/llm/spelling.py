"""Operator 11: spelling variants by a relational trie frontier.

Words of the corpus are counted; two are near if one inserted, deleted or
replaced code point makes them equal.  The words form a trie whose edges
(side, depth, node, letter) are a table, a node being the letters that lead to
it.  A frontier of states (word, position, node, edits) goes down level by
level, each level one join with the edges of its depth.  A state without an
edit lies on its word's own path, so those of a level are read from the words;
at each node it branches into the edges of other letters (a replacement) and
into the edge of the letter after the next (a deletion).  A state with its one
edit follows the edge of its next letter only.  A state that ends at a word
gives a pair of neighbours.

What keeps the frontier small:

* an edit in a word's first half is found in the trie of the reversed words,
  so states branch in the second half of a word alone, below busy nodes;
* a pair is found from its longer word, or from the one with the smaller
  letter, and where one of several equal letters goes the last of them does,
  so each pair comes up once;
* an edge carries a bit for each number of letters that words have left
  there, and bits for the letters that follow it; only states with such a
  number and next letter take it.

Letters are few, so a node has a bounded number of edges; no list of a node's
words is made.  Tries end at ``longest`` letters, which bounds the levels.
Pairs with a longer word are found exactly through hashes of the words without
one letter: those without the same place differ by that place's letter alone.

Defined results: a null or empty text has no words; a null doc_id reads as an
empty one in what is hashed; repeated rows count each; ties in size go to the
form that is first in code-point order; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._native import let
from ._store import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]"
LONGEST = 40


def occurrences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 7, damage: int = 31) -> DataFrame:
    """(word, n): lower-cased runs of letters, of which one in ``damage`` loses
    a letter by the hash of document and run."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    ascii_ = F.octet_length("run") == F.length("run")
    low = runs.select("id", F.when(ascii_, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))

    def lost(h: Column) -> Column:
        k = F.pmod(h, F.length("run")).cast("int")
        return F.when(h % damage == 0, F.concat(F.col("run").substr(F.lit(1), k), F.col("run").substr(k + 2, F.length("run")))).otherwise(F.col("run"))

    hashed = low.select(let(F.crc32(F.concat("id", F.lit(":"), "run")), lost).alias("word"))
    return hashed.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.length("word") >= least) & (F.col("n") >= 2))


def _letter(s: Column, at) -> Column:
    """The letter at place ``at`` (from 0), or an empty string behind the end."""
    return s.substr((at if isinstance(at, Column) else F.lit(at)) + 1, F.lit(1))


def _sided(words: DataFrame) -> DataFrame:
    """(side, w, n, m, half): each word as it is and reversed; ``half`` is the
    least place of an edit that its side finds."""
    m = F.length("word")
    half = (m / 2).cast("int")
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("w"), half.alias("half")),
                   F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w"), (m - half).alias("half")))
    return words.select("n", m.alias("m"), F.explode(both).alias("x")).select("x.side", "x.w", "n", "m", "x.half")


def _edges(sided: DataFrame) -> DataFrame:
    """(side, depth, node, letter, left, next, n): ``left`` has bit r set if a
    word has r letters from the node on, ``next`` that of each letter behind
    the edge; n counts the word that ends with the edge.  The edge without a
    letter ends a word at the node itself."""
    at = sided.select("side", "w", "n", "m", F.explode(F.sequence("half", "m")).alias("depth"))
    rest = F.col("m") - F.col("depth")
    return (at.groupBy("side", "depth", F.col("w").substr(F.lit(1), F.col("depth")).alias("node"), _letter(F.col("w"), F.col("depth")).alias("letter"))
            .agg(F.bit_or(F.expr("shiftleft(1L, m - depth)")).alias("left"),
                 F.bit_or(F.expr("shiftleft(1L, ascii(substr(w, depth + 2, 1)) % 63)")).alias("next"), F.max(F.when(rest <= 1, F.col("n"))).alias("n")))


def _level(states: DataFrame, edges: DataFrame, d: int) -> DataFrame:
    """The states that the edges of depth ``d`` lead to: (side, a, n, b, n_b),
    with n_b where b is complete.  Incoming states have b null (no edit yet) or
    the word that their edit makes of a."""
    w, b, letter, left = F.col("a"), F.col("b"), F.col("letter"), F.col("left")
    m = F.length("a")
    own, then = _letter(w, d), _letter(w, d + 1)

    def has(rest: Column, behind: Column) -> Column:
        fits = F.when((rest >= 0) & (rest < 63), F.getbit(left, F.greatest(rest, F.lit(0)))).otherwise(0) == 1
        return fits & (F.getbit(F.col("next"), F.ascii(behind) % 63) == 1)

    replaced = b.isNull() & (letter > own) & has(m - d, then)
    # the run of equal letters that ends here must not reach into the half of the other side
    crossing = (F.col("side") == 1) & (w.substr(F.col("half"), F.lit(d + 2) - F.col("half")) == F.repeat(own, F.lit(d + 2) - F.col("half")))
    deleted = b.isNull() & (letter == then) & (then != own) & ~crossing & has(m - d - 1, _letter(w, d + 2))
    follows = b.isNotNull() & (letter == _letter(b, d)) & has(F.length("b") - d, _letter(b, d + 1))
    head = w.substr(F.lit(1), F.lit(d))
    made = F.filter(F.array(F.struct(replaced.alias("ok"), F.concat(head, letter, w.substr(F.lit(d + 2), m)).alias("b")),
                            F.struct(deleted.alias("ok"), F.concat(head, w.substr(F.lit(d + 2), m)).alias("b")),
                            F.struct(follows.alias("ok"), b.alias("b"))), lambda x: F.coalesce(x["ok"], F.lit(False)))
    met = (states.withColumn("node", F.coalesce("b", "a").substr(F.lit(1), F.lit(d)))
           .join(edges.select(F.col("side").alias("_side"), F.col("node").alias("_node"), "letter", "left", "next", F.col("n").alias("_n")),
                 (F.col("side") == F.col("_side")) & (F.col("node") == F.col("_node")) & (replaced | deleted | follows)))
    out = met.select("side", "a", "n", "_n", F.explode(F.transform(made, lambda x: x["b"])).alias("b"))
    return out.select("side", "a", "n", "b", F.when(F.length("b") <= d + 1, F.col("_n")).alias("n_b"))


def _short_pairs(words: DataFrame, longest: int) -> DataFrame:
    """(a, n_a, b, n_b) for near words of at most ``longest`` letters."""
    spark = words.sparkSession
    words = words.where(F.length("word") <= longest)
    sided = stored(_sided(words), "op11-words")
    span = sided.agg(F.min("half"), F.max("m")).first()
    schema = "a string, n_a long, b string, n_b long"
    if span[0] is None:
        return spark.createDataFrame([], schema)
    edges = stored(_edges(sided).repartition("depth", F.pmod(F.xxhash64("node"), F.lit(64))), "op11-edges", "depth")
    carried, found = None, []
    for d in range(span[0], span[1] + 1):
        states = sided.where((F.col("half") <= d) & (F.col("m") > d)).select("side", F.col("w").alias("a"), "n", F.lit(None).cast("string").alias("b"), "half")
        if carried is not None:
            states = states.unionByName(carried.where("n_b is null").select("side", "a", "n", "b", F.lit(0).alias("half")))
        carried = stored(_level(states, edges.where(F.col("depth") == d), d), f"op11-level{d}")
        found.append(carried.where("n_b is not null"))
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)

    def forward(c: str) -> Column:
        return F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c))

    return pairs.select(forward("a").alias("a"), F.col("n").alias("n_a"), forward("b").alias("b"), "n_b")


def _without_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word: hashes of the word itself (place -1) and of the word without
    the letter at each place; of equal letters in a row, all places."""
    base = np.uint64(0x9E3779B97F4A7C15)
    for b in batches:
        for key, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                up = np.cumprod(np.r_[np.uint64(1), np.full(len(x), base)], dtype=np.uint64)
                head = np.r_[np.uint64(0), np.cumsum(x * up[:-1], dtype=np.uint64)]
                # letters behind the place move down by one power: hash their tails from the end
                low = np.r_[np.uint64(0), np.cumsum(x[1:] * up[:-2], dtype=np.uint64)]
                tail = low[-1] - low
            hashes = np.r_[head[-1], head[:-1] + tail]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), key)), pa.array(np.arange(-1, len(x))), pa.array(hashes.view(np.int64)),
                                              pa.array(np.full(len(hashes), len(x)))], ["key", "place", "h", "m"])


def _long_pairs(words: DataFrame, longest: int) -> DataFrame:
    """(a, n_a, b, n_b) for near words of which one has over ``longest`` letters."""
    words = stored(words.where(F.length("word") >= longest).select(F.xxhash64("word").alias("key"), "word", "n"), "op11-long")
    each = stored(words.select("key", "word").mapInArrow(_without_one, "key long, place long, h long, m long"), "op11-without")
    x, y = each.where("place >= 0").alias("x"), each.alias("y")
    replaced = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.m") == F.col("y.m")) & (F.col("x.place") == F.col("y.place"))
                      & (F.col("x.key") < F.col("y.key")) & (F.col("x.m") > longest))
    deleted = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("y.place") == -1) & (F.col("x.m") == F.col("y.m") + 1))
    keys = replaced.union(deleted).select(F.col("x.key").alias("ka"), F.col("y.key").alias("kb")).distinct()
    a = words.select(F.col("key").alias("ka"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = words.select(F.col("key").alias("kb"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    near = keys.join(a, "ka").join(b, "kb").where(F.levenshtein("a", "b", 1) == 1)
    return near.select("a", "n_a", "b", "n_b")


def neighbours(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words of (word, n) once."""
    return _short_pairs(words, longest).unionByName(_long_pairs(words, longest))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following forms ends.  Sizes grow
    along the way, so there are no circles; the steps double."""
    at = stored(forms.select("word", F.col("form").alias("root")), "op11-roots")
    while True:
        step = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        at = stored(at.join(step, F.col("root") == F.col("_word"), "left")
                    .select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "op11-roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def groups(words: DataFrame, factor: int = 10, longest: int = LONGEST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of (word, n)."""
    words = stored(words.select("word", "n"), "op11-counted")
    pairs = neighbours(words, longest)
    both = stored(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("n_other")),
                                                 F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))).alias("x"))
                  .select("x.*"), "op11-pairs")
    count = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"))
    best = (both.where(F.col("n_other") >= factor * F.col("n")).groupBy("word")
            .agg(F.min(F.struct((-F.col("n_other")).alias("n"), F.col("other").alias("form"))).alias("best"))
            .select("word", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")))
    best = stored(best, "op11-forms")
    return (words.join(count, "word", "left").join(best, "word", "left").join(roots(best), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(occurrences(table(spark, sf_dir, "documents")))


# crc32 from its polynomial over the bytes of the hashed string
SQL = rf"""
with recursive steps as (
  select list(c order by i) t from (
    select i, list_reduce([i::ubigint] || range(8)::ubigint[], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) c
    from range(256) g(i))),
runs as (
  select coalesce(doc_id::varchar, '') id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]{{7,}}')) run from documents),
distinct_runs as (select id, run, count(*) k, hex(encode(id || ':' || run)) x from runs group by id, run),
hashed as (
  select run, k, xor(list_reduce([4294967295::ubigint] || list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::ubigint),
    lambda c, v: xor(c >> 8, t[((xor(c, v) & 255) + 1)::bigint])), 4294967295::ubigint) h from distinct_runs, steps),
tokens as (
  select k, case when h % 31 = 0 then substr(run, 1, (h % len(run))::int) || substr(run, (h % len(run))::int + 2) else run end word from hashed),
words as (select word, cast(sum(k) as bigint) n from tokens where len(word) >= 7 group by word having sum(k) >= 2),
less as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) v from words, unnest(range(1, len(word) + 1)) g(i)),
near as (
  select distinct a.word, a.n, b.word other, b.n n_other from less a join less b on a.v = b.v and a.i = b.i and a.word <> b.word
  union select distinct a.word, a.n, b.word, b.n from less a join words b on a.v = b.word
  union select distinct b.word, b.n, a.word, a.n from less a join words b on a.v = b.word),
counts as (select word, count(*) n_near from near group by word),
forms as (
  select word, other form, n_other form_n from near where n_other >= 10 * n
  qualify row_number() over (partition by word order by n_other desc, other) = 1),
chain(word, root, d) as (
  select word, form, 1 from forms union all select chain.word, forms.form, d + 1 from chain join forms on chain.root = forms.word),
ends as (select word, root from chain qualify row_number() over (partition by word order by d desc) = 1)
select words.word, form, coalesce(root, words.word) root, n, coalesce(n_near, 0) n_near, form_n
from words left join counts using (word) left join forms using (word) left join ends using (word)
"""
