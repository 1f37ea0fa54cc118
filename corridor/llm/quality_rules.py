"""Operator 5: line-first quality rules, in DataFrame functions only.

Each line of a text is judged on its own by rules on punctuation,
navigation, symbols, capitals, stutter and boilerplate; failing lines go.
A document whose failing lines held more than ``max_lost`` of its word
characters is rejected, and so is one that fails the base rules (too few
words, or too many words in repeated 8-word windows).

All work is local to a row: no shuffle, no cap on a text's length; repeated
windows are found by sorting the windows' hashes, so a text of n words costs
n log n.

Defined results: a null or empty text has no words, fails the base rules and
is not kept; its cleaned text is the empty string.  Repeated rows are judged
alike; an empty table gives an empty result; further columns pass through,
except that the operator's own column names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._native import SPACE, let, words
from ._store import table

SYMBOLS = r"#*$%&|<>"
# Phrases that mark a page's furniture.
BOILERPLATE = ("javascript", "cookie policy", "terms of use", "privacy policy", "all rights reserved",
               "lorem ipsum", "click here", "sign in", "log in", "subscribe now", "read more")
BOILERPLATE_WORDS = 30


def count_of(text: Column, chars: str) -> Column:
    """Characters of ``text`` in the class ``chars``."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def line_fails(line: Column) -> Column:
    """The rules for one line; a line without words passes."""
    def judge(w: Column) -> Column:
        n = F.size(w)
        stutter = F.size(F.filter(w, lambda x, i: (i > 0) & (x == w[F.greatest(i - 1, F.lit(0))])))
        return (n > 0) & (
            ((n >= 20) & (count_of(line, ".!?。！？") == 0))                    # no sentence ends
            | (count_of(line, "|»›•") * 3 >= F.greatest(n, F.lit(6)))          # a row of links or cells
            | (count_of(line, SYMBOLS) * 10 > n * 3)                           # strewn with symbols
            | ((n >= 4) & (count_of(line, r"\p{Lu}") * 10 > count_of(line, r"\p{L}") * 6))  # shouted
            | ((n >= 10) & (stutter * 10 >= n * 3))                            # words said twice in a row
            | ((n <= BOILERPLATE_WORDS) & F.lower(line).rlike("|".join(BOILERPLATE))))
    return let(words(line), judge)


def repeat_words(w: Column, width: int = 8) -> Column:
    """Words that lie in windows of ``width`` words found twice or more."""
    def covered(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(width),
                           lambda acc, k: acc + F.least(F.lit(width), p[k] - p[k - 1]))

    def positions(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(s, lambda e, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == e["h"]))
                         | ((k < last) & (s[F.least(k + 1, last)]["h"] == e["h"])))
        return F.array_sort(F.transform(twice, lambda e: e["p"]))

    def from_windows(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            let(ranked, lambda s: let(positions(s), covered)))

    def from_hashes(h: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(h) - width),
                            lambda i: F.xxhash64(*[h[i + j] for j in range(width)]))
        return let(grams, from_windows)

    return F.when(F.size(w) <= width, F.lit(0)).otherwise(
        let(F.transform(w, lambda x: F.xxhash64(x)), from_hashes)).cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """The base measures in one struct per text, so that words are cut once."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    of_words = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                                                repeat_words(w).alias("n_repeat_words")))
    return {"_quality_w": of_words, "n_symbols": count_of(t, SYMBOLS).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")}


def quality_rules(df: DataFrame, text: str = "text", min_words: int = 20, max_repeat_pct: int = 30,
                  max_lost: float = 0.3) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_failed_lines, lost_chars, kept and clean_text."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "n_failed_lines", "lost_chars", "kept", "clean_text"]
    d = df.drop(*[c for c in own if c != text])
    t = F.coalesce(F.col(text), F.lit(""))

    def split_up(lines: Column) -> Column:
        bad = F.filter(lines, lambda x: x["bad"])
        return F.struct(F.size(bad).cast("long").alias("n_failed_lines"),
                        F.length(F.regexp_replace(F.array_join(F.transform(bad, lambda x: x["line"]), ""), SPACE, ""))
                        .cast("long").alias("lost_chars"),
                        F.array_join(F.transform(F.filter(lines, lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
                        .alias("clean_text"))

    judged = F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), line_fails(x).alias("bad")))
    d = d.withColumns(base_columns(F.col(text)) | {"_quality_l": let(judged, split_up)})
    failed = (F.col("_quality_w.n_words") < min_words) | (F.col("_quality_w.n_repeat_words") * 100 > F.col("_quality_w.n_words") * max_repeat_pct)
    return (d.withColumns({k: F.col(f"_quality_w.{k}") for k in ("n_words", "word_chars", "n_repeat_words")}
                          | {k: F.col(f"_quality_l.{k}") for k in ("n_failed_lines", "lost_chars", "clean_text")}
                          | {"base_failed": failed,
                             "kept": ~failed & (F.col("_quality_l.lost_chars") <= F.col("_quality_w.word_chars") * max_lost)})
            .drop("_quality_w", "_quality_l"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_COUNT = "length(regexp_replace({0}, '[^{1}]+', '', 'g'))"
_SP = r"[\x20\x09-\x0D]+"

SQL = rf"""
with docs as (
  select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
w as (
  select rid, doc_id, t, list_filter(string_split_regex(t, '{_SP}'), lambda x: x <> '') ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SP}', '', 'g') <> '') lines from docs),
grams as (
  select rid, i, hash(list_slice(ws, i, i + 7)) h from w, unnest(range(1, len(ws) - 6)) g(i) where len(ws) >= 8),
twice as (select rid, i from grams qualify count(*) over (partition by rid, h) > 1),
rep as (
  select rid, sum(g) n from (
    select rid, least(8, coalesce(lead(i) over (partition by rid order by i) - i, 8)) g from twice) group by rid),
ln as (
  select rid, l, list_filter(string_split_regex(l, '{_SP}'), lambda x: x <> '') ws
  from w, unnest(lines) u(l)),
judged as (
  select rid, l, len(ws) n,
    (len(ws) >= 20 and {_COUNT.format('l', '.!?。！？')} = 0)
    or {_COUNT.format('l', '|»›•')} * 3 >= greatest(len(ws), 6)
    or {_COUNT.format('l', SYMBOLS)} * 10 > len(ws) * 3
    or (len(ws) >= 4 and {_COUNT.format('l', chr(92) + 'p{Lu}')} * 10 > {_COUNT.format('l', chr(92) + 'p{L}')} * 6)
    or (len(ws) >= 10 and len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) * 10 >= len(ws) * 3)
    or (len(ws) <= {BOILERPLATE_WORDS} and regexp_matches(lower(l), '{"|".join(BOILERPLATE)}')) bad
  from ln),
lost as (select rid, sum(length(regexp_replace(l, '{_SP}', '', 'g'))) n from judged where bad group by rid),
base as (
  select w.rid, doc_id, cast(len(ws) as bigint) n_words, cast(length(array_to_string(ws, '')) as bigint) word_chars,
    cast({_COUNT.format('t', SYMBOLS)} as bigint) n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) n_dup_lines,
    cast(coalesce(rep.n, 0) as bigint) n_repeat_words, coalesce(lost.n, 0) lost
  from w left join rep using (rid) left join lost using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and lost <= word_chars * 0.3 as kept
from base
"""
