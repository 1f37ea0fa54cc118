"""Operator 2: repeated runs of lines, in DataFrame functions only.

A line here ends at a newline or, inside a physical line, after a sentence
(one of ``.!?`` and a space), so that a passage pasted into the middle of a
paragraph still consists of whole lines.  Lines are compared by the hash of
their text without trailing white space; blank ones are left out.

From every line on, the shortest run of lines that holds ``min_chars``
characters is a gram, and so is the shortest one up to every line.  Two places
share a run of ``min_chars`` characters or more if and only if they share
grams, and these grams cover it; so a gram that an earlier place has (by
doc_id, then position) is deleted, whichever place that is.  The first place
of a passage always stays: inside its own text, places that overlap it are not
repeats of it.

Every gram is a fingerprint.  Window minima alone, joined with the first place
of each, miss runs whose first place is part of a shorter one, and short lines
and runs of a few lines have no minimum of their own (see the README).

Scale: a gram is one row of fixed size, shuffled by hash to be counted and to
be met again; only repeated ones go further.  First places are found by a
pre-aggregated minimum, so a line that is in every document costs one row a
document, never a pair of documents.

Defined results: a null text stays null and has no lines; rows that repeat
both doc_id and text are one document; exact copies under other doc_ids lose
their text where it has ``min_chars`` characters; blank lines go where they
stand inside a run; an empty table gives an empty result; further columns pass
through, except that the operator's own column names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._native import let
from ._store import stored, table

# after a newline, or after a sentence's end and its space
CUT = r"(?<=\n)(?=[^\n])|(?<=[^.!?][.!?] )(?=[^\x20\n])"
OWN = ("n_lines", "n_deleted", "deleted_chars", "clean_text")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), CUT)


def bare(line: Column) -> Column:
    return F.rtrim(line, F.lit(" \n\t\r"))


def grams(units: Column, min_chars: int) -> Column:
    """Array of (f, b, e): from each unit (h, n, p) on, and up to each, the
    fewest units of ``min_chars`` characters; from place b to place e."""

    def taken(some: Column, seed: int) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(seed).cast("long").alias("f"))
        return F.aggregate(some, start, lambda r, x: F.when(r["n"] >= min_chars, r).otherwise(
            F.struct((r["n"] + x["n"]).alias("n"), (r["c"] + 1).alias("c"), F.xxhash64(r["f"], x["h"]).alias("f"))))

    def shortest(some, seed: int) -> Column:
        """``some(m)``: the next m units.  No unit is empty, so min_chars of them will do."""

        def of(m: int, *more: int) -> Column:
            few = taken(some(m), seed)
            return let(few, lambda r: F.when((r["n"] >= min_chars) | (F.size(some(m)) < m), r).otherwise(of(*more))) if more else few

        return of(4, 24, min_chars)

    def gram(f: Column, b: Column, e: Column) -> Column:
        return F.struct(f.alias("f"), units[b]["p"].alias("b"), units[e]["p"].alias("e"))

    def onward(i: Column) -> Column:
        return let(shortest(lambda m: F.slice(units, i + 1, m), 0), lambda r: F.when(r["n"] >= min_chars, gram(r["f"], i, i + r["c"] - 1)))

    def back(i: Column) -> Column:
        # without its last unit it is too short, or else the first unit's gram ends sooner
        return let(shortest(lambda m: F.reverse(F.slice(units, F.greatest(i - m + 2, F.lit(1)), F.least(i + 1, F.lit(m)))), 1),
                   lambda r: F.when(r["n"] - units[i]["n"] >= min_chars, gram(r["f"], i - r["c"] + 1, i)))

    each = F.transform(units, lambda x, i: F.array(onward(i), back(i)))
    return F.filter(F.flatten(each), lambda g: g.isNotNull())


def merged(runs: Column) -> Column:
    """Sorted runs (b, e) without overlaps that hold the same places."""
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["b"], r["e"])))))

    def ends(e: Column) -> Column:
        begin = F.filter(e, lambda p, i: F.coalesce(F.get(e, i - 1) != p - 1, F.lit(True)))
        end = F.filter(e, lambda p, i: F.coalesce(F.get(e, i + 1) != p + 1, F.lit(True)))
        return F.arrays_zip(begin.alias("b"), end.alias("e"))

    return let(places, ends)


def later(marks: DataFrame, name: str) -> DataFrame:
    """(k, runs): of grams (id, k, f, b, e), those that an earlier place has."""
    twice = stored(marks.groupBy("f").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("f"), f"{name}-twice")
    again = stored(marks.join(twice, "f", "left_semi"), f"{name}-again")
    first = stored(again.groupBy("f").agg(F.min(F.struct("id", "k", "b", "e")).alias("at")).select("f", F.col("at.k").alias("fk"), F.col("at.e").alias("fe")), f"{name}-first")
    gone = again.join(first, "f").where((F.col("k") != F.col("fk")) | (F.col("b") > F.col("fe")))
    return gone.groupBy("k").agg(merged(F.collect_list(F.struct("b", "e"))).alias("runs"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 120) -> DataFrame:
    """``df`` with n_lines, n_deleted, deleted_chars and clean_text."""
    df = df.drop(*[c for c in OWN if c not in (id_col, text)])
    key = F.xxhash64(F.col(id_col), F.col(text))
    d = df.where(F.col(text).isNotNull()).select(key.alias("k"), F.col(id_col).alias("id"), lines(F.col(text)).alias("l"))
    unit = F.transform(F.col("l"), lambda x, i: let(bare(x), lambda y: F.struct(F.xxhash64(y).alias("h"), F.length(y).alias("n"), i.alias("p"))))
    d = d.select("k", "id", let(F.filter(unit, lambda x: x["n"] > 0), lambda u: grams(u, min_chars)).alias("g"))
    marks = stored(d.dropDuplicates(["k"]), "op2-lines").select("id", "k", F.explode("g").alias("g")).select("id", "k", "g.f", "g.b", "g.e")
    gone = later(marks, "op2").withColumnRenamed("runs", "_dedup_runs")

    marked = df.withColumn("_dedup_k", F.when(F.col(text).isNotNull(), key)).join(gone.withColumnRenamed("k", "_dedup_k"), "_dedup_k", "left")

    def rewritten(l: Column) -> Column:
        def out(i: Column) -> Column:
            return F.exists(F.col("_dedup_runs"), lambda r: (r["b"] <= i) & (i <= r["e"]))

        return let(F.transform(l, lambda x, i: F.struct(x.alias("x"), out(i).alias("gone"))), lambda m: F.struct(
            F.size(m).alias("n_lines"), F.size(F.filter(m, lambda x: x["gone"])).alias("n_deleted"),
            F.array_join(F.transform(F.filter(m, lambda x: ~x["gone"]), lambda x: x["x"]), "").alias("clean_text")))

    plain = F.struct(F.size(lines(F.col(text))).alias("n_lines"), F.lit(0).alias("n_deleted"), F.col(text).alias("clean_text"))
    marked = marked.withColumn("_dedup_o", F.when(F.col("_dedup_runs").isNull(), plain).otherwise(let(lines(F.col(text)), rewritten)))
    return (marked.withColumns({
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.col("_dedup_o.n_lines")).cast("long"),
        "n_deleted": F.col("_dedup_o.n_deleted").cast("long"),
        "clean_text": F.col("_dedup_o.clean_text"),
        "deleted_chars": F.coalesce(F.length(text) - F.length("_dedup_o.clean_text"), F.lit(0)).cast("long")})
        .drop("_dedup_o", "_dedup_k", "_dedup_runs"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *OWN)
