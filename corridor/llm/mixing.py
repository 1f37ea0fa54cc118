"""Operator 8: mixing sources to target weights, in DataFrame functions only.

Each source's documents, in an order drawn by hash, make one stream of words,
cut into blocks of ``block`` words.  A source's target is its weight's share
of ``share`` of all words, at most ``most`` times its size, the excess being
shared out again by weight.  The target fixes how many slots a source has in
the mix.  Each output shard draws the source of each of its slots with the
sources' shares as probabilities, so its counts are multinomial; running sums
over the shards number a source's slots.  From the shard on that would give a
source more than its slots, the last shards even out what the targets lack:
the slots that are left are dealt to them in random order.  A pseudorandom
permutation per source and pass over it maps its slots to block indices, and
slots are joined with documents by (source, block).  The last slot of a source
is cut to its target.

Permutations are swap-or-not shuffles: a bijection of 0..n-1 for any n,
computed per row, so no table is sorted at random and reruns agree.

Scale: prefix sums are taken in two levels (documents in chunks of about
``chunk``, then chunks in a source; shards and sources likewise), so neither
the largest source nor the table of sources is ever in one task; shards are
generated in parallel, and slots are joined on (source, block), which is even
however large a source is.

Defined results: a null or empty text has size 0 and takes nothing; the null
source is one source, last in order; repeated rows are documents of their
own; an empty table, or one without words, gives takes of 0; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_group_rank
from ._native import let, words
from ._store import stored, table


def _shuffled(index: Column, n: Column, rounds: Column, seed: tuple[Column, ...]) -> Column:
    """Swap-or-not: in each round a value swaps, or not, with its mirror image
    about a random centre; both make the same choice."""
    def turn(k: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, F.lit("centre"), *seed), n) - k, n)
        return let(F.struct(k.alias("k"), mirror.alias("m")),
                   lambda p: F.when(F.pmod(F.xxhash64(F.greatest(p["k"], p["m"]), r, *seed), F.lit(2)) == 0, p["k"]).otherwise(p["m"]))

    return F.aggregate(rounds, index.cast("long"), turn)


def permuted(index: Column, n: Column, *seed: Column, rounds: int = 24) -> Column:
    """The value at place ``index`` of a pseudorandom permutation of 0..n-1."""
    return _shuffled(index, n, F.sequence(F.lit(1), F.lit(rounds)), seed)


def place_of(value: Column, n: Column, *seed: Column, rounds: int = 24) -> Column:
    """The place at which ``permuted`` has ``value``: its rounds, backwards."""
    return _shuffled(value, n, F.sequence(F.lit(rounds), F.lit(1), F.lit(-1)), seed)


def sized(df: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """(_id, _k, _s, size): _k tells rows apart by id and text; the source is
    never null in _s, and null sorts last."""
    return df.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text)).alias("_k"), F.struct(F.col(source).isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")).alias("_s"),
                     F.size(words(F.col(text))).cast("long").alias("size"))


def targets(docs: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(_s, _i, n_docs, source_size, target) for (_s, size); _i numbers the
    sources in order.  Sources are capped until the water level, the words per
    weight that the others share, lifts none above its cap."""
    s = docs.groupBy("_s").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    s = with_group_rank(s, [], ["_s"], "_i")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    s = stored(s.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))), "op8-weights")
    level, capped = 0.0, F.lit(False)
    everything = float(s.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        free = s.where(~capped).agg(F.sum("_w")).first()[0]
        if not free:
            break
        held = s.where(capped).agg(F.sum("_cap")).first()[0] or 0.0
        level, before = (everything - held) / free, level
        if level == before:
            break
        capped = F.lit(level) * F.col("_w") >= F.col("_cap")
    return s.select("_s", "_i", "n_docs", "source_size", F.when(capped, F.col("_cap")).otherwise(F.lit(level) * F.col("_w")).alias("target"))


def running(df: DataFrame, by: list[str], place: str, value: str, out: str, step: int = 1024) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, by ``place``,
    within ``by``: inside steps of ``step`` places, then over the steps."""
    df = df.withColumn("_step", F.floor(F.col(place) / step))
    steps = df.groupBy(*by, "_step").agg(F.sum(value).alias("_sum"))
    upto = Window.unboundedPreceding, -1
    steps = steps.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_step").rowsBetween(*upto)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*by, "_step").orderBy(place).rowsBetween(*upto)), F.lit(0))
    return df.withColumn("_in", inside).join(steps, [*by, "_step"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_step", "_base", "_in")


def streams(docs: DataFrame, sources: DataFrame, chunk: int) -> DataFrame:
    """(_id, _k, _s, size, offset): where each document begins in its source's stream."""
    d = docs.join(sources.select("_s", F.ceil(F.col("n_docs") / chunk).cast("int").alias("_chunks")), "_s")
    d = d.withColumn("_c", F.pmod(F.xxhash64("_k", F.lit("stream")), F.col("_chunks"))).drop("_chunks")
    sums = d.groupBy("_s", "_c").agg(F.sum("size").alias("_n"))
    begin = sums.select("_s", "_c", F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("_s", "_c").orderBy("_k", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_o", inside).join(begin, ["_s", "_c"]).select("_id", "_k", "_s", "size", (F.col("_b") + F.col("_o")).alias("offset"))


def _wanted(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """``sources`` that the mix takes from, with their blocks and slots: whole
    passes over a source, then as many blocks as hold the rest."""
    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    last = F.col("source_size") - (F.col("_blocks") - 1) * block  # words of the last block
    s = (sources.where("source_size > 0 and target >= 0.5").withColumn("_blocks", n_blocks).withColumn("_last", last)
         .withColumn("_want", F.round("target").cast("long")))
    s = s.withColumn("_pass", F.floor(F.col("_want") / F.col("source_size")))
    s = s.withColumn("_rest", F.col("_want") - F.col("_pass") * F.col("source_size"))
    # the smallest number of blocks of the last pass that hold the rest, given where the short block comes
    short = F.lit(block) - F.col("_last")
    s = s.withColumn("_at", place_of(F.col("_blocks") - 1, F.col("_blocks"), F.col("_s"), F.col("_pass"), F.lit(seed)))
    plain = F.ceil(F.col("_rest") / block)
    s = s.withColumn("_more", F.when(plain <= F.col("_at"), plain).otherwise(F.greatest(F.col("_at") + 1, F.ceil((F.col("_rest") + short) / block))))
    s = s.withColumn("_more", F.when(F.col("_rest") == 0, F.lit(0)).otherwise(F.col("_more")))
    s = s.withColumn("_slots", F.col("_pass") * F.col("_blocks") + F.col("_more"))
    # words of the last pass before its last slot
    return s.withColumn("_got", (F.col("_more") - 1) * block - F.when(F.col("_more") - 1 > F.col("_at"), short).otherwise(F.lit(0)))


def draws(sources: DataFrame, total: int, shard_slots: int, seed: int, cells: int = 4096, few: int = 100_000) -> DataFrame:
    """(shard, _s, n): the multinomial counts of each whole shard.  A slot
    draws a number below ``total``; the source whose range of as many numbers
    as it has slots holds it is found through cells of equal width, so no
    slot looks at all sources."""
    width = max(1, -(-total // cells))
    ranges = running(sources.select(F.lit(0).alias("_all"), "_s", "_i", "_slots"), ["_all"], "_i", "_slots", "_from")
    spread = ranges.where("_slots > 0").select("_s", "_from", (F.col("_from") + F.col("_slots")).alias("_to"))
    spread = stored(spread.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width)))), "op8-cells")
    spark = sources.sparkSession
    parts = max(1, min(total // shard_slots, spark.sparkContext.defaultParallelism * 4))
    slot = spark.range(0, total // shard_slots, 1, parts).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(shard_slots - 1))).alias("j"))
    drawn = slot.select("shard", F.pmod(F.xxhash64(F.lit("draw"), F.lit(seed), "shard", "j"), F.lit(total)).alias("u")).withColumn("_cell", F.floor(F.col("u") / width))
    # one row per cell and source border; a table of many sources is joined by cell instead
    spread = F.broadcast(spread) if spread.count() <= few else spread.hint("merge")
    return drawn.join(spread, "_cell").where("u >= _from and u < _to").groupBy("shard", "_s").agg(F.count(F.lit(1)).alias("n"))


def slots(sources: DataFrame, block: int, shard_slots: int, seed: int, step: int = 4096) -> DataFrame:
    """(shard, slot, _s, block, length): the mix, slot by slot; ``length`` words
    are taken from the block's beginning."""
    s = stored(_wanted(sources, block, seed), "op8-wanted")
    total = s.agg(F.sum("_slots")).first()[0] or 0
    counts = stored(running(draws(s, total, shard_slots, seed), ["_s"], "shard", "n", "_k"), "op8-draws")
    over = counts.join(s.select("_s", "_slots"), "_s").where("_k + n > _slots").agg(F.min("shard")).first()[0]
    whole = total // shard_slots if over is None else over  # shards from here on even out
    own = counts.where(F.col("shard") < whole)
    first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.select("_s", "_k", F.col("n").alias("_n"), "shard", first.alias("_slot"))
    # what the targets lack, in steps
    given = own.groupBy("_s").agg(F.sum("_n").alias("_given"))
    lack = s.join(given, "_s", "left").select("_s", "_i", F.coalesce("_given", F.lit(0)).alias("_given"), "_slots", F.lit(0).alias("_all"))
    lack = running(lack.withColumn("_lack", F.col("_slots") - F.col("_given")), ["_all"], "_i", "_lack", "_before").where("_lack > 0")
    for size in (step * step, step):
        start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lack") - 1, F.lit(size).cast("long")))
        lack = lack.withColumn("_o", start).select("_s", (F.col("_given") + F.col("_o")).alias("_given"), (F.col("_before") + F.col("_o")).alias("_before"),
                                                   F.least(F.lit(size).cast("long"), F.col("_lack") - F.col("_o")).alias("_lack"))
    rest = total - whole * shard_slots
    lack = lack.select("_s", F.col("_given").alias("_k"), F.col("_lack").alias("_n"), F.lit(None).cast("long").alias("shard"), F.col("_before").alias("_slot"))
    runs = own.unionByName(lack).join(s, "_s")
    k = runs.repartition(s.sparkSession.sparkContext.defaultParallelism * 4, "_s", "_k").withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    k = k.withColumn("k", F.col("_k") + F.col("_j")).withColumn("_slot", F.col("_slot") + F.col("_j"))
    dealt = F.lit(whole * shard_slots) + permuted(F.col("_slot"), F.lit(max(1, rest)), F.lit("rest"), F.lit(seed))
    g = F.when(F.col("shard").isNull(), dealt).otherwise(F.col("shard") * shard_slots + F.col("_slot"))
    pass_ = F.floor(F.col("k") / F.col("_blocks"))
    k = k.withColumn("_g", g).withColumn("block", permuted(F.col("k") % F.col("_blocks"), F.col("_blocks"), F.col("_s"), pass_, F.lit(seed)))
    full = F.when(F.col("block") == F.col("_blocks") - 1, F.col("_last")).otherwise(F.lit(block))
    length = F.when((F.col("k") == F.col("_slots") - 1) & (F.col("_more") > 0), F.least(full, F.col("_rest") - F.col("_got"))).otherwise(full)
    return k.select(F.floor(F.col("_g") / shard_slots).alias("shard"), (F.col("_g") % shard_slots).alias("slot"), "_s", "block", length.cast("long").alias("length"))


class Mix:
    """A mix of one corpus: ``slots`` (shard, slot, source, block, length) and
    ``per_block`` / ``documents`` derived from them."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                 weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64,
                 shard_slots: int = 4096, chunk: int = 4096, seed: int = 5):
        self.block, self.id_col = block, id_col
        docs = stored(sized(df, id_col, text, source), "op8-sizes")
        self.sources = stored(targets(docs, weights, share, most), "op8-sources")
        self.slots = slots(self.sources, block, shard_slots, seed)
        self.streams = streams(docs, self.sources, chunk)

    def uses(self) -> DataFrame:
        """(_s, block, times, cut, shard): how often a block is taken whole,
        the words that a cut slot takes of it besides, and the first shard
        that has it."""
        whole = F.when(F.col("block") == F.ceil(F.col("source_size") / self.block) - 1,
                       F.col("source_size") - F.col("block") * self.block).otherwise(F.lit(self.block))
        s = self.slots.join(self.sources.select("_s", "source_size"), "_s").withColumn("_full", F.col("length") == whole)
        return s.groupBy("_s", "block").agg(F.sum(F.col("_full").cast("long")).alias("times"),
                                            F.max(F.when(~F.col("_full"), F.col("length"))).alias("cut"), F.min("shard").alias("shard"))

    def parts(self) -> DataFrame:
        """(_id, _k, _s, size, offset, begin, end, times, shard): stretches of
        documents (word positions inside the document), how often the mix has
        them and in which shard first."""
        d = self.streams.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / self.block), F.floor((F.col("offset") + F.col("size") - 1) / self.block))))
        d = d.join(self.uses(), ["_s", "block"])
        begin = F.greatest(F.lit(0).cast("long"), F.col("block") * self.block - F.col("offset"))
        end = F.least(F.col("size"), (F.col("block") + 1) * self.block - F.col("offset"))
        middle = F.least(end, F.greatest(begin, F.col("block") * self.block + F.coalesce("cut", F.lit(0)) - F.col("offset")))
        d = d.withColumn("_p", F.array(F.struct(begin.alias("begin"), middle.alias("end"), (F.col("times") + 1).alias("times")),
                                       F.struct(middle.alias("begin"), end.alias("end"), F.col("times").alias("times"))))
        return (d.select("_id", "_k", "_s", "size", "offset", "shard", F.explode("_p").alias("p")).select("_id", "_k", "_s", "size", "offset", "shard", "p.*")
                .where("begin < end and times > 0"))

    def taken(self) -> DataFrame:
        """(id, size, source_size, target, taken, first_shard) for each document;
        first_shard is null where the mix takes nothing of it."""
        key = ["_id", "_k", "_s", "size", "offset"]
        got = self.parts().groupBy(*key).agg(F.sum((F.col("end") - F.col("begin")) * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
        same = [F.col(f"d.{c}").eqNullSafe(F.col(f"g.{c}")) for c in key]
        d = self.streams.alias("d").join(got.alias("g"), same, "left").select("d.*", "g.taken", "g.first_shard")
        return d.join(self.sources, "_s").select(F.col("_id").alias(self.id_col), "size", "source_size", "target",
                                                 F.coalesce("taken", F.lit(0)).alias("taken"), "first_shard")

    def documents(self, df: DataFrame, text: str = "text") -> DataFrame:
        """The mix as documents: rows of ``df`` with the words that the mix has
        once or more, and again with those that it has twice, in place and
        with the white space behind them."""
        place = ["_k", "offset"]
        p = self.parts().groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("begin", "end", "times"))).alias("_p"), F.max("times").alias("_most"))
        p = p.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_most")))
        p = p.select(F.col("_k").alias("_mix_k"), F.filter("_p", lambda x: x["times"] >= F.col("_copy")).alias("_mix_p"))
        held = F.aggregate("_mix_p", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
        d = df.withColumn("_mix_k", F.xxhash64(F.col(self.id_col), F.col(text))).dropDuplicates(["_mix_k"]).join(p, "_mix_k")
        spaced = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
        cut = let(spaced, lambda w: F.array_join(F.flatten(F.transform(
            "_mix_p", lambda x: F.slice(w, (x["begin"] + 1).cast("int"), (x["end"] - x["begin"]).cast("int")))), ""))
        whole = held >= F.size(words(F.col(text)))
        return d.withColumn(text, F.when(whole, F.col(text)).otherwise(cut)).drop("_mix_k", "_mix_p")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).taken()
