"""Temperature mixing of sources under a token budget.

Weights are source token shares to the power alpha, normalised.  Alpha is found by bisection: the largest one at which the
weights reach the target entropy, raised where a source would repeat more often than allowed.
Each source then gives floor(weight * budget) tokens: whole passes over its documents, and for the rest the first documents of one more
pass.  A pass is a block permutation: documents fall into 4096 blocks of 4096 parts by hash, and pass e visits them in the order
of the hash with a mask of its own, so every pass has an order of blocks (and inside them) of its own.

The cut of the last pass is found from sums of blocks, then of the parts of one block, then of the documents of one part; no
window holds more than 4096 sums or the documents of one part of 16 million.  DataFrame operations only.

Defined results: a null source is the source ""; a null text has no tokens; sources without tokens get no weight and their documents no
copy; a document without tokens in a source with tokens takes part; repeated rows are documents of their own and enter a cut pass
together or not at all; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcheck.llm.common import written

ENTROPY_SHARE = 0.5  # target entropy: so far from that of the shares to that of equal weights
MAX_REPEATS = 4.0  # passes over a source
MIX_BLOCKS = 64  # blocks of the mixed order
SEED = "mix-1"
BITS = 12  # of a block and of a part in it
STEPS = 50
SMALL_TABLE = 100_000  # sources that may be broadcast


def hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def measured(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str = SEED) -> DataFrame:
    """id, source, n_tokens and hash of every document, as a table."""
    n_tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    found = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), n_tokens.alias("n_tokens"),
        hash60(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("hash"),
    )
    return written(found, "mix-documents")


def weights(shares: Column, alpha: Column) -> Column:
    powers = F.transform(shares, lambda p: F.pow(p, alpha))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def entropy(w: Column) -> Column:
    return -F.aggregate(w, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def bisected(low: Column, high: Column, holds) -> Column:
    """The place where ``holds`` turns from true (below) to false."""
    start = F.struct(low.cast("double").alias("lo"), high.cast("double").alias("hi"))

    def half(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.when(holds(mid), F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, half)["lo"]


def source_plan(counts: DataFrame, budget: int | None, entropy_share: float, max_repeats: float) -> DataFrame:
    """(source, source_tokens, target, passes, rest) from (source, n_tokens); one row holds the sums of all sources."""
    one = counts.filter("n_tokens > 0").agg(F.array_sort(F.collect_list(F.struct("source", "n_tokens"))).alias("s"), F.sum("n_tokens").alias("total"))
    one = one.withColumn("budget", F.col("total") if budget is None else F.lit(budget).cast("bigint"))
    one = one.withColumn("p", F.transform("s", lambda x: x["n_tokens"] / F.col("total")))
    natural = entropy(F.col("p"))
    one = one.withColumn("wanted", natural + F.lit(entropy_share) * (F.ln(F.size("s")) - natural))
    one = one.withColumn("by_entropy", bisected(F.lit(0.0), F.lit(1.0), lambda a: entropy(weights(F.col("p"), a)) >= F.col("wanted")))

    def too_often(alpha: Column) -> Column:
        most = F.array_max(F.zip_with(weights(F.col("p"), alpha), "p", lambda w, p: w / p))
        return most * F.col("budget") / F.col("total") > max_repeats

    raised = F.when(too_often(F.col("by_entropy")), bisected(F.col("by_entropy"), F.lit(1.0), too_often)).otherwise(F.col("by_entropy"))
    one = one.withColumn("alpha", F.round(raised, 6)).withColumn("w", weights(F.col("p"), F.col("alpha")))
    each = one.select("budget", F.posexplode("s").alias("k", "x"), "w").select(
        F.col("x.source").alias("source"), F.col("x.n_tokens").alias("source_tokens"), F.floor(F.element_at("w", F.col("k") + 1) * F.col("budget")).cast("bigint").alias("target")
    )
    return each.withColumn("passes", F.floor(F.col("target") / F.col("source_tokens"))).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_tokens"))


def masks(seed: str, passes: Column) -> Column:
    return hash60(F.concat(F.lit(f"{seed}:pass:"), passes.cast("string")))


def cut(sums: DataFrame, slot: str, rest: Column, name: str) -> DataFrame:
    """(source, the first slot that does not fit as a whole, what is left for it); slots are at most 4096 for each source."""
    upto = F.sum("n_tokens").over(W.partitionBy("source").orderBy(slot))
    over = sums.withColumn("upto", upto).filter(F.col("upto") > rest)
    return over.groupBy("source").agg(F.min(F.struct(F.col(slot).alias("at"), (rest - F.col("upto") + F.col("n_tokens")).alias("left"))).alias("c")).select(
        "source", F.col("c.at").alias(name), F.col("c.left").alias(f"{name}_left")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    budget: int | None = None,
    entropy_share: float = ENTROPY_SHARE,
    max_repeats: float = MAX_REPEATS,
    mix_blocks: int = MIX_BLOCKS,
    seed: str = SEED,
) -> DataFrame:
    """One row for each copy of a document: the id, source, n_tokens, epoch, block (of the mixed order), order_key, source_target.

    Without a budget the mix has as many tokens as the corpus.
    """
    found = measured(docs, id_col, source_col, text_col, seed)
    counts = found.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    plan = written(source_plan(counts, budget, entropy_share, max_repeats).withColumn("mask", masks(seed, F.col("passes"))), "mix-sources")
    small = F.broadcast if plan.count() <= SMALL_TABLE else lambda df: df  # else a skewed join, which AQE splits

    key = F.col("hash").bitwiseXOR(F.col("mask"))
    part = F.shiftright(key, 60 - 2 * BITS).bitwiseAND((1 << BITS) - 1)
    placed = found.join(small(plan), "source").select("*", key.alias("key"), F.shiftright(key, 60 - BITS).alias("slot"), part.alias("part"))
    total = F.sum("n_tokens").alias("n_tokens")
    first = cut(placed.groupBy("source", "slot", "rest").agg(total), "slot", F.col("rest"), "cut1")
    inside = placed.join(small(first), "source").filter("slot = cut1")
    second = cut(inside.groupBy("source", "part", "cut1_left").agg(total), "part", F.col("cut1_left"), "cut2")
    last = inside.join(small(second), "source").filter("part = cut2")
    upto = F.sum("n_tokens").over(W.partitionBy("source").orderBy("key", "id", "n_tokens"))
    fits = last.withColumn("upto", upto).filter("upto <= cut2_left")
    # The last document of the cut, by its place in the pass: at most one row for each source.
    stop = fits.groupBy("source").agg(F.max(F.struct("key", F.col("id").alias("last_id"), F.col("n_tokens").alias("last_n"))).alias("stop"))
    bounds = first.join(second, "source", "left").join(stop, "source", "left")

    before = F.struct("key", F.col("id").alias("last_id"), F.col("n_tokens").alias("last_n")) <= F.col("stop")
    in_part = (F.col("part") < F.col("cut2")) | ((F.col("part") == F.col("cut2")) & before)
    extra = (F.col("slot") < F.col("cut1")) | ((F.col("slot") == F.col("cut1")) & in_part)
    copies = F.col("passes") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    taken = placed.join(small(bounds), "source", "left").withColumn("copies", copies).filter("copies > 0")
    each = taken.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("epoch"))
    order_key = F.col("hash").bitwiseXOR(masks(seed, F.col("epoch")))
    # Where the copy stands in all the source gives, from 0 to 1.
    share = (F.col("epoch") + order_key / float(1 << 60)) * F.col("source_tokens") / F.col("target")
    block = F.least(F.floor(share * mix_blocks), F.lit(mix_blocks - 1)).cast("bigint")
    return each.select(
        F.col("id").alias(id_col), "source", "n_tokens", "epoch", block.alias("block"), order_key.alias("order_key"), F.col("target").alias("source_target")
    )
