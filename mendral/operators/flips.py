"""What a repair changed: rates, rankings, soft penalties, bins, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .annotate import above
from .hierarchy import small

KEY = ["genome", "protein", "term"]


def changes(before: DataFrame, after: DataFrame, tau: float) -> DataFrame:
    """(keys, pre, post, demoted, promoted) of all pairs on either side."""
    j = before.select(*KEY, F.col("score").alias("pre")).join(after.select(*KEY, F.col("score").alias("post")), KEY, "full_outer")
    was, is_ = F.coalesce(F.col("pre") > tau, F.lit(False)), F.coalesce(F.col("post") > tau, F.lit(False))
    return j.select(*KEY, "pre", "post", (was & ~is_).alias("demoted"), (~was & is_).alias("promoted"))


def flip_rate(before: DataFrame, after: DataFrame, tau: float) -> DataFrame:
    """(genome, above, demoted, pct)."""
    kept = above(after, tau).select(*KEY).withColumn("kept", F.lit(True))
    rows = above(before, tau).select(*KEY).join(kept, KEY, "left").groupBy("genome").agg(F.count("*").alias("above"), F.count_if(F.col("kept").isNull()).alias("demoted"))
    return rows.withColumn("pct", 100.0 * F.col("demoted") / F.col("above"))


def flip_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (common, either, jaccard) of two sets of flips; 1 if both are empty."""
    cols = a.columns
    j = a.distinct().withColumn("__a", F.lit(1)).join(b.select(*cols).distinct().withColumn("__b", F.lit(1)), cols, "full_outer")
    s = j.agg(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("common"), F.count("*").alias("either"))
    return s.select("common", "either", F.when(F.col("either") > 0, F.col("common") / F.col("either")).otherwise(1.0).alias("jaccard"))


def soft_sweep(violating: DataFrame, lambdas: list[float], tau: float) -> DataFrame:
    """Per penalty: violating rows whose margin is below it, residual, share removed and cost.

    ``violating`` has scores above tau. One pass: each penalty is a conditional sum.
    """
    m = F.round(F.col("score") - tau, 9)
    aggs = [F.count("*").alias("total")]
    for i, x in enumerate(lambdas):
        aggs += [F.count_if(m < x).alias(f"n{i}"), F.sum(F.when(m < x, m).otherwise(0.0)).alias(f"c{i}")]
    one = violating.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("penalty"), F.col(f"n{i}").alias("removed"), (F.col("total") - F.col(f"n{i}")).alias("residual"), F.coalesce(f"c{i}", F.lit(0.0)).alias("cost"), F.col("total").alias("total")) for i, x in enumerate(lambdas)]))
    return one.select(rows.alias("r")).select("r.*").withColumn("pct", F.when(F.col("total") > 0, 100.0 * F.col("removed") / F.col("total")).otherwise(0.0))


def term_changes(before: DataFrame, after: DataFrame, tau: float) -> DataFrame:
    """Per term: demotions and promotions, their costs, proteins, mean and greatest score before.

    Raising a score that was there does not count as an addition.
    """
    c = changes(before, after, tau)
    cost = F.abs(F.coalesce("pre", F.lit(0.0)) - tau)
    added = F.col("promoted") & F.col("pre").isNull()
    return c.groupBy("term").agg(
        F.count_if(F.col("demoted")).alias("demotions"), F.count_if(F.col("promoted")).alias("promotions"), F.count_if(added).alias("additions"),
        F.sum(F.when(F.col("demoted"), cost).otherwise(0.0)).alias("demotion_cost"), F.sum(F.when(F.col("promoted"), cost).otherwise(0.0)).alias("promotion_cost"),
        F.count_distinct(F.when(F.col("demoted") | F.col("promoted"), F.concat_ws(":", "genome", "protein"))).alias("proteins"), F.avg("pre").alias("mean_pre"), F.max("pre").alias("max_pre"),
    ).where("demotions + promotions > 0")


def violation_ranking(listing: DataFrame, most: int) -> DataFrame:
    """(term, kind, taxon) by distinct genomes and annotations, a total order, ``most`` rows."""
    r = listing.groupBy("term", "kind", "taxon").agg(F.count_distinct("genome").alias("genomes"), F.count("*").alias("annotations"))
    return r.orderBy(F.desc("genomes"), F.desc("annotations"), "term", "kind", "taxon").limit(most)


def parse_bins(spec: str) -> list[tuple[int, int | None]]:
    """``1,2-5,101+`` -> [(1, 1), (2, 5), (101, None)]."""
    out: list[tuple[int, int | None]] = []
    for part in (x.strip() for x in spec.split(",")):
        if part.endswith("+"):
            out.append((int(part[:-1]), None))
        elif "-" in part:
            a, b = part.split("-", 1)
            out.append((int(a), int(b)))
        elif part:
            out.append((int(part), int(part)))
    return out


def binned(rows: DataFrame, size: str, value: str, bins: list[tuple[int, int | None]]) -> DataFrame:
    """Per bin of ``size``: n, mean, median, sample deviation (0 under two rows), share of positive values. Empty bins stay."""
    labels = [f"{a}+" if b is None else (str(a) if a == b else f"{a}-{b}") for a, b in bins]
    which: Column = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(bins))):
        which = F.when((F.col(size) >= a) & (F.lit(True) if b is None else F.col(size) <= b), i).otherwise(which)
    stats = rows.withColumn("i", which).where("i IS NOT NULL").groupBy("i").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), (100.0 * F.count_if(F.col(value) > 0) / F.count("*")).alias("pct"))
    table = rows.sparkSession.createDataFrame(list(enumerate(labels)), "i int, bin string")
    return table.join(stats, "i", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean", "median", F.when(F.col("n").isNotNull(), F.coalesce("std", F.lit(0.0))).alias("std"), "pct")


def flip_precision(changed: DataFrame, labels: DataFrame) -> DataFrame:
    """Per term: false positives removed over all demoted; null without any."""
    d = changed.where("demoted").join(labels.select(*KEY).distinct().withColumn("hit", F.lit(1)), KEY, "left")
    return d.groupBy("term").agg(F.count_if(F.col("hit").isNull()).alias("fp_removed"), F.count("hit").alias("tp_lost")).withColumn("precision", F.try_divide(F.col("fp_removed"), F.col("fp_removed") + F.col("tp_lost")))


def against_members(changed: DataFrame, index: DataFrame) -> DataFrame:
    """(genome, protein, term, kind, covered, member): each change, and whether curated members of its term are known and hold its protein."""
    c = changed.where("demoted OR promoted").join(small(index.select("genome", "term", "subunits")), ["genome", "term"], "left")
    return c.select("genome", "protein", "term", F.when(F.col("promoted"), "promotion").otherwise("demotion").alias("kind"), F.col("subunits").isNotNull().alias("covered"), F.coalesce(F.array_contains("subunits", F.col("protein")), F.lit(False)).alias("member"))


def coverage_examples(changed: DataFrame, index: DataFrame, most: int = 25) -> DataFrame:
    """The first covered changes of each kind in order of genome, term and protein: a report, ``most`` of a kind."""
    c = against_members(changed, index).where("covered").drop("covered")
    first = lambda kind: c.where(F.col("kind") == kind).orderBy("genome", "term", "protein").limit(most)
    return first("demotion").unionByName(first("promotion"))


def coverage(changed: DataFrame, index: DataFrame) -> DataFrame:
    """Promotions and demotions against curated members (taxon of genome, term, subunits).

    Shares are null when nothing is covered.
    """
    c = against_members(changed, index)
    good = F.when(F.col("kind") == "promotion", F.col("member")).otherwise(~F.col("member"))
    out = c.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("covered")).alias("covered"), F.count_if(F.col("covered") & good).alias("good"))
    pct = lambda a, b: F.round(F.try_divide(100.0 * F.col(a), F.col(b)), 2)
    return out.select("kind", "n", "covered", "good", pct("covered", "n").alias("covered_pct"), pct("good", "covered").alias("good_pct"))


def ranking_tables(changed_terms: DataFrame, k: int) -> dict[str, DataFrame]:
    """The four tables of a flip ranking: most flips, highest cost, all, and one row of totals."""
    flips = F.col("demotions") + F.col("promotions")
    cost = F.col("demotion_cost") + F.col("promotion_cost")
    rows = changed_terms.withColumns({"flips": flips, "cost": cost})
    return {
        "by_count": rows.orderBy(F.desc("flips"), "term").limit(k),
        "by_cost": rows.orderBy(F.desc("cost"), "term").limit(k),
        "all": rows.orderBy("term"),
        "summary": rows.agg(F.count("*").alias("terms"), F.sum("flips").alias("flips"), F.sum("cost").alias("cost")),
    }
