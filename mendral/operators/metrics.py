"""Evaluation of predictions: threshold sweeps, F-max, S-min, AUC, AUPR, per-term rates.

Nothing is densified and no threshold is crossed with facts: a protein's counts
change only at its own scores, so each change is one event at a threshold and a
running sum over the 101 thresholds of a group gives every point of its curve.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendral.plans.storage import materialize

from .hierarchy import small
from .running import running_sums

POINTS = 101


def bucket(score: Column) -> Column:
    """Greatest t in 0..100 with float(t / 100) <= float(score), as 32-bit numbers compare."""
    near = F.least(F.lit(POINTS - 1), F.greatest(F.lit(0), F.floor(score * 100 + 1e-6).cast("int")))

    def reached(t: Column) -> Column:
        return (t / F.lit(100.0)).cast("float") <= score.cast("float")

    return F.when((near < POINTS - 1) & reached(near + 1), near + 1).when(reached(near), near).otherwise(F.greatest(F.lit(0), near - 1))


#: Facts that are counted in one task.
TASK_ROWS = 100_000


def threshold_curve(predictions: DataFrame, labels: DataFrame, ic: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """One row per group and threshold t / 100, t in 0..100.

    Every labelled protein counts: recall averages over all of them, precision over
    those with a prediction at the threshold. ``ic`` has (term, ic, norm_ic) and
    also names the terms that are all predicted at threshold 0. Facts are dealt once, a
    protein's together, in as many tasks as ``rows`` (about how many there are; None: counted) ask for.
    """
    entity = [*keys, "protein"]
    info = small(ic.select("term", "ic", "norm_ic"))
    all_terms = ic.agg(F.count("*").alias("n"), F.sum("ic").alias("i"), F.sum("norm_ic").alias("w")).first()
    scored = predictions.select(*entity, "term", "score", F.lit(False).alias("label"))
    facts = scored.unionByName(labels.select(*entity, "term", F.lit(None).cast("double").alias("score"), F.lit(True).alias("label")))
    tasks = (facts.count() if rows is None else rows) // TASK_ROWS + 1
    same = Window.partitionBy(*entity, "term")
    first = F.row_number().over(same.orderBy(F.desc("label")))
    dealt = facts.repartition(max(tasks, predictions.sparkSession.sparkContext.defaultParallelism), *entity)
    # labels come first: a row after them is a label that is repeated, or a prediction that hits; a protein's labels have b = -1
    met = dealt.select("*", (F.max("label").over(same) & F.col("term").isNotNull()).cast("int").alias("h"), first.alias("k")).where("NOT label OR k = 1").join(info, "term", "left").withColumn("b", F.when(F.col("label"), -1).otherwise(bucket(F.col("score"))))
    i, w = F.coalesce("ic", F.lit(0.0)), F.coalesce("norm_ic", F.lit(0.0))
    steps = met.where("b <> 0").groupBy(*entity, "b").agg(F.count("*").alias("n"), F.sum("h").alias("tp"), F.sum(w * F.col("h")).alias("wtp"), F.sum(w).alias("wn"), F.sum(i * F.col("h")).alias("itp"), F.sum(i).alias("inn"))
    down = Window.partitionBy(*entity).orderBy(F.desc("b"))
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*entity)
    own = {name: F.max(F.when(F.col("b") < 0, F.col(c))).over(every).alias(name) for name, c in (("nl", "n"), ("il", "inn"), ("wl", "wn"))}
    sums = [F.when(F.col("b") > 0, F.sum(c).over(upto)).alias(c) for c in ("n", "tp", "wtp", "wn", "itp", "inn")]
    state = steps.select(*entity, "b", F.greatest(F.coalesce(F.lead("b").over(down), F.lit(0)), F.lit(0)).alias("low"), *sums, *own.values()).where("nl IS NOT NULL").where((F.col("b") < 0) | reduce(Column.__and__, [F.col(c).isNotNull() for c in entity]))
    value = {
        "p": F.col("tp") / F.col("n"),
        "r": F.col("tp") / F.col("nl"),
        "wp": F.when(F.col("wn") > 0, F.col("wtp") / F.col("wn")).otherwise(0.0),
        "wr": F.when(F.col("wl") > 0, F.col("wtp") / F.col("wl")).otherwise(0.0),
        "some": F.lit(1.0),
        "itp": F.col("itp"),
        "ifp": F.col("inn") - F.col("itp"),
        "tp": F.col("tp").cast("double"),
        "fp": (F.col("n") - F.col("tp")).cast("double"),
    }
    n_all, w_all = float(all_terms["n"] or 0), float(all_terms["w"] or 0.0)
    # what begins at b ends below the next lower step; rows of a protein's labels stay at t = -1, once
    at_b, at_low = F.struct(F.col("b").alias("t"), F.lit(1.0).alias("sign")), F.struct(F.col("low").alias("t"), F.lit(-1.0).alias("sign"))
    events = state.select(*keys, "nl", "il", "wl", F.explode(F.when(F.col("b") > 0, F.array(at_b, at_low)).otherwise(F.array(at_b))).alias("e"), *[v.alias(f"v_{k}") for k, v in value.items()])
    summed = materialize(
        events.where("e.t <> 0").groupBy(*keys, F.col("e.t").alias("t")).agg(
            *[F.sum(F.col("e.sign") * F.col(f"v_{k}")).alias(k) for k in value],
            F.count("*").alias("proteins"), F.sum("nl").alias("sum_nl"), F.sum("il").alias("sum_il"),
            F.avg(F.col("nl") / n_all).alias("p0"), F.avg(F.when(F.lit(w_all) > 0, F.col("wl") / w_all).otherwise(0.0)).alias("wp0"), F.avg(F.when(F.col("wl") > 0, 1.0).otherwise(0.0)).alias("wr0"),
        ),
        "curve-events",
    )
    totals = summed.where("t = -1").select(*keys, "proteins", "sum_nl", "sum_il", "p0", "wp0", "wr0")
    summed = summed.where("t > 0").select(*keys, "t", *value)
    grid = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("t"))
    above = Window.partitionBy(*keys).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow) if keys else Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = grid.join(summed, [*keys, "t"], "left").select(*keys, "t", "proteins", "sum_nl", "sum_il", "p0", "wp0", "wr0", *[F.round(F.sum(F.coalesce(k, F.lit(0.0))).over(above), 9).alias(k) for k in value])
    z, n = F.col("t") == 0, F.col("proteins")

    def at(zero: Column, else_: Column) -> Column:
        return F.when(z, zero).otherwise(else_)

    c = c.select(
        *keys, "t", "proteins",
        at(F.col("p0"), F.when(F.col("some") > 0.5, F.col("p") / F.col("some")).otherwise(0.0)).alias("precision"),
        at(F.lit(1.0), F.col("r") / n).alias("recall"),
        at(F.col("wp0"), F.when(F.col("some") > 0.5, F.col("wp") / F.col("some")).otherwise(0.0)).alias("wprecision"),
        at(F.col("wr0"), F.col("wr") / n).alias("wrecall"),
        at(F.lit(0.0), (F.col("sum_il") - F.col("itp")) / n).alias("ru"),
        at((F.lit(float(all_terms["i"] or 0.0)) * n - F.col("sum_il")) / n, F.col("ifp") / n).alias("mi"),
        at(F.lit(float(all_terms["i"] or 0.0)), (F.col("itp") + F.col("ifp")) / n).alias("avg_ic"),
        at(F.col("sum_nl").cast("double"), F.col("tp")).cast("long").alias("tp"),
        at(F.lit(n_all) * n - F.col("sum_nl"), F.col("fp")).cast("long").alias("fp"),
    )
    return c.select("*", harmonic("precision", "recall").alias("f"), harmonic("wprecision", "wrecall").alias("wf"), F.sqrt(F.col("ru") ** 2 + F.col("mi") ** 2).alias("s"))


def harmonic(a: str, b: str) -> Column:
    return F.when(F.col(a) + F.col(b) > 0, 2 * F.col(a) * F.col(b) / (F.col(a) + F.col(b))).otherwise(0.0)


def summary(curve: DataFrame, keys: list[str]) -> DataFrame:
    """fmax, tmax (the first threshold that reaches it), smin, wfmax, aupr and what holds at tmax."""
    r9 = lambda c: F.round(F.col(c), 9)
    order = Window.partitionBy(*keys).orderBy(r9("recall"), "t") if keys else Window.orderBy(r9("recall"), "t")
    area = curve.withColumn("a", (F.col("recall") - F.lag("recall").over(order)) * (F.col("precision") + F.lag("precision").over(order)) / 2)
    best = F.max(F.struct(r9("f").alias("f"), (-F.col("t")).alias("m"), "precision", "recall", "avg_ic", "tp", "fp"))
    out = area.groupBy(*keys).agg(best.alias("b"), F.min("s").alias("smin"), F.max(F.struct(r9("wf").alias("f"), (-F.col("t")).alias("m"))).alias("w"), F.sum("a").alias("aupr"))
    return out.select(*keys, F.col("b.f").alias("fmax"), (-F.col("b.m") / 100.0).alias("tmax"), "smin", F.col("w.f").alias("wfmax"), (-F.col("w.m") / 100.0).alias("wtmax"), "aupr", F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"), F.col("b.avg_ic").alias("avg_ic"), F.col("b.tp").alias("tp"), F.col("b.fp").alias("fp"))


def term_auc(predictions: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, n_pos, auc): exact rank AUC per term; labelled proteins without a score have 0.

    Terms without both classes have a null AUC. Equal scores are one tie group.
    """
    entity = [*keys, "protein"]
    lab = labels.select(*entity, "term").distinct()
    proteins = lab.select(*entity).distinct()
    total = proteins.groupBy(*keys).agg(F.count("*").alias("n")) if keys else proteins.agg(F.count("*").alias("n"))
    pos = lab.groupBy(*keys, "term").agg(F.count("*").alias("n_pos"))
    scored = predictions.select(*entity, "term", F.col("score").cast("float").alias("score")).where("score > 0").join(proteins, entity, "left_semi").join(lab.withColumn("hit", F.lit(1)), [*entity, "term"], "left")
    ties = scored.groupBy(*keys, "term", "score").agg(F.count("*").alias("k"), F.count("hit").alias("h"))
    ranked = running_sums(ties, [*keys, "term"], [F.asc("score")], {"before": "k"})
    per = ranked.groupBy(*keys, "term").agg(F.sum("k").alias("scored"), F.sum("h").alias("hits"), F.sum(F.col("h") * (F.col("before") + (F.col("k") + 1) / 2)).alias("ranks"))
    joined = pos.join(per, [*keys, "term"], "left").join(total, keys) if keys else pos.join(per, ["term"], "left").join(F.broadcast(total), F.lit(True))
    absent = F.col("n") - F.coalesce("scored", F.lit(0))
    hits = F.coalesce("hits", F.lit(0))
    rank_sum = F.coalesce("ranks", F.lit(0.0)) + hits * absent + (F.col("n_pos") - hits) * (absent + 1) / 2
    auc = (rank_sum - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * (F.col("n") - F.col("n_pos")))
    return joined.select(*keys, "term", "n_pos", F.when((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")), auc).alias("auc"))


def term_rates(predictions: DataFrame, labels: DataFrame, tmax: DataFrame | float, keys: list[str]) -> DataFrame:
    """(keys, term, tp, fp, fn, tn, sensitivity, specificity) at a threshold per group (keys, tmax) or one for all."""
    entity = [*keys, "protein"]
    lab = labels.select(*entity, "term").distinct().withColumn("hit", F.lit(1))
    proteins = lab.select(*entity).distinct()
    total = proteins.groupBy(*keys).agg(F.count("*").alias("n"))
    called = predictions.select(*entity, "term", "score").join(proteins, entity, "left_semi")
    called = called.join(small(tmax.select(*keys, "tmax")), keys) if isinstance(tmax, DataFrame) else called.withColumn("tmax", F.lit(tmax))
    called = called.where("CAST(score AS FLOAT) >= CAST(tmax AS FLOAT)").select(*entity, "term", F.lit(1).alias("call"))
    both = lab.join(called, [*entity, "term"], "full_outer").groupBy(*keys, "term").agg(F.count_if(F.col("hit").isNotNull() & F.col("call").isNotNull()).alias("tp"), F.count_if(F.col("hit").isNull()).alias("fp"), F.count_if(F.col("call").isNull()).alias("fn"))
    out = both.join(total, keys).withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn"))
    return out.select(*keys, "term", "tp", "fp", "fn", "tn", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).alias("sensitivity"), F.when(F.col("tn") + F.col("fp") > 0, F.col("tn") / (F.col("tn") + F.col("fp"))).alias("specificity"))


def pooled_curve(scored: DataFrame) -> DataFrame:
    """(t, tp, fp, fn, precision, recall, f) of all (score, label) pairs together."""
    b = scored.select(bucket(F.col("score")).alias("t"), "label").groupBy("t").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    grid = scored.sparkSession.range(POINTS).select(F.col("id").cast("int").alias("t")).join(b, "t", "left")  # 101 rows from here on
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(0))
    c = grid.select("t", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("called"), F.sum(F.coalesce("p", F.lit(0))).over(w).alias("tp"), F.sum(F.coalesce("p", F.lit(0))).over(every).alias("pos"))
    c = c.select("t", "tp", (F.col("called") - F.col("tp")).alias("fp"), (F.col("pos") - F.col("tp")).alias("fn"))
    pr = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rc = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return c.select("*", pr.alias("precision"), rc.alias("recall")).select("*", harmonic("precision", "recall").alias("f"))


def _tie_groups(scored: DataFrame, rising: bool) -> DataFrame:
    """Distinct scores with k rows and h hits, and what comes before each (bk, bh)."""
    ties = scored.groupBy("score").agg(F.count("*").alias("k"), F.sum("label").alias("h"))
    return running_sums(ties, [], [F.asc("score") if rising else F.desc("score")], {"bk": "k", "bh": "h"})


def pooled_auc(scored: DataFrame) -> DataFrame:
    """One row (auc): exact over pooled (score in [0, 1], label)."""
    r = _tie_groups(scored, rising=True)
    s = r.agg(F.sum(F.col("h") * (F.col("bk") + (F.col("k") + 1) / 2)).alias("r"), F.sum("h").alias("p"), F.sum("k").alias("n"))
    return s.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row (ap): precision at each distinct score, weighted by the recall it adds."""
    r = _tie_groups(scored, rising=False)
    return r.agg((F.sum(F.col("h") * (F.col("bh") + F.col("h")) / (F.col("bk") + F.col("k"))) / F.sum("h")).alias("ap"))


def matthews(scored: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Matthews correlation of label and ``score >= threshold``; 0 if a margin is empty."""
    call, lab = F.col("score") >= threshold, F.col("label") == 1
    c = scored.groupBy(*keys).agg(F.count_if(call & lab).cast("double").alias("tp"), F.count_if(call & ~lab).cast("double").alias("fp"), F.count_if(~call & lab).cast("double").alias("fn"), F.count_if(~call & ~lab).cast("double").alias("tn"))
    d = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    return c.select(*keys, F.when(d > 0, (F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / d).otherwise(0.0).alias("mcc"))


def spread(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, least, greatest and number of a measure."""
    v = F.col(value)
    return rows.groupBy(*(keys or [])).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def evaluate(predictions: DataFrame, labels: DataFrame, ic: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group of labels: curve summary, mean AUC, mean sensitivity and specificity at tmax.

    A group without any prediction above 0 has all measures 0 and an infinite smin.
    """
    curve = threshold_curve(predictions, labels, ic, keys)
    best = summary(curve, keys)
    auc = term_auc(predictions, labels, keys).groupBy(*keys).agg(F.coalesce(F.avg("auc"), F.lit(0.0)).alias("avg_auc"))
    rates = term_rates(predictions, labels, best, keys).groupBy(*keys).agg(F.coalesce(F.avg("sensitivity"), F.lit(0.0)).alias("sensitivity"), F.coalesce(F.avg("specificity"), F.lit(0.0)).alias("specificity"))
    some = predictions.where("score > 0").join(labels.select(*keys, "protein").distinct(), [*keys, "protein"], "left_semi").select(*keys).distinct().withColumn("__some", F.lit(1))
    out = best.join(auc, keys).join(rates, keys).join(some, keys, "left")
    zero = {c: F.when(F.col("__some").isNull(), 0.0).otherwise(F.col(c)) for c in ("fmax", "tmax", "wfmax", "wtmax", "aupr", "precision", "recall", "avg_auc", "sensitivity", "specificity")}
    return out.withColumns({**zero, "smin": F.when(F.col("__some").isNull(), float("inf")).otherwise(F.col("smin"))}).drop("__some")
