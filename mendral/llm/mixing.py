"""Mixing sources by temperature, realised as budgeted block permutations.

Source shares of tokens raised to an exponent and normalised are the weights of
a mixture. The exponent is bisected between 0 (all sources alike) and 1 (shares
as they are): it is the largest at which the entropy reaches a target, or the
smallest at which no source is repeated more often than a limit allows. The
budget defaults to the least one at which every source is read once in whole, so
that nothing is dropped. A source's budget is spent on whole passes and a part of
one more pass. Each pass is a permutation of its own, by a hash of id and pass;
the part is the beginning of its permutation, found by running totals over
blocks of it. What a source needs of a document is then one comparison of its
place with the source's last place: texts are never shuffled.

Defined results: tokens are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have
none, cost nothing and are in every whole pass. A null source is a source of its
own. Sources without tokens are read once. Rows that repeat an id share its place
and are taken or left together, as are rows whose places tie. A text counts its
tokens whatever its length. An empty table gives an empty result. Other columns
are never read, whatever their names; ``mix`` passes them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, own, unused
from .ranking import block_rows, near, running_total

#: No source is read more often than this.
MAX_REPEATS = 2.0
STEPS = 60


def source_key() -> Column:
    """Sources with a mark before them; the null source is the empty string."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))


def place(epoch: Column) -> Column:
    """Place of a document in the permutation of a pass: 52 bits of a hash of its id and the pass."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), epoch).cast("binary")), 1, 13), 16, 10).cast("long")


def exponent(totals: DataFrame, max_repeats: float | None, target_entropy: float | None) -> float | None:
    """The exponent for (tokens) of each source with tokens; None without any."""
    sizes = totals.where("tokens > 0")
    if target_entropy is not None:
        return by_entropy(sizes, target_entropy)
    ends = sizes.agg(F.min("tokens").cast("double").alias("a"), F.max("tokens").cast("double").alias("z")).where("a IS NOT NULL")
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        few = F.pow(F.col("z") / F.col("a"), 1 - mid) <= max_repeats
        return F.when(few, F.struct(s["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), s["hi"].alias("hi")))

    found = ends.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["hi"].alias("tau")).first()
    return found["tau"] if found else None


#: Exponents tried at once while an entropy is sought.
TRIES = 63


def by_entropy(sizes: DataFrame, target: float) -> float | None:
    """The largest exponent up to 1 at which the entropy reaches the target (0 if none does), bracketed by one aggregation for each 64th."""
    lo, hi = 0.0, 1.0
    while hi - lo > 2.0**-STEPS and (lo + hi) / 2 not in (lo, hi):
        step = (hi - lo) / (TRIES + 1)
        tries = F.array(*[F.lit(lo + step * (k + 1)) for k in range(TRIES)])
        v = sizes.select(F.log(F.col("tokens").cast("double")).alias("l"), F.explode(tries).alias("m")).withColumn("v", F.exp(F.col("l") * F.col("m")))
        rows = v.groupBy("m").agg(F.sum("v").alias("z"), F.sum(F.col("v") * F.col("l") * F.col("m")).alias("s")).select("m", (F.log("z") - F.col("s") / F.col("z")).alias("h")).collect()
        if not rows:
            return None
        reached = [r["m"] for r in rows if r["h"] >= target]
        lo = max(reached, default=lo)
        hi = min([m for r in rows if (m := r["m"]) > lo and r["h"] < target], default=hi)
    return lo


def counted(docs: DataFrame) -> DataFrame:
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select("doc_id", "source", source_key().alias("key"), tokens.alias("n_tokens"))


def plan(base: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(key, passes, cut) of each source: whole passes, and the last place of the pass after them (or -1)."""
    totals = materialize(base.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "source-totals")
    found = exponent(totals, max_repeats, target_entropy)
    tau = 1.0 if found is None else found
    sums = totals.where("tokens > 0").withColumn("v", F.pow(F.col("tokens").cast("double"), F.lit(tau)))
    whole = sums.agg(F.max(F.col("tokens") / F.col("v")).alias("scale"), F.sum("v").alias("z")).first()
    scale = (whole["scale"] or 0.0) if budget is None else budget / (whole["z"] or 1.0)
    budgets = sums.select("key", "tokens", "n", F.floor(F.lit(scale) * F.col("v") + 0.5).cast("long").alias("b"))
    passes = materialize(
        budgets.select("key", "n", F.floor(F.col("b") / F.col("tokens")).cast("int").alias("passes"), (F.col("b") % F.col("tokens")).alias("rest")).unionByName(
            totals.where("tokens = 0").select("key", "n", F.lit(1).alias("passes"), F.lit(0).cast("long").alias("rest"))
        ),
        "source-passes",
    )
    wide = materialize(
        base.join(near(passes.where("rest > 0")), "key")
        .withColumn("place", place(F.col("passes") + 1))
        .withColumn("block", F.floor(F.col("place") / F.ceil(F.lit(1 << 52) / F.ceil(F.col("n") / block_rows(F.col("n"))))).cast("int"))
        .select("key", "block", "place", "n_tokens", "rest"),
        "source-places",
    )
    cut = running_total(wide, ["key"], "block", ["place"], F.col("n_tokens"), "through", ties=True).where("through <= rest").groupBy("key").agg(F.max("place").alias("cut"))
    return materialize(passes.join(cut, "key", "left").select("key", "passes", F.coalesce("cut", F.lit(-1).cast("long")).alias("cut")), "source-plan")


def passes_of() -> Column:
    """The passes a row is read in, from its id and the plan of its source."""
    whole = F.when(F.col("passes") > 0, F.sequence(F.lit(1), F.col("passes"))).otherwise(F.array().cast("array<int>"))
    return F.when(place(F.col("passes") + 1) <= F.col("cut"), F.concat(whole, F.array(F.col("passes") + 1))).otherwise(whole)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = materialize(counted(documents(spark, sf_dir)), "mixing-base")
    read = base.join(near(plan(base)), "key").select("doc_id", "source", "n_tokens", F.explode(passes_of()).alias("epoch"))
    return read.select("doc_id", "source", "n_tokens", "epoch", place(F.col("epoch")).alias("place"))


def mix(docs: DataFrame, **target) -> DataFrame:
    """The documents as often as they are read, with their own columns."""
    key, until, epoch = unused(docs, "mixing_key", "mixing_plan", "mixing_pass")
    base = materialize(counted(docs), "mixing-base")
    known = near(plan(base, **target)).select(F.col("key").alias(key), F.struct("passes", "cut").alias(until))
    read = docs.join(known, source_key() == F.col(key))
    p, c = F.col(f"{until}.passes"), F.col(f"{until}.cut")
    times = p + F.when(place(p + 1) <= c, 1).otherwise(0)
    return read.select(*own(docs), F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))).alias(epoch)).drop(epoch)


ORACLE = rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
totals AS (SELECT key, sum(n_tokens)::BIGINT AS tokens, count(*) AS n FROM base GROUP BY key),
ends AS (SELECT min(tokens)::DOUBLE AS a, max(tokens)::DOUBLE AS z FROM totals WHERE tokens > 0),
bisect AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN pow(z / a, 1 - (lo + hi) / 2) <= {MAX_REPEATS} THEN lo ELSE (lo + hi) / 2 END, CASE WHEN pow(z / a, 1 - (lo + hi) / 2) <= {MAX_REPEATS} THEN (lo + hi) / 2 ELSE hi END
  FROM bisect, ends WHERE i < {STEPS}),
sums AS (SELECT key, tokens, n, pow(tokens::DOUBLE, (SELECT hi FROM bisect WHERE i = {STEPS})) AS v FROM totals WHERE tokens > 0),
budgets AS (SELECT key, tokens, floor((SELECT max(tokens / v) FROM sums) * v + 0.5)::BIGINT AS b FROM sums),
passes AS (
  SELECT key, b // tokens AS passes, b % tokens AS rest FROM budgets
  UNION ALL SELECT key, 1, 0 FROM totals WHERE tokens = 0),
places AS (SELECT base.*, passes, rest, CAST('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), (passes + 1)::VARCHAR)), 1, 13) AS BIGINT) AS p FROM base JOIN passes USING (key)),
through AS (SELECT *, sum(n_tokens) OVER (PARTITION BY key ORDER BY p RANGE UNBOUNDED PRECEDING) AS t FROM places),
rows AS (
  SELECT doc_id, source, n_tokens, unnest(range(1, passes + 1)) AS epoch FROM through
  UNION ALL SELECT doc_id, source, n_tokens, passes + 1 FROM through WHERE rest > 0 AND t <= rest)
SELECT doc_id, source, n_tokens, epoch::INT AS epoch, CAST('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), epoch::VARCHAR)), 1, 13) AS BIGINT) AS place FROM rows
"""
