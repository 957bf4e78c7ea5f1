"""Mixing sources to target weights by Poisson replication.

Each document's number of copies inverts a Poisson distribution at a uniform number of 53 bits hashed
from its key, capped at the source's limit. A source's mean is solved so that the copies that come
out, not only their expectation, have the wanted tokens. The tokens of each source are summed by
steps of the uniform number, which grow finer in proportion towards 0 and 1 (a bounded table), which
brackets the mean; a second sum over the documents whose copies change within the bracket finds it to
within a document. The copies are shuffled globally by a hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import checkpointed
from .p7_tokens import token_counts

#: Bits of the uniform number; steps for each halving of its distance to 0 or 1; steps within the bracket of a mean.
BITS, STEPS, FINE = 53, 32, 8192
#: Rows that the table of targets may have.
MOST_SOURCES = 10_000


def cdf(mean: float, most: int) -> list[float]:
    """P(N <= k) of a Poisson variable for k from 0 to most - 1."""
    out, p = [], math.exp(-mean)
    total = 0.0
    for k in range(most):
        total += p
        out.append(min(total, 1.0))
        p *= mean / (k + 1)
    return out


def uniform(key: str, seed: int) -> Column:
    """A number from 0 to 1 that depends on the key."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 64 - BITS).cast("double") / F.lit(float(1 << BITS))


def step(u: Column) -> Column:
    """The step of a uniform number: negative below a half, by the halvings of its distance to 0, else by those to 1."""
    low = F.floor(F.lit(-float(STEPS)) * F.log2(F.greatest(u, F.lit(2.0 ** -(BITS + 1))))).cast("int")
    high = F.floor(F.lit(-float(STEPS)) * F.log2(F.greatest(F.lit(1.0) - u, F.lit(2.0 ** -(BITS + 1))))).cast("int")
    return F.when(u < 0.5, -low).otherwise(high)


def bounds(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest uniform number of each step, a little widened for rounding."""
    d = np.abs(steps).astype(float)
    near, far = np.where(d >= BITS * STEPS, 0.0, 2.0 ** (-(d + 1) / STEPS) * (1 - 1e-12)), 2.0 ** (-d / STEPS) * (1 + 1e-12)
    low = steps < 0
    return np.where(low, near, 1 - far).clip(0, 1), np.where(low, far, 1 - near).clip(0, 1)


def copies(u: np.ndarray, mean: float, most: int) -> np.ndarray:
    """Copies at each uniform number: the Poisson quantile, at most `most`."""
    return np.searchsorted(np.array(cdf(mean, most)), u, side="left")


def bracket(steps: np.ndarray, tokens: np.ndarray, target: float, most: int) -> tuple[float, float]:
    """Two means between which the copies' tokens reach the target, whatever the numbers within the steps are."""
    least, largest = bounds(steps)

    def first(u: np.ndarray) -> tuple[float, float]:
        got = lambda m: float((copies(u, m, most) * tokens).sum())
        lo, hi = 0.0, 1e-9
        while got(hi) < target and hi < 1e4 * (most + 1):
            lo, hi = hi, hi * 2
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if got(mid) >= target else (mid, hi)
        return lo, hi

    return first(largest)[0], first(least)[1]


def plan(sizes: list[dict], targets: list[dict], total: float | None = None) -> list[dict]:
    """Cap, wanted tokens and the bracket of the mean (lo, hi) of each source that has tokens and a weight.

    Weights count relative to the sources that have rows. Without a total, it is the largest at
    which no source's cap keeps it below its share; with one, a source that can't reach its share gives all it may.
    """
    by: dict[str, list[dict]] = {}
    for r in sizes:
        by.setdefault(r["source"], []).append(r)
    have = [t for t in targets if t["source"] in by and t["weight"] and t["weight"] > 0 and (t["max_repeat"] or 0) > 0]
    weight = sum(t["weight"] for t in have)
    size = {s: sum(r["tokens"] for r in rs) for s, rs in by.items()}
    most = min((size[t["source"]] * t["max_repeat"] * weight / t["weight"] for t in have), default=0.0)
    aim = most if total is None else total
    out = []
    for t in have:
        rs = by[t["source"]]
        want = min(aim * t["weight"] / weight, size[t["source"]] * t["max_repeat"])
        lo, hi = bracket(np.array([r["step"] for r in rs]), np.array([float(r["tokens"]) for r in rs]), want, t["max_repeat"])
        out.append({"source": t["source"], "weight": t["weight"], "max_repeat": t["max_repeat"], "wanted": want, "lo": lo, "hi": hi})
    return out


def settle(row: dict, base: float, fine: list[tuple[int, float]]) -> float:
    """The mean within a source's bracket at which the tokens come nearest to the wanted ones.

    base: the tokens at the lower mean; fine: tokens that come in at each of the FINE steps up to the upper one.
    """
    best, at, total = abs(base - row["wanted"]), 0, base
    for k, tokens in sorted(fine):
        total += tokens
        if abs(total - row["wanted"]) < best:
            best, at = abs(total - row["wanted"]), k + 1
    return row["lo"] + (row["hi"] - row["lo"]) * at / FINE


def mix_sources(documents: DataFrame, targets: DataFrame, key: str = "doc_id", total: float | None = None, seed: int = 42, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection (key, source, copy_no, n_tokens), globally shuffled, and the report by source.

    targets: source, weight, max_repeat; at most MOST_SOURCES sources, of several rows of a source the largest values. Documents without
    a target source, or without tokens (null, empty), are left out. The report has, for each target:
    weight, max_repeat, n_docs, source_tokens, n_copies, n_tokens, share (of all selected tokens; 0
    where the source has no rows), mean_repeat and most_repeat.
    """
    targets = targets.where("source is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeat").alias("max_repeat"))
    asked = [r.asDict() for r in targets.limit(MOST_SOURCES + 1).collect()]
    if len(asked) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    spark = documents.sparkSession
    dim = F.broadcast(spark.createDataFrame([(t["source"],) for t in asked], "source string"))
    # the sources' texts only; tokens are counted once, the texts stay behind
    counted = checkpointed(token_counts(documents.join(dim, "source", "left_semi"), key, path=path, keep=("source",)).where("n_tokens > 0").withColumn("u", uniform(key, seed)))
    sizes = [r.asDict() for r in counted.groupBy("source", step(F.col("u")).alias("step")).agg(F.sum("n_tokens").alias("tokens")).collect()]
    rows = plan(sizes, asked, total)
    # the documents whose copies change within the bracket, by where in it
    pair = T.ArrayType(T.DoubleType())
    edges = T.StructType([T.StructField("source", T.StringType()), T.StructField("at_lo", pair), T.StructField("at_hi", pair)])
    limits = F.broadcast(spark.createDataFrame([(r["source"], cdf(r["lo"], r["max_repeat"]), cdf(r["hi"], r["max_repeat"])) for r in rows], edges))
    below = lambda c: F.size(F.filter(c, lambda x: x < F.col("u")))
    moved = counted.join(limits, "source").withColumn("n_lo", below("at_lo")).withColumn("n_hi", below("at_hi"))
    entering = F.when(F.col("n_hi") > F.col("n_lo"), F.transform(F.sequence("n_lo", F.col("n_hi") - 1), lambda k: F.least(F.lit(FINE - 1), F.floor(F.lit(float(FINE)) * (F.get("at_lo", k) - F.col("u")) / (F.get("at_lo", k) - F.get("at_hi", k))).cast("int"))))
    parts = moved.select("source", "n_tokens", F.explode(F.concat(F.array_repeat(F.lit(-1), F.col("n_lo")), F.coalesce(entering, F.array().cast("array<int>")))).alias("part"))
    fine: dict[str, dict[int, float]] = {}
    for r in parts.groupBy("source", "part").agg(F.sum("n_tokens").alias("tokens")).collect():
        fine.setdefault(r["source"], {})[r["part"]] = float(r["tokens"])
    for r in rows:
        got = fine.get(r["source"], {})
        r["cdf"] = cdf(settle(r, got.pop(-1, 0.0), list(got.items())), r["max_repeat"])
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("cdf", T.ArrayType(T.DoubleType()))])
    quantiles = F.broadcast(spark.createDataFrame([(r["source"], r["cdf"]) for r in rows], schema))
    drawn = counted.join(quantiles, "source").withColumn("n", below("cdf"))
    chosen = drawn.where("n > 0").select(key, "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "n_tokens")
    selection = chosen.orderBy(F.xxhash64(F.col(key), F.col("copy_no"), F.lit(seed + 1)), key, "copy_no")

    per = drawn.groupBy("source").agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("n_docs"), F.sum("n_tokens").alias("source_tokens"), F.sum("n").alias("n_copies"), F.sum(F.col("n") * F.col("n_tokens")).alias("n_tokens"), F.max("n").alias("most_repeat"))
    everything = per.agg(F.sum("n_tokens").alias("all_tokens"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_docs", "source_tokens", "n_copies", "n_tokens", "most_repeat")}
    report = F.broadcast(targets).join(per, "source", "left").crossJoin(everything).withColumns(zero)
    report = report.select("source", "weight", "max_repeat", "n_docs", "source_tokens", "n_copies", "n_tokens", F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"), F.when(F.col("source_tokens") > 0, F.col("n_tokens") / F.col("source_tokens")).alias("mean_repeat"), "most_repeat")
    return selection, report
