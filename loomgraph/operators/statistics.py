"""Agreement, tests and gates. Tables are reduced in Spark; what reaches the driver is one row a query or less."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def paired_bootstrap(diffs: list[float], n: int = 10_000, seed: int = 20260726) -> dict:
    """Mean, 95 % interval, two-sided p and wins, losses, ties of paired differences."""
    d = np.asarray(diffs, dtype=float)
    if not len(d):
        return {"mean": None, "low": None, "high": None, "p": None, "win": 0, "loss": 0, "tie": 0}
    rng = np.random.default_rng(seed)
    means = np.concatenate([d[rng.integers(0, len(d), (min(500, n - i), len(d)))].mean(1) for i in range(0, n, 500)])
    low, high = np.percentile(means, [2.5, 97.5])
    p = min(1.0, 2 * min(float((means <= 0).mean()), float((means >= 0).mean())))
    return {"mean": float(d.mean()), "low": float(low), "high": float(high), "p": p, "win": int((d > 0).sum()), "loss": int((d < 0).sum()), "tie": int((d == 0).sum())}


def ratio_bootstrap(num: list[float], den: list[float], n: int = 10_000, seed: int = 20260726) -> dict:
    """Ratio of sums with its interval; rows with a zero denominator are dropped and counted."""
    pairs = [(a, b) for a, b in zip(num, den, strict=True) if b]
    out = {"dropped": len(num) - len(pairs), "ratio": None, "low": None, "high": None}
    if pairs:
        a, b = np.array(pairs, dtype=float).T
        i = np.random.default_rng(seed).integers(0, len(a), (n, len(a)))
        r = a[i].sum(1) / b[i].sum(1)
        out |= {"ratio": float(a.sum() / b.sum()), "low": float(np.percentile(r, 2.5)), "high": float(np.percentile(r, 97.5))}
    return out


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided below 25 discordant pairs, else chi-squared with continuity correction."""
    n = b + c
    if n == 0:
        return 1.0
    if n < 25:
        return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)
    return math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / n / 2))


def mcnemar_one_sided(b: int, c: int) -> float:
    """P(at least b of b + c), exact."""
    return sum(math.comb(b + c, k) for k in range(b, b + c + 1)) / 2 ** (b + c)


def holm(pvalues: dict[str, float], alpha: float = 0.05) -> dict[str, bool]:
    """Step-down rejections: all stop at the first that fails."""
    out, open_ = {}, True
    for i, (k, p) in enumerate(sorted(pvalues.items(), key=lambda x: (x[1], x[0]))):
        open_ = open_ and p <= alpha / (len(pvalues) - i)
        out[k] = open_
    return out


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(df: DataFrame, a: str, b: str, quadratic: bool = False) -> DataFrame:
    """One row: n, observed, expected, kappa (null where the expected agreement is 1). Labels are numbers if quadratic."""
    c = confusion(df, a, b)
    everything = W.partitionBy()  # over the cells of one contingency table
    t = c.withColumn("total", F.sum("n").over(everything)).withColumn("nx", F.sum("n").over(W.partitionBy("x"))).withColumn("ny", F.sum("n").over(W.partitionBy("y")))
    if not quadratic:
        obs = t.agg(F.max("total").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
        px, py = c.groupBy("x").agg(F.sum("n").alias("cx")), c.groupBy(F.col("y").alias("x")).agg(F.sum("n").alias("cy"))
        exp = px.join(py, "x").agg(F.coalesce(F.sum(F.col("cx") * F.col("cy")), F.lit(0)).alias("e"))
        k = obs.crossJoin(exp).select("n", (F.col("same") / F.col("n")).alias("observed"), (F.col("e") / (F.col("n").cast("double") * F.col("n"))).alias("expected"))
        return k.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))
    px, py = c.groupBy("x").agg(F.sum("n").alias("cx")), c.groupBy("y").agg(F.sum("n").alias("cy"))
    w = lambda: F.pow(F.col("x").cast("double") - F.col("y").cast("double"), 2)
    obs = c.agg(F.sum("n").alias("n"), F.sum(w() * F.col("n")).alias("o"))
    exp = px.crossJoin(py).agg(F.sum(w() * F.col("cx") * F.col("cy")).alias("e"))  # labels x labels
    k = obs.crossJoin(exp).select("n", (F.col("o") / F.col("n")).alias("observed"), (F.col("e") / (F.col("n").cast("double") * F.col("n"))).alias("expected"))
    return k.withColumn("kappa", F.when(F.col("expected") > 0, 1 - F.col("observed") / F.col("expected")))


def fleiss_kappa(long: DataFrame) -> DataFrame:
    """One row from (item, label, n) counts; kappa is null unless every item has the same number of ratings."""
    per = long.groupBy("item").agg(F.sum("n").alias("r"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree"))
    whole = per.agg(F.count(F.lit(1)).alias("items"), F.min("r").alias("r"), F.max("r").alias("rmax"), F.avg(F.when(F.col("r") > 1, F.col("agree") / (F.col("r") * (F.col("r") - 1)))).alias("p_bar"))
    share = long.groupBy("label").agg(F.sum("n").alias("c"))
    total = share.agg(F.sum("c").alias("t"))
    pe = share.crossJoin(F.broadcast(total)).agg(F.sum(F.pow(F.col("c") / F.col("t"), 2)).alias("p_e"))
    return whole.crossJoin(pe).select("items", "p_bar", "p_e", F.when((F.col("r") == F.col("rmax")) & (F.col("p_e") < 1), (F.col("p_bar") - F.col("p_e")) / (1 - F.col("p_e"))).alias("kappa"))


def krippendorff_interval(long: DataFrame) -> DataFrame:
    """Alpha with squared differences from (item, value); items with one value do not pair."""
    u = long.groupBy("item").agg(F.count("value").alias("m"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).where("m >= 2")
    # Sum over pairs of (a - b)^2 = 2 m q - 2 s^2, so no pairs are made.
    agg = u.agg(F.sum("m").alias("n"), F.sum((2 * F.col("m") * F.col("q") - 2 * F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("d"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    do = F.col("d") / F.col("n")
    de = (2 * F.col("n") * F.col("q") - 2 * F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return agg.select("n", do.alias("observed"), de.alias("expected"), F.when(de > 0, 1 - do / de).alias("alpha"))


def icc(long: DataFrame) -> DataFrame:
    """ICC(2,1) and ICC(2,k) of a complete (item, rater, value) table by two-way mean squares."""
    g = long.agg(F.avg("value").alias("gm"), F.countDistinct("item").alias("n"), F.countDistinct("rater").alias("k"), F.sum(F.col("value") * F.col("value")).alias("q"))
    rows = long.groupBy("item").agg(F.avg("value").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("rq"))
    cols = long.groupBy("rater").agg(F.avg("value").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("cq"))
    n, k, gm = F.col("n"), F.col("k"), F.col("gm")
    ssr, ssc, sst = k * (F.col("rq") - n * gm * gm), n * (F.col("cq") - k * gm * gm), F.col("q") - n * k * gm * gm
    t = g.crossJoin(rows).crossJoin(cols).select("n", "k", (ssr / (n - 1)).alias("msr"), (ssc / (k - 1)).alias("msc"), ((sst - ssr - ssc) / ((n - 1) * (k - 1))).alias("mse"))
    msr, msc, mse = F.col("msr"), F.col("msc"), F.col("mse")
    return t.select("n", "k", F.try_divide(msr - mse, msr + (k - 1) * mse + k * (msc - mse) / n).alias("icc_single"), F.try_divide(msr - mse, msr + (msc - mse) / n).alias("icc_mean"))


def exclusive_quartiles(values: list[float]) -> list[float]:
    """Quartiles at (n + 1) p with linear interpolation, clamped to the ends."""
    x, n = sorted(values), len(values)
    if n < 2:
        raise ValueError("two values are needed")
    out = []
    for i in (1, 2, 3):
        j, r = divmod(i * (n + 1), 4)
        j = min(max(j, 1), n - 1)
        out.append((x[j - 1] * (4 - (i * (n + 1) - j * 4)) + x[j] * (i * (n + 1) - j * 4)) / 4)
    return out


def non_inferior(low: float, margin: float = 0.02) -> bool:
    """The lower bound lies strictly above -margin."""
    return low > -margin


def subgroup_drop(df: DataFrame, label: str, base: str, new: str, least: int = 20) -> DataFrame:
    """Mean of both systems per subgroup, the drop, and whether the group is large enough to count."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(base).alias("base"), F.avg(new).alias("new")).withColumn("drop", F.col("base") - F.col("new")).withColumn("reliable", F.col("n") >= least)


def monotone_verdict(base: Column, now: Column, kind: Column, tau: float = 0.05) -> Column:
    """Regression of a row count against its base: up must not fall, down not rise, flat not move by more than tau; base 0 never regresses."""
    change = (now - base) / base
    bad = F.when(kind == "up", change < -tau).when(kind == "down", change > tau).otherwise(F.abs(change) > tau)
    return F.when(base == 0, "pass").when(bad, "regressed").otherwise("pass")
