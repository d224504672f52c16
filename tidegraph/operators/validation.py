"""Statistics on predictions and result tables: AUC, paired bootstrap, filters, attribution."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.graphs import spread


def auc(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve: ties share their mean rank (Mann-Whitney).

    Rows are first counted per distinct score, so the ordered window runs over
    score values and not over rows.
    """
    by = by or []
    counts = rows.na.drop(subset=[label, score]).groupBy(*by, score).agg(F.sum((F.col(label) > 0).cast("bigint")).alias("p"), F.sum((F.col(label) <= 0).cast("bigint")).alias("q"))
    before = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("below", F.coalesce(F.sum("q").over(before), F.lit(0)))
    wins = F.sum(F.col("p") * (F.col("below") + F.col("q") / 2))
    pairs = F.sum("p") * F.sum("q")
    return ranked.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("auc"), F.sum("p").alias("n_positive"), F.sum("q").alias("n_negative"))


def auc_of(y: np.ndarray, score: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    s = score[order]
    first = np.r_[True, s[1:] != s[:-1]]
    group = np.cumsum(first) - 1
    size = np.bincount(group)
    rank = (np.cumsum(size) - (size - 1) / 2)[group]
    positive = y[order] > 0
    p, q = positive.sum(), (~positive).sum()
    if not p or not q:
        raise ValueError("both labels are needed")
    return float((rank[positive].sum() - p * (p + 1) / 2) / (p * q))


def words(seed: int, first: int, count: int, piece: int = 1 << 17):
    """``count`` 32-bit words of the default generator's stream from word ``first`` on, in pieces."""
    bits = np.random.default_rng(seed).bit_generator
    bits.advance(first // 2)
    skip = first % 2
    while count > 0:
        found = bits.random_raw(min(piece, (count + skip + 1) // 2)).astype("<u8", copy=False).view("<u4")[skip:][:count]
        count, skip = count - len(found), 0
        yield found


def drawn(found: np.ndarray, n: int) -> np.ndarray:
    """What ``integers(0, n)`` of the default generator makes of words, n up to 2^32: the high half of word times n, unless the low half is below 2^32 mod n."""
    product = (found * np.uint64(n)).view("<u4").reshape(-1, 2)
    return product[:, 1] if (least := 2**32 % n) == 0 else product[product[:, 0] >= least, 1]


def draws(seed: int, n: int, first: int = 0, late: int = 0):
    """Endless pieces of what ``integers(0, n)`` draws, from word ``first`` of the stream on and without the first ``late`` of them."""
    if n > 2**32:
        rng = np.random.default_rng(seed)
        pieces = (rng.integers(0, n, 1 << 17) for _ in itertools.count())
    else:
        pieces = (drawn(found, n) for found in words(seed, first, 2**127))
    for piece in pieces:
        yield piece[late:]
        late = max(0, late - len(piece))


def resamples(seed: int, n: int, first: int = 0, late: int = 0):
    """Endless lists of pieces, n draws in each list, as ``integers(0, n, n)`` gives them one call after another."""
    stream, rest = draws(seed, n, first, late), np.zeros(0, np.uint32)
    while True:
        pieces, missing = [], n
        while missing:
            piece = rest if len(rest) else next(stream)
            pieces.append(piece[:missing])
            rest, missing = piece[missing:], missing - len(pieces[-1])
        yield pieces


def counted(pieces: list[np.ndarray], ends: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """How many draws fall below each end, and not below the one before; as many draws are sorted at once as ``most``, or one piece."""
    below = np.zeros(len(ends), np.int64)
    held, size = [], 0
    for k, piece in enumerate(pieces):
        held, size = [*held, piece], size + len(piece)
        if size >= most or k + 1 == len(pieces):
            below += np.searchsorted(np.sort(np.concatenate(held)), ends)
            held, size = [], 0
    return np.diff(below, prepend=0)


class Auc:
    """``auc_of`` for rows that occur many times: classes are sorted by score once, their counts vary."""

    def __init__(self, y: np.ndarray, score: np.ndarray):
        self.order = np.argsort(score, kind="stable")
        s = score[self.order]
        self.first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        self.positive = y[self.order] > 0

    def __call__(self, times: np.ndarray) -> float:
        times = times[self.order]
        every = np.add.reduceat(times, self.first)
        won = np.add.reduceat(np.where(self.positive, times, 0), self.first)
        lost = every - won
        p, q = won.sum(), lost.sum()
        if not p or not q:
            raise ValueError("both labels are needed")
        return float((won * (2 * (np.cumsum(lost) - lost) + lost)).sum() / 2 / (p * q))


def paired_bootstrap(rows: DataFrame, label: str, a: str, b: str, metric: Callable[[np.ndarray, np.ndarray], float] = auc_of, n_boot: int = 1000, seed: int = 42, by: list[str] | None = None, work: int = 1 << 27) -> DataFrame:
    """Difference metric(b) - metric(a), its 95 % interval over joint resamples, and a two-sided p-value; resamples on which the metric fails are left out.

    Equal rows travel as one with their number. The resamples of a group are dealt
    over tasks of about ``work`` draws each. They are those of one generator, call
    after call, however they are dealt: a slice starts at a word of the stream, and
    the draws that the slices before it lost to rejected words are counted first.
    The AUC of a resample comes from the counts of its classes; another metric gets
    all its rows.
    """
    by = by or []
    source = rows.na.drop(subset=[label, a, b]).select(*by, label, a, b)
    alone = not by
    if alone:
        source, by = source.withColumn("_all", F.lit(1)), ["_all"]
    keys = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in by)
    classes = source.groupBy(*by, label, a, b).agg(F.count("*").alias("_times"))

    tasks = F.when(F.col("_n") <= 2**32, F.ceil(F.col("_n") * float(n_boot) / work)).otherwise(1)
    totals = classes.groupBy(*by).agg(F.sum("_times").alias("_n")).withColumn("_each", F.greatest(F.lit(1), F.ceil(n_boot / tasks)).cast("bigint"))
    last = F.greatest(F.lit(0), F.ceil(n_boot / F.col("_each")) - 1).cast("int")
    slices = totals.withColumn("_slice", F.explode(F.sequence(F.lit(0), last)))

    @F.pandas_udf("bigint")
    def rejected(n: pd.Series, each: pd.Series, k: pd.Series) -> pd.Series:
        lost = lambda n, size, k: size - sum(len(drawn(found, n)) for found in words(seed, k * size, size))
        return pd.Series([lost(i, i * e, j) if (j + 1) * e < n_boot else 0 for i, e, j in zip(n.tolist(), each.tolist(), k.tolist())], dtype="int64")

    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = spread(slices, [*by, "_slice"]).withColumn("_lost", rejected("_n", "_each", "_slice")).withColumn("_late", F.coalesce(F.sum("_lost").over(before), F.lit(0)))
    slices = slices.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(by)), "_each", "_slice", "_late")
    if alone:
        slices = F.broadcast(slices)  # n_boot rows at most
    dealt = classes.join(slices, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(by)]).select(*by, label, a, b, "_times", "_each", "_slice", "_late")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([a, b, label], kind="stable")
        y, x1, x2 = (frame[c].to_numpy(float) for c in (label, a, b))
        times = frame["_times"].to_numpy(np.int64)
        each, k, late = (int(frame[c].iloc[0]) for c in ("_each", "_slice", "_late"))
        ends, n = np.cumsum(times), int(times.sum())
        if metric is auc_of:
            one, two = Auc(y, x1), Auc(y, x2)
            ends = ends.astype(np.uint32 if n < 2**32 else np.int64)  # as the draws are: no search converts them
            difference = lambda times: two(times) - one(times)
            again = lambda pieces: difference(counted(pieces, ends))
        else:
            row = np.repeat(np.arange(len(y)), times)
            difference = lambda times: metric(y[row], x2[row]) - metric(y[row], x1[row])

            def again(pieces):
                i = row[np.concatenate(pieces)]
                return metric(y[i], x2[i]) - metric(y[i], x1[i])

        out = []
        if k == 0:
            try:
                out.append((True, difference(times)))
            except ValueError:
                out.append((True, float("nan")))
        for _, pieces in zip(range(min(each, n_boot - k * each)), resamples(seed, n, k * each * n, late)):
            try:
                out.append((False, again(pieces)))
            except ValueError:
                continue
        return pd.DataFrame({**{c: [frame[c].iloc[0]] * len(out) for c in by}, "_whole": [w for w, _ in out], "_d": [float(d) for _, d in out]})

    def summary(frame: pd.DataFrame) -> pd.DataFrame:
        whole = frame["_whole"].to_numpy(bool)
        d = frame["_d"].to_numpy(float)[~whole]
        p = min(1.0, 2 * min((d <= 0).mean(), (d >= 0).mean())) if len(d) else float("nan")
        low, high = np.percentile(d, [2.5, 97.5]) if len(d) else (float("nan"), float("nan"))
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in by}, "observed_diff": float(frame["_d"][whole].iloc[0]), "ci_low": low, "ci_high": high, "p_value": p, "n_valid": len(d)}])

    differences = spread(dealt, [*by, "_slice"]).groupBy(*by, "_slice").applyInPandas(run, f"{keys}, _whole boolean, _d double")
    got = differences.groupBy(*by).applyInPandas(summary, f"{keys}, observed_diff double, ci_low double, ci_high double, p_value double, n_valid int")
    return got.drop("_all") if alone else got


def significant(results: DataFrame, p: str = "p_value_fdr", level: float = 0.05, improved: str = "observed_diff") -> DataFrame:
    return results.where((F.col(p) < level) & (F.col(improved) > 0))


def benjamini_hochberg(results: DataFrame, p: str = "p_value", by: list[str] | None = None) -> DataFrame:
    """Adjusted p-values: running minimum of p * n / rank from the largest down."""
    by = by or []
    rank = Window.partitionBy(*by).orderBy(p)
    every = Window.partitionBy(*by)
    above = Window.partitionBy(*by).orderBy(p).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    adjusted = F.col(p) * F.count(p).over(every) / F.max("_r").over(Window.partitionBy(*by, p))
    return results.withColumn("_r", F.row_number().over(rank)).withColumn("_q", adjusted).withColumn("p_value_fdr", F.least(F.lit(1.0), F.min("_q").over(above))).drop("_r", "_q")


def placebo_residual(results: DataFrame, by: list[str], a: str, b: str, placebo: str) -> DataFrame:
    """100 (mean placebo - a) / (b - a), and how many placebos beat b."""
    gain = F.first(b) - F.first(a)
    return results.groupBy(*by).agg(F.when(gain != 0, 100 * (F.avg(placebo) - F.first(a)) / gain).alias("residual_percent"), F.count_if(F.col(placebo) >= F.col(b)).alias("n_beating"))


def best_by(results: DataFrame, criterion: str, choice: str, by: list[str] | None = None) -> DataFrame:
    """The choice with the smallest criterion, ties to the smaller choice."""
    return results.groupBy(*(by or [])).agg(F.min_by(choice, F.struct(criterion, choice)).alias(choice), F.min(criterion).alias(criterion))


def attributed(anomalies: DataFrame, events: DataFrame, windows: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Anomaly dates beside the events whose lag falls in a named window.

    An anomaly is sent to each day of its reach, which makes the interval join an
    equi join.
    """
    windows = windows or {"direct": (0, 3), "indirect": (4, 7), "precursor": (-7, -1)}
    low, high = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    lag = F.datediff("anomaly_date", "event_date")
    kind = F.coalesce(*(F.when(lag.between(a, b), F.lit(name)) for name, (a, b) in windows.items()))
    reach = anomalies.withColumn("event_date", F.explode(F.expr(f"sequence(date_add(anomaly_date, {-high}), date_add(anomaly_date, {-low}))")))
    return reach.join(events, "event_date").withColumn("lag_days", lag).withColumn("relation", kind).where("relation IS NOT NULL")


def lagged_agreement(labels: DataFrame, a: str, b: str, lags: range, order: str = "date", by: str = "series_id") -> DataFrame:
    """Share of days on which ``a`` equals ``b`` so many days later."""
    w = Window.partitionBy(by).orderBy(order)
    wide = labels.select(by, a, *(F.lead(b, k).over(w).alias(f"_{k}") for k in lags))
    long = wide.select(by, a, F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("later")) for k in lags))).alias("p")).select(by, a, "p.*").where("later IS NOT NULL")
    return long.groupBy(by, "lag").agg(F.avg((F.col(a) == F.col("later")).cast("double")).alias("agreement"), F.count("*").alias("n"))


def in_every_arm(rows: DataFrame, keys: list[str], arm: str) -> DataFrame:
    """Rows whose key occurs under every value of ``arm`` that the table has."""
    arms = rows.agg(F.count_distinct(arm).alias("arms"))  # one row
    common = rows.groupBy(*keys).agg(F.count_distinct(arm).alias("n_arms")).join(F.broadcast(arms), F.col("n_arms") == F.col("arms")).select(*keys)
    return rows.join(common, keys, "left_semi")
