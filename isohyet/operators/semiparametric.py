"""Daily rain in three states, dry, wet and extreme, with smoothed observed amounts: weighted fits and simulation.

A day is dry up to the threshold, extreme from a weighted quantile of the month's
rain on, wet between.  Cut-offs, yearly shares, transitions and bandwidths are
windows and grouped sums in the JVM; a month's smoothed amounts are its observed
ones, so a row holds the days of one site, month and state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_cdf
from ..functions.special import ndtr, ndtri
from . import fields
from .rainfall import TINY, with_weights

STATES = (0, 1, 2)
KEYS = ["site_id", "month"]


def check(wet: float, quantile: float, basis: str, method: str, bandwidth: str, ddof: int, resampled: int, start: str, interval: str, missing: str) -> None:
    if not (0 < wet < float("inf") and 0 < quantile < 1 and resampled >= 1):
        raise ValueError("the threshold is positive, the quantile between 0 and 1, and at least one year is resampled")
    choices = {"basis": (basis, ("wet", "all")), "method": (method, ("inverted_cdf", "hazen")), "bandwidth": (bandwidth, ("effective", "resampled")), "ddof": (ddof, (0, 1)), "start": (start, ("fractions", "stationary")), "interval": (interval, ("truncate", "positive", "raw")), "missing": (missing, ("fallback", "error"))}
    for name, (value, known) in choices.items():
        if value not in known:
            raise ValueError(f"{name} is one of {known}")


def weighted_days(cube: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Days of seasons that count, with their weight and the rain of the day before where that is in the same month."""
    by = Window.partitionBy("site_id", "season_year").orderBy("day")
    rows = with_weights(cube.select("site_id", "season_year", "day", "month", "PRCP"), weights).where("w > 0")
    next_day = (F.lag("month").over(by) == F.col("month")) & (F.col("day") - F.lag("day").over(by) == 1)
    return rows.withColumn("before", F.when(next_day, F.lag("PRCP").over(by)))


def cutoffs(days: DataFrame, wet: float = 0.1, quantile: float = 0.8, basis: str = "wet", method: str = "inverted_cdf") -> DataFrame:
    """(site_id, month, cutoff): the weighted quantile of wet days' rain, or of all days'; none where no day is wet.

    ``inverted_cdf`` takes the least amount at which the cumulated weight
    reaches the share; ``hazen`` reads a line through the middles of the weights.
    """
    x = F.col("PRCP")
    part = Window.partitionBy(*KEYS)
    rows = days.where(x.isNotNull()).withColumn("wets", F.count_if(x > wet).over(part)).where("wets > 0")
    rows = rows.where(x > wet) if basis == "wet" else rows
    order = part.orderBy("PRCP", "season_year", "day")
    rows = rows.withColumns({"until": F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("w").over(part)})
    if method == "inverted_cdf":
        return rows.where(F.col("until") >= quantile * F.col("all") * (1 - 1e-12)).groupBy(*KEYS).agg(F.min("PRCP").alias("cutoff"))
    rows = rows.withColumn("at", (F.col("until") - F.col("w") / 2) / F.col("all"))
    rows = rows.withColumns({"at0": F.lag("at").over(order), "x0": F.lag("PRCP").over(order)})
    line = F.col("x0") + (x - F.col("x0")) * (quantile - F.col("at0")) / (F.col("at") - F.col("at0"))
    reached = F.when(F.col("at") >= quantile, F.coalesce(line, x))
    return rows.groupBy(*KEYS).agg(F.coalesce(F.min_by(reached, F.when(reached.isNotNull(), F.col("at"))), F.max("PRCP")).alias("cutoff"))


def state_of(x: Column, wet: float) -> Column:
    """0, 1 or 2 by the threshold and the column cutoff; null for a missing day."""
    return F.when(x <= wet, 0).when(x < F.coalesce("cutoff", F.lit(float("inf"))), 1).when(x.isNotNull(), 2)


def with_states(days: DataFrame, cuts: DataFrame, wet: float) -> DataFrame:
    rows = days.join(cuts, KEYS, "left")
    return rows.withColumns({"state": state_of(F.col("PRCP"), wet), "was": state_of(F.col("before"), wet)})


def fit_states(rows: DataFrame, start: str = "fractions", missing: str = "fallback") -> DataFrame:
    """(site_id, month, cutoff, pi0 to pi2, t00 to t22, n0 to n2, missing0 to missing2, s0 to s2).

    A year's shares of states and its transitions from a state are averaged by
    the years' weights, transitions over the years in which the state has a
    next day.  A state without any takes the shares (``missing`` says so), or
    raises.  s is the chain's own distribution, from the cofactors of 1 - T; the
    shares where it isn't unique.  Without a weighted day a month has no row.
    """
    pairs = {f"n{i}{j}": F.count_if((F.col("was") == i) & (F.col("state") == j)) for i in STATES for j in STATES}
    yearly = rows.where("state IS NOT NULL").groupBy(*KEYS, "season_year").agg(
        F.max("w").alias("w"), F.max("cutoff").alias("cutoff"), F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("state") == i).alias(f"in{i}") for i in STATES], *[v.alias(k) for k, v in pairs.items()],
    )
    yearly = yearly.withColumns({f"from{i}": F.col(f"n{i}0") + F.col(f"n{i}1") + F.col(f"n{i}2") for i in STATES})
    of = lambda top, base: F.sum(F.col("w") * F.try_divide(F.col(top), F.col(base))) / F.sum(F.when(F.col(base) > 0, F.col("w")))
    out = yearly.groupBy(*KEYS).agg(
        F.max("cutoff").alias("cutoff"), *[of(f"in{i}", "n").alias(f"pi{i}") for i in STATES],
        *[of(f"n{i}{j}", f"from{i}").alias(f"raw{i}{j}") for i in STATES for j in STATES], *[F.sum(f"from{i}").alias(f"n{i}") for i in STATES],
    )
    unknown = {f"missing{i}": F.col(f"n{i}") == 0 for i in STATES}
    out = out.withColumns(unknown)
    if missing == "error":
        bad = F.raise_error(F.concat(F.lit("no transition from a state at site "), F.col("site_id").cast("string"), F.lit(", month "), F.col("month").cast("string"))).cast("double")
        out = out.withColumns({f"raw{i}{j}": F.when(F.col(f"missing{i}"), bad).otherwise(F.col(f"raw{i}{j}")) for i in STATES for j in STATES})
    out = out.withColumns({f"t{i}{j}": F.coalesce(F.col(f"raw{i}{j}"), F.col(f"pi{j}")) for i in STATES for j in STATES})
    minor = {}
    for i in STATES:
        a, b = (s for s in STATES if s != i)
        minor[i] = (1 - F.col(f"t{a}{a}")) * (1 - F.col(f"t{b}{b}")) - F.col(f"t{a}{b}") * F.col(f"t{b}{a}")
    out = out.withColumns({f"m{i}": F.greatest(F.lit(0.0), minor[i]) for i in STATES})
    mass = F.col("m0") + F.col("m1") + F.col("m2")
    out = out.withColumns({f"s{i}": F.when(mass > 1e-12, F.col(f"m{i}") / mass).otherwise(F.col(f"pi{i}")) for i in STATES})
    if start == "stationary":
        out = out.withColumns({f"pi{i}": F.col(f"s{i}") for i in STATES})
    return out.select(*KEYS, "cutoff", *[f"pi{i}" for i in STATES], *[f"t{i}{j}" for i in STATES for j in STATES], *[f"n{i}" for i in STATES], *[f"missing{i}" for i in STATES], *[f"s{i}" for i in STATES])


def fit_kernels(rows: DataFrame, wet: float = 0.1, bandwidth: str = "effective", ddof: int = 0, resampled: int = 1000, interval: str = "truncate") -> DataFrame:
    """(site_id, month, state, centres, shares, n_eff, sd, bandwidth, low, high, mismatch) of the wet and extreme days.

    The bandwidth is 1.06 sd n^(-1/5), n the effective number of days or
    the number expected in ``resampled`` years; without spread it is 0 and the
    amounts stay what they are.  ``mismatch`` is the share of the unbounded
    density that lies outside the state.  A low bound at the threshold is open.
    """
    part = Window.partitionBy(*KEYS, "state")
    days = rows.where("state > 0").select(*KEYS, "season_year", "day", "state", "cutoff", "w", F.col("PRCP").alias("x"))
    days = days.withColumn("share", F.col("w") / F.sum("w").over(part))
    days = days.withColumn("mean", F.sum(F.col("share") * F.col("x")).over(part))
    square = F.sum(F.col("share") * F.col("share"))
    spread = F.sum(F.col("share") * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean")))
    packed = F.sort_array(F.collect_list(F.struct("x", "season_year", "day", "share")))  # days of one site, month and state
    out = days.groupBy(*KEYS, "state").agg(packed.alias("all"), (1 / square).alias("n_eff"), square.alias("square"), spread.alias("variance"), F.max("cutoff").alias("cutoff"))
    if ddof == 1:
        out = out.withColumn("variance", F.when(F.col("n_eff") > 1 + 1e-12, F.col("variance") / (1 - F.col("square"))).otherwise(F.col("variance")))
    n = F.col("n_eff")
    if bandwidth == "resampled":
        yearly = rows.where("state IS NOT NULL").groupBy(*KEYS, "season_year").agg(F.max("w").alias("w"), *[F.count_if(F.col("state") == i).alias(f"in{i}") for i in STATES[1:]])
        mean = yearly.groupBy(*KEYS).agg(*[(F.sum(F.col("w") * F.col(f"in{i}")) / F.sum("w")).alias(f"mean{i}") for i in STATES[1:]])
        out = out.join(mean, KEYS)
        n = float(resampled) * F.when(F.col("state") == 1, F.col("mean1")).otherwise(F.col("mean2"))
    out = out.withColumn("sd", F.sqrt("variance"))
    out = out.withColumn("bandwidth", F.when(F.col("sd") > 1e-10, 1.06 * F.col("sd") * F.pow(n, F.lit(-0.2))).otherwise(0.0))
    first, last = F.when(F.col("state") == 1, F.lit(float(wet))).otherwise(F.col("cutoff")), F.when(F.col("state") == 1, F.col("cutoff")).otherwise(F.lit(float("inf")))
    out = out.withColumns({"own_low": F.greatest(first, F.lit(float(wet))), "own_high": last})
    h, low, high = F.col("bandwidth"), F.col("own_low"), F.col("own_high")

    def inside(c: Column) -> Column:
        x = c["x"]
        above = F.when(F.col("state") == 1, normal_cdf((high - x) / F.when(h > 0, h).otherwise(1.0))).otherwise(1.0)
        smooth = above - normal_cdf((low - x) / F.when(h > 0, h).otherwise(1.0))
        return c["share"] * F.when(h > 0, smooth).otherwise(F.when((x >= low) & (x < high), 1.0).otherwise(0.0))

    out = out.withColumn("mismatch", 1 - F.aggregate("all", F.lit(0.0), lambda a, c: a + inside(c)))
    bounds = {"truncate": (low, high), "positive": (F.lit(0.0), F.lit(float("inf"))), "raw": (F.lit(float("-inf")), F.lit(float("inf")))}[interval]
    return out.select(*KEYS, "state", F.transform("all", lambda c: c["x"]).alias("centres"), F.transform("all", lambda c: c["share"]).alias("shares"), "n_eff", "sd", "bandwidth", bounds[0].alias("low"), bounds[1].alias("high"), "mismatch")


def fit_three_states(cube: DataFrame, weights: DataFrame | None = None, *, wet: float = 0.1, quantile: float = 0.8, basis: str = "wet", method: str = "inverted_cdf", bandwidth: str = "effective", ddof: int = 0, resampled: int = 1000, start: str = "fractions", interval: str = "truncate", missing: str = "fallback") -> DataFrame:
    """One row a site and month with all that ``simulate_three_states`` takes (the kernels as an array of structs).

    cube: (site_id, season_year, day, month, PRCP); negative rain raises.  A
    site of which a month has no weighted day has no rows.
    """
    check(wet, quantile, basis, method, bandwidth, ddof, resampled, start, interval, missing)
    x = F.col("PRCP")
    cube = cube.withColumn("PRCP", F.when(x >= 0, x).when(x < 0, F.raise_error(F.lit("negative rain")).cast("double")))
    days = weighted_days(cube, weights)
    rows = with_states(days, cutoffs(days, wet, quantile, basis, method), wet)
    kernels = fit_kernels(rows, wet, bandwidth, ddof, resampled, interval)
    kernels = kernels.groupBy(*KEYS).agg(F.collect_list(F.struct("state", "centres", "shares", "bandwidth", "low", "high", "mismatch")).alias("kernels"))
    out = fit_states(rows, start, missing).join(kernels, KEYS, "left")
    whole = cube.select("month").distinct().agg(F.count(F.lit(1)).alias("months"))
    out = out.crossJoin(F.broadcast(whole))  # one row
    return out.withColumn("has", F.count(F.lit(1)).over(Window.partitionBy("site_id"))).where("has = months").drop("has", "months")


def prepared(kernel: dict, wet: float) -> dict:
    """A kernel's cumulated masses inside its state, and the places of each amount's bounds."""
    centres, shares, h = np.asarray(kernel["centres"], float), np.asarray(kernel["shares"], float), kernel["bandwidth"]
    low, high = kernel["low"], kernel["high"]
    low = np.nextafter(wet, np.inf) if low == wet else low
    if h == 0:
        below, above, mass = np.zeros_like(centres), np.ones_like(centres), shares
    else:
        below, above = ndtr((low - centres) / h), ndtr((high - centres) / h)
        mass = shares * np.maximum(above - below, 0)
        if mass.sum() <= 0:  # rounding left no mass in a narrow interval: the heaviest day stands for it
            mass = (np.arange(len(centres)) == np.argmax(shares)).astype(float)
    steps = np.cumsum(mass) / mass.sum()
    steps[-1] = 1.0
    return {"centres": centres, "h": h, "low": low, "high": np.nextafter(high, -np.inf) if np.isfinite(high) else np.inf, "below": below, "above": above, "steps": steps}


def kernel_at(k: dict, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Amounts at the uniforms u, which choose an observed amount, and v, which move it within the state."""
    i = np.minimum(np.searchsorted(k["steps"], u, side="right"), len(k["centres"]) - 1)
    if k["h"] == 0:
        return k["centres"][i]
    below, above = k["below"][i], k["above"][i]
    return np.clip(k["centres"][i] + k["h"] * ndtri(np.clip(below + v * (above - below), TINY, 1 - TINY)), k["low"], k["high"])


def three_state_chain(months: list[int], by_month: dict[int, dict], u: np.ndarray, component: np.ndarray, amount: np.ndarray, *, wet: float = 0.1, reset: bool = True, by_amount: bool = False) -> np.ndarray:
    """(member, day) of one site's rain from uniforms of the same shape."""
    out, before = np.zeros(u.shape), np.zeros(len(u), int)
    ready = {month: {int(k["state"]): prepared(k, wet) for k in (m["kernels"] if m["kernels"] is not None else [])} for month, m in by_month.items()}
    for d, month in enumerate(months):
        m, kernels = by_month[month], ready[month]
        if d == 0 or (reset and month != months[d - 1]):
            steps = np.tile(np.cumsum([m[f"pi{i}"] for i in STATES]), (len(u), 1))
        else:
            steps = np.cumsum([[m[f"t{i}{j}"] for j in STATES] for i in STATES], axis=1)[before]
        now = np.minimum((u[:, d, None] > steps).sum(axis=1), 2)
        # A sum a rounding short of 1 must not open a state that was never seen.
        now = np.where(np.isin(now, [0, *kernels]), now, max([0, *kernels]))
        for state in (1, 2):
            if (of := now == state).any():
                out[of, d] = kernel_at(kernels[state], component[of, d], amount[of, d])
        before = now
        if by_amount:
            cutoff = np.inf if m["cutoff"] is None or pd.isna(m["cutoff"]) else m["cutoff"]
            before = np.where(out[:, d] <= wet, 0, np.where(out[:, d] < cutoff, 1, 2))
    return out


def simulate_three_states(params: DataFrame, sites: DataFrame, months: list[int], members: int, *, seed: int = 42, member_start: int = 0, field: fields.Field | dict | None = None, classes: DataFrame | None = None, **options) -> DataFrame:
    """(site_id, member, day, PRCP): as ``rainfall.simulate``, of three states; ``classes`` picks a member's parameters
    among those of ``params`` (with a column class), and where a class lacks a month its members have no rain."""
    if members < 1 or member_start < 0:
        raise ValueError("members is at least 1, member_start not negative")
    months = [int(m) for m in months]
    need = sorted(set(months))
    of = field if isinstance(field, dict) else dict.fromkeys(("occurrence", "component", "amount"), field)
    keys = ["month", "cutoff", "kernels", *[f"pi{i}" for i in STATES], *[f"t{i}{j}" for i in STATES for j in STATES]]
    own = F.col("class") if "class" in params.columns else F.lit(0)
    gathered = params.where(F.col("month").isin(need)).groupBy("site_id").agg(F.collect_list(F.struct(*keys, own.alias("class"))).alias("params"))  # a site's months
    rows = gathered.join(sites.select("site_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")), "site_id")
    with_classes = classes is not None
    if with_classes:
        rows = rows.join(classes.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("member", "class"))).alias("classes")), "site_id")

    def run(batches):
        for batch in batches:
            for r in batch.to_dict("records"):
                site = (int(r["site_id"]), r["y"], r["x"])
                u, component, amount = (np.clip(ndtr(fields.draws(of.get(k), site, members, len(months), seed, k, member_start)), TINY, 1 - TINY) for k in ("occurrence", "component", "amount"))
                chosen = np.array([c["class"] for c in r["classes"]]) if with_classes else np.zeros(members, int)
                out = np.full((members, len(months)), np.nan)
                for k in np.unique(chosen):
                    by_month = {int(p["month"]): p for p in r["params"] if int(p["class"]) == k}
                    if not set(need) - set(by_month):
                        mine = chosen == k
                        out[mine] = three_state_chain(months, by_month, u[mine], component[mine], amount[mine], **options)
                values = pd.Series(out.ravel()).astype(object).where(~np.isnan(out.ravel()), None)
                yield pd.DataFrame({"site_id": site[0], "member": np.repeat(np.arange(member_start, member_start + members), len(months)), "day": np.tile(np.arange(len(months)), members), "PRCP": values})

    return rows.mapInPandas(run, "site_id bigint, member int, day int, PRCP double")
