"""Files of observations, forecasts and ensembles: one variable a file, as tables or classic NetCDF."""

from __future__ import annotations

import datetime
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import to_canonical
from . import netcdf
from .panel import CATEGORY_NAMES, VARIABLES, canonicalize, prepare_probabilities, relabel

#: Names that files use for the axes.
AXES = {"t": ("t", "time"), "y": ("y", "lat", "latitude"), "x": ("x", "lon", "longitude")}
EPOCH = datetime.date(1970, 1, 1)


def rename_axes(df: DataFrame) -> DataFrame:
    """Axis columns under their short names, whatever the file calls them; two for one axis raise."""
    found = {}
    for short, names in AXES.items():
        hits = [k for k in df.columns if k.lower() in names]
        if len(hits) > 1:
            raise ValueError(f"more than one column for {short}: {hits}")
        if hits:
            found[hits[0]] = short
    return df.withColumnsRenamed(found)


def days_since(unit: str, values: np.ndarray) -> np.ndarray:
    """Dates of a time axis in days or hours since a date of the Gregorian calendar."""
    word, _, start = unit.partition(" since ")
    step = {"days": 1.0, "day": 1.0, "hours": 1 / 24, "hour": 1 / 24, "seconds": 1 / 86400}.get(word.strip().lower())
    if step is None:
        raise ValueError(f"time unit {unit!r} is not days, hours or seconds since a date")
    return (np.datetime64(start.strip()[:10], "D") + np.floor(np.asarray(values, float) * step + 1e-9).astype("timedelta64[D]")).astype("datetime64[D]")


def read_netcdf(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(t, y, x, value, unit, and member where there is one) of a variable in classic NetCDF files; each file is one task."""

    def rows(batches):
        for batch in batches:
            for raw in batch["content"]:
                data = netcdf.parse(bytes(raw))
                v = data.variables[name]
                values = np.asarray(v.values, float)
                for k in ("_FillValue", "missing_value"):
                    if k in v.attrs:
                        values = np.where(values == v.attrs[k], np.nan, values)
                values = values * v.attrs.get("scale_factor", 1.0) + v.attrs.get("add_offset", 0.0)
                short = [next((s for s, names in AXES.items() if d.lower() in names), d) for d in v.dims]
                grid = np.meshgrid(*[np.arange(n) for n in values.shape], indexing="ij")
                out = {"value": values.ravel(), "unit": v.attrs.get("units")}
                for s, d, i in zip(short, v.dims, grid, strict=True):
                    axis = data.variables[d].values if d in data.variables else np.arange(data.dims[d])
                    axis = days_since(data.variables[d].attrs["units"], axis) if s == "t" else axis
                    out[s] = np.asarray(axis)[i.ravel()]
                frame = pd.DataFrame(out)
                frame["t"] = frame["t"].astype("datetime64[s]").dt.date if "t" in frame else None
                frame["member"] = frame["member"].astype(int) if "member" in frame else -1
                frame["value"] = frame["value"].astype(object).where(frame["value"].notna(), None)
                yield frame[["t", "y", "x", "member", "value", "unit"]]

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(rows, "t date, y double, x double, member int, value double, unit string").withColumn("member", F.when(F.col("member") >= 0, F.col("member")))


def read_variable(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(t, y, x, value, unit) of one variable: NetCDF, Parquet or CSV with a column of the variable's name, or ``value``."""
    if path.endswith(".nc"):
        return read_netcdf(spark, path, name).drop("member")
    df = spark.read.csv(path, header=True, inferSchema=True) if ".csv" in path else spark.read.parquet(path)
    df = rename_axes(df)
    value = name if name in df.columns else "value"
    unit = F.col("unit").cast("string") if "unit" in df.columns else F.lit(None).cast("string")
    return df.select(F.to_date("t").alias("t"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col(value).cast("double").alias("value"), unit.alias("unit"))


def with_site_ids(df: DataFrame) -> DataFrame:
    """``df`` with site_id, a hash of the place: the same place has the same id in every table, without a shared list."""
    plain = lambda k: F.when(F.col(k) == 0, 0.0).otherwise(F.col(k).cast("double"))  # noqa: E731 - no negative zero
    return df.withColumn("site_id", F.xxhash64(plain("y"), plain("x")))


def open_observations(spark: SparkSession, paths: dict[str, str], *, units: dict[str, str] | None = None, assume_units: bool = False, aliases: dict[str, str] | None = None) -> DataFrame:
    """(t, site_id, y, x, variables): files by variable, on one grid, in canonical units, impossible values as null.

    ``units`` overrides the files' units; a file without units raises unless
    ``assume_units``; ``aliases`` maps a file's variable name to ours.
    """
    known = aliases or {}
    names = {known.get(k, k): (k, path) for k, path in paths.items()}
    if unknown := set(names) - set(VARIABLES):
        raise ValueError(f"unknown variables {sorted(unknown)}; they are {VARIABLES}")
    if "PRCP" not in names:
        raise ValueError("PRCP is needed")
    out = None
    for name in (v for v in VARIABLES if v in names):
        own, path = names[name]
        rows = read_variable(spark, path, own)
        given = (units or {}).get(name)
        unit = F.lit(given) if given else F.col("unit")
        if assume_units:
            unit = F.coalesce(unit, F.lit({"PRCP": "mm", "TMIN": "degC", "TMAX": "degC", "HUMIN": "%", "HUMAX": "%", "WIND": "m/s", "SOLAR": "mj/m2"}[name]))
        rows = rows.select("t", "y", "x", to_canonical(name, F.col("value"), unit).alias(name))
        out = rows if out is None else out.join(rows, ["t", "y", "x"], "full")
    return canonicalize(with_site_ids(out)).select("t", "site_id", "y", "x", *[v for v in VARIABLES if v in names])


def require_grid(obs: DataFrame) -> DataFrame:
    """``obs``, checked: keys are there and unique, coordinates finite, latitudes within 90 degrees, and there is a row."""
    bad = ~F.col("y").between(-90, 90) | F.isnan("y") | F.isnan("x") | F.col("y").isNull() | F.col("x").isNull() | F.col("t").isNull()
    found = obs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad")).first()
    if not found["n"] or found["bad"]:
        raise ValueError("the grid is empty, or has missing, infinite or impossible coordinates")
    if obs.groupBy("t", "y", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a day occurs twice at a place")
    return obs


def load_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, y, x, pb, pn, pa) of a table (y, x, category, value) with any known category names, or with the three as
    columns; invalid triples are null."""
    df = rename_axes(spark.read.csv(path, header=True, inferSchema=True) if ".csv" in path else spark.read.parquet(path))
    kind = next((k for k in ("category", "probability", "class") if k in df.columns), None)
    if kind:
        df = df.select("y", "x", relabel(F.col(kind).cast("string")).alias("label"), F.col("value").cast("double").alias("value")).groupBy("y", "x").pivot("label", ["pb", "pn", "pa"]).agg(F.first("value"))
    else:
        ours = {k: short for k in df.columns for short, names in CATEGORY_NAMES.items() if k.upper() in names}
        df = df.withColumnsRenamed(ours)
    df = with_site_ids(df)
    return df.select("site_id", "y", "x").join(prepare_probabilities(df), "site_id")


def onto_grid(values: DataFrame, targets: DataFrame, columns: list[str], most: int = 100_000) -> DataFrame:
    """``columns`` of the nearest source cell for each target cell; null outside the sources' range on either axis.

    Axes are found apart, each of at most ``most`` coordinates, and cells then meet by equality of both.
    """
    from .panel import nearest_axis

    out = targets
    for axis in ("y", "x"):
        if values.select(axis).distinct().limit(most + 1).count() > most:
            raise ValueError(f"more than {most} coordinates on {axis}")
        near = nearest_axis(targets, values, axis).withColumnsRenamed({"target": f"{axis}_target", "source": f"{axis}_source"})
        out = out.join(F.broadcast(near), out[axis].cast("double") == F.col(f"{axis}_target"), "left").drop(f"{axis}_target")  # one row a coordinate
    cells = values.select(F.col("y").cast("double").alias("y_source"), F.col("x").cast("double").alias("x_source"), *columns)
    return out.join(cells, ["y_source", "x_source"], "left").select(*targets.columns, *columns)


def save_netcdf(ensemble: DataFrame, path: str, *, value: str = "PRCP", units: str = "mm d-1", others: dict[str, str] | None = None, attrs: dict | None = None, most: int = 50_000_000) -> None:
    """Write (member, t, y, x, value and ``others`` with their units) as one classic NetCDF file, single precision, days
    since 1970; at most ``most`` rows.

    Larger ensembles are written as Parquet, or season by season.
    """
    fields = {value: units} | (others or {})
    rows = ensemble.select("member", "t", "y", "x", *[F.col(v).cast("float").alias(v) for v in fields])
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows in one file; write seasons or members apart")
    got = rows.toPandas()
    axes = {k: np.unique(got[k].to_numpy()) for k in ("member", "t", "y", "x")}
    place = [np.searchsorted(axes[k], got[k].to_numpy()) for k in axes]
    time = np.array([(d - EPOCH).days for d in axes["t"]], np.int32)
    variables = {"member": netcdf.Variable(("member",), axes["member"].astype(np.int32)), "t": netcdf.Variable(("t",), time, {"units": "days since 1970-01-01"})}
    variables |= {k: netcdf.Variable((k,), axes[k].astype(float)) for k in ("y", "x")}
    for name, unit in fields.items():
        grid = np.full([len(a) for a in axes.values()], np.nan, np.float32)
        grid[tuple(place)] = got[name].to_numpy(np.float32)
        variables[name] = netcdf.Variable(tuple(axes), grid, {"units": unit, "_FillValue": float("nan")})
    with open(path, "wb") as f:
        f.write(netcdf.build(netcdf.Dataset({k: len(a) for k, a in axes.items()}, variables, attrs or {})))


def save_model(generator, path: str) -> None:
    """A fitted generator as tables beside a JSON of its options: parameters, weights, limits, runs, classes."""
    spark = generator.fitted["params"].sparkSession
    for name, df in generator.fitted.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    options = {k: v for k, v in vars(generator).items() if k not in ("fitted", "spatial", "constraints")}
    spark.createDataFrame([(json.dumps(options, default=list, sort_keys=True), json.dumps(generator.diagnostics(), default=str, sort_keys=True))], "options string, diagnostics string").coalesce(1).write.mode("overwrite").json(f"{path}/options")


def load_model(spark: SparkSession, path: str, **more):
    """The generator that ``save_model`` wrote; ``more`` gives what isn't plain values, such as the field in space."""
    from ..operators.generators import WeatherGenerator

    options = json.loads(spark.read.json(f"{path}/options").first()["options"])
    options = {k: tuple(v) if isinstance(v, list) else v for k, v in options.items()}
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    names = [x.getPath().getName() for x in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root) if x.isDirectory()]
    return WeatherGenerator(**(options | more), fitted={n: spark.read.parquet(f"{path}/{n}") for n in names if n != "options"})


def parse_constraint(text: str) -> tuple[str, str | None, float]:
    """(attribute, path of its forecast or None, tolerance) of ``attribute[=path][@tolerance]``."""
    head, _, tolerance = text.partition("@")
    name, _, path = head.partition("=")
    if not name.strip():
        raise ValueError(f"no attribute in {text!r}")
    out = float(tolerance) if tolerance else 0.01
    if not out > 0:
        raise ValueError("the tolerance is positive")
    return name.strip(), path.strip() or None, out


def smoke_panel(spark: SparkSession, years: tuple[int, int] = (2001, 2012), seed: int = 42) -> DataFrame:
    """(t, site_id, y, x, PRCP): a small panel of seasons July to September on a 2 by 2 grid, 45 % dry, Gamma amounts of shape
    1.5 and scale 6, by a generator of its own for each day and place."""
    rng = np.random.default_rng(seed)
    days = [datetime.date(y, 7, 1) + datetime.timedelta(i) for y in range(years[0], years[1] + 1) for i in range(92)]
    rows = [(d, y, x, float(rng.gamma(1.5, 6.0)) if rng.random() >= 0.45 else 0.0) for d in days for y in (10.0, 11.0) for x in (2.0, 3.0)]
    return with_site_ids(spark.createDataFrame(rows, "t date, y double, x double, PRCP double"))
