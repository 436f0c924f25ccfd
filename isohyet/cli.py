"""Command line: fit a generator on files of observations and a forecast, and write an ensemble.

    python -m isohyet.cli --observations PRCP=rain.parquet --forecast terciles.csv --year 2025 --members 20 --output out
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import season as s
from .operators.constraints import SeasonalConstraint
from .operators.companions import UNITS, VARIABLES
from .operators.fields import Field
from .operators.generators import PRESETS, WeatherGenerator, preset
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="isohyet", description="Daily seasons conditioned on tercile forecasts")
    p.add_argument("--observations", nargs="+", required=True, metavar="VARIABLE=PATH")
    p.add_argument("--forecast", required=True)
    p.add_argument("--months", default="7,8,9")
    p.add_argument("--years", default="1991,2020", help="first and last season that may be learned from")
    p.add_argument("--year", type=int, required=True)
    p.add_argument("--members", type=int, default=20)
    p.add_argument("--output", required=True, help="a folder for Parquet, or a file that ends in .nc")
    p.add_argument("--preset", choices=sorted(PRESETS))
    p.add_argument("--weighting", default="terciles")
    p.add_argument("--conditioning", default="mean")
    p.add_argument("--occurrence", default="markov")
    p.add_argument("--constraint", nargs="*", default=[], metavar="ATTRIBUTE[=PATH][@TOLERANCE]")
    p.add_argument("--range-km", type=float, help="correlation range of the field; without it sites are independent")
    p.add_argument("--units", nargs="*", default=[], metavar="VARIABLE=UNIT")
    p.add_argument("--assume-units", action="store_true")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--diagnostics", help="folder for the fitted model and its diagnostics")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("isohyet").getOrCreate()
    pairs = lambda items: dict(x.split("=", 1) for x in items)
    months, years = tuple(map(int, a.months.split(","))), tuple(map(int, a.years.split(",")))
    obs = files.require_grid(files.open_observations(spark, pairs(a.observations), units=pairs(a.units), assume_units=a.assume_units))
    sites = obs.select("site_id", "y", "x").distinct()
    prob = files.onto_grid(files.load_probabilities(spark, a.forecast), sites, ["pb", "pn", "pa"]).select("site_id", "pb", "pn", "pa")
    others = tuple(v for v in VARIABLES if v in obs.columns)
    cube = s.seasonal_cube(obs.select("t", "site_id", "PRCP", *others), months, years)
    constraints, attributes = [], None
    for text in a.constraint:
        name, path, tolerance = files.parse_constraint(text)
        own = files.onto_grid(files.load_probabilities(spark, path), sites, ["pb", "pn", "pa"]) if path else None
        constraints.append(SeasonalConstraint(name, own, tolerance))
    if constraints:
        attributes = s.compute_attributes(obs, years, {k.name: (k.name, {}) for k in constraints})
    options = {"months": months, "climatology": years, "seed": a.seed, "spatial": Field(range_km=a.range_km) if a.range_km else None, "companions": others}
    if a.preset:
        generator = preset(a.preset, **options)
    else:
        weighting = "mre" if constraints and a.weighting == "terciles" else a.weighting
        generator = WeatherGenerator(**options, weighting=weighting, conditioning=a.conditioning, occurrence=a.occurrence, constraints=tuple(constraints))
    generator = generator.fit(cube, prob, sites, attributes=attributes)
    out = generator.generate(a.year, a.members).join(sites, "site_id").select("member", "t", "site_id", "y", "x", "PRCP", "tercile_class", *others)
    if a.output.endswith(".nc"):
        files.save_netcdf(out, a.output, others={v: UNITS[v] for v in others}, attrs={"seed": a.seed, "year": a.year})
    else:
        out.write.mode("overwrite").parquet(a.output)
    if a.diagnostics:
        files.save_model(generator, a.diagnostics)


if __name__ == "__main__":
    main()
