"""Files in and out: NetCDF bytes, observations by variable, forecasts, the command line, a saved generator."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from isohyet import cli
from isohyet.sources import files, netcdf


def test_netcdf_round_trip():
    data = netcdf.Dataset({"t": 3, "x": 2}, {"t": netcdf.Variable(("t",), np.array([1, 2, 5], np.int32), {"units": "days since 2000-02-28"}), "PRCP": netcdf.Variable(("t", "x"), np.arange(6, dtype=np.float32).reshape(3, 2), {"units": "mm", "scale": 1.5, "n": 3})}, {"title": "é"})
    raw = netcdf.build(data)
    back = netcdf.parse(raw)
    assert back.dims == data.dims and back.attrs == {"title": "é"} and back.variables["PRCP"].attrs == {"units": "mm", "scale": 1.5, "n": 3}
    assert back.variables["PRCP"].values.tolist() == data.variables["PRCP"].values.tolist() and raw[:4] == b"CDF\x02"
    assert files.days_since("days since 2000-02-28", back.variables["t"].values).astype(str).tolist() == ["2000-02-29", "2000-03-01", "2000-03-04"]
    with pytest.raises(ValueError, match="classic"):
        netcdf.parse(b"\x89HDF....")


def test_record_variables():
    """A file with an unlimited dimension, put together by hand from the format's description."""
    import struct

    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    head = b"CDF\x01" + struct.pack(">i", 2) + struct.pack(">ii", 10, 2) + name("t") + struct.pack(">i", 0) + name("x") + struct.pack(">i", 2) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 2)
    one = lambda n, dims, kind, size, begin: name(n) + struct.pack(">i", len(dims)) + b"".join(struct.pack(">i", d) for d in dims) + struct.pack(">ii", 0, 0) + struct.pack(">iii", kind, size, begin)
    at = len(head + one("t", [0], 4, 4, 0) + one("v", [0, 1], 5, 8, 0))
    raw = head + one("t", [0], 4, 4, at) + one("v", [0, 1], 5, 8, at + 4) + b"".join(struct.pack(">iff", i, i + 0.5, i + 0.25) for i in (7, 8))
    data = netcdf.parse(raw)
    assert data.variables["t"].values.tolist() == [7, 8] and data.variables["v"].values.tolist() == [[7.5, 7.25], [8.5, 8.25]]


def test_files_to_ensemble(spark, tmp_path):
    obs = files.smoke_panel(spark, (2001, 2006))
    obs.select("t", obs["y"].alias("lat"), obs["x"].alias("lon"), "PRCP").write.parquet(f"{tmp_path}/rain")
    pd.DataFrame([(y, x, c, v) for y in (10.0, 11.0) for x in (2.0, 3.0) for c, v in (("Early", 20), ("normal", 30), ("LATE", 50))], columns=["Y", "X", "category", "value"]).to_csv(f"{tmp_path}/terciles.csv", index=False)
    with pytest.raises(Exception, match="unit"):
        files.open_observations(spark, {"PRCP": f"{tmp_path}/rain"}).collect()
    read = files.open_observations(spark, {"PRCP": f"{tmp_path}/rain"}, units={"PRCP": "m"})
    assert read.agg({"PRCP": "max"}).first()[0] == pytest.approx(1000 * obs.agg({"PRCP": "max"}).first()[0])
    with pytest.raises(ValueError, match="unknown variables"):
        files.open_observations(spark, {"PRCP": "a", "SNOW": "b"})
    prob = files.load_probabilities(spark, f"{tmp_path}/terciles.csv").collect()
    assert len(prob) == 4 and all((r.pb, r.pn, r.pa) == pytest.approx((0.2, 0.3, 0.5)) for r in prob)
    args = ["--observations", f"PRCP={tmp_path}/rain", "--forecast", f"{tmp_path}/terciles.csv", "--years", "2001,2006", "--year", "2007", "--members", "3", "--assume-units"]
    cli.main([*args, "--output", f"{tmp_path}/out.nc", "--diagnostics", f"{tmp_path}/model"], spark)
    back = files.read_netcdf(spark, f"{tmp_path}/out.nc", "PRCP")
    assert back.count() == 3 * 92 * 4 and back.where("value < 0 OR value IS NULL").count() == 0
    again = files.load_model(spark, f"{tmp_path}/model").generate(2007, 3)
    key = lambda rows: sorted((r.member, str(r.t), round(r.value, 3)) for r in rows)
    assert key(back.collect()) == key(again.withColumnRenamed("PRCP", "value").collect())
    more = files.load_model(spark, f"{tmp_path}/model").generate(2007, 1, member_start=2)
    assert sorted(round(r.PRCP, 3) for r in more.collect()) == sorted(round(r.PRCP, 3) for r in again.where("member = 2").collect())
    cli.main([*args, "--output", f"{tmp_path}/out", "--constraint", "total@0.02", "--range-km", "300"], spark)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3 * 92 * 4


def test_command_line_with_companions(spark, tmp_path):
    obs = files.smoke_panel(spark, (2001, 2006))
    place = ["t", obs["y"].alias("lat"), obs["x"].alias("lon")]
    obs.select(*place, "PRCP").write.parquet(f"{tmp_path}/rain")
    obs.select(*place, (10 - obs["PRCP"] / 10 + F.dayofmonth("t") / 10).alias("TMIN")).write.parquet(f"{tmp_path}/tmin")
    obs.select(*place, (22 - obs["PRCP"] / 10 + F.dayofweek("t")).alias("TMAX")).write.parquet(f"{tmp_path}/tmax")
    pd.DataFrame([(y, x, c, v) for y in (10.0, 11.0) for x in (2.0, 3.0) for c, v in (("below", 20), ("normal", 30), ("above", 50))], columns=["Y", "X", "category", "value"]).to_csv(f"{tmp_path}/terciles.csv", index=False)
    args = ["--observations", f"PRCP={tmp_path}/rain", f"TMIN={tmp_path}/tmin", f"TMAX={tmp_path}/tmax", "--forecast", f"{tmp_path}/terciles.csv", "--years", "2001,2006", "--year", "2007", "--members", "2", "--assume-units", "--preset", "three_states"]
    cli.main([*args, "--output", f"{tmp_path}/out.nc", "--diagnostics", f"{tmp_path}/model"], spark)
    low, high = (files.read_netcdf(spark, f"{tmp_path}/out.nc", v).toPandas() for v in ("TMIN", "TMAX"))
    both = low.merge(high, on=["member", "t", "y", "x"])
    assert len(both) == 2 * 92 * 4 and (both.value_x <= both.value_y).all() and 8 < both.value_x.mean() < 14
    again = files.load_model(spark, f"{tmp_path}/model").generate(2007, 2)
    assert sorted(round(r.TMIN, 3) for r in again.collect()) == pytest.approx(sorted(low.value.round(3)), abs=2e-3)


def test_nearest_cells(spark):
    source = spark.createDataFrame([(0.0, 0.0, 1), (0.0, 1.0, 2), (2.0, 0.0, 3), (2.0, 1.0, 4)], "y double, x double, v int")
    target = spark.createDataFrame([(0.4, 0.9), (1.9, 0.1), (2.1, 0.0)], "y double, x double")
    assert {(r.y, r.x): r.v for r in files.onto_grid(source, target, ["v"]).collect()} == {(0.4, 0.9): 2, (1.9, 0.1): 3, (2.1, 0.0): None}


def test_refusals(spark):
    rows = spark.createDataFrame([("2001-01-01", 91.0, 0.0)], "t string, y double, x double")
    with pytest.raises(ValueError, match="coordinates"):
        files.require_grid(rows)
    with pytest.raises(ValueError, match="twice"):
        files.require_grid(spark.createDataFrame([("2001-01-01", 1.0, 0.0)] * 2, "t string, y double, x double"))
    assert files.parse_constraint("onset=a/b.csv@0.05") == ("onset", "a/b.csv", 0.05) and files.parse_constraint("total") == ("total", None, 0.01)
    with pytest.raises(ValueError, match="positive"):
        files.parse_constraint("total@0")
