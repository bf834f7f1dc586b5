"""Scenes as band files: choices, two-phase commit, headers; bands of stored scenes."""

import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicube import registry
from lumicube.sources import band_files as bf
from lumicube.sources import band_store


def lines_of(spark, products=("A_1", "B_2"), bands=(1, 2, 11), lines=6, samples=5, seed=1):
    r = np.random.default_rng(seed)
    rows = [(p, k, b, 400.0 + b, y, [float(v) for v in r.integers(-100, 1000, samples)]) for p in products for k in ("radiance", "mask") for b in bands for y in range(lines)]
    return spark.createDataFrame(rows, bf.SCHEMA), {r[:3] + (r[4],): r[5] for r in rows}


def read_back(df):
    return {(x["product_id"], x["kind"], x["band"], x["y"]): x["samples"] for x in df.collect()}


def tree(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file() and not p.name.endswith(".crc"))


@pytest.mark.parametrize("options", [{}, {"dataType": "2", "byteOrder": "0"}, {"dataType": "5", "gain": "0.5"}])
def test_write_and_read_back(spark, tmp_path, options):
    df, want = lines_of(spark)
    bf.write_lines(df.repartition(3), str(tmp_path), **options)
    assert len(tree(tmp_path)) == 24 and "A_1.data/radiance_11.hdr" in tree(tmp_path)
    head = bf.parse_header((tmp_path / "A_1.data/radiance_11.hdr").read_text())
    assert (head["samples"], head["lines"], head["wavelength"], head["data type"]) == ("5", "6", "411.0", options.get("dataType", "3"))
    for part in (40, 1 << 20):
        got = bf.scan_lines(spark, str(tmp_path), partBytes=part)
        assert read_back(got) == want
        assert set(got.select("band", "wavelength").distinct().collect()) == {(b, 400.0 + b) for b in (1, 2, 11)}
    assert read_back(bf.scan_lines(spark, f"file://{tmp_path}/B_2.data")) == {k: v for k, v in want.items() if k[0] == "B_2"}


def test_choices_drop_files_and_lines(spark, tmp_path):
    df, want = lines_of(spark)
    bf.write_lines(df, str(tmp_path))
    cases = [
        (bf.Choice(), 12 * 3, lambda k: True),
        (bf.Choice(products=["A_1"], kinds=["radiance"], bands=[2, 11]), 2 * 3, lambda k: k[0] == "A_1" and k[1] == "radiance" and k[2] != 1),
        (bf.Choice(bands=[2], lines=(4, 99)), 4 * 3, lambda k: k[2] == 2 and k[3] >= 4),
        (bf.Choice(kinds=["mask"], lines=(3, 3)), 6 * 3, lambda k: k[1] == "mask" and k[3] == 3),
        (bf.Choice(kinds=["radiance"], wavelengths=(401.5, 402.0)), 6 * 3, lambda k: k[1] == "radiance" and k[2] == 2),
        (bf.Choice(bands=[77]), 1, lambda k: False),
    ]
    for choice, parts, keep in cases:
        some = bf.scan_lines(spark, str(tmp_path), choice, partBytes=40)
        assert some.rdd.getNumPartitions() == parts, choice
        assert read_back(some) == {k: v for k, v in want.items() if keep(k)}, choice
    (tmp_path / "A_1.data/mask_2.img").write_bytes(b"broken")
    (tmp_path / "A_1.data/mask_2.hdr").unlink()
    assert bf.scan_lines(spark, str(tmp_path), bf.Choice(kinds=["radiance"])).count() == 36  # other files aren't opened
    plan = bf.scan_lines(spark, str(tmp_path), bf.Choice(bands=[1]))._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan band_files" in plan


def test_filters_of_one_frame_do_not_meet(spark, tmp_path):
    df, want = lines_of(spark, bands=(1, 2))
    bf.write_lines(df.withColumn("wavelength", F.lit(None).cast("double")), str(tmp_path))
    got = bf.scan_lines(spark, str(tmp_path))
    one, two = got.filter("kind = 'radiance' AND band = 1"), got.filter("kind = 'mask' AND band = 2")
    assert read_back(one.union(two)) == {k: v for k, v in want.items() if k[1:3] in (("radiance", 1), ("mask", 2))}
    assert got.count() == len(want) and got.filter("wavelength IS NULL").count() == len(want)
    assert bf.scan_lines(spark, str(tmp_path), bf.Choice(wavelengths=(0.0, 1e9))).count() == 0


def test_half_way_failure_leaves_nothing_and_a_rerun_succeeds(spark, tmp_path):
    df, want = lines_of(spark)
    bf.write_lines(df.filter("product_id = 'A_1'"), str(tmp_path))
    before = tree(tmp_path)
    bad = df.withColumn("samples", F.when((F.col("product_id") == "B_2") & (F.col("band") == 11) & (F.col("y") == 5), F.array(F.lit(1e300))).otherwise(F.col("samples")))
    for wrong in (bad, df.filter("NOT (product_id = 'B_2' AND band = 2 AND y = 3)"), df.withColumn("samples", F.transform("samples", lambda v: v + 1e12)), df.union(df)):
        with pytest.raises(Exception, match="lines of|fit the data type"):
            bf.write_lines(wrong, str(tmp_path), overwrite=True)
        assert tree(tmp_path) == before
    with pytest.raises(Exception, match="there already: A_1"):
        bf.write_lines(df, str(tmp_path))
    assert tree(tmp_path) == before
    bf.write_lines(df, str(tmp_path), overwrite=True)
    assert read_back(bf.scan_lines(spark, str(tmp_path))) == want and not [p for p in os.listdir(tmp_path) if p.startswith("_")]


def test_bands_split_over_tasks_and_lost_attempts_are_refused_or_ignored(spark, tmp_path):
    df, want = lines_of(spark, products=("A_1",), bands=(1,))
    bf.register(spark)
    writer = bf.Writer(str(tmp_path), False, {})
    batch = df.filter("kind = 'mask'").toArrow().to_batches()
    lost, kept = writer.write(iter(batch)), writer.write(iter(batch))  # an attempt whose message never arrives
    assert bf.Reader(str(tmp_path), 1 << 20, bf.Choice()).partitions()[0].pieces == []  # nothing can be seen before the commit
    with pytest.raises(ValueError, match="by two tasks"):
        writer.commit([kept, lost, None])
    assert tree(tmp_path) == []
    writer = bf.Writer(str(tmp_path), False, {})
    writer.write(iter(batch))
    writer.commit([writer.write(iter(batch)), None])
    assert tree(tmp_path) == ["A_1.data/mask_1.hdr", "A_1.data/mask_1.img"]
    assert read_back(bf.scan_lines(spark, str(tmp_path))) == {k: v for k, v in want.items() if k[1] == "mask"}


def test_odd_folders(spark, tmp_path):
    assert bf.scan_lines(spark, str(tmp_path)).count() == 0
    df, want = lines_of(spark, products=("A_1",), bands=(1,))
    bf.write_lines(df, str(tmp_path))
    (tmp_path / "A_1.data/preview.img").write_bytes(b"x")
    (tmp_path / "_staging-x").mkdir()
    (tmp_path / "_staging-x/mask_1.img").write_bytes(b"x")
    assert read_back(bf.scan_lines(spark, str(tmp_path))) == want
    bf.write_lines(df.limit(0), str(tmp_path / "none"))
    image = tmp_path / "A_1.data/mask_1.img"
    image.write_bytes(image.read_bytes()[:-4])
    with pytest.raises(Exception, match="shorter than its header"):
        bf.scan_lines(spark, str(tmp_path)).collect()
    for name in (None, "_x", "a/b"):
        with pytest.raises(Exception, match="no file can be named"):
            bf.write_lines(df.withColumn("product_id", F.lit(name).cast("string")), str(tmp_path / "odd"))


def test_cells_lines_and_pixels(spark):
    cells = spark.createDataFrame([("p", "radiance", b, 400.0, y, x, float(100 * b + 10 * y + x)) for b in (1, 2) for y in range(3) for x in range(4) if (b, y, x) != (2, 1, 0)], "product_id string, kind string, band int, wavelength double, y int, x int, value double")
    lines = bf.to_lines(cells, -7.0)
    got = read_back(lines)
    assert len(got) == 6 and got["p", "radiance", 2, 1] == [-7.0, 211.0, 212.0, 213.0] and got["p", "radiance", 1, 2] == [120.0, 121.0, 122.0, 123.0]
    assert bf.to_cells(lines).filter("value <> -7").count() == 23
    pixels = {(x["y"], x["x"]): (x["radiance"], x["mask"]) for x in bf.to_pixels(lines, {"radiance": "int", "mask": "smallint"}).collect()}
    assert len(pixels) == 12 and pixels[1, 0] == ([110, -7], [0, 0]) and pixels[2, 3] == ([123, 223], [0, 0])


def test_bands_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    df, want = lines_of(spark)
    band_store.write_bands(df, path)
    with pytest.raises(Exception, match="already exists"):
        band_store.write_bands(df, path)
    files = {p: os.stat(f"{path}/{p}").st_mtime_ns for p in tree(path)}
    own = band_store.read_bands(spark, path).filter("product_id = 'A_1' AND kind = 'radiance' AND band = 2")
    band_store.put_bands(own.withColumn("samples", F.transform("samples", lambda v: v + 1)), path)
    key = lambda k: k[:3] == ("A_1", "radiance", 2)
    changed = {k: [v + 1 for v in x] if key(k) else x for k, x in want.items()}
    assert read_back(band_store.read_bands(spark, path)) == changed
    after = {p: os.stat(f"{path}/{p}").st_mtime_ns for p in tree(path)}
    gone = [p for p in files if after.get(p) != files[p] and p != "_SUCCESS"]
    assert len(gone) == 1 and "product_id=A_1/kind=radiance/band=2" in gone[0]
    own = band_store.read_bands(spark, path).filter("product_id = 'A_1' AND kind = 'radiance' AND band = 2")
    broken = own.withColumn("samples", F.transform("samples", lambda v: F.raise_error(F.lit("half way")).cast("double")))
    with pytest.raises(Exception, match="half way"):
        band_store.put_bands(broken, path)
    assert read_back(band_store.read_bands(spark, path)) == changed
    band_store.put_bands(own.withColumn("kind", F.lit("cloud_product")), path)
    assert band_store.read_bands(spark, path).filter("kind = 'cloud_product'").count() == 6 and band_store.read_bands(spark, path).count() == len(want) + 6
    plan = band_store.read_bands(spark, path).filter("band = 2 AND kind = 'mask'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan


@pytest.mark.parametrize("name", ["scan_product", "sink_product", "sink_band_into_product", "copy_product"])
def test_oracle(spark, data, same_as_oracle, name):
    assert same_as_oracle(registry.queries()[name](spark, data), registry.oracle_sql()[name]) > 0
