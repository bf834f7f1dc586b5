"""Binary tables, scenes in folders, time tables and mixtures with full covariances."""

import numpy as np
import pytest

from lumicube import registry
from lumicube.operators import mixture
from lumicube.plans.catalog_tables import rtc_stand_in
from lumicube.sources import binary_tables, scenes

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", "scan_xy_table scan_rtc_lut update_time_tables merge_time_tables three_decimals geographic_coordinates normalise_features kmeans_start".split())
def test_oracle(spark, data, same_as_oracle, name):
    assert same_as_oracle(QUERIES[name](spark, data), ORACLE[name]) > 0


def test_rtc_file(spark, tmp_path):
    table = rtc_stand_in()
    (tmp_path / "lut.bin").write_bytes(binary_tables.encode_rtc(table))
    read = binary_tables.load_rtc(spark, str(tmp_path / "lut.bin"))
    for k in "AB":
        np.testing.assert_allclose(read.blocks[k], table.blocks[k], rtol=1e-6)
    assert binary_tables.read_rtc(spark, str(tmp_path / "lut.bin")).count() == 32 + 48
    node = read.at(10.0, 40.0, 1.0, 0.25, 90.0, 2.0)  # a node, and a point held to the axes
    np.testing.assert_allclose(node.lpw, read.blocks["A"][1, 1, 1, 1, 1, :, 0])
    np.testing.assert_allclose(node.sab, read.at(99.0, 99.0, 9.0, 9.0, 180.0, 9.0).sab)
    between = read.at(5.0, 30.0, 0.5, 0.1875, 45.0, 0.75)
    np.testing.assert_allclose(between.lpw, read.blocks["A"][..., 0].mean(axis=(0, 1, 2, 3, 4)))


def test_scene_in_a_folder(spark, tmp_path):
    r = np.random.default_rng(1)
    made = {}
    for band in (1, 2, 11):
        for kind, code, dtype in (("radiance", 3, ">i4"), ("mask", 2, ">i2")):
            image = r.integers(0, 1000, (4, 5)).astype(dtype)
            made[kind, band] = image
            (tmp_path / f"{kind}_{band}.img").write_bytes(image.tobytes())
            (tmp_path / f"{kind}_{band}.hdr").write_text(f"ENVI\nsamples = 5\nlines = 4\nbands = 1\ndata type = {code}\nbyte order = 1\nwavelength = {{{400 + band}.5}}\n")
    headers = {x["stem"]: x for x in scenes.read_headers(spark, str(tmp_path)).collect()}
    assert headers["radiance_11"]["wavelength"] == 411.5 and headers["mask_2"]["kind"] == "mask" and len(headers) == 6
    got = scenes.read_scene(spark, str(tmp_path), "p").collect()
    assert len(got) == 20
    for x in got:
        assert x["radiance"] == [made["radiance", b][x["y"], x["x"]] for b in (1, 2, 11)]
        assert x["mask"] == [made["mask", b][x["y"], x["x"]] for b in (1, 2, 11)]


def test_full_covariances_are_what_numpy_finds(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.multivariate_normal(m, c, 200) for m, c in (((0, 0, 0), np.diag((1, 2, 0.5))), ((6, 1, 2), np.array([[1, 0.8, 0], [0.8, 1, 0], [0, 0, 1]])), ((0, 7, -3), np.eye(3)))])
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double")
    first = x[[0, 200, 400]]
    centres = first.copy()
    for _ in range(3):
        near = np.argmin(((x[:, None] - centres) ** 2).sum(axis=2), axis=1)
        centres = np.stack([x[near == k].mean(axis=0) for k in range(3)])
    got = mixture.kmeans(rows, ["a", "b", "c"], first, 3)
    np.testing.assert_allclose(got, centres, atol=1e-9)
    near = np.argmin(((x[:, None] - centres) ** 2).sum(axis=2), axis=1)
    state = [(centres[k], (x[near == k] - centres[k]).T @ (x[near == k] - centres[k]) / (near == k).sum(), (near == k).mean()) for k in range(3)]
    begun = mixture.start(rows, ["a", "b", "c"], centres)
    for g, (m, c, p) in zip(begun, state, strict=True):
        np.testing.assert_allclose(g.covariance, c, atol=1e-9)
        assert abs(g.prior - p) < 1e-12
    for _ in range(4):
        dens = np.stack([p * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for m, c, p in state], axis=1)
        post = dens / dens.sum(axis=1, keepdims=True)
        means = [post[:, k] @ x / post[:, k].sum() for k in range(3)]
        state = [(m, (post[:, k][:, None] * (x - m)).T @ (x - m) / post[:, k].sum(), post[:, k].mean()) for k, m in enumerate(means)]
    for g, (m, c, p) in zip(mixture.em(rows, ["a", "b", "c"], begun, 4), state, strict=True):
        np.testing.assert_allclose(g.mean, m, atol=1e-8)
        np.testing.assert_allclose(g.covariance, c, atol=1e-8)
        assert abs(g.prior - p) < 1e-9


def test_flat_clusters_get_the_identity(spark):
    rows = spark.createDataFrame([(float(i), 1.0) for i in range(10)], "a double, b double")
    made = mixture.start(rows, ["a", "b"], np.array([[2.0, 1.0], [7.0, 1.0]]))
    assert all(g.covariance[1, 1] == 1.0 for g in made)
    scaled = mixture.normalised(rows, ["a", "b"]).collect()
    assert {x["b"] for x in scaled} == {0.0} and max(x["a"] for x in scaled) == 1.0


def test_full_mixture_query(spark, data):
    got = QUERIES["find_full_mixture"](spark, data).collect()
    assert len(got) == 4 and abs(sum(x["prior"] for x in got) - 1) < 1e-9
