"""Registered queries of the reference's operators, held against their DuckDB SQL on the smallest tables."""

import os

import pytest

from lumicube import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, data, same_as_oracle, name):
    same_as_oracle(QUERIES[name](spark, data), ORACLE[name])


@pytest.mark.parametrize("name", ["perform_geometric_correction", "wv_retrieval", "smile_shift", "spectral_polishing"])
def test_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_water_vapour_is_near_the_simulated(spark, data):
    from lumicube.operators.atmosphere import CWV_NODES

    rows = QUERIES["wv_retrieval"](spark, data).collect()
    off = [r["water_vapour"] / CWV_NODES[(r["x"] + 25 * r["y"]) % len(CWV_NODES)] - 1 for r in rows]
    assert len(off) == 500 and max(map(abs, off)) < 0.06


def test_entry(spark, data):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["band", "n", "mean_reflectance"] and df.count() == 64


def test_entry_without_the_llm_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/lumicube", tmp_path / "lumicube", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n[:2] == 'op' and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
