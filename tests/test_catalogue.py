"""Every registered query: SQL twins agree exactly, kernels give sound rows."""

import math
import shutil
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from isopleth.catalogue import ORACLE_SQL, QUERIES
from isopleth.operators import kernels

SF = "/root/testdata/sf0.001"
TABLES = ("supplier", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twin(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = db.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    got, want = ordered(df.select(*columns).collect()), ordered(db.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_without_nan(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    assert not any(isinstance(x, float) and math.isnan(x) for r in rows for x in r)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_the_rest_imports_without_the_corpus_operators(tmp_path, pipeline_too):
    root = Path(__file__).parent.parent
    shutil.copytree(root / "isopleth", tmp_path / "isopleth", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(("corpus_pipeline.py",) if pipeline_too and (root / "corpus_pipeline.py").exists() else ())):
        shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'average_area' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) == len(QUERIES), done.stderr


def test_no_query_multiplies_scans_or_misses_pruning(spark):
    plan = QUERIES["average_area"](spark, SF)._jdf.queryExecution().toString()
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double>" in plan


@pytest.mark.parametrize(
    "name, most",
    [("average_area", 1), ("average_volume", 1), ("integral_area", 1), ("enforce_global", 1), ("geopad", 1), ("laplacian", 1), ("gradient", 1), ("truncate_lat", 1), ("truncate_rows", 1), ("deriv_cyclic", 3), ("sel_hemisphere_avg", 1), ("anomaly", 2), ("get_reduce_chain", 1)],
)
def test_inputs_are_read_once(spark, name, most):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    plan = plan.partition("== Initial Plan ==")[0] if "== Initial Plan ==" in plan else plan
    assert 1 <= plan.count("FileScan") <= most, plan


def test_linetrack_takes_every_crossing_of_every_user(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    rows, crossings = QUERIES["linetrack"](spark, sf).collect(), defaultdict(lambda: defaultdict(list))
    for r in QUERIES["find_zeros"](spark, sf).collect():
        crossings[r.user_id][int(r.x0 // 10)].append(r.x0 % 10)
    assert max(crossings) > 40 and len(rows) == sum(len(x) for s in crossings.values() for x in s.values())
    for user in sorted(crossings)[::10]:
        stretches = sorted(crossings[user])
        linked = kernels.link_tracks([sorted(crossings[user][s]) for s in stretches], separation=3.0)
        want = sorted((s, t, x) for s, pairs in zip(stretches, linked, strict=True) for t, x in pairs)
        got = sorted((r.stretch, r.track, r.x0) for r in rows if r.user_id == user)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)


# two equal lowest or highest points; places and values whose decimals end in a five, or nearly
SERIES = ([5, 1, 1, 4, 2, 3], [1, 6, 6, 2, 3], [6.28, 1.39, 8.02], [53.09, 2.79, 1.46, 25.73], [2.7, 19.93, 18.4, 51.43], [6.14, 43.76, 25.06, 23.17], [14.26, 120.85, 67.44, 95.89])


def extrema_twin(spark, folder, name):
    """Rows of the query and of its SQL over ``SERIES``."""
    rows = [(i, t, float(v)) for i, vs in enumerate(SERIES) for t, v in enumerate(vs)]
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.executemany("insert into events values (?, timestamp '2024-01-01' + to_minutes(?), ?, 'view', ?, null)", [(100 * u + t, t, u, v) for u, t, v in rows])
    con.execute(f"copy events to '{folder}/events.parquet' (format parquet)")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    return ordered(df.select(*columns).collect()), ordered(con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", ["global_max", "global_min"])
def test_global_extrema_agree_with_sql_on_flat_and_half_way_points(spark, tmp_path, name):
    got, want = extrema_twin(spark, tmp_path, name)
    assert got == want and len(got) == len(SERIES)


def test_local_max_agrees_with_sql_on_flat_and_half_way_points(spark, tmp_path):
    got, want = extrema_twin(spark, tmp_path, "local_max")
    assert got == want and len(got) >= 4


def test_local_min_agrees_with_sql_on_flat_and_half_way_points(spark, tmp_path):
    got, want = extrema_twin(spark, tmp_path, "local_min")
    assert got == want and len(got) >= 4
