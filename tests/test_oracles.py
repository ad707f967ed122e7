"""Every registered query with a DuckDB twin gives the same rows on the provided tables."""

import decimal
import glob
import math
import os

import pytest

from ledgerloom import registry

registry.load()
DATA = os.environ.get("LEDGERLOOM_TESTDATA", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(str([norm(r[c]) for c in cols]) for r in df.collect())
    cur = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(str([norm(dict(zip(names, r))[c]) for c in cols]) for r in cur.fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["beam_rollout", "dense_peel", "push_rank", "suspicious_set", "fit_mlp", "fit_boosted", "node_detector_1pct", "run_experiment", "multi_method_predict", "fit_logistic", "model_registry"])
def test_without_twin(spark, name):
    rows = registry.QUERIES[name](spark, DATA).collect()
    if name == "push_rank":
        total = {}
        for r in rows:
            total[r.case_id] = total.get(r.case_id, 0) + r["rank"] + r.residual
        assert all(abs(t - 1) < 1e-6 for t in total.values())
    if name == "suspicious_set":
        assert all(0 <= r.share <= 1 and r.size >= 1 for r in rows) and max(r.share for r in rows) == 1
    if name in ("fit_mlp", "fit_boosted"):
        # Better than the most frequent of four actions.
        assert sum(r.n * r.accuracy for r in rows) / sum(r.n for r in rows) > 0.3 and all(0 <= r.accuracy <= 1 for r in rows)
    if name == "node_detector_1pct":
        assert all(0 <= r.p <= 1 and 1 <= r["rank"] <= 10 for r in rows)
    if name == "model_registry":
        assert all(r.difference == 0 for r in rows)
    if name == "beam_rollout":
        assert all(0.5 <= r.probability <= 1 and len(r.path) <= 3 for r in rows)
    assert rows
