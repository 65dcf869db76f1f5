"""Association operators against brute force on small fixtures (phi_K has
no SQL oracle)."""

import numpy as np
import pandas as pd
import pytest

from cohortlens.operators.assoc import chi2_matrix, phik_from_chi2, phik_matrix


def test_perfect_association(spark):
    rows = [(c, {"a": "x", "b": "y", "c": "z"}[c]) for c in "abc" * 40]
    df = spark.createDataFrame(rows, "p string, q string")
    r = phik_matrix(df, ["p", "q"]).first()
    assert r["dof"] == 4 and r["n"] == 120
    assert r["chi2"] == pytest.approx(240.0)          # n * (k - 1)
    assert r["cramers_v"] == pytest.approx(1.0)
    assert r["phik"] == pytest.approx(1.0, abs=1e-3)


def test_independent_design(spark):
    rows = [(a, b) for a in "abc" for b in "xy" for _ in range(20)]
    r = phik_matrix(spark.createDataFrame(rows, "p string, q string"), ["p", "q"]).first()
    assert r["chi2"] == pytest.approx(0.0, abs=1e-9)
    assert r["phik"] == 0.0


def test_phik_grows_with_correlation():
    rng = np.random.default_rng(1)
    out = []
    for rho in (0.2, 0.8):
        z = rng.multivariate_normal([0, 0], [[1, rho], [rho, 1]], size=4000)
        x = np.digitize(z[:, 0], np.quantile(z[:, 0], [.2, .4, .6, .8]))
        y = np.digitize(z[:, 1], np.quantile(z[:, 1], [.2, .4, .6, .8]))
        tab = pd.crosstab(x, y).to_numpy().astype(float)
        e = tab.sum(1, keepdims=True) * tab.sum(0, keepdims=True) / tab.sum()
        chi2 = float(((tab - e) ** 2 / e).sum())
        out.append(phik_from_chi2(chi2, tab.sum(), 5, 5, 16.0))
    assert 0.1 < out[0] < 0.35 and 0.7 < out[1] < 0.9


def test_chi2_matches_crosstab(spark):
    from cohortlens.plans.places import ASSOC_COLS, ASSOC_INTERVAL, merge_and_dedup
    from cohortlens.sources import adapters as A
    from cohortlens.sources.tables import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    places = merge_and_dedup(A.p_info(t), A.p_price(t))
    m = {(r["col_a"], r["col_b"]): r for r in chi2_matrix(places, ASSOC_COLS, ASSOC_INTERVAL).collect()}
    pdf = places.select("category", "district", "price", "is_24_7").toPandas()
    for a, b in [("category", "district"), ("category", "price"), ("price", "is_24_7")]:
        sub = pdf[[a, b]].dropna()
        tab = pd.crosstab(sub[a], sub[b]).to_numpy().astype(float)
        e = tab.sum(1, keepdims=True) * tab.sum(0, keepdims=True) / tab.sum()
        assert m[(a, b)]["chi2"] == pytest.approx(float(((tab - e) ** 2 / e).sum()), abs=1e-5)
        assert m[(a, b)]["n"] == len(sub)
