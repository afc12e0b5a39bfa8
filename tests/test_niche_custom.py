"""Niches by any embedding and clustering, and the arguments of the flavors."""

import warnings

import pytest
from pyspark.sql import functions as F

from tesserae.operators import niche


def _fixture(spark):
    cells = [(i, "a" if i < 6 else "b" if i < 12 else None, "xy"[i % 2]) for i in range(14)]
    nodes = spark.createDataFrame(cells, "id long, lib string, cl string")
    near = [(i, j, 1.0) for i in range(14) for j in (i - 1, i + 1, i + 2) if 0 <= j < 14]
    return nodes, spark.createDataFrame(near, "src long, dst long, w double")


def _heaviest(rows):
    return rows.groupBy("id").agg(F.max_by("cl", F.struct("share", "cl")).alias("label"))


def _plain(ids, near):
    out = {}
    for i in ids:
        n = {}
        for a, b, w in near:
            if a == i and b in ids:
                n["xy"[b % 2]] = n.get("xy"[b % 2], 0) + w
        out[i] = max(n, key=lambda c: (n[c], c)) if n else "not_a_niche"
    return out


def test_custom_niches(spark):
    nodes, edges = _fixture(spark)
    near = [tuple(r) for r in edges.collect()]
    embed = lambda part, own: niche.hop_profile(own, part, absolute=True)
    got = {r["id"]: r["label"] for r in niche.calculate_custom(nodes, edges, embed, _heaviest).collect()}
    assert got == _plain(range(14), near)
    apart = {r["id"]: r["label"] for r in niche.calculate_custom(nodes, edges, embed, _heaviest, library="lib", min_size=3, mask="id <> 2").collect()}
    want = {12: "not_a_niche", 13: "not_a_niche"}
    for name, ids in (("a", range(6)), ("b", range(6, 12))):
        own = {i: "not_a_niche" if i == 2 else v for i, v in _plain(ids, near).items()}
        sizes = [*own.values()]
        want |= {i: f"lib={name}_{v if sizes.count(v) >= 3 else 'not_a_niche'}" for i, v in own.items()}
    assert apart == want
    assert niche.calculate_custom(nodes.limit(0), edges, embed, _heaviest, library="lib").count() == 0


def test_arguments(spark):
    table = _fixture(spark)[1]
    check = niche.check_arguments
    none = {"expr": None, "latent": None}
    for flavor, tables, options, error in [
        ("louvain", none, {}, ValueError), ("utag", none, {}, ValueError), ("spatialleiden", {"expr": table, "latent": None}, {}, ValueError), ("neighborhood", none, {"hops": 2}, TypeError),
        ("neighborhood", none, {"distance": 0}, ValueError), ("neighborhood", none, {"distance": 1.5}, ValueError), ("neighborhood", none, {"distance": True}, ValueError), ("neighborhood", none, {"resolution": 0}, ValueError),
        ("cellcharter", {"expr": table, "latent": None}, {"aggregation": "median"}, ValueError), ("cellcharter", {"expr": table, "latent": None}, {"n_components": 0}, ValueError),
    ]:
        with pytest.raises(error):
            check(flavor, tables, options)
    with pytest.warns(UserWarning, match="latent.*n_components"):
        assert check("neighborhood", {"expr": None, "latent": table}, {"n_components": 3, "distance": 2, "min_size": 4}) == {"distance": 2, "min_size": 4}
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert check("spatialleiden", {"expr": None, "latent": table}, {"layer_ratio": 0.5, "mask": "id > 1"}) == {"layer_ratio": 0.5, "mask": "id > 1"}
