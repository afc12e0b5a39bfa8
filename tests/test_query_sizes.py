"""Queries without SQL run the operators' whole number of steps, simulations and permutations."""

import inspect

import pytest

from tesserae.operators import autocorr, ligrec, patterns, sepal
from tesserae.plans import registry

SMALL = "/root/testdata/sf0.001"
CASES = [
    ("sepal", sepal, "sepal", {"n_iter": 30_000}),
    ("ripley_simulated", patterns, "ripley", {"n_sims": 100, "n_points": 1000, "n_steps": 50}),
    ("spatial_autocorr_permuted", autocorr, "spatial_autocorr", {"n_perms": 1000}),
    ("ligrec_fdr", ligrec, "ligrec", {"n_perms": 1000}),
]


class Seen(Exception):
    pass


@pytest.mark.parametrize(("query", "module", "name", "expected"), CASES, ids=[c[0] for c in CASES])
def test_whole_job(spark, monkeypatch, query, module, name, expected):
    signature = inspect.signature(getattr(module, name))

    def look(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Seen({k: bound.arguments[k] for k in expected})

    monkeypatch.setattr(module, name, look)
    with pytest.raises(Seen) as seen:
        registry.QUERIES[query](spark, SMALL)
    assert seen.value.args[0] == expected
