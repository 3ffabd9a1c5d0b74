"""The model comparison runs with the operator's own sizes."""

import inspect
from types import SimpleNamespace

import __spark_entry__ as entry
from caregap.operators import ml
from caregap.plans import catalog_ml


def test_comparison_is_not_cut(spark, monkeypatch):
    given = []
    real = inspect.signature(ml.compare_models)

    def record(*args, **sizes):
        call = real.bind(*args, **sizes)
        call.apply_defaults()
        given.append(call.arguments)
        return spark.range(1)

    monkeypatch.setattr(catalog_ml, "ml", SimpleNamespace(**{**vars(ml), "compare_models": record}))
    entry.queries()["m9_model_comparison"](spark, "/root/testdata/sf0.001")
    assert [(g["trees"], g["rounds"], g["iterations"]) for g in given] == [(400, 250, 2000)]
