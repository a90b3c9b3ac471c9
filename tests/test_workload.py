import pytest

from workload import modelling, sources
from workload.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


class Called(Exception):
    pass


@pytest.mark.parametrize(
    "name, module, function, reduced",
    [
        ("auto_select_model_parts", modelling.train, "auto_select_model", {"params"}),
        ("tune_forest_parts", modelling.train, "tune", {"draws", "grid"}),
        ("text_vectors_documents", modelling.features, "text_vectors", {"dims", "features"}),
        ("permutation_importance_parts", modelling.explain, "permutation_importance", {"n_repeats"}),
        ("shapley_sampling_parts", modelling.explain, "shapley_sampling", {"draws"}),
        ("auto_insights_orders", sources.insights, "auto_insights", {"trees", "top_n"}),
    ],
)
def test_queries_use_the_defaults(spark, monkeypatch, name, module, function, reduced):
    def spy(*args, **kwargs):
        raise Called(set(kwargs))

    monkeypatch.setattr(module, function, spy)
    monkeypatch.setattr(modelling, "_price_model", lambda t: None)
    with pytest.raises(Called) as call:
        QUERIES[name](spark, FOLDER)
    assert not call.value.args[0] & reduced


def test_queries_return_whole_results(spark):
    row = QUERIES["text_vectors_documents"](spark, FOLDER).first()
    assert len(row["vector"]) == 64
    assert {"promoted", "new_model_id"} <= set(QUERIES["retrain_on_drift_parts"](spark, FOLDER).columns)
