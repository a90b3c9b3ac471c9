import pandas as pd
import pytest

from tablewise.registry import OPERATORS, register, run


def test_run_checks_names_and_arguments(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2.0, 3.0]}))
    assert run("profile_dataset", df).first()["name"] == "a"
    for bad in (lambda: run("nope", df), lambda: run("histogram", df, column="a", colour=1), lambda: run("histogram", df, column="z")):
        with pytest.raises(ValueError):
            bad()
    register("row_count", lambda d: d.count())
    assert run("row_count", df) == 3
    del OPERATORS["row_count"]
