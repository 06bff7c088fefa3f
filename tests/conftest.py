import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from groundwell.session import local_session

    session = local_session("tests", 8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def one(spark):
    """Evaluate column expressions over one row of named string values."""

    def run(expr, **values):
        schema = ", ".join(f"`{k}` {_type(v)}" for k, v in values.items()) or "x int"
        row = tuple(values.values()) or (1,)
        return spark.createDataFrame([row], schema).select(expr.alias("out")).first()["out"]

    return run


def _type(v):
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "long"
    if isinstance(v, float):
        return "double"
    if isinstance(v, list):
        return f"array<{_type(v[0]) if v else 'string'}>"
    return "string"
