import pytest

from runscope.plans.stage import StageArea

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, answer int, key int"


@pytest.fixture
def docs(spark):
    """Makes a documents table with extra columns whose names the operators use inside."""

    def make(rows, partitions=3):
        full = [(i, t, "en", "a", None if t is None else len(t), f"b{n}", n, None) for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture
def own_area(spark):
    with StageArea(spark, "test") as area:
        yield area
