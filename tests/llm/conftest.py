import pytest


@pytest.fixture(scope="session", autouse=True)
def warehouse(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("llm")))
