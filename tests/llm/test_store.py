import pytest

from riskframe.contracts import RiskError
from riskframe.llm import store


def test_schemes_of_shared_folders():
    assert store._arrow_uri("s3a://bucket/a/b") == "s3://bucket/a/b" and store._arrow_uri("abfss://c@x.example/a") == "abfss://c@x.example/a" and store._arrow_uri("/tmp/x") == "/tmp/x"
    with pytest.raises(RiskError, match="wasbs"):
        store._arrow_uri("wasbs://c@x.example/a")
    assert store.filesystem("file:///tmp/some")[1] == "/tmp/some"
