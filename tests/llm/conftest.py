import pytest
from llm_tables import ODD, SMALL, documents
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text or "" for r in small.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, a null id, repeated rows, and columns with clashing names."""
    rows = list(enumerate(ODD)) + [(None, "no id at all"), (5, ODD[5]), (3, "x"), (3, "another text with id three")]
    clash = ["score", "shard", "slot", "predicted", "spans", "base", "start", "end", "set", "component", "path", "digest", "n", "text_hash"]
    return documents(spark, rows).withColumns({c: F.lit("kept") for c in clash})


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])
