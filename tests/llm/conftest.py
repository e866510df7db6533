import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    """A documents-like frame with clashing extra columns."""
    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            from pyspark.sql import functions as F
            for name in ("hit", "fp", "data", "block", "score", "lines", "spans", "n"):
                df = df.withColumn(name, F.lit("x"))
        return df
    return make
