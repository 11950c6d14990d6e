import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.legacy.javaCharsets", "true").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """The value of an expression over one row, or over one cell x."""

    def run(f, x=None, kind="string"):
        df = spark.createDataFrame([(x,)], f"x {kind}")
        from pyspark.sql import functions as F

        return df.select(f(F.col("x")).alias("v")).first()["v"]

    return run
