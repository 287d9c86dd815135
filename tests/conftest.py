"""One session for all tests, deliberately outside UTC: results must not depend on it."""

import pytest
from pyspark.sql import SparkSession

ARTICLE = (
    "title string, url string, published string, summary string, source string, "
    "tags array<string>, image string"
)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply an expression to a list of texts and return the results in order."""
    from pyspark.sql import functions as F

    def run(expression, texts):
        frame = spark.createDataFrame(list(enumerate(texts)), "place int, text string")
        rows = frame.select("place", expression(F.col("text")).alias("result")).collect()
        return [row.result for row in sorted(rows, key=lambda row: row.place)]

    return run


@pytest.fixture
def make_articles(spark):
    """Articles from (url, published, image) or dicts, numbered in arrival order."""
    from pyspark.sql import functions as F

    def make(rows):
        filled = []
        for place, row in enumerate(rows):
            given = {"title": f"Title {place}", "url": "", "published": "", "summary": "",
                     "source": "example.com", "tags": [], "image": ""} | row
            filled.append((place, *[given[name] for name in
                                    ("title", "url", "published", "summary", "source", "tags", "image")]))
        frame = spark.createDataFrame(filled, "position int, " + ARTICLE)
        return frame.withColumns({"source_rank": F.lit(0), "payload_id": F.lit(0).cast("bigint")})

    return make
