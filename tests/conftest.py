import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# One work in two formats, of which one is collected, and another work.
ITEM_ROWS = [
    (1, "zlib3", "n17", "Salt Road Ferries", "Ada Quill", "Harbour & Lane", "en", "1988", "epub", 1100, "204",
     "Crossings of a grey estuary", "sum-ferries-1", "9780000000171", "", "", datetime(2023, 3, 9)),
    (2, "zlib3", "n23", "Copper Valley", "Tom_Verne", "Ridge House", "en", "1974", "pdf", 2300, "388",
     "Winters in a mining town", "sum-copper", "9780000000232", "", "", None),
    (3, "zlib3", "n31", "Salt Road Ferries", "Ada Quill", "Harbour & Lane", "en", "1988", "pdf", 3500, "204",
     "Crossings of a grey estuary", "sum-ferries-2", "9780000000171", "", "", None),
]
RATING_ROWS = [
    (1, "r5", "Salt Road Ferries", "Ada Quill", 3.9, 820, "An adventure on the water", "Travel,Memoir",
     "9780000000171", "204", "1988"),
    (2, "r8", "Quiet Ledger", "Nora Holt", 2.4, 12, "A clerk counts days", "Drama", "", "96", "2011"),
]


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame(
        ITEM_ROWS,
        """id LONG, source STRING, source_id STRING, title STRING, author STRING, publisher STRING,
        language STRING, year STRING, extension STRING, filesize LONG, pages STRING, description STRING,
        md5 STRING, isbn STRING, series STRING, edition STRING, downloaded_at TIMESTAMP""",
    )


@pytest.fixture(scope="session")
def ratings(spark):
    return spark.createDataFrame(
        RATING_ROWS,
        """id LONG, source_id STRING, title STRING, author STRING, rating FLOAT, ratings_count INT,
        description STRING, genres STRING, isbn STRING, pages STRING, year STRING""",
    )


@pytest.fixture(scope="session")
def item_postings(items):
    from shelfspark.operators.fulltext import build_index
    from shelfspark.schemas import ITEM_FIELDS
    from shelfspark.sources.storage import stage

    return stage(build_index(items, ITEM_FIELDS, "english"))


@pytest.fixture(scope="session")
def rating_postings(ratings):
    from shelfspark.operators.fulltext import build_index
    from shelfspark.schemas import RATING_FIELDS
    from shelfspark.sources.storage import stage

    return stage(build_index(ratings, RATING_FIELDS, "english"))
