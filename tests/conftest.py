import os
import sys
from datetime import datetime, timedelta

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from ticketspark.session import build_session, shared_dir  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
T0 = datetime(2026, 4, 20, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    shared_dir(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def minutes(n):
    return T0 + timedelta(minutes=n)


@pytest.fixture
def make_tickets(spark):
    """rows of (ticket_id, user_id, created_at, resolved_at)"""

    def make(rows):
        df = spark.createDataFrame(rows, "ticket_id string, user_id string, created_at timestamp, resolved_at timestamp")
        return df.select("ticket_id", F.concat(F.lit("text of "), "ticket_id").alias("text"), F.lit("paste").alias("source"),
                         "user_id", "created_at", "resolved_at")

    return make


@pytest.fixture
def make_predictions(spark):
    """rows of (prediction_id, ticket_id, predicted_priority, created_at, model_version)"""

    def make(rows):
        schema = "prediction_id string, ticket_id string, predicted_priority string, created_at timestamp, model_version string"
        df = spark.createDataFrame(rows, schema)
        scores = F.create_map(*[F.lit(x) for x in ("low", 0.05, "medium", 0.77, "high", 0.15, "urgent", 0.03)])
        return df.withColumns({
            "confidence": F.lit(0.77), "all_scores": scores, "model_run_id": F.lit("run"), "latency_ms": F.lit(None).cast("int"),
        })

    return make


def column(df, name):
    return [row[name] for row in df.select(name).collect()]


def nulls_first(row):
    return [(value is not None, value) for value in row]


def pairs(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=nulls_first)
