"""Table schemas, vocabularies and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- Fixed values: these must stay as they are for results to agree. ---------------------------

# Ordinal label vocabulary; the position is the label id.
LABELS = ["low", "medium", "high", "urgent"]
# Queue order, most pressing first.
QUEUE_ORDER = ["urgent", "high", "medium", "low"]
UNKNOWN_LABEL = "unknown"

SENTIMENTS = ["neutral", "negative", "frustrated"]
COMPLEXITIES = ["less", "medium", "high"]
# (sentiment, complexity, priority)
PRIORITY_RULES = [
    ("neutral", "less", "low"),
    ("neutral", "medium", "medium"),
    ("neutral", "high", "medium"),
    ("negative", "less", "medium"),
    ("negative", "medium", "high"),
    ("negative", "high", "high"),
    ("frustrated", "less", "high"),
    ("frustrated", "medium", "high"),
    ("frustrated", "high", "urgent"),
]

VERDICTS = ["thumbs_up", "thumbs_down"]

TARGET_MIX = {"low": 0.20, "medium": 0.35, "high": 0.30, "urgent": 0.15}
MIX_TOLERANCE = 0.05

MIN_WORDS = 10
MIN_UPLOAD_CHARS = 5
MAX_TEXT_CHARS = 10_000
LOG_PREVIEW_CHARS = 100
LIST_PREVIEW_CHARS = 200
UPLOAD_CAP = 500
UPLOAD_COLUMNS = ["text", "message", "description", "ticket", "ticket_text"]
REQUESTS_PER_MINUTE = 50
QUEUE_LIMIT_DEFAULT = 50
QUEUE_LIMIT_MAX = 500
TOP_BREACHES = 20
ERROR_SAMPLE = 20
NOISE_RATE = 0.07
SEED = 42
SPLIT_SIZES = (0.8, 0.1, 0.1)
PROMPT_BATCH = 5
REPLY_ATTEMPTS = 3
SCORING_BATCH = 32

LOG_EVENTS = [
    "ticket_created",
    "feedback_recorded",
    "ticket_resolved",
    "ticket_unresolved",
    "model_endpoint_error",
    "prediction",
    "batch_run_summary",
    "online_prediction",
    "batch_predict.error",
    "csv_upload",
]

# Literals that a dataset CSV reader takes as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- Table schemas -------------------------------------------------------------------------------

SCORES = T.MapType(T.StringType(), T.DoubleType())

TICKETS = T.StructType([
    T.StructField("ticket_id", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("resolved_at", T.TimestampType(), True),
])

PREDICTIONS = T.StructType([
    T.StructField("prediction_id", T.StringType(), False),
    T.StructField("ticket_id", T.StringType(), False),
    T.StructField("predicted_priority", T.StringType(), False),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("all_scores", SCORES, False),
    T.StructField("model_version", T.StringType(), False),
    T.StructField("model_run_id", T.StringType(), True),
    T.StructField("latency_ms", T.IntegerType(), True),
    T.StructField("created_at", T.TimestampType(), False),
])

FEEDBACK = T.StructType([
    T.StructField("feedback_id", T.StringType(), False),
    T.StructField("prediction_id", T.StringType(), False),
    T.StructField("verdict", T.StringType(), False),
    T.StructField("note", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), False),
])

GRID_COLUMNS = [
    "ticket_id", "issue_area", "issue_category", "issue_sub_category", "customer_sentiment",
    "issue_complexity", "product_category", "product_sub_category", "priority",
]


def vocabulary(spark: SparkSession) -> DataFrame:
    """The four labels with their ids; a fixed four-row table."""
    return spark.createDataFrame(list(enumerate(LABELS)), "label_id int, label string")


def rule_table(spark: SparkSession) -> DataFrame:
    """The nine (sentiment, complexity) rules."""
    return spark.createDataFrame(
        PRIORITY_RULES, "customer_sentiment string, issue_complexity string, priority string"
    )
