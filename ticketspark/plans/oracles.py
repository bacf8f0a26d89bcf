"""The same queries as ANSI SQL for DuckDB, written independently of the Spark plans."""

from __future__ import annotations

from ticketspark import schemas as S
from ticketspark.functions.prompts import BATCH, SCENARIO
from ticketspark.functions.text import SPACE_RANGES
from ticketspark.operators.distribution import MIX_WORDING
from ticketspark.operators.taxonomy import issue_rows, product_rows


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _rows(rows) -> str:
    cells = lambda row: ", ".join(_text(v) if isinstance(v, str) else str(v) for v in row)
    return ", ".join(f"({cells(row)})" for row in rows)


LABEL_LIST = ", ".join(_text(x) for x in S.LABELS)
VOCABULARY = f"vocabulary(label_id, label) AS (VALUES {_rows(enumerate(S.LABELS))})"
_SPACE_CLASS = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SPACE_RANGES)
_SPACES = "concat(" + ", ".join(f"chr({c})" for a, b in SPACE_RANGES for c in range(a, b + 1)) + ")"


def _strip(column: str) -> str:
    return f"trim({column}, {_SPACES})"


def _words(column: str) -> str:
    return f"len(regexp_extract_all({column}, '[^{_SPACE_CLASS}]+'))"


TICKETS = """tickets AS (
    SELECT o_orderkey AS ticket_id, o_custkey AS user_id, o_orderpriority AS text, o_orderdate AS created_at,
           CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS resolved_at
    FROM orders)"""
LABELLED = f"""labelled AS (
    SELECT o_orderkey AS ticket_id,
           CASE WHEN lower(substr(o_orderpriority, 3)) IN ({LABEL_LIST}) THEN lower(substr(o_orderpriority, 3))
                ELSE 'unknown' END AS priority
    FROM orders)"""
PREDICTIONS = """predictions AS (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS prediction_id, l_orderkey AS ticket_id,
           CASE WHEN l_quantity < 13 THEN 'low' WHEN l_quantity < 26 THEN 'medium'
                WHEN l_quantity < 39 THEN 'high' ELSE 'urgent' END AS predicted_priority,
           1 - l_discount AS confidence, l_returnflag AS model_version, l_linestatus AS model_run_id,
           l_linenumber AS latency_ms, l_shipdate AS created_at
    FROM lineitem)"""
LATEST = """latest AS (
    SELECT * FROM predictions
    QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, prediction_id DESC) = 1)"""
RECORDS = """records AS (
    SELECT t.*, p.prediction_id, coalesce(p.predicted_priority, 'unknown') AS predicted_priority, p.confidence,
           p.model_version, p.model_run_id, p.latency_ms
    FROM tickets t LEFT JOIN latest p USING (ticket_id))"""
RANK = """CASE predicted_priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3
          ELSE 4 END"""
QUEUE = f"WITH {TICKETS}, {PREDICTIONS}, {LATEST}, {RECORDS}"
CHANGES = """changes AS (
    SELECT event_id AS change_id, o_orderkey AS ticket_id,
           CASE WHEN event_type = 'error' THEN o_custkey + 1 ELSE o_custkey END AS user_id,
           CASE WHEN event_type = 'signup' THEN 'reopen' ELSE 'resolve' END AS action, ts AS changed_at
    FROM events JOIN orders ON o_orderkey = event_id // 4)"""
DOC_PREDICTIONS = """doc_predictions AS (
    SELECT doc_id AS prediction_id, doc_id AS ticket_id,
           CASE WHEN n_chars < 500 THEN 'low' WHEN n_chars < 1500 THEN 'medium' WHEN n_chars < 5000 THEN 'high'
                ELSE 'urgent' END AS predicted_priority,
           n_chars / (n_chars + 1000) AS confidence
    FROM documents)"""
FEEDBACK = """feedback AS (
    SELECT doc_id AS prediction_id, CASE WHEN lang = 'en' THEN source ELSE 'guest' END AS user_id,
           CASE WHEN toxic = 1 THEN 'flagged' WHEN quality = 1 THEN 'thumbs_up' ELSE 'thumbs_down' END AS verdict
    FROM labels JOIN documents USING (doc_id))"""
TEXTS = """texts AS (
    SELECT 'd' || doc_id AS ticket_id, text AS ticket_text FROM documents
    UNION ALL
    SELECT concat_ws('-', 'c', conv_id, turn), text FROM conversations WHERE role = 'user')"""
MINUTES = """minutes AS (
    SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS count FROM events GROUP BY ALL)"""
DAYS = """days AS (
    SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS count
    FROM events GROUP BY ALL)"""
RUNS = f"""{PREDICTIONS}, {LABELLED}, runs AS (
    SELECT model_run_id AS display_name, 'Run.' || model_version AS run_id,
           'models/' || model_run_id || '/runs/Run.' || model_version || '/model/' AS artifact_uri,
           avg(CASE WHEN priority = predicted_priority THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
           avg(confidence) AS macro_f1, max(created_at) AS create_time
    FROM labelled JOIN predictions USING (ticket_id) GROUP BY ALL),
versions AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY display_name ORDER BY create_time, run_id) AS INTEGER) AS version,
           row_number() OVER (PARTITION BY display_name ORDER BY create_time DESC, run_id DESC) = 1 AS is_default
    FROM runs)"""
DAY_DECISIONS = """
    SELECT event_id, user_id, ts, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start,
           row_number() OVER w AS request_number, row_number() OVER w <= 3 AS allowed
    FROM events
    WINDOW w AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id)"""
GRID = f"""issues(i, issue_area, issue_category, issue_sub_category) AS (VALUES {_rows(issue_rows())}),
products(p, product_category, product_sub_category) AS (VALUES {_rows(product_rows())}),
sentiments(s, customer_sentiment) AS (VALUES {_rows(enumerate(S.SENTIMENTS))}),
complexities(c, issue_complexity) AS (VALUES {_rows(enumerate(S.COMPLEXITIES))}),
rules(customer_sentiment, issue_complexity, priority) AS (VALUES {_rows(S.PRIORITY_RULES)}),
product_of_all AS (
    SELECT row_number() OVER (ORDER BY i, p, s, c) - 1 AS cell, *
    FROM issues CROSS JOIN products CROSS JOIN sentiments CROSS JOIN complexities),
grid AS (
    SELECT o_orderkey AS ticket_id, issue_area, issue_category, issue_sub_category, customer_sentiment,
           issue_complexity, product_category, product_sub_category, priority
    FROM orders JOIN product_of_all ON cell = o_orderkey % 11340
    JOIN rules USING (customer_sentiment, issue_complexity))"""
EXISTING = f"""existing AS (
    SELECT conv_id AS ticket_id, arg_max(text, turn) AS ticket_text
    FROM conversations WHERE role = 'user' AND {_strip('text')} <> '' GROUP BY conv_id)"""
TODO = f"""{GRID}, {EXISTING}, todo AS (
    SELECT *, (row_number() OVER (ORDER BY ticket_id) - 1) // 5 + 1 AS batch_id,
           CAST((row_number() OVER (ORDER BY ticket_id) - 1) % 5 AS INTEGER) AS pos
    FROM grid ANTI JOIN existing USING (ticket_id))"""
REPLIES = f"""{TODO}, said AS (
    SELECT *, 'My ' || product_sub_category || ' left me ' || customer_sentiment || ' ' || chr(10) || '"really" '
              || ticket_id AS reply FROM todo),
sizes AS (SELECT batch_id, count(*) AS n_rows FROM todo GROUP BY batch_id)"""
HASHES = f"""{GRID}, hashed AS (
    SELECT ticket_id, priority, md5('42:' || ticket_id) AS hash, md5('42:step:' || ticket_id) AS step FROM grid)"""
NOISE = f"""{HASHES}, noisy AS (
    SELECT ticket_id, priority AS was,
           CASE WHEN row_number() OVER (ORDER BY hash) <= greatest(1, round_even(count(*) OVER () * 0.07::DOUBLE, 0))
                THEN [{LABEL_LIST}][greatest(1, least(4,
                    list_position([{LABEL_LIST}], priority) + CASE WHEN substr(step, 1, 1) < '8' THEN -1 ELSE 1 END))]
                ELSE priority END AS priority
    FROM hashed)"""
# Largest remainder twice: test off the whole, then val off the rest.
QUOTAS = f"""{VOCABULARY}, counts AS (
    SELECT label_id, label, count(*) AS n, sum(count(*)) OVER () AS total
    FROM hashed JOIN vocabulary ON label = priority GROUP BY label_id, label),
first_cut AS (SELECT *, total - ceil(total * 0.1::DOUBLE) AS draws, n::DOUBLE / total::DOUBLE * (total - ceil(total * 0.1::DOUBLE)) AS exact FROM counts),
rest AS (
    SELECT label_id, label, n, floor(exact) + CASE WHEN
        row_number() OVER (ORDER BY exact - floor(exact) DESC, label_id) <= draws - sum(floor(exact)) OVER ()
        THEN 1 ELSE 0 END AS rest_n FROM first_cut),
second_cut AS (
    SELECT *, sum(rest_n) OVER () AS rest_total, sum(rest_n) OVER () - ceil(sum(rest_n) OVER () * {0.1 / (0.8 + 0.1)!r}::DOUBLE) AS draws FROM rest),
third AS (SELECT *, rest_n / rest_total * draws AS exact FROM second_cut),
quotas AS (
    SELECT label AS priority, CAST(floor(exact) + CASE WHEN
        row_number() OVER (ORDER BY exact - floor(exact) DESC, label_id) <= draws - sum(floor(exact)) OVER ()
        THEN 1 ELSE 0 END AS BIGINT) AS train, CAST(rest_n AS BIGINT) AS rest_n, n FROM third)"""
SPLIT = f"""{HASHES}, {QUOTAS}, split AS (
    SELECT ticket_id, priority,
           CASE WHEN place <= n - rest_n THEN 'test' WHEN place <= n - train THEN 'val' ELSE 'train' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY hash) AS place FROM hashed) JOIN quotas USING (priority))"""
JUDGED = f"""{PREDICTIONS}, {LATEST}, {LABELLED}, judged AS (
    SELECT ticket_id, priority AS true_label, predicted_priority AS pred_label
    FROM labelled JOIN latest USING (ticket_id) WHERE priority <> 'unknown')"""


def _class_metrics(source: str) -> str:
    return f"""{VOCABULARY}, per_class AS (
    SELECT label, count(*) FILTER (true_label = label) AS support, count(*) FILTER (pred_label = label) AS predicted,
           count(*) FILTER (true_label = label AND pred_label = label) AS hits
    FROM vocabulary CROSS JOIN {source} GROUP BY label),
scored AS (
    SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
           coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1
    FROM per_class),
overall AS (
    SELECT sum(hits) / sum(support) AS accuracy, avg(f1) FILTER (support + predicted > 0) AS macro_f1 FROM scored)"""


_LOGITS = f"""scoring AS (
    SELECT doc_id, text, ln({_words('text')} + 1.0::DOUBLE) AS size,
           len(regexp_extract_all(text, '[!?]')) / ({_words('text')} + 1.0::DOUBLE) AS marks, {_strip('text')} = '' AS skipped
    FROM documents),
logits AS (
    SELECT doc_id, skipped, 4 - size AS low, 1.2 + 0.2 * size AS medium, 0.6 * size - 0.8 + 2 * marks AS high,
           size - 4 + 8 * marks AS urgent
    FROM scoring),
weights AS (
    SELECT doc_id, skipped, exp(low - top) AS low, exp(medium - top) AS medium, exp(high - top) AS high, exp(urgent - top) AS urgent
    FROM (SELECT *, greatest(low, medium, high, urgent) AS top FROM logits)),
shares AS (
    SELECT doc_id, skipped, low / total AS low, medium / total AS medium, high / total AS high, urgent / total AS urgent
    FROM (SELECT *, low + medium + high + urgent AS total FROM weights)),
scores AS (
    SELECT doc_id AS ticket_id, skipped,
           CASE WHEN skipped THEN NULL
                WHEN low = greatest(low, medium, high, urgent) THEN 'low'
                WHEN medium = greatest(low, medium, high, urgent) THEN 'medium'
                WHEN high = greatest(low, medium, high, urgent) THEN 'high' ELSE 'urgent' END AS predicted_priority,
           CASE WHEN NOT skipped THEN greatest(low, medium, high, urgent) END AS confidence, low, medium, high, urgent
    FROM shares)"""
_SCORE_ROWS = "SELECT ticket_id, skipped, predicted_priority, round(confidence, 6) AS confidence, " + ", ".join(
    f"round(CASE WHEN NOT skipped THEN {x} END, 6) AS score_{x}" for x in S.LABELS
) + " FROM scores"
_STORED_SCORES = """SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, predicted_priority, round(confidence, 6) AS confidence,
    '1' AS model_version, 'run-1' AS model_run_id, TIMESTAMP '2026-04-19 02:00:00' AS created_at FROM scores WHERE NOT skipped"""


def _reason(column: str) -> str:
    return f"""CASE WHEN {column} IS NULL THEN 'missing' WHEN length({column}) > 10000 THEN 'too_long'
               WHEN {_strip(column)} = '' THEN 'blank' END"""


def _filled(template: str, **values: str) -> str:
    """SQL expression for a prompt template."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [_text(head), values.get(name, name)]
    return " || ".join(parts + [_text(rest)])


_MIX = f"""{LABELLED}, targets(label, target) AS (VALUES {_rows(S.TARGET_MIX.items())}),
mix AS (
    SELECT label, count(ticket_id) AS n, count(ticket_id)::DOUBLE / (SELECT count(*) FROM labelled)::DOUBLE AS share, target::DOUBLE AS target
    FROM targets LEFT JOIN labelled ON priority = label GROUP BY label, target)"""

_UPLOADS = f"""kept AS (
    SELECT doc_id // 600 AS upload, {_strip('text')} AS text,
           row_number() OVER (PARTITION BY doc_id // 600 ORDER BY doc_id) AS position
    FROM documents WHERE length({_strip('text')}) >= 5)"""

_DEDUP = f"""SELECT doc_id AS ticket_id, source AS user_id, text AS ticket_text FROM documents
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""

_COUNTED = f"""flagged AS (
    SELECT {_strip('text')} = '' AS blank, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS copy,
           {_words('text')} < 10 AS short
    FROM documents)"""

ORACLES: dict[str, str] = {
    "triage_queue": f"""{QUEUE}
        SELECT ticket_id, user_id, created_at, prediction_id, predicted_priority, confidence, model_version,
               model_run_id, latency_ms
        FROM records WHERE resolved_at IS NULL ORDER BY {RANK}, created_at DESC, ticket_id LIMIT 500""",
    "triage_queue_user": f"""{QUEUE}
        SELECT user_id, CAST(row_number() OVER w AS INTEGER) AS position, ticket_id, prediction_id, predicted_priority, created_at
        FROM records WHERE resolved_at IS NULL
        WINDOW w AS (PARTITION BY user_id ORDER BY {RANK}, created_at DESC, ticket_id)
        QUALIFY row_number() OVER w <= 5""",
    "ticket_lookup": f"""{QUEUE}, asked AS (
            SELECT o_orderkey AS ticket_id, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_custkey + 1 END AS user_id
            FROM orders)
        SELECT a.ticket_id, a.user_id, r.ticket_id IS NOT NULL AS found, prediction_id, predicted_priority, confidence, resolved_at
        FROM asked a LEFT JOIN records r ON r.ticket_id = a.ticket_id AND r.user_id = a.user_id""",
    "user_history": f"WITH {TICKETS} SELECT user_id, ticket_id, resolved_at, created_at FROM tickets",
    "latest_prediction": f"WITH {PREDICTIONS}, {LATEST} SELECT * FROM latest",
    "pending_split": f"""{QUEUE}
        SELECT ticket_id, predicted_priority, CASE WHEN prediction_id IS NULL THEN 'pending' ELSE 'classified' END AS state
        FROM records""",
    "queue_counts": f"""{QUEUE}
        SELECT count(*) AS total, count(prediction_id) AS classified, count(*) - count(prediction_id) AS pending FROM records""",
    "status_counts_by_user": f"""WITH {TICKETS}
        SELECT user_id, count(*) FILTER (resolved_at IS NULL) AS open_tickets, count(resolved_at) AS resolved_tickets
        FROM tickets GROUP BY user_id""",
    "resolve_apply": f"""WITH {TICKETS}, {CHANGES}, last AS (
            SELECT c.* FROM changes c JOIN tickets t ON t.ticket_id = c.ticket_id AND t.user_id = c.user_id
            QUALIFY row_number() OVER (PARTITION BY c.ticket_id ORDER BY changed_at DESC, change_id DESC) = 1)
        SELECT ticket_id, t.user_id, CASE WHEN action = 'resolve' THEN changed_at WHEN action = 'reopen' THEN NULL
               ELSE resolved_at END AS resolved_at
        FROM tickets t LEFT JOIN last USING (ticket_id)""",
    "resolve_rejects": f"""WITH {TICKETS}, {CHANGES}
        SELECT c.* FROM changes c WHERE NOT EXISTS (
            SELECT 1 FROM tickets t WHERE t.ticket_id = c.ticket_id AND t.user_id = c.user_id)""",
    "purge_user_preview": f"""WITH {TICKETS}, {PREDICTIONS}, {DAYS}, gone AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < 0),
        left_tickets AS (SELECT * FROM tickets WHERE user_id NOT IN (SELECT user_id FROM gone)),
        left_predictions AS (
            SELECT * FROM predictions WHERE ticket_id NOT IN (
                SELECT ticket_id FROM tickets WHERE user_id IN (SELECT user_id FROM gone)))
        SELECT 'tickets' AS table_name, 'before' AS step, count(*) AS n FROM tickets
        UNION ALL SELECT 'predictions', 'before', count(*) FROM predictions
        UNION ALL SELECT 'feedback', 'before', count(*) FROM predictions
        UNION ALL SELECT 'rate_limit_counters', 'before', count(*) FROM days
        UNION ALL SELECT 'tickets', 'after', count(*) FROM left_tickets
        UNION ALL SELECT 'predictions', 'after', count(*) FROM left_predictions
        UNION ALL SELECT 'feedback', 'after', count(*) FROM left_predictions
        UNION ALL SELECT 'rate_limit_counters', 'after', count(*) FROM days WHERE user_id NOT IN (SELECT user_id FROM gone)""",
    "unscored_default": f"""WITH {TICKETS}, {PREDICTIONS}
        SELECT t.ticket_id, t.text AS ticket_text
        FROM tickets t LEFT JOIN predictions p ON p.ticket_id = t.ticket_id AND p.model_version = 'N'
        WHERE p.ticket_id IS NULL""",
    "unscored_since": f"""WITH {TICKETS}, {PREDICTIONS}
        SELECT t.ticket_id, t.text AS ticket_text
        FROM tickets t LEFT JOIN predictions p ON p.ticket_id = t.ticket_id AND p.model_version = 'N'
        WHERE p.ticket_id IS NULL AND t.created_at >= TIMESTAMP '1998-01-01'""",
    "rescore_ids": f"""WITH {TICKETS}
        SELECT ticket_id, text AS ticket_text FROM tickets WHERE ticket_id IN (SELECT doc_id FROM labels)""",
    "model_versions": f"""WITH {RUNS}
        SELECT display_name, version, run_id, artifact_uri, 'run_id=' || run_id || ' | data_version=v1 | accuracy='
               || printf('%.4f', accuracy) || ' | macro_f1=' || printf('%.4f', macro_f1) AS description, is_default, create_time,
               lower(replace(run_id, '.', '-')) AS run_id_label, 'v1' AS data_version_label,
               replace(printf('%.4f', accuracy), '.', '-') AS accuracy_label,
               replace(printf('%.4f', macro_f1), '.', '-') AS macro_f1_label
        FROM versions""",
    "promote_version": f"""WITH {RUNS}
        SELECT display_name, run_id = 'Run.R' AS is_default, run_id, CAST(row_number() OVER (
            PARTITION BY display_name ORDER BY run_id = 'Run.R', create_time, run_id) AS INTEGER) AS version
        FROM versions""",
    "resolve_version": f"""WITH {RUNS}
        SELECT * FROM (SELECT 'default' AS how, display_name, version, run_id AS model_run_id FROM versions
            ORDER BY is_default DESC, create_time DESC, version DESC, display_name LIMIT 1)
        UNION ALL SELECT 'pinned', display_name, version, run_id FROM versions WHERE display_name = 'O' AND version = 1""",
    "request_windows": f"WITH {MINUTES} SELECT * FROM minutes",
    "request_decisions": DAY_DECISIONS,
    "request_decisions_hot": DAY_DECISIONS,
    "limit_breaches": f"WITH {DAYS} SELECT * FROM days WHERE count > 3 ORDER BY count DESC, user_id, window_start LIMIT 20",
    "counter_sweep": f"""WITH {MINUTES} SELECT * FROM minutes
        WHERE window_start >= (SELECT max(window_start) FROM minutes) - INTERVAL 7 DAY""",
    "feedback_checked": f"""WITH {FEEDBACK}, {DOC_PREDICTIONS}
        SELECT f.prediction_id, f.user_id, f.verdict,
               CASE WHEN f.verdict NOT IN ('thumbs_up', 'thumbs_down') THEN 'bad_verdict'
                    WHEN NOT EXISTS (
                        SELECT 1 FROM doc_predictions p JOIN documents d ON d.doc_id = p.ticket_id
                        WHERE p.prediction_id = f.prediction_id AND d.source = f.user_id) THEN 'unknown_prediction' END AS reason
        FROM feedback f""",
    "feedback_enriched": f"""WITH {FEEDBACK}, {DOC_PREDICTIONS}
        SELECT f.*, p.ticket_id, p.predicted_priority, round(p.confidence, 6) AS confidence
        FROM feedback f LEFT JOIN doc_predictions p USING (prediction_id)""",
    "contract_report": f"""WITH {TICKETS}, {PREDICTIONS}, {FEEDBACK}, {MINUTES}
        SELECT 'tickets' AS table_name, 'not_null(ticket_id)' AS rule, count(*) FILTER (ticket_id IS NULL) AS violations FROM tickets
        UNION ALL SELECT 'tickets', 'not_null(text)', count(*) FILTER (text IS NULL) FROM tickets
        UNION ALL SELECT 'tickets', 'not_null(source)', 0 FROM (SELECT 1)
        UNION ALL SELECT 'tickets', 'not_null(user_id)', count(*) FILTER (user_id IS NULL) FROM tickets
        UNION ALL SELECT 'tickets', 'not_null(created_at)', count(*) FILTER (created_at IS NULL) FROM tickets
        UNION ALL SELECT 'tickets', 'unique(ticket_id)', count(*) - count(DISTINCT ticket_id) FROM tickets
        UNION ALL SELECT 'predictions', 'not_null(prediction_id)', count(*) FILTER (prediction_id IS NULL) FROM predictions
        UNION ALL SELECT 'predictions', 'not_null(ticket_id)', count(*) FILTER (ticket_id IS NULL) FROM predictions
        UNION ALL SELECT 'predictions', 'not_null(predicted_priority)', count(*) FILTER (predicted_priority IS NULL) FROM predictions
        UNION ALL SELECT 'predictions', 'not_null(confidence)', count(*) FILTER (confidence IS NULL) FROM predictions
        UNION ALL SELECT 'predictions', 'not_null(model_version)', count(*) FILTER (model_version IS NULL) FROM predictions
        UNION ALL SELECT 'predictions', 'not_null(created_at)', count(*) FILTER (created_at IS NULL) FROM predictions
        UNION ALL SELECT 'predictions', 'unique(prediction_id)', count(*) - count(DISTINCT prediction_id) FROM predictions
        UNION ALL SELECT 'predictions', 'reference(ticket_id->tickets)', count(*) FROM predictions
            WHERE ticket_id NOT IN (SELECT ticket_id FROM tickets)
        UNION ALL SELECT 'feedback', 'not_null(prediction_id)', count(*) FILTER (prediction_id IS NULL) FROM feedback
        UNION ALL SELECT 'feedback', 'not_null(verdict)', count(*) FILTER (verdict IS NULL) FROM feedback
        UNION ALL SELECT 'feedback', 'domain(verdict)', count(*) FILTER (verdict NOT IN ('thumbs_up', 'thumbs_down')) FROM feedback
        UNION ALL SELECT 'feedback', 'reference(prediction_id->predictions)', count(*) FROM feedback
            WHERE CAST(prediction_id AS VARCHAR) NOT IN (SELECT prediction_id FROM predictions)
        UNION ALL SELECT 'rate_limit_counters', 'not_null(user_id)', count(*) FILTER (user_id IS NULL) FROM minutes
        UNION ALL SELECT 'rate_limit_counters', 'not_null(window_start)', count(*) FILTER (window_start IS NULL) FROM minutes
        UNION ALL SELECT 'rate_limit_counters', 'not_null(count)', count(*) FILTER (count IS NULL) FROM minutes
        UNION ALL SELECT 'rate_limit_counters', 'unique(user_id,window_start)', count(*) - count(DISTINCT (user_id, window_start)) FROM minutes""",
    "label_domain": f"""SELECT DISTINCT {_strip('lower(substr(o_orderpriority, 3))')} AS label FROM orders
        WHERE {_strip('lower(substr(o_orderpriority, 3))')} NOT IN ({LABEL_LIST})""",
    "clean_texts": f"""WITH firsts AS ({_DEDUP})
        SELECT ticket_id, ticket_text FROM firsts WHERE {_strip('ticket_text')} <> '' AND {_words('ticket_text')} >= 10""",
    "dedup_texts": f"WITH firsts AS ({_DEDUP}) SELECT ticket_id, user_id FROM firsts",
    "clean_counters": f"""WITH {_COUNTED}
        SELECT count(*) AS seen, count(*) FILTER (blank) AS dropped_blank, count(*) FILTER (NOT blank AND copy) AS dropped_duplicate,
               count(*) FILTER (NOT blank AND NOT copy AND short) AS dropped_short,
               count(*) FILTER (blank OR copy OR short) AS dropped_total,
               count(*) FILTER (NOT blank AND NOT copy AND NOT short) AS kept
        FROM flagged""",
    "word_counts": f"""SELECT doc_id AS ticket_id, CAST({_words('text')} AS INTEGER) AS words,
        CAST(length({_strip('text')}) AS INTEGER) AS stripped_chars, {_words('text')} >= 10 AS long_enough FROM documents""",
    "text_validity": f"""WITH {TEXTS}
        SELECT ticket_id, {_reason('ticket_text')} AS reason, length({_strip('ticket_text')}) >= 5 AS uploadable,
               {_strip('ticket_text')} = '' AS blank
        FROM texts""",
    "text_preview": f"""WITH {TEXTS}
        SELECT ticket_id, substr(ticket_text, 1, 100) AS input_preview, CAST(length(ticket_text) AS INTEGER) AS input_length_chars,
               CASE WHEN length(ticket_text) > 200 THEN {_strip('substr(ticket_text, 1, 200)')} || '...' ELSE ticket_text END AS display_text
        FROM texts""",
    "scalar_labels": f"""WITH {PREDICTIONS}, {VOCABULARY}
        SELECT prediction_id, 3 - label_id AS queue_rank, label_id, label,
               [{LABEL_LIST}][least(label_id + 1, 3) + 1] AS raised, [{LABEL_LIST}][greatest(label_id - 1, 0) + 1] AS lowered,
               CAST(floor(confidence * 100 + 0.5::DOUBLE) AS BIGINT) || '%' AS percent
        FROM predictions JOIN vocabulary ON label = predicted_priority""",
    "scalar_ids": """SELECT event_id, date_trunc('minute', ts) AS minute, 'pred-' || strftime(ts, '%Y%m%d-%H%M%S') AS run_id,
        strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, sha256(event_id || chr(31) || user_id) AS row_id FROM events""",
    "scalar_paths": r"""SELECT page_id, substr(regexp_replace(lower(url), '[^\p{L}\p{N}_-]', '-', 'g'), 1, 63) AS label,
        list_extract(string_split(rtrim(url, '/') , '/'), -1) AS last_part, list_extract(string_split(url, '/'), -1) AS run_id FROM pages""",
    "scalar_lists": f"""SELECT conv_id AS ticket_id, turn AS position, array_to_string(list_filter(
        list_transform(string_split(text, ','), lambda x: {_strip('x')}), lambda x: x <> ''), '|') AS parts
        FROM conversations WHERE role = 'user'""",
    "scalar_scores": f"""WITH {PREDICTIONS}, logits AS (
            SELECT prediction_id, confidence AS low, confidence * confidence AS medium, 1 - confidence AS high, latency_ms / 7 AS urgent
            FROM predictions),
        weights AS (
            SELECT prediction_id, exp(low - top) AS low, exp(medium - top) AS medium, exp(high - top) AS high, exp(urgent - top) AS urgent
            FROM (SELECT *, greatest(low, medium, high, urgent) AS top FROM logits)),
        shares AS (
            SELECT prediction_id, low / total AS low, medium / total AS medium, high / total AS high, urgent / total AS urgent
            FROM (SELECT *, low + medium + high + urgent AS total FROM weights))
        SELECT prediction_id, CASE greatest(low, medium, high, urgent) WHEN low THEN 'low' WHEN medium THEN 'medium'
                   WHEN high THEN 'high' ELSE 'urgent' END AS label, round(greatest(low, medium, high, urgent), 6) AS confidence,
               {", ".join(f"round({x}, 6) AS score_{x}" for x in S.LABELS)}
        FROM shares""",
    "label_distribution": f"""WITH {LABELLED}, {VOCABULARY}
        SELECT coalesce(label, priority) AS label, count(ticket_id) AS n
        FROM vocabulary FULL JOIN labelled ON priority = label GROUP BY 1""",
    "distribution_check": f"""WITH {_MIX}
        SELECT label, n, round(share, 6) AS share, target, abs(share - target) > 0.05 AS off_target,
               CASE WHEN abs(share - target) > 0.05 THEN round(share - target, 6) END AS signed_diff FROM mix""",
    "distribution_warnings": f"""WITH {_MIX}
        SELECT printf({_text(MIX_WORDING)}, label, share * 100, target * 100, abs(share - target) * 100, 5.0) AS warning
        FROM mix WHERE abs(share - target) > 0.05""",
    "rule_lookup": f"""WITH {GRID} SELECT customer_sentiment, issue_complexity, priority, count(*) AS n FROM grid GROUP BY ALL""",
    "grid_labels": f"WITH {GRID} SELECT * FROM grid",
    "noise_labels": f"WITH {NOISE} SELECT * FROM noisy",
    "noise_counts": f"WITH {NOISE} SELECT was, priority, count(*) AS n FROM noisy GROUP BY ALL",
    "split_rows": f"WITH {SPLIT} SELECT * FROM split",
    "split_counts": f"WITH {SPLIT} SELECT split, count(*) AS n FROM split GROUP BY split",
    "split_quotas": f"WITH {HASHES}, {QUOTAS} SELECT priority, train, rest_n - train AS val, n - rest_n AS test FROM quotas",
    "first_rows": f"WITH {GRID} SELECT ticket_id, priority FROM grid ORDER BY ticket_id LIMIT 1000",
    "confusion": f"""WITH {JUDGED}, {VOCABULARY}
        SELECT t.label AS true_label, p.label AS pred_label, count(ticket_id) AS n
        FROM vocabulary t CROSS JOIN vocabulary p
        LEFT JOIN judged ON true_label = t.label AND pred_label = p.label GROUP BY ALL""",
    "metrics": f"""WITH {JUDGED}, {_class_metrics('judged')}
        SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, predicted, hits
        FROM scored""",
    "metrics_flat": f"""WITH {JUDGED}, {_class_metrics('judged')}
        SELECT 'accuracy' AS metric, round(accuracy, 6) AS value FROM overall
        UNION ALL SELECT 'macro_f1', round(macro_f1, 6) FROM overall
        UNION ALL SELECT 'precision_' || label, round(precision, 6) FROM scored
        UNION ALL SELECT 'recall_' || label, round(recall, 6) FROM scored
        UNION ALL SELECT 'f1_' || label, round(f1, 6) FROM scored""",
    "metric_callback": f"""WITH {PREDICTIONS}, {LABELLED}, said AS (
            SELECT priority AS true_label, confidence AS a, 2 * confidence - 1 AS b, 0.9::DOUBLE AS c, latency_ms / 7 AS d
            FROM predictions JOIN labelled USING (ticket_id) WHERE priority <> 'unknown'),
        guessed AS (
            SELECT true_label, CASE greatest(a, b, c, d) WHEN a THEN 'low' WHEN b THEN 'medium' WHEN c THEN 'high' ELSE 'urgent' END AS pred_label
            FROM said), {_class_metrics('guessed')}
        SELECT 'accuracy' AS metric, round(accuracy, 6) AS value FROM overall
        UNION ALL SELECT 'macro_f1', round(macro_f1, 6) FROM overall
        UNION ALL SELECT 'f1_' || label, round(f1, 6) FROM scored""",
    "error_sample": f"""WITH {JUDGED}
        SELECT * FROM judged WHERE true_label <> pred_label ORDER BY md5('42:' || ticket_id), ticket_id LIMIT 20""",
    "eval_artifacts": f"""WITH {JUDGED}, {_class_metrics('judged')}
        SELECT 'accuracy' AS metric, round(accuracy, 6) AS value FROM overall
        UNION ALL SELECT 'macro_f1', round(macro_f1, 6) FROM overall
        UNION ALL SELECT 'precision_' || label, round(precision, 6) FROM scored
        UNION ALL SELECT 'recall_' || label, round(recall, 6) FROM scored
        UNION ALL SELECT 'f1_' || label, round(f1, 6) FROM scored""",
    "score_batch": f"WITH {_LOGITS} {_SCORE_ROWS}",
    "score_batch_python": f"WITH {_LOGITS} {_SCORE_ROWS}",
    "run_summary": f"""WITH {_LOGITS}
        SELECT count(*) AS row_count, count(*) FILTER (NOT skipped) AS row_count_scored, count(*) FILTER (skipped) AS row_count_skipped,
               round(coalesce(avg(confidence), 0), 6) AS avg_confidence,
               {", ".join(f"count(*) FILTER (predicted_priority = '{x}') AS n_{x}" for x in S.LABELS)}
        FROM scores""",
    "scoring_job": f"WITH {_LOGITS} {_STORED_SCORES}",
    "baseline_model": r"""WITH tokens AS (
            SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents)
        SELECT term, count(DISTINCT doc_id) AS df,
               round(ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(DISTINCT doc_id))::DOUBLE) + 1, 6) AS idf,
               (SELECT count(*) FROM documents) AS n_rows, true AS lower_loss, true AS better_than_constant
        FROM tokens GROUP BY term""",
    "tfidf_terms": r"""WITH tokens AS (
            SELECT doc_id AS ticket_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
        counts AS (SELECT ticket_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
        terms AS (
            SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(*))::DOUBLE) + 1 AS idf
            FROM counts GROUP BY term),
        weighted AS (SELECT *, tf * idf AS raw FROM counts JOIN terms USING (term)),
        norms AS (SELECT ticket_id, sqrt(sum(raw * raw)) AS norm FROM weighted GROUP BY ticket_id)
        SELECT ticket_id, term, tf, df, round(idf, 6) AS idf, round(raw / norm, 6) AS weight
        FROM weighted JOIN norms USING (ticket_id)""",
    "existing_texts": f"WITH {EXISTING} SELECT * FROM existing",
    "generation_todo": f"WITH {TODO} SELECT ticket_id, batch_id, pos FROM todo",
    "prompt_batches": f"""WITH {TODO}, numbered AS (
            SELECT batch_id, pos, (pos + 1) || '. ' || {_filled(SCENARIO)} AS scenario FROM todo),
        joined AS (
            SELECT batch_id, CAST(count(*) AS INTEGER) AS n_rows, string_agg(scenario, chr(10) ORDER BY pos) AS scenarios
            FROM numbered GROUP BY batch_id)
        SELECT batch_id, n_rows, {_filled(BATCH, n='n_rows', numbered_scenarios='scenarios')} AS prompt FROM joined""",
    "reply_parse": f"""WITH {REPLIES}
        SELECT batch_id, attempt, CAST(CASE
                   WHEN batch_id % 4 = 0 THEN n_rows
                   WHEN batch_id % 4 = 1 THEN CASE attempt WHEN 1 THEN n_rows - 1 ELSE n_rows END
                   WHEN batch_id % 4 = 2 THEN CASE attempt WHEN 3 THEN n_rows END
                   ELSE CASE attempt WHEN 3 THEN n_rows - 1 END END AS INTEGER) AS n_strings
        FROM sizes JOIN (VALUES (1), (2), (3)) a(attempt)
          ON attempt <= CASE batch_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END""",
    "reply_accept": f"""WITH {REPLIES}
        SELECT batch_id, CAST(batch_id % 4 + 1 AS INTEGER) AS attempt FROM sizes WHERE batch_id % 4 < 3""",
    "reply_merge": f"""WITH {REPLIES}
        SELECT ticket_id, batch_id, pos, CASE WHEN batch_id % 4 < 3 THEN reply END AS ticket_text FROM said""",
    "generation_summary": f"""WITH {REPLIES}, filled AS (
            SELECT ticket_id FROM existing WHERE ticket_id IN (SELECT ticket_id FROM grid)
            UNION ALL SELECT ticket_id FROM said WHERE batch_id % 4 < 3)
        SELECT total, filled, total - filled AS missing, round(filled / total, 6) AS share
        FROM (SELECT (SELECT count(*) FROM grid) AS total, (SELECT count(*) FROM filled) AS filled)""",
    "event_log_render": f"""WITH {PREDICTIONS}
        SELECT '{{"severity":"INFO","event":"prediction","run_id":null,"model_version":"' || model_version || '","model_run_id":"' || model_run_id
               || '","ticket_id":' || ticket_id || ',"input_preview":"' || o_orderpriority || '","input_length_chars":' || length(o_orderpriority)
               || ',"predicted_priority":"' || predicted_priority || '","confidence":' || confidence
               || ',"latency_ms":' || latency_ms || '}}' AS value
        FROM predictions JOIN orders ON o_orderkey = ticket_id""",
    "event_log_filter": """SELECT ts, event_id, 'ERROR' AS severity, 'model_endpoint_error' AS event, props ->> '$.k' AS message
        FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50""",
    "csv_ingest": f"""WITH {_UPLOADS}
        SELECT upload, CAST(position AS INTEGER) AS position, sha256(text) AS text_hash, CAST(length(text) AS INTEGER) AS chars
        FROM kept WHERE position <= 500""",
    "csv_cap": f"""WITH {_UPLOADS}
        SELECT upload, least(count(*), 500) AS accepted, greatest(count(*) - 500, 0) AS skipped FROM kept GROUP BY upload""",
    "scoring_events": f"""WITH {_LOGITS}
        SELECT 'INFO' AS severity, 'prediction' AS event, 'events' AS run_id, ticket_id, CAST(length(text) AS BIGINT) AS input_length_chars,
               predicted_priority, round(confidence, 6) AS confidence, sha256(left(text, 100)) AS preview_hash
        FROM scores JOIN documents ON doc_id = ticket_id WHERE NOT skipped""",
    "scoring_modes": """
        SELECT 'dry-run' AS selection_mode, count(*) AS row_count, count(*) AS row_count_scored, 0 AS stored FROM orders
        UNION ALL SELECT 'since', count(*), count(*), count(*) FROM orders WHERE o_orderdate >= DATE '1998-01-01'
        UNION ALL SELECT 'explicit-ids', count(*), count(*), count(*) FROM orders WHERE o_orderkey IN (SELECT doc_id FROM labels)""",
    "paste_tickets": f"""WITH {_LOGITS}
        SELECT sha256(text) AS text_hash, 'paste' AS source, 'u1' AS user_id, predicted_priority, round(confidence, 6) AS confidence,
               7 AS latency_ms, TIMESTAMP '2026-04-19 02:00:00' AS created_at
        FROM scores JOIN documents ON doc_id = ticket_id WHERE NOT skipped""",
    "feedback_stored": f"""WITH {FEEDBACK}
        SELECT CAST(prediction_id AS VARCHAR) AS prediction_id, verdict, user_id AS note, 1 AS rows_of_id,
               TIMESTAMP '2026-04-19 02:00:00' AS created_at FROM feedback""",
    "upload_tickets": f"""WITH {_UPLOADS}
        SELECT CAST(upload AS VARCHAR) AS user_id, 'csv' AS source, count(*) AS n_tickets, count(*) AS n_ids, CAST(sum(length(text)) AS BIGINT) AS chars,
               0 AS n_resolved
        FROM kept WHERE position <= 500 GROUP BY upload""",
    "dataset_cap": f"WITH {GRID} SELECT ticket_id, priority FROM grid ORDER BY ticket_id LIMIT 1000",
    "dataset_roundtrip": f"WITH {GRID} SELECT ticket_id, issue_sub_category AS ticket_text, priority FROM grid",
    "stream_request_windows": f"""WITH {MINUTES} SELECT * FROM minutes
        WHERE window_start + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE""",
    "stream_request_decisions": DAY_DECISIONS,
    "stream_pending_scoring": f"WITH {_LOGITS} {_STORED_SCORES}",
}
ORACLES["saved_texts"] = ORACLES["existing_texts"]
ORACLES["newest_maintained"] = ORACLES["latest_prediction"]
ORACLES["triage_queue_maintained"] = ORACLES["triage_queue"]
ORACLES["scored_index"] = ORACLES["unscored_default"]
ORACLES["event_store_newest"] = ORACLES["event_log_filter"]
ORACLES["purge_stored"] = f"SELECT table_name, n FROM ({ORACLES['purge_user_preview']}) WHERE step = 'after'"
