"""Comparison, evaluation metrics, log jobs and evaluation files over tables Spark derives from the inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import bulk_compare, compare, evaluation, logs
from tallyfold.plans.registry import query
from tallyfold.session import fresh_path
from tallyfold.sources import items as files
from tallyfold.sources.mapped import TABLES

# Two versions of one result: the prediction has noise within the tolerance and padded text.

def gold_orders(t):
    return t.base("orders").select(F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))


def noisy_orders(t, wrong: str = "0"):
    return t.base("orders").select(
        F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit("  ")).alias("STATUS"),
        F.expr(f"o_totalprice + 0.004d * (o_orderkey % 3 - 1) + {wrong}").alias("Total"),
    )


def _positional_sql(rule: str, pred: str, gold_order: str, pred_order: str) -> str:
    return f"""WITH gold AS (SELECT row_number() OVER (ORDER BY {gold_order}) - 1 AS pos, total, status FROM
                     (SELECT o_orderkey AS id, o_totalprice AS total, o_orderstatus AS status FROM orders) g),
             pred AS (SELECT row_number() OVER (ORDER BY {pred_order}) - 1 AS pos, total, status FROM
                     (SELECT o_orderkey AS id, {pred} AS total, o_orderstatus AS status FROM orders) p),
             faced AS (SELECT gold.pos AS pos, gold.status = pred.status AND
                         abs(gold.total - pred.total) <= greatest(0.011, abs(pred.total) * 1e-6) AS agree
                       FROM gold JOIN pred ON gold.pos = pred.pos)
        SELECT count(CASE WHEN NOT agree THEN 1 END) = 0 AS equal, '{rule}' AS rule,
               min(CASE WHEN NOT agree THEN pos END) AS first_mismatch FROM faced"""


_NOISE_SQL = "o_totalprice + CAST(0.004 AS DOUBLE) * (o_orderkey % 3 - 1)"
_CELL_ORDER = "round(total, 4), status, total"


@query("cmp_rowcount",
       """SELECT (SELECT count(*) FROM r_orders) AS gold_rows, (SELECT count(*) FROM orders) AS pred_rows,
                 (SELECT count(*) FROM r_orders) = (SELECT count(*) FROM orders) AS equal""")
def cmp_rowcount(t):
    return compare.row_counts(t.table("orders"), t.base("orders"))


@query("cmp_normalize",
       """SELECT CAST(id AS DOUBLE) AS id, trim(city) AS city, CAST(vip_level AS DOUBLE) AS vip_level,
                 username FROM r_users""")
def cmp_normalize(t):
    padded = t.table("users").select("id", F.concat(F.lit("\t "), "city", F.lit(" \n")).alias("city"), "vip_level", "username")
    return compare.normalized(padded)


@query("cmp_cell",
       f"""SELECT count(CASE WHEN abs(total - noisy) <= greatest(0.011, abs(noisy) * 1e-6) THEN 1 END) AS agree,
                  count(CASE WHEN abs(total - noisy) > greatest(0.011, abs(noisy) * 1e-6) THEN 1 END) AS differ
           FROM (SELECT o_totalprice AS total, o_totalprice + CAST(0.1 AS DOUBLE) * (o_orderkey % 7) AS noisy FROM orders) o""")
def cmp_cell(t):
    cells = t.base("orders").select(
        F.col("o_totalprice").alias("gold"), F.expr("o_totalprice + 0.1d * (o_orderkey % 7)").alias("pred")
    )
    agree = compare.cells_agree(F.col("gold"), F.col("pred"), True, True)
    return cells.agg(F.count_if(agree).alias("agree"), F.count_if(~agree).alias("differ"))


@query("cmp_align",
       f"SELECT {_NOISE_SQL} AS \"Total\", concat(' ', o_orderstatus, '  ') AS \"STATUS\" FROM orders")
def cmp_align(t):
    return compare.aligned(gold_orders(t), noisy_orders(t))


@query("cmp_ordered", _positional_sql("ordered", _NOISE_SQL, "total DESC, id", "total DESC, id"))
def cmp_ordered(t):
    """Most expensive order first; the order key breaks ties but is not compared."""
    gold = t.base("orders").select(F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    pred = t.base("orders").select("o_orderkey", F.expr("o_totalprice + 0.004d * (o_orderkey % 3 - 1)").alias("price"),
                                   F.col("o_orderstatus").alias("state"))
    return compare.compare_rows(
        gold, pred, "ordered", gold_columns=["total", "status"], pred_columns=["price", "state"],
        gold_order=[("total", False), ("o_orderkey", True)], pred_order=[("price", False), ("o_orderkey", True)],
    )


@query("cmp_multiset", _positional_sql("multiset", _NOISE_SQL, _CELL_ORDER, _CELL_ORDER))
def cmp_multiset(t):
    return compare.compare_tables(gold_orders(t), noisy_orders(t))


_WRONG = "CASE WHEN o_orderkey % 5000 = 17 THEN 2 ELSE 0 END"


@query("cmp_first_mismatch",
       f"""WITH gold AS (SELECT row_number() OVER (ORDER BY {_CELL_ORDER}) - 1 AS pos, total, status FROM
                     (SELECT o_totalprice AS total, o_orderstatus AS status FROM orders) g),
             pred AS (SELECT row_number() OVER (ORDER BY {_CELL_ORDER}) - 1 AS pos, total, status FROM
                     (SELECT {_NOISE_SQL} + {_WRONG} AS total, o_orderstatus AS status FROM orders) p),
             wrong AS (SELECT gold.pos AS pos, gold.total AS gold_total, gold.status AS gold_status, pred.total AS pred_total,
                         pred.status AS pred_status FROM gold JOIN pred ON gold.pos = pred.pos
                       WHERE gold.status <> pred.status OR abs(gold.total - pred.total) > greatest(0.011, abs(pred.total) * 1e-6))
        SELECT count(*) = 0 AS equal, (SELECT count(*) FROM gold) AS gold_rows, (SELECT count(*) FROM pred) AS pred_rows,
               min(pos) AS first_mismatch, round(min_by(gold_total, pos), 4) AS gold_total, min_by(gold_status, pos) AS gold_status,
               round(min_by(pred_total, pos), 4) AS pred_total, min_by(pred_status, pos) AS pred_status FROM wrong""")
def cmp_first_mismatch(t):
    """The first two rows that face each other and disagree, with both row counts."""
    found = compare.first_mismatch(gold_orders(t), noisy_orders(t, _WRONG))
    cells = lambda side: F.from_json(f"{side}_row", "total double, status string")
    return found.select("equal", "gold_rows", "pred_rows", "first_mismatch", *(
        made for side in ("gold", "pred") for made in (
            F.round(cells(side)["total"], 4).alias(f"{side}_total"), cells(side)["status"].alias(f"{side}_status"))))


@query("cmp_projection",
       """WITH gold AS (SELECT row_number() OVER (ORDER BY o_custkey, round(o_totalprice, 4), o_totalprice) AS pos,
                               o_custkey AS who, o_totalprice AS total FROM orders),
               pred AS (SELECT row_number() OVER (ORDER BY who, round(total, 4), total) AS pos, who, total FROM
                         (SELECT o_custkey AS who, o_totalprice + CAST(0.001 AS DOUBLE) AS total FROM orders) p)
          SELECT count(CASE WHEN gold.who <> pred.who OR abs(gold.total - pred.total) > 0.011 THEN 1 END) = 0 AS equal,
                 'projection' AS rule, CAST(NULL AS BIGINT) AS first_mismatch
          FROM gold JOIN pred ON gold.pos = pred.pos""")
def cmp_projection(t):
    """The prediction has two columns too many, other names and another column order."""
    gold = t.base("orders").select("o_custkey", "o_totalprice")
    pred = t.base("orders").select(
        F.col("o_orderstatus").alias("a"), F.expr("o_totalprice + 0.001d").alias("b"),
        F.col("o_orderkey").alias("c"), F.col("o_custkey").alias("d"),
    )
    return compare.compare_tables(gold, pred)


# Every customer's orders are the result of one question. Some predictions fail, lack rows or a column, have one more
# column, or wrong totals; every third question has an order.
_PAIRS_SQL = """pairs AS (SELECT o_custkey AS qid, o_orderkey AS id, o_totalprice AS total, o_orderstatus AS status,
                   o_totalprice + CAST(0.004 AS DOUBLE) * (o_orderkey % 3 - 1)
                     + CASE WHEN o_orderkey % 89 = 0 THEN 2 ELSE 0 END AS noisy,
                   o_custkey % 11 = 0 AND o_orderkey % 5 = 0 AS lost, o_custkey % 3 = 0 AS ordered FROM orders)"""


def result_pairs(t):
    """(items, gold, pred) of the results of all customers' questions."""
    orders = t.base("orders").select(
        F.col("o_custkey").cast("long").alias("qid"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"),
        F.expr("o_totalprice + 0.004d * (o_orderkey % 3 - 1) + CASE WHEN o_orderkey % 89 = 0 THEN 2 ELSE 0 END").alias("noisy"),
        F.col("o_orderstatus").alias("status"))
    qid, named = F.col("qid"), lambda *names: F.array(*map(F.lit, names))
    pred_columns = F.when(qid % 17 == 0, named("total")).when(qid % 7 == 0, named("id", "status", "price")).otherwise(
        named("STATUS", "Total"))
    items = orders.select("qid").distinct().select(
        "qid", named("total", "status").alias("gold_columns"), pred_columns.alias("pred_columns"),
        (qid % 3 == 0).alias("ordered"), F.when(qid % 13 == 0, "no such column: amount").alias("error"))
    gold = orders.select("qid", F.col("id").alias("at"), bulk_compare.cells_of(orders, ["total", "status"]).alias("cells"))
    cells = F.when(qid % 17 == 0, bulk_compare.cells_of(orders, ["noisy"])).when(
        qid % 7 == 0, bulk_compare.cells_of(orders, ["id", "status", "noisy"])).otherwise(bulk_compare.cells_of(orders, ["status", "noisy"]))
    pred = orders.where("NOT (qid % 11 = 0 AND id % 5 = 0)").select("qid", F.col("id").alias("at"), cells.alias("cells"))
    return items, gold, pred


@query("m_label_results",
       f"""WITH {_PAIRS_SQL},
              gold AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN ordered THEN id END,
                              round(total, 4), status, total) - 1 AS pos FROM pairs),
              pred AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN ordered THEN id END,
                              round(noisy, 4), status, noisy) - 1 AS pos FROM pairs WHERE NOT lost),
              sizes AS (SELECT qid, count(*) AS gold_rows, count(CASE WHEN NOT lost THEN 1 END) AS pred_rows, any_value(ordered) AS ordered
                        FROM pairs GROUP BY qid),
              wrong AS (SELECT gold.qid AS qid, min(gold.pos) AS pos FROM gold JOIN pred ON gold.qid = pred.qid AND gold.pos = pred.pos
                        WHERE gold.status <> pred.status OR abs(gold.total - pred.noisy) > greatest(0.011, abs(pred.noisy) * 1e-6)
                        GROUP BY gold.qid),
              judged AS (SELECT sizes.*, wrong.pos AS pos, CASE WHEN sizes.qid % 13 = 0 THEN 'exec_error'
                           WHEN gold_rows <> pred_rows THEN 'row_count' WHEN sizes.qid % 17 = 0 THEN 'column_count'
                           WHEN sizes.qid % 7 = 0 AND wrong.pos IS NULL THEN 'projection' WHEN sizes.qid % 7 = 0 THEN 'column_count'
                           WHEN ordered THEN 'ordered' ELSE 'multiset' END AS rule
                         FROM sizes LEFT JOIN wrong ON sizes.qid = wrong.qid)
           SELECT qid, rule IN ('projection', 'ordered', 'multiset') AND pos IS NULL AS correct,
                  CASE WHEN rule = 'exec_error' THEN rule WHEN rule IN ('projection', 'ordered', 'multiset') AND pos IS NULL
                       THEN 'correct' ELSE 'wrong_result' END AS attribution,
                  rule, gold_rows, pred_rows, CASE WHEN rule IN ('ordered', 'multiset') THEN pos END AS first_mismatch,
                  CASE WHEN rule = 'exec_error' THEN 'no such column: amount'
                       WHEN rule = 'row_count' THEN concat('rows: gold ', gold_rows, ' pred ', pred_rows)
                       WHEN rule = 'column_count' THEN concat('columns: gold 2 pred ', CASE WHEN qid % 17 = 0 THEN 1 ELSE 3 END)
                       WHEN pos IS NULL THEN '' ELSE concat('row ', pos, ' differs') END AS reason
           FROM judged""")
def m_label_results(t):
    """The rows that a reason quotes are cut off here; cmp_first_mismatch shows them."""
    labelled = bulk_compare.label_results(*result_pairs(t))
    return labelled.withColumn("reason", F.regexp_replace("reason", "(?s)^(row [0-9]+ differs):.*", "$1"))


# Metrics over a result log

@query("m_exec_accuracy",
       """SELECT run, count(*) AS total, count(CASE WHEN correct THEN 1 END) AS correct,
                 round(100.0 * count(CASE WHEN correct THEN 1 END) / count(*), 1) AS exec_accuracy
          FROM r_result_log GROUP BY run""")
def m_exec_accuracy(t):
    return evaluation.exec_accuracy(t.table("result_log"))


@query("m_first_round",
       """SELECT run, round(100.0 * count(CASE WHEN correct AND attempts <= 1 THEN 1 END) / count(*), 1) AS first_round_pass,
                 count(*) - count(CASE WHEN correct AND attempts <= 1 THEN 1 END) AS first_round_fail_count
          FROM r_result_log GROUP BY run""")
def m_first_round(t):
    return evaluation.first_round(t.table("result_log"))


@query("m_saved",
       """SELECT run, count(CASE WHEN correct AND attempts > 1 THEN 1 END) AS saved_count,
                 round(100.0 * count(CASE WHEN correct AND attempts > 1 THEN 1 END) /
                       (count(*) - count(CASE WHEN correct AND attempts <= 1 THEN 1 END)), 1) AS saved_by_correction
          FROM r_result_log GROUP BY run""")
def m_saved(t):
    return evaluation.saved(t.table("result_log"))


@query("m_by_difficulty",
       """SELECT r.run, d.difficulty, count(l.qid) AS total,
                 coalesce(round(100.0 * count(CASE WHEN l.correct THEN 1 END) / nullif(count(l.qid), 0), 1), 0) AS accuracy
          FROM (SELECT DISTINCT run FROM r_result_log) r CROSS JOIN (VALUES ('easy'), ('medium'), ('hard')) d(difficulty)
          LEFT JOIN r_result_log l ON l.run = r.run AND l.difficulty = d.difficulty GROUP BY r.run, d.difficulty""")
def m_by_difficulty(t):
    return evaluation.by_difficulty(t.table("result_log"))


@query("m_attribution", "SELECT run, attribution, count(*) AS n FROM r_result_log WHERE NOT correct GROUP BY run, attribution")
def m_attribution(t):
    return evaluation.attribution(t.table("result_log"))


@query("m_latency",
       """WITH ranked AS (SELECT run, latency_s, row_number() OVER (PARTITION BY run ORDER BY latency_s) - 1 AS idx,
                                 count(*) OVER (PARTITION BY run) AS n FROM r_result_log)
          SELECT run, round(CAST(sum(latency_s) AS DOUBLE) / count(*), 1) AS avg_latency_s,
                 CAST(max(CASE WHEN idx = least(CAST(floor(n * CAST(0.5 AS DOUBLE)) AS BIGINT), n - 1)
                               THEN latency_s END) AS DOUBLE) AS p50_latency_s,
                 CAST(max(CASE WHEN idx = least(CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT), n - 1)
                               THEN latency_s END) AS DOUBLE) AS p95_latency_s
          FROM ranked GROUP BY run""")
def m_latency(t):
    return evaluation.latency(t.table("result_log"))


@query("m_cost",
       """SELECT run, CAST(round(CAST(sum(total_tokens) AS DOUBLE) / count(*)) AS BIGINT) AS avg_total_tokens,
                 round(CAST(sum(llm_calls) AS DOUBLE) / count(*), 2) AS avg_llm_calls FROM r_result_log GROUP BY run""")
def m_cost(t):
    return evaluation.cost(t.table("result_log"))


@query("m_usage_rollup",
       """SELECT qid, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, count(*) AS llm_calls
          FROM r_call_log GROUP BY qid""")
def m_usage_rollup(t):
    return evaluation.usage_rollup(t.table("call_log"))


@query("m_ablation",
       """WITH acc AS (SELECT run, round(100.0 * count(CASE WHEN correct THEN 1 END) / count(*), 1) AS exec_accuracy
                       FROM r_result_log GROUP BY run)
          SELECT run, exec_accuracy,
                 round(exec_accuracy - (SELECT exec_accuracy FROM acc WHERE run = 'run0'), 4) AS exec_accuracy_delta FROM acc""")
def m_ablation(t):
    return evaluation.ablation(evaluation.outcomes(t.table("result_log")), "run0", "exec_accuracy")


@query("m_qid_filter", "SELECT qid, question FROM r_result_log ORDER BY qid LIMIT 50")
def m_qid_filter(t):
    """The first fifty questions, as a limited evaluation run asks for."""
    return evaluation.choose_items(t.table("result_log").select("qid", "question"), "qid", limit=50)


@query("m_qid_filter_listed", "SELECT qid, question FROM r_result_log WHERE qid IN (3, 5, 8, 700)")
def m_qid_filter_listed(t):
    return evaluation.choose_items(t.table("result_log").select("qid", "question"), "qid", ids=[3, 5, 8, 700])


@query("m_set_quality",
       """SELECT 'repeated_question' AS rule, question AS subject, count(*) AS n FROM r_result_log
          GROUP BY question HAVING count(*) > 1
          UNION ALL SELECT 'level_count', 'easy', count(*) FROM r_result_log WHERE difficulty = 'easy' HAVING count(*) <> 60
          UNION ALL SELECT 'level_count', 'medium', count(*) FROM r_result_log WHERE difficulty = 'medium' HAVING count(*) <> 40
          UNION ALL SELECT 'level_count', 'hard', count(*) FROM r_result_log WHERE difficulty = 'hard' HAVING count(*) <> 20
          UNION ALL SELECT 'not_admitted', CASE event_id % 8 WHEN 0 THEN 'many_statements' WHEN 4 THEN 'many_statements' WHEN 5 THEN 'empty'
                      ELSE 'not_a_query' END, count(*) FROM events WHERE event_id % 8 IN (0, 2, 3, 4, 5, 6, 7) GROUP BY 2""")
def m_set_quality(t):
    """The raw answers stand in for the SQL of a question set: fences and commands are refused."""
    answers = t.table("question_log").select("qid", "answer")
    items = t.table("result_log").select("qid", "question", "difficulty").join(answers, "qid").withColumnRenamed("qid", "id")
    return evaluation.item_violations(items, {"easy": 60, "medium": 40, "hard": 20}, logs.admission(F.col("answer")))


# Log jobs

@query("l_relative_time",
       """SELECT qid, event_id % 6 IN (0, 2, 4) AS relative FROM
            (SELECT event_id, event_id AS qid FROM events) e""")
def l_relative_time(t):
    return t.table("question_log").select("qid", logs.has_relative_time(F.col("question")).alias("relative"))


@query("l_extract_sql",
       """SELECT event_id AS qid, CASE event_id % 8
            WHEN 0 THEN concat('SELECT count(*) FROM orders WHERE user_id = ', CAST(user_id AS VARCHAR))
            WHEN 1 THEN 'select 1 AS x'
            WHEN 2 THEN concat('WITH t AS (SELECT ', CAST(user_id AS VARCHAR), ' AS x) SELECT x FROM t')
            WHEN 3 THEN 'DROP TABLE orders' WHEN 4 THEN 'SELECT 1; SELECT 2' WHEN 5 THEN ''
            WHEN 6 THEN concat('PRAGMA table_info(', event_type, ')') ELSE props END AS statement FROM events""")
def l_extract_sql(t):
    return t.table("question_log").select("qid", logs.extract_sql(F.col("answer")).alias("statement"))


@query("l_admit_sql",
       """SELECT event_id AS qid, CASE WHEN event_id % 8 IN (0, 1, 2) THEN 'ok' WHEN event_id % 8 = 4 THEN 'many_statements'
            WHEN event_id % 8 = 5 THEN 'empty' ELSE 'not_a_query' END AS reason FROM events""")
def l_admit_sql(t):
    return t.table("question_log").select("qid", logs.admission(logs.extract_sql(F.col("answer"))).alias("reason"))


@query("l_table_picks",
       """SELECT event_id AS qid, CASE event_id % 4 WHEN 0 THEN 'orders,users' WHEN 1 THEN 'orders,payments'
            WHEN 2 THEN 'refunds,order_items,orders,orders' ELSE '' END AS picks FROM events""")
def l_table_picks(t):
    picks = logs.known_names(F.col("picks"), list(TABLES))
    return t.table("question_log").select("qid", F.array_join(picks, ",").alias("picks"))


# Evaluation files

_ITEMS_SQL = "SELECT id, question, gold_sql, difficulty, concat(difficulty, ',text') AS tags FROM r_eval_items"


def eval_items(t):
    return t.table("eval_items").withColumn("tags", F.array("difficulty", F.lit("text")))


@query("write_jsonl", _ITEMS_SQL)
def write_jsonl(t):
    """Items written as JSON lines and read back."""
    path = files.write_jsonl(eval_items(t), fresh_path(t.spark, "items"))
    return files.read_jsonl(t.spark, path).withColumn("tags", F.array_join("tags", ","))


@query("read_jsonl", _ITEMS_SQL)
def read_jsonl(t):
    """The same lines with blank ones between them, which hold no item."""
    lines = eval_items(t).select(F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("value"))
    path = fresh_path(t.spark, "items")
    lines.write.text(path)
    return files.read_jsonl(t.spark, path).withColumn("tags", F.array_join("tags", ","))


@query("write_report_csv",
       """SELECT qid, run, question, correct, CAST(latency_s AS DOUBLE) AS latency_s,
                 concat('["', difficulty, '","', attribution, '"]') AS tags FROM r_result_log""")
def write_report_csv(t):
    log = t.table("result_log").select(
        "qid", "run", "question", "correct", F.col("latency_s").cast("double").alias("latency_s"),
        F.array("difficulty", "attribution").alias("tags"),
    )
    path = files.write_report_csv(log, fresh_path(t.spark, "report"))
    schema = "qid bigint, run string, question string, correct boolean, latency_s double, tags string"
    return files.read_report_csv(t.spark, path, schema)


@query("write_summary_json",
       """SELECT run, count(*) AS total, count(CASE WHEN correct THEN 1 END) AS correct,
                 round(100.0 * count(CASE WHEN correct AND difficulty = 'hard' THEN 1 END) /
                       count(CASE WHEN difficulty = 'hard' THEN 1 END), 1) AS hard_accuracy,
                 CAST(count(CASE WHEN attribution = 'exec_error' THEN 1 END) AS INTEGER) AS exec_errors
          FROM r_result_log GROUP BY run""")
def write_summary_json(t):
    path = files.write_summary_json(evaluation.summaries(t.table("result_log")), fresh_path(t.spark, "summary"))
    back = files.read_summary_json(t.spark, path)
    return back.select("run", "total", "correct", F.col("by_difficulty.hard.accuracy").alias("hard_accuracy"),
                       F.col("attribution.exec_error").alias("exec_errors"))


_MARKED_SQL = "SELECT qid, run, concat(question, chr(10), '\\n', chr(13), run, '\\') AS note FROM r_result_log"


@query("write_report_csv_lines", _MARKED_SQL)
def write_report_csv_lines(t):
    """Texts with line breaks, and with backslashes that only look like them, come back as they were."""
    note = F.concat("question", F.lit("\n\\n\r"), "run", F.lit("\\"))
    path = files.write_report_csv(t.table("result_log").select("qid", "run", note.alias("note")), fresh_path(t.spark, "lines"))
    return files.read_report_csv(t.spark, path, "qid bigint, run string, note string")


@query("write_summary_run_fields",
       """WITH runs AS (SELECT run, count(*) AS total, round(CAST(sum(latency_s) AS DOUBLE), 3) AS wall_time_s
                        FROM r_result_log GROUP BY run
                        UNION ALL SELECT 'idle', 0, CAST(0 AS DOUBLE))
          SELECT run, concat('tag-', run) AS tag, '1998-12-01T00:00:00' AS timestamp, 'none' AS model, 'main' AS dataset,
                 wall_time_s, total, CASE WHEN run = 'idle' THEN CAST(0 AS DOUBLE) END AS idle_accuracy,
                 CASE WHEN run = 'idle' THEN 0 END AS idle_hard FROM runs""")
def write_summary_run_fields(t):
    """What is known of a run stands beside its metrics; a run without a line in the log has zeros."""
    log = t.table("result_log")
    idle = log.limit(0).groupBy().agg(F.lit("idle").alias("run"), F.lit(0.0).alias("wall_time_s"))
    timed = log.groupBy("run").agg(F.round(F.sum("latency_s").cast("double"), 3).alias("wall_time_s"))
    runs = timed.unionByName(idle).select(
        "run", F.concat(F.lit("tag-"), "run").alias("tag"), F.lit("1998-12-01T00:00:00").alias("timestamp"),
        F.lit("none").alias("model"), F.lit("main").alias("dataset"), "wall_time_s")
    path = files.write_summary_json(evaluation.summaries(log, runs), fresh_path(t.spark, "summary"))
    idle_only = F.col("run") == "idle"
    return files.read_summary_json(t.spark, path).select(
        "run", "tag", "timestamp", "model", "dataset", "wall_time_s", "total",
        F.when(idle_only, F.col("exec_accuracy")).alias("idle_accuracy"),
        F.when(idle_only, F.col("by_difficulty.hard.total")).alias("idle_hard"))
