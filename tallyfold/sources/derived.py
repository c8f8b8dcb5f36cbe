"""Logs that Spark derives from the event table: questions with model answers, results, model calls."""

from __future__ import annotations

_FENCE = "'```'"
_NL = "chr(10)"

DERIVED = {
    "question_log": f"""
        SELECT event_id AS qid,
               concat(CASE event_id % 6 WHEN 0 THEN '上个月' WHEN 1 THEN '2024-01 月' WHEN 2 THEN '近7天'
                           WHEN 3 THEN '全部' WHEN 4 THEN '截止昨天' ELSE '' END,
                      ' ', event_type, ' 的用户 ', CAST(user_id AS STRING), ' 下了多少单？') AS question,
               CASE event_id % 8
                    WHEN 0 THEN concat({_FENCE}, 'sql', {_NL}, 'SELECT count(*) FROM orders WHERE user_id = ',
                                       CAST(user_id AS STRING), ';', {_NL}, {_FENCE})
                    WHEN 1 THEN concat('  select 1 AS x;', {_NL})
                    WHEN 2 THEN concat('Here it is:', {_NL}, {_FENCE}, {_NL}, 'WITH t AS (SELECT ',
                                       CAST(user_id AS STRING), ' AS x) SELECT x FROM t', {_NL}, {_FENCE}, {_NL}, 'Done.')
                    WHEN 3 THEN 'DROP TABLE orders'
                    WHEN 4 THEN 'SELECT 1; SELECT 2'
                    WHEN 5 THEN concat(' ;; ', {_NL})
                    WHEN 6 THEN concat('PRAGMA table_info(', event_type, ')')
                    ELSE concat(props, ' ') END AS answer,
               CASE event_id % 4 WHEN 0 THEN 'orders, users' WHEN 1 THEN 'orders，payments；bogus'
                    WHEN 2 THEN concat(' refunds', {_NL}, 'order_items;orders orders ')
                    ELSE event_type END AS picks
        FROM {{events}}""",
    "result_log": """
        SELECT event_id AS qid, concat('run', CAST(user_id % 4 AS STRING)) AS run,
               CASE event_type WHEN 'view' THEN 'easy' WHEN 'click' THEN 'easy' WHEN 'error' THEN 'hard'
                               ELSE 'medium' END AS difficulty,
               concat(event_type, ' ', props) AS question,
               event_id % 5 <> 0 AS correct,
               CASE WHEN event_id % 5 <> 0 THEN 'correct' WHEN event_id % 10 = 0 THEN 'exec_error'
                    ELSE 'wrong_result' END AS attribution,
               CAST(1 + event_id % 3 AS INT) AS attempts,
               CAST(value AS DECIMAL(12,2)) AS latency_s,
               CAST(1000 + event_id % 997 AS INT) AS total_tokens,
               CAST(2 + event_id % 2 AS INT) AS llm_calls
        FROM {events}""",
    "call_log": """
        SELECT user_id AS qid, CAST(100 + event_id % 50 AS INT) AS prompt_tokens,
               CAST(10 + event_id % 7 AS INT) AS completion_tokens
        FROM {events}""",
    "eval_items": """
        SELECT item_id AS id, text AS question, concat('SELECT ', CAST(item_id AS STRING)) AS gold_sql,
               CASE WHEN item_id % 6 < 3 THEN 'easy' WHEN item_id % 6 < 5 THEN 'medium' ELSE 'hard' END AS difficulty
        FROM {benchmark}""",
}
