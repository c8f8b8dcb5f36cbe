"""Evaluation metrics over a log with one row per run and question.

The log has ``run, qid, difficulty, correct, attribution, attempts, latency_s, total_tokens,
llm_calls``. Every metric is computed for all runs at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.functions.text import python_round
from tallyfold.session import shared_folder

# The difficulty levels every summary lists, in this order.
LEVELS = ("easy", "medium", "hard")


def stored(frame: DataFrame) -> DataFrame:
    """A small result that several steps read, computed once."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal; 0 of nothing is 0."""
    share = part.cast("double") / whole * 100
    return F.when(whole == 0, F.lit(0.0)).otherwise(python_round(share, 1))


def per_run(log: DataFrame) -> DataFrame:
    """Everything that can be counted per run, in one scan: totals, levels as an array, causes of failures as a map.

    Rows collapse per cause first, so what is gathered per run is one entry per cause.
    """
    correct, attempts = F.col("correct"), F.col("attempts")
    sums = {
        "total": F.count("*"), "right": F.count_if(correct), "first": F.count_if(correct & (attempts <= 1)),
        "saved_count": F.count_if(correct & (attempts > 1)), "latency": F.sum("latency_s"), "tokens": F.sum("total_tokens"),
        "calls": F.sum("llm_calls"),
    }
    if "difficulty" in log.columns:
        for level in LEVELS:
            of_level = F.col("difficulty") == level
            sums |= {f"{level}_total": F.count_if(of_level), f"{level}_right": F.count_if(of_level & correct)}
    cause = F.when(~correct, F.col("attribution")) if "attribution" in log.columns else F.lit(None).cast("string")
    parts = log.groupBy("run", cause.alias("cause")).agg(*(made.alias(name) for name, made in sums.items()))
    causes = F.collect_list(F.when(F.col("cause").isNotNull(), F.struct("cause", F.col("total").cast("int").alias("n"))))
    return parts.groupBy("run").agg(
        *(F.sum(name).alias(name) for name in sums), F.map_from_entries(F.array_sort(causes)).alias("causes"))


def _outcome_columns() -> list[Column]:
    total, missed = F.col("total"), F.col("total") - F.col("first")
    return [
        F.col("run"), total, F.col("right").alias("correct"),
        percent(F.col("right"), total).alias("exec_accuracy"),
        percent(F.col("first"), total).alias("first_round_pass"),
        percent(F.col("saved_count"), missed).alias("saved_by_correction"),
        F.col("saved_count"), missed.alias("first_round_fail_count"),
        python_round(F.col("latency").cast("double") / total, 1).alias("avg_latency_s"),
        python_round(F.col("tokens") / total, 0).cast("long").alias("avg_total_tokens"),
        python_round(F.col("calls") / total, 2).alias("avg_llm_calls"),
    ]


def outcomes(log: DataFrame) -> DataFrame:
    """Counts and shares per run: accuracy, first-round passes, answers saved by a retry."""
    return per_run(log).select(*_outcome_columns())


def exec_accuracy(log: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Accuracy per run; runs listed in ``runs`` (``run``) that the log does not know come out with zeros."""
    known = outcomes(log).select("run", "total", "correct", "exec_accuracy")
    if runs is None:
        return known
    return runs.select("run").distinct().join(known, "run", "left").fillna({"total": 0, "correct": 0, "exec_accuracy": 0.0})


def first_round(log: DataFrame) -> DataFrame:
    return outcomes(log).select("run", "first_round_pass", "first_round_fail_count")


def saved(log: DataFrame) -> DataFrame:
    return outcomes(log).select("run", "saved_count", "saved_by_correction")


def cost(log: DataFrame) -> DataFrame:
    return outcomes(log).select("run", "avg_total_tokens", "avg_llm_calls")


def by_difficulty(log: DataFrame) -> DataFrame:
    """Questions and accuracy per run and level. A level without questions keeps a zero row."""
    counts = [
        F.struct(
            F.lit(level).alias("difficulty"),
            F.count_if(F.col("difficulty") == level).alias("total"),
            F.count_if((F.col("difficulty") == level) & F.col("correct")).alias("correct"),
        )
        for level in LEVELS
    ]
    levels = log.groupBy("run").agg(F.array(*counts).alias("levels")).select("run", F.inline("levels"))
    return levels.select("run", "difficulty", "total", percent(F.col("correct"), F.col("total")).alias("accuracy"))


def attribution(log: DataFrame) -> DataFrame:
    """Failures per run and cause."""
    return log.where(~F.col("correct")).groupBy("run", "attribution").agg(F.count("*").alias("n"))


def latency_percentiles(log: DataFrame, **shares: float) -> DataFrame:
    """Exact order statistics per run: the value at index ``min(int(n * share), n - 1)``.

    Latencies become a histogram, stored once, and the wanted index is narrowed down in three steps: to its 10 ms
    bucket, inside that to its microsecond, inside that to the value. Each step orders only what the
    step before left, so no window grows with the number of questions of a run.
    """
    wanted = shares or {"p50": 0.5, "p95": 0.95}
    values = stored(log.groupBy("run", "latency_s").agg(F.count("*").alias("n")))
    seconds = F.col("latency_s").cast("double")
    values = values.withColumns({"bucket": F.floor(seconds * 100), "micro": F.floor(seconds * 1_000_000)})
    buckets = values.groupBy("run", "bucket").agg(F.sum("n").alias("n"))
    total = F.sum("n")
    indexes = F.array(*(
        F.struct(F.lit(name).alias("name"), F.least(F.floor(total.cast("double") * share), total - 1).alias("index"))
        for name, share in wanted.items()
    ))
    targets = buckets.groupBy("run").agg(indexes.alias("targets")).select("run", F.inline("targets"))

    in_bucket = _holding(buckets.join(targets, "run"), "bucket")
    micros = values.join(in_bucket, ["run", "bucket"]).groupBy("run", "name", "index", "micro").agg(F.sum("n").alias("n"))
    in_micro = _holding(micros, "micro")
    found = _holding(values.join(in_micro, ["run", "micro"]), "latency_s")
    return found.groupBy("run").agg(*(
        F.max(F.when(F.col("name") == name, F.col("latency_s"))).cast("double").alias(f"{name}_latency_s")
        for name in wanted
    ))


def _holding(counts: DataFrame, place: str) -> DataFrame:
    """The place each index falls into, and the index counted from the start of that place.

    ``counts`` has ``run, name, index, n`` and the place; the result ``run, name, index`` and the place.
    """
    earlier = W.partitionBy("run", "name").orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("skipped", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = F.col("index") - F.col("skipped")
    return placed.where((inside >= 0) & (inside < F.col("n"))).select("run", "name", place, inside.alias("index"))


def latency(log: DataFrame) -> DataFrame:
    return outcomes(log).select("run", "avg_latency_s").join(latency_percentiles(log), "run")


def usage_rollup(calls: DataFrame) -> DataFrame:
    """Tokens and model calls per question from a log of single calls."""
    return calls.groupBy("qid").agg(
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.count("*").alias("llm_calls"),
    )


def summaries(log: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row per run with all metrics, levels as a map of structs and causes as a map of counts.

    ``runs`` (``run`` and what else is known of a run, such as tag, time, model, data set, wall time) adds its columns and
    decides which runs are listed: one without a line in the log has zeros in every field.
    """
    levels = F.map_from_entries(F.array(*(
        F.struct(F.lit(level), F.struct(
            F.col(f"{level}_total").cast("int").alias("total"),
            percent(F.col(f"{level}_right"), F.col(f"{level}_total")).alias("accuracy")))
        for level in LEVELS)))
    counted = per_run(log).select(*_outcome_columns(), levels.alias("by_difficulty"), F.col("causes").alias("attribution"))
    measured = counted.join(latency_percentiles(log), "run")
    if runs is None:
        return measured
    nothing = F.map_from_entries(F.array(*(
        F.struct(F.lit(level), F.struct(F.lit(0).alias("total"), F.lit(0.0).alias("accuracy"))) for level in LEVELS)))
    empty = {"by_difficulty": nothing, "attribution": F.create_map()}
    listed = runs.join(measured, "run", "left")
    return listed.select(*runs.columns, *(
        F.coalesce(F.col(field.name), empty.get(field.name, F.lit(0)).cast(field.dataType)).alias(field.name)
        for field in measured.schema.fields if field.name != "run"))


def ablation(run_metrics: DataFrame, base: str, *metrics: str) -> DataFrame:
    """Runs side by side with the difference of each metric to a base run."""
    anchor = run_metrics.where(F.col("run") == base)
    return run_metrics.select(
        "run",
        *(F.col(name) for name in metrics),
        *(F.round(F.col(name) - anchor.select(name).scalar(), 4).alias(f"{name}_delta") for name in metrics),
    )


def choose_items(items: DataFrame, key: str, ids: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """Listed items, then the first ones by key: what a partial evaluation run asks for."""
    chosen = items.where(F.col(key).isin(*ids)) if ids else items
    return chosen.orderBy(key).limit(limit) if limit else chosen


def item_violations(items: DataFrame, expected: dict[str, int], admission: Column) -> DataFrame:
    """Faults of an evaluation set: repeated ids or questions, level counts off, SQL not admitted."""
    items = stored(items.select("id", "question", "difficulty", admission.alias("reason")))

    def repeated(column: str, rule: str) -> DataFrame:
        groups = items.groupBy(F.col(column).cast("string").alias("subject")).agg(F.count("*").alias("n"))
        return groups.where(F.col("n") > 1).select(F.lit(rule).alias("rule"), "subject", "n")

    level_counts = [
        F.struct(F.lit("level_count").alias("rule"), F.lit(level).alias("subject"),
                 F.count_if(F.col("difficulty") == level).alias("n"), F.lit(count).alias("wanted"))
        for level, count in expected.items()
    ]
    levels = items.agg(F.array(*level_counts).alias("levels")).select(F.inline("levels"))
    off = levels.where(F.col("n") != F.col("wanted")).select("rule", "subject", "n")
    refused = items.where(F.col("reason") != "ok").groupBy(
        F.col("reason").alias("subject")).agg(F.count("*").alias("n"))
    return (
        repeated("id", "repeated_id").unionByName(repeated("question", "repeated_question"))
        .unionByName(off).unionByName(refused.select(F.lit("not_admitted").alias("rule"), "subject", "n"))
    )
