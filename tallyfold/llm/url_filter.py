"""URL verdicts from rules and, where none fits, from a tree of path templates.

Per host, paths become templates: digits in a segment are one placeholder, and under a parent with many different
children that each have few paths the child is a wildcard. Templates that differ in their last literal segment only
are siblings; labelled siblings whose share of bad pages lies within ``SIMILAR`` standard errors of their joint share
are merged. A template's labelled purity is its share of good pages, smoothed towards one half, and a template
below one half is rejected. Labels are the pages a rule decides. Pages meet the tree as counts of distinct paths for
each (host, form of the path), so repeated rows change no verdict and a host with a third of all pages is spread by
path, then summed map-side.

Null urls and those without ``://`` have empty host and path; no rule fits them. Templates without a labelled page
are allowed. Repeated rows each get their verdict. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import checkpointed

Rule = tuple[str, str, str]
BRANCHES = 16
PATHS_PER_BRANCH = 4.0
SIMILAR = 2.0
SMOOTHING = 1.0


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url."""
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.translate(
        F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    fitting = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of_host, of_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(of_path)
        fitting = F.when(fits, F.struct(F.lit(of_host + of_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fitting)
    return fitting


def form_of(path: Column) -> Column:
    """The path with each run of digits as one placeholder."""
    return F.regexp_replace(path, "[0-9]+", "#")


def templates(forms: DataFrame) -> DataFrame:
    """(host, form, template): segments of ``forms`` (host, form, pages) with variable ones as wildcards."""
    segments = forms.select(
        "host", "form", "pages", F.posexplode(F.split(F.regexp_replace("form", "^/", ""), "/")).alias("depth", "segment"))
    parent = F.concat_ws("/", F.slice(F.split("form", "/"), 1, F.col("depth") + 1))
    segments = checkpointed(segments.withColumn("parent", parent))
    children = segments.groupBy("host", "parent", "segment").agg(F.sum("pages").alias("pages"))
    variable = children.groupBy("host", "parent").agg(
        F.count("*").alias("branches"), F.avg("pages").alias("per_branch"))
    variable = variable.where((F.col("branches") >= BRANCHES) & (F.col("per_branch") < PATHS_PER_BRANCH)).select(
        "host", "parent", F.lit(True).alias("variable"))
    kept = segments.join(variable, ["host", "parent"], "left").withColumn(
        "segment", F.when(F.col("variable"), "*").otherwise(F.col("segment")))
    in_order = F.array_sort(F.collect_list(F.struct("depth", "segment")))
    return kept.groupBy("host", "form").agg(in_order.alias("s")).select(
        "host", "form", F.col("s.segment").alias("segments"))


def branches(forms: DataFrame) -> DataFrame:
    """(host, form, rejected) of every form; ``forms`` also has counts of labelled and bad pages."""
    literal = F.transform("segments", lambda s: ~s.rlike(r"^[#*.a-z]*[#*][#*.a-z]*$") & (s != ""))
    hole = (F.size("segments") - F.array_position(F.reverse(literal), True)).cast("int")
    shaped = forms.join(templates(forms), ["host", "form"]).withColumn("hole", hole)
    family = F.transform("segments", lambda s, i: F.when(i == F.col("hole"), "{}").otherwise(s))
    shaped = shaped.withColumn("template", F.concat_ws("/", "segments")).withColumn(
        "family", F.concat_ws("/", family))
    sums = [F.sum(c).alias(c) for c in ("labelled", "bad")]
    own = checkpointed(shaped.groupBy("host", "family", "template").agg(*sums))
    joint = own.groupBy("host", "family").agg(
        F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    pooled = F.try_divide("all_bad", "all_labelled")
    error = F.sqrt(F.try_divide(pooled * (1 - pooled), F.col("labelled")))
    near = F.abs(F.try_divide("bad", "labelled") - pooled) <= SIMILAR * error
    branch = F.when(near, F.concat(F.lit("{}"), "family")).otherwise(F.concat(F.lit("="), "template"))
    merged = own.join(joint, ["host", "family"]).withColumn("branch", F.coalesce(branch, F.concat(F.lit("="), "template")))
    purity = (F.sum(F.col("labelled") - F.col("bad")) + SMOOTHING) / (F.sum("labelled") + 2 * SMOOTHING)
    judged = merged.groupBy("host", "branch").agg((purity < 0.5).alias("rejected"))
    by_template = merged.join(judged, ["host", "branch"]).select("host", "template", "rejected")
    return shaped.select("host", "form", "template").join(by_template, ["host", "template"]).select(
        "host", "form", "rejected")


def judged(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    host, path = parts(url)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("form", form_of(F.col("path")))
    paths = rows.select("host", "form", "path", "fit").distinct()
    forms = checkpointed(paths.groupBy("host", "form").agg(
        F.count("*").alias("pages"), F.count("fit").alias("labelled"),
        F.count_if(F.col("fit.verdict") == "block").alias("bad")))
    learned = F.when(F.col("rejected"), "block").otherwise("allow")
    return rows.join(branches(forms), ["host", "form"], "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", learned).alias("verdict"))
