"""Every question of both sets, on an export whose values are those the questions ask about, raw and curated."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyfold.plans.question_sets import CHILD_CATEGORIES, CITIES, HELD_OUT, MAIN, answer
from tallyfold.sources.dump import SCHEMAS, TABLES, CuratedTables, DumpTables, curate
from tallyfold.sources.mapped import TIME_SOURCE

YEARS = {"orders": 29, "payments": 29, "refunds": 29, "daily_product_metrics": 29, "reviews": 1, "user_coupons": 1,
         "daily_user_activity": 1}


def moved(column: str, years: int):
    """A text date some years later: only its first four characters change."""
    text = F.col(column)
    return F.concat((F.substring(text, 1, 4).cast("int") + years).cast("string"), F.substring(text, 5, 100))


@pytest.fixture(scope="module")
def export(spark, tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("asked"))
    names = F.array(*map(F.lit, CITIES))
    kinds = F.array(*map(F.lit, CHILD_CATEGORIES))
    for name in TABLES:
        columns = [part.split(" ")[0] for part in SCHEMAS[name].split(", ")]
        df = tables.table(name).select(*columns)
        if name in TIME_SOURCE:
            df = df.withColumns({c: moved(c, YEARS[name]) for c in columns if c.endswith("_at") or c in ("date", "pay_time")})
        if "city" in columns:
            df = df.withColumn("city", F.get(names, (F.regexp_extract("city", r"(\d+)", 1).cast("int") % len(CITIES))))
        if name == "categories":
            df = df.withColumn("name", F.when(F.col("parent_id").isNull(), F.col("name")).otherwise(F.get(kinds, (F.col("id") % 6).cast("int"))))
        df.write.parquet(f"{root}/{name}")
    return DumpTables(spark, root)


@pytest.fixture(scope="module")
def curated(spark, export, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("curated"))
    curate(export, path)
    return CuratedTables(spark, path)


def test_sets_are_complete():
    assert list(MAIN) == list(range(1, 121)) and list(HELD_OUT) == list(range(1, 41))


@pytest.mark.parametrize("questions, number", [(MAIN, n) for n in MAIN] + [(HELD_OUT, n) for n in HELD_OUT],
                         ids=[f"main{n}" for n in MAIN] + [f"held{n}" for n in HELD_OUT])
def test_answer_is_the_same_from_text_and_from_typed_partitions(export, curated, questions, number):
    """The raw export parses text times row by row, the curated copy prunes typed partitions."""
    raw, typed = answer(export, questions, number), answer(curated, questions, number)
    assert raw.columns == typed.columns
    rows = [sorted(map(repr, frame.collect())) for frame in (raw, typed)]
    assert rows[0] == rows[1]


def test_months_are_really_there(export):
    for number in (13, 14, 15, 45, 64, 70, 77, 91, 101, 106, 109, 113):
        row = answer(export, MAIN, number).first()
        assert row is not None and row[-1] not in (None, 0)


def test_cities_without_orders_differ_from_cities_with_idle_users(export):
    assert answer(export, HELD_OUT, 37).first()["n"] == 0
