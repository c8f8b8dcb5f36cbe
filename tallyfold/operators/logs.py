"""Column jobs over large logs of questions, model answers and SQL statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions.text import strip

# Words that make a question depend on the day it is asked.
RELATIVE_TIME = (
    r"今天|昨天|前天|本周|这周|上周|本月|这个月|上个月|上月|近\d*|最近|今年|去年|目前|当前|最新|至今|截止"
)
# The fenced block of a model answer, and what separates names in a list of tables.
FENCED_BLOCK = r"(?sU)```(?:sql)?\s*(.+?)\s*```"
NAME_SEPARATORS = r"(?U)[,，;；\s]+"
READ_ONLY_HEADS = ("SELECT", "WITH")


def has_relative_time(text: Column, pattern: str = RELATIVE_TIME) -> Column:
    return text.rlike(pattern)


def bare_statement(text: Column) -> Column:
    """A statement without surrounding white space and closing semicolons."""
    return strip(F.rtrim(strip(text), F.lit(";")))


def extract_sql(answer: Column) -> Column:
    """The first fenced block of an answer, else the whole answer, as a bare statement."""
    block = F.regexp_extract(answer, FENCED_BLOCK, 1)
    return bare_statement(F.when(block != "", block).otherwise(answer))


def admission(sql: Column) -> Column:
    """Why a statement may not run: ``empty``, ``many_statements``, ``not_a_query``; else ``ok``.

    Any semicolon inside counts as a second statement, even one in a literal.
    """
    bare = bare_statement(sql)
    head = F.upper(F.regexp_extract(bare, r"(?U)\A(\S+)", 1))
    return (
        F.when(bare == "", "empty")
        .when(bare.contains(";"), "many_statements")
        .when(~head.isin(*READ_ONLY_HEADS), "not_a_query")
        .otherwise("ok")
    )


def known_names(text: Column, names: list[str]) -> Column:
    """Known table names in a free list, in their order and with repeats."""
    listed = F.split(strip(text), NAME_SEPARATORS)
    return F.filter(listed, lambda name: name.isin(*names))
