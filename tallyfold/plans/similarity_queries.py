"""Character n-gram similarity over documents, conversations and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.functions.text import jaccard, ngrams
from tallyfold.operators.similarity import best_examples, distinct_texts, leakage_accuracy, leakage_groups, text_digest
from tallyfold.plans.registry import query


def _grams_sql(text: str) -> str:
    return f"list_distinct([substr({text}, i, 2) FOR i IN range(1, length({text}))])"


@query("s_bigrams",
       f"""SELECT doc_id, CAST(len(grams) AS INTEGER) AS n, md5(array_to_string(list_sort(grams), '|')) AS digest
           FROM (SELECT doc_id, {_grams_sql("text")} AS grams FROM documents) g""")
def s_bigrams(t):
    """The set of each text is made once, however many documents have the text."""
    docs = t.base("documents")
    sets = distinct_texts(docs, "text").select("digest", ngrams(F.col("text")).alias("grams")).select(
        F.col("digest").alias("of"), F.size("grams").alias("n"), F.md5(F.array_join(F.array_sort("grams"), "|")).alias("digest"))
    return docs.select("doc_id", text_digest("text").alias("of")).join(sets, "of").drop("of")


@query("s_jaccard",
       f"""WITH g AS (SELECT conv_id, turn, {_grams_sql("text")} AS grams FROM conversations),
                p AS (SELECT a.conv_id, a.turn, len(a.grams) AS la, len(b.grams) AS lb,
                             len(list_intersect(a.grams, b.grams)) AS shared
                      FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
           SELECT conv_id, turn, CASE WHEN la = 0 OR lb = 0 THEN 0 ELSE
                    round(CAST(shared AS DOUBLE) / (la + lb - shared), 6) END AS score FROM p""")
def s_jaccard(t):
    """Each turn of a conversation against the next one."""
    turns = t.base("conversations").select("conv_id", "turn", ngrams(F.col("text")).alias("grams"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("grams").alias("next_grams"))
    pairs = turns.join(following, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(jaccard(F.col("grams"), F.col("next_grams")), 6).alias("score"))


@query("s_topk_examples",
       f"""WITH q AS (SELECT conv_id, turn, {_grams_sql("text")} AS grams FROM conversations WHERE role = 'user'),
                e AS (SELECT item_id, {_grams_sql("text")} AS grams FROM benchmark
                      UNION ALL SELECT item_id, {_grams_sql("word")} FROM (
                        SELECT item_id, unnest(string_split(text, ' ')) AS word
                        FROM benchmark) w WHERE word <> ''),
                s AS (SELECT conv_id, turn, item_id, max(CASE WHEN len(q.grams) = 0 OR len(e.grams) = 0 THEN 0 ELSE
                             CAST(len(list_intersect(q.grams, e.grams)) AS DOUBLE) /
                             (len(q.grams) + len(e.grams) - len(list_intersect(q.grams, e.grams))) END) AS score
                      FROM q CROSS JOIN e GROUP BY conv_id, turn, item_id),
                r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, item_id) AS place
                      FROM s WHERE score >= 0.15)
           SELECT conv_id, turn, CAST(place AS INTEGER) AS place, item_id AS ordinal, round(score, 6) AS score FROM r WHERE place <= 2""")
def s_topk_examples(t):
    """User turns as questions; benchmark items, with all their words as keywords, as examples."""
    asked = t.base("conversations").where(F.col("role") == "user")
    asked = asked.select(F.struct("conv_id", "turn").alias("asked"), "text")
    examples = t.base("benchmark").select(
        F.col("item_id").alias("ordinal"), F.col("text").alias("question"),
        F.col("text").alias("keywords"),
    )
    found = best_examples(asked, examples, "asked")
    return found.select("asked.conv_id", "asked.turn", "place", "ordinal", F.round("score", 6).alias("score"))


_GROUPS_SQL = f"""g AS (SELECT doc_id, {_grams_sql("text")} AS grams FROM documents),
                  b AS (SELECT {_grams_sql("text")} AS grams FROM benchmark),
                  m AS (SELECT doc_id, max(CASE WHEN len(g.grams) = 0 OR len(b.grams) = 0 THEN 0 ELSE
                               CAST(len(list_intersect(g.grams, b.grams)) AS DOUBLE) /
                               (len(g.grams) + len(b.grams) - len(list_intersect(g.grams, b.grams))) END) AS best
                        FROM g CROSS JOIN b GROUP BY doc_id)"""


@query("s_leakage_group",
       f"""WITH {_GROUPS_SQL}
           SELECT doc_id, CASE WHEN best >= 0.35 THEN 'leaked' ELSE 'clean' END AS leakage,
                  CASE WHEN best >= 0.35 THEN round(best, 6) END AS similarity FROM m""")
def s_leakage_group(t):
    groups = leakage_groups(t.base("documents"), t.base("benchmark"), "doc_id")
    return groups.withColumn("similarity", F.round("similarity", 6))


@query("s_leakage_accuracy",
       f"""WITH {_GROUPS_SQL},
                log AS (SELECT 'quality' AS run, doc_id, quality = 1 AS correct FROM labels
                        UNION ALL SELECT 'toxic', doc_id, toxic = 0 FROM labels)
           SELECT run, CASE WHEN best >= 0.35 THEN 'leaked' ELSE 'clean' END AS leakage, count(*) AS total,
                  round(count(CASE WHEN correct THEN 1 END) * 100.0 / count(*), 1) AS accuracy
           FROM log JOIN m ON log.doc_id = m.doc_id GROUP BY 1, 2""")
def s_leakage_accuracy(t):
    """The two labels of a document are the outcomes of two runs."""
    runs = F.array(
        F.struct(F.lit("quality").alias("run"), (F.col("quality") == 1).alias("correct")),
        F.struct(F.lit("toxic").alias("run"), (F.col("toxic") == 0).alias("correct")),
    )
    log = t.base("labels").select("doc_id", F.inline(runs))
    return leakage_accuracy(leakage_groups(t.base("documents"), t.base("benchmark"), "doc_id"), log, "doc_id")
