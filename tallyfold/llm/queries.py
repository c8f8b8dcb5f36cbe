"""The registered queries: each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import (
    decontamination,
    exact_dedup,
    html_text,
    importance,
    language_id,
    packing,
    pii,
    prefix_trie,
    secret_scan,
    simhash,
    suffix_dedup,
    token_counts,
    url_filter,
)
from tallyfold.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return keep


TOKEN_LIMIT = 4096


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    counts = token_counts.token_counts(read(spark, sf_dir, "documents"), path)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a repository, its source for the owner."""
    return secret_scan.secrets(read(spark, sf_dir, "documents"))


@query("op4_html_text")
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.main_text(read(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def _fitting_sql(column: str) -> str:
    """What the longest rule that fits says: its text or its verdict."""
    by_length = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    cases = "".join(
        f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        f" THEN '{host + path if column == 'rule' else verdict}'" for verdict, host, path in by_length)
    return f"CASE{cases} END AS {column}"


@query("op5_url_filter", f"""
    WITH rest AS (
        SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
        SELECT page_id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, translate(regexp_extract(rest, '^[^/?#]*'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM rest),
    ruled AS (
        SELECT *, regexp_replace(path, '[0-9]+', '#', 'g') AS form, {_fitting_sql("rule")}, {_fitting_sql("verdict")} FROM parts),
    forms AS (
        SELECT host, form, count(DISTINCT path) AS paths, count(DISTINCT path) FILTER (rule IS NOT NULL) AS labelled,
            count(DISTINCT path) FILTER (verdict = 'block') AS bad FROM ruled GROUP BY host, form),
    cells AS (
        SELECT host, form, paths, depth, string_split(ltrim_one, '/')[depth] AS cell,
            array_to_string(string_split(ltrim_one, '/')[1:depth - 1], '/') AS above
        FROM (SELECT *, regexp_replace(form, '^/', '') AS ltrim_one FROM forms),
            unnest(range(1, len(string_split(ltrim_one, '/')) + 1)) AS t(depth)),
    wide AS (
        SELECT host, above, depth FROM (
            SELECT host, above, depth, cell, sum(paths) AS paths FROM cells GROUP BY ALL)
        GROUP BY host, above, depth HAVING count(*) >= {url_filter.BRANCHES} AND avg(paths) < {url_filter.PATHS_PER_BRANCH}),
    general AS (
        SELECT host, form, depth, CASE WHEN EXISTS (SELECT 1 FROM wide WHERE wide.host = cells.host AND wide.above = cells.above
            AND wide.depth = cells.depth) THEN '*' ELSE cell END AS cell FROM cells),
    marked AS (
        SELECT *, max(depth) FILTER (cell <> '' AND NOT regexp_full_match(cell, '[#*.a-z]*[#*][#*.a-z]*'))
            OVER (PARTITION BY host, form) AS hole FROM general),
    shaped AS (
        SELECT host, form, string_agg(cell, '/' ORDER BY depth) AS template,
            string_agg(CASE WHEN depth = hole THEN '{{}}' ELSE cell END, '/' ORDER BY depth) AS family
        FROM marked GROUP BY host, form),
    own AS (
        SELECT host, family, template, sum(labelled) AS labelled, sum(bad) AS bad
        FROM shaped JOIN forms USING (host, form) GROUP BY ALL),
    shares AS (
        SELECT *, sum(bad) OVER (PARTITION BY host, family) / nullif(sum(labelled) OVER (PARTITION BY host, family), 0) AS joint
        FROM own),
    merged AS (
        SELECT *, coalesce(abs(bad / labelled - joint) <= {url_filter.SIMILAR} * sqrt(joint * (1 - joint) / labelled), false) AS near
        FROM (SELECT * REPLACE (nullif(labelled, 0) AS labelled) FROM shares)),
    judged AS (
        SELECT host, template, (sum(coalesce(labelled, 0) - bad) OVER branch + {url_filter.SMOOTHING})
            / (sum(coalesce(labelled, 0)) OVER branch + 2 * {url_filter.SMOOTHING}) < 0.5 AS rejected
        FROM merged WINDOW branch AS (PARTITION BY host, near, CASE WHEN near THEN family ELSE template END))
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
    FROM ruled LEFT JOIN shaped USING (host, form) LEFT JOIN judged USING (host, template)
""")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read(spark, sf_dir, "pages"), URL_RULES)


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_exact_dedup", r"""
    WITH digests AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
            sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
        FROM documents),
    grouped AS (
        SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
            first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
        FROM digests)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(read(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(read(spark, sf_dir, "documents"))


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op10_simhash_links")
def op10_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.linked(read(spark, sf_dir, "documents"))
    return linked.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: CRC-32 in SQL: the table of steps made from the polynomial (a relation to join), then one step per byte.
_CRC_SQL = """
    steps AS (
        SELECT list(c ORDER BY i) AS crc_steps FROM (
            SELECT i, list_reduce(list_prepend(i, range(8)),
                lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
            FROM (SELECT unnest(range(256)) AS i)))"""


def _crc_sql(text: str) -> str:
    hexed = f"hex(encode({text}))"
    byte = f"list_transform(range(1, length({hexed}), 2), lambda i: CAST('0x' || substr({hexed}, i, 2) AS BIGINT))"
    step = "lambda a, b: xor(crc_steps[xor(a & 255, b) + 1], a >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), {step}), 4294967295)"


@query("op11_prefix_trie", f"""
    WITH {_CRC_SQL},
    turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
        SELECT conv_id, conv_id - conv_id % 5 AS base_id, {_crc_sql("conv_id::VARCHAR")} % 9 AS head
        FROM (SELECT DISTINCT conv_id FROM turns), steps),
    kept AS (
        SELECT conv_id, base_id, head, least(head, (SELECT count(*) FROM turns WHERE turns.conv_id = base_id)) AS kept FROM convs),
    rebuilt AS (
        SELECT kept.conv_id, place AS depth, role, text FROM kept JOIN turns ON turns.conv_id = base_id WHERE place <= kept
        UNION ALL SELECT conv_id, kept + place - head, role, text FROM kept JOIN turns USING (conv_id) WHERE place > head),
    prefixes AS (
        SELECT conv_id, 0 AS depth, [] AS path, 0 AS bytes FROM convs
        UNION ALL SELECT conv_id, depth, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY depth),
            strlen(text) FROM rebuilt),
    ends AS (SELECT conv_id, max(depth) AS total FROM prefixes GROUP BY conv_id),
    nodes AS (
        SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
            string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = total) AS ids
        FROM prefixes JOIN ends USING (conv_id) GROUP BY depth, path),
    sized AS (
        SELECT a.*, (SELECT count(*) FROM nodes b WHERE b.depth = a.depth + 1 AND b.path[1:a.depth] = a.path) AS n_children,
            (SELECT c.conv_id FROM nodes c WHERE c.depth = a.depth - 1 AND c.path = a.path[1:a.depth - 1]) AS parent_conv_id
        FROM nodes a)
    SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, any_value(a.parent_conv_id) AS parent_conv_id,
        any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
        count(CASE WHEN b.n_children = 0 THEN 1 END) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens,
        sha256(coalesce(any_value(a.ids), '')) AS ends_sha256
    FROM sized a JOIN sized b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path
    GROUP BY a.conv_id, a.depth
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.prefix_trie(
        read(spark, sf_dir, "conversations"), lambda conv: conv - conv % 5,
        lambda conv: F.crc32(conv.cast("string")) % 9)
    return nodes.drop("from_conv", "from_at")


@query("op12_suffix_dedup")
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.without_repeats(read(spark, sf_dir, "documents"), 50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span.high - span.low)
    return kept.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_importance", f"""
    WITH {_CRC_SQL},
    source AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    target AS (
        SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
    counted AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM source) GROUP BY ALL),
    aimed AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM target) GROUP BY ALL),
    hashed AS (
        SELECT word, {_crc_sql("word")} % 10000 AS bucket
        FROM (SELECT word FROM counted UNION SELECT word FROM aimed), steps),
    sums AS (
        SELECT bucket, sum(s) AS s, sum(t) AS t FROM (
            SELECT bucket, n AS s, 0 AS t FROM counted JOIN hashed USING (word)
            UNION ALL SELECT bucket, 0, n FROM aimed JOIN hashed USING (word)) GROUP BY bucket),
    gains AS (
        SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE
            / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sums),
    weighed AS (
        SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS n
        FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
    scored AS (
        SELECT doc_id, len(words) AS n_features,
            CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
            CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
        FROM source LEFT JOIN weighed USING (doc_id)),
    noisy AS (
        SELECT doc_id, n_features, weight,
            weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
    ranked AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
        FROM noisy WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
    FROM noisy LEFT JOIN ranked USING (doc_id)
""")
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
