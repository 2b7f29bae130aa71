"""Queries pN_... of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .frequency import count_terms, mark_terms
from .history import rows_without_new_content
from .main_body import main_body, not_main_body
from .near_duplicates import near_duplicate_pairs
from .packing import pack
from .repeated_lines import repeated_lines, without_repeated_lines
from .tokenizer import encode_corpus
from .visual_form import canonical_text, lookalike_pairs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(_table(spark, sf_dir, "snapshot_documents"), threshold=0.5, width=3)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(_table(spark, sf_dir, "snapshot_documents"))


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(_table(spark, sf_dir, "snapshot_documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_terms(_table(spark, sf_dir, "snapshot_documents"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_terms(_table(spark, sf_dir, "snapshot_documents")).drop("term_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_main_body(_table(spark, sf_dir, "snapshot_documents"))


def p4_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body(_table(spark, sf_dir, "snapshot_documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, batches = _table(spark, sf_dir, "snapshot_documents"), _table(spark, sf_dir, "snapshot_batches")
    return rows_without_new_content(history, batches, threshold=0.5, width=3)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(_table(spark, sf_dir, "documents"))


def p8_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p2_cleaned": p2_cleaned,
        "p3_found": p3_found,
        "p3_counts": p3_counts,
        "p4_found": p4_found,
        "p4_body": p4_body,
        "p5_found": p5_found,
        "p6_ids": p6_ids,
        "p7_containers": p7_containers,
        "p8_found": p8_found,
        "p8_canonical": p8_canonical,
    }


_ONCE = "SELECT id, any_value(url) AS url, any_value(content) AS content, any_value(tokens) AS tokens FROM snapshot_documents GROUP BY id"

#: The characters with the Unicode property White_Space but the line feed, as a class of the regular expressions.
_BLANKS = r"[\t\x{0B}\x{0C}\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_LINES = rf"""
once AS ({_ONCE}),
sites AS (
  SELECT id, content, regexp_replace(regexp_extract(lower(trim(url)), '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '') AS site
  FROM once WHERE content IS NOT NULL),
split AS (SELECT id, site, string_split(content, chr(10)) AS ls FROM sites WHERE site <> ''),
lines AS (
  SELECT id, site, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM split),
folded AS (
  SELECT id, site, line_no, lower(trim(regexp_replace(line, '{_BLANKS}+', ' ', 'g'))) AS line FROM lines),
hot AS (
  SELECT site, line FROM folded WHERE line <> '' GROUP BY site, line HAVING count(DISTINCT id) >= 8),
found AS (SELECT id, CAST(line_no AS INTEGER) AS line_no FROM folded JOIN hot USING (site, line))"""

_TERMS = f"""
once AS ({_ONCE}),
t AS (SELECT id, unnest(tokens) AS term FROM once),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT id) AS records FROM t WHERE term IS NOT NULL AND term <> '' GROUP BY term)"""


_PAIRS = f"""
once AS ({_ONCE}),
w AS (SELECT id, list_transform(regexp_extract_all(coalesce(content, ''), '[a-zA-Z0-9]+'), lambda x: lower(x)) AS w FROM once),
runs AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS r FROM w WHERE len(w) >= 3),
s AS (SELECT id, len(r) AS n, unnest(r) AS run FROM runs),
p AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS n, b.n AS m, count(*) AS common FROM s a JOIN s b ON a.run = b.run AND a.id < b.id GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_PAIRS} SELECT id_a, id_b FROM p WHERE 2 * common >= n + m - common",
        "p2_found": f"WITH {_LINES} SELECT id, line_no FROM found",
        "p2_cleaned": f"""WITH {_LINES},
cut AS (SELECT id, list(line_no) AS cut FROM found GROUP BY id)
SELECT once.id AS id, CASE WHEN cut.cut IS NULL THEN once.content ELSE
  array_to_string(list_filter(string_split(once.content, chr(10)), lambda x, i: NOT list_contains(cut.cut, i)), chr(10)) END AS content
FROM once LEFT JOIN cut ON once.id = cut.id""",
        "p3_found": f"""WITH {_TERMS}
SELECT term, CASE WHEN records <= 2 THEN 'rare' ELSE 'common' END AS mark FROM c
WHERE records <= 2 OR records > 0.2 * (SELECT count(*) FROM once)""",
        "p3_counts": f"WITH {_TERMS} SELECT term, occurrences, records FROM c",
    }
