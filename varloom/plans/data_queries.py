"""Registered queries of the general data-preparation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators.badrows import parse_lines, rejected_rows, valid_rows
from varloom.operators.packed import explode_packed
from varloom.support import SPACE, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_packed(table(spark, sf_dir, "allele_freq"), "alt", ["site_id"], value="allele", position="alt_no", min_values=2)


def p4_all_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its place, single values too: the form later joins use."""
    return explode_packed(table(spark, sf_dir, "allele_freq"), "alt", ["site_id"], value="allele", position="alt_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_rows(parse_lines(table(spark, sf_dir, "variant_lines"), "line", ["line_id"]), ["line_id"])


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_rows(parse_lines(table(spark, sf_dir, "variant_lines"), "line", ["line_id"]))


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each file fail for each reason."""
    parsed = parse_lines(table(spark, sf_dir, "variant_lines"), "line", ["line_id", "file_name"])
    return rejected_rows(parsed, ["line_id", "file_name"]).groupBy("file_name", "reason").agg(F.count("*").alias("n"))


QUERIES = {"p4_found": p4_found, "p4_all_values": p4_all_values, "p5_found": p5_found, "p5_loaded": p5_loaded, "p5_reasons": p5_reasons}

_TOKENS = rf"""
tokens AS (
  SELECT site_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
  FROM (
    SELECT site_id, regexp_extract_all(trim_cell, '(?:"[^"]*"|''[^'']*''|<[^>]*>|[^\s\x{{A0}},;|/])+|[,;|/]') AS toks
    FROM (
      SELECT site_id, regexp_replace(regexp_replace(alt, '^{SPACE}+|{SPACE}+$', '', 'g'), '{SPACE}*[,;|/]$', '') AS trim_cell
      FROM allele_freq WHERE alt IS NOT NULL
    )
  )
),
marked AS (
  SELECT *, tok IN (',', ';', '|', '/') AS is_sep,
    lag(tok IN (',', ';', '|', '/')) OVER (PARTITION BY site_id ORDER BY i) AS after_sep
  FROM tokens
),
placed AS (
  SELECT site_id, is_sep, tok,
    1 + sum(CASE WHEN is_sep OR NOT after_sep THEN 1 ELSE 0 END)
          OVER (PARTITION BY site_id ORDER BY i)
      AS alt_no
  FROM (SELECT *, is_sep AS s2 FROM (SELECT site_id, i, tok, is_sep, coalesce(after_sep, true) OR is_sep AS after_sep FROM marked))
),
vals AS (
  SELECT site_id, CAST(alt_no AS BIGINT) AS alt_no,
    regexp_replace(regexp_replace(
      regexp_replace(regexp_replace(tok, '"([^"]*)"', '\1', 'g'), '''([^'']*)''', '\1', 'g'),
      '^{SPACE}+|{SPACE}+$', '', 'g'), '', '') AS allele
  FROM placed WHERE NOT is_sep
)
"""

_LINE = r"""
shaped AS (
  SELECT line_id, file_name, text,
    regexp_full_match(text, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') AS quoted,
    regexp_full_match(text, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*)){9}') AS whole,
    regexp_extract_all(text || chr(9), '(?s)("(?:[^"]|"")*"|[^"\t]*)\t', 1) AS raw
  FROM (SELECT line_id, file_name, regexp_replace(line, '\r$', '') AS text FROM variant_lines WHERE line IS NOT NULL)
  WHERE NOT starts_with(text, '#') AND regexp_matches(text, '[^\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')
),
fielded AS (
  SELECT *, list_transform(raw, lambda f: CASE WHEN starts_with(f, '"') AND length(f) >= 2 THEN replace(f[2:-2], '""', '"') ELSE f END) AS f
  FROM shaped
),
reasoned AS (
  SELECT *, CASE
    WHEN NOT quoted THEN 'quoting'
    WHEN NOT whole THEN 'columns'
    WHEN NOT regexp_full_match(f[1], '(?i)(chr)?([1-9]|1[0-9]|2[0-2]|X|Y|MT)') THEN 'chrom'
    WHEN NOT regexp_full_match(f[2], '0*[0-9]{1,9}') OR NOT coalesce(try_cast(f[2] AS BIGINT), 0) BETWEEN 1 AND 250000000 THEN 'pos'
    WHEN NOT regexp_full_match(f[4], '(?i)[ACGTN]+') THEN 'ref' END AS reason
  FROM fielded
)
"""

ORACLE = {
    "p4_found": f"WITH {_TOKENS} SELECT site_id, alt_no, allele FROM vals WHERE allele <> '' QUALIFY count(*) OVER (PARTITION BY site_id) >= 2",
    "p4_all_values": f"WITH {_TOKENS} SELECT site_id, alt_no, allele FROM vals WHERE allele <> ''",
    "p5_found": f"WITH {_LINE} SELECT line_id, reason FROM reasoned WHERE reason IS NOT NULL",
    "p5_loaded": f"""WITH {_LINE} SELECT line_id, f[1] AS chrom, CAST(f[2] AS BIGINT) AS pos, f[3] AS id, f[4] AS ref, f[5] AS alt,
      try_cast(f[6] AS DOUBLE) AS qual, f[7] AS filter, f[8] AS info, f[9] AS format, f[10] AS sample FROM reasoned WHERE reason IS NULL""",
    "p5_reasons": f"WITH {_LINE} SELECT file_name, reason, count(*) AS n FROM reasoned WHERE reason IS NOT NULL GROUP BY ALL",
}
