"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

_CALLS = r"""
plain AS (
  SELECT variant_id, pos, sample_id,
    regexp_replace(lower(regexp_replace(chrom, '[^\p{L}\p{N}]+', '', 'g')), '^chr', '') AS c,
    lower(regexp_replace(ref, '[^\p{L}\p{N}*]+', '', 'g')) AS r,
    list_sort(list_filter(list_transform(string_split_regex(alt, '[,;|/]'), lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}*]+', '', 'g'))), lambda x: x <> '')) AS a,
    list_sort(list_filter(list_transform(string_split_regex(info, '[,;|]'), lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}=]+', '', 'g'))), lambda x: x <> '')) AS i
  FROM variants
)
"""

_NAMES = r"""
known AS (SELECT DISTINCT upper(regexp_replace(name2, '[^\p{L}\p{N}]+', '', 'g')) AS name, name2 AS symbol FROM gene_models WHERE name2 IS NOT NULL),
dictionary AS (
  SELECT * FROM known UNION
  SELECT upper(regexp_replace(other_name, '[^\p{L}\p{N}]+', '', 'g')) AS name, gene_symbol AS symbol FROM gene_aliases
  WHERE gene_symbol IN (SELECT symbol FROM known) AND upper(regexp_replace(other_name, '[^\p{L}\p{N}]+', '', 'g')) NOT IN (SELECT name FROM known)
),
parts AS (
  SELECT syn_id, upper(regexp_replace(regexp_replace(part, '(?i)^[^\p{L}\p{N}]*(gene|genes|symbol|locus)([^\p{L}\p{N}]|$)', ''), '[^\p{L}\p{N}]+', '', 'g')) AS name
  FROM (SELECT syn_id, unnest(string_split_regex(gene_id, '[,;/|]')) AS part FROM synonymous
        WHERE gene_id NOT IN (SELECT symbol FROM known))
)
"""

_GROUPS = r"""
every AS (
  SELECT syn_id, upper(regexp_replace(regexp_replace(part, '(?i)^[^\p{L}\p{N}]*(gene|genes|symbol|locus)([^\p{L}\p{N}]|$)', ''), '[^\p{L}\p{N}]+', '', 'g')) AS name
  FROM (SELECT syn_id, unnest(string_split_regex(gene_id, '[,;/|]')) AS part FROM synonymous)
),
links AS (SELECT syn_id, coalesce(symbol, '?' || e.name) AS entity FROM every e LEFT JOIN dictionary d ON e.name = d.name WHERE e.name <> ''),
ties AS (SELECT DISTINCT a.entity AS x, b.entity AS y FROM links a JOIN links b USING (syn_id)),
reach(x, y) AS (SELECT x, y FROM ties UNION SELECT r.x, t.y FROM reach r JOIN ties t ON r.y = t.x),
lowest AS (SELECT x AS entity, min(y) AS component FROM reach GROUP BY x),
groups AS (SELECT s.syn_id, coalesce(min(component), '#' || s.syn_id) AS group_id FROM synonymous s LEFT JOIN links USING (syn_id) LEFT JOIN lowest USING (entity) GROUP BY s.syn_id)
"""

_CHANGES = r"""
bare AS (
  SELECT row_id, split_name, source, split_name = 'train' AS is_train, CAST(pos AS BIGINT) AS pos,
    regexp_replace(upper(regexp_replace(chrom, '[\s\x{A0}]+', '', 'g')), '^CHR', '') AS chrom,
    coalesce(upper(regexp_replace(ref, '[\s\x{A0}]+', '', 'g')), '') AS ref,
    string_split(upper(regexp_replace(alt, '[\s\x{A0}]+', '', 'g')), ',')[1] AS alt
  FROM split_rows WHERE split_name IN ('train', 'valid', 'test')
),
ended AS (
  SELECT * REPLACE (ref[:length(ref) - n] AS ref, alt[:length(alt) - n] AS alt) FROM (
    SELECT *, coalesce(list_max(list_filter(range(1, least(length(ref), length(alt))), lambda i: right(ref, i) = right(alt, i))), 0) AS n FROM bare
    WHERE chrom <> '' AND alt <> '' AND pos IS NOT NULL)
),
changes AS (
  SELECT row_id, split_name, source, is_train, chrom, alt[n + 1:] AS alt, pos + n AS pos FROM (
    SELECT *, coalesce(list_max(list_filter(range(1, least(length(ref), length(alt))), lambda i: left(ref, i) = left(alt, i))), 0) AS n
    FROM (SELECT * EXCLUDE (n) FROM ended))
),
pairs AS (
  SELECT t.row_id AS train_id, e.row_id AS eval_id, abs(t.pos - e.pos) AS apart
  FROM changes t JOIN changes e ON t.chrom = e.chrom AND t.alt = e.alt AND e.pos BETWEEN t.pos - 1 AND t.pos + 1
  WHERE t.is_train AND NOT e.is_train
)
"""

_PASSAGES = r"""
doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(
    regexp_replace(regexp_replace(text, '\([^()\[\]]*\)|\[[^()\[\]]*\]', ' ', 'g'), '\([^()\[\]]*\)|\[[^()\[\]]*\]', ' ', 'g')
  ), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
),
item_words AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_passages),
doc_runs AS (SELECT doc_id, hash(w[i:i + 9]) AS h, w[i:i + 9] AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM doc_words)),
item_runs AS (SELECT item_id, hash(w[i:i + 9]) AS h, w[i:i + 9] AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM item_words))
"""

ORACLE = {
    "p1_found": f"""WITH {_CALLS} SELECT kept_id, variant_id AS copy_id FROM (
        SELECT variant_id, min(variant_id) OVER (PARTITION BY pos, sample_id, c, r, a, i) AS kept_id FROM plain) WHERE kept_id <> variant_id""",
    "p1_calls": f"WITH {_CALLS} SELECT min(variant_id) AS variant_id, count(*) AS copies FROM plain GROUP BY pos, sample_id, c, r, a, i",
    "p2_found": f"WITH {_NAMES} SELECT DISTINCT syn_id, symbol AS gene_symbol FROM parts JOIN dictionary USING (name)",
    "p2_groups": f"WITH RECURSIVE {_NAMES}, {_GROUPS} SELECT syn_id, group_id FROM groups",
    "p2_kept": f"WITH RECURSIVE {_NAMES}, {_GROUPS} SELECT CAST(count(*) AS BIGINT) AS n_records, count(DISTINCT group_id) AS n_groups, count(DISTINCT group_id) AS n_in_one_split FROM groups",
    "p3_found": f"WITH {_CHANGES} SELECT least(train_id, eval_id) AS row_id_a, greatest(train_id, eval_id) AS row_id_b FROM pairs",
    "p3_report": f"""WITH {_CHANGES}, best AS (
        SELECT id, min(apart) AS apart FROM (SELECT train_id AS id, apart FROM pairs UNION ALL SELECT eval_id, apart FROM pairs) GROUP BY id)
      SELECT split_name, source, count(*) AS n_rows, count(*) FILTER (apart = 0) AS n_same, count(*) FILTER (apart = 1) AS n_near_only
      FROM changes LEFT JOIN best ON row_id = id GROUP BY ALL""",
    "p6_found": f"WITH {_PASSAGES} SELECT DISTINCT doc_id, item_id FROM doc_runs d JOIN item_runs i ON d.h = i.h AND d.run = i.run",
    "p6_exact_items": f"""WITH {_PASSAGES}, found AS (SELECT DISTINCT doc_id, item_id FROM doc_runs d JOIN item_runs i ON d.h = i.h AND d.run = i.run)
      SELECT item_id, item_set, count(*) AS n_exact FROM found JOIN eval_passages USING (item_id) GROUP BY ALL""",
    "p7_kept": "SELECT source, max_repeats, true AS within_cap, true AS near_share FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE text <> '')",
}
