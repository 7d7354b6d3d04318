"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

import math

from . import quality as q

#: Sizes, draws and targets as in mixing.py; the level is that of repeated sharing.
MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS digest,
         coalesce(greatest(1 - 10 * (length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(length(text), 1), 0.05), 0.05)::DOUBLE AS weight
  FROM documents
), k AS (
  SELECT *, -ln((CAST('0x' || substr(digest, 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / weight AS draw FROM d
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM d GROUP BY source
), f AS (
  SELECT *, 2 * source_size AS cap, (sum(source_size) OVER ())::DOUBLE * 150 / 100 AS mix, (2 * source_size)::DOUBLE / w AS fills FROM t
), l AS (
  SELECT *, (mix - coalesce(sum(cap) OVER (ORDER BY fills, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(w) OVER (ORDER BY fills, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM f
), g AS (
  SELECT *, max(CASE WHEN level <= fills THEN level END) OVER () AS found FROM l
), s AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(found * w, cap::DOUBLE)) AS target FROM g
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS epochs FROM s
), o AS (
  SELECT k.*, source_size, target, epochs, target - epochs * source_size AS budget,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY draw, digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, source, size, source_size, target,
       (size * (epochs + CASE WHEN epochs < 2 AND size > 0 AND middle <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""



def _quality() -> str:
    """Measures, sketches of three levels, and fences as in quality.py."""
    value = lambda k, t="": "(" + "({}{} + {})::DOUBLE / nullif({}{} + {}, 0)".format(t, q.RATIOS[k][0], q.RATIOS[k][2], t, q.RATIOS[k][1], q.RATIOS[k][2]) + ")"
    values = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {value(k)} AS value FROM m WHERE NOT base_failed" for k in q.RATIOS)
    levels = " UNION ALL ".join(
        f"SELECT {n} AS level, {lang} AS lang, {source} AS source, measure, bin, n FROM b"
        for n, lang, source in ((0, "lang", "source"), (1, "lang", "NULL"), (2, "NULL", "NULL"))
    )
    at = lambda x: f"pow({q.GAMMA!r}, {x}) * {2 / (q.GAMMA + 1)!r}"
    inside = " AND ".join(
        f"coalesce({value(k, 'm.')} BETWEEN {at(f'({k}.q2 - {k}.reach)') if k in q.TWO_SIDED else '0'} AND {at(f'({k}.q2 + {k}.reach)')}, true)" for k in q.RATIOS
    )
    joins = " ".join(f"LEFT JOIN z AS {k} ON {k}.measure = '{k}' AND {k}.lang IS NOT DISTINCT FROM m.lang AND {k}.source IS NOT DISTINCT FROM m.source" for k in q.RATIOS)
    drawn = ", ".join(
        f"(o.{x} * o.n + (t.{x} * t.n + e.{x} * {q.PRIOR}) / (t.n + {q.PRIOR}) * {q.PRIOR}) / (o.n + {q.PRIOR}) AS {x}" for x in ("q1", "q2")
    )
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid
), m0 AS (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(ls)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON rep.rid = w.rid
), m AS (
  SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed FROM m0
), v AS ({values}), b AS (
  SELECT lang, source, measure, ceil(ln(value) / {math.log(q.GAMMA)!r})::BIGINT AS bin, count(*) AS n FROM v GROUP BY 1, 2, 3, 4
), lv AS (SELECT level, lang, source, measure, bin, sum(n)::BIGINT AS n FROM ({levels}) GROUP BY 1, 2, 3, 4, 5
), cum AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM lv
), qs AS (
  SELECT level, lang, source, measure, max(total)::DOUBLE AS n, min(CASE WHEN upto >= ceil(total * 0.25) THEN bin END)::DOUBLE AS q1,
         min(CASE WHEN upto >= ceil(total * 0.5) THEN bin END)::DOUBLE AS q2 FROM cum GROUP BY 1, 2, 3, 4
), c AS (
  SELECT o.lang, o.source, o.measure, {drawn}
  FROM qs o JOIN qs t ON o.level = 0 AND t.level = 1 AND t.measure = o.measure AND t.lang IS NOT DISTINCT FROM o.lang JOIN qs e ON e.level = 2 AND e.measure = o.measure
), z AS (SELECT lang, source, measure, q2, {q.REACH} * greatest(q2 - q1, 1) AS reach FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept, n_lines FROM m {joins}
"""


ORACLE_SQL = {"op5_quality": _quality(), "op8_mix": MIX}
