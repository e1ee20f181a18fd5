"""The URL filter's definition as one DuckDB query over `pages` and `labels`,
with window functions where the operator aggregates and joins."""

from __future__ import annotations

from .url_filter import LEVELS, RULES


def _level(d: int, support: int, weight: float, z: float) -> str:
    before = f"tree{d - 1}" if d else "start"
    part = f"COALESCE(parts[{d}], '')"
    template = "''" if not d else (
        f"CASE WHEN len(parts) < {d} THEN template ELSE template || '/' || CASE WHEN "
        f"SUM(n) OVER (PARTITION BY host, template, {part}) < {support} THEN '*' ELSE {part} END END")
    own = "(g + {w} * above) / (k + {w})".format(w=weight)
    return f"""
named{d} AS (
  SELECT * EXCLUDE (template), template AS parent, {template} AS template FROM {before}
),
branch{d} AS (
  SELECT host, parent, template, SUM(labelled) AS k, SUM(good) AS g, MAX(purity) AS above
  FROM named{d} GROUP BY ALL
),
binned{d} AS (
  SELECT host, parent, bin, SUM(k) AS k, SUM(g) AS g, MAX(above) AS above
  FROM (SELECT *, floor({own} * {LEVELS}) AS bin FROM branch{d} WHERE k > 0) GROUP BY ALL
),
apart{d} AS (
  SELECT *, LAG(k) OVER beside AS k0, LAG(g) OVER beside AS g0, (g + g0) / (k + k0) AS r,
         k0 IS NULL OR abs(g / k - g0 / k0) >= {z} * sqrt(greatest(r * (1 - r), 1e-4) * (1 / k + 1 / k0)) AS new
  FROM binned{d} WINDOW beside AS (PARTITION BY host, parent ORDER BY bin)
),
cluster{d} AS (
  SELECT *, SUM(new::INT) OVER (PARTITION BY host, parent ORDER BY bin) AS c FROM apart{d}
),
pooled{d} AS (
  SELECT host, parent, bin,
         CASE WHEN abs(tg / tk - ta) / sqrt(greatest(ta * (1 - ta), 1e-4) / tk) < {z} THEN ta
              ELSE (tg + {weight} * ta) / (tk + {weight}) END AS now
  FROM (SELECT host, parent, bin, SUM(k) OVER w AS tk, SUM(g) OVER w AS tg, MAX(above) OVER w AS ta
        FROM cluster{d} WINDOW w AS (PARTITION BY host, parent, c))
),
tree{d} AS (
  SELECT m.host, m.shape, m.n, m.labelled, m.good, m.parts, m.template, COALESCE(p.now, b.above) AS purity
  FROM named{d} m
  JOIN branch{d} b USING (host, parent, template)
  LEFT JOIN pooled{d} p ON b.k > 0 AND p.host = b.host AND p.parent = b.parent
                       AND p.bin = floor((b.g + {weight} * b.above) / (b.k + {weight}) * {LEVELS})
)"""


def oracle(least: float = 0.5, depth: int = 4, support: int = 5, weight: float = 10.0, z: float = 2.0) -> str:
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, v)
            for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    levels = ",".join(_level(d, support, weight, z) for d in range(depth + 1))
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
page AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
),
mark AS (
  SELECT p.page_id, bool_and(l.quality = 1 AND COALESCE(l.toxic, 0) = 0) AS fine
  FROM page p JOIN labels l ON l.doc_id = TRY_CAST(regexp_extract(p.path, '([0-9]{{1,18}})[^0-9/]*/?$', 1) AS BIGINT)
  WHERE l.quality IS NOT NULL GROUP BY ALL
),
shaped AS (
  SELECT page.*, regexp_replace(path, '[0-9]+', '#', 'g') AS shape, mark.fine FROM page LEFT JOIN mark USING (page_id)
),
start AS (
  SELECT host, shape, COUNT(*)::DOUBLE AS n, COUNT(fine)::DOUBLE AS labelled, (COUNT(*) FILTER (fine))::DOUBLE AS good,
         string_split(regexp_replace(shape, '^/', ''), '/') AS parts, '' AS template,
         (SELECT CASE WHEN COUNT(fine) = 0 THEN 1.0 ELSE (COUNT(*) FILTER (fine) + 1.0) / (COUNT(fine) + 1.0) END FROM shaped) AS purity
  FROM shaped GROUP BY ALL
),{levels}
SELECT page_id, host, path, {rule} AS rule,
       {verdict} WHEN purity < {least} THEN 'block' ELSE 'allow' END AS verdict
FROM shaped LEFT JOIN tree{depth} USING (host, shape)"""
