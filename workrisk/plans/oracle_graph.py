"""Oracle CTEs (DuckDB SQL) for the transition graph: brute-force pairs and a recursive-CTE rank."""

from __future__ import annotations

from workrisk.plans import oracle_skills  # noqa: F401  (long_risk CTE)
from workrisk.plans.sql import register

register("vec_long", ("skills_imp",), """
  SELECT code, element, (x - avg(x) OVER (PARTITION BY element))
           / CASE WHEN stddev_pop(x) OVER (PARTITION BY element) = 0 THEN 1.0
                  ELSE stddev_pop(x) OVER (PARTITION BY element) END AS z
  FROM (SELECT c.code, e.element, coalesce(s.value, 0.0) AS x
        FROM (SELECT DISTINCT onet_code AS code FROM skills_imp) c
        CROSS JOIN (SELECT printf('skill_%02d', i) AS element FROM range(64) t(i)) e
        LEFT JOIN (SELECT onet_code, element, max(value) AS value FROM skills_imp GROUP BY ALL) s
          ON s.onet_code = c.code AND s.element = e.element)""")

register("jobs", ("vec_long", "long_risk", "part_jobs"), """
  SELECT v.code, v.v, r.automation_risk_score AS risk, p.hot_tech_ratio AS hot FROM
    (SELECT code, list(z ORDER BY element) AS v FROM vec_long GROUP BY code) v
  JOIN long_risk r ON r.onet_code = v.code JOIN part_jobs p ON p.onet_code = v.code""")

register("pairs", ("jobs",), """
  SELECT src, dst, sim, cost,
         sim * 0.4 + (1.0 / (1.0 + cost)) * 0.2 + rf * 0.3 + hf * 0.1 AS w FROM (
    SELECT a.code AS src, b.code AS dst,
           coalesce(list_inner_product(a.v, b.v) / NULLIF(sqrt(list_inner_product(a.v, a.v))
                    * sqrt(list_inner_product(b.v, b.v)), 0), 0.0) AS sim,
           list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(x[2] - x[1]) * x[2])) AS cost,
           CASE WHEN a.risk > 0 THEN 1.0 - b.risk / a.risk ELSE 0.0 END AS rf,
           1.0 - abs(a.hot - b.hot) AS hf
    FROM jobs a JOIN jobs b ON a.code <> b.code AND b.risk <= a.risk)""")

register("tmatrix", ("pairs",), """
  SELECT src, dst, w, w / CASE WHEN rs = 0 THEN 1e-10 ELSE rs END AS p
  FROM (SELECT *, sum(w) OVER (PARTITION BY src) AS rs FROM pairs)""")

register("edges", ("tmatrix",), "SELECT src, dst, p AS weight FROM tmatrix WHERE p > 0")

register("ranks", ("edges",), """
  SELECT node, rank FROM (
    WITH RECURSIVE nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
    nn AS (SELECT count(*) AS n FROM nodes),
    el AS (SELECT src, dst, weight FROM edges UNION ALL SELECT node, node, 0.0 FROM nodes),
    pr(it, node, rank) AS (
      SELECT 0, node, 1.0 / (SELECT n FROM nn) FROM nodes
      UNION ALL
      SELECT pr.it + 1, el.dst, 0.15 / (SELECT n FROM nn) + 0.85 * sum(pr.rank * el.weight)
      FROM pr JOIN el ON pr.node = el.src WHERE pr.it < 100 GROUP BY pr.it, el.dst)
    SELECT node, rank FROM pr WHERE it = 100)""")

register("recs", ("edges",), """
  SELECT * FROM (
    SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM edges
    WHERE substring(replace(src, '-', ''), 1, 3) <> substring(replace(dst, '-', ''), 1, 3)
      AND substring(replace(src, '-', ''), 1, 2) = substring(replace(dst, '-', ''), 1, 2))
  WHERE rank <= 5""")

register("rec_skills", ("recs", "jobs"), """
  SELECT r.src, r.dst, k, printf('skill_%02d', k - 1) AS skill, a.v[k] AS s, b.v[k] AS t
  FROM recs r JOIN jobs a ON a.code = r.src JOIN jobs b ON b.code = r.dst, range(1, 65) q(k)""")
