"""Oracle CTEs (DuckDB SQL) for the skills -> risk chain."""

from __future__ import annotations

from workrisk.plans import oracle_exposure  # noqa: F401  (occupations CTE)
from workrisk.plans.sql import register

CATS = ["basic_skills", "cognitive_skills", "social_skills", "operations_skills",
        "maintenance_skills", "technical_skills", "management_skills"]
REFERENCE_AREA = "NATION_0"


def norm(c: str) -> str:
    return f"(({c} - 1.0) / 4.0)"


def logistic(x: str) -> str:
    return f"round_even(100.0 / (1.0 + exp(-4.0 * (({x}) - 0.40))), 1)"


register("skills_imp", ("skills_long",), "SELECT * FROM skills_long WHERE scale = 'Importance'")

register("cats", ("skills_imp", "skill_categories"), "SELECT onet_code, title, "
         + ", ".join(f"avg(value) FILTER (WHERE category = '{c}') AS {c}" for c in CATS)
         + " FROM skills_imp JOIN skill_categories USING (element) GROUP BY onet_code, title")

_b, _cg, _so, _op, _mt, _te, _mg = (norm(c) for c in CATS)
_raw_long = (f"(0.5 * {_op} + 0.5 * {_mt}) * 0.55 + (1 - (0.4 * {_so} + 0.3 * {_mg} + 0.2 * {_cg} + 0.1 * {_b})) * 0.30"
             f" + (1 - (0.3 * {_te} + 0.1 * {_cg})) * 0.15")
_growth = (f"(coalesce(regexp_matches(title, '(?i)(?:nurs|therap|counsel|teacher|educat|ai\\b|ml\\b|machine learning|"
           f"data|cyber|engineer|developer|analyst|renewable|solar|wind|green|sustain|project manager|"
           f"operations manager)'), false) AND ({_so} >= 0.60 OR {_te} >= 0.60))")

register("long_risk", ("cats",), f"""
  SELECT * EXCLUDE (raw), round_even(raw * 100.0, 1) AS automation_risk, {logistic('raw')} AS automation_risk_score
  FROM (SELECT *, coalesce({_growth}, false) AS growth_discounted,
               CASE WHEN {_growth} THEN ({_raw_long}) * 0.70 ELSE {_raw_long} END AS raw FROM cats)""")

_human = f"CASE WHEN {_so} IS NULL OR {_mg} IS NULL THEN NULL ELSE greatest({_so}, {_mg}) END"
_tc = f"({_te} / NULLIF({_te} + {_mg} + {_so} + {_mt}, 0))"
register("short_risk", ("cats",), f"""
  SELECT *, round_even({_tc} * 0.5 + (1 - (0.3 * {_op} + 0.7 * {_mt})) * 0.3 + (1 - {_human}) * 0.2, 2)
           AS intermediate_automation_risk
  FROM cats""")

register("blended", ("short_risk", "occupations"), f"""
  SELECT * EXCLUDE (occ, susc, p90), {logistic('automation_risk')} AS automation_risk_score FROM (
    SELECT s.*, a.susc, p.p90, split_part(s.onet_code, '.', 1) AS occ,
           CASE WHEN s.technical_skills >= p.p90 AND a.susc IS NOT NULL
                THEN s.intermediate_automation_risk * 0.2 + a.susc / 100.0 * 0.8
                ELSE s.intermediate_automation_risk END AS automation_risk
    FROM short_risk s
    LEFT JOIN (SELECT OCC_CODE, arg_min(automation_susceptibility, SOC_Code_Cleaned) AS susc FROM occupations
               WHERE AREA_TITLE = '{REFERENCE_AREA}' GROUP BY OCC_CODE) a ON split_part(s.onet_code, '.', 1) = a.OCC_CODE,
         (SELECT quantile_cont(technical_skills, 0.9) AS p90 FROM short_risk) p)""")

register("missing_codes", ("occupations", "blended"), """
  SELECT wc, t FROM (SELECT OCC_CODE || '.00' AS wc, arg_min(OCC_TITLE, AREA_TITLE) AS t FROM occupations
                     GROUP BY OCC_CODE)
  WHERE wc NOT IN (SELECT onet_code FROM blended)""")

# Brute force over all (missing, available) pairs: the oracle of the prefix-join operator.
register("nearest", ("blended", "missing_codes"), """
  SELECT wc, c AS match, l AS common_length FROM (
    SELECT *, row_number() OVER (PARTITION BY wc ORDER BY (wc = c) DESC, diff ASC NULLS LAST, c) AS rn FROM (
      SELECT *, CASE WHEN l < length(wc) AND l < length(c) THEN
                  CASE WHEN regexp_matches(substring(wc, l + 1, 1), '^[0-9]$')
                             AND regexp_matches(substring(c, l + 1, 1), '^[0-9]$')
                       THEN abs(CAST(substring(wc, l + 1, 1) AS INTEGER) - CAST(substring(c, l + 1, 1) AS INTEGER))
                       ELSE abs(ascii(substring(wc, l + 1, 1)) - ascii(substring(c, l + 1, 1))) END END AS diff
      FROM (SELECT *, max(l) OVER (PARTITION BY wc) AS lmax FROM (
              SELECT w.wc, a.c,
                     (SELECT coalesce(max(k), 0) FROM range(1, least(length(w.wc), length(a.c)) + 1) r(k)
                      WHERE substring(w.wc, 1, k) = substring(a.c, 1, k)) AS l
              FROM (SELECT DISTINCT wc FROM missing_codes) w,
                   (SELECT DISTINCT onet_code AS c FROM blended) a))
      WHERE l = lmax)) WHERE rn = 1""")

register("backfilled", ("blended", "nearest", "missing_codes"), """
  SELECT *, false AS missing_job FROM blended
  UNION ALL BY NAME
  SELECT b.* REPLACE (m.wc AS onet_code, m.t AS title), true AS missing_job
  FROM nearest n JOIN missing_codes m ON n.wc = m.wc
  JOIN (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY onet_code ORDER BY title NULLS LAST) AS rn
                       FROM blended) WHERE rn = 1) b ON n.match = b.onet_code""")

register("skills_risk", ("backfilled", "tech"), """
  SELECT j.* REPLACE (coalesce(j.adoption_rate, m.med) AS adoption_rate)
  FROM (SELECT b.*, t.hot_tech_ratio AS adoption_rate FROM backfilled b LEFT JOIN tech t
        ON b.onet_code = t.onet_code) j,
       (SELECT quantile_cont(t.hot_tech_ratio, 0.5) AS med FROM backfilled b LEFT JOIN tech t
        ON b.onet_code = t.onet_code) m""")
