"""SQL twins of ``workrisk.sources.domain`` for the DuckDB oracle.

``with_views(body, *names)`` prepends the CTEs ``names`` need (in dependency
order) to an oracle query body. The driver tables are pre-registered views.
"""

from __future__ import annotations

PART_CODE = "printf('%02d-%02d%06d', CAST(substring(p_brand, 7, 10) AS INTEGER), p_size, p_partkey)"
BRAND = "CAST(substring(p_brand, 7, 10) AS INTEGER)"
VEC_CODE = f"CASE WHEN p_partkey IS NULL THEN printf('00-00%06d.00', vec_id) ELSE {PART_CODE} || '.00' END"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


_view("employment", (), f"""
  SELECT CASE WHEN g_area = 1 THEN 'U.S.' ELSE n_name END AS AREA_TITLE,
         CASE WHEN g_part = 1 THEN '00-0000' ELSE {PART_CODE} END AS OCC_CODE,
         CASE WHEN g_part = 1 THEN 'All Occupations' ELSE p_name END AS OCC_TITLE,
         CASE WHEN g_part = 1 THEN 'total'
              WHEN {BRAND} % 5 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'major' ELSE 'broad' END
              WHEN p_partkey % 10 < 8 THEN 'detailed'
              WHEN p_partkey % 10 = 8 THEN 'broad' ELSE 'major' END AS O_GROUP,
         CASE WHEN g_part = 0 AND p_partkey % 7 = 0 THEN '*'
              ELSE format('{{:,}}', qty * 10) END AS TOT_EMP,
         CASE WHEN g_part = 1 THEN format('{{:,}}', (cents * 2) // (qty * 5))
              WHEN g_area = 1 AND p_partkey % 38 = 0 THEN '#'
              WHEN g_area = 0 AND p_partkey % 19 = 0 THEN '#'
              WHEN g_area = 0 AND p_partkey % 23 = 0 THEN '0'
              ELSE format('{{:,}}', (cents * 2) // (qty * 5)) END AS A_MEAN
  FROM (
    SELECT n_name, l_partkey, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(cents) AS BIGINT) AS cents,
           grouping(n_name) AS g_area, grouping(l_partkey) AS g_part
    FROM (SELECT n_name, l_partkey, CAST(l_quantity AS BIGINT) AS qty,
                 CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) f
    GROUP BY GROUPING SETS ((n_name, l_partkey), (l_partkey), (n_name), ())
  ) a LEFT JOIN part ON a.l_partkey = part.p_partkey""")

_TECH = f"""
  SELECT {PART_CODE} AS SOC_Code, {PART_CODE} || '.00' AS onet_code,
         CAST(p_size AS DOUBLE) AS tech_intensity_score,
         CAST(p_partkey % 11 AS DOUBLE) / 10.0 AS hot_tech_ratio,
         CAST(p_size * 3 AS BIGINT) AS total_technologies,
         CAST((p_size * 3 * (p_partkey % 11)) // 10 AS BIGINT) AS hot_technologies
  FROM part"""
_view("all_tech", (), _TECH)
_view("tech", (), _TECH + " WHERE p_partkey % 13 <> 0")

_view("apps", (), f"""
  SELECT printf('%02d-0000', b) AS soc_code, printf('%02d', b) AS major_group,
         count(*) AS estimated_apps
  FROM (SELECT {BRAND} AS b FROM part) p WHERE b % 4 <> 0 GROUP BY b""")

_view("sector", (), f"""
  SELECT {PART_CODE} || '.00' AS onet_code, p_name AS title,
         CASE WHEN p_partkey % 17 <> 0 THEN p_type END AS sector
  FROM part""")

_view("skills_long", (), f"""
  SELECT onet_code, title, printf('skill_%02d', pos) AS element, s.scale,
         CASE WHEN s.scale = 'Importance' THEN v ELSE v * 0.9 END AS value
  FROM (SELECT {VEC_CODE} AS onet_code, coalesce(p_name, 'vector ' || vec_id) AS title, u.pos - 1 AS pos,
               least(5.0, greatest(1.0, CAST(u.x AS DOUBLE) * 12.0 + 3.0)) AS v
        FROM (SELECT * FROM embeddings LEFT JOIN part ON vec_id = p_partkey) p,
             LATERAL (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos) u) e,
       (VALUES ('Importance'), ('Level')) s(scale)""")

_view("skill_categories", (), """
  SELECT printf('skill_%02d', i) AS element,
         ['basic_skills', 'cognitive_skills', 'social_skills', 'operations_skills',
          'maintenance_skills', 'technical_skills', 'management_skills'][(i % 7) + 1] AS category
  FROM range(64) t(i)""")

_view("part_jobs", (), f"""
  SELECT {VEC_CODE} AS onet_code, CAST(vec_id % 11 AS DOUBLE) / 10.0 AS hot_tech_ratio,
         CAST(coalesce(p_size, 0) AS DOUBLE) AS tech_intensity_score
  FROM embeddings LEFT JOIN part ON vec_id = p_partkey""")

_view("soc_titles", (), f"SELECT {PART_CODE} || '.00' AS onet_code, p_name AS title FROM part")

_view("score_labels", (), """
  SELECT d.doc_id, CAST(n_chars AS DOUBLE) AS score, toxic AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")


def register(name: str, deps: tuple[str, ...], sql: str) -> None:
    """Add a derived view (used by operator modules for shared intermediate CTEs)."""
    _view(name, deps, sql)


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str) -> str:
    parts = [f"{n} AS ({VIEWS[n][1]}\n)" for n in _order(names)]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
