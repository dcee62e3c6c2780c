"""All core queries by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from sizelake.operators import quantities, snapshot_diff
from sizelake.plans import amount_sql, details, documents, registry, review, tables_and_trends, values, workflow  # noqa: F401

QUERIES = registry.QUERIES | {
    "p1_found": quantities.p1_found,
    "p1_amounts": quantities.p1_amounts,
    "p4_found": snapshot_diff.p4_found,
    "p4_counts": snapshot_diff.p4_counts,
}
# Canonical rows in SQL: per row the sorted list of its non-null properties, numbers as doubles. Only what json_valid accepts.
_P4 = """
WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC, created_at DESC) AS k FROM project_revisions WHERE id IS NOT NULL) WHERE k = 1),
 full_ AS (SELECT id, project_id, created_at, CASE WHEN json_valid(snapshot_content) THEN snapshot_content->>'$.dinhCoHeThongContent' END AS l FROM last
   WHERE project_id IS NOT NULL AND (revision_type IS NULL OR upper(trim(revision_type)) IN ('BASELINE', '')) AND json_valid(snapshot_content)),
 ok AS (SELECT *, lag(id) OVER (PARTITION BY project_id ORDER BY created_at NULLS FIRST, id) AS prev FROM full_ WHERE l IS NULL OR json_valid(l)),
 r AS (SELECT id, unnest(CAST(l AS JSON[])) AS j FROM ok WHERE l IS NOT NULL),
 h AS (SELECT id, j->>'$.ma' AS ma, array_to_string(list_sort(list_transform(list_filter(json_keys(j), lambda k: json_type(j, '$."' || k || '"') <> 'NULL'),
     lambda k: k || '=' || CASE WHEN json_type(j, '$."' || k || '"') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(CAST(j->>('$."' || k || '"') AS DOUBLE) AS VARCHAR) ELSE j->>('$."' || k || '"') END)), chr(1)) AS c FROM r WHERE j->>'$.ma' IS NOT NULL),
 g AS (SELECT id, ma, array_to_string(list_sort(list_distinct(list(c))), chr(2)) AS c FROM h GROUP BY 1, 2),
 n AS (SELECT ok.id AS rev, g.ma, g.c FROM ok JOIN g ON g.id = ok.id WHERE ok.prev IS NOT NULL), o AS (SELECT ok.id AS rev, g.ma, g.c FROM ok JOIN g ON g.id = ok.prev)
SELECT rev AS revision_id, ma, CASE WHEN o.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' ELSE 'changed' END AS change_type FROM n FULL JOIN o USING (rev, ma) WHERE n.c IS DISTINCT FROM o.c"""
ORACLE: dict[str, str] = registry.ORACLE | {"p1_found": amount_sql.P1_FOUND, "p4_found": _P4, "p4_counts": f"SELECT change_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT revision_id) AS BIGINT) AS revisions FROM ({_P4}) GROUP BY 1"}
FLAGSHIP = "rule_outcomes"
