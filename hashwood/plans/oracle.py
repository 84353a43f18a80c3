"""The tree's definition as DuckDB SQL, written apart from the engine: windows over whole trees, one CTE per level."""

from __future__ import annotations

#: Levels that the SQL knows; 16 ** 8 keys have one more.
LEVELS = 8


def tree(name: str, source: str, value_text: str = "value::VARCHAR") -> str:
    """CTEs over source, a query of (tree, key, value): {name}_e entries with levels, {name}_s with slots, {name}_pages."""
    case = lambda agg, frame: "CASE level " + " ".join(f"WHEN {k} THEN {agg}(CASE WHEN level > {k} THEN key END) OVER {frame}" for k in range(LEVELS)) + " END"
    parts = [
        f"{name}_src AS MATERIALIZED ({source})",
        f"{name}_h AS (SELECT *, key::VARCHAR AS kt, {value_text} AS vt, sha256(key::VARCHAR) AS h FROM {name}_src)",
        f"{name}_e AS MATERIALIZED (SELECT tree, key, value, kt, vt, (length(h) - length(ltrim(h, '0')))::INT AS level FROM {name}_h)",
        f"{name}_b AS (SELECT *, {case('max', 'l')} AS prev, {case('min', 'r')} AS nxt FROM {name}_e WINDOW l AS (PARTITION BY tree ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY tree ORDER BY key ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))",
        f"{name}_s AS MATERIALIZED (SELECT b.*, p.level AS prev_level, n.level AS next_level, CASE WHEN nxt IS NOT NULL AND (prev IS NULL OR p.level > n.level) THEN nxt END AS low_of, CASE WHEN NOT (nxt IS NOT NULL AND (prev IS NULL OR p.level > n.level)) THEN prev END AS after_key FROM {name}_b b LEFT JOIN {name}_e p ON p.tree = b.tree AND p.key = b.prev LEFT JOIN {name}_e n ON n.tree = b.tree AND n.key = b.nxt)",
    ]
    text = "length(s.kt) || ':' || s.kt || length(s.vt) || ':' || s.vt || coalesce(length(c.hash) || ':' || c.hash, '~')"
    for k in range(LEVELS):
        below = " UNION ALL ".join(f"SELECT tree, hash, low_of, after_key FROM {name}_p{j}" for j in range(k)) or f"SELECT tree, NULL::VARCHAR AS hash, low_of, after_key FROM {name}_s WHERE false"
        parts.append(f"{name}_c{k} AS MATERIALIZED ({below})")
        rows = f"SELECT s.*, c.hash AS next_hash, d.hash AS low_hash, {text} AS txt FROM {name}_s s LEFT JOIN {name}_c{k} c ON c.tree = s.tree AND c.after_key = s.key LEFT JOIN {name}_c{k} d ON d.tree = s.tree AND d.low_of = s.key WHERE s.level = {k}"
        parts.append(f"{name}_p{k} AS MATERIALIZED (SELECT tree, {k}::INT AS level, prev, nxt, low_of, after_key, max(low_hash) AS low, sha256('{k}|' || coalesce(max(low_hash), '~') || '|' || string_agg(txt, '' ORDER BY key)) AS hash, min(key) AS first_key, max(key) AS last_key, count(*) AS n_entries, list(next_hash ORDER BY key) AS nexts, string_agg(kt || '=' || vt, ', ' ORDER BY key) AS listing FROM ({rows}) GROUP BY tree, prev, nxt, low_of, after_key)")
    union = " UNION ALL ".join(f"SELECT * FROM {name}_p{k}" for k in range(LEVELS))
    parts.append(f"{name}_pages AS MATERIALIZED ({union})")
    parts.append(f"{name}_roots AS (SELECT tree, hash AS root FROM {name}_pages WHERE low_of IS NULL AND after_key IS NULL)")
    return ",\n".join(parts)


def with_tree(source: str, query: str, name: str = "t", **options) -> str:
    return f"WITH {tree(name, source, **options)}\n{query}"
