"""SQL twins of the isolation forest (from the same portable hashes) and of boosted trees.

``boosted`` grows a few boosted trees from whole sums over (node, feature, value), as ``operators.trees`` does;
``boosted_rounds`` grows them by recursion, a level a step, in any number of rounds.
``ctes`` grows a forest level by level (a level's nodes are an aggregate over the sample rows in them), and
``walk`` scores rows by walking the node table, a join a level.
"""

from __future__ import annotations

from ..functions.hashing import sql_hash_int
from ..operators.anomaly import BILLION, EULER_GAMMA, POOL, SPACE, max_depth


def _path(n: str) -> str:
    """c(n) in SQL."""
    return (f"(CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1.0::DOUBLE) + {EULER_GAMMA}) - 2 * ({n} - 1.0::DOUBLE) / {n} "
            f"WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")


def ctes(rows: str, key: str, features, n_trees: int, period: str = "0", seed: int = 42, sample_size: int = 256) -> str:
    """CTEs ending in ``nodes`` (period, tree, node, f, at, length) and ``psi`` (period, c) for the relation ``rows``."""
    k = len(features)
    xs = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(features))
    lists = lambda f: "[" + ", ".join(f"{f}(x{i})" for i in range(k)) + "]"
    tree_key = "tree || '|' || CAST(k AS VARCHAR)"
    out = [f"""grow_rows AS MATERIALIZED (SELECT {period} AS period, {key} AS k, {xs} FROM {rows}),
 grow_pool AS MATERIALIZED (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY period
   ORDER BY {sql_hash_int('k', f'pool|{seed}')}, k) AS r FROM grow_rows) WHERE r <= {POOL * sample_size}),
 grow_0 AS MATERIALIZED (SELECT * EXCLUDE (r), 1 AS node FROM (SELECT *, row_number() OVER (PARTITION BY period, tree
   ORDER BY {sql_hash_int(f'({tree_key})', f'tree|{seed}')}, k) AS r
   FROM grow_pool, range({n_trees}) AS t(tree)) WHERE r <= {sample_size}),
 psi AS MATERIALIZED (SELECT period, {_path('n')} AS c, greatest(ceil(log2(greatest(n, 2)))::INTEGER, 1) AS deepest
   FROM (SELECT period, max(n) AS n FROM (SELECT period, tree, count(*) AS n FROM grow_0 GROUP BY ALL) GROUP BY period))"""]
    deepest = max_depth(sample_size)
    pick = "list_filter(range({k}), i -> hi[i + 1] > lo[i + 1])".replace("i ->", "lambda i:").format(k=k)
    for d in range(deepest + 1):
        out.append(f"""
 grow_n{d} AS MATERIALIZED (SELECT *, CASE WHEN {d} < deepest AND len(usable) > 0
     THEN usable[1 + CAST(CAST(('0x' || substr(h, 16, 15))::UBIGINT AS BIGINT) % len(usable) AS INTEGER)] ELSE -1 END AS f,
     CAST(CAST(('0x' || substr(h, 1, 15))::UBIGINT AS BIGINT) AS DOUBLE) / {SPACE!r} AS place
   FROM (SELECT *, {pick} AS usable, md5('{seed}|' || tree || '|' || node) AS h
         FROM (SELECT period, tree, node, count(*) AS size, {lists('min')} AS lo, {lists('max')} AS hi
               FROM grow_{d} GROUP BY period, tree, node) JOIN psi USING (period)))""")
        if d < deepest:
            out.append(f"""
 grow_{d + 1} AS MATERIALIZED (SELECT s.period, s.k, {', '.join(f's.x{i}' for i in range(k))}, s.tree,
     2 * s.node + CASE WHEN [{', '.join(f's.x{i}' for i in range(k))}][n.f + 1]
       >= n.lo[n.f + 1] + (n.hi[n.f + 1] - n.lo[n.f + 1]) * n.place THEN 1 ELSE 0 END AS node
   FROM grow_{d} s JOIN grow_n{d} n USING (period, tree, node) WHERE n.f >= 0)""")
    level = " UNION ALL ".join(
        f"SELECT period, tree, node, f, lo[f + 1] + (hi[f + 1] - lo[f + 1]) * place AS at, "
        f"{d} * {BILLION}::BIGINT + CAST(round({_path('size')} * {BILLION}) AS BIGINT) AS length FROM grow_n{d}"
        for d in range(deepest + 1))
    out.append(f"\n nodes AS MATERIALIZED ({level})")
    return ",".join(out)


def walk(name: str, rows: str, key: str, features, n_trees: int, period: str = "0", sample_size: int = 256) -> str:
    """CTEs ending in ``name`` (period, k, score): every row of ``rows`` walks its period's trees, a level a step."""
    xs = ", ".join(f"CAST({c} AS DOUBLE)" for c in features)
    out = [f"{name}_0 AS (SELECT {period} AS period, {key} AS k, [{xs}] AS x, tree, 1 AS node FROM {rows}, range({n_trees}) AS t(tree))"]
    deepest = max_depth(sample_size)
    for d in range(deepest):
        out.append(f"""
 {name}_{d + 1} AS (SELECT w.period, w.k, w.x, w.tree,
     CASE WHEN n.f < 0 THEN w.node WHEN w.x[n.f + 1] >= n.at THEN 2 * w.node + 1 ELSE 2 * w.node END AS node
   FROM {name}_{d} w JOIN nodes n ON n.period = w.period AND n.tree = w.tree AND n.node = w.node)""")
    out.append(f"""
 {name} AS MATERIALIZED (SELECT w.period, w.k, -pow(2.0::DOUBLE, -(sum(n.length) / ({BILLION}::DOUBLE * {n_trees})) / max(p.c)) AS score
   FROM {name}_{deepest} w JOIN nodes n ON n.period = w.period AND n.tree = w.tree AND n.node = w.node
   JOIN psi p ON p.period = w.period GROUP BY w.period, w.k)""")
    return ",".join(out)


def boosted(rows: str, features, target: str, rounds: int, depth: int, rate: float, lam: float, alpha: float,
            child: int) -> str:
    """CTEs ending in ``splits`` (tree, path, f, threshold, weight, value, gain): a row per node. Features need few values."""
    k = len(features)
    shrunk = lambda g: f"(sign({g}) * greatest(abs({g}) - a, 0.0::DOUBLE))"
    cells = " UNION ALL ".join(f"SELECT path, {i} AS f, x{i} AS v, g FROM {{rows}}" for i in range(k))
    out = [f"""u AS (SELECT max(abs({target})) / {1 << 30}::DOUBLE AS unit, {alpha!r}::DOUBLE / (max(abs({target})) / {1 << 30}::DOUBLE) AS a FROM {rows}),
 z0 AS MATERIALIZED (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS x{i}' for i, c in enumerate(features))},
     CAST(round_even({target} / unit, 0) AS BIGINT) AS y FROM {rows}, u),
 r0 AS MATERIALIZED (SELECT *, CAST((SELECT round_even(sum(y) / count(*), 0) FROM z0) AS BIGINT) AS p FROM z0)"""]
    found = []
    for t in range(rounds):
        out.append(f"\n t{t}_0 AS MATERIALIZED (SELECT *, y - p AS g, '' AS path, TRUE AS live FROM r{t})")
        for d in range(depth):
            here = f"t{t}_{d}"
            out.append(f"""
 b{t}_{d} AS MATERIALIZED (
   SELECT c.path, f, (v + nv) / 2 AS cut, score - s * s / (HT + {lam!r}::DOUBLE) AS gain
   FROM (SELECT *, {shrunk('GL::DOUBLE')} * {shrunk('GL::DOUBLE')} / (HL + {lam!r}::DOUBLE)
           + {shrunk('(GT - GL)::DOUBLE')} * {shrunk('(GT - GL)::DOUBLE')} / (HT - HL + {lam!r}::DOUBLE) AS score, {shrunk('GT::DOUBLE')} AS s
         FROM (SELECT *, sum(hw) OVER w AS HL, sum(gw) OVER w AS GL,
                      sum(hw) OVER (PARTITION BY path, f) AS HT, sum(gw) OVER (PARTITION BY path, f) AS GT
               FROM (SELECT path, f, v, count(*) AS hw, sum(g) AS gw FROM ({cells.format(rows=here + ' WHERE live')}) GROUP BY path, f, v)
               WINDOW w AS (PARTITION BY path, f ORDER BY v ROWS UNBOUNDED PRECEDING)), u) c
   JOIN (SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS nv FROM (
           SELECT DISTINCT f, v FROM ({' UNION ALL '.join(f'SELECT {i} AS f, x{i} AS v FROM z0' for i in range(k))}))) e USING (f, v)
   WHERE HL >= {child} AND HT - HL >= {child}
   QUALIFY row_number() OVER (PARTITION BY c.path ORDER BY score DESC, f, v) = 1),
 t{t}_{d + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (path, live), CASE WHEN b.f IS NULL THEN r.path
     WHEN [{', '.join(f'x{i}' for i in range(k))}][b.f + 1] <= b.cut THEN r.path || 'L' ELSE r.path || 'R' END AS path, b.f IS NOT NULL AS live
   FROM {here} r LEFT JOIN b{t}_{d} b ON r.live AND r.path = b.path AND b.gain > 0)""")
            found.append(f"SELECT {t} AS tree, t.path, b.f, b.cut, b.gain, t.n, t.g FROM (SELECT path, count(*) AS n, sum(g) AS g "
                         f"FROM {here} WHERE live GROUP BY path) t LEFT JOIN b{t}_{d} b ON b.path = t.path AND b.gain > 0")
        last = f"t{t}_{depth}"
        found.append(f"SELECT {t}, path, NULL, NULL, NULL, count(*), sum(g) FROM {last} WHERE live GROUP BY path")
        value = f"round_even({rate!r}::DOUBLE * ({shrunk('g::DOUBLE')} / (n + {lam!r}::DOUBLE)), 0)"
        out.append(f"""
 r{t + 1} AS MATERIALIZED (SELECT {', '.join(f'x{i}' for i in range(k))}, y, p + CAST(v AS BIGINT) AS p FROM {last} JOIN (
     SELECT path, {value} AS v FROM (SELECT path, count(*) AS n, sum(g) AS g FROM {last} GROUP BY path), u) USING (path))""")
    names = "[" + ", ".join(f"'{c}'" for c in features) + "]"
    out.append(f"""
 splits AS MATERIALIZED (SELECT tree, path, {names}[f + 1] AS feature, cut AS threshold, CAST(n AS BIGINT) AS weight,
     round_even({rate!r}::DOUBLE * ({shrunk('g::DOUBLE')} / (n + {lam!r}::DOUBLE)), 0) * unit AS value, coalesce(gain, 0) * unit * unit AS gain
   FROM ({' UNION ALL '.join(found)}), u)""")
    return ",".join(out)


def boosted_rounds(rows: str, features, target: str, rounds: int, depth: int, rate: float, lam: float, alpha: float,
                   child: int) -> str:
    """CTEs of a WITH RECURSIVE ending in ``splits`` as of ``boosted``. Each step takes all rows down one level of the
    current tree, after the last level on to the next round; rows (those with the same features as one, with their
    number and sum) have an id from 1, nodes found a negative one."""
    k = len(features)
    xs = ", ".join(f"x{i}" for i in range(k))
    shrunk = lambda g: f"(sign({g}) * greatest(abs({g}) - a, 0.0::DOUBLE))"
    squared = lambda g: f"{shrunk(g)} * {shrunk(g)}"
    values = " UNION ALL ".join(f"SELECT {i} AS f, x{i} AS v FROM z0" for i in range(k))
    cells = " UNION ALL ".join(f"SELECT node, {i} AS f, x{i} AS v, sum(n) AS hw, sum(g) AS gw FROM s WHERE live AND depth < {depth} "
                               f"GROUP BY node, x{i}" for i in range(k))
    value = f"round_even({rate!r}::DOUBLE * ({shrunk('g::DOUBLE')} / (n + {lam!r}::DOUBLE)), 0)"
    return f"""u AS MATERIALIZED (SELECT unit, {alpha!r}::DOUBLE / unit AS a FROM (SELECT max(abs({target})) / {1 << 30}::DOUBLE AS unit FROM {rows})),
 z0 AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (
     SELECT {', '.join(f'CAST({c} AS DOUBLE) AS x{i}' for i, c in enumerate(features))},
       CAST(sum(CAST(round_even({target} / unit, 0) AS BIGINT)) AS BIGINT) AS y, count(*) AS n FROM {rows}, u GROUP BY ALL)),
 e AS MATERIALIZED (SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS nv FROM (SELECT DISTINCT f, v FROM ({values}))),
 s(id, {xs}, tree, depth, node, live, n, g, f, cut, gain) USING KEY (id) AS (
   SELECT id, {xs}, 0, 0, 1::BIGINT, TRUE, n, y - n * CAST((SELECT round_even(sum(y) / sum(n), 0) FROM z0) AS BIGINT),
     NULL::INTEGER, NULL::DOUBLE, NULL::DOUBLE FROM z0
   UNION (
   WITH b AS MATERIALIZED (
     SELECT node, f, (v + nv) / 2 AS cut, score - parent AS gain
     FROM (SELECT *, {squared('GT::DOUBLE')} / (HT + {lam!r}::DOUBLE) AS parent,
             {squared('GL::DOUBLE')} / (HL + {lam!r}::DOUBLE) + {squared('(GT - GL)::DOUBLE')} / (HT - HL + {lam!r}::DOUBLE) AS score
           FROM (SELECT *, sum(hw) OVER w AS HL, sum(gw) OVER w AS GL,
                        sum(hw) OVER (PARTITION BY node, f) AS HT, sum(gw) OVER (PARTITION BY node, f) AS GT
                 FROM ({cells}) WINDOW w AS (PARTITION BY node, f ORDER BY v ROWS UNBOUNDED PRECEDING)), u) JOIN e USING (f, v)
     WHERE HL >= {child} AND HT - HL >= {child}
     QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, f, v) = 1 AND score - parent > 1e-12 * greatest(score, 1)),
   t AS MATERIALIZED (SELECT tree, depth, node, live, CAST(sum(n) AS BIGINT) AS n, CAST(sum(g) AS BIGINT) AS g
     FROM s WHERE id > 0 AND tree < {rounds} GROUP BY ALL)
   SELECT id, {xs}, CASE WHEN s.depth = {depth} THEN s.tree + 1 ELSE s.tree END, CASE WHEN s.depth = {depth} THEN 0 ELSE s.depth + 1 END,
     CASE WHEN s.depth = {depth} THEN 1 WHEN b.f IS NULL THEN s.node
          ELSE 2 * s.node + CASE WHEN [{xs}][b.f + 1] <= b.cut THEN 0 ELSE 1 END END,
     s.depth = {depth} OR b.f IS NOT NULL, s.n, s.g - CASE WHEN s.depth = {depth} THEN s.n * l.v ELSE 0 END, NULL, NULL, NULL
   FROM s JOIN (SELECT tree, node, CAST({value} AS BIGINT) AS v FROM t, u) l ON l.tree = s.tree AND l.node = s.node
     LEFT JOIN b ON s.live AND b.node = s.node
   WHERE s.id > 0 AND s.tree < {rounds}
   UNION ALL
   SELECT -(t.tree * {2 << depth}::BIGINT + t.node), {', '.join(['NULL'] * k)}, t.tree, t.depth, t.node, t.live, t.n, t.g, b.f, b.cut, b.gain
   FROM t LEFT JOIN b ON b.node = t.node WHERE t.live)),
 splits AS MATERIALIZED (SELECT tree, translate(substr(bin(node), 2), '01', 'LR') AS path,
     [{', '.join(f"'{c}'" for c in features)}][f + 1] AS feature, cut AS threshold, n AS weight, {value} * unit AS value,
     coalesce(gain, 0) * unit * unit AS gain FROM s, u WHERE id < 0)"""
