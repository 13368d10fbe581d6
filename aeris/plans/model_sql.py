"""DuckDB SQL of the model operators (oracle side): folds, forests, lasso, overfit loop.

Each function returns CTEs that read earlier ones; nothing here is shared with the
Spark side but constants.
"""

from __future__ import annotations

from aeris.operators.forest import LEAST_GAIN, POISSON, Params


def _hash(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT)"


def fold_ctes(name: str, source: str, k: int, seed: int = 42, rounds: int = 6) -> list[str]:
    """``fold_<name>`` (id, fold) for the ids 0..n-1 of ``source`` (a select of id): one
    recursion step is one turn of the Feistel network."""
    return [
        f"par_{name} AS (SELECT *, CAST(ceil(CAST(n AS DOUBLE) / a) AS BIGINT) AS b FROM (SELECT n, "
        f"CAST(ceil(sqrt(CAST(n AS DOUBLE))) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM ({source}))))",
        f"""walk_{name}(id, x, y, s) AS (SELECT id, id // b, id % b, 0 FROM ({source}), par_{name}
      UNION ALL SELECT id,
        CASE WHEN s % 2 = 0 THEN (x + {_hash(f"'{seed}'", f's % {rounds}', 'y')}) % a ELSE x END,
        CASE WHEN s % 2 = 1 THEN (y + {_hash(f"'{seed}'", f's % {rounds}', 'x')}) % b ELSE y END, s + 1
      FROM walk_{name}, par_{name} WHERE NOT (s > 0 AND s % {rounds} = 0 AND x * b + y < n))""",
        f"fold_{name} AS MATERIALIZED (SELECT id, CAST((x * b + y) * {k} // n AS INTEGER) AS fold "
        f"FROM walk_{name}, par_{name} WHERE s > 0 AND s % {rounds} = 0 AND x * b + y < n)"]


def forest_ctes(name: str, source: str, features, targets, p: Params, folds: int | None = None) -> list[str]:
    """``nodes_<name>`` of a forest on ``source`` (k, fold, features, targets), and
    ``bins_<name>``, the expressions' ranges. One group of CTEs a level."""
    n_features, trees = len(features), p.n_estimators
    per_split = p.features_per_split(n_features)
    t_names = [f"y{i}" for i in range(len(targets))]
    sums = [f"s{i}" for i in range(len(targets))]
    out = [f"tr_{name} AS MATERIALIZED ({source})",
           f"rg_{name} AS MATERIALIZED (SELECT " + ", ".join(
               f"min({f}) AS lo_{i}, max({f}) AS hi_{i}" for i, f in enumerate(features)) + f" FROM tr_{name})",
           f"bn_{name} AS MATERIALIZED (SELECT k, fold, {bin_list(features, p.bins)} AS b, " + ", ".join(
               f"CAST(floor({t} * 1000000.0 + 0.5) AS BIGINT) AS {y}" for t, y in zip(targets, t_names))
           + f" FROM tr_{name}, rg_{name})"]
    draw = (f"CAST('0x' || substr(md5(concat_ws(':', '{p.random_state}', (g % {trees}) // 8, k)), "
            f"CAST((g % {trees}) % 8 * 4 + 1 AS INTEGER), 4) AS INTEGER)")
    copies = " + ".join(f"(u >= {c})::BIGINT" for c in POISSON)
    seen = f"WHERE fold <> g // {trees}" if folds else ""
    out.append(f"a0_{name} AS MATERIALIZED (SELECT * FROM (SELECT g, CAST(1 AS BIGINT) AS node, k, b, {', '.join(t_names)}, "
               f"{copies} AS w FROM (SELECT *, {draw} AS u FROM bn_{name}, "
               f"(SELECT unnest(range({trees * (folds or 1)})) AS g) {seen})) WHERE w > 0)")
    total = ", ".join(["count(*) AS n", "CAST(sum(w) AS BIGINT) AS w"] + [
        f"CAST(sum(w * {y}) AS BIGINT) AS {c}" for y, c in zip(t_names, sums)])
    removed = lambda w, s: " + ".join(f"CAST({x} AS DOUBLE) * CAST({x} AS DOUBLE) / {w}" for x in s)
    nodes = []
    for d in range(p.max_depth + 1):
        a = f"a{d}_{name}"
        out.append(f"t{d}_{name} AS MATERIALIZED (SELECT g, node, {total} FROM {a} GROUP BY g, node)")
        if d == p.max_depth:
            nodes.append(f"SELECT *, NULL AS feature, NULL AS bin, NULL AS gain FROM t{d}_{name}")
            break
        out.append(f"c{d}_{name} AS MATERIALIZED (SELECT g, node, f, b[f + 1] AS bin, {total} FROM {a}, "
                   f"(SELECT unnest(range({n_features})) AS f) GROUP BY g, node, f, b[f + 1])")
        drawn = (f"SELECT g, node, f FROM (SELECT g, node, f, row_number() OVER (PARTITION BY g, node ORDER BY "
                 f"md5(concat_ws(':', '{p.random_state}', g % {trees}, node, f)), f) AS r FROM t{d}_{name}, "
                 f"(SELECT unnest(range({n_features})) AS f) WHERE n >= {p.min_samples_split}) WHERE r <= {per_split}")
        names = ["n", "w", *sums]
        cum = ", ".join(f"CAST(sum({c}) OVER (PARTITION BY g, node, f ORDER BY bin) AS BIGINT) AS {c}, "
                        f"CAST(sum({c}) OVER (PARTITION BY g, node, f) AS BIGINT) AS {c}_all" for c in names)
        right = [f"({c}_all - {c})" for c in sums]
        out.append(f"""s{d}_{name} AS MATERIALIZED (SELECT * FROM (SELECT g, node, f, bin, score, before, row_number() OVER
          (PARTITION BY g, node ORDER BY score DESC, f, bin) AS r FROM (SELECT g, node, f, bin,
            ({removed('w', sums)}) + ({removed('(w_all - w)', right)}) AS score,
            {removed('w_all', [f'{c}_all' for c in sums])} AS before
          FROM (SELECT g, node, f, bin, {cum} FROM c{d}_{name} JOIN ({drawn}) USING (g, node, f))
          WHERE n >= {p.min_samples_leaf} AND n_all - n >= {p.min_samples_leaf} AND n < n_all)
          WHERE score > before * (1 + {LEAST_GAIN!r}::DOUBLE)) WHERE r = 1)""")
        nodes.append(f"SELECT t.*, s.f AS feature, s.bin AS bin, s.score - s.before AS gain FROM t{d}_{name} t "
                     f"LEFT JOIN s{d}_{name} s USING (g, node)")
        out.append(f"a{d + 1}_{name} AS MATERIALIZED (SELECT g, node * 2 + (b[s.f + 1] > s.bin)::BIGINT AS node, k, b, "
                   f"{', '.join(t_names)}, w FROM {a} JOIN s{d}_{name} s USING (g, node))")
    out.append(f"nodes_{name} AS MATERIALIZED (" + " UNION ALL ".join(nodes) + ")")
    return out


def bin_list(features, bins: int) -> str:
    """The bins of a row, given its ranges lo_i and hi_i."""
    return "[" + ", ".join(
        f"greatest(0, least({bins - 1}, CAST(floor(floor(({f} - lo_{i}) / coalesce(nullif(hi_{i} - lo_{i}, 0.0), 1.0) "
        f"* 1000000.0 + 0.5) / 1000000.0 * {bins}) AS INTEGER)))" for i, f in enumerate(features)) + "]"


def predicted_cte(name: str, out: str, source: str, features, targets, p: Params) -> str:
    """``out`` (k, forest, p0, p1, ...) for ``source`` (k, forest, features): the mean over
    the trees of ``forest`` of the leaf that the row falls into."""
    walk = f"SELECT s.*, g, node, {bin_list(features, p.bins)} AS b FROM ({source}) s, rg_{name}, " \
           f"(SELECT DISTINCT g, CAST(1 AS BIGINT) AS node FROM nodes_{name}) r WHERE g // {p.n_estimators} = s.forest"
    for _ in range(p.max_depth):
        walk = (f"SELECT w.* REPLACE (CASE WHEN n.feature IS NULL THEN w.node ELSE w.node * 2 + "
                f"(w.b[n.feature + 1] > n.bin)::BIGINT END AS node) FROM ({walk}) w JOIN nodes_{name} n USING (g, node)")
    means = ", ".join(f"avg(CAST(n.s{t} AS DOUBLE) / n.w / 1000000.0) AS p{t}" for t in range(len(targets)))
    return (f"{out} AS MATERIALIZED (SELECT w.k, w.forest, {means} FROM ({walk}) w "
            f"JOIN nodes_{name} n USING (g, node) GROUP BY w.k, w.forest)")


def lasso2(moments: str, keys: str, alpha: str) -> str:
    """Per row of ``moments`` (``keys``, m1, m2, my, c11, c12, c22, c1, c2: means, variances
    and covariances) the two-feature lasso (w1, w2, b0): of the nine sign patterns whose
    solution has these signs, the one of least objective."""
    return f"""SELECT {keys}, w1, w2, my - w1 * m1 - w2 * m2 AS b0 FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
      ORDER BY 0.5 * (c11 * w1 * w1 + 2 * c12 * w1 * w2 + c22 * w2 * w2) - c1 * w1 - c2 * w2
        + ({alpha}) * (abs(w1) + abs(w2))) AS r
      FROM (SELECT *, CASE WHEN s1 = 0 THEN 0.0 WHEN s2 = 0 THEN (c1 - ({alpha}) * s1) / c11
          ELSE (c22 * (c1 - ({alpha}) * s1) - c12 * (c2 - ({alpha}) * s2)) / (c11 * c22 - c12 * c12) END AS w1,
        CASE WHEN s2 = 0 THEN 0.0 WHEN s1 = 0 THEN (c2 - ({alpha}) * s2) / c22
          ELSE (c11 * (c2 - ({alpha}) * s2) - c12 * (c1 - ({alpha}) * s1)) / (c11 * c22 - c12 * c12) END AS w2
        FROM ({moments}), (VALUES (-1), (0), (1)) u(s1), (VALUES (-1), (0), (1)) v(s2))
      WHERE sign(w1) = s1 AND sign(w2) = s2) WHERE r = 1"""
