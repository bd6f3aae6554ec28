"""SQL counterparts of the query catalogue, for the queries that have one."""

from __future__ import annotations

from itertools import combinations

NUMERICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]

_TWINS = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_quantity * 2 + l_tax AS quantity_twin,
       l_extendedprice / 2 - l_discount AS price_twin,
       CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
FROM lineitem
"""
_TWIN_COLUMNS = [*KEYS, *NUMERICS, "quantity_twin", "price_twin"]

_FOLDS = """
SELECT event_id, event_type,
       CAST((row_number() OVER (
           ORDER BY event_type, md5('1~' || CAST(event_id AS VARCHAR)), event_id) - 1) % 5 AS INTEGER) AS fold
FROM events
"""

_JUDGED = """
SELECT event_id,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
       CAST(value > 150 AS INTEGER) AS prediction
FROM events
"""

_CELLS = """
       count(*) FILTER (label = 0 AND prediction = 0) AS tn,
       count(*) FILTER (label = 0 AND prediction = 1) AS fp,
       count(*) FILTER (label = 1 AND prediction = 0) AS fn,
       count(*) FILTER (label = 1 AND prediction = 1) AS tp
"""

_CONFUSION = f"SELECT {_CELLS} FROM ({_JUDGED})"

_RATIOS = {
    "accuracy": "(tp + tn)::DOUBLE / (tp + tn + fp + fn)",
    "precision": "CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END",
    "recall": "CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END",
    "f1": "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END",
}


def _r(expression: str, places: int = 6) -> str:
    """Rounded, with negative zero folded into zero."""
    return f"round({expression}, {places}) + 0.0::DOUBLE"


def _cyclic(part: str, period: int) -> dict[str, str]:
    angle = f"{part}(ts) * (2 * pi() / {period})"
    return {"sin": _r(f"sin({angle})"), "cos": _r(f"cos({angle})")}


def _constants() -> str:
    names = [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "always_one",
    ]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n_values, "
        f"CAST(coalesce(min({c}) = max({c}), true) AS INTEGER) AS is_constant "
        "FROM (SELECT *, 1 AS always_one FROM lineitem)"
        for c in names
    )


def _corr_matrix() -> str:
    return f"WITH t AS ({_TWINS}) " + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {_r(f'corr({a}, {b})')} AS r FROM t"
        for a, b in combinations(_TWIN_COLUMNS, 2)
    )


_HOLES = {
    "l_discount": "CASE WHEN l_linenumber % 3 > 0 THEN l_discount END",
    "l_extendedprice": "CASE WHEN l_quantity > 7 THEN l_extendedprice END",
    "price_twin": "CASE WHEN l_partkey % 5 < 3 THEN price_twin END",
}


def _corr_gaps() -> str:
    holes = ", ".join(f"{e} AS {c}" for c, e in _HOLES.items())
    return f"WITH t AS (SELECT * REPLACE ({holes}) FROM ({_TWINS})) " + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {_r(f'corr({a}, {b})')} AS r FROM t" for a, b in combinations(_TWIN_COLUMNS, 2)
    )


def _corr_with_label() -> str:
    return f"WITH t AS ({_TWINS}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {_r(f'corr({c}, label)')} AS r FROM t" for c in _TWIN_COLUMNS
    )


def _corr_prune() -> str:
    """The two twin pairs are the only ones above the threshold, so each decides alone."""

    def dropped(a: str, b: str) -> dict[str, str]:
        both = f"abs(corr({a}, {b})) >= 0.95"
        weaker = f"abs(corr({a}, label)) < abs(corr({b}, label))"
        return {a: f"{both} AND {weaker}", b: f"{both} AND NOT ({weaker})"}

    rules = dropped("l_quantity", "quantity_twin") | dropped("l_extendedprice", "price_twin")
    columns = [
        f"CASE WHEN {rules[c]} THEN 0 ELSE count({c}) END AS n_{c}" if c in rules else f"count({c}) AS n_{c}"
        for c in _TWIN_COLUMNS
    ]
    return f"SELECT {', '.join(columns)} FROM ({_TWINS})"


def _fold_report() -> str:
    folded = f"""
    SELECT label, prediction,
           (row_number() OVER (
               ORDER BY label, md5('1~' || CAST(event_id AS VARCHAR)), event_id) - 1) % 5 AS fold
    FROM ({_JUDGED})"""
    per_fold = f"SELECT fold, {_CELLS} FROM ({folded}) GROUP BY fold"
    long = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, fold, {e} AS value FROM m" for m, e in _RATIOS.items()
    )
    lists = ", ".join(f"{_r(f'max(value) FILTER (fold = {i})')} AS fold_{i}" for i in range(5))
    return (
        f"WITH m AS ({per_fold}), v AS ({long}) "
        f"SELECT 'value_over_150' AS model, metric, {lists}, {_r('avg(value)')} AS mean_value "
        "FROM v GROUP BY metric"
    )


def _report_append() -> str:
    """A run that is appended twice counts once."""
    parts = []
    for run, some in (("all", _JUDGED), ("even", f"SELECT * FROM ({_JUDGED}) WHERE event_id % 2 = 0")):
        folded = f"""
        SELECT label, prediction, event_id, CAST((row_number() OVER (
                   ORDER BY label, md5('1~' || CAST(event_id AS VARCHAR)), event_id) - 1) % 5 AS INTEGER) AS fold
        FROM ({_JUDGED})"""
        cells = f"SELECT fold, {_CELLS} FROM ({folded}) WHERE event_id IN (SELECT event_id FROM ({some})) GROUP BY fold"
        parts += [
            f"SELECT '{run}' AS run_id, 'value_over_150' AS model, fold, '{m}' AS metric, {_r(e)} AS value FROM ({cells})"
            for m, e in _RATIOS.items()
        ]
    return " UNION ALL ".join(parts)


_AUC_SCORE = """
WITH t AS (
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_extendedprice * (1 - l_discount) AS s FROM lineitem
), c AS (
  SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM t GROUP BY s
), r AS (
  SELECT p, q, sum(q) OVER (ORDER BY s) AS upto FROM c
)
SELECT sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg,
       round(sum(p * (2 * upto - q))::DOUBLE / (2.0::DOUBLE * sum(p) * sum(q)), 9) AS auc FROM r
"""


def _param_grid() -> str:
    null_c = "NULL::DOUBLE AS c, NULL::DOUBLE AS reg_param, NULL::DOUBLE AS reg_param_by_n"
    rows = [
        f"SELECT 'LogisticRegression' AS model, {i} AS candidate, {c}::DOUBLE AS c, "
        f"round(1.0::DOUBLE / {c}, 12) AS reg_param, round(1.0::DOUBLE / ({c}::DOUBLE * n), 12) AS reg_param_by_n, "
        "NULL::INTEGER AS num_trees, NULL::VARCHAR AS layers FROM s"
        for i, c in enumerate([20, 30, 40, 50])
    ]
    rows += [
        f"SELECT 'RF_Classifier', {i}, {null_c}, {t}::INTEGER, NULL::VARCHAR FROM s"
        for i, t in enumerate([100, 200, 300])
    ]
    rows += [
        f"SELECT 'MLPClassifier', {i}, {null_c}, NULL::INTEGER, width || '-{h}-2' FROM s"
        for i, h in enumerate(["50-50-50", "50-50", "100"])
    ]
    return (
        "WITH s AS (SELECT count(*) AS n, max(len(embedding)) AS width FROM embeddings) "
        + " UNION ALL ".join(rows)
    )


# Orders with the label that query ``_orders`` gives them: the feature that decides it is known.
_ORDERS = """
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS final,
       CAST(xor(CAST(o_orderstatus = 'F' AS INTEGER), CAST(o_orderkey % 10 = 0 AS INTEGER)) AS INTEGER) AS label
FROM orders
"""
_ORDER_FOLDS = f"""
SELECT *, CAST((row_number() OVER (
           ORDER BY label, md5('1~' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) % 5 AS INTEGER) AS fold
FROM ({_ORDERS})
"""
_FITTED = f"SELECT o_orderkey, label, final AS prediction, fold FROM ({_ORDER_FOLDS})"
_ORDER_FEATURES = ["is_final", "o_totalprice", "o_custkey", "priority"]


def _values(rows: list[tuple], columns: str) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS v({columns})"


def _importance() -> str:
    rows = [(n, int(i == 0)) for i, n in enumerate(_ORDER_FEATURES)]
    found = "SELECT DISTINCT final FROM orders_final"
    return (
        f"WITH orders_final AS ({_ORDERS}) SELECT feature, importance::DOUBLE AS importance "
        f"FROM {_values(rows, 'feature, importance')} WHERE (SELECT count(*) FROM ({found})) = 2"
    )


def _curve() -> str:
    """Every size has the deciding feature, so every held-out row of every fold is right."""
    return (
        f"WITH f AS (SELECT fold, avg(CAST(final = final AS DOUBLE)) AS a FROM ({_ORDER_FOLDS}) GROUP BY fold) "
        "SELECT CAST(n AS INTEGER) AS n_features, CAST(count(*) AS INTEGER) AS folds, avg(a) AS mean_accuracy, "
        f"stddev_pop(a) AS std_accuracy FROM f, {_values([(4,), (3,), (2,), (1,)], 'n')} GROUP BY n"
    )


def _support() -> str:
    """One feature is enough; of equal ones the later column goes first."""
    rows = [(n, i + 1, int(i == 0)) for i, n in enumerate(_ORDER_FEATURES)]
    return (
        "SELECT feature, CAST(rank AS INTEGER) AS rank, CAST(selected AS INTEGER) AS selected "
        f"FROM {_values(rows, 'feature, rank, selected')} WHERE (SELECT count(*) FROM orders) > 0"
    )


def _searched() -> str:
    """All candidates predict the deciding feature, so all score alike and the first is best."""
    grids = [("LogisticRegression", i, f"{{'C': {c}}}") for i, c in enumerate([20, 30, 40, 50])]
    grids += [("RF_Classifier", i, f"{{'n_estimators': {n}}}") for i, n in enumerate([100, 200, 300])]
    hidden = [(50, 50, 50), (50, 50), (100,)]
    grids += [("MLPClassifier", i, f"{{'hidden_layer_sizes': {h}}}") for i, h in enumerate(hidden)]
    scored = f"SELECT fold, avg(CAST(final = label AS DOUBLE)) AS a FROM ({_ORDER_FOLDS}) GROUP BY fold"
    return (
        f"WITH f AS ({scored}) SELECT model, CAST(candidate AS INTEGER) AS candidate, params, "
        f"{_r('(SELECT avg(a) FROM f)')} AS avg_accuracy, CAST(candidate = 0 AS INTEGER) AS best "
        f"FROM {_values(grids, 'model, candidate, params')}"
    )


def _nested() -> str:
    """Every winner predicts the deciding feature, so all models score alike on an outer fold."""
    judged = f"SELECT fold, label, final AS prediction FROM ({_ORDER_FOLDS})"
    cells = f"SELECT fold, {_CELLS} FROM ({judged}) GROUP BY fold"
    ratios = _RATIOS | {"auc_hard": "(tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2"}
    names = ["LogisticRegression", "RF_Classifier", "MLPClassifier"]
    return f"WITH c AS ({cells}) " + " UNION ALL ".join(
        f"SELECT '{n}' AS model, fold, '{m}' AS metric, {_r(e)} AS value FROM c" for n in names for m, e in ratios.items()
    )


_MINUTES, _HOURS = _cyclic("minute", 60), _cyclic("hour", 24)

_PREFIXES = {
    "blog_http": "http://blog.",
    "blog_https": "https://blog.",
    "www_http": "http://www.",
    "www_https": "https://www.",
    "m_https": "https://m.",
}

ORACLES: dict[str, str] = {
    "scan_csv_mixed": """
        SELECT l_orderkey, CASE WHEN l_linenumber <> 3 THEN l_linenumber::BIGINT END AS l_linenumber,
               CASE WHEN l_suppkey % 10 <> 0 THEN l_quantity END AS l_quantity, l_returnflag,
               CASE WHEN l_linenumber = 3 THEN 'three' ELSE '' END AS lost_l_linenumber,
               CASE WHEN l_suppkey % 10 = 0 THEN 'n/a' ELSE '' END AS lost_l_quantity
        FROM lineitem""",
    "scan_flows": """
        SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber,
               CAST(l_suppkey AS INTEGER) AS l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate
        FROM lineitem""",
    "stack_sources": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, 'A' AS source
        FROM lineitem WHERE l_returnflag = 'A'
        UNION ALL BY NAME
        SELECT l_extendedprice, l_tax, l_orderkey, l_linenumber, l_quantity, 'N' AS source
        FROM lineitem WHERE l_returnflag = 'N'
        UNION ALL BY NAME
        SELECT l_discount, l_orderkey, l_linenumber, l_quantity, 'R' AS source
        FROM lineitem WHERE l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'N')""",
    "scan_csv_sources": """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_returnflag,
               CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag ELSE 'R' END AS source
        FROM lineitem""",
    "scan_row_id": """
        SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id
        FROM orders""",
    "row_id": """
        SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders""",
    "frame_shape": "SELECT count(*) AS n_rows, CAST(6 AS INTEGER) AS n_columns FROM orders",
    "recode_label": """
        SELECT event_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, count(*) AS n
        FROM events GROUP BY ALL""",
    "drop_columns": """
        SELECT * EXCLUDE (l_partkey, l_suppkey, l_discount, l_tax, l_shipdate) FROM lineitem""",
    "select_features": "SELECT l_tax, l_quantity, l_discount, l_returnflag FROM lineitem",
    "normalise_names": """
        SELECT l_orderkey AS order_key, l_linenumber AS line_1_2_, l_quantity AS qty_s, l_tax AS down_up_ratio
        FROM lineitem""",
    "parse_time": """
        SELECT event_id, strftime(ts, '%d/%m/%Y %I:%M:%S %p') AS ts_text,
               strptime(strftime(ts, '%d/%m/%Y %I:%M:%S %p'), '%d/%m/%Y %I:%M:%S %p') AS ts_parsed
        FROM events""",
    "time_parts": """
        SELECT event_id, CAST(minute(ts) AS INTEGER) AS minute_part, CAST(hour(ts) AS INTEGER) AS hour_part
        FROM events""",
    "cyclic_time": f"""
        SELECT event_id, {_MINUTES['sin']} AS hr_sin_minutes, {_MINUTES['cos']} AS hr_cos_minutes,
               {_HOURS['sin']} AS hr_sin_hours, {_HOURS['cos']} AS hr_cos_hours
        FROM events""",
    "weekend_flag": """
        SELECT event_id, CAST(isodow(ts) > 5 AS INTEGER) AS weekend FROM events""",
    "prefix_flags": "SELECT page_id, url, "
    + ", ".join(f"CAST(starts_with(url, '{p}') AS INTEGER) AS {n}" for n, p in _PREFIXES.items())
    + " FROM pages",
    "assemble_features": f"""
        SELECT CAST(dim AS INTEGER) AS dim, {_r('avg(x)')} AS mean_value, {_r('stddev_samp(x)')} AS std_value,
               {_r('min(x)')} AS min_value, {_r('max(x)')} AS max_value
        FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x,
                     generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
        GROUP BY dim""",
    "scale_std": "SELECT l_orderkey AS order_id, l_linenumber AS line_id, "
    + ", ".join(f"{_r(f'{c} / (SELECT stddev_samp({c}) FROM lineitem)')} AS {c}" for c in [*KEYS, *NUMERICS])
    + " FROM lineitem",
    "scale_centred": "SELECT l_orderkey AS order_id, l_linenumber AS line_id, "
    + ", ".join(
        _r(f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)") + f" AS {c}"
        for c in [*KEYS, *NUMERICS]
    )
    + " FROM lineitem",
    "scale_vector": "SELECT l_orderkey AS order_id, l_linenumber AS line_id, "
    + ", ".join(f"{_r(f'{c} / (SELECT stddev_samp({c}) FROM lineitem)')} AS {c}" for c in [*KEYS, *NUMERICS])
    + " FROM lineitem",
    "tree_importance": _importance(),
    "rfecv_curve": _curve(),
    "rfecv_support": _support(),
    "fit_logistic": _FITTED,
    "fit_forest": _FITTED,
    "fit_mlp": _FITTED,
    "grid_search": _searched(),
    "drop_negative": "SELECT * FROM customer WHERE NOT coalesce(c_acctbal < 0, false)",
    "exclude_ids": """
        SELECT * FROM orders
        WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 490000)""",
    "quantile_cut": """
        SELECT event_id, value,
               CASE WHEN value < (SELECT quantile_cont(value, 0.0001) FROM events) THEN -1 ELSE 1 END AS flag_0001,
               CASE WHEN value < (SELECT quantile_cont(value, 0.01) FROM events) THEN -1 ELSE 1 END AS flag_01
        FROM events""",
    "constant_columns": _constants(),
    "corr_matrix": _corr_matrix(),
    "corr_gaps": _corr_gaps(),
    "corr_with_label": _corr_with_label(),
    "corr_prune": _corr_prune(),
    "stratified_folds": _FOLDS,
    "fold_balance": f"SELECT event_type, fold, count(*) AS n FROM ({_FOLDS}) GROUP BY ALL",
    "train_test_fold": f"""
        SELECT *, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS part FROM ({_FOLDS})""",
    "confusion_matrix": _CONFUSION,
    "binary_metrics": "SELECT "
    + ", ".join(f"{_r(e)} AS {m}" for m, e in _RATIOS.items())
    + f" FROM ({_CONFUSION})",
    "auc_hard": f"""
        SELECT {_r('(tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2')} AS auc_hard FROM ({_CONFUSION})""",
    "fold_report": _fold_report(),
    "auc_score": _AUC_SCORE,
    "report_append": _report_append(),
    "param_grid": _param_grid(),
    "nested_cv": _nested(),
}


# --- isolation forests, replayed: the same digests make the same choices

_GROUPS = {
    "numbers": [*KEYS, *NUMERICS],
    "ratios": ["l_partkey", "l_suppkey", "unit_price", "charge", *NUMERICS],
}
_SEED, _TREES, _SAMPLE, _FEATURES, _LIMIT, _CUT = 1, 50, 256, 8, 8, 0.001
_PRIME, _BITS = 2147483647, 31
_PRICED = """
SELECT *, l_extendedprice / greatest(l_quantity, 1) AS unit_price,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
FROM lineitem
"""


def _hex(text: str, start: int, digits: int) -> str:
    return f"('0x' || substr({text}, {start}, {digits}))::BIGINT"


def _average_path(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2 * ({n} - 1.0::DOUBLE) / {n} END"


def _forest(groups: list[str]) -> str:
    """CTEs from the priced rows to ``scored``: their columns with ``score_<group>``.

    ``d`` the rows; ``drawn`` the samples; ``cut_at`` every sampled row at every node it comes to; ``splits`` and ``leaves`` the
    trees, known by their places; ``walk`` every row down every tree, level by level.
    """
    columns = list(dict.fromkeys(c for g in groups for c in _GROUPS[g]))
    as_list = lambda names: "[" + ", ".join(f"{c}::DOUBLE" for c in names) + "]"
    key = " || '~' || ".join(f"coalesce({c}::VARCHAR, '')" for c in KEYS)
    digest = f"md5('{_SEED}~draw~' || {key})"
    tree = f"md5('{_SEED}~tree~' || t)"
    number = (
        f"(((a * ({_hex('m', 1, 7)} + 1) + {_hex('m', 8, 7)} + 1) % {_PRIME}) << {_BITS})"
        f" + (b * ({_hex('m', 15, 7)} + 1) + {_hex('m', 22, 7)} + 1) % {_PRIME}"
    )
    place = f"{_hex(f'''md5('{_SEED}~' || tree || '~' || node || '~cut')''', 1, 15)}::DOUBLE / 1152921504606846976.0::DOUBLE"

    def picked(rows: str) -> str:
        """The split of every node of ``rows``: the first varying column in its order there, and the cut."""
        return f"""
  SELECT grp, tree, node, j, CASE WHEN lo + u * (hi - lo) < hi THEN lo + u * (hi - lo) ELSE lo END AS cut
  FROM (
    SELECT grp, tree, node, {place} AS u, arg_min(j, o) AS j, arg_min(lo, o) AS lo, arg_min(hi, o) AS hi
    FROM (
      SELECT grp, tree, node, j, min(x[j + 1]) AS lo, max(x[j + 1]) AS hi,
             md5('{_SEED}~' || tree || '~' || node || '~' || j) AS o
      FROM (SELECT {rows}.*, f.j FROM {rows} JOIN chosen f USING (grp, tree) WHERE depth < {_LIMIT})
      GROUP BY grp, tree, node, j
    ) WHERE lo < hi GROUP BY grp, tree, node
  )"""

    points = " UNION ALL ".join(f"SELECT '{g}' AS grp, rid, {as_list(_GROUPS[g])} AS x FROM d" for g in groups)
    widths = ", ".join(f"('{g}', {len(_GROUPS[g])})" for g in groups)
    walk = "w0 AS (SELECT grp, rid, x, tree, 1::BIGINT AS node FROM points, (SELECT range AS tree FROM range(trees))),\n"
    walk = walk.replace("range(trees)", f"range({_TREES})")
    for k in range(_LIMIT):
        walk += f"""w{k + 1} AS (
  SELECT grp, rid, x, tree, CASE WHEN j IS NULL THEN node ELSE 2 * node + (x[j + 1] > cut)::BIGINT END AS node
  FROM w{k} LEFT JOIN splits USING (grp, tree, node)
),
"""
    scores = ", ".join(f"any_value(score) FILTER (grp = '{g}') AS score_{g}" for g in groups)
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, * FROM ({_PRICED})),
points AS MATERIALIZED ({points}),
size AS (SELECT count(*) AS n, least(count(*), {_SAMPLE}) AS sample FROM d),
hashed AS (SELECT rid, {as_list(columns)} AS every, {_hex(digest, 1, 14)} % {_PRIME} AS a, {_hex(digest, 15, 14)} % {_PRIME} AS b FROM d),
numbered AS (SELECT rid, every, t AS tree, {number} AS u FROM hashed, (SELECT range AS t, {tree.replace("|| t", "|| range")} AS m FROM range({_TREES}))),
drawn AS MATERIALIZED (
  SELECT rid, tree FROM numbered WHERE u < 2.0 * (SELECT sample / n FROM size) * pow(2, {2 * _BITS})
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY u, every) <= (SELECT sample FROM size)
),
chosen AS MATERIALIZED (
  SELECT grp, tree, j FROM (VALUES {widths}) v(grp, width), (SELECT range AS tree FROM range({_TREES})), (SELECT range AS j FROM range(20))
  WHERE j < width QUALIFY row_number() OVER (PARTITION BY grp, tree ORDER BY md5('{_SEED}~' || tree || '~feature~' || j)) <= {_FEATURES}
),
cut_at AS (
  SELECT grp, tree, 1::BIGINT AS node, 0 AS depth, rid, x FROM drawn JOIN points USING (rid)
  UNION ALL
  SELECT * FROM (
    WITH here AS (SELECT * FROM cut_at), split AS ({picked("here")})
    SELECT grp, tree, 2 * node + (x[j + 1] > cut)::BIGINT, depth + 1, rid, x FROM here JOIN split USING (grp, tree, node)
  )
),
splits AS MATERIALIZED ({picked("cut_at")}),
leaves AS MATERIALIZED (
  SELECT grp, tree, node, round(1000000 * (any_value(depth) + {_average_path("count(*)")}))::BIGINT AS depth
  FROM cut_at ANTI JOIN splits USING (grp, tree, node) GROUP BY grp, tree, node
),
{walk}score AS (
  SELECT grp, rid, -pow(2, -(sum(depth)::DOUBLE / 1000000 / {_TREES} / (SELECT {_average_path("sample")} FROM size))) AS score
  FROM w{_LIMIT} JOIN leaves USING (grp, tree, node) GROUP BY grp, rid
),
scored AS (
  SELECT d.* EXCLUDE (rid), {scores} FROM d JOIN score USING (rid) GROUP BY ALL
)"""


def _outliers(groups: list[str]) -> str:
    cuts = ", ".join(f"quantile_cont(score_{g}, {_CUT}) AS cut_{g}" for g in groups)
    return f"{_forest(groups)}, cuts AS (SELECT {cuts} FROM scored)"


_BOTH = list(_GROUPS)
ORACLES |= {
    "iforest_scores": f"""{_forest(_BOTH)}
SELECT * EXCLUDE (score_numbers, score_ratios), {_r("score_numbers")} AS score_numbers, {_r("score_ratios")} AS score_ratios FROM scored""",
    "anomaly_rows": f"""{_outliers(["numbers"])}
SELECT scored.* EXCLUDE (score_numbers), -1::INTEGER AS anomaly_numbers FROM scored, cuts WHERE score_numbers < cut_numbers""",
    "multi_group_outliers": f"""{_outliers(_BOTH)}
SELECT d.* EXCLUDE (rid) FROM d
WHERE ({", ".join(KEYS)}) NOT IN (
  SELECT ({", ".join(KEYS)}) FROM scored, cuts WHERE score_numbers < cut_numbers OR score_ratios < cut_ratios
)""",
}
