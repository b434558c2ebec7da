"""The SQL a DuckDB runs for each registered query, built from small pieces."""

from __future__ import annotations

from checks.views import VIEWS

NULLS = "('Nan', 'nan', 'Null', 'null', 'NAN', 'N/A', 'n/a')"
DEFAULTS = (
    "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
    "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
)
NUMBER = (
    r"(\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*|[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?)"
)
BLANK = r"[\s\x0b\x1c-\x1f]"
CASED = r"\p{Lu}\p{Ll}\p{Lt}"

COLUMNS = {
    "dirty_orders": "order_id priority price_txt amount status score",
    "dirty_wide": "custkey balance nation_code segment country eighth segment_low grade",
    "const_cols": "partkey size price fixed nothing product root",
    "unit_text": "part_key weight label blurb",
    "text_cells": "order_key quantity price line returned maybe part_text ship_day blank suffixed status",
}
TEXTS = {
    "dirty_orders": "priority price_txt status",
    "dirty_wide": "segment country segment_low",
    "const_cols": "",
    "unit_text": "weight label blurb",
    "text_cells": COLUMNS["text_cells"],
}


def pick(view: str, changed: dict[str, str], drop: tuple[str, ...] = ()) -> str:
    names = [n for n in COLUMNS[view].split() if n not in drop]
    return ", ".join(f"{changed[n]} AS {n}" if n in changed else n for n in names)


def nulled(view: str, tokens: str = NULLS) -> str:
    changed = {n: f"CASE WHEN {n} IN {tokens} THEN NULL ELSE {n} END" for n in TEXTS[view].split()}
    return f"SELECT {pick(view, changed)} FROM {view}"


def base(view: str, tokens: str = NULLS) -> str:
    """``WITH`` the untidy view and its null-normalised form ``n``."""
    return f"WITH {view} AS ({VIEWS[view]}), n AS ({nulled(view, tokens)})"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def title(c: str) -> str:
    runs = f"regexp_extract_all({c}, '([{CASED}]+|[^{CASED}]+)', 1)"
    return f"array_to_string(list_transform({runs}, lambda t: CASE WHEN t[1] = 'ß' THEN 'Ss' ELSE upper(t[1]) END || lower(t[2:])), '')"


def number(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '{NUMBER}') THEN TRY_CAST(trim({c}, ' ' || chr(9) || chr(10)) AS DOUBLE) END"


def extract(c: str) -> str:
    return number(f"regexp_replace({c}, '[^0-9.-]', '', 'g')")


def unknown(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} IN ('nan', 'Nan', 'NaN') THEN 'Unknown' ELSE {c} END"


def r(c: str, digits: int = 4) -> str:
    return f"round_even({c}, {digits})"


def q(c: str, p: float) -> str:
    return f"quantile_cont({c}, {p})"


def missing(names: list[str]) -> list[str]:
    return [f"CAST(count(*) FILTER (WHERE {n} IS NULL) AS BIGINT)" for n in names]


def sparse(n_columns: int, names: list[str]) -> str:
    nulls = " + ".join(f"CAST({n} IS NULL AS INT)" for n in names)
    return f"({nulls}) <= 2"


def kept(view: str) -> str:
    """``base`` plus ``k``: the rows with at most two nulls."""
    names = COLUMNS[view].split()
    return f"{base(view)}, k AS (SELECT * FROM n WHERE {sparse(len(names), names)})"


def no_outliers(source: str, names: list[str]) -> tuple[str, str]:
    """CTEs that drop fenced rows column after column, and the last one's name."""
    ctes = []
    for i, n in enumerate(names):
        target = f"{source}_{i}" if i == 0 else f"{source[: source.rindex('_')]}_{i}"
        ctes.append(
            f"{target} AS (SELECT {source}.* FROM {source}, (SELECT {q(n, 0.25)} AS a, {q(n, 0.75)} AS b FROM {source}) f "
            f"WHERE NOT coalesce({n} < a - 1.5 * (b - a) OR {n} > b + 1.5 * (b - a), FALSE))"
        )
        source = target
    return ", ".join(ctes), source


def capped(c: str) -> str:
    """A cell held within the fences of its column; needs quartiles ``c_a`` and ``c_b``."""
    low, high = f"{c}_a - 1.5 * ({c}_b - {c}_a)", f"{c}_b + 1.5 * ({c}_b - {c}_a)"
    return (
        f"CAST(CASE WHEN {c} < {low} THEN {low} WHEN {c} > {high} THEN {high} ELSE {c} END AS DOUBLE)"
    )


def fenced(source: str, names: list[str]) -> str:
    fits = ", ".join(f"{q(n, 0.25)} AS {n}_a, {q(n, 0.75)} AS {n}_b" for n in names)
    return f"{source}, (SELECT {fits} FROM {source}) f"


ORACLE: dict[str, str] = {}
O = ORACLE

O["normalize_nulls"] = f"WITH dirty_orders AS ({VIEWS['dirty_orders']}) {nulled('dirty_orders')}"
O["default_nulls"] = f"WITH text_cells AS ({VIEWS['text_cells']}) {nulled('text_cells', DEFAULTS)}"


def kind_of(c: str) -> str:
    digits, whole = rf"regexp_full_match({c}, '\s*[+-]?[0-9]+\s*')", f"count(*) = count({c})"
    longs = f"count(*) FILTER (WHERE {digits} AND TRY_CAST({c} AS BIGINT) IS NOT NULL)"
    numbers = f"count(*) FILTER (WHERE regexp_full_match({c}, '{NUMBER}'))"
    booleans = f"count(*) FILTER (WHERE lower({c}) IN ('true', 'false'))"
    return (
        f"CASE WHEN count(*) FILTER (WHERE {digits}) <> {longs} THEN 'object' "
        f"WHEN count(*) = {longs} THEN 'int64' WHEN count({c}) = {numbers} THEN 'float64' "
        f"WHEN count({c}) = {booleans} AND {whole} THEN 'bool' ELSE 'object' END"
    )


O["infer_types"] = base("text_cells", DEFAULTS) + " UNION ALL ".join(
    f" SELECT '{c}' AS \"column\", {kind_of(c)} AS dtype FROM n" for c in COLUMNS["text_cells"].split()
)
O["infer_types_values"] = base("text_cells", DEFAULTS) + (
    " SELECT CAST(order_key AS BIGINT) AS order_key, CAST(quantity AS BIGINT) AS quantity, "
    "CAST(price AS DOUBLE) AS price, CAST(line AS DOUBLE) AS line, returned = 'TRUE' AS returned, "
    "maybe, CAST(CASE WHEN part_text <> 'NAN' THEN part_text END AS DOUBLE) AS part_text, ship_day, "
    "CAST(NULL AS DOUBLE) AS blank, suffixed, status FROM n"
)

wide = COLUMNS["dirty_wide"].split()
orders = COLUMNS["dirty_orders"].split()
O["drop_sparse_rows"] = kept("dirty_wide") + " SELECT * FROM k"
O["drop_missing"] = base("dirty_wide") + " SELECT * FROM n WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in wide
)
O["drop_columns"] = base("dirty_wide") + f" SELECT {pick('dirty_wide', {}, ('grade', 'eighth'))} FROM n"
O["drop_missing_target"] = base("dirty_orders") + " SELECT * FROM n WHERE status IS NOT NULL"
O["split_target"] = (
    f"WITH dirty_orders AS ({VIEWS['dirty_orders']}) "
    f"SELECT {pick('dirty_orders', {}, ('status',))} FROM dirty_orders WHERE status IS NOT NULL"
)
O["dedupe_rows"] = base("dirty_orders") + " SELECT DISTINCT * FROM n"
chain, last = no_outliers("n", ["amount", "score"])
O["remove_outliers"] = base("dirty_orders") + ", " + chain + f" SELECT * FROM {last}"
O["preview"] = base("dirty_orders") + " SELECT * FROM n ORDER BY order_id LIMIT 10"
O["profile_shape"] = base("dirty_orders") + (
    " SELECT count(*) AS row_count, CAST(6 AS BIGINT) AS column_count FROM n"
)
O["missing_counts"] = base("dirty_orders") + " UNION ALL ".join(
    f" SELECT '{c}' AS \"column\", {m} AS missing FROM n" for c, m in zip(orders, missing(orders))
)
O["table_health"] = base("dirty_orders") + (
    f", t AS (SELECT {' + '.join(missing(orders))} AS issues FROM n) SELECT CAST(issues AS BIGINT) AS issues, "
    "CASE WHEN issues = 0 THEN 'Clean Data' ELSE 'Needs Cleaning' END AS status FROM t"
)
O["dtype_counts"] = (
    f"WITH v AS ({VIEWS['dirty_wide']}), d AS (SELECT column_type AS t FROM (DESCRIBE SELECT * FROM v)) "
    "SELECT CASE t WHEN 'BIGINT' THEN 'int64' WHEN 'DOUBLE' THEN 'float64' ELSE 'object' END AS dtype, "
    "count(*) AS column_count FROM d GROUP BY 1"
)


def pearson_rows(names: list[str], source: str, digits: int) -> str:
    rows = []
    for a in names:
        for b in names:
            # The engine's corr gives NaN on a constant.
            value = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
            rows.append(
                f"SELECT '{a}' AS col_x, '{b}' AS col_y, "
                f"{r(f'CASE WHEN isnan({value}) THEN NULL ELSE {value} END', digits)} AS r FROM {source}"
            )
    return " UNION ALL ".join(rows)


constants = COLUMNS["const_cols"].split()
O["correlation_matrix"] = f"{base('const_cols')} {pearson_rows(constants, 'n', 6)}"
O["quartiles"] = base("const_cols") + " UNION ALL ".join(
    f" SELECT '{c}' AS \"column\", {r(q(f'CAST({c} AS DOUBLE)', 0.25), 6)} AS q1, "
    f"{r(q(f'CAST({c} AS DOUBLE)', 0.5), 6)} AS median, {r(q(f'CAST({c} AS DOUBLE)', 0.75), 6)} AS q3 FROM n"
    for c in constants
)
O["numeric_share"] = base("unit_text") + " UNION ALL ".join(
    f" SELECT '{c}' AS \"column\", count({extract(c)}) AS parsed, count(*) AS row_count, "
    f"count({extract(c)}) > 0.2 * count(*) AS is_numeric FROM n"
    for c in ("weight", "label", "blurb")
)
O["profile"] = (
    base("dirty_orders")
    + ", c AS ("
    + pearson_rows(["order_id", "amount", "score"], "n", 6)
    + ") SELECT 'correlation' AS part, col_x AS \"column\", col_y AS other, r AS value FROM c UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'missing', '{c}', '', CAST({m} AS DOUBLE) FROM n"
        for c, m in zip(orders, missing(orders))
    )
)

unit = f"WITH unit_text AS ({VIEWS['unit_text']})"
O["strip_text"] = unit + (
    f" SELECT part_key, {strip('weight')} AS weight, {strip('label')} AS label, {strip('blurb')} AS blurb FROM unit_text"
)
O["title_case"] = f"SELECT doc_id, {title('text')} AS titled FROM documents"
O["extract_number"] = unit + (
    f" SELECT part_key, {extract('weight')} AS weight, {extract('blurb')} AS blurb FROM unit_text"
)
O["to_number"] = unit + f" SELECT part_key, {number('weight')} AS weight FROM unit_text"
O["round_floats"] = (
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
    "round_even(l_extendedprice * l_discount * 0.5, 2) AS half_discount FROM lineitem"
)
O["demote_whole_floats"] = (
    "SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS l_quantity, l_extendedprice FROM lineitem"
)
SAFE = r"regexp_replace(regexp_replace({0}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', '_', 'g'), '[^\p{{L}}\p{{N}}_.-]', '', 'g')"
O["safe_name"] = (
    f"SELECT page_id, {SAFE.format('url')} AS safe, 'clean_' || {SAFE.format('html')} AS cleaned FROM pages"
)


def standard(c: str) -> str:
    return f"nullif({title(strip(c))}, 'Nan')"


def orders_with(changed: dict[str, str], source: str = "n", drop: tuple[str, ...] = ()) -> str:
    return f" SELECT {pick('dirty_orders', changed, drop)} FROM {source}"


O["standardize_text"] = base("dirty_orders") + orders_with(
    {"priority": standard("priority"), "status": standard("status")}
)
O["extract_numbers"] = base("dirty_orders") + orders_with({"price_txt": extract("price_txt")})
O["extract_numbers_auto"] = base("unit_text") + (
    f" SELECT part_key, {extract('weight')} AS weight, label, blurb FROM n"
)
O["fill_unknown"] = base("dirty_orders") + orders_with(
    {"priority": unknown("priority"), "status": unknown("status")}
)
O["fill_mean"] = base("dirty_orders") + orders_with(
    {
        c: r(f"coalesce({v}, (SELECT avg({v}) FROM n))")
        for c, v in (("amount", "amount"), ("score", "score"), ("price_txt", number("price_txt")))
    }
)
O["fill_median"] = base("dirty_orders") + orders_with(
    {c: r(f"coalesce({c}, (SELECT median({c}) FROM n))") for c in ("amount", "score")}
)


def mode_of(c: str, source: str = "n") -> str:
    return (
        f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    )


O["fill_mode"] = base("dirty_orders") + orders_with(
    {c: f"coalesce({c}, {mode_of(c)})" for c in ("priority", "status")}
)
O["fill_auto"] = base("dirty_orders") + orders_with(
    {
        **{c: r(f"coalesce({c}, (SELECT median({c}) FROM n))") for c in ("amount", "score")},
        **{c: f"coalesce({c}, 'Unknown')" for c in ("priority", "price_txt", "status")},
    }
)
O["cap_outliers"] = base("dirty_orders") + orders_with(
    {c: r(capped(c)) for c in ("order_id", "amount", "score")},
    fenced("n", ["order_id", "amount", "score"]),
)


def strategy_ctes(source: str) -> str:
    """The declared strategy of the queries, ending in CTE ``s``."""
    titled = {
        "priority": f"coalesce({standard('priority')}, 'Unknown')",
        "price_txt": extract("price_txt"),
        "status": unknown("status"),
    }
    means = {c: f"coalesce({c}, (SELECT avg({c}) FROM t))" for c in ("price_txt", "score")}
    chain, last = no_outliers("m", ["amount", "price_txt"])
    return (
        f", d AS (SELECT DISTINCT * FROM {source}), t AS ({orders_with(titled, 'd', ('order_id',))}), "
        f"m AS ({orders_with(means, 't', ('order_id',))}), {chain}, s AS (SELECT * FROM {last})"
    )


O["apply_strategy"] = base("dirty_orders") + strategy_ctes("n") + orders_with(
    {c: r(c) for c in ("price_txt", "amount", "score")}, "s", ("order_id",)
)


def auto_orders(source: str) -> str:
    """The automatic run over the orders view, ending in CTE ``c``."""
    text = {
        "priority": title(strip("priority")),
        "price_txt": extract("price_txt"),
        "status": title(strip("status")),
    }
    numbers = ["order_id", "price_txt", "amount", "score"]
    fills = {c: f"coalesce({c}, (SELECT median({c}) FROM t))" for c in numbers[1:]}
    fills.update({c: f"coalesce({c}, 'Unknown')" for c in ("priority", "status")})
    return (
        f", d AS (SELECT DISTINCT * FROM {source}), t AS ({orders_with(text, 'd')}), "
        f"e AS ({orders_with(fills, 't')}), c AS ("
        + orders_with({c: capped(c) for c in numbers}, fenced("e", numbers))
        + ")"
    )


O["auto_clean"] = base("dirty_orders") + auto_orders("n") + orders_with(
    {c: r(c) for c in ("order_id", "price_txt", "amount", "score")}, "c"
)


def whole(c: str) -> str:
    return f"CAST({r(c, 2)} AS BIGINT)"


# Columns that end up whole on this data come back as bigint.
O["clean"] = kept("dirty_orders") + auto_orders("k") + orders_with(
    {"order_id": whole("order_id"), "price_txt": whole("price_txt"), "amount": r("amount", 2), "score": whole("score")},
    "c",
)
O["clean_fallback"] = O["clean"]
WIDE_NUMBERS = ["custkey", "balance", "nation_code", "eighth", "grade"]
# The nation names hold digits, so the automatic run turns them into numbers.
WIDE_AUTO = ["custkey", "balance", "nation_code", "country", "eighth", "grade"]
WIDE_TEXTS = ["segment", "segment_low"]


def wide_with(changed: dict[str, str], source: str) -> str:
    return f" SELECT {pick('dirty_wide', changed)} FROM {source}"


def wide_auto() -> str:
    text = {c: title(strip(c)) for c in WIDE_TEXTS}
    text["country"] = extract("country")
    fills = {c: f"coalesce({c}, (SELECT median({c}) FROM t))" for c in WIDE_AUTO[1:]}
    fills.update({c: f"coalesce({c}, 'Unknown')" for c in WIDE_TEXTS})
    return (
        f", d AS (SELECT DISTINCT * FROM k), t AS ({wide_with(text, 'd')}), "
        f"e AS ({wide_with(fills, 't')}), c AS ("
        + wide_with({c: capped(c) for c in WIDE_AUTO}, fenced("e", WIDE_AUTO))
        + ")"
    )


WIDE_FINAL = {
    "custkey": whole("custkey"),
    "balance": r("balance", 2),
    "nation_code": whole("nation_code"),
    "country": whole("country"),
    "eighth": r("eighth", 2),
    "grade": whole("grade"),
}
O["clean_wide"] = kept("dirty_wide") + wide_auto() + wide_with(WIDE_FINAL, "c")
O["clean_strategy"] = kept("dirty_orders") + strategy_ctes("k") + orders_with(
    {c: r(c, 2) for c in ("price_txt", "amount", "score")}, "s", ("order_id",)
)
suggested_text = {
    "priority": unknown(standard("priority")),
    "price_txt": extract("price_txt"),
    "status": unknown("status"),
}
SUGGESTED = ("amount", "score", "price_txt")
O["clean_suggested"] = (
    kept("dirty_orders")
    + f", d AS (SELECT DISTINCT * FROM k), t AS ({orders_with(suggested_text, 'd')}), "
    + "m AS ("
    + orders_with({c: f"coalesce({c}, (SELECT avg({c}) FROM t))" for c in SUGGESTED}, "t")
    + "), "
    + no_outliers("m", ["amount"])[0]
    + orders_with({c: r(c, 2) for c in SUGGESTED}, "m_0")
)
O["clean_drop_missing"] = kept("dirty_wide") + wide_with(
    {"balance": r("balance", 2), "eighth": r("eighth", 2), "grade": whole("grade")},
    "k WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in wide),
)
O["clean_fill_mean"] = kept("dirty_wide") + wide_with(
    {
        "custkey": "custkey",
        **{c: r(f"coalesce({c}, (SELECT avg({c}) FROM k))", 2) for c in WIDE_NUMBERS[1:]},
    },
    "k",
)
chain, last = no_outliers("k", WIDE_NUMBERS)
O["clean_remove_outliers"] = kept("dirty_wide") + f", {chain}" + wide_with(
    {c: r(c, 2) for c in ("balance", "eighth")}, last
)
O["clean_manual"] = kept("dirty_wide") + wide_with({c: r(c, 2) for c in ("balance", "eighth")}, "k")


def log_rows() -> str:
    entries = [
        "(0, 'drop_sparse_rows', NULL, (SELECT count(*) FROM n) - (SELECT count(*) FROM k))",
        "(1, 'extract_numbers', 'country', NULL)",
    ]
    for i, c in enumerate(wide):
        op = "fill_unknown" if c in WIDE_TEXTS else "fill_median"
        entries.append(f"({2 + i}, '{op}', '{c}', (SELECT count(*) FROM k WHERE {c} IS NULL))")
    for i, c in enumerate(WIDE_AUTO):
        entries.append(f"({20 + i}, 'cap_outliers', '{c}', NULL)")
    return ", ".join(entries)


O["run_log"] = kept("dirty_wide") + (
    f", e(place, op, col, hit) AS (VALUES {log_rows()}) "
    "SELECT CAST(row_number() OVER (ORDER BY place) AS INT) AS seq, op, col AS \"column\", "
    "CAST(hit AS BIGINT) AS affected FROM e WHERE hit IS NULL OR hit > 0"
)


def suggestion() -> str:
    rows = []
    texts, numbers = TEXTS["dirty_orders"].split(), ["order_id", "amount", "score"]
    for c in texts:
        rows.append(
            ("standardize_text", c, f"count(DISTINCT {c}) > count(DISTINCT lower(trim({c}))) AND count({extract(c)}) <= 0.2 * count(*)")
        )
        numeric = f"count({extract(c)}) > 0.2 * count(*)"
        rows.append(("fill_unknown", c, f"count({c}) < count(*) AND NOT {numeric}"))
        rows.append(("extract_numbers", c, numeric))
        rows.append(("fill_mean", c, f"{numeric} AND count({extract(c)}) < count(*)"))
    for c in numbers:
        a, b = q(c, 0.25), q(c, 0.75)
        rows.append(("fill_mean", c, f"count({c}) < count(*)"))
        rows.append(
            (
                "remove_outliers",
                c,
                f"min({c}) < {a} - 1.5 * ({b} - {a}) OR max({c}) > {b} + 1.5 * ({b} - {a})",
            )
        )
    return " UNION ALL ".join(
        f" SELECT '{rule}' AS rule, '{c}' AS \"column\" FROM n HAVING {test}"
        for rule, c, test in rows
    )


O["suggest_strategy"] = base("dirty_orders") + suggestion()
O["parse_strategy"] = (
    "SELECT p_partkey, p_brand || '|' || p_type AS standardize_text, p_name AS fill_mean, "
    "TRUE AS no_fill_unknown, p_size > 25 AS drop_duplicates FROM part"
)

O["strategy_outcomes"] = (
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'empty' WHEN 3 THEN 'usable' ELSE 'unparsable' END AS outcome FROM part"
)

RUNS = r"""
WITH users AS (SELECT c_custkey AS id, c_nationkey || '_' || c_mktsegment AS username FROM customer),
owners AS (SELECT username, min(id) AS user_id FROM users GROUP BY username {0}),
placed AS (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place
           FROM orders o)
SELECT username, place, o_orderpriority || '.csv' AS filename,
 'clean_' || replace(o_orderpriority, ' ', '_') || '.csv' AS cleaned_filename,
 strftime(o_orderdate, '%Y-%m-%d %H:%M') AS date
FROM placed JOIN owners ON o_custkey = user_id WHERE place <= 10
"""
O["recent_runs"] = RUNS.format("")
O["user_runs"] = RUNS.format("HAVING username = '3_MACHINERY'")
SCORES = (
    "WITH s AS (SELECT CAST(o_orderpriority[1] AS INT) AS seq, o_orderpriority AS model, "
    "avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS score FROM orders GROUP BY ALL)"
)
O["leaderboard"] = SCORES + (
    ", p AS (SELECT seq, model, round_even(score * 100, 2) AS score FROM s) "
    "SELECT CAST(row_number() OVER (ORDER BY score DESC, seq) AS INT) AS rank, model, score, 'Accuracy' AS metric FROM p"
)
O["best_model"] = SCORES + " SELECT model AS best_model FROM s ORDER BY score DESC, seq LIMIT 1"
O["accuracy"] = (
    "SELECT round_even(avg(CAST(CAST(quality = CAST(n_chars > 500 AS INT) AS INT) AS DOUBLE)), 8) AS accuracy "
    "FROM labels JOIN documents USING (doc_id)"
)
O["r2"] = (
    "WITH p AS (SELECT p_retailprice AS y, 900 + (p_partkey % 1000) / 10 AS g FROM part) "
    "SELECT round_even(1 - sum((y - g) ** 2) / sum((y - (SELECT avg(y) FROM p)) ** 2), 8) AS r2 FROM p"
)


O["infer_task"] = (
    f"WITH c AS ({VIEWS['ml_cls']}), g AS ({VIEWS['ml_reg']}) "
    "SELECT 'ml_cls' AS source, 'verdict' AS target, CASE WHEN typeof(any_value(verdict)) = 'VARCHAR' "
    "THEN 'Classification' ELSE 'Regression' END AS task FROM c UNION ALL "
    "SELECT 'ml_reg', 'price', CASE WHEN count(DISTINCT price) <= 15 THEN 'Classification' ELSE 'Regression' END FROM g "
    "UNION ALL SELECT 'ml_clu', 'NONE', 'Clustering' UNION ALL "
    "SELECT 'labels', 'toxic', CASE WHEN count(DISTINCT toxic) <= 15 THEN 'Classification' ELSE 'Regression' END FROM labels"
)
O["encode_label"] = (
    "SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS label FROM documents"
)


def standardised(c: str, source: str, digits: int = 6) -> str:
    filled = f"coalesce({c}, (SELECT avg({c}) FROM {source}))"
    spread = f"(SELECT stddev_pop(coalesce({c}, (SELECT avg({c}) FROM {source}))) FROM {source})"
    return r(f"({filled} - (SELECT avg({c}) FROM {source})) / {spread}", digits)


O["scale_standard"] = f"WITH v AS ({VIEWS['ml_cls']}) SELECT doc_id, " + ", ".join(
    f"{standardised(c, 'v')} AS {c}" for c in ("n_chars", "blanks", "breaks")
) + " FROM v"


def minmaxed(c: str) -> str:
    filled = f"coalesce({c}, (SELECT avg({c}) FROM v))"
    low, high = f"(SELECT min({c}) FROM v)", f"(SELECT max({c}) FROM v)"
    return r(f"CASE WHEN {high} = {low} THEN 0 ELSE ({filled} - {low}) / ({high} - {low}) END", 8)


O["scale_minmax"] = f"WITH v AS ({VIEWS['const_cols']}) SELECT partkey, " + ", ".join(
    f"{minmaxed(c)} AS {c}" for c in ("fixed", "product", "root")
) + " FROM v"
O["one_hot"] = (
    f"WITH v AS ({VIEWS['ml_reg']}), f AS (SELECT p_partkey, coalesce(kind, {mode_of('kind', 'v')}) AS kind FROM v) "
    "SELECT p_partkey, dense_rank() OVER (ORDER BY kind) - 1 AS kind_slot FROM f"
)


def splitting(source: str, key: str) -> str:
    """Rows of ``source`` with ``is_test``, exactly a fifth of them rounded up."""
    return (
        f"SELECT *, row_number() OVER (ORDER BY md5('42|' || {key})) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM {source}"
    )


O["split_exact"] = (
    f"WITH s AS ({splitting('orders', 'o_orderkey')}) "
    "SELECT o_orderkey, CASE WHEN is_test THEN 'test' ELSE 'train' END AS part FROM s"
)
O["features"] = (
    f"WITH v AS ({VIEWS['ml_reg']}), s AS ({splitting('v', 'p_partkey')}), t AS (SELECT * FROM s WHERE NOT is_test), "
    "levels AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS slot FROM (SELECT DISTINCT kind FROM t WHERE kind IS NOT NULL)) "
    f"SELECT p_partkey, {standardised('size', 't')} AS size, {standardised('code', 't')} AS code, "
    f"coalesce(slot, -1) AS kind_slot FROM v LEFT JOIN levels ON coalesce(v.kind, {mode_of('kind', 't')}) = levels.kind"
)
NEAR = (
    f"WITH s AS ({splitting('embeddings', 'vec_id')}), p AS ("
    "SELECT a.vec_id AS query_id, b.vec_id AS train_id, b.label AS label, "
    "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance "
    "FROM s a, s b WHERE a.is_test AND NOT b.is_test), n AS (SELECT *, CAST(row_number() OVER "
    "(PARTITION BY query_id ORDER BY distance, train_id) AS INT) AS rank FROM p QUALIFY rank <= 5)"
)
O["knn_join"] = NEAR + f" SELECT query_id, rank, train_id, {r('distance', 5)} AS distance FROM n"
O["knn_join_cells"] = O["knn_join"]
O["knn_classify"] = NEAR + (
    ", v AS (SELECT query_id, label, count(*) AS votes FROM n GROUP BY ALL) "
    "SELECT query_id AS id, CAST(label AS DOUBLE) AS prediction FROM v "
    "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) = 1"
)
O["knn_regress"] = NEAR + (
    f" SELECT query_id AS id, {r('avg(label)', 6)} AS prediction FROM n GROUP BY query_id"
)


def silhouette_of(distance: str) -> str:
    return (
        f"WITH v AS ({VIEWS['ml_clu']}), p AS (SELECT row_number() OVER () AS id, "
        f"{standardised('c_acctbal', 'v', 12)} AS x, {standardised('nation', 'v', 12)} AS y, c_mktsegment AS m, "
        "CAST(nation AS INT) % 3 AS cluster FROM v), "
        "t AS (SELECT a.id, a.cluster, b.cluster AS other, sum(d) AS total, count(*) AS n FROM ("
        f"SELECT a, b, {distance} AS d FROM p a, p b WHERE a.id <> b.id) GROUP BY ALL), "
        "o AS (SELECT id, sum(total) FILTER (WHERE cluster = other) / sum(n) FILTER (WHERE cluster = other) AS own, "
        "min(total / n) FILTER (WHERE cluster <> other) AS near FROM t GROUP BY id) "
        f"SELECT {r('avg((near - own) / greatest(near, own))', 6)} AS silhouette FROM o"
    )


SQUARED = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + CASE WHEN a.m = b.m THEN 0 ELSE 2 END"
O["silhouette"] = silhouette_of(f"sqrt({SQUARED})")
O["silhouette_squared"] = silhouette_of(SQUARED)
