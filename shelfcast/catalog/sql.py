"""Building blocks of the comparison SQL: named subqueries and what they need."""

from __future__ import annotations

import math

from shelfcast.operators import additive

NEEDS: dict[str, list[str]] = {}
PARTS: dict[str, str] = {}


def part(name: str, needs: str, sql: str) -> None:
    PARTS[name] = sql.strip()
    NEEDS[name] = needs.split()


def query(needs: str, sql: str) -> str:
    """``sql`` after a WITH clause of everything it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS[name]:
            visit(n)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    # Candidates are used by several parts: made once, a reader that wants few rows waits for no repeats.
    once = {n: "MATERIALIZED " if n.endswith("_cand") else "" for n in order}
    parts = ",\n".join(f"{n} AS {once[n]}({PARTS[n]})" for n in order)
    recursive = "RECURSIVE " if any(n.endswith("_solve") for n in order) else ""
    rest = sql.strip()
    if not parts:
        return rest
    # A query may go on with subqueries of its own after a comma.
    return f"WITH {recursive}{parts}{rest}" if rest.startswith(",") else f"WITH {recursive}{parts}\n{rest}"


def r(expr: str, digits: int = 4) -> str:
    """Rounded, and without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


part(
    "raw",
    "",
    """
SELECT CAST(l_shipdate AS DATE) AS date, r_name AS store_id, p_brand AS product_id, p_type AS category,
       floor(l_extendedprice * 100 / l_quantity + CAST(0.5 AS DOUBLE)) / 100 AS price, l_quantity AS sales, l_discount AS disc
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
)
part(
    "fine",
    "",
    """
SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS store_id, CAST(l_partkey AS VARCHAR) AS product_id,
       floor(l_extendedprice * 100 / l_quantity + CAST(0.5 AS DOUBLE)) / 100 AS price, l_quantity AS sales, l_discount AS disc
FROM lineitem
""",
)
part(
    "days",
    "raw",
    """
SELECT store_id, product_id, date, coalesce(sum(sales), 0) AS sales, avg(price) AS price,
       CASE WHEN max(disc) > 0 THEN 1 ELSE 0 END AS promotion, 20 AS safety_stock, 2 AS lead_time_days
FROM raw GROUP BY store_id, product_id, date
""",
)
part(
    "fences",
    "days",
    """
SELECT store_id, product_id, quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.75) AS q3
FROM days GROUP BY store_id, product_id
""",
)
part(
    "cleaned",
    "days fences",
    """
SELECT d.*, CASE WHEN sales > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END AS is_outlier
FROM days d JOIN fences USING (store_id, product_id)
""",
)
part(
    "grid",
    "days",
    """
SELECT store_id, product_id, CAST(day AS DATE) AS date
FROM (SELECT DISTINCT store_id FROM days) CROSS JOIN (SELECT DISTINCT product_id FROM days)
CROSS JOIN (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day FROM days)
""",
)
part(
    "dense",
    "grid cleaned",
    """
SELECT g.store_id, g.product_id, g.date, coalesce(c.sales, 0) AS sales, coalesce(c.promotion, 0) AS promotion,
       coalesce(c.is_outlier, 0) AS is_outlier,
       coalesce(last_value(c.price IGNORE NULLS) OVER b, first_value(c.price IGNORE NULLS) OVER a) AS price,
       coalesce(last_value(c.safety_stock IGNORE NULLS) OVER b, first_value(c.safety_stock IGNORE NULLS) OVER a) AS safety_stock,
       coalesce(last_value(c.lead_time_days IGNORE NULLS) OVER b, first_value(c.lead_time_days IGNORE NULLS) OVER a) AS lead_time_days
FROM grid g LEFT JOIN cleaned c ON g.store_id = c.store_id AND g.product_id = c.product_id AND g.date = c.date
WINDOW b AS (PARTITION BY g.store_id, g.product_id ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       a AS (PARTITION BY g.store_id, g.product_id ORDER BY g.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
""",
)
part(
    "featured",
    "dense",
    """
SELECT *, isodow(date) - 1 AS day_of_week, day(date) AS day_of_month, week(date) AS week_of_year, month(date) AS month,
       quarter(date) AS quarter, dayofyear(date) AS day_of_year, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
       sin((isodow(date) - 1) * (2 * pi()) / 7) AS sin_day_of_week, cos((isodow(date) - 1) * (2 * pi()) / 7) AS cos_day_of_week,
       sin(month(date) * (2 * pi()) / 12) AS sin_month, cos(month(date) * (2 * pi()) / 12) AS cos_month,
       lag(sales, 1) OVER w AS lag_1, lag(sales, 7) OVER w AS lag_7, lag(sales, 14) OVER w AS lag_14, lag(sales, 28) OVER w AS lag_28,
       avg(sales) OVER w7 AS rolling_mean_7, stddev_samp(sales) OVER w7 AS rolling_std_7,
       min(sales) OVER w7 AS rolling_min_7, max(sales) OVER w7 AS rolling_max_7,
       avg(sales) OVER w14 AS rolling_mean_14,
       avg(sales) OVER w28 AS rolling_mean_28, stddev_samp(sales) OVER w28 AS rolling_std_28,
       min(sales) OVER w28 AS rolling_min_28, max(sales) OVER w28 AS rolling_max_28,
       CASE WHEN promotion > 0 THEN 1 ELSE 0 END AS is_promotion,
       lag(price, 1) OVER w AS previous_price
FROM dense
WINDOW w AS (PARTITION BY store_id, product_id ORDER BY date),
       w7 AS (PARTITION BY store_id, product_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
       w14 AS (PARTITION BY store_id, product_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING),
       w28 AS (PARTITION BY store_id, product_id ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)
""",
)
part(
    "labels",
    "days",
    """
SELECT date, CASE WHEN i < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
                  WHEN i < floor(n * CAST(0.85 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
      FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM days))
""",
)


def additive_terms() -> list[str]:
    """The terms of a day, from its place ``u`` in the learnt stretch, ``date`` and ``is_promotion``."""
    a = additive
    out = ["1.0", "u"] + [f"greatest(u - CAST({a.BENDS_UNTIL * k / (a.BENDS + 1)!r} AS DOUBLE), 0)" for k in range(1, a.BENDS + 1)]
    for waves, day, length in ((a.WEEK_WAVES, "(isodow(date) - 1)", 7.0), (a.YEAR_WAVES, "dayofyear(date)", a.YEAR)):
        for j in range(1, waves + 1):
            angle = f"{day} * CAST({2 * math.pi * j / length!r} AS DOUBLE)"
            out += [f"sin({angle})", f"cos({angle})"]
    return [*out, "CAST(is_promotion AS DOUBLE)"]


def additive_parts(prefix: str) -> None:
    """The ridge regression of each series: sums of products, and Gauss-Jordan steps over them."""
    p, k, n = prefix, "store_id, product_id", additive.SIZE
    names = [f"x{i}" for i in range(n)]
    columns = ", ".join(f"{t} AS {x}" for t, x in zip(additive_terms(), names))
    part(
        f"{p}terms",
        f"{p}rows {p}known",
        f"""
SELECT {k}, date, sales, learn, {columns}
FROM (SELECT *, CAST(date - lo AS DOUBLE) / greatest(hi - lo, 1) AS u FROM {p}rows, (SELECT min(date) AS lo, max(date) AS hi FROM {p}known))
""",
    )
    gate = {i: "wk" for i in range(additive.WEEKLY.start, additive.WEEKLY.stop)}
    gate |= {i: "yr" for i in range(additive.YEARLY.start, additive.YEARLY.stop)} | {n - 1: "pr"}

    def cell(i: int, j: int | None) -> str:
        gates = sorted({gate[g] for g in (i, j) if g in gate})
        value = f"sum({names[i]} * {names[j] if j is not None else 'sales'})"
        value = f"CASE WHEN {' AND '.join(gates)} THEN {value} ELSE 0 END" if gates else value
        return f"{value} + {additive.PENALTIES[i]!r} * count(*)" if i == j else value

    rows = ", ".join("[" + ", ".join([cell(i, j) for j in range(n)] + [cell(i, None)]) + "]" for i in range(n))
    gates = f"""span > {additive.WEEKLY_AFTER_DAYS} AS wk, span > {additive.YEARLY_AFTER_DAYS} AS yr, varies AS pr"""
    part(
        f"{p}gram",
        f"{p}terms {p}fit",
        f"""
SELECT {k}, [{rows}] AS a FROM {p}terms JOIN (SELECT {k}, {gates} FROM {p}fit) USING ({k})
WHERE learn GROUP BY {k}, wk, yr, pr
""",
    )
    part(
        f"{p}solve",
        f"{p}gram",
        f"""
SELECT {k}, 1 AS step, a FROM {p}gram
UNION ALL
SELECT {k}, step + 1, list_transform(range(1, {n + 1}), lambda i: CASE WHEN i = step THEN list_transform(a[step], lambda v: v / a[step][step])
       ELSE list_transform(range(1, {n + 2}), lambda j: a[i][j] - a[i][step] * a[step][j] / a[step][step]) END)
FROM {p}solve WHERE step <= {n}
""",
    )
    value = " + ".join(f"a[{i + 1}][{n + 1}] * {x}" for i, x in enumerate(names))
    part(
        f"{p}additive",
        f"{p}solve {p}terms",
        f"""
SELECT {k}, t.date, greatest({value}, 0) AS additive
FROM {p}terms t JOIN {p}solve s USING ({k}) WHERE step = {n + 1} AND NOT learn
""",
    )


def candidate_parts(prefix: str, needs: str, base: str) -> None:
    """Candidate forecasts as joins on fitted tables.

    ``base`` gives ``store_id, product_id, date, sales, is_promotion, learn``.
    """
    p = prefix
    k = "store_id, product_id"
    part(f"{p}rows", needs, base)
    part(
        f"{p}known",
        f"{p}rows",
        f"""
SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY date DESC) AS recency, isodow(date) - 1 AS dow, month(date) AS mon,
       CAST(date - min(date) OVER (PARTITION BY {k}) AS DOUBLE) AS t
FROM {p}rows WHERE learn
""",
    )
    part(
        f"{p}fit",
        f"{p}known",
        f"""
SELECT {k}, arg_max(sales, date) AS last_value, min(date) AS first_date, max(date) - min(date) AS span,
       coalesce(regr_slope(sales, t), 0) AS slope, coalesce(regr_intercept(sales, t), avg(sales)) AS intercept,
       min(is_promotion) < max(is_promotion) AS varies, count(*) < 5 OR sum(sales) = 0 AS naive_only
FROM {p}known GROUP BY {k}
""",
    )
    part(
        f"{p}season",
        f"{p}known",
        f"SELECT {k}, dow, arg_max(sales, date) AS value FROM {p}known WHERE recency <= 7 GROUP BY {k}, dow",
    )
    part(
        f"{p}res1",
        f"{p}known {p}fit",
        f"SELECT x.*, sales - (intercept + slope * t) AS rest, span, varies FROM {p}known x JOIN {p}fit USING ({k})",
    )
    part(f"{p}wk", f"{p}res1", f"SELECT {k}, dow, avg(rest) AS part FROM {p}res1 WHERE span > 14 GROUP BY {k}, dow")
    part(
        f"{p}res2",
        f"{p}res1 {p}wk",
        f"SELECT x.* EXCLUDE (rest), rest - coalesce(part, 0) AS rest FROM {p}res1 x LEFT JOIN {p}wk USING ({k}, dow)",
    )
    part(f"{p}mo", f"{p}res2", f"SELECT {k}, mon, avg(rest) AS part FROM {p}res2 WHERE span > 365 GROUP BY {k}, mon")
    part(
        f"{p}res3",
        f"{p}res2 {p}mo",
        f"SELECT x.* EXCLUDE (rest), rest - coalesce(part, 0) AS rest FROM {p}res2 x LEFT JOIN {p}mo USING ({k}, mon)",
    )
    part(f"{p}pr", f"{p}res3", f"SELECT {k}, is_promotion, avg(rest) AS part FROM {p}res3 WHERE varies GROUP BY {k}, is_promotion")
    additive_parts(p)
    part(
        f"{p}cand",
        f"{p}rows {p}fit {p}season {p}wk {p}mo {p}pr {p}additive",
        f"""
SELECT x.store_id, x.product_id, x.date, x.sales, f.naive_only, greatest(f.last_value, 0) AS baseline_naive,
       greatest(coalesce(s.value, f.last_value), 0) AS baseline_seasonal_naive,
       greatest(f.intercept + f.slope * CAST(x.date - f.first_date AS DOUBLE) + coalesce(wk.part, 0) + coalesce(mo.part, 0)
                + coalesce(pr.part, 0), 0) AS trend_seasonal, ad.additive
FROM {p}rows x JOIN {p}fit f ON x.store_id = f.store_id AND x.product_id = f.product_id
LEFT JOIN {p}season s ON x.store_id = s.store_id AND x.product_id = s.product_id AND isodow(x.date) - 1 = s.dow
LEFT JOIN {p}wk wk ON x.store_id = wk.store_id AND x.product_id = wk.product_id AND isodow(x.date) - 1 = wk.dow
LEFT JOIN {p}mo mo ON x.store_id = mo.store_id AND x.product_id = mo.product_id AND month(x.date) = mo.mon
LEFT JOIN {p}pr pr ON x.store_id = pr.store_id AND x.product_id = pr.product_id AND x.is_promotion = pr.is_promotion
JOIN {p}additive ad ON x.store_id = ad.store_id AND x.product_id = ad.product_id AND x.date = ad.date
WHERE NOT x.learn
""",
    )


_ROWS = "SELECT store_id, product_id, d.date, sales, CASE WHEN promotion > 0 THEN 1 ELSE 0 END AS is_promotion"
candidate_parts("v_", "dense labels", f"{_ROWS}, split = 'train' AS learn FROM dense d JOIN labels USING (date) WHERE split <> 'test'")
candidate_parts("t_", "dense labels", f"{_ROWS}, split = 'train' AS learn FROM dense d JOIN labels USING (date)")
candidate_parts(
    "f_",
    "dense",
    f"""
{_ROWS}, true AS learn FROM dense d
UNION ALL
SELECT store_id, product_id, CAST(last_date + CAST(h AS INTEGER) AS DATE), NULL, 0, false
FROM (SELECT store_id, product_id, max(date) AS last_date FROM dense GROUP BY store_id, product_id)
CROSS JOIN generate_series(1, 7) AS g(h)
""",
)
part(
    "v_long",
    "v_cand",
    """
SELECT store_id, product_id, date, sales AS y, model_type, yhat
FROM v_cand UNPIVOT (yhat FOR model_type IN (additive, trend_seasonal, baseline_seasonal_naive, baseline_naive))
WHERE NOT naive_only OR model_type = 'baseline_naive'
""",
)
part(
    "scores",
    "v_long",
    """
SELECT store_id, product_id, model_type, round_even(mae, 2) AS mae, round_even(rmse, 2) AS rmse, round_even(mape, 2) AS mape,
       round_even(wape, 2) AS wape, n,
       CASE WHEN wape < 10 THEN 'Excellent' WHEN wape < 20 THEN 'Good' WHEN wape < 35 THEN 'Moderate' ELSE 'Low' END AS reliability
FROM (SELECT store_id, product_id, model_type, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
             coalesce(avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END), 0) * 100 AS mape,
             sum(abs(y - yhat)) / CASE WHEN sum(y) = 0 THEN 1e-6 ELSE sum(y) END * 100 AS wape, count(*) AS n
      FROM v_long GROUP BY store_id, product_id, model_type)
""",
)
part(
    "ranked",
    "scores",
    """
SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY wape, mae,
       CASE model_type WHEN 'additive' THEN 0 WHEN 'trend_seasonal' THEN 1 WHEN 'baseline_seasonal_naive' THEN 2 ELSE 3 END) AS place
FROM scores
""",
)
part("best", "ranked", "SELECT *, 1 AS version FROM ranked WHERE place = 1")
part(
    "coming",
    "f_cand best",
    """
SELECT c.store_id, c.product_id, c.date, b.model_type AS selected_model, b.version AS model_version,
       greatest(CAST(round_even(CASE b.model_type WHEN 'additive' THEN additive WHEN 'trend_seasonal' THEN trend_seasonal
            WHEN 'baseline_seasonal_naive' THEN baseline_seasonal_naive ELSE baseline_naive END, 0) AS BIGINT), 0) AS predicted_demand,
       b.wape AS validation_score, b.reliability
FROM f_cand c JOIN best b ON c.store_id = b.store_id AND c.product_id = b.product_id
""",
)


def decision_parts(prefix: str, needs: str, base: str, extra: str = "") -> None:
    """Reorder decisions step by step.

    ``base`` gives one row per item: stock, demand, horizon, lead time, supplier
    and limit columns and ``daily_ltd`` (null where the average applies).
    """
    p = prefix
    part(f"{p}base", needs, base)
    part(
        f"{p}a",
        f"{p}base",
        f"""
SELECT *, current_stock + incoming_stock - reserved_stock AS inventory_position,
       CASE WHEN forecast_horizon > 0 THEN CAST(forecast_demand AS DOUBLE) / forecast_horizon ELSE 0 END AS avg_daily
FROM {p}base
""",
    )
    part(f"{p}b", f"{p}a", f"SELECT *, coalesce(daily_ltd, CAST(trunc(avg_daily * lead_time_days) AS BIGINT)) AS lead_time_demand FROM {p}a")
    part(
        f"{p}c",
        f"{p}b",
        f"""
SELECT *, CAST(ceil(CAST(1.645 AS DOUBLE) * CASE WHEN lead_time_demand > 0 THEN sqrt(lead_time_demand) ELSE 1 END) AS BIGINT) AS safety_stock
FROM {p}b
""",
    )
    part(
        f"{p}d",
        f"{p}c",
        f"""
SELECT *, lead_time_demand + safety_stock AS reorder_point,
       inventory_position <= lead_time_demand + safety_stock AS should_reorder,
       CAST(ceil(avg_daily * 7 + lead_time_demand + safety_stock) AS BIGINT) AS target_stock
FROM {p}c
""",
    )
    part(
        f"{p}e",
        f"{p}d",
        f"""
SELECT *, should_reorder AND supplier_availability AS ordering, greatest(target_stock - inventory_position, 0) AS q0,
       greatest(maximum_inventory - inventory_position, 0) AS room, coalesce(maximum_inventory <> 0, false) AS has_max
FROM {p}d
""",
    )
    part(f"{p}f", f"{p}e", f"SELECT *, has_max AND q0 > room AS capped, CASE WHEN has_max AND q0 > room THEN room ELSE q0 END AS q1 FROM {p}e")
    part(
        f"{p}g",
        f"{p}f",
        f"""
SELECT *, minimum_order_quantity > 1 AND q1 > 0 AND q1 < minimum_order_quantity AS raised,
       CASE WHEN minimum_order_quantity > 1 AND q1 > 0 AND q1 < minimum_order_quantity THEN minimum_order_quantity ELSE q1 END AS q2
FROM {p}f
""",
    )
    part(
        f"{p}h",
        f"{p}g",
        f"""
SELECT *, order_multiple > 1 AND q2 > 0 AND q2 % order_multiple <> 0 AS upped,
       CASE WHEN order_multiple > 1 AND q2 > 0 AND q2 % order_multiple <> 0 THEN q2 + order_multiple - q2 % order_multiple ELSE q2 END AS q3,
       CAST(trunc(avg_daily * shelf_life_days) AS BIGINT) AS sellable
FROM {p}g
""",
    )
    part(
        f"{p}i",
        f"{p}h",
        f"""
SELECT *, coalesce(shelf_life_days <> 0, false) AND q3 > sellable AS expires,
       CASE WHEN coalesce(shelf_life_days <> 0, false) AND q3 > sellable THEN sellable ELSE q3 END AS q4
FROM {p}h
""",
    )
    part(
        f"{p}decided",
        f"{p}i",
        f"""
SELECT *, CASE WHEN ordering THEN q4 ELSE 0 END AS recommended_order,
       CASE WHEN has_max AND inventory_position > maximum_inventory THEN 'OVERSTOCK'
            WHEN inventory_position <= safety_stock THEN 'CRITICAL' WHEN inventory_position <= reorder_point THEN 'REORDER'
            WHEN inventory_position <= reorder_point + (target_stock - reorder_point) * CAST(0.3 AS DOUBLE) THEN 'LOW_STOCK'
            ELSE 'HEALTHY' END AS stock_status,
       CASE WHEN inventory_position <= forecast_demand * CAST(0.2 AS DOUBLE) THEN 'CRITICAL'
            WHEN inventory_position <= forecast_demand * CAST(0.5 AS DOUBLE) THEN 'HIGH'
            WHEN inventory_position <= forecast_demand THEN 'MEDIUM' ELSE 'LOW' END AS stockout_risk,
       CASE WHEN inventory_position >= forecast_demand * 3 THEN 'HIGH'
            WHEN inventory_position >= forecast_demand * 2 THEN 'MEDIUM' ELSE 'LOW' END AS overstock_risk,
       concat_ws(' | ',
            CASE WHEN NOT should_reorder THEN 'Inventory position is above reorder point.'
                 WHEN NOT supplier_availability THEN 'Supplier is unavailable.' END,
            CASE WHEN ordering AND capped THEN 'Order capped by max inventory limit (' || maximum_inventory || ').' END,
            CASE WHEN ordering AND raised THEN 'Order increased to meet minimum order quantity (' || minimum_order_quantity || ').' END,
            CASE WHEN ordering AND upped THEN 'Order rounded up to match supplier multiple (' || order_multiple || ').' END,
            CASE WHEN ordering AND expires AND sellable = 0 THEN 'Order set to zero because shelf life will expire before demand materializes.'
                 WHEN ordering AND expires THEN 'Order strictly capped by perishable shelf-life limit (' || sellable || ' units).' END,
            CASE WHEN ordering AND q4 > 0 THEN 'Inventory position (' || inventory_position || ') dropped below reorder point (' || reorder_point || ').' END
       ) AS found
FROM {p}i
""",
    )
    part(
        f"{p}decisions",
        f"{p}decided",
        f"SELECT *, CASE WHEN found = '' THEN 'Stock levels are adequate.' ELSE found END AS reason, '1.0' AS decision_version FROM {p}decided",
    )
