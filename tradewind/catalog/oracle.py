"""DuckDB SQL for every registered query.

Written from the KPI definitions, not from the Spark plans: one row per as-of
date and source row for periods, a recursive day-by-day loop for the stock
ledger, ``format`` for number texts.
"""

from __future__ import annotations

LAST_ORDER_DAY = "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"
FIRST_ORDER_DAY = "(SELECT min(CAST(o_orderdate AS DATE)) FROM orders)"
LAST_SHIP_DAY = "(SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)"
FIRST_SHIP_DAY = "(SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem)"
LAST_EVENT_DAY = "(SELECT max(CAST(ts AS DATE)) FROM events)"
FIRST_EVENT_DAY = "(SELECT min(CAST(ts AS DATE)) FROM events)"
EVENT_SHIFT = f"CAST({LAST_EVENT_DAY} - {LAST_ORDER_DAY} AS INTEGER)"
SHIPPING_LAG = f"CAST({LAST_SHIP_DAY} - {LAST_ORDER_DAY} AS INTEGER)"


def r(value: str, digits: int) -> str:
    """Half away from zero on the shortest decimal text of a double."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def discounted(price: str) -> str:
    return f"round(CAST({price} AS DECIMAL(18,6)) * (1 - CAST(discount AS DECIMAL(9,6))), 2)"


def even(value: str, digits: int) -> str:
    """Half to even on the exact binary value."""
    return f"CAST(format('{{:.{digits}f}}', {value}) AS DOUBLE)"


def pct(c: str, p: str) -> str:
    return r(f"CASE WHEN {p} <> 0 THEN CAST({c} - {p} AS DOUBLE) / CAST({p} AS DOUBLE) * 100 END", 1)


def days(count: int) -> str:
    return f"SELECT CAST(range AS INTEGER) FROM range({count})"


def anchors(last: str, count: int | None = None, first: str | None = None, window: int = 30, step: int = 1) -> str:
    """CTE body: as-of dates with their window, latest first as far as asked."""
    if count is not None:
        return (
            f"SELECT CAST({last} - i * {step} AS DATE) AS as_of, {window} AS w FROM ({days(count)}) t(i)"
        )
    return (
        f"SELECT CAST({last} - i * {step} AS DATE) AS as_of, {window} AS w FROM ({days(20000)}) t(i) "
        f"WHERE {last} - i * {step} >= {first} + {2 * window - 1}"
    )


ONE = lambda last, window: anchors(last, count=1, window=window)

CUR = "{d} BETWEEN as_of - (w - 1) AND as_of"
PREV = "{d} BETWEEN as_of - (2 * w - 1) AND as_of - w"


def cur(day: str) -> str:
    return CUR.format(d=day)


def prev(day: str) -> str:
    return PREV.format(d=day)


def both(day: str) -> str:
    return f"{day} BETWEEN as_of - (2 * w - 1) AND as_of"


LINE_COLUMNS = """l_orderkey AS order_id, l_linenumber AS line_no, CAST(l_shipdate AS DATE) AS ship_date,
    l_partkey AS sku_id, l_extendedprice AS extended_price, CAST(l_quantity AS BIGINT) AS quantity,
    l_discount AS discount, l_returnflag = 'R' AS returned"""

LINES = f"""lines AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT {LINE_COLUMNS},
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CAST(l_shipdate AS DATE), l_partkey,
        l_extendedprice, CAST(l_quantity AS BIGINT), l_discount, l_returnflag = 'R') AS rn
    FROM lineitem) WHERE rn = 1)"""

ORDER_LINES = f"""{LINES},
order_lines AS (
  SELECT l.*, CAST(o_orderdate AS DATE) AS order_date, o_custkey AS customer_id, trim(o_orderpriority) AS channel,
    trim(p_brand) AS brand,
    {discounted('extended_price')} AS net
  FROM lines l JOIN orders ON o_orderkey = order_id JOIN part ON p_partkey = sku_id)"""

HEADS = """heads AS (
  SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, o_custkey AS customer_id,
    o_orderpriority AS channel, o_totalprice AS net_sales,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_new_customer
  FROM orders)"""

CUSTOMERS = """customers AS (
  SELECT o_custkey AS customer_id, any_value(c_mktsegment) AS acquisition_channel,
    min(CAST(o_orderdate AS DATE)) AS first_order_date, count(*) AS total_orders,
    CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,6))), 2) AS DOUBLE) AS total_net_sales,
    count(*) > 1 AS is_returning
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey)"""

CHANNELS = "['paid_search', 'paid_social', 'affiliate', 'referral']"
K = "CAST(json_extract(props, '$.k') AS INTEGER)"


def marketing(shift: str = "0") -> str:
    def money(kind: str) -> str:
        return (
            f"CAST(coalesce(sum(CAST(value AS DECIMAL(18,6))) FILTER (event_type = '{kind}'), 0) AS DOUBLE)"
        )

    return f"""marketing AS (
  SELECT CAST(CAST(ts AS DATE) - {shift} AS DATE) AS date, 'B' || ({K} % 5) AS brand,
    {CHANNELS}[user_id % 3 + 1] AS marketing_channel,
    {money('click')} AS spend,
    count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
    count(*) FILTER (event_type = 'purchase') AS attributed_orders,
    {money('purchase')} AS attributed_revenue
  FROM events GROUP BY ALL)"""


def acquired(shift: str = "0") -> str:
    return f"""acquired AS (
  SELECT user_id AS customer_id, {CHANNELS}[{K} % 4 + 1] AS acquisition_channel,
    CAST(CAST(ts AS DATE) - {shift} AS DATE) AS first_order_date
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
        FROM events WHERE event_type = 'signup') WHERE rn = 1)"""


SKUS = """skus AS (
  SELECT p_partkey AS sku_id, trim(p_brand) AS brand, p_retailprice AS base_price,
    CAST(round(CAST(p_retailprice AS DECIMAL(18,6)) * 0.45, 2) AS DOUBLE) AS unit_cost,
    CAST(p_size AS BIGINT) * 5 AS opening0 FROM part)"""

UNITS = """units AS (
  SELECT sku_id, ship_date AS date, CAST(sum(quantity) AS BIGINT) AS units FROM lines GROUP BY ALL)"""


def demand(end: str) -> str:
    return f"""{LINES}, {SKUS}, {UNITS},
span AS (SELECT {FIRST_SHIP_DAY} AS first_day, {end} AS last_day),
rate AS (
  SELECT s.sku_id, coalesce(CAST(sum(u.units) AS DOUBLE) / 30.0, 0.5) AS daily_demand
  FROM skus s LEFT JOIN (SELECT units.* FROM units, span WHERE date BETWEEN last_day - 59 AND last_day - 30) u
    ON u.sku_id = s.sku_id GROUP BY s.sku_id),
calendar AS (
  SELECT CAST(first_day + i AS DATE) AS date, CAST(i AS INTEGER) AS day_index
  FROM span, ({days(20000)}) t(i) WHERE first_day + i <= last_day),
grid AS (
  SELECT s.sku_id, s.brand, s.opening0, daily_demand, c.date, day_index, coalesce(u.units, 0) AS demand
  FROM skus s JOIN rate USING (sku_id), calendar c
  LEFT JOIN units u ON u.sku_id = s.sku_id AND u.date = c.date),
signal AS (
  SELECT g.*, CAST(coalesce(sum(demand) OVER (PARTITION BY sku_id ORDER BY date ROWS BETWEEN 7 PRECEDING
    AND 1 PRECEDING), 0) AS BIGINT) AS trailing_demand FROM grid g),
plan AS (
  SELECT *, CASE WHEN day_index = 0 THEN CAST(round_even(daily_demand * 7, 0) AS BIGINT)
    WHEN day_index % 7 = 0 THEN trailing_demand ELSE 0 END AS receipts FROM signal)"""


def stock(end: str) -> str:
    """The ledger as a plain loop over days. Needs WITH RECURSIVE."""
    return f"""{demand(end)},
ledger AS (
  SELECT sku_id, brand, date, day_index, demand, opening0 AS opening_stock, receipts,
    least(demand, opening0 + receipts) AS units_sold,
    opening0 + receipts - least(demand, opening0 + receipts) AS closing_stock
  FROM plan WHERE day_index = 0
  UNION ALL
  SELECT p.sku_id, p.brand, p.date, p.day_index, p.demand, l.closing_stock, p.receipts,
    least(p.demand, l.closing_stock + p.receipts),
    l.closing_stock + p.receipts - least(p.demand, l.closing_stock + p.receipts)
  FROM ledger l JOIN plan p ON p.sku_id = l.sku_id AND p.day_index = l.day_index + 1),
inventory AS (
  SELECT date, sku_id, brand, CAST(opening_stock AS BIGINT) AS opening_stock, CAST(receipts AS BIGINT) AS receipts,
    CAST(units_sold AS BIGINT) AS units_sold, CAST(closing_stock AS BIGINT) AS closing_stock FROM ledger)"""


def segments(*columns: str, name: str = "segments") -> str:
    """Needs order_lines and anchors."""
    cols = ", ".join(columns)
    return f"""{name}_sums AS (
  SELECT as_of, {cols}, sum(CASE WHEN {cur('order_date')} THEN net ELSE 0 END) AS c,
    sum(CASE WHEN {prev('order_date')} THEN net ELSE 0 END) AS p
  FROM order_lines JOIN anchors ON {both('order_date')} GROUP BY ALL),
{name} AS (
  SELECT as_of, {cols}, CAST(c AS DOUBLE) AS current_net_revenue, CAST(p AS DOUBLE) AS previous_net_revenue,
    CAST(c - p AS DOUBLE) AS change, {pct('c', 'p')} AS pct_change FROM {name}_sums)"""


SUMMARY = f"""summary_sums AS (
  SELECT as_of,
    coalesce(CAST(sum(net) FILTER ({cur('order_date')}) AS DOUBLE), 0) AS current_net_revenue,
    count(DISTINCT order_id) FILTER ({cur('order_date')}) AS current_orders,
    CAST(coalesce(sum(quantity) FILTER ({cur('order_date')}), 0) AS BIGINT) AS current_units_sold,
    coalesce(CAST(sum(net) FILTER ({prev('order_date')}) AS DOUBLE), 0) AS previous_net_revenue,
    count(DISTINCT order_id) FILTER ({prev('order_date')}) AS previous_orders,
    CAST(coalesce(sum(quantity) FILTER ({prev('order_date')}), 0) AS BIGINT) AS previous_units_sold
  FROM anchors LEFT JOIN order_lines ON {both('order_date')} GROUP BY as_of),
summary_aov AS (
  SELECT *, coalesce({r('current_net_revenue / nullif(current_orders, 0)', 2)}, 0.0) AS current_aov,
    coalesce({r('previous_net_revenue / nullif(previous_orders, 0)', 2)}, 0.0) AS previous_aov FROM summary_sums),
summary AS (
  SELECT *, {pct('current_net_revenue', 'previous_net_revenue')} AS pct_net_revenue,
    {pct('current_orders', 'previous_orders')} AS pct_orders,
    {pct('current_units_sold', 'previous_units_sold')} AS pct_units_sold,
    {pct('current_aov', 'previous_aov')} AS pct_aov FROM summary_aov)"""

MARKETING_SEGMENTS = f"""msums AS (
  SELECT as_of, brand, marketing_channel,
    sum(CASE WHEN {cur('date')} THEN CAST(spend AS DECIMAL(18,6)) ELSE 0 END) AS cs,
    sum(CASE WHEN {cur('date')} THEN CAST(attributed_revenue AS DECIMAL(18,6)) ELSE 0 END) AS cr,
    sum(CASE WHEN {prev('date')} THEN CAST(spend AS DECIMAL(18,6)) ELSE 0 END) AS ps,
    sum(CASE WHEN {prev('date')} THEN CAST(attributed_revenue AS DECIMAL(18,6)) ELSE 0 END) AS pr
  FROM marketing JOIN anchors ON {both('date')} GROUP BY ALL),
mseg AS (
  SELECT as_of, brand, marketing_channel, CAST(cs AS DOUBLE) AS current_spend,
    CAST(cr AS DOUBLE) AS current_attributed_revenue,
    coalesce((CAST(cr AS DOUBLE)) / nullif(CAST(cs AS DOUBLE), 0), 0.0) AS current_roas,
    CAST(ps AS DOUBLE) AS previous_spend, CAST(pr AS DOUBLE) AS previous_attributed_revenue,
    coalesce((CAST(pr AS DOUBLE)) / nullif(CAST(ps AS DOUBLE), 0), 0.0) AS previous_roas
  FROM msums),
msegments AS (SELECT *, {pct('current_roas', 'previous_roas')} AS roas_change_pct FROM mseg)"""

CAC = f"""spent AS (
  SELECT as_of, marketing_channel, CAST(sum(CAST(spend AS DECIMAL(18,6))) AS DOUBLE) AS spend
  FROM marketing JOIN anchors ON {cur('date')} GROUP BY ALL),
gained AS (
  SELECT as_of, acquisition_channel AS marketing_channel, count(*) AS new_customers
  FROM acquired JOIN anchors ON {cur('first_order_date')} GROUP BY ALL),
cac AS (
  SELECT as_of, marketing_channel, coalesce(spend, 0.0) AS spend, coalesce(new_customers, 0) AS new_customers,
    {r('coalesce(spend, 0.0) / nullif(new_customers, 0)', 2)} AS cac
  FROM spent FULL OUTER JOIN gained USING (as_of, marketing_channel))"""

MIX = f"""mix_shares AS (
  SELECT as_of, {r(f"avg(CAST(is_new_customer AS INTEGER)) FILTER ({cur('order_date')})", 3)} AS current_new_share,
    {r(f"avg(CAST(is_new_customer AS INTEGER)) FILTER ({prev('order_date')})", 3)} AS previous_new_share
  FROM anchors LEFT JOIN heads ON {both('order_date')} GROUP BY as_of),
mix AS (
  SELECT *, {r('1 - current_new_share', 3)} AS current_returning_share,
    {r('1 - previous_new_share', 3)} AS previous_returning_share FROM mix_shares)"""


STOCK_SUMS = ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("opening_stock", "receipts", "units_sold", "closing_stock")
)


def risk(velocity_days: int = 14, stockout: float = 7, excess: float = 60) -> str:
    """Needs inventory and anchors."""
    return f"""velocity AS (
  SELECT as_of, sku_id, {r('CAST(sum(units_sold) AS DOUBLE) / count(*)', 2)} AS velocity
  FROM inventory JOIN anchors ON date BETWEEN as_of - {velocity_days - 1} AND as_of GROUP BY ALL),
cover AS (
  SELECT as_of, i.sku_id, brand, closing_stock AS on_hand, coalesce(velocity, 0.0) AS velocity,
    CASE WHEN velocity > 0 THEN {r('closing_stock / velocity', 1)} END AS days_of_cover
  FROM anchors JOIN inventory i ON date = as_of LEFT JOIN velocity USING (as_of, sku_id)),
risk AS (
  SELECT *, days_of_cover IS NOT NULL AND days_of_cover < {stockout} AS stockout_risk,
    on_hand > 0 AND (velocity = 0 OR (days_of_cover IS NOT NULL AND days_of_cover > {excess})) AS excess_risk
  FROM cover)"""


# --- rules: one row per item ------------------------------------------------

ITEM = """as_of, lens, lens_order, issue_type, severity, headline, driver, possible_action, kpi_to_monitor, impact,
  order_value, order_key1, order_key2"""


def sales_items(medium: str = "-20", high: str = "-35", least: str = "500", extra: str = "") -> str:
    return f"""SELECT {extra}as_of, 'sales' AS lens, 0 AS lens_order, 'sales_decline' AS issue_type,
    CASE WHEN pct_change <= {high} THEN 'high' ELSE 'medium' END AS severity,
    'Material sales decline in ' || brand || ' / ' || channel AS headline,
    'Net revenue moved from ' || format('{{:.0f}}', previous_net_revenue) || ' to '
      || format('{{:.0f}}', current_net_revenue) || ' (' || format('{{:.1f}}', pct_change) || '%).' AS driver,
    'Investigate demand/pricing/assortment for ' || brand || ' / ' || channel || '.' AS possible_action,
    'net_revenue[' || brand || ' / ' || channel || ']' AS kpi_to_monitor, change AS impact,
    -abs(change) AS order_value, brand AS order_key1, channel AS order_key2,
    brand, channel, current_net_revenue, previous_net_revenue, pct_change
  FROM segments WHERE previous_net_revenue >= {least} AND pct_change <= {medium}"""


def marketing_items(medium: str = "-20", high: str = "-40", least: str = "1000", extra: str = "") -> str:
    change = "((current_roas - previous_roas) / previous_roas * 100)"
    return f"""SELECT {extra}as_of, 'marketing' AS lens, 1 AS lens_order, 'marketing_efficiency_decline' AS issue_type,
    CASE WHEN {change} <= {high} THEN 'high' ELSE 'medium' END AS severity,
    'Marketing efficiency deteriorating for ' || brand || ' / ' || marketing_channel AS headline,
    'Spend changed from ' || format('{{:.0f}}', previous_spend) || ' to ' || format('{{:.0f}}', current_spend)
      || ' while attributed revenue changed from ' || format('{{:.0f}}', previous_attributed_revenue)
      || ' to ' || format('{{:.0f}}', current_attributed_revenue) || '.' AS driver,
    'Review targeting, creative, and bid strategy for ' || brand || ' / ' || marketing_channel
      || '; consider reallocating budget to better-performing segments.' AS possible_action,
    'roas[' || brand || ' / ' || marketing_channel || ']' AS kpi_to_monitor,
    {even('current_attributed_revenue - current_spend * previous_roas', 2)} AS impact,
    roas_change_pct AS order_value, brand AS order_key1, marketing_channel AS order_key2,
    brand, marketing_channel, {even('current_roas', 2)} AS current_roas, {even('previous_roas', 2)} AS previous_roas,
    {even(change, 1)} AS roas_change_pct, current_spend
  FROM msegments WHERE previous_spend >= {least} AND previous_roas <> 0 AND {change} <= {medium}"""


def mix_items(medium: str = "-25", high: str = "-50", extra: str = "") -> str:
    change = "((current_new_share - previous_new_share) / previous_new_share * 100)"
    return f"""SELECT {extra}as_of, 'customer' AS lens, 2 AS lens_order, 'customer_mix_shift' AS issue_type,
    CASE WHEN {change} <= {high} THEN 'high' ELSE 'medium' END AS severity,
    'New-customer acquisition share dropping sharply' AS headline,
    'Share of orders from new customers moved from ' || format('{{:.0f}}', previous_new_share * 100) || '% to '
      || format('{{:.0f}}', current_new_share * 100) || '%.' AS driver,
    'Review acquisition marketing spend/effectiveness; confirm this is not a data/tracking issue.' AS possible_action,
    'new_customer_share' AS kpi_to_monitor, CAST(NULL AS DOUBLE) AS impact,
    0.0 AS order_value, '' AS order_key1, '' AS order_key2,
    current_new_share, previous_new_share, {even(change, 1)} AS pct_change
  FROM mix WHERE previous_new_share <> 0 AND {change} <= {medium}"""


def stock_items(high: str = "3", stockout: str | None = None, excess: str | None = None, extra: str = "") -> str:
    """Over risk, or over other limits where given."""
    source = "risk"
    if stockout is not None:
        source = f"""(SELECT * EXCLUDE (stockout_risk, excess_risk),
      days_of_cover IS NOT NULL AND days_of_cover < {stockout} AS stockout_risk,
      on_hand > 0 AND (velocity = 0 OR (days_of_cover IS NOT NULL AND days_of_cover > {excess})) AS excess_risk
    FROM risk)"""
    return f"""SELECT {extra}as_of, 'inventory' AS lens, 3 AS lens_order,
    CASE WHEN stockout_risk THEN 'stockout_risk' ELSE 'excess_inventory_risk' END AS issue_type,
    CASE WHEN NOT stockout_risk THEN 'low' WHEN days_of_cover < {high} THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN stockout_risk THEN 'Stock-out risk' ELSE 'Excess inventory risk' END
      || ' for SKU ' || sku_id || ' (' || brand || ')' AS headline,
    CASE WHEN stockout_risk THEN 'Demand of ~' || format('{{:.1f}}', velocity)
        || ' units/day against on-hand stock of ' || on_hand || ' leaves ~' || format('{{:.1f}}', days_of_cover)
        || ' days of cover.'
      ELSE 'On-hand stock of ' || on_hand || ' against demand of only ~' || format('{{:.1f}}', velocity)
        || ' units/day.' END AS driver,
    CASE WHEN stockout_risk THEN 'Expedite replenishment for ' || sku_id || '; consider a temporary allocation cap.'
      ELSE 'Consider a promotion or markdown for ' || sku_id || ' to work down excess stock.' END AS possible_action,
    'days_of_cover[' || sku_id || ']' AS kpi_to_monitor, CAST(NULL AS DOUBLE) AS impact,
    days_of_cover AS order_value, CAST(sku_id AS VARCHAR) AS order_key1, '' AS order_key2,
    brand, CAST(sku_id AS VARCHAR) AS sku_id, CAST(on_hand AS DOUBLE) AS on_hand, velocity AS velocity_per_day,
    days_of_cover
  FROM {source} WHERE stockout_risk OR excess_risk"""


def together(anchor_body: str, items: bool = True) -> str:
    """All sections on the order clock, and their items."""
    text = f"""anchors AS ({anchor_body}), {ORDER_LINES}, {HEADS}, {CUSTOMERS}, {marketing(EVENT_SHIFT)},
{acquired(EVENT_SHIFT)}, {stock(LAST_ORDER_DAY).removeprefix(LINES + ', ')},
{segments('brand', 'channel')}, {segments('sku_id', 'brand', name='sku_segments')}, {SUMMARY}, {MARKETING_SEGMENTS},
{CAC}, {MIX}, {risk()}"""
    if not items:
        return text
    return f"""{text},
items AS (
  SELECT {ITEM} FROM ({sales_items()}) UNION ALL SELECT {ITEM} FROM ({marketing_items()})
  UNION ALL SELECT {ITEM} FROM ({mix_items()}) UNION ALL SELECT {ITEM} FROM ({stock_items()})),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY
    CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, abs(impact) DESC NULLS LAST, lens_order,
    order_value ASC NULLS FIRST, order_key1, order_key2) AS rank FROM items)"""


TOGETHER = ONE(LAST_ORDER_DAY, 14)
TOGETHER_DAYS = anchors(LAST_ORDER_DAY, first=FIRST_ORDER_DAY, window=14, step=7)
TWO_DATES = (
    f"SELECT CAST({LAST_ORDER_DAY} AS DATE) AS as_of, 14 AS w UNION ALL SELECT CAST({LAST_ORDER_DAY} - 28 AS DATE), 14"
)
SALES_DAYS = anchors(LAST_ORDER_DAY, first=FIRST_ORDER_DAY, window=30)
SALES_AS_OF = ONE(LAST_ORDER_DAY, 30)
MARKETING_AS_OF = ONE(LAST_EVENT_DAY, 14)
MARKETING_DAYS = anchors(LAST_EVENT_DAY, first=FIRST_EVENT_DAY, window=7)
CAC_AS_OF = ONE(LAST_EVENT_DAY, 30)
STOCK_AS_OF = ONE(LAST_SHIP_DAY, 30)
STOCK_DAYS = anchors(LAST_SHIP_DAY, first=FIRST_SHIP_DAY, window=30, step=7)

BOUNDS = f"""bounds AS (
  SELECT greatest((SELECT max(CAST(o_orderdate AS DATE)) FROM orders),
      (SELECT CAST(max(CAST(ts AS DATE)) - {EVENT_SHIFT} AS DATE) FROM events),
      (SELECT CAST(max(CAST(l_shipdate AS DATE)) - {SHIPPING_LAG} AS DATE) FROM lineitem)) AS latest,
    (SELECT min(CAST(o_orderdate AS DATE)) FROM orders) AS earliest)"""


def bound_anchors(step: int) -> str:
    return f"""{BOUNDS}, anchors AS (
  SELECT CAST(latest - i * {step} AS DATE) AS as_of FROM bounds, ({days(20000)}) t(i)
  WHERE latest - i * {step} >= earliest + 59)"""


def sales_history(body: str, *columns: str) -> str:
    return f"WITH anchors AS ({body}), {ORDER_LINES}, {segments(*columns)} SELECT * FROM segments"


def with_mix(body: str) -> str:
    return f"WITH anchors AS ({body}), {HEADS}, {MIX} SELECT * FROM mix"


def with_risk(body: str, **limits) -> str:
    return f"WITH RECURSIVE anchors AS ({body}), {stock(LAST_SHIP_DAY)}, {risk(**limits)}"


def flat(*columns: str) -> str:
    extra = "".join(f", {c}" for c in columns)
    return f"as_of, issue_type, severity, headline, driver, possible_action, kpi_to_monitor, impact{extra}"


def comma(value: str) -> str:
    return f"format('{{:,.0f}}', {value})"


def money(value: str) -> str:
    return f"coalesce(CASE WHEN {value} < 0 THEN '-$' ELSE '$' END || format('{{:,.0f}}', abs({value})), 'n/a')"


def signed(value: str) -> str:
    return f"coalesce(format('{{:+.1f}}%', {value}), 'n/a')"


def tile(key: str, label: str, value: str, delta: str, source: str) -> str:
    return f"SELECT as_of, '{key}' AS tile, '{label}' AS label, {value} AS value, {delta} AS delta FROM {source}"


def sweep_items(name: str, **limits) -> str:
    scenario = f"'{name}' AS scenario, "
    cols = "scenario, as_of, lens, issue_type, severity, kpi_to_monitor"
    parts = (
        sales_items(*limits.get("sales", ()), extra=scenario),
        marketing_items(*limits.get("marketing", ()), extra=scenario),
        mix_items(*limits.get("customer", ()), extra=scenario),
        stock_items(*limits.get("inventory", ()), extra=scenario),
    )
    return " UNION ALL ".join(f"SELECT {cols} FROM ({p})" for p in parts)


def localized(lang: str) -> str:
    """Headline, driver and action in `lang`, over the typed items."""
    ko = lang == "ko"
    signed_text = lambda v: f"format('{{:+.1f}}%', {v})"
    two = lambda v: f"format('{{:.2f}}', {v})"
    one = lambda v: f"format('{{:.1f}}', {v})"
    whole = lambda v: f"CAST(CAST({v} AS BIGINT) AS VARCHAR)"
    texts = {
        "sales": (
            sales_items(),
            "brand || ' / ' || channel || ' 매출 실질 하락'",
            f"'순매출이 $' || {comma('previous_net_revenue')} || ' → $' || {comma('current_net_revenue')} || '로 변화(' || {signed_text('pct_change')} || ').'",
            "brand || ' / ' || channel || '의 수요·가격·구색을 조사하세요.'",
            f"'Net revenue moved from $' || {comma('previous_net_revenue')} || ' to $' || {comma('current_net_revenue')} || ' (' || {signed_text('pct_change')} || ').'",
        ),
        "marketing": (
            marketing_items(),
            "brand || ' / ' || marketing_channel || ' 마케팅 효율 악화'",
            f"'ROAS가 ' || {two('previous_roas')} || ' → ' || {two('current_roas')} || '로 하락(' || {signed_text('roas_change_pct')} || '), 현재 지출은 $' || {comma('current_spend')} || '.'",
            "brand || ' / ' || marketing_channel || '의 타겟팅·크리에이티브·입찰 전략을 재검토하고, 성과가 좋은 세그먼트로 예산 재배분을 고려하세요.'",
            f"'ROAS fell from ' || {two('previous_roas')} || ' to ' || {two('current_roas')} || ' (' || {signed_text('roas_change_pct')} || '); current spend is $' || {comma('current_spend')} || '.'",
        ),
        "customer": (
            mix_items(),
            "'신규 고객 획득 비중 급감'",
            "'신규 고객 주문 비중이 ' || format('{:.0f}', previous_new_share * 100) || '% → ' || format('{:.0f}', current_new_share * 100) || '%로 이동.'",
            "'획득 마케팅 지출/효율을 재검토하고, 데이터·트래킹 이슈가 아닌지 확인하세요.'",
            "driver",
        ),
        "inventory": (
            stock_items(),
            "'SKU ' || sku_id || '(' || brand || CASE WHEN issue_type = 'stockout_risk' THEN ') 품절 위험' ELSE ') 과잉재고 위험' END",
            f"CASE WHEN issue_type = 'stockout_risk' THEN '일 수요 ~' || {one('velocity_per_day')} || '개 대비 보유 재고 ' || {whole('on_hand')} || '개, 재고 소진까지 ~' || {one('days_of_cover')} || '일.'"
            f" ELSE '보유 재고 ' || {whole('on_hand')} || '개 대비 일 수요는 ~' || {one('velocity_per_day')} || '개에 불과.' END",
            "CASE WHEN issue_type = 'stockout_risk' THEN sku_id || ' 긴급 재입고를 진행하고, 필요시 임시 배분 상한을 고려하세요.' ELSE sku_id || '의 과잉 재고를 줄이기 위해 프로모션이나 가격 인하를 고려하세요.' END",
            "driver",
        ),
    }
    rows = []
    for source, headline, driver, action, english_driver in texts.values():
        chosen = (headline, driver, action) if ko else ("headline", english_driver, "possible_action")
        rows.append(
            f"SELECT '{lang}' AS lang, as_of, issue_type, kpi_to_monitor, {chosen[0]} AS headline, "
            f"{chosen[1]} AS driver, {chosen[2]} AS possible_action FROM ({source})"
        )
    return " UNION ALL ".join(rows)


def summary_text(lang: str) -> str:
    parts = {
        "en": (
            "'Net revenue change vs. prior period: '",
            "high || ' high-severity issue(s), ' || medium || ' medium, ' || low || ' low.'",
            "' Top issues: '",
            "headline",
        ),
        "ko": (
            "'이전 기간 대비 순매출 변화: '",
            "'high ' || high || '건, medium ' || medium || '건, low ' || low || '건.'",
            "' 주요 이슈: '",
            "ko_headline",
        ),
    }[lang]
    return f"""SELECT as_of, {parts[0]} || {signed('pct_net_revenue')} || '. ' || {parts[1]}
    || coalesce({parts[2]} || (SELECT string_agg({parts[3]}, '; ' ORDER BY rank) FROM spoken k
       WHERE k.as_of = s.as_of AND rank <= 3) || '.', '') AS summary, '{lang}' AS lang
  FROM summary s JOIN counts USING (as_of)"""


COUNTS = """counts AS (
  SELECT as_of, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
    count(*) FILTER (severity = 'low') AS low FROM anchors LEFT JOIN items USING (as_of) GROUP BY as_of)"""

INVARIANTS = f"""WITH RECURSIVE {ORDER_LINES}, {CUSTOMERS}, {marketing()}, {stock(LAST_SHIP_DAY).removeprefix(LINES + ', ')}
SELECT 'orders' AS "table", 'no_nulls' AS rule, count(*) FILTER (order_id IS NULL OR line_no IS NULL OR order_date IS NULL
    OR brand IS NULL OR channel IS NULL OR sku_id IS NULL OR customer_id IS NULL OR quantity IS NULL OR net IS NULL) AS violations
  FROM order_lines
UNION ALL SELECT 'orders', 'quantity_positive', count(*) FILTER (NOT quantity > 0) FROM order_lines
UNION ALL SELECT 'orders', 'net_sales_not_negative', count(*) FILTER (NOT net >= 0) FROM order_lines
UNION ALL SELECT 'orders', 'unique_key', count(*) FROM (SELECT 1 FROM order_lines GROUP BY order_id, line_no HAVING count(*) > 1)
UNION ALL SELECT 'marketing', 'no_nulls', count(*) FILTER (date IS NULL OR brand IS NULL OR marketing_channel IS NULL OR spend IS NULL
    OR impressions IS NULL OR clicks IS NULL OR attributed_orders IS NULL OR attributed_revenue IS NULL) FROM marketing
UNION ALL SELECT 'marketing', 'spend_positive', count(*) FILTER (NOT spend > 0) FROM marketing
UNION ALL SELECT 'marketing', 'impressions_cover_clicks', count(*) FILTER (impressions < clicks) FROM marketing
UNION ALL SELECT 'inventory', 'no_nulls', count(*) FILTER (date IS NULL OR sku_id IS NULL OR brand IS NULL OR opening_stock IS NULL
    OR receipts IS NULL OR units_sold IS NULL OR closing_stock IS NULL) FROM inventory
UNION ALL SELECT 'inventory', 'stock_not_negative', count(*) FILTER (opening_stock < 0 OR closing_stock < 0) FROM inventory
UNION ALL SELECT 'inventory', 'stock_balances', count(*) FILTER (closing_stock <> opening_stock + receipts - units_sold) FROM inventory
UNION ALL SELECT 'inventory', 'unique_key', count(*) FROM (SELECT 1 FROM inventory GROUP BY sku_id, date HAVING count(*) > 1)
UNION ALL SELECT 'customers', 'no_nulls', count(*) FILTER (customer_id IS NULL OR acquisition_channel IS NULL OR first_order_date IS NULL
    OR total_orders IS NULL OR total_net_sales IS NULL OR is_returning IS NULL) FROM customers
UNION ALL SELECT 'customers', 'has_orders', count(*) FILTER (NOT total_orders > 0) FROM customers
UNION ALL SELECT 'customers', 'unique_key', count(*) FROM (SELECT 1 FROM customers GROUP BY customer_id HAVING count(*) > 1)
UNION ALL SELECT 'skus', 'no_nulls', count(*) FILTER (sku_id IS NULL OR brand IS NULL OR base_price IS NULL OR unit_cost IS NULL
    OR opening0 IS NULL) FROM skus
UNION ALL SELECT 'skus', 'price_above_cost', count(*) FILTER (NOT base_price > unit_cost) FROM skus
UNION ALL SELECT 'skus', 'unique_key', count(*) FROM (SELECT 1 FROM skus GROUP BY sku_id HAVING count(*) > 1)"""

EXPECTATIONS = f"""WITH RECURSIVE {together(TOGETHER, items=False)}
SELECT as_of, 'sales_decline' AS "check", brand || ' / ' || channel AS subject,
    brand = 'Brand#1' AND channel = '1-URGENT' AS designated, pct_change AS value
  FROM segments WHERE previous_net_revenue >= 500 AND CASE WHEN brand = 'Brand#1' AND channel = '1-URGENT'
    THEN pct_change IS NULL OR pct_change > -40 ELSE coalesce(pct_change <= -35, false) END
UNION ALL SELECT as_of, 'roas_decline', brand || ' / ' || marketing_channel,
    brand = 'B1' AND marketing_channel = 'paid_social', roas_change_pct
  FROM msegments WHERE previous_spend >= 1000 AND CASE WHEN brand = 'B1' AND marketing_channel = 'paid_social'
    THEN roas_change_pct IS NULL OR roas_change_pct > -45 ELSE coalesce(roas_change_pct <= -40, false) END
UNION ALL SELECT as_of, 'new_share_drop', 'all', true,
    {r('(current_new_share - previous_new_share) / nullif(previous_new_share, 0) * 100', 1)}
  FROM mix WHERE coalesce((current_new_share - previous_new_share) / nullif(previous_new_share, 0) * 100 > -55, true)
UNION ALL SELECT as_of, 'stockout', CAST(sku_id AS VARCHAR), sku_id = 3, days_of_cover
  FROM risk WHERE CASE WHEN sku_id = 3 THEN days_of_cover IS NULL OR days_of_cover >= 2.5
    ELSE coalesce(days_of_cover < 3, false) END"""


def differences() -> str:
    def cell(column: str, step: float) -> str:
        a, b = f"a.{column}", f"b.{column}"
        return f"""SELECT brand, channel, '{column}' AS "column" FROM a JOIN b USING (brand, channel)
  WHERE NOT CASE WHEN {a} IS NULL OR {b} IS NULL THEN {a} IS NULL AND {b} IS NULL
    ELSE abs({a} - {b}) <= greatest(1e-6 * greatest(abs({a}), abs({b})), {step * 1.01 + 1e-9!r}) END"""

    cells = " UNION ALL ".join(
        cell(c, s) for c, s in (("current_net_revenue", 0.0), ("previous_net_revenue", 0.0), ("change", 0.0), ("pct_change", 0.1))
    )
    return f"""WITH anchors AS ({TWO_DATES}), {ORDER_LINES}, {segments('brand', 'channel')},
a AS (SELECT * FROM segments WHERE as_of = {LAST_ORDER_DAY} - 28), b AS (SELECT * FROM segments WHERE as_of = {LAST_ORDER_DAY})
{cells}
UNION ALL SELECT brand, channel, '(row)' FROM a FULL OUTER JOIN b USING (brand, channel) WHERE a.as_of IS NULL OR b.as_of IS NULL"""


def parity_rows(name: str) -> str:
    return f"""SELECT '{name}' AS "table", count(*) AS rows, CAST(0 AS BIGINT) AS one_sided_rows,
  CAST(0 AS BIGINT) AS differing_cells FROM {name}"""


def section_parity() -> str:
    """Rows of either side and what was changed among the SKUs."""
    wrong = ("count(*) FILTER (sku_id % 50 = 7)", "count(*) FILTER (sku_id % 50 = 9 AND current_net_revenue IS NOT NULL)")
    parts = [
        f"SELECT '{frame}' AS frame, count(*) AS rows, {one} AS one_sided_rows, {cell} AS differing_cells FROM {source}"
        for frame, source, _ in FRAME_NUMBERS
        for one, cell in [wrong if frame == "sales.by_sku" else ("0", "0")]
    ]
    return f"WITH RECURSIVE {together(TOGETHER)}, {REPEAT_RATE} {' UNION ALL '.join(parts)}"


LOAD_REJECTS = """WITH delivered AS (
  SELECT CASE WHEN l_orderkey % 100 = 7 THEN -l_orderkey ELSE l_orderkey END AS order_id, l_linenumber AS line_no,
    CAST(l_shipdate AS DATE) AS ship_date, CASE WHEN l_orderkey % 100 = 8 THEN -l_partkey ELSE l_partkey END AS sku_id,
    CASE WHEN l_orderkey % 100 = 9 THEN -l_extendedprice ELSE l_extendedprice END AS extended_price,
    CASE WHEN l_orderkey % 100 <> 10 THEN CAST(l_quantity AS BIGINT) END AS quantity, l_discount, l_returnflag = 'R' AS returned
  FROM lineitem),
reasons AS (SELECT *, CASE WHEN ship_date IS NULL THEN 'no ship date' WHEN quantity IS NULL OR quantity < 0 THEN 'quantity'
    WHEN extended_price IS NULL OR extended_price < 0 THEN 'price' WHEN l_discount IS NULL OR l_discount NOT BETWEEN 0 AND 1 THEN 'discount'
    WHEN order_id IS NULL OR line_no IS NULL THEN 'no key'
    WHEN order_id NOT IN (SELECT o_orderkey FROM orders) THEN 'no order'
    WHEN sku_id NOT IN (SELECT p_partkey FROM part) THEN 'no sku' END AS why FROM delivered),
dealt AS (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN row_number() OVER (PARTITION BY why IS NULL, order_id, line_no
    ORDER BY ship_date, sku_id, extended_price, quantity, l_discount, returned) = 1 THEN 'kept' ELSE 'duplicate' END AS reason FROM reasons)
SELECT order_id, line_no, ship_date, sku_id, extended_price, quantity, reason, count(*) AS copies
FROM dealt WHERE reason <> 'kept' GROUP BY ALL
UNION ALL SELECT NULL, NULL, NULL, NULL, CAST(sum(CAST(extended_price AS DECIMAL(18,2))) AS DOUBLE), CAST(sum(quantity) AS BIGINT), 'kept', count(*)
FROM dealt WHERE reason = 'kept'"""


def trend_points() -> str:
    return """points AS (
  SELECT 'sales' AS lens, 'net_revenue[' || brand || ' / ' || channel || ']' AS kpi_to_monitor, as_of, current_net_revenue AS value FROM segments
  UNION ALL SELECT 'marketing', 'roas[' || brand || ' / ' || marketing_channel || ']', as_of, current_roas FROM msegments
  UNION ALL SELECT 'customer', 'new_customer_share', as_of, current_new_share FROM mix
  UNION ALL SELECT 'inventory', 'days_of_cover[' || sku_id || ']', as_of, days_of_cover FROM risk)"""


_change = "current_{0} previous_{0}".format
# Frame, source and key columns of each section: its numeric columns.
FRAME_NUMBERS = {
    ("sales.summary", "summary", ""): " ".join(
        f"{_change(k)} pct_{k}" for k in ("net_revenue", "orders", "units_sold", "aov")
    ),
    ("sales.by_brand_channel", "segments", "brand channel"): f"{_change('net_revenue')} change pct_change",
    ("sales.by_sku", "sku_segments", "sku_id brand"): f"{_change('net_revenue')} change pct_change",
    ("marketing.by_segment", "msegments", "brand marketing_channel"): " ".join(
        map(_change, ("spend", "attributed_revenue", "roas"))
    )
    + " roas_change_pct",
    ("marketing.cac_by_channel", "cac", "marketing_channel"): "spend new_customers cac",
    ("customer.mix", "mix", ""): f"{_change('new_share')} {_change('returning_share')}",
    ("customer.repeat_purchase_rate", "repeat_rate", ""): "repeat_purchase_rate",
    ("inventory.risk_by_sku", "risk", "sku_id brand"): "on_hand velocity days_of_cover stockout_risk excess_risk",
    ("decisions", "items", "lens issue_type kpi_to_monitor"): "impact",
}
FRAME_TEXTS = {("decisions", "items", "lens issue_type kpi_to_monitor"): "severity headline possible_action"}


def cells(left_out: tuple[str, ...] = (), where: str = "") -> str:
    """Every value, column by column."""
    parts = []
    for columns, number, text in (
        (FRAME_NUMBERS, "CAST({} AS DOUBLE)", "CAST(NULL AS VARCHAR)"),
        (FRAME_TEXTS, "CAST(NULL AS DOUBLE)", "{}"),
    ):
        for (frame, source, keys), names in columns.items():
            if frame in left_out:
                continue
            key = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys.split()) + ")" if keys else "''"
            chosen = where if source == "items" else ""
            parts += [
                f"SELECT as_of, '{frame}' AS frame, {key} AS key, '{n}' AS column, {number.format(n)} AS number, "
                f"{text.format(n)} AS text FROM {source} {chosen}"
                for n in names.split()
            ]
    return " UNION ALL ".join(parts)


REPEAT_RATE = f"""repeat_rate AS (
  SELECT as_of, {r('avg(CAST(is_returning AS INTEGER))', 3)} AS repeat_purchase_rate FROM anchors, customers GROUP BY as_of)"""


def contents() -> str:
    return f"WITH RECURSIVE {together(TOGETHER)}, {REPEAT_RATE} {cells()}"


def frame_values() -> str:
    """Per date, frame and column: how many values there are, and their sum or, of texts, length."""
    parts = []
    for columns, total in ((FRAME_NUMBERS, "CAST({} AS DECIMAL(28,4))"), (FRAME_TEXTS, "length({})")):
        for (frame, source, _), names in columns.items():
            if frame != "customer.repeat_purchase_rate":
                parts += [
                    f"SELECT as_of, '{frame}' AS frame, '{n}' AS column, count(*) AS rows, count({n}) AS filled, "
                    f"CAST(sum({total.format(r(f'CAST({n} AS DOUBLE)', 4) if 'DECIMAL' in total else n)}) AS DOUBLE) AS total "
                    f"FROM {source} GROUP BY as_of"
                    for n in names.split()
                ]
    return f"WITH RECURSIVE {together(TOGETHER_DAYS)} {' UNION ALL '.join(parts)}"


SHIPPED = "SELECT DISTINCT {0}order_id, ship_date FROM lines{1}"


def shipped(step: int, *keys: str) -> str:
    cols = "".join(f"{k}, " for k in keys)
    source = SHIPPED.format(cols and "trim(p_brand) AS brand, ", " JOIN part ON p_partkey = sku_id" if keys else "")
    counted = f"""count(DISTINCT order_id) FILTER ({cur('ship_date')}) AS current_orders,
  count(DISTINCT order_id) FILTER ({prev('ship_date')}) AS previous_orders"""
    return f"""WITH anchors AS ({anchors(LAST_SHIP_DAY, first=FIRST_SHIP_DAY, window=30, step=step)}), {LINES}, s AS ({source})
SELECT as_of, {cols}{counted} FROM anchors {"" if keys else "LEFT "}JOIN s ON {both('ship_date')} GROUP BY ALL"""


LIFETIMES = f"""WITH RECURSIVE {together(TOGETHER_DAYS)},
places AS (SELECT as_of, row_number() OVER (ORDER BY as_of) AS i FROM anchors),
raised AS (SELECT lens, issue_type, kpi_to_monitor, i, as_of,
    min(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS grade
  FROM items JOIN places USING (as_of) GROUP BY ALL),
begun AS (SELECT *, CASE WHEN lag(i) OVER issue = i - 1 THEN 0 ELSE 1 END AS starts FROM raised
  WINDOW issue AS (PARTITION BY lens, issue_type, kpi_to_monitor ORDER BY i)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY lens, issue_type, kpi_to_monitor ORDER BY i) AS occurrence FROM begun)
SELECT lens, issue_type, kpi_to_monitor, min(as_of) AS first_seen, max(as_of) AS last_seen, CAST(count(*) AS INTEGER) AS dates,
  CASE min(grade) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS gravest, CAST(occurrence AS INTEGER) AS occurrence,
  count(*) OVER (PARTITION BY lens, issue_type, kpi_to_monitor) AS occurrences, max(i) = (SELECT max(i) FROM places) AS open
FROM numbered GROUP BY lens, issue_type, kpi_to_monitor, occurrence"""


def placed(result: str, source: str, key: str, order: str) -> str:
    return f"""SELECT as_of, '{result}' AS result, {key} AS row,
  row_number() OVER (PARTITION BY as_of ORDER BY {order}) AS position FROM {source}"""


def report_orders() -> str:
    """Each result over its own dates."""
    parts = {
        "sales": (
            f"WITH anchors AS ({SALES_DAYS}), {ORDER_LINES}, {segments('brand', 'channel')}",
            placed("sales", "segments", "brand || ' / ' || channel", "abs(change) DESC, brand, channel"),
        ),
        "marketing": (
            f"WITH anchors AS ({MARKETING_DAYS}), {marketing()}, {MARKETING_SEGMENTS}",
            placed("marketing", "msegments", "brand || ' / ' || marketing_channel", "roas_change_pct ASC NULLS LAST, brand, marketing_channel"),
        ),
        "cac": (
            f"WITH anchors AS ({MARKETING_DAYS}), {marketing()}, {acquired()}, {CAC}",
            placed("cac", "cac", "marketing_channel", "marketing_channel"),
        ),
        "inventory": (with_risk(STOCK_DAYS), placed("inventory", "risk", "CAST(sku_id AS VARCHAR)", "days_of_cover ASC NULLS FIRST, sku_id")),
    }
    return " UNION ALL ".join(f"SELECT * FROM ({ctes} {body})" for ctes, body in parts.values())


def without_date(statement: str) -> str:
    head, tail = statement.rsplit("SELECT * FROM", 1)
    return f"{head}SELECT * EXCLUDE (as_of) FROM{tail}"


def number(value: str, digits: int) -> str:
    """A JSON number with fixed digits, or null."""
    return f"coalesce(CAST(CAST({value} AS DECIMAL(28,{digits})) AS VARCHAR), 'null')"


def json_object(fields: dict[str, str]) -> str:
    """SQL of a JSON object from the SQL of its (already encoded) values."""
    inside = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields.items())
    return f"'{{' || {inside} || '}}'"


def json_text(value: str) -> str:
    return f"'\"' || {value} || '\"'"


def json_list(value: str) -> str:
    return f"'[' || {json_text(value)} || ']'"


def json_items() -> str:
    """Items with their facts as JSON."""
    sources = {
        "sales": (sales_items(), ("current_net_revenue", "previous_net_revenue", "pct_change"), ("brand", "channel")),
        "marketing": (
            marketing_items(),
            ("current_roas", "previous_roas", "roas_change_pct", "current_spend"),
            ("brand", "marketing_channel"),
        ),
        "customer": (mix_items(), ("current_new_share", "previous_new_share", "pct_change"), ()),
        "inventory": (stock_items(), ("on_hand", "velocity_per_day", "days_of_cover"), ("brand", "sku_id")),
    }
    parts = []
    for source, kpis, where in sources.values():
        kpi = json_object({**{k: number(k, 3) for k in kpis}, "estimated_revenue_impact": number("impact", 3)})
        affected = json_object({k: json_text(k) for k in where}) if where else "'{}'"
        parts.append(
            f"SELECT as_of, lens, issue_type, severity, headline, driver, possible_action, kpi_to_monitor, "
            f"{kpi} AS kpi_json, {affected} AS affected_json FROM ({source})"
        )
    return " UNION ALL ".join(parts)


PERIOD_JSON = json_object(
    {
        "current_start": json_text("strftime(as_of - (w - 1), '%Y-%m-%d')"),
        "current_end": json_text("strftime(as_of, '%Y-%m-%d')"),
        "previous_start": json_text("strftime(as_of - (2 * w - 1), '%Y-%m-%d')"),
        "previous_end": json_text("strftime(as_of - w, '%Y-%m-%d')"),
    }
)


def sales_json() -> str:
    def side(prefix: str) -> str:
        return json_object(
            {
                "net_revenue": number(f"{prefix}_net_revenue", 2),
                "orders": f"CAST({prefix}_orders AS VARCHAR)",
                "units_sold": f"CAST({prefix}_units_sold AS VARCHAR)",
                "aov": number(f"{prefix}_aov", 2),
            }
        )

    change = json_object({k: number(f"pct_{k}", 1) for k in ("net_revenue", "orders", "units_sold", "aov")})
    return json_object({"current": side("current"), "previous": side("previous"), "pct_change": change})


def prompt_sql() -> str:
    from ..functions.prose import FACTS_MARK, PROMPT_HEADER

    issue = json_object(
        {
            "headline": json_text("e.headline"),
            "severity": json_text("j.severity"),
            "supporting_kpi": "kpi_json",
            "likely_drivers": json_list("e.driver"),
            "possible_action": json_text("e.possible_action"),
            "kpi_to_monitor": json_text("j.kpi_to_monitor"),
        }
    )
    header = (PROMPT_HEADER["en"] + FACTS_MARK).replace("'", "''")
    return f"""WITH RECURSIVE {together(TOGETHER_DAYS)},
j AS ({json_items()}), e AS ({localized('en')}),
chosen AS (
  SELECT r.as_of, string_agg({issue}, ',' ORDER BY rank) AS issues
  FROM ranked r JOIN j USING (as_of, issue_type, kpi_to_monitor) JOIN e USING (as_of, issue_type, kpi_to_monitor)
  WHERE rank <= 5 GROUP BY r.as_of)
SELECT as_of, '{header}' || '{{"as_of_date":"' || strftime(as_of, '%Y-%m-%d') || '","period":' || {PERIOD_JSON}
  || ',"sales_summary":' || {sales_json()} || ',"issues":[' || coalesce(issues, '') || ']}}' AS prompt
FROM anchors JOIN summary USING (as_of) LEFT JOIN chosen USING (as_of)"""


def fact_sql() -> str:
    decision = json_object(
        {
            "issue_type": json_text("issue_type"),
            "headline": json_text("headline"),
            "severity": json_text("severity"),
            "supporting_kpi": "kpi_json",
            "likely_drivers": json_list("driver"),
            "affected": "affected_json",
            "possible_action": json_text("possible_action"),
            "kpi_to_monitor": json_text("kpi_to_monitor"),
            "lens": json_text("lens"),
        }
    )
    return f"""WITH RECURSIVE {together(TOGETHER)}, j AS ({json_items()})
SELECT as_of, 'period' AS kind, {PERIOD_JSON} AS fact FROM anchors
UNION ALL SELECT as_of, 'sales_summary', {sales_json()} FROM summary
UNION ALL SELECT as_of, 'decision', {decision} FROM j"""


def statements() -> dict[str, str]:
    short = "as_of, lens, issue_type, severity, kpi_to_monitor"
    sweep = " UNION ALL ".join(
        (
            sweep_items("default"),
            sweep_items(
                "strict",
                sales=("-5", "-20"),
                marketing=("-1", "-40", "0"),
                customer=("-5",),
                inventory=("3", "14", "30"),
            ),
            sweep_items(
                "relaxed",
                sales=("-60", "-80"),
                marketing=("-90", "-90"),
                customer=("-90", "-90"),
                inventory=("1", "3", "180"),
            ),
        )
    )
    made = {
        "stg_trim": "SELECT p_partkey AS sku_id, trim(p_brand) AS brand FROM part",
        "stg_orders_dedupe": f"""WITH {ORDER_LINES}
SELECT sku_id, order_id, line_no, ship_date, extended_price, quantity, discount, returned, order_date, customer_id,
  channel, brand FROM order_lines""",
        "stg_customers_dedupe": """SELECT customer_id, acquisition_channel, first_order_date FROM (
  SELECT o_custkey AS customer_id, trim(c_mktsegment) AS acquisition_channel, CAST(o_orderdate AS DATE) AS first_order_date,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rn
  FROM orders JOIN customer ON c_custkey = o_custkey) WHERE rn = 1""",
        "acquired_customers": f"WITH {acquired()} SELECT * FROM acquired",
        "stg_skus_dedupe": f"WITH {SKUS} SELECT * FROM skus WHERE sku_id IN (SELECT l_partkey FROM lineitem)",
        "stg_marketing_roas": f"""WITH {marketing()}
SELECT *, CASE WHEN spend <> 0 THEN attributed_revenue / spend END AS roas FROM marketing""",
        "stg_inventory": f"""WITH RECURSIVE {stock(LAST_SHIP_DAY)}
SELECT brand, date, {STOCK_SUMS} FROM inventory GROUP BY brand, date""",
        "latest_date": f"WITH {BOUNDS} SELECT * FROM bounds",
        "history_anchors": f"WITH {bound_anchors(1)} SELECT as_of FROM anchors",
        "period_windows": f"""WITH {bound_anchors(7)}
SELECT as_of, CAST(as_of - 29 AS DATE) AS current_start, as_of AS current_end,
  CAST(as_of - 59 AS DATE) AS previous_start, CAST(as_of - 30 AS DATE) AS previous_end FROM anchors""",
        "period_tagged_orders": f"""WITH {HEADS}
SELECT order_id, order_date, customer_id, channel, net_sales,
  CASE WHEN order_date > {LAST_ORDER_DAY} - 30 THEN 'current' ELSE 'previous' END AS period
FROM heads WHERE order_date BETWEEN {LAST_ORDER_DAY} - 59 AND {LAST_ORDER_DAY}""",
        "asof_anchor": f"""WITH {bound_anchors(7)}, picks AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS picked FROM lineitem)
SELECT picked, coalesce((SELECT max(as_of) FROM anchors WHERE as_of <= picked), (SELECT min(as_of) FROM anchors)) AS as_of
FROM picks""",
        "sales_summary": f"WITH anchors AS ({SALES_AS_OF}), {ORDER_LINES}, {SUMMARY} SELECT * FROM summary",
        "sales_summary_history": f"WITH anchors AS ({SALES_DAYS}), {ORDER_LINES}, {SUMMARY} SELECT * FROM summary",
        "sales_by_brand_channel": sales_history(SALES_AS_OF, "brand", "channel"),
        "sales_by_brand_channel_history": sales_history(SALES_DAYS, "brand", "channel"),
        "sales_by_sku": sales_history(SALES_AS_OF, "sku_id", "brand"),
        "sales_by_sku_history": sales_history(SALES_DAYS, "sku_id", "brand"),
        "sales_by_channel": sales_history(SALES_DAYS, "channel"),
        "marketing_by_segment": f"WITH anchors AS ({MARKETING_AS_OF}), {marketing()}, {MARKETING_SEGMENTS} SELECT * FROM msegments",
        "marketing_by_segment_history": f"WITH anchors AS ({MARKETING_DAYS}), {marketing()}, {MARKETING_SEGMENTS} SELECT * FROM msegments",
        "cac_by_channel": f"WITH anchors AS ({CAC_AS_OF}), {marketing()}, {acquired()}, {CAC} SELECT * FROM cac",
        "cac_by_channel_empty_side": f"WITH anchors AS ({MARKETING_AS_OF}), {marketing()}, {acquired()}, {CAC} SELECT * FROM cac",
        "cac_by_channel_history": f"WITH anchors AS ({MARKETING_DAYS}), {marketing()}, {acquired()}, {CAC} SELECT * FROM cac",
        "customer_mix": with_mix("SELECT DATE '1996-06-30' AS as_of, 30 AS w"),
        "customer_mix_history": with_mix(SALES_DAYS),
        "repeat_purchase_rate": f"WITH {CUSTOMERS} SELECT {r('avg(CAST(is_returning AS INTEGER))', 3)} AS repeat_purchase_rate FROM customers",
        "customer_summary": f"WITH {CUSTOMERS} SELECT * FROM customers",
        "new_customer_flag": f"WITH {HEADS} SELECT order_id, order_date, customer_id, is_new_customer FROM heads",
        "units_by_sku_day": f"WITH {LINES}, {UNITS} SELECT * FROM units",
        "baseline_daily_demand": f"WITH {demand(LAST_SHIP_DAY)} SELECT sku_id, daily_demand FROM rate",
        "dense_sku_day": f"""WITH RECURSIVE {stock(LAST_SHIP_DAY)}
SELECT brand, date, count(*) AS skus, CAST(sum(demand) AS BIGINT) AS demand, CAST(sum(receipts) AS BIGINT) AS receipts,
  CAST(sum(units_sold) AS BIGINT) AS units_sold, CAST(sum(closing_stock) AS BIGINT) AS closing_stock
FROM ledger GROUP BY brand, date""",
        "replenishment_signal": f"""WITH {demand(LAST_SHIP_DAY)}
SELECT sku_id, date, day_index, trailing_demand, receipts FROM plan""",
        "stock_ledger": f"""WITH RECURSIVE {stock(LAST_SHIP_DAY)}
SELECT i.*, CAST(demand AS BIGINT) AS demand FROM inventory i JOIN ledger l USING (sku_id, date)
WHERE l.receipts > 0 OR demand > 0 OR day_index = 0""",
        "sku_velocity_rolling": f"{with_risk(STOCK_DAYS)} SELECT * FROM velocity",
        "inventory_risk": f"{with_risk(STOCK_AS_OF)} SELECT * FROM risk",
        "inventory_risk_history": f"{with_risk(STOCK_DAYS)} SELECT * FROM risk",
        "inventory_reflag": f"{with_risk(STOCK_AS_OF, stockout=21, excess=30)} SELECT * FROM risk",
        "inventory_flag_counts": f"{with_risk(STOCK_DAYS)} SELECT as_of, count(*) FILTER (stockout_risk OR excess_risk) AS flagged, count(*) AS total FROM risk GROUP BY as_of",
        "net_sales_pricing": f"""WITH {LINES}, {SKUS}, priced AS (
  SELECT sku_id, order_id, line_no, quantity, discount, base_price,
    {discounted('base_price')} AS price, unit_cost
  FROM lines JOIN skus USING (sku_id))
SELECT * EXCLUDE (price), CAST(price AS DOUBLE) AS selling_price, CAST(price * quantity AS DOUBLE) AS net_sales FROM priced""",
        "detect_sales_decline": f"""WITH anchors AS ({SALES_DAYS}), {ORDER_LINES}, {segments('brand', 'channel')}
SELECT {flat('brand', 'channel', 'current_net_revenue', 'previous_net_revenue', 'pct_change')} FROM ({sales_items()})""",
        "detect_marketing_decline": f"""WITH anchors AS ({MARKETING_DAYS}), {marketing()}, {MARKETING_SEGMENTS}
SELECT {flat('brand', 'marketing_channel', 'current_roas', 'previous_roas', 'roas_change_pct', 'current_spend')}
FROM ({marketing_items(least='100')})""",
        "detect_inventory_issues": f"""{with_risk(STOCK_AS_OF)}
SELECT {flat('brand', 'sku_id', 'on_hand', 'velocity_per_day', 'days_of_cover')} FROM ({stock_items()})""",
        "detect_customer_mix": f"""WITH anchors AS ({SALES_DAYS}), {HEADS}, {MIX}
SELECT {flat('current_new_share', 'previous_new_share', 'pct_change')} FROM ({mix_items()})""",
        "all_decisions": f"WITH RECURSIVE {together(TOGETHER)} SELECT {short}, headline, driver, impact FROM items",
        "threshold_sweep": f"WITH RECURSIVE {together(TOGETHER, items=False)} {sweep}",
        "stored_history_sweep": f"""WITH RECURSIVE {together(TOGETHER, items=False)}
SELECT * FROM ({sweep}) WHERE scenario IN ('strict', 'default')""",
        "issue_resolution": f"""WITH RECURSIVE {together(TWO_DATES)},
a AS (SELECT * FROM items WHERE as_of = {LAST_ORDER_DAY} - 28), b AS (SELECT * FROM items WHERE as_of = {LAST_ORDER_DAY})
SELECT lens, issue_type, kpi_to_monitor, a.severity AS severity_before, b.severity AS severity_after,
  CASE WHEN b.severity IS NULL THEN 'resolved' WHEN a.severity IS NULL THEN 'new' ELSE 'persisting' END AS status
FROM a FULL OUTER JOIN b USING (lens, issue_type, kpi_to_monitor)""",
        "severity_counts": f"WITH RECURSIVE {together(TOGETHER_DAYS)}, {COUNTS} SELECT * FROM counts",
        "top_issues": f"""WITH RECURSIVE {together(TOGETHER_DAYS)}
SELECT as_of, CAST(rank AS INTEGER) AS rank, lens, issue_type, severity, kpi_to_monitor, impact FROM ranked WHERE rank <= 5""",
        "filter_decisions": f"""WITH RECURSIVE {together(TOGETHER_DAYS)}
SELECT {short} FROM items WHERE lens IN ('sales', 'inventory') AND severity = 'high'""",
        "filter_counts": f"""WITH RECURSIVE {together(TOGETHER_DAYS)}
SELECT as_of, count(*) FILTER (lens IN ('sales', 'inventory') AND severity = 'high') AS shown, count(*) AS total
FROM items GROUP BY as_of""",
        "kpi_trend": f"""WITH RECURSIVE {together(TOGETHER_DAYS)}, {trend_points()}
SELECT lens, issue_type, kpi_to_monitor, p.as_of, p.value
FROM (SELECT DISTINCT lens, issue_type, kpi_to_monitor FROM items WHERE as_of = {LAST_ORDER_DAY}) JOIN points p USING (lens, kpi_to_monitor)
WHERE p.value IS NOT NULL""",
        "localized_decisions": f"WITH RECURSIVE {together(TOGETHER, items=False)} {localized('ko')} UNION ALL {localized('en')}",
        "executive_summary": f"""WITH RECURSIVE {together(TOGETHER_DAYS)}, {COUNTS},
korean AS ({localized('ko')}),
spoken AS (SELECT r.as_of, r.rank, r.headline, k.headline AS ko_headline FROM ranked r JOIN korean k
  ON k.as_of = r.as_of AND k.issue_type = r.issue_type AND k.kpi_to_monitor = r.kpi_to_monitor)
{summary_text('ko')} UNION ALL {summary_text('en')}""",
        "kpi_tiles": f"""WITH anchors AS ({SALES_DAYS}), {ORDER_LINES}, {SUMMARY}, {HEADS}, {MIX}
{tile('net_revenue', 'Net revenue', money('current_net_revenue'), signed('pct_net_revenue'), 'summary')}
UNION ALL {tile('orders', 'Orders', 'CAST(current_orders AS VARCHAR)', signed('pct_orders'), 'summary')}
UNION ALL {tile('aov', 'AOV', money('current_aov'), signed('pct_aov'), 'summary')}
UNION ALL {tile('new_share', 'New-customer share', "coalesce(format('{:.0f}%', current_new_share * 100), 'n/a')", "format('{:+.1f}pt', (current_new_share - previous_new_share) * 100)", 'mix')}""",
        "snapshot": f"""WITH RECURSIVE {together(TOGETHER)}, {COUNTS}
SELECT s.*, m.* EXCLUDE (as_of), c.* EXCLUDE (as_of), 2 AS schema_version, CAST(s.as_of - 13 AS DATE) AS current_start,
  s.as_of AS current_end, CAST(s.as_of - 27 AS DATE) AS previous_start, CAST(s.as_of - 14 AS DATE) AS previous_end,
  'sales,marketing,customer,inventory' AS lenses, 'spark' AS metrics_source, CAST(-35 AS DOUBLE) AS sales_decline_high_pct,
  CAST(14 AS DOUBLE) AS velocity_window_days, CAST(NULL AS VARCHAR) AS narrative
FROM summary s JOIN mix m ON m.as_of = s.as_of JOIN counts c ON c.as_of = s.as_of""",
        "snapshot_contents": contents(),
        "snapshot_history": frame_values(),
        "ranked_issues": f"""WITH RECURSIVE {together(TOGETHER_DAYS)}
SELECT as_of, rank, lens, issue_type, severity, kpi_to_monitor FROM ranked""",
        "issue_lifetimes": LIFETIMES,
        "report_orders": report_orders(),
        "shipped_orders_history": shipped(1),
        "shipped_orders_by_sku_brand": shipped(7, "brand"),
        "content_reconciliation": f"""WITH {LINES}
SELECT order_id, line_no, 'lost' AS status, 1 AS delivered_rows, 0 AS loaded_rows FROM lines WHERE order_id % 1000 = 7
UNION ALL SELECT order_id, line_no, 'repeated', 1, 2 FROM lines WHERE order_id % 1000 = 8
UNION ALL SELECT order_id, line_no, 'altered', 1, 1 FROM lines WHERE order_id % 1000 = 9
UNION ALL SELECT order_id, line_no + 100, 'added', 0, 1 FROM lines WHERE order_id % 1000 = 10""",
        "load_rejects": LOAD_REJECTS,
        "checked_replace": f"WITH {CUSTOMERS} SELECT *, true AS refused FROM customers",
        "history_increment": f"""WITH RECURSIVE {together(TOGETHER_DAYS)}
{cells(("sales.by_sku", "customer.repeat_purchase_rate", "inventory.risk_by_sku"), "WHERE lens <> 'inventory'")}""",
        "snapshot_roundtrip": f"WITH RECURSIVE {together(TOGETHER_DAYS)} SELECT {short}, impact FROM items",
        "csv_roundtrip": f"WITH {CUSTOMERS} SELECT * FROM customers",
        "row_count_reconciliation": f"""WITH RECURSIVE {CUSTOMERS}, {marketing()}, {stock(LAST_SHIP_DAY)},
counted AS (SELECT 'orders' AS "table", count(*) AS expected FROM orders UNION ALL SELECT 'marketing', count(*) FROM marketing
  UNION ALL SELECT 'inventory', count(*) FROM inventory UNION ALL SELECT 'customers', count(*) FROM customers
  UNION ALL SELECT 'skus', count(*) FROM part)
SELECT "table", expected, expected AS actual, true AS matches FROM counted""",
        "kpi_parity": f"""WITH anchors AS ({SALES_AS_OF}), {ORDER_LINES}, {segments('brand', 'channel', name='sales_by_brand_channel')},
{segments('sku_id', 'brand', name='sales_by_sku')}
{parity_rows('sales_by_brand_channel')} UNION ALL {parity_rows('sales_by_sku')}""",
        "decision_parity": f"""WITH RECURSIVE {together(TOGETHER)}
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS one_sided_rows, CAST(0 AS BIGINT) AS differing_cells FROM items""",
        "section_parity": section_parity(),
        "kpi_differences": differences(),
        "fact_document": fact_sql(),
        "copy_prompt": prompt_sql(),
        "kpi_expectations": EXPECTATIONS,
        "table_invariants": INVARIANTS,
        "lens_returns": f"""WITH anchors AS ({STOCK_AS_OF}), {LINES},
sums AS (SELECT as_of, trim(p_brand) AS brand,
    CAST(sum(CASE WHEN {cur('ship_date')} THEN quantity ELSE 0 END) AS DOUBLE) AS c,
    CAST(sum(CASE WHEN {cur('ship_date')} AND returned THEN quantity ELSE 0 END) AS DOUBLE) AS cb,
    CAST(sum(CASE WHEN {prev('ship_date')} THEN quantity ELSE 0 END) AS DOUBLE) AS p,
    CAST(sum(CASE WHEN {prev('ship_date')} AND returned THEN quantity ELSE 0 END) AS DOUBLE) AS pb
  FROM lines JOIN part ON p_partkey = sku_id JOIN anchors ON {both('ship_date')} GROUP BY ALL),
shares AS (SELECT as_of, brand, c, {r('cb / nullif(c, 0) * 100', 1)} AS now, {r('pb / nullif(p, 0) * 100', 1)} AS before FROM sums)
SELECT as_of, 'returns' AS lens, 'goods_coming_back' AS issue_type,
  CASE WHEN now - before >= 4 THEN 'high' ELSE 'medium' END AS severity, 'More of ' || brand || ' is sent back' AS headline,
  'Of the pieces shipped, ' || format('{{:.1f}}', now) || '% came back, against ' || format('{{:.1f}}', before) || '% before.' AS driver,
  'Go through the complaints about ' || brand || ' and hold its next shipment if they agree.' AS possible_action,
  'back_pct[' || brand || ']' AS kpi_to_monitor, brand, now AS current_back_pct, before AS previous_back_pct,
  CAST(NULL AS DOUBLE) AS impact
FROM shares WHERE c >= 100 AND now - before >= 2""",
    }
    dated = (
        "sales_summary",
        "sales_by_brand_channel",
        "sales_by_sku",
        "marketing_by_segment",
        "cac_by_channel",
        "customer_mix",
        "inventory_risk",
    )
    made |= {f"sql_{name}": without_date(made[name]) for name in dated}
    made["sql_repeat_purchase_rate"] = made["repeat_purchase_rate"]
    return made
