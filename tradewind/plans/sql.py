"""The KPIs as SQL: staged tables as views, one table function per KPI.

    register(spark, tables)
    spark.sql("SELECT * FROM sales_summary(DATE '2026-09-21', 30)")

A table function takes one as-of date and answers like the DataFrame operator
of the same name (without ``as_of``). For many dates use the operators, which
read the tables once for all of them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.numeric import amount
from .lens import Tables

VIEWS = ("orders", "order_heads", "marketing", "acquired", "customers", "inventory", "skus")

# Whole windows between the row and the as-of date: 0 is the current period,
# 1 the previous one. The day filter holds the arguments only, so it reaches
# the scan.
_PERIOD = "datediff(as_of, {day}) div window_days AS period"
_INSIDE = "{day} BETWEEN date_sub(as_of, {span} * window_days - 1) AND as_of"
_CHANGE = "round(try_divide(double({c} - {p}), double({p})) * 100, 1)"


def _tagged(view: str, day: str, columns: str, span: int = 2) -> str:
    return (
        f"SELECT {columns}, {_PERIOD.format(day=day)} FROM staged_{view} WHERE {_INSIDE.format(day=day, span=span)}"
    )


def _side(period: int, value: str) -> str:
    return f"coalesce(sum({value}) FILTER (WHERE period = {period}), 0)"


def _change(current: str, previous: str) -> str:
    return _CHANGE.format(c=current, p=previous)


def _segments(columns: str) -> str:
    return f"""SELECT {columns}, double(c) AS current_net_revenue, double(p) AS previous_net_revenue,
    double(c - p) AS change, {_change('c', 'p')} AS pct_change
  FROM (SELECT {columns}, {_side(0, 'net')} AS c, {_side(1, 'net')} AS p
        FROM ({_tagged('orders', 'order_date', f'{columns}, {amount("net_sales")} AS net')}) GROUP BY {columns})"""


_SUMMARY = f"""SELECT c_net AS current_net_revenue, c_orders AS current_orders, c_units AS current_units_sold,
    c_aov AS current_aov, p_net AS previous_net_revenue, p_orders AS previous_orders,
    p_units AS previous_units_sold, p_aov AS previous_aov,
    {_change('c_net', 'p_net')} AS pct_net_revenue, {_change('c_orders', 'p_orders')} AS pct_orders,
    {_change('c_units', 'p_units')} AS pct_units_sold, {_change('c_aov', 'p_aov')} AS pct_aov
  FROM (SELECT *, coalesce(round(try_divide(c_net, c_orders), 2), 0D) AS c_aov,
          coalesce(round(try_divide(p_net, p_orders), 2), 0D) AS p_aov
        FROM (SELECT double(round({_side(0, 'net')}, 2)) AS c_net, double(round({_side(1, 'net')}, 2)) AS p_net,
                count(DISTINCT order_id) FILTER (WHERE period = 0) AS c_orders,
                count(DISTINCT order_id) FILTER (WHERE period = 1) AS p_orders,
                {_side(0, 'quantity')} AS c_units, {_side(1, 'quantity')} AS p_units
              FROM ({_tagged('orders', 'order_date', f'order_id, quantity, {amount("net_sales")} AS net')})))"""

_MARKETING = f"""SELECT brand, marketing_channel, cs AS current_spend, cr AS current_attributed_revenue,
    c AS current_roas, ps AS previous_spend, pr AS previous_attributed_revenue, p AS previous_roas,
    {_change('c', 'p')} AS roas_change_pct
  FROM (SELECT *, coalesce(try_divide(cr, cs), 0D) AS c, coalesce(try_divide(pr, ps), 0D) AS p
        FROM (SELECT brand, marketing_channel, double({_side(0, 'spent')}) AS cs, double({_side(0, 'earned')}) AS cr,
                double({_side(1, 'spent')}) AS ps, double({_side(1, 'earned')}) AS pr
              FROM ({_tagged('marketing', 'date', f'''brand, marketing_channel, {amount("spend")} AS spent,
                {amount("attributed_revenue")} AS earned''')})
              GROUP BY brand, marketing_channel))"""

_CAC = f"""SELECT marketing_channel, coalesce(spend, 0D) AS spend, coalesce(new_customers, 0L) AS new_customers,
    round(try_divide(coalesce(spend, 0D), coalesce(new_customers, 0L)), 2) AS cac
  FROM (SELECT marketing_channel, double(sum(spent)) AS spend
        FROM ({_tagged('marketing', 'date', f'marketing_channel, {amount("spend")} AS spent', 1)})
        GROUP BY marketing_channel)
  FULL JOIN (SELECT acquisition_channel AS marketing_channel, count(1) AS new_customers
        FROM ({_tagged('acquired', 'first_order_date', 'acquisition_channel', 1)})
        GROUP BY acquisition_channel) USING (marketing_channel)"""

_MIX = f"""SELECT c AS current_new_share, p AS previous_new_share, round(1 - c, 3) AS current_returning_share,
    round(1 - p, 3) AS previous_returning_share
  FROM (SELECT round(avg(int(is_new_customer)) FILTER (WHERE period = 0), 3) AS c,
          round(avg(int(is_new_customer)) FILTER (WHERE period = 1), 3) AS p
        FROM ({_tagged('order_heads', 'order_date', 'is_new_customer')}))"""

_RISK = """SELECT sku_id, brand, on_hand, velocity, days_of_cover,
    coalesce(days_of_cover < stockout_days, false) AS stockout_risk,
    on_hand > 0 AND (velocity = 0 OR coalesce(days_of_cover > excess_days, false)) AS excess_risk
  FROM (SELECT *, if(velocity > 0, round(on_hand / velocity, 1), null) AS days_of_cover
        FROM (SELECT sku_id, brand, closing_stock AS on_hand, coalesce(mean, 0D) AS velocity
              FROM (SELECT sku_id, brand, closing_stock FROM staged_inventory WHERE date = as_of)
              LEFT JOIN (SELECT sku_id, round(avg(units_sold), 2) AS mean FROM staged_inventory
                         WHERE date BETWEEN date_sub(as_of, velocity_window_days - 1) AND as_of
                         GROUP BY sku_id) USING (sku_id)))"""

PERIOD_ARGUMENTS = "as_of DATE, window_days INT"
FUNCTIONS = {
    "sales_summary": (PERIOD_ARGUMENTS, _SUMMARY),
    "sales_by_brand_channel": (PERIOD_ARGUMENTS, _segments("brand, channel")),
    "sales_by_sku": (PERIOD_ARGUMENTS, _segments("sku_id, brand")),
    "marketing_by_segment": (PERIOD_ARGUMENTS, _MARKETING),
    "cac_by_channel": (PERIOD_ARGUMENTS, _CAC),
    "customer_mix": (PERIOD_ARGUMENTS, _MIX),
    "inventory_risk": ("as_of DATE, velocity_window_days INT, stockout_days DOUBLE, excess_days DOUBLE", _RISK),
}
REPEAT_RATE = "SELECT round(avg(int(is_returning)), 3) AS repeat_purchase_rate FROM staged_customers"


def register(spark: SparkSession, tables: Tables) -> None:
    """Views ``staged_<table>`` over staged tables and the functions whose
    tables are all there. Order headers and acquired customers fall back to
    orders (where they carry the new-customer flag) and customers."""
    known = dict(tables)
    if "orders" in known and "is_new_customer" in known["orders"].columns:
        known.setdefault("order_heads", known["orders"])
    if "customers" in known:
        known.setdefault("acquired", known["customers"])
    present = [v for v in VIEWS if v in known]
    for view in present:
        known[view].createOrReplaceTempView(f"staged_{view}")
    for name, (arguments, body) in FUNCTIONS.items():
        needed = {v for v in VIEWS if f"staged_{v} " in body + " "}
        if needed <= set(present):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE RETURN {body}")
    if "customers" in present:
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW repeat_purchase_rate AS {REPEAT_RATE}")
