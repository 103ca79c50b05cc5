import random

from pyspark.sql import functions as F

from tradewind.functions import numeric, prose, text


def test_number_texts_match_exact_binary_rounding(spark):
    pick = random.Random(7)
    values = [0.15, 0.25, 0.35, 2.45, 1234.5, 1235.5, 0.05, 2.5, 3.5, 0.0, -0.04, -2.45, 1e-9, 99999.95, 1e12 + 0.5]
    values += [round(pick.uniform(-3000, 3000), 2) for _ in range(2000)]
    values += [pick.randint(-(10**6), 10**6) / 8 for _ in range(1000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v",
        *(
            F.expr(e)
            for e in (
                text.fixed("v", 1),
                text.fixed("v"),
                text.signed_pct("v"),
                text.number("v"),
                text.number("v", 2),
                text.currency("v"),
                text.share("v"),
                numeric.round_half_even("v", 2),
                numeric.round_half_even("v", 1),
            )
        ),
    )
    for v, *got in frame.collect():
        sign = "-" if v < 0 else ""
        assert got == [
            f"{v:.1f}",
            f"{v:.0f}",
            f"{v:+.1f}%",
            f"{v:,.0f}",
            f"{v:,.2f}",
            f"{sign}${abs(v):,.0f}",
            f"{v:.0%}",
            round(v, 2),
            round(v, 1),
        ]


def test_missing_numbers(spark):
    row = spark.sql("select cast(null as double) v").select(
        F.expr(text.signed_pct("v")), F.expr(text.currency("v")), F.expr(text.number("v")), F.expr(text.fixed("v"))
    )
    assert tuple(row.first()) == ("n/a", "n/a", "n/a", None)


def test_known_formats(spark):
    frame = spark.sql("select 1.25D a, 1234.5D b, -2631.0D c")
    shown = frame.select(F.expr(text.signed_pct("a")), F.expr(text.currency("b")), F.expr(text.currency("c"))).first()
    assert tuple(shown) == ("+1.2%", "$1,234", "-$2,631")


def test_render_quotes_text_and_fills_facts(spark):
    sql = prose.render("it's {name}\\n: {count}%\n", {"name": "name", "count": "count"})
    assert spark.sql("select 'x' name, 3 count").select(F.expr(sql)).first()[0] == "it's x\\n: 3%\n"


def test_money_sums_are_exact_in_any_order(spark):
    frame = spark.range(100_000).withColumn("amount", F.lit(0.1)).repartition(7)
    total = frame.select(F.expr(f"sum({numeric.amount('amount')})").alias("c")).select(numeric.dollars(F.col("c")))
    assert total.first()[0] == 10_000.0


def test_fractions_of_a_cent_count(spark):
    frame = spark.createDataFrame([(0.004,)] * 1000, "amount double")
    total = frame.select(F.expr(f"sum({numeric.amount('amount')})").alias("c")).select(numeric.dollars(F.col("c"), 2))
    assert total.first()[0] == 4.0


def test_discounts_are_exact(spark):
    frame = spark.createDataFrame([(100.0, 0.125), (19.99, 0.333333), (0.01, 0.5)], "price double, discount double")
    got = [float(r[0]) for r in frame.select(numeric.discounted(F.col("price"), F.col("discount"))).collect()]
    assert got == [87.5, 13.33, 0.01]


def test_percent_change_needs_a_previous_value(spark):
    frame = spark.createDataFrame([(1, 0), (80, 100), (0, 4)], "c bigint, p bigint")
    assert [r[0] for r in frame.select(numeric.pct_change(F.col("c"), F.col("p"))).collect()] == [None, -20.0, -100.0]
