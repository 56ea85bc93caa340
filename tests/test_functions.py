"""Scalar rules on tiny frames with explicit schemas."""

import pytest
from pyspark.sql import functions as F

from pricelens import functions as X

SIZE_CASES = [
    ("Amul Milk 500 ml", "500", "ml", "500ml"),
    ("Sugar 1 kg", "1", "kg", "1kg"),
    ("Eggs 12 pcs", "12", "pcs", "12 pcs"),
    ("Plain Yogurt", "1", "pcs", ""),
    ("Ghee 200gms", "200", "g", "200g"),
    ("Oil 1.5L", "1.5", "l", "1.5l"),
    ("Atta 2 x 500g", "500", "g", "500g"),
    ("Soap 3x75 g", "1", "pcs", ""),
    ("Eggs pack of 12", "1", "pcs", ""),
    ("Rice 1,000 g", "000", "g", "000g"),
    ("Milk half kg", "1", "pcs", ""),
    ("1 dozen eggs", "1", "pcs", ""),
    ("pack of 6 eggs", "6", "pcs", "6 pcs"),
]

EXTENDED_CASES = [
    ("Atta 2 x 500g", "1000", "g", "1000g"),
    ("Soap 3x75 g", "225", "g", "225g"),
    ("Milk half kg", "500", "g", "500g"),
    ("Juice 1/2 liter", "500", "ml", "500ml"),
    ("Eggs 1 dozen", "12", "pcs", "12 pcs"),
    ("Eggs half dozen", "6", "pcs", "6 pcs"),
    ("Sugar 1 kg", "1000", "g", "1000g"),
    ("Oil 1 L", "1000", "ml", "1000ml"),
    ("Eggs pack of 12", "12", "pcs", "12 pcs"),
    ("Plain Yogurt", "1", "pcs", ""),
]


def _one(spark, value, expr, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("name,q,u,label", SIZE_CASES)
def test_extract_size_basic(spark, name, q, u, label):
    r = _one(spark, name, X.extract_size(F.col("s")))
    assert (r.quantity, r.unit, r.size_label) == (q, u, label)


@pytest.mark.parametrize("name,q,u,label", EXTENDED_CASES)
def test_extract_size_extended(spark, name, q, u, label):
    r = _one(spark, name, X.extract_size_extended(F.col("s")))
    assert (r.quantity, r.unit, r.size_label) == (q, u, label)


def test_table_form_equals_column_form(spark):
    from pricelens.functions.sizes import with_size
    df = spark.createDataFrame([(n,) for n, *_ in SIZE_CASES + EXTENDED_CASES], "s string")
    for mode, fn in (("basic", X.extract_size), ("extended", X.extract_size_extended)):
        a = with_size(df, "s", mode, "z").select("s", "z").collect()
        b = df.select("s", fn(F.col("s")).alias("z")).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("text,expected", [
    ("₹65", 65.0), ("Rs. 149", 149.0), ("MRP ₹199", 199.0), ("1,299.00", 1299.0),
    ("", None), ("0", None), ("1.2.3", 1.2), (None, None), ("Rs.65", 65.0), ("₹65 ₹80", 65.0),
])
def test_clean_price_first_amount(spark, text, expected):
    assert _one(spark, text, X.clean_price(F.col("s"))) == expected


def test_clean_price_strip_rule_keeps_code_quirk(spark):
    assert _one(spark, "Rs.65", X.clean_price(F.col("s"), "strip")) == 0.65
    assert _one(spark, "₹65 ₹80", X.clean_price(F.col("s"), "strip")) == 6580.0


@pytest.mark.parametrize("price,q,u,expected", [
    (65.0, "500", "ml", 13.0), (45.0, "1", "kg", 4.5), (60.0, "12", "pcs", 5.0),
    (99.0, "000", "g", 99.0), (80.0, "x", "g", 80.0), (50.0, "2", "box", 50.0),
    (100.0, "1.5", "l", 6.67),
])
def test_unit_price(spark, price, q, u, expected):
    df = spark.createDataFrame([(price, q, u)], "p double, q string, u string")
    assert df.select(X.unit_price(F.col("p"), F.col("q"), F.col("u"))).first()[0] == expected


def test_unit_price_kg_equals_thousand_grams(spark):
    df = spark.createDataFrame([(123.45, "2", "kg"), (123.45, "2000", "g")], "p double, q string, u string")
    a, b = [r[0] for r in df.select(X.unit_price(F.col("p"), F.col("q"), F.col("u"))).collect()]
    assert a == b


@pytest.mark.parametrize("ppu,price,mins,expected", [
    (100.0, 100.0, 10, 102.5), (100.0, 100.0, 120, 130.0), (0.0, 80.0, None, 92.0),
    (None, 80.0, 0, 92.0), (10.0, 1.0, 60, 11.5),
])
def test_value_score_penalty(spark, ppu, price, mins, expected):
    df = spark.createDataFrame([(ppu, price, mins)], "a double, p double, m int")
    assert df.select(X.value_score(F.col("a"), F.col("p"), F.col("m"))).first()[0] == expected


def test_mrp_and_discount(spark):
    df = spark.createDataFrame([(90.0, 100.0), (100.0, None), (100.0, 80.0)], "p double, m double")
    rows = df.select(X.effective_mrp(F.col("p"), F.col("m")).alias("e")) \
             .select("e").collect()
    assert [r.e for r in rows] == [100.0, 100.0, 100.0]
    d = df.select(X.discount_pct(F.col("p"), X.effective_mrp(F.col("p"), F.col("m")))).collect()
    assert [r[0] for r in d] == [10.0, 0.0, 0.0]


def test_round_half_up(spark):
    df = spark.createDataFrame([(2.675,), (1.005,), (0.125,), (-0.5,)], "x double")
    got = [r[0] for r in df.select(X.round_half_up(F.col("x"), 2)).collect()]
    assert got[2] == 0.13 and got[3] == -0.5


def test_unit_label(spark):
    df = spark.createDataFrame([("g",), ("KG",), ("ml",), ("l",), ("pcs",), ("box",)], "u string")
    got = [r[0] for r in df.select(X.unit_label(F.col("u"))).collect()]
    assert got == ["per 100g", "per 100g", "per 100mL", "per 100mL", "per pc", "per unit"]


def test_strip_and_clip_handle_tabs(spark):
    assert _one(spark, "\t  Milk 1 L \n", X.clean_text(F.col("s"))) == "Milk 1 L"
    assert _one(spark, "x" * 300, X.clean_text(F.col("s"))) == "x" * 300
    assert _one(spark, "x" * 300, X.clean_text(F.col("s"), 120)) == "x" * 120
    assert _one(spark, "\u00a0Milk\u3000", X.clean_text(F.col("s"))) == "Milk"


def test_card_text_rules(spark):
    assert _one(spark, "9 mins Amul Taaza Milk 500 ml ₹27 ₹29 ADD", X.card_name(F.col("s"))) == \
        "Amul Taaza Milk 500 ml"
    assert _one(spark, "9 mins Amul ₹27", X.observed_minutes(F.col("s"))) == 9
    assert _one(spark, "₹27 ₹1,299.50 x", X.amounts(F.col("s"))) == [27.0, 1299.5]


def test_clean_product_name(spark):
    df = spark.createDataFrame([("AmulGold Milk 4.1 Ratings 230", "Amul"), ("Fresh Paneer 123456 200 g 4", "")],
                               "n string, b string")
    got = [r[0] for r in df.select(X.clean_product_name(F.col("n"), F.col("b"))).collect()]
    assert got == ["Gold Milk", "Fresh Paneer 200 g"]


def test_sanity_price_and_card_mrp(spark):
    df = spark.createDataFrame([([7.72, 150.0, 160.0],)], "f array<double>")
    row = df.select(X.card_mrp(F.col("f")[0], F.col("f")).alias("m")).first()
    assert row.m == 160.0
    fixed = df.select(X.sanity_price(F.col("f")[0], F.lit(160.0), F.col("f"))).first()[0]
    assert fixed == 150.0


def test_brand_and_bullets(spark):
    assert _one(spark, "Tata Salt 1 kg", X.brand_guess(F.col("s"))) == "Tata"
    assert _one(spark, "1kg Salt", X.brand_guess(F.col("s"))) == ""
    df = spark.createDataFrame([(["tiny", "Iodised salt for daily use", "third bullet text"],)], "b array<string>")
    assert df.select(X.bullets_description(F.col("b"))).first()[0] == "Iodised salt for daily use"
    df2 = spark.createDataFrame([(["ab", "abcd", "wxyz", ""],)], "b array<string>")
    assert df2.select(X.longest(F.col("b"))).first()[0] == "abcd"
