"""Pack size from a product name (X2, X3, X22) as native regex Columns.

Word boundaries use ASCII classes (``[0-9A-Za-z_]``) so Java, Python and RE2
agree; Java supports the look-arounds natively.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

NOT_WORD_BEFORE = r"(?<![0-9A-Za-z_])"
NOT_WORD_AFTER = r"(?![0-9A-Za-z_])"
UNIT_ALTERNATION = r"(kg|grams?|gms?|g|litres?|liters?|lit|l|ml)"
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"

# The unit words and forms that shops use. Weight/volume: number, optional space, unit; first match wins.
SIZE_PATTERN = "(?i)" + NOT_WORD_BEFORE + NUMBER + WS + "*" + UNIT_ALTERNATION + NOT_WORD_AFTER
# Count: "12 pcs", "6 eggs", "pack of 12 eggs", "x 10 units".
COUNT_PATTERN = f"(?i)(?:pack{WS}+of{WS}+|x{WS}*)?([0-9]+){WS}*(?:pcs?|pieces?|eggs?|units?)"

# Extended forms (documented rules, checked in this order).
MULTI_PATTERN = ("(?i)" + NOT_WORD_BEFORE + f"([0-9]+){WS}*[x×]{WS}*" + NUMBER + WS + "*"
                 + UNIT_ALTERNATION + NOT_WORD_AFTER)
HALF_PATTERN = r"(?i)" + NOT_WORD_BEFORE + f"(?:half|1/2){WS}*" + UNIT_ALTERNATION + NOT_WORD_AFTER
HALF_DOZEN_PATTERN = r"(?i)" + NOT_WORD_BEFORE + f"half{WS}+dozen" + NOT_WORD_AFTER
DOZEN_PATTERN = r"(?i)" + NOT_WORD_BEFORE + f"([0-9]+){WS}*dozens?" + NOT_WORD_AFTER
PACK_OF_PATTERN = f"(?i)pack{WS}+of{WS}+([0-9]+)"


# (pattern, group) in the order of the rules: multipack, half, half dozen, dozen, measure, pack, count.
EXTENDED_RULES = [(MULTI_PATTERN, 0), (HALF_PATTERN, 0), (HALF_DOZEN_PATTERN, 0), (DOZEN_PATTERN, 1),
                  (SIZE_PATTERN, 0), (PACK_OF_PATTERN, 1), (COUNT_PATTERN, 1)]


def canonical_unit(raw: Column) -> Column:
    """kg / g / l / ml from the matched unit word."""
    u = F.lower(raw)
    return (F.when(u == "kg", F.lit("kg"))
             .when(u.isin("g", "gm", "gms", "gram", "grams"), F.lit("g"))
             .when(u.isin("l", "lit", "litre", "liter", "litres", "liters"), F.lit("l"))
             .when(u == "ml", F.lit("ml"))
             .otherwise(u))


def _size_struct(q: Column, unit: Column, label: Column) -> Column:
    return F.struct(q.alias("quantity"), unit.alias("unit"), label.alias("size_label"))


def extract_size(name: Column) -> Column:
    """struct(quantity string, unit string, size_label string), the code's rules.

    ``Lime Soda 750 ml`` -> (750, ml, 750ml); ``Rolls 8 pcs`` -> (8, pcs, 8 pcs);
    no size -> (1, pcs, ''). ``3 x 90g`` reads as 90 g and ``2,000 g`` as 000 g.
    """
    qty = F.regexp_extract(name, SIZE_PATTERN, 1)
    unit = canonical_unit(F.regexp_extract(name, SIZE_PATTERN, 2))
    cnt = F.regexp_extract(name, COUNT_PATTERN, 1)
    has_size = qty != ""
    has_count = cnt != ""
    return (F.when(has_size, _size_struct(qty, unit, F.concat(qty, unit)))
             .when(has_count, _size_struct(cnt, F.lit("pcs"), F.concat(cnt, F.lit(" pcs"))))
             .otherwise(_size_struct(F.lit("1"), F.lit("pcs"), F.lit(""))))


def _number_text(x: Column) -> Column:
    """Integral doubles print without decimals; others with up to 3 (engine-neutral)."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(
        F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", ""))


def _to_base(q: Column, unit: Column) -> Column:
    """(quantity double, unit) in base units g / ml."""
    return F.struct(
        F.when(unit.isin("kg", "l"), q * F.lit(1000.0)).otherwise(q).alias("q"),
        F.when(unit == "kg", F.lit("g")).when(unit == "l", F.lit("ml")).otherwise(unit).alias("u"))


def extract_size_extended(name: Column) -> Column:
    """The documented size rules, normalised to g / ml / pcs.

    Order: ``N x Q unit`` (multipack), ``half``/``1/2`` + unit, ``half dozen``,
    ``N dozen``, plain weight/volume, ``pack of N``, count words, else 1 pc.
    Result struct(quantity string, unit string, size_label string).
    """
    return _extended_from(*(F.regexp_extract(name, pattern, group) for pattern, group in EXTENDED_RULES))


# ---------------------------------------------------------------------------
# Table form: each pattern is evaluated once per row into a helper column, and
# the size struct is built from those columns (a Column-only form repeats the
# regex inside every branch that uses it).
# ---------------------------------------------------------------------------

def with_size(df, name_col: str, mode: str = "basic", out: str = "_size"):
    """Add struct column ``out`` (quantity, unit, size_label) computed from ``name_col``."""
    name = F.col(name_col)
    if mode == "basic":
        staged = df.withColumns({
            "_sz_m": F.regexp_extract(name, SIZE_PATTERN, 0),
            "_sz_c": F.regexp_extract(name, COUNT_PATTERN, 1),
        }).withColumns({
            "_sz_q": F.regexp_extract(F.col("_sz_m"), r"^[0-9]+(?:\.[0-9]+)?", 0),
            "_sz_u": canonical_unit(F.regexp_extract(F.col("_sz_m"), r"(?i)[a-z]+$", 0)),
        })
        q, u, c = F.col("_sz_q"), F.col("_sz_u"), F.col("_sz_c")
        built = (F.when(q != "", _size_struct(q, u, F.concat(q, u)))
                  .when(c != "", _size_struct(c, F.lit("pcs"), F.concat(c, F.lit(" pcs"))))
                  .otherwise(_size_struct(F.lit("1"), F.lit("pcs"), F.lit(""))))
        return staged.withColumn(out, built).drop("_sz_m", "_sz_c", "_sz_q", "_sz_u")
    if mode != "extended":
        raise ValueError(mode)
    staged = df.withColumns({f"_x{k}": F.regexp_extract(name, pattern, group) for k, (pattern, group) in enumerate(EXTENDED_RULES)})
    parts = [f"_x{k}" for k in range(len(EXTENDED_RULES))]
    return staged.withColumn(out, _extended_from(*map(F.col, parts))).drop(*parts)


def _extended_from(m: Column, h: Column, hd: Column, dz: Column, s: Column, pk: Column,
                   c: Column) -> Column:
    """Extended size struct from the whole matches / groups of each rule."""
    num = r"[0-9]+(?:\.[0-9]+)?"
    unit_tail = r"(?i)[a-z]+$"
    m_n = F.regexp_extract(m, r"[0-9]+", 0)
    m_q = F.regexp_extract(m, f"(?i)[x×]{WS}*(" + num + ")", 1)
    m_u = canonical_unit(F.regexp_extract(m, unit_tail, 0))
    h_u = canonical_unit(F.regexp_extract(h, unit_tail, 0))
    s_q = F.regexp_extract(s, "^" + num, 0)
    s_u = canonical_unit(F.regexp_extract(s, unit_tail, 0))

    def measured(q: Column, unit: Column) -> Column:
        b = _to_base(q, unit)
        txt = _number_text(b["q"])
        return _size_struct(txt, b["u"], F.concat(txt, b["u"]))

    def counted(n: Column) -> Column:
        txt = _number_text(n)
        return _size_struct(txt, F.lit("pcs"), F.concat(txt, F.lit(" pcs")))

    return (F.when(m != "", measured(m_n.cast("double") * m_q.cast("double"), m_u))
             .when(h != "", measured(F.lit(0.5), h_u))
             .when(hd != "", counted(F.lit(6.0)))
             .when(dz != "", counted(dz.cast("double") * F.lit(12.0)))
             .when(s != "", measured(s_q.cast("double"), s_u))
             .when(pk != "", counted(pk.cast("double")))
             .when(c != "", counted(c.cast("double")))
             .otherwise(_size_struct(F.lit("1"), F.lit("pcs"), F.lit(""))))
