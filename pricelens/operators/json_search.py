"""Product lists inside JSON of unknown shape, without leaving the JVM.

A text is parsed to VARIANT once; text that is no JSON goes to quarantine. The search goes
down level by level: a list whose first element is an object with one of the wanted keys is a candidate and
is not searched further; any other list or object is replaced by its values. The recursion is unrolled into one
explosion per level, all in one stage: a recursive query would run a job per level and has a limit on rows. Nothing is
shuffled before the choice of the longest list, which compares list lengths only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels below the root that are searched.
DEPTH = 12
_LIST, _OBJECT = "array<variant>", "map<string, variant>"


def parsed(df: DataFrame, text: str, out: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(rows with the VARIANT column ``out`` in place of ``text``, rows whose text is not null and no JSON)."""
    both = df.withColumn(out, F.try_parse_json(text))
    return both.where(F.col(out).isNotNull()).drop(text), both.where(F.col(out).isNull() & F.col(text).isNotNull()).drop(out)


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _is_candidate(v: Column, keys: list[str]) -> Column:
    first = _as(F.get(_as(v, _LIST), F.lit(0)), _OBJECT)
    return F.coalesce(F.arrays_overlap(F.map_keys(first), F.array(*map(F.lit, keys))), F.lit(False))


def candidate_lists(docs: DataFrame, doc: str, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """One row per candidate list: the other columns of ``docs``, path (positions from the root; an object's values
    are numbered in the order of their keys), items (array of VARIANT).

    ``depth`` is the deepest level at which a list may stand; the root is level 0.
    """
    others = [c for c in docs.columns if c != doc]
    node = "struct<path: array<int>, v: variant, found: boolean>"
    rows = docs.select(*others, F.struct(F.array().cast("array<int>").alias("path"), F.col(doc).alias("v"), F.lit(False).alias("found")).cast(node).alias("_n"))
    for level in range(depth + 1):
        found = F.col("_n.found") | _is_candidate(F.col("_n.v"), keys)
        if level == depth:
            rows = rows.where(found)
            break
        inside = F.coalesce(_as(F.col("_n.v"), _LIST), _values(F.col("_n.v")))
        below = F.transform(inside, lambda c, k: F.struct(F.concat(F.col("_n.path"), F.array(k)).alias("path"), c.alias("v"), F.lit(False).alias("found")))
        kept = F.array(F.struct(F.col("_n.path").alias("path"), F.col("_n.v").alias("v"), F.lit(True).alias("found")))
        rows = rows.withColumn("_n", F.explode(F.when(found, kept).otherwise(below)))
    return rows.select(*others, F.col("_n.path").alias("path"), _as(F.col("_n.v"), _LIST).alias("items"))


def _values(v: Column) -> Column:
    """An object's values in the order of its keys."""
    whole = _as(v, _OBJECT)
    return F.transform(F.array_sort(F.map_keys(whole)), lambda k: F.try_element_at(whole, k))


def longest_list(candidates: DataFrame, scope: list[str]) -> DataFrame:
    """Per ``scope`` the candidate with most items, of equal ones the first by path (A10). Only lengths and paths are compared and shuffled twice; lists once."""
    size = F.size("items")
    best = candidates.groupBy(*scope).agg(F.min(F.struct((-size).alias("less"), "path")).alias("_b")).select(*scope, F.col("_b.path").alias("path"))
    return candidates.join(best, [*scope, "path"], "left_semi")


def list_items(lists: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per item: position from 0, item (VARIANT); at most ``cap`` of a list."""
    items = F.slice("items", 1, cap) if cap is not None else F.col("items")
    return lists.select(*[c for c in lists.columns if c != "items"], F.posexplode(items).alias("position", "item"))


def _text_if_any(item: Column, key: str) -> Column:
    """The text of a value that is not absent, null, false, an empty text or a zero."""
    value = F.try_variant_get(item, f"$.{key}", "variant")
    text, kind = F.try_variant_get(value, "$", "string"), F.schema_of_variant(value)
    nothing = F.when(kind == "STRING", text == "").when(kind == "BOOLEAN", text == "false").otherwise(
        F.coalesce(text.try_cast("double") == 0.0, F.lit(False)) | text.isin("[]", "{}"))
    return F.when(~nothing, text)


def first_of(item: Column, keys: list[str]) -> Column:
    """The text of the first key that holds something (X18): absent, null, false, zero and empty values are passed over. A text "0" is something."""
    return F.coalesce(*[_text_if_any(item, k) for k in keys])


def name_of(item: Column, key: str, inner: str = "name") -> Column:
    """A value that may be an object with a name, or the name itself (X20); empty if absent."""
    value = F.try_variant_get(item, f"$.{key}", "variant")
    named = F.coalesce(F.try_variant_get(value, f"$.{inner}", "string"), F.lit(""))
    return F.coalesce(F.when(_as(value, _OBJECT).isNotNull(), named).otherwise(_text_if_any(item, key)), F.lit(""))
