"""Problem 1: amounts in whatever unit and scale, brought to the base unit of their group and compared."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sizelake.functions.quantity_grammar import UnitTable, bracket, to_base

#: The unit list and the units by rule name are vocabularies, not data; beyond this many rows they are refused.
MOST_VOCABULARY = 100_000

AMOUNT = T.StructType(
    [
        T.StructField("amount", T.DoubleType()),
        T.StructField("dims", T.StringType()),
        T.StructField("base_unit", T.StringType()),
        T.StructField("unit_group", T.StringType()),
        T.StructField("unit_from", T.StringType()),
    ]
)


def _rows(df: DataFrame, what: str) -> list:
    got = df.limit(MOST_VOCABULARY + 1).collect()
    if len(got) > MOST_VOCABULARY:
        raise ValueError(f"{what}: more than {MOST_VOCABULARY} entries")
    return got


def unit_rows(units: DataFrame) -> list[tuple]:
    cols = ["unit_group", "unit", "alias", "case_sensitive", "factor", "base_unit"]
    return sorted((tuple(r) for r in _rows(units.select(*cols).distinct(), "units")), key=lambda r: tuple("" if x is None else str(x) for x in r))


def rule_units(rule_inputs: DataFrame, table: UnitTable) -> dict[str, str]:
    """name → a unit that its rules name. A name's unit always means the same; of several spellings any known one will do,
    the least is taken."""
    by: dict[str, str] = {}
    for r in sorted(_rows(rule_inputs.select("name", "unit").where("name is not null and unit is not null").distinct(), "rule_inputs")):
        if r["unit"].strip() and r["name"] not in by and table.resolve(r["unit"]) is not None:
            by[r["name"]] = r["unit"]
    return by


def rule_targets(units: DataFrame, rule_inputs: DataFrame) -> DataFrame:
    """(name, rule_dims, rule_factor): the unit that each rule input expects; a vocabulary, like the units themselves."""
    held = UnitTable(unit_rows(units))
    rows = [(n, ";".join(f"{k}^{e}" for k, e in u.dims), u.factor) for n, t in rule_units(rule_inputs, held).items() for u in [held.resolve(t)]]
    return units.sparkSession.createDataFrame(rows, "name string, rule_dims string, rule_factor double")


def amounts_udf(units: list[tuple], by_name: dict[str, str]):
    """Arrow UDF (raw, beside, header, quote, name) → AMOUNT; the unit table is built once a worker."""
    held: dict[str, UnitTable] = {}

    @F.pandas_udf(AMOUNT)
    def amounts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = held.get("t") or held.setdefault("t", UnitTable(units))
        for raw, beside, header, quote, name in batches:
            out = []
            for r, b, h, q, n in zip(raw, beside, header, quote, name, strict=True):
                b = b if isinstance(b, str) else None
                h = h if isinstance(h, str) else None
                got = to_base(r if isinstance(r, str) else None, b or bracket(h), q if isinstance(q, str) else None, by_name.get(n), table)
                out.append(got or (None,) * 5)
            yield pd.DataFrame(out, columns=["amount", "dims", "base_unit", "unit_group", "unit_from"]).astype({c: object for c in ("dims", "base_unit", "unit_group", "unit_from")})

    return amounts.asNondeterministic()  # or each filter on the result would evaluate it again


def normalised_values(values: DataFrame, units: DataFrame, rule_inputs: DataFrame) -> DataFrame:
    """gia_tri_so rows, each once, with the amount in base units (null where the entry is no single value)."""
    rows = unit_rows(units)
    f = amounts_udf(rows, rule_units(rule_inputs, UnitTable(rows)))
    v = values.select("value_id", "doc_id", "scope_key", "name", "gia_tri_nguyen_van", "tieu_de_cot", "cau_chua").distinct()
    return v.select(
        "value_id", "doc_id", "scope_key", "name",
        f("gia_tri_nguyen_van", F.lit(None).cast("string"), "tieu_de_cot", "cau_chua", "name").alias("q"),
    ).select("value_id", "doc_id", "scope_key", "name", "q.*")


def normalised_images(images: DataFrame, units: DataFrame, rule_inputs: DataFrame) -> DataFrame:
    rows = unit_rows(units)
    f = amounts_udf(rows, rule_units(rule_inputs, UnitTable(rows)))
    v = images.select("number_id", "doc_id", "scope_key", "name", "gia_tri_raw", "don_vi", "trich_dan").distinct()
    return v.select(
        "number_id", "doc_id", "scope_key", "name",
        f("gia_tri_raw", F.when(F.trim("don_vi") != "", F.col("don_vi")), F.lit(None).cast("string"), "trich_dan", "name").alias("q"),
    ).select("number_id", "doc_id", "scope_key", "name", "q.*")


def disagreements(values: DataFrame, images: DataFrame, units: DataFrame, rule_inputs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(value_id, number_id, ...) whose amounts in a common unit differ by more than `tolerance` of the larger.

    Nulls in a join column match nothing; a null, blank, ranged or referring entry is no case; rows repeated exactly count
    once; units without a factor compare only with themselves. Empty tables give no rows, extra columns are not read. The
    join is on (doc_id, scope_key, name, dimension vector), so a document that holds a large share of the rows is spread by
    its scopes and names."""
    a = normalised_values(values, units, rule_inputs).where("amount is not null and dims <> 'none^1'")
    b = normalised_images(images, units, rule_inputs).where("amount is not null and dims <> 'none^1'")
    b = b.withColumnsRenamed({"amount": "image_amount", "unit_from": "image_unit_from", "base_unit": "image_base_unit"}).drop("unit_group")
    x, y = F.abs("amount"), F.abs("image_amount")
    return (
        a.join(b, ["doc_id", "scope_key", "name", "dims"])
        .where(F.abs(F.col("amount") - F.col("image_amount")) > tolerance * F.greatest(x, y))
        .select("value_id", "number_id", "doc_id", "scope_key", "name", "amount", "image_amount", "base_unit", "unit_from", "image_unit_from")
    )


def _tables(spark, folder):
    from sizelake.sources.tables import table

    return [table(spark, folder, t) for t in ("gia_tri_so", "so_lieu_anh", "units", "rule_inputs")]


def p1_found(spark, folder: str) -> DataFrame:
    return disagreements(*_tables(spark, folder)).select("value_id", "number_id").distinct()


def p1_amounts(spark, folder: str) -> DataFrame:
    """Every value as an amount in the base unit of its group."""
    v, i, u, r = _tables(spark, folder)
    a = normalised_values(v, u, r).select(F.lit("value").alias("kind"), F.col("value_id").alias("id"), "amount", "base_unit", "unit_group", "unit_from")
    b = normalised_images(i, u, r).select(F.lit("image").alias("kind"), F.col("number_id").alias("id"), "amount", "base_unit", "unit_group", "unit_from")
    return a.unionByName(b)
