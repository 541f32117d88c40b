"""The text of a record: put together from the parts of a case, and taken apart again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import hygiene as H
from ..functions.normalize import first_number

#: The labels of a record's sections, in order.
SECTIONS = ("Pre-anesthetic Patient Conditions Summary", "Preoperative Preparations and Premedication", "Anesthetic TOTALS", "Anesthetic Record")


def assemble(cases: DataFrame, key: str, preop: str, premed: str, totals: dict[str, str], record: str) -> DataFrame:
    """key, emr: four labelled sections with an empty line between them. The totals are a line for each column (by label) that
    is not null; without any their section is left out. Other parts that are null are blank."""
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c in totals.items()]) if totals else F.lit("")
    part = lambda k, c: F.concat(F.lit(f"- {SECTIONS[k]}\n"), F.coalesce(c, F.lit("")))
    return cases.select(key, F.concat_ws("\n\n", part(0, F.col(preop)), part(1, F.col(premed)), F.when(lines != "", part(2, lines)), part(3, F.col(record))).alias("emr"))


def total_columns(columns: list[str], prefix: str) -> dict[str, str]:
    """The columns whose names begin with the prefix, in order, by what follows it."""
    return {c.removeprefix(prefix).strip("_ "): c for c in columns if c.startswith(prefix)}


def sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, k, label, content of each labelled section of a text, from 0; a text without labels is one section, EMR."""
    at = F.split(text, rf"- (?=(?:{'|'.join(SECTIONS)})\n)")
    whole = F.array(F.struct(F.lit("EMR").alias("label"), H.strip(F.col(text)).alias("content")))
    split = F.transform(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(1))), lambda p: F.struct(F.substring_index(p, "\n", 1).alias("label"), H.strip(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("content")))
    x = rows.where(F.col(text).isNotNull()).select(key, F.posexplode(F.when(F.size(at) > 1, split).otherwise(whole)).alias("k", "s"))
    return x.select(key, "k", "s.label", "s.content")


#: Parts of the names of columns that hold a weight, and the weights that are possible.
WEIGHT_HINTS, WEIGHT_RANGE = ("체중", "weight", "몸무게"), (0.4, 150.0)


def weight_column(cases: DataFrame) -> str | None:
    """The first column whose name looks like a weight's and that holds a possible one; None if there is none."""
    hinted = [c for c in cases.columns if any(h in c.lower() for h in WEIGHT_HINTS)]
    if not hinted:
        return None
    some = cases.agg(*[F.count_if(first_number(F.col(f"`{c}`").cast("string")).between(*WEIGHT_RANGE)).alias(f"n{k}") for k, c in enumerate(hinted)]).first()
    return next((c for k, c in enumerate(hinted) if some[f"n{k}"]), None)


def weights(cases: DataFrame, key: str) -> DataFrame:
    """key, weight: the number in the weight column that was found; null outside the range, or if no column was found."""
    c = weight_column(cases)
    w = first_number(F.col(f"`{c}`").cast("string")) if c else F.lit(None).cast("double")
    return cases.select(key, F.when(w.between(*WEIGHT_RANGE), w).alias("weight"))


def record_column(columns: list[str], names: tuple[str, ...] = ("record", "emr", "anesthetic_record")) -> str | None:
    """The first of the names that is a column, whatever the case; without one interventions can't be linked."""
    there = {c.lower(): c for c in columns}
    return next((there[n] for n in names if n in there), None)
