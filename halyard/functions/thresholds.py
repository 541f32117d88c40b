"""Age-dependent limits of vital signs, as columns. Ages in years; a null age gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: upper ends of age bands (exclusive, the last open) with their limits -------------------------------------
NEONATE = 28 / 365
AGE_GROUPS = ((NEONATE, "neonate"), (1, "infant"), (3, "toddler"), (6, "preschool"), (12, "school"), (None, "adolescent"))
HR_NORMAL = ((1 / 365, 94, 145), (8 / 365, 100, 175), (31 / 365, 115, 190), (0.25, 124, 190), (1, 111, 179), (3, 98, 163), (5, 65, 132), (8, 70, 115), (None, 55, 105))
HR_CRITICAL = ((NEONATE, 60, 220), (1, 60, 190), (10, 60, 180), (None, 60, 150))
SBP_P95 = {1: 104, 2: 106, 3: 109, 4: 111, 5: 112, 6: 114, 7: 115, 8: 116, 9: 118, 10: 119, 11: 121, 12: 123}
DBP_P95 = {1: 58, 2: 63, 3: 67, 4: 70, 5: 72, 6: 74, 7: 76, 8: 78, 9: 79, 10: 80, 11: 80, 12: 81}
EBV = ((0.25, 85), (1, 78), (6, 73), (None, 68))
SPO2_CRITICAL, SPO2_TARGET, TEMP_LOW, TEMP_HYPO, TEMP_HIGH, TEMP_FEVER, QTC_LONG = 90.0, 94.0, 35.5, 36.0, 37.5, 38.0, 480.0
EBL_SIGNIFICANT, EBL_MASSIVE, UO_LOW, HB_LOW = 10.0, 50.0, 0.5, 7.0
MIN_DEVIATION = {"HR": 10.0, "SBP": 10.0, "MBP": 10.0, "DBP": 10.0, "ISBP1": 10.0, "IMBP1": 10.0, "IDBP1": 10.0, "SpO2": 3.0, "T1": 0.5, "QTc": 20.0}
PLANNED_HYPOTHERMIA = ("cpb", "체외순환", "심폐순환", "cardiopulmonary bypass", "dhca", "deep hypothermic", "bypass on", "aortic cross", "acc on")
# ------------------------------------------------------------------------------------------------------------------------


def band(age: Column, bands: tuple, place: int = 1) -> Column:
    """The limit of the first band that the age lies under."""
    out = None
    for row in bands:
        value = F.lit(row[place] if isinstance(row[place], str) else float(row[place]))
        if row[0] is None:
            return out.otherwise(F.when(age.isNotNull(), value))
        out = (F.when if out is None else out.when)(age < row[0], value)
    return out


def age_group(age: Column) -> Column:
    return band(age, AGE_GROUPS)


def sbp_hypotension(age: Column) -> Column:
    return F.when(age < NEONATE, 60.0).when(age < 1, 70.0).when(age <= 10, 70 + 2 * age).when(age.isNotNull(), 90.0)


def _p95(age: Column, young: float, old: float, by_year: dict[int, int]) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in by_year.items() for x in (k, float(v))])
    return F.when(age < 1, young).when(age >= 13, old).otherwise(table[F.floor(age).cast("int")])


def sbp_p95(age: Column) -> Column:
    return _p95(age, 100.0, 130.0, SBP_P95)


def dbp_p95(age: Column) -> Column:
    return _p95(age, 65.0, 80.0, DBP_P95)


def map_hypotension(age: Column) -> Column:
    return F.when(age.isNotNull(), F.least(1.5 * age + 40, F.lit(65.0)))


def map_relative(baseline: Column, drop: float = 0.2) -> Column:
    return baseline * (1 - drop)


def qtc_upper(age: Column) -> Column:
    return F.when(age < NEONATE, 470.0).when(age.isNotNull(), 440.0)


def ebl_percent(ebl: Column, weight: Column, age: Column) -> Column:
    """Blood loss as percent of the estimated blood volume; null without a positive weight."""
    return F.when(weight > 0, ebl / (weight * band(age, EBV)) * 100)


def hard_low(item: Column, age: Column) -> Column:
    return (
        F.when(item == "HR", 50.0).when(item.isin("SBP", "ISBP1"), 0.7 * sbp_hypotension(age)).when(item.isin("MBP", "IMBP1"), 0.7 * map_hypotension(age))
        .when(item == "SpO2", 80.0).when(item == "T1", 34.0)
    )


def hard_high(item: Column, age: Column) -> Column:
    return F.when(item == "HR", band(age, HR_CRITICAL, 2) + 30).when(item == "T1", 39.0).when(item == "QTc", 500.0)


def planned_hypothermia(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for word in PLANNED_HYPOTHERMIA:
        out = out | low.contains(word)
    return out
