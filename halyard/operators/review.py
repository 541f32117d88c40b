"""Gold texts under review: merged with new wording, overridden by confirmed text, and turned into checklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hygiene as H

# fixed values ---------------------------------------------------------------------------------------------------------
REFERS_BACK = r"(위의?\s*내용|상기|앞의?\s*내용|이\s*외|추가\s*$)"
CLAIMS_NONE = r"(특이\s*사항\s*(없|없었|없음)|이상\s*(소견\s*)?없|필요\s*없|문제\s*없)"
SUBSTANCE = r"(?i)(투여|투약|수혈|삽관|재삽관|처치|교체|suction|흡인|wheez|crackle|desat|탈포화|저혈압|서맥|부정맥|출혈|경련|VT|arrest|심정지|puff|ventolin|lipoma|compression|병력|증후군)"
REWRITE, HEAD, LITTLE = 100, 12, 15
# ----------------------------------------------------------------------------------------------------------------------


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]+", "")


def _hollow(c: Column) -> Column:
    """Without claims that there is nothing, hardly anything is left."""
    return F.length(F.regexp_replace(F.regexp_replace(c, CLAIMS_NONE, ""), r"[\s*#:·\-–—.,()]+", "")) < LITTLE


def merge_kind(old: Column, new: Column) -> Column:
    """What becomes of an old gold text beside a new one (null is blank), the first that holds:

    kept or empty without a new one; replaced without an old one, or if the new one begins as the old one, is a whole text by
    its length and doesn't refer back, or has substance where the old one has none; merged if it refers back;
    merged_conflict if it claims that there is nothing beside findings of the old one; merged.
    """
    old, new = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    head = F.substring(_bare(old), 1, HEAD)
    return (
        F.when((new == "") & (old != ""), "kept").when(new == "", "empty").when(old == "", "replaced").when((head != "") & F.startswith(_bare(new), head), "replaced").when((F.length(new) >= REWRITE) & ~new.rlike(REFERS_BACK), "replaced")
        .when(_hollow(old) & ~_hollow(new), "replaced").when(new.rlike(REFERS_BACK), "merged").when(new.rlike(CLAIMS_NONE) & old.rlike(SUBSTANCE), "merged_conflict").otherwise("merged")
    )


def merge_gold(rows: DataFrame, old: str = "old_gt", new: str = "new_gt", prefer_new: bool = False) -> DataFrame:
    """rows with merge_type and final_gt. With prefer_new a conflict is settled for the new text (replaced_conflict)."""
    o, n = F.coalesce(F.col(old), F.lit("")), F.coalesce(F.col(new), F.lit(""))
    x = rows.withColumn("merge_type", merge_kind(F.col(old), F.col(new)))
    if prefer_new:
        x = x.withColumn("merge_type", F.when(F.col("merge_type") == "merged_conflict", "replaced_conflict").otherwise(F.col("merge_type")))
    kind = F.col("merge_type")
    return x.withColumn("final_gt", F.when(kind.isin("kept", "empty"), o).when(kind.isin("replaced", "replaced_conflict"), n).otherwise(F.concat(F.rtrim(o), F.lit("\n"), F.ltrim(n))))


def confirmed(rows: DataFrame) -> DataFrame:
    """sid, state, final_gt of reviewed rows (sid, ok, final_gt): `confirmed` with Y and a text, `skipped` without Y, else `empty`."""
    text = H.strip(F.coalesce("final_gt", F.lit("")))
    yes = F.coalesce(F.upper(H.strip(F.col("ok"))) == "Y", F.lit(False))
    state = F.when(~yes, "skipped").when(text == "", "empty").otherwise("confirmed")
    return rows.where("sid is not null").select("sid", state.alias("state"), F.when(state == "confirmed", text).alias("final_gt"))


def remap_and_override(gold: DataFrame, remap: DataFrame, override: DataFrame) -> DataFrame:
    """sid, real, text, state: gold (sid, text) under the sid that remap (sid, real) says, and override (sid, text) in its place.

    state: `gold`, `override`, or `unknown` for an override of a sid that no gold has, which is reported and not used.
    """
    x = gold.join(remap, "sid", "left").withColumn("real", F.coalesce("real", "sid"))
    o = override.select(F.col("sid").alias("real"), F.col("text").alias("_by"))
    used = x.join(o, "real", "left").select("sid", "real", F.coalesce("_by", "text").alias("text"), F.when(F.col("_by").isNotNull(), "override").otherwise("gold").alias("state"))
    stray = o.join(x.select("real").distinct(), "real", "left_anti").select(F.lit(None).cast("long").alias("sid"), "real", F.lit(None).cast("string").alias("text"), F.lit("unknown").alias("state"))
    return used.unionByName(stray)


def checklist(gold: DataFrame) -> DataFrame:
    """sid, source, is_normal_case, items of gold (sid, gold_text, parsed): the checklist that a judge's answer is read into.

    parsed: struct of is_normal_case and items (id, finding, category, severity, source), null where reading failed. Blank
    gold is no_gold, one that says that there is nothing gold_normal; else items without a finding are left out, an id that
    is missing is c and the item's place, and a text without items that is not normal has failed (gold_failed).
    """
    text = H.strip(F.coalesce("gold_text", F.lit("")))
    item = lambda i, k: F.struct(
        F.coalesce(F.nullif(i["id"].cast("string"), F.lit("")), F.concat(F.lit("c"), (k + 1).cast("string"))).alias("id"), H.strip(F.coalesce(i["finding"], F.lit(""))).alias("finding"), H.category(i["category"]).alias("category"),
        F.coalesce(i["severity"], F.lit("medium")).alias("severity"), H.strip(F.coalesce(i["source"], F.lit(""))).alias("source"),
    )
    items = F.filter(F.transform(F.coalesce(F.col("parsed.items"), F.expr("array()")), item), lambda i: i["finding"] != "")
    x = gold.withColumns({"_t": text, "items": items})
    by_text = F.when(F.col("_t") == "", "no_gold").when(H.no_issue(F.col("_t")), "gold_normal")
    normal = F.coalesce(F.col("parsed.is_normal_case"), F.lit(False)) & (F.size("items") == 0)
    source = F.coalesce(by_text, F.when(F.col("parsed").isNull() | ((F.size("items") == 0) & ~normal), "gold_failed").otherwise("gold_llm"))
    used = by_text.isNull()
    return x.select(
        "sid", source.alias("source"), F.when(used, normal).otherwise(by_text == "gold_normal").alias("is_normal_case"), F.when(used, F.col("items")).otherwise(F.slice("items", 1, 0)).alias("items"),
    )
