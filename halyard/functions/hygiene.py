"""Hygiene of generated text, as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

# fixed values ---------------------------------------------------------------------------------------------------------
ALLOWED_SIGNS = " \n\t().,/%+-:;#*°<>=~?!'\"[]{}·…&|\\@^_$²³㎎㎍㏖①②③‘’“”，。？！：；（）【】『』「」、〜ㆍ％℃㎏㎜㎝㎖ℓμΔ±×÷—–‐ 　"
ALLOWED_SIGNS_V2 = " \n\t().,/%+-:;#*°<>=~?!'\"[]{}·…&|\\@^_$²³㎎㎍㏖①②③"
NO_ISSUE = ("특이사항 없음", "특이 사항 없음", "특이사항없음", "이상 없음", "이상소견 없음", "특이소견 없음", "no issues", "no issue", "none", "unremarkable")
NO_ISSUE_V2 = ("특이사항 없음", "특이 사항 없음", "특이사항없음", "이상 없음", "이상소견 없음", "no issues", "none", "unremarkable")
SOUND_ENDS = ("다", "요", ".", "음", "함", "됨", "임", ")", "%")
SOUND_ENDS_V2 = ("다", "요", ".", "음", "함")
#: Legacy category ids, and the ids of today; what is neither is `other`.
CATEGORY_MAP = {
    "airway": "airway_management", "respiratory": "airway_management", "hemodynamics": "intraop_event", "lines_devices": "intraop_event", "cooperation_agitation": "intraop_event", "bleeding_transfusion": "transfusion_fluid",
    "congenital_major_disease": "comorbidity_medication", "drug_effect": "comorbidity_medication",
}
CATEGORIES = ("comorbidity_medication", "airway_management", "intraop_event", "transfusion_fluid", "preop_abnormal_test", "uri_status", "other")
MODEL_KEYS = ("gemma4_31b", "gemma4", "qwen35", "llama", "qwen", "hari")
EXPERIMENTS = ("raw", "rlaif_dpo", "rlaif_simpo", "sft_1ep", "sft_3ep", "sft_1ep_dpo", "sft_3ep_dpo")
LEAKS = {
    "think_tag": r"(?i)</?think", "thought": r"(?i)(?://|_|\|)\s*thought|ownthought|thought\b", "judge_token": r"(?im)\[RESULT\]|Assistant [AB]\b|^\s*[AB]\s*$", "prompt": r"(?i)Constraint|System:|###\s|You are an anesthesiolog",
    "summary": r"(?i)\*\*Summary|Post-?Op(?:erative)? (?:Findings|Events)",
}
ROLE = r"(?im)^[ \t]*(?:assistant|user|system)[ \t]*:?[ \t]*$"
THOUGHT = r"(?i)(?://|_|\|)\s*thought\b|<\|?thought"
PARTICLES = "을|를|이|가|에|의|로|와|과|은|는"
PARTICLES_V2 = "를|을|이|가|에|의|로|와|과"
LABELLED_NUMBER = r"(?i)(병\s*록\s*번\s*호|등\s*록\s*번\s*호|chart\s*(?:no\.?|number)|MRN)\s*[:：]?\s*\S+"
LABELLED_NAME = r"(?i)(환자\s*(?:성명|이름|명)|성\s*명|환자명)\s*[:：]?\s*\S+"
#: Version 1: a chain of thought behind the answer or before it, and lines that the training data left.
TRAILING_V1 = r"(?is)\n*\s*(?:Thinking Process|Analyze the Request)\b.*$"
LEADING_V1 = r"(?is)^\s*(?:Thinking Process|Analyze the Request|Analysis|Step \d|<think>).*?(?=(?:##|환아|환자|\*\*환자|소아|▶|\d{2}:\d{2}|특이사항))"
JUNK_V1 = r"(?m)Name:\s*\d+,\s*dtype:\s*\w+|^(?:assistant|user)\s*$|위 데이터를 바탕으로[^。\n]*작성하세요\.?"
FAILED_V1 = "[생성 실패: 출력 없음]"
OUTPUT_OPEN, OUTPUT_CLOSE = "<<<MODEL_HANDOFF>>>", "<<<END_MODEL_HANDOFF>>>"
# ----------------------------------------------------------------------------------------------------------------------

SPACE = "[ \\t\\n\\r\\f 　]"
_SIGNS = "".join("\\" + c if c in "[]\\^-&~" else c for c in ALLOWED_SIGNS if not c.isspace())
ALLOWED = f"[가-힣ᄀ-ᇿ㄰-㆏A-Za-z0-9一-鿿{_SIGNS}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def without_thinking(raw: Column) -> Column:
    """Without closed think blocks, one left open at the end, and lines of a role's name."""
    closed = F.regexp_replace(raw, r"(?is)<think>.*?</think>", "")
    low = F.lower(closed)
    opened = F.when(low.contains("<think>") & ~low.contains("</think>"), F.regexp_replace(closed, r"(?is)<think>.*$", "")).otherwise(closed)
    return strip(F.regexp_replace(opened, ROLE, ""))


def char_wall(c: Column) -> Column:
    """Eight equal characters in a row, signs of rules and blanks aside."""
    return c.rlike(r"([^\-=#*_~. \t\n·])\1{7,}")


def foreign_share(c: Column) -> Column:
    """Share of the characters other than blanks that are of no script or sign expected."""
    solid = F.regexp_replace(c, f"{SPACE}", "")
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(solid, ALLOWED, "")).cast("double"), F.length(solid)), F.lit(0.0))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda t: t != "")


def repeats(t: Column) -> Column:
    """Of an array of words: the same three times in a row, or fewer than half of the runs of four different."""
    n = F.size(t)
    at = lambda k: F.sequence(F.lit(1), k)
    triple = F.when(n >= 3, F.exists(at(n - 2), lambda i: (F.get(t, i - 1) == F.get(t, i)) & (F.get(t, i) == F.get(t, i + 1)))).otherwise(False)
    grams = F.when(n >= 12, F.transform(at(n - 3), lambda i: F.array_join(F.slice(t, i, 4), "\u0001")))
    return triple | F.coalesce(F.size(F.array_distinct(grams)) < 0.5 * F.size(grams), F.lit(False))


def status(cleaned: Column, words: Column) -> Column:
    """empty, repetition, garbage, leak or ok, in this order; words: the cleaned text's, computed once."""
    return (
        F.when(F.length(cleaned) < 3, "empty").when(char_wall(cleaned), "repetition").when(foreign_share(cleaned) > 0.15, "garbage")
        .when(cleaned.rlike(THOUGHT), "leak").when(repeats(words), "repetition").otherwise("ok")
    )


def flags(raw: Column, cleaned: Column, state: Column) -> Column:
    sound = F.lit(False)
    for end in SOUND_ENDS:
        sound = sound | cleaned.endswith(end)
    return F.array_compact(F.array(
        F.when(F.lower(raw).contains("<think>"), "had_think_block"), F.when(F.regexp_replace(raw, r"(?is)<think>.*?</think>", "").rlike(ROLE), "had_role_lines"),
        F.when((state == "ok") & cleaned.rlike(f"(?:{PARTICLES}){SPACE}*$") & ~sound, "maybe_truncated")))


def no_issue(c: Column) -> Column:
    """The text says that there is nothing to report, and nothing else; null and empty texts don't."""
    bare = F.regexp_replace(F.lower(c), "[^가-힣a-z0-9]", "")
    return F.coalesce((bare != "") & bare.isin(*sorted({p.replace(" ", "") for p in NO_ISSUE})), F.lit(False))


def squeeze(c: Column) -> Column:
    """Without case, and each run of blanks as one."""
    return F.regexp_replace(strip(F.lower(c)), f"{SPACE}+", " ")


def cell(c: Column) -> Column:
    """A cell of a sheet: stand-ins for nothing as empty, outer quotes off, those without a partner too."""
    s = strip(c)
    two = F.length(s) >= 2
    quoted = s.startswith('"') & s.endswith('"') & two
    odd = F.length(s) - F.length(F.replace(s, F.lit('"'), F.lit("")))
    return (
        F.when(c.isNull() | F.lower(s).isin("nan", "none", "-", "(없음)"), "").when(quoted, strip(F.substr(s, F.lit(2), F.length(s) - 2)))
        .when((odd % 2 == 1) & s.startswith('"'), strip(F.substr(s, F.lit(2)))).when((odd % 2 == 1) & s.endswith('"'), strip(F.substr(s, F.lit(1), F.length(s) - 1))).otherwise(s)
    )


def scrub_labels(c: Column) -> Column:
    """Numbers and names that stand behind their label."""
    return F.regexp_replace(F.regexp_replace(c, LABELLED_NUMBER, "[식별번호 제거]"), LABELLED_NAME, "[이름 제거]")


def category(c: Column) -> Column:
    """A category's id of today: blanks and dashes are underscores, legacy ids are mapped, unknown ones and null are `other`."""
    known = F.create_map(*[F.lit(x) for pairs in (((k, k) for k in CATEGORIES), CATEGORY_MAP.items()) for pair in pairs for x in pair])
    key = F.translate(F.lower(strip(F.coalesce(c, F.lit("")))), "- ", "__")
    return F.coalesce(F.try_element_at(known, key), F.lit("other"))


def no_issue_v2(c: Column) -> Column:
    """Version 2: empty texts say so too, and short ones whose first line begins so."""
    low = strip(F.lower(c))
    compact = F.regexp_replace(low, "[ .·]", "")
    first = strip(F.substring_index(low, "\n", 1))
    starts = F.lit(False)
    for p in NO_ISSUE_V2:
        starts = starts | F.startswith(first, F.lit(p))
    same = compact.isin(*sorted({p.replace(" ", "") for p in NO_ISSUE_V2})) | low.isin(*NO_ISSUE_V2)
    return F.coalesce((c == "") | same | (starts & (F.length(low) < 40)), F.lit(True))


def clean_v1(c: Column, failed: str = FAILED_V1) -> Column:
    """Version 1: without thinking before, behind and in it, and without lines of the training data; `failed` under five letters."""
    x = F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", "")
    x = F.regexp_replace(F.regexp_replace(x, TRAILING_V1, ""), JUNK_V1, "")
    x = strip(F.regexp_replace(x, LEADING_V1, ""))
    return F.when(F.length(x) < 5, failed).otherwise(x)


def foreign_share_v2(c: Column) -> Column:
    """Version 2: compatibility letters and curly signs are foreign too."""
    signs = "".join("\\" + x if x in "[]\\^-&~" else x for x in ALLOWED_SIGNS_V2 if not x.isspace())
    solid = F.regexp_replace(c, f"{SPACE}", "")
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(solid, f"[가-힣ᄀ-ᇿA-Za-z0-9一-鿿{signs}]", "")).cast("double"), F.length(solid)), F.lit(0.0))


def status_v2(cleaned: Column, words: Column) -> Column:
    """Version 2: any sign repeats as a wall, and a text that breaks off is `truncated`. null is empty."""
    sound = F.lit(False)
    for end in SOUND_ENDS_V2:
        sound = sound | cleaned.endswith(end)
    return (
        F.when(cleaned.isNull() | (F.length(cleaned) < 3), "empty").when(cleaned.rlike(r"(.)\1{7,}"), "repetition").when(foreign_share_v2(cleaned) > 0.15, "garbage").when(cleaned.rlike(THOUGHT), "leak")
        .when(repeats(words), "repetition").when(cleaned.rlike(f"(?:{PARTICLES_V2}){SPACE}*$") & ~sound, "truncated").otherwise("ok")
    )


def collapse_repeats(c: Column) -> Column:
    """For display: a unit of 1 to 40 characters four times or more as itself and how often, and a character 15 times or more
    as three of it. Counts stand in the text, so it runs in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        many = lambda m: f"{m[1]} …(×{len(m[0]) // len(m[1])}회 반복 생략)"
        runs = lambda m: f"{m[1] * 3}…(×{len(m[0])})"
        return texts.map(lambda t: t if not t else re.sub(r"(?s)(.)\1{14,}", runs, re.sub(r"(?s)(.{1,40}?)(?:\1){3,}", many, t)), na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def nested(row: Column, *path: str) -> Column:
    """The text at a path of a struct, blank where a step is null: what is read from a sheet never stops a prompt."""
    x = row
    for step in path:
        x = x[step]
    return F.coalesce(strip(x.cast("string")), F.lit(""))


def split_tag(tag: Column) -> Column:
    """struct of model and experiment: the longest known model that the tag is or begins with, else its first part; "?" for no
    experiment."""
    rest = F.substring_index(tag, "_", 1)
    out = F.struct(rest.alias("model"), F.when(F.contains(tag, F.lit("_")), F.substr(tag, F.length(rest) + 2)).otherwise("?").alias("experiment"))
    for key in sorted(MODEL_KEYS, key=len):
        hit = F.startswith(tag, F.lit(f"{key}_"))
        out = F.when(tag == key, F.struct(F.lit(key).alias("model"), F.lit("?").alias("experiment"))).when(hit, F.struct(F.lit(key).alias("model"), F.substr(tag, F.lit(len(key) + 2)).alias("experiment"))).otherwise(out)
    return out


def wrapped(output: Column) -> Column:
    """A model's output between marks, so that it can't pass for instructions."""
    return F.concat(F.lit(f"{OUTPUT_OPEN}\n"), output, F.lit(f"\n{OUTPUT_CLOSE}"))


def json_candidates(c: Column, want: str = "obj") -> Column:
    """What may be the JSON object (or array, for want "arr") of an answer: in a fence first, then in the whole; each as it is,
    then without commas before a bracket."""
    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = r"(?s)\{.*\}" if want == "obj" else r"(?s)\[.*\]"
    bodies = F.transform(F.array(fence, c), lambda p: F.regexp_extract(p, body, 0))
    both = F.flatten(F.transform(bodies, lambda b: F.array(b, F.regexp_replace(b, r",(\s*[}\]])", "$1"))))
    return F.filter(both, lambda b: b != "")


def first_json(c: Column, want: str = "obj") -> Column:
    """The first candidate that parses, as text; null if none does."""
    return F.get(F.filter(json_candidates(c, want), lambda b: F.try_parse_json(b).isNotNull()), F.lit(0))


def result_score(c: Column) -> Column:
    """The number behind [RESULT], 1 to 5; nothing else is a score."""
    return F.nullif(F.regexp_extract(c, r"\[RESULT\]\s*\(?\s*([1-5])\s*\)?", 1), F.lit("")).try_cast("double")
