"""SQL text that several modules' DuckDB counterparts share."""

from __future__ import annotations

from ..functions import hygiene as H

BLANK = "[ \\t\\n\\r\\f 　]"


def STRIP_SQL(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def SQUEEZE_SQL(c: str) -> str:
    return f"regexp_replace({STRIP_SQL(f'lower({c})')}, '{BLANK}+', ' ', 'g')"


def NO_ISSUE_SQL(c: str) -> str:
    phrases = ", ".join(repr(x) for x in sorted({p.replace(" ", "") for p in H.NO_ISSUE}))
    return f"coalesce(regexp_replace(lower({c}), '[^가-힣a-z0-9]', '', 'g') IN ({phrases}), false)"


def CATEGORY_SQL(c: str) -> str:
    key = f"replace(replace(lower({STRIP_SQL(f'coalesce({c}, chr(32))')}), '-', '_'), ' ', '_')"
    legacy = " ".join(f"WHEN {key} = '{a}' THEN '{b}'" for a, b in H.CATEGORY_MAP.items())
    return f"CASE WHEN {key} IN ({', '.join(repr(x) for x in H.CATEGORIES)}) THEN {key} {legacy} ELSE 'other' END"


def RANKED(v: str, g: str) -> str:
    """Mean rank of equal values within a group."""
    return f"rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2"


def _simpson(f: str, lo: str, hi: str, steps: int) -> str:
    """The integral of f, in x, by Simpson's rule."""
    h = f"(({hi}) - ({lo})) / {steps}"
    at = f.replace("{x}", f"(({lo}) + k * {h})")
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda k: (CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * ({at}))) * {h} / 3)"


def TAIL_Z(z: str) -> str:
    """Two-sided p of a standard normal z, by quadrature."""
    return f"(2 * {_simpson('exp(-{x} * {x} / 2) / sqrt(2 * pi())', f'abs({z})', f'abs({z}) + 9', 2000)})"


def BOTH_SIDES_T(t: str, df: str) -> str:
    """Two-sided p of Student's t, by quadrature of powers of the cosine."""
    whole = _simpson(f"pow(greatest(cos({{x}}), 0), {df} - 1)", "0", "pi() / 2", 4000)
    tail = _simpson(f"pow(greatest(cos({{x}}), 0), {df} - 1)", f"atan(abs({t}) / sqrt({df}))", "pi() / 2", 4000)
    return f"({tail} / {whole})"


GOLD_SQL = f"""gold AS (SELECT sid, CASE WHEN {STRIP_SQL("coalesce(gold_text, '')")} = '' THEN 'no_gold' WHEN {NO_ISSUE_SQL('gold_text')} THEN 'gold_normal' WHEN coalesce(len(check_items), 0) = 0 AND NOT coalesce(is_normal_case, false) THEN 'gold_failed' ELSE 'gold_llm' END AS source,
  coalesce(len(check_items), 0) > 0 AS has_items, coalesce(is_normal_case, false) AS normal FROM gold_checklist)"""
