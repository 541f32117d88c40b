"""Prompts and training rows: rendered, cut to a budget on the side of the record only, flattened to chats, masked and padded.

Wording is a parameter; what matters is which parts may be cut. Tokenizers are functions: the default counts words, and any
other is given as a function of a text (`fit`) or as arrays of ids (masks, padding, pairs).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hygiene as H

# fixed values ---------------------------------------------------------------------------------------------------------
HEADER_EMR, HEADER_VITAL, HEADER_OUTPUT = "### EMR", "### INTRAOPERATIVE VITAL SUMMARY", "### OUTPUT"
MARKER = "[... EMR 앞부분 생략(길이 초과) ...]\n"
SHOT_HEAD, MASKED, STEPS = 700, -100, 20
# ----------------------------------------------------------------------------------------------------------------------
INSTRUCTION = "Write a hand-off for the recovery room from the record below, in one to five short Korean sentences."
JUDGE = "Say which of the two hand-offs is better, A or B, and nothing else."


def user_prompt(emr: Column, vital: Column | None = None, instruction: str = INSTRUCTION, shots: Column | None = None) -> Column:
    """Examples, instruction, record, vital summary (left out where blank) and the header that the answer follows."""
    v = F.coalesce(vital, F.lit("")) if vital is not None else F.lit("")
    part = F.when(v != "", F.concat(F.lit(f"\n\n{HEADER_VITAL}\n"), v)).otherwise("")
    text = F.concat(F.lit(f"{instruction}\n\n{HEADER_EMR}\n"), F.coalesce(emr, F.lit("")), part, F.lit(f"\n\n{HEADER_OUTPUT}\n"))
    return text if shots is None else F.concat(F.when(F.coalesce(shots, F.lit("")) != "", F.concat(shots, F.lit("\n\n"))).otherwise(""), text)


def shot_block(shots: Column, head: int = SHOT_HEAD) -> Column:
    """Examples (array of structs of k, emr and handoff) in words, in order of k, the records cut to their first `head`
    characters, which is the feature; blank for none."""
    one = lambda s: F.concat(F.lit("\nExample "), s["k"].cast("string"), F.lit("\n"), F.substring(F.coalesce(s["emr"], F.lit("")), 1, head), F.lit("\nHandoff\n"), F.coalesce(s["handoff"], F.lit("")), F.lit("\n--"))
    return F.when(F.size(shots) > 0, F.concat(F.lit("### EXAMPLES"), F.lit("\n"), F.array_join(F.transform(F.array_sort(shots), one), "\n"))).otherwise("")


def chat(system: Column, user: Column, answer: Column | None = None, system_turn: bool = True) -> Column:
    """Turns as one text. Without an answer it ends where the model goes on. Templates without a system turn have the system's
    text at the head of the user's."""
    turn = lambda role, text: F.concat(F.lit(f"<|{role}|>\n"), text, F.lit("\n"))
    sys_ = F.coalesce(system, F.lit(""))
    said = F.concat(turn("system", sys_), turn("user", user)) if system_turn else turn("user", F.concat(F.when(sys_ != "", F.concat(sys_, F.lit("\n\n"))).otherwise(""), user))
    return F.concat(said, turn("assistant", answer)) if answer is not None else F.concat(said, F.lit("<|assistant|>\n"))


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def fit_words(emr: Column, budget: int, render: Callable[[Column], Column], strict: bool = False) -> Column:
    """The prompt render(emr), of at most `budget` words: if it has more, the record's first words make way for a marker.

    Nothing but the record is cut. Where even an empty record is too much the prompt is null, or, if strict, the query fails.
    In closed form: the record keeps as many of its last words, with the blanks before each, as the rest leaves room for.
    """
    emr = F.coalesce(emr, F.lit(""))
    whole, bare = render(emr), render(F.lit(MARKER))
    room = F.lit(budget) - words(bare)
    pattern = F.concat(F.lit(r"^(\s*(?:\S+\s+){"), F.greatest(room, F.lit(0)).cast("string"), F.lit("})"))
    kept = F.reverse(F.call_function("regexp_extract", F.reverse(emr), pattern, F.lit(1)))
    cut = render(F.concat(F.lit(MARKER), kept))
    none = F.raise_error(F.lit(f"a budget of {budget} does not hold the prompt without its record")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(words(whole) <= budget, whole).when(room < 0, none).otherwise(cut)


def fit_text(text: str, budget: int, render: Callable[[str], str], count: Callable[[str], int]) -> str | None:
    """The same for one text and any count of tokens, by bisection over how many of its last characters stay; null if none fits."""
    whole = render(text)
    if count(whole) <= budget:
        return whole
    lo, hi, best = 0, len(text), None
    for _ in range(STEPS):
        mid = (lo + hi) // 2
        made = render(MARKER + text[len(text) - mid :])
        if count(made) <= budget:
            best, lo = made, mid + 1
        else:
            hi = mid - 1
        if lo > hi:
            break
    return best


def fit(df: DataFrame, key: str, emr: str, budget: int, render: Callable[[str], str], count: Callable[[], Callable[[str], int]]) -> DataFrame:
    """key, prompt: fit_text for a column. count() makes the tokenizer in the worker. A record that does not fit at all is an
    error, never a prompt without its header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted = count()
        for b in batches:
            made = [fit_text(t or "", budget, render, counted) for t in b[emr]]
            if any(m is None or HEADER_OUTPUT not in m for m in made):
                raise ValueError(f"a budget of {budget} does not hold the prompt without its record")
            yield pd.DataFrame({key: b[key], "prompt": made})

    return df.select(key, emr).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, prompt string")


def training_rows(pairs: DataFrame, system: str, key: str = "row_idx", instruction: str = JUDGE) -> DataFrame:
    """key, task, prompt, target of pairs (key, user, chosen, rejected): writing the chosen answer, and, where there is a
    rejected one, judging the two in both orders. The target follows the prompt; see masked."""
    versus = lambda a, b: F.concat(F.lit(f"{instruction}\n\nEMR:\n"), "user", F.lit("\n\nAssistant A: "), a, F.lit("\n\nAssistant B: "), b)
    c, r = F.coalesce("chosen", F.lit("")), F.coalesce("rejected", F.lit(""))
    row = lambda task, user, target: F.struct(F.lit(task).alias("task"), user.alias("user"), target.alias("target"))
    rows = F.concat(F.array(row("write", F.col("user"), c)), F.when(r != "", F.array(row("judge_ab", versus(c, r), F.lit("A")), row("judge_ba", versus(r, c), F.lit("B")))).otherwise(F.slice(F.array(row("", c, c)), 1, 0)))
    x = pairs.select(key, F.explode(rows).alias("r"))
    return x.select(key, "r.task", chat(F.lit(system), F.col("r.user")).alias("prompt"), chat(F.lit(system), F.col("r.user"), F.col("r.target")).alias("whole"), F.col("r.target").alias("target"))


def byte_ids(c: Column) -> Column:
    """The text as ids of its bytes, the tokenizer that needs no table."""
    code, n = F.hex(F.encode(c, "UTF-8")), F.octet_length(c)
    ids = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.conv(F.substr(code, 2 * k - 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(n > 0, ids).when(n == 0, F.slice(ids, 1, 0))


def masked(prompt: Column, whole: Column) -> Column:
    """Labels of the ids of a whole text: those that it has in common with the ids of its prompt from the left are masked."""
    n = F.size(prompt)
    same = F.when(F.slice(whole, 1, F.greatest(n, F.lit(1))) == prompt, n).otherwise(
        F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.least(n, F.size(whole))), lambda k: ~F.get(prompt, k).eqNullSafe(F.get(whole, k)) | (k == F.least(n, F.size(whole)))), F.lit(0)), F.lit(0))
    )
    return F.concat(F.array_repeat(F.lit(MASKED), same), F.slice(whole, same + 1, F.greatest(F.size(whole) - same, F.lit(0))))


def pad_left(ids: Column, length: int, pad: int) -> Column:
    """An array's last `length` items, with pads before it where there are fewer."""
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))), F.slice(ids, F.greatest(F.size(ids) - length + 1, F.lit(1)), length))


def fit_pair(prompt: Column, chosen: Column, rejected: Column, most: int, most_prompt: int, mode: str = "keep_end") -> Column:
    """struct of prompt, chosen and rejected (arrays of ids) within `most`: if the prompt and the longer answer are more, the
    prompt keeps its last (first, for keep_start) most_prompt ids; if that is still too much, answers their first ones."""
    if mode not in ("keep_end", "keep_start"):
        raise ValueError(mode)
    longer = F.greatest(F.size(chosen), F.size(rejected))
    over = F.size(prompt) + longer > most
    start = F.greatest(F.size(prompt) - most_prompt + 1, F.lit(1)) if mode == "keep_end" else F.lit(1)
    p = F.when(over, F.slice(prompt, start, most_prompt)).otherwise(prompt)
    still = F.size(p) + longer > most
    cut = lambda a: F.when(still, F.slice(a, 1, most - most_prompt)).otherwise(a)
    return F.struct(p.alias("prompt"), cut(chosen).alias("chosen"), cut(rejected).alias("rejected"))


def chunks(c: Column, size: int = 100, most: int = 512) -> Column:
    """The text's first `most` words, as the scorer takes no more, in parts of `size`; a blank text is one part as it is."""
    t = F.slice(H.tokens(c), 1, most)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / size).cast("int")), lambda k: F.slice(t, k * size + 1, size))
    return F.when(F.size(t) > 0, parts).otherwise(F.array(F.array(F.coalesce(c, F.lit("")))))
