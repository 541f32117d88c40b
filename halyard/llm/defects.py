"""Broken prompt and response pairs: empty, refused, copied, foreign and truncated answers.

A multi-label linear classifier (logistic, one head per defect) decides all five. Its heads read hashed n-grams of each
sentence, the kinds of words in a row, the end of the answer, and features of the pair: how much of the answer is in the
prompt, how many letters of its own it has, whether exact checks (nothing but signs; four fifths copied; no Korean sentence)
hold. It is trained on a bounded sample of the answers themselves, taken as sound, and on answers made from them: emptied,
cut off, copied from the prompt, refused, or put into another language. Answers swapped between prompts are made too, but
taught as sound: no defect asked for is about them, and they keep the copy head from reading more than what is copied.
Refusals are composed from templates, and calibrated on templates that no head was trained on. Each head's threshold is
calibrated on made answers that it was not trained on.
"""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import spread
from .overlap import letters

DEFECTS = ("empty", "refusal", "copy", "language", "truncated")
HEADS = DEFECTS
DIM = 1 << 16
SAMPLE = 2_500  # answers that the classifier is trained on
COPIED = 0.8  # least share of an answer's letters that a copy has from its prompt
GRAM = 6
DOUBT = 0.02  # score from which a sampled answer is not taught as sound

# fixed values ---------------------------------------------------------------------------------------------------------
MISSING = frozenset("null none nan na nil undefined missing blank empty tbd 없음 해당없음 미입력 미기재 무응답 빈칸 결측 noanswer noresponse nooutput".split())
NO_ISSUE = frozenset("특이사항없음 특이소견없음 이상없음 이상소견없음 특이사항없습니다".split())
#: Refusals as templates of opener, subject and closing; see _refusal. Every second template is kept for calibration.
KO_OPEN = ("", "", "미안합니다만 ", "유감스럽게도 ", "양해를 구합니다. ", "말씀 잘 들었습니다. ", "네, 이해했습니다. 다만 ")
KO_SUBJECT = ("인계 글", "의무기록 해석", "진료에 관한 물음", "임상 문서 초안", "이 건", "환자 자료 정리", "의학적 판단", "기록 요약본", "건강 정보", "그런 문안")
KO_DECLINE = (
    "{}에 관해서는 도움이 되어 드리지 못합니다.", "{}에는 답하지 못하는 점 이해 바랍니다.", "{} 쪽은 제가 다룰 수 없는 영역입니다.", "{} 관련 작업은 진행하지 않겠습니다.", "{}까지 대신 써 드릴 수는 없습니다.", "{} 생성을 거부합니다.",
    "저는 언어 모델이라 {} 같은 일은 맡을 수 없습니다.", "인공지능 도우미로서 {} 이야기는 하기 곤란합니다.", "규정에 따라 {} 제공이 제한됩니다.", "개인정보 때문에 {} 공개는 하지 못합니다.", "{} 처리 권한이 저에게 주어지지 않았습니다.",
    "{} 요청은 받아들일 수 없습니다.", "{}에 대한 의견을 드리는 것은 적절하지 않습니다.", "{} 지원은 하지 않는 기능입니다.", "주어진 자료로 {} 완성은 불가능하니 다른 방법을 찾아 주십시오.", "{} 작성은 허용되지 않은 일입니다.",
)
KO_CLOSE = ("", "", "담당 의사와 의논해 주십시오.", "의료진의 확인을 권합니다.", "다른 주제라면 돕겠습니다.", "가까운 전문가에게 여쭤 보십시오.")
EN_OPEN = ("", "Being just a language model, ", "Since I am only software, ", "Apologies, but ", "I'm sorry, but ", "Unfortunately, ", "Thanks for asking, but ", "Regrettably, ")
EN_CAN = ("I can't", "I cannot", "I am unable to", "I'm not able to", "I won't", "I'm not allowed to", "I must decline to", "as an AI model I may not", "I am not in a position to", "being an AI assistant, I am not able to", "I don't have permission to")
EN_DO = ("help with", "assist in writing", "draft", "produce", "summarise", "comment on", "discuss", "give an opinion on", "go over", "interpret", "look through")
EN_SUBJECT = ("this chart.", "that kind of note.", "medical documents.", "personal health data.", "clinical matters.", "the handover you want.", "this question.", "such a task.")
EN_CLOSE = ("", "", "Kindly turn to the treating team.", "Try a different topic.", "A physician should be asked.")
EN_WHOLE = (
    "That is beyond my remit.", "Such requests are outside my scope.", "My guidelines rule this out.", "No reply can be given on this matter.", "This is not something I may do.", "I have to pass on this one.", "Requests of this sort are declined.",
    "The assistant is of no use in this matter.", "I cannot offer that.", "Providing it would go against policy, so I refrain.",
)
OTHER = (
    "お手伝いできかねます。ご了承ください。", "その件についてはお答えいたしかねます。", "医療上の助言はできません。", "個人情報のため対応しておりません。", "私はAIですので診断はできません。", "あいにくですが、作成は承れません。",
    "恐縮ですが、診療記録の要約はお引き受けできません。", "その依頼にはお応えしかねます。", "申し訳ないのですが、医学的な判断は行えません。", "对不起，我无法完成这份交接记录。", "我不能处理患者的资料。", "作为人工智能，我不便给出医学意见。",
    "Perdón, no me es posible redactar esa nota.", "No estoy autorizado a tratar datos clínicos.", "Leider kann ich diese Notiz nicht schreiben.", "Ich darf keine medizinischen Auskünfte geben.",
    "Désolé, il m'est impossible de rédiger cette note.", "Je ne suis pas en mesure de traiter ce dossier.", "Извините, я не вправе составлять такие записи.", "Я не могу обсуждать данные пациента.",
    "Rất tiếc, tôi không được phép xử lý hồ sơ này.", "Tôi không thể viết bản bàn giao này.",
)
#: What could not be done to a patient, which is a report and no refusal.
NOT_DONE = ("기관삽관", "말초정맥로 확보", "동맥혈 채취", "경막외 카테터 거치", "혈압 측정", "비강 삽관", "중심정맥관 삽입", "보호자 연락", "체온 측정")
NOT_DONE_HOW = ("{} 할 수 없어 다른 방법으로 변경함.", "{} 불가능하여 의료진에게 인계함.", "{} 어려워 세 차례 시도 후 중단함.", "{} 실패하여 재시도 예정임.", "{} 시행하지 못하였고 이후 안정됨.")
#: Answers that hold nothing.
HOLLOW = ("", " ", "-", "--", "...", "**", "#", "###", "1.", "•", "( )", "[]", "\u200b", "null", "None", "N/A", "n/a", "NaN", "nil", "-없음-", "해당없음", "미기재", "(미입력)", "답변:", "인계문:", "### 요약", "Output:", "**인계 사항**", "결과: -", "요약: null", "undefined", "TBD", "빈칸", "무응답", "“”", "no answer", "[blank]", "1)\n2)\n3)", "- \n- ", "—")
FOREIGN = """The patient had a stable course and was transferred to the recovery room.
Watch for stridor after extubation and keep the child warm.
Blood loss was small and urine output was adequate throughout.
Oxygen saturation fell for a few minutes and recovered with suction.
El paciente permaneció estable y fue trasladado a la sala de recuperación.
Se recomienda vigilar la respiración y la temperatura.
Der Patient war stabil und wurde in den Aufwachraum verlegt.
Auf Nachblutung und Atmung ist zu achten.
Le patient est resté stable et a été transféré en salle de réveil.
Surveiller la respiration et la température.
Пациент стабилен и переведён в палату пробуждения.
Следить за дыханием и температурой.
患者は安定しており、回復室に移りました。
呼吸と体温に注意してください。
患者生命体征平稳，已转入恢复室。
请注意呼吸和体温变化。
Bệnh nhân ổn định và được chuyển về phòng hồi tỉnh.
Cần theo dõi hô hấp và nhiệt độ.""".split("\n")
_HEADING = regex.compile(r"^\s*(?:[#*>\-•·\s]*)(?:인계\s?(?:요약|문|사항|내용)?|답변|답|요약|결과|출력|회복실\s?인계문?|output|answer|hand-?off(?:\s+note)?|summary|response|result)\s*[*#]*\s*(?:[:：]\s*[*]*|\n|$)", regex.I)
# ----------------------------------------------------------------------------------------------------------------------

_SENTENCE = regex.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+")
_MARKS = regex.compile(r"^\s*(?:[-*•·▶▷►#>]+|\d{1,2}[.)]|[①-⑳]|\([0-9a-z]\))\s*", regex.I)
_WORD = regex.compile(r"\S+")
_NO_HANGUL = regex.compile(r"[가-힣]+")
_DIGITS = regex.compile(r"\d+")
_OPEN = regex.compile(r"(?:을|를|(?<!추)이|가|에|의|로|와|과|은|는|도|고|며|여|어|나|및|한|할|된|될)$")


def body(answer: str) -> str:
    """The answer without headings before it."""
    while (m := _HEADING.match(answer)) and m.end():
        answer = answer[m.end() :]
    return answer


def is_empty(answer: str | None) -> bool:
    """Null, or nothing but blanks, signs, list marks, headings or stand-ins for a missing value."""
    if answer is None:
        return True
    rest = letters(_MARKS.sub("", body(answer)))
    return not any(c.isalpha() for c in rest) or rest in MISSING


def _alphas(s: str) -> int:
    return sum(map(str.isalpha, s))


def _hanguls(s: str) -> int:
    return len(s) - len(_NO_HANGUL.sub("", s))


def korean_sentences(text: str) -> int:
    """Sentences with two Hangul syllables at least beside which the other letters don't make up nearly all."""
    return sum(_korean(s) for s in _SENTENCE.split(text))


def _korean(sentence: str) -> bool:
    ko = _hanguls(sentence)
    return ko >= 2 and ko >= 0.08 * _alphas(sentence)


@lru_cache(maxsize=16)
def _letters(prompt: str) -> str:
    return letters(prompt)


@lru_cache(maxsize=16)
def _runs(prompt: str) -> frozenset[str]:
    p = _letters(prompt)
    return frozenset(p[i : i + GRAM] for i in range(len(p) - GRAM + 1))


def copied_share(answer: str, prompt: str) -> float:
    """Share of the answer's letters that lie in runs of GRAM letters of the prompt."""
    return _copied(letters(answer), prompt)


def _copied(a: str, prompt: str) -> float:
    p = _letters(prompt)
    if len(a) < GRAM:
        return float(bool(a) and a in p)
    there = p if len(a) < 200 else _runs(prompt)  # a few runs are sooner looked for in the text itself
    total = last = 0
    for i in range(len(a) - GRAM + 1):
        if a[i : i + GRAM] in there:
            total += i + GRAM - max(i, last)
            last = i + GRAM
    return total / len(a)


#: What each head reads: the letters that are there, grams of each sentence (the highest score counts), how much is copied,
#: scripts and kinds of words, the end.
READS = {"empty": "bare", "refusal": "gram", "copy": "copied", "language": "script", "truncated": "end"}


@lru_cache(maxsize=1 << 16)
def _hash(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % DIM


def _slots(names) -> np.ndarray:
    return np.array(sorted({_hash(x) for x in names}), np.int64)


@lru_cache(maxsize=1 << 16)
def _word_kind(w: str) -> str:
    """H: Hangul in it, L: Latin letters only, N: digits, other scripts by their first letter's block, S: signs."""
    if _NO_HANGUL.search(w):
        return "H"
    for c in w:
        if c.isalpha():
            return "L" if c < "\u0250" else f"x{ord(c) >> 8}"
    return "N" if any(map(str.isdigit, w)) else "S"


def _steps(name: str, x: float, steps: int = 20) -> list[str]:
    """Names of the twentieths that x reaches."""
    return [f"{name}{k}" for k in range(1, min(steps, int(x * steps + 1e-9)) + 1)]


def _grams(text: str) -> np.ndarray:
    """Slots of the runs of two, three and four characters, as often as they occur."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out, h = [], points
    for n in (1, 2, 3):
        if len(points) <= n:
            break
        h = h[:-1] * np.uint64(1_000_003) + points[n:]
        out.append((h ^ (h >> np.uint64(29))) % np.uint64(DIM))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class Pair:
    """An answer with what is known of it beside its prompt; slots: the features by what they are of."""

    text: str
    copied: float
    korean: int
    slots: dict[str, list[np.ndarray]]  # one array for the answer, or one for each sentence


def look(prompt: str | None, answer: str | None) -> Pair:
    text = body(answer or "").strip()
    mine = letters(_MARKS.sub("", text))
    hollow = is_empty(answer)
    bare = ["bias", f"n{min(len(mine), 12)}", *(["hollow"] if hollow else []), *(["signs"] if not _alphas(mine) else [])]
    if len(mine) <= 12:
        bare.append(f"b{mine}")
    if hollow:
        return Pair(text, 0.0, 0, {"bare": [_slots(bare)], "gram": [_slots(["bias"])], "copied": [_slots(["bias"])], "script": [_slots(["bias"])], "end": [_slots(["bias"])]})
    plain = _DIGITS.sub("0", text)
    sentences = _SENTENCE.split(plain)
    copied = _copied(mine, prompt or "")
    korean = sum(_korean(s) for s in sentences)
    own = (1 - copied) * len(mine)
    words = sentences[-1].split() or [""]
    ends = [f"e{plain[-n:]}" for n in range(1, 13)] + [f"w{' '.join(words[-n:])}" for n in (1, 2, 3)] + [f"x{plain.rstrip('.')[-n:]}" for n in range(1, 9)]
    grams = [_grams(x.lower()) for x in sentences if _alphas(x) > 2]
    kinds = [[_word_kind(w) for w in s.split()] for s in sentences]
    runs = {f"r{''.join(k[i : i + n])}" for k in kinds for n in (1, 2, 3) for i in range(len(k) - n + 1)}
    slots = {
        "bare": [_slots(bare)],
        "gram": [np.append(g, _hash("bias")) for g in grams] or [_slots(["bias"])],
        "copied": [_slots(["bias", *_steps("c", copied), *(["exact"] if copied >= COPIED else []), f"o{min(int(own), 1 << 20).bit_length()}", f"l{len(mine).bit_length()}"])],
        "script": [_slots(["bias", f"k{min(korean, 3)}", *_steps("h", _hanguls(text) / (_alphas(text) or 1)), *runs])],
        "end": [_slots(["bias", *ends])],
    }
    return Pair(text, copied, korean, slots)


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray  # heads x DIM
    thresholds: dict[str, float]

    def scores(self, pair: Pair) -> dict[str, float]:
        return {h: float(max(_logistic(w[g].sum()) for g in pair.slots[READS[h]])) for h, w in zip(HEADS, self.weights)}

    def defect(self, prompt: str | None, answer: str | None) -> tuple[str | None, float]:
        """The first defect that the classifier finds, and its score. That there is nothing to report is a sound answer."""
        pair = look(prompt, answer)
        if letters(pair.text) in NO_ISSUE:
            return None, 0.0
        p = self.scores(pair)
        for head in HEADS:
            if p[head] >= self.thresholds[head]:
                return head, p[head]
        return None, max(p.values())


def _refusal(rng: random.Random, part: int | None = None) -> str:
    """A refusal from the templates; part 0 or 1: from those of even or odd place only."""
    pick = lambda xs: rng.choice(xs if part is None else xs[part::2])
    how = rng.random()
    if how < 0.45:
        said = f"{rng.choice(KO_OPEN)}{pick(KO_DECLINE).format(rng.choice(KO_SUBJECT))}"
        return f"{said} {rng.choice(KO_CLOSE if rng.random() < 0.9 else EN_CLOSE)}".strip()
    if how < 0.7:
        said = f"{rng.choice(EN_OPEN)}{pick(EN_CAN)} {pick(EN_DO)} {rng.choice(EN_SUBJECT)}"
        return f"{said[0].upper()}{said[1:]} {rng.choice(EN_CLOSE)}".strip()
    if how < 0.82:
        said = f"{rng.choice(EN_OPEN)}{pick(EN_WHOLE)}"
        return f"{said[0].upper()}{said[1:]} {rng.choice(EN_CLOSE)}".strip()
    return f"{pick(OTHER)} {rng.choice(('', '', *KO_CLOSE, *EN_CLOSE))}".strip()


def _made(base: list[tuple[str, str]], rng: random.Random, part: int | None = None) -> Iterator[tuple[str, str, str]]:
    """(prompt, answer, label) made from sound pairs; label "" is sound."""
    for prompt, answer in base:
        yield prompt, answer, ""
        if answer.endswith("."):
            yield prompt, answer[:-1], ""  # a full stop may be left out
        lines = [x.strip() for x in prompt.split("\n") if len(x.strip()) > 8]
        yield rng.choice(base)[0], answer, ""  # swapped between prompts, it is a sound answer by itself
        if lines and rng.random() < 0.5:
            yield prompt, f"{answer} 기록상 '{rng.choice(lines).strip('.')}' 소견 확인됨.", ""
        if rng.random() < 0.15:
            yield prompt, f"{rng.choice(NOT_DONE_HOW).format(rng.choice(NOT_DONE))} {answer}", ""
        if rng.random() < 0.15:
            yield prompt, f"{rng.choice(FOREIGN)} {answer}", ""
        for _ in range(3):
            sentences = [m for m in regex.finditer(r"[^.!?\n]+(?:[.!?](?=\s|$)|\n|$)|\S+", answer) if len(_WORD.findall(m[0])) > 1]
            if not sentences:
                break
            m = rng.choice(sentences)
            words = list(_WORD.finditer(answer, m.start(), m.end()))
            if rng.random() < 0.8:
                cut = words[rng.randrange(len(words) - 1)].end()
            else:
                w = rng.choice(words)
                cut = rng.randrange(w.start() + 1, w.end() + 1)
            if sum(c.isalpha() for c in answer[cut : m.end()]) and is_empty(answer[:cut]) is False:
                yield prompt, answer[:cut].rstrip(), "truncated"
        if lines:
            k = rng.randrange(len(lines))
            some = lines[k : k + rng.randint(1, 6)]
            if rng.random() < 0.5:
                some = rng.sample(lines, min(len(lines), rng.randint(1, 5)))
            text = rng.choice(["\n", " / ", " ", ". "]).join(some)
            text = rng.choice([text, text, text.replace(",", ""), f"인계문: {text}", prompt[: rng.randint(60, 600)], prompt])
            yield prompt, text, "copy"
            parts = _SENTENCE.split(answer)
            own = " ".join(parts[-rng.randint(1, len(parts)) :])  # sentences of its own behind it
            yield prompt, f"{text}\n{own}", "copy" if copied_share(f"{text}\n{own}", prompt) >= COPIED else ""
        yield prompt, _refusal(rng, part), "refusal"
        foreign = " ".join(rng.sample(FOREIGN, rng.randint(1, 3)))
        yield prompt, rng.choice(["", "", "인계 요약: "]) + foreign, "language"
        yield prompt, rng.choice(HOLLOW), "empty"


_TRAINED: dict[str, Model] = {}


def train(rows: list[tuple[str, str]], seed: int = 7, epochs: int = 5, rate: float = 0.3, part: int | None = None) -> Model:
    """A model from (prompt, answer) pairs that are sound for the most part; the same pairs give the same model, trained once.

    Refusals for training are made from every second template and those for calibration from the others; then, with the
    threshold found, each head is trained on all. part 0 or 1 keeps it to one half, so that the other can measure it.
    """
    digest = hashlib.blake2b(repr((rows, seed, epochs, rate, part)).encode("utf-8", "surrogatepass")).hexdigest()
    if digest not in _TRAINED:
        if len(_TRAINED) > 3:
            _TRAINED.clear()
        _TRAINED[digest] = _train(rows, seed, epochs, rate, part)
    return _TRAINED[digest]


def _fit(x: list[np.ndarray], y: np.ndarray, kept: np.ndarray, epochs: int, rate: float) -> np.ndarray:
    w, square = np.zeros(DIM), np.full(DIM, 1e-6)
    sizes = np.array([len(g) for g in x])
    for _ in range(epochs):
        for lo in range(0, len(kept), 128):
            group = kept[lo : lo + 128]
            slots, of = np.concatenate([x[i] for i in group]), np.repeat(np.arange(len(group)), sizes[group])
            g = _logistic(np.bincount(of, weights=w[slots], minlength=len(group))) - y[group]
            at, place = np.unique(slots, return_inverse=True)
            grad = np.bincount(place, weights=g[of]) / len(group) + 1e-7 * w[at]
            square[at] += grad * grad
            w[at] -= rate * grad / np.sqrt(square[at])
    return w


def _fit_mean(x: list[np.ndarray], y: np.ndarray, kept: np.ndarray, epochs: int, rate: float, rng: random.Random, times: int = 2) -> np.ndarray:
    """The mean of several fits, each in an order of its own: single fits differ in what they make of rare endings."""
    orders = [kept] + [np.array(rng.sample(kept.tolist(), len(kept)), np.int64) for _ in range(times - 1)]
    return sum(_fit(x, y, o, epochs, rate) for o in orders) / times


def _without_refusals(base: list[tuple[str, str]], rng: random.Random, epochs: int, rate: float, part: int | None) -> list[tuple[str, str]]:
    """The sample has refusals itself, some many times, which must not be taught as sound. Answers with a number report on a
    patient and are sure to be none; of the others those stay that don't look like one to a head that has not seen them."""
    sure, bare = [b for b in base if _DIGITS.search(b[1])], [b for b in base if not _DIGITS.search(b[1])]
    if not sure or not bare:
        return base
    said = [_refusal(rng, part) for _ in sure] + [f"{rng.choice(NOT_DONE_HOW).format(rng.choice(NOT_DONE))}" for _ in sure[::4]]
    texts = [a for _, a in sure] + said
    x, y = [], []
    for k, text in enumerate(texts):
        for g in look("", text).slots["gram"]:
            x.append(g)
            y.append(float(len(sure) <= k < 2 * len(sure)))
    w = _fit(x, np.array(y), np.array(rng.sample(range(len(x)), len(x)), np.int64), epochs, rate)
    likely = lambda a: max(float(_logistic(w[g].sum())) for g in look("", a).slots["gram"]) > DOUBT
    return sure + [b for b in bare if not likely(b[1])]


def _train(rows: list[tuple[str, str]], seed: int, epochs: int, rate: float, part: int | None) -> Model:
    rng = random.Random(seed)
    base, foreign = [], []
    for prompt, answer in rows:
        if not is_empty(answer):
            pair = look(prompt, answer)
            if pair.copied < COPIED:
                (base if pair.korean else foreign).append((prompt, answer.strip()))
    # answers without a full stop are taken as sound if many end so, in Hangul, with no particle and no bracket open
    close = lambda a: " ".join(_DIGITS.sub("0", a).split()[-2:])
    often = Counter(close(a) for _, a in base)
    ends = lambda a: "가" <= a[-1] <= "힣" and not _OPEN.search(a) and a.count("(") == a.count(")")
    base = [(p, a) for p, a in base if a[-1] in ".!?。" or ends(a) and often[close(a)] >= max(3, 0.002 * len(base))]
    rng.shuffle(base)
    both = _without_refusals(base + foreign, rng, epochs, rate, part)
    other = set(foreign)
    base, foreign = [b for b in both if b not in other], [b for b in both if b in other]
    held = len(base) // 5  # pairs whose made answers only calibrate
    made = list(_made(base[:held], rng, 1 if part is None else part)) if held else []
    tested = len(made)
    made += list(_made(base[held:], rng, 0 if part is None else part)) if base else []
    if part is None and base:
        made += [(p, _refusal(rng, 1), "refusal 1") for p, _ in base[held:]]
    made += [(p, a, "foreign") for p, a in foreign]
    pairs = [look(p, a) for p, a, _ in made]
    labels = [label for _, _, label in made]
    weights, thresholds = np.zeros((len(HEADS), DIM)), dict.fromkeys(HEADS, 0.5)
    for h, head in enumerate(HEADS):
        x, of = [], []
        for k, pair in enumerate(pairs):
            # heads come in order, and the first that fits decides: what one before has taken is not taught to the last as whole
            if head == "empty" or labels[k] != "empty" and (head != "truncated" or labels[k] in ("", "truncated")):
                for g in pair.slots[READS[head]]:
                    x.append(g)
                    of.append(k)
        of = np.array(of, np.int64)
        # an answer may have several defects: a refusal in another language is both
        is_ = np.array([label in (head, f"{head} 1") or (head == "language" and label != "empty" and pair.korean == 0) for label, pair in zip(labels, pairs)], bool)[of]
        sound = np.array([label in ("", "foreign") for label in labels], bool)[of]
        later = np.array([label.endswith(" 1") for label in labels], bool)[of]
        y = is_.astype(float)
        order = np.array(rng.sample(range(len(x)), len(x)), np.int64)
        training = order[(of[order] >= tested) & ~later[order]]
        score = lambda w: np.array([_logistic(w[g].sum()) for g in x])
        sure = np.ones(len(x), bool)
        if head == "truncated":
            # what looks like one is not taught as sound again
            sure = ~(sound & (score(_fit(x, y, training, epochs, rate)) > DOUBT))
        training = training[sure[training]]
        w = _fit_mean(x, y, training, epochs, rate, rng)
        # the lowest of the thresholds with about the fewest errors among made answers that it was not trained on
        p, test = score(w), (of < tested) & sure
        if test.any() and 0 < y[test].sum() < test.sum():
            grid = np.linspace(0.1, 0.95, 18)
            errors = np.array([((p[test] >= t) != y[test].astype(bool)).sum() for t in grid])
            thresholds[head] = float(grid[np.flatnonzero(errors <= errors.min() + 0.003 * test.sum())[0]])
        weights[h] = _fit_mean(x, y, order[sure[order]], epochs, rate, rng)
    return Model(weights.astype(np.float32), thresholds)


def find_defects(records: DataFrame, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """gen_id, defect, score of each defective record (gen_id, prompt_text, generated).

    The first of DEFECTS that fits. A null answer is empty; a null prompt has nothing to copy from. "특이사항 없음" alone is
    sound. Texts are read whole. Repeated rows give their rows again. Extra columns are ignored; an empty table gives no
    rows. The classifier is trained on `sample` answers, the least by a hash of gen_id; nothing else is sampled.
    """
    rows = spread(records.select("gen_id", "prompt_text", "generated"))
    order = F.xxhash64("gen_id", F.lit(seed))
    picked = rows.where("generated is not null").select("prompt_text", "generated", order.alias("_o"), "gen_id").orderBy("_o", "gen_id").limit(sample).collect()
    model = train([(r["prompt_text"] or "", r["generated"]) for r in picked], seed)
    shared = records.sparkSession.sparkContext.broadcast(model)  # DIM weights for each head, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = []
            for gen_id, prompt, answer in b.itertuples(index=False, name=None):
                defect, score = m.defect(prompt, answer)
                if defect:
                    out.append((gen_id, defect, score))
            yield pd.DataFrame(out, columns=["gen_id", "defect", "score"])

    return rows.mapInPandas(run, "gen_id long, defect string, score double")
