"""Personal data in free text: found, scored, and replaced by typed placeholders.

Patterns propose spans. Each proposal has a score: that of its pattern, raised by validators that hold (Luhn, mod 97, the
check digit of resident numbers, a possible date of birth), and raised or lowered by words nearby. Proposals under the
threshold are dropped; of those that overlap the best stays. Check digits only confirm: numbers without one count too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame

from ..session import spread

from .folding import folded

KINDS = ("email", "phone", "id_number", "address", "name")
THRESHOLD = 0.5

# fixed values ---------------------------------------------------------------------------------------------------------
#: Family names of one and of two syllables.
FAMILY_1 = "강고공곽구권기길김나남노도류마맹명모문민박반방배백변봉부빈서석선설성소손송신심안양엄여연염예오옥온왕용우원위유육윤은이인임장전정제조주지진차채천최추탁태편표하한함허현형홍황"
FAMILY_2 = "남궁|선우|황보|제갈|독고|사공|서문|동방"
#: Words that stand where a name would and are none.
NOT_NAMES = frozenset("환자 환아 보호자 선생 교수 과장 간호사 주치의 전공의 마취의 집도의 의사 부모 모친 부친 어머니 아버지 고객 담당 당직 원장 팀장 기사 인턴 조모 조부 이모 고모 형제 우리 여러 기타 인계 완료 지속 이상 소견 정상 수술 마취 어린이 소아 신생아 영아 유아 남아 여아 본인 하나 이동 동반 입실 대기 면담 예정 연락 전화 주소 성명 이름 확인 진행 보고 설명".split())
#: Adverbs that begin as a family name does.
ADVERBS = "추가|전일|이후|이전|당시|현재|우선|주로|지금|전혀|천천히|모두|방금|임시|정규|하루|최근|최초|반복|연속|전후|직후|직전|조금|자주|다시|이미|아직"
NOT_ENGLISH = frozenset("the a an is was were and or of in on at to for with from by per all day patient mother father nurse doctor room ward bed team on-call oncall call hold line lot rate note name names unknown none general surgery anesthesia pediatric resident fellow staff attending consulted notified aware present available requested called paged informed".split())
#: Words near a number that make it an identity number, a telephone number, or the number of a thing.
ID_WORDS = "주민|등록번호|외국인|여권|passport|보험|insurance|환자번호|병록번호|차트|chart|MRN|Hospital No|ID#|ID No|환자 ?ID|생년월일|동의서|RRN|SSN"
PHONE_WORDS = "전화|연락|핸드폰|휴대|통화|문자|비상|당직|직장|회신|call|tel|phone|mobile|reach|☎|H\\.P|HP|보호자"
THING_WORDS = "lot|S/N|SN|serial|바코드|barcode|코드|code|검체|혈액번호|혈액백|unit no|batch|model|장비|주입펌프|펌프|pump|약품|device|REF|specimen|단위번호"
#: Words after a name that make it the name of a disease, operation, sign or score; and titles and relations beside one.
EPONYM_WORDS = "증후군|징후|척도|점수|분류법?|기준|syndrome|disease|procedure|operation|sign|score|scale|criteria|classification|shunt|repair|anomaly|tetralogy|catheter"
TITLE_WORDS = "환자|환아|보호자|어머니|아버지|모친|부친|교수|선생|과장|간호사|전공의|마취의|집도의|Dr|Prof|Mr|Mrs|Ms|RN|MD|mother|father|parent|guardian|nurse|patient|fellow|resident"
UNITS = r"(?:시|군|구|읍|면|도|특별시|광역시)"
STREETS = "Street|Drive|Lane|Avenue|Court|Road|Boulevard|Way|Place|Terrace|Crescent|Close|Square|Parkway"
# ----------------------------------------------------------------------------------------------------------------------

_F = regex.IGNORECASE | regex.V1
_S = r"[^\S\n]"
#: A word or note that may stand between a label and its value, where the value doesn't follow at once.
_FILL = rf"(?:(?:\([^()\n]{{1,8}}\)|[가-힣]{{1,3}}|[A-Za-z]{{2,3}}-){_S}+)??"
#: What may stand between a name and what follows it: fewer words, since a name may follow too.
_GAP = rf"(?:(?:\([^()\n]{{1,8}}\)|(?:{ADVERBS}|약간|금일|매우|재)|[A-Za-z]{{2,3}}-){_S}+)?"
_GIVEN = r"[가-힣]{1,2}(?:[ \t]?[가-힣]{1,2})?"
KO = rf"(?=[{FAMILY_1}남선황제독사서동])(?!(?:{ADVERBS})(?![가-힣]))(?:(?:{FAMILY_2})|[{FAMILY_1}])[ \t]?{_GIVEN}"
_W = r"[A-Za-z][A-Za-z'’\-]+"
EN = rf"(?:[A-Za-z]\.{_S}*)?{_W}(?:{_S}+(?:[A-Za-z]\.{_S}*)?{_W})?"
EN_CAP = rf"(?:[A-Z]\.{_S}*)?[A-Z][A-Za-z'’\-]+(?:{_S}+(?:[A-Z]\.{_S}*)?[A-Z][A-Za-z'’\-]+)?"
EITHER = rf"(?:{KO}|{EN})"
_SEP = r"(?:[\s.\-–‑·]|-\n)"


@dataclass(frozen=True)
class Rule:
    """A pattern whose group `x` (else the whole match) is proposed as a span of kind with a score."""

    kind: str
    pattern: regex.Pattern
    score: float
    need: tuple[str, ...] = ()  # texts without any of these, in folded case and with each blank as a space, can't match
    number: bool = False  # nor can texts without a long number, see _LONG


def _rule(kind: str, score: float, pattern: str, flags: int = _F, need: str = "", number: bool = False) -> Rule:
    return Rule(kind, regex.compile(pattern, flags), score, tuple(need.split("|")) if need else (), number)


def _labels(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|골뱅이)\s?[\])}>]\s?|\s골뱅이\s)"
_DOT = r"(?:\s?\.\s?|\s?[\[({<]\s?(?:dot|점)\s?[\])}>]\s?)"
_ID_LABEL = _labels(r"MRN", r"Hospital\s+No\.?", r"ID\s*#", r"ID\s*No\.?", r"등록\s?번호", r"환자\s?번호", r"병록\s?번호", r"차트\s?번호", r"chart\s*(?:no\.?|number|#)", r"환자\s?ID", r"patient\s*(?:id|no\.?|number)")
_DIGITS = r"[A-Z]{0,2}\d{7,10}|[A-Z]?\d{3,4}[\s\-–]\d{4}"
_ROAD = rf"[가-힣0-9]+(?:대로|로|길)\s+\d+(?:번길\s+\d+)?(?:-\d+)?"
_LOT = rf"[가-힣0-9]+(?:동|리|가)\s+(?:산\s?)?\d+(?:-\d+)?(?:번지)?"
_FLAT = rf"(?:,?\s+(?:[가-힣]+(?:아파트|빌라|주공|맨션|타운)\s+)?(?:\d+동\s+\d+호|\d+-\d+(?:호)?|\d+호))?"

RULES = (
    _rule("email", 0.95, rf"(?<![\w.+\-])[A-Za-z0-9][A-Za-z0-9._+\-]*{_AT}(?:[A-Za-z0-9\-]+{_DOT})+[A-Za-z]{{2,}}", need="@|[at|(at|{at|<at|[ at|( at|{ at|< at|골뱅이"),
    _rule("email", 0.9, r"(?<![\w.+\-])[A-Za-z0-9][A-Za-z0-9._+\-]*\s+at\s+[A-Za-z0-9\-]+(?:\s+dot\s+[A-Za-z0-9\-]+)+", need="dot"),
    # telephone numbers: mobile, city, international
    _rule("phone", 0.75, rf"(?<![\d\-.])(?=[+\s80])(?:\+?\s?82{_SEP}?(?:\(0\)|0)?|0)1[016789]{_SEP}{{0,2}}\d{{3,4}}{_SEP}{{0,2}}\d{{4}}(?![\d]|[\-.]\d)", need="1", number=True),
    _rule("phone", 0.65, rf"(?<![\d\-.])(?=[(0+8])(?:\(0(?:2|[3-6]\d|70|50\d)\)|0(?:2|[3-6]\d|70|50\d)|\+?82{_SEP}?0?(?:2|[3-6]\d|70|50\d)){_SEP}{{1,2}}\d{{3,4}}{_SEP}{{1,2}}\d{{4}}(?![\d]|[\-.]\d)", need="0|82", number=True),
    _rule("phone", 0.75, rf"(?<![\w\-.])\+(?!82)\d{{1,3}}{_SEP}?\(?\d{{1,4}}\)?(?:{_SEP}{{1,2}}\d{{2,4}}){{2,4}}(?![\d]|[\-.]\d)", need="+"),
    _rule("phone", 0.5, rf"{_labels('전화(?:번호)?', '연락처', '핸드폰', '휴대폰', r'tel\.?', r'phone')}\s*:?\s*(?P<x>\(?\d{{2,4}}\)?{_SEP}{{0,2}}\d{{3,4}}{_SEP}{{0,2}}\d{{4}})(?![\d]|[\-.]\d)", need="전화|연락처|폰|tel|phone", number=True),
    # identity numbers
    _rule("id_number", 0.6, r"(?<![\d\-.])\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:\s?[\-–‑]\s?|\s)?[1-8]\d{6}(?![\d]|[\-.]\d)", number=True),
    _rule("id_number", 0.4, r"(?<![\d\-.])\d{6}\s?[\-–‑]\s?\d{7}(?![\d]|[\-.]\d)", number=True),
    _rule("id_number", 0.9, rf"{_ID_LABEL}{_S}*[:#]?\s*{_FILL}(?P<x>{_DIGITS})(?![\d])", need="mrn|no|번호|id|chart|patient", number=True),
    _rule("id_number", 0.9, rf"(?:여권(?:\s?번호)?|passport(?:\s*(?:no\.?|number|#))?)\s*[:#]?\s*{_FILL}(?P<x>[A-Z]{{1,2}}\d{{7,8}}|[A-Z]\d{{3}}[A-Z]\d{{4}})(?!\d)", need="여권|passport"),
    _rule("id_number", 0.9, rf"(?:보험증?(?:\s?번호)|insurance\s*(?:no\.?|number|#|id))\s*[:#]?\s*{_FILL}(?P<x>\d(?:[\d\-]{{8,13}})\d)(?!\d)", need="보험|insurance"),
    _rule("id_number", 0.85, rf"(?:주민|외국인)(?:등록)?\s?번호\s*[:#]?\s*{_FILL}(?P<x>\d{{6}}\s?[\-–‑]?\s?[\d*]{{7}})(?!\d)", need="주민|외국인"),
    _rule("id_number", 0.85, rf"(?<=(?<![가-힣]){KO}\s*[/,;]\s*)(?P<x>\d{{6}}\s?[\-–‑]?\s?\d{{7}})(?!\d)", need="NUMBER13"),
    _rule("id_number", 0.45, r"(?<![\d\-.])(?:\d{4}[ \-]){3}\d{4}(?![\d\-])", number=True),
    _rule("id_number", 0.45, r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){3,7}\b", regex.V1),
    # home addresses
    _rule("address", 0.85, rf"(?<![가-힣])(?:[가-힣]+{UNITS}\s+){{1,3}}(?:{_ROAD}|(?:[가-힣]+{UNITS}\s+)?{_LOT}){_FLAT}", need="HOUSE"),
    _rule("address", 0.85, rf"(?<![\w])(?=[\d#AUFS])(?:(?:Apt|Apartment|Unit|Flat|Suite|#)\.?\s*\d+[A-Z]?,\s*)?\d{{1,5}}\s+(?:[A-Za-z'’]{{2,}}{_S}+){{1,3}}(?:{STREETS})\b(?:,{_S}*(?:[A-Za-z'’]+)(?:{_S}+(?-i:[A-Z][A-Za-z'’]+))?(?=[\s,.;)/]|$))?", need="street|drive|lane|avenue|court|road|boulevard|way|place|terrace|crescent|close|square|parkway"),
    # names in Korean
    _rule("name", 0.9, rf"(?:성명|환자명|이름|성함)\s*[:：]?\s*{_FILL}(?P<x>{KO})(?=[\s,;.()/]|$|님|씨)", need="성명|환자명|이름|성함"),
    _rule("name", 0.9, rf"(?:성명|환자명|이름|성함)\s*[:：]?\s*{_FILL}(?P<x>{EN})(?=\s*(?:[,;./()\n]|$)|\s+[가-힣0-9])", need="성명|환자명|이름|성함"),
    _rule("name", 0.85, rf"(?:기록자|인계받은\s+사람|의뢰의|작성자|서명자|담당자|인계자)\s*[:：]?\s*{_FILL}(?P<x>{KO})(?=[\s,;.()/]|$)", need="기록자|인계|의뢰의|작성자|서명자|담당자"),
    _rule("name", 0.85, rf"보호자\s+{_FILL}(?P<x>{KO})(?=\s*(?:\(?[+0]\d?|\(\(|에게|께|와|과|,\s*전화)|\s*\([+(\d])", need="보호자"),
    _rule("name", 0.85, rf"(?<![가-힣])환아\s+{_FILL}(?P<x>{KO})(?=\s+{_GAP}보호자)", need="환아"),
    _rule("name", 0.85, rf"(?<![가-힣])(?P<x>{KO})(?=\s?님(?:[\s,.;)(/]|$|이|의|과|께|은|을))", need="님"),
    _rule("name", 0.85, rf"(?<![가-힣])(?P<x>{KO})(?=\s+씨(?:[\s(,.]|$)|씨(?:[\s(,.]|$))", need="씨"),
    _rule("name", 0.85, rf"(?<![가-힣])(?P<x>{KO})(?=\s+{_GAP}(?:어린이|환아\s+{_GAP}수술|환자\s+{_GAP}본인|군\s|양\s))", need="어린이|환아|환자|군 |양 "),
    _rule("name", 0.85, rf"(?:집도의|전공의|간호사|마취의|보조|과장|교수|선생|주치의|펠로우|전문의|수간호사|인턴|의사|소아과|외과|내과|마취과|흉부외과|정형외과|신경외과|이비인후과|심장내과)\s+{_FILL}(?P<x>{KO})(?=\s*{_GAP}(?:교수|선생|과장|인수함|인수|교대|간호사|전공의|원장|의사|[,;]\s*{_GAP}보조|[,;]\s*RN))", need="집도의|전공의|간호사|마취의|주치의|인턴|보조|과장|교수|선생|펠로우|전문의|의사|과"),
    _rule("name", 0.85, rf"마취의\s+{_FILL}{KO}\s*[,;]\s*{_FILL}보조\s+{_FILL}(?P<x>{KO})(?=[\s,;.)]|$)", need="보조"),
    _rule("name", 0.85, rf"마취의\s+{_FILL}(?P<x>{KO})(?=\s*[,;]\s*{_GAP}보조)", need="보조"),
    _rule("name", 0.8, rf"(?<=(?<![가-힣])(?P<x>{KO})\s*[/,;]\s*)\d{{6}}\s?[\-–‑]?\s?\d{{7}}", need="NUMBER13"),
    # names in Latin letters
    _rule("name", 0.85, rf"\b(?:Dr|Prof|Mr|Mrs|Ms|Miss)(?:\.|\b){_S}*(?P<x>{EN})(?=\s*(?:,|;|at\s+bedside|hold|waiting|consented|notified|RN|MD|requested|called|/|\)|\(|<|\.\s|\n|$))", need="dr|prof|mr|ms|miss"),
    _rule("name", 0.8, rf"\b(?:Dr|Prof|Mr|Mrs|Ms|Miss)(?:\.|\b){_S}*(?P<x>{EN_CAP})", regex.V1, need="dr|prof|mr|ms|miss"),
    _rule("name", 0.85, rf"\b(?:mother|father|mom|dad|parents?|guardian|grandmother|grandfather|aunt|uncle|sister|brother|caregiver)\s*\((?P<x>{EN})\)", need="mother|father|mom|dad|parent|guardian|aunt|uncle|sister|brother|caregiver"),
    _rule("name", 0.85, rf"\b(?:mother|father|mom|dad|parents?|guardian|grandmother|grandfather|aunt|uncle)\s*[\(,]?\s*(?P<x>{KO})(?=[)\s])", need="mother|father|mom|dad|parent|guardian|aunt|uncle"),
    _rule("name", 0.85, rf"\b(?:fellow|nurse|resident|attending|anesthesiologist|surgeon|RN)\s+(?P<x>{EN})(?=\s*(?:<|\(|,|notified|aware))", need="fellow|nurse|resident|attending|anesthesiologist|surgeon|rn"),
    _rule("name", 0.85, rf"\b(?:verified|checked|signed|recorded|seen|done|reviewed|confirmed)\s+by\s+(?P<x>{EN})(?=\s*[,;]\s*(?:RN|MD|CRNA|nurse))", need="by "),
    _rule("name", 0.85, rf"\b(?:Pt\.?|patient|child'?s?|pt's)\s*name\s*[:：]?\s*(?P<x>{EITHER})(?=\s*(?:[,;./()\n]|$|{_S}))", need="name"),
    _rule("name", 0.8, rf"\bpatient\s+(?P<x>{EN})(?=\s+(?:[a-z]+ed|is|was|has)\b)", need="patient"),
    _rule("name", 0.7, rf"(?<=거주하는\s)(?P<x>{KO})(?=\s*(?:님|씨))", need="거주하는"),
)

_NEAR = 24
_IDS, _PHONES, _THINGS, _TITLES = (regex.compile(p, _F) for p in (ID_WORDS, PHONE_WORDS, THING_WORDS, TITLE_WORDS))
_EPONYMS = frozenset(EPONYM_WORDS.split("|"))
_EPONYM = regex.compile(rf"(?:['’]s)?[\s\-]+(?:{EPONYM_WORDS})(?![A-Za-z])", _F)
_LONG = regex.compile(r"\d{3}(?:[\s.\-–‑·]|-\n){0,2}\d{4}")  # in every number of the rules that ask for it
_NUMBER13 = regex.compile(r"\d{6}\s?[\-–‑]?\s?\d{7}")
_HOUSE = regex.compile(r"[로길동리가]\s+(?:산\s?)?\d")
_BLANKS = {k: " " for k in range(0x3001) if chr(k).isspace()}
_ODD_BLANK = regex.compile(r"[\s--[ \n\t]]", regex.V1)
_AFTER_ML = regex.compile(r"\s*(?:mL|cc)\b", _F)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def resident_check(digits: str) -> bool:
    weights = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
    rest = sum(w * int(d) for w, d in zip(weights, digits)) % 11
    return (11 - rest) % 10 == int(digits[12]) or (13 - rest) % 10 == int(digits[12])


def _score(rule: Rule, text: str, lo: int, hi: int) -> float:
    """The score of a proposal, from its pattern, its validators and the words before and after it on its line."""
    score, value = rule.score, text[lo:hi]
    if rule.kind in ("phone", "id_number"):
        digits = "".join(c for c in value if c.isdigit())
        before = text[max(0, lo - _NEAR) : lo].rpartition("\n")[2]
        # of the words before it the nearest says what the number is
        said = [(m.end(), w) for p, w in ((_IDS, "id"), (_PHONES, "phone"), (_THINGS, "thing")) for m in p.finditer(before)]
        nearest = max(said)[1] if said else ""
        if nearest == "thing":
            score -= 0.5
        elif nearest == ("id" if rule.kind == "id_number" else "phone"):
            score += 0.15
        if _AFTER_ML.match(text, hi):
            score -= 0.5
        if rule.kind == "id_number":
            if len(digits) == 13 and resident_check(digits):
                score += 0.15
            if len(digits) == 16 and luhn(digits):
                score += 0.3
            plain = "".join(value.split())
            if plain[:2].isalpha() and plain.isascii() and plain.isalnum() and len(plain) >= 15 and mod97(plain.upper()):
                score += 0.4
    elif rule.kind == "name":
        words = value.split()
        if value in NOT_NAMES or "".join(words) in NOT_NAMES or any(w in NOT_NAMES for w in words):
            score -= 0.6
        if value.isascii() and any(w.lower() in NOT_ENGLISH for w in words):
            score -= 0.6
        if _EPONYM.match(text, hi) or len(words) > 1 and words[-1].lower() in _EPONYMS:
            score -= 0.5
        elif score < 0.85 and _TITLES.search(text, max(0, lo - _NEAR), min(len(text), hi + _NEAR)):
            score += 0.1
    return score


def spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the personal data in text, from the left, in places of the text as it is."""
    if not text:
        return []
    plain, begin, end = folded(text)
    numbers = _LONG.search(plain) is not None
    low = plain.casefold().replace("\n", " ").replace("\t", " ")
    if _ODD_BLANK.search(low):
        low = low.translate(_BLANKS)
    low += "NUMBER13" * (numbers and bool(_NUMBER13.search(plain))) + "HOUSE" * bool(_HOUSE.search(plain))
    found = []
    for rule in RULES:
        if rule.number and not numbers or rule.need and not any(word in low for word in rule.need):
            continue
        for m in rule.pattern.finditer(plain, overlapped=rule.kind == "name"):
            lo, hi = m.span("x") if "x" in rule.pattern.groupindex else m.span()
            score = _score(rule, plain, lo, hi)
            if hi > lo and score >= threshold:
                found.append((lo, hi, rule.kind, score))
    order = {k: i for i, k in enumerate(KINDS)}
    taken: list[tuple[int, int, str, float]] = []
    for lo, hi, kind, score in sorted(found, key=lambda s: (order[s[2]], -s[3], s[0] - s[1])):
        if all(hi <= a or lo >= b for a, b, _, _ in taken):
            taken.append((lo, hi, kind, score))
    taken.sort()
    return [(begin[lo] if begin else lo, end[hi - 1] if end else hi, kind, score) for lo, hi, kind, score in taken]


def redact(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with each span replaced by its kind in brackets, and everything else as it was."""
    if not text:
        return text
    out, at = [], 0
    for lo, hi, kind, _ in spans(text, threshold):
        out += [text[at:lo], f"[{kind.upper()}]"]
        at = hi
    return "".join([*out, text[at:]])


def find_personal(df: DataFrame, id_col: str, fields: tuple[str, ...], threshold: float = THRESHOLD) -> DataFrame:
    """id_col, fld, kind, seq, start, stop, score: each occurrence of personal data in the fields of df.

    seq counts the occurrences of a kind in a field from the left, from 1; start and stop count code points. Null, empty
    and blank texts have none. Texts are read whole, whatever their length. Repeated rows give their rows again. Extra
    columns are ignored; an empty table gives no rows.
    """
    rows = spread(df.select(df[id_col].alias("_id"), *[df[f] for f in fields]))
    kind = rows.schema[0].dataType.simpleString()
    names = [id_col, "fld", "kind", "seq", "start", "stop", "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                for fld, text in zip(fields, row[1:]):
                    seq: dict[str, int] = {}
                    for lo, hi, what, score in spans(text, threshold):
                        seq[what] = seq.get(what, 0) + 1
                        out.append((row[0], fld, what, seq[what], lo, hi, score))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, f"`{id_col}` {kind}, fld string, kind string, seq int, start int, stop int, score double")


def redacted(df: DataFrame, id_col: str, fields: tuple[str, ...], threshold: float = THRESHOLD) -> DataFrame:
    """id_col and the fields of df, with personal data replaced by typed placeholders; nulls stay null."""
    rows = spread(df.select(df[id_col].alias("_id"), *[df[f] for f in fields]))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch.columns = [id_col, *fields]
            for f in fields:
                batch[f] = [redact(t, threshold) for t in batch[f]]
            yield batch

    return rows.mapInPandas(run, ", ".join([f"`{id_col}` {kind}", *[f"`{f}` string" for f in fields]]))
