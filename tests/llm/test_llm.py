"""Operators on text against brute force, exact round trips and odd input."""

import random

import pytest
from pyspark.sql import functions as F

bpe = pytest.importorskip("halyard.llm.bpe")
from halyard.llm import defects, folding, mixing, overlap, pii, splitting  # noqa: E402

DIR = "/root/testdata/sf0.001"
WORDS = "환자 상태 안정 BP 120/80 수액 투여함 HR 98 bpm\n체온 36.5℃ 유지 — 출혈 없음 😀 é naïve  \t <|endoftext|>".split(" ")


def test_bpe_equals_a_public_library():
    tiktoken = pytest.importorskip("tiktoken")
    b = bpe.Bpe()
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    rng = random.Random(1)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(60))) for _ in range(200)] + ["", " ", "\n\n", "가" * 5000, "ab" * 4000, "x" * 9000 + "가", "​\u0000﻿"]
    assert all(b.encode(t) == enc.encode_ordinary(t) and b.count(t) == len(b.encode(t)) for t in texts)


def test_encode_has_a_row_for_each_document(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " ", "c"), (3, " ", "c"), (4, "혈압 120", "d")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode(df).collect())
    assert got[:4] == [(1, []), (2, []), (3, [220]), (3, [220])] and len(got[4][1]) > 3
    assert bpe.encode(df.limit(0)).count() == 0


def test_pieces_keep_limit_order_and_text():
    s = splitting.Splitter(bpe.Bpe())
    rng = random.Random(2)
    for k in range(150):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", ". ", "\n", "\n\n", "", "\n# "]) for _ in range(rng.randrange(1, 300)))
        limit, both = rng.choice([(8, 2), (32, 8), (64, 0), (128, 32)])
        pieces = s.split(text, limit, both)
        assert "".join(text[a + n : b] for a, b, n, _, _ in pieces) == text
        assert all(s.bpe.count(text[a:b]) == tokens <= limit for a, b, _, _, tokens in pieces)
        assert all(s.bpe.count(text[a : a + n]) <= both for a, b, n, _, _ in pieces) and all(p[1] == q[0] + q[2] for p, q in zip(pieces, pieces[1:]))
    assert s.split("가" * 4000, 64, 8)[0][3] == "character"


def test_parts_are_counted_as_they_are_by_themselves():
    b = bpe.Bpe()
    rng = random.Random(12)
    parts = [*WORDS, " ", "  ", "\n", "\n\n", "\t ", "'s", "'re", "it's", "　", "\u00a0 ", "가나다", "12.5", "…", "\r\n"]
    for _ in range(150):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 60)))
        words = b.words.findall(text)
        t = splitting._Counted(b, text, words, [len(b.word(w)) for w in words])
        for _ in range(60):
            lo = rng.randrange(len(text) + 1)
            hi = rng.randrange(lo, len(text) + 1)
            assert t.count(lo, hi) == b.count(text[lo:hi]), (text, lo, hi)


def test_split_defines_nulls_and_unlimited_sources(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "word " * 50, None), (4, "word " * 50, "a"), (5, "word " * 50, "zz")], "doc_id long, text string, source string")
    limits = spark.createDataFrame([("a", 16, 4), ("a", 32, 4), (None, 5, 1)], "source string, max_tokens int, overlap_tokens int")
    rows = splitting.split_oversized(docs, limits).collect()
    n = {}
    for r in rows:
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert n[1] == n[2] == n[3] == n[5] == 1 and n[4] > 3
    assert splitting.split_oversized(docs.limit(0), limits).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(3)
    x = [float(rng.randrange(1, 500)) for _ in range(2000)]
    pi = [rng.random() for _ in x]
    tokens, docs = sum(a * b for a, b in zip(x, pi)), sum(pi)
    mixing.fly(x, pi, rng)
    assert sum(0 < p < 1 for p in pi) <= 2
    assert abs(sum(a * b for a, b in zip(x, pi)) - tokens) < 1e-3 and abs(sum(pi) - docs) < 1e-6
    mixing.land(x, pi)
    assert set(pi) <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(x, pi)) - tokens) < 500


def test_landing_comes_close_even_beside_a_very_long_document():
    import pandas as pd

    rng = random.Random(4)
    for n in (3, 30, 400):
        g = pd.DataFrame({"doc_id": range(n), "source": "a", "n_tokens": [*(rng.randrange(20, 900) for _ in range(n - 1)), 17_000], "base": 0, "pi": [rng.random() for _ in range(n)]})
        want = float((g.n_tokens * g.pi).sum())
        out = mixing._flight(1, True)(("a", 0), g)
        assert set(out.pi) <= {0.0, 1.0} and (n < 30 or abs(float((out.n_tokens * out.pi).sum()) - want) <= 2), n


@pytest.mark.parametrize("block", [20_000, 50])
def test_mix_reaches_what_is_in_reach(spark, block):
    docs = spark.createDataFrame([(k, "단어 " * (1 + k % 9), "ab"[k % 4 == 0]) for k in range(600)] + [(9000, None, "a"), (9001, "x", None), (9002, "x", "other")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.5, 4), ("gone", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeat int")
    chosen, shares = mixing.mix(docs, targets, block=block)
    got = {r["source"]: r for r in shares.collect()}
    assert not got["gone"]["in_reach"] and got["gone"]["mix_tokens"] == 0
    assert all(abs(got[s]["mix_tokens"] / got[s]["wanted_tokens"] - 1) < 0.002 and got[s]["in_reach"] for s in "ab")
    rows = chosen.collect()
    assert max(r["copies"] for r in rows if r["source"] == "b") <= 4 and max(r["copies"] for r in rows if r["source"] == "a") == 1
    assert len({r["doc_id"] for r in rows}) == len(rows) and not {9000, 9001, 9002} & {r["doc_id"] for r in rows}


TEXT = "환아 권 갈별 보호자 동반\nMRN 2942-8532 와 대조함\n보호자 송별벼리 (010-0975-6525) 동의 얻음\n검체번호 5627-5821 재채혈\n239-147-142 mL 순으로 수액 교체\nRemifentanil @ 0.7 mcg/kg/min 유지\ne-mail kim_kid10 [at] mail [dot] example [dot] com\n주소: 해무시 솔빛구 느티나무길 133, 109동 701호\nETT lot 201031-3012095 사용\n주민번호 ２００２０９－８１９６５４２ 확인\nDr. on call 호출 후 대기\nper Dr fenwick vardoun, hold extubation\nreachable on 010-0583-\n8187 all day"


def test_personal_data_and_look_alikes():
    found = {}
    for lo, hi, kind, _ in pii.spans(TEXT):
        found.setdefault(kind, []).append(TEXT[lo:hi])
    assert found == {
        "name": ["권 갈별", "송별벼리", "fenwick vardoun"], "id_number": ["2942-8532", "２００２０９－８１９６５４２"], "phone": ["010-0975-6525", "010-0583-\n8187"],
        "email": ["kim_kid10 [at] mail [dot] example [dot] com"], "address": ["해무시 솔빛구 느티나무길 133, 109동 701호"],
    }
    clean = pii.redact(TEXT)
    assert "[NAME] 보호자 동반" in clean and "검체번호 5627-5821 재채혈" in clean and clean.count("\n") == TEXT.count("\n") - 1
    assert pii.luhn("4539578763621486") and pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


@pytest.mark.parametrize("text,kind,value", [
    ("경기도 성남시 분당구 정자동 178-1", "address", "경기도 성남시 분당구 정자동 178-1"),
    ("서울시 중구 을지로2가 12-3", "address", "서울시 중구 을지로2가 12-3"),
    ("강원도 춘천시 소양로\t45", "address", "강원도 춘천시 소양로\t45"),
    ("주치의 장마루늘 인수함", "name", "장마루늘"),
    ("인턴 장마루늘 인수함", "name", "장마루늘"),
    ("마취의 장마루늘 인수함", "name", "장마루늘"),
    ("+82-2-5123-4567", "phone", "+82-2-5123-4567"),
    ("kim { at } mail.example.com", "email", "kim { at } mail.example.com"),
    ("kim [\tat\t] mail.example.com", "email", "kim [\tat\t] mail.example.com"),
])
def test_personal_data_alone_in_a_text(text, kind, value):
    assert [(k, text[lo:hi]) for lo, hi, k, _ in pii.spans(text)] == [(kind, value)]


@pytest.mark.parametrize("text", ["Dr. Fallot tetralogy, corrected", "Prof. Glasgow score, 15", "환자명: 고은별 증후군 의심"])
def test_words_after_a_name_make_it_none(text):
    assert not [k for _, _, k, _ in pii.spans(text) if k == "name"]


def test_no_rule_is_skipped_where_its_pattern_matches(monkeypatch):
    rng = random.Random(8)
    parts = ["경기도 성남시 ", "정자동 178-1", "주치의\n장마루늘\t인수함", "verified by\tkim vardoun, RN", "+82-31-5123-4567", "kim <\tat > mail.example.com", "장마루늘 군\n", "MIẞ vardoun, ", "보호자 ", TEXT[:200]]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(300)]
    got = [pii.spans(t) for t in texts]
    monkeypatch.setattr(pii, "RULES", tuple(pii.Rule(r.kind, r.pattern, r.score) for r in pii.RULES))
    assert got == [pii.spans(t) for t in texts]


def test_personal_data_defines_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, None, ""), (2, "성명: 장마루늘, 성명: 장마루늘", "x" * 100_000), (2, "성명: 장마루늘, 성명: 장마루늘", None)], "rec_id long, emr string, handoff string")
    assert sorted((r["rec_id"], r["fld"], r["kind"], r["seq"]) for r in pii.find_personal(df, "rec_id", ("emr", "handoff")).collect()) == [(2, "emr", "name", 1)] * 2 + [(2, "emr", "name", 2)] * 2
    assert pii.redacted(df, "rec_id", ("emr", "handoff")).where("emr is null").count() == 1


def test_folding_maps_places_back():
    text = "ＨＲ 각​말"
    plain, begin, end = folding.folded(text)
    assert plain == "HR 각말" and text[begin[3] : end[3]] == "각" and text[begin[4] : end[4]] == "말"


def test_index_counts_equal_brute_force():
    rng = random.Random(4)
    texts = ["".join(rng.choice("가나다라") for _ in range(rng.randrange(1, 200))) for _ in range(40)]
    index = overlap.Index(*overlap.Index.build([overlap.symbols(t) for t in texts]))
    import numpy as np

    for _ in range(200):
        p = "".join(rng.choice("가나다라") for _ in range(rng.randrange(1, 20)))
        lo, hi = index.search(overlap.symbols(p), np.array([len(p)]), np.array([len(p)]))
        want = [k for k, t in enumerate(texts) for i in range(len(t)) if t.startswith(p, i)]
        assert sorted(index.owner[lo[0] : hi[0]].tolist()) == want


def test_cross_split_equals_brute_force(spark):
    rng = random.Random(5)
    lines = [f"{rng.choice(WORDS)} {rng.randrange(10**6)} 항목 {rng.choice(WORDS)} 수치 {rng.randrange(10**5)} 확인함" for _ in range(400)]
    rows = [(k, 1000 + k, rng.choice(["sft", "sft", "dev", "gold", "fewshot"]), "\n".join(rng.sample(lines, 14))) for k in range(80)]
    for k in range(80, 140):
        _, _, _, text = rng.choice(rows[:80])
        part = text.split("\n")
        rng.shuffle(part)
        keep = part[: rng.choice([14, 13, 12, 9])]
        rows.append((k, 1000 + k, rng.choice(["sft", "dev", "gold"]), rng.choice([str.upper, str, lambda t: t.replace(" ", "  ")])("\n".join(keep))))
    rows += [(200, 1000, "dev", None), (201, -1, "sft", ""), (202, -1, "dev", " "), (203, None, "gold", "--"), (204, 77, None, "x")]
    df = spark.createDataFrame(rows, "rec_id long, sid long, split string, emr string").withColumn("train_id", F.lit("clash"))
    got = {(r["train_id"], r["eval_id"]) for r in overlap.cross_split(df).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[2] == "sft" and b[2] in ("dev", "gold"):
                la, lb = overlap.letters(a[3]), overlap.letters(b[3])
                if (a[1] == b[1] and a[1] not in (None, -1)) or (la and lb and overlap.near_same(la, lb, 0.8)):
                    want.add((a[0], b[0]))
    assert got == want and len(want) > 10
    assert overlap.cross_split(df.limit(0)).count() == 0
    pairs = overlap.cross_split(df).collect()
    for r in overlap.link_counts(df).collect():
        mine = [p for p in pairs if p["eval_id" if r["ev"] else "train_id"] == r["rec_id"]]
        assert (r["near_links"], r["sid_links"]) == (sum(p["near_emr"] for p in mine), sum(p["same_sid"] for p in mine)), r
    assert overlap.link_counts(df.limit(0)).count() == 0


def test_cross_split_finds_small_edits_all_over(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("가나다라마바사아자차카타파하abcdefghij0123456789") for _ in range(n))
    texts = ["\n".join(f"{rng.randrange(24):02}:{rng.randrange(60):02} 활력징후 {word(rng.choice([7, 14, 25]))}" for _ in range(30)) for _ in range(12)]
    every = lambda t, n: "".join("z" if c.isalnum() and sum(map(str.isalnum, t[: i + 1])) % n == 0 else c for i, c in enumerate(t))
    shifted = lambda t: "\n".join(f"{rng.randrange(24):02}:{rng.randrange(60):02} {line[6:]}" for line in reversed(t.split("\n")))
    edits = [lambda t: every(t, 15), lambda t: every(t, 9), shifted, lambda t: t[: int(len(t) * 0.83)], lambda t: every(t[:30], 10)]
    rows = [(k, -1, "sft", t[:30] if k % 5 == 4 else t) for k, t in enumerate(texts)] + [(100 + k, -1, "dev", edits[k % 5](t)) for k, t in enumerate(texts)]
    got = {(r["train_id"], r["eval_id"]) for r in overlap.cross_split(spark.createDataFrame(rows, "rec_id long, sid long, split string, emr string")).collect()}
    alike = lambda a, b: overlap.near_same(overlap.letters(a[3]), overlap.letters(b[3]), 0.8)
    assert got == {(a[0], b[0]) for a in rows[:12] for b in rows[12:] if alike(a, b)}
    assert {(k, 100 + k) for k in range(12) if k % 5 in (0, 1, 3)} <= got


@pytest.mark.parametrize("hits", [2_000_000, 60])
def test_candidates_lose_no_near_same_text(monkeypatch, hits):
    monkeypatch.setattr(overlap, "HITS", hits, raising=False)
    rng = random.Random(7)
    texts = ["".join(rng.choice("가나다라마") for _ in range(rng.choice([1, 3, 9, 20, 33, 39, 41, 90, 300]))) for _ in range(60)]
    partners = []
    for t in texts:
        x = list(t)
        for i in rng.sample(range(len(x)), int(len(x) * rng.choice([0, 0.02, 0.05, 0.1]))):
            x[i] = rng.choice(["", "나", "하하"])
        cut = rng.randrange(len(x))
        partners.append("".join(x[cut:] + x[:cut]) or "가")
    index = overlap.Index(*overlap.Index.build([overlap.symbols(t) for t in partners]))
    got = set(overlap.candidates(index, texts))
    want = {(a, b) for a, x in enumerate(texts) for b, y in enumerate(partners) if overlap.near_same(x, y, 0.8)}
    assert want <= got and len(want) > 30


@pytest.mark.parametrize("seed", [8, 9])
def test_runs_located_by_one_shard_lose_no_text_of_another(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("가나다라마") for _ in range(rng.choice([1, 3, 9, 39, 90, 300]))) for _ in range(60)]
    partners = ["".join(rng.choice([c] * 30 + ["", "나"]) for c in t) or "가" for t in texts]
    shards = [overlap.Index(*overlap.Index.build([overlap.symbols(t) for t in part])) for part in (partners[:30], partners[30:])]
    located = overlap.Runs(shards[0], texts, 0.8)
    got = {(a, b + 30 * k) for k, index in enumerate(shards) for a, b in overlap.candidates(index, texts, 0.8, located)}
    want = {(a, b) for a, x in enumerate(texts) for b, y in enumerate(partners) if overlap.near_same(x, y, 0.8)}
    assert want <= got and len(want) > 30


def test_letters_of_many_texts_equal_those_of_each():
    texts = [None, "", " ", "ＨＲ 90㎎/㎏, Ⅳ형", "ß İ e\u0301 각 \u1100\u1161\u11a8", "①²½ a_b-c\u200b", "\U0001d54f\U00020000x"] + ["x", None, "가 나"] * 50
    assert overlap.letters_of(texts) == [overlap.letters(t) for t in texts]


def test_pairs_of_copies_are_neither_shuffled_nor_lost(spark):
    text = "마취 유도 후 혈압 저하 있어 수액 주입하고 경과 관찰함 "
    rows = [(k, k % 7 if k % 3 else -1, "sft" if k % 2 else "dev", f"{text * 2}{k % 4}") for k in range(40)] + [(50, 3, "sft", None), (51, 3, "gold", " ")]
    df = spark.createDataFrame(rows, "rec_id long, sid long, split string, emr string")
    alike = lambda a, b: bool(a and b) and overlap.near_same(overlap.letters(a), overlap.letters(b), 0.8)
    want = sorted((a[0], b[0], a[1] == b[1] != -1, alike(a[3], b[3])) for a in rows for b in rows if a[2] == "sft" != b[2] and (a[1] == b[1] != -1 or alike(a[3], b[3])))
    pairs = overlap.cross_split(df)
    assert sorted((r["train_id"], r["eval_id"], r["same_sid"], r["near_emr"]) for r in pairs.collect()) == want and len(want) > 300
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    # a record of two rows is still one record
    twice = overlap.cross_split(df.union(df.limit(5)).union(spark.createDataFrame([(1, 6, "sft", "다른 글")], df.schema)))
    assert sorted((r["train_id"], r["eval_id"]) for r in twice.collect()) == sorted({(a, b) for a, b, *_ in want} | {(1, b[0]) for b in rows if b[2] != "sft" and b[1] == 6})


PROMPT = "다음 EMR 을 요약하시오.\n\n### EMR\n►11:52 PEEP 7 → 9 cmH2O, FiO2 0.2\n►11:58 Urine 315 mL, 색 분홍빛\n►12:11 두드러기 관찰되어 Dexamethasone 1.2 mL 투여\n"


def test_defects_on_made_and_held_out_answers(spark):
    rows = [(r["prompt_text"], r["generated"]) for r in spark.read.parquet("/root/testdata/sf0.01/inference_records.parquet").where("generated is not null").select("prompt_text", "generated").collect()]
    model = defects.train(rows)
    say = lambda a: model.defect(PROMPT, a)[0]
    assert [say(a) for a in (None, "", " ​", "**", "N/A", "### OUTPUT", "1.", "답변:")] == ["empty"] * 8
    assert say("특이사항 없음") is None and say("특이 사항 없음.") is None
    assert say("인계문: 11:52 PEEP 7 → 9 cmH2O FiO2 0.2 11:58 Urine 315 mL 색 분홍빛") == "copy"
    assert say("The child has a history of asthma and takes inhaled steroids.") == "language"
    assert say("죄송하지만 의료 정보에 대한 요약은 제공해 드릴 수 없습니다.") == "refusal"
    assert say("기관삽관을 할 수 없어 성문상 기도기로 전환 후 안정됨.") is None
    assert say("체온 35.0도로 저체온 지속되어 상처 출혈 확인 중임. 실혈량 465mL로 적혈구 1단위를") == "truncated"
    assert say("체온 35.0도로 저체온 지속되어 상처 출혈 확인 중임.") is None
    empty = spark.createDataFrame([], "gen_id long, prompt_text string, generated string")
    assert defects.find_defects(empty).count() == 0


def _answers(spark):
    return [(r["prompt_text"] or "", r["generated"]) for r in spark.read.parquet("/root/testdata/sf0.01/inference_records.parquet").where("generated is not null").select("prompt_text", "generated").collect()]


@pytest.mark.parametrize("part", [0, 1])
def test_refusals_of_templates_that_were_not_taught_are_found(spark, part):
    rows = _answers(spark)
    model = defects.train(rows, part=part)
    rng = random.Random(9)
    other = [defects._refusal(rng, 1 - part) for _ in range(600)]
    found = sum(model.defect(PROMPT, a)[0] == "refusal" for a in other)
    reports = [how.format(what) for how in defects.NOT_DONE_HOW for what in ("척수마취", "위관 삽입", "요도 카테터 거치")]
    assert found >= 0.85 * len(other), found / len(other)
    assert sum(model.defect(PROMPT, f"{a} HR 98회로 안정됨.")[0] is None for a in reports) >= 0.9 * len(reports)


def test_no_taught_line_stands_in_the_tables(spark):
    said = "\n".join(a for _, a in _answers(spark))
    taught = [t.format(s) for t in defects.KO_DECLINE for s in defects.KO_SUBJECT] + [f"{c} {d} {s}" for c in defects.EN_CAN for d in defects.EN_DO for s in defects.EN_SUBJECT]
    taught += [*defects.EN_WHOLE, *defects.OTHER, *defects.FOREIGN, *filter(None, defects.KO_CLOSE + defects.EN_CLOSE)]
    assert not [t for t in taught if t in said]


def test_all_heads_decide_by_their_scores(spark):
    model = defects.train(_answers(spark))
    assert set(model.thresholds) == set(defects.DEFECTS)
    for answer, head in ((None, "empty"), ("N/A", "empty"), (PROMPT[30:150], "copy"), ("Der Patient ist wach und atmet ruhig.", "language")):
        assert model.defect(PROMPT, answer)[0] == head and model.scores(defects.look(PROMPT, answer))[head] >= model.thresholds[head]
