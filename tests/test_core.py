"""The reference's golden cases, the registry, and a sample of queries against DuckDB."""

import decimal
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from halyard.functions import hygiene as H
from halyard.functions.normalize import fixed
from halyard.operators import audits, prompts, roles, scoring, splits, statistics as S, timeline, vitals
from halyard.plans import record_queries

DIR = "/root/testdata/sf0.001"


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def test_registry_has_the_same_names_and_no_stray_oracle():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


def test_entry_runs(spark):
    assert entry.entry(spark).columns


@pytest.mark.parametrize("text,want", [("특이사항 없음", True), ("특이사항 없음.", True), ("  특이 사항 없음 ", True), ("특이사항 없음. 단 출혈", False), ("None significant except bleeding", False), ("", False), (None, False)])
def test_no_issue(spark, text, want):
    assert one(spark, text, H.no_issue) is want


@pytest.mark.parametrize("text,want", [("수액 유지 중인 환아", "ok"), ("--------\n정상 소견임", "ok"), ("체온 36.5℃ ‘안정’", "ok"), ("", "empty"), ("same1 same1 same1 same1", "repetition"), ("//thought: 확인", "leak"), ("가가가가가가가가가", "repetition")])
def test_status(spark, text, want):
    assert one(spark, text, lambda c: H.status(c, H.tokens(c))) == want


def test_think_block_is_removed(spark):
    assert one(spark, "<think>a\nb</think>\n결과임", H.without_thinking) == "결과임"
    assert one(spark, "결과임 <think>never closed", H.without_thinking) == "결과임"


def test_coverage_rules(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")], "case int, item string")
    verdicts = spark.createDataFrame([(1, "a", "yes", 0), (1, "b", "partial", 0), (2, "a", "yes", 0), (2, "z", "no", 0), (3, "a", "no", 0), (3, "a", "YES", 1)], "case int, item string, status string, ord int")
    got = {r["case"]: (r["coverage"], r["failed"]) for r in scoring.coverage(items, verdicts).collect()}
    assert got == {1: (0.75, False), 2: (None, True), 3: (1.0, False)}


def test_statistics():
    import numpy as np

    assert S.sign_flip(np.zeros(5)) == 1.0
    assert S.sign_flip(np.arange(1, 11) / 10) < 0.01
    lo, hi = S.bootstrap_ci(np.array([0.5, np.nan, 0.7]))
    assert lo <= 0.6 <= hi and S.bootstrap_ci(np.array([1.0])) == (None, None)
    one, counted = np.repeat([1.0, 2.0, 4.0], [3, 5, 2]), (np.array([1.0, 2.0, 4.0]), np.array([3, 5, 2]))
    assert np.allclose(S.bootstrap_ci(one, iters=40_000), S.bootstrap_ci(*counted, iters=40_000), atol=0.11)
    assert abs(S.sign_flip(np.array([0.1, 0.1, -0.2, 0.3])) - S.sign_flip(np.array([0.1, -0.2, 0.3]), np.array([2, 1, 1]))) < 0.02
    assert abs(S.t_critical(11) - 2.228139) < 1e-5 and S.sign_p(8, 2) == pytest.approx(0.109375) and S.sign_p(0, 0) is None
    assert S.wilcoxon_p(10, 8, 0, -1.98) == pytest.approx(0.048828125)
    assert abs(S.t_p_value(2.228139, 10) - 0.05) < 1e-5 and S.t_p_value(0.0, 5) == 1.0


def test_disjointness_is_enforced(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "sid long"), spark.createDataFrame([(3,), (None,)], "sid long")
    splits.assert_disjoint(a, b, "sid", "gold and sft")
    with pytest.raises(ValueError):
        splits.assert_disjoint(a, a, "sid", "gold and sft")


SERIES = "sid long, item string, us long, v double, row_id long, lo double, hi double, age double"
MIN = 60_000_000


def series(spark, item, values, age):
    return spark.createDataFrame([(1, item, k * 5 * MIN, float(v), k, None, None, age) for k, v in enumerate(values) if v is not None], SERIES)


def verdicts(spark, item, values, age, touched=None):
    ev = vitals.classify(vitals.events(vitals.mark(series(spark, item, values, age))), touched)
    return {(r["kind"], r["tier2"]): tuple(r["reasons"]) for r in ev.collect()}


def test_runs_go_over_the_borders_of_spans(spark):
    values = [95] * 6 + [58, 55, 57, 140, 62, 60, 61, 59] + [95] * 5 + [50] * 9
    rows = [(1, "SBP", 20_000_000 * MIN + k * 700 * MIN, float(v), k, None, None, 5.0) for k, v in enumerate(values)] + [(2, "SBP", 5, 50.0, 99, None, None, 5.0)]
    whole = spark.createDataFrame(rows, SERIES)
    of = lambda days, f: sorted(map(str, f(vitals.mark(whole, days)).collect()))
    for f in (vitals.episodes, vitals.events, vitals.steps, vitals.baselines):
        assert of(1, f) == of(3, f) == of(10_000, f)
    assert len(vitals.episodes(vitals.mark(whole, 1)).where("kind = 'hypotension' and sid = 1").collect()) == 3


def test_rows_without_a_number_move_the_hand_off(spark):
    rows = [(1, "HR", k * 5 * MIN, 90.0 if k < 10 else None, k, 1.0, 300.0, 5.0) for k in range(20)] + [(1, None, 100 * MIN, None, 30, None, None, 5.0), (2, "HR", None, 80.0, 31, 1.0, 300.0, 5.0)]
    got = {r["sid"]: r["handoff_us"] for r in vitals.handoffs(vitals.mark(spark.createDataFrame(rows, SERIES))).collect()}
    assert got == {1: 85 * MIN, 2: None}


def test_fixed_rounds_as_c_does(spark):
    import random

    rng = random.Random(1)
    xs = [0.5, 1.5, 2.5, 36.25, 36.45, 36.35, 0.05, 0.15, -0.3, -36.45, 99.95, 59.5, 16.955, 1.005, 0.285, 1e6 + 0.25, 0.0] + [rng.randrange(100_000) / 20 for _ in range(300)] + [rng.uniform(-500, 500) for _ in range(100)]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").select("x", fixed(F.col("x")).alias("a"), fixed(F.col("x"), 1).alias("b"), fixed(F.col("x"), 2).alias("c")).collect()
    assert [(r["a"], r["b"], r["c"]) for r in got] == [(f"{r['x']:.0f}", f"{r['x']:.1f}", f"{r['x']:.2f}") for r in got]


def test_summary_of_a_planned_and_a_bleeding_case(spark):
    t1 = [36.4] * 4 + [30, 24, 20.1, 20.3, 24, 30] + [36.2] * 14
    rows = [(4, "T1", k * 5 * MIN, float(v), k, 14.0, 45.0, 0.5) for k, v in enumerate(t1)] + [(5, "EBL", k * 30 * MIN, 200.0 * k, 100 + k, 0.0, None, 5.0) for k in range(4)] + [(5, "UO", k * 60 * MIN, 5.0 * k, 110 + k, 0.0, None, 5.0) for k in range(3)]
    m = vitals.mark(spark.createDataFrame(rows, SERIES))
    cases = spark.createDataFrame([(4, 0.5, None), (5, 5.0, 10.0)], "sid long, age double, weight double")
    given = timeline.interventions(timeline.parse(spark.createDataFrame([(4, "▶01:50 Epinephrine")], "sid long, record string"))).select("sid", "minute", "category")
    planned = spark.createDataFrame([(4,)], "sid long")
    audit = vitals.audit(m, cases, given, planned, timeline.matches)
    got = {r["sid"]: r["summary"] for r in vitals.summaries(m, audit, vitals.planned_lines(m, planned), vitals.handoff_lines(m, given), cases).collect()}
    assert got[4] == "(연령군: 영아(28일–1세))\n### VITAL — REPORTABLE\n- 계획된 저체온(체외순환): 최저 20.1°C, 종료 시 36.2°C\n### VITAL — AT HANDOFF (last 15 min)\n- T1 36.2°C — 종료 15분 내 처치: 승압제 01:50"
    assert got[5] == "(연령군: 학령전(3–5세))\n### VITAL — REPORTABLE\n- 실혈 600 mL (EBV의 82%) — 대량 실혈(>50% EBV)\n- 소변량 10 mL (0.5 mL/kg/hr)".replace("\n- 소변량 10 mL (0.5 mL/kg/hr)", "")


def test_vital_rules(spark):
    low = [95] * 6 + [58, 55, 57, 60, 62] + [95] * 13
    low[20] = 140
    assert "R2" in verdicts(spark, "SBP", low, 5.0)["hypotension", False]
    assert verdicts(spark, "SBP", low, 5.0)["hypertension", True] == ()
    once = [95] * 24
    once[10] = 60
    assert verdicts(spark, "SBP", once, 5.0).get(("hypotension", False), ()) == ()
    assert verdicts(spark, "SpO2", [75, 76, 74, 75, 76] + [75] * 19, 1.0)["desaturation", False] == ()
    assert verdicts(spark, "SpO2", [75] * 6 + [68, 67, 68] + [75] * 15, 1.0)["desaturation", False] != ()
    deep = [99] * 24
    deep[12] = 78
    assert "R4" in verdicts(spark, "SpO2", deep, 5.0)["desaturation", False]


def test_interventions_match_around_midnight(spark):
    text = "►09:00 warming\n►09:35 Ephedrine 5 mg\n►23:58 Atropine\n►25:10 dopamine\n"
    given = timeline.interventions(timeline.parse(spark.createDataFrame([(1, text), (1, None)], "sid long, record string")))
    assert {(r["minute"], r["category"]) for r in given.collect()} == {(575, "vasopressor"), (1438, "anticholinergic")}
    ep = spark.createDataFrame([(1, "HR", "bradycardia", False, 1443 * MIN, 1500 * MIN), (1, "SBP", "hypotension", False, 400 * MIN, 570 * MIN), (1, "T1", "fever", False, 575 * MIN, 575 * MIN)], "sid long, item string, kind string, tier2 boolean, from_us long, to_us long")
    assert {(r["item"], r["category"]) for r in timeline.matches(ep, given).collect()} == {("HR", "anticholinergic"), ("SBP", "vasopressor")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    cols = sorted(got.columns)
    rel = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    text = lambda x: f"{float(x):.6g}" if isinstance(x, (float, decimal.Decimal)) else str(x)
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(text(r[c]) for c in cols) for r in got.collect()) == want


def test_few_shots_come_from_the_whole_bank(spark):
    rows = spark.range(4000).select(F.col("id").alias("rec_id"))
    for n in (0, 1, 2, 3, 300):
        bank = spark.range(1000, 1000 + n).select(F.col("id").alias("shot"))
        got = {}
        for r in splits.draw(rows, bank, "rec_id", "shot", 2).collect():
            got.setdefault(r["rec_id"], {})[r["k"]] = r["shot"]
        take = min(n, 2)
        assert len(got) == (4000 if n else 0)
        assert all(sorted(x) == list(range(1, take + 1)) and len(set(x.values())) == take for x in got.values())
        for k in range(1, take + 1):
            assert {x[k] for x in got.values()} == set(range(1000, 1000 + n))


def test_few_shot_query_reaches_every_record_of_the_bank(spark, tmp_path):
    bank = [(k, k, "fewshot") for k in range(200)] + [(k, -1, "fewshot") for k in range(200, 220)] + [(1000 + k, k, "dev") for k in range(3000)]
    spark.createDataFrame(bank, "rec_id long, sid long, split string").write.parquet(str(tmp_path / "fewshot_bank.parquet"))
    got = record_queries.fewshot_topk(spark, str(tmp_path)).collect()
    assert len(got) == 6000 and {r["shot"] for r in got} == set(range(200))
    assert sorted(map(tuple, got)) == sorted(map(tuple, record_queries.fewshot_topk(spark, str(tmp_path)).collect()))


def test_bootstrap_query_draws_as_often_as_the_defaults(spark):
    p = [r["p"] for r in entry.queries()["bootstrap_permutation"](spark, "/root/testdata/sf0.01").collect()]
    steps = [x * 20_001 for x in p]
    assert any(x < 1 for x in p) and all(abs(x - round(x)) < 1e-6 for x in steps)


def test_strata_add_up_to_what_is_taken(spark):
    for n, normal, take in ((22, 11, 5), (22, 1, 6), (9, 0, 4), (5, 5, 3), (0, 0, 3)):
        cases = spark.createDataFrame([(k, k < normal) for k in range(n)], "sid long, normal boolean")
        rows = splits.stratified(cases, "sid", "normal", take).collect()
        assert len(rows) == n and sum(r["picked"] for r in rows) == min(take, n)
        assert sum(r["picked"] and r["normal"] for r in rows) == min(round(take * normal / max(1, n)), normal)


def test_missing_keys_and_sealed_splits_are_errors(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "sid long"), spark.createDataFrame([(1,)], "sid long")
    assert splits.strict_join(b, a, "sid", "x").count() == 1
    for wrong in (lambda: splits.strict_join(a, b, "sid", "x"), lambda: splits.require_sids(spark.createDataFrame([(-1,)], "sid long"), "x"), lambda: splits.zip_by_position(a, b, "sid")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(PermissionError):
        splits.unsealed("gold", False)
    assert splits.unsealed("gold", True) == "gold" and splits.unsealed("dev", False) == "dev"
    got = splits.zip_by_position(a, a.select((-F.col("sid")).alias("sid")), "sid").orderBy("position").collect()
    assert [tuple(r) for r in got] == [(0, 1, -2), (1, 2, -1)]


def test_categories_of_today_and_before(spark):
    rows = [("Airway", "airway_management"), ("preop abnormal-test", "preop_abnormal_test"), ("uri", "other"), ("preop_test", "other"), (None, "other"), (" URI status ", "uri_status"), ("drug-effect", "comorbidity_medication")]
    got = spark.createDataFrame([(a,) for a, _ in rows], "c string").select(H.category(F.col("c")).alias("x")).collect()
    assert [r["x"] for r in got] == [b for _, b in rows]


@pytest.mark.parametrize("text,want", [(None, True), ("", True), ("특이사항 없음", True), ("특이사항 없음, 출혈 소량", True), ("특이사항 없음. " + "이후 출혈이 있어 수혈하였음. " * 3, False), ("출혈 있음", False), ("None", True)])
def test_no_issue_of_version_2(spark, text, want):
    assert one(spark, text, H.no_issue_v2) is want


def test_repeats_are_collapsed_for_display(spark):
    show = lambda t: one(spark, t, H.collapse_repeats)
    assert show("(34.5) (34.5) (34.5) (34.5) (34.5) end") == "(34.5)  …(×5회 반복 생략)end" and show("ok") == "ok" and show(None) is None
    assert show("abcabcabc") == "abcabcabc"


def test_older_summaries_with_hours_and_marks(spark):
    text = "(연령군: 영아)\nSBP: 안정, 이벤트: [유의]저혈압(<65): 5회 1.5시간(최장 <1분), 최저 28 | 서맥(<60): 1회 <1분, 최저 55\n[유의]QTc 연장 의심 [유의]핍뇨\n- 저체온(<35): 2회 12분, 최저 33\n이상 없음"
    rows = audits.legacy_events(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", "t").orderBy("line", "part").collect()
    assert [(r["category"], r["reportable"], r["n"], r["total_min"], r["longest_min"]) for r in rows] == [
        ("hypotension", True, 5, 90.0, 0.5), ("bradycardia", False, 1, 0.5, 0.5), ("qtc", True, None, None, None), ("oliguria", True, None, None, None), ("hypothermia", False, 2, 12.0, 12.0),
    ]


def test_levels_of_a_tree_with_a_loop(spark):
    nodes = spark.createDataFrame([("raw", None), ("a", "raw"), ("b", "a"), ("x", "y"), ("y", "x"), ("lost", "gone")], "name string, parent string")
    assert {r["name"]: r["level"] for r in roles.levels(nodes).collect()} == {"raw": 0, "a": 1, "b": 2, "x": None, "y": None, "lost": None}


def test_roles(spark):
    make = lambda rows: spark.createDataFrame(rows, "model string, role string, family string")
    fine = [("t", "teacher", "f1"), ("p", "pair_judge", "f2"), ("j", "judge", "f3"), ("m", "trained", "f3")]
    assert roles.assert_roles(make(fine)) == ["judge_family_trained: j"]
    with pytest.raises(ValueError, match="teacher_judges: t"):
        roles.assert_roles(make([*fine, ("t", "judge", "f1")]))


def test_budget_cuts_the_record_only(spark):
    words = "단어 " * 3000 + "끝"
    df = spark.createDataFrame([(1, words), (2, "짧은 기록"), (3, None)], "k int, emr string")
    render = lambda e: prompts.user_prompt(e, F.lit("VITAL"))
    got = {r["k"]: r["p"] for r in df.select("k", prompts.fit_words(F.col("emr"), 800, render).alias("p")).collect()}
    assert len(got[1].split()) == 800 and prompts.MARKER.strip() in got[1] and got[1].endswith("### OUTPUT\n") and "VITAL" in got[1] and "끝" in got[1] and prompts.MARKER.strip() not in got[2] and got[3]
    assert {r["p"] for r in df.where("k = 1").select(prompts.fit_words(F.col("emr"), 5, render).alias("p")).collect()} == {None}
    with pytest.raises(Exception, match="does not hold"):
        df.where("k = 1").select(prompts.fit_words(F.col("emr"), 5, render, strict=True)).collect()
    plain = lambda e: f"{prompts.INSTRUCTION}\n\n{prompts.HEADER_EMR}\n{e}\n\n{prompts.HEADER_OUTPUT}\n"
    count = lambda: (lambda t: len(t.split()))
    fitted = {r["k"]: r["prompt"] for r in prompts.fit(df, "k", "emr", 60, plain, count).collect()}
    same = {r["k"]: r["p"] for r in df.select("k", prompts.fit_words(F.col("emr"), 60, prompts.user_prompt).alias("p")).collect()}
    assert fitted == same


def test_masks_and_pads(spark):
    m = spark.createDataFrame([([1, 2, 3], [1, 2, 3, 4, 5]), ([1, 9], [1, 2, 3]), ([], [7]), ([1, 2], [1, 2])], "p array<int>, w array<int>")
    assert [r[0] for r in m.select(prompts.masked(F.col("p"), F.col("w"))).collect()] == [[-100, -100, -100, 4, 5], [-100, 2, 3], [7], [-100, -100]]
    assert [r[0] for r in m.select(prompts.pad_left(F.col("w"), 3, 0)).collect()] == [[3, 4, 5], [1, 2, 3], [0, 0, 7], [0, 1, 2]]
    assert one(spark, "가a", lambda c: prompts.byte_ids(c)) == [234, 176, 128, 97] and one(spark, "", lambda c: prompts.byte_ids(c)) == []
