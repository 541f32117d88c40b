"""Problems 4 and 5 against brute force, and their defined results for odd input."""

import datetime as dt
import random
from statistics import median

import pytest

from halyard.operators import gridfill, spikes
from halyard.operators.readings import readings

REF = "item string, plausible_lo double, plausible_hi double, min_jump double, grid_min int"
RAW = "row_id long, sid long, ts timestamp_ntz, item_raw string, value_raw string, extra string"
MIN = 60_000_000
ROWS = "sid long, item string, us long, v double, row_id long, lo double, hi double, min_jump double, grid_min int"


def test_readings_parse_items_numbers_and_nulls(spark):
    t = dt.datetime(2024, 1, 1)
    raw = [
        (1, 5, t, "ＨＲ ← x", "１２０", "a"), (2, 5, t, " h r <- HR", "'95", "a"), (3, 5, t, "HR", "12 cmH2O", "a"), (4, 5, t, "HR", "cmH2O", "a"), (5, 5, t, "HR", "0", "a"), (6, 5, t, "EBL", "0", "a"),
        (7, -1, t, "HR", "80", "a"), (8, None, t, "HR", "80", "a"), (9, 5, None, "HR", "80", "a"), (10, 5, t, None, "80", "a"), (11, 5, t, "HR", None, "a"), (12, 5, t, "XX", "80", "a"),
        (13, 5, t, "HR", "36,5", "a"), (14, 5, t, "HR", "1.000E+02", "a"), (15, 5, t, "HR", "-1", "a"), (16, 5, t, "HR", "NaN", "a"), (17, 5, t, "HR", "٩٥", "a"), (18, 5, t, "HR", "98↓", "a"), (19, 5, t, "HR", "x" * 50_000 + " 7", "a"),
    ]
    ref = spark.createDataFrame([("HR", 1.0, 300.0, 15.0, 5), ("EBL", 0.0, None, None, 60)], REF)
    got = {r["row_id"]: (r["item"], r["v"]) for r in readings(spark.createDataFrame(raw, RAW), ref).collect()}
    assert got == {1: ("HR", 120.0), 2: ("HR", 95.0), 3: ("HR", 12.0), 6: ("EBL", 0.0), 13: ("HR", 36.5), 14: ("HR", 100.0), 15: ("HR", -1.0), 17: ("HR", 95.0), 18: ("HR", 98.0), 19: ("HR", 7.0)}


def brute_gaps(rows):
    out = set()
    by = {}
    for sid, item, us, _, _, _, _, _, grid in rows:
        by.setdefault((sid, item, grid), []).append(us)
    for (sid, item, grid), times in by.items():
        times.sort()
        for a, b in zip(times, times[1:]):
            if b - a <= 360 * MIN:
                lo, hi = a // (grid * MIN) * grid, b // (grid * MIN) * grid
                out |= {(sid, item, s) for s in range(lo + grid, hi, grid)}
    return out


def random_rows(seed, n=600):
    rng = random.Random(seed)
    rows, us = [], {}
    for k in range(n):
        sid, item = rng.choice([(1, "HR"), (1, "T1"), (2, "HR")])
        us[sid, item] = us.get((sid, item), rng.randrange(-10**9, 10**15)) + rng.choice([30, 60, 300, 900, 21_600, 21_601, 80_000, 700_000]) * 1_000_000 * rng.choice([0, 1, 1, 1])
        rows.append((sid, item, us[sid, item], float(rng.choice([80, 80, 81, 82, 120, 400])), k, 1.0, 300.0, 15.0, 5))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_equal_brute_force(spark, seed):
    rows = random_rows(seed)
    got = gridfill.gaps(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute_gaps(rows)


def test_grid_states(spark):
    rows = [(1, "HR", m * MIN, v, k, 1.0, 300.0, 15.0, 5) for k, (m, v) in enumerate([(0, 10.0), (2, 20.0), (15, 45.0), (120, 5.0), (900, 1.0)])]
    bounds = spark.createDataFrame([(1, -10 * MIN, 915 * MIN), (1, None, 3), (2, 5, 1)], "sid long, lo_us long, hi_us long")
    got = {(r["slot_min"]): (r["value"], r["state"]) for r in gridfill.regular_grid(spark.createDataFrame(rows, ROWS), bounds=bounds).collect()}
    assert got[0] == (15.0, "observed") and got[5] == (25.0, "interpolated") and got[10] == (35.0, "interpolated")
    assert got[60] == (None, "missing") and 500 not in got and got[-10] == (None, "before") and got[915] == (None, "after")


def test_bounds_far_away_add_all_their_slots(spark):
    rows = [(1, "HR", m * MIN, 10.0, m, 1.0, 300.0, 15.0, 5) for m in (0, 5)]
    bounds = spark.createDataFrame([(1, -5 * 4000 * MIN, 5 * 3001 * MIN)], "sid long, lo_us long, hi_us long")
    got = gridfill.regular_grid(spark.createDataFrame(rows, ROWS), bounds=bounds).groupBy("state").count().collect()
    assert {r["state"]: r["count"] for r in got} == {"before": 4000, "observed": 2, "after": 3000}


def brute_kinds(rows):
    out = {}
    by = {}
    for sid, item, us, v, row_id, lo, hi, jump, _ in rows:
        if v < lo or v > hi:
            out[row_id] = "impossible"
        else:
            by.setdefault((sid, item), {}).setdefault((us, v), []).append(row_id)
    for found in by.values():
        keys = sorted(found)
        v = [k[1] for k in keys]
        chg = [abs(b - a) for a, b in zip(v, v[1:])]
        limit = max(15.0, 8 * median(chg)) if chg else None
        changing = 2 * sum(c > 0 for c in chg) > len(chg)
        for i in range(len(v)):
            a = b = i
            while a and v[a - 1] == v[i]:
                a -= 1
            while b + 1 < len(v) and v[b + 1] == v[i]:
                b += 1
            kind = "stuck" if b - a >= 9 and changing else None
            if not kind and limit:
                for n in (1, 2, 3):
                    for s in range(i - n + 1, i + 1):
                        e = s + n - 1
                        if s < 1 or e > len(v) - 2:
                            continue
                        before, after = median(v[max(0, s - 5) : s]), median(v[e + 1 : e + 6])
                        leave = all(y - max(before, after) >= limit or min(before, after) - y >= limit for y in v[s : e + 1])
                        if leave and abs(v[s - 1] - before) < limit and abs(v[e + 1] - after) < limit:
                            kind = "spike"
            if kind:
                out |= dict.fromkeys(found[keys[i]], kind)
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_kinds_equal_brute_force_across_spans(spark, seed):
    rng = random.Random(seed)
    rows, us, level = [], 0, 80.0
    for k in range(500):
        us += rng.choice([60, 600, 86_400, 3_000_000]) * 1_000_000
        v = level + rng.choice([-1, 0, 0, 1])
        rows.append((1, "HR", us, v, len(rows), 1.0, 300.0, 15.0, 5))
        if rng.random() < 0.06:
            for _ in range(rng.choice([1, 2, 3, 4])):
                us += 60_000_000
                rows.append((1, "HR", us, v + rng.choice([60.0, 62.0, -60.0]), len(rows), 1.0, 300.0, 15.0, 5))
        if rng.random() < 0.03:
            for _ in range(rng.choice([9, 12])):
                us += 60_000_000
                rows.append((1, "HR", us, 90.0, len(rows), 1.0, 300.0, 15.0, 5))
        if rng.random() < 0.1:
            rows.append((*rows[-1][:4], len(rows), *rows[-1][5:]))
        if rng.random() < 0.02:
            rows.append((1, "HR", us + 1_000_000, 999.0, len(rows), 1.0, 300.0, 15.0, 5))
    got = {r["row_id"]: r["kind"] for r in spikes.implausible(spark.createDataFrame(rows, ROWS)).collect()}
    want = brute_kinds(rows)
    assert {"spike", "stuck", "impossible"} <= set(want.values())
    assert got == want


def test_whole_runs_of_three_are_spikes_beside_noise(spark):
    """Each run meets the level test; the run's own readings widen the deviation around its first or last one."""
    cases = {
        "HR": [131, 150, 128, 147, 139, 200, 204, 208, 145, 127, 149, 130, 146],
        "IDBP1": [57, 70, 44, 69, 57, 100, 104, 107, 58, 45, 71, 46, 68],
    }
    rows = []
    for item, v in cases.items():
        for k, y in enumerate([v[0]] * 40 + v + [v[-1]] * 40):
            rows.append((1, item, k * MIN, float(y), len(rows), 1.0, 300.0, 40.0, 5))
    want = {r[4] for r in rows if (r[1] == "HR" and r[3] >= 200) or (r[1] == "IDBP1" and r[3] >= 100)}
    got = {r["row_id"]: r["kind"] for r in spikes.implausible(spark.createDataFrame(rows, ROWS)).collect()}
    assert len(want) == 6 and got == dict.fromkeys(want, "spike")


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert gridfill.gaps(none).count() == 0 and gridfill.regular_grid(none).count() == 0 and spikes.implausible(none).count() == 0


@pytest.mark.parametrize("size", [1, 5, 19, 64])
def test_marks_do_not_depend_on_the_batches(size):
    import pyarrow as pa

    rng = random.Random(size)
    rows = []
    for grp, n in ((1, 1), (2, 90), (3, 17), (4, 18), (5, 40), (6, 3)):
        v = 50.0
        for k in range(n):
            v += rng.choice([0, 0, 0, 1, -1])
            rows.append((grp, grp, "HR", 0, k, v + rng.choice([0, 0, 0, 0, 40, -40]), len(rows), 1, 15.0, None))
    names = ["grp", "sid", "item", "span", "us", "v", "row_id", "copies", "min_jump", "judged"]
    table = pa.table({n: [r[k] for r in rows] for k, n in enumerate(names)})

    def marks(step):
        out = []
        for b in spikes._scan(table.slice(k, step).combine_chunks().to_batches()[0] for k in range(0, len(rows), step)):
            out += [tuple(map(str, r.values())) for r in b.to_pylist() if r["tag"] != "change"]
        return sorted(out)

    assert marks(size) == marks(len(rows)) and any("held" in m for m in marks(size))
