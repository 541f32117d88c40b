"""Older versions of hygiene, JSON and scores in answers, prompts, chats and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hygiene as H
from ..operators import emr, judging, prompts as P, scoring
from ..session import load
from .query import Query
from .sqltext import BLANK, CATEGORY_SQL, STRIP_SQL

_inf = lambda s, d: load(s, d, "inference_records")
_bank = lambda s, d: load(s, d, "fewshot_bank")
_R = lambda c, name=None: F.round(c, 6).alias(name or c)
_Q = lambda x: x.replace("'", "''")
_WORDS = lambda c: f"list_filter(regexp_split_to_array({c}, '{BLANK}+'), lambda t: t <> '')"
_COUNT = lambda c: f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda t: t <> ''))"
_REPEATS = lambda t: f"(len(list_filter(range(1, len({t}) - 1), lambda i: {t}[i] = {t}[i + 1] AND {t}[i + 1] = {t}[i + 2])) > 0 OR (len({t}) >= 12 AND len(list_distinct(list_transform(range(1, len({t}) - 2), lambda i: array_to_string({t}[i : i + 3], chr(1))))) < 0.5 * (len({t}) - 3)))"
_WALL = lambda c: f"(len(list_filter(range(1, length({c}) - 6), lambda i: substr({c}, i, 1) <> chr(10) AND substr({c}, i, 8) = repeat(substr({c}, i, 1), 8))) > 0)"


def clean_v2(s, d):
    x = _inf(s, d).select("gen_id", F.coalesce(H.without_thinking(F.col("generated_raw")), F.lit("")).alias("cleaned"))
    return x.select("gen_id", "cleaned", H.status_v2(F.col("cleaned"), H.tokens(F.col("cleaned"))).alias("status"))


_THINK = "regexp_replace(coalesce(generated_raw, ''), '(?is)<think>.*?</think>', '', 'g')"
_V2_SIGNS = _Q("".join("\\" + c if c in "[]\\^-&~" else c for c in H.ALLOWED_SIGNS_V2 if not c.isspace()))
_V2_SQL = f"""WITH a AS (SELECT gen_id, {_THINK} AS t FROM inference_records), b AS (SELECT gen_id, CASE WHEN contains(lower(t), '<think>') AND NOT contains(lower(t), '</think>') THEN regexp_replace(t, '(?is)<think>.*$', '', 'g') ELSE t END AS t FROM a),
c AS (SELECT gen_id, {STRIP_SQL(f"regexp_replace(t, '{H.ROLE}', '', 'g')")} AS cleaned FROM b), e AS (SELECT *, {_WORDS('cleaned')} AS w, regexp_replace(cleaned, '{BLANK}', '', 'g') AS solid FROM c)
SELECT gen_id, cleaned, CASE WHEN length(cleaned) < 3 THEN 'empty' WHEN {_WALL('cleaned')} THEN 'repetition' WHEN coalesce(length(regexp_replace(solid, '[가-힣ᄀ-ᇿA-Za-z0-9一-鿿{_V2_SIGNS}]', '', 'g')) / nullif(length(solid), 0), 0) > 0.15 THEN 'garbage'
WHEN regexp_matches(cleaned, '{H.THOUGHT}') THEN 'leak' WHEN {_REPEATS('w')} THEN 'repetition' WHEN regexp_matches(cleaned, '(?:{H.PARTICLES_V2}){BLANK}*$') AND NOT ({" OR ".join(f"ends_with(cleaned, '{x}')" for x in H.SOUND_ENDS_V2)}) THEN 'truncated' ELSE 'ok' END AS status FROM e"""
_V1_SQL = f"""WITH a AS (SELECT gen_id, regexp_replace(regexp_replace(generated_raw, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', '', 'g') AS t FROM inference_records WHERE generated_raw IS NOT NULL),
b AS (SELECT gen_id, {STRIP_SQL(f"regexp_replace(regexp_replace(t, '{H.TRAILING_V1}', '', 'g'), '{H.JUNK_V1}', '', 'g')")} AS t FROM a) SELECT gen_id, CASE WHEN length(t) < 5 THEN '{H.FAILED_V1}' ELSE t END AS cleaned FROM b"""
_NI2 = ", ".join(f"'{p}'" for p in H.NO_ISSUE_V2)
_NI2_SQL = f"""WITH a AS (SELECT gen_id, generated AS g, {STRIP_SQL('lower(generated)')} AS t FROM inference_records) SELECT gen_id, coalesce(g = '' OR regexp_replace(t, '[ .·]', '', 'g') IN ({", ".join(repr(p.replace(" ", "")) for p in H.NO_ISSUE_V2)}) OR t IN ({_NI2})
OR (len(list_filter([{_NI2}], lambda p: starts_with({STRIP_SQL("split_part(t, chr(10), 1)")}, p))) > 0 AND length(t) < 40), true) AS no_issue FROM a"""


def cells(s, d):
    """Premedication notes as they come from a sheet: in quotes, with one of them missing, or with a stand-in for nothing."""
    x, k = F.col("premed"), F.pmod("sid", F.lit(6))
    cell = F.when(k == 0, F.concat(F.lit('"'), x, F.lit('"'))).when(k == 1, F.concat(F.lit('"'), x)).when(k == 2, F.concat(x, F.lit('" '))).when(k == 3, " NaN ").when(k == 4, "(없음)").otherwise(x)
    return load(s, d, "emr_case").select("sid", H.cell(cell).alias("cell"))


_CELL = STRIP_SQL("x")
_CELL_SQL = f"""WITH c AS (SELECT sid, CASE sid % 6 WHEN 0 THEN '"' || premed || '"' WHEN 1 THEN '"' || premed WHEN 2 THEN premed || '" ' WHEN 3 THEN ' NaN ' WHEN 4 THEN '(없음)' ELSE premed END AS x FROM emr_case), t AS (SELECT sid, x, {_CELL} AS y FROM c)
SELECT sid, CASE WHEN x IS NULL OR lower(y) IN ('nan', 'none', '-', '(없음)') THEN '' WHEN length(y) >= 2 AND starts_with(y, '"') AND ends_with(y, '"') THEN {STRIP_SQL("substr(y, 2, length(y) - 2)")}
WHEN (length(y) - length(replace(y, '"', ''))) % 2 = 1 AND starts_with(y, '"') THEN {STRIP_SQL("substr(y, 2)")} WHEN (length(y) - length(replace(y, '"', ''))) % 2 = 1 AND ends_with(y, '"') THEN {STRIP_SQL("substr(y, 1, length(y) - 1)")} ELSE y END AS cell FROM t"""
_MODELS = (*H.MODEL_KEYS, "other", "solo")


def tags(s, d):
    """Tags of models and experiments, known and not, split again."""
    m = F.element_at(F.array(*map(F.lit, _MODELS)), (F.pmod("idx", F.lit(len(_MODELS))) + 1).cast("int"))
    e = F.element_at(F.array(*map(F.lit, H.EXPERIMENTS)), (F.pmod("gen_id", F.lit(len(H.EXPERIMENTS))) + 1).cast("int"))
    tag = F.when(F.pmod("gen_id", F.lit(9)) == 0, m).otherwise(F.concat(m, F.lit("_"), e))
    return _inf(s, d).where("idx is not null").select("gen_id", H.split_tag(tag).alias("t")).select("gen_id", "t.model", "t.experiment")


_TAG_SQL = f"""WITH t AS (SELECT gen_id, [{', '.join(repr(m) for m in _MODELS)}][idx % {len(_MODELS)} + 1] AS m, [{', '.join(repr(e) for e in H.EXPERIMENTS)}][gen_id % {len(H.EXPERIMENTS)} + 1] AS e FROM inference_records WHERE idx IS NOT NULL),
g AS (SELECT gen_id, CASE WHEN gen_id % 9 = 0 THEN m ELSE m || '_' || e END AS tag FROM t), k AS (SELECT *, list_filter([{', '.join(repr(m) for m in sorted(H.MODEL_KEYS, key=len, reverse=True))}], lambda x: tag = x OR starts_with(tag, x || '_'))[1] AS hit FROM g)
SELECT gen_id, coalesce(hit, split_part(tag, '_', 1)) AS model, CASE WHEN hit = tag THEN '?' WHEN hit IS NOT NULL THEN substr(tag, length(hit) + 2) WHEN contains(tag, '_') THEN substr(tag, strpos(tag, '_') + 1) ELSE '?' END AS experiment FROM k"""


def leaks(s, d):
    x = _inf(s, d).select(F.lower(F.coalesce("engine", F.lit("?"))).alias("engine"), F.coalesce("generated_raw", "generated", F.lit("")).alias("t"))
    return x.groupBy("engine").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("t").rlike(p)).alias(k) for k, p in H.LEAKS.items()], F.count_if(F.col("t").rlike(r"(.)\1{7,}")).alias("wall"))


_LEAK_SQL = "WITH x AS (SELECT lower(coalesce(engine, '?')) AS engine, coalesce(generated_raw, generated, '') AS t FROM inference_records) SELECT engine, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(t, '{_Q(p)}')) AS {k}" for k, p in H.LEAKS.items()) + f", count(*) FILTER (WHERE {_WALL('t')}) AS wall FROM x GROUP BY 1"


def answers(s, d):
    """Events as a judge's answers: JSON in a fence with a comma too many, plain, amid text, broken, an array, or none."""
    k, p = F.pmod("event_id", F.lit(6)), F.col("props")
    text = F.when(k == 0, F.concat(F.lit("```json\n"), F.regexp_replace(p, r"\}$", ", }"), F.lit("\n``` {x"))).when(k == 1, p).when(k == 2, F.concat(F.lit("note "), p, F.lit(" end"))).when(k == 3, F.substr(p, F.lit(1), F.length(p) - 1)).when(k == 4, F.concat(F.lit("list ["), p, F.lit(",] ok"))).otherwise("[RESULT] (4) of 5")
    return load(s, d, "events").select("event_id", text.alias("text"))


_ANSWER_SQL = """a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '```json' || chr(10) || regexp_replace(props, '\\}$', ', }') || chr(10) || '``` {x' WHEN 1 THEN props WHEN 2 THEN 'note ' || props || ' end' WHEN 3 THEN substr(props, 1, length(props) - 1) WHEN 4 THEN 'list [' || props || ',] ok' ELSE '[RESULT] (4) of 5' END AS text FROM events)"""
_JSON_SQL = lambda body: f"""list_filter(flatten(list_transform(list_filter([regexp_extract(regexp_extract(text, '(?s)```(?:json)?\\s*(.*?)```', 1), '{body}', 0), regexp_extract(text, '{body}', 0)], lambda y: y <> ''), lambda y: [y, regexp_replace(y, ',(\\s*[}}\\]])', '\\1', 'g')])), lambda y: json_valid(y))[1]"""


def retry(s, d):
    """Answers that get one letter longer with each attempt: some can be read at once, some later, some never."""
    e = load(s, d, "events").select("event_id", "props")
    cut = lambda k: F.substr("props", F.lit(1), F.length("props") - F.greatest(F.pmod("event_id", F.lit(5)) - k, F.lit(0)).cast("int"))
    ask = lambda pending, k: pending.join(e, "event_id").select("event_id", cut(k).alias("answer"))
    return judging.ask_until_read(e.select("event_id"), "event_id", ask).select("event_id", "attempt", F.get_json_object("parsed", "$.k").alias("k"))


def emr_assembly(s, d):
    x = load(s, d, "emr_case")
    return emr.assemble(x, "sid", "preop_summary", "premed", {"Weight": "weight_raw", "Department": "dept", "Anesthesia": "anes_type"}, "opname")


_EMR_SQL = """WITH t AS (SELECT *, concat_ws(chr(10), 'Weight: ' || weight_raw, 'Department: ' || dept, 'Anesthesia: ' || anes_type) AS tot FROM emr_case)
SELECT sid, concat_ws(chr(10) || chr(10), '- Pre-anesthetic Patient Conditions Summary' || chr(10) || coalesce(preop_summary, ''), '- Preoperative Preparations and Premedication' || chr(10) || coalesce(premed, ''), CASE WHEN tot <> '' THEN '- Anesthetic TOTALS' || chr(10) || tot END, '- Anesthetic Record' || chr(10) || coalesce(opname, '')) AS emr FROM t"""
_SECTION_SQL = f"""WITH m AS (SELECT rec_id, emr, string_split(regexp_replace(emr, '- ({"|".join(emr.SECTIONS)})\\n', chr(1) || '\\1' || chr(10), 'g'), chr(1)) AS s FROM fewshot_bank WHERE emr IS NOT NULL),
e AS (SELECT rec_id, emr, s, unnest(range(2, len(s) + 1)) AS k FROM m) SELECT rec_id, CAST(k - 2 AS INT) AS k, split_part(s[k], chr(10), 1) AS label, {STRIP_SQL("substr(s[k], strpos(s[k], chr(10)) + 1)")} AS content FROM e
UNION ALL SELECT rec_id, 0, 'EMR', {STRIP_SQL('emr')} FROM m WHERE len(s) = 1"""

_BUDGET = 120
_FRAME_SQL = lambda e: f"'{P.INSTRUCTION}' || chr(10) || chr(10) || '### EMR' || chr(10) || {e} || CASE WHEN coalesce(vital, '') <> '' THEN chr(10) || chr(10) || '### INTRAOPERATIVE VITAL SUMMARY' || chr(10) || vital ELSE '' END || chr(10) || chr(10) || '### OUTPUT' || chr(10)"
_MARK_SQL = _Q(P.MARKER.strip())
_FIT_SQL = f"""WITH a AS (SELECT rec_id, coalesce(emr, '') AS emr, vital FROM fewshot_bank), b AS (SELECT *, {_FRAME_SQL('emr')} AS whole, {_BUDGET} - {_COUNT(_FRAME_SQL(f"'{_MARK_SQL}' || chr(10)"))} AS room FROM a),
c AS (SELECT *, {_COUNT('whole')} AS n FROM b) SELECT rec_id, CASE WHEN n <= {_BUDGET} THEN whole WHEN room < 0 THEN NULL ELSE {_FRAME_SQL(f"'{_MARK_SQL}' || chr(10) || regexp_extract(emr, '((?:\\s+\\S+){{' || room || '}}\\s*)$', 1)")} END AS prompt, n > {_BUDGET} AS cut FROM c"""


def prompt_fit(s, d):
    x = _bank(s, d).select("rec_id", "emr", "vital")
    render = lambda e: P.user_prompt(e, F.col("vital"))
    return x.select("rec_id", P.fit_words(F.col("emr"), _BUDGET, render).alias("prompt"), (P.words(render(F.coalesce("emr", F.lit("")))) > _BUDGET).alias("cut"))


def preference(s, d):
    """Pairs of a cleaned and a raw answer that differ, neither blank: chosen and rejected."""
    x = _inf(s, d).select("gen_id", F.col("prompt_text").alias("user"), H.strip(F.col("generated")).alias("chosen"), H.strip(F.col("generated_raw")).alias("rejected"))
    return x.where("chosen <> '' and rejected <> '' and chosen <> rejected")


_PREF_SQL = f"pref AS (SELECT * FROM (SELECT gen_id, prompt_text AS user, {STRIP_SQL('generated')} AS chosen, {STRIP_SQL('generated_raw')} AS rejected FROM inference_records) WHERE chosen <> '' AND rejected <> '' AND chosen <> rejected)"
_SYSTEM = "You write hand-offs."


def training(s, d):
    return P.training_rows(preference(s, d), _SYSTEM, "gen_id")


_CHAT_SQL = lambda u: f"'<|system|>' || chr(10) || '{_SYSTEM}' || chr(10) || '<|user|>' || chr(10) || {u} || chr(10)"
_VERSUS = lambda a, b: f"'{P.JUDGE}' || chr(10) || chr(10) || 'EMR:' || chr(10) || user || chr(10) || chr(10) || 'Assistant A: ' || {a} || chr(10) || chr(10) || 'Assistant B: ' || {b}"
_TRAIN_SQL = f"""{_PREF_SQL}, rows_of AS (SELECT gen_id, 'write' AS task, {_CHAT_SQL('user')} AS said, chosen AS target FROM pref UNION ALL SELECT gen_id, 'judge_ab', {_CHAT_SQL(_VERSUS('chosen', 'rejected'))}, 'A' FROM pref UNION ALL SELECT gen_id, 'judge_ba', {_CHAT_SQL(_VERSUS('rejected', 'chosen'))}, 'B' FROM pref),
train AS (SELECT gen_id, task, said || '<|assistant|>' || chr(10) AS prompt, said || '<|assistant|>' || chr(10) || target || chr(10) AS whole, target FROM rows_of)"""


def label_mask(s, d):
    """Ids and labels of the training rows, with how much is trained and what the last labels are; padded and cut on the left."""
    x = training(s, d).select("gen_id", "task", P.byte_ids(F.col("prompt")).alias("p"), P.byte_ids(F.col("whole")).alias("w"))
    x = x.select("gen_id", "task", "w", P.masked(F.col("p"), F.col("w")).alias("labels"))
    padded, kept = P.pad_left(F.col("labels"), 400, P.MASKED), P.pad_left(F.col("w"), 400, 0)
    return x.select("gen_id", "task", F.size("w").alias("n"), F.size(F.filter("labels", lambda y: y != P.MASKED)).alias("trained"), F.array_join(F.slice(padded, 396, 5), ",").alias("tail"), F.size(F.filter(padded, lambda y: y != P.MASKED)).alias("kept"), F.element_at(kept, 1).alias("first"))


_MASK_SQL = f"""WITH {_TRAIN_SQL}, x AS (SELECT gen_id, task, octet_length(encode(whole)) AS n, octet_length(encode(target)) + 1 AS m, hex(encode(whole)) AS h FROM train),
y AS (SELECT *, list_transform(range(greatest(n - 400, 0), n), lambda k: CAST('0x' || substr(h, CAST(2 * k + 1 AS BIGINT), 2) AS INT)) AS ids FROM x)
SELECT gen_id, task, CAST(n AS INT) AS n, CAST(m AS INT) AS trained, array_to_string(list_transform(range(n - 5, n), lambda k: CASE WHEN k < n - m THEN -100 ELSE CAST('0x' || substr(h, CAST(2 * k + 1 AS BIGINT), 2) AS INT) END), ',') AS tail, CAST(least(m, 400) AS INT) AS kept, CASE WHEN n < 400 THEN 0 ELSE ids[1] END AS first FROM y"""


def dpo_fit(s, d):
    x = preference(s, d).select("gen_id", P.fit_pair(H.tokens(F.col("user")), H.tokens(F.col("chosen")), H.tokens(F.col("rejected")), 60, 40).alias("f"))
    return x.select("gen_id", *[F.array_join(f"f.{c}", " ").alias(c) for c in ("prompt", "chosen", "rejected")])


_DPO_SQL = f"""WITH {_PREF_SQL}, t AS (SELECT gen_id, {_WORDS('user')} AS p, {_WORDS('chosen')} AS c, {_WORDS('rejected')} AS r FROM pref), o AS (SELECT *, greatest(len(c), len(r)) AS m, CASE WHEN len(p) + greatest(len(c), len(r)) > 60 THEN p[greatest(len(p) - 39, 1) : len(p)] ELSE p END AS q FROM t)
SELECT gen_id, array_to_string(q, ' ') AS prompt, array_to_string(CASE WHEN len(q) + m > 60 THEN c[1:20] ELSE c END, ' ') AS chosen, array_to_string(CASE WHEN len(q) + m > 60 THEN r[1:20] ELSE r END, ' ') AS rejected FROM o"""


def simpo(s, d):
    """Loss and rewards of the pairs under the unigram model of all answers: the mean log-probability of a text's words."""
    x = preference(s, d).select("gen_id", F.explode(F.array(F.struct(F.lit("c").alias("k"), F.col("chosen").alias("t")), F.struct(F.lit("r").alias("k"), F.col("rejected").alias("t")))).alias("p")).select("gen_id", "p.k", F.explode(H.tokens(F.col("p.t"))).alias("w"))
    counts = x.groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("all"))  # one row
    logp = x.join(counts, "w").join(F.broadcast(total)).groupBy("gen_id").pivot("k", ["c", "r"]).agg(F.avg(F.log(F.col("c") / F.col("all"))))
    return logp.where("c is not null and r is not null").select("gen_id", scoring.simpo(F.col("c"), F.col("r")).alias("f")).select("gen_id", *[_R(f"f.{k}", k) for k in ("loss", "chosen_reward", "rejected_reward", "margin")], "f.right")


_SIMPO_SQL = f"""WITH {_PREF_SQL}, x AS (SELECT gen_id, 'c' AS k, unnest({_WORDS('chosen')}) AS w FROM pref UNION ALL SELECT gen_id, 'r', unnest({_WORDS('rejected')}) FROM pref), n AS (SELECT w, count(*) AS c FROM x GROUP BY 1), t AS (SELECT count(*) AS t FROM x),
l AS (SELECT gen_id, avg(ln(c / t)) FILTER (WHERE k = 'c') AS a, avg(ln(c / t)) FILTER (WHERE k = 'r') AS b FROM x JOIN n USING (w), t GROUP BY gen_id)
SELECT gen_id, round(ln(1 + exp(-2.0 * (a - b - 0.25))), 6) AS loss, round(2 * a, 6) AS chosen_reward, round(2 * b, 6) AS rejected_reward, round(2 * (a - b), 6) AS margin, a > b AS "right" FROM l WHERE a IS NOT NULL AND b IS NOT NULL"""


def registry_of(s, d, part):
    """Each source as a prompt whose parts are its documents: one fingerprint over the parts' digests, in buckets of ids."""
    x = load(s, d, "documents").where(F.pmod("doc_id", F.lit(7)) != part).select(F.coalesce("source", F.lit("?")).alias("name"), F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    return judging.fingerprints(x, "name", "k", "t")


def fingerprint_diff(s, d):
    return judging.changed(registry_of(s, d, 0), registry_of(s, d, 0).where("name <> 'guideline'").unionByName(registry_of(s, d, 1).where("name = 'guideline'").withColumn("name", F.lit("guideline"))))


_REG_SQL = lambda part: f"SELECT name, substr(sha1(string_agg(h, ',' ORDER BY b)), 1, 12) AS digest FROM (SELECT coalesce(source, '?') AS name, doc_id % 1024 AS b, sha1(string_agg(sha1(coalesce(text, '')), ',' ORDER BY doc_id)) AS h FROM documents WHERE doc_id % 7 <> {part} GROUP BY ALL) GROUP BY name"


QUERIES = {
    "no_issue_prefix": Query(lambda s, d: _inf(s, d).select("gen_id", H.no_issue_v2(F.col("generated")).alias("no_issue")), _NI2_SQL),
    "clean_v1": Query(
        lambda s, d: _inf(s, d).where("generated_raw is not null").select("gen_id", H.clean_v1(F.col("generated_raw")).alias("cleaned")),
        _V1_SQL,
    ),
    "clean_v2": Query(clean_v2, _V2_SQL),
    "collapse_repeats": Query(lambda s, d: load(s, d, "documents").select("doc_id", H.collapse_repeats(F.col("text")).alias("shown"))),
    "cell_normalize": Query(cells, _CELL_SQL),
    "nested_get": Query(
        lambda s, d: load(s, d, "gold_checklist").select("sid", F.struct(F.struct(F.get("check_items", F.lit(0)).alias("first")).alias("items")).alias("r")).select("sid", H.nested(F.col("r"), "items", "first", "finding").alias("finding"), H.nested(F.col("r"), "items", "first", "severity").alias("severity")),
        f"SELECT sid, coalesce({STRIP_SQL('check_items[1].finding')}, '') AS finding, coalesce({STRIP_SQL('check_items[1].severity')}, '') AS severity "
        "FROM gold_checklist",
    ),
    "tag_longest_prefix": Query(tags, _TAG_SQL),
    "category_normalize": Query(
        lambda s, d: load(s, d, "gold_checklist").select("sid", F.explode("check_items").alias("i")).select("sid", F.col("i.id").alias("id"), H.category(F.col("i.category")).alias("category")),
        f"SELECT sid, i.id AS id, {CATEGORY_SQL('i.category')} AS category FROM (SELECT sid, unnest(check_items) AS i FROM gold_checklist)",
    ),
    "family_label": Query(
        lambda s, d: tags(s, d).select("gen_id", judging.family(F.col("model")).alias("family")),
        f"WITH x AS ({_TAG_SQL}) SELECT gen_id, CASE {' '.join(f'''WHEN contains(lower(model), '{k}') THEN '{k}' ''' for k in judging.FAMILIES)} ELSE 'other' END AS family "
        "FROM x",
    ),
    "leak_pattern_counts": Query(leaks, _LEAK_SQL),
    "ngram_repetition": Query(
        lambda s, d: _inf(s, d).where("generated is not null").select("gen_id", H.repeats(H.tokens(F.col("generated"))).alias("repeats")),
        f"SELECT gen_id, {_REPEATS('t')} AS repeats FROM (SELECT gen_id, {_WORDS('generated')} AS t FROM inference_records WHERE generated IS NOT NULL)",
    ),
    "json_extract_robust": Query(
        lambda s, d: answers(s, d).select("event_id", F.get_json_object(H.first_json(F.col("text")), "$.k").alias("k"), H.first_json(F.col("text"), "arr").isNotNull().alias("array")),
        f"WITH {_ANSWER_SQL}, j AS (SELECT event_id, {_JSON_SQL('(?s)[{].*[}]')} AS o, {_JSON_SQL('(?s)[[].*[]]')} AS r FROM a) SELECT event_id, CASE "
        "WHEN o IS NOT NULL THEN json_extract_string(o, '$.k') END AS k, r IS NOT NULL AS array FROM j",
    ),
    "result_score_parse": Query(
        lambda s, d: answers(s, d).select("event_id", H.result_score(F.col("text")).alias("score")),
        f"WITH {_ANSWER_SQL} SELECT event_id, TRY_CAST(nullif(regexp_extract(text, '\\[RESULT\\]\\s*\\(?\\s*([1-5])\\s*\\)?', 1), '') AS DOUBLE) AS score FROM a",
    ),
    "score_parse_fallback": Query(
        lambda s, d: answers(s, d).select("event_id", F.coalesce(F.try_element_at(F.regexp_extract_all("text", F.lit("[1-5]"), 0), F.lit(-1)).cast("double"), F.lit(3.0)).alias("score")),
        f"WITH {_ANSWER_SQL} SELECT event_id, coalesce(CAST(regexp_extract_all(text, '[1-5]')[-1] AS DOUBLE), 3.0) AS score FROM a",
    ),
    "pending_retry_antijoin": Query(
        retry,
        "SELECT event_id, CASE WHEN event_id % 5 <= 2 THEN CAST(event_id % 5 AS INT) END AS attempt, CASE "
        "WHEN event_id % 5 <= 2 THEN json_extract_string(props, '$.k') END AS k FROM events",
    ),
    "emr_assembly": Query(emr_assembly, _EMR_SQL),
    "section_split": Query(lambda s, d: emr.sections(_bank(s, d), "rec_id", "emr"), _SECTION_SQL),
    "prompt_render": Query(
        lambda s, d: _bank(s, d).select("rec_id", P.user_prompt(F.col("emr"), F.col("vital")).alias("prompt")),
        f"SELECT rec_id, {_FRAME_SQL("coalesce(emr, '')")} AS prompt FROM fewshot_bank",
    ),
    "left_truncate": Query(prompt_fit, _FIT_SQL),
    "prompt_budget_max": Query(
        lambda s, d: prompt_fit(s, d).agg(F.max(P.words(F.col("prompt"))).alias("most"), F.count_if("cut").alias("cut"), F.count_if(F.col("prompt").isNull()).alias("too_small")),
        f"WITH f AS ({_FIT_SQL}) SELECT CAST(max({_COUNT('prompt')}) AS INT) AS most, count(*) FILTER (WHERE cut) AS cut, "
        "count(*) FILTER (WHERE prompt IS NULL) AS too_small FROM f",
    ),
    "chat_flatten": Query(
        lambda s, d: _inf(s, d).where("generated is not null").select("gen_id", P.chat(F.lit(_SYSTEM), F.col("prompt_text"), F.col("generated"), True).alias("chat"), P.chat(F.lit(_SYSTEM), F.col("prompt_text"), None, False).alias("merged")),
        f"SELECT gen_id, {_CHAT_SQL('prompt_text')} || '<|assistant|>' || chr(10) || generated || chr(10) AS chat, "
        f"'<|user|>' || chr(10) || '{_SYSTEM}' || chr(10) || chr(10) || prompt_text || chr(10) || '<|assistant|>' || chr(10) AS merged FROM inference_records "
        "WHERE generated IS NOT NULL",
    ),
    "output_wrapped": Query(
        lambda s, d: _inf(s, d).where("generated is not null").select("gen_id", H.wrapped(F.col("generated")).alias("wrapped")),
        f"SELECT gen_id, '{H.OUTPUT_OPEN}' || chr(10) || generated || chr(10) || '{H.OUTPUT_CLOSE}' AS wrapped FROM inference_records WHERE generated IS NOT NULL",
    ),
    "dpo_filter": Query(
        lambda s, d: preference(s, d).select("gen_id", F.length("chosen").alias("chosen"), F.length("rejected").alias("rejected")),
        f"WITH {_PREF_SQL} SELECT gen_id, length(chosen) AS chosen, length(rejected) AS rejected FROM pref",
    ),
    "sft_explode": Query(
        lambda s, d: training(s, d).select("gen_id", "task", F.sha1("prompt").alias("prompt"), F.sha1("whole").alias("whole"), "target"),
        f"WITH {_TRAIN_SQL} SELECT gen_id, task, sha1(prompt) AS prompt, sha1(whole) AS whole, target FROM train",
    ),
    "label_mask": Query(label_mask, _MASK_SQL),
    "dpo_fit": Query(dpo_fit, _DPO_SQL),
    "simpo_loss": Query(simpo, _SIMPO_SQL),
    "fingerprint_diff": Query(
        fingerprint_diff,
        f"WITH a AS ({_REG_SQL(0)}), c AS ({_REG_SQL(1)}), b AS (SELECT * FROM a WHERE name <> 'guideline' UNION ALL SELECT * FROM c "
        "WHERE name = 'guideline') SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' "
        "WHEN a.digest <> b.digest THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.name = b.name",
    ),
}
