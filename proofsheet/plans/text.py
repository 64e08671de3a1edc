"""Captions, keywords, transcripts, names, replies and cleaning of fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofsheet.functions import columns as C
from proofsheet.functions import text as T
from proofsheet.plans.catalog import query
from proofsheet.plans.views import METRICS_SQL, metrics, table

_SAID = """said AS (SELECT conv_id, turn, role, text || CASE turn % 5 WHEN 0 THEN ' With this ring, ...' WHEN 1 THEN ' and their FIRST DANCE' WHEN 2 THEN ' raise a glass; the rings' ELSE '' END AS text, (conv_id * 31 + turn * 17) % 100 / 100.0 AS confidence FROM conversations)"""


def said(spark, sf):
    c = table(spark, sf, "conversations")
    tail = F.when(F.col("turn") % 5 == 0, " With this ring, ...").when(F.col("turn") % 5 == 1, " and their FIRST DANCE").when(F.col("turn") % 5 == 2, " raise a glass; the rings").otherwise("")
    return c.select("conv_id", "turn", "role", F.concat("text", tail).alias("text"), ((F.col("conv_id") * 31 + F.col("turn") * 17) % 100 / 100.0).alias("confidence"))


def _first(text, vocabulary):
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "coalesce(" + ", ".join(f"CASE WHEN contains({text}, {quoted(p)}) THEN {quoted(m)} END" for p, m in vocabulary) + ")"


@query(f"WITH {_SAID}, m AS (SELECT conv_id, turn, confidence, {_first('lower(text)', T.CEREMONY)} AS moment FROM said WHERE confidence >= 0.6) SELECT conv_id, turn, confidence, moment FROM m WHERE moment IS NOT NULL")
def transcript_moments(spark, sf):
    rows = said(spark, sf).filter("confidence >= 0.6").withColumn("moment", T.ceremony_moment(F.col("text")))
    return rows.filter("moment is not null").select("conv_id", "turn", "confidence", "moment")


@query("""WITH s AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'user' ELSE role END AS speaker FROM conversations), t AS (SELECT conv_id, count(DISTINCT speaker) > 1 AS told FROM s GROUP BY conv_id)
 SELECT s.conv_id, turn, CASE WHEN told THEN speaker END AS speaker FROM s JOIN t ON t.conv_id = s.conv_id""")
def told_speakers(spark, sf):
    s = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, "user").otherwise(F.col("role")).alias("speaker"))
    return T.distinct_speakers(s, "conv_id", "speaker").select("conv_id", "turn", "speaker")


def timed(spark, sf):
    """Turns with the times of their characters; every seventh lacks one."""
    c = table(spark, sf, "conversations")
    body = F.length(F.regexp_replace("text", rf"[{T.SENTENCE_ENDS}{T.CLAUSE_ENDS}\s]", ""))
    n = body - F.when(F.col("conv_id") % 7 == 0, 1).otherwise(0)
    times = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct((i * 100).alias("a"), (i * 100 + 80).alias("b")))
    return c.select("conv_id", "turn", "text", times.alias("times"))


_MARKS = f"[{T.SENTENCE_ENDS}{T.CLAUSE_ENDS}\\s]"


@query(f"""WITH c AS (SELECT conv_id, turn, trim(text) AS text, length(regexp_replace(trim(text), '{_MARKS}', '', 'g')) AS body FROM conversations), n AS (SELECT *, body - CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END AS n FROM c),
 p AS (SELECT conv_id, turn, n, unnest(regexp_extract_all(text, '{T.CLAUSE_PATTERN}')) AS piece, generate_subscripts(regexp_extract_all(text, '{T.CLAUSE_PATTERN}'), 1) AS k FROM n WHERE n = body AND n > 0),
 w AS (SELECT *, length(regexp_replace(piece, '{_MARKS}', '', 'g')) AS m, sum(length(regexp_replace(piece, '{_MARKS}', '', 'g'))) OVER (PARTITION BY conv_id, turn ORDER BY k) AS upto FROM p)
 SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS INT) AS i, trim(piece) AS text, CAST((upto - m) * 100 AS DOUBLE) / 1000 AS a, CAST((upto - 1) * 100 + 80 AS DOUBLE) / 1000 AS b FROM w WHERE m > 0
 UNION ALL SELECT conv_id, turn, 0, text, 0.0, CAST((n - 1) * 100 + 80 AS DOUBLE) / 1000 FROM n WHERE n <> body AND n > 0""")
def transcript_clauses(spark, sf):
    return timed(spark, sf).select("conv_id", "turn", F.posexplode(T.clauses(F.col("text"), F.col("times"))).alias("i", "c")).select("conv_id", "turn", "i", "c.text", "c.a", "c.b")


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"score": ' || doc_id || '}' WHEN 1 THEN '<think>{"no": 1}</think> {"score": ' || doc_id || '}' WHEN 2 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{"score": ' || doc_id || '}' || chr(10) || '```' WHEN 3 THEN 'I say {"score": ' || doc_id || '} and no more' WHEN 4 THEN '<think> never ends {"score": 1}' ELSE 'nothing {here' END AS reply FROM documents),
 b AS (SELECT doc_id, trim(regexp_replace(trim(reply), '(?s)<think>.*?</think>', '', 'g')) AS b FROM r), f AS (SELECT doc_id, b, CASE WHEN regexp_matches(b, '(?s)```(?:json)?\\s*.*?```') THEN trim(regexp_extract(b, '(?s)```(?:json)?\\s*(.*?)```', 1), ' ' || chr(10)) ELSE b END AS s FROM b),
 j AS (SELECT doc_id, CASE WHEN contains(b, '<think>') THEN NULL WHEN json_valid(s) THEN s WHEN json_valid(regexp_extract(s, '(?s)\\{.*\\}', 0)) THEN regexp_extract(s, '(?s)\\{.*\\}', 0) END AS j FROM f)
 SELECT doc_id, CAST(json_extract_string(j, '$.score') AS BIGINT) AS score FROM j""")
def json_replies(spark, sf):
    i = F.col("doc_id")
    one = F.concat(F.lit('{"score": '), i, F.lit("}"))
    reply = F.when(i % 6 == 0, one).when(i % 6 == 1, F.concat(F.lit('<think>{"no": 1}</think> '), one)).when(i % 6 == 2, F.concat(F.lit("Sure:\n```json\n"), one, F.lit("\n```"))).when(i % 6 == 3, F.concat(F.lit("I say "), one, F.lit(" and no more"))).when(i % 6 == 4, '<think> never ends {"score": 1}').otherwise("nothing {here")
    return table(spark, sf, "documents").select("doc_id", F.get_json_object(T.json_reply(reply), "$.score").cast("bigint").alias("score"))


_ROW = f"{METRICS_SQL}, rw AS (SELECT *, CASE WHEN score_final > 0.65 THEN 'keep' WHEN score_final > 0.4 THEN 'maybe' ELSE 'cull' END AS decision, CASE WHEN photo_id % 4 = 0 THEN [] WHEN photo_id % 4 = 1 THEN ['Ada'] ELSE ['Ada', ' Bo', 'Ada', ''] END AS people, CASE WHEN photo_id % 3 = 0 THEN 'Pier ' || photo_id % 9 END AS place FROM v_metrics)"


def rows(spark, sf):
    i = F.col("photo_id")
    decision = F.when(F.col("score_final") > 0.65, "keep").when(F.col("score_final") > 0.4, "maybe").otherwise("cull")
    people = F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.array(F.lit("Ada"))).otherwise(F.array(*map(F.lit, ("Ada", " Bo", "Ada", ""))))
    return metrics(spark, sf).withColumns({"decision": decision, "people": people, "place": F.when(i % 3 == 0, F.concat(F.lit("Pier "), i % 9))})


_NAMES = "list_filter(list_transform(people, lambda p: trim(p)), lambda p: p <> '')"


@query(f"""WITH {_ROW} SELECT photo_id, array_to_string(list_concat(list_filter(['review:' || decision, 'review:scene:' || scene, CASE WHEN photo_id % 2 = 0 THEN 'review:vertical:' || scene END, 'review:run:' || right('run' || run_id, 4), CASE WHEN photo_id % 5 = 0 THEN 'review:judged-by:cloud' END], lambda x: x IS NOT NULL),
 list_transform(CASE WHEN len({_NAMES}) > 1 THEN ['Ada', 'Bo'] ELSE {_NAMES} END, lambda p: 'review:person:' || p)), ';') AS keywords FROM rw""")
def catalogue_keywords(spark, sf):
    i = F.col("photo_id")
    found = T.keywords("review", F.col("decision"), F.col("scene"), F.when(i % 2 == 0, F.col("scene")), F.concat(F.lit("run"), F.col("run_id")), F.when(i % 5 == 0, "cloud"), F.col("people"))
    return rows(spark, sf).select("photo_id", F.array_join(found, ";").alias("keywords"))


@query(f"""WITH {_ROW} SELECT photo_id, CASE WHEN photo_id % 7 = 0 THEN 'A caption' ELSE array_to_string(list_concat(CASE WHEN photo_id % 2 = 0 THEN ['◇ clear'] ELSE [] END, ['+ light', '+ eyes'][1 : CAST(photo_id % 3 AS BIGINT)], CASE WHEN lap IS NULL THEN ['- soft'] ELSE [] END), chr(10)) END AS description FROM rw""")
def descriptions(spark, sf):
    i = F.col("photo_id")
    strengths = F.slice(F.array(F.lit("light"), F.lit("eyes")), F.lit(1), (i % 3).cast("int"))
    out = T.description(F.when(i % 7 == 0, "A caption"), F.when(i % 2 == 0, "clear"), strengths, F.when(F.col("lap").isNull(), F.array(F.lit("soft"))))
    return rows(spark, sf).select("photo_id", out.alias("description"))


_SUBJECT = "CASE scene " + " ".join(f"WHEN '{k}' THEN {{}}" for k in ("portrait", "wildlife", "event", "stilllife")) + " {} END"
_SCENES = [T.SCENES[k] for k in ("portrait", "wildlife", "event", "stilllife")]
_WITH = _SUBJECT.format(*[f"'{w[0].upper() + w[1:]}'" for w, _ in _SCENES], "ELSE 'Photograph of'")
_ALONE = _SUBJECT.format(*[f"'{n[0].upper() + n[1:]}'" for _, n in _SCENES], "ELSE 'Photograph (scene: ' || scene || ')'")


@query(f"""WITH {_ROW} SELECT photo_id, array_to_string(list_filter([CASE photo_id % 4 WHEN 0 THEN {_ALONE} WHEN 1 THEN {_WITH} || ' Ada' ELSE {_WITH} || ' Ada and  Bo' END || coalesce(' at ' || place, ''),
 '{T.SCORE_WORD} ' || printf('%.2f', floor(score_final * 100) / 100), CASE decision WHEN 'keep' THEN '保留' WHEN 'maybe' THEN '待定' ELSE '建议剔除' END, CASE WHEN photo_id % 10 = 0 THEN '{T.PEAK_WORD}' END, CASE WHEN photo_id % 2 = 0 THEN 'sharp eyes' END], lambda x: x IS NOT NULL), '{T.JOINT}') AS caption FROM rw""")
def captions(spark, sf):
    i = F.col("photo_id")
    out = T.caption(F.col("scene"), F.col("people"), F.col("place"), F.floor(F.col("score_final") * 100) / 100.0, F.col("decision"), i % 10 == 0, F.when(i % 2 == 0, F.array(F.lit("sharp eyes (0.93)"), F.lit("light"))))
    return rows(spark, sf).select("photo_id", out.alias("caption"))


@query("""SELECT doc_id, substr(sha256(text), 1, 16) || CASE doc_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.cr3' ELSE '.jpg' END AS name FROM documents""")
def hashed_names(spark, sf):
    i = F.col("doc_id")
    name = F.when(i % 4 == 0, "a/b/IMG.JPG").when(i % 4 == 1, "pack.Tar.GZ").when(i % 4 == 2, "x.y/raw.CR3").otherwise(".hidden")
    return table(spark, sf, "documents").select("doc_id", T.hashed_name(name, F.col("text")).alias("name"))


@query(f"""WITH n AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'Display P3' WHEN 1 THEN 'sRGB IEC61966-2.1' WHEN 2 THEN 'Adobe RGB (1998)' WHEN 3 THEN 'ROMM RGB' WHEN 4 THEN 'Rec. 2020' WHEN 5 THEN 'DCI-P3' WHEN 6 THEN 'camera' WHEN 7 THEN '' END AS d, CASE event_id % 4 WHEN 0 THEN ' Crowd laughing ' WHEN 1 THEN 'Hand-clapping' WHEN 2 THEN 'musical instrument' END AS l FROM events)
 SELECT event_id, coalesce({_first("regexp_replace(lower(d), '[ ._-]', '', 'g')", T.PROFILES)}, 'unknown') AS profile, {_first('lower(trim(l))', T.SOUNDS)} AS sound, event_id % 5 IN (0, 1, 3) AS drone FROM n""")
def names_of_things(spark, sf):
    i = F.col("event_id")
    pick = lambda n, values: F.coalesce(*[F.when(i % n == k, v) for k, v in enumerate(values)])
    profile = pick(9, ["Display P3", "sRGB IEC61966-2.1", "Adobe RGB (1998)", "ROMM RGB", "Rec. 2020", "DCI-P3", "camera", ""])
    drone = T.is_drone(pick(5, [" DJI ", None, "Canon"]), pick(5, [None, "FC3582", "EOS", "L2D-20c"]), pick(5, ["a.jpg", "b.jpg", "c.jpg", "d.jpg", "e_DJI_1.jpg"]))
    return table(spark, sf, "events").select("event_id", T.profile_name(profile).alias("profile"), T.sound_kind(pick(4, [" Crowd laughing ", "Hand-clapping", "musical instrument"])).alias("sound"), drone.alias("drone"))


@query("""WITH s AS (SELECT event_id % 3000 AS name, 0 AS source, CASE WHEN event_id % 3 = 0 THEN 'a/' || event_id END AS path FROM events UNION ALL SELECT event_id % 2500, 1, 'b/' || event_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id % 4000, 2, 'c/' || event_id FROM events)
 SELECT name, path, CAST(source AS INT) AS source FROM s WHERE path <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY source, path) = 1""")
def paths_by_source(spark, sf):
    e = table(spark, sf, "events")
    at = lambda n, path, keep=F.lit(True): e.filter(keep).select((F.col("event_id") % n).alias("name"), path.alias("path"))
    i = F.col("event_id")
    return T.first_of_sources([at(3000, F.when(i % 3 == 0, F.concat(F.lit("a/"), i))), at(2500, F.concat(F.lit("b/"), i), i % 2 == 0), at(4000, F.concat(F.lit("c/"), i))], "name", "path")


@query("""WITH b AS (SELECT user_id AS scope, 'key' || event_id % 7 AS chord, event_type AS action FROM events) SELECT scope, chord, count(DISTINCT action) AS actions, array_to_string(list_sort(list(DISTINCT action)), ',') AS which FROM b GROUP BY ALL HAVING count(DISTINCT action) >= 2""")
def key_conflicts(spark, sf):
    b = table(spark, sf, "events").select(F.col("user_id").alias("scope"), F.concat(F.lit("key"), F.col("event_id") % 7).alias("chord"), F.col("event_type").alias("action"))
    return T.conflicts(b, "scope", "chord", "action").withColumn("which", F.array_join("which", ","))


@query(f"""WITH {_ROW}, g AS (SELECT *, CASE photo_id % 5 WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 WHEN 2 THEN 16.0 WHEN 3 THEN 1.0 END AS w, CASE photo_id % 5 WHEN 0 THEN 2.0 WHEN 1 THEN 3.0 WHEN 2 THEN 9.0 ELSE 1.0 END AS h FROM rw),
 v AS (SELECT *, coalesce(NOT (abs(w / h - 1.5) / 1.5 <= 0.02 OR abs(w / h - 1 / 1.5) / (1 / 1.5) <= 0.02), false) AS wide, decision = 'keep' AS s1, decision = 'keep' AND scene = 'portrait' AS s2 FROM g)
 SELECT photo_id, array_to_string(list_filter([CASE WHEN wide THEN 'aspect' END, CASE WHEN s1 AND luma < 40 THEN 'dark' END, CASE WHEN s2 AND lap < 10 THEN 'soft' END], lambda x: x IS NOT NULL), ',') AS broken, CASE WHEN s2 AND lap < 10 THEN 'cull' WHEN s1 AND luma < 40 THEN 'maybe' END AS new_decision, 1 + CAST(s1 AS INT) + CAST(s2 AS INT) AS looked_at FROM v""")
def style_guide(spark, sf):
    i = F.col("photo_id")
    w = F.when(i % 5 == 0, 3.0).when(i % 5 == 1, 2.0).when(i % 5 == 2, 16.0).when(i % 5 == 3, 1.0)
    h = F.when(i % 5 == 0, 2.0).when(i % 5 == 1, 3.0).when(i % 5 == 2, 9.0).otherwise(1.0)
    broken, floor, looked = T.guide_violations(F.col("decision"), F.col("scene"), [("aspect", "", ~T.aspect_fits(w, h, [1.5]), "advisory"), ("dark", "keep_only", F.col("luma") < 40, "maybe"), ("soft", "portrait_keepers", F.col("lap") < 10, "cull")])
    return rows(spark, sf).select("photo_id", F.array_join(broken, ",").alias("broken"), floor.alias("new_decision"), looked.alias("looked_at"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'reject' WHEN 2 THEN 'Borderline' WHEN 3 THEN 'nan' WHEN 4 THEN '3.0' WHEN 5 THEN '' END AS raw FROM events)
 SELECT event_id, CASE event_id % 7 WHEN 4 THEN 3.0 END AS number, CAST(CASE event_id % 7 WHEN 4 THEN 3 END AS INT) AS whole, CASE WHEN event_id % 7 IN (3, 5, 6) THEN '' ELSE raw END AS clean, CASE event_id % 7 WHEN 0 THEN 'keep' WHEN 1 THEN 'cull' WHEN 2 THEN 'maybe' ELSE '' END AS label,
 event_id % 3 = 0 AS flagged, len(CASE WHEN event_id % 2 = 0 THEN [1, 2] ELSE [7] END) AS listed, CASE event_id % 7 WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS stars, CASE WHEN event_id % 2 = 0 THEN -(40 + 30 / 60.0 + 36 / 3600.0) ELSE 40 + 30 / 60.0 + 36 / 3600.0 END AS degrees,
 'run' || chr(31) || 'f' || event_id || chr(31) || '12' AS entry FROM r""")
def cleaned_fields(spark, sf):
    i = F.col("event_id")
    raw = F.coalesce(*[F.when(i % 7 == k, v) for k, v in enumerate((" Yes ", "reject", "Borderline", "nan", "3.0", ""))])
    flags = F.when(i % 3 == 0, "a, smile ,b").otherwise("smiles,b")
    return table(spark, sf, "events").select(
        "event_id", C.number(raw).alias("number"), C.whole_number(raw).alias("whole"), C.clean_text(raw).alias("clean"), C.label(F.coalesce(raw, F.lit(""))).alias("label"), C.has_flag(flags, "smile").alias("flagged"),
        F.size(C.int_list(F.when(i % 2 == 0, "[1, 2]").otherwise("[7]"))).cast("long").alias("listed"), C.decision_rating(C.label(F.coalesce(raw, F.lit(""))))["stars"].alias("stars"), C.degrees(F.lit(40.0), F.lit(30.0), F.lit(36.0), F.when(i % 2 == 0, "s").otherwise("n")).alias("degrees"),
        C.entry_key(F.lit("run"), F.concat(F.lit("f"), i), F.lit(12.7)).alias("entry"),
    )


@query("""WITH p AS (SELECT event_id, [(event_id % 11) / 10.0, (event_id % 7) / 10.0, (event_id % 5) / 10.0] AS v FROM events), s AS (SELECT event_id, v[1] * 2.0 AS a, v[2] * 0.5 AS b, v[3] AS c FROM p),
 n AS (SELECT event_id, CASE WHEN a + b + c > 0 THEN a / (a + b + c) ELSE a END AS a, CASE WHEN a + b + c > 0 THEN b / (a + b + c) ELSE b END AS b, CASE WHEN a + b + c > 0 THEN c / (a + b + c) ELSE c END AS c FROM s),
 o AS (SELECT *, list_sort([{'p': -a, 'k': 'a'}, {'p': -b, 'k': 'b'}, {'p': -c, 'k': 'c'}]) AS o FROM n)
 SELECT event_id, a, b, c, CASE WHEN o[2].p - o[1].p < 0.1 THEN 'unknown' ELSE o[1].k END AS scene, CASE event_id % 4 WHEN 0 THEN a >= 0.3 WHEN 1 THEN a <= 0.3 WHEN 2 THEN a > 0.3 ELSE a < 0.3 END AS passes, CASE event_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'y' END AS from_scene, CASE event_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'x' ELSE 'y' END AS vertical FROM o""")
def label_margins(spark, sf):
    i = F.col("event_id")
    p = F.create_map(*[x for k, n in (("a", 11), ("b", 7), ("c", 5)) for x in (F.lit(k), (i % n) / 10.0)])
    e = table(spark, sf, "events").withColumn("p", C.with_priors(p, F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(0.5))))
    op = F.when(i % 4 == 0, ">=").when(i % 4 == 1, "<=").when(i % 4 == 2, ">").otherwise("<")
    scene, vertical = T.scene_and_vertical(F.when(i % 3 == 0, "x").when(i % 3 == 1, "y").otherwise(" "), F.when(i % 3 == 1, "x").when(i % 3 == 2, "y"))
    return e.select("event_id", F.col("p")["a"].alias("a"), F.col("p")["b"].alias("b"), F.col("p")["c"].alias("c"), C.margin_label(F.col("p"), 0.1).alias("scene"), C.passes(F.col("p")["a"], F.lit(0.3), op).alias("passes"), scene.alias("from_scene"), vertical.alias("vertical"))


@query("""SELECT event_id, CAST(('0x' || substr(sha256('k' || event_id), 1, 8))::BIGINT % 5 AS INT) AS choice, CASE event_id % 4 WHEN 0 THEN 1704067200.0::DOUBLE WHEN 1 THEN 1704067200.0::DOUBLE WHEN 2 THEN 12.5::DOUBLE END AS seconds,
 CASE event_id % 4 WHEN 0 THEN 'soft: 0.25' WHEN 1 THEN 'count 25' WHEN 2 THEN 'off by 12.5%' ELSE 'plain' END AS phrase, CASE WHEN event_id % 2 = 0 THEN 1 - (event_id % 5 * 1.0) / sqrt((event_id % 5) * (event_id % 5) + 1.0) ELSE 0.0::DOUBLE END AS distance FROM events""")
def choices_and_times(spark, sf):
    i = F.col("event_id")
    stamp = F.when(i % 4 == 0, "2024:01:01 00:00:00").when(i % 4 == 1, "2024-01-01T00:00:00").when(i % 4 == 2, "12.5").otherwise("never")
    phrase = F.when(i % 4 == 0, "soft: {value:.2f}").when(i % 4 == 1, "count {value:.0f}").when(i % 4 == 2, "off by {value:.1%}").otherwise("plain")
    value = F.when(i % 4 == 0, 0.25).when(i % 4 == 1, 25.0).when(i % 4 == 2, 0.125)
    a, b = F.array((i % 5).cast("double"), F.lit(1.0)), F.when(i % 2 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0)))
    return table(spark, sf, "events").select("event_id", C.stable_choice(F.concat(F.lit("k"), i), F.lit(5)).alias("choice"), C.timestamp(stamp).alias("seconds"), T.formatted(phrase, value).alias("phrase"), C.cosine_distance(a, b).alias("distance"))
