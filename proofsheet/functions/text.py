"""Text of captions, transcripts, keywords, names and replies, as expressions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of a ceremony and the moments they mark, the first that occurs.
CEREMONY = [
    ("i, take you to be my", "vows"), ("to have and to hold", "vows"), ("from this day forward", "vows"), ("for better or for worse", "vows"), ("till death do us part", "vows"), ("vows", "vows"), ("我愿意", "vows"),
    ("exchange rings", "ring_exchange"), ("with this ring", "ring_exchange"), ("place this ring", "ring_exchange"), ("the rings", "ring_exchange"), ("交换戒指", "ring_exchange"),
    ("you may now kiss", "kiss"), ("you may kiss the bride", "kiss"), ("kiss the bride", "kiss"), ("kiss the partner", "kiss"), ("first kiss as", "kiss"),
    ("i now pronounce you", "pronouncement"), ("by the power vested in me", "pronouncement"), ("husband and wife", "pronouncement"), ("wife and wife", "pronouncement"), ("husband and husband", "pronouncement"),
    ("first dance", "first_dance"), ("their first dance", "first_dance"), ("请新郎新娘跳第一支舞", "first_dance"),
    ("cake cutting", "cake_cutting"), ("cut the cake", "cake_cutting"), ("cutting the cake", "cake_cutting"), ("切蛋糕", "cake_cutting"),
    ("to the bride and groom", "toast"), ("raise a glass", "toast"), ("raise our glasses", "toast"), ("举杯", "toast"),
    ("敬茶", "tea_ceremony"), ("tea ceremony", "tea_ceremony"), ("三鞠躬", "bow"), ("跪拜", "bow"),
]
#: Parts of sound labels and the kind of event they mean.
SOUNDS = [("laughter", "laughter"), ("laugh", "laughter"), ("giggle", "laughter"), ("applause", "applause"), ("clap", "applause"), ("cheer", "applause"), ("music", "music"), ("singing", "music"), ("instrument", "music")]
#: Parts of colour profile names, without blanks and marks, and the canonical name.
PROFILES = [("displayp3", "Display P3"), ("prophoto", "ProPhoto RGB"), ("rommrgb", "ProPhoto RGB"), ("adobergb", "Adobe RGB"), ("rec2020", "Rec. 2020"), ("bt2020", "Rec. 2020"), ("rec709", "Rec. 709"), ("dcip3", "DCI-P3"), ("srgb", "sRGB"), ("iec61966", "sRGB")]
#: Makers, and beginnings of model names, of cameras on drones.
DRONE_MAKER, DRONE_MODELS, DRONE_FILE = "dji", ["L1D", "L2D", "L1P", "ZH", "HG"], "DJI_"
#: Marks that end a sentence or a clause, and the least characters of a clause.
SENTENCE_ENDS, CLAUSE_ENDS, CLAUSE = "。！？!?…", "，,、；;：:", 10
#: A clause: up to a sentence mark, or, from CLAUSE characters on, to a clause mark; or what is left.
CLAUSE_PATTERN = f"(?s)[^{SENTENCE_ENDS}]{{0,{CLAUSE - 1}}}[{SENTENCE_ENDS}]|[^{SENTENCE_ENDS}]{{{CLAUSE - 1}}}[^{SENTENCE_ENDS}{CLAUSE_ENDS}]*[{SENTENCE_ENDS}{CLAUSE_ENDS}]|.+"
#: How a caption names a scene with and without people.
SCENES = {
    "portrait": ("portrait photo of", "portrait photograph"), "wildlife": ("wildlife photo featuring", "wildlife photograph"), "event": ("event photo capturing", "event photograph"),
    "landscape": ("landscape image including", "landscape image"), "stilllife": ("studio composition of", "studio composition"), "street": ("street photograph showing", "street photograph"),
    "architecture": ("architectural photograph with", "architectural photograph"), "documentary": ("documentary photograph of", "documentary photograph"), "fashion": ("fashion editorial featuring", "fashion editorial"),
    "macro": ("macro photograph of", "macro photograph"), "food": ("food photography with", "food photograph"), "sports": ("sports action shot of", "sports photograph"),
    "astro": ("astrophotograph with", "astrophotograph"), "abstract": ("abstract composition with", "abstract composition"),
}
#: How a caption gives the score, the decision and a burst's peak, and what joins its parts.
SCORE_WORD, DECISION_WORDS, PEAK_WORD, JOINT = "综合分", {"keep": "保留", "maybe": "待定", "cull": "建议剔除"}, "连拍峰值", " · "


def first_match(text: Column, vocabulary: list[tuple[str, str]]) -> Column:
    """The meaning of the first phrase of the vocabulary that the text contains; null if none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), m) for p, m in vocabulary])


def ceremony_moment(text: Column) -> Column:
    return first_match(F.lower(text), CEREMONY)


def sound_kind(label: Column) -> Column:
    return first_match(F.lower(F.trim(label)), SOUNDS)


def profile_name(description: Column) -> Column:
    """The canonical name of a colour profile; unknown for others and for none."""
    return F.coalesce(first_match(F.regexp_replace(F.lower(description), r"[\s\-_.]", ""), PROFILES), F.lit("unknown"))


def is_drone(make: Column, model: Column, filename: Column) -> Column:
    """Whether maker, model or file name are those of a camera on a drone."""
    name = F.upper(F.trim(F.coalesce(model, F.lit(""))))
    models = reduce(lambda a, b: a | b, [name.startswith(p) for p in DRONE_MODELS])
    maker = F.lower(F.trim(F.coalesce(make, F.lit("")))) == DRONE_MAKER
    return maker | name.rlike("^FC[0-9]") | models | F.upper(F.coalesce(filename, F.lit(""))).startswith(DRONE_FILE)


def scene_and_vertical(scene: Column, vertical: Column) -> tuple[Column, Column]:
    """Each of the two filled from the other where it is missing or empty."""
    a, b = F.nullif(F.trim(scene), F.lit("")), F.nullif(F.trim(vertical), F.lit(""))
    return F.coalesce(a, b), F.coalesce(b, a)


def formatted(phrase: Column, value: Column) -> Column:
    """A phrase with its {value:.2f}, {value:.0f}, {value:.1%} or {value:.0%} filled in; untouched where the value is missing."""
    out = phrase
    for mark, text in (("{value:.2f}", F.format_string("%.2f", value)), ("{value:.0f}", F.format_string("%.0f", value)), ("{value:.1%}", F.format_string("%.1f%%", value * 100)), ("{value:.0%}", F.format_string("%.0f%%", value * 100))):
        out = F.replace(out, F.lit(mark), text)
    return F.when(value.isNull(), phrase).otherwise(out)


def hashed_name(name: Column, content: Column) -> Column:
    """The beginning of the content's SHA-256, with the name's endings in lower case (.jpg if it has none)."""
    base = F.regexp_extract(name, "[^/]*$", 0)
    endings = F.when(base.endswith("."), "").otherwise(F.lower(F.regexp_extract(F.regexp_replace(base, r"^\.+", ""), r"^[^.]*(\..*)?$", 1)))
    return F.concat(F.substring(F.sha2(content, 256), 1, 16), F.when(endings == "", ".jpg").otherwise(endings))


def json_reply(text: Column) -> Column:
    """The JSON object of a model's reply: without its thoughts, out of its fence, or what stands between the outer braces; null if none."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(bare.rlike(r"(?s)```(?:json)?\s*.*?```"), F.trim(fenced)).otherwise(bare)
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.when(~F.contains(bare, F.lit("<think>")), F.coalesce(valid(F.nullif(body, F.lit(""))), valid(F.nullif(braces, F.lit("")))))


def keywords(prefix: str, decision: Column, scene: Column, vertical: Column, run: Column, judge: Column, people: Column) -> Column:
    """Catalogue keywords of a photo, each under the prefix; people: an array of names, of which empty ones and repeats go."""
    known = lambda x: F.nullif(F.trim(x), F.lit(""))
    key = lambda name, x: F.concat(F.lit(f"{prefix}:{name}"), x)
    names = F.array_distinct(F.filter(F.transform(F.coalesce(people, F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: F.coalesce(p != "", F.lit(False))))
    one = F.array_compact(F.array(key("", F.when(decision.isin("keep", "maybe", "cull"), decision)), key("scene:", known(scene)), key("vertical:", known(vertical)), key("run:", F.right(known(run), F.lit(4))), key("judged-by:", known(judge))))
    return F.concat(one, F.transform(names, lambda p: key("person:", p)))


def description(caption: Column, rationale: Column, strengths: Column, weaknesses: Column) -> Column:
    """The caption, or else the judge's reason, the strengths and the weaknesses, a line each."""
    marked = lambda mark, xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.concat(F.lit(mark), x))
    why = F.array_compact(F.array(F.concat(F.lit("◇ "), F.nullif(F.trim(rationale), F.lit("")))))
    return F.coalesce(F.nullif(caption, F.lit("")), F.array_join(F.concat(why, marked("+ ", strengths), marked("- ", weaknesses)), "\n"))


def caption(scene: Column, people: Column, place: Column, score: Column, decision: Column, is_peak: Column, strengths: Column) -> Column:
    """One line: who or what and where, the score, the decision, whether it is a burst's peak, and the first strength without its measure."""
    with_people = F.create_map(*[F.lit(x) for k, (w, _) in SCENES.items() for x in (k, w[0].upper() + w[1:])])
    alone = F.create_map(*[F.lit(x) for k, (_, n) in SCENES.items() for x in (k, n[0].upper() + n[1:])])
    names = F.array_distinct(F.filter(F.coalesce(people, F.array().cast("array<string>")), lambda p: F.coalesce(F.trim(p) != "", F.lit(False))))
    named = F.concat_ws(" ", F.coalesce(F.try_element_at(with_people, scene), F.lit("Photograph of")), F.array_join(names, " and "))
    bare = F.coalesce(F.try_element_at(alone, scene), F.when(scene != "", F.concat(F.lit("Photograph (scene: "), scene, F.lit(")"))), F.lit("Photograph"))
    subject = F.concat(F.when(F.size(names) > 0, named).otherwise(bare), F.coalesce(F.concat(F.lit(" at "), F.nullif(F.trim(place), F.lit(""))), F.lit("")))
    words = F.create_map(*[F.lit(x) for k, v in DECISION_WORDS.items() for x in (k, v)])
    strength = F.nullif(F.trim(F.regexp_replace(F.try_element_at(strengths, F.lit(1)), r"\s*[(（].*?[)）]", "")), F.lit(""))
    return F.concat_ws(JOINT, subject, F.when(score.isNotNull(), F.concat(F.lit(SCORE_WORD + " "), F.format_string("%.2f", score))), F.try_element_at(words, decision), F.when(is_peak, PEAK_WORD), strength)


def distinct_speakers(segments: DataFrame, clip: str, speaker: str) -> DataFrame:
    """segments with the speaker null in clips where no two are told apart. Extremes of a clip say it: no set is gathered."""
    ends = segments.groupBy(clip).agg((F.min(speaker) < F.max(speaker)).alias("_told"))
    return segments.join(ends, clip).withColumn(speaker, F.when(F.col("_told"), F.col(speaker))).drop("_told")


def clauses(text: Column, times: Column) -> Column:
    """A transcript as clauses (text, start, end in seconds).

    times: milliseconds (a, b) of each character that is neither a mark nor blank. Sentence marks end a clause always, clause
    marks from CLAUSE characters on. If characters and times don't agree in number, the whole text is one clause.
    """
    trimmed = F.trim(text)
    times = F.filter(times, lambda p: p.isNotNull() & p["a"].isNotNull() & p["b"].isNotNull())
    spoken = lambda x: F.length(F.regexp_replace(x, rf"[{SENTENCE_ENDS}{CLAUSE_ENDS}\s]", ""))
    piece = "array<struct<text: string, a: double, b: double>>"
    # the pieces with the number of spoken characters before each
    counted = F.transform(F.regexp_extract_all(trimmed, F.lit(CLAUSE_PATTERN), F.lit(0)), lambda x: F.struct(F.trim(x).alias("text"), spoken(x).alias("n")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text: string, n: int, at: int>>").alias("out"))
    placed = F.aggregate(counted, none, lambda acc, x: F.struct((acc["at"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(x["text"], x["n"], acc["at"].alias("at")))).alias("out")), lambda acc: acc["out"])
    second = lambda i, end: F.get(times, i)[end].cast("double") / 1000
    cut = F.transform(F.filter(placed, lambda x: x["n"] > 0), lambda x: F.struct(x["text"].alias("text"), second(x["at"], "a").alias("a"), second(x["at"] + x["n"] - 1, "b").alias("b")))
    whole = F.array(F.struct(trimmed.alias("text"), second(F.lit(0), "a").alias("a"), second(F.size(times) - 1, "b").alias("b")))
    empty = (trimmed == "") | (F.size(times) == 0) | text.isNull() | times.isNull()
    return F.when(empty, F.array().cast(piece)).when(spoken(trimmed) != F.size(times), whole).otherwise(cut)


def first_of_sources(sources: list[DataFrame], name: str, path: str) -> DataFrame:
    """name and path from the first source that has the name with a path (the first path by name order within a source)."""
    rows = reduce(DataFrame.unionByName, [s.select(name, path, F.lit(i).alias("source")) for i, s in enumerate(sources)]).filter(F.coalesce(F.col(path) != "", F.lit(False)))
    return rows.groupBy(name).agg(F.min(F.struct("source", path)).alias("f")).select(name, f"f.{path}", "f.source")


def conflicts(bindings: DataFrame, scope: str, chord: str, action: str) -> DataFrame:
    """Chords that mean two or more actions in one scope."""
    return bindings.groupBy(scope, chord).agg(F.count_distinct(action).alias("actions"), F.sort_array(F.collect_set(action)).alias("which")).filter("actions >= 2")


def aspect_fits(width: Column, height: Column, ratios: list[float], tolerance: float = 0.02) -> Column:
    """Whether a picture has one of the ratios, upright or on its side; null if its size is unknown."""
    actual = F.when((width > 0) & (height > 0), width / height)
    return reduce(lambda a, b: a | b, [F.abs(actual - t) / t <= tolerance for r in ratios for t in (r, 1 / r)])


def guide_violations(decision: Column, scene: Column, rules: list[tuple[str, str, Column, str]]) -> tuple[Column, Column, Column]:
    """Of style rules (id, scope, broken, level): the ids broken, the worst level that changes a decision, and the rules looked at."""
    scopes = {"": F.lit(True), "keep_only": decision == "keep", "portrait_keepers": (decision == "keep") & (scene == "portrait")}
    hits = [(i, F.coalesce(scopes[s], F.lit(False)), F.coalesce(b, F.lit(False)), level) for i, s, b, level in rules]
    broken = F.array_compact(F.array(*[F.when(s & b, i) for i, s, b, _ in hits]))
    at = lambda level: reduce(lambda a, b: a | b, [s & b for _, s, b, x in hits if x == level], F.lit(False))
    return broken, F.when(at("cull"), "cull").when(at("maybe"), "maybe"), reduce(lambda a, b: a + b, [s.cast("int") for _, s, _, _ in hits])


