"""Column functions on text, keys, times and labels.  All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stage directions that are never spoken.
DIRECTIONS = r"laughs?|sighs?|pauses?|chuckles?|clears?\s*throat|whispers?|gasps?|coughs?|smiles?|nods?|grins?|winks?|sniffs?|sobs?|giggles?|groans?|mumbles?|breathes?\s*(?:deeply|in|out)?|exhales?|inhales?"
#: Directions removed before word errors are counted.
SHORT_DIRECTIONS = ["(laughs)", "(sighs)", "(pauses)", "(clears throat)", "(whispers)"]
#: Keys and values of style objects that say nothing.
STYLE_KEYS, STYLE_VALUES = ["voice", "rate", "pitch", "volume"], ["default", "neutral", "normal"]
#: Words without content.
STOPWORDS = (
    "the and a an to of for in on at by with is are was were be been being have has had do does did i you he she it we they my "
    "your his her their our this that these those but or so if as from about what when where how why would could should will can just yeah "
    "okay sure got really into some any all more than then there here well right actually good great want wanted going make let lets let's"
).split()
#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Subsets of the judged sessions.
SUBSETS = ["daily", "correction", "entity_tracking", "safety"]
DECADES = ["teens", "twenties", "thirties", "forties", "fifties", "sixties", "seventies", "eighties", "nineties"]


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def wrap_prompt(text: Column) -> Column:
    """Put <system> marks around a prompt unless they are there."""
    bare = F.trim(text)
    return F.when(bare.startswith("<system>") & bare.endswith("<system>"), bare).otherwise(F.concat(F.lit("<system> "), bare, F.lit(" <system>")))


def unwrap_prompt(text: Column) -> Column:
    """Take the marks off, then one pair of equal quotes."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^<system>\s*", ""), r"\s*<system>$", ""))
    return F.regexp_replace(bare, r"(?s)^([\"'])(.*)\1$", "$2")


def drop_directions(text: Column) -> Column:
    """Remove (laughs) and the like."""
    return squeeze(F.regexp_replace(text, rf"(?i)\s*\((?:{DIRECTIONS})\)\s*", " "))


def drop_short_directions(text: Column) -> Column:
    """T3, the form used before word errors: lower case, five markers."""
    out = F.lower(F.trim(text))
    for marker in SHORT_DIRECTIONS:
        out = F.trim(F.replace(out, F.lit(marker), F.lit("")))
    return out


def short_style(style: Column) -> Column:
    """T4: at most three comma-separated parts; null if empty."""
    parts = F.filter(F.transform(F.split(style, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(style != "", F.when(F.size(parts) <= 3, style).otherwise(F.array_join(F.slice(parts, 1, 3), ", ")))


def style_of_object(style: Column) -> Column:
    """T4 for a map: values that say something, then as for a string."""
    kept = F.map_values(F.map_filter(style, lambda k, v: ~k.isin(STYLE_KEYS) & ~v.isin(STYLE_VALUES)))
    return short_style(F.array_join(kept, ", "))


def normal_answer(text: Column) -> Column:
    """T5: lower case, no ASCII punctuation, single spaces."""
    return squeeze(F.translate(F.lower(text), PUNCTUATION, ""))


def answer_matches(prediction: Column, target: Column) -> Column:
    """Equal, or the target at word borders inside the prediction; an empty side is false."""
    p, t = normal_answer(prediction), normal_answer(target)
    return F.coalesce((p != "") & (t != "") & F.contains(F.concat(F.lit(" "), p, F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" "))), F.lit(False))


def normal_gender(raw: Column) -> Column:
    """Male, female, other or null, from the spellings of three corpora."""
    r = F.lower(F.trim(raw))
    return F.when(r.isin("m", "male", "male_masculine", "masculine"), "male").when(r.isin("f", "female", "female_feminine", "feminine"), "female").when(r.isin("other", "other_gender"), "other")


def normal_age(raw: Column) -> Column:
    """A decade's name, or null."""
    r = F.replace(F.lower(F.trim(raw)), F.lit(" "), F.lit(""))
    return F.when(r.isin(DECADES), r)


def age_decade(age: Column) -> Column:
    """Years to a decade's name; under 13 null, 90 and more nineties."""
    out = F.when(age < 13, None).when(age < 20, DECADES[0])
    for i, name in enumerate(DECADES[1:-1], 2):
        out = out.when(age < 10 * (i + 1), name)
    return out.when(age.isNotNull(), DECADES[-1])


def normal_accent(raw: Column) -> Column:
    """One letter of a telephone corpus."""
    r = F.lower(F.trim(raw))
    return F.when(r == "a", "american").when(r == "o", "other")


def activity_seconds(spans: Column) -> Column:
    """Total length of "[(start, end), ...]"; 0 for anything else."""
    pair = r"\(\s*([0-9.]+)\s*,\s*([0-9.]+)\s*\)"
    starts, ends = (F.transform(F.regexp_extract_all(spans, F.lit(pair), k), lambda x: x.try_cast("double")) for k in (1, 2))
    return F.coalesce(F.aggregate(F.zip_with(starts, ends, lambda s, e: e - s), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def padded(number: Column, digits: int) -> Column:
    """A number with leading zeros; longer ones stay whole."""
    s = number.cast("string")
    return F.lpad(s, F.greatest(F.length(s), F.lit(digits)), F.lit("0"))


def split_key(split: Column, id_: Column, index: Column) -> Column:
    """{split}__{id or index}."""
    return F.concat_ws("__", split, F.coalesce(id_.cast("string"), index.cast("string")))


def slot_key(category: Column, slot: Column) -> Column:
    """{category}_{five digits or more}."""
    return F.concat_ws("_", category, padded(slot, 5))


def chunk_key(id_: Column, chunk: Column, of: Column) -> Column:
    """{id}_chunk{two digits}; the only chunk keeps the id."""
    return F.when(of == 1, id_).otherwise(F.concat(id_, F.lit("_chunk"), padded(chunk, 2)))


def rebase_path(path: Column, prefix: str) -> Column:
    """A relative path as seen from another folder; absolute paths stay."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(prefix.rstrip("/") + "/"), path)) if prefix else path


def source_label(path: Column, names: list[str]) -> Column:
    """The longest of the names found in the path, else unknown."""
    ordered = sorted(names, key=lambda n: (-len(n), n))
    out = F.when(F.contains(path, F.lit(ordered[0])), ordered[0])
    for name in ordered[1:]:
        out = out.when(F.contains(path, F.lit(name)), name)
    return out.otherwise("unknown")


def usable_voice(id_: Column, path: Column, text: Column, duration: Column, low: float, high: float) -> Column:
    """Not a template, a path, a text of five characters or more, a duration in range."""
    return F.coalesce(~id_.startswith("_") & path.isNotNull() & (F.length(F.trim(text)) >= 5) & duration.between(low, high), F.lit(False))


def clean_text(text: Column) -> Column:
    """Not empty, without [...] and without ((."""
    return F.coalesce((F.trim(text) != "") & ~text.rlike(r"\[[^\]]*\]") & ~F.contains(text, F.lit("((")), F.lit(False))


def bad_transcription(text: Column) -> Column:
    """Null, blank, or what looks like an object."""
    return F.coalesce(F.trim(text).isin("") | F.ltrim(text).startswith("{"), F.lit(True))


#: Metrics of which 0 means that there is none.
ZERO_IS_MISSING = ("wpm", "speech_dur_s", "mean_pitch", "std_pitch", "std_intensity")


def mask_sentinel(metric: Column, value: Column) -> Column:
    """Null for what stands for a missing value of these metrics, see ``ZERO_IS_MISSING``."""
    return F.when((metric == "mean_intensity") & (value <= -190), None).when(metric.isin(*ZERO_IS_MISSING) & (value == 0), None).otherwise(value)


def time_seconds(token: Column) -> Column:
    """T16: "h:m:s", "m:s" or a number, perhaps quoted, as seconds; null if it is none."""
    parts = F.reverse(F.transform(F.split(F.btrim(F.trim(token), F.lit("\"'")), ":"), lambda p: p.try_cast("double")))
    return F.aggregate(F.transform(parts, lambda p, i: p * F.pow(F.lit(60.0), i)), F.lit(0.0), lambda a, x: a + x)


def codec_frames(seconds: Column, per_second: float = 12.5) -> Column:
    """Whole codec frames in so many seconds."""
    return F.floor(seconds * per_second).cast("long")


def prompt_offset(start: Column, prompt_end: Column) -> Column:
    """What is left of the prompt in a chunk that begins at ``start``."""
    return F.greatest(prompt_end - start, F.lit(0.0))


def join_tokens(tokens: Column) -> Column:
    """Generated tokens without those in brackets."""
    return F.array_join(F.filter(tokens, lambda t: ~t.startswith("[")), "")


def subset_name(raw: Column) -> Column:
    """One of four names, whatever its case, spaces and underscores; anything else is an error."""
    bare = F.regexp_replace(F.lower(F.trim(raw)), "[ _]", "")
    out = F.when(bare.isin(SUBSETS[0]), SUBSETS[0])
    for name in SUBSETS[1:]:
        out = out.when(bare.isin(name.replace("_", ""), *(["corrections"] if name == "correction" else [])), name)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown subset: "), F.coalesce(raw, F.lit("null")))).cast("string"))


def snippet(words: Column, n: int = 50) -> Column:
    """The first words."""
    return F.array_join(F.slice(words, 1, n), " ")


def content_words(text: Column, longer_than: int = 5) -> Column:
    """Distinct lower-case words longer than so many characters, without stopwords."""
    words = F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"(?U)\s+")
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > longer_than)), F.array(*map(F.lit, STOPWORDS)))


def length_ratio_ok(rewrite: Column, original: Column, low: float = 0.3, high: float = 2.5) -> Column:
    """A rewrite's length is within bounds of the original's."""
    return F.length(rewrite).between(F.length(original) * low, F.length(original) * high)


def normal_verdict(raw: Column) -> Column:
    """CORRECT, INCORRECT or ERROR."""
    r = F.upper(F.trim(raw))
    return F.when(r.isin("CORRECT", "INCORRECT"), r).otherwise("ERROR")


def common_words(a: Column, b: Column) -> Column:
    """The different words of both texts, cut at single spaces."""
    return F.array_intersect(F.split(a, " "), F.split(b, " "))
