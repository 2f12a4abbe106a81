"""Text functions as Catalyst expressions: Turkish-aware keys, tokens, wrapping, splitting, checks.

Java regular expressions treat letters and case as ASCII unless told otherwise, so (?U) and (?iu) are stated wherever the
meaning is Unicode; boundaries that are ASCII by definition stay so.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: they decide results and are stated as they are ---
MAX_LINE = 42
MAX_CPS = 17.0
SPELLING_VARIANTS = {
    "vallahi": "valla", "bayağı": "baya", "tabii": "tabi", "abiciğim": "abicim", "ayy": "ay", "ayyy": "ay",
    "eee": "ee", "ııı": "ıı", "yoo": "yo", "okay": "okey", "hımm": "hım",
}
FILLERS = ["ya", "yani", "ay", "ee", "ıı", "ha", "hı", "hım", "aa", "e", "ah", "of", "eh", "oo", "ıh", "mm", "hmm"]
TURKISH_WORD = "A-Za-z0-9_çğıöşüÇĞİÖŞÜ"
ANNOTATION = r"\([^)]*\)|\[[^\]]*\]|♪[^♪]*♪|♪"
SOUND_CUE = r"\([^)]*\)|\[[^\]]*\]|♪|♫"
LYRICS = "(?iu)♪|çalıyor|şarkı|müzik"


def quote(text: str) -> str:
    """A literal for Java regular expressions."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", text)


def quote_replacement(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)


def lstrip(text: Column) -> Column:
    """Without white space of any kind at the start; ltrim() knows blanks only."""
    return F.regexp_replace(text, r"(?U)^\s+", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def strip(text: Column) -> Column:
    return rstrip(lstrip(text))


def bound(value: Column, body) -> Column:
    """body of a value that is computed once: inside a lambda, Catalyst repeats a plain subexpression at every use."""
    return F.transform(F.array(value), body)[0]


def turkish_lower(text: Column) -> Column:
    """Lower case with dotted and dotless i kept apart; collations and lower() alone don't do this."""
    return F.lower(F.translate(text, "İI", "iı"))


def words_of(text: Column) -> Column:
    """Runs without white space, none empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def phrase_key(text: Column) -> Column:
    """Key of a whole utterance: trimmed, without its final .!?, Turkish lower case."""
    return turkish_lower(F.regexp_replace(strip(text), r"[.!?]+\z", ""))


def carry_mark(source: Column, translation: Column) -> Column:
    """A source that ends in ! or ? gives its mark to a translation that ends in a full stop."""
    tail = F.right(rstrip(source), F.lit(1))
    return F.when(tail.isin("!", "?") & translation.endswith("."), F.concat(F.substring(translation, F.lit(1), F.length(translation) - 1), tail)).otherwise(translation)


def phantom_key(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.translate(text, "İI", "iı"), f"[^{TURKISH_WORD}]+", " ")))


def is_phantom(text: Column, patterns: list[str]) -> Column:
    """Whether the whole of a cue is one of the known phantom phrases."""
    key = phantom_key(text)
    return reduce(lambda a, b: a | b, [key.rlike(f"^(?:{p})$") for p in patterns], F.lit(False))


def apply_corrections(text: Column, corrections: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Text after whole-word replacements in order, and how many there were; each counts on the text that it meets."""
    n = F.lit(0)
    for heard, correct in corrections:
        pattern = f"(?<![{TURKISH_WORD}]){quote(heard)}(?![{TURKISH_WORD}])"
        n = n + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, quote_replacement(correct))
    return text, n


def collapse_repeats(text: Column) -> Column:
    """A word said three times or more in a row is left twice."""
    return F.regexp_replace(text, r"(?iU)\b(\w+)(?:[\s,.!?…-]+\1\b){2,}", "$1 $1")


def score_tokens(text: Column, keep_annotations: bool = False, content: bool = False) -> Column:
    """Tokens for word error rate: no annotations, Turkish lower case, circumflexes folded, apostrophes joined, no punctuation."""
    if not keep_annotations:
        text = F.regexp_replace(text, ANNOTATION, " ")
    text = F.translate(turkish_lower(text), "âîû", "aiu")
    text = F.regexp_replace(F.regexp_replace(text, "['’`]", ""), r"(?U)[^\w\s]|_", " ")
    tokens = words_of(text)
    if content:
        variants = F.create_map(*[F.lit(x) for pair in SPELLING_VARIANTS.items() for x in pair])
        tokens = F.filter(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(variants, t), t)), lambda t: ~t.isin(FILLERS))
    return tokens


def clean_for_ngrams(text: Column) -> Column:
    """No tags, sound cues or dialogue dashes, single spaces."""
    text = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), SOUND_CUE, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)(^|\s)-\s*", " "), r"(?U)\s+", " "))


def wrap_balanced(text: Column, width: int = MAX_LINE) -> Column:
    """Two lines of about equal length: the split with the least difference, plus 3 away from punctuation, plus 100 where a line is
    too long; the first of equals. Texts that fit, and single words, stay."""
    # A split loses 103 points at most away from the middle, so only spaces near it can win; long lines cost no more than short ones.
    def places(x: Column) -> Column:
        before = F.when(F.contains(x["left"], F.lit(" ")), F.length(x["left"]) - F.length(F.substring_index(x["left"], " ", -1)))
        after = F.nullif(F.call_function("locate", F.lit(" "), text, F.length(x["left"]) + 1), F.lit(0))
        reach = F.least(F.abs(2 * before - 1 - x["size"]), F.abs(2 * after - 1 - x["size"])) + 104
        return F.struct(x["size"].alias("size"), reach.alias("reach"), F.greatest(F.lit(1), F.floor((x["size"] + 1 - reach) / 2).cast("int")).alias("low"))

    def around(x: Column) -> Column:
        # one letter more in front, for the mark before a space
        return F.struct(x["size"].alias("size"), x["low"].alias("low"), F.concat(F.when(x["low"] > 1, F.substring(text, x["low"] - 1, F.lit(1))).otherwise("x"), F.substring(text, x["low"], x["reach"] + 2)).alias("near"))

    def best(x: Column) -> Column:
        def scored(k: Column) -> Column:
            p = x["low"] + k - 2
            mark = F.substring(x["near"], k - 1, F.lit(1)).isin(*",.?!:;")
            long = (p - 1 > width) | (x["size"] - p > width)
            return F.struct((F.abs(2 * p - 1 - x["size"]) + F.when(mark, 0).otherwise(3) + F.when(long, 100).otherwise(0)).alias("cost"), p.alias("at"))

        spaces = F.filter(F.sequence(F.lit(2), F.length(x["near"])), lambda k: F.substring(x["near"], k, F.lit(1)) == " ")
        return F.array_min(F.transform(spaces, scored))["at"]

    start = F.struct(F.length(text).alias("size"), F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int") + 1).alias("left"))
    at = bound(bound(bound(start, places), around), best)
    split = bound(at, lambda p: F.concat(F.substring(text, F.lit(1), p - 1), F.lit("\n"), F.substring(text, p + 1, F.length(text))))
    return F.when((F.length(text) <= width) | ~F.contains(text, F.lit(" ")), text).otherwise(split)


def wrap_greedy(text: Column, width: int = MAX_LINE) -> Column:
    """Lines filled word by word; texts with lines or a leading dash, and those that fit, stay. Words longer than a line are broken."""
    pieces = F.flatten(F.transform(words_of(text), lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / width).cast("int")), lambda k: F.substring(t, k * width + 1, F.lit(width)))))
    lines = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda acc, t: F.when(
            (F.size(acc) > 0) & (F.length(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))) + F.length(t) < width),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(acc, F.lit(-1)), t))),
        ).otherwise(F.concat(acc, F.array(t))),
    )
    return F.when(F.contains(text, F.lit("\n")) | (F.length(text) <= width) | text.startswith("-"), text).otherwise(F.array_join(lines, "\n"))


def split_sentences(text: Column) -> Column:
    """Sentences with their punctuation, or null where there are fewer than two."""
    parts = F.filter(F.split(strip(text), r"(?U)(?<=[.!?…])\s+"), lambda s: s != "")
    return F.when(F.size(parts) > 1, parts)


def split_dash_lines(text: Column) -> Column:
    """The turns of a text all of whose lines, two at least, start with a dash; else null."""
    lines = F.split(text, "\n")
    return F.when((F.size(lines) > 1) & F.forall(lines, lambda x: x.startswith("-")), F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^-\s*", "")))


def is_run_on(text: Column) -> Column:
    return ~text.rlike("[.!?…]") & (F.size(words_of(text)) >= 8)


def chunk_words(text: Column, n: int = 6) -> Column:
    w = words_of(text)
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat(F.array_join(F.slice(w, i + 1, F.lit(n)), " "), F.lit(".")))


def bounded(pattern: str) -> str:
    """ASCII word boundaries: a form before an apostrophe or a Turkish letter still counts."""
    return f"(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def quality_flag(source: Column, target: Column) -> Column:
    """The first reason why a translation looks wrong, or null."""
    ratio = F.length(target) / F.greatest(F.length(source), F.lit(1))
    return (
        F.when(strip(target) == "", "empty")
        .when(target.rlike(bounded("X[a-z]{2}")), "placeholder leaked")
        .when(count_of(target, "([") != count_of(target, ")]"), "unbalanced bracket")
        .when(ratio < 0.25, "too short")
        .when(ratio > 3.5, "too long")
    )


def cue_flags(start: Column, end: Column, text: Column) -> Column:
    """What a reviewer would see in a cue: lines, reading speed, blank text."""
    lines = F.split(text, "\n")
    long = (F.size(lines) > 2) | F.exists(lines, lambda x: F.length(x) > MAX_LINE)
    fast = F.length(F.replace(text, F.lit("\n"), F.lit(""))) / F.greatest(end - start, F.lit(0.1)) > MAX_CPS
    return F.array_compact(F.array(F.when(long, "lines"), F.when(fast, "speed"), F.when(strip(text) == "", "blank")))


def exclaim(text: Column, interjections: list[str]) -> Column:
    """An interjection that ends a sentence or a line takes an exclamation mark; by line."""

    def line(x: Column) -> Column:
        for w in interjections:
            x = F.regexp_replace(x, rf"(?iu)(?<![{TURKISH_WORD}])({quote(w)})\.(?=\s|$)", "$1!")
            x = F.regexp_replace(x, rf"(?iu)(?<![{TURKISH_WORD}])({quote(w)})$", "$1!")
        return x

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def fix_honorifics(source: Column, english: Column) -> Column:
    """Titles that a model translated go back to the source's, after the name."""
    english = F.when(F.contains(source, F.lit("Hanım")), F.regexp_replace(english, r"(?U)\b(Madam|Mrs?\.?|Ms\.?|Miss)(?=\W|$)", "Hanım")).otherwise(english)
    english = F.when(F.contains(source, F.lit("Bey")), F.regexp_replace(english, r"(?U)\b(Sir|Mr\.?)(?=\W|$)", "Bey")).otherwise(english)
    return F.when(source.rlike("Bey|Hanım"), F.regexp_replace(english, r"(?U)\b(Bey|Hanım)\s+([A-ZÇĞİÖŞÜ]\w+)", "$2 $1")).otherwise(english)


def fix_gender(source: Column, english: Column, terms: list[tuple[str, str, str]]) -> Column:
    """(stem, right, wrong): where the source has the stem, the wrong word gives way; capital and plural stay."""
    for stem, right, wrong in terms:
        capital, small = wrong[:1].upper() + wrong[1:], wrong[:1].lower() + wrong[1:]
        fixed = F.regexp_replace(english, rf"(?U)\b{quote(capital[:1])}(?i:{quote(wrong[1:])})(s?)\b", quote_replacement(right.capitalize()) + "$1")
        fixed = F.regexp_replace(fixed, rf"(?U)\b{quote(small[:1])}(?i:{quote(wrong[1:])})(s?)\b", quote_replacement(right) + "$1")
        english = F.when(source.rlike("(?iu)" + quote(stem)), fixed).otherwise(english)
    return english


def _milliseconds(total: Column) -> Column:
    part = lambda unit, base: F.floor(total / unit) % base
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(total / 3_600_000), part(60_000, 60), part(1000, 60), total % 1000)


def timecode(seconds: Column, rounded: bool = False) -> Column:
    """hh:mm:ss,mmm; a fresh file truncates milliseconds, a re-timed one rounds half to even."""
    return _milliseconds((F.bround(seconds * 1000, 0) if rounded else seconds * 1000).cast("long"))


def seconds_of(line: Column, group: int = 1) -> Column:
    """Start (group 1) or end (2) of a timing line, in seconds."""
    pattern = r"(\d+):(\d+):(\d+)[,.](\d+) --> (\d+):(\d+):(\d+)[,.](\d+)"
    at = [F.try_to_number(F.regexp_extract(line, pattern, 4 * (group - 1) + i), F.lit("9" * 12)).cast("double") for i in (1, 2, 3, 4)]
    return at[0] * 3600 + at[1] * 60 + at[2] + at[3] / 1000


def clock(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds)
    short = F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    return F.when(s < 3600, short).otherwise(F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def series_id(path: Column) -> Column:
    found = F.regexp_extract(path, r"tvdb-(\d+)", 1)
    return F.when(found != "", found)


def safe_stem(name: Column) -> Column:
    stem = F.substring(F.trim(F.regexp_replace(name, r"(?U)[^\w .()\-]", "_")), 1, 100)
    return F.when(stem != "", stem)


def retimed_stem(stem: Column, replace: Column) -> Column:
    return F.when(replace, stem).otherwise(F.concat(stem, F.lit(".retimed")))


def english_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.tr\.srt$", ".en.srt")


def first_name(name: Column) -> Column:
    return F.element_at(words_of(name), 1)


def actor_key(normalised: Column) -> Column:
    """First and last word, so that a middle name makes no difference."""
    w = words_of(normalised)
    return F.when(F.size(w) > 0, F.struct(F.element_at(w, 1).alias("first"), F.element_at(w, -1).alias("last")))


def core_of(surface: Column) -> Column:
    """A word without final punctuation and quotation marks around it."""
    return F.regexp_replace(F.regexp_replace(surface, r"[.,!?…]+$", ""), "^[\"'“”()\\-–]+|[\"'“”()\\-–]+$", "")


def index_quantile(sorted_values: Column, share: float) -> Column:
    """The value at place int(share * (n - 1)) of a sorted array, without interpolation."""
    return F.try_element_at(sorted_values, (F.floor(F.lit(share) * (F.size(sorted_values) - 1)) + 1).cast("int"))
