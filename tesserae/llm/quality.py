"""Line-first cleaning with built-in functions only.

Each line of a text is judged by itself: lines without a word pass, lines that look
like navigation or boilerplate fail, and long lines without closing punctuation
fail.  Failed lines are removed; a document that loses too much of its text is
rejected, as is one that fails the base counts.

Defined results: a null text counts as no text; texts without words have zero
counts and fail the base rule; repeated rows are judged alike; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, and the symbols that are counted.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Characters that close a sentence or a part of one.
CLOSING = ".!?:;…。)]\"'”"

#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "all rights reserved",
    "javascript is disabled",
    "enable javascript",
    "accept cookies",
    "use of cookies",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "click here to",
    "share this article",
    "skip to content",
    "lorem ipsum",
    "powered by",
    "log in to comment",
)
#: Single words that make up navigation lines.
NAVIGATION = ("home", "about", "contact", "login", "log in", "sign in", "register", "menu", "search", "next", "previous", "back", "top", "share", "print", "read more", "more", "help", "faq", "sitemap")

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line of boilerplate has this many words at most; a longer one that mentions a phrase is prose.
BOILERPLATE_WORDS = 60
#: A line with this many words or more should end a sentence somewhere.
LONG_LINE_WORDS = 25
#: Separators (bars, arrows, bullets) per 100 words from which a line is navigation.
SEPARATOR_PERCENT = 20
SYMBOL_WORD_PERCENT = 30
#: A document is rejected when more than this share of its word characters is removed.
MAX_LOST_PERCENT = 50

_POSITION_BITS = 20


def _words(text: Column) -> Column:
    """Runs of characters other than white space, as an array."""
    flat = text
    for c in SPACE[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    parts = F.split(flat, " ")
    gaps = F.contains(flat, F.lit("  ")) | F.startswith(flat, F.lit(" ")) | F.endswith(flat, F.lit(" ")) | (flat == "")
    return F.when(gaps, F.filter(parts, lambda w: w != "")).otherwise(parts)


def _count(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``; each is looked for by itself, which is quick."""
    out = F.lit(0)
    for c in chars:
        out = out + ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))) / len(c.encode())).cast("int")
    return out


def _word_chars(text: Column) -> Column:
    return F.char_length(text) - _count(text, SPACE)


def _has_word(text: Column) -> Column:
    return text.rlike("[^ \\t\\n\\x0b\\f\\r]")


def _covered(starts: Column) -> Column:
    """Words covered by 3-word windows at the sorted positions ``starts``."""
    steps = F.transform(
        starts,
        lambda p, i: F.when(i + 1 < F.size(starts), F.least(F.lit(3), F.get(starts, i + 1) - p)).otherwise(F.lit(3)),
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))


#: One navigation phrase, with nothing but marks and white space around it; for lower-case lines.
NAVIGATION_LINE = f"^[ \\t\\x0b\\f\\r.:>»|]*(?:{'|'.join(NAVIGATION)})[ \\t\\x0b\\f\\r.:>»|]*\\z"
WORD = "[^ \\t\\n\\x0b\\f\\r]+"


def line_passes(line: Column) -> Column:
    """Whether one line survives: punctuation, navigation and boilerplate rules."""
    low = F.lower(line)
    words = F.regexp_count(line, F.lit(WORD))
    boiler = F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | F.contains(low, F.lit(phrase))
    bars = _count(line, "|»›•→>")
    menu = line.rlike("[|»›•→>]") & (bars >= 2) & (bars * 100 > words * SEPARATOR_PERCENT)
    single = low.rlike(NAVIGATION_LINE)
    # Cheap questions come first, so that words are counted on few lines.
    some = lambda chars: line.rlike("[" + "".join("\\" + c for c in chars) + "]")
    noisy = some(SYMBOLS) & (words >= 10) & (_count(line, SYMBOLS) * 100 > words * SYMBOL_WORD_PERCENT)
    endless = ~some(CLOSING) & (words >= LONG_LINE_WORDS)
    return ~_has_word(line) | ~((boiler & (words <= BOILERPLATE_WORDS)) | menu | single | noisy | endless)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Counts, line verdicts and cleaned text of every document."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(key).alias("key"), body.alias("body"), _words(body).alias("words"), F.split(body, "\n").alias("lines"))
    n = F.size("words")
    trigrams = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    worded = F.filter("lines", _has_word)
    counted = split.select(
        "key",
        "body",
        "lines",
        n.alias("n_words"),
        _word_chars(F.col("body")).alias("word_chars"),
        _count(F.col("body"), SYMBOLS).alias("n_symbols"),
        worded.alias("worded"),
        trigrams.alias("tri"),
    )
    # A hash and a position share one long, so that sorting longs brings equal windows together.
    packed = F.sort_array(F.transform("tri", lambda h, i: F.shiftleft(h, _POSITION_BITS).bitwiseOR(i.cast("long"))))
    sorted_ = counted.withColumn("packed", F.when(F.col("n_words") < (1 << _POSITION_BITS), packed))
    same = lambda a, b: F.shiftright(a, _POSITION_BITS) == F.shiftright(b, _POSITION_BITS)
    follows = F.filter("packed", lambda p, i: (i > 0) & same(p, F.get("packed", F.greatest(i - 1, F.lit(0)))))
    counted = sorted_.withColumn("again", F.size(follows))
    # The sort key keeps 44 bits of the hash; texts where that merges two windows, and
    # those with too many words for the position, take the longer way.
    repeats = F.size("tri") - F.size(F.array_distinct("tri"))
    marked = counted.withColumn("clash", F.col("packed").isNull() | ((F.col("again") > 0) & (F.col("again") != repeats)))
    again = F.filter(
        "packed",
        lambda p, i: ((i > 0) & same(p, F.get("packed", F.greatest(i - 1, F.lit(0))))) | F.coalesce(same(p, F.get("packed", i + 1)), F.lit(False)),
    )
    starts = F.sort_array(F.transform(again, lambda p: p.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int")))
    marked = marked.withColumn("starts", F.when(~F.col("clash") & (F.col("again") > 0), starts))
    slow_sorted = F.sort_array(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    marked = marked.withColumn("slow", F.when(F.col("clash"), slow_sorted))
    twice = F.filter(
        "slow",
        lambda p, i: ((i > 0) & (p["h"] == F.get("slow", F.greatest(i - 1, F.lit(0)))["h"])) | F.coalesce(p["h"] == F.get("slow", i + 1)["h"], F.lit(False)),
    )
    marked = marked.withColumn("starts", F.when(F.col("clash"), F.sort_array(F.transform(twice, lambda p: p["i"]))).otherwise(F.col("starts")))
    n_repeat = F.when(F.col("starts").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("starts")))
    out = marked.select(
        "key",
        "body",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        F.filter("lines", line_passes).alias("kept_lines"),
        F.size("lines").alias("n_lines"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    clean = out.withColumn("cleaned", F.array_join("kept_lines", "\n"))
    lost = F.when(F.size("kept_lines") == F.col("n_lines"), F.lit(0)).otherwise(F.col("word_chars") - _word_chars(F.col("cleaned")))
    return clean.select(
        F.col("key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (F.col("n_lines") - F.size("kept_lines")).cast("long").alias("n_failed_lines"),
        lost.cast("long").alias("lost_chars"),
        (~base & (lost * 100 <= F.col("word_chars") * max_lost_percent)).alias("kept"),
        F.col("cleaned").alias("cleaned_text"),
    )
