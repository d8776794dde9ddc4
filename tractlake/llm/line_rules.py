"""Line-first cleaning of documents, with DataFrame functions only.

Every line is judged by rules on punctuation, navigation and boilerplate. Failing lines go; a document that loses too
much of its text with them is rejected, as is one that fails the base rules on the whole text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.llm.common import carried, table

SPACE = " \t\n\x0b\x0c\r"
#: Words of the windows in which repeats are sought.
WINDOW = 8
# The characters that count as symbols, what ends a sentence, and phrases of pages rather than of prose.
SYMBOLS = "#*$%&|<>"
ENDINGS = ".!?:;\"'»”)…。！？"
SEPARATORS = "|»›·•→"
BOILERPLATE = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "use cookies",
    "accept cookies", "enable javascript", "click here", "read more", "sign in", "log in", "subscribe to", "lorem ipsum",
    "licensed under the", "share this", "alle rechte vorbehalten", "datenschutzerkl", "nutzungsbedingungen", "mehr erfahren",
    "tous droits réservés", "mentions légales", "lire la suite", "en savoir plus", "todos los derechos", "política de privacidad",
    "aviso legal", "leer más",
)
#: A document is rejected when its failing lines hold more than this share of its words' characters.
MOST_LOST = 0.5
BASE_MIN_WORDS, BASE_REPEAT_PERCENT = 20, 30


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def solid_chars(lines: str) -> Column:
    """Code points of all words of lines."""
    return F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(x["solid"]))


def has_phrase(text: Column) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(p)) for p in BOILERPLATE))


def line_fails(line: Column, any_phrase: Column) -> Column:
    """Whether a line fails: by punctuation, as navigation, or by a page's phrase.

    Punctuation: many symbols or shouting, no letters, or an ellipsis of dots at its end. Navigation: separators, links
    that make up a quarter of its words or more, or a word or two that no sentence ends. line: its ``text``, and ``solid``
    without white space. any_phrase: whether the whole text has a phrase; only then are its lines searched.
    """
    text, solid = line["text"], line["solid"]
    passing = F.length(without(solid, SYMBOLS + "!")) * 10 >= F.length(solid) * 9
    punctuation = ~passing | F.endswith(solid, F.lit("...")) | solid.rlike(r"^[\W\d_]{4,}$")
    # words but for the last one are followed by a space: an upper bound by white space is enough for short lines
    gaps = F.length(F.trim(text)) - F.length(solid)
    n_links = (F.length(text) - F.length(F.replace(text, F.lit("://"), F.lit("")))) / 3
    links = F.contains(text, F.lit("://")) & (gaps + 1 <= 4 * n_links)
    short = (gaps <= 1) & ~F.contains(F.lit(ENDINGS), F.right(solid, F.lit(1)))
    navigation = (F.length(text) - F.length(without(text, SEPARATORS)) >= 3) | links | short
    return punctuation | navigation | (any_phrase & has_phrase(text))


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns with the base measures, ``clean_text`` (lines that pass, in order), ``boilerplate`` (whether a page's phrase
    stands anywhere) and the verdict ``kept``.

    Null text counts as empty: no words, so base_failed and not kept. Lines end at line feeds only. Rows are judged
    one by one: repeated rows, ties and null keys make no difference, and an empty table gives no rows. Input columns
    named like an added one are not carried.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "lost_chars", "kept", "boilerplate")
    df = docs.select(*carried(docs, "__t", "__words", "__lines", "__runs", "__sorted", "__at", "__passing", *added), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    df = df.withColumns({"__words": F.transform(words_of(F.col("__t")), lambda w: F.xxhash64(w)), "__lines": F.transform(F.split("__t", "\n", -1), lambda x: F.struct(x.alias("text"), without(x, SPACE).alias("solid"))), "boilerplate": has_phrase(F.col("__t"))})
    # boilerplate is returned, so that the optimizer does not move it into the loop over lines, where it is used once
    runs = F.transform(F.sequence(F.lit(0), F.size("__words") - WINDOW), lambda i: F.xxhash64(*(F.get("__words", i + j) for j in range(WINDOW))))
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": solid_chars("__lines"),
        "n_symbols": (F.length("__t") - F.length(without(F.col("__t"), SYMBOLS))).cast("long"),
        "__runs": F.when(F.size("__words") > WINDOW, runs).otherwise(F.array().cast("array<bigint>")),
        "__lines": F.filter("__lines", lambda x: x["solid"] != ""),
        "__passing": F.filter("__lines", lambda x: (x["solid"] != "") & ~line_fails(x, F.col("boilerplate"))),
    })
    # windows in order of hash and place; only texts with a repeated window are sorted
    repeats = F.size(F.array_distinct("__runs")) < F.size("__runs")
    df = df.withColumns({
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines.text"))).cast("long"),
        "__sorted": F.when(repeats, F.sort_array(F.transform("__runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    })
    again = lambda i: (F.get("__sorted", i)["h"] == F.get("__sorted", i - 1)["h"]) | (F.get("__sorted", i)["h"] == F.get("__sorted", i + 1)["h"])
    places = F.transform(F.filter(F.sequence(F.lit(0), F.size("__sorted") - 1), lambda i: F.coalesce(again(i), F.lit(False))), lambda i: F.get("__sorted", i)["i"])
    df = df.withColumn("__at", F.when(F.col("__sorted").isNotNull(), F.sort_array(places)))
    covered = F.aggregate("__at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    df = df.withColumns({
        "base_failed": (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words")),
        "clean_text": F.array_join("__passing.text", "\n"),
        "lost_chars": F.col("word_chars") - solid_chars("__passing"),
    })
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= MOST_LOST * F.col("word_chars")))
    return df.drop("__t", "__words", "__lines", "__runs", "__sorted", "__at", "__passing")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, verdict, and what is left of every document."""
    out = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "boilerplate")
