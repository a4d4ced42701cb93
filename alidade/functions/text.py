"""Text cleaning as column functions."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What makes a line boilerplate, whatever the case of its letters.
BOILERPLATE = [
    r"^(all rights reserved|copyright\s*©)",
    r"^(cookie policy|privacy policy|terms of (use|service))",
    r"we use cookies",
    r"subscribe to our newsletter",
    r"follow us on (linkedin|twitter|facebook)",
    r"^\s*share\s+(this\s+)?(job|post|article)\s*$",
    r"^\s*(apply now|send cv|siųsti cv)\s*$",
    r"^\s*(back to (top|search|results))\s*$",
    r"lygios galimybės",
    r"mes garantuojame",
    r"^\s*[\|\-–—•]+\s*$",
    r"^\s*\d+\s*$",
    r"click here to apply",
    r"equal opportunity employer",
    r"<\s*/?[a-z][^>]{0,100}>",
]
# A job post's header line, and the lines where what is not about the job begins.
POST_HEADER = r"^\s*about the job\s*$"
POST_CUTOFFS = [
    r"^\s*(what we offer|we offer|our offer|what you('ll| will) get|benefits|benefits for you|perks|equal opportunity|salary\s*:.*|compensation\s*:.*|atlyginimas\s*:.*|siųsdami savo gyvenimo aprašymą|kandidatų konfidencialumą|joinrs ai)\s*$",
    r"we are proud to (foster|be an equal)|proud to be an equal opportunity|we (provide|ensure) equal opportunity|workplace free from discrimination|committed to (fostering|building) an inclusive",
]
#: What ends a line.
LINE_ENDS = "\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
SUPPORTED = {"programme": ["lt", "en"], "job_ad": ["lt", "en", "lv", "et", "pl", "de", "fr", "nl", "sv", "es"]}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


def _strip(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return " ".join(parser.parts)


def strip_html(text: Column) -> Column:
    """Text nodes joined by spaces, entities decoded (Arrow)."""

    @F.pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        return s.map(_strip, na_action="ignore")

    return strip(text)


#: Texts that an Arrow function holds as Python strings at a time.
SLICE = 256


def nfc(text: Column) -> Column:
    """NFC, no-break space to space, zero-width characters dropped (Arrow; of a
    batch only SLICE texts are Python strings at a time)."""

    @F.arrow_udf("string")
    def form(s: pa.Array) -> pa.Array:
        done = [pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in s.slice(a, SLICE).to_pylist()], pa.string()) for a in range(0, len(s), SLICE)]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return F.translate(form(text), "\u00a0\u200b\u200c\ufeff", " ")


def collapse_space(text: Column) -> Column:
    """Runs of spaces and tabs to one space, line ends to LF, at most one blank line."""
    t = F.regexp_replace(text, "[ \\t]+", " ")
    t = F.regexp_replace(t, "\\r\\n?", "\n")
    return F.regexp_replace(F.regexp_replace(t, "\\n{3,}", "\n\n"), "\\A[ \\n\\t\\r]+|[ \\n\\t\\r]+\\z", "")


def _says(line: Column, pattern: str) -> Column:
    return line.rlike("(?iu)" + pattern)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row however often body names
    it; conditions and lambdas otherwise compute it again at each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(text: Column) -> Column:
    """Lines as they end in text, without an empty one behind the last end."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_ENDS})\\z", ""), LINE_ENDS, -1)


def drop_boilerplate(text: Column) -> Column:
    """Without the lines that a pattern of BOILERPLATE finds in; one search of
    the joined patterns a line."""
    pattern = "|".join(f"(?:{p})" for p in BOILERPLATE)
    return F.array_join(F.filter(_lines(text), lambda x: ~_says(F.trim(x), pattern)), "\n")


def strip_post(text: Column) -> Column:
    """A job post without its header lines, up to the first cutoff line."""
    cutoff = "|".join(f"(?:{p})" for p in POST_CUTOFFS)
    place = lambda lines: F.array_position(F.transform(lines, lambda x: _says(x, cutoff)), True).cast("int")
    body = lambda lines: let(place(lines), lambda cut: F.when(cut > 0, F.slice(lines, F.lit(1), cut - 1)).otherwise(lines))
    return F.array_join(F.filter(let(_lines(text), body), lambda x: ~_says(x, POST_HEADER)), "\n")


def drop_lines(text: Column, phrases: list[str]) -> Column:
    """Without the lines that hold one of the phrases."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.filter(lines, lambda x: ~F.exists(F.array(*(F.lit(p) for p in phrases)), lambda p: F.contains(F.lower(x), p))), "\n")


def cut_before(text: Column, phrases: list[str]) -> Column:
    """Up to the first line that holds one of the phrases."""
    hit = lambda x: F.exists(F.array(*(F.lit(p) for p in phrases)), lambda p: F.contains(F.lower(x), p))
    place = lambda lines: F.array_position(F.transform(lines, hit), True).cast("int")
    body = lambda lines: let(place(lines), lambda at: F.when(at > 0, F.slice(lines, F.lit(1), at - 1)).otherwise(lines))
    return F.array_join(let(F.split(text, "\n", -1), body), "\n")


def after_marker(text: Column, marker: str) -> Column:
    """What follows the marker, or the text."""
    return let(text, lambda t: let(F.instr(t, marker), lambda at: F.when(at > 0, F.ltrim(F.substring(t, at + len(marker), F.length(t)))).otherwise(t)))


def drop_urls(text: Column) -> Column:
    return F.regexp_replace(text, "https?://[^ \\t\\n\\r]+", "")


def clean(text: Column, least: int = 50, html: bool = False) -> Column:
    """All steps in order; null below the least length."""
    t = nfc(strip_html(text) if html else text)
    t = collapse_space(drop_urls(drop_boilerplate(collapse_space(t))))
    return let(t, lambda x: F.when(F.length(x) >= least, x))


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\r\\f\\x0B]+"), lambda x: x != "")


def supported(language: Column, kind: str) -> Column:
    return language.isin(SUPPORTED[kind])


def detect_language(text: Column, stop_words: dict[str, list[str]]) -> Column:
    """(language, confidence) by the share of each language's stop words; a
    native stand-in for a detector: null below 20 characters."""
    every = sorted({w for ws in stop_words.values() for w in ws})
    own = lambda t: F.array_intersect(words(t), F.array(*(F.lit(w) for w in every)))
    count = lambda o, k: F.struct(F.size(F.array_intersect(o, F.array(*(F.lit(w) for w in stop_words[k])))).alias("n"), F.lit(k).alias("language"))
    counts = lambda t: let(own(t), lambda o: F.array(*(count(o, k) for k in sorted(stop_words))))

    def best(c: Column) -> Column:
        top, total = F.array_max(c), F.aggregate(c, F.lit(0), lambda s, x: s + x["n"])
        return F.when(total > 0, F.struct(top["language"].alias("language"), F.round(top["n"] / total, 3).alias("confidence")))

    return let(text, lambda t: F.when(F.length(F.trim(t)) >= 20, let(counts(t), best)))


def chunks(text: Column, most: int = 4500) -> Column:
    """Pieces of at most ``most`` characters, cut behind the last sentence, else
    the last space, else hard (Arrow: each cut depends on the one before)."""

    def split(t: str) -> list[str]:
        out = []
        while len(t) > most:
            at = t.rfind(". ", 0, most)
            at = at + 1 if at > 0 else t.rfind(" ", 0, most)
            at = at if at > 0 else most
            out.append(t[:at].strip())
            t = t[at:].strip()
        return out + [t] if t else out

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(split, na_action="ignore")

    return cut(text)


def tag_language(text: Column, stop_words: dict[str, list[str]], kind: str) -> Column:
    """(language, confidence, supported) of a text; no language is not supported."""
    tag = lambda found: F.struct(found["language"].alias("language"), F.coalesce(found["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(supported(found["language"], kind), F.lit(False)).alias("supported"))
    return let(detect_language(text, stop_words), tag)


def tokens(text: Column, stop_words: dict[str, list[str]]) -> Column:
    """Lower-case words of two letters or more that stop no language; a native
    stand-in for a lemmatizer."""
    stop = F.array(*(F.lit(w) for w in sorted({w for ws in stop_words.values() for w in ws})))
    every = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]{2,}"), F.lit(0))
    return F.filter(every, lambda w: ~F.array_contains(stop, w))


def process_records(records: DataFrame, fields: list[str], kind: str, stop_words: dict[str, list[str]], marker: str | None = None, html: bool = True, translate=None) -> DataFrame:
    """``records`` with cleaned_text, language, language_confidence,
    language_supported and tokens.

    The fields that are not blank are joined by spaces and cleaned (null below
    30 characters); a programme loses what stands before the marker, a job post
    its header and tail. ``translate`` maps the text column of Lithuanian job
    posts to English; without one they stay as they are."""
    part = lambda c: F.when(F.col(c).cast("string").rlike("(?U)\\S"), F.col(c).cast("string"))
    rows = records.withColumn("cleaned_text", clean(F.concat_ws(" ", *map(part, fields)), 30, html))
    if kind == "job_ad":
        rows = rows.withColumn("cleaned_text", strip_post(F.col("cleaned_text")))
    elif marker is not None:
        rows = rows.withColumn("cleaned_text", after_marker(F.col("cleaned_text"), marker))
    rows = rows.withColumn("__tag", F.when(F.col("cleaned_text").isNotNull(), tag_language(F.col("cleaned_text"), stop_words, kind)))
    if kind == "job_ad" and translate is not None:
        foreign = F.col("__tag.language") == "lt"
        rows = rows.withColumn("cleaned_text", F.when(foreign, translate(F.col("cleaned_text"))).otherwise(F.col("cleaned_text")))
        rows = rows.withColumn("__tag", F.when(foreign, F.struct(F.lit("en").alias("language"), F.lit(1.0).alias("confidence"), F.lit(True).alias("supported"))).otherwise(F.col("__tag")))
    return rows.select("*", F.col("__tag.language").alias("language"), F.coalesce("__tag.confidence", F.lit(0.0)).alias("language_confidence"), F.coalesce("__tag.supported", F.lit(False)).alias("language_supported"), tokens(F.col("cleaned_text"), stop_words).alias("tokens")).drop("__tag")


def sections(text: Column) -> Column:
    """(header, body) of each section: a header is a line that ends in a colon
    and has 4 to 79 characters; text before the first has header ''. Bodies are
    slices between the headers' places, so long texts cost their length."""
    is_header = lambda x: x.endswith(":") & F.length(x).between(4, 79)

    def parts(lines: Column, places: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), places)
        ends = F.concat(places, F.array(F.size(lines) + 1))
        body = lambda a, b: F.trim(F.array_join(F.slice(lines, a + 1, b - a - 1), "\n"))
        name = lambda a: F.when(a == 0, F.lit("")).otherwise(F.lower(F.regexp_replace(F.get(lines, a - 1), ":\\z", "")))
        return F.zip_with(starts, ends, lambda a, b: F.struct(name(a).alias("header"), body(a, b).alias("body")))

    places = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(is_header(x), i + 1)), lambda i: i.isNotNull())
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))
    return let(trimmed, lambda lines: let(places(lines), lambda at: parts(lines, at)))


def skill_tags(text: Column, terms: list[str]) -> Column:
    """Distinct terms found as whole words, sorted."""
    pattern = "(?i)\\b(" + "|".join(terms) + ")\\b"
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.lower(x))))


def posting_too_old(date: Column, cutoff: Column) -> Column:
    """Whether a date in one of the usual forms lies before the cutoff; unknown: no."""
    day = F.coalesce(*(F.try_to_timestamp(date, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "dd.MM.yyyy", "yyyy.MM.dd")))
    return F.coalesce(day < cutoff, F.lit(False))
