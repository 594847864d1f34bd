"""Text cleaning as Column -> Column functions. Null stays null."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvane.functions import patterns as P


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(P.WS_CHARACTERS))


def dehyphenate(c: Column) -> Column:
    """Joins words that a hyphen and white space separate, left to right without overlaps."""
    return F.when(F.rlike(c, F.lit(P.JVM_MAY_DEHYPHENATE)), F.regexp_replace(c, P.JVM_DEHYPHENATE, "$1$2")).otherwise(c)


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, P.JVM_SPACES, " ")


def no_space_before_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, P.JVM_BEFORE_PUNCTUATION, "$1")


def trim_brackets(c: Column) -> Column:
    """Round brackets only."""
    return F.regexp_replace(F.regexp_replace(c, P.AFTER_OPEN, "("), P.JVM_BEFORE_CLOSE, ")")


def plain_quotes(c: Column) -> Column:
    return F.translate(c, "«»", '""')


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x if unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfc(c: Column) -> Column:
    """Unicode NFC, for which Spark has no function. c appears once, so what comes before is computed once; text that is NFC already is only looked at."""
    return _nfc(c)


def nfkc(c: Column) -> Column:
    return _nfkc(c)


def clean_text_native(c: Column) -> Column:
    """clean_text() without the Unicode step."""
    return plain_quotes(trim_brackets(no_space_before_punctuation(collapse_ws(dehyphenate(c)))))


def clean_text(c: Column) -> Column:
    """Hyphens, white space, punctuation, brackets, quotes, NFC and ends, in this order. Not idempotent."""
    return F.trim(nfc(clean_text_native(c)))


def normalize_whitespace(c: Column) -> Column:
    """Spaces and tabs become one space, white space before a newline goes, and with it blank lines."""
    c = F.regexp_replace(F.translate(c, " ", " "), "[ \t]{2,}+|\t", " ")
    c = F.regexp_replace(c, P.BEFORE_NEWLINE, "\n")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def squeeze_ws(c: Column) -> Column:
    """White-space separated words, joined by one space."""
    return F.trim(F.regexp_replace(c, P.JVM_SPACES, " "))


def title_header(stem: Column, markdown: Column) -> Column:
    return F.concat(F.lit("# Complete structured extraction: "), stem, F.lit("\n\n"), markdown)


def page_marked(page_no: Column, text: Column) -> Column:
    """A page after its marker, stripped."""
    return F.concat(F.lit("\n\n<<<PAGE "), page_no.cast("string"), F.lit(">>>\n"), strip(F.coalesce(text, F.lit(""))), F.lit("\n"))


def cap(c: Column, most: int = 400_000) -> Column:
    return F.substring(c, 1, most)


def append_eos(c: Column, eos: str) -> Column:
    return F.concat(F.coalesce(c, F.lit("")), F.lit(eos))


def strip_backticks(c: Column) -> Column:
    return F.regexp_replace(strip(c), "^`+|`+$", "")


def blank_sentinel(c: Column, sentinel: str = "NOTHING") -> Column:
    """Empty where the sentinel occurs anywhere."""
    return F.when(F.contains(c, F.lit(sentinel)), F.lit("")).otherwise(c)


def answer_after(output: Column, prompt: Column) -> Column:
    """What follows the last occurrence of the prompt; the whole output without one, and for an empty prompt."""
    return F.when(F.length(prompt) == 0, output).otherwise(F.call_function("substring_index", output, prompt, F.lit(-1)))


def year(c: Column) -> Column:
    """The first year of a publisher's line; null without one."""
    found = F.regexp_extract(c, P.YEAR, 1)
    return F.when(found != "", found.cast("int"))


def author(c: Column) -> Column:
    return strip(F.substring_index(c, P.AUTHOR_MARK, -1))


def _without_dots(path: Column) -> Column:
    """An absolute path without . and .. segments (RFC 3986, 5.2.4)."""
    parts = F.slice(F.split(path, "/", -1), 2, 1 << 30)
    ends_in_folder = F.element_at(parts, -1).isin(".", "..")

    def step(done: Column, part: Column) -> Column:
        return F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(ends_in_folder, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def absolute_url(base: str, href: Column) -> Column:
    """href against a base URL (with a host), as RFC 3986, 5.2 resolves references: absolute ones, and those that begin with //, /, ?, # or a path, dot segments taken out."""
    scheme, _, rest = base.partition("#")[0].partition("://")
    host, _, tail = rest.partition("?")[0].partition("/")
    root, path, query = f"{scheme}://{host}", "/" + tail, ("?" + rest.partition("?")[2]) if "?" in rest else ""
    folder = path.rpartition("/")[0] + "/"
    own = F.regexp_extract(href, "^[^?#]*", 0)
    after = F.substr(href, F.length(own) + 1)
    whole = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.lit(folder), own))
    dotted = F.rlike(whole, F.lit(r"/\.\.?(/|$)"))
    return (
        F.when(F.rlike(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.lit(scheme + ":"), href))
        .when(own == "", F.concat(F.lit(root + (path if tail or rest != host else "")), F.when(F.startswith(after, F.lit("?")), after).otherwise(F.concat(F.lit(query), after))))
        .otherwise(F.concat(F.lit(root), F.when(dotted, _without_dots(whole)).otherwise(whole), after))
    )


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def stem(c: Column) -> Column:
    """The base name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(c), r"(.)\.[^.]*$", "$1")


def extension(c: Column) -> Column:
    """The lower-case last suffix of the base name with its dot; empty without one."""
    return F.lower(F.regexp_extract(basename(c), r"[^.].*?(\.[^.]*)$", 1))


def output_path(path: Column, root: str, out: str, suffix: str = ".json") -> Column:
    """The path below root moved below out, its last suffix replaced."""
    below = F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(path)
    return F.concat(F.lit(out.rstrip("/") + "/"), F.regexp_replace(below, r"([^/])\.[^./]*$", "$1"), F.lit(suffix))


def sanitized_model_name(c: Column) -> Column:
    """The last path segment without the characters that file names can't hold."""
    return F.translate(basename(c), "/:.%\"'", "")


def experiment_name(model: Column, kind: str, tag: Column) -> Column:
    """[tag-]KIND-name."""
    return F.concat(F.when(F.length(F.coalesce(tag, F.lit(""))) > 0, F.concat(tag, F.lit("-"))).otherwise(F.lit("")), F.lit(kind + "-"), sanitized_model_name(model))


def chunk_id(position: Column) -> Column:
    return F.format_string("chunk_%05d", position)


def listing_url(page: Column, template: str) -> Column:
    """template has one %d for the page number."""
    return F.format_string(template, page)


def first_words(c: Column, most: int = 2048) -> Column:
    """At most so many white-space separated words, joined by one space: a stand-in for a tokenizer's truncation."""
    return F.array_join(F.slice(F.split(squeeze_ws(c), " "), 1, most), " ")


def word_count(c: Column) -> Column:
    s = squeeze_ws(c)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, " "))).cast("long")
