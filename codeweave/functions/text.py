"""String/array scalar builders (T01-T19). Every function returns a Column so the
work stays inside whole-stage codegen; no Python UDFs."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import let
from .hashing import _c

# ASCII word class used for oracle-checkable tokenisation; the Unicode form
# (sklearn-like ``\b\w\w+\b``) is available through ``pattern=UNICODE_TOKENS``.
ASCII_TOKENS = "[a-z0-9_]{2,}"
UNICODE_TOKENS = r"[\p{L}\p{N}_]{2,}"
# Characters treated as punctuation (Python's string.punctuation).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Sentence unit: starts at a non-space non-terminator, ends with a run of . ! ? or at text end.
SENTENCE = r"[^.!?\s](?:[^.!?]*[^.!?\s])?[.!?]*"


def lower_words(text) -> Column:
    """Lower-case, split on whitespace runs, drop empties."""
    return F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda x: F.length(x) > 0)


def join_words(words) -> Column:
    return F.concat_ws(" ", _c(words))


def strip_punctuation(text) -> Column:
    """Space after / . , ? ! : before an ASCII letter, then drop ASCII punctuation."""
    spaced = F.regexp_replace(_c(text), r"([/.,?!:])([a-zA-Z])", "$1 $2")
    return F.translate(spaced, PUNCTUATION, "")


def remove_words(words, stop: list) -> Column:
    """Drop tokens in a bounded stopword list (keeps duplicates and order;
    ``array_except`` would de-duplicate)."""
    if not stop:
        return _c(words)
    return F.filter(_c(words), lambda x: ~x.isin(list(stop)))


def remove_questions(text) -> Column:
    r"""Drop lazy spans of word chars, '|' or whitespace ending in '?'.
    Same matches as the lazy pattern ``[\w|\s]*?\?`` (a match always starts at
    the start of the class run before the '?'), but the look-behind lets the
    Java engine skip non-run-start positions, so long texts without '?' stay linear."""
    return F.regexp_replace(_c(text), r"(?<![\w|\s])[\w|\s]*+\?", "")


def remove_brackets(text) -> Column:
    """Drop ``[...]`` spans (shortest match)."""
    return F.regexp_replace(_c(text), r"\[.*?]", "")


def repair_sentence_breaks(text) -> Column:
    """Between ASCII letters, '.', '?' or '!' (optionally preceded by one
    whitespace) becomes the mark followed by one space."""
    t = _c(text)
    for mark in (".", "?", "!"):
        esc = "\\" + mark
        t = F.regexp_replace(t, rf"(?<=[a-zA-Z])({esc}|(\s{esc}))(?=[a-zA-Z])", mark + " ")
    return t


def sentences(text) -> Column:
    """Sentence split (re-aim of a punkt model): maximal spans ending in . ! ? runs."""
    return F.regexp_extract_all(_c(text), F.lit(SENTENCE), 0)


def clean_description(text, stop: list | None = None, lower=True) -> Column:
    """Bracket strip, question strip, then T09."""
    return preprocess(remove_questions(remove_brackets(text)), stop=stop)


def preprocess(text, stop: list | None = None, lang_stop: list | None = None,
               remove_punct: bool = False) -> Column:
    """T09 without lemmas (lemmas are a table join, see operators.structure.lemmatise)."""
    t = F.lower(_c(text))
    if remove_punct:
        t = strip_punctuation(t)
    words = F.filter(F.split(t, r"\s+"), lambda x: F.length(x) > 0)
    if stop:
        words = remove_words(words, stop)
    if lang_stop:
        words = remove_words(words, lang_stop)
    return F.concat_ws(" ", words)


def code_categories(codes, drop_admin: bool = True) -> Column:
    """First character, trimmed, upper-cased; '-' (process codes) dropped.
    The first character is taken before trimming (so ' B80' gives '')."""
    cats = F.transform(_c(codes), lambda c: F.upper(F.trim(F.substring(c, 1, 1))))
    return F.filter(cats, lambda c: c != "-") if drop_admin else cats


CODE_PATTERN = r"[A-Z]\d{2}|-\d{2}"


def extract_codes(text) -> Column:
    """Every code-shaped token in free text, empty array for null."""
    return F.coalesce(F.regexp_extract_all(_c(text), F.lit(CODE_PATTERN), 0), F.array().cast("array<string>"))


def heading_wanted(heading, wanted: list) -> Column:
    """Keep when the heading is a substring of any wanted heading."""
    arr = F.array(*[F.lit(w) for w in wanted])
    return F.exists(arr, lambda w: F.contains(w, _c(heading)))


def concat_nullable(*cols) -> Column:
    """Join nullable texts with one space (nulls become empty strings)."""
    return F.concat_ws(" ", *[F.coalesce(_c(c), F.lit("")) for c in cols])


def softmax(arr) -> Column:
    """Numerically stable softmax over a numeric array (max and sum bound
    once per row)."""
    return let(_c(arr).cast("array<double>"), lambda a: let(F.array_max(a), lambda m: let(
        F.transform(a, lambda x: F.exp(x - m)), lambda e: let(
            F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda s: F.transform(e, lambda x: x / s)))))


def with_softmax(df, arr_col: str, out_col: str):
    """DataFrame form of :func:`softmax`."""
    return df.withColumn(out_col, softmax(arr_col))


def expit(x) -> Column:
    """Logistic squash."""
    return 1.0 / (1.0 + F.exp(-_c(x)))


def tokens(text, pattern: str = UNICODE_TOKENS) -> Column:
    """V01 token list: lower-case then regex word tokens."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(pattern), 0)


def word_count(text) -> Column:
    """Token length used by chunk packing (whitespace-separated pieces)."""
    return F.regexp_count(_c(text), F.lit(r"\S+"))
