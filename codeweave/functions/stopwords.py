"""Stopword sets.

Sets are addressed by letter like the reference's settings strings ("mc", "ce", ...):
  c = custom conversational list (fixed values below),
  e = the English list of Spark ML's StopWordsRemover (fixed values below; no jar or JVM is needed),
  m = medical list: supplied by the caller as a word list or a one-word-per-line file
      (it is a ~200-entry reference vocabulary, so it is a parameter, not code).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The custom stopword list, in its original order.
CUSTOM_STOPWORDS = (
    "also another around back bad better care cause come cks day days difference effect fine four good "
    "help high important information left life like may mind month months morning need never new night "
    "normal often one past people question quite rather ray result right ring side six sometimes taken "
    "thinking thought three time topic try trying two use using usually want water way week weeks weight "
    "well worried worry year"
).split()

# Hyphenated entries that are removed from the medical list when present.
MEDICAL_DROPPED = ("side-effect", "side-effects", "over-the-counter")


# The default English list of Spark ML's StopWordsRemover, in its original order.
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her "
    "hers herself it its itself they them their theirs themselves what which who whom this that these "
    "those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such no nor not only own same so than too very s "
    "t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd "
    "they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't "
    "weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't "
    "couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's "
    "would "
).split()


def english_stopwords() -> tuple:
    return tuple(ENGLISH_STOPWORDS)


def medical_stopwords(words_or_path=None) -> list:
    if words_or_path is None:
        raise ValueError("stopword set 'm' needs a word list or a one-word-per-line file")
    if isinstance(words_or_path, str):
        with open(words_or_path, encoding="utf-8") as fh:
            words = [ln.strip() for ln in fh]
    else:
        words = list(words_or_path)
    if "side-effect" in words:
        words = [w for w in words if w not in MEDICAL_DROPPED]
    return words


def stopword_list(sets: str, medical=None) -> list:
    """Unique stopwords of the chosen sets, first-seen order (m, then c, then e)."""
    out = []
    if "m" in sets:
        out += medical_stopwords(medical)
    if "c" in sets:
        out += CUSTOM_STOPWORDS
    if "e" in sets:
        out += list(english_stopwords())
    seen, uniq = set(), []
    for w in out:
        if w not in seen:
            seen.add(w)
            uniq.append(w)
    return uniq


def stopword_table(spark: SparkSession, sets: str = "ce", medical=None) -> DataFrame:
    """Long table (set, word) of the chosen sets."""
    rows = []
    if "m" in sets:
        rows += [("m", w) for w in medical_stopwords(medical)]
    if "c" in sets:
        rows += [("c", w) for w in CUSTOM_STOPWORDS]
    if "e" in sets:
        rows += [("e", w) for w in english_stopwords()]
    return spark.createDataFrame(rows, "set string, word string")


def sql_list(words) -> str:
    """DuckDB list literal of words (for oracles)."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
