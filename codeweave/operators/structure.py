"""Transcript and record structuring.

Raw transcript = one text per document: 4 header lines (Date/File, Time,
Duration, ID) then ``Speaker: text`` lines with continuation lines and
``[...]`` info spans. Everything is Column expressions plus ordered scans per
document: a window where documents are short (counted, or known because the lines all
come from one input row), and block summaries with carried state (``scan.running``)
where one document has more lines than a task should hold.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import _c
from ..session import bounded_rows
from .scan import LONG, scanned

INFO = "info"
# The record attributes a patient-table heading may fill, in order.
RECORD_FIELDS = ["gp", "additional", "allergy", "assessment", "comment", "document", "examination",
                 "family_history", "follow_up", "history", "lab_results", "medication", "problem",
                 "procedure", "referral", "regime_review", "result", "social", "template_entry",
                 "test_request", "x_ray"]
# One step of the bracket scan: leftover ']' | '[...]' pair | unclosed '[' | plain text
BRACKET_STEP = r"[^\[\]]*\]|[^\[\]]*\[[^\]]*\]|[^\[\]]*\[[^\]]*$|[^\[\]]+$"


def strip_ws(c) -> Column:
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def nonempty_lines(text) -> Column:
    """Normalise CRLF, split into lines, drop empty lines."""
    return F.filter(F.split(F.regexp_replace(_c(text), "\r\n", "\n"), "\n"), lambda x: F.length(x) > 0)


def parse_date(line) -> Column:
    """Header date: strip labels, keep digits; DDMMYY -> 20YYMMDD; not 8 digits -> null."""
    d = F.regexp_replace(strip_ws(F.replace(F.replace(_c(line), F.lit("Date:"), F.lit("")), F.lit("File:"), F.lit(""))),
                         "[^0-9]", "")
    d = F.when(F.length(d) == 6, F.concat(F.lit("20"), F.substring(d, 5, 2), F.substring(d, 3, 2), F.substring(d, 1, 2))).otherwise(d)
    return F.when(F.length(d) == 8, d)


def parse_time(line) -> Column:
    """Header time: not 6 long with ':' -> digits as int, zero-padded to 6;
    5 long -> seconds padded; not 6 -> null."""
    t = strip_ws(F.replace(_c(line), F.lit("Time:"), F.lit("")))
    colon = F.lpad(F.replace(t, F.lit(":"), F.lit("")).try_cast("bigint").cast("string"), 6, "0")
    t2 = (F.when((F.length(t) != 6) & t.contains(":"), colon)
          .when(F.length(t) == 5, F.concat(F.substring(t, 1, 4), F.lit("0"), F.substring(t, 5, 1)))
          .otherwise(t))
    return F.when(F.length(t2) == 6, t2)


def start_timestamp(date8, time6) -> Column:
    """date+time -> timestamp; date only -> midnight; else null."""
    return F.coalesce(F.try_to_timestamp(F.concat(_c(date8), _c(time6)), F.lit("yyyyMMddHHmmss")),
                      F.try_to_timestamp(_c(date8), F.lit("yyyyMMdd")))


def duration_seconds(line) -> Column:
    """D05: 'h:m:s' or 'm:s' -> seconds (null when neither shape)."""
    p = F.split(strip_ws(F.replace(_c(line), F.lit("Duration:"), F.lit(""))), ":")
    n = F.size(p)
    v = lambda i: F.get(p, i).try_cast("bigint")
    return (F.when(n == 3, v(0) * 3600 + v(1) * 60 + v(2))
            .when(n == 2, v(0) * 60 + v(1)))


def record_id(line) -> Column:
    """Id from an 'ID:' line, else from a mislabelled 'Date:' line."""
    l = _c(line)
    return (F.when(l.contains("ID"), strip_ws(F.replace(l, F.lit("ID:"), F.lit(""))))
            .when(l.contains("Date"), strip_ws(F.replace(l, F.lit("Date:"), F.lit("")))))


def speaker_split(line) -> Column:
    """struct(speaker, content): text before the first ':' is a speaker iff it
    contains a letter; otherwise the whole (stripped) line is content."""
    s = strip_ws(line)
    seg = F.split(s, ":", 2)
    is_sp = (F.size(seg) == 2) & F.get(seg, 0).rlike(r"\p{L}")
    return F.struct(F.when(is_sp, strip_ws(F.get(seg, 0))).alias("speaker"),
                    F.when(is_sp, strip_ws(F.get(seg, 1))).otherwise(s).alias("content"))


def bracket_parts(speaker, content) -> Column:
    """array<struct<speaker, text>> of one line: a leading text closed by ']'
    is info; '[x]' gives (speaker, before) and (info, x); an unclosed '[' gives
    (speaker, before) and (info, rest); plain text of length <= 1 is dropped."""
    steps = F.regexp_extract_all(strip_ws(content), F.lit(BRACKET_STEP), 0)
    sp = _c(speaker)

    def parts(m):
        lb = F.instr(m, "[")
        closes = m.endswith("]")
        pre = F.when(lb > 1, F.substring(m, F.lit(1), lb - 1))
        info_pair = F.substring(m, lb + 1, F.length(m) - lb - 1)
        info_open = F.substring(m, lb + 1, F.length(m))
        none = F.lit(None).cast("struct<speaker:string,text:string>")
        return (F.when(closes & (lb == 0),
                       F.array(F.struct(F.lit(INFO).alias("speaker"), F.substring(m, F.lit(1), F.length(m) - 1).alias("text"))))
                .when(lb > 0, F.array(
                    F.when(pre.isNotNull(), F.struct(sp.alias("speaker"), pre.alias("text"))).otherwise(none),
                    F.struct(F.lit(INFO).alias("speaker"), F.when(closes, info_pair).otherwise(info_open).alias("text"))))
                .when(F.length(m) > 1, F.array(F.struct(sp.alias("speaker"), m.alias("text"))))
                .otherwise(F.array(none)))

    return F.filter(F.flatten(F.transform(steps, parts)), lambda x: x.isNotNull())


def parse_transcripts(raw: DataFrame, id_col: str = "id", text_col: str = "raw") -> tuple[DataFrame, DataFrame]:
    """D11 = D01..D10. Returns (header(id, record_id, start_ts, duration_s),
    turns(id, turn_no, speaker, utterance))."""
    l = raw.select(F.col(id_col).alias("id"), nonempty_lines(text_col).alias("_l"))
    d8, t6 = parse_date(F.get(F.col("_l"), 0)), parse_time(F.get(F.col("_l"), 1))
    header = l.select("id", record_id(F.get(F.col("_l"), 3)).alias("record_id"),
                      start_timestamp(d8, t6).alias("start_ts"),
                      duration_seconds(F.get(F.col("_l"), 2)).alias("duration_s"))
    body = l.select("id", F.posexplode(F.slice("_l", 5, 1 << 30)).alias("line_no", "line"))
    turns = merge_turns(line_parts(body, None), None)  # lines of one row
    return header, turns


def line_parts(lines: DataFrame, long_group: int | None = LONG) -> DataFrame:
    """D07+D08+D09: (id, line_no, line) -> (id, line_no, part_no, speaker, text)."""
    s = lines.select("id", "line_no", speaker_split("line").alias("_s")).select("id", "line_no", F.col("_s.speaker").alias("own"), F.col("_s.content").alias("content"))
    s = scanned(s, ["id"], ["line_no"], lasts={"speaker": F.col("own")}, long_group=long_group)
    p = s.select("id", "line_no", F.posexplode(bracket_parts(F.col("speaker"), F.col("content"))).alias("part_no", "p"))
    return p.select("id", "line_no", "part_no", F.col("p.speaker").alias("speaker"), F.col("p.text").alias("text"))


def merge_turns(parts: DataFrame, long_group: int | None = LONG) -> DataFrame:
    """Merge a line's first part into the previous turn when the speaker is
    the same (gaps-and-islands); later parts of a line are never merged."""
    order = ["line_no", "part_no"]
    m = scanned(parts, ["id"], order, previous={"_line": F.col("line_no"), "_speaker": F.col("speaker")}, long_group=long_group)
    merge = (F.col("part_no") == 0) & F.col("_line").isNotNull() & F.col("speaker").eqNullSafe(F.col("_speaker"))
    m = m.withColumn("_start", F.when(merge, 0).otherwise(1)).drop("_line", "_speaker")
    m = scanned(m, ["id"], order, sums={"turn_no": F.col("_start")}, long_group=long_group).withColumn("turn_no", F.col("turn_no") - 1)
    g = m.groupBy("id", "turn_no").agg(
        F.max("speaker").alias("speaker"),
        F.sort_array(F.collect_list(F.struct("line_no", "part_no", "text"))).alias("_t"))
    return g.select("id", "turn_no", "speaker", F.concat_ws(" ", F.transform("_t", lambda e: e["text"])).alias("utterance"))


def role_filter(turns: DataFrame, patient: bool = True, gp: bool = True, info: bool = True) -> DataFrame:
    """Keep turns by speaker role (lower-cased speaker contains 'pat' /
    'gp' or 'doc' / 'info')."""
    sp = F.lower(F.col("speaker"))
    cond = F.lit(False)
    if patient:
        cond = cond | sp.contains("pat")
    if gp:
        cond = cond | sp.contains("gp") | sp.contains("doc")
    if info:
        cond = cond | sp.contains("info")
    return turns.filter(cond)


def turn_list(turns: DataFrame, id_col: str, pos_col: str, text_col: str) -> DataFrame:
    """Ordered list of a document's turn texts (one row per document)."""
    g = turns.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(pos_col, text_col))).alias("_t"))
    return g.select(id_col, F.transform("_t", lambda e: e[text_col]).alias("units"))


def joined_text(turns: DataFrame, id_col: str, pos_col: str, text_col: str) -> DataFrame:
    """D14 (text form): a document's kept turns joined with spaces in order."""
    t = turn_list(turns, id_col, pos_col, text_col)
    return t.select(id_col, F.concat_ws(" ", "units").alias("text"))


def apply_to_turns(turns_arr, fn_speaker=None, fn_utterance=None) -> Column:
    """Map functions over array<struct<speaker, utterance>> in-row."""
    fs = fn_speaker or (lambda x: x)
    fu = fn_utterance or (lambda x: x)
    return F.transform(_c(turns_arr), lambda t: F.struct(fs(t["speaker"]).alias("speaker"),
                                                          fu(t["utterance"]).alias("utterance")))


def duration_histogram(seconds: DataFrame, col: str = "secs", bins: int = 10) -> DataFrame:
    """Equal-width histogram between min and max (last bin closed), like
    numpy's default. min/max are a one-row aggregate joined by broadcast."""
    mm = bounded_rows(seconds.agg(F.min(col).alias("lo"), F.max(col).alias("hi")), 1)[0]
    lo, hi = mm["lo"], mm["hi"]
    width = (hi - lo) / bins if hi is not None else 0
    b = F.lit(0) if not width else F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    return seconds.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def parse_list_literal(s) -> Column:
    """Python-style list literal of strings -> array<string>."""
    # quoted items of either kind, with backslash escapes
    items = F.regexp_extract_all(_c(s), F.lit(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""), F.lit(0))
    return F.transform(items, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))


def record_entries(rows: DataFrame, long_group: int | None = LONG) -> DataFrame:
    """D12+D13: patient-table rows (id, row_no, c1, c2, c3, c4) -> one row per
    entry: (id, entry_no, date, <RECORD_FIELDS>).

    The text column is the first column (after the first) that differs from
    column 1 in the first row with a non-empty column 1 that has such a column; a row whose column 1 is a
    ``dd-MMM-yyyy`` date opens an entry (its text is the GP line); other non-empty
    column-1 texts set the heading (normalised) that following texts append to;
    unknown headings are dropped."""
    cells = F.array("c2", "c3", "c4")
    first_ok = F.length(strip_ws("c1")) > 0
    pick = F.array_position(F.transform(cells, lambda x: (F.coalesce(F.length(x), F.lit(0)) > 0)
                                        & (x != F.col("c1"))), True)
    # rows in which no cell differs say nothing: the next row decides
    picks = F.when(first_ok & (pick > 0), F.col("row_no"))
    idx = rows.groupBy("id").agg(F.min_by(pick, picks).alias("_idx"), F.min("row_no").alias("_first"))
    if long_group is not None:  # records are counted before any text is looked at
        most = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        long_group = None if most <= long_group else 0
    r = rows.join(idx, "id", "left")
    first = strip_ws("c1")
    third = strip_ws(F.coalesce(F.get(cells, F.col("_idx") - 1), F.lit("")))
    is_date = F.try_to_timestamp(first, F.lit("dd-MMM-yyyy")).isNotNull()
    r = r.select("id", "row_no", "_first", first.alias("first"), third.alias("third"), is_date.alias("is_date"),
                 F.to_date(F.try_to_timestamp(first, F.lit("dd-MMM-yyyy"))).alias("date"))
    # a heading "Date" in the first row is skipped
    r = r.filter((F.col("first") != "Date") | ~F.col("row_no").eqNullSafe(F.col("_first"))).drop("_first")
    r = r.filter((F.length("first") > 0) | (F.length("third") > 0))
    head = F.when(F.col("is_date"), F.lit("gp")).when(F.length("first") > 0, F.lower(F.translate("first", "- ", "__")))
    r = scanned(r, ["id"], ["row_no"], sums={"entry_no": F.col("is_date").cast("int")}, lasts={"heading": head}, long_group=long_group)
    r = r.select("id", "row_no", "third", "is_date", "date", "entry_no", "heading")
    r = r.filter(F.col("entry_no") > 0)
    dates = r.filter("is_date").select("id", "entry_no", "date")
    texts = r.filter(F.col("heading").isin(RECORD_FIELDS) & (F.length("third") > 0))
    agg = texts.groupBy("id", "entry_no", "heading").agg(
        F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("row_no", "third"))), lambda e: e["third"]))
        .alias("text"))
    wide = agg.groupBy("id", "entry_no").pivot("heading", RECORD_FIELDS).agg(F.first("text"))
    out = dates.join(wide, ["id", "entry_no"], "left")
    return out.withColumn("gp", F.coalesce("gp", F.lit("")))


def lemmatise(words: DataFrame, lemmas: DataFrame, id_col: str = "id") -> DataFrame:
    """T04 (re-aimed): token -> lemma through a caller-supplied (form, lemma)
    table; tokens without an entry stay as they are. Input (id, pos, token);
    the lemma table is a vocabulary-sized dimension, broadcast after a size check."""
    lt = lemmas.select(F.col("form").alias("token"), "lemma")
    j = words.join(lt, "token", "left").select(id_col, "pos", F.coalesce("lemma", "token").alias("token"))
    return j.groupBy(id_col).agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))),
                                                              lambda e: e["token"])).alias("text"))
