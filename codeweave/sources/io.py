"""Sources and sinks (S01-S25). Readers take explicit schemas; writers produce
partitioned files. Scratch output goes under the session's shared
``spark.checkpoint.dir`` (never a machine-local folder on a cluster)."""
from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/codeweave-out/{name}-{uuid.uuid4().hex[:12]}"


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    except Exception:
        try:
            spark.read.parquet(path).schema  # noqa: B018
            return True
        except Exception:
            return False


def fingerprint(inputs: list[DataFrame], version: str = "") -> str:
    """Digest of the files the inputs are read from (path, length, modification time) and of ``version``, which stands
    for whatever else the prepared table depends on. Folders are listed, no file is opened."""
    import hashlib
    seen = []
    for df in inputs:
        try:
            df.sparkSession.sparkContext._jvm
        except Exception:  # sessions without a classic SparkContext: the reader's own file columns
            m = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
            seen += ["|".join(map(str, r)) for r in m.collect()]  # one row per file
            continue
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        files = set(df.inputFiles())
        for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
            p = jvm.org.apache.hadoop.fs.Path(folder)
            for st in p.getFileSystem(conf).listStatus(p):
                name = f"{folder}/{st.getPath().getName()}"
                if name in files or jvm.java.net.URI(name).getPath() in {jvm.java.net.URI(f).getPath() for f in files}:
                    seen.append(f"{name}|{st.getLen()}|{st.getModificationTime()}")
    return hashlib.sha256("\n".join([version, *sorted(seen)]).encode()).hexdigest()[:24]


def read_or_build(spark: SparkSession, path: str, build, inputs: list[DataFrame] | None = None, version: str = "", schema=None) -> DataFrame:
    """The prepared table of these inputs if it was written to its end, else build, write and read it back.

    Every state of the inputs has a folder of its own below ``path``, named by its fingerprint, so changed inputs
    are built anew and an older table is never mistaken for theirs. The marker that the writing job leaves at
    its commit is checked first: a table whose writing was broken off is built again."""
    target = f"{path.rstrip('/')}/{fingerprint(inputs or [], version)}"
    if not _exists(spark, f"{target}/_SUCCESS"):
        build().write.mode("overwrite").parquet(target)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(target)


#: Ends a transcript within a bundle: a line that holds the record separator alone.
RECORD_END = "\n\x1e\n"


def write_transcripts(turns: DataFrame, path: str, id_col: str = "id") -> None:
    """Transcripts in bundles, as many files as the job has partitions. Each is one record: id, start,
    duration, then alternating speaker and utterance lines. A line break or record separator inside a field becomes a blank. Beside
    the bundles, ``_index`` tells which file holds an id."""
    body = turns.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("turn_no", "speaker", "utterance"))).alias("_t"),
        F.first("start").alias("start"), F.first("duration").alias("duration"))

    def line(c):
        return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\r\n\x1e]", " ")
    lines = F.concat(F.array(line(F.col(id_col)), line(F.col("start")), line(F.col("duration"))),
                     F.flatten(F.transform("_t", lambda e: F.array(line(e["speaker"]), line(e["utterance"])))))
    body.select(F.array_join(lines, "\n").alias("value")).write.mode("overwrite").option("lineSep", RECORD_END).text(f"{path}/bundles")
    files = _records(turns.sparkSession, f"{path}/bundles").select(F.get("l", 0).alias("id"), F.col("file"))
    files.write.mode("overwrite").parquet(f"{path}/_index")


def _records(spark: SparkSession, files) -> DataFrame:
    raw = spark.read.option("lineSep", RECORD_END).text(files)
    return raw.filter(F.length("value") > 0).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("l"))


def read_transcripts(spark: SparkSession, path: str, id_col: str = "id", ids: list | None = None) -> DataFrame:
    """Line 1 id, 2 start (with a time only if ':' is in it), 3 duration, then (speaker, utterance) line pairs ->
    (id, start, duration, turn_no, speaker, utterance). For a few ``ids`` only the files that hold them are read."""
    files = f"{path}/bundles"
    if ids is not None:
        held = spark.read.parquet(f"{path}/_index").filter(F.col("id").isin([str(i) for i in ids])).select("file").distinct()
        files = [r["file"] for r in held.collect()]  # one row per asked id at most
        if not files:
            return read_transcripts(spark, path, id_col).limit(0)
    l = _records(spark, files)
    if ids is not None:
        l = l.filter(F.get("l", 0).isin([str(i) for i in ids]))
    start = F.get(F.col("l"), 1)
    hdr = l.select(F.get("l", 0).alias(id_col), F.when(start.contains(":"), F.try_to_timestamp(start, F.lit("yyyy-MM-dd HH:mm:ss")))
                   .otherwise(F.try_to_timestamp(start, F.lit("yyyy-MM-dd"))).alias("start"),
                   F.get(F.col("l"), 2).alias("duration"), F.slice("l", 4, 1 << 30).alias("b"))
    # pairs within the row: no window, no shuffle
    pairs = F.transform(F.sequence(F.lit(0), F.size("b") - 2, F.lit(2)), lambda i: F.struct(
        (i / 2).cast("int").alias("turn_no"), F.get("b", i).alias("speaker"), F.get("b", i + 1).alias("utterance")))
    return hdr.filter(F.size("b") >= 2).select(id_col, "start", "duration", F.inline(pairs))


def write_json_by_id(df: DataFrame, path: str, id_col: str = "id") -> None:
    """JSON lines in bundles, each a range of ids in their order (no folder or file per id, and readers skip
    nothing but what they filter); UTF-8 text, nothing escaped to ASCII."""
    df.repartitionByRange(id_col).sortWithinPartitions(id_col).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema, date_cols=(), date_format: str = "yyyy-MM-dd") -> DataFrame:
    """JSON with an explicit schema; date fields revived."""
    d = spark.read.schema(schema).json(path)
    for c in date_cols:
        d = d.withColumn(c, F.to_date(F.col(c), date_format))
    return d


def ids_from_names(df: DataFrame, name_col: str, pattern: str) -> DataFrame:
    """Ids extracted from file names (first group of ``pattern``), distinct."""
    ids = df.select(F.regexp_extract(F.col(name_col), pattern, 1).alias("id")).filter(F.length("id") > 0)
    return ids.distinct()


def name_filter(df: DataFrame, name_col: str, exclude_prefix: str = "~$", must_contain: str = ".doc") -> DataFrame:
    """Keep names that do not start with the lock-file prefix and contain
    the extension marker."""
    n = F.col(name_col)
    return df.filter(~n.startswith(exclude_prefix) & n.contains(must_contain))


def read_all_string_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, every column read as string."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def normalise_headers(df: DataFrame) -> DataFrame:
    """Headers lower-cased, whitespace runs -> '_'."""
    return df.toDF(*[re.sub(r"\s+", "_", c.strip().lower()) for c in df.columns])


def matrix_to_links(wide: DataFrame, key_col: str, drop_cols=("*",)) -> DataFrame:
    """0/1 matrix (one row per topic, one column per code) -> long
    (topic, code): '*' dropped, header -> upper-case first letter, null -> 0,
    kept where the flag is 1."""
    cols = [c for c in wide.columns if c != key_col and c not in drop_cols]
    long = wide.unpivot([key_col], cols, "header", "flag")
    return (long.filter(F.coalesce(F.col("flag").cast("int"), F.lit(0)) == 1)
            .select(F.col(key_col).alias("topic"), F.upper(F.substring("header", 1, 1)).alias("code")).distinct())


def sanitise_id(c) -> "F.Column":
    """Numeric-looking ids read as floats ('123.0') back to '123'."""
    col = F.col(c) if isinstance(c, str) else c
    as_num = col.try_cast("double")
    return F.when(as_num.isNotNull() & (as_num == F.floor(as_num)),
                  as_num.cast("bigint").cast("string")).otherwise(col)


def wide_codes_to_long(wide: DataFrame, code_col: str) -> DataFrame:
    """Sheet with one code per row and record ids spread over columns ->
    (record_id, code)."""
    cols = [c for c in wide.columns if c != code_col]
    long = wide.unpivot([code_col], cols, "slot", "rid").filter(F.col("rid").isNotNull())
    return long.select(sanitise_id("rid").alias("record_id"), F.col(code_col).alias("code"))


def codes_per_record(long: DataFrame) -> DataFrame:
    """(record_id, code) -> record_id with its sorted code list."""
    return long.groupBy("record_id").agg(F.sort_array(F.collect_list("code")).alias("codes"))


def read_nested_pairs(df: DataFrame, col: str, fields: list) -> DataFrame:
    """JSON text holding ``[[a, b, ...], ...]`` -> one row per inner list
    with named string fields."""
    arr = F.from_json(F.col(col), "array<array<string>>")
    e = df.select(F.explode(arr).alias("_x"))
    return e.select(*[F.get(F.col("_x"), i).alias(f) for i, f in enumerate(fields)])


def invert_mapping(m: DataFrame, key_col: str, json_col: str) -> DataFrame:
    """JSON map code -> [topics] inverted to topic -> sorted codes."""
    mp = m.select(F.from_json(F.col(json_col), "map<string,array<string>>").alias("m"))
    e = mp.select(F.explode("m").alias("code", "topics")).select("code", F.explode("topics").alias("topic"))
    return e.groupBy("topic").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def wide_predictions(gold: DataFrame, pred: DataFrame, ids: DataFrame, classes: list) -> DataFrame:
    """One row per document with gold_for_class_i and predictions_for_class_i
    (classes = the bounded, ordered label list)."""
    g = gold.select("id", "label").withColumn("v", F.lit(1))
    gw = g.groupBy("id").pivot("label", classes).agg(F.max("v"))
    pw = pred.groupBy("id").pivot("label", classes).agg(F.max("score"))
    base = ids.select("id").distinct()
    out = base.join(gw, "id", "left").join(pw.select("id", *[F.col(c).alias("_p_" + c) for c in classes]), "id", "left")
    sel = ["id"] + [F.coalesce(F.col(c), F.lit(0)).alias(f"gold_for_class_{i}") for i, c in enumerate(classes)]
    sel += [F.coalesce(F.col("_p_" + c), F.lit(0.0)).alias(f"predictions_for_class_{i}") for i, c in enumerate(classes)]
    return out.select(*sel)


def long_predictions(wide: DataFrame, n_classes: int) -> DataFrame:
    """Wide prediction table back to long (id, class, gold, pred)."""
    g = wide.unpivot(["id"], [f"gold_for_class_{i}" for i in range(n_classes)], "k", "gold")
    p = wide.unpivot(["id"], [f"predictions_for_class_{i}" for i in range(n_classes)], "k", "pred")
    g = g.select("id", F.regexp_extract("k", r"(\d+)$", 1).cast("int").alias("class"), "gold")
    p = p.select("id", F.regexp_extract("k", r"(\d+)$", 1).cast("int").alias("class"), "pred")
    return g.join(p, ["id", "class"])


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with header."""
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def error_analysis(chunk_pred: DataFrame) -> DataFrame:
    """Per chunk the comma-joined predicted labels and the max probability:
    (doc_id, segment_id, text, label, probability)."""
    return chunk_pred.groupBy("doc_id", "segment_id", "text").agg(
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("pred"), F.col("label"))))).alias("label"),
        F.max("score").alias("probability"))


def experiment_grid(metrics: DataFrame, row: str = "method", col: str = "setting", value: str = "f1",
                    digits: int = 3) -> DataFrame:
    """Long metrics -> method x setting grid rounded to ``digits``."""
    return metrics.groupBy(row).pivot(col).agg(F.first(F.round(value, digits)))


def nested_export(records: DataFrame, turns: DataFrame, key: str = "id") -> DataFrame:
    """Record -> {records[], transcript{conversation[]}} as nested structs."""
    conv = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn_no", "speaker", "utterance"))).alias("c"))
    conv = conv.select(key, F.struct(F.transform("c", lambda e: F.struct(e["speaker"].alias("speaker"),
                                                                        e["utterance"].alias("dialogue"))).alias("conversation"))
                       .alias("transcript"))
    return records.join(conv, key, "left")


def read_eval_json(df: DataFrame, col: str) -> DataFrame:
    """``[[chunks...], [codes...], id]`` -> (id, chunks, codes, split_nums).
    Elements are read as raw JSON text first (the outer list is heterogeneous)."""
    parts = F.from_json(F.col(col), "array<string>")
    x = df.select(parts.alias("_p"))
    return x.select(F.get("_p", 2).alias("id"),
                    F.from_json(F.get("_p", 0), "array<string>").alias("chunks"),
                    F.from_json(F.get("_p", 1), "array<string>").alias("codes")).withColumn("split_nums", F.size("chunks"))
