"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

Everything is DataFrame functions, per document: no shuffle, no Python. Patterns give the
matches, splitting by the same pattern the text between them, and running lengths the
positions (code points). Candidate strings are maximal runs of ``CANDIDATE``; over each, a
window of ``WINDOW`` characters slides with incremental character counts and an incremental
``sum(c * log2 c)``, so a step costs the same at any length. A run of windows whose Shannon
entropy reaches the threshold of the string's character class (hex digits only, or mixed) is a
span from the first such window's start to the last one's end. Allow-listed strings (plain
words, also joined by signs, UUIDs, placeholders) are suppressed; the list never touches
pattern matches.

Defined cases: null text is empty text; no match gives zero counts and the digest of the empty
string; spans of different kinds may overlap; nulls in other columns and repeated rows pass
through; other columns are ignored."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, own_columns

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Kinds of the base patterns in their order, with the least length and the group it is taken from.
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))

WINDOW = 20
#: Matches whose places are summed in one go.
RUN = 64
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Entropy in bits a window must reach, by character class.
HEX_BITS, MIXED_BITS = 3.0, 3.8
ALLOW = (r"^[+/_=-]*([A-Z]?[a-z]+|[A-Z]+|[0-9]+)([+/_=-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[+/_=-]*$",  # words, numbers, paths
         r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",           # UUID
         r"(?i)(example|placeholder|sample|dummy|changeme|your[_-]|xxxx)")


def located(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Adds ``name``: array<struct<s, e, m>> of the leftmost non-overlapping matches."""
    m, p = f"_{name}_m", f"_{name}_p"
    df = df.withColumn(m, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split(text, pattern, -1)))
    # running places by blocks of RUN matches, so that no long array is appended to match by match
    # (columns stand outside of lambdas, where they would be computed again for each match)
    lens = f"zip_with(slice({p}, 1, size({m})), {m}, (g, x) -> named_struct('g', length(g), 'n', length(x), 'm', x))"
    steps = F.expr(f"""element_at(transform(array({lens}), l -> element_at(transform(array(
        aggregate(transform(sequence(0, (size(l) - 1) div {RUN}), b -> aggregate(slice(l, b * {RUN} + 1, {RUN}), 0, (a, x) -> a + x.g + x.n)),
          array(0), (a, t) -> concat(a, array(element_at(a, -1) + t)))), begin ->
      flatten(transform(sequence(0, (size(l) - 1) div {RUN}), b -> aggregate(sequence(b * {RUN}, least((b + 1) * {RUN}, size(l)) - 1),
        named_struct('at', begin[b], 'out', CAST(array() AS array<struct<s:int,e:int,m:string>>)),
        (a, i) -> named_struct('at', a.at + l[i].g + l[i].n,
          'out', concat(a.out, array(named_struct('s', a.at + l[i].g, 'e', a.at + l[i].g + l[i].n, 'm', l[i].m)))),
        a -> a.out)))), 1)), 1)""")
    none = F.expr("CAST(array() AS array<struct<s:int,e:int,m:string>>)")
    return df.withColumn(name, F.when(F.size(m) > 0, steps).otherwise(none)).drop(m, p)


def _entropy_bounds(s: str, bits: str) -> str:
    """SQL: struct<lo, hi> of the windows of string ``s`` that reach ``bits`` (hi null if none).

    State: counts by character code, q = sum(c log2 c) of the window, lo, hi."""
    gain = "IF({c} > 0, {c} * log2({c}), 0D)"
    def f(c):
        return gain.format(c=c)
    # codes and threshold are made once: reading the i-th character of a string would walk there from its start;
    # slot 128 of the counts stands for no character leaving the window
    return f"""element_at(transform(array(named_struct('codes', transform(split({s}, ''), c -> ascii(c)), 'bits', {bits})), z -> aggregate(sequence(1, size(z.codes)),
      named_struct('n', array_repeat(0, 129), 'q', 0D, 'lo', CAST(NULL AS int), 'hi', CAST(NULL AS int)),
      (a, i) -> element_at(transform(array(named_struct('x', z.codes[i - 1], 'y', IF(i > {WINDOW}, z.codes[i - 1 - {WINDOW}], 128))), c ->
        element_at(transform(array(named_struct('q', IF(c.x = c.y, a.q, a.q
            + {f('(a.n[c.x] + 1)')} - {f('a.n[c.x]')}
            + IF(c.y = 128, 0D, {f('(a.n[c.y] - 1)')} - {f('a.n[c.y]')})), 'low', least(c.x, c.y), 'high', greatest(c.x, c.y))), v ->
          named_struct('n', IF(c.x = c.y, a.n, concat(slice(a.n, 1, v.low), array(a.n[v.low] + IF(v.low = c.x, 1, -1)),
              slice(a.n, v.low + 2, v.high - v.low - 1), array(a.n[v.high] + IF(v.high = c.x, 1, -1)), slice(a.n, v.high + 2, 128 - v.high))),
            'q', v.q,
            'lo', IF(i >= {WINDOW} AND log2({WINDOW}) - v.q / {WINDOW} >= z.bits, coalesce(a.lo, i - {WINDOW}), a.lo),
            'hi', IF(i >= {WINDOW} AND log2({WINDOW}) - v.q / {WINDOW} >= z.bits, i, a.hi))), 1)), 1),
      a -> named_struct('lo', a.lo, 'hi', a.hi))), 1)"""


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base and spans as array<struct<start, rank, end, kind>>, in order."""
    d = own_columns(docs, doc_id=("doc_id", "long"), text=("text", "string"))
    d = d.withColumn("text", F.coalesce("text", F.lit("")))
    for kind, pattern, _, _ in BASE:
        d = located(d, "text", pattern, kind)
    d = located(d, "text", CANDIDATE, "cand").drop("text")
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        keep = F.filter(F.col(kind), lambda x: F.length(F.regexp_extract(x["m"], pattern, group)) >= least)
        parts.append(F.transform(keep, lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"),
                                                          x["e"].alias("end"), F.lit(kind).alias("kind"))))
    d = d.select("doc_id", F.array_sort(F.concat(*parts)).alias("base"), "cand")
    allowed = " OR ".join(f"x.m RLIKE r'{a}'" for a in ALLOW)
    hexa = "x.m RLIKE '^[0-9a-fA-F]+$'"
    d = d.withColumn("cand", F.expr(f"filter(cand, x -> NOT ({allowed}))"))
    d = d.withColumn("cand", F.expr(f"""transform(cand, x -> named_struct('s', x.s, 'hexa', {hexa},
      'b', {_entropy_bounds('x.m', f"IF({hexa}, {HEX_BITS}D, {MIXED_BITS}D)")}))"""))
    found = F.expr(f"""transform(filter(cand, x -> x.b.hi IS NOT NULL), x -> named_struct('start', x.s + x.b.lo,
      'rank', IF(x.hexa, {len(BASE)}, {len(BASE) + 1}), 'end', x.s + x.b.hi,
      'kind', IF(x.hexa, 'entropy_hex', 'entropy_mixed')))""")
    return d.select("doc_id", "base", F.array_sort(F.concat("base", found)).alias("spans"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                      x["end"].cast("string"))), ",")


def op4_secrets(spark, sf_dir):
    d = scan(load(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{kind}')) AS long) AS n_{kind}") for kind, *_ in BASE]
    return d.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def _oracle() -> str:
    assign = ASSIGN.replace("'", "''")
    pats = {"assign": assign, "access": ACCESS, "hex": HEX, "cand": CANDIDATE}
    cols = ",\n  ".join(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS p_{k}" for k, p in pats.items())
    arrays = ",\n  ".join(
        f"list_transform(range(1, len(m_{k}) + 1), lambda i: {{'s': list_sum(list_transform(p_{k}[1:i], lambda z: length(z)))"
        f" + coalesce(list_sum(list_transform(m_{k}[1:i - 1], lambda z: length(z))), 0), 'm': m_{k}[i]}}) AS a_{k}" for k in pats)
    base = "\n  || ".join(
        f"list_transform(list_filter(a_{k}, lambda x: {cond}), lambda x: {{'start': x.s, 'rank': {r}, 'stop': x.s + length(x.m), 'kind': '{k}'}})"
        for r, (k, cond) in enumerate((("assign", f"length(regexp_extract(x.m, '{assign}', 2)) >= 6"),
                                       ("access", "length(x.m) >= 20"), ("hex", "length(x.m) >= 24"))))
    allow = " OR ".join(f"regexp_matches(x.m, '{a}')" for a in ALLOW)
    hexa = "regexp_matches(x.m, '^[0-9a-fA-F]+$')"
    hits = (f"list_filter(range(1, length(x.m) - {WINDOW - 2}), lambda i: list_aggregate(string_split(substr(x.m, i, {WINDOW}), ''), 'entropy')"
            f" >= CASE WHEN {hexa} THEN {HEX_BITS} ELSE {MIXED_BITS} END)")
    text = "array_to_string(list_transform({0}, lambda x: x.kind || ':' || x.start || ':' || x.stop), ',')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id,
  {cols} FROM d),
a AS (SELECT doc_id,
  {arrays} FROM m),
b AS (SELECT doc_id, list_sort({base}) AS base,
  list_transform(list_filter(a_cand, lambda x: length(x.m) >= {WINDOW} AND NOT ({allow})),
    lambda x: {{'s': x.s, 'hexa': {hexa}, 'h': {hits}}}) AS c FROM a),
s AS (SELECT doc_id, base, list_sort(base || list_transform(list_filter(c, lambda x: len(x.h) > 0),
    lambda x: {{'start': x.s + list_min(x.h) - 1, 'rank': CASE WHEN x.hexa THEN 3 ELSE 4 END, 'stop': x.s + list_max(x.h) + {WINDOW - 1},
      'kind': CASE WHEN x.hexa THEN 'entropy_hex' ELSE 'entropy_mixed' END}})) AS spans FROM b)
SELECT doc_id, len(list_filter(base, lambda x: x.kind = 'assign')) AS n_assign,
  len(list_filter(base, lambda x: x.kind = 'access')) AS n_access, len(list_filter(base, lambda x: x.kind = 'hex')) AS n_hex,
  sha256(coalesce({text.format('base')}, '')) AS base_sha256, coalesce({text.format('spans')}, '') AS spans FROM s"""


QUERIES = {"op4_secrets": op4_secrets}
ORACLES = {"op4_secrets": _oracle()}
