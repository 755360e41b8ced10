"""Prefix trie of conversations, with count-min screening of prefix digests.

A node is a distinct sequence of first turns (role, text); conversations that start with it are its
members. No text is shuffled: a turn travels as a digest and its number of words.

1. Prefix digests. A prefix is keyed by its depth and three sums of 32-bit hashes of its turns and their
   places, running sums over the turns in order (``operators.scan``), so that a conversation of any
   length is spread over tasks.
2. Screening. A count-min sketch with one row of cells per sum counts all prefixes; each task counts
   its own and sends the cells it used. If any cell of a prefix holds a single one, the prefix
   occurs once: the estimate of one proves it. Only one bit per cell is broadcast, 2^28 cells in a
   row at most (96 MiB), 4 cells per prefix below; beyond, the sketch proves less and more is grouped.
3. Tails. Prefixes proven single, and all below them, are emitted where they are.
4. Exact grouping. The others are grouped by key. What a node needs of its subtree is a sum over its
   members: a node is *owned* by its smallest member, the nodes that a conversation owns
   are the last ones of its path, so every node of a subtree is counted once, by its owner. No walk over
   levels is needed, and all groups are aggregated before they are shuffled.
5. The ids that end at a node are sorted and packed into chunks by ranges, and the chunks hashed in a stream:
   a group of copies of any size is never held in memory.

Defined cases: null role or text is empty; a null conv_id is no conversation (its rows are left out);
equal turn numbers of a conversation go by the digest of role and text, repeated rows are turns of their
own; an empty table gives an empty result; other columns are ignored."""
from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running
from .common import WORD, load, own_columns, share, stage

LANES, LANE = 3, 1 << 32
KEY = ["depth", *(f"l{i}" for i in range(LANES))]
#: Parts of 2^16 cells; fewest and most cells of a row; prefixes a task counts before it sends the cells.
PART, LEAST, MOST, FLUSH = 1 << 16, 1 << 16, 1 << 28, 1 << 20
CHUNK = 1 << 13
EMPTY = hashlib.sha256(b"").hexdigest()


# -- conversations -----------------------------------------------------------------------------

def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, dig, words): 128 bits of the SHA-256 of role and text, and the words of the text."""
    c = own_columns(conversations, conv_id=("conv_id", "long"), turn=("turn", "long"), role=("role", "string"), text=("text", "string"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return c.filter("conv_id is not null").select("conv_id", "turn", F.unhex(F.substring(sha, 1, 32)).alias("dig"),
                                                  F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def rebuild(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their first turns: (conv_id, len) of all, and (conv_id, depth, len, dig, words) of
    their turns. The first h turns come from conversation c - c % every, the rest are its own from h on,
    h = crc32(c) % most."""
    placed = stage(running(turns, ["conv_id"], ["turn", "dig"], sums={"pos": F.lit(1).cast("long")}), "turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    base = F.col("conv_id") - F.col("conv_id") % every
    sizes = placed.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("h", h).withColumn("base", base)
    theirs = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = sizes.join(theirs, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = stage(plan.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "plan")
    firsts = placed.filter((F.col("pos") < most) & (F.col("conv_id") % every == 0)).select(
        F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "dig", "words")
    heads = plan.join(firsts, "base").filter(F.col("depth") <= F.col("h")).select("conv_id", "depth", "len", "dig", "words")
    own = placed.join(plan, "conv_id").filter(F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "len", "dig", "words")
    return plan.select("conv_id", "len"), heads.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, len, words, upto, l0.., p0..): each prefix with its sums and those of the prefix before it."""
    parts = [F.pmod(F.xxhash64(F.lit(i), "dig", "depth"), F.lit(LANE)) for i in range(LANES)]
    t = turns.withColumns({f"h{i}": p for i, p in enumerate(parts)})
    r = running(t, ["conv_id"], ["depth"], sums={f"s{i}": F.col(f"h{i}") for i in range(LANES)} | {"upto": F.col("words")})
    return r.select("conv_id", "depth", "len", "words", "upto", *[F.pmod(f"s{i}", F.lit(LANE)).alias(f"l{i}") for i in range(LANES)],
                    *[F.pmod(F.col(f"s{i}") - F.col(f"h{i}"), F.lit(LANE)).alias(f"p{i}") for i in range(LANES)])


# -- screening ---------------------------------------------------------------------------------

def sketch(table: DataFrame, prefixes_count: int, least: int = LEAST, most: int = MOST):
    """(cells per row, bits): count-min sketch of the sums; of each cell the bit whether it was counted more than once."""
    cells = least
    while cells < 4 * prefixes_count and cells < most:
        cells *= 2
    parts = -(-cells // PART)

    def count(batches):
        import pyarrow as pa

        def flush(held):
            for lane in range(LANES):
                at, n = np.unique(np.concatenate([h[lane] for h in held]) & (cells - 1), return_counts=True)
                cuts = np.searchsorted(at, np.arange(parts + 1) * PART)
                for part in np.flatnonzero(np.diff(cuts)).tolist():
                    a, c = at[cuts[part]:cuts[part + 1]] & (PART - 1), n[cuts[part]:cuts[part + 1]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lane * parts + part], pa.int32()), pa.array([a[c == 1].astype("<u2").tobytes()], pa.binary()),
                        pa.array([a[c > 1].astype("<u2").tobytes()], pa.binary())], names=["part", "one", "more"])
        held, size = [], 0
        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            size += b.num_rows
            if size >= FLUSH:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    def merge(batches):
        import pyarrow as pa

        def row(part, more):
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(more).tobytes()], pa.binary())], names=["part", "bits"])
        now, seen, more = None, None, None
        for b in batches:
            for part, ones, many in zip(*(c.to_pylist() for c in b.columns)):
                if part != now:
                    if now is not None and more.any():
                        yield row(now, more)
                    now, seen, more = part, np.zeros(PART, bool), np.zeros(PART, bool)
                one, two = np.frombuffer(ones, "<u2"), np.frombuffer(many, "<u2")
                more[one[seen[one]]] = True
                more[two] = True
                seen[one] = seen[two] = True
        if now is not None and more.any():
            yield row(now, more)
    lanes = table.select(*[f"l{i}" for i in range(LANES)])
    rows = lanes.mapInArrow(count, "part int, one binary, more binary").repartition("part").sortWithinPartitions("part") \
        .mapInArrow(merge, "part int, bits binary").collect()  # at most LANES * MOST bits
    bits = np.zeros((LANES * parts, PART // 8), dtype=np.uint8)
    for r in rows:
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return cells, bits.reshape(-1)


def screen(table: DataFrame, cells: int, bits: np.ndarray) -> DataFrame:
    """Adds ``kind``: 0 possibly shared; proven to occur once: 1, first of its conversation that is (as far as
    its own and the prefix before it tell): 2."""
    held = share(table.sparkSession, bits)

    def run(batches):
        import pyarrow as pa
        bits = held.value
        stride = max(cells, PART)

        def single(b, kind):
            out = np.zeros(b.num_rows, bool)
            for lane in range(LANES):
                at = (b.column(f"{kind}{lane}").to_numpy() & (cells - 1)) + lane * stride
                out |= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 0
            return out
        for b in batches:
            below = single(b, "p") & (b.column("depth").to_numpy() > 1)
            kind = np.where(below, 1, np.where(single(b, "l"), 2, 0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kind)], names=[*b.schema.names, "kind"])
    return table.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema) + ", kind int")


# -- ids that end at a node ----------------------------------------------------------------------

def digest_ids(ends: DataFrame) -> DataFrame:
    """(depth, l0.., ends_sha256) of rows (depth, l0.., conv_id): SHA-256 of the ids in order, comma-joined."""
    def groups(batches):
        """Runs of rows with one key: (key, columns after the key, place of the run)."""
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            keys = list(zip(*cols[:len(KEY)]))
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    yield keys[at], cols[len(KEY):], slice(at, i)
                    at = i

    def out(rows, last):
        import pyarrow as pa
        cols = list(zip(*rows)) or [()] * (len(KEY) + len(last))
        names = [*KEY, *(n for n, _ in last)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * len(KEY) + [k for _, k in last])], names=names)

    def pack(batches):
        import pyarrow as pa
        kinds, rows = [("first", pa.int64()), ("ids", pa.string())], []
        for key, (ids,), run in groups(batches):
            for at in range(run.start, run.stop, CHUNK):
                part = ids[at:min(at + CHUNK, run.stop)]
                rows.append((*key, part[0], ",".join(map(str, part))))
            if len(rows) >= 1000:
                yield out(rows, kinds)
                rows = []
        yield out(rows, kinds)

    def digest(batches):
        import pyarrow as pa
        kinds, rows, now, sha = [("ends_sha256", pa.string())], [], None, None
        for key, (_, ids), run in groups(batches):
            if key != now:
                if now is not None:
                    rows.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(",".join(ids[run]).encode())
            if len(rows) >= 1000:
                yield out(rows, kinds)
                rows = []
        if now is not None:
            rows.append((*now, sha.hexdigest()))
        yield out(rows, kinds)
    schema = ", ".join(f"{k} long" for k in KEY)
    ends = ends.select(*[F.col(k).cast("long") for k in KEY], "conv_id")
    chunks = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(pack, schema + ", first long, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, schema + ", ends_sha256 string")


# -- the trie ------------------------------------------------------------------------------------

def trie(convs: DataFrame, turns: DataFrame, most_cells: int = MOST) -> DataFrame:
    """One row per node of conversations (conv_id, len) with turns (conv_id, depth, len, dig, words): conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    table = stage(prefixes(turns), "prefixes")
    cells, bits = sketch(table, table.count(), min(LEAST, most_cells), most_cells)
    table = stage(screen(table, cells, bits), "screened")
    shared = table.filter("kind = 0")
    owners = stage(shared.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.max("len").alias("longest")), "owners")
    member = stage(shared.join(owners, KEY), "members")
    other, last = F.col("owner") != F.col("conv_id"), F.col("depth") == F.col("len")
    # per conversation: the last prefix that another one owns, and whether it owns a leaf
    info = stage(member.groupBy("conv_id").agg(
        F.max(F.when(other, F.struct("depth", "upto"))).alias("lost"),
        F.max(F.when(last & (other | (F.col("longest") > F.col("len"))), 1).otherwise(0)).alias("no_leaf"))
        .select("conv_id", F.coalesce("lost.depth", F.lit(0)).alias("lost"), F.coalesce("lost.upto", F.lit(0)).alias("lost_upto"), "no_leaf"), "info")
    own_next = (F.col("len") > F.col("depth")) & (F.col("lost") <= F.col("depth"))
    saved = F.when(F.col("lost") >= F.col("depth"), F.col("lost_upto") - F.col("upto") + F.col("words")).otherwise(0)
    sums = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(own_next.cast("long")).alias("n_children"),
            F.sum(1 - F.col("no_leaf")).alias("n_leaves"), F.sum(saved).alias("saved_tokens")]
    before = [f"p{i}" for i in range(LANES)]
    nodes = member.join(info, "conv_id").groupBy(*KEY).agg(*sums, *[F.min(p).alias(p) for p in before])
    ends = shared.filter(last).select(*KEY, "conv_id").unionByName(
        convs.filter("len = 0").select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in KEY[1:]], "conv_id"))
    ends = stage(digest_ids(ends), "ends")
    nodes = nodes.join(ends, KEY, "left")
    one = F.lit(1).cast("long")
    alone = [one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
             F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).alias("ends_sha256")]
    firsts = table.filter("kind = 2").select("depth", "conv_id", *before, *alone)
    # the node above: its owner, or, if it was proven single, the conversation itself
    above = owners.select((F.col("depth") + 1).alias("depth"), *[F.col(f"l{i}").alias(f"p{i}") for i in range(LANES)], F.col("owner").alias("above"))
    inner = nodes.select("depth", "conv_id", *before, "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").unionByName(firsts)
    root = convs.join(info, "conv_id", "left").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(((F.col("len") > 0) & (F.coalesce("lost", F.lit(0)) <= 0)).cast("long")).alias("n_children"),
        F.greatest(F.sum(((F.col("len") > 0) & (F.coalesce("no_leaf", F.lit(0)) == 0)).cast("long")), one).alias("n_leaves"),
        F.sum(F.coalesce("lost_upto", F.lit(0))).alias("saved_tokens")).filter("n_convs > 0").withColumn("depth", F.lit(0).cast("long"))
    root = root.join(ends.filter("depth = 0").select("depth", "ends_sha256"), "depth", "left").withColumn("parent_conv_id", F.lit(None).cast("long"))
    inner = inner.join(above, ["depth", *before], "left").withColumn(
        "parent_conv_id", F.when(F.col("depth") > 1, F.coalesce("above", "conv_id")))
    top = convs.agg(F.min("conv_id")).first()[0]
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(top).cast("long")))
    tails = table.filter("kind = 1").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *alone)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")]
    return tails.select(*cols).unionByName(inner.select(*cols)).unionByName(root.select(*cols))


def op11_prefix_trie(spark, sf_dir):
    # written first: dealing by ranges reads its input twice, and texts should be hashed once
    return trie(*rebuild(stage(turn_digests(load(spark, sf_dir, "conversations")), "digests")))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {"op11_prefix_trie": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS dig,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
o AS (SELECT conv_id, list(dig ORDER BY turn NULLS FIRST, dig) AS digs, list(words ORDER BY turn NULLS FIRST, dig) AS words FROM g GROUP BY conv_id),
x AS (SELECT *, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS ops FROM o),
y AS (SELECT *, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || ops,
        lambda a, z: CASE WHEN z >= 0 THEN xor(a, z) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 4 AS h FROM x),
r AS (SELECT y.conv_id, coalesce(list_slice(b.digs, 1, y.h), []) || list_slice(y.digs, y.h + 1, len(y.digs)) AS seq,
        coalesce(list_slice(b.words, 1, y.h), []) || list_slice(y.words, y.h + 1, len(y.words)) AS words
      FROM y LEFT JOIN o b ON b.conv_id = y.conv_id - y.conv_id % 20),
p AS (SELECT conv_id, seq, words, unnest(range(0, len(seq) + 1)) AS depth FROM r),
q AS (SELECT depth, list_slice(seq, 1, depth) AS pre, conv_id, len(seq) AS n, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS w FROM p),
n AS (SELECT depth, pre, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest, any_value(w) AS w,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
      FROM q GROUP BY depth, pre),
s AS (SELECT a.depth, a.pre, sum((b.n_convs - 1) * b.w) AS saved_tokens, count(*) FILTER (WHERE b.longest = b.depth) AS n_leaves,
        count(*) FILTER (WHERE b.depth = a.depth + 1) AS n_children
      FROM n a JOIN n b ON b.depth >= a.depth AND list_slice(b.pre, 1, a.depth) = a.pre GROUP BY a.depth, a.pre)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.depth = n.depth AND s.pre = n.pre
LEFT JOIN n u ON u.depth = n.depth - 1 AND u.pre = list_slice(n.pre, 1, n.depth - 1)"""}
