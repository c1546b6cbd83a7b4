"""The trie of conversation prefixes, by prefix doubling.

Single turns get dense names (numbers without gaps) by their digests. In each of log2(longest) join rounds, two neighbouring blocks of named turns make a
block of twice as many, whose name is the dense name of the pair; only blocks at multiples of their size are made, so all
levels together have twice the rows of the turns. A prefix of d turns is then composed along the binary digits of d, from the highest down: its
name so far and the name of the block that follows give a pair, and the pair a dense name. Equal depth and equal name mean equal
prefixes, so nodes are groups of (depth, name). What a subtree sums to is doubled up as well: after round k a node holds the sums over
its descendants less than 2^k below it, and the node 2^k above is looked up by (smallest member, depth), which is unique.

Naming meets hot groups (a first turn that a third of all conversations share): pairs are counted before they are shuffled, and names
return to their rows by two joins, a broadcast one for names with a thousandth of the rows or more (a thousand at most, whatever
the table) and a shuffled one for the rest. The place of a turn in its conversation comes from a range partitioning by (conversation, turn, role,
text), so a conversation with a third of all turns is spread. Digests of ids are taken over chunks that other tasks have joined.

Turns are known by SHA-256 of role and text. Depths above 2^62 aside, nothing is bounded.

Defined results: rows with a null conv_id are left out; turns that tie are ordered by role, the first 32 characters of the text, and its digest;
repeated rows are turns of their own; null roles and texts are empty; a conversation that has no turn after rebuilding ends at the root; ``c % 5`` of a
negative c has c's sign, as in SQL; a very long text is read whole, once, for its digest and length; an empty table has no root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import CRC_TABLE, Tables, crc32_sql, settle

FAMILY, HEADS = 5, 9
#: Turns in a range partition, and different names in a bucket, about; what share of the rows makes a name hot, one in so many.
PART_ROWS, BUCKET_ROWS, HOT_SHARE, TIE_CHARS = 65_536, 1_000_000, 1000, 32
EMPTY = hashlib.sha256(b"").hexdigest()


def head(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first one of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def turns_of(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    own = conversations.where(F.col("conv_id").isNotNull())
    return own.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, TIE_CHARS).alias("tie"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def placed(turns: DataFrame, n: int, tables: Tables) -> DataFrame:
    """(c, i, digest, bytes, part): each turn's place in its conversation, from 0; parts follow the order of c."""
    order = ["turn", "role", "tie", "digest"]
    parts = max(turns.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS))
    held = tables.store(turns.repartitionByRange(parts, "c", *order).withColumn("part", F.spark_partition_id()))
    before = F.sum("m").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.groupBy("c", "part").agg(F.count(F.lit(1)).alias("m")).select("c", "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("c", "part").orderBy(*order))
    return tables.store(held.withColumn("within", within).join(offsets, ["c", "part"]).select("c", (F.col("before") + F.col("within") - 1).alias("i"), "digest", "bytes", "part"))


def rebuilt(turns: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(c, length, chunk) of every conversation, and (c, d, digest, bytes) of its turns after rebuilding, d from 1."""
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("own"), F.min("part").alias("chunk"))
    convs = tables.store(convs.withColumn("h", head(F.col("c"))).withColumn("base", F.col("c") - F.col("c") % FAMILY))
    bases = convs.select(F.col("c").alias("base"), F.col("own").alias("base_own"))
    convs = tables.store(convs.join(bases, "base", "left").withColumn("taken", F.least(F.coalesce("base_own", F.lit(0)), F.col("h"))))
    keys = convs.select("c", "h", "base", "taken")
    own = turns.join(keys, "c").where("i >= h").select("c", (F.col("taken") + F.col("i") - F.col("h") + 1).alias("d"), "digest", "bytes")
    first = turns.where(f"i < {HEADS - 1} AND c % {FAMILY} = 0").select(F.col("c").alias("base"), "i", "digest", "bytes")
    taken = first.join(keys, "base").where("i < h").select("c", (F.col("i") + 1).alias("d"), "digest", "bytes")
    return convs.select("c", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"), "chunk"), tables.store(own.union(taken))


def back(rows: DataFrame, table: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``rows`` with the columns of ``table``, whose ``held`` says how many rows have a key; hot keys go by broadcast."""
    least = max(16, n // HOT_SHARE)
    hot = F.broadcast(table.where(F.col("held") >= least).drop("held").withColumn("hot", F.lit(True)))
    marked = rows.join(hot.select(*keys, "hot"), keys, "left").where("hot IS NULL").drop("hot")
    return rows.join(hot.drop("hot"), keys).unionByName(marked.join(table.where(F.col("held") < least).drop("held"), keys))


def named(rows: DataFrame, keys: list[str], n: int, tables: Tables) -> DataFrame:
    """``rows`` with the dense name of their ``keys``: the order of a bucket's different keys after the buckets before."""
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ROWS))
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("held")).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    ranked = tables.store(counted.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(*keys))))
    sizes = ranked.groupBy("bucket").agg(F.max("rank").alias("size"))  # a row a bucket
    offsets = sizes.select("bucket", (F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).alias("before"))
    names = ranked.join(F.broadcast(offsets), "bucket").select(*keys, "held", (F.col("before") + F.col("rank") - 1).cast("long").alias("name"))
    return back(rows, names, keys, n)


def blocks(turns: DataFrame, n: int, longest: int, tables: Tables) -> list[DataFrame]:
    """By level k: (c, b, block), the names of turns b * 2^k and the next, 2^k in all."""
    out = [tables.store(named(turns.select("c", (F.col("d") - 1).alias("b"), "digest"), ["digest"], n, tables).select("c", "b", F.col("name").alias("block")))]
    while 2 ** len(out) <= longest:
        side = lambda odd: F.max(F.when(F.col("b") % 2 == odd, F.col("block")))
        pairs = tables.store(out[-1].groupBy("c", F.shiftright("b", 1).alias("half")).agg(side(0).alias("left"), side(1).alias("right")).where("left IS NOT NULL AND right IS NOT NULL"))
        out.append(tables.store(named(pairs, ["left", "right"], n, tables).select("c", F.col("half").alias("b"), F.col("name").alias("block"))))
    return out


def prefixes(places: DataFrame, levels: list[DataFrame], n: int, tables: Tables) -> DataFrame:
    """``places`` (c, d, bytes) with the name of the first d turns, -1 for none; equal among equal depths for equal prefixes alone."""
    held = places.withColumn("name", F.lit(None).cast("long"))
    for k in range(len(levels) - 1, -1, -1):
        bit = F.col("d").bitwiseAND(F.lit(1 << k)) != 0
        hit = tables.store(held.where(bit).withColumn("b", F.shiftright("d", k) - 1).join(levels[k], ["c", "b"]).select("c", "d", "bytes", F.col("name").alias("left"), F.col("block").alias("right")))
        parts = held.where(~bit).union(hit.where("left IS NULL").select("c", "d", "bytes", F.col("right").alias("name")))
        if k < len(levels) - 1:
            parts = parts.union(named(hit.where("left IS NOT NULL"), ["left", "right"], n, tables).select("c", "d", "bytes", "name"))
        held = tables.store(parts)
    return held.withColumn("name", F.coalesce("name", F.lit(-1)))


def ends(convs: DataFrame, members: DataFrame) -> DataFrame:
    """(depth, rep, ends_sha256): the ids that end at a node are joined in chunks of a range of ids, and the chunks digested one after another."""
    at = convs.join(members, (convs.c == members.c) & (convs.length == members.d)).select("d", "rep", "chunk", convs.c.alias("c"))
    chunks = at.groupBy("d", "rep", "chunk").agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))  # a chunk's conversations at most
    ordered = chunks.repartition("d", "rep").sortWithinPartitions("d", "rep", "chunk").select("d", "rep", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done]), pa.array([x[2] for x in done])], ["depth", "rep", "ends_sha256"])
        for batch in batches:
            done = []
            for d, rep, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, rep) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (d, rep), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield row()
        if key is not None:
            done = [(*key, state.hexdigest())]
            yield row()

    return ordered.mapInArrow(run, "depth long, rep long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node."""
    tables = Tables(conversations.sparkSession)
    own = turns_of(conversations)
    convs, turns = rebuilt(placed(own, own.count(), tables), tables)
    convs = tables.store(convs)
    n, longest = convs.agg(F.coalesce(F.sum(F.col("length") + 1), F.lit(0)), F.coalesce(F.max("length"), F.lit(0))).first()
    levels = blocks(turns, n, longest, tables) if longest else []
    places = turns.select("c", "d", "bytes").union(convs.select("c", F.lit(0).cast("long"), F.lit(0).cast("long")))
    held = prefixes(places, levels, n, tables)
    groups = tables.store(held.groupBy("d", "name").agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("held"), F.max("bytes").alias("bytes")))
    members = tables.store(back(held.select("c", "d", "name"), groups.select("d", "name", "rep", "held"), ["d", "name"], n).select("c", "d", "rep"))

    above = lambda rows, by: rows.where(F.col("depth") >= by).withColumn("up", F.col("depth") - by).join(members.select(F.col("c").alias("rep"), F.col("d").alias("up"), F.col("rep").alias("up_rep")), ["rep", "up"])
    nodes = groups.select(F.col("d").alias("depth"), "rep", F.col("held").alias("n_convs"), "bytes")
    parents = tables.store(above(nodes.select("depth", "rep"), 1).select("depth", "rep", F.col("up_rep").alias("parent_conv_id")))
    children = parents.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("rep")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = tables.store(nodes.join(parents, ["depth", "rep"], "left").join(children, ["depth", "rep"], "left").fillna(0, ["n_children"]))
    sums = nodes.select("depth", "rep", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    by = 1
    while by <= longest:
        more = above(sums, by).groupBy(F.col("up").alias("depth"), F.col("up_rep").alias("rep")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        both = sums.join(more, ["depth", "rep"], "left")
        sums = tables.store(both.select("depth", "rep", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")))
        by *= 2
    whole = nodes.join(sums, ["depth", "rep"]).join(ends(convs, members), ["depth", "rep"], "left")
    out = settle(whole.select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))
    tables.clear()
    return out


SQL = f"""
WITH RECURSIVE {CRC_TABLE},
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), substring(coalesce(text, ''), 1, {TIE_CHARS}), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, strlen(coalesce(text, ''))::BIGINT AS b FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, own, c - c % {FAMILY} AS base, {crc32_sql("c::VARCHAR")} % {HEADS} AS h
  FROM (SELECT c, count(*) AS own FROM t GROUP BY c), tab),
r AS (SELECT c, 1 AS own, i, x, b FROM t JOIN cs USING (c) WHERE i >= h UNION ALL SELECT cs.c, 0, i, x, b FROM cs JOIN t ON t.c = cs.base WHERE i < h),
o AS (SELECT c, row_number() OVER w AS d, list(x) OVER w AS p, b FROM r WINDOW w AS (PARTITION BY c ORDER BY r.own, i ROWS UNBOUNDED PRECEDING) UNION ALL SELECT c, 0, [], 0 FROM cs),
g AS (SELECT d, p, min(c) AS rep, count(*) AS n_convs, max(b) AS b FROM o GROUP BY d, p),
m AS (SELECT o.c, o.d, rep FROM o JOIN g USING (d, p)),
k AS (SELECT g.d, g.rep, n_convs, b, m.rep AS parent FROM g LEFT JOIN m ON m.c = g.rep AND m.d = g.d - 1),
kids AS (SELECT d - 1 AS d, parent AS rep, count(*) AS n_children FROM k WHERE d > 0 GROUP BY ALL),
n AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN kids USING (d, rep)),
s AS (SELECT m.d, m.rep, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * b) AS saved FROM n JOIN m ON m.c = n.rep AND m.d <= n.d GROUP BY ALL),
e AS (SELECT d, rep, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS x FROM m JOIN (SELECT c, max(d) AS d FROM m GROUP BY c) USING (c, d) GROUP BY ALL)
SELECT n.rep AS conv_id, n.d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(e.x, sha256('')) AS ends_sha256
FROM n JOIN s USING (d, rep) LEFT JOIN e USING (d, rep)
"""
