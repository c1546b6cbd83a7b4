"""Graph operators over edge tables (subject, predicate, object, weight): expansion, cascades, rooms, tunnels, PageRank.

Loops run a bounded number of rounds; each round joins the frontier, aggregated to a row a node, with the edges. A round uses what the
round before it gave twice, so from the third round on that is stored, and plans do not double with the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.settle import settle


def undirected(edges: DataFrame, *keep: str) -> DataFrame:
    """(a, b): each edge in both directions."""
    return edges.select(F.col("subject").alias("a"), F.col("object").alias("b"), *keep).unionByName(edges.select(F.col("object").alias("a"), F.col("subject").alias("b"), *keep))


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(node, depth): breadth first from ``seeds`` (node) in both directions, at most 5 deep, with the least depth."""
    both = undirected(edges).distinct()
    reached = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for k in range(1, min(depth, 5) + 1):
        frontier, reached = (settle(frontier), settle(reached)) if k > 2 else (frontier, reached)
        step = frontier.join(both, frontier.node == both.a).select(F.col("b").alias("node")).distinct()
        frontier = step.join(reached, "node", "left_anti").withColumn("depth", F.lit(k))
        reached = reached.unionByName(frontier)
    return reached


def follow(edges: DataFrame, seeds: DataFrame, depth: int = 3, least_confidence: float = 0.0) -> DataFrame:
    """(node, depth): along the edges only, over edges of at least that confidence, with the least depth."""
    out = edges.where(F.col("confidence") >= least_confidence).select(F.col("subject").alias("a"), F.col("object").alias("b")).distinct()
    reached = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for k in range(1, depth + 1):
        frontier, reached = (settle(frontier), settle(reached)) if k > 2 else (frontier, reached)
        step = frontier.join(out, frontier.node == out.a).select(F.col("b").alias("node")).distinct()
        frontier = step.join(reached, "node", "left_anti").withColumn("depth", F.lit(k))
        reached = reached.unionByName(frontier)
    return reached


def cascade(edges: DataFrame, seeds: DataFrame, depth: int = 2, decay: float = 0.7, tags: DataFrame | None = None, tag_weight: float = 0.8) -> DataFrame:
    """(node, score): the best product of seed score and weight · decay over walks of at most ``depth`` edges, either way.

    ``tags`` (node, tag): a node also reaches, in one step, the other nodes of each of its tags, with the weight of a tag. A round
    goes through the tags, each with the best score of its nodes and the best of the others, so nodes of a tag never meet in
    pairs; tags themselves are no result.
    """
    both = undirected(edges, "weight").groupBy("a", "b").agg(F.max("weight").alias("weight"))
    best = seeds.groupBy("node").agg(F.max("score").alias("score"))
    held = tags.select("node", "tag").distinct() if tags is not None else None
    for k in range(depth):
        best = settle(best) if k > 2 or held is not None else best  # deep cascades: each round uses the scores twice
        step = best.join(both, best.node == both.a).select(F.col("b").alias("node"), (F.col("score") * F.col("weight") * decay).alias("score"))
        if held is not None:
            own = best.join(held, "node")
            first = own.groupBy("tag").agg(F.max(F.struct("score", "node")).alias("first"))
            second = own.join(first, "tag").where(F.col("node") != F.col("first.node")).groupBy("tag").agg(F.max("score").alias("second"))
            reach = first.join(second, "tag", "left")
            heard = F.when(F.col("node") == F.col("first.node"), F.col("second")).otherwise(F.col("first.score"))  # from another node of the tag
            fanned = held.join(reach, "tag").select("node", (heard * tag_weight * decay).alias("score")).where("score IS NOT NULL")
            step = step.unionByName(fanned)
        best = best.unionByName(step).groupBy("node").agg(F.max("score").alias("score"))
    return best


def degrees(edges: DataFrame, key: str = "triple_id") -> DataFrame:
    """(node, degree): edges that touch a node; an edge from a node to itself counts once."""
    ends = edges.select(key, F.explode(F.array_distinct(F.array("subject", "object"))).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def room_nodes(drawers: DataFrame, dates: int = 5) -> DataFrame:
    """(room, wings, halls, dates, n): nodes of the room graph; ``general`` and empty rooms are left out."""
    kept = drawers.where("coalesce(room, '') NOT IN ('', 'general')")
    return kept.groupBy("room").agg(
        F.sort_array(F.collect_set("wing")).alias("wings"),
        F.sort_array(F.collect_set("hall")).alias("halls"),
        F.sort_array(F.collect_set("date")).alias("_dates"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("dates", F.expr(f"slice(_dates, greatest(size(_dates) - {dates - 1}, 1), {dates})")).drop("_dates")


def tunnels(nodes: DataFrame, wing_a: str | None = None, wing_b: str | None = None, limit: int = 50) -> DataFrame:
    """Rooms in two wings or more, the fullest first."""
    found = nodes.where(F.size("wings") >= 2)
    for wing in (wing_a, wing_b):
        if wing is not None:
            found = found.where(F.array_contains("wings", wing))
    return found.orderBy(F.desc("n"), "room").limit(limit)


def tunnel_edges(nodes: DataFrame) -> DataFrame:
    """(room, wing_a, wing_b, hall): all pairs of a room's wings with each of its halls. Wings are few; drawers never meet in pairs."""
    a = nodes.select("room", "halls", "wings", F.explode("wings").alias("wing_a"))
    b = a.select("room", "halls", "wing_a", F.explode(F.filter("wings", lambda w: w > F.col("wing_a"))).alias("wing_b"))
    return b.select("room", "wing_a", "wing_b", F.explode("halls").alias("hall"))


def topic_tunnels(topics: DataFrame, least: int = 1) -> DataFrame:
    """(wing_a, wing_b, topic): topics (case aside) that two wings share, for pairs that share at least ``least``."""
    t = topics.select("wing", F.lower("topic").alias("topic")).distinct()
    pairs = t.alias("x").join(t.alias("y"), (F.col("x.topic") == F.col("y.topic")) & (F.col("x.wing") < F.col("y.wing"))).select(F.col("x.wing").alias("wing_a"), F.col("y.wing").alias("wing_b"), F.col("x.topic").alias("topic"))
    n = F.count(F.lit(1)).over(Window.partitionBy("wing_a", "wing_b"))
    named = pairs.withColumn("n", n).where(F.col("n") >= least).drop("n")
    return named.withColumn("tunnel_id", F.substring(F.sha2(F.concat_ws("|", "wing_a", "wing_b", "topic"), 256), 1, 16))


def room_traversal(nodes: DataFrame, start: str, hops: int = 2, limit: int = 50) -> DataFrame:
    """(room, hop, n): rooms that share a wing with one that was reached before; the start has hop 0."""
    links = nodes.select("room", F.explode("wings").alias("wing"))
    reached = nodes.where(F.col("room") == start).select("room").withColumn("hop", F.lit(0))
    frontier = reached
    for k in range(1, hops + 1):
        frontier, reached = (settle(frontier), settle(reached)) if k > 2 else (frontier, reached)
        wings = frontier.join(links, "room").select("wing").distinct()
        step = links.join(wings, "wing", "left_semi").select("room").distinct()
        frontier = step.join(reached, "room", "left_anti").withColumn("hop", F.lit(k))
        reached = reached.unionByName(frontier)
    return reached.join(nodes.select("room", "n"), "room").orderBy("hop", F.desc("n"), "room").limit(limit)


def room_similarity(drawers: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(wing, room_a, room_b, similarity): Jaccard similarity of the rooms' words, for pairs of one wing above the threshold.

    Two rooms that are similar enough share one of their rarest words: of a room's ``n`` words in order of rarity only the first
    ``n - ceil(threshold * n) + 1`` look for partners, so a word that most rooms have brings no pairs together unless the
    threshold is low. Candidates are then counted exactly. Under a threshold of one half nearly all pairs are candidates; then a wing's rooms meet at each of
    their words at once, and only counts of pairs are sent on.
    """
    words = drawers.select("wing", "room", F.explode(F.array_distinct(F.filter(F.split("content", r"\s+"), lambda w: w != ""))).alias("word")).distinct()
    if threshold < 0.5:
        sizes = words.groupBy("wing", "room").agg(F.count(F.lit(1)).alias("size"))
        met = words.alias("a").join(words.alias("b"), (F.col("a.wing") == F.col("b.wing")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.room") < F.col("b.room")))
        counted = met.groupBy(F.col("a.wing").alias("wing"), F.col("a.room").alias("room_a"), F.col("b.room").alias("room_b")).agg(F.count(F.lit(1)).alias("both"))
        counted = counted.join(sizes.toDF("wing", "room_a", "size_a"), ["wing", "room_a"]).join(sizes.toDF("wing", "room_b", "size_b"), ["wing", "room_b"])
        return counted.select("wing", "room_a", "room_b", (F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))).alias("similarity")).where(F.col("similarity") > threshold)
    room = Window.partitionBy("wing", "room")
    common = words.groupBy("wing", "word").agg(F.count(F.lit(1)).alias("rooms")).where("rooms > 1")  # others have no partner
    sized = words.withColumn("size", F.count(F.lit(1)).over(room))
    ranked = sized.join(common, ["wing", "word"], "left").withColumn("rooms", F.coalesce("rooms", F.lit(1))).withColumn("place", F.row_number().over(room.orderBy("rooms", "word")))
    head = ranked.where((F.col("place") <= F.col("size") - F.ceil(threshold * F.col("size")) + 1) & (F.col("rooms") > 1)).select("wing", "room", "word", "size")
    a, b = head.alias("a"), head.alias("b")
    near = (F.col("a.wing") == F.col("b.wing")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.room") < F.col("b.room"))
    alike = (F.col("a.size") >= threshold * F.col("b.size")) & (F.col("b.size") >= threshold * F.col("a.size"))
    pairs = a.join(b, near & alike).select(F.col("a.wing").alias("wing"), F.col("a.room").alias("room_a"), F.col("b.room").alias("room_b"), F.col("a.size").alias("size_a"), F.col("b.size").alias("size_b")).distinct()
    of_a = pairs.join(words.withColumnRenamed("room", "room_a"), ["wing", "room_a"])
    both = of_a.join(words.withColumnRenamed("room", "room_b"), ["wing", "room_b", "word"]).groupBy("wing", "room_a", "room_b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("both"))
    return both.select("wing", "room_a", "room_b", (F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))).alias("similarity")).where(F.col("similarity") > threshold)


def pagerank(nodes: DataFrame, seeds: DataFrame, teleport: float = 0.15, rounds: int = 30) -> DataFrame:
    """(room, rank): personalised PageRank over rooms that share a wing. ``seeds`` is (room, mass), scaled to one.

    Mass of rooms without neighbours is dropped. A round goes through the wings (room to wing to room), so the rooms of a wing
    never meet in pairs: what a room gets from a wing is the wing's inflow less its own.
    """
    nodes = settle(nodes.select("room", "wings"))  # read in every round
    links = nodes.select("room", F.explode("wings").alias("wing")).distinct()
    sizes = links.groupBy("wing").agg(F.count(F.lit(1)).alias("size"))
    degree = links.join(sizes, "wing").groupBy("room").agg(F.sum(F.col("size") - 1).alias("degree"))
    total = seeds.agg(F.sum("mass").alias("total"))
    base = nodes.select("room").join(seeds, "room", "left").crossJoin(F.broadcast(total)).select("room", (F.coalesce("mass", F.lit(0.0)) / F.col("total")).alias("base"))
    rank = base.select("room", F.col("base").alias("rank"))
    for _ in range(rounds):
        sent = rank.join(degree, "room").where("degree > 0").join(links, "room").select("room", "wing", (F.col("rank") / F.col("degree")).alias("out"))
        inflow = sent.groupBy("wing").agg(F.sum("out").alias("inflow"))
        got = sent.join(inflow, "wing").groupBy("room").agg(F.sum(F.col("inflow") - F.col("out")).alias("got"))
        rank = base.join(got, "room", "left").select("room", (teleport * F.col("base") + (1 - teleport) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        rank = settle(rank)  # a round uses the ranks twice, so uncut plans would double each time
    return rank


def pagerank_of_queries(nodes: DataFrame, seeds: DataFrame, teleport: float = 0.15, rounds: int = 30, least: float = 0.0) -> DataFrame:
    """(query_id, room, rank): ``pagerank`` for many queries at once, by pushing what each still has to give.

    nodes: (room, wings), seeds: (query_id, room, mass), scaled to one for each query. A round sends every residual on through the room's wings and keeps ``teleport`` of it; residuals up to ``least`` are dropped, so a
    rank may be too low by what was dropped, and a round's work is that of the residuals that are left. With ``least`` 0 the ranks are those of ``rounds`` rounds of power iteration from the seeds.
    """
    links = settle(nodes.select("room", F.explode("wings").alias("wing")).distinct())
    sizes = links.groupBy("wing").agg(F.count(F.lit(1)).alias("size"))
    degree = settle(links.join(sizes, "wing").groupBy("room").agg(F.sum(F.col("size") - 1).alias("degree")).where("degree > 0"))
    total = seeds.groupBy("query_id").agg(F.sum("mass").alias("total"))
    rest = settle(seeds.join(total, "query_id").where("mass > 0").select("query_id", "room", (F.col("mass") / F.col("total")).alias("rest")))
    kept = []
    for _ in range(rounds):
        kept.append(rest.select("query_id", "room", (F.col("rest") * teleport).alias("rank")))
        sent = rest.join(degree, "room").join(links, "room").select("query_id", "room", "wing", ((1 - teleport) * F.col("rest") / F.col("degree")).alias("out"))
        inflow = sent.groupBy("query_id", "wing").agg(F.sum("out").alias("inflow"))
        # every room of a wing gets the wing's inflow, less what it gave itself
        got = inflow.join(links, "wing").select("query_id", "room", F.col("inflow").alias("got")).unionByName(sent.select("query_id", "room", (-F.col("out")).alias("got")))
        rest = settle(got.groupBy("query_id", "room").agg(F.sum("got").alias("rest")).where(F.col("rest") > max(least, 1e-15)))
        if least and rest.isEmpty():
            break
    kept.append(rest.select("query_id", "room", F.col("rest").alias("rank")))
    ranks = kept[0]
    for k in kept[1:]:
        ranks = ranks.unionByName(k)
    return ranks.groupBy("query_id", "room").agg(F.sum("rank").alias("rank"))


def room_ranks(nodes: DataFrame, queries: DataFrame, most: int = 50, **options: float) -> tuple[DataFrame, DataFrame]:
    """(seeding, room, rank), the ``most`` best rooms of each seeding, and (query_id, seeding) of every query (query_id, query).

    A query seeds the rooms whose names contain its words, by how many do; all queries that name no room share one seeding, of all rooms alike. Words meet rooms by the parts
    of their names: a room lists them, which are its name's length squared at most.
    """
    name = F.lower("room")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.transform(F.sequence(F.lit(1), F.length(name) - i + 1), lambda n: F.substring(name, i, n))))
    rooms = settle(nodes.select("room", "wings"))
    listed = rooms.where("room <> ''").select("room", F.explode(F.array_distinct(parts)).alias("word"))
    words = queries.select("query_id", F.explode(tokens("query")).alias("word"))
    named = settle(words.join(listed, "word").groupBy("query_id", "room").agg(F.count(F.lit(1)).cast("double").alias("mass")))
    own = F.concat(F.lit("q"), F.col("query_id").cast("string"))
    seeds = named.select(own.alias("query_id"), "room", "mass").unionByName(rooms.select(F.lit("all").alias("query_id"), "room", F.lit(1.0).alias("mass")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("rank", 12)), "room"))
    ranks = pagerank_of_queries(rooms, seeds, **options).withColumn("place", place).where(F.col("place") <= most).select(F.col("query_id").alias("seeding"), "room", "rank")
    known = named.select("query_id").distinct().withColumn("named", F.lit(True))
    return ranks, queries.select("query_id").distinct().join(known, "query_id", "left").select("query_id", F.when(F.col("named"), own).otherwise("all").alias("seeding"))
