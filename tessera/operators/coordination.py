"""Agents' actions, leases, reservations, signals and saturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalised_blocker

DONE = ("done", "completed", "cancelled")


def unblocked(actions: DataFrame, edges: DataFrame, statuses: tuple[str, ...] = DONE) -> DataFrame:
    """Actions without an open dependency; edges (action_id, depends_on). A dependency that does not exist blocks nothing."""
    open_ = actions.where(~F.col("status").isin(*statuses)).select(F.col("action_id").alias("depends_on"))
    blocked = edges.join(open_, "depends_on").select("action_id").distinct()
    return actions.join(blocked, "action_id", "left_anti")


def frontier(actions: DataFrame, edges: DataFrame, leases: DataFrame, agent: str, now: Column) -> DataFrame:
    """What an agent can do next, scored: (5 - priority) * 10 + min(.5 age in hours, 20) + 15 if in progress."""
    free = unblocked(actions.where(~F.col("status").isin("completed", "done", "cancelled", "blocked")), edges)
    held = leases.where((F.col("agent_id") != agent) & (F.col("expires_at") > now)).select("action_id").distinct()
    age = (F.unix_timestamp(now) - F.unix_timestamp("created_at")) / 3600.0
    score = (5 - F.col("priority")) * 10 + F.least(age * 0.5, F.lit(20.0)) + F.when(F.col("status") == "in_progress", 15).otherwise(0)
    return free.join(held, "action_id", "left_anti").withColumn("score", score)


def completed_by(actions: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocked actions whose dependencies have all ended."""
    deps = edges.join(actions.select(F.col("action_id").alias("depends_on"), F.col("status").alias("_s")), "depends_on")
    ready = deps.groupBy("action_id").agg(F.bool_and(F.col("_s").isin(*DONE)).alias("ready")).where("ready").select("action_id")
    return actions.where("status = 'blocked'").join(ready, "action_id", "left_semi")


def active_leases(events: DataFrame, now: Column) -> DataFrame:
    """The latest lease of each action that has not run out."""
    last = events.groupBy("action_id").agg(F.max(F.struct("acquired_at", "agent_id", "expires_at")).alias("l"))
    return last.select("action_id", "l.agent_id", "l.acquired_at", "l.expires_at").where(F.col("expires_at") > now)


def _parts(path: str) -> Column:
    return F.split(F.coalesce(F.col(path), F.lit("")), "/", -1)


def _head(parts: str) -> Column:
    """How many parts there are before the first with a wildcard."""
    wild = F.array_position(F.transform(parts, lambda p: p.rlike(r"[*?]")), True)
    return F.when(wild > 0, wild - 1).otherwise(F.size(parts)).cast("int")


def _matches(pattern: Column, text: Column) -> Column:
    """A part against a part with * (any run) and ? (any character)."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|])", r"\\$1")
    regex = F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    return (pattern == text) | (pattern.rlike(r"[*?]") & F.rlike(text, regex))


def overlapping_paths(held: DataFrame, wanted: DataFrame, both_ways: bool = False) -> DataFrame:
    """Rows of ``wanted`` (path) joined with those of ``held`` (held_path) whose paths overlap.

    Paths overlap if, part by part, the wanted one's parts match the held one's as far as the shorter goes: a folder overlaps all below it, and * and ? in a wanted part stand for any
    run and any character of the held part. ``both_ways``: in a held part they stand for parts of the wanted one as well. A null path is empty.

    Pairs meet on leading parts without wildcards: as many as both have before a wildcard or their end. A held path lists the prefixes that any wanted one asks for, and the
    other way round, so only pairs that agree in them are looked at, and paths of other folders never meet.
    """
    h = held.withColumn("_hp", _parts("held_path"))
    h = h.withColumn("_hg", _head("_hp") if both_ways else F.size("_hp"))
    w = wanted.withColumn("_wp", _parts("path"))
    w = w.withColumn("_wg", _head("_wp"))
    keys = lambda parts, n: F.transform(F.sequence(F.lit(0), n), lambda k: F.when(k > 0, F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))).otherwise(""))
    hx = h.select("*", F.posexplode(keys(F.col("_hp"), F.col("_hg"))).alias("_l", "_key"))
    wx = w.select("*", F.posexplode(keys(F.col("_wp"), F.col("_wg"))).alias("_wl", "_key"))
    asked = wx.where("_wl = _wg").select("_key").distinct().withColumn("_heads", F.lit(True))
    hx = hx.join(asked, "_key", "left").where("_l = _hg OR _heads").drop("_heads")
    met = wx.join(hx, "_key").where("_wl = _wg OR _l = _hg")
    n = F.least(F.size("_wp"), F.size("_hp"))
    rest = F.zip_with(F.slice("_wp", F.col("_l") + 1, F.greatest(n - F.col("_l"), F.lit(0))), F.slice("_hp", F.col("_l") + 1, F.greatest(n - F.col("_l"), F.lit(0))), lambda p, t: _matches(p, t) | (_matches(t, p) if both_ways else F.lit(False)))
    return met.where(F.forall(rest, lambda x: x)).drop("_key", "_l", "_wl", "_wp", "_hp", "_wg", "_hg")


def conflicts(reservations: DataFrame, wanted: DataFrame, both_ways: bool = False) -> DataFrame:
    """``wanted`` (path, agent_id, exclusive) that meets an active reservation, with ``verdict``, ``holder`` and ``until``: the first reservation in the order of ``reservation_id`` that overlaps
    and is the agent's own (same_agent) or, if either is exclusive, another's (conflict). Shared ones pass each other.

    Of a holder's reservations of one path, exclusive or not, only the first can be the answer, so paths meet once for each holder, however often they were reserved."""
    w = wanted.select("path", "agent_id", "exclusive").distinct()
    r = reservations.where("active").groupBy(F.col("path").alias("held_path"), F.col("agent_id").alias("holder"), F.col("exclusive").alias("held_exclusive")).agg(F.min(F.struct("reservation_id", "expires_at")).alias("x"))
    r = r.select("held_path", "holder", "held_exclusive", "x.reservation_id", "x.expires_at")
    own = F.col("holder") == F.col("agent_id")
    hit = overlapping_paths(r, w, both_ways).where(own | F.col("exclusive") | F.col("held_exclusive"))
    first = hit.groupBy("path", "agent_id", "exclusive").agg(F.min(F.struct("reservation_id", F.when(own, "same_agent").otherwise("conflict").alias("verdict"), "holder", F.col("expires_at").alias("until"))).alias("x"))
    return first.select("path", "agent_id", "exclusive", "x.verdict", "x.holder", "x.until")


#: What tells that work is done twice, that an agent introduces itself, and that it takes something on.
TWICE = ("already claimed", "duplicate", "same task", "same action")
INTRODUCES = ("hello", "intro", "available", "starting", "beginning")
CLAIMS = ("claimed", "working on", "assigned", "taking")


def mentions(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(w).cast("int") for w in words), F.lit(0)) > 0


def duplicate_work(events: DataFrame) -> DataFrame:
    """(agent_id, n): messages that say that work is done twice."""
    return events.where(mentions(F.col("content"), TWICE)).groupBy("agent_id").agg(F.count(F.lit(1)).alias("n"))


def stale_introductions(events: DataFrame, least: int = 2) -> DataFrame:
    """(agent_id, n): agents that introduced themselves ``least`` times among these events and claimed nothing."""
    introduced = events.where(mentions(F.col("content"), INTRODUCES)).groupBy("agent_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return introduced.join(events.where(mentions(F.col("content"), CLAIMS)).select("agent_id").distinct(), "agent_id", "left_anti")


def unclaimed_introductions(events: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(agent_id, ts): introductions with no claim of the same agent in the time ``within`` before or after. For tables and for streams (agent_id, content, ts).

    In a stream both sides have a watermark, so an introduction waits until no claim can come any more, and a claim that is late but not behind the watermark counts; state goes with it.
    A null agent never claims; a row without a time says nothing.
    """
    timed = events.select("agent_id", "content", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    # the text is tied to the time: a filter that isn't would be taken below the watermark, which must see all events
    text = F.when(F.col("ts").isNotNull(), F.col("content"))
    said = timed.where(mentions(text, INTRODUCES)).select("agent_id", "ts")
    claims = timed.where(mentions(text, CLAIMS)).select(F.col("agent_id").alias("claimant"), F.col("ts").alias("claimed_at"))
    near = (F.col("agent_id") == F.col("claimant")) & (F.col("claimed_at") >= F.col("ts") - F.expr(f"INTERVAL {within}")) & (F.col("claimed_at") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return said.join(claims, near, "left_outer").where(F.col("claimant").isNull()).select("agent_id", "ts")


def saturation(events: DataFrame, now: Column, hours: int = 1, stale_minutes: int = 30) -> DataFrame:
    """(detector, subject, n) over the last hour: new actions, repeated blockers, chatter, claims, quiet threads, work done twice, introductions without claims."""
    recent = events.where((F.col("ts") > now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= now))
    total = lambda name, kind: recent.where(F.col("event_type") == kind).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("detector"), F.lit("").alias("subject"), "n")
    blockers = recent.where("event_type = 'blocker'").groupBy(normalised_blocker("content").alias("subject")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(F.lit("repeated_blocker").alias("detector"), "subject", "n")
    quiet = recent.where("thread_id IS NOT NULL").groupBy(F.col("thread_id").cast("string").alias("subject")).agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("last") < now - F.expr(f"INTERVAL {stale_minutes} MINUTES")).select(F.lit("stale_thread").alias("detector"), "subject", "n")
    named = lambda rows, name: rows.select(F.lit(name).alias("detector"), F.col("agent_id").cast("string").alias("subject"), "n")
    twice, stale = named(duplicate_work(recent), "duplicate_work"), named(stale_introductions(recent), "stale_introduction")
    return total("new_actions", "action").unionByName(total("messages", "message")).unionByName(total("claims", "claim")).unionByName(blockers).unionByName(quiet).unionByName(twice).unionByName(stale)
