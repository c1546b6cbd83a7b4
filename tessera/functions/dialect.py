"""The compact index dialect: a header, then entities, topics, a key sentence, and codes of emotions and flags. Column expressions, but for the counting of topics."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col, token_estimate, trimmed, truncate_bytes

# What a code stands for is part of the format, in this order.
EMOTIONS = (
    ("decided", "determ"), ("prefer", "convict"), ("worried", "anx"), ("excited", "excite"), ("frustrated", "frust"), ("confused", "confuse"), ("love", "love"), ("hate", "rage"), ("hope", "hope"), ("fear", "fear"), ("trust", "trust"),
    ("happy", "joy"), ("sad", "grief"), ("surprised", "surprise"), ("grateful", "grat"), ("curious", "curious"), ("wonder", "wonder"), ("anxious", "anx"), ("relieved", "relief"), ("satisf", "satis"), ("disappoint", "grief"), ("concern", "anx"),
)
FLAGS = (
    ("decided", "DECISION"), ("chose", "DECISION"), ("switched", "DECISION"), ("migrated", "DECISION"), ("replaced", "DECISION"), ("instead of", "DECISION"), ("because", "DECISION"), ("founded", "ORIGIN"), ("created", "ORIGIN"), ("started", "ORIGIN"), ("born", "ORIGIN"),
    ("launched", "ORIGIN"), ("first time", "ORIGIN"), ("core", "CORE"), ("fundamental", "CORE"), ("essential", "CORE"), ("principle", "CORE"), ("belief", "CORE"), ("always", "CORE"), ("never forget", "CORE"), ("turning point", "PIVOT"), ("changed everything", "PIVOT"),
    ("realized", "PIVOT"), ("breakthrough", "PIVOT"), ("epiphany", "PIVOT"), ("api", "TECHNICAL"), ("database", "TECHNICAL"), ("architecture", "TECHNICAL"), ("deploy", "TECHNICAL"), ("infrastructure", "TECHNICAL"), ("algorithm", "TECHNICAL"), ("framework", "TECHNICAL"),
    ("server", "TECHNICAL"), ("config", "TECHNICAL"),
)
#: Words that make a sentence the key one.
DECISIVE = "decided because instead prefer switched chose realized important key critical discovered learned conclusion solution reason why breakthrough insight".split()
#: Words that are no topics and no names.
STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into about between through during before after above below up down out off over under again "
    "further then once here there when where why how all each every both few more most other some such no nor not only own same so than too very just don now and but or if while that this these those it its i we you he she they me him her us "
    "them my your his our their what which who whom also much many like because since get got use used using make made thing things way well really want need"
).split()
WORD = r"[a-zA-Z][a-zA-Z_-]{2,}"
#: Bytes of a key sentence, and of one that is cut.
QUOTE, CUT = 55, 52


def codes(text: Column | str, table: tuple[tuple[str, str], ...], most: int = 3) -> Column:
    """The first ``most`` different codes, in the table's order, of those whose words the text contains in any case."""
    low = F.lower(col(text))
    return F.slice(F.array_distinct(F.filter(F.array(*(F.when(low.contains(word), code) for word, code in table)), lambda x: x.isNotNull())), 1, most)


def key_sentence(text: Column | str) -> Column:
    """The sentence of more than ten bytes with the highest score, the first of several: two for each decisive word in it, one if it is below 80 bytes, one more below 40, two less above 150."""
    sentences = F.filter(F.transform(F.split(col(text), r"[.!?\n]+"), trimmed), lambda s: F.octet_length(s) > 10)
    size = F.octet_length

    def scored(s: Column, k: Column) -> Column:
        low = F.lower(s)
        score = sum((2 * low.contains(w).cast("int") for w in DECISIVE), F.lit(0)) + (size(s) < 80).cast("int") + (size(s) < 40).cast("int") - 2 * (size(s) > 150).cast("int")
        return F.struct((-score).alias("score"), k.alias("k"), s.alias("s"))

    best = F.array_min(F.transform(sentences, scored))["s"]
    return F.coalesce(F.when(size(best) > QUOTE, F.concat(truncate_bytes(best, CUT), F.lit("..."))).otherwise(best), F.lit(""))


def top_words(text: str | None, n: int) -> list[str]:
    """Words by how often they come, two more for each time with a capital, two more for each time joined or in mixed case; ties by word."""
    count: Counter[str] = Counter()
    for w in re.findall(WORD, text or ""):
        if (low := w.lower()) not in _stop:
            count[low] += 1 + 2 * w[0].isupper() + 2 * ("_" in w or "-" in w or any(c.isupper() for c in w[1:]))
    return [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:n]]


_stop = frozenset(STOP)


def topics(text: Column | str, n: int = 3) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: top_words(t, n))

    return run(col(text))


def entities(text: Column | str, people: dict[str, str] | None = None, most: int = 3) -> Column:
    """Codes of the people (name -> code) whose names the text contains in any case; if none, the first three letters of words that look like names and don't begin the text."""
    low = F.lower(col(text))
    known = [F.when(low.contains(name.lower()), code) for name, code in (people or {}).items() if name != name.lower()]
    found = F.array_distinct(F.filter(F.array(*known), lambda x: x.isNotNull())) if known else F.array().cast("array<string>")
    words = F.filter(F.split(col(text), r"\s+"), lambda w: w != "")
    clean = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.regexp_replace(w, "[^a-zA-Z]", ""))
    names = F.filter(clean, lambda w: w.rlike("^[A-Z][a-z]+$") & ~F.lower(w).isin(STOP))
    guessed = F.slice(F.array_distinct(F.transform(names, lambda w: F.upper(F.substring(w, 1, 3)))), 1, most)
    return F.slice(F.when(F.size(found) > 0, found).otherwise(guessed), 1, most)


def line(text: Column | str, wing: Column | None = None, room: Column | None = None, date: Column | None = None, source: Column | None = None, people: dict[str, str] | None = None) -> Column:
    """The text in the dialect, with a header if it has a source or a wing; a null or blank text gives nothing."""
    text = col(text)
    none = lambda c: F.coalesce(c, F.lit("")) if c is not None else F.lit("")
    said = lambda c, other: F.when(c == "", other).otherwise(c)
    stem = F.regexp_extract(F.regexp_extract(none(source), r"([^/]*)/*$", 1), r"^(.+?)(?:\.[^.]*)?$", 1)
    header = F.when((none(source) != "") | (none(wing) != ""), F.concat_ws("|", said(none(wing), "?"), said(none(room), "?"), said(none(date), "?"), said(stem, "?")))
    quote, felt, marked = key_sentence(text), codes(text, EMOTIONS), codes(text, FLAGS)
    body = F.concat_ws("|", F.concat(F.lit("0:"), said(F.array_join(entities(text, people), "+"), "???")), said(F.array_join(topics(text), "_"), "misc"), F.when(quote != "", F.concat(F.lit('"'), quote, F.lit('"'))), F.when(F.size(felt) > 0, F.array_join(felt, "+")), F.when(F.size(marked) > 0, F.array_join(marked, "+")))
    return F.when(F.coalesce(trimmed(text), F.lit("")) == "", "").otherwise(F.concat_ws("\n", header, body))


def ratio(original: Column | str, summary: Column | str) -> Column:
    """How many times fewer tokens the summary has, estimated, to one decimal."""
    return F.round(token_estimate(original) / F.greatest(token_estimate(summary), F.lit(1)), 1)
