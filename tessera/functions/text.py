"""Text expressions: tokens, scripts, similarity, names, dates and scores. All are built-in column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Lower-cased words between white space; punctuation stays with its word."""
    return F.array_remove(F.split(F.lower(col(text)), r"\s+"), "")


def cjk_segments(text: Column | str) -> Column:
    """Runs of one script: Han, kana and Hangul runs apart from everything else."""
    return F.regexp_extract_all(col(text), F.lit(r"\p{IsHan}+|\p{IsHiragana}+|\p{IsKatakana}+|\p{IsHangul}+|[^\s" + CJK + "]+"), 0)


def has_cjk(text: Column | str) -> Column:
    return col(text).rlike(f"[{CJK}]")


def dominant_script(text: Column | str) -> Column:
    """The script of more than half of the characters; ties go to the first of latin, cyrillic, cjk, arabic; else other."""
    t = col(text)
    share = lambda cls: F.regexp_count(t, F.lit(cls)) * 2 > F.length(t)
    return F.when(share(r"[A-Za-zÀ-ɏ]"), "latin").when(share(r"\p{IsCyrillic}"), "cyrillic").when(share(f"[{CJK}]"), "cjk").when(share(r"\p{IsArabic}"), "arabic").otherwise("other")


def language(text: Column | str) -> Column:
    """ru if any Cyrillic letter occurs, en otherwise."""
    return F.when(col(text).rlike("[А-Яа-яЁё]"), "ru").otherwise("en")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; an empty side gives 0."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def contains_count(text: Column | str, terms: Sequence[str]) -> Column:
    """How many of the terms the lower-cased text contains; a term given twice counts twice."""
    low = F.lower(col(text))
    return sum((low.contains(t.lower()).cast("int") for t in terms), F.lit(0))


def quoted_and_capitalised(text: Column | str) -> Column:
    """Names in a query: quoted strings, then capitalised words."""
    t = col(text)
    quoted = F.regexp_extract_all(t, F.lit('"([^"]+)"'), 1)
    return F.array_distinct(F.concat(quoted, F.regexp_extract_all(t, F.lit(r"\b([A-Z][a-z]+)\b"), 1)))


def token_estimate(text: Column | str) -> Column:
    """1.3 tokens a word, at least one."""
    return F.greatest(F.lit(1), F.floor(F.size(tokens(text)) * 1.3).cast("int")).cast("long")


def wing_name(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(name)), "[ -]", "_")


def entity_id(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(name)), " ", "_"), "'", "")


def trimmed(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the text without white space at its ends."""
    return F.sha2(trimmed(text), 256)


def drawer_id(wing: Column, room: Column, source_file: Column, chunk_index: Column) -> Column:
    """drawer_{wing}_{room}_ and the first 24 hex digits of SHA-256 over source file and chunk number."""
    return F.concat(F.lit("drawer_"), wing, F.lit("_"), room, F.lit("_"), F.substring(F.sha2(F.concat(source_file, chunk_index.cast("string")), 256), 1, 24))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def iso_temporal(value: Column | str) -> Column:
    """YYYY-MM-DD or YYYY-MM-DDTHH:MM:SSZ (+00:00 counts as Z); an empty string stays; anything else is null."""
    v = F.regexp_replace(trimmed(value), r"\+00:00$", "Z")
    form = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}Z)?$"
    return F.when(v == "", v).when(v.rlike(form) & F.try_to_timestamp(F.substring(v, 1, 10), F.lit("yyyy-MM-dd")).isNotNull(), v)


#: Words that count for and against in ``sentiment``; defaults, to be replaced by the caller's own lists.
POSITIVE = ("good", "great", "love", "happy", "success", "works", "fixed", "solved", "excellent", "perfect")
NEGATIVE = ("bad", "broken", "fail", "failed", "error", "bug", "wrong", "hate", "crash", "terrible")


def sentiment(text: Column | str, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """Sign of the distinct positive words less the distinct negative ones."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z]+"), 0))
    hits = lambda xs: F.size(F.array_intersect(words, F.array(*map(F.lit, xs))))
    return F.signum(hits(positive) - hits(negative)).cast("int")


def slices(text: Column | str, size: int = 800, least: int = 30) -> Column:
    """The trimmed text in slices of ``size`` characters; none if it has at most ``least``."""
    t = trimmed(text)
    n = F.ceil(F.length(t) / size).cast("int")
    return F.when(F.length(t) <= least, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(t, k * size + 1, F.lit(size))))


def paragraphs(text: Column | str, lines: int = 25, most: int = 20) -> Column:
    """Blocks between blank lines; a single block of more than ``most`` lines becomes groups of ``lines`` lines."""
    blocks = F.filter(F.transform(F.split(col(text), r"\n\s*\n"), trimmed), lambda x: x != "")
    rows = F.split(col(text), "\n")
    n = F.ceil(F.size(rows) / lines).cast("int")
    grouped = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(rows, k * lines + 1, F.lit(lines)), "\n"))
    return F.when((F.size(blocks) <= 1) & (F.size(rows) > most), grouped).otherwise(blocks)


def topic_room(text: Column | str, topics: dict[str, Sequence[str]], head: int = 3000, fallback: str = "general") -> Column:
    """The topic with the most distinct keywords in the first ``head`` characters; the first of several; else ``fallback``."""
    low = F.lower(F.substring(col(text), 1, head))
    counts = F.array(*[sum((low.contains(k).cast("int") for k in words), F.lit(0)) for words in topics.values()])
    best = F.array_max(counts)
    return F.when(best > 0, F.element_at(F.array(*map(F.lit, topics)), F.array_position(counts, best).cast("int"))).otherwise(fallback)


def strip_noise(text: Column | str) -> Column:
    """Without lines of tool chatter and tags; three and more line ends become two."""
    t = col(text)
    for pattern in (r"(?s)<system-reminder>.*?</system-reminder>", r"(?s)<(command-name|command-message|local-command-stdout)>.*?</\1>", r"(?m)^\s*\[Tool [^\]]*\]\s*$", r"(?m)^\s*… \+\d+ lines.*$", r"(?m)^\s*\d+ tokens?( used)?\s*$"):
        t = F.regexp_replace(t, pattern, "")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def markdown_compress(text: Column | str) -> Column:
    """Blank runs become one line, blanks at line ends go. Text within code fences stays as it is."""
    parts = F.split(col(text), r"(?m)(?=^```)|(?<=^```\n)")
    prose = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")
    return F.array_join(F.transform(parts, lambda x, k: F.when(x.startswith("```") | (k % 2 == 1), x).otherwise(prose(x))), "")


def truncate_bytes(text: Column | str, most: int) -> Column:
    """The longest beginning of at most ``most`` UTF-8 bytes that ends at a character: a bisection over built-in lengths."""
    t = col(text)
    head = F.substring(t, 1, most)
    spare = F.greatest(F.lit(0), F.octet_length(head) - most)
    lengths = F.transform(F.sequence(F.greatest(F.lit(0), F.length(head) - spare), F.length(head)), lambda n: F.when(F.octet_length(F.substring(head, F.lit(1), n)) <= most, n))
    return F.when(F.octet_length(t) <= most, t).otherwise(F.substring(head, F.lit(1), F.array_max(lengths)))


def resolved(text: Column | str) -> Column:
    """Does the text tell of something fixed or solved?"""
    return F.lower(col(text)).rlike(r"\b(fixed|solved|resolved|works now|working now|done|figured (it )?out|that worked|no longer (fails|broken))\b")


def sweep_id(session: Column, uuid: Column) -> Column:
    return F.concat(F.lit("sweep_"), session, F.lit("_"), uuid)


def normalised_blocker(text: Column | str) -> Column:
    """Lower case; paths, uuids and numbers become placeholders. Texts that share it are the same blocker."""
    word = lambda w: (
        F.when(w.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "<uuid>").when(w.contains("/"), "<path>").when(w.rlike(r"^[0-9]+$"), "<num>").otherwise(w)
    )
    return F.array_join(F.transform(tokens(text), word), " ")


def observation_type(tool: Column, hook: Column) -> Column:
    """From the tool's name, and from the hook where that says nothing."""
    t, h = F.lower(F.coalesce(tool, F.lit(""))), F.lower(F.coalesce(hook, F.lit("")))
    kinds = (("file_edit", "edit|patch"), ("file_write", "write|create"), ("file_read", "read|view|cat"), ("search", "grep|search|glob|find"), ("command_run", "bash|shell|exec|run"), ("web_fetch", "web|fetch|http"), ("task", "task|agent"))
    out = F
    for name, pattern in kinds:
        out = out.when(t.rlike(rf"(^|[_-])({pattern})"), name)
    return out.when(h.contains("error"), "error").when(h.contains("prompt"), "conversation").otherwise("other")
