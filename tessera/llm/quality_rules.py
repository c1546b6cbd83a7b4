"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are measured on a sample; the rules then run in the order of rejections per second among
the documents that the rules before them let pass. A document stops at the first rule that rejects it. The rules are a
conjunction, so the order changes the cost and never the verdict.

Defined results: a null text counts as empty; repeated rows are judged each on its own, rows with null ids as others; a very long
text is read whole (only the sample leaves texts over SAMPLE_BYTES out); a measure that equals its limit passes; of rules that reject
as much a second the first named comes first; an empty table gives an empty result; columns other than doc_id and text are not
looked at, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows and bytes a row that the profile of the rules may look at.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 65536


class _Ids(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which the text has twice or more."""
    n = len(words)
    if n <= window:
        return 0
    seen = _Ids()
    ids = np.fromiter(map(seen.__getitem__, words), np.int64, n)
    codes, base = ids[: n - window + 1], len(seen)
    if base == n:
        return 0
    span = base
    for k in range(1, window):
        if span > 2**62 // base:  # the code would overflow: give the codes so far small numbers
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
            span = len(codes)
        codes, span = codes * base + ids[k : n - window + 1 + k], span * base
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(codes, twice))
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int(np.count_nonzero(np.cumsum(marks)[:n]))


class TextView:
    """A text with measures that are taken when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_upper(self) -> int:
        return sum(map(self.text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextView], bool]


#: The two rules of the base verdict.
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 10),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
)
#: Ratios in whole numbers, so that SQL says the same.
MORE_RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > 2 * t.n_words),
    Rule("short_words", lambda t: t.word_chars < 2 * t.n_words),
    Rule("long_words", lambda t: t.word_chars > 15 * t.n_words),
    Rule("upper_case", lambda t: 2 * t.n_upper > t.word_chars),
    Rule("repeated_lines", lambda t: t.n_dup_lines >= 3 and 2 * t.n_dup_lines > len(t.lines)),
)


def profile(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every rule, on a sample: seconds and verdict for each text.

    The sample is the first ``rows`` texts of at most SAMPLE_BYTES that the scan yields, so that its size is bounded
    whatever the table. Only the order of the rules depends on it.
    """
    picked = documents(docs).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).select("text").limit(rows).collect()
    out = []
    for rule in rules:
        seconds, verdicts = np.zeros(len(picked)), np.zeros(len(picked), bool)
        for i, (text,) in enumerate(picked):
            view = TextView(text)
            began = time.perf_counter()
            verdicts[i] = rule.rejects(view)
            seconds[i] = time.perf_counter() - began
        out.append((seconds, verdicts))
    return out


def cascade_order(profiled: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """Greedy: next comes the rule with the most rejections a second among the texts that no rule before it rejected."""
    left, order = list(range(len(profiled))), []
    alive = np.ones(len(profiled[0][0]), bool) if profiled else np.zeros(0, bool)
    while left:
        rate = lambda k: (profiled[k][1][alive].sum() + 1e-6) / (profiled[k][0][alive].sum() + 1e-9)
        best = max(left, key=lambda k: (rate(k), -k))
        left.remove(best)
        order.append(best)
        alive &= ~profiled[best][1]
    return order


def planned(docs: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    return [rules[k] for k in cascade_order(profile(docs, rules))]


def first_rejection(view: TextView, rules: Sequence[Rule]) -> str | None:
    return next((rule.name for rule in rules if rule.rejects(view)), None)


def filter_quality(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text no rule rejects."""
    order, at = planned(docs, rules), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([first_rejection(TextView(x), order) is None for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def quality_report(docs: DataFrame, rules: Sequence[Rule] = MORE_RULES) -> DataFrame:
    """A row for each document: base measures and verdict, and whether it passes the cascade as well."""
    order = planned(docs, rules)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                t = TextView(text)
                failed = any(rule.rejects(t) for rule in BASE_RULES)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and first_rejection(t, order) is None))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64() if k < 5 else pa.bool_()) for k, c in enumerate(columns))], ["doc_id", *names])

    return documents(docs).mapInArrow(measure, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w WHERE len(ws) > 5),
g AS (SELECT r, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d, lead(word, 4) OVER o AS e
      FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c, d, e) AS n FROM g WHERE e IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM t, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
      FROM w JOIN l USING (r) LEFT JOIN rep USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > 2 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
           OR 2 * n_upper > word_chars OR (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines)) AS kept
FROM v
"""
