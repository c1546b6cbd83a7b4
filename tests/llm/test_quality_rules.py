import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import quality_rules as Q


def brute_repeats(words, window=5):
    grams = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    count = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(window)})


def test_repeated_words_equals_brute_force():
    r = random.Random(2)
    for _ in range(500):
        words = [r.choice([b"a", b"b", b"c", b"dd"]) for _ in range(r.randint(0, 40))]
        assert Q.repeated_words(words) == brute_repeats(words)
    many = [b"w%d" % r.randint(0, 7000) for _ in range(9000)] * 2  # codes would overflow without renumbering
    assert Q.repeated_words(many) == brute_repeats(many)


def test_cascade_order_takes_rejections_per_second_among_survivors():
    costs = [np.full(4, 1.0), np.full(4, 0.1), np.full(4, 0.1)]
    verdicts = [np.array([1, 1, 1, 0], bool), np.array([1, 0, 0, 0], bool), np.array([1, 1, 0, 0], bool)]
    assert Q.cascade_order(list(zip(costs, verdicts))) == [2, 0, 1]
    assert Q.cascade_order([]) == []


def test_order_changes_no_verdict(docs_of):
    texts = ["#### $$ %%%", "WORD " * 30, "clean words of a plain text " * 2 + "and so on to the end", None]
    rules = Q.BASE_RULES + Q.MORE_RULES
    want = {k for k, t in enumerate(texts) if Q.first_rejection(Q.TextView(t), rules) is None}
    for order in (rules, rules[::-1]):
        assert {r.doc_id for r in Q.filter_quality(docs_of(texts), order).collect()} == want


def test_awkward_rows_equal_sql(docs_of, awkward):
    rows = [(i, t) for i, t in awkward if t is None or "\x00" not in t]
    df = Q.quality_report(docs_of(rows))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(Q.SQL)
    names = [x[0] for x in found.description]
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


def test_all_columns_stay_and_empty_table(docs_of, spark):
    df = docs_of([(1, "plain words in a row that no rule would ever reject here")])
    out = Q.filter_quality(df)
    assert out.schema == df.schema and out.count() == 1
    assert Q.quality_report(df.limit(0)).count() == 0 and Q.filter_quality(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,kept", [("x " * 9, False), ("one two three four five six seven eight nine ten", True), ("ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN", False), ("one# two# three# four five six seven eight nine ten", False)])
def test_verdicts(docs_of, text, kept):
    assert Q.quality_report(docs_of([text])).first().kept is kept
