"""What is told by prefix sums and scans is what a plain loop tells."""

import random

from turnmill.operators import kpi, review, scope

DAY = review.DAY


def test_regression_check(spark):
    """Changes at the same time, at the edges, without turns; scores that are null or 0; times before the epoch."""
    r = random.Random(2)
    now = 3 * DAY
    turns = [(r.randint(now - 22 * DAY, now + DAY) // 1000 * 1000, r.choice([None, 0.0, 0.1, 0.7, 1 / 3])) for _ in range(1500)] + [(-5 * DAY, 0.5)] * 40
    changes = [(f"c{i}", r.choice([r.randint(now - 15 * DAY, now), -5 * DAY, turns[i][0]]), None if i % 9 else 7) for i in range(200)] + [("far", now - 14 * DAY, None), ("near", now - 2 * DAY, None)]
    got = review.regression_check(spark.createDataFrame(changes, "change_id string, applied_at long, reverted_at long"), spark.createDataFrame(turns, "started_at long, kpi_score double"), now, least=5)
    got = {x.change_id: x for x in got.collect()}
    live = [(c, at) for c, at, gone in changes if gone is None and now - 14 * DAY <= at <= now - 2 * DAY]
    assert set(got) == {c for c, _ in live} and len(live) > 100
    for c, at in live:
        before = [s for t, s in turns if s is not None and at - 7 * DAY <= t < at]
        after = [s for t, s in turns if s is not None and at <= t < min(now, at + 7 * DAY)]
        x = got[c]
        assert (x.n_before, x.n_after) == (len(before), len(after))
        for mean, some in ((x.mean_before, before), (x.mean_after, after)):
            assert mean is None and not some or abs(mean - sum(some) / len(some)) < 1e-12
        assert (x.verdict == "insufficient_samples") == (min(len(before), len(after)) < 5)
    none = review.regression_check(spark.createDataFrame(changes, "change_id string, applied_at long, reverted_at long"), spark.createDataFrame([], "started_at long, kpi_score double"), now)
    assert {(x.n_before, x.verdict) for x in none.collect()} == {(0, "insufficient_samples")}


def test_trailing_percentiles_are_exact(spark):
    """Longs beyond 2^53 beside nulls, the ends of the range of longs, many turns of one time."""
    r = random.Random(6)
    walls = [None, 2**53 + 1, 2**53 + 2, 2**53 + 3, -(2**63), 2**63 - 1]
    rows = [(i, r.choice(["a", None]), r.choice(["x", None]), r.choice([r.randint(-500, 500), 7, 7]), r.choice([None, 1, 30]), None, r.choice(walls)) for i in range(300)]
    df = spark.createDataFrame(rows, "turn_id long, source string, tier string, started_at long, prompt_tokens long, completion_tokens long, wall_ms long")
    rank = lambda v, p: sorted(v)[round(p * (len(v) - 1))] if v else None
    near = {x[0]: [y for y in rows if y[1:3] == x[1:3] and x[3] - 100 <= y[3] < x[3]] for x in rows}
    want = {i: (rank([y[4] for y in some if y[4]], 0.5), rank([y[6] for y in some if y[6] is not None], 0.95)) for i, some in near.items()}
    assert {x.turn_id: (x.base_tokens, x.base_wall) for x in kpi.trailing_percentiles(df, 100).collect()} == want
    assert kpi.trailing_percentiles(df.limit(0), 100).count() == 0


def test_phrases_of_any_length(spark):
    """Of one to four words or one letter, beginning inside words, across lines, with letters beyond 16 bits: as a plain search finds them."""
    r = random.Random(7)
    words = ["no", "again", "é😀", "x", "that's", "not", "what", "i", "asked", "İx", "a\nb", "the"]
    texts = [(f"s{i % 5}", i, " ".join(r.choice(words).upper() if r.random() < 0.2 else r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(200)] + [("s", 900, None), ("s", 901, "")]
    phrases = {*words, "", None, "t", "gain no", "ot what i", "😀 not", "b the", "never there", "asked again no not", *(" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(60))}
    turns = spark.createDataFrame(texts, "session string, idx int, text string")
    low = {(x.session, x.idx): x.low for x in turns.selectExpr("session", "idx", "lower(text) AS low").collect()}
    got = [tuple(x) for x in scope.phrase_hits(spark.createDataFrame([(p,) for p in phrases] * 2, "phrase string"), turns).collect()]
    want = {(p, *k) for p in phrases if p for k, t in low.items() if t and p in t}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert scope.phrase_hits(spark.createDataFrame([("",)], "phrase string"), turns).count() == 0
