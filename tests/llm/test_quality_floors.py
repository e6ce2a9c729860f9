"""Each repetition statistic can reject a document alone."""

import random

from tickforge.llm import quality as Q


def test_repetition_alone_reaches_the_cut():
    assert 1 / Q.FLOORS[3] ** 2 > Q.CUT
    assert Q.MAX_REPEAT / 100 / Q.FLOORS[4] ** 2 > Q.CUT


def test_repeated_lines_are_rejected(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(3000)]
    plain = [" ".join(rng.choice(vocab) for _ in range(rng.randint(100, 300))) for _ in range(250)]
    few = ["abcde", "bcdef", "acegh", "fghab", "cdefh"]
    doubled = "\n".join(rng.choice(few) for _ in range(200))
    rows = [(i, t, "en", "s") for i, t in enumerate([*plain, doubled])]
    got = {r.doc_id: r for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[250].base_failed and got[250].n_repeat_words < 10 and not got[250]["kept"]
    assert all(got[i]["kept"] for i in range(250))
