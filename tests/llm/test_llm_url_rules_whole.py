import random

from test_llm_url_rules import brute_rules

from shelfspark.llm.url_rules import mine_rules


def mined(spark, rows, support, confidence):
    table = spark.createDataFrame(rows, "tokens ARRAY<STRING>, label STRING").repartition(3)
    return {(t, label): c for t, label, c in mine_rules(table, support, confidence)}


def test_a_token_beyond_the_most_telling_ten_makes_rules(spark):
    """Thirteen host words that only blocked URLs have stand before the two words whose pair tells them from the rest."""
    telling = [f"host=h{i:02}" for i in range(13)]
    rows = [([*telling[:i], *telling[i + 1:], "path=x", "path=y"], "block") for i in range(13) for _ in range(2)]
    rows += [(["host=a", "path=x"], "allow")] * 20 + [(["host=a", "path=y"], "allow")] * 20
    found = mined(spark, rows, 0.01, 0.95)
    assert found == brute_rules(rows, 0.01, 0.95) and found[("path=x", "path=y"), "block"] == 1


def test_tokens_that_stand_together_are_not_combined(spark):
    """2 ** 60 frequent combinations, of which a few can be rules."""
    same = [f"path=s{i:02}" for i in range(60)]
    rows = [(same, "block")] * 50 + [(same[:30], "allow")] * 5 + [(["host=a", "path=z"], "allow")] * 45
    assert mined(spark, rows, 0.01, 0.95) == {
        **{((t,), "block"): 1.0 for t in same[30:]}, (("path=z",), "allow"): 1.0}


def test_rules_of_random_sets_by_counting(spark):
    rng = random.Random(7)
    words = [f"host={c}" for c in "abc"] + [f"path={c}" for c in "defghij"]
    longest = 0
    for labels, confidence in ((("allow", "block"), 0.8), (("allow", "block", "ask"), 0.6)):
        rows = []
        for _ in range(150):
            tokens = sorted(rng.sample(words, rng.randint(0, 7)))
            likely = labels[sum(t in tokens for t in ("host=a", "path=d", "path=g")) % len(labels)]
            rows.append((tokens, rng.choice([likely] * 6 + [*labels, None])))
        brute = brute_rules(rows, 0.03, confidence)
        found = mined(spark, rows, 0.03, confidence)
        assert found.keys() == brute.keys() and all(abs(found[k] - brute[k]) < 1e-12 for k in brute)
        longest = max([longest, *(len(t) for t, _ in found)])
    assert longest >= 3
