"""Work that a table's rows share is done once."""

from pyspark.sql import functions as F

from veinstone.operators import evidence as E
from veinstone.plans import plan as P


def test_quota_and_counts_come_from_one_pass(spark):
    """quota_bundles gives the rows of bundles and select_quota, ids that repeat included, without a join of the items with themselves."""
    rows = [(i % 3, "paper", f"paper:{i % 7}", f"{'blue bolt ' if i % 2 else ''}{'small ' if i % 5 else ''}t{i}", "economy" if i % 4 else "b", f"{1990 + i % 9}-01-01") for i in range(60)]
    items = E.dedup(E.score_items(spark.createDataFrame(rows, "expert_id int, type string, item_id string, title string, body string, date string"), ["blue bolt", "small"], ["economy"], 2001))
    own, apart = E.quota_bundles(items, ["blue bolt", "small"]), E.bundles(items, E.select_quota(items, ["blue bolt", "small"]))
    shown = lambda f: sorted(map(str, f.select(*apart.columns).collect()))
    assert shown(own) == shown(apart) and own.where(F.size("selected") > 0).count() == 3
    assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()


def test_a_words_pattern_is_made_once(monkeypatch):
    made = []
    real = P.term_pattern
    monkeypatch.setattr(P, "term_pattern", lambda terms: made.append(1) or real(terms))
    P.fallback_plan("find zinc quark expert")
    first = len(made)
    P.fallback_plan("find lead gluon expert")
    assert len(made) == first <= 3
