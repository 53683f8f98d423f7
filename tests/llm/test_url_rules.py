"""Mined url rules where pages have more items than FP-growth takes: held against counting all combinations."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from precepta.llm import url_filter

SCHEMA = "tokens array<string>, blocked boolean"


def pages(share_of_wide):
    rng = np.random.default_rng(17)
    out = []
    for _ in range(500):
        likely = 0.7 if rng.random() < share_of_wide else 0.18
        tokens = [t for t in "abcdefgh" if rng.random() < likely]
        bad = {"a", "b", "c"} <= set(tokens) or {"d", "g"} <= set(tokens) and rng.random() < 0.9 or rng.random() < 0.15
        out.append((tokens, bool(bad)))
    return out


def brute_force(given, support):
    where = {t: frozenset(i for i, (x, _) in enumerate(given) if t in x) for t in "abcdefgh"}
    assert len(set(where.values())) == 8
    scored, least = {}, max(support * len(given), 10)
    for k in range(1, 5):
        for combo in itertools.combinations("abcdefgh", k):
            on = frozenset.intersection(*(where[t] for t in combo))
            n, bad = len(on), sum(given[i][1] for i in on)
            if bad >= least and (p := bad / n) - url_filter.Z * np.sqrt(p * (1 - p) / n + 0.25 / n**2) >= 0.5:
                scored[combo] = (p, n)
    return {c: v for c, v in scored.items() if not any(scored.get(s, (0,))[0] >= v[0] for k in range(1, len(c)) for s in itertools.combinations(c, k))}


@pytest.mark.parametrize(("share_of_wide", "mined_items"), [(0.5, 3), (0.5, 0), (0.02, 5), (0.5, 8)])
def test_rules_of_pages_with_many_items(spark, share_of_wide, mined_items):
    given = pages(share_of_wide)
    want = brute_force(given, 0.02)
    got = url_filter.mined_rules(spark.createDataFrame(given, SCHEMA), support=0.02, mined_items=mined_items).collect()
    assert {tuple(r["items"]): (pytest.approx(r["confidence"]), r["n"]) for r in got} == want
    assert share_of_wide < 0.5 or max(map(len, want)) >= 3


def test_least_support_is_reached_by_ten_pages(spark):
    given = [(["a", "b"], True)] * 10 + [(["a"], False)] * 20 + [(["b"], False)] * 20 + [([], False)] * 53
    for mined_items in (1, 16):
        got = url_filter.mined_rules(spark.createDataFrame(given, SCHEMA), mined_items=mined_items).collect()
        assert [(r["items"], r["n"]) for r in got] == [(["a", "b"], 10)]
