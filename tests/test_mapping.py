from __future__ import annotations

import random

from ledgerflow.operators import mapping as M


def test_single_labels():
    assert M.map_label("BalanceSheet", "Deferred income taxes", "CURRENT_ASSET").standard_item == "Deferred Income Taxes (Assets)"
    assert M.map_label("BalanceSheet", "Deferred income taxes", "LIABILITY").standard_item == "Deferred Income Taxes (Liabilities)"
    assert M.map_label("BalanceSheet", "Deferred income taxes", "LIABILITY").confidence >= 0.9
    assert M.map_label("IncomeStatement", "Gross margin").standard_item == "Gross Margin"
    assert M.map_label("IncomeStatement", "Gross margin rate").relationship != "exact_concept"
    fund = M.map_label("IncomeStatement", "Net increase in net assets from operations")
    net = M.map_label("IncomeStatement", "Net income")
    assert fund.internal_id != net.internal_id and fund.analytical_family == net.analytical_family == "period_result"
    assert M.map_label("BalanceSheet", "something else").rule == "unmapped"


def by_all_pairs(kind, label, context):
    """The best alias by trying each."""
    key, found = M.label_key(label), []
    for at, a in enumerate(x for x in M.aliases() if x.statement_type == kind and x.alias):
        if a.contexts and not any(c in context.upper() for c in a.contexts):
            continue
        score = M.EXACT if key == a.alias else 0.0 if a.exact_only else M.SUBSET if set(a.alias.split()) <= set(key.split()) else M.SUBSTRING if a.alias in key else min(M.FUZZY_TOP, r * M.FUZZY_SCALE) if (r := M.ratio(key, a.alias)) >= M.FUZZY_RATIO else 0.0
        if score:
            found.append((min(1.0, score + M.CONTEXT_BONUS * bool(a.contexts)), -at, a.standard_item))
    score, _, item = max(found, default=(0.0, 0, label))
    return (item, round(score, 3)) if score >= M.LEAST else (label, 0.0)


def test_the_index_finds_what_all_pairs_find():
    rng = random.Random(9)
    every = [a for a in M.aliases() if a.alias]
    words = [w for a in every for w in a.alias.split()]
    seen = set()
    for i in range(2000):
        a = rng.choice(every)
        label = list(a.alias)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(label) + 1)
            label[at : at + rng.choice([0, 1])] = rng.choice(["", "q", "s", " ", rng.choice("abcdefgh")])
        label = "".join(label)
        if i % 4 == 0:
            label = f"{rng.choice(words)} {label} {rng.choice(words)}"
        context = rng.choice(["", "ASSET", "current_asset", "LIABILITY", "EQUITY"])
        got = M.map_label(a.statement_type, label, context)
        if got.internal_id != M.FUND_RESULT[3]:
            assert (got.standard_item, got.confidence) == by_all_pairs(a.statement_type, label, context), (label, context)
            seen.add(got.rule)
    assert seen == {"exact_alias", "token_subset_context", "substring_context", "fuzzy", "unmapped"}


def test_the_index_compares_few_labels(monkeypatch):
    calls = []
    monkeypatch.setattr(M, "ratio", lambda a, b: calls.append((a, b)) or 0.0)
    index = M.LabelIndex([a for a in M.aliases() if a.statement_type == "BalanceSheet"])
    for label in ("accounts receivablle", "gooodwill", "nothing like any of these", "zzzz"):
        index.alike(label)
    assert len(calls) < 12


def test_the_join_agrees_with_single_labels(spark):
    random.seed(4)
    words = [w for a in M.aliases() for w in a.alias.split()]
    labels = [a.alias for a in M.aliases()]
    rows = []
    for i in range(600):
        kind = random.choice(["BalanceSheet", "IncomeStatement", "CashFlowStatement", "PartnersCapital", "Other"])
        label = random.choice(labels)
        if i % 3 == 0:
            label = f"{random.choice(words)} {label.title()}, {random.choice(words)}"
        if i % 3 == 1:
            at = random.randrange(len(label))
            label = label[:at] + "q" + label[at + 1 :]
        rows.append((i, kind, label, random.choice(["", "ASSET", "CURRENT_ASSET", "liability", None])))
    rows += [(700, "BalanceSheet", None, ""), (701, "BalanceSheet", " ", "")]
    got = M.map_concepts(spark.createDataFrame(rows, "i int, statement_type string, raw_item string, context string")).collect()
    assert len(got) == len(rows)
    for r in got:
        own = M.map_label(r["statement_type"], r["raw_item"] or "", r["context"] or "")
        assert (r["rule"], r["confidence"], r["relationship"]) == (own.rule, own.confidence, own.relationship), r
        assert own.rule == "unmapped" or r["standard_item"] == own.standard_item, r
