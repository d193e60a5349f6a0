from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import ODD, by_sql, rows_of, table, written

from ledgerflow.llm import decontamination, line_dedup, near_dup, quality_classifier, quality_rules, shared, sharding, url_filter, words


def clash(frame):
    """Further columns whose names the operators use inside."""
    return frame.selectExpr("*", "'x' AS id", "1 AS key", "2 AS n", "'y' AS node", "3 AS _id", "4 AS first", "5 AS kept", "6 AS bucket")


# Sharding


@pytest.mark.parametrize("rows", [ODD, [], [(i, f"t{i % 7}", "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(5000)]])
def test_shards_match_the_sql(spark, tmp_path, rows):
    docs = table(spark, rows)
    got = sharding.op1_interleaved_shards(spark, written(spark, tmp_path, documents=clash(docs))).toPandas()
    assert len(got) == len(rows)
    assert sorted(got["text_crc32"]) == sorted(zlib.crc32((r[1] or "").encode()) for r in rows)
    sizes = got.groupby("shard").size().reindex(range(24), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    if rows and rows is not ODD:
        own = ["doc_id", "shard", "slot"]
        assert rows_of(got[own]) == rows_of(by_sql(sharding.ORACLE_SQL["op1_interleaved_shards"], documents=docs.toPandas())[own])
        mix = got[got["source"] == "hot"].groupby("shard").size()
        assert mix.max() - mix.min() <= 6  # a cut may move by half a row for each of the six sources


def test_rows_that_are_repeated_very_often_are_no_group(spark, tmp_path):
    rows = [(None, "t", "en", "hot", 1)] * 4000 + [(None, f"t{i}", "en", "hot", 1) for i in range(3000)] + [(7, f"u{i}", "en", "s", 1) for i in range(3000)]
    got = sharding.interleave(table(spark, rows), 8, group_rows=100).toPandas()
    assert (got.groupby("shard").size() == 1250).all()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(1250)) and abs((own["source"] == "hot").sum() - 875) <= 2
    keys = table(spark, rows).select(sharding.seeded(7, F.lit("=hot"), F.col("doc_id"), F.crc32(F.col("text").cast("binary")))).distinct().count()
    assert keys == 6001


# Line dedup


def test_lines_match_the_sql(spark, sf):
    got = line_dedup.op9_line_dedup(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert rows_of(got) == rows_of(by_sql(line_dedup.ORACLE_SQL["op9_line_dedup"], documents=docs))


def test_odd_lines(spark, monkeypatch):
    monkeypatch.setattr(shared, "HEAVY_LEAST", 5)
    common, marks = "  A Very common LINE\t", [None, "", "short", "ÄÖÜ line of ten", "äöü line of ten"]
    rows = [(i, "\n".join(filter(None, [common, f"own line number {i}", marks[i % 5], "x" * 9, common.lower()]))) for i in range(60)] + [(99, None), (98, ""), (97, "\n\n"), (None, "a very common line\nmy own long line"), (5, "a very common line")]
    got = {(r["doc_id"], r["text"]): r for r in line_dedup.drop_repeated_lines(clash(table(spark, rows))).collect()}
    first: dict[str, int] = {}
    holders = defaultdict(set)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    place = lambda d: 1 << 70 if d is None else d
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(place(d))
                first[key(line)] = min(first.get(key(line), 1 << 71), place(d))
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and place(d) > first[key(x)])]
        r = got[d, t]
        assert (r["kept_text"], r["n_lines"], r["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.drop_repeated_lines(table(spark, [])).count() == 0


# Quality rules


def test_lines_of_a_row_that_is_repeated_very_often(spark):
    rows = [(1, "a line of its own\nshared by many"), (9, "shared by many\nfirst seen in nine"), *[(2, "shared by many\nb")] * 3000, *[(None, None)] * 2500, *[(None, "first seen in nine\nc")] * 1200]
    frame = table(spark, rows).repartition(8)
    got = line_dedup.drop_repeated_lines(frame)
    assert "_salt" in got._jdf.queryExecution().analyzed().toString()
    counted = {(r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]): r["count"] for r in got.groupBy("doc_id", "kept_text", "n_lines", "n_dropped").count().collect()}
    assert counted == {(1, rows[0][1], 2, 0): 1, (9, "first seen in nine", 2, 1): 1, (2, "b", 2, 1): 3000, (None, "", 1, 0): 2500, (None, "c", 2, 1): 1200}


def test_base_rules_by_brute_force(spark):
    rows = [*[(i, t) for i, (_, t) in enumerate(ODD)], (50, "a b c d e f g h " * 6), (51, "q w e r t y u i o p a s d f g h j k l z x. " * 2), (52, "line one is here\nline one is here\n \n \nother")]
    got = {r["id"]: r for r in quality_rules.clean_lines(clash(table(spark, rows)).drop("id")).collect()}
    import re

    for d, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        repeats = len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats)
        assert r["base_failed"] == (len(w) < 20 or 100 * repeats > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.clean_lines(table(spark, [])).count() == 0


def test_rules_match_the_sql(spark, sf):
    got = quality_rules.op7_line_first_cleaning(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert rows_of(got) == rows_of(by_sql(quality_rules.ORACLE_SQL["op7_line_first_cleaning"], documents=docs))


def test_line_rules():
    good = "A sentence of some length that ends as it should."
    assert [quality_rules.line_fails(x) for x in (good, "Home | About | Contact", "Short heading", "buy### now*** cheap$$$ pills&&&", "We use cookies to improve this site.", "one long line without any mark at its end that goes on for more than ten words")] == [None, "navigation", "punctuation", "punctuation", "boilerplate", None]
    foreign = ("Datenschutzerklärung und Impressum finden Sie hier.", "Mentions légales et politique de confidentialité.", "Todos los derechos reservados por el autor.", "© 1999 by whoever wrote it.", "https://a.b/c www.d.e")
    assert [quality_rules.line_fails(x) for x in foreign] == ["boilerplate"] * 4 + ["navigation"]
    assert quality_rules.line_fails("The page at www.example.com tells more about all of it.") is None
    text = "\n".join(["Home | About | Contact", good, "Another one, quite unlike the first, says something else.", "The third adds a few words so that there are enough of them."])
    *_, kept, removed, lost, cleaned = quality_rules.judge(text)
    assert kept and removed == 1 and lost == 5 and "Home" not in cleaned
    assert not quality_rules.judge("\n".join(f"item{i} | other{i} | third{i} | last{i} |" for i in range(30)))[6]


# Quality classifier


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_classifier.op8_additive_quality(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    both = got.merge(labels, on="doc_id")
    own = both[both["held_out"]]
    assert (own["predicted"] == own["quality"]).mean() > 0.97


def test_classifier_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, None, 0), (None, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for rows in (ODD, []):
        assert quality_classifier.quality_scores(clash(table(spark, rows)), labels).count() == len(rows)
        assert quality_classifier.accepted(clash(table(spark, rows)), labels).columns == clash(table(spark, [])).columns
    assert set(quality_classifier.quality_scores(table(spark, ODD), labels.limit(0)).toPandas()["predicted"]) == {1}


def test_model_finds_pairs():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality_classifier.fit(x[:3000], y[:3000])
    assert (1, 0) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85
    assert quality_classifier.fit(x[:0], y[:0]).score(x).tolist() == [0.5] * 4000
    for row, got in zip(x[:200], model.score(x[:200]), strict=True):  # by a loop over the tables
        odds = model.base + sum(t[sum(e <= v for e in edges)] for t, edges, v in zip(model.tables, model.edges, row, strict=True))
        odds += sum(t[sum(e <= row[i] for e in model.coarse[i]), sum(e <= row[j] for e in model.coarse[j])] for t, (i, j) in zip(model.pair_tables, model.pairs, strict=True))
        assert got == pytest.approx(1 / (1 + np.exp(-odds)))


def test_the_first_split_by_brute_force():
    """One round of one feature: the cut of two leaves and their values, against all cuts."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        g, h = rng.normal(size=8), rng.uniform(0.1, 1, 8)
        value = lambda a, b: g[a:b].sum() / (h[a:b].sum() + 1)
        gains = [sum(value(a, b) ** 2 * (h[a:b].sum() + 1) for a, b in ((0, k), (k, 8))) for k in range(1, 8)]
        k = int(np.argmax(gains)) + 1
        assert quality_classifier._tree(g, h, 1.0, leaves=2) == pytest.approx([value(0, k)] * k + [value(k, 8)] * (8 - k))


def test_repeated_ids_train_alike(spark):
    docs = [(i, f"some words of text {i} " * (1 + i % 5)) for i in range(60)] + [(i, "other text under the same id! " * 3) for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = (quality_classifier.quality_scores(table(spark, rows).repartition(n), labels).toPandas().sort_values(["id", "score"])["score"].tolist() for rows, n in ((docs, 2), (docs[::-1], 5)))
    assert a == b


# Decontamination


def brute_leaks(docs, items, least=decontamination.LEAST_ITEM):
    """Overlaps over all shifts, without seeds, in plain Python: (doc, item, place, place in the item, words, equal words)."""

    def stretches(equal, need):
        best = (0, 0, 0)
        for b in range(1, len(equal) + 1):
            for a in range(b - 1, -1, -1):
                score = sum(1 if e else -decontamination.DIFFERENCE for e in equal[a:b])
                if score > best[0]:
                    best = (score, a, b)
        _, a, b = best
        if not best[0]:
            return []
        here = [(a, b, sum(equal[a:b]))] if sum(equal[a:b]) >= need else []
        return here + stretches(equal[:a], need) + [(x + b, y + b, n) for x, y, n in stretches(equal[b:], need)]

    import regex

    plain = lambda t: regex.findall(r"[^\s\p{P}\p{S}]+", (t or "").lower())
    out = []
    for d, t in docs:
        w = plain(t)
        for i, u in items:
            v, found = plain(u), []
            if len(v) < least:
                continue
            need = min(decontamination.LEAST_EQUAL, len(v))
            for shift in range(-len(v) + 1, len(w)):
                equal = [0 <= shift + k < len(w) and w[shift + k] == v[k] for k in range(len(v))]
                if sum(equal) >= need:
                    found += [(-n, shift + a, a, b - a) for a, b, n in stretches(equal, need)]
            taken = set()
            for n, at, own, size in sorted(found):
                if not taken & set(range(at, at + size)):
                    taken |= set(range(at, at + size))
                    out.append((d, i, at, own, size, -n))
    return sorted(out, key=str)


def leaks_of(spark, docs, items, **how):
    return sorted((tuple(r) for r in decontamination.leaks(clash(table(spark, docs)), spark.createDataFrame(items, "item_id long, text string"), **how).collect()), key=str)


SENT = pytest.mark.parametrize("how", [{}, {"sent_words": 0}], ids=["sent", "joined"])


@SENT
def test_leaks(spark, how):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    speak = lambda n: list(rng.choice(vocabulary, n))
    items = [(i, " ".join(speak(n))) for i, n in enumerate([30, 30, 30, 9, 8, 7, 13, 40])] + [(8, None), (9, ""), (0, "again the same id with other words " * 3), (10, "one two three four five six seven eight")]
    docs = [(i, " ".join(speak(60))) for i in range(12)]
    for k in (0, 3, 4, 5, 6):
        docs.append((100 + k, " ".join(speak(50)) + f" {items[k][1].upper()}, " + " ".join(speak(20))))
    changed = items[1][1].split()
    for at in (6, 13, 20, 27):
        changed[at] = "OTHER"
    docs += [(200, " ".join(speak(30) + changed)), (201, " ".join(items[2][1].split()[:14])), (202, " ".join(items[2][1].split()[:9])), *ODD[:-1]]
    got = leaks_of(spark, docs, items, **how)
    assert got == brute_leaks(docs, items)
    assert {(d, i) for d, i, *_ in got} == {(100, 0), (103, 3), (104, 4), (106, 6), (200, 1), (201, 2), (4, 10), (5, 10)}
    assert leaks_of(spark, docs, items, least_item=1, **how) == brute_leaks(docs, items, 1)
    assert {r["id"]: r["n_words"] for r in decontamination.skipped_items(spark.createDataFrame(items, "item_id long, text string")).collect()} == {5: 7, 8: 0, 9: 0}
    left = decontamination.without_leaks(clash(table(spark, docs)), spark.createDataFrame(items, "item_id long, text string"), **how)
    assert left.columns == clash(table(spark, [])).columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter((d, t) for d, t in docs if not brute_leaks([(d, t)], items))
    assert leaks_of(spark, [], [], **how) == leaks_of(spark, docs, [], **how) == leaks_of(spark, [], items, **how) == []


@SENT
def test_leaks_that_come_again_and_tie(spark, how):
    rng = np.random.default_rng(4)
    speak = lambda n, size=3: list(rng.choice([f"v{i}" for i in range(size)], n))
    item = [f"u{i}" for i in range(40)]
    docs = [(1, " ".join(item[2:17] + speak(40, 900) + item[20:36] + speak(5, 900) + item[20:36])), (2, " ".join(item[:15] + speak(8, 900) + item[23:40])), (3, " ".join("one two " * 40)), (3, " ".join(speak(60)))]
    docs += [(10 + k, " ".join(speak(50))) for k in range(6)] + [(30, "She said: “quick” brown fox’s tail — it jumps «over» the lazy dog; again…")]
    items = [(0, " ".join(item)), (1, "one two " * 10), (2, " ".join(speak(30))), (3, " ".join(speak(20))), (4, "she said \"quick\" brown fox's tail: it jumps over the lazy dog again"), (5, "one two one two one two three")]
    got = leaks_of(spark, docs, items, **how)
    assert got == brute_leaks(docs, items)
    assert [x[2:] for x in got if x[:2] == (1, 0)] == [(0, 2, 15, 15), (55, 20, 16, 16), (76, 20, 16, 16)] and [x[1] for x in got if x[0] == 30] == [4]


def test_a_test_set_of_many_bytes_and_few_words_is_joined(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SENT_BYTES", 200)
    words = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([(1, words), (2, "x" * 300)], "item_id long, text string")
    assert decontamination._sent(decontamination._items(items, "item_id", "text"), 10**6, 8) is None
    got = [tuple(r) for r in decontamination.leaks(table(spark, [(7, f"some {words} more"), (8, "clean text")]), items).collect()]
    assert got == [(7, 1, 1, 0, 30, 30)]


def test_leaks_of_changed_words():
    """Each passage of an item with some words changed is found, against a search along all shifts."""
    rng = np.random.default_rng(6)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, 30))) for i in range(40)]
    block, found, all_ = decontamination.TestItems(items), 0, 0
    for share in (0.05, 0.1, 0.15, 0.2):
        for i, t in items:
            words = [w if rng.random() > share else "other" for w in t.split()]
            want = brute_leaks([(0, " ".join(words))], [(i, t)])
            got = [x for x in block.overlaps(words_of_text(" ".join(words))) if x[0] == i]
            all_, found = all_ + len(want), found + len({x[1:] for x in got} & {x[2:] for x in want})
    assert all_ > 100 and found >= 0.99 * all_


def words_of_text(text):
    return words.hashes.of(decontamination.plain_words(text))


def test_a_text_of_one_word():
    import time

    block, began = decontamination.TestItems([(i, "again " * 100) for i in range(5)]), time.process_time()
    got = block.overlaps(words_of_text("again " * 60_000))
    assert len(got) == 5 * 600 and all(x[3:] == (100, 100) for x in got)
    assert time.process_time() - began < 60


# URL filter


def test_urls_by_brute_force(spark):
    import re

    urls = ["http://A.Example.com/en/1?x#y", "https://www.example.com/en/", "https://example.com/EN/", "http://b.net/es/q", "http://notnet/es/q", "http://xexample.com/en/", "http://com/", "http://x.com", "x://y://z/", "no scheme", "", None, "http://", "http://?q", "ftp://u:p@h.net:80/fr/1#", "http://cheappills.example.org/de/5", "http://" + "ab" * 400 + ".io/", "http://Ä.net/fr/"]
    frame = spark.createDataFrame([(i, u, f"<p>cheap pills example {i}</p><script>bad words</script>") for i, u in enumerate(urls)] + [(None, "http://a.net/es/", None), (0, urls[0], "")], "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS rule", "'z' AS id")
    got = {r["id"]: r for r in url_filter.judged(frame).collect()}
    for i, u in enumerate(urls):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert not fits or got[i]["verdict"] == max(fits)[2]
        assert got[i]["verdict"] in ("allow", "block")
    assert got[15]["host_words"] == ["cheap", "pills", "example"]
    assert url_filter.judged(frame.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(1, 50), max_size=12))
def test_splits_by_brute_force(name, counts):
    import math

    total = sum(counts.values()) + 2
    cost = lambda words: sum(math.log(total / counts[w]) if w in counts else math.log(total) + 2.5 * len(w) + 1 for w in words)

    def ways(rest):
        return [[]] if not rest else [[rest[:k], *more] for k in range(1, len(rest) + 1) for more in ways(rest[k:])]

    got = url_filter.best_split(name, counts, total)
    assert "".join(got) == name and cost(got) == pytest.approx(min(map(cost, ways(name))))


def test_verdicts_by_brute_force(spark):
    """Naive Bayes over the words that the operator reports, counted in plain Python."""
    import math
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in pages.select("page_id", "url").collect()}
    rows = url_filter.judged(pages).collect()
    tokens = lambda r: ["h:" + w for w in r["host_words"]] + ["p:" + w for w in re.findall(r"[^\W\d_]+|0", re.sub("[0-9]+", "/0/", r["path"].lower()))]
    seen, priors = {v: Counter() for v in ("allow", "block")}, Counter()
    for r in rows:
        if r["rule"] is not None:
            priors[r["verdict"]] += 1
            seen[r["verdict"]].update(tokens(r))
    words = set(seen["allow"]) | set(seen["block"])
    chance = lambda w, v: math.log((seen[v][w] + 1) / (seen[v].total() + len(words)))
    rest = [r for r in rows if r["rule"] is None]
    assert len(rest) > 50 and priors["allow"] and priors["block"] and len(urls) == len(rows)
    for r in rest:
        odds = math.log((priors["allow"] + 1) / (priors["block"] + 1)) + sum(chance(w, "allow") - chance(w, "block") for w in tokens(r) if w in words)
        assert r["log_odds"] == pytest.approx(odds) and r["verdict"] == ("allow" if odds >= 0 else "block")


def test_a_very_long_host(spark):
    import time

    rows = [(1, "http://" + "cheappills" * 10_000 + ".example/x", "cheap pills"), (2, "http://cheappills.io/", "cheap pills pills"), (3, "http://" + "x" * 100_000, "")]
    began = time.time()
    got = {r["id"]: r["host_words"] for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ["cheap", "pills"] * 10_000 and got[2] == ["cheap", "pills"] and got[3] == []
    assert time.time() - began < 120


# Near duplicates


def brute_classes(docs, least=0.8):
    """Exact copies and all pairs of that weighted Jaccard similarity, counted in plain Python over an inverted index of shingles; rows are named by their place."""
    nodes, sets, parent = {}, {}, {}
    for i, (_, t) in enumerate(docs):
        w = (t or "").lower().split()
        n = nodes.setdefault(" ".join(w), i)
        sets.setdefault(n, Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
        parent.setdefault(n, n)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for d, own in sets.items():
        both = Counter()
        for c, n in own.items():
            for e in seen[c]:
                both[e] += min(n, sets[e][c])
            seen[c].append(d)
        for e, n in both.items():
            if n >= least * (own.total() + sets[e].total() - n) - 1e-9:
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    found = [find(nodes[" ".join((t or "").lower().split())]) for _, t in docs]
    least_id = {c: min((d for (d, _), x in zip(docs, found, strict=True) if x == c and d is not None), default=None) for c in set(found)}
    return {docs[i]: least_id[c] for i, c in enumerate(found)}


def planted(n_star=150):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    speak = lambda n: list(rng.choice(vocabulary, n))
    docs, base = [], speak(300)
    for i in range(n_star):  # copies of one text, each with edits of its own; many pairs of them are under the threshold
        own = list(base)
        for at in rng.choice(300, int(rng.integers(0, 14)), replace=False):
            own[at] = "edit"
        docs.append(" ".join(own))
    docs += [" ".join(base)] * 50
    for _ in range(60):
        own = speak(int(rng.integers(1, 400)))
        docs.append(" ".join(own))
        own[len(own) // 2] = "changed"
        docs.append(" ".join(own).upper())
    chain = speak(200)
    for i in range(20):  # each near the next, the ends far apart
        docs.append(" ".join(chain))
        chain[10 * i] = f"c{i}"
    docs += ["", "", "one", "One ", "a b c d", "a b c d", "a b a b a b a b a b", "a b a b a b a b a b a b"]
    order = rng.permutation(len(docs))
    return [(int(i), docs[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("blocks", [(1024, 24), (16, 1)])
def test_classes_by_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_dup, "BLOCK", blocks[0])
    monkeypatch.setattr(near_dup, "SPLIT_BLOCKS", blocks[1])
    docs = planted()
    classes = brute_classes(docs)
    got = {r["id"]: r for r in near_dup.near_duplicates(clash(table(spark, docs))).collect()}
    assert {d: r["class_id"] for d, r in got.items()} == {d: c for (d, _), c in classes.items()}
    texts = {}
    for d, t in docs:
        texts.setdefault(" ".join(t.lower().split()), got[d]["class_id"])
    sizes = Counter(texts.values())
    for d, r in got.items():  # texts with another one in their class are linked, with the similarity that was verified
        assert (r["n_links"] > 0) == (sizes[r["class_id"]] > 1) == (r["similarity"] is not None)
        assert r["similarity"] is None or 0.8 - 1e-9 <= r["similarity"] < 1
    left = near_dup.first_of_each(table(spark, docs)).collect()
    assert sorted(r["doc_id"] for r in left) == sorted(set(classes.values()))


def test_a_sample_has_all_its_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    order = [r["doc_id"] for r in labels.filter(~quality_classifier.held_out("doc_id")).orderBy(F.xxhash64("doc_id")).collect()]
    for n in (1, 3, 10, len(order), 600):  # of the first three, fewer are under the first bound
        assert sorted(r["id"] for r in quality_classifier.sample(labels, n).collect()) == sorted(order[:n])


def test_a_pair_of_a_large_bucket_that_shares_no_other_band(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SPLIT_BLOCKS", 0)  # every bucket was a large one then
    cells = lambda k: bytearray(near_dup.packed_set(np.arange(k, k + 10, dtype=np.uint64), np.ones(10)))
    a, b, leader = (bytearray([k] * 16) for k in (1, 2, 3))
    members = spark.createDataFrame([(7, n, leader, 120) for n in (a, b, leader)], "bucket long, node binary, leader binary, size int")
    sketch = bytearray(2 * near_dup.COORDINATES)
    contents = spark.createDataFrame([(a, [7, 1], sketch), (b, [7, 2], sketch), (leader, [7, 3], sketch)], "node binary, keys array<long>, sketch binary")
    sets = spark.createDataFrame([(a, cells(0)), (b, cells(0)), (leader, cells(50))], "node binary, cells binary")
    labels = spark.createDataFrame([], "node binary, label binary")
    found = near_dup.crossing(members, contents, labels, sets).collect()
    assert {(bytes(r["a"]), bytes(r["b"]), r["similarity"]) for r in found} == {(bytes(a), bytes(b), 1.0)}


def test_texts_with_a_shared_id_stay(spark):
    speak = lambda k: " ".join(f"{k}{i}" for i in range(40))
    t, u, v = speak("t"), speak("u"), speak("v")
    near = t.replace("t39", "other")
    rows = [(1, t), (2, t), (2, u), (5, near), (5, near), (6, v), (6, v), (None, speak("n")), (None, None), (None, speak("n").upper()), (7, speak("p")), (7, speak("q"))]
    left = near_dup.first_of_each(clash(table(spark, rows)))
    assert left.columns == clash(table(spark, [])).columns
    got = Counter((r["doc_id"], r["text"]) for r in left.collect())
    n = {x for x in got if x[0] is None and x[1] and x[1].lower() == speak("n")}
    assert len(n) == 1 and got == Counter([(1, t), (2, u), (6, v), (None, None), (7, speak("p")), (7, speak("q")), *n])


def test_a_row_that_is_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(shared, "HEAVY_LEAST", 50)
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(3, t)] * 400 + [(None, "null id, one text over and over")] * 300 + [(i, f"{t} and more {i} {i}") for i in range(10, 20)]
    left = near_dup.first_of_each(table(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in left) == [(-1, "null id, one text over and over"), (3, t)]


def test_classes_of_odd_tables(spark):
    assert near_dup.near_duplicates(table(spark, [])).count() == 0
    got = [(r["id"], r["class_id"]) for r in near_dup.near_duplicates(table(spark, ODD)).collect()]
    assert len(got) == len(ODD) and (2, 1) in got and (5, 4) in got and (None, 1) in got
    assert near_dup.first_of_each(table(spark, [])).columns == table(spark, []).columns


def test_every_pair_of_the_similarity_is_found(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.op3_dart_minhash(spark, "/root/testdata/sf0.01").collect()}
    assert got == {d: c for (d, _), c in brute_classes(docs).items()}


@pytest.mark.parametrize("weights", ["count", "log", "set"])
def test_darts_estimate_weighted_similarity(weights):
    rng, off = np.random.default_rng(2), []
    for _ in range(60):
        base = rng.integers(0, 40, 300).astype(str)
        x, y = (near_dup.weighted_shingles([w.encode() for w in own], weights, 1) for own in (base[:250], base[60:]))
        u, v = (dict(zip(*z, strict=True)) for z in (x, y))
        exact = sum(min(u.get(k, 0), v.get(k, 0)) for k in u | v) / sum(max(u.get(k, 0), v.get(k, 0)) for k in u | v)
        assert near_dup.similarity(x, y) == pytest.approx(exact)
        assert near_dup.similarity(*(near_dup.unpacked_set(near_dup.packed_set(*z)) for z in (x, y))) == pytest.approx(exact)
        off.append((near_dup.darts(*x) == near_dup.darts(*y)).mean() - exact)
    assert abs(np.mean(off)) < 0.02


def test_darts_of_small_weights():
    x = np.arange(5).astype(np.uint64) * words.multiplier(3)
    u, v = np.array([0.01, 0.02, 0.005, 0.01, 0.03]), np.array([0.01, 0.01, 0.005, 0.02, 0.03])
    got = np.mean([(near_dup.darts(x + np.uint64(k), u) == near_dup.darts(x + np.uint64(k), v)).mean() for k in range(30)])
    assert abs(got - np.minimum(u, v).sum() / np.maximum(u, v).sum()) < 0.03


def test_repeated_words_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        w = [f"{x}".encode() for x in rng.integers(0, 3, int(rng.integers(0, 60)))]
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        assert words.repeated_words(words.hashes.of(w)) == len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)})
