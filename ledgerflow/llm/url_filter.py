"""URL filters: host and path rules, and for the rest a naive Bayes verdict over words that host names are split into."""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.shared import slices, spread, staged, texts_of

#: (verdict, host, path): a rule fits its host, all subdomains of it, and paths that start with its path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Letters of a word that a name can hold, and buckets for tokens: the model has no more numbers than these.
MOST_LETTERS, BUCKETS = 20, 1 << 18
#: Distinct words that a task counts before it hands its counts on.
MOST_WORDS = 200_000
_TAGS = re.compile(rb"<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>", re.DOTALL | re.IGNORECASE)
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: the host up to `/`, `?`, `#` or the end with A to Z in lower case, then the path up to `?`, `#` or the end. Null, or without `://`: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """word, n: the words of all pages' text outside tags, in lower case. Tasks count for themselves and hand on sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w.decode("utf-8", "replace") for w in counted]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counted.values(), pa.int64())], names=["word", "n"])
            counted.clear()
            return out

        for batch in slices(batches, "html"):
            for page in texts_of(batch, "html"):
                counted.update(w for w in _TAGS.sub(b" ", page.encode("utf-8", "surrogatepass")).translate(_LETTERS).split() if len(w) <= 4 * MOST_LETTERS)
            if len(counted) > MOST_WORDS:
                yield flush()
        yield flush()

    return pages.select(F.col(html_column).alias("html")).mapInArrow(run, "word string, n long").filter(F.char_length("word") <= MOST_LETTERS).groupBy("word").agg(F.sum("n").alias("n"))


def best_split(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The words of highest joint unigram probability that make up the name. A run of letters that is no known word is less likely the longer it is."""
    best = [(0.0, 0)] + [(math.inf, 0)] * len(name)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - MOST_LETTERS), end):
            n = counts.get(name[start:end])
            cost = math.log(total / n) if n else math.log(total) + 2.5 * (end - start) + 1
            if best[start][0] + cost < best[end][0]:
                best[end] = (best[start][0] + cost, start)
    words, end = [], len(name)
    while end:
        words.append(name[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def split_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name, words. Each name's own substrings are joined with the counts, so no word list is sent about. Rows of substrings carry a 128-bit key of the name, so
    a name of n letters takes 20 n short rows at most, and n steps of 20 to split."""
    total = max(2, counts.agg(F.sum("n")).first()[0] or 0)
    keyed = names.select("name", F.unhex(F.md5("name")).alias("name_key"))

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "name", 1 << 18):
            found = [list({name[i : i + k] for i in range(len(name)) for k in range(1, min(MOST_LETTERS, len(name) - i) + 1)}) for name in batch.column("name").to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column("name_key").take(pa.array(row)), pa.array([w for x in found for w in x], pa.string())], names=["name_key", "word"])

    spans = staged(keyed.mapInArrow(substrings, "name_key binary, word string"), "spans")
    known = spread(spans, counts, "word", "name_key").groupBy("name_key").agg(F.collect_list("word").alias("parts"), F.collect_list("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [best_split(name, dict(zip(parts or [], n or [], strict=True)), total) for name, parts, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], names=["name", "words"])

    return keyed.join(known, "name_key", "left").select("name", "parts", "n").mapInArrow(run, "name string, words array<string>")


def judged(pages: DataFrame, rules=RULES, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """id, host, path, rule, verdict, log_odds, host_words for each page.

    Rules come first. Pages that a rule fits are the examples of a multinomial naive Bayes model whose tokens are the words in the host (all labels but the
    last, split by unigram Viterbi with the counts of all pages' words) and in the path (numbers are one token); it judges the pages that no rule fits:
    allow if the log odds are 0 or more. Tokens are hashed into BUCKETS, so that the model is bounded; its counts cover all pages.

    Null and odd urls have no host, no path and no tokens: the prior decides, and without examples the verdict is allow. Null ids and repeated rows are
    judged like others; an empty table gives no rows; only the three columns named are read. A host that most pages have is split once, and joined back
    salted by the place of its rows, so that null and repeated ids are dealt out too.
    """
    host, path = host_and_path(F.col(url_column))
    seen = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = staged(seen.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("at", F.monotonically_increasing_id()), "urls")
    hosts = seen.select("host").distinct()
    labels = hosts.select("host", F.posexplode(F.expr("flatten(transform(slice(split(host, '[.]'), 1, greatest(0, size(split(host, '[.]')) - 1)), l -> split(l, '[^\\\\p{L}]+')))")).alias("pos", "name")).filter("name != ''")
    labels = staged(labels, "labels")
    parts = staged(split_names(labels.select("name").distinct(), staged(word_counts(pages, html_column), "words")), "names")
    words = spread(labels, parts, "name", "host").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("host_words"))
    by_host = hosts.join(words, "host", "left").select("host", F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words"))
    path_words = F.expr("filter(split(regexp_replace(lower(path), '[0-9]+', '/0/'), '[^\\\\p{L}0]+'), w -> w != '')")
    tokens = F.concat(F.transform("host_words", lambda w: F.concat(F.lit("h:"), w)), F.transform(path_words, lambda w: F.concat(F.lit("p:"), w)))
    full = spread(seen, by_host, "host", "at").drop("at").withColumn("tokens", F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))
    full = staged(full, "tokens")

    ruled = full.filter(F.col("ruled").isNotNull())
    sides = ruled.select("ruled", F.explode("tokens").alias("bucket")).groupBy("bucket").agg(F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block")).toPandas()
    priors = ruled.agg(F.count_if(F.col("ruled") == "allow"), F.count_if(F.col("ruled") == "block")).first()
    seen_n = np.zeros((2, BUCKETS))
    seen_n[:, sides["bucket"].to_numpy(int)] = sides[["allow", "block"]].to_numpy(float).T
    share = (seen_n + 1) / (seen_n.sum(axis=1, keepdims=True) + max(1, len(sides)))
    share[:, seen_n.sum(axis=0) == 0] = 1.0  # tokens without an example say nothing
    model = pages.sparkSession.sparkContext.broadcast((math.log((priors[0] + 1) / (priors[1] + 1)), np.log(share[0]) - np.log(share[1])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, weights = model.value
        for batch in batches:
            own = batch.column("tokens")
            n = np.asarray(pa.compute.list_value_length(own), int)
            odds = np.full(len(n), prior)
            np.add.at(odds, np.repeat(np.arange(len(n)), n), weights[np.asarray(pa.compute.list_flatten(own), int)])
            rest = pa.array(np.where(odds >= 0, "allow", "block"))
            columns = [batch.column(c) for c in ("id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*columns, pa.compute.coalesce(batch.column("ruled"), rest), pa.array(odds), batch.column("host_words")], names=["id", "host", "path", "rule", "verdict", "log_odds", "host_words"])

    kind = dict(pages.dtypes)[id_column]
    return full.mapInArrow(score, f"id {kind}, host string, path string, rule string, verdict string, log_odds double, host_words array<string>")


def op5_segmented_host_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id").drop("log_odds")
