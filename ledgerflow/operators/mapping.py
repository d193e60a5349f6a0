"""Row labels to standard concepts: a best-match join with a rule table that is a few hundred rows by definition."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.functions.fixed_values import CONCEPTS, FUND_RESULT, FUND_RESULT_PATTERN, FUND_RESULT_STATEMENTS
from ledgerflow.functions.lines import clean
from ledgerflow.functions.text import concept_label

#: What a match counts, and what a rule with a context adds; beyond LEAST a label is mapped.
EXACT, SUBSET, SUBSTRING, CONTEXT_BONUS, LEAST, FUZZY_RATIO, FUZZY_SCALE, FUZZY_TOP = 1.0, 0.90, 0.86, 0.03, 0.70, 0.90, 0.82, 0.79


def label_key(text: str) -> str:
    plain = re.sub(r"[^a-z0-9%/()'& -]+", " ", clean(text).lower().replace("’", "'"))
    return clean(plain)


def internal_id(statement_type: str, name: str) -> str:
    return "corporate_net_income" if name == "Net Income (Loss)" else f"{statement_type}:" + re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


class Mapping(NamedTuple):
    standard_item: str
    category: str
    subcategory: str
    confidence: float
    rule: str
    internal_id: str
    analytical_family: str
    relationship: str


class Alias(NamedTuple):
    statement_type: str
    rule_ord: int
    alias_ord: int
    alias: str
    standard_item: str
    category: str
    subcategory: str
    contexts: list[str]
    exact_only: bool
    internal_id: str
    analytical_family: str


def aliases() -> list[Alias]:
    return [
        Alias(kind, i, j, label_key(a), c.name, c.category, c.subcategory, list(c.contexts), c.exact, internal_id(kind, c.name), "period_result" if c.name == "Net Income (Loss)" else c.category)
        for kind, concepts in CONCEPTS.items()
        for i, c in enumerate(concepts)
        for j, a in enumerate(c.aliases)
    ]


_FUND_RESULT = re.compile(FUND_RESULT_PATTERN)
ALIAS_SCHEMA = "statement_type string, rule_ord int, alias_ord int, alias string, standard_item string, category string, subcategory string, contexts array<string>, exact_only boolean, internal_id string, analytical_family string"
#: Letters of a place in an alias by which labels that contain it are found, and of the grams by which almost equal ones are.
ANCHOR, GRAM = 3, 2


def grams(text: str, n: int = GRAM) -> Counter:
    return Counter(text[i : i + n] for i in range(len(text) - n + 1))


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


class LabelIndex:
    """Aliases by what a label must share with them: all of it, its rarest word, its first letters, or enough of its grams. A label meets those aliases alone."""

    def __init__(self, rules: list[Alias]) -> None:
        self.rules = [r for r in rules if r.alias]
        loose = [(i, r.alias) for i, r in enumerate(self.rules) if not r.exact_only]
        use = Counter(w for _, alias in loose for w in set(alias.split()))
        self.exact, self.by_word, self.by_anchor, self.by_gram = (defaultdict(list) for _ in range(4))
        for i, r in enumerate(self.rules):
            self.exact[r.alias].append(i)
        for i, alias in loose:
            self.by_word[min(alias.split(), key=lambda w: (use[w], w))].append(i)
            self.by_anchor[alias[:ANCHOR]].append(i)
            for gram, n in grams(alias).items():
                self.by_gram[gram].append((i, n))

    def contained(self, key: str) -> dict[int, tuple[float, str]]:
        """Aliases that are the label, that have no other words, or that stand in it: place, score, rule."""
        words = set(key.split())
        pieces = {key[i : i + n] for n in range(1, ANCHOR + 1) for i in range(len(key) - n + 1)}
        found = {i: (SUBSTRING, "substring_context") for p in pieces & self.by_anchor.keys() for i in self.by_anchor[p] if self.rules[i].alias in key}
        found |= {i: (SUBSET, "token_subset_context") for w in words & self.by_word.keys() for i in self.by_word[w] if words.issuperset(self.rules[i].alias.split())}
        return found | {i: (EXACT, "exact_alias") for i in self.exact.get(key, ())}

    def alike(self, key: str) -> dict[int, tuple[float, str]]:
        """Aliases of almost the same letters. With a ratio r over s letters together, r * s / 2 letters are matched, and each of the others parts the matched
        ones once at most: so many grams are shared at least. Lengths tell the rest."""
        shared: Counter = Counter()
        for gram, n in grams(key).items():
            for i, m in self.by_gram.get(gram, ()):
                shared[i] += min(n, m)
        found = {}
        for i, n in shared.items():
            alias = self.rules[i].alias
            size = len(key) + len(alias)
            matched = FUZZY_RATIO * size / 2
            if min(len(key), len(alias)) >= matched and n >= matched - (size - 2 * matched) - 1 and (r := ratio(key, alias)) >= FUZZY_RATIO:
                found[i] = (min(FUZZY_TOP, r * FUZZY_SCALE), "fuzzy")
        return found

    def best(self, key: str, context: str) -> tuple[Alias, float, str] | None:
        """The alias of the highest score, the first of equals; what is contained in a label scores more than what is like it."""
        where = context.upper().strip()
        for candidates in (self.contained, self.alike):
            fits = [(min(1.0, score + CONTEXT_BONUS) if self.rules[i].contexts else score, -i, how) for i, (score, how) in candidates(key).items() if not self.rules[i].contexts or any(c in where for c in self.rules[i].contexts)]
            if fits:
                score, at, how = max(fits)
                return (self.rules[-at], score, how) if score >= LEAST else None
        return None


@lru_cache(None)
def _index(statement_type: str) -> LabelIndex:
    return LabelIndex([a for a in aliases() if a.statement_type == statement_type])


@lru_cache(50_000)
def map_label(statement_type: str, label: str, context: str = "") -> Mapping:
    """One label's concept, for rows whose context an earlier row's concept decides; map_concepts() is for all others."""
    key = label_key(label)
    if key and statement_type in FUND_RESULT_STATEMENTS and _FUND_RESULT.fullmatch(key):
        name, category, sub, own, family = FUND_RESULT
        return Mapping(name, category, sub, 1.0, "exact_alias", own, family, "exact_concept")
    best = _index(statement_type).best(key, context) if key else None
    if best is None:
        return Mapping(label, "", "", 0.0, "unmapped", "", "", "unmapped")
    a, score, how = best
    return Mapping(a.standard_item, a.category, a.subcategory, round(score, 3), how, a.internal_id, a.analytical_family, "exact_concept" if how == "exact_alias" else "related")


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(aliases(), ALIAS_SCHEMA)


def _context_fits(contexts: Column, context: Column) -> Column:
    return (F.size(contexts) == 0) | F.exists(contexts, lambda c: F.upper(F.trim(F.coalesce(context, F.lit("")))).contains(c))


def best_match(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """labels(statement_type, key, context) with the best exact, subset or substring rule, or null.

    Rules are a dimension: they are broadcast, and the comparison is a filter on the equi-join by statement type. One aggregate keeps the highest score, and
    of equals the first rule and alias.
    """
    score = F.when(F.col("key") == F.col("alias"), EXACT).when(~F.col("exact_only") & (F.size(F.array_except(F.split("alias", " "), F.split("key", " "))) == 0), SUBSET).when(~F.col("exact_only") & F.col("key").contains(F.col("alias")), SUBSTRING)
    how = F.when(F.col("key") == F.col("alias"), "exact_alias").when(F.size(F.array_except(F.split("alias", " "), F.split("key", " "))) == 0, "token_subset_context").otherwise("substring_context")
    pairs = labels.join(F.broadcast(rules), "statement_type").filter(_context_fits(F.col("contexts"), F.col("context"))).withColumn("score", score).withColumn("rule", how).filter("score IS NOT NULL")
    pairs = pairs.withColumn("score", F.when(F.size("contexts") > 0, F.least(F.lit(1.0), F.col("score") + CONTEXT_BONUS)).otherwise(F.col("score")))
    best = F.max_by(F.struct("standard_item", "category", "subcategory", F.round("score", 3).alias("confidence"), "rule", "internal_id", "analytical_family"), F.struct("score", -F.col("rule_ord"), -F.col("alias_ord")))
    return pairs.groupBy("statement_type", "key", "context").agg(best.alias("best"))


MAPPING = "standard_item string, category string, subcategory string, confidence double, rule string, internal_id string, analytical_family string, relationship string"


def _map_labels(kind: pd.Series, label: pd.Series, context: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([map_label(k or "", x or "", c or "") for k, x, c in zip(kind, label, context, strict=True)], columns=Mapping._fields)


def map_concepts(rows: DataFrame, label: str = "raw_item") -> DataFrame:
    """rows(statement_type, label, context) with the columns of Mapping.

    Distinct labels are matched and joined back. Exact, subset and substring matches never leave the JVM; only labels without one, which a fuzzy match
    may still save, and fund results go through Python.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", concept_label(F.col(label))).withColumn("_context", F.coalesce(F.col("context"), F.lit("")))
    distinct = keyed.select("statement_type", F.col("_key").alias("key"), F.col("_context").alias("context")).filter("key != ''").distinct()
    special = F.col("key").rlike(f"^(?:{FUND_RESULT_PATTERN})$") & F.col("statement_type").isin(*FUND_RESULT_STATEMENTS)
    matched = distinct.join(best_match(distinct.filter(~special), rule_table(spark)), ["statement_type", "key", "context"], "left")
    direct = matched.filter("best IS NOT NULL").select("statement_type", "key", "context", F.struct("best.*", F.when(F.col("best.rule") == "exact_alias", "exact_concept").otherwise("related").alias("relationship")).alias("m"))
    other = matched.filter("best IS NULL").select("statement_type", "key", "context", F.pandas_udf(_map_labels, MAPPING)("statement_type", "key", "context").alias("m"))
    found = direct.unionByName(other).withColumnsRenamed({"key": "_key", "context": "_context"})
    out = keyed.join(found, ["statement_type", "_key", "_context"], "left")
    mapped = F.coalesce(F.col("m.rule") != "unmapped", F.lit(False))
    fill = {"standard_item": F.when(mapped, F.col("m.standard_item")).otherwise(F.coalesce(F.col(label), F.lit(""))), "confidence": F.coalesce("m.confidence", F.lit(0.0)), "rule": F.coalesce("m.rule", F.lit("unmapped")), "relationship": F.coalesce("m.relationship", F.lit("unmapped"))}
    fill |= {c: F.coalesce(f"m.{c}", F.lit("")) for c in ("category", "subcategory", "internal_id", "analytical_family")}
    return out.withColumns(fill).drop("m", "_key", "_context")


def best_of(rows: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """The first row of each partition: arg-max with explicit ties."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter("_n = 1").drop("_n")
