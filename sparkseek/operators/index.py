"""Token indexes: postings built once, searched by token, with phrases, prefixes, fuzzy terms, sections, weights and scores.

Postings are rows (token, doc_id, section, position) in token order, so that a search reads the row groups of its tokens alone and
shuffles nothing but their hits, by document. What a query brings, its tokens, is literals of the plan; no join is needed to find
which word a posting stands for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import FULL_TEXT, Analyzer, EngineConf
from ..functions.tokenize import query_terms, query_tokens, tokens_column, tokens_of
from ..plans.query import Leaf, fold, leaves, parse
from ..plans.spread import spread
from .predicates import Condition


#: Tokens that a fuzzy search names in its plan at most; beyond, it compares postings.
FUZZY_TOKENS = 2000


def postings_schema(id_type: str = "bigint") -> str:
    return f"token string, doc_id {id_type}, section int, position int"


def postings_of(df: DataFrame, id_col: str | list[str], columns: list[str], analyzer: Analyzer = FULL_TEXT) -> DataFrame:
    """Postings of text columns, or of the elements of array columns; null values have none."""
    parts = []
    df = spread(df.select(*dict.fromkeys([*([id_col] if isinstance(id_col, str) else id_col), *columns])))
    for n, name in enumerate(columns):
        col = F.col(name)
        if df.schema[name].dataType.typeName() == "array":
            rows = df.select(key_column(id_col).alias("doc_id"), F.posexplode(col).alias("section", "value"))
        else:
            rows = df.select(key_column(id_col).alias("doc_id"), F.lit(n).alias("section"), col.alias("value"))
        found = rows.select("doc_id", "section", F.posexplode(tokens_column(F.col("value"), analyzer)).alias("position", "token"))
        parts.append(found.filter("token <> ''").select("token", "doc_id", "section", "position"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class TokenIndex:
    """postings: rows (token, doc_id, section, position); documents: doc_id of every indexed row; sections: how many a document has.

    doc_id is of the type of the indexed table's key, a struct if the key is of several columns.
    """

    postings: DataFrame
    documents: DataFrame
    analyzer: Analyzer = FULL_TEXT
    sections: int = 1
    columns: tuple[str, ...] = ()
    #: The distinct tokens, where a stored index keeps them; tokens may repeat.
    words: DataFrame | None = None
    #: (doc_id, texts) of the indexed rows, where the index is computed as it is searched and all its columns are texts.
    rows: DataFrame | None = None

    def lexicon(self) -> DataFrame:
        """(token, df, tf): documents that have it and how often it occurs."""
        if self.rows is not None:
            return self._lexicon_of_rows()
        each = self.postings.groupBy("token", "doc_id").agg(F.count("*").alias("tf"))
        return each.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))

    def _lexicon_of_rows(self) -> DataFrame:
        """The lexicon from whole rows: each tells its distinct tokens by itself, so that only sums by token are shuffled.

        Rows that share their doc_id are one document, and are told apart by it as far as their tokens are counted.
        """
        again = self.documents.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("shared"), F.lit(True).alias("again"))
        rows = spread(self.rows).join(again, F.expr("doc_id <=> shared"), "left")
        tokens = [F.coalesce(tokens_column(F.col(c), self.analyzer), F.array().cast("array<string>")) for c in self.rows.columns if c != "doc_id"]
        rows = rows.select(F.when(F.col("again"), F.struct("doc_id")).alias("shared"), F.concat(*tokens).alias("t"))
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        both = F.array(F.struct(none.alias("df"), one.alias("tf"), F.col("t")), F.struct(one.alias("df"), none.alias("tf"), F.array_distinct("t").alias("t")))
        each = rows.select("shared", F.explode(both).alias("x")).select("shared", "x.df", "x.tf", F.explode("x.t").alias("token")).filter("token <> ''")
        each = each.groupBy("token", "shared").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
        return each.groupBy("token").agg(F.sum(F.when(F.col("shared").isNull(), F.col("df")).otherwise(one)).alias("df"), F.sum("tf").alias("tf"))

    def _words(self, wanted: list[Leaf], fuzzy: float | None, loose: bool) -> tuple[list[tuple], list[Column]]:
        """The tokens of leaves, (leaf, place, how many the leaf has, token, whether a prefix, edits allowed), and what meets each."""
        rows, any_token = [], []
        for n, x in enumerate(wanted):
            tokens = query_terms(x.text, self.analyzer)
            for i, (k, t, gram) in enumerate(tokens):
                start = gram or (x.kind == "prefix" or loose and self.analyzer.prefix_search) and i == len(tokens) - 1
                reach = int(fuzzy * len(t)) if fuzzy else 0
                rows.append((n, k, len(tokens), t, start, reach))
                token = F.col("token")
                any_token.append(F.levenshtein(token, F.lit(t), reach) >= 0 if reach else token.startswith(t) if start else token == t)
        return rows, any_token

    def _some(self, condition: Column, fuzzy: bool) -> DataFrame:
        """Postings of the tokens that meet a condition. Edits are counted once for each token of a stored index, not for each posting."""
        if not fuzzy or self.words is None:
            return self.postings.filter(condition)
        tokens = [r.token for r in self.words.filter(condition).select("token").distinct().limit(FUZZY_TOKENS + 1).collect()]
        return self.postings.filter(condition) if len(tokens) > FUZZY_TOKENS else self.postings.filter(F.col("token").isin(tokens) if tokens else F.lit(False))

    def keyword_hits(self, wanted: list[Leaf], fuzzy: float | None = None, loose: bool = False) -> DataFrame:
        """(doc_id, section, leaf, tf, bonus) of each leaf's occurrences; rows of a document stand in one partition."""
        rows, any_token = self._words(wanted, fuzzy, loose)
        if not rows:
            return self.documents.select("doc_id", F.lit(0).alias("section"), F.lit(0).alias("leaf"), F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("bonus")).limit(0)
        some = self._some(_any(any_token), bool(fuzzy))
        if len(rows) == 1:  # one token: no positions to compare
            n, _, _, t, _, reach = rows[0]
            bonus = F.max(F.lit(reach) - F.levenshtein("token", F.lit(t), reach) + 1) if reach else F.max(F.lit(0))
            return some.groupBy("doc_id", "section").agg(F.count("*").alias("tf"), bonus.cast("long").alias("bonus")).select("doc_id", "section", F.lit(n).alias("leaf"), "tf", "bonus")
        each, nth = [], 0  # what a posting stands for: some words of the query, each at its place in its phrase
        for i, ((n, k, size, t, _, reach), meets) in enumerate(zip(rows, any_token)):
            nth = nth + 1 if i and rows[i - 1][0] == n else 0
            bonus = F.lit(reach) - F.levenshtein("token", F.lit(t), reach) + 1 if reach else F.lit(0)
            each.append(F.when(meets, F.struct(F.lit(n).alias("leaf"), F.lit(k).alias("k"), F.lit(size).alias("n"), F.lit(nth).alias("nth"), bonus.cast("long").alias("bonus"))))
        hits = some.select("doc_id", "section", "position", F.explode(F.array_compact(F.array(*each))).alias("hit")).select("doc_id", "section", "position", "hit.*")
        hits = hits.repartition("doc_id")  # the one shuffle of all groupings from here on
        # the words of a phrase as bits, which one grouping puts together
        have = F.bit_count(F.bit_or(F.expr("shiftleft(1L, nth)"))) if max(r[2] for r in rows) < 64 else F.count_distinct("nth")
        runs = hits.groupBy("doc_id", "section", "leaf", "n", (F.col("position") - F.col("k")).alias("at")).agg(have.alias("have"), F.max("bonus").alias("bonus"))
        return runs.filter("have = n").groupBy("doc_id", "section", "leaf").agg(F.count("*").alias("tf"), F.max("bonus").alias("bonus"))

    def search(self, query, conf: EngineConf = EngineConf(), loose: bool = False) -> DataFrame:
        """(doc_id, score) of the documents for which the query holds. query: text or a Condition.

        The score of a document sums, over the query's positive words and its sections, weight times scorer of the term frequency.
        Sections of weight 0 and beyond the weights given are not searched.
        """
        condition = query if isinstance(query, Condition) else Condition(query)
        tree = parse(condition.query or "", self.analyzer.query_allow_column)
        empty = self.documents.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        if condition.weights is not None and not len(condition.weights):
            raise ValueError("weights are empty")
        if tree is None:
            return empty
        if conf.force_match_escalation:
            loose = True
        wanted = leaves(tree)
        order = {x: i for i, x in enumerate(dict.fromkeys(wanted))}
        weight, keep = self._weights(condition)
        positive = [order[x] for x in dict.fromkeys(leaves(tree, positive_only=True))]
        rows, meets = self._words(list(order), condition.fuzzy_max_distance_ratio, loose)
        negative = fold(tree, lambda x: False, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)  # true of documents without any of the words
        if rows and all(r[2] == 1 for r in rows) and not any(condition.scorers or ()) and not condition.fuzzy_max_distance_ratio:
            # words alone: each posting tells all it has to tell, and sums are combined before they are shuffled
            def sums(meets: list[Column], wide: str) -> list[Column]:
                value = [F.when(c, weight).otherwise(0.0) for (leaf, *_), c in zip(rows, meets) if leaf in positive]
                score = F.sum(reduce(lambda a, b: a + b, value)) if value else F.max(F.lit(0.0))
                known = {leaf: c for (leaf, *_), c in zip(rows, meets)}
                has = [(F.max(F.when(known[i], True)) if i in known else F.max(F.lit(None).cast("boolean"))).alias(f"has{wide}{i}") for i in order.values()]
                return [score.cast("double").alias(f"score{wide}"), *has]

            if conf.escalate and not loose and not negative:
                return self._escalated(tree, order, keep, meets, self._words(list(order), None, True)[1], sums, conf.match_escalation_threshold)
            some = self.postings.filter(_any(meets) if keep is None else _any(meets) & keep)
            each = some.groupBy("doc_id").agg(*sums(meets, ""))
        else:
            hits = self.keyword_hits(list(order), condition.fuzzy_max_distance_ratio, loose)
            if keep is not None:
                hits = hits.filter(keep)
            if any("idf" in (s or "") for s in condition.scorers or ()):
                n = self.documents.count()
                rarity = hits.groupBy("leaf").agg((F.lit(1.0) + F.log(F.lit(float(max(1, n))) / F.count_distinct("doc_id"))).alias("idf"))
                hits = hits.join(F.broadcast(rarity), "leaf")  # as many rows as the query has words
            value = weight * self._scorer(condition)
            has = [F.max(F.when(F.col("leaf") == i, True)).alias(f"has{i}") for i in order.values()]
            score = F.sum(F.when(F.col("leaf").isin(positive), value).otherwise(0.0)) if positive else F.max(F.lit(0.0))
            each = hits.groupBy("doc_id").agg(score.cast("double").alias("score"), *has)
        flag = lambda x: F.coalesce(F.col(f"has{order[x]}"), F.lit(False))
        holds = fold(tree, flag, lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)
        if negative:
            each = self.documents.select("doc_id").join(each, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        found = each.filter(holds).select("doc_id", "score")
        if conf.escalate and not loose:
            wide = self.search(query, conf.with_(escalate=False), loose=True)
            few = found.limit(conf.match_escalation_threshold + 1).agg((F.count("*") <= conf.match_escalation_threshold).alias("few"))
            found = found.unionByName(wide.join(found.select("doc_id"), "doc_id", "left_anti").join(F.broadcast(few.filter("few")).select(F.lit(1).alias("one")), how="left_semi", on=F.lit(True)))
        return found

    def _escalated(self, tree, order: dict, keep: Column | None, meets: list[Column], wide: list[Column], sums, threshold: int) -> DataFrame:
        """Search by words with escalation in one pass: both rules are told of each document, and the looser one counts if few meet the other."""
        some = self.postings.filter(_any(wide) if keep is None else _any(wide) & keep)
        each = some.groupBy("doc_id").agg(*sums(meets, ""), *sums(wide, "w"))
        holds = lambda w: fold(tree, lambda x: F.coalesce(F.col(f"has{w}{order[x]}"), F.lit(False)), lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)
        each = each.select("doc_id", holds("").alias("strict"), holds("w").alias("loose"), "score", "scorew").filter("strict or loose")
        few = each.agg((F.count_if("strict") <= threshold).alias("few"))  # one row
        return each.join(F.broadcast(few), F.lit(True)).filter("strict or loose and few").select("doc_id", F.when(F.col("strict"), F.col("score")).otherwise(F.col("scorew")).alias("score"))

    def _weights(self, condition: Condition) -> tuple[Column, Column | None]:
        n = max(len(condition.weights or ()), len(condition.scorers or ()))
        if not n:
            return F.lit(1.0), None
        w = [1.0 if i >= len(condition.weights or ()) or condition.weights[i] is None else float(condition.weights[i]) for i in range(n)]
        on = [i for i in range(n) if w[i] != 0]
        return F.get(F.array(*map(F.lit, w)), F.col("section")), F.col("section").isin(on) if on else F.lit(False)

    def _scorer(self, condition: Condition) -> Column:
        tf = F.col("tf") + F.lit(0.0)
        if condition.fuzzy_max_distance_ratio:
            tf = F.when(F.col("bonus") > 0, F.col("bonus")).otherwise(tf)
        out = tf
        for i, s in reversed(list(enumerate(condition.scorers or ()))):
            if not s:
                continue
            if m := re.match(r"scorer_tf_at_most\(.*?,\s*([\d.]+)\s*\)", s):
                one = F.least(tf, F.lit(float(m[1])))
            elif s.startswith("scorer_tf_idf"):
                one = tf * F.col("idf")
            else:
                raise ValueError(f"unknown scorer: {s}")
            out = F.when(F.col("section") == i, one).otherwise(out)
        return out

    def match(self, term: str, **options) -> DataFrame:
        """(doc_id, score) where the term's tokens stand side by side."""
        return self.search_leaf(Leaf(term), **options) if term else self.search("")

    def search_leaf(self, leaf: Leaf, fuzzy: float | None = None, loose: bool = False) -> DataFrame:
        hits = self.keyword_hits([leaf], fuzzy, loose)
        tf = F.when(F.col("bonus") > 0, F.col("bonus")).otherwise(F.col("tf")) if fuzzy else F.col("tf")
        return hits.groupBy("doc_id").agg(F.sum(tf).cast("double").alias("score"))

    def similar(self, query, least: float = 0.5) -> DataFrame:
        """(doc_id, score): documents that have at least the share `least` of the text's distinct tokens; score is how many.

        query: text or a Condition, whose weights count for sections, 0 leaving one out; a token's weight is that of its best
        section. Sections are columns, or the elements of an array column.
        """
        condition = query if isinstance(query, Condition) else Condition(query)
        tokens = sorted(set(query_tokens(condition.query or "", self.analyzer)))
        if not tokens:
            return self.search("")
        weight, keep = self._weights(condition)
        some = self.postings.filter(F.col("token").isin(tokens))
        each = (some if keep is None else some.filter(keep)).groupBy("doc_id", "token").agg(F.max(weight).alias("w"))
        hits = each.groupBy("doc_id").agg(F.sum("w").alias("score"), F.count("*").alias("n"))
        return hits.filter(F.col("n") >= least * len(tokens)).select("doc_id", "score")

    def similar_distance(self, query) -> DataFrame:
        """(doc_id, distance): 1 less the share of the text's distinct tokens that a document has; nearest documents have 0."""
        condition = query if isinstance(query, Condition) else Condition(query)
        n = max(1, len(set(query_tokens(condition.query or "", self.analyzer))))
        _, keep = self._weights(condition)
        flat = Condition(condition.query, tuple(1 if w is None or w else 0 for w in condition.weights) if keep is not None and condition.weights else None)
        return self.similar(flat, 0.0).select("doc_id", (1 - F.col("score") / n).alias("distance"))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def key_column(id_col: str | list[str]) -> Column:
    """A table's key: a column, or several as a struct."""
    return F.col(id_col) if isinstance(id_col, str) else F.struct(*id_col)


def build_index(df: DataFrame, id_col: str | list[str], columns: list[str], analyzer: Analyzer = FULL_TEXT) -> TokenIndex:
    """An index over columns of df, computed as it is searched; sources.store keeps one on disk. id_col: the key, of any type."""
    rows = None
    if not any(df.schema[c].dataType.typeName() == "array" for c in columns):
        rows = df.select(key_column(id_col).alias("doc_id"), *[F.col(c).alias(f"text{n}") for n, c in enumerate(columns)])
    return TokenIndex(postings_of(df, id_col, columns, analyzer), df.select(key_column(id_col).alias("doc_id")), analyzer, len(columns), tuple(columns), rows=rows)


TOKEN_ROWS = "array<struct<value:string,position:int,source_offset:int,source_length:int>>"


def token_positions(df: DataFrame, id_col: str, column: str, analyzer: Analyzer = FULL_TEXT) -> DataFrame:
    """(doc_id, value, position, source_offset, source_length) of each token, in characters of the original text."""

    @F.pandas_udf(TOKEN_ROWS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else [{"value": x.value, "position": x.position, "source_offset": x.start, "source_length": x.end - x.start} for x in tokens_of(t, analyzer)])

    each = df.select(F.col(id_col).alias("doc_id"), F.explode(run(F.col(column))).alias("t"))
    return each.select("doc_id", "t.*")
