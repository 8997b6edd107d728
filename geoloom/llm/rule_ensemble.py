"""Quality classifier: a sparse ensemble of rules read off trees.

Statistics of each text are Spark columns. A forest of shallow trees is fitted on a bounded sample of
labelled rows; each path from a root to a node is a conjunction of bounds on statistics. A lasso
logistic regression weighs the rules and drops most of them; the rest compile into one Spark column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.shared import stage, unstage

#: Labelled rows used for fitting, at most (about; chosen by a hash of the id).
MAX_TRAINING_ROWS = 50_000
BLANKS, BLANK_CHARS = r"[\x20\x09-\x0D]+", " \t\n\x0b\f\r"
STATISTICS = ("n_words", "word_length", "symbols", "uppercase", "digits", "punctuation", "repeated_words", "repeated_lines", "words_per_line", "accents", "exclamations")


def statistics(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """``keep`` (new name: column) and ``STATISTICS`` (doubles, 0 for texts without characters) of every row."""
    rows = docs.select(*[c.alias(name) for name, c in keep.items()], F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.select(*keep, "_t", F.length("_t").alias("_c"), F.split(F.btrim("_t", F.lit(BLANK_CHARS)), BLANKS).alias("_w"), F.split("_t", "\n").alias("_l"))
    share = lambda pattern: F.regexp_count("_t", F.lit(pattern)) / F.greatest("_c", F.lit(1))
    n = F.size("_w")
    values = {
        "n_words": F.when(F.col("_w")[0] == "", 0).otherwise(n),
        "word_length": F.col("_c") / n,
        "symbols": share("[#*$%&|<>]"),
        "uppercase": share("[A-Z]"),
        "digits": share("[0-9]"),
        "punctuation": share("[.,;:!?]"),
        "repeated_words": 1 - F.size(F.array_distinct("_w")) / n,
        "repeated_lines": 1 - F.size(F.array_distinct("_l")) / F.size("_l"),
        "words_per_line": n / F.size("_l"),
        "accents": (F.octet_length("_t") - F.col("_c")) / F.greatest("_c", F.lit(1)),
        "exclamations": share("!"),
    }
    return rows.select(*keep, *[values[name].cast("double").alias(name) for name in STATISTICS])


@dataclass(frozen=True)
class RuleEnsemble:
    """rules: for each, its weight and its (statistic, above, bound) conditions, all of which hold."""

    intercept: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def score(self) -> Column:
        """Probability of label 1, from columns named like the statistics."""
        terms = [F.when(condition(c), F.lit(w)).otherwise(F.lit(0.0)) for w, c in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))


def condition(rule: tuple[tuple[str, bool, float], ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(name) > bound if above else F.col(name) <= bound for name, above, bound in rule])


def paths(node, conditions: tuple = ()) -> Iterator[tuple[tuple[str, bool, float], ...]]:
    """Conjunctions that lead to the nodes of a fitted tree, the root left out."""
    if conditions:
        tightest: dict[tuple[str, bool], float] = {}
        for name, above, bound in conditions:
            at = tightest.get((name, above), bound)
            tightest[name, above] = max(at, bound) if above else min(at, bound)
        yield tuple(sorted((name, above, bound) for (name, above), bound in tightest.items()))
    if node.subtreeDepth() > 0:
        split = node.split()
        name, bound = STATISTICS[split.featureIndex()], float(split.threshold())
        yield from paths(node.leftChild(), (*conditions, (name, False, bound)))
        yield from paths(node.rightChild(), (*conditions, (name, True, bound)))


def fit(rows: DataFrame, label: str, trees: int = 12, depth: int = 3, lasso: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """Fit on rows with the statistics and a 0/1 label. With one label or no rows, a constant score."""
    rows = rows.select(*STATISTICS, F.col(label).cast("double").alias("_y")).filter("_y in (0, 1)")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0.0))).first()
    if ones in (0, n):
        return RuleEnsemble(0.0 if not n else 10.0 if ones else -10.0, ())
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="_x").transform(rows)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(vectors)
    rules = sorted({r for tree in forest.trees for r in paths(tree._call_java("rootNode"))})
    names = [f"_r{k}" for k in range(len(rules))]
    held = rows.select("_y", *[condition(r).cast("double").alias(n) for n, r in zip(names, rules, strict=True)])
    held = VectorAssembler(inputCols=names, outputCol="_x").transform(held).select("_y", "_x")
    weighed = LogisticRegression(featuresCol="_x", labelCol="_y", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(held)
    return RuleEnsemble(float(weighed.intercept), tuple((float(w), r) for w, r in zip(weighed.coefficients, rules, strict=True) if w))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def train(known: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id") -> RuleEnsemble:
    """Fit on the statistics ``known`` (with doc_id) of labelled rows that aren't held out.

    All of them up to ``max_rows``, beyond that about ``max_rows`` chosen by a hash of the id. Labels
    other than 0 and 1 and null ids are left out; repeated ids meet each of their labels.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("_label")).filter("_label in (0, 1)").filter(~held_out("doc_id"))
    rows, n = known.join(marks, "doc_id"), marks.count()
    if n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    # one order, so that the forest's draws, and the scores, don't depend on the cluster; the sample is bounded
    ordered = rows.select("doc_id", *STATISTICS, "_label").repartition(1).sortWithinPartitions("doc_id", "_label", *STATISTICS)
    return fit(stage(ordered, "training"), "_label")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Inputs of a score are the statistics only. Null and empty texts have statistics of 0 and a score.
    Rows with null ids are scored and never learnt from. Other columns are ignored. Statistics are
    computed once and stored, then read by training and scoring.
    """
    known = stage(statistics(docs, {"doc_id": F.col(id_col)}, text_col), "statistics")
    model = train(known, labels, label, max_rows, id_col)
    scored = known.select("doc_id", held_out("doc_id").alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``classify`` predicts as 1, with all their columns, whatever their names, and without a shuffle of texts.

    Null and empty texts are scored like others, repeated rows each; an empty table gives an empty one.
    """
    known = stage(statistics(docs, {"doc_id": F.col(id_col)}, text_col), "statistics")
    model = train(known, labels, label, max_rows, id_col)
    unstage(known)
    # a column that isn't deterministic keeps the filter above the statistics, so that each is computed once and not in every rule
    rows = statistics(docs, {"_row": F.struct("*")}, text_col).withColumn("_once", F.monotonically_increasing_id())
    return rows.filter((model.score() >= threshold) & (F.col("_once") >= 0)).select("_row.*")
