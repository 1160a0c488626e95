"""Quality rules learned as a decision list.

Statistics of whole texts are counted in Arrow batches. From labelled documents,
sequential covering learns what to reject: it grows a conjunction of thresholds by FOIL
gain on two thirds of the labelled rows, prunes its last conditions on the other third,
keeps it if it is precise enough there, removes what it covers and goes on. The list
becomes one ordered Spark ``when`` chain; documents that no rule covers are kept.

At most ``bound`` labelled rows are used for fitting (a hash of the id picks them);
statistics, rules and verdicts cover all documents.

Defined cases: a null text has no words, so it fails the base rules; labels that are
null, or whose document is missing, do not count; a document counts once for each
verdict it is labelled with, and of several texts of one id the one of least hash counts;
of conditions of equal gain the first by feature and threshold is taken; texts of any
length are counted whole; with no labels or a single class the list is empty; an empty
table gives an empty result; other columns, whatever their names, are carried through
untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.llm.common import free_name, hashed_sample, in_slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in (*COUNTS, "n_lines")])
_BLANKS = b" \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code = ids[:n]
    for k in range(1, width):  # numbers of the windows of k + 1 words, exact at every step
        code = code * len(number) + ids[k : k + n]
        if k < width - 1 and int(code.max()) >= (1 << 62) // len(number):
            code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[width : width + n] -= twice
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def _text_statistics(text: pa.Array) -> pa.Array:
    """The counts of each whole text."""
    rows = []
    chars = pc.fill_null(pc.utf8_length(text.cast(pa.large_string())), 0).to_pylist()
    for value, n_chars in zip(text.cast(pa.large_binary()), chars, strict=True):
        raw = value.as_py() or b""
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x.strip()]
        rows.append((
            len(words), n_chars - len(raw) + len(raw.translate(None, _BLANKS)), len(raw) - len(raw.translate(None, b"#*$%&|<>")),
            len(lines) - len(set(lines)), repeated_words(words), len(lines),
        ))
    columns = zip(*rows, strict=True) if rows else [[]] * len(_TYPE)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], _TYPE.names)


text_statistics = F.arrow_udf(in_slices(_text_statistics), _TYPE)

#: What rules may ask: shares and means, so that the length of a text is no proxy.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "words": ("n_words", None),
}


def feature(name: str, stats: Column) -> Column:
    """Value of a feature from the struct of counts."""
    over, under = FEATURES[name]
    top = stats[over].cast("double")
    return top if under is None else top / F.greatest(stats[under], F.lit(1)).cast("double")


def base_failed(stats: Column) -> Column:
    """Too short, or more than a fifth of the words in repeated windows."""
    return (stats["n_words"] < 10) | (stats["n_repeat_words"] * 100 > stats["n_words"] * 20)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, list(FEATURES).index(self.feature)]
        return column > self.threshold if self.above else column <= self.threshold

    def column(self, stats: Column) -> Column:
        value = feature(self.feature, stats)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float

    def covers(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x) for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> list[Condition]:
    """Conditions in order of gain, until only bad rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and (bad & inside).any() and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), inside.sum()
        best, best_gain = None, 1e-9
        for k, name in enumerate(FEATURES):
            order = np.argsort(x[inside, k], kind="stable")
            v, b = x[inside, k][order], bad[inside][order]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            low_p, low_n = np.cumsum(b)[cuts], cuts + 1
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                with np.errstate(divide="ignore"):
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - np.log2(p0 / n0)), 0.0)
                at = int(np.argmax(gain))
                if gain[at] > best_gain:
                    best_gain = float(gain[at])
                    best = Condition(name, above, float((v[cuts[at]] + v[cuts[at] + 1]) / 2))
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, max_rules: int = 8, max_conditions: int = 4, precision: float = 0.9, support: int = 3) -> list[Rule]:
    """The ordered rules that reject, from feature rows and their verdicts."""
    third = np.arange(len(x)) % 3 == 2
    gx, gb, px, pb = x[~third], bad[~third], x[third], bad[third]
    rules: list[Rule] = []

    def worth(conditions: list[Condition]) -> float:
        inside = Rule(tuple(conditions), 0).covers(px)
        return (pb[inside].sum() - (~pb[inside]).sum()) / max(1, inside.sum())

    while len(rules) < max_rules and gb.sum() >= support:
        conditions = _grow(gx, gb, max_conditions)
        if not conditions:
            break
        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions = conditions[:-1]
        rule = Rule(tuple(conditions), 0)
        on_grow, on_prune = rule.covers(gx), rule.covers(px)
        hits = gb[on_grow].sum() + pb[on_prune].sum()
        score = float(hits / max(1, on_grow.sum() + on_prune.sum()))
        held_out = pb[on_prune].mean() if on_prune.any() else score
        if hits < support or score < precision or held_out < precision:
            break
        rules.append(Rule(tuple(conditions), score))
        gx, gb, px, pb = gx[~on_grow], gb[~on_grow], px[~on_prune], pb[~on_prune]
    return rules


def fit(docs: DataFrame, labels: DataFrame, bound: int = 20_000) -> list[Rule]:
    """Rules from at most ``bound`` labelled documents (labels: doc_id, quality 0 or 1).

    Only those documents' statistics reach the driver: ``bound`` rows of a few numbers.
    """
    chosen = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("labelled"), "quality")
    chosen = hashed_sample(chosen.withColumn("h", F.xxhash64("labelled")), "h", bound, labels.count()).drop("h")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    # of repeated rows of an id one counts, so no more than ``bound`` rows leave
    stats = found.select("doc_id", "quality", F.xxhash64("text").alias("h"), text_statistics("text").alias("s")).groupBy("doc_id", "quality").agg(F.min_by("s", "h").alias("s"))
    usable = stats.where(~base_failed(F.col("s")))
    rows = usable.select("doc_id", "quality", *(feature(f, F.col("s")).alias(f) for f in FEATURES)).toPandas()
    if rows.empty or rows["quality"].nunique() < 2:
        return []
    rows = rows.sort_values(["doc_id", "quality"], kind="stable")
    rows = rows.iloc[np.random.default_rng(1).permutation(len(rows))]
    return learn(rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy() == 0)


def verdict(rules: list[Rule], stats: Column) -> Column:
    """True where no rule of the ordered list covers the document."""
    chain = None
    for rule in rules:
        test = rule.conditions[0].column(stats)
        for condition in rule.conditions[1:]:
            test = test & condition.column(stats)
        chain = F.when(test, F.lit(False)) if chain is None else chain.when(test, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, bound: int = 20_000) -> tuple[DataFrame, str, str, str]:
    """``docs`` with its counts, the base verdict and the final one.

    Returns the frame and the three column names, chosen not to clash with its own.
    """
    rules = fit(docs, labels, bound)
    stats, failed, kept = (free_name(docs, x) for x in ("stats", "base_failed", "kept"))
    out = docs.withColumn(stats, text_statistics("text"))
    out = out.withColumn(failed, base_failed(F.col(stats)))
    return out.withColumn(kept, ~F.col(failed) & verdict(rules, F.col(stats))), stats, failed, kept
