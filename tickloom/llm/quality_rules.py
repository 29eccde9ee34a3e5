"""Quality rules as a learned decision list: ordered threshold conjunctions by sequential covering.

Statistics of every whole text come from one pass; the list is learned from labelled
statistics and applied as one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tickloom.llm.common import as_bytes, chunked, map_batches
from tickloom.llm.words import mix, windows, words_of

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The measures that rules test, by name; each is an expression of the counts.
MEASURES: dict[str, str] = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "coalesce(try_divide(word_chars, n_words), 0D)",
    "symbols_per_word": "coalesce(try_divide(n_symbols, n_words), 0D)",
    "dup_lines_per_word": "coalesce(try_divide(n_dup_lines, n_words), 0D)",
    "repeat_share": "coalesce(try_divide(n_repeat_words, n_words), 0D)",
}
#: Labelled rows that the list is learned from, about, where there are more: those whose id's hash lies under the cut that leaves so many.
LABELLED_ROWS = 60_000


def text_counts(texts: list[bytes]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text.

    Words are runs outside [\\x20\\x09-\\x0D]; word_chars are their code points; a
    duplicate line holds a word and equals an earlier line of its text; repeated words
    lie in a window of three words that the text holds twice or more.
    """
    n = len(texts)
    w = words_of(texts, lower=False)
    whole = np.concatenate((w.begins, [len(w.joined)]))
    letters = np.concatenate(([0], np.cumsum((w.joined & 0xC0) != 0x80)))
    chars = np.bincount(w.doc, letters[w.end] - letters[w.start], n).astype(np.int64)
    marks = np.concatenate(([0], np.cumsum(SYMBOLS[w.joined])))
    symbols = marks[whole[1:]] - marks[whole[:-1]]
    lines = np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        if b"\n" in text:
            held = [x for x in text.split(b"\n") if x and not x.isspace()]
            lines[i] = len(held) - len(set(held))
    triples, at = windows(w, 3)
    again = np.zeros(len(w.hash), bool)
    if len(at):
        key = mix(triples ^ mix(w.doc[at].astype(np.uint64) + np.uint64(1)))
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[times[inverse] > 1]
        for j in range(3):
            again[twice + j] = True
    repeats = np.bincount(w.doc[again], minlength=n)
    return [w.count, chars, symbols, lines, repeats]


def _counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs (text, ...) under the names c0, c1, ..., which no count has, and the counts of each row's whole text."""
    kept = docs.select(*keep, *([] if "text" in keep else ["text"]))
    at = kept.columns.index("text")
    schema = StructType([*(StructField(f"c{i}", f.dataType) for i, f in enumerate(kept.schema.fields[: len(keep)])), *(StructField(c, LongType()) for c in COUNTS)])

    def make() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            for begin, some in chunked(as_bytes(batch.column(at))):
                sums = [pa.array(x, pa.int64()) for x in text_counts(some)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begin, len(some)) for i in range(len(keep))), *sums], schema.names)

        return each

    return map_batches(kept.toDF(*(f"c{i}" for i in range(len(kept.columns)))), make, schema)


def with_counts(docs: DataFrame, keep: list[str], into: str = "counts") -> DataFrame:
    """The columns `keep` of docs (text, ...) and, in one column `into`, the counts of each row's whole text; a null text has no words."""
    found = _counted(docs, keep)
    return found.select(*found.columns[: len(keep)], F.struct(*COUNTS)).toDF(*keep, into)


@dataclass
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        v = values[self.measure]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = F.expr(MEASURES[self.measure])
        return v >= F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)


@dataclass
class Rule:
    """Rejects what meets all conditions; precision is over the rows that the rule was pruned on."""

    conditions: list[Condition] = field(default_factory=list)
    rejects: bool = True
    precision: float = 0.0
    covered: int = 0

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(values.values()))), bool)
        for c in self.conditions:
            out &= c.holds(values)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, steps: int, most: int) -> Rule:
    """Adds the condition of the greatest information gain until the rule covers bad rows only."""
    rule, inside = Rule(), np.ones(len(bad), bool)
    for _ in range(most):
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for name, v in values.items():
            cuts = np.unique(np.quantile(v[inside], np.linspace(0, 1, steps + 1)))
            mids = np.unique(np.concatenate(((cuts[1:] + cuts[:-1]) / 2, cuts)))
            for above in (True, False):
                for cut in mids:
                    held = inside & (v >= cut if above else v <= cut)
                    p, n = int((held & bad).sum()), int((held & ~bad).sum())
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(name, above, float(cut)), g
        if best is None:
            break
        rule.conditions.append(best)
        inside &= best.holds(values)
    return rule


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drops final conditions while (bad - good) / covered on held-back rows does not fall."""

    def worth(conditions: list[Condition]) -> tuple[float, int, float]:
        held = Rule(conditions).holds(values)
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        return ((p - n) / (p + n) if p + n else -1.0), p + n, (p / (p + n) if p + n else 0.0)

    best = rule.conditions
    for k in range(len(rule.conditions) - 1, 0, -1):
        if worth(rule.conditions[:k])[0] >= worth(best)[0]:
            best = rule.conditions[:k]
    _, covered, precision = worth(best)
    return Rule(best, True, precision, covered)


def learn_rules(values: dict[str, np.ndarray], good: np.ndarray, keys: np.ndarray, precision: float = 0.9, most_rules: int = 12, most_conditions: int = 3, steps: int = 24) -> list[Rule]:
    """An ordered list of rejecting rules from labelled rows; no rule if none is precise enough.

    Two thirds of the rows (by key) grow a rule and the rest prunes it. Rules are added
    until one is less precise than `precision` on the pruning rows or covers fewer than
    three of them. Rows of the same key fall together, so the result does not depend on
    their order.
    """
    order = np.argsort(keys, kind="stable")
    values, bad, keys = {k: v[order] for k, v in values.items()}, ~good[order].astype(bool), keys[order]
    left, grow = np.ones(len(bad), bool), keys % 3 != 0
    rules: list[Rule] = []
    while len(rules) < most_rules:
        g, p = left & grow, left & ~grow
        if not (g & bad).any() or not p.any():
            break
        rule = _grow({k: v[g] for k, v in values.items()}, bad[g], steps, most_conditions)
        if not rule.conditions:
            break
        rule = _prune(rule, {k: v[p] for k, v in values.items()}, bad[p])
        if rule.precision < precision or rule.covered < 3:
            break
        rules.append(rule)
        left &= ~rule.holds(values)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that holds decides, else the row is kept."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), not rule.rejects) if out is None else out.when(rule.column(), not rule.rejects)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Measures, labels and keys of documents of about `rows` labelled ids at most, for the driver.

    A null label or id does not count; of repeated labels the least counts, and of rows
    that repeat an id the one of the least measures. The ids drawn are so few that they
    can be broadcast, so no text moves.
    """
    own = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("key", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    cut = int((1 << 40) * min(1.0, rows / max(1, own.count())))
    drawn = docs.select("doc_id", "text").join(F.broadcast(own.where(F.col("key") < cut)), "doc_id")
    measured = with_counts(drawn, ["doc_id", "quality", "key"]).select("quality", "key", "counts.*")
    got = measured.groupBy("key", "quality").agg(F.min(F.struct(*(F.expr(x).alias(m) for m, x in MEASURES.items()))).alias("m")).select("key", "quality", "m.*").toPandas().sort_values("key", kind="stable")
    return {m: got[m].to_numpy(float) for m in MEASURES}, got["quality"].to_numpy() > 0, got["key"].to_numpy(np.int64)


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], rows: int = LABELLED_ROWS, into: str = "judged") -> DataFrame:
    """The columns `keep` of docs (doc_id, text, ...) and, in one column `into`, its counts, base_failed and kept.

    The list is learned from labels (doc_id, quality). A null or empty text has no words
    and fails the base rule. Without labels the list is empty and the base rule alone
    decides. Rows of equal doc_id, and repeated rows, are judged each by its own text;
    `into` must be another name than those of `keep`, which are free. An empty table
    gives no rows.
    """
    rules = learn_rules(*labelled_rows(docs, labels, rows))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    found = _counted(docs, keep)
    result = F.struct(*COUNTS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
    return found.select(*found.columns[: len(keep)], result).toDF(*keep, into)
