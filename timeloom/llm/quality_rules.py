"""Quality rules: statistics of whole texts, and decision lists learned from labelled ones.

Sequential covering grows conjunctions of thresholds on a part of a labelled sample by information gain, prunes each on the
rest, and keeps those that are right often enough there. The ordered list becomes one Spark conditional expression.

Defined cases: a null text has no words and fails the base rules, as an empty one does. Repeated rows are judged each. Without
labels of both kinds the list is empty and keeps everything that passes the base rules. Text statistics need memory in
proportion to the longest text only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, append_columns, bounded_share, count_in, mix, one_text_each, words

#: Labelled rows that the list is fitted on at most, on average over hash samples.
SAMPLE_ROWS = 20_000
WINDOW = 8
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?|")] = True
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_upper bigint, n_digits bigint, n_marks bigint, n_repeated_next bigint, n_distinct_words bigint"


def block_stats(offsets: np.ndarray, data: np.ndarray) -> list[pa.Array]:
    """The columns of STATS for the texts of a block."""
    n, rolling = len(offsets) - 1, Rolling()
    starts, ends, owner = words(data, offsets)
    n_words = np.bincount(owner, minlength=n)
    solid = np.ones(len(data), bool)
    solid[data == 0x20] = False
    solid[(data >= 0x09) & (data <= 0x0D)] = False
    word_chars = count_in(solid & ((data & 0xC0) != 0x80), offsets)
    prefix = rolling.prefix(data)

    # lines with a word, and those equal to an earlier one of the same text
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))[: len(begin)]
    end = end - (data[end - 1] == 0x0A) if len(end) else end
    full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[full], end[full]
    line_owner = np.searchsorted(offsets, begin, "right") - 1
    n_lines = np.bincount(line_owner, minlength=n)
    keys = mix(rolling.slices(prefix, begin, end) + line_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    n_dup_lines = n_lines - np.bincount(line_owner[np.unique(keys, return_index=True)[1]], minlength=n)

    # words in windows that the same text holds twice or more
    hashes = rolling.slices(prefix, starts, ends)
    n_repeat = np.zeros(n, np.int64)
    if len(hashes) > WINDOW:
        up, down = rolling.powers(len(hashes) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1])))
        at = np.flatnonzero(owner[: 1 - WINDOW] == owner[WINDOW - 1 :])
        keys = mix((sums[at + WINDOW] - sums[at]) * down[at] + owner[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = at[np.unique(np.concatenate((order[1:][same], order[:-1][same])))]
        change = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(change, twice, 1)
        np.add.at(change, twice + WINDOW, -1)
        n_repeat = np.bincount(owner[np.cumsum(change[:-1]) > 0], minlength=n)
    next_same = np.zeros(len(hashes), bool)
    next_same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    keys = mix(hashes + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    distinct = np.bincount(owner[np.unique(keys, return_index=True)[1]], minlength=n)
    out = [n_words, word_chars, count_in(_SYMBOLS[data], offsets), n_dup_lines, n_repeat, n_lines, count_in(_UPPER[data], offsets), count_in(_DIGIT[data], offsets), count_in(_MARKS[data], offsets), np.bincount(owner[next_same], minlength=n), distinct]
    return [pa.array(np.asarray(x, np.int64)) for x in out]


def text_stats(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and those of STATS, of every whole text."""
    return append_columns(df, text_col, keep, STATS, block_stats)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Numbers that conditions compare, from the columns of STATS."""
    of = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")
    return {
        "symbols_per_word": of("n_symbols", "n_words"),
        "chars_per_word": of("word_chars", "n_words"),
        "dup_line_share": of("n_dup_lines", "n_lines"),
        "repeat_share": of("n_repeat_words", "n_words"),
        "upper_share": of("n_upper", "word_chars"),
        "digit_share": of("n_digits", "word_chars"),
        "marks_per_word": of("n_marks", "n_words"),
        "repeated_next_share": of("n_repeated_next", "n_words"),
        "distinct_share": of("n_distinct_words", "n_words"),
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x >= self.threshold if self.at_least else x < self.threshold

    def column(self) -> Column:
        x = features()[self.feature]
        return x >= F.lit(self.threshold) if self.at_least else x < F.lit(self.threshold)


@dataclass
class DecisionList:
    """Ordered conjunctions, each of which rejects; what none of them catches is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self) -> Column:
        """The number of the first rule that fires, from 1, or 0: an ordered conditional expression."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            every = rule[0].column()
            for c in rule[1:]:
                every = every & c.column()
            out = F.when(every, i) if out is None else out.when(every, i)
        return F.lit(0) if out is None else out.otherwise(0)


def _information_gain(good: np.ndarray, bad: np.ndarray, p0: int, n0: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = bad * (np.log2(bad / (bad + good)) - np.log2(p0 / (p0 + n0)))
    return np.where(bad > 0, gain, -np.inf)


def grow(values: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> list[Condition]:
    """Add the condition of highest information gain until only bad rows are covered."""
    rule: list[Condition] = []
    covered = np.ones(len(bad), bool)
    while len(rule) < most and (~bad[covered]).any():
        p0, n0 = int(bad[covered].sum()), int((~bad[covered]).sum())
        best, found = 1e-9, None
        for name, x in values.items():
            cuts, index = np.unique(x[covered], return_inverse=True)
            if len(cuts) < 2:
                continue
            b, g = np.bincount(index, bad[covered]), np.bincount(index, ~bad[covered])
            below_b, below_g = np.cumsum(b)[:-1], np.cumsum(g)[:-1]
            for at_least, bb, gg in ((False, below_b, below_g), (True, p0 - below_b, n0 - below_g)):
                gain = _information_gain(gg, bb, p0, n0)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, found = gain[i], Condition(name, at_least, float((cuts[i] + cuts[i + 1]) / 2))
        if found is None:
            break
        rule.append(found)
        covered &= found.holds(values)
    return rule


def _right(rule: list[Condition], values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[int, int]:
    covered = np.logical_and.reduce([c.holds(values) for c in rule])
    return int(bad[covered].sum()), int((~bad[covered]).sum())


def fit(values: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 5, most_rules: int = 12) -> DecisionList:
    """Grow on two of three rows, prune on the third; a rule counts if it is right in `precision` of at least `least` rows there."""
    out = DecisionList()
    left = np.ones(len(bad), bool)
    part = mix(np.arange(1, len(bad) + 1, dtype=np.uint64)) % np.uint64(3) == 0
    while len(out.rules) < most_rules:
        rows, held = left & ~part, left & part
        if bad[rows].sum() < least or not (~bad[rows]).any():
            break
        pick = lambda m: ({k: v[m] for k, v in values.items()}, bad[m])
        rule = grow(*pick(rows))
        if not rule:
            break
        scored = []
        for k in range(1, len(rule) + 1):
            p, n = _right(rule[:k], *pick(held))
            scored.append(((p - n) / max(p + n, 1) if p + n >= least else -1.0, -k, p, n))
        worth, k, p, n = max(scored)
        rule = rule[:-k]
        if worth < 2 * precision - 1 or p + n < least:
            break
        out.rules.append(rule)
        left &= ~np.logical_and.reduce([c.holds(values) for c in rule])
    return out


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Fit a list on a bounded hash sample of labelled rows that pass the base rules."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = bounded_share(known.count(), sample_rows)
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    rows = text_stats(one_text_each(docs, sample, "quality"), ["doc_id", "quality"]).where(~base_failed())
    names = features()
    got = rows.orderBy("doc_id").select("quality", *[c.alias(k) for k, c in names.items()]).toPandas()
    if not len(got):
        return DecisionList()
    return fit({k: got[k].to_numpy(float) for k in names}, got["quality"].to_numpy() == 0)


def judge(docs: DataFrame, rules: DecisionList, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, statistics, base_failed, rule (first that rejects, or 0) and kept."""
    rows = text_stats(docs, keep, text_col).withColumn("base_failed", base_failed())
    return rows.withColumn("rule", rules.rejects()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
