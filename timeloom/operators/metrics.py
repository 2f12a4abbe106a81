"""Corpus metrics: windowed word error rate, character n-gram F-score, bootstrap, waveform peaks."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from timeloom.functions.text import clean_for_ngrams
from timeloom.storage import cut

ORDER, BETA = 6, 2.0
OPS = ArrayType(StructType([StructField(name, StringType()) for name in ("op", "ref", "hyp")]))


class EditRows:
    """Rows of the edit matrix from ref (rows) to hyp (columns), each two numbers of as many bits as hyp has tokens.

    Bit j of `diagonal` says that cell j costs what the cell before it in the row before costs; bit j of `down`, that it costs one more
    than the cell above. All cells of a row come from a few operations on whole numbers.
    """

    def __init__(self, hyp: list[str]) -> None:
        self.full, self.places = (1 << len(hyp)) - 1, {}
        for j, token in enumerate(hyp):
            self.places[token] = self.places.get(token, 0) | 1 << j

    def first(self) -> tuple[int, int]:
        """Where a row rises and falls from a cell to the next, for the row of no ref tokens."""
        return self.full, 0

    def after(self, row: tuple[int, int], token: str) -> tuple[tuple[int, int], int, int]:
        rises, falls = row
        same = self.places.get(token, 0) | falls
        diagonal = ((same & rises) + rises ^ rises | same) & self.full
        up, down = rises & diagonal, falls | self.full & ~(rises | diagonal)
        shifted = down << 1 | 1
        return ((up << 1 | ~(diagonal | shifted)) & self.full, shifted & diagonal & self.full), diagonal, down


def align_tokens(ref: list[str], hyp: list[str]) -> list[dict[str, str]]:
    """Least edits from ref to hyp. Traced from the end; of equal ways a pair comes before a deletion, that before an insertion.

    Only each so many-th row is kept on the way down; on the way back the rows between two of them are made again. So n by m tokens
    take about 4 * sqrt(n) * m bits, not n * m numbers."""
    matrix, span = EditRows(hyp), max(1, math.isqrt(len(ref)))
    row, kept = matrix.first(), []
    for i, token in enumerate(ref):
        if i % span == 0:
            kept.append(row)
        row = matrix.after(row, token)[0]
    out, i, j = [], len(ref), len(hyp)
    below = i  # the first row of those at hand
    rows: list[tuple[int, int]] = []
    while i or j:
        if i and i <= below:
            below = (i - 1) // span * span
            row, rows = kept[below // span], []
            for token in ref[below:i]:
                row, *bits = matrix.after(row, token)
                rows.append(tuple(bits))
        diagonal, down = rows[i - 1 - below] if i else (0, 0)
        if i and j and (ref[i - 1] == hyp[j - 1] or not diagonal >> (j - 1) & 1):
            i, j = i - 1, j - 1
            out.append({"op": "ok" if ref[i] == hyp[j] else "sub", "ref": ref[i], "hyp": hyp[j]})
        elif i and (not j or down >> (j - 1) & 1):
            i -= 1
            out.append({"op": "del", "ref": ref[i], "hyp": ""})
        else:
            j -= 1
            out.append({"op": "ins", "ref": "", "hyp": hyp[j]})
    return out[::-1]


@F.pandas_udf(OPS)
def align(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([align_tokens(list(r), list(h)) for r, h in zip(ref, hyp)])


def binned_tokens(cues: DataFrame, tokens: Column, window: float, name: str) -> DataFrame:
    """Tokens of cues in order, by the window that holds their midpoint."""
    rows = cues.select("file_id", F.floor((F.col("start") + F.col("end")) / 2 / window).alias("bin"), "seq", tokens.alias("t"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "t")))
    return rows.groupBy("file_id", "bin").agg(F.flatten(F.transform(parts, lambda x: x["t"])).alias(name))


def aligned_bins(ref: DataFrame, hyp: DataFrame, ref_tokens: Column, hyp_tokens: Column, window: float = 60.0) -> DataFrame:
    """(file_id, bin, ref, hyp, ops): windows are the unit of parallel work; a long one takes more time, hardly more memory."""
    a, b = binned_tokens(ref, ref_tokens, window, "ref"), binned_tokens(hyp, hyp_tokens, window, "hyp")
    none = F.array().cast("array<string>")
    both = a.join(b, ["file_id", "bin"], "full_outer").withColumns({"ref": F.coalesce("ref", none), "hyp": F.coalesce("hyp", none)})
    return both.withColumn("ops", align("ref", "hyp"))


def window_errors(bins: DataFrame) -> DataFrame:
    count = lambda op: F.size(F.filter("ops", lambda x: x["op"] == op))
    rows = bins.select("file_id", "bin", F.size("ref").alias("n_ref"), F.size("hyp").alias("n_hyp"), count("sub").alias("subs"), count("del").alias("dels"), count("ins").alias("inss"))
    return rows.withColumn("wer", (F.col("subs") + F.col("dels") + F.col("inss")) / F.greatest(F.col("n_ref"), F.lit(1)))


def total_errors(windows: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n_ref", "n_hyp", "subs", "dels", "inss")]
    return windows.agg(*sums).withColumn("wer", (F.col("subs") + F.col("dels") + F.col("inss")) / F.greatest(F.col("n_ref"), F.lit(1)))


def worst_windows(windows: DataFrame, k: int = 8) -> DataFrame:
    """The windows with the highest rates; of equals the later one first."""
    return windows.orderBy(F.desc("wer"), F.desc("bin"), F.desc("file_id")).limit(k)


def confusions(bins: DataFrame, k: int = 25) -> DataFrame:
    """(op, ref, hyp, n): the most frequent substitutions, deletions and insertions, k of each; of equals the one seen first."""
    rows = bins.select("file_id", "bin", F.posexplode("ops").alias("place", "o")).where(F.col("o.op") != "ok")
    counts = rows.groupBy("o.op", "o.ref", "o.hyp").agg(F.count("*").alias("n"), F.min(F.struct("file_id", "bin", "place")).alias("first"))
    place = F.row_number().over(Window.partitionBy("op").orderBy(F.desc("n"), "first"))
    return counts.withColumn("_k", place).where(F.col("_k") <= k).select("op", "ref", "hyp", "n")


def report_line(totals: DataFrame, label: str) -> DataFrame:
    rate = lambda c: 100 * F.col(c) / F.greatest(F.col("n_ref"), F.lit(1))
    form = f"{label:8s} WER=%.1f%%  sub=%.1f%%  del=%.1f%%  ins=%.1f%%  (ref words=%d, hyp words=%d)"
    return totals.select(F.format_string(form, 100 * F.col("wer"), rate("subs"), rate("dels"), rate("inss"), F.col("n_ref").cast("long"), F.col("n_hyp").cast("long")).alias("line"))


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """(file_id, seq, h, r) of covered pairs whose reference is no quotation or song and which both leave text when cleaned."""
    spoken = ~F.regexp_replace("ref_text", r"^[-( ]+", "").rlike(r"^[\"“♪]")
    rows = pairs.where(spoken).select("file_id", "seq", clean_for_ngrams(F.col("hyp_text")).alias("h"), clean_for_ngrams(F.col("ref_text")).alias("r"))
    return rows.where((F.col("h") != "") & (F.col("r") != ""))


def worst_pairs(stats: DataFrame, n: int) -> DataFrame:
    """(pair_id, chrf) of the n pairs with the lowest scores, ties by pair."""
    return f_score(stats, "pair_id").orderBy("chrf", "pair_id").limit(n)


def gram_counts(hyp: list[str], ref: list[str]) -> np.ndarray:
    """[pair, n - 1, (matched, hyp, ref)] for n from 1 to ORDER over all pairs at once: a gram of n characters is a number made of
    that of its first n - 1 and its last character, and a pair's multisets are sorted runs of those numbers."""
    n_pairs, texts = len(hyp), [*hyp, *ref]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters from here to the end of the text
    last = gram = np.unique(points, return_inverse=True)[1].astype(np.int64)
    kinds = int(last.max(initial=0)) + 1
    out = np.zeros((n_pairs, ORDER, 3), np.int64)
    for n in range(1, ORDER + 1):
        if n > 1:
            longer, reach = np.zeros(len(gram), np.int64), max(len(gram) - n + 1, 0)
            longer[:reach] = gram[:reach] * kinds + last[len(gram) - reach :]
            gram = np.unique(longer, return_inverse=True)[1]
        whole = left >= n
        pair, mine = text[whole] % n_pairs, text[whole] < n_pairs
        code = pair * (int(gram.max(initial=0)) + 1) + gram[whole]
        a, count_a = np.unique(code[mine], return_counts=True)
        b, count_b = np.unique(code[~mine], return_counts=True)
        both, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        owner = both // (int(gram.max(initial=0)) + 1)
        out[:, n - 1, 0] = np.bincount(owner, np.minimum(count_a[at_a], count_b[at_b]), n_pairs)
        out[:, n - 1, 1], out[:, n - 1, 2] = np.bincount(pair[mine], minlength=n_pairs), np.bincount(pair[~mine], minlength=n_pairs)
    return out


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _gram_counts(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """For n from 1 to ORDER: n-grams in both (each as often as in the one that has fewer), in hyp, in ref."""
    bare = lambda x: x.fillna("").str.replace(" ", "", regex=False).tolist()
    return pd.Series(gram_counts(bare(hyp), bare(ref)).tolist()) if len(hyp) else pd.Series([], dtype=object)


def ngram_stats(pairs: DataFrame) -> DataFrame:
    """(pair_id, n, matched, hyp, ref) for texts h and r without spaces.

    Both multisets of a pair are counted where the pair is: n-grams as rows would be a hundred times the text, and a shuffle of them.
    """
    rows = pairs.select("pair_id", F.posexplode(_gram_counts("h", "r")).alias("n", "c"))
    some = rows.where((F.col("c")[1] > 0) | (F.col("c")[2] > 0))
    return some.select("pair_id", (F.col("n") + 1).alias("n"), F.col("c")[0].alias("matched"), F.col("c")[1].alias("hyp"), F.col("c")[2].alias("ref"))


def f_score(stats: DataFrame, *keys: str) -> DataFrame:
    """chrF of totals by n: mean precision and recall over the n that both sides have, recall counting BETA times."""
    totals = stats.groupBy(*keys, "n").agg(*[F.sum(c).alias(c) for c in ("matched", "hyp", "ref")]).where((F.col("hyp") > 0) & (F.col("ref") > 0))
    means = totals.groupBy(*keys).agg(F.avg(F.col("matched") / F.col("hyp")).alias("p"), F.avg(F.col("matched") / F.col("ref")).alias("r"))
    b2 = BETA**2
    return means.select(*keys, F.when(F.col("p") + F.col("r") > 0, 100 * (1 + b2) * F.col("p") * F.col("r") / (b2 * F.col("p") + F.col("r"))).otherwise(0.0).alias("chrf"))


def _score_of(sums: np.ndarray) -> float:
    """chrF of (order, 3) totals."""
    some = sums[(sums[:, 1] > 0) & (sums[:, 2] > 0)]
    if not len(some):
        return 0.0
    p, r = (some[:, 0] / some[:, 1]).mean(), (some[:, 0] / some[:, 2]).mean()
    return 100 * (1 + BETA**2) * p * r / (BETA**2 * p + r) if p + r else 0.0


#: Pairs whose numbers one task adds up for all rounds.
BLOCK = 4096


def _draws(n: int, rounds: int, seed: int, block: int) -> Iterator[pd.DataFrame]:
    """How often each of n rows is drawn in each round, by blocks of rows; the generator is sequential, so one task runs it."""
    draw = random.Random(seed)
    for r in range(rounds):
        times = np.bincount([draw.randrange(n) for _ in range(n)], minlength=n)
        parts = [times[i : i + block] for i in range(0, n, block)]
        yield pd.DataFrame({"block": range(len(parts)), "round": r, "times": [p.tolist() for p in parts]})


def bootstrap(stats_a: DataFrame, stats_b: DataFrame, rounds: int = 300, seed: int = 0, order: int = ORDER, block: int = BLOCK, by_block: bool = False) -> DataFrame:
    """Difference of two systems' chrF over resampled pairs, with the interval from sorted places 7 and 292 of 300.

    Rows are numbered in order of pair_id. A resample is a vector of multiplicities; blocks of rows add up their numbers for all
    rounds by a matrix product, and only these sums, one row a round and block, come together.

    by_block: multiplicities are Poisson numbers of mean 1 that each block draws from a seed of its own, so no task draws for all rows.
    A resample then has about as many pairs as there are, not just as many; the interval is another draw of the same kind.
    """
    spark, width = stats_a.sparkSession, 3 * order

    def wide(stats: DataFrame, name: str) -> DataFrame:
        of = lambda n: F.coalesce(F.max(F.when(F.col("n") == n, F.array("matched", "hyp", "ref"))), F.array(*[F.lit(0).cast("long")] * 3))
        return stats.groupBy("pair_id").agg(F.concat(*[of(n) for n in range(1, order + 1)]).alias(name))

    both = wide(stats_a, "a").join(wide(stats_b, "b"), "pair_id").select("pair_id", F.concat("a", "b").alias("v"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(both.repartitionByRange(parts, "pair_id").sortWithinPartitions("pair_id").withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # a row for each partition
    total = sum(sizes.values())
    schema = "pairs bigint, difference double, low double, high double"
    if not total:
        return spark.createDataFrame([], schema)
    before = {p: sum(n for q, n in sizes.items() if q < p) for p in sizes}
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("part")]
    numbered = rows.withColumn("k", base + F.row_number().over(Window.partitionBy("part").orderBy("pair_id")) - 1)
    blocks = numbered.select(F.floor(F.col("k") / block).cast("int").alias("block"), "k", "v")

    def add_up(mine: pd.DataFrame, times: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(mine.sort_values("k")["v"].to_numpy())
        sums = np.stack(times["times"].to_numpy()) @ values
        out = pd.DataFrame({"round": times["round"].to_numpy(), "sums": sums.tolist()})
        return pd.concat([out, pd.DataFrame({"round": [-1], "sums": [values.sum(axis=0).tolist()]})])

    def draw_and_add_up(mine: pd.DataFrame) -> pd.DataFrame:
        draw = np.random.Generator(np.random.PCG64([seed, int(mine["block"].iloc[0])]))
        return add_up(mine, pd.DataFrame({"round": range(rounds), "times": list(draw.poisson(1.0, (rounds, len(mine))))}))

    if by_block:
        sums = blocks.groupBy("block").applyInPandas(draw_and_add_up, "round int, sums array<bigint>")
    else:
        draws = spark.range(0, 1, 1, 1).mapInPandas(lambda _: _draws(total, rounds, seed, block), "block int, round int, times array<bigint>")
        sums = blocks.groupBy("block").cogroup(draws.groupBy("block")).applyInPandas(add_up, "round int, sums array<bigint>")
    whole = sums.groupBy("round").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(2 * width)]).alias("sums"))

    def interval(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {r: np.array(v).reshape(2, order, 3) for f in frames for r, v in zip(f["round"], f["sums"])}
        score = {r: _score_of(v[0]) - _score_of(v[1]) for r, v in found.items()}
        diffs = sorted(score[r] for r in range(rounds))
        yield pd.DataFrame({"pairs": [total], "difference": [score[-1]], "low": [diffs[int(0.025 * rounds)]], "high": [diffs[int(0.975 * rounds)]]})

    return whole.coalesce(1).mapInPandas(interval, schema)


def peaks(samples: DataFrame, per_bin: int = 200) -> DataFrame:
    """Largest absolute sample of each whole bin, scaled to 0..255 by the largest of the file. samples: file_id, i, sample."""
    bins = samples.groupBy("file_id", F.floor(F.col("i") / per_bin).alias("bin")).agg(F.max(F.abs("sample")).alias("top"), F.count("*").alias("n")).where(F.col("n") == per_bin)
    most = F.max("top").over(Window.partitionBy("file_id"))  # samples are read once; a join with each file's largest would read them twice
    return bins.withColumn("most", most).select("file_id", "bin", F.expr("(top * 255) div greatest(most, 1)").alias("peak"))


def lower_median_anchors(offsets: DataFrame, least: int = 2) -> DataFrame:
    """Median offset of each cue with enough matched tokens."""
    return offsets.groupBy("file_id", "cue_seq").agg(F.percentile("offset", 0.5).alias("offset"), F.count("*").alias("n")).where(F.col("n") >= least)


