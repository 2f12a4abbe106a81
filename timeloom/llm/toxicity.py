"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, and scores of the windows around each hit.

Words and stems that labelled toxic documents use far more than others form a trie. Every distinct word of a text runs through
the intersection of that trie with the Levenshtein automaton of the word, so misspellings are found as well; results are kept
per word. Each hit is judged in its window of words: other hits nearby raise it, quotation marks around it set it apart.
A logistic model over those window scores gives the document's score.

Defined cases: null and empty texts have no hits and get the score of a text without any. Without labels of both kinds every
score is 0. Repeated rows are scored each.
"""

from __future__ import annotations

import functools
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, SliceCache, append_columns, blocks, bounded_share, count_in, one_text_each

#: Labelled documents that lexicon and model are fitted on at most, on average over a hash sample.
SAMPLE_ROWS = 30_000
#: A term's likelihood ratio and share of toxic documents at least; all terms that reach both are in the lexicon.
LEAST_RATIO, PURITY = 25.0, 0.7
WINDOW = 8
STEMS = (4, 5, 6, 7)
_STEM = "*"  # no word ends in it


# ---------------------------------------------------------------- words
@functools.cache
def _points() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point, and whether it is a letter or digit."""
    low, word = np.arange(sys.maxunicode + 1, dtype=np.uint32), np.zeros(sys.maxunicode + 1, bool)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalnum():
            word[i] = True
            if len(c.lower()) == 1:
                low[i] = ord(c.lower())
    return low, word


@dataclass
class Tokens:
    """Words of a block: runs without white space, less what is no letter or digit at either end."""

    n: int
    points: np.ndarray  # lower-cased
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    quoted: np.ndarray


def tokens(offsets: np.ndarray, data: np.ndarray) -> Tokens:
    n = len(offsets) - 1
    raw = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    low, alnum = _points()
    points, word = low[raw], alnum[raw]
    solid = ~((raw == 0x20) | ((raw >= 9) & (raw <= 13)))
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = np.diff(bounds) > 0
    first[bounds[:-1][full]] |= solid[bounds[:-1][full]]
    last[bounds[1:][full] - 1] |= solid[bounds[1:][full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    inside = np.flatnonzero(word)
    a, b = np.searchsorted(inside, starts), np.searchsorted(inside, ends) - 1
    some = b >= a
    starts, ends = inside[a[some]], inside[b[some]] + 1
    owner = np.searchsorted(bounds, starts, "right") - 1
    # quotation: an odd number of straight marks so far in the line, or more opening than closing ones
    marks = np.cumsum(raw == 0x22)
    opened = np.cumsum(np.isin(raw, (0xAB, 0x201C, 0x201E)).astype(np.int64) - np.isin(raw, (0xBB, 0x201D)).astype(np.int64))
    line = np.maximum.accumulate(np.where((raw == 0x0A) | np.isin(np.arange(len(raw)), bounds[:-1]), np.arange(len(raw)), 0)) if len(raw) else np.zeros(0, np.int64)
    base = line[starts]
    quoted = ((marks[starts] - marks[base] + (raw[base] == 0x22)) % 2 == 1) | (opened[starts] - opened[base] > 0) if len(starts) else np.zeros(0, bool)
    return Tokens(n, points, starts, ends, owner, quoted)


# ---------------------------------------------------------------- lexicon
def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1


class Lexicon:
    """Trie of terms; a stem also takes any ending."""

    def __init__(self, terms: list[str], stems: list[str]) -> None:
        self.terms = [*terms, *stems]
        self.stem = [False] * len(terms) + [True] * len(stems)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for i, term in enumerate(self.terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(i)
        # an automaton can only accept a word that is a term, or becomes equal to one when either loses a letter; stems by their length
        self.near: set[str] = set()
        self.open_heads: dict[int, set[str]] = defaultdict(set)
        for term, stem in zip(self.terms, self.stem):
            if stem:
                self.open_heads[len(term)].add(term)
                continue
            self.near.add(term)
            if edits_allowed(len(term)):
                self.near.update(term[:i] + term[i + 1 :] for i in range(len(term)))
        self.longest = max(map(len, self.near), default=0) + 1

    def maybe(self, word: str) -> bool:
        """Whether the automata have to be asked: few words pass, however many terms there are."""
        for n, found in self.open_heads.items():
            if word[:n] in found:
                return True
        near = self.near
        if word in near:
            return True
        return len(word) <= self.longest and any(word[:i] + word[i + 1 :] in near for i in range(len(word)))

    def match(self, word: str) -> tuple[int, int]:
        """Nearest term (fewest edits, then first) and edits, or (-1, 0). The trie is walked together with the word's Levenshtein
        automaton, whose state at depth d is the edits (2: too many) between the path and the word's first d - 1, d and d + 1
        letters; a branch ends where all three are too many."""
        best = (2, len(self.terms))
        size = len(word)
        stack = [(0, 0, 2, 0, 1)]
        while stack:
            node, depth, before, here, after = stack.pop()
            for i in self.ends[node]:
                if self.stem[i]:
                    if here == 0 and depth <= size:
                        best = min(best, (0, i))
                else:
                    edits = before if size == depth - 1 else here if size == depth else after if size == depth + 1 else 2
                    if edits <= edits_allowed(depth):
                        best = min(best, (edits, i))
            for c, child in self.children[node].items():
                # letters of the word at depth - 1, depth and depth + 1; past its end nothing fits
                x = 2 if depth > size else min(2, before + (depth < 1 or word[depth - 1] != c), here + 1)
                y = 2 if depth + 1 > size else min(2, here + (word[depth] != c), x + 1, after + 1)
                z = 2 if depth + 2 > size else min(2, after + (word[depth + 1] != c), y + 1)
                if x < 2 or y < 2 or z < 2:
                    stack.append((child, depth + 1, x, y, z))
        return (best[1], best[0]) if best[1] < len(self.terms) else (-1, 0)

    def compute(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For the cache: one number for each word, 0 or 1 + 2 * term + edits."""
        out = np.zeros(len(slices), np.uint32)
        for k, x in enumerate(slices):
            word = x.decode("utf-32-le")
            if self.maybe(word):
                i, edits = self.match(word)
                if i >= 0:
                    out[k] = 1 + 2 * i + edits
        return out, np.ones(len(slices), np.int64)


FEATURES = ("hits", "quoted", "window", "fuzzy", "share")


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None  # of FEATURES, the last: constant
    worth: np.ndarray | None = None  # of each code of a hit, 0 to 1; 0: clean texts hold it as well, a misspelling that is a word of its own

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def cache(self) -> SliceCache:
        if "_cache" not in self.__dict__:
            self._lexicon = Lexicon(self.terms, self.stems)
            self._cache, self._rolling = SliceCache(self._lexicon.compute), Rolling(3)
        return self._cache

    def hits(self, t: Tokens) -> np.ndarray:
        """For each word 0, or 1 + 2 * term + edits."""
        if not len(t.starts) or not (self.terms or self.stems):
            return np.zeros(len(t.starts), np.uint32)
        cache = self.cache()
        hashes = self._rolling.slices(self._rolling.prefix(t.points), t.starts, t.ends)
        code = cache.rows(hashes, t.points.tobytes(), 4 * t.starts, 4 * t.ends)[0]
        return code if self.worth is None else np.where(self.worth[code] > 0, code, 0)

    def features(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """FEATURES of each text: worth of hits outside and number inside quotation, the densest window, misspelled hits, share of words."""
        t = tokens(offsets, data)
        code = self.hits(t)
        at = np.flatnonzero(code)
        of, quoted = t.owner[at], t.quoted[at]
        count = np.bincount(t.owner, minlength=t.n)
        # a window is the words around a hit, in its own text
        first = np.cumsum(count) - count
        left, right = np.maximum(at - WINDOW, first[of]), np.minimum(at + WINDOW + 1, (first + count)[of])
        open_hits = np.concatenate(([0], np.cumsum(np.isin(np.arange(len(code)), at[~quoted]))))
        near = open_hits[right] - open_hits[left]
        worth = np.ones(len(at)) if self.worth is None else self.worth[code[at]]
        densest = np.zeros(t.n)
        np.maximum.at(densest, of, near)
        fuzzy = (code[at] - 1) % 2 == 1
        alone = np.bincount(of[~quoted], worth[~quoted], minlength=t.n)
        return np.column_stack([np.log1p(alone), np.log1p(np.bincount(of[quoted], minlength=t.n)), densest, np.log1p(np.bincount(of[fuzzy & ~quoted], minlength=t.n)), np.sqrt(alone / np.maximum(count, 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-(x @ self.weights[:-1] + self.weights[-1])))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the constant last, by Newton's method with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def lexicon_of(counts: list[tuple[str, bool, int, int]], toxic: int, clean: int, least_ratio: float = LEAST_RATIO, purity: float = PURITY) -> tuple[list[str], list[str]]:
    """Words and stems whose likelihood ratio of use in toxic documents is large. Words that a stem covers follow the others, as a
    stem takes no misspelling."""
    rate = toxic / max(toxic + clean, 1)
    good = []
    for term, stem, a, b in counts:
        n = a + b
        if a < 3 or a / n < purity:
            continue
        p = a / n
        ratio = 2 * (a * np.log(p / rate) + (b * np.log((1 - p) / (1 - rate)) if b else 0.0))
        if ratio >= least_ratio:
            good.append((ratio, term, stem))
    good.sort(key=lambda x: (-x[0], x[1]))
    beginnings = Counter(t[:k] for _, t, stem in good if not stem for k in range(1, len(t) + 1))
    stems: dict[str, None] = {}
    inside: set[str] = set()  # beginnings of stems
    begun = lambda t: any(t[:k] in stems for k in range(1, len(t) + 1))
    for _, term, stem in good:
        # a stem says more than its words only if several words share it
        if stem and beginnings[term] >= 3 and term not in inside and not begun(term):
            stems[term] = None
            inside.update(term[:k] for k in range(1, len(term) + 1))
    terms, covered = [], []
    for _, t, stem in good:
        if not stem:
            (covered if begun(t) else terms).append(t)
    return terms + covered, list(stems)


def least_use(toxic: int, clean: int) -> int:
    """Documents that a term needs: with fewer toxic ones its ratio is too small even if no other document uses it."""
    said = np.log((toxic + clean) / max(toxic, 1))
    return max(3, int(np.ceil(LEAST_RATIO / (2 * max(said, 1e-9)))))


def _word_counts(sample: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """(term, stem, documents) over the sample's documents; wanted: terms and stems (with a trailing mark) that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for _, offsets, data in blocks(batch.column(0)):
                t = tokens(offsets, data)
                raw = t.points.tobytes()
                bounds = np.searchsorted(t.owner, np.arange(t.n + 1)).tolist()
                for a, b in zip(bounds, bounds[1:]):
                    own = {raw[4 * i : 4 * j].decode("utf-32-le") for i, j in zip(t.starts[a:b].tolist(), t.ends[a:b].tolist())}
                    own |= {w[:k] + _STEM for w in own for k in STEMS if len(w) > k}
                    found.update(own if wanted is None else own & wanted)
                if len(found) > 500_000:
                    yield _count_rows(found)
                    found.clear()
        yield _count_rows(found)

    rows = sample.select("text").mapInArrow(run, "term string, n bigint")
    return rows.groupBy("term").agg(F.sum("n").alias("n"))


def _count_rows(found: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])


def _hit_counts(sample: DataFrame, model: Model) -> DataFrame:
    """(code, toxic documents, other documents) for each term and number of edits that the sample holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column(1).to_pylist())
            for first, offsets, data in blocks(batch.column(0)):
                t = tokens(offsets, data)
                code = model.hits(t)
                at = np.flatnonzero(code)
                pairs = np.unique(np.column_stack([t.owner[at], code[at].astype(np.int64)]), axis=0)
                kind = toxic[first + pairs[:, 0]] > 0
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(kind)], names=["code", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "code bigint, toxic boolean")
    return rows.groupBy("code").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and model from a bounded hash sample of the labelled rows given; which rows may be learned from is the caller's choice."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {bool(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model()
    share = bounded_share(sum(totals.values()), sample_rows)
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    rows = one_text_each(docs, sample, "toxic")
    sizes = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    # what toxic documents use often enough is counted in the others as well; the sample bounds how many terms that can be
    least = least_use(sizes.get(True, 0), sizes.get(False, 0))
    ours = dict(map(tuple, _word_counts(rows.where("toxic > 0")).where(F.col("n") >= least).collect()))
    theirs = dict(map(tuple, _word_counts(rows.where("toxic = 0"), frozenset(ours)).collect()))
    counts = [(term.rstrip(_STEM), term.endswith(_STEM), a, theirs.get(term, 0)) for term, a in ours.items()]
    model = Model(*lexicon_of(counts, sizes.get(True, 0), sizes.get(False, 0)))
    model.worth = np.full(2 * len(model.terms + model.stems) + 3, 0.5)  # of misspellings that the sample lacks
    for code, a, b in _hit_counts(rows, Model(model.terms, model.stems)).collect():  # two rows for each term at most
        odds = np.log((a + 0.5) / (sizes.get(True, 0) + 1)) - np.log((b + 0.5) / (sizes.get(False, 0) + 1))
        model.worth[code] = 0.0 if b > 0.2 * (a + b) else min(max(odds / 6, 0.05), 1.0)
    names = [f"x{i}" for i in range(len(FEATURES))]
    bare = Model(model.terms, model.stems, None, model.worth)
    seen = append_columns(rows, "text", ["doc_id", "toxic"], ", ".join(f"{n} double" for n in names), lambda o, d: [pa.array(c) for c in bare.features(o, d).T]).orderBy("doc_id").toPandas()
    y = seen["toxic"].to_numpy(float)
    if len(set(y.tolist())) > 1:
        model.weights = logistic(seen[names].to_numpy(float), (y > 0).astype(float))
    return model


def score(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, score, predicted and the hits in the densest window of every whole text."""

    def run(offsets: np.ndarray, data: np.ndarray) -> list[pa.Array]:
        x = model.features(offsets, data)
        s = model.score(x)
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(x[:, 2].astype(np.int32))]

    return append_columns(df, text_col, keep, "score double, predicted int, densest_window int", run)
