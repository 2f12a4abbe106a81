"""Language identification by rank order: out-of-place distance between a document's n-grams and each language's.

Texts become words of lower-cased letters with one mark between them; n-grams of one to three characters are counted over the
whole text, the PROFILE most frequent are ranked (ties: by code points), and their places are compared with those of each
learned profile. An n-gram that a profile lacks counts as PROFILE places away.

Defined cases: a null text, or one without a letter, is `und` with score 0. Of languages at equal distance the first in order
of names wins. Without learned languages everything is `und`. Repeated rows are judged each.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns, blocks, bounded_share

#: Places of a profile.
PROFILE = 300
#: Documents of each language that profiles are learned from at most, on average over hash samples.
DOCS_PER_LANGUAGE = 3000
_MARK = 0x5F
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for what is none."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _symbols(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the texts with one mark before, between and after their words; and where each text starts."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.searchsorted(lead, offsets)
    letters = _letters()[points]
    # a mark in front of each text, then all but the non-letters that follow a non-letter
    wide = np.insert(letters, bounds[:-1], 0)
    begin = bounds[:-1] + np.arange(len(bounds) - 1)
    keep = wide != 0
    keep[1:] |= wide[:-1] != 0
    keep[begin] = True
    last = np.append(begin[1:], len(wide)) - 1
    ends_in_letter = (wide[last] != 0) & (last >= begin)
    out = np.where(wide == 0, _MARK, wide)[keep]
    begin = np.cumsum(keep)[begin] - 1
    # a mark after a text that ends in a letter
    stops = np.append(begin[1:], len(out))[ends_in_letter]
    out = np.insert(out, stops, _MARK)
    return out, np.append(begin + np.concatenate(([0], np.cumsum(ends_in_letter)[:-1])), len(out))


def ranked(offsets: np.ndarray, data: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, count, place) of the n-grams of each text of a block, the most frequent first; most: places kept."""
    n = len(offsets) - 1
    empty = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(data):
        return empty
    symbols, bounds = _symbols(offsets, data)
    alphabet, dense = np.unique(symbols, return_inverse=True)
    bits = max(1, int(len(alphabet)).bit_length())
    if 3 * bits + n.bit_length() > 62 and n > 1:  # many texts in many scripts: in halves
        half = n // 2
        a = ranked(offsets[: half + 1], data[: offsets[half]], most)
        b = ranked(offsets[half:] - offsets[half], data[offsets[half] :], most)
        return np.concatenate((a[0], b[0] + half)), *(np.concatenate(x) for x in zip(a[1:], b[1:]))
    dense = dense.astype(np.int64) + 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    letter = symbols != _MARK
    keys = [(owner[letter] << (3 * bits)) | dense[letter]]
    two = (owner[:-1] == owner[1:]) & (letter[:-1] | letter[1:])
    pair = (dense[:-1] << bits) | dense[1:]
    keys.append((owner[:-1][two] << (3 * bits)) | pair[two])
    three = two[:-1] & (owner[:-2] == owner[2:]) & letter[1:-1]
    keys.append((owner[:-2][three] << (3 * bits)) | (pair[:-1][three] << bits) | dense[2:][three])
    every = np.sort(np.concatenate(keys))
    if not len(every):
        return empty
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    count = np.diff(np.append(first, len(every)))
    keys = every[first]
    of = keys >> (3 * bits)
    order = np.lexsort((keys, -count, of))
    of, keys, count = of[order], keys[order], count[order]
    begin = np.searchsorted(of, np.arange(n))
    place = np.arange(len(of)) - begin[of]
    if most is not None:
        top = place < most
        of, keys, count, place = of[top], keys[top], count[top], place[top]
    wide = np.concatenate((np.zeros(1, np.int64), alphabet.astype(np.int64)))
    mask = (1 << bits) - 1
    code = (wide[(keys >> (2 * bits)) & mask] << 42) | (wide[(keys >> bits) & mask] << 21) | wide[keys & mask]
    return of, code, count, place


@dataclass
class Profiles:
    languages: list[str] = field(default_factory=list)
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # ascending
    places: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))  # of each language and code, the last: none

    def distances(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Mean distance over PROFILE of each text to each language; not a number for texts without letters."""
        n = len(offsets) - 1
        of, code, _, place = ranked(offsets, data, PROFILE)
        at = np.searchsorted(self.codes, code)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != code)] = len(self.codes)
        total = np.bincount(of, minlength=n).astype(float)
        out = np.empty((len(self.languages), n))
        for i in range(len(self.languages)):
            theirs = self.places[i, at]
            out[i] = np.bincount(of, np.where(theirs < 0, PROFILE, np.abs(place - theirs)), minlength=n)
        with np.errstate(invalid="ignore", divide="ignore"):
            return out / (total * PROFILE)


def _hash_below(share: Column | float) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Profiles:
    """Profiles of the languages of docs (text, lang, doc_id), from a bounded hash sample of each; the rows to learn from are the caller's choice."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    totals = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not totals:
        return Profiles()
    shares = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(bounded_share(v, docs_per_language)))])
    sample = known.where(_hash_below(F.element_at(shares, F.col("lang")))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for first, offsets, data in blocks(batch.column(1)):
                of, code, number, _ = ranked(offsets, data, None)
                mine = names[first : first + len(offsets) - 1]
                for lang in sorted(set(mine)):
                    pick = (mine == lang)[of]
                    codes, at = np.unique(code[pick], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(np.bincount(at, number[pick], minlength=len(codes)).astype(np.int64))], names=["lang", "code", "n"])

    counts = sample.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1).where(F.col("place") < PROFILE)
    rows = top.select("lang", "code", "place").toPandas()  # PROFILE rows for each language
    languages = sorted(rows["lang"].unique())
    codes = np.unique(rows["code"].to_numpy())
    places = np.full((len(languages), len(codes) + 1), -1, np.int64)
    places[np.searchsorted(languages, rows["lang"].to_numpy()) if languages else [], np.searchsorted(codes, rows["code"].to_numpy())] = rows["place"].to_numpy()
    return Profiles([str(x) for x in languages], codes, places)


def identify(df: DataFrame, profiles: Profiles, keep: list[str], text_col: str = "text", sharpness: float = 40.0) -> DataFrame:
    """The kept columns, lang_pred, score (share of the nearest profile among all, falling off exponentially with distance) and
    distance (0: the profile's own order, 1: nothing in common; null for `und`)."""

    def judge(offsets: np.ndarray, data: np.ndarray) -> list[pa.Array]:
        n = len(offsets) - 1
        if not profiles.languages:
            return [pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), pa.nulls(n, pa.float64())]
        far = profiles.distances(offsets, data)
        none = np.isnan(far[0])
        far = np.where(none, 1.0, far)
        best = np.argmin(far, axis=0)
        least = far[best, np.arange(n)]
        score = np.where(none, 0.0, 1 / np.exp(-sharpness * (far - least)).sum(axis=0))
        names = [UNKNOWN if x else profiles.languages[i] for x, i in zip(none.tolist(), best.tolist())]
        return [pa.array(names, pa.string()), pa.array(score), pa.array(least, mask=none)]

    return append_columns(df, text_col, keep, "lang_pred string, score double, distance double", judge)
