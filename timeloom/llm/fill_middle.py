"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, which are written in another order between marks.

A text's bytes are numbers of as many bits. `bytes.translate` makes a digit of each byte, one number for each class (first byte of a
code point, white space, line break); boolean operations on shifted numbers mark where units start; `bit_count` gives how many there
are; the place of a unit is found by halving: the count of the lower half says which half holds it. All of it is linear in the text.

Which documents are cut, and where, follows from a hash of the id, so reruns and copies of an id agree.

Defined cases: a null text is empty; an empty text, and one that holds a mark, stays plain. A null id hashes as an empty one. Rows
that repeat an id are cut by the same numbers. An empty table gives no rows. Kept columns give way to new ones of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred texts so many stay plain, and so many of the others have the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
NEW = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def _digits(of) -> bytes:
    return bytes(0x31 if of(b) else 0x30 for b in range(256))


_FIRST = _digits(lambda b: b & 0xC0 != 0x80)
_SOLID = _digits(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
_BREAK = _digits(lambda b: b == 0x0A)


def class_mask(raw: bytes, digits: bytes) -> int:
    """A number whose bit i says whether byte i is of a class."""
    return int(raw[::-1].translate(digits), 2) if raw else 0


def unit_starts(raw: bytes, unit: str) -> int:
    """A number whose bit i says whether a unit starts at byte i: a code point, a word with the white space behind it, or a line."""
    if unit == "points":
        return class_mask(raw, _FIRST)
    if unit == "words":
        solid = class_mask(raw, _SOLID)
        starts = solid & ~(solid << 1)
        first = starts & -starts
        return starts ^ first | 1 if raw else 0  # white space before the first word is part of it
    if unit == "lines":
        return (class_mask(raw, _BREAK) << 1 | 1) & ((1 << len(raw)) - 1)
    raise ValueError(f"no such unit: {unit}")


def select(mask: int, width: int, k: int) -> int:
    """Place of the set bit number k, counted from 0, of a number of `width` bits that has one."""
    at = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        n = low.bit_count()
        if k < n:
            mask, width = low, half
        else:
            mask, width, k, at = mask >> half, width - half, k - n, at + half
    return at


def split(raw: bytes, h1: int, h2: int, unit: str = "points") -> tuple[int, int, int]:
    """(units, byte where the prefix ends, byte where the middle ends)."""
    starts = unit_starts(raw, unit)
    n = starts.bit_count()
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    place = lambda k: len(raw) if k == n else select(starts, len(raw), k)
    return n, place(a), place(b)


def points_in(raw: bytes) -> int:
    return class_mask(raw, _FIRST).bit_count()


def hashes(id_col: str, seed: str) -> list[Column]:
    """Four numbers of 32 bits for each id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(df: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", seed: str = "1", unit: str = "points", plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """The kept columns; n (units), form (plain, psm or spm), prefix_chars and middle_chars (null where plain) and output."""
    names = [x.split()[0] for x in NEW.split(", ")]
    keep = [c for c in keep if c not in names]
    rows = df.select(F.struct(*keep).alias("_kept"), F.col(text_col).alias("_text"), *[h.alias(f"_h{i}") for i, h in enumerate(hashes(id_col, seed))])
    kept_type = rows.schema["_kept"].dataType.simpleString()
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def one(raw: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple:
        n, a, b = split(raw, h1, h2, unit)
        if not raw or PREFIX in raw or SUFFIX in raw or MIDDLE in raw or h3 % 100 >= 100 - plain_percent:
            return n, "plain", None, None, raw
        before, middle, after = raw[:a], raw[a:b], raw[b:]
        first = h4 % 100 < suffix_first_percent
        parts = (SUFFIX, after, PREFIX, before, MIDDLE, middle) if first else (PREFIX, before, SUFFIX, after, MIDDLE, middle)
        return n, "spm" if first else "psm", points_in(before), points_in(middle), b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, offsets, data in blocks(batch.column(1)):
                n, raw = len(offsets) - 1, data.tobytes()
                numbers = (batch.column(i).slice(at, n).to_pylist() for i in range(2, 6))
                done = [one(raw[a:b], *h) for a, b, *h in zip(offsets[:-1].tolist(), offsets[1:].tolist(), *numbers)]
                columns = [pa.array(c, pa.binary() if k == pa.string() and i == 4 else k).cast(k) for i, (c, k) in enumerate(zip(zip(*done), kinds))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *columns], names=["_kept", *names])

    return small_batches(rows).mapInArrow(run, f"_kept {kept_type}, {NEW}").select("_kept.*", *names)


def rebuild(output: bytes, form: str) -> bytes:
    """The text that a form's output was made of; marks stand where no text can hold one, so the first of each is meant."""
    if form == "plain":
        return output
    mark = SUFFIX if form == "psm" else PREFIX
    one, _, rest = output[len(mark) :].partition(mark)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def restore(df: DataFrame, keep: list[str], output_col: str = "output", form_col: str = "form") -> DataFrame:
    """The kept columns and `restored`: the text before transform(), from output and form alone; null where either is."""
    keep = [c for c in keep if c != "restored"]
    rows = df.select(F.struct(*keep).alias("_kept"), F.col(output_col).alias("_output"), F.col(form_col).alias("_form"))
    kept_type = rows.schema["_kept"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, offsets, data in blocks(batch.column(1)):
                n, raw = len(offsets) - 1, data.tobytes()
                there = np.asarray(batch.column(1).slice(at, n).is_valid())
                forms = batch.column(2).slice(at, n).to_pylist()
                texts = [rebuild(raw[a:b], f) if f and ok else None for a, b, f, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), forms, there)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(texts, pa.binary()).cast(pa.string())], names=["_kept", "restored"])

    return small_batches(rows).mapInArrow(run, f"_kept {kept_type}, restored string").select("_kept.*", "restored")
