"""Mixing, alignment of tokenizers and fill-in-the-middle against brute force, on tables with every odd case."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest

from timeloom.llm import alignment, fill_middle, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def text_of(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(n))


def odd_texts(rng):
    base = [text_of(rng, rng.randint(1, 80)) for _ in range(30)]
    return [*base, None, "", " ", "  \n\t ", base[3], base[3], "a<P>b", "<S>", "x<M", "<s>a</s> <unk> <|endoftext|>", "é日本 ß\n" * 50, "#" * 500, "a  b   c ", "end   ", "▁x", "a▁ b", "it's  we'll 'S x́", "\x00 nul", "👩‍👩‍👧 ok", text_of(rng, 4000), "مرحبا بالعالم"]


def documents(spark, rows, **more):
    """Documents with columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit("clash"), "size": F.lit("clash"), "kept": F.lit(1), "block": F.lit("x"), "output": F.lit("y"), "source_size": F.lit("z"), **more})


# ---------------------------------------------------------------- fill in the middle
def cut_by_rule(doc_id, text):
    t = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fill_middle_equals_the_rule_and_is_undone(spark):
    rng = random.Random(3)
    texts = odd_texts(rng) * 4
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "no id at all", "en", "s", 0), (None, None, None, None, None), (7, "another text of seven", "en", "s", 0)]
    out = fill_middle.transform(documents(spark, rows), ["doc_id", "n", "text", "output"])
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = fill_middle.restore(out, ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]).collect()
    assert len(back) == len(rows)
    for r in back:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == cut_by_rule(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}
    assert fill_middle.transform(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0


def test_units_and_places_by_big_numbers():
    rng = random.Random(5)
    for t in [x or "" for x in odd_texts(rng)]:
        raw = t.encode()
        for unit, want in (("points", [len(t[:i].encode()) for i in range(len(t))]), ("lines", [m.start() for m in re.finditer(rb"(?s)[^\n]*\n|[^\n]+", raw)]), ("words", [0, *[m.start() for m in WORD.finditer(raw.decode("latin-1"))][1:]] if raw else [])):
            mask = fill_middle.unit_starts(raw, unit)
            assert mask.bit_count() == len(want)
            for k in rng.sample(range(len(want)), min(20, len(want))):
                assert fill_middle.select(mask, len(raw), k) == want[k]
    with pytest.raises(ValueError):
        fill_middle.unit_starts(b"a", "pages")


# ---------------------------------------------------------------- mixing
def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets of sources in order, by dealing what is cut off again until none is above."""
    total, w = sum(sizes), [weights[i % len(weights)] for i in range(len(sizes))]
    capped: set[int] = set()
    while True:
        left, weight = total - sum(most * sizes[i] for i in capped), sum(w[i] for i in range(len(sizes)) if i not in capped)
        target = [most * s if i in capped else left * w[i] / weight for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in capped and target[i] > most * s}
        if not over:
            return target
        capped |= over


def mixed_rows(rng, counts):
    rows = []
    for source, n in counts.items():
        for _ in range(n):
            rows.append((len(rows), text_of(rng, int(rng.lognormvariate(3, 1)) + 1), "en", source, 0))
    return rows


def test_mix_meets_targets_in_whole_copies(spark):
    rng = random.Random(9)
    rows = mixed_rows(rng, {"a": 60, "b": 300, "c": 2500, "Z": 400, "é": 200, None: 150})
    rows += [(None, None, "en", "a", 0), (None, "one two", "en", "b", 0), (5, rows[5][1], "en", "c", 0), (5, "another", "en", "c", 0), (900001, "  ", "en", "empty", 0), (900002, "w " * 3000, "en", "c", 0)]
    docs = documents(spark, rows)
    out = mixing.mix(docs, ["doc_id", "size", "kept"])
    assert out.columns == ["doc_id", "kept", "size", "source_size", "target", "copies", "taken"]
    got = mixing.mix(docs, ["doc_id", "source", "text"]).collect()
    key = lambda r: (r[0] is None, r[0], r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(((r[0], r[1]) for r in rows), key=key)
    names = sorted({r[3] for r in rows if r[3] is not None}, key=lambda s: [ord(c) for c in s]) + [None]
    size = {n: sum(len(WORD.findall(r[1] or "")) for r in rows if r[3] == n) for n in names}
    want = dict(zip(names, shares([size[n] for n in names])))
    taken = Counter()
    for r in got:
        words = len(WORD.findall(r["text"] or ""))
        assert r["size"] == words and r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        mean = want[r["source"]] / size[r["source"]] if size[r["source"]] else 0
        assert int(mean) <= r["copies"] <= min(3, int(mean) + 1) and r["taken"] == words * r["copies"] <= 3 * words
        taken[r["source"]] += r["taken"]
    for n in names:
        assert abs(taken[n] - want[n]) <= max(5, 0.01 * want[n]), (n, taken[n], want[n])
    # the same whatever the partitions
    again = mixing.mix(docs.repartition(3), ["doc_id", "source", "text"]).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_levels_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 16)
    monkeypatch.setattr(mixing, "FAN", 4)
    monkeypatch.setattr(mixing, "ROWS", 8)
    rng = random.Random(10)
    rows = mixed_rows(rng, {"a": 700, "b": 100})
    got = mixing.mix(spark.createDataFrame(rows, DOCS), ["doc_id", "source"]).collect()
    assert len(got) == len(rows)
    for n in "ab":
        mine = [r for r in got if r["source"] == n]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.02 * mine[0]["target"]
        assert abs(sum(r["copies"] for r in mine) - len(mine) * mine[0]["target"] / mine[0]["source_size"]) < 20  # the landing, 64 documents here, drops this total
    assert mixing.mix(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, None, None, None), (1, " ", None, None, None)], DOCS), ["doc_id"]).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in blank] == [(0, 0, 0.0, 0)] * 2


def test_flights_keep_probabilities_right():
    """Over many seeds each document is taken about as often as its probability says, and the words stay as they are."""
    sizes = [3, 3, 8, 1, 40, 5, 5, 2, 9, 30, 7, 7, 7, 12]
    taken = Counter()
    for seed in range(3000):
        flight = mixing.Flight(seed)
        for i, s in enumerate(sizes):
            flight.add([0.3, s, i])
        rest = flight.rest()
        assert len(rest) <= mixing.LEFT
        assert abs(sum(sizes[i] * k for i, k in flight.done) + sum(u[0] * u[1] for u in rest) - 0.3 * sum(sizes)) < 1e-6
        assert abs(sum(k for _, k in flight.done) + sum(u[0] for u in rest) - 0.3 * len(sizes)) < 1e-6
        for i, k in flight.done:
            taken[i] += k
        for u in rest:
            taken[u[2]] += u[0]
    assert all(abs(taken[i] / 3000 - 0.3) < 0.04 for i in range(len(sizes)))


def test_a_landing_drops_no_large_document_that_the_rest_cannot_replace():
    """Nearly all documents of a source are wanted: the words that are too many go with small ones."""
    for seed in range(200):
        rng = random.Random(seed)
        sizes = [int(rng.lognormvariate(5, 1)) + 1 for _ in range(50)]
        flight = mixing.Flight(seed, float("inf"))
        for i, size in enumerate(sizes):
            flight.add([0.99, size, i])
        flight.land()
        assert len(flight.done) == 50
        missed = abs(sum(sizes[i] * k for i, k in flight.done) - 0.99 * sum(sizes))
        assert missed <= max(3, 0.01 * sum(sizes)), (seed, missed, sum(sizes))


# ---------------------------------------------------------------- alignment
def aligned_by_loops(texts):
    import json

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    bytes_a = {i: bytes(letter[c] for c in e) for e, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items() if i != 50256}
    bytes_b = lambda i: bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    out, links_of, pairs = [], [], Counter()
    for t in texts:
        if not t:
            out.append(None), links_of.append([])
            continue
        whole = (" " + t).encode()
        a, b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        ba, bb = [bytes_a[i] for i in a], [bytes_b(i) for i in b]
        if b"".join(ba) != whole or b"".join(bb) != whole:
            out.append(None), links_of.append([])
            continue
        spans = []
        for parts in (ba, bb):
            at, mine = 0, []
            for x in parts:
                mine.append((at, at + len(x)))
                at += len(x)
            spans.append(mine)
        ends = sorted({y for _, y in spans[0]} & {y for _, y in spans[1]})
        group = lambda span: next(i for i, e in enumerate(ends) if span[1] <= e)
        written: list = [([], []) for _ in ends]
        for side, (ids, mine) in enumerate(zip((a, b), spans)):
            for i, s in zip(ids, mine):
                written[group(s)][side].append(str(i))
        links = [(a[i], b[j]) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
        pairs.update(links)
        links_of.append(links)
        out.append((len(a), len(b), len(ends), len(links), hashlib.sha256(";".join(f"{','.join(x)}|{','.join(y)}" for x, y in written).encode()).hexdigest()))
    top = Counter()
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    done = []
    for o, links in zip(out, links_of):
        n_a, n_b, groups, n, sha = o or (0, 0, 0, 0, "")
        done.append((n_a, n_b, groups, n, sum(pairs[p] == top[p[1]] for p in links), sum(pairs[p] for p in links), sha))
    return done


@pytest.mark.parametrize("part", [alignment.PART, 3])
def test_alignment_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(alignment, "BLOCK", 3000)
    monkeypatch.setattr(alignment, "HELD", 50)
    rng = random.Random(7)
    texts = [t if t is None else t[:900] for t in odd_texts(rng)] + ["the cat sat on the mat, again and again", "The  CAT's  mat\n\n\tsat", "ﬁne ½ ①", "don't can't won't 12345 3.14"] * 2
    rows = [(i if i != 4 else None, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = alignment.align(documents(spark, rows).repartition(3), A, B, ["doc_id", "text", "block", "kept", "n_a"], part=part).collect()
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = Counter((i, t, *w) for (i, t, *_), w in zip(rows, aligned_by_loops(texts)))
    assert Counter((r["doc_id"], r["text"], *[r[c] for c in columns]) for r in got) == want
    assert all(r["block"] == "x" for r in got)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], DOCS), A, B, ["doc_id"]).count() == 0
    none = alignment.align(spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], DOCS), A, B, ["doc_id"]).collect()
    assert sorted(map(tuple, none)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pieces_of_whole_texts_equal_the_library():
    import numpy as np

    rng = random.Random(21)
    model = alignment.piece_bpe(B)
    texts = ["".join(rng.choice("ab  \n.é日\t'<>s/0") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    offsets, data = alignment.spaced(np.concatenate(([0], np.cumsum([len(x) for x in raw]))), np.frombuffer(b"".join(raw), np.uint8))
    ids, bounds = model.encode_block(offsets, data)
    assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])] == model.library.encode(texts)
