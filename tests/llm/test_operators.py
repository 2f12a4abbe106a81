"""Operators on training text against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from timeloom import storage
from timeloom.llm import byte_bpe, components, language, nearest, packing, quality_rules, simhash, suffix_dedup, token_store, toxicity, url_rules
from timeloom.llm.common import SliceCache, blocks
from timeloom.llm.word_bpe import WordBpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def text_of(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(n))


def documents(spark, texts):
    """Texts with ids in order, with columns of clashing names."""
    rows = [(i, t, "en", "s", len(t or ""), "x", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + ", ids string, n_words int")


def sample(rng):
    base = [text_of(rng, rng.randint(1, 300)) for _ in range(40)]
    return [*base, None, "", " \n\t ", base[3], base[3], base[4] + " tail", "#" * 3000, "é日本 ß\n" * 50, text_of(rng, 6000), "it's  we'll  'S\u00a0x"]


@pytest.fixture(scope="module")
def texts():
    return sample(random.Random(11))


# ---------------------------------------------------------------- url rules
RULES = [url_rules.Rule("org", "/", "allow"), url_rules.Rule("example.org", "/es/", "block"), url_rules.Rule("example.org", "/en/1", "block"), url_rules.Rule("com", "/fr/", "allow"), url_rules.Rule("com", "/de/", "block")]


def judged(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and re.match(".*".join(map(re.escape, r.path.split("*"))), path, re.S)]
    best = max(fit, key=lambda r: len(r.host) + len(r.path), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


@pytest.mark.parametrize("inline", [0, 256])
def test_url_rules(spark, inline):
    rules = [*RULES, url_rules.Rule("net", "/*ads", "block"), url_rules.Rule("net", "/a/*/b", "block")]
    urls = [None, "", "nothing", "http://", "HTTP://A.EXAMPLE.ORG/en/12", "http://example.org", "http://notexample.org/es/", "http://x.example.org/es/a?b", "http://a.com/fr", "http://a.com/fr/", "https://de.com/de/?://x.org/", "http://com/de/x#y", "http://x.org?q/es/", "http://b.net/x/ads1", "http://b.net/a/1/b", "http://É.com/fr/ü", "a://b://c.org/", "http://example.org/en/1", "http://example.org/en/1", "http://a\n.org/x", "http://x.example\n.org/es/", "http://example.org\n/es/", "http://com\n/de/"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id bigint, url string, host string, path string")
    got = {r["page_id"]: tuple(r[1:5]) for r in url_rules.judge(df, rules, inline_rules=inline).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_url_rules_edges(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert url_rules.judge(none, RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string")
    assert url_rules.judge(one, [], "block").first()["verdict"] == "block"
    assert url_rules.Rule("example.org", "/en/1", "x").tokens == ["example", "org", "en"]


# ---------------------------------------------------------------- byte-level BPE
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_byte_bpe_equals_the_library_and_round_trips(spark, texts):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    odd = ["".join(rng.choice("ab's tre've'll \n\t 12é9ß!?.,'日本'd'mI\u0301٣½\r\u00a0") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    every = [*texts, *odd, "<|endoftext|>"]
    rows = byte_bpe.encode(documents(spark, every), MULTI, round_trip=True)
    got = {r["doc_id"]: r for r in rows.collect()}
    for i, t in enumerate(every):
        want = library.encode_ordinary(t or "")
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want and bytes(got[i]["decoded"]) == (t or "").encode()
        ends = np.frombuffer(got[i]["token_ends"], "<u4").tolist()
        assert ends == np.cumsum([len(library.decode_single_token_bytes(x)) for x in want]).tolist()
    back = byte_bpe.decode(rows.select("doc_id", "ids"), MULTI).collect()
    assert all(bytes(r["decoded"]) == (every[r["doc_id"]] or "").encode() for r in back)


def test_scan_is_associative():
    functions = byte_bpe._machine()[0][np.random.default_rng(1).integers(0, 16, 5000)]
    product = byte_bpe._machine()[1]
    want = functions.copy()
    for i in range(1, len(want)):
        want[i] = product[want[i - 1], functions[i]]
    assert (byte_bpe.scan(functions) == want).all()


def test_slice_cache_starts_anew_when_full():
    cache = SliceCache(lambda xs: (np.array([b for x in xs for b in x], np.uint32), np.array([len(x) for x in xs])), bits=4)
    from timeloom.llm.common import Rolling

    rolling = Rolling()
    for k in range(20):
        raw = bytes(range(3 * k, 3 * k + 60))
        data, at = np.frombuffer(raw, np.uint8), np.arange(0, 60, 3)
        flat, counts = cache.rows(rolling.slices(rolling.prefix(data), at, at + 3), raw, at, at + 3)
        assert bytes(flat.astype(np.uint8)) == raw and (counts == 3).all()


# ---------------------------------------------------------------- language
def test_language(spark):
    rng = random.Random(2)
    make = lambda letters: text_of(rng, 80, letters)
    rows = [(i, make("aeilmo") if i % 2 else make("bdkrtz"), "xx" if i % 2 else "yy", "s", 1) for i in range(200)]
    profiles = language.learn(spark.createDataFrame(rows, DOCS).where("doc_id < 100"))
    assert profiles.languages == ["xx", "yy"]
    extra = [(200, None, None, None, None), (201, "", "xx", "s", 0), (202, "123 !?", "xx", "s", 0), (203, "a" * 200_000, "xx", "s", 0)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame([*rows, *extra, rows[0]], DOCS), profiles, ["doc_id"]).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(100, 200))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (200, 201, 202)) and got[203]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = language.learn(spark.createDataFrame([], DOCS))
    assert language.identify(documents(spark, ["abc"]), empty, ["doc_id"]).first()["lang_pred"] == "und"


def test_rank_order_counts(spark):
    text = "ab ab! ba"
    arr = pa.array([text, "", None, "z"])
    (_, offsets, data), *_ = blocks(arr)
    of, code, count, place = language.ranked(offsets, data, None)
    grams = Counter()
    for w in ("ab", "ab", "ba"):
        padded = f"_{w}_"
        grams.update(w)
        grams.update(padded[i : i + 2] for i in range(len(padded) - 1))
        grams.update(padded[i : i + 3] for i in range(len(padded) - 2))
    name = lambda c: "".join(chr(x) for x in (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF) if x)
    assert {name(int(c)): int(n) for c, n in zip(code[of == 0], count[of == 0])} == dict(grams)
    assert sorted(place[of == 0].tolist()) == list(range(len(grams))) and set(of.tolist()) == {0, 3}


# ---------------------------------------------------------------- simhash
def fingerprint(text, shingle=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_classes(spark, texts):
    every = [*texts, *[t.upper() for t in texts[:5]], "one", "one two", "ONE  two"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, every)).collect()}
    fps = [fingerprint(t) for t in every]
    assert [got[i]["fingerprint"] for i in range(len(every))] == [f"{f:016x}" for f in fps]
    assert {i: got[i]["component_id"] for i in range(len(every))} == classes(fps)


def classes(fps, distance=3):
    root = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= distance:
                ra, rb = root[a], root[b]
                if ra != rb:
                    root = [min(ra, rb) if x in (ra, rb) else x for x in root]
    return dict(enumerate(root))


@pytest.mark.parametrize("group_rows", [4, 2048])
def test_links_keep_every_class_however_large_groups_are(spark, group_rows):
    rng = random.Random(9)
    fps = set()
    for _ in range(25):
        c = rng.getrandbits(64)
        for _ in range(12):
            x = c
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp bigint"), 3, group_rows)
    roots = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in components.components(links).collect()}
    want = classes(fps)
    mine = {}
    for i, x in enumerate(fps):
        mine.setdefault(roots.get(x, x), set()).add(i)
    theirs = {}
    for i, r in want.items():
        theirs.setdefault(r, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {r["root"] for r in components.components(edges).collect()} == {0}
    assert components.components(edges.limit(0)).count() == 0


def test_simhash_edges(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "other words in here"), (5, None)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(rows).collect())
    assert got == [(0, 0), (0, 3), (3, 3), (3, 3), (5, 5)]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


# ---------------------------------------------------------------- toxicity
def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_and_trie_find_exactly_the_terms_within_reach():
    rng = random.Random(5)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randint(a, b)))
    for _ in range(60):
        terms, stems = list(dict.fromkeys(word(2, 9) for _ in range(15))), list(dict.fromkeys(word(4, 6) for _ in range(3)))
        lexicon = toxicity.Lexicon(terms, stems)
        for w in (word(1, 10) for _ in range(60)):
            reach = [(edit_distance(t, w), i) for i, t in enumerate(terms) if edit_distance(t, w) <= toxicity.edits_allowed(len(t))]
            reach += [(0, len(terms) + i) for i, s in enumerate(stems) if w.startswith(s)]
            i, edits = lexicon.match(w)
            assert (min(reach) if reach else None) == ((edits, i) if i >= 0 else None)
            assert not reach or lexicon.maybe(w)


def test_toxicity_learns_finds_misspellings_and_spares_quotation(spark):
    rng = random.Random(6)
    clean = [text_of(rng, 60) for _ in range(300)]
    toxic = [" ".join([*t.split()[:20], rng.choice(["nastyword", "vileterm"]), *t.split()[20:40], rng.choice(["nastyword", "vileterm"]), *t.split()[40:]]) for t in clean[:80]]
    every = [*toxic, *clean[80:]]
    labels = spark.createDataFrame([(i, 1, int(i < 80)) for i in range(len(every))], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, every)
    model = toxicity.learn(docs, labels)
    assert {"nastyword", "vileterm"} <= set(model.terms)
    tests = ["x nastywrod y", "so nastywords and vileterrm here", 'he said "nastyword" once', "", None, "calm words only", "nastyword vileterm nastyword"]
    got = {r["doc_id"]: r for r in toxicity.score(documents(spark, tests), model, ["doc_id"]).collect()}
    assert got[1]["predicted"] == got[6]["predicted"] == 1 and [got[i]["predicted"] for i in (2, 3, 4, 5)] == [0] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[3]["score"] == got[4]["score"]
    blank = toxicity.learn(docs, labels.where("toxic = 0"))
    assert toxicity.score(documents(spark, ["a"]), blank, ["doc_id"]).first()["score"] == 0


# ---------------------------------------------------------------- quality
def statistics(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, texts):
    rng = random.Random(8)
    odd = ["\n".join(rng.choice(["a b", "a b ", "", " ", "c|d"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    every = [*texts, *odd, "a b c d e f g h " * 5, "a b\n", "\n", "x" * 100_000]
    rows = quality_rules.text_stats(documents(spark, every), ["doc_id", "n_words"]).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == statistics(every[r["doc_id"]]), every[r["doc_id"]]


def test_decision_list_learns_a_threshold_and_needs_both_kinds(spark):
    rng = random.Random(3)
    every = [text_of(rng, 60) if i % 3 else " ".join(x + "###" for x in text_of(rng, 60).split()) for i in range(600)]
    docs = documents(spark, every)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)], "doc_id bigint, quality int, toxic int")
    rules = quality_rules.learn(docs, labels)
    assert rules.rules
    kept = {r["doc_id"] for r in quality_rules.judge(docs, rules, ["doc_id"]).where("kept").collect()}
    assert kept == {i for i in range(600) if i % 3}
    assert quality_rules.learn(docs, labels.where("quality = 1")).rules == []
    assert quality_rules.learn(docs, labels.limit(0)).rules == []


# ---------------------------------------------------------------- suffix dedup
def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0 if len(x) else np.zeros(0, bool)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(x), int(gone.sum()), spans, bytes(b for b, g in zip(x, gone) if not g)))
    return out


def passages(rng):
    shared = [text_of(rng, 120)[:n] for n in (399, 400, 401, 700, 250)]
    texts = [text_of(rng, 150) for _ in range(30)]
    for i in range(60):
        texts.append(text_of(rng, rng.randint(0, 40)) + rng.choice(shared) + text_of(rng, rng.randint(0, 40)))
    long = text_of(rng, 900)
    texts += [long, long, long[:1500] + "!" + long[1500:], "ab" * 600, "q" * 1000, "q" * 399, "é" * 300, None, "", texts[5], "line of text here\n" * 60]
    return texts


@pytest.mark.parametrize("index_bytes", [2000, 3 << 20])
def test_repeated_strings_go(spark, index_bytes):
    texts = passages(random.Random(13))
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in suffix_dedup.remove(docs, ["doc_id"], index_bytes=index_bytes).collect()}
    for i, (n, gone, spans, kept) in enumerate(removed(texts, 400)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept_bytes"])) == (n, gone, spans, kept), i


@pytest.mark.parametrize("index_bytes", [300, 5000])
def test_hot_passages_and_near_copies_are_cut_finer(spark, index_bytes):
    """One passage a little shorter than the length in most texts, and a group of near copies: many texts at one anchor."""
    rng = random.Random(29)
    common, base = text_of(rng, 30)[:59], text_of(rng, 60)
    texts = [text_of(rng, 12) + common + text_of(rng, 12) for _ in range(60)]
    for _ in range(40):
        at = rng.randrange(len(base))
        texts.append(base[:at] + "#" + base[at + 1 :])
    got = {r["doc_id"]: r for r in suffix_dedup.remove(documents(spark, texts), ["doc_id"], length=64, index_bytes=index_bytes).collect()}
    for i, (n, gone, spans, kept) in enumerate(removed(texts, 64)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept_bytes"])) == (n, gone, spans, kept), i


def test_passages_beside_long_strings(spark):
    rng = random.Random(31)
    words_of = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared, short, long = words_of(53), words_of(45), words_of(200)
    texts = [words_of(30) + " " + x + " " + words_of(30) for x in (shared, shared, short, short, long, long)] + [None, "", words_of(300)]
    docs = documents(spark, texts).withColumn("n_passages", F.lit("clash"))
    both = {r["doc_id"]: r for r in suffix_dedup.remove(docs, ["doc_id", "n_passages"], passage=(200, 51)).collect()}
    alone = {r["doc_id"]: r for r in suffix_dedup.remove(docs, ["doc_id"], length=None, passage=(200, 51)).collect()}
    for i, (n, gone, spans, kept) in enumerate(removed(texts, 400)):
        assert (both[i]["n_bytes"], both[i]["n_removed"], both[i]["n_spans"], bytes(both[i]["kept_bytes"])) == (n, gone, spans, kept), i
        assert [both[i][c] for c in ("n_passages", "passage_bytes", "kept_passages")] == [alone[i][c] for c in ("n_passages", "passage_bytes", "kept_passages")]
    want = removed(texts, 200)
    assert [alone[i]["passage_bytes"] for i in range(9)] == [want[0][1], want[1][1], 0, 0, want[4][1], want[5][1], 0, 0, 0]
    assert shared.encode() not in bytes(alone[0]["kept_passages"]) and bytes(alone[2]["kept_passages"]) == texts[2].encode()


def test_the_query_tells_passages_that_its_strings_do_not_fit_into(spark, tmp_path):
    import __spark_entry__

    rng = random.Random(37)
    words_of = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared, short, long = words_of(53), words_of(45), words_of(90)  # 317, 269 and 539 bytes
    texts = [words_of(30) + f" {x} " + words_of(30) for x in (shared, shared, short, short, long, long)] + [None, words_of(120)]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in __spark_entry__.queries()["op7_suffix_dedup"](spark, str(tmp_path)).collect()}
    for i, (n, gone, spans, kept) in enumerate(removed(texts, 400)):
        want = (n, gone, spans, hashlib.sha256(kept).hexdigest(), kept.decode())
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "text")) == want, i
    assert [got[i]["n_removed"] > 0 for i in range(8)] == [False] * 4 + [True] * 2 + [False] * 2
    assert [got[i]["n_passages"] for i in range(8)] == [1, 1, 0, 0, 1, 1, 0, 0]
    for i, (_, gone, _, kept) in enumerate(removed(texts, 200)):
        if got[i]["n_passages"]:
            assert (got[i]["passage_bytes"], got[i]["text_without_passages"]) == (gone, kept.decode()), i
        else:
            assert (got[i]["passage_bytes"], got[i]["text_without_passages"]) == (0, texts[i] or ""), i


def test_long_strings_are_searched_only_where_all_shorter_ones_repeat(spark):
    """Short passages far apart in a text, as any that shares two with others, gave the second search the whole text."""
    rng = random.Random(43)
    words_of = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    one, two = words_of(53), words_of(53)
    apart = [f"{words_of(30)} {one} {words_of(40)} {two} {words_of(30)}" for _ in range(6)]
    base = words_of(150)
    chained = [base, base[:399] + words_of(30), words_of(30) + base[150:549], words_of(20) + base[300:701] + words_of(9)]
    own = words_of(80)
    texts = [*chained, f"{own} {own}", "é" * 300, "ab" * 450, None, "", base[:400], base[:399]]

    def search(texts):
        named = set(storage._NAMED)
        rows = suffix_dedup.remove(documents(spark, texts), ["doc_id"], passage=(200, 51))
        got = {r["doc_id"]: r for r in rows.collect()}
        for i, (n, gone, spans, kept) in enumerate(removed(texts, 400)):
            assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept_bytes"])) == (n, gone, spans, kept), i
        assert [got[i]["n_passages"] for i in range(len(texts))] == [r["n_passages"] for r in sorted(suffix_dedup.remove(documents(spark, texts), ["doc_id"], length=None, passage=(200, 51)).collect(), key=lambda r: r["doc_id"])]
        (anchors,) = [x for x in storage._NAMED if x not in named and os.path.basename(x).startswith("anchors-")][:1]
        return got, spark.read.parquet(anchors).count()

    got, strings = search(apart)
    assert strings == 0 and all(got[i]["n_passages"] == 2 for i in range(6))
    got, strings = search(texts)
    assert strings > 0 and [got[i]["n_removed"] > 0 for i in range(5)] == [True, False, False, True, True]


def test_suffix_dedup_leaves_no_shuffle_files_and_only_the_tables_of_its_result(spark):
    manager, setting = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffle_files():
        found = manager.getAllFiles()
        return {x for i in range(found.size()) if (x := found.apply(i).getName()).startswith("shuffle_")}

    named, before, own = list(storage._NAMED), shuffle_files(), spark.conf.get(setting)
    texts = passages(random.Random(41))
    rows = suffix_dedup.remove(documents(spark, texts), ["doc_id"], passage=(200, 51))
    until = time.monotonic() + 20  # executors remove files a little later
    while (left := shuffle_files() - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(setting) == own
    mine = [x for x in storage._NAMED if x not in named]
    assert sorted(re.sub("-[0-9a-f]{32}$", "", os.path.basename(x)) for x in mine) == ["anchors", "groups", "matches", "passages", "passages-of-texts"]
    there = set(os.listdir(os.path.dirname(mine[0]).removeprefix("file:")))
    assert all(os.path.basename(x) in there for x in mine)
    assert not [x for x in there if x.startswith(("all-anchors", "repeated-anchors", "long-passages")) and x not in map(os.path.basename, named)]
    got = {r["doc_id"]: r for r in rows.collect()}
    for i, (n, gone, spans, kept) in enumerate(removed(texts, 400)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept_bytes"])) == (n, gone, spans, kept), i


def test_repeated_rows_and_ids(spark):
    rng = random.Random(17)
    a, b = text_of(rng, 200), text_of(rng, 200)
    df = spark.createDataFrame([(1, a), (1, a), (2, b), (2, b[:500] + "#" + b[500:]), (3, text_of(rng, 90))], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_removed"] == r["n_bytes"]) for r in suffix_dedup.remove(df, ["doc_id"]).collect())
    assert got.count((1, True)) == 2 and (3, False) in got and len(got) == 5
    nameless = spark.createDataFrame([(None, a), (None, "x" + a), (7, b)], "doc_id bigint, text string")
    assert sorted(r["n_removed"] for r in suffix_dedup.remove(nameless, ["doc_id"]).collect()) == [0, len(a), len(a)]
    assert suffix_dedup.remove(df.limit(0), ["doc_id"]).count() == 0


def thue_morse(n, first="ab"):
    """A text of two letters and, with the letters changed, another: sums of powers modulo 2 ** 64 cannot tell them apart."""
    return "".join(first[i.bit_count() % 2] for i in range(n))


def test_texts_of_one_hash_stay_apart_in_suffix_dedup(spark):
    rng = random.Random(37)
    passage, other = text_of(rng, 120)[:420], text_of(rng, 120)[:420]
    ids = spark.range(60_000)
    left = ids.select(F.concat("id", F.lit(" " + passage)).alias("x")).select("x", F.hash("x").alias("h"))
    right = ids.select(F.concat("id", F.lit(" " + other)).alias("y")).select("y", F.hash("y").alias("h"))
    pair = left.join(right, "h").orderBy("h").first()
    for own in (None, 5):
        texts = ["start " + passage, pair["x"], pair["y"]]
        df = spark.createDataFrame([(1, texts[0]), (own, texts[1]), (own, texts[2])], "doc_id bigint, text string")
        got = sorted((r["n_bytes"], r["n_removed"], bytes(r["kept_bytes"])) for r in suffix_dedup.remove(df, ["doc_id"]).collect())
        assert got == sorted((n, gone, kept) for n, gone, _, kept in removed(texts, 400))
    texts = [thue_morse(2048), thue_morse(2048, "ba"), "x" + thue_morse(2048)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove(documents(spark, texts), ["doc_id"], length=1500).collect()}
    assert [got[i] for i in range(3)] == [gone for _, gone, _, _ in removed(texts, 1500)]


def test_long_slices_of_one_hash_stay_apart(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [thue_morse(n, x) for n in (1024, 2048, 4096) for x in ("ab", "ba")]
    rows = byte_bpe.encode(documents(spark, texts).coalesce(1), MULTI, round_trip=True).collect()
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]).decode() == texts[r["doc_id"]] for r in rows)
    model = WordBpe(WORDS)
    want = [x.ids for x in model.tokenizer.encode_batch(texts, add_special_tokens=False)]
    folder = token_store.write(documents(spark, texts).coalesce(1), WORDS, end=1)
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == [*want[r["doc_id"]], 1] for r in token_store.read(spark, folder).collect())
    pieces = packing.pack(documents(spark, texts).coalesce(1), WORDS, end=2, with_ids=True).collect()
    for i in range(len(texts)):
        mine = sorted((r["start"], bytes(r["ids"])) for r in pieces if r["doc_id"] == i)
        assert np.frombuffer(b"".join(x for _, x in mine), "<u4").tolist() == [*want[i], 2]


def test_long_matches_equal_those_of_all_statistics():
    """Suffixes in order over several rounds and alphabets; matches under `least` cost no search and change no longer one."""
    rng = random.Random(47)
    some = [bytes(rng.randrange(250) for _ in range(300)), bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(300))]
    for texts in ([b"ab" * 400, b"a" * 700, b"b" + b"ab" * 300], [some[0], some[0][:150] + b"#" + some[0][150:], some[0]], [some[1] * 2, some[1][50:] + b"!", b"x", b""], [b"a"], [b"", b""]):
        whole = b"".join(t + b"\0" for t in texts)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        stop = np.repeat(ends, [len(t) + 1 for t in texts])
        symbols, left = np.frombuffer(whole, np.uint8).astype(np.int64) + 1, stop - np.arange(len(whole))
        symbols[ends] = 0
        want = sorted(range(len(whole)), key=lambda i: (symbols[i : stop[i]].tolist() + [0], i))
        assert suffix_dedup.suffix_order(symbols, left, int(left.max()) + 1).tolist() == want
        index = suffix_dedup.RunLengthIndex(texts)
        statistics = index.matching_statistics()
        for length in (1, 7, 100, 149, 150, 151, 299, 300):
            found = np.zeros(len(whole), bool)
            for text, first, count in zip(*suffix_dedup.RunLengthIndex(texts, length).long_matches(length)):
                found[index.starts[text] + first : index.starts[text] + first + count] = True
            assert found.tolist() == (statistics >= length).tolist(), length


def test_matching_statistics_equal_brute_force():
    rng = random.Random(19)
    for _ in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))).encode() for _ in range(4)]
        index = suffix_dedup.RunLengthIndex(texts)
        got = index.matching_statistics()
        suffixes = [(i, j, t[j:]) for i, t in enumerate(texts) for j in range(len(t))]
        for i, j, s in suffixes:
            want = 0
            for k, m, o in suffixes:
                if (k, m) != (i, j):
                    n = 0
                    while n < min(len(s), len(o)) and s[n] == o[n]:
                        n += 1
                    want = max(want, n)
            assert got[index.starts[i] + j] == want
        assert index.runs <= index.n


# ---------------------------------------------------------------- token files and packing
WORDS = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts, end):
    model = WordBpe(WORDS).tokenizer
    return [[*model.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


@pytest.fixture(scope="module")
def odd_texts(texts):
    return [*texts, "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>", "K\u0301 İ ﬁ\u0085x"]


def test_token_files(spark, odd_texts):
    df = documents(spark, odd_texts).repartition(3)
    folder = token_store.write(df, WORDS, end=1, docs_per_shard=7)
    assert spark.read.parquet(f"{folder}/blocks").select("shard").distinct().count() > 1
    # a new session knows nothing but the folder
    got = {r["doc_id"]: r for r in token_store.read(spark.newSession(), folder).collect()}
    start = 0
    for i, want in enumerate(ids_of(odd_texts, 1)):
        assert (got[i]["start"], got[i]["n_tokens"], np.frombuffer(got[i]["ids"], "<u4").tolist()) == (start, len(want), want)
        start += len(want)
    folder = token_store.write(spark.createDataFrame([(None, "b"), (-5, "a b"), (None, "a"), (-5, "a b")], "doc_id bigint, text string"), WORDS, end=1)
    rows = [(r["doc_id"], r["start"], r["n_tokens"]) for r in token_store.read(spark, folder).orderBy("start").collect()]
    assert rows == [(None, 0, 2), (None, 2, 2), (-5, 4, 3), (-5, 7, 3)]
    folder = token_store.write(df.limit(0), WORDS, end=1)
    assert token_store.read(spark, folder).count() == 0


def test_one_id_that_most_rows_carry_is_dealt_over_shards(spark):
    texts = [f"word{i} " * (i % 7 + 1) for i in range(400)]
    df = spark.createDataFrame([(None if i % 3 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    folder = token_store.write(df, WORDS, end=1, docs_per_shard=50)
    blocks_of = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum(F.length("lengths") / 4).alias("n")).collect()
    assert len(blocks_of) >= 6 and max(r["n"] for r in blocks_of) < 150
    got = token_store.read(spark, folder).orderBy("start").collect()
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in got) == sorted(ids_of(texts, 1))
    assert [r["start"] for r in got] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in got])))[:-1].tolist()


def test_word_ids_shared_across_case_and_marks_equal_the_library():
    rng, model, mine = random.Random(37), WordBpe(WORDS).tokenizer, WordBpe(WORDS)
    letters = ["a", "B", "J", "\u030c", "T", "\u0308", "Σ", "é", "É", "×", "÷", "İ", "\u0307", ".", ",", "!", "'", "'s", "'LL", "9", " ", "\n", "\u0085", "K", "字", "—", "ñ", "ª", ":", ";", "?"]
    for special in ([], ["<|", "|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<", "\u0338"]):
        texts = ["".join(rng.choice(letters + special) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
        for at, offsets, data in blocks(pa.array(texts)):
            ids, bounds = mine.encode_block(offsets, data)
            for i, text in enumerate(texts[at : at + len(offsets) - 1]):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_variable_length_coding_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_store.pack(ranks)
        assert len(control) == -(-n // 4) and (token_store.unpack(control, data, n) == ranks).all()


@pytest.mark.parametrize("parts", [1, 5])
def test_packing(spark, odd_texts, parts):
    df = documents(spark, odd_texts).repartition(parts)
    rows = packing.pack(df, WORDS, end=2, length=256, windows=4, with_ids=True).toPandas()
    for i, want in enumerate(ids_of(odd_texts, 2)):
        own = rows[rows["doc_id"] == i].sort_values("start")
        at = 0
        for r in own.itertuples():
            part = np.array(want[r.start : r.start + r.length], "<u4").tobytes()
            assert r.start == at and r.ids_crc32 == zlib.crc32(part) and bytes(r.ids) == part and r.doc_tokens == len(want)
            at += r.length
        assert at == len(want)
    full = 0
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1].tolist()]
        size = int(s["length"].sum())
        assert size & (size - 1) == 0 and size <= 256
        full += size == 256
    assert full >= rows["length"].sum() // 256 - 1
    assert packing.pack(df.limit(0), WORDS, end=2).count() == 0


def test_merging_in_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 2)
    df = documents(spark, [text_of(random.Random(i), 30) for i in range(60)]).repartition(9)
    rows = packing.pack(df, WORDS, end=2, length=128, windows=2).toPandas()
    sizes = rows.groupby("sequence_id")["length"].sum()
    assert all(n & (n - 1) == 0 for n in sizes) and (sizes < 128).sum() <= 7


# ---------------------------------------------------------------- neighbours
def vectors(rng, n, dim=16):
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(0, 8, n)] + 0.3 * rng.normal(size=(n, dim))
    x[n // 2 : n // 2 + n // 3] = x[0]  # a vector that a third of all rows hold
    return x.astype(np.float32)


@pytest.mark.parametrize("factor", [1.0, 1.2])
def test_neighbours(spark, factor):
    x = vectors(np.random.default_rng(3), 900)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [1.0, None] * 8), (980, []), (1000, [1.0, 2.0]), (1020, [float("inf")] * 16)]
    df = spark.createDataFrame([*rows, *bad], "vec_id bigint, embedding array<float>")
    got = nearest.search(df, F.col("vec_id") % 20 == 0, k=20, factor=factor, shard_rows=300).toPandas()
    wide = x.astype(float)
    right = total = 0
    for q in range(0, 900, 20):
        score = wide @ wide[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(900), -np.round(score, 9)))[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine["score"], score[mine["vec_id"]], rtol=0, atol=1e-12)
        right += len(set(best.tolist()) & set(mine["vec_id"].tolist()))
        total += 20
    assert right == total if factor == 1 else right >= 0.9 * total
    assert set(got["query_id"]) == set(range(0, 900, 20))
    assert nearest.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("shard_rows", [150, 5000])
def test_neighbours_with_equal_scores(spark, shard_rows):
    """Small whole numbers: many different vectors have the same product, and the smaller id goes first."""
    x = np.random.default_rng(5).integers(-2, 3, (600, 8))
    x[x.any(axis=1) == 0] = 1
    df = spark.createDataFrame([(i, [float(v) for v in r], "clash", 1) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>, query_id string, rank int")
    got = nearest.search(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=shard_rows).orderBy("query_id", "rank").collect()
    want = []
    for q in range(0, 600, 20):
        best = sorted((-int(x[i] @ x[q]), i) for i in range(600) if i != q)[:20]
        want += [(q, r + 1, i, float(-s)) for r, (s, i) in enumerate(best)]
    assert [tuple(r) for r in got] == want


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(23)
    passage = text_of(rng, 120, "abcdefghijklmnop")
    texts = [text_of(rng, 150, "abcdefghijklmnop") for _ in range(60)]
    texts += [texts[0], texts[1] + " end", texts[2] + "\n" + passage, texts[3] + "\n" + passage, "few words", None, "### " * 100]
    documents(spark, texts).drop("ids", "n_words").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.toPandas()
        if name != names[-1]:
            assert docs.columns == corpus_pipeline.COLUMNS
            docs.write.parquet(str(tmp_path / f"{len(seen)}.parquet"))
            docs = spark.read.parquet(str(tmp_path / f"{len(seen)}.parquet"))
    assert set(seen[names[0]]["doc_id"]) == set(range(64))
    assert set(seen[names[1]]["doc_id"]) == set(range(64))
    kept = set(seen[names[2]]["doc_id"])
    want = {i for i, r in classes([fingerprint(t) for t in texts[:64]]).items() if i == r}
    assert kept == want
    after = seen[names[3]].set_index("doc_id")["text"]
    order = sorted(kept)
    for i, (_, _, _, left) in zip(order, removed([texts[i] for i in order], 200)):  # the passage is the only repeat, and has over 50 words
        assert after[i] == left.decode("utf-8", "replace")
    assert seen[names[4]]["length"].sum() == sum(len(x) for x in ids_of([after[i] for i in order], 2))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[names[4]])


def test_contract_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def set_of(text):
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_of_the_pipeline_equal_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(31)
    texts = []
    for _ in range(60):
        base = text_of(rng, rng.randint(30, 400), "abcdefghijklmnop").split()
        for share in (0.0, 0.005, 0.01, 0.02, 0.03, 0.06):
            texts.append(" ".join(text_of(rng, 1, "qrstuv") if rng.random() < share else w for w in base))
    rng.shuffle(texts)
    every = [set_of(t) for t in texts]
    root = list(range(len(texts)))
    far = 0  # near copies that three bits of three-word fingerprints do not link
    for b in range(len(texts)):
        for a in range(b):
            if jaccard(every[a], every[b]) >= 0.8:
                far += bin(fingerprint(texts[a]) ^ fingerprint(texts[b])).count("1") > 3
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert far > 20
    docs = documents(spark, texts).drop("ids", "n_words")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root))
    assert all(r["text"] == texts[r["doc_id"]] for r in kept)


@pytest.mark.parametrize(("cluster_sets", "pivots"), [(1, (2, 4)), (4, (3, 3))])
def test_clusters_too_large_for_a_task_equal_brute_force(spark, cluster_sets, pivots):
    """Chains of edits, where a text is near its neighbours only, and many edits of one text, through pivots and bands."""
    from timeloom.llm import near_copies

    rng = random.Random(41)
    texts = []
    for _ in range(3):
        words_now = text_of(rng, 80, "abcdefghijklmnop").split()
        for _ in range(12):
            texts.append(" ".join(words_now))
            for _ in range(rng.randint(1, 2)):
                words_now[rng.randrange(len(words_now))] = text_of(rng, 1, "qrstuv")
        for _ in range(12):
            texts.append(" ".join(text_of(rng, 1, "qrstuv") if rng.random() < 0.01 else w for w in words_now))
    rng.shuffle(texts)
    every, root = [set_of(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if jaccard(every[a], every[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    docs = documents(spark, texts).drop("ids", "n_words")
    kept = near_copies.keep_first(docs, docs.columns, cluster_sets=cluster_sets, pivots=pivots).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root))


def test_large_clusters_of_near_copies():
    from timeloom.llm import near_copies

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(300)]
    near = [np.array(sorted(set(base[:i] + base[i + 1 :])), np.uint64) for i in range(40)]
    other = [np.array(sorted(rng.getrandbits(64) for _ in range(300)), np.uint64) for _ in range(20)]
    found = near_copies.confirmed(near + other)
    assert len(found) == 39 and max(max(x) for x in found) < 40


def test_rows_without_an_id_or_with_a_repeated_one_in_the_near_dup_stage(spark):
    import corpus_pipeline

    rng = random.Random(37)
    a, b, c, d, e = (text_of(rng, 150, "abcdefghijklmnop") for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, b + " end"), (2, c), (2, d), (2, d), (3, c), (None, e), (None, e + " end"), (4, None), (None, "")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], DOCS)
    kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    assert len(kept) == 6 and kept[0][0] == 0 and {k[1] for k in kept if not k[0]} in ({a, e}, {a, e + " end"})
    assert kept[2:] == sorted([(1, b + " end"), (2, c), (2, d), (4, "")])
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_words_under_a_stem_still_match_misspelled():
    counts = [(w, False, 40, 0) for w in ("nastyword", "nastyones", "nastytalk")] + [("nasty", True, 120, 0)]
    terms, stems = toxicity.lexicon_of(counts, 150, 850)
    assert stems == ["nasty"] and set(terms) == {"nastyword", "nastyones", "nastytalk"}
    lexicon = toxicity.Lexicon(terms, stems)
    for word, edits in (("nastywords", 0), ("nstyword", 1), ("nasytalk", 1), ("nastyword", 0)):
        found, n = lexicon.match(word)
        assert lexicon.maybe(word) and found >= 0 and n == edits


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    ids = [20 if i < 60 else 40 if i < 64 else i + 100 for i in range(400)]
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in zip(ids, x)]
    rows += [(60, rows[100][1])] * 30 + [(61, rows[100][1])] * 30  # one vector, ids that repeat over k times
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = nearest.search(df, F.col("vec_id").isin(20, 40, 60), k=20, shard_rows=1000).toPandas()
    for q in (20, 40, 60):
        pairs = [(-sum(a * b for a, b in zip(u, v)), i) for j, u in rows if j == q for i, v in rows if i != q]
        want = sorted((round(s, 9), i) for s, i in pairs)[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and mine["vec_id"].tolist() == [i for _, i in want]


def test_one_id_of_many_rows_is_one_labelled_row(spark):
    """What comes to the driver is bounded by the sample's ids, not by the rows that carry them."""
    from timeloom.llm.common import one_text_each

    docs = spark.range(5000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, None), (3, "c")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1)], "doc_id bigint, toxic int")
    assert sorted(map(tuple, one_text_each(docs, labels, "toxic").collect())) == [(1, "text 0", 1), (2, None, 0)]


def test_the_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
