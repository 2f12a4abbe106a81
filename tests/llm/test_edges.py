"""Empty tables, clashing names and repeated rows, and verdicts against brute force."""

import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from timeloom.llm import byte_bpe, language, quality_rules, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(rng, n, letters):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


def grams(text):
    """N-grams of one to three characters of each run of letters with a mark (0x5f) at both ends, as places of code points."""
    found, run = Counter(), []
    for c in [*text, " "]:
        if c.isalpha():
            run.append(ord(c.lower()))
            continue
        if run:
            padded = [0x5F, *run, 0x5F]
            found.update((0, 0, x) for x in run)
            found.update((0, a, b) for a, b in zip(padded, padded[1:]))
            found.update(zip(padded, padded[1:], padded[2:]))
        run = []
    return found


def places(counts):
    order = sorted(counts, key=lambda g: (-counts[g], g))[: language.PROFILE]
    return {g: i for i, g in enumerate(order)}


def test_language_distances_equal_brute_force(spark):
    rng = random.Random(41)
    kinds = {"aa": "abcdeilm", "bb": "bdkrtzéo", "cc": "aeiouñlç"}
    rows = [(i, words_of(rng, rng.randint(3, 60), kinds[k]), k, "s", 0) for i, k in enumerate(list(kinds) * 12)]
    docs = spark.createDataFrame([*rows, rows[0], (99, "12 !", "aa", "s", 0)], DOCS).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(-1))
    totals = {k: Counter() for k in kinds}
    for _, text, k, _, _ in [*rows, rows[0]]:
        totals[k].update(grams(text))
    profiles = {k: places(c) for k, c in totals.items()}
    got = language.identify(docs, language.learn(docs), ["doc_id", "lang_pred", "score"]).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] == 99:
            assert (r["lang_pred"], r["score"], r["distance"]) == ("und", 0.0, None)
            continue
        mine = places(grams(rows[r["doc_id"]][1]))
        far = {k: sum(abs(i - p[g]) if g in p else language.PROFILE for g, i in mine.items()) / (len(mine) * language.PROFILE) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert r["lang_pred"] == best and abs(r["distance"] - far[best]) < 1e-12
    assert language.identify(docs.limit(0), language.Profiles(), ["doc_id"]).count() == 0


def test_byte_bpe_of_an_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert byte_bpe.encode(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), round_trip=True).count() == 0


def test_quality_verdicts_equal_the_rules(spark):
    rng = random.Random(43)
    rows = [(i, words_of(rng, rng.randint(1, 60), "abcdefg#12")) for i in range(80)]
    rows += [rows[0], rows[0], (80, None), (81, ""), (82, "x " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"kept": F.lit("clash"), "n_words": F.lit(-5)})
    rules = quality_rules.DecisionList([[quality_rules.Condition("symbols_per_word", True, 0.4), quality_rules.Condition("n_words", False, 40.0)], [quality_rules.Condition("digit_share", True, 0.22)]])
    got = quality_rules.judge(docs, rules, ["doc_id", "n_words"]).collect()
    assert len(got) == len(rows) and len([r for r in got if r["doc_id"] == 0]) == 3
    texts = dict(rows)
    for r in got:
        words = (texts[r["doc_id"]] or "").split()
        n, chars = max(len(words), 1), max(sum(map(len, words)), 1)
        symbols, digits = (sum(c in kind for w in words for c in w) for kind in ("#*$%&|<>", "0123456789"))
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        first = 1 if symbols / n >= 0.4 and len(words) < 40 else 2 if digits / chars >= 0.22 else 0
        assert (r["n_words"], r["base_failed"], r["rule"], r["kept"]) == (len(words), failed, first, not failed and first == 0)
    assert quality_rules.judge(docs.limit(0), rules, ["doc_id"]).count() == 0


def test_toxicity_of_odd_tables(spark):
    rng = random.Random(47)
    rows = [(i, words_of(rng, 30, "abcdefg") + (" zurgle wibbet" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame([*rows, rows[4], rows[4], (300, None), (301, "")], "doc_id bigint, text string").withColumns({"score": F.lit("clash"), "predicted": F.lit(9)})
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model, ["doc_id", "score"]).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["doc_id"] < 200)
    assert {r["predicted"] for r in got if r["doc_id"] >= 300} == {0}
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0
    nothing = toxicity.learn(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs, nothing, ["doc_id"]).count() == len(rows) + 4


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_the_gate_before_the_automata_lets_every_match_through():
    rng = random.Random(43)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    for _ in range(40):
        terms, stems = list(dict.fromkeys(word(rng.randint(2, 8)) for _ in range(12))), [word(4)]
        lexicon = toxicity.Lexicon(terms, stems)
        for _ in range(200):
            x = word(rng.randint(1, 9))
            fits = [(edits(x, t), k) for k, t in enumerate(terms) if edits(x, t) <= toxicity.edits_allowed(len(t))]
            fits += [(0, len(terms) + k) for k, s in enumerate(stems) if x.startswith(s)]
            best = min(fits, default=None)
            assert lexicon.match(x) == ((best[1], best[0]) if best else (-1, 0))
            assert not best or lexicon.maybe(x)


def test_a_lexicon_holds_all_terms_that_reach_the_ratio():
    counts = [(f"term{i}x", False, 40, 0) for i in range(3000)] + [("termsome", True, 500, 0), ("rare", False, 2, 0), ("usual", False, 30, 60)]
    terms, stems = toxicity.lexicon_of(counts, 5000, 5000)
    assert len(terms) == 3000 and "usual" not in terms and stems == []
    assert toxicity.lexicon_of([*counts, ("term", True, 900, 10)], 5000, 5000)[1] == ["term"]
