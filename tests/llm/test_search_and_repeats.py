"""Source divergence, ranked lexical search and substring dedup against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadweave.llm import divergence, lexical_search, repeats
from leadweave.llm.divergence import source_divergence
from leadweave.llm.lexical_search import Best, group_masks, ranked_search, search_block
from leadweave.llm.repeats import maximal_spans, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ["_id", "_hash", "_text", "_bytes", "_item", "anchor", "starts", "term", "score", "rank", "n_words", "value", "part", "item", "prefix", "n"]


def clashing(frame):
    return frame.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


def plain(rows):
    return Counter(map(tuple, rows))


# Source divergence -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sourced():
    rng = random.Random(3)
    words = ["Ab", "abc", "abcd", "abcdefgh", "abcdefghi", "Éa", "éa", "日本", "日本語", "z" * 40, "z" * 41, "z" * 300, "x9y", "Q"] + ["w" + "ab"[k % 2] * (k % 9) + chr(97 + k) for k in range(20)]
    rows = []
    for i in range(160):
        text = rng.choice([" ", "1", "\n", "."]).join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(25)))
        rows.append((i, text, rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "a", "b", "Ä", None])))
    rows += [(500, None, "en", "empty"), (501, "", "de", "lonely"), (502, "only twice only", "de", "other"), (None, "ab abc", "en", "a")] + [rows[5], rows[5]]
    return rows


def brute_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter() for lg, s, _ in docs if lg == lang}
        for lg, s, terms in docs:
            if lg == lang:
                counts[s].update(t for t in terms if t in kept)
        rate = lambda c: {t: 1 + (10**9 * (c[t] + 2)) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        whole = rate(sum(counts.values(), Counter()))
        rates = {s: rate(c) for s, c in counts.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in counts:
            pairs = sorted(((-sum(f(rates[s][t], rates[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            terms = sorted((-f(rates[s][t], whole[t]), t.encode()) for t in kept if counts[s][t] and rates[s][t] > whole[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms, 1)]
    return Counter(out)


@pytest.mark.parametrize(("least", "top", "small"), [(10, 10, False), (2, 3, True)])
def test_divergence(spark, sourced, monkeypatch, least, top, small):
    if small:  # several parts, blocks and tiles
        for name, value in (("BLOCK_TERMS", 5), ("TILE", 2), ("PART_BYTES", 300), ("MOST_SUMS", 50)):
            monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(sourced, SCHEMA).repartition(3)
    assert plain(source_divergence(docs, least, top).collect()) == brute_divergence(sourced, least, top)


def test_divergence_empty_and_clashing(spark, sourced):
    docs = spark.createDataFrame(sourced, SCHEMA)
    assert plain(source_divergence(clashing(docs)).collect()) == brute_divergence(sourced, 10, 10)
    assert source_divergence(docs.limit(0)).collect() == []


def test_prefix_codes_tell_prefixes_apart():
    terms = divergence.Terms([b"abcdefgh abcdefghi", b"", b"abcdefgh ABCDEFGHIJKLMNOPQ abcdefghijklmnopq", b"a\xc3\xa9"])
    everything = np.arange(len(terms.start))
    for limit in (1, 4, 8, 9, 12, None):
        code, some = terms.codes(everything, np.zeros(len(everything), np.int64), limit)
        prefix = terms.prefixes(everything, limit)
        assert all((prefix[i] == prefix[j]) == (code[i] == code[j]) for i in everything for j in everything)
        assert terms.prefixes(some, limit) == [prefix[int(np.flatnonzero(code == c)[0])] for c in range(len(some))]
    assert terms.doc.tolist() == [0, 0, 2, 2, 2, 3]


# Ranked lexical search -------------------------------------------------------------------------------

def brute_search(rows, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    docs = [(i, Counter(words(t))) for i, t in rows]
    docs = [d for d in docs if d[1]]
    count, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(words(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, n, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(150)] + ["É1", "日本", "Ab"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "w1 " * 4000), (None, "w1 w2"), (None, "w1 w2"), (903, "-- !"), rows[7], rows[7]]
    items = [(n, " ".join(rng.choices(words, k=rng.randrange(1, 90)))) for n in range(12)] + [(50, None), (51, "unseen"), (3, "W5 extra"), (None, "w1 w2"), (60, "w1"), (60, "w1")]
    return rows, items


@pytest.mark.parametrize("block", [4096, 17])
def test_search(spark, searched, monkeypatch, block):
    rows, items = searched
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert plain(ranked_search(docs, queries, 10).collect()) == brute_search(rows, items, 10)
    monkeypatch.setattr(lexical_search, "PART_BYTES", 200)  # the query set in several parts
    assert plain(ranked_search(docs, queries, 3).collect()) == brute_search(rows, items, 3)


def test_search_empty_and_clashing(spark, searched):
    rows, items = searched
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert plain(ranked_search(clashing(docs), clashing(queries)).collect()) == brute_search(rows, items, 10)
    assert ranked_search(docs.limit(0), queries).collect() == [] and ranked_search(docs, queries.limit(0)).collect() == []


def test_masks_and_safe_stop():
    rng = np.random.default_rng(4)
    present = rng.random((130, 400)) < 0.02  # masks of more than two words
    masks, group = group_masks(present)
    assert (masks[group] == present.T).all() and len({m.tobytes() for m in masks}) == len(masks)
    worth = present * rng.integers(1, 1000, present.shape)
    ids, nulls, best = np.arange(400), np.zeros(400, bool), Best(10)
    evaluated = search_block(best, present, worth, ids, nulls)
    order = np.lexsort((ids, -worth.sum(axis=0)))[:10]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == worth.sum(axis=0)[order].tolist()
    assert evaluated < 400 and search_block(best, present[:, :5] & False, worth[:, :5] * 0, ids[:5], nulls[:5]) == 0


# Substring dedup -------------------------------------------------------------------------------------

def brute_repeats(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = [math.inf if i is None else i for i, _ in rows]
    lowest = {}
    for i, w in zip(order, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            lowest[key] = min(lowest.get(key, math.inf), i)
    out = []
    for (i, _), o, w in zip(rows, order, words):
        gone = {p for k in range(len(w) - window + 1) if lowest[tuple(w[k : k + window])] < o for p in range(k, k + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(6)
    some = lambda n: [rng.choice(["la", "Si", "mu", "é", "日", "x-1", "Q."]) + str(rng.randrange(9)) for _ in range(n)]
    shared = [some(n) for n in (12, 13, 14, 20, 60, 200)]
    rows = [(7, None), (8, ""), (9, " \n"), (10, "short text"), (11, " ".join(["same"] * 300)), (12, "\t".join(["same"] * 13)), (13, " ".join(["same"] * 12)), (None, " ".join(shared[4])), (None, " ".join(some(30)))]
    for i in range(60):
        parts = [some(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(shared), some(rng.randrange(3))]
        rows.append((100 + i * 7 % 60, rng.choice([" ", "\n", "  "]).join(sum(parts, []))))
    rows += [rows[12], rows[12], (rows[12][0], " ".join(shared[5] + some(5))), (5, rows[20][1]), (3000, rows[20][1]), (4000, " ".join(some(20_000) + shared[3]))]
    return rows


@pytest.mark.parametrize(("window", "small"), [(13, False), (6, True), (25, True)])
def test_substring_dedup(spark, passages, monkeypatch, window, small):
    if small:
        monkeypatch.setattr(repeats, "PART_WORDS", 100)
    docs = spark.createDataFrame(passages, "doc_id long, text string").repartition(4)
    got = substring_dedup(docs, window, with_text=True).collect()
    assert plain([r[:4] for r in got]) == brute_repeats(passages, window)
    for r in got:
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"]
        assert all(a["end"] < b["first"] for a, b in zip(r["spans"], r["spans"][1:]))
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_substring_dedup_crowded_bits(spark, passages, monkeypatch):
    monkeypatch.setattr(repeats, "BITS", 16)  # bits shared by many anchors change nothing
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    assert plain(substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute_repeats(passages, 13)


def test_substring_dedup_empty_and_clashing(spark, passages):
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    assert plain(substring_dedup(clashing(docs)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute_repeats(passages, 13)
    assert substring_dedup(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        substring_dedup(docs, 4)


def test_word_hashes_of_odd_texts(monkeypatch):
    """Words of any length, at any place of a text, have one hash each; texts are cut between words only."""
    monkeypatch.setattr(repeats, "PART_BYTES", 40)
    rng = random.Random(8)
    long = ["x" * n for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 200, 9000)] + ["y" + "x" * n for n in (7, 63, 64, 8999)] + ["é日", "\x00", "a\x00", "a\x00\x00", "\x1f", "\u00a0"]
    texts = ["", " ", "\n a\t", "x" * 5000, *("".join(rng.choice(long) + rng.choice(" \t\n\x0b\x0c\r") * rng.randrange(1, 3) for _ in range(rng.randrange(60))) for _ in range(40)), " z", ""]
    texts = [t.encode() for t in texts]
    found, known = list(repeats.hashed_words(pa.array(texts, pa.binary()))), {}
    assert [row for row, _ in found] == list(range(len(texts)))
    for text, (_, hashes) in zip(texts, found, strict=True):
        assert len(text.split()) == len(hashes)
        assert all(known.setdefault(w, h) == h for w, h in zip(text.split(), hashes.tolist(), strict=True))
    assert len(set(known.values())) == len(known) > 20


def test_words_are_hashed_without_a_python_step_each(monkeypatch):
    """Words are hashed many at a time (F1 of round 3): distinct ones, of which a cache would hold few, call no hash of their own."""
    calls, digest = [], repeats.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(repeats.xxhash, "xxh3_64_intdigest", lambda word: calls.append(1) or digest(word))
    texts = pa.array([" ".join(f"word{i}" for i in range(k, k + 500)).encode() for k in range(0, 20_000, 500)], pa.binary())
    assert sum(len(words) for _, words in repeats.hashed_words(texts)) == 20_000 and not calls


def test_only_anchors_with_several_extents_send_windows(spark, monkeypatch):
    """Copies alone are settled by the join (F1 of round 3): no window of theirs is compared, and the result is that of the brute force."""
    rng, staged, real = random.Random(5), {}, repeats.stage

    def kept(df, name):
        staged[name] = real(df, name)
        return staged[name]

    monkeypatch.setattr(repeats, "stage", kept)
    some = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    copies = [some(40) for _ in range(5)]
    rows = [(i, copies[i % 5]) for i in range(20)] + [(None, copies[0]), (3, copies[3]), (30, some(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute_repeats(rows, 13)
    assert staged["extents"].count() == 0 and staged["seeds"].where("windows IS NOT NULL").count() == 0 < staged["seeds"].count()
    mixed = spark.createDataFrame([*rows, (31, some(10) + " " + copies[0][:90] + " " + some(10))], "doc_id long, text string")
    substring_dedup(mixed).collect()
    assert staged["extents"].count() > 0


def test_spans_and_anchors():
    first, end = maximal_spans(np.array([30, 1, 2, 15, 1, 28]), 13)
    assert list(zip(first.tolist(), end.tolist())) == [(1, 43)]
    words = np.random.default_rng(1).integers(0, 5, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    best, at = repeats.anchors(words, 13)
    again, places = repeats.anchors(words[40:90], 13)
    assert (np.diff(at) >= 0).all() and (best[40 : 40 + len(again)] == again).all() and (at[40 : 40 + len(again)] == places + 40).all()


def test_exact_dedup_sorts_in_every_round(spark):
    from leadweave.llm.exact_dedup import merged_runs, text_digests

    docs = spark.createDataFrame([(i, f"t{i % 5}") for i in range(50)], "doc_id long, text string").repartition(8)
    merged = merged_runs(text_digests(docs), "doc_id", rounds=3)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") >= 5 and len(re.findall(r"\bSort \[_run", plan)) >= 5 and "HashAggregate" not in plan
    assert sorted((r["keep_id"], r["group_size"]) for r in merged.collect()) == [(45 + k, 10) for k in range(5)]


def test_toxicity_shuffles_no_text_below_its_bits(spark, monkeypatch):
    from leadweave.llm import toxicity

    staged = []
    plain_stage = toxicity.stage
    monkeypatch.setattr(toxicity, "stage", lambda df, name: staged.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or plain_stage(df, name))
    rows = [(i, "bad awful words" if i % 5 == 0 else "good words") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    toxicity.fit_toxicity(docs, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int"))
    plans = dict(staged)
    assert "LeftSemi" not in plans["maybe-confirmed"] and "LeftSemi" in plans["confirmed"] and "_place" not in plans["confirmed"]


def test_quality_takes_the_lowest_of_conflicting_labels(spark):
    from leadweave.llm.quality import score_quality

    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["ka", "lo", "mi."] if k % 4 else ["|", "??", "1"]) for _ in range(30)), f"h{k % 3}", "p") for k in range(120)]
    rows += [rows[3], (3, "another text", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    plain_labels = [(k, int(k % 4 > 0)) for k in range(120)]
    lowest = [(k, 0 if k % 5 == 0 else v) for k, v in plain_labels]
    score = lambda d, pairs: sorted((r["doc_id"], round(r["score"], 9)) for r in score_quality(d, spark.createDataFrame(pairs, "doc_id long, quality int")).collect())
    wanted = score(docs, lowest)
    assert score(docs, [*plain_labels, *[(k, 0) for k in range(0, 120, 5)], (7, None), (None, 1)]) == wanted and len(wanted) == 122
    extra = docs.select("*", *[F.lit("own").alias(n) for n in ("_host", "_path", "_x", "_y", "_salt", "evidence", "score")])
    assert score(extra, lowest) == wanted
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert score_quality(docs.limit(0), empty).collect() == [] and score_quality(docs, empty).count() == 122


def test_gradients_leave_out_the_lead(spark):
    from leadweave.llm import lm

    rng = np.random.default_rng(5)
    model = lm.new_model(np.zeros(lm.CLASSES, np.float32))
    rows, target = rng.integers(-1, 60, (9, lm.WINDOW)), rng.integers(-1, 20, (9, lm.WINDOW))
    rows[:, lm.LEAD :] = abs(rows[:, lm.LEAD :])
    target[:, : lm.LEAD] = -1
    whole, short = lm.gradients(model, rows, target), lm.gradients(model, rows, target, lm.LEAD)
    assert whole[0] == pytest.approx(short[0], rel=1e-5)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole[1], short[1], strict=True))


def test_texts_are_encoded_once_for_training_and_scoring(spark, monkeypatch):
    """Training and scoring read the ids of one pass over the texts; ids, rounds, frequent and other words are those of each text."""
    import public_tokenizers

    from leadweave.llm import lm
    from leadweave.llm.common import fold_of, lower_words

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = [None, "", "The cat", "the cat the dog \u00e9t\u00e9", "x" * 300, "a b c " * 40, "the cat"] * 3
    docs = spark.createDataFrame([(i if i % 8 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(lm, "HOT_WORDS", 3)
    made, encode = [], lm.encode_texts
    monkeypatch.setattr(lm, "encode_texts", lambda *args: made.append(encode(*args)) or made[-1])
    got = lm.score_held_out(docs, path, pattern).collect()
    assert len(made) == 1 and "text" not in made[0].columns and len(got) == len(texts)
    subwords = lm.Subwords(path, pattern)
    found = Counter((r["doc_id"], tuple(lm.unpack_ids(r["_ids"], subwords.end).tolist()), r["n_tokens"], r["_turn"] is None) for r in made[0].collect())
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", (fold_of(F.col("doc_id"), 7) == 2).alias("h")).collect()}
    expected = Counter()
    for i, t in enumerate(texts):
        words = lower_words((t or "").encode())
        expected[(i if i % 8 else None, tuple(subwords.ids(words).tolist()), len(words) + 1, held[i if i % 8 else None])] += 1
    assert found == expected and {r["_turn"] for r in made[0].collect()} <= {None, *range(lm.ROUNDS)} and any(held.values())
    assert all(lm.unpack_ids(lm.pack_ids(np.arange(9), end), end).tolist() == list(range(9)) for end in (50_256, 70_000))
