"""Corpus operators against brute force, round trips and hand-made edge cases."""

import collections
import hashlib
import html
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from affinia.llm import chat, common, components, decontaminate, encode, html_text, language, near_dups, packing, pii, quality, token_counts, token_store
from affinia.llm.queries import ORACLES, QUERIES
from tests.compare import assert_same

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = common.tokenizer_path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"
#: Null, empty, blank, one word, long without a space, repeated rows, ties.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "x" * 200_000), (6, "same words here and there " * 30), (7, "same words here and there " * 30), (7, "same words here and there " * 30), (8, "Ünïcödé ﬁn \U0001f600 done")]


def frame(spark, data, schema=DOCS):
    return spark.createDataFrame(data, schema)


def documents(spark, folder):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, tables, name):
    assert_same(QUERIES[name](spark, tables[0]), tables[1].sql(ORACLES[name]))


# ---- 1 token counts


def greedy(text, pieces):
    n = at = 0
    while at < len(text):
        k = next((k for k in range(len(text), at, -1) if text[at:k] in pieces), 0)
        n, at = (n + 1, k) if k else (n + len(text[at].encode()), at + 1)
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.text("abcé", max_size=30))
def test_longest_match(pieces, text):
    assert token_counts.LongestMatch(pieces).count(text) == greedy(text, pieces)


def test_token_counts(spark, tables):
    pieces = set(token_counts.vocabulary(common.tokenizer_path("piece_bpe_32k.model")))
    docs = documents(spark, tables[0])
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op1_token_counts"](spark, tables[0]).collect()}
    words = {w: greedy("▁" + w, pieces) for _, text in docs for w in set(text.split())}
    for i, text in docs:
        assert got[i] == (len(text.split()), sum(words[w] for w in text.split()), len(text))
    longest = " ".join(rng_word for rng_word in (random.Random(5).choices("abcdefgh", k=9)))
    more = token_counts.count_tokens(frame(spark, [(1, "hello " * 300_000, 3), (None, longest, 4)], DOCS + ", n_tokens int")).collect()
    assert more[0].n_tokens == 300_000 * greedy("▁hello", pieces) and more[1].n_tokens == sum(greedy("▁" + w, pieces) for w in longest.split())
    assert token_counts.count_tokens(frame(spark, [])).count() == 0
    edge = token_counts.count_tokens(frame(spark, EDGES)).collect()
    assert [tuple(r)[1:] for r in edge[:3]] == [(0, 0, 0), (0, 0, 0), (0, 0, 4)] and len(edge) == len(EDGES)


# ---- 2 quality


def base_counts(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search("[^\\x20\\x09-\\x0D]", line):
            lines += line in seen
            seen.add(line)
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {k + j for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def test_quality(spark, tables):
    rows = {r[0]: r for r in QUERIES["op2_quality_rules"](spark, tables[0]).collect()}
    for i, text in documents(spark, tables[0]):
        assert tuple(rows[i])[1:7] == base_counts(text)
    own = [(k, "good words of a clean text stand here " * 3 + f"number {k} " + " ".join(f"w{j}" for j in range(60))) for k in range(40)]
    bad = [(100 + k, " ".join(f"zq{j * k}%%%" for j in range(80))) for k in range(3)]
    got = {r.doc_id: r for r in quality.quality_rules(frame(spark, own + bad), frame(spark, [(k,) for k in range(40)], "doc_id long")).collect()}
    assert all(not got[100 + k].kept for k in range(3)) and sum(got[k].kept for k in range(40)) >= 38
    edge = quality.quality_rules(frame(spark, EDGES), frame(spark, [(1,)], "doc_id long")).collect()
    assert [tuple(r)[1:7] for r in edge] == [base_counts(t or "") for _, t in EDGES]
    assert quality.quality_rules(frame(spark, []), frame(spark, [], "doc_id long")).count() == 0


def test_quality_verdict(spark):
    """Scores and verdicts against the ratio worked out by hand: words and pairs of words hashed, all documents
    against the first half of the trusted ones, the threshold from the other half."""
    import xxhash

    rng = random.Random(7)
    docs = [(k, " ".join(rng.choice(["good", "clean", "fine", "text"] if k < 30 else ["bad", "junk", "text", "zq"]) + str(rng.randrange(40)) for _ in range(60 + k))) for k in range(60)] + [(61, None), (5, "x")]
    got = sorted((tuple(r) for r in quality.quality_rules(frame(spark, [(*d, 1.0, 2) for d in docs], DOCS + ", score double, bucket int"), frame(spark, [(k,) for k in range(30)] + [(3,)], "doc_id long"), buckets=1 << 10, keep_share=0.9).collect()), key=str)
    order = {r.doc_id: k for k, r in enumerate(frame(spark, [(k,) for k in range(30)], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect())}
    mask = (1 << 64) - 1

    def grams(text):
        own = [xxhash.xxh3_64_intdigest(w.encode()) for w in (text or "").split()]
        mix = lambda x: (x * 0x9E3779B97F4A7C15 & mask) >> 54
        return [mix(x) for x in own] + [mix(3 * a + b & mask) for a, b in zip(own, own[1:])]

    raw, target = collections.Counter(), collections.Counter()
    for i, text in docs:
        raw.update(grams(text))
        if i in order and order[i] % 2 == 0:
            target.update(grams(text))
    a, b = sum(raw.values()) + 1024, sum(target.values()) + 1024
    score = lambda text: np.mean([np.log((target[g] + 1) / b) - np.log((raw[g] + 1) / a) for g in grams(text)]) if text else None
    held = sorted(score(text) for i, text in docs if i in order and order[i] % 2)
    least = held[int(len(held) * (1 - 0.9))]
    want = []
    for i, text in docs:
        base = base_counts(text or "")
        x = score(text)
        want.append((i, *base, not base[-1] and x is not None and x >= least - 1e-12, x))
    want.sort(key=str)
    assert sorted((str(r[0]), r[1:8]) for r in got) == sorted((str(r[0]), r[1:8]) for r in want)
    assert sorted(r[8] for r in got if r[8] is not None) == pytest.approx(sorted(r[8] for r in want if r[8] is not None))


@pytest.mark.parametrize("by_shuffle", [False, True])
def test_all_trusted_documents_take_part(spark, monkeypatch, by_shuffle):
    """More trusted documents than 20,000, the bound of before: all of them count, and the threshold is the order
    statistic of every score of the other half, repeated ids included."""
    if by_shuffle:
        monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    n, words = 30_000, "good clean fine text bad junk of some kind".split()
    docs = [(k % (n + 2000), " ".join(words[(k * 7 + j * j) % len(words)] + str(k % 50 * j % 11) for j in range(6))) for k in range(n + 4000)]
    docs, trusted = frame(spark, docs), frame(spark, [(k,) for k in range(n)] + [(3,), (None,)], "doc_id long")
    got = quality.quality_rules(docs, trusted, buckets=1 << 8, keep_share=0.9, min_words=1, max_repeat=100).collect()
    order = {r.doc_id: k for k, r in enumerate(trusted.filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").collect())}
    flags, count = quality.halves(trusted)
    assert count == n and {r.t_id: r.half for r in flags.collect()} == {k: 1 + at % 2 for k, at in order.items()}
    memo, raw, target = common.Memo(quality.word_hash), np.ones(1 << 8), np.ones(1 << 8)
    for r in docs.collect():
        own = np.bincount(quality.buckets_of(r.text.encode().split(), memo, 1 << 8), minlength=1 << 8)
        raw += own
        target += own * (order.get(r.doc_id, 1) % 2 == 0)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = sorted((r.doc_id, ratio[quality.buckets_of(r.text.encode().split(), memo, 1 << 8)].mean()) for r in docs.collect())
    assert np.allclose([x for _, x in want], [x for _, x in sorted((r.doc_id, r.score) for r in got)])
    held = sorted(r.score for r in got if order.get(r.doc_id, 0) % 2)
    least = held[int(len(held) * (1 - 0.9))]
    assert all(r.kept == (r.score >= least) for r in got) and len(got) == n + 4000


# ---- 3 chat


def test_chat(spark):
    turns = [(c, t, r, x) for c, own in {1: "ab", 2: "abc", 3: "abc", 4: "xb", 5: "abd"}.items() for t, (x, r) in enumerate(zip(own, ["user", "assistant", "user"]))]
    turns += [(2, 0, "user", "a"), (6, 9, None, None), (None, 1, "user", "hi")]
    got = {r.conv_id: r for r in chat.format_chats(frame(spark, turns, "conv_id long, turn int, role string, text string")).collect()}
    assert set(got) == {2, 4, 5, 6, None} and got[2].n_copies == 2 and got[2].n_turns == 3
    assert got[4].text == "<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n" and got[6].text == "<|im_start|>\n<|im_end|>\n"
    long = [(1, t, "user", f"t{t}") for t in range(2500)] + [(2, t, "user", f"t{t}") for t in range(1200)]
    parts = chat.format_chats(frame(spark, long, "conv_id long, turn int, role string, text string")).orderBy("part").collect()
    assert [(r.conv_id, r.n_part_turns) for r in parts] == [(1, 1024), (1, 1024), (1, 452)]
    assert chat.format_chats(frame(spark, [], "conv_id long, turn int, role string, text string")).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def exact_chats(turns):
    """{conv_id: (n_turns, n_copies, text)} of what is no prefix of another conversation."""
    low = lambda x: (x is not None, x or "")
    convs = collections.defaultdict(set)
    for c, *turn in turns:
        convs[c].add(tuple(turn))
    convs = {c: tuple((r, x) for _, r, x in sorted(own, key=lambda t: (t[0] is not None, t[0] or 0, low(t[1]), low(t[2])))) for c, own in convs.items()}
    inner = {own[:k] for own in convs.values() for k in range(len(own))}
    out = {}
    for own in set(convs.values()) - inner:
        ids = [c for c, x in convs.items() if x == own]
        out[min((c for c in ids if c is not None), default=None)] = (len(own), len(ids), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in own))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chat_with_nulls(spark, seed):
    """Null cells, equal and null turn numbers and repeated rows against brute force; further columns don't matter."""
    rng = random.Random(seed)
    cell = lambda: rng.choice([None, "", "user", "a"])
    turns = [(c, rng.choice([None, 0, 1, 2, 2, 3]), cell(), cell()) for c in [*range(60), None] for _ in range(rng.randrange(1, 5))]
    turns += [(100, 0, "user", None), (101, 0, None, "user"), (102, 0, "user", ""), (103, 0, "", "user")] + turns[:20]
    rng.shuffle(turns)
    got = chat.format_chats(frame(spark, [(*t, 7, "x") for t in turns], TURNS + ", part int, h1 string")).collect()
    assert {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in got} == exact_chats(turns) and len(got) == len(exact_chats(turns))


def test_chat_over_partitions(spark):
    """A few conversations that run through many partitions, one of equal and null turn numbers, and their snapshots."""
    long = [(None, k % 3, "user", f"t{k:04}") for k in range(900)] + [(5, None, "user", f"n{k}") for k in range(300)]
    long += [(7, t, "user", f"t{t}") for t in range(2000)] + [(8, t, "user", f"t{t}") for t in range(1500)] + [(9, t, "user", f"t{t}") for t in range(2000)]
    long += [(6, 0, "user", "again")] * 5000
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        got = chat.format_chats(frame(spark, long, TURNS), None).collect()
        assert {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in got} == exact_chats(long) and len(got) == 4
        parts = chat.format_chats(frame(spark, long, TURNS), 128).filter("conv_id = 7").orderBy("part").collect()
        assert "".join(r.text for r in parts) == exact_chats(long)[7][2] and [r.part for r in parts] == list(range(16))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert chat.format_chats(frame(spark, [(1, 1, "user", "x" * 3_000_000)], TURNS)).first().text == f"<|im_start|>user\n{'x' * 3_000_000}<|im_end|>\n"


# ---- 4 near duplicates


def exact_components(docs, width, percent):
    sets = {}
    for i, text in docs:
        w = re.findall("[^\\x20\\x09-\\x0D]+", (text or "").translate(LOW))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed, groups=6, size=12, words=60):
    """Groups of copies with edits around the threshold, so that links run through chains."""
    rng = random.Random(seed)
    docs, k = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(words)] = f"e{rng.randrange(30)}" if rng.random() < 0.5 else f"u{rng.randrange(10**9)}"
            docs.append((k, " ".join(own)))
            k += 1
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "width"), [(1, 2), (2, 2), (3, 5)])
def test_near_duplicates(spark, seed, width):
    docs = near_copies(seed) + [(1000, None), (1001, ""), (1002, "a"), (1003, "A"), (1004, "a b"), (1005, " a  b ")]
    got = {r[0]: (r[1], r[2], r[3]) for r in near_dups.near_duplicates(frame(spark, docs), width).collect()}
    want = exact_components(docs, width, 80)
    assert {i: x[:2] for i, x in got.items()} == want and all(x[2] == (i == x[1]) for i, x in got.items())


def test_near_duplicates_of_one_shingle(spark):
    """A text of exactly the shingle's words has an ordinary set; one of fewer words hasn't."""
    for width in (2, 5):
        docs = [(k, " ".join(["ha"] * n)) for k, n in enumerate([width, width + 1, width + 7, width - 1, width - 1])]
        got = {r[0]: (r[1], r[2]) for r in near_dups.near_duplicates(frame(spark, docs), width).collect()}
        assert got == exact_components(docs, width, 80) and [got[k][1] for k in range(5)] == [0, 0, 0, 3, 3]


def test_near_duplicate_stage(spark):
    docs = frame(spark, [(1, "a b c d e f", 5), (2, "a b c d e f", 6), (3, "z", 7), (3, "z", 7), (None, "q", 8)], "doc_id long, text string, digest int")
    assert sorted((r[0] or 0, r[2]) for r in near_dups.drop_near_duplicates(docs).collect()) == [(0, 8), (1, 5), (3, 7)]
    assert near_dups.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(k + 1, k) for k in range(30)] + [(50, 40), (40, 60), (7, 7)]
    got = {r[0]: r[1] for r in components.components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 50: 40, 60: 40}


def test_near_duplicates_of_hot_groups(spark, monkeypatch):
    """Heads with many nodes are dealt to shares, also those that are a large part of all rows; nothing is left behind."""
    from affinia.sources import shared

    monkeypatch.setattr(near_dups, "SHARE_ROWS", 4)
    base = [f"w{k}" for k in range(40)]
    rng = random.Random(8)
    docs = [(k, " ".join(w if rng.random() > 0.09 else f"x{rng.randrange(60)}" for w in base)) for k in range(150)] + [(200 + k, x) for k, (_, x) in enumerate(near_copies(11, 4, 8))]
    docs += [(400, "y " * 100_000), (401, "y " * 100_000)]
    for few in (1000, 3):
        monkeypatch.setattr(near_dups, "FEW_HEADS", few)
        begin = shared.mark()
        found = near_dups.near_duplicates(frame(spark, [(*d, "s", 1) for d in docs], DOCS + ", sig string, component_id int"), 2)
        assert {r[0]: (r[1], r[2]) for r in found.collect()} == exact_components(docs, 2, 80)
        assert shared.mark() - begin <= 5
        shared.free(spark, begin)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text("ab A\n", max_size=9), min_size=10, max_size=60))
def test_near_duplicates_of_short_texts(spark, texts):
    docs = list(enumerate(texts))
    got = {r[0]: (r[1], r[2]) for r in near_dups.near_duplicates(frame(spark, docs), 2).collect()}
    assert got == exact_components(docs, 2, 80)


# ---- 5 decontamination


def exact_hits(docs, items, width, least):
    find = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+").findall
    windows, lengths = collections.defaultdict(set), set()
    for i, text in items:
        w = find((text or "").translate(LOW))
        if w:
            n = min(width, len(w))
            lengths.add(n)
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(str(i))
    for i, text in docs:
        w = find((text or "").translate(LOW))
        hit, own = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    own |= found
                    hit |= set(range(k, k + n))
        yield i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(own) >= least


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["The", "a", "of", "é", "b2"]) if rng.random() < 0.6 else f"w{rng.randrange(60)}"
    items = [(k, ", ".join(word() for _ in range(rng.randrange(0, 25)))) for k in range(30)] + [(90, None), (91, "a of"), (92, "only")]
    docs = []
    for k in range(80):
        own = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            text = (items[rng.randrange(30)][1] or "").split(", ")
            at = rng.randrange(len(own) + 1)
            own[at:at] = text[rng.randrange(max(1, len(text) // 2)) :]
        docs.append((k, " ".join(own)))
    docs += [(100, None), (101, ""), (102, "only"), (102, "only")]
    got = decontaminate.match_benchmark(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert sorted(tuple(r)[:6] for r in got.collect()) == sorted(exact_hits(docs, items, 8, 2))
    none = frame(spark, [], "item_id long, text string")
    assert decontaminate.match_benchmark(frame(spark, docs), none).filter("n_hit > 0 OR n_words IS NULL").count() == 0
    assert decontaminate.match_benchmark(frame(spark, []), frame(spark, items, "item_id long, text string")).count() == 0


def test_proximity(spark):
    items = decontaminate.items_of(frame(spark, [("i", "alpha beta gamma delta eps zeta eta theta")], "item_id string, text string"), 8)
    texts = decontaminate.texts_of(frame(spark, [(1, "alpha beta x gamma y delta"), (2, "alpha " + "z " * 40 + "beta"), (3, "alpha beta gamma delta eps zeta eta theta")]))
    near = decontaminate.proximity_matches(decontaminate.meet(decontaminate.build_index(texts, items, 8)), 4, 3, 16)
    got = {r.doc_id: r.n_terms for r in near.join(texts, "rid").collect()}
    assert got[1] == 4 and 2 not in got and got[3] == 8


def test_long_items_take_linear_room(spark):
    """What is stored for an item grows with its length; a long item in both tables is found whole."""
    rng = random.Random(3)
    sizes = []
    for n in (500, 2000):
        words = [f"w{rng.randrange(3000)}" for _ in range(n)]
        texts = decontaminate.texts_of(frame(spark, [(1, " ".join(words))]))
        index = decontaminate.build_index(texts, decontaminate.items_of(frame(spark, [("i", " ".join(words))], "item_id string, text string"), 8), 2)
        places = index.places.collect()
        assert max(len(r.starts) for r in places) <= 8
        sizes.append(sum(len(r.starts) for r in places) + index.windows.count())
    assert sizes[1] <= 4.2 * sizes[0]
    words = [f"w{rng.randrange(9000)}" for _ in range(20_000)]
    docs = [(1, "before it " + " ".join(words) + " behind it"), (2, " ".join(words[5000:5100])), (3, "nothing")]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.match_benchmark(frame(spark, docs), frame(spark, [(1, " ".join(words))], "item_id long, text string")).collect()}
    assert got == {1: (20_004, 20_000, 1), 2: (100, 100, 1), 3: (1, 0, 0)}


def test_large_benchmarks_join_by_shuffle(spark, monkeypatch):
    """Without broadcasts, results are the same; rows of one doc_id are judged by themselves, null ids count as the empty one."""
    rng = random.Random(6)
    items = [(k, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 20)))) for k in range(20)] + [(None, "the one without an id has so many words"), (None, None), (7, "")]
    docs = [(None, " ".join(items[k % 21][1].split()[:12])) for k in range(60)] + [(1, items[20][1]), (1, "other words"), (2, "x " * 30_000 + items[3][1])]
    schema, columns = "item_id long, text string", "doc_id long, text string, words string, rid int, hits int"
    frames = frame(spark, [(*d, "a", 1, 2) for d in docs], columns), frame(spark, items, schema)
    want = sorted((tuple(x)[1:] for x in exact_hits([(k, d[1]) for k, d in enumerate(docs)], [("" if i is None else i, x) for i, x in items], 8, 2)))
    for bytes_ in (decontaminate.BROADCAST_BYTES, -1):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bytes_)
        got = decontaminate.match_benchmark(*frames, slack=4).collect()
        assert sorted(tuple(r)[1:6] for r in got) == want and all(r.n_near_items >= 0 for r in got)


def test_near_matches(spark):
    """An item whose word in each window is changed, also to one that no document holds, is found."""
    words = [f"w{k}" for k in range(15)]
    items = frame(spark, [("i", " ".join([*words[:7], "unheard", *words[8:]]))], "item_id string, text string")
    docs = frame(spark, [(1, " ".join(words)), (2, " ".join([*words[:4], "more", *words[4:7], "yet", *words[8:]])), (3, "w3 other words w9"), (4, None)])
    got = {r.doc_id for r in decontaminate.near_matches(docs, items).collect()}
    assert got == {1, 2} and decontaminate.match_benchmark(docs, items).filter("n_hit > 0").count() == 0
    near = {r.doc_id: (r.n_items, r.n_near_items) for r in decontaminate.match_benchmark(docs, items, slack=4).collect()}
    assert near == {1: (0, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0)}


# ---- 6, 7 tokens


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab .'\n,sé1 \t!\x00　Ж_-", max_size=14), max_size=8))
def test_encoder(texts):
    own = encode.encoder(TOKENIZER)
    want = [x.ids for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode_many(texts)] == want and [own.encode(x).tolist() for x in texts] == want


def test_encoder_forgets():
    small = encode.Encoder(TOKENIZER, entries=5)
    texts = [" ".join(f"word{k % 7}, a{chr(97 + k % 20)}" for k in range(j, j + 30)) for j in range(10)]
    assert [x.tolist() for x in small.encode_many(texts, 50)] == [x.ids for x in small.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(small.spaced) <= 5


def test_encoders_are_released():
    """Stages that do not encode empty what a worker's encoders remember; ids stay the same."""
    coder = encode.encoder(TOKENIZER)
    texts = ["some words here\nand ünïcödé ones, twice", None, "  odd  space "]
    before = [x.tolist() for x in coder.encode_many(texts)]
    assert coder.first and coder.spaced
    common.release()
    assert not (coder.first or coder.spaced or coder.first.old or coder.spaced.old)
    assert encode.encoder(TOKENIZER) is coder and [x.tolist() for x in coder.encode_many(texts)] == before


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70), st.data())
def test_bit_packing(width, ids, data):
    ids = [x % (1 << width) for x in ids]
    raw = token_store.pack(np.array(ids, np.uint64), width)
    assert len(raw) == (len(ids) * width + 63) // 64 * 8
    first = data.draw(st.integers(0, len(ids)))
    n = data.draw(st.integers(0, len(ids) - first))
    assert token_store.unpack(raw, width, first, n).tolist() == ids[first : first + n]


def encoded(docs, end):
    own = encode.encoder(TOKENIZER).tokenizer
    return [(i, x.ids + [end]) for (i, _), x in zip(docs, own.encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True)]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_token_store(spark, tables, tmp_path):
    at, want = 0, []
    for i, ids in encoded(documents(spark, tables[0]), 2):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op6_token_store"](spark, tables[0]).collect()) == want
    path = f"file://{tmp_path}/store"
    assert token_store.write_store(frame(spark, EDGES), path, TOKENIZER, shards=3, block_ids=64) == 16
    got = token_store.read_store(spark, path, with_ids=True).orderBy("start").collect()
    flat = [x for _, ids in encoded(EDGES, 2) for x in ids]
    assert [x for r in got for x in r.ids] == flat and [r.doc_id for r in got] == [i for i, _ in EDGES]
    blocks = token_store.read_blocks(spark, path).orderBy("shard", "block").collect()
    shard = blocks[-1].shard
    n = sum(b.n_ids for b in blocks if b.shard == shard)
    assert token_store.read_slice(spark, path, shard, 2, n - 3).tolist() == flat[len(flat) - n + 2 : -1]
    by_id = collections.defaultdict(list)
    for i, ids in encoded(EDGES, 2):
        by_id[i].append(ids)
    for i, want in by_id.items():
        assert [x.tolist() for x in token_store.read_document(spark, path, i)] == want
    assert token_store.read_document(spark, path, 99) == [] == token_store.read_document(spark, path, None)
    token_store.write_store(frame(spark, []), f"{path}0", TOKENIZER, shards=2)
    assert token_store.read_store(spark, f"{path}0").count() == 0


def test_token_store_of_equal_ids(spark, tmp_path):
    """Rows of one id or none are dealt over shards, in the order of the table; further columns don't matter."""
    docs = [(None, f"none {k}") for k in range(300)] + [(5, f"five {k}") for k in range(300)] + [(6, None)]
    path = f"file://{tmp_path}/store"
    token_store.write_store(frame(spark, [(*d, 1, 2) for d in docs], DOCS + ", rid int, shard int").coalesce(1), path, TOKENIZER, shards=6, block_ids=200)
    got = token_store.read_store(spark, path, with_ids=True).orderBy("start").collect()
    assert [(r.doc_id, r.ids) for r in got] == encoded(docs, 2)
    rows = {r.shard: r.n for r in token_store.read_blocks(spark, path).groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).collect()}
    assert len(rows) >= 5 and max(rows.values()) < 250
    assert [x.tolist() for x in token_store.read_document(spark, path, None)] == [ids for i, ids in encoded(docs, 2) if i is None]


def pieces_hold(pieces, docs, size=2048):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, ids in encoded(docs, 1):
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size
    return len(by_seq)


def test_packing(spark, tables):
    docs = documents(spark, tables[0])
    pieces = QUERIES["op7_packing"](spark, tables[0]).collect()
    n = pieces_hold(pieces, docs)
    assert n == -(-sum(len(x) for _, x in encoded(docs, 1)) // 2048)
    edges = [x for k, x in enumerate(EDGES) if k != 6]
    pieces_hold(packing.pack_documents(frame(spark, edges), TOKENIZER, group_docs=3).collect(), edges)
    assert packing.pack_documents(frame(spark, EDGES), TOKENIZER).filter("doc_id = 7 AND start = 0").count() == 2
    assert packing.pack_documents(frame(spark, []), TOKENIZER).count() == 0


def test_packing_groups_are_bounded(spark):
    """Equal rows are dealt over groups; a group gets less than a sequence of each document."""
    same = [(1, "equal words")] * 3000 + [(None, None)] * 50
    pieces = packing.pack_documents(frame(spark, [(*d, 1, 2) for d in same], DOCS + ", rid int, start int"), TOKENIZER, group_docs=100, with_ids=True).collect()
    groups = collections.Counter(p.sequence_id >> 32 for p in pieces)
    assert len(groups) == 31 and max(groups.values()) < 200 and len(pieces) >= 3050
    long = [(k, "word " * n) for k, n in enumerate((100_000, 2047, 2048, 2049, 5, 0))]
    pieces = packing.pack_documents(frame(spark, long), TOKENIZER, with_ids=True).collect()
    pieces_hold(pieces, long)
    ids = dict(encoded(long, 1))
    assert all(p.ids == ids[p.doc_id][p.start : p.start + p.length] for p in pieces)
    assert sum(p.sequence_id >= packing.FULL for p in pieces) == sum(len(x) // 2048 for x in ids.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=40))
def test_plan(lengths):
    bins = packing.plan(lengths, 16)
    assert all(0 < sum(x[2] for x in b) <= 16 for b in bins) and len(bins) == -(-sum(lengths) // 16)
    taken = collections.defaultdict(list)
    for b in bins:
        for item, start, n in b:
            taken[item] += range(start, start + n)
    assert all(sorted(taken[k]) == list(range(n)) for k, n in enumerate(lengths))


# ---- 8 language


def test_language(spark, tables):
    got = QUERIES["op8_language_id"](spark, tables[0])
    lang = spark.read.parquet(f"{tables[0]}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(lang, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    more = [(k, t, None) for k, t in [*EDGES, (20, "12 % 34")]]
    docs = lang.select("doc_id", "text", "lang").filter("doc_id >= 50").union(frame(spark, more, "doc_id long, text string, lang string"))
    edge = {r.doc_id: r for r in language.detect_language(docs).filter("doc_id < 50").collect()}
    assert all(edge[k].lang_pred == "und" and edge[k].rejected for k in (1, 2, 3, 20)) and edge[4].lang_pred != "und"
    none = language.detect_language(frame(spark, [(1, "text", None)], "doc_id long, text string, lang string")).collect()
    assert none[0].lang_pred == "und" and language.detect_language(frame(spark, [], "doc_id long, text string, lang string")).count() == 0


def test_language_against_brute_force(spark):
    """Predictions, scores and rejections from centroids that are worked out here, by the sample's rule."""
    rng = random.Random(1)
    words = {"aa": "alpha beta gamma delta", "bb": "uno dos tres cuatro cinco", "cc": "один два три четыре"}
    docs = [(k, " ".join(rng.choice(words[lang].split()) for _ in range(5 + k % 9)), lang) for k in range(90) for lang in [list(words)[k % 3]]]
    docs += [docs[0], docs[0], (300, "zzzz qqqq xxxx wwww", None), (301, "12 34", "aa"), (None, "alpha beta", "aa"), (302, "Ω", None)]
    size = 1 << 10
    schema = "doc_id long, text string, lang string"
    got = {(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9), r.rejected) for r in language.detect_language(frame(spark, [(*d, 1.0, "x") for d in docs], schema + ", score double, lang_pred string"), per_language=12, size=size, k=1).collect()}
    hashes = {r[0]: r[1] for r in frame(spark, [(k,) for k in range(90)], "doc_id long").select("doc_id", F.xxhash64("doc_id")).collect()}
    train = [d for d in docs[:90] if zlib.crc32(str(d[0]).encode()) % 3 != 1]
    sample = {lang: [d[1] for d in sorted((d for d in train if d[2] == lang), key=lambda d: hashes[d[0]])[:12]] for lang in words}

    def dense(text):
        out = np.zeros(size)
        found = language.gram_counts(text, size)
        if found is None:
            return None
        out[found[0]] = 1 + np.log(found[1])
        return out

    every = [dense(x) for own in sample.values() for x in own]
    idf = np.log((1 + len(every)) / (1 + sum((x > 0).astype(float) for x in every))) + 1
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
    centres = {lang: unit(sum(unit(dense(x) * idf) for x in own)) for lang, own in sample.items()}
    floors = {lang: 0.3 * min(unit(dense(x) * idf) @ centres[lang] for x in own) for lang, own in sample.items()}
    want = set()
    for i, text, _ in docs:
        held = i is not None and zlib.crc32(str(i).encode()) % 3 == 1
        if dense(text) is None:
            want.add((i, held, "und", 0.0, True))
            continue
        near = {lang: unit(dense(text) * idf) @ c for lang, c in centres.items()}
        best = max(near, key=near.get)
        want.add((i, held, best, float(near[best]), bool(near[best] < floors[best])))
    key = lambda r: (str(r[0]), r[1:3], r[4])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert [r[3] for r in sorted(got, key=str)] == pytest.approx([r[3] for r in sorted(want, key=str)], abs=1e-6)
    assert any(r[4] for r in want if r[0] == 302)


def test_long_text_counts_alike():
    text = "".join(random.Random(3).choice("abcd é1 ") for _ in range(3_000_000))
    used, count = language.gram_counts(text, 4096)
    letters = sum(c.isalpha() for c in text)
    runs = len(re.findall(r"[a-dé]+", text))
    bounds = runs + 1 + (not text[0].isalpha()) + (not text[-1].isalpha())
    assert count.sum() == letters + (letters + bounds - 1) + (letters + bounds - 2)


# ---- 9 personal data


def luhn(number):
    """Whether the check digit of a card's number is right."""
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(digits[::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0


KEY = b"k" * 32


def test_surrogates_hold_over_the_corpus():
    """Each entity by itself, as in documents of their own: equal ones equal, different ones different, none as it was."""
    letters = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрст", "greek": "αβγδεζηθικλμνξοπρ"}
    rng = random.Random(2)
    for script, own in letters.items():
        for gender in ("m", "f", "x", ""):
            names = {"".join(rng.choice(own) for _ in range(rng.randrange(1, 9))) for _ in range(10_000)}
            made = pii.Surrogates(KEY)
            new = {n: made.name(n, gender) for n in sorted(names)[: 10_000 if gender == "" else 500]}
            assert len(set(new.values())) == len(new) and all(a != b and pii._script(b) == script for a, b in new.items())
    made = pii.Surrogates(KEY)
    for kind, values in {
        "ipv4": [f"10.{k % 7}.{k // 256}.{k % 256}" for k in range(2000)],
        "email": [f"{a}{k}@{d}.org" for k in range(300) for a in "ab" for d in ("x", "mail")] + ["é@x.org", "ü@x.org"],
        "secret": [f"{k:032x}" for k in range(500)] + [f"AKIA{k:016d}" for k in range(500)],
        "mac": [f"00:00:00:00:{k // 256:02x}:{k % 256:02x}" for k in range(1000)],
        "ipv6": [f"2001:db8::{k:x}" for k in range(1, 1000)],
        "ssn": [f"{k:09d}" for k in range(1000)],
        "phone": [f"{k:03d}" for k in range(1000)] + [f"+1 {k:03d}" for k in range(1000)],
        "card": [f"4{k:015d}" for k in range(3000)],
        "iban": [f"DE{k % 100:02d}{k // 100:018d}" for k in range(3000)],
    }.items():
        new = [made.of(kind, v) for v in values]
        assert len(set(new)) == len(new) == len(set(values)) and not any(a == b for a, b in zip(new, values)), kind
        if kind == "card":
            assert all(luhn(a) == luhn(b) and b[0] == "4" for a, b in zip(values, new))


def test_surrogates_of_small_forms_are_permutations():
    made = pii.Surrogates(KEY)
    for n in (1, 2, 3):
        every = [f"{k:0{n}d}" for k in range(10**n)]
        new = [made.digits("x", v) for v in every]
        assert sorted(new) == every and all(a != b for a, b in zip(every, new))


def test_account_numbers_stay_valid():
    valid = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    text = "DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 and GB83WEST12345698765432"
    new, kinds = pii.replace(text, KEY)
    de, gb, wrong = (x.replace(" ", "") for x in re.findall(r"[A-Z]{2}\d{2}(?: ?\w{4})+(?: ?\w{2})?", new.replace(" and ", ", ")))
    assert kinds == ["iban"] * 3 and valid(de) and valid(gb) and not valid(wrong) and len(new) == len(text) and not {"3704", "WEST"} & set(re.findall("[A-Z]{4}|[0-9]{4}", new))


def test_cases_of_titles_and_numbers():
    text = "MR. SMITH, mrs Jones; I miss Paris. MS Windows; 0171 555 7713, tel. 1234567890, tel: 555 7713; 3782 822463 10005; numbers 1234567890 and 4111111111111112"
    new, kinds = pii.replace(text, KEY)
    assert kinds == ["person", "person", "phone", "phone", "phone", "card"]
    assert not any(x in new for x in ("SMITH", "Jones", "0171", "555", "tel. 1234567890", "3782 822463"))
    assert re.fullmatch(r"MR\. [A-Z]+, mrs [A-Z][a-z]+; I miss Paris\. MS Windows; \d{4} \d{3} \d{4}, tel\. \d{10}, tel: \d{3} \d{4}; \d{4} \d{6} \d{5}; numbers 1234567890 and 4111111111111112", new)
    assert luhn(re.search(r"\d{4} \d{6} \d{5}", new)[0])
    new, _ = pii.replace("Mr. John Smith came. Smith then left; John too, Johns didn't, Mr O'Neill Lee-Smith", KEY)
    john, smith = re.match(r"Mr\. (\w+) (\w+) came", new).groups()
    assert f"{smith} then left; {john} too, Johns didn't" in new and re.search(rf"Mr [A-Z][a-z]*'[A-Z]\w+ [A-Z]\w+-{smith}$", new)


def test_long_texts_of_persons():
    text = " ".join(f"Dr. Name{chr(97 + k % 26)} Last{chr(97 + k % 24)}." for k in range(20_000)) + " x" * 500_000
    new, kinds = pii.replace(text, KEY)
    assert len(kinds) == 20_000 and "Name" not in new and "Last" not in new and new.endswith(" x" * 500_000)


def test_key_is_needed(spark):
    with pytest.raises(ValueError):
        pii.replace_pii(frame(spark, EDGES), "")
    one, two = (sorted(r.text or "" for r in pii.replace_pii(frame(spark, [(1, "a.b@example.org"), (1, "a.b@example.org"), (None, None)]), k).collect()) for k in "ab")
    assert one != two and one[0] == "" and one[1] == one[2] and pii.replace_pii(frame(spark, []), "k").count() == 0
    assert len(pii.session_key(spark)) == 64 and pii.session_key(spark) == pii.session_key(spark)


def test_surrogates():
    key = b"k" * 32
    text = "Mr. John Smith <j.smith@mail.example.com>, +1 (017) 555-7713, card 4111 1111 1111 1111, ip 10.0.0.1; Frau Müller; Mr Smith and J.SMITH@MAIL.EXAMPLE.COM; Господин Иванов 4111111111111111"
    new, kinds = pii.replace(text, key)
    assert kinds == ["person", "email", "phone", "card", "ipv4", "person", "person", "email", "person", "card"]
    for real in ("Smith", "John", "smith", "SMITH", "555-7713", "4111 1111", "10.0.0.1", "Müller", "Иванов"):
        assert real not in new
    assert pii.replace(text, key) == (new, kinds) and pii.replace(text, b"other" * 8)[0] != new
    last = re.search(r"Mr\. \w+ (\w+) <", new)[1]
    assert f"Mr {last} and" in new
    lower, upper = re.search(r"<(\S+)>", new)[1], re.search(r"and (\S+);", new)[1]
    assert upper == lower.upper()
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", new)
    assert len({c.replace(" ", "") for c in cards}) == 1 and luhn(cards[1])
    assert re.search(r"Господин [А-Яа-я]+ \d", new) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)
    assert pii.replace("nothing to see, 3 of 12 on 4.0", key) == ("nothing to see, 3 of 12 on 4.0", [])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 9999), min_size=2, max_size=60, unique=True))
def test_numbers_stay_distinct(numbers):
    text = " ".join(f"+1 (017) 555-{n:04d}" for n in numbers)
    new, kinds = pii.replace(text, b"k")
    assert len(kinds) == len(numbers) and len(set(re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", new))) == len(numbers)


def test_names_stay_distinct():
    """However many persons a text has, each gets a surrogate of its own and none keeps its name."""
    letters = {"Dr": "abcdefghijklmnop", "Mr": "abcdefghijklmnop", "Prof": "αβγδεζηθικλμνξοπ"}
    for title, own in letters.items():
        given = [f"{x}{y}{z}q".capitalize() for x in own for y in own for z in own[:3]]
        text = "; ".join(f"{title} {name} Zyx" for name in given)
        new = re.findall(rf"{title} (\w+) (\w+)", pii.replace(text, b"k" * 32)[0])
        assert len({g for g, _ in new}) == len(given) and len({n for _, n in new}) == 1
        assert not {g for g, _ in new} & set(given)
    last = {pii.replace(f"Mr {a}{b}{c}{d}", b"k")[0] for a in "ABCDEFGHIJ" for b in "abcdefghij" for c in "abcdefghij" for d in "abcdefghij"}
    assert len(last) == 10_000  # in texts of their own


def test_later_mentions():
    """A person with a title once is replaced everywhere, by the same names."""
    text = "Anna Smith came. Dr. Anna Smith and Mr Bob Jones spoke; Smith said, SMITH'S view, Anna\nSmith, smith work, Bob Jones's, Jones’s, Smithson, Mr Smith's"
    new, kinds = pii.replace(text, b"k" * 32)
    anna, smith, bob, jones = re.search(r"Dr\. (\w+) (\w+) and Mr (\w+) (\w+) spoke", new).groups()
    assert new == f"{anna} {smith} came. Dr. {anna} {smith} and Mr {bob} {jones} spoke; {smith} said, {smith.upper()}'S view, {anna}\n{smith}, smith work, {bob} {jones}'s, {jones}’s, Smithson, Mr {smith}'s"
    assert kinds == ["person"] * 9 and not {"Anna", "Smith", "Bob", "Jones"} & {anna, smith, bob, jones}


def test_short_ipv6():
    text = "at 2001:db8::1, 2001:0db8:0000:0000:0000:0000:0000:0001, 2001:DB8:0:0:0:0:0:1; ::ffff:192.0.2.1 fe80::1%eth0 ::1/128 but std::vector a::b 12:30 ::"
    new, kinds = pii.replace(text, b"k" * 32)
    assert kinds == ["ipv6"] * 6 and new.endswith("but std::vector a::b 12:30 ::")
    short, wide, eight, mapped = re.match(r"at (\S+), (\S+), (\S+); (\S+) ", new).groups()
    import ipaddress

    assert len({ipaddress.IPv6Address(x) for x in (short, wide, eight)}) == 1 and len(wide) == 39 and "::" in short and "::" not in eight
    assert ipaddress.IPv6Address(mapped) and not any(x in new for x in ("2001:", "192.0.2.1", "fe80::1%"))


def test_pii_columns(spark, tables):
    docs = frame(spark, [(1, "mail a.b@c.example.org now", "k"), (2, None, None), (3, "", "x")], "doc_id long, text string, pii_kinds string")
    got = pii.replace_pii(docs, "k").orderBy("doc_id").collect()
    assert [tuple(r.pii_kinds) for r in got] == [("email",), (), ()] and [r.text for r in got[1:]] == [None, ""]
    found = re.compile(r"[\w.]+@[\w.]+\w|\b4\d{15}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d+\.\d+\.\d+\.\d+\b|\b[0-9a-f]{40}\b")
    new = {r.doc_id: r.text for r in QUERIES["op9_pii_surrogates"](spark, tables[0]).collect()}
    for i, text in documents(spark, tables[0]):
        assert not [x for x in found.findall(text) if x in new[i] and (len(x) != 16 or luhn(x))]
        assert all(luhn(x) or x in new[i] for x in re.findall(r"\b\d{16}\b", text))
        assert found.search(text) or new[i] == text or pii.entities(text)


# ---- 10 pages


def test_pages(spark, tables):
    rows = {r.page_id: r for r in QUERIES["op10_html_extraction"](spark, tables[0]).collect()}
    for page in spark.read.parquet(f"{tables[0]}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert rows[page.page_id].text == "\n".join(p for p in parts if p) and rows[page.page_id].n_chars == len(rows[page.page_id].text)


def test_page_layouts():
    for page, main in html_text._labelled():
        assert set(html_text.main_text(page).split("\n")) == main
    words = "A sentence of the story that goes on for a while, and then ends."
    page = f"""<body><div class="cookie-notice">We use cookies, <a href=#>ok</a></div><header><h1>Site</h1></header><div id="content"><h2>Head &amp; line</h2><p>{words}<p>{words}
      <div class="advert">Buy</div><form><label>Mail</label><input></form><script>if (a < b) "</p>"</script><p>x &lt; y&nbsp;z<!-- <p>hidden</p> --></div>
      <section class="comments"><p>Nice text, I liked it very much indeed.</p></section><div class="sidebar"><ul><li><a href=1>one</a></ul></div><footer>Foot</footer>"""
    assert html_text.main_text(page) == f"Head & line\n{words}\n{words}\nx < y z"
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<script>a b c", "<div class='ad'>buy</div>")] == [""] * 5
    assert html_text.main_text("plain words only") == "plain words only"
    assert html_text.best_region([1.0, -5.0, 2.0, 3.0, -1.0]) == (2, 4)


def test_elements_without_end_tags():
    """However many elements of a menu are left open, its end closes them, and the article is kept."""
    words = "A sentence of the story that goes on for a while, and then ends."
    article = f"<article><p>{words}<p>{words}</article>"
    for item in ("<li>topic", "<p>note", "<b>x", "<dt>a<dd>b", "<option>y"):
        for around in ("nav", "aside", "form", 'div class="comments"'):
            page = f"<body><{around}><div>{item * 300}</div></{around.split()[0]}>{article}"
            assert html_text.main_text(page) == f"{words}\n{words}"
    # a new item, cell or row ends the one before, with all that is open in it; one of an inner list does not
    assert html_text.main_text(f'<ul><li><div class="ad">buy<li>{words}</ul>') == words
    assert html_text.main_text(f'<table><tr><td class="menu">home<td>{words}<tr><td class="menu">home<tr><td>{words}</table>') == f"{words}\n{words}"
    assert html_text.main_text(f'<ul><li class="menu"><ul><li>one<li>two</ul>three<li>{words}</ul>') == words


def test_asides_within_a_block():
    """Only the words of an aside element go, and only by its own attributes."""
    long = "A sentence of the story that goes on for a while"
    for name in ("tag", "meta", "share", "print", "related"):
        assert html_text.main_text(f'<article><p>{long} <span class="{name}">x</span> and ends.</p><p>{long}.</p></article>') == f"{long} and ends.\n{long}."
    for attribute in ('href="/hidden-valley"', 'title="a hidden gem"', "data-hidden=1", 'href="?class=ad&id=menu"', 'data-class="ad"'):
        assert html_text.main_text(f"<article><p>{long} <a {attribute}>of a link</a> and ends.</p></article>") == f"{long} of a link and ends."
        assert html_text._kind("a", f" {attribute}", True) == "plain"
    assert html_text._kind("div", ' id="story" width="menu"', False) == "main" and html_text._kind("p", " title=x hidden", False) == "silent"
    assert html_text._kind("div", " class = 'ad box' data-x=\"1\"", True) == "aside" and html_text._kind("div", ' aria-hidden="true"', True) == "silent"


WORDS = "A sentence of the story that goes on for a while, and then ends."
SIDE = '<div class="sidebar"><h3>Popular</h3><ul><li><a href=x>thing one</a></li></ul><p>some blurb of the sidebar with several words</p></div>'
READERS = '<section id="comments"><h3>Comments</h3><article class="comment"><p>I liked this a lot, really.</p></article><p>so did I and all of my friends</p></section>'


@pytest.mark.parametrize("names", ["layout has-sidebar", "page nav-open", "no-js hidden-sidebar-right", "wrap has-banner", "print", "two-col side", "comments-open", "sidebar-left", "site-header-wrap"])
def test_wrappers_named_like_asides(names):
    """No class or id of what holds the article makes it go; asides within go."""
    body = "".join(f"<p>{WORDS}</p>" for _ in range(4))
    text = "\n".join([WORDS] * 4)
    for inner, main in ((body, text), (f"<article>{body}</article>", text), (f"<h1>A title</h1>{body}", f"A title\n{text}"), (f"<main><h1>A title</h1>{body}</main>", f"A title\n{text}")):
        for tail in ("", SIDE, READERS, SIDE + READERS):
            for tag, attribute in (("div", "class"), ("section", "id"), ("form", "class")):
                page = f'<html><body><nav><ul><li><a href="/a">one</a></ul></nav><{tag} {attribute}="{names}"><div>{inner}</div>{tail}</{tag}><footer>&copy; site</footer></body></html>'
                assert html_text.main_text(page) == main


def test_asides_of_no_wrapper():
    """What is named an aside goes where it holds no page: by its family also with articles in it."""
    body = f"<article><h1>A title</h1><p>{WORDS}</p></article>"
    for other in (SIDE, READERS, '<div class="related"><article><h3>More</h3><p>A teaser of another page.</p></article></div>', f'<form><label>Mail</label><p>{WORDS}</p></form>', f'<div class="newsletter"><p>{WORDS}</p></div>'):
        for page in (body + other, other + body, f"<main>{body}{other}</main>"):
            assert html_text.main_text(page) == f"A title\n{WORDS}"
    for page in (READERS, '<div class="ad"><p>Buy this, it is good and cheap and everybody has it by now, so should you, do not wait any longer.</p></div>'):
        assert html_text.main_text(page) == ""


def test_offsets_survive_other_cases():
    """Letters whose lower case is longer stand before scripts."""
    assert html_text.main_text(f"<p>{'İ' * 60} a</p><SCRIPT>if (a < b) '</p>'</ScRiPt ><p>{WORDS}</p>") == f"{'İ' * 60} a\n{WORDS}"


@pytest.mark.parametrize("piece", ["<a '", "<a x='", '<a x="', "<!", "<!--", "<a b='>' ", "<", "<script>", "<p", "<b>", "</p>", "<a =", "<![CDATA[", "&#", "<div class='ad'>"])
def test_broken_pages_take_linear_time(piece):
    import time

    took = []
    for n in (20_000, 160_000):
        page = piece * (n // len(piece))
        began = time.process_time()
        html_text.main_text(page)
        html_text.main_text(page + f"<article><p>{WORDS}</article>")
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5  # eight times the length


def test_weights_from_labelled_pages(spark):
    """Learned from a table of pages, tested on pages of other layouts."""
    rng = random.Random(4)
    sentence = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(6, 20))) + "."
    pages = []
    for k in range(120):
        main = [f"Title {k}", *(sentence() for _ in range(rng.randrange(2, 9)))]
        links = "".join(f'<li><a href="/{j}">topic {j}</a></li>' for j in range(rng.randrange(3, 15)))
        body = f"<h1>{main[0]}</h1>" + "".join(f"<p>{x}</p>" for x in main[1:])
        around = [f"<div>{{}}</div><ul>{links}</ul>", f"<ul>{links}</ul><div>{{}}</div>", f"<table><tr><td><ul>{links}</ul></td><td>{{}}</td></tr></table>"][k % 3]
        pages.append((k, around.format(body), "\n".join(main)))
    train = frame(spark, [p[1:] for p in pages if p[0] % 3 < 2] + [(None, "x"), ("<p>y", None)], "html string, text string")
    weights = html_text.weights_of(train)
    assert weights["plain"] > 0 > weights["t-link"] and weights != html_text.learned_weights()
    got = [html_text.main_text(page, weights) == main for k, page, main in pages if k % 3 == 2]
    assert np.mean(got) == 1
    rows = html_text.extract(frame(spark, [(k, None, p) for k, p, _ in pages], "page_id long, url string, html string"), train).collect()
    assert all(r.text == pages[r.page_id][2] for r in rows)
    assert html_text.weights_of(train.limit(0)) == html_text.learned_weights()


def test_page_rows(spark):
    """Repeated rows, nulls and further columns of clashing names."""
    schema = "page_id long, url string, html string, text int, n_chars string"
    page = f"<article><p>{WORDS}</article>"
    got = html_text.extract(frame(spark, [(1, "u", page, 1, "x"), (1, "u", page, 1, "x"), (None, None, page, None, None)], schema)).collect()
    assert sorted(tuple(r) for r in got if r[0]) == [(1, "u", WORDS, len(WORDS))] * 2 and len(got) == 3
    assert html_text.main_text("<p>" + "word " * 1_000_000) == ("word " * 1_000_000).strip()


def test_empty_pages(spark):
    schema = "page_id long, url string, html string"
    assert html_text.extract(frame(spark, [], schema)).count() == 0
    assert [tuple(r) for r in html_text.extract(frame(spark, [(1, None, None)], schema)).collect()] == [(1, None, "", 0)]


# ---- pipeline


def test_pipeline(spark, tables):
    """Each stage against brute force over what the one before it kept."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(9)
    vocabulary = {"en": ["the", "and", "thing", "with", "over"], "de": ["der", "und", "nicht", "über", "schön"]}
    data = []
    for k in range(120):
        lang = "de" if k % 3 == 0 else "en"
        data.append((k, " ".join(f"{rng.choice(vocabulary[lang])}{rng.choice('abcde')} {rng.choice(vocabulary[lang])}" for _ in range(60)), lang, "s", 0))
    data += [(200, data[5][1], "en", "s", 0), (201, data[6][1] + " more words", "en", "s", 0), (202, None, "en", "s", 0), (203, "1 2 3", "en", "s", 0), (204, data[7][1] + " mail a.b@c.example.org", "en", "s", 0)]
    leak = "eight words of the benchmark stand right here " * 1
    data += [(205, f"{data[8][1][::-1]} {leak}", "en", "s", 0)]
    docs = spark.createDataFrame(data, schema)
    import tempfile

    folder = tempfile.mkdtemp()
    spark.createDataFrame([(1, leak), (2, "short")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = common.written(cp.language_id(spark, docs, folder), "t1")
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert not ids & {202, 203} and len(ids & set(range(120))) >= 118
    one = common.written(cp.near_dedup(spark, kept, folder), "t2")
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    want = {i for i, (_, c) in exact_components(rows, 5, 80).items() if i == c}
    assert {r[0] for r in one.select("doc_id").collect()} == want
    clean = common.written(cp.decontamination(spark, one, folder), "t3")
    assert {r[0] for r in clean.select("doc_id").collect()} == want - {205}
    safe = common.written(cp.pii_surrogates(spark, clean, folder), "t4")
    assert safe.columns == cp.COLUMNS and safe.filter("n_chars <> length(text)").count() == 0 and safe.filter(F.col("text").contains("a.b@c.")).count() == 0
    pieces_hold(cp.packed(spark, safe, folder).collect(), [(r.doc_id, r.text) for r in safe.collect()])
    docs.write.parquet(f"{folder}/documents.parquet")
    assert cp.run(spark, folder).select("doc_id").distinct().count() == safe.count()
    empty = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, folder).count() == 0
