"""Byte-level BPE, lexical search and the prefix trie against plain Python."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.llm import byte_bpe, cap_filters, decontaminate, lexical_search, prefix_trie, store, token_histogram

tiktoken = pytest.importorskip("tiktoken")
# Fixed value: the public vocabulary's pattern as its library writes it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks(byte_bpe.VOCABULARY), special_tokens={})


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "clash", [1]) for i, t in rows], "doc_id long, text string, ids string, bytes array<int>")


def hashed(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def encoded(spark, rows):
    tokens = byte_bpe.encode(documents(spark, rows))
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(tokens.select("doc_id", "ids")).collect()}
    return tokens.collect(), back


def test_bpe_equals_the_library(spark, library):
    r = random.Random(3)
    odd = ["", " ", "\n\n a  b\t\r\n", "I'll we've it's 'S don't", "<|endoftext|>", "x" * 20_000, "ab" * 3000, "aaab" * 3000, "\x00\x1c\x1d\x85​ 　 z",
           "é \U0001F600\U0001F3FD กำ 你好世界 " * 50, "".join(chr(r.randrange(97, 123)) for _ in range(3000)),
           "".join(chr(r.choice([r.randrange(1, 0x250), r.randrange(0x370, 0xD7FF), r.randrange(0xE000, 0x1FFFF)])) for _ in range(6000)), "1" * 5000 + " ½²Ⅷ३"]
    rows = [*enumerate(odd), (100, None), (3, odd[3]), (3, odd[3]), (None, "no id")]
    got, back = encoded(spark, rows)
    assert len(got) == len(rows)
    for x in got:
        t = "no id" if x.doc_id is None else next(t for i, t in rows if i == x.doc_id) or ""
        want = library.encode_ordinary(t)
        assert (x.ids, x.n_tokens, x.ids_sha256) == (want, len(want), hashed(want))
        assert back[x.doc_id] == t.encode()
    assert byte_bpe.decode(byte_bpe.encode(documents(spark, []))).count() == 0


def test_bpe_of_every_character(spark, library):
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(i, "".join(f"a{c}1{c} {c}{c}" for c in chars[i:i + 2000])) for i in range(0, len(chars), 2000)]
    tokens = byte_bpe.encode(documents(spark, rows).repartition(4)).collect()
    texts = dict(rows)
    assert all(x.ids == library.encode_ordinary(texts[x.doc_id]) for x in tokens)


def test_bpe_of_long_runs(spark, library):
    n = 1_000_000
    one = {c: library.encode_ordinary(c)[0] for c in (" ", " a", "\t", "\n")}
    got, back = encoded(spark, [(0, " " * n + "a"), (1, "\t" * n), (2, "x" * n), (3, "7" * n), (4, "word " * 500_000)])
    ids = {x.doc_id: x.ids for x in got}
    assert ids[0] == [one[" "]] * (n - 1) + [one[" a"]] and ids[4][1:-1] == library.encode_ordinary(" word") * 499_999
    assert back[1] == b"\t" * n and back[2] == b"x" * n and back[3] == b"7" * n
    # the library's own result on a length it takes, as the run's repeated middle
    for i, c in ((1, "\t"), (2, "x"), (3, "7")):
        assert set(ids[i]) <= set(library.encode_ordinary(c * 20_000)) | set(library.encode_ordinary(c * 20_001))


def test_vocabulary_makes_entries_of_lower_ones():
    assert byte_bpe.well_ordered(byte_bpe.ranks(byte_bpe.VOCABULARY))
    few = {bytes([b]): b for b in range(256)}
    assert byte_bpe.well_ordered(few | {b"ab": 256, b"abc": 257}) and not byte_bpe.well_ordered(few | {b"abc": 256, b"ab": 257})


def ranked(docs, items, k):
    low = str.maketrans(lexical_search.UPPER, lexical_search.LOWER)
    words = [(i, re.findall(lexical_search.TERM, (t or "").translate(low))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, length = len(words), sum(len(w) for _, w in words)
    df, out = Counter(x for _, w in words for x in set(w)), []
    for item, text in items:
        q = Counter(re.findall(lexical_search.TERM, (text or "").translate(low)))
        scores = []
        for i, w in words:
            m, tf = 25 + (75 * len(w) * n_docs) // length, Counter(w)
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, c in q.items() if tf[t])
            scores.append((-s, i is None, i or 0, i, s))
        out += [(item, r, x[3], x[4]) for r, x in enumerate(sorted(x for x in scores if x[4] > 0)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("k,block", [(10, 200_000), (3, 40), (1000, 200_000)])
def test_search(spark, k, block):
    r = random.Random(4)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 3))) for _ in range(120)]
    say = lambda n: " ".join(min(r.choice(words), r.choice(words)) for _ in range(n))
    docs = [(i, say(r.choice([1, 5, 40, 200]))) for i in range(150)] + [(200, None), (201, ""), (202, " ,. "), (203, "A" * 9000), (204, "rare " * 30_000)]
    docs += [(5, docs[5][1])] * 3 + [(300 + i, docs[7][1].upper()) for i in range(40)] + [(None, docs[7][1]), (None, docs[7][1])]
    items = [(i, say(r.choice([1, 6, 30]))) for i in range(12)] + [(50, None), (51, ""), (52, "zzz nowhere"), (53, "rare rare RARE"), (3, "a b a"), (3, "a b a"),
                                                                 (54, " ".join(words) + " x1 x2")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n long").repartition(5)
    q = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = lexical_search.search(d, q, k, block)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(str(tuple(x)) for x in got.collect()) == ranked(docs, items, k)
    assert lexical_search.search(d.limit(0), q, k).count() == 0 and lexical_search.search(d, q.limit(0), k).count() == 0


def test_masks_group_by_terms():
    r = np.random.default_rng(1)
    held = r.random((300, 130)) < 0.02
    held[200:] = held[:100]
    present, rows, first = lexical_search.masks(300, [np.flatnonzero(held[:, t]) for t in range(130)])
    assert sorted(rows.tolist()) == np.flatnonzero(held.any(axis=1)).tolist() and len(np.unique(present, axis=0)) == len(present)
    for g, (a, b) in enumerate(zip(first, np.append(first[1:], len(rows)), strict=True)):
        assert (held[rows[a:b]] == present[g]).all()


def plain_trie(rows):
    """rows: (conv_id, turn, role, text)"""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, text[:32], hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(t[2], t[5]) for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = ((len(members[p]) - 1) * len(re.findall(prefix_trie.WORD, p[-1][1])) if p else 0) + sum(saved[x] for x in children[p])
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
    return sorted(str((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                       hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())) for p, m in members.items())


def conversation_rows():
    r, rows = random.Random(7), []
    say = lambda: r.choice(["yes", "no", "a b", "", None, "long  words\there\n", "é"])
    for c in range(130):
        if c % 11:
            rows += [(c, t, "user" if t % 2 == 0 else "assistant", say()) for t in range(r.randint(1, 7))]
    rows += [(200 + i, t, "user", f"same {t}") for i in range(60) for t in range(9)] + [(r.choice([260, 261]), t, "user", "z") for t in range(50)]
    rows += [(400, t, "user", f"hot {t // 2}") for t in range(700)] + [(400 + 20 * i, t, "user", f"hot {t // 2}") for i in (1, 2) for t in range(699 + i)]
    rows += [(500, None, None, None), (500, None, "b", None), (500, 3, None, "x"), (500, 3, "a", "x"), (None, 1, "user", "lost"), (521, 0, "user", "one"), (-7, 0, "user", "neg")]
    return rows + [(3, 0, "user", "twice")] * 2 + [(600, 0, "user", "w " * 100_000)]


@pytest.mark.parametrize("level,range_rows", [(512, 8192), (512, 20), (3, 25), (4, 8192), (1, 60)])
def test_trie(spark, level, range_rows):
    rows = conversation_rows()
    if level < 10:
        rows = [x for x in rows if x[1] is None or x[1] < 40]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn int, role string, text string, depth int").repartition(6)
    turns, lengths = prefix_trie.rebuilt(prefix_trie.turn_rows(df))
    got = prefix_trie.trie(store.save(turns, "t"), lengths, level, range_rows)
    assert sorted(str(tuple(x)) for x in got.collect()) == plain_trie(rows)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turn_rows(df))).count() == 0
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn int, role string, text string")
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turn_rows(df))).count() == 0


def test_turns_are_numbered_across_ranges(spark):
    """One conversation with most rows, in many ranges; equal turns are ordered by role and text."""
    rows = [(1, i // 3, "r", f"t{i % 3}") for i in range(3000)] + [(c, 0, "r", "x") for c in range(2, 50)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.numbered(prefix_trie.turn_rows(df)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    key = {hashlib.sha256(f"1:rt{i}".encode()).hexdigest()[:32]: i for i in range(3)}
    one = {x.place: key[x.key] for x in got if x.c == 1}
    assert sorted(one) == list(range(1, 3001)) and all(one[p] == (p - 1) % 3 for p in one) and all(x.place == 1 for x in got if x.c > 1)


def test_token_counts_of_long_white_space(spark, library):
    """The library's expressions fail on these; the pieces are known."""
    n = 10 ** 6
    one = {c: library.encode_ordinary(c)[0] for c in ("\t", "\n")}
    texts = {" " * n + "a": n, " " * n: n, "a" + " " * n + "\t" * 5 + "b": None, "\t" * n + "a": n + 1, "x" * n: len(library.encode_ordinary("x" * n)),
             "7" * n: len(library.encode_ordinary("7" * n)), "a" + "\n" * (n + 1) + " b": None}
    for t, want in texts.items():
        got = token_histogram.count(token_histogram.VOCABULARY, t)
        assert got == want if want else got > n / 2
    r = random.Random(2)
    for _ in range(300):     # every cut, against the library on runs it takes
        t = "".join(r.choice(["a", "b c", " " * r.randint(1, 40), "\t\t", "\n" * 30, "'s", "1", " \n \t" * 8]) for _ in range(r.randint(1, 12)))
        parts = []
        for m in re.split(r"(\s{20,})", t):
            parts.append(m)
        old, token_histogram.RUN = token_histogram.RUN, 20
        token_histogram._long_run.cache_clear()
        try:
            assert token_histogram.count(token_histogram.VOCABULARY, t) == len(library.encode_ordinary(t)), repr(t)
            assert "".join(p for _, p in token_histogram.cut(t)) == t
        finally:
            token_histogram.RUN = old
            token_histogram._long_run.cache_clear()
    assert one and [x.n_tokens for x in token_histogram.lengths(documents(spark, [(0, " " * n + "a")])).collect()] == [n]


def test_caps_of_mixed_lengths(spark):
    """Most vectors of one length, the links among those of another."""
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((3000, 64)).tolist())]
    for i, x in enumerate(rng.standard_normal((200, 256))):
        for k in range(3):
            rows.append((10_000 + 3 * i + k, (x + rng.standard_normal(256) * 0.3).tolist()))
    got = {r.vec_id: r.n_links for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = np.array([v for i, v in rows if i >= 10_000])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert want.sum() > 1000 and [got[10_000 + i] for i in range(600)] == want.tolist()


def test_repetitive_texts_against_plain_bands():
    """A periodic item in a periodic text: the same bands as by plain counting, and time linear in the text."""
    unit = "abcd efgh"
    items = [(1, (unit * 30)[:270]), (2, "some other words that are not periodic at all in here")]
    ix = decontaminate._finished(decontaminate.index(items, 0.1))
    text = "intro words " + unit * 60 + " and some other words that are not periodic at all in here " + unit * 30
    x = decontaminate.normal(text)[0]
    old = decontaminate.HITS
    try:
        seen = []
        for decontaminate.HITS in (10 ** 6, 500, 1):
            seen.append(sorted(decontaminate._bands(ix, x)))
    finally:
        decontaminate.HITS = old
    plain, g = [], decontaminate.qgrams(x).tolist()
    for i, (_, p, k) in enumerate(ix["items"]):
        w, least, q = 2 * k + 1, int(ix["least"][i]), decontaminate.qgrams(p).tolist()
        found = defaultdict(set)
        for a, y in enumerate(g):
            for o, z in enumerate(q):
                if y == z:
                    band = (a - o + ix["longest"]) // w
                    found[band].add(o)
                    found[band - 1].add(o)
        plain += [(i, b * w - ix["longest"], (b + 2) * w - 1 - ix["longest"], len(s)) for b, s in found.items() if b >= 0 and len(s) >= least]
    assert seen[0] == seen[1] == seen[2] == sorted(plain)
    start = time.time()
    found = decontaminate.matches(ix, [unit * 111_112])[0]
    took = time.time() - start
    assert len(found) > 3000 and took < 30, took      # a megabyte; the scan by bands took hours
