"""Substring and line dedup and the n-gram join against brute force."""

import hashlib
import random

import numpy as np
import pytest

from flatscan.llm.blocks import Blocks, block_size
from flatscan.llm.line_dedup import chunk_ends, chunks_of, line_dedup
from flatscan.llm.near_duplicates import depth_for, keep_one, near_duplicates, neighbours, sequences, verify, verify_sets
from flatscan.llm.substring_dedup import levels, substring_dedup
from flatscan.llm.words import hash_texts, ngrams

SCHEMA = "doc_id long, text string, n_words string, part int, block int, key string"


def rows_of(texts):
    """(doc_id, text) with extra columns whose names the operators use inside."""
    return [(i, t, "x", 1, 2, "k") for i, t in texts]


def corpus(seed, n=60):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passage = [" ".join(draw.choices(words, k=30)) for _ in range(3)]
    out = []
    for i in range(n):
        t = " ".join(draw.choices(words, k=draw.randint(0, 80)))
        if draw.random() < 0.4:
            t += "\n" + draw.choice(passage) + "\t" + " ".join(draw.choices(words, k=5))
        if draw.random() < 0.2 and out:
            t = draw.choice(out)[1]
        out.append((i, t))
    out += [(n, None), (n + 1, ""), (n + 2, " \n "), (None, out[3][1]), (5, out[3][1]), (5, out[3][1])]
    return out


def brute_substring(rows, k=13):
    last = float("inf")
    first = {}
    split = [(last if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            first[key] = min(first.get(key, last), i)
    out = []
    for i, w in split:
        gone = {q for p in range(len(w) - k + 1) if first[tuple(w[p : p + k])] < i for q in range(p, p + k)}
        out.append((len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("window", [13, 4, 20])
def test_substring_dedup_equals_brute_force(spark, seed, window):
    rows = corpus(seed)
    got = substring_dedup(spark.createDataFrame(rows_of(rows), SCHEMA), window=window, block_bytes=500).collect()
    want = brute_substring(rows, window)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=key) == sorted(
        ((i, n, m, None if t is None else kept) for (i, t), (n, m, kept) in zip(rows, want, strict=True)), key=key
    )
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert {r.part for r in got} == {1} and {r.key for r in got} == {"k"}


def test_levels_double_up_to_the_window():
    assert levels(13) == [7, 13] and levels(20) == [5, 10, 20] and levels(100) == [7, 13, 25, 50, 100] and levels(4) == [4]


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    assert substring_dedup(spark.createDataFrame(rows_of([(1, None)]), SCHEMA)).head().text is None


def test_substring_dedup_of_a_very_long_text(spark):
    long = " ".join(f"a{i}" for i in range(30_000))
    got = substring_dedup(spark.createDataFrame(rows_of([(1, long), (2, "x " + long)]), SCHEMA), block_bytes=1000).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, len(r.text.split())) for r in got] == [(30_000, 0, 30_000), (30_001, 30_000, 1)]


def brute_lines(rows):
    last = 1 << 62
    first = {}
    for i, t in rows:
        for s, _, body in chunks_of(None if t is None else t.encode())[1]:
            first[body] = min(first.get(body, (last + 1, 0)), (last if i is None else i, s))
    out = []
    for i, t in rows:
        lines, own = chunks_of(None if t is None else t.encode())
        gone = [(s, e) for s, e, body in own if (last if i is None else i, s) > first[body]]
        n = len(lines)
        for s, e in reversed(gone):
            del lines[s:e]
        out.append((i, None if t is None else b"\n".join(lines).decode(), n, sum(e - s for s, e in gone)))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_line_dedup_equals_brute_force(spark, seed):
    draw = random.Random(seed)
    pool = [f"line {i}" for i in range(30)] + ["", " "]
    shared = [draw.choices(pool, k=12) for _ in range(3)]
    rows = []
    for i in range(50):
        own = draw.choices(pool, k=draw.randint(0, 15))
        if draw.random() < 0.6:
            at = draw.randint(0, len(own))
            own[at:at] = draw.choice(shared)
        rows.append((i, "\n".join(own)))
    rows += [(50, None), (None, rows[1][1]), (7, rows[1][1]), (7, rows[1][1]), (51, "\n\n\n")]
    got = line_dedup(spark.createDataFrame(rows_of(rows), SCHEMA), block_bytes=200).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=key) == sorted(brute_lines(rows), key=key)
    assert sum(r.n_removed for r in got) > 0


def brute_runs(rows):
    """Lines that stay, by looking at every two neighbouring lines on their own."""
    last = 1 << 62
    split = [(last if i is None else i, [] if t is None else t.split("\n")) for i, t in rows]
    places = {}
    for i, w in split:
        for s in range(len(w) - 1):
            places.setdefault((w[s], w[s + 1]), []).append((i, s))
    out = []
    for (i, t), (d, w) in zip(rows, split, strict=True):
        old = [any(x < d or (x == d and k + 2 <= s) for x, k in [min(places[w[s], w[s + 1]])]) for s in range(len(w) - 1)]
        gone, s = set(), 0
        while s < len(old):
            e = s
            while e < len(old) and old[e]:
                e += 1
            if e > s and any(x.encode().split() for x in w[s : e + 1]):
                gone |= set(range(s, e + 1))
            s = e + 1
        out.append((i, None if t is None else "\n".join(x for q, x in enumerate(w) if q not in gone), len(w), len(gone)))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_whole_runs_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    pool = [f"line {i}" for i in range(30)] + ["", " "]
    rows = [(i, "\n".join(draw.choices(pool, k=draw.randint(0, 20)))) for i in range(50)]
    rows += [(50, None), (None, rows[1][1]), (7, rows[7][1]), (51, "\n\n\n"), (52, "\n\n\n"), (53, "a\na\na\na\na")]
    got = line_dedup(spark.createDataFrame(rows_of(rows), SCHEMA), block_bytes=200, whole_runs=True).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=key) == sorted(brute_runs(rows), key=key)


def test_whole_runs_find_every_repeated_passage(spark):
    passages = [[f"p{k} line {j}" for j in range(2 + k % 3)] for k in range(30)]
    own = lambda i, n: [f"own {i} {j}" for j in range(n)]
    rows = [(i, "\n".join(own(i, 1 + i % 4) + passages[i % 30] + own(-i - 1, 1 + i % 5))) for i in range(60)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows_of(rows), SCHEMA), whole_runs=True).collect()}
    assert [got[i].n_removed for i in range(60)] == [0] * 30 + [len(p) for p in passages]
    # the chunks of the contract lose some of them
    assert sum(x[3] for x in brute_lines(rows)) < sum(map(len, passages))


def test_ids_must_be_numbers(spark):
    table = spark.createDataFrame([("a", "b c")], "doc_id string, text string")
    for fn in (substring_dedup, line_dedup):
        with pytest.raises(TypeError, match="whole numbers"):
            fn(table)


def test_line_dedup_of_a_very_long_text(spark):
    long = [f"line {i}" for i in range(30_000)]
    rows = [(1, "\n".join(long)), (2, "\n".join(["own", *long, "last"])), (3, "x" * 500_000), (4, "x" * 500_000)]
    got = line_dedup(spark.createDataFrame(rows_of(rows), SCHEMA), block_bytes=1000, whole_runs=True).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_removed) for r in got] == [(30_000, 0), (30_002, 30_000), (1, 0), (1, 0)]
    assert got[1].text == "own\nlast" and got[3].text == rows[3][1]


def test_blocks_grow_with_the_root_of_the_input():
    assert [block_size(n << 20, 4 << 20) >> 20 for n in (1, 500, 1024, 4096, 30_000, 65_536, 1 << 30)] == [4, 4, 4, 8, 21, 32, 32]
    messages = [(n << 20) ** 2 / block_size(n << 20, 4 << 20) ** 2 / 4 / (n << 20) for n in (1024, 4096, 30_000, 65_536)]
    assert max(messages) < 1.01 * min(messages)


def test_repeated_rows_do_not_meet_in_one_block(spark):
    same = " ".join(f"w{i}" for i in range(40))
    table = spark.createDataFrame(rows_of([(1, same)] * 64 + [(2, same)] * 64), SCHEMA).repartition(8)
    assert Blocks(table, "doc_id", "text").rows.select("__block").distinct().count() > 6
    got = substring_dedup(table).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0)] * 64 + [(2, 40)] * 64


def test_line_dedup_of_nothing(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chunks_resist_shifts():
    lines = [f"some line {i}".encode() for i in range(200)]
    ends = {b"\n".join(lines[:e][-2:]) for e in chunk_ends(lines)[:-1]}
    moved = [b"new", *lines]
    again = {b"\n".join(moved[:e][-2:]) for e in chunk_ends(moved)[:-1]}
    assert len(ends & again) >= len(ends) - 2
    assert 2 <= 200 / len(chunk_ends(lines)) <= 5


def shingles(t):
    w = (t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_groups(rows, j=0.8):
    texts = sorted({t for _, t in rows if t is not None})
    sets = {t: shingles(t) for t in texts}
    links = {t: [u for u in texts if u != t and sets[t] and sets[u] and len(sets[t] & sets[u]) >= j * len(sets[t] | sets[u])] for t in texts}
    ids = {}
    for i, t in rows:
        ids.setdefault(t, []).append(float("inf") if i is None else i)
    none = lambda x: None if x == float("inf") else x
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, i, i, 0))
            continue
        seen, todo = {t}, [t]
        while todo:
            for u in links[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        out.append((i, none(min(min(ids[u]) for u in seen)), none(min(ids[t])), len(links[t])))
    return out


def near_corpus(seed, n=80):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    bases = [draw.choices(words, k=120) for _ in range(4)]
    for i in range(n):
        w = list(draw.choice(bases)) if draw.random() < 0.6 else draw.choices(words, k=draw.randint(0, 60))
        for _ in range(draw.randint(0, 3)):
            if w:
                w[draw.randrange(len(w))] = draw.choice(words)
        rows.append((i, " ".join(w)))
    return [*rows, (n, None), (n + 1, None), (n + 2, ""), (n + 3, ""), (n + 4, "a b"), (n + 5, "a  b"), (None, rows[3][1]), (3, rows[3][1]), (None, "only here is this text")]


@pytest.mark.parametrize("block", [256, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr("flatscan.llm.near_duplicates.BLOCK", block)
    rows = near_corpus(5)
    got = near_duplicates(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = brute_groups(rows)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert max(r.n_links for r in got) > 5


def test_keep_one_keeps_the_least_id_of_each_group(spark):
    rows = near_corpus(6)
    got = keep_one(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()
    groups = {(c, i if t is None else 0) for (i, t), (_, c, _, _) in zip(rows, brute_groups(rows), strict=True)}
    assert len(got) == len(groups)
    assert {r.doc_id for r in got} == {c for c, _ in groups}


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == [] and keep_one(empty).collect() == []


def test_prefixes_shorten_until_recall():
    assert depth_for(0.8) == 5 and depth_for(0.95) > depth_for(0.8) > depth_for(0.5)
    assert 1 - (1 - 0.8 ** depth_for(0.8)) ** 24 >= 0.9999


def test_a_link_counts_at_one_leader():
    text = " ".join(f"w{i}" for i in range(50)).encode()
    args = ([b"a", b"b"], [0, 0], [[3, 9], [3, 9]], [text, text + b" x"], 0.8)
    assert verify(3, *args) == [(b"a", 1, b"a"), (b"b", 1, b"a")]
    assert verify(9, *args) == [(b"a", 0, b"a"), (b"b", 0, b"a")]


def test_long_texts_at_the_threshold_are_linked():
    # 4 n shared shingles of 5 n: exactly 0.8
    for n in (1077, 1078, 1079, 1083, 1090, 1200, 1301, 1502, 1999):
        words = [f"w{i}" for i in range(5 * n + 4)]
        long, short = " ".join(words).encode(), " ".join(words[: 4 * n + 4]).encode()
        args = ([b"a", b"b"], [0, 0], [[3], [3]])
        assert verify(3, *args, [long, short], 0.8) == [(b"a", 1, b"a"), (b"b", 1, b"a")], n
        assert verify(3, *args, [long, short.rsplit(None, 1)[0]], 0.8) == [], n


def test_hot_runs_get_more_trees_and_large_leaders_are_compared_by_differences(spark, monkeypatch):
    monkeypatch.setattr("flatscan.llm.near_duplicates.HOT", 6)
    monkeypatch.setattr("flatscan.llm.near_duplicates.BLOCK", 5)
    monkeypatch.setattr("flatscan.llm.near_duplicates.GROUP_BYTES", 4000)
    monkeypatch.setattr("flatscan.llm.near_duplicates.SWEEP_ROWS", 40)
    rows = near_corpus(7)
    got = near_duplicates(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_groups(rows), key=key)


def test_sequences_are_tries_of_labels():
    texts = [" ".join(f"w{i}" for i in range(n)).encode() for n in (200, 200, 4, 195)]
    rows, some = sequences(texts)
    assert some.tolist() == [True, True, False, True] and (rows[0] == rows[1]).all()
    # a prefix of labels agrees more often than a longer one, and whole sequences least of all
    far = [" ".join(f"x{i if i % 40 else -i}" for i in range(k, 200 + k)).encode() for k in (0, 20)]
    (a, b), _ = sequences(far, range(64))
    shared = [int(((a ^ b) >> np.uint64(64 - 8 * d) == 0).sum()) for d in (1, 2, 4, 8)]
    assert shared == sorted(shared, reverse=True) and shared[0] > 40
    assert depth_for(0.8, trees=40) == 7


def test_neighbours_share_the_floor(spark):
    draw = random.Random(8)
    rows = [(t, draw.randrange(40) << 56 | draw.randrange(2) << 20, n) for n in range(300) for t in range(2)]
    rows = [(t, s - (1 << 64) if s >> 63 else s, n) for t, s, n in rows]
    table = spark.createDataFrame(rows, "tree int, sequence long, node long")
    count = {}
    for t, s, _ in rows:
        count[t, s >> 56] = count.get((t, s >> 56), 0) + 1
    got = {tuple(r) for r in neighbours(table, 600, 1).collect()}
    assert {r for r in rows if count[r[0], r[1] >> 56] > 1} <= got <= set(rows)


def test_differences_count_like_sets():
    draw = random.Random(9)
    base = draw.choices([f"w{i}" for i in range(300)], k=100)
    texts = [" ".join(base).encode()]
    for _ in range(12):
        w = list(base)
        for _ in range(draw.randint(1, 6)):
            w[draw.randrange(100)] = "new"
        texts.append(" ".join(w).encode())
    keys, blocks, leaders = [bytes([i]) for i in range(13)], [i % 2 for i in range(13)], [[5]] * 13
    sets = [np.unique(ngrams(hash_texts([t])[0], 5)) for t in texts]
    diffs = [np.setxor1d(s, sets[0]) for s in sets]
    common = [(len(s) + len(sets[0]) - len(d)) // 2 for s, d in zip(sets, diffs, strict=True)]
    assert verify(5, keys, blocks, leaders, texts, 0.8) == verify_sets(5, keys, blocks, leaders, diffs, [len(s) for s in sets], common, len(sets[0]), 0.8)


def test_near_duplicates_of_very_long_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(5, " ".join(words)), (3, " ".join(words[:58_000])), (4, " ".join(words[:40_000])), (9, "x" * 400_000), (8, "x" * 400_000), (7, "y" * 400_000)]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows_of(rows), SCHEMA)).collect())
    assert got == [(3, 3, 3, 1), (4, 4, 4, 0), (5, 3, 5, 1), (7, 7, 7, 0), (8, 8, 8, 0), (9, 8, 8, 0)]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from flatscan.sources.scratch import shared_folder

    unset = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("local-cluster[2,1,1024]", "spark://a:7077", "yarn"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master)))


def test_kept_text_digest_matches_contract(spark):
    from flatscan.llm.queries import op1_substring_dedup

    got = {r.doc_id: r for r in op1_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for (i, _), (n, m, kept) in zip(rows, brute_substring(rows), strict=True):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, m, hashlib.sha256(kept.encode()).hexdigest())
