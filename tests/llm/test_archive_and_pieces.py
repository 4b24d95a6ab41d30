"""WARC archives, sampled pieces, decontamination, and the registered queries."""

import base64
import collections
import glob
import gzip
import hashlib
import math
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from compare import differences
from flatscan.llm import queries, sql
from flatscan.llm.decontamination import Items, MultiIndex, decontaminate, decontamination, matches, shingles, simhash, weighted_jaccard
from flatscan.llm.pieces import decode, decode_ids, encode, encode_texts, vocabulary
from flatscan.llm.warc import base32_sha1, read_archive, write_archive
from flatscan.llm.words import mix

MODEL = queries.PIECE_MODEL
PAGES = "page_id long, url string, html string, sha string, shard int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


ROWS = [
    (1, "http://a/1", "same"),
    (2, None, "same"),
    (3, "http://a/3\r\nX: y", "other é \U0001f600 \r\n\r\nWARC/1.1"),
    (4, "http://a/4", None),
    (5, "http://a/5", ""),
    (5, "http://a/5", ""),
    (None, "http://a/n", "same"),
    (None, "http://a/n", "alone"),
    (7, "http://a/7", "z" * 300_000),
]


@pytest.mark.parametrize("shard_bytes", [16 << 20, 100])
def test_archive_round_trip(spark, tmp_path, shard_bytes):
    uri = f"file://{tmp_path}/w"
    manifest = write_archive(pages(spark, ROWS), uri, shard_bytes=shard_bytes, roll_bytes=600)
    assert sum(r.records for r in manifest.collect()) == len(ROWS)
    got = read_archive(spark, uri).collect()
    newest = collections.defaultdict(lambda: -1)
    for i, _, h in ROWS:
        newest[h or ""] = max(newest[h or ""], -1 if i is None else i)
    want = []
    for i, _, h in ROWS:
        data, top = (h or "").encode(), newest[h or ""]
        revisit = top >= 0 and i != top
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all(base32_sha1(r.payload) == r.payload_digest for r in got if r.record_type == "response")
    assert not glob.glob(f"{tmp_path}/w/.part*.gz.*") and len(glob.glob(f"{tmp_path}/w/*.warc.gz")) > 1


def test_archive_is_deterministic(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, f"http://a/{i}", str(draw.random())) for i in range(300)]
    sums = []
    for k, own in enumerate((rows, rows[::-1])):
        write_archive(pages(spark, own).repartition(3 + k), f"file://{tmp_path}/{k}", shard_bytes=1000, roll_bytes=2000)
        sums.append({os.path.basename(f): hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{tmp_path}/{k}/*.gz")})
    assert sums[0] == sums[1] and len(sums[0]) > 3


def test_archive_records_are_gzip_members(spark, tmp_path):
    write_archive(pages(spark, ROWS[:3]), f"file://{tmp_path}/w")
    (name,) = glob.glob(f"{tmp_path}/w/*.warc.gz")
    data = gzip.decompress(open(name, "rb").read())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and data.count(b"WARC-Type: revisit") == 1
    with pytest.raises(Exception, match="manifest already"):
        write_archive(pages(spark, ROWS[:3]), f"file://{tmp_path}/w")


def test_small_payloads_are_never_revisits(spark, tmp_path):
    write_archive(pages(spark, ROWS), f"file://{tmp_path}/w", min_bytes=1)
    assert {r.record_type for r in read_archive(spark, f"file://{tmp_path}/w").where("payload_bytes = 0").collect()} == {"response"}


def test_shards_are_bounded_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("flatscan.llm.warc.MAX_SHARDS", 3)
    monkeypatch.setattr("flatscan.llm.warc.MAX_SAMPLE", 30)
    rows = [(i, f"http://a/{i}", f"text {i}") for i in range(300)]
    manifest = write_archive(pages(spark, rows), f"file://{tmp_path}/w", shard_bytes=10).collect()
    assert {r.shard for r in manifest} == {0, 1, 2} and sum(r.records for r in manifest) == 300
    assert sorted(r.key for r in read_archive(spark, f"file://{tmp_path}/w").collect()) == list(range(300))


def test_a_task_that_runs_again_replaces_its_files(spark, tmp_path):
    from flatscan.llm import warc

    uri = f"file://{tmp_path}/w"
    os.makedirs(f"{tmp_path}/w/{warc.UNNAMED}")
    for lost in ("x", "y"):
        open(f"{tmp_path}/w/{warc.UNNAMED}/part-000000-000000.warc.gz.{lost}", "w").close()
    first = [list(w.add(warc.page_record(1, None, b"a", None))) + list(w.close()) for w in (warc.ShardWriter(uri, 0, 100),) * 2]
    assert first[0][0][2] == "part-000000-000000.warc.gz"
    write_archive(pages(spark, ROWS), uri)
    assert not os.path.exists(f"{tmp_path}/w/{warc.UNNAMED}")
    assert len(read_archive(spark, uri).collect()) == len(ROWS)


def test_archive_of_nothing(spark, tmp_path):
    write_archive(pages(spark, []), f"file://{tmp_path}/w")
    assert read_archive(spark, f"file://{tmp_path}/w").collect() == []


TEXTS = ["Hello  wörld\n x", "", "a", " ", " \n\n", "▁lit▁eral ▁", "日本語 emoji 😀😀", "x" * 3000, "\x00\x01", "  lead", "trail  ", "\ttab\r\n"]


def test_pieces_round_trip_and_agree_with_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    v, model = vocabulary(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    data = [t.encode() for t in TEXTS]
    ids, n = encode_texts(data, list(range(len(data))), v, 1.0, 0)
    assert decode_ids(ids, n, v) == data
    for t, own in zip(TEXTS, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert model.decode(own.tolist()) == t


def all_paths(word, v):
    by = {p: i for i, p in enumerate(v.parts) if p and v.byte_ids[p[0]] != i}
    out = {}

    def walk(at, ids, weight):
        if at == len(word):
            out[tuple(ids)] = weight
        for end in range(at + 1, len(word) + 1):
            if (i := by.get(word[at:end])) is not None:
                walk(end, [*ids, i], weight + v.weight[i])

    walk(0, [], 0.0)
    total = sum(map(math.exp, out.values()))
    return {k: math.exp(x) / total for k, x in out.items()}


def test_samples_follow_the_lattice():
    v, n = vocabulary(MODEL), 20_000
    want = all_paths(b" there", v)
    ids, counts = encode_texts([b"there"] * n, list(range(n)), v, 1.0, 0)
    seen = collections.Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1]))
    assert set(seen) <= set(want)
    assert all(abs(seen[k] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3 for k, p in want.items())


def plain_pieces(text, key, v, seed=0):
    """The pieces of a text by plain loops: sums of path weights to each place, then draws from the end of each word."""
    by = {p: i for i, p in enumerate(v.parts) if p and v.byte_ids[p[0]] != i}
    row, out = xxhash.xxh3_64_intdigest(str(key), seed), []
    m = (1 << 64) - 1

    def mixed(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & m
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & m
        return h ^ (h >> 31)

    for place, word in enumerate(re.findall(rb" *[^ \n]+| +|\n", b" " + text) if text else []):
        edges = {j: [] for j in range(len(word) + 1)}
        at = 0
        for c in word.decode().encode("utf-32-le").decode("utf-32-le"):
            n = len(c.encode())
            for size in range(1, v.longest + 1):
                if at + size <= len(word) and (i := by.get(word[at : at + size])) is not None:
                    edges[at + size].append((size, i))
            if word[at : at + n] not in by:
                for k in range(n):
                    edges[at + k + 1].append((1, int(v.byte_ids[word[at + k]])))
            at += n
        total = {0: 0.0}
        for j in range(1, len(word) + 1):
            own = [total[j - n] + v.weight[i] for n, i in edges[j] if j - n in total]
            if own:
                total[j] = max(own) + math.log(sum(math.exp(x - max(own)) for x in own))
        start, back, step = mixed((row + place * 0x9E3779B97F4A7C15) & m), [], 0
        j = len(word)
        while j:
            step += 1
            draw, upto = (mixed((start + step) & m) >> 11) * 2.0**-53, 0.0
            for n, i in sorted(edges[j]):
                if j - n not in total:
                    continue
                upto += math.exp(total[j - n] + v.weight[i] - total[j])
                if draw < upto:
                    break
            back.append(i)
            j -= n
        out += back[::-1]
    return out


def test_pieces_equal_a_plain_version():
    v = vocabulary(MODEL)
    draw = random.Random(11)
    texts = [*TEXTS, "".join(draw.choices("abcdefgh+/=", k=1500)), "天地玄黄宇宙洪荒日月盈昃辰宿列张" * 40, "the quick brown fox jumps over it " * 8]
    data = [t.encode() for t in texts]
    ids, n = encode_texts(data, list(range(len(data))), v, 1.0, 0)
    got = np.split(ids, np.cumsum(n)[:-1])
    same = [g.tolist() == plain_pieces(t, k, v) for k, (g, t) in enumerate(zip(got, data, strict=True))]
    assert all(same), [texts[k][:20] for k, x in enumerate(same) if not x]


def test_the_query_equals_a_plain_version(spark):
    sf, v = "/root/testdata/sf0.001", vocabulary(MODEL)
    got = {r.doc_id: r for r in queries.op10_sentencepiece(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, t in rows:
        want = plain_pieces((t or "").encode(), i, v)
        assert got[i].n_pieces == len(want) and got[i].lossless
        assert b"".join(v.parts[k] for k in want)[1:] == (t or "").encode()
        assert got[i].decoded_sha256 == (None if t is None else hashlib.sha256(t.encode()).hexdigest())


def test_long_words_take_time_in_proportion():
    v = vocabulary(MODEL)
    draw = random.Random(12)
    word = "".join(draw.choices("ABCDEFabcdef0123456789+/", k=1_000_000)).encode()
    began = time.perf_counter()
    ids, n = encode_texts([word], [1], v, 1.0, 0)
    assert decode_ids(ids, n, v) == [word] and time.perf_counter() - began < 60
    chinese = ("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏" * 2000).encode()
    assert decode_ids(*encode_texts([chinese, chinese], [1, 2], v, 1.0, 0), v) == [chinese] * 2


def test_samples_depend_on_the_key_alone(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, "the quick brown fox " * 20])] + [(99, None, "x"), (None, "abc def", "x"), (12, "the quick brown fox " * 20, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    a = decode(encode(table, MODEL), MODEL).collect()
    b = encode(table.repartition(5), MODEL).collect()
    key = lambda r: (str(r.doc_id), str(r.pieces))
    assert sorted(map(key, a)) == sorted(map(key, b))
    assert all(r.text == r.decoded for r in a) and [r.pieces for r in a if r.doc_id == 99] == [None]
    both = encode(table, MODEL, decoded="decoded").collect()
    assert sorted(map(key, a)) == sorted(map(key, both)) and all(r.text == r.decoded for r in both)
    fox = {str(r.pieces) for r in a if r.text and r.text.startswith("the quick")}
    assert len(fox) == 1
    assert {str(r.pieces) for r in encode(table, MODEL, seed=1).collect()} != {str(r.pieces) for r in a}
    assert encode(table.limit(0), MODEL).collect() == []


def test_multi_index_finds_all_within_the_radius():
    draw = np.random.default_rng(1)
    prints = draw.integers(0, 1 << 64, 300, np.uint64)
    index = MultiIndex(prints)
    for i in range(50):
        x = int(prints[i]) ^ sum(1 << int(k) for k in draw.choice(64, draw.integers(0, 30), replace=False))
        want = {k for k, p in enumerate(prints.tolist()) if (p ^ x).bit_count() <= index.radius}
        assert set(index.near(x).tolist()) == want


def test_wide_index_meets_few_and_loses_none_of_the_similar():
    draw = np.random.default_rng(5)
    items = draw.integers(0, 1 << 64, (20_000, 45), np.uint64)
    prints = simhash(items, 4)
    index = MultiIndex(prints, 66, 16, 2)
    windows = items[:400].copy()
    windows[:, :5] = draw.integers(0, 1 << 64, (400, 5), np.uint64)  # 40 of 50 shingles: exactly 0.8
    asked = simhash(windows, 4)
    assert all(i in index.near(x) for i, x in enumerate(asked))
    assert np.mean([len(index.met(x)) for x in asked[:100]]) < 0.05 * len(items)
    # both ways of looking a block up find the same, and all within the guaranteed radius
    few = MultiIndex(prints[:500], 47, 16, 2)
    for x in asked[:20]:
        far = np.bitwise_count(prints[:500] ^ x).sum(axis=1, dtype=np.int64)
        assert set(few.near(x).tolist()) == set(np.flatnonzero(far <= 47).tolist())
        assert set(few.met(x).tolist()) == {i for i in index.met(x).tolist() if i < 500}


def test_simhash_is_near_for_near_windows():
    s = np.random.default_rng(2).integers(0, 1 << 64, (1, 40), np.uint64)
    near = s.copy()
    near[0, :3] = 1
    far = np.random.default_rng(3).integers(0, 1 << 64, (1, 40), np.uint64)
    bits = lambda a, b: int(np.bitwise_count(simhash(a) ^ simhash(b))[0])
    assert bits(s, near) < 16 < bits(s, far)


def test_refrains_do_not_pass_the_radius():
    draw = np.random.default_rng(4)
    for n, repeats in ((45, 5), (90, 10), (180, 20)):
        for _ in range(40):
            s = draw.integers(0, 1 << 64, n - repeats + 2, np.uint64)
            item, text = (np.concatenate([s[2:], np.full(repeats, x)]) for x in s[:2])
            assert matches(text, Items(["q"], [item]), 0.8) == [(0, 0.8, 0)]


def brute_items(text, items, j=0.8):
    s = shingles((text or "").encode())
    out = {}
    for i, t in items:
        own = shingles((t or "").encode())
        best = max((weighted_jaccard(s[k : k + len(own)], own) for k in range(len(s) - len(own) + 1)), default=0) if len(own) else 0
        if best >= j:
            out[i] = best
    return out


def test_decontamination_equals_brute_force(spark):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(15, 40)))) for i in range(12)] + [(50, None), (51, "too short"), (None, "a b c d e f g h i j")]
    items.append((60, items[0][1]))
    texts = [None, "", "w1 w2"]
    for _ in range(60):
        t = draw.choices(words, k=draw.randint(0, 60))
        if draw.random() < 0.6:
            own = draw.choice(items[:12])[1].upper().split()
            if draw.random() < 0.5:
                own[-1 if draw.random() < 0.5 else len(own) // 2] = "changed"
            t[len(t) // 2 : len(t) // 2] = own
        texts.append(draw.choice([" ", "\n", ", "]).join(t))
    texts += [texts[5], "x " * 20_000 + items[3][1]]
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, similarity int")
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    for limit in (16 << 20, 500):
        got = decontamination(table, bench, item_bytes=limit).collect()
        want = {(i, k): j for i, t in enumerate(texts) for k, j in brute_items(t, items).items()}
        assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(j, 9) for k, j in want.items()}
        assert len(got) == len(want) > 20
        clean = decontaminate(table, bench, item_bytes=limit)
        assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(len(texts)) if i not in {k for k, _ in want}]
        assert clean.columns == table.columns
    none = bench.limit(0)
    assert decontamination(table, none).collect() == [] and decontaminate(table, none).count() == len(texts)
    assert decontamination(table.limit(0), bench).collect() == []


def test_a_text_shorter_than_an_item_is_compared_whole(spark):
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(words[:48]), " ".join(words[3:46]), " ".join(words[:41]), " ".join(words[5:45])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[::-1]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontamination(table, bench).collect()}
    assert got == {(0, 1): (44 / 46, 0), (1, 1): (39 / 46, 0), (2, 1): (37 / 46, 0)}
    assert [r.doc_id for r in decontaminate(table, bench).collect()] == [3]


@pytest.mark.parametrize("k", [533562, 554747, 673187, 700609])
def test_pairs_that_the_fingerprints_miss_are_found(k):
    s = mix(np.arange(k * 50, k * 50 + 50, dtype=np.uint64))
    item, window = s[:45], np.concatenate([s[45:], s[5:45]])  # 40 of 50 shingles: exactly 0.8
    items = Items(["q"], [item])
    own = MultiIndex(simhash(np.stack([item] * 600), 4), 66, 16, 2)
    assert not len(own.near(simhash(window[None], 4)[0]))
    assert matches(window, items, 0.8) == [(0, 0.8, 0)]
    other = mix(np.arange(3, dtype=np.uint64))
    assert matches(np.concatenate([other, window, other]), items, 0.8) == [(0, 0.8, 3)]


@pytest.mark.parametrize("similarity", [0.1, 0.3, 0.5, 0.7, 0.8, 1.0])
def test_every_similarity_finds_the_best_window_of_each_item(similarity):
    draw = random.Random(13)
    few, many = list(range(6)), list(range(6, 90))
    sets = [draw.choices(few if k % 3 == 0 else many, k=draw.randint(1, 40)) for k in range(30)]
    sets += [sets[1], sets[2][::-1], [3] * 20, [3] * 20]
    shared = [mix(np.array(x, np.uint64)) for x in sets]
    items, n = Items(list(range(len(sets))), shared), 0
    for _ in range(50):
        text = draw.choices(draw.choice((few, many)), k=draw.randint(0, 60))
        for _ in range(draw.randint(0, 3)):
            kept = draw.choice((0.6, 0.9, 1.0))
            own = [x if draw.random() < kept else draw.choice(many) for x in draw.choice(sets)]
            at = draw.randint(0, len(text))
            text[at:at] = own
        s = mix(np.array(text, np.uint64))
        want = []
        for i, x in enumerate(shared):
            windows = [s[k : k + len(x)] for k in range(max(1, len(s) - len(x) + 1))] if len(s) else []
            j, k = max(((weighted_jaccard(w, x), -k) for k, w in enumerate(windows)), default=(0, 0))
            if j >= similarity:
                want.append((i, j, -k))
        assert matches(s, items, similarity) == want
        n += len(want)
    assert n > 20


def test_lower_similarities_lose_no_row(spark):
    draw = random.Random(14)
    word = lambda: f"w{draw.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(44))) for i in range(40)]
    texts = []
    for _, t in items:
        own = t.split()
        own[:13] = [word() for _ in range(13)]  # 27 of 53 shingles: just over 0.5
        texts.append(" ".join([word(), *own, word()]))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontamination(table, bench, similarity=0.5).collect())
    assert got == [(i, i, 27 / 53, 1) for i in range(40)]
    assert decontaminate(table, bench, similarity=0.5).count() == 0


def test_case_beyond_ascii_is_that_of_the_sql(spark, tmp_path):
    rest = " ".join(f"w{i}" for i in range(12))
    items = [f"istanbul {rest}", f"ο δροσοσ {rest}", f"ÉCOLE straße {rest}", f"i\u0307zmir {rest}"]
    texts = [f"İSTANBUL {rest}", f"Ο ΔΡΟΣΟΣ {rest}", f"école STRAßE {rest}", f"I\u0307ZMIR {rest}", f"ο δροσος {rest}", f"\u212aİ ΣΑΣ {rest}"]
    for name, id, rows in (("documents", "doc_id", texts), ("benchmark", "item_id", items)):
        pq.write_table(pa.table({id: pa.array(range(len(rows)), pa.int64()), "text": rows}), tmp_path / f"{name}.parquet")
    out = queries.queries()["op3_benchmark_decontamination"](spark, str(tmp_path))
    assert differences(out, sql.oracle_sql()["op3_benchmark_decontamination"], str(tmp_path)) == []
    assert {(r.doc_id, r.item_id) for r in out.collect() if r.similarity == 1} == {(i, i) for i in range(4)}


def test_every_operator_has_a_query():
    names = sorted(queries.queries(), key=lambda k: int(k[2:].split("_")[0]))
    assert [int(k[2:].split("_")[0]) for k in names] == list(range(1, 11))
    assert set(sql.oracle_sql()) <= set(names)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in docs.collect()}
    assert 0 < len(got) < len(ids) and {r.doc_id for r in got} <= ids
    assert all(r.lossless and len(r.pieces) == r.n_pieces for r in got)
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumn("extra", docs.lang), sf)
        assert out.columns == [*docs.columns, "extra"]
        assert stage(spark, docs.limit(0), sf).count() == 0
