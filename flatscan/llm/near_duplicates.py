"""N-gram Jaccard join over a MinHash LSH forest.

A text is its set of five-word shingles; equal texts form one class. In each tree
of the forest a class has a sequence of eight labels (a byte each, the first one
highest), so a tree's sorted sequences are its prefix trie: classes that share a
prefix stand side by side. One sweep over the range-sorted sequences compares
neighbours and keeps those that share a prefix of the tree's floor.

Prefixes are shortened from eight labels on, a class at a time. The first trees'
floor is the longest prefix at which a pair at the similarity meets in one of them
with the target probability. A prefix whose run at the floor holds more than HOT
classes isn't shortened: its classes keep whole sequences there and get more
trees, whose floor is longer because they are more. These are drawn apart from the
first, so that a pair of such classes meets in them with the target probability
whatever the first trees said.

Every run elects a leader. The classes of a small leader are verified against each
other in one task. A large one's are turned into differences from the leader's
set, a few shingles for near copies, in slices of bounded bytes; blocks of those
meet in pairs. All pairs are compared by exact Jaccard similarity. Pairs stay
inside the verifying task: it returns a row a class, with its number of links and
the least class that it is linked to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, fresh, pieces_for
from .words import chunks, hash_texts, inside, ngrams

SHINGLE = 5
LABELS = 8
TREES = 24
MORE_TREES = 40
RECALL = 0.9999
#: A run at the floor with more classes than this keeps whole sequences.
HOT = 1024
BLOCK = 256
GROUP_BYTES = 8 << 20
SWEEP_ROWS = 1 << 18
#: Classes with such runs that one broadcast takes, of some 40 bytes each.
BROADCAST_ROWS = 200_000


def depth_for(similarity: float, recall: float = RECALL, trees: int = TREES, deepest: int = LABELS) -> int:
    """The floor: how many labels are left when a pair at the similarity meets in some tree with probability ``recall``."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def sequences(texts: list[bytes], trees: range = range(TREES), seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """A row a text: its label sequence in each tree; and which texts have a shingle, for the others' rows say nothing."""
    h, counts = hash_texts(texts)
    s = (ngrams(h, SHINGLE)[inside(counts, SHINGLE)] >> np.uint64(32)).astype(np.uint32)
    n = np.maximum(counts - SHINGLE + 1, 0)
    some = np.flatnonzero(n)
    out = np.zeros((len(texts), len(trees)), np.uint64)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        draw = np.random.default_rng(seed).integers(0, 1 << 32, (TREES + MORE_TREES, LABELS, 2), np.uint32)
        row = np.empty_like(s)
        for at, tree in enumerate(trees):
            sequence = np.zeros(len(some), np.uint64)
            for a, b in draw[tree]:
                np.multiply(s, a | np.uint32(1), out=row)
                row += b
                least = np.minimum.reduceat(row, starts)
                # least hashes are small numbers: mixed before a byte of them is taken
                least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                least = (least ^ (least >> np.uint32(12))) * np.uint32(0x297A2D39)
                sequence = sequence << np.uint64(8) | (least >> np.uint32(24))
            out[some, at] = sequence
    return out, n > 0


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    out = []
    for t in texts:
        h, _ = hash_texts([t])
        out.append(np.unique(ngrams(h, SHINGLE)))
    return out


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Shared shingles of each of ``left`` with each of ``right``; only shingles of two sets or more are looked at."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = np.concatenate(sets)
    if not len(flat):
        return out
    own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    own, column = own[keep], (np.cumsum(often) - 1)[column[keep]]
    for first in range(0, int(often.sum()), columns):
        a, b = np.searchsorted(column, (first, first + columns))
        m = np.zeros((len(sets), columns), np.float32)
        m[own[a:b], column[a:b] - first] = 1
        out += m[left] @ m[right].T
    return out


def verify(leader: int, keys: list[bytes], blocks: list[int], leaders: list[list[int]], texts: list[bytes], similarity: float) -> list[tuple[bytes, int, bytes]]:
    """(class, links, least linked class) of one task that holds the texts."""
    sets = _sets(texts)
    return verify_sets(leader, keys, blocks, leaders, sets, [len(x) for x in sets], [0] * len(sets), 0, similarity)


def verify_sets(
    leader: int,
    keys: list[bytes],
    blocks: list[int],
    leaders: list[list[int]],
    sets: list[np.ndarray],
    sizes: list[int],
    common: list[int],
    base: int,
    similarity: float,
) -> list[tuple[bytes, int, bytes]]:
    """(class, links, least linked class) of one task, from sets or from differences.

    A difference holds the shingles that a class and its leader don't share, in
    either direction; ``common`` counts those that they share and ``base`` all of
    the leader's. Two classes then share common + common - base shingles, and
    those that both differences have.

    Pairs within one block, or between two. A pair with several common leaders
    counts at the least of them, so no link counts twice.
    """
    sides = np.array(blocks)
    low, high = sides.min(), sides.max()
    left, right = np.flatnonzero(sides == low), np.flatnonzero(sides == high)
    size, both = np.array(sizes, np.float64), np.array(common, np.float64)
    shared = overlaps(sets, left, right).astype(np.float64) + both[left][:, None] + both[right][None, :] - base
    union = size[left][:, None] + size[right][None, :] - shared
    # compared as shared >= j * union, with whole numbers on both sides where j is a short decimal
    linked = (shared > 0) & (np.rint(shared * 1_000_000) >= np.rint(similarity * 1_000_000 * union))
    if low == high:
        np.fill_diagonal(linked, False)
    before = sorted({x for own in leaders for x in own if x < leader})
    at = {x: i for i, x in enumerate(before)}
    m = np.zeros((len(keys), len(before)), np.float32)
    for i, own in enumerate(leaders):
        for x in own:
            if x < leader:
                m[i, at[x]] = 1
    counted = linked & ~((m[left] @ m[right].T) > 0)
    links = np.zeros(len(keys), np.int64)
    np.add.at(links, left, counted.sum(axis=1))
    if low != high:
        np.add.at(links, right, counted.sum(axis=0))
    root = list(range(len(keys)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in np.argwhere(linked):
        x, y = find(left[i]), find(right[j])
        if x != y:
            root[max(x, y, key=lambda k: keys[k])] = min(x, y, key=lambda k: keys[k])
    touched = set(left[linked.any(axis=1)].tolist()) | set(right[linked.any(axis=0)].tolist())
    return [(keys[i], int(links[i]), keys[find(i)]) for i in sorted(touched)]


def text_key(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _signed(texts: DataFrame, trees: range, schema: str) -> DataFrame:
    """Rows (key, ..., t) with the text's bytes and its sequences in the trees instead; null without a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, own in chunks(batch["t"]):
                part = batch.slice(first, len(own))
                # equal texts of a chunk are hashed once
                number: dict[bytes, int] = {}
                at = np.array([number.setdefault(k, len(number)) for k in part["key"].to_pylist()])
                once = np.unique(at, return_index=True)[1]
                rows, some = sequences([own[i] for i in once], trees)
                offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(trees))
                lists = pa.ListArray.from_arrays(offsets, pa.array(rows[at].view(np.int64).reshape(-1)), mask=pa.array(~some[at]))
                size = pa.array([len(t) for t in own], pa.int64())
                kept = [c for c in part.schema.names if c != "t"]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), size, lists], [*kept, "bytes", "trees"])

    return texts.mapInArrow(run, schema)


def classes(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(key, rep, bytes, trees): each different text once; trees is null without a shingle."""
    kind = docs.schema[id].dataType.simpleString()
    narrow = docs.where(F.col(text).isNotNull()).select(text_key(text).alias("key"), F.col(id).alias("rep"), F.col(text).alias("t"))
    rows = _signed(narrow, range(TREES), f"key binary, rep {kind}, bytes bigint, trees array<bigint>")
    return rows.groupBy("key").agg(F.min("rep").alias("rep"), F.max("bytes").alias("bytes"), F.any_value("trees").alias("trees"))


def neighbours(rows: DataFrame, total: int, floor: int) -> DataFrame:
    """Of rows (tree, sequence, node), those that share a prefix of ``floor`` labels with a neighbour in the sorted trie.

    Equal sequences are split by node, so no prefix is too common for a range. The
    first and last rows of a range have neighbours out of sight and stay.
    """
    shift = np.uint64(64 - 8 * floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        tree, sequence = table["tree"].to_numpy(), table["sequence"].to_numpy().view(np.uint64)
        same = (tree[1:] == tree[:-1]) & ((sequence[1:] ^ sequence[:-1]) >> shift == 0)
        edge = np.array([True])[: len(tree)]
        stays = np.concatenate([edge, same]) | np.concatenate([same, edge])
        yield from table.filter(pa.array(stays)).to_batches()

    n = pieces_for(total, SWEEP_ROWS, rows.sparkSession.sparkContext.defaultParallelism)
    ranged = rows.repartitionByRange(n, "tree", "sequence", "node").sortWithinPartitions("tree", "sequence")
    return ranged.mapInArrow(run, "tree int, sequence bigint, node bigint")


def _runs(members: DataFrame, prefix: Column) -> tuple[DataFrame, DataFrame]:
    """members with ``run``, and (run, leader, n) of the runs of two classes or more."""
    members = members.withColumn("run", F.xxhash64("tree", prefix))
    led = members.groupBy("run").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    return members, checkpoint(led)


def routes_of(docs: DataFrame, text: str, known: DataFrame, similarity: float) -> DataFrame:
    """(node, leader): where each class meets those that may be linked to it."""

    def exploded(rows: DataFrame, first: int) -> DataFrame:
        out = rows.where("trees is not null").select(F.xxhash64("key").alias("node"), F.posexplode("trees").alias("tree", "sequence"))
        return out.select((F.col("tree") + first).cast("int").alias("tree"), "sequence", "node")

    def prefix(labels: int) -> Column:
        return F.shiftrightunsigned("sequence", 64 - 8 * labels)

    floor = depth_for(similarity)
    total = known.count() * TREES
    members, led = _runs(checkpoint(neighbours(exploded(known, 0), total, floor)), prefix(floor))
    out = members.join(led.where(F.col("n") <= HOT), "run").select("node", "leader")
    if led.where(F.col("n") > HOT).isEmpty():
        return out.distinct()
    hot = checkpoint(members.join(led.where(F.col("n") > HOT).select("run"), "run"))
    whole, whole_led = _runs(hot.drop("run"), F.col("sequence"))
    out = out.unionByName(whole.join(whole_led, "run").select("node", "leader"))
    nodes = checkpoint(hot.select("node").distinct())
    n = nodes.count()
    nodes = F.broadcast(nodes) if n <= BROADCAST_ROWS else nodes
    texts = docs.where(F.col(text).isNotNull()).select(text_key(text).alias("key"), F.col(text).alias("t")).withColumn("node", F.xxhash64("key"))
    more = _signed(texts.join(nodes, "node", "left_semi").select("key", "t"), range(TREES, TREES + MORE_TREES), "key binary, bytes bigint, trees array<bigint>")
    more = more.groupBy("key").agg(F.any_value("trees").alias("trees"))
    floor = depth_for(similarity, trees=MORE_TREES)
    members, led = _runs(checkpoint(neighbours(exploded(more, TREES), n * MORE_TREES, floor)), prefix(floor))
    return out.unionByName(members.join(led, "run").select("node", "leader")).distinct()


FOUND = "key binary, n bigint, root binary"


def _found(out: list[tuple[bytes, int, bytes]]) -> pa.Table:
    return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate((("key", pa.binary()), ("n", pa.int64()), ("root", pa.binary())))})


def _tasks(table: pa.Table, *by: str) -> Iterator[tuple[tuple, dict[str, list]]]:
    """The rows of each task of a lot, once a class and in the order of their keys, as columns."""
    cols = {c: table[c].to_pylist() for c in table.schema.names}
    parts: dict[tuple, dict[bytes, int]] = {}
    for i, (at, key) in enumerate(zip(zip(*(cols[c] for c in by), strict=True), cols["key"], strict=True)):
        parts.setdefault(at, {})[key] = i
    for at, rows in sorted(parts.items()):
        yield at, {c: [x[i] for _, i in sorted(rows.items())] for c, x in cols.items()}


def _verified(full: DataFrame, similarity: float) -> DataFrame:
    """Links of the classes of small leaders; full: a row for each class and leader, with its text."""
    lots = pieces_for(full.select(F.sum("bytes")).head()[0] or 0, GROUP_BYTES)

    def run(table: pa.Table) -> pa.Table:
        out = []
        for (leader,), x in _tasks(table, "leader"):
            if len(x["key"]) > 1:
                out += verify(leader, x["key"], [0] * len(x["key"]), x["leaders"], x["t"], similarity)
        return _found(out)

    dealt = full.withColumn("lot", F.pmod(F.xxhash64("leader"), F.lit(lots)).cast("int"))
    return dealt.select("lot", "leader", "key", "leaders", "t").groupBy("lot").applyInArrow(run, FOUND)


def _verified_apart(full: DataFrame, similarity: float) -> DataFrame:
    """Links of the classes of large leaders, block by block, by their differences from the leader."""
    own = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int")
    leads = F.xxhash64("key") == F.col("leader")
    rows = full.withColumn("block", own)
    # the leader goes to every slice
    sliced = rows.withColumn("slice", F.explode(F.when(leads, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    lots = pieces_for(full.select(F.sum("bytes")).head()[0] or 0, GROUP_BYTES)
    sliced = sliced.withColumn("lot", F.pmod(F.xxhash64("leader", "slice"), F.lit(lots)).cast("int")).withColumn("leads", leads)

    def differ(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for (leader, number), x in _tasks(table, "leader", "slice"):
            first = _sets([next(t for t, is_one in zip(x["t"], x["leads"], strict=True) if is_one)])[0]
            for key, leaders, t, block, blocks in zip(x["key"], x["leaders"], x["t"], x["block"], x["blocks"], strict=True):
                if block == number:
                    own = _sets([t])[0]
                    diff = np.setxor1d(own, first, assume_unique=True)
                    out.append((leader, key, leaders, block, blocks, len(own), (len(own) + len(first) - len(diff)) // 2, len(first), diff.tobytes()))
        types = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ("leader", "key", "leaders", "block", "blocks", "size", "common", "base", "diff")
        return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate(zip(names, types, strict=True))})

    schema = "leader bigint, key binary, leaders array<bigint>, block int, blocks int, size bigint, common bigint, base bigint, diff binary"
    dealt = sliced.select("lot", "leader", "slice", "leads", "key", "leaders", "t", "block", "blocks")
    apart = checkpoint(dealt.groupBy("lot").applyInArrow(differ, schema))
    met = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).drop("other", "blocks")
    load = apart.select(F.sum(F.col("blocks") * (F.octet_length("diff") + 100))).head()[0] or 0
    met = met.withColumn("lot", F.pmod(F.xxhash64("leader", "low", "high"), F.lit(pieces_for(load, GROUP_BYTES))).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        out = []
        for (leader, low, high), x in _tasks(table, "leader", "low", "high"):
            if len(set(x["block"])) == 1 + (low != high) and len(x["key"]) > 1:
                sets = [np.frombuffer(d, np.uint64) for d in x["diff"]]
                out += verify_sets(leader, x["key"], x["block"], x["leaders"], sets, x["size"], x["common"], x["base"][0], similarity)
        return _found(out)

    return met.groupBy("lot").applyInArrow(run, FOUND)


def groups(docs: DataFrame, id: str, text: str, similarity: float) -> DataFrame:
    """(key, rep, class_id, best, n_links) of every different text; best is the class that stands for its group."""
    known = checkpoint(classes(docs, id, text))
    routes = checkpoint(routes_of(docs, text, known, similarity))
    narrow = known.select("key", "rep", "bytes", F.xxhash64("key").alias("node"))
    routes = checkpoint(routes.join(narrow, "node").select("key", "rep", "bytes", "leader"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / GROUP_BYTES)).cast("int")
    sizes = checkpoint(routes.groupBy("leader").agg(blocks.alias("blocks")))
    to = F.array_sort(F.collect_list(F.struct("leader", "blocks")))
    sent = checkpoint(routes.join(sizes, "leader").groupBy("key", "rep").agg(F.max("bytes").alias("bytes"), to.alias("to")))
    body = docs.where(F.col(text).isNotNull()).select(text_key(text).alias("key"), F.col(id).alias("id"), F.col(text).cast("binary").alias("t"))
    full = body.alias("b").join(sent.alias("s"), (F.col("b.key") == F.col("s.key")) & F.col("b.id").eqNullSafe(F.col("s.rep")))
    # both ways of verifying read the texts of linked candidates from here, so that all texts are moved once
    full = checkpoint(full.select("s.key", "s.bytes", "s.to", "t"))
    full = full.select("key", "bytes", F.col("to.leader").alias("leaders"), "t", F.explode("to").alias("x"))
    full = full.select("key", "bytes", "leaders", "t", "x.leader", "x.blocks")
    found = _verified(full.where("blocks = 1"), similarity)
    if not sizes.where("blocks > 1").isEmpty():
        found = found.unionByName(_verified_apart(full.where("blocks > 1"), similarity))
    found = checkpoint(found)
    links = found.groupBy("key").agg(F.sum("n").alias("n"))
    joined = checkpoint(components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))))
    member = known.select("key", "rep").join(joined.withColumnRenamed("node", "key"), "key")
    order = F.struct(F.col("rep").isNull(), "rep", "key")
    best = checkpoint(member.groupBy("root").agg(F.min(order).alias("best")))
    grouped = checkpoint(member.join(best, "root").select("key", F.col("best.rep").alias("class_id"), F.col("best.key").alias("best")))
    out = known.select("key", "rep").join(grouped, "key", "left").join(links, "key", "left")
    alone = F.col("best").isNull()
    return out.select(
        "key",
        "rep",
        F.when(alone, F.col("rep")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("best", "key").alias("best"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
    )


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """(id, class_id, text_id, n_links): one row for each row of docs.

    class_id: the least id among all texts that a chain of links reaches, where a
    link joins two different texts whose sets of five-word shingles have a
    Jaccard similarity of ``similarity`` or more. text_id: the least id with
    exactly this text. n_links: how many different texts link to this one. Texts
    of fewer than five words have no shingle: they are grouped with equal texts
    only, as are empty ones. A null text is in a group of its own, with its own
    id. A very long text is compared whole. Null ids are never the least where
    another exists. Ties at the similarity are links. Repeated rows give repeated
    rows, and an empty table none. Extra columns are not returned, whatever their
    names.
    """
    known = checkpoint(groups(docs, id, text, similarity))
    rows = docs.select(F.col(id).alias("id"), text_key(text).alias("key"))
    out = rows.join(known, "key", "left")
    return out.select(
        F.col("id").alias(id),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("rep")).alias("text_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the least id; rows with a null text all stay.

    The groups are those of near_duplicates. Of repeated rows, or of texts that tie
    for the least id, one stays. An empty table stays empty. All columns stay,
    whatever their names.
    """
    mark = fresh(docs, "__n_mark")
    place = F.concat(F.hex("key"), F.lit(":"), F.coalesce(F.col("rep").cast("string"), F.lit("")))
    best = checkpoint(groups(docs, id, text, similarity).where("key = best").select(place.alias(mark)))
    # one key for both sides and for dropping repeated rows, so that texts move once
    own = F.concat(F.hex(text_key(text)), F.lit(":"), F.coalesce(F.col(id).cast("string"), F.lit("")))
    stay = docs.where(F.col(text).isNotNull()).withColumn(mark, own).join(best, mark, "left_semi").dropDuplicates([mark])
    return stay.select(docs.columns).unionByName(docs.where(F.col(text).isNull()))
