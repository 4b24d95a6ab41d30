"""Plans, lanes, pages, batches and the session on generated files."""

import decimal
import hashlib
import io
import struct
import threading

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from build import I32, STRUCT, column, file, leaf, page, root
from flatscan.errors import FormatError, LimitExceededError, UnsupportedFeatureError
from flatscan.operators.batches import batch_identity, capped_rows, offsets, validity
from flatscan import made_queries, queries
from flatscan.operators.checksum import SEED, group_checksums, mix, mix_long, scan_checksum, stream_digest
from flatscan.operators.metadata import TABLES, metadata, pages, summary
from flatscan.operators.scan import oversized_values, scan, scan_files
from flatscan.options import ReaderOptions, RowRange, ScanOptions
from flatscan.plans.preflight import Segment, plan
from flatscan.sources.decode import hybrid
from flatscan.sources.footer import open_metadata
from flatscan.sources.pages import walk
from flatscan.sources.ranges import BytesSource
from flatscan.streaming.session import Cancelled, FlatFile

FIVE = file([[column([0, 1], [2, 3, 4])]])
TWO_GROUPS = file([[column([10, 11])], [column([20, 21, 22])]])
TWO_COLUMNS = file([[column([1, 2], [3, 4, 5]), column([6], [7, 8], [9, 10])]], names=("left", "right"))


def batches(data, *args, options=None, **kw):
    out = []
    with FlatFile(data, options) as f:
        for b in f.scan(ScanOptions(*args, **kw)):
            out.append((b.row_offset, b.row_group, b.offset_in_group, b.row_count, [c.values for c in b.columns]))
            b.dispose()
    return out


def test_golden_batches():
    assert batches(FIVE, ["value"], rows=RowRange(1, 3)) == [(1, 0, 1, 1, [[1]]), (2, 0, 2, 2, [[2, 3]])]
    one = file([[column([0, 1, 2, 3, 4])]])
    assert [x[0] for x in batches(one, ["value"], target_rows=2)] == [0, 2, 4]
    assert batches(one, ["value"], rows=RowRange(1, 3)) == [(1, 0, 1, 3, [[1, 2, 3]])]
    assert [(x[0], x[4]) for x in batches(TWO_COLUMNS, ["right", "left"])] == [(0, [[6], [1]]), (1, [[7], [2]]), (2, [[8], [3]]), (3, [[9, 10], [4, 5]])]
    assert [x[:4] for x in batches(TWO_GROUPS, ["value"], target_rows=16)] == [(0, 0, 0, 2), (2, 1, 0, 3)]
    assert batches(TWO_GROUPS, ["value"], row_groups=[1])[0][0] == 2
    assert batches(TWO_GROUPS, ["value"], row_groups=[]) == []
    assert batches(file([[column([1, 2])], [column([])]]), ["value"])[0][4] == [[1, 2]]
    eight = file([[column([10 * i, 10 * i + 1])] for i in range(8)])
    assert [(x[0], x[1], x[4]) for x in batches(eight, ["value"], rows=RowRange(5, 2))] == [(5, 2, [[21]]), (6, 3, [[30]])]
    assert [x[0] for x in batches(file([[column([], [1, 2])]]), ["value"])] == [0]


@pytest.mark.parametrize(
    ("kw", "kind"),
    [
        ({"columns": []}, ValueError),
        ({"columns": ["value", 0]}, ValueError),
        ({"columns": [1]}, ValueError),
        ({"columns": [-1]}, ValueError),
        ({"columns": ["other"]}, ValueError),
        ({"columns": [0], "target_rows": 0}, ValueError),
        ({"columns": [0], "target_rows": 1 << 30}, ValueError),
        ({"columns": [0], "row_groups": [0, 0]}, ValueError),
        ({"columns": [0], "row_groups": [2]}, ValueError),
        ({"columns": [0], "rows": RowRange(0, 6)}, ValueError),
        ({"columns": [0], "rows": RowRange(9, 0), "row_groups": []}, ValueError),
    ],
)
def test_plan_errors(kw, kind):
    with pytest.raises(kind):
        plan(open_metadata(BytesSource(TWO_GROUPS)), ScanOptions(**kw))


def test_plan_segments():
    m = open_metadata(BytesSource(TWO_GROUPS))
    assert plan(m, ScanOptions([0], row_groups=[1, 0], rows=RowRange(1, 3))).segments == (Segment(0, 1, 1), Segment(1, 2, 2))
    assert plan(m, ScanOptions([0], rows=RowRange(5, 0))).segments == ()
    with pytest.raises(ValueError):
        ScanOptions([None])


def test_chunk_preflight_looks_at_selected_chunks():
    def gzip_second(chunk, meta):
        if meta[3][1][1] == ["b"]:
            meta[4] = (I32, 2)

    data = file([[column([1]), column([2])]], names=("a", "b"), change_chunk=gzip_second)
    assert batches(data, ["a"])[0][4] == [[1]]
    with pytest.raises(UnsupportedFeatureError) as e:
        batches(data, ["b"])
    assert (e.value.row_group, e.value.column) == (0, 1)
    for number, kind, x in ((1, 8, "other.parquet"), (8, STRUCT, []), (9, 8, b"k")):
        with pytest.raises(UnsupportedFeatureError):
            batches(file([[column([1])]], change_chunk=lambda c, m, n=number, k=kind, v=x: c.update({n: (k, v)})), [0])
    m = open_metadata(BytesSource(file([[column([1])]], schema=[root(1), leaf(repetition=2)])))
    with pytest.raises(UnsupportedFeatureError):
        plan(m, ScanOptions([0]))


def walked(data, options=None, payloads=True):
    s = BytesSource(data)
    m = open_metadata(s)
    return [list(walk(s, m, c, options, payloads)) for g in m.groups for c in g.chunks]


def one(*raw, rows=2, **kw):
    return file([[(rows, list(raw))]], **kw)


OPTIONAL = [root(1), leaf(repetition=1)]


@pytest.mark.parametrize(
    ("data", "kind"),
    [
        (one(page([1, 2], kind=1)), UnsupportedFeatureError),
        (one(page([1, 2], encoding=5)), UnsupportedFeatureError),
        (one(page([1, 2], encoding=3)), UnsupportedFeatureError),
        (one(page([1, 2], definition=4), schema=OPTIONAL), UnsupportedFeatureError),
        (one(page([1, 2], encoding=8)), FormatError),
        (one(page([1, 2, 3])), FormatError),
        (one(page([1])), FormatError),
        (one(page([1, 2], crc="bad")), FormatError),
        (one(page([1, 2], uncompressed=9)), FormatError),
        (one(page([1, 2], compressed=90)), FormatError),
        (one(page([1, 2]), page([7], kind=2)), FormatError),
        (one(page([7], kind=2), page([7], kind=2), page([1, 2])), FormatError),
        (one(page([7], kind=2, encoding=8), page([1, 2])), UnsupportedFeatureError),
        (one(page([1, 2], header=(7, [(1, I32, 1), (2, I32, 0)]))), FormatError),
        (one(page([1, 2]), change_chunk=lambda c, m: m.update({6: (6, 1)})), FormatError),
        (one(page([1, 2]), change_chunk=lambda c, m: m.update({6: (6, 999)})), FormatError),
        (one(page([1, 2]), change_chunk=lambda c, m: m.update({11: (6, 4)})), FormatError),
    ],
)
def test_strict_pages(data, kind):
    with pytest.raises(kind) as e:
        walked(data)
    assert type(e.value) is kind


def test_pages_that_are_fine():
    assert [p.crc for p in walked(one(page([1, 2], crc="good")))[0]] == ["OK"]
    assert [p.kind for p in walked(one(page([7], kind=2), page([1, 2])))[0]] == ["dictionary", "v1"]
    assert [p.row for p in walked(one(page([1]), page([]), page([2])))[0]] == [0, 1, 1]


def test_page_limits():
    data = one(page([7], kind=2), page([1]), page([2]))
    for limit, least in (("pages_per_column_chunk", 2), ("values_per_page", 1), ("dictionary_entries", 1), ("dictionary_bytes", 1), ("page_header_bytes", 3), ("uncompressed_page_bytes", 3), ("compressed_page_bytes", 3)):
        if limit in ("values_per_page", "dictionary_entries"):
            big = one(page([7, 8], kind=2), page([1, 2]))
            with pytest.raises(LimitExceededError):
                walked(big, ReaderOptions(**{limit: least}))
        else:
            with pytest.raises(LimitExceededError):
                walked(data, ReaderOptions(**{limit: least}))


def test_unsupported_encoding_outranks_a_limit():
    with pytest.raises(UnsupportedFeatureError):
        walked(one(page([1, 2], encoding=5)), ReaderOptions(values_per_page=1))


def test_one_scan_and_one_batch_at_a_time():
    with FlatFile(TWO_GROUPS) as f:
        a = f.scan(ScanOptions([0]))
        first = next(a)
        with pytest.raises(RuntimeError, match="active"):
            next(f.scan(ScanOptions([0])))
        with pytest.raises(RuntimeError, match="disposed"):
            next(a)
        first.dispose()
        first.dispose()
        with pytest.raises(RuntimeError):
            _ = first.columns
        b = f.scan(ScanOptions([0]))
        with next(b):
            f.cancel()
        with pytest.raises(Cancelled):
            next(b)
    f.close()
    with pytest.raises(RuntimeError):
        f.scan(ScanOptions([0]))


def test_sources_and_ownership(tmp_path):
    (tmp_path / "f").write_bytes(FIVE)
    assert batches(str(tmp_path / "f"), [0]) == batches(FIVE, [0]) == batches(io.BytesIO(FIVE), [0])
    s = io.BytesIO(b"nothing at all")
    with pytest.raises(FormatError):
        FlatFile(s, owned=True)
    assert s.closed


TABLE = pa.table(
    {
        "bool": pa.array([None if i % 8 == 0 else i % 3 == 0 for i in range(200)], pa.bool_()),
        "int": pa.array([None if i % 8 == 0 else i * 7 - 300 for i in range(200)], pa.int32()),
        "long": pa.array([None if i % 8 == 0 else i << 40 for i in range(200)], pa.int64()),
        "float": pa.array([None if i % 8 == 0 else i / 7 for i in range(200)], pa.float32()),
        "double": pa.array([None if i % 8 == 0 else -i / 3 for i in range(200)], pa.float64()),
        "bytes": pa.array([None if i % 8 == 0 else bytes([i]) * (i % 5) for i in range(200)], pa.binary()),
        "fixed": pa.array([None if i % 8 == 0 else bytes([i, 1, 2, 3]) for i in range(200)], pa.binary(4)),
    }
)


def values(df, name):
    rows = sorted(df.collect(), key=lambda r: r["row_index"])
    return [bytes(r[name]) if isinstance(r[name], bytearray) else r[name] for r in rows]


@pytest.mark.parametrize("nullable", [True, False])
@pytest.mark.parametrize(("version", "codec", "dictionary"), [("1.0", "snappy", True), ("1.0", "none", False), ("2.0", "snappy", True)])
def test_lanes_agree(spark, tmp_path, nullable, version, codec, dictionary):
    t = TABLE if nullable else TABLE.filter(TABLE["int"].is_valid()).cast(pa.schema([f.with_nullable(False) for f in TABLE.schema]))
    names = [n for n in t.column_names if version == "1.0" or n != "bool"]
    path = f"{tmp_path}/f.parquet"
    pq.write_table(t.select(names), path, row_group_size=30, data_page_version=version, compression=codec, use_dictionary=dictionary, write_page_checksum=True)
    for kw in ({}, {"rows": RowRange(25, 70)}, {"row_groups": [1, 4]}, {"row_groups": [0, 2], "rows": RowRange(10, 60)}):
        native = scan(spark, path, names[::-1], identity=True, **kw)
        groups = scan(spark, path, names[::-1], identity=True, lane="row_group", target_rows=7, **kw)
        strict = scan(spark, path, names[::-1], identity=True, lane="strict", target_rows=9, **kw)
        assert native.columns == groups.columns == strict.columns == [*names[::-1], "row_index", "row_group"]
        strict = strict.cache()
        at = values(native, "row_index")
        with FlatFile(path) as f:
            own = {n: [] for n in names}
            for b in f.scan(ScanOptions(names, target_rows=11, **kw)):
                for c in b.columns:
                    own[c.column.name] += c.values
                b.dispose()
        for n in names:
            want = [t[n].to_pylist()[i] for i in at]
            kind = open_metadata(BytesSource(open(path, "rb").read())).column(n).element.physical
            digests = {stream_digest(x, kind) for x in (values(native, n), values(groups, n), values(strict, n), own[n], want)}
            assert len(digests) == 1, n
        assert values(native, "row_group") == values(groups, "row_group") == [i // 30 for i in at]


ANNOTATED = pa.table(
    {
        "u8": pa.array([0, 200], pa.uint8()),
        "i8": pa.array([-1, 100], pa.int8()),
        "u16": pa.array([0, 60000], pa.uint16()),
        "u32": pa.array([5, 1 << 31], pa.uint32()),
        "u64": pa.array([5, (1 << 64) - 2], pa.uint64()),
        "date": pa.array([0, 19000], pa.date32()),
        "time_ms": pa.array([1, 2], pa.time32("ms")),
        "time_us": pa.array([1, 2], pa.time64("us")),
        "ts_ms": pa.array([1, -5], pa.timestamp("ms", "UTC")),
        "ts_us": pa.array([1, -5], pa.timestamp("us")),
        "ts_ns": pa.array([1, -5], pa.timestamp("ns")),
        "small": pa.array([decimal.Decimal("1.25"), decimal.Decimal("-3.50")], pa.decimal32(9, 2)),
        "wide": pa.array([decimal.Decimal("1.25"), decimal.Decimal("-3.50")], pa.decimal64(18, 2)),
        "text": ["a", "é"],
    }
)
PHYSICAL = {
    "u8": [0, 200], "i8": [-1, 100], "u16": [0, 60000], "u32": [5, -(1 << 31)], "u64": [5, -2], "date": [0, 19000], "time_ms": [1, 2],
    "time_us": [1, 2], "ts_ms": [1, -5], "ts_us": [1, -5], "ts_ns": [1, -5], "small": [125, -350], "wide": [125, -350], "text": [b"a", "é".encode()],
}


def test_values_are_physical(spark, tmp_path):
    path = f"{tmp_path}/f.parquet"
    pq.write_table(ANNOTATED, path, store_decimal_as_integer=True)
    names = ANNOTATED.column_names
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        native = scan(spark, path, names, identity=True)
        got = {n: values(native, n) for n in names}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == PHYSICAL
    groups = scan(spark, path, names, identity=True, lane="row_group")
    assert {n: values(groups, n) for n in names} == PHYSICAL
    assert [c.values for c in next(FlatFile(path).scan(ScanOptions(names))).columns] == list(PHYSICAL.values())


@pytest.mark.parametrize(
    ("table", "kw"),
    [
        (pa.table({"a": [True, False] * 50}), {"data_page_version": "2.0", "use_dictionary": False}),
        (pa.table({"a": list(range(100))}), {"column_encoding": "DELTA_BINARY_PACKED", "use_dictionary": False}),
        (pa.table({"a": [1.5] * 100}), {"column_encoding": "BYTE_STREAM_SPLIT", "use_dictionary": False}),
        (pa.table({"a": [1] * 100}), {"compression": "gzip"}),
        (pa.table({"a": [1] * 100}), {"compression": "zstd"}),
        (pa.table({"a": [[1]]}), {}),
        (pa.table({"a": pa.array([1], pa.timestamp("ns"))}), {"use_deprecated_int96_timestamps": True}),
    ],
)
def test_what_the_profile_leaves_out_is_rejected(tmp_path, table, kw):
    path = f"{tmp_path}/f.parquet"
    pq.write_table(table, path, **kw)
    with pytest.raises(UnsupportedFeatureError):
        batches(path, [0])


@pytest.mark.parametrize(
    ("data", "width", "count", "want"),
    [
        (b"\x06\x05", 3, 3, [5, 5, 5]),
        (b"\x03\x88\xc6\xfa", 3, 8, [0, 1, 2, 3, 4, 5, 6, 7]),
        (b"\x03\x88\xc6\xfa", 3, 5, [0, 1, 2, 3, 4]),
        (b"\x04", 0, 2, [0, 0]),
        (b"", 1, 0, []),
        (b"\x02\x01\x02\x00", 1, 2, [1, 0]),
        (b"\x00\x01", 1, 1, None),
        (b"\x06\x05", 3, 2, None),
        (b"\x02\x08", 3, 1, None),
        (b"\x05\x88\xc6\xfa\x88\xc6\xfa", 3, 5, None),
        (b"\x03\x88", 3, 5, None),
        (b"\x06\x05\x00", 3, 3, None),
        (b"\x80", 3, 3, None),
        (b"\x06\x05", 33, 3, None),
    ],
)
def test_hybrid_numbers(data, width, count, want):
    if want is None:
        with pytest.raises(FormatError):
            hybrid(data, width, count, FormatError)
    else:
        assert hybrid(data, width, count, FormatError).tolist() == want


@pytest.mark.parametrize("body", [b"\x01\x00\x00", b"\x01" * 9, b""])
def test_values_fill_their_page(body):
    with pytest.raises(FormatError):
        batches(one(page([1, 2], body=body)), [0])


def test_levels_and_indices_are_checked():
    def data(levels, *values):
        return len(levels).to_bytes(4, "little") + levels + b"".join(v.to_bytes(4, "little") for v in values)

    assert batches(one(page([1, 2], body=data(b"\x03\x02", 7)), schema=OPTIONAL), [0])[0][4] == [[None, 7]]
    for body in (data(b"\x03\x03", 7), data(b"\x03\x02\x00", 7), b"\x09\0\0\0", b"\0"):
        with pytest.raises(FormatError):
            batches(one(page([1, 2], body=body), schema=OPTIONAL), [0])
    words = page([5, 6], kind=2)
    assert batches(one(words, page([1, 2], encoding=8, body=b"\x01\x03\x02")), [0])[0][4] == [[5, 6]]
    for body in (b"\x02\x03\x0f\x00", b"\x01\x02\x00", b"\x21\x03\x02", b""):
        with pytest.raises(FormatError) as e:
            batches(one(words, page([1, 2], encoding=8, body=body)), [0])
        assert (e.value.row_group, e.value.column, e.value.page) == (0, 0, 1)


def test_a_flipped_bit_is_found(spark, tmp_path):
    path = f"{tmp_path}/f.parquet"
    pq.write_table(pa.table({"a": list(range(1000))}), path, use_dictionary=False, compression="none", write_page_checksum=True)
    data = bytearray(open(path, "rb").read())
    data[2000] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(FormatError) as e:
        batches(path, [0])
    assert (e.value.row_group, e.value.column, e.value.page) == (0, 0, 0)
    with pytest.raises(Exception, match="checksum"):
        pages(spark, path, payloads=True).collect()


def cuts(starts, low, high, target):
    """Batch starts by a model of the cursors: the least remaining rows of all columns."""
    at, out = low, []
    while at < high:
        out.append(at)
        ends = []
        for own in starts:
            first = max([s for s in own if s <= at])
            begin = max(first, low)
            after = min([s for s in own if s > at], default=high)
            ends.append(min(begin + ((at - begin) // target + 1) * target, after, high))
        at = min(ends)
    return out


def test_batch_identity_follows_pages(spark, tmp_path):
    path = f"{tmp_path}/f.parquet"
    t = pa.table({"a": pa.array(range(20_000), pa.int32()), "b": [f"value {i}" for i in range(20_000)]})
    pq.write_table(t, path, data_page_size=8192, write_batch_size=100, use_dictionary=False, compression="none", row_group_size=9_000)
    walkers = [p for p in pages(spark, path).collect()]
    for kw in ({}, {"rows": RowRange(1234, 10_000)}):
        for target in (65_536, 700):
            got = sorted(batch_identity(spark, path, ScanOptions(["a", "b"], target_rows=target, **kw)).collect())
            with FlatFile(path) as f:
                own = []
                for b in f.scan(ScanOptions(["a", "b"], target_rows=target, **kw)):
                    own.append((b.row_offset, b.row_group, b.offset_in_group, b.row_count))
                    b.dispose()
            assert [tuple(r) for r in got] == own
            low, high = (1234, 11_234) if kw else (0, 20_000)
            want = []
            for g in range(3):
                starts = [[9000 * g + p.row_in_group for p in walkers if (p.row_group, p.column) == (g, c)] for c in (0, 1)]
                want += cuts(starts, max(low, 9000 * g), min(high, 9000 * g + 9000), target)
            assert [r.row_offset for r in got] == want


def test_binary_caps_shorten_batches():
    t = pa.table({"a": pa.array([b"x" * 10] * 7, pa.binary())})
    f = io.BytesIO()
    pq.write_table(t, f, use_dictionary=False)
    got = batches(f.getvalue(), [0], options=ReaderOptions(binary_batch_bytes=35))
    assert [x[3] for x in got] == [3, 3, 1]
    for kw in ({"binary_batch_bytes": 9}, {"binary_value_bytes": 9}):
        with pytest.raises(LimitExceededError):
            batches(f.getvalue(), [0], options=ReaderOptions(**kw))


def test_views():
    t = pa.table({"a": pa.array([b"ab", None, b"", b"cde", b"f"], pa.binary()), "f": pa.array([b"12", None, b"34", b"56", b"78"], pa.binary(2))})
    f = io.BytesIO()
    pq.write_table(t, f)
    with FlatFile(f.getvalue()) as file_, next(file_.scan(ScanOptions(["a", "f"]))) as b:
        a, fixed = b.columns
        assert (a.offsets, a.payload, a.bitmap, a.all_valid) == ([0, 2, 2, 2, 5, 6], b"abcdef", bytes([0b11101]), False)
        assert fixed.payload == b"12\0\x00345678" and a.is_valid(2) and not a.is_valid(1)
        with pytest.raises(IndexError):
            a.is_valid(5)


def test_relational_views(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else b"x" * i) for i in range(20)], "row_index long, v binary")
    got = {r.byte_index: r.bits for r in validity(rows, F.col("v")).collect()}
    bits = np.packbits([i % 3 != 0 for i in range(20)], bitorder="little")
    assert [got[i] for i in range(3)] == bits.tolist()
    ends = sorted((r.row_index, r.begin, r.end) for r in offsets(rows, "v", F.floor(F.col("row_index") / 10)).collect())
    assert ends[:3] == [(0, 0, 0), (1, 0, 1), (2, 1, 3)] and ends[10] == (10, 0, 10)
    assert capped_rows(rows, ["v"], F.lit(0)).agg(F.max("payload")).head()[0] == sum(i for i in range(20) if i % 3)
    with pytest.raises(LimitExceededError):
        capped_rows(rows, ["v"], F.lit(0), ReaderOptions(binary_batch_bytes=18))
    assert oversized_values(rows, ["v"], ReaderOptions(binary_value_bytes=18)).count() == 1


def test_metadata_tables_of_many_files(spark, tmp_path):
    for i in range(3):
        pq.write_table(TABLE, f"{tmp_path}/{i}.parquet", row_group_size=60)
    (tmp_path / "_SUCCESS").write_text("")
    for name, (ddl, _) in TABLES.items():
        many = metadata(spark, str(tmp_path), name)
        one_ = metadata(spark, f"{tmp_path}/0.parquet", name)
        assert many.schema == one_.schema and many.count() == 3 * one_.count()
    assert metadata(spark, str(tmp_path), "row_groups").agg(F.sum("row_count")).head()[0] == 600
    assert {r.chunks for r in summary(spark, str(tmp_path)).collect()} == {12}
    assert pages(spark, str(tmp_path)).where("kind <> 'dictionary'").agg(F.sum("values")).head()[0] == 3 * 200 * 7
    with pytest.raises(ValueError):
        scan(spark, str(tmp_path), [0])
    with pytest.raises(FileNotFoundError):
        metadata(spark, f"{tmp_path}/none", "columns")


def test_a_file_of_many_groups(spark, tmp_path):
    path = f"{tmp_path}/f.parquet"
    pq.write_table(pa.table({"a": pa.array(range(10_000), pa.int32()), "b": [f"{i}" for i in range(10_000)]}), path, row_group_size=2)
    for kw, want in (({}, range(10_000)), ({"row_groups": [*range(0, 5000, 2)]}, [i for i in range(10_000) if i % 4 < 2]), ({"rows": RowRange(4001, 10)}, range(4001, 4011))):
        for lane in (None, "native", "row_group"):
            out = scan(spark, path, ["a"], lane=lane, identity=True, **kw)
            assert sorted((r.a, r.row_index, r.row_group) for r in out.collect()) == [(i, i, i // 2) for i in want]
    assert scan(spark, path, ["a"], lane="native").count() == 10_000


def test_a_short_range_opens_its_group_alone(spark, tmp_path):
    path = f"{tmp_path}/f.parquet"
    pq.write_table(pa.table({"a": list(range(5000))}), path, row_group_size=100, use_dictionary=False, compression="none", write_page_checksum=True)
    m = open_metadata(BytesSource(open(path, "rb").read()))
    data = bytearray(open(path, "rb").read())
    for g in m.groups[:17] + m.groups[18:]:
        data[g.chunks[0].first_page + g.chunks[0].meta["compressed"] - 1] ^= 1
    open(path, "wb").write(data)
    # every other group is broken, and nobody looks at one
    assert sorted(r.a for r in scan(spark, path, ["a"], rows=RowRange(1750, 10)).collect()) == [*range(1750, 1760)]
    out = scan(spark, path, ["a"], rows=RowRange(1750, 10))
    assert out.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="[Cc]hecksum|CRC"):
        scan(spark, path, ["a"], rows=RowRange(1690, 20)).collect()


def test_partitions_hold_neighbouring_groups(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/f.parquet"
    pq.write_table(pa.table({"a": list(range(5000))}), path, row_group_size=100)
    assert scan(spark, path, ["a"], lane="row_group").rdd.getNumPartitions() == 1
    monkeypatch.setattr("flatscan.operators.scan.PARTITION_BYTES", 1)
    assert scan(spark, path, ["a"], lane="row_group").rdd.getNumPartitions() == 50


def test_batches_halve_until_they_fit():
    t = pa.table({"a": pa.array(range(100), pa.int64())}, schema=pa.schema([pa.field("a", pa.int64(), nullable=False)]))
    f = io.BytesIO()
    pq.write_table(t, f)
    assert [x[3] for x in batches(f.getvalue(), [0], options=ReaderOptions(scan_pooled_bytes=300))] == [25, 37, 19, 19]
    assert {x[3] for x in batches(f.getvalue(), [0], options=ReaderOptions(scan_pooled_bytes=8))} == {1}
    with pytest.raises(LimitExceededError):
        batches(f.getvalue(), [0], options=ReaderOptions(scan_pooled_bytes=7))


class Recorded(BytesSource):
    """Notes the ranges that are read."""

    def __init__(self, data):
        super().__init__(data)
        self.ranges = []

    def read(self, offset, size):
        self.ranges.append((offset, size))
        return super().read(offset, size)


def ranged(data, rows, *columns):
    source = Recorded(data)
    f = FlatFile(source)
    source.ranges.clear()
    got = [(b.row_offset, [c.values for c in b.columns], b.dispose()) for b in f.scan(ScanOptions(columns or [0], rows=rows))]
    return [x[:2] for x in got], source.ranges


def test_pages_outside_a_range_are_not_read():
    groups = [[column([0, 1], [2, 3, 4], [5], [6, 7], crc="good")]]
    data = bytearray(file(groups))
    whole = [p for p in walked(bytes(data), payloads=False)[0]]
    for p in (whole[0], whole[3]):
        data[p.offset + p.header_bytes] ^= 1
    got, ranges = ranged(bytes(data), RowRange(3, 3))
    assert got == [(3, [[3, 4]]), (5, [[5]])]
    # payloads of the two pages inside, whole as they have checksums; headers of all
    payloads = {(p.offset + p.header_bytes, p.compressed) for p in whole}
    assert set(ranges) & payloads == {(p.offset + p.header_bytes, p.compressed) for p in whole[1:3]}
    assert {p.offset for p in whole} <= {a for a, _ in ranges}
    with pytest.raises(FormatError):
        ranged(bytes(data), RowRange(1, 3))
    # an optional column's pages are decoded all the same
    levels = b"\x02\x00\x00\x00\x04\x01"
    body = lambda *v: levels + b"".join(x.to_bytes(4, "little") for x in v)
    optional = bytearray(one(page([1, 2], body=body(1, 2)), page([3, 4], body=body(3, 4)), rows=4, schema=OPTIONAL))
    assert ranged(bytes(optional), RowRange(2, 2))[0] == [(2, [[3, 4]])]
    optional[walked(bytes(optional), payloads=False)[0][0].offset + 21] ^= 0xFF
    with pytest.raises(FormatError):
        ranged(bytes(optional), RowRange(2, 2))


def test_a_part_of_a_plain_page_is_read_alone():
    data = file([[column(list(range(100)), list(range(100, 150)))]])
    first, second = walked(data, payloads=False)[0]
    got, ranges = ranged(data, RowRange(90, 15))
    assert got == [(90, [[*range(90, 100)]]), (100, [[*range(100, 105)]])]
    at = [p.offset + p.header_bytes for p in (first, second)]
    assert [r for r in ranges if r[0] >= at[0] and r[0] not in (first.offset, second.offset)] == [(at[0] + 360, 40), (at[1], 20)]
    # a checksum covers the whole page
    checked = file([[column(list(range(100)), crc="good")]])
    (p,) = walked(checked, payloads=False)[0]
    assert (p.offset + p.header_bytes, 400) in ranged(checked, RowRange(90, 5))[1]
    short = file([[(100, [page(list(range(100)), body=bytes(396))])]])
    with pytest.raises(FormatError):
        ranged(short, RowRange(5, 5))


def test_ranges_of_required_columns_agree_in_all_lanes(spark, tmp_path):
    t = TABLE.filter(TABLE["int"].is_valid()).cast(pa.schema([f.with_nullable(False) for f in TABLE.schema]))
    for codec, dictionary, crc in (("none", False, False), ("snappy", True, True), ("none", False, True)):
        path = f"{tmp_path}/{codec}{crc}.parquet"
        pq.write_table(t, path, row_group_size=60, compression=codec, use_dictionary=dictionary, write_page_checksum=crc, data_page_size=64, write_batch_size=8)
        for rows in (RowRange(0, 1), RowRange(17, 100), RowRange(t.num_rows - 1, 1), RowRange(59, 2)):
            for name in t.column_names:
                want = t[name].to_pylist()[rows.start : rows.end]
                lanes = [values(scan(spark, path, [name], rows=rows, identity=True, lane="strict"), name)] if name == "bytes" else []
                with FlatFile(path) as f:
                    own = []
                    for b in f.scan(ScanOptions([name], rows=rows, target_rows=7)):
                        own += b.columns[0].values
                        b.dispose()
                assert all(x == want for x in [own, *lanes]), (codec, crc, rows, name)


class Slow(BytesSource):
    """Waits in its reads, once told to, until it is let go."""

    def __init__(self, data):
        super().__init__(data)
        self.wait, self.reached, self.go, self.closed = False, threading.Event(), threading.Event(), False

    def read(self, offset, size):
        if self.wait:
            self.reached.set()
            assert self.go.wait(10)
        assert not self.closed
        return super().read(offset, size)

    def close(self):
        self.closed = True


def test_closing_waits_for_a_decode_and_cancels_it():
    source = Slow(file([[column(*[[i] for i in range(50)])]]))
    f = FlatFile(source)
    source.wait, got = True, []

    def pull():
        try:
            got.append(next(f.scan(ScanOptions([0]))))
        except Cancelled as e:
            got.append(e)

    one_, two = threading.Thread(target=pull), threading.Thread(target=f.close)
    one_.start()
    assert source.reached.wait(10)
    two.start()
    two.join(0.2)
    # the source stays open under the read, and the decode ends at its next page
    assert two.is_alive() and not source.closed
    source.go.set()
    one_.join(10)
    two.join(10)
    assert [type(x) for x in got] == [Cancelled] and source.closed


def test_closing_ends_a_scan_between_batches():
    source = Slow(FIVE)
    f = FlatFile(source)
    s = f.scan(ScanOptions([0]))
    next(s).dispose()
    f.close()
    assert source.closed and next(s, None) is None


def test_repeated_names_go_by_ordinal(spark, tmp_path):
    path = f"{tmp_path}/f.parquet"
    open(path, "wb").write(file([[column([1, 2]), column([3, 4])]], names=("x", "x")))
    with pytest.raises(UnsupportedFeatureError):
        scan(spark, path, [1, 0])


def test_checksum_is_ordered(spark):
    rows = spark.createDataFrame([(0, 5), (1, None), (2, 7)], "row_index long, a int").repartition(3)
    want = mix_long(mix(mix(SEED, 5), 7), mix_long(SEED, 1))
    assert scan_checksum(rows, {"a": "INT32"}).head().checksum == want - (1 << 64 if want >> 63 else 0)
    assert stream_digest([1, None], "INT32") != stream_digest([None, 1], "INT32")


def test_checksums_of_row_groups(spark, tmp_path):
    path = f"{tmp_path}/f.parquet"
    pq.write_table(pa.table({"a": list(range(95)), "b": [None if i % 7 == 0 else f"x{i}".encode() for i in range(95)]}), path, row_group_size=30)
    kinds = {"a": "INT64", "b": "BYTE_ARRAY"}
    got = {r.row_group: (r.row_count, r.checksum) for r in group_checksums(scan(spark, path, ["a", "b"], identity=True).repartition(5), kinds).collect()}
    want = {g: (n, scan_checksum(scan(spark, path, ["a", "b"], row_groups=[g], identity=True), kinds).head().checksum) for g, n in enumerate((30, 30, 30, 5))}
    assert got == want


def test_the_checksum_query_folds_a_whole_table(spark):
    got = queries.bn_checksum(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.row_count for r in got) == pq.read_metadata("/root/testdata/sf0.001/lineitem.parquet").num_rows


def test_scan_of_many_files(spark, tmp_path):
    at = pa.array([0, 1], pa.timestamp("ms"))
    for i, kind in enumerate(("ms", "us", "ms")):  # two forms of one column
        pq.write_table(pa.table({"k": pa.array([2 * i, 2 * i + 1], pa.int64()), "at": at.cast(pa.timestamp(kind)), "file": ["x", "y"]}), f"{tmp_path}/{i} {kind}.parquet")
    (tmp_path / "_SUCCESS").write_text("")
    got = scan_files(spark, str(tmp_path), ["at", "k"], identity=True).collect()
    assert sorted((r.k, r.at, r.row_index) for r in got) == [(0, 0, 0), (1, 1, 1), (2, 0, 0), (3, 1000, 1), (4, 0, 0), (5, 1, 1)]
    assert len({r.file for r in got}) == 3
    assert sorted(r.file for r in scan_files(spark, str(tmp_path), ["file"]).collect()) == [b"x"] * 3 + [b"y"] * 3
    pq.write_table(pa.table({"k": pa.array([1], pa.int32())}), f"{tmp_path}/3.parquet")
    with pytest.raises(ValueError):
        scan_files(spark, str(tmp_path), ["k"])
    with pytest.raises(ValueError):
        scan_files(spark, str(tmp_path), ["at"])


def in_two(folder, table, tables="/root/testdata/sf0.001"):
    """The table as a folder of two files in one's own folder, each of two row groups."""
    rows = pq.read_table(f"{tables}/{table}.parquet")
    half = len(rows) // 2
    (folder / f"{table}.parquet").mkdir()
    for i in (0, 1):
        pq.write_table(rows.slice(i * half, half if i == 0 else None), f"{folder}/{table}.parquet/{i}.parquet", row_group_size=half // 2 + 1)
    return rows, half


def test_the_limit_query_reads_all_files_of_a_table(spark, tmp_path):
    rows, _ = in_two(tmp_path, "documents")
    want = [r["doc_id"] for r in rows.select(["doc_id", "text"]).to_pylist() if len((r["text"] or "").encode()) > 3000]
    assert sorted(r.doc_id for r in made_queries.lm_binary_value(spark, str(tmp_path)).collect()) == sorted(want) and want


def test_the_text_query_numbers_the_rows_of_each_file(spark, tmp_path):
    rows, half = in_two(tmp_path, "documents")
    got = sorted((r.row_index, r.text_md5) for r in queries.pg_binary(spark, str(tmp_path)).collect())
    assert got == sorted((i % half if i < 2 * half else i - half, hashlib.md5(t.encode()).hexdigest()) for i, t in enumerate(rows["text"].to_pylist()))


def test_the_checksum_query_goes_on_through_row_groups(spark, tmp_path):
    rows, _ = in_groups(tmp_path, "lineitem", 1000)
    values = [SEED, SEED]
    for k, f in zip(rows["l_orderkey"].to_pylist(), rows["l_returnflag"].to_pylist(), strict=True):
        values = [mix_long(values[0], k), mix(mix(values[1], ord(f)), 0x100)]
    want = SEED
    for v in values:
        want = mix_long(want, mix_long(v, SEED))
    assert [tuple(r) for r in queries.bn_checksum(spark, str(tmp_path)).collect()] == [(0, len(rows), want - (1 << 64 if want >> 63 else 0))]


def test_checksums_of_all_types(spark):
    kinds = {"b": "BOOLEAN", "i": "INT32", "l": "INT64", "f": "FLOAT", "d": "DOUBLE", "s": "BYTE_ARRAY"}
    data = [(True, -5, -(1 << 40) - 3, -1.5, -0.0, b""), (None,) * 6, (False, 7, 9, 2.25, 1e300, b"\xff\0x"), (True, None, -1, None, 3.5, None)]
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], "row_index long, b boolean, i int, l long, f float, d double, s binary")
    bits = {"f": lambda x: struct.unpack("<i", struct.pack("<f", x)), "d": lambda x: struct.unpack("<2i", struct.pack("<d", x)), "l": lambda x: (x, x >> 32), "s": lambda x: (*x, 0x100)}
    want = SEED
    for i, n in enumerate(kinds):
        value, null = SEED, SEED
        for k, r in enumerate(data):
            if r[i] is None:
                null = mix_long(null, k)
            else:
                for x in bits.get(n, lambda x: (int(x),))(r[i]):
                    value = mix(value, x)
        want = mix_long(want, mix_long(value, null))
    assert scan_checksum(rows.repartition(3), kinds).head().checksum == want - (1 << 64 if want >> 63 else 0)


def in_groups(folder, table, n, tables="/root/testdata/sf0.001"):
    """The table as one file in one's own folder, of row groups of n rows."""
    rows = pq.read_table(f"{tables}/{table}.parquet")
    pq.write_table(rows, f"{folder}/{table}.parquet", row_group_size=n)
    return rows, -(-len(rows) // n)


def test_the_query_of_readable_columns_has_a_row_a_chunk(spark, tmp_path):
    _, n = in_groups(tmp_path, "lineitem", 1000)
    in_two(tmp_path, "embeddings")
    names = pq.read_schema(f"{tmp_path}/lineitem.parquet").names
    want = [("vec_id", True), ("embedding, list, element", False), ("label", True)] * 4 + [(x, True) for x in names] * n
    assert sorted(tuple(r) for r in queries.md_columns_readable(spark, str(tmp_path)).collect()) == sorted(want) and n > 1


def test_the_schema_query_numbers_the_elements_of_all_files(spark, tmp_path):
    in_two(tmp_path, "embeddings")
    got = sorted((r.ordinal, r.name) for r in queries.md_schema(spark, str(tmp_path)).collect())
    assert got == list(enumerate(["schema", "vec_id", "embedding", "list", "element", "label"] * 2))
