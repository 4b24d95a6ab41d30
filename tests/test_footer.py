"""Footers, limits, annotations and errors, on hand-built and mutated files."""

import pickle
import random
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from build import BIN, BOOL, I8, I32, I64, LIST, STRUCT, column, fields, file, leaf, root
from flatscan.errors import FormatError, LimitExceededError, ScanError, UnsupportedFeatureError
from flatscan.options import LIMITS, ReaderOptions, RowRange, ScanOptions
from flatscan.plans.preflight import plan
from flatscan.sources import annotations as an
from flatscan.sources import footer as ft
from flatscan.sources.pages import walk
from flatscan.sources.ranges import BytesSource, StreamSource, open_source, read_exactly


def opened(data, **limits):
    return ft.open_metadata(BytesSource(data), ReaderOptions(**limits))


GOOD = file([[column([10, 11])], [column([20, 21, 22])]])


def test_a_file_opens():
    m = opened(GOOD)
    assert (m.version, m.rows, [(g.offset, g.rows) for g in m.groups]) == (1, 5, [(0, 2), (2, 3)])
    assert m.columns[0].name == "value" and m.columns[0].reason is None and m.orders == []


@pytest.mark.parametrize(
    ("data", "kind", "offset"),
    [
        (b"PAR1PAR1", FormatError, None),
        (b"XXXX" + GOOD[4:], FormatError, 0),
        (GOOD[:-4] + b"PARE", UnsupportedFeatureError, len(GOOD) - 4),
        (GOOD[:-4] + b"XXXX", FormatError, len(GOOD) - 4),
        (GOOD[:-8] + struct.pack("<i", -1) + b"PAR1", FormatError, len(GOOD) - 8),
        (GOOD[:-8] + struct.pack("<i", 1 << 20) + b"PAR1", FormatError, len(GOOD) - 8),
        (file([[column([1])]], version=3), UnsupportedFeatureError, None),
        (file([[column([1])]], rows=2), FormatError, None),
        (file([[column([1])]], rows=-1), FormatError, None),
        (file([[column([1])]], schema=[]), FormatError, None),
        (file([[column([1])]], schema=[root(2), leaf()]), FormatError, None),
        (file([[column([1])]], schema=[root(0), leaf()]), FormatError, None),
        (file([[column([1])]], schema=[root(1), [(1, I32, 1), (4, BIN, "value")]]), FormatError, None),
        (file([[column([1])]], schema=[root(1), leaf(extra=[(5, I32, 1)])]), FormatError, None),
        (file([[column([1])]], schema=[root(1), leaf(name="other")]), FormatError, None),
        (file([[column([1])]], schema=[root(1), leaf(kind=2)]), FormatError, None),
        (file([[column([1])]], schema=[root(1), leaf(kind=7)]), FormatError, None),
        (file([[column([1])]], schema=[root(-1), leaf()]), FormatError, None),
        (file([[column([1]), column([1])]], names=("a", "b"), schema=[root(1), leaf(name="a")]), FormatError, None),
    ],
)
def test_broken_files_are_classified(data, kind, offset):
    with pytest.raises(kind) as e:
        opened(data)
    assert type(e.value) is kind or kind is FormatError
    if offset is not None:
        assert e.value.byte_offset == offset


def test_bytes_after_the_metadata_and_the_footer_limit():
    size = struct.unpack("<i", GOOD[-8:-4])[0]
    with pytest.raises(FormatError):
        opened(GOOD[:-8] + b"\0" + struct.pack("<i", size + 1) + b"PAR1")
    with pytest.raises(LimitExceededError):
        opened(GOOD, footer_bytes=10)


@pytest.mark.parametrize(
    "change",
    [
        lambda c, m: c.update({2: (I64, -1)}),
        lambda c, m: m.update({5: (I64, 1)}),
        lambda c, m: m.update({7: (I64, 1 << 40)}),
        lambda c, m: m.update({9: (I64, 1 << 40)}),
        lambda c, m: m.update({11: (I64, 1 << 40)}),
        lambda c, m: m.update({15: (I32, 4)}),
        lambda c, m: m.update({10: (I64, 1 << 40)}),
        lambda c, m: c.update({4: (I64, 4)}),
        lambda c, m: c.update({6: (I64, 4), 7: (I32, 1 << 30)}),
        lambda c, m: m.update({12: (STRUCT, [(3, I64, -1)])}),
        lambda c, m: m.update({12: (STRUCT, [(20, I64, 1), (20, I64, 1)])}),
    ],
)
def test_chunk_checks(change):
    with pytest.raises(FormatError):
        opened(file([[column([1, 2])]], change_chunk=change))


def test_unknown_fields_are_skipped_and_duplicates_are_not():
    more = [(20, STRUCT, [(1, LIST, (I32, [1, 2])), (2, BOOL, True)]), (21, BIN, b"x")]
    assert opened(file([[column([1])]], more=more)).rows == 1
    assert opened(file([[column([1])]], more=[(21, I32, 1), (21, I32, 1)])).rows == 1
    with pytest.raises(FormatError):
        opened(file([[column([1])]], more=[(6, BIN, "a"), (6, BIN, "b")]))
    with pytest.raises(FormatError):
        opened(file([[column([1])]], more=[(6, BIN, b"\xff\xfe")]))
    with pytest.raises(FormatError):
        opened(file([[column([1])]], more=[(6, I32, 1)]))


@pytest.mark.parametrize("limit", ["schema_elements", "leaf_columns", "row_groups", "metadata_string_bytes", "thrift_container_elements", "thrift_depth"])
def test_limits_bite(limit):
    data = file([[column([1]), column([1])], [column([1]), column([1])]], names=("a", "b"))
    with pytest.raises(LimitExceededError):
        opened(data, **{limit: 1})
    with pytest.raises(LimitExceededError):
        opened(file([[column([1])]], more=[(5, LIST, (STRUCT, [[(1, BIN, "k")]] * 3))]), key_value_metadata_entries=2)


def test_options_have_ranges():
    for name, (default, ceiling) in LIMITS.items():
        assert getattr(ReaderOptions(), name) == default and ReaderOptions(**{name: ceiling})
        for bad in (0, -1, ceiling + 1):
            with pytest.raises(ValueError):
                ReaderOptions(**{name: bad})
    for bad in ((-1, 1), (0, -1), (1 << 62, 1 << 62)):
        with pytest.raises(ValueError):
            RowRange(*bad)


def test_errors_cross_processes():
    e = pickle.loads(pickle.dumps(LimitExceededError("x", 1, 2, 3, 4)))
    assert (type(e), str(e), e.byte_offset, e.row_group, e.column, e.page) == (LimitExceededError, "x", 1, 2, 3, 4)


def annotated(kind, logical=None, converted=None, scale=None, precision=None, length=None):
    body = {"type": kind}
    for k, v in (("logical", logical), ("converted", converted), ("scale", scale), ("precision", precision), ("type_length", length)):
        if v is not None:
            body[k] = v
    return an.resolve(body)


def union(member, **body):
    return {"member": member, "body": body}


MICROS = {"member": 2}


@pytest.mark.parametrize(
    ("args", "status", "kind"),
    [
        ((6,), "NONE", None),
        ((6, union(1)), "MODERN_ONLY", "STRING"),
        ((6, None, 0), "LEGACY_ONLY", "STRING"),
        ((6, union(1), 0), "CONSISTENT", "STRING"),
        ((1, union(1), 0), "INVALID", None),
        ((6, union(4), 0), "CONFLICT", None),
        ((2, union(8, adjusted=True, unit=MICROS), 10), "CONSISTENT", "TIMESTAMP"),
        ((2, union(8, adjusted=False, unit=MICROS), 10), "CONFLICT", None),
        ((2, union(8, adjusted=True, unit={"member": 9})), "MODERN_ONLY", None),
        ((1, union(6), 6), "CONSISTENT", "DATE"),
        ((2, union(6)), "INVALID", None),
        ((1, union(10, width=8, signed=True), 15), "CONSISTENT", "INTEGER"),
        ((1, union(10, width=8, signed=False), 15), "CONFLICT", None),
        ((1, union(10, width=9, signed=True)), "INVALID", None),
        ((1, union(5, scale=2, precision=9), 5, 2, 9), "CONSISTENT", "DECIMAL"),
        ((1, union(5, scale=2, precision=10), 5, 2, 10), "INVALID", None),
        ((2, None, 5, 2, 18), "LEGACY_ONLY", "DECIMAL"),
        ((2, None, 5, 3, 2), "INVALID", None),
        ((1, union(5, scale=2, precision=9)), "INVALID", None),
        ((7, union(5, scale=0, precision=9), 5, 0, 9, 4), "CONSISTENT", "DECIMAL"),
        ((7, union(5, scale=0, precision=10), 5, 0, 10, 4), "INVALID", None),
        ((7, union(14), None, None, None, 16), "MODERN_ONLY", "UUID"),
        ((7, union(14), None, None, None, 15), "INVALID", None),
        ((7, None, 21, None, None, 12), "LEGACY_ONLY", "INTERVAL"),
        ((7, union(15), None, None, None, 2), "MODERN_ONLY", "FLOAT16"),
        ((1, None, 7), "LEGACY_ONLY", "TIME"),
        ((2, None, 7), "INVALID", None),
        ((1, None, 99), "LEGACY_ONLY", None),
        ((6, union(99)), "MODERN_ONLY", None),
        ((6, union(17)), "MODERN_ONLY", None),
        ((6, union(99), 0), "CONFLICT", None),
        ((1, union(11)), "MODERN_ONLY", "UNKNOWN"),
        ((None, union(3), 3), "CONSISTENT", "LIST"),
    ],
)
def test_annotations(args, status, kind):
    got, meaning = annotated(*args)
    assert (got, meaning and meaning.kind) == (status, kind)


def test_annotations_from_the_wire():
    logical = [(8, STRUCT, [(1, BOOL, False), (2, STRUCT, [(2, STRUCT, [])])])]
    m = opened(file([[column([1])]], schema=[root(1), leaf(extra=[(10, STRUCT, logical)])]))
    assert m.elements[1].status == "INVALID"
    number = [(10, STRUCT, [(1, I8, 32), (2, BOOL, True)])]
    m = opened(file([[column([1])]], schema=[root(1), leaf(extra=[(6, I32, 17), (10, STRUCT, number)])]))
    assert m.elements[1].status == "CONSISTENT" and m.elements[1].meaning.width == 32
    with pytest.raises(FormatError):
        opened(file([[column([1])]], schema=[root(1), leaf(extra=[(10, STRUCT, [])])]))


def test_why_leaves_are_unreadable():
    schema = [root(4), leaf("a", 3), leaf("b", 1, 2), leaf("c", 99), [(3, I32, 1), (4, BIN, "g"), (5, I32, 1)], leaf("d", 1)]
    m = opened(file([], names=(), schema=schema))
    assert [c.reason for c in m.columns] == [ft.INT96, ft.REPETITION_MODE, ft.UNKNOWN_TYPE, ft.NESTED]
    assert m.columns[3].element.max_definition == 1 and m.columns[1].element.max_repetition == 1


def test_names_are_exact():
    m = opened(file([[column([1]), column([2]), column([3])]], names=("x", "X", "x")))
    assert m.column("X").ordinal == 1
    for name in ("x", "y"):
        with pytest.raises(ValueError):
            m.column(name)
    assert plan(m, ScanOptions([2, 0])).names == ["c2", "c0"]


def test_ranges_are_checked():
    s = BytesSource(b"abc")
    assert read_exactly(s, 1, 2) == b"bc"
    for bad in ((-1, 1), (0, 4), (3, 1)):
        with pytest.raises(ValueError):
            read_exactly(s, *bad)
    s.length = 5
    with pytest.raises(FormatError):
        read_exactly(s, 0, 5)


def test_streams_are_closed_where_owned(tmp_path):
    (tmp_path / "f").write_bytes(GOOD)
    for owned in (True, False):
        f = open(tmp_path / "f", "rb")
        s = open_source(f, owned)
        assert isinstance(s, StreamSource) and ft.open_metadata(s).rows == 5
        s.close()
        assert f.closed == owned
        f.close()
    assert ft.open_metadata(open_source(str(tmp_path / "f"))).rows == 5


def test_mutated_files_fail_in_three_ways_only(tmp_path):
    t = pa.table({"a": pa.array([1, 2, None, 4] * 20, pa.int32()), "b": [str(i) for i in range(80)]})
    pq.write_table(t, tmp_path / "f", row_group_size=30, write_page_checksum=True)
    data, draw = (tmp_path / "f").read_bytes(), random.Random(5)
    outcomes = set()
    for _ in range(400):
        own = bytearray(data)
        for _ in range(draw.randint(1, 4)):
            own[draw.randrange(len(own))] ^= 1 << draw.randrange(8)
        s = BytesSource(bytes(own))
        try:
            m = ft.open_metadata(s)
            for g in m.groups:
                for c in g.chunks:
                    list(walk(s, m, c, payloads=True))
            outcomes.add("read")
        except ScanError as e:
            outcomes.add(type(e).__name__)
    assert {"read", "FormatError"} <= outcomes


def test_fields_helper_round_trips():
    assert fields([(1, I32, -1)]) == b"\x15\x01\x00"
