"""Properties of decoders, plans and jobs, on generated cases."""

import threading
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import build
from flatscan.errors import FormatError, ScanError
from flatscan.options import ReaderOptions, RowRange, ScanOptions
from flatscan.plans.preflight import plan
from flatscan.sources.decode import hybrid
from flatscan.sources.footer import open_metadata
from flatscan.sources.ranges import BytesSource
from flatscan.sources.thrift import I32, I64, Decoder, Many, Struct, Text
from flatscan.streaming.jobs import tagged


def encoded(runs, width):
    """Hybrid bytes of (packed, values) runs; only the last packed run may be short."""
    out = b""
    for packed, values in runs:
        if packed:
            groups = -(-len(values) // 8)
            own = np.array([*values, *[0] * (8 * groups - len(values))])
            bits = (own[:, None] >> np.arange(width)) & 1
            out += build.varint(groups << 1 | 1) + np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()
        else:
            out += build.varint(len(values) << 1) + int(values[0]).to_bytes((width + 7) // 8, "little")
    return out


@given(st.data())
@settings(max_examples=200, deadline=None)
def test_hybrid_round_trips(data):
    width = data.draw(st.integers(1, 20))
    number = st.integers(0, (1 << width) - 1)
    runs = []
    for last in [False] * data.draw(st.integers(0, 4)) + [True]:
        if data.draw(st.booleans()):
            n = data.draw(st.integers(1, 3)) * 8 - (data.draw(st.integers(0, 7)) if last else 0)
            runs.append((True, [data.draw(number) for _ in range(n)]))
        else:
            runs.append((False, [data.draw(number)] * data.draw(st.integers(1, 40))))
    want = [x for _, values in runs for x in values]
    raw = encoded(runs, width)
    assert hybrid(raw, width, len(want), FormatError).tolist() == want
    with pytest.raises(FormatError):
        hybrid(raw[:-1], width, len(want), FormatError)
    with pytest.raises(FormatError):
        hybrid(raw + b"\0", width, len(want), FormatError)


SPEC = Struct("thing", {1: ("a", I32, True), 3: ("b", I64, False), 20: ("c", Text(), False), 21: ("d", Many(I64), False)})


@given(st.integers(-(1 << 31), (1 << 31) - 1), st.integers(-(1 << 63), (1 << 63) - 1), st.text(), st.lists(st.integers(-(1 << 63), (1 << 63) - 1)))
@settings(max_examples=200, deadline=None)
def test_thrift_round_trips(a, b, c, d):
    raw = build.fields([(1, build.I32, a), (3, build.I64, b), (20, build.BIN, c), (21, build.LIST, (build.I64, d)), (22, build.BIN, "unknown")])
    decoder = Decoder(raw, 0, ReaderOptions())
    assert decoder.struct(SPEC) == {"a": a, "b": b, "c": c, "d": d} and decoder.at == len(raw)
    for n in range(len(raw)):
        with pytest.raises(FormatError):
            Decoder(raw[:n], 0, ReaderOptions()).struct(SPEC)


@given(st.binary(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_bytes_are_classified(data):
    try:
        Decoder(data, 0, ReaderOptions()).struct(SPEC)
    except ScanError:
        pass
    with pytest.raises(ScanError):
        open_metadata(BytesSource(b"PAR1" + data + len(data).to_bytes(4, "little") + b"PAR1"))


@given(st.lists(st.integers(0, 5), max_size=6), st.data())
@settings(max_examples=200, deadline=None)
def test_segments_are_the_chosen_rows(sizes, data):
    meta = open_metadata(BytesSource(build.file([[build.column(list(range(n)))] for n in sizes])))
    total = sum(sizes)
    start = data.draw(st.integers(0, total))
    count = data.draw(st.integers(0, total - start))
    chosen = data.draw(st.none() | st.sets(st.integers(0, len(sizes) - 1)).map(list) if sizes else st.none())
    p = plan(meta, ScanOptions([0], chosen, RowRange(start, count)))
    got = [r for s in p.segments for r in range(s.start, s.start + s.count)]
    group = [g for g, n in enumerate(sizes) for _ in range(n)]
    assert got == [r for r in range(start, start + count) if chosen is None or group[r] in chosen]


def test_tagged_jobs_can_be_stopped(spark):
    failed = []

    def run():
        with tagged(spark) as job:
            jobs.append(job)
            try:
                spark.range(1 << 40).selectExpr("sum(id * id % 7)").collect()
            except Exception as e:  # noqa: BLE001
                failed.append(str(e))

    jobs = []
    thread = threading.Thread(target=run)
    thread.start()
    for _ in range(100):
        time.sleep(0.2)
        if jobs and spark.sparkContext.statusTracker().getActiveJobsIds():
            time.sleep(0.5)
            jobs[0].cancel()
        if failed:
            break
    thread.join(20)
    assert failed and not thread.is_alive()
