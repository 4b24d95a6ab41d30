"""Queries over files that are written anew, so that every page form is read, and over broken ones.

The tables' own files have one group, version-1 pages, Snappy and no nulls. Here a
table's columns are written again by Spark in the form in question, and read back
by the strict lane, whose decoder is this library's own. The SQL takes the same
values from the table itself.
"""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import FormatError, LimitExceededError, UnsupportedFeatureError
from .operators.metadata import files, metadata, pages
from .operators.scan import oversized_values, scan, scan_files
from .options import LIMITS, ReaderOptions, RowRange, ScanOptions
from .sources.annotations import resolve
from .sources.pages import walk
from .sources.ranges import BytesSource, StreamSource, read_exactly
from .sources.scratch import new_folder
from .streaming.session import Cancelled, FlatFile

Query = Callable[[SparkSession, str], DataFrame]

#: What a file is made with: forms of pages and chunks, by the writer's public settings.
V1 = {"compression": "snappy"}
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}
V2 = {"compression": "snappy", "parquet.writer.version": "PARQUET_2_0"}
SMALL = {"parquet.page.size": "1024", "parquet.page.size.row.check.min": "50", "parquet.page.row.count.limit": "300"}
#: Dictionaries that outgrow their limit after some pages; the rest of the chunk is plain.
MIXED = {"compression": "snappy", "parquet.dictionary.page.size": "4096", **SMALL}
GROUPS = {"compression": "snappy", "parquet.block.size": "16384", "parquet.block.size.row.check.min": "50", "parquet.page.size.row.check.min": "50"}


def written(spark: SparkSession, sf_dir: str, table: str, columns: list[str], options: dict[str, str], files_out: int = 1) -> list[str]:
    """The table's columns (SQL expressions) in new files of the given form."""
    folder = new_folder(spark, "made")
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)
    # a table of one piece is one file; a larger one has more, each scanned on its own
    (df.coalesce(files_out) if df.rdd.getNumPartitions() <= 8 else df).write.options(**options).parquet(folder)
    return files(spark, folder)


def strict(spark: SparkSession, paths: list[str], columns: list[str], **kw: object) -> DataFrame:
    out = None
    for p in paths:
        part = scan(spark, p, columns, lane="strict", **kw)
        out = part if out is None else out.unionByName(part)
    return out


NUMBERS = ["p_partkey as k", "if(p_partkey % 3 = 0, null, p_size) as i", "if(p_partkey % 5 < 2, null, p_partkey * 1000003) as l", "cast(p_retailprice as float) as f", "if(p_size > 40, null, p_retailprice) as d"]


def pg_plain_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLAIN INT32, INT64, FLOAT and DOUBLE with nulls, not compressed, in pages of version 1."""
    return strict(spark, written(spark, sf_dir, "part", NUMBERS, PLAIN), ["k", "i", "l", "f", "d"])


def pg_small_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with dictionaries, in many small pages."""
    return strict(spark, written(spark, sf_dir, "part", NUMBERS, V1 | SMALL), ["k", "i", "l", "f", "d"])


def pg_v2_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of version 2: levels apart from values, dictionaries of numbers and strings, nulls."""
    columns = ["p_size as s", "if(p_size % 4 = 1, null, p_brand) as b", "if(p_size < 10, null, p_size * 1.5D) as d"]
    return strict(spark, written(spark, sf_dir, "part", columns, V2), ["s", "b", "d"])


def pg_v2_plain_snappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of version 2 with PLAIN doubles and floats, whose values alone are compressed."""
    columns = ["p_retailprice as d", "if(p_partkey % 7 = 0, null, cast(p_retailprice as float)) as f"]
    return strict(spark, written(spark, sf_dir, "part", columns, V2 | {"parquet.enable.dictionary": "false"}), ["d", "f"])


def pg_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLAIN booleans, some of them null."""
    return strict(spark, written(spark, sf_dir, "part", ["p_partkey as k", "p_size > 25 as b", "if(p_size % 2 = 0, null, p_size > 10) as c"], PLAIN), ["k", "b", "c"])


def pg_validity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition levels in long runs, in bit-packed groups, all null and all valid."""
    columns = ["p_partkey as k", "if(p_partkey < 700, null, p_size) as a", "if(p_partkey % 2 = 0, null, p_size) as b", "cast(null as int) as c", "p_size as d"]
    return strict(spark, written(spark, sf_dir, "part", columns, V1), ["k", "a", "b", "c", "d"])


def pg_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXED_LEN_BYTE_ARRAY, plain: the nine bytes of a wide decimal."""
    columns = ["p_partkey as k", "if(p_partkey % 6 = 0, null, cast(p_retailprice as decimal(20,2))) as f"]
    return strict(spark, written(spark, sf_dir, "part", columns, PLAIN), ["k", "f"]).select("k", F.hex("f").alias("f"))


def pg_fixed_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a dictionary."""
    columns = ["p_partkey as k", "cast(p_size as decimal(20,0)) as f"]
    return strict(spark, written(spark, sf_dir, "part", columns, V1), ["k", "f"]).select("k", F.hex("f").alias("f"))


#: Few different values at first, so that a dictionary is begun, and many later.
GROWING = "if(p_partkey <= 600, p_brand, concat(p_name, ' ', p_partkey))"


def pg_mixed_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that begin with a dictionary and go on plain."""
    columns = ["p_partkey as k", f"{GROWING} as n", "if(p_partkey % 4 = 0, null, if(p_partkey <= 600, p_size, p_retailprice)) as d"]
    return strict(spark, written(spark, sf_dir, "part", columns, MIXED), ["k", "n", "d"])


def pg_mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of those chunks: which have data pages of both encodings, and the checksum state and values of all."""
    out = None
    for p in written(spark, sf_dir, "part", [f"{GROWING} as n"], MIXED):
        part = pages(spark, p, payloads=True).where("kind <> 'dictionary'")
        out = part if out is None else out.unionByName(part)
    both = F.count_distinct(F.col("encoding_code") == 0) == 2
    return out.groupBy("column", "crc").agg(both.alias("both_encodings"), F.sum("values").alias("values"))


def pg_binary_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLAIN BYTE_ARRAY of whole texts, null and empty ones told apart."""
    columns = ["doc_id as k", "case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then '' else text end as t"]
    out = strict(spark, written(spark, sf_dir, "documents", columns, {"compression": "snappy", "parquet.enable.dictionary": "false"}), ["k", "t"])
    return out.select("k", F.md5("t").alias("text_md5"), F.octet_length("t").cast("long").alias("bytes"))


def pg_strict_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table as it is, by the strict lane."""
    return scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"], lane="strict")


def sc_many_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second group of a file with many, a range of its rows, by the row-group lane."""
    out = None
    for p in written(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"], GROUPS):
        groups = [r.ordinal for r in metadata(spark, p, "row_groups").collect()]
        halves = [scan(spark, p, ["o_totalprice", "o_orderkey"], row_groups=groups[k::2], lane="row_group") for k in (0, 1)]
        part = halves[0].unionByName(halves[1])
        out = part if out is None else out.unionByName(part)
    return out


def sc_many_groups_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and first rows of each group as the native lane numbers them, against the footer."""
    out = None
    for p in written(spark, sf_dir, "orders", ["o_orderkey"], GROUPS):
        own = scan(spark, p, ["o_orderkey"], lane="native", identity=True).groupBy("row_group").agg(F.count("*").alias("n"), F.min("row_index").alias("first"))
        said = metadata(spark, p, "row_groups").select(F.col("ordinal").cast("long").alias("row_group"), "row_count", "row_offset")
        part = own.join(said, "row_group", "full").select(F.coalesce((F.col("n") == F.col("row_count")) & (F.col("first") == F.col("row_offset")), F.lit(False)).alias("right"), "n")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("right").agg(F.sum("n").alias("row_count"))


def sc_row_range_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], rows=RowRange(1000, 1000), lane="strict", identity=True)


def sc_row_range_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], rows=RowRange(1000, 1000), lane="native", identity=True)


ANNOTATED = ["cast(p_size as tinyint) as i8", "cast(p_size as smallint) as i16", "p_size as i32", "cast(p_retailprice as decimal(9,2)) as d9", "cast(p_retailprice as decimal(18,2)) as d18", "cast(p_retailprice as decimal(20,2)) as d20", "date_add(date'2000-01-01', p_size) as day", "p_name as name", "cast(p_name as binary) as raw"]


def md_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of written columns: union members, and the meaning that they resolve to."""
    path = written(spark, sf_dir, "part", ANNOTATED, V1)[0]
    out = metadata(spark, path, "schema_elements").where("physical_type is not null")
    return out.select("name", "physical_type", "type_length", "logical_type", "converted_type", "status", "semantic_kind", "semantic_scale", "semantic_precision", "integer_width", "integer_signed")


def md_stats_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw least and greatest value of string and number columns; numbers as the bytes are stored, lowest first."""
    out = metadata(spark, f"{sf_dir}/customer.parquet", "chunk_statistics").where(F.element_at("path", 1).isin("c_name", "c_mktsegment", "c_custkey", "c_nationkey"))
    return out.select(F.element_at("path", 1).alias("name"), "present", F.hex("min").alias("least"), F.hex("max").alias("greatest"), "null_count")


def md_stats_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of nulls alone have a null count and no least or greatest value."""
    path = written(spark, sf_dir, "part", ["p_size as a", "cast(null as int) as n", "cast(null as string) as s"], V1)[0]
    return metadata(spark, path, "chunk_statistics").select(F.element_at("path", 1).alias("name"), F.col("min").isNull().alias("no_min"), F.col("max").isNull().alias("no_max"), (F.col("null_count") > 0).alias("nulls"))


def md_column_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(spark, f"{sf_dir}/orders.parquet", "columns").select("name", "column_order")


def md_row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a file claims, and those that its groups add up to."""
    path = f"{sf_dir}/orders.parquet"
    groups = metadata(spark, path, "row_groups").groupBy("file").agg(F.sum("row_count").alias("group_rows"))
    return metadata(spark, path, "file_metadata").join(groups, "file").select("row_count", "group_rows")


def md_annotation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and meaning of annotations by cases, from legacy codes, members of the modern union and physical types."""
    stamp = {"member": 8, "body": {"adjusted": True, "unit": {"member": 2}}}
    decimal = {"member": 5, "body": {"scale": 2, "precision": 9}}
    cases = {
        "nothing": {"type": 1},
        "string, legacy": {"type": 6, "converted": 0},
        "string, both": {"type": 6, "converted": 0, "logical": {"member": 1}},
        "string and enum": {"type": 6, "converted": 0, "logical": {"member": 4}},
        "string of numbers": {"type": 1, "converted": 0},
        "date": {"type": 1, "converted": 6, "logical": {"member": 6}},
        "date of 64 bits": {"type": 2, "logical": {"member": 6}},
        "timestamp, both": {"type": 2, "converted": 10, "logical": stamp},
        "timestamp, local": {"type": 2, "converted": 10, "logical": {"member": 8, "body": {"adjusted": False, "unit": {"member": 2}}}},
        "timestamp, other unit": {"type": 2, "converted": 9, "logical": stamp},
        "time without unit": {"type": 1, "logical": {"member": 7, "body": {"adjusted": True, "unit": {"member": 9}}}},
        "time of 32 bits": {"type": 1, "converted": 7},
        "time of 64 bits in millis": {"type": 2, "converted": 7},
        "decimal, both": {"type": 1, "converted": 5, "scale": 2, "precision": 9, "logical": decimal},
        "decimal, other precision": {"type": 1, "converted": 5, "scale": 2, "precision": 8, "logical": decimal},
        "decimal of ten digits": {"type": 1, "converted": 5, "scale": 0, "precision": 10},
        "decimal of four bytes": {"type": 7, "type_length": 4, "converted": 5, "scale": 0, "precision": 9},
        "decimal of ten digits, four bytes": {"type": 7, "type_length": 4, "converted": 5, "scale": 0, "precision": 10},
        "scale over precision": {"type": 2, "converted": 5, "scale": 3, "precision": 2},
        "integer of 16": {"type": 1, "logical": {"member": 10, "body": {"width": 16, "signed": False}}},
        "integer of 9": {"type": 1, "logical": {"member": 10, "body": {"width": 9, "signed": True}}},
        "integer, other sign": {"type": 1, "converted": 15, "logical": {"member": 10, "body": {"width": 8, "signed": False}}},
        "uuid": {"type": 7, "type_length": 16, "logical": {"member": 14}},
        "uuid of 15": {"type": 7, "type_length": 15, "logical": {"member": 14}},
        "interval": {"type": 7, "type_length": 12, "converted": 21},
        "unknown member": {"type": 6, "logical": {"member": 99}},
        "unknown code": {"type": 6, "converted": 99},
    }
    rows = [(k, status, m.kind if m else None) for k, (status, m) in ((k, resolve(x)) for k, x in cases.items())]
    return spark.createDataFrame(rows, "case string, status string, kind string")


def pg_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns without nulls by their schema, whose pages have no levels, and a range of rows that begins within a page."""
    path = written(spark, sf_dir, "nation", REQUIRED, PLAIN)[0]
    return scan(spark, path, ["k", "n"], rows=RowRange(7, 11), lane="strict").select("k", F.col("n").cast("string").alias("n"))


#: Expressions that can't be null, so that their columns are written as required.
REQUIRED = ["coalesce(n_nationkey, 0) as k", "coalesce(n_name, '') as n"]


def sc_range_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of payload that a range of three rows reads: its own of a plain page, a whole page where that has a checksum."""
    out = []
    for crc in ("false", "true"):
        data = _content(spark, written(spark, sf_dir, "nation", REQUIRED[:1], PLAIN | {"parquet.page.write-checksum.enabled": crc})[0])
        source = _Counted(data)
        with FlatFile(source) as f:
            (chunk,) = f.metadata.groups[0].chunks
            heads = {p.offset for p in walk(source, f.metadata, chunk)}
            source.ranges.clear()
            rows = [v for b in f.scan(ScanOptions(["k"], rows=RowRange(20, 3))) for v in b.columns[0].values]
        out.append((crc == "true", len(rows), sum(n for at, n in source.ranges if at not in heads)))
    return spark.createDataFrame(out, "checksum boolean, n int, bytes int")


def er_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages past a limit or of a form outside the profile."""
    forms = {"plain": PLAIN, "dictionary": {"compression": "snappy"}, "delta": {**PLAIN, "parquet.writer.version": "PARQUET_2_0"}, "small": {**PLAIN, **SMALL, "parquet.page.size.row.check.min": "5", "parquet.page.row.count.limit": "5"}}
    data = {k: _content(spark, written(spark, sf_dir, "nation", ["n_nationkey as k", "n_name as n", "n_regionkey > 2 as b", "repeat(cast(n_regionkey as string), 40) as r"], x)[0]) for k, x in forms.items()}

    def read(form: str, columns: list[str], **limits: int) -> Callable[[], object]:
        return lambda: _rows(FlatFile(data[form], ReaderOptions(**limits)), columns)

    cases = {
        "plain": read("plain", ["k", "n", "b"]),
        "dictionary": read("dictionary", ["k", "r"]),
        "delta numbers": read("delta", ["k"]),
        "delta strings": read("delta", ["n"]),
        "run-length booleans": read("delta", ["b"]),
        "small pages": read("small", ["k", "n", "b"]),
        "pages of a chunk": read("small", ["k"], pages_per_column_chunk=1),
        "values of a page": read("plain", ["k"], values_per_page=24),
        "header bytes": read("plain", ["k"], page_header_bytes=3),
        "compressed bytes": read("plain", ["k"], compressed_page_bytes=99),
        "uncompressed bytes": read("plain", ["k"], uncompressed_page_bytes=99),
        "dictionary entries": read("dictionary", ["r"], dictionary_entries=4),
        "dictionary bytes": read("dictionary", ["r"], dictionary_bytes=99),
        "value bytes": read("plain", ["n"], binary_value_bytes=5),
        "batch bytes": read("plain", ["n"], binary_batch_bytes=5),
        "budget": read("plain", ["k"], scan_pooled_bytes=4),
        "encoding before limit": read("delta", ["k"], values_per_page=1),
    }
    return spark.createDataFrame([(k, _outcome(f)) for k, f in cases.items()], "case string, outcome string")


def _content(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])


class _Counted:
    """A source of one's own: bytes, with what is read of them."""

    def __init__(self, data: bytes, short: int = 0):
        self.data, self.length, self.reads, self.short = data, len(data), 0, short
        self.ranges: list[tuple[int, int]] = []

    def read(self, offset: int, size: int) -> bytes:
        self.reads += 1
        self.ranges.append((offset, size))
        return self.data[offset : offset + size - (self.short if self.reads > 3 else 0)]

    def close(self) -> None:
        pass


def _rows(f: FlatFile, columns: list[str]) -> list[tuple]:
    out = []
    for b in f.scan(ScanOptions(columns)):
        out += zip(*(c.values for c in b.columns), strict=True)
        b.dispose()
    return out


def _named(rows: list[tuple]) -> list[tuple]:
    return [tuple(x.decode() if isinstance(x, bytes) else x for x in r) for r in rows]


def src_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file in memory."""
    with FlatFile(_content(spark, f"{sf_dir}/nation.parquet")) as f:
        return spark.createDataFrame(_named(_rows(f, ["n_name", "n_nationkey"])), "n_name string, n_nationkey int")


def src_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file behind a stream, which stays open where it isn't owned and is closed where it is."""
    data = _content(spark, f"{sf_dir}/region.parquet")
    out = []
    for owned in (False, True):
        stream = io.BytesIO(data)
        with FlatFile(stream, owned=owned) as f:
            rows = _named(_rows(f, ["r_regionkey", "r_name"]))
        out += [(owned, stream.closed, *r) for r in rows]
    return spark.createDataFrame(out, "owned boolean, closed boolean, r_regionkey int, r_name string")


def src_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file behind a source of one's own, and how many reads opening takes."""
    source = _Counted(_content(spark, f"{sf_dir}/nation.parquet"))
    with FlatFile(source) as f:
        opened = source.reads
        return spark.createDataFrame([(opened, *r) for r in _named(_rows(f, ["n_regionkey", "n_name"]))], "open_reads int, n_regionkey int, n_name string")


def _outcome(fn: Callable[[], object]) -> str:
    kinds = {FormatError: "format", UnsupportedFeatureError: "unsupported", LimitExceededError: "limit", Cancelled: "cancelled", ValueError: "argument", IndexError: "argument", RuntimeError: "state"}
    try:
        fn()
    except tuple(kinds) as e:
        return kinds[type(e)]
    return "fine"


def er_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What opening a broken, foreign or oversized file is."""
    data = _content(spark, f"{sf_dir}/nation.parquet")
    size = int.from_bytes(data[-8:-4], "little")

    def tail(n: int) -> bytes:
        return data[:-8] + n.to_bytes(4, "little", signed=True) + b"PAR1"

    cases = {
        "whole": lambda: FlatFile(data),
        "short": lambda: FlatFile(data[:11]),
        "head": lambda: FlatFile(b"PARX" + data[4:]),
        "tail": lambda: FlatFile(data[:-1] + b"X"),
        "encrypted": lambda: FlatFile(data[:-4] + b"PARE"),
        "negative footer": lambda: FlatFile(tail(-1)),
        "footer outside": lambda: FlatFile(tail(len(data))),
        "footer cut": lambda: FlatFile(tail(size - 1)),
        "footer limit": lambda: FlatFile(data, ReaderOptions(footer_bytes=size - 1)),
        "leaf limit": lambda: FlatFile(data, ReaderOptions(leaf_columns=2)),
        "element limit": lambda: FlatFile(data, ReaderOptions(schema_elements=3)),
        "depth limit": lambda: FlatFile(data, ReaderOptions(thrift_depth=1)),
        "string limit": lambda: FlatFile(data, ReaderOptions(metadata_string_bytes=4)),
        "option range": lambda: ReaderOptions(row_groups=0),
        "option ceiling": lambda: ReaderOptions(thrift_depth=257),
        "negative read": lambda: read_exactly(BytesSource(data), -1, 4),
        "read past the end": lambda: read_exactly(BytesSource(data), len(data) - 3, 4),
        "short read": lambda: _rows(FlatFile(_Counted(data, short=1)), ["n_name"]),
        "closed stream": lambda: StreamSource(io.BytesIO(b"")).read(0, 0),
    }
    return spark.createDataFrame([(k, _outcome(f)) for k, f in cases.items()], "case string, outcome string")


def er_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a wrong scan is, before anything is read."""
    path, nested = f"{sf_dir}/orders.parquet", f"{sf_dir}/embeddings.parquet"
    n = metadata(spark, path, "file_metadata").head()["row_count"]
    key = ["o_orderkey"]
    cases = {
        "no column": lambda: scan(spark, path, []),
        "column twice": lambda: scan(spark, path, ["o_orderkey", 0]),
        "absent name": lambda: scan(spark, path, ["O_ORDERKEY"]),
        "absent ordinal": lambda: scan(spark, path, [99]),
        "nested": lambda: scan(spark, nested, [1]),
        "group twice": lambda: scan(spark, path, key, row_groups=[0, 0]),
        "absent group": lambda: scan(spark, path, key, row_groups=[1 << 20]),
        "rows outside": lambda: scan(spark, path, key, rows=RowRange(n, 1)),
        "rows outside, no group": lambda: scan(spark, path, key, rows=RowRange(n + 1, 0), row_groups=[]),
        "negative rows": lambda: RowRange(-1, 1),
        "rows overflow": lambda: RowRange((1 << 63) - 1, 1),
        "no target": lambda: scan(spark, path, key, target_rows=0),
        "target over limit": lambda: scan(spark, path, key, target_rows=1 << 30),
        "null column": lambda: ScanOptions([None]),
        "no lane": lambda: scan(spark, path, key, lane="other"),
        "empty rows": lambda: scan(spark, path, key, rows=RowRange(n, 0)),
    }
    return spark.createDataFrame([(k, _outcome(f)) for k, f in cases.items()], "case string, outcome string")


def er_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codecs outside the profile are refused where their chunks are chosen; rows of the others come."""
    out = []
    for codec in ("uncompressed", "snappy", "gzip", "zstd"):
        path = written(spark, sf_dir, "nation", ["n_nationkey", "n_name"], {"compression": codec})[0]
        out.append((codec, _outcome(lambda p=path: scan(spark, p, ["n_name"])), _outcome(lambda p=path: scan(spark, p, ["n_name"], row_groups=[]))))
    return spark.createDataFrame(out, "codec string, outcome string, no_group string")


def er_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flipped bit in a page's payload, by place: the error has the chunk and the page."""
    data = _content(spark, written(spark, sf_dir, "nation", ["n_nationkey", "n_name"], PLAIN)[0])
    out = []
    with FlatFile(data) as f:
        chunks = [c for g in f.metadata.groups for c in g.chunks]
    for c in chunks:
        broken = bytearray(data)
        broken[c.first_page + c.meta["compressed"] - 1] ^= 1
        try:
            _rows(FlatFile(bytes(broken)), ["n_nationkey", "n_name"])
            out.append((c.column, "fine", None, None))
        except FormatError as e:
            out.append((c.column, "format", e.row_group, e.page))
    return spark.createDataFrame(out, "column int, outcome string, row_group int, page int")


def lm_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every limit with its default and ceiling; both are taken, one more than the ceiling isn't."""
    rows = [(k, ceiling, getattr(ReaderOptions(), k) == default and getattr(ReaderOptions(**{k: ceiling}), k) == ceiling, _outcome(lambda k=k, c=ceiling: ReaderOptions(**{k: c + 1}))) for k, (default, ceiling) in LIMITS.items()]
    return spark.createDataFrame(rows, "name string, ceiling long, taken boolean, beyond string")


def lm_binary_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text passes the limit of a value's bytes."""
    rows = scan_files(spark, f"{sf_dir}/documents.parquet", ["doc_id", "text"])
    return oversized_values(rows, ["text"], ReaderOptions(binary_value_bytes=3000)).select("doc_id")


def lf_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session makes of calls out of order."""
    data = _content(spark, f"{sf_dir}/nation.parquet")
    key = ScanOptions(["n_nationkey"], target_rows=10)

    def overlap() -> None:
        with FlatFile(data) as f:
            first = f.scan(key)
            next(first)
            next(f.scan(key))

    def undisposed() -> None:
        with FlatFile(data) as f:
            s = f.scan(key)
            next(s)
            next(s)

    def disposed() -> None:
        with FlatFile(data) as f:
            b = next(f.scan(key))
            b.dispose()
            b.dispose()
            _ = b.columns

    def cancelled() -> None:
        with FlatFile(data) as f:
            s = f.scan(key)
            with next(s):
                f.cancel()
            next(s)

    def closed() -> None:
        f = FlatFile(data)
        f.close()
        f.close()
        f.scan(key)

    def again() -> None:
        with FlatFile(data) as f:
            for _ in range(2):
                _rows(f, ["n_name"])

    def outside() -> None:
        with FlatFile(data) as f, next(f.scan(key)) as b:
            b.columns[0].is_valid(10)

    def ended() -> None:
        f = FlatFile(data)
        s = f.scan(key)
        with next(s):
            f.close()
        if next(s, None) is not None:
            raise AssertionError("a closed file went on")

    cases = {"overlap": overlap, "undisposed": undisposed, "disposed": disposed, "cancelled": cancelled, "closed": closed, "again": again, "outside": outside, "ended by close": ended}
    return spark.createDataFrame([(k, _outcome(f)) for k, f in cases.items()], "case string, outcome string")


def _batches(spark: SparkSession, data: bytes, scan_: ScanOptions, options: ReaderOptions | None = None) -> DataFrame:
    rows = []
    with FlatFile(data, options) as f:
        for b in f.scan(scan_):
            rows.append((b.row_offset, b.row_group, b.offset_in_group, b.row_count))
            b.dispose()
    return spark.createDataFrame(rows, "row_offset long, row_group int, offset_in_group long, row_count int")


def bt_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a session: rows from 3 on, seven at a time."""
    return _batches(spark, _content(spark, f"{sf_dir}/nation.parquet"), ScanOptions(["n_name", "n_nationkey"], rows=RowRange(3, 20), target_rows=7))


def bt_binary_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches cut where the bytes of names pass a limit."""
    return _batches(spark, _content(spark, f"{sf_dir}/nation.parquet"), ScanOptions(["n_name"]), ReaderOptions(binary_batch_bytes=40))


def bt_halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches halved from the rows that are left until they fit a budget of 30 bytes: n rows take 4 n, and n / 8 of validity."""
    return _batches(spark, _content(spark, f"{sf_dir}/nation.parquet"), ScanOptions(["n_nationkey"]), ReaderOptions(scan_pooled_bytes=30))


def bt_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets, payload and validity bitmap of a batch with nulls."""
    data = _content(spark, written(spark, sf_dir, "nation", ["n_nationkey as k", "if(n_nationkey % 4 = 1, null, n_name) as n"], PLAIN)[0])
    with FlatFile(data) as f, next(f.scan(ScanOptions(["n"]))) as b:
        v = b.columns[0]
        return spark.createDataFrame([(v.offsets, bytearray(v.payload), bytearray(v.bitmap), v.all_valid)], "offsets array<int>, payload binary, bitmap binary, all_valid boolean")


def bt_fixed_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload of fixed-width values, with zeros for the nulls."""
    data = _content(spark, written(spark, sf_dir, "nation", ["if(n_nationkey % 3 = 0, null, cast(n_nationkey as decimal(20,0))) as f"], PLAIN)[0])
    with FlatFile(data) as f, next(f.scan(ScanOptions(["f"]))) as b:
        return spark.createDataFrame([(b.row_count, bytearray(b.columns[0].payload))], "row_count int, payload binary")


def bt_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of two columns whose pages end in different rows: every batch has both, row by row."""
    path = written(spark, sf_dir, "nation", ["n_nationkey as k", "repeat(n_name, 20) as n"], PLAIN | SMALL | {"parquet.page.size": "200", "parquet.page.size.row.check.min": "1", "parquet.page.row.count.limit": "4"})[0]
    out = []
    with FlatFile(_content(spark, path)) as f:
        for b in f.scan(ScanOptions(["k", "n"], target_rows=3)):
            out += [(k, n.decode()) for k, n in zip(b.columns[0].values, b.columns[1].values, strict=True)]
            b.dispose()
    return spark.createDataFrame(out, "k int, n string")


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.split("_")[0] in ("md", "sc", "pg", "bt", "src", "er", "lm", "lf")}


def _values(columns: str, rows: list[tuple]) -> str:
    def text(x: object) -> str:
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x) + "'"

    return f"select * from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


def _little(value: str, bytes_: int) -> str:
    """Hex of a whole number, lowest byte first."""
    digits = f"printf('%0{2 * bytes_}X', {value})"
    return " || ".join(f"substr({digits}, {2 * i + 1}, 2)" for i in reversed(range(bytes_)))


def oracle_sql(sf_dir: str) -> dict[str, str]:
    """DuckDB SQL by query; sf_dir is where SQL that needs a file's own numbering finds the tables."""
    mib, gib = 1 << 20, 1 << 30
    numbered = "(select *, file_row_number as row from read_parquet('{}/{}.parquet', file_row_number=true))".format
    return {
        "pg_plain_numbers": "select p_partkey as k, case when p_partkey % 3 <> 0 then p_size end as i, case when p_partkey % 5 >= 2 then p_partkey * 1000003 end as l, cast(p_retailprice as float) as f, case when p_size <= 40 then p_retailprice end as d from part",
        "pg_small_pages": "select p_partkey as k, case when p_partkey % 3 <> 0 then p_size end as i, case when p_partkey % 5 >= 2 then p_partkey * 1000003 end as l, cast(p_retailprice as float) as f, case when p_size <= 40 then p_retailprice end as d from part",
        "pg_v2_dictionary": "select p_size as s, case when p_size % 4 <> 1 then encode(p_brand) end as b, case when p_size >= 10 then p_size * cast(1.5 as double) end as d from part",
        "pg_v2_plain_snappy": "select p_retailprice as d, case when p_partkey % 7 <> 0 then cast(p_retailprice as float) end as f from part",
        "pg_boolean": "select p_partkey as k, p_size > 25 as b, case when p_size % 2 <> 0 then p_size > 10 end as c from part",
        "pg_validity_runs": "select p_partkey as k, case when p_partkey >= 700 then p_size end as a, case when p_partkey % 2 <> 0 then p_size end as b, cast(null as int) as c, p_size as d from part",
        "pg_fixed": "select p_partkey as k, case when p_partkey % 6 <> 0 then printf('%018X', cast(round(p_retailprice * 100) as bigint)) end as f from part",
        "pg_fixed_dictionary": "select p_partkey as k, printf('%018X', cast(p_size as bigint)) as f from part",
        "pg_mixed_encodings": "select p_partkey as k, encode(case when p_partkey <= 600 then p_brand else p_name || ' ' || p_partkey end) as n, case when p_partkey % 4 <> 0 then case when p_partkey <= 600 then p_size else p_retailprice end end as d from part",
        "pg_mixed_pages": """select cast(0 as int) as "column", 'OK' as crc, true as both_encodings, count(*) as "values" from part""",
        "pg_binary_strict": "select k, md5(t) as text_md5, cast(octet_length(encode(t)) as bigint) as bytes from (select doc_id as k, case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then '' else text end as t from documents)",
        "pg_strict_lineitem": "select l_orderkey, l_linenumber, l_extendedprice, encode(l_returnflag) as l_returnflag, epoch_us(l_shipdate) as l_shipdate from lineitem",
        "sc_many_groups": "select o_totalprice, o_orderkey from orders",
        "sc_many_groups_native": """select true as "right", count(*) as row_count from orders""",
        "sc_row_range_strict": f"select l_orderkey, l_quantity, row as row_index, cast(0 as bigint) as row_group from {numbered(sf_dir, 'lineitem')} where row between 1000 and 1999",
        "sc_row_range_native": f"select l_orderkey, l_quantity, row as row_index, cast(0 as bigint) as row_group from {numbered(sf_dir, 'lineitem')} where row between 1000 and 1999",
        "md_logical": _values(
            "name, physical_type, type_length, logical_type, converted_type, status, semantic_kind, semantic_scale, semantic_precision, integer_width, integer_signed",
            [
                ("i8", "INT32", None, "INTEGER", "INT_8", "CONSISTENT", "INTEGER", None, None, 8, True),
                ("i16", "INT32", None, "INTEGER", "INT_16", "CONSISTENT", "INTEGER", None, None, 16, True),
                ("i32", "INT32", None, None, None, "NONE", None, None, None, None, None),
                ("d9", "INT32", None, "DECIMAL", "DECIMAL", "CONSISTENT", "DECIMAL", 2, 9, None, None),
                ("d18", "INT64", None, "DECIMAL", "DECIMAL", "CONSISTENT", "DECIMAL", 2, 18, None, None),
                ("d20", "FIXED_LEN_BYTE_ARRAY", 9, "DECIMAL", "DECIMAL", "CONSISTENT", "DECIMAL", 2, 20, None, None),
                ("day", "INT32", None, "DATE", "DATE", "CONSISTENT", "DATE", None, None, None, None),
                ("name", "BYTE_ARRAY", None, "STRING", "UTF8", "CONSISTENT", "STRING", None, None, None, None),
                ("raw", "BYTE_ARRAY", None, None, None, "NONE", None, None, None, None, None),
            ],
        ),
        "md_annotation_rules": _values(
            '"case", status, kind',
            [
                ("nothing", "NONE", None), ("string, legacy", "LEGACY_ONLY", "STRING"), ("string, both", "CONSISTENT", "STRING"), ("string and enum", "CONFLICT", None), ("string of numbers", "INVALID", None),
                ("date", "CONSISTENT", "DATE"), ("date of 64 bits", "INVALID", None), ("timestamp, both", "CONSISTENT", "TIMESTAMP"), ("timestamp, local", "CONFLICT", None), ("timestamp, other unit", "CONFLICT", None),
                ("time without unit", "MODERN_ONLY", None), ("time of 32 bits", "LEGACY_ONLY", "TIME"), ("time of 64 bits in millis", "INVALID", None), ("decimal, both", "CONSISTENT", "DECIMAL"),
                ("decimal, other precision", "INVALID", None), ("decimal of ten digits", "INVALID", None), ("decimal of four bytes", "LEGACY_ONLY", "DECIMAL"), ("decimal of ten digits, four bytes", "INVALID", None),
                ("scale over precision", "INVALID", None), ("integer of 16", "MODERN_ONLY", "INTEGER"), ("integer of 9", "INVALID", None), ("integer, other sign", "CONFLICT", None), ("uuid", "MODERN_ONLY", "UUID"),
                ("uuid of 15", "INVALID", None), ("interval", "LEGACY_ONLY", "INTERVAL"), ("unknown member", "MODERN_ONLY", None), ("unknown code", "LEGACY_ONLY", None),
            ],
        ),
        "pg_required": f"select n_nationkey as k, n_name as n from {numbered(sf_dir, 'nation')} where row between 7 and 17",
        "sc_range_bytes": _values("checksum, n, bytes", [(False, 3, 12), (True, 3, 100)]),
        "er_pages": _values(
            '"case", outcome',
            [
                ("plain", "fine"), ("dictionary", "fine"), ("small pages", "fine"), ("delta numbers", "unsupported"), ("delta strings", "unsupported"), ("run-length booleans", "unsupported"),
                *((k, "limit") for k in ("pages of a chunk", "values of a page", "header bytes", "compressed bytes", "uncompressed bytes", "dictionary entries", "dictionary bytes", "value bytes", "batch bytes", "budget")),
                ("encoding before limit", "unsupported"),
            ],
        ),
        "md_stats_bytes": " union all ".join(
            f"select '{c}' as name, true as present, {form(f'min({c})')} as least, {form(f'max({c})')} as greatest, count(*) - count({c}) as null_count from customer"
            for c, form in (("c_name", lambda x: f"hex({x})"), ("c_mktsegment", lambda x: f"hex({x})"), ("c_custkey", lambda x: _little(x, 8)), ("c_nationkey", lambda x: _little(x, 4)))
        ),
        "md_stats_absent": _values("name, no_min, no_max, nulls", [("a", False, False, False), ("n", True, True, True), ("s", True, True, True)]),
        "md_column_orders": _values("name, column_order", [(c, "TYPE_DEFINED") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]),
        "md_row_sums": "select count(*) as row_count, count(*) as group_rows from orders",
        "src_bytes": "select n_name, n_nationkey from nation",
        "src_stream": "select owned, owned as closed, r_regionkey, r_name from region, (values (false), (true)) t(owned)",
        "src_custom": "select 3 as open_reads, n_regionkey, n_name from nation",
        "er_open": _values(
            '"case", outcome',
            [
                ("whole", "fine"), ("short", "format"), ("head", "format"), ("tail", "format"), ("encrypted", "unsupported"), ("negative footer", "format"), ("footer outside", "format"),
                ("footer cut", "format"), ("footer limit", "limit"), ("leaf limit", "limit"), ("element limit", "limit"), ("depth limit", "limit"), ("string limit", "limit"),
                ("option range", "argument"), ("option ceiling", "argument"), ("negative read", "argument"), ("read past the end", "argument"), ("short read", "format"), ("closed stream", "fine"),
            ],
        ),
        "er_plan": _values(
            '"case", outcome',
            [
                *((k, "argument") for k in ("no column", "column twice", "absent name", "absent ordinal", "group twice", "absent group", "rows outside", "rows outside, no group", "negative rows", "rows overflow", "no target", "target over limit", "null column", "no lane")),
                ("nested", "unsupported"),
                ("empty rows", "fine"),
            ],
        ),
        "er_codec": _values("codec, outcome, no_group", [("uncompressed", "fine", "fine"), ("snappy", "fine", "fine"), ("gzip", "unsupported", "fine"), ("zstd", "unsupported", "fine")]),
        "er_crc": _values('"column", outcome, row_group, page', [(0, "format", 0, 0), (1, "format", 0, 0)]),
        "lm_limits": _values(
            "name, ceiling, taken, beyond",
            [
                (k, v, True, "argument")
                for k, v in {
                    "footer_bytes": gib, "thrift_depth": 256, "thrift_container_elements": 16_777_216, "schema_elements": 1_048_576, "leaf_columns": 65_536, "row_groups": 1_048_576,
                    "key_value_metadata_entries": 1_048_576, "metadata_string_bytes": 256 * mib, "page_header_bytes": 16 * mib, "compressed_page_bytes": gib, "uncompressed_page_bytes": gib,
                    "pages_per_column_chunk": 16_777_216, "dictionary_entries": 134_217_728, "dictionary_bytes": gib, "values_per_page": 134_217_728, "binary_value_bytes": gib,
                    "rows_per_batch": 16_777_216, "binary_batch_bytes": gib, "scan_pooled_bytes": 8 * gib,
                }.items()
            ],
        ),
        "lm_binary_value": "select doc_id from documents where octet_length(encode(text)) > 3000",
        "lf_states": _values('"case", outcome', [("overlap", "state"), ("undisposed", "state"), ("disposed", "state"), ("cancelled", "cancelled"), ("closed", "state"), ("again", "fine"), ("outside", "argument"), ("ended by close", "fine")]),
        "bt_session": "select cast(a as bigint) as row_offset, 0 as row_group, cast(a as bigint) as offset_in_group, least(7, 23 - a) as row_count from range(3, 23, 7) t(a)",
        "bt_binary_cap": f"""
with recursive n as (select row, octet_length(encode(n_name)) as b from {numbered(sf_dir, 'nation')}),
s as (select row, b, sum(b) over (order by row) as upto from n),
c(a, z) as (
  select cast(0 as bigint), (select max(row) + 1 from s where upto <= 40)
  union all
  select z, (select max(s.row) + 1 from s where s.upto - (select p.upto from s p where p.row = z - 1) <= 40) from c where z < (select count(*) from n))
select a as row_offset, 0 as row_group, a as offset_in_group, cast(z - a as int) as row_count from c""",
        "bt_halved": _values("row_offset, row_group, offset_in_group, row_count", [(a, 0, a, n) for a, n in ((0, 6), (6, 4), (10, 7), (17, 4), (21, 4))]),
        "bt_views": f"""
with n as (select row, case when n_nationkey % 4 <> 1 then n_name end as n from {numbered(sf_dir, 'nation')}),
s as (select row, n, sum(coalesce(octet_length(encode(n)), 0)) over (order by row) as upto from n),
b as (select row // 8 as byte, sum(case when n is null then 0 else 1 << cast(row % 8 as int) end) as bits from n group by 1)
select list_concat([0], (select list(cast(upto as int) order by row) from s)) as offsets, encode((select string_agg(n, '' order by row) from s)) as payload,
  unhex((select string_agg(printf('%02X', cast(bits as bigint)), '' order by byte) from b)) as bitmap, false as all_valid""",
        "bt_fixed_views": f"select cast(count(*) as int) as row_count, unhex(string_agg(printf('%018X', cast(case when n_nationkey % 3 = 0 then 0 else n_nationkey end as bigint)), '' order by row)) as payload from {numbered(sf_dir, 'nation')}",
        "bt_aligned": "select n_nationkey as k, repeat(n_name, 20) as n from nation",
    }
