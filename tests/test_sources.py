"""Sources, sinks, tables and snapshots on small inputs."""
import datetime as dt
import os
from collections import defaultdict
from urllib.parse import urlparse

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeline.sources import io as IO
from lakeline.sources import snapshots as SN
from lakeline.sources import tables as TB


def local(path: str) -> str:
    u = urlparse(path)
    return u.path if u.scheme == "file" else path


def test_arrow_ipc_reads_back_to_back_streams(spark, tmp_dir):
    """A producer that writes one complete IPC stream per batch into one file."""
    d = local(tmp_dir)
    os.makedirs(d, exist_ok=True)
    schema = pa.schema([("id", pa.int64()), ("name", pa.string())])
    with open(os.path.join(d, "multi.arrow"), "wb") as f:
        for start in (0, 3, 6):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema) as w:
                w.write_batch(pa.record_batch([pa.array(range(start, start + 3)),
                                               pa.array([f"n{i}" for i in range(start, start + 3)])], schema=schema))
            f.write(sink.getvalue().to_pybytes())
    df = IO.src_arrow_ipc(spark, tmp_dir, spark.createDataFrame([], "id long, name string").schema)
    assert sorted(r.id for r in df.collect()) == list(range(9))


def test_arrow_batches_are_bounded(spark):
    out = IO.arrow_ipc_batches(spark.range(25000).repartition(2), max_rows=10000)
    assert out.agg(F.max("rows")).first()[0] <= 10000
    assert out.agg(F.sum("rows")).first()[0] == 25000


@pytest.mark.parametrize("accept,fmt", [
    ("application/vnd.apache.arrow.stream", "arrow"), ("application/vnd.apache.arrow.file", "arrow"),
    ("application/octet-stream", "parquet"), ("application/parquet", "parquet"),
    ("text/csv", "csv"), ("application/json", "json"), ("*/*", "json"), (None, "json"),
    ("text/csv, application/vnd.apache.arrow.stream", "arrow")])
def test_negotiation_precedence(accept, fmt):
    assert IO.negotiate(accept) == fmt


def test_negotiation_unsupported():
    with pytest.raises(ValueError):
        IO.negotiate("image/png")


def test_csv_nulls_written_empty(spark, tmp_dir):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, s string")
    IO.sink_csv(df, tmp_dir)
    lines = sorted(r.value for r in spark.read.text(tmp_dir).collect())
    assert "1," in lines and "id,s" in lines


def test_type_mapping_and_identifiers():
    assert TB.spark_type("VARCHAR(20)") == "STRING"
    assert TB.spark_type("numeric(10, 2)") == "DECIMAL(10,2)"
    assert TB.spark_type("TIMESTAMPTZ") == "TIMESTAMP"
    assert TB.spark_type("integer[]") == "ARRAY<INT>"
    with pytest.raises(ValueError):
        TB.quote("x; DROP TABLE y")


def test_bulk_update_from_arrays(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, status string")
    u = TB.updates_from_arrays(spark, [1, 3], ["x", "y"])
    got = sorted(tuple(r) for r in TB.tbl_bulk_update(t, "id", "status", u).collect())
    assert got == [(1, "x"), (2, "b"), (3, "y")]
    with pytest.raises(ValueError):
        TB.updates_from_arrays(spark, [1, 1], ["x", "y"])


def test_zorder_keeps_rows_and_clusters(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("a"), (F.col("id") * 7 % 101).alias("b"))
    z = TB.tbl_zorder(df, ["a", "b"], 4)
    assert z.count() == 1000 and z.exceptAll(df).count() == 0
    assert TB.z_value([F.lit(1), F.lit(0)], 2) is not None


def test_vacuum_keeps_latest_and_recent(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("t", 1, t0), ("t", 2, t0 + dt.timedelta(hours=1)), ("t", 3, t0 + dt.timedelta(days=10)),
            ("u", 4, t0)]
    v = spark.createDataFrame(rows, "table_name string, snapshot_id long, created_at timestamp_ntz")
    expired = sorted(r.snapshot_id for r in TB.tbl_vacuum(v, 168).collect())
    assert expired == [1, 2]  # 3 is the latest of t, 4 the latest of u


def test_snapshot_as_of_requires_exactly_one(spark):
    v = spark.createDataFrame([("t", 1, dt.datetime(2024, 1, 1))],
                              "table_name string, snapshot_id long, created_at timestamp_ntz")
    with pytest.raises(ValueError):
        SN.snap_as_of(v)
    with pytest.raises(ValueError):
        SN.snap_as_of(v, version=1, ts="2024-01-02 00:00:00")
    assert SN.snap_as_of(v, ts="2024-01-02 00:00:00").first().snapshot_id == 1
    assert SN.snap_as_of(v, version=1).first().snapshot_id == 1


def test_cache_key_ignores_param_order():
    assert TB.cache_key("q", {"a": 1, "b": 2}) == TB.cache_key("q", {"b": 2, "a": 1})
    assert TB.cache_key("q", {"a": 1}) != TB.cache_key("q", {"a": 2})


def test_fallback_order(spark, tmp_dir):
    good = IO.sink_parquet(spark.range(3), f"{tmp_dir}/good")
    df = IO.src_fallback(spark, [f"{tmp_dir}/missing", good])
    assert df.count() == 3
    with pytest.raises(RuntimeError):
        IO.src_fallback(spark, [f"{tmp_dir}/missing1", f"{tmp_dir}/missing2"])


def test_schema_merge_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "id long, s string")
    b = spark.createDataFrame([(2.5, 2)], "v double, id long")
    out = TB.tbl_schema_merge(a, b)
    assert set(out.columns) == {"id", "s", "v"} and out.count() == 2


def test_one_value_partition_gives_many_files(spark, tmp_dir):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(0, 200_000, 1, 8).withColumn("p", F.lit("x")).withColumn("v", F.xxhash64("id"))
        IO.sink_partitioned(df, tmp_dir, ["p"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert IO.src_object_list(spark, tmp_dir, "*.parquet").count() > 4
    assert spark.read.parquet(tmp_dir).count() == 200_000


def test_arrow_sink_round_trip(spark, tmp_dir):
    df = spark.range(0, 2500, 1, 3).withColumn("s", F.concat(F.lit("é"), F.col("id")))
    IO.sink_arrow(df, tmp_dir, max_rows=400)
    back = IO.src_arrow_ipc(spark, tmp_dir, df.schema)
    assert back.count() == 2500 and back.exceptAll(df).count() == 0


def test_arrow_files_hold_a_bounded_number_of_streams(spark, tmp_dir):
    """One partition of many streams becomes several files, so no task reads all of it at once."""
    df = spark.range(0, 1000, 1, 1).withColumn("s", F.concat(F.lit("LAKEARRW"), F.col("id")))
    IO.sink_arrow(df, tmp_dir, max_rows=10)
    assert IO.src_object_list(spark, tmp_dir, "part-*").count() == -(-100 // IO.ARROW_FILE_STREAMS)
    back = IO.src_arrow_ipc(spark, tmp_dir, df.schema)
    assert back.count() == 1000 and back.exceptAll(df).count() == 0


def test_updates_with_repeated_keys_are_rejected(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "id long, value string")
    with pytest.raises(Exception, match="more than once"):
        TB.tbl_bulk_update(t, "id", "s", twice).collect()
    with pytest.raises(Exception, match="more than once"):
        TB.tbl_merge_upsert(t, twice.withColumnRenamed("value", "s"), ["id"]).collect()


def test_zorder_limits_and_prunes(spark, tmp_dir):
    df = spark.range(40_000).select((F.col("id") % 200).alias("a"), F.floor(F.col("id") / 200).alias("b"))
    TB.tbl_zorder(df, ["a", "b"], 16).write.parquet(tmp_dir)
    per = spark.read.parquet(tmp_dir).groupBy(F.input_file_name().alias("f")).agg(
        F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1")).collect()
    assert len(per) == 16
    for lo, hi in (("a0", "a1"), ("b0", "b1")):  # a value of either column is in a few files only
        assert sum(r[lo] <= 77 <= r[hi] for r in per) <= 8
    many = df.select(*[F.col("a").alias(f"c{i}") for i in range(5)])
    assert TB.tbl_zorder(many, many.columns, 4).count() == 40_000
    with pytest.raises(ValueError):
        TB.tbl_zorder(many, many.columns, 4, bits=21)


def test_versions_survive_a_vacuum(spark, tmp_dir):
    df = spark.range(5)
    for i in range(3):
        assert TB.commit_version(spark, tmp_dir, "t", df.filter(F.col("id") <= i)) == i + 1
    assert TB.vacuum_versions(spark, tmp_dir, "t") == []
    assert TB.read_version(spark, tmp_dir, "t", 2).count() == 2
    assert TB.vacuum_versions(spark, tmp_dir, "t", retention_hours=-1) == [1, 2]
    assert TB.read_version(spark, tmp_dir, "t").count() == 3 and TB.read_version(spark, tmp_dir, "t", 3).count() == 3
    with pytest.raises(KeyError):
        TB.read_version(spark, tmp_dir, "t", 1)
    assert not os.path.exists(local(TB.versions_of(spark, tmp_dir, "t").filter("version = 1").first().path))
    assert TB.commit_version(spark, tmp_dir, "t", df) == 4


def test_compact_packs_small_files_only(spark, tmp_dir):
    src, size = f"{tmp_dir}/a", 40_000
    spark.range(0, 20_000, 1, 1).write.parquet(src)
    big = IO.src_object_list(spark, src, "*.parquet").first().path
    spark.range(20_000, 21_000, 1, 20).write.mode("append").parquet(src)
    paths = TB.tbl_compact(spark, src, f"{tmp_dir}/b", size)
    rows = spark.read.parquet(*paths)
    assert big in paths and len(paths) == 2 and rows.count() == 21_000 and rows.distinct().count() == 21_000
    packed = [r.id for r in spark.read.parquet(paths[1]).select("id", "_metadata.row_index").orderBy("row_index").collect()]
    runs = [packed[i : i + 50] for i in range(0, 1000, 50)]
    assert all(r == list(range(r[0], r[0] + 50)) for r in runs)  # each file's rows in their order
    assert TB.tbl_compact(spark, f"{tmp_dir}/b", f"{tmp_dir}/c", size) == [p.path for p in IO.src_object_list(spark, f"{tmp_dir}/b", "*.parquet").collect()]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=40))
def test_pack_files(sizes):
    files = [(f"f{i}", n) for i, n in enumerate(sizes)]
    bins = TB.pack_files(files, 100)
    packed = [f for b in bins for f in b]
    assert len(packed) == len(set(packed)) and all(len(b) > 1 and sum(sizes[int(f[1:])] for f in b) <= 100 for b in bins)
    left = [n for f, n in files if f not in packed]
    assert all(a + b > 100 for i, a in enumerate(left) for b in left[i + 1 :])


def test_zorder_skips_files_despite_an_outlier(spark, tmp_dir):
    import glob

    import pyarrow.parquet as pq

    df = spark.range(40_000).select(F.when(F.col("id") == 5, 10**15).otherwise(F.xxhash64("id") % 1000).alias("a"),
                                    F.when(F.col("id") == 6, 1e300).otherwise(F.pow(F.lit(1.01), F.pmod(F.hash("id"), F.lit(2000)))).alias("b"), "id")
    TB.tbl_zorder(df, ["a", "b"], 160).write.parquet(tmp_dir)
    assert spark.read.parquet(tmp_dir).exceptAll(df).count() == 0
    ends = [[(s.min, s.max) for s in (pq.ParquetFile(f).metadata.row_group(0).column(i).statistics for i in (0, 1))] for f in glob.glob(f"{local(tmp_dir)}/*.parquet")]
    assert len(ends) >= 120
    for i, (low, high) in enumerate([(100, 150), (1.01**500, 1.01**550)]):
        met = sum(1 for e in ends if e[i][0] <= high and e[i][1] >= low)
        assert met <= 0.2 * len(ends)


def test_hilbert_neighbours(spark):
    """Along the curve one axis changes by one: it visits every cell, and no step jumps."""
    for k, bits in ((2, 4), (3, 2)):
        axes = [f"x{i}" for i in range(k)]
        cells = spark.range(1 << (k * bits)).select(*[F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(a) for i, a in enumerate(axes)])
        kept = cells.select("*", *[F.col(a).alias("k" + a) for a in axes])
        rows = TB.hilbert(kept, axes, bits, "h").orderBy("h").collect()
        assert [r.h for r in rows] == list(range(1 << (k * bits)))
        assert all(sum(abs(a["k" + x] - b["k" + x]) for x in axes) == 1 for a, b in zip(rows, rows[1:]))


def test_tuned_parquet_options_reach_the_footer(spark, tmp_dir):
    import glob

    import pyarrow.parquet as pq

    IO.sink_parquet_tuned(spark.range(5000).select("id", (F.col("id") % 7).alias("k")).repartition(2), tmp_dir, bloom_cols=["id"], sort_cols=["k"])
    for name in glob.glob(f"{local(tmp_dir)}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        column = meta.row_group(0).column(1)
        assert column.compression == "ZSTD" and "PLAIN" in str(column.encodings) and "DICTIONARY" in str(column.encodings)
        rows = pq.read_table(name).column("k").to_pylist()
        assert rows == sorted(rows)


def test_compact_into_a_used_folder(spark, tmp_dir):
    """The folder's earlier content goes, but never the files that are read."""
    spark.range(0, 400, 1, 8).write.parquet(f"{tmp_dir}/a")
    spark.range(9).write.mode("overwrite").parquet(f"{tmp_dir}/b/old")
    size = max(r.length for r in spark.read.format("binaryFile").load(f"{tmp_dir}/a").select("length").collect())
    paths = TB.tbl_compact(spark, f"{tmp_dir}/a", f"{tmp_dir}/b", size * 4)
    assert len(paths) == 2 and spark.read.parquet(*paths).distinct().count() == 400
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_dir}/b").count() == 400
    with pytest.raises(ValueError):
        TB.tbl_compact(spark, f"{tmp_dir}/b", f"{tmp_dir}/b", 1 << 20)


def test_object_bodies_come_in_pieces(spark, tmp_dir, monkeypatch):
    """Rows hold a bounded part of a body; a query that decodes bodies gets them whole."""
    bodies = {"a b.bin": os.urandom(2500), "even.bin": os.urandom(2000), "small.bin": b"x"}
    os.makedirs(f"{local(tmp_dir)}/objects")
    for name, body in bodies.items():
        with open(f"{local(tmp_dir)}/objects/{name}", "wb") as f:
            f.write(body)
    got = defaultdict(list)
    for r in IO.src_object_get(spark, f"{tmp_dir}/objects", "*.bin", 1000).collect():
        assert len(r.content) <= 1000 and r.length == len(bodies[r.path.rsplit("/", 1)[1]])
        got[r.path.rsplit("/", 1)[1]].append((r.offset, bytes(r.content)))
    assert {n: b"".join(c for _, c in sorted(x)) for n, x in got.items()} == bodies
    assert [o for o, _ in got["a b.bin"]] == [0, 1000, 2000] and len(got["even.bin"]) == 2
    whole = {r.path.rsplit("/", 1)[1]: (r.length, bytes(r.content)) for r in IO.src_object_get(spark, f"{tmp_dir}/objects").collect()}
    assert whole == {n: (len(b), b) for n, b in bodies.items()}
    from lakeline.plans import q_io

    for n in (1, 3000):
        spark.range(n).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/tables")
    monkeypatch.setattr(IO, "OBJECT_PIECE", 700)
    assert sorted(r.n_rows for r in q_io.q_src_object_get(spark, f"{tmp_dir}/tables").collect()) == [1, 3000]
