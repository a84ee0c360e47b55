"""Tables that change file by file: what is rewritten, what is carried over, races."""
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lakeline.sources import commits
from lakeline.sources import snapshots as SN
from lakeline.sources import tables as TB
from lakeline.sources import versions as V


def files_of(t, version=None):
    return {r.file for r in t.manifest(version).collect()}


def numbers(spark, n, files):
    return spark.range(0, n, 1, files).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"), F.lit("old").alias("s"))


def pairs(df):
    return sorted((r.k is None, r.k or 0, r.v, r.s) for r in df.collect())


def test_one_key_rewrites_one_file_of_many(spark, tmp_dir):
    t = V.Table(spark, tmp_dir, "t")
    V.create(t, numbers(spark, 20_000, 1000), ["k"])
    before = files_of(t)
    assert len(before) == 1000
    V.merge_into(t, spark.createDataFrame([(7777, None, "new")], "k long, v long, s string"))
    assert len(before - files_of(t)) == 1 and len(files_of(t) - before) <= 1
    assert t.read().count() == 20_000 and pairs(t.read().where("k = 7777")) == [(False, 7777, None, "new")]
    assert pairs(t.read(1).where("k = 7777")) == [(False, 7777, 77770, "old")]


def test_scattered_keys_are_found_by_bloom_filters(spark, tmp_dir):
    """Every file spans all keys, so ranges prune nothing and the filters decide."""
    t = V.Table(spark, tmp_dir, "t")
    V.create(t, numbers(spark, 40_000, 1).repartition(64, "k"), ["k"])
    before = files_of(t)
    keys = spark.createDataFrame([(123,), (30_000,), (99_999_999,)], "k long")
    found = [r.file for r in V.candidate_files(t, 1, keys, ["k"]).collect()]
    assert len(before) >= 60 and 2 <= len(found) <= 6
    V.merge_into(t, keys.select("k", F.lit(1).cast("long").alias("v"), F.lit("new").alias("s")))
    assert len(before - files_of(t)) == 2
    assert t.read().count() == 40_001 and t.read().where("s = 'new'").count() == 3


def test_filters_never_miss(spark, tmp_dir, monkeypatch):
    t = V.Table(spark, tmp_dir, "t")
    rows = spark.range(3000).select(F.col("id").alias("a"), F.concat(F.lit("n"), F.col("id") % 17).alias("b"), F.lit(0).alias("v"))
    V.create(t, rows.repartition(20, F.rand(1)), ["a", "b"])
    file = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    want = {tuple(r) for r in t.read().where("a % 100 = 3").select("a", file).collect()}
    for probes in (10_000, 0):  # by filter; by range alone
        monkeypatch.setattr(V, "PROBES", probes)
        found = {r.file.rsplit("/", 1)[1] for r in V.candidate_files(t, 1, rows.where("a % 100 = 3"), ["a", "b"]).collect()}
        assert {f for _, f in want} <= found


def test_merge_nulls_duplicates_and_empty(spark, tmp_dir):
    t = V.Table(spark, tmp_dir, "t")
    rows = spark.createDataFrame([(1, 1, "a"), (None, 2, "b"), (2, 3, "c")], "k long, v long, s string")
    V.create(t, rows, ["k"])
    V.merge_into(t, spark.createDataFrame([(None, 9, "x"), (2, None, None), (5, 5, "y")], "k long, v long, s string"))
    assert {(r.k, r.v, r.s) for r in t.read().collect()} == {(1, 1, "a"), (None, 2, "b"), (None, 9, "x"), (2, None, None), (5, 5, "y")}
    files = files_of(t)
    V.merge_into(t, rows.where("false"))
    assert files <= files_of(t) and t.read().count() == 5
    with pytest.raises(Exception, match="more than once"):
        V.merge_into(t, spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k long, v long, s string"))
    empty = V.Table(spark, tmp_dir, "empty")
    V.create(empty, rows.where("false"), ["k"])
    V.merge_into(empty, rows.where("k = 1"))
    assert pairs(empty.read()) == [(False, 1, 1, "a")] and empty.read(1).count() == 0


def test_update_append_compact_vacuum(spark, tmp_dir):
    t = V.Table(spark, tmp_dir, "t")
    V.create(t, numbers(spark, 4000, 40), ["k"])
    first = files_of(t)
    V.update_into(t, "s", spark.createDataFrame([(5, "u"), (10**9, "none")], "id long, value string"))
    assert len(first - files_of(t)) == 1 and t.read().where("s = 'u'").count() == 1 and t.read().count() == 4000
    assert V.append(t, spark.createDataFrame([(4000, 1, "new")], "k long, v long, s string")) == 3
    size = sum(r.bytes for r in t.manifest().collect())
    V.compact(t, target_bytes=size // 3)
    assert len(files_of(t)) <= 6 and t.read().count() == 4001 and t.read().distinct().count() == 4001
    kept = files_of(t)
    V.compact(t, target_bytes=1)  # nothing is small against that
    assert files_of(t) == kept
    V.merge_into(t, spark.createDataFrame([(6, 6, "m")], "k long, v long, s string"))  # filters of packed files
    assert pairs(t.read().where("k = 6")) == [(False, 6, 6, "m")] and t.read().count() == 4001
    assert V.vacuum(t) == []
    dead = V.vacuum(t, retention_hours=-1)
    assert len(first & set(dead)) > 30 and not set(dead) & files_of(t) and t.read().count() == 4001
    with pytest.raises(KeyError):
        t.read(1)
    assert V.vacuum(t, retention_hours=-1) == []


def test_writers_race(spark, tmp_dir):
    t = V.Table(spark, tmp_dir, "t")
    V.create(t, numbers(spark, 10, 1), ["k"])
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda i: V.append(t, spark.createDataFrame([(100 + i, i, "x")], "k long, v long, s string")), range(4)))
    assert sorted(done) == [2, 3, 4, 5] and t.read().where("s = 'x'").count() == 4
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: commits.claim(spark, f"{tmp_dir}/claims"), range(24)))
    assert sorted(got) == list(range(1, 25))


def test_eight_threads_register_eight_versions(spark, tmp_dir):
    reg = f"{tmp_dir}/registry"
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: SN.snap_register(spark, reg, "t/ö", i, f"{tmp_dir}/none"), range(8)))
        list(pool.map(lambda i: TB.commit_version(spark, tmp_dir, "v", spark.range(i)), range(8)))
    assert sorted(r.version for r in SN.read_registry(spark, reg).collect()) == list(range(1, 9))
    assert sorted(r.version for r in TB.versions_of(spark, tmp_dir, "v").collect()) == list(range(1, 9))


def test_markers_on_other_file_systems(spark, tmp_dir, monkeypatch):
    """The rename path: never overwrites, leaves no temporary file."""
    monkeypatch.setattr(commits, "_local", lambda fs, path: None)
    path = commits.marker(f"{tmp_dir}/log", 3)
    assert commits.create_if_absent(spark, path, '{"a": 1}') and not commits.create_if_absent(spark, path, "{}")
    assert commits.read_marker(spark, f"{tmp_dir}/log", 3) == {"a": 1}
    assert [n for n in commits.names(spark, f"{tmp_dir}/log") if not n.startswith(".")] == ["000000000003.json"]


def test_rollup_reads_new_files_only(spark, tmp_dir):
    from lakeline.sources.materialized import Rollup

    def day(d, n):
        return spark.range(n).select((F.col("id") + d * 10_000).alias("k"), F.lit(d).alias("day"), (F.col("id") % 7).alias("user"), (F.col("id") * d).alias("v"))

    def full(rows):
        return {tuple(r) for r in rows.groupBy("day").agg(F.count("*"), F.sum("v"), F.min("v"), F.max("v"), F.countDistinct("user")).collect()}

    t = V.Table(spark, tmp_dir, "t")
    V.create(t, day(1, 500).unionAll(day(2, 300)).repartitionByRange(6, "k"), ["k"])
    r = Rollup(t, tmp_dir, "daily", {"day": F.col("day")}, {"n": ("count", None), "total": ("sum", F.col("v")), "lo": ("min", F.col("v")),
                                                            "hi": ("max", F.col("v")), "users": ("distinct", F.col("user"))})
    assert len(r.refresh()) == len(files_of(t)) and r.refresh() == []
    before = files_of(t)
    V.append(t, day(3, 200).coalesce(1))
    assert set(r.refresh()) == files_of(t) - before
    assert {tuple(x) for x in r.read().collect()} == full(t.read())
    V.merge_into(t, day(2, 10).withColumn("v", F.lit(5).cast("long")))  # rewrites a file: its old states go
    assert 0 < len(r.refresh()) < 3
    assert {tuple(x) for x in r.read().collect()} == full(t.read())


def test_cached_by_plan_and_inputs(spark, tmp_dir):
    spark.range(10).write.parquet(f"{tmp_dir}/in")
    entries = lambda: spark.read.parquet(f"{tmp_dir}/cache/_cache_registry").count()
    q = f"SELECT id % 3 AS g, count(*) AS n FROM parquet.`{tmp_dir}/in` WHERE id > :x GROUP BY 1"
    first = sorted(map(tuple, TB.rep_cached(spark, f"{tmp_dir}/cache", q, {"x": 2}).collect()))
    renamed = TB.rep_cached(spark, f"{tmp_dir}/cache", q.replace("AS n", "AS rows"), {"x": 2})
    assert entries() == 1 and renamed.columns == ["g", "rows"] and sorted(map(tuple, renamed.collect())) == first
    TB.rep_cached(spark, f"{tmp_dir}/cache", q, {"x": 3})
    assert entries() == 2
    spark.range(100, 103).write.mode("append").parquet(f"{tmp_dir}/in")
    again = TB.rep_cached(spark, f"{tmp_dir}/cache", q, {"x": 2})
    assert entries() == 3 and sorted(map(tuple, again.collect())) != first


def test_search_index_finds_what_a_scan_finds(spark, tmp_dir):
    import random

    from lakeline.operators import monitoring as M

    rng = random.Random(7)
    words = ["customer", "custmer", "orders", "aa", "aaaa", "ab", "événement", "lineitem", "abab", "x"]
    def typo(w):
        i = rng.randrange(len(w) + 1)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdefgo") + w[i:], w])
    random_word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 14)))
    rows = [("job", str(i), "_".join(typo(rng.choice(words)) if rng.random() < 0.2 else random_word() for _ in range(3))) for i in range(800)]
    items = spark.createDataFrame(rows + [("job", "n", None), ("t", "e", "")], "kind string, item_id string, name string")
    M.write_search_index(items, tmp_dir)
    for term in ("custmer", "CUSTOMER", "orders", "aaa", "abab", "zz", "lineitm"):
        for threshold in (0.3, 0.5, 0.0):
            want = {tuple(r) for r in M.cat_search(items, term, threshold).collect()}
            assert {tuple(r) for r in M.cat_search_indexed(spark, tmp_dir, term, threshold).collect()} == want
    tokens = spark.read.parquet(f"{tmp_dir}/tokens").select("token").distinct().count()
    assert M.search_candidates(spark, tmp_dir, "customer", 0.3).count() < 0.05 * tokens


def test_file_statistics_and_filters_sort_no_rows(spark, tmp_dir):
    """Rows are folded where they are read; the filters are those of the bitmap aggregate."""
    spark.range(0, 9_000, 1, 3).selectExpr("id", "CAST(id AS string) AS s").write.parquet(f"{tmp_dir}/t")
    rows = spark.read.parquet(f"{tmp_dir}/t")
    file = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    stats = V._stats(rows, file, ["id", "s"])
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
    assert sorted((r.rows, r.least.id, r.most.id) for r in stats.collect()) == [(3000, a, a + 2999) for a in (0, 3000, 6000)]
    held = rows.select(file.alias("file"), "id", "s").join(stats.select(F.col("file").alias("f"), "rows"), F.col("file") == F.col("f"))
    held = held.select("file", *[c.alias(n) for n, c in V._hashes(["id", "s"], F.col("rows")).items()]).select("file", "page", F.explode("bits").alias("bit"))
    want = held.groupBy("file", "page").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    found = V._filters(rows, file, ["id", "s"], stats)
    key = lambda r: (r.file, r.page, bytes(r.bitmap))
    assert sorted(map(key, found.collect())) == sorted(map(key, want.collect()))
