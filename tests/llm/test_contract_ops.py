"""Contract operators: oracle or brute force, and every odd input."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from brute import SF, simhash_groups
from pyspark.sql import functions as F

from lakeline.llm import queries as Q
from lakeline.llm.exact_dedup import exact_dedup
from lakeline.llm.language_id import Model, drop_unidentified, language_of, words_of
from lakeline.llm.simhash import drop_near_duplicates, simhash_groups as groups
from lakeline.llm.token_files import EliasFano, read_token_files, write_token_files
from lakeline.llm.url_filter import boundaries, judge_urls
from lakeline.llm.warc import read_warc, write_warc
from oracle_compare import canon, duck

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, salt int, row string, doc string"
ODD = [
    (5, "a  b\tc", "en", "s", 1, "x", 1, "r", "d"), (3, "a b c", "en", None, 1, "x", 1, "r", "d"),
    (3, "a b c", "en", None, 1, "x", 1, "r", "d"), (7, None, None, None, None, None, None, None, None),
    (8, "", "fr", "s", 0, "x", 1, "r", "d"), (None, "A b c", "de", "s", 1, "x", 1, "r", "d"),
    (9, "12 34 !!", "en", "s", 1, "x", 1, "r", "d"), (10, "long word " * 30000, "en", "s", 1, "x", 1, "r", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.mark.parametrize("key", sorted(Q.ORACLE))
def test_oracle(spark, key):
    got, want = Q.QUERIES[key](spark, SF).toPandas(), duck(SF).execute(Q.ORACLE[key]).df()
    assert canon(got) == canon(want)


def test_exact_dedup_odd(odd):
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(odd, fan_in=2).collect()}
    assert {(5, 3, 3, False), (3, 3, 3, True), (7, 7, 2, True), (8, 7, 2, False), (None, None, 1, True)} <= rows
    assert exact_dedup(odd).count() == len(ODD) and exact_dedup(odd.where("false")).count() == 0


def test_exact_dedup_rounds(spark):
    docs = spark.range(0, 500, 1, 37).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("text"))
    for r in exact_dedup(docs, fan_in=3).collect():
        text = "hot" if r.doc_id % 3 else str(r.doc_id % 7)
        same = [i for i in range(500) if ("hot" if i % 3 else str(i % 7)) == text]
        assert (r.keep_id, r.group_size, r.kept) == (same[0], len(same), r.doc_id == same[0])


def test_simhash_brute(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = simhash_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, groups(docs).collect()), key=str) == want


def test_simhash_odd(spark, odd):
    want = simhash_groups([r[:2] for r in ODD])
    assert sorted(map(tuple, groups(odd).collect()), key=str) == want
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({r[2] if r[2] is not None else r[1] for r in want})
    assert groups(odd.where("false")).count() == drop_near_duplicates(odd.where("false")).count() == 0


def test_simhash_ball(spark):
    """Links at every distance up to four, chains, and none at five."""
    from lakeline.llm.components import components
    from lakeline.llm.simhash import fingerprint_links

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    fps = [int(x) for x in base]
    for x in base:
        for d in (1, 2, 3, 4, 5):
            fps.append(int(x) ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    fps = sorted({int(np.uint64(x).astype(np.int64)) for x in fps})
    got = components(fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4)).collect()
    a = np.array(fps).view(np.uint64)
    from brute import Sets

    sets = Sets(len(a))
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4):
            sets.join(i, int(j))
    assert {(r.node, r.root) for r in got} == {(fps[i], fps[sets.find(i)]) for i in range(len(a)) if sets.find(i) != i}


def test_dense_prefix_is_split():
    from lakeline.llm.simhash import prefix_links

    fps = np.unique(np.random.default_rng(1).integers(0, 1 << 12, 900).astype(np.uint64))
    whole, split = (prefix_links(0, fps, 6, 4, most) for most in (1 << 24, 1 << 12))
    assert [x.tolist() for x in whole] == [x.tolist() for x in split]


def test_language(spark):
    rows = language_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_odd(odd):
    rows = {(r.doc_id, r.lang_pred) for r in language_of(odd).collect()}
    assert {(7, "und"), (8, "und"), (9, "und")} <= rows and len(rows) == len(ODD) - 1
    assert drop_unidentified(odd).columns == odd.columns
    assert language_of(odd.where("false")).count() == 0
    assert {r.lang_pred for r in language_of(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_backoff():
    model = Model.of([("x", 0, "known", 5), ("y", 0, "other", 5), ("x", 2, "zz", 9), ("y", 1, "q", 9), ("y", 2, "zz", 1)])
    assert [x[0] for x in model.predict(["known", "azzb", None, "q", "½ 7", "", "known q known"])] == ["x", "x", "und", "y", "und", "und", "x"]
    assert Model.of([]).predict(["a", None]) == [("und", 0.0)] * 2 and words_of("Ab1c_d") == ["ab", "c", "d"]


def test_warc_odd(spark, tmp_dir):
    big = "é" * 700
    rows = [(1, "http://a/\r\nX: y", big), (4, None, big), (4, "u", big), (2, "http://b/", "s"), (3, "", "s"), (6, "c", None), (None, "d", big), (9, "e", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("salt", F.lit("s"))
    write_warc(pages, tmp_dir + "/w", archive_bytes=1 << 20)
    got = read_warc(spark, tmp_dir + "/w").collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str) == sorted([
        (1, "revisit", 4, 1400), (4, "response", None, 1400), (4, "response", None, 1400), (2, "response", None, 1), (3, "response", None, 1),
        (6, "response", None, 0), (None, "revisit", 4, 1400), (9, "response", None, 3_000_000)], key=str)
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"} == {4: big, 2: "s", 3: "s", 6: "", 9: "x" * 3_000_000}
    assert {r.url for r in got if r.page_id == 1} == {"http://a/%0D%0AX: y"}
    write_warc(pages.where("false"), tmp_dir + "/e")
    assert read_warc(spark, tmp_dir + "/e").count() == 0


def test_warc_is_a_frame_chain(spark, tmp_dir):
    """Dictionary first, in its skippable frame; any Zstandard reader decodes the rest."""
    import zstandard

    write_warc(spark.read.parquet(f"{SF}/pages.parquet"), tmp_dir + "/w")
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(tmp_dir + "/w").collect():
        data = bytes(r.content)
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        words = zstandard.ZstdCompressionDict(data[8 : 8 + int.from_bytes(data[4:8], "little")])
        plain = zstandard.ZstdDecompressor(dict_data=words).stream_reader(data, read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and plain.count(b"WARC/1.1\r\n") > 10


@pytest.mark.parametrize("values", [[0], [5, 5, 5], [0, 1, 2, 3], [7, 900, 10**6, 2**40, 2**63], list(range(0, 3000, 7))])
def test_elias_fano(values):
    ef = EliasFano.of(np.array(values, np.uint64))
    again = EliasFano.unpack(memoryview(ef.pack()))
    assert again.values().tolist() == values and [again.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        again.select(len(values))


def test_elias_fano_space():
    values = np.sort(np.random.default_rng(1).integers(0, 10**9, 100_000)).astype(np.uint64)
    assert len(EliasFano.of(values).pack()) * 8 < 100_000 * (np.log2(10**4) + 2.6)


def test_token_files_brute(spark, odd, tmp_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    extra = ["x<|endoftext|>y <|EndOfText|>", "İ Σ ΣΑΣ é 한국 it's we'll 3.5 🙂", "\x1c a\x85b\u2028c"]
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    write_token_files(docs, tmp_dir + "/t", Q.tokenizer_path(), chunk_ids=5000)
    got = read_token_files(spark, tmp_dir + "/t").orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    at, want = 0, {}
    for d, t in rows:
        want.setdefault(d, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids in want[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    write_token_files(odd.where("false"), tmp_dir + "/e", Q.tokenizer_path())
    assert read_token_files(spark, tmp_dir + "/e").count() == 0


def test_word_encoder_forgets():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from lakeline.llm.token_files import WordEncoder

    tok, enc = Tokenizer.from_file(Q.tokenizer_path()), WordEncoder(Q.tokenizer_path(), max_words=50)
    rng = random.Random(2)
    for _ in range(20):
        texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(30)) for _ in range(5)]
        ids, size = enc.encode(pa.array(texts))
        want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == sum(want, []) and size.tolist() == [len(x) for x in want]


def test_urls_odd(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/x?y"), (1, "HTTP://WWW.Example.COM/en/x?y"), (2, "http://example.com/en"), (3, None), (4, "no scheme"),
        (5, "x://net/es/#f"), (6, "x://a.b.net/fr/1"), (None, "x://notexample.com/en/"), (7, "x://example.com?/en/"), (8, "://"), (9, "x://com:80/a"), (10, "x://..com//"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("range", F.lit(1))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, Q.URL_RULES).collect()}
    assert got == {
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "example.com", "/en", "com/", "allow"), (3, "", "", None, "allow"),
        (4, "", "", None, "allow"), (5, "net", "/es/", "net/es/", "block"), (6, "a.b.net", "/fr/1", "net/fr/", "block"),
        (None, "notexample.com", "/en/", "com/", "allow"), (7, "example.com", "", None, "allow"), (8, "", "", None, "allow"),
        (9, "com:80", "/a", None, "allow"), (10, "..com", "//", "com/", "allow"),
    }
    assert judge_urls(pages, Q.URL_RULES).count() == len(rows)
    assert judge_urls(pages.where("false"), Q.URL_RULES).count() == 0
    assert {r.verdict for r in judge_urls(pages, []).collect()} == {"allow"}


def test_urls_brute(spark):
    rng = random.Random(5)
    label = lambda: rng.choice(["a", "b", "ab", "com"])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 4)))
    rules = list({(host(), path()): None for _ in range(60)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [(i, f"s://{host()}{path()}") for i in range(600)]
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    for i, u in urls:
        h, _, p = u[4:].partition("/")
        fit = [(len(a + b), len(a), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and ("/" + p).startswith(b)]
        assert got[i] == (max(fit)[2:] if fit else (None, "allow"))


def test_boundaries_nest():
    marks = boundaries([("com", "/", "allow"), ("com", "/a", "block"), ("net", "/", "block")])
    assert [bytes(m[0]) for m in marks] == sorted(bytes(m[0]) for m in marks)
    assert [m[1] for m in marks] == ["com/", "com/a", "com/", None, "net/", None]


def test_duck_has_the_same_white_space():
    assert duckdb.sql(r"SELECT regexp_replace(e'a \t\n\x0b\x0c\rb', '[ \t-\r]+', ' ', 'g')").fetchall() == [("a b",)]
