"""Hard negatives, sharding and fill-in-the-middle against brute force, round trips and odd inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeline.llm import hard_negatives as H
from lakeline.llm.fill_in_middle import SkipList, cuts_of, fill_in_middle, restored, unit_widths
from lakeline.llm.sharding import shard_rows, write_shards
import lakeline.llm.sharding as S

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


# --- fill-in-the-middle


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abZ <>P\n\té日𝒳"), st.characters(exclude_categories=["Cs"])), max_size=200), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_are_those_of_the_pattern(text, first, second):
    units = UNIT.findall(text)
    assert unit_widths(text).tolist() == [len(u) for u in units]
    low, high = sorted((first % (len(units) + 1), second % (len(units) + 1)))
    assert cuts_of(text, first, second) == (len(units), len("".join(units[:low])), len("".join(units[low:high])))


def test_skip_list_every_rank_and_lanes():
    widths = np.random.default_rng(5).integers(1, 30, 5000)
    units = SkipList(widths)
    ends = np.concatenate([[0], np.cumsum(widths)])
    assert [units.chars(r) for r in range(len(ends))] == ends.tolist()
    sizes = [len(lane[0]) for lane in units.lanes]
    assert len(sizes) >= 5 and all(b < a / 2 for a, b in zip(sizes, sizes[1:]))
    assert all(lane[0].sum() == 5000 and lane[1].sum() == widths.sum() for lane in units.lanes)
    for rank in (-1, 5001):
        with pytest.raises(IndexError):
            units.chars(rank)


def test_units_over_pieces(monkeypatch):
    from lakeline.llm import fill_in_middle as M

    text = "ab cde  fgé" * 50 + "x" * 300
    whole = unit_widths(text).tolist()
    monkeypatch.setattr(M, "PIECE", 7)
    assert unit_widths(text).tolist() == whole


def test_fill_in_middle_odd(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "some words here", "x"), (3, "has <M> in it", "x"), (3, "has <M> in it", "x"),
            (4, "é<P" * 40 + ">", "x"), (5, "<" * 50, "x"), (6, "word, " * 100_000, "x"), (7, "𝒳y日" * 30, "x"), (8, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").withColumn("n", F.lit(0)).withColumn("form", F.lit("f"))
    for seed in range(1, 8):
        made = fill_in_middle(docs, seed=seed).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
        assert len(made) == len(rows)
        for r in made:
            text = r.doc.text or ""
            assert r.back == text and r.n == len(UNIT.findall(text))
            if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")):
                assert r.form == "plain"
            if r.form == "plain":
                assert r.output == text and r.prefix_chars is None and r.middle_chars is None
            else:
                p, m = text[: r.prefix_chars], text[r.prefix_chars : r.prefix_chars + r.middle_chars]
                s = text[r.prefix_chars + r.middle_chars :]
                assert r.output == (f"<P>{p}<S>{s}<M>{m}" if r.form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    assert fill_in_middle(docs.where("false")).count() == 0


def test_fill_in_middle_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    forms = Counter(r.form for r in fill_in_middle(docs).select("form").collect())
    assert abs(forms["plain"] - 400) < 90 and abs(forms["spm"] - 720) < 120
    h = hashlib.sha256(b"1:7").hexdigest()
    seven = fill_in_middle(docs.where("doc_id = 7")).first()
    assert seven.prefix_chars is None or seven.prefix_chars == len("".join(UNIT.findall("one two three")[: min(int(h[:8], 16) % 6, int(h[8:16], 16) % 6)]))


# --- sharding


def sources(i):
    return F.when(i % 3 == 0, "hot").when(i % 10 == 1, None).when(i % 10 == 2, F.concat(F.lit("one-"), i.cast("string"))).otherwise(F.concat(F.lit("s"), (i % 7).cast("string")))


@pytest.mark.parametrize("n,shards", [(1, 4), (5, 16), (1003, 16), (997, 7)])
def test_shards(spark, n, shards, monkeypatch):
    monkeypatch.setattr(S, "PER_BUCKET", 20)
    monkeypatch.setattr(S, "BLOCK", 4)
    i = F.col("id")
    docs = spark.range(0, n, 1, 5).select(i.alias("doc_id"), F.when(i % 4 > 0, i.cast("string")).alias("text"), sources(i).alias("source"), F.lit(9).alias("shard"), F.lit("x").alias("bucket"))
    rows = shard_rows(docs, shards).collect()
    assert sorted(r.doc.doc_id for r in rows) == list(range(n))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(r.slot for r in by[s]) == list(range(len(by[s]))) for s in by)
    total = Counter(r.doc.source for r in rows)
    for s in by:
        got = Counter(r.doc.source for r in by[s])
        for source, m in total.items():
            assert abs(got[source] - m * len(by[s]) / n) <= 2
    again = {(r.doc.doc_id, r.shard, r.slot) for r in shard_rows(docs.repartition(3), shards).collect()}
    assert again == {(r.doc.doc_id, r.shard, r.slot) for r in rows}
    assert {(r.doc.doc_id, r.shard, r.slot) for r in shard_rows(docs, shards, seed=1).collect()} != again or n < 6


def test_shards_odd_and_files(spark, tmp_dir):
    rows = [(1, "same", "a")] * 40 + [(None, None, None)] * 30 + [(2, "", ""), (3, "w " * 300_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = shard_rows(docs, 4)
    assert sorted(Counter(r.shard for r in placed.collect()).values()) == [18, 18, 18, 18]
    write_shards(placed, tmp_dir + "/shards", per_file=10)
    files = spark.read.parquet(tmp_dir + "/shards")
    assert files.count() == 72 and files.where("shard = 2").selectExpr("max(slot)").first()[0] == 17
    one = files.select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert max(r["count"] for r in one) <= 10
    assert shard_rows(docs.where("false"), 4).count() == 0


# --- hard negatives


def brute(rows, positives=5, negatives=10, low=30, high=90):
    used = [(i, y, [int(np.floor(256 * v)) for v in x]) for i, y, x in rows if y is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    width = max((len(x) for _, _, x in used), default=0)
    used = [(i, y, x + [0] * (width - len(x))) for i, y, x in used]
    last = lambda i: (i is None, i or 0)
    out = []
    for i, y, x in used:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(x, z)), j, w) for j, w, z in used]
        own = sorted([(s, j) for s, j, w in scored if w == y and j != i], key=lambda t: (-t[0], last(t[1])))[:positives]
        for s, j in own:
            fits = sorted([(t, k) for t, k, w in scored if w != y and low * s <= 100 * t <= high * s], key=lambda t: (-t[0], last(t[1])))
            out += [(i, j, r, k, s, t) for r, (t, k) in enumerate(fits[:negatives], 1)]
    return sorted(out, key=str)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("id", F.lit(1)).withColumn("salt", F.lit("s"))
    return sorted(map(tuple, H.mine_hard_negatives(df, lambda i: i % 100 == 0, **more).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives_brute(spark, seed, monkeypatch):
    monkeypatch.setattr(H, "PER_CELL", 12)  # many cells
    monkeypatch.setattr(H, "PIECE", 5)
    monkeypatch.setattr(H, "ANCHORS", 3)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 9))
    label = rng.integers(0, 6, 700)
    spread = [0.05, 0.4, 2.0][seed]
    x = centres[label] + spread * rng.normal(size=(700, 9))
    flip = rng.random(700) < 0.2
    label = np.where(flip, (label + 1) % 6, label)
    rows = [(int(i), int(y), [float(v) for v in np.round(z, 3)]) for i, y, z in zip(rng.permutation(1400)[:700], label, x)]
    rows += [(100 * i, 0, rows[0][2]) for i in range(3)] + [rows[1]] * 30  # copies: ties
    want = brute(rows)
    assert len(want) > 20 and mined(spark, rows, block=2) == want


def test_hard_negatives_prunes():
    """Cells whose bounds meet no open window are not scored."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 300
    code = rng.integers(0, 40, 4000)
    x = (centres[code] + rng.normal(size=(4000, 16))).astype(np.int32)
    cells = H.Cells(np.arange(4000), code % 2, x, code, code)
    block = H.Block(np.arange(20), code[:20] % 2, x[:20], np.full((20, 1), -(1 << 62)), np.full((20, 1), 1 << 62), True, 5)
    scored = []
    plain = H.Block.score
    block.score = lambda cells, rows, anchors, some, begin, end, need, kept: scored.append(len(some) * (end - begin)) or plain(block, cells, rows, anchors, some, begin, end, need, kept)
    a, _, ids, score = block.search(cells)
    assert sum(scored) < 0.1 * 20 * 4000
    for i in range(20):
        dots = x.astype(np.int64) @ x[i].astype(np.int64)
        want = sorted([(-int(dots[j]), j) for j in range(4000) if code[j] % 2 == code[i] % 2 and j != i])[:5]
        assert sorted(zip((-score[a == i]).tolist(), ids[a == i].tolist())) == want


def test_hard_negatives_odd(spark):
    good = [(i, i % 3, [0.5 + i / 100, 0.25, 1.0]) for i in range(1, 60)]
    rows = good + [(100, 1, [0.5, 0.5, 0.5]), (100, 1, [0.5, 0.5, 0.5]), (200, 2, None), (300, None, [1.0, 1.0, 1.0]), (400, 1, [float("nan"), 0.0, 0.0]),
                   (500, 1, [None, 0.0, 0.0]), (600, 2, []), (700, 0, [1.0]), (None, 0, [0.9, 0.1, 0.3]), (None, 1, [0.9, 0.1, 0.3]), (800, 7, [0.4, 0.4, 0.4]), (900, 1, [-1.0, -1.0, -1.0])]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [r for r in rows if r[0] is not None and r[0] % 100]) == [] == mined(spark, [])
    huge = [(0, 1, [1e300, 1.0]), (1, 1, [1e5, 1.0]), (2, 2, [5e4, 0.0])]
    assert [r[:4] for r in mined(spark, huge)] == [(0, 1, 1, 2)]


# --- findings of earlier rounds


def test_every_language_is_learnt(spark):
    from lakeline.llm.language_id import identify

    rows = [(100 * k + i, " ".join(f"{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(97 + (k + j) % 26)}w{'xyz'[(i + j) % 3]}" for j in range(12)), f"lang{k}") for k in range(600) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert identify(docs).select("lang_pred").distinct().count() > 570


def test_null_shared_and_repeated_ids_are_learnt(spark):
    from lakeline.llm.language_id import train

    def rows(ids):
        return [(ids(i), f"der und die das wort{i}", "de") for i in range(3000)] + [(ids(i), f"the and of to word{i}", "en") for i in range(3000)]

    for ids in (lambda i: None, lambda i: 7, lambda i: i):
        model = train(spark.createDataFrame(rows(ids), "id long, text string, lang string"), per_lang=100)
        assert sorted(model.langs) == ["de", "en"]
        assert [x[0] for x in model.predict(["und die", "of the"])] == ["de", "en"]
    same = spark.createDataFrame([(1, "der und die das", "de")] * 5000, "id long, text string, lang string")
    assert train(same, per_lang=10, min_count=1).langs == ["de"]


def test_short_long_and_dense_items(spark):
    from lakeline.llm.decontaminate import contaminated, drop_contaminated

    rng = np.random.default_rng(8)
    word = lambda n, k=9**5: [f"w{rng.integers(k)}" for _ in range(n)]
    long = word(20_000, 3000)
    edited = [("changed" if i % 7 == 3 else w) for i, w in enumerate(long)]
    middle = word(700)
    dense = "这是一个没有空格的基准问题它应该被找到"
    items = spark.createDataFrame([(1, "three word item"), (2, "two words"), (3, " ".join(long)), (4, " ".join(middle)), (5, dense), (6, "one more short item here")], "item_id long, text string")
    docs = [(10, "before Three word, item after"), (11, "three item word"), (12, "two words"), (13, " ".join(word(50) + edited + word(50))), (14, " ".join(word(900) + middle[:90] + word(40) + middle[130:] + word(10))),
            (15, "前面的文字" + dense + "后面"), (16, " ".join(middle[:400])), (17, "one more short words item here"), (18, " ".join(word(300)))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.start_word, r.end_word, r.similarity) for r in contaminated(docs, items).collect()}
    assert set(found) == {(10, 1), (13, 3), (14, 4), (15, 5)}
    assert found[10, 1] == (1, 4, 1.0) and found[13, 3][:2] == (50, 20_050) and found[14, 4][0] == 900 and found[15, 5] == (5, 24, 1.0)
    assert {r.doc_id for r in drop_contaminated(docs, items).collect()} == {11, 12, 16, 17, 18}
    only_short = items.where("item_id = 1")
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, only_short).collect()] == [(10, 1)]


def test_large_weights_and_the_report(spark):
    from lakeline.llm.mixing import mix, mix_report

    rows = [(i, "tok " * (1 + i % 50), "a" if i % 3 else "b") for i in range(600)] + [(None, None, "c"), (600, "long " * 50_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit(1))
    levels, weights = {"source": F.col("source")}, {("a",): 5000, ("b",): 10**9, ("d",): 0.001}
    taken = mix(docs, levels, weights, share=0.3)
    report = {r.source: r for r in mix_report(docs, levels, weights, share=0.3).collect()}
    sums = {r[0]: r[1] for r in taken.groupBy("leaf.source").agg(F.sum("tokens")).collect()}
    assert all(r.delivered == sums.get(s, 0) and r.delivered <= r.budget for s, r in report.items())
    assert report["b"].budget == report["b"].tokens and "c" not in report
    with pytest.raises(ValueError):
        mix(docs, levels, {("a",): 10**10}, share=0.3)


def test_stages_can_be_held_together(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = P.table(spark, sf, "documents")
    a = P.near_dedup(spark, docs, sf)
    b = P.decontaminate(spark, a, sf)
    c = P.mixture(spark, docs, sf)
    assert a.count() >= b.count() > 0 and c.count() > 0 and a.count() > 0


def test_line_keys_have_no_step(spark):
    """One word more makes lines share a key at any length, 10 to 11 words included."""
    import pyarrow as pa

    from lakeline.llm.line_dedup import band_keys, split_words

    rng = np.random.default_rng(6)
    for size in (7, 8, 9, 10, 11, 12, 13, 14, 16):
        met = 0
        for _ in range(200):
            line = [f"w{rng.integers(9**6)}" for _ in range(size)]
            longer = line[:]
            longer.insert(int(rng.integers(size + 1)), "inserted")
            a, b = band_keys(split_words(pa.array([" ".join(line), " ".join(longer)])))
            met += bool(((a == b) & (a > 0)).any())
        assert met >= 190


def test_lines_of_ten_and_eleven_words_meet(spark):
    from lakeline.llm.line_dedup import dedup_lines

    rng = np.random.default_rng(7)
    rows = []
    for k in range(40):
        line = [f"word{rng.integers(9**6)}" for _ in range(10)]
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(line[:4] + ["inserted"] + line[4:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc.doc_id: r.n_kept for r in dedup_lines(docs, near="edit").collect()}
    assert sum(out[2 * k] == 1 and out[2 * k + 1] == 0 for k in range(40)) >= 38
