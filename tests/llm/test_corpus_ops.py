"""Free-form operators and the pipeline against brute force, and every odd input."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import SF, closest, dedup_lines as brute_lines, levenshtein, repeated_windows, simhash_groups
from pyspark.sql import functions as F

import corpus_pipeline
from lakeline.llm import line_dedup as L
from lakeline.llm import queries as Q
from lakeline.llm.components import components
from lakeline.llm.decontaminate import DEFAULTS, ItemBlock, best_match, contaminated, drop_contaminated, words_of
from lakeline.llm.line_dedup import dedup_lines, edit_alike, edit_distance, hamming_pairs, normalised
from lakeline.llm.mixing import mix
from lakeline.llm.substring_dedup import Pair, alike, compact_windows, drop_passages, repeated_passages, without, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, salt int, doc string, row long, tokens string, epoch int"
CLASH = (1, "d", 1, "t", 1)


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, lang, src, 1, *CLASH) for d, t, lang, src in rows], DOCS)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 50)]
    from brute import Sets

    sets = Sets(3000)
    for a, b in edges:
        sets.join(a, b)
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, sets.find(x)) for e in edges for x in e if sets.find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edit_distances():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(0, n)))
    for _ in range(300):
        a, b = word(12), word(12)
        assert edit_distance(a, b) == levenshtein(a, b)
        assert edit_alike(a, b, 0.7) == (levenshtein(a, b) <= int(0.3 * max(len(a), len(b)) + 1e-9))
        if a:
            want, got = closest(a, b), best_match(list(a), list(b), len(a))
            assert got is None and want == len(a) or got[0] == want


def test_lines_brute(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_lines({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc.doc_id: r.text for r in dedup_lines(docs).collect()} == want


def test_normalised():
    assert normalised(["", " \t ", " A  b\u00a0C ", "É\x1cx"]) == ["", "", "a b c", "é x"]


def test_lines_odd(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(3, f"{long}\n\nshort", "en", "s"), (2, f"  {long.upper()} \nother line", None, None), (2, f"  {long.upper()} \nother line", None, None), (None, "short\nx", "en", "s"),
            (5, None, "en", "s"), (6, "", "en", "s"), (7, "x\nx\n\n", "en", "s"), (8, "word " * 40000 + "\n" + "word " * 40001, "en", "s")]
    got = dedup_lines(docs_of(spark, rows)).collect()
    of = {r.doc.doc_id: (r.text, r.n_lines, r.n_kept) for r in got}
    assert len(got) == len(rows)
    assert of[2] == (f"  {long.upper()} \nother line", 2, 2) and of[3] == ("\nshort", 3, 2) and of[5] == (None, 0, 0) and of[6] == ("", 1, 1)
    assert of[7] == ("x\n\n", 4, 3) and of[None] == ("", 2, 0) and of[8][2] == 1
    assert dedup_lines(docs_of(spark, rows).where("false")).count() == 0


def test_lines_by_edits_alone(spark):
    """Lines of every length with one word in ten changed meet, whatever their fingerprints."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i, n in enumerate([5, 8, 10, 16, 32, 60, 100] * 30):
        line = [word() for _ in range(n)]
        other = [*line]
        for at in rng.sample(range(n), max(1, n // 10)):
            other[at] = word()
        assert edit_alike(" ".join(line), " ".join(other), 0.8)
        rows += [(i, " ".join(line), "en", "s"), (1000 + i, " ".join(other), "en", "s")]
    kept = {r.doc.doc_id for r in dedup_lines(docs_of(spark, rows), near="edit").collect() if r.n_kept}
    assert kept >= set(range(210)) and len(kept) <= 210 + 6


def test_lines_failed_edges_are_taken_again(spark):
    """Near fingerprints of unlike lines between two alike ones lose no link."""
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    fps = [base] + [base ^ (1 << int(b)) for b in rng.choice(62, 30, replace=False)]
    lines = spark.createDataFrame([(bytes([i]), f, bytes([i])) for i, f in enumerate(fps)], "tid binary, fp long, label binary")
    every = {(bytes(r.a), bytes(r.b)) for r in hamming_pairs(lines, 3, labelled=True).collect()}
    assert every == {(bytes([i]), bytes([j])) for i in range(31) for j in range(i + 1, 31)}
    forest = {(bytes(r.a), bytes(r.b)) for r in hamming_pairs(lines, 3).collect()}
    assert forest < every and components(spark.createDataFrame(list(forest), "a binary, b binary")).select("root").distinct().count() == 1


def test_lines_taken_again_in_bounded_memory():
    """A run of unlike lines of one fingerprint gives pairs some at a time, all that an edit check can pass."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz\u00e4") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(1000)]
    lines += [" ".join([*x.split()[1:], "new"]) for x in lines[:20]]
    n = len(lines)
    ids = pa.array([i.to_bytes(16, "big") for i in range(n)], pa.binary())
    rows = pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([0] * n), pa.array([0] * n), ids, ids, pa.array(L.shapes(lines), pa.binary())], ["block", "value", "fp", "tid", "label", "shape"])
    made, most = set(), 0
    for batch in L.block_pairs(L.FAR, True, 0.8, L.pairs_met)(iter([rows])):
        most = max(most, batch.num_rows)
        made |= {(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in zip(*(c.to_pylist() for c in batch.columns))}
    assert 0 < len(made) < n * (n - 1) // 4 and most <= L.MOST_PAIRS < n * (n - 1) // 2
    assert all((i, 1000 + i) in made for i in range(20) if edit_alike(lines[i], lines[1000 + i], 0.8))
    some = rng.sample([(i, j) for i in range(n) for j in range(i + 1, n)], 20_000)
    assert all(pair in made for pair in some if edit_alike(lines[pair[0]], lines[pair[1]], 0.8))


def test_pairs_that_cannot_be_alike_are_not_scored(monkeypatch):
    """Passages are scored only where enough shingles are common; nothing that could pass is left out."""
    from lakeline.llm import substring_dedup as S

    rng = random.Random(6)
    vocab = [rng.getrandbits(64) for _ in range(400)] + [1, 2]
    made = []
    for i in range(120):
        a = [rng.choice(vocab[:400] if i % 3 else vocab[398:]) for _ in range(rng.randint(40, 160))]
        b = [rng.choice(vocab) for _ in range(rng.randint(0, 60))] + [x if rng.random() > i % 4 / 60 else rng.choice(vocab) for x in a]
        made.append((np.array(a, np.uint64), np.array(b if i % 2 else b[: len(b) // 2] + a[: len(a) // 3], np.uint64)))
    a, b = zip(*made)
    sa, sb = S.shingles_each(a), S.shingles_each(b)
    assert all((x == S.shingles_of(h)).all() for x, h in zip(sa + sb, a + b))
    for x, y, possible in zip(a, b, S.reachable(sb, sa, 46, 0.8)):
        pair = Pair(x, y)
        assert len(possible) == max(0, len(y) - 49)
        for j in range(len(possible)):
            assert possible[j] or all(pair.similarity(i, j, 50) < 0.8 for i in range(0, max(0, len(x) - 49), 3))
    scored = []
    monkeypatch.setattr(Pair, "similarities", lambda self, i, j, n, words, f=Pair.similarities: (scored.append(n), f(self, i, j, n, words))[1])
    unlike = [np.array([rng.getrandbits(64) for _ in range(300)], np.uint64) for _ in range(2)]
    unlike[1][100:120] = unlike[0][100:120]
    assert alike(unlike[0], 0, unlike[1], 0, [(0, 80, 110)], 50, 0.8) == [] and not scored


def test_compact_windows_brute():
    rng = np.random.default_rng(7)
    h = rng.integers(1, 40, 400).astype(np.uint64)  # many ties
    h[[60, 61, 200, 399]] = 0
    w = 9
    first, last, at, _ = compact_windows(h, w)
    got = {s: p for f, t, p in zip(first, last, at) for s in range(f, t + 1)}
    want = {i: i + int(np.argmin(h[i : i + w])) for i in range(len(h) - w + 1) if (h[i : i + w] > 0).all()}
    assert got == want and sum(last - first + 1) == len(want)


def test_passages_cover_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = repeated_passages(docs).collect()
    split = {d: t.encode().lower().split() for d, t in texts.items()}
    spans = defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start_word, r.end_word))
        assert r.keep_id < r.doc_id and r.end_word - r.start_word >= 50 and r.similarity >= 0.8 and r.end_word <= len(split[r.doc_id])
        if r.similarity == 1 and r.end_word - r.start_word == r.keep_end - r.keep_start:
            assert split[r.doc_id][r.start_word : r.end_word] == split[r.keep_id][r.keep_start : r.keep_end]
    want = repeated_windows(texts)
    need = [(d, i) for d, at in want.items() for i in at]
    met = [(d, i) for d, i in need if any(a <= i and i + 50 <= b for a, b in spans[d])]
    assert set(want) <= set(spans) and len(met) >= 0.995 * len(need)


def test_passages_planted(spark):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = words(60).split()
    near = [w if i != 30 else "changed" for i, w in enumerate(passage)]
    rows = [(i, f"{words(30)} {' '.join(passage).upper()}\n{words(30)}", "en", "s") for i in range(20)]
    rows += [(100, f"{words(80)} {' '.join(near)} {words(10)}", "en", "s"), (200, words(500), "en", "s"), (201, None, "en", "s"), (202, "", None, None), (None, " ".join(passage), "en", "s")]
    docs = docs_of(spark, rows).repartition(5)
    found = repeated_passages(docs)
    got = {(r.doc_id, r.end_word - r.start_word >= 50) for r in found.collect()}
    assert got == {(i, True) for i in [*range(1, 20), 100, None]}
    cut = {r.doc.doc_id: r.text for r in drop_passages(docs, found).collect()}
    assert len(cut) == len(rows) and cut[200] == rows[21][1] and all(len(cut[i].split()) == 60 for i in range(1, 20)) and len(cut[0].split()) == 120
    assert repeated_passages(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        repeated_passages(docs, words=500)


def hashed(words):
    return word_hashes([" ".join(w if isinstance(w, str) else w.decode() for w in words).encode()])[0]


def test_passages_in_crowded_keys(spark):
    """A near copy is found though an unlike document that shares most of the passage comes first."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(9**6)}" for _ in range(n)]
    rows, n = [], 300
    for k in range(n):
        passage = words(60)
        near, unlike = [*passage], words(10) + passage[10:50] + words(10)
        near[29] = "changed"
        for i, body in enumerate((unlike, passage, near)):
            rows.append((3 * k + i, " ".join(words(40) + body + words(40)), "en", "s"))
    found = {(r.doc_id, r.keep_id) for r in repeated_passages(docs_of(spark, rows)).collect()}
    caught = sum((3 * k + 2, 3 * k + 1) in found for k in range(n))
    assert caught >= 0.9 * n


def test_passages_beside_unlike_documents(spark):
    """An unlike document that comes first in their keys takes no link from two alike ones."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(9**6)}" for _ in range(n)]
    rows = []
    for k in range(300):
        passage = words(60)
        near, unlike = [*passage], words(10) + passage[10:50] + words(10)
        near[29] = "changed"
        rows += [(3 * k + i, " ".join(words(40) + body + words(40)), "en", "s") for i, body in enumerate((unlike, passage, near))]
    alone, beside = ({(r.doc_id, r.keep_id) for r in repeated_passages(docs_of(spark, some)).collect()} for some in ([r for r in rows if r[0] % 3], rows))
    assert len(alone) > 270 and alone <= beside


def test_links_of_a_key(monkeypatch):
    """All pairs of ranges with different words, some at a time; equal ones meet their first and the first of the key."""
    from lakeline.llm import substring_dedup as S

    monkeypatch.setattr(S, "MOST_PAIRS", 50)
    rng = np.random.default_rng(9)
    key, doc = rng.integers(1, 40, 500).astype(np.uint64), rng.integers(0, 30, 500)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    ends, pack = rng.integers(0, 12, 500).astype(np.uint64) << np.uint64(20), rng.integers(0, 2, 500) << 16
    lead, a, b = S.copies(key, doc, pack, ends)
    star = set(zip(a.tolist(), b.tolist()))
    heads = [[j for j in range(500) if key[j] == key[i]] for i in range(500)]
    firsts = [next(j for j in heads[i] if (ends[j], pack[j]) == (ends[i], pack[i])) for i in range(500)]
    assert lead.tolist() == sorted(set(firsts))
    assert star == {(j, i) for i in range(500) if firsts[i] != i for j in (firsts[i], heads[i][0]) if doc[j] != doc[i]}
    got = [pair for x, y in S.linked(key[lead], doc[lead]) for pair in zip(lead[x].tolist(), lead[y].tolist())]
    every = [(i, j) for i in lead.tolist() for j in lead.tolist() if i < j and key[i] == key[j] and doc[i] != doc[j]]
    assert sorted(got) == sorted(every) and len(every) > 500


def test_passage_hashes():
    from lakeline.llm.substring_dedup import passages_of

    x = np.random.default_rng(1).integers(1, 1 << 63, 500, np.uint64)
    x[300:400] = x[100:200]
    h = passages_of(x, 46)
    assert (h[300:355] == h[100:155]).all() and len(set(h.tolist())) == 500 - 55


def test_joined_spans():
    from lakeline.llm.substring_dedup import joined

    assert joined([(1, 5, 9), (1, 10, 12), (0, 1, 2), (1, 0, 6), (1, 20, 21), (0, 1, 2)]) == [(1, 0, 12), (0, 1, 2), (1, 20, 21)]


def test_passage_helpers():
    assert without("a b  c\nd e", [(1, 3)]) == "a d e" and without("a b", [(0, 2)]) == "" and without(None, []) is None
    assert Pair(hashed("abcdef"), hashed("abcdex")).similarity(0, 0, 6) == pytest.approx(1 / 3)
    many = hashed(str(i) for i in range(9000))
    assert Pair(many, many).similarity(5, 5, 50) == 1.0 and Pair(many, many).similarity(5, 6, 50) == pytest.approx(45 / 47)


def test_passages_every_start():
    """Near passages of 50 to 60 words are found wherever they lie in a span."""
    rng = random.Random(9)
    words = lambda n, k=9**5: [b"%d" % rng.randrange(k) for _ in range(n)]
    for trial in range(200):
        size, k = rng.randint(50, 60), rng.choice([3, 9**5])  # few different words: repeated shingles
        passage = words(size, k)
        near = [*passage]
        near[rng.randint(12, size - 13)] = b"changed"
        a, b = words(rng.randint(60, 99)) + passage + words(99), words(rng.randint(60, 99)) + near + words(99)
        diagonal = next(i for i in range(60, 100) if a[i : i + size] == passage) - next(i for i in range(60, 100) if b[i : i + size] == near)
        lo, hi = max(0, -diagonal), min(len(b), len(a) - diagonal) - 50
        a, b = hashed(a), hashed(b)
        pair = Pair(a, b)
        want = [pair.similarity(i + diagonal, i, 50) for i in range(lo, hi + 1)]
        assert pair.similarities(lo + diagonal, lo, hi + 1 - lo, 50) == pytest.approx(want)
        got = alike(a, 0, b, 0, [(diagonal, lo, hi)], 50, 0.8)
        assert (k == 3 or max(want) >= 0.8) and {i for p, q, *_ in got for i in range(p, q - 49)} >= {i for i, s in enumerate(want, lo) if s >= 0.8}


def test_decontaminate_brute(spark):
    """Items edited up to the limit are found; what is found is within the limit, as the plain distance says."""
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    hosts = [words_of(r.text)[:60] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng, rows, planted = random.Random(3), [], []
    for k in range(150):
        item, text = rng.choice(items)
        w = words_of(text)
        for _ in range(rng.randint(0, len(w) // 5)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [rng.choice(rng.choice(hosts))] * rng.randint(0, 1)
        host = rng.choice(hosts)
        at = rng.randint(0, len(host))
        rows.append((k, " ".join(host[:at] + w + host[at:]), "en", "s"))
        planted.append((k, item))
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(docs, bench, block_items=60).collect()}
    texts, of = {r[0]: words_of(r[1]) for r in rows}, dict(items)
    for (d, i), s in got.items():
        w = words_of(of[i])
        assert 1 - closest(w, texts[d]) / len(w) == pytest.approx(s)
    within = [(d, i) for d, i in planted if closest(words_of(of[i]), texts[d]) <= int(0.2 * len(words_of(of[i])) + 1e-9)]
    assert len(within) > 100 and sum(x in got for x in within) >= 0.98 * len(within)
    kept = drop_contaminated(docs, bench, block_items=60)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(texts) - {d for d, _ in got}


def test_decontaminate_odd(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = docs_of(spark, [(1, f"x, {item.upper()}!", None, None), (1, f"x, {item.upper()}!", None, None), (2, None, "en", "s"), (3, "", "en", "s"), (None, item, "en", "s"), (4, "filler " * 100_000 + item, "en", "s")])
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "alpha beta"), (None, "one two three four five six seven eight nine")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start_word, r.end_word) for r in contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(1, 1, 1, 11)] * 4 + [(None, 1, 0, 10)] * 2 + [(4, 1, 100_000, 100_010)] * 2, key=str)
    assert contaminated(docs, bench.where("false")).count() == contaminated(docs.where("false"), bench).count() == 0
    assert drop_contaminated(docs, bench.where("false")).count() == 6
    assert ItemBlock([], **DEFAULTS).find(["a"]) == [[]]


def plain_budgets(leaves, weights, budget, depth=0, path=()):
    """Water level by repeated passes over the children, down the tree."""
    if not leaves or depth == len(next(iter(leaves))):
        return {path: budget}
    kids = defaultdict(dict)
    for k, c in leaves.items():
        kids[k[depth]][k] = c
    cap = {k: sum(v.values()) for k, v in kids.items()}
    w = {k: round(weights.get((*path, k), 1.0) * 10**6) for k in kids}
    share, open_, left = {k: 0 for k in kids if not w[k]}, {k for k in kids if w[k]}, budget
    while full := {k for k in open_ if cap[k] * sum(w[x] for x in open_) <= left * w[k]}:
        share |= {k: cap[k] for k in full}
        left, open_ = left - sum(cap[k] for k in full), open_ - full
    total = sum(w[x] for x in open_)
    share |= {k: left * w[k] // total for k in open_}
    out = {}
    for k, v in kids.items():
        out |= plain_budgets(v, weights, share[k], depth + 1, (*path, k))
    return out


def test_mix_brute(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice(["en", "de", None]), f"s{rng.randint(0, 3) if i % 3 else 0}") for i in range(400)]
    weights = {("en",): 0.5, ("de",): 0.1, ("en", "s1"): 3.0, ("en", "s2"): 0.0}
    levels = {"lang": F.col("lang"), "site": F.col("source")}
    tokens = defaultdict(int)
    for _, t, lang, s in rows:
        tokens[lang, s] += len(t.split())
    for share, epochs in ((0.3, 1), (0.9, 1), (1.5, 3)):
        total = sum(tokens.values())
        want = plain_budgets({k: v * epochs for k, v in tokens.items()}, weights, min(int(total * share), total * epochs))
        taken = defaultdict(list)
        for r in mix(docs_of(spark, rows), levels, weights, share, epochs).collect():
            taken[r.leaf.lang, r.leaf.site].append((r.tokens, r.epoch, r.doc.doc_id))
        longest = 30
        for leaf, budget in want.items():
            got = sum(t for t, _, _ in taken[leaf])
            assert budget - longest < got <= budget or got == budget
            per = defaultdict(int)
            for _, e, _ in taken[leaf]:
                per[e] += 1
            n = sum((lang, s) == leaf for _, _, lang, s in rows)
            assert all(per[e] == n for e in range(budget // tokens[leaf])) and all(e <= budget // tokens[leaf] for e in per)


def test_mix_odd(spark):
    docs = docs_of(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one two", None, None), (3, "one two", None, None), (None, "x", "en", "a")])
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = mix(docs, levels, {}, 1.0)
    assert sorted(str(r.doc.doc_id) for r in got.collect()) == ["3", "3", "None"] and got.select("doc.*").columns == docs.columns
    assert mix(docs.where("false"), levels, {}, 1.0).count() == mix(docs, levels, {}, 0.0).count() == 0


def test_pipeline_stages(spark):
    """Each stage against a plain version on its own input."""
    import zlib

    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs_of(spark, [(None, None, None, None), (90001, "!!", "en", "s"), (90002, "", None, "s")]).select(*docs.columns)
    docs, made = docs.unionByName(extra), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = corpus_pipeline.saved(stage(spark, docs, SF), f"test{i}")
        made.append((before, docs.collect()))
        if i < 4:
            assert docs.columns == extra.columns
    (a, b), (_, c), (_, d), (_, e), (_, f) = made
    assert {r.doc_id for r in a} - {r.doc_id for r in b} == {None, 90001, 90002}
    assert {r.doc_id for r in c} == {g[2] for g in simhash_groups([(r.doc_id, r.text) for r in b])} and len(c) == len({r.doc_id for r in c})
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in c if all(closest_within(x, words_of(r.text)) for x in items)}
    assert {r.doc_id for r in d} == clean
    n = lambda rows: sum(len(r.text.split()) for r in rows)
    assert 0.6 * n(d) < n(e) <= 0.9 * n(d) and {r.doc_id for r in e} <= {r.doc_id for r in d}
    tok, at = Tokenizer.from_file(Q.tokenizer_path()), 0
    want = {}
    for r in sorted(e, key=lambda r: r.doc_id):
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 1]
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in f} == want


def closest_within(item, text):
    """True when ``item`` does not occur in ``text`` within a fifth of its words."""
    if len(set(item) & set(text)) < 0.5 * len(set(item)):
        return True
    return best_match_plain(item, text) > int(0.2 * len(item) + 1e-9)


def best_match_plain(item, text):
    ids = {w: i for i, w in enumerate(dict.fromkeys(item))}
    t = np.array([ids.get(w, -1) for w in text])
    row = np.zeros(len(t) + 1, np.int64)
    for i, w in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (t != ids[w]))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def test_pipeline_on_an_empty_table(spark, tmp_dir):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(f"{tmp_dir}/sf/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_dir}/sf/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_dir}/sf").count() == 0
