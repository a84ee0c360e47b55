"""Language identification: known words first, then ever shorter character n-grams.

A word seen in training scores by its log frequency in each language.  An unseen
word backs off to its n-grams (with word ends marked): the longest length of which
any n-gram is known gives the mean of their log frequencies.  A text's score is the
sum over all its words, so whole texts count, and the posterior of the best
language is the result.

Training reads a sample of about ``per_lang`` labelled rows per language, chosen by
a hash of the identifier; that bound also bounds the model that is broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import saved

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4
BATCH = 1 << 20  # characters scored at once


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(text: str, words: list[str]) -> bool:
    return any(map(str.isalpha, words)) or any(map(str.isalpha, text))


def grams(word: str, n: int) -> list[str]:
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Words(dict):
    """Word -> number in order of first sight; ``new`` lists those without scores yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = code = len(self)
        return code


class Model:
    """Log frequencies per language of words (length 0) and of n-grams by their length."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[dict[str, int], np.ndarray]], max_words: int = 200_000):
        self.langs, self.tables, self.max_words = langs, tables, max_words
        self.fresh()

    @classmethod
    def of(cls, counts: list[tuple[str, int, str, int]]) -> Model:
        langs = sorted({lang for lang, *_ in counts})
        at = {lang: i for i, lang in enumerate(langs)}
        tables = {}
        for n in range(LONGEST + 1):
            mine = [(g, at[lang], c) for lang, m, g, c in counts if m == n]
            rows = {g: i for i, g in enumerate(dict.fromkeys(g for g, _, _ in mine))}
            seen = np.zeros((len(rows), len(langs)))
            for g, lang, c in mine:
                seen[rows[g], lang] += c
            tables[n] = rows, np.log((seen + 0.5) / (seen.sum(0) + 0.5 * (len(rows) + 1))).astype(np.float32)
        return cls(langs, tables)

    def fresh(self) -> None:
        self.codes, self.scores = Words(), np.zeros((0, len(self.langs)), np.float32)

    def scored(self, words: list[str]) -> np.ndarray:
        """A row per word: its log frequencies, or its longest known n-grams' mean."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        left = np.arange(len(words))
        for n in (0, *range(LONGEST, 0, -1)):
            rows, table = self.tables[n]
            parts = [grams(words[i], n) if n else [words[i]] for i in left.tolist()]
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            found = np.fromiter((rows.get(g, -1) for p in parts for g in p), np.int64, size.sum())
            owner = np.repeat(np.arange(len(left)), size)[found >= 0]
            hits = np.bincount(owner, minlength=len(left))
            some = np.flatnonzero(hits)
            if len(some):
                first = np.concatenate([[0], np.cumsum(hits[some])[:-1]])
                out[left[some]] = np.add.reduceat(table[found[found >= 0]], first, axis=0) / hits[some, None]
            left = left[hits == 0]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        words = [words_of(t or "") for t in texts]
        told = [i for i, w in enumerate(words) if w and self.langs and has_letter(texts[i], w)]
        if not told:
            return out
        if len(self.codes) > self.max_words:  # bounds memory, not results
            self.fresh()
        size = np.array([len(words[i]) for i in told])
        flat = pa.array(list(chain.from_iterable(words[i] for i in told)), pa.string()).dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        code = np.fromiter(map(self.codes.__getitem__, distinct), np.int64, len(distinct))[np.array(flat.indices)]
        if self.codes.new:
            self.scores = np.concatenate([self.scores, self.scored(self.codes.new)])
            self.codes.new = []
        total = np.add.reduceat(self.scores[code], np.cumsum(size) - size, axis=0, dtype=np.float64)
        p = np.exp(total - total.max(1, keepdims=True))
        best = p.argmax(1)
        for i, k, s in zip(told, best.tolist(), (1 / p.sum(1)).tolist()):
            out[i] = self.langs[k], s
        return out


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows -> counts of words (n = 0) and n-grams of each task."""
    counts: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((lang, w) for w in words_of(text or ""))
    out: Counter = Counter()
    for (lang, w), c in counts.items():
        out[lang, 0, w] += c
        for n in range(1, LONGEST + 1):
            for g in grams(w, n):
                out[lang, n, g] += c
    rows = [(*k, c) for k, c in out.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["lang", "n", "gram", "count"])


def crc_part(id_col: str) -> Column:
    """crc32 of the identifier as text, modulo 4; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def train(labelled: DataFrame, per_lang: int = 600, min_count: int = 2) -> Model:
    """Fit on columns id, text, lang.

    Every language of the rows is learnt, from about ``per_lang`` different rows at most:
    a row is in the sample when a hash of its id and text falls below per_lang / different
    rows of its language (estimated by a sketch), and counts once however often it is
    repeated.  So null ids, ids that many rows share and repeated rows neither empty the
    sample nor fill it.  Words and n-grams seen fewer than ``min_count`` times count as unseen.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("lang", "text", F.xxhash64(F.lit("language"), "id", "text").alias("hash"))
    # Written, so that its size is known when the join is planned: small ones are broadcast.
    per = saved(rows.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n")), "language-rows")
    chance = F.pmod("hash", F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.join(per, "lang").where(chance < F.lit(float(per_lang)) / F.col("n")).dropDuplicates(["lang", "hash"]).select("lang", "text")
    counts = sample.mapInArrow(gram_counts, "lang string, n long, gram string, count long")
    counts = counts.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    kept = counts.withColumn("all", F.sum("count").over(gram_window())).where(F.col("all") >= min_count).drop("all")
    return Model.of([tuple(r) for r in kept.orderBy("lang", "n", "gram").collect()])


def gram_window():
    from pyspark.sql import Window

    return Window.partitionBy("n", "gram")


def predictor(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t or "")
            if size > BATCH:
                out += shared.value.predict(some)
                some, size = [], 0
        return pd.DataFrame(out + shared.value.predict(some), columns=["lang", "score"])

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training) -> DataFrame:
    """Every row of docs as struct ``doc``, with held_out, lang_pred and score.

    Learns from rows with a language whose crc32(id as text) mod 4 is not 2; the
    others are held out.  A null text, one without any letter, or a model without
    training rows gives ``und`` and score 0.  A null id counts as the empty text for
    the hold-out.  Repeated rows each get a row, an empty table an empty result.
    """
    learn = docs.where(crc_part(id_col) != 2).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    predict = predictor(docs, train(learn, **training))
    rows = docs.select(F.struct("*").alias("doc"), (crc_part(id_col) == 2).alias("held_out"), predict(F.col(text_col)).alias("found"))
    return rows.select("doc", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def language_of(docs: DataFrame, **training) -> DataFrame:
    """doc_id, held_out, lang_pred, score of documents."""
    return identify(docs.select("doc_id", "text", "lang"), **training).select("doc.doc_id", "held_out", "lang_pred", "score")


def drop_unidentified(docs: DataFrame, min_score: float = 0.5, **training) -> DataFrame:
    """The rows of docs, all columns, whose language was found with ``min_score`` or more."""
    found = identify(docs, **training)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("doc.*")
