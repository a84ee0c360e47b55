"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A file is a chain of chunks.  A chunk holds a bounded number of ids (2 bytes each
where the vocabulary allows, else 4), the documents' end offsets and the document
ids.  Both sequences rise, so both are Elias-Fano coded: about 2 + log2(u / n)
bits an entry, with the position of every 256th set bit as select samples, and no
64-bit table.  ``EliasFano.select`` finds one entry from its sample and a few
bytes; ``values`` decodes all at once.

Documents are range-partitioned and sorted by id, tokenised where they land, and
written by Spark's text writer with the chunk's end mark as line separator, so the
commit protocol covers lost executors.  Chunk totals, one small row per chunk,
give each chunk's first offset.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeline.llm.common import saved

# Fixed values of the file format.
MAGIC = b"LKTOKEF1"
END = "LKTOKEND"
HEAD = struct.Struct("<8sIIQQQBqQQQ")  # magic, shard, chunk, docs, null ids, ids, width, first doc_id, bytes of ids, ends, doc ids
SAMPLE = 256


class EliasFano:
    """A rising sequence of unsigned integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value, read from its sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        left, at = i % SAMPLE, int(self.samples[i // SAMPLE])
        byte, skip = at // 8, at % 8
        bits = int(self.high[byte]) >> skip << skip
        while (k := bits.bit_count()) <= left:
            left, byte = left - k, byte + 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        high = byte * 8 + (bits & -bits).bit_length() - 1 - i
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        low = int.from_bytes(self.low[first // 8 : last // 8 + 1].tobytes(), "little") >> first % 8
        return high << self.low_bits | low & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out

    def pack(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: memoryview) -> EliasFano:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", data)
        at = struct.calcsize("<QBQQ")
        parts = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, low_bits, *parts, np.frombuffer(data, "<u4", -(-n // SAMPLE), at + a + b))


def packed_chunk(shard: int, chunk: int, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    body = ids.astype(f"<u{width}").tobytes()
    ends = EliasFano.of(np.cumsum(lengths)).pack()
    gaps = EliasFano.of(known.astype(np.uint64) - np.array(first, np.int64).astype(np.uint64)).pack()
    return HEAD.pack(MAGIC, shard, chunk, len(doc_ids), len(doc_ids) - len(known), len(ids), width, first, len(body), len(ends), len(gaps)) + body + ends + gaps


def chunks_of(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, EliasFano]]:
    """shard, chunk, document ids, token ids and end offsets of each chunk of a file."""
    view, at = memoryview(content), 0
    while at < len(view):
        magic, shard, chunk, n, nulls, n_ids, width, first, a, b, c = HEAD.unpack_from(view, at)
        at += HEAD.size
        if magic != MAGIC:
            raise ValueError("not a token file")
        ids = np.frombuffer(view, f"<u{width}", n_ids, at)
        ends = EliasFano.unpack(view[at + a : at + a + b])
        gaps = EliasFano.unpack(view[at + a + b : at + a + b + c]).values()
        known = (gaps + np.array(first, np.int64).astype(np.uint64)).astype(np.int64)
        yield shard, chunk, [None] * nulls + known.tolist(), ids, ends
        at += a + b + c + len(END)


class WordEncoder:
    """Encodes texts word by word, each distinct word once.

    Right for tokenizers whose pre-tokenizer never lets a token cross ASCII white
    space and drops that white space, sets letters apart from marks, and marks word
    ends, as the word-end BPE does.  New words of small Latin letters, alone or with
    one mark behind, need no normalising: they are encoded a thousand at a time by
    the bare model and cut apart after their end-of-word tokens.  Other new words go
    through the whole tokenizer with a special token between them.  Known words are
    found by two independent hashes (96 bits) in flat sorted arrays, about 30 bytes
    a word; of more than ``max_words`` all are forgotten, which bounds memory, not
    results.
    """

    MARKS = ".,!?;:"

    def __init__(self, path: str, max_words: int = 2_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.max_words = Tokenizer.from_file(path), max_words
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark_id, self.mark = special[-1]
        ends = self.tokenizer.model.end_of_word_suffix
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[[i for t, i in self.tokenizer.get_vocab().items() if ends and t.endswith(ends)]] = True
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Punctuation("isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = [b"ab", b"c", b"de,", b"'s", b"it's", "é.".encode(), b"x!!"]
        if self.tokenizer.encode(b" ".join(probe).decode(), add_special_tokens=False).ids != self.encoded(probe)[1].tolist():
            raise ValueError("this tokenizer does not encode words apart from each other")
        self.forget()

    def forget(self) -> None:
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.first, self.size, self.pool = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, self.kind)

    def kind_of(self, t: str) -> int:
        """1: small Latin letters, 2: those and one mark, 0: other, -1: may spell a special token."""
        base = t[:-1] if t[-1:] in self.MARKS and t else t
        if base.isalpha() and base.islower() and max(base) < "\u0250":
            return 1 if base is t else 2
        return -1 if "<|" in t else 0

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids in a row."""
        text = [w.decode("utf-8", "replace") for w in words]
        kinds = np.fromiter(map(self.kind_of, text), np.int8, len(text))
        size, parts, order = np.zeros(len(words), np.int64), [np.zeros(0, self.kind)], []

        def add(group: list[int], sizes: np.ndarray, flat: np.ndarray) -> None:
            size[group] = sizes
            parts.append(flat)
            order.extend(group)

        def apart(group: list[int]) -> None:
            flat = np.array(self.tokenizer.encode("".join(text[i] + self.mark for i in group), add_special_tokens=False).ids, self.kind)
            marks = np.flatnonzero(flat == self.mark_id)
            add(group, np.diff(marks, prepend=-1) - 1, np.delete(flat, marks))

        for kind in (1, 2):
            mine = np.flatnonzero(kinds == kind).tolist()
            groups = [mine[i : i + 1000] for i in range(0, len(mine), 1000)]
            for i in range(0, len(groups), 20):
                joined = [" ".join([text[k] for k in g]) for g in groups[i : i + 20]]
                for g, e in zip(groups[i : i + 20], self.bare.encode_batch_fast(joined, add_special_tokens=False)):
                    flat = np.array(e.ids, self.kind)
                    ends = np.flatnonzero(self.is_end[flat])
                    if len(ends) != kind * len(g):
                        raise ValueError("a word did not end once")
                    add(g, np.diff(ends[kind - 1 :: kind], prepend=-1), flat)
        rest = np.flatnonzero(kinds == 0).tolist()
        for i in range(0, len(rest), 1000):
            apart(rest[i : i + 1000])
        for i in np.flatnonzero(kinds == -1).tolist():
            flat = np.array(self.tokenizer.encode(text[i], add_special_tokens=False).ids, self.kind)
            add([i], np.array([len(flat)]), flat)
        flat, sizes = np.concatenate(parts), size[order]
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(sizes) - sizes
        return size, flat[spans(first, size)]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Where each of the distinct words stands in the table; new ones are added."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        check = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))

        def found() -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(self.hash, h)
            in_table = np.minimum(at, max(0, len(self.hash) - 1))
            return in_table, (self.hash[in_table] == h) & (self.check[in_table] == check) if len(self.hash) else np.zeros(len(h), bool)

        at, known = found()
        if not known.all():
            new = np.flatnonzero(~known)
            new = new[np.argsort(h[new])]
            size, flat = self.encoded([words[i] for i in new])
            where = np.searchsorted(self.hash, h[new])
            first = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate([self.pool, flat])
            self.hash, self.check = np.insert(self.hash, where, h[new]), np.insert(self.check, where, check[new])
            self.first, self.size = np.insert(self.first, where, first), np.insert(self.size, where, size)
            at, known = found()
            if not known.all():
                raise ValueError("two words have one hash")
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        if len(self.hash) > self.max_words:
            self.forget()
        # The tokenizer lower-cases anyway, but not its special tokens' spellings.
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(lower)
        per_text = np.array(words.value_lengths(), np.int64)
        coded = words.flatten().dictionary_encode()
        at = self.numbers(coded.dictionary.cast(pa.binary()).to_pylist())
        code = at[np.array(coded.indices)]
        size = self.size[code]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.cumsum(per_text)]
        return self.pool[spans(self.first[code], size)], np.diff(ends, prepend=0)


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions first[i] .. first[i] + size[i] - 1 of all i in a row."""
    upto = np.cumsum(size, dtype=np.int64)
    return np.repeat(first - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder_of(path: str, max_words: int) -> WordEncoder:
    """The worker's encoder, kept over its tasks with the words it knows."""
    if (path, max_words) not in ENCODERS:
        ENCODERS[path, max_words] = WordEncoder(path, max_words)
    return ENCODERS[path, max_words]


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text, the second column."""
    begin = size = 0
    lengths = np.array(pc.binary_length(batch.column(1)), np.int64)
    for i, n in enumerate(lengths.tolist()):
        size += n
        if size >= most or i == len(lengths) - 1:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0


def chunk_writer(tokenizer: str, end_id: int, chunk_ids: int, width: int, block_bytes: int, max_words: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk = TaskContext.get().partitionId(), 0
        encoder, docs, parts, sizes, held = encoder_of(tokenizer, max_words), [], [], [], 0

        def flush() -> pa.RecordBatch:
            data = packed_chunk(shard, chunk, docs, np.concatenate(parts), np.concatenate(sizes), width)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["chunk"])

        for batch in batches:
            for some in slices(batch, block_bytes):
                ids, size = encoder.encode(some.column(1))
                ids = np.insert(ids, np.cumsum(size), end_id)
                docs += some.column(0).to_pylist()
                parts.append(ids.astype(np.uint16 if width == 2 else np.uint32))
                sizes.append(size + 1)
                held += len(ids)
                if held >= chunk_ids:
                    yield flush()
                    docs, parts, sizes, held, chunk = [], [], [], 0, chunk + 1
        if docs:
            yield flush()
        pa.default_memory_pool().release_unused()  # the worker lives on

    return write


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, chunk_ids: int = 2 << 20,
    id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, max_words: int = 2_000_000,
) -> None:
    """Tokenise whole texts and write them in ascending id order under ``path``.

    Null text counts as empty (the end id alone).  Null ids come first; rows with
    equal ids are ordered by their text.  An empty table writes no chunk.  Other
    columns are ignored.  ``tokenizer`` is the path of a tokenizer file.
    ``block_bytes`` (text encoded at once) and ``max_words`` (words remembered) bound
    a worker's memory; the result does not depend on them.
    """
    from tokenizers import Tokenizer

    top = max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    chunks = rows.mapInArrow(chunk_writer(tokenizer, end_id, chunk_ids, 2 if top < 1 << 16 else 4, block_bytes, max_words), "chunk binary")
    chunks.select(F.col("chunk").cast("string")).write.option("lineSep", END).text(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    fields = [("shard", pa.int32()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    shape = "shard int, chunk int, doc_id long, offset long, n_tokens long, ids_crc32 long"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
        shape += ", ids array<long>"
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for shard, chunk, doc_ids, ids, ends in chunks_of(content.as_py()):
                    upto = ends.values().astype(np.int64)
                    begin = np.concatenate([[0], upto[:-1]])
                    for i in range(0, len(doc_ids), 2000):
                        of = slice(i, i + 2000)
                        spans = [ids[a:b] for a, b in zip(begin[of].tolist(), upto[of].tolist())]
                        n = len(spans)
                        cols = [[shard] * n, [chunk] * n, doc_ids[of], begin[of], (upto - begin)[of], [zlib.crc32(x.astype("<u4").tobytes()) for x in spans]]
                        cols += [[x.tolist() for x in spans]] * with_ids
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = saved(files.select("content").mapInArrow(read, shape), "token-docs")
    totals = rows.groupBy("shard", "chunk").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = rows.join(totals, ["shard", "chunk"])
    return out.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
