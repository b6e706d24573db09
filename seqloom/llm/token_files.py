"""Token-ID output: canonical length-limited Huffman codes of ids, decoded by table in independent blocks.

File format, a Parquet container so that commits survive lost executors:

- `codes`: one row a token id that occurs: token, count, length. Codes are canonical: ordered by (length, id).
- `parts`: rows of up to SEGMENT tokens in the global document order: part (number of the range of documents),
  seq (number of the segment in its part), docs (packed document ids, null flags and token counts), bits (the
  code stream, most significant bit first), marks (bit offset of every BLOCK-th token, 64-bit). A block is
  decoded by itself from its mark.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import Work, chunks, pack, tasks, tidy, unpack, utf8

#: Longest code in bits, unless more ids occur than there are such codes: the decoding table has 2 ** MAX_BITS entries.
MAX_BITS = 18
#: Tokens between two bit-offset checkpoints.
BLOCK = 512
#: Tokens in a segment.
SEGMENT = 1 << 20
#: Pieces that a worker remembers in each of two generations: up to 40 MB each, whatever the corpus.
CACHE = 200_000
#: Longer pieces are not remembered.
LONG = 64

#: Fixed value: the splitting pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# -- encoding -----------------------------------------------------------------------------------------------
class _Cache(dict):
    """Ids of pieces, as bytes. When full, the older half of what it remembers goes."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, piece):
        got = self.old.get(piece)
        if got is None:
            got = self.make(piece)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got


class Encoder:
    """Whole texts to ids with the tokenizers library, each different piece of a chunk of texts once.

    A byte-level vocabulary that splits by PATTERN never joins across some places, such as a space between two other
    characters: texts are cut there, and Arrow finds the different pieces of all texts of a chunk. Any other
    tokenizer gets the whole texts, and so does every text that holds an added token such as <|endoftext|>.
    """

    def __init__(self, path: str, end_id: int | None = 2):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile(b"|".join(added)).search if added else None
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else "<u4")
        self.end = np.array([] if end_id is None else [end_id], self.dtype)
        pre = self.tokenizer.pre_tokenizer
        shape = pre.__getstate__() if pre is not None else b""
        self.split = b'"ByteLevel"' in shape and b'"add_prefix_space":false' in shape and b"Sequence" not in shape and self.tokenizer.normalizer is None
        self.find = regex.compile(PATTERN).findall
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(keep)]
        self.bytes = str.maketrans({chr(b): chr(256 + n) for n, b in enumerate(other)})
        self.space, self.code = self.bytes[32], "H" if self.dtype.itemsize == 2 else "I"
        self.parts = _Cache(self._part, CACHE // 4)
        self.pieces = _Cache(self._piece, CACHE)

    def _part(self, part: str) -> bytes:
        text = part.encode().decode("latin-1").translate(self.bytes)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            text = self.space + text[1:] if text[0] == " " else text
            return array(self.code, [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()
        if text[:1] == " " and text[1:].isalpha():
            return self._part(text)
        return b"".join(self.parts[p] if len(p) <= LONG else self._part(p) for p in self.find(text))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, text: str) -> bytes:
        """Ids of one text with the end id, little-endian."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id after it, and where each text's ids begin, and the end."""
        raw, offsets = utf8(texts)
        if not self.split or (self.added and self.added(raw)):
            each = [np.concatenate([self._text(raw[a:b]), self.end]) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.concatenate([np.zeros(0, self.dtype), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
        starts = cuts(raw, offsets[:-1][np.diff(offsets) > 0])
        ids, n = self._ids(raw, starts)
        upto = np.concatenate([[0], np.cumsum(n)])
        first = upto[np.searchsorted(starts, offsets)]
        if not len(self.end):
            return ids, first
        begin = first + np.arange(len(first))
        out = np.full(begin[-1], self.end[0], self.dtype)
        inside = np.ones(len(out), bool)
        inside[begin[1:] - 1] = False
        out[inside] = ids
        return out, begin

    def _text(self, raw: np.ndarray) -> np.ndarray:
        if not self.split or self.added(raw):
            return self._whole(raw.tobytes().decode())
        return self._ids(raw, cuts(raw, np.zeros(min(1, len(raw)), np.int64)))[0]

    def _ids(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that begin at the starts and fill raw, and how many ids each piece has."""
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        ends = np.append(starts, len(raw)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        at = np.asarray(coded.indices)
        _, ends, data = coded.dictionary.buffers()
        ends, data = np.frombuffer(ends, np.int64, len(coded.dictionary) + 1).tolist(), data.to_pybytes()
        each = [self.pieces[data[a:b]] if b - a <= LONG else self._piece(data[a:b]) for a, b in zip(ends, ends[1:])]
        size = np.array([len(x) for x in each], np.int64) // self.dtype.itemsize
        known = np.frombuffer(b"".join(each), self.dtype)
        n = size[at]
        upto = np.cumsum(n)
        place = np.repeat((np.cumsum(size) - size)[at] - (upto - n), n)
        return known[place + np.arange(len(place))], n


_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
#: ASCII letters, digits, signs, the apostrophe, which may begin a piece with letters, and the line feed.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[39], _KIND[10] = 4, 5


def cuts(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin: at the first byte of each text, at safe spaces, and between ASCII characters where PATTERN
    always ends a piece: where letters, digits and signs meet, and beside a single line feed."""
    at = np.zeros(len(raw) + 1, bool)
    kind = _KIND[raw]
    a, b = kind[:-1], kind[1:]
    at[1:-1] = (a != b) & (a > 0) & (b > 0) & (a != 4) & ~((a == 3) & (b == 4))
    feed = np.flatnonzero(a == 5)
    at[feed[(feed == 0) | (kind[feed - 1] == 0) | (kind[feed - 1] == 5)] + 1] = False  # white space of several characters ends otherwise
    at[first] = at[safe_spaces(raw)] = True
    return np.flatnonzero(at)


def safe_spaces(raw: np.ndarray) -> np.ndarray:
    """Places of spaces that stand between two characters other than white space of any kind."""
    at = np.flatnonzero(raw == 32)
    at = at[(at > 0) & (at < len(raw) - 1)]
    before, after = _PLAIN[raw[at - 1]], _PLAIN[raw[at + 1]]
    odd = np.flatnonzero(~(before & after))  # beside control characters, other spaces or beyond ASCII
    if len(odd):
        pad = np.concatenate([np.full(3, 32, np.uint8), raw, np.full(3, 32, np.uint8)])
        o = at[odd] + 3
        left = before[odd] | ((pad[o - 1] >= 128) & ~_blank(pad[o - 3], pad[o - 2], pad[o - 1]))
        right = after[odd] | ((pad[o + 1] >= 194) & ~(_blank(np.zeros(len(o), np.uint8), pad[o + 1], pad[o + 2]) | _blank(pad[o + 1], pad[o + 2], pad[o + 3])))
        at = np.delete(at, odd[~(left & right)])
    return at


def _blank(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether bytes end in white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029,
    U+202F, U+205F, U+3000 (fixed values)."""
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return two | general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))


_ENCODERS: dict = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    """One for each worker process, which keeps what it remembers from task to task."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


# -- codes --------------------------------------------------------------------------------------------------
def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of the shortest prefix code of the counts with none above `most`; 0 for a count of 0.

    Package-merge: the items of a level are the ids and pairs of items of the level before, by weight; of the last
    level's, the 2 n - 2 lightest are taken, and an id's length is the number of levels at which it is among them.
    Where more ids occur than codes of `most` bits exist, codes are as long as they must be.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    most = max(most, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)  # weights beyond 2 ** 53 may be rounded, which costs bits, not correctness
    items, levels = leaves, [np.ones(n, bool)]
    for _ in range(most - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        items, leaf = both[place], place < n
        levels.append(leaf)
    take = 2 * n - 2
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        out[order[:own]] += 1
        take = 2 * (take - own)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: consecutive numbers in order of (length, id)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = lengths[order]
    # each code starts where those before it end, in units of the finest step
    most = int(n.max()) if len(n) else 0
    start = np.concatenate([[0], np.cumsum(1 << (most - n))[:-1]]) if len(n) else n
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (start >> (most - n)).astype(np.uint64)
    return codes


def write_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The code stream, and the bit offset of every BLOCK-th id."""
    n = lengths[ids]
    end = np.cumsum(n)
    at = end - n
    total = int(end[-1]) if len(ids) else 0
    word, shift = at >> 5, (64 - n - (at & 31)).astype(np.uint64)
    value = codes[ids] << shift  # within the 64 bits that begin at the word
    # bits of different ids never overlap, so sums of doubles below 2 ** 32 are exact
    size = (total >> 5) + 2
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), size)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    return (high + low).astype(np.uint32).astype(">u4").tobytes()[: (total + 7) // 8], at[::BLOCK].astype(np.uint64)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length by the next `most` bits of the stream."""
    most = max(1, int(lengths.max())) if len(lengths) else 1
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    reach = 1 << (most - lengths[order])
    table = np.zeros(1 << most, np.uint32)
    width = np.ones(1 << most, np.uint8)
    filled = int(reach.sum()) if len(order) else 0
    table[:filled], width[:filled] = np.repeat(order, reach), np.repeat(lengths[order], reach)
    return table, width, most


def read_bits(bits: bytes, marks: np.ndarray, n: int, table: np.ndarray, width: np.ndarray, most: int) -> np.ndarray:
    """All ids of a stream: its blocks go side by side, one id of each at a step."""
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8)
    out = np.zeros((BLOCK, len(marks)), np.uint32)
    at, full = marks.astype(np.int64), n // BLOCK
    for step in range(min(BLOCK, n)):
        if step == n - full * BLOCK:
            at = at[:full]  # the last block has ended
        byte = at >> 3
        window = (raw[byte].astype(np.uint32) << 24) | (raw[byte + 1].astype(np.uint32) << 16) | (raw[byte + 2].astype(np.uint32) << 8) | raw[byte + 3]
        code = (window << (at & 7).astype(np.uint32)) >> np.uint32(32 - most)
        out[step, : len(at)] = table[code]
        at = at + width[code]
    return out.T.reshape(-1)[:n]


# -- the operator -------------------------------------------------------------------------------------------
def write_tokens(docs: DataFrame, work: Work, path: str, end_id: int | None = 2, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes whole texts and writes the format above into the work folder as `codes` and `parts`.

    A null text is empty. Documents go by ascending id, nulls first; equal ids in the order of their tokens. A very
    long text is a segment of its own; an empty table gives files without rows. Other columns are not read. Ids of a text are made once and kept in a table, from which the global counts
    and then the streams come.
    """
    plain = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        seen = np.zeros(0, np.int64)
        for b in chunks(batches, "text"):
            ids, begin = enc.encode_all(b.column("text"))
            n = np.bincount(ids)
            if len(n) > len(seen):
                seen = np.concatenate([seen, np.zeros(len(n) - len(seen), np.int64)])
            seen[: len(n)] += n
            at = (begin * enc.dtype.itemsize).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at), pa.py_buffer(ids)])
            yield pa.record_batch([b.column("doc_id"), data, pa.nulls(b.num_rows, pa.binary())], ["doc_id", "ids", "counts"])
        used = np.flatnonzero(seen)
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pack(used.astype(np.int64), seen[used])], pa.binary())], ["doc_id", "ids", "counts"])

    ids = work.table("ids", plain.mapInArrow(tidy(encode), "doc_id long, ids binary, counts binary"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in b.column("counts").to_pylist():
                token, count = unpack(d, np.int64, np.int64)
                yield pa.record_batch([pa.array(token), pa.array(count)], ["token", "n"])

    counts = ids.filter("counts IS NOT NULL").select("counts").mapInArrow(tidy(spread), "token long, n long").groupBy("token").agg(F.sum("n").alias("count"))
    found = counts.toPandas()  # one row for each id of the vocabulary at most
    dense = np.zeros(int(found["token"].max()) + 1 if len(found) else 0, np.int64)
    dense[found["token"].to_numpy()] = found["count"].to_numpy()
    lengths = code_lengths(dense)
    spark = docs.sparkSession
    used = np.flatnonzero(lengths)
    work.table("codes", spark.createDataFrame([(int(t), int(dense[t]), int(lengths[t])) for t in used], "token long, count long, length int").coalesce(1))
    dtype = encoder(path, end_id).dtype
    shared = spark.sparkContext.broadcast(lengths)  # bounded by the vocabulary

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = shared.value
        codes = canonical(lengths)
        held: list[tuple[int | None, bytes]] = []
        size, seq = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            tokens = np.frombuffer(b"".join(h[1] for h in held), dtype)
            bits, marks = write_bits(tokens, lengths, codes)
            who = pack(np.array([h[0] or 0 for h in held], np.int64), np.array([len(h[1]) // dtype.itemsize for h in held], np.int64), np.array([h[0] is None for h in held], np.int8))
            out = pa.record_batch([pa.array([seq], pa.int64()), pa.array([who], pa.binary()), pa.array([bits], pa.binary()), pa.array([marks.tobytes()], pa.binary())], ["seq", "docs", "bits", "marks"])
            held.clear()
            seq, size = seq + 1, 0
            return out

        for b in batches:
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                held.append((doc, data.as_py()))
                size += len(held[-1][1]) // dtype.itemsize
                if size >= SEGMENT:
                    yield flush()
        if held:
            yield flush()

    rows = ids.filter("ids IS NOT NULL").select("doc_id", "ids")
    # a range of a repeated id is cut further by what the row holds
    rows = rows.withColumn("tie", F.xxhash64("ids"))
    parts = max(1, tasks(plain))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    rows.mapInArrow(tidy(compress), "seq long, docs binary, bits binary, marks binary").withColumn("part", F.spark_partition_id()).write.parquet(f"{work.root}/parts")
    work.drop("ids")


def read_tokens(spark: SparkSession, work: Work) -> DataFrame:
    """The files' documents: doc_id, part, at (place in its part), before (ids before it in its part), tokens."""
    return _read(spark, work, True)


def _read(spark: SparkSession, work: Work, with_tokens: bool) -> DataFrame:
    codes = work.read("codes", spark.createDataFrame([], "token long, count long, length int").schema)
    found = codes.select("token", "length").toPandas()  # bounded by the vocabulary
    lengths = np.zeros(int(found["token"].max()) + 1 if len(found) else 0, np.int64)
    lengths[found["token"].to_numpy()] = found["length"].to_numpy()
    shared = spark.sparkContext.broadcast(lengths)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, width, most = decode_table(shared.value)
        for b in batches:
            for part, seq, docs, bits, marks in zip(*[b.column(c).to_pylist() for c in ("part", "seq", "docs", "bits", "marks")]):
                doc, n, null = unpack(docs, np.int64, np.int64, np.int8)
                ids = read_bits(bits, np.frombuffer(marks, np.uint64), int(n.sum()), table, width, most).astype("<u4")
                end = np.cumsum(n)
                view = [ids[e - k : e].tobytes() for e, k in zip(end, n)]
                out = [pa.array(doc, mask=null.astype(bool)), pa.array(np.full(len(doc), part, np.int64)), pa.array(np.full(len(doc), seq, np.int64)), pa.array(np.arange(len(doc)))]
                out += [pa.array(n), pa.array([zlib.crc32(v) for v in view], pa.int64())] + ([pa.array(view, pa.binary())] if with_tokens else [])
                yield pa.record_batch(out, ["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"] + ["tokens"] * with_tokens)

    schema = "doc_id long, part long, seq long, at long, n_tokens long, ids_crc32 long" + ", tokens binary" * with_tokens
    raw = spark.read.parquet(f"{work.root}/parts").select("part", "seq", "docs", "bits", "marks")
    return raw.mapInArrow(tidy(decode), schema)


def token_index(spark: SparkSession, work: Work) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    rows = work.table("index", _read(spark, work, False))
    segments = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    # totals of parts meet in one task: as many rows as the files have ranges
    totals = segments.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("skip")).join(totals, "part")
    segments = segments.select("part", "seq", (F.col("base") + F.col("skip")).alias("from"))
    place = Window.partitionBy("part", "seq").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(place), F.lit(0)))
    return rows.join(segments, ["part", "seq"]).select("doc_id", (F.col("from") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's place, length and checksum, read back from the files."""
    import public_tokenizers

    work = Work(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), work, public_tokenizers.path("byte_bpe_50k.json"))
    return token_index(spark, work)
