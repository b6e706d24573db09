"""Cross-entropy difference: target and background bigram models over the words of the whole corpus."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import SPACED, Words, Work, blocks_of, by_block, chunks, mix, pack, release, small, tasks, tidy, unpack, utf8

#: Weight of the word's own frequency in its smoothed bigram probability.
BACKOFF = 20.0
#: Blocks of the count tables, at least; they grow with the input's partitions.
BLOCKS = 64
#: Bytes of text in a shard, which asks for each of its different counts once.
SHARD_BYTES = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_ids(texts: pa.Array, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, 0 for those outside a given vocabulary, and each text's first word."""
    raw, offsets = utf8(texts)
    words = Words(raw, offsets, SPACED)
    h = words.hashes()
    return h if vocabulary is None else np.where(np.isin(h, vocabulary), h, np.uint64(0)), words.of


def keys_of(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key of (word before, word) and the word before, for all words; a text begins after word 0. And each
    word's text."""
    before = np.concatenate([np.zeros(1, np.uint64), ids[:-1]]) if len(ids) else ids
    n = np.diff(of)
    before[of[:-1][n > 0]] = 0
    return mix(mix((before + np.uint64(1)) * _ODD) ^ ids), before, np.repeat(np.arange(len(n)), n)


def words_of(ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words, 0 among them, and each one's number in ids and in before."""
    words, at = np.unique(np.concatenate([np.zeros(1, np.uint64), ids]), return_inverse=True)
    at_before = np.zeros(len(ids), np.int64)
    at_before[1:] = at[1:-1]
    at_before[before == 0] = 0  # the smallest number is that of word 0
    return words, at[1:], at_before


def cuts_of(keys: np.ndarray, bits_: int) -> np.ndarray:
    """Where each of the 2 ** bits_ blocks begins in sorted keys, and the end; a block is a range of keys."""
    return np.concatenate([np.searchsorted(keys, np.arange(1 << bits_, dtype=np.uint64) << np.uint64(64 - bits_)), [len(keys)]])


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0, each in as many bytes a number as its largest one needs."""
    out = []
    for a in arrays:
        k = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        out += [len(a).to_bytes(8, "little"), bytes([k]), np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes()]
    whole = b"".join(out)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> list[np.ndarray]:
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(data):
        n, k = int.from_bytes(data[at : at + 8], "little"), data[at + 8]
        a = np.zeros((n, 8), np.uint8)
        a[:, :k] = np.frombuffer(data, np.uint8, n * k, at + 9).reshape(k, n).T
        out.append(a.view(np.int64).reshape(-1))
        at += 9 + n * k
    return out


def steps(keys: np.ndarray, base: int) -> np.ndarray:
    """Sorted keys as steps from the base on, which take fewer bytes."""
    return np.diff(keys, prepend=np.uint64(base))


def vocabulary_of(docs: DataFrame, size: int, text_column: str = "text") -> np.ndarray:
    """Hashes of the most frequent words of all texts, ties by hash."""
    n_blocks = max(BLOCKS, tasks(docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged(h, n):
            h, at = np.unique(h, return_inverse=True)
            return h, np.bincount(at, n, len(h)).astype(np.int64)

        def flush(h, n):
            for b, (x, k) in by_block((h % np.uint64(n_blocks)).astype(np.int64), n_blocks, h, n):
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([pack(x, k)], pa.binary())], ["block", "data"])

        for b in chunks(batches, text_column):
            raw, offsets = utf8(b.column(text_column))
            h, n = np.unique(Words(raw, offsets, SPACED).hashes(), return_counts=True)
            held_h, held_n = merged(np.concatenate([held_h, h]), np.concatenate([held_n, n]))
            if len(held_h) > 1 << 20:
                yield from flush(held_h, held_n)
                held_h, held_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield from flush(held_h, held_n)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in blocks_of(batches):
            both = [unpack(p, np.uint64, np.int64) for p in pieces]
            h, at = np.unique(np.concatenate([x for x, _ in both]), return_inverse=True)
            n = np.bincount(at, np.concatenate([k for _, k in both])).astype(np.int64)
            best = np.lexsort((h.astype(np.int64), -n))[:size]  # no more than this can be among the best of all
            yield pa.record_batch([pa.array(h[best].astype(np.int64)), pa.array(n[best])], ["h", "n"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select(text_column).mapInArrow(tidy(count), "block int, data binary").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(tidy(total), "h long, n long")
    top = found.orderBy(F.desc("n"), "h").limit(size).collect()
    return np.array([r["h"] for r in top], np.int64).astype(np.uint64)


def sharded(docs: DataFrame, text_column: str) -> DataFrame:
    """lm_shard and rows: about SHARD_BYTES of one task's texts with their other columns, as a compressed stream."""

    def pack_rows(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.record_batch([pa.array([shard], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["lm_shard", "rows"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, held = TaskContext.get().partitionId() << 32, 0, []
        for b in chunks(batches, text_column):
            more = b.column(text_column).nbytes
            if held and size + more > SHARD_BYTES:
                yield pack_rows(shard, held)
                shard, size, held = shard + 1, 0, []
            held.append(b)
            size += more
        if held:
            yield pack_rows(shard, held)

    return docs.mapInArrow(tidy(go), "lm_shard long, rows binary")


def rows_of(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def counts_of(shards: DataFrame, vocabulary, bits_: int, text_column: str, target_column: str) -> DataFrame:
    """Answers to every shard and block, in the order of the shard's keys there: lm_shard, block, data, the counts
    of pairs and of words, these also as the word before, in the background (all texts) and in the target, from
    every text. And for each block a row without a shard: words, whole_sum and part_sum, its different words and
    how often they occur.

    Tasks send each different key of a shard once with its counts, so a frequent word weighs like a rare one; a
    block holds the keys of one hash range, and blocks grow in number with the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, data in zip(b.column("lm_shard").to_pylist(), b.column("rows")):
                own = rows_of(data.as_buffer())
                ids, of = word_ids(own.column(text_column), vocabulary.value)
                pair, before, who = keys_of(ids, of)
                target = np.asarray(own.column(target_column).combine_chunks().fill_null(False)).astype(bool)[who]
                pairs, at = np.unique(pair, return_inverse=True)
                both = [np.bincount(x, minlength=len(pairs)) for x in (at, at[target])]
                words, at, at_before = words_of(ids, before)
                single = [np.bincount(x, minlength=len(words)) for x in (at, at[target], at_before, at_before[target])]
                p, w = cuts_of(pairs, bits_), cuts_of(words, bits_)
                blocks, data = [], []
                for k in range(1 << bits_):
                    i, j, base = slice(p[k], p[k + 1]), slice(w[k], w[k + 1]), k << (64 - bits_)
                    if p[k] < p[k + 1] or w[k] < w[k + 1]:
                        blocks.append(k)
                        data.append(squeeze(steps(pairs[i], base), *(x[i] for x in both), steps(words[j], base), *(x[j] for x in single)))
                yield pa.record_batch([pa.array(blocks, pa.int64()), pa.array(np.full(len(blocks), shard, np.int64)), pa.array(data, pa.binary())], ["block", "lm_shard", "data"])

    def summed(block: int, shard: list[int], data: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unsqueeze(d) for d in data]
        base, of = np.uint64(block << (64 - bits_)), np.array(shard)
        answers: dict[int, list[np.ndarray]] = {x: [] for x in dict.fromkeys(shard)}
        sums = []
        for first, n in ((0, 2), (3, 4)):  # pairs, words
            keys = np.concatenate([np.cumsum(x[first].view(np.uint64), dtype=np.uint64) + base for x in parts])
            who = np.repeat(of, [len(x[first]) for x in parts])
            all_, at = np.unique(keys, return_inverse=True)
            order = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[order], np.arange(len(all_)))
            total = []
            for c in range(n):
                column = np.concatenate([x[first + 1 + c] for x in parts])
                total.append(np.add.reduceat(column[order], starts) if len(starts) else column)
            order = np.argsort(who, kind="stable")
            ends = np.searchsorted(who[order], list(answers), "left"), np.searchsorted(who[order], list(answers), "right")
            for x, lo, hi in zip(answers, *ends):
                own = np.unique(at[order[lo:hi]])
                answers[x] += [t[own] for t in total]
            sums = total
        yield _answers(block, [None], [None], [int((sums[0] > 0).sum())], [int(sums[0].sum())], [int(sums[1].sum())])
        for x, a in answers.items():
            yield _answers(block, [x], [squeeze(*a)], [None], [None], [None])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, data = None, [], []
        for b in batches:
            for k, x, d in zip(b.column("block").to_pylist(), b.column("lm_shard").to_pylist(), b.column("data")):
                if k != now and data:
                    yield from summed(now, shard, data)
                    shard, data = [], []
                now = k
                shard.append(x)
                data.append(d.as_py())
        if data:
            yield from summed(now, shard, data)

    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = shards.mapInArrow(tidy(count), "block long, lm_shard long, data binary")
    asked = asked.repartition(max(parts, (1 << bits_) // 4), "block").sortWithinPartitions("block")
    return asked.mapInArrow(tidy(total), "block long, lm_shard long, data binary, words long, whole_sum long, part_sum long")


def _answers(block: int, *cols: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array([block], pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["block", "lm_shard", "data", "words", "whole_sum", "part_sum"])


def bits(both, word, before, total: int, size: int, backoff: float = BACKOFF):
    """-log2 p(word | word before): bigram counts smoothed by the word's own frequency, itself add-one."""
    return -np.log2((both + backoff * ((word + 1.0) / (total + size))) / (before + backoff))


def losses(counts: np.ndarray, backoff: float = BACKOFF) -> np.ndarray:
    """The bits of all cells of a square table of counts (word before, word)."""
    word = counts.sum(axis=0)
    return bits(counts, word, counts.sum(axis=1, keepdims=True), word.sum(), len(counts), backoff).astype(np.float32)


def score(docs: DataFrame, target_column: str, text_column: str = "text", vocabulary: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """The rows with lm_tokens, loss_target, loss_background (bits a token) and lm_score, target less background:
    low scores are like the target. Columns of these names give way.

    target_column marks target texts; null marks none. Null and empty texts have no tokens and null losses.
    Counts come from every text. Repeated rows count each time and score alike. Both models are over all words of
    the corpus, as tables of counts by hash in the shared folder; a vocabulary makes one class of all words but
    its most frequent ones. With keep, only these columns of the rows stay.
    """
    names = ["lm_tokens", "loss_target", "loss_background", "lm_score"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    spark = docs.sparkSession
    work = Work(spark, "lm")
    listed = None if vocabulary is None else vocabulary_of(docs.select(text_column), vocabulary, text_column)
    shared = spark.sparkContext.broadcast(listed)
    # the text and the target have names of their own, whatever is kept
    plain = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_column}`").alias("lm_text"), F.col(f"`{target_column}`").alias("lm_target"))
    bits_ = (max(BLOCKS, 4 * tasks(plain)) - 1).bit_length()
    shards = work.table("shards", sharded(plain, "lm_text"))
    found = work.table("counts", counts_of(shards, shared, bits_, "lm_text", "lm_target"))
    gc.collect()
    spark._jvm.System.gc()  # lets the shuffle of the counts go
    sums = found.filter("lm_shard IS NULL").agg(F.sum("words"), F.sum("whole_sum"), F.sum("part_sum")).head()
    words, whole_sum, part_sum = (x or 0 for x in sums)
    size = (words if vocabulary is None else vocabulary) + 1
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[: len(kept)])

    def go(rows: pa.Table, answers: pa.Table) -> pa.Table:
        release()  # what the shard before left
        rows = rows_of(rows.column("rows")[0].as_buffer())
        ids, of = word_ids(rows.column("lm_text"), shared.value)
        pair, before, who = keys_of(ids, of)
        pairs, at = np.unique(pair, return_inverse=True)
        words, at_word, at_before = words_of(ids, before)
        # blocks are ranges of keys, so their answers follow one another as the shard's keys do
        said = [unsqueeze(d) for _, d in sorted(zip(answers.column("block").to_pylist(), answers.column("data").to_pylist()))]
        counts = [np.concatenate(x) for x in zip(*said)]
        if [len(x) for x in counts] != [len(pairs)] * 2 + [len(words)] * 4:
            raise ValueError("counts do not fit their shard")
        n = np.diff(of)
        mean = []
        for k, t in ((1, part_sum), (0, whole_sum)):
            loss = bits(counts[k][at], counts[2 + k][at_word], counts[4 + k][at_before], t, size)
            mean.append(np.bincount(who, loss, len(n)) / np.maximum(n, 1))
        cols = [pa.array(n.astype(np.int64)), *[pa.array(m, mask=n == 0) for m in (*mean, mean[0] - mean[1])]]
        return pa.table([*[rows.column(c) for c in kept], *cols], [*kept, *names])

    answers = found.filter("lm_shard IS NOT NULL").select("lm_shard", "block", "data")
    return shards.groupBy("lm_shard").cogroup(answers.groupBy("lm_shard")).applyInArrow(go, f"{fields}, lm_tokens long, loss_target double, loss_background double, lm_score double")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's losses; the target is what labels call good and not toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(((F.max("quality") == 1) & (F.max("toxic") == 0)).alias("target")).withColumnRenamed("doc_id", "label_id")
    marked = docs.join(small(good), F.col("doc_id") == F.col("label_id"), "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    return score(marked, "target", keep=["doc_id"]).select("doc_id", "lm_tokens", F.round("loss_target", 6).alias("loss_target"), F.round("loss_background", 6).alias("loss_background"), F.round("lm_score", 6).alias("lm_score"))
