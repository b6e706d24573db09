"""Benchmark decontamination by an FM-index of words for each training shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import ALNUM, Words, chunks, tidy, utf8

#: Words in a window.
WINDOW = 10
#: Distance of sampled suffix positions.
SAMPLE = 8
#: Bytes of text that a benchmark may have.
ITEM_BYTES = 64 << 20
#: Bytes of text in a shard's index.
SHARD_BYTES = 6 << 20


def suffix_order(seq: np.ndarray, bits: int) -> np.ndarray:
    """The suffix array of seq, whose last symbol is its only 0.

    The first sort compares as many symbols as fit 63 bits; doubling then refines only suffixes that still tie.
    """
    n = len(seq)
    take = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(take):
        key <<= bits
        key[: max(0, n - k)] |= seq[k:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.empty(n, bool)
    new[0], new[1:] = True, key[1:] != key[:-1]
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    size = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, size)  # a suffix's rank is the place of the first that ties with it
    del key
    tied = np.flatnonzero(np.repeat(size, size) > 1)  # places in order
    h = take
    while len(tied):
        who = order[tied]
        after = rank[np.minimum(who + h, n - 1)]
        group = rank[who]
        best = np.lexsort((after, group))
        who, after, group = who[best], after[best], group[best]
        order[tied] = who
        start = np.empty(len(who), bool)
        start[0] = True
        start[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(who)))
        rank[who] = np.repeat(tied[at], size)
        tied = tied[np.repeat(size, size) > 1]
        h *= 2
    return order


class Wavelet:
    """A wavelet matrix: counts of a symbol before a place, for many symbols and places at once."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            one = ((seq >> b) & 1).astype(bool)
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((b, ones, len(seq) - int(ones[-1])))
            seq = np.concatenate([seq[~one], seq[one]])

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = np.zeros(len(symbol), np.int64)
        for b, ones, zeros in self.levels:
            up = ((symbol >> b) & 1).astype(bool)
            lo, hi, base = (np.where(up, zeros + ones[x], x - ones[x]) for x in (lo, hi, base))
        return lo - base, hi - base


class FMIndex:
    """Words of a shard, searchable backwards. Symbols: 0 ends the shard, 1 ends a text, words from 2."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.n = len(seq)
        bits = max(1, int(symbols - 1).bit_length())
        order = suffix_order(seq, bits)
        last = seq[order - 1]  # the symbol before each suffix; before the first comes the end mark
        self.start = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        self.tree = Wavelet(last, bits)
        self.last = last
        # every SAMPLE-th position keeps its place in the order, so locating walks fewer than SAMPLE steps
        kept = order % SAMPLE == 0
        self.marked = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
        self.kept = order[kept].astype(np.int32)

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffix order that begin with each phrase (rows, left-aligned, size words each)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(1, int(size.max(initial=0)) + 1):
            live = np.flatnonzero((size >= step) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, size[live] - step]
            a, b = self.tree.ranks(c, lo[live], hi[live])
            lo[live], hi[live] = self.start[c] + a, self.start[c] + b
        return lo, np.maximum(hi, lo)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of places in the suffix order."""
        row, steps = row.copy(), np.zeros(len(row), np.int64)
        out = np.zeros(len(row), np.int64)
        live = np.arange(len(row))
        while len(live):
            r = row[live]
            here = self.marked[r + 1] > self.marked[r]
            done = live[here]
            out[done] = self.kept[self.marked[row[done]]] + steps[done]
            live = live[~here]
            r = row[live]
            c = self.last[r]
            row[live] = self.start[c] + self.tree.ranks(c, r, r)[0]
            steps[live] += 1
        return out


def windows_of(texts: list[str | None], ids: list, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Different windows of the items as word hashes (rows of `size`), their lengths, and the (window, item)
    pairs. An item with fewer words, but some, is one window."""
    raw, offsets = utf8(pa.array(texts, pa.string()))
    words = Words(raw, offsets, ALNUM)
    h = words.hashes()
    seen: dict[bytes, int] = {}
    rows, sizes, pairs = [], [], []
    for d, item in enumerate(ids):
        own = h[words.of[d] : words.of[d + 1]]
        n = min(size, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            w = own[k : k + n]
            at = seen.setdefault(w.tobytes(), len(seen))
            if at == len(rows):
                rows.append(np.concatenate([w, np.zeros(size - n, np.uint64)]))
                sizes.append(n)
            pairs.append((at, item))
    return np.array(rows, np.uint64).reshape(-1, size), np.array(sizes, np.int64), sorted(set(pairs), key=lambda p: (p[0], str(p[1]))), ids


def search_shard(texts: pa.Array, phrases: np.ndarray, sizes: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Indexes the texts and finds all phrases: the words, each text's first word, and (word place, phrase)."""
    raw, offsets = utf8(texts)
    words = Words(raw, offsets, ALNUM)
    h = words.hashes()
    none = np.zeros(0, np.int64)
    if not len(h) or not len(phrases):
        return words, words.of, none, none
    sorted_ = np.sort(h)
    vocab = sorted_[np.concatenate([[True], sorted_[1:] != sorted_[:-1]])]
    counts = np.diff(words.of)
    # a text's end mark follows its words
    place = np.arange(len(h)) + np.repeat(np.arange(len(counts)), counts)
    seq = np.ones(len(h) + len(counts) + 1, np.int64)
    seq[-1] = 0
    seq[place] = np.searchsorted(vocab, h) + 2
    at = np.searchsorted(vocab, phrases)
    known = vocab[np.minimum(at, len(vocab) - 1)] == phrases
    known |= np.arange(phrases.shape[1]) >= sizes[:, None]
    ask = np.flatnonzero(known.all(axis=1))
    if not len(ask):
        return words, words.of, none, none
    index = FMIndex(seq, len(vocab) + 2)
    lo, hi = index.search(np.where(np.arange(phrases.shape[1]) < sizes[ask, None], at[ask] + 2, 0), sizes[ask])
    n = hi - lo
    which = np.repeat(ask, n)
    row = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    found = index.locate(row)
    doc = np.searchsorted(np.flatnonzero(seq == 1), found)
    return words, words.of, found - doc, which


SPANS = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, cut: bool = False, null_items: bool = False) -> DataFrame:
    """The rows with n_words, n_hit (words inside any occurrence of a window), items (ids, as sorted strings, of
    items with an occurring window), and spans, the hit words' byte spans, merged where words adjoin. With cut,
    the text without its spans takes the text's place and spans are left out.

    Null and empty texts have no words. Repeated rows get equal results; items with equal text are all named, and an
    id that several items have is named once. Items with a null id are left out; with null_items their windows are
    searched too, and only the list of ids lacks them.
    The benchmark is a test set, read by the driver and broadcast as word hashes; one of more than ITEM_BYTES of text
    raises ValueError. Each task indexes its texts in shards of SHARD_BYTES, equal texts of a shard
    once; nothing is shuffled.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{item_text}`")).cast("long") + 8), F.lit(0))).head()[0]
    if size > ITEM_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text, more than {ITEM_BYTES}: search its parts one after the other")
    items = [(r[0], r[1]) for r in benchmark.select(F.col(f"`{item_id}`"), F.col(f"`{item_text}`")).collect() if null_items or r[0] is not None]
    phrases, sizes, pairs, _ = windows_of([t for _, t in items], [None if i is None else str(i) for i, _ in items], window)
    owner: dict[int, list[str]] = {}
    for at, item in pairs:
        owner.setdefault(at, []).extend([] if item is None else [item])
    shared = docs.sparkSession.sparkContext.broadcast((phrases, sizes, owner))
    mine = ["n_words", "n_hit", "items", "spans"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in mine]
    extra = text_column not in kept
    plain = docs.select(*[F.col(f"`{c}`") for c in kept], *([F.col(f"`{text_column}`")] if extra else []))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields if f.name in kept)
    schema = f"{fields}, {SPANS}"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, sizes, owner = shared.value
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in chunks(batches, text_column, SHARD_BYTES):
            column = b.column(text_column)
            coded = column.dictionary_encode()
            texts, code = coded.dictionary, np.asarray(coded.indices.fill_null(-1))
            words, of, at, which = search_shard(texts, phrases, sizes)
            n_words = np.diff(of)
            # each occurrence covers its phrase's words; a difference array merges them
            step = np.zeros(len(words.start) + 1, np.int32)
            np.add.at(step, at, 1)
            np.add.at(step, at + sizes[which], -1)
            hit = np.cumsum(step[:-1]) > 0
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[of])
            doc = np.searchsorted(of, at, "right") - 1
            by_doc: dict[int, set[str]] = {}
            for d, w in zip(*[x.tolist() for x in np.unique(np.stack([doc, which]), axis=1)] if len(doc) else ([], [])):
                by_doc.setdefault(d, set()).update(owner[w])
            spans: dict[int, list] = {}
            base = utf8(texts)[1]
            for d in by_doc:
                own = np.flatnonzero(hit[of[d] : of[d + 1]]) + of[d]
                cuts = np.flatnonzero(np.diff(own) > 1)
                first, last = own[np.concatenate([[0], cuts + 1])], own[np.concatenate([cuts, [len(own) - 1]])]
                spans[d] = [{"start": int(s - base[d]), "end": int(e - base[d])} for s, e in zip(words.start[first], words.end[last])]
            pick = lambda a: np.where(code >= 0, a[np.maximum(code, 0)], 0) if len(a) else np.zeros(len(code), np.int64)
            cols = [b.column(c) for c in kept]
            if cut and text_column in kept and spans:
                cols[kept.index(text_column)] = pa.array([without(t, spans.get(c)) for t, c in zip(column.to_pylist(), code.tolist())], column.type)
            cols += [pa.array(pick(n_words).astype(np.int64)), pa.array(pick(n_hit).astype(np.int64))]
            cols += [pa.array([sorted(by_doc.get(c, ())) for c in code.tolist()], pa.list_(pa.string())), pa.array([[] if cut else spans.get(c, []) for c in code.tolist()], span)]
            yield pa.record_batch(cols, [*kept, *mine])

    return plain.mapInArrow(tidy(search), schema)


def without(text: str | None, spans: list | None) -> str | None:
    """The text without its byte spans."""
    if not spans or text is None:
        return text
    raw, at, out = text.encode(), 0, []
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*out, raw[at:]]).decode("utf-8", "ignore")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's hits."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_leaks(docs.select("doc_id", "text"), items, keep=["doc_id"], null_items=True)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, g, len(g) AS k FROM (SELECT item_id, w[i:i + 9] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
q AS (SELECT r, i, w[i] || ' ' || coalesce(w[i + 1], '') AS s FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (SELECT DISTINCT r, i, k FROM q JOIN (SELECT DISTINCT k, g[1] || ' ' || coalesce(g[2], '') AS s FROM g WHERE k > 1) USING (s) UNION SELECT r, i, 1 FROM q WHERE EXISTS (SELECT 1 FROM g WHERE k = 1) ),
m AS MATERIALIZED (SELECT r, i, k, item_id FROM (SELECT r, i, k, w[i:i + k - 1] AS g FROM c JOIN d USING (r)) JOIN g USING (k, g)),
n AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + k)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
