"""N-gram Jaccard join: a blocked sparse product of document by n-gram incidence.

The matrix has a row for each different shingle set (exact copies are one row) and a column for each shingle.
Rows enter the product only with their prefix, the n - ceil(t n) + 1 first shingles in one global order: two
sets of Jaccard t or more share one of those. Blocks of columns are multiplied apart; sizes bound which rows of
a column can meet. Candidate overlaps are then accumulated exactly.

A pair counts in a column only if it could have its first shared shingle there: what is left of both rows after
their places in the order must still reach the overlap that their sizes call for.

Before whole sets are fetched, the columns are cut into RANGES ranges and the rows' sizes in each bound the
overlap of a pair: the sum of the smaller sizes. Only pairs that this bound lets pass are counted exactly. Pairs of
a long column meet it before they leave the column's task.

A long column is not multiplied out. Its rows first meet a pivot; rows that this leaves in different components
meet each other only where the Jaccard distance, a metric, allows it: |d(x, p) - d(y, p)| <= 1 - t. So every
pair of a column is linked through others, verified, or ruled out by a bound.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import SPACED, Words, Work, blocks_of, by_block, chunks, components, mix, pack, small, tasks, tidy, unpack, utf8

#: Columns of up to this many rows are multiplied out.
SHORT = 12
#: One text in SAMPLE is looked at to put frequent shingles last in the global order, at most MOST of them. The
#: order decides how much work there is, never what is found.
SAMPLE, MOST = 16, 1_000_000
#: Rounds in which each row outside a column's largest component meets one row of another component, before all
#: pairs that are still open are listed.
ROUNDS = 1
#: Rows that a row tries in such a round; what it does not try is left to the list.
TRIES = 1024
#: Ranges of columns in which a row's sizes are kept.
RANGES = 256
#: Entries that a task holds before it hands them on.
HELD = 1 << 19
#: Columns that the sample expects to have more rows than this are not multiplied in one block.
HOT = 1 << 17
#: Rows of a column that are looked at in one task while its open pairs are listed.
TILE = 4096


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has the whole sequence as one."""
    raw, offsets = utf8(texts)
    words = Words(raw, offsets, SPACED)
    h, of = words.hashes(), words.of
    n = np.diff(of)
    s = mix(h + np.uint64(width))
    size = len(h) - width + 1
    for k in range(1, width):
        if size > 0:
            s[:size] = mix((s[:size] ^ h[k : k + size]) * np.uint64(0x9E3779B97F4A7C15))
    for d in range(len(n)):
        if n[d] >= width:
            own = np.sort(s[of[d] : of[d + 1] - width + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n[d]:
            one = mix(np.array([n[d]], np.uint64))
            for x in h[of[d] : of[d + 1]]:
                one = mix(one ^ x)
            yield one
        else:
            yield h[:0]


def entity(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(np.array([mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) ^ np.uint64(len(s))]))[0].astype(np.int64))


def could(n, place, m, other, percent: int):
    """Whether sets of n and m shingles whose first shared one has these places can be similar enough."""
    return (100 + percent) * np.minimum(n - place, m - other) >= percent * (n + m)


def most_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bound of the overlap of a row, as its sizes by range, with each of others."""
    out = np.empty(len(y), np.int64)
    for at in range(0, len(y), 4096):
        out[at : at + 4096] = np.minimum(x, y[at : at + 4096]).sum(axis=1, dtype=np.int64)
    return out


def by_sizes(values: list[bytes]) -> np.ndarray:
    """One row of RANGES sizes for each value, of a byte each where all values have it so."""
    if all(len(v) == RANGES for v in values):
        return np.frombuffer(b"".join(values), np.uint8).reshape(-1, RANGES)
    return np.stack([np.frombuffer(v, np.uint8 if len(v) == RANGES else np.uint32).astype(np.uint32) for v in values])


class Join:
    """One run. t is percent / 100; percent and width are whole numbers, so bounds are exact."""

    def __init__(self, docs: DataFrame, work: Work, width: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text"):
        self.work, self.width, self.percent = work, width, percent
        self.docs = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
        self.n_blocks = min(1 << 15, max(64, 4 * tasks(self.docs)))
        self.step = np.log(100 / percent) if percent < 100 else 1.0

    def release(self) -> None:
        """Lets Spark delete shuffle files of steps that are over."""
        gc.collect()
        self.work.spark._jvm.System.gc()

    # -- frequent shingles last ----------------------------------------------------------------------------
    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequent shingles, and those of them whose columns are hot."""
        width, n_blocks = self.width, self.n_blocks
        part = self.docs.filter((F.length("text") > 0) & (F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)).select("text")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def flush():
                h, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                for b, (x, k) in by_block((h % np.uint64(n_blocks)).astype(np.int64), n_blocks, h, n.astype(np.uint32)):
                    yield pa.record_batch([pa.array([b], pa.int32()), pa.array([pack(x, k)], pa.binary())], ["block", "data"])

            for b in chunks(batches, "text"):
                held += list(shingle_sets(b.column("text"), width))
                if sum(map(len, held)) > HELD:
                    yield from flush()
            if held:
                yield from flush()

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, pieces in blocks_of(batches):
                both = [unpack(p, np.uint64, np.uint32) for p in pieces]
                h, at = np.unique(np.concatenate([x for x, _ in both]), return_inverse=True)
                n = np.bincount(at, np.concatenate([k for _, k in both])).astype(np.int64)
                yield pa.record_batch([pa.array(h[n > 2].astype(np.int64)), pa.array(n[n > 2])], ["h", "n"])

        parts = int(self.work.spark.conf.get("spark.sql.shuffle.partitions"))
        found = part.mapInArrow(tidy(count), "block int, data binary").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(tidy(total), "h long, n long")
        top = found.orderBy(F.desc("n"), "h").limit(MOST).toPandas()  # at most MOST numbers
        h, n = top["h"].to_numpy(np.int64).astype(np.uint64), top["n"].to_numpy(np.int64)
        return np.sort(h), np.sort(h[n * SAMPLE > HOT])

    # -- one pass over the texts ---------------------------------------------------------------------------
    def scan(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Documents (doc_id, n, entity), rows' sizes by range (entity, sizes), and the product's entries in blocks
        of columns."""
        width, percent, n_blocks = self.width, self.percent, self.n_blocks
        found = self.frequent()
        self.any_hot = len(found[1]) > 0
        shared = self.work.spark.sparkContext.broadcast(found)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (late, hot), seen = shared.value, set()
            held: list[tuple[np.ndarray, int, int]] = []  # prefix, name, size of the set
            docs: list[tuple[int | None, int, int]] = []
            sizes: dict[type, list[tuple[int, np.ndarray]]] = {np.uint8: [], np.uint32: []}

            def flush():
                for mark, kind in ((-2, np.uint8), (-3, np.uint32)):
                    if sizes[kind]:
                        data = np.array([x[0] for x in sizes[kind]], np.int64).tobytes() + b"".join(x[1].tobytes() for x in sizes[kind])
                        yield pa.record_batch([pa.array([mark], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])
                        sizes[kind].clear()
                if docs:
                    who = pack(np.array([d[0] or 0 for d in docs], np.int64), np.array([d[1] for d in docs], np.int64), np.array([d[2] for d in docs], np.int64), np.array([d[0] is None for d in docs], np.int8))
                    yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([who], pa.binary())], ["block", "data"])
                    docs.clear()
                if held:
                    n = [len(x[0]) for x in held]
                    h, e, s = np.concatenate([x[0] for x in held]), np.repeat(np.array([x[1] for x in held], np.int64), n), np.repeat(np.array([x[2] for x in held], np.uint32), n)
                    pos = np.concatenate([np.arange(k, dtype=np.uint32) for k in n])
                    held.clear()
                    if len(hot):
                        own = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                        if own.any():
                            yield pa.record_batch([pa.array([-4], pa.int32()), pa.array([pack(h[own], e[own], s[own], pos[own])], pa.binary())], ["block", "data"])
                            h, e, s, pos = (x[~own] for x in (h, e, s, pos))
                    for b, cols in by_block((h % np.uint64(n_blocks)).astype(np.int64), n_blocks, h, e, s, pos):
                        yield pa.record_batch([pa.array([b], pa.int32()), pa.array([pack(*cols)], pa.binary())], ["block", "data"])

            for b in chunks(batches, "text"):
                for doc, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text"), width)):
                    n = len(s)
                    name = entity(s) if n else 0
                    docs.append((doc, n, name))
                    if not n or name in seen:
                        continue
                    seen.add(name)
                    in_range = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=RANGES)
                    kind = np.uint8 if in_range.max() < 256 else np.uint32
                    sizes[kind].append((name, in_range.astype(kind)))
                    need = n - (percent * n + 99) // 100 + 1
                    if len(late):
                        at = np.searchsorted(late, s)
                        common = late[np.minimum(at, len(late) - 1)] == s
                        rare = s[~common]
                        s = rare[:need] if len(rare) >= need else np.concatenate([rare, s[common][: need - len(rare)]])
                    held.append((s[:need], name, n))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from flush()
            yield from flush()

        rows = self.work.table("pass", self.docs.mapInArrow(tidy(go), "block int, data binary"))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d in b.column("data").to_pylist():
                    doc, n, name, null = unpack(d, np.int64, np.int64, np.int64, np.int8)
                    yield pa.record_batch([pa.array(doc, mask=null.astype(bool)), pa.array(n), pa.array(name, mask=n == 0)], ["doc_id", "n", "entity"])

        def spread_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for mark, d in zip(b.column("block").to_pylist(), b.column("data").to_pylist()):
                    width = RANGES * (1 if mark == -2 else 4)
                    n = len(d) // (8 + width)
                    data = [d[8 * n + k * width : 8 * n + (k + 1) * width] for k in range(n)]
                    yield pa.record_batch([pa.array(np.frombuffer(d, np.int64, n)), pa.array(data, pa.binary())], ["entity", "sizes"])

        by_range = rows.filter("block IN (-2, -3)").mapInArrow(tidy(spread_sizes), "entity long, sizes binary")
        by_range = self.work.table("sizes", by_range.groupBy("entity").agg(F.first("sizes").alias("sizes")))
        docs = self.work.table("docs", rows.filter("block = -1").select("data").mapInArrow(tidy(spread), "doc_id long, n long, entity long"))
        return docs, by_range, rows.filter("block >= 0 OR block = -4")

    # -- the blocked product -------------------------------------------------------------------------------
    def multiply(self, entries: DataFrame) -> DataFrame:
        """Candidates: rows without a column are pairs (a, b); rows with one are a long column's members, with
        the pivots of their own and the next size class."""
        step, percent = self.step, self.percent
        hot, entries = entries.filter("block = -4"), entries.filter("block >= 0")

        names = ["col", "a", "b", "c", "cls", "n", "place"]

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, pieces in blocks_of(batches):
                cols = [unpack(p, np.uint64, np.int64, np.uint32, np.uint32) for p in pieces]
                h, e, z, pos = (np.concatenate(c) for c in zip(*cols))
                order = np.argsort(h)
                h, e, z, pos = h[order], e[order], z[order].astype(np.int64), pos[order].astype(np.int64)
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                size = np.diff(np.append(new, len(h)))
                pairs, members, known = [], [], {}
                for at, k in zip(new[size > 1].tolist(), size[size > 1].tolist()):
                    who, first = np.unique(e[at : at + k], return_index=True)
                    n, place, k = z[at : at + k][first], pos[at : at + k][first], len(who)
                    if k < 2:
                        continue
                    if k <= SHORT:
                        i, j = np.triu_indices(k, 1)
                        near = could(n[i], place[i], n[j], place[j], percent)
                        pairs.append(np.stack([who[i[near]], who[j[near]]]))
                        continue
                    turn = int(h[at] >> np.uint64(20)) & 3
                    mark = (who.tobytes(), turn)
                    if mark in known:  # the same rows with the same pivots: the best place of each stands for both
                        np.minimum(known[mark], place, out=known[mark])
                        continue
                    known[mark] = place
                    cls = np.minimum(255, (np.log(n) / step).astype(np.int64))
                    draw = mix(who.astype(np.uint64) + np.uint64(turn))
                    best = np.lexsort((draw, cls))
                    heads = best[np.concatenate([[True], cls[best][1:] != cls[best][:-1]])]
                    pivot = np.zeros(258, np.int64)
                    there = np.zeros(258, bool)
                    pivot[cls[heads]], there[cls[heads]] = who[heads], True
                    own, nxt, has = pivot[cls], pivot[cls + 1], there[cls + 1]
                    for other, ok in ((own, own != who), (nxt, has & (nxt != who))):
                        pairs.append(np.stack([np.minimum(who, other)[ok], np.maximum(who, other)[ok]]))
                    name = np.int64(np.uint64(h[at]).astype(np.int64))
                    members.append((np.full(k, name), who, own, nxt, has, cls, n, place))
                if pairs:
                    p = np.unique(np.concatenate(pairs, axis=1), axis=1) if sum(x.shape[1] for x in pairs) else np.zeros((2, 0), np.int64)
                    none = pa.nulls(p.shape[1], pa.int64())
                    yield pa.record_batch([none, pa.array(p[0]), pa.array(p[1]), none, none, none, none], names)
                for col, who, own, nxt, has, cls, n, place in members:
                    yield pa.record_batch([pa.array(col), pa.array(who), pa.array(own), pa.array(nxt, mask=~has), pa.array(cls), pa.array(n), pa.array(place)], names)

        parts = int(self.work.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = entries.repartition(parts, "block").sortWithinPartitions("block")
        found = rows.mapInArrow(tidy(product), ", ".join(f"{c} long" for c in names))
        return self.work.table("cand", found.unionByName(self._hot(hot, names)) if self.any_hot else found)

    def _hot(self, entries: DataFrame, names: list[str]) -> DataFrame:
        """Candidates of hot columns, whose rows no task has together: pivots come from a sum in each task, and columns
        with the same rows stand for each other."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d in b.column("data").to_pylist():
                    h, e, n, pos = unpack(d, np.uint64, np.int64, np.uint32, np.uint32)
                    yield pa.record_batch([pa.array(h.astype(np.int64)), pa.array(e), pa.array(n.astype(np.int64)), pa.array(pos.astype(np.int64))], ["col", "a", "n", "place"])

        rows = entries.select("data").mapInArrow(tidy(spread), "col long, a long, n long, place long")
        rows = self.work.table("hot", rows.groupBy("col", "a").agg(F.min("n").alias("n"), F.min("place").alias("place")))
        of = rows.groupBy(F.col("col").alias("own")).agg(F.bit_xor(F.xxhash64("a")).alias("x"), F.count("*").alias("k"))
        of = of.select("own", F.min("own").over(Window.partitionBy("x", "k", F.pmod("own", F.lit(4)))).alias("name"))
        rows = rows.join(small(of), F.col("col") == F.col("own")).groupBy(F.col("name").alias("col"), "a").agg(F.min("n").alias("n"), F.min("place").alias("place"))
        cls = F.least(F.lit(255), F.floor(F.log("n") / float(self.step))).cast("long")
        rows = self.work.table("hotrows", rows.withColumn("cls", cls))
        pivots = self.work.table("pivots", rows.groupBy("col", "cls").agg(F.min_by("a", F.xxhash64("a", "col")).alias("p")))
        own, nxt = (small(pivots.select(F.col("col").alias(f"{x}col"), (F.col("cls") - k).alias(f"{x}cls"), F.col("p").alias(x))) for x, k in (("b", 0), ("c", 1)))
        members = rows.join(own, (F.col("col") == F.col("bcol")) & (F.col("cls") == F.col("bcls"))).join(nxt, (F.col("col") == F.col("ccol")) & (F.col("cls") == F.col("ccls")), "left")
        members = self.work.table("hotmembers", members.select(*names))
        pairs = members.select("a", F.col("b").alias("p")).union(members.filter("c IS NOT NULL").select("a", F.col("c").alias("p"))).filter("a <> p").distinct()
        none = {c: F.lit(None).cast("long").alias(c) for c in names}
        pairs = pairs.select(*[{"a": F.least("a", "p").alias("a"), "b": F.greatest("a", "p").alias("b")}.get(c, none[c]) for c in names])
        return members.unionByName(pairs)

    # -- exact overlaps ------------------------------------------------------------------------------------
    def overlaps(self, name: str, docs: DataFrame, by_range: DataFrame, pairs: DataFrame) -> DataFrame:
        """a, b, na, nb, most, both for every pair: the bound of the overlap, and the overlap itself from whole sets
        where the bound lets the pair pass (else null)."""
        some = lambda p: p.select(F.col("a").alias("want")).union(p.select(F.col("b").alias("want"))).distinct()
        wanted = self.work.table(f"wanted{name}", some(pairs))
        part = by_range.join(small(wanted), F.col("entity") == F.col("want"), "left_semi")

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = lambda v: np.frombuffer(v.as_buffer(), np.uint8 if v.as_buffer().size == RANGES else np.uint32)
            for b in batches:
                out = []
                for x, y in zip(b.column("x"), b.column("y")):
                    x, y = read(x), read(y)
                    out.append((int(x.sum(dtype=np.int64)), int(y.sum(dtype=np.int64)), int(np.minimum(x, y).sum(dtype=np.int64))))
                cols = list(zip(*out)) or [(), (), ()]
                yield pa.record_batch([b.column("a"), b.column("b"), *[pa.array(c, pa.int64()) for c in cols]], ["a", "b", "na", "nb", "most"])

        bounded = self._beside(pairs.select("a", "b"), part, "sizes").mapInArrow(tidy(bound), "a long, b long, na long, nb long, most long")
        bounded = self.work.table(f"bound{name}", bounded)
        self.work.drop(f"wanted{name}")
        return self.measure(name, docs, bounded)

    def measure(self, name: str, docs: DataFrame, bounded: DataFrame) -> DataFrame:
        """The pairs with `both` where their bound lets them pass."""
        width, percent = self.width, self.percent
        some = lambda p: p.select(F.col("a").alias("want")).union(p.select(F.col("b").alias("want"))).distinct()
        passed = bounded.filter(f"100 * most >= {percent} * (na + nb - most)").select("a", "b")
        exact = self._exact(name, docs, passed, some(passed), width).select(F.col("a").alias("x"), F.col("b").alias("y"), "both")
        done = bounded.join(exact, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left").drop("x", "y")
        done = self.work.table(f"measured{name}", done)
        self.release()
        return done

    def _beside(self, pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        """a, b with a's and b's value as x and y. A row with many pairs is a skewed join, which Spark splits."""
        rows = pairs.join(table.select(F.col("entity").alias("b"), F.col(column).alias("y")), "b")
        return rows.join(table.select(F.col("entity").alias("a"), F.col(column).alias("x")), "a").select("a", "b", "x", "y")

    def _exact(self, name: str, docs: DataFrame, pairs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
        """a, b, both, from the whole sets of just the rows that occur in the pairs."""
        holder = docs.filter("entity IS NOT NULL").groupBy("entity").agg(F.min("doc_id").alias("at")).join(wanted, F.col("entity") == F.col("want"), "left_semi")
        holder = small(holder.select("at").distinct())

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, "text"):
                got = {entity(s): s.tobytes() for s in shingle_sets(b.column("text"), width) if len(s)}
                yield pa.record_batch([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.binary())], ["entity", "members"])

        texts = self.docs.join(holder, F.col("doc_id").eqNullSafe(F.col("at")), "left_semi").select("text")
        whole = self.work.table(f"sets{name}", texts.mapInArrow(tidy(sets), "entity long, members binary").groupBy("entity").agg(F.first("members").alias("members")))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for x, y in zip(b.column("x"), b.column("y")):
                    m = np.sort(np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)]))
                    out.append(int((m[1:] == m[:-1]).sum()))
                yield pa.record_batch([b.column("a"), b.column("b"), pa.array(out, pa.int64())], ["a", "b", "both"])

        done = self.work.table(f"pairs{name}", self._beside(pairs, whole, "members").mapInArrow(tidy(count), "a long, b long, both long"))
        self.work.drop(f"sets{name}")
        return done

    def links(self, measured: DataFrame) -> DataFrame:
        """Union sizes are na + nb - both: whole numbers throughout."""
        return measured.filter(f"100 * both >= {self.percent} * (na + nb - both)").select(F.col("a").alias("u"), F.col("b").alias("v"))

    # -- what pivots left open -----------------------------------------------------------------------------
    def open_pairs(self, members: DataFrame, by_range: DataFrame, measured: DataFrame, found: DataFrame, turn: int | None = None) -> DataFrame | None:
        """a, b, na, nb and most of pairs of long columns that are in different components and that no bound rules
        out: all of them, or in a numbered round one for each row outside the largest component. None if no column
        has rows of different components."""
        slack, percent = 1 - self.percent / 100 + 1e-9, self.percent
        named = members.join(found, F.col("a") == F.col("node"), "left").drop("node").withColumn("component", F.coalesce("component", "a"))
        # of each column: its rows, and the component that most of them are in
        kinds = named.groupBy("col", "component").agg(F.count("*").alias("k"))
        mixed = kinds.groupBy("col").agg(F.max_by("component", F.struct("k", "component")).alias("most"), F.sum("k").alias("k"), F.count("*").alias("kinds")).filter("kinds > 1").drop("kinds")
        left = self.work.table(f"mixed{turn}", named.join(small(mixed), "col"))
        if not left.limit(1).count():
            return None
        vectors = by_range.join(small(left.select(F.col("a").alias("want")).distinct()), F.col("entity") == F.col("want"), "left_semi")
        # a pair without an exact overlap has a distance between what its bound allows and 1
        far = lambda c: 1 - c / (F.col("na") + F.col("nb") - c)
        near = measured.select("a", "b", far(F.coalesce("both", "most")).alias("lo"), F.when(F.col("both").isNull(), F.lit(1.0)).otherwise(far(F.col("both"))).alias("hi"))
        near = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "lo", "hi"))
        own = near.select("a", "b", F.col("lo").alias("d_own"), F.col("hi").alias("d_own_hi"))
        nxt = near.select("a", F.col("b").alias("c"), F.col("lo").alias("d_next"), F.col("hi").alias("d_next_hi"))
        left = left.join(own, ["a", "b"], "left").join(nxt, ["a", "c"], "left")
        for name, other in (("d_own", "b"), ("d_next", "c")):
            same = F.coalesce(F.col("a") == F.col(other), F.lit(False))
            left = left.withColumn(name, F.when(same, F.lit(0.0)).otherwise(F.coalesce(name, F.lit(0.0))))
            left = left.withColumn(f"{name}_hi", F.when(same, F.lit(0.0)).otherwise(F.coalesce(f"{name}_hi", F.lit(1.0))))

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def solve(t: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
                mine, rest = t["side"] == 1, t["side"] == 0
                rng = np.random.default_rng([turn or 0, len(t["a"]), int(t["a"][0]) & 0x7FFFFFFF])
                for c in np.unique(t["cls"][mine]):
                    # pairs that have a pivot in common: of the row's class, of the next, of the one before
                    for other, key, their in ((c, "d_own", "d_own"), (c + 1, "d_next", "d_own"), (c - 1, "d_own", "d_next")):
                        these, those = mine & (t["cls"] == c), rest & (t["cls"] == other)
                        x, lx, hx, gx, nx, px, vx = (v[these] for v in (t["a"], t[key], t[key + "_hi"], t["component"], t["n"], t["place"], t["sizes"]))
                        y, ly, hy, gy, ny, py, vy = (v[those] for v in (t["a"], t[their], t[their + "_hi"], t["component"], t["n"], t["place"], t["sizes"]))
                        order = np.argsort(hy)
                        y, ly, hy, gy, ny, py, vy = (v[order] for v in (y, ly, hy, gy, ny, py, vy))
                        low = np.searchsorted(hy, lx - slack)
                        for i, k in enumerate(low):
                            sel = np.flatnonzero((gy[k:] != gx[i]) & (ly[k:] <= hx[i] + slack) & could(nx[i], px[i], ny[k:], py[k:], percent)) + k
                            if turn is not None and len(sel) > TRIES:
                                sel = sel[rng.integers(len(sel), size=TRIES)]
                            most = most_shared(vx[i], vy[sel])
                            near = 100 * most >= percent * (nx[i] + ny[sel] - most)
                            sel, most = sel[near], most[near]
                            if len(sel) and turn is not None:
                                one = rng.integers(len(sel))
                                sel, most = sel[[one]], most[[one]]
                            if len(sel):
                                first = x[i] < y[sel]
                                yield np.where(first, x[i], y[sel]), np.where(first, y[sel], x[i]), np.where(first, nx[i], ny[sel]), np.where(first, ny[sel], nx[i]), most

            def column(held: list[dict]) -> Iterator[tuple[np.ndarray, ...]]:
                t = {n: np.concatenate([h[n] for h in held]) for n in names}
                yield from solve(t | {"sizes": by_sizes([v for h in held for v in h["sizes"]])})

            def columns() -> Iterator[tuple[np.ndarray, ...]]:
                now, held = None, []
                for b in batches:
                    col, tile = np.asarray(b.column("col")), np.asarray(b.column("tile"))
                    cut = np.flatnonzero((col[1:] != col[:-1]) | (tile[1:] != tile[:-1])) + 1
                    for s, e in zip([0, *cut], [*cut, b.num_rows]):
                        if s == e:
                            continue
                        if (col[s], tile[s]) != now and held:
                            yield from column(held)
                            held = []
                        now = col[s], tile[s]
                        part = b.slice(s, e - s)
                        held.append({n: part.column(n).to_numpy(zero_copy_only=False).astype(float if n[0] == "d" else np.int64) for n in names} | {"sizes": part.column("sizes").to_pylist()})
                if held:
                    yield from column(held)

            def once(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
                t = np.unique(np.concatenate([np.stack(r) for r in rows], axis=1), axis=1)
                return pa.record_batch([pa.array(c) for c in t], ["a", "b", "na", "nb", "most"])

            names = ["a", "side", "cls", "n", "place", "d_own", "d_own_hi", "d_next", "d_next_hi", "component"]
            out, n = [], 0
            for r in columns():
                out.append(r)
                n += len(r[0])
                if n > HELD:
                    yield once(out)
                    out, n = [], 0
            if out:
                yield once(out)

        parts = int(self.work.spark.conf.get("spark.sql.shuffle.partitions"))
        # a row outside the column's largest component meets all rows of the column, TILE of them in a task
        rows = left.join(vectors, F.col("a") == F.col("entity")).withColumn("tiles", F.ceil(F.col("k") / TILE).cast("int"))
        those = rows.withColumn("tile", F.pmod(F.xxhash64("a"), F.col("tiles")).cast("int")).withColumn("side", F.lit(0))
        these = rows.filter("component <> most").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("side", F.lit(1))
        picked = ["col", "tile", "a", "side", "cls", "n", "place", "d_own", "d_own_hi", "d_next", "d_next_hi", "component", "sizes"]
        rows = those.select(*picked).union(these.select(*picked)).repartition(parts, "col", "tile").sortWithinPartitions("col", "tile")
        new = rows.mapInArrow(tidy(pairs), "a long, b long, na long, nb long, most long").distinct()
        return new.join(measured.select("a", "b"), ["a", "b"], "left_anti")

    def run(self) -> DataFrame:
        docs, by_range, entries = self.scan()
        cand = self.multiply(entries)
        self.work.drop("pass")
        self.release()
        pairs = self.work.table("first", cand.filter("col IS NULL").select("a", "b").distinct())
        measured = self.overlaps("1", docs, by_range, pairs)
        linked = self.links(measured)
        found = self.work.table("found1", components(self.work, linked))
        members = cand.filter("col IS NOT NULL")
        known = measured
        for turn in [*range(ROUNDS), None]:
            pairs = self.open_pairs(members, by_range, known, found, turn)
            if pairs is None:
                break
            more = self.work.table(f"open{turn}", pairs)
            if not more.limit(1).count():
                continue
            measured = self.measure(f"-{turn}", docs, more)
            known = known.union(measured)
            fresh = self.links(measured)
            if fresh.limit(1).count():
                # components so far are links too
                linked = fresh.union(found.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")))
                found = self.work.table(f"found-{turn}", components(self.work, linked))
        ids = docs.filter("entity IS NOT NULL").groupBy("entity").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
        ids = ids.join(found, F.col("entity") == F.col("node"), "left").withColumn("root", F.coalesce("component", "entity"))
        low = ids.groupBy("root").agg(F.min("low").alias("component_id"))
        named = ids.join(low, "root").select(F.col("entity").alias("name"), "component_id")
        out = docs.join(named, F.col("entity") == F.col("name"), "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, work: Work, width: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, for every row.

    Two texts link where their sets of `width`-word shingles have a Jaccard similarity of percent / 100 or more.
    A-Z is lower-cased. Null texts and texts without words have no shingles, link with nothing and are their own
    component. Repeated rows link with each other. Null ids are never a component's name unless it has no other.
    Other columns are not read.
    """
    return Join(docs, work, width, percent, id_column, text_column).run()


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's shingle count and component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Work(spark, "ngrams"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, CASE WHEN len(w) >= 4 THEN hash(w[i], w[i + 1], w[i + 2], w[i + 3]) ELSE hash(array_to_string(w, ' ')) END AS h FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
e AS MATERIALIZED (SELECT r, n, min(r) OVER (PARTITION BY n, x, y) AS e FROM (SELECT r, count(*) AS n, bit_xor(h) AS x, sum(h) AS y FROM s GROUP BY r)),
x AS MATERIALIZED (SELECT e, n, h FROM e JOIN s USING (r) WHERE r = e),
p AS (SELECT a.e AS a, b.e AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x AS a JOIN x AS b ON a.h = b.h AND a.e < b.e AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT DISTINCT a, a AS b FROM u UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a),
m AS (SELECT c.a AS e, min(doc_id) AS low FROM c JOIN e ON e.e = c.b JOIN d USING (r) GROUP BY 1),
o AS (SELECT e, min(doc_id) AS low FROM e JOIN d USING (r) GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(m.low, o.low, doc_id) AS component_id
FROM d LEFT JOIN e USING (r) LEFT JOIN m ON m.e = e.e LEFT JOIN o ON o.e = e.e
"""
