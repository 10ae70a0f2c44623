"""Exact Jaccard join of word shingles as a metric-space join.

Jaccard distance is a metric, so what a document's distance to a pivot says about its distance to any other document is exact.

1. Sets.  Every whole text becomes a set of 64-bit hashes of its shingles and a 128-bit signature of the set; equal sets are
   one point of the space from here on.
2. Isolated points.  A set whose partners can differ in at most k - 1 of its shingles has no partner if k of them occur in no
   other set.  Hashes are dealt by range, packed, sorted and counted within a task first; those that occur once are counted
   away.  What is left of the corpus ("crowded" sets) keeps its shared hashes, which is all that intersections need.
3. Cells.  Shingles have one order: rare ones first.  Two crowded sets within the radius share one of their k rarest shingles,
   and the first one they share opens the cell in which they meet.  A shingle that comes late in a set's order leaves room for
   small partners only, so members for whom every other member is too large leave the cell.
4. Pivots.  In each cell pivots are drawn: the member with the least share of shingles of its own, which lies in the middle of
   a group of near copies, and in large cells others by hash.  Every member's exact distance to them is computed once per
   pair.  Members within the radius of a pivot are linked to it; members of one component need no further comparison.
5. Regions.  In a cell that holds several components, members go to the nearest pivot's region, and by the triangle
   inequality also to each region whose pivot is at most two radii further away (the boundary window).  Regions are cells of
   the next level, with pivots of their own, until they have CELL members at most or no longer shrink.  Then they are joined
   within the windows |d(x, p) - d(y, p)| <= radius.  Members outside a cell's largest component meet all members; those
   inside it are never compared with each other.
6. Sketches.  The symmetric difference is a metric, too, and folding a set's hashes into parities of SKETCH * 64 counters never
   makes it larger.  Pairs whose parities already differ in more places than the radius allows are left out in the join itself.

No candidate is dropped at any level: each step only leaves out pairs that cannot be within the radius, or whose documents
already are in one component.  What no pivot can tell apart is compared: sets that all lie between one and two radii from each
other and share most of their rare shingles cost a sketch comparison a pair, dealt over many tasks and without a row of output.
"""

from collections.abc import Callable, Iterable, Iterator

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.exact_dedup import FAN_IN, n_levels
from plenum.llm.scratch import KEY, ROW, emitted, key_of, over_cores, spread, stored

WIDTH = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
RADIUS = 1 - PERCENT / 100
SLACK = 1e-9
#: Hashes that a map task holds before it deals them out, and that a range of hashes has on average.
CHUNK = 1_500_000
#: Members up to which a region is joined; a larger one is split by so many pivots, as long as that leaves at most this share
#: of the members in a region.
CELL = 32
PIVOTS = 4
SHRUNK = 0.75
#: Members that a task compares with a region's members at a time.
DEALT_NATIVES = 256
#: 64-bit words of a set's parity sketch.
SKETCH = 32

#: Words whose hashes a Python worker keeps, and bytes of text that are shingled at a time.
KEPT_WORDS = 150_000
STEP_BYTES = 1 << 20


_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    """A number per word, and by it one hash for each place that a word can have in a shingle."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []
        self.hashes = np.empty((0, WIDTH), np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def of(self, words: list[list[bytes]], total: int) -> np.ndarray:
        """WIDTH hashes for each of all the words, one after the other."""
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, total)
        if self.new:
            new = np.fromiter(map(xxhash.xxh64_intdigest, self.new), np.uint64, len(self.new))
            self.hashes, self.new = np.concatenate([self.hashes, _mixed(new[:, None] + _PLACES) * _PLACES]), []
        found = self.hashes[numbers]
        if len(self) > KEPT_WORDS:
            self.clear()
            self.hashes = np.empty((0, WIDTH), np.uint64)
        return found


_words = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each whole text the sorted distinct hashes of its WIDTH-word shingles; fewer words are one shingle, none is no shingle."""
    held: list[list[bytes]] = []
    size = 0

    def close() -> Iterator[np.ndarray]:
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        total = int(lengths.sum())
        hashes = _words.of(held, total)
        rolled = _mixed(reduce(np.add, (hashes[k : total - WIDTH + 1 + k, k] for k in range(WIDTH)))) if total >= WIDTH else None
        for words, start in zip(held, (np.cumsum(lengths) - lengths).tolist(), strict=True):
            n = len(words)
            if n >= WIDTH:
                yield _distinct(rolled[start : start + n - WIDTH + 1])
            elif n:
                yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
            else:
                yield np.empty(0, np.uint64)

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        held.append(raw.split())
        size += len(raw)
        if size >= STEP_BYTES:
            yield from close()
            held, size = [], 0
    if held:
        yield from close()


def shingles(text: str | None) -> np.ndarray:
    return next(shingle_sets([text]))


def signature(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def n_prefix(n: int) -> int:
    """So many of a set's n shingles cannot all be missing from a set within the radius."""
    return n - (PERCENT * n + 99) // 100 + 1


# ---- 1. and 2. sets, isolated and crowded ---------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length; ascending unsigned 64-bit ones as differences, all with their bytes in planes."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for a in arrays:
        if a.dtype == np.uint64:
            a = np.diff(a, prepend=np.uint64(0))
        out.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(raw: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n)
        out.append(np.cumsum(a, dtype=np.uint64) if kind is np.uint64 else a)
        at += n * size
    return out


#: Kinds of payload: hashes of a range; a chunk's sets; its documents; its hashes that several of its own sets have.
HASHES, SETS, DOCS, SHARED = range(4)
DEALT = "range int, chunk long, kind int, payload binary"
#: A word beside a hash is the number of the set that has it, or with this bit the number of the chunk's sets that have it.
COUNT = np.uint32(1 << 31)
DOC = pa.schema([("doc_id", pa.int64()), (ROW, pa.int64()), *((k, pa.int64()) for k in KEY), ("n", pa.int64()), ("sig", pa.binary())])
FOUND = f"doc_id long, {ROW} long, {KEY[0]} long, {KEY[1]} long, n long, sig binary, alone long, shared array<long>, prefix array<long>, sketch array<long>"


def _dealt(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents (doc_id, ROW, KEY, text) shingled and dealt as payloads over 2 ** bits ranges of hashes, CHUNK hashes at a time."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, size = TaskContext.get().partitionId(), 0, 0
        seen: set[bytes] = set()
        held: list[tuple[bytes, np.ndarray]] = []
        docs: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            nonlocal made, held, docs, size
            chunk, made = (part << 32) + made, made + 1
            sizes = [len(h) for _, h in held]
            hashes = np.concatenate([np.empty(0, np.uint64), *(h for _, h in held)])
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), sizes)
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            about = b"".join(s + n.to_bytes(8, "little") for (s, _), n in zip(held, sizes, strict=True))
            held, docs_, docs, size = [], pa.Table.from_batches(docs, DOC), [], 0
            first = np.concatenate(([True], hashes[1:] != hashes[:-1]))[: len(hashes)]
            starts = np.flatnonzero(first)
            counts = np.diff(starts, append=len(hashes))
            several = np.repeat(counts > 1, counts)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, DOC) as writer:
                writer.write_table(docs_)
            small = zstandard.ZstdCompressor(level=1)
            home = chunk % (1 << bits)
            out = [(home, SETS, small.compress(about)), (home, DOCS, small.compress(sink.getvalue())), (home, SHARED, _pack(hashes[several], owner[several]))]
            # A hash that several sets here have travels once, with their number.
            word = np.where(counts > 1, counts.astype(np.uint32) | COUNT, owner[starts])
            hashes = hashes[starts]
            edges = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            for r, (h, w) in enumerate(zip(np.split(hashes, edges), np.split(word, edges), strict=True)):
                if len(h):
                    out.append((r, HASHES, _pack(h, w)))
            ranges, kinds, payloads = zip(*out, strict=True)
            return pa.RecordBatch.from_pydict({"range": pa.array(ranges, pa.int32()), "chunk": pa.array([chunk] * len(out), pa.int64()), "kind": pa.array(kinds, pa.int32()), "payload": pa.array(payloads, pa.binary())})

        def read(batch: pa.RecordBatch, begin: int, n: list[int], sigs: list[bytes | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(c.slice(begin, len(n)) for c in batch.columns[:4]), pa.array(n, pa.int64()), pa.array(sigs, pa.binary())], schema=DOC)

        for batch in batches:
            begin, n, sigs = 0, [], []
            for h in shingle_sets(t.as_py() for t in batch.column(4)):
                n.append(len(h))
                sigs.append(signature(h) if len(h) else None)
                size += 1
                if len(h) and sigs[-1] not in seen:
                    seen.add(sigs[-1])
                    held.append((sigs[-1], h))
                    size += len(h)
                if size >= CHUNK:
                    docs.append(read(batch, begin, n, sigs))
                    begin, n, sigs = begin + len(n), [], []
                    yield close()
            docs.append(read(batch, begin, n, sigs))
        if docs:
            yield close()

    return deal


def _common(table: pa.Table) -> pa.Table:
    """Of a range of hashes those that two sets or more have, back to the chunks they came from, with the number of sets."""
    chunks, kinds, payloads = (table.column(c).to_pylist() for c in ("chunk", "kind", "payload"))
    out = [(c, k, p) for c, k, p in zip(chunks, kinds, payloads, strict=True) if k != HASHES]
    parts = [(c, *_unpack(p, np.uint64, np.uint32)) for c, k, p in zip(chunks, kinds, payloads, strict=True) if k == HASHES]
    if parts:
        _, at = np.unique(np.concatenate([h for _, h, _ in parts]), return_inverse=True)
        words = np.concatenate([w for _, _, w in parts])
        sets = np.bincount(at, np.where(words & COUNT, words & ~COUNT, 1))
        sets = np.minimum(sets, np.iinfo(np.uint32).max).astype(np.uint32)[at]
        start = 0
        for c, h, w in parts:
            n = sets[start : start + len(h)]
            start += len(h)
            if (on := n > 1).any():
                out.append((c, HASHES, _pack(h[on], w[on], n[on])))
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([x[1] for x in out], pa.int32()), "payload": pa.array([x[2] for x in out], pa.binary())})


def _gathered(table: pa.Table) -> pa.Table:
    """A chunk's documents, and its sets that are not isolated, with their shared hashes and the rarest of them."""
    kinds, payloads = (table.column(c).to_pylist() for c in ("kind", "payload"))
    opened = zstandard.ZstdDecompressor()
    docs = pa.ipc.open_stream(opened.decompress(payloads[kinds.index(DOCS)])).read_all()
    about = np.frombuffer(opened.decompress(payloads[kinds.index(SETS)]), np.uint8).reshape(-1, 24)
    sizes = np.ascontiguousarray(about[:, 16:]).view(np.int64).reshape(-1)
    back = [_unpack(p, np.uint64, np.uint32, np.uint32) for p, k in zip(payloads, kinds, strict=True) if k == HASHES]
    hashes, words, counts = (np.concatenate([np.empty(0, kind), *(x[i] for x in back)]) for i, kind in enumerate((np.uint64, np.uint32, np.uint32)))
    several = (words & COUNT) > 0
    own, owner = _unpack(payloads[kinds.index(SHARED)], np.uint64, np.uint32)
    known = np.argsort(hashes[several], kind="stable")
    own_counts = counts[several][known][np.searchsorted(hashes[several][known], own)] if len(own) else np.empty(0, np.uint32)
    hashes, owner, counts = np.concatenate([hashes[~several], own]), np.concatenate([words[~several], owner]), np.concatenate([counts[~several], own_counts])
    order = np.lexsort((hashes, counts, owner))
    hashes, owner = hashes[order], owner[order]
    edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
    rows = []
    for i, size in enumerate(sizes.tolist()):
        mine = hashes[edges[i] : edges[i + 1]]
        alone = size - len(mine)
        left = n_prefix(size) - alone
        if left > 0 and len(mine):
            odd = np.bincount((_mixed(mine) % np.uint64(SKETCH * 64)).astype(np.int64), minlength=SKETCH * 64) & 1
            rows.append((size, about[i, :16].tobytes(), alone, mine.view(np.int64), mine[:left].view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)))
    n, sig, alone, shared, prefix, sketch = zip(*rows, strict=True) if rows else [()] * 6
    lists = pa.list_(pa.int64())
    kinds = {"n": pa.int64(), "sig": pa.binary(), "alone": pa.int64(), "shared": lists, "prefix": lists, "sketch": lists}
    sets = pa.table({k: pa.array(v, kind) for (k, kind), v in zip(kinds.items(), (n, sig, alone, shared, prefix, sketch), strict=True)})
    return pa.concat_tables([docs, sets], promote_options="default").select([x.split()[0] for x in FOUND.split(", ")])


def _sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row per document: doc_id, ROW, KEY, n, sig (null for the empty set); and the crowded sets, once each."""
    spark = rows.sparkSession
    words = (rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // 6  # about; only deals the hashes
    bits = max(1, (max(int(spark.conf.get("spark.sql.shuffle.partitions")), words // CHUNK) - 1).bit_length())
    keys = [F.col(k) if k in rows.columns else F.lit(None).cast("long").alias(k) for k in KEY]
    dealt = rows.select(F.col("doc_id").cast("long").alias("doc_id"), ROW, *keys, "text").mapInArrow(_dealt(bits), DEALT)
    back = dealt.groupBy("range").applyInArrow(_common, "chunk long, kind int, payload binary")
    found = stored(back.groupBy("chunk").applyInArrow(_gathered, FOUND), "found")
    docs = found.filter(F.col(ROW).isNotNull()).select("doc_id", ROW, *KEY, "n", "sig")
    crowded = found.filter(F.col(ROW).isNull()).select("sig", "n", "alone", "shared", "prefix", "sketch")
    return docs, stored(crowded.dropDuplicates(["sig"]), "crowded")


# ---- 3. to 5. cells, pivots, regions --------------------------------------------------------------------------------------


def _run(sig: str, sets: DataFrame) -> Column:
    """Deals the rows of a key that very many sets have over several."""
    return F.pmod(F.xxhash64(sig), F.lit(FAN_IN ** n_levels(sets))).alias("run")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (sig, other) with ``distance`` and ``linked``, from their sets."""
    x = sets.select("sig", F.col("n").alias("n1"), F.col("shared").alias("s1"))
    y = sets.select(F.col("sig").alias("other"), F.col("n").alias("n2"), F.col("shared").alias("s2"))
    both = F.size(F.array_intersect("s1", "s2"))
    out = pairs.join(x, "sig").join(y, "other").select("sig", "other", both.alias("both"), (F.col("n1") + F.col("n2") - both).alias("either"))
    return stored(out.select("sig", "other", (1 - F.col("both") / F.col("either")).alias("distance"), (100 * F.col("both") >= PERCENT * F.col("either")).alias("linked")), "distances")


def _named(edges: DataFrame, labels: DataFrame, end: str) -> DataFrame:
    """Edges (sig, other, run) with the label of one end in its place, if it has one; an end may have very many edges."""
    known = labels.select(F.col("sig").alias(end), F.col("comp").alias("named"))
    to = edges.select("run", end).distinct().join(known, end, "left")
    return edges.join(to, ["run", end]).withColumn(end, F.coalesce("named", end)).drop("named")


def _components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``labels`` (sig, comp, run) after more links (sig, other), comp the least sig that links lead to; sigs without a link are not in it.

    Each round every point takes its least neighbour, trees of these become one point each, and links between the trees' least
    points go on: a link meets the labels once at each end, and what is within one tree or was one component before is gone.
    """

    def between(edges: DataFrame, names: DataFrame | None) -> DataFrame:
        for end in ("sig", "other") if names is not None else ():
            edges = _named(edges, names, end)
        ends = edges.filter("sig != other").select(F.least("sig", "other").alias("sig"), F.greatest("sig", "other").alias("other"))
        return stored(ends.distinct().withColumn("run", run("sig", "other")), "edges")

    run = lambda *of: F.pmod(F.xxhash64(*of), F.lit(FAN_IN ** n_levels(links)))
    edges, first = between(links.select("sig", "other", run("sig", "other").alias("run")), labels), True
    if labels is None:
        labels = edges.limit(0).select("sig", F.col("sig").alias("comp"), "run")
    while not edges.isEmpty():
        ends = edges.select("sig", "other").union(edges.select(F.col("other").alias("sig"), F.col("sig").alias("other")))
        trees = ends.groupBy("sig").agg(F.least("sig", F.min("other")).alias("comp")).withColumn("run", run("sig"))
        trees, moved = stored(trees, "trees"), True
        while moved:
            jumped = spread(trees, trees.select(F.col("sig").alias("comp"), F.col("comp").alias("next")), ["comp"])
            jumped = stored(jumped.select("sig", F.col("next").alias("comp"), "run", (F.col("comp") != F.col("next")).alias("moved")), "trees")
            trees, moved = jumped.drop("moved"), not jumped.filter("moved").isEmpty()
        names = trees.select(F.col("sig").alias("comp"), F.col("comp").alias("named"))
        to = labels.select("run", "comp").distinct().join(names, "comp", "left")
        older = labels.join(to, ["run", "comp"]).select("sig", F.coalesce("named", "comp").alias("comp"), "run")
        # A point of a later round is a label already.
        labels = stored(older.unionByName(trees.join(labels.select("sig"), "sig", "left_anti")) if first else older, "labels")
        edges, first = between(edges, trees), False
    return labels


def _first_cells(sets: DataFrame) -> DataFrame:
    """A cell per rare shingle that two sets or more have, with the sets that may share it first; of cells with the same members, one.

    ``reach`` is the number of shingles up to which a set of the cell can be a partner, given that none of the ``pos`` shingles
    before this one is shared.
    """
    placed = sets.select("sig", "n", "alone", _run("sig", sets), F.posexplode("prefix").alias("at", "cell")).withColumn("pos", F.col("alone") + F.col("at"))
    reach = F.floor(((100 + PERCENT) * (F.col("n") - F.col("pos")) - PERCENT * F.col("n")) / PERCENT)
    placed = stored(placed.select("cell", "sig", "n", "alone", "run", "pos", reach.alias("reach")), "cells")
    least = placed.groupBy("cell").agg(F.min("n").alias("least"), F.count("*").alias("k")).filter("k > 1").select("cell", "least")
    cells = stored(spread(placed, least, ["cell"]).filter("reach >= least").drop("least"), "cells")
    marks = [F.bit_xor(F.xxhash64("sig", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    members = cells.groupBy("cell").agg(*marks, F.count("*").alias("members"), F.sum("pos").alias("place")).filter("members > 1")
    # The first in the order: there the pairs of these members that share none before it meet with the most reach.
    chosen = members.groupBy("m1", "m2", "members").agg(F.min_by("cell", "place").alias("cell")).select("cell", "members")
    cells = spread(cells, chosen, ["cell"]).drop("pos")
    return stored(cells.withColumns({"root": F.col("cell"), "native": F.lit(True), "main": F.lit(False)}), "cells")


def _linked(sets: DataFrame) -> DataFrame:
    """Labels (sig, comp, run): the components of all pairs of ``sets`` within the radius."""
    cells, known, links, labels, level = _first_cells(sets), None, None, None, 0
    while True:
        mark = lambda k: F.xxhash64("sig", F.lit(level), F.lit(k))  # noqa: B023, E731
        drawn = [F.min(F.when(F.col("native"), F.struct((F.col("alone") / F.col("n")).alias("apart"), mark(0).alias("mark"), "sig"))).getField("sig").alias("p0")]
        drawn += [F.min(F.when(F.col("native"), F.struct(mark(k).alias("mark"), "sig"))).getField("sig").alias(f"p{k}") for k in range(1, PIVOTS)]
        several = F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))
        pivots = cells.groupBy("cell").agg(*drawn, F.first("members").alias("k")).select("cell", F.when(F.col("k") > CELL, several).otherwise(F.array("p0")).alias("pivots"))
        starred = spread(cells, pivots, ["cell"]).withColumn("pivot", F.explode("pivots")).drop("pivots")
        starred = stored(starred.withColumn("a", F.least("sig", "pivot")).withColumn("b", F.greatest("sig", "pivot")), "starred")
        pairs = starred.filter("a != b").select(F.col("a").alias("sig"), F.col("b").alias("other")).distinct()
        new = _verified(pairs if known is None else pairs.join(known, ["sig", "other"], "left_anti"), sets)
        known = new if known is None else known.unionByName(new)
        found = new.filter("linked").select("sig", "other")
        links = found if links is None else links.unionByName(found)
        far = starred.join(known.select(F.col("sig").alias("a"), F.col("other").alias("b"), "distance"), ["a", "b"], "left")
        far = far.withColumn("distance", F.coalesce("distance", F.lit(0.0))).drop("a", "b")  # none: the pivot itself
        # Each point's nearest pivot's region, and the regions whose window it lies in.
        nearest = far.groupBy("cell", "sig").agg(F.min(F.struct("distance", "pivot")).alias("nearest"))
        regions = far.join(nearest, ["cell", "sig"]).filter(F.col("distance") <= F.col("nearest.distance") + 2 * RADIUS + SLACK)
        native = F.col("native") & (F.col("pivot") == F.col("nearest.pivot"))
        regions = regions.select(F.xxhash64("cell", "pivot").alias("cell"), F.col("members").alias("was"), "root", "main", "sig", "n", "alone", "reach", "run", native.alias("native"), "distance")
        labels = _components(links, labels)
        cells = _open(regions, labels, level == 0)
        is_leaf = (F.col("members") <= CELL) | (F.col("members") > SHRUNK * F.col("was"))
        links = _leaf(cells.filter(is_leaf), sets).filter("linked").select("sig", "other")
        cells = cells.filter(~is_leaf).drop("was", "distance", "comp", "natives")
        if cells.isEmpty():
            return _components(links, labels)
        level += 1


def _open(cells: DataFrame, labels: DataFrame, first: bool) -> DataFrame:
    """Cells with a native member and another of another component, with the numbers of members and natives.

    After the first level a root cell's largest component is ``main`` for good: whatever other member links to one of it is a
    native of some region, where that one is a member, too.  So members of it are no longer natives.
    """
    cells = stored(cells.join(labels.select("sig", "comp"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig")), "regions")
    if first:
        largest = cells.filter("native").groupBy("root", "comp").agg(F.count("*").alias("k")).groupBy("root").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"))
        cells = spread(cells, largest, ["root"]).withColumn("main", F.col("comp") == F.col("largest")).withColumn("native", F.col("native") & ~F.col("main")).drop("largest")
    counted = cells.groupBy("cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("members"), F.count_if("native").alias("natives"))
    return stored(spread(cells, counted.filter("a != b and natives > 0").select("cell", "members", "natives"), ["cell"]), "open")


def _leaf(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified pairs of a native and another member of other components, of fitting sizes and places, within the window of the
    cell's pivot and by sketch.  Natives are dealt, DEALT_NATIVES at a time, and each lot meets all members.
    """
    words = [F.get("sketch", k).alias(f"w{k}") for k in range(SKETCH)]
    lots = F.ceil(F.col("natives") / DEALT_NATIVES)
    sketched = sets.select("sig", *words)
    columns = ["cell", "sig", "n", "alone", "reach", "comp", "distance"]
    left = cells.filter("native").select(*columns, F.pmod(F.xxhash64("sig"), lots).alias("lot")).join(sketched, "sig")
    right = cells.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), lots - 1)).alias("lot")).join(sketched, "sig")
    right = right.select("cell", "lot", *[F.col(c).alias(f"{c}_") for c in right.columns if c not in ("cell", "lot")])
    differ = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"w{k}_"))) for k in range(SKETCH)), F.col("alone") + F.col("alone_"))
    fits = (F.col("n_") <= F.col("reach")) & (F.col("n") <= F.col("reach_")) & (F.abs(F.col("distance") - F.col("distance_")) <= RADIUS + SLACK)
    near = (100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("n") + F.col("n_"))
    pairs = left.join(right, ["cell", "lot"]).filter((F.col("comp") != F.col("comp_")) & fits & near)
    return _verified(pairs.select(F.least("sig", "sig_").alias("sig"), F.greatest("sig", "sig_").alias("other")).distinct(), sets)


def _classes(rows: DataFrame) -> DataFrame:
    """A row per row: doc_id, ROW, KEY, n_shingles, component_id, is_first (one row of each component)."""
    docs, sets = _sets(rows)
    docs = docs.withColumn("run", _run(ROW, rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col(ROW).alias("row"))).alias("first")
    per_sig = docs.filter("sig is not null").groupBy("sig").agg(first)
    labels = _linked(sets)
    per_comp = per_sig.join(labels, "sig").groupBy("comp").agg(F.min("first").alias("best"))
    best = spread(labels, per_comp, ["comp"]).select("sig", "best")
    per_sig = per_sig.join(best, "sig", "left").select("sig", F.coalesce("best", "first").alias("first"))
    named = spread(docs.filter("sig is not null"), per_sig, ["sig"])
    named = named.select("doc_id", ROW, *KEY, F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), (F.col("first.row") == F.col(ROW)).alias("is_first"))
    empty = docs.filter("sig is null").select("doc_id", ROW, *KEY, F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("is_first"))
    return named.unionByName(empty)


def components(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id.

    Null and empty texts have no shingles and are components of their own; a null id is never a component's unless the
    component has no other; repeated rows are in one component; an empty table gives no rows.  Other columns are not read.
    """
    rows = over_cores(docs.select("doc_id", "text")).withColumn(ROW, F.monotonically_increasing_id())
    return _classes(rows).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns unchanged, one of each component: the smallest doc_id's."""
    rows = over_cores(docs.select(*key_of(docs), "doc_id", "text")).withColumn(ROW, F.monotonically_increasing_id())
    return emitted(docs, _classes(rows), "is_first")
