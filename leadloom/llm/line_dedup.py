"""Line dedup: lines within ``edits`` edits of each other are one class, of which the first occurrence stays.

A segment-partition edit join. A line is cut into edits + 1 segments of even length; of two
lines within that many edits, one holds a segment of the other unchanged, near its
place. Each line indexes its segments by (length, segment number, content) and probes, for
its own and each slightly smaller length, the substrings at the places where that
segment can stand: within i edits of the left end and edits - i of the right one.

Only lines that meet at a key go on; their texts are read again, others passed over by a bitmap of
bounded size before anything is shuffled. A key at which more than ``block`` lines meet is split by
the same rule again: what is left of two such lines beside the segment they share is within
the same number of edits, so they meet at a segment of that rest as well. What still
meets in larger groups is compared in cells of two blocks. In a cell, pairs whose bigram
parities differ in more bits than that many edits can change are passed over, and
the others are verified by a banded bit-parallel edit distance, many pairs at once; pairs
that verified links already join are not compared again. Links become classes.

Lines are what newlines separate, without white space at the ends, told apart by a 64-bit
hash: two different lines share one with a chance of n ** 2 / 2 ** 65 among n lines. Equal lines
are one row from the slice on.

Lines of fewer than ``shortest`` characters are no part of the edit join; from ``exact``
characters on, equal ones are one class all the same. The query takes every line that is not blank.

Defined results: lines of fewer than ``exact`` characters are always kept and not
compared; null and empty texts have no lines; order is by document id, then line, so the
class member that stays is the first in the corpus; rows that repeat an id share its lines'
places, and of equal places one is counted as first; rows with a null id come before all
others; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import WHITE, written
from leadloom.llm.components import components
from leadloom.llm.words import slices

EDITS = 2
SHORTEST = 32
#: The query compares equal lines from so many characters on: all but blank ones.
EXACT = 1
#: Lines, and characters of lines, of a block: two blocks are compared at a time.
BLOCK = 256
BLOCK_CHARS = 1 << 22
#: Characters, and pairs of a cell, that are verified at once, which bounds a task's memory.
AT_ONCE = 1 << 21
PAIRS_AT_ONCE = 2048
#: Bits of the map of lines whose texts are wanted: 16 MB, enough for eight million at 16 bits each.
MOST_BITS = 1 << 27
_MASK = (1 << 64) - 1


def lines_of(text: str | None) -> list[str]:
    return [line.strip(WHITE) for line in text.split("\n")] if text else []


def name(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


@lru_cache(1 << 16)
def segments(length: int, edits: int) -> tuple[tuple[int, int], ...]:
    """``(start, length)`` of a line's segments; the longer ones last."""
    base, longer = divmod(length, edits + 1)
    sizes = [base + (i > edits - longer) for i in range(edits + 1)]
    return tuple((sum(sizes[:i]), n) for i, n in enumerate(sizes))


@lru_cache(1 << 16)
def probes(length: int, edits: int) -> tuple[tuple[int, int, int, int], ...]:
    """``(length of the other, segment, start, size)`` of each substring to look up, but those that the line indexes itself."""
    out = []
    for other in range(max(0, length - edits), length + 1):
        apart = length - other
        for i, (at, size) in enumerate(segments(other, edits)):
            low, high = max(at - i, at + apart - (edits - i), 0), min(at + i, at + apart + edits - i, length - size)
            out += [(other, i, start, size) for start in range(low, high + 1) if apart or start != at]
    return tuple(out)


def keys(line: str, edits: int, seed: int = 0) -> tuple[list[int], list[int]]:
    """Hashed keys that a line indexes, even, and that it probes, odd: half a key is what the two share."""
    n, h = len(line), xxhash.xxh3_64_intdigest
    own = [(h(line[s : s + size], (seed + n * 64 + i) & _MASK) & ~1) - (1 << 63) for i, (s, size) in enumerate(segments(n, edits))]
    return own, [(h(line[s : s + size], (seed + other * 64 + i) & _MASK) | 1) - (1 << 63) for other, i, s, size in probes(n, edits)]


def rests(line: str, edits: int, half: int) -> set[str]:
    """What is left of a line beside the segments under half a key, the gap marked by a character that no text compares equal to."""
    own, asked = keys(line, edits)
    places = zip(own + asked, (*segments(len(line), edits), *(p[2:] for p in probes(len(line), edits))), strict=True)
    return {line[:s] + "\0" + line[s + size :] for key, (s, size) in places if key >> 1 == half}


def distances(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Edit distances of pairs of strings, ``(pairs, m)`` and ``(pairs, n)`` code points, exact up to ``edits``.

    Bit d of a word stands for row j - edits + d of column j: the band around the diagonal, one
    vertical difference a bit, moved down by one with each column. The score follows the band's
    lowest row to the last row, then that row to the end. Needs abs(m - n) <= edits < m.
    """
    m, n, top = a.shape[1], b.shape[1], 2 * edits
    padded = np.full((len(a), m + 3 * edits + n), -1, np.int32)
    padded[:, edits : edits + m] = a
    one, band = np.uint64(1), np.uint64((1 << (top + 1)) - 1)
    up = np.full(len(a), ((1 << (edits + 1)) - 1) << edits, np.uint64)
    down = np.zeros(len(a), np.uint64)
    score, last = np.full(len(a), edits, np.int64), top - 1
    for j in range(n):
        x = np.zeros(len(a), np.uint64)
        for d in range(top + 1):
            x |= (padded[:, j + d] == b[:, j]).astype(np.uint64) << np.uint64(d)
        diagonal = ((((x & up) + up) ^ up) | x | down) & band
        right_up, right_down = (down | ~(diagonal | up)) & band, diagonal & up
        if j < m - edits:
            score += (diagonal >> np.uint64(top) & one == 0).astype(np.int64)
        else:
            score += (right_up >> np.uint64(last) & one).astype(np.int64) - (right_down >> np.uint64(last) & one).astype(np.int64)
            last -= 1
        moved = diagonal >> one
        up, down = (right_down | ~(moved | right_up)) & band, moved & right_up
    return score


def near(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Which of these pairs are within ``edits``. Pairs of like lengths are verified together, both ends of a pair drawn out by as much of the same."""
    out = np.zeros(len(pairs), bool)
    size = np.array([(len(a), len(b)) for a, b in pairs], np.int64).reshape(-1, 2)
    low, apart = size.min(1), np.abs(size[:, 0] - size[:, 1])
    order = np.lexsort((low, apart))
    order = order[apart[order] <= edits]
    at = 0
    while at < len(order):
        d, least = apart[order[at]], low[order[at]]
        end = min(len(order), at + max(1, int(AT_ONCE // (least + least // 4 + 16))))
        same = (apart[order[at:end]] == d) & (low[order[at:end]] <= least + least // 4 + 16)
        chunk = order[at : at + (len(same) if same.all() else int(np.argmin(same)))]
        width = int(low[chunk].max())
        short, long = np.full((len(chunk), width), -2, np.int32), np.full((len(chunk), width + int(d)), -2, np.int32)
        for row, i in enumerate(chunk):
            a, b = sorted(pairs[i], key=len)
            short[row, : len(a)] = np.frombuffer(a.encode("utf-32-le"), np.int32)
            long[row, : len(b)] = np.frombuffer(b.encode("utf-32-le"), np.int32)
        out[chunk] = distances(short, long, edits) <= edits
        at += len(chunk)
    return out


def parities(line: str) -> np.ndarray:
    """256 bits: of each hashed pair of neighbouring characters, whether it occurs an odd number of times. An edit changes 4 bits at most."""
    c = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    pair = (c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(24)
    return np.packbits(np.bincount(pair, minlength=256).astype(np.uint8) & 1).view(np.uint64)


def candidate_pairs(texts: list[str], side: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``i < j`` that may be within ``edits``; of two sides, only pairs across."""
    size, bits = np.fromiter(map(len, texts), np.int64, len(texts)), np.array([parities(t) for t in texts])
    out = []
    for i in range(len(texts) - 1):
        apart = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(1, dtype=np.int64)
        fits = (apart <= 4 * edits) & (np.abs(size[i + 1 :] - size[i]) <= edits)
        if side[0] != side[-1]:
            fits &= side[i + 1 :] != side[i]
        out.append(np.flatnonzero(fits) + i + 1)
    return np.repeat(np.arange(len(out)), [len(x) for x in out]), np.concatenate(out) if out else np.zeros(0, np.int64)


def _listed(exact: int):
    def run(batches):
        for batch in slices(batches, "text"):
            rows = [(i, k, name(x) if len(x) >= exact else None) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, x in enumerate(lines_of(t))]
            yield _batch("doc_id line_no line", ([r[k] for r in rows] for k in range(3)))

    return run


def _batch(names: str, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names.split())


def _keyed(edits: int, shortest: int):
    def run(batches):
        for batch in slices(batches, "text"):
            seen = {x for t in batch.column("text").to_pylist() for x in lines_of(t) if len(x) >= shortest}
            key, line = [], []
            for x in seen:
                own, asked = keys(x, edits)
                key += own
                key += asked
                line += [name(x)] * (len(own) + len(asked))
            yield _batch("key line", (key, line))

    return run


def _rekeyed(edits: int):
    """Lines that meet at a hot half key, by the segments of what is left beside it."""

    def run(batches):
        for batch in batches:
            key, line = [], []
            for half, i, text in zip(*(batch.column(c).to_pylist() for c in ("half", "id", "text")), strict=True):
                for rest in rests(text, edits, half):
                    own, asked = keys(rest, edits, half & _MASK)
                    key += own + asked
                    line += [i] * (len(own) + len(asked))
            yield _batch("key line", (key, line))

    return run


def _met(batches):
    """Rows in order of key: of each half key that a line indexes and another one has too, its lines."""
    last, hub, indexing = None, None, False
    for batch in batches:
        key, line = (np.asarray(batch.column(c)) for c in ("key", "line"))
        if not len(key):
            continue
        half = key >> 1
        begin = np.flatnonzero(np.concatenate(([True], half[1:] != half[:-1])))
        hubs, indexed = line[begin].copy(), key[begin] & 1 == 0
        if last == half[0]:  # a key that began in an earlier batch
            hubs[0], indexed[0] = hub, indexing
        run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
        apart = indexed[run] & (line != hubs[run])
        with_hub = np.unique(run[apart])
        last, hub, indexing = half[-1], hubs[-1], bool(indexed[-1])
        yield _batch("half line", (np.concatenate((half[apart], half[begin][with_hub])), np.concatenate((line[apart], hubs[with_hub]))))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits at every id modulo their number: 16 bits an id and ``MOST_BITS`` at most, so what comes to the driver is bounded. Full, it passes more, never less."""
    size = max(1 << 10, min(MOST_BITS, 1 << (16 * ids.count()).bit_length()))
    at = ids.select(F.pmod("id", F.lit(size)).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
    words, found = np.zeros(size >> 6, np.int64), at.toArrow()
    words[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
    return words.view(np.uint64)


def _texts(shortest: int, bitmap: Broadcast):
    """Lines whose hash the bitmap may hold: most others stay where they were read."""

    def run(batches):
        words = bitmap.value
        for batch in slices(batches, "text"):
            seen = [x for x in {x for t in batch.column("text").to_pylist() for x in lines_of(t)} if len(x) >= shortest]
            ids = np.fromiter(map(name, seen), np.int64, len(seen))
            at = ids % (len(words) * 64)
            has = np.flatnonzero(words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array([seen[i] for i in has], pa.string())], ["id", "text"])

    return run


class _Sets:
    """Which ids are joined; the smallest stands for a set."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, i: int) -> int:
        while (above := self.up.get(i, i)) != i:
            self.up[i] = i = self.up.get(above, above)
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        self.up[max(a, b)] = min(a, b)


def _verified(edits: int):
    """Cells of lines to links: a forest of each cell's, or all that are found among pairs of small ones."""

    def run(batches):
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("cell", "side", "id", "text")), strict=True))
        ids: list[tuple[int, int]] = []
        pairs: list[tuple[str, str]] = []
        held = 0

        def verified():
            hits = [ids[k] for k in np.flatnonzero(near(pairs, edits))]
            return _batch("a b", ([h[0] for h in hits], [h[1] for h in hits]))

        for _, group in groupby(rows, key=lambda r: r[0]):
            members = list(group)
            texts = [m[3] for m in members]
            i, j = candidate_pairs(texts, np.array([m[1] for m in members]), edits)
            joined = _Sets()
            while len(i) > PAIRS_AT_ONCE:
                hit = near([(texts[x], texts[y]) for x, y in zip(i[:PAIRS_AT_ONCE], j[:PAIRS_AT_ONCE], strict=True)], edits)
                for x, y in zip(i[:PAIRS_AT_ONCE][hit].tolist(), j[:PAIRS_AT_ONCE][hit].tolist(), strict=True):
                    joined.join(x, y)
                i, j = i[PAIRS_AT_ONCE:], j[PAIRS_AT_ONCE:]
                tops = np.array([joined.top(x) for x in range(len(texts))])
                i, j = i[tops[i] != tops[j]], j[tops[i] != tops[j]]
            if joined.up:
                edges = [(members[x][2], members[joined.top(x)][2]) for x in joined.up if joined.top(x) != x]
                yield _batch("a b", ([e[0] for e in edges], [e[1] for e in edges]))
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                ids.append((members[x][2], members[y][2]))
                pairs.append((texts[x], texts[y]))
                held += len(texts[x])
            if held >= AT_ONCE:
                yield verified()
                ids, pairs, held = [], [], 0
        if pairs:
            yield verified()

    return run


def _links(docs: DataFrame, edits: int, shortest: int, block: int) -> DataFrame:
    """``a, b``: hashes of lines within ``edits`` edits of each other, enough of them to join every class."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(keyed: DataFrame, name: str) -> DataFrame:
        dealt = keyed.repartition(parts, F.shiftright("key", 1)).sortWithinPartitions("key")
        return written(dealt.mapInArrow(_met, "half long, line long").distinct(), name)

    found = met(docs.mapInArrow(_keyed(edits, shortest), "key long, line long"), "line-keys")
    wanted = written(found.select(F.col("line").alias("id")).distinct(), "lines-met")
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))
    texts = written(docs.mapInArrow(_texts(shortest, bitmap), "id long, text string").join(wanted, "id", "left_semi").dropDuplicates(["id"]), "line-texts")
    hot = written(found.groupBy("half").count().filter(F.col("count") > block).select("half"), "hot-keys")
    if not hot.isEmpty():
        lines = found.join(hot, "half").join(texts, F.col("line") == F.col("id")).select("half", "id", "text").repartition(parts)
        found = found.join(hot, "half", "left_anti").union(met(lines.mapInArrow(_rekeyed(edits), "key long, line long"), "line-keys"))
    rows = found.join(texts, F.col("line") == F.col("id")).select("half", "id", "text")
    sizes = found.join(texts.select("id", F.length("text").alias("chars")), F.col("line") == F.col("id")).groupBy("half")
    sizes = sizes.agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("chars") / BLOCK_CHARS)).cast("int").alias("blocks"))
    large = rows.join(written(sizes.filter("blocks > 1"), "large-keys"), "half", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = large.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(F.concat_ws(":", "half", F.least("side", "to"), F.greatest("side", "to")).alias("cell"), "side", "id", "text")
    return cells.repartition(parts, "cell").sortWithinPartitions("cell", "side").mapInArrow(_verified(edits), "a long, b long")


def line_classes(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, block: int = BLOCK, exact: int | None = None) -> DataFrame:
    """``doc_id, line_no, line, keep_doc, keep_line`` of every line: where its class first occurs (itself, if it is kept).

    Lines of ``exact`` characters or more, ``shortest`` if not given, are compared with equal ones.
    """
    if not 0 <= edits < shortest:
        raise ValueError("lines must be longer than the edits allowed")
    texts = docs.selectExpr("cast(doc_id as long) id", "text")
    every = written(texts.mapInArrow(_listed(shortest if exact is None else exact), "doc_id long, line_no long, line long"), "lines")
    joined = components(_links(texts, edits, shortest, block), "line-links")

    place = F.struct("doc_id", "line_no")
    first = every.filter("line IS NOT NULL").groupBy("line").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    named = first.join(joined.withColumnRenamed("id", "line"), "line", "left").withColumn("cls", F.coalesce("component", "line"))
    best = named.filter("component IS NOT NULL").groupBy("cls").agg(F.min("first").alias("best"))
    repeated = named.join(best, "cls", "left").filter("n > 1 OR component IS NOT NULL").select("line", F.coalesce("best", "first").alias("keep"))
    out = every.join(repeated, "line", "left").withColumn("keep", F.coalesce("keep", place))
    return out.select("doc_id", "line_no", "line", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line_no").alias("keep_line"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row a document: how many lines it has, how many of them go, and ``dropped``, each place that goes with the place that stays for it.

    A class is what shares a place that stays. Rows that repeat an id share one list, in which a place stands once for each that stays for it.
    """
    gone = ~(F.col("keep_doc").eqNullSafe(F.col("doc_id")) & (F.col("keep_line") == F.col("line_no")))
    places = F.sort_array(F.collect_set(F.when(gone, F.struct("line_no", "keep_doc", "keep_line")))).alias("dropped")
    counts = line_classes(docs, exact=EXACT).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(gone).alias("n_dropped"), places)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    none = F.array().cast("array<struct<line_no:bigint,keep_doc:bigint,keep_line:bigint>>")
    rows = ids.join(counts.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return rows.select("doc_id", zero("n_lines"), zero("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with the lines that go taken out of their texts."""
    gone = line_classes(docs, exact=EXACT).filter("keep_doc <> doc_id OR keep_line <> line_no").groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"))
    rows = docs.join(gone, "doc_id", "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<bigint>")), i.cast("long"))), "\n")
    return rows.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left)).select(docs.columns)
