"""N-gram Jaccard self-join with token-combination prefixes.

Documents are sets of word shingles; two link when their sets' Jaccard similarity is at
least ``percent`` / 100. The join runs in these steps:

1. Shingles are hashed (48 bits) slice by slice of the input. Each slice sends every
   bucket of the hash space its distinct shingles, a bucket counts in how many documents
   each occurs, and answers each slice with those that occur in more than one. A shingle
   met more than once in a slice is sent once with its count, so a bucket gets a row for
   each slice and shingle at most, however common the shingle.
2. All shingles have one order: rarest first, then by hash. A document can miss at most
   t = n - ceil(percent * n / 100) of its n shingles in a partner, so one that has more
   than t shingles of its own alone has no partner. Of the others, the prefix is indexed:
   shingles of up to ``RARE`` documents singly; if these don't make up t + 1, the prefix
   is extended into the frequent ones, dealt by hash into classes, until classes holding
   p tokens give the missing number as sum(p - 1); of each class, all pairs are
   indexed. A partner that shares less than a pair in every class misses at least t + 1.
3. Documents that share an index entry are joined in stars, never in pairs, and the
   connected sets are verified: in blocks of ``BLOCK`` documents or ``BLOCK_SHINGLES`` shingles, each
   pair's overlap of whole hashed sets is counted and compared in integers. Each block returns its links as
   a forest, and the forests' components are the result. A set of more than one block is
   first compared around hubs, and only index entries that still hold documents of several
   classes connect what is left of it; blocks of one class are not compared again.

Equal sets are one row from step 1 on (in a slice) and step 2 on (everywhere), so copies
are never expanded into pairs.

Defined results: null, empty and blank texts have no shingles and link with nothing; a
text of fewer words than a shingle is one shingle; repeated rows are each returned, with
the component of their id; rows with a null id are returned with a null component; other columns are ignored.
"""

from __future__ import annotations

import functools
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import dropped, numbered, settled, without, written
from leadloom.llm.components import components
from leadloom.llm.words import slices, words

RARE = 64
#: Documents, and shingles of them, of a block: two blocks are compared at a time.
BLOCK = 512
BLOCK_SHINGLES = 1 << 22
#: How often the sets of more than one block are taken apart, while a turn leaves half of their entries at most; the rest is compared block by block.
TURNS = 3
#: Bytes of text hashed at a time, which bound a worker's memory.
SLICE = 4 << 20
#: Bytes of input for a bucket of the hash space, and buckets for a task at most.
BUCKET_BYTES = 32 << 20
MOST_BUCKETS = 1 << 10
#: Frequent tokens are dealt into n / CLASS classes, rounded to a power of two.
CLASS = 16

_U = np.uint64
_NULL = np.iinfo(np.int64).min


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pack(sorted_keys: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as compressed byte planes of their differences."""
    steps = np.diff(sorted_keys, prepend=_U(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(_U), dtype=_U)


def shingle_keys(column: pa.Array, k: int) -> np.ndarray:
    """Sorted distinct ``hash48 << 16 | row`` of a slice's shingles (a slice has at most 2 ** 15 rows)."""
    codes, bounds, distinct = words(column, lower_ascii=True)
    strings = (w for a in range(0, len(distinct), 1 << 14) for w in distinct.slice(a, 1 << 14).to_pylist())
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in strings), _U, len(distinct))[codes]
    length = np.diff(bounds)
    rows = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(codes)) - bounds[:-1][rows]
    with np.errstate(over="ignore"):
        full = place <= (length - k)[rows]
        at = np.flatnonzero(full)
        h = hashes[at]
        for j in range(1, k):
            h = h * _U(0x9E3779B97F4A7C15) + hashes[at + j]
        short = np.flatnonzero((length > 0) & (length < k))
        s = length[short].astype(_U)
        for j in range(k - 1):
            has = length[short] > j
            s = np.where(has, s * _U(0xD6E8FEB86659FD93) + hashes[np.minimum(bounds[short] + j, max(0, len(hashes) - 1))], s) if len(hashes) else s
    keys = np.concatenate((mixed(h) >> _U(16) << _U(16) | rows[at].astype(_U), mixed(s) >> _U(16) << _U(16) | short.astype(_U)))
    keys.sort()
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def _shingled(k: int, buckets: int):
    """Slices of documents to rows for buckets (kind 1) and for the slice itself (kind 0)."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in slices(batches, "text", SLICE):
            keys = shingle_keys(batch.column("text"), k)
            ids = np.asarray(batch.column("id").fill_null(_NULL), np.int64)
            row = (keys & _U(0xFFFF)).astype(np.int64)
            order = np.argsort(row.astype(np.uint16), kind="stable")
            n = np.bincount(row, minlength=len(ids))
            starts = np.concatenate(([0], np.cumsum(n)))
            h = keys >> _U(16)
            sums = [np.concatenate(([_U(0)], np.cumsum(mixed(h[order] + _U(c)), dtype=_U))) for c in (0x51ED270B, 0xA0761D64)]
            d1, d2 = (np.diff(s[starts]).view(np.int64) for s in sums)
            first: dict[tuple, int] = {}  # of equal sets, the row with the smallest id stands for the slice's others
            for r in np.lexsort((ids,)):
                if ids[r] != _NULL and n[r]:
                    first.setdefault((n[r], d1[r], d2[r]), r)
            stands = np.zeros(len(ids), bool)
            stands[list(first.values())] = True
            keys = keys[stands[row]]
            h = keys >> _U(16)
            new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(h)))
            many = np.repeat(count > 1, count)
            single, shared = keys[~many], (h[begin][count > 1] << _U(16)) | np.minimum(count[count > 1], 0xFFFF).astype(_U)
            out = [(number % buckets, 0, number, b"".join((np.int64(len(ids)).tobytes(), ids.tobytes(), n.astype(np.int64).tobytes(), d1.tobytes(), d2.tobytes(), stands.tobytes(), _pack(keys[many]))))]
            cuts = [np.searchsorted(x >> _U(16), (np.arange(buckets + 1, dtype=_U) << _U(32)) // _U(buckets) << _U(16)) for x in (single, shared)]
            for b in range(buckets):
                one, two = single[cuts[0][b] : cuts[0][b + 1]], shared[cuts[1][b] : cuts[1][b + 1]]
                if len(one) or len(two):
                    packed = _pack(one)
                    out.append((b, 1, number, np.int64(len(packed)).tobytes() + packed + _pack(two)))
            yield _rows(out)
            number += 1

    return run


_ROUTED = "bucket int, kind int, slice long, body binary"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["bucket", "kind", "slice", "body"])


def _counted(batches):
    """Rows in order of bucket: what slices keep for themselves, and each bucket's answers."""
    sent: list[tuple[int, np.ndarray, np.ndarray]] = []
    at = None
    for batch in batches:
        buckets, kinds, numbers = (batch.column(c).to_pylist() for c in ("bucket", "kind", "slice"))
        passing = [i for i, kind in enumerate(kinds) if kind == 0]
        if passing:
            yield batch.take(pa.array(passing))
        for i, kind in enumerate(kinds):
            if kind == 1:
                if buckets[i] != at:
                    yield from _answers(sent)
                    sent, at = [], buckets[i]
                body = batch.column("body")[i].as_py()
                size = int(np.frombuffer(body[:8], np.int64)[0])
                sent.append((numbers[i], _unpack(body[8 : 8 + size]), _unpack(body[8 + size :])))
    yield from _answers(sent)


def _answers(sent: list[tuple[int, np.ndarray, np.ndarray]]):
    """One bucket: its slices' shingles to, for each slice, those of more than one document, as ``count << 48 | hash`` and the row."""
    if not sent:
        return
    whole = np.concatenate([x for _, one, two in sent for x in (one >> _U(16), two >> _U(16))])
    weight = np.concatenate([x for _, one, two in sent for x in (np.ones(len(one), np.int64), (two & _U(0xFFFF)).astype(np.int64))])
    order = np.argsort(whole, kind="stable")
    whole, weight = whole[order], weight[order]
    begin = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1]))) if len(whole) else np.zeros(0, np.int64)
    if len(whole):
        distinct, df = whole[begin], np.add.reduceat(weight, begin)
        distinct, df = distinct[df > 1], np.minimum(df[df > 1], 0xFFFF).astype(_U)
        for number, one, two in sent:
            answer = []
            for x in (one, two):
                at = np.searchsorted(distinct, x >> _U(16))
                hit = at < len(distinct)
                hit[hit] = distinct[at[hit]] == x[hit] >> _U(16)
                answer.append((df[at[hit]] << _U(48) | x[hit] >> _U(16), x[hit] & _U(0xFFFF)))
            if len(answer[0][0]) or len(answer[1][0]):
                body = zstandard.ZstdCompressor(level=1).compress(b"".join((np.int64([len(a) for a, _ in answer]).tobytes(), answer[0][0].tobytes(), answer[0][1].astype(np.uint16).tobytes(), answer[1][0].tobytes())))
                yield _rows([(0, 1, number, body)])


_DOCS = "doc_id long, n long, d1 long, d2 long, stands boolean, tokens binary"


def _assembled(percent: int):
    """Rows of one slice at a time: documents, with their shared shingles in global order where they can have a partner."""

    def run(batches):
        rows = ((s, k, b) for batch in batches for s, k, b in zip(*(batch.column(c).to_pylist() for c in ("slice", "kind", "body")), strict=True))
        for _, group in groupby(rows, key=lambda r: r[0]):
            tokens, at, counts = [], [], []
            head = b""
            for _, kind, body in group:
                if kind == 0:
                    head = body
                    continue
                body = zstandard.ZstdDecompressor().decompress(body)
                a, b = np.frombuffer(body[:16], np.int64)
                tokens.append(np.frombuffer(body, _U, a, 16))
                at.append(np.frombuffer(body, np.uint16, a, 16 + 8 * a).astype(np.int64))
                counts.append(np.frombuffer(body, _U, b, 16 + 10 * a))
            size = int(np.frombuffer(head[:8], np.int64)[0])
            ids, n, d1, d2 = (np.frombuffer(head, np.int64, size, 8 + 8 * size * i) for i in range(4))
            stands = np.frombuffer(head, bool, size, 8 + 32 * size)
            repeated = _unpack(head[8 + 33 * size :])
            # Shingles that the slice kept: each has an answer, since it has more than one document here.
            known = np.sort(np.concatenate([np.zeros(0, _U), *counts]) << _U(16)) >> _U(16)
            full = np.concatenate([np.zeros(0, _U), *counts])
            full = full[np.argsort(full << _U(16), kind="stable")]
            place = np.searchsorted(known, repeated >> _U(16))
            tokens.append(full[place] if len(repeated) else np.zeros(0, _U))
            at.append((repeated & _U(0xFFFF)).astype(np.int64))
            tokens, at = np.concatenate(tokens), np.concatenate(at)
            order = np.lexsort((tokens, at))
            tokens, bounds = tokens[order], np.concatenate(([0], np.cumsum(np.bincount(at, minlength=size))))
            need = -(-percent * n // 100)
            bodies = [tokens[bounds[r] : bounds[r + 1]].tobytes() if stands[r] and bounds[r + 1] - bounds[r] >= need[r] else None for r in range(size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == _NULL), pa.array(n), pa.array(d1), pa.array(d2), pa.array(stands), pa.array(bodies, pa.binary())],
                ["doc_id", "n", "d1", "d2", "stands", "tokens"],
            )

    return run


def _level(n: int) -> int:
    return max(0, (max(1, n) // CLASS).bit_length() - 1)


def signatures(tokens: np.ndarray, n: int, percent: int, single: int = RARE) -> np.ndarray:
    """Index entries of a document: ``tokens`` are its shared shingles in global order, ``count << 48 | hash``."""
    need = n - -(-percent * n // 100) + 1 - (n - len(tokens))
    h, rare = tokens & _U((1 << 48) - 1), int(np.searchsorted(tokens, _U(single + 1) << _U(48)))
    out = [mixed(h[: min(need, rare)] ^ (_U(1) << _U(60)))]
    if need > rare:
        if n == 1:
            return mixed(h ^ (_U(2) << _U(60)))
        frequent, missing = h[rare:], need - rare
        for level in sorted({_level(-(-percent * n // 100)), _level(n), _level(100 * n // percent)}):
            dealt = frequent & _U((1 << level) - 1)
            later = np.ones(len(frequent), np.int64)
            later[np.unique(dealt, return_index=True)[1]] = 0
            upto = int(np.searchsorted(np.cumsum(later), missing)) + 1
            order = np.argsort(dealt[:upto], kind="stable")
            cls, tok = dealt[:upto][order], frequent[:upto][order]
            bounds = np.append(np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1]))), len(cls))
            for d in range(1, int(np.diff(bounds).max())):  # pairs at distance d in their class, smaller hash first
                same = np.flatnonzero(cls[d:] == cls[:-d])
                low, high = np.minimum(tok[same], tok[same + d]), np.maximum(tok[same], tok[same + d])
                with np.errstate(over="ignore"):
                    out.append(mixed(mixed(low + _U(level << 50)) * _U(0x9E3779B97F4A7C15) + high))
    return np.unique(np.concatenate(out))


def _indexed(percent: int, single: int):
    def run(batches):
        for batch in batches:
            ids, sigs = [], []
            for i, n, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "tokens")), strict=True):
                sigs.append(signatures(np.frombuffer(body, _U), n, percent, single))
                ids.append(np.full(len(sigs[-1]), i, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids))], ["sig", "id"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of these sets share, exactly."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begin = np.concatenate(([True], flat[1:] != flat[:-1]))
    number = np.cumsum(begin) - 1
    count = np.bincount(number)
    keep = count[number] > 1
    owner, number = owner[keep], number[keep]
    number = np.unique(number, return_inverse=True)[1] if len(number) else number
    out, width = np.zeros((m, m), np.float32), 2048
    cuts = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else -1) + 1 + width, width))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = np.zeros((m, width), np.float32)
        part[owner[a:b], number[a:b] % width] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def forest(ids: np.ndarray, n: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Each id with the smallest id that it reaches by links among these documents."""
    shared = overlaps(sets)
    linked = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
    order = np.argsort(ids)
    linked, ids = linked[np.ix_(order, order)], ids[order]
    np.fill_diagonal(linked, True)
    label = np.arange(len(ids))
    while True:
        lower = np.where(linked, label[None, :], len(ids)).min(1)
        lower = lower[lower]
        if (lower == label).all():
            return [(int(ids[i]), int(ids[x])) for i, x in enumerate(label) if i != x]
        label = lower


def _verified(percent: int):
    def run(batches):
        columns = ("cell", "doc_id", "n", "tokens")
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        edges: list[tuple[int, int]] = []
        for _, group in groupby(rows, key=lambda r: r[0]):
            members = list(group)
            if len(members) > 1:
                edges += forest(np.array([m[1] for m in members]), np.array([m[2] for m in members]), [np.frombuffer(m[3], _U) for m in members], percent)
            if len(edges) >= 1 << 16:
                yield _edges(edges)
                edges = []
        yield _edges(edges)

    return run


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])


def _blocks(sets: DataFrame, reps: DataFrame, name: str, block: int) -> DataFrame:
    """Into how many blocks each set of documents goes: ``name``, ``blocks``."""
    held = sets.join(reps.select("doc_id", "n"), F.col("id") == F.col("doc_id")).groupBy(name)
    return held.agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def _compared(cells: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the links among the documents of each cell (``id, cell``), as forests."""
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.join(reps, F.col("id") == F.col("doc_id")).select("cell", "doc_id", "n", "tokens")
    return rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_verified(percent), "a long, b long")


def _narrowed(sets: DataFrame, index: DataFrame, reps: DataFrame, percent: int, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """Cells (``id, cell``) that compare all of each candidate set (``id, component``), and the links found in taking those of more than one block apart.

    In a turn, each document of a large set goes to one hub, that of most of its index
    entries, and each hub's documents are compared with it and one another block by block,
    which grows with the set, not with its square. Entries whose documents are all linked
    by then have nothing left to tell; the others connect the sets of the next turn.
    What stays large is dealt into blocks by class, and blocks of one class aren't compared.
    """
    settled, links, classes, worn = [], [], None, False
    for turn in range(TURNS + 1):
        large = written(_blocks(sets, reps, "component", block).filter("blocks > 1").select("component"), "large-sets")
        settled.append(sets.join(large, "component", "left_anti").select("id", F.col("component").cast("string").alias("cell")))
        sets = sets.join(large, "component", "left_semi").select("id", "component")
        if turn == TURNS or worn or large.isEmpty():
            break
        entries = written(index.join(sets, "id", "left_semi").select("sig", "id"), "large-entries")
        hubs = entries.groupBy("sig").agg(F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("hub"))
        votes = entries.join(hubs, "sig").filter("id <> hub").groupBy("id", "hub").count()
        chosen = written(votes.groupBy("id").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub")), "hubs")
        around = _blocks(chosen, reps, "hub", block)
        members = chosen.join(around, "hub").withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        each = around.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"))
        cells = members.select("id", "hub", "at").union(each).select("id", F.concat_ws(":", "hub", "at").alias("cell"))
        links.append(written(_compared(cells, reps, percent), "large-links"))
        classes = written(components(functools.reduce(DataFrame.union, links), "large-links"), "large-classes")
        named = entries.join(classes, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("cls"))
        still = named.groupBy("sig").agg(F.min("id").alias("hub"), F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high")
        index = written(entries.join(still.select("sig", "hub"), "sig"), "open-entries")
        stars = index.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
        sets = written(components(stars, "candidate-edges"), "candidates")
        worn = 2 * index.count() > entries.count()
    if classes is not None:
        settled.append(_grid(sets, classes, reps, block))
    return functools.reduce(DataFrame.union, settled), links


def _grid(sets: DataFrame, classes: DataFrame, reps: DataFrame, block: int) -> DataFrame:
    """Cells of two blocks each for large sets: a class of a block or more has blocks of its own, the others share theirs."""
    named = sets.join(classes.select("id", F.col("component").alias("cls")), "id", "left")
    own = named.groupBy("component", "cls").count().filter(F.col("cls").isNotNull() & (F.col("count") >= block))
    own = own.select("component", "cls", F.col("cls").cast("string").alias("own"))
    named = written(named.join(own, ["component", "cls"], "left").select("id", F.struct("component", F.coalesce("own", F.lit("")).alias("own")).alias("part")), "large-members")
    sizes = written(_blocks(named, reps, "part", block), "large-parts")
    dealt = sizes.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"))
    sides = dealt.select(F.col("part.component").alias("component"), F.col("part.own").alias("own"), F.concat_ws("/", "part.own", "at").alias("side"))
    across = sides.join(sides.select("component", F.col("own").alias("other"), F.col("side").alias("to")), "component").filter("own = '' OR own <> other")
    across = across.select("component", "side", F.concat_ws(":", "component", F.least("side", "to"), F.greatest("side", "to")).alias("cell"))
    members = named.join(sizes, "part").select("id", F.col("part.component").alias("component"), F.concat_ws("/", "part.own", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("side"))
    return members.join(across, ["component", "side"]).select("id", "cell")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; ``k`` words a shingle, similarity of ``percent`` / 100 or more."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text")
    # A task takes its buckets one after another, so the input's size decides how many there are, not how much one holds.
    buckets = parts * max(1, min(MOST_BUCKETS, -(-int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // (parts * BUCKET_BYTES))))
    sent = texts.mapInArrow(_shingled(k, buckets), _ROUTED)
    counted = sent.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket").mapInArrow(_counted, _ROUTED)
    table = written(counted.repartition(parts, "slice").sortWithinPartitions("slice", "kind").mapInArrow(_assembled(percent), _DOCS), "shingle-sets")

    able = table.filter("tokens IS NOT NULL")
    one = able.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    reps = written(able.join(one, "doc_id", "left_semi").select("doc_id", "n", "tokens").dropDuplicates(["doc_id"]), "representatives")
    index = written(reps.repartition(parts).mapInArrow(_indexed(percent, rare), "sig long, id long"), "signatures")
    hubs = index.groupBy("sig").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("sig", "hub")
    stars = index.join(hubs, "sig").filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    sets = written(components(stars, "candidate-edges"), "candidates")
    cells, links = _narrowed(sets, index, reps, percent, block)
    links = functools.reduce(DataFrame.union, links, _compared(cells, reps, percent))
    joined = components(links, "links")

    classes = table.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = classes.join(joined, F.col("rep") == F.col("id"), "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = table.join(classes, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, k=4, percent=85)


def kept(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each group the row with the smallest id stays, null ids last, with its columns; five words, similarity 0.8.

    Rows count, not ids: rows that share an id, or have none, are compared by their own texts.
    Repeated rows are one group. Rows without words are in no group and stay.
    """
    rows = numbered(docs)
    found = settled(lambda: near_duplicates(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("cls")), "groups")
    others = found.filter("cls <> _row")
    members = others.union(others.select(F.col("cls").alias("_row"), "cls").distinct())
    named = members.join(rows.select("_row", F.col("doc_id").alias("id")), "_row")
    first = named.groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row")).alias("first"))
    out = without(rows, named.join(first, "cls").filter("_row <> first._row")).select(docs.columns)
    dropped(found)
    return out
