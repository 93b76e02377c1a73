"""Packing token sequences by best-fit decreasing.

Each input partition is packed where it is read, in blocks of ``BLOCK_TOKENS`` tokens,
so nothing is shuffled and memory is bounded. Documents above the window are first
cut into full windows, which are sequences already; what is left of each is a piece.
Pieces go, largest first, into the open window with the least room that holds them: a
segment tree over remaining capacities finds it in a few steps. Windows that this
leaves emptier than ``SLACK`` are dissolved: their pieces are poured, cut where needed,
into full windows, and what remains into windows of powers of two, which need no padding.

Tokens: words are independent of each other in this vocabulary (white space is dropped,
and neither its normaliser nor its pre-tokeniser looks across it), so each distinct word
of a slice is encoded once by the tokenizers library and looked up after that.

Defined results: a null or empty text is the single closing id; ids repeat the order of
rows, and equal rows give equal pieces of their own; an empty table gives no pieces;
other columns are ignored. A sequence id is the partition's number and a counter.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from leadloom.llm.words import ragged, slices, words

WINDOW = 4096
CLOSING_ID = 2
SLACK = 0.05
BLOCK_TOKENS = 1 << 23
#: Distinct word heads that a worker keeps encoded; beyond, it starts over.
CACHE_WORDS = 600_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# Words of plain letters and closing punctuation split in two pre-tokens; letters of this range are stable under NFC and lower-case alike everywhere.
_PLAIN = r"^(?P<head>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


class WordTokenizer:
    """Token ids of whole columns of text, encoding each distinct word once."""

    kept: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """The number under which each of these strings is kept, encoding the new ones."""
        strings = parts.to_pylist()
        if len(self.known) + len(strings) > CACHE_WORDS:
            self._clear()
        new = list(dict.fromkeys(s for s in strings if s not in self.known))
        if new:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((i for ids in got for i in ids), np.int32, int(lengths.sum()))
            self.known.update(zip(new, range(len(self.starts), len(self.starts) + len(new)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.concatenate(([0], np.cumsum(lengths)[:-1]))))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.ids = np.concatenate((self.ids, flat))
        return np.fromiter(map(self.known.__getitem__, strings), np.int64, len(strings))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)``: row r's ids are ``ids[bounds[r]:bounds[r + 1]]``."""
        codes, bounds, distinct = words(column)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        parts = pc.extract_regex(distinct, _PLAIN)
        plain = pc.is_valid(parts)
        head = pc.if_else(plain, pc.utf8_lower(pc.struct_field(parts, "head")), distinct).dictionary_encode()
        tail = pc.if_else(plain, pc.struct_field(parts, "tail"), "").dictionary_encode()
        both = self._numbers(pa.concat_arrays([head.dictionary, tail.dictionary]))
        heads = both[: len(head.dictionary)][np.asarray(head.indices)][codes]
        tails = both[len(head.dictionary) :][np.asarray(tail.indices)][codes]
        pairs = np.stack((heads, tails), 1).ravel()
        lengths = self.lengths[pairs]
        upto = np.concatenate(([0], np.cumsum(lengths[0::2] + lengths[1::2])))
        return ragged(self.ids, self.starts[pairs], lengths), upto[bounds]


class OpenWindows:
    """Open windows by remaining capacity: leaf c of a segment tree counts those with room c."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: dict[int, list[int]] = {}

    def put(self, room: int, number: int) -> None:
        self.at.setdefault(room, []).append(number)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of ``need`` or more: ``(room, number)``."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until a right neighbour has one
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.at[room].pop()


def best_fit(lengths: np.ndarray, window: int = WINDOW, slack: float = SLACK) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(item, start, length)``: every item's tokens lie in exactly one piece, each sequence within the window."""
    out: list[list[tuple[int, int, int]]] = []
    rest = np.asarray(lengths, np.int64) % window
    for item in np.flatnonzero(np.asarray(lengths) >= window):
        out += [[(int(item), s, window)] for s in range(0, int(lengths[item]) - window + 1, window)]
    tree, bins, rooms = OpenWindows(window), [], []
    for item in np.argsort(-rest, kind="stable"):
        need = int(rest[item])
        if not need:
            break
        room, number = tree.tightest(need) or (window, len(bins))
        if number == len(bins):
            bins.append([])
            rooms.append(window)
        bins[number].append((int(item), int(lengths[item]) - need, need))
        rooms[number] = room - need
        if room > need:
            tree.put(room - need, number)
    loose = [x for b, room in zip(bins, rooms, strict=True) if room > slack * window for x in b]
    out += [b for b, room in zip(bins, rooms, strict=True) if room <= slack * window]
    left = sum(x[2] for x in loose)
    sizes = [window] * (left // window) + [1 << k for k in range(window.bit_length(), -1, -1) if (left % window) >> k & 1]
    at = iter(loose)
    item, start, length = next(at, (0, 0, 0))
    for size in sizes:
        out.append([])
        while size:
            if not length:
                item, start, length = next(at)
            take = min(size, length)
            out[-1].append((item, start, take))
            start, length, size = start + take, length - take, size - take
    return out


def pack(docs: DataFrame, path: str, window: int = WINDOW, closing_id: int = CLOSING_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece, with its token ids if ``with_ids``; ``path``: the vocabulary file, the same on every machine."""
    schema = PIECES + ", ids array<int>" * with_ids

    def packed(batches):
        from pyspark import TaskContext

        tokenizer = WordTokenizer.of(path)
        base, counter, keys, texts, held = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def block():
            nonlocal counter
            rows, spans = [], []
            for sequence in best_fit(np.fromiter(map(len, texts), np.int64, len(texts)), window):
                offset = 0
                for item, start, length in sequence:
                    ids = texts[item][start : start + length]
                    rows.append((keys[item], start, length, zlib.crc32(ids.astype("<u4").tobytes()), len(texts[item]), base + counter, offset))
                    spans.append(ids)
                    offset += length
                counter += 1
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns]
            if with_ids:
                bounds = np.concatenate(([0], np.cumsum([len(s) for s in spans]))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(spans).astype(np.int32))))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

        for batch in slices(batches, "text"):
            ids, bounds = tokenizer.encode(batch.column("text"))
            keys += batch.column("id").to_pylist()
            # Kept as 16 bits where the vocabulary allows, half the memory.
            kind = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.int32
            texts += [np.append(ids[a:b], closing_id).astype(kind) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            held += len(ids) + batch.num_rows
            if held >= BLOCK_TOKENS:
                yield block()
                keys, texts, held = [], [], 0
        if texts:
            yield block()

    return docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text").mapInArrow(packed, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(docs, default_path())
