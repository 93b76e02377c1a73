"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as its words ``[^\\x20\\x09-\\x0D]+``, every one of them, lower-cased in
ASCII, in pieces of at most ``PIECE`` bytes. The network reads a piece's bytes forward
and backward with one gated recurrent unit each way and labels every position with a
distribution over languages; a document's probabilities pool the positions' log
probabilities over all bytes of all its words. Equal pieces are read once for each slice of
input and counted, which gives the same sums. All training, by backpropagation through
time, is numpy on the driver, from a bounded sample of labelled rows.

Rows for training: text and label are not null and crc32(id as text) mod 4 is not 2. The query
learns, for each label, from the ``SAMPLE_DOCS`` with the smallest digest of their id, and of their pieces the
``SAMPLE_PIECES`` commonest of each label: both bound what comes to the driver. Label, source and id
are no inputs of a prediction.

The pipeline's stage learns from all of these rows: the pieces of all their words are counted,
and workers train on every one of them (``fit_all``); only networks come to the driver. It has one label
more, for what is none of the languages: made-up pieces of shuffled words, random letters and digits, one repeated
character and letters of many scripts. A text's evidence is the mean over its bytes of the log
probability of its best language less that of none, over its words of letters if it has any, so
that numbers, addresses and keys do not count against a text; a text whose evidence is below a
threshold goes. The threshold is ``MARGIN`` below the ``LOW`` quantile of the evidence of
all labelled documents, counted in steps of ``STEP``, so that clean ones stay; ``SHORT`` favours short texts.

Defined results: null text, or text without a letter, is ``und`` with score 0; a
document's score is its label's pooled probability; the pool is a mean over positions
times ``EVIDENCE``, so it stays a soft probability however long the text; with one
label learned that is always it; with none (an empty table) everything is ``und``; rows
that repeat are each returned; a null id is not held out and no training row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadloom.llm.common import dropped, written
from leadloom.llm.words import slices, trimmed, words

#: Labelled documents for training, and distinct pieces of their words, at most so many of each label.
SAMPLE_DOCS = 300
SAMPLE_PIECES = 40_000
PIECE = 24
HIDDEN = 12
STEPS = 300
BATCH = 256
RATE = 0.01
#: The pipeline's network is trained in so many turns, each over another part of all pieces; in a turn a worker takes its cell's, of so many pieces over all turns.
TURNS = 6
CELL = 1 << 16
#: How many positions' worth of evidence a whole document counts as in its pooled probability.
EVIDENCE = 16.0
UNKNOWN = "und"
#: Made-up pieces, and the blocks of Unicode whose characters some of them are drawn from.
OTHERS = 6000
SCRIPTS = ((0x61, 0x7A), (0x30, 0x39), (0x21, 0x40), (0xC0, 0x17F), (0x370, 0x3FF), (0x400, 0x45F), (0x5D0, 0x5EA), (0x620, 0x64A), (0x900, 0x940), (0xE00, 0xE30), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
#: Evidence is in nats a byte.
#: Letters, with apostrophes and hyphens among them and other marks at the ends: numbers, addresses and keys say nothing about a language.
PLAIN_WORD = r"^[^\pL\pN@=:/_]*\pL[\pL\pM'’\-]*[^\pL\pN@=:/_]*$"
LOW = 0.01
MARGIN = 4.0
STEP = 2.0**-10
#: A text of so many bytes gets MARGIN once more, one of twice as many half of it: a mean over few bytes says little.
SHORT = 8


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class ByteGru:
    """One unit each way: state h, update gate z, reset gate r, candidate c; 256 embedded bytes and 0 for padding."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        size = {"x": (257, 3 * hidden), "u": (hidden, 2 * hidden), "v": (hidden, hidden)}
        self.p = {f"{side}{name}": rng.normal(0, 0.3, shape).astype(np.float32) for side in "fb" for name, shape in size.items()}
        self.p["out"] = rng.normal(0, 0.3, (2 * hidden, len(labels))).astype(np.float32)
        self.p["bias"] = np.zeros(len(labels), np.float32)

    def _read(self, side: str, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each position, ``(length, batch, hidden)``; a padded position leaves the state alone."""
        x, u, v, n = self.p[side + "x"], self.p[side + "u"], self.p[side + "v"], self.hidden
        h = np.zeros((codes.shape[1], n), np.float32)
        out = np.empty((len(codes), codes.shape[1], n), np.float32)
        for t in range(len(codes)) if side == "f" else range(len(codes) - 1, -1, -1):
            given = x[codes[t]]
            zr = _sigmoid(given[:, : 2 * n] + h @ u)
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(given[:, 2 * n :] + (r * h) @ v)
            z = z * (codes[t] > 0)[:, None]
            if keep is not None:
                keep.append((t, h, zr, z, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of each position, ``(length, batch, labels)``."""
        both = np.concatenate((self._read("f", codes), self._read("b", codes)), 2)
        s = both @ self.p["out"] + self.p["bias"]
        s -= s.max(2, keepdims=True)
        return s - np.log(np.exp(s).sum(2, keepdims=True))

    def gradient(self, codes: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over positions, by backpropagation through time both ways; ``weight`` is each piece's."""
        n, kept = self.hidden, {"f": [], "b": []}
        both = np.concatenate([self._read(side, codes, kept[side]) for side in "fb"], 2)
        s = both @ self.p["out"] + self.p["bias"]
        s = np.exp(s - s.max(2, keepdims=True))
        s /= s.sum(2, keepdims=True)
        s[:, np.arange(len(label)), label] -= 1
        s *= (codes > 0)[:, :, None] / max(1, (codes > 0).sum())
        if weight is not None:
            s *= weight[None, :, None].astype(np.float32)
        g = {k: np.zeros_like(w) for k, w in self.p.items()}
        g["out"] = np.einsum("tbh,tbl->hl", both, s)
        g["bias"] = s.sum((0, 1))
        above = s @ self.p["out"].T
        for side, part in (("f", above[:, :, :n]), ("b", above[:, :, n:])):
            u, v = self.p[side + "u"], self.p[side + "v"]
            dh = np.zeros((codes.shape[1], n), np.float32)
            for t, h, zr, z, c in reversed(kept[side]):
                dh = dh + part[t]
                gate, r = zr[:, :n], zr[:, n:]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * (codes[t] > 0)[:, None] * gate * (1 - gate)
                drh = dc @ v.T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate((dz, dr), 1)
                g[side + "u"] += h.T @ dzr
                g[side + "v"] += (r * h).T @ dc
                np.add.at(g[side + "x"], codes[t], np.concatenate((dzr, dc), 1))
                dh = dh * (1 - z) + drh * r + dzr @ u.T
        return g


def coded(pieces: list[bytes]) -> np.ndarray:
    """``(length, pieces)``: byte + 1, and 0 beyond a piece's end."""
    out = np.zeros((len(pieces), max(map(len, pieces), default=1)), np.int16)
    for row, piece in zip(out, pieces, strict=True):
        row[: len(piece)] = np.frombuffer(piece, np.uint8)
        row[: len(piece)] += 1
    return out.T.copy()


class Adam:
    """A network with the two moments of its parameters and the number of steps taken."""

    def __init__(self, net: ByteGru):
        self.net, self.steps = net, 0
        self.first, self.second = ({k: np.zeros_like(w) for k, w in net.p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        for k, w in self.net.p.items():
            self.first[k] += 0.1 * (g[k] - self.first[k])
            self.second[k] += 0.01 * (g[k] * g[k] - self.second[k])
            w -= rate * self.first[k] / (1 - 0.9**self.steps) / (np.sqrt(self.second[k] / (1 - 0.99**self.steps)) + 1e-6)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for d in (self.net.p, self.first, self.second) for x in d.values()])

    def take(self, flat: np.ndarray, steps: int) -> None:
        at, self.steps = 0, steps
        for d in (self.net.p, self.first, self.second):
            for x in d.values():
                x[...] = flat[at : at + x.size].reshape(x.shape)
                at += x.size


def train(pieces: list[bytes], label: np.ndarray, weight: np.ndarray, labels: list[str], steps: int = STEPS, seed: int = 11) -> ByteGru:
    """Adam over batches drawn by weight, each label equally often."""
    net, rng = ByteGru(labels), np.random.default_rng(seed)
    share = weight / np.bincount(label, weight, len(labels))[label]
    share /= share.sum()
    codes, adam = coded(pieces), Adam(net)
    for step in range(1, steps + 1):
        at = rng.choice(len(pieces), BATCH, p=share)
        adam.step(net.gradient(codes[: max(1, int((codes[:, at] > 0).any(1).sum())), at], label[at]), RATE * min(1, 2 * (1 - step / (steps + 1))))
    return net


def passed(adam: Adam, pieces: list[bytes], label: np.ndarray, weight: np.ndarray, turn: int, seed: int) -> None:
    """One turn over a part: every piece at least once, as often as its share says, and by a weight that makes up for the rest."""
    rng, codes = np.random.default_rng(seed), coded(pieces)
    share = weight / np.bincount(label, weight)[label]
    share /= share.sum()
    total = STEPS * BATCH // TURNS
    times = np.maximum(1, np.rint(share * total)).astype(np.int64)
    order = rng.permutation(np.repeat(np.arange(len(pieces)), times))
    cuts = range(0, len(order), BATCH)
    for i, a in enumerate(cuts):
        at = order[a : a + BATCH]
        g = adam.net.gradient(codes[: max(1, int((codes[:, at] > 0).any(1).sum())), at], label[at], share[at] * total / times[at])
        adam.step(g, RATE * min(1, 2 * (1 - (turn + (i + 1) / (len(cuts) + 1)) / TURNS)))


def labelled(id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang"):
    """Whether a row may be learned from."""
    return F.coalesce(F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != 2), F.lit(False))


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``id, label, text`` of the labelled documents that are sampled."""
    rows = docs.filter(labelled(id_col, text_col, label_col))
    # Ids are drawn before any text is read for it.
    ids = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).withColumn("at", F.row_number().over(W.partitionBy("label").orderBy(F.md5(F.col("id").cast("string")), "id")))
    ids = ids.filter(F.col("at") <= SAMPLE_DOCS).select("id", "label").distinct()
    return rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text")).join(F.broadcast(ids), ["id", "label"])


def pieces_of(texts: DataFrame) -> DataFrame:
    """``label, piece, weight``: pieces of all words of these texts and how often they occur."""

    def split(batches):
        for batch in slices(batches, "text"):
            codes, bounds, distinct = words(batch.column("text"), lower_ascii=True)
            names = batch.column("label").dictionary_encode()
            label = np.repeat(np.asarray(names.indices, np.int64), np.diff(bounds))
            found, times = np.unique(label * max(1, len(distinct)) + codes, return_counts=True)
            strings = distinct.cast(pa.large_binary()).to_pylist()
            count: dict[tuple[int, bytes], int] = {}
            for key, n in zip(found.tolist(), times.tolist(), strict=True):
                name, code = divmod(key, len(distinct))
                for s in range(0, len(strings[code]), PIECE):
                    at = name, strings[code][s : s + PIECE]
                    count[at] = count.get(at, 0) + n
            if count:
                which = names.dictionary.to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([which[k[0]] for k in count]), pa.array([k[1] for k in count], pa.binary()), pa.array(list(count.values()), pa.int64())], ["label", "piece", "weight"])

    return texts.select("label", "text").mapInArrow(split, "label string, piece binary, weight long").groupBy("label", "piece").agg(F.sum("weight").alias("weight"))


def sample(docs: DataFrame, **columns) -> DataFrame:
    """``label, piece, weight``: whole words of the sampled documents and how often they occur, the commonest of each label."""
    most = F.row_number().over(W.partitionBy("label").orderBy(F.desc("weight"), "piece"))
    return pieces_of(drawn(docs, **columns)).withColumn("at", most).filter(F.col("at") <= SAMPLE_PIECES).drop("at")


def others(pieces: list[bytes], seed: int = 13, number: int = OTHERS) -> list[bytes]:
    """Made-up pieces that are no language's: the given ones shuffled, random characters, letters of one script, one character repeated."""
    rng, out = np.random.default_rng(seed), set()
    plain = [chr(c) for c in (*range(0x61, 0x7B), *range(0x30, 0x3A))]
    for i in range(number):
        if i % 3 == 0:
            made = list(pieces[int(rng.integers(len(pieces)))].decode("utf-8", "ignore"))
            rng.shuffle(made)
        elif i % 3 == 1:
            low, high = SCRIPTS[int(rng.integers(len(SCRIPTS)))]
            made = map(chr, rng.integers(low, high + 1, int(rng.integers(1, 13))))
        else:
            made = [plain[k] for k in rng.integers(len(plain), size=int(rng.integers(2, PIECE + 1)))]
            made = made[:1] * len(made) if i % 12 == 2 else made
        word = "".join(made).encode()
        out.update(word[a : a + PIECE] for a in range(0, len(word), PIECE))
    return sorted({x for x in out if len(x) > 1} - set(pieces))


def fit(docs: DataFrame, **columns) -> ByteGru | None:
    """The network of the labels found."""
    rows = sorted(sample(docs, **columns).toLocalIterator(), key=lambda r: (r.label, bytes(r.piece)))
    labels = sorted({r.label for r in rows})
    if not labels:
        return None
    number = {x: i for i, x in enumerate(labels)}
    return train([bytes(r.piece) for r in rows], np.array([number[r.label] for r in rows]), np.array([r.weight for r in rows], float), labels)


def fit_all(docs: DataFrame) -> ByteGru | None:
    """The network of the labels found and of ``UNKNOWN``, learned from made-up pieces, trained on every piece of every labelled row.

    Pieces are dealt by hash into parts, frequent ones into several with their weight divided. In
    a turn each cell's worker goes on from the common network over its part of that turn, and
    the results are averaged in order of cells.
    """
    pieces = written(pieces_of(docs.filter(labelled()).select(F.col("lang").alias("label"), "text")), "pieces")
    found = {r.label: r for r in pieces.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).collect()}
    if not set(found) - {UNKNOWN}:
        return None
    labels = sorted({*found, UNKNOWN})
    number, cells = {x: i for i, x in enumerate(labels)}, -(-sum(r.n for r in found.values()) // CELL)
    parts = cells * TURNS
    share = F.element_at(F.create_map(*(F.lit(v) for k, r in found.items() for v in (k, CELL * cells / len(found) / r.weight))), F.col("label"))
    many = F.least(F.lit(parts), F.greatest(F.lit(1), F.ceil(F.col("weight") * share))).cast("int")
    dealt = pieces.withColumn("many", many).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = dealt.select("label", "piece", (F.col("weight") / F.col("many")).alias("weight"), F.pmod(F.xxhash64("label", "piece") + F.col("copy"), F.lit(parts)).alias("part"))
    adam = Adam(ByteGru(labels))
    for turn in range(TURNS):
        start, steps = adam.flat(), adam.steps

        def run(batches, turn=turn, start=start, steps=steps):
            def trained(cell: int, rows: list[tuple]) -> pa.RecordBatch:
                own = Adam(ByteGru(labels))
                own.take(start, steps)
                known = [p for _, p, _ in rows]
                made = others(known, cell, OTHERS // TURNS)
                label = np.array([number[x] for x, _, _ in rows] + [number[UNKNOWN]] * len(made))
                weight = [w for _, _, w in rows] + [sum(w for _, _, w in rows) / max(1, len(made))] * len(made)
                passed(own, known + made, label, np.array(weight, float), turn, seed=cell)
                return pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([own.steps], pa.int64()), pa.array([own.flat().tobytes()], pa.binary())], ["cell", "steps", "state"])

            at, rows = None, []
            for batch in batches:
                for cell, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "label", "piece", "weight")), strict=True):
                    if cell != at and rows:
                        yield trained(at, rows)
                        rows = []
                    at = cell
                    rows.append(tuple(row))
            if rows:
                yield trained(at, rows)
            trimmed()

        one = dealt.filter(F.col("part") % TURNS == turn).repartition(cells, "part").sortWithinPartitions("part", "label", "piece")
        got = sorted(one.mapInArrow(run, "cell long, steps long, state binary").collect(), key=lambda r: r.cell)
        if got:
            adam.take(np.mean([np.frombuffer(r.state, np.float32) for r in got], 0), max(r.steps for r in got))
    dropped(pieces)
    return adam.net


def pooled(net: ByteGru, column: pa.Array, most: float = EVIDENCE, plain: bool = False) -> np.ndarray:
    """Log probabilities of each text, ``(rows, labels)``, but for a constant: the mean over its bytes times their number, ``most`` at most.

    With ``plain``, a text that has words of letters is judged by these alone.
    """
    codes, bounds, distinct = words(column, lower_ascii=True)
    strings = distinct.cast(pa.large_binary()).to_pylist()
    owner, pieces = [], []
    for i, s in enumerate(strings):
        for a in range(0, len(s), PIECE):
            owner.append(i)
            pieces.append(s[a : a + PIECE])
    owner = np.array(owner, np.int64)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    order = np.argsort(size, kind="stable")
    total = np.zeros((len(strings), len(net.labels)), np.float64)
    for a in range(0, len(order), 4096):  # pieces of like lengths together
        at = order[a : a + 4096]
        c = coded([pieces[i] for i in at])
        np.add.at(total, owner[at], (net.scores(c) * (c > 0)[:, :, None]).sum(0))
    length = np.bincount(owner, size, len(strings))
    table = np.concatenate((total, length[:, None]), 1)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def summed(of: np.ndarray) -> np.ndarray:
        """Column by column, since a slice has a million words and more."""
        return np.stack([np.bincount(rows, column[codes], len(bounds) - 1) for column in of.T], 1)

    sums = summed(table)
    if plain:
        some = summed(table * np.asarray(pc.match_substring_regex(distinct, PLAIN_WORD))[:, None])
        sums = np.where(some[:, -1:] > 0, some, sums)
    return sums[:, :-1] / np.maximum(1, sums[:, -1:]) * np.minimum(most, np.maximum(1, sums[:, -1:]))


def probabilities(net: ByteGru, column: pa.Array) -> np.ndarray:
    """Probabilities of each text, ``(rows, labels)``."""
    mean = pooled(net, column)
    mean = np.exp(mean - mean.max(1, keepdims=True))
    return mean / mean.sum(1, keepdims=True)


def lettered(column: pa.Array) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(column, r"\pL"), False)


def evidence(net: ByteGru, column: pa.Array) -> np.ndarray:
    """Of a network with ``UNKNOWN``: how much likelier a byte of each text is of the text's best language than of none, in nats."""
    at = net.labels.index(UNKNOWN)
    mean = pooled(net, column, 1, plain=True)
    return np.delete(mean, at, 1).max(1) - mean[:, at]


def positions(net: ByteGru, text: str) -> list[list[str]]:
    """The label of every byte of every piece of a text."""
    pieces = [w[a : a + PIECE] for w in text.encode().lower().split() for a in range(0, len(w), PIECE)]
    if not pieces:
        return []
    best = net.scores(coded(pieces)).argmax(2)
    return [[net.labels[k] for k in best[: len(p), i]] for i, p in enumerate(pieces)]


def identify(docs: DataFrame, net: ByteGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``. The network, a few thousand numbers, goes to the workers with the function."""

    def run(batches):
        for batch in slices(batches, "text"):
            text = batch.column("text")
            known = lettered(text)
            if net is None:
                label, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                p = probabilities(net, text)
                ok = np.asarray(known)
                label = [net.labels[k] if o else UNKNOWN for k, o in zip(p.argmax(1), ok, strict=True)]
                score = p.max(1) * ok
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(label, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = identify(docs, fit(docs))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def judged(docs: DataFrame, net: ByteGru) -> DataFrame:
    """``digest, learned, evidence`` of every text: its SHA-256, whether its row is labelled, and minus infinity without a letter."""

    def run(batches):
        for batch in slices(batches, "text"):
            text = batch.column("text")
            size = np.maximum(1, pc.binary_length(text).to_numpy(zero_copy_only=False))
            found = np.where(np.asarray(lettered(text)), evidence(net, text) + MARGIN * SHORT / size, -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("learned"), pa.array(found, pa.float64())], ["digest", "learned", "evidence"])

    rows = docs.filter(F.col("text").isNotNull()).select("text", F.sha2("text", 256).alias("digest"), (labelled() & (F.col("lang") != UNKNOWN)).alias("learned"))
    return written(rows.mapInArrow(run, "digest string, learned boolean, evidence double"), "evidence")


def threshold(found: DataFrame) -> float:
    """``MARGIN`` below the ``LOW`` quantile of the evidence of all labelled rows, which are counted in steps of ``STEP``."""
    at = F.floor(F.col("evidence") / STEP).alias("at")
    counts = sorted((r.at, r.n) for r in found.filter(F.col("learned") & (F.col("evidence") > float("-inf"))).groupBy(at).agg(F.count(F.lit(1)).alias("n")).collect())
    if not counts:
        return 0.0
    below = np.cumsum([n for _, n in counts])
    return counts[int(np.searchsorted(below, LOW * below[-1]))][0] * STEP - MARGIN


def kept(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents in none of the languages learned go, each row by its own text, with its columns as they are.

    Null texts and texts without a letter go; ids do not matter, so repeated rows and rows
    without an id stay or go alike. Without any label to learn from all rows go, an empty table stays empty.
    """
    net = fit_all(docs)
    if net is None:
        return docs.filter(F.lit(False))
    found = judged(docs, net)
    # Equal texts go together; the digests that go are written, so that Spark knows how many they are.
    gone = written(found.filter(F.col("evidence") < threshold(found)).select(F.col("digest").alias("_gone")).distinct(), "gone")
    dropped(found)
    return docs.filter(F.col("text").isNotNull()).join(gone, F.sha2("text", 256) == F.col("_gone"), "left_anti")
