"""The corpus operators against brute force, SQL, exact round trips and held-out accuracy, on small fixtures."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from oracle import of_query, of_sql
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import chat, common, exact_dedup, language_id, line_dedup, mixing, neighbours, ngram_join, packing, toxicity, warc
from leadloom.llm import words as word_slices
from leadloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def base(n, start=0):
    return " ".join(f"w{start + i}" for i in range(n))


#: Nulls, empty and blank texts, ties, repeats, near copies, white space of all kinds and one very long text.
TEXTS = [None, "", " \t\n", "one", "One", "one two three", base(60), base(60), base(60) + " more", "  " + base(60).upper(), base(61, 1), base(40, 500),
         base(40, 500) + "\x0bx y", "éà ü z " * 3, base(20000, 10000), base(20000, 10000) + " end", "a a a a a a a", "a a a a a a", None]


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert of_query(QUERIES[name](spark, SF)) == of_sql(SQL[name], SF)


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op8_source_mixing"])
def test_same_rows_as_sql_on_awkward_documents(spark, tmp_path, name):
    rows = [(i, t, None, [None, "a", "b", "é"][i % 4], 0) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents"))
    import pyarrow.parquet as pq

    pq.write_table(pq.read_table(tmp_path / "documents"), tmp_path / "documents.parquet")
    assert of_query(QUERIES[name](spark, str(tmp_path))) == of_sql(SQL[name], str(tmp_path))


def shingles(text, k):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def classes(sets, percent):
    top = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((top[i], top[j]))
                top = [low if t == high else t for t in top]
    return top


def test_ngram_join_is_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = list(TEXTS)
    for _ in range(12):
        words = [f"v{x}" for x in rng.integers(0, 400, 80)]
        for edits in (0, 1, 2, 3, 5):
            copy = list(words)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    sets = [shingles(t, 4) for t in texts]
    expected = {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, classes(sets, 85), strict=True))}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.query(spark, docs_of(spark, texts)).collect()}
    assert found == expected


def test_ngram_join_is_brute_force_on_driver_rows(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    sets = [shingles(r.text, 4) for r in rows]
    expected = {r.doc_id: (len(s), rows[c].doc_id) for r, s, c in zip(rows, sets, classes(sets, 85), strict=True)}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_ngram_jaccard_join"](spark, SF).collect()}
    assert found == expected


@pytest.mark.parametrize("block", [2, 7])
def test_large_sets_of_the_join_are_brute_force(spark, block):
    """Families around one long passage, so that candidates connect far more than links do, and chains whose ends don't link."""
    rng = np.random.default_rng(8)
    passage, texts = [f"p{i}" for i in range(70)], []
    for family in range(8):
        own = [f"f{family}-{i}" for i in range(int(rng.integers(4, 40)))]
        for _ in range(9):
            words = passage + own
            for at in rng.integers(0, len(words), int(rng.integers(0, 4))):
                words[at] = f"x{rng.integers(0, 9)}"
            texts.append(" ".join(words))
    texts += [" ".join(f"c{i}" for i in range(start, start + 60)) for start in rng.permutation(30)]
    sets = [shingles(t, 4) for t in texts]
    expected = {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, classes(sets, 85), strict=True))}
    found = ngram_join.near_duplicates(docs_of(spark, texts), k=4, percent=85, rare=5, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()
    truth = {r.doc_id: r for r in docs.collect()}
    rows = language_id.query(spark, docs).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [r for r in rows if r.held_out and truth[r.doc_id].lang and len(truth[r.doc_id].text or "") >= 40]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in judged]) >= 0.95
    for r in rows:
        text = truth[r.doc_id].text
        if text is None or not any(c.isalpha() for c in text):
            assert r.lang_pred == "und"


def test_neighbours_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    found = defaultdict(list)
    for r in sorted(QUERIES["op4_nearest_neighbours"](spark, SF).collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        scores = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        got = found[q]
        assert [r.rank for r in got] == list(range(1, 21))
        assert all(abs(r.score - scores[ids == r.vec_id][0]) < 1e-9 for r in got)
        hit, total = hit + len({r.vec_id for r in got} & set(ids[order])), total + 20
    assert hit / total >= 0.9


def test_neighbours_leave_out_unusable_vectors(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(0, 30)] + [(40, None), (60, [0.0, 0.0]), (80, [None, 1.0]), (100, [float("nan"), 1.0])]
    got = neighbours.query(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.query_id for r in got} == {0, 20} and not {40, 60, 80, 100} & {r.vec_id for r in got}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def line_brute_force(texts, shortest=32, exact=32, edits=2):
    """The place that stays for each line's place."""
    placed = [(i, j, line.strip(" \t\n\x0b\x0c\r")) for i, t in enumerate(texts) if t for j, line in enumerate(t.split("\n"))]
    top = list(range(len(placed)))
    for i, (_, _, a) in enumerate(placed):
        for j in range(i):
            b = placed[j][2]
            if top[i] != top[j] and (a == b and len(a) >= exact or min(len(a), len(b)) >= shortest and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits):
                low, high = sorted((top[i], top[j]))
                top = [low if t == high else t for t in top]
    return {p[:2]: placed[t][:2] for p, t in zip(placed, top, strict=True)}


def edited_lines(seed, groups, head=""):
    rng, lines = np.random.default_rng(seed), []
    for _ in range(groups):
        line = head + "".join(rng.choice(list("abcdefgh "), 45)).strip().ljust(40, "z")
        for edits in (0, 0, 1, 2, 4):
            s = list(line)
            for _ in range(edits):
                at, how = int(rng.integers(1, len(s) - 1)), int(rng.integers(3))
                s[at : at + (how != 1)] = [] if how == 0 else ["é"]
            lines.append("".join(s))
    rng.shuffle(lines)
    return [None, "", "short\nshort", *("\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5))]


def test_lines_are_brute_force(spark):
    texts = edited_lines(5, 25)
    found = {(r.doc_id, r.line_no): (r.keep_doc, r.keep_line) for r in line_dedup.line_classes(docs_of(spark, texts)).collect()}
    assert {k: v for k, v in found.items() if texts[k[0]]} == line_brute_force(texts)


@pytest.mark.parametrize("block", [3, 16])
def test_lines_that_share_segments_are_brute_force(spark, block):
    """Every line starts alike, so that most keys are hot: they are split, and cells of two blocks compare what is left."""
    texts = edited_lines(8, 20, "the same beginning of all of these lines, ")
    found = {(r.doc_id, r.line_no): (r.keep_doc, r.keep_line) for r in line_dedup.line_classes(docs_of(spark, texts), block=block).collect()}
    assert {k: v for k, v in found.items() if texts[k[0]]} == line_brute_force(texts)


def test_line_query_is_brute_force(spark):
    texts = [*edited_lines(9, 12), "Of.\n \nOf.\n", "x" * 1500 + "\n" + "x" * 1499 + "y", " Of. ", "x" * 1499]
    keep = line_brute_force(texts, exact=1)
    want = {i: sorted((j, *keep[i, j]) for k, j in keep if k == i and keep[i, j] != (i, j)) for i in range(len(texts))}
    got = {r.doc_id: r for r in line_dedup.query(spark, docs_of(spark, texts)).collect()}
    assert {i: list(map(tuple, r.dropped)) for i, r in got.items()} == want
    assert {i: (r.n_lines, r.n_dropped) for i, r in got.items()} == {i: (len(t.split("\n")) if t else 0, len(want[i])) for i, t in enumerate(texts)}


def test_distances_of_pairs_drawn_out(spark):
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice(list("ab"), int(rng.integers(3, 60))))
        b = list(a)
        for _ in range(int(rng.integers(0, 5))):
            at = int(rng.integers(0, len(b)))
            b[at : at + 1] = [[], ["c"], ["a", "b"]][int(rng.integers(3))]
        if len(b) > 2:
            pairs.append((a, "".join(b)))
    assert line_dedup.near(pairs, 2).tolist() == [distance(a, b) <= 2 for a, b in pairs]
    assert all(np.bitwise_count(line_dedup.parities(a) ^ line_dedup.parities(b)).sum() <= 4 * distance(a, b) for a, b in pairs)


def test_short_equal_lines_go(spark):
    texts = ["Of.\none line\n\nOf.", "All rights reserved.\n\n Of. \nOff.", "x\nAll rights reserved.\n"]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.query(spark, docs_of(spark, texts)).collect()}
    assert got == {0: (4, 1), 1: (4, 1), 2: (3, 1)}
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(docs_of(spark, texts)).collect()} == {0: "Of.\none line\n", 1: "All rights reserved.\n\nOff.", 2: "x\n"}


def test_line_query_returns_the_classes(spark):
    near = "a line that is long enough to be compared fuzzily"
    texts = [None, f"{near}\nOf.\n", f"Of.\n{near}!", f"own\n\n{near}?\nown"]
    rows = {r.doc_id: r for r in line_dedup.query(spark, docs_of(spark, texts)).collect()}
    assert {k: list(map(tuple, r.dropped)) for k, r in rows.items()} == {0: [], 1: [], 2: [(0, 1, 1), (1, 1, 0)], 3: [(2, 1, 0), (3, 3, 0)]}
    assert all(r.n_dropped == len(r.dropped) for r in rows.values())


def test_language_stage_drops_what_is_no_language(spark):
    clean = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rng = np.random.default_rng(4)
    drawn = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    noise = [" ".join(drawn("abcdefghijklmnopqrstuvwxyz", 7) for _ in range(40)), drawn("bcdfgjkqxz", 300), drawn("абвгдежзиклмнопрст ", 300), drawn("0123456789 ", 300) + "x",
             "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 200))), "hyvää päivää kaikille ystäville jotka ovat tulleet tänne katsomaan kuinka talvi saapuu pohjoiseen", "123 ...", None]
    # Of rows that share an id, or have none, each goes or stays by its own text.
    more = [(10**6 + i if i % 2 else None, t, None, "s", 0) for i, t in enumerate(noise)] + [(10**6 + 1, clean[0][1], None, "s", 0), (None, clean[1][1], None, "s", 0)]
    got = language_id.kept(spark.createDataFrame(clean + more, DOCS)).collect()
    texts = {r.text for r in got}
    assert not texts & set(noise)
    assert len(got) >= len(clean) + 2 - 1 and {(10**6 + 1, clean[0][1]), (None, clean[1][1])} <= {(r.doc_id, r.text) for r in got}


def test_language_stage_keeps_texts_full_of_numbers_and_addresses(spark):
    """Short texts of whatever personal data are in a language nevertheless; none of the driver's documents is in none."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    more = ["+1 (235) 555-3833 Onwhiner be innd 4690149265297988 anon the of theseand in.", "At +1 (619) 555-1368 ingou, hees intion of.", "password=101a821562d3999d51 At anining as a."]
    got = language_id.kept(docs.union(spark.createDataFrame([(10**7 + i, t, "en", "s", len(t)) for i, t in enumerate(more)], DOCS)))
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    lettered = {r.doc_id for r in docs.filter("text rlike '\\\\p{L}'").select("doc_id").collect()}
    assert {10**7 + i for i in range(len(more))} <= ids and len(lettered - ids) <= 1


def test_mixed_stage_takes_each_row_once(spark):
    rows = [(None, f"a{i} b c d", "en", "s", 0) for i in range(6)] + [(7, "x y z w", "en", "s", 0)] * 5 + [(8 + i, "k l m n", "en", "s", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.repeated(docs).collect()
    words = lambda found: sum(len((r.text or "").split()) for r in found)
    assert words(got) == sum(r.taken for r in mixing.query(spark, docs).collect()) == 84
    assert all(1 <= len([r for r in got if r.doc_id is None and r.text.startswith(f"a{i}")]) <= 2 for i in range(6))
    assert 5 <= len([r for r in got if r.doc_id == 7]) <= 10


def test_neighbours_count_repeated_rows_once(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    schema = "vec_id long, embedding array<double>"
    once = sorted(map(tuple, neighbours.query(spark, spark.createDataFrame(rows, schema)).collect()))
    again = sorted(map(tuple, neighbours.query(spark, spark.createDataFrame(rows * 2 + [rows[5]] * 30, schema)).collect()))
    assert again == once and len(once) == 60


def test_neighbours_probe_a_small_share_of_nearly_random_vectors():
    """Uniform directions are the hardest to tell apart by a code: what probes reach, and find, of 50,000."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    projection = neighbours.learn(neighbours._augmented(x[:4096], 1.0))
    asked = np.arange(0, len(x), 500)
    coded = lambda rows: neighbours.codes(neighbours._augmented(rows, 1.0), projection)
    fitted = np.arange(100, len(x), 200)
    found = neighbours.best_of(x, np.arange(len(x)), fitted, x[fitted], 20)
    own = neighbours.codes(np.concatenate((x[fitted], np.zeros((len(fitted), 1))), 1), projection)
    radius = neighbours.radius_of(np.concatenate([neighbours.retrieved_at(coded(x[rows]), own[k]) for k, (rows, _) in enumerate(found)]))
    probes = neighbours.codes(np.concatenate((x[asked], np.zeros((len(asked), 1))), 1), projection)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-scores, 20, axis=1)[:, :20]
    share, hits = 0.0, 0
    for a in range(0, len(x), 25_000):
        block = coded(x[a : a + 25_000])
        reached = neighbours.Index(block).within(probes, radius)
        # Pigeonhole: nothing within the radius is left out.
        assert all(reached[i][np.bitwise_count(block ^ probes[i]).sum(1, dtype=np.int64) <= radius].all() for i in range(3))
        share += reached.sum() / len(asked) / len(x)
        here = (near >= a) & (near < a + 25_000)
        hits += reached[np.nonzero(here)[0], near[here] - a].sum()
    assert share < 0.1 and hits / near.size >= 0.9


def test_neighbours_of_any_magnitude_ties_and_clashing_columns(spark):
    rows = [(i, [float(a), float(b)], "x") for i, (a, b) in enumerate([(1e200, 1), (1, 1e-200), (-1e200, 3), (0, 2), (0, 2), (0, 2), (5, 5)])] + [(None, [1.0, 1.0], "x"), (20, [1.0, 0.0], "y"), (20, [1.0, 0.0], "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string").withColumns({"kind": F.lit("k"), "id": F.lit(None).cast("int"), "v": F.lit("v"), "score": F.lit(0)})
    got = neighbours.query(spark, df).collect()
    for q, v in ((0, rows[0][1]), (20, [1.0, 0.0])):
        others = {r[0]: r[1] for r in rows if r[0] is not None and r[0] != q}
        scores = {i: float(np.float64(x[0]) * v[0] + np.float64(x[1]) * v[1]) for i, x in others.items()}
        want = sorted(scores, key=lambda i: (-scores[i], i))
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, scores[i]) for i in want]


def test_revisits_of_sites_look_back_over_other_records(spark):
    rows = QUERIES["op10_warc_revisits"](spark, "/root/testdata/sf0.01").collect()
    assert {r.status for r in rows} == {"resolved", "changed", "no_validator", "no_response"}
    # A record's own page, id // 2, is never the answer; many answers are in an earlier bucket.
    found = [(r.record_id // 2, r.response_id // 2) for r in rows if r.response_id is not None]
    assert all(a > b for a, b in found)
    assert any(a * warc.STEP // warc.BUCKET > b * warc.STEP // warc.BUCKET for a, b in found)
    assert of_query(QUERIES["op10_warc_revisits"](spark, "/root/testdata/sf0.01")) == of_sql(SQL["op10_warc_revisits"], "/root/testdata/sf0.01")


def test_revisits_are_brute_force(spark):
    rng, kinds = np.random.default_rng(7), ["response", "revisit"]
    records = [(i, f"https://www.s{int(rng.integers(4))}.com/", int(rng.integers(0, 40)) * warc.BUCKET // 4, kinds[int(rng.integers(2))], {"ETag": str(int(rng.integers(3)))}, "x") for i in range(300)]
    df = spark.createDataFrame(records, "record_id long, url string, at long, kind string, headers map<string,string>, bucket string").withColumns({"near": F.lit(1), "status": F.lit("s"), "canonical_url": F.lit("c")})
    got = {r.record_id: (r.status, r.response_id) for r in warc.resolve(df).collect()}
    for i, url, at, kind, headers, _ in records:
        if kind == "revisit":
            earlier = max(((r[2], r[0], r[4]["ETag"]) for r in records if r[3] == "response" and r[1] == url and r[2] < at), default=None)
            assert got.pop(i) == (("no_response", None) if earlier is None else ("resolved", earlier[1]) if earlier[2] == headers["ETag"] else ("changed", None))
    assert not got


def test_canonical_urls(spark):
    urls = ["http://m.com/x", "https://WWW.A.com:443/x/?utm_source=a&utm_medium=b&utm_campaign=c", "https://m.a.com/x?b=1&ref=2&a=3#f", "https://www.com", "https://a.com?gclid=1", "x", "", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", warc.canonical(F.col("u")).alias("c"))
    assert [r.c for r in df.orderBy("i").collect()] == ["m.com/x", "a.com/x", "a.com/x?b=1&a=3", "www.com", "a.com", None, None, None]


def test_positions_are_read_in_lower_case():
    net, text = language_id.ByteGru(list("abcdefgh")), "The Quick BROWN fox Jumps OVER the Lazy DOG"
    assert language_id.positions(net, text) == language_id.positions(net, text.lower())


def test_toxicity_held_out(spark):
    """Learned from two thirds of the labelled documents, judged on the others, whose labels are noisy."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.query(spark, docs, labels.filter("doc_id % 3 <> 0")).collect()}
    assert len(got) == docs.count() and all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in got.values())
    held = [r for r in labels.collect() if r.doc_id % 3 == 0 and r.doc_id in got]
    assert np.mean([got[r.doc_id].toxic == bool(r.toxic) for r in held]) >= 0.85
    assert np.mean([got[r.doc_id].p_toxic for r in held if r.toxic]) > 2 * np.mean([got[r.doc_id].p_toxic for r in held if not r.toxic])


def test_toxicity_of_awkward_rows(spark):
    texts = [*(f"good calm words here {i % 7}" for i in range(40)), *(f"vile awful slur there {i % 7}" for i in range(40)), None, "", "  ", "vile awful " * 30000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(0, texts[0], "k"), (None, "vile awful slur", "k")], "doc_id long, text string, id string").withColumns({"digest": F.lit(1), "toxic": F.lit("t"), "n": F.lit(1)})
    labels = spark.createDataFrame([(i, int(i < 40), int(i >= 40)) for i in range(80)] + [(3, None, 1), (4, 1, None), (None, 1, 1), (5, 0, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.query(spark, docs, labels).collect()
    assert len(rows) == len(texts) + 2
    told = {r.doc_id: (r.toxic, round(r.p_toxic, 12)) for r in rows}
    assert told == {r.doc_id: (r.toxic, round(r.p_toxic, 12)) for r in toxicity.query(spark, docs.repartition(7), labels.repartition(3)).collect()}
    assert told[83][0] and told[None][0] and told[50][0] and not told[7][0] and [told[i] for i in (80, 81, 82)] == [(False, 0.0)] * 3
    assert all(not r.toxic and r.p_toxic == 0 for r in toxicity.query(spark, docs, labels.limit(0)).collect())


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_path())
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in TEXTS]
    rows = packing.query(spark, docs_of(spark, TEXTS)).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for table, full in ((pieces, {i: len(x) for i, x in enumerate(ids)}), (windows, None)):
        for k, spans in table.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at and length > 0
                at += length
            assert at == full[k] if full else at <= 4096
    assert set(pieces) == set(range(len(TEXTS)))


def test_best_fit_is_the_tightest_window_for_each_piece():
    rng = np.random.default_rng(3)
    lengths = np.concatenate((rng.integers(1, 100, 300), rng.integers(1, 400, 40)))
    window, rooms = 64, []
    for need in sorted((int(n) % window for n in lengths), reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= need]
        if need and fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= need
        elif need:
            rooms.append(window - need)
    # Nothing is dissolved at full slack: what is used of each window is what the plain search leaves.
    used = sorted(sum(x[2] for x in b) for b in packing.best_fit(lengths, window, 1.0))
    assert used == sorted([window - r for r in rooms] + [window] * int((lengths // window).sum()))


def test_mixing_with_many_sources_is_sql(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(n)), None, None if n % 17 == 0 else f"s{int(k):03d}", 0) for i, (n, k) in enumerate(zip(rng.integers(0, 60, 600), rng.integers(0, 150, 600), strict=True))]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents"))
    pq.write_table(pq.read_table(tmp_path / "documents"), tmp_path / "documents.parquet")
    assert of_query(QUERIES["op8_source_mixing"](spark, str(tmp_path))) == of_sql(SQL["op8_source_mixing"], str(tmp_path))


def test_mixing_bounds(spark):
    rows = QUERIES["op8_source_mixing"](spark, SF).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op8_source_mixing"](spark, SF).collect()))


def test_preference_prompt_is_the_common_prefix(spark):
    turns = [(2, 0, "user", "q"), (2, 1, "assistant", "good"), (3, 0, "user", "q"), (3, 1, "assistant", "bad"), (4, 0, None, None), (None, 0, "user", "x")]
    got = {(r.pair_id, r.part): r for r in chat.query(spark, spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, "prompt"].text == "<|user|>\nq<|end|>\n" and got[1, "prompt"].learned == ""
    for side, word in (("chosen", "good"), ("rejected", "bad")):
        start, end = map(int, got[1, side].learned.split(":"))
        assert got[1, side].text[start:end] == word + "<|end|>\n"
    assert (2, "prompt") not in got and got[2, "chosen"].text == "<|user|>\n<|end|>\n" and len(got) == 4


def test_revisits_take_the_latest_earlier_response(spark):
    step = warc.BUCKET
    records = [
        (1, "http://www.a.com/x/", 0, "response", {"etag": "1", "content-type": "t"}), (2, "https://a.com/x#f", 5 * step, "response", {"etag": "2"}),
        (3, "http://a.com/x?utm_source=q", 4 * step, "revisit", {"etag": "W/1", "server": "s", "date": "d"}), (4, "http://a.com/x", 9 * step, "revisit", {"etag": "1"}),
        (5, "http://b.com/", 1, "revisit", {"etag": "1"}), (6, None, 1, "revisit", None), (7, "http://a.com/x", 0, "revisit", {"etag": "1"}), (8, "http://a.com/x", 7 * step, "revisit", None),
    ]
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(records, "record_id long, url string, at long, kind string, headers map<string,string>")).collect()}
    assert {k: r.status for k, r in got.items()} == {3: "resolved", 4: "changed", 5: "no_response", 6: "no_response", 7: "no_response", 8: "no_validator"}
    assert got[3].response_id == 1 and got[3].headers == {"etag": "W/1", "content-type": "t", "date": "d"}


@pytest.mark.parametrize("operator", [ngram_join.query, language_id.query, exact_dedup.query, line_dedup.query, mixing.query, packing.query])
def test_empty_documents(spark, operator):
    assert operator(spark, spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("operator", [ngram_join.query, language_id.query, exact_dedup.query, line_dedup.query, mixing.query, packing.query])
def test_clashing_columns_and_repeated_null_rows(spark, operator):
    names = "size long, digest string, id string, component string, a long, b long, key string, sig string, n long, at long, line string, target double"
    rows = [(None, "x y z w v", "en", "s", 1, *[None] * 12), *[(7, "x y z w v", "en", None, 1, *[None] * 12)] * 2, *[(8, None, None, None, None, *[None] * 12)] * 2]
    got = operator(spark, spark.createDataFrame(rows, f"{DOCS}, {names}")).collect()
    assert {r.doc_id for r in got} >= {7, 8}


def test_empty_tables_of_the_others(spark):
    assert neighbours.query(spark, spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []
    assert chat.query(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert warc.query(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert toxicity.query(spark, spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_digest_index_over_batches_and_reopened(spark):
    """Three batches, the index opened anew for each: the anti-join takes out what earlier batches had, and sizes count them."""
    path = common.fresh_path(spark, "index-test")
    batches = [["a b", "c", "c"], ["ab", "C", "d", None], ["a\tb  ", "d", ""]]
    base, seen = 0, []
    for texts in batches:
        index = exact_dedup.DigestIndex(spark, path)
        docs = spark.createDataFrame([(base + i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
        groups = exact_dedup.grouped(exact_dedup.digests(docs))
        new = {"".join((t or "").split()) for t in texts} - set(seen)
        assert index.unseen(groups).count() == len(new)
        got = {r.id: (r.keep_id, r.group_size) for r in exact_dedup.deduplicate(docs, index).collect()}
        seen += ["".join((t or "").split()) for t in texts]
        assert got == {base + i: (seen.index(k), seen.count(k)) for i, k in enumerate("".join((t or "").split()) for t in texts)}
        base += len(texts)
        spark.catalog.refreshTable(index.name)
    best = {r.digest: r.keep_id for r in index.held(best=True).collect()}
    assert sorted(best.values()) == sorted([7, 1, 4, 5, 6]) and index.held().count() == 5
    plan = index.unseen(groups)._jdf.queryExecution().executedPlan().toString()
    # The batch's rows are dealt by digest; the index's buckets are read where they are.
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan and "Bucketed: false" not in plan


def test_a_small_batch_does_not_carry_the_index_along(spark):
    index = exact_dedup.DigestIndex(spark, common.fresh_path(spark, "index-hot"), 4)
    many = spark.createDataFrame([(i, f"t{i // 2}", None, None, 0) for i in range(4000)], DOCS)
    exact_dedup.deduplicate(many, index).count()
    few = spark.createDataFrame([(5000 + i, f"t{i}", None, None, 0) for i in range(3)], DOCS)
    assert {(r.id, r.keep_id, r.group_size) for r in exact_dedup.deduplicate(few, index).collect()} == {(5000 + i, 2 * i, 3) for i in range(3)}
    assert index.held().filter(F.col("group_size") >= max(2, int(exact_dedup.HOT_SHARE * 4003))).count() == 0


STAGE_ROWS = [(1, "one two three four five six", "en", "s", 5), (1, "another text by the same number", "en", "s", 5), (None, "a text without a number at all", "en", None, 5), (None, "one  two three four five\tsix", "en", "s", 5),
              (2, "one two three four five six", "en", "s", 5), (2, "one two three four five six", "en", "s", 5), (3, None, None, None, None), (4, "", "en", "s", 0), (5, " ", "en", "s", 0), (6, "long " * 30000, "en", "s", 0)]


def test_exact_dedup_stage_acts_on_rows(spark):
    """Rows of one id with other texts stay, exact repeats go, null, empty and blank texts are one group."""
    got = exact_dedup.kept(spark.createDataFrame(STAGE_ROWS, DOCS)).collect()
    assert sorted(((r.doc_id, (r.text or "")[:12]) for r in got), key=str) == sorted([(1, "another text"), (None, "a text witho"), (None, "one  two thr"), (5, " "), (6, "long long lo")], key=str)
    twice = exact_dedup.kept(spark.createDataFrame([(2, "x y", "en", "s", 3)] * 9 + [(None, "z", None, None, 1)] * 3, DOCS)).collect()
    assert sorted((r.text for r in twice)) == ["x y", "z"]


def test_join_stage_acts_on_rows(spark):
    base_text = " ".join(f"u{i}" for i in range(60))
    rows = [(7, base_text, "en", "s", 1), (7, "quite another text of more than five words", "en", "s", 1), (None, base_text + " x", "en", "s", 1), (3, base_text + " y", "en", "s", 1), (9, None, None, None, None), (9, "", None, None, None), (None, " ", None, None, None), (4, "quite another text of more than five words", "en", "s", 1)]
    got = ngram_join.kept(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id, (r.text or "")[-5:]) for r in got), key=str) == sorted([(3, "u59 y"), (4, "words"), (9, ""), (9, ""), (None, " ")], key=str)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_and_empty_tables(spark, stage):
    names = ["_row", "cls", "digest", "keep_id", "key", "label", "evidence", "component_id"]
    docs = spark.createDataFrame(STAGE_ROWS, DOCS).withColumns({n: F.lit(n) for n in names if n != "_row"})
    out = stage(spark, docs, SF)
    assert out.collect() is not None and (out.columns == docs.columns or "sequence_id" in out.columns)
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_pipeline_keeps_clean_documents_and_packs(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language ID" and rows
    windows = defaultdict(int)
    for r in rows:
        windows[r.sequence_id] += r.length
    assert max(windows.values()) <= 4096


def test_language_stage_learns_from_every_labelled_row(spark, monkeypatch):
    """a language of few pieces among many documents of a label, each in one document only, and the threshold's count of all rows."""
    rng = np.random.default_rng(8)
    word = lambda letters: "".join(rng.choice(list(letters), 6))
    rows = [(i, " ".join(word("abcdefg") if i % 2 else word("pqrstuv") for _ in range(12)), "x" if i % 2 else "y", "s", 0) for i in range(2400)]
    docs = spark.createDataFrame(rows, DOCS)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(learned) > 2 * language_id.SAMPLE_DOCS
    seen = []
    whole = language_id.pieces_of
    monkeypatch.setattr(language_id, "pieces_of", lambda texts: seen.append(whole(texts)) or seen[-1])
    net = language_id.fit_all(docs)
    assert {(r.label, bytes(r.piece).decode()) for r in seen[0].collect()} == {(r[2], w) for r in learned for w in r[1].split()}
    found = language_id.judged(docs, net)
    values = sorted(r.evidence for r in found.filter("learned").collect())
    assert len(values) == len(learned)
    low = values[max(0, int(np.ceil(language_id.LOW * len(values))) - 1)]
    assert 0 <= low - language_id.MARGIN - language_id.threshold(found) <= language_id.STEP
    assert language_id.kept(docs).count() == len(rows)


def test_slices_give_free_memory_back(monkeypatch):
    """Workers live on for the stages that follow: after each slice, not only at the end."""
    given = []
    monkeypatch.setattr(word_slices, "trimmed", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (word_slices.SLICE_BYTES - 1)] * 3)], ["text"])
    assert [len(given) for _ in word_slices.slices([batch], "text")] == [0, 1, 2] and len(given) == 3


def _lying(spark) -> set[str]:
    folder = Path(common.shared_dir(spark).removeprefix("file://")) / "leadloom"
    return {str(p) for p in folder.iterdir()} if folder.exists() else set()


def test_rows_of_files_are_numbered_without_a_copy(spark, tmp_path):
    """Rows have the same numbers in every reading, however the files are split; files listed twice get a written table."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i % 7, f"t {i}", None, None, 1) for i in range(3000)], DOCS).repartition(5).write.parquet(path)
    docs, before = spark.read.parquet(path), _lying(spark)
    rows = common.numbered(docs)
    assert rows.columns == [*docs.columns, "_row"] and not _lying(spark) - before
    first = {r._row: r.text for r in rows.collect()}
    assert len(first) == 3000 and first == {r._row: r.text for r in common.numbered(docs.select("text")).collect()}
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert first == {r._row: r.text for r in common.numbered(docs).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    for others in (spark.read.parquet(path, path), docs.union(docs), docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))):
        assert common.numbered(others).select("_row").distinct().count() == 6000


@pytest.mark.parametrize("stage", [exact_dedup.kept, ngram_join.kept, mixing.repeated])
def test_stages_leave_no_copies_of_texts_behind(spark, tmp_path, stage):
    """Pipeline: what a stage has written on the way is deleted, and texts of files are not copied."""
    made = spark.createDataFrame(STAGE_ROWS, DOCS)
    made.write.parquet(str(tmp_path / "docs"))
    before = _lying(spark)
    out = stage(spark.read.parquet(str(tmp_path / "docs")))
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in _lying(spark) - before]
    assert not {"numbered", "files", "digests", "digest-index", "groups", "shingle-sets", "representatives", "signatures"} & set(left)
    if stage != mixing.repeated:  # there, equal ids and sizes are told apart by number
        assert sorted(map(repr, out.collect())) == sorted(map(repr, stage(made).collect()))
    else:
        assert out.count() == stage(made).count()
