"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoframe.llm import queries
from convoframe.llm.common import WORKER_BATCH, WORKER_BYTES
from convoframe.llm.components import connected_components
from convoframe.llm.cuckoo import CuckooFilter, CuckooIndex, exact_duplicates
from convoframe.llm.decontaminate import contaminated
from convoframe.llm.features import INNER, RUNS_AT_ONCE, sampled_features, word_grams
from convoframe.llm.licenses import scan_licenses
from convoframe.llm.near_dup import bands_for, near_duplicates, shingle_hashes, signatures
from convoframe.llm.pieces import LONGEST_UNIT, SPACE, Pieces, _group_edges, best_paths, decode, encode
from convoframe.llm.pii import base_spans, find_pii, training_parts
from convoframe.llm.quality import dual_descent, score_quality
from convoframe.llm.records import TextEncoder, frame, parse, payload, read_one, read_records, unframe, write_records
from convoframe.llm.toxicity import score_toxicity
from convoframe.llm.transcripts import Model, parse_transcripts, split_transcripts, viterbi

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
# Names that the operators use inside, as columns of the input.
CLASHES = ("row", "id", "n", "key", "group", "digest", "block", "score", "label", "w", "window", "source")

WORD = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in both columns, empty and blank texts, a long one, ties and repeated rows."""
    long = " ".join(random.Random(1).choices(WORD, k=30_000)) + " x" * 5 + "y" * 3_000
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "same words here again"), (5, "same words here again")]
    rows += [(5, "same words here again"), (5, "other words"), (7, long), (None, None), (8, "Same  words\there again")]
    df = table(spark, rows)
    for name in CLASHES:
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def brute_classes(rows, linked):
    """Least id reachable over links, null last, for each row."""
    left, out = set(range(len(rows))), {}
    while left:
        seen, todo = set(), [min(left)]
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += [b for b in left if b not in seen and linked(rows[a], rows[b])]
        ids = [rows[i][0] for i in seen if rows[i][0] is not None]
        for i in seen:
            out[i] = min(ids) if ids else None
        left -= seen
    return out


def test_exact_duplicates(spark, odd, none):
    rows = [(r.doc_id, re.sub(r"[ \t-\r]+", " ", r.text or "")) for r in odd.collect()]
    expected = brute_classes(rows, lambda a, b: a[1] == b[1])
    found = exact_duplicates(odd).collect()
    assert sorted([(repr(r.doc_id), repr(r.keep_id)) for r in found]) == sorted(
        (repr(rows[i][0]), repr(k)) for i, k in expected.items()
    )
    assert sum(r.kept for r in found) == len({t for _, t in rows})
    assert exact_duplicates(none).count() == 0


def test_cuckoo_filter_resizes_and_deletes():
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3_000)]
    made = CuckooFilter.of(digests, 4)
    assert all(d in made for d in digests) and made.buckets >= 750
    for d in digests[:1_500]:
        made.remove(d)
    assert all(d in made for d in digests[1_500:])
    assert sum(d in made for d in digests[:1_500]) < 30


def test_index_inserts_looks_up_and_deletes(spark):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(399)]
    rows = lambda names: spark.createDataFrame([(d, i, i) for i, d in enumerate(names)], "digest string, id long, row long")
    index = CuckooIndex(spark, 3).insert(rows(digests[:300])).insert(rows(digests[200:300] * 2))
    assert index.keys().count() == 300
    index = index.delete(rows(digests[:100])).delete(rows(digests[200:300]))
    live = {r.digest: r for r in index.lookup(rows(digests)).collect()}
    assert len(live) == 399
    assert {d for d, r in live.items() if r.live} == set(digests[100:300])
    assert live[digests[250]].copies == 2 and live[digests[150]].copies == 1
    assert all(r.maybe for r in live.values() if r.live)


def shingles(text, size):
    words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def alike(percent, size):
    def linked(a, b):
        x, y = shingles(a[1], size), shingles(b[1], size)
        return bool(x and y) and 100 * len(x & y) >= percent * len(x | y)

    return linked


def near_rows(seed, base_words, copies, edits):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4_000)]
    rows, doc_id = [], 0
    for _ in range(6):
        base = draw.choices(vocabulary, k=base_words)
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.randint(0, edits)):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            rows.append((doc_id, " ".join(text)))
            doc_id += 1
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("base_words,copies,edits", [(120, 12, 9), (9, 8, 1), (300, 5, 20)])
def test_near_duplicates_equal_brute_force(spark, base_words, copies, edits):
    rows = near_rows(3, base_words, copies, edits)
    expected = brute_classes(rows, alike(85, 3))
    # Small blocks and no broadcast take every path.
    found = near_duplicates(table(spark, rows), 3, 85, 8, broadcast_nodes=0, block=4).collect()
    assert {r.doc_id: r.component_id for r in found} == {rows[i][0]: k for i, k in expected.items()}
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingles(t, 3)) for i, t in rows}


def test_near_duplicates_on_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = near_duplicates(odd, 3, 85, 8).collect()
    expected = brute_classes(rows, alike(85, 3))
    assert sorted((repr(r.doc_id), repr(r.component_id)) for r in found) == sorted(
        (repr(rows[i][0]), repr(k)) for i, k in expected.items()
    )
    blank = [r for r in found if r.n_shingles == 0]
    assert len(blank) == 4 and all(r.kept for r in blank)
    assert near_duplicates(none).count() == 0


def test_densified_bins_agree_as_often_as_sets_do():
    draw = random.Random(5)
    agreed, total = 0, 0
    for _ in range(60):
        words = [f"v{draw.random()}" for _ in range(25)]
        texts = pa.array([" ".join(words[:23]), " ".join(words[2:])])
        offsets, hashes = shingle_hashes(texts, 1)
        sig = signatures(offsets, hashes, 256)
        agreed += int((sig[0] == sig[1]).sum())
        total += 256
    assert abs(agreed / total - 21 / 25) < 0.05
    assert (1 - 0.85**8) ** bands_for(0.85, 8) <= 1e-7


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 150)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    named = {r.node: r.component for r in got}
    assert all(named[i] == 0 for i in range(41))
    assert all(named[i] == 100 for i in range(100, 160)) and named[200] == 100
    assert len(got) == len(named)


def brute_hits(text, items, width=10):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    words, hit, ids = cut(text), set(), set()
    for item, content in items:
        own = cut(content)
        size = min(width, len(own))
        for s in range(len(own) - size + 1 if own else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == own[s : s + size]:
                    hit.update(range(p, p + size))
                    ids.add(str(item))
    return len(words), len(hit), len(ids)


ITEMS = [
    (1, "One two THREE four five six seven eight nine ten eleven twelve"),
    (2, "tiny item"),
    (3, "x"),
    (4, None),
    (5, "..."),
    (6, "éa éb"),
    (7, "two three four five six seven eight nine ten eleven, twelve thirteen"),
    (8, "the the the the the the the the the the the"),
]


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_contaminated_equals_brute_force(spark, broadcast):
    texts = [
        "zero one two three four five six seven eight nine ten eleven twelve thirteen",
        "a TINY item, x tiny item",
        None,
        "",
        "!!",
        "x",
        "Éa éb éa éb",
        "the " * 14,
        "nine ten eleven twelve one two three four five six seven eight nine",
        "-one two three four five six seven eight nine ten-",
    ]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit(1))
    docs = table(spark, rows).withColumn("window", F.lit(1)).withColumn("token", F.lit(2))
    found = contaminated(docs, items, broadcast_prefixes=broadcast).collect()
    expected = [(i, *brute_hits(t, ITEMS)) for i, t in rows]
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items)) for r in found)
    assert all(r.contaminated == (r.n_hit > 0) for r in found)


def test_contaminated_without_rows(spark, none, odd):
    items = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(none, items).count() == 0
    found = contaminated(odd, items).collect()
    assert len(found) == odd.count() and not any(r.contaminated for r in found)


def test_pii_on_odd_rows(spark, odd, none):
    found = find_pii(odd).collect()
    assert len(found) == odd.count() and all(r.n_email == 0 for r in found)
    assert find_pii(none).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c_d@e.f g@h i@j.k@l.m",
        "a@b@c.d @x.y z@.q",
        "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.04 1..2.3.4 " + "9" * 5_000 + ".1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559 12",
        "+1 (555) 123-4567 ++44 20 7946 0958- +12 +1.2.3.4.5.6.7.8.9.1",
        "é@é.é x@y.zé 😀a@b.co",
        "x" * 20_000,
        "1" * 20_000,
        "+1" + "(" * 3_000,
    ],
)
def test_base_spans_equal_plain_patterns(text):
    from test_llm_queries import plain_spans

    if "9" * 5_000 in text:
        text_short = text.replace("9" * 5_000, "9" * 50)
        assert base_spans(text_short) == plain_spans(text_short)
        assert base_spans(text)
    elif len(text) < 10_000:
        assert base_spans(text) == plain_spans(text)
    else:
        base_spans(text)


def test_field_adds_disguised_spans(spark):
    draw = random.Random(2)
    rows = []
    for i in range(120):
        mail = f"n{draw.randrange(99)}.k{draw.randrange(99)}@mail{draw.randrange(9)}.example.com"
        phone = f"+1 ({draw.randrange(200, 999)}) 555-{draw.randrange(1000, 9999)}"
        rows.append((i, f"some words {mail} and more\nthen call {phone} or wait"))
    rows.append((900, "write to jo.doe[at]site7.example.com today"))
    rows.append((901, "no data 12 here, 7 apples and 2024 years"))
    found = {r.doc_id: r for r in find_pii(table(spark, rows)).collect()}
    assert found[900].n_email == 0 and found[900].n_added == 1 and found[900].spans.startswith("email:9:")
    assert found[901].n_added == 0
    assert all(found[i].n_email == 1 and found[i].n_phone == 1 for i in range(120))


@pytest.mark.parametrize("score,column", [(score_toxicity, "toxic"), (score_quality, "quality")])
def test_scores_on_odd_rows(spark, odd, none, score, column):
    labels = spark.createDataFrame(
        [(1, 0), (2, 1), (3, None), (None, 1), (5, 1), (5, 0), (7, 0), (8, 1)], f"doc_id long, {column} int"
    ).withColumn("text", F.lit("clash"))
    found = score(odd, labels).collect()
    assert len(found) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
    assert score(none, labels).count() == 0
    assert score(odd, labels.limit(0)).count() == odd.count()


def test_inner_runs_of_a_whole_word():
    draw = random.Random(8)
    long = "".join(draw.choices("abcdefgéß漢字", k=300))
    chunks = [long, "", "toxin", "a1b", f"x-{long[100:140]}", long[200:204], long[290:]]
    starts, hashes = word_grams(pa.array(chunks))
    own = [set(hashes[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert len(own[0]) == len({long[i : i + INNER] for i in range(296)}) + 5 and own[1] == set()
    # Runs are the same wherever they stand; the word and its beginnings are of its own.
    assert [len(own[0] & x) for x in own] == [len(own[0]), 0, 0, 0, 36, 0, 6]
    assert len(own[2]) == 4 and len(own[3]) == 2 and len(own[5]) == 3
    starts, hashes = word_grams(pa.array(["z" * RUNS_AT_ONCE + long, long]))
    assert len(np.intersect1d(hashes[: starts[1]], hashes[starts[1] :])) == len({long[i : i + INNER] for i in range(296)})


def test_toxic_word_late_in_an_unspaced_run(spark):
    draw = random.Random(9)
    toxic = ["grumblewortish", "snarklebladder", "vexomandibule"]
    rows, labels = [], []
    for i in range(600):
        words = draw.choices(WORD, k=12)
        if i % 4 == 0:
            words[3] = draw.choice(toxic)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    glued, bad = "".join(draw.choices(WORD, k=40)), "".join(toxic)
    rows += [(1_000, glued), (1_001, glued[:9] + bad + glued[9:]), (1_002, glued[:90] + bad), (1_003, glued + bad)]
    found = score_toxicity(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    named = {r.doc_id: r for r in found}
    assert [named[i].predicted for i in range(1_000, 1_004)] == [0, 1, 1, 1]
    assert named[1_003].score == pytest.approx(named[1_002].score, abs=0.05)


def test_sample_of_a_hot_id_is_bounded(spark):
    rows = [(i, f"text {i}") for i in range(50)] + [(7, f"hot {i}") for i in range(400)]
    docs = table(spark, rows)
    for limit, expected in ((100, 50), (20, 20)):
        labels, features = sampled_features(docs, docs.select("doc_id", F.lit(0).alias("label")), limit, 20, False)
        assert len(labels) == len(features) == expected


def test_dual_descent_separates():
    lists = [np.array([0, 1]), np.array([0, 2]), np.array([3, 1]), np.array([3, 2])]
    y = np.array([1.0, 1.0, -1.0, -1.0])
    w = dual_descent(lists, [np.full(2, 0.7)] * 4, y, 4, np.ones(4), epochs=50)
    assert all(y[i] * (w[lists[i]] * 0.7).sum() > 0.5 for i in range(4))


def test_records_frame_and_checksum():
    data = payload(-5, np.array([1, 70_000, 3], dtype=np.uint32))
    framed = frame(data)
    body, end = unframe(memoryview(framed))
    assert body == data and end == len(framed)
    doc_id, ids = parse(body)
    assert doc_id == -5 and ids.tolist() == [1, 70_000, 3]
    assert parse(payload(None, np.array([2], dtype=np.uint32)))[0] is None
    for at in (0, 9, 14, len(framed) - 1):
        bad = bytearray(framed)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            unframe(memoryview(bytes(bad)))


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    file = queries.vocabulary(queries.WORD_BPE)
    library = Tokenizer.from_file(file)
    draw = random.Random(4)
    letters = "aAbÉéßİıſ'sΣς ́ﬁÿŸ9٣ \t\n\r\x0b\x0c\x1c  .,!<|endoftext|>😀漢字's't"
    texts = ["".join(draw.choices(letters, k=draw.randrange(30))) for _ in range(800)]
    texts += ["", "don't WE'LL", "<|startoftext|> a<|endoftext|>b", "é É", "Ünïcödé, naïve!!", None]
    offsets, ids = TextEncoder(file).encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_records_of_odd_rows(spark, odd, none):
    file = queries.vocabulary(queries.WORD_BPE)
    folder, manifest = write_records(odd, file)
    found = sorted(read_records(manifest, folder).collect(), key=lambda r: r.start)
    assert len(found) == odd.count()
    ids = [r.doc_id for r in found]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:], strict=False))
    empty = zlib.crc32(np.array([2], dtype="<u4").tobytes())
    assert sum(r.n_tokens == 1 and r.ids_crc32 == empty for r in found) == 4
    name = manifest.orderBy("part").first().file
    doc_id, own = read_one(folder, name, 0)
    assert doc_id is None and own[-1] == 2
    folder, manifest = write_records(none, file)
    assert read_records(manifest, folder).count() == 0


def test_pieces_of_odd_rows(spark, odd, none):
    file = queries.vocabulary(queries.PIECES)
    pieces = Pieces.load(file)
    texts = ["a  b", " lead", "tail ", "   ", "é😀\n\n漢字", "<s> </s>", "x" * 500, "tab\tand\r\n", "ab " * 40, None, "▁", "a\0b \0\0 c"]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r.ids for r in encode(table(spark, rows).withColumn("ids", F.lit(1)), file, buckets=3).collect()}
    for i, text in rows:
        assert found[i] == (pieces.best_path(SPACE + text.replace(" ", SPACE)) if text else []), repr(text)
    assert len("x" * 500) > LONGEST_UNIT
    back = {r.doc_id: r.text for r in decode(encode(table(spark, rows), file), file).collect()}
    assert all(back[i] == (t or "").replace(SPACE, " ") for i, t in rows)
    assert encode(odd, file).count() == odd.count()
    (alone,) = encode(table(spark, [(1, "\0")]), file).collect()
    assert alone.ids == pieces.best_path(SPACE + "\0")
    assert encode(none, file).count() == 0 and decode(encode(none, file), file).count() == 0


def test_edges_are_folded_by_ends(spark):
    """A row for each unit has a list for each end; many ties, letters without a piece and letters of four bytes."""
    names = ["a", "b", "aa", "ab", "ba", "aab", "bb😀", "😀"]
    scores = [-1.0, -1.0, -2.0, -2.0, -2.0, -3.0, -2.5, -1.0]
    pieces = Pieces(names, scores, [True] * len(names), list(range(300, 556)))
    draw = random.Random(9)
    drawn = {"".join(draw.choices("abé😀", (5, 5, 1, 1), k=draw.randrange(1, LONGEST_UNIT + 1))) for _ in range(400)}
    units = spark.createDataFrame([(i % 3, u) for i, u in enumerate(sorted(drawn | {"a", "é"}))], "bucket int, unit string")
    found = best_paths(units, pieces).collect()
    assert {r.unit for r in found} == drawn | {"a", "é"} and len(found) == units.count()
    for r in found:
        ids = [i for p in r.ids for i in ([p] if p >= 0 else pieces.bytes_of(r.unit[-1 - p]))]
        assert ids == pieces.best_path(r.unit), r.unit
    edge = [(e << 27) + (s << 20) + n for e, s, n in ((1, 0, 1), (2, 0, 3), (2, 1, 1), (1, 0, 2))]
    columns = [pa.array([0, None, None, 1], pa.int32()), pa.array(["aa", None, None, "b"]), pa.array(edge)]
    (aa,), (b,) = (x.to_pylist() for x in _group_edges([pa.RecordBatch.from_arrays(columns, names=["bucket", "unit", "edge"])]))
    assert aa["ends"] == [[1], [3, (1 << 20) + 1]] and b["ends"] == [[2]]


def test_batches_for_workers_are_bounded_in_bytes(spark):
    was = spark.conf.getAll.get(WORKER_BATCH)
    try:
        spark.conf.unset(WORKER_BATCH)
        encode(table(spark, [(1, "a")]), queries.vocabulary(queries.PIECES))
        assert int(spark.conf.get(WORKER_BATCH)) == WORKER_BYTES

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

        texts = spark.range(0, 3_000, 1, 1).select(F.expr("repeat('0123456789', 400)").alias("text"))
        found = [r.bytes for r in texts.mapInArrow(sizes, "bytes long").collect()]
        assert len(found) > 1 and max(found) < 1.1 * WORKER_BYTES
        # A size that the session names stays.
        spark.conf.set(WORKER_BATCH, "9000000")
        encode(table(spark, [(1, "a")]), queries.vocabulary(queries.PIECES))
        assert spark.conf.get(WORKER_BATCH) == "9000000"
    finally:
        spark.conf.unset(WORKER_BATCH)
        if was:
            spark.conf.set(WORKER_BATCH, was)


def test_best_path_equals_the_library_on_a_unigram_model(tmp_path):
    """The same pieces and scores, with the file's type set to the one whose rule is the best path."""
    import sentencepiece

    file = queries.vocabulary(queries.PIECES)
    data = open(file, "rb").read()
    # trainer_spec.model_type is the field 18 02 (BPE) after the model prefix; 18 01 is the best-path type.
    at = data.rindex(b"\x18\x02\x20\x80\xfa\x01")
    changed = tmp_path / "unigram.model"
    changed.write_bytes(data[:at] + b"\x18\x01" + data[at + 2 :])
    library = sentencepiece.SentencePieceProcessor(model_file=str(changed))
    pieces = Pieces.load(file)
    draw = random.Random(6)
    words = ["".join(draw.choices("abcdefghinorstu", k=draw.randrange(1, 14))) for _ in range(500)]
    for word in words + ["Hello", "größe", "naïve", "l'été"]:
        assert pieces.best_path(SPACE + word) == library.encode(word), word


def test_licenses_on_odd_rows(spark, odd, none):
    assert all(r.matches == [] for r in scan_licenses(odd).collect())
    assert scan_licenses(none).count() == 0
    templates = {"long": " ".join(f"t{i}" for i in range(40)), "two": "zig zag", "blank": "..."}
    part = " ".join(f"t{i}" for i in range(3, 39))
    rows = [(1, "pre " * 13 + templates["long"]), (2, f"ZIG, zag {part}"), (3, "t1 t2 t3 t4 t5 t6"), (4, "zig x zag")]
    for per_block in (2_000, 1):
        found = scan_licenses(table(spark, rows), templates, per_block=per_block).collect()
        names = {r.doc_id: [m.license for m in r.matches] for r in found}
        assert names == {1: ["long"], 2: ["long", "two"], 3: [], 4: []}


NOTICES = {
    "mit": "Distributed under the MIT Licence, see the file",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0. If a copy was not given",
    "epl-2.0": "made available under the terms of the Eclipse Public License 2.0 as it is",
    "cc0-1.0": "To the extent possible under law, given out under CC0 1.0 Universal",
    "cc-by-4.0": "This text is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-3.0": "see <https://creativecommons.org/licenses/by-sa/3.0/> for more",
    "isc": "SPDX-License-Identifier: ISC",
    "zlib": "use is granted under the zlib license",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "bsd-3-clause": "published under the three-clause BSD license",
    "gpl-3.0": "you may copy it under the GNU GPL v3 or what you like",
    "lgpl-2.1": "covered by the GNU Lesser General Public License, version 2.1",
    "apache-2.0": "Published subject to the Apache License 2.0 by its authors",
    "": "a MIT professor and a licence to fish, apache helicopters, general public",
}
# Bodies with one changed word and without their openings.
BODIES = {
    "mit": "obtaining a copy of this software and associated documentation files, to deal in the Software without any "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to",
    "isc": "Permission to use, copy, change, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event shall the authors be "
    "held liable for any damages arising from the use of this software.",
    "mpl-2.0": "You may choose to offer, and to charge a price for, warranty, support, indemnity or liability obligations "
    "to one or more recipients of Covered Software. However, You may do so only on Your own behalf, and not on behalf of "
    "any Contributor. You must make it absolutely clear that any such warranty, support, indemnity, or liability "
    "obligation is offered by You alone, and You hereby agree to indemnify every Contributor for any liability incurred "
    "by such Contributor as a result of warranty, support, indemnity or liability terms You offer. You may include "
    "additional disclaimers of warranty and limitations of liability specific to any jurisdiction.",
    "lgpl": "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by",
}


def test_licenses_in_other_words(spark, tmp_path):
    texts = [*NOTICES.items(), *BODIES.items()]
    rows = [(i, f"{'some words before ' * 9}{text} {'and words after ' * 7}") for i, (_, text) in enumerate(texts)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.QUERIES["op5_licenses"](spark, str(tmp_path)).collect()}
    assert [found[i].licenses for i in range(len(texts))] == [name for name, _ in texts]
    assert all(found[i].n_licenses == bool(name) for i, (name, _) in enumerate(texts))


def test_viterbi_is_the_same_for_every_block_size(spark):
    draw = np.random.default_rng(0)
    model = Model(np.log(draw.random((7, 6))), np.log(draw.random((6, 96))))
    rows = [(t, i * 3, int(draw.integers(96))) for t, n in (("a", 300), ("b", 1), ("c", 40)) for i in range(n)]
    rows += [(None, i, int(draw.integers(96))) for i in range(20)]
    lines = spark.createDataFrame(rows, "transcript string, line long, seen int")
    whole = sorted(map(repr, viterbi(lines, model, 4_096, 4_096).collect()))
    assert len(whole) == len(rows)
    assert sorted(map(repr, viterbi(lines, model, 3, 8).collect())) == whole


def test_transcripts_on_odd_rows(spark):
    model = Model(*queries.fit(queries.labelled_lines(queries.raw_lines(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")))))
    texts = [("a", "User: hi\nthere\n\nAssistant: hello\n\nthanks"), ("b", None), ("c", ""), (None, "Human: x")]
    raw = spark.createDataFrame(texts, "transcript string, text string")
    lines = split_transcripts(raw)
    lines = lines.unionByName(lines.where("transcript = 'a'"))
    turns = sorted((tuple(r) for r in parse_transcripts(lines, model).collect()), key=repr)
    assert ("a", 1, "user", "hi\nthere") in turns and ("a", 2, "assistant", "hello") in turns
    assert (None, 1, "user", "x") in turns
    assert {t[0] for t in turns} == {"a", None}
    assert parse_transcripts(lines.limit(0), model).count() == 0


def test_training_texts_are_different_and_bounded(spark):
    rows = [(i, "mail a.b@c.example now") for i in range(50)] + [(None, None), (60, ""), (61, "plain words")]
    rows += [(100 + i, f"x\ncall +49 30 555 {i:04d}\n" * 9) for i in range(20)]
    found = training_parts(table(spark, rows), texts=15, parts=2)
    assert len(found) == len(set(found)) == 15
    assert all(p.count("\n") <= 1 for p in found)
    everything = training_parts(table(spark, rows), texts=100)
    assert len(everything) == 21 and "mail a.b@c.example now" in everything
    assert training_parts(table(spark, rows).limit(0)) == []
    assert training_parts(table(spark, [(1, "z" * 500 + "+1" + "z" * 500)]), letters=7) == ["z" * 7 + "+1" + "z" * 7]
