import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convoframe import session
from convoframe.operators import generate, retrieval, usage
from convoframe.operators.chats import title_prompts
from convoframe.operators.messages import build_prompts
from convoframe.plans import QUERIES
from convoframe.streaming import autosave

WORDS = [f"w{i}" for i in range(60)]


def corpus(rng, n=150):
    """Words of very different frequency; many copies; an empty document."""
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    docs = [" ".join(rng.choices(WORDS, weights, k=rng.randrange(1, 30))) for _ in range(n)]
    docs[10:30] = [docs[0]] * 20
    docs[40] = "?!"
    return docs


def brute_force(questions, docs, k, max_share=1.0):
    split = [Counter(re.findall(r"\w+", d.lower())) for d in docs]
    average = sum(sum(c.values()) for c in split) / len(docs)
    df = Counter(t for c in split for t in c)
    best = {}
    for q, text in questions:
        scores = {}
        for d, counts in enumerate(split):
            for t in set(re.findall(r"\w+", text.lower())) & set(counts):
                if df[t] > max_share * len(docs):
                    continue
                idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                tf, size = counts[t], sum(counts.values())
                share = tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / average))
                scores[d] = scores.get(d, 0) + int(math.floor(idf * share * 1e6 + 0.5))
        ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        best[q] = [(d, s / 1e6) for d, s in ranked]
    return best


@pytest.mark.parametrize(
    "k,seeds,spare,share",
    [(3, 0, 0, None), (3, 4, 0.4, None), (1, 1, 0.9, None), (5, 2, 0.0, None), (3, 4, 1.0, 0.3), (200, 4, 0.4, None)],
)
def test_search_equals_brute_force(spark, monkeypatch, k, seeds, spare, share):
    """For any choice of how much to prune; many copies of one question."""
    monkeypatch.setattr(retrieval, "_SEED_TERMS", seeds)
    monkeypatch.setattr(retrieval, "_SPARE", spare)
    rng = random.Random(k)
    docs = corpus(rng)
    asked = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 9)))) for i in range(30)]
    asked += [(i, "W0 w1, w7!") for i in range(30, 45)] + [(50, ""), (51, "unknown"), (52, "w0 w0")]
    expected = brute_force(asked, docs, k, share or 1.0)
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    queries = spark.createDataFrame(asked, "q bigint, content string")
    found: dict = {q: [] for q, _ in asked}
    for r in sorted(retrieval.search_documents(queries, table, k, max_df_share=share).collect()):
        assert r["rank"] == len(found[r.q]) + 1
        found[r.q].append((r.doc_id, r.score))
    assert found == expected


@pytest.mark.parametrize("k,cell,share", [(1, 100, None), (3, 3_000_000, None), (3, 40, 0.3), (200, 500, None)])
def test_many_questions_equal_brute_force(spark, monkeypatch, k, cell, share):
    """Scored in cells of any size; no step writes more rows than the best of each cell and the texts' terms."""
    monkeypatch.setattr(retrieval, "_CELL", cell)
    written = []
    monkeypatch.setattr(session, "observers", [written.append])
    rng = random.Random(k)
    docs = corpus(rng, 400)
    asked = [(i, " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(60)], k=rng.randrange(1, 30)))) for i in range(300)]
    asked += [(300, ""), (301, "unknown"), (302, "W0 w0"), (303, " ".join(WORDS))]
    table = spark.createDataFrame([*enumerate(docs), (400, None)], "doc_id bigint, text string")
    queries = spark.createDataFrame(asked, "q bigint, content string")
    hits = retrieval.search_documents(queries, table, k, max_df_share=share)
    found: dict = {q: [] for q, _ in asked}
    for r in sorted(hits.collect()):
        assert r["rank"] == len(found[r.q]) + 1
        found[r.q].append((r.doc_id, r.score))
    assert found == brute_force(asked, [*docs, ""], k, share or 1.0)
    assert max(df.count() for df in written) <= len(asked) * k + len(docs) + 1


def test_documents_of_cells_share_ids_and_scores(spark, monkeypatch):
    """Ids may be structs; texts with one id are one document; a term may add nothing and is found all the same."""
    monkeypatch.setattr(retrieval, "_FEW_QUESTIONS", 0)
    monkeypatch.setattr(retrieval, "_SCALE", 1)
    docs = spark.createDataFrame(
        [((1, "b"), "fox"), ((1, "b"), "fox hen"), ((1, "a"), "cow"), ((2, "a"), "fox cat")],
        "doc_id struct<n: int, s: string>, text string",
    )
    asked = spark.createDataFrame([(0, "fox"), (1, "hen"), (2, "ox")], "q int, content string")
    found = retrieval.search_documents(asked, docs, 5).collect()
    assert sorted((r.q, r["rank"], tuple(r.doc_id)) for r in found) == [
        (0, 1, (1, "b")), (0, 2, (2, "a")), (1, 1, (1, "b"))]


def test_cells_give_no_more_than_their_task(spark, monkeypatch):
    """However many cells there are: the questions and the best documents are shuffled once for each task."""
    rng = random.Random(5)
    docs = corpus(rng, 400)
    index = retrieval.index_documents(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"))
    asked = spark.createDataFrame([(i, WORDS[i : i + 5], [1.0] * 5) for i in range(20)], "_q bigint, terms array<string>, idfs array<double>")
    found = {}
    for cell in (10, 1_000_000):
        monkeypatch.setattr(retrieval, "_CELL", cell)
        monkeypatch.setattr(retrieval, "_TEXTS", 1)
        scored = retrieval._cell_scores(asked, index, 3)
        found[cell] = sorted((r._q, r.doc_id, r.points) for r in scored.collect())
        assert len(found[cell]) <= 2 * spark.sparkContext.defaultParallelism * 20 * 3
    assert found[10] == found[1_000_000]


@pytest.mark.parametrize("scale,k,dense", [(1, 4, 16), (10, 3, 1_000), (1_000_000, 5, 16), (100_000_000, 2, 4), (1_000_000, 90, 16)])
def test_cells_of_one_task_equal_brute_force(monkeypatch, scale, k, dense):
    """Terms that add nothing, equal scores, sums beyond 32 bits, shared ids, and cells that improve on earlier ones."""
    monkeypatch.setattr(retrieval, "_DENSE", dense)
    rng = np.random.default_rng(k)
    idfs = {w: (1e-8 if scale == 1 and i < 3 else 0.1 + 0.09 * i) for i, w in enumerate(WORDS)}
    texts = []
    for i in range(600):
        terms = rng.choice(WORDS, rng.integers(1, 40), replace=False).tolist()
        texts.append((i // 2 if 100 <= i < 140 else i, terms, rng.integers(1, 4, len(terms)).tolist()))
    texts += [(600, ["w5", "w59"], [1, 1])] * 3000
    texts.sort(key=lambda t: t[0])
    asked = [rng.choice([*WORDS, "other"], rng.integers(1, 30), replace=False).tolist() for _ in range(60)] + [["w0"], ["other"], WORDS]
    scores: list[dict] = [{} for _ in asked]
    for doc, terms, tfs in texts:
        share = {w: tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * sum(tfs) / 30.0)) for w, tf in zip(terms, tfs)}
        for q, words in enumerate(asked):
            if set(words) & set(terms):
                points = sum(math.floor(idfs[w] * share[w] * scale + 0.5) for w in words if w in share)
                scores[q][doc] = scores[q].get(doc, 0) + points
    expected = [sorted(((-p, d) for d, p in s.items()))[:k] for s in scores]

    def cell(some, first):
        table = pa.table({"doc_id": [t[0] for t in some], "n_tokens": [sum(t[2]) for t in some],
                          "terms": [" ".join(t[1]) for t in some], "tfs": pa.array([t[2] for t in some], pa.list_(pa.int32()))})
        return retrieval._Cell(table, 30.0, k, scale, first)

    numbers = {w: i for i, w in enumerate([*WORDS, "other"])}
    terms = pa.table({"term": list(numbers), "idf": [idfs.get(w, 1.0) for w in numbers]})
    questions = pa.table({"_q": list(range(len(asked))), "terms": pa.array([[numbers[w] for w in q] for q in asked], pa.list_(pa.int32()))})
    best = np.full((2, len(asked), k), -1)
    ids = []
    for start, end in ((0, 60), (60, 150), (150, len(texts))):
        # A cell ends where an id does.
        while 0 < start < len(texts) and texts[start][0] == texts[start - 1][0]:
            start += 1
        while end < len(texts) and texts[end][0] == texts[end - 1][0]:
            end += 1
        part = cell(texts[start:end], len(ids))
        ids += part.ids.to_pylist()
        part.answer(best, terms, questions)
    found = [[(-p, ids[at]) for p, at in zip(*best[:, q].tolist()) if at >= 0] for q in range(len(asked))]
    assert found == expected


def test_corpus_goes_once_it_is_indexed(spark, tmp_path):
    """The files of the corpus are not kept while documents are searched, nor after."""
    spark.createDataFrame([(1, 'red "fox",\n  hen '), (2, "red cow"), (3, None)], "doc_id bigint, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, 0, "user", "Hen?"), (7, 1, "assistant", "cow")], "conv_id bigint, turn bigint, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    with session.scratch_paths() as made:
        found = QUERIES["x8_read_corpus"](spark, str(tmp_path)).collect()
    assert [(r.chat_id, r.turn, r.doc_id) for r in found] == [(7, 0, "1")]
    (corpus_path,) = [p for p in made if "/corpus-" in p and "corpus-" in p.rsplit("/", 1)[1] and not _has_parquet(spark, p)]
    where = spark._jvm.org.apache.hadoop.fs.Path(corpus_path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _has_parquet(spark, path):
    return any(name.endswith(".parquet") for name in session.text_files(spark).names(path))


def test_index_serves_several_searches(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen")], "doc_id bigint, text string")
    index = retrieval.index_documents(docs)
    for word, doc in (("fox", 1), ("hen", 2)):
        asked = spark.createDataFrame([(0, word)], "q int, content string")
        assert [r.doc_id for r in retrieval.search_documents(asked, index).collect()] == [doc]


MSGS = "chat_id string, turn bigint, role string, content string"


@pytest.fixture
def talk(spark):
    return spark.createDataFrame(
        [("a", 0, "user", "one fox"), ("a", 1, "assistant", "a Fox?"), ("a", 2, "user", "boom"),
         ("b", 0, "user", "Red hen 12")], MSGS)


def test_augment(spark, talk):
    hits = spark.createDataFrame(
        [("a", 2, 2, "second"), ("a", 2, 1, "first")], "chat_id string, turn bigint, rank bigint, snippet string")
    found = {(r.chat_id, r.turn): [(m.role, m.content) for m in r.prompt]
             for r in retrieval.augment_prompts(build_prompts(talk), hits).collect()}
    assert found["a", 2][1:] == [
        ("user", "one fox"), ("assistant", "a Fox?"), ("system", "Search results:\nfirst\nsecond"), ("human", "boom")]
    assert len(found["b", 0]) == 2


def model_factory():
    """A factory as a caller would bring it: replies are texts or objects with a content."""

    class Reply:
        def __init__(self, content):
            self.content = content

    def make():
        def model(prompt):
            if prompt[-1]["content"] == "boom":
                raise ValueError("no answer")
            text = f" {prompt[0]['role']} {len(prompt)} "
            return Reply(text) if len(prompt) > 2 else text

        return model

    return make


def test_generate(talk):
    prompts = build_prompts(talk)
    found = generate.batch_generate(prompts, model_factory(), on_error="record", strip=True)
    assert {(r.chat_id, r.turn): (r.response, r.error) for r in found.collect()} == {
        ("a", 0): ("system 2", None), ("a", 2): (None, "ValueError: no answer"), ("b", 0): ("system 2", None)}
    with pytest.raises(Exception, match="no answer"):
        generate.batch_generate(prompts, model_factory()).collect()
    with pytest.raises(ValueError):
        generate.batch_generate(prompts, model_factory(), on_error="ignore")


def test_titles_from_a_model(spark, talk):
    """Two prompt messages; the reply is stripped; chats with a name are not asked for."""
    names = spark.createDataFrame([("a", ""), ("b", "Kept")], "chat_id string, chat_name string")
    prompts = title_prompts(talk, names)
    (found,) = generate.batch_generate(prompts, model_factory(), strip=True).collect()
    assert (found.chat_id, found.response) == ("a", "system 2")
    assert prompts.first().prompt[1].content.endswith("one fox")


def test_search_messages(talk, rows):
    def found(q, mode):
        return [(r[0], r[1]) for r in rows(usage.search_messages(talk, q, mode))]

    assert found("FOX", "contains") == [("a", 0), ("a", 1)]
    assert found(r"\d+$", "regex") == [("b", 0)]
    with pytest.raises(ValueError):
        found("x", "other")


def test_rank_messages(spark, talk):
    asked = spark.createDataFrame([(0, "fox one")], "q int, content string")
    found = sorted(usage.rank_messages(asked, talk).collect(), key=lambda r: r["rank"])
    assert [(r.hit_chat_id, r.hit_turn) for r in found] == [("a", 0), ("a", 1)]


def test_usage(spark, talk, rows):
    assert rows(usage.token_counts(talk)) == [("a", "assistant", 2, 1), ("a", "user", 3, 2), ("b", "user", 3, 1)]
    prices = spark.createDataFrame([("m", 0.5)], "model string, per_1k double")
    spent = spark.createDataFrame([("m", 2000), ("n", 1)], "model string, tokens bigint")
    assert rows(usage.estimate_cost(spent, prices)) == [("m", 2000, 0.5, 1.0), ("n", 1, None, None)]
    dated = talk.replace({"a": "20240101_000000"}, subset="chat_id")
    assert rows(usage.usage_stats(dated)) == sorted([
        ("20240101", "user", 1, 2, 11), ("20240101", "assistant", 1, 1, 6), ("20240101", None, 1, 3, 17),
        ("other", "user", 1, 1, 10), ("other", None, 1, 1, 10), (None, None, 2, 4, 27)], key=repr)


def test_log_metrics(spark, at, rows):
    log = spark.createDataFrame(
        [(at(0), "Error: permission"), (at(10), "no access"), (at(4000), "")], "ts timestamp_ntz, raw string")
    assert rows(usage.log_metrics(log)) == [
        (at(0), "Permission Error", 2, 9), (at(3600), "Error", 1, 0)]


def test_autosave_equals_the_batch_table(spark, tmp_path, rows):
    """Messages arrive in files, some again with other texts; a repeated batch changes nothing."""
    kind = MSGS + ", saved bigint"
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    saves = [[("a", 0, "user", "draft", 1), ("a", 0, "user", "sent", 2)],
             [("a", 1, "assistant", "reply", 3), ("b", 0, "user", "x", 4)],
             [("a", 0, "user", "edited", 5)]]

    def run():
        stream = spark.readStream.schema(kind).parquet(source)
        query = autosave.stream_autosave(stream, path, str(tmp_path / "cp"), ("saved",), available_now=True)
        query.awaitTermination()
        return autosave.read_autosave(spark, path, stream.schema, ("saved",))

    for rows_of_file in saves:
        spark.createDataFrame(rows_of_file, kind).coalesce(1).write.mode("append").parquet(source)
        current = run()
    expected = [("a", 0, "user", "edited", 5), ("a", 1, "assistant", "reply", 3), ("b", 0, "user", "x", 4)]
    assert rows(current) == expected
    assert rows(run()) == expected


def test_two_streams_save_to_one_table(spark, tmp_path, rows):
    """Streams with checkpoints of their own, on one path: neither replaces the other's batches."""
    kind = MSGS
    path = str(tmp_path / "table")
    for name, content in (("one", "a"), ("two", "b")):
        source = str(tmp_path / name)
        spark.createDataFrame([(name, 0, "user", content)], kind).write.parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        for _ in range(2):
            run = autosave.stream_autosave(stream, path, str(tmp_path / f"cp-{name}"), available_now=True)
            run.awaitTermination()
    assert rows(autosave.read_autosave(spark, path, stream.schema)) == [("one", 0, "user", "a"), ("two", 0, "user", "b")]


def test_a_message_saved_twice_needs_a_version(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 0, "user", "x"), ("a", 0, "user", "y")], MSGS).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(MSGS).parquet(source)
    run = autosave.stream_autosave(stream, str(tmp_path / "t"), str(tmp_path / "cp"), available_now=True)
    with pytest.raises(Exception, match="version"):
        run.awaitTermination()


def test_frequent_words_are_pruned_by_blocks(spark, monkeypatch):
    """Questions of the five commonest terms look into less than a tenth of the documents, and lose no hit."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    held = [(r.doc_id, r.text) for r in docs.collect()]
    split = {d: Counter(re.findall(r"[^\W_]+", t.lower())) for d, t in held}
    common = [t for t, _ in Counter(t for c in split.values() for t in c).most_common(5)]
    asked = [(i, " ".join(words)) for i, words in enumerate(itertools.combinations(common, 3))] + [(99, " ".join(common))]
    index = retrieval.index_documents(docs)
    kept = []
    whole = retrieval._kept_blocks

    def seen(*args):
        found = whole(*args)
        kept.append(found[0])
        return found

    monkeypatch.setattr(retrieval, "_kept_blocks", seen)
    hits = retrieval.search_documents(spark.createDataFrame(asked, "q bigint, content string"), index, 5).collect()
    sizes = index.postings.select("block", "doc_id").distinct().groupBy("block").count()
    pairs = kept[0].join(sizes, "block").agg(F.sum("count")).first()[0]
    assert pairs < 0.1 * len(asked) * len(held)
    average = sum(sum(c.values()) for c in split.values()) / len(split)
    df = Counter(t for c in split.values() for t in c)
    for q, text in asked:
        scores = {}
        for d, counts in split.items():
            size = sum(counts.values())
            for t in text.split():
                if counts[t]:
                    idf = math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5))
                    share = counts[t] * 2.2 / (counts[t] + 1.2 * (1 - 0.75 + 0.75 * size / average))
                    scores[d] = scores.get(d, 0) + int(math.floor(idf * share * 1e6 + 0.5))
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [(r.doc_id, round(r.score * 1e6)) for r in sorted(hits, key=lambda r: r["rank"]) if r.q == q] == best
