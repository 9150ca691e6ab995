"""Divergence audit, archives and prefix tries: brute force, odd rows, and what each method rests on."""

import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from convoframe.llm import queries
from convoframe.llm.divergence import Tile, audit_sources, divergence, only_letters, shares
from convoframe.llm.prefix_trie import FACTORS, PRIME, DoubleArray, borrowed_heads, follow, prefix_trie
from convoframe.llm.transcripts import STATES, Model, fit, parse_transcripts, render, viterbi
from convoframe.llm.warc import (
    LoserTree,
    parse,
    read_index,
    read_records,
    record,
    url_key,
    write_archives,
)

# Names that the operators use inside, as further columns of the input.
CLASHES = (
    "row", "n", "term", "place", "total", "value", "rank", "counts", "digest", "size", "payload", "first", "time",
    "conv", "pos", "id", "points", "seg", "said", "chat_id", "owner", "_block", "_at", "part", "item", "kind",
)


def with_clashes(df):
    for name in CLASHES:
        df = df.withColumn(name, F.lit(name))
    return df


# Source divergence


def plain_audit(rows, min_docs=3, limit=200):
    """(lang, source, part, item, value, rank) by the rule as it reads, rows being (text, lang, source)."""
    rows = [tuple(x or "" for x in row) for row in rows]
    out = []
    for lang in {r[1] for r in rows}:
        words = [
            (source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
            for text, own, source in rows
            if own == lang
        ]
        docs = Counter(w for _, ws in words for w in set(ws))
        kept = sorted(w for w, n in docs.items() if n >= min_docs)
        counts = {source: Counter() for source, _ in words}
        for source, ws in words:
            counts[source].update(w for w in ws if docs[w] >= min_docs)
        whole = sum(counts.values(), Counter())

        def p(count, held, size=len(kept)):
            total = sum(held.values())
            return 1 + 10**9 * (count + 1) // (total + size)

        def ranked(found):
            order = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            return [(item, value, k + 1) for k, (item, value) in enumerate(order)]

        for source, held in counts.items():
            pairs = []
            for other, theirs in counts.items():
                if other != source:
                    ps = [(p(held[w], held), p(theirs[w], theirs)) for w in kept]
                    pairs.append((other, sum((a - b) ** 2 // b for a, b in ps)))
            out += [(lang, source, "pair", *x) for x in ranked(pairs)]
            marks = [(w, p(held[w], held), p(whole[w], whole)) for w in kept if held[w]]
            marks = [(w, (a - b) ** 2 // b) for w, a, b in marks if a > b]
            out += [(lang, source, "term", *x) for x in ranked(marks)[:limit]]
    return sorted(out)


def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string"
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)


@pytest.fixture(scope="module")
def mixed():
    """Texts with a hot source, ties, nulls, empty and long texts, repeated rows and letters beyond ASCII."""
    draw = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "É", "ß", "Q", "z")]
    rows = []
    for i in range(240):
        source = "hot" if i % 3 == 0 else f"s{draw.randrange(9)}"
        text = " ".join(draw.choices(words, weights=range(1, len(words) + 1), k=draw.randrange(1, 40)))
        rows.append((text.replace(" x", "-X1"), draw.choice(["en", "en", "de", None]), source))
    rows += [(None, "en", "s1"), ("", "fr", "alone"), ("one two", "fr", None), (None, None, None)]
    rows += [rows[0]] * 5 + [("longword " * 20_000, "en", "s2"), ("a b c", "it", "x"), ("b c d", "it", "y")]
    return rows


@pytest.mark.parametrize("block,parts,limit", [(256, 4, 200), (3, 2, 7), (1, 1, 1)])
def test_audit_equals_brute_force(spark, mixed, block, parts, limit):
    df = with_clashes(documents(spark, mixed)).drop("source").join(
        documents(spark, mixed).select("doc_id", "source"), "doc_id"
    )
    found = audit_sources(df, limit=limit, block=block, parts=parts)
    assert sorted(tuple(r) for r in found.collect()) == plain_audit(mixed, limit=limit)


def test_audit_without_rows_or_terms(spark):
    assert audit_sources(documents(spark, [])).collect() == []
    found = audit_sources(documents(spark, [("only here", "en", "a"), (None, "en", "b")])).collect()
    assert sorted(tuple(r) for r in found) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact():
    draw = random.Random(1)
    for _ in range(2_000):
        total = draw.randrange(1, 9 * 10**15)
        n = draw.randrange(0, total)
        assert shares(np.array([n]), np.array([total]))[0] == 1 + 10**9 * (n + 1) // total


def test_tile_sums_equal_all_cells():
    draw = np.random.default_rng(3)
    counts = [draw.poisson(0.4, (50, 6)), draw.poisson(0.7, (50, 4))]
    weights = draw.integers(1, 9, 50)
    tile = Tile(900, *[(c * weights[:, None]).sum(0) for c in counts])
    tile.base(900)
    tile.add(weights, counts, both=True)
    for k in (0, 1):
        for a in range(counts[k].shape[1]):
            for b in range(counts[1 - k].shape[1]):
                p = shares(counts[k][:, a], np.full(50, tile.totals[k][a]))
                q = shares(counts[1 - k][:, b], np.full(50, tile.totals[1 - k][b]))
                both = (weights * divergence(p, q)).sum() + (900 - weights.sum()) * divergence(
                    tile.zero[k][a], tile.zero[1 - k][b]
                )
                assert tile.sums[k][a, b] == both


def test_only_letters_keep_their_bytes():
    texts = pa.array(["Ab_é9Z\x7f", "", "日本-X"]).slice(0, 3)
    assert only_letters(texts).to_pylist() == ["ab é z ", "", "日本 x"]


# Archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def captures():
    """Pages with shared payloads around 100 bytes, repeated and null ids, odd URLs and nulls."""
    draw = random.Random(2)
    rows = []
    for i in range(400):
        html = f"<p>{draw.randrange(60)}</p>" + "x" * draw.choice([80, 92, 200])
        host = draw.choice(["www.example.com", "Blog.example.com:80", "example.org", "localhost"])
        rows.append((draw.randrange(1_000_000), f"http://{host}/p{draw.randrange(25)}/?b=2&a={draw.randrange(3)}#x", html))
    rows += [(None, None, None), (7, "", ""), (8, "no host\r\nX: 1", "é" * 60), (9, "http://a b/\x00", "é" * 60), (9, "http://c", "é" * 60)]
    rows += [(None, "http://n", "z" * 100), (None, "http://m", "z" * 100), (10, None, "y" * 99), (11, None, "y" * 99)]
    return rows + [rows[0]] * 3


@pytest.mark.parametrize("settings", [{}, {"run": 7, "fan_in": 2, "per_range": 20, "batch": 3}, {"run": 16, "fan_in": 3, "per_range": 5, "batch": 2}])
def test_archives_round_trip(spark, captures, settings):
    df = with_clashes(pages(spark, captures).repartition(5))
    folder, index = write_archives(df, F.timestamp_seconds(F.col("page_id") % 50), **settings)
    entries = read_index(folder, index)
    found = [tuple(r) for r in read_records(folder, entries).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    payloads = [(i, (html or "").encode()) for i, _, html in captures]
    assert Counter((i, size, sha) for i, size, sha, _, _ in found) == Counter(
        (i, len(p), hashlib.sha256(p).hexdigest()) for i, p in payloads
    )
    groups: dict = {}
    for r in found:
        groups.setdefault((r[1], r[2]), []).append(r)
    for (size, _), rows in groups.items():
        first = [r for r in rows if r[3] == "response"]
        ids = [r[0] for r in rows if r[0] is not None]
        if size < 100:
            assert len(first) == len(rows)
        else:
            assert len(first) == 1 and first[0][0] == (min(ids) if ids else None)
            assert all(r[4] == first[0][0] for r in rows if r[3] == "revisit")
    # The index is one order over all of its files: URL key, time, id.
    store, path = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    order = []
    for part in sorted(index.collect(), key=lambda r: r["at"]):
        with store.open_input_file(f"{path}/{part['run']}") as file:
            order += [(r["urlkey"], r["time"], r["page_id"] is None, r["page_id"] or 0) for r in pa.ipc.open_file(file).read_all().to_pylist()]
    assert order == sorted(order) and len(order) == len(captures)
    if settings:
        assert index.count() > 5


def test_archives_without_rows(spark):
    folder, index = write_archives(pages(spark, []))
    assert read_records(folder, read_index(folder, index)).collect() == []


def test_records_are_proved():
    capture = {"record_type": "response", "page_id": 1, "row": 0, "time": "2000-01-01T00:00:00Z", "digest": "d", "url": "http://x"}
    data = record(capture, b"\r\n\r\npay\r\n\r\nload")
    headers, _, payload = parse(data)
    assert payload == b"\r\n\r\npay\r\n\r\nload" and headers["WARC-Target-URI"] == "http://x"
    with pytest.raises(ValueError):
        parse(data.replace(b"load", b"lead"))
    with pytest.raises(ValueError):
        parse(data[:-1])
    assert gzip.decompress(gzip.compress(data, mtime=0)) == data


def test_url_keys():
    assert url_key("HTTP://user@www2.Example.com:80/A/?b=1&a=2#f") == "com,example)/a?a=2&b=1"
    assert url_key("https://example.com") == url_key("http://www.example.com/") == "com,example)/"
    assert url_key("mailto:x") == "mailto:x" and url_key("") == ""


def test_loser_tree_sorts_any_number_of_runs():
    draw = random.Random(4)
    for runs in range(1, 12):
        left = [sorted((draw.randrange(30),) for _ in range(draw.randrange(6))) for _ in range(runs)]
        expected, out = sorted(x for run in left for x in run), []
        tree = LoserTree([run[0] if run else None for run in left])
        while tree.heads[tree.winner] is not None:
            rest = [h for k, h in enumerate(tree.heads) if k != tree.winner and h is not None]
            assert tree.runner_up() == (min(rest) if rest else None)
            out.append(left[tree.winner].pop(0))
            tree.heads[tree.winner] = left[tree.winner][0] if left[tree.winner] else None
            tree.replay(tree.winner)
        assert out == expected


# Prefix tries


def plain_trie(chats):
    """Rows of the trie of {conversation: turns}."""
    nodes: dict = {}
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, members in nodes.items():
        under = [k for k in nodes if k[: len(prefix)] == prefix]
        leaves = sum(not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in nodes) for k in under)
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in under if k)
        ends = ",".join(str(c) for c in sorted(members) if len(chats[c]) == len(prefix))
        children = sum(len(k) == len(prefix) + 1 for k in under)
        parent = min(nodes[prefix[:-1]]) if prefix else None
        out.append((min(members), len(prefix), parent, len(members), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(rows):
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}, own


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.fixture(scope="module")
def talks():
    """Shared openings, copies, a long conversation and its copies, null and repeated turns."""
    draw = random.Random(6)
    rows = []
    for c in [*range(0, 130), *range(205, 230)]:
        for t in range(draw.choice([1, 2, 3, 8])):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["hi", "Hi", "é" * 3, "", "long " * 20])))
    for c in (400, 407, 431):
        rows += [(c, t, "user", f"turn {t % 3}") for t in range(60)]
    rows += [(431, 60, "user", "more"), (500, None, None, None), (500, None, None, None), (500, 1, "user", "x"), (500, 1, "a", "x")]
    rows += [(None, 0, "user", "nobody"), (600, 3, "ab", "c"), (601, 3, "a", "bc"), (600, 3, "ab", "c")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [{}, {"span": 7, "block_turns": 20, "block_rows": 5}, {"span": 1, "block_turns": 1, "block_rows": 1}])
def test_trie_equals_brute_force(spark, talks, settings):
    chats, own = rebuilt(talks)
    df = with_clashes(conversations(spark, talks).repartition(3))
    found = prefix_trie(df, borrowed_heads, **settings).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_trie(chats)
    assert any(not turns for turns in chats.values())
    if not settings:
        found = prefix_trie(df).collect()
        assert sorted((tuple(r) for r in found), key=repr) == plain_trie(own)


def test_trie_without_rows(spark):
    assert prefix_trie(conversations(spark, []), borrowed_heads).collect() == []
    assert prefix_trie(conversations(spark, [(None, 1, "user", "x")])).collect() == []


def test_ends_of_many_copies(spark):
    copies = spark.range(150_000).select(
        F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text")
    )
    root, leaf = sorted(prefix_trie(copies).collect(), key=lambda r: r.depth)
    ids = ",".join(map(str, range(150_000)))
    assert leaf.ends_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    assert (leaf.n_convs, leaf.saved_tokens, root.saved_tokens, root.n_leaves) == (150_000, 149_999 * 4, 149_999 * 4, 1)


def test_double_array_holds_its_children_only():
    draw = random.Random(7)
    trie, children, nodes = DoubleArray(2, 50), {}, [0, 1]
    for _ in range(4):
        pairs = sorted((n, c) for n in nodes for c in draw.sample(range(1, 51), draw.choice([0, 1, 1, 3, 20])))
        if pairs:
            parents, codes = (np.array(x) for x in zip(*pairs, strict=True))
            trie.insert(parents, codes)
            children.update(zip(pairs, trie.step(parents, codes).tolist(), strict=True))
            nodes = [children[p] for p in pairs][:40]
    assert -1 not in children.values() and len(set(children.values())) == len(children)
    for node in {n for n, _ in children}:
        reached = trie.step(np.full(50, node), np.arange(1, 51))
        assert {c + 1 for c in np.flatnonzero(reached >= 0)} == {c for n, c in children if n == node}


def test_prefix_hashes_follow_the_polynomial():
    draw = random.Random(8)
    for factor in FACTORS:
        key = np.array([draw.randrange(PRIME) for _ in range(200)])
        turn = np.array([draw.randrange(1 << 40) for _ in range(200)])
        assert follow(key, factor, turn).tolist() == [(k * factor + t + 1) % PRIME for k, t in zip(key.tolist(), turn.tolist(), strict=True)]


# Transcripts


@pytest.fixture(scope="module")
def speaker_model(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    return Model(*fit(queries.labelled_lines(queries.raw_lines(rows))))


def test_paths_are_the_best_of_all(spark, speaker_model):
    """Against every sequence of states of short transcripts, for any cutting into blocks."""
    draw = random.Random(9)
    lines, best = [], {}
    for t in range(8):
        seen = [draw.randrange(len(speaker_model.lines)) for _ in range(draw.randrange(1, 6))]
        lines += [(t, 3 * i, s) for i, s in enumerate(seen)]
        scores = {}
        for path in itertools.product(range(STATES), repeat=len(seen)):
            steps = zip(seen, [STATES, *path], path, strict=False)
            scores[path] = sum(speaker_model.lines[s, a, b] for s, a, b in steps)
        best[t] = max(scores.values()), scores
    table = spark.createDataFrame(lines, "transcript long, line long, seen int")
    for block, span in ((512, 512), (2, 1), (2, 4)):
        found: dict = {}
        for r in sorted(viterbi(table, speaker_model, block, span).collect()):
            found.setdefault(r.transcript, []).append(r.state)
        for t, path in found.items():
            assert best[t][1][tuple(path)] == pytest.approx(best[t][0])


def test_no_row_of_a_conversation_is_lost(spark, speaker_model):
    """Rows that share a turn number, rows without one, repeated rows and many lines."""
    rows = [(1, 0, "user", "Hello there, how are you?"), (1, 0, "assistant", "I am fine."), (1, None, "user", "Thanks a lot."),
            (1, None, "user", "Thanks a lot."), (2, None, "user", "only this"), (3, 5, "user", "\n".join(f"line {i}" for i in range(3_000))),
            (3, 6, "assistant", None), (None, 0, "user", "whose?")]
    table = with_clashes(conversations(spark, rows))
    raw = queries.raw_lines(table).collect()
    assert Counter((r.transcript, r.role) for r in raw if r["first"]) == Counter((c, role) for c, _, role, _ in rows)
    for c in (1, 2, 3, None):
        own = sorted(r.line for r in raw if r.transcript == c)
        assert own == list(range(len(own)))
    assert [r.role for r in sorted(raw, key=lambda r: r.line) if r.transcript == 1] == ["assistant", "user", "user", "user"]
    lines = queries.raw_lines(table).select("transcript", "line", "text", "blank")
    turns = render(parse_transcripts(lines, speaker_model)).collect()
    assert {r.transcript for r in turns} == {1, 2, 3, None}
    assert all(r.canonical == f"<|{r.role}|>\n{r.text}" for r in turns)
    assert sum(r.text.count("line ") for r in turns) == 3_000
