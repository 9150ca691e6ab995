"""Registered queries of the operators: against SQL where there is one, else against brute force."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from convoframe.llm import queries
from convoframe.llm.pii import KINDS, luhn

FOLDER = "/root/testdata/sf0.001"
TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean", "INTEGER": "int"}


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in sorted(rows)}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    oracle = duckdb.connect()
    for file in os.listdir(FOLDER):
        oracle.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    ours = queries.QUERIES[name](spark, FOLDER)
    theirs = oracle.execute(queries.SQL[name])
    kinds = {c[0]: TYPES[str(c[1])] for c in theirs.description}
    assert dict(ours.dtypes) == kinds
    order = [list(kinds).index(c) for c in sorted(kinds)]
    expected = sorted(tuple(row[i] for i in order) for row in theirs.fetchall())
    assert sorted(tuple(r) for r in ours.select(*sorted(kinds)).collect()) == expected


def plain_spans(text):
    """The base patterns as they read, without care for speed."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def test_op1_base_spans(spark, texts):
    found = queries.QUERIES["op1_pii"](spark, FOLDER).collect()
    assert len(found) == len(texts)
    for r in found:
        spans = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in spans) for k in KINDS]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
        assert len([x for x in r.spans.split(",") if x]) == len(spans) + r.n_added


def test_op2_records(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary(queries.WORD_BPE))
    expected, start = [], 0
    for doc_id, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.QUERIES["op2_records"](spark, FOLDER).collect()) == expected


def test_op3_recovers_roles(spark):
    turns = queries.QUERIES["op3_transcripts"](spark, FOLDER).collect()
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role, hashlib.sha256(r.text.encode()).hexdigest()))
    found: dict = {}
    for t in sorted(turns, key=lambda t: (t.conv_id, t.turn)):
        found.setdefault(t.conv_id, []).append((t.role, t.text_sha256))
    assert set(found) == set(by)
    right = sum(found[c] == by[c] for c in by)
    assert right >= 0.9 * len(by)


def test_op5_finds_planted_lines(spark, texts):
    from convoframe.llm.licenses import TEMPLATES

    short = ("apache-2.0", "cc-by-nc-4.0", "gpl-3.0", "mit")
    for r in queries.QUERIES["op5_licenses"](spark, FOLDER).collect():
        held = [n for n in short if TEMPLATES[n] in texts[r.doc_id]]
        assert set(held) <= set(r.licenses.split(","))
        if "icense" not in texts[r.doc_id]:
            assert r.n_licenses == 0


def accuracy(spark, name, column, folder):
    scored = queries.QUERIES[name](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    right = sum(r.predicted == r[column] for r in rows) / len(rows)
    clean = [r for r in rows if r[column] == (0 if column == "toxic" else 1)]
    kept = sum(r.predicted == r[column] for r in clean) / len(clean)
    return right, kept


def test_op6_held_out_accuracy(spark):
    right, clean = accuracy(spark, "op6_toxicity", "toxic", "/root/testdata/sf0.1")
    assert right >= 0.95 and clean >= 0.98


def test_op7_held_out_accuracy(spark):
    right, kept = accuracy(spark, "op7_quality", "quality", "/root/testdata/sf0.01")
    assert right >= 0.95 and kept >= 0.97


def test_op9_round_trip(spark, texts):
    found = queries.QUERIES["op9_pieces"](spark, FOLDER).collect()
    assert len(found) == len(texts) and all(r.round_trip for r in found)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in found)
