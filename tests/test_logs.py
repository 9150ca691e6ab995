import json

import pytest
from pyspark.sql import functions as F

from convoframe.functions import ids
from convoframe.functions import logs as rules
from convoframe.operators import logs

RAW = [
    None,
    "",
    "  \n\t ",
    "urllib3 v2 failed\n  Error: no such app \t\r\n",
    "first\nsecond  \nurllib3 failed",
    "CLI v0.2 failed",
    "one\n LIMIT reached \nPermission Denied\x1f",
    "all fine",
    "\n\nnot Found\n\n\ninvalid",
    "warnings.warn error\nCLI v0.3 found at\nplain",
]


def clean(raw):
    """The rule restated line by line."""
    if not raw:
        return "Unknown error occurred"
    lines = [line.strip() for line in raw.strip().split("\n")]
    kept = [x for x in lines if not any(n in x for n in rules.NOISE)
            and any(w in x.lower() for w in rules.ERROR_WORDS)]
    if kept:
        return "\n".join(kept)
    readable = [x for x in lines if x and "CLI v0." not in x]
    return readable[-1] if readable else raw


def test_clean(spark):
    """F10, every noise word, and every word that marks an error."""
    raw = RAW + [f"an error\n{n} error" for n in rules.NOISE] + [f"x\n{w.upper()}\ny" for w in rules.ERROR_WORDS]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    assert [r.message for r in logs.clean_errors(df).collect()] == [clean(r) for r in raw]


def test_classes(spark):
    data = [("Max Limit of SCOPES", "Workspace Limit Reached"), ("max limit", "Error"),
            ("no ACCESS, not found", "Permission Error"), ("Not Found: invalid", "Resource Not Found"),
            ("Bad Request", "Invalid Request"), ("", "Error"), (None, "Error")]
    df = spark.createDataFrame([(m,) for m, _ in data], "message string")
    assert [r.error_type for r in logs.classify_errors(df).collect()] == [c for _, c in data]


JSON = {
    'x [{"a":1}] y': '{"a":1}',
    'log {"s":"}"} end': '{"s":"}"}',
    'log {"q":"\\""} end': '{"q":"\\""}',
    "unbalanced {": None,
    "[1]": "[1]",
    "tail [1, [2]] more": "[1, [2]]",
    'bad {"a":[1}': None,
    '{"a": {"b": [1, 2]}}': '{"a": {"b": [1, 2]}}',
    ' {"a":1} ': ' {"a":1} ',
    '{"a":1} {"b":2}': '{"a":1}',
    '{"a":1,"a":2}': '{"a":1,"a":2}',
    '{not json} {"a":1}': None,
    "NaN": "NaN",
    "12": "12",
    '"text"': '"text"',
    "text": None,
    "": None,
    "   ": None,
    "1,2": None,
    '{"a":1}],[{"b":2}': '{"a":1}',
    '{"a": "end-of-text"}': '{"a": "end-of-text"}',
    'deep {"a":{"b":{"c":"{["}}} x': '{"a":{"b":{"c":"{["}}}',
}


def test_json_parts(spark):
    """F11."""
    df = spark.createDataFrame([(r,) for r in [*JSON, None]], "raw string")
    found = {r.raw: r.json for r in logs.extract_json(df).collect()}
    assert found == {**JSON, None: None}
    for part in filter(None, found.values()):
        json.loads(part)


def test_direct_json_needs_no_python(spark):
    df = spark.createDataFrame([(r,) for r in JSON], "raw string")
    direct = [r.raw for r in df.where(rules.is_json(F.col("raw"))).collect()]
    assert set(direct) == {"[1]", '{"a": {"b": [1, 2]}}', ' {"a":1} ', "12", '"text"'}


def test_listing(spark, rows):
    raw = "\n  Scope  Backend  \n a  X\n\n  b\tY \n c\n"
    df = spark.createDataFrame([("s", raw), ("t", "Scope"), ("u", ""), ("v", None)], "source string, raw string")
    assert rows(logs.parse_listing(df)) == [("s", 1, "a"), ("s", 2, "b"), ("s", 3, "c")]


def test_owner(spark):
    """F12."""
    kind = "emails array<struct<value: string, primary: boolean>>, userName string"
    data = [
        ([("x@y.z", False)], "first.last@corp"),
        ([("a.b@c.d", True), ("e@f", True)], "u"),
        ([(None, True), ("g@h", True)], "u"),
        ([("", True)], "u"),
        (None, None),
    ]
    found = logs.derive_owner(spark.createDataFrame(data, kind)).collect()
    assert [(r.email, r.slug) for r in found] == [
        ("first.last@corp", "first-last"), ("a.b@c.d", "a-b"), ("g@h", "g"), ("u", "u"), (None, None)]
    assert found[1].scope_name == "a-b-chatbot" and found[1].app_name == "a-b-ai-chatbot"
    assert found[1].workspace_path == "/Workspace/Users/a.b@c.d/a-b-ai-chatbot"


def test_first_valid_host(spark):
    kind = ("profiles array<struct<host: string, valid: boolean, cloud: string>>, config_host string, "
            "last_host string")
    data = [
        ([("https://one.eu.example.com", None, "aws"), ("https://two.us.example.com", True, "azure")], "c", "d"),
        ([("https://x.y", False, None)], "https://conf.eu", "d"),
        (None, "", "plain"),
        ([], None, None),
    ]
    found = logs.first_valid(spark.createDataFrame(data, kind)).collect()
    assert [(r.host, r.region, r.cloud) for r in found] == [
        ("https://two.us.example.com", "us", "AZURE"), ("https://conf.eu", "eu", None),
        ("plain", "Unknown", None), (None, None, None)]


def test_secret_refs(spark, rows):
    raw = "a: {{secrets/s1/k1}}, {{secrets/s2/k 2}} {{secrets//x}} {{secret/s/k}}"
    df = spark.createDataFrame([(1, raw), (2, None)], "id int, raw string")
    assert rows(logs.extract_secret_refs(df)) == [(1, "s1", "k1"), (1, "s2", "k 2")]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_chat_ids_do_not_depend_on_the_zone(spark, zone):
    """02:30 on 31 March 2024 does not exist in Berlin."""
    import datetime as dt

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = [dt.datetime(2024, 3, 31, 2, 30, 5, 900000), dt.datetime(2024, 1, 1)]
        df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
        found = df.select(ids.chat_id_from_ts(F.col("ts")).alias("i"))
        back = found.select("i", ids.chat_id_to_ts(F.col("i")).alias("t")).collect()
        assert [r.i for r in back] == ["20240331_023005", "20240101_000000"]
        assert [r.t for r in back] == [t.replace(microsecond=0) for t in times]
        odd = spark.createDataFrame([("chat",), ("20241399_000000",), (None,)], "i string")
        assert [r.t for r in odd.select(ids.chat_id_to_ts(F.col("i")).alias("t")).collect()] == [None] * 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_deeply_nested_text_is_no_json(spark):
    df = spark.createDataFrame([("[" * 200_000,), ('x {"a": 1} y',), ("{" * 200_000 + "}" * 200_000,)], "raw string")
    found = logs.extract_json(df).collect()
    assert len(found) == 3
