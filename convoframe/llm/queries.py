"""Queries of the operators over the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoframe.llm.common import held_out, table
from convoframe.llm.cuckoo import exact_duplicates
from convoframe.llm.decontaminate import contaminated
from convoframe.llm.divergence import audit_sources
from convoframe.llm.licenses import scan_licenses
from convoframe.llm.near_dup import near_duplicates
from convoframe.llm.pieces import encode_and_decode
from convoframe.llm.pii import find_pii
from convoframe.llm.prefix_trie import borrowed_heads, prefix_trie
from convoframe.llm.quality import score_quality
from convoframe.llm.records import read_records, write_records
from convoframe.llm.toxicity import score_toxicity
from convoframe.llm.transcripts import Model, fit, parse_transcripts, render, role_state
from convoframe.llm.warc import read_index, write_archives
from convoframe.llm.warc import read_records as read_captures
from convoframe.operators.messages import number_turns
from convoframe.session import materialise

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(
    r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents
)
select doc_id, min(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
  doc_id = min(doc_id) over (partition by h) as kept, h as text_sha256
from d
"""
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


# Links of full shingle sets, then components by following links from each document.
NEAR_DUP_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents
), s as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')))
    end as shingles
  from w
), n as (
  select doc_id, len(shingles) as n_shingles from s
), e as (
  select doc_id, unnest(shingles) as shingle from s
), p as (
  select a.doc_id as u, b.doc_id as v, count(*) as common
  from e a join e b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v
  where 100 * common >= 85 * (a.n_shingles + b.n_shingles - common)
), reach as (
  select doc_id as u, doc_id as v from n
  union
  select r.u, l.v from reach r join links l on l.u = r.v
), c as (
  select u as doc_id, min(v) as component_id from reach group by 1
)
select doc_id, n_shingles, component_id, doc_id = component_id as kept from n join c using (doc_id)
"""


@query(NEAR_DUP_SQL)
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85, rows=8)


@query(
    r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words
  from documents
), b as (
  select item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words
  from benchmark
), windows as (
  select distinct item_id, len(ws) as k, array_to_string(ws, ' ') as ws from (
    select item_id, unnest(case when len(words) = 0 then [] when len(words) < 10 then [words]
      else list_transform(range(1, len(words) - 8), lambda i: words[i:i + 9]) end) as ws
    from b)
), sizes as (
  select distinct k from windows
), found as (
  select doc_id, i, k, item_id from (
    select doc_id, k, i, array_to_string(words[i:i + k - 1], ' ') as ws from (
      select doc_id, words, k, unnest(range(1, len(words) - k + 2)) as i from d, sizes)) x
  join windows using (k, ws)
), hits as (
  select doc_id, count(distinct p) as n_hit from (
    select doc_id, unnest(range(i, i + k)) as p from found) group by 1
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (
    select distinct doc_id, cast(item_id as varchar) as item from found) group by 1
)
select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
  coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""
)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


@query()
def op2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_records(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))
    return read_records(manifest, folder)


@query()
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text that they decode to, as digests."""
    docs = table(spark, sf_dir, "documents")
    file = vocabulary(PIECES)
    row = F.struct(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    found = encode_and_decode(docs.select(row.alias("row"), "text"), file, key="row")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("text", 256).alias("decoded_sha256"),
        (F.sha2("text", 256) == F.col("row.sha")).alias("round_trip"),
    )


@query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    kinds = [f"n_{kind}" for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *kinds, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


@query()
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of each text, a family (gpl) only where none of its versions (gpl-3.0) is, and the templates' places."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array_distinct(F.transform("matches", lambda m: F.substring_index(m["license"], "#", 1)))
    found = found.withColumn("every", F.array_sort(names))
    finer = lambda name: F.exists("every", lambda other: F.startswith(other, F.concat(name, F.lit("-"))))
    found = found.withColumn("names", F.filter("every", lambda name: ~finer(name)))
    return found.select(
        "doc_id",
        F.size("names").cast("long").alias("n_licenses"),
        F.array_join("names", ",").alias("licenses"),
        F.array_join(
            F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["first"], m["after"])), ","
        ).alias("places"),
    )


def raw_lines(conversations: DataFrame) -> DataFrame:
    """Lines of unlabelled transcripts as they are pasted: speakers named in one of four styles, one turn in
    eight unnamed after a blank line.

    Every row is a turn, by number, null numbers last, and by role and text where numbers are equal; lines are
    numbered through. Columns: transcript, line, text, blank, and what is to be recovered: role, turn, first.
    """
    styles = {
        "user": ("User: ", "Human: ", "[user] ", "Q: "),
        "assistant": ("Assistant: ", "AI: ", "[assistant] ", "A: "),
        "system": ("System: ", "SYS: ", "[system] ", "Note: "),
    }
    place = F.struct(F.col("turn").isNull().alias("none"), "turn")
    turns = conversations.select(F.col("conv_id").alias("chat_id"), F.struct("role", "text").alias("said"), place.alias("turn"))
    turns = number_turns(turns, "turn", "said")
    style = F.pmod(F.xxhash64("chat_id"), F.lit(4)).cast("int")
    name = F.lit("")
    for role, marks in styles.items():
        name = F.when(F.col("said.role") == role, F.get(F.array(*[F.lit(m) for m in marks]), style)).otherwise(name)
    unnamed = F.pmod(F.xxhash64("chat_id", "turn"), F.lit(8)) == 0
    lines = turns.select(
        "chat_id",
        F.col("turn").alias("said_at"),
        F.col("said.role").alias("role"),
        name.alias("name"),
        unnamed.alias("unnamed"),
        (style % 2 == 1).alias("spaced"),
        F.posexplode(F.split(F.coalesce("said.text", F.lit("")), "\n")).alias("i", "part"),
    )
    lines = number_turns(lines.withColumn("turn", F.struct("said_at", "i")))
    first = F.col("i") == 0
    return lines.select(
        F.col("chat_id").alias("transcript"),
        F.col("turn").alias("line"),
        F.when(first & ~F.col("unnamed"), F.concat("name", "part")).otherwise(F.col("part")).alias("text"),
        (first & (F.col("spaced") | F.col("unnamed"))).alias("blank"),
        "role",
        F.col("said_at").alias("turn"),
        first.alias("first"),
    )


def labelled_lines(raw: DataFrame) -> DataFrame:
    """Lines with their state and that of the line before, -1 at a transcript's start."""
    state = role_state(F.col("role"), F.col("first"))
    lines = raw.select("transcript", "line", "text", "blank", state.alias("state"))
    last = lines.select(F.col("transcript").alias("t"), (F.col("line") + 1).alias("l"), F.col("state").alias("before"))
    both = lines.join(last, (F.col("transcript") == F.col("t")) & (F.col("line") == F.col("l")), "left")
    both = both.select("text", "blank", "state", F.coalesce("before", F.lit(-1)).alias("before"))
    return both.where("state is not null")


@query()
def op3_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from the transcripts of all conversations, by a model of those not held out, and the
    digest of each as it is rendered."""
    raw = materialise(raw_lines(table(spark, sf_dir, "conversations")), "raw-lines")
    model = Model(*fit(labelled_lines(raw.where(~held_out("transcript")))))
    turns = render(parse_transcripts(raw.select("transcript", "line", "text", "blank"), model))
    return turns.select(
        F.col("transcript").alias("conv_id"),
        "turn",
        "role",
        F.sha2("text", 256).alias("text_sha256"),
        F.sha2("canonical", 256).alias("canonical_sha256"),
        held_out("transcript").alias("held_out"),
    )


@query(
    r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as words
  from documents
), docs as (
  select lang, term, count(*) as docs from (select lang, unnest(list_distinct(words)) as term from d) group by all
), kept as (
  select lang, term from docs where docs >= 3
), counts as (
  select lang, source, term, count(*) as n
  from (select lang, source, unnest(words) as term from d) semi join kept using (lang, term) group by all
), groups as (
  select distinct lang, source from d
), size as (
  select lang, count(*) as v from kept group by all
), share as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, v,
    sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as total,
    sum(coalesce(c.n, 0)) over (partition by g.lang, k.term) as lang_n,
    sum(coalesce(c.n, 0)) over (partition by g.lang) as lang_total
  from groups g join kept k using (lang) join size using (lang)
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), p as (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + 1)) // (total + v)::hugeint as p,
    1 + (1000000000::hugeint * (lang_n + 1)) // (lang_total + v)::hugeint as q
  from share
), pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), result as (
  select lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from groups a join groups b using (lang) left join pairs p using (lang)
  where a.source <> b.source and (p.source is null or (p.source = a.source and p.item = b.source))
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // q from p where n > 0 and p > q
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from result
) where part = 'pair' or rank <= 200
"""
)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


@query(
    r"""
with p as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages
), f as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first
  from p
)
select page_id, payload_bytes, payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from f
"""
)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back through the index. The pages bear no times: the id counts seconds from 2000."""
    pages = table(spark, sf_dir, "pages")
    folder, index = write_archives(pages, F.timestamp_seconds(F.col("page_id") + 946_684_800))
    records = read_captures(folder, read_index(folder, index))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# CRC-32 of the id's digits bit by bit; nodes as lists of turns; each node counts in all of its prefixes.
TRIE_SQL = r"""
with t as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} as said
  from conversations where conv_id is not null
), crc as (
  select c, xor(list_reduce(list_concat([4294967295::bigint], list_transform(
    range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i, 1))::bigint)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: xor(x >> 1, case when x % 2 = 1 then 3988292384 else 0 end))), 4294967295) as crc, own
  from (select c, count(*) as own from t group by c)
), convs as (
  select a.c, a.own, a.crc % 6 as h, a.c - a.c % 100 as source, least(a.crc % 6, coalesce(b.own, 0)) as taken
  from crc a left join crc b on b.c = a.c - a.c % 100
), turns as (
  select convs.c, pos, said from convs join t on t.c = convs.source and t.pos < convs.taken
  union all
  select convs.c, pos - h + taken, said from convs join t on t.c = convs.c and t.pos >= convs.h
), whole as (
  select convs.c, coalesce(said, []) as said from convs
  left join (select c, list(said order by pos) as said from turns group by c) using (c)
), members as (
  select c, len(said) as total, unnest(range(0, len(said) + 1)) as depth, said from whole
), nodes as (
  select depth, said[1:depth] as prefix, min(c) as conv_id, count(*) as n,
    string_agg(case when total = depth then c end, ',' order by c) as ends
  from members group by depth, prefix
), children as (
  select depth - 1 as depth, prefix[1:depth - 1] as prefix, count(*) as n_children from nodes where depth > 0 group by all
), counted as (
  select nodes.*, coalesce(n_children, 0) as n_children,
    case when depth = 0 then 0 else (n - 1) * length(prefix[depth].text) end as saved
  from nodes left join children using (depth, prefix)
), sums as (
  select above as depth, prefix[1:above] as prefix, sum(saved) as saved, sum(cast(n_children = 0 as int)) as leaves
  from (select *, unnest(range(0, depth + 1)) as above from counted) group by all
)
select a.conv_id, a.depth, p.conv_id as parent_conv_id, a.n as n_convs, a.n_children, cast(leaves as bigint) as n_leaves,
  cast(s.saved as bigint) as saved_tokens, sha256(coalesce(a.ends, '')) as ends_sha256
from counted a join sums s using (depth, prefix)
left join nodes p on p.depth = a.depth - 1 and p.prefix = a.prefix[1:a.depth - 1]
"""


@query(TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of conversations whose first turns come from the one that their hundred begins with."""
    return prefix_trie(table(spark, sf_dir, "conversations"), borrowed_heads)
