"""Personal data by fixed patterns and a semi-Markov conditional random field.

Patterns give the base spans. The field scores whole candidate segments of at most ``MOST_TOKENS`` tokens by
features of the segment as one string, and dynamic programming over the tokens picks boundaries and types
together, with weights for neighbouring types. It is trained here, on base spans and on disguised copies of
them (an e-mail's signs spelled out, a phone number without its prefix), so that it adds spans that
the patterns miss. Base spans stay as they are; an added span overlaps none of them.

Only stretches around a digit, an at sign or a spelled-out one are looked at: a candidate without any of
these is no segment of the model. An e-mail must hold an at sign, the other kinds have no letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoframe.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 20
REACH = 80
# Most texts that the field is trained on, and of each the most lines' parts around a sign, the letters to either
# side of it, and the most stretches of these parts.
TRAINING_TEXTS = 300
TRAINING_PARTS = 4
TRAINING_LETTERS = 100
TRAINING_STRETCHES = 6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]|[\[({<](?i:at)[\])}>]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
_AT = re.compile(r"@|[\[({<](?i:at)[\])}>]")
_GROUPS = re.compile(r"[0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        n = int(d) * (2 if at % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; from each at sign outwards, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and then kind."""
    out: list[Span] = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of lines within ``REACH`` letters of a seed."""
    out: list[list[int]] = []
    for m in _SEED.finditer(text):
        start = max(text.rfind("\n", max(0, m.start() - REACH), m.start()) + 1, m.start() - REACH, 0)
        line = text.find("\n", m.end(), m.end() + REACH)
        end = line if line >= 0 else min(len(text), m.end() + REACH)
        if out and start <= out[-1][1] and "\n" not in text[out[-1][1] : start + 1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def span_features(span: str, left: str, right: str) -> list[str]:
    """Features of a candidate as a whole, and of the letters beside it."""
    groups = _GROUPS.findall(span)
    digits = sum(map(len, groups))
    letters = sum(c.isalpha() for c in span)
    signs = "".join(sorted({c for c in span if not c.isalnum()}))
    at = _AT.search(span)
    out = [
        "bias",
        f"digits{_bucket(digits, (1, 4, 7, 9, 12, 16, 17, 20))}",
        f"letters{_bucket(letters, (1, 3, 8, 20))}",
        f"signs{signs[:6]}",
        f"groups{'-'.join(str(len(g)) for g in groups[:6])}" if letters == 0 else "mixed",
        f"at{bool(at)}",
        f"first{_class(span[0])}",
        f"last{_class(span[-1])}",
        f"left{_class(left)}",
        f"right{_class(right)}",
        f"edges{_class(left)}{_class(span[0])}{_class(span[-1])}{_class(right)}",
    ]
    if letters == 0:
        out.append(f"luhn{12 <= digits <= 19 and luhn(''.join(groups))}{_bucket(digits, (12, 20))}")
        dots = span.count(".")
        small = all(len(g.lstrip("0")) <= 3 and int(g) <= 255 for g in groups[:4]) if len(groups) == 4 else False
        out.append(f"four{dots == 3 and small and len(span) == digits + 3}")
        out.append(f"sum{digits if digits < 20 else 20}{signs[:4]}")
    if at:
        tail = re.sub(r"\s*[\[({<](?i:dot)[\])}>]\s*", ".", span[at.end() :])
        name = span[: at.start()].strip()
        host = re.fullmatch(r"\s*[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", tail)
        out.append(f"host{bool(host)}name{bool(re.fullmatch('[A-Za-z0-9._%+-]+', name))}")
    return out


def allowed(span: str) -> np.ndarray:
    """What to add to the score of each kind: nothing, or minus infinity where a span cannot be of that kind."""
    digits = sum(map(len, _GROUPS.findall(span)))
    plain = not any(c.isalpha() for c in span)
    can = (bool(_AT.search(span)), plain and digits >= 4, plain and digits >= 12, plain and digits >= 7)
    return np.where(can, 0.0, -np.inf)


def _class(letter: str) -> str:
    if not letter:
        return "^"
    if letter.isdigit():
        return "9"
    if letter.isalpha():
        return "a"
    return "_" if letter.isspace() else letter


@dataclass
class Lattice:
    """Tokens of a stretch and its candidate segments: (first token, token after, features, kinds it can be)."""

    ends: list[int]
    segments: list[tuple[int, int, np.ndarray, np.ndarray]]

    @property
    def size(self) -> int:
        return len(self.ends) - 1


def lattice(text: str, start: int, end: int, index: dict[str, int], grow: bool, blocked: list[Span] = ()) -> Lattice:
    """Candidates in [start, end) that overlap no blocked span."""
    ends = [start, *(m.end() for m in _TOKEN.finditer(text, start, end))]
    n = len(ends) - 1
    firsts = [text[a] for a in ends[:-1]]
    lasts = [text[b - 1] for b in ends[1:]]
    opens = [c.isalnum() or c in "+(" for c in firsts]
    closes = [c.isalnum() for c in lasts]
    seeds = np.zeros(n + 1, dtype=np.int64)
    for m in _SEED.finditer(text, start, end):
        seeds[np.searchsorted(ends, m.start(), side="right")] += 1
    seeds = np.cumsum(seeds)
    taken = np.zeros(n + 1, dtype=np.int64)
    for _, a, b in blocked:
        if b > start and a < end:
            low = max(int(np.searchsorted(ends, a, side="right")) - 1, 0)
            high = min(int(np.searchsorted(ends, b, side="left")), n)
            taken[low + 1 : high + 1] = 1
    taken = np.cumsum(taken)
    segments = []
    for i in range(n):
        if not opens[i] or taken[i + 1] > taken[i]:
            continue
        for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
            if taken[j] > taken[i]:
                break
            if not closes[j - 1] or seeds[j] == seeds[i]:
                continue
            span = text[ends[i] : ends[j]]
            can = allowed(span)
            if not np.isfinite(can).any():
                continue
            names = span_features(span, text[ends[i] - 1 : ends[i]], text[ends[j] : ends[j] + 1])
            if grow:
                ids = [index.setdefault(x, len(index)) for x in names]
            else:
                ids = [index[x] for x in names if x in index]
            segments.append((i, j, np.array(ids, dtype=np.int64), can))
    return Lattice(ends, segments)


@dataclass
class Field:
    """Feature weights for each kind, and weights of neighbouring labels (the last is no entity)."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def scores(self, made: Lattice) -> np.ndarray:
        return np.array([self.weights[ids].sum(axis=0) + can for _, _, ids, can in made.segments]).reshape(-1, len(KINDS))

    def decode(self, made: Lattice) -> list[tuple[int, int, int]]:
        """Segments (first, after, kind) of the best labelling."""
        n, k = made.size, len(KINDS)
        best = np.full((n + 1, k + 1), -np.inf)
        best[0, k] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (_, j, _, _) in enumerate(made.segments):
            by_end[j].append(s)
        scores = self.scores(made)
        into = np.full((n + 1, k + 1), -np.inf)
        came = np.zeros((n + 1, k + 1), dtype=np.int64)
        for j in range(n + 1):
            if j:
                best[j, k] = into[j - 1, k]
                back[j, k] = (j - 1, int(came[j - 1, k]))
                for s in by_end[j]:
                    i = made.segments[s][0]
                    value = into[i, :k] + scores[s]
                    for kind in np.flatnonzero(value > best[j, :k]):
                        best[j, kind] = value[kind]
                        back[j, int(kind)] = (i, int(came[i, kind]))
            reach = best[j][:, None] + self.moves
            into[j], came[j] = reach.max(axis=0), reach.argmax(axis=0)
        out, at, label = [], n, int(best[n].argmax())
        while at > 0:
            i, before = back[at, label]
            if label < k:
                out.append((i, at, label))
            at, label = i, before
        return out[::-1]


def _log_sum(a: np.ndarray, axis: int = 0) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def train(examples: list[tuple[Lattice, set[tuple[int, int, int]]]], index: dict[str, int], epochs: int = 6) -> Field:
    """Weights of largest likelihood by AdaGrad, one stretch at a time, with a small quadratic penalty."""
    k = len(KINDS)
    field = Field(index, np.zeros((len(index), k)), np.zeros((k + 1, k + 1)))
    past_w, past_m = np.full_like(field.weights, 1e-2), np.full_like(field.moves, 1e-2)
    draw = np.random.default_rng(0)
    for _ in range(epochs):
        for x in draw.permutation(len(examples)):
            made, gold = examples[x]
            n = made.size
            scores = field.scores(made)
            ahead, behind = [[[] for _ in range(n + 1)] for _ in range(2)]
            for s, (i, j, _, _) in enumerate(made.segments):
                behind[j].append(s)
                ahead[i].append(s)
            alpha = np.full((n + 1, k + 1), -np.inf)
            alpha[0, k] = 0.0
            into = np.empty((n + 1, k + 1))
            into[0] = field.moves[k]
            for j in range(1, n + 1):
                rows = [into[made.segments[s][0], :k] + scores[s] for s in behind[j]]
                if rows:
                    alpha[j, :k] = _log_sum(np.array(rows))
                alpha[j, k] = into[j - 1, k]
                into[j] = _log_sum(alpha[j][:, None] + field.moves)
            total = float(_log_sum(alpha[n]))
            beta = np.full((n + 1, k + 1), -np.inf)
            beta[n] = 0.0
            out = np.full((n + 1, k + 1), -np.inf)
            for j in range(n - 1, -1, -1):
                rows = [scores[s] + beta[made.segments[s][1], :k] for s in ahead[j]]
                if rows:
                    out[j, :k] = _log_sum(np.array(rows))
                out[j, k] = beta[j + 1, k]
                beta[j] = _log_sum(field.moves + out[j][None, :], axis=1)
            # Expected less observed counts.
            wanted = np.zeros_like(field.moves)
            for j in range(n):
                wanted += np.exp(np.minimum(alpha[j][:, None] + field.moves + out[j][None, :] - total, 0))
            grad_m = wanted
            grad_w = 1e-3 * field.weights
            for s, (i, j, ids, _) in enumerate(made.segments):
                p = np.exp(np.minimum(into[i, :k] + scores[s] + beta[j, :k] - total, 0))
                for kind in range(k):
                    if (i, j, kind) in gold:
                        p[kind] -= 1
                np.add.at(grad_w, ids, p)
            at, label = 0, k
            marks = {i: (j, kind) for i, j, kind in gold}
            while at < n:
                after, kind = marks.get(at, (at + 1, k))
                grad_m[label, kind] -= 1
                at, label = after, kind
            past_w += grad_w**2
            past_m += grad_m**2
            field.weights -= 0.5 * grad_w / np.sqrt(past_w)
            field.moves -= 0.2 * grad_m / np.sqrt(past_m)
    return field


def _disguise(text: str, spans: list[Span], turn: int) -> tuple[str, list[Span]] | None:
    """The text with one span in another form, and the spans of the new text."""
    for kind, s, e in spans:
        old = text[s:e]
        if kind == "email" and turn % 2 == 0:
            mark = ("[at]", "(at)", " [at] ", " (at) ")[turn // 2 % 4]
            new = old.replace("@", mark)
            if turn % 4 == 0:
                name, _, host = new.rpartition(mark)
                new = name + mark + host.replace(".", "[dot]")
        elif kind == "phone":
            new = re.sub(r"^\+[0-9]{1,3}[\x20.-]?", "", old)
            if len(re.sub(r"[^0-9]", "", new)) < 9:
                continue
        else:
            continue
        shift = len(new) - len(old)
        changed = text[:s] + new + text[e:]
        moved = [(k, a + shift * (a >= e), b + shift * (b >= e)) for k, a, b in spans if (k, a, b) != (kind, s, e)]
        inside = [x for x in moved if x[1] < s + len(new) and x[2] > s]
        if not inside:
            return changed, sorted([*moved, (kind, s, s + len(new))], key=lambda x: x[1])
    return None


def fit_field(texts: list[str], epochs: int = 6, most: int = TRAINING_STRETCHES) -> Field:
    """A field trained on the base spans of the first ``most`` stretches of texts and on disguised copies."""
    index: dict[str, int] = {}
    examples = []

    def add(text: str, spans: list[Span]) -> None:
        for a, b in stretches(text):
            made = lattice(text, a, b, index, True)
            place = {p: i for i, p in enumerate(made.ends)}
            known = {(i, j) for i, j, _, _ in made.segments}
            gold, end = set(), -1
            for kind, s, e in spans:
                pair = (place.get(s), place.get(e))
                if s >= end and pair in known:
                    gold.add((*pair, KINDS.index(kind)))
                    end = e
            examples.append((made, gold))

    for turn, text in enumerate(texts):
        for a, b in stretches(text)[:most]:
            part = text[max(0, a - 1) : b + 1]
            add(part, base_spans(part))
            other = _disguise(part, base_spans(part), turn)
            if other:
                add(*other)
    return train(examples, index, epochs)


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Spans that the field finds beside the base ones."""
    out = []
    for a, b in stretches(text):
        made = lattice(text, a, b, field.index, False, base)
        for i, j, kind in field.decode(made) if made.segments else ():
            out.append((KINDS[kind], made.ends[i], made.ends[j]))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _finder(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches([whole], "text"):
                texts = pc.fill_null(batch.column(1), "")
                some = pc.match_substring_regex(texts, r"[0-9@]|[\[({<][aA][tT][\])}>]").to_numpy(zero_copy_only=False)
                base = [""] * len(texts)
                every = [""] * len(texts)
                counts = np.zeros((len(KINDS) + 1, len(texts)), dtype=np.int64)
                for row in np.flatnonzero(some).tolist():
                    text = texts[row].as_py()
                    found = base_spans(text)
                    more = added_spans(text, found, field)
                    for kind, _, _ in found:
                        counts[KINDS.index(kind), row] += 1
                    counts[-1, row] = len(more)
                    base[row] = _joined(found)
                    every[row] = _joined(sorted(found + more, key=lambda x: (x[1], KINDS.index(x[0]))))
                arrays = [batch.column(0), *(pa.array(c) for c in counts), pa.array(base), pa.array(every)]
                names = ["key", *(f"n_{k}" for k in KINDS), "n_added", "base", "spans"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def training_parts(
    docs: DataFrame,
    texts: int = TRAINING_TEXTS,
    parts: int = TRAINING_PARTS,
    letters: int = TRAINING_LETTERS,
) -> list[str]:
    """Parts around the signs of base spans, of ``texts`` different texts at the most: those with the least hashes.

    The hashes are chosen first, so that only the chosen texts are taken apart. What comes back is bounded by the
    parameters.
    """
    signs = r"@|\+[0-9]|[0-9]{12}|[0-9]\.[0-9]"
    some = F.col("text").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]{12}|[0-9]\.[0-9]")
    likely = docs.where(some).select(F.xxhash64("text").alias("h"), "text")
    chosen = [r.h for r in likely.select("h").distinct().orderBy("h").limit(texts).collect()]
    near = rf"[^\n]{{0,{letters}}}"
    found = F.regexp_extract_all("text", F.lit(f"({near}(?:{signs}){near})"), F.lit(1))
    part = F.array_join(F.slice(found, 1, parts), "\n").alias("part")
    rows = likely.where(F.col("h").isin(chosen)).select("h", part).groupBy("h").agg(F.min("part").alias("part"))
    return [r.part for r in rows.orderBy("h").collect()]


def find_pii(docs: DataFrame, key: str = "doc_id", training_texts: int = TRAINING_TEXTS) -> DataFrame:
    """Spans of personal data in each whole text.

    One row for each input row: ``key``, n_email, n_ip, n_card, n_phone (base spans), n_added (the field's),
    base and spans: kind:start:end by start and then kind, comma-joined, in code points with the end
    exclusive. Null texts count as empty and have none. The field is trained on at most
    ``training_texts`` different texts with a base span's signs, those with the least hashes; without any, nothing
    is added.
    Rows that repeat each other have the same spans each. Texts may have any length: a batch holds 8 MB of them,
    or one. An empty table gives an empty table. Other columns are not looked at, whatever their names.
    """
    kind = dict(docs.dtypes)[key]
    field = fit_field(training_parts(docs, training_texts))
    rows = docs.select(F.col(key).alias("key"), "text")
    counts = ", ".join(f"n_{k} long" for k in (*KINDS, "added"))
    found = rows.mapInArrow(_finder(field), f"key {kind}, {counts}, base string, spans string")
    return found.withColumnRenamed("key", key)
