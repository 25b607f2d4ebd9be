"""Personal data: exact patterns, and a skip-chain conditional random field over the tokens around them.

The patterns give the base spans. The field labels every token that holds a digit or
an @: neighbours in the text are linked by a chain, and tokens of a document that
repeat or resemble each other (the same digits, the same address) by skip edges, so that a mention
which no pattern matches takes the label of its likes. The weights of tokens, chain and skip edges are fitted
together, by pseudo-likelihood: each token's label given those of its neighbours. As the patterns know nothing
of mentions that they do not match, the fit hides one side of a pair: a mention of a text is said again in a
form that no pattern matches, once beside the text, where its label is the mention's, and once alone, where it has none.
Loopy message passing runs over all documents of a batch at once; no edge joins two documents. Neighbouring tokens of
one label become one span, if together they have what a mention of the kind needs at least.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Different texts that the weights are fitted on (those with the least hashes, give or take a few roots of that), and tokens of each at most.
SAMPLE_DOCS, SAMPLE_TOKENS = 4000, 64
#: Steps of the fit, their length, and how strongly weights are drawn to zero.
STEPS, RATE, DECAY = 500, 5.0, 1e-4
#: Digits that a mention of each kind has at most.
DIGITS = (0, 12, 19, 15)
#: Rounds of messages, and the posterior from which a token becomes a span.
ROUNDS, LEAST = 12, 0.9

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANY = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]+")
_EDGES = ".,;:!?()[]{}<>\"'"


def _emails(text: str):
    """A local part begins where its run of allowed characters does, or where the last match ended."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _RUN:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        else:
            floor = max(floor, at + 1)  # no run reaches across an @
        at = text.find("@", max(at + 1, floor))


def _byte(digits: str) -> bool:
    """At most 255, whatever the number of zeros in front."""
    value = digits.lstrip("0")
    return len(value) < 3 or (len(value) == 3 and value <= "255")


def _luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; kind is a place in KINDS."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if not _ANY.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_byte(p) for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def written_spans(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


class Token(NamedTuple):
    start: int
    end: int
    text: str
    label: int  # of the base span it lies in; 0 outside


_WORD = re.compile(r"\S+")


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[Token]:
    """The words that hold a digit or @, without punctuation at their ends."""
    out, i = [], 0
    for m in _ANY.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        a = m.start()
        while a and not text[a - 1].isspace():
            a -= 1
        w = _WORD.match(text, a)
        b = w.end()
        s, e = a, b
        while s < e and text[s] in _EDGES:
            s += 1
        while e > s and text[e - 1] in _EDGES:
            e -= 1
        out.append((a, b, s, e))
    found = []
    for _, _, s, e in out:
        while i < len(base) and base[i][2] <= s:
            i += 1
        hit = [k for a, k, b in base[i : i + 4] if a < e and b > s]
        found.append(Token(s, e, text[s:e], 1 + hit[0] if hit else 0))
    return found


def _features(t: Token) -> list[float]:
    """The shape of a token."""
    x = t.text
    digits = sum(c in "0123456789" for c in x)
    letters = sum(c.isalpha() for c in x)
    n = max(1, len(x))
    dots, dashes = x.count("."), x.count("-")
    return [
        1.0, "@" in x, "@" in x and dots > 0, digits / n, letters / n, letters == 0, digits == 0, min(digits, 20) / 20,
        digits < 4, 4 <= digits < 9, 9 <= digits <= 15, 12 <= digits <= 19, digits > 19, 13 <= digits == len(x),
        dots == 3 and letters == 0, dots == 3 and digits <= 12, x[:1] == "+", dashes > 0, "=" in x or ":" in x or "_" in x, "%" in x or "$" in x,
        12 <= digits <= 19 and _luhn(_DIGITS.sub("", x)),
    ]


def _likes(t: Token) -> list[str]:
    """Tokens that share one of these keys repeat or resemble each other: the same word; the same local part of an address; the same digits but for
    a prefix; an address of numbers with the same parts."""
    found = [t.text.lower()]
    if "@" in t.text:
        found.append("@" + t.text.split("@")[0].lower())
    elif not any(c.isalpha() for c in t.text):
        digits = _DIGITS.sub("", t.text)
        if len(digits) >= 7:
            found.append("#" + digits[-9:])
        parts = [p for p in _DIGITS.split(t.text) if p]
        if len(parts) == 4:
            found.append("." + ".".join(parts))
    return found


def hidden(mention: str, kind: int, way: int) -> str:
    """A mention in a form that the patterns do not match; ``way`` chooses among the forms of its kind."""
    if kind == 0:
        local, domain = mention.split("@", 1)
        return local + ("@" + domain.split(".")[0] if way % 2 else "@")
    if kind == 1:
        return mention.replace(".", "-_"[way % 2])
    words = mention.split()
    if len(words) > 1:  # without its first group of digits
        return " ".join(words[1:])
    digits = _DIGITS.sub("", mention)
    return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)) if kind == 2 else digits[-9:]


class Field(NamedTuple):
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray  # labels x labels


def _edges(likes: list[list[str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain and skip edges of a document's tokens; a skip edge leads to the last token before with a common key, so that all of a key hang together."""
    skip, last = set(), {}
    for i, keys in enumerate(likes):
        for key in keys:
            if key in last:
                skip.add((last[key], i))
            last[key] = i
    return [(i - 1, i) for i in range(1, len(likes))], sorted(skip)


def _lesson(text: str, most: int) -> tuple[list[Token], list[int], list[tuple[int, int]], list[tuple[int, int]]]:
    """Tokens, labels, chain and skip edges of a text as it is, and of the text with one mention of each kind, and one token
    that is none, said again; and of what was said again alone, where it is no mention."""
    base = base_spans(text)
    own = tokens(text, base)[:most]
    again = [(hidden(text[a:b], k, a), 1 + k) for a, k, b in sorted({k: (a, k, b) for a, k, b in reversed(base) if own and b <= own[-1].end}.values())]
    plain = [t for t in own if not t.label]
    again += [(plain[len(text) % len(plain)].text, 0)] if plain else []
    graphs = [(own, [t.label for t in own])]
    for said, label in again:
        more = tokens(said, [])
        graphs.append((own + more, [t.label for t in own] + [label] * len(more)))
        graphs.append((more, [0] * len(more)))
    found, labels, chain, skip = [], [], [], []
    for part, y in graphs:
        at = len(found)
        for edges, these in zip((chain, skip), _edges([_likes(t) for t in part]), strict=True):
            edges += [(at + i, at + j) for i, j in these]
        found += part
        labels += y
    return found, labels, chain, skip


def _learn(x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> Field:
    """Weights that make each token's label likely given its features and the labels of its neighbours. Edges are (n x 2) places of tokens.

    The base patterns decide most labels by a token's features alone, which would leave the edges without weight. Each token is
    therefore seen a second time with nothing but its neighbours.
    """
    n, m = len(y), len(LABELS)
    target = np.eye(m)[y]
    blank = np.zeros_like(x)
    blank[:, 0] = 1.0
    sides = np.concatenate([x, blank])
    before, after, alike = (np.zeros((n, m)) for _ in range(3))
    if len(chain):
        np.add.at(before, chain[:, 1], target[chain[:, 0]])
        np.add.at(after, chain[:, 0], target[chain[:, 1]])
    if len(skip):
        np.add.at(alike, skip[:, 1], target[skip[:, 0]])
        np.add.at(alike, skip[:, 0], target[skip[:, 1]])
    w, c, s = np.zeros((x.shape[1], m)), np.zeros((m, m)), np.zeros((m, m))
    # Labels are rare: each counts by the root of how much rarer it is than the others together.
    share = np.bincount(y, minlength=m) / n
    weight = np.sqrt(1.0 / np.maximum(share[y] * m, 1e-9))[:, None] / (2 * n)
    for step in range(STEPS):
        z = (sides @ w).reshape(2, n, m) + (before @ c + after @ c.T + alike @ s)
        p = np.exp(z - z.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        both = (p - target) * weight
        g, rate = both.sum(axis=0), RATE / np.sqrt(1 + step / 50)
        to_skip = alike.T @ g
        w -= rate * (sides.T @ both.reshape(-1, m) + DECAY * w)
        c -= rate * (before.T @ g + (after.T @ g).T + DECAY * c)
        s -= rate * ((to_skip + to_skip.T) / 2 + DECAY * s)
    return Field(w, c, s)


def fit(docs: DataFrame, *, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_tokens: int = SAMPLE_TOKENS) -> Field:
    """Weights from a bounded sample of texts, with the base spans as labels.

    A text is in the sample by its hash alone, so that equal tables give equal weights, however they are dealt to tasks,
    and copies of a text count once. A table without such texts gives a field that adds nothing.
    """
    key = F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 40))
    share = min(1.0, sample_docs / max(1, docs.count()))
    some = docs.where((key < int((1 << 40) * share)) & F.col(text_col).rlike("[0-9@]")).select(key.alias("key"), F.col(text_col).alias("text"))
    some = some.groupBy("key").agg(F.min("text").alias("text"))

    def look(batches):
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                found, y, chain, skip = _lesson(text, sample_tokens)
                x = [float(v) for t in found for v in _features(t)]
                yield type(pdf)({"key": [key], "x": [x], "y": [y], "chain": [[i for e in chain for i in e]], "skip": [[i for e in skip for i in e]]})

    rows = sorted(some.mapInPandas(look, "key long, x array<double>, y array<int>, chain array<int>, skip array<int>").collect(), key=lambda r: r["key"])
    rows = [r for r in rows if r["y"]]
    width, m = len(_features(Token(0, 0, "", 0))), len(LABELS)
    if not rows:
        return Field(np.zeros((width, m)), np.zeros((m, m)), np.zeros((m, m)))
    x, y = np.concatenate([r["x"] for r in rows]).reshape(-1, width), np.concatenate([r["y"] for r in rows])
    first = np.cumsum([0, *[len(r["y"]) for r in rows[:-1]]])
    chain, skip = (np.concatenate([np.array(r[c], np.int64).reshape(-1, 2) + at for r, at in zip(rows, first, strict=True)]) for c in ("chain", "skip"))
    return _learn(x, y, chain, skip)


def _posteriors(field: Field, docs: list[list[Token]]) -> np.ndarray:
    """Label probabilities of all tokens, by loopy message passing in log space. The labels of base spans are given."""
    flat = [t for d in docs for t in d]
    m = len(LABELS)
    unary = np.array([_features(t) for t in flat], np.float64) @ field.unary
    unary -= np.log(np.exp(unary - unary.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + unary.max(axis=1, keepdims=True)
    base = np.array([t.label for t in flat])
    unary[base > 0] = -12.0
    unary[base > 0, base[base > 0]] = 0.0
    ends, kinds, at = [], [], 0
    for d in docs:
        for kind, own in enumerate(_edges([_likes(t) for t in d])):
            ends += [(at + i, at + j) for i, j in own]
            kinds += [kind] * len(own)
        at += len(d)
    if ends:
        a, b = np.array(ends).T
        psi = np.stack([field.chain, field.skip])[np.array(kinds)]
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        messages = np.zeros((len(src), m))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst, messages)
            out = (belief[src] - messages[back])[:, :, None] + psi
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            messages = 0.5 * messages + 0.5 * new
        np.add.at(unary, dst, messages)
    unary = np.exp(unary - unary.max(axis=1, keepdims=True))
    return unary / unary.sum(axis=1, keepdims=True)


def _complete(kind: int, said: str) -> bool:
    """Whether a span has what a mention of its kind needs at least, so that a scrap of one is none."""
    digits = len(_DIGITS.sub("", said))
    if kind == 0:
        return "@" in said
    if kind == 1:
        return len([p for p in _DIGITS.split(said) if p]) >= 4
    return digits >= (12 if kind == 2 else 7)


def _merged(text: str, found: list[Token], kinds: list[int | None]) -> list[tuple[int, int, int]]:
    """(start, kind, end): neighbouring tokens of one kind with nothing but spaces and brackets between them are one span; addresses are one each."""
    out: list[tuple[int, int, int]] = []
    last = None
    for i, (t, kind) in enumerate(zip(found, kinds, strict=True)):
        if kind is None:
            continue
        joined = bool(out) and kind > 0 and last == i - 1 and out[-1][1] == kind and not text[out[-1][2] : t.start].strip(" ()-")
        if joined and len(_DIGITS.sub("", text[out[-1][0] : t.end])) <= DIGITS[kind]:
            out[-1] = (out[-1][0], kind, t.end)
        else:
            out.append((t.start, kind, t.end))
        last = i
    # A bracket that the first token lost belongs to its other half.
    out = [(a - (text[a - 1 : a] == "(" and text[a:b].count(")") > text[a:b].count("(")), k, b) for a, k, b in out]
    return [(a, k, b) for a, k, b in out if _complete(k, text[a:b])]


def spans_of(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans, and the spans that the field adds."""
    bases = [base_spans(x) if "@" in x or _ANY.search(x) else [] for x in texts]
    found = [tokens(x, b) if _ANY.search(x) else [] for x, b in zip(texts, bases, strict=True)]
    # A document whose tokens all lie in base spans has nothing to add.
    asked = [i for i, d in enumerate(found) if any(not t.label for t in d)]
    added: list[list] = [[] for _ in texts]
    if asked:
        p, at = _posteriors(field, [found[i] for i in asked]), 0
        for i in asked:
            own = p[at : at + len(found[i])]
            at += len(found[i])
            best = own.argmax(axis=1)
            sure = (best > 0) & (own.max(axis=1) >= LEAST)
            added[i] = _merged(texts[i], found[i], [int(k) - 1 if s and not t.label else None for t, k, s in zip(found[i], best, sure, strict=True)])
    return list(zip(bases, added, strict=True))


def find_personal(docs: DataFrame, field: Field, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, and ``base`` and ``added``: arrays of (kind, start, end) in code points, end exclusive.

    Whole texts are searched; a null or empty text has no spans. Equal texts have equal spans. Added spans do not
    overlap base ones. Repeated rows stay. Columns named base or added cannot be kept under these names. An empty table gives an empty table.
    """
    small = docs.select(*[f"`{c}`" for c in keep], text_or_empty(text_col).alias("_pii_text"))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*small.drop("_pii_text").schema, T.StructField("base", span), T.StructField("added", span)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                spans = spans_of(field, batch.column(batch.num_columns - 1).to_pylist())
                rows = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(s[i])] for s in spans], kind) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *rows], names=[*batch.schema.names[:-1], "base", "added"])

    return small.mapInArrow(run, schema)
