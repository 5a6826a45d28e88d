"""Personal data: base patterns, and a skip-chain conditional random field that carries labels across a document."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Rows that the field is trained on, about (twice that at most); chosen by a hash of id and text among rows with a digit or an @.
SAMPLE = 4000
#: Tokens of a row of the sample up to which it is trained on.
SAMPLE_TOKENS = 500
SLOTS = 4096
#: Share of the tokens whose own features training hides, so that their labels must come through their edges.
HIDDEN = 0.3
#: Steps of gradient ascent on the pseudo-likelihood, their size, and the weight of the squared parameters.
STEPS, RATE, RIDGE = 120, 0.5, 2e-4
#: Messages count as settled when none changes by more than this.
SETTLED = 1e-4
#: Margin in log-odds by which a label must beat "none" outside base matches.
MARGIN = 3.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Starts at the first digit of a run: from a later one it fails if it fails from there, so this is linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_MARKED = re.compile("[0-9@]")
_BLANK = re.compile(r"\s|\Z")
_TRIM = "\"'()[]{}<>,;:!?*#$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the local part, @, a domain with a dot; found from each @, so linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that can be or belong to an entity: those with a digit or an @, without punctuation around them."""
    out, b = [], 0
    while m := _MARKED.search(text, b):
        a, low = m.start(), b
        while a > low and not text[a - 1].isspace():
            a -= 1
        b = end = _BLANK.search(text, m.end()).start()
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and (text[b - 1] in _TRIM or text[b - 1] == "."):
            b -= 1
        if a < b:
            out.append((a, b))
        b = end
    return out


def shape(token: str) -> str:
    """Classes of the characters, runs shortened: 9 digit, a letter, other signs as they are; and the number of digits."""
    s = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "9", token))
    return f"{s}/{len(_digits(token))}"


def slots(text: str, spans: list[tuple[int, int]], i: int) -> list[int]:
    """Hashed features of a token: its shape, length and signs, and the shapes beside it. No base match is a feature."""
    a, b = spans[i]
    token = text[a:b]
    digits = _digits(token)
    say = [f"shape {shape(token)}", f"signs {''.join(sorted(set(re.sub('[A-Za-z0-9]', '', token))))}", f"digits {len(digits)}", f"at {'@' in token}", f"luhn {len(digits) >= 13 and luhn(digits)}"]
    for name, j in (("left", i - 1), ("right", i + 1)):
        near = 0 <= j < len(spans) and (spans[i][0] - spans[j][1] if j < i else spans[j][0] - spans[i][1]) <= 2
        say.append(f"{name} {shape(text[slice(*spans[j])]) if near else '-'}")
    say.append(f"before {text[max(0, a - 2) : a].strip()[-1:]}")
    return [zlib.crc32(s.encode("utf-8", "replace")) % SLOTS for s in say]


#: What joins two tokens: standing side by side, being the same, being similar.
EDGES = ("chain", "repeat", "similar")


def links(text: str, spans: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Edges by kind: between neighbours; skip edges from each token to the last one with the same letters and digits, and to
    the last one of others that begins or ends with the same six (a network, an issuer, an area, a domain).
    """
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= 2]
    repeat, similar, last = [], [], {}
    for i, (a, b) in enumerate(spans):
        bare = re.sub("[^a-z0-9@]", "", text[a:b].lower())
        if len(bare) < 4:
            continue
        if ("", bare) in last:
            repeat.append((last["", bare], i))
        elif len(bare) >= 8:
            similar += sorted({(last[key], i) for key in (("head", bare[:6]), ("tail", bare[-6:])) if key in last})
        last["", bare] = i
        if len(bare) >= 8:
            last["head", bare[:6]] = last["tail", bare[-6:]] = i
    return [chain, repeat, similar]


class Field:
    """Weights by feature slot and label; log-potentials by kind of edge and pair of labels."""

    def __init__(self, weights: np.ndarray, potentials: np.ndarray):
        self.weights, self.potentials = weights, potentials

    def scores(self, text: str, spans: list[tuple[int, int]], fixed: np.ndarray) -> np.ndarray:
        """Log-potentials of each token alone. Tokens in base matches are observed with their kind."""
        unary = np.stack([self.weights[slots(text, spans, i)].sum(0) for i in range(len(spans))])
        unary -= unary.max(1, keepdims=True)
        held = np.flatnonzero(fixed)
        unary[held] = -50.0
        unary[held, fixed[held]] = 0.0
        return unary

    def beliefs(self, unary: np.ndarray, edges: list[list[tuple[int, int]]]) -> np.ndarray:
        """Log-beliefs over the labels of each token by loopy max-product message passing, until messages settle.

        Without loops they are the exact max-marginals (up to a constant for each token). Damping
        grows with the rounds, so messages settle with loops too.
        """
        flat = np.array([e for some in edges for e in some], np.int64).reshape(-1, 2)
        belief = unary.copy()
        if len(flat):
            table = np.repeat(self.potentials, [len(some) for some in edges], 0)
            src, dst = np.concatenate([flat[:, 0], flat[:, 1]]), np.concatenate([flat[:, 1], flat[:, 0]])
            table = np.concatenate([table, table.transpose(0, 2, 1)])
            back = np.roll(np.arange(len(src)), len(flat))
            message = np.zeros((len(src), unary.shape[1]))
            at, calm = 0, 200 + len(unary)
            while True:  # damped ever more, steps shrink as 1 / rounds; their number is bounded in case they circle all the same
                out = belief[src] - message[back]
                new = (out[:, :, None] + table).max(1)
                new -= new.max(1, keepdims=True)
                change = np.abs(new - message).max()
                message = new if at == 0 else message + min(0.7, calm / (2 * (at + 1))) * (new - message)
                belief = unary.copy()
                np.add.at(belief, dst, message)
                at += 1
                if change < SETTLED or at > 20 * calm:
                    break
        belief -= belief.max(1, keepdims=True)
        return belief - np.log(np.exp(belief).sum(1, keepdims=True))

    def spans(self, text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
        """Base matches, and all spans: those and tokens outside them that the field labels."""
        base = base_spans(text)
        found = tokens(text)
        extra: list[tuple[str, int, int]] = []
        if found:
            fixed = labels(found, base)
            if not fixed.all():
                belief = self.beliefs(self.scores(text, found, fixed), links(text, found))
                taken = sorted(x for some in base.values() for x in some)
                starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
                for i in np.flatnonzero(fixed == 0).tolist():
                    k = int(belief[i].argmax())
                    if k and belief[i, k] - belief[i, 0] >= MARGIN:
                        before = bisect_left(starts, found[i][1])
                        if not before or reach[before - 1] <= found[i][0]:
                            extra.append((LABELS[k], *found[i]))
        return base, [(kind, a, b) for kind in KINDS for a, b in sorted([*base[kind], *((a, b) for x, a, b in extra if x == kind)])]


def labels(spans: list[tuple[int, int]], base: dict[str, list[tuple[int, int]]]) -> np.ndarray:
    """The kind of the base match that holds at least half of each token, else none.

    By binary search: tokens, and matches of a kind, are in order and do not overlap.
    """
    out = np.zeros(len(spans), np.int64)
    starts, ends = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
    for k, kind in enumerate(KINDS, 1):
        if base[kind]:
            a, b = np.array(base[kind]).T
            low, high = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            for i, j, x, y in zip(low.tolist(), high.tolist(), a.tolist(), b.tolist()):
                for t in range(i, j):
                    if 2 * (min(y, spans[t][1]) - max(x, spans[t][0])) >= spans[t][1] - spans[t][0]:
                        out[t] = k
    return out


def taught(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Labels to learn from: those of base matches, and the kind of a token that is a match when it stands alone."""
    out = labels(spans, base_spans(text))
    for i in np.flatnonzero(out == 0).tolist():
        token = text[slice(*spans[i])]
        for k, kind in enumerate(KINDS, 1):
            if len(token) < 400 and base_spans(token)[kind] == [(0, len(token))]:
                out[i] = k
    return out


_HIDDEN_SLOT = zlib.crc32(b"hidden") % SLOTS


def hide(rows: np.ndarray, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Slots with those of a HIDDEN share of the tokens, drawn by text and place, replaced by one that says nothing."""
    draw = np.array([zlib.crc32(f"{a} {text[a:b]}".encode("utf-8", "replace")) % 1000 for a, b in spans])
    return np.where((draw < 1000 * HIDDEN)[:, None], _HIDDEN_SLOT, rows)


def train(slots_of: np.ndarray, y: np.ndarray, edges: list[np.ndarray]) -> Field:
    """The field that maximises the pseudo-likelihood: of each token's label given its features and its neighbours' labels.

    slots_of: a row of slots for each token; edges by kind: index pairs. Gradient ascent with
    steps scaled by the gradients so far; a squared penalty keeps parameters small.
    """
    k, n = len(LABELS), max(1, len(y))
    weights, potentials = np.zeros((SLOTS, k)), np.zeros((len(EDGES), k, k))
    seen_w, seen_p = np.full_like(weights, 1e-8), np.full_like(potentials, 1e-8)
    truth = np.eye(k)[y]
    for _ in range(STEPS if len(y) else 0):
        score = weights[slots_of].sum(1)
        for t, e in enumerate(edges):
            np.add.at(score, e[:, 0], potentials[t][:, y[e[:, 1]]].T)
            np.add.at(score, e[:, 1], potentials[t][y[e[:, 0]]])
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        miss = truth - p
        up = np.stack([np.bincount(slots_of.ravel(), np.repeat(miss[:, c], slots_of.shape[1]), SLOTS) for c in range(k)], axis=1) / n - RIDGE * weights
        seen_w += up * up
        weights += RATE * up / np.sqrt(seen_w)
        for t, e in enumerate(edges):
            pair = np.zeros((k, k))
            np.add.at(pair.T, y[e[:, 1]], miss[e[:, 0]])
            np.add.at(pair, y[e[:, 0]], miss[e[:, 1]])
            pair = pair / n - RIDGE * potentials[t]
            seen_p[t] += pair * pair
            potentials[t] += RATE * pair / np.sqrt(seen_p[t])
    return Field(weights, potentials)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """A field trained with base matches as labels, on a bounded sample of rows with a digit or an @.

    The features of a share of the tokens are hidden: what they are can be told from the tokens
    they are linked with alone, which is what teaches the edges to carry labels. Tasks find tokens, features, labels and edges; the driver gets those of the sample, at most
    2 * sample rows of at most SAMPLE_TOKENS tokens, and climbs the pseudo-likelihood.
    """
    ship(docs.sparkSession)
    able = docs.where(F.col(text_col).rlike("[0-9@]"))
    n = able.count()
    u = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col), F.lit(1_000_000)) / 1_000_000

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0):
                text = t.as_py()
                spans = tokens(text)
                if 0 < len(spans) <= SAMPLE_TOKENS:
                    rows = hide(np.array([slots(text, spans, i) for i in range(len(spans))], np.int32), text, spans).astype(np.int32)
                    out.append((rows.tobytes(), taught(text, spans).astype(np.int8).tobytes(), *(np.array(e, np.int32).tobytes() for e in links(text, spans))))
            cols = [pa.array(c, pa.binary()) for c in zip(*out)] if out else [pa.array([], pa.binary())] * 5
            yield pa.RecordBatch.from_arrays(cols, ["slots", "y", *EDGES])

    rows = able.where(u < min(1.0, sample / max(1, n))).select(text_col).orderBy(F.xxhash64(text_col), text_col).limit(2 * sample).mapInArrow(describe, "slots binary, y binary, chain binary, repeat binary, similar binary").collect()
    rows.sort(key=lambda r: tuple(map(bytes, r)))  # the same field whatever order tasks end in
    y = [np.frombuffer(r["y"], np.int8) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in y])]).astype(np.int64)
    slots_of = np.concatenate([np.frombuffer(r["slots"], np.int32).reshape(len(x), -1) for r, x in zip(rows, y)]) if rows else np.zeros((0, 1), np.int32)
    edges = [np.concatenate([np.zeros((0, 2), np.int64), *(np.frombuffer(r[e], np.int32).reshape(-1, 2) + at for r, at in zip(rows, first))]) for e in EDGES]
    return train(slots_of, np.concatenate([np.zeros(0, np.int64), *y]).astype(np.int64), edges)


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def detect(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row.

    Counts and hash are those of base matches; ``spans`` has all spans as kind:start:end in
    code points. Null texts are empty: no span. Texts are read whole, in time about linear in
    them. Repeated rows get a row each, an empty table none; other columns are not read. Of labels
    that score the same the first counts: none, then kinds as listed.
    """
    ship(docs.sparkSession)
    field = field or fit(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                base, spans = field.spans(t.as_py() or "")
                first = told([(k, a, e) for k in KINDS for a, e in base[k]])
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(first.encode()).hexdigest(), told(spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Rows and columns of ``docs`` with personal data in texts replaced by its kind, and ``chars_col`` made to fit.

    Null texts stay null, empty ones empty; repeated rows stay repeated, an empty table empty;
    columns of any other names are carried along.
    """
    ship(docs.sparkSession)
    field = field or fit(docs, id_col, text_col)
    at = docs.columns.index(text_col)
    size = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, texts = b.columns, b.column(at).to_pylist()
            new = [t if t is None else mask(t, field.spans(t)[1]) for t in texts]
            cols[at] = pa.array(new, cols[at].type)
            if size is not None:
                n = [old if a == t else len(a) for old, a, t in zip(cols[size].to_pylist(), new, texts)]
                cols[size] = pa.array(n, cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(run, docs.schema)
