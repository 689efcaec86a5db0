"""Personal data by candidate gradient boosting.

*Generators* of high recall propose spans for e-mail addresses, IP addresses, card numbers and phone numbers; spans of
different kinds may overlap. *Boosted trees* (oblivious, depth 3) score each candidate by its format and its context.
*Calibrated thresholds*, one per kind, select what to redact: the lowest score at which candidates kept from training
are personal data in at least ``PRECISION`` of cases. Spans that the exact rules find always stay.

Labels come from the data. Positive are spans of the exact rules, the same data rewritten in other forms (spelt-out
signs, other separators and groups, a dropped plus), and candidates that hold a valid card number, address or phone
number though the rules lost it, as in two numbers side by side. Negative are rewritten forms spoilt in a digit,
candidates with a wrong check digit or octet, and words around an "at" without a domain. Candidates of which nothing is
known take no part. Examples come from at most ``TRAIN_ROWS`` documents for each kind that may hold that kind, those
with the smallest seeded hash of their id, and at most ``EXAMPLES`` of each kind and label by the hash of their
features. Finding spans reads whole texts in Arrow tasks and moves no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, first_of_each, slices

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS = 1000
EXAMPLES = 4000
PRECISION = 0.95

# The exact rules. Looking back for a digit only skips starts that cannot match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Generators: one scan for places where anything may begin, then one pattern per kind.
_AT = r"\s?(?:@|\(at\)|\[at\]|\{at\}|\sat\s)\s?"
_DOT = r"\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?"
_LOOSE = {
    "email": re.compile(rf"(?<![\w.+-])[\w.+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:[._-]|\[\.\]|\(dot\))\s?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+|00)?[0-9]{0,3}[ ./-]{0,2}\(?[0-9]{3}\)?[ ./-]{0,2}[0-9]{3}[ ./-]{0,2}[0-9]{4}(?![0-9])"),
}
_CARD_GROUPS = re.compile(r"(?<![0-9])[0-9]{4}(?:([ ._/-]?)[0-9]{4})(?:\1[0-9]{4}){2}(?![0-9])")
_INTERNATIONAL = re.compile(r"(?<![0-9+])(?:\+|00)[0-9]{1,3}(?:[ ./-]{0,2}\(?[0-9]{1,5}\)?){2,6}(?![0-9])")
_HEX_IP = re.compile(r"(?<![0-9A-Za-z.])0[xX][0-9A-Fa-f]{1,2}(?:\.0[xX][0-9A-Fa-f]{1,2}){3}(?![0-9A-Za-z])")
#: Whether a document may hold a kind, for choosing training documents.
_MAY_HOLD = (r"@|\(at\)|\[at\]", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9]([ -]?[0-9]){13}", r"\+[0-9]|[0-9]{3}[ ./-][0-9]{4}")
_MAY_EMAIL = re.compile(r"@|[(\[{]at[)\]}]|\sat\s")
_CUES = {
    "email": ("mail", "write", "reach"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "pay", "credit"),
    "phone": ("phone", "call", "tel", "mobile"),
}

FEATURES = 24
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """Spans of the exact rules: per kind leftmost and non-overlapping, failing matches dropped without another try."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m.group())]
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def candidates(text: str) -> list[Span]:
    """What the generators propose."""
    out: list[Span] = []
    if _MAY_EMAIL.search(text):
        out += [(m.start(), 0, m.end()) for m in _LOOSE["email"].finditer(text)]
    if re.search("[0-9]{3}", text):
        for kind in (1, 2, 3):
            out += [(m.start(), kind, m.end()) for m in _LOOSE[KINDS[kind]].finditer(text)]
        out += [(m.start(), 3, m.end()) for m in _INTERNATIONAL.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in _CARD_GROUPS.finditer(text)]
    if "0x" in text or "0X" in text:
        out += [(m.start(), 1, m.end()) for m in _HEX_IP.finditer(text)]
    return sorted(set(out))


def known_label(text: str, span: Span) -> float | None:
    """What the form of a candidate tells about it; None where it tells nothing."""
    start, kind, end = span
    body = text[start:end]
    digits = _digits(body)
    if kind == 0:
        return float("@" in body)
    if kind == 1:
        parts = re.findall("[0-9]+", body) if "x" not in body.lower() else ["0"]
        return float(all(int(x) <= 255 for x in parts))
    if kind == 2:
        return float(14 <= len(digits) <= 19 and luhn(digits))
    return 1.0 if body.startswith("+") and 10 <= len(digits) <= 15 else None


def features(text: str, span: Span) -> list[float]:
    """Format of the span and what stands around it."""
    start, kind, end = span
    body = text[start:end]
    digits = _digits(body)
    groups = [len(g) for g in re.findall("[0-9]+", body)] or [0]
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 24]
    if kind == 0:  # an address is none by its digits; what counts is how its signs are written
        domain = re.split(_AT, body, maxsplit=1)[-1]
        marks = [bool(re.search(p, body)) for p in (r"@|[(\[{]at", r"\sat\s")]
        marks += [bool(re.search(p, domain)) for p in (r"[(\[{]dot|\sdot\s", r"\S\.\S", r"\.\s", r"[.)\]}\s][A-Z][a-z]*$")]
        digits, groups = "", [int(m) for m in marks]
    octets = [int(g[:4]) for g in re.findall("[0-9]+", body)[:4]]
    top = re.search(r"([A-Za-z]+)$", body)
    return [
        kind,
        len(body),
        len(digits),
        groups[0] + 2 * groups[1] if kind == 0 else len(groups),
        groups[2] if kind == 0 else max(groups),
        groups[3] if kind == 0 else min(groups),
        groups[4] if kind == 0 else len(body) - len(digits),
        float(luhn(digits)) if len(digits) > 1 else 0.0,
        groups[5] if kind == 0 else max(octets, default=0),
        float(len(set(digits))),
        float(body.startswith(("+", "00"))),
        float("(" in body),
        float("@" in body),
        float(bool(re.search(r"[(\[{\s](?:at|dot)[)\]}\s]", body))),
        float(" " in body),
        float(body.count(".")),
        float(body.count("-")),
        float(len(top.group()) if top else 0),
        float(before[-1:].isalnum() or before[-1:] in ("=", "#", "_")),
        float(after[:1].isalnum()),
        float(any(cue in before for cue in _CUES[KINDS[kind]])),
        float(sum(c.isdigit() for c in before) + sum(c.isdigit() for c in after)),
        float(int(digits[0]) if digits else -1),
        float(bool(re.search(r"\w\s?\.\s?\w", body)) and kind == 0 and "@" not in body),
    ]


def rewritten(kind: int, body: str, rng: random.Random) -> str:
    """The same datum as people also write it."""
    if kind == 0:
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", "."), ("@", "."), ("@", " . "), (" @ ", ".")])
        local, _, domain = body.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        hexed = ".".join(f"0x{int(p):02x}" for p in body.split("."))
        return rng.choice([body.replace(".", "[.]"), body.replace(".", "-"), body, body.replace(".", "(dot)"), hexed])
    digits = _digits(body)
    if kind == 2:
        sep = rng.choice([".", "/", "_", "  ", " ", "-", ""])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    country, rest = digits[:-10], digits[-10:]
    if rng.random() < 0.4:  # groups as in other countries
        at, groups = 0, [rng.choice(["+", "00"]) + str(rng.randrange(20, 999))]
        while at < len(rest):
            size = rng.choice([2, 3, 4])
            size = size if len(rest) - at - size != 1 else size + 1
            groups.append(rest[at : at + size])
            at += size
        return rng.choice([" ", "-", "."]).join(groups)
    area, sep = rest[:3], rng.choice([".", "-", " ", "/"])
    return rng.choice(["", "+" + country + " ", "00" + country + sep]) + rng.choice([area + sep, f"({area}) "]) + rest[3:6] + sep + rest[6:]


def spoilt(kind: int, body: str, rng: random.Random) -> str:
    """Of the same shape, but no datum."""
    digits = [i for i, c in enumerate(body) if c.isdigit()]
    if kind == 0:
        return rng.choice(["stand at the dot com", "look at this. then", body.replace("@", " at ").split(".")[0] + " the.end"])
    if kind == 1:
        return re.sub("[0-9]+", lambda m: str(rng.randrange(256, 1000)), body, count=rng.randrange(1, 4))
    out = list(body)
    if kind == 2 and digits:
        i = rng.choice(digits)
        out[i] = str((int(out[i]) + rng.randrange(1, 10)) % 10)
        return "".join(out)
    return "".join(str(rng.randrange(10)) for _ in range(rng.choice([10, 11, 12])))


@dataclass
class Trees:
    """Oblivious trees of depth 3 for the log-odds, and the threshold of each kind."""

    base: float = 0.0
    columns: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    leaves: np.ndarray = field(default_factory=lambda: np.zeros((0, 8)))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(KINDS), np.inf))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for column, cut, leaf in zip(self.columns, self.cuts, self.leaves, strict=True):
            z += leaf[(x[:, column] > cut) @ np.array([1, 2, 4])]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Newton boosting on the logistic loss; a fifth of the rows only sets the thresholds."""
    if len(y) < 20 or y.min() == y.max():
        return Trees()
    order = np.random.default_rng(5).permutation(len(y))
    kept, learn = order[::5], np.setdiff1d(order, order[::5])
    xs, ys = x[learn], y[learn]
    grids = [np.unique(np.quantile(xs[:, c], np.linspace(0, 1, 33)[:-1])) for c in range(x.shape[1])]
    share = ys.mean()
    out = Trees(float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    z = np.full(len(ys), out.base)
    columns, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - ys, np.maximum(p * (1 - p), 1e-9)
        leaf = np.zeros(len(ys), np.int64)
        chosen = []
        for depth in range(3):
            best = (-1.0, 0, 0.0)
            width = 1 << depth
            for c, grid in enumerate(grids):
                bins = np.searchsorted(grid, xs[:, c])
                at = leaf * (len(grid) + 1) + bins
                gs = np.bincount(at, g, width * (len(grid) + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(at, h, width * (len(grid) + 1)).reshape(width, -1).cumsum(1)
                right_g, right_h = gs[:, -1:] - gs, hs[:, -1:] - hs
                gain = (gs**2 / (hs + ridge) + right_g**2 / (right_h + ridge)).sum(0)[:-1]
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), c, float(grid[gain.argmax()]))
            chosen.append(best[1:])
            leaf |= (xs[:, best[1]] > best[2]).astype(np.int64) << depth
        value = -rate * np.bincount(leaf, g, 8) / (np.bincount(leaf, h, 8) + ridge)
        z += value[leaf]
        columns.append([c for c, _ in chosen])
        cuts.append([t for _, t in chosen])
        leaves.append(value)
    out.columns, out.cuts, out.leaves = np.array(columns), np.array(cuts), np.array(leaves)
    s = out.scores(x[kept])
    for kind in range(len(KINDS)):
        mine = x[kept, 0] == kind
        ranked = np.argsort(-s[mine], kind="stable")
        good = np.cumsum(y[kept][mine][ranked]) / np.arange(1, mine.sum() + 1)
        ok = np.flatnonzero(good >= PRECISION)
        if len(ok):
            out.thresholds[kind] = max(0.5, float(s[mine][ranked][ok[-1]]))
    return out


def examples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates in the texts and of rewritten and spoilt forms put in their place."""
    rng = random.Random(11)
    x: list[list[float]] = []
    y: list[float] = []

    def add(text: str, lo: int, hi: int, kind: int, label: float) -> None:
        for span in candidates(text):
            if span[1] == kind and span[0] < hi and span[2] > lo and span[0] >= lo - 3 and span[2] <= hi + 3:
                x.append(features(text, span))
                y.append(label)

    for text in texts:
        known = base_spans(text)
        for span in candidates(text):
            same = any(b[1] == span[1] and b[0] < span[2] and span[0] < b[2] for b in known)
            label = 1.0 if same else known_label(text, span)
            if label is not None:
                x.append(features(text, span))
                y.append(label)
        for start, kind, end in known:
            around = text[max(0, start - 60) : start], text[end : end + 60]
            for make, label in ((rewritten, 1.0), (rewritten, 1.0), (spoilt, 0.0), (spoilt, 0.0)):
                body = make(kind, text[start:end], rng)
                if label == 0.0 and any(s[1] == kind for s in base_spans(body)):
                    continue
                add(around[0] + body + around[1], len(around[0]), len(around[0]) + len(body), kind, label)
    return np.array(x, float).reshape(len(x), FEATURES), np.array(y, float)


def train(docs: DataFrame, most: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Fits on at most ``most`` whole documents for each kind, those that may hold it with the smallest seeded hash of
    their id, and at most ``EXAMPLES`` of each kind and label. Rows without an id or a text take no part. Without
    candidates of both labels nothing is added to the rules."""
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_id is not null and _text is not null")
    may = F.array_compact(F.array(*[F.when(F.col("_text").rlike(p), F.lit(k)) for k, p in enumerate(_MAY_HOLD)]))
    order = [F.xxhash64("_id", F.lit(31)), F.col("_id")]
    some = first_of_each(own.select("_id", F.explode(may).alias("_kind")).distinct(), "_kind", order, most)
    ddl = "kind int, y double, x array<double>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, y = examples([t.as_py() for t in batch.column(0)])
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(y, pa.float64()), pa.array(x.tolist(), schema.types[2])], schema=schema)

    joined = own.join(F.broadcast(some.select("_id").distinct()), "_id").select("_text")  # at most `most` ids for each kind
    drawn = Window.partitionBy("kind", "y").orderBy(F.xxhash64("x"), "x")
    # by label only once the hash has cut, so that neither label crowds out the other
    table = joined.mapInArrow(run, ddl).withColumn("n", F.row_number().over(drawn)).where(F.col("n") <= EXAMPLES).orderBy("kind", "y", "n").toArrow()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, FEATURES)
    return fit(x, table.column("y").to_numpy())


def find_spans(text: str, trees: Trees) -> tuple[list[Span], list[Span]]:
    """The spans of the exact rules, and all spans: those and what the trees add.

    An added span overlaps no exact span of its kind.
    """
    base = base_spans(text)
    found = [c for c in candidates(text) if not any(b[1] == c[1] and b[0] < c[2] and c[0] < b[2] for b in base)]
    if not found or not len(trees.leaves):
        return base, base
    x = np.array([features(text, c) for c in found])
    keep = trees.scores(x) >= trees.thresholds[x[:, 0].astype(int)]
    return base, sorted({*base, *(c for c, k in zip(found, keep, strict=True) if k)})


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind.

    All rows and columns stay, repeated ones too; a null text stays null, an empty one empty; an empty table gives an
    empty result.
    """
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for start, kind, end in find_spans(text, trees)[1]:
            if start >= done:
                out += [text[done:start], f"[{KINDS[kind]}]"]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t.as_py()) for t in columns[at]], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def span_digest(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row of ``docs``.

    Counts and digest are of the exact rules' spans, ``spans`` are all, ordered by start and then kind, as code points
    with the end exclusive. A null text is empty. Repeated rows come back repeated, null ids stay null, an empty table
    gives an empty result, and other columns are ignored, whatever their names.
    """
    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = find_spans(text.as_py() or "", trees)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(columns, schema.types[1:], strict=True)]], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ddl)
