"""Operator 10: secret scans by rules and a character convolutional network in numpy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table

KINDS = ("assign", "access", "hex", "model")


def _either_case(pattern: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


#: Matches whose value (group 2) is too short still use up their text, so the length is tested afterwards.
ASSIGN = re.compile("(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Whole runs of one class: a length in the pattern is the same as one tested afterwards.
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
#: What the network looks at besides.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
DIGIT, ALNUM, TOKEN = re.compile("[0-9]"), re.compile("[A-Za-z0-9]"), re.compile("[A-Za-z0-9]+")

LEFT, MIDDLE, RIGHT = 24, 40, 8
WIDTH, FILTERS, CHANNELS = 5, 32, 12
LENGTH = LEFT + MIDDLE + RIGHT
STEP = 20  # between windows of a long candidate: any 20 characters lie whole in one of them

Span = tuple[int, int, int, str]  # start, end, start of the value, kind


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), m.end(), m.start(2), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), m.start(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), m.start(), "hex") for m in HEX.finditer(text)]


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


class Covered:
    """Spans by start, to find those that overlap a run without a look at all."""

    def __init__(self, spans: list[Span]) -> None:
        self.spans = sorted((s, e) for s, e, _, _ in spans)
        self.ends, last = [], 0  # the furthest end so far never falls
        for _, e in self.spans:
            last = max(last, e)
            self.ends.append(last)

    def within(self, run: tuple[int, int]) -> Iterator[tuple[int, int]]:
        for i in range(bisect_right(self.ends, run[0]), len(self.spans)):
            s, e = self.spans[i]
            if s >= run[1]:
                return
            if e > run[0]:
                yield s, e


def open_parts(text: str, run: tuple[int, int], covered: Covered) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """(part, what is judged for it) for each part of a run that no rule's span covers: a part of 12 characters or more by itself, and a shorter one that goes on from a span without a separator with all of that token."""
    out, at = [], run[0]
    left = right = (-1, -1)  # the token about the last part's first and last character, walked once
    for s, e in [*covered.within(run), (run[1], run[1])]:
        if s - at >= 12:
            out.append(((at, s), (at, s)))
        elif s > at:
            left = left if left[0] <= at < left[1] else token(text, run, at)
            right = right if right[0] < s <= right[1] else token(text, run, s - 1)
            if right[1] - left[0] > s - at:
                out.append(((at, s), (left[0], right[1])))
        at = max(at, e)
    return out


def token(text: str, run: tuple[int, int], at: int) -> tuple[int, int]:
    """The letters and digits about a place of a run, or the character there where it is none."""
    if not ALNUM.match(text[at]):
        return at, at + 1
    start = at
    while start > run[0] and ALNUM.match(text[start - 1]):
        start -= 1
    return start, TOKEN.match(text, at, run[1]).end()


def windows(span: tuple[int, int]) -> list[tuple[int, int]]:
    """The span itself, or overlapping windows of ``MIDDLE`` characters over all of a longer one."""
    s, e = span
    return [(a, a + MIDDLE) for a in range(s, e - MIDDLE, STEP)] + [(max(s, e - MIDDLE), e)]


def one_window(text: str, span: tuple[int, int]) -> tuple[int, int]:
    """The window that stands for a span in training, by a hash of its text."""
    all_ = windows(span)
    return all_[zlib.crc32(text[slice(*span)].encode("utf-8", "replace")) % len(all_)]


# -- the network ----------------------------------------------------------------------------------


def encode(text: str, span: tuple[int, int]) -> np.ndarray:
    """Code points (127 for those beyond ASCII, 0 for none) of the context before, the window of a candidate, and the context after (either may lie in the same run), each in its place."""
    s, e = span
    out = np.zeros(LENGTH, np.uint8)
    for at, part in ((LEFT - min(LEFT, s), text[max(0, s - LEFT) : s]), (LEFT, text[s : min(e, s + MIDDLE)]), (LEFT + MIDDLE, text[e : e + RIGHT])):
        out[at : at + len(part)] = [min(ord(c), 127) for c in part]
    return out


def channels() -> np.ndarray:
    """Fixed properties of the 128 codes: the network's input channels."""
    table_ = np.zeros((128, CHANNELS), np.float32)
    for code in range(1, 128):
        c = chr(code)
        flags = [c.islower(), c.isupper(), c.isdigit(), c in "abcdef", c in "ABCDEF", c in "+/=", c in "_-", c in ".@", c in ":=", c in "\"'", c.isspace(), code == 127 or c in "aeiou"]
        table_[code] = flags
    return table_


@dataclass
class Network:
    """Embedding (fixed properties of a character and four learnt numbers), one convolution with ReLU, maximum and mean over the candidate and its context, a logistic output, Platt calibration and a threshold."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @staticmethod
    def fresh(seed: int) -> Network:
        r = np.random.default_rng(seed)
        normal = lambda *s: r.normal(0, np.sqrt(2 / s[0]), s).astype(np.float32)
        embed = np.concatenate([channels(), r.normal(0, 0.1, (128, 4)).astype(np.float32)], axis=1)
        return Network({"embed": embed, "conv": normal(WIDTH * (CHANNELS + 4), FILTERS), "bias": np.zeros(FILTERS, np.float32), "out": normal(2 * FILTERS, 1)[:, 0], "off": np.zeros(1, np.float32)})

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        e = w["embed"][x]
        windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - WIDTH + 1, -1)
        h = np.maximum(windows @ w["conv"] + w["bias"], 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None, :], axis=1)[:, 0], h.mean(axis=1)], axis=1)
        return pooled @ w["out"] + w["off"][0], (windows, h, top, pooled)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        z, (windows, h, top, pooled) = self.forward(x)
        dz = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        dp = dz[:, None] * w["out"]
        dh = np.repeat(dp[:, None, FILTERS:] / h.shape[1], h.shape[1], axis=1)
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        dh[rows, top, cols] += dp[:, :FILTERS]
        dh *= h > 0
        flat = dh.reshape(-1, FILTERS)
        back = (flat @ w["conv"].T).reshape(len(x), h.shape[1], WIDTH, -1)[..., CHANNELS:]
        inputs = np.zeros((len(x), LENGTH, back.shape[-1]), np.float32)
        for i in range(WIDTH):
            inputs[:, i : i + h.shape[1]] += back[:, :, i]
        embed = np.zeros_like(w["embed"])
        for i in range(back.shape[-1]):
            embed[:, CHANNELS + i] = np.bincount(x.ravel(), weights=inputs[..., i].ravel(), minlength=128)
        return {"embed": embed, "conv": windows.reshape(len(flat), -1).T @ flat, "bias": flat.sum(axis=0), "out": pooled.T @ dz, "off": dz.sum(keepdims=True)}

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.forward(x[i : i + 1024])[0] for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-(self.scale * z + self.shift)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 3, steps: int = 200, min_recall: float = 0.98, unruled: np.ndarray | None = None) -> Network:
    """Fit by Adam on four fifths; on the rest, calibrate by Platt's scaling, then take the highest threshold that still finds ``min_recall`` of the secrets, of those that no rule finds (``unruled``) where they are told."""
    r = np.random.default_rng(seed)
    order = r.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    net = Network.fresh(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        pick = r.choice(used, min(128, len(used)), replace=False)
        for k, g in net.gradients(x[pick], y[pick]).items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            net.weights[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    z = np.concatenate([net.forward(x[held[i : i + 1024]])[0] for i in range(0, len(held), 1024)])
    # Platt's targets keep the fit finite where the classes are apart.
    good = y[held] == 1
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, np.array([((p - target) * z).sum(), (p - target).sum()]))
        a, b = a - 0.5 * move[0], b - 0.5 * move[1]
    net.scale, net.shift = float(a), float(b)
    counted = good if unruled is None else good & unruled[held]
    found = np.sort(net.probability(x[held][counted]))
    net.threshold = float(found[int((1 - min_recall) * len(found))]) if len(found) else 0.5
    return net


def made_findings(n: int, seed: int) -> list[tuple[str, tuple[int, int], int]]:
    """Labelled findings made from a seed: keys of common shapes after telling words, and harmless runs (numbers, dates, addresses, versions, paths, long words)."""
    r = random.Random(seed)
    letters, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz"
    digits = "0123456789"
    some = lambda pool, a, b: "".join(r.choice(pool) for _ in range(r.randint(a, b)))
    word = lambda: some(small, 2, 9)
    secret = [
        lambda: some(letters + digits, 20, 44),
        lambda: some(letters + digits + "+/", 28, 60) + "=" * r.randint(0, 2),
        lambda: some("0123456789abcdef", 16, 64),
        lambda: some("0123456789ABCDEF", 20, 64),
        lambda: r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "key-"]) + some(letters + digits, 16, 36),
        lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + digits, 14, 20),
    ]
    plain = [
        lambda: some(digits, 12, 20),
        lambda: ".".join(str(r.randint(100, 255)) for _ in range(4)),
        lambda: f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}",
        lambda: f"{word()}.{r.randint(1, 99)}.mail{r.randint(1, 9)}.example.com",
        lambda: "/".join(word() for _ in range(4)) + f"/{r.randint(1, 999)}.html",
        lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 9999)}",
        lambda: some(small, 10, 18) + r.choice(digits),
        lambda: f"v{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}-{word()}-{word()}",
        lambda: "-".join(some(digits, 3, 4) for _ in range(4)),
    ]
    out = []
    for _ in range(n):
        good = r.random() < 0.5
        value = r.choice(secret if good else plain)()
        before = " ".join(word() for _ in range(r.randint(0, 5)))
        lead = r.choice([" ", " key: ", ' "', " auth=", " credential ", " (", " bearer ", "="]) if good else r.choice([" ", " id ", " (", ' "', " no. ", ": "])
        text = before + lead + value + r.choice(["", " ", '"', ".", ")", "\n"]) + r.choice(["", " ", " " + word()])
        at = len(before) + len(lead)
        out.append((text, (at, at + len(value)), int(good)))
    return out


def made_runs(n: int, seed: int) -> list[tuple[str, tuple[int, int], int]]:
    """Labelled windows of long runs made from a seed: dotted names and paths, every other one with a key at its end or inside. A window that holds only a part of a key is left out."""
    r = random.Random(seed)
    small, every = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda pool, a, b: "".join(r.choice(pool) for _ in range(r.randint(a, b)))
    out = []
    for i in range(n):
        mark = r.choice("./_-")
        part = lambda: r.choice([some(small, 2, 11), some(small, 2, 11), some("0123456789", 1, 4), some(small, 2, 6).title()])
        harmless = lambda a, b: mark.join(part() for _ in range(r.randint(a, b)))
        head, key, tail = harmless(6, 18) + r.choice("=/.") * (i % 2), "", ""
        if i % 2:
            key = r.choice(["", "", "ghp_", "sk_live_", "xoxb-", "key-"]) + some(every, 16, 44)
            tail = mark + harmless(1, 12) if r.random() < 0.3 else ""
        lead = " ".join(some(small, 2, 9) for _ in range(r.randint(0, 4))) + r.choice([" ", ' "', " (", ": "])
        text = lead + head + key + tail + r.choice(["", " ", '"', ".\n", ") " + some(small, 2, 9)])
        a = len(lead) + len(head)
        for s, e in windows((len(lead), a + len(key) + len(tail))):
            both = min(e, a + len(key)) - max(s, a)
            if both <= 0 or both >= min(len(key), 20):
                out.append((text, (s, e), int(both > 0)))
    return r.sample(out, min(n, len(out)))


def made_letters(n: int, seed: int) -> list[tuple[str, tuple[int, int], int]]:
    """Labelled runs without a digit made from a seed: keys of letters, and long words alone or joined, in any case, and repeated characters."""
    r = random.Random(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    word = lambda a, b: "".join(r.choice(["", *"bcdfghklmnprstvwy"]) + r.choice("aeiou") + r.choice(["", "", "n", "r", "s", "t", "st", "ng"]) for _ in range(r.randint(a, b)))
    plain = [
        lambda: word(5, 9),
        lambda: word(5, 9).title(),
        lambda: word(5, 9).upper(),
        lambda: r.choice("-_./=").join(word(2, 4) for _ in range(r.randint(3, 8))),
        lambda: r.choice(["get", "is", word(1, 2)]) + "".join(word(1, 4).title() for _ in range(r.randint(3, 5))),
        lambda: "".join(word(1, 4).title() for _ in range(r.randint(3, 6))),
        lambda: r.choice("=-_.+/zaxX") * r.randint(12, 80),
        lambda: f"www.{word(2, 5)}.com/{word(2, 4)}",
    ]
    out = []
    for _ in range(n):
        good = r.random() < 0.5
        key = r.choice(["", "", "", "ghp_", "sk_live_", "key-"]) + "".join(r.choice(letters) for _ in range(r.randint(16, 44)))
        value = key if good else r.choice(plain)()
        lead = " ".join(word(1, 3) for _ in range(r.randint(0, 4))) + r.choice([" ", ' "', " (", ": ", " key: "])
        out.append((lead + value + r.choice(["", " ", '"', ". ", ", " + word(1, 3)]), (len(lead), len(lead) + len(value)), int(good)))
    return out


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = 2000, max_findings: int = 4000, made: int = 3000, seed: int = 3) -> Network:
    """Train on labelled findings: those that rules settle in at most about ``max_docs`` documents chosen by a hash of the key (positive: in a rule's span; negative: in none), at most ``max_findings`` and a third each of positives and of negatives with and without a digit, and ``made`` made ones, with half as many windows of long made runs and runs without a digit each. Of a finding longer than a window one window is used.

    A run in no rule's span may be a secret that no rule knows. So a first network learns from the positives
    and the made findings, and the negatives that it takes for secrets are left out for the second.
    """
    every = max(1, -(-docs.count() // max_docs))
    rows = docs.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(0).to_pylist():
                spans = base_spans(t)
                covered = Covered(spans)
                found += [(encode(t, one_window(t, (v, e))).tobytes(), 1) for _, e, v, _ in spans]
                found += [(encode(t, one_window(t, c)).tobytes(), 0 if DIGIT.search(t, *c) else 2) for c in candidates(t) if not any(covered.within(c))]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.binary()), pa.array([y for _, y in found], pa.int32())], names=["x", "y"])

    found = rows.mapInArrow(run, "x binary, y int").distinct()
    sample = [f for kind in (0, 1, 2) for f in found.where(F.col("y") == kind).orderBy(F.xxhash64("x"), "x").limit(max_findings // 3).collect()]
    own = [(t, one_window(t, s), g) for t, s, g in made_findings(made, seed)] + made_runs(made // 2, seed) + [(t, one_window(t, s), g) for t, s, g in made_letters(made // 2, seed)]
    unruled = np.array([False] * len(sample) + [not any(Covered(base_spans(t)).within(s)) for t, s, _ in own])
    x = np.stack([np.frombuffer(bytes(f["x"]), np.uint8) for f in sample] + [encode(t, s) for t, s, _ in own])
    y = np.array([f["y"] % 2 for f in sample] + [g for _, _, g in own], np.float32)
    found = np.arange(len(x)) < len(sample)
    sure = ~found | (y == 1)
    first = train(x[sure], y[sure], seed)
    sure[found & (y == 0)] = first.probability(x[found & (y == 0)]) < 0.5
    return train(x[sure], y[sure], seed, unruled=unruled[sure])


# -- the scan -------------------------------------------------------------------------------------


def scan_texts(texts: list[str], net: Network) -> list[list[Span]]:
    """Spans of each text: those of the rules, and what they leave open of candidates where the network takes any window for a secret; by start, then kind as listed."""
    base = [base_spans(t) for t in texts]
    covered = [Covered(b) for b in base]
    open_ = [(i, c) for i, t in enumerate(texts) for run in candidates(t) for c in open_parts(t, run, covered[i])]
    judged = list(dict.fromkeys((i, j) for i, (_, j) in open_))  # parts of one token are judged by it together
    best: dict[tuple[int, tuple[int, int]], float] = {}
    at = 0
    while at < len(judged):  # some ten thousand windows at once
        to, size = at, 0
        while to < len(judged) and size < 10_000:
            size += len(windows(judged[to][1]))
            to += 1
        parts = [windows(j) for _, j in judged[at:to]]
        p = net.probability(np.stack([encode(texts[i], w) for (i, _), ws in zip(judged[at:to], parts, strict=True) for w in ws]))
        best |= dict(zip(judged[at:to], np.maximum.reduceat(p, np.cumsum([0, *map(len, parts[:-1])])).tolist(), strict=True))
        at = to
    for i, ((s, e), j) in open_:
        if best[i, j] >= net.threshold:
            base[i].append((s, e, s, "model"))
    return [sorted(b, key=lambda x: (x[0], KINDS.index(x[3]), x[1])) for b in base]


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """Replace the value of each span, overlapping ones together, by ``mark``."""
    out, at = [], 0
    for v, e in sorted((v, e) for _, e, v, _ in spans):
        if e <= at:
            continue
        if v >= at:
            out += [text[at:v], mark]
        at = e
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(all columns of ``docs``, spans array of (kind, start, end, value_start), redacted) for each row.

    Offsets are in code points of the whole text, ends exclusive. Null text is empty and stays null in
    ``redacted``. Very long texts are scanned whole, in time about in proportion to their length; spans of one
    start are in the order of kinds, and overlapping ones are all reported and redacted together. Columns named
    spans or redacted give way. Repeated rows are scanned each; an empty table gives no rows.
    """
    kept = docs.drop("spans", "redacted")
    rows = kept.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    schema = rows.sparkSession.createDataFrame([], "spans array<struct<kind:string,start:int,end:int,value_start:int>>, redacted string").schema
    schema = type(schema)([*kept.schema.fields, *schema.fields])
    at = kept.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            found = scan_texts(texts, net)
            nulls = b.column(at).is_null().to_pylist()
            clean = [None if n else redact(t, s) for t, s, n in zip(texts, found, nulls, strict=True)]
            spans = [[{"kind": k, "start": s, "end": e, "value_start": v} for s, e, v, k in x] for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(spans, kind), pa.array(clean, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all ``documents``; training on a bounded sample of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        for b in batches:
            found = scan_texts([t or "" for t in b.column(1).to_pylist()], net)
            join = lambda x: ",".join([f"{k}:{s}:{e}" for s, e, _, k in x])
            base = [[s for s in x if s[3] != "model"] for x in found]
            counts = [pa.array([sum(s[3] == k for s in x) for x in base], pa.int64()) for k in KINDS[:3]]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([hashlib.sha256(join(x).encode()).hexdigest() for x in base]), pa.array([join(x) for x in found])], names=names)

    schema = type(docs.schema)([docs.schema["doc_id"], *spark.createDataFrame([], "n_assign long, n_access long, n_hex long, base_sha256 string, spans string").schema.fields])
    return docs.mapInArrow(run, schema)
