"""A linear SVM over character n-grams: n-grams as integers, documents as packed blocks, one pass over them for each step of the solver.

A text's n-grams (of 3 to 5 code points) become integers that tell them apart, so a document's counts come from one
sort. Blocks hold, for each n-gram of a document, the distance to the one before (2 bytes) and its count (1 byte).
Objective, scaling and steps are those of Spark's ``LinearSVC`` (hinge loss, L2, centred and scaled features, OWL-QN
without L1), whose vectors take 12 bytes for each n-gram of a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

LOW, HIGH = 3, 5
#: N-grams of a chunk, which stays in the processor's cache; a gap between n-gram numbers that is filled up by steps; the code of counts that need more than a byte.
CHUNK, STEP, LARGE = 32_768, 65_535, 255
_LOGS = np.concatenate([[0.0], 1 + np.log(np.arange(1, 256))])


# -- n-grams as integers --------------------------------------------------------------------------


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Coder:
    """N-grams of known characters as integers below 2**63, each its own.

    Up to 4,095 characters, an n-gram is the digits of its characters. With more, those of 3 are numbered (``threes``,
    sorted), and a longer one is its length with the numbers of its first 3 and last 3 characters.
    """

    alphabet: np.ndarray
    threes: np.ndarray | None = None
    table: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.bits = np.uint64(max(1, int(len(self.alphabet)).bit_length()))
        self.table = np.zeros(int(self.alphabet[-1]) + 2 if len(self.alphabet) else 1, np.uint64)
        self.table[self.alphabet] = np.arange(1, len(self.alphabet) + 1)

    @property
    def wide(self) -> bool:
        return HIGH * int(self.bits) > 63

    def digits(self, text: str) -> np.ndarray:
        """The characters' numbers, 0 for unknown ones."""
        return self.table[np.minimum(code_points(text), len(self.table) - 1)]

    def of_three(self, digits: np.ndarray) -> np.ndarray:
        return (digits[:-2] << (self.bits + self.bits)) | (digits[1:-1] << self.bits) | digits[2:]

    def keys(self, text: str) -> np.ndarray:
        """The n-grams of a text, repeats included, without those of unknown characters."""
        d = self.digits(text)
        if len(d) < LOW:
            return np.zeros(0, np.uint64)
        three = self.of_three(d)
        if not self.wide:
            four = (three[:-1] << self.bits) | d[3:]
            five = (four[:-1] << self.bits) | d[4:]
            found = np.concatenate([three, four, five])
            if d.all():
                return found
            bad = np.concatenate([np.convolve(d == 0, np.ones(n, int))[n - 1 : len(d)] > 0 for n in (3, 4, 5) if len(d) >= n])
            return found[~bad]
        at = np.searchsorted(self.threes, three)
        known = (at < len(self.threes)) & (self.threes[np.minimum(at, len(self.threes) - 1)] == three)
        at = at.astype(np.uint64)
        pairs = [(np.uint64(n - LOW) << np.uint64(61)) | (at[: len(at) - (n - LOW)] << np.uint64(30)) | at[n - LOW :] for n in (3, 4, 5) if len(d) >= n]
        return np.concatenate([p[known[: len(p)] & known[len(known) - len(p) :]] for p in pairs])

    def term(self, key: int) -> str:
        b, key = int(self.bits), int(key)
        if self.wide:
            low = (1 << 30) - 1
            n, first, last = (key >> 61) + LOW, int(self.threes[(key >> 30) & low]), int(self.threes[key & low])
            tail = [(last >> (b * k)) & ((1 << b) - 1) for k in range(n - LOW - 1, -1, -1)]
            found = [(first >> (b * k)) & ((1 << b) - 1) for k in (2, 1, 0)] + tail
        else:
            found = [x for k in range(HIGH - 1, -1, -1) if (x := (key >> (b * k)) & ((1 << b) - 1))]
        return "".join(chr(int(self.alphabet[x - 1])) for x in found)


def distinct(parts: Iterable[np.ndarray], most: int = 4_000_000) -> np.ndarray:
    """The distinct values of arrays, sorted, with ``most`` values held besides those found."""
    found, held, n = np.zeros(0, np.uint64), [], 0
    for p in parts:
        held.append(p.astype(np.uint64))
        n += len(p)
        if n > most:
            found, held, n = np.unique(np.concatenate([found, *held])), [], 0
    return np.unique(np.concatenate([found, *held]))


def frequencies(texts: Iterable[str], coder: Coder, occurrences: bool, most: int = 3_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, documents that have them, occurrences) of runs of texts; without ``occurrences`` the last are the documents again."""
    held, tfs, n = [], [], 0

    def flush():
        keys = np.concatenate(held)
        if not occurrences:
            u, docs = np.unique(keys, return_counts=True)
            return u, docs, docs
        u, inverse, docs = np.unique(keys, return_inverse=True, return_counts=True)
        return u, docs, np.bincount(inverse, np.concatenate(tfs), len(u)).astype(np.int64)

    for text in texts:
        u, tf = np.unique(coder.keys(text), return_counts=True)
        held.append(u)
        if occurrences:
            tfs.append(tf)
        n += len(u)
        if n > most:
            yield flush()
            held, tfs, n = [], [], 0
    if n:
        yield flush()


@dataclass
class Lexicon:
    """The n-grams that are features: ``keys`` sorted, the number of each, the weights ln((1 + docs) / (1 + df)) by number."""

    coder: Coder
    keys: np.ndarray
    number: np.ndarray
    idf: np.ndarray
    docs: int

    def __len__(self) -> int:
        return len(self.keys)

    def term(self, number: int) -> str:
        return self.coder.term(self.keys[np.flatnonzero(self.number == number)[0]])

    @property
    def vocabulary(self) -> list[str]:
        return [self.coder.term(k) for k in self.keys[np.argsort(self.number)]]

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text's features, ascending, and how often each occurs."""
        u, tf = np.unique(self.coder.keys(text), return_counts=True)
        if not len(u) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)
        known = self.keys[at] == u
        ids, tf = self.number[at[known]], tf[known]
        order = np.argsort(ids)
        return ids[order], tf[order]

    def scale(self, ids: np.ndarray, tf: np.ndarray) -> float:
        """What brings (1 + ln tf) * idf to length 1."""
        x = (1 + np.log(tf)) * self.idf[ids]
        norm = np.sqrt(x @ x)
        return 1 / norm if norm > 0 else 1.0


# -- packed blocks --------------------------------------------------------------------------------


def pack(rows: Iterable[tuple[str, int]], lexicon: Lexicon) -> Iterator[tuple]:
    """Chunks of documents: gaps (the first of a document from 0), codes, large counts' values, starts, last features, signs, scales."""
    gaps, codes, large, starts, last, sign, scale, n = [], [], [], [], [], [], [], 0

    def chunk():
        return (np.concatenate(gaps), np.concatenate(codes), np.concatenate(large), np.array(starts, np.int32), np.array(last, np.int32), np.array(sign, np.int8), np.array(scale))

    for text, label in rows:
        if label not in (0, 1):
            raise ValueError(f"labels are 0 or 1, not {label}")
        ids, tf = lexicon.count(text)
        scale.append(lexicon.scale(ids, tf))
        gap, code = np.diff(ids, prepend=0), np.minimum(tf, LARGE)
        if not len(ids):
            gap, code = np.zeros(1, np.int64), np.zeros(1, np.int64)
        elif gap.max() >= STEP:
            steps = gap // STEP
            at = np.repeat(np.arange(len(gap)), steps)
            gap -= steps * STEP
            gap, code = np.insert(gap, at, STEP), np.insert(code, at, 0)
        starts.append(n)
        last.append(ids[-1] if len(ids) else 0)
        sign.append(2 * label - 1)
        gaps.append(gap.astype(np.uint16))
        codes.append(code.astype(np.uint8))
        large.append(1 + np.log(tf[tf >= LARGE]))
        n += len(gap)
        if n >= CHUNK:
            yield chunk()
            gaps, codes, large, starts, last, sign, scale, n = [], [], [], [], [], [], [], 0
    if starts:
        yield chunk()


def unpack(chunk: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Features and 1 + ln tf of each entry."""
    gaps, codes, large, starts, last, _, _ = chunk
    step = gaps.astype(np.int64)
    step[starts[1:]] -= last[:-1]
    logs = _LOGS.take(codes)
    if len(large):
        logs[codes == LARGE] = large
    return np.cumsum(step, out=step), logs


def moments(chunks: Iterable[tuple], lexicon: Lexicon) -> Iterator[tuple]:
    """The sum and the sum of squares of each feature."""
    one, two = np.zeros(len(lexicon) + 1), np.zeros(len(lexicon) + 1)
    for c in chunks:
        ids, x = unpack(c)
        x *= np.repeat(c[6], np.diff(c[3], append=len(ids)))
        np.add.at(one, ids, x)
        x *= x
        np.add.at(two, ids, x)
    yield one[:-1] * lexicon.idf, two[:-1] * lexicon.idf**2


def losses(chunks: Iterable[tuple], weights: np.ndarray, offset: float) -> Iterator[tuple]:
    """(hinge loss, sum of its derivatives by the score, and these times the features) for ``weights`` of 1 + ln tf, with one more for documents without features."""
    loss, total, slope = 0.0, 0.0, np.zeros(len(weights))
    for c in chunks:
        ids, logs = unpack(c)
        starts, sign, scale = c[3], c[5].astype(float), c[6]
        short = 1 - sign * (np.add.reduceat(weights.take(ids) * logs, starts) * scale + offset)
        inside = short > 0
        if not inside.any():
            continue
        loss += short[inside].sum()
        total -= sign[inside].sum()
        size = np.diff(starts, append=len(ids))
        pull = np.where(inside, -sign * scale, 0.0)
        if size[inside].sum() * 2 < len(ids):
            for k in np.flatnonzero(inside):
                a, b = starts[k], starts[k] + size[k]
                np.add.at(slope, ids[a:b], logs[a:b] * pull[k])
        else:
            logs *= np.repeat(pull, size)
            np.add.at(slope, ids, logs)
    at = np.flatnonzero(slope)
    yield (loss, total, at.astype(np.int32), slope[at]) if len(at) * 2 < len(slope) else (loss, total, None, slope)


def line(chunks: Iterable[tuple], weights: np.ndarray, change: np.ndarray, bend: np.ndarray) -> Iterator[tuple]:
    """What trials along a line need: signs, scores at its start, their change, and the entries of the features in ``bend`` (document, place in it, value)."""
    place = np.full(len(weights), -1, np.int32)
    place[bend] = np.arange(len(bend))
    for c in chunks:
        ids, logs = unpack(c)
        starts, scale = c[3], c[6]
        at = np.flatnonzero(place.take(ids) >= 0)
        row = np.searchsorted(starts, at, "right") - 1
        yield c[5], np.add.reduceat(weights.take(ids) * logs, starts) * scale, np.add.reduceat(change.take(ids) * logs, starts) * scale, row.astype(np.int32), place[ids[at]], logs[at] * scale[row]


def trial(rows: Iterable[tuple], alpha: float, bent: np.ndarray, offset: float, turn: float) -> Iterator[tuple[float, float]]:
    """(hinge loss, its derivative along the line) at ``alpha``; ``bent``: what features in ``bend`` lack there."""
    loss = slope = 0.0
    for sign, start, change, row, place, value in rows:
        score = start + alpha * change + offset
        if len(row):
            score += np.bincount(row, value * bent[place], len(sign))
        short = 1 - sign * score
        inside = short > 0
        loss += short[inside].sum()
        slope -= (sign[inside] * (change[inside] + turn)).sum()
    yield loss, slope


def decision(text: str, lexicon: Lexicon, weights: np.ndarray, offset: float) -> float:
    ids, tf = lexicon.count(text)
    return float((1 + np.log(tf)) @ weights[ids]) * lexicon.scale(ids, tf) + offset


# -- the solver -----------------------------------------------------------------------------------


class SearchFailed(ArithmeticError):
    pass


def owlqn(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, iterations: int, memory: int = 10, tolerance: float = 1e-6, along: Callable | None = None) -> np.ndarray:
    """Breeze's OWL-QN with an L1 weight of 0, as LinearSVC uses it: no coordinate changes its sign within a step.

    ``along(x, dir)`` gives a function of a step's length and end that returns value and slope there for less than ``f``.
    """
    value, grad = f(x)
    first, steps, changes, seen, failed = value, [], [], [], False
    k = 0
    while k < iterations and not (len(seen) >= 2 and abs(value - max(seen)) <= tolerance * abs(first)) and np.linalg.norm(grad) > max(tolerance * abs(value), 1e-8):
        try:
            dir_ = _direction(grad, steps, changes)
            dir_ = np.where(dir_ * grad < 0, dir_, 0.0)
            new, v, g = _search(f, x, value, grad, dir_, k, along)
        except SearchFailed:
            if failed:
                break
            failed, steps, changes = True, [], []
            continue
        failed = False
        steps, changes = [new - x, *steps][:memory], [g - grad, *changes][:memory]
        x, value, grad = new, v, g
        seen = [*seen, value][-20:]
        k += 1
    return x


def _direction(grad: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Minus the approximate inverse Hessian times the gradient."""
    out, kept = grad.copy(), []
    for s, y in zip(steps, changes, strict=True):
        rho = s @ y
        if not rho or not np.isfinite(rho):
            raise SearchFailed
        kept.append((s @ out / rho, rho))
        out -= kept[-1][0] * y
    if steps:
        if steps[0] @ changes[0] < 0:
            raise SearchFailed
        out *= (steps[0] @ changes[0]) / (changes[0] @ changes[0])
    for s, y, (a, rho) in reversed(list(zip(steps, changes, kept, strict=True))):
        out += (a - y @ out / rho) * s
    return -out


def _search(f, x: np.ndarray, value: float, grad: np.ndarray, dir_: np.ndarray, k: int, along: Callable | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """A step by the strong Wolfe conditions, shrunk or grown; the twentieth trial is taken as it is.

    Breeze takes the value before the step for that of its first trial, which so is always too long where the
    slope falls; that trial isn't evaluated here. After the first that is, trials are told by ``along``.
    """
    side = np.where(x != 0, np.sign(x), np.sign(-grad))
    slope, shrink = dir_ @ grad, 0.1 if k < 1 else 0.5
    alpha = 0.5 / np.linalg.norm(grad) if k < 1 else 1.0
    g, told = None, None
    for n in range(20):
        long = value > value + alpha * slope * 1e-4
        if n or not long:
            new = x + alpha * dir_
            new[np.sign(new) != side] = 0
            if told or along and n > 1:
                told, g = told or along(x, dir_), None
                v, d = told(alpha, new)
            else:
                v, g = f(new)
                d = g @ dir_
            long = n and v > value + alpha * slope * 1e-4
        if not long and not d < 0.9 * slope and not d > -0.9 * slope:
            break
        alpha *= shrink if long or not d < 0.9 * slope else 2.1
        if not 1e-10 <= alpha <= 1e10:
            raise SearchFailed
    return new, *((v, g) if g is not None else f(new))
