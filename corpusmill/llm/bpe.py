"""Operator 9: BPE encoding and decoding by batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table

_SPACES = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACE_RUN = regex.compile(f"[{_SPACES}]+")
_NO_RANK = np.int64(1) << 62
#: Bytes of a word from which it is merged by itself.
LONG = 1000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next free one from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def every_other(starts: np.ndarray) -> np.ndarray:
    """Of places in runs (True where a run starts), the first, third and so on of each run."""
    at = np.arange(len(starts))
    return (at - np.maximum.accumulate(np.where(starts, at, 0))) % 2 == 0


class WordBpe:
    """A BPE with word ends over bytes, read from a tokenizer file: special strings are cut out of the raw text, the rest is normalised (NFC, white space, lower case) and split into words by the file's pattern."""

    def __init__(self, path: str, cache: int = 200_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (vocab | specials).items()}
        self.size = max(self.token) + 1
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _SPACES)
        self.words = regex.compile(pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")")
        self.cache_size = cache
        #: word -> (ids as little-endian bytes, its tokens joined by spaces). A special string is no
        #: ordinary word, as the pattern cuts its "<|" from letters.
        self.fixed = {s: (np.array([i], "<u4").tobytes(), s) for s, i in specials.items()}
        self.known: dict[str, tuple[bytes, str]] = dict(self.fixed)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. All words' symbols lie in one flat array; each round looks up every neighbouring pair by binary search and merges, in each word, the pairs of its lowest rank, leftmost first."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(lengths > LONG).tolist():
            found = self.merge_long(symbols[ends[i] - lengths[i] : ends[i]])
            done.append((np.full(len(found), i), found))
        short = (lengths <= LONG)[owner]
        symbols, owner = symbols[short], owner[short]
        while len(symbols):
            rank = np.append(np.where(owner[:-1] == owner[1:], self.rank_of(symbols[:-1], symbols[1:]), _NO_RANK), _NO_RANK)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(owner)])
            lowest = np.repeat(best, sizes)
            hit = (rank == lowest) & (rank != _NO_RANK)
            # Of pairs that overlap (a run of one symbol) every other one is merged, from the left.
            places = np.flatnonzero(hit)
            places = places[every_other(np.r_[True, np.diff(places) != 1][: len(places)])]
            symbols = symbols.copy()
            symbols[places] = self.merged[rank[places]]
            stay = np.ones(len(symbols), bool)
            stay[places + 1] = False
            finished = np.repeat(best == _NO_RANK, sizes)
            if finished.any():
                done.append((owner[finished], symbols[finished]))
            stay &= ~finished
            symbols, owner = symbols[stay], owner[stay]
        owners = np.concatenate([o for o, _ in done])
        ids = np.concatenate([s for _, s in done])
        order = np.argsort(owners, kind="stable")
        return np.split(ids[order].astype("<u4"), np.cumsum(np.bincount(owners, minlength=len(words)))[:-1])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, by binary search over the sorted keys of pairs."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of one long word: the same rounds, but a round only touches the pairs of its rank and those beside them. Places of each rank are kept, and dropped when they are looked at after a change."""
        n = len(symbols)
        symbols, alive = symbols.copy(), np.ones(n + 1, bool)
        left, right = np.arange(-1, n), np.arange(1, n + 2)  # the place n stands for the end
        rank = np.append(self.rank_of(symbols[:-1], symbols[1:]), [_NO_RANK, _NO_RANK])
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def add(places: np.ndarray) -> None:
            places = places[rank[places] != _NO_RANK]
            order = np.argsort(rank[places], kind="stable")
            places = places[order]
            for part in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1) if len(places) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    heapq.heappush(ranks, r)
                waiting.setdefault(r, []).append(part)

        add(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[alive[places] & (rank[places] == r)]
            if not len(places):
                continue
            places = places[every_other(np.r_[True, right[places[:-1]] != places[1:]])]
            gone = right[places]
            symbols[places] = self.merged[r]
            alive[gone] = False
            after = right[gone]
            right[places] = after
            left[after] = places
            beside = np.unique(np.r_[places, left[places][left[places] >= 0]])
            beside = beside[alive[beside]]
            ahead = right[beside]
            inside = ahead < n
            rank[beside] = _NO_RANK
            rank[beside[inside]] = self.rank_of(symbols[beside[inside]], symbols[ahead[inside]])
            add(beside)
        return symbols[alive[:n]]

    def split(self, text: str) -> list[str]:
        """Words and special strings of a text, in order."""
        out: list[str] = []
        for part in self.special.split(text) if "<|" in text else (text,):
            if part in self.fixed:
                out.append(part)
            elif part:
                # Each character is lower-cased alone, so a final sigma is no case of its own.
                flat = _SPACE_RUN.sub(" ", unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower()
                out += self.words.findall(flat)
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        split = [self.split(t) for t in texts]
        fresh: set[str] = set()
        for words in split:
            fresh.update(words)
        known = self.known
        fresh -= known.keys()
        if len(known) + len(fresh) > self.cache_size:
            known.clear()
            known.update(self.fixed)
            fresh = {w for words in split for w in words} - known.keys()
        todo = sorted(fresh)
        for i in range(0, len(todo), 20_000):
            part = todo[i : i + 20_000]
            for w, ids in zip(part, self.merge(part), strict=True):
                known[w] = (ids.tobytes(), " ".join([self.token[x] for x in ids.tolist()]))
        for words in split:
            found = [known[w] for w in words]
            yield b"".join([x for x, _ in found]), " ".join([x for _, x in found])


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One tokenizer per process and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _slices(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """(``key``, n_tokens, ids array<int> if ``ids``, decoded, ids_sha256, decoded_sha256) of every whole text.

    Equal to the tokenizers library's encode with add_special_tokens=False, and its decode with
    skip_special_tokens=False. ``path``: a tokenizer file that every worker can read. Null text is empty and
    has no tokens. Repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    extra = "ids array<int>, decoded string, " if ids else ""
    schema = rows.select(key).schema
    for f in rows.sparkSession.createDataFrame([], f"n_tokens long, {extra}ids_sha256 string, decoded_sha256 string").schema:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            at = 0
            for texts in _slices(b.column(1).to_pylist()):
                found = list(bpe.encode(texts))
                columns = [b.column(0).slice(at, len(texts)), pa.array([len(i) // 4 for i, _ in found], pa.int64())]
                if ids:
                    ends = np.cumsum([0, *[len(i) // 4 for i, _ in found]]).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join([i for i, _ in found]), "<i4"), pa.int32())
                    columns += [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([d for _, d in found], pa.string())]
                columns += [pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], pa.string()), pa.array([hashlib.sha256(d.encode("utf-8")).hexdigest() for _, d in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                at += len(texts)

    return rows.mapInArrow(run, schema)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of all ``documents``."""
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), ids=False)
