"""Encoding and decoding with merge-type piece vocabularies (the ``.model`` files of the sentencepiece library).

A chunk of text starts as single characters. An agenda holds its adjacent pairs that join to a piece, ordered by
score, then from the left; the best is merged until none is left. Characters outside the vocabulary become byte
pieces. No piece holds a mark of white space behind other characters, nor a line end, so words are chunks of their
own and lines are cut apart; neither changes a merge. The new chunks of an Arrow batch are merged in step, with
arrays; chunks are merged once per worker and then looked up, in a cache bounded by CACHE chunks and CACHE_CHARS
characters. Of each Arrow batch the first text, and of every ``check_every`` texts of a stream one more, go whole through
the sentencepiece library too, and so does every chunk of a rare sort (merged alone for its length, of byte pieces, or
with a run of blanks) when it is merged; a difference ends the job.

A null text is an empty one, which has the end id alone. Long texts are taken whole; repeated rows are coded each, and
rows without an id too. A table without rows gives none. Extra columns are kept out.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import trim

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Chunks and their characters in one generation of a cache; rows, and bytes but for a single longer text, handled
#: together; longest chunk that is merged in step.
CACHE, CACHE_CHARS, SLICE, SLICE_BYTES, LONG, CHECK_EVERY = 160_000, 6_000_000, 1_024, 3 << 20, 96, 512
NONE = np.iinfo(np.int64).max
_BLANKS = (MARK + MARK, "\n" + MARK)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, raw[at : at + size]
        at += size


class Vocabulary:
    """Pieces, scores and options of a model file of the merge type with byte pieces and plain normalisation."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        self.pieces, self.kinds, scores, trainer, normal = [], [], [], {}, {}
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        if trainer.get(3) != 2 or normal.get(2) or normal.get(4, 1) or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type vocabularies without rewriting rules are read here")
        self.prefix = bool(normal.get(3, 1))
        self.end = trainer.get(42, 2)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.order = {p: (-scores[i]) for p, i in self.ids.items()}
        self.plain_from = 1 + max(i for i, kind in enumerate(self.kinds) if kind != NORMAL)
        self.plain, self.decimal = [p.replace(MARK, " ") for p in self.pieces], list(map(str, range(len(self.pieces))))
        if any(MARK in p.lstrip(MARK) for p in self.ids) or len(self.byte_ids) != 256:
            raise ValueError("a piece goes over the start of a word, or byte pieces are missing")
        self._table()

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk by the agenda of its adjacent pairs."""
        n = len(chunk)
        symbols = list(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        order = self.order
        agenda = [(order[chunk[i : i + 2]], i, 2) for i in range(n - 1) if chunk[i : i + 2] in order]
        heapq.heapify(agenda)
        while agenda:
            _, left, size = heapq.heappop(agenda)
            right = after[left]
            if not symbols[left] or right >= n or len(symbols[left]) + len(symbols[right]) != size:
                continue
            joined = symbols[left] = symbols[left] + symbols[right]
            symbols[right] = ""
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                if (score := order.get(joined + symbols[nxt])) is not None:
                    heapq.heappush(agenda, (score, left, size + len(symbols[nxt])))
            if (prior := before[left]) >= 0 and (score := order.get(symbols[prior] + joined)) is not None:
                heapq.heappush(agenda, (score, prior, len(symbols[prior]) + size))
        out = []
        for s in symbols:
            if s:
                if (i := self.ids.get(s)) is not None:
                    out.append(i)
                else:
                    out.extend(self.byte_ids[b] for b in s.encode())
        return out

    def _table(self) -> None:
        """Open-addressed table of the pairs of pieces that join to a piece: key, rank of the score, joined piece."""
        scores = sorted(set(self.order.values()))
        rank = {s: i for i, s in enumerate(scores)}
        pairs = [(self.ids[p[:i]], self.ids[p[i:]], rank[self.order[p]], j) for p, j in self.ids.items() for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids]
        keys = np.array([(a << 32) | b for a, b, _, _ in pairs], np.int64)
        values = np.array([(r << 32) | j for _, _, r, j in pairs], np.int64)
        bits = int(4 * len(pairs)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.slot_keys, self.slot_values = np.full((1 << bits) + 64, -1, np.int64), np.zeros((1 << bits) + 64, np.int64)
        left = np.arange(len(keys))
        for probe in range(64):
            at = self._slots(keys[left]) + probe
            free = self.slot_keys[at] < 0
            at, new = at[free], left[free]
            first = np.unique(at, return_index=True)[1]
            self.slot_keys[at[first]], self.slot_values[at[first]] = keys[new[first]], values[new[first]]
            left = np.setdiff1d(left, new[first])
            if not len(left):
                self.probes = probe + 1
                break
        else:
            raise RuntimeError("the table of pairs is too full")

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | joined piece of each pair, or NONE."""
        keys = (left << 32) | right
        slots = self._slots(keys)
        out = np.full(len(keys), NONE, np.int64)
        todo = np.arange(len(keys))
        for probe in range(self.probes):
            got = self.slot_keys[slots[todo] + probe]
            hit = got == keys[todo]
            out[todo[hit]] = self.slot_values[slots[todo[hit]] + probe]
            todo = todo[~hit & (got >= 0)]
            if not len(todo):
                break
        return out

    def merge_all(self, chunks: list[str]) -> list[list[int]]:
        """merge() of each chunk. Chunks of up to LONG characters go in step: in each round every one of them takes
        the best entry of its agenda, by score and then from the left."""
        short = [i for i, c in enumerate(chunks) if 0 < len(c) <= LONG]
        out: list[list[int]] = [[]] * len(chunks)
        for i, c in enumerate(chunks):
            if len(c) > LONG:
                out[i] = self.merge(c)
        if not short:
            return out
        points = np.frombuffer("".join(chunks[i] for i in short).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(chunks[i]) for i in short])
        distinct, inverse = np.unique(points, return_inverse=True)
        symbol = np.array([self.ids.get(chr(p), -1 - int(p)) for p in distinct], np.int64)[inverse]
        owner = np.repeat(np.arange(len(short)), sizes)
        best = np.full(len(symbol), NONE, np.int64)
        inner = (owner[1:] == owner[:-1]) & (symbol[1:] >= 0) & (symbol[:-1] >= 0)
        at = np.flatnonzero(inner)
        best[at] = self._pairs(symbol[at], symbol[at + 1])
        done_symbols, done_owners = [], []
        while len(symbol):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.diff(np.r_[first, len(owner)])
            place = np.arange(len(owner)) - np.repeat(first, count)
            key = np.where(best == NONE, NONE, (best >> 32 << 8) | place)
            low = np.minimum.reduceat(key, first)
            live = low != NONE
            if not live.all():
                stays = np.repeat(live, count)
                done_symbols.append(symbol[~stays])
                done_owners.append(owner[~stays])
                symbol, owner, best = symbol[stays], owner[stays], best[stays]
                first, count, low = np.cumsum(np.r_[0, count[live]])[:-1], count[live], low[live]
            if not len(symbol):
                break
            at = first + (low & 255)
            symbol[at] = best[at] & 0xFFFFFFFF
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # each chunk before has lost one symbol
            symbol, owner, best = symbol[keep], owner[keep], best[keep]
            best[new] = NONE
            for a in (new - 1, new):
                a = a[(a >= 0) & (a + 1 < len(symbol))]
                a = a[(owner[a] == owner[a + 1])]
                none = (symbol[a] < 0) | (symbol[a + 1] < 0)
                best[a] = NONE
                a = a[~none]
                best[a] = self._pairs(symbol[a], symbol[a + 1])
        symbols, owners = np.concatenate(done_symbols), np.concatenate(done_owners)
        order = np.argsort(owners, kind="stable")
        symbols, ends = symbols[order], np.cumsum(np.bincount(owners, minlength=len(short)))
        starts = np.r_[0, ends[:-1]]
        flat = symbols.tolist()
        for i, start, end in zip(short, starts.tolist(), ends.tolist(), strict=True):
            out[i] = flat[start:end]
        for k in np.flatnonzero(np.minimum.reduceat(symbols, starts) < 0):
            out[short[k]] = [j for s in out[short[k]] for j in ([s] if s >= 0 else (self.byte_ids[b] for b in chr(-1 - s).encode()))]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control pieces are silent, runs of byte pieces are UTF-8, marks are spaces."""
        if ids and min(ids) >= self.plain_from:
            return "".join(map(self.plain.__getitem__, ids))
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            if self.kinds[i] != CONTROL:
                out.append(self.pieces[i])
        out.append(run.decode(errors="replace"))
        return "".join(out).replace(MARK, " ")


class Coder:
    """Texts to ids and back; chunks seen before are looked up, in two generations."""

    def __init__(self, path: str):
        self.path, self.vocabulary = path, Vocabulary(path)
        if not self.vocabulary.prefix or any("\n" in p for p in self.vocabulary.ids):
            raise ValueError("only vocabularies with a mark before the text and without pieces over line ends are read here")
        self.known = _Cache()
        self.end = str(self.vocabulary.end)
        self.runs = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def chunks(self, text: str) -> list[str]:
        """Keys of the chunks of a text: a word stands for itself behind a mark, all others are written out."""
        out: list[str] = []
        for i, line in enumerate(text.replace(MARK, " ").split("\n") if text else ()):
            words = line.split(" ")
            if "" not in words:
                if i:
                    words[0] = "\n" + words[0]
                out += words
                continue
            found = self.runs.findall((("" if i else " ") + line).replace(" ", MARK))
            if i:
                out.append("\n" + (found.pop(0) if found and found[0][0] != MARK else ""))
            out += found
        return out

    def learn(self, keys: set[str], check: bool = False) -> None:
        """Merges the chunks that are in neither generation; known holds their decimal ids joined by spaces, with the text
        that they decode to unless that is the chunk behind a blank. check: those of rare sorts go through the library too."""
        self.known.age()
        fresh = list(keys - self.known.keys() - self.known.old.keys())
        found = self.vocabulary.merge_all([k if k[0] in "\n" + MARK else MARK + k for k in fresh])
        decimal, decode, plain = self.vocabulary.decimal.__getitem__, self.vocabulary.decode, self.vocabulary.plain_from
        if check:
            check_chunks(self.path, {k: ids for k, ids in zip(fresh, found, strict=True) if len(k) >= LONG or min(ids, default=plain) < plain or k[:2] in _BLANKS})
        for key, ids in zip(fresh, found, strict=True):
            text, own = decode(ids), " ".join(map(decimal, ids))
            self.known[key] = own if text[:1] == " " and text[1:] == key else (own, text)
        self.known.chars += sum(map(len, fresh))

    def code(self, texts: list[str], check: bool = False) -> tuple[list[str], list[str]]:
        """For each text its ids with the end id, as decimals joined by spaces, and the text that they decode to."""
        chunks = [self.chunks(t) for t in texts]
        self.learn(set().union(*chunks), check)
        ids, back = [], []
        for keys in chunks:
            held = list(map(self.known.__getitem__, keys))
            ids.append(" ".join([*[h if type(h) is str else h[0] for h in held], self.end]))
            text = "".join([f" {k}" if type(h) is str else h[1] for k, h in zip(keys, held, strict=True)])
            back.append(text[1:] if text[:1] == " " else text)
        return ids, back


class _Cache(dict):
    """Two generations: a full young one is aged, and what is used again returns from the old one."""

    def __init__(self):
        self.old: dict = {}
        self.chars = 0

    def age(self) -> None:
        if len(self) >= CACHE or self.chars >= CACHE_CHARS:
            self.old = dict(self)
            self.clear()
            self.chars = 0

    def __missing__(self, key):
        value = self[key] = self.old[key]
        self.chars += len(key)
        return value


@functools.lru_cache(2)
def coder_of(path: str) -> Coder:
    """One coder for each worker process, so that tasks share what it has seen."""
    return Coder(path)


@functools.lru_cache(2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_batch(path: str, texts: list[str], ids: list[str], decoded: list[str]) -> None:
    """Compares results with the sentencepiece library's for the same texts."""
    library = _library(path)
    for text, own, back in zip(texts, ids, decoded, strict=True):
        other = library.encode(text, add_eos=True, num_threads=1)
        if own != " ".join(map(str, other)) or back != library.decode(other):
            raise AssertionError(f"the library differs on a text that starts {text[:60]!r}")


def check_chunks(path: str, found: dict[str, list[int]]) -> None:
    """Compares the ids of chunks with the library's. It puts a mark before whatever it gets, as chunks() leaves off
    words; before a line end that mark is a piece of its own."""
    library, keys = _library(path), list(found)
    texts = [k.lstrip(MARK) if k[0] != MARK else k.replace(MARK, " ")[1:] for k in keys]
    for key, other in zip(keys, library.encode(texts, num_threads=1), strict=True):
        if found[key] != (other[1:] if key[0] == "\n" else other):
            raise AssertionError(f"the library differs on a chunk that starts {key[:60]!r}")


def _coded(batches, model_path: str, check_every: int):
    """(batch slice, ids, decoded texts); of each batch the first row goes through the library too, and one of
    ``check_every`` rows of the stream. 0: none does, and no chunk."""
    coder = coder_of(model_path)
    seen = 0
    for batch in batches:
        total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0))])
        at, part, texts, ids, decoded = 0, None, [], [], []
        while at < batch.num_rows:
            part = batch.slice(at, min(SLICE, max(1, int(np.searchsorted(total, total[at] + SLICE_BYTES, "right")) - 1 - at)))
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids, decoded = coder.code(texts, bool(check_every))
            if check_every:
                pick = [i for i in range(len(texts)) if not (seen + i) % check_every or not at + i]
                check_batch(model_path, [texts[i] for i in pick], [ids[i] for i in pick], [decoded[i] for i in pick])
            seen, at = seen + len(texts), at + len(texts)
            yield part, ids, decoded
        del batch, part, texts, ids, decoded  # before the next batch is read
    trim()


def encoded(docs: DataFrame, model_path: str, check_every: int = CHECK_EVERY) -> DataFrame:
    """(doc_id, ids array<int>, decoded): the ids with the end id, and the text that they decode to."""

    def run(batches):
        for part, ids, decoded in _coded(batches, model_path, check_every):
            lists = [list(map(int, i.split(" "))) for i in ids]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str, check_every: int = CHECK_EVERY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``."""

    def run(batches):
        for part, ids, decoded in _coded(batches, model_path, check_every):
            counts = [i.count(" ") + 1 for i in ids]
            hexes = [[hashlib.sha256(x.encode()).hexdigest() for x in xs] for xs in (ids, decoded)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), *map(pa.array, hexes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
