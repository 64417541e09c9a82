"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Attention over a piece of n tokens costs about LINEAR * n + QUADRATIC * n * n. Pieces are taken in
descending order and each goes to the lowest-cost sequence that still has room for it; what fits in
no sequence whole is cut to fill the roomiest ones. Tokenising and packing happen in one pass over
each input partition, in groups of a bounded number of tokens, so nothing is shuffled, memory does
not grow with the data (a worker holds one group, one run of texts of bounded size and the ids of a
bounded number of words, which serve its next task too; the encoder grew by 128 MB over 107 MB of text), and a lost executor repeats only its own partition with the same result.

Every group has exactly as much room as tokens: full sequences of max_tokens, and for the rest
sequences whose lengths are powers of two, which take no padding.

Cases: null text is empty and has the end token alone; repeated rows are packed once each; an empty
table gives no pieces; texts longer than a sequence are cut at multiples of max_tokens; other
columns of the input are ignored.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

MAX_TOKENS = 4096
END_ID = 2
#: Sequences in one packing group; a group holds about 4 MB of ids.
GROUP_SEQUENCES = 256
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Words whose ids are remembered in each worker, in each of two halves (some 130 bytes a word, and a run's new words more), and the longest such word.
CACHE_WORDS, CACHE_CHARS = 300_000, 48
#: Bytes of text whose words are looked up at once.
PART_CHARS = 1 << 22
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_COMBINING = re.compile("[̀-ͯ]")
#: Kinds of bytes: ASCII letters, and the marks that are tokens apart from letters before them.
_LETTER, _MARK = 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(string.ascii_letters.encode())] = _LETTER
_KINDS[list(string.punctuation.replace("'", "").encode())] = _MARK
_LINES = bytes.maketrans(b"\n", b" ")
_FOLD = bytes.maketrans(string.ascii_uppercase.encode() + b"\n", string.ascii_lowercase.encode() + b" ")
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of whole texts, through a memory of the ids of their words, of two halves of a bounded size.

    The vocabulary's words end at white space, so a text's ids are its words' ids one after the
    other. The words of a run of texts are told apart by Arrow, which also puts their ids in the texts' order, so
    that Python sees each distinct word of a run once. Marks after ASCII and Latin-1 letters are words of their own. Words not seen before are encoded together in one call and
    told apart by the tokens that end a word.
    ASCII letters are lowered first, as the tokenizer does it, unless a combining mark could join
    with one. Texts with a special token's opening are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache, self.older = {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_mixed(self, words: list[str]) -> None:
        """Any words without white space or combining marks, told apart by where their tokens begin."""
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in some])
            cuts = np.searchsorted(np.array([o[0] for o in e.offsets], np.int64), ends).tolist()
            raw = np.array(e.ids, "<u4").tobytes()
            self.cache.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(some, [0, *cuts[:-1]], cuts))

    def learn(self, words: list[str]) -> None:
        """Words of letters: each is one run of tokens of which only the last is an end of a word."""
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(some):
                raw = ids.tobytes()
                self.cache.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(some, [0, *cuts[:-1]], cuts))
            else:
                self.cache.update((w, self.direct(w)) for w in some)

    def remember(self, words: list[str]) -> dict[str, bytes]:
        """Brings the ids of words that the younger half of the memory lacks into it; those of words that are not kept are returned."""
        plain, mixed, odd = [], [], []
        for w in self.recall(words):
            if len(w) > CACHE_CHARS:
                odd.append(w)
            elif w.isalpha():
                plain.append(w)
            else:
                (mixed if w.isprintable() and not _COMBINING.search(w) else odd).append(w)
        self.learn(plain)
        self.learn_mixed(mixed)
        return {w: self.direct(w) for w in odd}

    def recall(self, words: list[str]) -> list[str]:
        """Brings what the older half knows of the words into the younger one; returns the others."""
        found = list(map(self.older.get, words))
        self.cache.update((w, x) for w, x in zip(words, found) if x is not None)
        return [w for w, x in zip(words, found) if x is None]

    def look_up(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part, a lowered text or words of one."""
        data, lasts = spaced(parts)
        ends = np.flatnonzero(data == 32) + 1
        bounds = np.concatenate([[0], ends]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(ends), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        n = len(words.dictionary)
        _, bounds, names = words.dictionary.buffers()
        distinct = names.to_pybytes()[: np.frombuffer(bounds, np.int32)[n]].decode().split(" ")[:n]
        found = list(map(self.cache.get, distinct))
        new = [j for j, x in enumerate(found) if x is None]
        other = self.remember([distinct[j] for j in new])
        for j in new:
            found[j] = other[distinct[j]] if distinct[j] in other else self.cache[distinct[j]]
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        _, bounds, ids = pa.array(found, pa.binary()).take(words.indices).buffers()
        cuts = np.frombuffer(bounds, np.int32)[np.searchsorted(ends, lasts) + 1].tolist()
        raw = ids.to_pybytes() if ids else b""
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def parts(self, text: bytes) -> Iterator[bytes]:
        """A text cut at spaces, which go, into parts of about PART_CHARS bytes; a longer word is a part."""
        at = 0
        while len(text) - at > PART_CHARS:
            end = text.rfind(b" ", at, at + PART_CHARS)
            end = end if end >= at else text.find(b" ", at + PART_CHARS)
            if end < 0:
                break
            yield text[at:end]
            at = end + 1
        yield text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as unsigned little-endian 32-bit numbers. Texts of some PART_CHARS at once are best."""
        out: list[list[bytes]] = [[] for _ in texts]
        run: list[tuple[int, bytes]] = []
        size = 0

        def join() -> None:
            for (i, _), ids in zip(run, self.look_up([p for _, p in run]) if run else ()):
                out[i].append(ids)
            run.clear()

        for i, t in enumerate(texts):
            if "<|" in t:
                out[i].append(self.direct(t))
                continue
            raw = t.encode()
            combining = (b"\xcc" in raw or b"\xcd" in raw) and _COMBINING.search(t)
            for part in self.parts(raw.translate(_LINES if combining else _FOLD)):
                if len(part) > PART_CHARS:  # one word
                    join()
                    out[i].append(self.direct(part.decode()))
                    size = 0
                    continue
                run.append((i, part))
                size += len(part)
                if size > PART_CHARS:
                    join()
                    size = 0
        join()
        return [b"".join(x) for x in out]


def spaced(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The parts as one, with a space after each and between a letter and a mark after it; and where each one's last space ends."""
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    marks = np.flatnonzero(_KINDS[data] == _MARK)
    before, latin = data[marks - 1], (data[marks - 2] == 0xC3) & (marks > 1)
    at = marks[(marks > 0) & ((_KINDS[before] == _LETTER) | latin & (before >= 0x80) & (before != 0x97) & (before != 0xB7))]
    lasts = np.cumsum([len(p) + 1 for p in parts])
    return np.insert(data, at, 32), lasts + np.searchsorted(at, lasts)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about PART_CHARS bytes of text each, or of one longer text."""
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, done + PART_CHARS, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, int(size[to - 1])


def powers(n: int) -> list[int]:
    """The powers of two that sum to n, descending."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def assign(lengths: list[int], max_tokens: int = MAX_TOKENS) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Places pieces of the given lengths; (piece, start in it, length, sequence, offset in that) and the sequences' lengths."""
    whole = [(i, a, max_tokens) for i, n in enumerate(lengths) for a in range(0, n - n % max_tokens, max_tokens)]
    rest = sorted(((n % max_tokens, i) for i, n in enumerate(lengths) if n % max_tokens), key=lambda x: (-x[0], x[1]))
    out = [(i, a, n, s, 0) for s, (i, a, n) in enumerate(whole)]
    total = sum(n for n, _ in rest)
    room = np.array([max_tokens] * (total // max_tokens) + powers(total % max_tokens), np.int64)
    sizes, cost, base = room.tolist(), np.zeros(len(room)), len(whole)
    for n, i in rest:
        at = lengths[i] - n
        while n:
            fits = np.flatnonzero(room >= n)
            s = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            m = min(n, int(room[s]))
            out.append((i, at, m, base + s, sizes[s] - int(room[s])))
            room[s] -= m
            cost[s] += LINEAR * m + QUADRATIC * m * m
            at, n = at + m, n - m
    return out, [max_tokens] * base + sizes


def pack(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, group_sequences: int = GROUP_SEQUENCES) -> DataFrame:
    """docs (doc_id, text) to PIECES. tokenizer: a file of the tokenizers library, the public one if None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        sequence, held, tokens = TaskContext.get().partitionId() << 36, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            placed, sizes = assign([len(b) // 4 for _, b in held], max_tokens)
            rows = [(held[i][0], a, n, zlib.crc32(memoryview(held[i][1])[4 * a : 4 * (a + n)]), len(held[i][1]) // 4, sequence + s, o) for i, a, n, s, o in placed]
            sequence += len(sizes)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            for part in slices(batch, 1):
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode([t or "" for t in part.column(1).to_pylist()])):
                    held.append((doc_id, ids + end))
                    tokens += len(ids) // 4 + 1
                    if tokens >= group_sequences * max_tokens:
                        yield flush()
                        tokens = 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
