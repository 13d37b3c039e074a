"""BPE encoding and decoding over a minimal acyclic transducer lexicon.

The tokenizer file holds the vocabulary and the ranked merges.  Its whole words
(tokens that carry the end-of-word mark) are the frequent words: ``compile_lexicon``
merges each once and stores them, with their ids as output, in a minimal acyclic
automaton whose equal suffixes are shared.  An arc carries the number of words
before it, so the sum along a path is the word's index into the output table.
The compiled lexicon is one flat byte string of fixed size (it depends on the
vocabulary only), sent to the workers, which map it into memory.  Words outside
it are merged exactly by rank.  A bounded memo of words stands in front.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import map_batches, strings, text_rows

END = "</w>"
#: Pieces of text in one generation of a worker's memo.
MEMO = 400_000
#: Marks a special token among pieces; no text holds a lone surrogate.
SPECIAL = "\ud800"

# Plain characters need neither normalisation nor Unicode classes: ASCII and the Latin-1 letters,
# but for four separators on which Python splits and the tokenizer does not.
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]")
_PLAIN_WORD = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t\n\r\x0b\x0ca-z0-9ß-öø-ÿ]+")
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
_ANY_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    letters = {b: chr(b) for b in shown}
    return [letters[b] if b in letters else chr(next(spare)) for b in range(256)]


class Merger:
    """Exact merging of one word by the ranked pairs of the tokenizer file."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]]):
        self.vocabulary = vocabulary
        self.letters = byte_letters()
        self.inner = [vocabulary[c] for c in self.letters]
        self.last = [vocabulary[c + END] for c in self.letters]
        # Rank and outcome of a pair in one number, so that the smallest is the next to merge.
        self.pairs = {(vocabulary[a], vocabulary[b]): rank << 32 | vocabulary[a + b] for rank, (a, b) in enumerate(merges)}

    def ids(self, word: str) -> list[int]:
        data = word.encode()
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        return self._short(parts) if len(parts) <= 40 else self._long(parts)

    def _short(self, parts: list[int]) -> list[int]:
        find, never = self.pairs.get, 1 << 62
        ranks = [find(pair, never) for pair in pairwise(parts)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            parts[i] = best & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = find((parts[i], parts[i + 1]), never)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        """The same by a heap over a linked list, in n log n."""
        n = len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.pairs.get((parts[i], parts[j]))):
                heapq.heappush(heap, (found >> 32, i, parts[i], parts[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = self.pairs[left, right] & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p >= 0]


def minimal_automaton(words: list[bytes]) -> list[tuple[bool, list[tuple[int, int]]]]:
    """Minimal acyclic automaton of sorted distinct words; state 0 is the start.

    Words are added in order; once a word leaves a branch, the branch is final and
    each of its states is replaced by an equal one seen before, if there is one.
    """
    final, arcs = [False], [[]]
    register: dict[tuple, int] = {}
    path = [0]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            same = register.setdefault((final[state], tuple(arcs[state])), state)
            if same != state:
                arcs[path[-1]][-1] = (arcs[path[-1]][-1][0], same)

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared)
        for byte in word[shared:]:
            final.append(False)
            arcs.append([])
            arcs[path[-1]].append((byte, len(final) - 1))
            path.append(len(final) - 1)
        final[path[-1]] = True
        last = word
    close(0)
    number, states = {0: 0}, [0]
    for state in states:
        for _, target in arcs[state]:
            if target not in number:
                number[target] = len(states)
                states.append(target)
    return [(final[s], [(byte, number[t]) for byte, t in arcs[s]]) for s in states]


def compile_lexicon(path: str) -> bytes:
    """Compile the tokenizer file at ``path`` into one flat byte string."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    merger = Merger(model["vocab"], map(tuple, model["merges"]))
    back = {letter: byte for byte, letter in enumerate(merger.letters)}
    words = []
    for token in model["vocab"]:
        if token.endswith(END) and len(token) > len(END):
            word = bytes(back[c] for c in token[: -len(END)])
            try:
                word.decode()
            except UnicodeDecodeError:
                continue
            words.append(word)
    words.sort()
    states = minimal_automaton(words)
    below = [0] * len(states)
    depth_first, order, seen = [0], [], set()
    while depth_first:
        state = depth_first.pop()
        if state < 0:
            order.append(~state)
        elif state not in seen:
            seen.add(state)
            depth_first.append(~state)
            depth_first.extend(t for _, t in states[state][1])
    for state in order:
        below[state] = states[state][0] + sum(below[t] for _, t in states[state][1])
    first, labels, targets, counts = [], bytearray(), [], []
    for final, arcs in states:
        first.append(len(labels))
        before = int(final)
        for byte, target in arcs:
            labels.append(byte)
            targets.append(target)
            counts.append(before)
            before += below[target]
    first.append(len(labels))
    outputs = [merger.ids(w.decode()) for w in words]
    starts = np.cumsum([0, *map(len, outputs)])
    rest = json.dumps({"vocab": model["vocab"], "merges": model["merges"], "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}).encode()
    arrays = [np.array([f for f, _ in states], np.uint32), np.array(first, np.uint32), np.array(targets, np.uint32), np.array(counts, np.uint32), starts.astype(np.uint32), np.array([i for o in outputs for i in o], np.uint32)]
    parts = [*(a.tobytes() for a in arrays), bytes(labels), rest]
    head = struct.pack(f"<{len(parts)}Q", *map(len, parts))
    return head + b"".join(parts)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, blob: bytes):
        file = os.memfd_create("lexicon")  # a file in memory, which goes with the process
        try:
            with open(file, "wb", closefd=False) as out:
                out.write(blob)
            self.map = mmap.mmap(file, 0, access=mmap.ACCESS_READ)
        finally:
            os.close(file)
        sizes = struct.unpack_from("<8Q", self.map)
        at = [64]
        for size in sizes:
            at.append(at[-1] + size)
        view = memoryview(self.map)
        self.final, self.first, self.target, self.count, self.start, self.output = (view[at[i] : at[i + 1]].cast("I") for i in range(6))
        self.labels = at[6]
        rest = json.loads(self.map[at[7] : at[8]])
        self.merger = Merger(rest["vocab"], map(tuple, rest["merges"]))
        self.special: dict[str, int] = rest["special"]
        self.token = {i: t for t, i in [*rest["vocab"].items(), *self.special.items()]}
        self.heads: dict[bytes, tuple[int, int] | None] = {}
        self.first_of_special = {t[0] for t in self.special}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _walk(self, word: bytes, state: int, index: int) -> tuple[int, int] | None:
        """State and word index after the bytes of ``word``, if there is a path."""
        arc_of, first, base = self.map.find, self.first, self.labels
        for i in range(len(word)):
            arc = arc_of(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            index += self.count[arc]
            state = self.target[arc]
        return state, index

    def find(self, word: bytes) -> list[int] | None:
        """The ids of a word of the automaton, else None."""
        head = word[:4]
        if head not in self.heads:  # as many as the automaton has, and misses up to a bound
            if len(self.heads) >= MEMO:
                self.heads.clear()
            self.heads[head] = self._walk(head, 0, 0)
        at = self.heads[head]
        at = at and self._walk(word[4:], *at)
        if at is None or not self.final[at[0]]:
            return None
        return self.output[self.start[at[1]] : self.start[at[1] + 1]].tolist()

    def ids(self, word: str) -> list[int]:
        found = self.find(word.encode())
        return self.merger.ids(word) if found is None else found

    def pieces(self, text: str) -> list[str]:
        """The text cut where no word goes on: at white space, or into words, or at special tokens.

        ``words`` takes a piece further.  A special token is a piece behind ``SPECIAL``.
        """
        if self.split and any(c in text for c in self.first_of_special) and len(parts := self.split.split(text)) > 1:
            return [p for part in parts for p in ([SPECIAL + part] if part in self.special else self._pieces(part))]
        return self._pieces(text)

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if _NOT_PLAIN.search(text) is None:
            return text.lower().split()
        # Lower-casing goes by single characters, so a last sigma is like any other.
        return _ANY_WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    @staticmethod
    def words(piece: str) -> list[str]:
        return [piece] if _NOT_PLAIN.search(piece) else _PLAIN_WORD.findall(piece)


class Memo(dict):
    """piece -> what ``make`` gives for its words' ids, joined.

    Remembers a bounded number of pieces in two generations: as one fills up, the one
    before it is forgotten, so frequent pieces stay.
    """

    def __init__(self, lexicon: Lexicon, make: Callable[[list[int]], bytes], mark: bytes):
        self.lexicon, self.make, self.mark = lexicon, make, mark
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.before.get(piece)
        if out is None:
            if piece[0] == SPECIAL:
                out = self.make([self.lexicon.special[piece[1:]]])
            else:
                words = self.lexicon.words(piece)
                out = self.make(self.lexicon.ids(piece)) if len(words) == 1 else self.mark.join([self[w] for w in words])
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.before = dict(self)
                self.clear()
            self[piece] = out
        return out


_loaded: dict[str, tuple] = {}


def loaded(blob: bytes) -> tuple[Lexicon, Memo, Memo, Memo]:
    """The lexicon of this worker, with memos of packed ids, decimal ids and tokens."""
    name = hashlib.sha256(blob).hexdigest()
    if name not in _loaded:
        x = Lexicon(blob)
        packed = Memo(x, lambda ids: struct.pack(f"<{len(ids)}I", *ids), b"")
        decimal = Memo(x, lambda ids: " ".join(map(str, ids)).encode(), b" ")
        tokens = Memo(x, lambda ids: " ".join(x.token[i] for i in ids).encode(), b" ")
        _loaded[name] = x, packed, decimal, tokens
    return _loaded[name]


class Shared:
    """A broadcast lexicon; a task takes its tables on first use."""

    def __init__(self, broadcast: Broadcast):
        self.broadcast = broadcast
        self.tables = None

    def __reduce__(self):
        return Shared, (self.broadcast,)

    def get(self) -> tuple[Lexicon, Memo, Memo, Memo]:
        if self.tables is None:
            self.tables = loaded(self.broadcast.value)
        return self.tables


def share(df: DataFrame, path: str) -> Shared:
    """Compile the lexicon on the driver and broadcast it: a few MB, fixed by the vocabulary."""
    return Shared(df.sparkSession.sparkContext.broadcast(compile_lexicon(path)))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256, a row for each row of
    ``docs``.  A null or empty text has no ids; both digests are then those of the
    empty string.  Decoding joins the tokens with one space, as the tokenizer file,
    which names no decoder, asks for.
    """
    shared = share(docs, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lexicon, _, decimal, tokens = shared.get()
        counts, ids, decoded = [], [], []
        for text in strings(batch, "text"):
            pieces = lexicon.pieces(text)
            line = b" ".join(map(decimal.__getitem__, pieces))
            counts.append(line.count(b" ") + 1 if line else 0)
            ids.append(hashlib.sha256(line).hexdigest())
            decoded.append(hashlib.sha256(b" ".join(map(tokens.__getitem__, pieces))).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(text_rows(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(text: str, lexicon: Lexicon) -> list[int]:
    """The ids of one text."""
    out: list[int] = []
    for piece in lexicon.pieces(text):
        if piece[0] == SPECIAL:
            out.append(lexicon.special[piece[1:]])
        else:
            out += [i for word in lexicon.words(piece) for i in lexicon.ids(word)]
    return out


def decode(ids: Iterable[int], lexicon: Lexicon) -> str:
    """The tokens of the ids, joined by one space."""
    return " ".join(lexicon.token[i] for i in ids)
