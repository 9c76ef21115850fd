"""Byte-level BPE encoding and decoding (operator 6).

Pre-tokens are counted over the whole corpus; the frequent ones are compiled
into a minimal acyclic transducer: equal suffix sub-automata are one, and the
number of words that lie before an edge adds up, along a path, to the word's
place in the table of its ids.  The automaton is one flat file that every
worker maps into memory.  A pre-token outside it is merged exactly by the
tokenizer's ranks.  Both ways give the ids that the tokenizers library gives.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import sys
import tempfile
import uuid
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import type_of, written
from .words import BLANK, CACHE, DIGIT, LETTER, UNPLAIN, UNPLAIN_SIGN, Cache, byte_signs, is_plain

#: Words in the transducer, at most; what is collected for it is bounded by this.
LEXICON = 1 << 15
# Fixed: the split rule of the byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_any = regex.compile(SPLIT)
#: The same rule over plain characters (words.UNPLAIN), and a blank that it does not let end a part.
_plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{BLANK}{LETTER}{DIGIT}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
_UNEVEN = re.compile(f"[{BLANK}](?: |\\Z)")
_ONE_BLANK = bytes.maketrans(b"\t\x0b\f\r", b"\n\n\n\n")
#: Stands before a part that has no blank before it; no plain character.
_HEAD = "\x01"


def pre_tokens(text: str) -> list[str]:
    return (_any if UNPLAIN.search(text) else _plain).findall(text)


def _is_even(raw: bytes) -> bool:
    """Nothing of _UNEVEN is in the text."""
    flat = raw.translate(_ONE_BLANK)
    return b"  " not in flat and b"\n " not in flat and not flat.endswith((b" ", b"\n"))


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        signs = {ord(s): b for b, s in byte_signs().items()}
        to_bytes = lambda token: bytes(signs[ord(c)] for c in token)
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        words = {to_bytes(t): i for t, i in file["model"]["vocab"].items() if t not in special}
        self.byte = [words[bytes([b])] for b in range(256)]
        self.ranks = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = (to_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.ranks.setdefault((words[a], words[b]), (rank, words[a + b]))
        self.rank = {pair: rank for pair, (rank, _) in self.ranks.items()}
        self.made = [0] * len(file["model"]["merges"])
        for rank, new in self.ranks.values():
            self.made[rank] = new
        self.special = special
        self.text = {i: w for w, i in words.items()} | {i: s.encode() for s, i in special.items()}
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of a pre-token: the pair of least rank is merged, leftmost first, until none has a rank."""
        ids = [*map(self.byte.__getitem__, word)]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, made = self.rank.get, self.made
        last = len(self.made)  # no rank
        order = [*map(rank, zip(ids, ids[1:]), repeat(last))]
        while order and (best := min(order)) < last:
            i = order.index(best)
            ids[i] = new = made[best]
            del ids[i + 1], order[i]
            if i:
                order[i - 1] = rank((ids[i - 1], new), last)
            if i < len(order):
                order[i] = rank((new, ids[i + 1]), last)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same over a linked list and a heap, n log n."""
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*ranks[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (p := (ids[left], ids[right])) in ranks:
                    heapq.heappush(heap, (*ranks[p], left, *p))
        return [x for x in ids if x >= 0]


def compile_transducer(words: list[bytes], outputs: list[list[int]]) -> bytes:
    """The flat transducer of sorted, distinct, non-empty words and their ids."""
    # Each state: edges (label, target), whether it ends a word; states below are shared once they are complete.
    shared: dict[tuple, int] = {}
    states: list[tuple[tuple[tuple[int, int], ...], bool]] = []
    path: list[list] = [[[], False]]  # open states along the last word: edges so far, final

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            edges, final = path.pop()
            key = (tuple(edges), final)
            if key not in shared:
                shared[key] = len(states)
                states.append(key)
            parent = path[-1][0]
            parent[-1] = (parent[-1][0], shared[key])

    last = b""
    for word in words:
        k = len(os.path.commonprefix([last, word]))
        close(k)
        for c in word[k:]:
            path[-1][0].append((c, -1))
            path.append([[], False])
        path[-1][1] = True
        last = word
    close(0)
    states.append((tuple(path[0][0]), path[0][1]))
    sizes: list[int] = []  # words below each state; targets come before their parents
    for edges, final in states:
        sizes.append(final + sum(sizes[t] for _, t in edges))
    first, labels, targets, skips, finals = [0], [], [], [], []
    for edges, final in states:
        passed = int(final)
        for c, t in edges:
            labels.append(c)
            targets.append(t)
            skips.append(passed)
            passed += sizes[t]
        first.append(len(labels))
        finals.append(int(final))
    ends = np.cumsum([0, *map(len, outputs)])
    ids = [i for out in outputs for i in out]
    parts = [np.array(x, np.int32) for x in (first, targets, skips, finals, ends, ids)]
    labels = np.array(labels, np.uint8).tobytes()
    head = np.array([*map(len, parts), len(labels)], np.int32)
    return head.tobytes() + b"".join(p.tobytes() for p in parts) + labels


class Transducer:
    """A compiled transducer, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self._map)
        sizes = view[:28].cast("i").tolist()
        at, parts = 28, []
        for n in sizes[:6]:
            parts.append(view[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.targets, self.skips, self.finals, self.ends, self.ids = parts
        self.labels = bytes(view[at : at + sizes[6]])
        self.root = len(self.finals) - 1

    def get(self, word: bytes) -> list[int] | None:
        """The word's ids, None if it is not in the lexicon."""
        state, place, first, targets, skips, edge = self.root, 0, self.first, self.targets, self.skips, self.labels.find
        for c in word:
            e = edge(c, first[state], first[state + 1])
            if e < 0:
                return None
            place += skips[e]
            state = targets[e]
        if not self.finals[state]:
            return None
        return self.ids[self.ends[place] : self.ends[place + 1]].tolist()


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    packed = array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


class Encoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids and decodes them."""

    def __init__(self, tokenizer: str, lexicon: str | None = None):
        self.vocabulary = Vocabulary(tokenizer)
        self.lexicon = Transducer(lexicon) if lexicon else None
        self.parts, self.words = Cache(self._part, CACHE * 2 // 3), Cache(self._word, CACHE * 7 // 6)  # a word costs more to make than a part of known words
        text = self.vocabulary.text
        self.text = pa.array([text.get(i, b"") for i in range(max(text) + 1)], pa.large_binary())

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        ids = self.lexicon.get(raw) if self.lexicon else None
        return _packed(self.vocabulary.merge(raw) if ids is None else ids)

    def _part(self, part: str) -> bytes:
        return b"".join(map(self.words.get, _plain.findall(" " + part)))

    def _ordinary(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        if not (is_plain(text, raw) and _is_even(raw)):
            return b"".join(map(self.words.get, pre_tokens(text)))
        # Every blank starts a part of its own, so the parts' ids follow each other.
        head, *parts = text.split(" ")
        known, made = self.parts.now.get, self.parts.get
        return b"".join([*map(self.words.get, _plain.findall(head)), *[known(p) or made(p) for p in parts]])

    def encode(self, text: str) -> bytes:
        split = self.vocabulary.special_split
        if split is None or not any(s in text for s in self.vocabulary.special):
            return self._ordinary(text)
        special = self.vocabulary.special
        return b"".join(np.array([special[p]], "<u4").tobytes() if p in special else self._ordinary(p) for p in split.split(text) if p)

    def decode(self, ids: bytes) -> str:
        taken = self.text.take(pa.array(np.frombuffer(ids, "<u4")))  # the values lie one behind the other
        if not len(taken):
            return ""
        _, ends, values = taken.buffers()
        return str(memoryview(values or b"")[: np.frombuffer(ends, "<i8")[len(taken)]], "utf-8", "replace")


_encoders: dict[tuple, Encoder] = {}


def encoder(tokenizer: str, lexicon: str | None) -> Encoder:
    """The worker's encoder; a new lexicon takes the place of the last one."""
    key = (tokenizer, lexicon)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer, SparkFiles.get(lexicon) if lexicon else None)
    return _encoders[key]


def count_pre_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n`` over all texts.

    What stands between blanks, the blank before it included, is counted by
    Spark and split once for all its places; a text that is not plain is split
    as a whole.
    """
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = F.contains("text", F.lit("<|")) | F.col("text").rlike(UNPLAIN_SIGN) | F.col("text").rlike(_UNEVEN.pattern.replace("\\Z", "\\z"))
    headed = F.concat(F.lit(_HEAD), "text")
    part = F.explode(F.when(whole, F.array(headed)).otherwise(F.split(headed, " ", -1))).alias("part")
    counted = text.select(part).groupBy("part").agg(F.count(F.lit(1)).alias("n"))

    def run(batches):
        for b in batches:
            counts: dict[str, int] = {}
            for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in pre_tokens(t[1:] if t[:1] == _HEAD else " " + t):
                    counts[w] = counts.get(w, 0) + n
            words = [w.encode("utf-8", "surrogatepass") for w in counts]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return counted.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = LEXICON) -> list[bytes]:
    """The frequent words of ``counts(word, n)``, at most ``most``: all from that frequency on which leaves no more."""
    counts = written(counts.where("n > 1"), "words")
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    left, least = most, None
    for r in sorted(counts.groupBy(step).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # 8 steps a doubling
        if r["n"] > left:
            break
        left, least = left - r["n"], r["step"]
    if least is None:
        return []
    return sorted(bytes(r["word"]) for r in counts.where(F.floor(F.log2("n") * 8).cast("int") >= least).select("word").collect())


def lexicon_file(docs: DataFrame, tokenizer: str, text_col: str = "text", most: int = LEXICON) -> str | None:
    """Compiles the corpus's frequent words and hands the file to all workers; its name there."""
    words = frequent_words(count_pre_tokens(docs, text_col), most)
    if not words:
        return None
    vocabulary = Vocabulary(tokenizer)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="patchcraft-"), name)
    with open(path, "wb") as f:
        f.write(compile_transducer(words, [vocabulary.merge(w) for w in words]))
    docs.sparkSession.sparkContext.addFile(path)
    return name


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = LEXICON, decode: bool = False, digest: bool = False) -> DataFrame:
    """One row for each input row: ``doc_id, n_tokens, ids`` and, with ``decode``, ``decoded``.

    ``ids`` are little-endian unsigned 32-bit numbers.  With ``digest`` the
    columns are ``ids_sha256`` and ``decoded_sha256`` instead, so that the ids
    stay in the worker.  Null counts as empty, and empty texts have no ids.
    Special tokens' strings get their ids, as in the tokenizers library.
    Repeated rows and null ids get a row each, empty input none.
    """
    lexicon = lexicon_file(docs, tokenizer, text_col, most)

    def run(batches):
        coder = encoder(tokenizer, lexicon)
        for b in batches:
            ids = [coder.encode(t) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if digest:
                columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
                columns.append(pa.array([hashlib.sha256(coder.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids], pa.string()))
            else:
                columns.append(pa.array(ids, pa.binary()))
                if decode:
                    columns.append(pa.array([coder.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields])

    fields = [f"doc_id {type_of(docs, id_col)}", "n_tokens long"]
    fields += ["ids_sha256 string", "decoded_sha256 string"] if digest else ["ids binary", *["decoded string"] * decode]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ", ".join(fields))


def decode_documents(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of encoded documents; null ids decode to an empty text."""

    def run(batches):
        coder = encoder(tokenizer, None)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {type_of(encoded, id_col)}, text string")
