"""Edit-aware token counts (operator 7).

A document's pre-tokens are grouped into leaves of a segment tree that holds
the tokens and characters below each node.  An edit re-reads the leaves it
touches and, as boundary context, what stands up to two characters before (a pre-token may grow to the
right) and those after up to the first pre-token boundary that old and new
text share: from there on the split is as it was, since the split rule never
looks back.  New counts go into the touched leaves and up to the root; nothing
else is encoded again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import pre_tokens
from .common import type_of
from .words import Cache, byte_signs

#: Characters of a leaf when it is built, at least.
LEAF = 256


class TokenCounter:
    """Tokens of a pre-token, by the tokenizers library, kept for the words a worker has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model, self.signs, self.known = Tokenizer.from_file(path).model, byte_signs(), Cache(self._tokens)

    def _tokens(self, word: str) -> int:
        return len(self.model.tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.signs)))

    def count(self, words: list[str]) -> int:
        return sum(map(self.known.get, words))


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


class TokenTree:
    """Characters and tokens of the leaves of one text, with the sums of all subtrees.

    ``chars`` and ``tokens`` are arrays of a complete binary tree: node i has
    the children 2 i and 2 i + 1, leaf k is node ``width`` + k.
    """

    def __init__(self, chars: list[int], tokens: list[int]):
        self.width = 1
        while self.width < len(chars):
            self.width *= 2
        pad = [0] * (self.width - len(chars))
        self.chars, self.tokens = [0] * self.width + chars + pad, [0] * self.width + tokens + pad
        self.n_leaves = len(chars)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @classmethod
    def build(cls, text: str, count: TokenCounter, leaf: int = LEAF) -> TokenTree:
        chars, tokens, part, size = [], [], [], 0
        for w in pre_tokens(text):
            part.append(w)
            size += len(w)
            if size >= leaf:
                chars.append(size)
                tokens.append(count.count(part))
                part, size = [], 0
        if part or not chars:
            chars.append(size)
            tokens.append(count.count(part))
        return cls(chars, tokens)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one with text if ``at`` is the end), and where it starts."""
        node, start, at = 1, 0, min(at, max(0, self.chars[1] - 1))
        while node < self.width:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.width
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def edit(self, text: str, start: int, stop: int, new: str, count: TokenCounter) -> tuple[str, int]:
        """Replaces ``text[start:stop]``; the new text and how many characters were read again."""
        # A pre-token that begins two characters before the edit may be a contraction that the edit completes.
        first, begin = self.find(max(0, start - 2))
        last, last_begin = self.find(max(stop, start + 1) - 1 if stop > start else start)
        last, last_begin = max((last, last_begin), (first, begin))
        after = text[:start] + new + text[stop:]
        moved = len(after) - len(text)
        end = last_begin + self.chars[self.width + last]
        while True:
            # One leaf more than the edit touches, so that a boundary can be met again within it.
            more = last + 1
            while more < self.n_leaves and not self.chars[self.width + more]:
                more += 1
            ahead = end + (self.chars[self.width + more] if more < self.n_leaves else 0)
            at, words, done = begin, [], ahead >= len(text)
            for w in pre_tokens(after[begin : ahead + moved]):
                if at == end + moved and at > start + len(new):
                    done = True
                    break
                words.append(w)
                at += len(w)
            if done or more >= self.n_leaves:
                break
            last, end = more, ahead
        read = sum(map(len, words))
        if begin + read != end + moved:  # to the end of the text: the leaf looked ahead to is part of it
            last = more if more < self.n_leaves else last
        self._set(first, read, count.count(words))
        for leaf in range(first + 1, last + 1):
            self._set(leaf, 0, 0)
        return after, read


def count_with_edits(
    docs: DataFrame,
    edits: Column,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    leaf: int = LEAF,
    leaves: tuple[str, str] | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """One row for each input row: ``doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_read, leaf_chars, leaf_tokens``.

    ``edits`` is an array of ``struct<start, stop, new>`` (code points), applied
    in turn, each to the text the one before left; places outside the text
    are moved to its ends, null fields mean 0, ``start`` and "".  The leaf
    columns are the tree after the edits; with ``keep_text`` the edited text
    follows as ``text``.  Given as ``leaves`` to a later call, the tree is
    taken from them and only what the edits touch is encoded; a row whose
    leaves are null or do not add up to its text gets a new tree.

    Special tokens' strings are ordinary text.  Null text counts as empty, a
    null array as no edit.  A very long text has more leaves, not larger ones.
    """
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_read", "leaf_chars", "leaf_tokens", *["text"] * keep_text]

    def run(batches):
        count = counter(tokenizer)
        for b in batches:
            rows = []
            for text, todo, chars, tokens in zip(*(b.column(j).to_pylist() for j in (1, 2, 3, 4))):
                stored = bool(chars) and bool(tokens) and len(chars) == len(tokens) and sum(chars) == len(text)
                tree = TokenTree(chars, tokens) if stored else TokenTree.build(text, count, leaf)
                before, read = tree.n_tokens, 0
                for e in todo or ():
                    start = min(max(e["start"] or 0, 0), len(text))
                    stop = min(max(start if e["stop"] is None else e["stop"], start), len(text))
                    text, n = tree.edit(text, start, stop, e["new"] or "", count)
                    read += n
                own = slice(tree.width, tree.width + tree.n_leaves)
                rows.append((before, len(todo or ()), tree.n_tokens, read, tree.chars[own], tree.tokens[own], text))
            types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 2 + [pa.string()] * keep_text
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]], names=names)

    kept = [F.col(c).cast("array<int>") if leaves else F.lit(None).cast("array<int>") for c in leaves or ("", "")]
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        edits.cast("array<struct<start:bigint,stop:bigint,new:string>>").alias("edits"), kept[0].alias("chars"), kept[1].alias("tokens"),
    )
    schema = f"doc_id {type_of(docs, id_col)}, n_tokens long, n_edits long, n_tokens_edited long, n_chars_read long, leaf_chars array<int>, leaf_tokens array<int>"
    return rows.mapInArrow(run, schema + ", text string" * keep_text)
