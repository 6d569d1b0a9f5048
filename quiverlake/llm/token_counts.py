"""Exact token counts at every prefix of a text, by dynamic programming.

A byte-pair vocabulary has the property that the encoding of a prefix is the
encoding of a shorter prefix and one more piece, and that a sequence of pieces
is an encoding exactly if each neighbouring pair is the encoding of its own
concatenation. So for every prefix p there is one piece t that ends there and
fits behind the last piece of the prefix p - |t|:

    last[p] = t,   count[p] = count[p - |t|] + cost(t)

The table is built for all distinct chunks of an Arrow batch side by side (a
numpy wave per position). A chunk is a run of spaces with the word behind it;
no piece of the vocabulary spans two chunks, so prefixes of a text add up from
prefixes of its chunks. Pair verdicts are asked from the library once a pair.
Truncation and budget questions are then look-ups in the table.

Rows: a null or empty text has 0 tokens. Repeated rows are counted each. Other
columns of the input are not read. Nothing is truncated.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

#: Chunks longer than this go one at a time, as waves over few chunks are slow.
LONG = 48
#: What a Python worker keeps before it starts afresh: distinct chunks, prefixes of them (4 bytes each), and verdicts on pairs.
KEEP, KEEP_PREFIXES, KEEP_PAIRS = 600_000, 16_000_000, 1_000_000
#: Code points that are worked on at once, if they are of several texts.
AT_ONCE = 4_000_000
SPACE = "▁"


class PrefixCounter:
    """Token counts of every prefix under one sentencepiece BPE model."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        # A line feed is spelt in bytes, so nothing merges across it; it keeps the library's leading space away.
        self.fence = "\n"
        self.fenced = len(self.sp.encode(self.fence))
        n = self.sp.get_piece_size()
        special = lambda i: self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)
        self.surface = [self.sp.id_to_piece(i) for i in range(n)]
        self.unknown = n
        self.surface.append("")
        self.ids = {self.surface[i]: i for i in range(n) if not special(i)}
        self._build_trie()
        self._forget_pairs()
        self.forget()

    def _forget_pairs(self) -> None:
        self.pairs: dict[int, bool] = {}
        self.pair_keys = np.full(1 << 16, -1, np.int64)

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts: list[int] = [0]
        self.prefix = np.zeros(1 << 16, np.int32)

    # ---- the vocabulary as a trie in one open-addressed table -------------

    def _build_trie(self) -> None:
        letters = sorted({c for p in self.ids for c in p})
        self.sym_of = np.zeros(0x110000, np.int32)
        for k, c in enumerate(letters, 1):
            self.sym_of[ord(c)] = k
        self.width = len(letters) + 1
        children: dict[int, int] = {}
        token = [-1]
        for piece, i in self.ids.items():
            node = 0
            for c in piece:
                key = node * self.width + int(self.sym_of[ord(c)])
                if key not in children:
                    children[key] = len(token)
                    token.append(-1)
                node = children[key]
            token[node] = i
        self.children, self.token_of = children, np.array(token, np.int32)
        size = 1 << 19
        self.trie_mask = size - 1
        self.trie_keys, self.trie_next = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        keys = np.fromiter(children, np.int64, len(children))
        for key, slot in zip(keys.tolist(), self._slot(keys, size - 1).tolist(), strict=True):
            while self.trie_keys[slot] >= 0:
                slot = (slot + 1) & self.trie_mask
            self.trie_keys[slot], self.trie_next[slot] = key, children[key]

    @staticmethod
    def _slot(keys: np.ndarray, mask: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(33)).astype(np.int64) & mask

    def _step(self, node: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """The child nodes, -1 where there is none."""
        keys = node.astype(np.int64) * self.width + sym
        slot = self._slot(keys, self.trie_mask)
        found = self.trie_keys[slot]
        out = np.where(found == keys, self.trie_next[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & self.trie_mask
            found = self.trie_keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.trie_next[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    # ---- which pieces may follow which -----------------------------------

    def _learn(self, keys: np.ndarray) -> None:
        keys = np.unique(keys)
        n = self.unknown + 1
        left, right = (keys // n).tolist(), (keys % n).tolist()
        verdict = [a == self.unknown or b == self.unknown for a, b in zip(left, right, strict=True)]
        ask = [k for k, v in enumerate(verdict) if not v]
        for k, got in zip(ask, self.sp.encode([self.fence + self.surface[left[k]] + self.surface[right[k]] for k in ask], num_threads=1), strict=True):
            verdict[k] = got[self.fenced :] == [left[k], right[k]]
        self.pairs.update(zip(keys.tolist(), verdict, strict=True))
        if 4 * len(self.pairs) > self.pair_keys.size:
            self.pair_keys = np.full(8 * self.pair_keys.size, -1, np.int64)
            keys, verdict = np.fromiter(self.pairs, np.int64, len(self.pairs)), list(self.pairs.values())
        entry = keys * 2 + np.array(verdict, np.int64)
        mask, slot = self.pair_keys.size - 1, self._slot(keys, self.pair_keys.size - 1)
        left_over = np.arange(keys.size)
        while left_over.size:
            at = slot[left_over]
            free = self.pair_keys[at] < 0
            self.pair_keys[at[free]] = entry[left_over[free]]
            left_over = left_over[self.pair_keys[at] != entry[left_over]]
            slot[left_over] = (slot[left_over] + 1) & mask

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        """1 valid, 0 not, -1 not known."""
        mask = self.pair_keys.size - 1
        slot = self._slot(keys, mask)
        found = self.pair_keys[slot]
        out = np.where((found >> 1) == keys, found & 1, -1)
        open_ = np.flatnonzero((out < 0) & (found >= 0))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & mask
            found = self.pair_keys[slot[open_]]
            hit = (found >> 1) == keys[open_]
            out[open_[hit]] = found[hit] & 1
            open_ = open_[~hit & (found >= 0)]
        return out

    def fits(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys = last.astype(np.int64) * (self.unknown + 1) + token
        out = self._look_up(keys)
        new = out < 0
        if new.any():
            self._learn(keys[new])
            out[new] = self._look_up(keys[new])
        return out == 1

    # ---- the tables --------------------------------------------------------

    def _waves(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all prefixes of short chunks: flat, and where each starts."""
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(-length, kind="stable")
        width = length + 1
        base = np.cumsum(width) - width
        sym = np.zeros(int(width.sum()), np.int32)
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.repeat(base - (np.cumsum(length) - length), length) + np.arange(points.size)
        sym[place] = self.sym_of[points]
        cost_unknown = np.ones(sym.size, np.int32)
        cost_unknown[place] = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
        count = np.zeros(sym.size, np.int32)
        last = np.full(sym.size, self.unknown, np.int32)
        sorted_base, sorted_length = base[order], length[order]
        deepest = int(length.max(initial=0))
        for p in range(deepest):
            live = int(np.searchsorted(-sorted_length, -p, side="left"))
            start = sorted_base[:live] + p
            end = sorted_base[:live] + sorted_length[:live]
            none = self.token_of[self._step(np.zeros(live, np.int32), sym[start])] < 0
            none |= sym[start] == 0
            at = start[none]
            count[at + 1] = count[at] + cost_unknown[at]
            last[at + 1] = self.unknown
            node, here = np.zeros(live, np.int32), start
            first = start
            while here.size:
                node = self._step(node, sym[here])
                ok = (node >= 0) & (sym[here] > 0)
                node, here, first, end = node[ok], here[ok], first[ok], end[ok]
                token = self.token_of[node]
                whole = np.flatnonzero(token >= 0)
                if whole.size:
                    token, origin = token[whole], first[whole]
                    good = self.fits(last[origin], token)
                    origin, to = origin[good], here[whole][good] + 1
                    count[to] = count[origin] + 1
                    last[to] = token[good]
                here = here + 1
                more = here < end
                node, here, first, end = node[more], here[more], first[more], end[more]
        return count, base

    def _alone(self, chunk: str) -> list[int]:
        """Counts of all prefixes of one long chunk."""
        n, fits = self.unknown + 1, self.pairs
        count, last = [0] * (len(chunk) + 1), [self.unknown] * (len(chunk) + 1)
        sym = self.sym_of[np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        token_of = self.token_of.tolist() if not hasattr(self, "_tokens") else self._tokens
        self._tokens = token_of
        for p, s in enumerate(sym):
            if not s or token_of[self.children.get(s, 0)] < 0:
                count[p + 1] = count[p] + len(chunk[p].encode("utf-8", "surrogatepass"))
                last[p + 1] = self.unknown
                if not s:
                    continue
            node, behind = 0, last[p] * n
            for q in range(p, len(sym)):
                node = self.children.get(node * self.width + sym[q], -1) if sym[q] else -1
                if node < 0:
                    break
                t = token_of[node]
                if t >= 0:
                    if behind + t not in fits:
                        self._learn(np.array([behind + t], np.int64))
                    if fits[behind + t]:
                        count[q + 1], last[q + 1] = count[p] + 1, t
        return count

    def add(self, chunks: Iterable[str]) -> None:
        """Puts new chunks' tables behind those that are known."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.index]
        short, long_ = [c for c in new if len(c) <= LONG], [c for c in new if len(c) > LONG]
        tables = [(short, self._waves(short)[0])] if short else []
        tables += [([c], np.array(self._alone(c), np.int32)) for c in long_]
        for names, flat in tables:
            at = self.starts[-1]
            while at + flat.size > self.prefix.size:
                self.prefix = np.concatenate([self.prefix, np.zeros_like(self.prefix)])
            self.prefix[at : at + flat.size] = flat
            for c in names:
                self.index[c] = len(self.starts) - 1
                self.starts.append(self.starts[-1] + len(c) + 1)

    def tables(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """For each text: its chunks, their rows in the store, and the counts after each chunk."""
        split = [chunks_of(t) for t in texts]
        if len(self.index) > KEEP or self.starts[-1] > KEEP_PREFIXES:
            self.forget()
        if len(self.pairs) > KEEP_PAIRS:
            self._forget_pairs()
        index = self.index
        fresh = {c for s in split for c in s if c not in index}
        if fresh:
            self.add(fresh)
        starts = np.array(self.starts, np.int64)
        for s in split:
            row = np.fromiter(map(index.__getitem__, s), np.int64, len(s))
            yield s, row, np.cumsum(self.prefix[starts[row + 1] - 1])

    def every_prefix(self, text: str) -> np.ndarray:
        """count[p] for p = 0 .. len(text): the tokens of text[:p]."""
        ((chunks, row, total),) = self.tables([text])
        parts, before = [np.zeros(1, np.int64)], 0
        for c, r, after in zip(chunks, row.tolist(), total.tolist(), strict=True):
            at = self.starts[r]
            parts.append(before + self.prefix[at + 1 : at + len(c) + 1].astype(np.int64))
            before = after
        out = np.concatenate(parts)
        return np.concatenate([[0], out[2:]]) if chunks else out

    def counts(self, texts: list[str], limit: int) -> tuple[list[int], list[int]]:
        """Tokens of each text, and the length of its longest prefix of at most ``limit`` tokens."""
        n_tokens, fit = [], []
        for text, (chunks, row, total) in zip(texts, self.tables(texts), strict=True):
            n = int(total[-1]) if chunks else 0
            n_tokens.append(n)
            if n <= limit:
                fit.append(len(text))
                continue
            k = int(np.searchsorted(total, limit, side="right"))
            before, at = int(total[k - 1]) if k else 0, self.starts[row[k]]
            inner = self.prefix[at : at + len(chunks[k]) + 1]
            fit.append(max(0, sum(map(len, chunks[:k])) + int(np.flatnonzero(before + inner <= limit)[-1]) - 1))
        return n_tokens, fit


_BEFORE_WORD = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


def chunks_of(text: str) -> list[str]:
    """A run of spaces with the word behind it, again and again, after the space that the library puts first."""
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    if SPACE + SPACE in marked or marked[-1] == SPACE:
        return _BEFORE_WORD.split(marked)
    return [SPACE + w for w in marked[1:].split(SPACE)]


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    """The counter of a tokenizer file, one a Python worker. ``model``: a name among the public tokenizers, or a path."""
    if model not in _COUNTERS:
        import public_tokenizers

        _COUNTERS[model] = PrefixCounter(model if "/" in model else public_tokenizers.path(model))
    return _COUNTERS[model]


def bounded(batch, column: int, most: int = AT_ONCE, rows: int = 1000):
    """Slices of a batch with at most ``rows`` rows whose texts have at most ``most`` code points, or one text."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
    at, held = 0, 0
    for k, n in enumerate(size):
        if k > at and (held + n > most or k - at >= rows):
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < len(size):
        yield batch.slice(at)


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", limit: int = 4096
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_chars) for each row.

    ``fit_chars``: code points of the longest prefix of at most ``limit`` tokens.
    One narrow pass: no shuffle, only the two columns are read.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        c = counter(model)
        for batch in batches:
            for part in bounded(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n_tokens, fit = c.counts(texts, limit)
                n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens]), pa.array(fit, pa.int64())],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
