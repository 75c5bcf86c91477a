"""Token counts by trie-shared dynamic programming.

A unigram model over a given vocabulary splits each pre-token (a word with the mark of
the space before it) into the pieces of the highest total score (ties: fewer tokens);
characters that no piece covers fall back to one token per UTF-8 byte.  The distinct
pre-tokens of a block of rows are inserted in a trie, level by level: a level's nodes are
the distinct pairs of parent and character, forward scores of all of them are computed at
once, one time for each shared prefix, and the count at a terminal node is stored for all
of the pre-token's occurrences, in this block and later ones.  No shuffle: every block of
rows stands for itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifterra.llm.columns import trimmed

MARK = "▁"
#: Characters of pre-tokens whose counts a worker keeps (twice, in two generations), and
#: characters of text that are split at once.
MAX_KEPT, SLICE = 4_000_000, 1 << 22
#: Levels with fewer nodes than this go on node by node.
FEW = 24
_GAP = re.compile(r"\s")


class UnigramTrie:
    """Token counts of pre-tokens by forward scores on a trie.

    The vocabulary is a trie of its own: ``goto`` has its edges, ``gain`` the score of the
    piece that a state spells (-inf: none).  A node of the pre-tokens' trie carries, for
    each length, the state that its last characters spell (-1: no piece starts so) and the
    best score and tokens so many characters before.
    """

    def __init__(self, scores: dict[str, float], max_kept: int = MAX_KEPT) -> None:
        goto: dict[int, int] = {}
        gain = [-math.inf]
        for piece, score in scores.items():
            state = 0
            for c in piece:
                key = state << 21 | ord(c)
                if key not in goto:
                    goto[key] = len(gain)
                    gain.append(-math.inf)
                state = goto[key]
            if piece:
                gain[state] = score
        self.goto, self.gain = goto, np.array(gain)
        self.keys = np.array(sorted(goto), np.int64)
        self.to = np.array([goto[k] for k in self.keys.tolist()], np.int64)
        self.longest = max(map(len, scores), default=1) or 1
        self.floor = min(scores.values(), default=0.0) - 10.0
        self.max_kept = max_kept
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.kept = 0
        self.nodes = 0  # that were computed so far

    def _start(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, tokens and states of ``n`` roots."""
        score, tokens = np.full((n, self.longest), -np.inf), np.zeros((n, self.longest), np.int64)
        score[:, 0] = 0.0
        return score, tokens, np.full((n, self.longest), -1, np.int64)

    def _level(self, score: np.ndarray, tokens: np.ndarray, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same after one more character of each node."""
        self.nodes += len(char)
        before = np.concatenate([np.zeros((len(char), 1), np.int64), state[:, :-1]], 1)
        state = np.full_like(before, -1)
        row, col = np.nonzero(before >= 0)
        if len(self.keys):
            key = before[row, col] << 21 | char[row]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            row, col = row[hit], col[hit]
            state[row, col] = self.to[at[hit]]
        made = np.full(score.shape, -np.inf)
        made[row, col] = score[row, col] + self.gain[state[row, col]]
        width = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
        best, fewest = score[:, 0] + self.floor * width, tokens[:, 0] + width
        top = made.max(1)
        least = np.where(made == top[:, None], tokens + 1, np.iinfo(np.int64).max).min(1)
        better = (top > best) | ((top == best) & (least < fewest))
        best, fewest = np.where(better, top, best), np.where(better, least, fewest)
        return np.concatenate([best[:, None], score[:, :-1]], 1), np.concatenate([fewest[:, None], tokens[:, :-1]], 1), state

    def _alone(self, score: np.ndarray, tokens: np.ndarray, state: np.ndarray, rest: str) -> int:
        """Tokens of one node's continuation by ``rest``, character by character."""
        path, used = score[::-1].tolist(), tokens[::-1].tolist()
        live = [(int(s), k + 1) for k, s in enumerate(state) if s >= 0]
        goto, gain, longest, floor = self.goto, self.gain, self.longest, self.floor
        self.nodes += len(rest)
        for c in rest:
            code, width = ord(c), 1 if c < "\x80" else len(c.encode())
            best, fewest = path[-1] + floor * width, used[-1] + width
            after = []
            for s, length in [(0, 0), *live]:
                nxt = goto.get(s << 21 | code)
                if nxt is not None:
                    length += 1
                    after.append((nxt, length))
                    total = path[-length] + float(gain[nxt])
                    if total > best or (total == best and used[-length] + 1 < fewest):
                        best, fewest = total, used[-length] + 1
            live = after
            path.append(best)
            used.append(fewest)
            if len(path) > 8192:  # only the last ones are looked at again
                del path[:-longest], used[:-longest]
        return used[-1]

    def count_all(self, words: list[str]) -> list[int]:
        """Tokens of the pre-tokens of distinct words (without their marks)."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        words = [words[i] for i in order]
        sizes = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        first = np.cumsum(sizes) - sizes
        score, tokens, state = self._level(*self._start(1), np.array([ord(MARK)]))
        node, out = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        depth, open_ = 0, len(words)
        while True:
            still = int(np.searchsorted(-sizes, -depth, "left"))  # words longer than the depth
            out[still:open_] = tokens[node[still:open_], 0]
            open_ = still
            if not open_:
                break
            if open_ < FEW:
                for i in range(open_):
                    out[i] = self._alone(score[node[i]], tokens[node[i]], state[node[i]], words[i][depth:])
                break
            key, node = np.unique(node[:open_] << 21 | code[first[:open_] + depth], return_inverse=True)
            parent = key >> 21
            score, tokens, state = self._level(score[parent], tokens[parent], state[parent], key & 0x1FFFFF)
            depth += 1
        got = [0] * len(words)
        for i, n in zip(order, out.tolist(), strict=True):
            got[i] = n
        return got

    def _learn(self, words: Iterable[str]) -> None:
        """Have the counts of all ``words``."""
        if self.kept > self.max_kept:
            self.counts, self.older, self.kept = {}, self.counts, 0
        new = {w for w in words if w not in self.counts}
        known = {w: n for w in new if (n := self.older.get(w)) is not None}
        fresh = [w for w in new if w not in known]
        self.counts |= known
        self.counts.update(zip(fresh, self.count_all(fresh), strict=True))
        self.kept += sum(map(len, new))

    def count_texts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text; white space only separates."""
        split: list[tuple[int, list[str]]] = []
        size, out = 0, [(0, 0)] * len(texts)

        def flush() -> None:
            nonlocal split, size
            self._learn(w for _, words in split for w in words)
            for i, words in split:
                n, k = out[i]
                out[i] = n + sum(map(self.counts.__getitem__, words)), k + len(words)
            split, size = [], 0

        for i, text in enumerate(texts):
            lo = 0
            while text and lo < len(text):
                cut = _GAP.search(text, lo + SLICE) if len(text) - lo > SLICE else None
                hi = cut.start() if cut else len(text)
                split.append((i, (text if hi - lo == len(text) else text[lo:hi]).split()))
                size += hi - lo
                lo = hi + 1
                if size >= SLICE:
                    flush()
        flush()
        return out


def zipf_scores(pieces: Iterable[str]) -> dict[str, float]:
    """Log-probabilities of ranked pieces under Zipf's law (exponent 1, shift 2.7)."""
    pieces = list(pieces)
    total = sum(1 / (r + 2.7) for r in range(1, len(pieces) + 1))
    return {p: -math.log((r + 2.7) * total) for r, p in enumerate(pieces, 1)}


@lru_cache(maxsize=2)
def vocabulary(model_path: str) -> tuple[str, ...]:
    """Ordinary pieces of a sentencepiece model in order of rank: single characters, whose
    ids come last, after the merged pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return tuple(model.id_to_piece(i) for i in ids)


@lru_cache(maxsize=2)
def _trie(model_path: str) -> UnigramTrie:
    return UnigramTrie(zipf_scores(vocabulary(model_path)))


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) for each row of ``docs``, whole texts.

    Only doc_id and text are read.  A null or empty text has 0 of both; a null doc_id
    stays; repeated rows give repeated results; an empty table an empty one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(model_path)
        for batch in batches:
            got = trie.count_texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], ["doc_id", "n_tokens", "n_pretokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(count), "doc_id long, n_tokens long, n_pretokens long")
