"""Token counts by greedy longest match, in one pass over the letters of a word.

A trie of the vocabulary has failure links: where no letter continues the current match, a node knows how
many pieces the greedy rule takes off the match so far and where the rest of it lies in the trie. A word's
count is the sum of those numbers; pieces are never built and no letter is looked at twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo

MARK = "▁"


class Automaton:
    """Counts for `MARK + word`; pieces that begin with MARK begin a word, others go on within one."""

    def __init__(self, pieces: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        depth_first: list[tuple[int, str]] = [(0, "")]  # parent and letter of each node
        token = [False]
        for piece in pieces:
            at = 0
            for letter in piece:
                if letter not in self.next[at]:
                    self.next[at][letter] = len(self.next)
                    self.next.append({})
                    depth_first.append((at, letter))
                    token.append(False)
                at = self.next[at][letter]
            token[at] = bool(piece)
        # Popped pieces and the node of the rest; -1 where the match cannot be cut into pieces.
        self.popped, self.fail = [0] * len(self.next), [-1] * len(self.next)
        row = list(self.next[0].values())
        while row:
            for v in row:
                u, letter = depth_first[v]
                if token[v]:
                    self.popped[v], self.fail[v] = 1, 0
                    continue
                z, taken = self.fail[u], self.popped[u]
                while z >= 0 and letter not in self.next[z]:
                    taken += self.popped[z]
                    z = self.fail[z]
                if z >= 0 and u:
                    self.popped[v], self.fail[v] = taken, self.next[z][letter]
            row = [w for v in row for w in self.next[v].values()]

    def count(self, word: str) -> int:
        """Number of pieces; 0 where no pieces make up the word."""
        at, out = 0, 0
        for letter in MARK + word:
            while letter not in self.next[at]:
                if not at or self.fail[at] < 0:
                    return 0
                out += self.popped[at]
                at = self.fail[at]
            at = self.next[at][letter]
        while at:
            if self.fail[at] < 0:
                return 0
            out += self.popped[at]
            at = self.fail[at]
        return out


def vocabulary(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model: no control, unknown, unused or byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not any(f(i) for f in odd)]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_words, n_tokens, n_unknown.

    Words are runs of characters other than ASCII white space. A word that the vocabulary cannot spell is
    one unknown token. Null and empty texts count nothing; repeated rows are counted alike. Texts stay
    where they are: nothing is shuffled.
    """

    def count(batches):
        automaton = Automaton(vocabulary(path))
        memo = Memo(automaton.count)
        for batch in batches:
            rows = np.zeros((batch.num_rows, 3), np.int64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = (text or b"").split()
                if found:
                    n = np.fromiter(map(memo.__getitem__, map(bytes.decode, found)), np.int64, len(found))
                    unknown = int((n == 0).sum())
                    rows[i] = len(found), int(n.sum()) + unknown, unknown
            columns = [batch.column("doc_id"), *(pa.array(c.copy()) for c in rows.T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens", "n_unknown"])

    narrow = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text")
    return narrow.mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_unknown long")
