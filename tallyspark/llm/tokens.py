"""Whole-text encoding with the tokenizers library, one call per distinct piece of text.

A text is cut only where the tokenizer's own pre-tokenizer always cuts: at single spaces and line
breaks between other characters, and between a run of letters and the comma or stop that ends it.
The library encodes each distinct piece once; ids of a text are put together from those. A text with
any other arrangement of white space, or with a special token's string, is encoded whole, so the ids always
equal those that the tokenizer as loaded gives for the whole text.
"""

from __future__ import annotations

import json
import os
import sys
from itertools import chain, repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A line break by itself; no piece of a text begins with two spaces.
LINE = "  \n"
SPACE = "Ġ"  # a space in the byte alphabet of the vocabulary
#: Places of a piece that is not known yet, and of one that has to be encoded with its whole text.
NEW, HARD = -2, -1


def _latin(word: str) -> bool:
    """Whether a word of letters has Latin ones alone, that stay single letters in lower case: normalisation changes nothing else."""
    return word.isascii() or (max(word) < "\u0250" and word.lower().isalpha())


class Encoder:
    def __init__(self, path: str, limit: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # cores are shared out by Spark
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            file = json.load(f)
        spec, json_model = file["pre_tokenizer"] or {}, file["model"]
        kinds = [p["type"] for p in spec.get("pretokenizers", [spec]) if p]
        drops = kinds[:1] == ["Split"] and spec["pretokenizers"][0]["behavior"] == "Removed"
        decoder = self.tokenizer.get_added_tokens_decoder()
        added = decoder.values()
        # No piece holds the string of a special token, so one may stand between pieces.
        alone = [(t.content, i) for i, t in decoder.items() if t.content and not (t.single_word or t.lstrip or t.rstrip or t.normalized)]
        self.between = alone[0] if alone else None
        self.spaced = kinds == ["ByteLevel"] and spec.get("use_regex", True) and not spec.get("add_prefix_space")
        self.pieced = (self.spaced or drops) and not any(t.normalized for t in added)
        self.specials = [t.content for t in added]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.limit = limit
        # Words of Latin letters by themselves: they need no pattern to be cut, and of the normalisation only the case.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None if self.spaced else normalizers.Lowercase()
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=self.spaced, use_regex=False)]
        )
        # The ids that begin a word (with its space), or those that carry a word's end.
        mark = json_model.get("end_of_word_suffix") or ""
        self.marks = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.marks[i] = token.startswith(SPACE) if self.spaced else bool(mark) and token.endswith(mark)
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _store(self, keys: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.starts)
        self.slots.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + lengths.cumsum() - lengths])
        self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])

    def _gathered(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several stored pieces, one after another, and their lengths."""
        n = self.lengths[slots]
        ends = n.cumsum()
        at = np.arange(int(ends[-1]) if len(n) else 0)
        at += np.repeat(self.starts[slots] - (ends - n), n)
        return self.flat[at], n

    def _encode_words(self, keys: list[str]) -> None:
        """Store words of Latin letters. They are encoded as one text, whose ids show where each word is."""
        found = self.plain.encode_batch_fast([" ".join(keys)], add_special_tokens=False)[0].ids
        ids = np.array(found, np.uint32)
        at = np.flatnonzero(self.marks[ids])
        if len(at) != len(keys):
            self._encode_each(keys)
        else:
            self._store(keys, ids, np.diff(at, append=len(ids)) if self.spaced else np.diff(at, prepend=-1))

    def _encode_each(self, keys: list[str]) -> None:
        plain = [(k.lstrip(" ") if k[:1] == " " else " " + k) if self.spaced else k for k in keys]
        if self.between is not None:
            # As one text, in which a special token stands between pieces: the library cuts there before anything else.
            text, mark = self.between
            ids = np.array(self.tokenizer.encode_batch_fast([text.join(plain)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == mark)
            if len(at) == len(keys) - 1:
                self._store(keys, np.delete(ids, at), np.diff(at, prepend=-1, append=len(ids)) - 1)
                return
        found = [e.ids for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self._store(keys, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)

    def _cut(self, key: str) -> list[str] | None:
        """Smaller pieces of a piece; None where white space makes the cut unsure.

        In spaced mode a key stands for itself after one space, and a key that begins with a space
        for the rest without it (the start of a text or line).
        """
        bare, body = self.spaced and key[:1] == " ", key[1:] if self.spaced and key[:1] == " " else key
        if not body:
            return None if self.spaced else []
        if body[0].isspace() or body[-1].isspace():
            return None if self.spaced else [key]
        lines = body.split("\n")
        if len(lines) > 1 and self.spaced and any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            return None
        out = []
        for i, line in enumerate(lines):
            if i and self.spaced:
                out.append(LINE)
            if not line:
                continue
            start = " " if self.spaced and (bare or i) else ""
            if line[-1] in ",." and line[:-1].isalpha() and line.lower()[:-1].isalpha():  # also without new accents
                out += [start + line[:-1], (" " if self.spaced else "") + line[-1]]
            else:
                out.append(start + line)
        return out

    def _learn(self, keys: list[str]) -> None:
        """Store pieces that are not known yet."""
        simple, single, joined = [], [], []
        space = " " if self.spaced else ""
        for key in keys:
            if key.isalpha():
                (simple if _latin(key) else single).append(key)
            elif key[-1:] in (",", ".") and key[:-1].isalpha() and key.lower()[:-1].isalpha():
                joined.append((key, (key[:-1], space + key[-1])))
            else:
                cut = self._cut(key)
                if cut is None:
                    self.slots[key] = HARD
                elif cut == [key]:
                    single.append(key)
                else:
                    joined.append((key, cut))
        parts = {p for _, cut in joined for p in cut}.difference(simple, single)
        for p in parts:
            if p not in self.slots:
                (simple if p.isalpha() and _latin(p) else single).append(p)
        if simple:
            self._encode_words(simple)
        if single:
            self._encode_each(single)
        if joined:
            sizes = np.fromiter((len(cut) for _, cut in joined), np.int64, len(joined))
            slots = np.fromiter((self.slots[p] for _, cut in joined for p in cut), np.int64, int(sizes.sum()))
            flat, n = self._gathered(slots)
            total = np.concatenate([[0], n.cumsum()])
            ends = sizes.cumsum()
            self._store([key for key, _ in joined], flat, total[ends] - total[ends - sizes])

    def _slots_of(self, keys: list[str]) -> np.ndarray:
        """The places of distinct pieces, learnt where they are new."""
        slots = np.fromiter(map(self.slots.get, keys, repeat(NEW)), np.int64, len(keys))
        new = np.flatnonzero(slots == NEW)
        if len(new):
            fresh = [keys[i] for i in new.tolist()]
            self._learn(fresh)
            slots[new] = np.fromiter(map(self.slots.__getitem__, fresh), np.int64, len(fresh))
        return slots

    def encode(self, texts: list[str | None], end: int | None = None) -> list[np.ndarray]:
        """Ids of each text (null: empty), with `end` appended where it is given."""
        tail = np.array([] if end is None else [end], np.uint32)
        if not self.pieced:
            found = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.concatenate([np.array(e.ids, np.uint32), tail]) for e in found]
        if len(self.slots) > self.limit:
            self._reset()
        held = pa.array([t or "" for t in texts], pa.large_string())
        special = np.zeros(len(texts), bool)
        for content in self.specials:
            special |= pc.match_substring(held, content).to_numpy(zero_copy_only=False)
        # Empty texts and those with special tokens have no pieces.
        whole = special | (pc.binary_length(held).to_numpy(zero_copy_only=False) == 0)
        held = held.filter(pa.array(~whole))
        split = pc.split_pattern(held, " ")
        sizes = np.zeros(len(texts), np.int64)
        sizes[~whole] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        ends = sizes.cumsum()
        words = split.flatten().dictionary_encode()
        slots = self._slots_of(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy(zero_copy_only=False)]
        if self.spaced and len(held):  # the first piece of a text follows no space
            first = pc.list_element(split, 0).dictionary_encode()
            own = self._slots_of([" " + key for key in first.dictionary.to_numpy(zero_copy_only=False).tolist()])
            slots[(ends - sizes)[~whole]] = own[first.indices.to_numpy(zero_copy_only=False)]
        hard = slots < 0
        flat, n = self._gathered(np.where(hard, 0, slots)) if len(self.starts) else (np.empty(0, np.uint32), np.zeros(len(slots), np.int64))
        total, doubts = np.concatenate([[0], n.cumsum()]), np.concatenate([[0], hard.cumsum()])
        doubtful = special | (doubts[ends] > doubts[ends - sizes])
        out = []
        for text, begin, end_, odd in zip(texts, total[ends - sizes].tolist(), total[ends].tolist(), doubtful.tolist(), strict=True):
            if odd:
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            else:
                ids = flat[begin:end_]
            out.append(np.concatenate([ids, tail]))
        return out


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker. Spark reuses workers, so pieces learnt in one task serve the next.

    A worker holds one encoder, of at most `limit` pieces and those of one chunk. It lives in a module of the
    process, as the functions of a task, and their globals, are made anew for each task.
    """
    held = sys.modules.setdefault("tallyspark_worker", ModuleType("tallyspark_worker")).__dict__
    if held.get("path") != path:
        held["path"], held["encoder"] = path, Encoder(path)
    return held["encoder"]


def chunks(texts: list[str | None], most: int = 1 << 23):
    """Texts of a batch, about `most` characters at a time."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < most):
            size += len(texts[stop] or "")
            stop += 1
        yield texts[at:stop]
        at = stop
