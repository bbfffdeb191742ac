"""Ids of whole texts by a public tokenizer, through a table of the distinct pieces of the texts at hand.

Both tokenizers cut a text before a run of ASCII blanks that follows another character, and between an ASCII letter
or digit and a full stop or comma; what stands behind the cut doesn't depend on what stands before it. So a
piece between such cuts is encoded once, however often it occurs. A text with other blanks, where that isn't
so, is encoded whole, and so is one that holds a string which the tokenizer takes for a special id. Pieces are found
and hashed (64 bits) over a whole batch at once.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import chain

from tidemark.llm.words import mix


def piece_starts(data, limits):
    """Where pieces start in ``data``, texts end to end that begin at ``limits``."""
    import numpy as np

    kind = np.zeros(256, np.uint8)
    kind[[32, *range(9, 14)]] = 1
    kind[[44, 46]] = 2
    kind[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 3
    k = kind[data]
    new = np.zeros(len(data), bool)
    new[1:] = ((k[1:] == 1) & (k[:-1] != 1)) | ((k[1:] == 2) & (k[:-1] == 3))
    new[limits[limits < len(data)]] = True
    return new


def hashes_of(data, start):
    """64-bit hashes of the pieces of ``data`` that begin at ``start``."""
    import numpy as np

    size = np.diff(np.append(start, len(data)))
    byte = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    place = np.arange(len(data)) - np.repeat(start, size)
    return mix(np.add.reduceat(byte[data] * power[place], start) + size.astype(np.uint64))


class Encoder:
    """``Encoder(path)(texts)`` gives all ids (uint32) and each text's number of ids; null counts as empty.

    ``most``: the distinct pieces that are held at once; beyond it the half that was met last goes, which has the rarer ones. ``fold``: the tokenizer
    lower-cases and takes all blanks alike, so texts are folded before pieces are told apart (but not those with
    combining marks, which may compose with a small letter alone).
    """

    def __init__(self, path: str, most: int = 1_200_000, fold: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True  # pieces may look like special strings only once they are folded
        self.odd = re.compile(r"[^\S \t-\r]").search
        self.most = most
        self.folded = bytes.maketrans(b"\t\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"     abcdefghijklmnopqrstuvwxyz") if fold else None
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.ids, self.ends = array("I"), array("q", [0])
        self.fresh: list = []  # names of pieces not sorted in yet, in the order of their places
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2  # sorted names and their places: many, and the latest

    def find(self, names):
        """Places of pieces by name (sorted), -1 for those that aren't held."""
        import numpy as np

        out = np.full(len(names), -1)
        for known, place in self.levels:
            if len(known):
                k = np.minimum(np.searchsorted(known, names), len(known) - 1)
                out = np.where(known[k] == names, place[k], out)
        return out

    def sort_in(self) -> None:
        """Fresh pieces join the latest ones; when these are many, they join the others."""
        import numpy as np

        def merged(*levels):
            names, places = (np.concatenate(x) for x in zip(*levels, strict=True))
            order = np.argsort(names, kind="stable")
            return names[order], places[order]

        many, late = self.levels
        late = merged(late, (np.array(self.fresh, np.uint64), len(self.ends) - 1 - len(self.fresh) + np.arange(len(self.fresh))))
        self.levels = [many, late] if len(late[0]) < 1 << 16 else [merged(many, late), (late[0][:0], late[1][:0])]
        self.fresh = []

    def forget(self) -> None:
        """The later half of the pieces goes."""
        left = min(self.most // 2, len(self.ends) - 1)
        self.levels = [(names[places < left], places[places < left]) for names, places in self.levels]
        del self.ids[self.ends[left] :]
        del self.ends[left + 1 :]

    def learn(self, names: list[int], new: list[str]) -> None:
        """Pieces of one blank and letters are words to both tokenizers. They are encoded end to end in one text, and
        its ids dealt out by word, which is much faster than a call for each."""
        import numpy as np

        joined, alone = [], []
        for x in zip(names, new, strict=True):
            (joined if x[1][0] == " " and x[1][1:].isalpha() else alone).append(x)
        for k in range(0, len(joined), 2_000):
            part = joined[k : k + 2_000]
            e = self.tokenizer.encode("".join([p for _, p in part]), add_special_tokens=False)
            sizes = np.bincount(np.array(e.word_ids))
            if len(sizes) == len(part):
                self.keep(part, e.ids, sizes)
            else:
                alone += part
        for k in range(0, len(alone), 2_000):
            part = alone[k : k + 2_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([p for _, p in part], add_special_tokens=False)]
            self.keep(part, list(chain.from_iterable(ids)), np.array([len(x) for x in ids]))

    def keep(self, part: list, ids: list[int], sizes) -> None:
        self.fresh += [n for n, _ in part]
        self.ends.frombytes((sizes.cumsum() + len(self.ids)).astype("i8").tobytes())
        self.ids.extend(ids)

    def __call__(self, texts: list):
        import numpy as np

        odd = [k for k, t in enumerate(texts) if t and any(s in t for s in self.special)]
        if not odd:
            return self.by_pieces(texts)
        alone = set(odd)
        flat, sizes = self.by_pieces([None if k in alone else t for k, t in enumerate(texts)])
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        self.tokenizer.encode_special_tokens = False
        for k in odd:
            parts[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32)
        self.tokenizer.encode_special_tokens = True
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def by_pieces(self, texts: list):
        import numpy as np

        raw = [(t or "").encode() for t in texts]
        if self.folded:
            raw = [t if b"\xcc" in t or b"\xcd" in t else t.translate(self.folded) for t in raw]
        limits = np.concatenate([[0], np.cumsum([len(t) for t in raw], dtype=np.int64)])
        if not limits[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        whole = b"".join(raw)
        data = np.frombuffer(whole, np.uint8)
        new = piece_starts(data, limits[:-1])
        for k, t in enumerate(texts):
            if t and self.odd(t):
                new[limits[k] + 1 : limits[k + 1]] = False
        start = np.flatnonzero(new)
        distinct, first, which = np.unique(hashes_of(data, start), return_index=True, return_inverse=True)
        at = self.find(distinct)
        if len(self.ends) + np.count_nonzero(at < 0) > self.most:
            self.forget()
            at = self.find(distinct)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            end = np.append(start[1:], len(data))
            lo, hi = start[first[fresh]].tolist(), end[first[fresh]].tolist()
            self.learn(distinct[fresh].tolist(), [whole[i:e].decode() for i, e in zip(lo, hi, strict=True)])
            self.sort_in()
            at = self.find(distinct)
        which = at[which]
        ids, ends = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ends, np.int64)  # not copied: the table may be long
        sizes = ends[which + 1] - ends[which]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.arange(upto[-1]) + np.repeat(ends[which] - upto[:-1], sizes)]
        docs = np.searchsorted(start, limits)
        return flat, np.diff(upto[docs])


@lru_cache(maxsize=1)
def encoder(path: str, fold: bool = False) -> Encoder:
    """The worker's encoder, kept from task to task: its table then holds the frequent pieces. A task has one core, so the
    tokenizer starts no threads (each with memory of its own), unless the worker's environment says so."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, fold=fold)


def with_end(ids, sizes, end: int = 0):
    """The same with an end id behind each text's ids."""
    import numpy as np

    at = np.cumsum(sizes)
    return np.insert(ids, at, end), sizes + 1
