"""Token ids of whole texts with a tokenizer file of the tokenizers library."""

from __future__ import annotations

import os
import re
import sys
import types
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's table of known pieces; beyond it those that were met in one step only are forgotten.
KNOWN = 700_000
#: Unknown pieces that are encoded as one text.
JOINT = 200
#: Characters that are encoded at a time.
STEP = 4 << 20

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"[^\S \n]")


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, which serves many tasks."""
    return sys.modules.setdefault("_marketpulse_worker", types.ModuleType("_marketpulse_worker")).__dict__


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does, word by word.

    A byte-level tokenizer of this kind never joins a single space to the word before it, and a
    single line feed between words stands alone. So a text's ids are those of its pieces, cut before
    such spaces and line feeds; pieces already met are looked up. Texts with other white space or runs of it
    are cut only at single spaces between other characters. Unknown pieces are encoded
    together and told apart by the tokens that begin with the space or line feed.
    """

    def __init__(self, path: str, limit: int | None = None):
        self.limit = limit
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.top = max(vocab.values(), default=size)
        self.spaced = np.zeros(self.top + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.feed = np.zeros(self.top + 1, bool)
        self.feed[[i for t, i in vocab.items() if t == "Ċ"]] = True
        # Place of each known piece; its ids are ids[starts[place]:][:sizes[place]].
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes, self.met = (np.zeros(0, t) for t in ("<u4", np.int64, np.int64, np.int32))
        self.ends = dict(zip(",.", self._one_by_one([",", "."])))

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _ids_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the known pieces at ``places`` one after another, and where each begins (one more: the end)."""
        sizes = self.sizes[places]
        bounds = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        return self.ids[np.repeat(self.starts[places] - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds

    def _add(self, found: dict[str, bytes]) -> None:
        self.known.update(zip(found, range(len(self.known), len(self.known) + len(found))))
        sizes = np.fromiter(map(len, found.values()), np.int64, len(found)) // 4
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.met = np.concatenate([self.met, np.zeros(len(found), np.int32)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found.values()), "<u4")])

    def _forget(self) -> None:
        """Keep the known pieces met in several steps since the last time, or none if these are too many."""
        stay = self.met > 1
        if stay.sum() > (self.limit or KNOWN) // 2:
            stay[:] = False
        self.known = dict(zip((w for w, s in zip(self.known, stay.tolist()) if s), range(int(stay.sum()))))
        self.ids, bounds = self._ids_at(np.flatnonzero(stay))
        self.starts, self.sizes, self.met = bounds[:-1], np.diff(bounds), np.zeros(len(bounds) - 1, np.int32)

    def _together(self, pieces: list[str], mark: str, first: np.ndarray, found: dict[str, bytes]) -> list[str]:
        """Encode ``pieces`` into ``found``, many to a text; returns those that could not be told apart."""
        runs = [pieces[i : i + JOINT] for i in range(0, len(pieces), JOINT)]
        left: list[str] = []
        for run, ids in zip(runs, self._one_by_one([mark + mark.join(r) for r in runs])):
            at = (4 * np.flatnonzero(first[np.frombuffer(ids, "<u4")])).tolist()
            if len(at) == len(run):
                found.update(zip(run, [ids[a:b] for a, b in zip(at, [*at[1:], len(ids)])]))
            else:
                left += run
        return left

    def _learn(self, new: list[str], careful: set[str]) -> None:
        """Learn unknown pieces; those in ``careful`` come from texts that were not cut at each blank."""
        found: dict[str, bytes] = {}
        feeds, whole, ends, other = [], [], [], []
        for p in new:
            if p in careful and (not p or " " in p or "\n" in p or p[0].isspace() or p[-1].isspace() or "<|" in p):
                other.append(p)
            elif p[0] == "\n":
                feeds.append(p)
            elif p[-1] in self.ends and p[-2:-1].isalpha():
                ends.append(p)  # a sign after a letter is a token of its own
            else:
                whole.append(p)
        whole = list(dict.fromkeys(whole + [p[:-1] for p in ends if p[:-1] not in self.known]))
        other += self._together(whole, " ", self.spaced, found)
        other += self._together(feeds, "", self.feed, found)
        if other:
            found.update(zip(other, self._one_by_one([p if p[:1] == "\n" else " " + p for p in other])))
        for p in ends:
            at = self.known.get(p[:-1])
            stem = found[p[:-1]] if at is None else self.ids[self.starts[at] : self.starts[at] + self.sizes[at]].tobytes()
            found[p] = stem + self.ends[p[-1]]
        self._add(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        odd = [("  " in t or " \n" in t or "\n " in t or "\n\n" in t or "<|" in t
                or t[:1].isspace() or t[-1:].isspace() or _ODD.search(t) is not None) for t in texts]
        # A piece from the careful cut begins with a line feed only if it is the first.
        cut = [_CUT.split(t) for t, o in zip(texts, odd) if o]
        plain = pa.array([t for t, o in zip(texts, odd) if not o], pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        lists = pa.concat_arrays([lists, pa.array(cut, lists.type)])
        bounds = lists.offsets.to_numpy()
        flat = lists.flatten().dictionary_encode()
        heads = flat.dictionary.take(flat.indices.take(pa.array(bounds[:-1]))).to_pylist()
        inner = np.ones(len(flat), bool)
        inner[bounds[:-1]] = False
        pieces = flat.indices.to_numpy()[inner]
        used = np.zeros(len(flat.dictionary), bool)
        used[pieces] = True
        words = flat.dictionary.filter(pa.array(used)).to_pylist()
        places = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        gaps = np.flatnonzero(places < 0).tolist()
        if gaps:
            new = [words[i] for i in gaps]
            self._learn(new, {p for c in cut for p in c})
            places[gaps] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        self.met[places] += 1
        place_of = np.zeros(len(used), np.int64)
        place_of[used] = places
        ids, starts = self._ids_at(place_of[pieces])
        ids, cuts = ids.tobytes(), (4 * starts[bounds - np.arange(len(bounds))]).tolist()
        if len(self.known) > (self.limit or KNOWN):
            self._forget()
        found = [h + ids[a:b] for h, a, b in zip(self._one_by_one(heads), cuts, cuts[1:])]
        plain_ones, odd_ones = iter(found), iter(found[len(plain):])
        return [next(odd_ones if o else plain_ones) for o in odd]

    def steps(self, texts: list[str]):
        """(first place, encoded texts) for runs of texts of about STEP characters."""
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= STEP):
                size += len(texts[end])
                end += 1
            yield start, self.encode(texts[start:end])
            start = end


def encoder(path: str, limit: int | None = None) -> Encoder:
    """The worker's encoder of a tokenizer file that remembers ``limit`` pieces (default: KNOWN)."""
    cache = worker_cache()
    if ("encoder", path, limit) not in cache:
        cache["encoder", path, limit] = Encoder(path, limit)
    return cache["encoder", path, limit]
