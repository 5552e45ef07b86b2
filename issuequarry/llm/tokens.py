"""Token ids of whole texts, by units.

The tokenizer drops white space, lowers the case and never merges across white space or from a letter into a following
punctuation mark. A text is therefore cut there into units, and its ids are those of its units in order. Each distinct
unit is encoded once per Python worker: invented or rare words cost one encoding, frequent ones a look-up by a 64-bit
hash. The store of known units is emptied when it is full, which changes no result. Texts with very long units, or
with the opening of a special token, are encoded as they are.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from issuequarry.llm.common import hash_spans, lower_ascii, text_bytes

#: End of document.
END_ID = 1
#: Known units a worker keeps; texts with longer units than ``LONGEST`` bytes are encoded whole.
KNOWN = 1_000_000
LONGEST = 64
_JOINED = 256

_BLANK, _LETTER, _MARK = (np.zeros(256, dtype=bool) for _ in range(3))
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER[97:123] = True
_MARK[[33, 44, 46, 58, 59, 63]] = True


def default_path() -> str:
    """The public vocabulary file; another path may be given wherever one is asked for."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class UnitTokens:
    """Ids of units, kept as places in one flat array."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)  # sorted
        self.place = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.start = np.zeros(1, dtype=np.int64)

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units one after the other, and how many each has.

        Units of letters are encoded many in one string; each gives one word, whose last id is a word end.
        """
        ids: list[list[int] | None] = [None] * len(units)
        letters = [k for k, u in enumerate(units) if u.isalpha()]
        for at in range(0, len(letters), _JOINED):
            part = letters[at : at + _JOINED]
            found = self.tokenizer.encode(" ".join([units[k] for k in part]), add_special_tokens=False).ids
            last = np.flatnonzero(self.ends[found])
            if len(last) == len(part):
                begin = 0
                for k, end in zip(part, (last + 1).tolist()):
                    ids[k] = found[begin:end]
                    begin = end
        rest = [k for k, x in enumerate(ids) if x is None]  # also letters that turn into more than letters
        if rest:
            for k, e in zip(rest, self.tokenizer.encode_batch([units[k] for k in rest], add_special_tokens=False)):
                ids[k] = e.ids
        return np.array([i for x in ids for i in x], dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64)

    def _places(self, hashes: np.ndarray, units) -> np.ndarray:
        """Places of hashes; ``units(which)`` gives the strings of those asked for."""
        def look() -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
            return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), dtype=bool)

        at, known = look()
        if not known.all():
            if len(self.hashes) + len(hashes) > KNOWN:
                self.clear()
                known[:] = False
            new = np.flatnonzero(~known)
            ids, sizes = self._encoded(units(new))
            used = self.start[-1]
            if used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(max(len(ids), len(self.flat)), dtype=np.uint32)))
            self.flat[used : used + len(ids)] = ids
            place = np.concatenate((self.place, np.arange(len(new)) + len(self.start) - 1))
            self.start = np.concatenate((self.start, used + np.cumsum(sizes)))
            merged = np.concatenate((self.hashes, hashes[new]))
            order = np.argsort(merged)
            self.hashes, self.place = merged[order], place[order]
            at, _ = look()
        return self.place[at]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with END_ID after each, and where each text's ids start (and the last end)."""
        raw, begin = text_bytes(column)
        n_texts = len(begin) - 1
        if not n_texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        data = lower_ascii(raw)
        blank = _BLANK[data]
        opens = _MARK[data]
        opens[1:] &= _LETTER[data[:-1]]
        opens[1:] |= blank[:-1]
        opens[0] = True
        opens &= ~blank
        closes = ~blank
        closes[:-1] &= blank[1:] | opens[1:]
        first, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        owner = np.searchsorted(begin, first, side="right") - 1
        opening = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
        alone = np.union1d(owner[end - first > LONGEST], np.searchsorted(begin, opening, side="right") - 1)
        if len(alone):
            usual = ~np.isin(owner, alone)
            first, end, owner = first[usual], end[usual], owner[usual]
        hashes = hash_spans(data, first, end)
        # Sorting the upper bits of the hash with the place packed below them is far cheaper than an argsort. Runs of
        # equal hashes may come apart when upper bits agree; then a unit is merely looked up twice.
        low = np.uint64(len(hashes).bit_length())
        packed = np.sort((hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64))
        order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        ranked = hashes[order]
        fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(ranked)]
        sample = order[fresh]
        text = data.tobytes()
        place = self._places(ranked[fresh], lambda which: [text[a:b].decode() for a, b in zip(first[sample[which]].tolist(), end[sample[which]].tolist())])
        at = np.empty(len(order), dtype=np.int64)
        at[order] = place[np.cumsum(fresh) - 1]
        sizes = self.start[at + 1] - self.start[at]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        bound = np.searchsorted(owner, np.arange(n_texts + 1))
        per_text = upto[bound[1:]] - upto[bound[:-1]]
        whole = {int(i): self.tokenizer.encode(raw[begin[i] : begin[i + 1] - 1].tobytes().decode(), add_special_tokens=False).ids for i in alone}
        for i, ids in whole.items():
            per_text[i] = len(ids)
        starts = np.concatenate(([0], np.cumsum(per_text + 1)))
        out = np.full(starts[-1], END_ID, dtype=np.uint32)
        body = np.ones(len(out), dtype=bool)
        body[starts[1:] - 1] = False
        for i, ids in whole.items():
            out[starts[i] : starts[i + 1] - 1] = ids
            body[starts[i] : starts[i + 1]] = False
        source = np.repeat(self.start[at] - upto[:-1], sizes)
        source += np.arange(upto[-1])
        out[body] = self.flat[source]
        return out, starts


_loaded: dict[str, UnitTokens] = {}


def encode_column(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """By the tokenizer of this Python worker, with the units it knows from earlier tasks."""
    if path not in _loaded:
        _loaded[path] = UnitTokens(path)
    return _loaded[path].encode(column)
