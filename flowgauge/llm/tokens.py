"""Token ids of whole texts by a public tokenizer, encoding each distinct word of a batch once.

The tokenizers of this module cut a text into pieces by a pattern and encode each piece on its own, so the ids of a text
are those of its pieces in order.  Pieces are found on arrays of code points, hashed, and only pieces not seen before go
to the library.  That holds for code points whose class is beyond doubt (Latin letters, ASCII, no rare blanks); texts
with any other code point, or with the string of an added token, go to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

from .common import process_cache, slices, stretch_hashes

_SAFE_END = 0x180
_SAFE = re.compile("[\\x00-\\x1b\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u017f]*")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: How byte-level tokenizers write a space in the names of their ids.
SPACE_SIGN = "\u0120"
#: New pieces that go to the library as one text.
JOINED = 500
#: New pieces that go to the library at once, which takes up to a kilobyte for each.
NEW_PIECES = 2000


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_SAFE_END)], dtype=np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    return out


_CLASS = _classes()


def _contractions(points: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> None:
    """'s 't 'm 'd 're 've 'll are pieces of their own where a piece would begin at the apostrophe."""
    at = np.flatnonzero((points[:-1] == 39) & begins[:-1])
    if not len(at):
        return
    one, two = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
    is_one = np.isin(one, [ord(c) for c in "stmd"])
    is_two = np.zeros(len(at), dtype=bool)
    for a, b in ("re", "ve", "ll"):
        is_two |= (one == ord(a)) & (two == ord(b))
    for which, size in ((is_one, 1), (is_two, 2)):
        place = at[which]
        begins[place + 1] = False
        after = place + 1 + size
        after = after[after < len(points)]
        begins[after[kinds[after] == _LETTER]] = True


def _word_pieces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter runs, single numbers, runs of other signs; blanks separate and go."""
    kinds = _CLASS[points]
    begins = np.ones(len(points), dtype=bool)
    begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _NUMBER)
    _contractions(points, kinds, begins)
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(points))
    keep = kinds[starts] != _SPACE
    return starts[keep], ends[keep]


def _byte_pieces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, numbers or other signs with one space before them; other blanks by themselves.

    The last code point of ``points`` is a closing blank that belongs to no text.
    """
    kinds = _CLASS[points]
    begins = np.ones(len(points), dtype=bool)
    begins[1:] = kinds[1:] != kinds[:-1]
    blank = kinds == _SPACE
    last = np.zeros(len(points), dtype=bool)  # blanks just before something else
    last[:-1] = blank[:-1] & ~blank[1:]
    joins = last & (points == 32)
    after = np.flatnonzero(joins) + 1
    begins[after] = False
    begins[last] = True
    _contractions(points, kinds, begins)
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], len(points))


class Known:
    """Pieces seen before and their ids: sorted arrays, and a small dictionary of the latest ones.

    A piece takes some 30 bytes, so that a worker that lives on after its task keeps little.  Past ``most`` pieces those go
    that were not met again.
    """

    def __init__(self, most: int, latest: int = 30_000):
        self.most, self.most_latest = most, latest
        self.clear()

    def clear(self) -> None:
        self.keys, self.starts = np.empty(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
        self.flat, self.used = np.empty(0, dtype=np.uint32), np.empty(0, dtype=bool)
        self.latest: dict[int, bytes] = {}

    def settle(self) -> None:
        """Move the latest pieces into the arrays."""
        keys = np.fromiter(self.latest, dtype=np.uint64, count=len(self.latest))
        sizes = np.fromiter(map(len, self.latest.values()), dtype=np.int64, count=len(keys)) // 4
        keys = np.concatenate([self.keys, keys])
        sizes = np.concatenate([np.diff(self.starts), sizes])
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(self.latest.values()), dtype=np.uint32)])
        used = np.concatenate([self.used, np.zeros(len(self.latest), dtype=bool)])
        self._take(keys, sizes, flat, used, np.argsort(keys))
        self.latest = {}

    def forget(self) -> None:
        """Keep the settled pieces that were met since the last time; rare ones go, frequent ones stay."""
        self._take(self.keys, np.diff(self.starts), self.flat, np.zeros(len(self.keys), dtype=bool), np.flatnonzero(self.used))

    def _take(self, keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray, used: np.ndarray, order: np.ndarray) -> None:
        begin = np.cumsum(sizes) - sizes
        self.keys, self.used, sizes = keys[order], used[order], sizes[order]
        self.flat, self.starts = flat[spread(begin[order], sizes)], np.concatenate([[0], np.cumsum(sizes)])

    def ids_of(self, keys: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, begin, size): where the ids of each key are; ``encode`` gives those of the places not known."""
        if len(self.keys) + len(self.latest) + len(keys) > self.most:
            self.forget()
            if 2 * (len(self.keys) + len(self.latest) + len(keys)) > self.most:
                self.clear()
        elif len(self.latest) > self.most_latest:
            self.settle()
        at = np.searchsorted(self.keys, keys)
        found = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            found = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        other = np.flatnonzero(~found)
        names, latest = keys[other].tolist(), self.latest
        new = [k for k, name in enumerate(names) if name not in latest]
        for k, ids in zip(new, encode(other[new]), strict=True):
            latest[names[k]] = ids
        parts = [latest[name] for name in names]
        known, size = at[found], np.empty(len(keys), dtype=np.int64)
        self.used[known] = True
        size[found] = self.starts[known + 1] - self.starts[known]
        size[other] = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        mine, begin = self.flat[spread(self.starts[known], size[found])], np.empty(len(keys), dtype=np.int64)
        begin[found] = np.cumsum(size[found]) - size[found]
        begin[other] = len(mine) + np.cumsum(size[other]) - size[other]
        return np.concatenate([mine, np.frombuffer(b"".join(parts), dtype=np.uint32)]), begin, size


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each stretch of ``size``, one stretch after the other."""
    stop = np.cumsum(size)
    return np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


def _leads(library) -> np.ndarray:
    """Which ids have a name that begins with the sign of a space."""
    names = library.get_vocab(with_added_tokens=True)
    leads = np.zeros(max(names.values(), default=0) + 1, dtype=bool)
    leads[[i for name, i in names.items() if name.startswith(SPACE_SIGN)]] = True
    return leads


class Encoder:
    """Ids of texts, by batches.  ``cuts``: "word" or "byte", the kind of pieces the tokenizer cuts."""

    def __init__(self, path: str, cuts: str, remember: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.cuts = cuts
        if ("tokenizer", path, cuts) not in process_cache():
            library = Tokenizer.from_file(path)
            added = [re.escape(t.content) for t in library.get_added_tokens_decoder().values() if t.content]
            pattern = re.compile("|".join(added) if added else "(?!)", re.IGNORECASE)
            leads = _leads(library) if cuts == "byte" else None
            process_cache()["tokenizer", path, cuts] = library, Known(remember), pattern, leads
        self.library, self.seen, self.added, self.leads = process_cache()["tokenizer", path, cuts]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in found]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids for each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        safe = [i for i, t in enumerate(texts) if _SAFE.fullmatch(t) and not self.added.search(t)]
        odd = sorted(set(range(len(texts))) - set(safe))
        for some in slices([texts[i] for i in odd]):
            for ids in self.whole(some):
                out[odd.pop(0)] = ids
        places = iter(safe)
        for some in slices([texts[i] for i in safe]):
            for ids in self._slice(some):
                out[next(places)] = ids
        return out

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        if self.cuts == "word":
            texts = [t.lower() for t in texts]
        # texts are parted by a line break; the pieces that hold it are known by their place
        data = "\n".join(texts) + "\n"
        points = np.frombuffer(data.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        bounds = np.cumsum(lengths + 1)
        if self.cuts == "word":
            starts, ends = _word_pieces(points)
        else:
            starts, ends = self._byte_cut(points, bounds)
        hashes = stretch_hashes(points, starts, ends)
        distinct, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)

        def encode(places: np.ndarray) -> list[bytes]:
            at = place[places]
            pieces = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            led = self.cuts == "byte"
            out: list[bytes | None] = [None] * len(pieces)
            several = [k for k, x in enumerate(pieces) if led and len(x) > 1 and x[0] == " "]
            for k in range(0, len(several), JOINED):
                some = several[k : k + JOINED]
                for i, ids in zip(some, self._joined([pieces[i] for i in some]), strict=False):
                    out[i] = ids
            single = [k for k, ids in enumerate(out) if ids is None]
            for k in range(0, len(single), NEW_PIECES):
                some = single[k : k + NEW_PIECES]
                found = self.library.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)
                for i, x in zip(some, found, strict=True):
                    out[i] = np.array(x.ids, dtype=np.uint32).tobytes()
            return out

        flat, begin, sizes = self.seen.ids_of(distinct, encode)
        size = sizes[inverse]
        stop = np.cumsum(size)
        ids = flat[spread(begin[inverse], size)]
        cut = np.concatenate([[0], stop])[np.searchsorted(starts, bounds)]
        return np.split(ids, cut[:-1]) if len(texts) > 1 else [ids]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that begin with their only space, encoded as one text; none if they cannot be told apart.

        Each space opens a piece there too, and an id opens one exactly if its name begins with the space's sign.
        """
        text = "".join(pieces)
        if self.added.search(text):
            return []
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        begins = np.flatnonzero(self.leads[ids])
        if len(begins) != len(pieces) or begins[0] != 0:
            return []
        blob, ends = ids.tobytes(), [*(4 * begins[1:]).tolist(), 4 * len(ids)]
        return [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _byte_cut(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cut each text by itself: the closing line break neither joins nor lengthens a run of blanks."""
        starts, ends = [], []
        begin = 0
        for end in bounds.tolist():
            if end - begin > 1:
                a, b = _byte_pieces(points[begin : end - 1])
                starts.append(a + begin)
                ends.append(b + begin)
            begin = end
        none = np.empty(0, dtype=np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *ends])
