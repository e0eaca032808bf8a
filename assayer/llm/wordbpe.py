"""A word-level BPE vocabulary (pieces end in a marked symbol, white space is dropped), read from a tokenizers file.

A text's tokens are those of its pieces in turn, so what is known of a piece is kept under a 64-bit hash of its
bytes and texts are put together from it with numpy. Texts in ASCII and Latin-1 letters without special strings
take that path; all others are encoded by the tokenizers library itself. The tests hold both against the library.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from assayer.llm.text import _DOWN, _SEED, _UP, mix, utf8

#: Fixed value: how the vocabulary file cuts a text into pieces (the file's own pattern).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
GROUP = 1 << 20

# Classes of bytes: 0 white space, 1 letters, 2 digits, 3 all else.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEAD = 0xC3  # starts U+00C0 to U+00FF: letters but for the signs of multiplication and division
_SIGNS = (0x97, 0xB7)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Payloads:
    """Number arrays by 64-bit key, in flat numpy arrays. Beyond `limit` keys, those not used of late go."""

    def __init__(self, dtype: str, limit: int):
        self.limit, self.now = limit, 0
        self.keys = np.zeros(0, np.uint64)
        self.start, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.pool = np.zeros(0, dtype)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool))

    def add(self, keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.limit:
            self._forget()
        at = np.searchsorted(self.keys, keys)  # new keys come in ascending order
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, len(self.pool) + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, at, sizes)
        self.used = np.insert(self.used, at, self.now)
        self.pool = np.concatenate((self.pool, flat))

    def _forget(self) -> None:
        keep = self.used >= self.now  # what this group of texts uses stays
        late = np.flatnonzero(~keep)
        keep[late[np.argsort(-self.used[late], kind="stable")][: self.limit // 2]] = True
        flat = gather(self.pool, self.start[keep], self.size[keep])
        self.keys, self.size, self.used = self.keys[keep], self.size[keep], self.used[keep]
        self.start, self.pool = np.cumsum(self.size) - self.size, flat


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of `flat` one after another."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1])]


class WordBpe:
    def __init__(self, path: str, remember: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.path, self.end = path, spec["model"]["end_of_word_suffix"]
        vocab = spec["model"]["vocab"]
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.pieces = regex.compile(PIECES)
        self.symbols = byte_symbols()
        self.open = np.array([vocab[c] for c in self.symbols], dtype=np.int64)
        self.closed = np.array([vocab[c + self.end] for c in self.symbols], dtype=np.int64)
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        rows = np.array([((vocab[a] << 20) | vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(merges)], dtype=np.int64)
        rows = rows[np.argsort(rows[:, 0])]
        self.pair, self.rank, self.made = np.append(rows[:, 0], np.iinfo(np.int64).max), np.append(rows[:, 1], -1), np.append(rows[:, 2], -1)
        self._apart: dict[int, bool] = {}  # by both tokens
        self._state: tuple[str, list[int], list[int], list[int]] = ("", [-1], [0], [])  # of the last piece
        self.ids, self.deltas = Payloads("<u4", remember // 4), Payloads("int8", remember)  # ids are learnt faster

    # What only counts at prefixes need

    @cached_property
    def merge(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and result of each merge, by its two parts."""
        pairs = zip((self.pair[:-1] >> 20).tolist(), (self.pair[:-1] & 0xFFFFF).tolist(), strict=True)
        return dict(zip(pairs, zip(self.rank[:-1].tolist(), self.made[:-1].tolist(), strict=True), strict=True))

    @cached_property
    def made_by(self) -> dict[int, tuple[int, int, int]]:
        """Rank and parts of the first merge that makes a token."""
        found: dict[int, tuple[int, int, int]] = {}
        for (a, b), (k, t) in self.merge.items():
            found[t] = min(found.get(t, (k, a, b)), (k, a, b))
        return found

    @cached_property
    def _ids(self) -> tuple[dict[str, int], dict[str, int]]:
        with open(self.path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        return {t: k for t, k in vocab.items() if not t.endswith(self.end)}, {t.removesuffix(self.end): k for t, k in vocab.items() if t.endswith(self.end)}

    @cached_property
    def longest(self) -> int:
        return max(max(map(len, ids)) for ids in self._ids)

    # Cutting

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, start and end of each piece, and which rows must go to the library."""
        size = len(data)
        low = _LOWER[data]
        after = np.append(data[1:], 0)
        capital = np.flatnonzero((data == _LEAD) & (after >= 0x80) & (after <= 0x9E)) + 1
        low[capital] += 0x20
        odd = (data >= 0xC0) & ((data != _LEAD) | (after == _SIGNS[0]) | (after == _SIGNS[1])) | (data == 60) & (after == 124)
        odd = np.concatenate(([0], np.cumsum(odd)))
        cls = _CLASS[data]
        change = np.ones(size + 1, dtype=bool)
        change[1:size] = (cls[1:] != cls[:-1]) | (cls[1:] == 2)
        change[offsets] = True
        # A lone apostrophe before one of the fixed endings is one piece with it.
        lone = np.flatnonzero((data == 39) & change[:-1] & change[1:])
        if len(lone):
            row_end = offsets[np.searchsorted(offsets, lone, side="right")]
            padded = np.append(low, (0, 0))
            one, two = padded[lone + 1], padded[lone + 2]
            length = np.isin(one, list(b"stmd")).astype(np.int64)
            for x, y in (b"re", b"ve", b"ll"):
                length[(one == x) & (two == y)] = 2
            lone, length = (x[(length > 0) & (lone + length < row_end)] for x in (lone, length))
            change[lone + 1] = False
            change[lone + 1 + length] = True
        edges = np.flatnonzero(change)
        inside = cls[edges[:-1]] != 0
        return low, edges[:-1][inside], edges[1:][inside], odd[offsets[1:]] - odd[offsets[:-1]] > 0

    def _rows(self, column: pa.Array, have: Payloads, learn: Callable, odd: Callable, spread: bool) -> Iterator[np.ndarray]:
        """For each row its payloads; spread: each piece's numbers stand at its bytes, and zero elsewhere."""
        data, offsets = utf8(column)
        n, first = len(offsets) - 1, 0
        while first < n:
            end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GROUP, side="right")) - 1)
            group, at = data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
            low, start, stop, strange = self._cut(group, at) if len(group) else (group, at[:0], at[:0], np.zeros(end - first, bool))
            have.now += 1
            if len(start):
                run = np.zeros(len(low) + 1, dtype=np.uint64)
                np.cumsum(_SEED[low] * _UP.upto(len(low)), out=run[1:])
                key, where = np.unique(mix((run[stop] - run[start]) * _DOWN.upto(len(low))[start] + (stop - start).astype(np.uint64)), return_inverse=True)
                slot, known = have.find(key)
                if not known.all():
                    one = np.zeros(len(key), dtype=np.int64)
                    one[where] = np.arange(len(where))
                    new = one[~known]
                    have.used[slot[known]] = have.now
                    have.add(key[~known], *learn(low, start[new], stop[new]))
                    slot, _ = have.find(key)
                have.used[slot] = have.now
                size, begin = have.size[slot][where], have.start[slot][where]
            else:
                size = begin = at[:0]
            if spread:
                flat = np.zeros(len(low), have.pool.dtype)
                flat[gather(np.arange(len(low)), start, stop - start)] = gather(have.pool, begin, size)
                bounds = at
            else:
                flat = gather(have.pool, begin, size)
                bounds = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, at)]
            for k in range(end - first):
                yield odd(group[at[k] : at[k + 1]].tobytes().decode()) if strange[k] else flat[bounds[k] : bounds[k + 1]]
            first = end

    # Ids

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each whole text; null is empty."""
        return self._rows(column, self.ids, self._learn_ids, self._odd_ids, spread=False)

    def _odd_ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn_ids(self, low: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round merges, in every piece that still has one, the leftmost pair of least rank."""
        size = stop - start
        raw = gather(low, start, size)
        ends = np.cumsum(size)
        ids = self.open[raw]
        ids[ends - 1] = self.closed[raw[ends - 1]]
        owner = np.repeat(np.arange(len(size)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.int64(1 << 40)
        while len(ids):
            same = owner[1:] == owner[:-1]
            key = (ids[:-1] << 20) | ids[1:]
            at = np.searchsorted(self.pair, key)
            rank = np.append(np.where((self.pair[at] == key) & same, self.rank[at], none), none)
            first = np.flatnonzero(np.append(True, ~same))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            more = best < none
            if not more.all():
                done.append((owner[~more], ids[~more]))
            hit = np.flatnonzero(more & (rank == best))
            if len(hit):
                hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]
                ids[hit] = self.made[at[hit]]
                more[hit + 1] = False
            ids, owner = ids[more], owner[more]
        owner, ids = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        return np.bincount(owner, minlength=len(size)), ids[np.argsort(owner, kind="stable")].astype("<u4")

    # Counts at every prefix

    def prefix_deltas(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For each text the change of the token count at each of its bytes; the sum up to a byte is the exact count of that prefix.

        A prefix that ends within a character counts as the one before that character.
        """
        return self._rows(column, self.deltas, self._learn_deltas, self._odd_deltas, spread=True)

    def _learn_deltas(self, low: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = low.tobytes()
        pieces = [raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        found = {p: self._piece_deltas(p) for p in sorted(pieces)}  # neighbours share the states of their common prefix
        return stop - start, np.frombuffer(b"".join(map(found.__getitem__, pieces)), dtype=np.int8)

    def _piece_deltas(self, piece: bytes) -> bytes:
        text = piece.decode()
        if text[0] == "'" and text[1:].isalpha():  # an ending: its shorter prefixes are cut otherwise
            counts = [len(self.library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        else:
            counts = self.prefix_counts(piece)
        out, last, k = bytearray(len(piece)), 0, -1
        for c in text:
            k += 1 if c < "\x80" else len(c.encode())
            n = counts[k]
            out[k] = (n - last) & 255
            last = n
        return bytes(out)

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token count of each prefix of a piece, closed as a piece of its own.

        Dynamic programming: the encoding of a prefix is that of a shorter prefix and one last token, namely the
        only token that ends there and stays apart from the last token before it. So a prefix needs its last
        token and its count only, and each follows from those of shorter prefixes.
        """
        text = "".join([self.symbols[b] for b in piece])
        (opened_as, closed_as), longest, known, apart = self._ids, self.longest, self._apart, self.apart
        before, last, count, out = self._state
        same = len(os.path.commonprefix((before, text)))
        last, count, out = last[: same + 1], count[: same + 1], out[:same]
        for i in range(same + 1, len(text) + 1):
            closed = opened = 0
            for j in range(i - 1, max(-1, i - longest - 1), -1):
                part = text[j:i]
                if not closed and (t := closed_as.get(part)) is not None and (not j or (known[key] if (key := last[j] << 20 | t) in known else apart(key))):
                    closed = count[j] + 1
                    if opened:
                        break
                if not opened and (t := opened_as.get(part)) is not None and (not j or (known[key] if (key := last[j] << 20 | t) in known else apart(key))):
                    opened, token = count[j] + 1, t
                    if closed:
                        break
            last.append(token)
            count.append(opened)
            out.append(closed)
        self._state = text, last, count, out
        return out

    def apart(self, key: int) -> bool:
        """Whether two neighbouring tokens stay as they are: no merge across their border comes before those that make them."""
        if len(self._apart) > 200_000:
            self._apart.clear()
        a, b = key >> 20, key & 0xFFFFF
        merge, made, base = self.merge, self.made_by, (-1, -1, -1)
        bound, good = 1 << 40, True
        while good:
            across = merge.get((a, b))
            if across is not None and across[0] < bound:
                good = False
                break
            (ra, _, a_right), (rb, b_left, _) = made.get(a, base), made.get(b, base)
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # undo the later of the two merges
                bound, a = ra, a_right
            else:
                bound, b = rb + 1, b_left
        self._apart[key] = good
        return good

    def _odd_deltas(self, text: str) -> np.ndarray:
        """As the fast path, for any text: special strings, other alphabets, decomposed characters."""
        return self._composed(text) if unicodedata.is_normalized("NFC", text) else self._decomposed(text)

    def _decomposed(self, text: str) -> np.ndarray:
        """For a text that the normaliser changes. It is cut where nothing composes across the cut. Behind a whole segment the count is
        that of the composed text there; a prefix that ends within one is encoded from the last white space on, where pieces end."""
        nfc = lambda s: unicodedata.normalize("NFC", s)
        segments = [text[0]]
        for c in text[1:]:
            if not unicodedata.combining(c) and nfc(segments[-1] + c) == nfc(segments[-1]) + nfc(c):
                segments.append(c)
            else:
                segments[-1] += c
        composed = nfc(text)
        counts = np.concatenate(([0], np.cumsum(self._composed(composed), dtype=np.int64)))[np.cumsum([0, *[len(c.encode()) for c in composed]])]
        out, last, at, word = [], 0, 0, 0
        for segment in segments:
            whole = nfc(segment)
            for k, c in enumerate(segment, 1):
                n = int(counts[at + len(whole)] if k == len(segment) else counts[word] + len(self.library.encode(composed[word:at] + nfc(segment[:k]), add_special_tokens=False).ids))
                out += [0] * (len(c.encode()) - 1) + [n - last]
                last = n
            at += len(whole)
            if whole[-1].isspace():
                word = at
        return np.array(out, dtype=np.int8)

    def _composed(self, text: str) -> np.ndarray:
        out: list[int] = []
        at = 0
        for m in self.special.finditer(text):
            part = self._ordinary(text[at : m.end()])
            part[-1] = sum(part[: len(text[at : m.start()].encode())]) + 1 - sum(part[:-1])
            out += part
            at = m.end()
        return np.array(out + self._ordinary(text[at:]), dtype=np.int8)

    def _ordinary(self, text: str) -> list[int]:
        lowered = [c.lower() for c in text]
        low = "".join(lowered)
        counts: list[int] = []  # at each lower-cased character
        done = at = 0
        for m in self.pieces.finditer(low):
            counts += [done] * (m.start() - at)
            steps = np.cumsum(np.frombuffer(self._piece_deltas(m[0].encode()), dtype=np.int8))
            ends = np.cumsum([len(c.encode()) for c in m[0]]) - 1
            counts += (done + steps[ends]).tolist()
            done, at = counts[-1], m.end()
        counts += [done] * (len(low) - at)
        out, last, k = [], 0, 0
        for c, lc in zip(text, lowered, strict=True):
            k += len(lc)
            n = counts[k - 1]
            out += [0] * (len(c.encode()) - 1) + [n - last]
            last = n
        return out
