"""Splitting texts into independent pieces for byte-level BPE vocabularies, on arrays.

A *piece* is a stretch of bytes that no merge can cross: a pre-token, or a part of one between
forced boundaries.  Pieces are found with array operations over a whole batch, reduced to the
distinct ones, and only a distinct piece is ever handed to the tokenizer's model.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

from . import textscan as ts

LETTER, NUMBER, WHITE, OTHER = 0, 1, 2, 3
#: Distinct pieces that a worker keeps with their ids; when full, the table starts anew.
CACHE_PIECES = 400_000
#: Ids that such a table holds before it starts anew.
CACHE_IDS = 8_000_000
#: The contractions of the public pre-tokenizer pattern.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


UNKNOWN = 255
_classes = np.full(0x110000, UNKNOWN, np.uint8)


def _learn(points: np.ndarray) -> None:
    """Asks the tokenizers library's own pattern engine for the classes of some code points."""
    from tokenizers import Regex, pre_tokenizers

    text = "".join(map(chr, points.tolist()))
    _classes[points] = OTHER
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for _, (a, b) in split.pre_tokenize_str(text):
            _classes[points[a:b]] = cls


def class_of(points: np.ndarray) -> np.ndarray:
    """The class of each code point, as the library's patterns see it; new ones are learnt when first met."""
    got = _classes[points]
    if (got == UNKNOWN).any():
        _learn(np.unique(points[got == UNKNOWN]))
        got = _classes[points]
    return got


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of valid UTF-8 belongs to."""
    cls = class_of(np.arange(128))[buf & 0x7F]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = buf.astype(np.uint32, copy=False) if len(lead) * 8 > len(buf) else buf
        at = lambda i: b[np.minimum(i, len(buf) - 1)].astype(np.uint32) & 0x3F
        first = buf[lead].astype(np.uint32)
        two, three = first < 0xE0, (first >= 0xE0) & (first < 0xF0)
        cp = np.where(two, (first & 0x1F) << 6 | at(lead + 1), np.where(three, (first & 0x0F) << 12 | at(lead + 1) << 6 | at(lead + 2), (first & 0x07) << 18 | at(lead + 1) << 12 | at(lead + 2) << 6 | at(lead + 3)))
        of = class_of(cp)
        cls[lead], cls[lead + 1] = of, of
        cls[lead[~two] + 2] = of[~two]
        four = ~two & ~three
        cls[lead[four] + 3] = of[four]
    return cls


def _contractions(buf: np.ndarray, cls: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes `at` where a piece begins (`end`: of their documents), those that begin a contraction, and its length."""
    n = len(buf) - 1
    c1, c2 = buf[np.minimum(at + 1, n)], buf[np.minimum(at + 2, n)]
    length = np.zeros(len(at), np.int64)
    for word in CONTRACTIONS:
        tail = word[1:].encode()
        ok = (c1 == tail[0]) & (at + len(tail) < end)
        if len(tail) == 2:
            ok &= c2 == tail[1]
        length[ok & (length == 0)] = 1 + len(tail)
    return at[length > 0], length[length > 0]


def run_starts(buf: np.ndarray, offs: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Marks the first byte of each run of one class inside a document."""
    start = np.empty(len(buf), bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start[offs[:-1][offs[:-1] < offs[1:]]] = True
    return start


def space_attached(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece starts and ends under the public byte-level pattern: a space goes with what follows it."""
    cls = byte_classes(buf)
    start = run_starts(buf, offs, cls)
    white = cls == WHITE
    solid = np.flatnonzero(start & ~white)  # first bytes of runs that are not white space
    has_before = np.ones(len(solid), bool)
    has_before[np.isin(solid, offs[:-1])] = False
    after = solid[has_before & (solid > 0)]
    after = after[white[after - 1]]  # preceded by white space of their document
    # the last white character before them: its first byte (it may have several)
    last = after - 1
    for _ in range(3):
        last = np.where((buf[last] & 0xC0) == 0x80, last - 1, last)
    start[last] = True
    start[after[buf[after - 1] == 0x20]] = False
    quote = np.flatnonzero(start & (buf == 0x27))
    if len(quote):
        end = offs[np.searchsorted(offs, quote, side="right")]
        at, length = _contractions(buf, cls, quote, end)
        start[at + 1] = False
        rest = at + length
        rest = rest[(rest < len(buf)) & ~np.isin(rest, offs)]
        start[rest] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], len(buf))


def space_dropped(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece starts and ends under the public word-end pattern: white space lies in no piece, a digit is one."""
    cls = byte_classes(buf)
    start = run_starts(buf, offs, cls)
    start |= (cls == NUMBER) & ((buf & 0xC0) != 0x80)
    quote = np.flatnonzero(start & (buf == 0x27))
    if len(quote):
        end = offs[np.searchsorted(offs, quote, side="right")]
        at, length = _contractions(buf, cls, quote, end)
        start[at + 1] = False
        rest = at + length
        rest = rest[(rest < len(buf)) & ~np.isin(rest, offs)]
        start[rest] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(buf))
    keep = cls[starts] != WHITE
    return starts[keep], ends[keep]


@lru_cache(maxsize=1)
def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies, from its public rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file of the tokenizers library, opened once per worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(self.spec))
        self.model = self.tokenizer.model
        self.normalizer = self.tokenizer.normalizer
        self.suffix = self.spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"] if t["special"]}
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split: Callable = space_dropped if self.suffix else space_attached
        self.chars = {b: c for b, c in enumerate(byte_chars())}
        self._inner = None
        self._seen: dict[str, dict] = {}
        self._rows: dict[bytes, int] = {}
        self._ids, self._ends = array("I"), array("q", [0])

    @property
    def inner_model(self):
        """The same merges without the word-end mark, for parts of a word that do not end it."""
        if self._inner is None:
            from tokenizers import Tokenizer

            spec = json.loads(json.dumps(self.spec))
            spec["model"]["end_of_word_suffix"] = None
            self._keep = Tokenizer.from_str(json.dumps(spec))
            self._inner = self._keep.model
        return self._inner

    @property
    def tokens(self) -> dict[str, int]:
        return self.spec["model"]["vocab"]

    def joined_pairs(self) -> np.ndarray:
        """256 x 256: whether two bytes stand next to each other inside any token; the rest are forced boundaries."""
        back = {c: b for b, c in enumerate(byte_chars())}
        seen = np.zeros((256, 256), bool)
        for token in self.tokens:
            if self.suffix and token.endswith(self.suffix):
                token = token[: -len(self.suffix)]
            raw = [back[c] for c in token]
            seen[raw[:-1], raw[1:]] = True
        return seen

    def model_tokens(self, piece: bytes, ends_word: bool = True) -> list:
        """The tokens of one piece, from the tokenizer's model."""
        model = self.model if ends_word else self.inner_model
        if piece.isalpha():
            return model.tokenize(piece.decode())
        if piece[:1] == b" " and piece[1:].isalpha():
            return model.tokenize(self.chars[0x20] + piece[1:].decode())
        return model.tokenize(piece.decode("latin-1").translate(self.chars))

    def lookup(self, kind: str, pieces: list[bytes], flags: list[int], make: Callable) -> list:
        """`make(piece, flag)` of each piece, kept in a table of bounded size for each kind of answer."""
        seen = self._seen.setdefault(kind, {})
        if len(seen) + len(pieces) > CACHE_PIECES:
            seen.clear()
        keys = _keys(pieces, flags)
        out = list(map(seen.get, keys))
        for k, got in enumerate(out):
            if got is None:
                out[k] = seen[keys[k]] = make(pieces[k], flags[k])
        return out

    def ids(self, pieces: list[bytes], flags: list[int], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces `of` names, in their order, and the number of ids of each.

        Ids of distinct pieces are kept behind each other in one table of bounded size.
        """
        if len(self._rows) + len(pieces) > CACHE_PIECES or len(self._ids) > CACHE_IDS:
            self._rows, self._ids, self._ends = {}, array("I"), array("q", [0])
        keys = _keys(pieces, flags)
        row = np.fromiter(map(self._rows.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(row < 0)
        first = len(self._rows)
        for k in new.tolist():
            if flags[k] == 2:
                self._ids.append(self.special[pieces[k].decode()])
            else:
                self._ids.extend([t.id for t in self.model_tokens(pieces[k], flags[k] == 1)])
            self._ends.append(len(self._ids))
        row[new] = np.arange(first, first + len(new))
        self._rows.update(zip((keys[k] for k in new.tolist()), range(first, first + len(new)), strict=True))
        pool, ends = np.array(self._ids, np.uint32), np.array(self._ends, np.int64)
        base, n = ends[row][of], (ends[row + 1] - ends[row])[of]
        upto = np.cumsum(n)
        return pool[np.repeat(base - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)], n


def _keys(pieces: list[bytes], flags: list[int]) -> list[bytes]:
    """0xFF is in no UTF-8 text, so a fragment inside a word has a key of its own."""
    if min(flags, default=1) == max(flags, default=1) == 1:
        return pieces
    return [p if f == 1 else p + bytes([0xFF, f]) for p, f in zip(pieces, flags, strict=True)]


_open: dict[str, Vocabulary] = {}


#: Characters above this can be changed by composition, or lower-cased otherwise than by str.lower().
_BEYOND_LATIN = re.compile("[\u0130\u0250-\U0010ffff]")


def normalize(vocab: Vocabulary, text: str) -> str:
    """The vocabulary's own normalizer, up to white space; plain Latin text needs lower-casing only."""
    if text.isascii() or not _BEYOND_LATIN.search(text):
        return text.lower()
    return vocab.normalizer.normalize_str(text)


def vocabulary(path: str) -> Vocabulary:
    if path not in _open:
        _open[path] = Vocabulary(path)
    return _open[path]


def sections(vocab: Vocabulary, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at the strings of special tokens: sections, their documents, and the special id or -1."""
    out, doc, special = [], [], []
    for i, t in enumerate(col.to_pylist()):
        t = t or ""
        if vocab.find_special is not None and "<|" in t:
            for part in vocab.find_special.split(t):
                if part:
                    out.append(part)
                    doc.append(i)
                    special.append(vocab.special.get(part, -1))
        elif t:
            out.append(t)
            doc.append(i)
            special.append(-1)
    return out, np.array(doc, np.int64), np.array(special, np.int64)


class Pieces:
    """The pieces of a step: for each its document and its distinct piece."""

    def __init__(self, buf, starts, ends, doc, flags):
        self.doc = doc
        eight, size = ts.octets(buf), ends - starts
        h = ts.range_hashes(buf, starts, ends, eight) ^ flags.astype(np.uint64)
        order = np.argsort(h)
        hs = h[order]
        new = np.empty(len(h), bool)
        if len(h):
            new[0] = True
            np.not_equal(hs[1:], hs[:-1], out=new[1:])
        self.of = np.empty(len(h), np.int64)
        self.of[order] = np.cumsum(new) - 1
        rep = order[new]
        raw = buf.tobytes()
        # a hash only brings pieces together: each is compared with the first of its group
        like = rep[self.of]
        same = (size == size[like]) & (flags == flags[like])
        same &= ts.equal_ranges(buf, starts, starts[like], np.where(same, size, 0), eight)
        if not same.all():
            table: dict = {}
            of = [table.setdefault((raw[s:e], f), len(table)) for s, e, f in zip(starts.tolist(), ends.tolist(), flags.tolist(), strict=True)]
            self.of = np.array(of, np.int64)
            rep = np.unique(self.of, return_index=True)[1]
        self.distinct = [raw[s:e] for s, e in zip(starts[rep].tolist(), ends[rep].tolist(), strict=True)]
        self.flags = flags[rep].tolist()


def pieces(vocab: Vocabulary, col: pa.Array, cut_pairs: np.ndarray | None = None):
    """Yields (first document, one after the last, Pieces, special ids by unit order) for bounded steps of a column.

    cut_pairs: pairs of bytes that may stand together; pieces are also cut at all other pairs.
    A special string is a piece of its own, marked by flag 2.
    """
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    _, offs = ts.text_buffer(col)
    for i, j in ts.steps(offs):
        texts, doc, special = sections(vocab, col.slice(i, j - i))
        plain = special < 0
        if vocab.normalizer is not None:
            texts = [normalize(vocab, t) if p else t for t, p in zip(texts, plain.tolist(), strict=True)]
        raw = [t.encode() for t in texts]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        so = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        if not len(buf):
            yield i, j, Pieces(buf, so[:0], so[:0], doc[:0], np.empty(0, np.int64))
            continue
        starts, ends = vocab.split(buf, so)
        unit = np.searchsorted(so, starts, side="right") - 1
        flags = np.ones(len(starts), np.int64)
        if not plain.all():
            at = np.flatnonzero(~plain)
            keep = plain[unit]
            starts = np.concatenate([starts[keep], so[at]])
            ends = np.concatenate([ends[keep], so[at + 1]])
            unit = np.concatenate([unit[keep], at])
            flags = np.concatenate([flags[keep], np.full(len(at), 2)])
            order = np.argsort(starts, kind="stable")
            starts, ends, unit, flags = starts[order], ends[order], unit[order], flags[order]
        if cut_pairs is not None:
            free = np.flatnonzero(~cut_pairs.ravel()[(buf[:-1].astype(np.int32) << 8) | buf[1:]]) + 1
            owner = np.searchsorted(starts, free, side="left") - 1
            owner0 = np.maximum(owner, 0)
            ok = (owner >= 0) & (free < ends[owner0]) & (flags[owner0] == 1)
            free, owner = free[ok], owner[ok]
            if len(free):
                all_starts = np.concatenate([starts, free])
                order = np.argsort(all_starts, kind="stable")
                src = np.concatenate([np.arange(len(starts)), owner])[order]
                all_starts = all_starts[order]
                nxt = np.append(all_starts[1:], len(buf))
                all_ends = np.minimum(ends[src], nxt)
                flags = np.where(all_ends == ends[src], flags[src], 0)
                starts, ends, unit = all_starts, all_ends, unit[src]
        yield i, j, Pieces(buf, starts, ends, doc[unit], flags)
