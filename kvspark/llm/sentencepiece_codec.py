"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary is a public BPE model with byte fallback and identity
normalisation; its file is a parameter (``MODEL_PATH``) and it is never trained
here. A text gets the dummy prefix, spaces become U+2581, and each chunk (spaces
and what follows them up to the next space) is merged from single characters: the
best-ranked pair first, the leftmost of equals. With ``dropout`` p, a candidate
merge of the characters [s, m) and [m, e) of a document is skipped for good where
the hash of (seed, doc_id, s, m, e) falls under p, so a segmentation is the same
on every run and every machine, and differs between seeds, documents and places.
With p = 0 it is the library's own encoding.

Chunks of all documents of a slice are merged in lockstep as arrays, one merge a
chunk and round; chunks over ``LONG_CHUNK`` characters go through an agenda (candidates by
rank and place) instead, so a text without spaces stays O(n log n). Chunks are first cut where two
neighbouring characters stand together in no piece, since nothing can merge there.
A document over ``SLICE_BYTES`` is encoded in pieces between such cuts, with the
places of its characters counted on.

Decoding is lossless for every text: characters outside the vocabulary, and a
U+2581 that stands in the text itself, are spelt as byte pieces.

Defined cases: null and empty texts have no tokens and decode to the empty text;
a null doc_id hashes as one of its own; repeated rows get the same tokens; an
empty table gives no rows; other columns are ignored; bytes that aren't UTF-8 are
read as U+FFFD and told by ``lossless`` false; ids outside the vocabulary and null
ones decode to nothing. A text of any length is encoded whole: beside it and its ids,
memory grows with the longest stretch without a cut (about 50 bytes a character;
words, numbers and scripts with many characters are cut often, a run of one letter isn't).
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import vectext as vt
from .work import texts

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 1
LONG_CHUNK = 256
SLICE_BYTES = 1 << 17  # what is worked on stays in the cache
#: Characters or candidates of a long chunk that are turned to arrays or Python numbers at a time.
AGENDA_BLOCK = 1 << 16
_U = np.uint64
_M64 = (1 << 64) - 1
#: A merge's code: rank, place and id of the merged piece, so that the smallest code is the next merge.
_ID_BITS, _RANK_AT = 18, 46
_ID = (1 << _ID_BITS) - 1
_NONE = _U((1 << 64 - _RANK_AT) - 1 << _RANK_AT)
_MARK = -3
_SPACE, _LITERAL = 0x2581, 0x110000
_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


class Vocabulary:
    """Tables of a BPE model: characters, mergeable pairs, pieces as bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        normal = [i for i in range(n) if not special[i]]
        rank = {x: k for k, x in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        if any("▁" in p[i:] for p in (pieces[j] for j in normal) for i in [len(p) - len(p.lstrip("▁"))]):
            raise ValueError("a piece reaches over a space")
        ids = {pieces[i]: i for i in normal}
        self.longest = max(map(len, ids))
        self.char = np.full(0x110001, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.nothing = next(i for i in range(n) if sp.is_unknown(i))
        self.byte0 = sp.piece_to_id("<0x00>")
        if n >= _ID:
            raise ValueError(f"at most {_ID - 1} pieces")
        # (left id, right id) -> code of the merge, without a place
        self.pairs = {(ids[p[:k]], ids[p[k:]]): rank[sp.get_score(i)] << _RANK_AT | i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self._table()
        # neighbouring characters of a piece; where two stand in none together, nothing merges
        self._near = np.array(sorted({ord(a) << 21 | ord(b) for p in ids for a, b in zip(p, p[1:])} | {-1}), np.int64)
        blobs = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_len = np.array([len(b) for b in blobs], np.int64)
        self.blob_at = np.concatenate([[0], np.cumsum(self.blob_len)])[:-1]

    def _table(self) -> None:
        bits = max(16, (8 * len(self.pairs)).bit_length())
        self._shift = _U(64 - bits)
        self._keys, self._vals = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE)
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        vals = np.array(list(self.pairs.values()), np.uint64)
        at = self._slot(keys)
        while len(keys):
            _, first = np.unique(at, return_index=True)
            first = first[self._keys[at[first]] == -1]
            self._keys[at[first]], self._vals[at[first]] = keys[first], vals[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, vals, at = keys[rest], vals[rest], (at[rest] + 1) & (len(self._keys) - 1)

    def apart(self, cp: np.ndarray) -> np.ndarray:
        """For each of the code points but the first: can nothing merge over its start?"""
        out = np.empty(max(0, len(cp) - 1), bool)
        for a in range(0, len(out), AGENDA_BLOCK):
            part = cp[a : a + AGENDA_BLOCK + 1]
            keys = part[:-1].astype(np.int64) << 21 | part[1:]
            at = np.minimum(np.searchsorted(self._near, keys), len(self._near) - 1)
            out[a : a + AGENDA_BLOCK] = self._near[at] != keys
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _U(_A)) >> self._shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Code of the merge of each pair, _NONE where there is none."""
        out = np.full(len(left), _NONE)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[at].astype(np.int64) << 32 | right[at]
        slot = self._slot(keys)
        while len(at):
            have = self._keys[slot]
            hit = have == keys
            out[at[hit]] = self._vals[slot[hit]]
            on = ~hit & (have != -1)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & (len(self._keys) - 1)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _mix_int(h: int) -> int:
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & _M64
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & _M64
    return h ^ (h >> 32)


class Dropout:
    """Which candidate merges are skipped."""

    def __init__(self, p: float, seed: int, doc_keys: np.ndarray, doc_of: np.ndarray, first: np.ndarray):
        """doc_keys: one each document; doc_of: each character's document; first: each document's first character."""
        self.p, self.bar = p, _U(min(int(p * 2.0**64), _M64))
        self.salt = vt.mix(doc_keys ^ vt.mix(np.array([seed], np.int64).view(np.uint64)))
        self.doc_of, self.first = doc_of, first

    def skip(self, s: np.ndarray, m: np.ndarray, e: np.ndarray) -> np.ndarray:
        d = self.doc_of[s]
        f = self.first[d]
        h = self.salt[d] + (s - f).astype(np.uint64) * _U(_A) + (m - f).astype(np.uint64) * _U(_B) + (e - f).astype(np.uint64) * _U(_C)
        return vt.mix(h) < self.bar

    def skip_one(self, s: int, m: int, e: int) -> bool:
        d = int(self.doc_of[s])
        f = int(self.first[d])
        return _mix_int((int(self.salt[d]) + (s - f) * _A + (m - f) * _B + (e - f) * _C) & _M64) < int(self.bar)


def _agenda(v: Vocabulary, sym: np.ndarray, at: int, drop: Dropout | None, out: np.ndarray) -> None:
    """Merge one chunk, which begins at character ``at``, rank by rank.

    Candidates of worse ranks than the one at work wait in arrays by rank, one number each, and are
    sorted when their rank's turn comes. What a merge offers at this rank or a better one lies beside
    it and comes next, so the heap of these stays small.
    """
    n, width = len(sym), v.longest.bit_length()
    kind = "i" if n < 1 << 31 else "q"
    # a symbol ends where the next one starts
    ids, nxt, prv = array("i", sym.astype(np.int32).tobytes()), array(kind, range(1, n + 1)), array(kind, range(-1, n - 1))
    gone = bytearray(n)
    #: by rank: place, and the lengths of the left part and of both
    waiting: dict[int, array] = {}
    for a in range(0, n - 1, AGENDA_BLOCK):
        i = np.arange(a, min(a + AGENDA_BLOCK, n - 1))
        code = v.merged(sym[i], sym[i + 1])
        i, code = i[code != _NONE], code[code != _NONE]
        if drop and len(i):
            stay = ~drop.skip(at + i, at + i + 1, at + i + 2)
            i, code = i[stay], code[stay]
        rank = (code >> _U(_RANK_AT)).astype(np.int64)
        order = np.argsort(rank, kind="stable")
        x = i.astype(np.uint64) << _U(2 * width) | _U(1 << width | 2)
        each, first = np.unique(rank[order], return_index=True)
        for r, part in zip(each.tolist(), np.split(x[order], first[1:])):
            waiting.setdefault(r, array("Q")).frombytes(part.tobytes())
    ranks = list(waiting)
    heapq.heapify(ranks)
    soon: list[tuple[int, int]] = []
    now = -1

    def offer(i: int) -> None:
        j = nxt[i]
        if j >= n:
            return
        new = v.pairs.get((ids[i], ids[j]))
        if new is None or drop and drop.skip_one(at + i, at + j, at + nxt[j]):
            return
        r, x = new >> _RANK_AT, (i << width | j - i) << width | nxt[j] - i
        if r <= now:
            heapq.heappush(soon, (r, x))
        elif r in waiting:
            waiting[r].append(x)
        else:
            waiting[r] = array("Q", (x,))
            heapq.heappush(ranks, r)

    part = (1 << width) - 1

    def merge(x: int) -> None:
        i = x >> 2 * width
        j = i + (x >> width & part)
        if gone[i] or nxt[i] != j or j >= n or nxt[j] != i + (x & part):
            return
        ids[i], gone[j] = v.pairs[ids[i], ids[j]] & _ID, 1
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        if prv[i] >= 0:
            offer(prv[i])
        offer(i)

    while ranks:
        now = heapq.heappop(ranks)
        turn = np.frombuffer(waiting.pop(now), np.uint64).copy()
        turn.sort()
        for a in range(0, len(turn), AGENDA_BLOCK):
            for x in turn[a : a + AGENDA_BLOCK].tolist():
                while soon and soon[0] < (now, x):
                    merge(heapq.heappop(soon)[1])
                merge(x)
        while soon:
            merge(heapq.heappop(soon)[1])
    left = np.flatnonzero(np.frombuffer(gone, np.uint8) == 0)
    out[at + left] = np.frombuffer(ids, np.int32)[left]


def _lockstep(v: Vocabulary, sym: np.ndarray, starts: np.ndarray, lengths: np.ndarray, drop: Dropout | None, out: np.ndarray) -> None:
    """Merge the chunks that begin at the characters ``starts``, one merge a chunk and round.

    Each chunk ends with a mark of an id of its own, which nothing merges with; so every
    symbol ends where the next one starts.
    """
    wl = lengths + 1
    ws = np.cumsum(wl) - wl
    st = np.repeat(starts - ws, wl) + np.arange(wl.sum())
    ids = sym[np.minimum(st, len(sym) - 1)]
    ids[ws + lengths] = _MARK
    st = st.astype(np.int32) if len(sym) < 1 << 31 else st

    def codes(i: np.ndarray) -> np.ndarray:
        r = v.merged(ids[i], ids[i + 1])
        if drop:
            hit = np.flatnonzero(r != _NONE)
            k = i[hit]
            r[hit[drop.skip(st[k], st[k + 1], st[k + 2])]] = _NONE
        return r

    code = np.full(len(ids), _NONE)
    code[:-1] = codes(np.arange(len(ids) - 1))
    place = np.arange(len(ids), dtype=np.uint64) << _U(_ID_BITS)
    none, low = _NONE >> _U(_RANK_AT), _U((1 << _RANK_AT - _ID_BITS) - 1)
    while len(wl):
        best = np.minimum.reduceat(code | place[: len(code)], ws)
        has = best >> _U(_RANK_AT) != none
        if has.all():
            stay = np.ones(len(ids), bool)
        else:
            stay = np.repeat(has, wl)
            done = np.flatnonzero(~stay)
            done = done[ids[done] != _MARK]
            out[st[done]] = ids[done]
            best, wl = best[has], wl[has]
        i = (best >> _U(_ID_BITS) & low).astype(np.int64)
        ids[i] = best & _U(_ID)
        stay[i + 1] = False
        keep = np.flatnonzero(stay)
        i = np.cumsum(stay)[i] - 1
        ids, st, code = ids.take(keep), st.take(keep), code.take(keep)
        wl = wl - 1
        ws = np.cumsum(wl) - wl
        again = np.concatenate([i, i[i > 0] - 1])
        code[again] = codes(again)


def _marked(cp: np.ndarray) -> np.ndarray:
    """Code points with U+2581 for spaces, and a literal one as _LITERAL."""
    return np.where(cp == _SPACE, _LITERAL, np.where(cp == 32, _SPACE, cp))


def encode_slice(v: Vocabulary, s: vt.Slice, doc_keys: np.ndarray, dropout: float = 0.0, seed: int = SEED, begun: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, n + 1 offsets) of a slice's documents; doc_keys: a uint64 for each.

    ``begun``: characters before the slice of the one document that it continues, the
    dummy prefix among them.
    """
    cp, off = s.code_points()
    full = off[1:] > off[:-1]
    cp = _marked(cp)
    if not begun:
        cp = np.insert(cp, off[:-1][full], _SPACE)
        off = off + np.concatenate([[0], np.cumsum(full)])
    if not len(cp):
        return np.zeros(0, np.int32), np.zeros(s.n + 1, np.int64)
    sym = v.char[cp]
    space = cp == _SPACE
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[off[:-1][full]] = True
    starts = np.flatnonzero(head)
    lengths = np.diff(np.append(starts, len(cp)))
    if (lengths > LONG_CHUNK).any():
        head[1:] |= v.apart(cp)
        starts = np.flatnonzero(head)
        lengths = np.diff(np.append(starts, len(cp)))
    drop = None
    if dropout > 0:
        drop = Dropout(dropout, seed, doc_keys, np.repeat(np.arange(s.n, dtype=np.int32), np.diff(off)), off[:-1] - begun)
    out = np.full(len(cp), -2, np.int32)
    short = lengths <= LONG_CHUNK
    if short.any():
        _lockstep(v, sym, starts[short], lengths[short], drop, out)
    for a, n in zip(starts[~short].tolist(), lengths[~short].tolist()):
        _agenda(v, sym[a : a + n], a, drop, out)
    at = np.flatnonzero(out != -2)
    ids = out[at]
    width = np.ones(len(ids), np.int64)
    odd = np.flatnonzero(ids == -1)
    if len(odd):
        chars = cp[at[odd]]
        chars = np.where(chars == _LITERAL, _SPACE, chars)
        width[odd] = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        spelt = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int64) + v.byte0
        ids = np.repeat(ids, width)
        ids[ids == -1] = spelt
    before = np.concatenate([[0], np.cumsum(width)])
    return ids.astype(np.int32), before[np.searchsorted(at, off)]


def _long_pieces(v: Vocabulary, b: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A document's bytes in pieces of ``size`` or, where nothing may be cut, more."""
    at = 0
    while at < len(b):
        step, cut = size, len(b)
        while at + step < len(b):
            part = b[at : at + step]
            space = part == 32
            heads = np.flatnonzero(space[1:] & ~space[:-1])
            if len(heads):
                cut = at + int(heads[-1]) + 1
                break
            # no space: between characters that stand together in no piece
            begins = np.flatnonzero((part & 0xC0) != 0x80)
            loose = np.flatnonzero(v.apart(_marked(vt.code_points(part[: begins[-1]])))) if len(begins) > 2 else ()
            if len(loose):
                cut = at + int(begins[loose[-1] + 1])
                break
            step *= 2
        yield b[at:cut]
        at = cut


def encoded(v: Vocabulary, parts: Iterable[vt.Slice | vt.Long], keys: np.ndarray, dropout: float, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each slice: ids, n + 1 offsets, whether decoding gives the document again, and its first document's number."""
    for s in parts:
        own = keys[s.first : s.first + s.n]
        if isinstance(s, vt.Slice):
            ids, off = encode_slice(v, s, own, dropout, seed)
            back, at = decode_ids(v, ids, off)
            same = np.diff(at) == np.diff(s.off)
            if len(back) == len(s.b) and same.all():
                same = s.count(back != s.b) == 0 if len(back) else same
            else:
                same = np.array([np.array_equal(back[at[i] : at[i + 1]], s.b[s.off[i] : s.off[i + 1]]) for i in range(s.n)])
            yield ids, off, same, s.first
            continue
        found, begun, same = array("i"), 0, True
        for b in _long_pieces(v, s.b, SLICE_BYTES):
            ids, off = encode_slice(v, vt.Slice(0, b, np.array([0, len(b)])), own, dropout, seed, begun)
            same = same and np.array_equal(decode_ids(v, ids, off, not begun)[0], b)
            begun += int(((b & 0xC0) != 0x80).sum()) + (not begun)
            found.frombytes(ids.tobytes())
        ids = np.frombuffer(found, np.int32)
        yield ids, np.array([0, len(ids)]), np.array([same]), s.first


def decode_ids(v: Vocabulary, ids: np.ndarray, off: np.ndarray, prefixed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, n + 1 offsets) of the texts that the ids spell, without the dummy prefix that they begin with if ``prefixed``."""
    n = v.blob_len[ids]
    ends = np.cumsum(n)
    src = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(v.blob_at[ids] - (ends - n), n)
    b = v.blob[src]
    at = np.concatenate([[0], ends])[off]
    if not prefixed:
        return b, at
    full = at[1:] > at[:-1]
    first = at[:-1][full]
    first = first[b[first] == 32]
    cut = np.zeros(len(b) + 1, np.int64)
    cut[first + 1] = 1
    return np.delete(b, first), at - np.cumsum(cut)[at]


def keys_of(col: pa.Array) -> np.ndarray:
    """A uint64 for each id; null has one of its own."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    raw = np.asarray(col.cast(pa.int64()).fill_null(0)).view(np.uint64)
    k = vt.mix(raw + _U(1))
    k[np.asarray(col.is_null())] = _U(_C)
    return k


def encode(docs: DataFrame, model_path: str = MODEL_PATH, dropout: float = DROPOUT, seed: int = SEED, number: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, lossless (decoding the ids gave the text again). One scan, no shuffle.

    ``number`` names a column that tells rows of one doc_id apart: copies of a
    document with other numbers get other segmentations. Number 1 is like none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for b in batches:
            keys = keys_of(b.column("doc_id"))
            if number:
                copy = np.asarray(b.column("number").fill_null(1)).view(np.uint64) - _U(1)
                keys = np.where(copy == 0, keys, vt.mix(keys ^ copy * _U(_B)))
            for ids, off, same, first in encoded(v, vt.slices(b.column("text"), SLICE_BYTES), keys, dropout, seed):
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, len(same)), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)), pa.array(same)],
                    ["doc_id", "n_tokens", "ids", "lossless"],
                )

    rows = texts(docs, F.col(number).cast("bigint").alias("number")) if number else texts(docs)
    return rows.mapInArrow(work, "doc_id bigint, n_tokens bigint, ids array<int>, lossless boolean")


#: Ids that are decoded at a time.
DECODE_IDS = 1 << 20


def decode(tokens: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, text from the columns doc_id and ids; null ids give the empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for b in batches:
            lists = b.column("ids").cast(pa.large_list(pa.int64()))
            off = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists).fill_null(0), np.int64))])
            flat = np.asarray(lists.flatten().fill_null(-1), np.int64)
            flat = np.where((flat >= 0) & (flat < len(v.blob_len)), flat, v.nothing)
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + DECODE_IDS, "right")) - 1)
                if off[j] - off[i] <= DECODE_IDS:
                    raw, at = decode_ids(v, flat[off[i] : off[j]], off[i : j + 1] - off[i])
                    out = [raw[p:q].tobytes() for p, q in zip(at[:-1], at[1:])]
                else:
                    cuts = range(int(off[i]), int(off[j]), DECODE_IDS)
                    out = [b"".join(decode_ids(v, x := flat[k : min(k + DECODE_IDS, off[j])], np.array([0, len(x)]), k == off[i])[0].tobytes() for k in cuts)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())], ["doc_id", "text"])
                i = j

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<bigint>").alias("ids")).mapInArrow(work, "doc_id bigint, text string")
