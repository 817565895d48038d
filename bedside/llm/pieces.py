"""SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary is read from a SentencePiece model of the BPE kind with byte fallback, no normalisation and a blank
in front of the text. Each position keeps one backpointer: the piece that ends the best path to it. A step from one
piece to the next costs nothing if the model's own merges would leave the two side by side, and is barred otherwise,
so the one path that is left is the model's own segmentation. Only a window of the longest piece's length can still be
extended; ids are committed whenever all paths that end in the window run through one boundary.

A blank that follows another character starts a piece in every path, and so does a character that occurs in no
longer piece; paths converge there by themselves. Stretches between such boundaries are encoded once and kept. The new
stretches of a record batch that end within one window take their steps side by side in numpy: step t settles
the t-th position of each. A longer stretch goes through its windows alone and commits where its paths meet.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words

BLANK = "▁"
#: Stretches that a worker keeps, and slots for pairs of pieces (a power of two).
KEPT_STRETCHES, PAIR_SLOTS = 400_000, 1 << 20
#: Bytes of text whose new stretches take their steps together; the pieces at all of their places are held meanwhile.
PART = 1 << 18
_WINDOWS = 4  # a path first looks for a meeting point after so many lengths of the longest piece
_CODE = 21  # bits of a code point; also of a piece, as pieces that are a code point only are numbered after the others
_END = (1 << _CODE) - 1  # no code point
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(NamedTuple):
    """Pieces by id, their scores, the ids of the 256 bytes, and the id of the unknown piece."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    special: frozenset[int]


def load_vocabulary(model_file: str) -> Vocabulary:
    """Read the model on the driver; executors get the pieces, not the path."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = frozenset(i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    if not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte fallback")
    return Vocabulary(pieces, [model.get_score(i) for i in ids], byte_ids, special)


class Trie:
    """Pieces as a trie whose steps (node, code point) are looked up for whole arrays in a table with open addresses."""

    def __init__(self, pieces: dict[str, int]):
        child: dict[int, int] = {}
        piece_of = [-1]
        for piece, number in pieces.items():
            node = 0
            for c in piece:
                key = node << _CODE | ord(c)
                if key not in child:
                    child[key] = len(piece_of)
                    piece_of.append(-1)
                node = child[key]
            piece_of[node] = number
        self.piece_of = np.array(piece_of, dtype=np.int64)
        bits = max(4, (8 * len(child)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._nodes, self._probes = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64), 1
        slots = self._slot(np.fromiter(child, dtype=np.int64, count=len(child))).tolist()
        for (key, node), slot in zip(child.items(), slots):
            probes = 1
            while self._keys[slot] >= 0:
                slot, probes = slot + 1 & self._mask, probes + 1
            self._keys[slot], self._nodes[slot] = key, node
            self._probes = max(self._probes, probes)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _MULTIPLIER >> self._shift).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each node, -1 where there is none."""
        keys = nodes << _CODE | codes
        slot = self._slot(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._nodes[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for probe in range(1, self._probes):
            if not len(open_):
                break
            at = slot[open_] + probe & self._mask
            found = self._keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self._nodes[at[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        plain = [(p, i) for i, p in enumerate(vocabulary.pieces) if i not in vocabulary.special]
        self._id = {p: i for p, i in plain}
        self._score = {p: vocabulary.scores[i] for p, i in plain}
        self._pieces, self._many = vocabulary.pieces, len(vocabulary.pieces)
        self._bytes = vocabulary.byte_ids
        self._longest = max((len(p) for p in self._id), default=1)
        self._literal = tuple(self._bytes[b] for b in BLANK.encode())
        # Stretches end before a blank that follows another character, if no piece goes across one, ...
        leads = all(BLANK not in p.lstrip(BLANK) for p in self._id)
        # ... and around newlines, if no longer piece has one.
        alone = "" if any("\n" in p for p in self._id if len(p) > 1) else "\n"
        self._stretch = re.compile(f"{alone or '(?!)'}|{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" if leads else "(?s:.+)")
        self._trie = Trie(self._id)
        self._kept: dict[str, tuple[int, ...]] = {}
        self._pair_keys, self._pair_fits = np.full(PAIR_SLOTS, -1, dtype=np.int64), np.zeros(PAIR_SLOTS, dtype=bool)
        self._pair_shift = np.uint64(65 - PAIR_SLOTS.bit_length())
        self._bytes_of = [b"" if i in vocabulary.special else p.replace(BLANK, " ").encode() for i, p in enumerate(vocabulary.pieces)]
        for b, i in enumerate(self._bytes):
            self._bytes_of[i] = bytes([b])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; an empty text has none. A literal blank mark is spelled in bytes, so that decoding gives it back."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """``encode`` of each text; what is new in any of them is searched together."""
        split = [self._split(t) for t in texts]
        wanted = set(chain.from_iterable(chain.from_iterable(split)))
        if len(self._kept) + len(wanted) > KEPT_STRETCHES:
            self._kept = {s: self._kept[s] for s in wanted if s in self._kept}
        known = self._kept
        new = [s for s in wanted if s not in known]
        window = _WINDOWS * self._longest
        known.update(zip(own, self._side_by_side(own)) if (own := [s for s in new if len(s) <= window]) else ())
        passing = {s: tuple(chain.from_iterable(map(self._ids_of, self.path(s)))) for s in new if len(s) > window}
        known.update(passing)
        out = []
        for parts in split:
            ids: list[Iterable[int]] = []
            for k, part in enumerate(parts):
                if k:
                    ids.append(self._literal)
                ids += map(known.__getitem__, part)
            out.append(np.fromiter(chain.from_iterable(ids), dtype=np.int32))
        for s in passing:  # of any length, so they are not kept
            del known[s]
        return out

    def _split(self, text: str) -> list[list[str]]:
        """Stretches of the parts of a text between literal blank marks."""
        if not text:
            return []
        first, *more = text.split(BLANK)
        return [self._stretch.findall(BLANK + first.replace(" ", BLANK)), *[self._stretch.findall(m.replace(" ", BLANK)) for m in more]]

    def _side_by_side(self, stretches: list[str]) -> list[tuple[int, ...]]:
        """Ids of whole stretches, position by position for all of them.

        Each stretch is followed by a mark in one array of code points, so a position is also a node between characters.
        """
        size = np.fromiter(map(len, stretches), dtype=np.int64, count=len(stretches))
        code = np.frombuffer("\0".join([*stretches, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        last_at = np.cumsum(size + 1) - 1  # the mark after each stretch
        code[last_at] = _END
        first_at = last_at - size
        is_first = np.zeros(len(code), dtype=bool)
        is_first[first_at] = True
        local = np.arange(len(code)) - np.repeat(first_at, size + 1)

        # every piece at every position: the walks down the trie that are still going
        begin, node = np.arange(len(code)), np.zeros(len(code), dtype=np.int64)
        begin = begin[code != _END]
        node = node[: len(begin)]
        edges = []
        for length in range(1, self._longest + 1):
            node = self._trie.step(node, code[begin + length - 1])
            going = node >= 0
            if length == 1:  # a character in no piece is one by itself
                alone = begin[~going | (self._trie.piece_of[np.maximum(node, 0)] < 0)]
                edges.append((alone, np.ones(len(alone), dtype=np.int64), self._many + code[alone]))
            begin, node = begin[going], node[going]
            if not len(begin):
                break
            ends = (piece := self._trie.piece_of[node]) >= 0
            edges.append((begin[ends], np.full(int(ends.sum()), length), piece[ends]))
        begin, length, piece = (np.concatenate(x) for x in zip(*edges))
        turn = local[begin] + length
        order = np.lexsort((begin, turn))
        begin, end, piece, turn = begin[order], (begin + length)[order], piece[order], turn[order]
        bounds = np.searchsorted(turn, np.arange(1, int(size.max()) + 2))

        last, back = np.full(len(code), -1, dtype=np.int64), np.zeros(len(code), dtype=np.int64)
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = slice(a, b)
            fits = is_first[begin[own]]
            before = last[begin[own]]
            ask = np.flatnonzero(before >= 0)
            fits[ask] = self._fit(before[ask], piece[own][ask])
            ok = np.flatnonzero(fits) + a
            ok = ok[np.append(True, end[ok[1:]] != end[ok[:-1]])] if len(ok) else ok  # the longest that fits
            last[end[ok]], back[end[ok]] = piece[ok], begin[ok]

        on_path = np.zeros(len(code), dtype=bool)
        at = last_at
        while len(at):
            on_path[at] = True
            at = back[at]
            at = at[~is_first[at]]
        nodes = np.flatnonzero(on_path)
        flat, cuts = last[nodes].tolist(), np.searchsorted(nodes, last_at, side="right").tolist()
        out, start = [], 0
        for stop in cuts:
            ids = flat[start:stop]
            if max(ids) >= self._many:
                ids = chain.from_iterable((i,) if i < self._many else self._ids_of(chr(i - self._many)) for i in ids)
            out.append(tuple(ids))
            start = stop
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """May piece b stand behind piece a? Answers are kept by slot; a new pair takes the slot of an older one."""
        keys = a << _CODE | b
        slot = (keys.astype(np.uint64) * _MULTIPLIER >> self._pair_shift).astype(np.int64)
        out, missed = self._pair_fits[slot], np.flatnonzero(self._pair_keys[slot] != keys)
        if len(missed):
            new, at = np.unique(keys[missed], return_inverse=True)
            text = self._text
            fits = np.array([self._merged(text(k >> _CODE), text(k & _END)) for k in new.tolist()], dtype=bool)
            out[missed] = fits[at]
            into = (new.astype(np.uint64) * _MULTIPLIER >> self._pair_shift).astype(np.int64)
            # two new pairs may share a slot: the key and its answer must come from the same one
            into, one = np.unique(into, return_index=True)
            self._pair_keys[into], self._pair_fits[into] = new[one], fits[one]
        return out

    def _text(self, piece: int) -> str:
        return self._pieces[piece] if piece < self._many else chr(piece - self._many)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become replacement marks."""
        data = b"".join(map(self._bytes_of.__getitem__, ids))
        return data.removeprefix(b" ").decode("utf-8", "replace")

    def _ids_of(self, piece: str) -> Iterable[int]:
        found = self._id.get(piece)
        return (found,) if found is not None else [self._bytes[b] for b in piece.encode()]

    def path(self, chars: str) -> Iterator[str]:
        """Pieces of the best path, as soon as they are certain; a character in no piece is one by itself."""
        known, longest, beside = self._id, self._longest, self._merged
        back: dict[int, int] = {}
        last: dict[int, str] = {0: ""}
        done, check = 0, _WINDOWS * longest
        n = len(chars)
        for end in range(1, n + 1):
            for begin in range(max(done, end - longest), end):
                piece = chars[begin:end]
                if (piece in known or end - begin == 1) and begin in last and (begin == 0 or beside(last[begin], piece)):
                    back[end], last[end] = begin, piece
                    break
            if end == done + check and end < n:
                meeting = self._meeting(back, end, done)
                if meeting > done:
                    yield from self._trace(back, last, done, meeting)
                    for at in range(done, meeting):
                        last.pop(at, None)
                        back.pop(at, None)
                    back.pop(meeting, None)
                    done, check = meeting, _WINDOWS * longest
                else:
                    check += longest
        yield from self._trace(back, last, done, n)

    def _meeting(self, back: dict[int, int], end: int, done: int) -> int:
        """The last boundary that all paths ending in the window have in common."""
        fronts = {at for at in range(end - self._longest + 1, end + 1) if at in back}
        while len(fronts) > 1:
            latest = max(fronts)
            fronts.remove(latest)
            fronts.add(back[latest] if latest > done else done)
        return fronts.pop() if fronts else done

    @staticmethod
    def _trace(back, last, done: int, end: int) -> list[str]:
        pieces = []
        while end > done:
            pieces.append(last[end])
            end = back[end]
        return pieces[::-1]

    def _merged(self, a: str, b: str) -> bool:
        """Do the model's merges leave the two pieces side by side? The best score merges first, then the leftmost."""
        if a + b in self._score:
            return False  # they would merge
        parts, border = list(a + b), len(a)
        none = float("-inf")
        score = self._score.get
        values = [score(x + y, none) for x, y in zip(parts, parts[1:])]  # of merging each part with the next
        left = border  # parts before the border
        while values and (best := max(values)) > none:
            at = values.index(best)
            if at == left - 1:
                return False  # a merge across the border
            left -= at < left
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del values[at]
            if at:
                values[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(values):
                values[at] = score(parts[at] + parts[at + 1], none)
        return parts == [a, b]


def _encoder(key: str, vocabulary) -> Encoder:
    """The encoder of a job; a worker keeps it, with what it has learnt, for its next tasks."""
    return words.kept(key, lambda: Encoder(vocabulary.value))


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", ids: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` with the ids of every whole text as an array; ``check`` names a column that tells whether decoding gives the text back.

    A null text has null ids (and a null check), an empty one an empty array. Rows stay one to one; columns of
    these names are replaced. The vocabulary (a fixed file's pieces) is broadcast.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex
    rest = [c for c in docs.columns if c not in (ids, check)]
    schema = docs.select(*rest)._jdf.schema().toDDL() + f", `{ids}` array<int>" + (f", `{check}` boolean" if check else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, sent)
        for batch in batches:
            for part in words.slices(batch, text, PART):
                bodies = part.column(text).to_pylist()
                found = encoder.encode_all([t or "" for t in bodies])
                gone = np.array([t is None for t in bodies], dtype=bool)
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
                columns = [part.column(c) for c in rest]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(gone, False)), pa.array(flat)))
                if check:
                    columns.append(pa.array([None if t is None else encoder.decode(f.tolist()) == t for t, f in zip(bodies, found)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, [*rest, ids, *([check] if check else [])])

    return docs.select(*rest).mapInArrow(words.lean(run, key), schema)


def decode_ids(rows: DataFrame, vocabulary: Vocabulary, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text of their ids; null ids give a null text. Columns of that name are replaced."""
    sent, key = rows.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex
    rest = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(key, sent)
        for batch in batches:
            yield batch[rest].assign(**{text: [None if v is None else encoder.decode(list(v)) for v in batch[ids]]})

    return rows.select(*rest).mapInPandas(run, rows.select(*rest)._jdf.schema().toDDL() + f", `{text}` string")
