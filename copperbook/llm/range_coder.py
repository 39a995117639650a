"""Context-mixing range coder for token ids, many strands side by side.

A block is coded from a fresh model and knows nothing of other blocks. Its ids
are cut into up to ``LANES`` strands of nearly equal length, which share the
model: one step codes the next id of every strand, as lanes of numpy arrays. The
model learns after some steps, after one at first and then after more, up to
``_STEPS``; in between it stands still, so the encoder, which knows all ids, takes
the shares of all these steps together. All ids are coded; orders 2 and 1 and the
symbols learn from the last ``_LESSON`` of these steps, order 0 from all.

For each id, order 2 (the two ids before) and order 1 (the id before) each
predict an id, with a count of how often that was right of late. The symbols are:
order 2 is right, order 1 is right, neither. Their frequencies are the sum of
three adaptive tables: one chosen by each order's count and one by both; all of
them know whether the orders agree. If neither is right, order 0 gives the id by
adaptive frequencies of all such ids, which begin falling with the number of the
id, as the ids of byte pairs do.

The coder keeps 64 bits and moves 32 at a time. All symbols have sizes out of
``2**_BITS``, all ids out of ``2**_BITS_0``, so that a step needs a shift where
others divide. Carries are noted and added to the words at the end. A block is:
ids, strands, CRC-32 of the ids as little-endian 32-bit integers, words of each
strand, then the 32-bit words of one strand after another. Ids are below 65,536.
"""

import struct
import zlib

import numpy as np

BLOCK = 1 << 22
LANES = 4096
#: A strand has at least so many ids, so that its last words cost little.
_STRAND = 256
_IDS = 1 << 16
_SURE = 8  # an order's count is below this
_SYMBOLS = 3
_BITS, _BITS_0 = 10, 20
_MOST = 1 << 14  # the sum that halves the symbols' tables
_ADD = 16  # what an id adds to order 0
_STEPS, _LESSON = 8, 2
_LEARN_LEAST, _LEARN_MOST = 1 << 10, 1 << 19  # ids between two states of order 0
_SLOTS = 1 << 18  # of order 2
_ROWS = _SURE * _SURE
_HEAD = struct.Struct("<III")

_U = np.uint64
_ALL, _THIRTY_TWO, _LEAST, _MASK32 = _U(_BITS + _BITS_0), _U(32), _U(1 << 32), _U((1 << 32) - 1)
_FIRST = 1 + (1 << 15) // (np.arange(_IDS, dtype=np.int64) + 256)


class _Order0:
    """Frequencies of all ids."""

    def __init__(self, decodes: bool):
        self.decodes, self.count, self.seen, self.next = decodes, _FIRST.copy(), 0, 0
        self.set()

    def see(self, ids: np.ndarray) -> None:
        self.count += np.bincount(ids, minlength=_IDS) * _ADD
        self.seen += len(ids)
        if self.seen >= self.next:
            self.set()

    def set(self) -> None:
        self.next = self.seen + min(max(self.seen // 2, _LEARN_LEAST), _LEARN_MOST)
        size = 1 + self.count * ((1 << _BITS_0) - _IDS) // int(self.count.sum())
        size[size.argmax()] += (1 << _BITS_0) - int(size.sum())
        self.size = size.astype(_U)
        self.start = (size.cumsum() - size).astype(_U)
        if self.decodes:
            self.ids = np.repeat(np.arange(_IDS, dtype=np.uint16), size)


class _Mixer:
    """Sizes of the symbols, by whether the orders agree and their counts."""

    def __init__(self):
        self.shape = (_SYMBOLS, 2, _SURE, _SURE)
        self.rows = 2 * _ROWS
        shapes = ((_SYMBOLS, 2, _SURE, 1), (_SYMBOLS, 2, 1, _SURE), self.shape)
        self.tables = [np.full(shape, 4) for shape in shapes]
        self.set()

    def see(self, chosen: np.ndarray) -> None:
        n = np.bincount(chosen, minlength=_SYMBOLS * self.rows).reshape(self.shape) * 2
        for table, more in zip(self.tables, (n.sum(axis=3, keepdims=True), n.sum(axis=2, keepdims=True), n)):
            table += more
            while (full := table.sum(axis=0) > _MOST).any():
                table[:, full] = (table[:, full] + 1) >> 1
        self.set()

    def set(self) -> None:
        mixed = (self.tables[0] + self.tables[1] + 2 * self.tables[2]).reshape(_SYMBOLS, -1)
        size = 1 + mixed * ((1 << _BITS) - _SYMBOLS) // mixed.sum(axis=0)
        size[2] += (1 << _BITS) - size.sum(axis=0)
        self.size = size.astype(_U)
        self.start = (size.cumsum(axis=0) - size).astype(_U)


class _Model:
    def __init__(self, decodes: bool):
        # per context: the id seen last, then three bits of order 2's and three of order 1's count
        self.last2, self.last1 = np.full(_SLOTS, -_ROWS, np.int32), np.full(_IDS, -_ROWS, np.int32)
        self.order0, self.mixer = _Order0(decodes), _Mixer()

    def look(self, before: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, ...]:
        """What orders 2 and 1 have, and the row of the mixer."""
        seen2 = self.last2.take(_slot(before, earlier), mode="clip")
        seen1 = self.last1.take(before, mode="clip")
        agree = (seen2 ^ seen1).view(np.uint32) < _ROWS
        row = ((seen2 | seen1) & (_ROWS - 1)).astype(np.int64)
        row += agree.view(np.int8) * np.int8(_ROWS)
        return seen2, seen1, row

    def learn(self, before, earlier, value, seen2, seen1, row, symbol) -> None:
        """An id that was right counts one more, to seven; one that was wrong halves a
        count above two before another id takes the place."""
        for last, at, seen, low in ((self.last2, _slot(before, earlier), seen2, 3), (self.last1, before, seen1, 0)):
            count, hit = (seen >> low) & (_SURE - 1), (seen >> 6) == value
            taken = ~hit & (count <= 2)
            count = np.where(hit, np.minimum(count + 1, _SURE - 1), count >> 1)
            count[taken] = 1
            last[at] = (np.where(taken, value, seen >> 6) << 6) + (count << low)
        self.mixer.see(symbol * self.mixer.rows + row)


def _slot(before: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return (before * 40503 + earlier * 30011) & (_SLOTS - 1)


def _spans(lengths: np.ndarray):
    """Steps that are coded between two lessons: from, to, strands that have them.
    Only in the last step some strands can be at their end."""
    full, at = int(lengths[-1]), 0
    while at < full:
        to = min(full, at + min(max(at // 4, 1), _STEPS))
        yield at, to, len(lengths)
        at = to
    if full < lengths[0]:
        yield full, full + 1, int((lengths > full).sum())


def _even(n: int, parts: int) -> np.ndarray:
    return n // parts + (np.arange(parts) < n % parts)


def _strands(n: int) -> np.ndarray:
    return _even(n, min(LANES, -(-n // _STRAND)))


def _settled(words: np.ndarray, moved: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that moved, one strand after another, and how many each strand has.
    A carry adds one to the strand's word before it, and may pass on from there."""
    moved, carried = np.ascontiguousarray(moved.T), np.ascontiguousarray(carried.T)
    flat = words.T[moved].astype(_U)
    over = np.flatnonzero(carried)
    if len(over):
        before = moved.reshape(-1).cumsum(dtype=np.int32)[over] - moved.reshape(-1)[over]
        flat[before - 1] += _U(1)
    while len(over := np.flatnonzero(flat > _MASK32)):
        flat[over] &= _MASK32
        flat[over - 1] += _U(1)
    return flat.astype("<u4"), moved.sum(axis=1)


def _encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all strands, one strand after another, and how many each has."""
    lengths = _strands(len(ids))
    steps, lanes = int(lengths[0]), len(lengths)
    grid = np.zeros((lanes, steps), np.int32)
    grid[np.arange(steps) < lengths[:, None]] = ids
    padded = np.zeros((steps + 2, lanes), np.int32)
    padded[2:] = grid.T
    model = _Model(False)
    low, wide = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    words = np.zeros((steps + 1, lanes), np.uint32)
    moved, carried = np.zeros((steps + 1, lanes), bool), np.zeros((steps + 1, lanes), bool)
    for at, to, live in _spans(lengths):
        earlier, before, value = (padded[at + k : to + k, :live].astype(np.int64).ravel() for k in range(3))
        seen2, seen1, row = model.look(before, earlier)
        symbol = np.where((seen2 >> 6) == value, 0, np.where((seen1 >> 6) == value, 1, 2))
        chosen, new = symbol * model.mixer.rows + row, np.flatnonzero(symbol == 2)
        new_ids = value.take(new, mode="clip")
        size = model.mixer.size.reshape(-1).take(chosen, mode="clip")
        start = model.mixer.start.reshape(-1).take(chosen, mode="clip") << _U(_BITS_0)
        part = size << _U(_BITS_0)
        size = size.take(new, mode="clip")
        start[new] += size * model.order0.start.take(new_ids, mode="clip")
        part[new] = size * model.order0.size.take(new_ids, mode="clip")
        start, part = start.reshape(to - at, live), part.reshape(to - at, live)
        low_, wide_ = low[:live], wide[:live]
        for k in range(to - at):
            unit = wide_ >> _ALL
            by = unit * start[k]
            low_ += by
            np.less(low_, by, out=carried[at + k, :live])
            np.multiply(unit, part[k], out=wide_)
            go = np.less(wide_, _LEAST, out=moved[at + k, :live])
            words[at + k, :live] = low_ >> _THIRTY_TWO
            shift = go.astype(_U) << _U(5)
            low_ <<= shift
            wide_ <<= shift
        lesson = slice(-_LESSON * live, None)
        model.learn(*(x[lesson] for x in (before, earlier, value, seen2, seen1, row, symbol)))
        model.order0.see(new_ids)
    # a word ends each strand; the bits after it may be any
    last = (low + _MASK32) & ~_MASK32
    carried[steps], moved[steps], words[steps] = last < low, True, last >> _THIRTY_TWO
    return _settled(words, moved, carried)


def _decode_block(n: int, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    lengths = _strands(n)
    steps, lanes = int(lengths[0]), len(lengths)
    # a word of zeros follows each strand
    flat = np.zeros(len(words) + lanes + 1, _U)
    at_ = np.cumsum(sizes + 1) - sizes - 1
    flat[np.arange(len(words)) + np.repeat(np.arange(lanes), sizes)] = words
    code, wide = (flat[at_] << _THIRTY_TWO) | flat[at_ + 1], np.full(lanes, (1 << 64) - 1, _U)
    at_ += 2
    padded = np.zeros((steps + 2, lanes), np.int64)
    model = _Model(True)
    for at, to, live in _spans(lengths):
        lesson, fresh = [], []
        code_, wide_ = code[:live], wide[:live]
        mixer, order0 = model.mixer, model.order0
        ends0, ends1 = (mixer.start[k] << _U(_BITS_0) for k in (1, 2))
        for k in range(at, to):
            earlier, before = padded[k, :live], padded[k + 1, :live]
            seen2, seen1, row = model.look(before, earlier)
            unit = wide_ >> _ALL
            end0, end1 = unit * ends0.take(row, mode="clip"), unit * ends1.take(row, mode="clip")
            past0, past1 = code_ >= end0, code_ >= end1
            value = padded[k + 2, :live]
            value[:] = np.where(past0, seen1, seen2) >> 6
            wide_[:] = np.where(past0, end1 - end0, end0)
            new = np.flatnonzero(past1)
            size = (unit * mixer.size[2].take(row, mode="clip")).take(new, mode="clip")
            inside = (code_ - end1).take(new, mode="clip")
            code_ -= end0 * past0
            ids = order0.ids.take((inside // size).astype(np.int64), mode="clip").astype(np.int64)
            code_[new] = inside - size * order0.start.take(ids, mode="clip")
            wide_[new] = size * order0.size.take(ids, mode="clip")
            value[new] = ids
            fresh.append(ids)
            if k >= to - _LESSON:
                lesson.append((before, earlier, value, seen2, seen1, row, past0.astype(np.int64) + past1))
            go = np.flatnonzero(wide_ < _LEAST)
            place = at_.take(go, mode="clip")
            code_[go] = (code_.take(go, mode="clip") << _THIRTY_TWO) | flat.take(place, mode="clip")
            wide_[go] <<= _THIRTY_TWO
            at_[go] = place + 1
        model.learn(*map(np.concatenate, zip(*lesson)))
        model.order0.see(np.concatenate(fresh))
    return padded[2:].T[np.arange(steps) < lengths[:, None]].astype("<u4")


def encode(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """Blocks of nearly equal length; no ids give no block."""
    out, at = [], 0
    for n in _even(len(ids), -(-len(ids) // block)).tolist() if len(ids) else []:
        mine = np.asarray(ids[at : at + n], "<u4")
        words, sizes = _encode_block(mine)
        head = _HEAD.pack(n, len(sizes), zlib.crc32(mine.tobytes()))
        out.append(b"".join([head, sizes.astype("<u4").tobytes(), words.tobytes()]))
        at += n
    return out


def decode(data: bytes) -> np.ndarray:
    """All ids of blocks written one after another; a damaged block is an error."""
    found, at = [], 0
    while at < len(data):
        if len(data) < at + _HEAD.size:
            raise ValueError("a block is cut short")
        n, of, check = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        if not n or of != len(_strands(n)) or len(data) < at + 4 * of:
            raise ValueError("a block is damaged or cut short")
        sizes = np.frombuffer(data, "<u4", of, at).astype(np.int64)
        at += 4 * of
        if not sizes.all() or len(data) < at + 4 * int(sizes.sum()):
            raise ValueError("a block is damaged or cut short")
        ids = _decode_block(n, sizes, np.frombuffer(data, "<u4", int(sizes.sum()), at))
        at += 4 * int(sizes.sum())
        if zlib.crc32(ids.tobytes()) != check:
            raise ValueError(f"block {len(found)} is damaged")
        found.append(ids)
    return np.concatenate(found) if found else np.zeros(0, np.uint32)
