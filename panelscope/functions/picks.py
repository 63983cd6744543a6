"""Hashed draws of whole slots at once: MD5 of short texts that differ in two numbers only, by numpy."""

from __future__ import annotations

import math

import numpy as np

_ROTATE = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(t + 1)) * 2**32) & 0xFFFFFFFF for t in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts hashed side by side; seven arrays of them stay in a core's cache.
TILE = 32768
#: Shifts as arrays without dimension, which numpy need not make anew for each call.
_SHIFT = [np.array(s, np.uint32) for s in range(32)]


def rooms(shape: tuple[int, int]) -> list[np.ndarray]:
    """The arrays that the hashing of a tile works in, to be used again for the next one: made anew
    for each tile, their memory would go back to the system and come again page by page."""
    return [np.empty(shape, np.uint32) for _ in range(7)]


def _compress(state: list[np.ndarray], words: list[tuple], shape: tuple[int, int], last: bool, tile: list[np.ndarray]) -> list[np.ndarray]:
    """The state after one block of 16 words; of the ``last`` block its first number alone.

    A word is a constant and, where not None, a part of the draw (a column) and one of the slot (a
    row). Numbers are small until the first slot comes in; then the arrays of the ``tile`` are used."""
    a, b, c, d = state
    full = any(x.shape == shape for x in state)
    room: list = [None] * 7
    x = None
    for step in range(61 if last else 64):  # what the last three make is not in the first number
        turn, g = step // 16, (step, 5 * step + 1, 3 * step + 5, 7 * step)[step // 16] % 16
        const, *parts = words[g]
        full = full or parts[1] is not None
        if full and room[0] is None:
            room = tile
        f, t = room[4:6]
        if turn == 0:
            f = np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f), d, out=f)
        elif turn == 1:
            f = np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f), c, out=f)
        elif turn == 3:
            f = np.bitwise_xor(np.bitwise_or(np.invert(d, out=f), b, out=f), c, out=f)
        elif step % 2 == 0:
            x = np.bitwise_xor(b, c, out=room[6])
            f = np.bitwise_xor(x, d, out=f)
        else:  # c and d are what b and c were
            f = np.bitwise_xor(b, x, out=f)
        f = np.add(f, a, out=room[4])
        number = np.array((const + _SINES[step]) & 0xFFFFFFFF, np.uint32)
        for part in parts:
            if part is not None:  # the constant goes in with the first of them
                f = np.add(f, part if number is None else part + number, out=room[4])
                number = None
        if number is not None:
            f = np.add(f, number, out=room[4])
        s = _ROTATE[turn][step % 4]
        t = np.left_shift(f, _SHIFT[s], out=t)
        f = np.bitwise_or(np.right_shift(f, _SHIFT[32 - s], out=room[4]), t, out=room[4])
        # the new b lies where a did
        a, b, c, d = d, np.add(f, b, out=room[step % 4]), b, c
    return [np.add(b, state[0], out=room[4])] if last else [y + s for y, s in zip((a, b, c, d), state, strict=True)]


def _digits(numbers: np.ndarray, at: int) -> dict[int, np.ndarray]:
    """What the digits of the numbers add to the words, if their text begins at byte ``at``."""
    found: dict[int, np.ndarray] = {}
    length = len(str(int(numbers.flat[0])))
    for p in range(length):
        word, byte = divmod(at + p, 4)
        digit = (numbers // 10 ** (length - 1 - p) % 10 + 48).astype(np.uint32) << np.uint32(8 * byte)
        found[word] = found[word] + digit if word in found else digit
    return found


def first_words(prefix: bytes, draws: np.ndarray, slots: np.ndarray, known: dict[int, np.ndarray] | None = None, tile: list[np.ndarray] | None = None) -> np.ndarray:
    """The first 8 hex digits of ``md5(prefix|draw|slot)`` as numbers, for every draw (rows) and slot.
    All draws, and all slots, have the same number of digits. ``known``: ``slot_words`` of the slots;
    ``tile``: ``rooms`` of this shape, one of which the result lies in."""
    wide, tall = len(str(int(slots[0]))), len(str(int(draws[0])))
    text = prefix + b"|" + bytes(tall) + b"|" + bytes(wide)
    consts = np.frombuffer(text + b"\x80" + bytes((55 - len(text)) % 64) + (8 * len(text)).to_bytes(8, "little"), "<u4").tolist()
    across = _digits(draws.astype(np.int64)[:, None], len(prefix) + 1)
    down = slot_words(prefix, tall, slots) if known is None else known
    words = [(k, across.get(w), down.get(w)) for w, k in enumerate(consts)]
    state = [np.full((1, 1), s, np.uint32) for s in _START]
    shape = (len(draws), len(slots))
    tile = rooms(shape) if tile is None else tile
    for block in range(0, len(words), 16):
        state = _compress(state, words[block : block + 16], shape, block + 16 == len(words), tile)
    return state[0].byteswap(inplace=True)


def slot_words(prefix: bytes, tall: int, slots: np.ndarray) -> dict[int, np.ndarray]:
    """What the slots' digits add to the words, behind draws of ``tall`` digits."""
    return _digits(slots.astype(np.int64)[None, :], len(prefix) + 2 + tall)


def _same_length(lo: int, hi: int):
    """The range from lo up to hi - 1, cut where the number of digits changes."""
    while lo < hi:
        top = min(hi, 10 ** len(str(lo)))
        yield lo, top
        lo = top


def drawn_sums(prefix: bytes, first: int, last: int, n: int, base: int, columns: list[np.ndarray]) -> np.ndarray:
    """(columns, draws): for the draws ``first`` to ``last``, the sum of each column over the numbers
    that the slots 0 to n - 1 take; number k is entry k - base of the columns, and numbers outside
    them add nothing."""
    size = len(columns[0])
    out = np.zeros((len(columns), last - first + 1))
    for a, b in _same_length(first, last + 1):
        for lo, hi in _same_length(0, n):
            wide = -(-(hi - lo) // -(-(hi - lo) // TILE))
            tall = max(1, TILE // wide)
            for s in range(lo, hi, wide):
                slots = np.arange(s, min(s + wide, hi))
                known, tile = slot_words(prefix, len(str(a)), slots), None
                for x in range(a, b, tall):
                    y = min(x + tall, b)
                    shape = (y - x, len(slots))
                    if tile is None or tile[0].shape != shape:
                        tile, at, sums = rooms(shape), np.empty(shape, np.intp), np.empty(shape)
                    taken = first_words(prefix, np.arange(x, y), slots, known, tile)
                    np.remainder(taken, np.uint32(n), out=at, casting="unsafe")
                    if size == n:
                        for k, c in enumerate(columns):
                            out[k, x - first : y - first] += c.take(at, out=sums, mode="clip").sum(axis=1)
                    else:
                        at -= base
                        here = (at >= 0) & (at < size)
                        at[~here] = 0
                        for k, c in enumerate(columns):
                            out[k, x - first : y - first] += np.where(here, c.take(at), 0.0).sum(axis=1)
    return out
