"""Jump-ahead for the Mersenne Twister that Python's random uses, so that tasks can each draw a part of one sequence of words.

A step of the generator is linear over GF(2), so a state J steps on is a fixed combination of the next 19,937 states: that of x^J modulo the
generator's characteristic polynomial. The polynomial is found from the generator's own bits by Berlekamp and Massey's method, once a process.
Polynomials are whole numbers whose bits are coefficients.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np

#: Fixed values of the generator: words of its state, and bits of it that matter.
WORDS, DEGREE = 624, 19_937


def seeded(seed: int) -> np.ndarray:
    """The state of random.Random(seed) before its first word."""
    *key, at = random.Random(seed).getstate()[1]
    if at != WORDS:
        raise ValueError("this generator has given words already")
    return np.array(key, np.uint32)


def generator(state: np.ndarray) -> np.random.Generator:
    """numpy's generator, which gives the words that follow state."""
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": state, "pos": WORDS}}
    return np.random.Generator(out)


def _raw(state: np.ndarray, n: int) -> np.ndarray:
    """The states' words from state on, n at least, before they are tempered."""
    made, parts = np.random.MT19937(), [state]
    made.state = {"bit_generator": "MT19937", "state": {"key": state, "pos": WORDS}}
    while WORDS * len(parts) < n:
        made.random_raw(WORDS)
        parts.append(made.state["state"]["key"].copy())
    return np.concatenate(parts)


@cache
def characteristic() -> int:
    """The polynomial that every bit of the sequence obeys."""
    bits = (_raw(seeded(1), 2 * DEGREE + 2 * WORDS)[WORDS : WORDS + 2 * DEGREE + 64] >> np.uint32(31)).tolist()
    c, b, length, since, window = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        window = window << 1 | bit  # bit i of the window is the sequence's n - i
        if (c & window).bit_count() & 1:
            before = c
            c ^= b << since
            if 2 * length <= n:
                length, b, since = n + 1 - length, before, 0
        since += 1
        window &= (1 << DEGREE + 1) - 1
    if length != DEGREE:
        raise ArithmeticError("the sequence's polynomial has another degree")
    return int(bin(c)[2:].zfill(DEGREE + 1)[::-1], 2)  # c is in powers of the inverse


def _reduced(a: int) -> int:
    terms = [i for i, x in enumerate(reversed(bin(characteristic())[2:])) if x == "1" and i < DEGREE]
    while high := a >> DEGREE:
        a &= (1 << DEGREE) - 1
        for i in terms:
            a ^= high << i
    return a


def power(n: int) -> int:
    """x^n modulo the characteristic polynomial."""
    out = 1
    for bit in bin(n)[2:]:
        out = _reduced(int("0".join(bin(out)[2:]), 2) << int(bit))  # a square has the bits of its root with zeros between them
    return out


def jumped(state: np.ndarray, words: int) -> np.ndarray:
    """The state after so many words."""
    if words < 4 * DEGREE:
        return _raw(state, words + WORDS)[words : words + WORDS]
    taken = np.flatnonzero(np.array(list(reversed(bin(power(words))[2:]))) == "1")
    raw = _raw(state, DEGREE + WORDS)
    out = np.zeros(WORDS, np.uint32)
    for some in np.array_split(taken, 1 + len(taken) // 512):
        out ^= np.bitwise_xor.reduce(raw[some[:, None] + np.arange(WORDS)], axis=0)
    return out
