"""Fingerprints against plain integers, and texts made to collide modulo powers of two."""

from __future__ import annotations

import numpy as np

from tarn.llm.rolling import PIECE_BASES, PRIME, WORD_BASES, Words, run_fingerprints, times

P = int(PRIME)


def thue_morse(size: int, swap: bool = False) -> str:
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(size))


def plain(word: bytes, base: int) -> int:
    out = len(word)
    for k in range(0, len(word), 7):
        out = (out * base + int.from_bytes(word[k : k + 7], "little")) % P
    return out


def test_products_match_integers():
    pick = np.random.default_rng(1)
    a = np.concatenate((pick.integers(0, P, 500, np.uint64), np.array([0, 1, P - 1], np.uint64)))
    for b in (0, 1, 2, P - 1, WORD_BASES[0]):
        assert times(a, b).tolist() == [int(x) * b % P for x in a]


def test_words_and_runs_match_integers():
    found = [b"a", b"Abc", b"x" * 7, b"y" * 8, "é日本語".encode() * 9, b"z" * 5_000, b"A" * 113, b"\0", b"\0\0"]
    data = np.frombuffer(b" ".join(found), np.uint8)
    words = Words(data, np.array([0, len(data)]))
    for lane in (0, 1):
        values = words.fingerprints(data, lane=lane)
        assert values.tolist() == [plain(w, PIECE_BASES[lane]) for w in found]
        assert words.fingerprints(data, fold=True, lane=lane).tolist() == [plain(w.lower(), PIECE_BASES[lane]) for w in found]
        assert words.fingerprints(data, lane=lane, most=4).tolist() == [plain(w[:4], PIECE_BASES[lane]) for w in found]
        for width in (1, 2, 3, 5, 8, 9, 10):
            got = run_fingerprints(values, width, lane).tolist()
            expected = []
            for i in range(len(values) - width + 1):
                out = 0
                for v in values[i : i + width].tolist():
                    out = (out * WORD_BASES[lane] + v) % P
                expected.append(out)
            assert got == expected


def test_words_that_collide_modulo_powers_of_two_differ():
    for size in (512, 1024, 2048, 4096):
        data = np.frombuffer(f"{thue_morse(size)} {thue_morse(size, True)}".encode(), np.uint8)
        one, two = Words(data, np.array([0, len(data)])).hashes(data)
        assert one != two
