"""Hashed words and character n-grams, for many words at once."""

from __future__ import annotations

import zlib

import numpy as np


def subword_hashes(words: list[bytes], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, 32-bit hash) of every word and of its n-grams of bytes, borders marked.

    The whole word is a feature of its own beside its n-grams; a word shorter
    than a size has none of that size.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    text = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(text))
    owners = [np.arange(len(words))]
    hashes = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
    for size in sizes:
        if size > len(text):
            continue
        value = np.full(len(text) - size + 1, size, np.uint32)
        for i in range(size):
            value = value * np.uint32(16777619) + text[i : len(text) - size + 1 + i] + np.uint32(1)
        value ^= value >> np.uint32(15)
        value = value * np.uint32(0x2C1B3C6D)
        value ^= value >> np.uint32(13)
        fits = place[: len(value)] + size <= ends[owner[: len(value)]]
        owners.append(owner[: len(value)][fits])
        hashes.append(value[fits])
    return np.concatenate(owners), np.concatenate(hashes)
