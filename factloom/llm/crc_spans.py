"""CRC-32 of many spans of a byte buffer at once, by a table of each byte value's contribution at each distance from the end.

CRC-32 is linear over XOR but for a constant of the length: a span's value is the XOR of what its
bytes contribute and of the CRC of as many zero bytes. Spans longer than the table are cut into
blocks from their end, and the blocks' values are folded pairwise.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 64


def _one_byte() -> np.ndarray:
    """What each byte value leaves behind when it is the last byte."""
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = (values >> 1) ^ np.where(values & 1, np.uint32(0xEDB88320), np.uint32(0))
    return values


LAST = _one_byte()


def _distances() -> np.ndarray:
    """[distance from the end, byte value] -> contribution."""
    rows = [LAST]
    for _ in range(BLOCK - 1):
        rows.append((rows[-1] >> 8) ^ LAST[rows[-1] & 0xFF])
    return np.stack(rows)


TABLE = _distances()
#: CRCs of 0 to BLOCK zero bytes.
ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], dtype=np.uint32)


def advance(operator: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``values`` after the zero bytes that ``operator`` (4 tables, one a byte of the value) stands for."""
    return operator[0][values & 0xFF] ^ operator[1][(values >> 8) & 0xFF] ^ operator[2][(values >> 16) & 0xFF] ^ operator[3][values >> 24]


def _block_operator() -> np.ndarray:
    """The operator of BLOCK zero bytes."""
    values = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)])
    for _ in range(BLOCK):
        values = (values >> 8) ^ LAST[values & 0xFF]
    return values


OPERATOR = _block_operator()


def _disjoint(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Contributions of spans of 1 to BLOCK bytes, by one gather and ``reduceat``."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)
    distance = np.repeat(starts + lengths - 1, lengths) - at
    return np.bitwise_xor.reduceat(TABLE.reshape(-1)[distance * 256 + buffer[at]], ends - lengths)


def crc32_spans(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 (uint32) of each span of ``buffer`` (uint8); spans may overlap, empty ones give 0."""
    out = np.zeros(len(starts), dtype=np.uint32)
    short = np.flatnonzero((lengths > 0) & (lengths <= BLOCK))
    out[short] = _disjoint(buffer, starts[short], lengths[short]) ^ ZEROS[lengths[short]]
    long = np.flatnonzero(lengths > BLOCK)
    if len(long):
        s, n = starts[long], lengths[long]
        blocks = -(-n // BLOCK)
        first = np.cumsum(blocks) - blocks
        turn = np.arange(blocks.sum()) - np.repeat(first, blocks)
        head = n - (blocks - 1) * BLOCK
        size = np.where(turn == 0, np.repeat(head, blocks), BLOCK)
        begin = np.repeat(s, blocks) + np.where(turn == 0, 0, np.repeat(head, blocks) + (turn - 1) * BLOCK)
        values, operator = _disjoint(buffer, begin, size), OPERATOR
        while (blocks > 1).any():
            odd = blocks % 2 == 1
            values = np.insert(values, (np.cumsum(blocks) - blocks)[odd], np.uint32(0))  # a block of zeros in front adds nothing
            values = advance(operator, values[0::2]) ^ values[1::2]
            blocks = (blocks + 1) // 2
            operator = np.stack([advance(operator, part) for part in operator])
        sizes, which = np.unique(n, return_inverse=True)
        out[long] = values ^ np.array([zlib.crc32(bytes(int(m))) for m in sizes], dtype=np.uint32)[which]
    return out
