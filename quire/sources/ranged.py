"""Byte sources that are read where they are asked: bytes at hand, or a file by seeking in blocks."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Iterator

from quire.session import open_fs


class Held:
    """Bytes at hand."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def read(self, at: int, size: int) -> bytes:
        return self.data[max(0, at) : max(0, at + size)]

    def close(self) -> None:
        pass


class Ranged:
    """A file of any file system that Arrow knows, read by seeking; of it, `blocks` blocks are held at most."""

    def __init__(self, path: str, block: int = 1 << 16, blocks: int = 64) -> None:
        fs, plain = open_fs(path)
        self.file = fs.open_input_file(plain)
        self.size, self.block, self.blocks = self.file.size(), block, blocks
        self.held: OrderedDict[int, bytes] = OrderedDict()
        self.bytes_read = 0

    def _block(self, number: int) -> bytes:
        if number in self.held:
            self.held.move_to_end(number)
            return self.held[number]
        data = self._fetch(number * self.block, self.block)
        self.held[number] = data
        if len(self.held) > self.blocks:
            self.held.popitem(last=False)
        return data

    def _fetch(self, at: int, size: int) -> bytes:
        data = self.file.read_at(max(0, min(size, self.size - at)), at)
        self.bytes_read += len(data)
        return data

    def read(self, at: int, size: int) -> bytes:
        at, end = max(0, at), min(at + size, self.size)
        if end <= at:
            return b""
        if end - at > self.block * self.blocks // 2:
            return self._fetch(at, end - at)  # a great stream goes around the blocks
        first, last = at // self.block, (end - 1) // self.block
        data = b"".join([self._block(n) for n in range(first, last + 1)])
        return data[at - first * self.block : end - first * self.block]

    def close(self) -> None:
        self.file.close()


Source = Held | Ranged


def opened(path: str) -> Source:
    """The file at path: its bytes if they are no more than a block, which any look at it would read, else by seeking."""
    source = Ranged(path)
    if source.size > source.block:
        return source
    try:
        return Held(source.read(0, source.size))
    finally:
        source.close()

#: Bytes of one piece when a source is searched from end to end, and by how much pieces overlap.
_PIECE, _OVERLAP = 1 << 22, 1 << 8


def find(source: Source, what: bytes, at: int) -> int:
    """The first place of what from at on, -1 if there is none."""
    while at < source.size:
        place = source.read(at, _PIECE + len(what) - 1).find(what)
        if place >= 0:
            return at + place
        at += _PIECE
    return -1


def rfind(source: Source, what: bytes) -> int:
    """The last place of what, sought from the end in growing pieces."""
    end, piece = source.size, 1 << 12
    while end > 0:
        begin = max(0, end - piece)
        place = source.read(begin, end - begin + len(what) - 1).rfind(what)
        if place >= 0:
            return begin + place
        end, piece = begin, min(_PIECE, 4 * piece)
    return -1


def matches(source: Source, pattern: re.Pattern[bytes]) -> Iterator[tuple[int, re.Match[bytes]]]:
    """The matches of a pattern (shorter than the overlap) over the whole source, with the place of each."""
    at, done = 0, 0
    while at < source.size:
        before = min(at, 1)  # for a look behind
        data = source.read(at - before, _PIECE + _OVERLAP + before)
        for m in pattern.finditer(data, before):
            place = at - before + m.start()
            if place >= at + _PIECE:
                break
            if place >= done:
                done = at - before + m.end()
                yield place, m
        at += _PIECE


def windowed(source: Source, at: int, parse: Callable[[bytes, bool], tuple[object, int]], size: int = 1 << 13) -> tuple[object, int]:
    """parse(window from at on, whether it is the last bytes) as (value, bytes used), over windows that grow until the value ends well within one."""
    while True:
        data = source.read(at, size)
        last = at + size >= source.size
        try:
            value, used = parse(data, last)
        except Exception:
            if last:
                raise
        else:
            if last or used + 64 <= len(data):
                return value, used
        size *= 8
