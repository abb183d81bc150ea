"""Appending to one file batch by batch, so that each batch is in it once."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from typing import IO


@contextmanager
def appending(path: str | os.PathLike, batch: int, header: str = "") -> Iterator[IO[str]]:
    """The file opened for the text of a micro-batch, ``header`` first in a new file.

    A note beside the file (``path`` + ``.batch``) holds the number of the last batch and the length
    of the file before it, and is replaced before the batch is written: a batch that comes again,
    after a failure in its midst, is cut off first, and a restart goes on behind all earlier batches.
    Batch 0 belongs to a new checkpoint and starts a new file.
    """
    path, note = os.fspath(path), os.fspath(path) + ".batch"
    before = os.path.getsize(path) if os.path.exists(path) else 0
    if batch == 0:
        before = 0
    elif os.path.exists(note):
        with open(note, encoding="ascii") as f:
            last, length = map(int, f.read().split())
        if last == batch:
            before = min(before, length)
    with open(note + ".new", "w", encoding="ascii") as f:
        f.write(f"{batch} {before}")
    os.replace(note + ".new", note)
    with open(path, "a", encoding="utf-8", newline="") as f:
        f.truncate(before)
        if not before:
            f.write(header)
        yield f
