"""Which file is which between two looks: name, inode and birth, and a chain of block digests.

A followed file is known by its inode with the time it was made, and by what was read of it so far. That
content is a chain of digests: blocks 0, 1, 3, 7, ... of ``BLOCK`` bytes, and the last block that ends
at the read position. It grows with the logarithm of the file, is extended by reading new blocks only, and
agrees with another file's bytes only if that file holds the same past right up to the read position.

``decide`` answers for one entry and one file that stands somewhere now:

* ``SAME``: the same inode, born at the same time, not shorter than what was read, ending there in the same block;
* ``COPY``: another inode with the whole chain. Log tools copy a log aside and truncate it, so the copy's
  name extends the log's. A name that tells nothing needs a past longer than any banner: ``BANNER`` bytes;
* ``NEW``: all else. A new file under the log's own name that begins like the old one is new, and
  is read from its first byte, unless it repeats more than ``BANNER`` bytes of it.

A file cut short in place and rewritten between two looks with the very bytes that were read, then more,
cannot be told from one that grew; it counts as grown.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import struct
from functools import cache

BLOCK = 1 << 16
BANNER = 1 << 16
SAME, COPY, NEW = "same", "copy", "new"

_STATX_BTIME = 0x800
_AT_FDCWD = -100


@cache
def _statx():
    try:
        return ctypes.CDLL(None, use_errno=True).statx
    except (AttributeError, OSError):
        return None


def birth(path: str) -> str:
    """Time the file was made, where the system tells; inodes are used again, times are not."""
    st = os.stat(path)
    if hasattr(st, "st_birthtime_ns"):
        return str(st.st_birthtime_ns)
    call = _statx()
    if call is None:
        return ""
    buf = ctypes.create_string_buffer(256)
    if call(_AT_FDCWD, os.fsencode(path), 0, _STATX_BTIME, buf) or not struct.unpack_from("I", buf, 0)[0] & _STATX_BTIME:
        return ""
    seconds, nanos = struct.unpack_from("qI", buf, 80)
    return f"{seconds}.{nanos}"


def look(path: str) -> dict | None:
    """``id`` (device, inode, birth), ``size`` and ``mtime`` of a regular file, None when it is not there."""
    try:
        st = os.stat(path)
        if not os.path.isfile(path):
            return None
        return {"id": f"{st.st_dev}:{st.st_ino}:{birth(path)}", "size": st.st_size, "mtime": st.st_mtime_ns}
    except OSError:
        return None


def _digest(path: str, start: int, end: int) -> str | None:
    """Digest of the bytes ``[start, end)``; None when they are not all there."""
    try:
        with open(path, "rb") as f:
            f.seek(start)
            data = f.read(end - start)
    except OSError:
        return None
    return hashlib.blake2b(data, digest_size=8).hexdigest() if len(data) == end - start else None


def _marks(pos: int) -> list[int]:
    """Numbers of the chain's whole blocks below ``pos``: 0, 1, 3, 7, ..."""
    return [(1 << i) - 1 for i in range(64) if ((1 << i) * BLOCK) <= pos]


def extend(chain: dict, path: str, pos: int) -> dict:
    """The chain up to ``pos``, reading only blocks it does not have."""
    blocks = dict(chain.get("blocks", {}))
    for k in _marks(pos):
        if str(k) not in blocks:
            blocks[str(k)] = _digest(path, k * BLOCK, (k + 1) * BLOCK)
    return {"pos": pos, "blocks": blocks, "last": _digest(path, max(0, pos - BLOCK), pos)}


def ends_alike(chain: dict, path: str) -> bool:
    """Whether the file has the chain's last block where the chain has it."""
    pos = chain["pos"]
    return _digest(path, max(0, pos - BLOCK), pos) == chain["last"]


def holds(chain: dict, path: str) -> bool:
    """Whether the file begins with all the chain's bytes, as far as its digests tell."""
    return ends_alike(chain, path) and all(_digest(path, int(k) * BLOCK, (int(k) + 1) * BLOCK) == d for k, d in chain["blocks"].items())


def decide(entry: dict, path: str, seen: dict) -> str:
    """``SAME``, ``COPY`` or ``NEW``: what the file ``path`` (with ``look`` ``seen``) is to a followed entry."""
    chain = entry["chain"]
    if seen["id"] == entry["id"]:
        if seen["size"] == entry["size"] and seen["mtime"] == entry["mtime"]:
            return SAME  # untouched since the last look: nothing is read
        return SAME if seen["size"] >= chain["pos"] and ends_alike(chain, path) else NEW
    if not 0 < chain["pos"] <= seen["size"]:
        return NEW
    name = os.path.basename(entry["name"])
    here = os.path.basename(path)
    aside = path != entry["name"] and here.startswith(name)
    return COPY if (aside or chain["pos"] >= BANNER) and holds(chain, path) else NEW
