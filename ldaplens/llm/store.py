"""Files that tasks write to, and read from, the shared folder."""

from __future__ import annotations

import re
import uuid


def opened(uri: str):
    """``(filesystem, path)`` of a folder or file named by a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def publish(uri: str, write) -> None:
    """Call ``write(stream)`` on a file of its own, then move it to ``uri``: a task that is run
    again, or twice at a time, leaves one whole file."""
    place, path = opened(uri)
    place.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with place.open_output_stream(own, compression=None) as out:
        write(out)
    place.move(own, path)
