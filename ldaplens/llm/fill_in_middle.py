"""Operator 12: fill-in-middle transformation by secondary-sort assembly.

A map pass cuts every text into prefix, middle and suffix and emits them as pieces of whole units
(lines; a unit longer than a piece is cut), keyed by document and place in the output. One shuffle by
document with a sort inside each partition brings the pieces in output order past a streaming digest,
so a document is never held as a whole there, however long it is. The same pass splits the output again
at its marks, which with the form is all it takes, and emits the parts keyed by their place in the text;
sorted once more inside the same partitions, without a second shuffle, they stream into the digest of
the restored text.

A document is named by its id and the digest of its text. Rows that agree in both are told apart by
nothing, so a task sends their pieces once with a number of copies, and a document that a third of all
rows repeat costs the shuffle no more than a few pieces a task.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from ldaplens.llm import common

SEED = 7
PLAIN_FROM, SPM_BELOW = 100, 50  # percent: plain from the first on (none), spm below the second
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle"), "plain": ("prefix",)}
PLACE = {"prefix": 0, "middle": 1, "suffix": 2}  # of the parts in the text
PIECE = 16_384  # characters
MEMO = 50_000  # documents a map task remembers to have sent

KEY = "doc_id long, digest binary, "
FACTS = "copies long, n long, form string, prefix_chars long, middle_chars long"
PIECES = KEY + "pos int, " + FACTS + ", piece string"
RESTORED = KEY + "pos int, seq int, " + FACTS + ", output_sha256 string, piece string"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def plan(doc_id, text: str) -> tuple[str, int, dict[str, str]]:
    """Form, number of units and the parts of one text; plain texts are all prefix."""
    n = text.count("\n") + (text != "" and text[-1] != "\n")
    h = sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in MARKS.values()) or h3 % 100 >= PLAIN_FROM:
        return "plain", n, {"prefix": text}
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    at, cuts, done = 0, [], 0
    for units in (first, second):
        for _ in range(units - done):
            at = text.find("\n", at) + 1 or len(text)
        done = units
        cuts.append(at)
    a, b = cuts
    return "spm" if h4 % 100 < SPM_BELOW else "psm", n, {"prefix": text[:a], "middle": text[a:b], "suffix": text[b:]}


def pieces_of(part: str) -> Iterator[str]:
    """A part in pieces of whole units, up to ``PIECE`` characters; a longer unit is cut."""
    at = 0
    while at < len(part):
        end = at + PIECE
        if end < len(part):
            unit = part.rfind("\n", at, end) + 1
            end = unit if unit > at else end
        yield part[at:end]
        at = end


def output_pieces(form: str, parts: dict[str, str]) -> Iterator[str]:
    """The output in order; a part's mark goes before its pieces."""
    for name in ORDER[form]:
        if form != "plain":
            yield MARKS[name]
        yield from pieces_of(parts[name])


class Restorer:
    """Splits an output, fed in pieces, into (place in the text, piece) by its form alone."""

    def __init__(self, form: str):
        self.left = list(ORDER[form]) if form != "plain" else []
        self.place, self.held = 0, ""

    def feed(self, piece: str) -> Iterator[tuple[int, str]]:
        text = self.held + piece
        while self.left:
            mark = MARKS[self.left[0]]
            at = text.find(mark)
            if at < 0:
                break
            if at:
                yield self.place, text[:at]
            text, self.place = text[at + len(mark):], PLACE[self.left.pop(0)]
        # a mark may begin in the last two characters
        keep = 2 if self.left else 0
        self.held = text[len(text) - keep:] if keep else ""
        if len(text) > keep:
            yield self.place, text[:len(text) - keep]

    def rest(self) -> Iterator[tuple[int, str]]:
        if self.held:
            yield self.place, self.held


class _Rows:
    """Collects rows and hands them on as Arrow batches of bounded size."""

    def __init__(self, schema: str, limit: int = 1 << 21):
        self.schema, self.limit = _arrow(schema), limit
        self.rows, self.size = [], 0

    def add(self, *row, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 64
        if self.size > self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.size = [], 0


def _emit(batches):
    """Rows of texts to pieces; one row of facts (pos -1) tells how many copies the task met."""
    rows, sent = _Rows(PIECES), OrderedDict()
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            key = (doc_id, sha256(text.encode()).digest())
            if key in sent:
                sent[key][0] += 1
                sent.move_to_end(key)
                continue
            form, n, parts = plan(doc_id, text)
            sizes = (None, None) if form == "plain" else (len(parts["prefix"]), len(parts["middle"]))
            for pos, piece in enumerate(output_pieces(form, parts)):
                yield from rows.add(*key, pos, None, None, None, None, None, piece, size=len(piece))
            sent[key] = [1, n, form, *sizes]
            if len(sent) > MEMO:
                old, facts = sent.popitem(last=False)
                yield from rows.add(*old, -1, *facts, None)
    for key, facts in sent.items():
        yield from rows.add(*key, -1, *facts, None)
    yield from rows.flush()


def _assemble(batches):
    """Pieces in output order to the output's digest and the text's parts."""
    rows, key, facts = _Rows(RESTORED), None, None

    def close():
        for place, piece in restorer.rest():
            yield from put(place, piece)
        yield from rows.add(*key, -1, 0, *facts, digest.hexdigest(), None)

    def put(place, piece):
        nonlocal seq
        seq += 1
        yield from rows.add(*key, place, seq, None, None, None, None, None, None, piece, size=len(piece))

    for b in batches:
        for doc_id, text_digest, pos, *found, piece in zip(*(c.to_pylist() for c in b.columns)):
            if (doc_id, text_digest) != key:
                if key is not None:
                    yield from close()
                key, facts, last, seq = (doc_id, text_digest), None, -1, 0
                digest = sha256()
            if pos < 0:
                facts = [found[0] + (facts[0] if facts else 0), *found[1:]]
                restorer = Restorer(facts[2])
            elif pos > last:  # another task may have sent the same piece
                last = pos
                digest.update(piece.encode())
                for place, part in restorer.feed(piece):
                    yield from put(place, part)
    if key is not None:
        yield from close()
    yield from rows.flush()


def _restore(batches):
    """Parts in the text's order to the digest of the restored text; one row for each copy."""
    rows, key, facts = _Rows(SCHEMA), None, None

    def close():
        copies, *told, output = facts
        for _ in range(copies):
            yield from rows.add(key[0], *told, output, digest.hexdigest())

    for b in batches:
        for doc_id, text_digest, pos, _, *found, piece in zip(*(c.to_pylist() for c in b.columns)):
            if (doc_id, text_digest) != key:
                if key is not None:
                    yield from close()
                key, digest = (doc_id, text_digest), sha256()
            if pos < 0:
                facts = found
            else:
                digest.update(piece.encode())
    if key is not None:
        yield from close()
    yield from rows.flush()


def assembled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces ``doc_id, digest, pos, ..., piece`` of all outputs, each partition in output order."""
    common.python_ready(docs.sparkSession)
    return (common.texts(docs, id_col, text_col).mapInArrow(_emit, PIECES)
            .repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "pos"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every row.

    A null or empty text is plain with no units; a text that holds a mark is plain. A null id stays
    null and is hashed as no digits. Repeated rows give repeated results; rows with one id and
    different texts are different documents. An empty table gives no rows, other columns are ignored.
    A text of any length is read whole by its map task and from there on streamed in pieces.
    """
    return (assembled(docs, id_col, text_col).mapInArrow(_assemble, RESTORED)
            .sortWithinPartitions("doc_id", "digest", "pos", "seq").mapInArrow(_restore, SCHEMA))
