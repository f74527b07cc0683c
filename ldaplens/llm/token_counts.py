"""Operator 1: token counts by heap-and-linked-list byte-pair merging, no identifiers emitted."""

from __future__ import annotations

import json
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from ldaplens.llm import common
from ldaplens.llm.wordsplit import Bounded, byte_alphabet, lower_words, normal_form, unsafe

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Counter:
    """Counts the tokens of texts for a word-end BPE vocabulary file.

    A word's bytes (the last one carrying the word-end mark) are the initial symbols; a heap holds
    (rank, position, pair) of adjacent symbols, a linked list the live neighbours. Every successful
    pop is one merge, so the count is the initial symbols minus the merges.
    """

    def __init__(self, vocab_file: str):
        import re

        from tokenizers import Tokenizer

        with open(vocab_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        alphabet = byte_alphabet()
        self.first = [ids[c] for c in alphabet]
        self.last = [ids[c + end] for c in alphabet]
        # a pair of ids in one integer -> (rank, id of the merged symbol)
        self.pairs = {ids[a] << 32 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.by_char = {c: b for b, c in enumerate(alphabet)}
        self.tokenizer = Tokenizer.from_file(vocab_file)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)))
        self.words = Bounded(lambda w: self.count_bytes(w.encode()), limit=1_000_000)
        self.mapped = Bounded(lambda w: self.count_bytes(bytes(map(self.by_char.__getitem__, w))))

    def count_bytes(self, word: bytes) -> int:
        n = len(word)
        if n < 2:
            return n
        pairs = self.pairs
        symbol = [self.first[b] for b in word]
        symbol[-1] = self.last[word[-1]]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(hit[0], i, key) for i in range(n - 1) if (hit := pairs.get(key := symbol[i] << 32 | symbol[i + 1]))]
        heapify(heap)
        count = n
        while heap:
            _, i, key = heappop(heap)
            j = after[i]
            if j < 0 or symbol[i] << 32 | symbol[j] != key:
                continue  # one of the two has been merged since
            symbol[i] = pairs[key][1]
            symbol[j] = -1
            after[j], after[i] = -1, (k := after[j])
            count -= 1
            if k >= 0:
                before[k] = i
                if hit := pairs.get(key := symbol[i] << 32 | symbol[k]):
                    heappush(heap, (hit[0], i, key))
            if (h := before[i]) >= 0 and (hit := pairs.get(key := symbol[h] << 32 | symbol[i])):
                heappush(heap, (hit[0], h, key))
        return count

    def _section(self, text: str) -> int:
        if unsafe()(text) is None:
            return sum(map(self.words.__getitem__, lower_words()(normal_form(text))))
        tokenizer = self.tokenizer
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))
        return sum(self.mapped[w] for w, _ in pieces)

    def count(self, text: str) -> int:
        """Tokens of one text; every special string in it is one token, as the library has it."""
        if not text:
            return 0
        sections = self.special.split(text) if "<|" in text else [text]
        return len(sections) - 1 + sum(map(self._section, sections))


@cache
def counter(vocab_file: str) -> Counter:
    return Counter(vocab_file)


def token_counts(docs: DataFrame, vocab_file: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, one narrow pass without a shuffle.

    Null or empty text: 0 bytes, 0 tokens, not over the limit. A null id stays null; repeated rows
    give repeated results; an empty table gives no rows; other columns are ignored. A word of any
    length is merged whole (n log n), and the memo of words is bounded.
    """
    common.python_ready(docs.sparkSession)

    def count(batches):
        from ldaplens.llm.token_counts import counter

        one = counter(vocab_file).count
        for b in batches:
            found = b.column(1).to_pylist()
            n = [one(t) for t in found]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(t.encode()) for t in found], pa.int64()),
                pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.texts(docs, id_col, text_col).mapInArrow(count, SCHEMA)
