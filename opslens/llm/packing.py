"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids and its end id are cut into full windows, which are sequences of their own, and a rest that is cut evenly
into pieces of at most ``MOST_PIECE`` tokens. The pieces of ``GROUP`` windows' worth of tokens form a group. In a group every
piece starts as a partial partition of k windows; the two partial partitions with the largest spread are merged again
and again, the fullest windows of one onto the emptiest of the other, until one partition with near-equal windows is left.
k is the least number that the tokens need; whenever a window would hold more than fits, k rises by one and the
differencing is done again.

Groups are runs of documents inside a Spark partition, so nothing is shuffled; a task holds one group and one batch.
Sequence numbers carry the partition's number in their upper bits, so a task that is run again gives the same ones.
"""

import heapq
import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
GROUP = 128
MOST_PIECE = 256
LONG_BLANK = 100_000
END = np.array([0], "<u4").tobytes()


def differenced(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """``k`` windows as (total, items) that hold all items, near equal; windows without items may be left out."""
    ticket = count()
    heap = [(-size, next(ticket), [(size, [i])]) for i, size in enumerate(sizes)]
    if k == 1:
        return [(sum(sizes), list(range(len(sizes))))]
    heapq.heapify(heap)
    while len(heap) > 1:
        one, other = heapq.heappop(heap)[2], heapq.heappop(heap)[2]  # each from full to empty, empty windows left out
        shared = len(one) + len(other) - k
        if shared > 0:
            lone, other_lone = one[: len(one) - shared], other[: len(other) - shared]
            met = zip(one[len(one) - shared :], reversed(other[len(other) - shared :]), strict=True)
            windows = lone + other_lone + [(a + b, x + y) for (a, x), (b, y) in met]
        else:
            windows = one + other
        windows.sort(key=lambda w: -w[0])
        spread = windows[0][0] - (windows[-1][0] if len(windows) == k else 0)
        heapq.heappush(heap, (-spread, next(ticket), windows))
    return heap[0][2] if heap else []


def packed(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Items of each window, none over ``window``; every size is at most ``window``."""
    k = -(-sum(sizes) // window)
    while True:
        windows = differenced(sizes, k)
        if not windows or windows[0][0] <= window:
            return [items for _, items in windows]
        k += 1


def byte_letters() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of a byte-level BPE vocabulary in the ``tokenizers`` file format; its ids are the ranks of its merges."""

    def __init__(self, tokenizer_json: str, pattern: str) -> None:
        import json

        import regex
        import tiktoken

        letters = byte_letters()
        vocabulary = json.loads(tokenizer_json)["model"]["vocab"]
        ranks = {bytes(map(letters.__getitem__, name)): i for name, i in vocabulary.items() if letters.keys() >= set(name)}
        added = json.loads(tokenizer_json)["added_tokens"]
        # Other flags would take in white space, hold to word borders or look in changed text; the file's tokens have none set.
        if any(token[flag] for token in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with single_word, lstrip or rstrip are not supported")
        self.added = {token["content"]: np.array([token["id"]], "<u4").tobytes() for token in added if token["content"]}
        longest_first = sorted(self.added, key=lambda content: -len(content))
        self.at_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if added else lambda text: [text]
        special = {token["id"] for token in added}
        ranks = {name: i for name, i in ranks.items() if i not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern).findall

    def encode_whole(self, text: str) -> bytes:
        """Ids of a text in which the file's added tokens stand for themselves, as in ``encode``."""
        parts = self.at_added(text)  # ordinary text and added tokens in turn
        return b"".join(self.added[part] if k % 2 else self.encode(part) for k, part in enumerate(parts) if part)

    def encode(self, text: str) -> bytes:
        """Ids of ordinary text as little-endian unsigned 32-bit integers."""
        if len(text) > LONG_BLANK and re.search(rf"\s{{{LONG_BLANK}}}", text):
            # The library's own splitting overflows its stack on longer runs of white space.
            ids = [i for part in self.cut(text) for i in self.encoding._encode_single_piece(part)]
        else:
            ids = self.encoding.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


LOADED: dict[tuple[int, str], Encoder] = {}


def encoder(tokenizer_json: str, pattern: str) -> Encoder:
    """The encoder, built once a process."""
    key = (hash(tokenizer_json), pattern)
    if key not in LOADED:
        LOADED.clear()
        LOADED[key] = Encoder(tokenizer_json, pattern)
    return LOADED[key]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Rows (id, start, length, ids, doc_tokens, sequence_id, offset), one for each piece of a document.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers; each document ends with id 0. ``pattern``
    splits text into the tokenizer's pre-tokens. The strings of added tokens in a text become their ids, as in the
    library. A null or empty text is the end id alone. Repeated rows are packed each on their own; other columns are not looked at; an empty table
    gives no rows. The tokenizer file is read once, here, and travels with the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_json, pattern).encode_whole
        sequence = count(TaskContext.get().partitionId() << 33)
        waiting: list[tuple] = []  # pieces (id, start, length, ids, doc_tokens)
        filled = 0
        id_type = None

        def record(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], id_type)] + [pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def flush() -> list[tuple]:
            rows = []
            for items in packed([piece[2] for piece in waiting], window):
                number, offset = next(sequence), 0
                for i in items:
                    rows.append((*waiting[i], number, offset))
                    offset += waiting[i][2]
            waiting.clear()
            return rows

        for batch in batches:
            id_type = batch.column(0).type
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + END
                n = len(ids) // 4
                whole = n - n % window
                for at in range(0, whole, window):
                    rows.append((name, at, window, ids[4 * at : 4 * (at + window)], n, next(sequence), 0))
                parts = -(-(n - whole) // MOST_PIECE)
                borders = [whole + (n - whole) * p // parts for p in range(parts + 1)] if parts else []
                waiting.extend((name, s, e - s, ids[4 * s : 4 * e], n) for s, e in zip(borders, borders[1:], strict=False))
                filled += n - whole
                if filled >= GROUP * window:
                    rows += flush()
                    filled = 0
            if rows:
                yield record(rows)
        if waiting:
            yield record(flush())

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
