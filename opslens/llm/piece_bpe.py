"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut into chunks that no piece crosses: a word with at most one space mark before it, a newline, a run of marks.
Chunks met before come from a table that holds at most ``MOST_KNOWN`` of them; the new chunks of a batch are encoded together
in flat numpy arrays, a symbol per character. Each round takes the segmented minimum of the pair ranks of every chunk and
merges, in all chunks at once, the pairs with that rank from the left without overlap; chunks without a pair leave the
arrays, and the rounds end when none is left. The rank of a pair is the rank of the piece it makes, by falling score.

One merge can make a pair of better rank than the merge itself, and that pair goes first in the sequential order. For such
pieces a round merges only occurrences that are at least twice the longest piece behind the one before them: what a merge
sets off stays inside one piece around it, so the others cannot be reached. Runs of marks are encoded once a length:
their pieces share the lowest score and repeat with the longest piece.
"""

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.spans import slices

MARK = "▁"
MOST_KNOWN = 200_000
SLICE = 512 * 1024
SHIFT = 21  # characters outside the vocabulary are symbols above it; all symbols are under 2 ** SHIFT
NEVER = np.iinfo(np.int32).max


LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"


def chunk_pattern(names: Iterable[str]) -> str:
    """Chunks that no piece crosses: finer where no piece holds a newline, or has Latin letters beside others."""
    names = list(names)
    line = "\n" * (not any("\n" in name for name in names))
    mixed = re.compile(f"[{LATIN}][^{LATIN}]|[^{LATIN}][{LATIN}]")
    parts = [f"[^ {line}]+"] if any(map(mixed.search, names)) else [f"[{LATIN}]+", f"[^ {line}{LATIN}]+"]
    return "|".join([f" {{2,}}(?:{'|'.join(parts)})?", *(f" ?{part}" for part in parts), " "] + [line] * bool(line))


class Pieces:
    """The vocabulary of a BPE model with byte fallback, and its merge tables."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = reader.get_piece_size()
        names = [reader.id_to_piece(i) for i in range(n)]
        self.end = reader.eos_id()
        plain = [i for i in range(n) if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i))]
        scores = {names[i]: reader.get_score(i) for i in plain}
        ids = {names[i]: i for i in plain}
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}

        self.first_byte = next(i for i in range(n) if reader.is_byte(i))
        self.outside = n
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for name, i in ids.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        splits, self.careful = [], np.zeros(n, bool)
        for name, i in ids.items():
            for k in range(1, len(name)):
                left, right = ids.get(name[:k]), ids.get(name[k:])
                if left is not None and right is not None:
                    splits.append(((left << SHIFT) + right, order[scores[name]], i))
                    for part in (name[:k], name[k:]):
                        self.careful[ids[part]] |= scores[name] >= scores[part]
        splits.sort()
        self.pairs = np.array([s[0] for s in splits] + [np.iinfo(np.int64).max], np.int64)
        self.ranks = np.array([s[1] for s in splits] + [NEVER], np.int32)
        self.made = np.array([s[2] for s in splits] + [0], np.int32)
        self.reach = 2 * max(map(len, ids))
        self.longest_run = max(len(name) for name in ids if not name.strip(MARK))
        self.text = [b""] * n
        for i in plain:
            self.text[i] = names[i].replace(MARK, " ").encode()
        for i in range(256):
            self.text[self.first_byte + i] = bytes([i])
        self.text[0] = " ⁇ ".encode()
        self.known: dict[str, bytes] = {}
        self.runs: dict[int, bytes] = {}
        self.chunks = re.compile(chunk_pattern(names[i].lstrip(MARK) for i in plain)).findall

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the tables; the last place stands for none."""
        keys = (left.astype(np.int64) << SHIFT) + right
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, at, len(self.pairs) - 1)

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of each word as bytes of 32-bit integers; a space stands for the mark."""
        points = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) for w in words], np.int64)
        symbol, place = self.symbol[points], np.arange(len(points))
        word = np.repeat(np.arange(len(words)), sizes)
        pair = np.full(len(symbol), len(self.pairs) - 1)
        pair[:-1] = np.where(word[:-1] == word[1:], self.lookup(symbol[:-1], symbol[1:]), len(self.pairs) - 1)
        done_words, done_symbols = [], []
        while len(symbol):
            rank = self.ranks[pair]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(word)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            rest = lowest == NEVER
            if rest.any():
                done_words.append(word[rest])
                done_symbols.append(symbol[rest])
                live = ~rest
                symbol, place, word, pair, rank, lowest = (a[live] for a in (symbol, place, word, pair, rank, lowest))
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == lowest)
            fresh = np.r_[True, (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - run) % 2 == 0
            careful = self.careful[self.made[pair[at]]]
            if careful.any():
                far = np.r_[True, (word[at[1:]] != word[at[:-1]]) | (place[at[1:]] - place[at[:-1]] >= self.reach)]
                take &= ~careful | far
            at = at[take]
            symbol[at] = self.made[pair[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            shift = np.cumsum(keep) - 1
            symbol, place, word, pair = symbol[keep], place[keep], word[keep], pair[keep]
            new = shift[at]
            stale = np.concatenate([new, new[new > 0] - 1])
            inner = stale[stale < len(symbol) - 1]
            pair[stale] = len(self.pairs) - 1
            inner = inner[word[inner] == word[inner + 1]]
            pair[inner] = self.lookup(symbol[inner], symbol[inner + 1])
        word, symbol = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        word, symbol = self.with_bytes(word, symbol)
        ends = (4 * np.searchsorted(word, np.arange(len(words)), "right")).tolist()
        data = symbol.astype("<i4").tobytes()
        return [data[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    def with_bytes(self, word: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as the ids of their bytes."""
        outside = np.flatnonzero(symbol >= self.outside)
        if not len(outside):
            return word, symbol
        spelt = [chr(s).encode() for s in (symbol[outside] - self.outside).tolist()]
        times = np.ones(len(symbol), np.int64)
        times[outside] = [len(b) for b in spelt]
        first = np.cumsum(times) - times
        word, symbol = np.repeat(word, times), np.repeat(symbol, times)
        at = np.concatenate([np.arange(f, f + len(b)) for f, b in zip(first[outside].tolist(), spelt, strict=True)])
        symbol[at] = self.first_byte + np.frombuffer(b"".join(spelt), np.uint8)
        return word, symbol

    def learn(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self.known)
        if len(self.known) + len(new) > MOST_KNOWN:
            self.known.clear()
            new = sorted(words)
        if new:
            self.known.update(zip(new, self.merged(new), strict=True))

    def marks(self, n: int) -> bytes:
        """Ids of ``n`` marks alone: copies of the longest piece, then what is left of a run of under three of them."""
        whole = max(0, n // self.longest_run - 2)
        left = n - whole * self.longest_run
        if left not in self.runs:
            self.runs[left] = self.merged([" " * left])[0] if left else b""
        return self.longest() * whole + self.runs[left]

    def longest(self) -> bytes:
        if 0 not in self.runs:
            self.runs[0] = b""
            self.runs[-1] = self.merged([" " * self.longest_run])[0]
        return self.runs[-1]

    def one(self, chunk: str) -> bytes:
        """Ids of a chunk whose words are known."""
        if not chunk.startswith("  "):
            return self.known[chunk]
        word = chunk.lstrip(" ")
        if not word:
            return self.marks(len(chunk))
        ids = self.known[" " + word]
        alone = self.known[" "]
        more = len(chunk) - len(word) - 1
        return self.marks(more + 1) + ids[len(alone) :] if ids.startswith(alone) else self.marks(more) + ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids with the end id, as bytes of 32-bit integers."""
        end = np.array([self.end], "<i4").tobytes()
        texts = [t.replace(MARK, " ") for t in texts]
        cut = [self.chunks(" " + t) if t else [] for t in texts]
        words, spaced = {" "}, ["  " in t or t[:1] == " " for t in texts]
        for chunks, wide in zip(cut, spaced, strict=True):
            words.update([c if c[:2] != "  " else " " + c.lstrip(" ") for c in chunks] if wide else chunks)
        self.learn(words)
        get = self.known.__getitem__
        return [b"".join(map(self.one if wide else get, chunks)) + end for chunks, wide in zip(cut, spaced, strict=True)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


LOADED: dict[bytes, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """The tables of ``model``, built once a process."""
    if model not in LOADED:
        LOADED.clear()
        LOADED[model] = Pieces(model)
    return LOADED[model]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids), one for each row of ``docs``: piece ids with an end id, no start id.

    A null text is encoded as an empty one, to the end id alone. Repeated rows stay repeated; other columns are not
    looked at; an empty table gives no rows. The model is read once, here, and travels with the tasks (under 1 MB).
    """
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
            made = pieces(model).encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum([0] + [len(m) // 4 for m in made]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, ids, text): the text that the ids stand for; null ids give a null text."""
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            decode, lists = pieces(model).decode, batch.column(1)
            ids, ends, there = lists.values.to_numpy(), lists.offsets.to_pylist(), lists.is_valid().to_pylist()
            texts = [decode(ids[s:e].tolist()) if known else None for s, e, known in zip(ends, ends[1:], there, strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["id", "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, text string").withColumnRenamed("id", id_col)
