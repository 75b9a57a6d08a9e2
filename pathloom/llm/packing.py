"""Sum-of-squares online packing of token sequences into fixed windows.

Every task packs the documents it reads as they come: ``levels[h]`` counts the
partially filled windows with h tokens, and a document goes whole where the sum
of the squared counts grows least, be it a new window. A task keeps at most
``most_open`` windows open: once it has so many, a document that fits in none
of them is cut to fill the level with the most windows, and its rest is placed
in the same way. At the end of a task the open windows, no more than that, are
joined by cutting what they hold, so it pads one window at most. No shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SumOfSquares:
    """At most ``most_open`` open windows of ``size`` tokens by fill level."""

    def __init__(self, size: int, most_open: int = 64):
        if size < 1 or most_open < 1:
            raise ValueError("a window holds a token at least, and one must be open")
        self.size, self.most_open = size, most_open
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.used = 0
        self.n_open = 0

    def growth(self, item: int) -> np.ndarray:
        """How the sum of squares grows if an item of up to size - 1 tokens goes to level 0 (a new window), 1, ... size - item."""
        n = self.levels
        before, after = n[: self.size - item + 1], n[item:]
        grow = 2 * (after - before + 1)
        grow[0] = 2 * after[0] + 1
        grow[-1] = 1 - 2 * before[-1]  # a full window counts no more
        grow[1:][before[1:] == 0] = np.iinfo(np.int64).max
        if self.n_open >= self.most_open:
            grow[0] = np.iinfo(np.int64).max
        return grow

    def _put(self, at: int, tokens: int) -> tuple[int, int, int]:
        if at:
            window = self.open[at].pop()
            self.levels[at] -= 1
            self.n_open -= 1
        else:
            window, self.used = self.used, self.used + 1
        if at + tokens < self.size:
            self.levels[at + tokens] += 1
            self.n_open += 1
            self.open.setdefault(at + tokens, []).append(window)
        return window, at, tokens

    def place(self, item: int) -> list[tuple[int, int, int]]:
        """(window, offset, tokens) of each piece of an item of 1 to size tokens. Of equal levels the fullest is taken."""
        if not 1 <= item <= self.size:
            raise ValueError(f"an item of {item} tokens does not fit a window of {self.size}")
        out = []
        while item:
            if item == self.size:
                return [*out, self._put(0, item)]
            grow = self.growth(item)
            at = len(grow) - 1 - int(np.argmin(grow[::-1]))
            if grow[at] == np.iinfo(np.int64).max:  # all are open and none has room: only fuller levels have windows
                at = int(np.argmax(self.levels))
                out.append(self._put(at, self.size - at))
            else:
                out.append(self._put(at, item))
            item -= out[-1][2]
        return out


class ByteBpe:
    """Ids of a byte-level BPE given as a ``tokenizers`` file.

    Ordinary texts go through ``tiktoken`` over the file's own vocabulary in
    merge order, which gives the same ids several times faster (tested on all
    documents of a table); a text that holds an added token's string goes
    through ``tokenizers`` itself, which a task loads with the first of these.
    """

    def __init__(self, path: str, pattern: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.slow = path, None
        self.added = [x["content"] for x in spec["added_tokens"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.added}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if any(x in text for x in self.added):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def _packed(path: str, pattern: str, size: int, end_id: int, most_open: int):
    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        encode, state = ByteBpe(path, pattern), SumOfSquares(size, most_open)
        base = TaskContext.get().partitionId() << 40
        held: dict[int, list[tuple]] = {}  # pieces of open windows: (id, start, tokens, doc_tokens)
        ready: list[tuple] = []

        def emit(window: int, own: list[tuple]) -> None:
            offset = 0
            for key, start, part, whole in own:
                ready.append((key, start, len(part), part.tobytes(), whole, base + window, offset))
                offset += len(part)

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True)) if ready else [[]] * 7
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in zip(names, columns[1:], strict=True))], ["id", *names])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for first in range(0, len(tokens), size):
                    start = first
                    for window, offset, n in state.place(min(size, len(tokens) - first)):
                        held.setdefault(window, []).append((key, start, tokens[start : start + n], len(tokens)))
                        start += n
                        if offset + n == size:
                            emit(window, held.pop(window))
                if len(ready) >= 512:
                    yield batch_of(kind)
        # The windows still open, ``most_open`` at most, are joined by cutting what they hold into full ones.
        own, room = [], size
        for window in sorted(held):
            for key, start, part, whole in held[window]:
                while len(part):
                    own.append((key, start, part[:room], whole))
                    start, room, part = start + len(part[:room]), room - len(part[:room]), part[room:]
                    if not room:
                        emit(state.used, own)
                        state.used, own, room = state.used + 1, [], size
        if own:
            emit(state.used, own)
        if ready:
            yield batch_of(kind)

    return run


def pack(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, size: int = 2048, end_id: int = 1, most_open: int = 64) -> DataFrame:
    """Packs whole documents into windows of ``size`` tokens. One row per piece:

    id, start, length, ids (little-endian unsigned 32-bit, binary), doc_tokens,
    sequence_id, offset. A document is its ids and ``end_id``. One of more than
    ``size`` tokens, however long, is cut at each multiple of ``size``; what
    remains, and every shorter one, is placed by sum of squares over at most
    ``most_open`` open windows a task. Of equal levels the fullest is taken.
    Null and empty texts are ``end_id`` alone. Repeated rows and null ids are
    packed as rows of their own; other columns are ignored; an empty table gives
    no rows. Windows belong to one input partition; a rerun of a lost task gives
    the same rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(_packed(tokenizer, pattern, size, end_id, most_open), schema).withColumnRenamed("id", id_col)
