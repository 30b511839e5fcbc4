"""Packing: vector bin packing of examples into training sequences.

Three limits hold at once in a sequence: tokens, segments, and loss-bearing tokens (the last ones of an example: a prompt
comes first; of a plain document an eighth counts as its prompt).  The dot-product heuristic fills one sequence after another: of
the examples that fit, it takes the one whose demand has the largest weighted dot product with what is left.  When none fits, the
best one is cut at the gap and its rest goes back.  Examples of equal demand are one choice, so that the work of a placement
grows with the number of different demands and not with that of examples.  A sequence that another limit ends early is cut back
to a power of two of tokens, which needs no padding, unless it is nearly full; the last ids of a group are dealt to
sequences of powers of two.

Every partition is packed where it lies, in groups of about `group_tokens` tokens, so nothing is shuffled, memory is bounded
and a lost task packs the same rows again.  A sequence's id holds the partition's number in its upper bits.

Cases: null text is empty (its one id is the end id); a document of any length is cut; special-token strings in a text are
those tokens, as the tokenizer reads them; ids may be null or repeat (each row is its own document); an empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: The limits of a sequence.  The last one binds where only the later parts of long documents are left to fill with.
TOKENS, SEGMENTS, LOSS = 4096, 256, 4032
#: One of so many ids at the front of a plain document bears no loss, one at least; share of a sequence that may be padding.
PROMPT, PADDING = 8, 1 / 64
END_ID = 2
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_encoders: dict = {}


class WordIds:
    """Ids by a word-level vocabulary file: no piece of this tokenizer crosses white space, so each distinct word is encoded
    once and kept."""

    #: Words that a process keeps: those that it met first, so the frequent ones.
    KEEP = 300_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """bounds, ids: those of text i are ids[bounds[i]:bounds[i + 1]]."""
        bounds, codes, vocabulary = T.words(texts)
        own = vocabulary.to_pylist()
        known = self.known
        each = [known.get(w) for w in own]
        new = [k for k, e in enumerate(each) if e is None]
        for at in range(0, len(new), 500):  # one text of many words is encoded faster than many texts
            part = [own[k] for k in new[at : at + 500]]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, starts = array("I", found.ids).tobytes(), np.cumsum([0, *(len(w) + 1 for w in part)])
            cut = (4 * np.searchsorted(np.fromiter((o[0] for o in found.offsets), np.int64, len(ids) // 4), starts)).tolist()
            for k, a, b in zip(new[at : at + 500], cut[:-1], cut[1:], strict=True):
                each[k] = ids[a:b]
        known.update((own[k], each[k]) for k in new[: max(0, self.KEEP - len(known))])
        ends, ids = T.flat_ids(each, codes)
        cut = ends[bounds]
        if end_id is not None:
            ids, cut = np.insert(ids, cut[1:], np.uint32(end_id)), cut + np.arange(len(cut))
        return cut, ids


def encoder(path: str) -> WordIds:
    """One a process."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def loss_bearing(lengths: np.ndarray) -> np.ndarray:
    """The loss-bearing ids of plain documents of such lengths."""
    return np.maximum(lengths - np.maximum(lengths // PROMPT, 1), 0)


class _Pool:
    """Examples by demand (ids and loss-bearing ids left); equal ones are one row with a stack."""

    def __init__(self, left: np.ndarray, bear: np.ndarray, items: np.ndarray):
        order = items[np.lexsort((items, bear[items], left[items]))]
        new = np.flatnonzero(np.r_[True, (np.diff(left[order]) != 0) | (np.diff(bear[order]) != 0)]) if len(order) else np.empty(0, np.int64)
        self.need, self.need_loss = left[order[new]].astype(float), bear[order[new]].astype(float)
        self.stacks = [part[::-1].tolist() for part in np.split(order, new[1:])] if len(order) else []
        self.row = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(self.need, self.need_loss, strict=True))}
        self.some, self.free, self.n = np.ones(len(new), bool), self.need - self.need_loss, len(order)

    def put(self, i: int, need: int, need_loss: int) -> None:
        self.n += 1
        k = self.row.get((need, need_loss))
        if k is None:
            k = self.row[need, need_loss] = len(self.stacks)
            self.stacks.append([])
            if k == len(self.need):  # room for as many again
                self.need, self.need_loss, self.free = (np.r_[x, np.zeros(k + 16)] for x in (self.need, self.need_loss, self.free))
                self.some = np.r_[self.some, np.zeros(k + 16, bool)]
            self.need[k], self.need_loss[k], self.free[k] = need, need_loss, need - need_loss
        self.stacks[k].append(i)
        self.some[k] = True

    def take(self, k: int) -> int:
        self.n -= 1
        i = self.stacks[k].pop()
        self.some[k] = bool(self.stacks[k])
        return i


def pack(lengths, loss, tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int = LOSS) -> list[list[tuple[int, int, int, int]]]:
    """Sequences of pieces (example, start, length, loss-bearing tokens).  Each id of each example is in one piece; each
    sequence keeps the three limits and is full, nearly so, or has a power of two of tokens (if `tokens` is one)."""
    if min(tokens, segments, loss_tokens) < 1:
        raise ValueError("limits are 1 at least")
    left, bear, begin = np.array(lengths, np.int64), np.array(loss, np.int64), np.zeros(len(lengths), np.int64)
    out: list = []
    limits = np.array([tokens, segments, loss_tokens], float)
    weight = np.array([left.sum(), len(left), bear.sum()]) / limits
    weight = weight / max(weight.sum(), 1e-12) / limits**2
    fit = (left <= tokens) & (bear <= loss_tokens)
    long, pool = np.flatnonzero(~fit)[::-1].tolist(), _Pool(left, bear, np.flatnonzero(fit & (left > 0)))
    whole = not tokens & (tokens - 1)
    while long or pool.n:
        placed, room, seats, room_loss = [], tokens, segments, loss_tokens

        def place(i: int, n: int) -> None:
            nonlocal room, seats, room_loss
            placed.append((i, n))
            room, seats, room_loss = room - n, seats - 1, room_loss - max(0, n - int(left[i] - bear[i]))

        if long:
            i = long.pop()
            place(i, int(min(tokens, left[i] - bear[i] + loss_tokens)))
        while room and seats and pool.n:
            fits = pool.some & (pool.need <= room) & (pool.need_loss <= room_loss)
            score = pool.need * (weight[0] * room) + pool.need_loss * (weight[2] * room_loss) + weight[1] * seats
            if fits.any():
                k = int(np.argmax(np.where(fits, score, -1)))
                i = pool.take(k)
                place(i, int(left[i]))
                continue
            able = pool.some if room_loss else pool.some & (pool.free > 0)
            if not able.any():
                break
            i = pool.take(int(np.argmax(np.where(able, score, -1))))
            place(i, int(min(left[i], room, left[i] - bear[i] + room_loss)))
        total, more = tokens - room, bool(long or pool.n) or any(n < left[i] for i, n in placed)
        aim = 1 << (total.bit_length() - 1) if whole and more and total < tokens * (1 - PADDING) else total
        sequence = []
        for i, n in placed:
            if n := min(n, aim):
                held = max(0, n - int(left[i] - bear[i]))
                sequence.append((i, int(begin[i]), n, held))
                begin[i], left[i], bear[i], aim = begin[i] + n, left[i] - n, bear[i] - held, aim - n
            if left[i] > tokens or bear[i] > loss_tokens:
                long.append(i)
            elif left[i]:
                pool.put(i, int(left[i]), int(bear[i]))
        out.append(sequence)
    return out[:-1] + _powers(out[-1], tokens) if out else out


def _powers(sequence: list, tokens: int) -> list[list]:
    """The sequence itself if it is nearly full, else its ids dealt to sequences of powers of two, largest first."""
    total = sum(p[2] for p in sequence)
    if total >= tokens * (1 - PADDING) or tokens & (tokens - 1):
        return [sequence]
    parts, now, room = [], [], 1 << (total.bit_length() - 1)
    for i, start, n, loss in sequence:
        while n:
            k = min(n, room)
            held = max(0, k - (n - loss))
            now.append((i, start, k, held))
            start, n, loss, room, total = start + k, n - k, loss - held, room - k, total - k
            if not room:
                parts.append(now)
                now, room = [], 1 << (total.bit_length() - 1) if total else 0
    return parts


def pack_documents(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int = LOSS, group_tokens: int = 2_000_000, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.  tokenizer: the path
    of the vocabulary file on the workers."""

    def placed(ids_of, docs_of, cuts, base: int):
        lengths = np.diff(cuts)
        data = memoryview(ids_of).cast("B")
        rows: list = []
        found = pack(lengths, loss_bearing(lengths), tokens, segments, loss_tokens)
        for k, sequence in enumerate(found):
            offset = 0
            for i, start, n, loss in sequence:
                a = (int(cuts[i]) + start) * 4
                rows.append((docs_of[i], start, n, zlib.crc32(data[a : a + 4 * n]), int(lengths[i]), base + k, offset, loss))
                offset += n
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in _SCHEMA.split(", ")]), len(found)

    def run(batches):
        to_ids, base = encoder(tokenizer), TaskContext.get().partitionId() << 36
        held, names, total = [], [], 0
        for batch in batches:
            for part in T.slices(batch, "text"):
                cuts, ids = to_ids.encode(T.column(part, "text"), end_id)
                held.append((cuts, ids))
                names += part.column("doc_id").to_pylist()
                total += len(ids)
                if total >= group_tokens:
                    out, n = placed(*_joined(held, names), base)
                    yield out
                    held, names, total, base = [], [], 0, base + n
        if held:
            yield placed(*_joined(held, names), base)[0]

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, _SCHEMA)


def _joined(held, names):
    sizes = np.concatenate([np.diff(c) for c, _ in held])
    return np.ascontiguousarray(np.concatenate([i for _, i in held])), names, np.r_[0, np.cumsum(sizes)]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
