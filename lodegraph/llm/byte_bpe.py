"""Byte-level BPE encoding and decoding with DuckDB's recursive queries in each partition.

A word (a match of the pattern) that is a token itself is that token.  Any other is cut where no token of the rank file can
lie across: no pair is ever merged there, so the stretches between are contracted by themselves.  A stretch becomes rows of
token and position, one a byte.  The recursive query joins neighbours with the merge table and contracts each stretch's pairs of
least rank, leftmost first (disjoint ones of the same rank in the same round), until no neighbours merge.  Should a
contraction give rise to a pair of lesser rank, the order could matter: such a stretch is done again by a query that contracts
one pair a round.  Distinct stretches of a slice that this process does not hold are contracted in one query; those that it met
first, up to `KEEP`, are kept.  Decoding joins the ids of each text with the vocabulary and aggregates the bytes in the order of
their positions.

No shuffle: each task holds a slice of rows, the merge table (from the rank file, of fixed size) and the kept stretches.  The
database has one thread, keeps the order of its rows (joins keep that of their left side; the query fails if it did not) and
writes no file; its memory grows with the longest stretch.

Cases: null text is empty, no ids, decodes to the empty text; texts and words of any length; ids may be null or repeat;
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: Most stretches and units that a process keeps, bytes of text in a slice, and MB of the database's memory.
KEEP, SLICE, MEMORY = 200_000, 4 << 20, 300
#: MB more for each million bytes of the longest stretch.
STRETCH = 400
_coders: dict = {}

#: Rows of state are in the order of word (here: stretch) and position; a round gives `done` rows once and goes on with the
#: others.  `least` is the rank that the round before contracted.  `doubt` marks words where one contraction at a time could have
#: met a lesser rank first: one that came up beside what was contracted, or (`turns`: pairs of lesser rank than their left token)
#: would have, had its right token not been contracted too.
_ROUNDS = """
with recursive state as (
  select t.word, t.pos, t.id, m.rank, -1 as least, false as doubt, false as done
  from (select word, pos, id, case when lead(word) over () = word then lead(id) over () end as nxt from fresh) t
  left join merges m on m.a = t.id and m.b = t.nxt
  union all
  select t.word, t.pos, t.id, m.rank, t.least, t.doubt, t.done
  from (
    select word, pos, case when taken then best else id end as id, best as least, doubt or v.a is not null as doubt, best is null as done,
      case when lead(word) over () = word then lead(case when taken then best else id end) over () end as nxt
    from (
      select *, coalesce(lag(taken) over (), false) as swallowed, case when taken and lead(taken, 2) over () then best end as made, lead(id, 2) over () as beside,
        case when lag(place) over () > place then error('rows out of order') end as wrong
      from (
        select *, {taken} as taken
        from (
          select s.word, s.pos, s.id, b.best, b.first, coalesce(s.rank = b.best, false) as hit, b.doubt or coalesce(b.best < s.least, false) as doubt,
            cast(s.word as bigint) * 4294967296 + s.pos as place, row_number() over () as n
          from state s left join (select word, min(rank) as best, arg_min(pos, rank) as first, bool_or(doubt) as doubt from state where not done group by word) b on b.word = s.word
          where not s.done
        )
      )
    ) r
    left join turns v on v.a = r.made and v.b = r.beside
    where not swallowed and wrong is null
  ) t
  left join merges m on m.a = t.id and m.b = t.nxt and not t.done
)
select word, pos, id, doubt from state where done
"""
#: Of a run of overlapping hits every second one, from the left.
_ENCODE = _ROUNDS.format(taken="hit and (n - coalesce(max(case when not hit then n end) over (rows between unbounded preceding and current row), 0)) % 2 = 1")
_ENCODE_SINGLY = _ROUNDS.format(taken="hit and pos = first")

_DECODE = """
select i.doc, string_agg(v.hex, '' order by i.pos) as hex from ids i join vocabulary v on v.id = i.id group by i.doc
"""


class Coder:
    """Encodes and decodes by a rank file; one a process.  The tables of either side are made at first use.

    spaced: no match of the pattern goes on over a single space that stands behind anything but white space, so texts are cut
    there and equal cuts are encoded once."""

    def __init__(self, path: str, pattern: str, spaced: bool = False, keep: int = KEEP):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find, self.keep, self.spaced = regex.compile(pattern).findall, keep, spaced
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        self.db.execute("set disabled_optimizers = 'join_order,build_side_probe_side'")
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.two, self.three = self._neighbours()
        self.made: set[str] = set()
        self.stretches: dict[bytes, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Which two bytes are a token, and which three stand side by side in one."""
        two, three = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        size = np.fromiter(map(len, self.ranks), np.int64, len(self.ranks))
        x = np.frombuffer(b"".join(self.ranks), np.uint8).astype(np.int32)
        last = np.cumsum(size)
        left = np.repeat(last, size) - np.arange(len(x))  # bytes of the token from here on
        at = (last - size)[size == 2]
        two[x[at] << 8 | x[at + 1]] = True
        at = np.flatnonzero(left >= 3)
        three[x[at] << 16 | x[at + 1] << 8 | x[at + 2]] = True
        return two, three

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from given")
        self.db.unregister("given")

    def _once(self, name: str, columns) -> None:
        if name not in self.made:
            self._table(name, columns())
            self.made.add(name)

    def _merges(self) -> dict:
        ranks = self.ranks
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        return {name: pa.array(x, pa.int32()) for name, x in zip(("a", "b", "rank"), zip(*pairs, strict=True) if pairs else ((), (), ()), strict=True)}

    def _contract(self, new: list[bytes], query: str = _ENCODE) -> list[bytes]:
        """Ids of stretches, all by one recursive query."""
        if "turns" not in self.made:
            self._once("merges", self._merges)
            self.db.execute("create or replace table turns as select a, b from merges where rank < a")
            self.made.add("turns")
        size = np.fromiter(map(len, new), np.int64, len(new))
        if (longest := int(size.max())) > 1_000_000:
            self.db.execute(f"set memory_limit = '{MEMORY + STRETCH * longest // 1_000_000}MB'")
        word = np.repeat(np.arange(len(new)), size)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        ids = self.single[np.frombuffer(b"".join(new), np.uint8)]
        self._table("fresh", {"word": word.astype(np.int32), "pos": pos.astype(np.int32), "id": ids})
        found = self.db.execute(query).fetchnumpy()
        order = np.lexsort((found["pos"], found["word"]))
        word = found["word"][order]
        cuts = np.searchsorted(word, np.arange(len(new) + 1)) * 4
        each = np.asarray(found["id"])[order].astype("<u4").tobytes()
        out = [each[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        if query is _ENCODE and len(again := np.unique(found["word"][found["doubt"]]).tolist()):
            for k, ids_of in zip(again, self._contract([new[k] for k in again], _ENCODE_SINGLY), strict=True):
                out[k] = ids_of
        return out

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ends, ids: those of words[i] are ids[ends[i]:ends[i + 1]]."""
        data = [w.encode() for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        own = self.ranks
        whole = np.fromiter((own.get(d, -1) for d in data), np.int64, len(data))
        body = np.frombuffer(b"".join(data), np.uint8)
        x = body.astype(np.int32)
        pairs = x[:-1] << 8 | x[1:]
        joined = self.two[pairs]  # byte i and the next one, by a token that spans both
        triples = self.three[pairs[:-1] << 8 | x[2:]] if len(x) > 2 else np.empty(0, bool)
        joined[: len(triples)] |= triples
        joined[len(joined) - len(triples) :] |= triples
        ends = np.cumsum(size)
        joined |= np.repeat(whole >= 0, size)[:-1]
        joined[ends[:-1] - 1] = False
        bounds = np.r_[0, np.flatnonzero(~joined) + 1, len(x)].astype(np.int64)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(body)]).dictionary_encode()
        codes, distinct = cut.indices.to_numpy().astype(np.int64), cut.dictionary.to_pylist()
        first = np.searchsorted(bounds, ends - size)  # the first stretch of each word
        tokens, of = np.unique(whole[whole >= 0], return_inverse=True)
        codes[first[whole >= 0]] = len(distinct) + of
        known = self.stretches
        each = [known.get(s) for s in distinct]
        used = np.zeros(len(distinct) + len(tokens), bool)
        used[codes] = True
        new = [k for k, ids in enumerate(each) if ids is None and used[k]]
        if new:
            for k, ids in zip(new, self._contract([distinct[k] for k in new]), strict=True):
                each[k] = ids
            known.update((distinct[k], each[k]) for k in new[: max(0, self.keep - len(known))])  # the frequent ones come early and stay
        tokens = tokens.astype("<u4")
        at, ids = T.flat_ids([e or b"" for e in each] + [tokens[k : k + 1].tobytes() for k in range(len(tokens))], codes)
        return at[np.r_[first, len(codes)]], ids

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """bounds, codes, distinct units: whole texts, or if the pattern allows it texts cut before single spaces.  A text with
        a unit that is empty or ends in white space, where a match may go on, is one unit."""
        if not self.spaced:
            coded = texts.dictionary_encode()
            return np.arange(len(texts) + 1), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        parts = pc.split_pattern(texts, " ")
        flat = parts.flatten()
        size = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        coded = flat.dictionary_encode()
        codes, own = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        open_end = np.fromiter((not u or u[-1].isspace() for u in own), bool, len(own))[codes]
        open_end[ends - 1] = False
        row = np.repeat(np.arange(len(texts)), size)
        whole = np.bincount(row[open_end], minlength=len(texts)) > 0
        first = np.zeros(len(codes), bool)
        first[ends - size] = True
        codes = codes * 2 + ~first  # odd: a space stands before it
        keep = ~whole[row] | first
        extra = np.flatnonzero(whole)
        codes[(ends - size)[extra]] = 2 * len(own) + 2 * np.arange(len(extra))
        codes = codes[keep]
        used = np.zeros(2 * len(own) + 2 * len(extra) + 2, bool)
        used[codes] = True
        codes = (np.cumsum(used) - 1)[codes]
        units = [(" " if c & 1 else "") + own[c >> 1] if c < 2 * len(own) else texts[int(extra[(c >> 1) - len(own)])].as_py() for c in np.flatnonzero(used).tolist()]
        return np.r_[0, np.cumsum(np.where(whole, 1, size))], codes, units

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """bounds, ids: those of text i are ids[bounds[i]:bounds[i + 1]]."""
        bounds, codes, units = self._cut(texts)
        known = self.units
        each = [known.get(u) for u in units]
        missing = [k for k, ids in enumerate(each) if ids is None]
        found = [self.find(units[k]) for k in missing]
        words = [w for f in found for w in f if w]
        if words:
            at, ids = self._words(words)
            n = np.r_[0, np.cumsum(np.fromiter((sum(map(bool, f)) for f in found), np.int64, len(found)))]
            data, cuts = ids.tobytes(), (4 * at[n]).tolist()
            for k, a, b in zip(missing, cuts[:-1], cuts[1:], strict=True):
                each[k] = data[a:b]
            room = max(0, self.keep - len(known))
            known.update((units[k], each[k]) for k in missing[:room] if len(units[k]) < 200)
        ends, ids = T.flat_ids([e or b"" for e in each], codes)
        return ends[bounds], ids

    def decode(self, bounds: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes behind the ids of each text."""
        self._once("vocabulary", lambda: {"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self._table("ids", {"doc": doc.astype(np.int32), "pos": np.arange(len(ids), dtype=np.int64), "id": ids.astype(np.int32)})
        out = [b""] * (len(bounds) - 1)
        for d, h in self.db.execute(_DECODE).fetchall():
            out[d] = bytes.fromhex(h)
        return out


def coder(path: str, pattern: str, spaced: bool = False) -> Coder:
    if (path, pattern, spaced) not in _coders:
        _coders[path, pattern, spaced] = Coder(path, pattern, spaced)
    return _coders[path, pattern, spaced]


def encode_bpe(docs: DataFrame, path: str, pattern: str, spaced: bool = False, decode: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) of each row; with decode also `decoded` (binary), the
    bytes behind the ids, without a second process.  path: the rank file on the workers.  spaced: see Coder; true for
    public_tokenizers.PATTERN, a matter of speed alone."""

    def run(batches):
        own = coder(path, pattern, spaced)
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                bounds, ids = own.encode(T.column(part, "text"))
                data = ids.tobytes()
                columns = [part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array([data[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own.decode(bounds, ids), pa.binary())] * decode, names)

    names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * decode
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decode)


def decode_bpe(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded's columns and `decoded` (binary): the bytes behind the ids."""

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            for part in T.slices(batch, "ids", 2 * SLICE):
                data = pc.fill_null(part.column("ids"), b"").to_pylist()
                bounds = np.r_[0, np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) // 4)]
                decoded = own.decode(bounds, np.frombuffer(b"".join(data), "<u4"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    encoded = encode_bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, spaced=True, decode=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
