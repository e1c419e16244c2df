"""Byte-level BPE by recursive DuckDB queries inside Spark tasks.

Encoding: a text is cut into parts (``pieces``) and these into the matches of the vocabulary's pattern. Each distinct
match that is no token itself becomes rows (word, position, token) of one token a byte. A recursive query joins the
rows of neighbouring positions to the merge table (left, right -> token, whose id is its rank) and contracts in every
word its leftmost pair of least rank, until no word has a pair.
A word of over ``LONG`` bytes is cut into windows of ``WINDOW`` bytes, whatever its length. Tokens are the encoding of
what they spell exactly if every two neighbours are the encoding of what these two spell: merging goes by least rank
and leftmost first, so the first merge over a border would also be the next one with these two tokens alone. So the
encodings of neighbouring windows are joined by encoding the two tokens at their border again, and then, where these
change, those next to them. Every encoding is one of short strings by the recursive query, many to a query.
Decoding: rows (document, position, token) are aggregated in the order of positions and looked up in the vocabulary.

Every Spark task works on Arrow batches in bounded parts, with one DuckDB connection of one thread; encodings of
parts are remembered up to ``REMEMBERED``, over all tasks of a worker. Nothing is shuffled.
"""

from __future__ import annotations

import base64

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import give_back, ship, slices
from .pieces import Memory, binary_column, column_bytes

LONG, WINDOW, WIDE, LOOKS = 64, 32, 1000, 24
REMEMBERED = 1_000_000
WORDS_AT_ONCE = 10_000
BYTES_AT_ONCE = 1 << 20
ROWS_AT_ONCE = 2_000_000
TOKENS_AT_ONCE = 250_000

#: A row's key is its word and position; each round emits what is left of the words that it contracts. All rounds of a
#: query are kept, at most about half the square of a word's bytes.
_ROUNDS = """
with recursive st(i, k, tok) as (
  select 0, (w::bigint << 10) | p, tok from words
  union all
  select a.i + 1, a.k, case when a.k & 1023 = best.of & 1023 then (best.of >> 20)::int else a.tok end
  from st a join (
    select s.k >> 10 as w, min((m.new::bigint << 20) | ((s.after & 1023) << 10) | (s.k & 1023)) as of
    from (select k, tok, lead(tok) over g as nxt, lead(k) over g as after from st window g as (order by k)) s
    join merges m on m.l = s.tok and m.r = s.nxt
    where s.k >> 10 = s.after >> 10
    group by s.k >> 10
  ) best on a.k >> 10 = best.w where a.k & 1023 <> (best.of >> 10) & 1023
), last as (select k >> 10 as w, max(i) as i from st group by k >> 10)
select w, list(tok order by k) as ids from st join last on st.k >> 10 = last.w and st.i = last.i group by w order by w
"""

#: The same of one word whose rows are replaced by their key; -1 marks what is contracted away.
_WIDE_ROUNDS = """
with recursive st(k, tok) using key (k) as (
  select k, tok from given
  union all
  (with s as (select k, tok, lead(tok) over (order by k) as nxt, lead(k) over (order by k) as after from recurring.st where tok >= 0),
   best as (select k, after, new from s join merges m on m.l = s.tok and m.r = s.nxt order by new, k limit 1)
   select k, new from best union all select after, -1 from best)
)
select tok from st where tok >= 0 order by k
"""


#: Tokens of a document in the order of their positions, each looked up in the vocabulary's list.
_DECODE = """
with seq as (select d, list_sort(list((p::bigint << 32) | tok)) as ids from given group by d)
select d, array_to_string(list_transform(ids, lambda x: parts[(x & 4294967295) + 1]), '') as s from seq, vocab
"""


class Vocabulary:
    """A rank file (base64 token and rank a line) with its splitting pattern, loaded into a DuckDB connection."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # The library reads \s as the Unicode property; Python's own class is wider.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        left, right, new = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), new.append(rank)
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        self.sql.register("m", pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "new": pa.array(new, pa.int32())}))
        self.sql.execute("create table merges as select * from m")
        self.sql.unregister("m")
        self.sql.register("v", pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "part": [k.decode("latin-1") for k in self.ranks]}))
        self.sql.execute("create table vocab as select list(part order by i) as parts from range((select max(tok) + 1 from v)) t(i) left join v on tok = i")
        self.sql.unregister("v")
        self.parts = {rank: token for token, rank in self.ranks.items()}
        self.named = np.zeros(max(self.ranks.values()) + 1, dtype=bool)
        self.named[list(self.ranks.values())] = True
        self.memory = Memory(REMEMBERED)

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (none of them empty), by the recursive query."""
        size = np.array([len(x) for x in words], dtype=np.int64)
        flat = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        self.sql.register("given", pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), size), "p": at.astype(np.int32), "tok": flat}))
        self.sql.execute("create or replace temp table words as select * from given")
        self.sql.unregister("given")
        ids = self.sql.sql(_ROUNDS).to_arrow_table().column("ids").combine_chunks()
        values, ends = ids.values.to_numpy().astype(np.uint32), ids.offsets.to_numpy()
        return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _merge_wide(self, word: bytes) -> np.ndarray:
        """The ids of one word of any length; its rows are kept once, and a round each contracts one pair."""
        self.sql.register("given", pa.table({"k": np.arange(len(word), dtype=np.int32), "tok": self.byte[np.frombuffer(word, dtype=np.uint8)]}))
        ids = self.sql.sql(_WIDE_ROUNDS).to_arrow_table().column("tok").to_numpy().astype(np.uint32)
        self.sql.unregister("given")
        return ids

    def _encode_short(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        """The ids of distinct words by the recursive query, all in one piece."""
        out, todo, start = {}, sorted(words, key=len), 0
        while start < len(todo):
            end, rows = start, 0
            while end < len(todo) and end - start < WORDS_AT_ONCE and len(todo[end]) < WIDE and (end == start or rows + len(todo[end]) ** 2 // 2 <= ROWS_AT_ONCE):
                rows += len(todo[end]) ** 2 // 2
                end += 1
            if end > start:
                out.update(zip(todo[start:end], self._merge(todo[start:end]), strict=True))
            else:
                out[todo[start]], end = self._merge_wide(todo[start]), start + 1
            start = end
        return out

    def _encode_words(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        """The ids of each distinct match of the pattern."""
        out = {x: np.array([self.ranks[x]], dtype=np.uint32) for x in words if x in self.ranks}
        out.update(self._encode_short([x for x in words if len(x) <= LONG and x not in out]))
        todo, start = [x for x in words if x not in out], 0
        while start < len(todo):
            end, total = start, 0
            while end < len(todo) and (end == start or total + len(todo[end]) <= BYTES_AT_ONCE):
                total += len(todo[end])
                end += 1
            out.update(zip(todo[start:end], self._encode_long(todo[start:end]), strict=True))
            start = end
        return out

    def _encode_long(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words of any length, by windows."""
        known: dict[bytes, list[int]] = {}

        def learn(texts) -> None:
            new = list(dict.fromkeys(t for t in texts if t not in known))
            if new:
                known.update((t, ids.tolist()) for t, ids in self._encode_short(new).items())

        def look(text: bytes) -> list[int]:
            learn([text])
            return known[text]

        cut = [[word[k : k + WINDOW] for k in range(0, len(word), WINDOW)] for word in words]
        learn(c for some in cut for c in some)
        # What the borders will need is mostly known from the windows on either side of each, so it is encoded together.
        open_ = {(a, b): None for some in cut for a, b in zip(some, some[1:])}
        asks = [[self._join(list(known[a]), known[b]), None] for a, b in open_]
        for _ in range(LOOKS):
            asks = [[join, text] for join, text in ((join, next(join, None) if text is None else join.send(known[text])) for join, text in asks) if text is not None]
            if not asks:
                break
            learn(text for _, text in asks)
        out = []
        for some in cut:
            ids: list[int] = []
            for window in some:
                join = self._join(ids, known[window])
                text = next(join, None)
                while text is not None:
                    text = join.send(look(text))
            out.append(np.array(ids, dtype=np.uint32))
        return out

    def _join(self, ids: list[int], more: list[int]):
        """Appends ``more`` to ``ids``, both encodings of what they spell, so that all is one: yields each text whose
        encoding it needs to know, then None."""
        spell = lambda some: b"".join(self.parts[t] for t in some)
        at, reach = 0, 1
        while ids and at < len(more):
            reach = min(reach, len(ids))
            held = [*ids[-reach:], more[at]]
            new = yield spell(held)
            if reach < len(ids) and new[0] != held[0]:
                pair = [ids[-reach - 1], new[0]]
                if (yield spell(pair)) != pair:
                    reach *= 2
                    continue
            # The border is behind ``new`` now, and is one no more if its last token was there before.
            ids[-reach:] = new
            at, reach = at + 1, 1
            if new[-1] == held[-1]:
                break
        ids += more[at:]
        yield None

    def _matches(self, part: bytes) -> list[bytes]:
        text = part.decode("utf-8")
        word = text[1:] if text[0] == " " else text
        if word.isalpha() and max(word) < "\u0250":  # letters behind at most one space are one match
            return [part]
        return [m.encode("utf-8") for m in self.split(text)]

    def _encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        matches = [self._matches(p) for p in parts.to_pylist()]
        words = self._encode_words(list({m for found in matches for m in found}))
        done = [words[found[0]] if len(found) == 1 else np.concatenate([words[m] for m in found]) for found in matches]
        return np.concatenate(done), np.fromiter(map(len, done), np.int64, len(done))

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a column (null: none), and the number of ids of each."""
        return self.memory.encode(col, self._encode_parts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, n = self.encode_column(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        return [ids[b - k : b].astype("<u4").tobytes() for b, k in zip(ends, n, strict=True)]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes behind each document's ids; an id outside the vocabulary is an error."""
        n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        return self.decode_column(np.frombuffer(b"".join(ids), dtype="<u4"), n).to_pylist()

    def decode_column(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """As ``decode``, of all ids in a row and their number in each document; in windows of ``TOKENS_AT_ONCE`` ids."""
        if len(ids) and (ids.max() >= len(self.named) or not self.named[ids].all()):
            raise ValueError("an id is outside the vocabulary")
        doc, out = np.repeat(np.arange(len(n), dtype=np.int32), n), [b""] * len(n)
        for at in range(0, len(ids), TOKENS_AT_ONCE):
            some = slice(at, at + TOKENS_AT_ONCE)
            self.sql.register("given", pa.table({"d": doc[some], "p": np.arange(len(ids[some]), dtype=np.int32), "tok": ids[some].astype(np.int32)}))
            for d, s in self.sql.sql(_DECODE).fetchall():
                out[d] += s.encode("latin-1")
            self.sql.unregister("given")
        return pa.array(out, pa.binary())


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file, loaded once a worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary(path, pattern)
    return _LOADED[path, pattern]


def _mapper(path: str, pattern: str, keep: list[str], mode: str, remembered: int, nbytes: int):
    def run(batches):
        v = vocabulary(path, pattern)
        v.memory.most = remembered
        for batch in batches:
            column = "ids" if mode == "decode" else "text"
            for part in slices(batch, 2048, nbytes, column):
                cols = [part.column(k) for k in keep]
                names = list(keep)
                if mode == "decode":
                    raw, bounds = column_bytes(part.column("ids"))
                    ids, n = raw.view("<u4"), np.diff(bounds) // 4
                else:
                    ids, n = v.encode_column(part.column("text"))
                    cols += [pa.array(n, pa.int64()), binary_column(ids, n)]
                    names += ["n_tokens", "ids"]
                if mode != "encode":
                    cols.append(v.decode_column(ids, n))
                    names.append("decoded")
                done = pa.RecordBatch.from_arrays(cols, names)
                for at in range(0, done.num_rows, 256):  # small batches keep the reader's buffers small
                    yield done.slice(at, 256)
                del part, ids, n, cols, done
            del batch
            give_back()

    return run


def _apply(df: DataFrame, path: str, pattern: str, mode: str, source: str, keep: list[str], added: str, remembered: int = REMEMBERED, nbytes: int = 4 << 20) -> DataFrame:
    ship(df.sparkSession)
    fields = ", ".join(f"`{k}` {t}" for k, t in df.select(*keep).dtypes) if keep else ""
    return df.select(*keep, source).mapInArrow(_mapper(path, pattern, keep, mode, remembered, nbytes), ", ".join(x for x in (fields, added) if x))


def encode(documents: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_tokens and ids (little-endian unsigned 32-bit) of ``text``, one row for each input row.

    A null text counts as empty and has no ids. Special tokens are not known: their strings are ordinary text.
    """
    return _apply(documents, path, pattern, "encode", "text", list(keep), "n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with the bytes that the column ``ids`` stands for (null: none)."""
    return _apply(encoded, path, pattern, "decode", "ids", list(keep), "decoded binary")


def round_trip(documents: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), remembered: int = REMEMBERED, nbytes: int = 4 << 20) -> DataFrame:
    """``encode`` and then ``decode`` of its ids in one pass over the rows.

    A worker remembers the encodings of so many parts and works on about so many bytes of text at once.
    """
    return _apply(documents, path, pattern, "both", "text", list(keep), "n_tokens long, ids binary, decoded binary", remembered, nbytes)
