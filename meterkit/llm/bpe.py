"""BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of a text's prefix by ranked merges ends in one token only. So
for every prefix it is enough to store that last token: of the vocabulary's
tokens that are suffixes of the prefix (the longest of each found in one walk of
an automaton with suffix links over the vocabulary, the others by such links
between tokens), it is the one that is compatible with the stored last token of
the prefix before it: encoding the joint bytes of the two gives back just these
two. The program starts at the whole text and settles a shorter prefix when a
longer one asks for it, each once; following the back-pointers from the whole
text yields its exact ids. It runs over each piece that the tokenizer's first
split makes. The new short pieces of many texts go through it together, a byte
further at a time, as arrays.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from meterkit.llm import pretokens
from meterkit.llm import words as W
from meterkit.llm.scratch import free_name, numbered

#: Pieces whose ids a Python worker remembers (some 250 bytes each): those of
#: the last REMEMBERED new ones, and of the REMEMBERED before.
REMEMBERED = 120_000
#: Neighbouring tokens whose compatibility a worker remembers (some 130 bytes each).
PAIRS = 180_000
#: Pieces up to this many bytes are settled together, so many at a time.
SHORT, TOGETHER = 64, 20_000
#: Places for compatibilities of pairs in arrays, as a power of two (9 bytes each).
PLACES = 18
#: Above every token id.
IDS = 1 << 32
NEVER = 1 << 60
#: Below every rank: that of tokens that no merge makes.
UNMADE = -1


def merge_by_rank(tables: pretokens.ByteBpe, data: bytes) -> list[int]:
    """Ids of ``data`` by applying merges in rank order (for short bytes)."""
    ids = [tables.vocab[data[i:i + 1]] for i in range(len(data))]
    while len(ids) > 1:
        best = min((tables.merges.get(p, (1 << 60, 0)) + (i,) for i, p in enumerate(zip(ids, ids[1:]))))
        if best[0] == 1 << 60:
            break
        pair, out, i = (ids[best[2]], ids[best[2] + 1]), [], 0
        while i < len(ids):
            if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                out.append(best[1])
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


class Encoder(dict):
    """Piece to its ids as text ("12,345"), worked out once per new piece."""

    def __init__(self, content: str):
        self.tables = tables = pretokens.load(content)
        self.token = {i: t for t, i in tables.vocab.items()}
        self.special = {s: str(i) for s, i in tables.special.items()}
        self.bytes_of = {str(i): t for i, t in self.token.items()} | {str(i): s.encode() for s, i in tables.special.items()}
        # bytes as letters, for the automaton holds text
        self.automaton = ahocorasick.Automaton()
        for t, i in tables.vocab.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.size = {i: len(t) for t, i in tables.vocab.items()}
        # the longest other token that ends as a token does
        self.shorter = {i: next((tables.vocab[t[k:]] for k in range(1, len(t)) if t[k:] in tables.vocab), None)
                        for t, i in tables.vocab.items()}
        # bytes that no token stands for: the library leaves them out before it merges
        self.unknown = bytes(b for b in range(256) if bytes([b]) not in tables.vocab)
        # token -> the rank and pair of the merge that makes it
        self.made_of = {i: (UNMADE, (i, i)) for i in self.token}
        made = {out: (rank, pair) for pair, (rank, out) in tables.merges.items()}
        if len(made) < len(tables.merges):
            raise ValueError("several merges make the same token")
        self.made_of.update(made)
        self.pair: dict[int, bool] = {}  # by left * IDS + right
        self.said = {i: str(i) for i in self.token}
        self.older: dict[str, str] = {}
        # the tables once more as arrays, by token; tokens are counted from 1 in ``last`` and keys, 0 is none
        self.ids = max(self.token, default=0) + 2
        self.sizes, self.made, self.of_left, self.of_right = np.ones((4, self.ids), dtype=np.int64)
        for i, (rank, pair) in self.made_of.items():
            self.sizes[i], self.made[i], self.of_left[i], self.of_right[i] = self.size[i], rank, *pair
        keys = np.array([a * self.ids + b for a, b in tables.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.merge_keys = np.append(keys[order], NEVER)
        self.merge_ranks = np.append(np.array([rank for rank, _ in tables.merges.values()], dtype=np.int64)[order], NEVER)
        self.place_keys, self.place_fits = np.full(1 << PLACES, -1, dtype=np.int64), np.zeros(1 << PLACES, dtype=bool)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side in an encoding; with
        ``left`` -1, whether ``right`` can stand alone.

        Merges happen in rank order, so the pair at the border changes only
        when a merge swallows one of the two. The tokens are incompatible if at
        some time the pair at the border merges before that; of equal ranks,
        the merge further left comes first.
        """
        known = self.pair.get(left * IDS + right)
        if known is None:
            if len(self.pair) >= PAIRS:
                self.pair.clear()
            known = self.pair[left * IDS + right] = self._alone(right) if left < 0 else self._side_by_side(left, right)
        return known

    def _alone(self, token: int) -> bool:
        return merge_by_rank(self.tables, self.token[token]) == [token]

    def _side_by_side(self, left: int, right: int) -> bool:
        # back in time from the two whole tokens: each step undoes the last merge
        merges, made_of = self.tables.merges.get, self.made_of
        left_gone = right_gone = NEVER  # ranks of the merges that swallow the two
        while True:
            joined = merges((left, right))
            if joined and joined[0] < left_gone and joined[0] <= right_gone:
                return False
            (left_made, of_left), (right_made, of_right) = made_of[left], made_of[right]
            if left_made >= right_made:
                if left_made == UNMADE:
                    return True
                left_gone, left = left_made, of_left[1]
            if right_made >= left_made:
                right_gone, right = right_made, of_right[0]

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if self.unknown:
            data = data.translate(None, self.unknown)
        if not data:
            return []
        # of each prefix, by its last byte: the token to try next (the longest first), and the one that fits
        tried: list = [None] * len(data)
        for end, token in self.automaton.iter(data.decode("latin-1")):
            if tried[end] is None:
                tried[end] = token
        last: list = [None] * len(data) + [-1]  # at -1: nothing before
        known, test, size, shorter = self.pair.get, self.compatible, self.size, self.shorter
        end, waiting = len(data) - 1, []
        while True:
            token = tried[end]
            before = end - size[token]
            left = last[before]
            if left is None:
                waiting.append(end)
                end = before
                continue
            fits = known(left * IDS + token)
            if fits or fits is None and test(left, token):
                last[end] = token
                if not waiting:
                    break
                end = waiting.pop()
            else:
                tried[end] = shorter[token]
        ids, end = [], len(data) - 1
        while end >= 0:
            token = last[end]
            ids.append(token)
            end -= size[token]
        ids.reverse()
        return ids

    def _all_side_by_side(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_side_by_side`` of many pairs, all a step back at a time."""
        out, at = np.ones(len(left), dtype=bool), np.arange(len(left))
        left_gone = right_gone = np.full(len(left), NEVER)
        while len(at):
            key = left * self.ids + right
            i = np.searchsorted(self.merge_keys, key)
            joined = np.where(self.merge_keys[i] == key, self.merge_ranks[i], NEVER)
            joins = (joined < left_gone) & (joined <= right_gone)
            out[at[joins]] = False
            left_made, right_made = self.made[left], self.made[right]
            on = ~joins & (np.maximum(left_made, right_made) != UNMADE)
            undo_left, undo_right = left_made >= right_made, right_made >= left_made
            left_gone, right_gone = np.where(undo_left, left_made, left_gone)[on], np.where(undo_right, right_made, right_gone)[on]
            left, right = np.where(undo_left, self.of_right[left], left)[on], np.where(undo_right, self.of_left[right], right)[on]
            at = at[on]
        return out

    def _all_compatible(self, left: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs, ``left`` counted from 1. A pair's answer
        is kept at one place, until another pair needs it."""
        key = left * self.ids + token
        place = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PLACES)).astype(np.int64)
        fits, new = self.place_fits[place], np.flatnonzero(self.place_keys[place] != key)
        if len(new):
            keys, which = np.unique(key[new], return_inverse=True)
            lefts, rights = keys // self.ids - 1, keys % self.ids
            found, alone = np.zeros(len(keys), dtype=bool), lefts < 0
            found[alone] = [self.compatible(-1, i) for i in rights[alone].tolist()]
            found[~alone] = self._all_side_by_side(lefts[~alone], rights[~alone])
            fits[new] = found[which]
            self.place_keys[place[new]], self.place_fits[place[new]] = key[new], fits[new]
        return fits

    def encode_short(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each of ``pieces``, of 1 to ``SHORT`` bytes that all have tokens."""
        # end to end, each after a letter that is no byte; the automaton starts anew there
        letters = "\u0100" + "\u0100".join(p.decode("latin-1") for p in pieces)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(letters)), dtype=np.int64).reshape(-1, 2)
        ends, tokens = found[:, 0], found[:, 1]
        first = np.searchsorted(ends, np.arange(len(letters)))  # each prefix's longest token; shorter ones follow
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths
        last = np.zeros(len(letters), dtype=np.int64)
        for done in range(lengths.max()):
            at = starts[lengths > done] + done
            tried = first[at]
            while len(at):
                token = tokens[tried]
                fits = self._all_compatible(last[at - self.sizes[token]], token)
                last[at[fits]] = token[fits] + 1
                at, tried = at[~fits], tried[~fits] + 1
        # back from the ends
        ending, at, start = np.zeros(len(letters), dtype=bool), starts + lengths - 1, starts
        while len(at):
            ending[at] = True
            at = at - self.sizes[last[at] - 1]
            on = at >= start
            at, start = at[on], start[on]
        ids = (last[ending] - 1).tolist()
        cuts = np.cumsum(ending)[starts + lengths - 1].tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def learn(self, pieces: set[str]) -> None:
        """Works out the new ones among short ``pieces`` together, and keeps the others."""
        unseen = [p for p in pieces if p not in self]
        self.update((p, self.older[p]) for p in unseen if p in self.older)
        new = [(p, data) for p in unseen if len(p) <= SHORT and p not in self.older and p not in self.special
               and 0 < len(data := p.encode().translate(None, self.unknown)) <= SHORT]
        for i in range(0, len(new), TOGETHER):
            some = new[i:i + TOGETHER]
            for (piece, _), ids in zip(some, self.encode_short([data for _, data in some]), strict=True):
                self[piece] = ",".join(map(self.said.__getitem__, ids))

    def _turn(self) -> None:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> str:
        if piece in self.special:
            return self.special[piece]
        ids = self.older.get(piece)
        if ids is None:
            ids = ",".join(map(self.said.__getitem__, self.encode_bytes(piece.encode())))
        if len(piece) <= SHORT:
            self._turn()
            self[piece] = ids
        return ids

    def release(self) -> None:
        """Let go of all tables."""
        self.clear()
        self.__dict__.clear()

    def encode(self, text: str) -> str:
        """The ids of a text, joined by commas."""
        return ",".join(map(self.__getitem__, self.tables.pieces(text)))

    def encode_all(self, texts: list[str | None]) -> Iterator[str]:
        """``encode`` of each text (null: empty)."""
        split = [self.tables.pieces(t or "") for t in texts]
        self._turn()
        self.learn(set().union(*split))
        for pieces in split:
            yield ",".join(map(self.__getitem__, pieces))

    def decode(self, ids: str) -> str:
        """The text of ids joined by commas; bytes that are no UTF-8 become
        the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


@contextlib.contextmanager
def encoder(content: str) -> Iterator[Encoder]:
    """A task's encoder for a tokenizer file. It goes with the task: a worker
    that waits for other work would hold some 300 MB of tables and pieces."""
    own = Encoder(content)
    try:
        yield own
    finally:
        own.release()


def _broadcast(df: DataFrame, tokenizer_path: str):
    with open(tokenizer_path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int), the tokens of each whole text.

    A null or empty text has none, nor have bytes that the vocabulary lacks.
    Other columns pass through; where one is named ``ids`` already, the new one
    is ``ids_1``. Rows are independent of each other; an empty table gives an
    empty result.
    """
    name = free_name(df.columns, "ids")
    content = _broadcast(df, tokenizer_path)
    plain, text = numbered(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(content.value) as own:
            for part in (p for batch in batches for p in W.slices(batch, text)):
                ids = [list(map(int, s.split(","))) if s else [] for s in own.encode_all(part.column(text).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names, "ids"])

    return plain.mapInArrow(run, StructType([*plain.schema.fields]).add("ids", ArrayType(IntegerType()))).toDF(*df.columns, name)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of each list of ids, special tokens
    included (a null list gives the empty text; an unknown id is an error).
    Where ``decoded`` is taken, the new column is ``decoded_1``."""
    name = free_name(df.columns, "decoded")
    content = _broadcast(df, tokenizer_path)
    plain, ids_of = numbered(df, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(content.value) as own:
            for batch in batches:
                texts = [own.decode(",".join(map(str, ids or ()))) for ids in batch.column(ids_of).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return plain.mapInArrow(run, StructType([*plain.schema.fields]).add("decoded", StringType())).toDF(*df.columns, name)


def round_trip(df: DataFrame, tokenizer_path: str, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` (of the ids joined by commas)
    and ``decoded_sha256`` (of the text decoded from them): encode and decode in
    one pass. With ``keep_ids`` also ``ids``, and the text stays; else the text
    is dropped, and digests only move. Nulls, clashes and empty tables as in ``encode``."""
    added = StructType().add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    if keep_ids:
        added = added.add("ids", ArrayType(IntegerType()))
    content = _broadcast(df, tokenizer_path)
    plain, text_of = numbered(df, text_col)
    rest = [f for f in plain.schema.fields if keep_ids or f.name != text_of]
    names = [c for c in df.columns if keep_ids or c != text_col] + [free_name(df.columns, f.name) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(content.value) as own:
            for part in (p for batch in batches for p in W.slices(batch, text_of)):
                n, ids_hash, text_hash, ids_of = [], [], [], []
                for ids in own.encode_all(part.column(text_of).to_pylist()):
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                    if keep_ids:
                        ids_of.append(np.fromstring(ids, dtype=np.int32, sep=",") if ids else np.zeros(0, np.int32))
                columns = [*(part.column(f.name) for f in rest), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                if keep_ids:
                    columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in rest), *added.names])

    return plain.mapInArrow(run, StructType([*rest, *added.fields])).toDF(*names)
