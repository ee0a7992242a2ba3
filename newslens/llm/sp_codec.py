"""SentencePiece encoding and decoding for merge-type vocabularies (operator 4).

Each text is escaped as the library does it (a space in front, spaces written as
U+2581) and cut into chunks that no vocabulary piece can span.  Every chunk has a
score-ordered agenda of adjacent symbol pairs: the pair whose joint piece has the
best score is merged first, the leftmost among equals, and the pairs that the merge
makes join the agenda.  A long chunk works its agenda off with a heap; short ones,
which are nearly all, advance together in numpy, one merge each per round.  Symbols
outside the vocabulary become byte pieces.  Decoding joins the pieces and the UTF-8
of byte pieces.

A chunk ends before U+2581 (if no piece holds one after another character) and
around line ends and tabs (if no longer piece holds them); both are read off the
vocabulary.  Results of chunks are kept in two per-task dictionaries of bounded
size, so that those met again and again stay.

Every Arrow batch is checked against the sentencepiece library: each chunk that is
new to the task, and one whole text, must encode and decode alike; a difference
fails the job.

Nulls and empty texts have no ids and decode to the empty text.  Texts of any
length are encoded whole.  Repeated rows give repeated results; an empty table
gives no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from newslens.llm.common import in_arrow, text_slices

BLANK = "\u2581"
KEPT_CHUNKS = 300_000
KEPT_LENGTH = 48
NEVER = np.int64(1) << 62
PLACE = 32  # bits of a position beside a rank


class Codec:
    """A merge vocabulary read from a model file: encode and decode."""

    def __init__(self, model: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not handled")
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.cost = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.unknown = sp.unk_id()
        raw = {i: bytes([b]) for b, i in self.bytes.items()}
        raw |= {i: sp.id_to_piece(i).replace(BLANK, " ").encode() for i in plain}
        raw[self.unknown] = " \u2047 ".encode()
        self.raw = [raw.get(i, b"") for i in range(n)]
        self.word = [str(i) for i in range(n)]
        self.chunk = re.compile(self._chunks(), re.DOTALL)
        self._pairs(n)
        self.kept: dict[str, str] = {}  # the ids of a chunk
        self.older: dict[str, str] = {}  # those kept before; what is met again goes over to `kept`
        self.odd: dict[str, str] = {}  # the decoded text of kept chunks that is not the chunk with its blanks

    def _chunks(self) -> str:
        pieces = [p for p in self.ids if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            return r".+"
        joined = {c for p in pieces for c in p}
        alone = re.escape("".join(c for c in "\n\r\t" if c not in joined))
        return f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|[{alone}]" if alone else "")

    def _pairs(self, n: int) -> None:
        """Symbol numbers (ids, then characters that are no piece) and the sorted table of pairs that make a piece."""
        number = dict(self.ids)
        for p in self.ids:
            for c in p:
                number.setdefault(c, n + len(number))
        self.number_of = np.full(0x110000, -1, np.int64)
        for p, i in number.items():
            if len(p) == 1:
                self.number_of[ord(p)] = i
        ranks = {c: r for r, c in enumerate(sorted(set(self.cost.values())))}
        table = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    table[a << 32 | b] = (ranks[self.cost[p]], i)
        keys = sorted(table)
        self.pair = np.array([*keys, NEVER], np.int64)
        self.pair_rank = np.array([*(table[k][0] for k in keys), -1], np.int64)
        self.pair_makes = np.array([*(table[k][1] for k in keys), -1], np.int64)

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER where the two don't join) and joint symbol of pairs."""
        key = np.where((a < 0) | (b < 0), np.int64(-1), a << np.int64(32) | b)
        at = np.searchsorted(self.pair, key)
        hit = self.pair[at] == key
        return np.where(hit, self.pair_rank[at], NEVER), np.where(hit, self.pair_makes[at], -1)

    def merge(self, chunk: str) -> list[str]:
        """The pieces of one chunk, by a heap of adjacent pairs."""
        cost, part = self.cost, list(chunk)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i, i + 1, 2) for i in range(n - 1) if (c := cost.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not part[i] or not part[j] or len(part[i]) + len(part[j]) != size or after[i] != j:
                continue  # a neighbour has changed since
            part[i] += part[j]
            part[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (c := cost.get(part[i] + part[k])) is not None:
                    heapq.heappush(agenda, (c, i, k, len(part[i]) + len(part[k])))
            if (h := before[i]) >= 0 and (c := cost.get(part[h] + part[i])) is not None:
                heapq.heappush(agenda, (c, h, i, len(part[h]) + len(part[i])))
        return [p for p in part if p]

    def merge_many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of many chunks, in order, and each chunk's end among them: all agendas advance by one merge per round."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbol = self.number_of[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(chunks)), sizes)
        rank, makes = self._look(symbol, np.append(symbol[1:], -1))
        rank[np.cumsum(sizes) - 1] = NEVER
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(np.where(rank == NEVER, NEVER, rank << np.int64(PLACE) | np.arange(len(rank))), starts)
            at = best & np.int64((1 << PLACE) - 1)
            done = best == NEVER
            if done.any():
                live = np.repeat(~done, np.diff(np.append(starts, len(symbol))))
                ended.append((owner[~live], symbol[~live]))
                at = (np.cumsum(live) - 1)[at[~done]]
                symbol, owner, rank, makes = (x[live] for x in (symbol, owner, rank, makes))
                if not len(symbol):
                    break
            symbol[at] = makes[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            symbol, owner, rank, makes = (x[keep] for x in (symbol, owner, rank, makes))
            new = np.concatenate([at, at[at > 0] - 1])
            follows = np.minimum(new + 1, len(symbol) - 1)
            rank[new], makes[new] = self._look(symbol[new], symbol[follows])
            rank[new[(owner[follows] != owner[new]) | (follows == new)]] = NEVER
        owner, symbol = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.searchsorted(owner[order], np.arange(len(chunks)), side="right")

    def _ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def chunks(self, text: str | None) -> list[str]:
        return self.chunk.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that are not kept yet, and compare each with the library."""
        new = [c for c in chunks if c not in self.kept]
        if self.kept and len(self.kept) + len(new) > KEPT_CHUNKS // 2:
            self.older, self.kept = self.kept, {c: self.kept[c] for c in chunks if c in self.kept}
            self.odd = {c: t for c, t in self.odd.items() if c in self.older}
        self.kept |= {c: ids for c in new if (ids := self.older.get(c)) is not None}
        new = [c for c in new if c not in self.kept]
        short = [c for c in new if len(c) <= KEPT_LENGTH]
        found: list[tuple[str, list[int], str]] = [(c, i := self._ids(self.merge(c)), self._text(i)) for c in new if len(c) > KEPT_LENGTH]
        if short:
            symbols, ends = self.merge_many(short)
            strange = (np.add.reduceat((symbols < 0) | (symbols >= len(self.raw)), np.append(0, ends[:-1])) > 0).tolist()
            symbols, ends = symbols.tolist(), ends.tolist()
            for c, a, b, odd in zip(short, [0, *ends], ends, strange, strict=False):
                ids = self._ids(self.merge(c)) if odd else symbols[a:b]
                found.append((c, ids, self._text(ids) if odd else c.replace(BLANK, " ")))  # without byte pieces, the pieces are the chunk
        lead = self._ids([BLANK]) + self._ids(["\n"])
        asked = [c[1:].replace(BLANK, " ") if c[0] == BLANK else "\n" + c for c, _, _ in found]
        for (c, ids, text), theirs in zip(found, self.library.encode(asked, num_threads=1), strict=True):
            if theirs != (ids if c[0] == BLANK else lead + ids) and c != BLANK:  # one blank alone stands for the space in front
                raise RuntimeError(f"{c!r}: other ids than the library's")
            self.kept[c] = ",".join([self.word[i] for i in ids])
            if text != c.replace(BLANK, " "):
                self.odd[c] = text

    def joined(self, parts: list[str]) -> tuple[str, str]:
        """The ids and the decoded text of the kept chunks of a text."""
        if not self.odd or self.odd.keys().isdisjoint(parts):
            back = "".join(parts).replace(BLANK, " ")
        else:
            back = "".join([t if (t := self.odd.get(c)) is not None else c.replace(BLANK, " ") for c in parts])
        return ",".join([self.kept[c] for c in parts]), back.removeprefix(" ")

    def _text(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")

    def encode(self, text: str | None) -> list[int]:
        parts = self.chunks(text)
        self.learn(set(parts))
        return [int(i) for c in parts for i in self.kept[c].split(",")]

    def decode(self, ids: list[int]) -> str:
        return self._text(ids).removeprefix(" ")


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, [ids array, decoded text,] ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    extra = "ids array<int>, decoded string, " if with_ids else ""
    spark.sparkContext.addFile(model)  # executors need not hold the vocabulary file
    name = model.rsplit("/", 1)[-1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the kept chunks hold no cycles, and walking over them takes longer than the work
        codec = Codec(SparkFiles.get(name))
        sha = hashlib.sha256
        for batch in batches:
            for k, part in enumerate(text_slices(batch, text_col, most=1 << 18)):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                parts = [codec.chunks(t) for t in texts]
                codec.learn(set().union(*parts))
                ids, back = zip(*(codec.joined(x) for x in parts), strict=True)
                if not k:
                    theirs = codec.library.encode(texts[0])
                    if ",".join(map(str, theirs)) != ids[0] or codec.library.decode(theirs) != back[0]:
                        raise RuntimeError("a text differs from the library's result")
                columns = {id_col: part.column(id_col), "n_tokens": pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64())}
                if with_ids:
                    flat = np.fromiter((int(i) for x in ids if x for i in x.split(",")), np.int32)
                    ends = np.cumsum([0, *columns["n_tokens"].to_pylist()]).astype(np.int32)
                    columns |= {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), "decoded": pa.array(back, pa.string())}
                columns |= {
                    "ids_sha256": pa.array([sha(x.encode()).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([sha(x.encode()).hexdigest() for x in back], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(columns)
        gc.enable()

    return in_arrow(docs.select(id_col, text_col), encode, f"`{id_col}` {kind}, n_tokens long, {extra}ids_sha256 string, decoded_sha256 string")
