"""SentencePiece merge-type (BPE) encoding by a prefix table, and decoding.

Every prefix of a merge-encoded text has one possible last token.  The table
holds it for each prefix: an automaton over the vocabulary gives the tokens that
end at a position, and the one whose left neighbour (the last token of the
prefix before it) would not have merged with it across their border is the
entry.  Walking the table backwards from the end recovers the ids.

Pieces hold the blank mark only in front, so no merge crosses the border
before a mark that follows another character: texts are cut there and each chunk
is encoded on its own.  Characters outside the vocabulary never merge and become
byte pieces.  Runs of blank marks have equal scores, for which the last
token of a prefix is not unique; a chunk with such a run is merged pair by pair.

Defined results: null and empty texts have no ids and decode to nothing;
repeated rows are encoded alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm.chunks import DistinctChunks, join_texts
from stepwise.llm.common import share, slices, worker_cache

MARK = "▁"
#: A worker keeps this many encoded chunks of at most CHUNK_CHARS characters.
CACHE_CHUNKS, CHUNK_CHARS = 300_000, 40
#: Texts encoded together, in bytes.
BATCH_BYTES = 6 << 20
_BASE = -1
_NEVER = 1 << 30
_BORDER = re.compile(f"(?<=[^{MARK}])(?={MARK})")


@dataclass
class PieceTable:
    """Vocabulary of a merge-type model: ranks by falling score, and each piece's last merge."""
    ids: dict[str, int]
    rank: dict[str, int]
    split: dict[str, tuple[str, str]]
    pieces: list[str]
    byte_of: dict[int, int]
    byte_ids: list[int]
    silent: frozenset[int]
    prefix: bool = True
    automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}

    def matcher(self):
        if self.automaton is None:
            import ahocorasick
            self.automaton = ahocorasick.Automaton()
            for p in self.rank:
                self.automaton.add_word(p, p)
            self.automaton.make_automaton()
        return self.automaton


def load_table(model: bytes) -> PieceTable:
    """Read a model file; raises for models this method does not cover."""
    import sentencepiece as sp
    m = sp.SentencePieceProcessor(model_proto=model)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(i) for i in range(n)]
    byte_of = {i: int(pieces[i][1:-1], 16) for i in range(n) if m.is_byte(i)}
    if len(byte_of) != 256:
        raise ValueError("the model has no byte pieces")
    byte_ids = [0] * 256
    for i, b in byte_of.items():
        byte_ids[b] = i
    plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    if any(MARK in pieces[i].lstrip(MARK) for i in plain):
        raise ValueError("pieces with a blank inside are not covered")
    probe = m.encode("x  　Ａ  y ", out_type=str)
    if m.decode(m.encode("x  　Ａ  y ")) != "x  　Ａ  y " or not probe[0].startswith(MARK):
        raise ValueError("models that normalise texts, or add no blank in front, are not covered")
    ids = {pieces[i]: i for i in plain}
    order = sorted((i for i in plain if len(pieces[i]) > 1), key=lambda i: -m.get_score(i))
    score_rank, last = {}, None
    for i in order:  # equal scores share a rank
        if last is None or m.get_score(i) != last[0]:
            last = (m.get_score(i), len(score_rank))
        score_rank[pieces[i]] = last[1]
    t = PieceTable(ids, {**{p: _BASE for p in ids if len(p) == 1}, **score_rank}, {}, pieces, byte_of, byte_ids,
                   frozenset(i for i in range(n) if m.is_control(i)))
    usable: dict[str, int] = {}
    for p, r in t.rank.items():
        if r == _BASE:
            usable[p] = r
        elif p.strip(MARK):
            parts, final = merge(t.rank, p)
            if len(parts) == 1:
                if max(t.rank[final[0]], t.rank[final[1]]) >= r:
                    raise ValueError("a piece ranks before its parts: the model is not of the merge type")
                usable[p] = r
                t.split[p] = final
    t.full_rank = t.rank  # every mergeable piece, for border tests and merging by pairs
    t.rank = usable
    return t


def merge(rank: dict[str, int], chunk: str) -> tuple[list[str], tuple[str, str] | None]:
    """Merge adjacent symbols, best score first and leftmost among equals; the symbols left and the last merge."""
    sym: list[str] = list(chunk)
    nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
    heap: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < len(sym) and (r := rank.get(sym[i] + sym[j])) is not None:
            heappush(heap, (r, i, sym[i] + sym[j]))

    for i in range(len(sym) - 1):
        offer(i)
    final = None
    while heap:
        _, i, whole = heappop(heap)
        j = nxt[i]
        if not sym[i] or j >= len(sym) or sym[i] + sym[j] != whole:
            continue
        final = (sym[i], sym[j])
        sym[i], sym[j] = whole, ""
        nxt[i] = nxt[j]
        if nxt[j] < len(sym):
            prv[nxt[j]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [s for s in sym if s], final


def compatible(t: PieceTable, left: str, right: str) -> bool:
    """Whether merging ``left + right`` ends in these two tokens: undo their
    merges, latest first, and look for a merge across the border that would have
    come before the merge undone last."""
    rank, full = t.rank, t.full_rank
    before, ties = _NEVER, False
    while True:
        across = full.get(left + right)
        if across is not None and (across < before or ties and across == before):
            return False
        a, b = rank[left], rank[right]
        if a == _BASE and b == _BASE:
            return True
        if a > b:  # a merge on the left comes first among equals
            before, ties, left = a, False, t.split[left][1]
        else:
            before, ties, right = b, True, t.split[right][0]


def prefix_tokens(t: PieceTable, chunk: str, fits: dict) -> list[str]:
    """Tokens of a chunk of known characters through its prefix table."""
    if chunk in t.rank:
        return [chunk]
    last: list[str | None] = [None] * (len(chunk) + 1)
    rank = t.rank
    for end, piece in t.matcher().iter(chunk):
        end += 1
        if last[end] is not None:
            continue
        start = end - len(piece)
        if start:
            before = last[start]
            if before is None:
                continue
            pair = (before, piece)
            ok = fits.get(pair)
            if ok is None:
                if len(fits) >= 1_000_000:
                    fits.clear()
                ok = fits[pair] = compatible(t, before, piece)
            if not ok:
                continue
        last[end] = piece
    out = []
    at = len(chunk)
    while at:
        piece = last[at]
        out.append(piece)
        at -= len(piece)
    out.reverse()
    return out


def encode_chunk(t: PieceTable, chunk: str, fits: dict) -> list[int]:
    if MARK + MARK in chunk:
        parts = merge(t.full_rank, chunk)[0]
    elif all(map(t.rank.__contains__, chunk)):
        parts = prefix_tokens(t, chunk, fits)
    else:
        parts, run = [], ""
        for c in chunk:
            if c in t.rank:
                run += c
                continue
            if run:
                parts += prefix_tokens(t, run, fits)
                run = ""
            parts.append(c)
        if run:
            parts += prefix_tokens(t, run, fits)
    out: list[int] = []
    for p in parts:
        i = t.ids.get(p)
        if i is None:
            out += [t.byte_ids[b] for b in p.encode()]
        else:
            out.append(i)
    return out


def chunks(text: str) -> list[str]:
    """The text with a blank in front, cut before each blank that follows another character."""
    if not text:
        return []
    flat = MARK + text.replace(" ", MARK)
    if MARK + MARK in flat:
        return _BORDER.split(flat)
    return [MARK + w for w in flat.split(MARK)[1:]]


def decode_ids(t: PieceTable, ids: list[int]) -> str:
    """Text of whole chunks: pieces joined, byte runs decoded, marks as blanks."""
    out: list[str] = []
    raw = bytearray()
    for i in ids:
        b = t.byte_of.get(i)
        if b is not None:
            raw.append(b)
            continue
        if raw:
            out.append(_utf8(bytes(raw)))
            raw.clear()
        if i not in t.silent:
            out.append(t.pieces[i].replace(MARK, " "))
    if raw:
        out.append(_utf8(bytes(raw)))
    return "".join(out)


def _utf8(raw: bytes) -> str:
    """Bytes as text, one replacement character for each byte outside a valid character."""
    out = ""
    while raw:
        try:
            return out + raw.decode()
        except UnicodeDecodeError as e:
            out += raw[: e.start].decode() + "�"
            raw = raw[e.start + 1:]
    return out


def strip_front(text: str) -> str:
    return text[1:] if text.startswith(" ") else text


def encode(t: PieceTable, text: str, fits: dict | None = None) -> list[int]:
    fits = {} if fits is None else fits
    return [i for c in chunks(text) for i in encode_chunk(t, c, fits)]


def encode_decode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): ids as decimal text joined by commas, and the
    text that the ids decode to."""
    shared = share(df.sparkSession, load_table(model))
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared()
        t.matcher()
        known, fits = worker_cache("piece-chunks", dict), worker_cache("piece-fits", dict)

        def look(chunk: str) -> tuple[bytes, int, bytes]:
            ids = encode_chunk(t, chunk, fits)
            got = ("".join([f",{i}" for i in ids]).encode(), len(ids), decode_ids(t, ids).encode())
            if len(chunk) <= CHUNK_CHARS and len(known) < CACHE_CHUNKS:
                known[chunk] = got
            return got

        for b in slices(batches, "text", BATCH_BYTES):
            if len(known) >= CACHE_CHUNKS:
                known.clear()
            # a blank in front of each text; a mark in a text is a blank to the model
            data, starts = join_texts([(x or "").replace(MARK, " ") for x in b.column("text").to_pylist()], " ")
            at = np.flatnonzero((data[1:] == 32) & (data[:-1] != 32)) + 1
            first = np.zeros(len(data) + 1, bool)
            first[starts] = True
            at = at[~first[at]]
            c = DistinctChunks(data, starts, at)
            got = []
            for s, n in zip(c.starts[c.first].tolist(), c.sizes[c.first].tolist()):
                chunk = data[s:s + n].tobytes().decode().replace(" ", MARK)
                got.append(known.get(chunk) or look(chunk))
            counts = np.array([g[1] for g in got], np.int64)
            totals = np.r_[0, np.cumsum(counts[c.inverse])][c.text_chunks]

            def texts_of(k: int) -> pa.Array:
                """Joined results per text, without the character in front."""
                ends = np.r_[0, np.cumsum([len(g[k]) for g in got], dtype=np.int64)]
                flat, at = c.gather(np.frombuffer(b"".join([g[k] for g in got]), np.uint8), ends)
                raw = flat.tobytes()
                return pa.array([raw[s + 1:e].decode() if e > s else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())

            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(totals)), texts_of(0), texts_of(2)], ["id", "n_tokens", "ids", "decoded"])

    return src.mapInArrow(run, f"id {id_type}, n_tokens long, ids string, decoded string")
