"""BPE encoding by a bounded-lookahead streaming transducer, and streaming decoding.

The merge list of a tokenizer file is compiled into a table of tokens. The encoder reads a piece
symbol by symbol and keeps, for the last few prefixes only, the last token of each prefix's
encoding: a token may follow another exactly if the pair encodes to itself, and each prefix has
just one such last token. A token is emitted once every prefix that a later token can still start
from agrees on it. Whether a border stands is settled by so many letters behind it as `lookahead` says, the merge list's
sufficient lookahead: no more than that and a few tokens' length can be pending, so memory does not grow with the text.

Defined results: a null text is encoded as an empty one and gives no ids; white space gives no
ids; rows are encoded one by one, repeated or not; other columns are left out.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common, units

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Steps of the transducer that a worker keeps, and units in each generation of its memory.
STATES, KEPT = 300_000, 100_000


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merges:
    """A merge list compiled for streaming."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank: dict[tuple[str, str], int] = {}
        for r, m in enumerate(merges):
            self.rank.setdefault(tuple(m), r)
        self.longest = max((len(self._symbols(t)) for t in vocab), default=1)
        self.lookahead = self._lookahead()
        self._tokens: dict[str, tuple | None] = {}
        self.states: dict[str | None, After] = {}
        self.learned = 0

    def _lookahead(self) -> int:
        """Letters behind a border that can matter for it. A merge hangs on what follows it only through earlier merges that could take
        the end of its right part away: merges whose left part is such an end. So letters of right parts add up along chains
        of merges of falling rank; the longest chain counts."""
        reach: dict[str, int] = {}  # of left parts: letters behind them that earlier merges can hang on
        most = 1
        for left, right in self.rank:  # by rank
            letters = self._symbols(right)
            n = len(letters) + max(reach.get("".join(letters[k:]), 0) for k in range(len(letters)))
            reach[left] = max(reach.get(left, 0), n)
            most = max(most, n)
        return most

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merged(self, symbols: list[str], halves: dict | None = None) -> list[str]:
        """By the definition: the lowest-ranked pair first, leftmost first. For single tokens and tests.

        halves: gets for each token that is made, the pair it is made of.
        """
        parts = list(symbols)
        while len(parts) > 1:
            best, i = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            if halves is not None:
                halves[parts[i] + parts[i + 1]] = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def token(self, text: str) -> tuple | None:
        """None if the text is no token that encodes to itself; else what stands at its left and at its right edge
        in the course of its making: (part, rank of the merge that made it, rank of the merge that ends it)."""
        try:
            return self._tokens[text]
        except KeyError:
            pass
        got, halves = None, {}
        if text in self.vocab and self.merged(self._symbols(text), halves) == [text]:
            edges = []
            for side in (0, 1):
                spine, part, ends = [], text, 1 << 59
                while True:
                    born = self.rank[halves[part]] if part in halves else -1
                    spine.append((part, born, ends))
                    if part not in halves:
                        break
                    part, ends = halves[part][side], born
                edges.append(spine)
            got = tuple(edges)
        if len(self._tokens) > 600_000:
            self._tokens.clear()
        self._tokens[text] = got
        return got

    def follows(self, a: str, b: str) -> bool:
        """Whether no merge reaches across the border of a and b while they are being made."""
        rank = self.rank
        for x, born_x, ends_x in self.token(a)[1]:
            for y, born_y, ends_y in self.token(b)[0]:
                r = rank.get((x, y))
                # at the same rank the merge further left goes first: the one inside a, but not the one inside b
                if r is not None and (now := max(r, born_x, born_y)) < ends_x and now <= ends_y:
                    return False
        return True

    def start(self) -> After:
        """The state before the first letter; what was learned is dropped when it has grown too much."""
        if self.learned > STATES:
            self.learned, self.states = 0, {}
        return self.states.get(None) or self.states.setdefault(None, After(self, None))

    def stream(self, letters: Iterable[str]) -> Iterator[str]:
        """The tokens of a piece that arrives in strings of any length, each as soon as no later letter can change it. So many letters as the
        lookahead behind a token settle it, so no more than those, a token, and what comes between two looks are ever held."""
        buffer, base = "", 0  # letters from the oldest unsettled prefix on; how many prefixes are settled
        after: list[After] = [self.start()]  # of prefixes from there on: what may follow the last token,
        came: list[int] = [0]  # and where that token starts
        wait, longest, suffix = "", self.longest, self.suffix
        emit = min(self.lookahead + longest, 3 * longest)  # letters held before it is looked at what is settled
        most = self.lookahead + longest + emit
        for block in letters:
            block, wait = wait + block[:-1], block[-1:]  # the last letter carries the end mark
            for s in block:
                buffer += s
                n = len(buffer)
                for j in range(n - 1, max(-1, n - 1 - longest), -1):
                    if (now := after[j][buffer[j:n]]) is not None:
                        after.append(now)
                        came.append(base + j)
                        break
                else:
                    raise ValueError(f"no token ends in {buffer[-1]!r}")
                if n > emit:
                    out, done = self._settle(after, came, base)
                    yield from out
                    if done:
                        after, came, buffer, base = after[done:], came[done:], buffer[done:], base + done
                    elif n > most:
                        raise RuntimeError("the lookahead does not suffice")
        if wait:
            n = len(buffer) + 1
            tail = buffer + wait + suffix
            for j in range(n - 1, max(-1, n - 1 - longest), -1):
                if (now := after[j][tail[j:]]) is not None:
                    after.append(now)
                    came.append(base + j)
                    break
            else:
                raise ValueError(f"no token ends in {wait + suffix!r}")
            yield from self._path(after, came, base, base + n)

    @staticmethod
    def _path(after: list, came: list, base: int, n: int) -> list[str]:
        out = []
        while n > base:
            out.append(after[n - base].text)
            n = came[n - base]
        return out[::-1]

    def _settle(self, after: list, came: list, base: int) -> tuple[list[str], int]:
        """Tokens that all live prefixes share, and how many letters they cover."""
        n = base + len(after) - 1
        live = set(range(max(base, n + 1 - self.longest), n + 1))
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(came[last - base] if last > base else base)
        stable = live.pop()
        return self._path(after, came, base, stable), stable - base


class After(dict):
    """The state after a token: for each string, the state after it where it is a token that may follow, else None."""

    __slots__ = ("merges", "text")

    def __init__(self, merges: Merges, text: str | None):
        self.merges, self.text = merges, text

    def __missing__(self, tail: str) -> After | None:
        m, got = self.merges, None
        if m.token(tail) is not None and (self.text is None or m.follows(self.text, tail)):
            got = m.states.get(tail) or m.states.setdefault(tail, After(m, tail))
        m.learned += 1
        self[tail] = got
        return got


class Codec:
    """Encoder and decoder of a tokenizer file of the kind: NFC, lower case, pattern, byte letters, merges."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = Merges(self.vocab, [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]], self.suffix)
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["pattern"]["Regex"] != units.PATTERN:
            raise ValueError("only files with the known pattern are encoded here")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.lines = regex.compile(split["pattern"]["Regex"] + r"|\n")
        self.specials = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.letters = byte_letters()
        self.decoder = spec.get("decoder")
        if self.decoder is not None and self.decoder["type"] != "ByteLevel":
            raise ValueError("only files without a decoder or with a byte-level one are known here")
        self.bytes = {c: b for b, c in self.letters.items()}
        #: What follows the decoded text of each token but the last.
        self.between = b" " if self.decoder is None else b""
        self.units = units.Encoder(self.encode_units, KEPT)
        most = max(self.tokens, default=-1) + 1
        ends = [b"%d " % i for i in range(most)]
        shown = [self.letter_bytes(self.tokens[i]) + self.between if i in self.tokens else b"" for i in range(most)]
        self.tables = [pa.array(x, pa.large_binary()) for x in (ends, shown)]

    def pieces(self, chunk: str) -> Iterator[str | int]:
        """Ids of special tokens, and pieces of ordinary text; a piece's letters stand for bytes."""
        at = 0
        for m in self.specials.finditer(chunk) if self.specials and "<|" in chunk else ():
            yield from self._plain(chunk[at : m.start()])
            yield self.added[m[0]]
            at = m.end()
        yield from self._plain(chunk[at:])

    def _normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # the file's lower-casing is letter by letter: a final sigma is not told apart
        return text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)

    def _plain(self, text: str) -> list[str]:
        return self.pattern.findall(self._normal(text))

    def encode_piece(self, piece: str) -> bytes:
        """A piece is kept like a unit, which it is where it stands alone."""
        if (got := self.units.kept.get(raw := piece.encode())) is None:
            letters = "".join(map(self.letters.__getitem__, raw))
            ids = [self.vocab[t] for t in self.merges.stream((letters,))]
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(raw) <= units.KEPT_LEN:
                self.units.kept.put(raw, got)
        return got

    def encode_units(self, some: list[bytes]) -> list[bytes]:
        """Ids of units, as 32-bit integers; units without special tokens are cut into pieces together, a line each."""
        if self.decoder is not None:  # such files take white space for letters, which units leave out
            raise ValueError("files with a decoder are only decoded here")
        out: list[list[bytes]] = [[]]
        special = [b"<|" in u for u in some]
        for p in self.lines.findall(self._normal("".join(("" if x else u.decode()) + "\n" for u, x in zip(some, special, strict=True)))):
            if p == "\n":
                out.append([])
            else:
                out[-1].append(self.encode_piece(p))
        for k in itertools.compress(range(len(some)), special):
            out[k] = [struct.pack("<I", p) if isinstance(p, int) else self.encode_piece(p) for p in self.pieces(some[k].decode())]
        return list(map(b"".join, out[: len(some)]))

    def encode(self, text: str) -> list[int]:
        """Units are encoded apart: no rule of the file reaches across them."""
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        return np.frombuffer(next(self.units.rows(raw, np.array([0, len(raw)]))), dtype="<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.decode_stream(ids)).decode()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[bytes]:
        """Text as UTF-8, a token at a time; unknown ids give nothing. Without a decoder in the file, tokens' letters stand for
        themselves, parted by a space, and the state is whether a token came before. With a byte-level one, letters stand for
        bytes, and the state is the unfinished character: its bytes wait until it is whole."""
        if self.decoder is not None:
            waiting = codecs.getincrementaldecoder("utf-8")("replace")
            for i in ids:
                if (t := self.tokens.get(i)) is not None and (text := waiting.decode(self.letter_bytes(t))):
                    yield text.encode()
            if text := waiting.decode(b"", final=True):
                yield text.encode()
            return
        begun = False
        for i in ids:
            if (t := self.tokens.get(i)) is not None:
                yield (" " + t if begun else t).encode()
                begun = True

    def letter_bytes(self, token: str) -> bytes:
        """What a token stands for: the bytes of its letters where the file has a byte-level decoder, else the letters themselves."""
        if self.decoder is not None and all(c in self.bytes for c in token):
            return bytes(map(self.bytes.__getitem__, token))
        return token.encode()

    def sinks(self) -> tuple[Digest, Digest]:
        """For a document's ids and its text; the latter goes through the state machine of a byte-level decoder, if the file has one."""
        return Digest(b" "), Digest(self.between, self.decoder is not None)

    def digests(self, raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, str, str]]:
        """Of each row: number of ids, digests of the ids and of the text decoded from them, a block at a time."""
        row, n, kept = 0, 0, None
        for i, j, block, first in units.blocks(raw, starts):
            indices, bounds, ids = self.units.distinct(block, first)
            counts, places = self._shown(ids)
            held = np.zeros(len(indices) + 1, dtype=np.int64)
            np.cumsum(counts[indices], out=held[1:])
            both = [units.views(pc.take(p, indices)) for p in places]
            for k in range(j - i):
                if kept is None or i + k != row:
                    if kept is not None:
                        yield n, *(x.end() for x in kept)
                    row, n, kept = i + k, 0, self.sinks()
                n += int(held[bounds[k + 1]] - held[bounds[k]])
                for x, (data, offsets) in zip(kept, both, strict=True):
                    x.add(data[offsets[bounds[k]] : offsets[bounds[k + 1]]])
        if kept is not None:
            yield n, *(x.end() for x in kept)

    def digest(self, text: bytes) -> tuple[int, str, str]:
        raw = np.frombuffer(text, dtype=np.uint8)
        return next(self.digests(raw, np.array([0, len(raw)])))

    def _shown(self, ids: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """Of units' ids: how many, as decimals, and decoded, what parts them after each."""
        data, offsets = units.views(ids)
        flat = pa.array(np.frombuffer(data, dtype="<u4", count=int(offsets[-1]) // 4).astype(np.int32))
        at = offsets // 4
        out = []
        for t in self.tables:
            some, ends = units.views(pc.take(t, flat))
            out.append(units.binary(ends[at], some))
        return np.diff(at), out


class Digest:
    """SHA-256 of bytes that come in pieces, without the separator that ends the last. With `bytewise` they are bytes of characters, and those of
    an unfinished one wait until it is whole."""

    def __init__(self, after: bytes, bytewise: bool = False):
        self.after, self.hash, self.any = after, hashlib.sha256(), False
        self.waiting = codecs.getincrementaldecoder("utf-8")("replace") if bytewise else None

    def add(self, data: memoryview) -> None:
        if len(data):
            if self.any:
                self.hash.update(self.after)
            data = data[: len(data) - len(self.after)]
            self.hash.update(data if self.waiting is None else self.waiting.decode(bytes(data)).encode())
            self.any = True

    def end(self) -> str:
        if self.waiting is not None:
            self.hash.update(self.waiting.decode(b"", final=True).encode())
        return self.hash.hexdigest()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text decoded from them. No shuffle."""

    common.lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = list(c.digests(*common.text_views(batch, "text")))
            n, a, b = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.empty_if_null(F.col(text_col)).alias("text")).mapInArrow(common.tidy(run), SCHEMA)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """Of documents' packed ids (doc_id, ids): what encode_decode says of their texts, from the ids alone."""
    common.lean(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            raw, starts = common.text_views(batch, "ids")
            at, flat, rows = (starts - starts[0]) // 4, pa.array(raw[starts[0] : starts[-1]].view("<i4")), []
            for i, j in common.row_runs(at, units.BLOCK // 4):
                both = [units.views(pc.take(t, flat.slice(at[i], at[j] - at[i]))) for t in c.tables]
                for k in range(i, j):
                    a, b = int(at[k] - at[i]), int(at[k + 1] - at[i])
                    ends = []
                    for (data, offsets), d in zip(both, c.sinks(), strict=True):
                        d.add(data[offsets[a] : offsets[b]])
                        ends.append(d.end())
                    rows.append((b - a, *ends))
            n, a, b = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(common.tidy(run), SCHEMA)


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """Per document: its ids, as array<int>, or packed as little-endian 32-bit integers."""

    common.lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = list(c.units.rows(*common.text_views(batch, "text")))
            if packed:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "ids"])
                continue
            at = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=at[1:])
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.empty_if_null(F.col(text_col)).alias("text")).mapInArrow(common.tidy(run), f"doc_id long, ids {'binary' if packed else 'array<int>'}")
