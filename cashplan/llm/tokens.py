"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer file.

Two deterministic transducers in a row take the tokenizer's place.

* The splitter reads character classes and marks each transition that starts a new piece. It has eight states, so what a
  chunk of text does is a map of eight states to eight. The maps of all chunks of a batch are worked out side by side, then
  composed by a parallel prefix scan, which gives the state at the start of each chunk; a second pass marks the pieces.
* The counter reads the bytes of a piece. Each transition carries the change in the number of tokens: the tokens of
  a prefix are those of a shorter prefix and one more, namely the one token that ends there and would not merge with what
  is before it. A state is the last bytes that can still begin a token, with the last token and the count (relative to the
  present one) at each place among them from which a token may still start. States are compiled when first reached and kept.

The classes are read off the tokenizer itself, as its library knows other characters than Python does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashplan.llm.common import Cache, slices, texts

# The symbols of the splitter.
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
SPACE_LAST, BLANK_LAST, CONTRACTION_2, CONTRACTION_3, END = range(5, 10)
# Its states, named by the piece that is open.
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
STATES, SYMBOLS = 8, 10
CHUNK = 256
#: Symbols after which the state nearly always no longer depends on the one before them.
TAIL = 8
CHARS_AT_ONCE = 1 << 21
CODES_AT_ONCE = 1 << 12
TRANSITIONS_KEPT = 1_000_000
PIECES_KEPT = 600_000
LONGEST_PIECE_KEPT = 64
#: Bytes of a piece that fit into a number of 64 bits beside their count.
SHORT = 7
_END_CODE = 0x110000


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """The next state, and whether a piece starts, by symbol and state."""
    after = np.zeros((SYMBOLS, STATES), np.intp)
    starts = np.ones((SYMBOLS, STATES), bool)
    runs = ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS))
    for symbol, state in runs:
        after[symbol] = state
        starts[symbol, [state, AFTER_SPACE]] = False
    for symbol, state in ((CONTRACTION_2, ONE_MORE), (CONTRACTION_3, TWO_MORE)):
        after[symbol] = state
        after[symbol, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        starts[symbol, [IN_OTHERS, AFTER_SPACE]] = False
    for symbol in (SPACE, BLANK):
        after[symbol] = IN_BLANKS
        starts[symbol, IN_BLANKS] = False
    after[SPACE_LAST] = AFTER_SPACE
    after[BLANK_LAST] = NONE
    for state, then in ((TWO_MORE, ONE_MORE), (ONE_MORE, NONE)):
        after[:, state] = then
        starts[:, state] = False
    after[END] = NONE
    starts[END] = True
    return after, starts


AFTER, STARTS = _splitter()


def _maps(symbols: np.ndarray) -> np.ndarray:
    """What each row of symbols does to each of the states."""
    flat = AFTER.ravel()
    maps = np.broadcast_to(np.arange(STATES), (len(symbols), STATES)).copy()
    for column in symbols.T.astype(np.intp) * STATES:
        maps = flat[column[:, None] + maps]
    return maps


def states_at_chunks(symbols: np.ndarray) -> np.ndarray:
    """The splitter's state before each row of a (chunks, length) array that is one text, cut up.

    Where the last symbols of a chunk lead all states to the same one, so does the chunk; only others are run whole.
    """
    maps = _maps(symbols[:, -TAIL:])
    open_ = np.flatnonzero((maps != maps[:, :1]).any(axis=1))
    if len(open_):
        maps[open_] = _maps(symbols[open_])
    step = 1
    while step < len(maps):  # map i becomes what chunks i - 2 * step + 1 to i do in a row
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return np.concatenate([[NONE], maps[:-1, NONE]])


def piece_starts(symbols: np.ndarray) -> np.ndarray:
    """Marks where pieces start."""
    n = len(symbols)
    cut = np.full((-(-n // CHUNK), CHUNK), END, np.uint8)
    cut.ravel()[:n] = symbols
    state = states_at_chunks(cut)
    marks = np.empty(cut.shape, bool)
    after, starts = AFTER.ravel(), STARTS.ravel()
    for at, column in enumerate(cut.T.astype(np.intp) * STATES):
        marks[:, at] = starts[column + state]
        state = after[column + state]
    return marks.ravel()[:n]


def character_classes(pre_tokenizer) -> np.ndarray:
    """OTHER, LETTER, NUMBER or BLANK for each code point, as a library's splitter has them."""

    def alone(first: str, char: str) -> bool:
        return len(pre_tokenizer.pre_tokenize_str(first + char)) > 1

    def kind(char: str) -> int:
        for first, found in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if not alone(first, char):
                return found
        return BLANK

    classes = np.full(_END_CODE + 1, OTHER, np.uint8)
    codes = np.concatenate([np.arange(128, 0xD800, dtype="<u4"), np.arange(0xE000, _END_CODE, dtype="<u4")])
    for first in range(0, len(codes), CODES_AT_ONCE):  # the library's time grows faster than the text
        some = codes[first : first + CODES_AT_ONCE]
        text = some.tobytes().decode("utf-32-le")
        for _, (start, stop) in pre_tokenizer.pre_tokenize_str(text):
            classes[some[start:stop]] = kind(text[start])
    for code in range(128):
        classes[code] = kind(chr(code))
    return classes


class Tokenizer:
    """A byte-level BPE tokenizer file, compiled. ``count`` and ``pieces`` are what the operators call."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splitter = spec["pre_tokenizer"]
        if (
            spec["model"]["type"] != "BPE"
            or splitter["type"] != "ByteLevel"
            or splitter["add_prefix_space"]
            or spec["normalizer"]
        ):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        if any(token["lstrip"] or token["rstrip"] or token["single_word"] for token in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take their surroundings in")
        self.library = Library.from_file(path)
        self.classes = character_classes(self.library.pre_tokenizer)
        self.byte_of = _byte_of()
        self.model = spec["model"]
        self.whole = Cache(lambda token: self.merged(token) == [token], 100_000)
        self.apart = Cache(lambda pair: self.merged(pair[0] + pair[1]) == [*pair], 500_000)
        self.tokens_of = Cache(self.count_piece, PIECES_KEPT, LONGEST_PIECE_KEPT)
        self._forget()

    @cached_property
    def token_id(self) -> dict[bytes, int]:
        return {self._bytes(token): i for token, i in self.model["vocab"].items()}

    @cached_property
    def rank(self) -> dict[tuple[bytes, bytes], int]:
        pairs = [x if isinstance(x, list) else x.split(" ") for x in self.model["merges"]]
        return {(self._bytes(a), self._bytes(b)): i for i, (a, b) in enumerate(pairs)}

    @cached_property
    def begins(self) -> set[bytes]:
        return {token[:n] for token in self.token_id for n in range(1, len(token) + 1)}

    def _bytes(self, token: str) -> bytes:
        return bytes(map(self.byte_of.__getitem__, token))

    def _forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.state: list[tuple] = []
        self.moves: dict[int, tuple[int, int]] = {}
        self._state_id((b"", ((None, 0),)))

    def _state_id(self, state: tuple) -> int:
        if state not in self.states:
            self.states[state] = len(self.state)
            self.state.append(state)
        return self.states[state]

    def merged(self, text: bytes) -> list[bytes]:
        """The tokens of a short string by the merges themselves, to compile transitions with."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(parts, parts[1:], strict=False)]
            at = ranks.index(least := min(ranks))
            if least == len(self.rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state and a byte: the next state, and the change in the count of tokens."""
        seen, ends = self.state[state]
        seen += bytes([byte])
        for start, end in enumerate(ends):
            if end and (token := seen[start:]) in self.token_id and self.whole[token]:
                if end[0] is None or self.apart[end[0], token]:
                    break
        change = end[1] + 1
        opens = [bool(end) and seen[n:] in self.begins for n, end in enumerate(ends)]
        keep = opens.index(True) if any(opens) else len(seen)
        ends = tuple((end[0], end[1] - change) if open_ else None for end, open_ in zip(ends[keep:], opens[keep:]))
        return self._state_id((seen[keep:], (*ends, (token, 0)))), change

    def count_piece(self, piece: str) -> int:
        """The tokens of a piece: the counter run over its bytes."""
        if len(self.moves) > TRANSITIONS_KEPT:
            self._forget()
        state, total, moves = 0, 0, self.moves
        for byte in piece.encode():
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._compile(state, byte)
            state, change = move
            total += change
        return total

    def pieces(self, texts: list[str]) -> Iterator[list[str]]:
        """The pieces of each text, special tokens not looked for."""
        for group in _groups(texts):
            _, bounds, ends = self._bounds(group)
            first = begin = 0
            for text, end in zip(group, ends.tolist(), strict=True):
                last_bound = int(np.searchsorted(bounds, end))
                cuts = (bounds[first : last_bound + 1] - begin).tolist()
                yield list(map(text.__getitem__, map(slice, cuts, cuts[1:])))
                first, begin = last_bound + 1, end + 1

    def distinct_pieces(self, texts: list[str]) -> Iterator[tuple[list[int | str], np.ndarray, np.ndarray]]:
        """For groups of texts: their distinct pieces, which of them each piece is, and where each text's pieces end.

        Pieces are cut out of one buffer and numbered by Arrow, so only the distinct ones become Python objects. One of up to
        seven bytes is a number, which :func:`piece_of` turns back.
        """
        for group in _groups(texts):
            codes, bounds, ends = self._bounds(group)
            size = (codes >= 0x80).astype(np.int8)
            size += codes >= 0x800
            size += codes >= 0x10000
            size += 1
            size[ends] = 0
            starts = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[bounds]
            is_text = size[bounds] > 0  # the end of a text is a bound as well
            stops = np.cumsum(is_text)[np.searchsorted(bounds, ends)]
            data = "".join(group).encode()
            starts = starts[is_text]
            lengths = np.diff(starts, append=len(data))
            eight = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))[starts]  # the bytes from each start on
            short = lengths <= SHORT
            kept = lengths[short].astype(np.uint64)
            keys = (eight[short] & ((np.uint64(1) << (kept << np.uint64(3))) - np.uint64(1))) | (kept << np.uint64(56))
            numbers = pa.array(keys).dictionary_encode()
            offsets = np.append(starts, len(data))
            all_ = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
            strings = all_.filter(pa.array(~short)).dictionary_encode()
            pieces = np.empty(len(starts), np.int32)
            pieces[short] = numbers.indices
            pieces[~short] = strings.indices.to_numpy() + len(numbers.dictionary)
            yield numbers.dictionary.to_pylist() + strings.dictionary.to_pylist(), pieces, stops

    def _bounds(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The code points of all texts, an end after each; where pieces (and ends) start; and where the ends are."""
        codes = np.concatenate(
            [part for text in texts for part in (np.frombuffer(text.encode("utf-32-le"), "<u4"), _END_ARRAY)]
        )
        symbols = self.classes[codes]
        ends = np.flatnonzero(codes == _END_CODE)
        symbols[ends] = END
        blank = (symbols == BLANK) | (symbols == SPACE)
        space = blank & (codes == 32)
        last = blank.copy()
        last[:-1] &= ~(blank[1:] | (symbols[1:] == END))
        symbols[space] = SPACE
        symbols[blank & last] = BLANK_LAST
        symbols[space & last] = SPACE_LAST
        quotes = np.flatnonzero(codes == ord("'"))
        if len(quotes):
            padded = np.concatenate([codes, [0, 0]])
            one, two = padded[quotes + 1], padded[quotes + 2]
            symbols[quotes[np.isin(one, _ENDINGS_1)]] = CONTRACTION_2
            pair = np.isin(one.astype(np.int64) << 32 | two, _ENDINGS_2)
            symbols[quotes[pair]] = CONTRACTION_3
        return codes, np.flatnonzero(piece_starts(symbols)), ends

    def parts(self, text: str) -> list[str | int]:
        """A text cut at its special tokens: strings, and the ids of special tokens."""
        if not any(token in text for token in self.special):
            return [text]
        out: list[str | int] = [text]
        for token, i in self.special.items():
            out = [
                y
                for x in out
                for y in ([x] if isinstance(x, int) else _between(x.split(token), i))
            ]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        parts = [self.parts(text) for text in texts]
        pieces = self.pieces([x for some in parts for x in some if isinstance(x, str)])
        of = self.tokens_of.__getitem__
        return [sum(1 if isinstance(x, int) else sum(map(of, next(pieces))) for x in some) for some in parts]


_END_ARRAY = np.array([_END_CODE], "<u4")


def piece_of(key: int | str) -> str:
    """The piece that :meth:`Tokenizer.distinct_pieces` names so."""
    return key if isinstance(key, str) else (key & (1 << 56) - 1).to_bytes(SHORT, "little")[: key >> 56].decode()


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in groups of some characters, so that few are numbers at a time."""
    group: list[str] = []
    chars = 0
    for text in texts:
        group.append(text)
        chars += len(text)
        if chars >= CHARS_AT_ONCE:
            yield group
            group, chars = [], 0
    if group:
        yield group


# The endings that the splitter cuts off after an apostrophe.
_ENDINGS_1 = [ord(c) for c in "stmd"]
_ENDINGS_2 = [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")]


def _between(texts: list[str], token: int) -> list[str | int]:
    return [x for text in texts for x in (text, token)][:-1]


def _byte_of() -> dict[str, int]:
    """Bytes by the printable characters that byte-level tokenizer files write for them."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def compiled(path: str) -> Tokenizer:
    """One compiled tokenizer for a Python worker's life."""
    return Tokenizer(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    Reads ``doc_id`` and ``text`` only; a null text is empty and has no tokens. Nothing is added, cut or padded. A special
    token's string in a text is that one token. Repeated rows each come back, ids may be null, an empty table gives
    an empty one. There is no shuffle: texts stay where they are read. The file must lie at the path on every executor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(tokenizer_path)
        for batch in slices(batches):
            found = [text or "" for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(text.encode()) for text in found], pa.int64()),
                    pa.array(tokenizer.counts(found), pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
