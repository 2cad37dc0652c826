"""A byte-pair-encoding tokenizer compiled to a deterministic finite-state transducer over bytes.

The vocabulary file (tokenizers JSON: NFC, white space, lower case; words split by a fixed pattern; BPE with
word ends) is a function of normalised bytes. A state says all that later bytes can ask of those before:

- which kind of word is open, and bytes of it that are held back (its last byte, whose symbol depends on
  whether the word ends there; parts of a character or of a contraction);
- its ``Window``: the last token of the encoding at each place where a token that is still open may start, and
  the tokens up to there that aren't certain yet. A sequence of tokens is the encoding of its bytes if each
  pair of neighbours is, so a place's last token is found from the places before it, and places further
  back than the longest open token matter no more.

Each transition is annotated with the tokens that became certain with its byte. There are finitely many states;
they and their transitions are compiled from the merge table when first met, into two-level arrays that are
kept for the life of the worker process.

A stream of texts is cut into chunks of ``CHUNK`` bytes, whatever the texts' lengths. All chunks are
read in step, from the start state. What a chunk does to an unknown state before it is its state map: behind
its first white space or end of text it always ends in one state, and the bytes up to there (its head) are
read from the state before. Such maps compose associatively; a parallel prefix scan over them gives the state
before every chunk, and the heads are read again from there.
"""

from __future__ import annotations

import json
import marshal
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import takewhile
from typing import NamedTuple

import numpy as np
import regex

from newsloom.llm.common import held

#: Bytes of a chunk, and chunks that are read in step.
CHUNK, LANES = 512, 2048
#: States that are kept before all are given up: between words, and inside one, where the current one stays.
STATES, MOST = 200_000, 400_000
#: A part with under one end of a word in ``SPARSE`` bytes is cut to ``LONG`` bytes, each of which may make a state of its own.
LONG, SPARSE = 1 << 17, 64
#: Pairs of tokens of which it is remembered whether they may be neighbours.
NEIGHBOURS = 100_000
#: Below so many heads they are read one by one.
FEW = 64
#: The pattern that the states implement.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Bytes that UTF-8 never has: end of text, and from SPECIAL on one for each special token.
END, SPECIAL = 0xFF, 0xF8
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_SPACE_BYTES = b"\t\n\v\f\r "
_KINDS = [(kind, regex.compile(pattern)) for kind, pattern in ((_SPACE, r"\p{White_Space}"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"))]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of byte-level tokenizers."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class Merges:
    """Vocabulary and merge table; symbols are ids of single bytes, inside a word or at its end."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or model.get("end_of_word_suffix") != "</w>" or split["pattern"] != {"Regex": PATTERN}:
            raise ValueError(f"{path}: not a lower-casing BPE with word ends")
        ids = model["vocab"]
        self.merged = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        alphabet = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.inner, self.final = [ids[c] for c in alphabet], [ids[c + "</w>"] for c in alphabet]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbols: dict[int, list[int]] = {}
        self.inside: dict[bytes, int] = {}  # tokens that end inside a word, and at its end
        self.ending: dict[bytes, int] = {}
        self.prefixes = {b""}  # proper prefixes of tokens
        for token, number in ids.items():
            word = token.removesuffix("</w>")
            if number in self.special.values() or not all(c in byte_of for c in word):
                continue
            raw = bytes(byte_of[c] for c in word)
            ends = word != token
            (self.ending if ends else self.inside)[raw] = number
            self.symbols[number] = [self.inner[b] for b in raw[:-1]] + [(self.final if ends else self.inner)[raw[-1]]]
            self.prefixes.update(raw[:k] for k in range(1, len(raw)))
        self.halves = {token: (a, b, rank) for (a, b), (rank, token) in self.merged.items()}
        if len(self.halves) < len(self.merged) or any(self.halves.get(x, (0, 0, -1))[2] >= rank for a, b, rank in self.halves.values() for x in (a, b)):
            raise ValueError(f"{path}: a token that two merges make, or one that is made before its parts")
        self.neighbours: dict[tuple[int | None, int], bool] = {}

    def encode(self, symbols: list[int]) -> list[int]:
        """Merges the pair of least rank, the leftmost of equals, until none is left."""
        symbols, merged = list(symbols), self.merged
        while len(symbols) > 1:
            found = [(*m, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (m := merged.get(pair))]
            if not found:
                break
            _, token, i = min(found, key=lambda f: (f[0], f[2]))
            symbols[i : i + 2] = [token]
        return symbols

    def side(self, token: int, half: int) -> list[tuple[int, int]]:
        """What stands at the left (0) or right (1) edge of a token while it is merged, each with the rank that takes it into the next."""
        found, at, after = [], token, 1 << 60
        while True:
            found.append((at, after))
            if at not in self.halves:
                return found[::-1]
            at, after = self.halves[at][half], self.halves[at][2]

    def fit(self, left: int | None, right: int) -> bool:
        """Whether two tokens side by side (or one at the start of a word) are the encoding of their bytes.

        Merges go by rank, so the two are merged each for itself unless at some time the pair across their
        border has a lower rank than what is next on either side; of equal ranks the leftmost goes first.
        """
        known = self.neighbours.get((left, right))
        if known is not None:
            return known
        if left is None:
            known = self.encode(self.symbols[right]) == [right]
        else:
            known, a, b = True, self.side(left, 1), self.side(right, 0)
            i = j = 0
            while True:
                (x, x_next), (y, y_next) = a[i], b[j]
                across = self.merged.get((x, y))
                if across and across[0] < x_next and across[0] <= y_next:
                    known = False
                    break
                if i == len(a) - 1 and j == len(b) - 1:
                    break
                if x_next <= y_next:
                    i += 1
                else:
                    j += 1
        if len(self.neighbours) >= NEIGHBOURS:
            self.neighbours.clear()
        self.neighbours[left, right] = known
        return known


#: For each place where an open token may start, the last token before it and the tokens not yet emitted.
Places = tuple[tuple[int | None, tuple[int, ...]], ...]


class Window(NamedTuple):
    """The end of the open word's bytes that an open token may cover, and its places."""

    text: bytes = b""
    places: Places = ((None, ()),)


class State(NamedTuple):
    """An open word of a kind: its window, and the tokens not yet emitted if it ends here.

    ``pending`` is what may become a contraction, ``cut`` are bytes of a character that isn't complete.
    """

    kind: int = _SPACE
    window: Window = Window()
    close: tuple[int, ...] = ()
    pending: bytes = b""
    cut: bytes = b""


    def packed(self) -> bytes:
        """The state in few bytes, equal for equal states."""
        return marshal.dumps((self.kind, *self.window, self.close, self.pending, self.cut), 2)

    @staticmethod
    def of(packed: bytes) -> State:
        kind, text, places, close, pending, cut = marshal.loads(packed)
        return State(kind, Window(text, places), close, pending, cut)


START = State()


class Transducer:
    """States and transitions of a vocabulary file. ``run`` reads a stream; annotations are numbers of ``outputs``."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")")
        self.special_byte = {content: bytes([SPECIAL + k]) for k, content in enumerate(self.merges.special)}
        self.special_ids = list(self.merges.special.values())
        self.kinds: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        """Gives up all states, and the numbers of outputs."""
        self.outputs: dict[tuple[int, ...], int] = {(): 0}
        self._flat, self._ends = array("I"), array("q", [0])
        self.merges.neighbours.clear()
        self.states, self.numbers = [START.packed()], {START.packed(): 0}
        self.pages = np.zeros(8 * 1024, np.int32)  # page of each state and eighth of the bytes; page 0 is empty
        self.arcs = np.full(32 * 4096, -1, np.int64)  # next state and output of each page and byte in it
        self.n_pages = 1

    # compiling

    def _kind(self, char: bytes) -> int:
        known = self.kinds.get(char)
        if known is None:
            text = char.decode("utf-8", "replace")
            known = next((kind for kind, pattern in _KINDS if pattern.match(text)), _OTHER)
            self.kinds[char] = known
        return known

    def _extended(self, window: Window, byte: bytes) -> Window:
        """The window after a byte that doesn't end the word."""
        inside, prefixes, fit = self.merges.inside, self.merges.prefixes, self.merges.fit
        text, places = window.text + byte, window.places
        for i, (before, tokens) in enumerate(places):
            token = inside.get(text[i:])
            if token is not None and fit(before, token):
                break
        first = 0
        while text[first:] not in prefixes:
            first += 1
        return Window(text[first:], (*places[first:], (token, (*tokens, token))) if first <= len(places) else ((token, (*tokens, token)),))

    def _ended(self, window: Window, byte: bytes) -> tuple[int, ...]:
        """The tokens that are left when the word ends with a byte."""
        for i, (before, tokens) in enumerate(window.places):
            token = self.merges.ending.get(window.text[i:] + byte)
            if token is not None and self.merges.fit(before, token):
                return (*tokens, token)
        raise AssertionError("no encoding of a word")

    def _word(self, kind: int, window: Window, char: bytes) -> tuple[State, tuple[int, ...]]:
        """After a character of a word with the window before it; what all its ends have in common is certain."""
        for k in range(len(char) - 1):
            window = self._extended(window, char[k : k + 1])
        close = certain = self._ended(window, char[-1:])
        window = self._extended(window, char[-1:])
        for _, tokens in window.places:
            if tokens[: len(certain)] != certain:
                certain = tuple(a for a, b in takewhile(lambda p: p[0] == p[1], zip(certain, tokens)))
            if not certain:
                break
        n = len(certain)
        window = Window(window.text, tuple([(t, rest[n:]) for t, rest in window.places]))
        return State(kind, window, close[n:]), certain

    def _step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        if byte >= SPECIAL:
            return START, state.close if byte == END else (*state.close, self.special_ids[byte - SPECIAL])
        if byte < 0x80 and not state.cut:
            return self._read(state, bytes([byte]))
        cut = state.cut + bytes([byte])
        need = 4 if cut[0] >= 0xF0 else 3 if cut[0] >= 0xE0 else 2
        if cut[0] < 0xC0 or not all(0x80 <= x < 0xC0 for x in cut[1:]):
            return START, state.close  # not UTF-8: where a chunk starts inside a character
        state = state._replace(cut=cut)
        return self._read(state._replace(cut=b""), cut) if len(cut) == need else (state, ())

    def _read(self, state: State, char: bytes) -> tuple[State, tuple[int, ...]]:
        """After a whole character."""
        kind = self._kind(char)
        if state.pending:
            tail = state.pending[1:].decode() + char.decode()
            if tail in CONTRACTIONS:
                return START, self._read_word(state.pending + char)
            if any(c.startswith(tail) for c in CONTRACTIONS):
                word, out = self._word(_LETTER, Window(), char)
                return State(_LETTER, word.window, (*state.close, *out, *word.close), state.pending + char), ()
            if len(state.pending) == 1:
                state = state._replace(pending=b"")
            else:  # a stroke, and the first letter of a word
                stroke = self._read_word(state.pending[:1])
                after, out = self._read(self._word(_LETTER, Window(), state.pending[1:])[0], char)
                return after, stroke + self._word(_LETTER, Window(), state.pending[1:])[1] + out
        if kind == state.kind and kind in (_LETTER, _OTHER):
            return self._word(kind, state.window, char)
        if kind == _SPACE:
            return START, state.close
        after, out = self._word(kind, Window(), char)
        if kind == _NUMBER:
            return START, state.close + out + after.close
        if char == b"'":
            return after._replace(close=out + after.close, pending=char, window=self._extended(Window(), char)), state.close
        return after, state.close + out

    def _read_word(self, word: bytes) -> tuple[int, ...]:
        """The tokens of a whole word."""
        window = Window()
        for k in range(len(word) - 1):
            window = self._extended(window, word[k : k + 1])
        return self._ended(window, word[-1:])

    def _number(self, packed: bytes) -> int:
        """The number of a state, a new one if it hasn't any."""
        number = self.numbers.get(packed)
        if number is None:
            number = self.numbers[packed] = len(self.states)
            self.states.append(packed)
            if 8 * len(self.states) > len(self.pages):
                self.pages = np.concatenate([self.pages, np.zeros_like(self.pages)])
        return number

    def _compile(self, state: int, byte: int) -> int:
        """Adds the transition and returns its arc."""
        next_state, tokens = self._step(State.of(self.states[state]), byte)
        number = self._number(next_state.packed())
        page = int(self.pages[8 * state + (byte >> 5)])
        if not page:
            page = self.pages[8 * state + (byte >> 5)] = self.n_pages
            self.n_pages += 1
            if 32 * self.n_pages > len(self.arcs):
                self.arcs = np.concatenate([self.arcs, np.full(32 * 16384, -1, np.int64)])
        output = self.outputs.get(tokens)
        if output is None:
            output = self.outputs[tokens] = len(self.outputs)
            self._flat.extend(tokens)
            self._ends.append(len(self._flat))
        arc = number << 32 | output
        self.arcs[32 * page + (byte & 31)] = arc
        return arc

    # reading

    def _follow(self, state: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The arcs of some states and bytes (their upper three and lower five bits)."""
        arc = self.arcs.take((self.pages.take(8 * state + high) << 5) + low)
        if arc.min() < 0:
            for i in np.flatnonzero(arc < 0).tolist():
                arc[i] = self._arc(int(state[i]), int(high[i]) << 5 | int(low[i]))
        return arc

    def _arc(self, state: int, byte: int) -> int:
        arc = int(self.arcs[32 * int(self.pages[8 * state + (byte >> 5)]) + (byte & 31)])
        return arc if arc >= 0 else self._compile(state, byte)

    def _read_chunks(self, data: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """Outputs at each byte of equal chunks that are read in step from the start state, and the states after them."""
        steps = np.ascontiguousarray(data.reshape(lanes, -1).T)
        high, low = (steps >> 5).astype(np.int64), (steps & 31).astype(np.int64)
        out, state = np.empty(steps.shape, np.int64), np.zeros(lanes, np.int64)
        for k in range(len(steps)):
            out[k] = arc = self._follow(state, high[k], low[k])
            state = arc >> 32
        return (out & 0xFFFFFFFF).astype(np.int32).T.reshape(-1), state

    def _read_spans(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, state: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Reads spans of the stream from given states into ``out``; the states after them."""
        state, at = state.copy(), first.copy()
        live = np.flatnonzero(at < last)
        while len(live) > FEW:
            byte = data[at[live]].astype(np.int64)
            arc = self._follow(state[live], byte >> 5, byte & 31)
            out[at[live]] = arc & 0xFFFFFFFF
            state[live] = arc >> 32
            at[live] += 1
            live = live[at[live] < last[live]]
        for i in live.tolist():
            s = int(state[i])
            a, b = int(at[i]), int(last[i])
            codes = []
            for byte in data[a:b].tolist():
                arc = self._arc(s, byte)
                codes.append(arc & 0xFFFFFFFF)
                s = arc >> 32
            out[a:b] = codes
            state[i] = s
        return state

    def run(self, data: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """Outputs at each byte of a part of the stream that starts in state ``entry``, and the state after it."""
        n = len(data)
        lanes = -(-n // CHUNK)
        padded = np.full(lanes * CHUNK, END, np.uint8)
        padded[:n] = data
        resets = _RESETS[padded].reshape(lanes, CHUNK)
        reset = resets.any(1)
        head = np.where(reset, resets.argmax(1) + 1, CHUNK)  # bytes up to the first that ends every word
        # heads are read later, from the states before them: here they are white space, which makes no states
        own = np.where(np.arange(CHUNK) < np.where(reset, head - 1, CHUNK)[:, None], np.uint8(0x20), padded.reshape(lanes, CHUNK))
        out, after = self._read_chunks(own, lanes)
        starts = np.arange(lanes, dtype=np.int64) * CHUNK
        # maps: the state that a prefix of the chunks ends in and the byte from which it is still to be read
        before, origin = prefix_scan(np.concatenate([[entry], np.where(reset, after, -1)]), np.concatenate([[0], np.where(reset, starts + CHUNK, starts)]))
        owners = np.flatnonzero(reset)
        self._read_spans(padded, origin[owners], starts[owners] + head[owners], before[owners], out)
        if n == lanes * CHUNK and reset[-1]:
            return out, int(after[-1])
        # the last state: behind the last reset of the bytes themselves
        resets_at = np.flatnonzero(_RESETS[data])
        from_, state = (int(resets_at[-1]) + 1, 0) if len(resets_at) else (0, entry)
        state = self._read_spans(padded, np.array([from_]), np.array([n]), np.array([state]), out)
        return out[:n], int(state[0])

    def bytes_of(self, text: str | None) -> bytes:
        """A text's normalised bytes, special tokens as bytes of their own."""
        if not text:
            return b""
        if "<|" in text:
            return b"".join([self.special_byte.get(p) or _normalised(p) for p in self.specials.split(text)])
        return _normalised(text)

    def read(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The stream of some texts in parts: the index of the first text in a part, where each text in it ends, and the outputs.

        A text that is longer than a part goes on in the next. Outputs of a part hold until the next is asked for.
        """
        waiting: list[bytes] = []
        first, size = 0, 0
        for text in texts:
            waiting.append(self.bytes_of(text) + b"\xff")
            size += len(waiting[-1])
            if size >= CHUNK * LANES:
                yield from self._read_parts(first, waiting)
                first, size, waiting = first + len(waiting), 0, []
        if waiting:
            yield from self._read_parts(first, waiting)

    def _read_parts(self, first: int, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        state, k, at = 0, 0, 0
        while at < len(data):
            if len(self.states) > (MOST if state else STATES):
                current = self.states[state]
                self.forget()
                state = self._number(current)
            part = data[at : at + CHUNK * LANES]
            if SPARSE * np.count_nonzero(_RESETS[part]) < len(part):
                part = part[:LONG]
            out, state = self.run(part, state)
            last = int(np.searchsorted(ends, at + len(out), "left"))  # of the text that the part ends in
            yield first + k, np.minimum(ends[k : last + 1] - at, len(out)), out
            at += len(out)
            k = last + (last < len(ends) and ends[last] == at)

    def counts(self, outputs: np.ndarray) -> np.ndarray:
        """How many tokens each output has."""
        return np.diff(np.array(self._ends), prepend=0)[outputs]

    def tokens(self, outputs: np.ndarray) -> np.ndarray:
        """The token ids of outputs, one after the other."""
        outputs = outputs[outputs > 0]
        ends = np.array(self._ends)
        size = np.diff(ends, prepend=0)[outputs]
        total = np.cumsum(size)
        if not len(total):
            return np.zeros(0, "<u4")
        place = np.arange(total[-1]) + np.repeat(ends[outputs] - total, size)
        return np.array(self._flat, "<u4")[place]


def _resets() -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(_SPACE_BYTES)] = True
    out[SPECIAL:] = True
    return out


_RESETS = _resets()


def _normalised(text: str) -> bytes:
    if text.isascii():
        return text.lower().encode()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().encode("utf-8", "replace")  # one by one, sigma has one lower case


def prefix_scan(state: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composes the maps of all prefixes in log2(n) rounds, each over all places at once.

    A map is a state that is certain at byte ``origin``, or -1 if all bytes from ``origin`` on are still to be
    read from whatever comes before. Two maps in a row compose to the second if its state is certain, else to
    the first: the bytes of the second follow those that the first leaves to be read.
    """
    state, origin, width = state.copy(), origin.copy(), 1
    while width < len(state):
        open_ = state[width:] < 0
        first_state, first_origin = state[:-width].copy(), origin[:-width].copy()
        state[width:] = np.where(open_, first_state, state[width:])
        origin[width:] = np.where(open_, first_origin, origin[width:])
        width *= 2
    return state, origin


def transducer(path: str) -> Transducer:
    """The transducer of a file, which a worker process keeps for its next tasks."""
    return held(path, lambda: Transducer(path))
