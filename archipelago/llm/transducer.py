"""A byte-level BPE tokenizer compiled to a deterministic counting transducer.

The transducer reads characters.  Its state holds what the pre-tokenizer still
has to decide (a pending white-space character, a pending apostrophe) and the
BPE state of the piece being read.  Every state carries the number of tokens
that arriving in it adds to the count, so the count of a text is the sum over
the states passed plus what the last state still owes.

BPE state.  The encodings of all prefixes of a piece are nested: the encoding
of a prefix is its last token after the encoding of the rest, and a token may
follow another if and only if encoding the two together gives just the two.
So it is enough to know, for every position at which a token may still be
open (the text since then is the beginning of some token), the last token of
the encoding up to there and its length relative to the present one.  These
are finitely many; states are made when they are first reached and kept, and
the table starts afresh when it holds ``MAX_STATES``.
"""

from __future__ import annotations

import json
import re
import sys

from tokenizers import pre_tokenizers

MAX_STATES = 200_000
MAX_UNITS = 600_000


def _byte_names() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: a printable
    Latin-1 byte stands for itself, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as bytes, the merges' ranks, and which tokens may follow which."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = [x["content"] for x in model["added_tokens"]]
        names = _byte_names()
        self.id = {bytes(names[c] for c in text): n for text, n in model["model"]["vocab"].items()}
        self.bytes = {n: text for text, n in self.id.items()}
        self.rank = {}
        for n, pair in enumerate(model["model"]["merges"]):
            one, two = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[bytes(names[c] for c in one), bytes(names[c] for c in two)] = n
        self.parts = {one + two: (one, two) for one, two in sorted(self.rank, key=self.rank.get, reverse=True)}
        self._follows: dict[int, bool] = {}
        self._edges: dict[tuple[bytes, int], list] = {}
        #: The trie: (node << 8 | byte) to node, each node's token (-1: none)
        #: and whether it goes on.  A token that encoding its own bytes does not
        #: give never occurs.
        self.trie: dict[int, int] = {}
        self.ends, self.inner = [-1], [True]
        for text, n in self.id.items():
            node = 0
            for byte in text:
                self.inner[node] = True
                to = self.trie.get(node << 8 | byte)
                if to is None:
                    to = self.trie[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = to
            if self.encode(text) == [text]:
                self.ends[node] = n

    def encode(self, piece: bytes) -> list[bytes]:
        """Plain BPE: merge the pair of least rank, leftmost first, until none is left."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The tokens that stand at one edge of ``token`` while it is merged, from
        its byte to itself, each with the rank of the merge that absorbs it."""
        found = self._edges.get((token, side))
        if found is None:
            now, rank, found = token, 1 << 60, []
            while True:
                found.insert(0, (now, rank))
                if len(now) == 1:
                    break
                rank = self.rank[self.parts[now]]
                now = self.parts[now][side]
            self._edges[token, side] = found
        return found

    def follows(self, one: int, two: int) -> bool:
        """Whether encoding ``one + two`` gives just these two tokens.

        While both are merged, the right edge of the first meets the left edge
        of the second; a merge across must never come before the merges that
        absorb the two.  A merge's parts have lower ranks than it has.
        """
        known = self._follows.get(one << 32 | two)
        if known is None:
            right, left = self._edge(self.bytes[one], 1), self._edge(self.bytes[two], 0)
            i, j, known = 0, 0, True
            while True:
                (a, until_a), (b, until_b) = right[i], left[j]
                across = self.rank.get((a, b), 1 << 60)
                if across < until_a and across <= until_b and across < 1 << 60:
                    known = False
                    break
                if until_a == until_b == 1 << 60:
                    break
                if until_a <= until_b:
                    i += 1
                else:
                    j += 1
            if len(self._follows) > 1_000_000:
                self._follows.clear()
            self._follows[one << 32 | two] = known
        return known


#: A piece's BPE state: for each position at which a token may be open, longest
#: first, the trie node of the text since then, the last token up to there (-1:
#: the piece begins) and the count up to there less the present one.
_START = ((0, -1, 0),)

#: The key of the state in which a text begins.
START = ("start", "", _START)


def _feed(vocab: Vocabulary, marks: tuple, char: str) -> tuple[tuple, int]:
    """The BPE state after one more character, and the change of the count."""
    trie, ends, inner, follows = vocab.trie, vocab.ends, vocab.inner, vocab.follows
    change = 0
    for byte in char.encode("utf-8", "surrogatepass"):
        token, step, still = -1, 0, []
        for node, last, rel in marks:
            node = trie.get(node << 8 | byte)
            if node is None:
                continue
            if token < 0 and ends[node] >= 0 and (last < 0 or follows(last, ends[node])):
                token, step = ends[node], rel + 1
            if inner[node]:
                still.append((node, last, rel))
        change += step
        marks = (*((node, last, rel - step) for node, last, rel in still), (0, token, 0))
    return marks, change


class State(dict):
    """A state: a map from characters to states, filled when asked.

    ``None`` maps to the count that arriving here adds, ``""`` to what is owed
    if the text ends here.
    """

    __slots__ = ("key", "machine")

    def __missing__(self, char: str) -> State:
        return self.machine.step(self, char)


#: What follows an apostrophe at a piece's start to make a piece of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class Transducer:
    """Counts tokens of ordinary text as the vocabulary's library does."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.states: dict[tuple, State] = {}
        self.kinds: dict[str, str] = {}
        self._split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.start = self._state(START, 0)
        parts = sorted((s for s in self.vocab.special if s), key=len, reverse=True)
        if any(self.kind(c) == "B" for s in parts for c in s):
            raise ValueError("special strings with white space are not supported")
        self.special = re.compile("|".join(map(re.escape, parts))) if parts else None
        #: How far beyond a chunk a special string that begins in it may go.
        self.reach = max(map(len, parts), default=1) - 1
        blank = "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and self.kind(c) == "B")
        #: Units: the blanks before a run of others, and that run.  A piece never
        #: goes on with a blank after another character, so counts add up.
        self.unit = re.compile(f"[{blank}]*[^{blank}]+|[{blank}]+")
        self.units = _Units(self)

    def kind(self, char: str) -> str:
        """L, N, O or B (letter, number, other, blank) as the library's own
        pre-tokenizer sees the character."""
        found = self.kinds.get(char)
        if found is None:
            pieces = self._split.pre_tokenize_str
            found = next((k for k, lead in (("L", "a"), ("N", "1"), ("O", "!")) if len(pieces(lead + char)) == 1), "B")
            self.kinds[char] = found
        return found

    def _state(self, key: tuple, adds: int) -> State:
        full = (key, adds)
        state = self.states.get(full)
        if state is None:
            state = State()
            state.key, state.machine = key, self
            state[None], state[""] = adds, self._owed(key)
            self.states[full] = state
        return state

    def _one(self, text: str) -> int:
        return len(self.vocab.encode(text.encode("utf-8", "surrogatepass")))

    def _owed(self, key: tuple) -> int:
        mode, held, bpe = key
        if mode == "blank":  # at the end of a text the held blank belongs to the run
            return _feed(self.vocab, bpe, held)[1]
        return 0

    def step(self, state: State, char: str) -> State:
        if len(self.states) >= MAX_STATES:
            self.states.clear()
            self.start = self._state(START, 0)
        key, adds = self._next(state.key, char)
        new = state[char] = self._state(key, adds)
        return new

    def _open(self, char: str, lead: str = "") -> tuple[tuple, int]:
        """Begin a piece with an optional blank and a character that is none."""
        bpe, adds = _START, 0
        for c in lead + char:
            bpe, more = _feed(self.vocab, bpe, c)
            adds += more
        mode = self.kind(char)
        if char == "'" and not lead:
            mode = "'"
        return (mode, "", bpe), adds

    def _next(self, key: tuple, char: str) -> tuple[tuple, int]:
        mode, held, bpe = key
        kind = self.kind(char)
        if mode == "blank":
            if kind == "B":
                bpe, adds = _feed(self.vocab, bpe, held)
                return ("blank", char, bpe), adds
            if held == " ":
                return self._open(char, " ")
            after, adds = self._open(char)
            return after, adds + self._one(held)
        if mode == "'" and kind != "B":
            said = held + char
            if said in CONTRACTIONS:
                before = self._one("'") + (self._one(held) if held else 0)
                return START, self._one("'" + said) - before
            if any(x.startswith(said) for x in CONTRACTIONS):
                bpe, adds = _feed(self.vocab, _START, char)
                return ("'", said, bpe), adds
            if held:  # the apostrophe stands alone and the letters after it are a piece
                mode = "L"
            else:
                mode = "O"
        if kind == "B":
            return ("blank", char, _START), 0
        if kind == mode:
            bpe, adds = _feed(self.vocab, bpe, char)
            return (mode, "", bpe), adds
        return self._open(char)

    def run(self, text: str) -> int:
        """The tokens of a text without special strings, from the start state."""
        state, n = self.start, 0
        for char in text:
            state = state[char]
            n += state[None]
        return n + state[""]

    def unit_count(self, unit: str) -> int:
        """The tokens of a unit; a special string inside it is one token."""
        if self.special is None or not self.special.search(unit):
            return self.run(unit)
        n, at = 0, 0
        for found in self.special.finditer(unit):
            n += 1 + self.run(unit[at : found.start()])
            at = found.end()
        return n + self.run(unit[at:])

    def count(self, text: str) -> int:
        """The tokens of a whole text."""
        return sum(map(self.units.__getitem__, self.unit.findall(text)))

    def advance(self, key: tuple, chunk: str, ahead: str = "") -> tuple[tuple, int]:
        """The state after ``chunk`` from the state ``key``, and the count added.

        ``ahead`` is the text that follows, at least ``self.reach`` characters
        of it: a special string that begins in the chunk is counted here, and
        the state after it says how many more characters belong to it.
        """
        if key[0] == "skip":
            if key[1] > len(chunk):
                return ("skip", key[1] - len(chunk)), 0
            chunk, key = chunk[key[1] :], START
        n, at, state = 0, 0, self._state(key, 0)
        if self.special is not None:
            for found in self.special.finditer(chunk + ahead):
                if found.start() >= len(chunk):
                    break
                state, more = self._read(state, chunk[at : found.start()])
                n += more + state[""] + 1
                at, state = found.end(), self._state(START, 0)
            if at > len(chunk):
                return ("skip", at - len(chunk)), n
        state, more = self._read(state, chunk[at:])
        return state.key, n + more

    def _read(self, state: State, text: str) -> tuple[State, int]:
        """The state after a text without special strings, and the count added.

        Between units every state goes on like the start state, so the units
        after the first are read from there, all but the last from memory."""
        units = self.unit.findall(text)
        n = sum(map(self.units.__getitem__, units[1:-1]))
        for k in (0, -1) if len(units) > 1 else (0,) if units else ():
            if k:
                state = self._state(START, 0)
            for char in units[k]:
                state = state[char]
                n += state[None]
        return state, n

    def owed(self, key: tuple) -> int:
        """What the state ``key`` still adds where a text ends."""
        return 0 if key[0] == "skip" else self._owed(key)

    def settles(self, text: str) -> bool:
        """Whether the state after ``text`` is the same from every state."""
        return len(self.unit.findall(text)) > 1


def written(key: tuple) -> str:
    """A state's key as text; the same vocabulary file reads it anywhere."""
    return json.dumps(key, separators=(",", ":"))


def read(text: str) -> tuple:
    """The key that :func:`written` wrote."""
    key = json.loads(text)
    return tuple(key) if key[0] == "skip" else (key[0], key[1], tuple(map(tuple, key[2])))


class _Units(dict):
    """Counts of the units met lately."""

    __slots__ = ("machine",)

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, unit: str) -> int:
        if len(self) >= MAX_UNITS:
            self.clear()
        n = self.machine.unit_count(unit)
        if len(unit) <= 64:
            self[unit] = n
        return n
