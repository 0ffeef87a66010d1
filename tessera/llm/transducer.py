"""Token counts by a finite-state transducer compiled from a byte-level BPE vocabulary.

The transducer reads code points. Its state is a pair: where the splitter into pre-tokens stands, and a state of the
merge automaton for the pre-token so far. The merge automaton works on bytes. For a prefix p of a pre-token let
last(p) be the last token of its encoding and c(p) the number of tokens. The encoding of p+b ends in the longest
vocabulary entry t that is a suffix of p+b and may follow last(p+b without t); its count is c of that shorter prefix
plus one. So all that later input can depend on is, for each suffix of p that begins some vocabulary entry, last(.)
before that suffix and its count relative to c(p). That tuple is the merge state (with last(.)
replaced by the entries that may still follow it where they are few); there are finitely many, since the
suffixes are no longer than the longest entry. A transition's annotation is the change in the token count, which may
be negative when a merge takes earlier tokens back.

States are built when first reached (lazy determinisation) and dropped together when there are MAX_STATES, so memory
is bounded and results are the same. Special strings cut the text, as the library does, and count one each.

A text of more than CHUNK characters is cut there, wherever that is. A chunk has a state map, entry state -> (exit state,
count). It is worked out for the states in which the text before may end: those that the transducer reaches when it
begins 1, 2, 4, .. LOOK characters earlier. Runs from different entries soon meet in one state; from there on they are one
run, and from the first change from non-space to space on all are the same, so that this part is counted once, by words.
Maps compose associatively, (a then b)(s) = b(exit of a(s)) with the counts added, and an inclusive prefix scan in rounds of
doubled distance gives the map of all chunks up to each. An entry that was not foreseen is run when it is asked for.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache

CHUNK = 1 << 13
LOOK = 64
SYNC = 256
MAX_STATES = 200_000
MAX_STARTS = 400_000
FEW = 6
MAX_WORDS = 500_000
#: Characters that no library takes for spaces, and the pieces of a text that is made of them and single separators.
PLAIN = r"!-~\u00c0-\u024f"
PIECES = re.compile(rf"[ \n]?[{PLAIN}]+")
CUTS = re.compile(rf"(?<=[{PLAIN}])(?=[ \n])")

# modes of the splitter
BEGIN, LETTERS, NUMBERS, OTHERS, SPACES, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(9)
#: Second letter of the contractions ending in it after the quote and the first: 're, 've, 'll.
TWO = {"r": (QUOTE_R, "e"), "v": (QUOTE_V, "e"), "l": (QUOTE_L, "l")}
ONE = "stmd"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte, by the public rule of byte-level BPE vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Node(dict):
    """A state of the transducer: code point -> (next state, change in count); missing ones are built."""

    __slots__ = ("machine", "mode", "merge", "held")

    def __init__(self, machine: "Machine", mode: int, merge: int, held: str):
        self.machine, self.mode, self.merge, self.held = machine, mode, merge, held

    def __missing__(self, ch: str) -> tuple["Node", int]:
        self[ch] = got = self.machine.step(self, ch)
        return got


class Words(dict):
    """Chunk that begins at a change from non-space to space -> its count: a constant map, kept once computed."""

    def __init__(self, machine: "Machine"):
        self.machine = machine

    def __missing__(self, piece: str) -> int:
        n = self.machine.run(self.machine.begin, piece)[1]
        if len(piece) <= 24:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[piece] = n
        return n


class ChunkMap:
    """The state map of one chunk. States are named by their keys, which outlive a drop of the built states."""

    def __init__(self, machine: "Machine", text: str, entries: Iterable[tuple] = ()):
        self.machine, self.known = machine, {}
        cut = CUTS.search(text)
        self.head, self.tail = (text, None) if cut is None else (text[: cut.start()], text[cut.start() :])
        if self.tail is not None:
            *whole, last = CUTS.split(self.tail)
            node, n = machine.run(machine.begin, last)
            self.exit, self.rest = machine.key(node), n + sum(machine.words[w] for w in whole)
        self.path: list[tuple[Node, int]] = []  # of the first run: state and count after each of the first SYNC characters
        for entry in entries:
            self(entry)

    def __call__(self, entry: tuple) -> tuple[tuple, int]:
        got = self.known.get(entry)
        if got is None:
            node, n = self._run(self.machine.node(entry))
            got = self.known[entry] = (self.machine.key(node), n) if self.tail is None else (self.exit, n + self.rest)
        return got

    def _run(self, node: Node) -> tuple[Node, int]:
        m, n = self.machine, 0
        first = not self.path
        for i, ch in enumerate(self.head[:SYNC]):
            node, more = node[ch]
            n += more
            if first:
                self.path.append((node, n))
            elif i < len(self.path) and self.path[i][0] is node:
                return m.node(self.end[0]), self.end[1] + n - self.path[i][1]
        node, more = m.run(node, self.head[SYNC:])
        if first:
            self.end = (m.key(node), n + more)
        return node, n + more


class Composed:
    """One map after another."""

    def __init__(self, a: "ChunkMap | Composed", b: "ChunkMap | Composed"):
        self.a, self.b, self.known = a, b, {}
        for entry in a.known:
            self(entry)

    def __call__(self, entry: tuple) -> tuple[tuple, int]:
        got = self.known.get(entry)
        if got is None:
            middle, n = self.a(entry)
            out, more = self.b(middle)
            got = self.known[entry] = (out, n + more)
        return got


def prefix_scan(maps: list) -> list:
    """The maps of chunks 1..i for each i, in rounds of doubled distance; the compositions of a round do not need each other."""
    distance = 1
    while distance < len(maps):
        maps = [Composed(maps[i - distance], m) if i >= distance else m for i, m in enumerate(maps)]
        distance *= 2
    return maps


class Machine:
    def __init__(self, path: str):
        spec = json.load(open(path))
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normaliser or prefix space is compiled")
        self.path = path
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take neighbouring text are not compiled")
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        self.made: dict[bytes, int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = bytes(alphabet[c] for c in a), bytes(alphabet[c] for c in b)
            self.rank[pair] = i
            if pair[0] + pair[1] not in self.parts:
                self.parts[pair[0] + pair[1]] = pair
                self.made[pair[0] + pair[1]] = i
        self.tokens = frozenset(vocab)
        #: Proper beginnings of entries, each with the entries that go on from it where these are at most FEW.
        self.begins: dict[bytes, list[bytes] | None] = {}
        for t in vocab:
            for k in range(1, len(t)):
                more = self.begins.setdefault(t[:k], [])
                if more is not None:
                    more.append(t)
                    if len(more) > FEW:
                        self.begins[t[:k]] = None
        self.kinds: dict[str, int] = {}
        self.follows = lru_cache(1 << 18)(self._follows)
        self.probe = None
        self.words = Words(self)
        self.reset()

    def reset(self) -> None:
        """Drop all states. They refer to one another in circles, which are undone here: nothing is left to be collected."""
        for node in getattr(self, "nodes", {}).values():
            node.clear()
        self.nodes: dict[tuple[int, int, str], Node] = {}
        self.merges: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.starts: dict[str, tuple[int, int]] = {}
        self.empty = self._state(((b"", None, 0),))
        self.begin = self._node(BEGIN, self.empty)

    # --- merge automaton -------------------------------------------------------------------------------------------

    def _follows(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a, b stand side by side in some encoding.

        They do unless some merge across their border comes before the merges that made the two sides. Undo the
        latest merge of either side, again and again, and look for such a merge at the border each time.
        """
        rank, made, parts = self.rank, self.made, self.parts
        before = 1 << 60
        while True:
            r = rank.get((a, b))
            if r is not None and r < before:
                return False
            ra, rb = made.get(a, -1), made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, parts[a][1]
            else:
                before, b = rb + 1, parts[b][0]  # of two equal merges the left one comes first

    def _state(self, key: tuple) -> int:
        n = self.merges.get(key)
        if n is None:
            n = self.merges[key] = len(self.states)
            self.states.append(key)
        return n

    def push(self, state: int, byte: int) -> tuple[int, int]:
        """One byte into the merge automaton: the next state and the change in the count."""
        got = self.moves.get((state, byte))
        if got is not None:
            return got
        alive = self.states[state]  # (suffix, last token before it or what may follow it, its count minus the count now)
        b = bytes((byte,))
        token = None
        for suffix, last, rel in alive:  # longest suffix first
            t = suffix + b
            if t in self.tokens and self.may(last, t):
                token, change = t, rel + 1
                break
        kept = []
        for suffix, last, rel in alive:
            s = suffix + b
            more = self.begins.get(s, ())
            if more is None:
                kept.append((s, last, rel - change))
            elif more and (ahead := tuple(t for t in more if self.may(last, t))):
                kept.append((s, ahead, rel - change))  # only what may still follow tells states apart
        kept.append((b"", token, 0))
        got = self.moves[state, byte] = self._state(tuple(kept)), change
        return got

    def may(self, last: bytes | tuple | None, t: bytes) -> bool:
        return last is None or (t in last if type(last) is tuple else self.follows(last, t))

    def pushes(self, state: int, text: str) -> tuple[int, int]:
        total = 0
        for byte in text.encode():
            state, change = self.push(state, byte)
            total += change
        return state, total

    # --- splitter --------------------------------------------------------------------------------------------------

    def kind(self, ch: str) -> int:
        """Letter, number, other or space, as the library's own splitter takes it."""
        k = self.kinds.get(ch)
        if k is None:
            if self.probe is None:
                from tokenizers import Tokenizer

                self.probe = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
            whole = lambda first: len(self.probe(first + ch)) == 1
            k = LETTERS if whole("a") else NUMBERS if whole("1") else OTHERS if whole("!") else SPACES
            self.kinds[ch] = k
        return k

    def _node(self, mode: int, merge: int, held: str = "") -> Node:
        key = (mode, merge, held)
        node = self.nodes.get(key)
        if node is None:
            node = self.nodes[key] = Node(self, mode, merge, held)
        return node

    def _fresh(self, text: str) -> tuple[int, int]:
        got = self.starts.get(text)
        if got is None:
            got = self.starts[text] = self.pushes(self.empty, text)
        return got

    def _start(self, ch: str, lead: str = "") -> tuple[Node, int]:
        """A pre-token begins with ch, after a space of its own where ``lead`` is one."""
        kind = self.kind(ch)
        if ch == "'" and not lead:
            merge, n = self._fresh("'")
            return self._node(QUOTE, merge), n
        if kind == SPACES:
            return self._spaces(self.empty, 0, ch)
        merge, n = self._fresh(lead + ch)
        return self._node(kind, merge), n

    def _spaces(self, merge: int, n: int, ch: str) -> tuple[Node, int]:
        """In a run of spaces ``merge`` holds all but the last, which is ``held``; the count is that of the whole run."""
        _, more = self.pushes(merge, ch)
        return self._node(SPACES, merge, ch), n + more

    def step(self, node: Node, ch: str) -> tuple[Node, int]:
        mode, kind = node.mode, self.kind(ch)
        if mode == BEGIN:
            return self._start(ch)
        if mode == SPACES:
            merge, n = self.pushes(node.merge, node.held)
            if kind == SPACES:
                return self._spaces(merge, 0, ch)
            if node.held == " ":  # the last space goes with what follows
                target, more = self._start(ch, " ")
                return target, more - n
            alone, m = self._fresh(node.held)  # the run without its last, then that one, then ch
            target, more = self._start(ch)
            return target, m - n + more
        if mode >= QUOTE:
            if mode == QUOTE and ch in ONE:
                whole = self._fresh("'" + ch)[1]
                return self._node(BEGIN, self.empty), whole - self._fresh("'")[1]
            if mode == QUOTE and ch in TWO:
                merge, n = self._fresh(ch)
                return self._node(TWO[ch][0], merge), n
            first = {m: (c, second) for c, (m, second) in TWO.items()}
            if mode != QUOTE:
                c, second = first[mode]
                if ch == second:
                    whole = self._fresh("'" + c + second)[1]
                    return self._node(BEGIN, self.empty), whole - self._fresh("'")[1] - self._fresh(c)[1]
            mode = OTHERS if mode == QUOTE else LETTERS
        if kind == mode:
            merge, n = self.pushes(node.merge, ch)
            return self._node(mode, merge), n
        return self._start(ch)

    # --- runs and maps ---------------------------------------------------------------------------------------------

    def run(self, node: Node, text: str) -> tuple[Node, int]:
        if len(self.states) > MAX_STATES or len(self.nodes) > MAX_STATES or len(self.starts) > MAX_STARTS:
            mode, key, held = node.mode, self.states[node.merge], node.held
            self.reset()
            node = self._node(mode, self._state(key), held)
        n = 0
        for ch in text:
            node, more = node[ch]
            n += more
        return node, n

    def key(self, node: Node) -> tuple:
        """What tells a state from others, whatever has been built or dropped."""
        return node.mode, self.states[node.merge], node.held

    def node(self, key: tuple) -> Node:
        mode, merge, held = key
        return self._node(mode, self._state(merge), held)

    def count_piece(self, text: str) -> int:
        """Cut where every state map is constant and add; longer texts are counted by the maps of their chunks."""
        if len(text) > CHUNK:
            return self.count_long(text)
        pieces = PIECES.findall(text)
        if sum(map(len, pieces)) != len(text):
            pieces = CUTS.split(text)
        words = self.words
        return sum([words[p] for p in pieces])

    def entries(self, before: str) -> list[tuple]:
        """States in which ``before`` may end, by beginning a little earlier and earlier."""
        found, back = {}, 1
        while True:
            node, _ = self.run(self.begin, before[-back:])
            found[self.key(node)] = None
            if back >= min(len(before), LOOK):
                return list(found)
            back *= 2

    def count_long(self, text: str) -> int:
        cuts = range(0, len(text), CHUNK)
        begin = self.key(self.begin)
        maps = [ChunkMap(self, text[at : at + CHUNK], self.entries(text[max(0, at - LOOK) : at]) if at else [begin]) for at in cuts]
        return prefix_scan(maps)[-1](begin)[1]

    def count(self, text: str) -> int:
        for i, mark in enumerate(self.special):
            if mark in text:
                return self._count_special(text)
        return self.count_piece(text)

    def _count_special(self, text: str) -> int:
        """Leftmost special strings, longest first at a place, count one each and cut the text."""
        n, at = 0, 0
        marks = sorted(self.special, key=len, reverse=True)
        while True:
            found = [(text.find(m, at), -len(m), m) for m in marks]
            found = [x for x in found if x[0] >= 0]
            if not found:
                return n + self.count_piece(text[at:])
            where, _, m = min(found)
            n += self.count_piece(text[at:where]) + 1
            at = where + len(m)


@lru_cache(4)
def machine(path: str) -> Machine:
    return Machine(path)
