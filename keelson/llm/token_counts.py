"""Token counts by finite-state tokenizer compilation.

The BPE vocabulary is compiled, on demand, into a deterministic transducer over the symbols of a word. Its state holds
what the rest of the word can still depend on: the last token so far and, for every start from which a longer token can
still grow, the place in the token trie, the token that ended there and how many tokens lie behind that start. A
transition reads a symbol and emits how many tokens more (or fewer) the word has now. Two tokens can stand side by side
if no merge crosses their seam, so each prefix of a word has exactly one last token, and merging by rank gives the same.

White space resets the transducer. A text is cut into chunks anywhere; each chunk becomes a state map: for a chunk with
white space in it all start states meet there, so the map is the open head, the count between, and the open tail. Inside
one long word nothing resets, and a chunk's map goes from start state to end state and count, for the states that the
symbols before it lead to from several places; a start state that isn't among them is added when a composition asks for
it, so the map is exact. Maps compose associatively, and a count is the composition of all maps in a tree.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import map_rows, whole_text
from keelson.llm.seams import NEVER, can_meet

CHUNK_CHARS = 65_536
MEMO_WORDS = 1_000_000
MEMO_CHARS = 64
#: Symbols of a word beyond which it is counted by chunk maps, and how far before a chunk its start states are looked for.
WORD_CHUNK = 16_384
LOOK_BACK = (16, 32, 64)
STATES = 200_000

# The characters that Unicode calls white space; Python's own split() also cuts at U+001C to U+001F.
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")

# A tokenizer file's word pattern as its JSON spells it, and the same for lower-case ASCII.
_ASCII_WORDS_OF = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


#: No token yet, and none that grows.
START = (None, ())


class WordTransducer:
    """Counts the tokens of a word, given as a string of byte characters; ``end`` marks a word's last symbol."""

    def __init__(self, merges: list[tuple[str, str]], end: str, alphabet: str):
        self.end = end
        self.rank: dict[tuple[str, ...], int] = {}
        self.pairs: dict[tuple[str, ...], list[tuple[tuple[str, ...], tuple[str, ...]]]] = {}
        self.trie: list[dict[str, int]] = [{}]
        self.token_at: list[tuple[str, ...] | None] = [None]
        for char in alphabet:
            self._grow((char,))
            self._grow((char + end,))
        for n, (left, right) in enumerate(merges):
            a, b = self._symbols(left), self._symbols(right)
            if (a, b) not in self.rank:
                self.rank[a, b] = n
                self.pairs.setdefault(a + b, []).append((a, b))
                self._grow(a + b)
        self._halves_of: dict[tuple[str, ...], tuple | None] = {}
        self._edges: dict[tuple, tuple[list, list[int]]] = {}
        self._fits: dict[tuple, bool] = {}
        self._start_over()

    def _symbols(self, token: str) -> tuple[str, ...]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            bare = token[: -len(self.end)]
            return (*bare[:-1], bare[-1] + self.end)
        return tuple(token)

    def _grow(self, token: tuple[str, ...]) -> None:
        node = 0
        for symbol in token:
            if symbol not in self.trie[node]:
                self.trie[node][symbol] = len(self.trie)
                self.trie.append({})
                self.token_at.append(None)
            node = self.trie[node][symbol]
        self.token_at[node] = token

    def _start_over(self) -> None:
        self.states: list[tuple] = [START]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]

    def count(self, word: str) -> int:
        if len(self.states) > STATES:
            self._start_over()
        if not word:
            return 0
        arcs, state, total = self.arcs, 0, 0
        if len(word) > WORD_CHUNK:
            end, total = self.scanned(word[:-1])
            state = self._numbered(end)
        else:
            for symbol in word[:-1]:
                state, emitted = arcs[state].get(symbol) or self._compile(state, symbol)
                total += emitted
        symbol = word[-1] + self.end
        return total + (arcs[state].get(symbol) or self._compile(state, symbol))[1]

    def run(self, start: tuple, symbols: str) -> tuple[tuple, int]:
        """The end state and the count from a start state."""
        arcs, state, total = self.arcs, self._numbered(start), 0
        for symbol in symbols:
            state, emitted = arcs[state].get(symbol) or self._compile(state, symbol)
            total += emitted
        return self.states[state], total

    def scanned(self, symbols: str) -> tuple[tuple, int]:
        """run() from the first state, as the composition of the maps of the chunks."""
        maps = [ChunkMap(self, symbols[at : at + WORD_CHUNK], [START] if at == 0 else [self.run(START, symbols[max(0, at - n) : at])[0] for n in LOOK_BACK]) for at in range(0, len(symbols), WORD_CHUNK)]
        while len(maps) > 1:
            maps = [ComposedMap(*maps[n : n + 2]) if n + 1 < len(maps) else maps[n] for n in range(0, len(maps), 2)]
        return maps[0].from_state(START)

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        last, growing = self.states[state]
        chosen, emitted, grown = None, 0, []
        for node, before, behind in (*growing, (0, last, 0)):
            node = self.trie[node].get(symbol, -1)
            if node < 0:
                continue
            grown.append((node, before, behind))
            token = self.token_at[node]
            if token is not None and self._built(token) and (before is None or self.can_stand(before, token)):
                chosen, emitted = token, 1 - behind
        if chosen is None:
            raise ValueError(f"the vocabulary has no token for {symbol!r}")
        found = (chosen, tuple((node, before, behind + emitted) for node, before, behind in grown if self.trie[node]))
        self.arcs[state][symbol] = arc = (self._numbered(found), emitted)
        return arc

    def _numbered(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.arcs.append({})
        return self.number[state]

    # -- which tokens can stand side by side --------------------------------------------------------------------------

    def _halves(self, token: tuple[str, ...]) -> tuple | None:
        """The pair whose merge builds the token when it is merged alone, or None."""
        if token not in self._halves_of:
            options = sorted(self.pairs.get(token, ()), key=self.rank.__getitem__)
            self._halves_of[token] = next((p for p in options if self._built(p[0]) and self._built(p[1]) and self.can_stand(*p, self.rank[p])), None)
        return self._halves_of[token]

    def _built(self, token: tuple[str, ...]) -> bool:
        return len(token) == 1 or self._halves(token) is not None

    def _edge(self, token: tuple[str, ...], right: bool) -> tuple[list, list[int]]:
        """The tokens at one edge while the token is built, and the rank of the merge that ends each."""
        if (token, right) not in self._edges:
            chain, ends = [token], [NEVER]
            while len(chain[-1]) > 1:
                halves = self._halves(chain[-1])
                ends.append(self.rank[halves])
                chain.append(halves[right])
            self._edges[token, right] = (chain[::-1], ends[::-1])
        return self._edges[token, right]

    def can_stand(self, a: tuple[str, ...], b: tuple[str, ...], limit: int = NEVER) -> bool:
        """Whether no merge of rank under ``limit`` crosses the seam; of equal ranks the leftmost merge comes first."""
        key = (a, b)
        if limit == NEVER and (known := self._fits.get(key)) is not None:
            return known
        ok = can_meet(*self._edge(a, True), *self._edge(b, False), self._rank_of, limit)
        if limit == NEVER:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            self._fits[key] = ok
        return ok

    def _rank_of(self, a: tuple[str, ...], b: tuple[str, ...]) -> int:
        return self.rank.get((a, b), NEVER)


class ChunkMap:
    """What a chunk inside a word does: (end state, count) by start state."""

    def __init__(self, transducer: WordTransducer, symbols: str, starts: list[tuple]):
        self.transducer, self.symbols = transducer, symbols
        self.known = {x: transducer.run(x, symbols) for x in set(starts)}

    def from_state(self, start: tuple) -> tuple[tuple, int]:
        if start not in self.known:
            self.known[start] = self.transducer.run(start, self.symbols)
        return self.known[start]


class ComposedMap:
    """One map after another."""

    def __init__(self, first: ChunkMap | ComposedMap, second: ChunkMap | ComposedMap):
        self.first, self.second = first, second
        self.known = {x: self._through(x) for x in first.known}

    def _through(self, start: tuple) -> tuple[tuple, int]:
        middle, n = self.first.from_state(start)
        end, m = self.second.from_state(middle)
        return end, n + m

    def from_state(self, start: tuple) -> tuple[tuple, int]:
        if start not in self.known:
            self.known[start] = self._through(start)
        return self.known[start]


class StateMap(NamedTuple):
    """What a chunk does. Without white space in it: all of it is head and ``count`` is -1."""

    head: str
    count: int
    tail: str


class TokenCounter:
    """Counts a text's tokens as the tokenizers library does for a BPE file with byte-level words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain BPE files can be compiled")
        library = Tokenizer.from_file(path)
        self.normalize, self.words = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        end = model.get("end_of_word_suffix") or ""
        alphabet = "".join(x for x in model["vocab"] if len(x) == 1)
        self.transducer = WordTransducer(merges, end, alphabet)
        specials = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        # On printable ASCII without white space the file's word pattern and lower casing are these; other text goes by the library.
        self.ascii_words = _ASCII_WORDS if _ASCII_WORDS_OF in json.dumps(spec["pre_tokenizer"]) and "Lowercase" in json.dumps(spec["normalizer"]) else None
        self.memo: dict[str, int] = _Memo(self)

    def piece(self, piece: str) -> int:
        """Tokens of a piece without white space; special strings in it are one token each."""
        if self.specials is None or not (cut := self.specials.split(piece))[1:]:
            return self._plain(piece)
        return len(cut) - 1 + sum(map(self._plain, cut))

    def _plain(self, piece: str) -> int:
        if self.ascii_words and piece.isascii() and piece.isprintable():
            return sum(map(self.transducer.count, self.ascii_words.findall(piece.lower())))
        return sum(self.transducer.count(word) for word, _ in self.words(self.normalize(piece)))

    def map_of(self, chunk: str) -> StateMap:
        pieces = _WHITE.split(chunk) if _SEPARATORS.search(chunk) else None
        if pieces is None:
            pieces = chunk.split()
            if not pieces:
                return StateMap("", 0 if chunk else -1, "")
            if chunk[0].isspace():
                pieces.insert(0, "")
            if chunk[-1].isspace():
                pieces.append("")
        if len(pieces) == 1:
            return StateMap(chunk, -1, "")
        return StateMap(pieces[0], sum(map(self.memo.__getitem__, pieces[1:-1])), pieces[-1])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if a.count < 0:
            return StateMap(a.head + b.head, b.count, b.tail)
        if b.count < 0:
            return StateMap(a.head, a.count, a.tail + b.head)
        return StateMap(a.head, a.count + self.memo[a.tail + b.head] + b.count, b.tail)

    def count(self, text: str) -> int:
        maps = [self.map_of(text[at : at + CHUNK_CHARS]) for at in range(0, len(text), CHUNK_CHARS)] or [StateMap("", -1, "")]
        while len(maps) > 1:
            maps = [self.compose(*maps[n : n + 2]) if n + 1 < len(maps) else maps[n] for n in range(0, len(maps), 2)]
        head, count, tail = maps[0]
        return self.memo[head] + max(count, 0) + self.memo[tail]


class _Memo(dict):
    def __init__(self, counter: TokenCounter):
        super().__init__({"": 0})
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        found = self.counter.piece(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
                self[""] = 0
            self[piece] = found
        return found


@lru_cache(maxsize=2)
def counter_for(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens): UTF-8 length and token count of every whole text.

    A null text is the empty text: 0 and 0. Rows are kept as they are, repeated ones and null keys too; other columns
    are not read. An empty table gives an empty one. ``path`` must be there on every executor. A long text is one task's
    work, linear in its length.
    """
    kind = docs.schema[key].dataType.simpleString()

    def make():
        counter = counter_for(path)

        def step(rows: pa.RecordBatch) -> pa.RecordBatch:
            counts = [counter.count(x) for x in rows.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(counts, pa.int64())], [key, "n_bytes", "n_tokens"])

        return step

    whole = whole_text(text)
    return map_rows(docs.select(key, F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text")), f"`{key}` {kind}, n_bytes bigint, n_tokens bigint", make)
