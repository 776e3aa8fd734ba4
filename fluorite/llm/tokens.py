"""Token counts by finite-state transducers.

A byte-level BPE tokenizer is compiled to two machines. The first splits text
into pieces: a deterministic transducer over character classes that emits at the
transitions that open a piece. What it must see to the right (a contraction, the
end of white space) is bounded and folded into the input symbol. Text is cut
into chunks; each chunk becomes a map from any state to the state after it, the
maps are composed by a parallel prefix scan, and then all chunks emit at once.

The second machine reads the bytes of pieces, and each transition carries the
number of tokens that its byte adds (0 or less where tokens grow together). It
rests on a property of byte-pair encoding: a sequence of tokens is the encoding
of its bytes exactly if every two neighbours are (see Vocabulary.border), so the
last token of every prefix follows from earlier prefixes' last tokens. A state
is what can still matter of them: for every place from which a token may still
run on, where in the vocabulary's tree it is, the last token before it and how
many tokens lie between. States and transitions are compiled when they are
first met. An opening resets the machine, so a chunk's map is constant from its
first opening on: chunks are read from there at once, then their heads from the
state that the chunk before hands on.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, ship

# Input symbols
RESET, LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_X, BLANK_X, BLANK = range(9)
# States: between pieces; in letters, numbers, others; after the space that opens a piece; in blanks; with one, two letters of a contraction to come
FREE, IN_L, IN_N, IN_O, JOINED, IN_B, ONE, TWO = range(8)
N_SYMBOLS, N_STATES = 9, 8
CHUNK = 256
#: Characters that are turned into arrays at a time, longer texts excepted.
SLAB = 1 << 19
#: Compiled states that a worker keeps from one slab to the next; 1 KB each.
STATES = 1 << 17
#: Rounds in which all chunks pass their states on at once; the rest is read in order.
ROUNDS = 8

# Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emits) by state and symbol."""
    opens = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, SHORT: ONE, LONG: TWO, SPACE_X: JOINED, BLANK_X: FREE, BLANK: IN_B}
    after, emits = np.zeros((N_STATES, N_SYMBOLS), np.uint8), np.zeros((N_STATES, N_SYMBOLS), np.uint8)
    stays = {
        IN_L: {LETTER: IN_L}, IN_N: {NUMBER: IN_N}, IN_O: {OTHER: IN_O, SHORT: IN_O, LONG: IN_O}, IN_B: {BLANK: IN_B},
        JOINED: {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, SHORT: IN_O, LONG: IN_O}, ONE: dict.fromkeys(opens, FREE), TWO: dict.fromkeys(opens, ONE),
    }
    for state in range(N_STATES):
        after[state, RESET] = FREE
        for symbol, opened in opens.items():
            kept = stays.get(state, {}).get(symbol)
            after[state, symbol], emits[state, symbol] = (opened, 1) if kept is None else (kept, 0)
    return after, emits


def character_classes() -> np.ndarray:
    classes = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            classes[c] = LETTER
        elif kind == "N":
            classes[c] = NUMBER
    classes[WHITE] = BLANK
    return classes


_classes: np.ndarray | None = None
_after, _emits = splitter()


def symbols(codes: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Input symbols of code points; resets are the places between texts."""
    global _classes
    if _classes is None:
        _classes = character_classes()
    s = _classes[codes]
    s[resets] = RESET
    quotes = np.flatnonzero((codes == 0x27) & (s == OTHER))
    if len(quotes):
        at = lambda d: np.where(quotes + d < len(codes), codes[np.minimum(quotes + d, len(codes) - 1)], 0)
        free = lambda d: np.where(quotes + d < len(codes), s[np.minimum(quotes + d, len(codes) - 1)], RESET) == LETTER
        one, two = at(1), at(2)
        s[quotes[np.isin(one, [ord(c) for c in "stmd"]) & free(1)]] = SHORT
        pairs = sum((one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")).astype(bool)
        s[quotes[pairs & free(1) & free(2)]] = LONG
    blank = s == BLANK
    ahead = np.zeros(len(s), bool)
    ahead[:-1] = ~blank[1:] & (s[1:] != RESET)
    last = blank & ahead
    s[last] = np.where(codes[last] == 0x20, SPACE_X, BLANK_X)
    return s


def openings(symbol: np.ndarray) -> np.ndarray:
    """Places at which the splitter emits, by chunk maps and a prefix scan over them."""
    n = -(-len(symbol) // CHUNK)
    padded = np.zeros(n * CHUNK, np.uint8)
    padded[: len(symbol)] = symbol
    grid = np.ascontiguousarray(padded.reshape(n, CHUNK).T).astype(np.intp)
    table = _after.astype(np.intp).ravel()
    maps = np.tile(np.arange(N_STATES, dtype=np.intp), (n, 1))
    for column in grid:
        maps = table[maps * N_SYMBOLS + column[:, None]]
    reach = 1
    while reach < n:  # maps[i] becomes that of chunks 0 to i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1) if reach else maps
        reach *= 2
    state = np.concatenate([[FREE], maps[:-1, FREE]])
    out = np.empty((CHUNK, n), np.uint8)
    emits = _emits.ravel()
    for j, column in enumerate(grid):
        at = state * N_SYMBOLS + column
        out[j] = emits[at]
        state = table[at]
    return np.flatnonzero(out.T.reshape(-1)[: len(symbol)])


def shown_bytes() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens in order of their merges, 0 to 255 the bytes; a tree of those that encode themselves."""

    def __init__(self, merges: list[tuple[str, str]]) -> None:
        shown = shown_bytes()
        names = {c: b for c, b in shown.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        spelled: list[bytes] = [bytes([b]) for b in range(256)]
        for x, y in merges:
            if x + y in names or x not in names or y not in names:
                raise ValueError("merges that make a token twice or of unknown parts aren't supported")
            token = len(self.parts)
            self.rank[names[x], names[y]] = token
            self.parts.append((names[x], names[y]))
            spelled.append(spelled[names[x]] + spelled[names[y]])
            names[x + y] = token
        self.known: dict[int, bool] = {}
        own = [True] * 256
        for token in range(256, len(self.parts)):
            x, y = self.parts[token]
            own.append(own[x] and own[y] and self.border(x, y, token, token))
        # the tree: child of (node * 256 + byte), token that ends at a node, and whether the node goes on
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.goes_on: list[bool] = [True]
        for token, letters in enumerate(spelled):
            if own[token]:
                node = 0
                for b in letters:
                    self.goes_on[node] = True
                    node = self.child.setdefault(node << 8 | b, len(self.token))
                    if node == len(self.token):
                        self.token.append(-1)
                        self.goes_on.append(False)
                self.token[node] = token

    def border(self, x: int, y: int, made_x: int = 1 << 40, made_y: int = 1 << 40) -> bool:
        """Whether no merge joins x and y across their border while they are made.

        Going back in time the later of the two last merges beside the border is
        undone. In between the two tokens beside it stand side by side; a merge
        of them would come first if it is before those that used them up, and in
        a tie if it is to their left.
        """
        rank, parts = self.rank, self.parts
        while True:
            joined = rank.get((x, y))
            if joined is not None and joined < made_x and joined <= made_y:
                return False
            if x > y:
                if x < 256:
                    return True
                made_x, x = x, parts[x][1]
            else:
                if y < 256:
                    return True
                made_y, y = y, parts[y][0]

    def neighbours(self, x: int, y: int) -> bool:
        key = x << 32 | y
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 1 << 20:
                self.known.clear()
            found = self.known[key] = self.border(x, y)
        return found


class Transducer:
    """The second machine, compiled as it is run. State 0 opens a piece."""

    def __init__(self, merges: list[tuple[str, str]]) -> None:
        self.vocabulary = Vocabulary(merges)
        self.reset()

    def reset(self) -> None:
        #: What a state knows: (node, last token before it or -1, tokens since), the last place first.
        self.states: list[tuple[tuple[int, int, int], ...]] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.table = np.full(1 << 18, -1, np.int32)
        self.emits = np.zeros(1 << 10, np.int8)

    def compile(self, key: int) -> int:
        v, after, token, count = self.vocabulary, [], -1, 0
        byte, neighbours = key & 255, self.vocabulary.neighbours
        for node, last, since in self.states[key >> 8]:
            node = v.child.get(node << 8 | byte)
            if node is not None:
                if token < 0 and (t := v.token[node]) >= 0 and (last < 0 or neighbours(last, t)):
                    token, count = t, since
                if v.goes_on[node]:
                    after.append((node, last, since))
        emitted = 1 - count
        state = ((0, token, 0), *[(node, last, since + emitted) for node, last, since in after], emitted)
        at = self.number.setdefault(state, len(self.states))
        if at == len(self.states):
            self.states.append(state[:-1])
            if at == len(self.emits):
                self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)])
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.emits[at] = emitted
        self.table[key] = at
        return at

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = state.astype(np.intp) << 8 | byte
        after = self.table[key]
        new = after < 0
        if new.any():
            for k in np.unique(key[new]).tolist():
                self.compile(k)
            after = self.table[key]
        return after

    def run(self, data: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """The tokens that every byte adds; opens: bytes with which a piece begins, the first one too."""
        n = -(-len(data) // CHUNK)
        grid, fresh = (np.zeros(n * CHUNK, d) for d in (np.uint8, bool))
        grid[: len(data)], fresh[: len(data)] = data, opens
        fresh[len(data) :] = True
        grid, fresh = (np.ascontiguousarray(v.reshape(n, CHUNK).T) for v in (grid, fresh))
        states = np.full((CHUNK, n), -1, np.int32)
        lanes, state = np.empty(0, np.intp), np.empty(0, np.int32)
        for j in range(CHUNK):  # each chunk from its first opening, whatever comes before
            new = np.flatnonzero(fresh[j] & (states[j - 1] < 0)) if j else np.flatnonzero(fresh[0])
            if len(new):
                lanes, state = np.concatenate([lanes, new]), np.concatenate([state, np.zeros(len(new), np.int32)])
            state = self.step(np.where(fresh[j, lanes], 0, state), grid[j, lanes])
            states[j, lanes] = state
        came = np.full(n, -1, np.int32)
        for _ in range(ROUNDS):  # and up to there from the state that the chunk before hands on
            comes = np.concatenate([came[:1], states[-1, :-1]])
            lanes = np.flatnonzero((comes != came) & ~fresh[0])
            if not len(lanes):
                break
            came = comes
            self._read_on(grid, fresh, states, lanes, comes[lanes])
        for k in np.flatnonzero(states[0] < 0).tolist():  # what is left of very long pieces
            at = int(states[-1, k - 1])
            for j, byte in enumerate(grid[:, k].tolist()):
                if fresh[j, k]:
                    break
                key = at << 8 | byte
                at = int(self.table[key])
                if at < 0:
                    at = self.compile(key)
                states[j, k] = at
        return self.emits[states].T.reshape(-1)[: len(data)]

    def _read_on(self, grid: np.ndarray, fresh: np.ndarray, states: np.ndarray, lanes: np.ndarray, state: np.ndarray) -> None:
        """Reads the heads of chunks, up to their first opening."""
        for j in range(CHUNK):
            on = ~fresh[j, lanes]
            lanes, state = lanes[on], state[on]
            if not len(lanes):
                return
            state = states[j, lanes] = self.step(state, grid[j, lanes])


class TokenCounter:
    """Counts of whole texts. special: strings that are one token wherever they stand."""

    def __init__(self, merges: list[tuple[str, str]], special: list[str]) -> None:
        self.machine, self.special = Transducer(merges), sorted(special, key=len, reverse=True)

    @staticmethod
    def parameters(file: str) -> tuple[list[tuple[str, str]], list[str]]:
        """What a tokenizer.json file says; ValueError if it isn't a plain byte-level BPE."""
        with open(file, encoding="utf-8") as f:
            j = json.load(f)
        before, model = j["pre_tokenizer"], j["model"]
        plain = j["normalizer"] is None and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{file} is not a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in j["added_tokens"]):
            raise ValueError(f"{file} has added tokens that take up their surroundings")
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        return merges, [t["content"] for t in j["added_tokens"]]

    def _segments(self, text: str) -> tuple[list[str], int]:
        segments, extra = [text], 0
        for s in self.special:
            if s in text:
                cut = [part.split(s) for part in segments]
                extra += sum(len(c) - 1 for c in cut)
                segments = [p for c in cut for p in c]
        return segments, extra

    def __call__(self, texts: list[str | None]) -> list[int]:
        counts, held, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            if text:
                segments, counts[i] = self._segments(text)
                held += [(i, s) for s in segments if s]
                size += len(text)
            if held and (size >= SLAB or i == len(texts) - 1):
                self._count(held, counts)
                held, size = [], 0
        if held:
            self._count(held, counts)
        return counts

    def _count(self, segments: list[tuple[int, str]], counts: list[int]) -> None:
        whole = "\0".join(s for _, s in segments) + "\0"
        ends = np.cumsum([len(s) + 1 for _, s in segments]) - 1
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        opened = openings(symbols(codes, ends))
        width = 1 + (codes >= 0x80) + (codes >= 0x800).astype(np.int64) + (codes >= 0x10000)
        place = np.cumsum(width) - width  # of characters among the bytes
        data = np.frombuffer(whole.encode(), np.uint8)
        opens = np.zeros(len(data), bool)
        opens[place[opened]] = True
        opens[place[ends]] = True  # what stands between texts is a piece of its own
        if len(self.machine.states) > STATES:
            self.machine.reset()
        emitted = self.machine.run(data, opens)
        starts = np.concatenate([[0], place[ends[:-1]] + 1])
        totals = np.add.reduceat(emitted, starts, dtype=np.int64) - emitted[place[ends]]
        for (i, _), total in zip(segments, totals.tolist(), strict=True):
            counts[i] += total


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_bytes and n_tokens (long) and over_limit (n_tokens > limit) for each row of docs.

    Null and empty texts have 0 of each. Special strings in a text count as the
    one token they are to the tokenizer. The tokenizer's merges are broadcast;
    they are as large as its file. Repeated rows get equal counts; empty input:
    no rows; other columns of docs are ignored.
    """
    merges, special = TokenCounter.parameters(tokenizer_file)
    sent = ship(docs.sparkSession).sparkContext.broadcast((merges, special))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _counters:
            _counters[tokenizer_file] = TokenCounter(*sent.value)
        counter = _counters[tokenizer_file]
        for batch in batches:
            n = np.array(counter(batch.column(2).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    fields = [("id", docs.schema[id_col].dataType), ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    return rows.mapInArrow(count, T.StructType([T.StructField(*f) for f in fields])).withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str, file: str | None = None) -> DataFrame:
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(read(spark, sf_dir, "documents"), file)


QUERIES = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}
