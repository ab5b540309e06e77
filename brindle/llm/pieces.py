"""Encoding and decoding with a merge-type piece vocabulary, by a table over prefixes.

Of every prefix of a chunk, greedy merging leaves exactly one last token. The table stores it: among
the tokens that an automaton finds to end at a position, it is the one whose pair with the last token
of the prefix before it is compatible, that is, merging the two tokens' joined characters gives the
two tokens again. The ids are then recovered from the end backwards. No merge queue runs over a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from .common import as_bytes, mapped, own_columns, small_batches

MARK = "▁"
#: Bytes that a worker remembers of chunks, and of pairs of tokens; what is used least goes, which changes no result.
CHUNK_BYTES, PAIR_BYTES = 8 << 20, 4 << 20
#: Texts by which a vocabulary file shows its rules: the mark put first, runs of spaces, composed and wide letters, controls.
PROBES = ("a", " a", "a  b ", "   ", "A b", "▁x▁", "\ta\r\nb", "\n", "e\u0301 é ﬁ Ａ ½ \u00a0x\u3000y", "日本\U0001d4b3", "\x00\x07", "<s></s><unk>", "1,234.5")
#: Chunks of which the tables are filled together, so that they stay near the processor.
SLICE = 16384
#: Prefixes of the chunks of a slice, at most.
CELLS = 1 << 19
#: Characters up to which a chunk's table is filled with others; of a longer one alone, with the same result.
LEVELS = 256
#: Pairs that the table of many chunks remembers, each at a place of its own that a later pair may take.
PAIRS = 1 << 18
#: Bytes of an entry of a dictionary and of its two objects' heads.
ENTRY = 220


class Recent(dict):
    """A dictionary that computes what it lacks and forgets what was not asked for lately, to stay under a number of bytes.

    It holds two generations: when the young one is half the bytes, it becomes the old one, and what is asked for again returns.
    """

    def __init__(self, most: int):
        self.most, self.bytes, self.old = most // 2, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.made(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        size = self.size(key, value)
        if size < self.most:
            if self.bytes + size > self.most:
                self.old, self.bytes = dict(self), 0
                self.clear()
            self[key] = value
            self.bytes += size

    def size(self, key, value) -> int:
        return ENTRY


class States:
    """The automaton over the tokens as arrays, in which many chunks take a step at once. State 0 has read no token's beginning."""

    def __init__(self, tokens: dict[str, int]):
        go: list[dict[str, int]] = [{}]
        own: list[tuple[int, ...]] = [()]
        for text, i in tokens.items():
            state = 0
            for c in text:
                if c not in go[state]:
                    go[state][c] = len(go)
                    go.append({})
                    own.append(())
                state = go[state][c]
            own[state] = (i,)
        fail, queue = [0] * len(go), [0]
        for state in queue:  # it grows: states by their depth
            for c, then in go[state].items():
                queue.append(then)
                back = fail[state]
                while back and c not in go[back]:
                    back = fail[back]
                fail[then] = go[back].get(c, 0) if state else 0
                own[then] = own[then] + own[fail[then]] if own[then] else own[fail[then]]
        names = sorted({c for edges in go for c in edges})
        self.wide, self.names = len(names) + 1, np.zeros(0x110000, np.int32)  # name 0: a character of no token
        self.names[[ord(c) for c in names]] = np.arange(1, self.wide)
        self.fail = np.array(fail, np.int64)
        self.counts = np.fromiter(map(len, own), np.int64, len(own))
        self.first = np.cumsum(self.counts) - self.counts
        self.tokens = np.fromiter(chain.from_iterable(own), np.int64)  # those that end where a state is reached
        number = dict(zip(names, range(1, self.wide), strict=True))
        edges = np.array([(a * self.wide + number[c], b) for a, some in enumerate(go) for c, b in some.items()], np.int64).reshape(-1, 2)
        self.most = (4 << len(edges).bit_length()) - 1
        self.keys, self.to = np.full(self.most + 1, -1, np.int64), np.zeros(self.most + 1, np.int32)
        place = self._place(edges[:, 0])
        while len(edges):  # those whose place is taken go on to the next
            free = np.flatnonzero(self.keys[place] < 0)
            self.keys[place[free]] = edges[free, 0]
            kept = self.keys[place] == edges[:, 0]
            self.to[place[kept]] = edges[kept, 1]
            edges, place = edges[~kept], (place[~kept] + 1) & self.most

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * -7046029254386353131) >> 24) & self.most

    def _edge(self, state: np.ndarray, name: np.ndarray) -> np.ndarray:
        """The states that follow in the tree; 0 where none does."""
        key = state * self.wide + name
        place = self._place(key)
        held = self.keys[place]
        out = np.where(held == key, self.to[place], 0).astype(np.int64)
        odd = np.flatnonzero((held != key) & (held >= 0))
        while len(odd):
            place[odd] = (place[odd] + 1) & self.most
            held = self.keys[place[odd]]
            same = held == key[odd]
            out[odd[same]] = self.to[place[odd[same]]]
            odd = odd[~same & (held >= 0)]
        return out

    def step(self, state: np.ndarray, name: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        out = self._edge(state, name)
        left = np.flatnonzero((out == 0) & (state > 0))
        state, name = state[left], name[left]
        while len(left):
            state = self.fail[state]
            out[left] = then = self._edge(state, name)
            on = np.flatnonzero((then == 0) & (state > 0))
            left, state, name = left[on], state[on], name[on]
        return out


class Pieces:
    """A vocabulary file's pieces and the prefix table over them."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = range(model.get_piece_size())
        self.eos = model.eos_id()
        self.texts = [model.id_to_piece(i) for i in size]
        self.special = {i for i in size if model.is_control(i) or model.is_unknown(i)}
        for i in self.special:
            self.texts[i] = model.decode([i])  # nothing, or the mark of the unknown
        self.bytes = {int(self.texts[i][3:5], 16): i for i in size if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {self.texts[i]: i for i in size if i not in self.special and i not in self.byte_of and not model.is_unused(i)}
        self.scores = {i: model.get_score(i) for i in self.ids.values()}
        if any(MARK in text.lstrip(MARK) for text in self.ids) or any("\n" in text or len(text) > 255 for text in self.ids):
            raise ValueError("pieces that reach over a word's start or a line's end aren't supported")
        self.known = {c for text in self.ids for c in text}
        self.joined = {text[k : k + 2] for text in self.ids for k in range(len(text) - 1)}  # no piece joins other neighbours
        self.newline = str(self.bytes[10])
        self.automaton = ahocorasick.Automaton()
        #: Of each token while its characters merge: the next merge's score, and the parts at its left and its right end.
        self.steps = {}
        own = {text: text for text in self.ids}  # parts are pieces: each is held once
        for text, i in self.ids.items():
            parts, steps = self._merged(text)
            if parts == [text]:  # others are never the result of merging
                self.automaton.add_word(text, i << 8 | len(text))
                self.steps[i] = tuple((s, own.get(x, x), own.get(y, y)) for s, x, y in steps)
        self.automaton.make_automaton()
        self.states = States({text: i for text, i in self.ids.items() if i in self.steps})

    def _merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """Greedy merging of a short string, by its definition: what is left, and the ends' parts before each merge."""
        parts, steps = list(text), []
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best[0]):
                    best = (self.scores[i], k)
            steps.append((best[0] if best else -inf, parts[0], parts[-1]))
            if best is None:
                return parts, steps
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]

    def merge(self, text: str) -> list[int]:
        """Ids that greedy merging leaves of a short string of known characters."""
        return [self.ids.get(p, -1) for p in self._merged(text)[0]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when their joined characters are merged.

        Both merge as they do alone until a merge over their border has the greatest score; of equal ones the left goes first.
        """
        mine, other, a, b = self.steps[left], self.steps[right], 0, 0
        ids, scores = self.ids, self.scores
        while True:
            (s, _, x), (t, y, _) = mine[a], other[b]
            over = ids.get(x + y)
            if over is not None and s < scores[over] >= t:
                return False
            if s >= t:
                if s == -inf:
                    return True
                a += 1
            else:
                b += 1

    def _known(self, text: str, out: list[int], compatible: Pairs) -> None:
        last = [-1] * (len(text) + 1)  # last[i]: the last token of the prefix of length i
        for end, found in self.automaton.iter(text):
            start, i = end + 1 - (found & 255), found >> 8
            if last[end + 1] < 0 and (start == 0 or ((before := last[start]) >= 0 and compatible[before << 32 | i])):
                last[end + 1] = i
        at, ids = len(text), []
        while at:
            i = last[at]
            if i < 0:
                ids = self.merge(text)[::-1]  # a vocabulary without a character of its own pieces
                break
            ids.append(i)
            at -= len(self.texts[i])
        out.extend(reversed(ids))

    def chunk(self, text: str, compatible: Pairs) -> list[int]:
        """Ids of a chunk in which no piece boundary is known; unknown characters fall back to bytes."""
        out: list[int] = []
        if self.known.issuperset(text):
            self._known(text, out, compatible)
            return out
        start = 0
        for k, c in enumerate(text):
            if c not in self.known:
                if k > start:
                    self._known(text[start:k], out, compatible)
                out.extend(self.bytes[b] for b in c.encode("utf-8"))
                start = k + 1
        if start < len(text):
            self._known(text[start:], out, compatible)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids give nothing, bytes that are no UTF-8 give U+FFFD, the mark put first goes."""
        parts: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                parts.append(_utf8(bytes(raw)))
                raw.clear()
            parts.append(self.texts[i].replace(MARK, " "))
        if raw:
            parts.append(_utf8(bytes(raw)))
        text = "".join(parts)
        first = next((i for i in ids if self.texts[i]), None)
        return text[1:] if first is not None and self.texts[first].startswith(MARK) else text


def _utf8(raw: bytes) -> str:
    """As many characters as the bytes hold; each byte of none gives U+FFFD."""
    out, k = [], 0
    while k < len(raw):
        n = 1 if raw[k] < 0x80 else 2 if 0xC2 <= raw[k] < 0xE0 else 3 if 0xE0 <= raw[k] < 0xF0 else 4 if 0xF0 <= raw[k] < 0xF5 else 0
        try:
            out.append(raw[k : k + n].decode("utf-8") if n else "�")
            k += n or 1
        except UnicodeDecodeError:
            out.append("�")
            k += 1
    return "".join(out)


class Pairs(Recent):
    """left << 32 | right -> whether two tokens stay as they are when their joined characters are merged."""

    def __init__(self, pieces: Pieces):
        super().__init__(PAIR_BYTES)
        self.pieces = pieces

    def size(self, key: int, same: bool) -> int:
        return ENTRY // 2

    def made(self, key: int) -> bool:
        return self.pieces.compatible(key >> 32, key & 0xFFFFFFFF)


class Tables:
    """Prefix tables of many chunks at once, filled by the length of the prefix."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.lengths = np.array([len(t) for t in pieces.texts], np.int64)
        self.names = list(map(str, range(len(pieces.texts))))
        self.texts = [t.replace(MARK, " ") for t in pieces.texts]
        self.keys, self.same = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two tokens stay as they are when their joined characters are merged."""
        key = left << 32 | right
        place = ((key * -7046029254386353131) >> 24) & (PAIRS - 1)
        out, new = self.same[place], np.flatnonzero(self.keys[place] != key)
        if len(new):
            some, where = np.unique(key[new], return_inverse=True)
            told = np.fromiter(map(self.pieces.compatible, (some >> 32).tolist(), (some & 0xFFFFFFFF).tolist()), bool, len(some))
            out[new] = told[where]
            at = ((some * -7046029254386353131) >> 24) & (PAIRS - 1)
            self.keys[at] = some
            kept = self.keys[at] == some  # of pairs that share a place one keeps it
            self.same[at[kept]] = told[kept]
        return out

    def ids(self, chunks: list[str]) -> tuple[list[str | None], list[str | None]]:
        """Ids of each chunk in decimal, joined by spaces, and the text that they decode to.

        None for chunks that are empty, longer than LEVELS, or have characters that no piece has.
        """
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(-size, kind="stable")
        order = order[(size[order] > 0) & (size[order] <= LEVELS)]
        out: tuple[list[str | None], list[str | None]] = ([None] * len(chunks), [None] * len(chunks))
        while len(order):
            most = min(SLICE, CELLS // (int(size[order[0]]) + 1))
            some, order = order[:most].tolist(), order[most:]
            for all_of, told in zip(out, self._ids([chunks[j] for j in some]), strict=True):
                for j, x in zip(some, told, strict=True):
                    all_of[j] = x
        return out

    def _ids(self, chunks: list[str]) -> tuple[list[str | None], list[str | None]]:
        """Of chunks from long to short."""
        states, n = self.pieces.states, len(chunks)
        size = np.fromiter(map(len, chunks), np.int64, n)
        begin = np.cumsum(size) - size
        names = states.names[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")]
        longer = n - np.searchsorted(size[::-1], np.arange(size[0]), side="right")  # chunks that have a character there
        last = np.full((int(size[0]) + 1) * n, -1, np.int32)  # at length * n + chunk: the last token of that prefix
        state = np.zeros(n, np.int64)
        for at, m in enumerate(longer.tolist()):
            state = states.step(state[:m], names[begin[:m] + at])
            count = states.counts[state]
            row = np.repeat(np.arange(m), count)
            token = states.tokens[np.arange(len(row)) + np.repeat(states.first[state] - np.cumsum(count) + count, count)]
            start = at + 1 - self.lengths[token]
            before = last[start * n + row].astype(np.int64)
            good = start == 0
            asked = np.flatnonzero(~good & (before >= 0))
            good[asked] = self.compatible(before[asked], token[asked])
            last[(at + 1) * n + row[good]] = token[good]
        # from the ends backwards
        at, now, told, of = size.copy(), np.arange(n), [], []
        broken = np.zeros(n, bool)
        while len(now):
            token = last[at[now] * n + now]
            broken[now[token < 0]] = True
            now, token = now[token >= 0], token[token >= 0]
            told.append(token)
            of.append(now)
            at[now] -= self.lengths[token]
            now = now[at[now] > 0]
        of = np.concatenate(of)
        order = np.argsort(of[::-1], kind="stable")  # a chunk's tokens were found last first
        ids = np.concatenate(told)[::-1][order].tolist()
        ends = np.cumsum(np.bincount(of, minlength=n)).tolist()
        join = lambda names, by: [None if bad else by.join(names[a:b]) for bad, a, b in zip(broken.tolist(), [0, *ends], ends, strict=False)]
        return join([self.names[i] for i in ids], " "), join([self.texts[i] for i in ids], "")


class Chunks(Recent):
    """Chunk -> its ids in decimal, joined by spaces."""

    def __init__(self, pieces: Pieces, compatible: Pairs, before: str, most: int):
        super().__init__(most)
        self.pieces, self.compatible, self.before = pieces, compatible, before
        self.tails = self if not before else Chunks(pieces, compatible, "", most // 10)

    def made(self, word: str) -> str:
        if 1 < len(word) <= 64 and word[-2:] not in self.pieces.joined:
            return f"{self[word[:-1]]} {self.tails[word[-1]]}"
        return " ".join(map(str, self.pieces.chunk(self.before + word, self.compatible)))

    def size(self, word: str, ids: str) -> int:
        return ENTRY + 4 * len(word) + len(ids) if len(word) <= 64 else self.most  # long chunks hardly come again


class Encoder:
    """Encodes whole texts: their chunks are separate, as no piece reaches over a word's start."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        compatible = Pairs(pieces)
        self.tables = Tables(pieces)
        self.first, self.later = Chunks(pieces, compatible, "", CHUNK_BYTES // 5), Chunks(pieces, compatible, MARK, CHUNK_BYTES * 7 // 10)

    def encode(self, text: str) -> str:
        """The ids in decimal, joined by one space, the end id last."""
        if not text:
            return str(self.pieces.eos)
        later, first, out = self.later, self.first, []
        for line in (" " + text).replace(MARK, " ").split("\n"):
            head, *rest = line.split(" ")
            if "" in rest:  # runs of spaces are chunks of their own with the word after them
                rest, spaces = [], 1
                for word in line.split(" ")[1:]:
                    if word:
                        rest.append(MARK * (spaces - 1) + word)
                        spaces = 1
                    else:
                        spaces += 1
                if spaces > 1:
                    rest.append(MARK * (spaces - 2))
            if head:
                out.append(first[head])
            out.extend(map(later.__getitem__, rest))
            out.append(self.pieces.newline)
        out[-1] = str(self.pieces.eos)
        return " ".join(out)


@lru_cache(maxsize=2)
def pieces_of(model_path: str) -> Pieces:
    """A vocabulary file's table, read once by a process; it never grows.

    Files that normalise texts, or treat white space, in another way than this module does are refused.
    """
    pieces = Pieces(model_path)
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=model_path), Encoder(pieces)
    for text in PROBES:
        ids = library.encode(text, add_eos=True)
        if encoder.encode(text) != " ".join(map(str, ids)) or pieces.decode(ids) != library.decode(ids):
            raise ValueError(f"{model_path} treats {text!r} in a way that isn't supported")
    return pieces


class Shared:
    """A worker's encoder for the tasks of one query. It hangs on the query's broadcast: a worker that goes on to another query drops both."""

    def __init__(self):
        self.held: Encoder | None = None

    def encoder(self, pieces: Pieces) -> Encoder:
        if self.held is None:
            self.held = Encoder(pieces)
        return self.held


def encode(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every whole text and the text that they decode to, exactly as the library gives them.

    Returns doc_id, ids (array<int>, the end id last), decoded; one row for each input row, repeated rows
    included. A null text counts as empty: its ids are the end id alone and it decodes to ''. An empty table
    gives no rows. Other columns stay behind.
    """
    return _run(df, model_path, id_column, text_column, "ids array<int>, decoded string", lambda joined, decoded: [pc.split_pattern(joined, " ").cast(pa.list_(pa.field("element", pa.int32()))), decoded])


def digests(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`encode` with its columns folded where they arise: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _run(df, model_path, id_column, text_column, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digest)


def _digest(joined: pa.Array, decoded: pa.Array) -> list:
    ids, texts = as_bytes(joined), as_bytes(decoded)
    return [[x.count(b" ") + 1 for x in ids], *([hashlib.sha256(x).hexdigest() for x in some] for some in (ids, texts))]


class _Texts(dict):
    """Decimal id -> its piece's text; a byte beyond ASCII is left to `Pieces.decode`."""

    def __init__(self, pieces: Pieces):
        super().__init__((str(i), t.replace(MARK, " ")) for i, t in enumerate(pieces.texts) if i not in pieces.byte_of)
        self.update((str(i), chr(b)) for b, i in pieces.bytes.items() if b < 128)

    def of(self, joined: str, pieces: Pieces) -> str:
        """The text of a chunk's ids; no character's bytes reach over its end."""
        try:
            return "".join(map(self.__getitem__, joined.split(" "))) if joined else ""
        except KeyError:
            ids = list(map(int, joined.split(" ")))
            # the mark put first is the whole text's affair
            return (" " if pieces.texts[ids[0]].startswith(MARK) else "") + pieces.decode(ids)


#: Stands before a line's first word, which has no space before it.
HEAD = "\x00"
#: Longer texts are encoded by themselves.
LONG_BYTES = 32 << 20
#: Bytes of texts that are encoded at a time.
TOGETHER_BYTES = 3 << 20


def _together(texts: pa.Array, encoder: Encoder, known: _Texts) -> tuple[pa.Array, pa.Array]:
    """Ids joined by spaces, and decoded texts: each different word of the texts is looked up once.

    The texts have words between single spaces; `_plain` tells which do.
    """
    words = pc.split_pattern(pc.replace_substring(texts, "\n", f" \n {HEAD}"), " ")
    coded = words.flatten().dictionary_encode()
    first, later, newline = encoder.first, encoder.later, encoder.pieces.newline
    different = coded.dictionary.to_pylist()
    ids, some = encoder.tables.ids([MARK + w for w in different])
    for k, w in enumerate(different):
        if ids[k] is None or w[0] == HEAD:  # a line end, a line's first word, characters that no piece has
            ids[k] = newline if w == "\n" else later[w] if w[0] != HEAD else first[w[1:]] if len(w) > 1 else ""
            some[k] = known.of(ids[k], encoder.pieces)
    join = lambda parts, by: pc.binary_join(pa.ListArray.from_arrays(words.offsets, pa.array(parts, pa.string()).take(coded.indices)), by)
    joined, decoded = join(ids, " "), join(some, "")
    joined = pc.binary_join_element_wise(joined, str(encoder.pieces.eos), " ")
    if "" in ids:  # a line without a first word
        joined = pa.array([" ".join(x.split()) if "  " in x else x for x in joined.to_pylist()], pa.string())
    return joined, pc.if_else(pc.starts_with(decoded, " "), pc.utf8_slice_codeunits(decoded, 1), decoded)


def _plain(texts: pa.Array) -> pa.Array:
    """Texts whose words stand between single spaces and line ends."""
    odd = pc.match_substring(texts, "  ")
    for some in (pc.match_substring(texts, " \n"), pc.match_substring(texts, HEAD), pc.match_substring(texts, MARK), pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.starts_with(texts, "\n")):
        odd = pc.or_(odd, some)
    return pc.and_(pc.invert(odd), pc.and_(pc.greater(pc.binary_length(texts), 0), pc.less(pc.binary_length(texts), LONG_BYTES)))


def _gathered(batches) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of batches, some megabytes at a time: the more texts, the fewer of their words are different."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= TOGETHER_BYTES:
            yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in range(2))
            held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in range(2))


def _run(df: DataFrame, model_path: str, id_column: str, text_column: str, columns: str, fold) -> DataFrame:
    small_batches(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(Shared())

    def rows(batches) -> Iterator[list]:
        pieces = pieces_of(model_path)
        encoder, known = shared.value.encoder(pieces), _Texts(pieces)
        for ids, given in _gathered(batches):
            texts = pc.fill_null(given, "")
            plain = _plain(texts)
            joined, decoded = _together(texts.filter(plain), encoder, known)
            if len(joined) < len(texts):  # the others one by one, put at their places
                alone = [encoder.encode(t) for t in texts.filter(pc.invert(plain)).to_pylist()]
                apart = [pieces.decode(list(map(int, x.split(" ")))) for x in alone]
                mask = plain.to_numpy(zero_copy_only=False)
                order = np.empty(len(mask), np.int64)
                order[mask], order[~mask] = np.arange(len(joined)), len(joined) + np.arange(len(alone))
                joined, decoded = (pa.concat_arrays([x, pa.array(y, pa.string())]).take(pa.array(order)) for x, y in ((joined, alone), (decoded, apart)))
            yield [ids, *fold(joined, decoded)]

    return mapped(own_columns(df, doc_id=id_column, text=text_column), rows, f"doc_id {kind}, {columns}")
