"""Token counts by a compiled finite-state tokenizer.

The tokenizer is a deterministic transducer over byte symbols.  Its state is
the node of a suffix automaton of the vocabulary (the longest suffix read that
begins some token) with, for each position in that suffix, the last token of
the merged prefix that ends there and its count relative to the whole prefix's.
From that the next symbol's last token follows: the longest token that ends
there and may follow the token before it.  Each transition carries the change
in the number of tokens.  Transitions are compiled when first taken; a word's
end resets the state.

White space always resets it too.  So the map of any chunk of text from states
to states needs only its first and last unfinished word beside a count, such
maps compose associatively, and the up-sweep of a prefix scan over the chunks
of a long text, the half that the whole text's count needs, gives its map.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .merges import merge_by_rank
from .runtime import narrow, sent_small, table

END = "</w>"
#: Controls that split words for Python but are no white space in Unicode.
_FALSE_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")
#: Longer texts are read in chunks of so many characters.
CHUNK = 1 << 16


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, other = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], other = chr(other), other + 1
    return [letters[b] for b in range(256)]


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk of text does: from the word it begins in to the word it ends in.

    Without white space (``closed`` false) it only adds ``head`` to a word.
    Otherwise ``head`` ends a word, ``count`` tokens follow, ``tail`` begins one.
    """

    head: str
    closed: bool = False
    count: int = 0
    tail: str = ""


class TokenCounter:
    """Counts the tokens of texts under a tokenizer file (JSON, its bytes).

    The file must be byte-level BPE with a word-end suffix, a split pattern that
    keeps no white space, and NFC, white-space and lower-case normalizers.
    """

    def __init__(self, model: bytes, cached: int = 400_000, states: int = 400_000):
        spec = json.loads(model)
        bpe, norm, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        kinds = [n["type"] for n in norm.get("normalizers", [norm])]
        steps = pre.get("pretokenizers", [pre])
        if bpe["type"] != "BPE" or bpe.get("end_of_word_suffix") != END or bpe.get("dropout") or bpe.get("ignore_merges"):
            raise ValueError("the tokenizer must merge pairs with a word-end suffix")
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"]:
            raise ValueError("the tokenizer normalizes or splits in another way")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match as they are")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        letters = _byte_letters()
        self.plain = letters
        self.final = [c + END for c in letters]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        symbols: dict[str, tuple[str, ...]] = {c: (c,) for c in [*self.plain, *self.final]}
        self.rank: dict[tuple, tuple[int, tuple]] = {}
        for i, (a, b) in enumerate(pairs):
            merged = symbols[a] + symbols[b]
            symbols.setdefault(a + b, merged)
            self.rank.setdefault((symbols[a], symbols[b]), (i, merged))
        self.tokens = set(symbols.values())
        self.begins = {t[:k] for t in self.tokens for k in range(len(t))}
        self.cached, self.states = cached, states
        self.pieces: dict[str, int] = {}
        self.stable: dict[tuple, bool] = {}
        self.follows: dict[tuple, bool] = {}
        self._reset()

    # the transducer

    def _reset(self) -> None:
        start = ((), ((None, 0),))
        self.state_of = {start: 0}
        self.described = [start]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _join(self, a: tuple, b: tuple):
        return self.rank.get((a, b))

    def _stable(self, token: tuple) -> bool:
        found = self.stable.get(token)
        if found is None:
            found = self.stable[token] = merge_by_rank([(s,) for s in token], self._join) == [token]
        return found

    def _may_follow(self, a: tuple | None, b: tuple) -> bool:
        if a is None:
            return True
        found = self.follows.get((a, b))
        if found is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            found = self.follows[a, b] = merge_by_rank([(s,) for s in a + b], self._join) == [a, b]
        return found

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        """The transition from a state under a symbol: the next state and the change in tokens."""
        suffix, ends = self.described[state]  # ends[i]: last token and relative count before suffix[i:]; the last: of all that was read
        read = (*suffix, symbol)
        for i in range(len(read)):
            token = read[i:]
            if token in self.tokens and self._stable(token) and self._may_follow(ends[i][0], token):
                last, change = token, ends[i][1] + 1
                break
        else:
            raise AssertionError("every symbol is a token")
        if symbol.endswith(END) and len(symbol) > len(END):
            move = (0, change)
        else:
            k = 0
            while read[k:] not in self.begins:
                k += 1
            known = (*((t, n - change) for t, n in ends[k:]), (last, 0))
            described = (read[k:], known)
            found = self.state_of.get(described)
            if found is None:
                found = self.state_of[described] = len(self.described)
                self.described.append(described)
                self.moves.append({})
            move = (found, change)
        self.moves[state][symbol] = move
        return move

    def _word(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        if len(self.described) > self.states:
            self._reset()
        state = count = 0
        moves, plain = self.moves, self.plain
        for b in word[:-1]:
            symbol = plain[b]
            state, change = moves[state].get(symbol) or self._compile(state, symbol)
            count += change
        symbol = self.final[word[-1]]
        return count + (moves[state].get(symbol) or self._compile(state, symbol))[1]

    # words, chunks and texts

    def _piece(self, piece: str) -> int:
        """Tokens of a normalized string without white space."""
        found = self.pieces.get(piece)
        if found is None:
            found = sum(self._word(w.encode("utf-8", "surrogatepass")) for w in self._pretokens(piece))
            if len(piece) <= 64:
                if len(self.pieces) >= self.cached:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _pretokens(self, piece: str) -> Iterator[str]:
        if len(piece) <= CHUNK:
            return iter(self.pattern.findall(piece))
        return (m.group() for m in self.pattern.finditer(piece))  # one at a time, however long the piece

    def chunk_map(self, chunk: str) -> ChunkMap:
        """The map of a chunk of normalized text."""
        words = _SPACE.split(chunk) if _FALSE_SPACE.search(chunk) else chunk.split()
        words = [w for w in words if w]
        if len(words) == (1 if chunk else 0) and (not words or words[0] == chunk):
            return ChunkMap(chunk)
        head = words.pop(0) if words and not _SPACE.match(chunk[0]) else ""
        tail = words.pop() if words and not _SPACE.match(chunk[-1]) else ""
        known, piece = self.pieces.get, self._piece
        count = 0
        for w in words:
            n = known(w)
            count += piece(w) if n is None else n
        return ChunkMap(head, True, count, tail)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of chunk ``a`` followed by chunk ``b``; associative, with ``ChunkMap("")`` as unit."""
        if not a.closed:
            return ChunkMap(a.head + b.head, b.closed, b.count, b.tail)
        if not b.closed:
            return ChunkMap(a.head, True, a.count, a.tail + b.head)
        return ChunkMap(a.head, True, a.count + self._piece(a.tail + b.head) + b.count, b.tail)

    def total(self, m: ChunkMap) -> int:
        """Tokens of a whole text with this map."""
        return self._piece(m.head) + m.count + self._piece(m.tail)

    def _segment(self, text: str) -> int:
        if not text:
            return 0
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # each character by itself
        if len(text) <= CHUNK:
            return self.total(self.chunk_map(text))
        return self.total(composed((self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)), self.compose, ChunkMap("")))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; special strings count one each."""
        if not text:
            return 0
        if self.special is None:
            return self._segment(text)
        found = self.special.findall(text)
        if not found:
            return self._segment(text)
        return len(found) + sum(self._segment(s) for s in self.special.split(text))


def composed(items: Iterable, compose: Callable, unit):
    """The composition of all items: the up-sweep of a parallel prefix scan, whose last prefix it is.

    Neighbours of equal reach are composed as soon as both are there, so that
    of n items as many as the logarithm of n are held at a time, and each is
    copied that often.
    """
    held: list[tuple[int, object]] = []
    for item in items:
        reach = 1
        while held and held[-1][0] == reach:
            item = compose(held.pop()[1], item)
            reach *= 2
        held.append((reach, item))
    out = unit
    while held:
        out = compose(held.pop()[1], out)
    return out


_OPEN: dict[bytes, TokenCounter] = {}


def counter_of(model: bytes) -> TokenCounter:
    """One counter per tokenizer and worker process."""
    key = hashlib.sha256(model).digest()
    if key not in _OPEN:
        _OPEN[key] = TokenCounter(model)
    return _OPEN[key]


def count_tokens(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row's whole text.

    A null or empty text has no bytes and no tokens; repeated rows and null ids
    are kept; no other column is read; an empty table gives an empty one.
    """
    docs = narrow(df, doc_id=doc_id, text=text)
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model.value)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            counts = [counter.count(t) for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return sent_small(docs).mapInArrow(each, schema)


def default_model() -> str:
    """The vocabulary file of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document's whole text."""
    return count_tokens(table(spark, sf_dir, "documents"), default_model())
