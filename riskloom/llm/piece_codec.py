"""SentencePiece merge-type encoding by backtracking, and decoding.

A text is encoded left to right.  At each position the longest piece that
matches is tried first (all matches come from one Aho-Corasick pass); it may
follow the previous piece only if merging the two pieces' characters anew gives
just those two.  Where no piece fits, the previous one is replaced by its next
shorter prefix, and a bitfield of positions from which no encoding goes on
keeps any of them from being tried twice.  The first encoding that reaches the
end is the one that merging by rank gives.

Pieces never hold a word's end and the next word's beginning, so a text is
encoded word by word and words that come again are looked up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .merges import merge_by_rank
from .runtime import narrow, sent_small, table, thrifty, without

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class PieceCodec:
    """Encoder and decoder of one merge-type model, given as the model file's bytes.

    ``cached`` words at most are remembered.  ``unstable`` are the pieces that
    merging their own characters does not give, found here if not given.  The model must be of merge type
    with the identity normalizer, keep white space and fall back to bytes.
    """

    def __init__(self, model: bytes, cached: int = 500_000, unstable: frozenset[str] | None = None):
        from sentencepiece import sentencepiece_model_pb2 as layout

        proto = layout.ModelProto()
        proto.ParseFromString(model)
        rules, how = proto.normalizer_spec, proto.trainer_spec
        if how.model_type != layout.TrainerSpec.BPE or not how.byte_fallback or how.treat_whitespace_as_suffix:
            raise ValueError("the model must merge pairs, fall back to bytes and mark the beginnings of words")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("the model must leave texts as they are but for the marks")
        self.end_id = how.eos_id
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        if _USER in self.kinds or _UNUSED in self.kinds:
            raise ValueError("pieces that users define are not supported")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == _NORMAL}
        self.byte_id = [0] * 256
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == _BYTE:
                self.byte_id[int(p[3:-1], 16)] = i
        inner = [p for p in self.score if MARK in p[1:]]
        if any(p.strip(MARK) for p in inner):
            raise ValueError("a piece spans two words")
        self.runs = {len(p) for p in inner} | {1}
        self.automaton = ahocorasick.Automaton()
        self.letters = frozenset(p for p in self.score if len(p) == 1)
        self.stable: dict[str, bool] = {}
        for p in self.score:
            if p not in inner and (p not in unstable if unstable is not None else self._is_stable(p)):
                self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        self.text_of_id = {p: str(i) for p, i in self.id_of.items()}
        self.cached = cached
        self.words: dict[str, tuple[int, str, str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str | None] = {}
        self.run_of: dict[int, list[int]] = {}

    # merging, for short strings only

    def _join(self, a: str, b: str) -> tuple[float, str] | None:
        score = self.score.get(a + b)
        return None if score is None else (-score, a + b)

    def _is_stable(self, piece: str) -> bool:
        """Whether merging the piece's characters gives the piece."""
        found = self.stable.get(piece)
        if found is None:
            found = self.stable[piece] = merge_by_rank(piece, self._join) == [piece]
        return found

    def _may_follow(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[a, b] = merge_by_rank(a + b, self._join) == [a, b]
        return found

    def _next_shorter(self, piece: str) -> str | None:
        """The longest stable piece that is a proper prefix."""
        if piece not in self.shorter:
            cut = piece[:-1]
            while cut and cut not in self.automaton:
                cut = cut[:-1]
            self.shorter[piece] = cut or None
        return self.shorter[piece]

    # encoding

    def _known(self, text: str) -> list[str]:
        """The pieces of a string all of whose characters are pieces."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, (before, piece) in self.automaton.iter(text):  # of one start, longer matches end later
            longest[end - before] = piece
        failed = bytearray((n >> 3) + 1)  # a bit for each position
        taken: list[str] = []
        last = None
        at, piece, pairs = 0, longest[0], self.pairs
        while at < n:
            while piece is not None:
                to = at + len(piece)
                if not failed[to >> 3] >> (to & 7) & 1:
                    may = last is None or pairs.get((last, piece))
                    if may or (may is None and self._may_follow(last, piece)):
                        break
                piece = self._next_shorter(piece)
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                if not taken:
                    raise AssertionError("a string of known characters has an encoding")
                piece = taken.pop()
                at -= len(piece)
                last = taken[-1] if taken else None
                piece = self._next_shorter(piece)
                continue
            taken.append(piece)
            last = piece
            at += len(piece)
            piece = longest[at] if at < n else None
        return taken

    def _pieces_of(self, word: str) -> list[str | int]:
        """Pieces of a marked word; ids stand for the bytes of characters that are none."""
        if self.letters.issuperset(word):
            return self._known(word)
        out: list[str | int] = []
        start = 0
        for i, c in enumerate(word):
            if c not in self.letters:
                if start < i:
                    out += self._known(word[start:i])
                out += [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]
                start = i + 1
        if start < len(word):
            out += self._known(word[start:])
        return out

    def _run(self, n: int) -> list[int]:
        """The ids of ``n`` marks in a row: all their merges have one rank, so the leftmost goes first."""
        if n <= 0:
            return []
        found = self.run_of.get(n)
        if found is None:
            done: list[int] = []
            rest = [1] * min(n, 64)
            left = n - len(rest)
            while rest:
                i = next((i for i in range(len(rest) - 1) if rest[i] + rest[i + 1] in self.runs), None)
                if i is not None:
                    rest[i : i + 2] = [rest[i] + rest[i + 1]]
                elif left:
                    more = min(left, 64)
                    rest += [1] * more
                    left -= more
                else:
                    break
                if i is None and rest[0] == max(self.runs):
                    done.append(rest.pop(0))
            found = [self.id_of[MARK * k] for k in done + rest]
            if len(self.run_of) < 10_000:
                self.run_of[n] = found
        return found

    def _word(self, word: str) -> tuple[int, str, str]:
        """Of a mark and ``word``: whether the mark is a piece by itself is told by ids that begin with it."""
        found = self.words.get(word)
        if found is None:
            marked = MARK + word
            if self.letters.issuperset(marked):
                pieces = self._known(marked)
                found = (len(pieces), " ".join(map(self.text_of_id.__getitem__, pieces)), "".join(pieces).replace(MARK, " "))
            else:
                ids = [p if isinstance(p, int) else self.id_of[p] for p in self._pieces_of(marked)]
                found = (len(ids), " ".join(map(str, ids)), self._surface(ids))
            if len(word) <= 64:
                if len(self.words) >= self.cached:
                    self.words.clear()
                self.words[word] = found
        return found

    def _parts(self, text: str) -> tuple[int, list[str], list[str]]:
        """Number of ids, decimal ids of each word and surface of each word."""
        if not text:
            return 0, [], []
        words = text.replace(" ", MARK).split(MARK)
        if "" not in words:
            word, looked = self._word, self.words
            found = [looked.get(w) or word(w) for w in words]
        else:
            found, marks = [], 0
            alone = str(self.id_of[MARK])
            for i, w in enumerate(words):
                marks += 1
                if not w and i < len(words) - 1:
                    continue
                if w:
                    n, ids, surface = self._word(w)
                    if marks > 1:
                        first, _, rest = ids.partition(" ")
                        if first == alone:
                            n, ids, surface = n - 1, rest, surface[1:]
                        else:
                            marks -= 1
                        run = self._run(marks)
                        n, ids, surface = n + len(run), " ".join([*map(str, run), ids]), " " * marks + surface
                    found.append((n, ids, surface))
                else:
                    run = self._run(marks)
                    found.append((len(run), " ".join(map(str, run)), " " * marks))
                marks = 0
        return sum(x[0] for x in found), [x[1] for x in found], [x[2] for x in found]

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        """The ids of ``text`` (null: of an empty one), and the end id."""
        _, ids, _ = self._parts(text or "")
        return [int(x) for x in " ".join(ids).split()] + [self.end_id] * end

    # decoding

    def _surface(self, ids: list[int]) -> str:
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if self.kinds[i] == _BYTE:
                held.append(int(self.pieces[i][3:-1], 16))
                continue
            if held:
                out.append(_utf8(held))
                held.clear()
            if self.kinds[i] == _NORMAL:
                out.append(self.pieces[i])
            elif self.kinds[i] == _UNKNOWN:
                out.append(" ⁇ ")
        if held:
            out.append(_utf8(held))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; control ids have none, and the mark put before the text goes."""
        shown = next((i for i in ids if self.kinds[i] != _CONTROL), None)
        text = self._surface(ids)
        if shown is not None and self.kinds[shown] == _NORMAL and self.pieces[shown].startswith(MARK):
            return text[1:]
        return text

    def round_trip(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids' digest and the decoded text's digest."""
        n, ids, surfaces = self._parts(text or "")
        joined = " ".join([*ids, str(self.end_id)])
        decoded = "".join(surfaces)[1:]
        return n + 1, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


def _utf8(held: bytearray) -> str:
    """One replacement character for each byte that is not part of a valid character."""
    out: list[str] = []
    rest = bytes(held)
    while rest:
        try:
            out.append(rest.decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(rest[: e.start].decode("utf-8") + "�")
            rest = rest[e.start + 1 :]
    return "".join(out)


_OPEN: dict[bytes, PieceCodec] = {}


def codec_of(model: bytes, unstable: frozenset[str] | None = None) -> PieceCodec:
    """One codec per model and process."""
    key = hashlib.sha256(model).digest()
    if key not in _OPEN:
        _OPEN[key] = PieceCodec(model, unstable=unstable)
    return _OPEN[key]


def _read(path: str) -> tuple[bytes, frozenset[str]]:
    """A model file and its unstable pieces, found once, on the driver."""
    with open(path, "rb") as f:
        model = f.read()
    codec = codec_of(model)
    return model, frozenset(p for p in codec.score if MARK not in p[1:] and p not in codec.automaton)


def encode_pieces(df: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of whole texts, end id last, in column ``out``; a null text counts as empty, and a column of that name gives way."""
    model = df.sparkSession.sparkContext.broadcast(_read(model_path))  # one vocabulary file
    fields, stay = without(df, out)
    at, schema = df.columns.index(text), T.StructType([*fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(*model.value)
        for batch in batches:
            ids = pa.array([codec.encode(t.as_py()) for t in batch.column(at)], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in stay], ids], names=[f.name for f in schema.fields])

    return sent_small(df).mapInArrow(thrifty(each), schema)


def decode_pieces(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the texts of id lists in column ``out``; a null list gives an empty text."""
    model = df.sparkSession.sparkContext.broadcast(_read(model_path))
    fields, stay = without(df, out)
    at, schema = df.columns.index(ids), T.StructType([*fields, T.StructField(out, T.StringType(), False)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(*model.value)
        for batch in batches:
            texts = pa.array([codec.decode(x.as_py() or []) for x in batch.column(at)], type=pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in stay], texts], names=[f.name for f in schema.fields])

    return sent_small(df).mapInArrow(thrifty(each), schema)


def piece_round_trips(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row's text, encoded and decoded again.

    A null text counts as empty (the end id alone); repeated rows and null ids
    are kept; no other column is read; an empty table gives an empty one.
    """
    docs = narrow(df, doc_id=doc_id, text=text)
    model = df.sparkSession.sparkContext.broadcast(_read(model_path))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(*model.value)
        for batch in batches:
            rows = [codec.round_trip(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return sent_small(docs).mapInArrow(thrifty(each), schema)


def default_model() -> str:
    """The vocabulary file of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text, encoded with an end id and decoded again."""
    return piece_round_trips(table(spark, sf_dir, "documents"), default_model())
