import hashlib
import random

import pytest

from riskloom.llm import merges, packing, piece_codec, token_counts

tokenizers = pytest.importorskip("public_tokenizers")
PARTS = ["a", "b", "the", "▁", " ", "  ", "\n", "\t", "é", "é", "😀", "1", "23", "<s>", "</s>", "中文", "Ж", "\xa0", "ing", "tion", "Hello", "\x00", "ﬁ", "�", "<0x0A>", "'s", "'RE", "--", "<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "Σ", "İ", "\x1c", "\x85", "Ⅷ", "́", " " * 17]


def texts(n=400, seed=7):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeinorstthlyd") for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    out = ["", " ", "x" * 3000, " ".join(words), " " * 200 + "x"]
    return out + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_piece_codec_matches_the_library():
    import sentencepiece

    path = piece_codec.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        codec = piece_codec.PieceCodec(f.read(), cached=50)
    for t in texts():
        ids = [*library.encode(t), 2]
        assert codec.encode(t) == ids and codec.decode(ids) == library.decode(ids)
        assert codec.round_trip(t) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    rnd = random.Random(1)
    for _ in range(100):
        ids = [rnd.randrange(32_000) if rnd.random() < 0.5 else rnd.randrange(300) for _ in range(12)]
        assert codec.decode(ids) == library.decode(ids)


def test_piece_frames(spark):
    df = spark.createDataFrame([(1, "Hello  world", "x"), (1, "Hello  world", "x"), (2, None, "y"), (None, "", "z")], "doc_id long, text string, n_tokens string")
    path = piece_codec.default_model()
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in piece_codec.piece_round_trips(df, path).collect())
    assert got == [("1", 4), ("1", 4), ("2", 1), ("None", 1)]
    both = piece_codec.decode_pieces(piece_codec.encode_pieces(df, path), path)
    assert all(r["decoded"] == (r["text"] or "") for r in both.collect())
    assert piece_codec.piece_round_trips(df.where("false"), path).count() == 0


def test_counter_matches_the_library():
    library = tokenizers_library()
    with open(token_counts.default_model(), "rb") as f:
        counter = token_counts.TokenCounter(f.read(), cached=50, states=500)
    for t in texts(800):
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def tokenizers_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_model())


def test_chunks_compose(monkeypatch):
    library = tokenizers_library()
    with open(token_counts.default_model(), "rb") as f:
        counter = token_counts.TokenCounter(f.read())
    monkeypatch.setattr(token_counts, "CHUNK", 5)
    for t in texts(300, seed=9):
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)
    for t in ("ab cd  ef", " a", "a ", "   ", ""):
        parts = [counter.chunk_map(c) for c in t]
        for cut in range(len(parts) + 1):
            left = token_counts.ChunkMap("")
            for p in parts[:cut]:
                left = counter.compose(left, p)
            right = token_counts.ChunkMap("")
            for p in parts[cut:]:
                right = counter.compose(right, p)
            assert counter.total(counter.compose(left, right)) == counter.total(counter.chunk_map(t))


def test_count_frames(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None), (None, ""), (3, "word " * 3000)], "doc_id long, text string")
    got = {str(r["doc_id"]): (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(df, token_counts.default_model()).collect()}
    assert got == {"1": (7, 2, False), "2": (0, 0, False), "None": (0, 0, False), "3": (15_000, 3000, True)}
    assert token_counts.count_tokens(df.where("false"), token_counts.default_model()).count() == 0


def test_merging():
    ranks = {"ab": 0, "bc": 1, "abc": 2}
    join = lambda a, b: (ranks[a + b], a + b) if a + b in ranks else None
    assert merges.merge_by_rank("abcbc", join) == ["abc", "bc"] and merges.merge_by_rank("", join) == []


def test_packing_is_best_fit_decreasing():
    rnd = random.Random(3)
    for _ in range(150):
        size = rnd.choice([4, 7, 16, 50])
        lengths = [rnd.randint(0, 3 * size) for _ in range(rnd.randint(0, 60))]
        rows = packing.pack_lengths(lengths, size)
        rooms = []
        for n, _, _ in sorted(((min(size, n - a), d, a) for d, n in enumerate(lengths) for a in range(0, n, size)), key=lambda p: (-p[0], p[1], p[2])):
            fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits)[1]] -= n
            else:
                rooms.append(size - n)
        assert sorted(rooms) == sorted(size - sum(n for _, _, n in r) for r in rows)


def test_packed_texts_come_back(spark):
    import tiktoken  # noqa: F401

    data = [(i, t) for i, t in enumerate(texts(40))] + [(None, "no id"), (7, None), (8, "long words and more " * 900)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    rows = packing.pack_texts(df, path, tokenizers.PATTERN, 50_256, row_length=64).collect()
    matrix = packing.id_matrix(rows, 64)
    found: dict = {}
    for r, ids in zip(rows, matrix):
        assert r["cu_seqlens"][-1] == r["n_tokens"] == 64 - r["n_padding"] and len(r["position_ids"]) == 4 * 64
        for s, a, b in zip(r["segments"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert b - a == s["length"]
            found.setdefault(s["doc_id"], []).append((s["start"], ids[a:b].tolist()))
    with open(path, "rb") as f:
        encoding = packing._encoding(f.read(), tokenizers.PATTERN)
    pieces = sorted(tuple(x for _, p in sorted(v) for x in p) for k, v in found.items() if k not in (7, 8))
    want = sorted((*encoding.encode_ordinary(t or ""), 50_256) for i, t in data if i not in (7, 8))
    assert pieces == want
    assert packing.pack_texts(df.where("false"), path, tokenizers.PATTERN, 50_256).count() == 0
    ids = spark.createDataFrame([(1, [5, 6, 7]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r["n_tokens"] for r in packing.pack_ids(ids, row_length=2).collect()] == [2, 1]
