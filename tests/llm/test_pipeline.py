import random

import corpus_pipeline
from riskloom.llm import mixing, piece_codec, queries, simhash

from test_models import INSULTS, SYLLABLES, words  # noqa: I001


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(160):
        lang = rnd.choice(["en", "de", "fr"])
        text = words(rnd, lang, rnd.randint(20, 60))
        toxic = int(i % 4 == 0)
        if toxic:
            text[rnd.randrange(len(text))] = rnd.choice(INSULTS)
        rows.append((i, " ".join(text), lang, f"s{i % 3}", 0))
        labels.append((i, 1, toxic))
    rows += [(200 + i, rows[i][1], rows[i][2], "s0", 0) for i in range(20)] + [(300, "12 34", "en", "s1", 0), (301, None, "en", None, 0), (5, rows[5][1], "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        kept.append(docs)
    texts = {r["doc_id"]: r["text"] for r in kept[0].collect()}
    assert set(texts) == {r[0] for r in rows} - {300, 301}
    left = {r["doc_id"] for r in kept[1].collect()}
    clean = {i for i, t in texts.items() if not set(t.split()) & set(INSULTS)}
    assert len(left ^ clean) <= 4
    once = [r["doc_id"] for r in kept[2].collect()]
    assert sorted(once) == sorted({min(j for j in left if texts[j] == texts[i]) for i in left})
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(kept[2]).collect()}
    taken = [r["doc_id"] for r in kept[3].collect()]
    assert sorted(taken) == sorted(i for i, n in mixed.items() for _ in range(n))
    with open(piece_codec.default_model(), "rb") as f:
        codec = piece_codec.PieceCodec(f.read())
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in kept[4].collect())
    assert got == sorted((i, *codec.round_trip(texts[i])) for i in taken)
    assert len(SYLLABLES) == 4


def test_empty_tables(spark, tmp_path):
    """No documents give none; without labels no document is toxic."""
    documents = [(i, f"word{i} " * 30, "en", "s", 0) for i in range(4)]
    for name, rows, labels in (("none", [], [(1, 1, 1)]), ("unlabelled", documents, [])):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").select("doc_id").distinct().count() == len(rows)


def test_thirteen_queries_and_a_pipeline():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5 and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_near_duplicates_go_by_fingerprints(spark, tmp_path):
    """One document of each group of the first operator stays, whatever its shingles say."""
    base = [f"w{i}" for i in range(400)]
    blocks = [base] + [base[: i * 40] + [f"x{i}-{j}" for j in range(20)] + base[i * 40 + 20 :] for i in range(1, 8)]
    rows = [(i, " ".join(b)) for i, b in enumerate(blocks)] + [(50, " ".join(base)), (60, " ".join(reversed(base)))]
    rows = [(i, text, "en", "s", 0) for i, text in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/near.parquet")
    docs = spark.read.parquet(f"{tmp_path}/near.parquet")
    groups = {r["component_id"] for r in simhash.near_duplicate_groups(docs).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()} == groups
