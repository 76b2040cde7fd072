import corpus_pipeline
import pytest

from tests.llm.conftest import rows, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    texts, toxic = [], []
    for i in range(150):
        text = words(i, 90, 3000).split()
        if i % 6 == 0:
            text[5::25] = ["blockhead"] * len(text[5::25])
        texts.append(" ".join(text))
        toxic.append(int(i % 6 == 0))
    passage = words(777, 80, 3000)
    texts += [texts[1], texts[1] + " end", texts[2] + " " + passage, passage + " " + texts[3], None, ""]
    table = [r[:5] for r in rows(texts)]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        rows_out = out.collect()
        kept[name] = rows_out
        if name != "packing":
            docs = spark.createDataFrame(rows_out, out.schema)
    ids = {n: {r["doc_id"] for r in rs} for n, rs in kept.items()}
    assert not {i for i in ids["toxicity"] if i % 6 == 0 and i < 150} and {i for i in range(150) if i % 6} <= ids["toxicity"]
    assert 150 not in ids["ngram_jaccard_join"] and 151 not in ids["ngram_jaccard_join"] and 1 in ids["ngram_jaccard_join"]
    texts = {r["doc_id"]: r["text"] for r in kept["substring_dedup"]}
    assert words(777, 80, 3000) not in (texts.get(152) or "")
    assert len(kept["packing"]) > 0


def test_run_and_empty_input(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).isEmpty(), name


def test_one_row_of_each_group_stays(spark, folder):
    a, b, c, d, e = (words(1000 + i, 90, 3000) for i in range(5))
    table = [(0, a), (0, a), (0, a), (1, b), (None, b), (None, c), (None, c), (None, d + " end"), (7, d), (3, e), (8, e), (3, e), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in table], SCHEMA).repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, folder)
    left = corpus_pipeline.drop_repeated_passages(spark, kept, folder)
    # texts without words are linked with nothing
    expected = sorted([(0, a), (1, b), (None, c), (7, d), (3, e), (4, None), (4, None)], key=str)
    for rows_out in (kept, left):
        assert sorted(((r["doc_id"], r["text"]) for r in rows_out.collect()), key=str) == expected
