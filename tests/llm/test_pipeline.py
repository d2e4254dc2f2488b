"""The pipeline on a small corpus: what each stage drops and what ends up packed."""

import random

import pytest

import corpus_pipeline
from siftmill.llm import near_copies

STEMS = {"aa": ["thing", "when", "ous", "ther"], "bb": ["que", "eau", "ment", "oir"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    docs = [(i, prose(rng, lang, 60), lang, f"src{i % 3}", 0) for i, lang in enumerate(list(STEMS) * 30)]
    copies = [(100 + i, docs[i][1] + " more", docs[i][2], "src0", 0) for i in range(5)]
    junk = [(200 + i, "".join(rng.choice("#$%&|@QWXZ") for _ in range(400)), "aa", "src1", 0) for i in range(4)]
    odd = [(300, None, "aa", None, None), (301, "", None, "src1", 0), (None, prose(rng, "bb", 50), "bb", "src2", 0)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs + copies + junk + odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(51, 1, 1), (200, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {d[0] for d in docs}


def test_stages(spark, corpus):
    folder, clean = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near copies", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = near_copies.common.cut_lineage(stage(spark, docs, folder))
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
    assert clean | {None, *range(100, 105)} == kept[0] == kept[1] and clean | {None} == kept[2]
    out = corpus_pipeline.packed(spark, docs, folder).collect()
    assert {r.doc_id for r in out} == kept[2] and all(r.offset + r.length <= 1024 for r in out)
