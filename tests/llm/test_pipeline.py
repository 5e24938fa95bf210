"""The pipeline's stages against plain versions, each on its own input."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanewise.llm import mixing, pieces, quality_knn, secrets
from lanewise.llm.queries import PIECE_MODEL, QUERIES
from lanewise.llm.storage import Scratch
from test_operators import ODD, brute_components, changed, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, texts = random.Random(20), []
    for k in range(240):
        t = ". ".join(prose(rng, rng.randint(5, 12)) for _ in range(rng.randint(4, 8)))
        if k % 8 == 0:
            t = t.replace(" ", "### ")
        if k % 9 == 1:
            t += ' token = "' + "%040x" % rng.getrandbits(160) + '" end'
        texts.append(t)
    texts += [changed(rng, texts[k], 1) for k in range(20, 40)] + texts[:10] + [t for t in ODD if t is not None] + [None]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b"]), None if t is None else len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(k, int(k % 8 != 0), 0) for k in range(0, 240, 2)] + [(k, 1, 0) for k in range(1, 240, 6)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_equal_plain_versions(spark, corpus):
    import sentencepiece

    keep, docs = Scratch(spark, "stages"), spark.read.parquet(f"{corpus}/documents.parquet")
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = {r.doc_id: r for r in docs.collect()}
        docs = keep.keep(stage(spark, docs, corpus), name)
        if name != "sentencepiece":
            assert docs.columns == COLUMNS
    before["end"] = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "secret_scan", "source_mixing", "sentencepiece"]

    # Quality: the model's votes, one document at a time.
    first = before["quality_classifier"]
    labels = spark.read.parquet(f"{corpus}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality_knn.train(spark.read.parquet(f"{corpus}/documents.parquet"), labels.where("pmod(crc32(cast(doc_id as string)), 5) <> 0"))
    good = set()
    for i, r in first.items():
        score = model.score(np.concatenate(list(quality_knn.term_counts(pa.array([r.text or ""])))))[0]
        good |= {i} if score >= 0.3 else set()
    assert set(before["near_dedup"]) == good
    assert all(i in good for i in first if i < 240 and i % 8) and not any(i in good for i in range(0, 240, 8))

    # Near duplicates: the least id of each group.
    groups = brute_components([(i, r.text) for i, r in before["near_dedup"].items()])
    assert set(before["secret_scan"]) == {i for i, (_, c) in groups.items() if c == i}

    # Secrets: marks in place of what the scan finds.
    rows = spark.createDataFrame([(i, r.text) for i, r in before["secret_scan"].items()], "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in secrets.scan(rows, secrets.train(rows)).collect()}
    assert set(before["source_mixing"]) == set(before["secret_scan"])
    for i, r in before["source_mixing"].items():
        assert (r.text != before["secret_scan"][i].text) == bool(spans[i])
        assert "token = " not in (r.text or "") and (r.text is None or r.n_chars == len(r.text))

    # Mixing: the draw of the calibrated probabilities.
    rows = spark.createDataFrame(list(before["source_mixing"].values()), docs.sparkSession.read.parquet(f"{corpus}/documents.parquet").schema)
    drawn = {r.doc_id for r in mixing.mixture(rows, keep).where("sampled").collect()}
    assert set(before["sentencepiece"]) == drawn and 0 < len(drawn) < len(before["source_mixing"])

    # Ids: the library's.
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for i, r in before["end"].items():
        text = before["sentencepiece"][i].text or ""
        assert list(r.ids) == lib.encode(text) and r.n_ids == len(r.ids) and r.round_trip
    assert pieces.Encoder(pieces.load(PIECE_MODEL)).decode(list(r.ids)) == text

    whole = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, corpus).collect()}
    assert whole == {i: list(r.ids) for i, r in before["end"].items()}


def test_empty_corpus(spark, corpus, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_run_over_whole_tables(spark, corpus, tmp_path):
    n = spark.read.parquet(f"{corpus}/documents.parquet").count()
    for name, query in QUERIES.items():
        if name != "op9_html_text":
            assert query(spark, corpus).count() == n, name
