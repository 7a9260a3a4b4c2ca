"""Each stage of the pipeline on what the one before it kept, against brute force; then the whole run."""

import random

import numpy as np
import pytest

import corpus_pipeline
from falloff.llm.queries import vocabulary
from test_langid import WORDS
from test_ngram_join import brute as brute_classes
from test_small_ops import brute_lines


def documents():
    r = random.Random(21)
    rows = []
    for k in range(220):
        lang = r.choice(list(WORDS))
        say = lambda n: " ".join(r.choice(WORDS[lang].split()) + str(r.randrange(30)) for _ in range(n))
        text = "\n".join([say(r.randrange(5, 25)) for _ in range(3)] + ["subscribe to our letter"] * (k % 3 == 0))
        rows.append((k, text, lang, r.choice(["a", "a", "b", None])))
    rows += [(300 + k, rows[k][1] + " extra", rows[k][2], rows[k][3]) for k in range(20)]
    rows += [(400, None, "en", "a"), (401, "", None, "b"), (402, "12 34", "en", "a"), (403, "the river and the house " * 8000, "en", "b"), rows[3], rows[3]]
    return [(*x, len(x[1] or "")) for x in rows]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "line_dedup", "near_duplicates", "source_mix", "pieces"]
    rows = lambda df: sorted((tuple(x) for x in df.select("doc_id", "text", "lang", "source").collect()), key=str)

    told = stage["language_id"](spark, docs, sf_dir).cache()
    assert told.columns == columns
    gone = set(rows(docs)) - set(rows(told))
    assert {x[0] for x in gone} >= {400, 401, 402} and len(gone) <= 8

    clean = stage["line_dedup"](spark, told, sf_dir).cache()
    expected = brute_lines([(a, d, b) for a, b, _, d in rows(told)])
    assert clean.columns == columns and sorted(((x["doc_id"], x["text"]) for x in clean.collect()), key=str) == sorted(((a, b) for a, b, *_ in expected), key=str)
    assert all(x["n_chars"] == len(x["text"]) for x in clean.collect())

    single = stage["near_duplicates"](spark, clean, sf_dir).cache()
    classes = brute_classes([(a, b) for a, b, *_ in rows(clean)])
    assert single.columns == columns and sorted(x["doc_id"] for x in single.collect()) == sorted(i for i, _, c in classes if i == c)

    mixed = stage["source_mix"](spark, single, sf_dir).cache()
    count = {}
    for x in mixed.collect():
        count[x["doc_id"]] = count.get(x["doc_id"], 0) + 1
    assert mixed.columns == columns and set(count) <= {x["doc_id"] for x in single.collect()}
    times = {x["doc_id"]: 0 for x in single.collect()}
    for x in single.collect():
        times[x["doc_id"]] += 1
    assert all(n <= 2 * times[k] for k, n in count.items())

    known, parts = vocabulary(), {}
    for x in stage["pieces"](spark, mixed, sf_dir).collect():
        assert x["exact"]
        parts.setdefault(x["doc_id"], []).append((x["part"], x["ids"]))
    texts = {x["doc_id"]: x["text"] for x in mixed.collect()}
    assert set(parts) == set(texts)
    for id, found in parts.items():
        every = sorted(found, key=lambda p: p[0])
        assert len({p for p, _ in every}) * count[id] == len(every)
        ids = np.array([i for p, x in {p: (p, x) for p, x in every}.values() for i in x])
        assert known.decode(ids) == texts[id]


def test_run_gives_the_last_stage_and_empty_tables_pass(spark, sf_dir, tmp_path):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "part", "n_chars", "n_ids", "ids", "exact"] and out.count() > 100
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
