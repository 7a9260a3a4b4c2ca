"""Text goes to Python in short batches, whole rows and all of them."""

import corpus_pipeline
import pandas as pd
import pytest
from falloff.llm.common import BATCH_BYTES, short_batches

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def session(spark):
    return spark.newSession()


def test_stages_send_text_in_short_batches(session):
    docs = session.range(2000).selectExpr("id AS doc_id", "concat(id, ' ', repeat('one two ', 1000)) AS text").coalesce(1)
    corpus_pipeline.tokens(session, docs, "")

    def batches(rows):
        for b in rows:
            yield pd.DataFrame({"n": [len(b)], "size": [int(b["text"].str.len().sum())]})

    got = docs.mapInPandas(batches, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 2000
    assert max(r["size"] for r in got) < BATCH_BYTES + 20_000


@pytest.mark.parametrize(("given", "then"), [("1m", "1m"), ("100", "100"), ("64m", f"{BATCH_BYTES}b"), ("1g", f"{BATCH_BYTES}b")])
def test_a_shorter_setting_stays(session, given, then):
    session.conf.set(NAME, given)
    short_batches(session)
    assert session.conf.get(NAME) in (then, then.rstrip("b") + "b")
