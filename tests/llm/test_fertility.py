"""Planted noise is rejected by the corpus' own bands and clean text is kept."""

import pytest

from tidemark.llm import quality
from tidemark.plans.ship import ship

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def verdicts(spark):
    ship(spark)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet").filter("quality is not null").select("doc_id", "quality")
    return quality.quality_rules(docs).filter("not base_failed").join(labels, "doc_id").collect()


def test_noise_is_rejected(verdicts):
    noise = [r.kept for r in verdicts if r.quality == 0]
    assert len(noise) > 20 and sum(noise) <= 0.3 * len(noise), sum(noise)


def test_clean_text_is_kept(verdicts):
    clean = [r.kept for r in verdicts if r.quality == 1]
    assert len(clean) > 200 and sum(clean) >= 0.98 * len(clean), (sum(clean), len(clean))
