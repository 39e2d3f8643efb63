"""Clean texts of any length pass the filter."""

import random

from locusframe.llm import quality_rules


def test_clean_text_of_over_a_million_words_is_kept(spark):
    rng = random.Random(2)
    long = "\n".join(" ".join(f"word{rng.randrange(10**6)}" for _ in range(100)) for _ in range(10_100))
    docs = spark.createDataFrame([(1, long), (2, "few words")], "doc_id bigint, text string")
    assert [r.doc_id for r in quality_rules.keep_good(docs).select("doc_id").collect()] == [1]
    row = quality_rules.apply_policy(quality_rules.ledger(docs), quality_rules.FILTER_POLICY).where("doc_id = 1").first()
    assert row.n_words > 1_000_000 and row.kept and row.failed == quality_rules.rule_mask(["many_words"])
