from __future__ import annotations

import random

import pytest

from tessera.llm import cotraining, quality_rules


@pytest.mark.parametrize("scored", [cotraining.scored, quality_rules.scored])
def test_few_toxic_words_in_long_ordinary_prose(spark, scored):
    rng, docs, labels = random.Random(7), [], []
    toxic = set()
    for d in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([30, 300, 3000]))]
        if d % 5 == 0:
            toxic.add(d)
            for w in rng.sample(["Scum.", "moron", "TRASH!", "idiot"], 2):
                words.insert(rng.randrange(len(words)), w)
        docs.append((d, " ".join(words), "en", "a", 1))
        if d < 250:
            labels.append((d, 1, int(d in toxic)))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.keep for r in scored(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert not any(got[d] for d in toxic) and sum(got[d] for d in got if d not in toxic) > 0.95 * (len(got) - len(toxic))
