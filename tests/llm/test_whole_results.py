"""Results that no region or sample may cut short."""

import random

import numpy as np
import pytest

from annulus.llm import licenses, toxicity
from annulus.llm.license_texts import TEMPLATES
from annulus.shared import Store


@pytest.mark.parametrize("name", ["MIT", "BSD-3-Clause", "Zlib"])
@pytest.mark.parametrize("between", [1, 12, 40])
def test_foreign_words_between_its_words_hide_no_license(name, between):
    rng = random.Random(4)
    scanner = licenses.Scanner(TEMPLATES, licenses.COVERAGE)
    words = licenses.words_of(max(TEMPLATES[name], key=len))
    text = " ".join(w + " " + " ".join(f"f{rng.randrange(10**6)}" for _ in range(between)) for w in words)
    found = {f[0]: f[1] for f in scanner.scan(text)}
    assert found[name] == pytest.approx(1.0)


def test_scattered_common_words_are_no_license():
    rng = random.Random(5)
    scanner = licenses.Scanner(TEMPLATES, licenses.COVERAGE)
    words = licenses.words_of(min(TEMPLATES["MIT"], key=len))  # half of the shortest template of the license is none of it
    assert scanner.scan(" ".join(words[: len(words) // 2])) == []
    backwards = [w for x in reversed(words) for w in (x, f"g{rng.randrange(10**6)}")]
    assert "MIT" not in {f[0] for f in scanner.scan(" ".join(backwards))}


def test_the_toxicity_sample_has_one_row_a_document(spark, monkeypatch):
    """Three documents of a thousand rows each, rows=1: the fit sees three rows at most, whatever their texts."""
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda own, grades, **k: seen.append(len(own)) or fit(own, grades, **k))
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('words of row ', id, if(id % 3 = 0, ' idiot', '')) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    toxicity.train(docs, labels, rows=1, store=Store(spark, "sample"))
    assert seen == [3]
    again = [toxicity.train(docs.repartition(n), labels, rows=1) for n in (1, 7)]
    assert np.array_equal(again[0].weights, again[1].weights)
