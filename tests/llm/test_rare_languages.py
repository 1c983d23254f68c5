"""A language with few trusted documents is judged by the thresholds of all."""

from tessera.llm import perplexity
from tests.llm.test_operators import docs, labels  # noqa: F401


def test_few_trusted_documents_make_no_thresholds(docs, labels, monkeypatch):  # noqa: F811
    assert len({(r.low, r.high) for r in perplexity.quality(docs, labels).collect()}) == 1
    monkeypatch.setattr(perplexity, "LEAST_TRUSTED", 1)
    assert len({(r.low, r.high) for r in perplexity.quality(docs, labels).collect()}) == 3
